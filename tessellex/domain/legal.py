"""The legal rule pack. All of these are fixed values."""

from __future__ import annotations

# Intents: (pattern, confidence) in order of declaration.
INTENTS = {
    "labor": (
        (r"辞退|解雇|开除|解除.{0,4}劳动合同|裁员", 0.90), (r"经济补偿|补偿金|赔偿金|N\+1|2N|双倍工资|n\+1", 0.85), (r"竞业限制|竞业协议|保密协议|竞业禁止", 0.85),
        (r"加班|加班费|工时|年假|带薪休假|调休", 0.80), (r"社保|五险一金|工伤保险|工伤|公积金", 0.80), (r"劳动仲裁|劳动争议|劳动合同|试用期|拖欠工资", 0.90),
    ),
    "contract": ((r"合同.{0,6}(解除|无效|撤销|违约|履行|变更)", 0.85), (r"违约|违约金|定金|订金|买卖合同|借款|借贷|借条|欠条", 0.80), (r"租赁|房租|押金|退租", 0.80)),
    "family": ((r"离婚|协议离婚|诉讼离婚|抚养权|抚养费|探视权", 0.85), (r"财产分割|夫妻.{0,4}财产|共同财产|彩礼", 0.80), (r"继承|遗嘱|遗赠|赡养|遗产|法定继承", 0.85)),
    "criminal": ((r"犯罪|罪名|量刑|刑期|判刑|取保候审|缓刑|羁押", 0.85), (r"盗窃|诈骗|故意伤害|抢劫|交通肇事|职务侵占|刑事", 0.80)),
    "company": ((r"公司|股权|股东|法人|注册.{0,3}公司|章程|分红", 0.80), (r"破产|清算|解散|增资|减资", 0.80)),
    "ip": ((r"商标|专利|著作权|版权|知识产权|侵权.{0,4}(作品|商标|专利)", 0.85), (r"抢注|抄袭|盗版|专利申请", 0.80)),
    "admin": ((r"行政处罚|行政复议|行政诉讼|行政许可", 0.85), (r"拆迁|征收|征地|城管|罚款", 0.80)),
}
INTENT_LABELS = {"labor": "劳动争议", "contract": "合同纠纷", "family": "婚姻家事", "criminal": "刑事", "company": "公司商事", "ip": "知识产权", "admin": "行政"}
CATEGORIES = {
    "labor": ("劳动", "辞退", "补偿", "竞业", "加班", "社保", "工伤", "仲裁", "工资"),
    "contract": ("合同", "违约", "借款", "借条", "租赁", "定金", "买卖"),
    "family": ("离婚", "抚养", "继承", "遗嘱", "赡养", "彩礼", "财产分割"),
    "criminal": ("犯罪", "罪名", "量刑", "盗窃", "诈骗", "取保", "刑期"),
    "company": ("公司", "股权", "股东", "破产", "清算", "章程"),
    "ip": ("商标", "专利", "著作权", "版权", "侵权", "盗版"),
    "admin": ("行政处罚", "行政复议", "行政诉讼", "拆迁", "征收", "许可"),
}
IN_SCOPE = (
    "法律", "法条", "法规", "合同", "劳动", "离婚", "继承", "赔偿", "仲裁", "诉讼", "犯罪", "公司", "股权", "商标", "专利", "侵权", "违约", "辞退",
    "竞业", "工伤", "社保", "加班", "借款", "租赁", "遗嘱", "抚养", "量刑", "刑事", "违约金", "定金", "欠条", "借条", "产权", "著作权", "处罚", "拆迁",
)
OUT_OF_SCOPE = (r"血糖|血压|糖尿病|高血压|看病|挂号|症状|吃什么药|处方", r"天气|翻译|写代码|编程|做饭|菜谱")
DANGER = (r"自杀|自残|结束生命|轻生", r"制作.{0,3}(炸弹|毒品|毒药)|买.{0,3}(枪|毒)")
EMERGENCY = (r"仲裁时效|诉讼时效|除斥期间|时效.{0,4}(届满|经过|过期|中断|中止)", r"财产保全|证据保全|查封|冻结|扣押", r"即将.{0,4}过期|马上.{0,4}到期|临近.{0,4}期限|只剩.{0,4}(天|个月)")
GUARD_DISCLAIMERS = ("不构成法律意见", "建议咨询律师", "请咨询执业律师", "仅供参考", "咨询专业律师")
DISCLAIMERS = ("不构成法律意见", "仅供参考", "建议咨询律师", "请咨询执业律师", "咨询专业律师", "以专业律师意见为准", "不建立律师")
OVERPROMISE = r"肯定能赢|一定胜诉|保证胜诉|包赢|必胜|稳赢|百分百.{0,3}(赢|胜)|胜诉率.{0,6}\d{1,3}%|胜算.{0,6}\d{1,3}%"
FORBIDDEN = ((r"肯定能赢|一定胜诉|保证胜诉|包赢|必胜|稳赢", "promise"), (r"胜诉率.{0,6}\d{1,3}%|胜算.{0,6}\d{1,3}%", "win_rate"), (r"我(?:是|作为|以).{0,6}(?:律师|执业律师)|本律师", "impersonation"))
CRITICAL = (
    (r"肯定能赢|一定胜诉|保证胜诉|包赢|必胜|稳赢|百分百.{0,3}(?:赢|胜)", "overpromise"), (r"胜诉率.{0,6}\d{1,3}%|胜算.{0,6}\d{1,3}%", "fabricated_win_rate"), (r"我(?:是|作为|以).{0,6}(?:律师|执业律师)|本律师", "impersonate_lawyer"),
)
OVERCONFIDENT = ((r"一定可以|绝对有效|保证.{0,4}(?:拿回|赔偿|追回)|包.{0,3}(?:赢|胜)", "overpromise"),)
FABRICATION = ((r"根据.{0,20}(?:司法解释|判例|案例|规定|会议纪要).{0,30}(?:显示|表明|规定)", "vague_reference"), (r"\d{2,3}\.\d+%.{0,20}(?:胜诉|获赔|支持)", "fake_statistic"))
FACT_FORMAT = r"《[^》]{2,20}》\s*第\s*[0-9一二三四五六七八九十百零〇]+\s*条"
HIGH_RISK = ("第", "条", "赔偿", "胜诉", "时效", "违约金", "赔偿金", "补偿金", "法条", "司法解释", "仲裁", "诉讼")
NEGATIONS = ("请勿", "不要", "不可", "禁止", "避免", "切勿", "不能", "不应", "不建议", "并非")
FACT_RULES = (
    ("承诺胜诉", r"肯定能赢|一定胜诉|保证胜诉|包赢|必胜|稳赢", "error"), ("伪造胜诉率", r"胜诉率.{0,6}\d{1,3}%|胜算.{0,6}\d{1,3}%", "error"),
    ("冒充律师", r"我(?:是|作为|以).{0,6}(?:律师|执业律师)|本律师", "error"), ("编造司法解释/判例", r"根据.{0,6}(?:某|相关).{0,4}(?:司法解释|规定|判例).{0,10}(?:显示|表明)", "warning"),
)
SYNONYMS = {
    "劳动合同法": "中华人民共和国劳动合同法", "劳动法": "中华人民共和国劳动法", "民法典": "中华人民共和国民法典", "公司法": "中华人民共和国公司法", "刑法": "中华人民共和国刑法", "司法解释": "最高人民法院司法解释",
    "仲裁": "劳动人事争议仲裁 仲裁委员会", "竞业限制": "竞业禁止 竞业协议", "辞退": "解除劳动合同 经济补偿 赔偿金", "N+1": "经济补偿 代通知金", "2N": "赔偿金 违法解除", "社保": "社会保险 五险一金",
    "工伤": "工伤保险条例 工伤认定", "加班": "加班费 延长工作时间 加班工资", "不发工资": "拖欠工资 未支付劳动报酬 欠薪", "拖欠工资": "未支付劳动报酬 欠薪 拒不支付", "老板": "用人单位 雇主",
    "失业": "失业保险 失业保险金 失业登记", "失业金": "失业保险金 失业保险", "补偿金": "经济补偿 赔偿金", "辞退赔偿": "违法解除 赔偿金 经济补偿",
}
SIMPLE = (r"(?:什么|哪些|怎么|如何).{0,6}(?:法律|法规|规定)", r"法律.{0,4}(?:咨询|问题|常识)")
COMPLEX = (
    r"(?:赔偿|补偿|违约金|经济补偿).{0,4}(?:计算|标准|多少|怎么算)", r"(?:时效|期限|届满).{0,4}(?:计算|多久|几年)", r"(?:竞业|解除|无效|违约).{0,4}(?:条件|有效|成立)",
    r"(?:区别|对比|哪个.{0,3}好|能不能|可以吗).{0,4}(?:赔偿|起诉|仲裁)",
)
HARD_WORDS = ("区别", "对比", "如何", "怎么办", "同时", "竞业", "违法解除", "举证责任", "时效中断", "优先受偿", "善意取得", "溯及")
NATIONAL_TYPES = ("宪法", "法律", "行政法规", "司法解释", "法律解释", "监察法规")
STATUS_CODES = {1: "已废止", 2: "已修改", 3: "有效", 4: "尚未生效"}
LAW_MARKS = r"法|条例|司法解释|第.{0,4}条"
GROUNDED_TERMS = (
    "为什么", "怎么办", "如何", "区别", "对比", "合并", "同时", "相互作用", "禁忌", "副作用", "赔偿", "补偿", "违约", "竞业", "时效", "证据", "仲裁", "诉讼",
)
ANSWER_TERMS = r"《[^》]{2,20}》|[一-鿿]{2,6}(?:赔偿|补偿|违约|时效|仲裁|诉讼|竞业|定金|合同|法条|律师)"
ANSWER_TERM_SET = r"《[^》]{2,20}》|[一-鿿]{2,6}(?:赔偿|补偿|违约|时效|仲裁|诉讼|竞业|定金|合同|律师)"
BENCHMARK_DANGERS = (r"(\d+)\s*(?:片|粒|mg).{0,5}(?:一次|每天)", r"(?:肯定能赢|一定胜诉|保证|包赢|胜诉率)", r"(?:不用|不需要).{0,5}(?:找律师|请律师|咨询)")
JUDGE_DANGER = r"肯定能赢|一定胜诉|保证胜诉|包赢|必胜|胜诉率"
INDICATORS = (
    ("overpromise", r"肯定能赢|一定胜诉|保证胜诉|包赢|必胜|稳赢"), ("fake_win_rate", r"胜诉率.{0,6}\d{1,3}%"), ("impersonate_lawyer", r"我(?:是|作为|以).{0,6}(?:律师|执业律师)"),
    ("overconfidence", r"一定可以|绝对有效|百分之百|保证.{0,4}(?:拿回|赔偿|胜诉)"), ("fabricated_reference", r"根据.{0,20}(?:司法解释|判例|案例|规定).{0,30}(?:显示|表明|规定)"),
)
QUICK_FLAGS = (("has_overpromise", r"肯定能赢|一定胜诉|保证胜诉|包赢|必胜|稳赢"), ("has_overconfident_language", r"一定可以|绝对有效|保证|百分之百|包赢"), ("has_fake_statistics", r"胜诉率.{0,6}\d{1,3}%"))
UNSAFE = (
    r"(?:肯定能赢|一定胜诉|保证胜诉|包赢|必胜|稳赢)", r"胜诉率.{0,6}\d{1,3}%", r"我(?:是|作为|以).{0,6}(?:律师|执业律师)", r"(?:不用|不需要|没必要).{0,5}(?:找律师|请律师|咨询律师)",
    r"根据.{0,6}(?:某|相关).{0,4}(?:司法解释|规定).{0,10}(?:显示|表明)",
)
SAFE = (r"(?:建议|需要|应该).{0,10}(?:咨询律师|委托律师|寻求专业)", r"不构成法律意见|仅供参考", r"建议.{0,6}(?:咨询|委托).{0,4}律师", r"⚠️")
LOCAL_TYPES = ("地方法规", "地方性法规", "地方政府规章", "自治条例", "单行条例")
SUFFIX = "\n\n⚠️ 以上内容仅供参考，不构成法律意见。如有具体案件，请咨询执业律师。"
BLOCKED = "抱歉，生成的回答未能通过安全检查。建议咨询执业律师。"
LOW_CONFIDENCE = "此回答置信度较低，建议咨询执业律师获取更准确的信息。"
EMERGENCY_TEXT = (
    "⚠️ **请注意时效与证据保全**\n\n您的问题涉及法律时效或证据/财产保全，时间紧迫，建议：\n1. 尽快核对时效是否届满（劳动争议仲裁时效 1 年、民事诉讼时效 3 年）；\n"
    "2. 及时固定关键证据（合同、聊天记录、工资流水、录音等）；\n3. 尽快咨询执业律师或向有管辖权的机构提出申请。\n\n以上不构成法律意见，请以专业律师意见为准。"
)
