"""Problem 4: defective question-answer pairs, each with the kind of its defect.

Truncation rests on three findings over all answers. Sorted by text, an answer that is a mere beginning
of its right-hand neighbour and stops within a sentence is a shortened version of it. Lengths at which
unfinished answers pile up are length limits. And the ends of all sentences show which words can end
one: an answer without a final mark whose last words never end a sentence stops in the middle. Announced
counts and lists, open brackets and quotes are checked in the answer itself. The other kinds are rules
on the pair: what is left of the answer without the question's own words, without phrases of refusal
and courtesy, and the languages of both.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut, table
from .one_form import same_codes

# What stands for an answer that is missing, without case, marks and blanks.
PLACEHOLDERS = ("na", "null", "none", "nil", "nan", "undefined", "todo", "tbd", "无", "空", "暂无", "暂无回答", "暂无答案", "暂无内容", "没有", "略", "待补充", "待回答", "待填", "未填写", "答", "回答", "回复", "answer", "a", "test", "测试", "xxx", "内容为空", "无内容", "noanswer", "empty")
# Openings, closings and frames that carry no content of a reply.
COURTESY = (
    "您好", "你好", "亲爱的用户", "亲爱的", "尊敬的用户", "尊敬的客户", "亲", "嗯", "哦", "啊", "自动回复", "系统提示", "抱歉啦", "抱歉", "很抱歉", "非常抱歉", "十分抱歉", "对不起", "不好意思", "很遗憾", "非常遗憾", "遗憾地告诉您", "遗憾", "请谅解", "敬请谅解", "谢谢理解", "感谢理解", "谢谢您的理解",
    "感谢您的提问", "谢谢您的提问", "感谢提问", "感谢您的咨询", "谢谢", "再见", "祝您顺利解决", "祝您顺利", "祝您生活愉快", "希望对您有所帮助", "希望对您有帮助", "以上仅供参考", "仅供参考", "请换个话题", "建议另找渠道", "请另找途径", "换一个吧", "您问别人吧", "我理解您的着急", "出于安全考虑", "但", "sorry", "hello", "hi", "thankyou", "thanks",
)
# A reply's frame around a repeated question.
FRAMES = ("关于您提的", "关于您提到的", "关于您的问题", "针对您提出的", "您提的是", "您问的是", "您的问题是", "您想问的是", "您咨询的是", "就您所说的", "就您提出的", "这个问题", "的问题", "该问题", "答复如下", "回复如下", "解答如下", "收到您的问题", "收到", "好的", "原问题", "提问", "问题", "问", "答", "yourquestion", "youasked", "youask", "youareasking", "regarding", "question", "answer")

# Patterns below are for texts in one form, where full-width marks have become their ordinary kin.
_WHO = r"(?:作为一个?(?:人工智能|语言模型|AI|智能助手)[^。,!?~]{0,6}|我只是智能助手|(?:本|小|这个)?(?:助手|机器人|系统|平台|客服)|我们?|咱|这边|此处|这里|本平台|小助手)"
_NOT = r"(?:实在)?(?:无法|不能|不便|不打算|不愿|不会|拒绝|没有权限|没有资格|没有能力|无权|没法|没办法|暂不支持|不支持|暂时不能|暂时无法|不被允许|不可以|不得|恕不|恕难|不宜|谢绝)"
_SAY = r"(?:就此|就具体案件|就[^。,!?~]{0,6})?(?:对此)?(?:作出|做出|提供|给出|给您?|发表|进行)?(?:任何)?(?:回答|讨论|评价|评论|分析|回应|处理|解答|参与|深入|答复|建议|意见|看法|谈论|帮助|从命|回复|判断|涉及)"
# A clause that only declines to answer.
REFUSAL = "|".join(
    (
        rf"(?:{_WHO})?(?:对此)?{_NOT}{_SAY}[^。,!?~;\n]{{0,14}}", r"(?:这个|此题|这|该题)我?答不了", r"(?:该|这个|此)问题不在我的服务范围之内", r"(?:这个|此|该)?话题我?帮不上忙", r"我这边不做解答", r"(?:请)?直接找专业人士", r"内容受限", r"暂不提供(?:解答|回答|服务)",
        r"您的(?:提问|问题|咨询)涉及敏感信息", r"本次不予(?:答复|回答|回复)", r"此类请求我必须谢绝", r"恕难从命", r"我(?:非常|很|十分)?理解您的[^,。!?]{0,8}", r"相关内容我无权评论", r"没法给您意见", r"不在(?:我的)?服务范围[^。,!?~]{0,4}", r"没有资格谈论此类事项", rf"{_WHO}",
        r"i(?:'m| am) (?:sorry|unable|not able)[^.!?\n]{0,120}", r"i (?:can(?:no|')t|can not|won't|will not|am not able to|must decline)[^.!?\n]{0,120}", r"as an? (?:ai|language model)[^.!?\n]{0,120}",
    )
)
# The parts of REFUSAL that must be there at least once.
DECLINES = r"无法|不能|不便|不打算|拒绝|没有权限|没有资格|无权|没法|没办法|不支持|不被允许|谢绝|恕难|答不了|帮不上|不做解答|不予|受限|暂不|服务范围|敏感信息|i'm sorry|i am sorry|cannot|can't|unable|won't|decline|not able"
# Frequent function words by language.
FUNCTION_WORDS = {
    "en": "the of and to is that for by with must may or be when unless before under in an are not this which who has",
    "fr": "le la les des et est que pour une dans sous ne il au en du doit peut sauf quand lorsque si ou un sur avec selon",
    "de": "der die das und ist nicht den mit wenn von zu innerhalb muss ein eine bitte sollte nach dem des für oder im wird hilft",
    "es": "el los las que para por con una del se no en al debe puede cuando si y o como un es su",
    "it": "il lo gli che per con una del non di al deve può quando se e o come un è le la",
    "pt": "o os as que para por com uma do não em ao deve pode quando se e ou como um é da",
}
MARKUP = r"</?[A-Za-zА-я][^<>\n]{0,80}>|&nbsp;"
ANNOUNCED = r"(?:有|共|共计|分为|分|以下|如下|列)([一二两三四五六七八九十]|\d{1,2})(?:大|个|条)?(?:点|项|步|条|方面|种情形|步骤|要点|部分|理由)[^。!?;\n]{0,6}:"
#: A plain final mark, and no open quote or bracket can be open before it in a text that the next pattern takes.
SAFE_END = r"\A[^《“(【]*(?:(?:《[^《》]*》|“[^“”]*”|\([^()]*\)|【[^【】]*】)[^《“(【]*)*(?<=[。!?.~)])\z"
TERMINAL = r"[。!?.~)”\"」』】\]]\z"
OPEN_END = r"[、,:;×+\-—…(《“「=÷·]\z"
NUMBERS = {n: i + 1 for i, n in enumerate("一二三四五六七八九十")} | {"两": 2}
#: An unfinished length is a limit if so many answers stop at it, and so many times more than around it.
SPIKE_ROWS, SPIKE_TIMES = 20, 6.0
#: Last words behind so many different texts are a closing, if a letter more or less stands behind so many times fewer.
CLOSING_TEXTS, CLOSING_TIMES = 5, 6.0


def _letters(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "")


def language_of(name: str) -> Column:
    """The main language of a column by script, and by function words where the script is Latin; null if there is too little to tell.

    Titles and names in quotes or brackets do not count. Texts of nothing but Chinese, or nearly so, which
    their bytes per character show, take a short way.
    """
    text = F.col(name)
    bare = F.regexp_replace(F.lower(text), r"《[^》]*》|“[^”]*”|「[^」]*」|\"[^\"]*\"|（[^）]*）|\([^)]*\)", " ")

    def once(value: Column, use) -> Column:
        """``use`` of a value that is made a single time, however often it is used."""
        return F.element_at(F.transform(F.array(value), use), 1)

    def western(t: Column) -> Column:
        words = F.array(*[F.struct(F.regexp_count(t, F.lit(rf"(?<!\p{{L}})(?:{'|'.join(w.split())})(?!\p{{L}})")).alias("n"), F.lit(k).alias("k")) for k, w in FUNCTION_WORDS.items()])
        return once(F.array_max(words), lambda w: F.when(w["n"] >= 2, w["k"]).otherwise("latin"))

    def counted(t: Column) -> Column:
        patterns = {"han": r"\p{IsHan}", "kana": r"[ぁ-ヿ]", "hangul": r"[가-힣]", "cyrillic": r"\p{IsCyrillic}+", "other": r"[\p{IsArabic}\p{IsHebrew}\p{IsThai}\p{IsDevanagari}]+", "latin": r"\p{IsLatin}{2,}", "greek": r"\p{IsGreek}+"}
        counts = F.struct(*[F.regexp_count(t, F.lit(p)).alias(n) for n, p in patterns.items()])

        def decide(c: Column) -> Column:
            east = (c["han"] + c["kana"]) / 2
            top = F.greatest(east, c["hangul"] / 2, c["cyrillic"], c["other"], c["latin"], c["greek"])
            return (
                F.when(top < 2, None).when(east == top, F.when(c["kana"] * 4 > c["han"], "ja").otherwise("zh")).when(c["hangul"] / 2 == top, "ko")
                .when(c["cyrillic"] == top, "cyrillic").when(c["other"] == top, "other").when(c["greek"] == top, "greek").when(c["latin"] >= 4, western(t))
            )

        return once(counts, decide)

    mostly = (F.octet_length(text) > 1.9 * F.length(text)) & (F.length(text) >= 12) & ~text.rlike(r"[ぁ-ヿ가-힣Ͱ-῿]")
    return F.when(mostly, "zh").otherwise(once(bare, counted))


def _grams(text: Column, n: int = 4) -> Column:
    last = F.greatest(F.length(text) - n + 1, F.lit(1))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(text, i, F.lit(n))))


def _shortened(texts: DataFrame) -> DataFrame:
    """(_a of answers that begin their right-hand neighbour and stop within a sentence), from distinct texts.

    The texts are sorted over all partitions; a text's longer version, if there is one, is the next in order.
    """
    schema = pa.schema([("_a", pa.string()), ("_first", pa.string()), ("_part", pa.int32())])
    ordered = texts.repartitionByRange("_a").sortWithinPartitions("_a")

    def stops(short: str, long: str) -> bool:
        if len(short) < 8 or len(long) <= len(short) or not long.startswith(short):
            return False
        rest = long[len(short) :].lstrip()
        return bool(rest) and short.rstrip()[-1:] not in "。!?;.\n)”" and rest[0] not in "。!?.;\n~(”)"

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, first, at = None, None, TaskContext.get().partitionId()
        for batch in batches:
            out = []
            for text in batch.column(0).to_pylist():
                if before is not None and stops(before, text):
                    out.append(before)
                first = text if first is None else first
                before = text
            yield pa.RecordBatch.from_pydict({"_a": out, "_first": [None] * len(out), "_part": [-1] * len(out)}, schema)
        if before is not None:  # the edges of a partition, to be compared with those beside it
            yield pa.RecordBatch.from_pydict({"_a": [before], "_first": [first], "_part": [at]}, schema)

    found = cut(ordered.mapInArrow(walk, "_a string, _first string, _part int"))
    edges = found.where("_part >= 0").orderBy("_part").collect()  # two texts per partition
    across = [(x["_a"],) for x, y in zip(edges, edges[1:]) if stops(x["_a"], y["_first"])]
    return found.where("_part < 0").select("_a").union(texts.sparkSession.createDataFrame(across, "_a string")).distinct()


def broken_pairs(rows: DataFrame, key: str = "case_id", question: str = "question", answer: str = "answer") -> DataFrame:
    """(``key``, defect) of the rows with a defective answer.

    defect is the first of 'empty', 'copied', 'refusal', 'language', 'truncated' that holds. A null answer is
    empty; a null or empty question cannot be copied nor set a language. Texts are judged whole, however
    long. Repeated rows come out each; an empty table gives none. Further columns, whatever their names,
    are ignored.
    """
    q, a = F.coalesce(same_codes(F.col(question)), F.lit("")), F.coalesce(same_codes(F.col(answer)), F.lit(""))
    base = rows.select(F.col(key).alias("_key"), q.alias("_q"), F.regexp_replace(a, r"\A\s+|\s+\z", "").alias("_r"))
    # Markup and a pair of brackets around the whole fall away; few answers have any.
    clean = F.when(F.col("_r").rlike(r"\A[\[【“\"<]|>\z|&nbsp;"), F.regexp_replace(F.regexp_replace(F.regexp_replace("_r", MARKUP, ""), r"\A\s+|\s+\z", ""), r"\A[\[【“\"](?!自动)([\s\S]*)[\]】”\"]\z", "$1")).otherwise(F.col("_r"))
    # What can be a copy: one of six short stretches of the question stands in the answer.
    lead = F.greatest(F.lit(6), F.least(F.lit(10), F.expr("length(_q) div 5"))).cast("int")
    anchors = [F.substring(F.col("_q"), (F.length("_q") * k / 6).cast("int") + 1, lead) for k in range(6)]
    seen = reduce(Column.__or__, [(F.length(x) >= 6) & F.contains("_r", x) for x in anchors]) | ((F.length("_q") > 0) & (F.length("_q") < 12) & F.contains("_r", F.col("_q")))
    ql, al = language_of("_q"), language_of("_r")
    foreign = F.coalesce((ql != al) & (al != "latin") & (ql != "latin") | (ql == "zh") & (al == "latin") | (ql == "latin") & al.isin("zh", "ja", "ko", "cyrillic", "other"), F.lit(False))
    # Written once: what follows reads it several times, and no filter must pull the above into itself.
    base = cut(base.select("_key", clean.alias("_a"), F.when(seen, F.col("_q")).alias("_q"), foreign.alias("_foreign")))

    # Copies: little is left of the answer without the question's words and a frame.
    letters = base.select("_key", "_a", "_foreign", F.when(F.col("_q").isNotNull(), _letters(F.col("_a"))).alias("_al"), F.when(F.col("_q").isNotNull(), _letters(F.col("_q"))).alias("_ql"))
    around = "|".join(sorted(COURTESY + FRAMES, key=len, reverse=True))
    unframed = letters.withColumn("_u", F.regexp_replace(F.regexp_replace("_al", f"^(?:{around})+", ""), f"(?:{around})+$", ""))
    mine, theirs = _grams(F.col("_u")), _grams(F.col("_ql"))
    copied = F.when(F.col("_ql").isNull(), False).when((F.col("_u") == "") | (F.col("_al") == F.col("_ql")), True).otherwise(F.size(F.array_except(mine, theirs)) <= 0.25 * F.size(mine))

    # Refusals: nothing is left without phrases that decline and courtesies, and something declines.
    low = F.lower(F.col("_a"))
    rest = _letters(F.regexp_replace(F.regexp_replace(low, REFUSAL, " "), "|".join(sorted(COURTESY, key=len, reverse=True)), " "))
    opening = rf"\A[\s\p{{P}}]*(?:{'|'.join(sorted(COURTESY, key=len, reverse=True))}|{REFUSAL})"  # fails at once for a real reply
    refusal = F.when(~low.rlike(opening), False).when(~low.rlike(DECLINES), False).otherwise(low.rlike(REFUSAL) & (F.length(rest) <= 3))
    few = rf"\A[^\p{{L}}\p{{N}}]*+(?:[\p{{L}}\p{{N}}][^\p{{L}}\p{{N}}]*+){{0,{max(map(len, PLACEHOLDERS))}}}\z"  # fails at the next letter
    empty = F.when(~F.col("_a").rlike(few), False).otherwise(_letters(F.col("_a")).isin("", *PLACEHOLDERS))
    kind = F.when(empty, "empty").when(copied, "copied").when(refusal, "refusal").when(F.col("_foreign"), "language").otherwise("")
    kinds = cut(unframed.select("_key", kind.alias("_kind"), F.when(~F.col("_a").rlike(SAFE_END) | F.col("_a").rlike(ANNOUNCED), F.col("_a")).alias("_a")))

    # Truncation, for what is not defective otherwise.
    # Only answers without a plain final mark, or with an announced count, need a closer look; of the others no text is kept.
    left = kinds.where("_kind = '' AND _a IS NOT NULL")
    left = left.withColumn("_tail", F.element_at(F.split("_a", r"[。!?;\n]"), -1))
    tail = F.col("_tail")
    last = F.when(F.col("_a").rlike(r"\p{IsLatin}\z"), F.regexp_extract("_a", r"(\p{L}+[\s']\p{L}+)\z", 1)).otherwise(F.regexp_extract("_a", r"(.{4})\z", 1))
    opened = [F.regexp_count(tail, F.lit(a)) > F.regexp_count(tail, F.lit(b)) for a, b in (("《", "》"), ("“", "”"), (r"\(", r"\)"), ("【", "】"))]
    promised = F.regexp_extract("_a", ANNOUNCED, 1)
    number = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in NUMBERS.items() for x in p]), promised), F.expr("try_cast(_promised as int)"))
    found = left.withColumn("_promised", promised).withColumn("_n", number)
    names = F.array(*[F.lit(x) for x in "一二三四五六七八九十"])
    there = F.contains("_a", F.concat(F.lit("第"), F.try_element_at(names, F.col("_n")))) | F.rlike("_a", F.concat(F.lit(r"(?:^|[\s:。;(])"), F.col("_n").cast("string"), F.lit(r"[、.)]")))
    # Read by each of the findings below.
    marked = cut(found.select(
        "_key", "_a", tail.alias("_tail"), last.alias("_last"), F.length("_a").alias("_len"),
        (F.col("_a").rlike(OPEN_END) | F.coalesce(~there & (F.col("_n") > 1), F.lit(False)) | reduce(Column.__or__, opened)).alias("_sure"),
        F.col("_a").rlike(TERMINAL).alias("_ended"),
    ))
    bare = marked.where("NOT _sure AND NOT _ended")
    parts = base.select(F.split("_a", r"[。!?;.]\s*").alias("_s")).select(F.explode(F.slice("_s", 1, F.greatest(F.size("_s") - 1, F.lit(0)))).alias("_s"))
    ending = F.when(F.col("_s").rlike(r"[A-Za-z]\z"), F.regexp_extract(F.expr("right(_s, 40)"), r"(\p{L}+[\s']\p{L}+)\z", 1)).otherwise(F.expr("right(_s, 4)"))
    ends = parts.groupBy(ending.alias("_last")).agg(F.count(F.lit(1)).alias("_times")).where("_times > 1")
    # A closing stands behind a finished sentence in different texts; copies of one text count once. An answer cut at
    # some length leaves tails of all lengths, so that a letter more or less is as frequent.
    before = F.expr("left(_a, length(_a) - length(_tail))")
    closings = bare.where(before != "").select("_tail", F.xxhash64(before).alias("_b")).distinct().groupBy("_tail").agg(F.count(F.lit(1)).alias("_same"))
    closings = cut(closings.where(F.col("_tail") != ""))
    shorter = closings.select("_tail", "_same", F.expr("left(_tail, length(_tail) - 1)").alias("_less"))
    beside = shorter.select(F.col("_less").alias("_tail"), F.col("_same").alias("_other")).unionByName(shorter.select("_tail", "_less").join(closings.select(F.col("_tail").alias("_less"), F.col("_same").alias("_other")), "_less").select("_tail", "_other"))
    most = beside.groupBy("_tail").agg(F.max("_other").alias("_other"))
    usual = closings.where(F.col("_same") >= CLOSING_TEXTS).join(most, "_tail", "left").where(F.col("_same") > CLOSING_TIMES * F.coalesce("_other", F.lit(0))).select("_tail", F.lit(True).alias("_usual"))
    open_ends = bare.join(usual, "_tail", "left").where("_usual IS NULL").join(ends, "_last", "left")
    stopped = open_ends.where("_times IS NULL").select("_key")

    # Length limits among answers without a final mark or closing.
    lengths = open_ends.groupBy("_len").agg(F.count(F.lit(1)).alias("_c"))
    around = Window.orderBy("_len").rangeBetween(-10, 10)  # one row per length
    spikes = lengths.withColumn("_s", (F.sum("_c").over(around) - F.col("_c")) / 20).where((F.col("_c") >= SPIKE_ROWS) & (F.col("_c") > SPIKE_TIMES * F.col("_s"))).select("_len")
    limited = open_ends.join(spikes, "_len").select("_key")

    shortened = open_ends.select("_key", "_a").join(_shortened(base.select("_a").distinct()), "_a").select("_key")
    truncated = marked.where("_sure").select("_key").union(stopped).union(limited).union(shortened).distinct()
    out = kinds.where("_kind <> ''").select("_key", "_kind").union(truncated.select("_key", F.lit("truncated")))
    return out.select(F.col("_key").alias(key), F.col("_kind").alias("defect"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return broken_pairs(table(spark, folder, "contract"))


QUERIES = {"p4_found": p4_found}
SQL: dict[str, str] = {}
