import cProfile
import random
import time
import unicodedata
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessellex.llm import abuse_score, bad_pairs, byte_bpe, mix_sources, one_form, quota_sample, split_overlap, split_pieces


# --- problem 1


def _forms(spark, texts, extra=False):
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id long, t string, form string")
    return one_form.one_form({"a": (rows, "id", "t")})


def test_one_form(spark):
    texts = ["Bank of 中⽂，ＡＢ１", "Bаnk of 中文,AB1", "a\u200bb\u3000c", "ab c", "ab  c", "caf\u00e9", "cafe\u0301", "m²", "m2", "①", "1", "行\r\n次", "行\n次", "Ab", "ab", None, "", "дом", "ΒΑΝΚ", "BANK", "Ⅳ", "IV", "дoм", "Quаrx"]
    rows = {r["id"]: r for r in _forms(spark, texts).collect()}
    form, look = ({i: r[c] for i, r in rows.items()} for c in ("form", "look"))
    same = [(0, 1), (2, 3), (5, 6), (11, 12), (17, 22)]
    assert all(form[a] == form[b] and look[a] == look[b] for a, b in same)
    apart = [(3, 4), (7, 8), (9, 10), (13, 14), (20, 21)]
    assert all(form[a] != form[b] and look[a] != look[b] for a, b in apart)
    assert form[15] is None and form[16] == "" and form[17] == "дом"
    assert form[18] == "ΒΑΝΚ" and look[18] == look[19] == "BANK"  # a word of one script keeps its letters
    assert form[23] == "Quаrx" and look[23] == "Quarx"  # no clean word to repair it into


def test_vocabulary_decides(spark):
    with_word, without = _forms(spark, ["Lоrvit", "Lorvit"]).collect(), _forms(spark, ["Lоrvit", "x"]).collect()
    assert {r["form"] for r in with_word} == {"Lorvit"}
    assert {r["form"] for r in without} == {"Lоrvit", "x"}
    assert {r["form"] for r in _forms(spark, ["сор", "оса", "ΝΟΤΕ", "cop", "NOTE"]).collect()} == {"сор", "оса", "ΝΟΤΕ", "cop", "NOTE"}


def test_look_alikes(spark):
    texts = ["甲а乙", "甲a乙", "甲a乙", "丙", None, "", "\u200b", "cop", "сор"]
    pairs = {(r["id_a"], r["id_b"]) for r in one_form.look_alikes(_forms(spark, texts)).collect()}
    assert pairs == {(0, 1), (0, 2), (7, 8)}  # null and empty texts form none; equal strings neither
    assert one_form.look_alikes(_forms(spark, texts).limit(0)).collect() == []
    many = _forms(spark, ["сор"] * 30 + ["cop"] * 30)
    classes, members = one_form.look_classes(many)
    assert classes.count() == 1 and members.count() == 60 and one_form.look_alikes(many).count() == 900


def test_repair():
    assert one_form.repair("Bаnk")[0][0] == "Bank" and one_form.repair("дoм")[0] == ["дом"]
    assert one_form.repair("сор")[0] == [] and one_form.repair("cafe\u0301") == ([], "caf\u00e9", "caf\u00e9")
    assert one_form.repair("cafе\u0301")[2] == "caf\u00e9"  # a Cyrillic letter below the accent


# --- problem 2


def test_controlled_rounding():
    r = random.Random(1)
    for _ in range(50):
        cells = {(i, j): r.choice([0, r.random() * 9, float(r.randrange(5))]) for i in range(r.randrange(1, 6)) for j in range(4)}
        out = quota_sample.controlled_rounding(cells)
        near = lambda x, y: abs(x - y) < 1 + 1e-6
        assert all(near(out[k], x) for k, x in cells.items())
        for axis in (0, 1):
            for g in {k[axis] for k in cells}:
                assert near(sum(v for k, v in out.items() if k[axis] == g), sum(v for k, v in cells.items() if k[axis] == g))
        assert near(sum(out.values()), sum(cells.values()))


def _contract(spark, rows):
    return spark.createDataFrame(rows, "case_id long, department string, difficulty double, band string")


def test_quota_sample(spark):
    rows = [(i, " A " if i % 3 else "b", (i % 10) / 10, "clash") for i in range(300)] + [(900, None, 0.5, ""), (901, "a", None, ""), (902, "a", float("nan"), ""), (903, "a", 1.5, "")] + [(1, " A ", 0.1, "clash")] * 2
    targets = spark.createDataFrame([("a", "easy", 300, 2), ("a", "hard", 500, 2), ("b", "medium", 150, 60), ("c", "easy", 50, 1)], "department string, band string, target_pm int, min_rows int")
    sample, report = quota_sample.quota_sample(_contract(spark, rows), targets)
    plan = {(r["department"], r["band"]): r for r in report.collect()}
    drawn = {(r[0], r[1]): r[2] for r in sample.groupBy("department", "band").count().collect()}
    assert drawn == {k: r["quota"] for k, r in plan.items() if r["quota"]} and sum(drawn.values()) == 153
    assert {k for k, r in plan.items() if not r["met"]} == {("c", "easy"), ("b", "medium")}
    empty, report = quota_sample.quota_sample(_contract(spark, rows[:0]), targets)
    assert empty.collect() == [] and report.where("NOT met").count() == 4  # min_rows still stands
    again = quota_sample.quota_sample(_contract(spark, rows).repartition(5), targets)[0]
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, sample.collect()))


# --- problem 3

LIMITS = [("x", 40, 8), (None, 60, 10)]


def _split(spark, rows):
    laws = spark.createDataFrame(rows, "law_id long, title string, content string, type string, piece string")
    return split_pieces.split_oversized(laws, spark.createDataFrame(LIMITS, "law_type string, max_chars int, overlap_chars int"))


def test_split_round_trip(spark):
    r = random.Random(5)
    rows = [(i, r.choice([None, "", "题名", "很" * 50]), "".join(r.choice("甲乙丙丁。；\n𠀀a ") for _ in range(r.randrange(400))), r.choice(["x", "y", None]), "") for i in range(120)]
    rows += [(500, "t" * 70, None, "y", ""), (501, "t" * 70, "", "x", ""), (502, None, None, None, ""), (503, "t", "长" * 5000, "x", "")]
    pieces = {}
    for p in _split(spark, rows).collect():
        pieces.setdefault(p["law_id"], []).append(p)
    for key, title, content, kind, _ in rows:
        limit, overlap = (40, 8) if kind == "x" else (60, 10)
        whole = content or ""
        if len(title or "") + len(whole) <= limit:
            assert key not in pieces
            continue
        both = sorted(pieces[key], key=lambda p: p["piece"])
        assert [p["piece"] for p in both] == list(range(both[0]["pieces"]))
        assert all(len(p["piece_text"]) <= limit for p in both)
        rest = [p for p in both if p["part"] == "title"]
        own = both[len(rest) :]
        assert all(p["part"] == "content" for p in own)
        led = min(len(title or ""), limit - 1 - overlap - max(2, limit // 4)) if len(title or "") + 1 + overlap + max(2, limit // 4) > limit else len(title or "")
        head = (title or "")[:led] + ("\n" if led else "")
        assert head.rstrip("\n") + "".join(p["piece_text"][len(head) :] for p in rest) == (title or "")  # the whole title comes out
        back = ""
        for k, p in enumerate(own):
            end = own[k + 1]["start"] if k + 1 < len(own) else len(whole)
            assert p["piece_text"] == head + whole[p["start"] - p["overlap"] : end]
            assert p["overlap"] == min(overlap, p["start"])
            back += whole[p["start"] : end]
            if title:
                assert p["piece_text"].startswith(title[: limit // 2 - 1])
            if p["cut"] == "character":  # there was no natural end to cut at
                assert not any(c in "\n。；" for c in whole[p["start"] : end])
        assert back == whole


def test_split_long_text(spark):
    for size in (20_000, 1_000_000):
        whole = "".join("一行文字，没有别的。"[: 3 + i % 7] + "\n" * (i % 3 == 0) for i in range(size // 7))
        got = sorted(_split(spark, [(1, "题" * 3000, whole, "y", "")]).select("piece", "part", "start", F.length("piece_text").alias("n"), "overlap", "piece_text").collect())
        own = [p for p in got if p["part"] == "content"]
        assert max(p["n"] for p in got) <= 60 and all(p["overlap"] == min(10, p["start"]) for p in own)
        assert "".join(p["piece_text"][p["n"] - (q["start"] if q else len(whole)) + p["start"] :] for p, q in zip(own, [*own[1:], None])) == whole
        assert sum(p["n"] for p in got if p["part"] == "title") >= 3000


def test_split_empty(spark):
    assert _split(spark, [(1, "t", "c", "x", "")]).collect() == []


# --- problem 4


def test_broken_pairs(spark):
    q = "2020年我和某公司签了合同，对方不付款，违约金怎么算？"
    good = [f"根据规定，对方应当支付第{i}笔违约金。协商不成的，可以向法院提起诉讼。" for i in range(12)] + ["对方应当支付违约金。可以起诉。", "依法应当支付违约金。"]
    rows = [(i, q, a) for i, a in enumerate(good)]
    more = [(100, q, None, "empty"), (101, q, " N/A ", "empty"), (102, q, "<p></p>", "empty"), (103, q, q, "copied"), (104, q, "您好，您的问题是：" + q, "copied"), (105, q, "抱歉，我无法回答这个问题。", "refusal"),
            (106, q, "The tenant must pay the rent within ten days unless the contract says that it is not due.", "language"), (107, q, "根据规定，对方应当支付", "truncated"), (108, q, "主要有三点：第一，催告。第二，起诉。", "truncated"), (109, q, "具体步骤如下：", "truncated")]
    fine = [(200, q, "可以。"), (201, q, "针对您提出的“" + q + "”，答复如下：对方应当支付全部违约金并赔偿由此产生的损失，可以向法院提起诉讼。"), (202, q, "很遗憾发生这样的事。对方应当支付违约金，可以向法院提起诉讼。"), (203, None, "对方应当支付违约金。"), (204, "", ""), (205, q, "根据规定，对方应当支付违约金")]
    table = rows + [m[:3] for m in more] + fine
    found = {r["case_id"]: r["defect"] for r in bad_pairs.broken_pairs(spark.createDataFrame(table, "case_id long, question string, answer string").withColumn("defect", F.lit(1))).collect()}
    assert found == {m[0]: m[3] for m in more} | {204: "empty"}
    assert bad_pairs.broken_pairs(spark.createDataFrame([], "case_id long, question string, answer string")).collect() == []


def test_copies_make_no_closing(spark):
    q = "2020年我和某公司签了合同，对方不付款，违约金怎么算？"
    fine = [f"根据规定，对方应当支付第{i}笔违约金。协商不成的，可以向法院提起诉讼。以上仅供参考" for i in range(12)]
    cut = ["对方应当支付违约金。如果协商不成，可以"] * 30
    blank = ["。" * 40, "N / A" + " ." * 20]
    rows = list(enumerate(fine + cut + blank))
    found = {r["case_id"]: r["defect"] for r in bad_pairs.broken_pairs(spark.createDataFrame([(i, q, a) for i, a in rows], "case_id long, question string, answer string")).collect()}
    assert found == {i: "truncated" if a in cut else "empty" for i, a in rows if a not in fine}


def test_long_refusals(spark):
    long = "抱歉，我无法回答这个问题。" * 60
    rows = [(1, "合同怎么解除？", long), (2, "合同怎么解除？", "抱歉让您久等了。" + "可以书面通知对方解除合同，并保留送达凭证。" * 30)]
    found = bad_pairs.broken_pairs(spark.createDataFrame(rows, "case_id long, question string, answer string")).collect()
    assert [tuple(r) for r in found] == [(1, "refusal")]


# --- problem 5


def test_overlaps(spark):
    q, a = "2019年3月我在某地买了一台二手设备，对方拒绝退押金，定金能不能双倍返还？", "对方应当双倍返还定金。协商不成的可以起诉。请保留付款凭证和聊天记录，以便举证。"
    q2 = "甲公司拖欠工资三个月，劳动仲裁需要准备哪些材料呢，请问流程怎么走？"
    rows = [(1, q, a, "train"), (2, q, a, "eval"), (3, "请问" + q.replace("设备", "设各"), a + "以上仅供参考", "test"), (4, q, "完全不同的回答，说的是另外一件事情，与定金没有任何关系。", "eval"), (5, q2, a, "eval"), (6, q2, None, "train"),
            (7, q2, None, "test"), (8, None, a, "eval"), (9, "", "", "train"), (10, q.replace("，", " , "), "<p>" + a + "</p>", "eval"), (11, q, a, None), (2, q, a, "eval")]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "case_id long, question string, answer string, split string, id_train string")
    pairs = [tuple(r) for r in split_overlap.overlaps(frame).collect()]
    assert sorted(set(pairs)) == [(1, 2), (1, 3), (1, 10), (6, 7)] and pairs.count((1, 2)) == 2  # the repeated row counts again
    assert split_overlap.overlaps(frame.limit(0)).collect() == []


def test_overlaps_hot_question(spark):
    rows = [(i, "同一个问题反复出现，怎么办才好呢？", f"第{i}种回答，彼此不同，内容编号{i * 7919}，细节{i * 104729}，结论{i * 1299709}。", "train") for i in range(300)]
    rows += [(1000 + i, r[1], r[2], "eval") for i, r in enumerate(rows[:40])]
    pairs = {tuple(r) for r in split_overlap.overlaps(spark.createDataFrame(rows, "case_id long, question string, answer string, split string")).collect()}
    assert {(i, 1000 + i) for i in range(40)} <= pairs


def _edited(r, text, edits):
    for _ in range(edits):
        i = r.randrange(max(len(text), 1))
        text = text[:i] + r.choice(["", "换", text[i : i + 1] + "增"]) + text[i + 1 :]
    return text


def test_overlaps_scattered_edits(spark):
    r = random.Random(5)
    signs = [chr(0x4E00 + i) for i in range(300)]
    asked = ["".join(r.choice(signs) for _ in range(60 + i % 40)) for i in range(60)] + ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(60 + i % 40)) for i in range(60)]
    rows = [(i, q, "可以", "train") for i, q in enumerate(asked)] + [(1000 + i, _edited(r, q, 2 + i % 12), "可以", "eval") for i, q in enumerate(asked)]
    pairs = {tuple(x) for x in split_overlap.overlaps(spark.createDataFrame(rows, "case_id long, question string, answer string, split string")).collect()}
    assert pairs == {(i, 1000 + i) for i in range(120)}


def test_sharing_misses_no_pair():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            before, row = row, [i + 1]
            for j, y in enumerate(b):
                row.append(min(before[j] + (x != y), before[j + 1] + 1, row[j] + 1))
        return row[-1]

    r = random.Random(6)
    known = ["".join(r.choice("甲乙丙丁abc") for _ in range(r.randrange(1, 40))) for _ in range(80)] + ["a" * n for n in range(1, 12)]
    held = [_edited(r, t, r.randrange(9)) for t in known]
    for edits in (0.25, 0.15):
        found = set(zip(*map(list, split_overlap.sharing(held, known, 2, edits))))
        near = {(i, j) for i, a in enumerate(held) for j, b in enumerate(known) if a and distance(a, b) <= edits * max(len(a), len(b))}
        assert near <= found and len(near) > 20


def test_overlaps_sentence_left_out(spark):
    q = "同一个问题反复出现，怎么办才好呢？"
    r = random.Random(7)
    signs = [chr(0x4E00 + i) for i in range(400)]
    rows, wanted = [], set()
    for i in range(30):
        whole = ["".join(r.choice(signs) for _ in range(60)) for _ in range(5)]
        less = whole[: i % 5] + whole[i % 5 + 1 :]
        rows += [(3 * i, q, "。".join(whole), "train"), (3 * i + 1, q, "。".join(less), "train"), (3 * i + 2, q, "。".join([*whole, "完"]), "eval")]
        wanted |= {(3 * i, 3 * i + 2), (3 * i + 1, 3 * i + 2)}
    frame = spark.createDataFrame(rows, "case_id long, question string, answer string, split string")
    assert {tuple(x) for x in split_overlap.overlaps(frame).collect()} == wanted
    few = frame.where("case_id < 15")
    assert {tuple(x) for x in split_overlap.overlaps(few).collect()} == {p for p in wanted if p[1] < 15}


def test_overlaps_leave_texts_of_others(spark):
    """Of texts only those of linked questions are shuffled, and the files of the steps before are gone when the pairs are read."""
    r = random.Random(8)
    signs = [chr(0x4E00 + i) for i in range(20000)]
    rows = [(i, "".join(r.choice(signs) for _ in range(30)), "".join(r.choice(signs) for _ in range(3000)), "train" if i % 2 else "eval") for i in range(400)]
    rows += [(1000, *rows[1][1:3], "eval"), (1001, rows[0][1] + "吗", rows[0][2], "train"), (1002, "!?", "x", "eval"), (1003, "", "x", "train"), (None, *rows[1][1:3], "eval")]
    frame = spark.createDataFrame(rows, "case_id long, question string, answer string, split string")
    env = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get()
    folders = [Path(str(d)) for d in env.blockManager().diskBlockManager().localDirs()]

    def written():
        context = spark.sparkContext._jsc.sc()
        context.listenerBus().waitUntilEmpty()
        ran = context.statusStore().executorList(False)
        return sum(ran.apply(i).totalShuffleWrite() for i in range(ran.size()))

    def files():
        return {p for d in folders for p in d.rglob("shuffle_*.data")}

    before, there, setting = written(), files(), spark.conf.get(freed := "spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    spark.conf.set(limit := "spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables of which no side is small
    try:
        pairs = split_overlap.overlaps(frame)
    finally:
        spark.conf.unset(limit)
    for _ in range(100):
        if not (left := files() - there):
            break
        time.sleep(0.1)
    assert not left and spark.conf.get(freed) == setting
    assert sorted(map(tuple, pairs.collect())) == [(1, 1000), (1001, 0)]
    assert written() - before < 1_000_000 < sum(len(x[2].encode()) for x in rows) / 3


def test_likely_keeps_all_wanted(spark, monkeypatch):
    rows = spark.range(20000).withColumn("t", F.concat(F.lit("x"), "id"))
    wanted = rows.where("id % 100 = 7").select("t")
    for words, most in ((1 << 20, 210), (4, 20000)):  # with few places more of the others stay
        monkeypatch.setattr(split_overlap, "_WORDS", words)
        got = split_overlap._likely(rows, "t", wanted)
        assert got.columns == ["id", "t"] and got.join(wanted, "t").count() == 200 and 200 <= got.count() <= most
    assert split_overlap._likely(rows, "t", wanted.limit(0)).count() == 0


# --- problem 6

ODD = [None, "", " ", "  a", "a  b\n\n c", "don't I'll", "中文，ABC 123!!", "ドラゴン龍契士", "<|endoftext|>", "é́ẹ́ ​﻿", "🙏🏽😀", "\x00\x01", "a" * 3000, "裏覚醒 裏覚醒", "x" * 700 + "中", "　　第", "𠀀𠀁", "9" * 1500]


def test_ids_against_public_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    reference = tokenizers.Tokenizer.from_file(byte_bpe.VOCABULARY)
    reference.encode_special_tokens = True
    r = random.Random(2)
    texts = ODD + ["".join(r.choice("中文测试，。 aeé\n1️⃣ドの龍") for _ in range(r.randrange(60))) for _ in range(200)]
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = {x["doc_id"]: x["ids"] for x in byte_bpe.encode_texts(rows).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i] == reference.encode(t or "", add_special_tokens=False).ids, repr(t)
    assert byte_bpe.encode_texts(rows.limit(0)).collect() == []
    lengths = {x["doc_id"]: x["tokens"] for x in byte_bpe.encode_texts(rows, lengths_only=True).collect()}
    assert lengths == {i: len(x) for i, x in got.items()}


def test_heap_merge_equals_recursion():
    tokenizers = pytest.importorskip("tokenizers")
    reference = tokenizers.Tokenizer.from_file(byte_bpe.VOCABULARY)
    v = byte_bpe.Vocabulary(byte_bpe.load_vocabulary())
    for word in ("hello", " internationalization", "ドラゴン", "aaaaaaaaab", "龍契士"):
        assert v.merge(word.encode()) == reference.encode(word, add_special_tokens=False).ids


# --- problem 7


def test_rake():
    cells = {("a", "zh", "x"): 100.0, ("a", "en", "x"): 50.0, ("b", "zh", "y"): 30.0}
    w = mix_sources.rake(cells, [{"a": 60.0, "b": 90.0}, {}, {}], {"a": 1, "b": 2})
    assert abs(w["a", "zh", "x"] * 100 + w["a", "en", "x"] * 50 - 60) < 1e-6 and w["b", "zh", "y"] == 2


def test_rake_meets_all_margins():
    r = random.Random(3)
    cells = {(s, lang, t): float(r.randrange(50, 500)) for s in "abc" for lang in ("zh", "en") for t in ("x", "y", "z")}
    total = sum(cells.values())
    margins = [{"a": 0.3 * total, "b": 0.3 * total, "c": 0.4 * total}, {"zh": 0.7 * total, "en": 0.3 * total}, {"x": 0.2 * total, "y": 0.5 * total, "z": 0.3 * total}]
    w = mix_sources.rake(cells, margins, dict.fromkeys("abc", 20))
    for place, margin in enumerate(margins):
        for name, goal in margin.items():
            assert abs(sum(x * w[c] for c, x in cells.items() if c[place] == name) - goal) < 0.001 * goal
    only_sources = mix_sources.rake(cells, [margins[0], {}, {}], dict.fromkeys("abc", 20))
    assert max(abs(w[c] - only_sources[c]) for c in cells) > 0.1  # languages and topics change the weights


def test_mix(spark):
    docs = [(i, "字" * (5 + i % 7), "zh", "ab"[i % 2], "某法") for i in range(400)] + [(900, None, None, "a", None), (901, "", "zh", None, None), (902, "词语", "zh", "c", "x")]
    frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, lang string, source string, law_title string, repeats int")
    targets = spark.createDataFrame([("a", 200, 1), ("b", 790, 2), ("d", 10, 5)], "source string, target_pm int, max_repeats int")
    mix, report = mix_sources.mix_sources(frame, targets)
    got = {r["source"]: r for r in report.collect()}
    # Shares of the mix, which lacks what d falls short of.
    assert abs(got["a"]["actual_pm"] - 200 / 0.99) < 5 and abs(got["b"]["actual_pm"] - 790 / 0.99) < 5 and abs(sum(r["actual_pm"] for r in got.values()) - 1000) < 0.01
    assert abs(got["b"]["off_pm"] - (got["b"]["actual_pm"] - 790)) < 0.01
    assert got["d"]["short"] and not got["a"]["short"] and not got["b"]["short"] and got["c"]["actual_tokens"] == 0
    assert mix.agg(F.max("repeats")).first()[0] <= 2 and mix.where("source = 'a'").agg(F.max("repeats")).first()[0] == 1
    mix, report = mix_sources.mix_sources(frame.limit(0), targets)
    assert mix.collect() == [] and report.count() == 3


# --- problem 8


def _documents(n, seed):
    r = random.Random(seed)
    bad = ["你这个人渣全家不得好死", "楼主就是个废物给我滚", "那帮移民都是寄生虫", "你是畜生转世吧去死"]
    out = []
    for _ in range(n):
        lines = [f"{r.choice(['承租人', '出卖人', '劳动者'])}应当在{r.randrange(90)}日内{r.choice(['支付租金', '返还押金', '提交材料'])}" for _ in range(6)]
        y = int(r.random() < 0.3)
        if y:
            lines.insert(r.randrange(6), r.choice(bad))
        elif r.random() < 0.3:
            lines.insert(2, "某人在群里骂邻居废物，法院认定侵害名誉权")
        out.append(("。".join(lines), y))
    return out


def test_abuse_scores_on_held_out_documents(spark):
    train, held = _documents(200, 1), _documents(100, 2)
    rows = [(i, t) for i, (t, _) in enumerate(train + held)] + [(900, None), (901, ""), (902, "长" * 50000)]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(train)] + [(0, None), (5, 1), (5, 0), (7777, 1)], "doc_id long, label int")
    model = abuse_score.fit(docs, labels)
    got = {r["doc_id"]: r["score"] for r in abuse_score.score(docs, model).collect()}
    right = sum((got[200 + i] >= abuse_score.CASE) == bool(y) for i, (_, y) in enumerate(held))
    assert right >= 97 and len(got) == len(rows)
    assert got[900] < abuse_score.CASE and got[901] < abuse_score.CASE and got[902] < abuse_score.CASE
    none = abuse_score.fit(docs, labels.limit(0))
    assert {r["score"] for r in abuse_score.score(docs, none).collect()} == {0.0}
    assert abuse_score.score(docs.limit(0), model).collect() == []


def test_bounds_change_nothing():
    model = abuse_score.Model(_documents(150, 3))
    for text, _ in _documents(60, 4):
        for units in abuse_score.passages(text):
            ids, _s = model._near(model._vector(units))
            if len(ids) and (model.bad[ids] > 0).any():
                continue
            assert model.passage(units) == 0.0


def test_near_is_exact_in_few_steps():
    r = random.Random(5)
    known = [("，".join("".join(r.choices("甲乙丙丁戊己庚辛", k=r.randrange(4, 12))) for _ in range(8)), int(i % 2)) for i in range(300)]
    model, profile = abuse_score.Model(known), cProfile.Profile()
    kept = sorted({p for t, _ in known for p in abuse_score.passages(t)}, key=lambda p: (not any(y and p in abuse_score.passages(t) for t, y in known), p))
    rows = np.zeros((len(kept), len(model.terms)), np.float32)
    for k, p in enumerate(kept):
        ids, w = model._vector(p)
        rows[k, ids] = w
    some = kept[::40]
    for p in some:
        ids, w = model._vector(p)
        sims = rows[:, ids] @ w
        got = model._near((ids, w))
        assert set(np.flatnonzero(sims >= abuse_score.NEAR + 1e-5)) <= set(got[0]) <= set(np.flatnonzero(sims >= abuse_score.NEAR - 1e-5))
        assert np.allclose(sims[got[0]], got[1], atol=1e-5)
    profile.runcall(lambda: [model._near(model._vector(p)) for p in some])
    assert sum(x.callcount for x in profile.getstats()) < 150 * len(some)  # not some for each block of passages
    text = "①②年12月，٣日，" + known[1][0] + "。" + known[3][0]
    assert abuse_score.passages(text)[:2] == [("0", "0", "年", "0", "月"), ("0", "日")]
    assert model.raw(text)[0] == max(model.passage(p) for p in abuse_score.passages(text))


def test_isotonic():
    steps = abuse_score.isotonic([(0.1, 0), (0.2, 1), (0.3, 0), (0.9, 1), (0.9, 1)])
    assert [y for _, y in steps] == sorted(y for _, y in steps)


def test_unicode_tables():
    assert all(len(a) == 1 and len(b) == 1 for a, b in one_form.SAME.items())
    assert all(unicodedata.category(c) != "Mn" or c in one_form.INVISIBLE for c in one_form.SAME)
