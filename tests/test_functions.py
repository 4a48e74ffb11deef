from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessellex.functions import citations as C
from tessellex.functions import numerals, text


def test_numerals(spark):
    cases = [("八十七", 87), ("一百二十三", 123), ("十", 10), ("二十", 20), ("一二三", 3), ("1百", None), ("万", None), ("一百零五", 105), ("47", 47), ("", None), (None, None)]
    rows = spark.createDataFrame([(a, i) for i, (a, _) in enumerate(cases)], "s string, i int").select("i", numerals.to_int(F.col("s")).alias("n")).orderBy("i").collect()
    assert [r["n"] for r in rows] == [n for _, n in cases]


def test_numeral_round_trip(spark):
    n = spark.range(0, 10000).withColumn("v", numerals.to_int(numerals.to_numeral(F.col("id"))))
    assert n.where("v IS NULL OR v <> id").isEmpty()
    got = spark.createDataFrame([(87,), (187,), (101,), (110,)], "n int").select(numerals.to_numeral(F.col("n"))).collect()
    assert [r[0] for r in got] == ["八十七", "一百八十七", "一百一", "一百十"]


def test_citations(spark):
    t = "《中华人民共和国劳动合同法》第八十七条、第47条，以及《民法典》第五百八十七条第二款，又《民法典》第587条第二款。最高人民法院关于适用《民法典》的解释（一）第三条"
    found = spark.createDataFrame([(t,), (None,), ("",)], "t string").select(C.citations(F.col("t")).alias("c")).collect()
    assert [(c["law"], c["article"], c["para"]) for c in found[0]["c"]][:2] == [("中华人民共和国劳动合同法", 87, None), ("民法典", 587, 2)]
    assert found[0]["c"][2]["law"].startswith("最高人民法院") and found[0]["c"][2]["article"] == 3
    assert found[1]["c"] == [] and found[2]["c"] == []


def test_lexical_score(spark):
    rows = spark.createDataFrame([("支付三倍工资", "二倍"), ("没有数字", "x"), ("一年内付20%", "一年内按20%付"), (None, None)], "a string, b string")
    assert [r[0] for r in rows.select(C.lexical_score(F.col("a"), F.col("b"))).collect()] == [0.0, 1.0, 1.0, 1.0]


def test_tokens_and_sentences(spark):
    r = spark.createDataFrame([("劳动法，N+1 v2.0。好",)], "t string").select(text.tokens(F.col("t")).alias("t"), text.sentences(F.col("t")).alias("s")).first()
    assert r["t"] == ["劳动", "动法", "法好", "劳动法", "n", "1", "v2.0"]
    assert r["s"] == ["劳动法，N+1 v2.", "0。", "好"]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="甲乙a1。 ，", max_size=12), min_size=1, max_size=8))
def test_normalize_is_idempotent(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(text.normalize(F.col("t")).alias("n"))
    assert rows.where(text.normalize(F.col("n")) != F.col("n")).isEmpty()
