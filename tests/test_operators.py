from pyspark.sql import functions as F

from tessellex.operators import builders, chunking, corpus, dedup, guard, metrics, quality, retrieval, sampling, statutes

LAWS = "law_id long, title string, type string, publish_date string, status string, content string"


def _laws(spark):
    return spark.createDataFrame(
        [
            (1, "中华人民共和国劳动合同法", "法律", "2012", "有效", "第八十七条 用人单位违法解除的，支付二倍赔偿金。\n第八十八条 其他。"),
            (2, "中华人民共和国民法典", "法律", "2020", "有效", "第五百八十七条 债务人履行债务的，定金应当抵作价款。"),
            (3, None, "法律", "2020", "有效", "第一条 x"), (4, "空", "法律", "", None, None),
        ], LAWS,
    )


def test_articles(spark):
    z = spark.createDataFrame([(1, "前言\n第一条 甲。\n依照第四十七条规定\n\n第二条：乙\n续行"), (2, None), (3, "")], "law_id int, content string")
    rows = z.select("law_id", statutes.articles(F.col("content")).alias("a")).orderBy("law_id").collect()
    assert [(a["article"], a["text"]) for a in rows[0]["a"]] == [(1, "第一条 甲。\n依照第四十七条规定"), (2, "第二条：乙\n续行")]
    assert rows[1]["a"] == [] and rows[2]["a"] == []
    assert {(r["pos"], r["article"]) for r in statutes.article_rows(z).collect()} == {(1, 1), (2, 2)}


def test_verify(spark):
    answers = spark.createDataFrame([(1, "依《劳动合同法》第八十七条"), (2, "依《劳动合同法》第二百条"), (3, "没有引用"), (4, None), (5, "依《劳动合同法》第八十七条支付三倍")], "case_id int, answer string")
    got = {r["case_id"]: (r["total"], r["nhsr"]) for r in statutes.verify(answers, _laws(spark)).collect()}
    assert got == {1: (1, 1.0), 2: (1, 0.0), 3: (0, None), 4: (0, None), 5: (1, 0.0)}


def test_resolve_prefers_longest(spark):
    _, names = statutes.statute_index(_laws(spark))
    cited = spark.createDataFrame([("劳动合同法",), ("民法典合同编",), ("无此法",), ("民法",)], "law string")
    assert {r["law"]: r["title"] for r in statutes.resolve_names(cited, names).collect()} == {"劳动合同法": "中华人民共和国劳动合同法", "民法典合同编": None, "无此法": None, "民法": "中华人民共和国民法典"}


def test_exact_and_greedy_dedup(spark):
    rows = spark.createDataFrame([(1, "你好，世界"), (2, "你好世界！"), (3, "别的"), (4, None)], "id int, t string")
    assert {r["id"] for r in dedup.exact_dedup(rows, F.col("t"), "id").collect()} == {1, 3, 4}
    # 1~2, 2~3, not 1~3: the third survives, since only kept rows count.
    keyed = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b"), (3, "b")], "id int, k string")
    assert {r["id"] for r in dedup.greedy_survivors(keyed, "id", "k").collect()} == {1, 3}
    assert dedup.greedy_survivors(keyed.limit(0), "id", "k").collect() == []


def test_greedy_against_sequential(spark):
    import random

    r = random.Random(3)
    pairs = [(i, r.randrange(60)) for i in range(120) for _ in range(3)]
    kept, taken = set(), set()
    for i in range(120):
        ks = {k for j, k in pairs if j == i}
        if not ks & taken:
            kept.add(i)
            taken |= ks
    assert {x["id"] for x in dedup.greedy_survivors(spark.createDataFrame(pairs, "id int, k int"), "id", "k").collect()} == kept


def test_minhash_and_semantic(spark):
    rows = spark.createDataFrame([(1, "劳动合同解除后应当支付经济补偿金"), (2, "劳动合同解除后，应当支付经济补偿金。"), (3, "完全不同的另一段文字在这里")], "id int, t string")
    assert {r["id"] for r in dedup.minhash_dedup(rows, F.col("t"), "id").collect()} == {1, 3}
    vec = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.99, 0.01]), (3, [0.0, 1.0])], "id int, v array<double>")
    assert {r["id"] for r in dedup.semantic_dedup(vec, "v", "id").collect()} == {1, 3}


def test_quality(spark):
    rows = spark.createDataFrame([("公司辞退怎么赔偿？", "依《劳动合同法》第八十七条应支付赔偿金，具体以证据为准。以上仅供参考，不构成法律意见。"), ("合同怎么赔", "肯定能赢，放心起诉赔偿吧，我们帮你处理一切事情，绝不会有任何问题的。"), ("天气", "今天晴。"), (None, None)], "question string, answer string")
    assert [r["reason"] for r in quality.cascade(rows).collect()] == [None, "fact_error", "out_of_scope", "missing"]
    assert rows.select(quality.category(F.concat("question", "answer"))).first()[0] == "labor"


def test_sampling(spark):
    rows = spark.createDataFrame([(i, "ab"[i % 2], i / 400, ["easy", "medium", "hard"][i % 3]) for i in range(400)], "id int, c string, d double, b string")
    assert sampling.diversity_sample(rows, "c", "b", 100, 1, "id").count() == 100
    split = sampling.stratified_split(rows, "c", "d", "id")
    assert {r[0]: r[1] for r in split.groupBy("split").count().collect()} == {"train": 280, "eval": 60, "test": 60}
    assert split.where("split = 'test'").agg(F.min("d")).first()[0] > split.where("split = 'train'").agg(F.max("d")).first()[0]
    again = sampling.random_split(rows.repartition(7), 5, "id").where("split = 'eval'").select("id")
    assert {r[0] for r in again.collect()} == {r[0] for r in sampling.random_split(rows, 5, "id").where("split = 'eval'").collect()}


def test_clean_and_preprocess(spark):
    t = "> 引\n目 录\n第一条的目\n第一章 总则\n![图](x) 正文[链接](y)\n\n\\<a\\>"
    assert spark.createDataFrame([(t,)], "t string").select(corpus.clean_content(F.col("t"))).first()[0] == "引\n正文链接\n〈a〉"
    assert {r["law_id"]: r["reason"] for r in corpus.preprocess(_laws(spark)).collect()} == {1: None, 2: "short", 3: "title", 4: "status"}


def test_chunks(spark):
    laws = spark.createDataFrame([(1, "t", "第一条 " + "甲" * 10 + "\n第二条 乙"), (2, "u", "无条文的一段\n另一段")], "law_id int, title string, content string")
    got = chunking.chunk_by_article(laws).collect()
    assert [(r["law_id"], r["article"]) for r in got] == [(1, 1), (1, 2), (2, None), (2, None)]
    x = spark.createDataFrame([("一二三。四五六。七八九。",)], "t string").select(chunking.sentence_chunks(F.col("t"), 8, 4)).first()[0]
    assert x == ["一二三。四五六。", "四五六。七八九。"]


def test_retrieval(spark):
    docs = spark.createDataFrame([(1, "经济补偿的计算标准"), (2, "租赁合同的押金"), (3, None)], "id int, t string")
    q = spark.createDataFrame([(7, "经济补偿怎么算")], "query_id int, query string")
    hits = retrieval.bm25(q, docs, "id", "t").collect()
    assert [(r["id"], r["rank"]) for r in hits] == [(1, 1)]
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "query_id int, content string, rank int")
    b = spark.createDataFrame([(1, "y", 1)], "query_id int, content string, rank int")
    fused = retrieval.fuse(a, b).orderBy("rank").collect()
    assert [(r["content"], r["method"]) for r in fused] == [("y", "hybrid"), ("x", "bm25")]
    assert abs(fused[0]["score"] - (0.5 / 62 + 1 / 61)) < 1e-8
    assert spark.createDataFrame([("辞退赔偿",)], "q string").select(retrieval.expand(F.col("q"))).first()[0] == "辞退 (解除劳动合同 经济补偿 赔偿金)赔偿"


def test_guard(spark):
    rows = spark.createDataFrame([("公司辞退我怎么办",), ("今天天气",), ("自杀",), (None,)], "q string")
    assert [r[0] for r in rows.select(guard.filter_input(F.col("q"))["category"]).collect()] == ["in_scope", "off_topic", "abusive", "off_topic"]
    assert rows.select(guard.intent(F.col("q"))["intent"]).first()[0] == "labor"
    a = spark.createDataFrame([("肯定能赢",), ("请勿相信肯定能赢的说法",), ("根据相关司法解释的规定显示，可以",), ("胜诉率高达95%",), ("普通",)], "a string")
    assert [r[0] for r in a.select(guard.risk(guard.findings(F.col("a")))).collect()] == ["critical", "low", "low", "critical", "low"]


def test_builders(spark):
    rows = spark.createDataFrame([("问", "依《劳动合同法》第八十七条。仅供参考")], "q string, a string")
    r = rows.select(builders.perturb_article(F.col("a"), F.lit(98)).alias("x"), builders.perturb_law(F.col("a"), F.lit("民法典")).alias("y"), builders.perturb_promise(F.col("a")).alias("z")).first()
    assert r["x"] == "依《劳动合同法》第一百九十八条。仅供参考" and r["y"] == "依《民法典》第八十七条。仅供参考" and r["z"] == "依《劳动合同法》第八十七条。仅供参考你照做就行，肯定能赢。"
    m = rows.select(builders.loss_mask(F.array(F.lit(1), F.lit(2)), F.array(F.lit(3), F.lit(4)), 3).alias("m")).first()["m"]
    assert m["input_ids"] == [1, 2, 3] and m["labels"] == [-100, -100, 3]
    qa = spark.createDataFrame([(None, None, "q", "r"), ("i", "o", None, None)], "instruction string, output string, query string, response string")
    assert [(x["q"], x["a"]) for x in builders.extract_qa(qa).collect()] == [("q", "r"), ("i", "o")]


def test_metrics(spark):
    rows = spark.createDataFrame([("abcde", "abxde"), ("", "x"), (None, None), ("相同", "相同")], "a string, b string")
    assert [r["rouge_l"] for r in metrics.lcs_f1(rows, "a", "b").collect()] == [0.8, 0.0, 0.0, 1.0]
    r = spark.createDataFrame([("肯定能赢",), ("请咨询律师，保留证据，注意时效，不构成法律意见",)], "t string").select(metrics.safety_reward(F.col("t"))).collect()
    assert [x[0] for x in r] == [0.0, 1.0]


def test_sources(spark, tmp_path):
    from tessellex.sources import readers, writers

    (tmp_path / "x.jsonl").write_text('{"q":"甲"}\n\nbroken\n{"q":"乙"}\n', encoding="utf-8")
    assert {r["q"] for r in readers.read_jsonl(spark, str(tmp_path / "x.jsonl"), "q string").collect()} == {"甲", "乙"}
    kb = tmp_path / "kb"
    writers.knowledge_base_template(str(kb))
    (kb / "laws" / "a.txt").write_text("正文", encoding="utf-8")
    assert [(r["source"], r["content"]) for r in readers.read_texts(spark, str(kb)).collect()] == [("laws", "正文")]
    import io
    import zipfile

    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("word/document.xml", "<w:p><w:t>第一</w:t><w:t xml:space='preserve'>条</w:t></w:p><w:p></w:p><w:p><w:t>乙</w:t></w:p>")
    (tmp_path / "d.docx").write_bytes(b.getvalue())
    assert readers.read_docx(spark, str(tmp_path / "d.docx")).first()["content"] == "第一条\n乙"
    rows = spark.createDataFrame([(1, None), (2, "short")], "id int, reason string")
    writers.write_kept_and_rejected(rows, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/kept=true")).count() == 1
    assert writers.markdown(rows.orderBy("id")).splitlines()[2] == "| 1 |  |"


def test_streaming_guard(spark, tmp_path):
    from tessellex.streaming import guarded

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"question":"公司辞退怎么赔偿"}\n{"question":"天气"}\n', encoding="utf-8")
    stream = guarded.guard_stream(spark.readStream.schema("question string").json(str(tmp_path / "in")))
    stream.writeStream.format("memory").queryName("guarded").trigger(availableNow=True).start().awaitTermination()
    assert {r["question"]: r["check"]["safe"] for r in spark.table("guarded").collect()} == {"公司辞退怎么赔偿": True, "天气": False}


def test_every_chunk_supports_claims(spark, tmp_path):
    from tessellex.plans import record_queries

    chunks = [("某法", f"{sign}第{i}条的其他内容") for i, sign in enumerate("甲乙丙")] + [("某法", "当事人违约，承担赔偿责任，返还押金"), ("另法", None)]
    spark.createDataFrame([(i, *c) for i, c in enumerate(chunks)], "chunk_id int, title string, content string").write.parquet(str(tmp_path / "chunks.parquet"))
    cases = [(1, "某法", "当事人违约，应当承担赔偿责任，返还押金。"), (2, "某法", "出租人修缮，应当返还押金，承担费用。"), (3, "另法", "应当a1234567890b"), (4, "无法", "当事人违约，承担赔偿责任，返还押金。"), (5, "某法", None)]
    spark.createDataFrame(cases, "case_id int, law_title string, answer string").write.parquet(str(tmp_path / "contract.parquet"))
    assert {tuple(r) for r in record_queries.claim_support(spark, str(tmp_path)).select("case_id", "claims", "supported").collect()} == {(1, 1, 1), (2, 1, 0), (3, 1, 1)}


def test_minhash_query_recall(spark, tmp_path):
    import random

    from tessellex.plans import corpus_queries

    r = random.Random(4)
    texts = ["".join(chr(0x4E00 + r.randrange(3000)) for _ in range(200)) for _ in range(150)]
    # Four edits break 20 of 196 runs: 176 / 216 are shared.
    near = ["".join("换" if i in (30, 90, 150, 190) else c for i, c in enumerate(t)) for t in texts]
    grams = lambda t: {t[i : i + 5] for i in range(len(t) - 4)}
    alike = [len(grams(a) & grams(b)) / len(grams(a) | grams(b)) for a, b in zip(texts, near)]
    assert 0.79 < min(alike) and max(alike) < 0.83
    spark.createDataFrame(list(enumerate(texts + near)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_queries.minhash_dedup(spark, str(tmp_path)).where("doc_id >= 150").count() <= 0.12 * len(near)


def test_semantic_against_sequential(spark):
    import math
    import random

    r = random.Random(8)
    turns = [0.0] * 70 + [r.choice([0.0, 1.0, 2.0, 3.0]) + r.random() * 0.2 for _ in range(200)] + [r.random() * 6.28 for _ in range(100)]
    rows = [(i, [math.cos(t), math.sin(t)]) for i, t in enumerate(turns)]
    for window in (2, 20):
        kept = []
        for i, v in rows:
            if not any(v[0] * w[0] + v[1] * w[1] >= 0.95 for _, w in kept[-window:]):
                kept.append((i, v))
        frame = spark.createDataFrame(rows, "id int, v array<double>").repartition(5)
        assert sorted(x["id"] for x in dedup.semantic_dedup(frame, "v", "id", 0.95, window).collect()) == [i for i, _ in kept]


def test_dense_in_blocks(spark):
    rows = spark.createDataFrame([(i, [float(i % 37), float(i % 11)]) for i in range(90)], "id int, v array<double>")
    asked = rows.select(F.col("id").alias("query_id"), F.col("v").alias("vector"))
    whole = retrieval.dense(asked, rows, "id", "v", 3)
    parts = retrieval.dense(asked, rows, "id", "v", 3, block=20)
    assert sorted(map(tuple, parts.collect())) == sorted(map(tuple, whole.collect())) and whole.count() == 270


def test_check_output(spark):
    fine = "应当支付经济补偿。以上内容仅供参考，不构成法律意见。"
    rows = [("辞退赔偿多少", fine), ("仲裁时效多久届满", fine), ("辞退赔偿多少", "您肯定能赢。仅供参考"), ("辞退赔偿多少", "应当支付经济补偿。"), (None, None)]
    out = guard.check_output(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, question string, answer string")).orderBy("i").collect()
    assert [r["safe"] for r in out] == [True, True, False, True, True]
    assert [r["risk_level"] for r in out][1:3] == ["critical", "critical"] and out[1]["response"].startswith("⚠️") and out[2]["fallback"] and not out[0]["fallback"]
    assert "不构成法律意见" in out[3]["response"] and out[3]["response"].startswith("应当支付经济补偿。\n\n⚠️")
    done = guard.process(spark.createDataFrame([("辞退赔偿多少",), ("今天天气",)], "question string"), lambda d: d.withColumn("answer", F.lit(fine))).collect()
    assert {r["question"]: r["safe"] for r in done} == {"辞退赔偿多少": True, "今天天气": False}


def test_pack_context_forms(spark):
    hits = spark.createDataFrame([(1, k, f"法{k}", "甲" * 100) for k in range(3)], "g int, r int, title string, content string")
    plain = chunking.pack_context(hits, "g", "r", 320).first()["context"]
    assert plain.startswith("【参考法律法规】\n\n--- 法0 ---\n") and plain.count("---") == 4  # 84 characters are left for the third
    cut = chunking.pack_context(hits, "g", "r", 320, 80, numbered=True).first()["context"]
    assert cut.startswith("【检索到的法条】\n\n[文档1] 法0：\n") and cut.endswith("甲...") and "[文档3]" in cut


def test_grounded_records(spark):
    laws = spark.createDataFrame([(i, f"中华人民共和国第{i}法", f"第一条 内容{i}。\n第二条 其他{i}。") for i in range(8)], "law_id long, title string, content string")
    _, names = statutes.statute_index(laws)
    chunks = laws.select((F.col("law_id") * 2).alias("chunk_id"), "title", F.lit(1).alias("article"), F.lit("第一条").alias("content")).unionByName(laws.select((F.col("law_id") * 2 + 1).alias("chunk_id"), "title", F.lit(2).alias("article"), F.lit("第二条").alias("content")))
    rows = spark.createDataFrame([(i, "问", f"依《第{i % 8}法》第二条处理。") for i in range(60)] + [(99, "问", "没有引用")], "case_id long, question string, answer string")
    out = builders.grounded_records(rows, chunks, names).collect()
    assert len(out) == 60 and all(r["oracle_chunk"] == 2 * (r["case_id"] % 8) + 1 for r in out)  # resolved by the short form
    assert all(len(set(r["distractors"])) == 2 and all(d // 2 != r["case_id"] % 8 for d in r["distractors"]) for r in out)
    assert {d for r in out for d in r["distractors"]} == set(range(16))  # every chunk can be drawn
    assert 30 < sum(r["has_oracle"] for r in out) < 60
    for r in out:
        assert r["context"].count("[文档") == (3 if r["has_oracle"] else 2) and (r["answer"].startswith("抱歉") != r["has_oracle"])


def test_preference_pairs_limit(spark):
    good = "根据《劳动合同法》第八十七条的规定，用人单位违法解除劳动合同的，应当按照经济补偿标准的二倍向劳动者支付赔偿金，可以申请仲裁。" * 2 + "以上内容仅供参考，不构成法律意见。"
    rows = spark.createDataFrame([(i, "问", good if i % 2 else "短", None) for i in range(10)], "case_id long, question string, answer string, title string")
    none = spark.createDataFrame([], "title string, article int")
    pairs = builders.preference_pairs(rows, none, none)
    assert {r["case_id"] for r in pairs.collect()} == {1, 3, 5, 7, 9} and pairs.count() == 10
    assert {r["case_id"] for r in builders.preference_pairs(rows, none, none, most=3).collect()} == {1, 3}
    labels = builders.safety_labels(pairs).select("chosen_safety", "rejected_safety").distinct().collect()
    assert [tuple(r) for r in labels] == [(0, 1)]


def test_resolve_by_short_form(spark):
    names = spark.createDataFrame([("劳动法", "劳动法（试行）", 1), ("劳动法（试行）", "劳动法（试行）", 1)], "name string, title string, rank long")
    cited = spark.createDataFrame([("中华人民共和国劳动法",), ("无此法",)], "law string")
    assert {r["law"]: r["title"] for r in statutes.resolve_names(cited, names).collect()} == {"中华人民共和国劳动法": "劳动法（试行）", "无此法": None}


def test_dense_blocks_and_lengths(spark):
    import random

    r = random.Random(4)
    rows = [(i, [r.random() for _ in range(6)]) for i in range(120)] + [(500, None), (501, [0.5, 0.5])] + [(600 + i, [0.5] * 6) for i in range(20)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asked = spark.createDataFrame([(i, v) for i, v in rows if i % 7 == 0] + [(9001, [0.5] * 6), (9002, None)], "query_id long, vector array<float>")
    got = {}
    for x in retrieval.dense(asked, vectors, "vec_id", "embedding", 5, block=4).collect():
        got.setdefault(x["query_id"], []).append((x["rank"], x["vec_id"], x["score"]))
    kept = {x["vec_id"]: x["embedding"] for x in vectors.collect() if x["embedding"]}
    for q in asked.collect():
        if q["vector"] is None:
            assert q["query_id"] not in got
            continue
        far = {k: round(1 / (1 + sum((a - b) ** 2 for a, b in zip(q["vector"], v)) ** 0.5), 6) for k, v in kept.items() if len(v) == len(q["vector"])}
        want = sorted(far, key=lambda k: (-far[k], k))[:5]
        assert [k for _, k, _ in sorted(got[q["query_id"]])] == want


def test_hybrid_reranks_complex_only(spark):
    docs = spark.createDataFrame([(1, "经济补偿 的 计算 标准 2019年"), (2, "第八十七条 经济补偿 计算 司法解释"), (3, "租赁 押金 退还")], "chunk_id long, content string")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0])], "chunk_id long, embedding array<double>")
    queries = spark.createDataFrame([(1, "经济补偿怎么算", [1.0, 0.0]), (2, "押金 退还", [0.0, 1.0]), (3, "有什么法律规定", [0.0, 1.0])], "query_id long, query string, vector array<double>")
    out = retrieval.hybrid(queries, docs, "chunk_id", "content", vectors, 2)
    first = {r["query_id"]: r["chunk_id"] for r in out.where("rank = 1").collect()}
    assert first == {1: 2, 2: 3}  # the legal reference wins for the complex query, the simple one is left out
    hits = retrieval.document_search(queries.select("query_id", "query"), docs, "chunk_id", "content", 1).collect()
    assert {r["query_id"]: r["chunk_id"] for r in hits}[2] == 3
    postings, totals = retrieval.bm25_index(docs, "chunk_id", "content")
    plain = sorted(map(tuple, retrieval.bm25(queries, docs, "chunk_id", "content").collect()))
    assert sorted(map(tuple, retrieval.bm25_indexed(queries, postings, totals, "chunk_id").select("query_id", "chunk_id", "score", "rank").collect())) == plain


def test_bm25_in_blocks(spark, monkeypatch):
    """The scores of all pairs are in no plan; blocks of documents and of queries give what the index gives, also with repeated, null and empty rows."""
    words = ["合同", "解除", "赔偿", "时效", "劳动", "仲裁", "Rent", "lease"]
    texts = [" ".join(words[(i * j) % 8] for j in range(1, 2 + i % 7)) for i in range(200)]
    docs = spark.createDataFrame([(i % 190, t) for i, t in enumerate(texts)] + [(500, None), (501, ""), (None, "合同 lease"), (7, "劳动 lease lease")], "id int, t string")
    asked = spark.createDataFrame([(i % 28, texts[i * 5] + " 合同") for i in range(30)] + [(90, "无关"), (91, None)], "query_id int, query string")
    monkeypatch.setattr(retrieval, "BLOCK_TOKENS", 200)
    monkeypatch.setattr(retrieval, "BLOCK_WEIGHTS", 25)
    hits = retrieval.bm25(asked, docs, "id", "t")
    assert "Join" not in hits._jdf.queryExecution().toString()
    postings, totals = retrieval.bm25_index(docs, "id", "t")
    want = retrieval.bm25_indexed(asked, postings, totals, "id").select("query_id", "id", "score", "rank").collect()
    assert len(want) == 140 and sorted(map(str, hits.collect())) == sorted(map(str, want))
    assert retrieval.bm25(asked.limit(0), docs, "id", "t").count() == retrieval.bm25(asked, docs.limit(0), "id", "t").count() == 0


def test_claims_of_one_large_title(spark, tmp_path):
    """Claims and chunks of a title never meet all with all, and the numbers are those of the expression on whole texts."""
    import random

    from tessellex.plans import record_queries

    r = random.Random(5)
    runs = ["".join(chr(0x4E00 + r.randrange(40)) for _ in range(n)) for n in (3, 4, 5, 6, 7, 11, 12, 13, 20) for _ in range(3)]
    some = lambda n: [r.choice(runs) for _ in range(n)]
    chunks = [(i, "某法", "x1，".join(some(r.randrange(1, 7)))) for i in range(80)]
    cases = [(i, "某法", "应当a123456789，" + "，".join(x + r.choice(["", "换"]) for x in some(r.randrange(7))) + "。") for i in range(200)]
    spark.createDataFrame(chunks, "chunk_id int, title string, content string").write.parquet(str(tmp_path / "chunks.parquet"))
    spark.createDataFrame(cases, "case_id int, law_title string, answer string").write.parquet(str(tmp_path / "contract.parquet"))
    got = record_queries.claim_support(spark, str(tmp_path))
    assert "Contains(" not in got._jdf.queryExecution().toString()
    docs = F.array(*[F.lit(c) for _, _, c in chunks])
    claims = F.filter(guard.claims(F.col("answer")), lambda c: guard.supported(c, docs))
    want = spark.createDataFrame(cases, "case_id int, t string, answer string").select("case_id", F.size(guard.claims(F.col("answer"))), F.size(claims)).where(F.size(guard.claims(F.col("answer"))) > 0)
    want = {tuple(x) for x in want.collect()}
    assert {tuple(x) for x in got.select("case_id", "claims", "supported").collect()} == want
    assert 20 < sum(x[2] for x in want) < 180


def test_fast_signature_keeps_grams_in_their_row(spark):
    """No row per gram; the share of equal minima is that of common grams, in long, short, null and repeated texts."""
    text = "".join(chr(0x4E00 + i * 7 % 5000) for i in range(3000))
    rows = [(1, text), (2, text[:1800]), (3, text.replace(chr(0x4E00), " ")), (4, "甲乙丙丁"), (5, None), (6, "😀bcd e" * 3), (7, "😀bcd e")]
    signed = dedup.fast_signature(spark.createDataFrame(rows, "id int, t string"), F.col("t"), "id")
    assert "Generate" not in signed._jdf.queryExecution().toString()
    sig = {r["id"]: r["sig"] for r in signed.collect()}
    share = lambda a, b: sum(x == y for x, y in zip(sig[a], sig[b])) / 128
    assert 0.45 < share(1, 2) < 0.75 and share(1, 3) > 0.95 and share(1, 6) == 0
    assert sig[4] == sig[5] == sig[7] == [0] * 128 and len(set(sig[1])) == 128


def test_greedy_looks_at_shared_keys_only(spark):
    """Rows that share no key stay without a round, also those whose only key is null."""
    keyed = spark.createDataFrame([(1, 10), (1, 11), (2, 11), (3, 12), (4, None), (5, None), (5, 13)], "id int, k int")
    assert {r["id"] for r in dedup.greedy_survivors(keyed, "id", "k").collect()} == {1, 3, 4, 5}


def test_rerank_rounds_the_double(spark):
    """47.14545 is the double 47.145449999..., as SQL rounds it too."""
    hits = spark.createDataFrame([(x, "", "") for x in (47.14545, 51.83145, 2.00005)], "score double, q string, c string")
    assert [r["rerank_score"] for r in retrieval.rerank(hits, F.col("q"), F.col("c")).collect()] == [int(x * 10_000 + 0.5) / 10_000 for x in (47.14545, 51.83145, 2.00005)]


def _scored_in_blocks(spark, name, folder):
    """A query on generated tables whose plan scores in blocks, with the join of postings and weights nowhere in it."""
    from tessellex.plans import record_queries

    chunks = [(i, f"法{i % 3}" if i % 4 else None, f"合同解除后第{i}日内返还押金" if i % 7 else None) for i in range(60)]
    spark.createDataFrame(chunks, "chunk_id long, title string, content string").write.parquet(f"{folder}/chunks.parquet")
    spark.createDataFrame([(20 * i, "公司辞退，合同解除后押金返还吗" if i % 5 else None) for i in range(1, 12)], "case_id long, question string").write.parquet(f"{folder}/contract.parquet")
    got = record_queries.QUERIES[name](spark, str(folder))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "_idf" not in plan
    return got


def test_context_pack_scores_in_blocks(spark, tmp_path):
    rows = _scored_in_blocks(spark, "context_pack", tmp_path).collect()
    assert len(rows) == 9 and all(r["context"].count("\n--- ") == 5 for r in rows)


def test_hybrid_scores_in_blocks(spark, tmp_path):
    rows = _scored_in_blocks(spark, "hybrid_topk", tmp_path).collect()
    assert len(rows) == 45 and {r["rank"] for r in rows} == {1, 2, 3, 4, 5} and {r["method"] for r in rows} == {"bm25"}
