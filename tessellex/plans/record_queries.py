"""Queries on records: quality, samples, retrieval, guard, builders and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..domain import legal
from ..functions.citations import LOOSE, citations
from ..functions.text import char_grams
from ..operators import builders, chunking, guard, metrics, quality, retrieval, sampling, statutes
from ..session import kept_table, table

T = table
#: The beginnings of claims' runs are broadcast up to so many; beyond it their join shuffles all of the chunks' grams.
MAX_BROADCAST_GRAMS = 500_000


def _qa(s: SparkSession, d: str) -> DataFrame:
    """Records with null texts as empty ones."""
    return T(s, d, "contract").select("case_id", F.coalesce("question", F.lit("")).alias("question"), F.coalesce("answer", F.lit("")).alias("answer"), F.lower(F.trim("department")).alias("department"), F.col("difficulty"), "source", "created_at")


def Q() -> Column:  # noqa: N802
    return F.col("question")


def A() -> Column:  # noqa: N802
    return F.col("answer")


def quality_filter(s: SparkSession, d: str) -> DataFrame:
    return _qa(s, d).where(quality.good_pair(Q(), A())).select("case_id")


def difficulty(s: SparkSession, d: str) -> DataFrame:
    x = _qa(s, d).select("case_id", quality.difficulty(Q(), A()).alias("score"))
    return x.withColumn("bucket", quality.bucket(F.col("score")))


def category(s: SparkSession, d: str) -> DataFrame:
    return _qa(s, d).select("case_id", quality.category(F.concat(Q(), A())).alias("category"))


def flagship(s: SparkSession, d: str) -> DataFrame:
    x = _qa(s, d).withColumn("h", F.sha2(F.regexp_replace(F.lower(F.concat(Q(), F.lit(" "), A())), r"[^\p{L}\p{N}]+", ""), 256))
    first = x.groupBy("h").agg(F.min("case_id").alias("case_id"))
    kept = x.join(first.select("case_id"), "case_id", "left_semi").where(quality.good_pair(Q(), A()))
    scored = kept.select(quality.category(F.concat(Q(), A())).alias("category"), quality.difficulty(Q(), A()).alias("_s"))
    return scored.groupBy("category").agg(F.count(F.lit(1)).alias("records"), F.round(F.avg("_s") + 1e-9, 4).alias("mean_difficulty"), F.count_if(F.col("_s") >= 0.6).alias("hard"))


def cascade_filter(s: SparkSession, d: str) -> DataFrame:
    x = quality.cascade(_qa(s, d))
    return x.select("case_id", "reason", F.array_join("flags", ",").alias("flags"))


def filter_stats(s: SparkSession, d: str) -> DataFrame:
    return cascade_filter(s, d).groupBy("reason").agg(F.count(F.lit(1)).alias("records"))


def fact_rules(s: SparkSession, d: str) -> DataFrame:
    x = _qa(s, d).select("case_id", F.explode(quality.fact_issues(Q(), A())).alias("i"))
    return x.select("case_id", F.col("i.rule").alias("rule"), F.col("i.severity").alias("severity"))


def answer_flags(s: SparkSession, d: str) -> DataFrame:
    return _qa(s, d).select("case_id", quality.has_disclaimer(A()).alias("disclaimer"), quality.has_overpromise(A()).alias("promise"), quality.in_scope(Q()).alias("in_scope"), quality.preference_source(A()).alias("preference"), quality.complex_enough(Q()).alias("complex_enough"))


def stratified_split(s: SparkSession, d: str) -> DataFrame:
    return sampling.stratified_split(_qa(s, d), "department", "difficulty", "case_id").select("case_id", "split")


def random_split(s: SparkSession, d: str) -> DataFrame:
    return sampling.random_split(_qa(s, d), 42, "case_id").select("case_id", "split")


def hash_sample(s: SparkSession, d: str) -> DataFrame:
    return sampling.first_n(T(s, d, "documents"), 600, 42, "doc_id").select("doc_id")


def diversity_sample(s: SparkSession, d: str) -> DataFrame:
    x = _qa(s, d).withColumn("bucket", quality.bucket(F.coalesce("difficulty", F.lit(0.0))))
    return sampling.diversity_sample(x, "department", "bucket", 400, 42, "case_id").groupBy("department").agg(F.count(F.lit(1)).alias("records"))


def _questions(s: SparkSession, d: str) -> DataFrame:
    """The stated query set: every question whose id is divisible by 20."""
    return T(s, d, "contract").where("case_id % 20 = 0 AND question IS NOT NULL").select(F.col("case_id").alias("query_id"), F.col("question").alias("query"))


def expand_query(s: SparkSession, d: str) -> DataFrame:
    return _questions(s, d).select("query_id", retrieval.expand(F.col("query")).alias("expanded"), retrieval.complexity(F.col("query")).alias("level"))


def bm25_stats(s: SparkSession, d: str) -> DataFrame:
    postings, _ = retrieval.bm25_index(T(s, d, "chunks"), "chunk_id", "content")
    return postings.groupBy("term").agg(F.max("df").alias("df"), F.sum("tf").alias("tf"))


def bm25_topk(s: SparkSession, d: str) -> DataFrame:
    return retrieval.bm25(_questions(s, d), T(s, d, "chunks"), "chunk_id", "content")


def _vectors(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = T(s, d, "embeddings")
    return e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), e


def dense_topk(s: SparkSession, d: str) -> DataFrame:
    asked, e = _vectors(s, d)
    return retrieval.dense(asked, e, "vec_id", "embedding")


def rrf_fusion(s: SparkSession, d: str) -> DataFrame:
    asked, e = _vectors(s, d)
    near = retrieval.dense(asked, e, "vec_id", "embedding", 10)
    other = retrieval.dense(asked.withColumn("vector", F.transform("vector", lambda x: -x)), e, "vec_id", "embedding", 10)
    return retrieval.fuse(other, near, "vec_id", 8)


def hybrid_topk(s: SparkSession, d: str) -> DataFrame:
    return retrieval.hybrid(_questions(s, d), T(s, d, "chunks"), "chunk_id", "content", force=True)


def heuristic_rerank(s: SparkSession, d: str) -> DataFrame:
    hits = bm25_topk(s, d).join(_questions(s, d), "query_id").join(T(s, d, "chunks").select("chunk_id", "content"), "chunk_id")
    return retrieval.rerank(hits, F.col("query"), F.col("content")).select("query_id", "chunk_id", "rerank_score")


def context_pack(s: SparkSession, d: str) -> DataFrame:
    hits = bm25_topk(s, d).join(T(s, d, "chunks").select("chunk_id", "title", "content"), "chunk_id")
    return chunking.pack_context(hits, "query_id", "rank", 1200)


def input_filter(s: SparkSession, d: str) -> DataFrame:
    g = guard.filter_input(Q())
    return _qa(s, d).select("case_id", g["accepted"].alias("accepted"), g["category"].alias("category"), (g["reason"] != "").alias("has_reason"))


def intent_route(s: SparkSession, d: str) -> DataFrame:
    c = guard.check_input(Q())
    return _qa(s, d).withColumn("c", c).select("case_id", "c.intent", "c.confidence", "c.label", "c.emergency", "c.needs_rag", "c.refusal")


def moderate(s: SparkSession, d: str) -> DataFrame:
    x = _qa(s, d).select("case_id", F.explode(guard.moderate(A())).alias("w"))
    return x.select("case_id", "w.severity", "w.message")


def confidence(s: SparkSession, d: str) -> DataFrame:
    return _qa(s, d).select("case_id", guard.confidence(A()).alias("confidence"))


def check_output(s: SparkSession, d: str) -> DataFrame:
    return guard.check_output(_qa(s, d)).select("case_id", "risk_level", "safe", "confidence", F.length("response").alias("response_chars"))


def hallucination_findings(s: SparkSession, d: str) -> DataFrame:
    x = _qa(s, d).select("case_id", F.explode(guard.findings(A())).alias("f"))
    return x.groupBy("f.subtype", "f.severity").agg(F.count(F.lit(1)).alias("findings"), F.count_distinct("case_id").alias("answers"))


def risk_level(s: SparkSession, d: str) -> DataFrame:
    x = _qa(s, d).withColumn("f", guard.findings(A()))
    return x.select("case_id", guard.risk(F.col("f")).alias("risk"), guard.rate(F.col("f"), A()).alias("rate"))


def claim_support(s: SparkSession, d: str) -> DataFrame:
    chunks = T(s, d, "chunks").where("title IS NOT NULL").select("title", "content").distinct()
    asked = T(s, d, "contract").where("answer IS NOT NULL").select("case_id", F.col("law_title").alias("title"), F.explode(guard.claims(F.col("answer"))).alias("claim"))
    x = kept_table(asked.join(chunks.select("title").distinct(), "title", "left_semi"))
    # Every chunk of the title counts: runs meet its stretches of ideographs by their first 12, 6 or 3 and are looked for there, then runs are counted per claim and chunk.
    claims = x.select("title", "claim").distinct().withColumn("runs", guard.key_runs(F.col("claim"))).withColumn("n", F.size("runs"))
    runs = claims.select("title", "claim", "n", F.explode("runs").alias("run")).groupBy("title", "claim", "n", "run").agg(F.count(F.lit(1)).alias("times"))
    sought = runs.select("title", "run").distinct().withColumn("gram", F.substring("run", 1, F.when(F.length("run") >= 12, 12).when(F.length("run") >= 6, 6).otherwise(3)))
    parts = chunks.withColumn("chunk", F.xxhash64("content")).select("title", "chunk", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit("[一-鿿]{3,}"), F.lit(0)))).alias("part"))
    grams = parts.withColumn("gram", F.explode(F.array_distinct(F.concat(*[char_grams(F.col("part"), g) for g in (3, 6, 12)]))))
    wanted = kept_table(sought.select("gram").distinct())
    if wanted.count() <= MAX_BROADCAST_GRAMS:
        grams = grams.join(F.broadcast(wanted), "gram", "left_semi")
    hits = sought.join(grams, ["title", "gram"]).where(F.contains("part", F.col("run")))
    # What a chunk has is the set of its runs, and what a claim lacks in all chunks of its title counts in none: equal ones of either are compared once.
    sets = kept_table(hits.groupBy("title", "chunk").agg(F.array_sort(F.collect_set("run")).alias("there")).select("title", "there").distinct())
    by_run = sets.withColumn("run", F.explode("there"))
    held = runs.join(by_run.groupBy("title", "run").agg(F.count(F.lit(1)).alias("sets")), ["title", "run"]).groupBy("title", "claim", "n")
    held = kept_table(held.agg(F.array_sort(F.collect_list(F.struct("sets", "run", "times"))).alias("held"), F.sum("times").alias("most"), F.max("times").alias("least")).where("most >= 0.6D * n"))
    # A set with enough of a claim's runs has one, rarest first, behind which (with it) enough remain.
    open_ = held.where("least < 0.6D * n").select("title", "n", "held").distinct()
    starts = open_.withColumn("run", F.explode(F.expr("transform(filter(transform(held, (h, i) -> struct(h.run AS run, aggregate(slice(held, i + 1, size(held)), 0L, (a, y) -> a + y.times) AS rest)), z -> z.rest >= 0.6D * n), z -> z.run)")))
    met = starts.join(by_run, ["title", "run"]).where(F.expr("aggregate(held, 0L, (a, y) -> a + IF(array_contains(there, y.run), y.times, 0L)) >= 0.6D * n")).select("title", "n", "held").distinct()
    best = held.where("least >= 0.6D * n").select("title", "claim").unionByName(held.join(met, ["title", "n", "held"], "left_semi").select("title", "claim"))
    backed = best.unionByName(claims.where("n = 0").select("title", "claim")).distinct().withColumn("backed", F.lit(True))
    return x.join(backed, ["title", "claim"], "left").groupBy("case_id").agg(F.count(F.lit(1)).alias("claims"), F.count("backed").alias("supported"))


def qa_extract(s: SparkSession, d: str) -> DataFrame:
    x = T(s, d, "contract").select("case_id", F.when(F.col("case_id") % 2 == 0, F.col("question")).alias("instruction"), F.when(F.col("case_id") % 2 == 0, F.col("answer")).alias("output"), F.when(F.col("case_id") % 2 == 1, F.col("question")).alias("query"), F.when(F.col("case_id") % 2 == 1, F.col("answer")).alias("response"))
    return builders.extract_qa(x).select("case_id", F.sha2(F.col("q"), 256).alias("q"), F.sha2(F.col("a"), 256).alias("a"))


def to_chatml(s: SparkSession, d: str) -> DataFrame:
    return _qa(s, d).select("case_id", F.sha2(builders.chatml(builders.messages(Q(), A())), 256).alias("chatml"), F.length(builders.chatml(builders.messages(Q(), A()), True)).alias("prompt_chars"))


def chat_pairs(s: SparkSession, d: str) -> DataFrame:
    return _qa(s, d).select("case_id", F.posexplode(builders.share_format(builders.messages(Q(), A()))).alias("pos", "m")).select("case_id", "pos", F.col("m.from").alias("speaker"), F.length("m.value").alias("chars"))


def rag_prompt(s: SparkSession, d: str) -> DataFrame:
    return _qa(s, d).select("case_id", F.length(builders.rag_prompt(Q(), F.lit(""))).alias("chars"), F.length(builders.after_thinking(F.concat(F.lit("<think>a</think> "), A()))).alias("bare"))


def history_window(s: SparkSession, d: str) -> DataFrame:
    e = T(s, d, "events").select("user_id", "event_id", F.lit("user").alias("role"), F.col("event_type").alias("text"))
    return builders.history(e, "user_id", "event_id").select("event_id", F.length("history").alias("chars"))


def chain_of_thought(s: SparkSession, d: str) -> DataFrame:
    return _qa(s, d).select("case_id", builders.chain_of_thought(Q(), A()).alias("text"))


def loss_mask(s: SparkSession, d: str) -> DataFrame:
    def ids(c: Column) -> Column:
        return F.transform(F.filter(F.split(c, ""), lambda x: x != ""), F.ascii)

    x = _qa(s, d).select("case_id", builders.loss_mask(ids(Q()), ids(A()), 256).alias("m"))
    return x.select("case_id", F.size("m.input_ids").alias("n"), F.size(F.filter("m.labels", lambda v: v == -100)).alias("masked"), F.size("m.labels").alias("labels"))


def dpo_pairs(s: SparkSession, d: str) -> DataFrame:
    rows, names = statutes.statute_index(T(s, d, "laws"))
    x = _qa(s, d).withColumn("law", F.try_element_at(citations(A()), F.lit(1))["law"]).join(statutes.resolve_names(_qa(s, d).select(F.try_element_at(citations(A()), F.lit(1))["law"].alias("law")), names), "law", "left")
    return builders.preference_pairs(x, rows, names)


def safedpo_transform(s: SparkSession, d: str) -> DataFrame:
    x = _qa(s, d).select("case_id", F.lit("plain").alias("type"), F.when(F.col("case_id") % 3 == 0, builders.perturb_promise(A())).otherwise(A()).alias("chosen"), F.when(F.col("case_id") % 2 == 0, builders.perturb_promise(A())).otherwise(A()).alias("rejected"))
    return builders.safe_preferences(builders.safety_labels(x)).groupBy("action").agg(F.count(F.lit(1)).alias("pairs"), F.sum("rejected_safety").alias("unsafe"))


def raft_records(s: SparkSession, d: str) -> DataFrame:
    _, names = statutes.statute_index(T(s, d, "laws"))
    x = builders.grounded_records(T(s, d, "contract").where("question IS NOT NULL AND answer IS NOT NULL"), T(s, d, "chunks"), names)
    return x.select("case_id", "oracle_chunk", "has_oracle", "oracle_law", F.size("distractors").alias("distractors"))


def rewards(s: SparkSession, d: str) -> DataFrame:
    return _qa(s, d).select("case_id", metrics.reward(A()).alias("reward"))


def lcs_rouge(s: SparkSession, d: str) -> DataFrame:
    return metrics.lcs_f1(_qa(s, d), "question", "answer").select("case_id", "rouge_l")


def term_coverage(s: SparkSession, d: str) -> DataFrame:
    return _qa(s, d).select("case_id", metrics.term_coverage(A(), Q()).alias("coverage"), metrics.term_coverage(A(), Q(), True).alias("distinct_coverage"), metrics.keyword_coverage(Q(), A()).alias("keyword_coverage"))


def keypoint_coverage(s: SparkSession, d: str) -> DataFrame:
    return _qa(s, d).select("case_id", F.round(metrics.key_point_coverage(F.split(Q(), "，"), A()), 6).alias("coverage"), metrics.judge(A())["overall"].alias("judge"), metrics.judge(A())["has_errors"].alias("has_errors"))


def eval_rollup(s: SparkSession, d: str) -> DataFrame:
    return metrics.professional_rollup(_qa(s, d), "department")


def compare_rollup(s: SparkSession, d: str) -> DataFrame:
    x = _qa(s, d).select("department", metrics.term_coverage(A(), Q()).alias("t"), metrics.length_reward(A()).alias("b"))
    return metrics.comparison_rollup(x, "department", "b", "t")


def case_topk(s: SparkSession, d: str) -> DataFrame:
    return metrics.case_studies(_qa(s, d), F.length("answer") - F.length("question"), "case_id").select("case_id", "delta", "side")


def token_summary(s: SparkSession, d: str) -> DataFrame:
    return T(s, d, "contract").groupBy("split").agg(F.count(F.lit(1)).alias("records"), F.sum(F.length("answer")).alias("chars"), F.round(F.avg(F.length("answer")), 4).alias("mean_chars"))


def grid_runs(s: SparkSession, d: str) -> DataFrame:
    x = T(s, d, "nation").groupBy(F.col("n_regionkey").cast("string").alias("name")).agg(F.array_sort(F.collect_list(F.col("n_nationkey").cast("string"))).alias("values"))
    return builders.expand_grid(x)


QUERIES = {f.__name__: f for f in (
    flagship, quality_filter, difficulty, category, cascade_filter, filter_stats, fact_rules, answer_flags, stratified_split, random_split, hash_sample, diversity_sample, expand_query, bm25_stats, bm25_topk, dense_topk,
    rrf_fusion, hybrid_topk, heuristic_rerank, context_pack, input_filter, intent_route, moderate, confidence, check_output, hallucination_findings, risk_level, claim_support, qa_extract, to_chatml, chat_pairs, rag_prompt,
    history_window, chain_of_thought, loss_mask, dpo_pairs, safedpo_transform, raft_records, rewards, lcs_rouge, term_coverage, keypoint_coverage, eval_rollup, compare_rollup, case_topk, token_summary, grid_runs,
)}


def _like(column: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


def _sum(column: str, words: tuple[str, ...]) -> str:
    return "(" + " + ".join(f"contains({column}, '{w}')::INTEGER" for w in words) + ")"


from .corpus_queries import _CITED_TAIL  # noqa: E402

_QA = "WITH qa AS (SELECT case_id, coalesce(question, '') AS question, coalesce(answer, '') AS answer, lower(trim(department)) AS department, difficulty FROM contract)"
_GOOD = "length(question) BETWEEN 4 AND 500 AND length(answer) BETWEEN 20 AND 1500 AND len(regexp_extract_all(answer, '[一-鿿]')) >= 10 AND len(regexp_extract_all(question, '[一-鿿]')) >= 2 AND len(list_distinct(string_split(answer, ''))) >= 0.3::DOUBLE * length(answer)"
_OVER, _DISC = legal.OVERPROMISE, _like("answer", legal.DISCLAIMERS)
_SCORE = f""", {_CITED_TAIL}, cites AS (SELECT case_id, count(*) AS n FROM cited GROUP BY case_id), scored AS (SELECT qa.*, round(least(1.0::DOUBLE, least(length(question) / 100.0::DOUBLE, 1.0::DOUBLE) * 0.20::DOUBLE + least(length(answer) / 600.0::DOUBLE, 1.0::DOUBLE) * 0.20::DOUBLE
    + least(coalesce(n, 0) / 4.0::DOUBLE, 1.0::DOUBLE) * 0.25::DOUBLE + least(len(regexp_extract_all(question || answer, '[0-9]+\\.?[0-9]*\\s*(?:年|个月|倍|%|元|天|日)')) / 5.0::DOUBLE, 1.0::DOUBLE) * 0.20::DOUBLE
    + least({_sum('(question || answer)', legal.HARD_WORDS)} / 4.0::DOUBLE, 1.0::DOUBLE) * 0.15::DOUBLE) + 1e-9::DOUBLE, 3) AS score FROM qa LEFT JOIN cites USING (case_id))""".replace("\\\\", "\\")
_HITS = {n: _sum("(question || answer)", w) for n, w in legal.CATEGORIES.items()}
_BEST = "greatest(" + ", ".join(_HITS.values()) + ")"
_CAT = f"CASE WHEN {_BEST} = 0 THEN 'general' " + " ".join(f"WHEN {h} = {_BEST} THEN '{n}'" for n, h in _HITS.items()) + " END"
_BAD = "|".join(p for _, p, s in legal.FACT_RULES if s == "error")
_TRIM = r"regexp_replace({}, '^[\s\x{{00A0}}\x{{2000}}-\x{{200A}}\x{{202F}}\x{{3000}}]+|[\s\x{{00A0}}\x{{2000}}-\x{{200A}}\x{{202F}}\x{{3000}}]+$', '', 'g')"
_CASCADE = f"""{_QA}, t AS (SELECT case_id, {_TRIM.format('question')} AS q, {_TRIM.format('answer')} AS answer FROM qa),
    c AS (SELECT case_id, CASE WHEN q = '' OR answer = '' THEN 'missing' WHEN NOT {_like('(q || answer)', legal.IN_SCOPE)} THEN 'out_of_scope' WHEN length(answer) < 30 THEN 'too_short' WHEN regexp_matches(q || ' ' || answer, '{_BAD}') THEN 'fact_error' END AS reason,
          array_to_string(list_filter([CASE WHEN length(answer) > 1500 THEN 'too_long' END, CASE WHEN NOT {_DISC} THEN 'no_disclaimer' END], lambda x: x IS NOT NULL), ',') AS flags FROM t)"""
_TOK = """len_t AS (SELECT {k}, {x} AS c, regexp_replace({x}, '[^一-鿿]+', '', 'g') AS han FROM {t}),
    {n} AS (SELECT {k}, list_concat(list_concat(list_transform(range(1, length(han)), lambda i: substr(han, i::INTEGER, 2)), regexp_extract_all(c, '[一-鿿]{{2,6}}')), list_transform(regexp_extract_all(c, '[a-zA-Z0-9]+(?:\\.[a-zA-Z0-9]+)*'), lambda w: lower(w))) AS t FROM len_t)""".replace("\\\\", "\\")
_BM = "WITH " + _TOK.format(k="chunk_id", x="coalesce(content, '')", t="chunks", n="dt") + ", " + _TOK.replace("len_t", "len_q").format(k="case_id", x="question", t="contract WHERE case_id % 20 = 0 AND question IS NOT NULL", n="qt") + """,
    tot AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM dt), ex AS (SELECT chunk_id, len(t) AS dl, unnest(t) AS term FROM dt), tf AS (SELECT chunk_id, dl, term, count(*) AS tf FROM ex GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    q AS (SELECT case_id AS query_id, unnest(t) AS term FROM qt), qm AS (SELECT query_id, term, count(*) AS m FROM q GROUP BY ALL),
    sc AS (SELECT query_id, chunk_id, round(sum(m * ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score FROM qm JOIN tf USING (term) JOIN df USING (term), tot GROUP BY ALL),
    top AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INTEGER AS rank FROM sc QUALIFY rank <= 5)"""
_RULES = sorted(((c, -k, n, p) for k, (n, p, c) in enumerate((n, p, c) for n, ps in legal.INTENTS.items() for p, c in ps)), key=lambda r: (-r[0], -r[1]))
_MD = "md5('42:' || {})"




def _steps() -> str:
    """One column per synonym in nested subqueries, so that the text stays linear."""
    sql = "SELECT case_id, question, question AS e FROM contract WHERE case_id % 20 = 0 AND question IS NOT NULL"
    for t, more in legal.SYNONYMS.items():
        sql = f"SELECT case_id, question, CASE WHEN contains(question, '{t}') THEN replace(e, '{t}', '{t} ({more})') ELSE e END AS e FROM ({sql})"
    return sql


_R = lambda *ws: _like("answer", ws)
_JUDGE = f"CAST(round_even((3 + 3 + CASE WHEN regexp_matches(answer, '{legal.JUDGE_DANGER}') THEN 1 ELSE 4 END + CASE WHEN length(answer) > 500 THEN 5 WHEN length(answer) > 200 THEN 4 WHEN length(answer) < 50 THEN 2 ELSE 3 END + CASE WHEN length(answer) > 100 THEN 5 ELSE 3 END) / 5.0, 0) AS INTEGER)"


def _cover(terms: str, text: str) -> str:
    return f"CASE WHEN len({terms}) = 0 THEN 1.0::DOUBLE ELSE round(len(list_filter({terms}, lambda z: contains({text}, z)))::DOUBLE / len({terms}), 6) END"


SQL = {
    "flagship": _QA.replace("WITH qa", "WITH qa0", 1) + ", qa AS (SELECT * FROM qa0 QUALIFY row_number() OVER (PARTITION BY regexp_replace(lower(question || ' ' || answer), '[^\\p{L}\\p{N}]+', '', 'g') ORDER BY case_id) = 1)" + _SCORE
    + f" SELECT {_CAT} AS category, count(*) AS records, round(avg(score) + 1e-9::DOUBLE, 4) AS mean_difficulty, count_if(score >= 0.6) AS hard FROM scored WHERE {_GOOD} GROUP BY 1",
    "quality_filter": f"{_QA} SELECT case_id FROM qa WHERE {_GOOD}",
    "difficulty": _QA + _SCORE + " SELECT case_id, score, CASE WHEN score >= 0.6 THEN 'hard' WHEN score >= 0.3 THEN 'medium' ELSE 'easy' END AS bucket FROM scored",
    "category": f"{_QA} SELECT case_id, {_CAT} AS category FROM qa",
    "cascade_filter": _CASCADE + " SELECT case_id, reason, flags FROM c",
    "filter_stats": _CASCADE + " SELECT reason, count(*) AS records FROM c GROUP BY reason",
    "fact_rules": _QA + " " + " UNION ALL ".join(f"SELECT case_id, '{n}' AS rule, '{s}' AS severity FROM qa WHERE regexp_matches(question || ' ' || answer, '{p}')" for n, p, s in legal.FACT_RULES),
    "answer_flags": f"{_QA}, {_CITED_TAIL} SELECT case_id, {_DISC} AS disclaimer, regexp_matches(answer, '{_OVER}') AS promise, {_like('question', legal.IN_SCOPE)} AS in_scope, length(answer) >= 80 AND {_DISC} AND NOT regexp_matches(answer, '{_OVER}') AND case_id IN (SELECT case_id FROM cited) AS preference, {_sum('question', legal.GROUNDED_TERMS)} >= 2 AS complex_enough FROM qa",
    "stratified_split": f"{_QA}, r AS (SELECT case_id, row_number() OVER (PARTITION BY department ORDER BY coalesce(difficulty, 0), case_id) AS p, count(*) OVER (PARTITION BY department) AS n FROM qa) SELECT case_id, CASE WHEN p <= floor(n * 0.7::DOUBLE) THEN 'train' WHEN p <= floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'eval' ELSE 'test' END AS split FROM r",
    "random_split": f"WITH r AS (SELECT case_id, row_number() OVER (ORDER BY {_MD.format('case_id')}, case_id) AS p, count(*) OVER () AS n FROM contract) SELECT case_id, CASE WHEN p <= floor(n * 0.8::DOUBLE) THEN 'train' WHEN p <= floor(n * 0.8::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'eval' ELSE 'test' END AS split FROM r",
    "hash_sample": f"SELECT doc_id FROM documents ORDER BY {_MD.format('doc_id')}, doc_id LIMIT 600",
    "expand_query": f"SELECT case_id AS query_id, e AS expanded, CASE WHEN regexp_matches(question, '{'|'.join(legal.SIMPLE)}') THEN 'simple' WHEN regexp_matches(question, '{'|'.join(legal.COMPLEX)}') THEN 'complex' ELSE 'medium' END AS level FROM ({_steps()})",
    "bm25_stats": _BM + " SELECT term, any_value(df) AS df, sum(tf)::BIGINT AS tf FROM tf JOIN df USING (term) GROUP BY term",
    "bm25_topk": _BM + " SELECT query_id, chunk_id, score, rank FROM top",
    "dense_topk": "WITH q AS (SELECT vec_id AS query_id, embedding AS v FROM embeddings WHERE vec_id % 20 = 0) SELECT query_id, vec_id, round(1 / (1 + list_distance(v::DOUBLE[], embedding::DOUBLE[])), 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(1 / (1 + list_distance(v::DOUBLE[], embedding::DOUBLE[])), 6) DESC, vec_id)::INTEGER AS rank FROM q, embeddings QUALIFY rank <= 5",
    "heuristic_rerank": _BM + """ SELECT query_id, chunk_id, round(score * (1 + 0.2::DOUBLE * len(list_filter(regexp_extract_all(question, '[一-鿿]{2,}'), lambda r: contains(content, r)))) * CASE WHEN regexp_matches(content, '法|条例|司法解释|第.{0,4}条') THEN 1.5::DOUBLE ELSE 1 END * CASE WHEN regexp_matches(content, '20[0-9]{2}') THEN 1.1::DOUBLE ELSE 1 END, 4) AS rerank_score
        FROM top JOIN contract ON case_id = query_id JOIN chunks USING (chunk_id)""",
    "input_filter": f"{_QA}, g AS (SELECT case_id, CASE WHEN regexp_matches(question, '{'|'.join(legal.DANGER)}') THEN 'abusive' WHEN regexp_matches(question, '{'|'.join(legal.OUT_OF_SCOPE)}') THEN 'off_topic' WHEN {_like('question', legal.IN_SCOPE)} THEN 'in_scope' ELSE 'off_topic' END AS category FROM qa) SELECT case_id, category = 'in_scope' AS accepted, category, category <> 'in_scope' AS has_reason FROM g",
    "confidence": f"{_QA} SELECT case_id, round(0.15::DOUBLE + 0.2::DOUBLE + CASE WHEN {_R('<分析>', '**', '🔴')} THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN length(answer) > 100 THEN 0.05::DOUBLE ELSE 0 END + CASE WHEN regexp_matches(answer, '{legal.FACT_FORMAT}') THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN length(answer) BETWEEN 150 AND 1000 THEN 0.1::DOUBLE ELSE 0 END, 6) AS confidence FROM qa",
    "to_chatml": f"{_QA} SELECT case_id, sha256('<|im_start|>user' || chr(10) || question || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || answer || '<|im_end|>') AS chatml, length('<|im_start|>user' || chr(10) || question || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || answer || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10))::INTEGER AS prompt_chars FROM qa",
    "chat_pairs": f"{_QA} SELECT case_id, 0 AS pos, 'human' AS speaker, length(question)::INTEGER AS chars FROM qa UNION ALL SELECT case_id, 1, 'gpt', length(answer)::INTEGER FROM qa",
    "history_window": "SELECT event_id, length(string_agg('user: ' || substr(event_type, 1, 200), chr(10)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))::INTEGER AS chars FROM events",
    "loss_mask": f"{_QA} SELECT case_id, least(256, length(question) + length(answer))::INTEGER AS n, least(256, length(question))::INTEGER AS masked, (least(256, length(question)) + least(length(answer), greatest(0, 256 - length(question))))::INTEGER AS labels FROM qa",
    "term_coverage": f"""{_QA}, t AS (SELECT case_id, question, answer, regexp_extract_all(answer, '{legal.ANSWER_TERMS}') AS m, list_distinct(regexp_extract_all(answer, '{legal.ANSWER_TERM_SET}')) AS u, list_filter({list(dict.fromkeys(w for ws in legal.CATEGORIES.values() for w in ws))}, lambda x: contains(question, x)) AS k FROM qa)
        SELECT case_id, {_cover('m', 'question')} AS coverage, {_cover('u', 'question')} AS distinct_coverage, {_cover('k', 'answer')} AS keyword_coverage FROM t""",
    "keypoint_coverage": f"""{_QA}, p AS (SELECT case_id, answer, list_transform(string_split(question, '，'), lambda x: list_filter(regexp_split_to_array(x, '[\\s、]+'), lambda w: w <> '')) AS k FROM qa)
        SELECT case_id, round(len(list_filter(k, lambda w: len(list_filter(w, lambda x: contains(answer, x))) >= 0.4::DOUBLE * greatest(len(w), 1)))::DOUBLE / len(k), 6) AS coverage, {_JUDGE} AS judge, regexp_matches(answer, '{legal.JUDGE_DANGER}') AS has_errors FROM p""",
    "chain_of_thought": f"""{_QA}, c AS (SELECT *, array_to_string(list_slice(regexp_extract_all(answer, '{LOOSE}'), 1, 2), '、') AS basis FROM qa)
        SELECT case_id, CASE WHEN question = '' OR answer = '' THEN answer ELSE '<分析>' || chr(10) || '- 核心问题: ' || substr(question, 1, 60) || chr(10) || '- 法律依据: ' || CASE WHEN basis = '' THEN '请引用相关法条' ELSE basis END || chr(10) || '- 风险/时效: '
            || CASE WHEN contains(answer, '时效') THEN substr(regexp_extract(answer, '[^。；]*时效[^。；]*'), 1, 60) ELSE '请关注相关时效与举证责任' END || chr(10) || '</分析>' || chr(10) || '<建议>' || chr(10) || answer || chr(10) || '</建议>' END AS text FROM c""",
    "case_topk": f"{_QA}, x AS (SELECT case_id, (length(answer) - length(question))::INTEGER AS delta FROM qa) SELECT * FROM (SELECT case_id, delta, 'best' AS side FROM x ORDER BY delta DESC, case_id LIMIT 5) UNION ALL SELECT * FROM (SELECT case_id, delta, 'worst' AS side FROM x ORDER BY delta, case_id LIMIT 5)",
    "token_summary": "SELECT split, count(*) AS records, sum(length(answer))::BIGINT AS chars, round(avg(length(answer)), 4) AS mean_chars FROM contract GROUP BY split",
    "grid_runs": "SELECT n_regionkey::VARCHAR AS name, n_nationkey::VARCHAR AS value, n_regionkey || '-' || n_nationkey AS run, 'pending' AS status FROM nation",
    "intent_route": f"{_QA}, g AS (SELECT case_id, question, CASE " + " ".join(f"WHEN regexp_matches(question, '{p}') THEN '{n}'" for _, _, n, p in _RULES) + " ELSE 'off_topic' END AS intent, CASE " + " ".join(f"WHEN regexp_matches(question, '{p}') THEN {c}::DOUBLE" for c, _, _, p in _RULES)
    + f" ELSE 0.0::DOUBLE END AS confidence FROM qa) SELECT case_id, intent, confidence, CASE intent {' '.join(f'WHEN {k!r} THEN {v!r}' for k, v in legal.INTENT_LABELS.items())} ELSE intent END AS label, regexp_matches(question, '{'|'.join(legal.EMERGENCY)}') AS emergency, NOT regexp_matches(question, '{'|'.join(legal.DANGER + legal.OUT_OF_SCOPE)}') AND {_like('question', legal.IN_SCOPE)} AND intent <> 'off_topic' AS needs_rag, intent = 'criminal' AS refusal FROM g",
}


def _near(sign: str, name: str) -> str:
    d = f"round(1 / (1 + list_distance(list_transform(q.embedding, lambda x: {sign}x::DOUBLE), e.embedding::DOUBLE[])), 6)"
    return f"{name} AS (SELECT q.vec_id AS query_id, e.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY {d} DESC, e.vec_id) AS r FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0 QUALIFY r <= 10)"


_HEAD_CITED = _CITED_TAIL.replace("FROM contract WHERE", "FROM (SELECT case_id, substr(answer, 1, 200) AS answer FROM contract) WHERE").replace("raw AS", "raw_h AS").replace("FROM raw)", "FROM raw_h)").replace("one AS", "one_h AS").replace("FROM one)", "FROM one_h)").replace("parts AS", "parts_h AS").replace("FROM parts ", "FROM parts_h ").replace("cited AS", "cited_h AS")
_EXPANDED = "contract WHERE case_id % 20 = 0 AND question IS NOT NULL"
SQL |= {
    "qa_extract": f"SELECT case_id, CASE WHEN question <> '' AND answer <> '' THEN sha256({_TRIM.format('question')}) END AS q, CASE WHEN question <> '' AND answer <> '' THEN sha256({_TRIM.format('answer')}) END AS a FROM contract",
    "rag_prompt": f"{_QA} SELECT case_id, length('{builders.RAG_INSTRUCTION}' || chr(10) || '{builders.NO_CONTEXT}' || chr(10) || chr(10) || '问题：' || question)::INTEGER AS chars, length({_TRIM.format('answer')})::INTEGER AS bare FROM qa",
    "rrf_fusion": f"""WITH {_near('-', 'a')}, {_near('', 'b')}, u AS (SELECT query_id, vec_id, r, 0 AS f, 0.5::DOUBLE AS w FROM a UNION ALL SELECT query_id, vec_id, r, 1, 1.0::DOUBLE FROM b),
        g AS (SELECT query_id, vec_id, round(sum(w / (60 + r)), 9) AS score, min(f * 1000000 + r) AS o, CASE WHEN min(f) <> max(f) THEN 'hybrid' WHEN min(f) = 0 THEN 'bm25' ELSE 'dense' END AS method FROM u GROUP BY ALL)
        SELECT query_id, vec_id, score, method, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, o)::INTEGER AS rank FROM g QUALIFY rank <= 8""",
    "hybrid_topk": _BM.replace(_EXPANDED, f"(SELECT case_id, e AS question FROM ({_steps()}))") + " SELECT query_id, chunk_id, score, rank, 'bm25' AS method FROM top",
    "eval_rollup": f"""{_QA}, {_CITED_TAIL}, {_HEAD_CITED}, n AS (SELECT case_id, count(*) AS c FROM cited GROUP BY case_id),
        x AS (SELECT department AS grp, (case_id NOT IN (SELECT case_id FROM cited_h) AND {_like('substr(answer, 1, 200)', ('无法', '抱歉', '不能提供', '建议咨询', '超出'))})::INTEGER AS r, coalesce(c, 0) AS c, {_DISC}::INTEGER AS d, regexp_matches(answer, '{_OVER}')::INTEGER AS o FROM qa LEFT JOIN n USING (case_id))
        SELECT grp, grouping(grp)::INTEGER AS is_total, count(*) AS answers, round(avg(r), 4) AS refusal_rate, round(avg((c > 0)::INTEGER), 4) AS cited_rate, round(avg(c), 4) AS density, round(avg(d), 4) AS disclaimer_rate, round(avg(o), 4) AS promise_rate FROM x GROUP BY ROLLUP (grp)""",
    "compare_rollup": f"""{_QA}, m AS (SELECT *, regexp_extract_all(answer, '{legal.ANSWER_TERMS}') AS k FROM qa),
        x AS (SELECT department, {_cover('k', 'question')} AS t, CASE WHEN length(answer) < 50 THEN 0 WHEN length(answer) < 200 THEN 0.5 WHEN length(answer) <= 800 THEN 1 WHEN length(answer) <= 1500 THEN 0.7 ELSE 0.4 END::DOUBLE AS b FROM m),
        g AS (SELECT department, count(*) AS pairs, avg(nullif(b, 0)) AS bm, avg(nullif(t, 0)) AS tm, count_if(t - b > 0.01::DOUBLE) AS wins, count_if(t - b < -0.01::DOUBLE) AS losses, count_if(abs(t - b) <= 0.01::DOUBLE) AS ties, round(avg((t - b > 0.01::DOUBLE)::INTEGER), 4) AS win_rate FROM x GROUP BY department)
        SELECT department, pairs, round(bm, 4) AS base_mean, round(tm, 4) AS tuned_mean, round((tm - bm) / bm * 100, 2) AS improvement, wins, losses, ties, win_rate FROM g""",
}


def _promised(text: str) -> str:
    for phrase in builders.CUT_PHRASES:
        text = f"replace({text}, '{phrase}', '')"
    return f"rtrim({text}, ' ') || '{builders.PROMISE}'"


def _swapped(swap: str, first: str, second: str) -> str:
    return f"CASE WHEN {swap} THEN {second} ELSE {first} END AS {first}, CASE WHEN {swap} THEN {first} ELSE {second} END AS {second}"


_UNSAFE = lambda c: f"(regexp_matches({c}, '{_OVER}') OR NOT {_like(c, legal.DISCLAIMERS)})"
_RED = lambda c: f"(regexp_matches({c}, '{'|'.join(legal.UNSAFE)}') AND NOT regexp_matches({c}, '{'|'.join(legal.SAFE)}'))"
SQL |= {
    "safedpo_transform": f"""{_QA}, x AS (SELECT CASE WHEN case_id % 3 = 0 THEN {_promised('answer')} ELSE answer END AS a, CASE WHEN case_id % 2 = 0 THEN {_promised('answer')} ELSE answer END AS b FROM qa),
        l AS (SELECT {_swapped(f"{_UNSAFE('a')} AND NOT {_UNSAFE('b')}", 'a', 'b')} FROM x),
        y AS (SELECT *, {_UNSAFE('b')}::INTEGER AS u, {_RED('a')} AS ra, {_RED('b')} AS rb FROM l)
        SELECT CASE WHEN ra AND NOT rb THEN 'swap' ELSE 'keep' END AS action, count(*) AS pairs, sum(u)::BIGINT AS unsafe FROM y WHERE NOT (ra AND rb) GROUP BY 1""",
    "context_pack": _BM + """, h AS (SELECT query_id, rank, chr(10) || '--- ' || CASE WHEN coalesce(title, '') <> '' THEN title ELSE '法规' END || ' ---' || chr(10) AS h, coalesce(content, '') AS c FROM top JOIN chunks USING (chunk_id)),
        n AS (SELECT *, sum(length(h) + length(c)) OVER (PARTITION BY query_id ORDER BY rank) AS upto, length(h) + length(c) AS l FROM h),
        p AS (SELECT *, 1200 - (upto - l) - length(h) AS rest FROM n)
        SELECT query_id, '【参考法律法规】' || chr(10) || coalesce(string_agg(CASE WHEN upto <= 1200 THEN h || c WHEN upto - l <= 1200 AND rest > 100 THEN h || substr(c, 1, rest::BIGINT) || '...' END, chr(10) ORDER BY rank), '') AS context FROM p GROUP BY query_id""",
}
