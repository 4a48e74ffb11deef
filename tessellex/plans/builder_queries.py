"""Queries on record maps, assembled sets, flags and roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..domain import legal
from ..operators import builders, guard, metrics, quality, statutes
from ..session import table as T
from .corpus_queries import _INDEX
from .record_queries import _DISC, _OVER, _QA, _TRIM, A, Q, _cover, _qa


def law_summary(s: SparkSession, d: str) -> DataFrame:
    rows, _ = statutes.statute_index(T(s, d, "laws"))
    return statutes.law_summary(rows).select("title", F.array_join(F.col("articles").cast("array<string>"), ",").alias("articles"), "n_articles")


def embedding_score(s: SparkSession, d: str) -> DataFrame:
    e = T(s, d, "embeddings").select("vec_id", "embedding")
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(other, "vec_id").select("vec_id", F.round(statutes.embedding_score(F.col("embedding"), F.col("other")), 6).alias("score"))


def law_records(s: SparkSession, d: str) -> DataFrame:
    mirror = T(s, d, "laws").select("title", "type", F.col("publish_date").alias("publish"), F.col("effective_date").alias("effective"), "status", "content", F.col("source_id").alias("id"))
    return builders.law_records(mirror, "mirror", legal.LOCAL_TYPES).groupBy("type").agg(F.count(F.lit(1)).alias("laws"), F.sum(F.length("content")).alias("chars"), F.count_if(F.col("publish_date") == "").alias("undated"))


def question_answer(s: SparkSession, d: str) -> DataFrame:
    rows = T(s, d, "contract").select(F.col("question").alias("input"), F.col("answer").alias("output"), F.col("law_title").alias("reference"))
    return builders.question_answer(rows, "pairs").groupBy(F.size("reference").alias("references")).agg(F.count(F.lit(1)).alias("records"), F.sum(F.length("question") + F.length("answer")).alias("chars"))


def instruction_text(s: SparkSession, d: str) -> DataFrame:
    return T(s, d, "contract").select("case_id", F.sha2(builders.instruction_text(F.col("question"), F.col("law_title")), 256).alias("text"))


def conversations(s: SparkSession, d: str) -> DataFrame:
    rows = T(s, d, "contract").select("case_id", F.col("question").alias("instruction"), F.col("law_title").alias("input"), F.col("answer").alias("output"))
    return builders.conversations(rows).select("case_id", F.length(F.col("conversations")[0]["value"]).alias("asked"), F.length(F.col("conversations")[1]["value"]).alias("told"))


def assemble(s: SparkSession, d: str) -> DataFrame:
    x = _qa(s, d)
    parts = [x.where(f"case_id % 2 = {k}").select("case_id", *builders.message_record(Q(), A(), name, "legal", "")) for k, name in enumerate(("distilled", "grounded"))]
    return builders.assemble(parts, "case_id").select("case_id", "metadata.source", "split")


def gate_counts(s: SparkSession, d: str) -> DataFrame:
    gated = _qa(s, d).withColumn("reason", builders.distill_gate(Q(), A(), F.lit(0))).withColumn("kept", F.col("reason").isNull())
    return builders.record_counts(gated, "kept")


def gate_reasons(s: SparkSession, d: str) -> DataFrame:
    return builders.distil_reasons(_qa(s, d).withColumn("reason", builders.distill_gate(Q(), A(), F.lit(0))))


def comparison_head(s: SparkSession, d: str) -> DataFrame:
    return builders.comparison_table(_qa(s, d).select("case_id", "question", "answer"), "case_id", ("question", "answer"))


def title_mentions(s: SparkSession, d: str) -> DataFrame:
    rows = T(s, d, "contract").where("law_title IS NOT NULL AND answer IS NOT NULL")
    return rows.select("case_id", builders.title_mentions(F.col("answer"), F.array("law_title")).alias("mentions"))


def indicators(s: SparkSession, d: str) -> DataFrame:
    return _qa(s, d).select("case_id", guard.indicator_flags(F.concat(Q(), A())).alias("x"), guard.quick_flags(F.concat(Q(), A())).alias("y")).select("case_id", "x.*", "y.hallucination_count")


def evaluation_rollup(s: SparkSession, d: str) -> DataFrame:
    x = _qa(s, d).select("department", metrics.keyword_coverage(Q(), A()).alias("r"), metrics.term_coverage(A(), Q()).alias("c"), guard.quick_flags(A())["hallucination_count"].alias("f"))
    return metrics.evaluation_rollup(x, "department", "r", "c", "f")


def benchmark_rollup(s: SparkSession, d: str) -> DataFrame:
    x = _qa(s, d).select("department", metrics.keyword_coverage(Q(), A()).alias("c"), F.coalesce("difficulty", F.lit(0.0)).alias("t"), A().alias("a"))
    return metrics.benchmark_rollup(x, "department", "c", "t", "a")


def generation_times(s: SparkSession, d: str) -> DataFrame:
    x = T(s, d, "contract").select("case_id", F.length("question").alias("seconds"))
    return metrics.generation_times(x, T(s, d, "contract").select("case_id", F.length("answer").alias("seconds")), "case_id")


def verified_records(s: SparkSession, d: str) -> DataFrame:
    return T(s, d, "contract").where(quality.verified(F.col("difficulty") < 0.5, F.col("answer"))).select("case_id")


QUERIES = {f.__name__: f for f in (
    law_summary, embedding_score, law_records, question_answer, instruction_text, conversations, assemble, gate_counts, gate_reasons, comparison_head, title_mentions, indicators, evaluation_rollup, benchmark_rollup, generation_times, verified_records,
)}

_T = lambda c: _TRIM.format(f"coalesce({c}, '')")
_WORDS = list(dict.fromkeys(w for ws in legal.CATEGORIES.values() for w in ws))
_GATE = f"g AS (SELECT case_id, CASE WHEN NOT {_DISC} THEN 'no_disclaimer' WHEN regexp_matches(question || ' ' || answer, '{_OVER}') THEN 'overpromise' END AS reason FROM qa)"
_BOTH = "(question || answer)"
_FLAG = lambda p, t: f"regexp_matches({t}, '{p}')"
_COUNT = lambda flags, t: " + ".join(f"{_FLAG(p, t)}::INTEGER" for _, p in flags)
_COVERED = f"v AS (SELECT *, list_filter({_WORDS}, lambda x: contains(question, x)) AS k, regexp_extract_all(answer, '{legal.ANSWER_TERMS}') AS m FROM qa)"
SQL = {
    "law_summary": _INDEX + " SELECT title, string_agg(article::VARCHAR, ',' ORDER BY article) AS articles, count(*)::INTEGER AS n_articles FROM idx GROUP BY title",
    "embedding_score": "SELECT a.vec_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])) + 1e-9::DOUBLE), 6) AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
    "law_records": f"SELECT {_T('type')} AS type, count(*) AS laws, sum(length(content))::BIGINT AS chars, count_if(coalesce(publish_date, '') = '') AS undated FROM laws WHERE {_T('title')} <> '' AND coalesce(content, '') <> '' AND {_T('type')} NOT IN ({', '.join(repr(t) for t in legal.LOCAL_TYPES)}) GROUP BY 1",
    "question_answer": f"SELECT (law_title IS NOT NULL)::INTEGER AS references, count(*) AS records, sum(length({_T('question')}) + length({_T('answer')}))::BIGINT AS chars FROM contract WHERE {_T('question')} <> '' AND {_T('answer')} <> '' GROUP BY 1".replace(" AS references", ' AS "references"'),
    "instruction_text": f"SELECT case_id, sha256({_T('question')} || CASE WHEN {_T('law_title')} <> '' THEN chr(10) || {_T('law_title')} ELSE '' END) AS text FROM contract",
    "conversations": "SELECT case_id, length(coalesce(law_title, question))::INTEGER AS asked, length(answer)::INTEGER AS told FROM contract WHERE coalesce(law_title, question) IS NOT NULL AND answer IS NOT NULL",
    "assemble": f"{_QA}, u AS (SELECT min(case_id) AS case_id FROM qa GROUP BY regexp_replace(lower(question || answer), '[^\\p{{L}}\\p{{N}}]+', '', 'g')), r AS (SELECT case_id, row_number() OVER (ORDER BY md5('42:' || case_id), case_id) AS p, count(*) OVER () AS n FROM u) SELECT case_id, CASE WHEN case_id % 2 = 0 THEN 'distilled' ELSE 'grounded' END AS source, CASE WHEN p <= floor(n * 0.8::DOUBLE) THEN 'train' WHEN p <= floor(n * 0.8::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'eval' ELSE 'test' END AS split FROM r",
    "gate_counts": f"{_QA}, {_GATE} SELECT count(*) AS records, count_if(reason IS NULL) AS kept, count_if(reason IS NOT NULL) AS not_kept FROM g",
    "gate_reasons": f"{_QA}, {_GATE} SELECT reason, count(*) AS pairs FROM g WHERE reason IS NOT NULL GROUP BY reason",
    "comparison_head": f"{_QA} SELECT case_id, substr(question, 1, 200) AS question, substr(answer, 1, 200) AS answer FROM qa ORDER BY case_id LIMIT 30",
    "title_mentions": "SELECT case_id, ((length(answer) - length(replace(answer, '《' || substr(law_title, 1, 6), ''))) / length('《' || substr(law_title, 1, 6)))::INTEGER AS mentions FROM contract WHERE law_title IS NOT NULL AND answer IS NOT NULL",
    "indicators": f"{_QA} SELECT case_id, {', '.join(f'{_FLAG(p, _BOTH)} AS {n}' for n, p in legal.INDICATORS)}, round(({_COUNT(legal.INDICATORS, _BOTH)}) / 5.0::DOUBLE, 6) AS score, {_COUNT(legal.QUICK_FLAGS, _BOTH)} AS hallucination_count FROM qa",
    "evaluation_rollup": f"""{_QA}, {_COVERED}, x AS (SELECT department AS grp, {_cover('k', 'answer')} AS r, {_cover('m', 'question')} AS c, {_COUNT(legal.QUICK_FLAGS, 'answer')} AS f FROM v)
        SELECT grp, grouping(grp)::INTEGER AS is_total, count(*) AS answers, round(avg(r), 4) AS mean_rouge, round(avg(c), 4) AS mean_coverage, sum(f)::BIGINT AS flags, round(avg(f), 4) AS flag_rate, count_if(r > 0.5::DOUBLE) AS wins, count_if(r < 0.3::DOUBLE) AS losses, count_if(r BETWEEN 0.3::DOUBLE AND 0.5::DOUBLE) AS ties, round(avg((r > 0.5::DOUBLE)::INTEGER), 3) AS win_rate FROM x GROUP BY ROLLUP (grp)""",
    "benchmark_rollup": f"""{_QA}, {_COVERED}, x AS (SELECT department, {_cover('k', 'answer')} AS c, coalesce(difficulty, 0) AS t, regexp_matches(answer, '{"|".join(legal.BENCHMARK_DANGERS)}')::INTEGER AS b FROM v)
        SELECT department, count(*) AS answers, round(avg(c), 4) AS mean_coverage, round(avg(t), 4) AS mean_seconds, sum(b)::BIGINT AS safety_failures, round(1 - avg(b), 4) AS safety_rate FROM x GROUP BY department""",
    "generation_times": "SELECT count(*) AS questions, round(avg(length(question)), 4) AS base_seconds, round(avg(length(answer)), 4) AS tuned_seconds FROM contract",
    "verified_records": "SELECT case_id FROM contract WHERE difficulty < 0.5::DOUBLE AND coalesce(answer, '') <> ''",
}
