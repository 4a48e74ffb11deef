"""Lexical, dense and fused retrieval."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..domain import legal
from ..functions.text import tokens
from ..session import kept_table
from .chunking import sentence_chunks

#: A set of queries is broadcast up to so many term rows; beyond it the join shuffles.
MAX_BROADCAST_TERMS = 200_000
#: Terms of documents that are scored together, and weights of queries that meet them at once.
BLOCK_TOKENS, BLOCK_WEIGHTS = 4_000_000, 500_000


def expand(query: Column, synonyms: dict[str, str] = legal.SYNONYMS) -> Column:
    """Each synonym that the original query has is put behind its term in the query as it is by then."""
    out = query
    for term, more in synonyms.items():
        # An empty search replaces nothing, so the expression grows by one node a term.
        out = F.replace(out, F.when(F.contains(query, F.lit(term)), term).otherwise(""), F.lit(f"{term} ({more})"))
    return out


def complexity(query: Column) -> Column:
    """R2: 'simple', 'complex' or 'medium', by the first pattern that matches."""
    simple, hard = "|".join(legal.SIMPLE), "|".join(legal.COMPLEX)
    return F.when(query.rlike(simple), "simple").when(query.rlike(hard), "complex").otherwise("medium")


def bm25_index(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(postings, totals). postings(key, term, tf, dl, df), totals(docs, avgdl): documents without terms count too."""
    terms = docs.select(F.col(key).alias("_k"), tokens(F.coalesce(F.col(text), F.lit(""))).alias("_t")).withColumn("dl", F.size("_t"))
    totals = terms.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.avg("dl"), F.lit(1.0)).alias("avgdl"))
    tf = terms.select("_k", "dl", F.explode("_t").alias("term")).groupBy("_k", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return tf.join(df, "term").withColumnRenamed("_k", key), totals


def bm25(queries: DataFrame, docs: DataFrame, key: str, text: str, k: int = 5, query_key: str = "query_id", query: str = "query", k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query_key, key, score, rank) of the k best; repeated query terms count each time; ties by key.

    Only documents with a term of the query are scored; those of score 0 do not fill the rest. Scores never travel:
    documents lie in blocks of about ``BLOCK_TOKENS`` terms by key, queries (``BLOCK_WEIGHTS`` weights at once) are
    broadcast to them, and of each block the k best per query go on. Rows of one key add up, as one document has it.
    """
    asked = queries.select(F.col(query_key).alias("_q"), F.explode(tokens(F.col(query))).alias("term")).groupBy("_q", "term").agg(F.count(F.lit(1)).alias("_m"))
    wanted = asked.select("term").distinct()
    size = wanted.limit(MAX_BROADCAST_TERMS + 1).count()
    small = (lambda d: F.broadcast(d)) if size <= MAX_BROADCAST_TERMS else (lambda d: d)
    terms = docs.select(F.col(key).alias("_k"), tokens(F.coalesce(F.col(text), F.lit(""))).alias("_t")).withColumn("_dl", F.size("_t"))
    n, avgdl, keys = terms.agg(F.count(F.lit(1)), F.coalesce(F.avg("_dl"), F.lit(1.0)), F.count_distinct("_k")).first()
    avgdl, merged = max(avgdl, 1e-9), keys < n
    one = F.flatten(F.collect_list("_t")).alias("_t")
    df = (terms.groupBy("_k", "_dl").agg(one) if merged else terms).select(F.explode(F.array_distinct("_t")).alias("term"))
    df = df.join(small(wanted), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("_df"))
    idf = F.log((F.lit(n) - F.col("_df") + 0.5) / (F.col("_df") + 0.5) + 1)
    weighed = kept_table(asked.join(small(df), "term").select("_q", "term", (idf * F.col("_m")).alias("_w")))
    context = queries.sparkSession.sparkContext
    spread = max(1, int(n * avgdl) // BLOCK_TOKENS + 1, min(context.defaultParallelism, int(n * avgdl) // (BLOCK_TOKENS // 20)))
    # Texts travel, not their terms; all rows of a key meet in one block.
    placed = docs.select(F.col(key).alias("_k"), F.coalesce(F.col(text), F.lit("")).alias("_x")).repartition(spread, "_k")
    placed = placed.select("_k", tokens(F.col("_x")).alias("_t")).withColumn("_dl", F.size("_t"))
    placed = (placed.groupBy("_k", "_dl").agg(one) if merged else placed).select("_k", "_dl", "_t")
    count = max(1, -(-weighed.count() // BLOCK_WEIGHTS))
    schema = f"_q {asked.schema['_q'].dataType.simpleString()}, _k {placed.schema['_k'].dataType.simpleString()}, score double"

    def best(i: int) -> DataFrame:
        shared = context.broadcast(_weights(weighed.where(F.pmod(F.xxhash64("_q"), F.lit(count)) == i).toArrow()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from _lexical(batches, *shared.value, avgdl, k, k1, b)

        return placed.mapInArrow(run, schema)

    scored = reduce(DataFrame.unionByName, map(best, range(count))).withColumnRenamed("_q", query_key)
    return _top(scored, query_key, "_k", k).select(query_key, F.col("_k").alias(key), "score", "rank")


def _weights(rows: pa.Table) -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Queries, their terms, and by query: the start of its weights, their terms' numbers and the weights."""
    asked, named = (rows[c].combine_chunks().dictionary_encode(null_encoding="encode") for c in ("_q", "term"))
    q, t = asked.indices.to_numpy(), named.indices.to_numpy()
    order = np.lexsort((t, q))
    return asked.dictionary, named.dictionary, np.searchsorted(q[order], np.arange(len(asked.dictionary) + 1)), t[order], rows["_w"].to_numpy()[order]


def _lexical(batches: Iterator[pa.RecordBatch], asked: pa.Array, named: pa.Array, starts: np.ndarray, terms: np.ndarray, weights: np.ndarray, avgdl: float, k: int, k1: float, b: float) -> Iterator[pa.RecordBatch]:
    """The k best documents of a block (_k, _dl, _t) for each query."""
    keys, lengths, rows, found, seen = [], [], [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0
    for batch in batches:
        of = pc.index_in(batch["_t"].flatten(), value_set=named)
        here = np.repeat(np.arange(seen, seen + len(batch)), pc.list_value_length(batch["_t"]).to_numpy(zero_copy_only=False))
        held = of.is_valid().to_numpy(zero_copy_only=False)
        rows.append(here[held])
        found.append(of.drop_null().to_numpy().astype(np.int64))
        keys.append(batch["_k"])
        lengths.append(batch["_dl"].to_numpy())
        seen += len(batch)
    if not seen:
        return
    owners = pa.chunked_array(keys).combine_chunks().dictionary_encode(null_encoding="encode")
    place = np.empty(len(owners.dictionary), np.int64)
    place[pc.array_sort_indices(owners.dictionary, null_placement="at_start").to_numpy()] = np.arange(len(place))
    pairs, tf = np.unique(np.concatenate(found) * seen + np.concatenate(rows), return_counts=True)
    first = np.searchsorted(pairs, np.arange(len(named) + 1) * seen)
    row = pairs % seen
    part = tf * (k1 + 1) / (tf + k1 * (1 - b + b * np.concatenate(lengths)[row] / avgdl))
    doc = owners.indices.to_numpy().astype(np.int64)[row]
    lo, hi, wide = first[:-1], first[1:], -(-len(place) // 64) * 64
    del keys, lengths, rows, found, pairs, tf, row
    for at in range(0, len(asked), 4096):
        out_q, out_k, out_s = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
        for q in range(at, min(at + 4096, len(asked))):
            t = terms[starts[q] : starts[q + 1]]
            spans = [(x, y, w) for x, y, w in zip(lo[t].tolist(), hi[t].tolist(), weights[starts[q] : starts[q + 1]].tolist()) if x < y]
            if not spans:
                continue
            sums = np.bincount(np.concatenate([doc[x:y] for x, y, _ in spans]), np.concatenate([part[x:y] * w for x, y, w in spans]), wide)
            # Of 64 documents each the best one: the k-th of these is no better than the k-th of all. Rounding may lift by 1e-6.
            tops = sums.reshape(64, -1).max(0)
            limit = np.partition(tops, -k)[-k] if len(tops) >= k else 0.0
            near = np.flatnonzero(sums >= limit - 2e-6) if limit > 2e-6 else np.flatnonzero(sums)
            score = np.round(sums[near], 6)
            chosen = np.lexsort((place[near], -score))[:k]
            out_q.append(np.full(len(chosen), q))
            out_k.append(near[chosen])
            out_s.append(score[chosen])
        yield pa.RecordBatch.from_arrays([asked.take(pa.array(np.concatenate(out_q))), owners.dictionary.take(pa.array(np.concatenate(out_k))), pa.array(np.concatenate(out_s))], ["_q", "_k", "score"])


def _top(scored: DataFrame, group: str, key: str, k: int) -> DataFrame:
    """The k best by score, ties by key; Spark keeps k rows per group on the map side already."""
    order = Window.partitionBy(group).orderBy(F.col("score").desc(), F.col(key))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def dense(queries: DataFrame, vectors: DataFrame, key: str, vector: str, k: int = 5, query_key: str = "query_id", query: str = "vector", block: int = 5000) -> DataFrame:
    """(query_key, key, score, rank), score 1 / (1 + Euclidean distance), exact over all vectors.

    Queries go against all vectors in blocks of about ``block``, however many there are: a block is broadcast once,
    and each batch of vectors meets it in a matrix product, of which the k best per query go on. Null vectors
    and those of another length than the query's meet nothing.
    """
    asked = queries.select(F.col(query_key).alias("q"), F.col(query).cast("array<double>").alias("v")).where("v IS NOT NULL")
    base = vectors.select(F.col(key).alias("_k"), F.col(vector).cast("array<double>").alias("_v")).where("_v IS NOT NULL")
    count = max(1, -(-asked.count() // block))
    schema = f"`{query_key}` {asked.schema['q'].dataType.simpleString()}, _k {base.schema['_k'].dataType.simpleString()}, score double"

    def best(i: int) -> DataFrame:
        rows = asked.where(F.pmod(F.xxhash64("q"), F.lit(count)) == i).collect()  # about ``block`` vectors
        shared = queries.sparkSession.sparkContext.broadcast([(r["q"], r["v"]) for r in rows])

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            by_length: dict[int, list] = {}
            for q, v in shared.value:
                by_length.setdefault(len(v), []).append((q, v))
            sides = {n: ([q for q, _ in x], np.array([v for _, v in x], dtype=float).reshape(len(x), n)) for n, x in by_length.items()}
            for batch in batches:
                sizes = batch["_v"].map(len)
                for n, (names, wanted) in sides.items():
                    part = batch[sizes == n]
                    if len(part):
                        yield from _nearest(names, wanted, part["_k"].to_numpy(), np.stack(part["_v"].to_list()).reshape(len(part), n), k, query_key)

        return _top(base.mapInPandas(run, schema), query_key, "_k", k)

    return reduce(DataFrame.unionByName, map(best, range(count))).withColumnRenamed("_k", key)


def _nearest(names: list, wanted: np.ndarray, keys: np.ndarray, known: np.ndarray, k: int, query_key: str, rows: int = 256) -> Iterator[pd.DataFrame]:
    """The k best of a batch for each query; products find what can be among them, plain differences decide."""
    squares = (known * known).sum(1)
    for at in range(0, len(names), rows):
        some = wanted[at : at + rows]
        far = np.maximum((some * some).sum(1)[:, None] + squares[None, :] - 2 * some @ known.T, 0)
        out_q, out_k, out_s = [], [], []
        for i, d in enumerate(far):
            limit = np.partition(d, k - 1)[k - 1] if len(d) > k else d.max()
            near = np.flatnonzero(np.sqrt(d) <= np.sqrt(limit) + 1e-5 * (1 + np.sqrt(limit)) ** 2)
            score = np.round(1 / (1 + np.sqrt(((known[near] - some[i]) ** 2).sum(1))), 6)
            first = np.lexsort((keys[near], -score))[:k]
            out_q += [names[at + i]] * len(first)
            out_k += keys[near][first].tolist()
            out_s += score[first].tolist()
        yield pd.DataFrame({query_key: out_q, "_k": out_k, "score": out_s})


def fuse(lexical: DataFrame, dense_hits: DataFrame, key: str = "content", k: int = 5, query_key: str = "query_id", constant: int = 60, weights: tuple[float, float] = (0.5, 1.0)) -> DataFrame:
    """Weighted reciprocal rank fusion on ``key``: sum of weight / (constant + rank), rank from 1; method bm25, dense or hybrid; ties by the order of first appearance."""
    a = lexical.select(query_key, key, F.lit(weights[0]).alias("_w"), "rank", F.lit(0).alias("_from"))
    b = dense_hits.select(query_key, key, F.lit(weights[1]).alias("_w"), "rank", F.lit(1).alias("_from"))
    merged = a.unionByName(b).where(F.col(key).isNotNull())
    merged = merged.groupBy(query_key, key).agg(
        F.round(F.sum(F.col("_w") / (constant + F.col("rank"))), 9).alias("score"), F.min(F.col("_from") * 1_000_000 + F.col("rank")).alias("_first"),
        F.when(F.min("_from") != F.max("_from"), "hybrid").when(F.min("_from") == 0, "bm25").otherwise("dense").alias("method"),
    )
    order = Window.partitionBy(query_key).orderBy(F.col("score").desc(), "_first")
    return merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("_first")


def rerank(hits: DataFrame, query: Column, content: Column) -> DataFrame:
    """Adds rerank_score: score x (1 + 0.2 per run of ideographs of the query in the text, repeated runs each) x 1.5 for legal terms x 1.1 for a year of this century."""
    runs = F.regexp_extract_all(query, F.lit("[一-鿿]{2,}"), F.lit(0))
    matched = F.size(F.filter(runs, lambda r: F.contains(content, r)))
    law = F.when(content.rlike(legal.LAW_MARKS), 1.5).otherwise(1.0)
    year = F.when(content.rlike("20[0-9]{2}"), 1.1).otherwise(1.0)
    # Rounded as the double is, not as the decimal that it prints as.
    return hits.withColumn("rerank_score", F.round(F.col("score") * (1 + 0.2 * matched) * law * year * 10_000) / 10_000)


def bm25_indexed(queries: DataFrame, postings: DataFrame, totals: DataFrame, key: str, k: int = 5, query_key: str = "query_id", query: str = "query", k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """R4 on a written index (S14): only the queries' terms are read of it, and no text."""
    n, avgdl = totals.first()
    asked = queries.select(query_key, F.explode(tokens(F.col(query))).alias("term")).groupBy(query_key, "term").agg(F.count(F.lit(1)).alias("_m"))
    met = asked.join(postings, "term")
    idf = F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = F.col("_m") * idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(max(avgdl, 1e-9))))
    return _top(met.groupBy(query_key, key).agg(F.round(F.sum(part), 6).alias("score")), query_key, key, k)


def hybrid(
    queries: DataFrame, docs: DataFrame, key: str, text: str, vectors: DataFrame | None = None, k: int = 5, force: bool = False, reranker: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """Simple queries are left out (unless forced), others expanded, searched twice as deep, fused and cut to k; fused hits of complex ones are reranked first.

    ``queries`` has query_id, query and, for dense search, vector; ``vectors`` key and embedding. ``reranker`` (R7)
    gets hits with query and content and adds rerank_score; without one the heuristic decides.
    """
    gated = queries.withColumn("_level", complexity(F.col("query")))
    asked = gated if force else gated.where("_level <> 'simple'")
    wide = asked.withColumn("query", expand(F.col("query")))
    lexical = bm25(wide, docs, key, text, 2 * k)
    if vectors is None:
        return lexical.where(F.col("rank") <= k).withColumn("method", F.lit("bm25"))
    fused = fuse(lexical, dense(wide, vectors, key, "embedding", 2 * k), key, 2 * k)
    hits = fused.join(asked.select("query_id", "query", "_level"), "query_id")
    plain = hits.where("_level <> 'complex' AND rank <= " + str(k)).select(*fused.columns)
    hard = hits.where("_level = 'complex'").join(docs.select(F.col(key), F.col(text).alias("content")), key)
    scored = reranker(hard) if reranker else rerank(hard, F.col("query"), F.col("content"))
    order = Window.partitionBy("query_id").orderBy(F.col("rerank_score").desc(), "rank")
    again = scored.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).withColumns({"score": F.col("rerank_score"), "rank": F.col("_r")})
    return plain.unionByName(again.select(*fused.columns))


def document_search(questions: DataFrame, documents: DataFrame, key: str, text: str, k: int = 3, width: int = 512, overlap: int = 128) -> DataFrame:
    """(query_id, key, chunk_no, content, rank) of the k best chunks of given documents: no synonyms, no query left out, all hits reranked."""
    parts = documents.select(F.col(key), F.posexplode(sentence_chunks(F.coalesce(F.col(text), F.lit("")), width, overlap)).alias("chunk_no", "content"))
    parts = parts.withColumn("_c", F.xxhash64(key, "chunk_no"))
    hits = bm25(questions, parts, "_c", "content", 2 * k).join(parts, "_c").join(questions.select("query_id", "query"), "query_id")
    order = Window.partitionBy("query_id").orderBy(F.col("rerank_score").desc(), "rank")
    best = rerank(hits, F.col("query"), F.col("content")).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k)
    return best.select("query_id", key, "chunk_no", "content", F.col("_r").alias("rank"))
