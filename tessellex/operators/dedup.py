"""Exact, near and semantic duplicates with the first record of a group as survivor."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import char_grams, normalize, text_hash
from ..session import cut, kept_table


def exact_dedup(rows: DataFrame, text: Column, seq: str) -> DataFrame:
    """Of equal normalised texts the row of least ``seq``. Map-side minima go over the wire, no texts."""
    hashed = rows.withColumn("_h", text_hash(normalize(F.coalesce(text, F.lit("")))))
    first = hashed.groupBy("_h").agg(F.min(seq).alias(seq)).select(seq)
    return rows.join(first, seq, "left_semi")


def minhash_signature(rows: DataFrame, text: Column, seq: str, perms: int = 128, n: int = 5) -> DataFrame:
    """(seq, sig): minima of md5 hashes seeded 0 to perms - 1 over the grams of the normalised text; zeros without grams.

    Texts are exploded into distinct grams once; all minima come from one aggregation.
    """
    grams = rows.select(F.col(seq), F.explode(F.array_distinct(char_grams(normalize(text), n))).alias("_g"))
    hashes = [F.min(F.conv(F.substring(F.md5(F.concat(F.lit(f"{k}:"), F.col("_g"))), 1, 8), 16, 10).cast("bigint")).alias(f"_m{k}") for k in range(perms)]
    made = grams.groupBy(seq).agg(*hashes).select(seq, F.array(*[f"_m{k}" for k in range(perms)]).alias("sig"))
    return rows.select(seq).join(made, seq, "left").select(seq, F.coalesce("sig", F.array_repeat(F.lit(0).cast("bigint"), perms)).alias("sig"))


def fast_signature(rows: DataFrame, text: Column, seq: str, perms: int = 128, n: int = 5) -> DataFrame:
    """The same with a 64-bit hash of each gram, which an odd factor and a shift of each permutation change, in place of md5: not the same signatures, a fraction of the time.

    Grams stay in their text's row; repeated ones change no minimum.
    """
    factors, shifts = np.random.default_rng(perms).integers(0, 2**64, (2, perms), np.uint64, endpoint=False)
    factors |= np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.zeros((len(batch), perms), np.uint64)
            for i, t in enumerate(batch["_x"].to_pylist()):
                if t is not None and len(t) >= n:
                    made[i] = _minima(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64), factors, shifts, n)
            flat = pa.array(made.view(np.int64).ravel())
            yield pa.RecordBatch.from_arrays([batch["_s"], pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, perms, np.int32), flat)], ["_s", "sig"])

    kind = f"_s {rows.schema[seq].dataType.simpleString()}, sig array<bigint>"
    return rows.select(F.col(seq).alias("_s"), normalize(text).alias("_x")).mapInArrow(run, kind).withColumnRenamed("_s", seq)


def _minima(code: np.ndarray, factors: np.ndarray, shifts: np.ndarray, n: int) -> np.ndarray:
    """The least hash over the runs of n characters for each permutation, 512 runs at a time."""
    h = np.zeros(len(code) - n + 1, np.uint64)
    for j in range(n):
        h = (h ^ code[j : j + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    parts = [(h[at : at + 512, None] * factors + shifts).min(0) for at in range(0, len(h), 512)]
    return parts[0] if len(parts) == 1 else np.min(parts, 0)


def bands(signatures: DataFrame, seq: str, count: int = 16) -> DataFrame:
    """(seq, band): one hash for each of ``count`` equal parts of the signature."""
    width = F.expr(f"size(sig) div {count}")
    keys = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda b: F.concat_ws(":", b.cast("string"), F.array_join(F.slice("sig", b * width + 1, width).cast("array<string>"), ",")))
    return signatures.select(F.col(seq), F.explode(keys).alias("_k")).select(seq, F.xxhash64("_k").alias("band"))


def greedy_survivors(keyed: DataFrame, seq: str, key: str) -> DataFrame:
    """Keys of rows, first come first kept: a row falls if it shares a key with a kept row before it.

    ``keyed`` has a row per (seq, key). In each round the least undecided row of every key is known; a row that
    is least in all of its keys is kept, and rows that share a key with it fall. Keys travel, never pairs,
    so a key that a third of all rows share costs one aggregate. Rounds are bounded by the longest chain.
    """
    pairs = kept_table(keyed.select(F.col(seq).alias("_s"), F.col(key).alias("_k")))
    # A key of one row, or of none as it is null, decides nothing; rows without other keys stay, and only the rest is looked at in rounds.
    shared = pairs.groupBy("_k").agg(F.min("_s").alias("_a"), F.max("_s").alias("_b")).where("_a < _b").select("_k")
    todo = cut(pairs.join(shared, "_k", "left_semi").distinct())
    kept = pairs.where("_s IS NOT NULL").select("_s").distinct().join(todo.select("_s").distinct(), "_s", "left_anti")
    while not todo.isEmpty():
        least = todo.groupBy("_k").agg(F.min("_s").alias("_f"))
        state = todo.join(least, "_k").groupBy("_s").agg(F.min((F.col("_s") == F.col("_f")).cast("int")).alias("_first"))
        winners = cut(state.where("_first = 1").select("_s"))
        kept = kept.unionByName(winners)
        taken = todo.join(winners, "_s", "left_semi").select("_k").distinct()
        fallen = todo.join(taken, "_k", "left_semi").select("_s").distinct()
        todo = cut(todo.join(fallen, "_s", "left_anti"))
    return kept.select(F.col("_s").alias(seq))


def minhash_dedup(rows: DataFrame, text: Column, seq: str, threshold: float = 0.8, perms: int = 128, band_count: int = 16, n: int = 5, fast: bool = False) -> DataFrame:
    """The rows that survive the ordered greedy pass over band collisions.

    ``threshold`` is documentation only, as the bands set it; texts shorter than n characters have equal
    signatures and fall to the first of them.
    """
    signed = (fast_signature if fast else minhash_signature)(rows, text, seq, perms, n)
    return rows.join(greedy_survivors(bands(signed, seq, band_count), seq, "band"), seq, "left_semi")


def semantic_dedup(rows: DataFrame, vector: str, seq: str, threshold: float = 0.9, window: int = 20) -> DataFrame:
    """Drops a row whose vector has a cosine of at least ``threshold`` with one of the last ``window`` kept rows before it.

    Range partitions of the order are walked side by side, each from the last kept vectors of the one before.
    These are known for the first partition only; the others are walked again until what they start from no
    longer changes, which gives the sequential result. Only ``window`` vectors per partition reach the driver. Rows with a null
    vector stay and are compared with none.
    """
    base = rows.select(F.col(seq).alias("_s"), F.col(vector).cast("array<double>").alias("_v")).where("_s IS NOT NULL AND _v IS NOT NULL")
    parts = cut(base.repartitionByRange("_s").sortWithinPartitions("_s"))

    def walk(starts: dict[int, list], todo: set[int] | None):
        """Dropped keys of all partitions, or (``todo``) the last kept vectors of these."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            at = TaskContext.get().partitionId()
            if todo is not None and at not in todo:
                return
            kept = [np.array(v) for v in starts.get(at, [])]
            for batch in batches:
                fallen = []
                for s, v in zip(batch["_s"], batch["_v"]):
                    v = np.asarray(v, dtype=float)
                    if kept and any(len(w) == len(v) and v @ w / (np.linalg.norm(v) * np.linalg.norm(w) + 1e-9) >= threshold for w in kept):
                        fallen.append(s)
                    else:
                        kept = [*kept, v][-window:]
                if todo is None:
                    yield pd.DataFrame({"_s": fallen})
            if todo is not None:
                yield pd.DataFrame({"_p": [at], "_kept": [[w.tolist() for w in kept]]})

        kind = f"_s {parts.schema['_s'].dataType.simpleString()}" if todo is None else "_p int, _kept array<array<double>>"
        return parts.mapInPandas(run, kind)

    count = parts.rdd.getNumPartitions()
    starts: dict[int, list] = {}
    todo = set(range(count - 1))
    while todo:
        ends = {r["_p"]: r["_kept"] for r in walk(starts, todo).collect()}
        changed = {p + 1: kept for p, kept in ends.items() if kept != starts.get(p + 1, [])}
        starts |= changed
        todo = {p for p in changed if p < count - 1}
    dropped = cut(walk(starts, None))
    return rows.join(dropped.withColumnRenamed("_s", seq), seq, "left_anti")


def three_stage(rows: DataFrame, text: Column, seq: str, vector: str | None = None) -> DataFrame:
    """Exact, then near, then semantic duplicates where there are vectors."""
    out = minhash_dedup(exact_dedup(rows, text, seq), text, seq, fast=True)
    return semantic_dedup(out, vector, seq) if vector else out
