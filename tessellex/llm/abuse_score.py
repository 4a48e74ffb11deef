"""Problem 8: a score for abusive, hateful or sexual content of every document.

A document is read passage by passage (clauses, and windows of long ones), since an insult may stand in one
line of a long harmless text. A passage's score comes from its nearest labelled passages by exact cosine
of TF-IDF vectors of short runs of characters and words: neighbours vote with the square of their
similarity. The labelled passages stand in an inverted index: each run knows the passages it is in and its
weight there. Passages whose bound is under the least similarity that counts are passed over before the
index is asked, without changing any result.

Labels belong to whole documents, so most passages of a bad document are harmless. Each passage of a
bad document therefore carries only the weight that its own neighbours give it: how much nearer it is to
passages of other bad documents than to those of good ones, a passage in several counting for each. The
document's raw score is its worst passage's; isotonic regression on the labelled documents, each scored
without passages of its own alone, turns raw scores into shares of bad documents. Weights of passages that a
document shares with others still hold its own label, so that the shares are somewhat too sure.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import pairwise, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut, table
from .one_form import latin_look, same_codes

#: The model is fitted on at most so many labelled documents (by hash order if there are more).
MAX_LABELLED = 20_000
#: Characters of labelled text that the driver reads at most; documents beyond it, in hash order, are left out of the fit.
MAX_LABELLED_CHARS = 100_000_000
#: A window's length in units and the step between windows; longer clauses are read in windows.
WINDOW, STEP = 12, 6
#: Least cosine of a neighbour, neighbours that vote.
NEAR, NEIGHBOURS = 0.32, 12
#: Calibrated score from which a document is a case.
CASE = 0.5

_CLAUSE = re.compile(r"[。！？!?；;，,：:\n~～…]+")
_UNIT = re.compile(r"[a-zà-öø-ÿ]+|[0-9]+|[^\W_0-9a-zà-öø-ÿ]|\*")


def passages(text: str) -> list[tuple[str, ...]]:
    """The units of each passage: ideographs and other letters singly, words, numbers as one sign, masks.

    Marks and blanks inside a clause fall away, so that letters set apart by them stand side by side again.
    """
    return [p for units in _clauses(text) for p in _windows(units)]


def _clauses(text: str) -> Iterator[list[str]]:
    for clause in _CLAUSE.split(text):
        units = _UNIT.findall(clause)
        if not "".join(units).isalpha():
            units = ["0" if u[0].isdigit() else u for u in units]
        yield units


def _windows(units: list[str]) -> list[tuple[str, ...]]:
    """The passages of one clause."""
    if len(units) < 2:
        return [tuple(units)] if units and units[0].isalpha() and len(units[0]) > 2 else []
    if len(units) <= WINDOW + 2:
        return [tuple(units)]
    return [tuple(units[k : k + WINDOW]) for k in range(0, len(units) - STEP, STEP)]


def runs(units: tuple[str, ...]) -> list[str]:
    """Runs of two and three units, and single words."""
    pairs = [a + " " + b for a, b in pairwise(units)]
    return pairs + [p + " " + c for p, c in zip(pairs, units[2:])] + [u for u in units if len(u) > 2]


class Model:
    """Labelled passages in blocks, with their weights and the calibration."""

    def __init__(self, documents: list[tuple[str, int]]) -> None:
        """``documents``: (text in one form, label 0 or 1)."""
        where: dict[tuple, list[int]] = defaultdict(list)
        for d, (text, _) in enumerate(documents):
            for p in set(passages(text)):
                where[p].append(d)
        labels = np.array([y for _, y in documents], dtype=bool)
        bad_of = {p: [d for d in ds if labels[d]] for p, ds in where.items()}
        # Passages of bad documents first.
        keys = sorted(where, key=lambda p: (not bad_of[p], p))
        n = len(keys)
        self.terms: dict[str, int] = {}
        ids = [np.array(sorted({self.terms.setdefault(g, len(self.terms)) for g in runs(p)}), np.int32) for p in keys]
        term = np.concatenate([np.zeros(0, np.int32), *ids])
        df = np.bincount(term, minlength=len(self.terms))
        self.idf = (np.log((n + 1) / (df + 1)) + 1).astype(np.float32)
        self.unseen = float(np.log(n + 1) + 1)
        rows = [self._weighed(x) for x in ids]
        value = np.concatenate([np.zeros(0, np.float32), *(w for _, w in rows)]).astype(np.float32)
        owner = np.repeat(np.arange(n), [len(x) for x in ids])
        # Postings: for every run the passages it is in and its weights there.
        order = np.argsort(term, kind="stable")
        self.row, self.value = owner[order].astype(np.int32), value[order]
        self.at = np.searchsorted(term[order], np.arange(len(self.terms) + 1))
        self.bad_docs = [len(bad_of[p]) for p in keys]
        self.good_docs = np.array([len(where[p]) - len(bad_of[p]) for p in keys], dtype=np.float32)
        bad_rows = sum(1 for b in self.bad_docs if b)
        self.bad = np.zeros(n, np.float32)
        weight = np.zeros(n, np.float32)
        for k in range(bad_rows):
            if self.good_docs[k] >= self.bad_docs[k]:  # as common in good documents: of no weight
                continue
            ids, sims = self._near(rows[k], 0.8 * NEAR)
            own = len(bad_of[keys[k]])
            power = sims.astype(np.float64) ** 2
            near_bad = np.array([len(set(bad_of[keys[j]]).difference(bad_of[keys[k]])) if self.bad_docs[j] and j != k else 0 for j in ids.tolist()], np.float64)
            plus, minus = float((power * near_bad).sum()) + own - 1, float((power * self.good_docs[ids]).sum())
            weight[k] = (plus + 0.05) / (plus + minus + 0.1)
        self.bad = np.where(weight >= 0.5, weight, 0).astype(np.float32)
        # The most that any bad passage of weight can add to a cosine, by run.
        self.reach = np.zeros(len(self.terms), np.float32)
        of_weight = self.bad[owner] > 0
        np.maximum.at(self.reach, term[of_weight], value[of_weight])
        self.reach_of = {g: float(self.reach[k] * self.idf[k]) for g, k in self.terms.items() if self.reach[k] > 0}
        rows_of_weight = np.flatnonzero(self.bad > 0)
        self.bad_count = len(rows_of_weight)
        lists: dict[int, tuple[list, list]] = defaultdict(lambda: ([], []))
        for place, k in enumerate(rows_of_weight.tolist()):
            for t, x in zip(rows[k][0].tolist(), rows[k][1].tolist()):
                lists[t][0].append(place)
                lists[t][1].append(x)
        self.bad_postings = {t: (np.array(a, np.int32), np.array(b, np.float32)) for t, (a, b) in lists.items()}
        self._facts()
        self.steps = [(0.0, 0.0)]
        members = defaultdict(set)
        for k, p in enumerate(keys):
            if len(where[p]) == 1:  # others' copies of a passage speak for themselves
                members[where[p][0]].add(k)
        raw = [(self.raw(text, members[d])[0], int(y)) for d, (text, y) in enumerate(documents)]
        self.loo = raw
        self.steps = isotonic(raw)
        del self.bad_docs

    def _vector(self, units: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
        """(terms, weights) of length one; runs the model doesn't know count in the length only."""
        known, other, seen = [], 0, set()
        for g in runs(units):
            if g not in seen:
                seen.add(g)
                k = self.terms.get(g)
                if k is None:
                    other += 1
                else:
                    known.append(k)
        return self._weighed(np.array(sorted(known), dtype=np.int32), other)

    def _weighed(self, ids: np.ndarray, other: int = 0) -> tuple[np.ndarray, np.ndarray]:
        w = self.idf[ids]
        norm = float(np.sqrt(np.dot(w, w) + other * self.unseen**2)) or 1.0
        return ids, w / norm

    def _near(self, vector: tuple[np.ndarray, np.ndarray], least: float = NEAR) -> tuple[np.ndarray, np.ndarray]:
        """All labelled passages of at least that cosine, and their cosines."""
        ids, w = vector
        if not len(ids):
            return np.zeros(0, np.int64), np.zeros(0, np.float32)
        spans = list(zip(self.at[ids].tolist(), self.at[ids + 1].tolist(), w))
        sums = np.bincount(np.concatenate([self.row[a:b] for a, b, _ in spans]), np.concatenate([self.value[a:b] * x for a, b, x in spans]), len(self.bad))
        found = np.flatnonzero(sums >= least)
        return found, sums[found].astype(np.float32)

    def _near_bad(self, vector: tuple[np.ndarray, np.ndarray]) -> bool:
        """Whether a bad passage of weight has at least the cosine that counts; from the postings of those alone."""
        sims = np.zeros(self.bad_count, np.float32)
        for t, x in zip(vector[0].tolist(), vector[1].tolist()):
            found = self.bad_postings.get(t)
            if found is not None:
                sims[found[0]] += found[1] * np.float32(x)
        return bool(self.bad_count and sims.max() >= NEAR - 1e-5)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("_seen", "loo", "reach", "square_of", "reach_words", "reach_pairs", "pair_reach", "pair_square")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ = state
        self._facts()

    def _facts(self) -> None:
        """What the bounds look up: squares of weights, and for pairs the most that they and runs of three from them add."""
        self.square_of = {g: float(self.idf[k]) ** 2 for g, k in self.terms.items()}
        self.reach_words = {g for g in self.reach_of if " " not in g}
        most: dict[str, float] = defaultdict(float)
        for g, x in self.reach_of.items():
            if g.count(" ") == 2:
                pair = g.rsplit(" ", 1)[0]
                most[pair] = max(most[pair], x)
        # Pairs as tuples, as they come from a passage without making a string of each.
        self.pair_square = {tuple(g.split(" ")): x for g, x in self.square_of.items() if g.count(" ") == 1}
        self.pair_reach = {p: x for p in self.pair_square if (x := self.reach_of.get(" ".join(p), 0.0) + most.get(" ".join(p), 0.0))}
        self.reach_pairs = set(self.pair_reach)

    def passage(self, units: tuple[str, ...], without: set[int] | None = None) -> float:
        """The vote of a passage's neighbours, 0 to 1; 0 if no bad passage of weight is near."""
        # A first bound from pairs alone: a run of three weighs no less than the pair it begins with, and adds at
        # most what the best of those that begin so adds.
        pairs = set(pairwise(units))
        reach = self.reach_of
        hit = sum(map(self.pair_reach.__getitem__, pairs & self.reach_pairs)) + sum(map(reach.__getitem__, self.reach_words.intersection(units)))
        if not hit:
            return 0.0
        other = self.unseen * self.unseen
        square = self.pair_square.get
        total = sum(map(square, pairs, repeat(other)))
        if hit * hit < NEAR * NEAR * (2 * total - (square(units[-2:], other) if pairs else 0.0)):
            return 0.0
        grams = set(runs(units))
        hit = sum(map(reach.get, grams & reach.keys()))
        total = sum(map(self.square_of.get, grams, repeat(other)))
        if hit * hit < NEAR * NEAR * total:  # the bound on the cosine with any bad passage
            return 0.0
        vector = self._vector(units)
        if not self._near_bad(vector):
            return 0.0
        ids, sims = self._near(vector)
        if without:
            kept = np.array([k not in without for k in ids.tolist()], dtype=bool)
            ids, sims = ids[kept], sims[kept]
        if not len(ids):
            return 0.0
        best = np.argsort(-sims, kind="stable")[:NEIGHBOURS]
        ids, sims = ids[best], sims[best]
        power = sims.astype(np.float64) ** 2
        good = (self.good_docs[ids] > 0) & (self.bad[ids] == 0)
        plus, minus = float((power * self.bad[ids]).sum()), float((power * good).sum())
        # Few or far neighbours speak less for a vote than many near ones.
        return plus / (plus + minus + 0.08) if plus else 0.0

    def raw(self, text: str, without: set[int] | None = None) -> tuple[float, str]:
        """(worst passage's vote, that passage) of a document."""
        known = self.__dict__.setdefault("_seen", {})
        best, where = 0.0, ""
        for clause in _clauses(text):
            # Most clauses have nothing that any bad passage has, so that none of their passages has a bound above 0.
            if self.reach_pairs.isdisjoint(pairwise(clause)) and self.reach_words.isdisjoint(clause):
                continue
            for units in _windows(clause):
                if without is None:
                    x = known.get(units)
                    if x is None:
                        x = self.passage(units)
                        if len(known) > 200_000:
                            known.clear()
                        known[units] = x
                else:
                    x = self.passage(units, without)
                if x > best:
                    best, where = x, "".join(u if len(u) == 1 else f" {u} " for u in units).strip()
        return best, where

    def calibrated(self, raw: float) -> float:
        """The share of bad documents among labelled ones of such a score."""
        xs = [x for x, _ in self.steps]
        return float(np.interp(raw, xs, [y for _, y in self.steps]))


def isotonic(scored: list[tuple[float, int]]) -> list[tuple[float, float]]:
    """Pool-adjacent-violators: (score, share) with shares that never fall."""
    groups: list[list[float]] = []
    ties: dict[float, list[int]] = defaultdict(list)
    for x, y in scored:
        ties[x].append(y)
    for x in sorted(ties):
        groups.append([x, float(sum(ties[x])), float(len(ties[x])), x])
        while len(groups) > 1 and groups[-2][1] / groups[-2][2] >= groups[-1][1] / groups[-1][2]:
            b = groups.pop()
            a = groups[-1]
            groups[-1] = [a[0], a[1] + b[1], a[2] + b[2], b[3]]
    out = []
    for low, ones, count, high in groups:
        out += [(low, ones / count), (high, ones / count)]
    return out or [(0.0, 0.0)]


def one_line(rows: DataFrame, column: str, name: str) -> DataFrame:
    """Adds the column in lower case and one code for look-alikes; in two steps, as the second looks at its input twice."""
    return rows.withColumn("_c1", same_codes(F.col(column))).withColumn(name, F.lower(latin_look(F.col("_c1")))).drop("_c1")


def fit(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> Model:
    """A model of the labelled documents.

    A document's label is that of most of its rows with a label; at a tie it is undecided and left out.
    Null labels and labels of unknown documents are left out, as are null texts.
    """
    votes = labels.where("label IN (0, 1)").groupBy(F.col(key).alias("_id")).agg(F.avg("label").alias("_y")).where("_y <> 0.5")
    known = documents.select(F.col(key).alias("_id"), F.col(text).alias("_raw")).where("_raw IS NOT NULL").join(votes, "_id")
    picked = known.orderBy(F.xxhash64("_id"), "_id").limit(MAX_LABELLED)
    sized = cut(one_line(picked, "_raw", "_t").select("_id", "_t", (F.col("_y") > 0.5).cast("int").alias("_y")))
    upto = F.sum(F.length("_t")).over(Window.orderBy(F.xxhash64("_id"), "_id"))  # over MAX_LABELLED lengths at most
    few = sized.select("_id", upto.alias("_upto")).where(F.col("_upto") <= MAX_LABELLED_CHARS).select("_id").distinct()
    rows = sized.join(few, "_id", "left_semi").select("_t", "_y").collect()
    return Model([(r["_t"], r["_y"]) for r in rows])


def score(documents: DataFrame, model: Model, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(``key``, ``keep``..., score, evidence) of every document.

    score is the calibrated share, 0 to 1 (without any passage near a bad one, the share of bad documents among
    such); evidence the passage it rests on, '' if there is none. A null or empty text scores 0. Texts are read whole. Repeated rows come out each; an empty table gives none; without
    any labelled document every score is 0. Columns not in ``keep`` are ignored, whatever their names.
    """
    shared = documents.sparkSession.sparkContext.broadcast(zlib.compress(pickle.dumps(model), 1))
    own = [key, *keep]
    schema = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in own) + ", score double, evidence string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = _model(shared.id, shared.value) if hasattr(shared, "id") else pickle.loads(zlib.decompress(shared.value))
        for batch in batches:
            texts = batch.column(len(own)).to_pylist()
            found = [at.raw(t) if t else (0.0, "") for t in texts]
            scores, evidence = pa.array([at.calibrated(x) if t else 0.0 for (x, _), t in zip(found, texts)], pa.float64()), pa.array([e for _, e in found], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(own)], scores, evidence], [*own, "score", "evidence"])

    return one_line(documents.select(*own, F.col(text).alias("_raw")), "_raw", "_t").select(*own, "_t").mapInArrow(run, schema)


_models: dict = {}


def _model(name: int, packed: bytes) -> Model:
    """One model per worker, however many tasks it runs."""
    code = (name, zlib.crc32(packed))
    if code not in _models:
        _models.clear()
        _models[code] = pickle.loads(zlib.decompress(packed))
    return _models[code]


def _scored(spark: SparkSession, folder: str, keep: tuple[str, ...] = ()) -> DataFrame:
    documents = table(spark, folder, "documents")
    return score(documents, fit(documents, table(spark, folder, "review_labels")), keep=keep)


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return _scored(spark, folder).where(F.col("score") >= CASE).select("doc_id")


def p8_scores(spark: SparkSession, folder: str) -> DataFrame:
    return _scored(spark, folder)


def p8_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Each source with its documents, cases, rate of cases and mean score."""
    case = (F.col("score") >= CASE).cast("int")
    return _scored(spark, folder, ("source",)).groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum(case).alias("cases"), F.round(F.avg(case), 6).alias("rate"), F.round(F.avg("score"), 6).alias("mean_score"))


QUERIES = {"p8_found": p8_found, "p8_scores": p8_scores, "p8_rates": p8_rates}
SQL: dict[str, str] = {}
