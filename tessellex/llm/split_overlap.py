"""Problem 5: records of evaluation splits that the training split has too, exactly or almost.

Question and answer are brought to one canonical form (look-alike codes, case, marks, spaces and markup
gone) and hashed. Two records are a pair if their answers are almost the same and their questions are

* the same: equal hashes join evaluation with training;
* parted by at most k edits of characters, k being 2 and one more for each 32 characters of the shorter one, up
  to 10, and one for each 6 in short ones (question_edits): a training question is cut into k + 1 segments, of
  which k edits leave one as it is, and an evaluation question offers, for every length within k of its own, its
  stretches at the places to which edits can have moved a segment. An equi-join on hashes of both loses no pair;
* parted by more, up to QUESTION_EDITS, if the answers are the same or share a sentence of SENTENCE characters:
  an equi-join on hashes of answers and sentences.

Nothing is sampled and no key is left out: what meets grows with the records that share a segment, an answer
or a sentence. Before a text is read, lengths and a sketch of parities of counts of characters rule out most
pairs: an edit changes at most two of its bits. Under an answer or sentence that very many share, the sketches
alone meet, in blocks of bounded size, and under a question with very many answers the answers meet in blocks, in
which all that share as many runs as the deciding comparison implies are compared. Each distinct canonical question is looked up once, however many records have it, and each distinct pair of answers under a pair of
questions is compared once; rows come in only after that.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, freed_shuffles, kept_table, table
from .one_form import latin_look, same_codes

#: Characters of the training and of the held-out texts in a block.
KNOWN_CHARS, HELD_CHARS = 4_000_000, 600_000
#: Under linked questions with more pairs of answers than this the answers meet in blocks.
MANY_ANSWERS = 2_000
#: Rows in a block of the questions under one answer or sentence.
KNOWN_ROWS, HELD_ROWS = 8_000, 2_000
#: Shares of short runs that two questions and two answers have in common to be almost the same.
SAME_QUESTION, SAME_ANSWER = 0.6, 0.6
#: Questions of up to so many characters are compared by edit distance instead, of at most this share.
EDITED, QUESTION_EDITS = 400, 0.25
#: Edits between questions whatever their answers share: so many, one more for each so many characters of the shorter one, at most so many, and no more than one for each so many.
LEAST_EDITS, EDIT_EVERY, MOST_EDITS, BRIEF_EVERY = 2, 32, 10, 6
#: Letters and digits of a sentence that tells answers apart from others.
SENTENCE = 20
#: Answers of up to so many characters are compared by edit distance, of at most this share.
BRIEF, EDITS = 30, 0.15


def _folded(rows: DataFrame, column: str, name: str) -> DataFrame:
    """Adds the column without markup and case, and with one code for letters that look alike; null becomes ''.

    Each step is a column of its own: steps look at their input more than once, and nested expressions
    would make it anew each time.
    """
    out = rows.withColumn("_c1", F.coalesce(same_codes(F.col(column)), F.lit("")))
    out = out.withColumn("_c2", F.when(F.contains("_c1", F.lit("<")) | F.contains("_c1", F.lit("&nbsp;")), F.regexp_replace("_c1", r"<[^<>\n]{1,80}>|&nbsp;", "")).otherwise(F.col("_c1")))
    # Accents are told apart from their letters in some copies and not in others: marks go, and so do composed ones.
    out = out.withColumn("_c3", latin_look(F.col("_c2")))
    out = out.withColumn("_c4", F.when(F.col("_c3").rlike("[À-ɏ]"), F.translate("_c3", *_ACCENTS)).otherwise(F.col("_c3")))
    return out.withColumn(name, F.lower("_c4")).drop("_c1", "_c2", "_c3", "_c4")


def canonical(rows: DataFrame, column: str, name: str) -> DataFrame:
    """Adds the column folded, and without marks and spaces; null and empty become ''."""
    return _folded(rows, column, "_c0").withColumn(name, F.regexp_replace("_c0", r"[^\p{L}\p{N}]+", "")).drop("_c0")


def _answer_keys(rows: DataFrame, column: str, name: str) -> DataFrame:
    """Adds the hashes of the whole canonical text and of its sentences of at least SENTENCE letters and digits."""
    parts = _folded(rows, column, "_c0").withColumn("_c5", F.split("_c0", r"[。!?;\n]+|\. "))
    parts = parts.withColumn("_c6", F.transform("_c5", lambda t: F.regexp_replace(t, r"[^\p{L}\p{N}]+", "")))
    whole = F.array(F.xxhash64(F.lit("whole"), F.array_join("_c6", "")))
    return parts.withColumn(name, F.array_union(whole, F.transform(F.filter("_c6", lambda t: F.length(t) >= SENTENCE), lambda t: F.xxhash64(t)))).drop("_c0", "_c5", "_c6")


def _accents() -> tuple[str, str]:
    import unicodedata

    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in range(0xC0, 0x250) if len(unicodedata.normalize("NFD", chr(c))) > 1]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_ACCENTS = _accents()


def _runs(text: str, n: int) -> str:
    """SQL for the distinct runs of n characters of a column; the whole text if it is shorter."""
    return f"array_distinct(transform(sequence(1, greatest(1, length({text}) - {n - 1})), i -> xxhash64(substring({text}, i, {n}))))"


_SLOTS = 1 << 20
#: Words of 64 places for hashes of wanted values.
_WORDS = 1 << 20
#: So many runs of the rarest must be shared before all of a pair's are counted.
_FIRST = 4


def _grams(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lengths, repeated runs, starts, slots): the distinct slots of the runs of n characters, text after text."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    owner = np.repeat(np.arange(len(texts)), lengths)
    last = max(len(codes) - n + 1, 0)
    slot = np.zeros(last, dtype=np.int64)
    for j in range(n):
        slot = (slot * 1_000_003 + codes[j : j + last]) & 0xFFFFFFFFFFF
    slot = (slot ^ (slot >> 20)) % _SLOTS
    whole = owner[:last] == owner[n - 1 :] if last else np.zeros(0, dtype=bool)
    packed = np.unique((owner[:last][whole] << 20) | slot[whole])
    row = packed >> 20
    counts = np.bincount(row, minlength=len(texts))
    return lengths, np.maximum(lengths - n + 1, 0) - counts, np.concatenate([[0], np.cumsum(counts)]), packed & (_SLOTS - 1)


def sharing(held: list[str], known: list[str], n: int, edits: float | None, share: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Positions (in held, in known) of all pairs that can be almost the same, and of few others.

    With ``edits`` these are the pairs of an edit distance of at most that share of the longer text: an edit
    breaks at most n runs of n characters. Else those with ``share`` of the runs of _alike. Slots stand for
    runs; runs in one slot count as repeated ones, which lowers the bound.
    """
    lx, rx, sx, gx = _grams(held, n)
    ly, _, sy, gy = _grams(known, n)
    by = np.argsort(gy, kind="stable")
    rows = np.repeat(np.arange(len(known)), np.diff(sy))[by]
    starts = np.concatenate([[0], np.cumsum(np.bincount(gy, minlength=_SLOTS))])
    ny, mark = np.diff(sy), np.zeros(_SLOTS, dtype=bool)
    out_x, out_y = [], []

    def kept(longest):
        return longest - n + 1 - n * np.floor(edits * longest + 1e-9).astype(np.int64)

    for i, length in enumerate(lx):
        mine = gx[sx[i] : sx[i + 1]]
        if edits is not None:
            # The bound grows with the longer text, but for steps where one more edit is allowed.
            least = int(kept(np.arange(length, length + math.ceil(1 / edits) + 1)).min()) - rx[i] if n * edits < 1 else 0
        else:  # the other text may have fewer runs, down to 0.62 of these; slots may hide shared ones
            least = math.ceil(share * 0.62 * (len(mine) + rx[i]) * (1 - 1e-9)) - rx[i]
        if least > 0:
            first = min(_FIRST, least)
            often = starts[mine + 1] - starts[mine]
            rare = mine[np.argsort(often, kind="stable")[: len(mine) - least + first]]
            met = np.concatenate([rows[starts[g] : starts[g + 1]] for g in rare])
            near = np.flatnonzero(np.bincount(met, minlength=len(known)) >= first)
        else:
            near = np.arange(len(known))
        longest = np.maximum(ly[near], length)
        near = near[np.minimum(ly[near], length) >= (1 - edits if edits is not None else 0.5) * longest - 1e-9]
        if least > 0 and len(near):
            size = ny[near]
            at = np.arange(size.sum()) + np.repeat(sy[near] - (np.cumsum(size) - size), size)
            mark[mine] = True
            common = np.bincount(np.repeat(np.arange(len(near)), size), weights=mark[gy[at]], minlength=len(near))
            mark[mine] = False
            need = kept(np.maximum(ly[near], length)) - rx[i] if edits is not None else least
            near = near[common >= need]
        out_x.append(np.full(len(near), i))
        out_y.append(near)
    return np.concatenate(out_x or [np.zeros(0, int)]), np.concatenate(out_y or [np.zeros(0, int)])


def _likely(rows: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """The rows whose column has a value of ``wanted``, and the few others of which hashes don't tell it.

    At most _WORDS rows are broadcast, each with the places of 64 hashes; with more values more of the others stay,
    so that an exact join follows. None of the rows that it finds are lost.
    """
    place = F.pmod(F.xxhash64(column), F.lit(64 * _WORDS))
    words = wanted.select(place.alias("_p")).groupBy(F.expr("_p div 64").alias("_w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(_p % 64 as int))")).alias("_bits"))
    placed = rows.withColumn("_p", place).withColumn("_w", F.expr("_p div 64"))
    return placed.join(F.broadcast(words), "_w").where("shiftrightunsigned(_bits, cast(_p % 64 as int)) % 2 <> 0").select(*rows.columns)


def _blocks(n: int, edits: float | None, share: float = 0.0) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def met(held: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        x, y = sharing(held["_t"].tolist(), known["_t"].tolist(), n, edits, share)
        return pd.DataFrame({"_e": held["_id"].to_numpy()[x], "_k": known["_id"].to_numpy()[y], "_in": held["_in"].to_numpy()[x]})

    return met


def _candidates(held: DataFrame, known: DataFrame, n: int, edits: float | None, share: float = 0.0) -> DataFrame:
    """(_e, _k, _in) of pairs of (_in, _id, _t) that can be almost the same: texts of one ``_in``, of lengths near each other, in blocks."""
    base = math.log(1 / (1 - edits) + 0.01 if edits is not None else 2.01)

    def split(rows: DataFrame, chars: int, name: str) -> tuple[DataFrame, DataFrame]:
        sized = rows.where("_t <> ''").withColumn("_class", F.floor(F.log(F.length("_t")) / base))
        sums = sized.groupBy("_in", "_class").agg(F.ceil(F.sum(F.length("_t")) / chars).alias(f"_{name}n"))
        return sized, sums

    held, many = split(held, HELD_CHARS, "e")
    known, more = split(known, KNOWN_CHARS, "k")
    # Classes that meet, with the numbers of their blocks; every block of one side goes to every block of the other.
    meet = more.withColumnRenamed("_class", "_kclass").withColumn("_class", F.explode(F.array(F.col("_kclass") - 1, "_kclass", F.col("_kclass") + 1))).join(many, ["_in", "_class"])
    meet = cut(meet)
    block = F.concat_ws(":", "_in", "_class", "_kclass", "_eb", "_kb")

    def spread(rows: DataFrame, own: str, other: str) -> DataFrame:
        classes = meet if own == "e" else meet.withColumnsRenamed({"_class": "_eclass", "_kclass": "_class"})
        out = rows.join(classes, ["_in", "_class"]).withColumn(f"_{own}b", F.pmod(F.xxhash64("_id"), F.col(f"_{own}n")))
        out = out.withColumn(f"_{other}b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(f"_{other}n") - 1)))
        return (out if own == "e" else out.withColumnsRenamed({"_class": "_kclass", "_eclass": "_class"})).select(block.alias("_b"), *[F.col(c).alias(c) for c in ("_in", "_id", "_t")])

    return spread(held, "e", "k").groupBy("_b").cogroup(spread(known, "k", "e").groupBy("_b")).applyInPandas(_blocks(n, edits, share), "_e bigint, _k bigint, _in bigint")


def _alike(a: str, b: str, share: float) -> str:
    """SQL: two canonical texts are almost the same."""
    common = f"size(array_intersect({_runs(a, 4)}, {_runs(b, 4)}))"
    longest = f"greatest(length({a}), length({b}))"
    brief = f"levenshtein({a}, {b}) <= {EDITS} * {longest}"
    # A sentence more or less is a part of the longer text: the shorter one counts, if it is not much shorter.
    long = f"{common} >= {share} * greatest(least(size({_runs(a, 4)}), size({_runs(b, 4)})), 0.62 * greatest(size({_runs(a, 4)}), size({_runs(b, 4)})))"
    return f"CASE WHEN {a} = {b} THEN true WHEN {longest} <= {BRIEF} THEN {brief} WHEN least(length({a}), length({b})) < 0.5 * {longest} THEN false ELSE {long} END"


def question_edits(length: str) -> str:
    """SQL: the edits that the rule lets pass between questions of which the shorter has that length."""
    return f"least({MOST_EDITS}, {LEAST_EDITS} + {length} div {EDIT_EVERY}, {length} div {BRIEF_EVERY})"


#: Parities of the counts of characters, in so many numbers of 64 places.
_SKETCHES = 3


def _with_sketch(questions: DataFrame) -> DataFrame:
    places = questions.withColumn("_b", F.expr(f"transform(split(_q, ''), x -> pmod(xxhash64(x), {64 * _SKETCHES}))"))
    one = "aggregate(_b, 0L, (a, b) -> if(b div 64 = {0}, a ^ shiftleft(1L, cast(b % 64 as int)), a))"
    return places.withColumns({f"_s{i}": F.expr(one.format(i)) for i in range(_SKETCHES)}).drop("_b")


def _segment_pairs(distinct: DataFrame) -> DataFrame:
    """(_e, _k) of distinct (_train, _id, _q, _n) that share a segment where at most the edits of question_edits can have moved it.

    The j-th segment of a training text of length m can stand, in a text of length n, at most j places from its
    own, and at most k - j from its own counted from the end. k never falls with the length, so that the
    training text's own k holds for pairs with a shorter one, too.
    """
    known = distinct.where("_train").withColumn("_k", F.expr(question_edits("_n"))).withColumn("_w", F.expr("_n div (_k + 1)"))
    segments = "transform(sequence(0, cast(_k as int)), j -> xxhash64(_n, j, substring(_q, cast(j * _w + 1 as int), cast(_w as int))))"
    known = known.select(F.col("_id").alias("_k"), F.explode(F.expr(segments)).alias("_h"))
    held = distinct.where("NOT _train").withColumn("_m", F.explode(F.sequence(F.greatest(F.lit(1), F.col("_n") - MOST_EDITS), F.col("_n") + MOST_EDITS)))
    held = held.withColumn("_k", F.expr(question_edits("_m"))).where(F.abs(F.col("_m") - F.col("_n")) <= F.col("_k")).withColumn("_w", F.expr("_m div (_k + 1)"))
    low = "greatest(0L, j * _w - j, j * _w + (_n - _m) - (_k - j))"
    high = "least(_n - _w, j * _w + j, j * _w + (_n - _m) + (_k - j))"
    places = f"if({high} < {low}, cast(array() AS array<bigint>), sequence({low}, {high}))"
    offered = f"flatten(transform(sequence(0, cast(_k as int)), j -> transform({places}, p -> xxhash64(_m, j, substring(_q, cast(p + 1 as int), cast(_w as int))))))"
    held = held.select(F.col("_id").alias("_e"), F.explode(F.expr(offered)).alias("_h"))
    return held.join(known, "_h").where("_e <> _k").select("_e", "_k")


def _facts(distinct: DataFrame, train: bool, key: str) -> DataFrame:
    """The key, length and sketches of one side's questions, named by ``key``."""
    rows = distinct.where("_train" if train else "NOT _train")
    return rows.select(F.col("_id").alias(key), *[F.col(c).alias(f"{key}{c}") for c in ("_n", *(f"_s{i}" for i in range(_SKETCHES)))])


def _can_be_near(far: bool) -> Column:
    """What lengths and sketches of _e and _k leave possible: an edit changes at most two places of a sketch."""
    apart = reduce(Column.__add__, [F.bit_count(F.col(f"_e_s{i}").bitwiseXOR(F.col(f"_k_s{i}"))) for i in range(_SKETCHES)])
    longest, shortest = F.greatest("_e_n", "_k_n"), F.least("_e_n", "_k_n")
    if not far:
        return apart <= 2 * F.expr(question_edits("least(_e_n, _k_n)"))
    by_edits = (longest - shortest <= QUESTION_EDITS * longest) & (apart <= 2 * QUESTION_EDITS * longest)
    return F.when(longest > EDITED, shortest * 2 >= longest).otherwise(by_edits)


def _answer_pairs(distinct: DataFrame, asked: DataFrame) -> DataFrame:
    """(_e, _k) of questions that share an answer's key and that lengths and sketches leave possible.

    Most keys have a single row; only those of both sides are looked at again, with lengths and sketches in place
    of texts. Under a key of very many rows every block of one side meets every block of the other.
    """
    rows = asked.select("_train", F.xxhash64("_qh").alias("_id"), F.explode("_hs").alias("_h"))
    sizes = rows.groupBy("_h").agg(F.count_if("_train").alias("_a"), F.count_if(~F.col("_train")).alias("_b")).where("_a > 0 AND _b > 0")
    both = cut(sizes.select("_h", F.expr(f"cast((_a - 1) div {KNOWN_ROWS} + 1 AS int)").alias("_kn"), F.expr(f"cast((_b - 1) div {HELD_ROWS} + 1 AS int)").alias("_en")))
    keys = rows.join(both, "_h").withColumn("_m", F.struct("_kn", "_en")).groupBy("_h", "_train", "_id").agg(F.first("_m").alias("_m"))

    def spread(train: bool, own: str, other: str) -> DataFrame:
        mine = keys.where("_train" if train else "NOT _train").select("_h", F.col("_id").alias(own), "_m._kn", "_m._en").join(_facts(distinct, train, own), own)
        return mine.withColumn(f"{own}b", F.pmod(F.xxhash64(own), F.col(f"{own}n"))).withColumn(f"{other}b", F.explode(F.expr(f"sequence(0L, {other}n - 1L)"))).drop("_kn", "_en")

    met = spread(False, "_e", "_k").join(spread(True, "_k", "_e"), ["_h", "_eb", "_kb"])
    return met.where(_can_be_near(True) & (F.col("_e") != F.col("_k"))).select("_e", "_k").distinct()


def _near_questions(distinct: DataFrame, asked: DataFrame) -> DataFrame:
    """(_eq, _tq): pairs of different questions that are almost the same, of distinct (_train, _qh, _id, _q, _n, sketches) and rows of (_train, _qh, _hs)."""
    near = _segment_pairs(distinct).distinct().join(_facts(distinct, False, "_e"), "_e").join(_facts(distinct, True, "_k"), "_k").where(_can_be_near(False)).select("_e", "_k")
    met = near.withColumn("_far", F.lit(False)).unionByName(_answer_pairs(distinct, asked).withColumn("_far", F.lit(True)))
    met = cut(met.groupBy("_e", "_k").agg(F.max("_far").alias("_far")))
    text = distinct.join(met.select(F.col("_e").alias("_id")).union(met.select("_k")).distinct(), "_id", "left_semi")
    mine = text.where("NOT _train").select(F.col("_id").alias("_e"), F.col("_qh").alias("_eq"), F.col("_q").alias("_x"))
    theirs = text.where("_train").select(F.col("_id").alias("_k"), F.col("_qh").alias("_tq"), F.col("_q").alias("_y"))
    longest, edits = F.greatest(F.length("_x"), F.length("_y")), F.levenshtein("_x", "_y")
    near = (edits <= F.expr(question_edits("least(length(_x), length(_y))"))) | F.col("_far") & F.when(longest <= EDITED, edits <= QUESTION_EDITS * longest).otherwise(F.expr(_alike("_x", "_y", SAME_QUESTION)))
    return met.join(mine, "_e").join(theirs, "_k").where(near & (F.col("_eq") != F.col("_tq"))).select("_eq", "_tq")


def _classes(rows: DataFrame, key: str, question: str, answer: str, split: str, train: tuple[str, ...], held_out: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Rows (_train, _key, _qh, _ah) of linked questions; (_eq, _ea, _tq, _ta), the pairs of distinct questions and answers that are almost the same."""
    kept = rows.where(F.col(split).isin(*train, *held_out))
    asked = canonical(kept.select(F.col(key).alias("_key"), F.col(split).isin(*train).alias("_train"), F.col(question).alias("_s"), F.col(answer).alias("_a")), "_s", "_q")
    asked = kept_table(_answer_keys(asked, "_a", "_hs").select("_key", "_train", "_q", F.unhex(F.md5("_q")).alias("_qh"), "_hs"))
    asked = asked.where("_qh <> unhex(md5(''))")  # above the table: below it, the filter would make the canonical form anew for every look at it
    distinct = asked.groupBy("_train", "_qh").agg(F.first("_q").alias("_q"))
    distinct = kept_table(_with_sketch(distinct.withColumns({"_id": F.xxhash64("_qh"), "_n": F.length("_q")})))
    sides = distinct.groupBy("_qh").agg(F.count(F.lit(1)).alias("_n")).where("_n = 2")  # a question of both sides
    same = sides.select(F.col("_qh").alias("_eq"), F.col("_qh").alias("_tq"))
    linked = cut(_near_questions(distinct, asked).unionByName(same))

    # Only the rows of linked questions are read in full; the texts of most others stay where they are.
    ends = linked.select(F.col("_eq").alias("_qh")).union(linked.select("_tq")).distinct()
    keys = cut(asked.join(ends, "_qh", "left_semi").select("_key", "_train").distinct())
    full = kept.select(F.col(key).alias("_key"), F.col(split).isin(*train).alias("_train"), F.col(question).alias("_rq"), F.col(answer).alias("_ra"))
    full = _likely(full, "_key", keys).join(keys, ["_key", "_train"])  # keys are distinct; a semi-join would go below the other one
    full = canonical(canonical(full, "_rq", "_q"), "_ra", "_a")
    base = kept_table(full.select("_key", "_train", F.unhex(F.md5("_q")).alias("_qh"), "_a", F.xxhash64("_a").alias("_ah")))

    # Distinct answers under linked questions: equal ones by hash, others by comparison.
    answers = base.groupBy("_train", "_qh", "_ah").agg(F.first("_a").alias("_a"))
    held = answers.where("NOT _train").select(F.col("_qh").alias("_eq"), F.col("_ah").alias("_ea"), F.col("_a").alias("_x")).join(linked, "_eq")
    known = answers.where("_train").select(F.col("_qh").alias("_tq"), F.col("_ah").alias("_ta"), F.col("_a").alias("_y"))
    equal = held.join(known, (held["_tq"] == known["_tq"]) & (F.col("_ea") == F.col("_ta"))).select("_eq", "_ea", known["_tq"], "_ta")
    # All answers under linked questions are compared; under those with very many, all that share enough runs.
    sizes = held.groupBy("_eq", "_tq").agg(F.count(F.lit(1)).alias("_m")).join(known.groupBy("_tq").agg(F.count(F.lit(1)).alias("_n")), "_tq")
    hot = cut(sizes.where(F.col("_m") * F.col("_n") > MANY_ANSWERS).select("_eq", "_tq"))
    maybe = held.join(hot, ["_eq", "_tq"], "left_anti").join(known, "_tq").where("_ea <> _ta")
    if not hot.isEmpty():
        here = hot.withColumn("_in", F.xxhash64("_eq", "_tq"))
        mine = held.join(here, ["_eq", "_tq"]).select("_in", F.col("_ea").alias("_id"), F.col("_x").alias("_t"))
        theirs = known.join(here, "_tq").select("_in", F.col("_ta").alias("_id"), F.col("_y").alias("_t"))
        brief = F.length("_t") <= BRIEF
        found = _candidates(mine.where(brief), theirs.where(brief), 2, EDITS).unionByName(_candidates(mine.where(F.length("_t") > BRIEF // 2), theirs.where(F.length("_t") > BRIEF // 2), 4, None, SAME_ANSWER))
        found = found.distinct().join(here, "_in").select("_eq", F.col("_e").alias("_ea"), "_tq", F.col("_k").alias("_ta"))
        maybe = maybe.unionByName(found.where("_ea <> _ta").join(held, ["_eq", "_ea", "_tq"]).join(known, ["_tq", "_ta"]))
    close = maybe.where(F.expr(_alike("_x", "_y", SAME_ANSWER))).select("_eq", "_ea", "_tq", "_ta")
    return base, cut(equal.unionByName(close))


def overlaps(
    rows: DataFrame, key: str = "case_id", question: str = "question", answer: str = "answer", split: str = "split", train: tuple[str, ...] = ("train",), held_out: tuple[str, ...] = ("eval", "test")
) -> DataFrame:
    """(id_train, id_held_out) of all pairs of rows whose question and answer are both the same or almost the same.

    Null and empty answers are the same as each other; questions that are null or have no letters and
    digits make no pairs. Repeated rows make a pair each. Rows of other splits, or of null split, are left
    out; an empty table gives no pairs. Further columns, whatever their names, are ignored.
    """
    with freed_shuffles(rows.sparkSession):
        base, classes = _classes(rows, key, question, answer, split, train, held_out)
    # From classes to rows.
    members = base.select("_train", "_key", "_qh", "_ah")
    pairs = classes.join(members.where("NOT _train").select(F.col("_key").alias("id_held_out"), F.col("_qh").alias("_eq"), F.col("_ah").alias("_ea")), ["_eq", "_ea"])
    pairs = pairs.join(members.where("_train").select(F.col("_key").alias("id_train"), F.col("_qh").alias("_tq"), F.col("_ah").alias("_ta")), ["_tq", "_ta"])
    return pairs.select("id_train", "id_held_out")


def overlap_report(rows: DataFrame, pairs: DataFrame, key: str = "case_id", split: str = "split", source: str = "source", department: str = "department") -> DataFrame:
    """Per held-out split, source and department: pairs, and rows with at least one (each row counted once).

    Departments are without outer blanks and in lower case; null sources and departments are groups of their own.
    """
    per = pairs.groupBy(F.col("id_held_out").alias("_id")).agg(F.count(F.lit(1)).alias("_n"))
    facts = rows.select(F.col(key).alias("_id"), F.col(split).alias("split"), F.col(source).alias("source"), F.lower(F.trim(F.col(department))).alias("department"))
    return facts.join(per, "_id").groupBy("split", "source", "department").agg(F.count(F.lit(1)).alias("rows_found"), F.sum("_n").alias("pairs"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = overlaps(table(spark, folder, "contract"))
    return pairs.select(F.least("id_train", "id_held_out").alias("id_a"), F.greatest("id_train", "id_held_out").alias("id_b"))


def p5_report(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "contract")
    return overlap_report(rows, overlaps(rows))


QUERIES = {"p5_found": p5_found, "p5_report": p5_report}
SQL: dict[str, str] = {}
