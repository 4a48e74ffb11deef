"""Quality rules, difficulty, category and the cascade filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..domain import legal
from ..functions.citations import citations
from ..functions.text import CJK, any_of, count_of, strip


def _capped(x: Column, full: float) -> Column:
    return F.least(x / F.lit(float(full)), F.lit(1.0))


def good_pair(question: Column, answer: Column, least: int = 20, most: int = 1500) -> Column:
    """lengths in bounds, enough ideographs on both sides, and no answer of few distinct characters."""
    distinct = F.size(F.array_distinct(F.split(answer, "")))
    return (
        F.length(question).between(4, 500) & F.length(answer).between(least, most) & (F.regexp_count(answer, F.lit(CJK)) >= 10)
        & (F.regexp_count(question, F.lit(CJK)) >= 2) & (distinct >= F.lit(0.3) * F.length(answer))
    )


def difficulty(question: Column, answer: Column) -> Column:
    """M1: 0 to 1 by lengths, citations, figures and hard words, to 3 digits."""
    q, a = F.coalesce(question, F.lit("")), F.coalesce(answer, F.lit(""))
    both = F.concat(q, a)
    figures = F.regexp_count(both, F.lit(r"[0-9]+\.?[0-9]*\s*(?:年|个月|倍|%|元|天|日)"))
    return F.round(
        F.least(
            F.lit(1.0),
            _capped(F.length(q), 100) * 0.20 + _capped(F.length(a), 600) * 0.20 + _capped(F.size(citations(a)), 4) * 0.25 + _capped(figures, 5) * 0.20
            + _capped(count_of(both, legal.HARD_WORDS), 4) * 0.15,
        )
        + 1e-9,  # a tie rounds up, however its binary sum came out
        3,
    )


def bucket(score: Column) -> Column:
    """M2."""
    return F.when(score >= 0.6, "hard").when(score >= 0.3, "medium").otherwise("easy")


def category(text: Column, categories: dict[str, tuple[str, ...]] = legal.CATEGORIES) -> Column:
    """M3: the category with most keywords in the text, the first declared at a tie, 'general' without any."""
    hits = {name: count_of(text, words) for name, words in categories.items()}
    best = F.greatest(*hits.values())
    out = F.when(best == 0, "general")
    for name, n in hits.items():
        out = out.when(n == best, name)
    return out.otherwise("general")


def has_disclaimer(text: Column) -> Column:
    return any_of(text, legal.DISCLAIMERS)


def has_overpromise(text: Column) -> Column:
    return text.rlike(legal.OVERPROMISE)


def in_scope(text: Column) -> Column:
    return any_of(text, legal.IN_SCOPE)


def fact_issues(question: Column, answer: Column) -> Column:
    """ARRAY<STRUCT<rule, severity>> of the rules that the pair breaks."""
    text = F.concat_ws(" ", question, answer)
    found = [F.when(text.rlike(p), F.struct(F.lit(n).alias("rule"), F.lit(s).alias("severity"))) for n, p, s in legal.FACT_RULES]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def is_refusal(answer: Column) -> Column:
    """F16: no citation and a marker of declining in the first 200 characters."""
    markers = ("无法", "抱歉", "不能提供", "建议咨询", "超出")
    head = F.substring(answer, 1, 200)
    return (F.size(citations(head)) == 0) & any_of(head, markers)


def cascade(pairs: DataFrame, invalid: Column | None = None, score: Column | None = None, least: int = 30, most: int = 1500) -> DataFrame:
    """F8: adds reason (the first rule that rejects a pair, null if kept) and flags (what is only noted).

    ``pairs`` has question and answer; ``invalid`` is the number of citations that fail the check, ``score``
    the judge's mark, where there are any.
    """
    q, a = strip(F.coalesce(F.col("question"), F.lit(""))), strip(F.coalesce(F.col("answer"), F.lit("")))
    wrong = F.exists(fact_issues(q, a), lambda x: x["severity"] == "error")
    reason = F.when((q == "") | (a == ""), "missing").when(~in_scope(F.concat(q, a)), "out_of_scope").when(F.length(a) < least, "too_short").when(wrong, "fact_error")
    if invalid is not None:
        reason = reason.when(invalid > 0, "fabricated_citation")
    if score is not None:
        reason = reason.when(score < 4.0, "judge")
    flags = F.filter(F.array(F.when(F.length(a) > most, "too_long"), F.when(~has_disclaimer(a), "no_disclaimer")), lambda x: x.isNotNull())
    return pairs.withColumns({"reason": reason, "flags": flags})


def general_keep(instruction: Column, output: Column) -> Column:
    """F11."""
    return F.length(output).between(20, 1500) & (F.length(instruction) >= 3)


def verified(checked: Column, answer: Column) -> Column:
    """the facts hold and there is an answer."""
    return F.coalesce(checked, F.lit(False)) & (F.coalesce(answer, F.lit("")) != "")


def preference_source(answer: Column) -> Column:
    """long enough, with disclaimer and a citation, without promises."""
    return (F.length(answer) >= 80) & has_disclaimer(answer) & ~has_overpromise(answer) & (F.size(citations(answer)) >= 1)


def complex_enough(text: Column, terms: tuple[str, ...] = legal.GROUNDED_TERMS, least: int = 2) -> Column:
    """at least ``least`` of the terms are in the question."""
    return count_of(text, terms) >= least
