"""Input guard, intents, moderation, confidence and hallucination findings, as expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..domain import legal
from ..functions.text import any_of, clauses

FINDING = "array<struct<category:string,subtype:string,severity:string,span:string>>"


def filter_input(question: Column) -> Column:
    """G1: STRUCT<accepted, category, reason>: danger first, then foreign topics, then whether any keyword of the field is there."""
    q = F.coalesce(question, F.lit(""))
    label = F.when(q.rlike("|".join(legal.DANGER)), "abusive").when(q.rlike("|".join(legal.OUT_OF_SCOPE)), "off_topic").when(any_of(q, legal.IN_SCOPE), "in_scope").otherwise("off_topic")
    reason = F.when(label == "abusive", "检测到危险内容，无法处理此请求。").when(q.rlike("|".join(legal.OUT_OF_SCOPE)), "您的问题不在本领域范围内。").when(label == "off_topic", "您的问题似乎与本领域无关。").otherwise("")
    return F.struct((label == "in_scope").alias("accepted"), label.alias("category"), reason.alias("reason"))


def intent(question: Column) -> Column:
    """STRUCT<intent, confidence> of the surest pattern that matches, the first declared at a tie; off_topic with 0 without any."""
    rules = [(c, -k, n, p) for k, (n, p, c) in enumerate((n, p, c) for n, ps in legal.INTENTS.items() for p, c in ps)]
    name, sure = F.lit("off_topic"), F.lit(0.0)
    for c, _, n, p in sorted(rules, key=lambda r: (r[0], r[1])):  # the last that matches wins
        name, sure = F.when(question.rlike(p), n).otherwise(name), F.when(question.rlike(p), c).otherwise(sure)
    return F.struct(name.alias("intent"), sure.alias("confidence"))


def intent_label(name: Column) -> Column:
    """P20: the label of an intent, the name itself without one."""
    labels = F.create_map(*[F.lit(x) for p in legal.INTENT_LABELS.items() for x in p])
    return F.coalesce(F.try_element_at(labels, name), name)


def emergency(question: Column) -> Column:
    """G3."""
    return F.coalesce(question.rlike("|".join(legal.EMERGENCY)), F.lit(False))


def check_input(question: Column) -> Column:
    """STRUCT<safe, category, intent, confidence, label, emergency, needs_rag, rag_query, refusal>; rag_query is null where nothing is to be retrieved."""
    g, i = filter_input(question), intent(question)
    return F.struct(
        g["accepted"].alias("safe"), g["category"].alias("category"), i["intent"].alias("intent"), i["confidence"].alias("confidence"), intent_label(i["intent"]).alias("label"),
        emergency(question).alias("emergency"), (g["accepted"] & (i["intent"] != "off_topic")).alias("needs_rag"), F.when(g["accepted"] & (i["intent"] != "off_topic"), question).alias("rag_query"), (i["intent"] == "criminal").alias("refusal"),
    )


def _unless_negated(pattern: str, window: int, words: tuple[str, ...] = legal.NEGATIONS) -> str:
    """The pattern without matches that a negation stands before, within ``window`` characters, as bounded lookbehinds."""
    by_length: dict[int, list[str]] = {}
    for w in words:
        by_length.setdefault(len(w), []).append(w)
    before = "".join(f"(?<!(?s:(?:{'|'.join(ws)}).{{0,{window - n}}}))" for n, ws in by_length.items())
    return f"{before}(?:{pattern})"


def moderate(answer: Column) -> Column:
    """ARRAY<STRUCT<severity, message>>: a missing disclaimer, and each forbidden pattern once, unless negated in the 15 characters before."""
    found = [F.when(~any_of(answer, legal.GUARD_DISCLAIMERS), F.struct(F.lit("medium").alias("severity"), F.lit("no_disclaimer").alias("message")))]
    found += [F.when(answer.rlike(_unless_negated(p, 15)), F.struct(F.lit("critical").alias("severity"), F.lit(n).alias("message"))) for p, n in legal.FORBIDDEN]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def _spans(text: Column, pattern: str, category: str, subtype: str, severity: str) -> Column:
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.transform(found, lambda s: F.struct(F.lit(category).alias("category"), F.lit(subtype).alias("subtype"), F.lit(severity).alias("severity"), s.alias("span")))


def claims(text: Column) -> Column:
    """H-4: clauses of more than ten characters with a figure, an article or a word of obligation."""
    return F.filter(clauses(text), lambda s: (F.length(s) > 10) & s.rlike(r"[0-9]+\.?[0-9]*|第.{0,4}条|司法解释|规定|赔偿|时效|应当|不得"))


def key_runs(claim: Column) -> Column:
    """The first five runs of three or more ideographs."""
    return F.slice(F.filter(F.regexp_extract_all(claim, F.lit("[一-鿿]{2,}"), F.lit(0)), lambda r: F.length(r) >= 3), 1, 5)


def supported(claim: Column, docs: Column) -> Column:
    """H-5: whether a document has at least 60 % of the claim's first five runs of three or more ideographs; without runs it is."""
    runs = key_runs(claim)
    return (F.size(runs) == 0) | F.exists(docs, lambda d: F.size(F.filter(runs, lambda r: F.contains(d, r))) >= 0.6 * F.size(runs))


def findings(text: Column, docs: Column | None = None) -> Column:
    """H-1 to H-5: all findings; ``docs`` are the retrieved texts, without them the first risky term's clauses are marked."""
    t = F.coalesce(text, F.lit(""))
    parts = [_spans(t, _unless_negated(p, 15), "logical_error", n, "critical") for p, n in legal.CRITICAL]
    parts += [_spans(t, p, "logical_error", n, "high") for p, n in legal.OVERCONFIDENT] + [_spans(t, p, "fabrication", n, "medium") for p, n in legal.FABRICATION]
    parts.append(_spans(t, legal.FACT_FORMAT, "factual_error", "unverified_citation", "low"))
    if docs is not None:
        loose = F.filter(claims(t), lambda c: ~supported(c, docs))
        parts.append(F.transform(loose, lambda s: F.struct(F.lit("fabrication").alias("category"), F.lit("unsupported_claim").alias("subtype"), F.lit("high").alias("severity"), s.alias("span"))))
    else:
        term = F.coalesce(*[F.when(F.contains(t, F.lit(x)), x) for x in legal.HIGH_RISK])
        risky = F.filter(clauses(t), lambda s: F.coalesce(F.contains(s, term), F.lit(False)))
        parts.append(F.transform(risky, lambda s: F.struct(F.lit("omission").alias("category"), F.lit("unverified_high_risk").alias("subtype"), F.lit("low").alias("severity"), s.alias("span"))))
    return F.concat(*parts)


def risk(found: Column) -> Column:
    """H-6."""
    def n(s: str) -> Column:
        return F.size(F.filter(found, lambda x: x["severity"] == s))

    total = F.size(found)
    return F.when(n("critical") > 0, "critical").when((n("high") >= 2) | (total >= 5), "high").when((n("high") >= 1) | (total >= 3), "medium").otherwise("low")


def rate(found: Column, text: Column) -> Column:
    """H-7: findings per thousand characters."""
    return F.when(F.length(text) > 0, F.round(F.size(found) * 1000 / F.length(text), 6)).otherwise(0.0)


def confidence(answer: Column, found: Column | None = None, has_docs: Column | None = None) -> Column:
    """G5."""
    score = F.lit(0.15) + F.when(any_of(answer, ("<分析>", "**", "🔴")), 0.10).otherwise(0.0) + F.when(F.length(answer) > 100, 0.05).otherwise(0.0)
    score = score + F.when(answer.rlike(legal.FACT_FORMAT), 0.10).otherwise(0.0) + F.when(F.length(answer).between(150, 1000), 0.10).otherwise(0.0)
    score = score + (F.lit(0.20) if found is None else F.when(F.size(found) == 0, 0.20).when(risk(found) == "low", 0.10).otherwise(0.0))
    if has_docs is not None:
        score = score + F.when(has_docs, 0.15).otherwise(0.0)
    return F.round(F.least(F.lit(1.0), score), 6)


def report(found: Column) -> Column:
    """H-7: a text of all findings with their number and risk."""
    icons = F.create_map(*[F.lit(x) for x in ("critical", "🔴", "high", "🟠", "medium", "🟡", "low", "🟢")])
    span = lambda x: F.when(F.length(x["span"]) > 100, F.concat(F.substring(x["span"], 1, 100), F.lit("..."))).otherwise(x["span"])
    lines = F.transform(found, lambda x: F.concat(F.lit("  "), F.try_element_at(icons, x["severity"]), F.lit(" ["), x["category"], F.lit("/"), x["subtype"], F.lit("]\n     "), span(x)))
    head = F.format_string("%d finding(s), risk: %s", F.size(found), F.upper(risk(found)))
    return F.when(F.size(found) == 0, "no findings").otherwise(F.concat_ws("\n", head, F.array_join(lines, "\n")))


def check_output(rows: DataFrame, question: str = "question", answer: str = "answer", docs: str | None = None, suffix: str = legal.SUFFIX, blocked: str = legal.BLOCKED) -> DataFrame:
    """Adds risk_level, safe, response, fallback and confidence.

    A question with an emergency gets its fixed text, whatever the answer. A critical warning makes the answer
    unsafe, and the fallback is the text to show. Else a missing disclaimer is put behind; findings are looked for
    in the text as it is then, and those of high risk are reported behind it; an answer of a confidence below
    0.5 gets a note. ``docs`` names an array of retrieved texts.
    """
    a = F.coalesce(F.col(answer), F.lit(""))
    w = rows.withColumn("_w", moderate(a)).withColumn("_u", emergency(F.col(question)))
    w = w.withColumn("_x", F.exists("_w", lambda x: x["severity"] == "critical") & ~F.col("_u"))
    missing = F.exists("_w", lambda x: x["severity"] == "medium") & ~F.contains(a, F.lit(suffix.strip()))
    w = w.withColumn("_r", F.when(missing, F.concat(a, F.lit(suffix))).otherwise(a))
    w = w.withColumn("_f", findings(F.col("_r"), F.col(docs) if docs else None)).withColumn("_k", risk(F.col("_f")))
    w = w.withColumn("_r", F.when(F.col("_k").isin("critical", "high"), F.concat("_r", F.lit("\n\n⚠️ "), report(F.col("_f")))).otherwise(F.col("_r")))
    w = w.withColumn("_s", confidence(F.col("_r"), F.col("_f"), F.size(docs) > 0 if docs else None))
    response = F.when(F.col("_s") < 0.5, F.concat("_r", F.lit("\n\n⚠️ " + legal.LOW_CONFIDENCE))).otherwise(F.col("_r"))
    level = F.when(F.col("_u") | F.col("_x"), "critical").when(F.col("_k").isin("critical", "high"), "high").otherwise("low")
    return w.withColumns({
        "risk_level": level, "safe": ~F.col("_x"), "confidence": F.when(F.col("_u") | F.col("_x"), 0.0).otherwise(F.col("_s")),
        "response": F.when(F.col("_u"), legal.EMERGENCY_TEXT).when(F.col("_x"), a).otherwise(response), "fallback": F.when(F.col("_x"), blocked).otherwise(""),
    }).drop("_w", "_u", "_x", "_r", "_f", "_k", "_s")


def process(questions: DataFrame, generate: Callable[[DataFrame], DataFrame], question: str = "question", docs: str | None = None) -> DataFrame:
    """The input check, an answer by ``generate`` (which adds a column answer) where the question is accepted, and the output check.

    Refused questions come out with safe false and an empty answer.
    """
    checked = questions.withColumn("check", check_input(F.col(question)))
    done = check_output(generate(checked.where("check.safe")), question, docs=docs)
    return done.unionByName(checked.where("NOT check.safe").withColumn("safe", F.lit(False)), allowMissingColumns=True)


def indicator_flags(text: Column) -> Column:
    """H-8: STRUCT of the five indicators and score, the share that holds."""
    flags = {n: text.rlike(p) for n, p in legal.INDICATORS}
    return F.struct(*[c.alias(n) for n, c in flags.items()], F.round(sum((c.cast("int") for c in flags.values()), F.lit(0)) / len(flags), 6).alias("score"))


def quick_flags(text: Column) -> Column:
    """H-9: STRUCT of the three flags and their count."""
    flags = {n: text.rlike(p) for n, p in legal.QUICK_FLAGS}
    return F.struct(*[c.alias(n) for n, c in flags.items()], sum((c.cast("int") for c in flags.values()), F.lit(0)).alias("hallucination_count"))
