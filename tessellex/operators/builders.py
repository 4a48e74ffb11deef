"""Record reshaping and training-set builders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..domain import legal
from ..functions.citations import LOOSE, citations
from ..functions.numerals import to_numeral
from ..functions.text import strip
from .chunking import pack_context
from .dedup import exact_dedup
from .quality import has_disclaimer, has_overpromise, preference_source
from .sampling import draw_key, random_split, rank_in_groups
from .statutes import resolve_names

DISCLAIMER = "以上内容仅供参考，不构成法律意见。如有具体案件，请咨询执业律师。"
# What a bad answer loses and gets, texts of grounded records and prompts, built pairs that are unsafe by definition.
PROMISE = "你照做就行，肯定能赢。"
CUT_PHRASES = ("以上内容仅供参考，不构成法律意见。", "以上内容仅供参考。", "不构成法律意见", "建议咨询执业律师。")
REFUSAL_TEXT = "抱歉，当前检索结果中没有与该问题直接相关的法条，我无法给出准确的法律意见。\n建议您补充更多细节（如时间、主体、金额、是否已签订书面文件），或咨询执业律师。\n以上内容仅供参考，不构成法律意见。"
NO_CONTEXT = "【参考法律法规】未检索到直接相关条文。"
RAG_INSTRUCTION = "根据以下检索到的法条回答问题。若检索结果与问题相关，引用其中真实存在的条文（《法名》第X条）；若检索结果不足以直接回答，给出一般性法律说明、说明依据不足，并建议核实或咨询执业律师；不得编造法条。"
FORCED_UNSAFE = ("perturb_fabricate", "perturb_misattribute", "perturb_no_disclaimer_overpromise")


def _message(messages: Column, role: str, last: bool) -> Column:
    return F.try_element_at(F.filter(messages, lambda m: m["role"] == role), F.lit(-1 if last else 1))["content"]


def extract_qa(rows: DataFrame, last: bool = True) -> DataFrame:
    """Adds q and a from the first shape that a row has: messages, instruction and output (with input behind), question and answer, query and response, input and output. Missing columns count as null."""
    have = set(rows.columns)

    def c(name: str) -> Column:
        return F.when(F.col(name) != "", F.col(name)) if name in have else F.lit(None).cast("string")

    q, a = [], []
    if "messages" in have:
        q.append(_message(F.col("messages"), "user", last))
        a.append(_message(F.col("messages"), "assistant", last))
    joined = F.when(c("input").isNotNull(), F.concat(c("instruction"), F.lit(" "), c("input"))).otherwise(c("instruction"))
    for x, y in ((joined, c("output")), (c("question"), c("answer")), (c("query"), c("response")), (c("input"), c("output"))):
        both = x.isNotNull() & y.isNotNull()
        q.append(F.when(both, x))
        a.append(F.when(both, y))
    return rows.withColumns({"q": strip(F.coalesce(*q)), "a": strip(F.coalesce(*a))})


def reference_list(reference: Column) -> Column:
    """P4."""
    return F.when(reference.isNull(), F.array().cast("array<string>")).otherwise(F.array(reference))


def messages(question: Column, answer: Column, system: Column | None = None) -> Column:
    """ARRAY<STRUCT<role, content>>."""
    items = [F.struct(F.lit(r).alias("role"), c.alias("content")) for r, c in (("system", system), ("user", question), ("assistant", answer)) if c is not None]
    return F.array(*items)


def chatml(items: Column, generate: bool = False) -> Column:
    """The rendered conversation, with an open assistant turn to generate from."""
    body = F.array_join(F.transform(items, lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), m["content"], F.lit("<|im_end|>"))), "\n")
    return F.concat(body, F.lit("\n<|im_start|>assistant\n")) if generate else body


def share_format(items: Column) -> Column:
    """Role to from, user to human, assistant to gpt."""
    return F.transform(items, lambda m: F.struct(F.when(m["role"] == "user", "human").when(m["role"] == "assistant", "gpt").otherwise(m["role"]).alias("from"), m["content"].alias("value")))


def rag_prompt(question: Column, context: Column, instruction: str = RAG_INSTRUCTION) -> Column:
    """The user's turn: instruction, context (or a line that there is none) and question."""
    ctx = F.when(F.coalesce(context, F.lit("")) == "", NO_CONTEXT).otherwise(context)
    return F.concat(F.lit(instruction + "\n"), ctx, F.lit("\n\n问题："), question)


def after_thinking(text: Column) -> Column:
    """What follows the last closing mark of a thought block."""
    return strip(F.substring_index(text, "</think>", -1))


def ensure_disclaimer(answer: Column, suffix: str = "\n\n" + DISCLAIMER) -> Column:
    """B9."""
    return F.when(has_disclaimer(answer), answer).otherwise(F.concat(answer, F.lit(suffix)))


def chain_of_thought(question: Column, answer: Column) -> Column:
    """The answer as analysis (core issue, legal basis, risk) and advice; the answer itself where the question or it is empty."""
    basis = F.array_join(F.slice(F.regexp_extract_all(answer, F.lit(LOOSE), F.lit(0)), 1, 2), "、")
    risk = F.when(F.contains(answer, F.lit("时效")), F.substring(F.regexp_extract(answer, "[^。；]*时效[^。；]*", 0), 1, 60)).otherwise("请关注相关时效与举证责任")
    text = F.concat(
        F.lit("<分析>\n- 核心问题: "), F.substring(question, 1, 60), F.lit("\n- 法律依据: "), F.when(basis == "", "请引用相关法条").otherwise(basis), F.lit("\n- 风险/时效: "), risk, F.lit("\n</分析>\n<建议>\n"), answer, F.lit("\n</建议>"),
    )
    return F.when((question == "") | (answer == ""), answer).otherwise(text)


def loss_mask(prompt_ids: Column, answer_ids: Column, most: int) -> Column:
    """STRUCT<input_ids, attention_mask, labels>: prompt positions have label -100; what is beyond ``most`` is cut."""
    ids = F.slice(F.concat(prompt_ids, answer_ids), 1, most)
    masked = F.least(F.size(prompt_ids), F.lit(most))
    labels = F.concat(F.array_repeat(F.lit(-100), masked), F.slice(answer_ids, 1, F.greatest(F.lit(0), F.lit(most) - masked)))
    return F.struct(ids.alias("input_ids"), F.array_repeat(F.lit(1), F.size(ids)).alias("attention_mask"), labels.alias("labels"))


def history(turns: DataFrame, conversation: str, turn: str, most: int = 5, width: int = 200) -> DataFrame:
    """Adds history, the last 2 x most messages up to this turn, each cut to ``width`` characters."""
    line = F.concat(F.col("role"), F.lit(": "), F.substring("text", 1, width))
    return turns.withColumn("history", F.array_join(F.collect_list(line).over(Window.partitionBy(conversation).orderBy(turn).rowsBetween(1 - 2 * most, 0)), "\n"))


def perturb_article(answer: Column, last_article: Column) -> Column:
    """B1: the first citation's article becomes one that the law does not have: its last plus 100, or 999."""
    first = F.try_element_at(citations(answer), F.lit(1))
    wrong = F.concat(F.lit("第"), to_numeral(F.coalesce(last_article + 100, F.lit(999))), F.lit("条"))
    bad = F.regexp_replace(first["raw"], r"第\s*[零〇一二三四五六七八九十百千0-9]{1,8}\s*条", "@@")
    at = F.instr(answer, first["raw"])
    return F.when(first.isNotNull(), F.concat(F.substring(answer, F.lit(1), at - 1), F.replace(bad, F.lit("@@"), wrong), F.substring(answer, at + F.length(first["raw"]), F.length(answer))))


def perturb_law(answer: Column, other: Column) -> Column:
    """B2: the first cited law's name becomes another's."""
    first = F.try_element_at(citations(answer), F.lit(1))["law"]
    at = F.instr(answer, first)
    return F.when(first.isNotNull() & other.isNotNull(), F.concat(F.substring(answer, F.lit(1), at - 1), other, F.substring(answer, at + F.length(first), F.length(answer))))


def perturb_promise(answer: Column) -> Column:
    """Without disclaimers and with a promise."""
    out = answer
    for p in CUT_PHRASES:
        out = F.replace(out, F.lit(p), F.lit(""))
    return F.concat(F.rtrim(out), F.lit(PROMISE))


def preference_pairs(rows: DataFrame, statutes: DataFrame, titles: DataFrame, key: str = "case_id", most: int | None = None) -> DataFrame:
    """(key, type, prompt, chosen, rejected) by the three perturbations, of safe answers with a disclaimer and a citation.

    ``rows`` has question, answer and title, the resolved law of the answer's first citation. With ``most``,
    answers in order of key are taken until there are so many pairs; the last one gives all of its own.
    """
    last = statutes.groupBy("title").agg(F.max("article").alias("_last"))
    lowest = [r[0] for r in titles.select("title").distinct().orderBy("title").limit(2).collect()]
    other = F.when(F.col("title") == F.lit(lowest[0] if lowest else None), F.lit(lowest[1] if len(lowest) > 1 else None)).otherwise(F.lit(lowest[0] if len(lowest) > 1 else None))
    known = rows.where(preference_source(F.col("answer"))).join(last, "title", "left")
    options = F.array(
        F.struct(F.lit(FORCED_UNSAFE[0]).alias("type"), perturb_article(F.col("answer"), F.col("_last")).alias("rejected")),
        F.struct(F.lit(FORCED_UNSAFE[1]).alias("type"), F.when(F.col("title").isNotNull(), perturb_law(F.col("answer"), other)).alias("rejected")),
        F.struct(F.lit(FORCED_UNSAFE[2]).alias("type"), perturb_promise(F.col("answer")).alias("rejected")),
    )
    made = known.select(F.col(key), F.col("question").alias("prompt"), F.col("answer").alias("chosen"), F.filter(options, lambda x: x["rejected"].isNotNull()).alias("_x"))
    if most is not None:  # each answer gives a pair at least, so that no more answers than pairs are ordered
        made = made.orderBy(key).limit(most).withColumn("_n", F.sum(F.size("_x")).over(Window.orderBy(key)) - F.size("_x")).where(F.col("_n") < most).drop("_n")
    return made.select(key, "prompt", "chosen", F.explode("_x").alias("_x")).select(key, "_x.type", "prompt", "chosen", "_x.rejected")


def safety_labels(pairs: DataFrame) -> DataFrame:
    """Adds chosen_safety and rejected_safety (1 unsafe: a promise, or no disclaimer), forced to 1 for the built types, and swaps a pair whose chosen side alone is unsafe."""
    def unsafe(text: Column) -> Column:
        return (has_overpromise(text) | ~has_disclaimer(text)).cast("int")

    c, r = unsafe(F.col("chosen")), F.when(F.col("type").isin(*FORCED_UNSAFE), 1).otherwise(unsafe(F.col("rejected")))
    swap = (c == 1) & (r == 0)
    return pairs.select(
        *[x for x in pairs.columns if x not in ("chosen", "rejected")], F.when(swap, F.col("rejected")).otherwise(F.col("chosen")).alias("chosen"), F.when(swap, F.col("chosen")).otherwise(F.col("rejected")).alias("rejected"),
        F.when(swap, r).otherwise(c).alias("chosen_safety"), F.when(swap, c).otherwise(r).alias("rejected_safety"),
    )


def unsafe_text(text: Column) -> Column:
    """Whether a text has a pattern of unsafe ones and none of safe ones."""
    return text.rlike("|".join(legal.UNSAFE)) & ~text.rlike("|".join(legal.SAFE))


def safe_preferences(pairs: DataFrame) -> DataFrame:
    """Keeps pairs whose chosen side is safe, swaps those where only the rejected one is, drops those with two unsafe sides; labels are taken from the texts."""
    c, r = unsafe_text(F.col("chosen")), unsafe_text(F.col("rejected"))
    swap = c & ~r
    out = pairs.where(~(c & r))
    return out.withColumns({"action": F.when(swap, "swap").otherwise("keep"), "chosen": F.when(swap, F.col("rejected")).otherwise(F.col("chosen")), "rejected": F.when(swap, F.col("chosen")).otherwise(F.col("rejected"))})


def _numbered(chunks: DataFrame, seed: int) -> DataFrame:
    """(_at, chunk_id, title, content, _from, _n, _all): chunks in places from 0, those of a title side by side and in random order, with the title's first place and number and the number of all."""
    named = chunks.select("chunk_id", F.coalesce("title", F.lit("")).alias("title"), "content").withColumn("_k", draw_key(seed, F.col("chunk_id")))
    ranked = rank_in_groups(named, ["title"], ["_k", "chunk_id"], F.substring("_k", 1, 3))
    sizes = named.groupBy("title").agg(F.count(F.lit(1)).alias("_c"))
    upto = Window.orderBy("title")  # one row per title
    sizes = sizes.select("title", (F.sum("_c").over(upto) - F.col("_c")).alias("_from"), F.sum("_c").over(Window.partitionBy()).alias("_all"))
    return ranked.join(sizes, "title").select((F.col("_from") + F.col("_pos") - 1).alias("_at"), "chunk_id", "title", "content", "_from", "_n", "_all")


def grounded_records(rows: DataFrame, chunks: DataFrame, names: DataFrame, key: str = "case_id", seed: int = 42, share: float = 0.8, distractors: int = 2, most: int = 1200) -> DataFrame:
    """(key, question, answer, context, has_oracle, oracle_law, oracle_chunk, distractors) per answer with a cited article among the chunks.

    The oracle is the first chunk of the first citation whose law resolves to one of ``names`` and whose article has a chunk. A hash
    coin keeps it in the context for ``share`` of the records, in a random place among the distractors; the
    others have distractors only, and a refusal for an answer. Distractors are random chunks of other titles: a
    title's chunks lie side by side, so that a random place outside them is one draw and an equi-join, and every
    chunk can be drawn.
    """
    cited = rows.select(key, F.posexplode(citations(F.col("answer"))).alias("_p", "_c")).select(key, "_p", F.col("_c.law").alias("law"), F.col("_c.article").alias("article"))
    cited = cited.join(resolve_names(cited, names), "law").where("title IS NOT NULL")
    first = chunks.where("article IS NOT NULL").groupBy("title", "article").agg(F.min("chunk_id").alias("oracle_chunk"))
    oracle = cited.join(first, ["title", "article"]).groupBy(key).agg(F.min_by(F.struct("oracle_chunk", "title"), F.col("_p")).alias("_o")).select(key, "_o.oracle_chunk", F.col("_o.title").alias("oracle_law"))
    coin = F.conv(F.substring(draw_key(seed, F.col(key)), 1, 8), 16, 10).cast("bigint") / F.lit(float(1 << 32))
    oracle = oracle.withColumn("has_oracle", coin < share)
    places = _numbered(chunks, seed)
    spans = places.groupBy("title").agg(F.first("_from").alias("_from"), F.first("_n").alias("_n"), F.first("_all").alias("_all")).withColumnRenamed("title", "oracle_law")
    left = F.col("_all") - F.col("_n")
    # Few places are all taken, in random order; of many, more are drawn than needed, as some are drawn twice.
    tries = F.when(left <= 16, F.sequence(F.lit(0).cast("bigint"), left - 1)).otherwise(F.transform(F.sequence(F.lit(0), F.lit(8 * distractors + 7)), lambda i: F.pmod(F.xxhash64(F.lit(seed), F.col(key), i), left)))
    tries = F.when(left <= 16, F.array_sort(tries, lambda a, b: F.when(F.xxhash64(F.col(key), a) < F.xxhash64(F.col(key), b), -1).otherwise(1))).otherwise(F.array_distinct(tries))
    asked = oracle.join(spans, "oracle_law").where(left > 0).select(key, F.posexplode(F.transform(F.slice(tries, 1, distractors), lambda r: F.when(r < F.col("_from"), r).otherwise(r + F.col("_n")))).alias("_r", "_at"))
    drawn = asked.join(places.select("_at", "chunk_id", "title", "content"), "_at").select(key, "chunk_id", "title", "content", F.lit(False).alias("_own"))
    own = oracle.where("has_oracle").join(chunks.select(F.col("chunk_id").alias("oracle_chunk"), "content"), "oracle_chunk").select(key, F.col("oracle_chunk").alias("chunk_id"), F.col("oracle_law").alias("title"), "content", F.lit(True).alias("_own"))
    hits = drawn.unionByName(own).withColumn("_rank", F.xxhash64(F.lit(seed), key, "chunk_id"))
    context = pack_context(hits, key, "_rank", most, 80, numbered=True)
    picked = drawn.groupBy(key).agg(F.array_sort(F.collect_list("chunk_id")).alias("distractors"))
    out = oracle.join(rows.select(key, "question", "answer"), key).join(context, key, "left").join(picked, key, "left")
    answer = F.when(F.col("has_oracle"), F.col("answer")).otherwise(REFUSAL_TEXT)
    return out.select(key, "question", answer.alias("answer"), F.coalesce("context", F.lit("")).alias("context"), "has_oracle", "oracle_law", "oracle_chunk", F.coalesce("distractors", F.array().cast("array<bigint>")).alias("distractors"))


def record_counts(records: DataFrame, *flags: str) -> DataFrame:
    """All records, and of each flag those with and without it."""
    return records.agg(F.count(F.lit(1)).alias("records"), *[F.count_if(F.col(f)).alias(f) for f in flags], *[F.count_if(~F.coalesce(F.col(f), F.lit(False))).alias(f"not_{f}") for f in flags])


def question_answer(rows: DataFrame, source: str, question: str = "input", answer: str = "output") -> DataFrame:
    """P5: (question, answer, source, reference) of records with both; reference is a list where there is one."""
    q, a = strip(F.coalesce(F.col(question), F.lit(""))), strip(F.coalesce(F.col(answer), F.lit("")))
    ref = F.col("reference") if "reference" in rows.columns else F.lit(None).cast("string")
    kept = reference_list(ref) if "reference" not in rows.columns or not rows.schema["reference"].dataType.simpleString().startswith("array") else F.coalesce(ref, F.array().cast("array<string>"))
    return rows.select(q.alias("question"), a.alias("answer"), F.lit(source).alias("source"), kept.alias("reference")).where("question <> '' AND answer <> ''")


def law_records(rows: DataFrame, source: str, skip: tuple[str, ...] = ()) -> DataFrame:
    """The fields of a mirror's laws under their own names, without types to skip and without laws of no title or content."""
    have = set(rows.columns)

    def c(*names: str) -> Column:
        return F.coalesce(*[F.col(n) for n in names if n in have], F.lit(""))

    out = rows.select(strip(c("title")).alias("title"), strip(c("type")).alias("type"), c("publish").alias("publish_date"), c("effective", "sxrq").alias("effective_date"), c("status").alias("status"), c("content").alias("content"), F.lit(source).alias("source"), c("id").alias("source_id"))
    return out.where((F.col("title") != "") & (F.col("content") != "") & ~F.col("type").isin(*skip) if skip else (F.col("title") != "") & (F.col("content") != ""))


def instruction_text(instruction: Column, more: Column) -> Column:
    """The instruction and, on a line of its own, its input, both trimmed."""
    head, tail = strip(F.coalesce(instruction, F.lit(""))), strip(F.coalesce(more, F.lit("")))
    return F.when(tail != "", F.concat(head, F.lit("\n"), tail)).otherwise(head)


def conversations(rows: DataFrame) -> DataFrame:
    """Adds conversations (from, value) of input and output, or of instruction (with input behind) and output; rows of neither shape are dropped."""
    have = set(rows.columns)
    c = lambda n: F.col(n) if n in have else F.lit(None).cast("string")
    said = F.when(c("input").isNotNull(), c("input")).otherwise(c("instruction"))
    pair = F.array(F.struct(F.lit("human").alias("from"), said.alias("value")), F.struct(F.lit("gpt").alias("from"), c("output").alias("value")))
    return rows.withColumn("conversations", pair).where(said.isNotNull() & c("output").isNotNull())


def message_record(question: Column, answer: Column, source: str, category: str, system: str) -> list[Column]:
    """The columns messages (system, user, assistant) and metadata (source, category)."""
    return [messages(question, answer, F.lit(system)).alias("messages"), F.struct(F.lit(source).alias("source"), F.lit(category).alias("category")).alias("metadata")]


def grounded_prompt(instruction: str, context: Column, question: Column) -> Column:
    """The user's turn of a grounded record."""
    return F.concat(F.lit(instruction + "\n"), context, F.lit("\n\n问题："), question)


def assemble(parts: list[DataFrame], seq: str, seed: int = 42) -> DataFrame:
    """The union of records with messages, of equal first questions and answers (normalised, put together) the first by ``seq``, split 80 / 10 / 10 at random."""
    rows = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)
    text = F.concat(F.coalesce(_message(F.col("messages"), "user", False), F.lit("")), F.coalesce(_message(F.col("messages"), "assistant", False), F.lit("")))
    return random_split(exact_dedup(rows, text, seq), seed, seq)


def distilled(rows: DataFrame, text: str) -> DataFrame:
    """The JSON array in a model's output as rows of question and answer."""
    found = F.from_json(F.regexp_extract(F.col(text), r"(?s)\[.*\]", 0), "array<struct<question:string,answer:string>>")
    return rows.select("*", F.explode(found).alias("_x")).select(*rows.columns, "_x.question", "_x.answer")


def distill_gate(question: Column, answer: Column, invalid: Column) -> Column:
    """why a distilled pair is rejected, null if it is kept."""
    both = F.concat_ws(" ", question, answer)
    return F.when(invalid > 0, "fabricated_citation").when(~has_disclaimer(answer), "no_disclaimer").when(has_overpromise(both), "overpromise")


def distil_reasons(gated: DataFrame, reason: str = "reason") -> DataFrame:
    """Rejected pairs by reason, most frequent first."""
    return gated.where(F.col(reason).isNotNull()).groupBy(reason).agg(F.count(F.lit(1)).alias("pairs")).orderBy(F.col("pairs").desc(), reason)


def comparison_table(rows: DataFrame, seq: str, texts: tuple[str, ...], most: int = 30, width: int = 200) -> DataFrame:
    """The first rows (a head report) with their texts cut to ``width``."""
    return rows.orderBy(seq).limit(most).withColumns({t: F.substring(t, 1, width) for t in texts})


def title_mentions(answer: Column, titles: Column) -> Column:
    """How often the first six characters of the retrieved titles, with 《 before them, stand in the answer."""
    return F.aggregate(titles, F.lit(0), lambda n, t: n + (F.size(F.split(answer, F.concat(F.lit(r"\Q《"), F.substring(t, 1, 6), F.lit(r"\E")), -1)) - 1))


def expand_grid(experiments: DataFrame) -> DataFrame:
    """One row per experiment and value, with a run name and status 'pending'."""
    return experiments.select("*", F.explode("values").alias("value")).withColumns({"run": F.concat_ws("-", "name", "value"), "status": F.lit("pending")}).drop("values")

