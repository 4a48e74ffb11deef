"""Queries on the corpus: cleaning, audit, chunks, duplicates, statutes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..domain import legal
from ..functions import citations as C
from ..functions import numerals, text
from ..operators import chunking, corpus, dedup, statutes
from ..session import table

T = table


def normalize_hash(s: SparkSession, d: str) -> DataFrame:
    n = text.normalize(F.col("text"))
    return T(s, d, "documents").select("doc_id", F.length(n).alias("n"), text.text_hash(n).alias("h"))


def exact_dedup(s: SparkSession, d: str) -> DataFrame:
    return dedup.exact_dedup(T(s, d, "documents"), F.col("text"), "doc_id").select("doc_id")


def token_counts(s: SparkSession, d: str) -> DataFrame:
    return T(s, d, "chunks").select("chunk_id", F.size(text.tokens(F.coalesce("content", F.lit("")))).alias("n_tokens"), F.size(text.sentences(F.coalesce("content", F.lit("")))).alias("n_sentences"))


def title_version_dedup(s: SparkSession, d: str) -> DataFrame:
    return corpus.latest_versions(T(s, d, "laws")).select("law_id", "title", "publish_date")


def preprocess_reasons(s: SparkSession, d: str) -> DataFrame:
    return corpus.preprocess(T(s, d, "laws")).groupBy("reason").agg(F.count(F.lit(1)).alias("laws_count"))


def clean_laws(s: SparkSession, d: str) -> DataFrame:
    return T(s, d, "laws").select("law_id", corpus.clean_content(F.col("content")).alias("clean"))


def corpus_audit(s: SparkSession, d: str) -> DataFrame:
    return corpus.audit(T(s, d, "laws"))


def article_totals(s: SparkSession, d: str) -> DataFrame:
    n = F.size(statutes.articles(F.col("content")))
    return T(s, d, "laws").select("law_id", n.alias("n_articles"))


def type_histogram(s: SparkSession, d: str) -> DataFrame:
    return corpus.histogram(T(s, d, "laws"), "type")


def missing_titles(s: SparkSession, d: str) -> DataFrame:
    cited = T(s, d, "contract").where("law_title IS NOT NULL").select(F.col("law_title").alias("title"))
    return corpus.missing_titles(cited, T(s, d, "laws"))


def coverage_gap(s: SparkSession, d: str) -> DataFrame:
    official = T(s, d, "split_limits").where("law_type IS NOT NULL").select(F.col("law_type").alias("type"), F.col("max_chars").alias("official"))
    return corpus.coverage_gap(T(s, d, "laws"), official)


def national_laws(s: SparkSession, d: str) -> DataFrame:
    return T(s, d, "laws").where(F.col("type").isin(*legal.NATIONAL_TYPES) & (F.trim("status") == "有效")).select("law_id")


def split_articles(s: SparkSession, d: str) -> DataFrame:
    return statutes.article_rows(T(s, d, "laws")).select("law_id", "pos", "article", text.text_hash(F.col("text")).alias("h"))


def cn_numeral(s: SparkSession, d: str) -> DataFrame:
    n = T(s, d, "part").select("p_partkey", (F.col("p_partkey") % 10000).cast("int").alias("n"))
    return n.select("p_partkey", numerals.to_numeral(F.col("n")).alias("numeral"), numerals.to_int(numerals.to_numeral(F.col("n"))).alias("number"))


def extract_citations(s: SparkSession, d: str) -> DataFrame:
    one = T(s, d, "contract").select("case_id", F.posexplode(C.citations(F.col("answer"))).alias("pos", "c"))
    return one.select("case_id", F.col("c.law").alias("law"), F.col("c.article").alias("article"), F.coalesce("c.para", F.lit(-1)).alias("para"))


def citation_count(s: SparkSession, d: str) -> DataFrame:
    return T(s, d, "contract").select("case_id", F.regexp_count(F.coalesce("answer", F.lit("")), F.lit(C.LOOSE)).alias("loose"), F.size(C.quantities(F.coalesce("answer", F.lit("")))).alias("quantities"))


def statute_index(s: SparkSession, d: str) -> DataFrame:
    rows, _ = statutes.statute_index(T(s, d, "laws"))
    return rows.select("title", "article", text.text_hash(F.col("text")).alias("h"))


def resolve_law(s: SparkSession, d: str) -> DataFrame:
    _, names = statutes.statute_index(T(s, d, "laws"))
    cited = T(s, d, "contract").where("law_title IS NOT NULL").select(F.col("law_title").alias("law"))
    return statutes.resolve_names(cited, names)


def check_citations(s: SparkSession, d: str) -> DataFrame:
    return statutes.check_citations(T(s, d, "contract"), T(s, d, "laws"))


def verify_nhsr(s: SparkSession, d: str) -> DataFrame:
    return statutes.verify(T(s, d, "contract"), T(s, d, "laws"))


def nearest_article(s: SparkSession, d: str) -> DataFrame:
    rows, _ = statutes.statute_index(T(s, d, "laws"))
    asked = extract_citations(s, d).select(F.col("law").alias("title"), "article")
    return statutes.nearest_article(asked, rows)


def available_citations(s: SparkSession, d: str) -> DataFrame:
    return statutes.available_citations(T(s, d, "chunks")).select("chunk_id", F.array_join("citations", "|").alias("citations"))


def chunk_articles(s: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_by_article(T(s, d, "laws"))


def raft_chunks(s: SparkSession, d: str) -> DataFrame:
    return chunking.raft_chunks(T(s, d, "laws")).select("law_id", "chunk_no", F.length("content").alias("chars"), F.array_join("articles", ",").alias("articles"))


def sentence_chunks(s: SparkSession, d: str) -> DataFrame:
    return T(s, d, "documents").select("doc_id", F.posexplode(chunking.sentence_chunks(F.coalesce("text", F.lit("")))).alias("chunk_no", "content"))


def minhash_sig16(s: SparkSession, d: str) -> DataFrame:
    sig = dedup.minhash_signature(T(s, d, "laws"), F.col("title"), "law_id", 16)
    return sig.select("law_id", F.array_join("sig", ",").alias("sig"))


def minhash_dedup(s: SparkSession, d: str) -> DataFrame:
    return dedup.minhash_dedup(T(s, d, "documents"), F.coalesce("text", F.lit("")), "doc_id", fast=True).select("doc_id")


def title_dedup(s: SparkSession, d: str) -> DataFrame:
    keyed = T(s, d, "laws").where("title IS NOT NULL").select("law_id", F.explode(F.array("title", F.coalesce("source_id", "title"))).alias("k"))
    return dedup.greedy_survivors(keyed, "law_id", "k")


def semantic_dedup(s: SparkSession, d: str) -> DataFrame:
    return dedup.semantic_dedup(T(s, d, "embeddings"), "embedding", "vec_id", 0.9).select("vec_id")


QUERIES = {f.__name__: f for f in (
    normalize_hash, exact_dedup, token_counts, title_version_dedup, preprocess_reasons, clean_laws, corpus_audit, article_totals, type_histogram, missing_titles, coverage_gap, national_laws, split_articles, cn_numeral,
    extract_citations, citation_count, statute_index, resolve_law, check_citations, verify_nhsr, nearest_article, available_citations, chunk_articles, raft_chunks, sentence_chunks, minhash_sig16, minhash_dedup, title_dedup, semantic_dedup,
)}

_NORM = r"regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]+', '', 'g')"
_STRIP = r"regexp_replace({}, '^[\s\x{{00A0}}\x{{2000}}-\x{{200A}}\x{{202F}}\x{{3000}}]+|[\s\x{{00A0}}\x{{2000}}-\x{{200A}}\x{{202F}}\x{{3000}}]+$', '', 'g')"


def _int(x: str) -> str:
    """SQL: the number of a well-formed numeral."""
    digit = "position({} in '一二三四五六七八九')"

    def unit(sign: str, size: int) -> str:
        before = f"regexp_extract({x}, '([一二两三四五六七八九]?){sign}', 1)"
        return f"CASE WHEN contains({x}, '{sign}') THEN {size} * CASE WHEN {before} = '' THEN 1 WHEN {before} = '两' THEN 2 ELSE {digit.format(before)} END ELSE 0 END"

    last = f"CASE right({x}, 1) WHEN '两' THEN 2 ELSE {digit.format(f'right({x}, 1)')} END"
    return f"(CASE WHEN regexp_full_match({x}, '[0-9]+') THEN try_cast({x} AS INTEGER) ELSE {unit('千', 1000)} + {unit('百', 100)} + {unit('十', 10)} + {last} END)"


_N = "零〇一二三四五六七八九十百千0-9"
_WS = r"[\s\x{00A0}\x{2000}-\x{200A}\x{202F}\x{3000}]"
_CITED = rf"""
    WITH raw AS (SELECT case_id, answer, regexp_extract_all(answer, '《([^》]{{2,30}}?)》{_WS}*第{_WS}*([{_N}]{{1,8}}){_WS}*条(?:{_WS}*第{_WS}*([{_N}]{{1,4}}){_WS}*[款项])?', 0) AS r FROM contract WHERE answer IS NOT NULL),
    one AS (SELECT case_id, answer, generate_subscripts(r, 1) AS p, unnest(r) AS r FROM raw),
    parts AS (SELECT case_id, answer, p, {_STRIP.format("regexp_extract(r, '《([^》]{2,30}?)》', 1)")} AS law, regexp_extract(r, '》{_WS}*第{_WS}*([{_N}]+)', 1) AS a,
                     regexp_extract(r, '条{_WS}*第{_WS}*([{_N}]+){_WS}*[款项]$', 1) AS b FROM one),
    cited AS (SELECT case_id, any_value(answer) AS answer, min(p) AS p, law, {_int('a')} AS article, CASE WHEN b = '' THEN -1 ELSE {_int('b')} END AS para FROM parts GROUP BY case_id, law, {_int('a')}, CASE WHEN b = '' THEN -1 ELSE {_int('b')} END)"""
_LINES = rf"""
    WITH lines AS (SELECT law_id, title, generate_subscripts(x, 1) AS p, {_STRIP.format('unnest(x)')} AS l FROM (SELECT law_id, title, regexp_split_to_array(content, '\r\n|\r|\n') AS x FROM laws WHERE content IS NOT NULL)),
    heads AS (SELECT *, regexp_extract(l, '^第{_WS}*([{_N}]{{1,8}}){_WS}*条', 1) AS h FROM lines WHERE l <> ''),
    runs AS (SELECT *, count(CASE WHEN h <> '' THEN 1 END) OVER (PARTITION BY law_id ORDER BY p) AS i FROM heads),
    arts AS (SELECT law_id, any_value(title) AS title, i::INTEGER AS pos, {_int("max(h)")} AS article, string_agg(l, chr(10) ORDER BY p) AS text FROM runs WHERE i > 0 GROUP BY law_id, i)"""
_INDEX = _LINES + """,
    ranked AS (SELECT *, max(law_id) OVER (PARTITION BY title) AS m FROM arts WHERE title IS NOT NULL AND title <> ''),
    idx AS (SELECT title, article, arg_max(text, pos) AS text FROM ranked WHERE law_id = m GROUP BY title, article),
    firsts AS (SELECT title, min(law_id) AS f FROM ranked GROUP BY title),
    pairs AS (SELECT title AS name, title, f FROM firsts UNION SELECT trim(replace(title, '中华人民共和国', '')), title, f FROM firsts),
    names AS (SELECT name, arg_min(title, f) AS title FROM pairs GROUP BY name)"""
_CITED_TAIL = _CITED.replace("WITH raw", "raw", 1)
_RESOLVED = """,
    asked AS (SELECT DISTINCT law FROM {src}),
    near AS (SELECT a.law, arg_max(f.title, (length(f.title), -f.f)) AS title FROM asked a JOIN firsts f ON contains(a.law, f.title) OR contains(f.title, a.law) GROUP BY a.law),
    resolved AS (SELECT a.law, coalesce(n.title, near.title, m.title) AS title FROM asked a LEFT JOIN names n ON n.name = a.law LEFT JOIN near ON near.law = a.law LEFT JOIN names m ON m.name = trim(replace(a.law, '中华人民共和国', '')))"""
_CHECKED = _INDEX + ", " + _CITED_TAIL + _RESOLVED.format(src="cited") + r""",
    scored AS (SELECT c.case_id, c.p, c.law, c.article, c.para, r.title, i.text IS NOT NULL AS ok,
                      list_distinct(regexp_extract_all(c.answer, '[零〇一二两三四五六七八九十百千万0-9]{1,6}(?:倍|年|个月|月|日|天|元|万|%|％|小时|周)')) AS q, i.text
               FROM cited c LEFT JOIN resolved r USING (law) LEFT JOIN idx i ON i.title = r.title AND i.article = c.article),
    checked AS (SELECT *, CASE WHEN ok THEN CASE WHEN len(q) = 0 THEN 1.0::DOUBLE ELSE len(list_filter(q, lambda z: contains(text, z)))::DOUBLE / len(q) END END AS score FROM scored)"""
_TYPES = ", ".join(f"'{t}'" for t in legal.NATIONAL_TYPES)

SQL = {
    "normalize_hash": f"SELECT doc_id, length({_NORM.format('text')})::INTEGER AS n, sha256({_NORM.format('text')}) AS h FROM documents",
    "exact_dedup": f"SELECT min(doc_id) AS doc_id FROM documents GROUP BY {_NORM.format(chr(99) + 'oalesce(text, ' + chr(39) * 2 + ')')}",
    "title_version_dedup": "SELECT law_id, title, publish_date FROM laws WHERE title <> '' QUALIFY row_number() OVER (PARTITION BY title ORDER BY coalesce(publish_date, '') DESC, law_id) = 1",
    "corpus_audit": _LINES + r""", n AS (SELECT law_id, count(*) AS k FROM arts GROUP BY law_id)
        SELECT count(*) AS laws, coalesce(sum(k), 0)::BIGINT AS articles, count_if(k IS NULL) AS no_articles, count_if(coalesce(trim(title), '') = '') AS no_title, count_if(trim(coalesce(content, '')) = '') AS no_content, count_if(length(trim(coalesce(content, ''))) BETWEEN 1 AND 49) AS short,
               count_if(regexp_matches(coalesce(content, ''), '<[a-z]+[ >]')) AS html, count_if(contains(coalesce(content, ''), chr(65533))) AS mojibake,
               min(CASE WHEN regexp_matches(publish_date, '^[0-9]{4}') THEN publish_date END) AS first_date, max(CASE WHEN regexp_matches(publish_date, '^[0-9]{4}') THEN publish_date END) AS last_date,
               count(title) - count(DISTINCT title) AS repeated_titles FROM laws LEFT JOIN n USING (law_id)""",
    "article_totals": _LINES + " SELECT l.law_id, count(a.pos)::INTEGER AS n_articles FROM laws l LEFT JOIN arts a USING (law_id) GROUP BY l.law_id",
    "type_histogram": "SELECT type AS value, count(*) AS rows_count, round(count(*) / sum(count(*)) OVER (), 6)::DOUBLE AS share FROM laws GROUP BY type",
    "missing_titles": "SELECT DISTINCT law_title AS title FROM contract WHERE law_title IS NOT NULL AND law_title NOT IN (SELECT title FROM laws WHERE title IS NOT NULL)",
    "coverage_gap": "SELECT law_type AS type, max_chars AS official, n AS have, max_chars - n AS gap FROM (SELECT s.law_type, s.max_chars, count(l.law_id) AS n FROM split_limits s LEFT JOIN laws l ON l.type = s.law_type WHERE s.law_type IS NOT NULL GROUP BY s.law_type, s.max_chars)",
    "national_laws": f"SELECT law_id FROM laws WHERE type IN ({_TYPES}) AND trim(status) = '有效'",
    "split_articles": _LINES + " SELECT law_id, pos, article, sha256(text) AS h FROM arts",
    "extract_citations": _CITED + " SELECT case_id, law, article, para FROM cited",
    "citation_count": r"""SELECT case_id, len(regexp_extract_all(coalesce(answer, ''), '《[^》]{2,20}》\s*第\s*[0-9一二三四五六七八九十百零〇]+\s*条'))::INTEGER AS loose,
        len(list_distinct(regexp_extract_all(coalesce(answer, ''), '[零〇一二两三四五六七八九十百千万0-9]{1,6}(?:倍|年|个月|月|日|天|元|万|%|％|小时|周)')))::INTEGER AS quantities FROM contract""",
    "statute_index": _INDEX + " SELECT title, article, sha256(text) AS h FROM idx",
    "resolve_law": _INDEX + _RESOLVED.format(src="(SELECT law_title AS law FROM contract WHERE law_title IS NOT NULL)") + " SELECT law, title FROM resolved",
    "verify_nhsr": _CHECKED + " SELECT c.case_id, count(k.law) AS total, count(*) FILTER (WHERE k.score >= 0.5) AS valid, count(k.law) - count(*) FILTER (WHERE k.score >= 0.5) AS invalid, CASE WHEN count(k.law) > 0 THEN round(count(*) FILTER (WHERE k.score >= 0.5)::DOUBLE / count(k.law), 6) END AS nhsr FROM contract c LEFT JOIN checked k USING (case_id) GROUP BY c.case_id",
    "nearest_article": _INDEX + ", " + _CITED_TAIL + ", want AS (SELECT DISTINCT law AS title, article AS wanted FROM cited) SELECT w.title, w.wanted, arg_min(i.article, (abs(i.article - w.wanted), i.article)) AS article FROM want w JOIN idx i ON i.title = w.title GROUP BY w.title, w.wanted",
    "minhash_sig16": rf"""
        WITH n AS (SELECT law_id, {_NORM.format('title')} AS t FROM laws), g AS (SELECT law_id, substr(t, unnest(range(1, length(t) - 3)), 5) AS g FROM n WHERE length(t) >= 5),
        m AS (SELECT law_id, k, min(('0x' || substr(md5(k || ':' || g), 1, 8))::BIGINT) AS v FROM g, range(16) r(k) GROUP BY law_id, k)
        SELECT l.law_id, CASE WHEN count(m.k) = 0 THEN array_to_string(list_resize([0], 16, 0), ',') ELSE string_agg(v::VARCHAR, ',' ORDER BY k) END AS sig FROM laws l LEFT JOIN m USING (law_id) GROUP BY l.law_id""",
}


def _digit(size: int, sign: str) -> str:
    d = f"(n // {size} % 10)"
    one = "'十'" if sign == "十" else "'一' || '" + sign + "'"
    return f"CASE {d} WHEN 0 THEN '' WHEN 1 THEN {one} ELSE substr('一二三四五六七八九', {d}::INTEGER, 1) || '{sign}' END"


_CHUNK_CITED = _CITED.replace("FROM contract WHERE", "FROM (SELECT chunk_id AS case_id, content AS answer FROM chunks) WHERE")
SQL |= {
    "cn_numeral": f"SELECT p_partkey, CASE WHEN n = 0 THEN '零' ELSE {_digit(1000, '千')} || {_digit(100, '百')} || {_digit(10, '十')} || CASE n % 10 WHEN 0 THEN '' ELSE substr('一二三四五六七八九', (n % 10)::INTEGER, 1) END END AS numeral, n::INTEGER AS number FROM (SELECT p_partkey, p_partkey % 10000 AS n FROM part)",
    "check_citations": _CHECKED + " SELECT case_id, (row_number() OVER (PARTITION BY case_id ORDER BY p) - 1)::INTEGER AS pos, law, article, nullif(para, -1) AS para, title, title IS NOT NULL AS name_matched, ok AS article_exists, round(score, 6) AS content_score, coalesce(score >= 0.5, false) AS valid FROM checked",
    "available_citations": _CHUNK_CITED + ", names AS (SELECT DISTINCT case_id, '《' || law || '》第' || article || '条' AS s FROM cited) SELECT c.chunk_id, coalesce(string_agg(s, '|' ORDER BY s), '') AS citations FROM chunks c LEFT JOIN names n ON n.case_id = c.chunk_id GROUP BY c.chunk_id",
    "token_counts": rf"""
        WITH t AS (SELECT chunk_id, coalesce(content, '') AS c, regexp_replace(coalesce(content, ''), '[^一-鿿]+', '', 'g') AS han FROM chunks)
        SELECT chunk_id, (greatest(length(han) - 1, 0) + len(regexp_extract_all(c, '[一-鿿]{{2,6}}')) + len(regexp_extract_all(c, '[a-zA-Z0-9]+(?:\.[a-zA-Z0-9]+)*')))::INTEGER AS n_tokens,
               len(list_filter(regexp_extract_all(c, '[^。！？；.!?;\n]*[。！？；.!?;\n]|[^。！？；.!?;\n]+'), lambda x: {_STRIP.format("x")} <> ''))::INTEGER AS n_sentences FROM t""",
}
