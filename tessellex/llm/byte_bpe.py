"""Problem 6: every text as the ids of a public byte-level BPE vocabulary.

Texts are split into words by Spark. Within each partition DuckDB does the rest, per batch of texts:

1. The distinct words are cut where no merge can ever reach across: between two characters whose meeting
   bytes stand side by side in no token of the vocabulary. That is exact, since a merge only ever makes a
   token of the vocabulary. A run of ideographs falls into single characters, so that a whole batch has
   only some thousand distinct segments.
2. A recursive query holds the segments as token-position rows, joins neighbours with the merge table and
   contracts each segment's leftmost pair of least rank, until no pair of it is in the table.
3. Ordered aggregation puts segments' ids together to words' and words' to texts'.

The vocabulary goes to the executors as one broadcast of the file's own size (a megabyte or so).
"""

from __future__ import annotations

import functools
import heapq
import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table

#: Where the public tokenizers are.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: The largest vocabulary file that is broadcast.
MAX_VOCABULARY_BYTES = 64 << 20
#: Fixed value: the public pattern that splits text into words, with Unicode classes.
PATTERN = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Segments of more bytes are merged with a heap, since the recursion keeps all of its states.
LONG_SEGMENT = 600
#: Known segments that a worker keeps between batches.
KEPT_SEGMENTS = 300_000
#: MB that DuckDB may use in a worker.
MEMORY_MB = 500


def byte_symbols() -> dict[str, int]:
    """The printable stand-in of every byte in the vocabulary's file: itself if it is printable, else the next code above 255."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """The merge table and the cuts of a byte-level BPE file."""

    def __init__(self, content: bytes) -> None:
        model = json.loads(content)["model"]
        symbols, ids = byte_symbols(), model["vocab"]
        self.byte_ids = {symbols[s]: ids[s] for s in symbols if s in ids}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        beside: set[tuple[int, int]] = set()
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[ids[a], ids[b]] = (rank, ids[a + b])
            whole = [symbols[c] for c in a + b]
            beside.update(zip(whole, whole[1:]))
        self.segments = self._segment_pattern(beside)

    @staticmethod
    def _segment_pattern(beside: set[tuple[int, int]]) -> str:
        """A pattern that takes a word's next segment.

        C are the ideographs (three bytes, lead byte E4 to E9); N are those of them whose last byte stands
        in no token right before such a lead byte. A segment ends after an N that a C follows.
        """
        risky = {x & 0x3F for x, y in beside if x >= 0x80 and 0xE4 <= y <= 0xE9}
        safe, start = [], None
        for code in range(0x4E00, 0xA001):
            if code < 0xA000 and code & 0x3F not in risky:
                start = code if start is None else start
            elif start is not None:
                safe.append((start, code - 1))
                start = None
        n = "".join(f"{chr(a)}-{chr(b)}" for a, b in safe)
        c = "一-鿿"
        return f"(?s)(?:[^{n}]*[{n}][^{c}])*[^{n}]*(?:[{n}]|\\z)"

    def merge(self, word: bytes) -> list[int]:
        """The ids of one segment, with a heap of its pairs; for long segments."""
        ids = [self.byte_ids[b] for b in word]
        after, before = [*range(1, len(ids)), -1], [*range(-1, len(ids) - 1)]
        heap = [(*self.merges[p], k, p) for k, p in enumerate(zip(ids, ids[1:])) if p in self.merges]
        heap = [(rank, k, new, p) for rank, new, k, p in heap]
        heapq.heapify(heap)
        while heap:
            rank, k, new, pair = heapq.heappop(heap)
            n = after[k]
            if ids[k] < 0 or n < 0 or (ids[k], ids[n]) != pair:
                continue
            ids[k], ids[n], after[k] = new, -1, after[n]
            if after[k] >= 0:
                before[after[k]] = k
            for left in (before[k], k):
                if left >= 0 and after[left] >= 0 and (p := (ids[left], ids[after[left]])) in self.merges:
                    heapq.heappush(heap, (self.merges[p][0], left, self.merges[p][1], p))
        return [x for x in ids if x >= 0]


#: The recursion: rows (s, pos, tok) of segments; a step keeps only segments that still contract.
_CONTRACT = """
    WITH RECURSIVE step(s, round, pos, tok) AS (
        SELECT s, 0, pos, tok FROM start_rows
        UNION ALL
        SELECT s, round + 1, row_number() OVER (PARTITION BY s ORDER BY pos), CASE WHEN pos = spot THEN made ELSE tok END
        FROM (SELECT s, round, pos, tok, best % 1048576 AS spot, min(CASE WHEN pos = best % 1048576 THEN new END) OVER (PARTITION BY s) AS made
              FROM (SELECT s, round, pos, tok, new, min(rank * 1048576 + pos) OVER (PARTITION BY s) AS best
                    FROM (SELECT *, lead(tok) OVER (PARTITION BY s ORDER BY pos) AS nxt FROM step) LEFT JOIN merges ON tok = a AND nxt = b)
              WHERE best IS NOT NULL)
        WHERE pos <> spot + 1)
    SELECT s, list(tok ORDER BY pos) AS ids
    FROM (SELECT *, max(round) OVER (PARTITION BY s) AS last FROM step) WHERE round = last GROUP BY s"""


class Encoder:
    """DuckDB with the merge table, in one Python worker."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        import duckdb

        self.vocabulary = vocabulary
        self.db = db = duckdb.connect(config={"threads": 1, "memory_limit": f"{MEMORY_MB}MB", "temp_directory": ""})
        items = vocabulary.merges.items()
        merges = pa.table({"a": [p[0] for p, _ in items], "b": [p[1] for p, _ in items], "rank": [m[0] for _, m in items], "new": [m[1] for _, m in items]})
        db.register("merges_in", merges)
        db.execute("CREATE TABLE merges AS SELECT a::INTEGER a, b::INTEGER b, rank::BIGINT rank, new::INTEGER new FROM merges_in")
        db.register("bytes_in", pa.table({"h": [f"{b:02X}" for b in vocabulary.byte_ids], "tok": [*vocabulary.byte_ids.values()]}))
        db.execute("CREATE TABLE byte_ids AS SELECT h, tok::INTEGER tok FROM bytes_in")
        db.execute("CREATE TABLE known(seg VARCHAR, ids INTEGER[])")

    def _learn(self) -> None:
        """Adds the ids of the segments in ``todo`` to ``known``."""
        db = self.db
        db.execute("CREATE OR REPLACE TEMP TABLE fresh AS SELECT row_number() OVER () AS s, seg, hex(encode(seg)) AS h FROM todo")
        db.execute(f"""
            CREATE OR REPLACE TEMP TABLE start_rows AS
            SELECT s, pos, tok
            FROM (SELECT s, h, unnest(range(1, length(h) // 2 + 1)) AS pos FROM fresh WHERE length(h) <= {2 * LONG_SEGMENT}) f
            JOIN byte_ids b ON b.h = f.h[2 * pos - 1 : 2 * pos]""")
        db.execute(f"INSERT INTO known SELECT seg, ids FROM ({_CONTRACT}) JOIN fresh USING (s)")
        for (seg,) in db.execute(f"SELECT seg FROM fresh WHERE length(h) > {2 * LONG_SEGMENT}").fetchall():
            db.execute("INSERT INTO known VALUES (?, ?)", [seg, self.vocabulary.merge(seg.encode())])

    def encode(self, words: pa.Array) -> pa.Array:
        """The ids of texts, each given as the list of its words."""
        db = self.db
        db.register("texts", pa.table({"r": pa.array(range(len(words)), pa.int64()), "words": words}))
        if db.execute("SELECT count(*) FROM known").fetchone()[0] > KEPT_SEGMENTS:
            db.execute("DELETE FROM known")
        db.execute("CREATE OR REPLACE TEMP TABLE placed AS SELECT r, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM texts")
        db.execute("CREATE OR REPLACE TEMP TABLE words AS SELECT row_number() OVER () AS w, word FROM (SELECT DISTINCT word FROM placed)")
        db.execute("CREATE OR REPLACE TEMP TABLE parts AS SELECT w, unnest(segs) AS seg, generate_subscripts(segs, 1) AS pos FROM (SELECT w, regexp_extract_all(word, ?) AS segs FROM words)", [self.vocabulary.segments])
        db.execute("CREATE OR REPLACE TEMP TABLE todo AS SELECT DISTINCT seg FROM parts WHERE seg <> '' AND seg NOT IN (SELECT seg FROM known)")
        self._learn()
        db.execute("CREATE OR REPLACE TEMP TABLE coded AS SELECT word, ids FROM (SELECT w, flatten(list(ids ORDER BY pos)) AS ids FROM parts JOIN known USING (seg) GROUP BY w) JOIN words USING (w)")
        out = db.sql("SELECT coalesce(ids, []::INTEGER[]) AS ids FROM texts LEFT JOIN (SELECT r, flatten(list(ids ORDER BY pos)) AS ids FROM placed JOIN coded USING (word) GROUP BY r) USING (r) ORDER BY r").to_arrow_table()
        column = out.column("ids").combine_chunks()
        return column.chunk(0) if isinstance(column, pa.ChunkedArray) else column


@functools.lru_cache(1)
def _encoder(content: bytes) -> Encoder:
    return Encoder(Vocabulary(content))


def load_vocabulary(path: str = VOCABULARY) -> bytes:
    """The bytes of a vocabulary file, if it is small enough to be broadcast."""
    with open(path, "rb") as file:
        content = file.read(MAX_VOCABULARY_BYTES + 1)
    if len(content) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} has more than {MAX_VOCABULARY_BYTES} bytes")
    return content


def encode_texts(rows: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, lengths_only: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """(``key``, ids ARRAY<INT>) of every row, repeated ones too; the empty list for an empty and for a null text.

    No special tokens: their strings are ordinary text. Texts are taken whole, however long. Columns in
    ``keep`` come along; further columns of ``rows`` are ignored, whatever their names. The key's type is
    kept and it may be null. With ``lengths_only`` the result has tokens BIGINT in place of ids.
    """
    shared = rows.sparkSession.sparkContext.broadcast(load_vocabulary(vocabulary))
    cells = F.coalesce(F.regexp_extract_all(F.col(text), F.lit(PATTERN), F.lit(0)), F.array().cast("array<string>"))
    own = [key, *keep]
    words = rows.select(*[F.col(c) for c in own], cells.alias("_words"))
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        for batch in batches:
            ids = encoder.encode(batch.column(len(own)))
            if lengths_only:
                out = pc.list_value_length(ids).cast(pa.int64())
            else:
                out = ids.cast(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(own)], out], [*own, "tokens" if lengths_only else "ids"])

    return words.mapInArrow(run, schema + (", tokens bigint" if lengths_only else ", ids array<int>"))


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode_texts(table(spark, folder, "documents"))


QUERIES = {"p6_ids": p6_ids}
SQL: dict[str, str] = {}
