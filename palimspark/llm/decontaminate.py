"""Benchmark passages in a corpus: n-grams of test items as a broadcast hash set, document windows scanned against it.

Texts are cut into normalised words (A-Z lower-cased; everything that is neither an ASCII letter or digit nor beyond ASCII
separates). A window is WINDOW consecutive words of an item; an item of fewer words is one window. Three steps, all Columns:

1. Windows of the benchmark become a table (words joined by a space, hash, items that hold them) and a filter: an array
   of bits, two for each window's hash, which enters the scan as a constant of at most MAX_BITS bits.
2. One pass over the documents hashes every window of theirs and keeps those whose two bits are set. The pass is
   narrow; what leaves it are word counts and the few candidates, written without the text.
3. Candidates meet the table by their words, not by their hash, so a hit is verified by the join itself. The table is
   broadcast up to BROADCAST_WINDOWS windows and shuffled beyond, with equal results. Hits of a document unite into
   spans of words.

The number of documents that hold a window doesn't matter: the scan joins nothing, and the hits of a document are grouped
by its row.

Defined results: null texts and texts without words have no words and no hits; a null doc_id is a value like another;
each row is judged by itself, so repeated rows give repeated rows; an item without words is never found; items of one id count
as one; an item without id marks words but isn't listed or counted; texts of any length are read whole; an empty
benchmark hits nothing and an empty table gives an empty table; other columns are passed through by ``remove_spans`` and
``remove_documents`` whatever their names, and ignored by ``scan``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, ascii_lower

WINDOW = 10
#: Fixed value: what separates words.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BROADCAST_WINDOWS = 2_000_000
BITS_A_WINDOW = 64
MIN_BITS, MAX_BITS = 1 << 12, 1 << 20

ROW = "_contamination_row"
WORDS = "_contamination_words"
FOUND = "_contamination_found"
ITEMS = "array<string>"


def words_of(text: Column) -> Column:
    """The normalised words of a text; none for null."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), BREAK, -1), "")


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """gram, length, hash and the ids of the items (as strings) of every distinct window."""
    cut = benchmark.select(F.col(item_id).cast("string").alias("item"), words_of(F.col(text)).alias("words")).where(F.size("words") > 0)
    sized = cut.withColumn("length", F.least(F.size("words"), F.lit(window)))
    placed = sized.select("item", "length", "words", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("length") + 1)).alias("at"))
    grams = placed.select("item", "length", F.slice("words", F.col("at"), F.col("length")).alias("gram"))
    rows = grams.select("item", "length", F.array_join("gram", " ").alias("gram"), F.xxhash64("gram").alias("hash"))
    return rows.groupBy("gram", "length", "hash").agg(F.collect_set("item").alias("items"))


def _bits(windows: DataFrame, n_windows: int) -> tuple[Column, int]:
    """The filter as a constant array of longs, and its number of bits: a power of two, at most MAX_BITS."""
    size = MIN_BITS
    while size < BITS_A_WINDOW * n_windows and size < MAX_BITS:
        size *= 2
    bit = F.explode(F.array(*_places(F.col("hash"), size)))
    longs = windows.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("long"))
    found = {row["at"]: row["long"] for row in longs.collect()}  # at most MAX_BITS / 64 rows
    return F.from_json(F.lit(str([found.get(i, 0) for i in range(size // 64)])), "array<bigint>"), size


def _places(hashed: Column, size: int) -> list[Column]:
    return [hashed.bitwiseAND(F.lit(size - 1)), F.shiftrightunsigned(hashed, 40).bitwiseAND(F.lit(size - 1))]


CANDIDATES = "array<struct<at:int,length:int,gram:string>>"


def _known(length: int, bits: Column, size: int):
    """Whether both bits of the window of ``length`` words at a place are set."""

    def test(at: Column) -> Column:
        places = _places(F.xxhash64(F.slice(WORDS, at, length)), size)
        first, second = (F.getbit(F.get(bits, F.shiftright(p, 6).cast("int")), p.bitwiseAND(F.lit(63)).cast("int")) == 1 for p in places)
        return first & second

    return test


def _spelled(length: int):
    return lambda at: F.struct((at - 1).alias("at"), F.lit(length).alias("length"), F.array_join(F.slice(WORDS, at, length), " ").alias("gram"))


def _candidates(lengths: list[int], bits: Column, size: int) -> Column:
    """Start, length and words of the windows of a row whose bits are set."""
    none = F.array().cast(CANDIDATES)
    parts = []
    for length in lengths:
        last = F.size(WORDS) - length + 1
        found = F.transform(F.filter(F.sequence(F.lit(1), last), _known(length, bits, size)), _spelled(length))
        parts.append(F.when(last > 0, found).otherwise(none))
    return F.concat(*parts) if parts else none


def _spans(places: Column) -> Column:
    """Maximal stretches of hit words, from the sorted array of their numbers."""
    starts = F.filter(places, lambda p, k: F.coalesce(F.get(places, k - 1) < p - 1, F.lit(True)))
    ends = F.filter(places, lambda p, k: F.coalesce(F.get(places, k + 1) > p + 1, F.lit(True)))
    return F.zip_with(starts, ends, lambda a, b: F.struct(a.cast("long").alias("start"), (b - a + 1).cast("long").alias("length")))


def _scanned(docs: DataFrame, benchmark: DataFrame, keep: list[str], window: int, text: str, scratch: Scratch) -> DataFrame:
    """``keep`` columns of every row with ROW, n_words, n_hit, spans and items."""
    windows = scratch.written(benchmark_windows(benchmark, window), "benchmark-windows")
    sizes = windows.groupBy("length").count().collect()  # one row for each length up to the window's
    n_windows = sum(row["count"] for row in sizes)
    bits, size = _bits(windows, n_windows)
    cut = docs.withColumns({ROW: F.monotonically_increasing_id(), WORDS: words_of(F.col(text))})
    found = _candidates(sorted(row["length"] for row in sizes), bits, size)
    scanned = scratch.written(cut.select(*keep, ROW, F.size(WORDS).cast("long").alias(f"{WORDS}_n"), found.alias(FOUND)), "window-candidates")
    met = scanned.where(F.size(FOUND) > 0).select(ROW, F.explode(FOUND).alias("c")).select(ROW, "c.*")
    table = windows.select("gram", "items")
    hits = met.join(F.broadcast(table) if n_windows <= BROADCAST_WINDOWS else table, "gram")
    grouped = hits.groupBy(ROW).agg(F.collect_set(F.struct("at", "length")).alias("at"), F.collect_set("items").alias("items"))
    places = F.array_sort(F.array_distinct(F.flatten(F.transform("at", lambda s: F.sequence(s["at"], s["at"] + s["length"] - 1)))))
    united = grouped.select(ROW, places.alias("places"), F.array_sort(F.array_distinct(F.flatten("items"))).alias("items"))
    spans = united.select(F.col(ROW).alias(f"{ROW}_hit"), F.size("places").cast("long").alias("n"), _spans(F.col("places")).alias("spans"), "items")
    joined = scanned.drop(FOUND).join(spans, F.col(ROW) == F.col(f"{ROW}_hit"), "left")
    return joined.select(
        *(scanned[c] for c in [*keep, ROW]),
        F.col(f"{WORDS}_n").alias("_contamination_n_words"),
        F.coalesce(spans["n"], F.lit(0)).cast("long").alias("_contamination_n_hit"),
        F.coalesce(spans["spans"], F.array().cast("array<struct<start:bigint,length:bigint>>")).alias("_contamination_spans"),
        F.coalesce(spans["items"], F.array().cast(ITEMS)).alias("_contamination_items"),
    )


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit (words inside any occurrence of a window), spans (start and length in words), items and contaminated."""
    own = docs.select(F.col("doc_id"), F.col(text).alias("text"))
    found = _scanned(own, benchmark, ["doc_id"], window, "text", Scratch(docs.sparkSession))
    return found.select("doc_id", F.col("_contamination_n_words").alias("n_words"), F.col("_contamination_n_hit").alias("n_hit"), F.col("_contamination_spans").alias("spans"), F.col("_contamination_items").alias("items"), (F.col("_contamination_n_hit") > 0).alias("contaminated"))


def remove_documents(docs: DataFrame, benchmark: DataFrame, most_percent: float = 0.0, window: int = WINDOW, text: str = "text") -> DataFrame:
    """``docs`` without the rows of whose words more than ``most_percent`` are hit."""
    found = _scanned(docs, benchmark, docs.columns, window, text, Scratch(docs.sparkSession))
    return found.where(100 * F.col("_contamination_n_hit") <= most_percent * F.col("_contamination_n_words")).select(docs.columns)


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text") -> DataFrame:
    """``docs`` with the hit words, and what stands between and right behind them, cut out of the text; n_chars follows."""
    found = _scanned(docs, benchmark, docs.columns, window, text, Scratch(docs.sparkSession))
    return _without(found, docs.columns, text)


def _without(found: DataFrame, columns: list[str], text: str) -> DataFrame:
    separator = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # as BREAK, before lower-casing
    word = separator.replace("[", "[^", 1)
    head = F.regexp_extract(F.col(text), f"^(?:{separator})?", 0)
    found = found.withColumn("_contamination_pieces", F.when(F.size("_contamination_spans") > 0, F.regexp_extract_all(F.col(text).cast("string"), F.lit(f"{word}(?:{separator})?"), F.lit(0))))
    ends = F.transform("_contamination_spans", lambda s: s["start"] + s["length"])
    froms = F.concat(F.array(F.lit(0).cast("long")), ends)
    untils = F.concat(F.transform("_contamination_spans", lambda s: s["start"]), F.array(F.size("_contamination_pieces").cast("long")))
    kept = F.zip_with(froms, untils, lambda a, b: F.array_join(F.slice("_contamination_pieces", (a + 1).cast("int"), (b - a).cast("int")), ""))
    changed = F.when(F.size("_contamination_spans") > 0, F.concat(head, F.array_join(kept, ""))).otherwise(F.col(text))
    out = found.withColumn("_contamination_changed", changed)
    cells = [F.col("_contamination_changed").alias(c) if c == text else (F.when(F.size("_contamination_spans") > 0, F.length("_contamination_changed")).otherwise(F.col(c)).cast("long").alias(c) if c == "n_chars" else F.col(c)) for c in columns]
    return out.select(*cells)


def item_digests(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of what ``scan`` gives."""
    joined = F.array_join(F.array_sort("items"), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(joined, 256).alias("items_sha256"), "contaminated")


def oracle() -> str:
    """The same for DuckDB, by exploding all windows."""
    word = BREAK.replace("[", "[^", 1)
    words = lambda t: f"regexp_extract_all(translate(coalesce({t}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{word}')"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {words("text")} AS ws FROM documents),
b AS (SELECT item_id, ws, least(len(ws), {WINDOW}) AS n FROM (SELECT item_id, {words("text")} AS ws FROM benchmark) WHERE len(ws) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(ws[i : i + n - 1], ' ') AS g FROM (SELECT item_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM b)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT rid, i, n, array_to_string(ws[i : i + n - 1], ' ') AS g
       FROM (SELECT rid, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d JOIN lens ON len(ws) >= n)),
met AS (SELECT rid, i, dw.n, item_id FROM dw JOIN bw USING (g)),
words AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM met) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS joined
          FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS s FROM met WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(joined, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)"""
