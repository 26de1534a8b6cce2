"""Repeated lines across a corpus, exact and within one edit, by a deletion-neighbourhood join.

Lines (cut at line feeds, spaces around them taken off) of at least MIN_CHARS characters are compared; shorter
ones are always kept. Exact repeats count at any of these lengths, and so does one edit; a caller may ask for a least
length of either (``min_chars``, ``near_chars``).
Equal lines are one node, numbered by their earliest occurrence (doc_id, then position).
Two lines are within one edit exactly if one equals the other with a character deleted, or both agree after
deleting the character at the same position. So every line emits hashed keys: itself, and itself without
each of its characters together with the position. The earliest line of a key and position, and the line
that a key spells, are the only partners that have to be looked at, so no bucket is expanded into pairs; the
earliest partner is then verified by edit distance. An occurrence is dropped if its text occurs earlier or a
text within one edit does.

Most lines have no such partner, and a line of n characters emits n keys. An edit leaves the first or the last
half of a line alone; lines that share no half with another line of fitting length are left out
beforehand, which loses no pair.

Defined results: null and empty texts have no lines; a null doc_id sorts first; rows of one id (or none) with different
texts are documents of their own, in the order of a hash of the text; repeated rows of one id and text count as one
document (each keeps what the other keeps); an empty table gives an empty table; other columns are passed through by
``dedup_lines`` and ignored otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import slices
from .shared import Scratch

MIN_CHARS = 1
#: Shortest line that one edit makes equal to another; 1 is the exact form.
NEAR_CHARS = 1
SPACES = " \t\n\x0b\x0c\r"
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Characters whose keys a task emits at one time.
CHUNK = 200_000


def text_hash() -> Column:
    """With doc_id it names a row: rows of one id, or without one, may have different texts."""
    return F.xxhash64(F.col("text").cast("string"))


def same_row(doc_id: Column) -> Column:
    return doc_id.eqNullSafe(F.col("_id")) & (text_hash() == F.col("_text"))


def lines_of(text: str | None, min_chars: int) -> list[tuple[int, str]]:
    """Positions and contents of the lines that are compared."""
    if not text:
        return []
    cut = ((i, line.strip(SPACES)) for i, line in enumerate(text.split("\n")))
    return [(i, line) for i, line in cut if len(line) >= min_chars]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _identity(line: str) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(line.encode("utf-8", "surrogatepass"))
    return _signed(h >> 64), _signed(h & (1 << 64) - 1)


def half_keys(line: str) -> list[int]:
    """Hashes of both halves: as a line of its length, and as the longer one of a pair of lengths."""
    n, out = len(line), []
    for short in (n, n - 1):
        half = short // 2
        for part in (line[:half], line[n - (short - half) :]):
            out.append(_signed(xxhash.xxh3_64_intdigest(part.encode("utf-8", "surrogatepass"), seed=short)))
    return out


def deletion_hashes(line: str) -> np.ndarray:
    """64-bit hashes of the line without its character 0, 1, ..., and last of the whole line."""
    points = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    x = (points + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(x), _BASE, dtype=np.uint64)]), dtype=np.uint64)
    sums = np.concatenate([[np.uint64(0)], np.cumsum((x ^ (x >> np.uint64(29))) * powers[:-1], dtype=np.uint64)])
    return np.concatenate([sums[:-1] + (sums[-1] - sums[1:]) * np.uint64(_INVERSE), sums[-1:]])


def line_table(docs: DataFrame, min_chars: int = MIN_CHARS, near_chars: int = NEAR_CHARS) -> DataFrame:
    """doc_id, text_hash, pos, h1, h2 (identity of the line) and its half keys (none in short lines), one row per compared line. Narrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                ids, own, at, h1, h2, keys = [], [], [], [], [], []
                for doc_id, row, text in zip(part.column("doc_id").to_pylist(), part.column("text_hash").to_pylist(), part.column("text").to_pylist(), strict=True):
                    for i, line in lines_of(text, min_chars):
                        a, b = _identity(line)
                        ids.append(doc_id), own.append(row), at.append(i), h1.append(a), h2.append(b), keys.append(half_keys(line) if len(line) >= near_chars else [])
                columns = [pa.array(ids, pa.int64()), pa.array(own, pa.int64()), pa.array(at, pa.int32()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "pos", "h1", "h2", "keys"])

    return docs.select("doc_id", text_hash().alias("text_hash"), "text").mapInArrow(run, "doc_id long, text_hash long, pos int, h1 long, h2 long, keys array<long>")


def _contents(docs: DataFrame, wanted: DataFrame, min_chars: int) -> DataFrame:
    """node and line for ``wanted`` (node, doc_id, pos, h1, h2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                nodes, lines = [], []
                for text, want in zip(part.column("text").to_pylist(), part.column("want").to_pylist(), strict=True):
                    own = dict(lines_of(text, min_chars))
                    for w in want:
                        line = own.get(w["pos"])
                        if line is not None and _identity(line) == (w["h1"], w["h2"]):
                            nodes.append(w["node"]), lines.append(line)
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(lines, pa.string())], ["node", "line"])

    per_doc = wanted.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_text")).agg(F.collect_list(F.struct("node", "pos", "h1", "h2")).alias("want"))  # at most the lines of one document
    found = docs.join(per_doc, same_row(F.col("doc_id"))).select("text", "want").mapInArrow(run, "node long, line string")
    return found.dropDuplicates(["node"])


def deletion_keys(contents: DataFrame) -> DataFrame:
    """key, position (-1: the line itself) and node of every variant of every line of ``contents`` (node, line)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, line in zip(batch.column("node").to_pylist(), batch.column("line").to_pylist(), strict=True):
                keys = deletion_hashes(line).view(np.int64)
                places = np.arange(len(keys), dtype=np.int32)
                places[-1] = -1
                for i in range(0, len(keys), CHUNK):
                    own = keys[i : i + CHUNK]
                    yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(places[i : i + CHUNK]), pa.array(np.full(len(own), node, dtype=np.int64))], ["key", "place", "node"])

    return contents.mapInArrow(run, "key long, place int, node long")


def near_lines(contents: DataFrame, scratch: Scratch, by_bytes: bool = False) -> DataFrame:
    """node and its earliest partner, for lines that have an earlier one within one edit."""
    if by_bytes:  # a character for each byte
        contents = contents.select("node", F.decode(F.encode("line", "UTF-8"), "ISO-8859-1").alias("line"))
    keys = deletion_keys(contents)
    several = keys.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.min(F.when(F.col("place") < 0, F.col("node"))).alias("spelled")).filter("lo < hi")
    several = scratch.written(several.drop("hi"), "shared-keys")  # a table of its own, so that Spark can split frequent keys in the join
    met = scratch.written(keys.join(several, "key"), "line-keys")
    same_place = met.filter("place >= 0").groupBy("key", "place").agg(F.min("node").alias("partner"))
    swapped = met.select("key", "place", "node").join(same_place, ["key", "place"]).select("node", "partner")
    shorter = met.filter("place >= 0 and spelled is not null").select("node", F.col("spelled").alias("partner"))
    longer = met.filter("place < 0").select("node", F.col("lo").alias("partner"))
    best = swapped.unionByName(shorter).unionByName(longer).filter("partner < node").groupBy("node").agg(F.min("partner").alias("partner"))
    a, b = contents.select("node", F.col("line").alias("_a")), contents.select(F.col("node").alias("partner"), F.col("line").alias("_b"))
    return best.join(a, "node").join(b, "partner").filter(F.levenshtein("_a", "_b", 1) >= 0).select("node", "partner")


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, near_chars: int = NEAR_CHARS, by_bytes: bool = False) -> DataFrame:
    """doc_id, text_hash, n_lines (compared lines), and ``repeated`` and ``near``: sorted positions of dropped lines.

    One row per doc_id and text with a compared line. ``docs`` needs doc_id (a whole number) and text. With ``by_bytes`` an edit
    is one byte of UTF-8: a character outside ASCII is then one edit away only from those that differ in one byte.
    """
    scratch = Scratch(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    lines = scratch.written(line_table(docs, min_chars, near_chars), "lines")
    firsts = lines.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "text_hash", "pos")).alias("first"), F.first("keys").alias("keys"))
    nodes = scratch.written(firsts.orderBy("first").withColumn("node", F.monotonically_increasing_id()), "line-nodes")  # ids rise with the order
    halves = nodes.select("node", F.explode(F.array_distinct("keys")).alias("half"))
    shared = scratch.written(halves.groupBy("half").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo < hi").select("half"), "halves")
    some = halves.join(shared, "half", "left_semi").select("node").distinct()
    wanted = nodes.join(some, "node", "left_semi").select("node", "first.doc_id", "first.text_hash", "first.pos", "h1", "h2")
    contents = scratch.written(_contents(docs, wanted, min_chars), "line-contents")
    near = scratch.written(near_lines(contents, scratch, by_bytes).select("node", F.lit(True).alias("near")), "near-lines")
    scratch.keep_only(lines, nodes, near)
    judged = nodes.join(near, "node", "left").select("h1", "h2", "first", F.coalesce("near", F.lit(False)).alias("near"))
    again = ~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash")) & (F.col("pos") == F.col("first.pos")))
    why = F.when(again, "repeated").when(F.col("near"), "near")
    verdicts = lines.select("doc_id", "text_hash", "pos", "h1", "h2").join(judged, ["h1", "h2"]).select("doc_id", "text_hash", "pos", why.alias("why"))
    places = lambda name: F.array_sort(F.collect_set(F.when(F.col("why") == name, F.col("pos"))))
    found = verdicts.groupBy("doc_id", "text_hash").agg(F.countDistinct("pos").alias("n_lines"), places("repeated").alias("repeated"), places("near").alias("near"))
    found = scratch.written(found, "line-verdicts")
    scratch.keep_only(found)
    return found


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, near_chars: int = NEAR_CHARS) -> DataFrame:
    """``docs`` without dropped lines; n_chars, where there is such a column, is brought up to date.

    Documents that lose all their text this way go: every line of theirs stands in an earlier document.
    """
    found = dropped_lines(docs, min_chars, near_chars).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_text"), F.array_sort(F.concat("repeated", "near")).alias("_gone")).filter(F.size("_gone") > 0)
    joined = docs.join(found, same_row(F.col("doc_id").cast("long")), "left")
    def between(lines: Column) -> Column:
        froms, untils = F.concat(F.array(F.lit(0)), F.transform("_gone", lambda i: i + 1)), F.concat("_gone", F.array(F.size(lines)))
        return F.array_join(F.flatten(F.zip_with(froms, untils, lambda a, b: F.slice(lines, a + 1, b - a))), "\n")

    # What lies between dropped positions, as slices. The lines are a lambda's variable, so that no condition on the result that
    # Spark moves below cuts the text anew for each slice.
    left = F.element_at(F.transform(F.array(F.split("text", "\n", -1)), between), 1)
    cut = joined.withColumn("text", F.when(F.col("_gone").isNull(), F.col("text")).otherwise(left))
    cut = cut.filter(F.col("_gone").isNull() | (F.length(F.translate("text", SPACES, "")) > 0)).select(*docs.columns)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut


def line_digests(docs: DataFrame, min_chars: int = MIN_CHARS, near_chars: int = NEAR_CHARS, by_bytes: bool = False) -> DataFrame:
    """One row per document: doc_id, n_lines, n_repeated, n_near and the dropped positions as text."""
    found = dropped_lines(docs, min_chars, near_chars, by_bytes).withColumnsRenamed({"doc_id": "_id", "text_hash": "_text"})
    gone = F.array_join(F.array_sort(F.concat("repeated", "near")), ",")
    counted = lambda c: F.coalesce(F.when(c >= 0, c), F.lit(0)).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("_own"))  # the texts stay out of the join
    joined = rows.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_text")), "left")
    return joined.select("doc_id", counted(F.col("n_lines")).alias("n_lines"), counted(F.size("repeated")).alias("n_repeated"), counted(F.size("near")).alias("n_near"), F.coalesce(gone, F.lit("")).alias("dropped"))


def oracle(min_chars: int = MIN_CHARS, near_chars: int = NEAR_CHARS) -> str:
    """``line_digests`` by bytes for DuckDB, whose levenshtein counts bytes: edit distances of all lines of neighbouring lengths."""
    return f"""
WITH l AS (SELECT doc_id, pos - 1 AS pos, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS line FROM (
             SELECT doc_id, unnest(range(1, len(ls) + 1)) AS pos, unnest(ls) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
c AS (SELECT * FROM l WHERE length(line) >= {min_chars}),
f AS (SELECT line, length(line) AS n, min(doc_id * 1000000 + pos) AS first FROM c GROUP BY line),
p AS (SELECT a.line AS line FROM f a JOIN f b ON b.n BETWEEN a.n - 1 AND a.n + 1 AND b.first < a.first AND a.n >= {near_chars} AND b.n >= {near_chars}
      WHERE (left(a.line, a.n // 4) = left(b.line, a.n // 4) OR right(a.line, a.n // 4) = right(b.line, a.n // 4)) AND levenshtein(a.line, b.line) <= 1),
near AS (SELECT DISTINCT line FROM p),
v AS (SELECT doc_id, pos, doc_id * 1000000 + pos <> first AS again, near.line IS NOT NULL AS near
      FROM c JOIN f USING (line) LEFT JOIN near USING (line)),
g AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (again) AS n_repeated, count(*) FILTER (near AND NOT again) AS n_near,
             string_agg(pos, ',' ORDER BY pos) FILTER (again OR near) AS dropped FROM v GROUP BY doc_id)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_repeated, 0) AS n_repeated, coalesce(n_near, 0) AS n_near, coalesce(dropped, '') AS dropped
FROM documents LEFT JOIN g USING (doc_id)"""
