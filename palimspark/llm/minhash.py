"""Near-duplicate texts by fast similarity sketching, banding and exact verification.

A document is a set of word shingles, hashed to 64 bits. Its sketch has a fixed number of bins. In round i
every shingle falls into one bin by the round's hash and offers a value that is larger than all of earlier
rounds; a bin keeps its least value. The second half of the rounds offers every shingle to one bin each, so
after at most twice as many rounds as bins every bin is filled, however small the set is; two sets agree
in a bin with a probability of their Jaccard similarity, with the concentration of independent draws.

Equal sets are one node. Bins are cut into bands; nodes that agree in a band share a bucket. Buckets are
never expanded into all pairs: each bucket has a hub, drawn by lot, and each node is checked against a few hubs of its
buckets; once more, nodes are checked against new hubs of buckets that still hold several components. That joins
dense groups in a number of checks that is linear in their size. Nodes that share a bucket with
another component after that are compared exactly, by a prefix join whose pairs must pass two exact bounds
(position of the common element, and parity bits that tell how much two sets differ at least). All links are
confirmed on the full sets.

Every intermediate table lies in the shared folder, its shuffle files go when it is written, and it is deleted
itself when its last reader is done.

Defined results: null or empty texts, and texts of white space, have no shingles, are linked with nothing and
are components of their own; a text with fewer words than a shingle is one shingle; repeated rows are
linked with one another; with equal doc_id the rows share that id but are linked by their texts; a null
doc_id never names a component that has another member; an empty table gives an empty table; other columns are
ignored by ``near_duplicates`` and passed through by ``without_near_duplicates``. The latter keeps one row of each
component, the one with the smallest doc_id (none comes last) and, among rows of one id, the smallest text hash; of
equal ids and texts any one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import slices
from .components import led_to_roots, relabelled, with_roots
from .shared import Scratch

BANDS = 40
#: With 6 rows to a band, a pair at 0.8 shares none of 40 bands with a probability of 5e-6, one at 0.85 of 6e-9.
ROWS = 6
#: Checks of a node against others of its buckets in each of the two rounds before the exact rest.
HUBS = 6
#: Parity bits of a set, a multiple of 64.
PARITY_BITS = 512

_SHINGLE = np.uint64(0x9E3779B97F4A7C15)  # odd multipliers, as usual for 64-bit mixing
_MIX_A, _MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input moves every bit of the output."""
    x = (x ^ (x >> np.uint64(30))) * _MIX_A
    x = (x ^ (x >> np.uint64(27))) * _MIX_B
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str | None], words: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles of ``words`` lower-cased words."""
    from pandas.util import hash_array

    cut = [text.encode().lower().split() if text else [] for text in texts]  # bytes: A-Z only, ASCII white space only
    flat = np.empty(sum(map(len, cut)), dtype=object)
    flat[:] = [w for ws in cut for w in ws]
    hashes = hash_array(flat) if len(flat) else np.zeros(0, dtype=np.uint64)
    out, at = [], 0
    for ws in cut:
        own = hashes[at : at + len(ws)]
        at += len(ws)
        k = min(words, len(own))
        if not k:
            out.append(own)
            continue
        rolled = own[: len(own) - k + 1].copy()
        for i in range(1, k):
            rolled = mix(rolled) * _SHINGLE + own[i : len(own) - k + 1 + i]
        out.append(np.unique(mix(rolled + np.uint64(k))))
    return out


def sketch(elements: np.ndarray, bins: int) -> np.ndarray:
    """The least value of each bin over rounds of hashed bin placement."""
    least = np.full(bins, np.iinfo(np.uint64).max, dtype=np.uint64)
    step = max(1, int(2 * bins * np.log(bins) / len(elements)))
    first = 0
    while first < 2 * bins and least.max() == np.iinfo(np.uint64).max:
        rounds = np.arange(first, min(first + step, 2 * bins), dtype=np.uint64)
        h = mix(elements[None, :] + mix(rounds + np.uint64(1))[:, None])
        value = rounds[:, None] << np.uint64(52) | h >> np.uint64(12)
        placed = np.where(rounds[:, None] < bins, h % np.uint64(bins), rounds[:, None] - np.uint64(bins) * (rounds[:, None] >= bins))
        np.minimum.at(least, placed.astype(np.int64).ravel(), value.ravel())
        first += step
    return least


def band_keys(sketches: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key per band of each sketch (row)."""
    parts = sketches.reshape(len(sketches), bands, -1)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for i in range(parts.shape[2]):
        key = mix(key * _SHINGLE + parts[:, :, i])
    return key


def _long_lists(rows: list[np.ndarray]) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*rows, np.zeros(0, dtype=np.uint64)]).view(np.int64)))


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, text and a hash of the text, which names a row together with doc_id."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def sketch_documents(docs: DataFrame, words: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, text_hash, n_shingles, fingerprint (of the whole set; null where it is empty) and band keys. Narrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(part.column("text").to_pylist(), words)
                some = [s for s in sets if len(s)]
                keys = iter(band_keys(np.array([sketch(s, bands * rows) for s in some]), bands) if some else ())
                columns = [
                    part.column("doc_id"),
                    part.column("text_hash"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.md5(s.tobytes()).digest() if len(s) else None for s in sets], pa.binary()),
                    _long_lists([next(keys) if len(s) else s for s in sets]),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "n_shingles", "fingerprint", "keys"])

    return _rows(docs).mapInArrow(run, "doc_id long, text_hash long, n_shingles long, fingerprint binary, keys array<long>")


def parity_bits(elements: np.ndarray, bits: int = PARITY_BITS) -> np.ndarray:
    """For each of ``bits`` places whether an odd number of elements falls on it, as 64-bit words.

    Two sets differ by at least as many elements as their parities differ by places.
    """
    odd = np.bincount((elements & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def full_sets(docs: DataFrame, words: int) -> DataFrame:
    """node, the sorted shingle hashes of its text and their parity bits, for ``docs`` (node, fingerprint, text). Narrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(part.column("text").to_pylist(), words)
                same = [i for i, (s, f) in enumerate(zip(sets, part.column("fingerprint").to_pylist(), strict=True)) if hashlib.md5(s.tobytes()).digest() == f]
                columns = [part.column("node").take(pa.array(same, pa.int64())), _long_lists([sets[i] for i in same]), _long_lists([parity_bits(sets[i]) for i in same])]
                yield pa.RecordBatch.from_arrays(columns, ["node", "elements", "parity"])

    return docs.select("node", "fingerprint", "text").mapInArrow(run, "node long, elements array<long>, parity array<long>")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs`` (doc_id, text)."""
    sketched, named = _named(docs, words, percent, bands, rows)
    empty = sketched.filter("fingerprint is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    found = sketched.filter("fingerprint is not null").select("doc_id", "n_shingles", "fingerprint").join(named, "fingerprint")
    found = found.select("doc_id", "n_shingles", F.col("head.doc_id").alias("component_id")).unionByName(empty)
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def without_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``docs`` with one row of each component; rows without words all stay. Other columns are passed through."""
    sketched, named = _named(docs, words, percent, bands, rows)
    keys = sketched.filter("fingerprint is not null").groupBy("doc_id", "text_hash").agg(F.min("fingerprint").alias("fingerprint"), F.count("*").alias("n"))
    first = F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("text_hash") == F.col("head.text_hash"))
    marks = keys.join(named, "fingerprint").withColumn("kept", first).filter("not kept or n > 1")
    marks = Scratch(docs.sparkSession).written(marks.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_text"), "kept"), "marks")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("_text"))
    rest = docs.join(marks, same, "left_anti")
    repeated = docs.join(marks.filter("kept"), same).dropDuplicates(["_id", "_text"]).select(*(docs[c] for c in docs.columns))
    return rest.unionByName(repeated)


def _named(docs: DataFrame, words: int, percent: int, bands: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """The sketches of all rows, and for each fingerprint ``head``: the first row (nameless, doc_id, text_hash) of its component."""
    scratch = Scratch(docs.sparkSession)
    sketched = scratch.written(sketch_documents(docs, words, bands, rows), "sketches")
    first = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_hash")
    grouped = sketched.filter("fingerprint is not null").groupBy("fingerprint").agg(F.min(first).alias("first"), F.first("keys").alias("keys"))
    nodes = scratch.written(grouped.withColumn("node", F.monotonically_increasing_id()), "nodes")
    linked = scratch.written(with_roots(_linked(docs, nodes, words, percent, scratch)), "linked")
    owned = linked.join(nodes.select("node", "first"), "node")
    heads = scratch.written(owned.groupBy("component").agg(F.min("first").alias("head")), "heads")
    scratch.keep_only(sketched, nodes, linked, heads)
    named = nodes.select("node", "fingerprint", "first").join(linked.join(heads, "component").select("node", "head"), "node", "left")
    return sketched, named.select("fingerprint", F.coalesce("head", "first").alias("head"))


def _linked(docs: DataFrame, nodes: DataFrame, words: int, percent: int, scratch: Scratch) -> DataFrame:
    """node and component of every node that is linked with a smaller one."""
    banded = nodes.select("node", F.explode("keys").alias("key"))
    hubs = banded.groupBy("key").agg(F.min_by("node", _lot(0)).alias("hub"), F.count("*").alias("n")).filter("n > 1").select("key", "hub")
    hubs = scratch.written(hubs, "hubs")  # a table of its own, so that Spark can split frequent keys in the join
    buckets = scratch.written(banded.join(hubs, "key"), "buckets")
    sets = scratch.written(_sets_of(docs, nodes.join(buckets.select("node").distinct(), "node", "left_semi"), words), "sets")

    met = buckets.filter("node <> hub").groupBy("node").agg(F.collect_list("hub").alias("hubs"))
    times = F.transform(F.array_distinct("hubs"), lambda h: F.struct((-F.size(F.filter("hubs", lambda x: x == h))).alias("n"), F.xxhash64(h, "node").alias("lot"), h.alias("hub")))
    pairs = met.select("node", F.explode(F.slice(F.sort_array(times), 1, HUBS)).alias("h")).select(F.col("h.hub").alias("a"), F.col("node").alias("b"))
    labels = led_to_roots(_linked_pairs(pairs, sets, percent), scratch)
    scratch.drop(hubs)

    mixed, labelled = _mixed(buckets.select("key", "node"), labels, scratch)
    if mixed.isEmpty():
        return labels
    unsettled = scratch.written(labelled.join(mixed, "key"), "unsettled")
    few = unsettled.filter("component <> theirs").groupBy("node", "component").agg(F.collect_set(F.struct(F.xxhash64("hub", "node").alias("lot"), "hub", "theirs")).alias("hubs"))
    pairs = few.select("node", "component", F.explode(F.slice(F.sort_array("hubs"), 1, HUBS)).alias("h"))
    pairs = pairs.select(F.col("h.hub").alias("a"), F.col("node").alias("b"), F.col("h.theirs").alias("ca"), F.col("component").alias("cb"))
    labels = _joined(labels, _linked_pairs(pairs, sets, percent, "ca", "cb"), scratch)
    scratch.drop(mixed, labelled)

    mixed, labelled = _mixed(unsettled.select("key", "node"), labels, scratch)
    scratch.drop(unsettled)
    if mixed.isEmpty():
        return labels
    nodes_left = labelled.join(mixed, "key").select("node", "component").distinct()
    tokens = scratch.written(_prefixes(nodes_left, sets, percent), "prefixes")
    pairs = _prefix_pairs(tokens, percent).distinct()
    labels = _joined(labels, _linked_pairs(pairs, sets, percent, "ca", "cb"), scratch)
    scratch.drop(mixed, labelled, tokens, sets)
    return labels


def _lot(attempt: int) -> Column:
    """Each bucket draws its hub for itself, so no node stands for many buckets of a large group."""
    return F.xxhash64("node", "key", F.lit(attempt))


def _sets_of(docs: DataFrame, needed: DataFrame, words: int) -> DataFrame:
    """The sets of ``needed`` (node, fingerprint, first), each made anew from the text of its first row."""
    wanted = needed.select("node", "fingerprint", F.col("first.doc_id").alias("_id"), F.col("first.text_hash").alias("_text"))
    found = _rows(docs).join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_text")))
    return full_sets(found, words).groupBy("node").agg(F.first("elements").alias("elements"), F.first("parity").alias("parity"))


def _mixed(buckets: DataFrame, labels: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Keys of several components, each with a hub and the hub's component; and ``buckets`` with components."""
    labelled = buckets.join(labels, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    labelled = scratch.written(labelled, "labelled")
    ends = [F.min("component").alias("lo"), F.max("component").alias("hi"), F.min_by("node", _lot(1)).alias("hub"), F.min_by("component", _lot(1)).alias("theirs")]
    return scratch.written(labelled.groupBy("key").agg(*ends).filter("lo < hi").select("key", "hub", "theirs"), "mixed"), labelled


def _joined(labels: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """``labels`` after ``links`` between components."""
    return scratch.written(relabelled(labels, led_to_roots(links, scratch)), "labels")


def _prefixes(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The rarest elements of each of ``nodes`` (node, component), so many that no partner can do without all of them.

    Of two sets of that similarity each holds at most n - ceil(percent * n / 100) elements that the other lacks. So
    among its so many plus one rarest elements there is one that is also among the other's. Elements that one
    node alone has count as rarest, and a node with enough of them has no partner at all. ``left`` counts the elements
    from this one on.
    """
    own = nodes.join(sets, "node").withColumn("n", F.size("elements"))
    flat = own.select("node", F.explode("elements").alias("element"))
    common = flat.groupBy("element").agg(F.count("*").alias("df")).filter("df > 1")
    ranked = flat.join(common, "element").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "element"))).alias("shared"))
    spare = F.size("shared") - F.ceil(F.col("n") * percent / 100.0 - 1e-9).cast("int") + 1
    prefix = own.select("node", "component", "n", "parity").join(ranked, "node").withColumn("spare", spare).filter("spare > 0")
    tokens = prefix.select("node", "component", "n", "parity", F.size("shared").alias("m"), F.posexplode(F.slice("shared", F.lit(1), F.col("spare"))).alias("at", "t"))
    return tokens.select("t.element", "node", "component", "n", (F.col("m") - F.col("at")).alias("left"), "parity")


def _prefix_pairs(tokens: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components that share an element of both prefixes and may reach ``percent`` by two bounds."""
    x, y = tokens.alias("x"), tokens.alias("y")
    sizes = F.col("x.n") + F.col("y.n")
    differ = sum((F.bit_count(F.col("x.parity")[i].bitwiseXOR(F.col("y.parity")[i])) for i in range(PARITY_BITS // 64)), F.lit(0))
    fits = (F.col("x.element") == F.col("y.element")) & (F.col("x.component") < F.col("y.component"))
    # The overlap that this similarity takes: neither set may have fewer elements left, nor may they differ by more.
    fits = fits & ((100 + percent) * F.least("x.left", "y.left") >= percent * sizes) & ((100 + percent) * (sizes - differ) >= 2 * percent * sizes)
    return x.join(y, fits).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.col("x.component").alias("ca"), F.col("y.component").alias("cb"))


def _linked_pairs(pairs: DataFrame, sets: DataFrame, percent: int, ca: str = "a", cb: str = "b") -> DataFrame:
    """Those of ``pairs`` whose full sets reach ``percent``, as edges a and b between the columns ``ca`` and ``cb``.

    The side with one row per node comes first, so that a hub's set travels once per part of its pairs, not once per pair.
    """
    keep = list(dict.fromkeys(["a", "b", ca, cb]))
    b = pairs.select(*keep).join(sets.select(F.col("node").alias("b"), F.col("elements").alias("_b")), "b")
    both = b.join(sets.select(F.col("node").alias("a"), F.col("elements").alias("_a")), "a")
    common = F.size(F.array_intersect("_a", "_b"))
    linked = (100 + percent) * common >= percent * (F.size("_a") + F.size("_b"))
    return both.filter(linked).select(F.col(ca).alias("a"), F.col(cb).alias("b"))


def oracle(words: int = 2, percent: int = 80) -> str:
    """The same for DuckDB: all pairs of sets that share a shingle, and a recursive closure over the links."""
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(1, len(ws) - {words - 1}) + 1),
             lambda i: array_to_string(ws[i : i + {words - 1}], ' '))) END AS s FROM d),
n AS (SELECT doc_id, len(s) AS n FROM g),
e AS (SELECT doc_id, unnest(s) AS w FROM g),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM e a JOIN e b ON a.w = b.w AND a.doc_id <> b.doc_id
      JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
      WHERE 100 * na.n >= {percent} * nb.n AND 100 * nb.n >= {percent} * na.n GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * common >= {percent} * (na.n + nb.n - common)),
reach AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id, least(doc_id, coalesce(m, doc_id)) = doc_id AS kept
FROM n LEFT JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) ON a = doc_id"""
