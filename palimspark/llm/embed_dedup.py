"""Near-duplicate vectors by a robust-pruned graph on overlapping cluster shards.

Equal vectors are one node with a number of copies. Centroids come from a bounded sample; a node belongs to
its two nearest clusters and to others that are nearly as near, OVERLAP at most, so the shards together hold a bounded
multiple of the nodes whatever the number of clusters. Each shard builds adjacency lists from
its nearest neighbours, pruned so that the kept edges point in different directions; a node's lists from all
shards are united. Every node is then a query in the shard of its nearest centroid: a greedy search with a beam
starts at the shard's medoid and at the node itself, and once it stands in range it follows every neighbour in
range until no new one appears. Cosines are verified in double precision. After each attempt recall is audited against
brute force, over distinct nodes, on a bounded set of queries half of which have links; the search is widened if it
falls short, and a recall below FAIL_RECALL after the last attempt is an error, not a result.

Shards of more than BLOCK members are cut into blocks, and each block of queries searches each block of members, so
a task holds a bounded number of vectors whatever the data. Links are counted and merged into components inside
tasks; pairs are never written out. Past MAX_CLUSTERS * CLUSTER_NODES distinct vectors shards grow with the input.

Defined results: vectors that are null, zero, empty or hold null or non-finite components have no links and are
components of their own; vectors of different lengths don't link; a repeated vec_id keeps its rows; a null
vec_id never names a component that has another member; an empty table gives an empty table; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import Scratch

#: Bounds: vectors in the sample for centroids, mean nodes to a cluster, clusters, members and queries to a task.
SAMPLE = 8192
CLUSTER_NODES = 250
MAX_CLUSTERS = 4096
BLOCK = 4000
#: A node also belongs to clusters whose centroid's cosine is less than the best one's by so much at most, to so many in all.
MARGIN = 0.12
OVERLAP = 8
DEGREE = 16
POOL = 32
ALPHA = 1.2
BEAM = 8
#: Queries of the audit, the share of brute-force links that must be found, attempts, and the share that fails the job.
AUDIT = 400
LEAST_RECALL = 0.98
ATTEMPTS = 3
FAIL_RECALL = 0.9
_SLACK = 1e-9


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def fit_centroids(sample: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means on a sample of unit vectors; deterministic."""
    centres = sample[np.linspace(0, len(sample) - 1, min(k, len(sample))).astype(int)]
    for _ in range(rounds):
        own = (sample @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        filled = (sums * sums).sum(axis=1) > 1e-12
        centres = np.where(filled[:, None], sums, centres)
        centres = _unit(centres)
    return centres


def clusters_of(units: np.ndarray, centres: np.ndarray, margin: float, overlap: int) -> list[np.ndarray]:
    """For each vector its clusters, the nearest first."""
    near = units @ centres.T
    most = min(max(overlap, 2), near.shape[1])
    order = np.argpartition(-near, most - 1, axis=1)[:, :most]
    ranked = np.take_along_axis(near, order, axis=1)
    inner = np.argsort(-ranked, axis=1, kind="stable")
    order, ranked = np.take_along_axis(order, inner, axis=1), np.take_along_axis(ranked, inner, axis=1)
    n = np.maximum((ranked >= ranked[:, :1] - margin).sum(axis=1), min(2, most))
    return [o[:c] for o, c in zip(order, n.tolist(), strict=True)]


def pruned_graph(units: np.ndarray, degree: int, pool: int, alpha: float, block: int = 512) -> np.ndarray:
    """Adjacency (one row a node, -1 for none): of the nearest ``pool``, those not behind a nearer kept one.

    To these come the neighbours at ranks that grow by half, up to the farthest: they join dense groups that lie
    so close to each other that none of the nearest leads across.
    """
    n = len(units)
    pool = min(pool, n - 1)
    ranks = [pool]
    while ranks[-1] < n - 1:
        ranks.append(ranks[-1] + max(1, ranks[-1] // 2))
    far = [r for r in ranks if pool <= r < n - 1]
    out = np.full((n, degree + len(far)), -1, dtype=np.int64)
    for a in range(0, n, block) if pool > 0 else ():
        b = min(a + block, n)
        cosine = units[a:b] @ units.T
        cosine[np.arange(b - a), np.arange(a, b)] = -2
        ranked = np.argpartition(-cosine, [pool - 1, *far], axis=1)
        out[a:b, degree:] = ranked[:, far]
        near = ranked[:, :pool]
        inner = np.argsort(-np.take_along_axis(cosine, near, axis=1), axis=1, kind="stable")
        near = np.take_along_axis(near, inner, axis=1)
        away = 1 - np.take_along_axis(cosine, near, axis=1)
        alive = np.ones(near.shape, dtype=bool)
        rows = np.arange(b - a)
        for d in range(degree):
            some = alive.any(axis=1)
            pick = alive.argmax(axis=1)
            chosen = near[rows, pick]
            out[a:b, d] = np.where(some, chosen, -1)
            between = 1 - np.einsum("rpd,rd->rp", units[near], units[chosen])
            alive &= alpha * between > away
            alive[rows, pick] = False
    return out


def both_ways(adjacency: list[np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Lists with all their reverse edges: where each node's neighbours begin, and the neighbours.

    Reverse edges aren't limited: in a dense group all lists lead to the few nodes at its middle, and only their
    reverse edges lead out again.
    """
    ends = np.concatenate([*adjacency, np.zeros(0, dtype=np.int64)]).astype(np.int64)
    starts = np.repeat(np.arange(n), [len(x) for x in adjacency])
    edges = np.unique(np.concatenate([starts * n + ends, ends * n + starts]))
    return np.searchsorted(edges, np.arange(n + 1) * n), edges % n


def range_search(units: np.ndarray, graph: tuple[np.ndarray, np.ndarray], queries: np.ndarray, own: np.ndarray, beam: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(query, node) of all nodes found with a cosine of ``least`` or more. ``own``: the query's own node or -1."""
    n, q = len(units), len(queries)
    medoid = int((units @ units.mean(axis=0)).argmax())
    seen = np.zeros((q, n), dtype=bool)
    inside = np.zeros((q, n), dtype=bool)
    rows = np.arange(q)
    ids = np.full((q, beam), -1, dtype=np.int64)
    score = np.full((q, beam), -np.inf)
    opened = np.zeros((q, beam), dtype=bool)

    begins, ends = graph

    def visit(at: np.ndarray, lists: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mark the nodes of each query's list; new ones and their cosines, padded with -1 and -inf."""
        r, to = np.repeat(np.arange(len(at)), lengths), lists
        fresh = ~seen[at[r], to]
        r, to = r[fresh], to[fresh]
        seen[at[r], to] = True
        got = np.einsum("ij,ij->i", queries[at[r]], units[to])
        hit = got >= least
        inside[at[r[hit]], to[hit]] = True
        place = np.arange(len(r)) - np.searchsorted(r, r)
        shape = (len(at), int(place.max()) + 1 if len(place) else 1)
        new_ids, new_scores = np.full(shape, -1, dtype=np.int64), np.full(shape, -np.inf)
        new_ids[r, place], new_scores[r, place] = to, got
        return new_ids, new_scores

    def neighbours(of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lengths = begins[of + 1] - begins[of]
        inner = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        return ends[np.repeat(begins[of], lengths) + inner], lengths

    for start in (np.full(q, medoid), own):
        got = visit(rows[start >= 0], start[start >= 0], np.ones((start >= 0).sum(), dtype=np.int64))
        column = 0 if start is not own else 1
        ids[start >= 0, column], score[start >= 0, column] = got[0][:, 0], got[1][:, 0]
    opened[:, :2] = score[:, :2] > -np.inf
    active = rows
    expanded = np.zeros((q, n), dtype=bool)
    while len(active):
        best = np.where(opened[active], score[active], -np.inf).argmax(axis=1)
        active = active[opened[active, best]]
        if not len(active):
            break
        best = np.where(opened[active], score[active], -np.inf).argmax(axis=1)
        node = ids[active, best]
        opened[active, best] = False
        expanded[active, node] = True
        near, got = visit(active, *neighbours(node))
        all_ids, all_scores = np.concatenate([ids[active], near], axis=1), np.concatenate([score[active], got], axis=1)
        all_open = np.concatenate([opened[active], got > -np.inf], axis=1)
        top = np.argpartition(-all_scores, beam - 1, axis=1)[:, :beam]
        ids[active], score[active], opened[active] = (np.take_along_axis(x, top, axis=1) for x in (all_ids, all_scores, all_open))
    active = rows
    while len(active):
        waiting = inside[active] & ~expanded[active]
        more = waiting.any(axis=1)
        active, node = active[more], waiting[more].argmax(axis=1)
        expanded[active, node] = True
        if len(active):
            visit(active, *neighbours(node))
    return np.nonzero(inside)


def _stacked(vectors: pd.Series) -> np.ndarray:
    return np.array(vectors.tolist(), dtype=np.float64)


def near_vectors(embeddings: DataFrame, least: float = 0.95, margin: float = MARGIN, overlap: int = OVERLAP, beam: int = BEAM) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``embeddings`` (vec_id, embedding)."""
    spark = embeddings.sparkSession
    scratch = Scratch(spark)
    vector = F.col("embedding").cast("array<double>")
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    usable = F.coalesce(F.forall("vector", fine) & F.exists("vector", lambda x: x != 0), F.lit(False))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector"))
    # Two 64-bit hashes stand for a vector wherever rows meet; -0.0 counts as 0.0.
    plain = F.transform("vector", lambda x: x + F.lit(0.0))
    rows = rows.withColumns({"h1": F.when(usable, F.xxhash64(plain)), "h2": F.when(usable, F.xxhash64(F.lit(1), plain))})
    grouped = rows.filter("h1 is not null").groupBy("h1", "h2").agg(F.first("vector").alias("vector"), F.count("*").alias("copies"), F.min("vec_id").alias("first_id"))
    nodes = scratch.written(grouped.withColumn("node", F.monotonically_increasing_id()), "vectors")
    sample = {}
    for r in nodes.orderBy("h1", "h2").limit(SAMPLE).select("vector").collect():  # bounded by SAMPLE
        sample.setdefault(len(r[0]), []).append(r[0])
    k = min(MAX_CLUSTERS, max(1, nodes.count() // CLUSTER_NODES))
    centres = {d: fit_centroids(_unit(np.array(v)), max(1, k * len(v) // SAMPLE if len(sample) > 1 else k)) for d, v in sample.items()}
    centres = spark.sparkContext.broadcast(centres)  # at most MAX_CLUSTERS vectors
    links = None
    for attempt in range(ATTEMPTS):
        scratch.drop(*([] if links is None else [links]))
        links = _search(nodes, centres, least, margin * (1 + attempt), overlap << attempt, beam << attempt, scratch)
        recall = audit_recall(nodes, links, least)
        if recall >= LEAST_RECALL:
            break
    if recall < FAIL_RECALL:
        raise RuntimeError(f"the search found {recall:.3f} of the audited links; raise margin, overlap or beam")
    counts = links.groupBy("node").agg(F.sum("n").alias("n"))
    components = connected_components(links.select("node", F.col("root").alias("to")).filter("node <> to"), "node", "to")
    owned = components.join(nodes.select("node", "first_id"), "node")
    heads = scratch.written(owned.groupBy("component").agg(F.min("first_id").alias("component_id")), "heads")
    named = nodes.select("node", "h1", "h2", "copies", "first_id").join(counts, "node", "left").join(components.join(heads, "component").select("node", "component_id"), "node", "left")
    judged = named.select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), F.coalesce("component_id", "first_id").alias("component_id"))
    judged = scratch.written(judged, "judged-vectors")
    scratch.keep_only(judged)
    some = rows.filter("h1 is not null").select("vec_id", "h1", "h2").join(judged, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    none = rows.filter("h1 is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return some.unionByName(none).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _search(nodes: DataFrame, centres, least: float, margin: float, overlap: int, beam: int, scratch: Scratch) -> DataFrame:
    """node, n (copies of linked nodes), m (linked nodes) and root (a node of the same component), a few rows per node."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frame = batch.to_pandas()
            sizes = frame["vector"].map(len)
            for d in sorted(sizes.unique()):
                part = frame[sizes == d]
                centre = centres.value.get(d)
                units = _unit(_stacked(part["vector"]))
                found = [np.zeros(1, dtype=np.int64)] * len(part) if centre is None else clusters_of(units, centre, margin, overlap)
                times = [len(f) for f in found]
                out = part.loc[part.index.repeat(times)]
                home = np.concatenate([np.arange(t) == 0 for t in times])
                shard = d * (MAX_CLUSTERS + 1) + np.concatenate(found)
                yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(home), pa.array(out["node"]), pa.array(out["copies"]), pa.array(list(out["vector"]), pa.list_(pa.float64()))], ["shard", "home", "node", "copies", "vector"])

    placed = scratch.written(nodes.select("node", "copies", "vector").mapInArrow(assign, "shard long, home boolean, node long, copies long, vector array<double>"), "shards")
    sizes = placed.groupBy("shard").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("pieces"), F.greatest(F.lit(1), F.ceil(F.count_if("home") / BLOCK)).cast("int").alias("blocks"))
    sized = placed.join(sizes, "shard")
    in_piece = F.pmod(F.xxhash64("node"), F.col("pieces")).cast("int")
    in_block = F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int")
    members = sized.withColumn("piece", in_piece)

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        graph = pruned_graph(_unit(_stacked(frame["vector"])), DEGREE, POOL, ALPHA)
        ids = frame["node"].to_numpy()
        return pd.DataFrame({"node": ids, "near": [ids[row[row >= 0]].tolist() for row in graph]})

    lists = members.groupBy("shard", "piece").applyInPandas(build, "node long, near array<long>")
    united = scratch.written(lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "adjacency")  # a list per shard of the node
    indexed = members.join(united, "node").select("shard", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "piece", F.lit(False).alias("query"), "node", "copies", "vector", "near")
    asking = sized.filter("home").select("shard", in_block.alias("block"), F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), F.lit(True).alias("query"), "node", "copies", "vector", F.array().cast("array<long>").alias("near"))

    def search(frame: pd.DataFrame) -> pd.DataFrame:
        ask, own = frame[frame["query"]], frame[~frame["query"]]
        if not len(ask) or not len(own):
            return pd.DataFrame({"node": [], "n": [], "m": [], "root": []}).astype("int64")
        ids, asked = own["node"].to_numpy(), ask["node"].to_numpy()
        place = pd.Series(np.arange(len(ids)), index=ids)
        lists = [place.reindex(near).dropna().to_numpy(dtype=np.int64) if len(near) else np.zeros(0, dtype=np.int64) for near in own["near"]]
        units, queries = _unit(_stacked(own["vector"])), _unit(_stacked(ask["vector"]))
        graph = both_ways(lists, len(ids))
        at = place.reindex(asked).fillna(-1).to_numpy(dtype=np.int64)
        q, m = range_search(units, graph, queries, at, beam, least - _SLACK)
        exact = np.einsum("ij,ij->i", queries[q], units[m]) >= least
        q, m = q[exact & (asked[q] != ids[m])], m[exact & (asked[q] != ids[m])]
        n = np.bincount(q, weights=own["copies"].to_numpy()[m], minlength=len(asked)).astype(np.int64)
        every, flat = np.unique(np.concatenate([asked, ids]), return_inverse=True)
        a, b = flat[q], flat[len(asked) + m]
        root = np.arange(len(every))
        while True:  # the smallest place that links lead to
            before = root.copy()
            np.minimum.at(root, a, before[b])
            np.minimum.at(root, b, before[a])
            root = root[root]
            if (root == before).all():
                break
        linked = np.zeros(len(every), dtype=bool)
        linked[a] = linked[b] = True
        counted, different = np.zeros(len(every), dtype=np.int64), np.zeros(len(every), dtype=np.int64)
        counted[flat[: len(asked)]] = n
        different[flat[: len(asked)]] = np.bincount(q, minlength=len(asked))
        return pd.DataFrame({"node": every[linked], "n": counted[linked], "m": different[linked], "root": every[root[linked]]})

    found = indexed.unionByName(asking).groupBy("shard", "block", "piece").applyInPandas(search, "node long, n long, m long, root long")
    found = scratch.written(found, "vector-links")
    scratch.drop(placed, united)
    return found


def audit_recall(nodes: DataFrame, links: DataFrame, least: float, most: int = AUDIT) -> float:
    """Found links, each between two distinct nodes, as a share of those that brute force finds for a bounded set of queries.

    Half of the queries are nodes with a found link, half are any nodes, by a hash.
    """
    by_hash = lambda df: df.orderBy(F.xxhash64("node"), "node").limit(most // 2)
    chosen = by_hash(nodes.select("node")).unionByName(by_hash(links.filter("m > 0").select("node").distinct())).distinct()
    asked = nodes.join(F.broadcast(chosen), "node").select("node", "vector").collect()  # bounded by ``most``
    if not asked:
        return 1.0
    ids = np.array([r[0] for r in asked])
    by_size = {d: np.array([i for i, r in enumerate(asked) if len(r[1]) == d]) for d in {len(r[1]) for r in asked}}
    units = {d: _unit(np.array([asked[i][1] for i in at])) for d, at in by_size.items()}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(ids), dtype=np.int64)
        for batch in batches:
            frame = batch.to_pandas()
            sizes = frame["vector"].map(len)
            for d, at in by_size.items():
                part = frame[sizes == d]
                if len(part):
                    near = (units[d] @ _unit(_stacked(part["vector"])).T >= least) & (ids[at][:, None] != part["node"].to_numpy()[None, :])
                    total[at] += near.sum(axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], ["node", "m"])

    true = {r["node"]: r["m"] for r in nodes.select("node", "vector").mapInArrow(count, "node long, m long").groupBy("node").agg(F.sum("m").alias("m")).collect()}
    found = {r["node"]: r["m"] for r in links.join(F.broadcast(chosen), "node").groupBy("node").agg(F.sum("m").alias("m")).collect()}
    wanted = sum(true.values())
    return sum(min(m, found.get(i, 0)) for i, m in true.items()) / wanted if wanted else 1.0
