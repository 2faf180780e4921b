"""Nearest neighbours by inner product in sharded, robust-pruned directed graphs.

The greatest inner product is the least distance once every vector has one more
coordinate that gives all of them the length of the longest, and queries a zero
there. Distinct vectors are dealt to shards of bounded size by hash. In each
shard a graph is grown in batches: a greedy beam search from a few random
entries, the first points inserted, proposes neighbours, pruning by relaxed distance keeps diverse edges, and edges
are made mutual and pruned again. Queries run a beam search in every shard.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from metricloom.llm.batches import lists
from metricloom.llm.whitening import common_length, usable_vectors
from metricloom.sources.scratch import written

#: Vectors of a shard and query vectors of a block, about.
SHARD = 8192
QUERY_BLOCK = 2048
#: Most edges of a node, and by how much a kept edge must be shorter than a detour to drop the detour's end.
DEGREE = 32
RELAXED = 1.2
#: Beam of the searches that build the graph, and of queries.
BUILD_BEAM = 64
BEAM = 96
#: Edges beyond ``DEGREE`` that a node may gather before it is pruned again.
SLACK = 16
#: Entries from which a search starts, nodes that it opens at once, points inserted at once, and points of the first batch.
_STARTS = 8
_OPEN = 4
_BATCH = 512
_FIRST = 128


@dataclass
class Graph:
    """``edges`` holds a row per vector, filled up with -1; searches start from the nearest of ``entries``."""

    vectors: np.ndarray
    edges: np.ndarray
    entries: np.ndarray

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray, list]:
        """Nodes and squared distances (less the query's own square) of the beam, and all nodes opened.

        All queries advance together, each opening its nearest unopened nodes of
        the beam until there are none. Unused places hold -1 and infinity.
        """
        many, size = len(queries), len(self.vectors)
        squares = np.einsum("nd,nd->n", self.vectors, self.vectors)
        nodes = np.full((many, beam), -1, np.int32)
        far = np.full((many, beam), np.inf, np.float32)
        opened = np.ones((many, beam), bool)
        start = squares[self.entries] - 2 * queries @ self.vectors[self.entries].T
        width = min(beam, _STARTS, len(self.entries))
        pick = np.argpartition(start, width - 1, axis=1)[:, :width]
        nodes[:, :width], opened[:, :width] = self.entries[pick], False
        far[:, :width] = np.take_along_axis(start, pick, 1)
        seen = np.zeros((many, size), bool)
        seen[:, self.entries] = True
        trail = []
        live = np.arange(many)
        while len(live):
            wait = np.where(opened[live], np.inf, far[live])
            width = min(_OPEN, beam)
            pick = np.argpartition(wait, width - 1, axis=1)[:, :width]
            row = np.repeat(live, width)
            col = pick.ravel()
            ok = np.isfinite(np.take_along_axis(wait, pick, 1).ravel())
            row, col = row[ok], col[ok]
            opened[row, col] = True
            trail.append((row, nodes[row, col], far[row, col]))
            after = self.edges[nodes[row, col]]
            row = np.repeat(row, after.shape[1])
            node = after.ravel()
            ok = (node >= 0) & ~seen[row, node]
            # A node that two opened ones lead to is taken once.
            place = np.sort(row[ok].astype(np.int64) * size + node[ok])
            place = place[np.diff(place, prepend=-1) > 0]
            row, node = place // size, place % size
            seen[row, node] = True
            gap = squares[node] - 2 * np.einsum("nd,nd->n", self.vectors[node], queries[row])
            counts = np.bincount(row, minlength=many)[live]
            most = int(counts.max(initial=0))
            if most:
                rank = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
                at = np.repeat(np.arange(len(live)), counts)
                fresh = np.full((len(live), most), np.inf, np.float32)
                which = np.full((len(live), most), -1, np.int32)
                fresh[at, rank], which[at, rank] = gap, node
                all_far = np.concatenate([far[live], fresh], axis=1)
                best = np.argpartition(all_far, beam - 1, axis=1)[:, :beam]
                far[live] = np.take_along_axis(all_far, best, 1)
                nodes[live] = np.take_along_axis(np.concatenate([nodes[live], which], axis=1), best, 1)
                shut = np.concatenate([opened[live], which < 0], axis=1)
                opened[live] = np.take_along_axis(shut, best, 1)
            live = live[~opened[live].all(axis=1)]
        return nodes, far, trail


def robust_prune(
    vectors: np.ndarray, points: np.ndarray, found: np.ndarray, degree: int, relaxed: float
) -> np.ndarray:
    """At most ``degree`` of each point's candidates ``found`` (-1: none), the nearest first.

    Candidates are taken by rising distance; each taken one drops those to which
    it is nearer, by the factor ``relaxed``, than the point is.
    """
    found = np.sort(np.where(found == points[:, None], -1, found), axis=1)
    found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
    own = vectors[np.maximum(found, 0)]
    far = ((own - vectors[points][:, None, :]) ** 2).sum(axis=2)
    far[found < 0] = np.inf
    squares = np.einsum("bcd,bcd->bc", own, own)
    apart = squares[:, :, None] + squares[:, None, :] - 2 * own @ own.transpose(0, 2, 1)
    alive = found >= 0
    kept = np.full((len(points), degree), -1, np.int32)
    held = np.zeros(len(points), np.int64)
    for c in np.argsort(far, axis=1, kind="stable").T:
        take = np.flatnonzero(alive[np.arange(len(points)), c] & (held < degree))
        if not len(take):
            continue
        c = c[take]
        kept[take, held[take]] = found[take, c]
        held[take] += 1
        alive[take] &= relaxed * relaxed * apart[take, c] > far[take]
    return kept


def _prune(graph: Graph, nodes: np.ndarray, found: np.ndarray, degree: int, relaxed: float) -> None:
    """New edges of ``nodes`` out of their candidates ``found``."""
    for at in range(0, len(nodes), _BATCH):
        some = slice(at, at + _BATCH)
        graph.edges[nodes[some], degree:] = -1
        graph.edges[nodes[some], :degree] = robust_prune(graph.vectors, nodes[some], found[some], degree, relaxed)


def _link_back(graph: Graph, sources: np.ndarray, degree: int, relaxed: float) -> None:
    """Edges from the new neighbours of ``sources`` back to them, pruned where a node has too many."""
    width = graph.edges.shape[1]
    own = graph.edges[sources]
    start = np.repeat(sources, own.shape[1])
    target = own.ravel()
    ok = target >= 0
    start, target = start[ok], target[ok]
    while len(target):
        order = np.argsort(target, kind="stable")
        start, target = start[order], target[order]
        nodes, first, counts = np.unique(target, return_index=True, return_counts=True)
        rank = np.arange(len(target)) - np.repeat(first, counts)
        now = rank < degree
        added = np.full((len(nodes), degree), -1, np.int32)
        added[np.repeat(np.arange(len(nodes)), counts)[now], rank[now]] = start[now]
        both = np.concatenate([graph.edges[nodes], added], axis=1)
        both = np.sort(both, axis=1)[:, ::-1]
        both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
        full = (both >= 0).sum(axis=1) > width
        graph.edges[nodes[~full]] = np.sort(both[~full], axis=1)[:, ::-1][:, :width]
        _prune(graph, nodes[full], both[full], degree, relaxed)
        start, target = start[~now], target[~now]


def _matrix(found: list, rows: np.ndarray, size: int) -> np.ndarray:
    """Nodes opened by each search as rows, nearest first, filled up with -1."""
    row = np.concatenate([f[0] for f in found])
    node = np.concatenate([f[1] for f in found])
    far = np.concatenate([f[2] for f in found])
    order = np.lexsort((far, row))
    row, node = row[order], node[order]
    counts = np.bincount(row, minlength=len(rows))
    rank = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    out = np.full((len(rows), min(size, int(counts.max()))), -1, np.int32)
    ok = rank < out.shape[1]
    out[row[ok], rank[ok]] = node[ok]
    return out


def build_graph(
    vectors: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, relaxed: float = RELAXED, seed: int = 7
) -> Graph:
    """A graph over ``vectors`` (float32 rows, one at least), grown by batches in random order."""
    many = len(vectors)
    order = np.random.default_rng(seed).permutation(many)
    first = order[:_FIRST]
    graph = Graph(vectors, np.full((many, degree + SLACK), -1, np.int32), first)
    _prune(graph, first, np.tile(first, (len(first), 1)), degree, relaxed)
    _link_back(graph, first, degree, relaxed)
    at = len(first)
    while at < many:
        points = order[at : at + min(at, _BATCH)]
        _, _, trail = graph.search(vectors[points], beam)
        _prune(graph, points, _matrix(trail, points, 2 * beam), degree, relaxed)
        _link_back(graph, points, degree, relaxed)
        at += len(points)
    over = np.flatnonzero((graph.edges >= 0).sum(axis=1) > degree)
    _prune(graph, over, graph.edges[over], degree, relaxed)
    return graph


def _array(column: pa.ChunkedArray, d: int) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(-1, d)


def _lengthened(v: np.ndarray, longest: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(0.0, longest - (v * v).sum(axis=1)))
    return np.column_stack([v, rest]).astype(np.float32)


def build_index(classes: DataFrame, d: int, longest: float, shards: int) -> DataFrame:
    """``(shard, at, entry, ids, v, edges)``: one row per vector of ``classes(h1, h2, ids, v)``, written.

    ``edges`` are the places ``at`` of its neighbours in the shard. A shard is
    built in one task and holds about ``SHARD`` vectors at any table size.
    """

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by([("h1", "ascending"), ("h2", "ascending")])
        graph = build_graph(_lengthened(_array(table["v"], d), longest))
        keep = graph.edges >= 0
        entry = np.zeros(len(table), bool)
        entry[graph.entries] = True
        return pa.table(
            {
                "shard": table["shard"],
                "at": np.arange(len(table), dtype=np.int32),
                "entry": entry,
                "ids": table["ids"],
                "v": table["v"],
                "edges": lists(graph.edges[keep], keep.sum(axis=1), pa.int32()),
            }
        )

    dealt = classes.withColumn("shard", F.pmod("h1", F.lit(shards)).cast("int"))
    kind = classes.schema["ids"].dataType.simpleString()
    return written(
        dealt.groupBy("shard").applyInArrow(
            build, f"shard int, at int, entry boolean, ids {kind}, v array<double>, edges array<int>"
        )
    )


def _load(index: pa.Table, d: int, longest: float) -> Graph:
    counts = index["edges"].combine_chunks().value_lengths().to_numpy()
    edges = np.full((len(index), max(1, int(counts.max(initial=0)))), -1, np.int32)
    rank = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    edges[np.repeat(np.arange(len(index)), counts), rank] = index["edges"].combine_chunks().flatten().to_numpy()
    return Graph(_lengthened(_array(index["v"], d), longest), edges, np.flatnonzero(index["entry"].to_numpy()))


def _search(d: int, longest: float, k: int, beam: int, kind: pa.DataType):
    def run(index: pa.Table, queries: pa.Table) -> pa.Table:
        hits: dict[str, list] = {"h1": [], "h2": [], "ids": [], "score": []}
        if len(index) and len(queries):
            index = index.sort_by("at")
            graph, exact = _load(index, d, longest), _array(index["v"], d)
            asked = _array(queries["v"], d)
            width = max(beam, k)
            for at in range(0, len(asked), _BATCH):
                own = asked[at : at + _BATCH]
                long = np.column_stack([own, np.zeros(len(own))]).astype(np.float32)
                nodes, _, _ = graph.search(long, width)
                for i, row in enumerate(nodes):
                    row = row[row >= 0]
                    scores = (exact[row] * own[i]).sum(axis=1)
                    # Ties go to the smaller id.
                    first = [x[0].as_py() for x in index["ids"].take(pa.array(row))]
                    best = sorted(range(len(row)), key=lambda j: (-scores[j], first[j]))[:k]
                    for name in ("h1", "h2"):
                        hits[name] += [queries[name][at + i].as_py()] * len(best)
                    hits["ids"] += row[best].tolist()
                    hits["score"] += scores[best].tolist()
        return pa.table(
            {
                "h1": pa.array(hits["h1"], pa.int64()),
                "h2": pa.array(hits["h2"], pa.int64()),
                "ids": index["ids"].take(pa.array(hits["ids"], pa.int64())).cast(kind),
                "score": pa.array(hits["score"], pa.float64()),
            }
        )

    return run


def nearest(
    rows: DataFrame,
    queries: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    k: int = 20,
    beam: int = BEAM,
    shard: int = SHARD,
) -> DataFrame:
    """``(query_id, rank, <key>, score)``: for each row of ``queries`` the ``k`` nearest rows of ``rows`` found.

    Nearness is the inner product, in double precision on the vectors as given;
    ties go to the smaller key, and a query is no answer to itself. All rows are
    candidates and indexed; the search is approximate.

    Rows whose key is null, whose vector is null, empty or all zeros, holds null
    or non-finite entries, or has another length than most, take no part. Equal
    vectors are one node, which carries its ``k + 1`` least keys: no query can
    have further ones among its ``k``. Equal query vectors are searched once. A
    repeated row counts once; other columns are not looked at. An empty table on
    either side gives no rows.
    """
    spark = rows.sparkSession

    def keyed(table: DataFrame) -> DataFrame:
        own = usable_vectors(table, key, vector).where(
            F.col("key").isNotNull() & F.exists("v", lambda c: c != 0.0)
        )
        # Two hashes of a vector stand for it.
        return own.select("key", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"))

    every, asked = keyed(rows), keyed(queries)
    key_type = every.schema["key"].dataType.simpleString()
    d, _ = common_length(every)
    least = F.dense_rank().over(Window.partitionBy("h1", "h2").orderBy("key"))
    classes = written(
        every.where(F.size("v") == d)
        .withColumn("place", least)
        .where(F.col("place") <= k + 1)
        .groupBy("h1", "h2")
        .agg(F.first("v").alias("v"), F.sort_array(F.collect_set("key")).alias("ids"))
    )
    squares = F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c)
    many, longest = classes.agg(F.count("*"), F.max(squares)).first()
    if not many:
        return spark.createDataFrame([], f"query_id {key_type}, rank int, `{key}` {key_type}, score double")
    shards = -(-many // shard)
    index = build_index(classes, d, longest, shards)

    asked = asked.where(F.size("v") == d)
    vectors = asked.groupBy("h1", "h2").agg(F.first("v").alias("v"))
    vectors = written(vectors)
    blocks = max(1, -(-vectors.count() // QUERY_BLOCK))
    numbers = F.sequence(F.lit(0), F.lit(blocks - 1))
    spread = index.withColumn("block", F.explode(numbers))
    sent = vectors.withColumn("block", F.pmod("h2", F.lit(blocks)).cast("int")).withColumn(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    )
    kind = spark.createDataFrame([], f"ids array<{key_type}>").toArrow().schema[0].type
    found = (
        spread.groupBy("shard", "block")
        .cogroup(sent.groupBy("shard", "block"))
        .applyInArrow(
            _search(d, longest, k + 1, beam, kind), f"h1 long, h2 long, ids array<{key_type}>, score double"
        )
    )
    order = Window.partitionBy("h1", "h2").orderBy(F.desc("score"), "id")
    best = (
        found.select("h1", "h2", "score", F.explode("ids").alias("id"))
        .withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= k + 1)
        .groupBy("h1", "h2")
        .agg(F.sort_array(F.collect_list(F.struct("place", "id", "score"))).alias("hits"))
    )
    own = asked.select(F.col("key").alias("query_id"), "h1", "h2").distinct()
    others = F.slice(F.filter("hits", lambda x: x["id"] != F.col("query_id")), 1, k)
    return (
        own.join(written(best), ["h1", "h2"])
        .select("query_id", F.posexplode(others).alias("rank", "hit"))
        .select(
            "query_id",
            (F.col("rank") + 1).cast("int").alias("rank"),
            F.col("hit.id").alias(key),
            F.col("hit.score").alias("score"),
        )
    )
