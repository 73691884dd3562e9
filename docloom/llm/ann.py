"""Approximate nearest neighbours over balanced posting lists.

Centroids are fitted on a bounded sample by hierarchical balanced clustering. Every vector
goes to its nearest centroid's list. Boundary vectors, the part BOUNDARY of all whose next
centroid is nearly as close, are replicated to further lists, unless a list already chosen
lies close to that centroid. Centroids are found through an in-memory neighbour graph,
searched best first. A query takes the lists whose centroids are within a ratio of its
nearest centroid's distance, and ranks what they hold by exact distance.

Both ratios are measured when the index is built, on bounded samples: that of a boundary by
quantile, and that of a query by brute force of QUERIES sampled vectors against all: the
ratio by which FOUND of their true neighbours are in lists within it. So clustered vectors
have few lists read, and vectors without clusters as many as they need.

Equal vectors are one entry: it keeps the smallest k + 1 ids, as no answer can need more,
so a vector that a third of all rows share is one candidate and one query. Lists lie in
regions of about REGION_ROWS postings, neighbouring lists together; a longer list is dealt to
several regions, all of which its queries visit: no entry is dropped. A query first visits
the region of its nearest list, and takes from its other regions only what is no farther than
the last of its k best so far. What is broadcast is the graph: at most MOST_CENTROIDS vectors.
The driver holds the sample, its centroids and the graph, and distances in blocks of BLOCK.

Defined cases: vectors that are null, zero, of another length than most, or that hold null
or non-finite components take no part; ties go to the smaller id; with fewer than k
candidates all are returned; repeated rows of one id count as candidates once; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Bounds of the index: rows of the fitting sample, centroids, neighbours in the graph.
SAMPLE_ROWS, MOST_CENTROIDS, DEGREE = 131_072, 16_384, 16
#: Entries a centroid stands for, the part of vectors that are replicated, lists of each at
#: most and the ratio that they must be within whatever the part.
PER_CENTROID, BOUNDARY, REPLICAS, CLOSURE = 48, 0.3, 3, 1.25
#: Sampled vectors that the ratio of queries is measured with, and the part of their true
#: neighbours that must be in the lists they then read.
QUERIES, FOUND = 256, 0.93
#: Distances that the driver computes at once.
BLOCK = 2_000_000
#: Postings of a region, which one call ranks.
REGION_ROWS = 16_384


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, points by centres."""
    d = points @ centres.T
    d *= -2
    d += (points**2).sum(1)[:, None]
    d += (centres**2).sum(1)[None]
    return np.maximum(d, 0, out=d)


def _balanced_split(points: np.ndarray, parts: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """k-means labels with a penalty on large clusters."""
    centres = points[rng.choice(len(points), parts, replace=False)]
    size = np.full(parts, len(points) / parts)
    for _ in range(rounds):
        d = _nearest(points, centres)
        label = (d + 0.1 * d.mean() * (size / size.mean())[None]).argmin(1)
        size = np.bincount(label, minlength=parts).astype(float)
        for c in np.flatnonzero(size):
            centres[c] = points[label == c].mean(0)
    return label


def fit_centroids(sample: np.ndarray, count: int, seed: int = 7) -> np.ndarray:
    """At most `count` centroids by splitting the sample again and again until clusters are small."""
    rng, small, out, todo = np.random.default_rng(seed), max(1, len(sample) // max(1, count)), [], [sample]
    while todo:
        points = todo.pop()
        if len(points) <= small * 1.5 or len(points) < 4:
            out.append(points.mean(0))
            continue
        parts = int(min(16, max(2, len(points) // small)))
        label = _balanced_split(points, parts, rng)
        groups = [points[label == c] for c in range(parts) if (label == c).any()]
        if len(groups) == 1:
            out.append(points.mean(0))
        else:
            todo += groups
    return np.array(out, np.float64)[:MOST_CENTROIDS] if out else np.zeros((0, sample.shape[1]))


class CentroidGraph:
    """Centroids linked to their nearest ones, searched best first from spread entries."""

    def __init__(self, centres: np.ndarray, degree: int = DEGREE) -> None:
        self.centres = centres
        n = len(centres)
        self.norms = (centres**2).sum(1)
        k = min(degree + 1, n)
        self.links = np.zeros((n, k), int)
        step = max(1, BLOCK // max(1, n))
        for at in range(0, n, step):  # into place: a view of a block's order would keep all n distances of a row
            self.links[at : at + step] = np.argpartition(_nearest(centres[at : at + step], centres), k - 1, axis=1)[:, :k]
        self.entries = np.arange(0, n, 4)
        self.single = centres.astype(np.float32)

    def search(self, points: np.ndarray, k: int, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(places, distances) of about the k nearest centroids of each point, nearest first.

        A beam of `width` centroids is widened by its links until it no longer changes; all
        points of a batch move at once.
        """
        n, m = len(self.centres), len(points)
        k = min(k, n)
        width = min(n, max(width or 0, k, DEGREE))
        norms, single = (points**2).sum(1), points.astype(np.float32)

        def dist(places: np.ndarray) -> np.ndarray:
            return np.maximum(norms[:, None] - 2 * np.matmul(self.single[places], single[:, :, None])[:, :, 0] + self.norms[places], 0)

        d0 = np.maximum(norms[:, None] - 2 * points @ self.centres[self.entries].T + self.norms[self.entries][None], 0)
        first = min(max(8, k // 4), len(self.entries))
        beam, reach = self.entries[np.argpartition(d0, first - 1, axis=1)[:, :first]], max(8, k // 2)
        for _ in range(6):
            wide = np.concatenate([beam, self.links[beam[:, :reach]].reshape(m, -1)], axis=1)
            wide.sort(axis=1)
            d = dist(wide)
            d[:, 1:][wide[:, 1:] == wide[:, :-1]] = np.inf
            keep = np.argsort(d, axis=1, kind="stable")[:, :width]
            new, nd = np.take_along_axis(wide, keep, 1), np.take_along_axis(d, keep, 1)
            if beam.shape == new.shape and (beam[:, :reach] == new[:, :reach]).all():
                beam = new
                break
            beam = new
        ok = np.isfinite(nd)
        return np.where(ok, beam, -1)[:, :k], np.sqrt(np.where(ok, nd, np.inf))[:, :k]


def choose_lists(graph: CentroidGraph, points: np.ndarray, closure: float) -> list[np.ndarray]:
    """The lists of each vector: the nearest, and for boundary vectors close ones that no
    chosen list shields."""
    places, dist = graph.search(points, REPLICAS * 2)
    near = (places >= 0) & (dist <= closure * dist[:, :1])
    out = []
    for row, d, ok in zip(places, dist, near, strict=True):
        chosen = [row[0]]
        for c, dc in zip(row[1:][ok[1:]], d[1:][ok[1:]], strict=True):
            if len(chosen) == REPLICAS:
                break
            gaps = ((graph.centres[chosen] - graph.centres[c]) ** 2).sum(1)
            if (gaps > (0.25 * dc) ** 2).all():
                chosen.append(c)
        out.append(np.array(chosen))
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(n, -1) if n else np.zeros((0, 0))


class Index(NamedTuple):
    """Entries (v, ids, lists) with the graph of their lists' centroids, and what queries take."""

    assigned: DataFrame
    graph: CentroidGraph
    closure: float
    ratio: float
    probes: int


def _measured_ratio(assigned: DataFrame, graph: CentroidGraph, k: int) -> tuple[float, int]:
    """(the ratio of centroid distances, the number of lists) that FOUND of the true k nearest
    of sampled entries need; by brute force in the tasks, which send k + 1 rows a query."""
    sample = assigned.select("v").orderBy(F.xxhash64("v"), "v").limit(QUERIES).toArrow()
    asked = np.concatenate([_matrix(c) for c in sample.column("v").chunks if len(c)])
    ratios = _nearest(asked, graph.centres)  # of at most QUERIES to at most MOST_CENTROIDS
    np.sqrt(ratios, out=ratios)
    ratios /= np.maximum(ratios.min(1, keepdims=True), 1e-12)
    shared = assigned.sparkSession.sparkContext.broadcast((asked, ratios))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, ratios = shared.value
        best = [[] for _ in asked]
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                some = batch.slice(at, 4096)
                d, lists = _nearest(asked, _matrix(some.column("v"))), some.column("lists").to_pylist()
                for q, row in enumerate(d):
                    near = np.argpartition(row, min(k, len(row) - 1))[: k + 1]
                    best[q] = sorted([*best[q], *((float(row[i]), float(ratios[q, lists[i]].min())) for i in near)])[: k + 1]
        rows = [(q, *r) for q, found in enumerate(best) for r in found]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.float64(), pa.float64()), strict=True)], names=["q", "d", "need"])

    rows = assigned.select("v", "lists").mapInArrow(run, "q int, d double, need double")
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("d", "need"))).where((F.col("r") > 1) & (F.col("r") <= k + 1))
    need = ranked.select("need").toArrow().column("need").to_numpy()  # k rows of each query; the first is itself
    ratio = float(np.quantile(need, FOUND)) if len(need) else 1.0
    within = (ratios <= ratio + 1e-9).sum(1)
    return ratio, int(min(len(graph.centres), np.ceil(within.max() * 1.1) + 1))


def _sampled(entries: DataFrame, n: int) -> np.ndarray:
    """About SAMPLE_ROWS of the n vectors, one at least."""
    sample = entries.sample(min(1.0, SAMPLE_ROWS / n), seed=7).select("v").limit(SAMPLE_ROWS * 5 // 4).toArrow()
    points = [_matrix(c) for c in sample.column("v").chunks if len(c)]
    return np.concatenate(points or [_matrix(c) for c in entries.select("v").limit(1).toArrow().column("v").chunks])


def build_index(entries: DataFrame, k: int, id_type: str) -> Index | None:
    """The index of `entries` (v, ids); None without any."""
    spark, n = entries.sparkSession, entries.count()
    if not n:
        return None
    points = _sampled(entries, n)
    centres, points = fit_centroids(points, min(MOST_CENTROIDS, max(1, n // PER_CENTROID))), points[:4096].copy()
    graph = CentroidGraph(centres)
    near = np.concatenate([graph.search(points[at : at + 512], 2)[1] for at in range(0, len(points), 512)])
    closure = min(CLOSURE, float(np.quantile(near[:, 1] / np.maximum(near[:, 0], 1e-12), BOUNDARY))) if near.shape[1] > 1 else 1.0
    shared = spark.sparkContext.broadcast(graph)  # at most MOST_CENTROIDS vectors

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                lists = choose_lists(shared.value, _matrix(some.column("v")), closure)
                yield pa.RecordBatch.from_arrays([some.column("v"), some.column("ids"), pa.array([x.tolist() for x in lists], pa.list_(pa.int32()))], names=["v", "ids", "lists"])

    assigned = written(entries.select("v", "ids").mapInArrow(assign, f"v array<double>, ids array<{id_type}>, lists array<int>"), "ann-assigned")
    return Index(assigned, graph, closure, *_measured_ratio(assigned, graph, k))


def _regions(counts: pa.Table, lists: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each list the first of its regions and their number; short neighbours share one."""
    size = np.zeros(lists, np.int64)
    size[counts.column("list").to_numpy()] = counts.column("count").to_numpy()
    parts = np.maximum(1, -(-size // REGION_ROWS))
    first = np.cumsum(np.where(parts == 1, size, 0)) // REGION_ROWS
    long = np.flatnonzero(parts > 1)
    first[long] = first.max(initial=0) + 1 + np.concatenate([[0], np.cumsum(parts[long])[:-1]]) if len(long) else first[long]
    return first, parts


def search(vectors: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score) for the rows where `is_query` holds, against all others."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).where(F.forall("v", fine) & F.exists("v", lambda x: x != 0))
    rows = rows.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))  # one zero
    width = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    id_type = vectors.schema[id_col].dataType.simpleString()
    schema = f"query_id {id_type}, rank int, id {id_type}, score double"
    if width is None:
        return vectors.sparkSession.createDataFrame([], schema)
    rows = rows.where(F.size("v") == width[0]).withColumn("h", F.xxhash64("v"))
    # The k + 1 smallest ids of equal vectors; the limit by rank works before the shuffle too.
    ranked = rows.withColumn("r", F.dense_rank().over(Window.partitionBy("h", "v").orderBy("id"))).where(F.col("r") <= k + 1)
    entries = written(ranked.groupBy("h", "v").agg(F.array_sort(F.collect_set("id")).alias("ids")).select(F.col("h").alias("entry"), "v", "ids"), "ann-entries")
    index = build_index(entries, k, id_type)
    spark, graph, ratio, probes = vectors.sparkSession, index.graph, index.ratio, index.probes
    postings = index.assigned.select(F.explode("lists").alias("list"), "v", "ids")
    first, parts = _regions(postings.groupBy("list").count().toArrow(), len(graph.centres))  # at most MOST_CENTROIDS rows
    places = F.broadcast(spark.createDataFrame(pd.DataFrame({"list": np.arange(len(first), dtype=np.int32), "first": first, "parts": parts})))
    postings = postings.join(places, "list").select((F.col("first") + F.pmod(F.xxhash64("v"), F.col("parts"))).cast("int").alias("region"), "list", "v", "ids")
    postings = written(postings, "ann-postings")

    queries = written(rows.where(is_query).select("id", "v"), "ann-queries")
    asked = queries.groupBy("v").agg(F.min("id").alias("qid"))
    shared = spark.sparkContext.broadcast((graph, first, parts))
    step = max(8, 200_000 // (9 * probes))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, first, parts = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                some, out = batch.slice(at, step), []
                near, dist = graph.search(_matrix(some.column("v")), probes)
                for i, (row, d) in enumerate(zip(near, dist, strict=True)):
                    lists = row[(row >= 0) & (d <= ratio * d[0] + 1e-9)]
                    by_region: dict[int, list[int]] = {}
                    for one in lists.tolist():
                        for r in range(first[one], first[one] + parts[one]):
                            by_region.setdefault(r, []).append(one)
                    out += [(r, own, i, k == 0) for k, (r, own) in enumerate(by_region.items())]
                region, lists, take, nearest = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(region, pa.int32()), pa.array(lists, pa.list_(pa.int32())), pa.array(nearest), *[some.column(c).take(pa.array(take)) for c in ("v", "qid")]], names=["region", "lists", "nearest", "v", "qid"])

    routed = written(asked.mapInArrow(route, f"region int, lists array<int>, nearest boolean, v array<double>, qid {id_type}"), "ann-routed")

    whole = id_type in ("tinyint", "smallint", "int", "bigint")

    def rank(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            left = left.sort_values("list", kind="stable")
            vs, ids, lists = np.stack(left["v"].to_numpy()), left["ids"].to_numpy(), left["list"].to_numpy()
            smallest = np.array([x[0] for x in ids])
            for q, qv, own, far in zip(right["qid"], right["v"], right["lists"], right["far"], strict=True):
                begin, end = np.searchsorted(lists, own, "left"), np.searchsorted(lists, own, "right")
                at = np.concatenate([np.arange(a, b) for a, b in zip(begin, end, strict=True)])
                at = at[np.unique(smallest[at], return_index=True)[1]]  # of replicas one
                exact = np.sqrt(((vs[at] - qv) ** 2).sum(1))
                order = np.lexsort((smallest[at], exact))[: k + 1]
                found = [(float(exact[o]), i) for o in order if not exact[o] > far for i in ids[at[o]]]
                last = sorted(found)[k][0] if len(found) > k else np.inf
                out += [(q, score, i, last) for score, i in found]
        return pd.DataFrame(out, columns=["qid", "score", "id", "far"]).astype({"score": "float64", "far": "float64"} | ({} if out else dict.fromkeys(("qid", "id"), "int64" if whole else "object")))

    def ranked_in(some: DataFrame) -> DataFrame:
        return postings.groupBy("region").cogroup(some.groupBy("region")).applyInPandas(rank, f"qid {id_type}, score double, id {id_type}, far double")

    near = written(ranked_in(routed.where("nearest").withColumn("far", F.lit(float("inf")))), "ann-near")
    far = near.groupBy("qid").agg(F.min("far").alias("far"))
    rest = routed.where("not nearest").join(far, "qid", "left").withColumn("far", F.coalesce("far", F.lit(float("inf"))))
    hits = near.unionByName(ranked_in(rest)).drop("far")
    # Of each distinct query vector the best k + 1, as the query's own row is among them.
    best = hits.groupBy("qid", "id").agg(F.min("score").alias("score"))
    best = best.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy("score", "id"))).where(F.col("r") <= k + 1).select("qid", "id", "score")
    same = asked.select("qid", "v").join(queries, "v").select("qid", F.col("id").alias("query_id")).distinct()
    found = same.join(best, "qid").where("id <> query_id")
    order = Window.partitionBy("query_id").orderBy("score", "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
