"""Groups of near-duplicates: SimHash fingerprints searched by BK-trees in shards.

Texts are linked that share `similarity` of their distinct shingles (Jaccard). Their
fingerprints of 512 bits then differ in about 15 % of the bits, too many for blocks of bits
to agree. So fingerprints are dealt to shards by min-hashes: two sets agree in one of them
with their similarity as probability, thus in one of BANDS groups of ROWS with 0.997 at
0.8. A fingerprint is in BANDS shards at any size of the corpus. In each shard a BK-tree is
searched within the radius that holds 0.985 of such pairs: 0.98 of all are found at a
similarity of just 0.8, and more above. What the trees find is a candidate; texts are linked
where their shingle sets overlap enough, by count.

A shard of more than CELL fingerprints is dealt to cells by a hash, each with the shard's
first fingerprint too. A cell gives a spanning forest of its nearest candidates. When the
forests are tested, what a shard holds in different groups still is searched once more, with
the shingle sets at hand: the fingerprints outside the shard's largest group, in trees of at
most CELL each, by all of the shard's fingerprints. Those of a shard that was dealt to cells
are all among them, also where their own cell had no candidate. Candidates are tested there
until one links two groups, and only links leave the task. So every candidate pair is tested
or in one group, no task holds more than two cells, and no group's pairs are written out. The
price is a comparison of each pair of a crowded shard outside its largest group.

Defined cases: as for `simhash`; texts with the same set of shingles are one fingerprint;
rows of the same id and text are one document; of a group without ids one row stays.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, spread_join, written
from .components import component_roots
from .simhash import SEED, BKTree, hashes_fingerprint, shingle_hashes

#: Lanes of a fingerprint; groups of min-hashes and min-hashes in each; fingerprints of a
#: cell; the part of pairs at the similarity that the radius must hold.
LANES, BANDS, ROWS, CELL, WITHIN = 8, 8, 3, 512, 0.985
#: Sets of few shingles scatter more: 4 of 5 differ in 0.1875 of the bits at the most.
SHORT, SHORT_SHARE, SHORT_WITHIN = 16, 0.1875, 0.9999
#: Odd multipliers that make further hashes of a hash.
MULTIPLIERS = np.random.default_rng(SEED).integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def differing_share(similarity: float) -> float:
    """Of the bits of two texts whose shingle sets overlap so (Jaccard), how many differ."""
    return float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def radius_for(share: float, within: float, bits: int = 64 * LANES) -> int:
    """The radius that holds this part of pairs of which that share of bits differs."""
    below = np.cumsum([math.comb(bits, d) * share**d * (1 - share) ** (bits - d) for d in range(bits + 1)])
    return int(np.searchsorted(below, within))


def band_recall(similarity: float) -> float:
    """The part of pairs of this similarity that share a shard."""
    return 1 - (1 - similarity**ROWS) ** BANDS


def band_keys(hashes: np.ndarray) -> list[int]:
    """A set's shards."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 16_384):
        least = np.minimum(least, (hashes[at : at + 16_384, None] * MULTIPLIERS).min(0))
    return [xxhash.xxh64_intdigest(least[b * ROWS : (b + 1) * ROWS].tobytes(), b) - (1 << 63) for b in range(BANDS)]


def _node(hashes: np.ndarray) -> int:
    """A set's name: texts of the same set are one."""
    return xxhash.xxh64_intdigest(hashes.tobytes(), SEED) - (1 << 63)


class Reach:
    """How far a search must go for a similarity, and which sizes of sets can have it."""

    def __init__(self, similarity: float) -> None:
        share = differing_share(similarity)
        self.similarity = similarity
        self.far = radius_for(share, WITHIN)
        self.short = radius_for(max(share, SHORT_SHARE), SHORT_WITHIN)

    def radius(self, n: int) -> int:
        """For a set of n; wide if the smallest set it can be even with is short, so that
        it doesn't matter which of two asks."""
        return self.short if n * self.similarity**2 <= SHORT + 1e-9 else self.far

    def even(self, n: int, m: int) -> bool:
        return min(n, m) >= self.similarity * max(n, m) - 1e-9

    def overlap(self, x: np.ndarray, n: int, y: np.ndarray, m: int) -> bool:
        """Whether the sets of sizes n and m, given by the lower halves of their hashes, do."""
        both = len(np.intersect1d(x, y, assume_unique=True))
        return both >= self.similarity * (n + m - both) - 1e-9


def _root(group: dict | list, x: int) -> int:
    while group[x] != x:
        group[x] = x = group[group[x]]
    return x


def cell_forest(values: list[int], sizes: list[int], reach: Reach) -> list[tuple[int, int]]:
    """Places of candidates: a spanning forest of the smallest distances within reach."""
    tree, found = BKTree(), []
    for k, value in enumerate(values):
        for hit in tree.within(value, reach.radius(sizes[k])):
            if reach.even(sizes[hit], sizes[k]):
                found.append(((values[hit] ^ value).bit_count(), hit, k))
        tree.add(value)
    group, links = list(range(len(values))), []
    for _, a, b in sorted(found):
        if (x := _root(group, a)) != (y := _root(group, b)):
            group[max(x, y)] = min(x, y)
            links.append((a, b))
    return links


def _by_cell(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """The rows of each run of equal first columns."""
    cell, rows = None, []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if row[:keys] != cell:
                if len(rows) > 1:
                    yield rows
                cell, rows = row[:keys], []
            rows.append(row[keys:])
    if len(rows) > 1:
        yield rows


def _pairs(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    flat = np.array(pairs, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(flat.min(1)), pa.array(flat.max(1))], names=["a", "b"])


def overlapping(pairs: DataFrame, sets: DataFrame, reach: Reach) -> DataFrame:
    """Those `pairs` (a, b) of nodes whose sets (node, n, hashes) overlap so or more (Jaccard).

    Sets are compared by the lower halves of their hashes: of two sets of n, n * n in 2^32
    shingles are expected to be taken for common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n, m, x, y = batch.columns
            held = [reach.overlap(np.frombuffer(x[i].as_buffer(), np.uint32), n_a, np.frombuffer(y[i].as_buffer(), np.uint32), n_b) for i, (n_a, n_b) in enumerate(zip(n.to_pylist(), m.to_pylist(), strict=True))]
            keep = pa.array(held, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], names=["a", "b"])

    first = sets.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("hashes").alias("of_a"))
    second = sets.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("hashes").alias("of_b"))
    met = spread_join(spread_join(pairs.select("a", "b"), first, "a", limit=CELL), second, "b", limit=CELL)
    return met.select("a", "b", "n_a", "n_b", "of_a", "of_b").mapInArrow(run, "a bigint, b bigint")


def _crowded(dealt: DataFrame) -> DataFrame:
    """(shard, parts): the shards of more than CELL fingerprints and the cells they need."""
    return dealt.groupBy("shard").agg(F.count("*").alias("rows")).where(F.col("rows") > CELL).select("shard", F.ceil(F.col("rows") / CELL).cast("int").alias("parts"))


def _forests(dealt: DataFrame, sizes: DataFrame, reach: Reach) -> DataFrame:
    """Candidates of `dealt` (shard, node, n, fp): a spanning forest of each cell. `sizes`:
    its crowded shards."""
    cells = dealt.select("shard", F.lit(0).alias("cell"), F.lit(1).alias("turn"), "node", "n", "fp")
    if not sizes.isEmpty():
        wide = spread_join(dealt, sizes, "shard", how="left")
        first = wide.where("parts is not null").groupBy("shard", "parts").agg(F.min(F.struct("node", "n", "fp")).alias("f"))
        first = first.select("shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("cell"), F.lit(0).alias("turn"), "f.*")
        cell = F.pmod(F.xxhash64("node"), F.coalesce("parts", F.lit(1))).cast("int")
        cells = wide.select("shard", cell.alias("cell"), F.lit(1).alias("turn"), "node", "n", "fp").unionByName(first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_cell(batches, 2):
            _, nodes, n, fps = zip(*({r[1]: r for r in rows}).values(), strict=True)
            if found := cell_forest([int.from_bytes(f, "big") for f in fps], n, reach):
                yield _pairs([(nodes[a], nodes[b]) for a, b in found])

    return cells.repartition("shard", "cell").sortWithinPartitions("shard", "cell", "turn", "fp", "node").mapInArrow(run, "a bigint, b bigint").distinct()


def _across(labelled: DataFrame, sets: DataFrame, reach: Reach) -> DataFrame:
    """Links of `labelled` (shard, node, n, fp, root) that connect different roots: for each
    shard as many as connect all that its candidates with enough overlap connect."""
    mixed = labelled.groupBy("shard").agg(F.count("*").alias("rows"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    mixed = written(mixed.select("shard", "rows"), "near-mixed")
    rows = spread_join(labelled, mixed, "shard").join(sets.select("node", "hashes"), "node")
    rows = written(rows, "near-mixed-rows")
    own = ("node", "n", "fp", "root", "hashes")
    cells = rows.where(F.col("rows") <= CELL).select("shard", F.lit(0).alias("o"), F.lit(0).alias("c"), F.lit(2).alias("side"), *own)
    crowded = rows.where(F.col("rows") > CELL)
    if not crowded.isEmpty():
        by_root = crowded.groupBy("shard", "root").agg(F.count("*").alias("k"))
        main = by_root.groupBy("shard").agg(F.max(F.struct("k", "root")).alias("m"), F.sum("k").alias("all"))
        parts = lambda n: F.ceil(n / CELL).cast("int")
        main = written(main.select("shard", F.col("m.root").alias("main"), parts(F.col("all") - F.col("m.k")).alias("os"), parts(F.col("all")).alias("cs")), "near-main")
        wide = spread_join(crowded, main, "shard")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        part = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
        trees = wide.where("root <> main").select("shard", part("os").alias("o"), every("cs").alias("c"), F.lit(0).alias("side"), *own)
        asked = wide.select("shard", every("os").alias("o"), part("cs").alias("c"), F.lit(1).alias("side"), *own)
        cells = cells.unionByName(trees).unionByName(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_cell(batches, 3):
            if rows[0][0] == 2:
                main = Counter(r[4] for r in rows).most_common(1)[0][0]
                held, asked = [r for r in rows if r[4] != main], rows
            else:
                held, asked = [r for r in rows if r[0] == 0], [r for r in rows if r[0] == 1]
            tree, group, links = BKTree(), {r[4]: r[4] for r in rows}, []
            values, sets = [int.from_bytes(r[3], "big") for r in held], [np.frombuffer(r[5], np.uint32) for r in held]
            for value in values:
                tree.add(value)
            for _, node, n, fp, root, hashes in asked:
                value, own = int.from_bytes(fp, "big"), np.frombuffer(hashes, np.uint32)
                near = [h for h in tree.within(value, reach.radius(n)) if reach.even(n, held[h][2])]
                for h in sorted(near, key=lambda h: (values[h] ^ value).bit_count()):
                    a, b = _root(group, root), _root(group, held[h][4])
                    if a != b and reach.overlap(own, n, sets[h], held[h][2]):
                        group[a] = b
                        links.append((node, held[h][1]))
            if links:
                yield _pairs(links)

    return cells.repartition("shard", "o", "c").sortWithinPartitions("shard", "o", "c", "side", "fp", "node").mapInArrow(run, "a bigint, b bigint").distinct()


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(id, fp, component): groups of rows linked by shingle sets that overlap so or more."""
    reach = Reach(similarity)
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    texts = texts.withColumn("same", F.xxhash64("text"))

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [np.unique(shingle_hashes(t, words)) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array([_node(s) for s in sets]), pa.array([len(s) for s in sets]), pa.array([hashes_fingerprint(s, LANES).tobytes() for s in sets], pa.binary()), pa.array([band_keys(s) for s in sets], pa.list_(pa.int64()))],
                    names=["id", "same", "node", "n", "fp", "shards"],
                )

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                sets = [np.unique(shingle_hashes(t, words)) for t in batch.slice(at, 256).column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([_node(s) for s in sets]), pa.array([len(s) for s in sets]), pa.array([np.sort(s.astype(np.uint32)).tobytes() for s in sets], pa.binary())], names=["node", "n", "hashes"])

    fps = written(texts.mapInArrow(prints, f"id {kind}, same bigint, node bigint, n bigint, fp binary, shards array<bigint>"), "near-prints")
    distinct = fps.groupBy("node").agg(F.min(F.struct("id", "same", "n", "fp", "shards")).alias("s"))
    distinct = written(distinct.select("node", F.col("s.id").alias("least"), "s.same", "s.n", "s.fp", "s.shards"), "near-distinct")
    dealt = distinct.select(F.explode("shards").alias("shard"), "node", "n", "fp")
    crowded = written(_crowded(dealt), "near-crowded")
    tried = written(_forests(dealt, crowded, reach), "near-tried")
    again = tried.select(F.explode(F.array("a", "b")).alias("node"))
    if not crowded.isEmpty():  # the candidates of a cell's fingerprint may all lie in others
        again = again.unionByName(spread_join(dealt.select("shard", "node"), crowded, "shard").select("node"))
    met = written(distinct.join(again.distinct(), "node", "left_semi"), "near-met")
    wanted = met.select(F.col("least").alias("id"), "same")
    chosen = texts.join(wanted, texts["id"].eqNullSafe(wanted["id"]) & (texts["same"] == wanted["same"]), "left_semi")
    sets = written(chosen.select("text").mapInArrow(sets_of, "node bigint, n bigint, hashes binary").dropDuplicates(["node"]), "near-sets")
    held = written(overlapping(tried, sets, reach), "near-links")
    roots = written(component_roots(held), "near-roots")
    labelled = met.join(roots, "node", "left").select(F.explode("shards").alias("shard"), "node", "n", "fp", F.coalesce("root", "node").alias("root"))
    more = written(_across(labelled, sets, reach), "near-more")
    if not more.isEmpty():
        roots = component_roots(held.unionByName(more))
    rooted = distinct.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component"))
    labels = written(spread_join(rooted, named, "root").select("node", "component"), "near-components")
    return fps.join(labels, "node").select("id", "fp", "component")


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of `docs` that stand for their groups: of each, one row of the smallest id."""
    key, row = free_name(docs, "key"), free_name(docs, "row")
    ids = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
    keyed = docs.withColumn(key, F.to_json(ids))
    groups = similar_groups(docs.select(ids.alias(row), text_col), row, text_col, words, similarity)
    kept = groups.where(F.col("id").eqNullSafe(F.col("component"))).select(F.to_json("id").alias(key)).distinct()
    return keyed.join(kept, key, "left_semi").dropDuplicates([key]).drop(key)
