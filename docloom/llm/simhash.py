"""SimHash near-duplicates: fingerprints, BK-tree search in shards, connected components.

A text's fingerprint has a bit set where more than half of its shingles' XXH64 values have
it. Fingerprints within `radius` bits are linked; the groups are the components.

Search works on distinct fingerprints, so a group of exact copies is one row however large
it is. With `radius` differing bits at most, two fingerprints agree in one of radius + 1
blocks of bits: each block's value is a shard, and every link lies in some shard. A shard
that is too large is split the same way over the bits that its members need not share, so
no link is lost and shards stay small. In each shard a BK-tree is grown: children are keyed
by their Hamming distance to the parent, and a search follows only edges within the radius
of its own distance. A tree is grown in the task that holds its shard, as the sum of all
trees has no bound that would allow a broadcast. A shard emits a spanning forest of its
links: no pairs within groups.

`near_copies` builds upon this what the pipeline needs: wider fingerprints as candidates for
texts that share a given part of their shingles.

Defined cases: null text is empty; a text without words has fingerprint zero, linked like
any other; a text of fewer words than a shingle is one shingle; repeated rows get the same
group; null ids are never a group's name unless all its ids are null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import spread_join, written
from .components import component_roots

SEED = 42
#: A shard with more fingerprints is split, twice at most.
SHARD_LIMIT, SPLITS = 1024, 2


#: Odd factors that make further hashes of a hash, for fingerprints of more than 64 bits.
FACTORS = np.multiply.accumulate(np.array([1, *[0x9E3779B97F4A7C15] * 15], np.uint64))


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of every shingle in its order, repeated ones too."""
    tokens = (text or "").encode().lower().split()  # bytes: ASCII case and white space only
    if not tokens:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(tokens), xxhash.xxh64_intdigest
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: max(1, len(tokens) - words + 1)].tolist()
    ends = ends[words - 1 :].tolist() or [len(joined)]
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True)), np.uint64, len(starts))


def hashes_fingerprint(hashes: np.ndarray, lanes: int = 1) -> np.ndarray:
    counts = np.zeros(64 * lanes, np.int64)
    for at in range(0, len(hashes), 16_384):
        some = hashes[at : at + 16_384, None] * FACTORS[:lanes]
        some[:, 1:] ^= some[:, 1:] >> np.uint64(32)
        counts += np.unpackbits(some.view(np.uint8).reshape(-1, 8 * lanes), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > len(hashes)).view(np.uint64)


def text_fingerprints(texts: list[str | None], words: int = 4, lanes: int = 1) -> np.ndarray:
    """The fingerprints: 64-bit unsigned integers, `lanes` of them for each text."""
    return np.array([hashes_fingerprint(shingle_hashes(t, words), lanes) for t in texts], np.uint64).reshape(-1, lanes)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """(id, fp): the fingerprint as a signed 64-bit integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                fps = text_fingerprints(part.column(1).to_pylist(), words)[:, 0].view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps)], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, fp bigint")


def fingerprint_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


class BKTree:
    """Children keyed by integer Hamming distance to the parent."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        node, place = 0, len(self.values)
        self.values.append(value)
        self.children.append({})
        while place:
            edge = (self.values[node] ^ value).bit_count()
            node = self.children[node].setdefault(edge, place)
            if node == place:
                return

    def within(self, value: int, radius: int) -> list[int]:
        """Places of all values within the radius."""
        found, stack = [], [0] if self.values else []
        values, children = self.values, self.children
        while stack:
            node = stack.pop()
            d = (values[node] ^ value).bit_count()
            if d <= radius:
                found.append(node)
            if kids := children[node]:
                low, high = d - radius, d + radius
                stack += [kid for edge, kid in kids.items() if low <= edge <= high]
        return found


def shard_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between the values of one shard."""
    tree, parent, links = BKTree(), list(range(len(values))), []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for k, value in enumerate(values):
        for hit in tree.within(value, radius):
            if (a := root(hit)) != (b := root(k)):
                parent[b] = a
                links.append((values[hit], value))
        tree.add(value)
    return links


def _masks(bits: list[int], parts: int) -> list[list[int]]:
    return [list(map(int, x)) for x in np.array_split(np.array(bits), parts)]


def _signed(bits: list[int]) -> int:
    mask = sum(1 << b for b in bits)
    return mask - (1 << 64) if mask >> 63 else mask


def shards(fps: DataFrame, radius: int, limit: int = SHARD_LIMIT, splits: int = SPLITS) -> DataFrame:
    """`fps` (fp) to rows (shard, fp). Two fingerprints within the radius share a shard.

    A path is the list of blocks agreed on so far. The children of a path divide the bits
    that are not in it, so that links within a shard survive its division.
    """
    paths: list[list[int]] = _masks(list(range(64)), radius + 1)
    rows = lambda: F.explode(F.array(*[F.struct(F.lit(i).alias("path"), F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(_signed(p)))).alias("shard")) for i, p in enumerate(paths)])).alias("s")
    level, done = fps.select("fp", rows()).select("fp", "s.*"), []
    for _ in range(splits):
        level = written(level, "shards")
        big = level.groupBy("path", "shard").agg(F.count("*").alias("n")).where(F.col("n") > limit).select("path", "shard")
        big = written(big, "big-shards")
        if big.isEmpty():
            break
        done.append(level.join(big, ["path", "shard"], "left_anti"))
        wide = level.join(big, ["path", "shard"], "left_semi")
        children, cases = [], F.array().cast("array<struct<path:int,shard:bigint>>")
        for i, path in enumerate(paths):
            own = [path + x for x in _masks([b for b in range(64) if b not in path], radius + 1)]
            made = F.array(*[F.struct(F.lit(len(children) + k).alias("path"), F.xxhash64(F.lit(len(children) + k), F.col("fp").bitwiseAND(F.lit(_signed(p)))).alias("shard")) for k, p in enumerate(own)])
            cases = F.when(F.col("path") == i, made).otherwise(cases)
            children += own
        level, paths = wide.select("fp", F.explode(cases).alias("s")).select("fp", "s.*"), children
    out = level.select("shard", "fp")
    for part in done:
        out = out.unionByName(part.select("shard", "fp"))
    return out


def links(fps: DataFrame, radius: int = 4) -> DataFrame:
    """(a, b): links that connect all distinct fingerprints within the radius."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, values = None, []

        def flush() -> Iterator[pa.RecordBatch]:
            if len(values) > 1 and (found := shard_links(values, radius)):
                pairs = np.array(found, np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        for batch in batches:
            keys = batch.column(0).to_numpy()
            fps = batch.column(1).to_numpy().view(np.uint64)
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if keys[a] != shard:
                    yield from flush()
                    shard, values = keys[a], []
                values.extend(fps[a:b].tolist())
        yield from flush()

    return shards(fps, radius).repartition("shard").sortWithinPartitions("shard").mapInArrow(run, "a bigint, b bigint").distinct()


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = 4) -> DataFrame:
    """(id, fp, component): one row per row of `docs`; the component is its smallest id."""
    fps = written(fingerprints(docs, id_col, text_col, words), "fingerprints")
    distinct = written(fps.groupBy("fp").agg(F.min("id").alias("least")), "distinct-fingerprints")
    roots = component_roots(links(distinct.select("fp"), radius))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component"))
    labels = written(spread_join(rooted, named, "root").select("fp", "component"), "components")
    return spread_join(fps, labels, "fp").select("id", "fp", "component")
