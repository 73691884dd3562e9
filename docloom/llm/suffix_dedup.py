"""Suffix-array dedup: remove every byte that lies in a string of `width` bytes which also
starts anywhere else.

1. Anchors. Every window of `width` bytes is owned by its leftmost smallest hashed gram.
   Equal windows own equal grams at equal offsets, so whatever repeats meets under one
   gram. The windows of one gram at one place make a segment.
2. Classes. Segments are counted by (gram, content): a segment with an equal elsewhere is
   covered whole. Only counts and hashes are shuffled, and they are summed first.
3. Suffix arrays. What is left are segments that differ from all others of their gram, at
   the edges of repeats. Their texts go to shards by gram. A shard's segments are written
   in symbols (gram, offset, 16 bytes), and its suffix array is built by linear grouping:
   suffixes are grouped by their Lyndon prefix from the largest group down, by means of
   previous-smaller pointers, and each group's order is then emitted in one sweep, without
   recursion or renaming. Neighbours that share 11 symbols are candidates; the windows
   around them are compared byte by byte.
4. Grams with more than `HOT` different open segments (a passage in very many documents)
   aren't gathered: their windows are counted by hash, which sums before it shuffles.

Texts move once, into buckets by row; the later joins read them where they lie.

Defined cases: null text is empty; texts shorter than the width lose nothing; repeated rows
repeat each other; ids may be null or equal, as rows have a key of their own; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, written

WIDTH, GRAM, SYMBOL, HOT = 200, 24, 16, 4_096
#: Segments that one suffix array holds, and bytes of a text that are hashed at once.
SHARD_SEGMENTS, PIECE = 8_192, 1 << 22
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)


def suffix_array(s: list[int]) -> list[int]:
    """The suffix array of `s`, whose last symbol must be its only smallest one."""
    n = len(s)
    values = np.asarray(s)
    sa = np.argsort(values, kind="stable")
    cut = np.flatnonzero(np.diff(values[sa], prepend=values[sa[0]] - 1))
    begin = np.repeat(cut, np.diff(cut, append=n))
    group = np.empty(n, np.int64)  # of each suffix: where its group begins
    group[sa] = begin
    place = np.empty(n, np.int64)
    place[sa] = np.arange(n)
    size = dict(zip(cut.tolist(), np.diff(cut, append=n).tolist(), strict=True))
    sa, group, place, before = sa.tolist(), group.tolist(), place.tolist(), [-1] * n
    end = n
    while end > 0:  # groups from the largest down
        start = group[sa[end - 1]]
        times: dict[int, int] = {}
        for i in sorted(sa[start:end]) if end - start > 1 else (sa[start],):
            j = i - 1
            while j >= 0 and group[j] >= start:
                j = before[j]
            before[i] = j
            if j >= 0:
                times[j] = times.get(j, 0) + 1
        by_times: dict[int, list[int]] = defaultdict(list)
        for p, k in times.items():
            by_times[k].append(p)
        for k in sorted(by_times, reverse=True):
            parts: dict[int, list[int]] = defaultdict(list)
            for p in by_times[k]:
                parts[group[p]].append(p)
            for old, members in parts.items():
                top = old + size[old]
                new = top - len(members)
                if new == old:
                    continue
                size[old], size[new] = new - old, len(members)
                for p in members:  # to the end of the group
                    top -= 1
                    at, other = place[p], sa[top]
                    sa[at], sa[top], place[other], place[p], group[p] = other, p, at, top, new
        end = start
    out, slot = [-1] * n, {}
    done = bytearray(n)
    out[0] = n - 1
    done[n - 1] = 1
    for i in range(n):  # each suffix emits those that end where it begins
        j = out[i] - 1
        while j >= 0 and not done[j]:
            g = group[j]
            at = slot.get(g, g)
            out[at], slot[g] = j, at + 1
            done[j] = 1
            j = before[j]
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


_POWERS = {}


def _powers(base: int, n: int) -> np.ndarray:
    if base not in _POWERS or len(_POWERS[base]) < n:
        x = np.full(max(n, 1 << 16), base, np.uint64)
        x[0] = 1
        _POWERS[base] = np.multiply.accumulate(x)
    return _POWERS[base][:n]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(BASE, len(data)), out=out[1:])
    return out


def range_hash(sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Of data[start:stop], wherever it lies."""
    return _mixed((sums[stop] - sums[start]) * _powers(INVERSE, len(sums))[start])


def _window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Smallest of each w neighbours."""
    n = len(x)
    full = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    full[:n] = x
    rows = full.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def segments(data: np.ndarray, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(gram hash, content hash, anchor, first, last): the windows `first` to `last` own the gram at `anchor`."""
    parts = []
    for at in range(0, max(1, len(data) - width + 1), PIECE):
        piece = data[at : at + PIECE + width - 1]
        n = len(piece)
        if n < width:
            break
        sums = prefix_sums(piece)
        i = np.arange(n - gram + 1)
        hashes = range_hash(sums, i, i + gram)
        best = _window_min((hashes & ~np.uint64(0xFFFFFF)) | i.astype(np.uint64), width - gram + 1) & np.uint64(0xFFFFFF)
        first = np.flatnonzero(np.diff(best, prepend=np.uint64(0xFFFFFFFF)))
        last = np.append(first[1:], len(best)) - 1
        anchor = best[first].astype(np.int64)
        # The content also tells where the gram lies in it, so that equal classes align.
        content = _mixed(range_hash(sums, first, last + width) + (anchor - first).astype(np.uint64))
        parts.append((hashes[anchor], content, anchor + at, first + at, last + at))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else tuple(np.zeros(0, d) for d in (np.uint64, np.uint64, np.int64, np.int64, np.int64))


def merged(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ranges' union as maximal runs."""
    if not len(starts):
        return starts, stops
    order = np.argsort(starts, kind="stable")
    starts, far = starts[order], np.maximum.accumulate(stops[order])
    new = np.flatnonzero(np.append(True, starts[1:] > far[:-1]))
    return starts[new], far[np.append(new[1:] - 1, len(far) - 1)]


def open_matches(shard: list[tuple[int, bytes, int, int]], width: int = WIDTH) -> list[tuple[int, int] | None]:
    """Of each segment (gram, bytes, anchor, number of windows; places from the segment's
    start): the first and last window that another segment of its gram has too."""
    need = (width - SYMBOL + 1) // SYMBOL  # whole symbols in any window
    places, symbols, owner = [], [], []
    for k, (gram, data, anchor, _) in enumerate(shard):
        at = np.arange(anchor % SYMBOL, len(data) - SYMBOL + 1, SYMBOL)
        raw = np.frombuffer(data, np.uint8)[at[:, None] + np.arange(SYMBOL)].view(np.uint64)
        symbols.append(_mixed(_mixed(raw[:, 0] + np.uint64(gram)) + raw[:, 1] * np.uint64(BASE) + ((at - anchor) // SYMBOL).astype(np.uint64)))
        places.append(at)
        owner.append(np.full(len(at), k))
    if not symbols:
        return []
    places, owner = np.concatenate(places), np.concatenate(owner)
    ranks = np.unique(np.concatenate(symbols), return_inverse=True)[1] + 1
    s = np.append(ranks, 0)
    sa = np.array(suffix_array(s.tolist()))
    sa = sa[sa + need < len(s)]
    same = np.ones(max(0, len(sa) - 1), bool)
    for k in range(need):
        same &= s[sa[1:] + k] == s[sa[:-1] + k]
    near = np.zeros(len(sa), bool)
    near[1:] |= same
    near[:-1] |= same
    hits = sa[near]
    # All windows around the candidates, compared by their bytes.
    found: dict[tuple, list[tuple[int, int]]] = defaultdict(list)
    tried = set()
    for k, at in zip(owner[hits].tolist(), places[hits].tolist(), strict=True):
        gram, data, anchor, windows = shard[k]
        for start in range(max(0, at + need * SYMBOL - width), min(at, windows - 1) + 1):
            if (k, start) not in tried:
                tried.add((k, start))
                found[gram, start - anchor, data[start : start + width]].append((k, start))
    out: list[tuple[int, int] | None] = [None] * len(shard)
    for group in found.values():
        if len(group) > 1:
            for k, start in group:
                low, high = out[k] or (start, start)
                out[k] = (min(low, start), max(high, start))
    return out


def _anchor_rows(texts: DataFrame, width: int) -> DataFrame:
    """(row, gram, content, anchor, first, last, n) of each text's segments; n is how often
    the text has it. Where n is above 1 a row of gram null covers all of them."""
    names = ["row", "gram", "content", "anchor", "first", "last", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part, out = batch.slice(at, 512), []
                for row, data in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    gram, content, anchor, first, last = segments(np.frombuffer(data, np.uint8), width)
                    if not len(gram):
                        continue
                    _, one, back, n = np.unique(gram ^ content, return_index=True, return_inverse=True, return_counts=True)
                    again = n[back] > 1
                    out.append((np.full(len(one), row), gram[one].view(np.int64), content[one].view(np.int64), anchor[one], first[one], last[one], n, np.zeros(len(one), bool)))
                    if again.any():
                        start, stop = merged(first[again], last[again] + width)
                        zero = np.zeros(len(start), np.int64)
                        out.append((zero + row, zero, zero, zero, start, stop - width, zero, np.ones(len(start), bool)))
                if out:
                    columns = [np.concatenate(x) for x in zip(*out, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1], mask=columns[7]), *[pa.array(c.astype(np.int64)) for c in columns[2:7]]], names=names)

    return texts.select("row", "data").mapInArrow(run, ", ".join(f"{c} bigint" for c in names))


def _segment_texts(asked: DataFrame, width: int) -> DataFrame:
    """`asked` (row, data, wants: anchors) to (gram, hot, row, first, data, anchor, windows)."""
    schema = "gram bigint, hot boolean, row bigint, first bigint, data binary, anchor bigint, windows bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, out = batch.slice(at, 256), []
                for row, data, wants in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    out += [(w["gram"], w["hot"], row, w["first"], data[w["first"] : w["last"] + width], w["anchor"] - w["first"], w["last"] - w["first"] + 1) for w in wants]
                if out:
                    kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split(" ")[0] for x in schema.split(", ")])

    return asked.mapInArrow(run, schema)


def _cold_spans(texts: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, where, gram = [], [], None

        def flush() -> Iterator[pa.RecordBatch]:
            hits = [(r, f + m[0], f + m[1] + width) for (r, f), m in zip(where, open_matches(shard, width), strict=True) if m]
            if hits:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*hits, strict=True)], names=["row", "start", "stop"])

        for batch in batches:
            for g, r, f, data, anchor, windows in zip(*(batch.column(c).to_pylist() for c in ("gram", "row", "first", "data", "anchor", "windows")), strict=True):
                if g != gram and len(shard) >= SHARD_SEGMENTS:
                    yield from flush()
                    shard, where = [], []
                gram = g
                shard.append((g & 0xFFFFFFFFFFFFFFFF, data, anchor, windows))
                where.append((r, f))
        yield from flush()

    return texts.repartition("gram").sortWithinPartitions("gram").select("gram", "row", "first", "data", "anchor", "windows").mapInArrow(run, "row bigint, start bigint, stop bigint")


def _hot_spans(texts: DataFrame, width: int) -> DataFrame:
    """Windows of crowded grams, counted by a hash of 128 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                windows = part.column("windows").to_numpy()
                digests = np.frombuffer(b"".join(hashlib.blake2b(data[i : i + width], digest_size=16).digest() for data, n in zip(part.column("data").to_pylist(), windows.tolist(), strict=True) for i in range(n)), np.int64).reshape(-1, 2)
                row, first = (np.repeat(part.column(c).to_numpy(), windows) for c in ("row", "first"))
                step = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (digests[:, 0].copy(), digests[:, 1].copy(), row, first, first + step)], names=["a", "b", "row", "first", "start"])

    rows = written(texts.select("row", "first", "data", "windows").mapInArrow(run, "a bigint, b bigint, row bigint, first bigint, start bigint"), "dedup-windows")
    twice = written(rows.groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1").select("a", "b"), "dedup-repeated")
    return rows.join(twice, ["a", "b"], "left_semi").groupBy("row", "first").agg(F.min("start").alias("start"), (F.max("start") + width).alias("stop")).select("row", "start", "stop")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept (the bytes that remain)."""
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("data"))
    name = f"dedup_texts_{uuid.uuid4().hex}"
    rows.repartition(buckets, "row").write.option("compression", "zstd").option("path", f"{shared_dir(spark)}/{name}").bucketBy(buckets, "row").saveAsTable(name)
    texts = spark.table(name)
    anchors = written(_anchor_rows(texts, width), "dedup-anchors")
    classes = anchors.where("gram is not null").groupBy("gram", "content").agg(F.sum("n").alias("n"))
    classes = written(classes, "dedup-classes")
    grams = classes.groupBy("gram").agg(F.count("*").alias("kinds"), F.count(F.when(F.col("n") == 1, 1)).alias("open"), F.sum("n").alias("all")).where("all > 1")
    state = classes.join(grams, "gram").select("gram", "content", (F.col("n") > 1).alias("full"), ((F.col("open") > 0) & (F.col("kinds") > 1)).alias("wanted"), (F.col("kinds") > HOT).alias("hot"))
    state = written(state.where("full or wanted"), "dedup-state")
    known = written(anchors.where("gram is not null").join(state, ["gram", "content"]), "dedup-known")
    spans = [anchors.where("gram is null").select("row", F.col("first").alias("start"), (F.col("last") + width).alias("stop")), known.where("full").select("row", F.col("first").alias("start"), (F.col("last") + width).alias("stop"))]
    # Of equal segments one goes to the suffix array, for others of their gram to meet.
    wanted = known.where("wanted").groupBy("gram", "content").agg(F.min(F.struct("row", "anchor", "first", "last", "hot")).alias("w")).select("gram", "w.*")
    wants = wanted.groupBy("row").agg(F.collect_list(F.struct("gram", "hot", "anchor", "first", "last")).alias("wants"))
    open_ = written(_segment_texts(texts.join(wants, "row").select("row", "data", "wants"), width), "dedup-open")
    spans += [_cold_spans(open_.where("not hot"), width), _hot_spans(open_.where("hot"), width)]
    every = spans[0]
    for s in spans[1:]:
        every = every.unionByName(s)
    by_row = every.groupBy("row").agg(F.collect_list("start").alias("starts"), F.collect_list("stop").alias("stops"))
    schema = f"id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, out = batch.slice(at, 256), []
                for data, starts, stops in zip(*(part.column(c).to_pylist() for c in ("data", "starts", "stops")), strict=True):
                    a, b = merged(np.array(starts or [], np.int64), np.array(stops or [], np.int64))
                    edges = [0, *np.stack([a, b], 1).ravel().tolist(), len(data)]
                    out.append((len(data), int((b - a).sum()), len(a), b"".join(data[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2))))
                columns = list(zip(*out, strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays([part.column("id"), *[pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)]], names=["id", "n_bytes", "n_removed", "n_spans", "kept"])

    return texts.join(by_row, "row", "left").select("id", "data", "starts", "stops").mapInArrow(cut, schema)


__all__ = ["merged", "open_matches", "remove_repeats", "segments", "suffix_array"]
