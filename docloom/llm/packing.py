"""Packing token sequences by bounded-space online best fit.

Every partition keeps a fixed number of open windows. A document's ids go to the open
window that they fill best; chunks of a whole window go out at once. If no window can hold
the rest and no new one may be opened, the fullest is filled up with the head of the
document, so that it goes out without padding, or with a few ids of padding where the head
would be too short. Windows that stay open at the end of a partition are merged in groups
of a fixed number of partitions, again and again, until one group is left; its last ids
are cut into sequences whose lengths are powers of two, which need no padding.

A task's memory is its open windows. A merging task holds the open windows of one group,
whose number is fixed, so no step grows with the input.

Defined cases: null and empty texts have the end id only; repeated rows are packed each;
an empty table gives no rows; columns other than id and text are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

WINDOW, OPEN, SHORTEST, END_ID = 2048, 16, 8, 1
#: Words whose ids a task remembers, and partitions whose open windows merge in one task.
CACHE, FAN_IN = 700_000, 64
#: Texts that must have the same ids split and whole, for a tokenizer to be split at all.
PROBES = ("Hello, world.", "  two  spaces\tand\nlines\r\n", "don't stop... now", "naïve ÉTÉ straße", "x=1; y=[2,3]", "日本語 のテキスト", "A.B. C.,", " lead and trail ")
CHUNK = re.compile(r"[^\t\n\x0b\x0c\r ]+")


class Encoder:
    """Token ids as little-endian 32-bit bytes; `split` caches them by white-space chunk.

    Splitting is right for tokenizers that drop white space and never join across it, and
    whose letters and punctuation are apart: a chunk of letters with `.,` behind it is
    looked up in two parts. New words are encoded many at a time; a token that ends in
    `</w>` ends a word, and where the ends don't tally the words are encoded singly.
    """

    def __init__(self, path: str, split: bool = True) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.split, self.known = split, {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        if split and any(self.encode([text]) != self._ids([text]) for text in PROBES):
            raise ValueError("this tokenizer's ids depend on white space or on what is beside a word; set split to False")

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for at in range(0, len(words), 256):
            some = words[at : at + 256]
            ids = np.frombuffer(self._ids([" ".join(some)])[0], "<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(some):
                data = ids.tobytes()
                stops = (cuts * 4).tolist()
                out += [data[a:b] for a, b in zip([0, *stops], stops, strict=False)]
            else:
                out += self._ids(some)
        return out

    def _learn(self, chunks: set[str]) -> None:
        known, letters, others, parts = self.known, set(), set(), {}
        for chunk in chunks:
            core = chunk.rstrip(".,")
            if core.isalpha():
                parts[chunk] = (core.lower() if core.isascii() else core, chunk[len(core) :])
                letters.add(parts[chunk][0])
                others.add(parts[chunk][1])
            else:
                others.add(chunk)
        new = [w for w in letters if w not in known]
        known.update(zip(new, self._words(new), strict=True))
        others = [w for w in others if w not in known]
        known.update(zip(others, self._ids(others), strict=True))
        known.update([(chunk, known[core] + known[tail]) for chunk, (core, tail) in parts.items()])

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.split:
            return self._ids(texts)
        if len(self.known) > CACHE:
            self.known.clear()
        chunks = [CHUNK.findall(t) for t in texts]
        if new := set().union(*chunks).difference(self.known):
            self._learn(new)
        find = self.known.__getitem__
        return [b"".join(map(find, c)) for c in chunks]


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(path: str, split: bool) -> Encoder:
    """One per Python worker, so that its words stay known from task to task."""
    if (path, split) not in _ENCODERS:
        _ENCODERS[path, split] = Encoder(path, split)
    return _ENCODERS[path, split]


Piece = tuple  # id, start, ids as bytes, ids of the whole document


class Packer:
    """Open windows of one task. `out` collects (sequence, piece, offset) of those that left."""

    def __init__(self, first: int, window: int = WINDOW, open_: int = OPEN, shortest: int = SHORTEST) -> None:
        self.next, self.window, self.limit, self.shortest = first, window, open_, shortest
        self.open: list[list] = []  # [ids so far, pieces]
        self.out: list[tuple[int, Piece, int]] = []

    def _emit(self, pieces: list[Piece]) -> None:
        offset = 0
        for p in pieces:
            self.out.append((self.next, p, offset))
            offset += len(p[2]) // 4
        self.next += 1

    def _put(self, w: list, piece: Piece) -> None:
        w[0] += len(piece[2]) // 4
        w[1].append(piece)
        if w[0] == self.window:
            self.open.remove(w)
            self._emit(w[1])

    def add(self, piece: Piece) -> None:
        key, start, ids, whole = piece
        while len(ids) >= 4 * self.window:
            self._emit([(key, start, ids[: 4 * self.window], whole)])
            start, ids = start + self.window, ids[4 * self.window :]
        while n := len(ids) // 4:
            fits = [w for w in self.open if w[0] + n <= self.window]
            if fits:
                return self._put(max(fits, key=lambda w: w[0]), (key, start, ids, whole))
            if len(self.open) < self.limit:
                self.open.append(w := [0, []])
                return self._put(w, (key, start, ids, whole))
            fullest = max(self.open, key=lambda w: w[0])
            gap = self.window - fullest[0]
            if gap < self.shortest:
                self.open.remove(fullest)
                self._emit(fullest[1])
                continue
            self._put(fullest, (key, start, ids[: 4 * gap], whole))
            start, ids = start + gap, ids[4 * gap :]

    def settle(self, last: bool) -> list[Piece]:
        """Pour the open windows together. The last ones go out in powers of two, else
        what doesn't fill a window is returned."""
        pieces = [p for w in sorted(self.open, key=lambda w: -w[0]) for p in w[1]]
        total, self.open = sum(len(p[2]) // 4 for p in pieces), []
        while total >= self.window or last and total:
            size = self.window if total >= self.window else 1 << (total.bit_length() - 1)
            total, need, now = total - size, size, []
            while need:
                key, start, ids, whole = pieces.pop(0)
                n = min(need, len(ids) // 4)
                now.append((key, start, ids[: 4 * n], whole))
                if 4 * n < len(ids):
                    pieces.insert(0, (key, start + n, ids[4 * n :], whole))
                need -= n
            self._emit(now)
        return pieces


def _rows(out: list, left: list[Piece], part: int) -> dict[str, list]:
    rows = [(p[0], p[1], len(p[2]) // 4, zlib.crc32(p[2]), p[3], seq, at, None, None) for seq, p, at in out]
    rows += [(p[0], p[1], len(p[2]) // 4, None, p[3], None, None, p[2], part) for p in left]
    return dict(zip(("id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids", "part"), map(list, zip(*rows, strict=True)) if rows else [[]] * 9, strict=True))


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, open_windows: int = OPEN, end_id: int = END_ID, split: bool = True) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary, part bigint"
    end = end_id.to_bytes(4, "little")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokens, part = encoder(tokenizer, split), TaskContext.get().partitionId()
        packer = Packer(part << 32, window, open_windows)

        def batch_of(left: list[Piece]) -> pa.RecordBatch:
            rows = _rows(packer.out, left, part)
            packer.out = []
            return pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) for f in arrow], schema=arrow)

        arrow = None
        for batch in batches:
            arrow = arrow or pa.schema([("id", batch.schema.field(0).type), *[(c, pa.int64()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")], ("ids", pa.binary()), ("part", pa.int64())])
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                for key, ids in zip(some.column(0).to_pylist(), tokens.encode([t or "" for t in some.column(1).to_pylist()]), strict=True):
                    ids += end
                    packer.add((key, 0, ids, len(ids) // 4))
                yield batch_of([])
        if arrow is not None:
            yield batch_of(packer.settle(last=False))

    def merge(base: int, last: bool):
        def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            packer = Packer(base + (int(key[0]) << 24), window, open_windows)
            rows = rows.sort_values(["part", "start"], kind="stable")
            packer.open = [[0, list(zip(rows["id"], rows["start"], rows["ids"], rows["doc_tokens"], strict=True))]]
            left = packer.settle(last)
            return pd.DataFrame(_rows(packer.out, left, int(key[0]))).astype({c: "Int64" for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "part")})

        return run

    rows = written(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(pack, schema), "packed")
    done, open_ = [rows.where("ids is null")], rows.where("ids is not null")
    parts = (rows.where("ids is not null").agg(F.max("part")).first()[0] or 0) + 1
    level = 1
    while True:
        last = parts <= FAN_IN
        merged = open_.groupBy(F.floor(F.col("part") / FAN_IN).cast("bigint").alias("group")).applyInPandas(merge(level << 56, last), schema)
        if last:
            done.append(merged)
            break
        merged = written(merged, "packed")
        done.append(merged.where("ids is null"))
        open_, parts, level = merged.where("ids is not null"), -(-parts // FAN_IN), level + 1
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.drop("ids", "part")
