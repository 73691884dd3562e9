"""Document fingerprints from Lempel-Ziv phrases.

A text is split at white space, and words of more than LONG_WORD characters are cut where a
hash of the characters before says so, so that cuts move with the content and not with its
place. The words are parsed as LZ78 does: each phrase is the longest one seen before and one word more. The
set of phrases is hashed to 64 bits, and the fingerprint keeps the smallest hash of each of
128 bins as four hex digits. Likeness is the share of bins, of those that either text
fills, in which both have the same value: an estimate of the phrase sets' overlap, near 1
where one text compresses well given the other.

`next_documents` brings documents next to their successor in descending order of ids. Ids
are cut into buckets at sampled bounds; each bucket gets the first document of the bucket
after it as a guest, so that one shuffle of the texts and no global sort is needed. Tasks
stream through their buckets. Ids may be of any type that has an order.

Defined cases: null text is empty; rows of null ids come last, in the order of a hash of
their texts, in buckets of that hash; rows of one id follow each other by that hash, in one
bucket; texts that differ in white space only are alike; a single document is its own successor; an empty table gives no rows; two texts
without any phrase are alike (1).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BIN_BITS = 7
LONG_WORD, PIECE = 64, 8
ROWS_PER_BUCKET, MOST_BUCKETS, SAMPLES = 2048, 65_536, 20


def _pieces(word: str) -> list[str]:
    """A long word cut after characters at which a hash of the last four is 0 modulo PIECE,
    and what has no such place for LONG_WORD characters every PIECE."""
    c = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    mixed = c[3:] * np.uint64(0x9E3779B97F4A7C15) ^ c[2:-1] * np.uint64(0xC2B2AE3D27D4EB4F) ^ c[1:-2] * np.uint64(0x165667B19E3779F9) ^ c[:-3] * np.uint64(0x27D4EB2F165667C5)
    cuts = [0, *(np.flatnonzero((mixed >> np.uint64(40)) % np.uint64(PIECE) == 0) + 4).tolist(), len(word)]
    out = []
    for a, b in zip(cuts, cuts[1:], strict=False):
        out += [word[a:b]] if b - a <= LONG_WORD else [word[i : min(i + PIECE, b)] for i in range(a, b, PIECE)]
    return [w for w in out if w]


def split_words(text: str) -> list[str]:
    words = text.split()
    if not words or max(map(len, words)) <= LONG_WORD:
        return words
    return [p for w in words for p in (_pieces(w) if len(w) > LONG_WORD else (w,))]


def _parse(words: list[str], root: dict, node: dict, head: list[str], made: list[tuple[dict, str]] | None) -> tuple[list[str], dict, list[str]]:
    """New phrases of `words`, read on from `node` with the unfinished phrase `head`."""
    phrases, head = [], list(head)
    for word in words:
        head.append(word)
        child = node.get(word)
        if child is None:
            node[word] = {}
            if made is not None:
                made.append((node, word))
            phrases.append(" ".join(head))
            node, head = root, []
        else:
            node = child
    return phrases, node, head


def lz_phrases(text: str) -> list[str]:
    """The distinct phrases of the text's LZ78 parse, in order."""
    root: dict = {}
    return _parse(split_words(text), root, root, [], None)[0] if text else []


def signature(phrases: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bins that have a phrase, 16 bits of the smallest hash of each), bins ascending."""
    digest = xxhash.xxh64_intdigest
    hashes = np.sort(np.fromiter((digest(p) for p in phrases), np.uint64, len(phrases)))
    bins, first = np.unique(hashes >> np.uint64(64 - BIN_BITS), return_index=True)
    return bins.astype(np.int64), (hashes[first] & np.uint64(0xFFFF)).astype(np.int64)


def signature_text(sig: tuple[np.ndarray, np.ndarray]) -> str:
    """Four characters a bin; `----` where no phrase fell."""
    out = ["----"] * (1 << BIN_BITS)
    for at, value in zip(*(x.tolist() for x in sig), strict=True):
        out[at] = f"{value:04x}"
    return "".join(out)


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    both, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    filled = len(a[0]) + len(b[0]) - len(both)
    return float((a[1][i] == b[1][j]).sum()) / filled if filled else 1.0


def text_likeness(a: str, b: str) -> float:
    """Likeness of two fingerprints as text."""
    pairs = [(a[i : i + 4], b[i : i + 4]) for i in range(0, len(a), 4)]
    filled = [x == y for x, y in pairs if (x, y) != ("----", "----")]
    return sum(filled) / len(filled) if filled else 1.0


class Fingerprinted:
    """A text's fingerprint, and on demand that of the text with its last half replaced.

    The parse of the half that stays is done once: what the rest adds to the dictionary is
    taken back before the other rest is read.
    """

    def __init__(self, text: str) -> None:
        self.text, half = text, len(text) // 2
        self.kept = text[: len(text) - half]
        tail = self.kept.rsplit(None, 1)[-1:] if self.kept and not self.kept[-1].isspace() else []
        self.at = len(self.kept) - len(tail[0] if tail else "")
        self.root: dict = {}
        self.stem, self.node, self.head = _parse(split_words(text[: self.at]), self.root, self.root, [], None) if self.at else ([], self.root, [])
        self.sig = signature(self._rest(text))
        self.hex = signature_text(self.sig)

    def _rest(self, text: str) -> list[str]:
        made: list[tuple[dict, str]] = []
        phrases = self.stem + (_parse(split_words(text[self.at :]), self.root, self.node, self.head, made)[0] if text else [])
        for node, word in reversed(made):
            del node[word]
        return phrases

    def edited(self, other: str) -> tuple[str, tuple[np.ndarray, np.ndarray]]:
        text = self.kept + other[: len(self.text) // 2]
        return text, signature(self._rest(text))


def _bucket(key: Column, bounds: list, kind: str, step: int = 256) -> Column:
    """How many of the ascending bounds are below the key, in two short searches."""
    rows = [bounds[i : i + step] for i in range(0, len(bounds), step)] or [[]]
    table = F.array(*[F.array(*[F.lit(b) for b in r]).cast(f"array<{kind}>") for r in rows])
    coarse = F.size(F.filter(F.array(*[F.lit(r[0]) for r in rows[1:]]).cast(f"array<{kind}>"), lambda b: b < key))
    return coarse * step + F.size(F.filter(F.element_at(table, coarse + 1), lambda b: b < key))


def next_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (bucket, guest, id, text), in partitions that hold whole buckets, sorted so that
    every row which is no guest is followed by its successor.

    Buckets of ids ascend from 0; those of null ids descend from -1, in the hash's order."""
    kind = docs.schema[id_col].dataType.simpleString()
    docs = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    docs = docs.withColumn("h", F.xxhash64("text"))
    count, named = docs.agg(F.count("*"), F.count("id")).first()
    n, nameless = (max(1, min(MOST_BUCKETS, k // ROWS_PER_BUCKET)) for k in (named, count - named))
    bounds: list = []
    if n > 1:  # a bounded sample of ids, SAMPLES for each bucket on average
        ids = sorted(r[0] for r in docs.select("id").where("id is not null").sample(min(1.0, SAMPLES * n / named), seed=7).collect())
        bounds = sorted({ids[i] for i in np.linspace(0, len(ids) - 1, n + 1).astype(int)[1:-1]}) if ids else []
    last = F.least(F.floor((F.col("h") / 2.0**64 + 0.5) * nameless), F.lit(nameless - 1))
    dealt = docs.withColumn("bucket", F.when(F.col("id").isNull(), -1 - last).otherwise(_bucket(F.col("id"), bounds, kind)).cast("int"))
    heads = sorted(tuple(r) for r in dealt.groupBy("bucket").agg(F.max("id").alias("top"), F.min("h").alias("low")).collect())  # a row per bucket
    # Each bucket's guest is the first of the bucket below it; the lowest one's is the first of all.
    hosts = [(heads[i][0], *heads[i - 1]) for i in range(len(heads))]
    asked = F.broadcast(docs.sparkSession.createDataFrame(hosts, f"host int, bucket int, top {kind}, low bigint"))  # at most 2 * MOST_BUCKETS rows
    first = F.when(F.col("bucket") < 0, F.col("h") == F.col("low")).otherwise(F.col("id") == F.col("top"))
    guests = dealt.join(asked, "bucket").where(first).groupBy("host").agg(F.min(F.struct("h", "text")).alias("g"))
    guests = guests.select(F.lit(None).cast(kind).alias("id"), "g.text", "g.h", F.col("host").alias("bucket"), F.lit(1).alias("guest"))
    rows = dealt.withColumn("guest", F.lit(0)).unionByName(guests)
    return rows.repartition(max(1, len(heads)), "bucket").sortWithinPartitions("bucket", "guest", F.col("id").desc(), "h", "text").select("bucket", "guest", "id", "text")


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited and near_next."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, last_id, names = None, None, ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        for batch in batches:
            out: list[tuple] = []
            for guest, key, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                now = Fingerprinted(text)
                if last is not None:
                    edited, sig = last.edited(text)
                    out.append((last_id, len(last.text), hashlib.sha256(edited.encode()).hexdigest(), last.hex, signature_text(sig), likeness(last.sig, sig), likeness(last.sig, now.sig)))
                last, last_id = (None, None) if guest else (now, key)
            kinds = [batch.schema.field(2).type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            columns = list(zip(*out, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    schema = f"id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return next_documents(docs, id_col, text_col).mapInArrow(run, schema)
