"""Quality classifier: an interpolated modified Kneser-Ney model of trusted text.

The model is a word trigram model fitted on all trusted documents (labelled quality 1 and not
toxic) of one half by a hash of their ids; the other half sets the thresholds. Trigrams are
counted where their middle word lies, so that their contexts, pairs and the pairs' contexts
are met there; only single words are counted across shards, and their counts sent to the
shards that hold them. An interpolated model's log-probability is a sum of weights:
`log p(c|ab) = log p(c) + log w(b) + log w(ab) + D(bc) + D(abc)`, where w is what a context
leaves to the lower order, D(bc) = log(1 + p2(bc) / (w(b) p(c))) and D(abc) = log(1 +
p3(abc) / (w(ab) p(c|b))). All but p(c) lies with the middle word b, and p(c) with the
trigram of which c is the middle. So a block of documents asks each shard once about its
trigrams there, and gets sums per document. Documents ask in `ROUNDS`, by a hash of their
texts, as a round's questions take more disk than anything else and go when it ends.
`fit_model` makes a model of the same kind in memory, of a bounded sample; the operator
doesn't use it.

A document's score is its mean negative log-probability per word, with `prior_words` words
at its language's mean added, so that short texts don't stand out by chance; its
perplexity is the exponential. The threshold of a language is the `quantile` of the scores
of all its trusted documents that the model wasn't fitted on. Of fewer than `least_held`
the quantile would be little more than their maximum: so far as they are fewer, the
threshold is that at which all languages' scores exceed their means, widened for the
mean's own scatter. A language without any takes the threshold over all languages.

Defined cases: null text is empty, and a text without words has its language's mean; null
languages form a language of their own; without trusted documents nothing is rejected, and
of few in all languages together the quantile is their maximum; repeated rows are judged each; columns that clash with those added are replaced.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, free_name, freed_shuffles, n_words, spread_join, written

SAMPLE_DOCS, SAMPLE_WORDS, PRIOR_WORDS, QUANTILE = 6_000, 3_000_000, 20.0, 0.99
ADDED = ("nll", "n_tokens", "score", "perplexity", "threshold", "keep")
#: A word is known by the upper 31 bits of its XXH64 with this seed.
SEED, UPPER = 42, 33
#: A text begins and ends with words that no text has.
BEGIN, END = xxhash.xxh64_intdigest(b" ", SEED) >> UPPER, xxhash.xxh64_intdigest(b"\n", SEED) >> UPPER
#: Words whose hashes a worker remembers, and characters of text that are scored at once.
HOT_WORDS, CHARS = 200_000, 1_000_000
#: Characters of text that ask the shards together; of all texts for each shard; rounds of asking.
BLOCK_CHARS, SHARD_CHARS, ROUNDS = 8_000_000, 16_000_000, 4
#: What a shard holds: trigrams with their counts; counts of words after its words; and of its words.
TRIGRAMS, FOLLOWERS, WORDS = 0, 1, 2


def _joint(first: Column, second: Column) -> Column:
    """One 64-bit key of a context's key and the word after it: the first rotated, and the second."""
    return F.shiftleft(first, 31).bitwiseOR(F.shiftrightunsigned(first, 33)).bitwiseXOR(second)


def _joint_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return (first << np.uint64(31) | first >> np.uint64(33)) ^ second


def discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """What counts of 1, 2 and 3 or more give away, from the counts of counts."""
    n1, n2, n3, n4 = (max(1, n) for n in (n1, n2, n3, n4))
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return [min(max(d, 0.05), 0.95 * k) for k, d in enumerate(raw, 1)]


def _order(counts: DataFrame) -> DataFrame:
    """`counts` (context, key, n) to key and p, what each n-gram has after discounting, and
    w, what its context leaves to the lower order; w is null but in one row of a context."""
    of = counts.agg(*[F.count(F.when(F.col("n") == k, 1)) for k in (1, 2, 3, 4)]).first()
    d = discounts(*of)
    off = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
    shard = Window.partitionBy("context")
    once = F.row_number().over(shard.orderBy("key")) == 1
    total = F.sum("n").over(shard)
    return counts.select("context", "key", ((F.col("n") - off) / total).cast("float").alias("p"), F.when(once, F.sum(off).over(shard) / total).cast("float").alias("w"))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = out = xxhash.xxh64_intdigest(word, SEED) >> UPPER
        return out


def _tokens(texts: list[str | None], known: _Hashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of all words, with two at the beginning and one at the end of each text; places
    of those that are predicted; numbers of words)."""
    if len(known) > HOT_WORDS:
        known.clear()
    ids, sizes, get = [], [], known.__getitem__
    for text in texts:
        words = (text or "").encode().split()
        sizes.append(len(words))
        ids += [BEGIN, BEGIN, *map(get, words), END]
    flat, sizes = np.array(ids, np.uint64), np.array(sizes, np.int64)
    first = np.concatenate([[0], np.cumsum(sizes + 3)[:-1]]).astype(np.int64)
    real = np.ones(len(flat), bool)
    real[first], real[first + 1] = False, False
    return flat, np.flatnonzero(real), sizes


@dataclass
class KneserNey:
    """For words, pairs and trigrams: sorted keys with their discounted probabilities; for
    contexts of one and two words: sorted keys with the weights they leave to the lower order."""

    tables: dict[str, tuple[np.ndarray, np.ndarray]]
    floor: float = 1.0
    known: _Hashes = field(default_factory=_Hashes, repr=False)

    def __getstate__(self) -> dict:
        """Small, as every executor gets a copy: gaps between keys, and values, compressed."""
        packed = io.BytesIO()
        np.savez_compressed(packed, **{f"{name}_{i}": x for name, (keys, values) in self.tables.items() for i, x in enumerate((np.diff(keys, prepend=keys.dtype.type(0)), values))})
        return {"packed": packed.getvalue(), "floor": self.floor}

    def __setstate__(self, state: dict) -> None:
        arrays = np.load(io.BytesIO(state["packed"]))
        names = sorted({x.split("_")[0] for x in arrays.files})
        self.tables = {n: (np.cumsum(arrays[f"{n}_0"], dtype=np.uint64), arrays[f"{n}_1"]) for n in names}
        self.floor, self.known = state["floor"], _Hashes()

    def find(self, name: str, wanted: np.ndarray, missing: float) -> np.ndarray:
        keys, values = self.tables[name]
        if not len(keys):
            return np.full(len(wanted), missing)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, values[at].astype(np.float64), missing)

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(negative log-probabilities, numbers of words) of the texts."""
        flat, at, sizes = _tokens(texts, self.known)
        a, b, c = flat[at - 2], flat[at - 1], flat[at]
        ab = _joint_keys(a, b)
        # An n-gram that was never seen is looked up in vain: its part is nought.
        p = self.find("p1", c, 0.0) + self.floor
        p = self.find("p2", _joint_keys(b, c), 0.0) + self.find("w1", b, 1.0) * p
        p = self.find("p3", _joint_keys(ab, c), 0.0) + self.find("w2", ab, 1.0) * p
        starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]).astype(np.int64)
        return np.add.reduceat(-np.log(p), starts) if len(p) else np.zeros(0), sizes


def trusted_ids(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document that is labelled good and not toxic in all its labels."""
    agreed = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))
    return agreed.where("q = 1 and t = 0").select("id")


def _half(trusted: DataFrame) -> DataFrame:
    """Those that the model is fitted on."""
    return trusted.where(F.pmod(F.xxhash64("id"), F.lit(2)) == 0)


def _trigrams(docs: DataFrame, text_col: str) -> DataFrame:
    """(a, b, c): the hashes of three words in a row, repeats included."""
    text = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    begin, end = F.lit(BEGIN).cast("long"), F.lit(END).cast("long")
    ids = F.concat(F.array(begin, begin), F.transform(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), lambda w: F.shiftrightunsigned(F.xxhash64(w), UPPER)), F.array(end))
    return text.select(ids.alias("ids")).select(F.explode(F.transform(F.sequence(F.lit(1), F.size("ids") - 2), lambda i: F.struct(F.element_at("ids", i).alias("a"), F.element_at("ids", i + 1).alias("b"), F.element_at("ids", i + 2).alias("c")))).alias("t")).select("t.*")


def fit_model(docs: DataFrame, trusted: DataFrame, sample_docs: int = SAMPLE_DOCS, id_col: str = "doc_id", text_col: str = "text", sample_words: int = SAMPLE_WORDS) -> tuple[KneserNey, DataFrame]:
    """(the model, the ids it was fitted on: at most `sample_docs`, of `sample_words`)."""
    first = _half(trusted).orderBy(F.xxhash64("id"), "id").limit(sample_docs)
    sized = docs.join(F.broadcast(first), docs[id_col] == first["id"]).groupBy("id").agg(F.sum(n_words(F.col(text_col))).alias("n"))
    so_far = F.sum("n").over(Window.orderBy(F.xxhash64("id"), "id"))  # of at most `sample_docs` rows
    chosen = written(sized.select("id", so_far.alias("so_far")).where(F.col("so_far") <= sample_words).select("id"), "kn-sample")
    rows = _trigrams(docs.join(F.broadcast(chosen), docs[id_col] == chosen["id"], "left_semi"), text_col)
    three = written(rows.groupBy("a", "b", "c").agg(F.count("*").alias("n")), "kn-trigrams")
    two = written(three.groupBy("b", "c").agg(F.count("*").alias("n")), "kn-pairs")
    one = written(two.groupBy("c").agg(F.count("*").alias("n")), "kn-words")
    ab = _joint(F.col("a"), F.col("b"))
    orders = (
        one.select(F.lit(0).cast("long").alias("context"), F.col("c").alias("key"), "n"),
        two.select(F.col("b").alias("context"), _joint(F.col("b"), F.col("c")).alias("key"), "n"),
        three.select(ab.alias("context"), _joint(ab, F.col("c")).alias("key"), "n"),
    )
    tables = {}
    for k, counts in enumerate(orders):
        fitted = _order(counts).toArrow()  # of the bounded sample
        keys, p, context, w = (fitted.column(c).to_numpy() for c in ("key", "p", "context", "w"))
        first = np.flatnonzero(~np.isnan(w))
        tables[f"p{k + 1}"], tables[f"w{k}"] = _sorted(keys, p), _sorted(context[first], w[first])
    left = tables.pop("w0")[1]
    floor = float(left[0]) / (len(tables["p1"][0]) + 1) if len(left) else 1.0
    return KneserNey(tables, floor), chosen


# --- the whole model, in shards


def _packed(*arrays: np.ndarray) -> bytes:
    """Numbers below 2^32: the equal places of each array together, compressed."""
    planes = [pa.compress(place.tobytes(), "zstd", asbytes=True) for x in arrays for place in x.astype("<u4").view(np.uint8).reshape(-1, 4).T]
    return np.array([len(p) for p in planes], "<u4").tobytes() + b"".join(planes)


def _unpacked(data: bytes, *sizes: int) -> list[np.ndarray]:
    at = np.cumsum([16 * len(sizes), *np.frombuffer(data, "<u4", 4 * len(sizes)).tolist()])
    out = [np.zeros((n, 4), np.uint8) for n in sizes]
    for k in range(4 * len(sizes)):
        if sizes[k // 4]:
            out[k // 4][:, k % 4] = np.frombuffer(pa.decompress(data[at[k] : at[k + 1]], sizes[k // 4], "zstd", asbytes=True), np.uint8)
    return [x.view("<u4").reshape(-1).astype(np.int64) for x in out]


def _runs(*sorted_columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin."""
    new = np.ones(len(sorted_columns[0]), bool)
    new[1:] = np.any([x[1:] != x[:-1] for x in sorted_columns], axis=0)
    return np.flatnonzero(new)


def _lengths(starts: np.ndarray, n: int) -> np.ndarray:
    return np.diff(np.append(starts, n))


def _pack_trigrams(words: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray, counts: np.ndarray) -> tuple[int, int, bytes]:
    """(number of words, number of trigrams, both) of trigrams sorted by b, a and c, which are
    places in the sorted `words`; of these, only the used ones are packed."""
    used = np.zeros(len(words), bool)
    used[a] = used[b] = used[c] = True
    place = np.cumsum(used) - 1
    a, b, c = place[a], place[b], place[c]
    on = np.diff(b, prepend=0)
    return int(used.sum()), len(b), _packed(np.diff(words[used].astype(np.int64), prepend=0), np.where(on == 0, np.diff(a, prepend=0), a), on, c, counts)


def _unpack_trigrams(n_words: int, n: int, data: bytes) -> tuple[np.ndarray, ...]:
    """(words, a, b, c, counts)."""
    words, a, b, c, counts = _unpacked(data, n_words, *[n] * 4)
    starts = np.flatnonzero(np.append(True, b[1:] != 0))
    so_far = np.cumsum(a)
    return np.cumsum(words), so_far - np.repeat((so_far - a)[starts], _lengths(starts, n)), np.cumsum(b), c, counts


def _trigrams_of(texts: list[str], known: _Hashes) -> tuple[np.ndarray, ...]:
    """(the sorted words; a, b, c and counts of different trigrams, sorted by b, a and c; the
    text of each that occurs, in this order; the texts' numbers of words)."""
    flat, at, sizes = _tokens(texts, known)
    words, ids = np.unique(flat, return_inverse=True)
    a, b, c = ids[at - 2], ids[at - 1], ids[at]
    order = np.lexsort((c, a, b)) if len(words) > 1 << 21 else np.argsort(b << 42 | a << 21 | c, kind="stable")
    a, b, c = a[order], b[order], c[order]
    new = _runs(a, b, c)
    return words, a[new], b[new], c[new], _lengths(new, len(order)), np.repeat(np.arange(len(texts)), sizes + 1)[order], sizes


def _bounds(words: np.ndarray, shards: int) -> np.ndarray:
    """Where in sorted words those of each shard begin, and the end."""
    return np.searchsorted(words.astype(np.int64) * shards >> 64 - UPPER, np.arange(shards + 1))


def _few(n: np.ndarray) -> list[int]:
    """Of how many the count is 1, 2, 3 and 4."""
    return np.bincount(np.minimum(n, 5), minlength=6)[1:5].tolist()


def _off(n: np.ndarray, d: list[float]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(n, 3)]


@dataclass
class Rates:
    """What all shards share: discounts of words, pairs and trigrams, number of different pairs,
    the probability of a word that was never seen and of a text's end; the number of shards."""

    shards: int
    discounts: list[list[float]] = field(default_factory=list)
    pairs: int = 1
    floor: float = 1.0
    end: float = 1.0

    def p1(self, n: np.ndarray) -> np.ndarray:
        return (n - _off(n, self.discounts[0])) / self.pairs + self.floor


HELD = "shard int, kind int, n_words long, n long, data binary, counts array<long>"


def _table(rows: list[tuple], ddl: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (f.split(" ") for f in ddl.split(", "))])
    columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
    return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)


def _rows(table: pa.Table, *names: str) -> Iterator[tuple]:
    return zip(*(table.column(c).to_pylist() for c in names), strict=True)


def _shards(docs: DataFrame, text_col: str) -> int:
    return 16 + docs.agg(F.coalesce(F.sum(F.length(text_col)), F.lit(0))).first()[0] // SHARD_CHARS


def fit_weights(docs: DataFrame, text_col: str = "text", shards: int | None = None) -> tuple[DataFrame, Rates]:
    """(what the shards hold, what they share), fitted on all of `docs`."""
    texts = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    shards = shards or _shards(texts, "text")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for part in _blocks(batches):
            words, a, b, c, counts, _, _ = _trigrams_of(part, known)
            to = np.searchsorted(b, _bounds(words, shards))
            yield from _table([(shard, TRIGRAMS, *_pack_trigrams(words, a[i:j], b[i:j], c[i:j], counts[i:j]), None) for shard, (i, j) in enumerate(zip(to[:-1], to[1:], strict=True)) if i < j], HELD).to_batches()

    def count(parts: pa.Table) -> pa.Table:
        shard, rows = parts.column("shard")[0].as_py(), [_unpack_trigrams(*r) for r in _rows(parts, "n_words", "n", "data")]
        words = np.unique(np.concatenate([r[0] for r in rows]))
        at = [np.searchsorted(words, r[0]) for r in rows]
        a, b, c = (np.concatenate([place[r[k]] for place, r in zip(at, rows, strict=True)]) for k in (1, 2, 3))
        order = np.lexsort((c, a, b))
        a, b, c, n = a[order], b[order], c[order], np.concatenate([r[4] for r in rows])[order]
        new = _runs(a, b, c)
        a, b, c, n = a[new], b[new], c[new], np.add.reduceat(n, new)
        order = np.lexsort((c, b))
        pairs = _runs(b[order], c[order])
        after = np.bincount(c[order][pairs], minlength=len(words))
        out = [(shard, TRIGRAMS, *_pack_trigrams(words, a, b, c, n), [*_few(n), *_few(_lengths(pairs, len(order)))])]
        to = _bounds(words, shards)
        for home, (i, j) in enumerate(zip(to[:-1], to[1:], strict=True)):
            there = np.flatnonzero(after[i:j]) + i
            if len(there):
                out.append((home, FOLLOWERS, shard, len(there), _packed(np.diff(words[there], prepend=0), after[there]), None))
        return _table(out, HELD)

    def add_up(parts: pa.Table) -> pa.Table:
        home, rows = parts.column("shard")[0].as_py(), list(_rows(parts, "n_words", "n", "data"))
        found = [(lambda x: (np.cumsum(x[0]), x[1]))(_unpacked(data, n, n)) for _, n, data in rows]
        words, at = np.unique(np.concatenate([w for w, _ in found]), return_inverse=True)
        n1 = np.bincount(at, np.concatenate([n for _, n in found])).astype(np.int64)
        at = np.split(at, np.cumsum([len(w) for w, _ in found])[:-1])
        out = [(shard, FOLLOWERS, 0, n, _packed(np.diff(words[place], prepend=0), n1[place]), None) for (shard, n, _), place in zip(rows, at, strict=True)]
        return _table([*out, (home, WORDS, 0, len(words), _packed(np.diff(words, prepend=0), n1), [*_few(n1), int(n1.sum()), len(n1), int(n1[words == END].sum())])], HELD)

    by_shard = lambda df: df.repartition(shards, "shard").groupBy("shard")
    counted = written(by_shard(texts.mapInArrow(deal, HELD)).applyInArrow(count, HELD), "kn-trigrams")
    words = written(by_shard(counted.where(F.col("kind") == FOLLOWERS)).applyInArrow(add_up, HELD), "kn-words")
    trigrams = counted.where(F.col("kind") == TRIGRAMS)
    summed = lambda df, n: df.agg(*[F.sum(F.col("counts")[k]) for k in range(n)]).first()
    *few, total, known, ends = summed(words.where(F.col("kind") == WORDS), 7)
    rates = Rates(shards)
    if known:
        three = summed(trigrams, 8)
        d1 = discounts(*few)
        floor = (few[0] * d1[0] + few[1] * d1[1] + (known - few[0] - few[1]) * d1[2]) / total / (known + 1)
        rates = Rates(shards, [d1, discounts(*three[4:]), discounts(*three[:4])], total, floor)
        rates.end = float(rates.p1(np.array([ends]))[0])
    return trigrams.unionByName(words).select("shard", "kind", "n_words", "n", "data"), rates


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of `wanted` in the sorted keys; -1 where there is none."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


def _code(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """One number of two places; -1 where one of them is."""
    return np.where((high < 0) | (low < 0), -1, high << 32 | low)


def _at(values: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Nought where the place is -1."""
    return np.append(values, 0.0)[places]


class _Shard:
    """The weights of what a shard holds."""

    def __init__(self, rows: list[tuple], rates: Rates) -> None:
        counts = {kind: [(lambda x: (np.cumsum(x[0]), x[1]))(_unpacked(data, n, n)) for k, _, n, data in rows if k == kind] for kind in (FOLLOWERS, WORDS)}
        none = np.zeros(0, np.int64)
        self.own, n1 = counts[WORDS][0] if counts[WORDS] else (none, none)
        self.known = np.log(rates.p1(n1) / rates.floor) if len(n1) else np.zeros(0)
        held = [r for r in rows if r[0] == TRIGRAMS]
        if not held:
            self.words = self.ab = self.bc = self.abc = none
            self.left1 = self.left2 = self.d2 = self.d3 = np.zeros(0)
            return
        self.words, a, b, c, n = _unpack_trigrams(*held[0][1:])
        _, d2, d3 = rates.discounts
        p1 = np.ones(len(self.words))
        for words, n1 in counts[FOLLOWERS]:
            p1[np.searchsorted(self.words, words)] = rates.p1(n1)
        contexts = _runs(b, a)
        of_ab = np.repeat(np.arange(len(contexts)), _lengths(contexts, len(n)))
        total = np.add.reduceat(n, contexts)
        w2 = np.add.reduceat(_off(n, d3), contexts) / total
        order = np.lexsort((c, b))
        starts = _runs(b[order], c[order])
        m = _lengths(starts, len(n))
        of_bc = np.empty(len(n), np.int64)
        of_bc[order] = np.repeat(np.arange(len(m)), m)
        first, second = b[order][starts], c[order][starts]
        total1 = np.maximum(np.bincount(first, m, len(self.words)), 1)
        w1 = np.bincount(first, _off(m, d2), len(self.words)) / total1
        p2, low = (m - _off(m, d2)) / total1[first], w1[first] * p1[second]
        self.left1, self.left2 = np.log(np.where(w1 > 0, w1, 1.0)), np.log(w2)
        self.ab, self.bc, self.abc = b[contexts] << 32 | a[contexts], first << 32 | second, of_ab << 32 | c
        self.d2 = np.log1p(p2 / low)
        self.d3 = np.log1p((n - _off(n, d3)) / total[of_ab] / w2[of_ab] / (p2 + low)[of_bc])

    def weights(self, words: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Of trigrams whose words are places in `words`; of single words, that of b."""
        here = _find(self.words, words)
        ab = _find(self.ab, _code(here[b], here[a]))
        single = _at(self.known, _find(self.own, words)) + _at(self.left1, here)
        return single[b] + _at(self.left2, ab) + _at(self.d2, _find(self.bc, _code(here[b], here[c]))) + _at(self.d3, _find(self.abc, _code(ab, here[c])))


ASKED = "shard int, block long, n_words long, n long, data binary, docs binary, sums binary"


def score_texts(docs: DataFrame, held: DataFrame, rates: Rates, text_col: str = "text") -> DataFrame:
    """(hash, nll, n_tokens) of the different texts, by a join of their trigrams with the shards.
    Texts ask in blocks; a block's row of n = 0 holds its texts' hashes, sizes and sums so far."""
    texts = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    shards = rates.shards

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, place = _Hashes(), TaskContext.get().partitionId()
        for block_no, part in enumerate(_blocks(batches)):
            part = list(dict.fromkeys(part))
            words, a, b, c, counts, of, sizes = _trigrams_of(part, known)
            hashes = np.array([xxhash.xxh64_intdigest(t, SEED) for t in part], np.uint64)
            block = xxhash.xxh64_intdigest(hashes.tobytes() + f"{place},{block_no}".encode(), SEED) >> 1
            sums = np.log(rates.floor) * (sizes + 1) + np.log(rates.end / rates.floor)
            rows = [(int(block % shards), block, 0, 0, hashes.tobytes(), sizes.tobytes(), sums.tobytes())]
            to, ends = np.searchsorted(b, _bounds(words, shards)), np.append(0, np.cumsum(counts))
            for shard, (i, j) in enumerate(zip(to[:-1], to[1:], strict=True)):
                if i < j:
                    rows.append((shard, block, *_pack_trigrams(words, a[i:j], b[i:j], c[i:j], counts[i:j]), _packed(of[ends[i] : ends[j]]), None))
            yield from _table(rows, ASKED).to_batches()

    def answer(asked: pa.Table, model: pa.Table) -> pa.Table:
        shard, rows = _Shard(list(_rows(model, "kind", "n_words", "n", "data")), rates), []
        for block, n_words, n, data, of, sums in _rows(asked, "block", "n_words", "n", "data", "docs", "sums"):
            if n:
                words, a, b, c, counts = _unpack_trigrams(n_words, n, data)
                (of,) = _unpacked(of, int(counts.sum()))
                found = np.bincount(of, np.repeat(shard.weights(words, a, b, c), counts))
                which = np.flatnonzero(found)
                if not len(which):
                    continue
                n, data, of, sums = len(which), None, _packed(np.diff(which, prepend=0)), found[which].astype(np.float32).tobytes()
            rows.append((0, block, 0, n, data, of, sums))
        return _table(rows, ASKED)

    def total(answers: pa.Table) -> pa.Table:
        rows = list(_rows(answers, "n", "data", "docs", "sums"))
        _, hashes, sizes, sums = next(r for r in rows if not r[0])
        sums = np.frombuffer(sums).copy()
        for n, _, of, part in rows:
            if n:
                sums[np.cumsum(_unpacked(of, n)[0])] += np.frombuffer(part, np.float32)
        return pa.table({"hash": np.frombuffer(hashes, np.int64), "nll": -sums, "n_tokens": np.frombuffer(sizes, np.int64)})

    by_shard = lambda df: df.repartition(shards, "shard").groupBy("shard")
    rounds = []
    for k in range(ROUNDS):
        asked = texts.where(F.pmod(F.xxhash64("text"), F.lit(ROUNDS)) == k).mapInArrow(ask, ASKED)
        answers = by_shard(asked).cogroup(by_shard(held)).applyInArrow(answer, ASKED)
        rounds.append(written(answers.groupBy("block").applyInArrow(total, "hash long, nll double, n_tokens long"), "kn-sums"))
    return reduce(DataFrame.unionByName, rounds).groupBy("hash").agg(F.min("nll").alias("nll"), F.min("n_tokens").alias("n_tokens"))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[str]]:
    part, size = [], 0
    for batch in batches:
        for text in batch.column(0).to_pylist():
            if part and size + len(text) > BLOCK_CHARS:
                yield part
                part, size = [], 0
            part.append(text)
            size += len(text) + 16
    if part:
        yield part


def _sorted(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = keys.view(np.uint64)
    order = np.argsort(keys)
    return keys[order], values[order].astype(np.float32)


def score_documents(docs: DataFrame, model: KneserNey, text_col: str = "text") -> DataFrame:
    """`docs` with nll and n_tokens."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ADDED])
    schema = T.StructType([*docs.schema.fields, T.StructField("nll", T.DoubleType()), T.StructField("n_tokens", T.LongType())])
    place, shared = docs.columns.index(text_col), docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.utf8_length(batch.column(place).cast(pa.string())), 0).to_numpy(zero_copy_only=False) + 16)
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHARS, "right")))
                part = batch.slice(at, to - at)
                at = to
                nll, n = shared.value.score(part.column(place).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(nll), pa.array(n)], names=schema.names)

    return docs.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, prior_words: float = PRIOR_WORDS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", columns: list[str] | None = None, least_held: float | None = None) -> DataFrame:
    """`docs` (or their `columns`) with n_tokens, score, perplexity, threshold and keep."""
    least_held = 1 / max(1 - quantile, 1e-6) if least_held is None else least_held
    trusted = written(trusted_ids(labels, id_col), "kn-trusted")
    half = _half(trusted)
    fitted = docs.join(half, docs[id_col] == half["id"], "left_semi")
    with freed_shuffles(docs.sparkSession):
        nll = written(score_texts(docs, *fit_weights(fitted, text_col, _shards(docs, text_col)), text_col), "kn-nll")
    kept = [c for c in (columns or docs.columns) if c.lower() not in ADDED]
    mark = free_name(docs, "text_hash")
    by_text = docs.select(*kept, F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias(mark))
    with freed_shuffles(docs.sparkSession):
        scored = written(spread_join(by_text, nll.withColumnRenamed("hash", mark), mark).select(*kept, "nll", "n_tokens"), "kn-scored")
    held = trusted.where(F.pmod(F.xxhash64("id"), F.lit(2)) != 0)
    held = scored.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), "nll", "n_tokens").join(held, "id", "left_semi")
    rate = F.try_divide(F.sum("nll"), F.sum(F.col("n_tokens") + 1))
    means = held.groupBy("lang").agg(rate.alias("mean"))
    whole = held.agg(rate.alias("whole"))  # one row
    smooth = lambda mean: (F.col("nll") + prior_words * mean) / (F.col("n_tokens") + 1 + prior_words)
    held = held.alias("h").join(means.alias("m"), F.col("h.lang").eqNullSafe(F.col("m.lang"))).select(F.col("h.lang").alias("lang"), F.col("m.mean").alias("mean"), smooth(F.col("m.mean")).alias("score"))
    by_lang = held.groupBy("lang").agg(F.first("mean").alias("mean"), F.percentile_approx("score", F.lit(quantile), F.lit(20_000)).alias("threshold"), F.count("*").alias("held"))
    everywhere = held.agg(F.percentile_approx("score", F.lit(quantile), F.lit(20_000)).alias("any"), F.percentile_approx(F.col("score") - F.col("mean"), F.lit(quantile), F.lit(20_000)).alias("above"))
    weight = F.least(F.lit(1.0), F.col("held") / F.lit(float(least_held)))
    shared = F.col("mean") + F.col("above") * F.sqrt(1 + 1 / F.col("held"))
    own = F.when(weight < 1, weight * F.col("threshold") + (1 - weight) * F.greatest(shared, "threshold")).otherwise(F.col("threshold"))
    limits = written(by_lang.crossJoin(F.broadcast(everywhere)).select(F.col("lang").alias("l"), "mean", own.alias("own")), "kn-limits")
    other = written(whole.crossJoin(F.broadcast(everywhere.select("any"))), "kn-whole")  # one row
    judged = scored.join(limits, scored[lang_col].eqNullSafe(limits["l"]), "left").crossJoin(F.broadcast(other))
    judged = judged.withColumn("score", smooth(F.coalesce("mean", "whole"))).withColumn("threshold", F.coalesce("own", "any"))
    judged = judged.withColumn("perplexity", F.exp("score")).withColumn("threshold", F.exp("threshold")).withColumn("keep", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)))
    return judged.select(*kept, "n_tokens", "score", "perplexity", "threshold", "keep")


__all__ = ["KneserNey", "classify", "fit_model", "fit_weights", "score_documents", "score_texts", "trusted_ids"]
