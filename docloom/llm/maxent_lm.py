"""LM scoring by a hashed maximum-entropy model with a class-factored softmax.

The probability of a token is that of its class given the tokens before it, times that of
the word within its class given the same tokens. Classes are the bit lengths of training
counts (0: unknown, 1: once, 2: two or three times ...). A class of many words is factored
again, by digits of the words' hashes: each digit is a softmax over at most WAYS branches,
with as many digits as give the class's words leaves of their own, DEPTH at most; words that
still share a leaf have it in proportion to their counts. So every softmax is small, and the
probabilities of all known words and of "unknown" sum to 1.

The softmaxes have hashed indicator features: the previous token, the one before it (a skip,
for classes only) and both (an n-gram), joined with the class and the digits so far. They
share one table of weights, whose number of buckets grows with the training tokens up to a bound, and
start from the counts alone. Training is one pass in rounds: in a round every task updates a
copy of the weights by gradient steps over its blocks, and the changes of all tasks are
averaged by how often each bucket was seen. In training a token's own occurrence is left out
of its count, so the model learns how often unseen and rare tokens turn up in new text.

Texts are gathered in blocks of bounded size, each a row group of its own, so that a task holds
few at a time, however large its split is. A block sends the distinct words it has, with
their training counts, to shards by hash, and gets their totals over all blocks back: a word
is one number of a block however frequent it is, and no shard depends on one word. Words are
known by 64-bit hashes. All documents are counted, trained on and scored.

Defined cases: null text is empty and has the end token only; a null id is taken as the
empty text when documents are dealt to training and held-out; repeated rows count and are
scored each; without training tokens all tokens are unknown; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, written

#: Characters of text in a block; words that a shard takes; tokens of a gradient step.
BLOCK_CHARS, SHARD_WORDS, MOST_SHARDS, STEP_TOKENS = 8_000_000, 400_000, 4_096, 4_096
#: Branches of a softmax (a class, or a digit of a hash), digits at most, bits of a digit.
WAYS, DEPTH, DIGIT = 32, 2, 5
#: Bytes of totals that one task gathers by block; rows of totals in a row group.
GATHER_BYTES, GATHER_ROWS = 16_000_000, 4
#: Buckets of weights: a power of two, one for so many training tokens, between these.
TOKENS_PER_BUCKET, LEAST_BUCKETS, MOST_BUCKETS = 1_024, 1 << 14, 1 << 17
#: Rounds of training, characters of text that one task trains on in a round, step size.
ROUNDS, TASK_CHARS, RATE = 3, 48_000_000, 0.5
#: The end of a text (no word is a space), and what stands for the tokens before a text.
END, BEFORE = b" ", np.uint64(xxhash.xxh64_intdigest(b"\n"))
FIRST, SECOND, THIRD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def is_held_out(key) -> bool:
    return zlib.crc32(("" if key is None else str(key)).encode()) % 7 == 2


def token_class(counts: np.ndarray) -> np.ndarray:
    """The bit length of each count."""
    return np.minimum(np.frexp(np.maximum(counts, 0).astype(np.float64))[1], WAYS - 1)


def leaf_code(hashes: np.ndarray) -> np.ndarray:
    """DEPTH digits of each word's hash, the first the highest."""
    return (hashes >> np.uint64(20)).astype(np.int64) & ((1 << DEPTH * DIGIT) - 1)


def contexts(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Three hashes for each token: of the previous, of the one before, of both."""
    n = len(hashes)
    one, two = np.full(n, BEFORE, np.uint64), np.full(n, BEFORE, np.uint64)
    one[1:], two[2:] = hashes[:-1], hashes[:-2]
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    one[first], two[first] = BEFORE, BEFORE
    second = first[sizes > 1] + 1
    two[second] = BEFORE
    return np.stack([one * FIRST, two * SECOND, (one * THIRD) ^ (two * FIRST)])


class Tree:
    """What the counts alone say: of each class, and of its leaves by their first digits."""

    def __init__(self, leaves: np.ndarray, words: np.ndarray, tokens: np.ndarray, less: np.ndarray) -> None:
        """`leaves` (class and code) with their words and tokens; `less`: tokens by the class
        that each has if it is left out of its count."""
        leaf = np.zeros((WAYS, WAYS**DEPTH))
        leaf.ravel()[leaves] = tokens
        in_class = np.bincount(leaves >> DEPTH * DIGIT, words, WAYS)
        # As many digits as make leaves twice as many as words.
        self.depth = np.minimum(np.ceil(np.log2(np.maximum(in_class, 1) * 2) / DIGIT), DEPTH).astype(np.int64)
        self.depth[in_class <= 1] = 0
        #: Tokens below each node of d digits.
        self.mass = [leaf.reshape(WAYS, WAYS**d, -1).sum(2) for d in range(DEPTH + 1)]
        self.words = int(words.sum())
        #: Branches of the first softmax that stand for something.
        self.real = self.mass[0][:, 0] > 0
        self.real[0] = True
        start = np.where(self.real, np.maximum(less, 0.5), 0)
        with np.errstate(divide="ignore"):
            self.bias = [np.maximum(np.log(start / start.sum()), -60)[None, :].astype(np.float32)]
        for d in range(DEPTH):
            with np.errstate(divide="ignore", invalid="ignore"):
                share = self.mass[d + 1].reshape(-1, WAYS) / self.mass[d].reshape(-1, 1)
                self.bias.append(np.where(share > 0, np.log(share), -60.0).astype(np.float32))

    def share(self, counts: np.ndarray, classes: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """A word's part of its leaf."""
        out, depth = np.ones(len(counts)), self.depth[classes]
        for d in range(DEPTH + 1):
            at = np.flatnonzero((depth == d) & (classes > 0))
            mass = self.mass[d][classes[at], codes[at] >> (DEPTH - d) * DIGIT]
            out[at] = np.divide(counts[at], mass, out=np.ones(len(at)), where=mass > 0)
        return out

    def levels(self, classes: np.ndarray, codes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(level, the tokens it decides, their nodes, the branches they take)."""
        yield 0, np.arange(len(classes)), np.zeros(len(classes), np.int64), classes
        depth = np.where(classes > 0, self.depth[classes], 0)
        for d in range(DEPTH):
            at = np.flatnonzero(depth > d)
            if len(at):
                node = classes[at] * WAYS**d + (codes[at] >> (DEPTH - d) * DIGIT)
                yield d + 1, at, node, codes[at] >> (DEPTH - 1 - d) * DIGIT & WAYS - 1


class Model:
    """A tree and its weights by bucket."""

    def __init__(self, tree: Tree, weights: np.ndarray) -> None:
        self.tree, self.weights = tree, weights
        #: Each level has a part of the table to itself.
        self.part = len(weights) // (DEPTH + 1)
        self.shift = np.uint64(64 - self.part.bit_length() + 1)

    def buckets(self, context: np.ndarray, level: int, nodes: np.ndarray) -> np.ndarray:
        if level:
            context = context[::2]
        mixed = (context ^ ((nodes.astype(np.uint64) + np.uint64(level << 40)) * SECOND)) * FIRST
        return (mixed >> self.shift).astype(np.int64) + level * self.part

    def _softmax(self, buckets: np.ndarray, level: int, nodes: np.ndarray) -> np.ndarray:
        z = self.tree.bias[level].take(nodes, axis=0)
        for one in buckets:
            z += self.weights.take(one, axis=0)
        np.minimum(z, 60, out=z)  # biases are at most 0, so only runaway weights reach that
        np.exp(z, out=z)
        z /= z.sum(1, keepdims=True)
        return z

    def log_probabilities(self, context: np.ndarray, classes: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Of the leaf of each token."""
        out = np.zeros(len(classes))
        for level, at, nodes, branch in self.tree.levels(classes, codes):
            p = self._softmax(self.buckets(context[:, at], level, nodes), level, nodes)
            out[at] += np.log(p[np.arange(len(at)), branch])
        return out

    def step(self, context: np.ndarray, classes: np.ndarray, codes: np.ndarray, seen: np.ndarray, rate: float = RATE) -> None:
        """One gradient update; a bucket's rate falls with how often it was seen."""
        for level, at, nodes, branch in self.tree.levels(classes, codes):
            # Where leaving a token out leads to an empty branch there is nothing to learn.
            real = self.tree.mass[level].reshape(-1, WAYS)[nodes, branch] > 0 if level else self.tree.real[branch]
            at, nodes, branch = at[real], nodes[real], branch[real]
            if not len(at):
                continue
            buckets = self.buckets(context[:, at], level, nodes)
            g = self._softmax(buckets, level, nodes)
            g[np.arange(len(at)), branch] -= 1
            flat = buckets.ravel().astype(np.int32)
            order = np.argsort(flat)
            ranked, rows = flat[order], order % len(at)
            first = np.flatnonzero(np.diff(ranked, prepend=-1))
            size = np.diff(first, append=len(order))
            many = size > 1
            for alone in (True, False):  # most buckets are met once in a step
                begin, n = first[many ^ alone], size[many ^ alone]
                if not len(begin):
                    continue
                if alone:
                    sums = g.take(rows[begin], axis=0)
                else:
                    ends = np.cumsum(n)
                    sums = np.add.reduceat(g.take(rows[np.arange(ends[-1]) + np.repeat(begin - ends + n, n)], axis=0), ends - n, axis=0)
                used = ranked[begin]
                seen[used] += n
                sums *= (rate / np.sqrt(1 + 8 * seen[used]))[:, None].astype(np.float32)
                self.weights[used] -= sums


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in parts, as Python's copies of a whole one are several times its size."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per block: ids, sizes, tokens (32-bit places), words (hashes), training counts."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"block bigint, ids array<{kind}>, sizes array<bigint>, chars bigint, tokens binary, words binary, counts binary"
    names = ["block", "ids", "sizes", "chars", "tokens", "words", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, keys, texts, size, id_type = TaskContext.get().partitionId() << 32, [], [], 0, None

        def flush() -> pa.RecordBatch:
            places: dict[bytes, int] = {}
            flat, sizes, train = [], [], []
            for key, text in zip(keys, texts, strict=True):
                words = text.encode().lower().split()
                words.append(END)
                flat.extend([places.setdefault(w, len(places)) for w in words])
                sizes.append(len(words))
                train.append(not is_held_out(key))
            tokens = np.array(flat, np.int32)
            counts = np.bincount(tokens[np.repeat(train, sizes)], minlength=len(places)).astype(np.int32)
            words = np.fromiter(map(xxhash.xxh64_intdigest, places), np.uint64, len(places))
            order = np.argsort(words)  # so that a shard's words follow each other
            place = np.empty(len(order), np.int32)
            place[order] = np.arange(len(order), dtype=np.int32)
            return pa.RecordBatch.from_arrays([pa.array([block]), pa.array([keys], pa.list_(id_type)), pa.array([sizes], pa.list_(pa.int64())), pa.array([size]), *[pa.array([x.tobytes()], pa.binary()) for x in (place[tokens], words[order], counts[order])]], names=names)

        for batch in _slices(batches):
            id_type = batch.schema.field(0).type
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys.append(key)
                texts.append(text or "")
                size += len(texts[-1]) + 32
                if size >= BLOCK_CHARS:
                    yield flush()
                    block, keys, texts, size = block + 1, [], [], 0
        if keys:
            yield flush()

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def _array(column: pa.Array, i: int, dtype: type) -> np.ndarray:
    return np.frombuffer(column[i].as_buffer(), dtype)


def _cells(texts: DataFrame, shards: int) -> DataFrame:
    """(shard, block, words, counts): each block's words by the highest bits of their hashes."""

    lowest = np.array([s * (1 << 64) // shards for s in range(shards)], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                words, counts = _array(batch.column(1), i, np.uint64), _array(batch.column(2), i, np.int32)
                cuts = [*np.searchsorted(words, lowest).tolist(), len(words)]
                used = [s for s in range(shards) if cuts[s] < cuts[s + 1]]
                block = batch.column(0)[i].as_py()
                pieces = [pa.array([x[cuts[s] : cuts[s + 1]].tobytes() for s in used], pa.binary()) for x in (words, counts)]
                yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([block] * len(used), pa.int64()), *pieces], names=["shard", "block", "words", "counts"])

    return texts.select("block", "words", "counts").mapInArrow(run, "shard int, block bigint, words binary, counts binary")


def _totals(cells: DataFrame) -> DataFrame:
    """(block, shard, totals) for each cell; and for each shard, with block -1 - shard, its
    leaves as rows of (class and code, words, tokens), where negative leaves are classes of
    tokens that are left out of their counts."""
    schema = "block bigint, shard int, totals binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = None, []

        def flush() -> Iterator[pa.RecordBatch]:
            sizes = [len(w) // 8 for _, w, _ in held]
            words = np.frombuffer(b"".join(w for _, w, _ in held), np.uint64)
            counts = np.frombuffer(b"".join(c for _, _, c in held), np.int32)
            known, back = np.unique(words, return_inverse=True)
            totals = np.bincount(back, counts, len(known)).astype(np.int64)
            parts = np.split(totals[back], np.cumsum(sizes)[:-1])
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _, _ in held]), pa.array([shard] * len(held), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["block", "shard", "totals"])
            real = np.flatnonzero(totals)
            n = totals[real]
            leaves, at = np.unique(token_class(n).astype(np.int64) << DEPTH * DIGIT | leaf_code(known[real]), return_inverse=True)
            less = np.bincount(token_class(n - 1), n, WAYS).astype(np.int64)
            table = np.concatenate([np.stack([leaves, np.bincount(at, minlength=len(leaves)), np.bincount(at, n, len(leaves)).astype(np.int64)], 1), np.stack([-1 - np.arange(WAYS), np.zeros(WAYS, np.int64), less], 1)])
            yield pa.RecordBatch.from_arrays([pa.array([-1 - shard], pa.int64()), pa.array([shard], pa.int32()), pa.array([table.astype(np.int64).tobytes()], pa.binary())], names=["block", "shard", "totals"])

        for batch in _slices(batches):
            for s, b, w, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if s != shard and held:
                    yield from flush()
                    held = []
                shard = s
                held.append((b, w, c))
        if held:
            yield from flush()

    return cells.repartition("shard").sortWithinPartitions("shard", "block").mapInArrow(run, schema)


def _tree(counted: DataFrame) -> Tree:
    """The sums of all shards' leaves; their number is bounded by classes and codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.column(0).to_pylist():
                for one in part:
                    table = np.frombuffer(one, np.int64).reshape(-1, 3)
                    yield pa.RecordBatch.from_arrays([pa.array(table[:, i].copy()) for i in range(3)], names=["leaf", "words", "tokens"])

    rows = counted.where("block < 0").select("totals").mapInArrow(run, "leaf bigint, words bigint, tokens bigint")
    table = rows.groupBy("leaf").agg(F.sum("words").alias("words"), F.sum("tokens").alias("tokens")).toArrow()
    leaf, words, tokens = (table.column(i).to_numpy() for i in range(3))
    less = np.zeros(WAYS)
    less[-1 - leaf[leaf < 0]] = tokens[leaf < 0]
    return Tree(leaf[leaf >= 0], words[leaf >= 0], tokens[leaf >= 0], less)


def _whole_texts(sizes: np.ndarray, most: int = STEP_TOKENS) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` tokens each."""
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        yield at, to
        at = to


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    for i in range(batch.num_rows):
        totals = b"".join(batch.column("totals")[i].as_py())
        yield {"ids": batch.column("ids")[i].values, "sizes": batch.column("sizes")[i].values.to_numpy(), "tokens": _array(batch.column("tokens"), i, np.int32), "words": _array(batch.column("words"), i, np.uint64), "counts": np.frombuffer(totals, np.int64)}


def train_round(blocks: DataFrame, model: Model, tasks: int) -> Model:
    """All tasks' gradient updates over `blocks`, averaged by how often a bucket was seen."""
    shared = blocks.sparkSession.sparkContext.broadcast(model)  # a table of at most MOST_BUCKETS rows
    columns = [f"c{i}" for i in range(WAYS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = shared.value
        own, seen = Model(start.tree, start.weights.copy()), np.zeros(len(start.weights))
        for batch in batches:
            for row in _rows(batch):
                sizes, starts, codes = row["sizes"], np.concatenate([[0], np.cumsum(row["sizes"])]), leaf_code(row["words"])
                train = ~np.array([is_held_out(k) for k in row["ids"].to_pylist()])
                for a, b in _whole_texts(sizes):
                    tokens = row["tokens"][starts[a] : starts[b]]
                    use = np.repeat(train[a:b], sizes[a:b])
                    if use.any():
                        context = contexts(row["words"][tokens], sizes[a:b])[:, use]
                        tokens = tokens[use]
                        for at in range(0, len(tokens), STEP_TOKENS):
                            some = slice(at, at + STEP_TOKENS)
                            own.step(context[:, some], token_class(row["counts"][tokens[some]] - 1), codes[tokens[some]], seen)
        at = np.flatnonzero(seen)
        for some in np.array_split(at, len(at) // 4096 + 1):
            change = (own.weights[some] - start.weights[some]) * seen[some, None].astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(seen[some]), *[pa.array(np.ascontiguousarray(change[:, i])) for i in range(WAYS)]], names=["bucket", "seen", *columns])

    changes = blocks.coalesce(tasks).mapInArrow(run, f"bucket bigint, seen double, {', '.join(f'{c} float' for c in columns)}")
    table = changes.groupBy("bucket").agg(F.sum("seen").alias("seen"), *[F.sum(c).cast("float").alias(c) for c in columns]).toArrow()
    weights = model.weights.copy()
    if table.num_rows:
        at, seen = table.column("bucket").to_numpy(), table.column("seen").to_numpy()
        weights[at] += np.stack([table.column(c).to_numpy() / seen for c in columns], 1).astype(np.float32)
    return Model(model.tree, weights)


def score_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    with small_batches(docs.sparkSession):
        blocks, model = fit(docs, id_col, text_col, rounds)
        return written(score_blocks(blocks, model, docs.schema[id_col].dataType.simpleString()), "lm-scores")


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> tuple[DataFrame, Model]:
    """(the blocks of all documents with their words' totals, the model trained on them)."""
    spark = docs.sparkSession
    texts = written(_blocks(docs, id_col, text_col), "lm-blocks", group=1)
    chars, words = texts.agg(F.coalesce(F.sum("chars"), F.lit(0)), F.coalesce(F.sum(F.octet_length("words") / 8), F.lit(0))).first()
    shards = int(min(MOST_SHARDS, max(1, words // SHARD_WORDS + 1)))
    # By a number of our own, as what is gathered can't spill and Spark would join small partitions.
    parts = int(max(spark.sparkContext.defaultParallelism, words * 8 // GATHER_BYTES + 1))
    answers = _totals(_cells(texts, shards)).repartition(parts, "block").groupBy("block").agg(F.transform(F.array_sort(F.collect_list(F.struct("shard", "totals"))), lambda a: a["totals"]).alias("totals"))
    counted = written(answers, "lm-totals", group=GATHER_ROWS)
    tree = _tree(counted)
    blocks = texts.select("block", "ids", "sizes", "tokens", "words").join(counted.where("block >= 0"), "block")
    blocks = written(blocks.withColumn("round", F.pmod(F.xxhash64("block"), F.lit(rounds)).cast("int")), "lm-joined", by="round", group=1)
    n_train = tree.mass[0].sum()
    buckets = 1 << int(np.clip(n_train / TOKENS_PER_BUCKET, LEAST_BUCKETS, MOST_BUCKETS)).bit_length() - 1
    model = Model(tree, np.zeros((buckets, WAYS), np.float32))
    tasks = int(max(spark.sparkContext.defaultParallelism, chars // rounds // TASK_CHARS))
    if n_train:
        for i in range(rounds):
            model = train_round(blocks.where(F.col("round") == i).drop("round"), model, tasks)
    return blocks.drop("round"), model


def score_blocks(blocks: DataFrame, model: Model, kind: str) -> DataFrame:
    shared = blocks.sparkSession.sparkContext.broadcast(model)  # a table of at most MOST_BUCKETS rows
    n_train = int(model.tree.mass[0].sum())
    schema = f"id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    names = [x.split(" ")[0] for x in schema.split(", ")]
    n_words = model.tree.words

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for row in _rows(batch):
                sizes, starts, counts = row["sizes"], np.concatenate([[0], np.cumsum(row["sizes"])]), row["counts"]
                classes, codes = token_class(counts).astype(np.int64), leaf_code(row["words"])
                base = np.log10((counts + 1) / (n_train + n_words + 1))
                share = np.log(model.tree.share(counts, classes, codes))
                own = np.zeros(len(sizes))
                for a, b in _whole_texts(sizes):
                    tokens, logs = row["tokens"][starts[a] : starts[b]], []
                    context = contexts(row["words"][tokens], sizes[a:b])
                    for at in range(0, len(tokens), STEP_TOKENS):
                        some = tokens[at : at + STEP_TOKENS]
                        logs.append(model.log_probabilities(context[:, at : at + STEP_TOKENS], classes[some], codes[some]) + share[some])
                    own[a:b] = np.add.reduceat(np.concatenate(logs) / np.log(10), starts[a:b] - starts[a])
                held = np.array([is_held_out(k) for k in row["ids"].to_pylist()])
                total = lambda x: np.add.reduceat(x[row["tokens"]], starts[:-1])  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([row["ids"], pa.array(held), pa.array(sizes), pa.array(total((counts > 0).astype(np.int64))), pa.array(np.full(len(sizes), n_train)), pa.array(total(base)), pa.array(own)], names=names)

    return blocks.mapInArrow(score, schema)
