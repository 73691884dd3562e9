"""Groups of near-duplicates against brute force, with crowded shards and at the threshold."""

import math
import random

import numpy as np

from docloom.llm import near_copies
from test_operators import components


def test_similar_groups_catch_near_copies_only(spark):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(3000)]
    originals = [[rng.choice(vocabulary) for _ in range(rng.randint(120, 400))] for _ in range(150)]
    rows = [(i, " ".join(w)) for i, w in enumerate(originals)]
    for i, w in enumerate(originals[:60]):  # each change breaks five shingles of five words
        w = list(w)
        for at in rng.sample(range(len(w)), max(1, len(w) // 60)):
            w[at] = rng.choice(vocabulary)
        rows.append((1000 + i, " ".join(w)))
    rows += [(2000, None), (2001, ""), (2002, "two words"), (2003, "two words")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["id"]: r["component"] for r in near_copies.similar_groups(df).collect()}
    assert sum(got[1000 + i] == i for i in range(60)) >= 56
    assert all(got[i] == i for i in range(150))
    assert (got[2001], got[2003]) == (2000, 2002)
    assert near_copies.similar_groups(df.limit(0)).count() == 0


def test_similar_groups_link_by_overlap_alone(spark):
    """At an overlap of 0.8 and just above nearly all pairs are found, below it none is."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(9))
    rows, overlap, shingles = [], {}, lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    for i in range(600):
        n = rng.randint(150, 400)
        w = [word() for _ in range(n)] if i % 4 else [word() for _ in range(rng.randint(8, 24))]
        m = len(w) - 4  # shingles, of which this part is shared
        cut = m - math.ceil(m * (rng.choice((8 / 9, 0.895)) if i % 2 else rng.choice((0.8, 0.86)))) or 1
        v = w[:-cut] + [word() for _ in range(cut)]
        rows += [(i, " ".join(w)), (1000 + i, " ".join(v))]
        a, b = shingles(w), shingles(v)
        overlap[i] = len(a & b) / len(a | b)
    got = {r["id"]: r["component"] for r in near_copies.similar_groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    similar = [i for i in overlap if overlap[i] >= 0.8]
    apart = [i for i in overlap if 0.6 < overlap[i] < 0.8]
    assert len(similar) > 150 and len(apart) > 150 and np.mean([overlap[i] for i in similar]) < 0.84
    assert sum(got[1000 + i] == i for i in similar) >= 0.94 * len(similar)
    assert all(got[1000 + i] == 1000 + i for i in apart)


def test_failed_candidates_hide_no_link(spark):
    """A text between two others: links that fail the overlap keep none that holds away."""
    base = [f"w{i}" for i in range(300)]
    texts = [base[:k] + [f"x{k}-{i}" for i in range(300 - k)] for k in range(240, 300, 4)]
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    linked = {(a, b) for a in range(len(sets)) for b in range(a) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8}
    want = components(range(len(sets)), lambda a, b: (a, b) in linked or (b, a) in linked)
    got = {r["id"]: r["component"] for r in near_copies.similar_groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == want and len(set(want.values())) > 1


def family(rng, n, words=300, edits=6):
    """Texts that are all edits of one, so that some pairs are similar enough and some aren't."""
    base = [f"w{i}" for i in range(words)]
    out = []
    for k in range(n):
        text = list(base)
        for at in rng.sample(range(words), rng.randint(1, edits)):
            text[at] = f"x{k}-{at}"
        out.append(" ".join(text))
    return out


def jaccard(a, b):
    a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a.split(), b.split()))
    return len(a & b) / len(a | b)


def test_crowded_shards_lose_no_link(spark, monkeypatch):
    """With cells of eight fingerprints the groups of families are those of brute force."""
    rng = random.Random(4)
    texts = family(rng, 60) + family(rng, 60, edits=18) + [t.replace("w", "v") for t in family(rng, 40, edits=30)]
    linked = {(a, b) for a in range(len(texts)) for b in range(a) if jaccard(texts[a], texts[b]) >= 0.8}
    want = components(range(len(texts)), lambda a, b: (a, b) in linked or (b, a) in linked)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    monkeypatch.setattr(near_copies, "CELL", 8)
    got = {r["id"]: r["component"] for r in near_copies.similar_groups(df).collect()}
    assert got == want and 1 < len(set(want.values())) < len(texts)


def test_crowded_shards_search_what_has_no_candidate_in_its_cell(spark, monkeypatch):
    """Pairs in a crowd of texts that share seven tenths and are no candidates of each other."""
    rng = random.Random(12)
    base, texts = [f"w{i}" for i in range(210)], []
    for k in range(120):
        own = [f"x{k}-{i}" for i in range(90)]
        cut = rng.randint(20, 28)
        texts += [base + own, base + own[:-cut] + [f"y{k}-{i}" for i in range(cut)]]
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    sets = [np.unique(near_copies.shingle_hashes(text, 5)) for _, text in rows]
    prints = [int.from_bytes(near_copies.hashes_fingerprint(s, near_copies.LANES).tobytes(), "big") for s in sets]
    shards, far = [set(near_copies.band_keys(s)) for s in sets], near_copies.Reach(0.8).far
    share = lambda a, b: len(np.intersect1d(sets[a], sets[b])) / len(np.union1d(sets[a], sets[b]))
    linked = {(a, b) for a in range(240) for b in range(a) if share(a, b) >= 0.8}
    assert linked == {(a + 1, a) for a in range(0, 240, 2)}
    found = {a for b, a in linked if shards[a] & shards[b] and (prints[a] ^ prints[b]).bit_count() <= far}
    assert len(found) > 110
    monkeypatch.setattr(near_copies, "CELL", 8)
    got = {r["id"]: r["component"] for r in near_copies.similar_groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert {a for a in range(0, 240, 2) if got[a + 1] == a} >= found
    assert all(got[a] == a for a in range(0, 240, 2))


def test_radius_does_not_depend_on_which_set_asks():
    reach = near_copies.Reach(0.8)
    assert all(reach.radius(m) == reach.short for n in range(1, 21) for m in range(n, 200) if reach.even(n, m))
    assert reach.radius(200) == reach.far < reach.short


def test_links_across_groups_connect_what_overlaps(spark, monkeypatch):
    """`_across` connects the roots that pairs of a shard within reach and with enough overlap
    connect, whether shards are split or not."""
    rng = random.Random(6)
    base = [rng.getrandbits(64) for _ in range(200)]
    sets = [np.unique(np.array([rng.getrandbits(64) if rng.random() < share else h for h in base], np.uint64)) for share in (rng.choice((0.02, 0.08, 0.15)) for _ in range(90))]
    prints = [near_copies.hashes_fingerprint(s, near_copies.LANES).tobytes() for s in sets]
    rows = [(k % 2, k, len(s), f, k % 45) for k, (s, f) in enumerate(zip(sets, prints, strict=True))]
    df = spark.createDataFrame(rows, "shard bigint, node bigint, n bigint, fp binary, root bigint")
    held = spark.createDataFrame([(k, len(s), np.sort(s.astype(np.uint32)).tobytes()) for k, s in enumerate(sets)], "node bigint, n bigint, hashes binary")
    reach, bits = near_copies.Reach(0.8), [int.from_bytes(f, "big") for f in prints]
    share = lambda x, y: len(np.intersect1d(x, y)) / len(np.union1d(x, y))
    want = {(a, b) for a in range(90) for b in range(a + 1, 90) if a % 2 == b % 2 and (bits[a] ^ bits[b]).bit_count() <= reach.far and share(sets[a], sets[b]) >= 0.8}

    def groups(links):
        met = {(a % 45, b % 45) for a, b in links}
        return components(range(45), lambda a, b: (a, b) in met or (b, a) in met)

    for cell in (512, 10):
        monkeypatch.setattr(near_copies, "CELL", cell)
        got = {tuple(r) for r in near_copies._across(df, held, reach).collect()}
        assert got <= want and groups(got) == groups(want) and len(set(groups(want).values())) > 1


def test_shards_per_fingerprint_are_fixed_and_recall_is_planned():
    hashes = np.arange(1, 1000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    assert len(near_copies.band_keys(hashes)) == near_copies.BANDS
    assert near_copies.band_recall(0.8) * near_copies.WITHIN > 0.98
