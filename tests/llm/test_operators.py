"""The training-data operators against brute force, round trips and held-out figures."""

import collections
import hashlib
import math
import os
import random
import re
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest
import xxhash
from conftest import DATA
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.llm import ann, maxent_lm, packing, phrase_fingerprint, quality_classifier, secret_scan, simhash, source_mix, suffix_dedup, url_reputation
from docloom.llm import queries as Q
from docloom.llm.oracles import ORACLES

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(scope="module")
def corpus(spark):
    """Nulls, empty and long texts, repeated rows and ids, ties, and clashing columns."""
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdeéß😀") for _ in range(rng.randint(1, 7))) for _ in range(80)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    shared, long = say(80), say(6000)
    texts = [None, "", " \t\n", "One", long, long, shared, f"{say(10)} {shared} {say(3)}", shared + " x", f"{shared} {shared}", "a" * 700, "token = abcdefgh12 AKIA" + "Z" * 12 + " " + "0af" * 20, *[say(rng.randint(1, 60)) for _ in range(40)]]
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None]), None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[6], rows[6], (None, shared, "en", "a", 1)]
    return spark.createDataFrame(rows, DOCS), rows


def empty(spark, schema=DOCS):
    return spark.createDataFrame([], schema)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql_agrees(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = Q.QUERIES[name](spark, DATA)
    norm = lambda rows: sorted(tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in rows)
    assert norm(df.collect()) == norm(con.execute(f"SELECT {', '.join(df.columns)} FROM ({ORACLES[name]})").fetchall())


# --- 1


def test_url_rules_and_odd_urls(spark):
    urls = [None, "", "nothing", "HTTP://WWW.Example.ORG/en/12?x", "x://example.org/es/a", "http://a.com/fr/x#y", "http://a.com/de/", "http://notorg/x", "http://b.org", "://b.org/"]
    pages = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(urls)], "page_id int, url string, host string")
    outcomes = spark.createDataFrame([("a.com", 0)] * 9 + [("b.com", 1)] * 9 + [("b.com", None)], "host string, good int")
    got = {r["page_id"]: r for r in url_reputation.filter_urls(pages, outcomes, Q.URL_RULES).collect()}
    assert len(got) == len(urls) and got[0]["host"] == got[2]["path"] == ""
    assert (got[3]["host"], got[3]["path"], got[3]["rule"], got[3]["verdict"]) == ("www.example.org", "/en/12", "example.org/en/1", "block")
    assert [got[i]["rule"] for i in (4, 5, 6, 7, 8, 9)] == ["example.org/es/", "com/fr/", "com/de/", None, None, "org/"]


def test_reputation_shrinks_towards_parents(spark):
    outcomes = [("good.site.com", 1)] * 40 + [("bad.site.net", 0)] * 40 + [("new.site.com", None), ("one.other.net", 1)]
    rep = {r["host"]: r for r in url_reputation.host_reputation(spark.createDataFrame(outcomes, "host string, good int")).collect()}
    assert rep["good.site.com"]["bound"] > 0.5 > rep["bad.site.net"]["bound"]
    assert rep["new.site.com"]["mean"] > rep["one.other.net"]["mean"] - 0.5 and rep["new.site.com"]["n"] == 0
    assert all(r["bound"] < r["mean"] for r in rep.values())
    assert url_reputation.host_reputation(spark.createDataFrame([], "host string, good int")).count() == 0


# --- 2


def brute_spans(text):
    text = text or ""
    out = []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        out += [(m.start(), 0, m.end())] * (len(m[2]) >= 8)
    for k, pattern, least in ((1, r"AKIA[A-Z0-9]+", 16), (2, r"[0-9a-f]+", 32)):
        out += [(m.start(), k, m.end()) for m in re.finditer(pattern, text) if m.end() - m.start() >= least]
    return sorted(out)


def test_secret_spans(spark, corpus):
    odd = ["token=token: abcdefgh", "😀 API_KEY: 'abcdefghij' secret=x", "AKIA" + "A" * 11, "AKIAAKIA" + "1" * 12, "f" * 31, "F" * 40, "password='aaaaaaaa'password=bbbbbbbb", "-----BEGIN RSA PRIVATE KEY-----"]
    df = corpus[0].unionByName(spark.createDataFrame([(100 + i, t, "en", "a", 0) for i, t in enumerate(odd)], DOCS))
    found, ledger = secret_scan.scan_secrets(df)
    rows = found.collect()
    assert len(rows) == df.count()
    for r in rows:
        assert [(s["start"], s["kind"], s["end"]) for s in r["secret_spans"] if s["kind"] < 3] == brute_spans(r["text"])
    assert secret_scan.scan_secrets(empty(spark))[0].count() == 0
    # What the ledger has isn't scanned again: a made-up finding stays.
    forged = ledger.withColumn("spans", F.array().cast(ledger.schema["spans"].dataType))
    again, _ = secret_scan.scan_secrets(df.unionByName(spark.createDataFrame([(999, "token=newsecret1", "en", "a", 0)], DOCS)), forged)
    assert {r["doc_id"] for r in again.where(F.size("secret_spans") > 0).collect()} == {999}
    masked = {r["doc_id"]: r for r in secret_scan.masked(found, count_col="n_chars").collect()}
    assert masked[106]["text"] == "[secret]'[secret]" and masked[106]["n_chars"] == len(masked[106]["text"])
    assert masked[4]["text"] == corpus[1][4][1] and masked[0]["text"] is None


@pytest.mark.parametrize("small", [0, 100_000])
def test_ledger_runs_unseen_rules_only(spark, corpus, monkeypatch, small):
    monkeypatch.setattr(secret_scan, "SMALL_ROWS", small)
    key = "ghp_" + "a1" * 15
    old = corpus[0].unionByName(spark.createDataFrame([(900 + i, f"{key} password=abcdefgh{i % 2}", "en", "a", 0) for i in range(4)], DOCS))
    new = old.unionByName(spark.createDataFrame([(950, f"another {key}", "en", "a", 0), (951, "nothing", "en", "a", 0)], DOCS))
    once = {r["doc_id"]: r["secret_spans"] for r in secret_scan.scan_secrets(new)[0].collect()}
    _, first = secret_scan.scan_secrets(old, rules=secret_scan.BASE_RULES)
    found, second = secret_scan.scan_secrets(new, first)
    assert {r["doc_id"]: r["secret_spans"] for r in found.collect()} == once
    # Old blobs get the added rules only, new blobs get all; no pair is ever run twice.
    pairs = [(r["blob"], rule) for r in second.collect() for rule in r["rules"]]
    blobs = {b for b, _ in pairs}
    assert len(pairs) == len(set(pairs)) == len(blobs) * len(secret_scan.RULES)
    added = {secret_scan.rule_version(r) for r in secret_scan.EXTRA_RULES}
    fresh = secret_scan.scan_unseen(new, first).collect()
    known = {r["blob"] for r in first.collect()}
    assert {r["blob"] for r in fresh} == blobs and all(set(r["rules"]) == added for r in fresh if r["blob"] in known)
    assert secret_scan.scan_unseen(new, second).count() == 0
    # One changed rule is run alone, and the old one's findings aren't shown for it.
    changed = (*secret_scan.RULES[:2], secret_scan.Rule("hex", r"[0-9a-f]{40,}", 0, 40))
    third = secret_scan.scan_unseen(new, second, changed).collect()
    assert {tuple(r["rules"]) for r in third} == {(secret_scan.rule_version(changed[2]),)}
    shown = {r["doc_id"]: r["secret_spans"] for r in secret_scan.scan_secrets(new, second, changed)[0].collect()}
    assert shown == {i: [s for s in spans if s["kind"] < 2 or s["kind"] == 2 and s["end"] - s["start"] >= 40] for i, spans in once.items()}
    with pytest.raises(ValueError):
        secret_scan.scan_unseen(new, rules=(*secret_scan.RULES, secret_scan.RULES[0]))


# --- 3


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=60))
def test_suffix_array(s):
    s = [*s, 0]
    assert suffix_dedup.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def brute_dedup(texts, width):
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(d[i : i + width] for d in data for i in range(len(d) - width + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - width + 1):
            if seen[d[i : i + width]] > 1:
                gone[i : i + width] = True
        out.append((len(d), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), bytes(np.frombuffer(d, np.uint8)[~gone])))
    return out


def test_repeats_are_removed(spark, corpus):
    df, rows = corpus
    rng = random.Random(5)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(330))
    extra = [(200 + i, "".join(rng.choice("xyz ") for _ in range(rng.randint(0, 300))) + passage[rng.randint(0, 60) : 330 - rng.randint(0, 60)] + "".join(rng.choice("uvw ") for _ in range(90)), "en", "a", 0) for i in range(60)]
    df, rows = df.unionByName(spark.createDataFrame(extra, DOCS)), rows + extra
    got = sorted((r["id"] is not None, r["id"] or 0, r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffix_dedup.remove_repeats(df).collect())
    want = sorted((r[0] is not None, r[0] or 0, *b) for r, b in zip(rows, brute_dedup([r[1] for r in rows], 200), strict=True))
    assert got == want
    assert suffix_dedup.remove_repeats(empty(spark)).count() == 0


# --- 4


def test_model_is_a_distribution_and_ranks_held_out_text(spark):
    docs, labels = (spark.read.parquet(f"{DATA.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    model, chosen = quality_classifier.fit_model(docs, quality_classifier.trusted_ids(labels))
    assert chosen.count() > 50
    keys, p1 = model.tables["p1"]
    assert abs(p1.sum() + model.floor * (len(keys) + 1) - 1) < 1e-3
    judged = quality_classifier.classify(docs, labels).join(labels, "doc_id").join(chosen.withColumnRenamed("id", "doc_id"), "doc_id", "left_anti")
    good, bad = (judged.where(w).agg(F.avg(F.col("keep").cast("int"))).first()[0] for w in ("quality = 1 and toxic = 0", "quality = 0"))
    assert good > 0.95 and bad < 0.45


def test_kneser_ney_by_hand(spark):
    """Interpolated modified Kneser-Ney of a tiny corpus, computed plainly."""
    texts = ["a b a b c", "a b c", "b a", "c c c a b"]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts * 2)], "doc_id bigint, text string, lang string")
    model, chosen = quality_classifier.fit_model(docs, spark.range(8).toDF("id"))
    used = [texts[r["id"] % 4] for r in chosen.collect()]
    c3 = collections.Counter(g for t in used for w in [["<", "<", *t.split(), ">"]] for g in zip(w, w[1:], w[2:]))
    c2 = collections.Counter((b, c) for _, b, c in c3)
    c1 = collections.Counter(c for _, c in c2)

    def disc(counts):
        n = collections.Counter(counts.values())
        return quality_classifier.discounts(n[1], n[2], n[3], n[4])

    d = [disc(c) for c in (c1, c2, c3)]

    def level(counts, gram, lower_p, dd):
        own = {g: n for g, n in counts.items() if g[:-1] == gram[:-1]}
        if not own:
            return lower_p
        total, off = sum(own.values()), lambda n: dd[min(n, 3) - 1]
        left = sum(off(n) for n in own.values()) / total
        return (own[gram] - off(own[gram])) / total * (gram in own) + left * lower_p if gram in own else left * lower_p

    def p(a, b, c):
        ones = {(k,): n for k, n in c1.items()}
        low = level(ones, (c,), 1 / (len(c1) + 1), d[0])
        return level(c3, (a, b, c), level(c2, (b, c), low, d[1]), d[2])

    for text in ("a b c", "c a z", "", "b a b"):
        w = ["<", "<", *text.split(), ">"]
        want = -sum(math.log(p(*g)) for g in zip(w, w[1:], w[2:]))
        assert abs(model.score([text])[0][0] - want) < 1e-4


def test_thresholds_and_decisions_by_hand(spark):
    """Scores, thresholds and keep of every document, from the model and plain arithmetic."""
    docs, labels = (spark.read.parquet(f"{DATA.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.where("lang is null or lang <> 'xx'")
    trusted = quality_classifier.trusted_ids(labels)
    model, chosen = quality_classifier.fit_model(docs, trusted)
    held_ids = {r["id"] for r in trusted.collect()} - {r["id"] for r in chosen.collect()}
    rows = docs.collect()
    nll, n = model.score([r["text"] for r in rows])
    langs = {r["lang"] for r in rows}
    held = {lang: [i for i, r in enumerate(rows) if r["lang"] == lang and r["doc_id"] in held_ids] for lang in langs}
    mean = {lang: nll[at].sum() / (n[at] + 1).sum() for lang, at in held.items() if at}
    at_all = [i for at in held.values() for i in at]
    whole = nll[at_all].sum() / (n[at_all] + 1).sum()
    score = [(nll[i] + 20 * mean.get(r["lang"], whole)) / (n[i] + 21) for i, r in enumerate(rows)]
    quantile = lambda x: sorted(x)[math.ceil(0.99 * len(x)) - 1]
    every, above = quantile([score[i] for i in at_all]), quantile([score[i] - mean[rows[i]["lang"]] for i in at_all])
    limit = {}
    for lang, at in held.items():
        own, part = quantile([score[i] for i in at]) if at else every, min(1, len(at) / 100)
        limit[lang] = part * own + (1 - part) * max(mean[lang] + above * math.sqrt(1 + 1 / len(at)), own) if at else every
    got = {r["doc_id"]: r for r in quality_classifier.classify(docs, labels).collect()}
    for i, r in enumerate(rows):
        assert math.isclose(got[r["doc_id"]]["score"], score[i], rel_tol=1e-6)
        assert math.isclose(got[r["doc_id"]]["threshold"], math.exp(limit[r["lang"]]), rel_tol=1e-6)
        if abs(score[i] - limit[r["lang"]]) > 1e-6:
            assert got[r["doc_id"]]["keep"] == (score[i] <= limit[r["lang"]])


def test_sample_is_bounded_by_words(spark):
    docs = spark.createDataFrame([(i, "a b c d " * (1 + 50 * (i == 3)), "en") for i in range(40)], "doc_id bigint, text string, lang string")
    _, chosen = quality_classifier.fit_model(docs, spark.range(40).toDF("id"), sample_words=60)
    assert 0 < 4 * chosen.count() <= 60 and 3 not in {r["id"] for r in chosen.collect()}


def test_classifier_is_fitted_on_all_trusted_documents(spark):
    """Of more documents than a sample holds, and over several blocks and shards: the scores
    are those of a model in memory that saw every trusted document of the half."""
    rng = random.Random(4)
    common = ["w" + str(i) for i in range(300)]
    rows = [(i, " ".join([*rng.choices(common, k=rng.randint(1, 6)), f"rare{i % 9000}", *rng.choices(common[:9], k=2)]), "en") for i in range(13_000)]
    rows += [(13_000, None, "en"), (13_001, " ", "en"), (13_002, rows[5][1], None), (13_003, "unseen words", "en")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    labels = docs.where("doc_id < 13000").select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    model, chosen = quality_classifier.fit_model(docs, quality_classifier.trusted_ids(labels), sample_docs=20_000)
    assert chosen.count() > quality_classifier.SAMPLE_DOCS
    nll, n = model.score([r[1] for r in rows])
    before, quality_classifier.BLOCK_CHARS, quality_classifier.SHARD_CHARS, quality_classifier.HOT_WORDS = (quality_classifier.BLOCK_CHARS, quality_classifier.SHARD_CHARS, quality_classifier.HOT_WORDS), 20_000, 100_000, 40
    try:
        half = quality_classifier._half(quality_classifier.trusted_ids(labels))
        weights = quality_classifier.fit_weights(docs.join(half, docs["doc_id"] == half["id"], "left_semi"))
        got = {r["hash"]: r for r in quality_classifier.score_texts(docs, *weights).collect()}
        judged = {r["doc_id"]: r for r in quality_classifier.classify(docs, labels).collect()}
    finally:
        quality_classifier.BLOCK_CHARS, quality_classifier.SHARD_CHARS, quality_classifier.HOT_WORDS = before
    hashed = {r["doc_id"]: r["h"] for r in docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    for i, r in enumerate(rows):
        assert math.isclose(got[hashed[r[0]]]["nll"], nll[i], rel_tol=1e-6) and got[hashed[r[0]]]["n_tokens"] == n[i]
    chosen = {r["id"] for r in chosen.collect()}
    at = [i for i in range(13_000) if i not in chosen]
    mean = nll[at].sum() / (n[at] + 1).sum()
    assert len(judged) == len(rows)
    assert all(math.isclose(judged[r[0]]["score"], (nll[i] + 20 * mean) / (n[i] + 21), rel_tol=1e-6) for i, r in enumerate(rows) if r[2])


def test_classifier_leaves_few_shuffle_files(spark):
    """Questions, counts and copies of texts go as soon as what they are for is written."""
    docs, labels = (spark.read.parquet(f"{DATA.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    folders = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    on_disk = lambda: {f: f.stat().st_size for d in folders for f in Path(d).rglob("shuffle_*.data")}
    before = on_disk()
    quality_classifier.classify(docs, labels).write.format("noop").mode("overwrite").save()
    left = sum(n for f, n in on_disk().items() if f not in before)
    assert left < 0.02 * os.path.getsize(f"{DATA.replace('0.001', '0.01')}/documents.parquet")


def test_trigrams_are_packed_whole():
    rng = np.random.default_rng(4)
    words = np.unique(rng.integers(0, 1 << 31, 500).astype(np.uint64))
    rows = np.unique(rng.integers(0, len(words), (4000, 3)) // [[1, 9, 9]], axis=0)
    b, a, c = rows[np.lexsort(rows.T[::-1])].T
    for part in (slice(0, 1), slice(7, 8), slice(30, 2000), slice(0, None)):
        counts = rng.integers(1, 70_000, len(b[part]))
        n_words, n, data = quality_classifier._pack_trigrams(words, a[part], b[part], c[part], counts)
        got, x, y, z, m = quality_classifier._unpack_trigrams(n_words, n, data)
        want = words.astype(np.int64)
        assert all((p == q).all() and len(p) == len(q) for p, q in ((got[x], want[a[part]]), (got[y], want[b[part]]), (got[z], want[c[part]]), (m, counts)))


def test_classifier_edges(spark, corpus):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(30)] + [(3, 0, 1), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    df = corpus[0].withColumn("score", F.lit("mine"))
    assert quality_classifier.classify(df, labels).count() == df.count()
    assert quality_classifier.classify(df, labels.limit(0)).where("keep").count() == df.count()
    assert quality_classifier.classify(empty(spark), labels).count() == 0


# --- 5


def test_neighbours(spark):
    df = spark.read.parquet(f"{DATA.replace('0.001', '0.01')}/embeddings.parquet")
    rows = {r["vec_id"]: np.array(r["embedding"], float) for r in df.collect()}
    ids = np.array(sorted(rows))
    points = np.stack([rows[i] for i in ids])
    got = collections.defaultdict(list)
    for r in sorted(ann.search(df, F.col("id") % 20 == 0).collect(), key=lambda r: r["rank"]):
        got[r["query_id"]].append((r["score"], r["id"]))
    hits = total = 0
    for q in [i for i in ids if i % 20 == 0]:
        d = np.sqrt(((points - rows[q]) ** 2).sum(1))
        want = sorted((x, i) for x, i in zip(d.tolist(), ids.tolist(), strict=True) if i != q)[:10]
        assert got[q] == sorted(got[q]) and len(got[q]) == 10
        hits, total = hits + len({i for _, i in want} & {i for _, i in got[q]}), total + 10
    assert hits / total >= 0.9


def read_share(index, k=10):
    """The part of the entries that sampled queries compare, and how many lists entries have."""
    rows = index.assigned.collect()
    points, lists = np.array([r["v"] for r in rows]), [r["lists"] for r in rows]
    sizes = np.bincount(np.concatenate(lists), minlength=len(index.graph.centres))
    d = np.sqrt(ann._nearest(points[::50], index.graph.centres))
    return float(((d <= index.ratio * d.min(1, keepdims=True)) * sizes).sum(1).mean() / len(points)), np.array([len(x) for x in lists])


def test_index_reads_little_of_clustered_vectors(spark):
    """50,000 vectors in clusters: a minority is replicated, queries compare below a tenth, and
    nine tenths of the neighbours are found."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(400, 16))
    points = centres[rng.integers(0, 400, 50_000)] + 0.25 * rng.normal(size=(50_000, 16))
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "vec_id bigint, embedding array<double>").repartition(4)
    index = ann.build_index(df.select(F.col("embedding").alias("v"), F.array("vec_id").alias("ids")), 10, "bigint")
    share, copies = read_share(index)
    assert share < 0.1 and (copies > 1).mean() < 0.45
    got = collections.defaultdict(set)
    for r in ann.search(df, F.col("id") % 500 == 0).collect():
        got[r["query_id"]].add(r["id"])
    hits = 0
    for q in range(0, 50_000, 500):
        d = ((points - points[q]) ** 2).sum(1)
        d[q] = np.inf
        hits += len(got[q] & set(np.argsort(d)[:10].tolist()))
    assert hits / 1000 >= 0.9


def test_graph_of_many_centroids_takes_bounded_memory():
    """The links of 6,000 centroids are the nearest, without the 288 MB of all distances."""
    import tracemalloc

    centres = np.random.default_rng(8).normal(size=(6_000, 8))
    tracemalloc.start()
    graph = ann.CentroidGraph(centres)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6
    for at in range(0, 6_000, 500):
        assert set(graph.links[at]) == set(np.argsort(((centres - centres[at]) ** 2).sum(1))[: ann.DEGREE + 1])


def test_neighbours_of_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (100, [1.0, 0.0]), (1, [0.0, 2.0]), (2, None), (3, []), (4, [float("nan"), 1.0]), (5, [0.0, 0.0]), (6, [None, 1.0]), (7, [1.0, 2.0, 3.0]), (8, [-1.0, 0.0]), (8, [-1.0, 0.0]), (200, [float("inf"), 1.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = sorted((r["query_id"], r["rank"], r["id"], r["score"]) for r in ann.search(df, F.col("id") % 100 == 0).collect())
    assert [g[:3] for g in got] == [(0, 1, 100), (0, 2, 8), (0, 3, 1), (100, 1, 0), (100, 2, 8), (100, 3, 1)]
    assert ann.search(df.limit(0), F.col("id") % 100 == 0).count() == 0


# --- 6


def test_language_model(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    texts = {r["doc_id"]: [*words_of(lower(r["text"])), None] for r in docs.collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    counts = collections.Counter(w for i, t in texts.items() if not held[i] for w in t)
    n, v = sum(counts.values()), len(counts)
    base = model = 0.0
    for r in maxent_lm.score_corpus(docs).collect():
        t = texts[r["id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["id"]], len(t), sum(counts[w] > 0 for w in t), n)
        assert math.isclose(r["base_score"], sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t), rel_tol=1e-9)
        if r["held_out"]:
            base, model = base + r["base_score"], model + r["score"]
    assert model > base


def plain_probability(model, counts, word, one, two):
    """Of a word after `two`, `one` (hashes), from the counts and weights alone."""
    import xxhash

    tree, n = model.tree, counts[word]
    code = int(maxent_lm.leaf_code(np.array([xxhash.xxh64_intdigest(word)], np.uint64))[0])
    by_class = collections.defaultdict(list)
    for w, c in counts.items():
        by_class[c.bit_length()].append(w)
    depth = int(tree.depth[n.bit_length()]) if n else 0
    mask = (1 << 64) - 1
    context = np.array([[one * int(maxent_lm.FIRST) & mask], [two * int(maxent_lm.SECOND) & mask], [one * int(maxent_lm.THIRD) & mask ^ two * int(maxent_lm.FIRST) & mask]], np.uint64)

    def branch(level, node, taken):
        z = tree.bias[level][node] + sum(model.weights[b[0]] for b in model.buckets(context, level, np.array([node])))
        return math.exp(z[taken] - z.max()) / np.exp(z - z.max()).sum()

    p = branch(0, 0, n.bit_length())
    prefix = 0
    for d in range(depth):
        digit = code >> 5 * (maxent_lm.DEPTH - 1 - d) & 31
        p *= branch(d + 1, n.bit_length() * 32**d + prefix, digit)
        prefix = prefix * 32 + digit
    if n:
        code_of = lambda w: int(maxent_lm.leaf_code(np.array([xxhash.xxh64_intdigest(w)], np.uint64))[0]) >> 5 * (maxent_lm.DEPTH - depth)
        p *= n / sum(counts[w] for w in by_class[n.bit_length()] if code_of(w) == prefix)
    return p


def test_language_model_is_a_distribution_and_learns_contexts(spark):
    """Scores are the sums of probabilities that sum to 1 in each context; held-out texts are
    likelier than by counts alone."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    blocks, model = maxent_lm.fit(docs)
    got = {r["id"]: r for r in maxent_lm.score_blocks(blocks, model, "bigint").collect()}
    texts = {r["doc_id"]: [w.encode() for w in words_of(lower(r["text"]))] + [b" "] for r in docs.collect()}
    counts = collections.Counter(w for i, t in texts.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in t)
    digest, before = xxhash.xxh64_intdigest, int(maxent_lm.BEFORE)
    short = sorted(texts, key=lambda i: len(texts[i]))[::30]
    for i in short[:5]:
        t, total = texts[i][:], 0.0
        for k, w in enumerate(t):
            one, two = (digest(t[k - 1]) if k else before), (digest(t[k - 2]) if k > 1 else before)
            total += math.log10(plain_probability(model, counts, w, one, two))
        assert math.isclose(got[i]["score"], total, rel_tol=1e-4)
    some = texts[short[-1]]
    few = collections.Counter({w: c for w, c in counts.items() if c > 15})
    for one, two in ((before, before), (digest(some[1]), digest(some[0]))):
        known = sum(plain_probability(model, counts, w, one, two) for w in list(few)[:40])
        assert 0 < known < 1
    flat = maxent_lm.Model(model.tree, np.zeros_like(model.weights))
    plain = {r["id"]: r["score"] for r in maxent_lm.score_blocks(blocks, flat, "bigint").collect()}
    held = [i for i in got if got[i]["held_out"]]
    assert sum(got[i]["score"] for i in held) > sum(plain[i] for i in held)


def test_softmaxes_sum_to_one_over_all_words():
    """All known words of a small vocabulary, and the unknown, in random contexts."""
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 63, 700).astype(np.uint64)
    counts = np.concatenate([np.ones(400), rng.integers(2, 9, 250), rng.integers(100, 5000, 50)]).astype(np.int64)
    classes, codes = maxent_lm.token_class(counts).astype(np.int64), maxent_lm.leaf_code(words)
    leaves, at = np.unique(classes << maxent_lm.DEPTH * maxent_lm.DIGIT | codes, return_inverse=True)
    tree = maxent_lm.Tree(leaves, np.bincount(at), np.bincount(at, counts).astype(np.int64), np.bincount(maxent_lm.token_class(counts - 1), counts, maxent_lm.WAYS))
    model = maxent_lm.Model(tree, rng.normal(size=(1 << 14, maxent_lm.WAYS)).astype(np.float32))
    for _ in range(3):
        context = np.repeat(rng.integers(0, 1 << 63, (3, 1)).astype(np.uint64), 701, axis=1)
        logs = model.log_probabilities(context, np.append(classes, 0), np.append(codes, 0))
        assert math.isclose(np.exp(logs + np.log(np.append(tree.share(counts, classes, codes), 1.0))).sum(), 1, rel_tol=1e-4)
    before = logs
    seen = np.zeros(1 << 14)
    for _ in range(20):
        model.step(context[:, :50], classes[-50:], codes[-50:], seen)
    assert model.log_probabilities(context[:, :50], classes[-50:], codes[-50:]).mean() > before[-51:-1].mean()


def test_language_model_tasks_hold_few_blocks(spark, monkeypatch):
    """Blocks lie in row groups of their own, so that a reader's vectors hold one of them, and
    go to Python in batches of bounded bytes."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    from docloom.llm.common import small_batches

    monkeypatch.setattr(maxent_lm, "BLOCK_CHARS", 20_000)
    blocks, _ = maxent_lm.fit(spark.read.parquet(f"{DATA}/documents.parquet"))
    files = [pq.ParquetFile(f.removeprefix("file:")).metadata for f in blocks.inputFiles()]
    assert sum(m.num_rows for m in files) == sum(m.num_row_groups for m in files) > len(files)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["rows"])

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    with small_batches(spark, 2_000_000):
        rows = spark.range(0, 12, 1, 1).select(F.repeat(F.lit("x"), 1_000_000).alias("x")).mapInArrow(sizes, "rows bigint").collect()
    assert sum(r["rows"] for r in rows) == 12 and max(r["rows"] for r in rows) <= 3 and spark.conf.get(name) == before


def test_language_model_edges(spark, corpus):
    assert maxent_lm.score_corpus(corpus[0]).count() == len(corpus[1])
    assert maxent_lm.score_corpus(empty(spark)).count() == 0


# --- 7


def test_packing_round_trip(spark, corpus):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    df = corpus[0].where("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(spark.read.parquet(f"{DATA}/documents.parquet").select((F.col("doc_id") + 1000).alias("doc_id"), "text", "lang", "source", "n_chars"))
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in packing.pack_documents(df, path).collect():
        pieces[r["id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    texts = {r["doc_id"]: r["text"] for r in df.collect()}
    assert set(pieces) == set(texts)
    for key, text in texts.items():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for p in sorted(pieces[key], key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)
    padding = total = 0
    for members in sequences.values():
        at = 0
        for p in sorted(members, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 2048
        total, padding = total + at, padding + (0 if at & (at - 1) == 0 else 2048 - at)
    assert padding / total < 0.01
    assert packing.pack_documents(empty(spark), path).count() == 0
    assert packing.pack_documents(corpus[0], path).agg(F.sum("length")).first()[0] > 0


# --- 8


def brute_fingerprint(text, n):
    w = words_of(lower(text))
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + n]).encode(), 42) for i in range(max(1, len(w) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(keys, linked):
    root = {k: k for k in keys}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[:i]:
            if linked(a, b):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {k: top(k) for k in keys}


def test_simhash_groups(spark):
    df = spark.read.parquet(f"{DATA}/documents.parquet")
    df = df.unionByName(df.where("doc_id < 30").select((F.col("doc_id") + 10_000).alias("doc_id"), F.concat("text", F.lit(" more")).alias("text"), "lang", "source", "n_chars")).unionByName(spark.createDataFrame([(20_000, None, "en", "a", 0), (20_001, "", "en", "a", 0), (20_002, "One", "en", "a", 0)], DOCS))
    fps = {r["doc_id"]: brute_fingerprint(r["text"], 4) for r in df.collect()}
    want = components(sorted(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 4)
    got = {r["id"]: (r["fp"] & (1 << 64) - 1, r["component"]) for r in simhash.simhash_groups(df).collect()}
    assert got == {k: (fps[k], want[k]) for k in fps}
    assert simhash.simhash_groups(empty(spark)).count() == 0


def test_crowded_shards_lose_no_link(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(6)]
    values = sorted({b ^ sum(1 << i for i in rng.sample(range(64), rng.randint(0, 3))) for b in base for _ in range(60)})
    df = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp bigint")
    rows = simhash.shards(df, 4, limit=8, splits=2).collect()
    together = collections.defaultdict(set)
    for r in rows:
        together[r["shard"]].add(r["fp"] & (1 << 64) - 1)
    met = {frozenset((a, b)) for g in together.values() for a in g for b in g if a < b}
    assert all(frozenset((a, b)) in met for i, a in enumerate(values) for b in values[:i] if (a ^ b).bit_count() <= 4)


def test_tree_search():
    rng = random.Random(1)
    tree, values = simhash.BKTree(), []
    for _ in range(300):
        v = rng.choice(values) ^ (1 << rng.randrange(64)) if values and rng.random() < 0.7 else rng.getrandbits(64)
        assert {values[i] for i in tree.within(v, 4)} == {x for x in values if (x ^ v).bit_count() <= 4}
        if v not in values:
            values.append(v)
            tree.add(v)


# --- 9


def test_phrase_fingerprints(spark, corpus):
    rows = [r for r in corpus[1] if r[0] is not None]
    rows = list({r[0]: r for r in rows}.values())
    df = spark.createDataFrame(rows, DOCS)
    order = sorted(rows, key=lambda r: -r[0])
    follows = {r[0]: order[(i + 1) % len(order)][1] or "" for i, r in enumerate(order)}
    got = {r["id"]: r for r in phrase_fingerprint.fingerprint_documents(df).collect()}
    prints = {}
    for key, text, *_ in rows:
        text, half = text or "", len(text or "") // 2
        edited = text[: len(text) - half] + follows[key][:half]
        r = got[key]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        sig = phrase_fingerprint.signature
        a, b, c = (sig(phrase_fingerprint.lz_phrases(t)) for t in (text, edited, follows[key]))
        assert (r["fingerprint"], r["edited_fingerprint"]) == (phrase_fingerprint.signature_text(a), phrase_fingerprint.signature_text(b))
        assert (r["near_edited"], r["near_next"]) == (phrase_fingerprint.likeness(a, b), phrase_fingerprint.likeness(a, c))
        assert prints.setdefault(text, r["fingerprint"]) == r["fingerprint"]
    assert got[4]["fingerprint"] == got[5]["fingerprint"]
    assert phrase_fingerprint.fingerprint_documents(corpus[0]).count() == len(corpus[1])
    assert phrase_fingerprint.fingerprint_documents(empty(spark)).count() == 0
    named = df.withColumn("doc_id", F.format_string("k%06d", "doc_id"))
    texts = {f"k{k:06d}": v for k, v in got.items()}
    for r in phrase_fingerprint.fingerprint_documents(named).collect():
        assert (r["near_next"], r["edited_sha256"]) == (texts[r["id"]]["near_next"], texts[r["id"]]["edited_sha256"])
    one = phrase_fingerprint.fingerprint_documents(df.where("doc_id = 3")).first()
    assert one["near_next"] == 1.0


# --- 10


def test_mix_meets_targets_and_caps(spark, corpus):
    mixed = source_mix.mix_sources(corpus[0].withColumn("target", F.lit("mine"))).collect()
    assert len(mixed) == len(corpus[1])
    by = collections.defaultdict(list)
    for r in mixed:
        assert r["size"] == len(words_of(r["text"])) and r["taken"] <= 2 * r["size"]
        by[r["source"]].append(r)
    for members in by.values():
        assert members[0]["source_size"] == sum(r["size"] for r in members)
        assert abs(sum(r["taken"] for r in members) - members[0]["target"]) <= 1
        assert members[0]["target"] <= 2 * members[0]["source_size"] + 1e-6
    again = source_mix.mix_sources(corpus[0].repartition(3))
    key = lambda r: (str(r["doc_id"]), r["taken"])
    assert sorted(map(key, mixed)) == sorted(map(key, again.collect()))
    repeated = source_mix.repeat_documents(source_mix.mix_sources(corpus[0])).collect()
    assert sum(len(words_of(r["text"])) for r in repeated) == sum(r["taken"] for r in mixed)
    assert source_mix.mix_sources(empty(spark)).count() == 0


def test_few_held_out_documents_reject_no_clean_language(spark):
    """Languages with one and with five held-out documents lose few clean ones."""
    rng = random.Random(8)
    vocabulary = {lang: [lang + "".join(rng.choice("abcdefgh") for _ in range(3)) for _ in range(60)] for lang in ("en", "xa", "xb")}
    text = lambda lang: " ".join(rng.choices(vocabulary[lang], k=rng.randint(20, 120)))
    rows = [(i, text("en"), "en", "s", 0) for i in range(800)]
    rows += [(1000 + i, text("xa"), "xa", "s", 0) for i in range(200)] + [(2000 + i, text("xb"), "xb", "s", 0) for i in range(200)]
    docs = spark.createDataFrame(rows, DOCS)
    half = {r["id"] for r in spark.range(3000).where(F.pmod(F.xxhash64("id"), F.lit(2)) == 0).collect()}
    held = [i for i in range(1000, 2200) if i not in half]
    labelled = [*range(800), *[i for i in held if i < 1200][:1], *[i for i in held if i >= 2000][:5]]
    labels = spark.createDataFrame([(i, 1, 0) for i in labelled], "doc_id bigint, quality int, toxic int")
    kept = collections.Counter(r["lang"] for r in quality_classifier.classify(docs, labels).where("keep").collect())
    assert kept["xa"] >= 180 and kept["xb"] >= 190 and kept["en"] >= 780


def test_fingerprints_follow_shifted_content():
    """What is put before a text without spaces, or of many lines, changes little of it."""
    rng = random.Random(2)
    solid = "".join(rng.choice("abcdefghijklmnop") for _ in range(4000))
    lines = "\n".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(1500))
    for text in (solid, lines):
        a, b = (phrase_fingerprint.signature(phrase_fingerprint.lz_phrases(t)) for t in (text, "x" + text))
        assert phrase_fingerprint.likeness(a, b) > 0.6
    assert phrase_fingerprint.lz_phrases("a" * 20_000)


def test_null_ids_follow_in_buckets(spark, monkeypatch):
    """Many null ids are dealt to buckets of their own and still follow one another."""
    monkeypatch.setattr(phrase_fingerprint, "ROWS_PER_BUCKET", 8)
    rows = [(i, f"text {i}") for i in range(40)] + [(None, f"nameless {i}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    order = sorted([r for r in rows if r[0] is not None], key=lambda r: -r[0])
    hashed = {r["text"]: r["h"] for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
    order += sorted([r for r in rows if r[0] is None], key=lambda r: hashed[r[1]])
    want = sorted(hashlib.sha256((t[: len(t) - len(t) // 2] + order[(i + 1) % 100][1][: len(t) // 2]).encode()).hexdigest() for i, (_, t) in enumerate(order))
    assert sorted(r["edited_sha256"] for r in phrase_fingerprint.fingerprint_documents(df).collect()) == want


def test_tokenizers_that_need_white_space_are_refused():
    import public_tokenizers

    packing.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    with pytest.raises(ValueError, match="split"):
        packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
