"""Centroid clustering, ranked search and document fingerprints."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from labelwright.llm import phrase_fingerprint, simplex_clusters, stratified_search
from labelwright.llm.queries import ORACLES, QUERIES

# --- clusters


def test_apexes_bound_distances():
    rnd = np.random.default_rng(3)
    points = rnd.integers(-300, 300, (400, 64)) * rnd.integers(1, 20, (400, 1))
    points = np.vstack([points, points[:5], points[:1] * 1000])
    simplex = simplex_clusters.Simplex(points[:40])
    assert len(simplex.pivots) > 8
    apex = simplex.apexes(points)
    low, high = simplex_clusters.bounds(apex, apex[:40])
    true = np.sqrt(simplex_clusters.squared(points, points[:40]))
    slack = simplex.slack(apex, apex[:40])[:, None]
    assert (low <= true + slack).all() and (true <= high + slack).all()
    assert (low > 0.5 * true).mean() > 0.5  # they are of use


@pytest.mark.parametrize("scale", [1, 0.01, 3000])
def test_nearest_is_exact(scale):
    rnd = np.random.default_rng(4)
    points = np.floor(rnd.standard_normal((3000, 64)) * 256 * scale).astype(np.int64)
    centroids = np.vstack([points[:38], points[7], points[2] + 1])
    simplex = simplex_clusters.Simplex(centroids)
    apex, tops = simplex.apexes(points), simplex.apexes(centroids)
    c, d = simplex_clusters.nearest(points, apex, centroids, tops, simplex.slack(apex, tops))
    true = simplex_clusters.squared(points, centroids)
    assert (c == true.argmin(axis=1)).all() and (d == true.min(axis=1)).all()


def test_clusters_sql(spark, sf_dir, duck):
    from compare import compare

    assert compare(spark, duck, "op11", QUERIES["op11_simplex_clusters"], ORACLES["op11_simplex_clusters"], sf_dir).startswith("ok")


def test_cluster_edges(spark):
    rnd = np.random.default_rng(5)
    good = [rnd.standard_normal(64).tolist() for _ in range(30)]
    rows = [(k, v, 1, 2) for k, v in enumerate(good)] + [(3, good[3], 1, 1), (None, good[4], 1, 1), (50, None, 1, 1), (51, [], 1, 1), (52, good[0][:63], 1, 1)]
    rows += [(53, [float("nan"), *good[0][1:]], 1, 1), (54, [float("inf"), *good[0][1:]], 1, 1), (55, [None, *good[0][1:]], 1, 1), (56, [0.0] * 64, 1, 1), (57, [0.0] * 64, 1, 1)]
    rows += [(58, [500000.0] * 64, 1, 1), (59, [600000.0] * 64, 1, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cluster int, apex int")
    got = simplex_clusters.cluster(df, df.columns).collect()
    assert sorted((r.row.vec_id is None, r.row.vec_id or 0) for r in got) == [(False, k) for k in sorted([*range(30), 3, 56, 57, 58])] + [(True, 0)]
    assert sum(r.distance for r in got) == got[0].inertia and all(len(r.centroid) == 64 for r in got)
    assert simplex_clusters.cluster(df.limit(0), ["vec_id"]).count() == 0
    assert simplex_clusters.cluster(df.where("vec_id = 50"), ["vec_id"]).count() == 0
    assert {r.distance for r in simplex_clusters.cluster(df.where("vec_id in (56, 57)"), ["vec_id"]).collect()} == {0}


# --- search


def ranked(docs, items):
    """By scoring every document."""
    lower = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s or "")
    split = lambda s: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(s))
    counts = [(i, collections.Counter(split(t))) for i, t in docs]
    counts = [(i, c, sum(c.values())) for i, c in counts if c]
    n, total = len(counts), sum(x[2] for x in counts)
    df = collections.Counter(t for _, c, _ in counts for t in c)
    out = {}
    for item, text in items:
        asked = collections.Counter(split(text))
        found = []
        for i, c, size in counts:
            m = 25 + (75 * size * n) // total
            s = sum(k * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, k in asked.items() if t in c)
            if s > 0:
                found.append((-s, i))
        out[item] = [(i, -s) for s, i in sorted(found)[:10]]
    return out


def test_terms():
    text = "Ab-c_9éÉ  x\x7fy\x00z"
    assert [t.decode() for t in stratified_search.terms(text)] == re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text.replace("A", "a"))


def test_search_by_brute_force(spark, monkeypatch):
    rnd = random.Random(2)
    words = ["w%d" % int(300 * rnd.random() ** 3) for _ in range(4000)]
    docs = [(k, " ".join(rnd.choices(words, k=rnd.choice([3, 20, 20, 20, 21, 200])))) for k in range(900)] + [(1000 + k, "w1 W2 w3 w1") for k in range(300)]
    items = [(k, " ".join(rnd.choices(words, k=rnd.randint(1, 30)))) for k in range(60)] + [(99, "w1 w2 w3"), (100, "nobody")]
    monkeypatch.setattr(stratified_search, "SEGMENT", 150)  # many segments of one stratum
    monkeypatch.setattr(stratified_search, "BLOCK", 200)  # several blocks of queries
    want = ranked(docs, items)
    got = collections.defaultdict(list)
    out = stratified_search.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string"), ["item_id"])
    for r in sorted(out.collect(), key=lambda r: r.rank):
        got[r.row.item_id].append((r.doc_id, r.score))
    assert dict(got) == {k: v for k, v in want.items() if v}
    assert [i for i, _ in got[99]] == list(range(1000, 1010))  # ties by doc_id


def test_search_sql(spark, sf_dir, duck):
    from compare import compare

    assert compare(spark, duck, "op12", QUERIES["op12_stratified_search"], ORACLES["op12_stratified_search"], sf_dir).startswith("ok")


def test_search_edges(spark, edge, nothing):
    items = spark.createDataFrame([(1, "quick brown FOX", 1, "a"), (1, "quick brown FOX", 1, "a"), (2, None, 1, "a"), (3, " -- ", 1, "a"), (None, "x" * 20000, 1, "a"), (4, "word " * 9, 1, None)], "item_id long, text string, m int, terms string")
    got = stratified_search.search(edge, items, items.columns).collect()
    places = collections.defaultdict(list)
    for r in got:
        places[r.row.item_id].append(r["rank"])
    assert set(places) == {1, None, 4} and places[None] == [1]  # the 20,000 letters are one term of one document
    assert len(places[1]) % 2 == 0 and set(collections.Counter(places[1]).values()) == {2}  # a repeated item is ranked twice
    assert all(r.score > 0 for r in got)
    assert stratified_search.search(nothing, items, ["item_id"]).count() == 0
    assert stratified_search.search(edge, items.limit(0), ["item_id"]).count() == 0


# --- fingerprints

MASK = (1 << 64) - 1


def plain_mix(x):
    x ^= x >> 32
    x = x * int(phrase_fingerprint.SEED) & MASK
    x ^= x >> 29
    x = x * int(phrase_fingerprint.RUN) & MASK
    return x ^ (x >> 32)


def plain_level(x):
    """Phrases of one text, symbol by symbol."""
    runs = []
    for s in x:
        if runs and runs[-1][0] == s:
            runs[-1][1] += 1
        else:
            runs.append([s, 1])
    x = [s if n == 1 else plain_mix((s + int(phrase_fingerprint.RUN) * n) & MASK) for s, n in runs]

    def toss(v):
        out = []
        for k, s in enumerate(v):
            diff = s ^ v[k - 1] if k else 1
            low = (diff & -diff).bit_length() - 1
            out.append(2 * low + (s >> low & 1))
        return out

    label = toss(toss(x))
    assert all(a != b for a, b in zip(label, label[1:], strict=False))
    cuts = [0] + [k for k in range(1, len(x) - 1) if label[k - 1] < label[k] > label[k + 1]] + [len(x)]
    assert all(b - a <= phrase_fingerprint.LONGEST for a, b in zip(cuts, cuts[1:], strict=False))
    return [plain_mix((sum(s * int(phrase_fingerprint.WEIGHTS[p]) for p, s in enumerate(x[a:b])) + b - a) & MASK) for a, b in zip(cuts, cuts[1:], strict=False)]


def plain_print(text):
    x, levels = [ord(c) for c in text], []
    if not x:
        return "0" * 16
    while True:
        x = plain_level(x)
        if len(levels) < phrase_fingerprint.LEVELS:
            levels.append(sorted({n >> 32 for n in x})[: phrase_fingerprint.KEEP])
        if len(x) == 1:
            return "-".join([f"{x[0]:016x}", *("".join(f"{n:08x}" for n in lv) for lv in levels)])


def test_fingerprints_by_brute_force(spark, sf_dir, edge):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    docs.sort(reverse=True)
    want = {}
    for k, (i, t) in enumerate(docs):
        after = docs[(k + 1) % len(docs)][1] or ""
        t = t or ""
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        want[i] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), plain_print(t), plain_print(edited))
    rows = QUERIES["op13_phrase_fingerprint"](spark, sf_dir).collect()
    assert {r.doc_id: tuple(r)[1:5] for r in rows} == want and len(rows) == len(docs)
    assert all(0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1 for r in rows)
    long = [r for r in rows if r.n_chars > 100]
    assert np.mean([r.near_edited for r in long]) > 0.4 and np.mean([r.near_next for r in long]) < 0.1
    assert np.mean([r.near_edited > r.near_next for r in long]) > 0.97


def test_equal_parts_share_names():
    rnd = random.Random(1)
    said = lambda n: "".join(rnd.choice("abcdefgh ijkl mnop") for _ in range(n))
    inner = said(2000) + "zzzzzzzzzzzz" + said(2000)
    codes = [phrase_fingerprint.code_points(said(k) + inner + said(50)).astype(np.uint64) for k in (0, 1, 7, 300)]
    names = [set(phrase_fingerprint.level(c, np.array([0]))[0].tolist()) for c in codes]
    within = set(phrase_fingerprint.level(codes[0][20:3900], np.array([0]))[0].tolist())
    assert all(len(within - n) <= 4 for n in names)
    a, b, c = phrase_fingerprint.parse([phrase_fingerprint.code_points(t) for t in (inner, said(3000) + inner, said(7000))])
    assert phrase_fingerprint.likeness(a, b) > 0.5 > 0.1 > phrase_fingerprint.likeness(a, c)


def test_fingerprint_edges(spark, edge, nothing):
    got = phrase_fingerprint.fingerprints(edge, edge.columns).collect()
    assert len(got) == edge.count()
    prints = collections.defaultdict(set)
    for r in got:
        prints[r.row.text or ""].add(r.fingerprint)
        assert r.n_chars == len(r.row.text or "") and (r.fingerprint == "0" * 16) == (not r.row.text)
    assert all(len(p) == 1 for p in prints.values()) and len({min(p) for p in prints.values()}) == len(prints)
    one = phrase_fingerprint.fingerprints(edge.where("doc_id = 7"), ["doc_id"]).collect()
    assert len(one) == 1 and one[0].near_next == 1
    huge = spark.createDataFrame([(1, "a" * 1_000_000), (2, "ab" * 700_000), (3, None)], "doc_id long, text string")
    assert {r.row.doc_id: r.n_chars for r in phrase_fingerprint.fingerprints(huge, ["doc_id"]).collect()} == {1: 1_000_000, 2: 1_400_000, 3: 0}
    assert phrase_fingerprint.fingerprints(nothing, nothing.columns).count() == 0
