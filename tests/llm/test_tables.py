"""Operators on embeddings and pages, the shared helpers and the pipeline."""

import html
import random
import re

import numpy as np
import pytest
from labelwright.llm import graph, host_reputation, pstable, style_tree
from labelwright.llm.queries import ORACLES, QUERIES


def test_components(spark):
    rnd = random.Random(8)
    chain = [(k, k + 1) for k in range(100, 160)]
    edges = chain + [(rnd.randrange(1000, 1400), rnd.randrange(1000, 1400)) for _ in range(250)] + [(7, 7), (None, 3)] + [(5000, 5001 + k) for k in range(300)]
    top = {}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            top.setdefault(a, a), top.setdefault(b, b)
            x, y = sorted((find(a), find(b)))
            top[y] = x
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in top}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- embeddings


def test_embeddings_against_all_pairs(spark):
    rnd = np.random.default_rng(6)
    rows = []
    for g in range(40):
        centre = rnd.standard_normal(64)
        for _ in range(int(rnd.integers(1, 12)) if g else 900):  # one group spans several blocks
            rows.append(centre + rnd.standard_normal(64) * rnd.choice([0.05, 0.15, 0.3]))
    rows += [rows[0], rows[0] * 2.5]
    vectors = [r.astype(np.float32) for r in rows]
    x = np.array(vectors, dtype=float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    linked = x @ x.T >= 0.9
    np.fill_diagonal(linked, False)
    low = np.arange(len(x))
    while True:
        new = np.minimum(low, np.where(linked, low, len(x)).min(axis=1))
        if (new == low).all():
            break
        low = new
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, label int")
    got = {r.row.vec_id: r for r in pstable.near_duplicates(df, ["vec_id"]).collect()}
    n = np.array([got[i].n_links for i in range(len(x))])
    assert (n <= linked.sum(axis=1)).all() and n.sum() >= 0.98 * linked.sum()
    assert np.mean([got[i].component_id == low[i] for i in range(len(x))]) > 0.99


def test_embedding_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, None, 1), (5, [0.0, 0.0], 1), (6, [nan, 1.0], 1), (7, [inf, 1.0], 1), (8, [], 1),
            (9, [1.0, None], 1), (10, [1.0, 0.0, 0.0], 1), (1, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (None, None, None), (12, [1e-38, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rid int")
    got = pstable.near_duplicates(df, df.columns).collect()
    assert len(got) == len(rows)
    named = {r.row.vec_id: r for r in got if r.row.vec_id is not None and r.row.vec_id != 1}
    assert [named[i].component_id for i in (2, 3, 12)] == [1, 1, 1] and named[2].n_links == 5
    for i in (4, 5, 6, 7, 8, 9, 10):
        assert (named[i].n_links, named[i].component_id, named[i].kept) == (0, i, True)
    assert sum(r.kept for r in got if r.component_id == 1) == 1
    assert pstable.near_duplicates(df.limit(0), ["vec_id"]).count() == 0


# --- urls


def test_host_reputation(spark):
    rows = [(k, f"http://{'bad' if k % 2 else 'good'}.site{k % 4}.net/en/{k}") for k in range(400)]
    rows += [(1000, None), (1001, "no scheme"), (1002, "http://EXAMPLE.org:80/es/x?q#f"), (1003, "https://www.example.org/es/"), (1004, "https://a.com/de/1"), (1005, "https://a.com"), (1006, "x://b.org/en/1")]
    pages = spark.createDataFrame([(i, u, "h", 1) for i, u in rows], "page_id long, url string, host string, n int")
    outcomes = spark.createDataFrame([(k, k % 2 == 1) for k in range(400)] + [(5, None), (5, True)], "page_id long, bad boolean")
    got = {r.row.page_id: r for r in host_reputation.judge(pages, outcomes).collect()}
    assert all(got[k].verdict == ("block" if k % 2 else "allow") for k in range(400))
    assert (got[1000].host, got[1000].path, got[1001].host) == ("", "", "")
    assert (got[1002].host, got[1002].path, got[1002].rule) == ("example.org:80", "/es/x", None)
    assert [(got[i].rule, got[i].verdict) for i in (1003, 1004, 1006)] == [("example.org/es/", "block"), ("com/de/", "block"), ("org/", "allow")]
    assert got[1005].rule is None
    assert host_reputation.judge(pages.limit(0), outcomes).count() == 0
    assert {r.verdict for r in host_reputation.judge(pages.where("page_id < 9"), outcomes.limit(0), []).collect()} == {"allow"}


def test_host_reputation_sql(spark, sf_dir, duck):
    from compare import compare

    assert compare(spark, duck, "op2", QUERIES["op2_host_reputation"], ORACLES["op2_host_reputation"], sf_dir).startswith("ok")


# --- pages


def test_articles_of_the_pages(spark, sf_dir):
    got = {r.page_id: r for r in QUERIES["op8_style_tree"](spark, sf_dir).collect()}
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)(</article>|\Z)", r.html, re.S).group(1)
        want = " ".join(html.unescape(re.sub(r"</?b>", "", re.sub(r"</?(p|br|h1)>", " ", inner))).split())
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want)


def test_style_tree(spark):
    rnd = random.Random(1)
    said = lambda: " ".join("".join(rnd.choice("abcdefg") for _ in range(6)) for _ in range(12))
    rows, want = [], {}
    for k in range(20):
        body = [said() for _ in range(3)]
        rows.append((k, "http://h.net/x", f"<div class=top>Same words on every page</div><div class=text>{''.join(f'<p>{b}' for b in body)}</div><div class=tail><span>Read also</span> this</div>"))
        want[k] = " ".join(body)
    rows += [(100, "http://lonely.net/", "<div>Only <i>page</i> here &lt;ok&gt;<script>var a='<p>no</p>'</script></div><div id='comments'><p>me too</p></div>"), (101, None, None), (102, "", ""), (103, "http://h.net/y", "<p>unclosed <b>bold"), (104, "x", "<" * 2000)]
    want |= {100: "Only page here <ok>", 101: "", 102: "", 103: "unclosed bold", 104: "<" * 2000}
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, host string")
    got = {r.row.page_id: r.text for r in style_tree.extract(df, df.columns).collect()}
    assert got == want
    assert style_tree.extract(df.limit(0), ["page_id"]).count() == 0


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<nav><p>menu</nav><p>a<p>b", "a b"),
        ("<ul><li>x<li>y</ul>z", "x y z"),
        ("one<br>two <b>th</b>ree&nbsp;&amp;", "one two three &"),
        ("<table><tr><td>1<td>2<tr><td>3</table>", "1 2 3"),
        ("<p>before<form><input><p>field</form>after", "before after"),
        ("<main><header>kept title</header>text<aside>no</aside></main><div>outside</div>", "kept title text"),
        ("<div><p>The whole long text stands here.</div><article><p>teaser</article>", "The whole long text stands here. teaser"),
        ("<div class='social-science'><p>one</div><div class='share-prices'>two</div><div class='share-buttons'>no</div><p>three", "one two three"),
        ("<div class='site-nav x'>no</div><div id=top_menu2>no</div><div class='menus of paris'>yes</div>", "yes"),
        ("<div class='cookie-notice'>no<div>no</div></div>yes<footer>no", "yes"),
        ("<p title='a>b'>x</p><!-- <p>no</p> -->y", "x y"),
    ],
)
def test_blocks(page, want):
    assert " ".join(t for _, t in style_tree.blocks(page)[0]) == want


def test_deep_and_long_pages():
    deep = "<div>" * 50_000 + "here" + "<div>too" * 200
    got, shapes = style_tree.blocks(deep)
    assert " ".join(t for _, t in got) == "here" + " too" * 200
    assert max(len(p) for p, _ in got) < 1000 and max(len(p) for p, _ in shapes) < 1000
    long = "<article>" + "<p>word " * 100_000 + "</article>"
    assert len(style_tree.blocks(long)[0]) == 100_000


def test_importance_by_brute_force(spark):
    rnd = random.Random(3)
    pages = []
    for k in range(30):
        paras = "".join(f"<p>{rnd.choice('abc') if rnd.random() < 0.3 else k}{j}" for j in range(rnd.randint(1, 4)))
        extra = "<div class=tail><span>see</span> also</div>" if rnd.random() < 0.7 else ""
        pages.append((f"h{k % 2}.net" if k < 26 else "few.net", f"<body><div class=top><p>Menu</div><div class=text>{paras}</div>{extra}</body>"))
    texts, seen, shapes = {}, {}, {}
    above = lambda p: ["/".join(p.split("/")[:n]) for n in range(1, len(p.split("/")) + 1)]
    for host, page in pages:
        found, kids = style_tree.blocks(page)
        for path, text in set(found):
            texts.setdefault((host, path), {}).setdefault(text, 0)
            texts[host, path][text] += 1
        for path in {a for p, _ in found for a in above(p)}:
            seen[host, path] = seen.get((host, path), 0) + 1
        for path, k in dict.fromkeys(kids):
            shapes.setdefault((host, path), {}).setdefault(k, 0)
            shapes[host, path][k] += 1
    want = {}
    for host, path in seen:
        below = [(h, p) for h, p in texts if h == host and path in above(p) and seen[h, p] >= style_tree.MIN_PAGES]
        kinds = [(n, seen[b]) for b in below for n in texts[b].values()]
        if not kinds:
            continue
        content = sum(1 - np.log(n) / np.log(m) for n, m in kinds) / len(kinds)
        n = np.array(list(shapes.get((host, path), {}).values()), dtype=float)
        shape = content if not len(n) else 1.0 if n.sum() == 1 else float(-(n / n.sum() * np.log(n / n.sum())).sum() / np.log(n.sum()))
        want[host, path] = style_tree.CONTENT_WEIGHT * content + (1 - style_tree.CONTENT_WEIGHT) * shape
    from pyspark.sql import functions as F

    parse = F.pandas_udf("blocks array<struct<path:string,text:string>>, shapes array<struct<path:string,kids:string>>")(style_tree._parsed)
    parsed = spark.createDataFrame(pages, "host string, html string").select("host", parse("html").alias("p")).select("host", "p.*")
    got = {(r.host, r.path): r.importance for r in style_tree.importance(parsed).collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert not any(h == "few.net" for h, _ in got)


# --- pipeline


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    step = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        step = corpus_pipeline.save(stage(spark, step, sf_dir), f"test{k}")
        assert step.columns == docs.columns
        left = [r.doc_id for r in step.select("doc_id").collect()]
        assert len(left) == len(set(left)) and set(left) <= ids
        ids = set(left)
    packed = corpus_pipeline.STAGES[-1][1](spark, step, sf_dir)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == ids
    assert corpus_pipeline.run(spark, sf_dir).count() == packed.count()


def test_pipeline_near_duplicates_by_all_pairs(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sets = {}
    for r in docs.collect():
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or "")) if x]
        sets[r.doc_id] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((find(i), find(j)))
                top[y] = x
    got = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, sf_dir).select("doc_id").collect()}
    assert got == {i for i in sets if find(i) == i}


def test_pipeline_edges(spark):
    """Nulls, repeated and very long rows and columns of clashing names pass all five stages."""
    import corpus_pipeline

    rnd = random.Random(12)
    said = lambda n: " ".join("".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 9))) for _ in range(n))
    clean = [said(120) for _ in range(40)]
    huge = " ".join(clean[0].split() * 1500)  # over 1 MB
    rows = [(k, t, "en", "web", len(t)) for k, t in enumerate(clean)] + [(5, clean[5], "en", "web", len(clean[5])), (100, None, None, None, None), (None, clean[7], None, None, None)]
    rows += [(101, "", "en", "web", 0), (102, said(150_000), "en", "web", 0), (103, "\n".join([said(30)] * 3 + clean[9].split("|")), "en", "web", 0), (104, huge, "en", "web", len(huge))]
    rows = [(*r, k, "r", 1, "b") for k, r in enumerate(rows)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, rid long, row string, n int, bin string")
    step = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        step = corpus_pipeline.save(stage(spark, step, ""), f"edge{k}")
        assert step.columns == docs.columns, name
    left = [r.doc_id for r in step.collect()]
    assert {*range(40)} - {7} <= {*left} and sorted(left.count(k) for k in range(40))[-1] == 1  # one of the repeats stays
    assert 102 in left
    packed = corpus_pipeline.STAGES[-1][1](spark, step, "").collect()
    assert {r.doc_id for r in packed} == {*left}


def test_pipeline_empty(spark, nothing):
    import corpus_pipeline

    step = nothing.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        step = stage(spark, step, "")
    assert step.count() == 0
