"""Embeddings, pages, URLs and the pipeline."""

import math
import re
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalens.llm import queries
from stratalens.llm.components import connected_components
from stratalens.llm import hnsw
from stratalens.llm.hnsw import Graph, Side, cell_links, near_vectors
from stratalens.llm.html import extract, visible_text
from stratalens.llm.url_filters import filter_urls, host, intervals, patterns


# Components


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (102, 101), (7, 7), (None, 3), (200, 300), (300, 200)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {100: 100, 101: 100, 102: 100, 200: 200, 300: 200}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


# Embeddings


def brute_links(rows):
    good = {}
    for i, v in rows:
        if v and all(c is not None and math.isfinite(c) for c in v) and any(v):
            x = np.array(v, float) / max(map(abs, v))
            good[i] = x / np.linalg.norm(x)
    near = {i: {j for j in good if j != i and len(good[i]) == len(good[j]) and good[i] @ good[j] >= 0.9} if i in good else set() for i, _ in rows}
    root = {i: i for i, _ in rows}
    while True:
        new = {i: min([root[i], *(root[j] for j in near[i])]) for i in root}
        if new == root:
            return near, root
        root = new


def vectors(n=500, dims=16, seed=0):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n // 5, dims))
    return [(i, [float(np.float32(c)) for c in base[rng.integers(len(base))] + rng.standard_normal(dims) * rng.choice([0, 0.1, 0.3])]) for i in range(n)]


def test_near_vectors(spark):
    rows = [*vectors(), (900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, []), (904, [1.0, None] * 8), (905, [1.0, 2.0]), (906, [2.0, 4.0]), (907, [1e300] * 16), (908, [1e300] * 16), (909, [float("inf")] * 16)]
    near, root = brute_links(rows)
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<double>, label int, node string")
    got = {r.vec_id: r for r in near_vectors(df).collect()}
    assert len(got) == len(rows)
    links = sum(len(x) for x in near.values())
    assert sum(r.n_links for r in got.values()) >= 0.98 * links and all(got[i].n_links <= len(near[i]) for i in near)
    assert sum(got[i].component_id == root[i] for i in root) >= 0.99 * len(root)
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in (900, 901, 902, 903, 904, 909))
    assert got[905].n_links == got[906].n_links == 1 and got[906].component_id == 905
    assert got[908].component_id == 907


def test_copies_and_an_empty_table(spark):
    df = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(300)] + [(300, [1.0, 0.01])], "vec_id long, embedding array<float>")
    got = near_vectors(df).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(300, 0)}
    assert near_vectors(df.where("false")).collect() == []


def grouped(groups, n, dims=64, spread=0.2, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((groups, dims))[rng.integers(groups, size=n)] + rng.standard_normal((n, dims)) * spread
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("groups", [1, 2, 3, 40])
def test_cells_count_links_at_both_ends(groups):
    x = grouped(groups, 3000)
    a, b = (Side(p, np.arange(o, o + 1500), np.ones(1500, np.int64), Graph(p.astype(np.float32))) for p, o in ((x[:1500], 0), (x[1500:], 1500)))
    between = a.x @ b.x.T >= 0.9
    counts, tree = cell_links(a, b)
    assert (counts[0] == between.sum(1)).mean() > 0.98 and (counts[1] == between.sum(0)).mean() > 0.98
    assert counts[0].sum() == counts[1].sum() >= 0.98 * between.sum()
    within = (a.x @ a.x.T >= 0.9) & ~np.eye(1500, dtype=bool)
    (own,), _ = cell_links(a, a)
    assert own.sum() >= 0.98 * within.sum() and (own <= within.sum(1)).all()


def test_every_row_is_reachable_and_graphs_survive_writing():
    x = np.concatenate([grouped(2, 900, spread=0.02), grouped(300, 1500)]).astype(np.float32)
    g = Graph(x)
    h = Graph.of_rows(x, *g.rows())
    assert all((i == j).all() and (k == m).all() for (i, k), (j, m) in zip(g.levels, h.levels, strict=True)) and (g.entries == h.entries).all()
    front, seen = np.unique(np.concatenate([g.levels[-1][0], g.entries])), np.zeros(len(x), bool)
    while front.size:
        seen[front] = True
        front = np.unique(g.levels[0][1][front])
        front = front[(front >= 0) & ~seen[front]]
    assert seen.all()


def test_a_failed_audit_is_answered_by_products(monkeypatch):
    monkeypatch.setattr(hnsw, "search", lambda x, near, q, start, beam: (np.full((len(q), beam), -1), np.full((len(q), beam), -3, np.float32)))
    monkeypatch.setattr(Graph, "__init__", lambda self, x: self.__dict__.update(x=x, entries=np.zeros(0, np.int64), levels=[(np.arange(len(x)), np.full((len(x), 28), -1))]))
    x = grouped(30, 600)
    side = Side(x, np.arange(600), np.ones(600, np.int64), Graph(x.astype(np.float32)))
    (got,), _ = cell_links(side, side)
    assert (got == (x @ x.T >= 0.9).sum(1) - 1).all()


@pytest.mark.parametrize("groups", [1, 2, 40])
def test_grouped_vectors_have_all_their_links(spark, groups):
    x = grouped(groups, 3000)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in near_vectors(df).collect()}
    want = (x @ x.T >= 0.9).sum(1) - 1
    assert sum(got.values()) >= 0.98 * want.sum() and sum(got[i] == n for i, n in enumerate(want)) >= 0.98 * len(x)


def test_vectors_without_ids(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0]), (None, [1.0, 0.001]), (5, [1.0, 0.002]), (None, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = sorted((r.vec_id or -1, r.n_links, r.kept) for r in near_vectors(df).collect())
    assert got == [(-1, 0, False), (-1, 2, False), (-1, 2, False), (5, 2, True)]


def test_embedding_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    near, root = brute_links(rows)
    got = {r.vec_id: r for r in queries.op4_hnsw(spark, sf).collect()}
    assert {i: r.n_links for i, r in got.items()} == {i: len(x) for i, x in near.items()}
    assert {i: r.component_id for i, r in got.items()} == root


# HTML


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""),
        ("", ""),
        ("plain &amp; simple", "plain & simple"),
        ("<p>a<p>b", "a\n\nb"),
        ("<div>a</div><div>b</div>", "a\nb"),
        ("a<br>b", "a\nb"),
        ("x <b>y</b>z", "x yz"),
        ("<ul><li>a<li>b<ul><li>c</ul></ul>", "- a\n- b\n  - c"),
        ("<ol start=3><li>a</li><li>b</li></ol>", "3. a\n4. b"),
        ("<table><tr><th>n<th>name<tr><td>10<td>x</table>", "n   name\n10  x"),
        ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a  b\n   c"),
        ("<p hidden>no</p><p style='display:none'>no</p><script>no</script><style>no</style>yes<!-- no -->", "yes"),
        ("<head><title>no</title></head><body>yes", "yes"),
        ("<pre>a\n  b</pre>", "a\n  b"),
        ("<select><option>a<option>b</select>", "a\nb"),
        ("<dl><dt>t<dd>d</dl>", "t\n    d"),
        ("<p>1 < 2 & 3</p", "1 < 2 & 3"),
        ("</div></p>a<table>b", "a\n\nb"),
        ("<img alt='pic'><input type=hidden value=x>", "pic"),
        ("<textarea>&lt;b></textarea>", "<b>"),
        ("<table><tr><td>a<td rowspan=2>b<tr><td>c<tr><td>d<td>e</table>", "a  b\nc\nd  e"),
        ("<table><tr><td rowspan=3>a<td>b<tr><tr><td>c</table>", "a  b\n   c"),
        ("<style>.x, p#y { display:none } @media print { .z {display:none} } /* .w {display:none} */</style><p class='x q'>no</p><p id=y>no</p><p class=z>z</p><p class=w>w</p>", "z\n\nw"),
        ("<style>div{display:none}.on{display:block}</style><div>no</div><div class=on>yes</div>", "yes"),
        ("<div style='visibility:hidden'>no<b style='visibility:visible'>yes</b>no</div>", "yes"),
        ("<p =x a=1 a=2 'y' z=>t</p ><P CLASS>u", "t\n\nu"),
    ],
)
def test_rendering(html, text):
    assert visible_text(html) == text


def test_deep_and_long_pages():
    assert visible_text("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    assert len(visible_text("<p>word</p>" * 20_000).split()) == 20_000
    assert visible_text("<" * 5000) == "<" * 5000


@pytest.mark.parametrize("tag", ["font", "span", "div"])
def test_depth_changes_no_layout(tag):
    page = "<p>foo<b>bar</b><img alt=' pic'><input value=v></p><ul><li>a<li>b<ul><li>c</ul></ul><table><tr><th>n<th>name<tr><td>10<td>x</table><pre>a\n  b</pre>"
    want = visible_text(page)
    assert "foobar" in want and "- b\n  - c" in want and "10  x" in want
    for depth in (400, 5000, 10_000):
        assert visible_text(f"<{tag}>" * depth + page) == want
    assert visible_text("<table><tr><td>" * 1500 + "x<i>y</i>") == "xy"


def test_html_query(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    rows = queries.op9_html(spark, sf).collect()
    assert len(rows) == pages.count() and all(r.text and "<p>" not in r.text and "track(" not in r.text for r in rows)
    odd = spark.createDataFrame([(1, None, "t"), (2, "", "t"), (2, "", "t")], "page_id long, html string, title string")
    assert [(r.title, r.text) for r in extract(odd).collect()] == [("", "")] * 3
    assert extract(odd.where("false")).collect() == []


class Reader(HTMLParser):
    """Visible words in order, by the standard library's parser: void and hidden elements, no layout."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.words, self.skip, self.open = [], None, []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if self.skip is None:
            if tag == "img":
                self.words += (a.get("alt") or "").split()
            if tag in ("br", "img", "input", "hr", "meta", "link", "wbr", "source", "area", "base", "col", "embed", "param", "track"):
                return
            self.open.append(tag)
            if tag in ("head", "script", "style", "template", "noscript", "iframe", "svg", "title") or "hidden" in a or "display:none" in (a.get("style") or "").replace(" ", ""):
                self.skip = len(self.open)
        elif tag not in ("br", "img", "input", "hr", "meta", "link", "wbr"):
            self.open.append(tag)

    def handle_endtag(self, tag):
        if tag in self.open:
            while self.open.pop() != tag:
                pass
            if self.skip is not None and len(self.open) < self.skip:
                self.skip = None

    def handle_data(self, data):
        if self.skip is None:
            self.words += data.split()


def test_words_of_all_pages_against_another_parser(spark):
    sf = "/root/testdata/sf0.01"
    want = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    marks = re.compile(r"-|\d+\.")
    for r in queries.op9_html(spark, sf).collect():
        reader = Reader()
        reader.feed(want[r.page_id])
        reader.close()
        words, seen = ([w for w in x if not marks.fullmatch(w)] for x in (reader.words, r.text.split()))
        assert "".join(seen) == "".join(words), r.page_id


# URLs


def test_url_parts(spark):
    urls = [("http://u:p@A.B.example.org.:80/x/y?q#f",), ("https://h",), ("nonsense",), (None,), ("http://h/",)]
    rows = spark.createDataFrame(urls, "url string").select(host(F.col("url")).alias("h"), patterns(F.col("url")).alias("p")).collect()
    assert rows[0].h == "a.b.example.org"
    assert rows[0].p == ["org", "example.org", "b.example.org", "a.b.example.org", "a.b.example.org/x/", "a.b.example.org/x/y"]
    assert (rows[1].p, rows[2].p, rows[3].p or []) == (["h"], [], []) and rows[4].p == ["h", "h/"]


def test_url_filters_as_of(spark):
    entries = spark.createDataFrame([("h.org", "block", "2024-01-10"), ("h.org", "allow", "2024-02-01"), ("h.org", "block", "2024-02-01"), ("h.org", "allow", "2024-03-01"), ("h.org/ok/", "allow", "2024-01-01"), (None, "block", "2024-01-01"), ("x", None, "2024-01-01")], "pattern string, action string, d string").select("pattern", "action", F.col("d").cast("date").alias("dated"))
    assert intervals(entries).count() == 4
    cases = [(1, "http://h.org/a", "2024-01-09", False), (2, "http://h.org/a", "2024-01-10", True), (3, "http://h.org/ok/a", "2024-01-10", False), (4, "http://w.h.org/", "2024-02-15", True), (5, "http://h.org/", "2024-03-01", False), (6, None, "2024-01-10", False), (7, "http://h.org", None, False), (8, "http://otherh.org", "2024-01-10", False)]
    captures = spark.createDataFrame([(i, u, d, "z", 1) for i, u, d, _ in cases], "page_id long, url string, d string, pattern string, action int").withColumn("fetched_at", F.col("d").cast("date"))
    got = {r.page_id: r.blocked for r in filter_urls(captures.union(captures), entries).collect()}
    assert got == {i: b for i, _, _, b in cases}
    assert filter_urls(captures.where("false"), entries).collect() == []
    assert not any(r.blocked for r in filter_urls(captures, entries.where("false")).collect())


def test_url_query_matches_sql(spark, duck, sf):
    want = duck.sql(queries.oracle_sql()["op10_url_filters"])
    got = queries.op10_url_filters(spark, sf)
    assert sorted(got.columns) == sorted(want.columns)
    at = [want.columns.index(c) for c in got.columns]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str(tuple(r[i] for i in at)) for r in want.fetchall())


# Pipeline


def test_pipeline_against_brute_force(spark, sf):
    import corpus_pipeline as pipe
    from tests.llm.test_documents import brute_components, brute_fingerprint, brute_lines, check_pack

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    cols = docs.columns
    assert [k for k, _ in pipe.STAGES] == ["quality", "line_dedup", "near_dedup", "decontamination", "packing"]
    stage = dict(pipe.STAGES)
    score = {r.doc_id: r.predicted for r in queries.op1_quality(spark, sf).collect()}
    now = {r.doc_id: r.text for r in docs.collect() if score[r.doc_id]}
    got = stage["quality"](spark, docs, sf)
    assert got.columns == cols and {r.doc_id for r in got.collect()} == set(now)
    gone = {x[:2] for x in brute_lines(now)}
    now = {i: "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone) for i, t in now.items()}
    root = brute_components({i: brute_fingerprint(t) for i, t in now.items()})
    now = {i: t for i, t in now.items() if root[i] == i}
    bench = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    now = {i: t for i, t in now.items() if not any(b in t for b in bench)}
    check_pack(pipe.run(spark, sf).collect(), now)


def test_pipeline_edges(spark, tmp_path):
    """Null and repeated ids, null, empty and long texts, repeated rows, then an empty table."""
    import corpus_pipeline as pipe

    schema = "doc_id long, text string, lang string, source string, n_chars long, extra string"
    good = "the quiet river runs along the old road toward the village and the people there keep many small gardens"
    rows = [(1, good, "en"), (1, good, "en"), (1, good + " of herbs", "en"), (None, good.upper(), "en"), (None, "another clean line of words that nobody else in this table has written down so far", "en"), (5, None, None), (6, "", "en"), (7, "w " * 30_000 + "end", "en"), (8, None, "fr")]
    bench = spark.createDataFrame([(1, "zeta eta theta iota kappa lambda mu nu xi omicron")], "item_id long, text string")
    for k, docs in enumerate((rows, [])):
        at = str(tmp_path / str(k))
        spark.createDataFrame([(i, t, g, "s", len(t or ""), "z") for i, t, g in docs], schema).write.parquet(f"{at}/documents.parquet")
        spark.createDataFrame([(i, 1, 0) for i in range(1, 9)] if docs else [], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
        bench.write.parquet(f"{at}/benchmark.parquet")
        now = spark.read.parquet(f"{at}/documents.parquet")
        for name, stage in pipe.STAGES[:-1]:
            now = stage(spark, now, at)
            assert now.columns == schema.replace(" long", "").replace(" string", "").split(", "), name
        kept = sorted((str(r.doc_id), (r.text or "")[:12]) for r in now.collect())
        out = pipe.run(spark, at).collect()
        if not docs:
            assert kept == [] and out == []
            continue
        assert ("1", good[:12]) in kept and ("None", "another clea") in kept and sum(k[0] == "7" for k in kept) == 1
        assert len({r.doc_id for r in out}) == len({k[0] for k in kept})
