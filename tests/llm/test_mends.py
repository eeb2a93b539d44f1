"""Rows told apart by text, and texts and pages that no longer take long."""

import random
import time

import numpy as np
import pytest

from stratalens.llm.decontaminate import contamination
from stratalens.llm.hnsw import BEAM, STARTS, Graph, Keys, Side, audited_beam, cell_links, near_vectors
from stratalens.llm.html import parse, visible_text
from stratalens.llm.lines import drop_repeated_lines
from stratalens.llm.quality import score_documents, train


def test_lines_of_rows_that_share_a_doc_id(make):
    again = "this line stands in both of the rows here"
    rows = [(1, f"some unique first line here\n{again}"), (1, "another text altogether of it\nonly here stands this single line of text"), (2, f"{again}\nthe second document ends so"), (None, f"{again}\nno id, first"), (None, "no id, and a line of its own here"), (None, None), (3, "")]
    got = sorted((tuple(r) for r in drop_repeated_lines(make(rows)).select("doc_id", "text").collect()), key=str)
    want = [(1, "some unique first line here"), (1, rows[1][1]), (2, "the second document ends so"), rows[3], rows[4], rows[5], rows[6]]
    assert got == sorted(want, key=str)
    twice = [(7, "the same row stands here twice in all"), (7, "the same row stands here twice in all")]
    assert [tuple(r)[:2] for r in drop_repeated_lines(make(twice)).collect()] == twice


@pytest.mark.parametrize("page", ["<a " * 333_333 + '"', '<a "x" ' * 150_000 + '"', "<a \"' " * 150_000, "<b>" * 100_000 + "</i>" * 100_000, "<b>" * 100_000 + "<tr>" * 50_000, "<b><table>" + "<i>" * 100_000 + "</b>" * 100_000, "<div>" * 150_000, "<a \"<a '" * 100_000])
def test_malformed_pages_take_linear_time(page):
    began = time.process_time()
    parse(page)
    assert time.process_time() - began < 12


def test_tags_whose_quote_stays_open_are_text():
    assert visible_text('a <b class="x>y</b> z') == 'a <b class="x>y z'
    assert visible_text("a <b class='x>'>y</b> z") == "a y z"
    assert visible_text("<ul><li>one<li>two<ul><li>deep</ul><li>three</ul>").split("\n")[0].endswith("one")


def test_dense_texts_take_linear_time(spark, make):
    """100,000 words, every one of them an anchor: windows are cut from a split text, which is made once."""
    rng = random.Random(2)
    words = ["alpha", "bravo", "charlie", "delta", "echo", "foxtrot", "golf", "hotel"]
    items = spark.createDataFrame([(i, " ".join(rng.choices(words, k=12)) + f" {i}") for i in range(12)], "item_id long, text string")
    text = lambda n: " ".join(rng.choices([*words, "7", "12"], k=n))
    contamination(make([(0, text(100))]), items).collect()
    took = []
    for n in (25_000, 100_000):
        df = make([(1, text(n))])
        began = time.time()
        contamination(df, items).collect()
        took.append(time.time() - began)
    assert took[1] < 60 and took[1] < 10 * took[0] + 5


def test_repeated_documents_do_not_widen_the_sample(spark, make):
    rows = [(i, f"good words of text {i}") for i in range(40)] + [(1, f"copy {k}") for k in range(300)] + [(2, None)] * 50
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    model = train(make(rows), labels, 10)
    assert len(model.labels) <= 10
    assert score_documents(make(rows), labels).count() == len(rows)


@pytest.mark.parametrize(("groups", "spread"), [(1, 0.33), (3, 0.25), (40, 0.25), (400, 0.25)])
def test_graphs_lose_no_link(groups, spread):
    """Shards of 750 rows, which are searched through their graphs: every link of one broad group and of parted ones."""
    rng = np.random.default_rng(4)
    base = rng.standard_normal((groups, 24))
    x = base[rng.integers(groups, size=1500)] + spread * rng.standard_normal((1500, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)

    def side(lo, hi):
        part = x[lo:hi].astype(np.float32)
        return Side(x[lo:hi], np.arange(lo, hi), np.ones(hi - lo, np.int64), Graph.of_rows(part, *Graph(part).rows()[:2], np.array(Graph(part).rows()[2])))

    a, b = side(0, 750), side(750, 1500)
    assert 8 * BEAM <= len(a)  # or the graph is not asked
    got = sum(int(n.sum()) for pair in ((a, a), (a, b), (b, b)) for n in cell_links(*pair, 0.9)[0])
    assert got == int((x @ x.T >= 0.9).sum()) - 1500


def test_vectors_through_graphs_against_brute_force(spark):
    """Over 128 rows in each of the six shards: the query's operator, its links counted by all pairs."""
    rng = np.random.default_rng(6)
    base = rng.standard_normal((150, 16))
    x = base[rng.integers(150, size=1500)] + 0.2 * rng.standard_normal((1500, 16))
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    root = np.arange(len(x))
    while True:
        new = np.array([root[row].min() for row in near])
        if (new == root).all():
            break
        root = new
    assert got == {i: (int(near[i].sum()) - 1, int(root[i])) for i in range(len(x))}


def unlike(n, dims=64, seed=0):
    x = np.random.default_rng(seed).standard_normal((n, dims))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_beams_do_not_grow_with_a_graph_of_unlike_vectors():
    """The levels alone lead past rows that have no others near them, so beams were doubled until an audit found them."""
    x = unlike(20_000)
    side, of = (Side(v, np.arange(len(v)), np.ones(len(v), np.int64), Graph(v.astype(np.float32))) for v in (x, unlike(1500, seed=1)))
    assert audited_beam(side, of, 0.9) == BEAM


@pytest.mark.parametrize("dims", [2, 64])
def test_keys_give_rows_near_a_query(dims):
    x = unlike(3000, dims)
    x[100:400] = x[100]  # crowded keys
    off = unlike(3000, dims, seed=2)
    off -= np.einsum("nd,nd->n", off, x)[:, None] * x
    q = 0.9 * x + np.sqrt(0.19) * off / np.linalg.norm(off, axis=1, keepdims=True)
    got = Keys(x.astype(np.float32)).near(q.astype(np.float32))
    assert got.shape == (3000, STARTS) and (got >= -1).all() and (got < 3000).all()
    assert all(len(set(row[row >= 0])) == (row >= 0).sum() for row in got[:500])
    if dims == 64:
        assert (got == np.arange(3000)[:, None]).any(1)[400:].mean() > 0.99
