"""Steps that must not grow faster than their tables: what is planned, and how often and where rows are dealt."""

import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalens.lineage import cut
from stratalens.operators import cells, graph, lookup, postings, rules
from stratalens.plans import catalog
from stratalens.plans.prepared import published


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_import_targets_are_not_broadcast_and_places_are_resolved_once(spark):
    rows = [("a/x.ts", "./y"), ("a/x.ts", "./y"), ("a/z.ts", "./y"), ("a/z.ts", "../b/w.js"), ("a/z.ts", "react"), ("a/z.ts", "./none")]
    imports = spark.createDataFrame(rows, "path string, source string")
    files = spark.createDataFrame([("a/y.ts",), ("a/y.tsx",), ("b/w.ts",), ("b/w.ts",)], "path string")
    got = graph.resolve_imports(imports, files)
    assert "Broadcast" not in plan(got)
    assert sorted(map(tuple, got.collect())) == [("a/x.ts", "./y", "a/y.ts"), ("a/z.ts", "../b/w.js", "b/w.ts"), ("a/z.ts", "./y", "a/y.ts")]


def test_a_cut_plan_has_the_size_of_its_rows(spark):
    state = cut(spark.range(3))
    for _ in range(5):
        other = state.withColumnRenamed("id", "k")
        state = cut(state.groupBy("id").cogroup(other.groupBy("k")).applyInPandas(lambda a, b: a, "id long"))
    assert state._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 100_000
    assert sorted(r.id for r in state.collect()) == [0, 1, 2]


def test_texts_are_dealt_once_for_their_term_counts(spark):
    docs = spark.createDataFrame([(1, "one two two"), (2, None), (1, "one two")], "doc_id long, text string")
    got = postings.term_frequencies(docs, "doc_id", F.col("text"))
    assert plan(got).count("Exchange hashpartitioning") == 1
    assert sorted(map(tuple, got.collect())) == [(1, "one", 2), (1, "two", 3)]


def test_a_frequent_value_is_published_in_several_files(spark):
    on = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(on, "false")
    try:
        rows = spark.range(20_000).select(F.lit("the").alias("term"), "id")
        got = published(spark, "frequent", "frequent", lambda: rows, "term")
        assert got.groupBy(F.input_file_name()).count().count() > 1
        assert got.count() == got.distinct().count() == 20_000
    finally:
        spark.conf.unset(on)


def test_pairs_of_one_module_are_made_in_many_tasks(spark):
    files = spark.range(200).select(F.format_string("f%d", "id").alias("path"), F.floor(F.col("id") / 1000).alias("module"))
    got = graph.module_peers(files)
    assert got.count() == got.distinct().count() == 200 * 199
    assert sum(n > 0 for n in got.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()) > 8


def test_neighbours_without_groups_meet_by_stripes(spark, monkeypatch):
    """Where few cells are not enough, rows are not sent to ever more cells, and each goes to as many tasks as there are stripes."""
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.standard_normal(32)]) for i in range(900)] + [(900 + i, [1.0] * 32) for i in range(40)] + [(940, [0.0] * 32)]
    items = spark.createDataFrame(rows, "id long, vector array<float>")
    monkeypatch.setattr(cells, "LEAST_STRIPE", 100)
    monkeypatch.setattr(cells, "_looked_up", lambda *a: pytest.fail("sent to cells"))
    got = cells.knn_cells(items, cell=20, probes=1, recall=0.99)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, graph.knn_graph(items).collect()))


def test_the_best_of_a_product_are_those_of_double_precision(monkeypatch):
    monkeypatch.setattr(cells, "COLUMN_BLOCK", 50)
    monkeypatch.setattr(cells, "HELD", 200)
    rng = np.random.default_rng(6)
    base = rng.standard_normal(16)
    w = np.concatenate([base + 1e-5 * rng.standard_normal((300, 16)), rng.standard_normal((300, 16))])  # closer than single precision tells
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    ids = np.arange(600) * 3
    got = {(int(r), int(o)) for at, other, _ in cells.top_of(w, w, ids, 4, 0.1) for r, o in zip(at, other, strict=True)}
    sims = (w @ w.T).round(10)
    assert got == {(i, int(ids[j])) for i in range(600) for j in np.lexsort((ids, -sims[i]))[:4] if sims[i, j] >= 0.1}


def test_only_heads_are_parted_into_lines(spark):
    head = "// A\n// 😀 b\n// FEATURE: x\n// summary: s\n// inputs:\n// outputs: o"
    texts = ["", "//", "// a\n// b", "// a\n// b\n", "x\n// a\n// b", "#!/bin/x", "#!/bin/x\n// a\n// b", head, head + "\n", head + "\n\n// inputs: late", head + "\nx" * 1000, "// a\r\n//b\u2028c\nx", "// \n//\n//", None]
    rows = [(f"{i}.{e}", x) for i, x in enumerate(texts) for e in ("ts", "py", "md")] + [("h.py", "#!/x\n# a\n# b\n# Feature: q\n// no\n" + "\n" * 1000)]
    files = spark.createDataFrame(rows, "path string, content string")
    got = rules.findings(files)
    assert "split(content" not in plan(got)
    want = []
    for path, text in rows:
        sign = {"ts": "//", "py": "#"}.get(path.split(".")[1])
        if sign is None or text is None:
            continue
        lines = text.split("\n")
        first = int(lines[0].startswith("#!"))
        top = [x[len(sign) :].strip(" ") for x in itertools.takewhile(lambda x: x.startswith(sign), lines[first:])]
        if len(top) < 2:
            want.append((path, first + 1, "header", "error"))
        else:
            if not any("FEATURE:" in x.upper() for x in top):
                want.append((path, first + 2, "feature-tag", "warning"))
            for name in rules.FIELDS:
                if not any(re.match(rf"{name}:\s*\S", x.lower()) for x in top):
                    row = next((i + 1 for i, x in enumerate(top) if x.lower().startswith(f"{name}:")), 1)
                    want.append((path, first + row, f"{name}-header", "warning"))
        if len(lines) > rules.MAX_LINES:
            want.append((path, rules.MAX_LINES + 1, "file-length", "warning"))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_one_name_is_looked_for_without_an_index_of_all_words(spark, sf, monkeypatch):
    monkeypatch.setattr(catalog, "published", lambda *a: pytest.fail("an index is built"))
    assert catalog.blast_radius(spark, sf).count() > 0


def test_symbols_are_dealt_before_their_tokens_and_have_each_once(spark, sf, monkeypatch):
    monkeypatch.setattr(catalog, "published", lambda spark, sf, name, build, by: build())
    assert "REPARTITION_BY_NUM" in plan(catalog.part_word_hits(spark, sf))
    symbols = spark.createDataFrame([("p", "Save all", "k", 3, "k Save all now"), ("p", "Save all", "k", 3, "other"), ("p", None, "k", 4, "x1 y1"), ("p", "z1", "k", 5, None)], "path string, name string, kind string, line long, signature string")
    files = spark.createDataFrame([], "path string, header string, content string")
    got = lookup.word_hits(symbols, files)
    assert plan(got).count("Generate inline") == 1
    rows = [(r.token, r.line, r.title, r.score) for r in got.collect()]
    want = [("save all", 3, "Save all", 1.0), ("save", 3, "Save all", 0.88), ("all", 3, "Save all", 0.88), ("k save all now", 3, "Save all", 0.74), ("now", 3, "Save all", 0.74), ("other", 3, "Save all", 0.74)]
    want += [("x1", 4, None, 0.74), ("y1", 4, None, 0.74), ("x1 y1", 4, None, 0.74), ("z1", 5, "z1", 1.0)]
    assert sorted(rows, key=str) == sorted(want, key=str)


def test_contexts_are_cut_before_they_meet(spark):
    rng = np.random.default_rng(7)
    tables, best = [], {}
    for order, fixed in enumerate((0.72, None, 0.58)):
        rows = [(f"p{rng.integers(5)}", f"r{rng.integers(12)}", float(rng.integers(40, 95)) / 100) for _ in range(200)]
        for path, related, score in rows:
            best[path, related] = max(best.get((path, related), (-1, 0)), (score if fixed is None else fixed, -order))
        tables.append((spark.createDataFrame(rows, "path string, related string, score double"), f"s{order}", fixed))
    got = graph.related_contexts(tables, 4)
    assert plan(got).count("WindowGroupLimit") >= 2 * len(tables)
    want = []
    for path in {p for p, _ in best}:
        ranked = sorted((-s, r, o) for (p, r), (s, o) in best.items() if p == path)[:4]
        want += [(path, r, -s, f"s{-o}", i + 1) for i, (s, r, o) in enumerate(ranked)]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_scores_of_files_are_made_once_and_in_many_tasks(spark, sf):
    told = plan(catalog.file_search(spark, sf))
    assert told.count("zip_with") == 1 and "REPARTITION_BY_NUM" in told


def test_vectors_of_a_search_index_are_made_once_and_in_many_tasks(spark, sf, monkeypatch):
    told, published_ = {}, catalog.published

    def publish(spark, sf, name, build, by):
        told[name] = plan(build())
        return published_(spark, sf, f"once_{name}", build, by)

    monkeypatch.setattr(catalog, "published", publish)
    assert catalog.engine_search(spark, sf).count() == 10
    assert [name for name, p in told.items() if "ascii" in p] == ["part_rows"] and "REPARTITION_BY_NUM" in told["part_rows"]


@pytest.mark.parametrize("most", [16, 2])
def test_what_the_first_cells_lack_is_found(spark, monkeypatch, most):
    """An audit asks for half of the neighbours only; rows look into all cells that may hold the others, or meet all rows where these are many."""
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.standard_normal(4)]) for i in range(1200)] + [(1200 + i, [0.0] * 4) for i in range(2)] + [(1202, [float("nan"), 1.0, 1.0, 1.0])]
    items = spark.createDataFrame(rows + [(1203 + i, rows[i][1]) for i in range(30)], "id long, vector array<double>")
    monkeypatch.setattr(cells, "MOST_PROBES", most)
    monkeypatch.setattr(cells, "_compared", lambda *a: pytest.fail("all rows were compared"))
    met, with_all = [], cells._with_all
    monkeypatch.setattr(cells, "_with_all", lambda *a: met.append(a[1]) or with_all(*a))
    got = cells.knn_cells(items, cell=20, probes=1, recall=0.5)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, graph.knn_graph(items).collect()))
    assert (sum(met) > 100) == (most == 2)


def test_cells_that_may_hold_a_neighbour():
    rng = np.random.default_rng(9)
    x, c = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (rng.standard_normal((400, 3)), rng.standard_normal((30, 3))))
    own = (x @ c.T).argmax(1)
    radii = np.array([np.arccos((x[own == j] @ c[j]).clip(-1, 1)).max(initial=-1) for j in range(30)])
    floor = np.sort(x @ x.T, axis=1)[:, -4]
    may = cells.may_hold(x, c, radii, floor)
    assert all(may[i, own[j]] for i, j in zip(*np.nonzero(x @ x.T >= floor[:, None]), strict=True))
    assert may.sum(1).mean() < 10
