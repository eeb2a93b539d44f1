"""Word and gram positions, posting blocks and vector cells against the scans that they replace."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalens.functions import vectors
from stratalens.operators import blockmax, cells, graph, lookup, positions, postings, ranking, retrieval
from stratalens.plans.prepared import published

CODE = [
    "function save(x) { return save_all(x) }", "const y = save (1) + save(2); // resave", "save", "a.save\t(b)", "export class save {", "func (r *T) save() error {", "typedef save", "saveé sáve save",
    "", "no", "$save and foo.bar(1)", "foo . bar foo.barx xfoo.bar foo.bar", "operator==(a)", "foo  .bar", "UPPER Save SAVE", None,
]


@pytest.fixture(scope="module")
def lines(spark):
    rng = random.Random(1)
    rows = [(f"src/{i % 7}/f{i % 23}.ts", i, rng.choice(CODE)) for i in range(300)]
    return spark.createDataFrame(rows, "path string, line int, content string")


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


@pytest.mark.parametrize("name", ["save", "foo.bar", "$save", "operator==", "==", "absent", "SAVE", "foo"])
@pytest.mark.parametrize("call", [False, True])
def test_blast_radius_equals_the_scan(lines, name, call):
    words = positions.word_positions(lines)
    cols = ["path", "usages", "context", "total", "files", "low_usage"]
    for defined in (None, "src/0/f0.ts", "src/1/f1.ts", "nowhere"):
        assert rows(positions.blast_radius(words, lines, name, defined, call), *cols) == rows(retrieval.blast_radius(lines, name, defined, call), *cols)


def test_call_sites_equal_the_scan(spark, lines):
    symbols = spark.createDataFrame([(1, "save"), (2, "foo.bar"), (3, "absent"), (4, "$save"), (5, "=="), (6, None)], "symbol_id int, name string")
    words = positions.word_positions(lines)
    cols = ["symbol_id", "path", "line", "keyword_score", "total", "rank"]
    assert rows(positions.call_sites(symbols, words, lines, "save return", 4), *cols) == rows(retrieval.call_sites(symbols, lines, "save return", 4), *cols)
    q, v = vectors.mock_embed("save"), vectors.mock_vector(F.col("content"))
    got = positions.call_sites(symbols, words, lines, "save return", 3, q, v)
    assert rows(got, *cols, "score") == rows(retrieval.call_sites(symbols, lines, "save return", 3, q, v), *cols, "score")


def scanned(df):
    """Rows that the scans of an executed frame gave out."""
    plan, found = df._jdf.queryExecution().executedPlan(), []
    df.collect()
    stack = [plan]
    while stack:
        p = stack.pop()
        if "AdaptiveSparkPlan" in p.nodeName():
            p = p.executedPlan()
        if p.nodeName().startswith("Scan parquet"):
            found.append(int(p.metrics().apply("numOutputRows").value()))
        for i in range(p.children().size()):
            stack.append(p.children().apply(i))
        if hasattr(p, "plan") and "QueryStage" in p.nodeName():
            stack.append(p.plan())
    return found


def test_usages_push_the_word_and_scan_no_files(spark, lines, tmp_path):
    many = lines.withColumn("content", F.concat_ws(" ", "content", F.array_join(F.transform(F.sequence(F.lit(1), F.lit(40)), lambda i: F.concat(F.lit("w"), F.pmod(F.xxhash64(i, F.col("line")), F.lit(100_000)).cast("string"))), " ")))
    words = published(spark, str(tmp_path), "test_words", lambda: positions.word_positions(many), "word")
    df = positions.usage_lines(words, many, "save")
    plan = df._jdf.queryExecution().toString()
    assert "EqualTo(word,save)" in plan and "Scan parquet" in plan and "content" not in plan


def test_grams_equal_contains(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choices("abAB/.é", k=rng.randrange(12))) for _ in range(400)] + ["aaaaaaa", "aaaabaaa", "ab", "a"]
    df = spark.createDataFrame([(t,) for t in texts], "path string")
    grams = positions.gram_positions(df)
    for q in ["a", "ab", "aba", "abab", "aaaa", "aaaaaaa", "É", "b/a", "ab/.a", "zzz", "aaaab"]:
        want = {t for t in texts if q.lower() in t.lower()}
        assert {r.id for r in positions.holding(grams, q).collect()} == want, q
    paths = spark.createDataFrame([(p,) for p in ("src/Auth/login.ts", "src/auth", "lib/authTest.py", "docs/a.md", "x")], "path string")
    for q in ["auth", "src/auth", "SRC/AUTH ", "ts", "login", "none", "x"]:
        assert rows(positions.lookup_path(paths, positions.gram_positions(paths), q, 3), "path") == rows(lookup.lookup_path(paths, q, 3), "path")


def test_gram_scan_stays_flat(spark, tmp_path):
    """A hundred times the paths: the rows read for one query do not grow with them."""
    read = []
    for n in (300, 30_000):
        paths = spark.range(n).select(F.concat(F.lit("src/"), F.sha2(F.col("id").cast("string"), 256)).alias("path")).unionByName(spark.createDataFrame([("lib/qqzqq.ts",)], "path string"))
        where = str(tmp_path / f"grams{n}")
        positions.gram_positions(paths).repartitionByRange(8, "gram").sortWithinPartitions("gram").write.option("parquet.block.size", 1 << 16).option("parquet.page.row.count.limit", 500).parquet(where)
        found = positions.holding(spark.read.parquet(where), "qqzqq")
        read.append(sum(scanned(found)))
        assert [r.id for r in found.collect()] == ["lib/qqzqq.ts"]
    assert read[1] <= max(4 * read[0], 20_000)


def test_find_hub_equals_the_scan(spark):
    hubs = spark.createDataFrame([("hubs/auth-flow.md", "Auth flow"), ("hubs/auth.md", "Login"), ("hubs/b.md", "The AUTH"), ("hubs/c.md", None)], "hub string, title string")
    for q in ["auth", "AUTH ", "login", "hubs/b.md", "flow", "zz", "a"]:
        assert rows(positions.find_hub(hubs, positions.hub_grams(hubs), q), "hub", "title") == rows(ranking.find_hub(hubs, q), "hub", "title")


# Posting blocks


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(4)
    common = [f"w{i}" for i in range(60)]
    texts = []
    for i in range(900):
        words = rng.choices(common, k=rng.randint(3, 30))
        if i // 16 % 9 == 0:  # rare words lie together
            words += ["needle"] * rng.randint(0, 4) + ["thread"] * rng.randint(0, 2)
        texts.append((i, f"p{i % 40}/{i}", " ".join(words) + (" needle thread" if i % 31 == 0 else "")))
    docs = spark.createDataFrame(texts, "id long, path string, lexical_text string").withColumn("vector", vectors.mock_vector(F.col("lexical_text")))
    return docs.cache(), postings.term_frequencies(docs, "id", F.col("lexical_text")).cache()


@pytest.mark.parametrize("query", ["needle thread", "w1", "w1 w2 needle", "absent", "w3 w4 w5 w6 w7", "needle"])
@pytest.mark.parametrize("k", [1, 10])
def test_block_search_equals_hybrid_search(corpus, query, k):
    docs, posted = corpus
    blocks = blockmax.posting_blocks(posted, F.floor(F.col("id") / 16).cast("long")).cache()
    cols = ["id", "score", "lexical_score", "semantic_score", "matched_terms"]
    for v, w in ((vectors.mock_embed(query), 0.68), (None, 0.0)):
        got = blockmax.hybrid_search(blocks, docs, query, v, k, w, 0.32)
        assert rows(got, *cols) == rows(retrieval.hybrid_search(posted, docs, query, v, k, w, 0.32), *cols)
    n = blockmax.block_counts(blocks, query, retrieval.width(k)).first()
    assert n.blocks == n.read + n.skipped and n.first <= n.blocks


def test_blocks_are_skipped(corpus):
    docs, posted = corpus
    blocks = blockmax.posting_blocks(posted, F.floor(F.col("id") / 16).cast("long"))
    n = blockmax.block_counts(blocks, "needle thread w1", 20).first()
    assert n.skipped >= n.blocks // 3 and n.first < n.read
    with pytest.raises(Exception, match="posting without document"):
        blockmax.top_candidates(blocks, docs.where("id > 31"), "needle thread", 20).collect()


# Vector cells


def clustered(n, groups, dims=12, seed=0, copies=0):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((groups, dims))
    out = [(i, [float(x) for x in base[rng.integers(groups)] + 0.25 * rng.standard_normal(dims)]) for i in range(n)]
    return out + [(n + i, out[0][1]) for i in range(copies)] + [(n + copies, [0.0] * dims), (n + copies + 1, [0.0] * dims)]


def test_cells_equal_the_exact_graph_in_parted_groups(spark):
    """Groups far apart lie in cells of their own, and 300 copies of one vector meet only their least ids."""
    items = spark.createDataFrame(clustered(1500, 25, copies=300), "id long, vector array<double>").repartition(5)
    want = graph.knn_graph(items)
    got = cells.knn_cells(items, cell=60, probes=4, recall=1.0)
    assert rows(got, "id", "related", "score") == rows(want, "id", "related", "score")


def test_cells_reach_their_recall_or_become_exact(spark):
    """Vectors without groups: near cells are not enough, so the audit asks for more."""
    rng = np.random.default_rng(3)
    items = spark.createDataFrame([(f"v{i:04}", [float(x) for x in rng.standard_normal(6)]) for i in range(1200)], "id string, vector array<double>")
    want = set(rows(graph.knn_graph(items), "id", "related"))
    got = set(rows(cells.knn_cells(items, cell=40, probes=1, recall=0.95), "id", "related"))
    assert len(got & want) >= 0.93 * len(want)
    assert set(rows(cells.knn_cells(items, cell=100, probes=1, recall=1.01), "id", "related")) == want
    assert rows(cells.knn_cells(items.limit(100)), "id", "related") == rows(graph.knn_graph(items.limit(100)), "id", "related")
