"""The engine on a small source tree: build, lookups, searches, validation and failure."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalens.operators import clusters, graph, retrieval, rules
from stratalens.plans.engine import Engine
from stratalens.plans.generations import validate
from stratalens.sources import files as tree
from stratalens.sources import structure
from stratalens.streaming import changes

TREE = {
    ".gitignore": "ignored/\n*.log\n!keep.log\n",
    "src/auth/jwt.ts": "// Token signing\n// FEATURE: Auth\n\nexport function verifyToken(t: string) {\n  return t.length > 1;\n}\n\nexport const SECRET = 'x';\n",
    "src/auth/session.ts": "// Sessions\n// FEATURE: Auth\n\nimport { verifyToken } from './jwt.js'\n\nexport class Session {\n  open(t) {\n    return verifyToken(t);\n  }\n}\n",
    "src/search/search.ts": "// Search\n// FEATURE: Search\nimport { Session } from '../auth/session'\n\nexport function runSearch(q) {\n  const s = new Session();\n  return verifyToken(q);\n}\n",
    "py/tool.py": "# Tool\n# FEATURE: Tool\nimport os\nfrom re import compile as c\n\nclass Greeter:\n    def greet(self, name):\n        return shout(name)\n\n\ndef shout(x):\n    return x.upper()\n",
    "go/main.go": 'package main\n\nimport (\n\t"fmt"\n\t"net/http"\n)\n\nfunc Serve() {\n\tfmt.Println(1)\n}\n',
    "rs/lib.rs": "use std::io::{Read, Write};\npub struct Pool {}\npub fn start() {}\n",
    "docs/auth.md": "# Auth hub\n\nSee [[src/auth/jwt.ts|tokens]] and [[src/auth/session.ts]] @linked-to [[search]]\n",
    "py/__init__.py": "# Package\n",
    "notes.txt": "plain words about tokens\n",
    "ignored/x.ts": "export function hidden() {}\n",
    "a.log": "x",
    "node_modules/m/index.js": "function no() {}\n",
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("tree")
    for name, content in TREE.items():
        p = top / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(content)
    return str(top)


@pytest.fixture(scope="module")
def engine(spark, root, tmp_path_factory):
    e = Engine(spark, str(tmp_path_factory.mktemp("store")))
    assert e.index(root) == []
    return e


def col(df, name="path"):
    return [r[name] for r in df.collect()]


def test_tree_listing(spark, root):
    got = sorted(col(tree.read_tree(spark, root)))
    assert got == ["docs/auth.md", "go/main.go", "notes.txt", "py/__init__.py", "py/tool.py", "rs/lib.rs", "src/auth/jwt.ts", "src/auth/session.ts", "src/search/search.ts"]
    assert sorted(col(tree.read_tree(spark, root, depth=1))) == ["notes.txt"]
    assert tree.read_tree(spark, root + "/missing").count() == 0


def test_symbols(engine):
    s = {(r.path, r.name, r.kind, r.parent_name) for r in engine.store.table("symbols").collect()}
    assert ("py/tool.py", "greet", "function", "Greeter") in s
    assert ("src/auth/jwt.ts", "verifyToken", "function", None) in s
    assert ("src/auth/session.ts", "open", "method", "Session") in s
    assert {("go/main.go", "Serve", "function", None), ("rs/lib.rs", "Pool", "struct", None), ("rs/lib.rs", "start", "function", None)} <= s
    assert not any(x[1] == "hidden" for x in s)


def test_imports_exports_calls(engine):
    i = {(r.path, r.source, tuple(r.names)) for r in engine.store.table("imports").collect()}
    assert {("go/main.go", "net/http", ("http",)), ("py/tool.py", "re", ("compile",)), ("py/tool.py", "os", ("os",)), ("rs/lib.rs", "std::io", ("Read", "Write")), ("src/auth/session.ts", "./jwt.js", ("verifyToken",))} <= i
    e = {(r.path, r.name, r.kind) for r in engine.store.table("exports").collect()}
    assert {("src/auth/jwt.ts", "verifyToken", "function"), ("go/main.go", "Serve", "function"), ("rs/lib.rs", "Pool", "struct")} <= e
    c = {(r.path, r.caller, r.callee) for r in engine.store.table("calls").collect()}
    assert ("src/search/search.ts", "runSearch", "verifyToken") in c and ("go/main.go", "Serve", "Println") in c


def test_dependencies(engine):
    d = engine.deps("src/auth/session.ts").first()
    assert d.direct == ["src/auth/jwt.ts"] and d.reverse == ["src/search/search.ts"]
    with pytest.raises(LookupError):
        engine.deps("nothing-like-it")


def test_lookups(engine):
    assert col(engine.symbol("token"), "name") == ["verifyToken"]
    assert col(engine.symbol("verifyToken", kinds=["class"])) == []
    assert col(engine.path("notes.txt")) == ["notes.txt"]
    hit = engine.word("verifyToken").first()
    assert (hit.kind, hit.title, hit.score) == ("symbol", "verifyToken", 1.0)
    assert [r.name for r in engine.outline("src/auth/session.ts").collect()][0] == "Session"
    with pytest.raises(LookupError):
        engine.outline("SRC/auth/session.ts")


def test_related_search(engine):
    top = engine.search("verify token", k=5).collect()
    assert any(r.path == "src/auth/jwt.ts" for r in top[:2])
    assert all(0 <= r.score <= 1 for r in top)
    files = engine.search("verify token", entity_types=["file"], k=3).collect()
    assert files and all(r.entity_type == "file" for r in files)
    for mode in ("keyword", "semantic"):
        assert any(r.path == "src/auth/jwt.ts" for r in engine.search("verify token", mode=mode, k=5).collect())


def test_research_hubs_and_reports(engine):
    found = engine.research("session token")
    assert found["hits"].count() and found["cards"].count()
    assert engine.find_hub("auth").first().hub == "docs/auth.md"
    assert engine.find_hub(query="auth tokens").first().hub == "docs/auth.md"
    orphans = col(engine.find_hub(show_orphans=True))
    assert "src/search/search.ts" in orphans and "src/auth/jwt.ts" not in orphans
    usage = {r.path: r.usages for r in engine.blast_radius("verifyToken", "src/auth/jwt.ts").collect()}
    assert usage == {"src/auth/session.ts": 1, "src/search/search.ts": 1}
    assert engine.clusters().count() > 0 and engine.lint().count() > 0
    assert "jwt.ts" in engine.tree() and "verifyToken" not in engine.tree(max_tokens=60)


def test_generations(spark, root, tmp_path):
    e = Engine(spark, str(tmp_path / "s"))
    with pytest.raises(LookupError):
        e.symbol("x")
    e.index(root, "core")
    assert [c for c, _ in e.check("full")][0] == "mode-mismatch" and e.check("core") == []
    with pytest.raises(RuntimeError, match="mode-mismatch"):
        e.search("token")
    e.store.mark("dirty", "edited")
    assert e.check("core") == [("serving-generation-not-fresh", "generation 1 is dirty: edited")]
    e.index(root, "core")
    assert e.store.pointer().active == 2 and e.store.pointer().freshness == "fresh"
    m = json.loads((tmp_path / "s/generation-2/manifest.json").read_text())
    m["tables"]["files"] += 1
    (tmp_path / "s/generation-2/manifest.json").write_text(json.dumps(m))
    (tmp_path / "s/generation-2/.manifest.json.crc").unlink(missing_ok=True)
    assert [c for c, _ in validate(e.store, 2, "core")] == ["row-count-mismatch"]
    e.store.retain(1)
    assert not (tmp_path / "s/generation-1").exists()


def test_failed_build_keeps_the_active_generation(spark, root, tmp_path):
    e = Engine(spark, str(tmp_path / "s"))
    e.index(root, "core")
    with pytest.raises(Exception, match="hash|content|resolved"):
        e.index(spark.range(1).select(F.lit("a").alias("path")), "core")
    p = e.store.pointer()
    assert (p.active, p.pending) == (1, 0)


def test_missing_vector_and_document_fail(spark):
    p = spark.createDataFrame([("a", "foo", 1)], "id string, term string, frequency long")
    d = spark.createDataFrame([("a", "p", "foo", None)], "id string, path string, lexical_text string, vector array<double>")
    with pytest.raises(Exception, match="no vector"):
        retrieval.hybrid_search(p, d, "foo", [1.0, 0.0]).collect()
    assert retrieval.hybrid_search(p, d, "foo", None, 5, 0, 1).count() == 1
    with pytest.raises(Exception, match="without document"):
        retrieval.lexical_candidates(p, d.where("false"), "foo").collect()


def test_clustering(spark):
    x = np.array([[1, 0, 0], [1, 0.1, 0], [0.9, 0, 0.1], [0, 1, 0], [0, 1, 0.1], [0.1, 0.9, 0]])
    labels = clusters.cluster_array(x, 2)
    assert labels.tolist() == [0, 0, 0, 1, 1, 1]
    assert clusters.cluster_count(400, 12) == 12 and clusters.cluster_count(30, 20) == 2 and clusters.cluster_count(3, 20) == 3
    i = np.arange(400)
    y = np.eye(12)[i % 8] + 0.35 * np.eye(12)[(i % 8 + 5) % 12] + 0.018 * np.sin((i[:, None] + 1) * 0.03125 + np.arange(12))
    one = clusters.cluster_array(y, 12)
    assert len(set(one)) == 12 or len(set(one)) >= 8
    df = spark.createDataFrame([(int(k), [float(v) for v in row]) for k, row in enumerate(x)], "id long, vector array<double>")
    got = clusters.kmeans(df, 2)
    sides = {r.id: r.cluster for r in got.collect()}
    assert sides[0] == sides[1] == sides[2] != sides[3] == sides[4] == sides[5]


def test_knn_blocks_agree(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(i, [float(v) for v in rng.random(6)]) for i in range(40)], "id long, vector array<double>")
    assert sorted(graph.knn_graph(df).collect()) == sorted(graph.knn_graph(df, blocks=3).collect())


def test_rules(spark):
    f = spark.createDataFrame([("a.ts", "// x\n// FEATURE: y\n// summary: s\n// inputs: i\n// outputs: o\ncode"), ("b.py", "code"), ("c.txt", "none")], "path string, content string")
    assert [(r.path, r.rule) for r in rules.findings(f).collect()] == [("b.py", "header")]
    assert rules.file_scores(rules.findings(f)).first().score == 82


def test_streaming_sessions_and_follow(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:10:00"), (1, "2024-01-01 02:00:00"), (2, "2024-01-03 00:00:00")]
    df = spark.createDataFrame(rows, "k long, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    df.write.parquet(str(tmp_path / "in"))
    batch = changes.sessions(df, "k", "ts", "1 hour")
    assert sorted(r.events for r in batch.where("k = 1").collect()) == [1, 2]
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = changes.sessions(stream, "k", "ts", "1 hour", "1 minute").writeStream.format("memory").queryName("closed").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    closed = spark.table("closed")
    assert closed.where("k = 1").count() == 2 and closed.where("k = 2").count() == 0
    seen = []
    q = changes.follow(stream.withColumn("path", F.col("k").cast("string")), lambda b, n: seen.append(sorted(r.path for r in b.collect())), str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [x for x in seen if x] == [["1", "2"]]


def test_listing_changes(spark):
    schema = "path string, size long, mtime_ms long"
    a = spark.createDataFrame([("a", 1, 1), ("b", 1, 1), ("node_modules/x", 1, 1)], schema)
    b = spark.createDataFrame([("a", 2, 1), ("c", 1, 1)], schema)
    assert sorted((r.path, r.change) for r in changes.listing_changes(a, b).collect()) == [("a", "changed"), ("b", "removed"), ("c", "added")]


def test_python_parser_survives_bad_input():
    assert structure.parse_file("def f(:\n", "python") == [] and structure.parse_file("", "go") == []


def test_refresh_takes_over_unchanged_files(spark, root, tmp_path):
    import shutil

    from stratalens.plans.engine import Providers

    top = tmp_path / "tree"
    shutil.copytree(root, top)
    vector = lambda x: lambda c: F.when(c.isNotNull(), F.array(F.lit(x), F.lit(1.0)))
    e = Engine(spark, str(tmp_path / "store"), Providers("p", vector(1.0), lambda q: [1.0, 0.0]))
    assert e.index(str(top)) == []
    (top / "src/auth/jwt.ts").write_text("// Changed\n\nexport function renamedToken(t) {\n  return t;\n}\n")
    (top / "py/tool.py").unlink()
    e.providers = Providers("p", vector(2.0), lambda q: [1.0, 0.0])
    assert e.refresh(str(top)) == []
    first = {r.path: r.vector[0] for r in e.store.table("file_docs").collect()}
    assert first.pop("src/auth/jwt.ts") == 2.0 and set(first.values()) == {1.0} and "py/tool.py" not in first
    m = e.store.manifest(e.store.pointer().active)
    assert m.since == 1 and m.reused["file_docs"] == len(first) and m.reused["symbols"] > 0
    names = {r.name for r in e.store.table("symbols").collect()}
    assert "renamedToken" in names and not names & {"verifyToken", "Greeter"}
    assert e.symbol("renamedToken").count() == 1 and e.symbol("verifyToken").count() == 0
    assert e.word("renamedtoken").count() >= 1
    fresh = Engine(spark, str(tmp_path / "other"), Providers("p", vector(1.0), lambda q: [1.0, 0.0]))
    fresh.index(str(top))
    for t in ("symbols", "symbol_tokens", "identifiers", "word_hits", "chunks", "postings", "identifier_postings", "imports", "exports", "calls", "deps", "modules", "cards", "module_cards", "ownership"):
        keep = [c for c in fresh.store.table(t).columns if c != "vector"]
        a, b = (sorted(map(str, x.store.table(t).select(*keep).collect())) for x in (e, fresh))
        assert a == b, t


def test_prepared_lookups_equal_those_made_anew(engine):
    from stratalens.operators import lookup

    t = engine.store.table
    anew = lookup.lookup_word(lookup.word_hits(t("symbols"), t("files"), t("identifiers")), ["token"], 50).collect()
    assert engine.word("token", 50).collect() == anew and anew
    assert engine.path_content("src/auth/jwt.ts").first().content.startswith("// Token signing")
    assert engine.path_content("nowhere").collect() == []
    mixed = engine.exact("verifyToken")
    assert set(mixed) == {"symbols", "files", "words"} and mixed["symbols"].count() == 1
    assert list(engine.exact("jwt", "file")) == ["files"]


def test_hubs_expand_and_suggestions(engine):
    rows = engine.expand_hub("docs/auth.md").collect()
    assert [(r.target, r.resolved) for r in rows] == [("src/auth/jwt.ts", True), ("src/auth/session.ts", True)]
    found = engine.suggestions()
    assert found["members"].count() > 0 and all(r.label and r.slug for r in found["labels"].collect())
    cards = {r.path: r for r in engine.store.table("cards").collect()}
    assert "verifyToken (function)" in cards["src/auth/jwt.ts"].api and "imported by 1 file(s)" in cards["src/auth/jwt.ts"].hot_path
    assert engine.store.table("module_cards").count() == engine.store.table("modules").count()


def test_repair_and_locks(spark, root, tmp_path):
    e = Engine(spark, str(tmp_path))
    e.index(root)
    assert e.repair(root) == []
    e.store.mark("blocked", "test")
    assert [c for c, _ in e.repair(root, "file-search")] == ["serving-generation-not-fresh"]
    assert e.check() == [] and e.store.pointer().active == 2
    with pytest.raises(ValueError):
        e.repair(root, "nonsense")
    with e.store.lock():
        with pytest.raises(RuntimeError, match="locked"):
            e.index(root)
        with e.store.lock(stale_s=-1):
            pass
    m = e.store.manifest(2)
    m.stages["extra"] = "completed"
    e.store.save_manifest(m)
    assert ("unknown-stage", "extra is no stage") in validate(e.store, 2)


def test_large_nodes_split_by_the_distributed_loop(spark):
    rng = np.random.default_rng(0)
    base = rng.standard_normal((6, 8))
    rows = [(f"d/{i:03d}", (base[i % 6] + rng.standard_normal(8) * 0.01).tolist()) for i in range(90)]
    items = spark.createDataFrame(rows, "path string, vector array<double>")
    one, many = (sorted(map(tuple, clusters.hierarchy(items, depth=2, one_task=n).collect())) for n in (50_000, 30))
    part = lambda rows: {frozenset(p for p, n, _ in rows if n.split("/")[:2] == k) for k in {tuple(r[1].split("/")[:2]) for r in rows} for k in [list(k)]}
    assert part(one) == part(many)


def test_cluster_tree_as_text(engine):
    told = engine.navigate()
    paths = col(engine.store.table("cluster_nodes"))
    assert told.splitlines()[0] == f"{len(paths)} files by meaning"
    assert all(p in told for p in paths)
    assert "more" in engine.navigate(max_clusters=1)


def test_searches_are_counted(engine):
    engine.counters.reset()
    found = engine.diagnose("verifyToken session", 2)
    assert found["chunk"]["lexical_candidates"] >= 2 and found["chunk"]["results"] == 2
    engine.diagnose("nothingofthekind")
    report = engine.counters.report()
    assert report["chunk"]["calls"] == 2 and report["chunk"]["last_results"] == 0
    assert report["identifier"]["results"] == found["identifier"]["results"]
