"""Generations that share folders: merges write touched buckets only, and what a kept manifest names is not deleted."""

from pyspark.sql import functions as F

from stratalens.plans.generations import Manifest, Store, apply_merge, delete, diff_merge, upsert, validate


def folders(m, table="t"):
    return {f.split("/")[-1]: f.split("/")[0] for f in m.folders[table]}


def test_an_applied_merge_writes_touched_buckets_only(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    was = spark.createDataFrame([(f"f{i}", f"h{i}", [float(i)]) for i in range(200)], "path string, hash string, vector array<double>")
    old = Manifest(1, "full", buckets=16)
    store.save_parts(old, "t", was)
    assert sorted(map(tuple, store.read(old, 1, "t").collect())) == sorted(map(tuple, was.collect()))
    edited = was.where("path <> 'f7'").withColumn("hash", F.when(F.col("path") == "f9", "new").otherwise(F.col("hash")))
    wanted = edited.unionByName(spark.createDataFrame([("g1", "x", [1.0])], was.schema))
    new = Manifest(2, "full")
    actions = {r.path: r.action for r in apply_merge(store, old, new, "t", wanted, "path", "hash").where("action <> 'keep'").collect()}
    assert actions == {"f7": "delete", "f9": "update", "g1": "insert"}
    got = sorted(map(tuple, store.read(new, 2, "t").collect()))
    assert got == sorted(map(tuple, wanted.collect()))
    by_hand = delete(upsert(was, wanted.where(F.col("path").isin("f9", "g1")), ["path"]), spark.createDataFrame([("f7",)], "path string"), ["path"])
    assert got == sorted(map(tuple, by_hand.collect()))
    assert 1 <= sum(g == "generation-2" for g in folders(new).values()) <= 3
    assert diff_merge(store.read(new, 2, "t"), wanted, "path", "hash").where("action <> 'keep'").count() == 0
    third = Manifest(3, "full")
    apply_merge(store, new, third, "t", wanted, "path", "hash")
    assert third.folders["t"] == new.folders["t"]  # nothing changed, so nothing is written
    empty = Manifest(4, "full")
    apply_merge(store, new, empty, "t", wanted.where("false"), "path", "hash")
    assert store.read(empty, 4, "t").count() == 0 and store.read(empty, 4, "t").columns == was.columns


def test_kept_generations_keep_the_folders_that_they_name(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    rows = spark.createDataFrame([(f"f{i}", i) for i in range(60)], "path string, n int")
    made = []
    for g in (1, 2, 3):
        assert store.reserve() == g
        m = Manifest(g, "full", buckets=8)
        if g == 1:
            store.save_parts(m, "t", rows)
            store.save(g, "u", rows)
            m.tables["u"] = 60
        else:
            touched = [g]  # each generation writes one bucket anew
            store.save_parts(m, "t", rows.withColumn("n", F.lit(g)), "path", touched, store.shared_folders(made[-1], "t", touched))
            store.adopt(m, made[-1], "u")
        store.save_manifest(m)
        store.activate(g)
        made.append(m)
    before = sorted(map(tuple, store.table("t").collect()))
    store.retain(1)
    assert sorted(map(tuple, store.table("t").collect())) == before and store.table("u").count() == 60
    assert {r.n for r in store.table("t").collect()} > {2, 3}
    left = {p.name for p in (tmp_path / "s").iterdir() if p.name.startswith("generation-")}
    assert left == {"generation-1", "generation-2", "generation-3"}
    assert not (tmp_path / "s/generation-1/t/_bucket=3").exists() and (tmp_path / "s/generation-1/t/_bucket=4").exists()
    assert store.has(3, "t") and store.has(3, "u")
    (tmp_path / "s/generation-1/t/_bucket=4").rename(tmp_path / "s/away")
    assert not store.has(3, "t")


def test_a_refresh_shares_and_a_stage_is_repaired(spark, tmp_path):
    """Two files of many change: buckets of the others stay those of the first generation; a lost table is built again over
    the tables of the stages before it."""
    import shutil

    from stratalens.plans.engine import Engine

    root = tmp_path / "src"
    body = lambda i: f"// File {i}\n// FEATURE: x\nimport {{ fun{i + 1} }} from '../m{(i + 1) % 3}/f{i + 1}.js'\nexport function fun{i}(a: string) {{\n  return other{i % 5}(a)\n}}\n"
    for i in range(30):
        (root / f"m{i % 3}").mkdir(parents=True, exist_ok=True)
        (root / f"m{i % 3}/f{i}.ts").write_text(body(i))
    engine = Engine(spark, str(tmp_path / "s"))
    engine.index(str(root))
    (root / "m0/f0.ts").write_text("// Changed\n// FEATURE: x\n\nexport function changed(a: string) { return fun1(a) }\n")
    (root / "m1/f1.ts").unlink()
    (root / "m0/f30.ts").write_text("// New\n// FEATURE: x\nexport function fun30() { return 1 }\n")  # f29 imported it before it was there
    engine.refresh(str(root))
    m = engine.store.manifest(2)
    for table in ("symbols", "chunks", "postings", "source_lines", "word_hits", "file_docs"):
        homes = [f.split("/")[0] for f in m.folders[table]]
        assert 0 < homes.count("generation-2") <= 3 < homes.count("generation-1")
    assert [r.name for r in engine.symbol("changed").collect()] == ["changed"] and engine.symbol("fun1").count() == 0
    assert {r.path for r in engine.blast_radius("fun1").collect()} == {"m0/f0.ts"}
    whole = Engine(spark, str(tmp_path / "w"))
    whole.index(str(root))
    for table in ("deps", "cards"):
        assert m.reused[table] > 0
    assert m.tables["cards"] - m.reused["cards"] <= 5  # the changed file, its importers and what they name
    for table in ("symbols", "postings", "word_positions", "deps", "modules", "module_edges", "cards", "file_structure", "related"):
        cols = [c for c in whole.store.table(table).columns if c != "mtime_ms"]
        assert sorted(map(str, engine.store.table(table).select(cols).collect())) == sorted(map(str, whole.store.table(table).select(cols).collect())), table
    want = engine.search("changed function", k=3).select("id", "score").collect()
    shutil.rmtree(tmp_path / "s/generation-2/cards")
    assert [c for c, _ in validate(engine.store, 2, scan=False)] == ["missing-table"]
    assert [c for c, _ in engine.repair(str(root), "full-artifacts")] == ["missing-table"]
    m = engine.store.manifest(3)
    assert engine.check() == [] and m.folders["files"] == ["generation-2/files"]
    assert {f.split("/")[0] for f in m.folders["cards"]} == {"generation-3"}
    assert engine.search("changed function", k=3).select("id", "score").collect() == want
