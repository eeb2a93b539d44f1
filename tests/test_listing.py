"""The tree data source against the tree reader."""

import pytest
from pyspark.sql import functions as F

from stratalens.sources import files as tree
from stratalens.sources.listing import TreeReader, TreeSource
from stratalens.streaming.changes import listing_changes

FILES = ["a.ts", "src/b.py", "src/deep/er/c.go", "src/deep/d.md", "src/.hidden", ".git/x", "node_modules/m/i.js", "out/y.ts", "out/keep.ts", "lib/out/z.ts", "lib/é ü.ts", "srcs/e.rs", "lib/_under.ts"]


@pytest.fixture
def root(spark, tmp_path):
    spark.dataSource.register(TreeSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for f in FILES:
        (tmp_path / f).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / f).write_text("x" * len(f))
    return str(tmp_path)


def listed(spark, root, **options):
    return spark.read.format("tree").options(root=root, **options).load()


def paths(df):
    return sorted(r.path for r in df.collect())


@pytest.mark.parametrize("rules", ["", "out/\n", "/out\n", "out/*\n!out/keep.ts\n", "*.ts\n", "**/er/\n"])
def test_the_listing_equals_the_reader(spark, root, rules):
    want = sorted((r.path, r.depth, r["size"], r.mtime_ms) for r in tree.read_tree(spark, root, rules).collect())
    for n in ("1", "3", "64"):
        got = sorted(map(tuple, listed(spark, root, rules=rules, partitions=n).collect()))
        assert got == want


def test_filters_cut_the_walk(spark, root):
    df = listed(spark, root)
    assert paths(df.where("depth <= 1")) == [p for p in paths(df) if p.count("/") <= 1]
    assert paths(df.where("depth > 1 and depth < 3")) == ["lib/out/z.ts", "src/deep/d.md"]
    assert paths(df.where("path like 'src/%'")) == ["src/b.py", "src/deep/d.md", "src/deep/er/c.go"]
    assert paths(df.where("depth = 0 and size > 0")) == ["a.ts"]
    reader = TreeReader({"root": root})
    from pyspark.sql.datasource import LessThanOrEqual, StringStartsWith

    assert list(reader.pushFilters([LessThanOrEqual(("depth",), 1), StringStartsWith(("path",), "src/")])) == []
    entered, walk = [], reader._list
    reader._list = lambda s, b, f: entered.append(f) or walk(s, b, f)
    assert [r[0] for p in reader.partitions() for r in reader.read(p)] == ["src/b.py"]
    assert set(entered) == {"", "src"}


def test_changes_of_two_listings(spark, root, tmp_path):
    before = listed(spark, root)
    before = spark.createDataFrame(before.collect(), before.schema)
    (tmp_path / "a.ts").unlink()
    (tmp_path / "src/b.py").write_text("longer than before")
    (tmp_path / "src/n.py").write_text("")
    got = {(r.path, r.change) for r in listing_changes(before, listed(spark, root)).collect()}
    assert got == {("a.ts", "removed"), ("src/b.py", "changed"), ("src/n.py", "added")}
    assert listed(spark, root + "/missing").where(F.col("size") > 0).count() == 0
