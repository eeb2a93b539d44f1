import subprocess

import pytest

from stratalens.operators.rules import status_summary
from stratalens.plans import helpers
from stratalens.plans.generations import Store
from stratalens.sources import worktree


def test_parsers():
    branch, rows = worktree.parse_status('## main...origin/main [ahead 1]\n M a.ts\nA  b.ts\n?? "c d.ts"\nR  x -> y\n')
    assert branch == "main" and rows == [("a.ts", " ", "M"), ("b.ts", "A", " "), ("c d.ts", "?", "?"), ("y", "R", " ")]
    assert worktree.parse_status("## No commits yet on dev\n") == ("dev", []) and worktree.parse_status("")[0] == "detached"
    diff = "--- a/x\n+++ b/x\n@@ -1,2 +3,4 @@ f\n@@ -9 +12,0 @@\n--- a/y\n+++ /dev/null\n@@ -1 +0,0 @@\n"
    assert worktree.parse_hunks(diff) == [("x", 3, 6), ("x", 12, 11)]
    assert worktree.parse_numstat("3\t1\ta\n-\t-\tb\n") == [("a", 3, 1), ("b", 0, 0)]


def test_working_tree(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.email=a@b", "-c", "user.name=n", *a], check=True, capture_output=True)
    git("init", "-q")
    (tmp_path / "a").write_text("1\n2\n")
    git("add", "a")
    git("commit", "-qm", "x")
    (tmp_path / "a").write_text("1\n3\n")
    (tmp_path / "b").write_text("n\n")
    got = {r.path: (r["index"], r.worktree, r.added, r.removed) for r in worktree.changes(spark, str(tmp_path)).collect()}
    assert got == {"a": (" ", "M", 1, 1), "b": ("?", "?", 0, 0)}
    s = status_summary(worktree.status(spark, str(tmp_path))).first()
    assert (s.unstaged, s.untracked, s.modified, s.created) == (1, 1, 1, 1)
    assert [tuple(r) for r in worktree.changed_ranges(spark, str(tmp_path)).collect()] == [("a", 2, 2)]


def test_hub_files(tmp_path):
    (tmp_path / "a.ts").write_text("x")
    out = helpers.create_hub(str(tmp_path), "My Hub!", ["a.ts", "a.ts"])
    assert out.name == "my-hub.md" and out.read_text() == "# My Hub!\n\n- [[a.ts]]\n"
    with pytest.raises(FileExistsError):
        helpers.create_hub(str(tmp_path), "my hub", ["a.ts"])
    for bad in ("../x", "/etc/passwd", "missing"):
        with pytest.raises(ValueError):
            helpers.create_hub(str(tmp_path), "t", [bad])
    assert len(helpers.write_suggestions(str(tmp_path), [{"label": "A b", "paths": ["x"]}, {"label": "a-B", "paths": ["y"]}])) == 1


def test_restore_points(spark, tmp_path):
    points = helpers.RestorePoints(Store(spark, str(tmp_path / "s")))
    (tmp_path / "a").write_text("old")
    point = points.create(spark, str(tmp_path), ["a", "new"], "before")
    (tmp_path / "a").write_text("changed")
    (tmp_path / "new").write_text("x")
    assert points.restore(spark, str(tmp_path), point) == ["a", "new"]
    assert (tmp_path / "a").read_text() == "old" and not (tmp_path / "new").exists()
    with pytest.raises(LookupError):
        points.restore(spark, str(tmp_path), "none")


@pytest.mark.parametrize(("text", "value"), [('```json\n{"a": 1,}\n```', {"a": 1}), ('so: {"a": [1, {"b": "}"}]} done', {"a": [1, {"b": "}"}]}), ('{"a": [1, 2', {"a": [1, 2]}), ('{"a": "x', {"a": "x"})])
def test_repaired_json(text, value):
    assert helpers.repaired_json(text) == value


def test_reports(spark, tmp_path):
    assert helpers.doctor(Store(spark, str(tmp_path / "none")))["issues"] == ["no-generation"]
    assert helpers.summary("q", [], [], [])["answer"] == "Nothing fits 'q'."
    s = spark.createDataFrame([("p", "A", "class", 1, 4, "class A", None), ("p", "f", "function", 2, 3, "def f()", "A")], "path string, name string, kind string, line int, end_line int, signature string, parent_name string")
    assert helpers.skeleton(s, "p") == "class A  :1-4\n  def f()  :2-3"
