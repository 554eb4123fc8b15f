import subprocess

from pyspark.sql import functions as F

from lattica.operators import difference, graph, health, search, trees
from lattica.sources import extract, git, walk

PY = '''import os
LIMIT = 3

class Cache(Base):
    """Keeps."""

    def get(self, key):
        if key and self.ok:
            for x in key:
                if x:
                    return x
        elif key is None:
            return None

def _helper(a, b=1):
    return a
'''
RS = "use std::path::Path;\n\n/// Parses.\npub fn parse_file(path: &Path) -> u32 {\n    if a && b {\n        1\n    } else if c {\n        2\n    }\n}\n\nstruct Cache {\n    x: u32,\n}\n\nimpl Parser for Cache {\n    fn get(&self, k: u8) -> u8 {\n        k\n    }\n}\n"


def tree(tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "_x.py").write_text(PY)
    (tmp_path / "a.rs").write_text(RS)
    (tmp_path / "README.md").write_text("# Top\n## Sub\ntext\n# Next\n")
    (tmp_path / "empty.py").write_text("")
    (tmp_path / "skip.py").write_text("x = 1\n")
    (tmp_path / "bad.py").write_bytes(b"\xff\xfe")
    (tmp_path / ".hidden.py").write_text("y = 1\n")
    (tmp_path / ".gitignore").write_text("skip.*\n")
    return str(tmp_path)


def test_walk_and_extract(spark, tmp_path):
    root = tree(tmp_path)
    files = walk.files(spark, root)
    assert [r.path for r in files.orderBy("path_parts").collect()] == ["README.md", "a/_x.py", "a.rs", "bad.py", "empty.py"]
    contents = walk.contents(files)
    assert contents.count() == 4
    d = extract.declarations(contents).withColumn("member", F.lit("m"))
    by = {(r.path, r.name): r for r in d.collect()}
    get = by["a/_x.py", "get"]
    assert (get.cyclomatic, get.nesting, get.params, get.kind) == (6, 3, 1, "Method")
    assert by["a/_x.py", "Cache"].relationships == ["extends Base"] and by["a/_x.py", "_helper"].visibility == "Private"
    rs = by["a.rs", "parse_file"]
    assert (rs.cyclomatic, rs.nesting, rs.params, rs.visibility, rs.doc_comment) == (4, 1, 1, "Public", "Parses.")
    assert by["a.rs", "Parser for Cache"].relationships == ["implements Parser"]
    assert by["README.md", "Sub"].parent_ord == by["README.md", "Top"].decl_ord
    # trees are intervals
    assert {r.name for r in trees.by_kind(d, ["Method"]).where("path = 'a/_x.py'").collect()} == {"Cache", "get"}
    assert "_helper" not in {r.name for r in trees.public_only(d).collect()}
    assert {r.name for r in trees.by_symbol(d, "cache").where("path = 'a/_x.py'").collect()} == {"Cache", "get"}
    assert [r.name for r in search.lookup_symbol(d, "GET").collect()] == ["get", "get"]
    imports = extract.imports(contents)
    assert [r.path for r in search.callers(d, imports, "Path").collect()] == ["a.rs", "a.rs"]
    assert search.search_relevant(d, files, "parse file").first().name == "parse_file"
    m = d.where("cyclomatic is not null").select(F.col("path").alias("file"), "line", "cyclomatic", "nesting", "params", "body_lines")
    assert health.hotspots(m).first().cyclomatic == 6
    h = health.health(m).first()
    assert (h.analyzed, h.max_complexity) == (4, 6)
    empty = health.health(m.limit(0)).first()
    assert (empty.analyzed, empty.median, empty.p90, empty.avg_complexity) == (0, 0, 0, 0.0)


def test_git_diff(spark, tmp_path):
    root = tree(tmp_path)
    run = lambda *a: subprocess.run(["git", "-C", root, "-c", "user.name=x", "-c", "user.email=x@example.com", *a], check=True, capture_output=True)
    run("init", "-q")
    run("add", "-A")
    run("commit", "-qm", "one")
    first = git.head(root)
    (tmp_path / "a" / "_x.py").write_text(PY.replace("b=1", "b=2") + "def new():\n    pass\n")
    run("commit", "-qam", "two")
    paths = git.changed_paths(root, first)
    assert paths == ["a/_x.py"]
    old, new = (extract.declarations(git.at_ref(spark, root, r, paths)).select("path", "kind", "name", "signature") for r in (first, "HEAD"))
    got = {(r.name, r.change) for r in difference.structural_diff(old, new, ["path", "kind", "name"], "signature").collect()}
    assert got == {("_helper", "modified"), ("new", "added")}
    assert difference.structural_diff(new, new, ["path", "kind", "name"], "signature").isEmpty()


def test_reachable(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    seeds = spark.createDataFrame([("a",)], "node string")
    for depth, want in ((0, {"a"}), (1, {"a", "b"}), (2, {"a", "b", "c"}), (None, {"a", "b", "c", "d"})):
        assert {r.node for r in graph.reachable(e, seeds, depth).collect()} == want


def test_written_tables_are_cleaned(spark):
    from lattica import storage
    from lattica.operators import order

    df = spark.createDataFrame([(i % 3, i) for i in range(50)], "k int, v int")
    got = order.numbered(df, [F.col("v")], "n", 0).collect()
    assert sorted((r.v, r.n) for r in got) == [(i, i) for i in range(50)]
    sums = order.running(df, ["k"], [F.col("v")], "v", "before", "total").collect()
    assert all(r.before == sum(range(r.k, r.v, 3)) and r.total == sum(range(r.k, 50, 3)) for r in sums)
    assert storage.clean() >= 2 and storage.clean() == 0
