"""Growth: that a step isn't repeated or shuffled more than it needs, with the results as they were."""

import io
import random
from contextlib import redirect_stdout

from pyspark.sql import functions as F

from lattica.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain()
    return out.getvalue()


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_pairs_of_edges_are_not_shuffled(spark):
    from lattica.operators import graph

    symbols = spark.createDataFrame(
        [("a", "A", ["implements B", "extends B", "implements B"]), ("b", "B", []), ("b2", "B", ["implements B", "implements C"]), ("x", "B", []), ("x", "C", ["implements B"]), (None, "B", ["implements B"])],
        "symbol_id string, name string, relationships array<string>",
    )
    edges = graph.relationship_edges(symbols)
    assert "Exchange" not in plan(edges).partition("Join")[0]
    want = [("a", "b", "Extends"), ("a", "b", "Implements"), ("a", "b2", "Extends"), ("a", "b2", "Implements"), ("a", "x", "Extends"), ("a", "x", "Implements"), ("b2", "b", "Implements"), ("b2", "x", "Implements"), ("x", "b", "Implements"), ("x", "b2", "Implements")]
    assert rows(edges) == want  # x stands under both names that b2 uses, and is linked once


def test_pairs_of_references_are_not_shuffled(spark):
    from lattica.operators import graph

    symbols = spark.createDataFrame([("t", "Tree", "struct Tree"), ("t2", "Tree", "class Tree"), ("f", "f", "fn f(a: Tree, b: Tree) -> Leaf"), ("t", "Leaf", "struct Leaf")], "symbol_id string, name string, signature string")
    edges = graph.reference_edges(symbols)
    assert "Exchange" not in plan(edges).partition("Join")[0]
    assert rows(edges) == [("f", "t", "References"), ("f", "t2", "References"), ("t", "t2", "References"), ("t2", "t", "References")]


def test_references_of_all_files(spark):
    assert "/n7/" not in ORACLES["i36_reference_edges"]
    edges = QUERIES["i36_reference_edges"](spark, SF)
    assert edges.where("not contains(src, '/n7/')").count() > 0 and edges.where("not contains(dst, '/n7/')").count() > 0


def test_budget_reads_comments_once(spark, monkeypatch):
    """The stages that only change comments are estimated in one reading."""
    from lattica.operators import budget, trees

    decls = spark.createDataFrame([("m", "a.rs", 0, 0, 0, "Public", "fn a()", 1, "x" * 400, ["implements B"])], "member string, path string, decl_ord int, subtree_end int, depth int, visibility string, signature string, line int, doc_comment string, relationships array<string>")
    files = spark.createDataFrame([("m", "a.rs", 1)], "member string, path string, lines int")
    imports = spark.createDataFrame([("m", "a.rs", 0, "use b;")], "member string, path string, import_ord int, text string")
    ix = budget.Index("root", files, decls, imports, trees.tree_entries(files))
    one = [budget.index_tokens(x) for x in (ix, budget.shortened(ix), budget.undocumented(ix))]
    assert one[0] > one[1] > one[2]
    calls, collect = [], type(decls).collect
    monkeypatch.setattr(type(decls), "collect", lambda self: calls.append(1) or collect(self))
    for stage, most in enumerate(one):
        calls.clear()
        assert budget.fitted(ix, most)[1] == stage and len(calls) == 1


def test_declarations_are_shuffled_as_numbers(spark):
    """Texts are made after the windows: no text but the path is part of the shuffle."""
    from lattica.plans import standins as S

    d = S.decls(lambda name: spark.read.parquet(f"{SF}/{name}.parquet"))
    below = plan(d.select("path", "decl_ord", "signature", "name", "doc_comment")).partition("Exchange hashpartitioning(path")[2]
    assert below and "struct " not in below and "get_" not in below and "More of" not in below


def test_type_flow_takes_apart_what_names_the_type(spark, monkeypatch):
    from lattica.operators import types

    decls = spark.createDataFrame([("a.rs", "Rust", 0, "Function", "f", "fn f(a: TREE) -> Leaf", 1), ("a.rs", "Rust", 1, "Function", "g", "fn g(a: Leaf) -> tree", 2), ("a.rs", "Rust", 2, "Function", "h", "fn h(a: Leaf)", 3)], "path string, language string, decl_ord int, kind string, name string, signature string, line int")
    seen, flows = [], types.flows
    monkeypatch.setattr(types, "flows", lambda d, fields: seen.append(d.count()) or flows(d, fields))
    assert [(r.role, r.name) for r in types.type_flow(decls, "Tree").collect()] == [("producer", "g"), ("consumer", "f")]
    assert seen == [2]


def test_language_is_filtered_below_the_windows(spark):
    from lattica.plans import standins as S

    d = S.decls(lambda name: spark.read.parquet(f"{SF}/{name}.parquet"))
    assert "EndsWith" in plan(d.where("language = 'Rust'").select("path", "decl_ord")).partition("Window")[2]


def test_declaration_diff_without_joins(spark):
    from lattica.operators import difference

    schema = "path string, kind string, name string, signature string, decl_ord int, depth int"
    old = spark.createDataFrame([("a", "F", "x", "1", 0, 0), ("a", "F", "x", "2", 1, 1), ("a", "F", "gone", None, 2, 0), ("a", "F", None, "n", 3, 0), ("b", "F", "y", "1", 0, 0), ("c", "F", "z", "1", 0, 5), (None, "F", "q", "1", 0, 0)], schema)
    new = spark.createDataFrame([("a", "F", "x", "3", 0, 0), ("a", "F", None, "n", 3, 0), ("c", "F", "z", "1", 0, 0), ("d", "F", "w", None, 0, 0), (None, "F", "q", "1", 0, 0)], schema)
    d = difference.declaration_diff(old, new)
    assert "Join" not in plan(d)
    assert rows(d) == sorted([
        ("a", "modified", "F", "x", "modified", "2", "3"), ("a", "modified", "F", "gone", "removed", None, None), ("a", "modified", "F", None, "removed", "n", None), ("a", "modified", "F", None, "added", None, "n"),
        ("b", "removed", "F", "y", "removed", "1", None), ("c", "modified", "F", "z", "added", None, "1"), ("d", "added", "F", "w", "added", None, None), (None, "added", "F", "q", "removed", "1", None), (None, "added", "F", "q", "added", None, "1"),
    ], key=str)


def test_edited_texts_without_fingerprints(spark):
    from lattica.llm import simhash

    docs = spark.createDataFrame([(i, f"text {i} " * (i % 7)) for i in range(50)] + [(50, None)], "doc_id long, text string").repartition(5)
    plain, marked = simhash.with_next(docs, marks=False), simhash.with_next(docs)
    own = ["doc_id", "n_chars", "edited_sha256"]
    assert rows(plain.select(*own)) == rows(marked.select(*own)) and plain.count() == 51
    assert plain.where("fingerprint is not null or edited_fingerprint is not null or near_edited is not null or near_next is not null").count() == 0


def test_tree_filters_without_joins(spark):
    """Against the definition, on random trees, with two declarations at one place and unknown ends."""
    from lattica.operators import trees

    rnd = random.Random(8)
    data = []
    for f in range(12):
        for o in range(15):
            o2 = o - 1 if o and rnd.random() < 0.1 else o
            data.append(("m", None if f == 11 else f"f{f}", o2, None if rnd.random() < 0.05 else o2 + rnd.randint(0, 4), rnd.choice(["A", "B", None]), rnd.choice(["Private", "Public", None]), rnd.choice(["part7", "x"]), len(data)))
    d = spark.createDataFrame(data, "member string, path string, decl_ord int, subtree_end int, kind string, visibility string, name string, i int")

    def near(r, test, above, below):
        ok = lambda a, lo, hi: hi is not None and lo <= a <= hi
        return any(test(m) and r[1] is not None and m[1] == r[1] and ((above and ok(m[2], r[2], r[3])) or (below and ok(r[2], m[2], m[3]))) for m in data)

    ids = lambda df: sorted(r.i for r in df.collect())
    for got, want in (
        (trees.by_kind(d, ["A"]), lambda r: near(r, lambda m: m[4] == "A", True, False)),
        (trees.public_only(d), lambda r: not near(r, lambda m: m[5] == "Private", False, True)),
        (trees.by_symbol(d, "Part7"), lambda r: near(r, lambda m: m[6] == "part7", True, True)),
        (trees.with_descendants(d, F.col("kind") == "A"), lambda r: near(r, lambda m: m[4] == "A", False, True)),
    ):
        assert "Join" not in plan(got) and ids(got) == [r[7] for r in data if want(r)]


def test_an_import_is_taken_apart_once(spark, monkeypatch):
    from lattica.operators import graph

    files = spark.createDataFrame([("a/zebra.py",), ("b/yak.py",), ("b/zebra.py",), ("b/z/yak.py",)], "path string")
    texts = ["import zebra", "import b::yak", "import { k } from './yak'", None, "import zebra"]
    imports = spark.createDataFrame([(p, i, t) for p in ("a/zebra.py", "b/zebra.py", "c/q.py") for i, t in enumerate(texts)], "path string, import_ord int, text string")
    written, saved = [], graph.saved
    monkeypatch.setattr(graph, "saved", lambda df: written.append(saved(df)) or written[-1])
    got = rows(graph.resolve_imports(imports, files))
    assert got == [("a/zebra.py", 1, "b/yak.py"), ("a/zebra.py", 2, "b/yak.py"), ("b/zebra.py", 0, "a/zebra.py"), ("b/zebra.py", 1, "b/yak.py"), ("b/zebra.py", 2, "b/yak.py"), ("b/zebra.py", 4, "a/zebra.py")] + [("c/q.py", 0, "a/zebra.py"), ("c/q.py", 1, "b/yak.py"), ("c/q.py", 2, "b/yak.py"), ("c/q.py", 4, "a/zebra.py")]
    assert written[0].where("text = 'import b::yak'").count() == len(graph.candidates("import b::yak", "")) and {r.at for r in written[0].where("text = 'import zebra'").collect()} == {""}


def test_flows_make_only_what_is_read(spark):
    """The places of declarations aren't counted for a query that leaves them out."""
    assert "Window" not in plan(QUERIES["i38_type_flows"](spark, SF))


def test_nodes_read_edges_once(spark, tmp_path):
    from lattica.operators import graph

    spark.createDataFrame([("a/b", "c"), ("x::y", "a/b")], "src string, dst string").write.parquet(str(tmp_path / "e"))
    n = graph.nodes_of(spark.read.parquet(str(tmp_path / "e")))
    assert plan(n).count("FileScan") == 1 and rows(n) == [("a/b", "b"), ("c", "c"), ("x::y", "y")]


def test_scores_of_unlike_texts_are_cheap(spark):
    """As by the whole formula, though pairs of characters aren't intersected."""
    from lattica.functions import text as X

    rnd = random.Random(12)
    words = ["order42", "Order42", "ord", "o", "", "rder", "get_order42_x", "a-order42", "é", "orderé42", "order 42", "er42or", "ordr42", "odrer42", None] + ["".join(rnd.choice("order42_ xÉ") for _ in range(rnd.randint(0, 12))) for _ in range(400)]
    df = spark.createDataFrame([(w,) for w in words], "t string")
    for q in ("order42", "or", "order 42", "élan42"):
        terms, parts = q.split(), X.split_identifier(F.col("t"))
        score = F.when(F.contains("t", F.lit(q)), 10).otherwise(0) + F.when(F.col("t") == q, 20).otherwise(0)
        for t in terms:
            score = score + F.when(F.contains("t", F.lit(t)), 5).otherwise(0) + F.when(F.array_contains(parts, t), 3).otherwise(0)
        near = X.bigram_similarity(F.col("t"), F.lit(q))
        fuzzy = F.when(near > 0.4, F.floor(8 * near)).otherwise(0)
        want = score if len(q) < 4 else F.when(score == 0, fuzzy).otherwise(score)
        got = df.select(X.score_match(F.col("t"), q).alias("got"), want.cast("long").alias("want"), "t")
        assert [r for r in got.collect() if r.got != r.want] == []
        assert "array_intersect" not in plan(df.select(X.score_match(F.col("t"), q)))
