"""The whole tool on a small repository: tools, sinks, cache, workspace, wiki, protocol, server, watcher, command line."""

import http.client
import io
import json
import os
import queue
import subprocess
import threading
import time

import pytest

from lattica import __main__ as cli
from lattica import engine as E
from lattica.operators import budget, preflight, trees, wiki
from lattica.serving import http as H
from lattica.serving import protocol, writer
from lattica.sinks import graphs, markdown, serialize
from lattica.sources import cache, git, pull_request, walk, wiki_store, workspace
from lattica.streaming import watch

TREE = {
    "Cargo.toml": '[workspace]\nmembers = ["crates/*"]\nexclude = ["crates/no"]\n',
    "crates/a/Cargo.toml": '[package]\nname = "alpha"\n',
    "crates/a/src/lib.rs": "use crate::parser::parse;\n\n/// Keeps.\npub struct Store { pub n: u8, hidden: u8 }\npub trait Keep { fn keep(&self) -> Store; }\nimpl Keep for Store {\n    fn keep(&self) -> Store {\n        if self.n > 1 && true {\n            parse(1)\n        } else {\n            parse(2)\n        }\n    }\n}\n",
    "crates/a/src/parser/mod.rs": "pub fn parse(n: u8) -> Store {\n    for i in 0..n {\n        if i > 3 { return make(); }\n    }\n    make()\n}\nfn make() -> Store { Store { n: 1, hidden: 2 } }\n#[test]\nfn test_parse() { parse(1); }\n",
    "crates/b/Cargo.toml": '[package]\nname = "beta"\n',
    "crates/b/src/main.rs": "use alpha::parser;\nfn main() { parser::parse(3); }\n",
    "crates/no/Cargo.toml": '[package]\nname = "no"\n',
    "web/helper.ts": "export function help(x: Store): Store { return x; }\n",
    "web/app.ts": "import { help } from './helper';\nexport const go = () => help(null);\n",
    "README.md": "# Top\n## Next\n",
    ".hidden/x.rs": "fn no() {}\n",
}


def put(root, files):
    for path, text in files.items():
        full = os.path.join(root, path)
        os.makedirs(os.path.dirname(full), exist_ok=True)
        with open(full, "w") as f:
            f.write(text)


def run_git(root, *args):
    subprocess.run(["git", "-C", root, "-c", "user.name=x", "-c", "user.email=x@example.com", *args], check=True, capture_output=True)


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    r = str(tmp_path_factory.mktemp("tree"))
    put(r, TREE)
    run_git(r, "init", "-q", "-b", "main")
    run_git(r, "add", "-A")
    run_git(r, "commit", "-qm", "first")
    return r


@pytest.fixture(scope="module")
def engine(spark, root, tmp_path_factory):
    return E.Engine(spark, root, wiki_folder=str(tmp_path_factory.mktemp("wiki")))


def test_tools(engine):
    call = lambda tool, /, **a: E.call(engine, tool, a)
    assert {r["name"] for r in call("lookup_symbol", name="PARSE")} == {"parse", "test_parse"}
    assert [r["name"] for r in call("search_signatures", query="struct store")] == ["Store"]
    assert call("search_relevant", query="store")[0]["name"] == "Store"
    assert {r["path"] for r in call("get_callers", symbol="Store")} >= {"crates/a/src/lib.rs", "web/helper.ts"}
    assert call("explain_symbol", name="store")[0]["children"] == {"Field": 2}
    assert [r["reason"] for r in call("get_related_tests", symbol="parse")] == ["name_convention"]
    assert {r["name"] for r in call("get_public_api", path="web")} == {"help", "go"}
    assert [r["name"] for r in call("list_declarations", path="lib.rs")] == ["Store", "Keep", "Keep for Store"]
    assert call("list_declarations", path="lib.rs", kind="Method", compact=True)["rows"][0][:2] == ["Method", "keep"]
    assert call("get_file_summary", path="mod.rs")["kinds"] == {"Function": 3}
    assert call("batch_file_summaries", glob="web/*.ts")["total_matched"] == 2
    context = call("get_file_context", path="web/helper.ts")
    assert context["imported_by"] == [{"file": "web/app.ts", "import": "import { help } from './helper'"}] and context["related"] == [{"file": "web/app.ts", "relation": "sibling"}]
    assert call("get_imports", path="web/app.ts") == ["import { help } from './helper'"]
    assert "crates/a/src/parser" in {r["path"] for r in call("get_tree", path="crates/a")}
    assert {r["language"]: r["files"] for r in call("get_stats") if r["member"] is None and r["language"] is None} == {None: 10}
    assert {m["member"] for m in call("list_workspace_members")["members"]} >= {"alpha", "beta"}
    assert call("read_source", path="lib.rs", symbol="keep")[0]["source"] == "pub trait Keep { fn keep(&self) -> Store; }"
    assert "{ ... }" in call("read_source", path="mod.rs", start=1, end=7, collapse=True)[0]["source"]
    assert call("read_source", path="mod.rs", symbols=["make", "parse"])[0]["name"] == "make"
    assert call("get_token_estimate", directory="web")["files"] == 2 and call("get_token_estimate", path="mod.rs", symbol="make")[0]["saved_percent"] > 50
    h = call("get_health")
    assert (h["functions"], h["tests"], h["analyzed"], h["max_complexity"]) == (7, 1, 6, 3) and h["hottest_files"][0]["file"].endswith("lib.rs") is False
    assert call("get_hotspots", limit=1)[0]["name"] == "parse"
    assert "web/app.ts" in call("get_dependency_graph", format="dot") and "-->" in call("get_dependency_graph")
    assert {(e["from"], e["to"]) for e in json.loads(call("get_dependency_graph", format="json"))["edges"]} == {("web/app.ts", "web/helper.ts"), ("crates/a/src/lib.rs", "crates/a/src/parser/mod.rs"), ("crates/b/src/main.rs", "crates/a/src/parser/mod.rs")}
    assert "references" in call("get_dependency_graph", level="symbol")
    flow = call("get_type_flow", type_name="store")
    assert {r["name"] for r in flow["producers"]} == {"keep", "parse", "make", "help"} and [r["name"] for r in flow["consumers"]] == ["help"]
    assert call("find", query="parse", mode="symbol") and call("summarize", target="web/*.ts")["total_matched"] == 2
    assert call("summarize", target="Store")[0]["name"] == "Store" and call("summarize", target="lib.rs")["path"].endswith("lib.rs")
    assert call("read", path="lib.rs", symbol="Store")[0]["line"] == 4
    for name, args in (("nothing", {}), ("read_source", {"path": "no.rs"}), ("lookup_symbol", {}), ("get_diff_summary", {}), ("lookup_symbol", {"name": "x", "member": "nobody"}), ("get_hotspots", {"sort_by": "x"})):
        with pytest.raises(E.ToolError):
            E.call(engine, name, args)


def test_diff_and_regenerate(engine, root):
    run_git(root, "checkout", "-qb", "work")
    put(root, {"web/helper.ts": "export function help(x: Store, y: number): Store { return x; }\nexport function more() {}\n", "web/new.ts": "export class New {}\n"})
    os.remove(f"{root}/web/app.ts")
    run_git(root, "add", "-A")
    run_git(root, "commit", "-qm", "second")
    assert sorted(git.changed_paths(root, "main")) == ["web/app.ts", "web/helper.ts", "web/new.ts"] and git.changed_paths(root, "main", "D") == ["web/app.ts"]
    assert git.commits_behind(root, subprocess.run(["git", "-C", root, "rev-parse", "main"], capture_output=True, text=True).stdout.strip()) == 1 and git.commits_behind(root, "main") is None
    delta = {(r["path"], r["name"], r["change"]) for r in engine.regenerate()}
    want = {("web/app.ts", "go", "removed"), ("web/helper.ts", "help", "modified"), ("web/helper.ts", "more", "added"), ("web/new.ts", "New", "added")}
    assert delta == want
    d = E.call(engine, "get_diff_summary", {"since_ref": "main"})
    assert [f["path"] for f in d["files_added"]] == ["web/new.ts"] and [f["path"] for f in d["files_removed"]] == ["web/app.ts"] and len(d["files_modified"][0]["changes"]) == 2
    assert "~ export function help(x: Store): Store -> export function help(x: Store, y: number): Store" in E.call(engine, "get_diff_summary", {"since_ref": "main", "format": "markdown"})
    with pytest.raises(E.ToolError):
        E.call(engine, "get_diff_summary", {"since_ref": "nowhere"})
    run_git(root, "remote", "add", "origin", "git@github.com:some/thing.git")
    assert pull_request.repository(root) == ("some", "thing")
    assert pull_request.base_ref(root, 3, lambda url, key: {"base": {"ref": "main"}} if url.endswith("/some/thing/pulls/3") else {}) == "main"
    with pytest.raises(ValueError):
        pull_request.base_ref(root, 3, lambda url, key: {"base": {"ref": "gone"}})


def test_sinks(engine):
    f, d, i = engine.files, engine.decls, engine.imports
    text = "\n".join(markdown.workspace("tree", f, d, i, "now", "full"))
    assert text.startswith("# Workspace tree") and "| alpha | " in text and "- pub `pub struct Store` (line 4)" in text and "implements Keep" in text and "> Keeps." in text
    assert "struct" not in "\n".join(markdown.index("t", f, d, i, detail="summary")).split("## Public surface")[0]
    doc = json.loads("\n".join(serialize.json_lines(f, d, i, "tree", "now")))
    lib = next(x for x in doc["files"] if x["path"].endswith("lib.rs"))
    assert [c["name"] for c in lib["declarations"][0]["children"]] == ["n", "hidden"] and lib["imports"] == ["use crate::parser::parse;"]
    yaml = list(serialize.yaml_lines(f, d, i, "tree"))
    assert '      - kind: "Struct"' in yaml and yaml[0] == 'root_name: "tree"'
    e = engine.spark.createDataFrame([('a"b', "c", "Imports"), ("c", 'a"b', "References")], "src string, dst string, kind string")
    assert '  "a\\"b" -> "c";' in list(graphs.render(e, "dot")) and "  n1 -.->|references| n0" in list(graphs.render(e, "mermaid"))
    assert len(json.loads("\n".join(graphs.render(e, "json")))["edges"]) == 2


def test_budget_ends_with_one_file(engine):
    ix = budget.Index("t", engine.files, engine.decls, engine.imports, trees.tree_entries(engine.files))
    assert budget.fitted(ix, 10**6)[1] == 0
    last, stage = budget.fitted(ix, 1)
    assert stage == 5 and last.files.count() == 1 and last.files.first().path.endswith("main.rs") and last.decls.where("depth > 0").count() == 0
    assert preflight.largest_files(engine.files, engine.decls, 1).first().path.endswith("lib.rs")


def test_cache(spark, root, tmp_path):
    c = cache.Cache(spark, str(tmp_path))
    n = c.refresh(root)["miss"]
    assert n >= 8 and c.refresh(root) == {"hit": n, "miss": 0, "pruned": 0}
    put(root, {"web/extra.ts": "export class Extra {}\n"})
    assert c.refresh(root) == {"hit": n, "miss": 1, "pruned": 0}
    os.remove(f"{root}/web/extra.ts")
    again = cache.Cache(spark, str(tmp_path))
    assert again.tables()[1].where("name = 'Extra'").count() == 1
    assert again.refresh(root) == {"hit": n, "miss": 0, "pruned": 1} and again.tables()[1].where("name = 'Extra'").count() == 0
    (tmp_path / "current.json").write_text("{broken")
    assert cache.Cache(spark, str(tmp_path)).current is None


def test_workspaces(tmp_path, root):
    assert workspace.detect(root) == ("cargo", [("alpha", "crates/a"), ("beta", "crates/b")])
    put(str(tmp_path / "n"), {"package.json": '{"workspaces": {"packages": ["packages/*", "!packages/x"]}}', "packages/p/package.json": '{"name": "@s/p"}', "packages/x/package.json": "{}", "packages/none/a.js": ""})
    assert workspace.detect(str(tmp_path / "n")) == ("npm", [("@s/p", "packages/p")])
    put(str(tmp_path / "g"), {"go.work": "go 1.22\nuse (\n  ./b\n  ./a // yes\n)\nuse ./c\n", "a/go.mod": "module x.org/y/aa\n", "b/go.mod": "module bb\n", "c/z.go": ""})
    assert workspace.detect(str(tmp_path / "g")) == ("go", [("aa", "a"), ("bb", "b"), ("c", "c")])
    assert workspace.detect(str(tmp_path)) == ("none", [(tmp_path.name, "")])
    assert workspace.segment_matches("a[b]*?", "a[b]cd") and not workspace.segment_matches("a[b]", "ab")


def test_wiki(engine, tmp_path):
    call = lambda tool, /, **a: E.call(engine, tool, a)
    assert call("wiki_contribute", content="# Parsing\n\nThe parser parses.\n\n```\n[[code]]\n```\nSee [[Store|x]] and [[store]].\n> CONTRADICTION: it doesn't\n", title="Parsing source", sources=["crates/a/src/parser/mod.rs"]) == {"id": "parsing-source"}
    call("wiki_contribute", content="All about stores", title="Store", page_type="entity", sources=["crates/a/src/lib.rs"])
    assert [r["id"] for r in call("wiki_search", query="parsing source")][0] == "parsing-source"
    assert "parser parses" in call("wiki_search", query="parser")[0]["excerpt"]
    assert call("wiki_read", page="PARSING SOURCE")["title"] == "Parsing source" and call("wiki_read", page="stor")["id"] == "store"
    with pytest.raises(E.ToolError):
        call("wiki_read", page="zzz")
    assert call("wiki_suggest_contribution", question="parsing of source text?")["action"] == "update"
    assert call("wiki_compound", question="Parsing source twice", answer="Never.", sources=["crates/a/src/parser/mod.rs"])["action"] == "update"
    assert call("wiki_compound", question="Quite unrelated", answer="Yes.")["id"] == "quite-unrelated"
    assert call("wiki_record_failure", symptom="Stack overflow deep", attempted_fix="more stack")["id"] == "stack-overflow-deep"
    assert call("wiki_record_failure", symptom="Slow", attempted_fix="wait", actual_fix="cache", page="store")["id"] == "store"
    s = call("wiki_status")
    assert (s["pages"], s["failures"], s["open_failures"], s["covered"]) == (4, 2, 1, 2) and s["commits_behind"] == 0
    assert call("wiki_search", query="overflow")[0]["unresolved_failures"] == 1
    call("wiki_contribute", content="done", page="stack-overflow-deep", resolve=True)
    assert call("wiki_status")["open_failures"] == 0
    assert "crates/a/src/lib.rs" in "".join(call("wiki_generate")["context"])
    u = call("wiki_update", since_ref="main")
    assert u["affected"] == [] and "web/new.ts" in u["changed"] and "web/helper.ts" in {r["path"] for r in u["uncovered"]}
    pages = engine.pages()
    one = pages.where("id = 'parsing-source'").select(wiki.links(pages.content).alias("l"), wiki.contradictions(pages.content).alias("c")).first()
    assert one.l == ["store"] and one.c == ["it doesn't"]
    assert wiki_store.save(pages, str(tmp_path), "r") == 4 and [r.id for r in wiki_store.load(engine.spark, str(tmp_path)).orderBy("page_ord").collect()] == [r.id for r in pages.orderBy("page_ord").collect()]
    assert wiki_store.parse_page("no header") is None and wiki.json_block('x {"a": "}"} y') == '{"a": "}"}' and wiki.json_block("```json\n[1]\n```") == "[1]" and wiki.safe_id("a/../b c") == "a-b-c"
    patterns = wiki.resolve_sources(engine.files, ["lib.rs", "web/*.ts", "alpha/crates/a/src/lib.rs"]).collect()
    assert {(r.pattern, r.path) for r in patterns} == {("lib.rs", "crates/a/src/lib.rs"), ("alpha/crates/a/src/lib.rs", "crates/a/src/lib.rs"), ("web/*.ts", "web/helper.ts"), ("web/*.ts", "web/new.ts")}


def test_writer(engine, tmp_path):
    """The wiki by a stand-in model: a plan with a gap, pages, an update after a commit."""
    e, asked, old = engine, [], engine.wiki_folder
    e.wiki_folder = str(tmp_path)
    tries = [writer.Transient("busy")]

    def ask(prompt):
        if tries:
            raise tries.pop()
        asked.append(prompt)
        return 'So: [{"id": "a/b", "title": "Parser", "page_type": "module", "source_files": ["mod.rs"]}]' if prompt.startswith("Plan") else "# Page\n\nSee [[architecture]].\n"

    try:
        slept = []
        assert writer.patient(ask, sleep=slept.append)("Plan") and slept == [1.0]
        ids = writer.generate(e, ask)
        assert ids[0] == "a-b" and "architecture" in ids and len(asked) == len(ids) + 2
        pages = {r.id: r for r in e.pages().collect()}
        assert pages["a-b"].source_files == ["crates/a/src/parser/mod.rs"] and pages["a-b"].covers == ["function:parse"] and pages["a-b"].links_to == ["architecture"] and "[[a-b]]" in pages["index"].content
        assert wiki.uncovered(e.files, e.pages()).count() == 0
        assert "fn make" in next(p for p in asked if "Parser" in p and p.startswith("Write"))
        done = writer.update(e, ask, "main")
        assert done and "a-b" not in done
        with pytest.raises(RuntimeError):
            writer.generate(e, lambda p: '[{"a": }]')
    finally:
        e.wiki_folder = old
    runs = []
    auto = writer.AutoUpdate(lambda: runs.append(1), 0.1)
    auto.start()
    for _ in range(5):
        auto.tell()
        time.sleep(0.02)
    time.sleep(0.6)
    auto.stop()
    assert runs == [1]
    assert writer.command(["cat"])("x") == "x"
    with pytest.raises(RuntimeError):
        writer.command(["false"])("x")


def test_protocol(engine):
    s = protocol.Server(engine)
    ask = lambda **x: json.loads(s.answer(json.dumps({"jsonrpc": "2.0", "id": 1, **x})))
    assert ask(method="initialize")["result"]["serverInfo"]["name"] == "lattica"
    names = {t["name"] for t in ask(method="tools/list")["result"]["tools"]}
    assert {"find", "summarize", "read", "wiki_search"} <= names and "lookup_symbol" not in names
    assert {"lookup_symbol", *names} <= {t["name"] for t in protocol.definitions(True, True)} and len(protocol.definitions(True, True)) == len(E.TOOLS)
    assert json.loads(ask(method="tools/call", params={"name": "lookup_symbol", "arguments": {"name": "keep"}})["result"]["content"][0]["text"])
    assert ask(method="tools/call", params={"name": "nope"})["result"]["isError"]
    assert ask(method="nope")["error"]["code"] == -32601 and ask(method="tools/call", params={})["error"]["code"] == -32602
    assert json.loads(s.answer("{"))["error"]["code"] == -32700 and s.answer('{"jsonrpc": "2.0", "method": "notifications/x"}') is None
    assert len(json.loads(s.answer(json.dumps([{"jsonrpc": "2.0", "id": 1, "method": "ping"}] * 2)))) == 2
    out, changes, built = io.StringIO(), queue.Queue(), []
    for _ in range(3):
        changes.put(("change", ["a"]))
    protocol.serve_lines(s, ['{"jsonrpc": "2.0", "id": 5, "method": "ping"}\n', "\n"], out, changes, lambda: built.append(1))
    assert json.loads(out.getvalue()) == {"jsonrpc": "2.0", "id": 5, "result": {}} and len(built) == 1


def test_http(engine):
    now = [0.0]
    sessions = H.Sessions(ttl=10, most=2, clock=lambda: now[0])
    httpd = H.make(protocol.Server(engine), sessions=sessions, keep_alive=0.2)
    threading.Thread(target=httpd.serve_forever, daemon=True).start()

    def ask(verb, body=None, **headers):
        c = http.client.HTTPConnection("127.0.0.1", httpd.server_port, timeout=10)
        c.request(verb, "/mcp", body if body is None or isinstance(body, str) else json.dumps(body), {k.replace("_", "-"): v for k, v in headers.items()})
        r = c.getresponse()
        return r.status, r.getheader("Mcp-Session-Id"), r.read().decode() if verb != "GET" or r.status != 200 else r

    init, ping = {"jsonrpc": "2.0", "id": 1, "method": "initialize"}, {"jsonrpc": "2.0", "id": 2, "method": "ping"}
    code, name, _ = ask("POST", init)
    assert code == 200 and name
    assert ask("POST", ping)[0] == 400 and ask("POST", ping, Mcp_Session_Id="x")[0] == 404
    assert json.loads(ask("POST", ping, Mcp_Session_Id=name)[2])["id"] == 2
    assert ask("POST", {"jsonrpc": "2.0", "method": "n"}, Mcp_Session_Id=name)[0] == 202
    assert ask("POST", "{", Mcp_Session_Id=name)[0] == 400 and ask("POST", "x" * (H.BODY + 1), Mcp_Session_Id=name)[0] == 413
    stream = ask("GET", None, Mcp_Session_Id=name)[2]
    time.sleep(0.3)
    httpd.broadcast.say({"hello": 1})
    assert any(json.loads(line[6:]) == {"hello": 1} for line in iter(lambda: stream.readline().decode(), "") if line.startswith("data: "))
    assert ask("POST", init)[0] == 200 and ask("POST", init)[0] == 503
    now[0] = 11
    assert ask("POST", ping, Mcp_Session_Id=name)[0] == 404
    name = ask("POST", init)[1]
    assert ask("DELETE", None, Mcp_Session_Id=name)[0] == 204 and ask("DELETE", None, Mcp_Session_Id=name)[0] == 404
    httpd.broadcast.closed = True
    httpd.shutdown()


def test_watcher(spark, tmp_path):
    tree = str(tmp_path / "t")
    put(tree, {"a.py": "x = 1\n", "b.txt": "", ".c.py": ""})
    seen, batches = [], []
    p = watch.Poller(tree, seen.append, debounce=100, every=0.05)
    p.start()
    q = watch.follow(spark, tree, lambda df, k: batches.append(sorted((r.path, r.change) for r in df.collect())), str(tmp_path / "check"), 200)
    deadline = time.time() + 60
    while not batches and time.time() < deadline:
        time.sleep(0.1)
    put(tree, {"a.py": "x = 22\n", "d.rs": "fn f() {}\n"})
    while (len(batches) < 2 or not seen) and time.time() < deadline:
        time.sleep(0.1)
    p.stop()
    q.stop()
    assert batches[0] == [("a.py", "added")]
    assert sorted(x for b in batches[1:] for x in b)[0] == ("a.py", "changed") and ("d.rs", "added") in [x for b in batches[1:] for x in b]
    assert sorted({x for s in seen for x in s}) == ["a.py", "d.rs"]
    assert not watch.relevant(".x/a.py") and not watch.relevant("index.md", "index.md") and watch.relevant("a/b.go")


def test_command_line(engine, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "engine", lambda a: engine)
    out = tmp_path / "index.md"
    assert cli.main(["index", engine.root, "-o", str(out), "--kind", "fn", "--public-only"]) == 0
    assert "fn parse" in out.read_text() and "fn make" not in out.read_text()
    assert cli.main(["index", engine.root, "-f", "json", "--max-tokens", "1"]) == 0 and len(json.loads(capsys.readouterr().out)["files"]) == 1
    assert cli.main(["hotspots", "--limit", "1"]) == 0 and json.loads(capsys.readouterr().out)["name"] == "parse"
    assert cli.main(["call", ".", "get_imports", '{"path": "lib.rs"}']) == 0 and "crate::parser" in capsys.readouterr().out
    assert cli.main(["diff", "--since", "nowhere"]) == 1
    assert cli.main(["graph", "-f", "dot"]) == 0 and "digraph" in capsys.readouterr().out
    assert [r for r in walk.walk(engine.root, max_depth=1)] and all("/" not in r[0] for r in walk.walk(engine.root, max_depth=1))
