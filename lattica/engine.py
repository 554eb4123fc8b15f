"""An index of a source tree as tables, and every query on it by name: what the server, the command line and a notebook
share. Results are DataFrames; only `call` makes JSON of them, at the edge."""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.collapse import collapsed
from .functions.text import line_count
from .operators import difference, graph, health, preflight, search, trees, types, wiki
from .session import ship
from .sinks import diffs, graphs, markdown
from .sources import cache, extract, git, pull_request, walk, wiki_store, workspace
from .sources.languages import chosen
from .storage import saved


class ToolError(ValueError):
    """What a caller did wrong, in words for them."""


@dataclass
class Engine:
    spark: SparkSession
    root: str
    languages: list[str] = field(default_factory=list)
    options: dict = field(default_factory=dict)
    #: A folder for the index cache; without one each build reads all files.
    cache_folder: str | None = None
    wiki_folder: str | None = None

    def __post_init__(self):
        ship(self.spark)
        self.built_at = ""
        self.build()

    def build(self) -> None:
        """Reads the tree: files, contents, declarations and imports, each with its member; written once."""
        kind, _ = workspace.detect(self.root)
        self.kind = kind
        members = workspace.members(self.spark, self.root)
        listed = walk.files(self.spark, self.root, **self.options)
        if self.languages:
            listed = listed.where(F.col("language").isin(*(chosen(self.languages) or {""})))
        texts = saved(walk.contents(listed))
        if self.cache_folder:
            store = cache.Cache(self.spark, self.cache_folder)
            store.refresh(self.root, **self.options)
            _, decls, imports = (t.join(listed.select("path"), "path", "left_semi") for t in store.tables())
        else:
            decls, imports = extract.declarations(texts), extract.imports(texts)
        owned = saved(workspace.assigned(listed.select("path"), members).select("path", F.coalesce("member", F.lit(os.path.basename(os.path.abspath(self.root)))).alias("member")))
        with_member = lambda df: df.join(owned, "path")
        lines = texts.select("path", line_count(F.col("text")).alias("lines"))
        self.members = members
        self.files = saved(with_member(listed.join(lines, "path")).select("member", "path", "language", "size", "mtime", "lines"))
        self.contents = with_member(texts)
        self.decls = saved(with_member(decls))
        self.imports = saved(with_member(imports))
        self.built_at = datetime.now(UTC).strftime("%Y-%m-%d %H:%M:%S UTC")

    # shared by tools

    def of(self, member: str | None) -> tuple[DataFrame, DataFrame, DataFrame]:
        try:
            return tuple(search.of_member(t, member) for t in (self.files, self.decls, self.imports))
        except ValueError as e:
            raise ToolError(str(e)) from e

    def file(self, path: str, member: str | None = None) -> str:
        r = search.find_file(self.of(member)[0], path).select("path").first()
        if r is None:
            raise ToolError(f"no file {path} in the index")
        return r.path

    def metrics(self, decls: DataFrame, path: str | None) -> DataFrame:
        d = decls.where(F.contains("path", F.lit(path))) if path else decls
        return d.where(F.col("kind").isin("Function", "Method") & F.col("cyclomatic").isNotNull()).withColumn("file", F.col("path"))

    def pages(self) -> DataFrame:
        if not self.wiki_folder:
            raise ToolError("there is no wiki here")
        return wiki_store.load(self.spark, self.wiki_folder)

    def save_pages(self, pages: DataFrame, only: set[str]) -> None:
        kept = saved(pages)  # read before the files it came from are replaced
        wiki_store.save(kept, self.wiki_folder, git.head(self.root), self.built_at, only)

    def regenerate(self, output: str | None = None) -> list[dict]:
        """Builds again, writes the index file if one is named, and gives back what changed."""
        files, decls = self.files, self.decls
        self.build()
        if output:
            from .sinks.rows import save

            save(output, markdown.workspace(os.path.basename(os.path.abspath(self.root)), self.files, self.decls, self.imports, self.built_at))
        return _rows(difference.in_order(difference.snapshot_delta(files, self.files, decls, self.decls)))


def _rows(df: DataFrame) -> list[dict]:
    """The rows of an answer; every query that ends here has a limit or is about one file."""
    return [r.asDict(recursive=True) for r in df.collect()]


TOOLS: dict[str, Callable] = {}
#: Shown to clients first; the others are listed on demand and can always be called.
COMPOUND = ("find", "summarize", "read")


def tool(f: Callable) -> Callable:
    TOOLS[f.__name__] = f
    return f


_SHOWN = ["member", "path", "kind", "name", "signature", "line", "visibility"]


@tool
def lookup_symbol(e: Engine, name: str, limit: int = 50, member: str | None = None):
    """Declarations by a part of their name."""
    return _rows(search.lookup_symbol(e.of(member)[1], name, limit).select(*_SHOWN, F.substring("doc_comment", 1, 120).alias("doc")))


@tool
def search_signatures(e: Engine, query: str, limit: int = 20, member: str | None = None):
    """Declarations by a part of their signature."""
    return _rows(search.search_signatures(e.of(member)[1], query, limit).select(*_SHOWN))


@tool
def search_relevant(e: Engine, query: str, limit: int = 20, kind: str | None = None, member: str | None = None):
    """Files and declarations, the most relevant first."""
    files, decls, _ = e.of(member)
    return _rows(search.search_relevant(decls, files, query, limit, kind))


@tool
def get_callers(e: Engine, symbol: str, limit: int = 20, member: str | None = None):
    """Imports and signatures in which a symbol stands as a word."""
    _, decls, imports = e.of(member)
    return _rows(search.callers(decls, imports, symbol, limit))


@tool
def explain_symbol(e: Engine, name: str, member: str | None = None):
    """Declarations of a name with their metadata and children."""
    return _rows(search.explain_symbol(e.of(member)[1], name))


@tool
def get_related_tests(e: Engine, symbol: str, path: str | None = None, member: str | None = None):
    """Tests that name a symbol."""
    return _rows(search.related_tests(e.of(member)[1], symbol, path))


@tool
def get_public_api(e: Engine, path: str = "", limit: int = 100, member: str | None = None):
    """Public declarations below a path."""
    return _rows(search.public_api(e.of(member)[1], path, limit).select(*_SHOWN))


@tool
def list_declarations(e: Engine, path: str, kind: str | None = None, shallow: bool = False, compact: bool = False, member: str | None = None):
    """A file's declarations."""
    d = e.of(member)[1]
    some = search.list_declarations(d, e.file(path, member), kind)
    out = search.shallow(d, some) if shallow else some.select(*_SHOWN, "decl_ord")
    columns = ["kind", "name", "signature", "line"]
    if compact:
        return {"columns": columns, "rows": [json.loads(r.compact) for r in search.compact(out, columns).orderBy("decl_ord").select("compact").collect()]}
    return _rows(out.orderBy("decl_ord").drop("decl_ord"))


@tool
def get_file_summary(e: Engine, path: str, member: str | None = None):
    """Counts and top-level declarations of a file."""
    files, decls, _ = e.of(member)
    p = e.file(path, member)
    one = search.file_summaries(decls.where(F.col("path") == p), files.where(F.col("path") == p))
    return _rows(one)[0] | {"top": list_declarations(e, p, shallow=True, member=member)}


@tool
def batch_file_summaries(e: Engine, paths: list[str] | None = None, glob: str | None = None, limit: int = 30, member: str | None = None):
    """Summaries of several files."""
    files, decls, _ = e.of(member)
    found, n = search.batch_summaries(decls, files, paths, glob, limit)
    return {"total_matched": n, "files": _rows(found.orderBy(F.split("path", "/")))}


@tool
def get_file_context(e: Engine, path: str, member: str | None = None):
    """A file's summary, who imports it, its tests and the files beside it."""
    files, _, imports = e.of(member)
    p = e.file(path, member)
    return get_file_summary(e, p, member) | {"imported_by": _rows(search.imported_by(imports, p).orderBy("file")), "related": _rows(search.related_files(files, p).orderBy(F.col("relation") != "test", F.split("file", "/")))}


@tool
def get_imports(e: Engine, path: str, member: str | None = None):
    """A file's imports."""
    return [r.text for r in e.of(member)[2].where(F.col("path") == e.file(path, member)).orderBy("import_ord").select("text").collect()]


@tool
def get_tree(e: Engine, path: str | None = None, member: str | None = None):
    """Folders and files."""
    return _rows(trees.tree(e.of(member)[0], path).orderBy("member", F.split("path", "/")))


@tool
def get_stats(e: Engine, member: str | None = None):
    """Files and lines, by member and language and in all."""
    return _rows(trees.stats(e.of(member)[0]).orderBy("member", "language"))


@tool
def list_workspace_members(e: Engine):
    """Members with their sizes."""
    return {"kind": e.kind, "members": _rows(search.members(e.files, e.decls).orderBy("member"))}


@tool
def read_source(e: Engine, path: str, symbol: str | None = None, symbols: list[str] | None = None, start: int | None = None, end: int | None = None, expand: int = 0, collapse: bool = False, member: str | None = None):
    """Source of symbols or lines."""
    p = e.file(path, member)
    text = e.contents.where(F.col("path") == p)
    if symbols or symbol:
        out = search.read_symbols(text, e.of(member)[1].where(F.col("path") == p), symbols or [symbol])
        if expand and symbol:
            r = out.first()
            if r is None:
                raise ToolError(f"no symbol {symbol} in {p}")
            n = r.source.count("\n")
            out = search.read_lines(text, r.line - expand, r.line + n + expand)
        else:
            out = out.orderBy("ord")
    elif start is not None:
        out = search.read_lines(text, start, end if end is not None else start + 199)
    else:
        raise ToolError("a symbol or lines are needed")
    if collapse:
        out = out.withColumn("source", collapsed(F.col("source")))
    found = _rows(out.select(*[c for c in ("path", "name", "line", "source") if c in out.columns]))
    if not found:
        raise ToolError(f"nothing found in {p}")
    return found


@tool
def get_token_estimate(e: Engine, path: str | None = None, symbol: str | None = None, directory: str | None = None, glob: str | None = None, member: str | None = None):
    """What reading would cost."""
    files, decls, _ = e.of(member)
    if path and symbol:
        p = e.file(path, member)
        return _rows(search.symbol_tokens(e.contents.where(F.col("path") == p), decls.where(F.col("path") == p), symbol))
    if path:
        files = files.where(F.col("path") == e.file(path, member))
    one, top = search.token_estimates(files, directory, glob)
    return _rows(one)[0] | {"breakdown": _rows(top)}


@tool
def get_health(e: Engine, path: str | None = None, member: str | None = None):
    """Aggregates of complexity, tests and documentation."""
    return health.health_of(e.of(member)[1], path)


@tool
def get_hotspots(e: Engine, limit: int = 20, min_complexity: int = 1, sort_by: str = "score", path: str | None = None, member: str | None = None):
    """The most complex functions."""
    m = e.metrics(e.of(member)[1], path)
    try:
        return _rows(health.hotspots(m, min(limit, 100), min_complexity, sort_by).select("file", "name", "kind", "line", "cyclomatic", "nesting", "params", "body_lines", "score"))
    except ValueError as x:
        raise ToolError(str(x)) from x


@tool
def get_dependency_graph(e: Engine, level: str = "file", scope: str | None = None, depth: int | None = None, format: str = "mermaid", member: str | None = None):
    """Imports between files, or relations and references between symbols."""
    files, decls, imports = e.of(member)
    if level not in ("file", "symbol") or format not in ("mermaid", "dot", "json"):
        raise ToolError("level is file or symbol, format is mermaid, dot or json")
    edges = graph.file_graph(imports, files, scope, depth) if level == "file" else graph.symbol_graph(decls, scope, depth)
    return "\n".join(graphs.render(saved(edges), format))


@tool
def get_type_flow(e: Engine, type_name: str, limit: int = 50, include_fields: bool = False, member: str | None = None):
    """Who gives back and who takes a type."""
    f = _rows(types.type_flow(e.of(member)[1], type_name, limit, include_fields))
    return {"producers": [r for r in f if r["role"] == "producer"], "consumers": [r for r in f if r["role"] == "consumer"]}


@tool
def get_diff_summary(e: Engine, since_ref: str | None = None, pr: int | None = None, format: str = "json"):
    """What commits since a ref, or a pull request, did to declarations."""
    if (since_ref is None) == (pr is None):
        raise ToolError("exactly one of since_ref and pr is needed")
    try:
        ref = since_ref if since_ref is not None else pull_request.base_ref(e.root, pr)
        d = git.diff_since(e.spark, e.root, ref, e.contents.select("path", "language", "text"))
    except ValueError as x:
        raise ToolError(str(x)) from x
    return "\n".join(diffs.markdown(d, ref)) if format == "markdown" else json.loads(diffs.as_json(d, ref))


@tool
def regenerate_index(e: Engine, output: str | None = None):
    """Builds the index again."""
    return e.regenerate(output)


@tool
def find(e: Engine, query: str, mode: str = "relevant", limit: int = 20, member: str | None = None):
    """Finds by relevance, name, signature, callers or type."""
    modes = {"relevant": search_relevant, "symbol": lookup_symbol, "signature": search_signatures, "callers": get_callers}
    if mode == "type":
        return get_type_flow(e, query, limit, member=member)
    if mode not in modes:
        raise ToolError(f"mode is one of {[*modes, 'type']}")
    return modes[mode](e, query, limit=limit, member=member)


@tool
def summarize(e: Engine, target: str, public: bool = False, member: str | None = None):
    """A glob's files, a name's declarations, a path's public declarations, or a file's summary."""
    if any(c in target for c in "*?[{"):
        return batch_file_summaries(e, glob=target, member=member)
    if not search.looks_like_file(target) and "/" not in target and not search.is_directory(e.files, target):
        return explain_symbol(e, target, member)
    if public or search.is_directory(e.files, target):
        return get_public_api(e, target, member=member)
    return get_file_summary(e, target, member)


@tool
def read(e: Engine, path: str, symbol: str | None = None, symbols: list[str] | None = None, start: int | None = None, end: int | None = None, collapse: bool = False, member: str | None = None):
    """Source of symbols or lines."""
    return read_source(e, path, symbol, symbols, start, end, collapse=collapse, member=member)


# the wiki


@tool
def wiki_search(e: Engine, query: str, limit: int = 5):
    """Pages, the best first."""
    return _rows(wiki.search(e.pages(), query, limit))


@tool
def wiki_read(e: Engine, page: str):
    """One page."""
    r = wiki.read(e.pages(), page).first()
    if r is None:
        raise ToolError(f"no page {page}; there are: " + ", ".join(x.id for x in e.pages().orderBy("page_ord").select("id").limit(50).collect()))
    return r.asDict(recursive=True)


@tool
def wiki_status(e: Engine):
    """Pages, coverage, and what is open."""
    pages = e.pages()
    ref = pages.agg(F.max("generated_at_ref").alias("r")).first().r or ""
    return _rows(wiki.status(pages))[0] | _rows(wiki.coverage(e.files, pages))[0] | {"by_type": {r.page_type: r.pages for r in wiki.by_type(pages).collect()}, "commits_behind": git.commits_behind(e.root, ref)}


@tool
def wiki_contribute(e: Engine, content: str, title: str | None = None, page: str | None = None, page_type: str = "topic", sources: list[str] | None = None, resolve: bool = False):
    """Writes a page."""
    try:
        out = wiki.contribute(e.pages(), content, title, page, page_type, tuple(sources or ()), resolve, e.built_at, git.head(e.root))
    except ValueError as x:
        raise ToolError(str(x)) from x
    wanted = page or wiki.slug(title)
    e.save_pages(out, {wanted})
    return {"id": wanted}


@tool
def wiki_compound(e: Engine, question: str, answer: str, sources: list[str] | None = None):
    """Takes an answer up into the wiki."""
    out, what = wiki.compound(e.pages(), question, answer, tuple(sources or ()), now=e.built_at)
    e.save_pages(out, {what["id"]})
    return what


@tool
def wiki_suggest_contribution(e: Engine, question: str, content: str = "", sources: list[str] | None = None):
    """Where an answer would go."""
    return wiki.suggest(e.pages(), question, content, sources or [])


@tool
def wiki_record_failure(e: Engine, symptom: str, attempted_fix: str, actual_fix: str | None = None, sources: list[str] | None = None, page: str | None = None):
    """Notes what went wrong and what helped."""
    try:
        out, where = wiki.record_failure(e.pages(), symptom, attempted_fix, actual_fix, tuple(sources or ()), page, e.built_at)
    except ValueError as x:
        raise ToolError(str(x)) from x
    e.save_pages(out, {where})
    return {"id": where}


@tool
def wiki_generate(e: Engine):
    """What a writer of the wiki needs: the tree's files with their public names, and its groups."""
    ctx = wiki.planning_context(e.files, e.decls)
    return {"context": [r.summary for r in ctx.orderBy(F.split("path", "/")).collect()], "groups": _rows(preflight.groups(e.files, preflight.group_key(F.col("path"), F.lit("")))), "stats": get_stats(e)}


@tool
def wiki_update(e: Engine, since_ref: str | None = None):
    """Pages whose sources changed, files that no page covers, and what changed in them."""
    pages = e.pages()
    ref = since_ref or pages.agg(F.max("generated_at_ref").alias("r")).first().r
    if not ref:
        raise ToolError("the wiki names no ref; give one")
    try:
        paths = git.changed_paths(e.root, ref)
    except ValueError as x:
        raise ToolError(str(x)) from x
    changed = e.spark.createDataFrame([(p,) for p in paths], "path string")
    return {
        "since_ref": ref, "changed": paths, "affected": [r.id for r in wiki.affected(pages, changed).select("id").orderBy("id").collect()],
        "uncovered": _rows(wiki.uncovered(e.files, pages).select("path", "lines").orderBy(F.split("path", "/"))), "repair": _rows(wiki.repair_groups(e.files, pages).orderBy("folder")),
        "diff": get_diff_summary(e, since_ref=ref),
    }


WIKI_TOOLS = tuple(n for n in TOOLS if n.startswith("wiki_"))


def call(e: Engine, name: str, arguments: dict | None = None):
    """A tool's answer as plain values; ToolError for what the caller can mend."""
    f = TOOLS.get(name)
    if f is None:
        raise ToolError(f"unknown tool {name}")
    try:
        return f(e, **(arguments or {}))
    except TypeError as x:
        if f.__name__ in str(x):
            raise ToolError(str(x).replace(f"{f.__name__}()", name)) from x
        raise
