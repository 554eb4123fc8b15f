"""The knowledge wiki as a table: search, reading, scoring, contributions as upserts, coverage and status.

A page: page_ord (order in the store), id, title, page_type, source_files, generated_at_ref, generated_at, links_to,
covers, contradictions and failures (arrays of structs with resolved_at), content.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship

PAGE = """page_ord long, id string, title string, page_type string, source_files array<string>, generated_at_ref string, generated_at string, links_to array<string>, covers array<string>,
contradictions array<struct<description:string,source:string,detected_at:string,resolved_at:string>>,
failures array<struct<symptom:string,attempted_fix:string,actual_fix:string,source_files:array<string>,recorded_at:string,resolved_at:string>>, content string"""
TYPES = ("index", "architecture", "module", "entity", "topic")


def _has(text: Column, word: str) -> Column:
    return F.contains(text, F.lit(word))


def _any(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | _has(text, w)
    return out


def search_score(query: str) -> Column:
    """Title, id, what the page covers, content, source files and the first failure that matches; all add up."""
    q = query.lower()
    words = q.split()
    pick = lambda text, whole, part: F.when(_has(text, q), whole).when(_any(text, words), part).otherwise(0)
    title, content = F.lower("title"), F.lower("content")
    score = F.when(title == q, 100).otherwise(pick(title, 50, 25)) + pick(F.lower("id"), 40, 15)
    score = score + F.aggregate(F.coalesce("covers", F.array().cast("array<string>")), F.lit(0), lambda n, c: n + pick(F.lower(c), 30, 10))
    hits = sum([F.when(_has(content, w), 5).otherwise(0) for w in words], F.lit(0))
    score = score + F.when(_has(content, q), 20).otherwise(hits)
    score = score + F.when(F.exists("source_files", lambda f: _any(F.lower(f), words)), 10).otherwise(0)
    first = F.filter("failures", lambda f: _has(F.lower(f["symptom"]), q) | _any(F.lower(f["symptom"]), words))
    symptom = F.lower(F.get(first, F.lit(0))["symptom"])
    return (score + F.when(symptom.isNull(), 0).otherwise(F.when(_has(symptom, q), 25).otherwise(8))).cast("long")


def excerpt(content: Column, query: str, size: int = 150) -> Column:
    """About `size` characters around the first match of the query, else of one of its words, cut at lines' ends; without
    a match the beginning."""
    q = query.lower()
    words = [q, *q.split()]

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        def one(text: str) -> str:
            low = text.lower()
            at = next((i for w in words if (i := low.find(w)) >= 0), -1)
            start, end = (0, min(len(text), size)) if at < 0 else (max(0, at - size // 2), min(len(text), at + size // 2))
            if start:
                cut = text.find("\n", start, at)
                start = cut + 1 if cut >= 0 else start
            if end < len(text):
                cut = text.rfind("\n", max(at, start), end)
                end = cut if cut > start else end
            return ("..." if start else "") + text[start:end].strip() + ("..." if end < len(text) else "")

        return s.map(one, na_action="ignore")

    return run(content)


def unresolved(items: str) -> Column:
    """How many of an array's structs have no resolved_at; null: none."""
    return F.greatest(F.size(F.filter(items, lambda x: x["resolved_at"].isNull())), F.lit(0))


def search(pages: DataFrame, query: str, limit: int = 5) -> DataFrame:
    """The best pages with score, excerpt and open contradictions and failures; ties in the store's order."""
    ship(pages.sparkSession)
    top = pages.withColumn("score", search_score(query)).where("score > 0").orderBy(F.desc("score"), "page_ord").limit(limit)
    return top.select("page_ord", "id", "title", "page_type", "score", excerpt(F.col("content"), query).alias("excerpt"), unresolved("contradictions").alias("unresolved_contradictions"), unresolved("failures").alias("unresolved_failures"))


def read(pages: DataFrame, name: str) -> DataFrame:
    """One page: by its id; else by id or title, whatever the case; else by a part of either; else none."""
    n = name.lower()
    how = F.when(F.col("id") == name, 0).when((F.lower("id") == n) | (F.lower("title") == n), 1).when(_has(F.lower("id"), n) | _has(F.lower("title"), n), 2)
    return pages.withColumn("how", how).where("how is not null").orderBy("how", "page_ord").limit(1).drop("how")


def contribution_score(question: str, content: str, sources: list[str]) -> Column:
    """How well a page takes up an answer: 50 for a shared source, 10 for each word of the title, 2 for each in the first
    thousand bytes of its body (after its heading)."""
    words = [w for w in re.split(r"\s+", f"{question} {content}".lower().strip()) if len(w.encode()) >= 4]
    body = F.lower(F.substring(F.regexp_replace("content", r"^\s*#[^\n]*\n", ""), 1, 1000))
    title = F.lower("title")
    # repeats count: every word adds, so each different one is tested once and weighed
    weigh = lambda text, points: sum([F.when(_has(text, w), points * words.count(w)).otherwise(0) for w in dict.fromkeys(words)], F.lit(0))
    shared = F.arrays_overlap("source_files", F.array(*map(F.lit, sources))) if sources else F.lit(False)
    return (F.when(F.coalesce(shared, F.lit(False)), 50).otherwise(0) + weigh(title, 10) + weigh(body, 2)).cast("long")


def score_pages(pages: DataFrame, question: str, content: str = "", sources: list[str] | None = None) -> DataFrame:
    """Pages with a score above 0, the best first; the index page takes nothing up."""
    s = pages.where("page_type <> 'index'").withColumn("score", contribution_score(question, content, sources or []))
    return s.where("score > 0").orderBy(F.desc("score"), "page_ord")


def suggest(pages: DataFrame, question: str, content: str = "", sources: list[str] | None = None, least: int = 20) -> dict:
    """{action: update, id, score} of the best page if it scores enough, else {action: create, id: a free id}."""
    best = score_pages(pages, question, content, sources).select("id", "score").first()
    if best and best.score >= least:
        return {"action": "update", "id": best.id, "score": best.score}
    return {"action": "create", "id": free_id(pages, slug(question)), "score": best.score if best else 0}


def slug(text: str, most: int = 60) -> str:
    """Lower-case letters, digits and single dashes."""
    return re.sub(r"[^a-z0-9]+", "-", text.lower()).strip("-")[:most].strip("-") or "topic"


def free_id(pages: DataFrame, wanted: str, most: int = 100) -> str:
    """The id, or with -2, -3, ... the first that no page has."""
    taken = {r.id for r in pages.where((F.col("id") == wanted) | F.startswith("id", F.lit(wanted + "-"))).where(F.length("id") <= len(wanted) + 4).select("id").limit(10 * most).collect()}
    return next(c for c in [wanted, *[f"{wanted}-{i}" for i in range(2, 11 * most)]] if c not in taken)


def upsert(pages: DataFrame, changed: DataFrame) -> DataFrame:
    """The store with the changed pages in the places of those of the same id, new ones at the end."""
    old = pages.join(F.broadcast(changed.select("id")), "id", "left_anti")
    last = pages.agg(F.coalesce(F.max("page_ord"), F.lit(-1)).alias("last")).first()["last"]  # one row
    place = changed.drop("page_ord").join(pages.select("id", "page_ord"), "id", "left")
    new = place.withColumn("page_ord", F.coalesce("page_ord", F.lit(last + 1)).cast("long"))
    return old.select(*pages.columns).unionByName(new.select(*pages.columns))


def _page(pages: DataFrame, **values) -> DataFrame:
    base = {"page_ord": None, "title": None, "page_type": "topic", "source_files": [], "generated_at_ref": "", "generated_at": "", "links_to": [], "covers": [], "contradictions": [], "failures": [], "content": ""}
    return pages.sparkSession.createDataFrame([base | values], pages.schema)


def _merged(a: str, more: list[str]) -> Column:
    return F.array_union(F.coalesce(a, F.array().cast("array<string>")), F.array(*map(F.lit, more)).cast("array<string>"))


def contribute(pages: DataFrame, content: str, title: str | None = None, page_id: str | None = None, page_type: str = "topic", sources: tuple[str, ...] = (), resolve: bool = False, now: str = "", ref: str = "") -> DataFrame:
    """The store after a page was written: an existing id is replaced in content (and title, if given), with its sources
    merged and, with `resolve`, its open contradictions and failures resolved; a new page needs a title."""
    page_id = page_id or (slug(title) if title else None)
    if page_id is None:
        raise ValueError("a title or an id is needed")
    old = pages.where(F.col("id") == page_id)
    if old.isEmpty():
        if not title:
            raise ValueError("a new page needs a title")
        return upsert(pages, _page(pages, id=page_id, title=title, page_type=page_type, source_files=list(dict.fromkeys(sources)), content=content, generated_at=now, generated_at_ref=ref))
    new = old.withColumns({"content": F.lit(content), "title": F.lit(title) if title else F.col("title"), "source_files": _merged("source_files", list(sources)), "generated_at": F.lit(now), "generated_at_ref": F.lit(ref)})
    if resolve:
        done = lambda items: F.transform(items, lambda x: x.withField("resolved_at", F.coalesce(x["resolved_at"], F.lit(now))))
        new = new.withColumns({c: done(c).cast(pages.schema[c].dataType) for c in ("contradictions", "failures")})
    return upsert(pages, new.select(*pages.columns))


def compound(pages: DataFrame, question: str, answer: str, sources: tuple[str, ...] = (), links: tuple[str, ...] = (), now: str = "") -> tuple[DataFrame, dict]:
    """The store with an answer taken up: as a section of the best page, if one scores enough, else as a new topic."""
    what = suggest(pages, question, answer, list(sources))
    if what["action"] == "update":
        old = pages.where(F.col("id") == what["id"])
        section = f"\n\n## {question}\n\n{answer}\n"
        new = old.withColumns({"content": F.concat(F.rtrim("content"), F.lit(section)), "links_to": _merged("links_to", list(links)), "source_files": _merged("source_files", list(sources)), "generated_at": F.lit(now)})
        return upsert(pages, new.select(*pages.columns)), what
    page = _page(pages, id=what["id"], title=question, source_files=list(sources), links_to=list(links), content=f"# {question}\n\n{answer}\n", generated_at=now)
    return upsert(pages, page), what


def record_failure(pages: DataFrame, symptom: str, attempted_fix: str, actual_fix: str | None = None, sources: tuple[str, ...] = (), page_id: str | None = None, now: str = "", least: int = 25) -> tuple[DataFrame, str]:
    """(the store with the failure on its page, the page's id): the page named, else the best that scores enough, else a
    new one. A failure with its actual fix is resolved."""
    if page_id is None:
        what = suggest(pages, symptom, attempted_fix, list(sources), least)
        page_id = what["id"]
        if what["action"] == "create":
            pages = upsert(pages, _page(pages, id=page_id, title=symptom, content=f"# {symptom}\n", source_files=list(sources), generated_at=now))
    elif pages.where(F.col("id") == page_id).isEmpty():
        raise ValueError(f"unknown page {page_id}")
    entry = F.struct(F.lit(symptom).alias("symptom"), F.lit(attempted_fix).alias("attempted_fix"), F.lit(actual_fix).cast("string").alias("actual_fix"), F.array(*map(F.lit, sources)).cast("array<string>").alias("source_files"), F.lit(now).alias("recorded_at"), F.lit(now if actual_fix else None).cast("string").alias("resolved_at"))
    kind = pages.schema["failures"].dataType
    new = pages.where(F.col("id") == page_id).withColumn("failures", F.concat(F.coalesce("failures", F.array().cast(kind)), F.array(entry).cast(kind)))
    return upsert(pages, new.select(*pages.columns)), page_id


# coverage and status


def source_pages(pages: DataFrame) -> DataFrame:
    """(path, id): a row for each source file of each page."""
    return pages.select(F.explode("source_files").alias("path"), "id").distinct()


def uncovered(files: DataFrame, pages: DataFrame) -> DataFrame:
    return files.join(source_pages(pages).select("path").distinct(), "path", "left_anti")


def affected(pages: DataFrame, changed: DataFrame) -> DataFrame:
    """The pages one of whose source files changed; the index never."""
    ids = source_pages(pages).join(changed.select("path").distinct(), "path", "left_semi").select("id").distinct()
    return pages.where("page_type <> 'index'").join(ids, "id", "left_semi")


def coverage(files: DataFrame, pages: DataFrame) -> DataFrame:
    """One row: files, covered, uncovered, percent (whole)."""
    c = files.select("path").distinct().join(source_pages(pages).select("path", F.lit(1).alias("c")).distinct(), "path", "left")
    return c.agg(F.count("*").alias("files"), F.count("c").alias("covered")).select("files", "covered", (F.col("files") - F.col("covered")).alias("uncovered"), F.format_string("%.0f%%", 100.0 * F.col("covered") / F.greatest("files", F.lit(1))).alias("percent"))


def by_type(pages: DataFrame) -> DataFrame:
    return pages.groupBy("page_type").agg(F.count("*").alias("pages"))


def status(pages: DataFrame) -> DataFrame:
    """One row: pages, all and open contradictions and failures."""
    total = lambda c: F.coalesce(F.sum(F.greatest(F.size(c), F.lit(0))), F.lit(0)).alias(c)
    open_ = lambda c: F.coalesce(F.sum(unresolved(c)), F.lit(0)).alias(f"open_{c}")
    return pages.agg(F.count("*").alias("pages"), total("contradictions"), open_("contradictions"), total("failures"), open_("failures"))


def public_covers(decls: DataFrame, paths: DataFrame) -> DataFrame:
    """(path, covers): kind:name of each public top-level declaration of these paths, in order."""
    d = decls.where("visibility = 'Public' and depth = 0").join(paths.select("path").distinct(), "path", "left_semi")
    return d.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("decl_ord", F.concat_ws(":", F.lower("kind"), "name").alias("c")))), lambda x: x["c"]).alias("covers"))


def planning_context(files: DataFrame, decls: DataFrame, most: int = 100_000) -> DataFrame:
    """(path, summary): files in order with their public names, until the first that no longer fits in `most` bytes."""
    from .order import running

    names = public_covers(decls, files)
    f = files.join(names, "path", "left")
    text = F.concat(F.lit("- "), "path", F.lit(" ("), "language", F.lit(", "), "lines", F.lit(" lines): "), F.coalesce(F.array_join("covers", ", "), F.lit("")))
    f = f.select("path", text.alias("summary")).withColumns({"size": F.octet_length("summary") + 1, "one": F.lit(1)})
    return running(f, ["one"], [F.split("path", "/")], "size", "before", "all").where(F.col("before") + F.col("size") <= most).select("path", "summary")


def repair_groups(files: DataFrame, pages: DataFrame, least_files: int = 3, least_lines: int = 500) -> DataFrame:
    """Of uncovered files, by folder: (folder, files, lines, target): the page with most sources in the folder, else
    'module' where it is large enough for one of its own, else 'architecture'."""
    folder = lambda c: F.when(F.contains(c, F.lit("/")), F.regexp_replace(c, "/[^/]*$", "")).otherwise(".")
    g = uncovered(files, pages).groupBy(folder(F.col("path")).alias("folder")).agg(F.count("*").alias("files"), F.sum("lines").alias("lines"))
    near = source_pages(pages).groupBy(folder(F.col("path")).alias("folder"), "id").agg(F.count("*").alias("n"))
    best = near.groupBy("folder").agg(F.max(F.struct("n", "id"))["id"].alias("id"))
    own = F.when((F.col("files") >= least_files) | (F.col("lines") >= least_lines), "module").otherwise("architecture")
    return g.join(best, "folder", "left").select("folder", "files", "lines", F.coalesce("id", own).alias("target"))


def resolve_sources(files: DataFrame, patterns: list[str]) -> DataFrame:
    """(pattern, path) of the files that a page's sources mean: a member's name before the path, an exact path, a glob, or
    a file's bare name."""
    from ..functions.text import glob_regex

    out = None
    for p in patterns:
        marks = any(c in p for c in "*?[{")
        hit = F.regexp_like("path", F.lit(glob_regex(p))) if marks else (F.col("path") == p) | (F.concat_ws("/", "member", "path") == p)
        if not marks and "/" not in p:
            hit = hit | (F.substring_index("path", "/", -1) == p)
        one = files.where(hit).select(F.lit(p).alias("pattern"), "path")
        out = one if out is None else out.unionByName(one)
    return out if out is not None else files.sparkSession.createDataFrame([], "pattern string, path string")


# text of pages

_LINK = r"\[\[([^\]|#]+)(?:[|#][^\]]*)?\]\]"


def outside_fences(content: Column) -> Column:
    """The lines of a text that stand in no code fence: a running parity of fence lines."""
    lines = F.split(content, "\n")
    step = lambda a, x: F.struct((a["open"] != F.startswith(F.ltrim(x), F.lit("```"))).alias("open"), F.when(~a["open"] & ~F.startswith(F.ltrim(x), F.lit("```")), F.concat(a["out"], F.array(x))).otherwise(a["out"]).alias("out"))
    return F.aggregate(lines, F.struct(F.lit(False).alias("open"), F.array().cast("array<string>").alias("out")), step)["out"]


def links(content: Column) -> Column:
    """Ids linked as [[id]], outside code, in order and once each."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.array_join(outside_fences(content), "\n"), F.lit(_LINK), F.lit(1)), lambda x: F.lower(F.trim(x))))


def contradictions(content: Column) -> Column:
    """What stands after `CONTRADICTION:` at the beginning of a line, outside code."""
    lines = F.filter(outside_fences(content), lambda x: F.regexp_like(F.trim(x), F.lit("^[>*\\- ]*CONTRADICTION:")))
    return F.transform(lines, lambda x: F.trim(F.regexp_replace(x, "^.*?CONTRADICTION:", "")))


def json_block(text: str) -> str | None:
    """The JSON in a reply: fenced, else from the first bracket to the one that closes it."""
    if m := re.search(r"```(?:json)?\s*\n(.*?)```", text, re.S):
        return m[1].strip()
    for i, c in enumerate(text):
        if c in "{[":
            depth, quoted, k = 0, False, i
            while k < len(text):
                x = text[k]
                if quoted:
                    k += x == "\\"
                    quoted = x != '"'
                elif x == '"':
                    quoted = True
                else:
                    depth += (x in "{[") - (x in "}]")
                    if depth == 0:
                        return text[i : k + 1]
                k += 1
            return None
    return None


def safe_id(text: str) -> str:
    """An id that is a plain file name."""
    return re.sub(r"[^A-Za-z0-9_-]+", "-", text).strip("-") or "page"
