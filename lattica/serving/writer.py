"""Writing the wiki with a language model: a plan, its pages one after another, and an index page. The model is a function
from a prompt to a reply, or a command that reads the one and prints the other; everything else is tables."""

from __future__ import annotations

import json
import subprocess
import threading
import time
from collections.abc import Callable

from pyspark.sql import functions as F

from .. import engine as E
from ..operators import wiki
from ..sources import git

Ask = Callable[[str], str]
#: Seconds before the second and third try of a request that failed for a passing reason.
PAUSES = (1.0, 2.0)
SOURCE_BYTES = 100_000


class Transient(RuntimeError):
    """A failure that may pass: busy, timed out, cut off."""


def command(argv: list[str], timeout: float = 300) -> Ask:
    """A provider that is a program: the prompt on its input, the reply on its output."""

    def ask(prompt: str) -> str:
        try:
            r = subprocess.run(argv, input=prompt, capture_output=True, text=True, timeout=timeout)
        except subprocess.TimeoutExpired as e:
            raise Transient("timed out") from e
        if r.returncode:
            text = (r.stderr or r.stdout).strip()
            raise (Transient if any(w in text.lower() for w in ("rate limit", "overloaded", "timeout", "429", "503")) else RuntimeError)(text[:500])
        return r.stdout

    return ask


def patient(ask: Ask, pauses: tuple[float, ...] = PAUSES, sleep: Callable[[float], None] = time.sleep) -> Ask:
    def again(prompt: str) -> str:
        for pause in pauses:
            try:
                return ask(prompt)
            except Transient:
                sleep(pause)
        return ask(prompt)

    return again


def plan(e: E.Engine, ask: Ask) -> list[dict]:
    """[{id, title, page_type, source_files}] as the model plans them, with ids made safe and sources that exist; what is
    left uncovered is added to the pages nearest to it."""
    context = "\n".join(r.summary for r in wiki.planning_context(e.files, e.decls).orderBy(F.split("path", "/")).collect())
    reply = ask(f"Plan the pages of a wiki of this source tree. Answer with a JSON array of objects with id, title, page_type (architecture, module, entity or topic) and source_files.\n\n{context}\n")
    try:
        raw = json.loads(wiki.json_block(reply) or "[]")
    except ValueError as x:
        raise RuntimeError("the plan is no JSON") from x
    out: list[dict] = []
    for p in raw if isinstance(raw, list) else raw.get("pages", []):
        found = wiki.resolve_sources(e.files, [str(s) for s in p.get("source_files") or []])
        sources = [r.path for r in found.select("path").distinct().orderBy(F.split("path", "/")).collect()]
        kind = p.get("page_type") if p.get("page_type") in wiki.TYPES[1:] else "topic"
        out.append({"id": wiki.safe_id(str(p.get("id") or wiki.slug(str(p.get("title", ""))))), "title": str(p.get("title") or p.get("id")), "page_type": kind, "source_files": sources})
    return repaired(e, list({p["id"]: p for p in out}.values()))


def repaired(e: E.Engine, pages: list[dict]) -> list[dict]:
    """The plan with every file on some page: uncovered files of a folder go to the page with most sources there, else to
    a page of their own if they are many or long, else to the architecture."""
    schema = "id string, page_type string, source_files array<string>"
    table = e.spark.createDataFrame([(p["id"], p["page_type"], p["source_files"]) for p in pages], schema)
    groups = {r.folder: r.target for r in wiki.repair_groups(e.files, table).collect()}
    by = {p["id"]: p for p in pages}
    folder = F.when(F.contains("path", F.lit("/")), F.regexp_replace("path", "/[^/]*$", "")).otherwise(".")
    for r in wiki.uncovered(e.files, table).select("path", folder.alias("folder")).orderBy(F.split("path", "/")).toLocalIterator():
        target = groups[r.folder]
        if target == "module" and target not in by:
            target = wiki.safe_id(f"module-{r.folder}")
            by.setdefault(target, {"id": target, "title": r.folder.rsplit("/", 1)[-1].replace("_", " ").title(), "page_type": "module", "source_files": []})
        elif target not in by:
            by.setdefault(target, {"id": target, "title": "Architecture", "page_type": "architecture", "source_files": []})
        by[target]["source_files"].append(r.path)
    return list(by.values())


def sources_text(e: E.Engine, paths: list[str], most: int = SOURCE_BYTES) -> str:
    """The files' texts, in order, as far as whole ones fit."""
    out, size = [], 0
    for r in e.contents.where(F.col("path").isin(paths or [""])).select("path", "text").orderBy(F.split("path", "/")).toLocalIterator():
        block = f"=== {r.path}\n{r.text}\n"
        size += len(block.encode())
        if size > most:
            break
        out.append(block)
    return "".join(out)


def _write(e: E.Engine, page: dict, ask: Ask, change: str = "") -> None:
    """One page, saved as soon as it is there."""
    pages = e.pages()
    old = pages.where(F.col("id") == page["id"]).select("content").first()
    prompt = f"Write the wiki page \"{page['title']}\" in Markdown. Link other pages as [[id]].\n" + (f"\nIt says now:\n{old.content}\n" if old else "") + (f"\nWhat changed:\n{change}\n" if change else "") + "\n" + sources_text(e, page["source_files"])
    text = ask(prompt)
    out = wiki.contribute(pages, text, page["title"], page["id"], page["page_type"], tuple(page["source_files"]), now=e.built_at, ref=git.head(e.root))
    covers = [c for r in wiki.public_covers(e.decls, e.spark.createDataFrame([(p,) for p in page["source_files"]], "path string")).select("covers").collect() for c in r.covers]
    lit = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    mine = F.col("id") == page["id"]
    out = out.withColumns({"covers": F.when(mine, lit(dict.fromkeys(covers))).otherwise(F.col("covers")), "links_to": F.when(mine, wiki.links(F.col("content"))).otherwise(F.col("links_to"))})
    e.save_pages(out, {page["id"]})


def _index(e: E.Engine) -> None:
    rows = e.pages().where("page_type <> 'index'").orderBy("page_ord").select("id", "title", "page_type").collect()
    text = "# Index\n\n" + "".join(f"- [[{r.id}]] {r.title} ({r.page_type})\n" for r in rows)
    e.save_pages(wiki.contribute(e.pages(), text, "Index", "index", "index", now=e.built_at, ref=git.head(e.root)), {"index"})


def generate(e: E.Engine, ask: Ask) -> list[str]:
    """Plans and writes the whole wiki; the ids in the order they were written."""
    ask, out = patient(ask), []
    for page in plan(e, ask):
        _write(e, page, ask)
        out.append(page["id"])
    _index(e)
    return out


def update(e: E.Engine, ask: Ask, since_ref: str) -> list[str]:
    """Writes the pages again whose sources changed, puts new files on pages, takes away files that are gone (and pages
    left without any), and writes the index."""
    ask, pages = patient(ask), e.pages()
    changed = e.spark.createDataFrame([(p,) for p in git.changed_paths(e.root, since_ref)], "path string")
    touched = {r.id for r in wiki.affected(pages, changed).select("id").collect()}
    here = [r.path for r in e.files.select("path").collect()]
    kept = pages.where("page_type <> 'index'").select("id", "title", "page_type", F.array_intersect("source_files", F.array(*map(F.lit, here)).cast("array<string>")).alias("source_files"), F.size("source_files").alias("n"))
    plans = [r.asDict() for r in kept.collect()]
    gone = {p["id"] for p in plans if p.pop("n") > 0 and not p["source_files"]}
    before = {p["id"]: list(p["source_files"]) for p in plans}
    after = repaired(e, [p for p in plans if p["id"] not in gone])
    if gone:
        e.save_pages(pages.where(~F.col("id").isin(list(gone))), set())
    diff = json.dumps(E.call(e, "get_diff_summary", {"since_ref": since_ref}))[:20_000]
    out = [p["id"] for p in after if p["id"] in touched or before.get(p["id"]) != p["source_files"]]
    for p in after:
        if p["id"] in out:
            _write(e, p, ask, diff)
    _index(e)
    return out


class AutoUpdate(threading.Thread):
    """Runs `work` once after a burst of notices has been quiet for `debounce` seconds; notices that come while it runs
    lead to one more run."""

    def __init__(self, work: Callable[[], None], debounce: float = 30.0):
        super().__init__(daemon=True)
        self.work, self.debounce, self.told, self.ended = work, debounce, threading.Event(), threading.Event()

    def tell(self) -> None:
        self.told.set()

    def run(self) -> None:
        while not self.ended.is_set():
            if not self.told.wait(0.1):
                continue
            self.told.clear()
            while self.told.wait(self.debounce) and not self.ended.is_set():
                self.told.clear()
            if not self.ended.is_set():
                self.work()

    def stop(self) -> None:
        self.ended.set()
        self.told.set()
        self.join()

