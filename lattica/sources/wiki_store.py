"""The wiki on disk: a Markdown file with a header for each page, and a manifest that says which and in what order."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession

from ..operators.wiki import PAGE, safe_id

MANIFEST = "manifest.yaml"
_FOLDERS = {"index": "", "architecture": "", "module": "modules", "entity": "entities", "topic": "topics"}
_FIELDS = ("title", "page_type", "source_files", "generated_at_ref", "generated_at", "links_to", "covers", "contradictions", "failures")


def page_path(page_id: str, page_type: str) -> str:
    return os.path.join(_FOLDERS.get(page_type, "topics"), safe_id(page_id) + ".md")


def render_page(page: dict) -> str:
    """Header lines of YAML whose values are in JSON's spelling, then the content."""
    head = "".join(f"{k}: {json.dumps(page[k], ensure_ascii=False)}\n" for k in ("id", *_FIELDS))
    return f"---\n{head}---\n{page['content']}"


def parse_page(text: str) -> dict | None:
    """None for a page that has no header or a broken one."""
    if not text.startswith("---\n") or "\n---\n" not in text[3:]:
        return None
    head, _, content = text[4:].partition("\n---\n")
    page: dict = {"content": content}
    try:
        for line in head.split("\n"):
            k, _, v = line.partition(": ")
            page[k] = json.loads(v)
    except ValueError:
        return None
    return page if page.get("id") and page.get("title") is not None else None


def load(spark: SparkSession, folder: str) -> DataFrame:
    """The pages of the manifest in its order; pages that are missing or malformed are left out. No wiki: no rows."""
    rows = []
    try:
        with open(os.path.join(folder, MANIFEST), encoding="utf-8") as f:
            entries = [json.loads(line[2:]) for line in f if line.startswith("- ")]
    except (OSError, ValueError):
        entries = []
    for i, e in enumerate(entries):
        try:
            with open(os.path.join(folder, e["path"]), encoding="utf-8") as f:
                page = parse_page(f.read())
        except (OSError, UnicodeDecodeError, KeyError):
            continue
        if page:
            rows.append({"page_ord": i, "page_type": "topic", "source_files": [], "generated_at_ref": "", "generated_at": "", "links_to": [], "covers": [], "contradictions": [], "failures": []} | page)
    schema = spark.createDataFrame([], PAGE.replace("\n", " ")).schema
    return spark.createDataFrame([{k: r.get(k) for k in schema.names} for r in rows], schema)


def save(pages: DataFrame, folder: str, ref: str = "", now: str = "", only: set[str] | None = None) -> int:
    """Writes pages (only those of the ids given) a page at a time, then the manifest of all of them."""
    entries, n = [], 0
    for r in pages.orderBy("page_ord").toLocalIterator():
        page = r.asDict(recursive=True)
        path = page_path(page["id"], page["page_type"])
        entries.append({"id": page["id"], "title": page["title"], "path": path})
        if only is None or page["id"] in only:
            os.makedirs(os.path.dirname(os.path.join(folder, path)) or ".", exist_ok=True)
            _replace(os.path.join(folder, path), render_page(page))
            n += 1
    os.makedirs(folder, exist_ok=True)
    _replace(os.path.join(folder, MANIFEST), f"version: 1\nref: {json.dumps(ref)}\ngenerated_at: {json.dumps(now)}\npages:\n" + "".join(f"- {json.dumps(e, ensure_ascii=False)}\n" for e in entries))
    return n


def _replace(path: str, text: str) -> None:
    with open(path + ".new", "w", encoding="utf-8", newline="\n") as f:
        f.write(text)
    os.replace(path + ".new", path)
