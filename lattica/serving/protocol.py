"""JSON-RPC over lines: initialize, tools/list and tools/call on a warm engine."""

from __future__ import annotations

import inspect
import json
import queue
import threading
from collections.abc import Callable, Iterable
from typing import Any, TextIO

from .. import engine as E

PARSE, INVALID, METHOD, PARAMS = -32700, -32600, -32601, -32602
VERSION = "2024-11-05"
_TYPES = {"str": "string", "int": "integer", "bool": "boolean", "list[str]": "array"}


def definitions(extended: bool, wiki: bool) -> list[dict]:
    """Tools as shown to clients: the compound ones; with `extended` all; those of the wiki only where there is one."""
    out = []
    for name, f in E.TOOLS.items():
        if name in E.WIKI_TOOLS:
            if not wiki and name != "wiki_generate":
                continue
        elif not extended and name not in (*E.COMPOUND, "regenerate_index"):
            continue
        fields, needed = {}, []
        for p in list(inspect.signature(f).parameters.values())[1:]:
            kind = _TYPES.get(str(p.annotation).split(" | ")[0], "string")
            fields[p.name] = {"type": kind} | ({"items": {"type": "string"}} if kind == "array" else {})
            if p.default is inspect.Parameter.empty:
                needed.append(p.name)
        out.append({"name": name, "description": (f.__doc__ or "").strip(), "inputSchema": {"type": "object", "properties": fields, "required": needed}})
    return out


def _error(id_: Any, code: int, message: str) -> dict:
    return {"jsonrpc": "2.0", "id": id_, "error": {"code": code, "message": message}}


class Server:
    """answer() takes one message of any shape; handle() a decoded request. Calls run one at a time."""

    def __init__(self, engine: E.Engine, extended: bool = False):
        self.engine, self.extended, self.lock = engine, extended, threading.RLock()

    def handle(self, request: Any) -> dict | None:
        if not isinstance(request, dict) or not isinstance(request.get("method"), str):
            return _error(request.get("id") if isinstance(request, dict) else None, INVALID, "no request")
        id_, method, params = request.get("id"), request["method"], request.get("params") or {}
        if "id" not in request:
            return None  # a notification
        if method == "initialize":
            return {"jsonrpc": "2.0", "id": id_, "result": {"protocolVersion": VERSION, "capabilities": {"tools": {}}, "serverInfo": {"name": "lattica", "version": "1"}}}
        if method == "ping":
            return {"jsonrpc": "2.0", "id": id_, "result": {}}
        if method == "tools/list":
            return {"jsonrpc": "2.0", "id": id_, "result": {"tools": definitions(self.extended, self.engine.wiki_folder is not None)}}
        if method != "tools/call":
            return _error(id_, METHOD, f"unknown method {method}")
        if not isinstance(params, dict) or not isinstance(params.get("name"), str) or not isinstance(params.get("arguments") or {}, dict):
            return _error(id_, PARAMS, "a tool's name and arguments are needed")
        try:
            with self.lock:
                value, bad = E.call(self.engine, params["name"], params.get("arguments")), False
        except E.ToolError as x:
            value, bad = str(x), True
        text = value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, default=str)
        return {"jsonrpc": "2.0", "id": id_, "result": {"content": [{"type": "text", "text": text}]} | ({"isError": True} if bad else {})}

    def answer(self, line: str) -> str | None:
        try:
            request = json.loads(line)
        except ValueError:
            return json.dumps(_error(None, PARSE, "no JSON"))
        if isinstance(request, list):
            out = [r for x in request if (r := self.handle(x)) is not None]
            return json.dumps(out if request else _error(None, INVALID, "an empty batch")) if out or not request else None
        r = self.handle(request)
        return None if r is None else json.dumps(r)


def serve_lines(server: Server, source: Iterable[str], out: TextIO, changes: queue.Queue | None = None, rebuild: Callable[[], Any] | None = None) -> None:
    """Answers each line until the source ends. Lines are read by a thread of their own; what a watcher puts in `changes`
    is taken between requests, and a burst of it leads to one rebuild."""
    events: queue.Queue = changes if changes is not None else queue.Queue()
    end = object()

    def read() -> None:
        for line in source:
            events.put(("line", line))
        events.put(("end", end))

    threading.Thread(target=read, daemon=True).start()
    while True:
        kind, value = events.get()
        if kind == "end":
            return
        if kind == "change":
            held = []
            while not events.empty():
                k, v = events.get_nowait()
                if k != "change":
                    held.append((k, v))
            if rebuild:
                with server.lock:
                    rebuild()
            for x in held:
                events.put(x)
        elif value.strip() and (text := server.answer(value)) is not None:
            out.write(text + "\n")
            out.flush()
