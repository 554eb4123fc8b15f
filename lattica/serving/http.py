"""The same protocol over HTTP: POST answers, GET streams what the server says on its own, DELETE ends a session.
Sessions live as long as they are used (an idle hour ends one); there are at most a thousand."""

from __future__ import annotations

import json
import threading
import time
import uuid
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from .protocol import PARSE, Server, _error

TTL, MOST, BODY, HEADER = 3600.0, 1000, 1 << 20, "Mcp-Session-Id"


class Sessions:
    def __init__(self, ttl: float = TTL, most: int = MOST, clock=time.monotonic):
        self.ttl, self.most, self.clock, self.lock = ttl, most, clock, threading.Lock()
        self.used: dict[str, float] = {}

    def _expire(self) -> None:
        now = self.clock()
        for k in [k for k, t in self.used.items() if now - t > self.ttl]:
            del self.used[k]

    def open(self) -> str | None:
        """A new session's name; none if there are too many."""
        with self.lock:
            self._expire()
            if len(self.used) >= self.most:
                return None
            name = uuid.uuid4().hex
            self.used[name] = self.clock()
            return name

    def touch(self, name: str | None) -> bool:
        with self.lock:
            self._expire()
            if name not in self.used:
                return False
            self.used[name] = self.clock()
            return True

    def close(self, name: str | None) -> bool:
        with self.lock:
            return self.used.pop(name, None) is not None


class Broadcast:
    """What the server says on its own, to all open streams."""

    def __init__(self):
        self.ready, self.said, self.closed = threading.Condition(), [], False

    def say(self, message: dict) -> None:
        with self.ready:
            self.said.append(json.dumps(message))
            self.said = self.said[-1000:]
            self.ready.notify_all()


def make(server: Server, host: str = "127.0.0.1", port: int = 0, path: str = "/mcp", sessions: Sessions | None = None, keep_alive: float = 15.0) -> ThreadingHTTPServer:
    sessions, talk = sessions or Sessions(), Broadcast()

    class Handler(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def log_message(self, *args) -> None:
            pass

        def _send(self, code: int, body: str = "", **headers: str) -> None:
            raw = body.encode()
            self.send_response(code)
            for k, v in {"Content-Type": "application/json", "Content-Length": str(len(raw))}.items():
                self.send_header(k, v)
            for k, v in headers.items():
                self.send_header(k.replace("_", "-"), v)
            self.end_headers()
            self.wfile.write(raw)

        def _known(self) -> bool:
            if self.path.split("?")[0] != path:
                self._send(404)
                return False
            return True

        def do_POST(self) -> None:
            if not self._known():
                return
            n = int(self.headers.get("Content-Length") or 0)
            if n > BODY:
                self.close_connection = True
                self._send(413)
                return
            text = self.rfile.read(n).decode("utf-8", "replace")
            try:
                request = json.loads(text)
            except ValueError:
                self._send(400, json.dumps(_error(None, PARSE, "no JSON")))
                return
            more = {}
            if isinstance(request, dict) and request.get("method") == "initialize":
                name = sessions.open()
                if name is None:
                    self._send(503)
                    return
                more[HEADER.replace("-", "_")] = name
            elif not sessions.touch(self.headers.get(HEADER)):
                self._send(404 if self.headers.get(HEADER) else 400)
                return
            answer = server.answer(text)
            self._send(202 if answer is None else 200, answer or "", **more)

        def do_GET(self) -> None:
            if not self._known():
                return
            if not sessions.touch(self.headers.get(HEADER)):
                self._send(404 if self.headers.get(HEADER) else 400)
                return
            self.send_response(200)
            self.send_header("Content-Type", "text/event-stream")
            self.send_header("Cache-Control", "no-store")
            self.send_header("Connection", "close")
            self.end_headers()
            at = len(talk.said)
            try:
                while not talk.closed and sessions.touch(self.headers.get(HEADER)):
                    with talk.ready:
                        talk.ready.wait(keep_alive)
                        new, at = talk.said[at:], len(talk.said)
                    self.wfile.write("".join(f"data: {x}\n\n" for x in new).encode() or b": alive\n\n")
                    self.wfile.flush()
            except OSError:
                pass
            self.close_connection = True

        def do_DELETE(self) -> None:
            if self._known():
                self._send(204 if sessions.close(self.headers.get(HEADER)) else 404)

    httpd = ThreadingHTTPServer((host, port), Handler)
    httpd.daemon_threads = True
    httpd.broadcast = talk
    return httpd
