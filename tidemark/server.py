"""A thin HTTP service on an engine: a page at /, and /write, /query, /lang, /python, /ws, /subscribe, /status,
/measurements, /series, /fields, /health."""

from __future__ import annotations

import json
import queue
import time
import uuid
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

from tidemark import scripting, websocket
from tidemark.page import PAGE
from tidemark.plans.dialect import parse
from tidemark.render import series_json, value_json
from tidemark.session import Engine
from tidemark.streaming.ingest import Subscriptions


def handler(engine: Engine, scripts: bool = False) -> type[BaseHTTPRequestHandler]:
    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *args: object) -> None:
            pass

        def answer(self, status: int, body: object = None) -> None:
            data = b"" if body is None else json.dumps(body).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:
            url = urlparse(self.path)
            if url.path == "/":
                data = PAGE.encode()
                self.send_response(200)
                self.send_header("Content-Type", "text/html; charset=utf-8")
                self.send_header("Content-Length", str(len(data)))
                self.end_headers()
                self.wfile.write(data)
            elif url.path == "/health":
                self.answer(200, {"status": "ok"})
            elif url.path == "/status":
                self.answer(200, engine.store.status() if engine.store else {"measurements": len(engine.registered)})
            elif url.path == "/measurements":
                self.answer(200, {"measurements": engine.db_measurements()})
            elif url.path == "/fields":
                name = parse_qs(url.query).get("measurement", [""])[0]
                self.answer(200, {"fields": engine.db_fields(name)})
            elif url.path == "/series":
                self.answer(200, {"series": engine.db_series(parse_qs(url.query).get("measurement", [""])[0])})
            elif url.path == "/subscribe":
                self.subscribe(parse_qs(url.query))
            elif url.path == "/ws" and self.headers.get("Sec-WebSocket-Key"):
                self.live()
            else:
                self.answer(404, {"error": "no such path"})

        def subscribe(self, asked: dict[str, list[str]]) -> None:
            """Events with the result of ``q`` whenever it changes, until the client goes."""
            id_ = asked.get("id", [uuid.uuid4().hex])[0]
            changes: queue.Queue[str] = queue.Queue()
            polls = Subscriptions(lambda q: value_json(engine.eval(q)), lambda _, text: changes.put(text))
            self.send_response(200)
            self.send_header("Content-Type", "text/event-stream")
            self.end_headers()
            polls.subscribe(id_, asked.get("q", [""])[0], int(asked.get("interval_ms", ["1000"])[0]))
            try:
                while True:
                    try:
                        text = f"id: {id_}\ndata: {changes.get(timeout=5)}\n\n"
                    except queue.Empty:
                        text = ": still here\n\n"
                    self.wfile.write(text.encode())
                    self.wfile.flush()
            except OSError:
                pass
            finally:
                polls.close()

        def live(self) -> None:
            """Subscriptions over a WebSocket: {action: subscribe | unsubscribe, id, query, interval_ms}.
            A result is pushed as {id, data, timestamp} whenever it changes, a failure as {id, error}."""
            self.send_response(101)
            for name, value in (("Upgrade", "websocket"), ("Connection", "Upgrade"), ("Sec-WebSocket-Accept", websocket.accept(self.headers["Sec-WebSocket-Key"]))):
                self.send_header(name, value)
            self.end_headers()
            self.close_connection = True
            socket = websocket.Socket(self.rfile, self.wfile)

            def push(id_: str, text: str) -> None:
                value = json.loads(text)
                failed = isinstance(value, dict) and set(value) == {"error"}
                message = {"id": id_, **value} if failed else {"id": id_, "data": value, "timestamp": time.time_ns()}
                try:
                    socket.send(json.dumps(message))
                except OSError:
                    polls.unsubscribe(id_)

            polls = Subscriptions(lambda q: value_json(engine.eval(q)), push)
            try:
                for text in socket.messages():
                    try:
                        asked = json.loads(text)
                        action, id_ = asked["action"], str(asked["id"])
                    except (ValueError, KeyError, TypeError):
                        continue
                    if action == "subscribe" and asked.get("query"):
                        polls.subscribe(id_, asked["query"], asked.get("interval_ms"))
                    elif action == "unsubscribe":
                        polls.unsubscribe(id_)
            finally:
                polls.close()

        def do_POST(self) -> None:
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0)).decode("utf-8", "replace")
            try:
                if self.path == "/write":
                    engine.store.write_lines(body.splitlines())
                    self.answer(204)
                elif self.path == "/query":
                    text = json.loads(body)["q"]
                    self.answer(200, series_json(parse(text).measurement, engine.query(text)))
                elif self.path == "/lang":
                    started = time.perf_counter_ns()
                    value = engine.eval(json.loads(body)["q"])
                    self.answer(200, value_json(value, time.perf_counter_ns() - started))
                elif self.path == "/python" and scripts:
                    started = time.perf_counter_ns()
                    lines = scripting.run(engine, json.loads(body)["q"])
                    self.answer(200, {"type": "python_output", "output": lines, "elapsed_ns": time.perf_counter_ns() - started})
                else:
                    self.answer(404, {"error": "no such path"})
            except Exception as e:  # a request's failure is its answer
                self.answer(400, {"error": str(e)})

    return Handler


def serve(engine: Engine, host: str = "127.0.0.1", port: int = 8086, scripts: bool = False) -> ThreadingHTTPServer:
    """A server to call serve_forever() on. ``scripts`` lets clients run Python programs on the
    driver, so it is off unless asked for."""
    return ThreadingHTTPServer((host, port), handler(engine, scripts))
