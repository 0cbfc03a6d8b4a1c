"""Live queries, scripts and the listener."""

import json
import os
import socket
import struct
import threading
import time
import urllib.error
import urllib.request

import pytest

from tidemark import scripting, websocket
from tidemark.server import serve
from tidemark.session import Engine
from tidemark.streaming.ingest import ingest, lines_from
from tidemark.streaming.listener import Listener, Spool


@pytest.fixture
def engine(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/store")
    e.store.write_lines(["cpu,host=a usage=1 1", "cpu,host=b usage=3 2"])
    return e


@pytest.fixture
def served(engine):
    server = serve(engine, port=0, scripts=True)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield server.server_address[1]
    server.shutdown()


class Client:
    """A plain client of WebSockets."""

    def __init__(self, port):
        self.sock = socket.create_connection(("127.0.0.1", port), timeout=30)
        self.sock.sendall(b"GET /ws HTTP/1.1\r\nHost: x\r\nUpgrade: websocket\r\nConnection: Upgrade\r\nSec-WebSocket-Key: dGhlIHNhbXBsZSBub25jZQ==\r\nSec-WebSocket-Version: 13\r\n\r\n")
        self.file = self.sock.makefile("rb")
        head = []
        while (line := self.file.readline().strip()) != b"":
            head.append(line)
        assert b"101" in head[0] and b"Sec-WebSocket-Accept: s3pPLMBiTxaQ9kYGzzhZRbK+xOo=" in head

    def send(self, data, kind=1, last=True):
        data = data.encode() if isinstance(data, str) else data
        size = bytes([0x80 | len(data)]) if len(data) < 126 else b"\xfe" + struct.pack(">H", len(data))
        self.sock.sendall(bytes([0x80 * last | kind]) + size + b"abcd" + bytes(b ^ b"abcd"[i % 4] for i, b in enumerate(data)))

    def receive(self):
        first, n = self.file.read(2)
        n = struct.unpack(">H", self.file.read(2))[0] if n == 126 else n
        return first & 15, self.file.read(n)


def test_subscriptions_over_a_websocket(served, engine):
    c = Client(served)
    c.send("what")
    c.send(json.dumps({"action": "subscribe", "id": "a", "query": "sum cpu.usage", "interval_ms": 100}))
    first = json.loads(c.receive()[1])
    assert first["id"] == "a" and first["data"]["value"] == 4.0 and first["timestamp"] > 10**18
    c.send("hey", kind=websocket.PING)
    assert c.receive() == (websocket.PONG, b"hey")
    engine.store.write_lines(["cpu,host=a usage=5 3"])
    assert json.loads(c.receive()[1])["data"]["value"] == 9.0
    text = json.dumps({"action": "subscribe", "id": "a", "query": "nothing", "note": "x" * 200})
    c.send(text[:40], last=False)
    c.send(text[40:], kind=0)
    failed = json.loads(c.receive()[1])
    assert set(failed) == {"id", "error"} and failed["id"] == "a"
    c.send(json.dumps({"action": "unsubscribe", "id": "a"}))
    c.send(b"\x03\xe8", kind=websocket.CLOSE)
    assert c.receive() == (websocket.CLOSE, b"\x03\xe8")


def test_page(served):
    with urllib.request.urlopen(f"http://127.0.0.1:{served}/") as r:
        assert r.headers["Content-Type"].startswith("text/html") and b"new WebSocket" in r.read()


def post(port, path, body):
    return urllib.request.urlopen(urllib.request.Request(f"http://127.0.0.1:{port}{path}", json.dumps(body).encode(), method="POST"))


def test_scripts(served, engine, tmp_path, capsys):
    got = json.load(post(served, "/python", {"q": "for m in db_measurements():\n    print(m, db_fields(m), db_query('sum cpu.usage'))"}))
    assert got["type"] == "python_output" and got["output"] == ["cpu ['usage'] 4.0"] and got["elapsed_ns"] > 0
    with pytest.raises(urllib.error.HTTPError) as e:
        post(served, "/python", {"q": "1 / 0"})
    assert e.value.code == 400 and "division" in json.load(e.value)["error"]
    off = serve(engine, port=0)
    threading.Thread(target=off.serve_forever, daemon=True).start()
    with pytest.raises(urllib.error.HTTPError) as e:
        post(off.server_address[1], "/python", {"q": "1"})
    assert e.value.code == 404
    off.shutdown()
    scripting.one(engine, "1 + 1")
    scripting.one(engine, "1 +")
    assert capsys.readouterr().out == "2\n"
    assert json.load(urllib.request.urlopen(f"http://127.0.0.1:{served}/series?measurement=cpu")) == {"series": ["cpu,host=a", "cpu,host=b"]}


def test_python_command(spark, tmp_path, capsys):
    from tidemark.__main__ import main

    (tmp_path / "p.py").write_text("db_insert('t', {'v': 2.5}, {'k': 'a'}, 7)\nprint(db_query('t.v'))\n")
    assert main(["--data", f"file://{tmp_path}/st", "python", str(tmp_path / "p.py")]) == 0
    assert main(["--data", f"file://{tmp_path}/st", "python", "-e", "db_query('sum t.v')"]) == 0
    assert capsys.readouterr().out.splitlines() == ["[2.5]", "2.5"]


def test_lines_over_tcp(spark, engine, tmp_path):
    spool = Spool(f"{tmp_path}/spool", most_lines=3, most_seconds=0.2)
    listener = Listener(spool)
    threading.Thread(target=listener.serve_forever, daemon=True).start()
    lines = [f"mem,host=h{i} v={i} {i + 1}" for i in range(7)]
    with socket.create_connection(listener.server_address, timeout=10) as s:
        s.sendall(("\n".join(["# note", "", *lines[:5], "bad line", *lines[5:]]) + "\nmem v=9 9").encode())
    wait = time.monotonic() + 20
    while len([f for f in os.listdir(spool.folder) if f.endswith(".txt")]) < 3 and time.monotonic() < wait:
        time.sleep(0.05)
    listener.shutdown()
    listener.server_close()
    for _ in range(2):  # started again, nothing comes twice
        q = ingest(lines_from(spark, f"file://{spool.folder}"), engine.store, f"file://{tmp_path}/ck", once=True)
        assert q.awaitTermination(120) and q.exception() is None
    assert engine.query("select sum(v), count(v) from mem").collect()[0][1:] == (30.0, 8.0)
