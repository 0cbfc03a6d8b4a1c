"""A TCP listener for line protocol. It spools what comes to files that ``ingest`` takes in, so that
nothing is lost if the stream or the listener starts again."""

from __future__ import annotations

import os
import socketserver
import threading
import time
import uuid

#: Lines of a spooled file, and seconds that a line waits at most.
MOST_LINES, MOST_SECONDS = 100_000, 1.0
#: Bytes of a line; longer ones end the connection, as they are no lines.
MOST_BYTES = 1 << 20


class Spool:
    """Files of lines in a folder. One is renamed to its name once it is whole."""

    def __init__(self, folder: str, most_lines: int = MOST_LINES, most_seconds: float = MOST_SECONDS):
        self.folder, self.most_lines, self.most_seconds = folder, most_lines, most_seconds
        self.lines: list[bytes] = []
        self.since = time.monotonic()
        self.lock = threading.Lock()
        os.makedirs(folder, exist_ok=True)

    def add(self, line: bytes) -> None:
        with self.lock:
            if not self.lines:
                self.since = time.monotonic()
            self.lines.append(line)
            full = len(self.lines) >= self.most_lines
        if full:
            self.flush()

    def flush(self, old_only: bool = False) -> None:
        with self.lock:
            if not self.lines or (old_only and time.monotonic() - self.since < self.most_seconds):
                return
            lines, self.lines = self.lines, []
            aside = os.path.join(self.folder, f".{uuid.uuid4().hex}")  # Spark passes over hidden files
            with open(aside, "wb") as f:
                f.writelines(x + b"\n" for x in lines)
                f.flush()
                os.fsync(f.fileno())
            os.rename(aside, os.path.join(self.folder, f"{time.time_ns():020d}-{uuid.uuid4().hex}.txt"))


class Listener(socketserver.ThreadingTCPServer):
    """Lines of all connections go to one spool; blank lines and comments don't."""

    allow_reuse_address, daemon_threads = True, True

    def __init__(self, spool: Spool, host: str = "127.0.0.1", port: int = 0):
        self.spool, self.ended = spool, threading.Event()

        class Connection(socketserver.StreamRequestHandler):
            def handle(self) -> None:
                while (line := self.rfile.readline(MOST_BYTES)) and (line.endswith(b"\n") or len(line) < MOST_BYTES):
                    line = line.strip()
                    if line and not line.startswith(b"#"):
                        spool.add(line)

        super().__init__((host, port), Connection)
        threading.Thread(target=self._keep_flushing, daemon=True).start()

    def _keep_flushing(self) -> None:
        while not self.ended.wait(self.spool.most_seconds / 4):
            self.spool.flush(old_only=True)

    def server_close(self) -> None:
        super().server_close()
        self.ended.set()
        self.spool.flush()
