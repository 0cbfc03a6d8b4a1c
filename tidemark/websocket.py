"""The server's side of WebSockets (RFC 6455): text messages over one connection."""

from __future__ import annotations

import base64
import hashlib
import struct
import threading
from collections.abc import Iterator
from typing import BinaryIO

#: Fixed values of the protocol.
GUID = "258EAFA5-E914-47DA-95CA-C5AB0DC85B11"
TEXT, BINARY, CLOSE, PING, PONG = 1, 2, 8, 9, 10
#: Bytes of a message that a client may send.
MOST = 1 << 20


def accept(key: str) -> str:
    """The answer to a client's key."""
    return base64.b64encode(hashlib.sha1((key + GUID).encode()).digest()).decode()


class Socket:
    """Messages of a connection after its handshake. ``send`` may be called from any thread."""

    def __init__(self, read: BinaryIO, write: BinaryIO):
        self.read, self.write, self.lock = read, write, threading.Lock()

    def _frame(self, kind: int, data: bytes) -> None:
        n = len(data)
        size = bytes([n]) if n < 126 else b"\x7e" + struct.pack(">H", n) if n < 1 << 16 else b"\x7f" + struct.pack(">Q", n)
        with self.lock:
            self.write.write(bytes([0x80 | kind]) + size + data)
            self.write.flush()

    def send(self, text: str) -> None:
        self._frame(TEXT, text.encode())

    def _exactly(self, n: int) -> bytes:
        data = self.read.read(n)
        if len(data) < n:
            raise EOFError
        return data

    def _next(self) -> tuple[int, bool, bytes]:
        first, second = self._exactly(2)
        n = second & 0x7F
        if n >= 126:
            n = struct.unpack(">H", self._exactly(2))[0] if n == 126 else struct.unpack(">Q", self._exactly(8))[0]
        if n > MOST or not second & 0x80:
            raise EOFError  # too long, or not masked as a client's frames must be
        mask = self._exactly(4)
        data = self._exactly(n)
        return first & 0x0F, bool(first & 0x80), bytes(b ^ mask[i % 4] for i, b in enumerate(data))

    def messages(self) -> Iterator[str]:
        """Texts until the client goes; pings are answered, fragments put together."""
        parts: list[bytes] = []
        while True:
            try:
                kind, last, data = self._next()
            except (EOFError, OSError):
                return
            if kind == PING:
                self._frame(PONG, data)
            elif kind == CLOSE:
                try:
                    self._frame(CLOSE, data[:2])
                except OSError:
                    pass
                return
            elif kind in (0, TEXT, BINARY):
                parts.append(data)
                if sum(map(len, parts)) > MOST:
                    return
                if last:
                    yield b"".join(parts).decode("utf-8", "replace")
                    parts = []
