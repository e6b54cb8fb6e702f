"""Trades from a WebSocket, as a streaming data source, and the server that replays files over one.

Only the standard library is used: a handshake, and frames as the protocol has them.  Text and binary
messages are JSON lines; control frames are answered or passed over; a close ends the input.  The
driver takes messages in, at most ``max_rows`` of them or what comes in ``max_latency_ms``, a micro-batch,
and holds a batch until it is committed, so a retried batch has the same trades.  Messages that a
stopped driver had taken in and not finished are lost: the other side has no replay.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
import socket
import socketserver
import struct
import threading
import time
from collections.abc import Iterator
from pathlib import Path
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

from ..schemas import SEQUENCED

#: Fixed values of the protocol.
GUID = "258EAFA5-E914-47DA-95CA-C5AB0DC85B11"
TEXT, BINARY, CLOSE, PING, PONG = 1, 2, 8, 9, 10


def frame(kind: int, body: bytes, mask: bool) -> bytes:
    n, bit = len(body), 0x80 if mask else 0
    head = bytes([0x80 | kind]) + (bytes([bit | n]) if n < 126 else bytes([bit | 126]) + struct.pack(">H", n) if n < 1 << 16 else bytes([bit | 127]) + struct.pack(">Q", n))
    if not mask:
        return head + body
    key = os.urandom(4)
    return head + key + bytes(b ^ key[i % 4] for i, b in enumerate(body))


class Connection:
    """One side of an open WebSocket."""

    def __init__(self, sock: socket.socket, client: bool, buffer: bytes = b"") -> None:
        self.sock, self.client, self.buffer, self.parts, self.open = sock, client, buffer, b"", True

    @staticmethod
    def connect(url: str, timeout: float = 10.0) -> Connection:
        at = urlsplit(url)
        if at.scheme != "ws" or not at.hostname:
            raise ValueError(f"{url!r} is no ws:// address")
        sock = socket.create_connection((at.hostname, at.port or 80), timeout)
        key = base64.b64encode(os.urandom(16)).decode()
        path = (at.path or "/") + (f"?{at.query}" if at.query else "")
        sock.sendall(f"GET {path} HTTP/1.1\r\nHost: {at.netloc}\r\nUpgrade: websocket\r\nConnection: Upgrade\r\nSec-WebSocket-Key: {key}\r\nSec-WebSocket-Version: 13\r\n\r\n".encode())
        answer = b""
        while b"\r\n\r\n" not in answer:
            more = sock.recv(4096)
            if not more:
                raise ConnectionError("the server closed during the handshake")
            answer += more
        head, _, rest = answer.partition(b"\r\n\r\n")
        if b" 101 " not in head.split(b"\r\n")[0] or accept(key).encode() not in head:
            raise ConnectionError("no WebSocket at this address")
        return Connection(sock, True, rest)

    def send(self, kind: int, body: bytes) -> None:
        self.sock.sendall(frame(kind, body, self.client))

    def _frame(self) -> tuple[int, bool, bytes] | None:
        """(kind, final, body) of a frame that has come in whole."""
        b = self.buffer
        if len(b) < 2:
            return None
        n, at = b[1] & 0x7F, 2
        if n > 125:
            size = 2 if n == 126 else 8
            if len(b) < at + size:
                return None
            n, at = int.from_bytes(b[at : at + size], "big"), at + size
        masked = b[1] & 0x80
        key, at = (b[at : at + 4], at + 4) if masked else (b"", at)
        if len(b) < at + n:
            return None
        body = b[at : at + n]
        self.buffer = b[at + n :]
        return b[0] & 0x0F, bool(b[0] & 0x80), bytes(x ^ key[i % 4] for i, x in enumerate(body)) if masked else body

    def messages(self, until: float) -> Iterator[bytes]:
        """Whole messages that come in before the clock (``time.monotonic``) shows ``until``."""
        while self.open:
            got = self._frame()
            if got is None:
                left = until - time.monotonic()
                if left <= 0:
                    return
                self.sock.settimeout(left)
                try:
                    more = self.sock.recv(1 << 16)
                except TimeoutError:
                    return
                self.open = bool(more)
                self.buffer += more
                continue
            kind, final, body = got
            if kind == CLOSE:
                self.open = False
            elif kind == PING:
                self.send(PONG, body)
            elif kind in (0, TEXT, BINARY):
                self.parts += body
                if final:
                    whole, self.parts = self.parts, b""
                    yield whole


def accept(key: str) -> str:
    return base64.b64encode(hashlib.sha1((key + GUID).encode()).digest()).decode()


def trade(line: bytes) -> tuple | None:
    """ts, symbol, price, qty, side and the book of a JSON line; None if it is no trade."""
    try:
        x = json.loads(line)
        book = [None if x.get(f.name) is None else float(x[f.name]) for f in SEQUENCED.fields[6:]]
        row = int(x["ts"]), str(x["symbol"]), float(x["price"]), float(x["qty"]), x["side"]
    except (ValueError, KeyError, TypeError, AttributeError):
        return None
    return (*row, *book) if row[4] in ("buy", "sell") else None


class TradeReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.url, self.max_rows, self.latency = options["url"], int(options.get("max_rows", "1000")), int(options.get("max_latency_ms", "100")) / 1000
        self.connection: Connection | None = None
        self.held: dict[int, tuple] = {}
        self.bad = 0

    def initialOffset(self) -> dict:
        return {"seq": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        """The next trades, numbered in order of arrival."""
        at = start["seq"]
        if at not in self.held:
            if self.connection is None:
                self.connection = Connection.connect(self.url)
            n = at
            for message in self.connection.messages(time.monotonic() + self.latency):
                for line in message.splitlines():
                    row = trade(line) if line.strip() else None
                    if row is not None:
                        self.held[n] = (*row[:5], n, *row[5:])
                        n += 1
                    elif line.strip():
                        self.bad += 1
                if n - at >= self.max_rows:
                    break
        rows, n = [], at
        while n in self.held:
            rows.append(self.held[n])
            n += 1
        return iter(rows), {"seq": n}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        missing = [n for n in range(start["seq"], end["seq"]) if n not in self.held]
        if missing:
            raise RuntimeError(f"trades {missing[0]} to {end['seq'] - 1} were taken in by a driver that is gone, and the socket does not send them again")
        return iter([self.held[n] for n in range(start["seq"], end["seq"])])

    def commit(self, end: dict) -> None:
        self.held = {n: row for n, row in self.held.items() if n >= end["seq"]}


class TradeSocket(DataSource):
    @classmethod
    def name(cls) -> str:
        return "trade_socket"

    def schema(self) -> StructType:
        return SEQUENCED

    def simpleStreamReader(self, schema: StructType) -> TradeReader:
        return TradeReader(dict(self.options))


def socket_trades(spark: SparkSession, url: str, max_rows: int = 1000, max_latency_ms: int = 100) -> DataFrame:
    """Trades of a WebSocket as a stream; messages that are no trades are passed over."""
    spark.dataSource.register(TradeSocket)
    return spark.readStream.format("trade_socket").option("url", url).option("max_rows", max_rows).option("max_latency_ms", max_latency_ms).load()


class Replay:
    """Serves the JSON lines of a file, for everyone who connects, at ``speed`` times the pace of their ts."""

    def __init__(self, file: str, speed: float = 1.0, port: int = 0, host: str = "127.0.0.1") -> None:
        lines = [x for x in Path(file).read_bytes().splitlines() if x.strip()]

        class Handler(socketserver.BaseRequestHandler):
            def handle(self) -> None:
                ask = b""
                while b"\r\n\r\n" not in ask:
                    more = self.request.recv(4096)
                    if not more:
                        return
                    ask += more
                fields = dict(x.split(": ", 1) for x in ask.decode().split("\r\n")[1:] if ": " in x)
                key = {k.lower(): v for k, v in fields.items()}.get("sec-websocket-key", "")
                self.request.sendall(f"HTTP/1.1 101 Switching Protocols\r\nUpgrade: websocket\r\nConnection: Upgrade\r\nSec-WebSocket-Accept: {accept(key)}\r\n\r\n".encode())
                peer, began, first = Connection(self.request, False), time.monotonic(), None
                for line in lines:
                    try:
                        ts = json.loads(line)["ts"]
                        first = ts if first is None else first
                        time.sleep(max(0.0, began + (ts - first) / 1e9 / speed - time.monotonic()))
                    except (ValueError, KeyError, TypeError):
                        pass  # sent as it is
                    peer.send(TEXT, line)
                peer.send(CLOSE, struct.pack(">H", 1000))

        class Server(socketserver.ThreadingTCPServer):
            allow_reuse_address = daemon_threads = True

        self.server = Server((host, port), Handler)
        self.url = f"ws://{host}:{self.server.server_address[1]}"
        threading.Thread(target=self.server.serve_forever, daemon=True).start()

    def __enter__(self) -> Replay:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def close(self) -> None:
        self.server.shutdown()
        self.server.server_close()
