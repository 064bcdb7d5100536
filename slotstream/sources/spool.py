"""Packets from sockets into a spool folder that a file stream reads.

A listener coalesces what it receives into batches (by count, or after a short linger) and writes
each as one Parquet file, visible at once by a rename.  Spark's file source then gives exactly-once
batches with back-pressure; what a full buffer does is the spool's ``overflow``: wait, drop the
newest, or overwrite the oldest packet.
"""

from __future__ import annotations

import os
import socket
import struct
import threading
import time
import uuid
from collections import deque
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.parquet as pq

SCHEMA = pa.schema([("source", pa.string()), ("observed_ms", pa.int64()), ("bytes", pa.binary())])


@dataclass
class Spool:
    """A bounded buffer of packets that is written to ``folder`` in batches."""

    folder: str
    batch: int = 64
    linger: float = 0.05
    capacity: int = 8192
    overflow: str = "wait"
    dropped: int = 0
    _buffer: deque = field(default_factory=deque)
    _room: threading.Condition = field(default_factory=threading.Condition)
    _stop: bool = False

    def __post_init__(self) -> None:
        if self.overflow not in ("wait", "drop_newest", "overwrite_oldest"):
            raise ValueError(f"unknown overflow {self.overflow}")
        os.makedirs(self.folder, exist_ok=True)

    def push(self, packets: list[tuple[str, bytes]]) -> int:
        """Add (source, bytes) packets; how many were taken."""
        taken = 0
        with self._room:
            for source, raw in packets:
                while len(self._buffer) >= self.capacity and self.overflow == "wait" and not self._stop:
                    self._room.wait(0.1)
                if len(self._buffer) >= self.capacity:
                    self.dropped += 1
                    if self.overflow != "overwrite_oldest":
                        continue
                    self._buffer.popleft()
                self._buffer.append((source, int(time.time() * 1000), raw))
                taken += 1
            self._room.notify_all()
        return taken

    def flush(self, most: int | None = None) -> int:
        """Write up to ``most`` buffered packets as one file; how many."""
        with self._room:
            rows = [self._buffer.popleft() for _ in range(min(len(self._buffer), most or len(self._buffer)))]
            self._room.notify_all()
        if rows:
            columns = [list(c) for c in zip(*rows, strict=True)]
            table = pa.table([pa.array(c, f.type) for c, f in zip(columns, SCHEMA, strict=True)], schema=SCHEMA)
            name = f"{time.time_ns()}-{uuid.uuid4().hex}.parquet"
            hidden = os.path.join(self.folder, f"_{name}")
            pq.write_table(table, hidden)
            os.rename(hidden, os.path.join(self.folder, name))
        return len(rows)

    def run(self) -> None:
        """Write batches until :meth:`stop`: full ones at once, others after the linger."""
        while not self._stop:
            with self._room:
                self._room.wait_for(lambda: len(self._buffer) >= self.batch or self._stop, self.linger)
            self.flush(self.batch if len(self._buffer) > self.batch else None)
        self.flush()

    def start(self) -> threading.Thread:
        thread = threading.Thread(target=self.run, daemon=True)
        thread.start()
        return thread

    def stop(self) -> None:
        with self._room:
            self._stop = True
            self._room.notify_all()


class Listener:
    """A thread that feeds a spool from a socket until it is closed."""

    def __init__(self, spool: Spool, sock: socket.socket):
        self.spool, self.sock, self.closed = spool, sock, False
        self.address = sock.getsockname()
        self.thread = threading.Thread(target=self._run, daemon=True)
        self.thread.start()

    def _run(self) -> None:
        raise NotImplementedError

    def close(self) -> None:
        self.closed = True
        self.sock.close()
        self.thread.join(5)


class UdpListener(Listener):
    """Datagrams; those that wait in the socket's buffer come as one batch."""

    def _run(self) -> None:
        while not self.closed:
            found: list[tuple[str, bytes]] = []
            try:
                self.sock.settimeout(0.1)
                found.append(self._one())
                self.sock.setblocking(False)
                while len(found) < self.spool.batch:
                    found.append(self._one())
            except (BlockingIOError, TimeoutError):
                pass
            except OSError:
                if self.closed:
                    return
            if found:
                self.spool.push(found)

    def _one(self) -> tuple[str, bytes]:
        raw, peer = self.sock.recvfrom(65_535)
        return f"{peer[0]}:{peer[1]}", raw


class TcpReader(Listener):
    """Frames of a connected stream: a 32-bit big-endian length, then that many bytes."""

    most = 16 << 20

    def _run(self) -> None:
        peer = "%s:%s" % self.sock.getpeername()[:2]
        try:
            while not self.closed:
                (size,) = struct.unpack(">I", self._exactly(4))
                if size > self.most:
                    return
                self.spool.push([(peer, self._exactly(size))])
        except (OSError, EOFError):
            return

    def _exactly(self, size: int) -> bytes:
        out = b""
        while len(out) < size:
            part = self.sock.recv(size - len(out))
            if not part:
                raise EOFError
            out += part
        return out


class TcpListener(Listener):
    """Accepts connections; each gets its own reader."""

    def _run(self) -> None:
        self.readers: list[TcpReader] = []
        self.sock.settimeout(0.1)
        while not self.closed:
            try:
                connection, _ = self.sock.accept()
                connection.settimeout(None)
                self.readers.append(TcpReader(self.spool, connection))
            except TimeoutError:
                continue
            except OSError:
                return


def udp_listener(spool: Spool, host: str = "127.0.0.1", port: int = 0) -> UdpListener:
    sock = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
    sock.bind((host, port))
    return UdpListener(spool, sock)


def tcp_listener(spool: Spool, host: str = "127.0.0.1", port: int = 0) -> TcpListener:
    sock = socket.create_server((host, port))
    return TcpListener(spool, sock)


def tcp_connector(spool: Spool, host: str, port: int, attempts: int = 3) -> TcpReader:
    """A reader of an outgoing connection, tried a few times."""
    for attempt in range(attempts):
        try:
            return TcpReader(spool, socket.create_connection((host, port), 2))
        except OSError:
            if attempt + 1 == attempts:
                raise
            time.sleep(0.1 * 2**attempt)
    raise ValueError("no attempt")
