"""A streaming source of UDP datagrams (statsd), as a Python data source.

    spark.dataSource.register(DatagramSource)
    spark.readStream.format("datagrams").option("port", 8125).load()   # (received_at, value)

Datagrams wait in a bounded queue between batches; when it is full they are dropped and counted in `dropped`, as a UDP
receiver does. The reader runs on the driver, so this suits one host's agents; larger fleets write to a log that Spark
reads in parallel.
"""

from __future__ import annotations

import socket
import threading
import time
from collections import deque
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader


class DatagramReader(SimpleDataSourceStreamReader):
    def __init__(self, host: str, port: int, most: int) -> None:
        self.host, self.port, self.most = host, port, most
        self.rows: deque[tuple[int, float, str]] = deque()
        self.next, self.dropped = 0, 0
        self.lock = threading.Lock()
        self.socket: socket.socket | None = None

    def __getstate__(self) -> dict:
        return {"host": self.host, "port": self.port, "most": self.most}

    def __setstate__(self, state: dict) -> None:
        self.__init__(**state)

    def _listen(self) -> None:
        self.socket = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
        self.socket.setsockopt(socket.SOL_SOCKET, socket.SO_REUSEADDR, 1)
        self.socket.bind((self.host, self.port))

        def run() -> None:
            while True:
                data = self.socket.recv(65_535)
                with self.lock:
                    if len(self.rows) >= self.most:
                        self.dropped += 1
                        continue
                    self.rows.append((self.next, time.time(), data.decode(errors="replace")))
                    self.next += 1

        threading.Thread(target=run, daemon=True).start()

    def initialOffset(self) -> dict:
        return {"next": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        if self.socket is None:
            self._listen()
        with self.lock:
            got = [r for r in self.rows if r[0] >= start["next"]]
        return iter([(t, v) for _, t, v in got]), {"next": got[-1][0] + 1 if got else start["next"]}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        with self.lock:
            return iter([(t, v) for i, t, v in self.rows if start["next"] <= i < end["next"]])

    def commit(self, end: dict) -> None:
        with self.lock:
            while self.rows and self.rows[0][0] < end["next"]:
                self.rows.popleft()


class DatagramSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "datagrams"

    def schema(self) -> str:
        return "received_at double, value string"

    def simpleStreamReader(self, schema) -> DatagramReader:
        return DatagramReader(self.options.get("host", "127.0.0.1"), int(self.options.get("port", 8125)), int(self.options.get("queue", 100_000)))
