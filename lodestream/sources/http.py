"""HTTP as a Spark data source and sink: ``spark.read.format("http_json")`` and ``df.write.format("http_json").mode("append")``.

Each option ``url`` (comma-separated) is a partition, so pages of an interface are fetched in parallel by the executors.
Failures are tried again with growing pauses; Retry-After is heeded. A write sends each task's rows in batches; with the
option ``index`` in the bulk form of search engines, where an ``id`` column makes a batch that is sent again harmless.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType


class Page(InputPartition):
    def __init__(self, url: str) -> None:
        self.url = url


class HttpJsonReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        self.names = schema.names
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [Page(u.strip()) for u in self.options["url"].split(",") if u.strip()]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        body = fetch(partition.url, int(self.options.get("retries", "10")), float(self.options.get("pause", "0.1")), float(self.options.get("timeout", "30")))
        lines = self.options.get("lines", "false").lower() == "true"
        rows = [json.loads(x) for x in body.splitlines() if x.strip()] if lines else json.loads(body)
        for row in rows if isinstance(rows, list) else [rows]:
            yield tuple(row.get(n) for n in self.names)


class HttpJsonSource(DataSource):
    """Register with ``spark.dataSource.register(HttpJsonSource)``; a schema is required."""

    @classmethod
    def name(cls) -> str:
        return "http_json"

    def reader(self, schema: StructType) -> DataSourceReader:
        return HttpJsonReader(schema, dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("rows that were sent can't be replaced: write in mode append")
        return HttpJsonWriter(dict(self.options))


@dataclass
class Sent(WriterCommitMessage):
    rows: int
    batches: int


class HttpJsonWriter(DataSourceWriter):
    """Rows as JSON without nulls: an array a request, lines with ``lines``, or bulk actions with ``index``. Delivery is at least once: a task that is
    run again sends its batches again."""

    def __init__(self, options: dict[str, str]) -> None:
        self.url, self.size = options["url"], int(options.get("batch", "500"))
        self.index, self.id = options.get("index"), options.get("id")
        self.lines = options.get("lines", "false").lower() == "true"
        self.limits = int(options.get("retries", "10")), float(options.get("pause", "0.1")), float(options.get("timeout", "30"))

    def _body(self, rows: list[dict]) -> bytes:
        text = [json.dumps(r, default=str, separators=(",", ":")) for r in rows]
        if self.index:
            keys = [{"_index": self.index} | ({"_id": str(r[self.id])} if self.id and r.get(self.id) is not None else {}) for r in rows]
            text = [f"{json.dumps({'index': k})}\n{t}" for k, t in zip(keys, text, strict=True)]
        return ("\n".join(text) + "\n" if self.index or self.lines else "[" + ",".join(text) + "]").encode()

    def write(self, iterator: Iterator) -> Sent:
        rows: list[dict] = []
        sent = batches = 0
        for row in iterator:
            rows.append({k: v for k, v in row.asDict(recursive=True).items() if v is not None})
            if len(rows) == self.size:
                self._send(rows)
                sent, batches, rows = sent + len(rows), batches + 1, []
        if rows:
            self._send(rows)
            sent, batches = sent + len(rows), batches + 1
        return Sent(sent, batches)

    def _send(self, rows: list[dict]) -> None:
        answer = fetch(self.url, *self.limits, data=self._body(rows), kind="application/x-ndjson" if self.index or self.lines else "application/json")
        if self.index and json.loads(answer or "{}").get("errors"):
            raise RuntimeError(f"{self.url} refused rows of a batch")


def fetch(url: str, retries: int = 10, pause: float = 0.1, timeout: float = 30, data: bytes | None = None, kind: str = "application/json") -> str:
    """The body of the answer to a GET, or to a POST of data; client errors other than 429 are final."""
    asked = urllib.request.Request(url, data, {"Content-Type": kind} if data is not None else {})  # noqa: S310
    for attempt in range(retries + 1):
        try:
            with urllib.request.urlopen(asked, timeout=timeout) as answer:  # noqa: S310
                return answer.read().decode("utf-8")
        except urllib.error.HTTPError as e:
            if attempt == retries or (e.code < 500 and e.code != 429):
                raise
            time.sleep(float(e.headers.get("Retry-After") or pause * 2**attempt))
        except urllib.error.URLError:
            if attempt == retries:
                raise
            time.sleep(pause * 2**attempt)
    raise AssertionError
