"""A folder of HTML files as a table, and receipts as lines of JSON: Spark's Python data sources.

`spark.dataSource.register(PageFolder)` once, then `spark.read.format("page_folder").load(path)`;
receipts are written by `df.write.format("receipt_lines").mode("append").save(path)`, each task
a file that is renamed when whole, after values that may not leave are neutralised. Both use
local or mounted paths.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..operators.stores import OMITTED, SCRUBBED


@dataclass
class Files(InputPartition):
    names: list[str]
    first: int


class PageReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.many = options["path"], int(options.get("filesperpartition", 100))

    def partitions(self) -> list[InputPartition]:
        names = sorted(n for n in os.listdir(self.path) if n.endswith((".html", ".htm")))
        return [Files(names[i : i + self.many], i) for i in range(0, len(names), self.many)] or [Files([], 0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for i, name in enumerate(partition.names):
            with open(os.path.join(self.path, name), encoding="utf-8", errors="replace") as f:
                yield partition.first + i, "file://" + os.path.join(os.path.abspath(self.path), name), f.read()


class PageFolder(DataSource):
    """(page_id, url, html) of the .html files in a folder, numbered in the order of their names."""

    @classmethod
    def name(cls) -> str:
        return "page_folder"

    def schema(self) -> str:
        return "page_id long, url string, html string"

    def reader(self, schema) -> DataSourceReader:
        return PageReader(self.options)


@dataclass
class Written(WriterCommitMessage):
    part: str
    whole: str


def neutral(x):
    """A record without what dangerous keys hold, at any depth."""
    if isinstance(x, dict):
        return {k: OMITTED if k in SCRUBBED else neutral(v) for k, v in x.items()}
    return [neutral(v) for v in x] if isinstance(x, (list, tuple)) else x


class ReceiptWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self.path = options["path"]

    def write(self, rows: Iterator) -> WriterCommitMessage:
        os.makedirs(self.path, exist_ok=True)
        whole = os.path.join(self.path, f"{uuid.uuid4().hex}.jsonl")
        with open(whole + ".part", "w", encoding="utf-8") as f:
            for row in rows:
                f.write(json.dumps(neutral(row.asDict(recursive=True)), default=str, sort_keys=True) + "\n")
        return Written(whole + ".part", whole)

    def commit(self, messages: list) -> None:
        for m in messages:
            if m is not None:
                os.replace(m.part, m.whole)

    def abort(self, messages: list) -> None:
        for m in messages:
            if m is not None and os.path.exists(m.part):
                os.remove(m.part)


class ReceiptLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "receipt_lines"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return ReceiptWriter(self.options)
