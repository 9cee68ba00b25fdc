"""Reports written by executors: a data source whose tasks write the rows of their partitions into parts beside the report, and whose
commit joins the parts in order. No row passes through the driver's memory, so a report may be larger than it. The report's folder
must be one that driver and executors share. Until the commit there is no report, or still the old one; parts of tasks that were
repeated or lost are not joined, and all of them are deleted in the end."""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from .render import FRAMES


@dataclass
class Part(WriterCommitMessage):
    partition: int
    path: str
    rows: int


class ReportWriter(DataSourceWriter):
    def __init__(self, options: dict) -> None:
        self.path, self.head, self.tail, self.none = options["path"], options["head"], options["tail"], options["none"]
        self.between, self.lead, self.kind = options["between"], options["lead"], options["kind"]
        self.folder = f"{self.path}.parts-{options['run']}"

    def item(self, row: Row) -> str:
        """Functions travel by the format's name."""
        from . import render, sarif

        return {"json": render.json_item, "sarif": sarif.item, "html": render.html_item}[self.kind](row)

    def write(self, iterator: Iterator[Row]) -> Part:
        task = TaskContext.get()
        path, n = os.path.join(self.folder, f"{task.partitionId()}-{task.taskAttemptId()}"), 0
        os.makedirs(self.folder, exist_ok=True)
        with open(path, "w", encoding="utf-8") as f:
            for row in iterator:
                f.write((self.between if n else "") + self.lead + self.item(row))
                n += 1
        return Part(task.partitionId(), path, n)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        os.makedirs(self.folder, exist_ok=True)
        whole = os.path.join(self.folder, "whole")
        with open(whole, "w", encoding="utf-8") as out:
            out.write(self.head)
            empty = True
            for part in sorted((m for m in messages if m is not None and m.rows), key=lambda m: m.partition):
                out.write("" if empty else self.between)
                empty = False
                with open(part.path, encoding="utf-8") as f:
                    shutil.copyfileobj(f, out, 1 << 20)
            out.write(self.none if empty else self.tail)
        os.replace(whole, self.path)
        shutil.rmtree(self.folder, ignore_errors=True)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        shutil.rmtree(self.folder, ignore_errors=True)


class LeakReport(DataSource):
    @classmethod
    def name(cls) -> str:
        return "leak_report"

    def schema(self) -> str:
        raise NotImplementedError("reports are only written")

    def writer(self, schema, overwrite: bool) -> ReportWriter:
        return ReportWriter(dict(self.options))


def write_report(found: DataFrame, kind: str, path: str) -> None:
    """Writes a JSON, SARIF or HTML report, the same text as render.report(), on the executors."""
    kind = kind.lower()
    if kind not in FRAMES:
        raise ValueError(f"no distributed report of the format {kind!r}")
    frame, ordered = FRAMES[kind][0](found), FRAMES[kind][1](found)
    found.sparkSession.dataSource.register(LeakReport)
    options = {"path": os.path.abspath(path), "kind": kind, "run": uuid.uuid4().hex, "head": frame.head, "tail": frame.tail, "none": frame.none, "between": frame.between, "lead": frame.lead}
    ordered.write.format("leak_report").options(**options).mode("append").save()
