"""Printed reports as files: ``df.write`` and ``spark.read`` with format "tidewire_reports".

A row is a piece of a file: (report_id, part, number, text). Each (report_id, part) becomes one file that holds its pieces in
the order of their numbers, between the options ``head`` and ``tail`` and joined by ``between``, and is named by its SHA-256. Pieces
are written as they come, so a task holds one of them at a time; rows must be dealt by (report_id, part) and sorted within tasks,
which ``write_reports`` sees to, and which the writer checks.

Tasks write below ``root/_writing-RUN/``, each attempt in a folder of its own with an index of its files. Commit drops what lost or repeated
attempts left and renames the folder to ``root/run=RUN``; abort drops it whole. So readers see all files of a run or none,
and nothing but counts and one folder name a task passes through the driver. ``mode("overwrite")`` drops earlier runs after the commit.

Reading gives (run, report_id, part, n_pieces, n_bytes, sha256, path, content); a file that does not have its name's digest is an error.
Option ``content`` "false" leaves the files unopened. The path must be one that pyarrow.fs opens in every task.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from tidewire.sources.connector import _folders, _opened

FORMAT = "tidewire_reports"
PIECE = "report_id string, part int, number long, text string"
STORED = "run string, report_id string, part int, n_pieces long, n_bytes long, sha256 string, path string, content string"
INDEX = "index.jsonl"


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ReportFiles)


def write_reports(pieces: DataFrame, root: str, suffix: str = "html", head: str = "", between: str = "", tail: str = "", run: str | None = None, mode: str = "append") -> None:
    """Writes pieces (report_id, part, number, text), one file for each report and part, as one run."""
    register(pieces.sparkSession)
    dealt = pieces.selectExpr("cast(report_id as string) report_id", "cast(part as int) part", "cast(number as long) number", "text")
    dealt = dealt.repartition("report_id", "part").sortWithinPartitions("report_id", "part", "number")
    options = {"suffix": suffix, "head": head, "between": between, "tail": tail, "run": run or uuid.uuid4().hex}
    dealt.write.format(FORMAT).options(**options).mode(mode).save(root)


def read_reports(spark: SparkSession, root: str, content: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format(FORMAT).option("content", str(content).lower()).load(root)


@dataclass
class Written(WriterCommitMessage):
    folder: str
    files: int


class ReportWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.run = options.get("run") or uuid.uuid4().hex
        self.suffix = options.get("suffix", "html")
        self.head, self.between, self.tail = (options.get(k, "").encode() for k in ("head", "between", "tail"))
        fs, root = _opened(self.path)
        if fs.get_file_info(f"{root}/run={self.run}").type != pyarrow.fs.FileType.NotFound:
            raise ValueError(f"run {self.run} is there already")

    def write(self, iterator: Iterator) -> Written:
        fs, root = _opened(self.path)
        mine = f"{root}/_writing-{self.run}/{uuid.uuid4().hex}"
        fs.create_dir(mine)
        try:
            files, last = 0, None
            with fs.open_output_stream(f"{mine}/{INDEX}") as index:
                for key, rows in groupby(iterator, key=lambda r: (r[0], r[1])):
                    if None in key or (last is not None and key <= last):
                        raise ValueError(f"rows must be sorted by report and part, which must be known: {key} after {last}")
                    index.write(json.dumps(self._file(fs, mine, key, rows)).encode() + b"\n")
                    files, last = files + 1, key
        except BaseException:
            fs.delete_dir(mine)
            raise
        return Written(mine, files)

    def _file(self, fs: pyarrow.fs.FileSystem, mine: str, key: tuple[str, int], rows: Iterator) -> dict:
        digest, size, count, before = hashlib.sha256(), 0, 0, None
        with fs.open_output_stream(f"{mine}/unnamed") as out:

            def put(raw: bytes) -> None:
                nonlocal size
                out.write(raw)
                digest.update(raw)
                size += len(raw)

            put(self.head)
            for _, _, number, text in rows:
                if number is None or (before is not None and number <= before):
                    raise ValueError(f"numbers of {key} must ascend: {number} after {before}")
                if count:
                    put(self.between)
                put((text or "").encode())
                count, before = count + 1, number
            put(self.tail)
        name = f"{digest.hexdigest()}.{self.suffix}"
        fs.move(f"{mine}/unnamed", f"{mine}/{name}")
        return {"report_id": key[0], "part": key[1], "n_pieces": count, "n_bytes": size, "sha256": digest.hexdigest(), "name": name}

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = _opened(self.path)
        aside, kept = f"{root}/_writing-{self.run}", {m.folder for m in messages if m}
        fs.create_dir(aside)
        for folder in _folders(fs, aside):
            if folder not in kept:  # of an attempt that was lost or not needed
                fs.delete_dir(folder)
        fs.move(aside, f"{root}/run={self.run}")
        if self.overwrite:
            for folder in _folders(fs, root):
                if folder.rpartition("/")[2].startswith("run=") and not folder.endswith(f"/run={self.run}"):
                    fs.delete_dir(folder)

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = _opened(self.path)
        aside = f"{root}/_writing-{self.run}"
        if fs.get_file_info(aside).type != pyarrow.fs.FileType.NotFound:
            fs.delete_dir(aside)


@dataclass
class Attempt(InputPartition):
    run: str
    folder: str

    def __post_init__(self) -> None:
        super().__init__(self.folder)


class ReportReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.content = options["path"].rstrip("/"), options.get("content", "true") == "true"

    def partitions(self) -> list[Attempt]:
        fs, root = _opened(self.path)
        runs = [f for f in _folders(fs, root) if f.rpartition("/")[2].startswith("run=")]
        return [Attempt(run.rpartition("run=")[2], f) for run in runs for f in _folders(fs, run)] or [Attempt("", "")]

    def read(self, partition: Attempt) -> Iterator[tuple]:
        if not partition.folder:
            return
        fs = _opened(self.path)[0]
        with fs.open_input_stream(f"{partition.folder}/{INDEX}") as index:
            entries = index.read().decode().splitlines()
        for entry in map(json.loads, entries):
            path, content = f"{partition.folder}/{entry['name']}", None
            if self.content:
                with fs.open_input_stream(path) as stream:
                    raw = stream.read()
                if hashlib.sha256(raw).hexdigest() != entry["sha256"]:
                    raise ValueError(f"{path} is not what was written")
                content = raw.decode()
            yield partition.run, entry["report_id"], entry["part"], entry["n_pieces"], entry["n_bytes"], entry["sha256"], path, content


class ReportFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return STORED

    def reader(self, schema) -> ReportReader:
        return ReportReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> ReportWriter:
        return ReportWriter(dict(self.options), overwrite)
