"""A sink of named CSV files, one a report, published together when all tasks are done."""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from urllib.parse import urlparse

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import csv, fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

#: The column that says which file a row belongs to; it is not written.
FILE = "_file"
#: Files that are published at a time.
MOVERS = 16


@dataclass
class Written(WriterCommitMessage):
    """Files of one task: (name, where it is until it is published)."""

    files: list[tuple[str, str]]


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if urlparse(path).scheme else (fs.LocalFileSystem(), path)


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path, self.staging = path.rstrip("/"), f"{path.rstrip('/')}/_staging-{uuid.uuid4().hex}"

    def write(self, batches):
        """Rows of a file come together, so one file is open at a time."""
        system, staging = _open(self.staging)
        system.create_dir(staging, recursive=True)
        files, name, out = [], None, None
        for batch in batches:
            names = batch.column(batch.schema.get_field_index(FILE))
            rest = batch.drop_columns([FILE])
            runs = pc.run_end_encode(names)
            start = 0
            for end, value in zip(runs.run_ends.to_pylist(), runs.values.to_pylist(), strict=True):
                if value != name:
                    if out is not None:
                        out.close()
                    at = f"{staging}/{uuid.uuid4().hex}"
                    name, out = value, csv.CSVWriter(system.open_output_stream(at), rest.schema, write_options=csv.WriteOptions(quoting_style="needed"))
                    files.append((name, at))
                out.write_batch(rest.slice(start, end - start))
                start = end
        if out is not None:
            out.close()
        return Written(files)

    def commit(self, messages):
        """Move every file to its name, replacing one that is there; a name that two tasks wrote is an error, found before anything moves."""
        system, path = _open(self.path)
        files = [f for m in messages if m is not None for f in m.files]
        if len({name for name, _ in files}) != len(files):
            raise ValueError("rows of one report came from several tasks")
        for folder in {f"{path}/{name}".rsplit("/", 1)[0] for name, _ in files}:
            system.create_dir(folder, recursive=True)
        with ThreadPoolExecutor(MOVERS) as pool:
            list(pool.map(lambda f: system.move(f[1], f"{path}/{f[0]}"), files))
        self._clean()

    def abort(self, messages):
        self._clean()

    def _clean(self):
        system, staging = _open(self.staging)
        if system.get_file_info(staging).type != fs.FileType.NotFound:
            system.delete_dir(staging)


class ReportSink(DataSource):
    @classmethod
    def name(cls):
        return "named_reports"

    def schema(self):
        return "_file string"

    def writer(self, schema, overwrite):
        return _Writer(self.options["path"])


def write_named(rows: DataFrame, path: str, file: str, *order: str | Column) -> None:
    """``rows`` as CSV files below ``path``, named by the column ``file`` (which may hold folders), rows of a file by ``order``.

    Files are written aside and get their names when all are whole, so a failed or repeated run leaves no part of one; files that a run
    does not name stay.  One task writes a file, and there are as many tasks as shuffle partitions.  Columns are written as text.
    """
    rows.sparkSession.dataSource.register(ReportSink)
    text = rows.withColumnRenamed(file, FILE).repartition(FILE).sortWithinPartitions(FILE, *order)
    plain = text.select(*[F.col(f"`{c}`").cast("string").alias(c) if t != "boolean" else F.initcap(F.col(f"`{c}`").cast("string")).alias(c) for c, t in text.dtypes])
    plain.write.format(ReportSink.name()).mode("append").save(path)
