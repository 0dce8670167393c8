"""A data source for documents: ``spark.read.format("saldo_documents").load(path)``.

One partition stands for a group of files of about ``group_bytes``; each file is opened once, and its rows (``files.PARTS``) come from
that one look. The option ``partes`` names the kinds of rows that are wanted; others are neither parsed nor sent. (Filters aren't pushed: a reader's
state is shared by all scans of one DataFrame, so two filters on it would get each other's rows.) Files are listed and opened
with Arrow's file systems, so the path may be a URI of any store that Arrow knows; stores that only Spark reaches are read by
``files.document_parts`` over ``files.binary_files``, with the same parser.
"""

from __future__ import annotations

import importlib
import os
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from saldospark.sources import files

GROUP_BYTES = 64 << 20
NAME = "saldo_documents"


class Group(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


def _named(function: str | None) -> Callable[[bytes], list[str]] | None:
    """The function that ``module:name`` stands for."""
    if not function:
        return None
    module, name = function.split(":")
    return getattr(importlib.import_module(module), name)


class DocumentReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.pages = options["path"], options.get("pages")
        self.group, self.want = int(options.get("group_bytes", GROUP_BYTES)), tuple(options.get("partes", ",".join(files.PARTES)).split(","))

    def _system(self):
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(self.path if "://" in self.path else os.path.abspath(self.path))
        return system, fs.FileSelector(root, recursive=True), fs.FileType.File

    def partitions(self) -> list[Group]:
        system, where, kind = self._system()
        groups, size = [], 0
        for f in sorted((f for f in system.get_file_info(where) if f.type == kind), key=lambda f: f.path):
            if not groups or size + f.size > self.group:
                groups.append([])
                size = 0
            groups[-1].append(f.path)
            size += f.size
        return [Group(g) for g in groups] or [Group([])]

    def read(self, partition: Group) -> Iterator[tuple]:
        pages, (system, _, _) = _named(self.pages), self._system()
        for path in partition.paths:
            with system.open_input_stream(path) as f:
                content = f.read()
            suffix = os.path.splitext(path)[1][1:].lower()
            for part in files.file_parts(content, suffix, pages, self.want):
                if part[0] in self.want:
                    yield path, *part


class DocumentSource(DataSource):
    """Options: ``path``, ``pages`` (``module:function`` from the bytes of a PDF file to its pages), ``group_bytes``, ``partes``."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return files.PARTS

    def reader(self, schema) -> DocumentReader:
        return DocumentReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    spark.dataSource.register(DocumentSource)
