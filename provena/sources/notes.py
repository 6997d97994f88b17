"""Folders of notes as a PySpark data source.

Unlike the built-in file source it sees hidden and underscore names, takes a missing
folder as empty, and keeps folder order. Options: paths (a JSON list of folders), and
files_per_partition. Symbolic links to folders are not followed.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..schema import DOCUMENTS, HTML_SUFFIXES, MARKDOWN_SUFFIXES

SUFFIXES = MARKDOWN_SUFFIXES + HTML_SUFFIXES


def listed(folders: list[str]) -> list[tuple[int, str, str]]:
    """Source number, relative and full path of every document, in reading order."""
    out = []
    for number, folder in enumerate(sorted(folders)):
        stack = [folder]
        while stack:
            top = stack.pop()
            try:
                with os.scandir(top) as it:
                    entries = sorted(it, key=lambda e: e.name)
            except OSError:
                continue
            out += [(number, os.path.relpath(e.path, folder), e.path) for e in entries if not e.is_dir() and e.name.endswith(SUFFIXES)]
            stack += [e.path for e in reversed(entries) if e.is_dir(follow_symlinks=False)]
    return out


def read_text(path: str) -> str:
    """A file's text: no byte order mark, bad bytes replaced, every line end a newline."""
    with open(path, encoding="utf-8-sig", errors="replace") as f:
        return f.read()


class _Files(InputPartition):
    def __init__(self, files: list[tuple[int, str, str]]):
        self.files = files


class NotesDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "notes"

    def schema(self) -> str:
        return DOCUMENTS

    def reader(self, schema) -> DataSourceReader:
        return NotesReader(dict(self.options))


class NotesReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folders = json.loads(options["paths"])
        self.group = int(options.get("files_per_partition", 500))

    def partitions(self) -> list[InputPartition]:
        files = listed(self.folders)
        return [_Files(files[i : i + self.group]) for i in range(0, len(files), self.group)] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[tuple]:
        for number, relative, path in partition.files:
            yield number, relative, path, os.path.getmtime(path), read_text(path)


def read_notes(spark: SparkSession, folders: list[str]) -> DataFrame:
    """src_ord, rel_path, path, mtime and text of every document under the folders."""
    spark.dataSource.register(NotesDataSource)
    return spark.read.format("notes").option("paths", json.dumps(list(folders))).load()


def diagnosis(folders: list[str], documents: int) -> str:
    """Why there is nothing to map, or "" when there is."""
    missing = [f for f in folders if not os.path.isdir(f)]
    if missing:
        return "not found: " + ", ".join(missing)
    return "" if documents else "no documents under " + ", ".join(folders)
