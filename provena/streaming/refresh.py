"""Rebuilding a map when its documents change.

A map is always rebuilt as a whole, so it cannot drift from its documents; what is skipped
is a rebuild without a change. `watch` runs as a stream over the state of the folders: a
trigger whose listing differs from the last one (a note added, edited or removed, a folder
gone or back) is one batch, and a batch is one rebuild. The stream's checkpoint remembers
the listing, so a restart rebuilds nothing that is up to date.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from ..operators import graph
from ..schema import WATCHED_NAMES
from ..sources import map_store
from ..sources.notes import listed, read_notes
from ..sources.shared import written


def rebuild(spark: SparkSession, folders: list[str], path: str, watched: tuple[str, ...] = WATCHED_NAMES, force: bool = False, as_json: bool = False) -> bool:
    """Build the map at path if its documents changed; whether it was built. as_json: also as one
    canonical JSON file at the path, which streams through the driver: for maps of a size that
    one file is of use for."""
    store = map_store.MapStore(path)
    docs = read_notes(spark, folders)
    mark = map_store.fingerprint(docs, folders).first().asDict()
    if not force and store.unchanged(mark):
        return False
    pieces = graph.parse(docs.select("src_ord", "rel_path", "text"))
    nodes, links = written(graph.nodes(pieces), "nodes"), written(graph.links(pieces), "links")
    store.write(nodes, links, mark, as_json)
    store.report(nodes, watched)
    return True


def state(folders: list[str]) -> str:
    """A hash of every document's path, size and time of change."""
    marks = hashlib.sha256()
    for number, relative, path in listed(folders):
        try:
            found = os.stat(path)
        except OSError:
            continue
        marks.update(json.dumps([number, relative, found.st_size, found.st_mtime_ns]).encode())
    return marks.hexdigest()


class NoteChanges(DataSource):
    """One row, the new state of the folders, each time it differs from the one before."""

    @classmethod
    def name(cls) -> str:
        return "note_changes"

    def schema(self) -> str:
        return "state string"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Changes(json.loads(self.options["paths"]))


class _Changes(SimpleDataSourceStreamReader):
    def __init__(self, folders: list[str]):
        self.folders = folders

    def initialOffset(self) -> dict:
        return {"state": ""}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        now = state(self.folders)
        return iter([] if now == start["state"] else [(now,)]), {"state": now}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([] if start == end else [(end["state"],)])


def watch(spark: SparkSession, folders: list[str], path: str, checkpoint: str, watched: tuple[str, ...] = WATCHED_NAMES, every: str | None = None):
    """A streaming query that rebuilds the map when notes under the folders change: once, then it
    ends, or with `every` (an interval such as "10 seconds") until it is stopped."""
    spark.dataSource.register(NoteChanges)

    def batch(changes: DataFrame, _: int) -> None:
        if not changes.isEmpty():
            rebuild(spark, folders, path, watched)

    changes = spark.readStream.format("note_changes").option("paths", json.dumps(list(folders))).load()
    trigger = {"processingTime": every} if every else {"once": True}
    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**trigger).start()
