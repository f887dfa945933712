"""A store of report results and shared datasets, for all users of a cluster.

The dashboard kept each query's rows by its parameters until a timer ran out. Here an entry is
kept by its name, its parameters and a fingerprint of the files it was made from (path, length
and modification time of each): new or rewritten input files give another key, so an entry is
never stale, whoever wrote it. Two kinds of entries lie under ``path``, as Parquet:

* :meth:`ResultStore.result`: the rows of a report for one set of parameters;
* :meth:`ResultStore.rows`: rows of a dataset by day, in segments (a range of days each). A
  request computes only the days that no segment has, as a new segment, and reads the rest;
  so ranges that overlap share their days.

A folder counts once Spark has put its ``_SUCCESS`` file there, and a writer's folder has a name of
its own: a lost job leaves nothing that is read, and two writers of the same days do no harm
(a day is read from one segment only). :meth:`ResultStore.evict` removes what is outdated or
was never finished, :meth:`ResultStore.clear` everything.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterable, Mapping, Sequence
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import in_date_range
from ..params import as_date

DONE = "_SUCCESS"
DAY = timedelta(days=1)


def file_system(spark: SparkSession, path: str):
    """(the path's file system, the path), as the cluster's own classes."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def remove_folder(spark: SparkSession, path: str) -> None:
    fs, at = file_system(spark, path)
    fs.delete(at, True)


def folders_in(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders directly under ``path``; none if there is no such path."""
    fs, at = file_system(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory()) if fs.exists(at) else []


def fingerprint(frames: Iterable[DataFrame]) -> str:
    """A digest of the files behind the frames, from a listing that reads none of them."""
    files = sorted({f for df in frames for f in df.inputFiles()})
    if not files:
        raise ValueError("inputs without files have no fingerprint; store them first")
    spark = next(iter(frames)).sparkSession
    folders = sorted({f.rsplit("/", 1)[0] for f in files})
    listed = spark.read.format("binaryFile").load(folders).select("path", "length", "modificationTime")
    # A row a file comes to one sum; order and number of the tasks don't matter.
    each = F.xxhash64("path", "length", "modificationTime")
    total = listed.agg(F.count(F.lit(1)).alias("n"), F.sum(each.cast("decimal(38,0)")).alias("sum")).first()
    return hashlib.sha256(json.dumps([files, total["n"], str(total["sum"])]).encode()).hexdigest()


def uncovered(start: date, end: date, segments: Iterable[tuple[date, date]]) -> list[tuple[date, date]]:
    """The runs of days in ``start``..``end`` (inclusive) that no segment has, in order."""
    gaps, at = [], start
    for a, b in sorted(segments):
        if b < at or a > end:
            continue
        if a > at:
            gaps.append((at, a - DAY))
        at = max(at, b + DAY)
    return [*gaps, (at, end)] if at <= end else gaps


class ResultStore:
    """Entries under ``path``, a folder that the driver and all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._prints: dict[tuple, str] = {}

    def _fingerprint(self, sources: Sequence[DataFrame]) -> str:
        # The listing of one object's inputs is taken once: a refresh sees one state of them.
        key = tuple(id(df) for df in sources)
        if key not in self._prints:
            self._prints[key] = fingerprint(sources)
            self._kept = [*getattr(self, "_kept", []), *sources]  # ids stay theirs
        return self._prints[key]

    def _folder(self, name: str, params: Mapping[str, str], sources: Sequence[DataFrame]) -> str:
        named = json.dumps([name, sorted(params.items()), self._fingerprint(sources)])
        return f"{self.path}/{name}/{hashlib.sha256(named.encode()).hexdigest()}"

    def _complete(self, folder: str) -> list[str]:
        fs, _ = file_system(self.spark, folder)
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        return [f for f in folders_in(self.spark, folder) if fs.exists(path(f"{folder}/{f}/{DONE}"))]

    def result(
        self, name: str, params: Mapping[str, str], sources: Sequence[DataFrame], build: Callable[[], DataFrame]
    ) -> DataFrame:
        """The stored rows of ``build()`` for these parameters and source files; built if there are none.

        Rows keep the order they were made in only where that is one partition: sort again."""
        folder = self._folder(name, params, sources)
        found = self._complete(folder)
        if not found:
            build().write.parquet(f"{folder}/{(made := uuid.uuid4().hex)}")
            found = [made]
        return self.spark.read.parquet(f"{folder}/{found[0]}")

    def rows(
        self,
        name: str,
        sources: Sequence[DataFrame],
        timestamp: str,
        start: date | str,
        end: date | str,
        build: Callable[[date, date], DataFrame],
    ) -> DataFrame:
        """The rows of a dataset whose ``timestamp`` is on the days ``start`` to ``end``; ``build`` makes
        those of a range of days, and is asked for the days that are not stored yet."""
        folder, first, last = self._folder(name, {}, sources), as_date(start), as_date(end)
        for a, b in uncovered(first, last, (s[:2] for s in self._segments(folder))):
            build(a, b).write.parquet(f"{folder}/{a}_{b}_{uuid.uuid4().hex}")
        parts, covered = [], []
        for a, b, at in self._segments(folder):
            for x, y in uncovered(max(a, first), min(b, last), covered):
                parts.append(self.spark.read.parquet(f"{folder}/{at}").where(in_date_range(timestamp, x, y)))
                covered.append((x, y))
        return reduce(DataFrame.unionByName, parts)

    def _segments(self, folder: str) -> list[tuple[date, date, str]]:
        named = [(f.split("_"), f) for f in self._complete(folder)]
        return sorted((date.fromisoformat(p[0]), date.fromisoformat(p[1]), f) for p, f in named)

    def evict(self, name: str, current: Sequence[tuple[Mapping[str, str], Sequence[DataFrame]]]) -> int:
        """Remove the entries of ``name`` but the ``current`` ones (parameters and sources), and of
        these what was never finished; returns how many folders went. For times without writers."""
        kept = {self._folder(name, params, sources).rsplit("/", 1)[1] for params, sources in current}
        gone = [f"{self.path}/{name}/{f}" for f in folders_in(self.spark, f"{self.path}/{name}") if f not in kept]
        for key in kept:
            folder = f"{self.path}/{name}/{key}"
            done = set(self._complete(folder))
            gone += [f"{folder}/{f}" for f in folders_in(self.spark, folder) if f not in done]
        for folder in gone:
            remove_folder(self.spark, folder)
        return len(gone)

    def clear(self) -> None:
        remove_folder(self.spark, self.path)
