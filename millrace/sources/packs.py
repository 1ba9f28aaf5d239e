"""Packs: the many small files of an append-only table merged to a few large ones.

A pack takes over the files that were appended since the last one. As in a
log-structured table it also absorbs the newest packs while they are no more than
twice its size, so there are about log2(rows) packs and a row is written again as
often at most. A pack counts once its commit is there: one folder for each
commit with one row that names the packs and the files that they stand for.
Readers take the newest commit and the files that it does not name, so they see the
old files or the packs, never both. What no reader needs any more is deleted by
``vacuum`` after some days only, as older readers may still be at it.
"""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession

_COMMIT = "packs array<string>, files array<string>"


@dataclass(frozen=True)
class Layout:
    """What a reader opens: pack folders of the newest commit, and files appended since."""

    number: int
    packs: tuple[str, ...]
    covered: tuple[str, ...]
    tail: tuple[str, ...]


class Packs:
    """The packs of the table whose files are appended to ``source``; they lie in ``path``."""

    def __init__(self, spark: SparkSession, source: str, path: str):
        self.spark, self.source, self.path = spark, source.rstrip("/"), path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._hadoop(self.source).getFileSystem(spark._jsc.hadoopConfiguration())

    def _list(self, folder: str) -> list[tuple[str, float]]:
        """(name, seconds since its last change) of what is in a folder; nothing if there is none."""
        place = self._hadoop(folder)
        if not self._files.exists(place):
            return []
        now = time.time() * 1000
        return [(s.getPath().getName(), (now - s.getModificationTime()) / 1000) for s in self._files.listStatus(place)]

    def _commits(self) -> list[int]:
        """Numbers of the commits whose row is there, oldest first."""
        names = (re.fullmatch(r"n=(\d+)", name) for name, _ in self._list(f"{self.path}/commits"))
        numbers = sorted(int(n[1]) for n in names if n)
        return [n for n in numbers if any(name.endswith(".parquet") for name, _ in self._list(f"{self.path}/commits/n={n}"))]

    def _commit(self, number: int) -> Row:
        return self.spark.read.schema(_COMMIT).parquet(f"{self.path}/commits/n={number}").first()

    def layout(self) -> Layout:
        """The files of the table come before the commit, so a commit made in between names them or packs them."""
        there = sorted(name for name, _ in self._list(self.source) if name.endswith(".parquet"))
        commits = self._commits()
        if not commits:
            return Layout(0, (), (), tuple(there))
        row = self._commit(commits[-1])
        covered = set(row.files)
        return Layout(commits[-1], tuple(row.packs), tuple(row.files), tuple(n for n in there if n not in covered))

    def places(self, layout: Layout, kind: str) -> list[str]:
        """The paths to read: ``kind`` of each pack (rows or state; rows where it has no state of its own), and the tail."""
        own = lambda p: any(name == kind for name, _ in self._list(f"{self.path}/{p}"))
        return [f"{self.path}/{p}/{kind if own(p) else 'rows'}" for p in layout.packs] + [f"{self.source}/{name}" for name in layout.tail]

    def _size(self, pack: str) -> int:
        return self._files.getContentSummary(self._hadoop(f"{self.path}/{pack}/rows")).getLength()

    def pack(self, read: Callable[[list[str]], DataFrame], laid: Callable[[DataFrame], DataFrame], state: Callable[[DataFrame], DataFrame] | None) -> Layout:
        """Take over the tail. ``laid`` orders rows for writing; ``state`` are those of a pack that the current state needs.

        A crash leaves folders that no commit names; the next call takes the tail again.
        """
        old = self.layout()
        if not old.tail:
            return old
        tail = [f"{self.source}/{name}" for name in old.tail]
        size = sum(self._files.getFileStatus(self._hadoop(p)).getLen() for p in tail)
        kept, absorbed = list(old.packs), []
        while kept and (last := self._size(kept[-1])) <= 2 * size:
            absorbed.append(kept.pop())
            size += last
        name = f"pack-{uuid.uuid4().hex}"
        laid(read([*tail, *(f"{self.path}/{p}/rows" for p in absorbed)])).write.option("compression", "zstd").parquet(f"{self.path}/{name}/rows")
        if state is not None:
            rows = read([f"{self.path}/{name}/rows"])
            needed = state(rows)
            if 2 * needed.count() < rows.count():  # counted without texts
                needed.write.option("compression", "zstd").parquet(f"{self.path}/{name}/state")
        present = {n for n, _ in self._list(self.source)}
        row = ([*kept, name], [n for n in (*old.covered, *old.tail) if n in present])
        self.spark.createDataFrame([row], _COMMIT).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/n={old.number + 1}")
        return self.layout()

    def vacuum(self, hours: float) -> int:
        """Delete what no reader can need that began less than so many hours ago: how many files and folders went.

        Such a reader has a commit of that time or the last one before; what that one
        names as files was in packs already.
        """
        ages = dict(self._list(f"{self.path}/commits"))
        commits = self._commits()
        before = [n for n in commits if ages[f"n={n}"] >= hours * 3600]
        if not before:
            return 0
        named = {n: self._commit(n) for n in commits if n >= before[-1]}
        live = {"commits", *(p for row in named.values() for p in row.packs)}
        covered = set(named[before[-1]].files)
        old = [f"{self.source}/{n}" for n, _ in self._list(self.source) if n in covered]
        old += [f"{self.path}/{n}" for n, age in self._list(self.path) if n not in live and age >= hours * 3600]
        old += [f"{self.path}/commits/n={n}" for n in before[:-1]]
        for place in old:
            self._files.delete(self._hadoop(place), True)
        return len(old)
