"""Numbered versions of models and tables with atomic publishing.

A publisher writes its folder under a name of its own, then takes the next free number by creating a claim file
(``createNewFile``: one creator wins, the others try the next number), and renames its folder to ``<prefix>-<number>``.
Readers see only such folders, which are whole; the newest is that of the largest number, whatever clocks say.  A publisher that
dies before the rename leaves an unseen folder and at most an unused number.

Claims and renames are atomic on HDFS and on POSIX file systems; an object store needs a committer that makes them so.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

DIGITS = 12


class Registry:
    """Versions of one kind of thing under a folder."""

    def __init__(self, spark: SparkSession, folder: str, prefix: str):
        if not re.fullmatch(r"[A-Za-z0-9_]+", prefix):
            raise ValueError("a prefix has letters, digits and underscores")
        self.folder, self.prefix = folder.rstrip("/"), prefix
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _numbers(self, folder: str) -> list[int]:
        root = self._path(folder)
        if not self._fs.exists(root):
            return []
        names = (re.fullmatch(rf"{self.prefix}-(\d{{{DIGITS}}})", st.getPath().getName()) for st in self._fs.listStatus(root))
        return sorted(int(m[1]) for m in names if m)

    def path_of(self, number: int) -> str:
        return f"{self.folder}/{self.prefix}-{number:0{DIGITS}d}"

    def versions(self) -> list[int]:
        """Published numbers, oldest first."""
        return self._numbers(self.folder)

    def newest(self) -> str | None:
        """Folder of the newest version."""
        found = self.versions()
        return self.path_of(found[-1]) if found else None

    def claim(self) -> int:
        """A number that no one else has or gets."""
        claims = f"{self.folder}/_claims"
        self._fs.mkdirs(self._path(claims))
        number = max([0, *self._numbers(claims), *self.versions()]) + 1
        while not self._fs.createNewFile(self._path(f"{claims}/{self.prefix}-{number:0{DIGITS}d}")):
            number += 1
        return number

    def publish(self, write: Callable[[str], object]) -> str:
        """Run ``write(folder)`` on a fresh folder and publish it as the newest version; returns its final folder."""
        staged = f"{self.folder}/_staged/{self.prefix}-{uuid.uuid4().hex}"
        write(staged)
        final = self.path_of(self.claim())
        if not self._fs.rename(self._path(staged), self._path(final)):
            raise OSError(f"could not publish {staged} as {final}")
        return final
