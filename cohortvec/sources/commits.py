"""Several outputs that become readable together, or not at all.

Outputs are written to a staging folder, moved to their places and named in a
manifest, which is written last.  Readers take a folder by its manifest, so what
a stopped write has left is never taken for a result.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

MANIFEST = "manifest.json"


class NotCommitted(Exception):
    """A folder without a manifest: nothing, or what a stopped write has left."""


def _files(spark: SparkSession, path: str):
    """Spark's file system for a path, and the path as it takes it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), place


def children(spark: SparkSession, folder: str) -> list[str]:
    """Names inside a folder; none if it does not exist."""
    files, place = _files(spark, folder)
    return sorted(f.getPath().getName() for f in files.listStatus(place)) if files.exists(place) else []


def remove(spark: SparkSession, path: str) -> None:
    files, place = _files(spark, path)
    files.delete(place, True)


def _move(spark: SparkSession, source: str, target: str) -> None:
    files, place = _files(spark, source)
    if not files.rename(place, _files(spark, target)[1]):
        raise FileExistsError(f"{target} cannot be put in place")


class Staging:
    """Where the parts of one output are written until they are committed."""

    def __init__(self, folder: str) -> None:
        self.folder, self.parts = f"{folder}/_staging-{uuid.uuid4().hex}", []

    def path(self, part: str) -> str:
        """Where to write a part."""
        self.parts.append(part)
        return f"{self.folder}/{part}"


@contextmanager
def staged(spark: SparkSession, folder: str, about: dict | None = None) -> Iterator[Staging]:
    """Write the parts below ``folder``, which must be new, and commit them on exit.

    ``about`` is kept in the manifest.  An error inside removes what was written.
    """
    left = [name for name in children(spark, folder) if not name.startswith("_staging-")]
    if left:
        raise FileExistsError(f"{folder} already exists, with {', '.join(left)}")
    staging = Staging(folder)
    try:
        yield staging
    except BaseException:
        remove(spark, staging.folder)
        raise
    for part in staging.parts:
        _move(spark, f"{staging.folder}/{part}", f"{folder}/{part}")
    files, place = _files(spark, f"{staging.folder}/{MANIFEST}")
    stream = files.create(place, False)
    stream.write(bytearray(json.dumps({"parts": staging.parts, "about": about or {}}).encode()))
    stream.close()
    _move(spark, f"{staging.folder}/{MANIFEST}", f"{folder}/{MANIFEST}")
    remove(spark, staging.folder)


def manifest(spark: SparkSession, folder: str) -> dict:
    """Parts and ``about`` of a committed folder."""
    if MANIFEST not in children(spark, folder):
        raise NotCommitted(f"{folder} holds no committed output")
    found = json.loads(spark.read.text(f"{folder}/{MANIFEST}", wholetext=True).first()[0])
    missing = set(found["parts"]) - set(children(spark, folder))
    if missing:
        raise NotCommitted(f"{folder} lacks {', '.join(sorted(missing))}")
    return found
