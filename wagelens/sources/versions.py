"""Tables that are replaced as a whole: versions side by side and a pointer written last.

A table's folder holds its versions, a folder each, and ``_published``: empty files whose names
are a number and a version. The highest number is the current version. An empty file comes to
be in one step on any file system, object stores included, where renaming a folder is a copy.
So a write that fails, or stops between two steps, leaves the old version current and whole.

After a publication, versions before the newest ``KEEP`` go, and so do folders that no pointer
names once they are ``ORPHAN_HOURS`` old: a writer that was killed leaves one.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

KEEP = 2
ORPHAN_HOURS = 48

_LOG = "_published"
_DIGITS = 12


def file_system(spark: SparkSession, path: str):
    """The file system of a path, and the path as it knows it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder, if it is there, on whatever file system it lies."""
    files, place = file_system(spark, path)
    files.delete(place, True)


def published(spark: SparkSession, root: str) -> list[tuple[int, str]]:
    """(number, version) of all publications, oldest first; empty where there is none."""
    files, log = file_system(spark, f"{root}/{_LOG}")
    if not files.exists(log):
        return []
    names = [status.getPath().getName() for status in files.listStatus(log)]
    entries = [name.split(".", 1) for name in names if name[:_DIGITS].isdigit() and "." in name]
    return sorted((int(number), version) for number, version in entries)


def publish(spark: SparkSession, root: str, version: str) -> None:
    """Makes a complete version the current one. Of two writers at once the one that sorts last
    is current; either is whole."""
    number = max((n for n, _ in published(spark, root)), default=0) + 1
    files, entry = file_system(spark, f"{root}/{_LOG}/{number:0{_DIGITS}d}.{version}")
    if not files.createNewFile(entry):
        raise OSError(f"{entry} could not be made")


def current_version(spark: SparkSession, root: str) -> str:
    entries = published(spark, root)
    if not entries:
        raise FileNotFoundError(f"{root} has no published version")
    return entries[-1][1]


def current_path(spark: SparkSession, path: str) -> str:
    """The folder to read: of a versioned table its current version, else the path itself."""
    entries = published(spark, path)
    return f"{path}/{entries[-1][1]}" if entries else path


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table, versioned or plain."""
    return spark.read.parquet(current_path(spark, path))


def replace_table(
    spark: SparkSession, root: str, write: Callable[[str], object], name: str | None = None, keep: int = KEEP
) -> str:
    """``write(folder)`` into a new version, then make it current. The folder is returned.

    If ``write`` raises, its folder goes and the old version stays.
    """
    version = name or f"v-{uuid.uuid4().hex[:12]}"
    folder = f"{root}/{version}"
    try:
        write(folder)
    except BaseException:
        remove(spark, folder)
        raise
    publish(spark, root, version)
    retire(spark, root, keep)
    return folder


def retire(spark: SparkSession, root: str, keep: int = KEEP, orphan_hours: float = ORPHAN_HOURS) -> list[str]:
    """Removes versions before the newest ``keep``, and unpublished folders of some age.

    A pointer goes before its folder, so none ever names a folder that is partly gone. Only
    folders named as versions are (``run-...``, ``v-...``) count as unpublished ones.
    """
    entries = published(spark, root)
    old = entries[: max(0, len(entries) - max(1, keep))]
    kept = {version for _, version in entries[len(old) :]}
    for number, version in old:
        remove(spark, f"{root}/{_LOG}/{number:0{_DIGITS}d}.{version}")
    gone = [version for _, version in old if version not in kept]
    kinds = {version.partition("-")[0] for version in kept}
    files, place = file_system(spark, root)
    oldest = (time.time() - orphan_hours * 3600) * 1000
    for status in files.listStatus(place):
        name = status.getPath().getName()
        unnamed = status.isDirectory() and name.partition("-")[0] in kinds and name not in kept and name not in gone
        if unnamed and status.getModificationTime() < oldest:
            gone.append(name)
    for version in gone:
        remove(spark, f"{root}/{version}")
    return gone
