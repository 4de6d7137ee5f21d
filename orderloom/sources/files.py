"""Small questions to the file system, asked through Hadoop so that any store works."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def _open(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def has_data(spark: SparkSession, path: str) -> bool:
    """Is there at least one data file below ``path``? Stops at the first."""
    fs, target = _open(spark, path)
    if not fs.exists(target):
        return False
    files = fs.listFiles(target, True)
    while files.hasNext():
        below = files.next().getPath().toString()[len(fs.makeQualified(target).toString()):]
        if not any(part.startswith(("_", ".")) for part in below.split("/") if part):
            return True
    return False


def data_files(spark: SparkSession, folder: str) -> list[str]:
    """Data files right in ``folder``."""
    fs, target = _open(spark, folder)
    found = (status.getPath() for status in fs.listStatus(target) if status.isFile())
    return sorted(path.toString() for path in found if not path.getName().startswith(("_", ".")))


def state_of(spark: SparkSession, path: str) -> frozenset[tuple[str, int, int]]:
    """Names, lengths and times of the files below ``path``: equal while nobody has written there."""
    fs, target = _open(spark, path)
    if not fs.exists(target):
        return frozenset()
    found, files = set(), fs.listFiles(target, True)
    while files.hasNext():
        status = files.next()
        found.add((status.getPath().toString(), status.getLen(), status.getModificationTime()))
    return frozenset(found)


def list_dirs(spark: SparkSession, path: str, prefix: str) -> list[tuple[int, str]]:
    """Sub-folders called ``{prefix}=<number>`` as (number, path), largest number first."""
    fs, target = _open(spark, path)
    if not fs.exists(target):
        return []
    found = []
    for status in fs.listStatus(target):
        name, _, value = status.getPath().getName().partition("=")
        if status.isDirectory() and name == prefix and value.isdigit():
            found.append((int(value), status.getPath().toString()))
    return sorted(found, reverse=True)


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _open(spark, path)
    return fs.exists(target)


def mark(spark: SparkSession, path: str) -> None:
    """An empty file, there or not there: what it vouches for has been written."""
    fs, target = _open(spark, path)
    fs.create(target, True).close()


def move_below(spark: SparkSession, source: str, target: str) -> None:
    """Move the data files below ``source`` to the same places below ``target``. May be repeated.

    A folder that the target lacks is moved as one; only folders on both sides are looked into.
    """
    fs, top = _open(spark, source)
    if not fs.exists(top):
        return
    _, place = _open(spark, target)
    fs.mkdirs(place)
    there = {found.getPath().getName() for found in fs.listStatus(place)}
    for found in fs.listStatus(top):
        name = found.getPath().getName()
        if name.startswith(("_", ".")):
            continue
        if found.isDirectory() and name in there:
            move_below(spark, f"{source}/{name}", f"{target}/{name}")
        elif not fs.rename(found.getPath(), _open(spark, f"{target}/{name}")[1]):
            raise OSError(f"could not move {found.getPath()} to {target}")


def delete(spark: SparkSession, path: str) -> None:
    fs, target = _open(spark, path)
    fs.delete(target, True)


def day_folders(spark: SparkSession, path: str) -> Iterator[tuple[str, str]]:
    """Days (as text) and folders of a table laid out by date, newest first, listed as needed."""
    for y, year in list_dirs(spark, path, "year"):
        for m, month in list_dirs(spark, year, "month"):
            for d, folder in list_dirs(spark, month, "day"):
                yield f"{y:04}-{m:02}-{d:02}", folder


def newest_day(spark: SparkSession, path: str) -> str | None:
    return next((day for day, _ in day_folders(spark, path)), None)


def latest_watermark(spark: SparkSession, path: str, ts: str) -> str | None:
    """Largest ``ts`` of a table laid out by the date of ``ts``, as text.

    Looks into the newest day instead of scanning the table: three folder listings and one
    day's column, however long the history is.
    """
    for _, folder in day_folders(spark, path):
        if has_data(spark, folder):
            found = spark.read.parquet(folder).agg(F.max(ts).cast("string")).first()[0]
            if found is not None:
                return found
    return None
