"""Publish a dataset only after it has passed, and write reports."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor

from py4j.java_gateway import JavaObject
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


class PublishRefused(RuntimeError):
    """The output may not be written, or what was written did not pass."""


def _filesystem(spark: SparkSession, path: str) -> tuple[JavaObject, Callable[[str], JavaObject]]:
    jvm = spark._jvm
    make = jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark._jsc.hadoopConfiguration()), make


def path_exists(spark: SparkSession, path: str) -> bool:
    files, make = _filesystem(spark, path)
    return files.exists(make(path))


def _same(spark: SparkSession, one: str, other: str) -> bool:
    files, make = _filesystem(spark, one)
    return files.makeQualified(make(one)).equals(files.makeQualified(make(other)))


def _replace(spark: SparkSession, staged: str, out: str, force: bool) -> None:
    """Move the staged folder into place; an older one steps aside and is
    dropped only after the new one stands."""
    files, make = _filesystem(spark, out)
    aside = f"{out.rstrip('/')}.old-{uuid.uuid4().hex}"
    had = files.exists(make(out))
    if had:
        if not force:
            raise PublishRefused(f"{out} exists; use force to replace it")
        files.rename(make(out), make(aside))
    if not files.rename(make(staged), make(out)):
        if had:
            files.rename(make(aside), make(out))
        raise PublishRefused(f"could not move {staged} to {out}")
    if had:
        files.delete(make(aside), True)


def publish(
    spark: SparkSession,
    tables: Mapping[str, DataFrame],
    out: str,
    source: str | None = None,
    force: bool = False,
    validate: Callable[[Mapping[str, DataFrame]], bool] | None = None,
) -> None:
    """Write tables aside, validate what was written, then move it into place.

    Refuses to write over the ``source`` or, without ``force``, over anything.
    What fails validation never appears under ``out``.
    """
    if source is not None and _same(spark, source, out):
        raise PublishRefused("output must not overwrite the input")
    if path_exists(spark, out) and not force:
        raise PublishRefused(f"{out} exists; use force to replace it")
    staged = f"{out.rstrip('/')}.staging-{uuid.uuid4().hex}"
    files, make = _filesystem(spark, staged)
    try:
        with ThreadPoolExecutor(max_workers=max(len(tables), 1)) as pool:
            list(pool.map(lambda name: tables[name].write.parquet(f"{staged}/{name}"), tables))
        written = {name: spark.read.parquet(f"{staged}/{name}") for name in tables}
        if validate is not None and not validate(written):
            raise PublishRefused("validation failed; nothing was published")
        _replace(spark, staged, out, force)
    finally:
        if files.exists(make(staged)):
            files.delete(make(staged), True)


def publish_version(
    spark: SparkSession,
    tables: Mapping[str, DataFrame],
    out: str,
    validate: Callable[[Mapping[str, DataFrame]], bool] | None = None,
    keep: int = 2,
) -> str:
    """Publish where a folder cannot be renamed at once: a new version beside the older ones, and a pointer to it.

    Tables go to a folder of their own, are validated there, and become current by one small file that
    is made only if it is not there yet. Its number follows the last one, so of two that publish side by side
    one is refused. Readers (``read_published``) see the version before until that file stands;
    whatever fails earlier leaves it current. The last ``keep`` versions stay for readers that are still at work.
    """
    files, make = _filesystem(spark, out)
    root = out.rstrip("/")
    number = (max(_pointers(spark, root)) if _pointers(spark, root) else 0) + 1
    version = f"{number:012d}-{uuid.uuid4().hex}"
    try:
        with ThreadPoolExecutor(max_workers=max(len(tables), 1)) as pool:
            list(pool.map(lambda name: tables[name].write.parquet(f"{root}/versions/{version}/{name}"), tables))
        written = {name: spark.read.parquet(f"{root}/versions/{version}/{name}") for name in tables}
        if validate is not None and not validate(written):
            raise PublishRefused("validation failed; the version before stays current")
        _point(spark, root, number, version)
    except BaseException:
        if _current(spark, root) != version:
            files.delete(make(f"{root}/versions/{version}"), True)
        raise
    for old in sorted(_pointers(spark, root))[:-keep]:
        files.delete(make(f"{root}/versions/{_read_text(spark, f'{root}/current/{old:012d}')}"), True)
        files.delete(make(f"{root}/current/{old:012d}"), False)
    return version


def read_published(spark: SparkSession, out: str) -> dict[str, DataFrame]:
    """The tables of the current version."""
    root = out.rstrip("/")
    version = _current(spark, root)
    if version is None:
        raise FileNotFoundError(f"nothing has been published under {out}")
    files, make = _filesystem(spark, root)
    folders = files.listStatus(make(f"{root}/versions/{version}"))
    names = sorted(status.getPath().getName() for status in folders if status.isDirectory())
    return {name: spark.read.parquet(f"{root}/versions/{version}/{name}") for name in names}


def _pointers(spark: SparkSession, root: str) -> list[int]:
    files, make = _filesystem(spark, root)
    folder = make(f"{root}/current")
    if not files.exists(folder):
        return []
    return [int(status.getPath().getName()) for status in files.listStatus(folder) if status.getPath().getName().isdigit()]


def _point(spark: SparkSession, root: str, number: int, version: str) -> None:
    files, make = _filesystem(spark, root)
    files.mkdirs(make(f"{root}/current"))
    try:
        stream = files.create(make(f"{root}/current/{number:012d}"), False)
    except Py4JJavaError as error:
        raise PublishRefused(f"another version {number} was published meanwhile") from error
    try:
        stream.write(bytearray(version.encode()))
    finally:
        stream.close()


def _read_text(spark: SparkSession, path: str) -> str:
    files, make = _filesystem(spark, path)
    stream = files.open(make(path))
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _current(spark: SparkSession, root: str) -> str | None:
    """The version of the last pointer that was written to its end."""
    files, make = _filesystem(spark, root)
    for number in sorted(_pointers(spark, root), reverse=True):
        version = _read_text(spark, f"{root}/current/{number:012d}")
        if version.startswith(f"{number:012d}-") and files.exists(make(f"{root}/versions/{version}")):
            return version
    return None


def write_report(report: DataFrame, out: str, force: bool = False) -> None:
    """A small report as one file of JSON lines, written aside and moved.

    NULLs stay visible and Unicode stays as it is.
    """
    spark = report.sparkSession
    staged = f"{out.rstrip('/')}.staging-{uuid.uuid4().hex}"
    report.coalesce(1).write.option("ignoreNullFields", False).json(staged)
    _replace(spark, staged, out, force)
