"""Source files and source tables."""

from __future__ import annotations

import posixpath
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def plain_path(uri: Column) -> Column:
    """File URI to path: the local scheme and percent escapes are removed."""
    local = F.regexp_replace(uri, r"\Afile:/*+", "/")
    return F.url_decode(F.replace(local, F.lit("+"), F.lit("%2B")))


def distinct_targets(targets: Sequence[str], recursive: bool) -> list[str]:
    """The targets without those that another one already reaches.

    Spark reads a path once for each time it is named, so repeats are removed here,
    where they cost nothing, and not by a shuffle of file contents.
    """
    kept = list(dict.fromkeys(targets))
    whole = set(kept)

    def covered(path: str) -> bool:
        parent = posixpath.dirname(path)
        if not recursive:
            return path.endswith(".sol") and parent in whole
        while parent != posixpath.dirname(parent):
            if parent in whole:
                return True
            parent = posixpath.dirname(parent)
        return parent in whole and parent != path

    return [p for p in kept if not covered(p)]


def _qualified(spark: SparkSession, target: str):
    """The target as a Hadoop path with its file system and without dots."""
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    if "://" not in target and hadoop.FileSystem.getDefaultUri(conf).getScheme() == "file":
        target = posixpath.abspath(target)
    path = hadoop.Path(target)
    return hadoop.Path(path.getFileSystem(conf).makeQualified(path).toUri().normalize())


def read_sources(
    spark: SparkSession, targets: Sequence[str] | str, recursive: bool = False, suffix: str = ".sol",
    on_error: str = "fail",
) -> DataFrame:
    """``path, file_name, content``, one row per file below the targets.

    Other files are ignored and a missing target raises. A file that vanishes or
    cannot be read fails the job; with ``on_error="skip"`` it is left out, and
    ``skipped_sources`` names it. Names starting with ``_`` or ``.`` are not
    listed by Spark.
    """
    files, uri = _listed(spark, targets, recursive, suffix, on_error, "text")
    path = plain_path(uri)
    return files.select(
        path.alias("path"), F.element_at(F.split(path, "/"), -1).alias("file_name"),
        F.col("value").alias("content"),
    )


def skipped_sources(
    spark: SparkSession, targets: Sequence[str] | str, recursive: bool = False, suffix: str = ".sol"
) -> DataFrame:
    """``path`` of files that are listed but cannot be read.

    The listing opens no file; the files are read once to see which can be.
    """
    files, uri = _listed(spark, targets, recursive, suffix, "skip", "binaryFile")
    readable = read_sources(spark, targets, recursive, suffix, on_error="skip").select("path")
    return files.select(plain_path(uri).alias("path")).join(readable, "path", "left_anti")


def _direct(spark: SparkSession, targets: list, suffix: str) -> list[str]:
    """Patterns for the direct children of directories, so that nothing below them is listed; other targets as they are.

    A directory without such a child has no pattern, as Spark fails on one that matches nothing.
    """
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    found = []
    for path in targets:
        system = path.getFileSystem(conf)
        children = hadoop.Path(path, f"*{suffix}")
        if not system.exists(path) or system.getFileStatus(path).isFile():
            found.append(path.toString())
        elif len(system.globStatus(children) or ()):
            found.append(children.toString())
    return found


def _listed(
    spark: SparkSession, targets: Sequence[str] | str, recursive: bool, suffix: str, on_error: str, source: str
) -> tuple[DataFrame, Column]:
    """The files below the targets in one of Spark's file formats, and their URI."""
    if on_error not in ("fail", "skip"):
        raise ValueError("on_error is 'fail' or 'skip'")
    targets = [targets] if isinstance(targets, str) else list(targets)
    if not targets:
        raise ValueError("no targets given")
    qualified = {path.toString(): path for path in (_qualified(spark, t) for t in targets)}
    paths = distinct_targets(list(qualified), recursive)
    loaded = paths if recursive else _direct(spark, [qualified[p] for p in paths], suffix) or paths
    # Recursive lookup also when children of subdirectories are not wanted: without
    # it, directory names such as ``k=v`` would be taken for partitions. The filter on
    # the file's path is applied to the listing, so those children are never opened.
    skip = on_error == "skip"
    options = {"ignoreMissingFiles": skip, "ignoreCorruptFiles": skip, "pathGlobFilter": f"*{suffix}", "recursiveFileLookup": True}
    if source == "text":
        options["wholetext"] = True
    files = spark.read.format(source).options(**options).load(loaded)
    # Local URIs are spelled with one or with three slashes.
    uri = F.regexp_replace("_metadata.file_path", r"\Afile:/*+", "file:/")
    if not recursive:
        uris = [re.sub(r"\Afile:/+", "file:/", qualified[p].toUri().toString()) for p in paths]
        files = files.where(uri.isin(uris) | F.regexp_replace(uri, r"/[^/]*\z", "").isin(uris))
    return files, uri


def table_sources(table: DataFrame, path: str | Column = "path", content: str | Column = "content") -> DataFrame:
    """Any table that holds source texts; the main input at scale."""
    as_column = lambda c: F.col(c) if isinstance(c, str) else c
    return table.select(as_column(path).alias("path"), as_column(content).alias("content"))


def require_sources(sources: DataFrame) -> DataFrame:
    """Raise when there is nothing to scan."""
    if sources.isEmpty():
        raise ValueError("no source files found in the given paths")
    return sources
