"""Several tables that become visible together.

A commit writes its tables into a folder of its own, and then puts one small file, its mark,
into place by a rename. Readers follow the latest mark, so they see all tables of a commit or
none: a driver or executor lost on the way leaves folders that no mark names.

    <path>/tables/<id>/<name>     the tables of a commit, Parquet
    <path>/marks/<number>.json    id, names and facts of a commit, numbered from 1
"""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from fleetward.staging import remove


class Conflict(RuntimeError):
    """Another commit has taken the number that this one was to have."""


def _files(spark: SparkSession, path: str):
    """Hadoop's path and file system of a path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[str]:
    p, fs = _files(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []


def _numbers(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(x[:-5]) for x in _names(spark, f"{path}/marks") if x.endswith(".json") and not x.startswith((".", "_")))


def _put(spark: SparkSession, path: str, text: str) -> None:
    """Writes a file beside its place and renames it there, unless there is one already."""
    target, fs = _files(spark, path)
    temporary, _ = _files(spark, f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}")
    out = fs.create(temporary, False)
    out.write(bytearray(text.encode()))
    out.close()
    jvm = spark._jvm
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.getFileSystem(spark._jsc.hadoopConfiguration()).getUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(fs.makeQualified(temporary), fs.makeQualified(target), options)
    except Exception as e:
        fs.delete(temporary, False)
        if "FileAlreadyExists" in str(e):
            raise Conflict(path) from None
        raise


def commit(spark: SparkSession, path: str, tables: dict[str, DataFrame], by: dict[str, list[str]] | None = None, facts: dict[str, Any] | None = None) -> int:
    """Writes the tables and makes them the current ones; the commit's number.

    by: partition columns by table. facts: what the mark says beside (plain JSON). Another commit in between is a
    Conflict, and nothing of this one becomes visible.
    """
    number, own = (_numbers(spark, path) or [0])[-1] + 1, uuid.uuid4().hex
    for name, df in tables.items():
        out = df.write
        (out.partitionBy(*by[name]) if by and name in by else out).parquet(f"{path}/tables/{own}/{name}")
    schemas = {name: df.schema.jsonValue() for name, df in tables.items()}
    _put(spark, f"{path}/marks/{number:08d}.json", json.dumps({"id": own, "schemas": schemas, "facts": facts or {}}))
    return number


def mark(spark: SparkSession, path: str, number: int | None = None) -> dict[str, Any] | None:
    """The latest mark, or that of a number; None where nothing has been committed."""
    numbers = _numbers(spark, path)
    if not numbers:
        return None
    p, fs = _files(spark, f"{path}/marks/{number or numbers[-1]:08d}.json")
    stream = fs.open(p)
    try:
        return {"number": number or numbers[-1], **json.loads(bytes(stream.readAllBytes()))}
    finally:
        stream.close()


def current(spark: SparkSession, path: str, number: int | None = None) -> dict[str, DataFrame]:
    """The tables of the latest commit, or of a number, by name."""
    from pyspark.sql.types import StructType

    found = mark(spark, path, number)
    return {} if found is None else {name: spark.read.schema(StructType.fromJson(s)).parquet(f"{path}/tables/{found['id']}/{name}") for name, s in found["schemas"].items()}


def tidy(spark: SparkSession, path: str, keep: int = 1) -> None:
    """Removes all commits but the last ones, and folders that no mark names: while no commit is under way."""
    numbers = _numbers(spark, path)
    kept = {mark(spark, path, n)["id"] for n in numbers[-keep:]}
    for n in numbers[:-keep]:
        remove(spark, f"{path}/marks/{n:08d}.json")
    for x in _names(spark, f"{path}/tables"):
        if x not in kept:
            remove(spark, f"{path}/tables/{x}")
