"""Sinks: stage tables as Parquet, and exports as JSON."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convoframe.functions.text import iso
from convoframe.sources.manifest import exists, set_aside, unreadable


def _rename(spark: SparkSession, source: str, target: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    if not path(source).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).rename(path(source), path(target)):
        raise OSError(f"could not move {source} to {target}")


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def save_table(df: DataFrame, output_dir: str, name: str, mode: str = "overwrite") -> DataFrame:
    """Writes a stage table and reads it back; a table that feeds itself is written beside and moved."""
    spark, path = df.sparkSession, f"{output_dir}/{name}.parquet"
    if mode == "overwrite" and exists(spark, path):
        df.write.mode("overwrite").parquet(path + ".new")
        _delete(spark, path + ".old")
        _rename(spark, path, path + ".old")
        _rename(spark, path + ".new", path)
        _delete(spark, path + ".old")
    else:
        df.write.mode(mode).parquet(path)
    return spark.read.parquet(path)


def load_table(spark: SparkSession, output_dir: str, name: str) -> DataFrame | None:
    """A stage table, or None if there is none; a replacement that was cut short is finished first."""
    path = f"{output_dir}/{name}.parquet"
    if not exists(spark, path) and exists(spark, path + ".old"):  # the old one is moved only when the new one is whole
        _rename(spark, path + ".new", path)
        _delete(spark, path + ".old")
    return spark.read.parquet(path) if exists(spark, path) else None


def load_state(spark: SparkSession, output_dir: str, name: str, schema: str) -> DataFrame:
    """A table of state; empty if there is none, and if Spark finds no Parquet in it, which is then set aside."""
    try:
        found = load_table(spark, output_dir, name)
    except Exception as e:  # noqa: BLE001  the classes differ by Spark version
        if not unreadable(e):
            raise
        set_aside(spark, f"{output_dir}/{name}.parquet")
        found = None
    return found if found is not None else spark.createDataFrame([], schema)


def as_dicts(df: DataFrame) -> list[dict]:
    """The rows of a small result, times as text."""
    return [json.loads(row) for row in timestamps_as_text(df).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).toPandas().iloc[:, 0]]


def export_json(spark: SparkSession, value, path: str) -> None:
    """One small JSON document, on any file system Spark knows."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(hadoop, True)
    try:
        out.write(bytearray(json.dumps(value, ensure_ascii=False, indent=2).encode()))
    finally:
        out.close()


def _as_text(value: Column, kind: T.DataType) -> Column:
    """A value with all times in it, at any depth, as ISO text; nulls stay nulls."""
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return iso(value)
    if isinstance(kind, T.ArrayType) and _has_time(kind):
        return F.transform(value, lambda x: _as_text(x, kind.elementType))
    if isinstance(kind, T.MapType) and _has_time(kind):
        entries = F.transform(F.map_entries(value), lambda e: F.struct(_as_text(e["key"], kind.keyType).alias("key"), _as_text(e["value"], kind.valueType).alias("value")))
        return F.map_from_entries(entries)
    if isinstance(kind, T.StructType) and _has_time(kind):
        return F.when(value.isNotNull(), F.struct(*[_as_text(value.getField(f.name), f.dataType).alias(f.name) for f in kind]))
    return value


def _has_time(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _has_time(kind.elementType)
    if isinstance(kind, T.MapType):
        return _has_time(kind.keyType) or _has_time(kind.valueType)
    if isinstance(kind, T.StructType):
        return any(_has_time(f.dataType) for f in kind)
    return isinstance(kind, (T.TimestampType, T.TimestampNTZType))


def timestamps_as_text(df: DataFrame) -> DataFrame:
    """All times as ISO text, inside structs, arrays and maps too."""
    return df.select(*[_as_text(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema])


def export_json_lines(df: DataFrame, path: str) -> None:
    timestamps_as_text(df).write.mode("overwrite").json(path)


def export_json_array(df: DataFrame, path: str, head: dict | None = None, name: str = "rows") -> None:
    """One file with one JSON array, on any file system Spark knows, in the order of the rows.

    With ``head`` it is an object: what ``head`` has, and the array as ``name``.

    Tasks write part files, a row a line with a comma before it.  The parts are then
    copied, as bytes, behind each other into a file beside the target, without the first
    comma, and one rename puts it in place: readers see the old file or the new one.
    """
    spark = df.sparkSession
    parts, beside = f"{path}.{uuid.uuid4().hex}.parts", f"{path}.{uuid.uuid4().hex}.tmp"
    rows = timestamps_as_text(df)
    rows.select(F.concat(F.lit(","), F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), {"ignoreNullFields": "false"}))).write.text(parts)
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop, spark.sparkContext._jsc.hadoopConfiguration()
    place = hadoop.fs.Path(beside)
    fs = place.getFileSystem(conf)
    out = fs.create(place, True)
    try:
        opening = "" if head is None else "{" + "".join(f"{json.dumps(k)}: {json.dumps(v, ensure_ascii=False)},\n" for k, v in head.items()) + f"{json.dumps(name)}: "
        out.write(bytearray((opening + "[").encode()))
        first = True
        for status in sorted(fs.listStatus(hadoop.fs.Path(parts)), key=lambda s: s.getPath().getName()):
            if status.getPath().getName().startswith("part-") and status.getLen():
                part = fs.open(status.getPath())
                try:
                    if first:
                        part.read()
                        out.write(bytearray(b"\n"))
                        first = False
                    hadoop.io.IOUtils.copyBytes(part, out, conf, False)
                finally:
                    part.close()
        out.write(bytearray(b"]\n" if head is None else b"]}\n"))
    finally:
        out.close()
    _delete(spark, parts)
    _delete(spark, path)
    _rename(spark, beside, path)
