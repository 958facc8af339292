"""Message exports: ``<data>/<contact>/*.csv``, read by header and ingested by fingerprint."""

from __future__ import annotations

import csv
import io
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import zip_longest

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convoframe.operators.messages import TEXT, typed_time
from convoframe.sources import manifest
from convoframe.sources.files import listed
from convoframe.sources.ship import ship_package

#: Other spellings of the analysis path's columns.
RENAMED = {"talkerId": "talker", "msg": "content", "createTime": "timestamp", "CreateTime": "timestamp", "isSender": "is_sender", "localId": "local_id"}
REQUIRED = ("talker", "content", "timestamp", "is_sender")
#: Rows in an Arrow batch.
ROWS = 1000
ROW = "source_file string, contact_folder string, file_row long, fields map<string,string>, problem string"
RAW = ("id", "CreateTime", "is_sender", "talker", "room_name", "type_name", "msg", "src")


def folders(spark: SparkSession, data_dir: str) -> list[str]:
    """Folders with at least one CSV file, sorted."""
    return sorted({f.folder for f in listed(spark, f"{data_dir}/*/*.csv")})


def parsed_rows(contents: DataFrame) -> DataFrame:
    """``source_file, contact_folder, file_row, fields, problem``: all rows of files (``path, content``, at once or as a stream), a map from header to text each.

    One plan for files of any headers: each task opens its files, binds values to the
    header it finds there and numbers the rows, so a row keeps its number however files
    are read.  Empty values are missing.  A row with more values than the header has
    names keeps the first ones and has a ``problem``, as has a file that ends within
    quotes (its rest is one value).  Blank lines are no rows; a file without a header
    has none.  A file is read as a whole by one task and can't be over 2 GB.
    """

    def parse(batches):
        import pyarrow as pa

        kind = pa.schema([("source_file", pa.string()), ("contact_folder", pa.string()), ("file_row", pa.int64()), ("fields", pa.map_(pa.string(), pa.string())), ("problem", pa.string())])
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out = []
                for row in _parsed(content.decode("utf-8-sig", "replace")):
                    out.append((path, path.split("/")[-2], *row))
                    if len(out) >= ROWS:
                        yield pa.RecordBatch.from_pylist([dict(zip(kind.names, r, strict=True)) for r in out], schema=kind)
                        out = []
                yield pa.RecordBatch.from_pylist([dict(zip(kind.names, r, strict=True)) for r in out], schema=kind)

    ship_package(contents.sparkSession)
    return contents.select("path", "content").mapInArrow(parse, ROW)


def read_rows(spark: SparkSession, files: list[str]) -> DataFrame:
    """``parsed_rows`` of files by their paths."""
    return parsed_rows(spark.read.format("binaryFile").load(files)) if files else spark.createDataFrame([], ROW)


def _parsed(text: str) -> Iterator[tuple[int, dict[str, str | None], str | None]]:
    """(row number, fields, problem) of one file's text."""
    csv.field_size_limit(1 << 31)
    reader = csv.reader(io.StringIO(text, newline=""), strict=False)
    header = [h.strip() or f"_c{i}" for i, h in enumerate(next(reader, []))]
    # In a file that ends within quotes the number of quotes is odd.
    open_end = text.count('"') % 2 == 1
    last = None
    for n, values in enumerate(row for row in reader if row):
        if last is not None:
            yield last
        extra = len(values) > len(header)
        fields: dict[str, str | None] = {}
        for h, v in zip_longest(header, values[: len(header)]):
            fields.setdefault(h, v or None)  # of equal names the first
        last = (n, fields, "more values than names" if extra else None)
    if last is not None:
        yield (last[0], last[1], "open quotes") if open_end else last


def rejected_rows(rows: DataFrame) -> DataFrame:
    """The rows with a problem, for a side output."""
    return rows.filter("problem is not null").select("source_file", "file_row", "problem", F.to_json("fields").alias("fields"))


def raw_messages(spark: SparkSession, files: list[str]) -> DataFrame:
    """The export's columns as text; a file that lacks one has nulls there (its rows then fail to type)."""
    return as_raw(read_rows(spark, files))


def as_raw(rows: DataFrame) -> DataFrame:
    return rows.select(*[F.col("fields")[c].alias(c) for c in RAW], "source_file", "contact_folder", "file_row")


def _found(spark: SparkSession, data_dir: str) -> DataFrame:
    """``path, modified, size`` of all exports, as Spark lists them; no file is opened."""
    if not listed(spark, f"{data_dir}/*/*.csv"):
        return spark.createDataFrame([], "path string, modified long, size long")
    rows = spark.read.format("binaryFile").load(f"{data_dir}/*/*.csv")
    rows = rows.select("path", F.unix_millis("modificationTime").alias("modified"), F.col("length").alias("size"))
    return rows.filter(~F.element_at(F.split("path", "/"), -2).startswith("."))


def new_files(spark: SparkSession, data_dir: str, manifest_path: str) -> tuple[list[str], DataFrame]:
    """Paths the manifest lacks or has changed, and their manifest rows."""
    rows = _found(spark, data_dir).withColumn("fingerprint", F.md5(F.concat_ws("|", "path", F.col("modified").cast("string"), F.col("size").cast("string"))))
    todo = manifest.unprocessed(rows, manifest.load(spark, manifest_path))
    todo = spark.createDataFrame(sorted(todo.select("path", "fingerprint").collect()), manifest.SCHEMA)  # as it is now: the manifest changes
    return [r["path"] for r in todo.select("path").collect()], todo


def analysis_messages(spark: SparkSession, data_dir: str, folder: str | None = None, epoch_unit: str | None = None) -> DataFrame:
    """Text messages for the analysis path, from any of its header spellings, of one folder or all.

    Of a column's spellings the first in the header counts.  Files without a required
    column are left out, and so are rows that do not type.
    """
    rows = read_rows(spark, [f.path for f in listed(spark, f"{data_dir}/*/*.csv") if folder is None or f.folder == folder])
    names = F.map_keys("fields")  # a row has all of its file's, in the header's order

    def spelled(name: str) -> Callable[[Column], Column]:
        return lambda key: key.isin(name, *[old for old, new in RENAMED.items() if new == name])

    first = lambda name: F.element_at("fields", F.element_at(F.filter(names, spelled(name)), 1))
    has = [F.exists(names, spelled(name)) for name in REQUIRED]
    rows = rows.filter(reduce(lambda a, b: a & b, has))
    typed = F.when(F.array_contains(names, "type"), F.coalesce(F.col("fields")["type"].try_cast("int") == 1, F.lit(False)))
    typed = typed.when(F.array_contains(names, "type_name"), F.coalesce(F.col("fields")["type_name"] == TEXT, F.lit(False))).otherwise(True)
    out = rows.filter(typed).select(
        first("talker").alias("talker"), F.coalesce(first("content"), F.lit("")).alias("content"), typed_time(first("timestamp"), epoch_unit).alias("create_time"),
        first("is_sender").try_cast("int").alias("is_sender"), "contact_folder", "source_file", "file_row",
    )
    return out.filter(F.col("create_time").isNotNull() & F.col("is_sender").isNotNull())
