"""Tables with one row a key, changed by upserts.

A key's hash gives its bucket.  An upsert writes its rows beside what their buckets hold
and nothing else; a read takes each key's latest row; a bucket with many upserts is
rewritten by itself.  Upserts are commits of a snapshot store, so one that dies leaves
nothing, and one that is repeated changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convoframe.sources.snapshots import Snapshot, Store, _several

BUCKETS = 64
#: Upserts a bucket may hold beside its base.
DELTAS = 8
_VERSION, _BUCKET = "_version", "_key_bucket"


class Keyed:
    def __init__(self, store: Store, name: str, key: str, schema: str, buckets: int = BUCKETS):
        self.store, self.name, self.key, self.schema, self.buckets = store, name, key, schema, buckets
        self.columns = store.spark.createDataFrame([], schema).columns

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets))

    def _latest(self, rows: DataFrame) -> DataFrame:
        """Of each key the row of its latest upsert."""
        return rows.groupBy(self.key).agg(F.max_by(F.struct(*rows.columns), _VERSION).alias("_row")).select("_row.*")

    def _rows(self, at: Snapshot, buckets: Iterable[int] | None = None) -> DataFrame:
        return at.read(self.name, buckets, f"{self.schema}, {_VERSION} long, {_BUCKET} long")

    def read(self, at: Snapshot | None = None) -> DataFrame:
        """All rows, one a key."""
        return self._latest(self._rows(at or self.store.current())).select(*self.columns)

    def find(self, keys: DataFrame, at: Snapshot | None = None) -> DataFrame:
        """The rows of some keys, from their buckets only.  ``keys`` has the key's column."""
        buckets = [r[0] for r in keys.select(self._bucket(F.col(self.key))).distinct().collect()]  # at most ``buckets``
        rows = self._rows(at or self.store.current(), buckets)
        return self._latest(rows.join(keys.select(self.key).distinct(), self.key, "left_semi")).select(*self.columns)

    def upsert(self, rows: DataFrame) -> Snapshot:
        """Rows put in the place of those with their keys, or added; of several rows of a key one, the greatest.

        Null keys are left out.  No rows: no new version.
        """
        commit = self.store.commit()
        one = rows.filter(F.col(self.key).isNotNull()).groupBy(self.key).agg(F.max(F.struct(*self.columns)).alias("_row")).select("_row.*")
        one = one.select(*self.columns, F.lit(commit.version).cast("long").alias(_VERSION), self._bucket(F.col(self.key)).alias(_BUCKET))
        touched = commit.append_buckets(self.name, one, _BUCKET)
        if not touched:
            return commit.base
        full = [b for b in touched if len(_several(commit.tables[self.name]["folders"][str(b)])) > DELTAS + 1]
        if full:
            commit.write_buckets(self.name, self._latest(self._rows(Snapshot(self.store, commit.version, commit.tables), full)), _BUCKET, full)
        done = commit.publish()
        self.store.collect_garbage()
        return done

    def clear(self) -> None:
        commit = self.store.commit()
        commit.drop(self.name)
        commit.publish()
