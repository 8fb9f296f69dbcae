"""Stored tables with versioned commits.

A table is cut into parts by its key: ranges of a numeric key (new rows fall into
few parts) or a hash of any keys.  A commit names, for each part, the folder that
holds its current rows.  To change rows, the touched parts alone are read, merged
and written to new folders, which nobody reads yet; then one small file with the
next number is put in place by an atomic rename that fails if another writer was
first.  A job that dies before leaves the old version as it was, its folders are
swept up by ``vacuum``.  Readers keep the version that they opened.

The commit lists every part (some 50 bytes each), so parts should be large: of
128 MB, 100 TB have 800,000 parts and a commit of 40 MB.

Small batches whose keys lie anywhere would rewrite the whole table each.  ``changes``
adds such a batch as a layer of its own instead: its rows, and the keys whose older rows no
longer count.  Nothing is rewritten; readers leave out what a later layer replaces.  After
MAX_LAYERS layers, and before parts are rewritten, the layers are merged into the parts.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.upsert import _latest, upsert
from ..plans.sizing import checked_broadcast
from ..session import dropped, shuffles_freed, stored
from .commits import Commits


#: Layers of a table, at most; each is a folder of few files that readers open.
MAX_LAYERS = 512


class KeyedTable:
    """A stored table at ``path``; see ``create`` and ``open``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.commits = Commits(spark, f"{self.path}/commits")
        self.number, self.content = self.commits.latest()
        if self.number < 0:
            raise FileNotFoundError(f"no table at {path}")
        self.schema = T.StructType.fromJson(self.content["schema"])
        self.keys = self.content["keys"]

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: T.StructType, keys: list[str],
               span: int | None = None, buckets: int | None = None) -> KeyedTable:
        """An empty table.  Parts: ranges of ``span`` of the first key (a number), or
        ``buckets`` by the hash of all keys."""
        if (span is None) == (buckets is None):
            raise ValueError("give span or buckets")
        fields = [T.StructField(f.name, f.dataType, f.nullable) for f in schema.fields]
        Commits(spark, f"{path.rstrip('/')}/commits").put(0, {
            "schema": T.StructType(fields).jsonValue(), "keys": keys, "span": span, "buckets": buckets,
            "parts": {}, "layers": [], "done": {}})
        return cls(spark, path)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> KeyedTable:
        return cls(spark, path)

    @classmethod
    def open_or_create(cls, spark: SparkSession, path: str, *args, **kw) -> KeyedTable:
        try:
            return cls(spark, path)
        except FileNotFoundError:
            return cls.create(spark, path, *args, **kw)

    def part(self) -> Column:
        if self.content["span"]:
            span = F.lit(self.content["span"]).cast("long")
            return F.call_function("div", F.col(self.keys[0]) - F.pmod(F.col(self.keys[0]), span), span)
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.content["buckets"]))

    def parts_of(self, rows: DataFrame) -> list[str]:
        """The parts that the keys of ``rows`` belong to."""
        return [str(r[0]) for r in rows.select(self.part().alias("part")).distinct().collect()]

    def read(self, parts: list[str] | None = None) -> DataFrame:
        """The rows of this version, of some parts only if given."""
        now = self.content["parts"]
        paths = [f"{self.path}/data/part={p}/v={now[p]}" for p in (now if parts is None else parts) if p in now]
        layers = [x for x in self.layers() if parts is None or set(x["parts"]) & set(parts)]
        base = self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)
        if not layers:
            return base
        keys = [*(self.schema[k] for k in self.keys), T.StructField("_old", T.BooleanType())]
        later = self._layer_rows("layers", [x["v"] for x in layers], self.schema.fields)
        if parts is not None:
            later = later.where(self.part().isin([int(p) for p in parts]))
        rows = base.withColumn("_v", F.lit("")).unionByName(later) if paths else later
        gone = [self._layer_rows(kind, [x["v"] for x in layers if x["gone"] and x["gone_in"] == kind], keys).where("_old").drop("_old")
                for kind in ("layers", "gone") if any(x["gone"] and x["gone_in"] == kind for x in layers)]
        if gone:
            last = gone[0] if len(gone) == 1 else gone[0].unionByName(gone[1])
            last = checked_broadcast(last.groupBy(*self.keys).agg(F.max("_v").alias("_by")), bound=sum(x["gone"] for x in layers))
            rows = rows.join(last, self.keys, "left").where(F.col("_by").isNull() | (F.col("_v") >= F.col("_by")))
        return rows.select(*self.schema.names)

    def layers(self) -> list[dict]:
        """(v, parts, gone, gone_in) of each layer, the oldest first: its version, the parts that its
        keys belong to, how many keys it replaces, and whether these are marked in its own rows."""
        return self.content.get("layers", [])

    def _layer_rows(self, kind: str, versions: list[str], fields: list[T.StructField]) -> DataFrame:
        """The rows of some layers, with their version as _v."""
        return (self.spark.read.schema(T.StructType([*fields, T.StructField("_v", T.StringType())]))
                .option("basePath", f"{self.path}/{kind}").parquet(*(f"{self.path}/{kind}/_v={v}" for v in versions)))

    def _add_layer(self, rows: DataFrame, old: Column, gone: DataFrame | None, batch: tuple[str, int] | None) -> None:
        """Commits stored ``rows`` beside the others.  Older rows no longer count of the keys of
        rows that are ``old``, or of ``gone`` if given."""
        version = f"{self.number + 1:010d}-{uuid.uuid4().hex[:8]}"
        rows = rows.select(*self.schema.names, old.alias("_old")).where(self.part().isNotNull())
        parts = sorted({*self.parts_of(rows), *(self.parts_of(gone) if gone else ())} - {"None"})
        with shuffles_freed(self.spark):
            rows.repartition(self.part()).write.parquet(f"{self.path}/layers/_v={version}")
        if gone:
            held = self.read(parts).select(*self.keys).distinct()
            gone = stored(held.join(gone, self.keys, "left_semi").withColumn("_old", F.lit(True)), "layer-gone")
            gone.coalesce(1).write.parquet(f"{self.path}/gone/_v={version}")
            n = gone.count()
            dropped(gone)
        else:
            n = rows.where("_old").count()
        layer = {"v": version, "parts": parts, "gone": n, "gone_in": "gone" if gone else "layers"}
        content = self.content | {"layers": [*self.layers(), layer]}
        if batch:
            content = content | {"done": self.content["done"] | {batch[0]: batch[1]}}
        self.commits.put(self.number + 1, content)
        self.number, self.content = self.number + 1, content

    def merge_layers(self) -> KeyedTable:
        """All rows in parts again; the layers' folders go with ``vacuum``."""
        if self.layers():
            parts = sorted({*self.content["parts"], *(p for x in self.layers() for p in x["parts"])})
            self._commit(self.read(), parts, None, {"layers": []})
        return self

    def done(self, stream: str, batch: int) -> bool:
        """Whether the batch of a stream is in the table already."""
        return batch <= self.content["done"].get(stream, -1)

    def _commit(self, rows: DataFrame, parts: list[str] | None, batch: tuple[str, int] | None, more: dict | None = None) -> None:
        """Replaces parts by ``rows``, all of which belong to them.  ``parts`` None: the
        table has none yet, and ``rows`` (with a column part) lie in one task a part."""
        version = f"{self.number + 1:010d}-{uuid.uuid4().hex[:8]}"
        if parts is None:
            placed = rows.select(*self.schema.names, "part")
        else:
            placed = rows.select(*self.schema.names).withColumn("part", self.part()).repartition("part")
        with shuffles_freed(self.spark):
            placed.withColumn("v", F.lit(version)).write.mode("append").partitionBy("part", "v").parquet(f"{self.path}/data")
        if parts is None:               # rows without a key have the part __HIVE_DEFAULT_PARTITION__ and do not count
            parts = [f[5:] for f in self.commits.folders(f"{self.path}/data") if re.fullmatch(r"part=-?\d+", f)]
        written = {p for p in parts if f"v={version}" in self.commits.folders(f"{self.path}/data/part={p}")}
        now = {p: v for p, v in self.content["parts"].items() if p not in parts} | dict.fromkeys(written, version)
        content = self.content | {"parts": now} | (more or {})
        if batch:
            content = content | {"done": self.content["done"] | {batch[0]: batch[1]}}
        self.commits.put(self.number + 1, content)
        self.number, self.content = self.number + 1, content

    def upsert(self, batch: DataFrame, version: str | None = "updated_at", arrival: str | None = None,
               unique_keys: list[list[str]] | None = None, done: tuple[str, int] | None = None,
               changes: str | None = None) -> KeyedTable:
        """A11 into the stored table: the latest row of each key wins.  Only parts
        with a key of the batch, or with a row that shares a further unique key with
        it, are read and written.  ``done``: (stream, batch id) kept with the commit;
        a batch that is in the table already changes nothing.  The first batch of a table
        is exchanged once, by part: the latest rows are found where they are written.
        ``changes``: the batch is stored, has one row a key and all are newer than the table's,
        and this column says which of them replace a row; it becomes a layer."""
        if done and self.done(*done):
            return self
        columns = [*self.schema.names, *([arrival] if arrival and arrival not in self.schema.names else [])]
        if not self.content["parts"] and not self.layers() and not unique_keys:
            order = [F.col(c) for c in (version, arrival) if c]
            placed = batch.select(*columns).withColumn("part", self.part()).repartition("part")
            self._commit(_latest(placed, ["part", *self.keys], order, [*self.schema.names, "part"]), None, done)
            return self
        if changes and not unique_keys and len(self.layers()) < MAX_LAYERS:
            self._add_layer(batch, F.col(changes), None, done)
            return self
        self.merge_layers()
        batch = stored(batch.select(*columns), "upsert-batch")
        parts = set(self.parts_of(batch))
        for key in unique_keys or []:
            other = self.read().select(*dict.fromkeys([*self.keys, *key])).join(batch.select(*key).distinct(), key, "left_semi")
            parts |= set(self.parts_of(other))
        parts = sorted(parts)
        self._commit(upsert(self.read(parts), batch, self.keys, version, arrival, unique_keys), parts, done)
        dropped(batch)
        return self

    def replace(self, gone: DataFrame, rows: DataFrame, done: tuple[str, int] | None = None, layer: bool = False) -> KeyedTable:
        """Deletes all rows whose first key is in ``gone`` (one column of that name)
        and adds ``rows``.  Parts must follow from that key.  ``layer``: as a layer, where
        that is the only key."""
        if self.content["buckets"] and len(self.keys) > 1:
            raise ValueError("parts by a hash of several keys do not follow from the first")
        if done and self.done(*done):
            return self
        key = self.keys[0]
        gone, rows = stored(gone.select(key).distinct(), "replace-keys"), stored(rows.select(*self.schema.names), "replace-rows")
        if layer and self.keys == [key] and (self.content["parts"] or self.layers()) and len(self.layers()) < MAX_LAYERS:
            self._add_layer(rows, F.lit(False), gone, done)
        else:
            self.merge_layers()
            parts = sorted(set(self.parts_of(gone)) | set(self.parts_of(rows)))
            self._commit(self.read(parts).join(gone, key, "left_anti").unionByName(rows), parts, done)
        dropped(gone, rows)
        return self

    def vacuum(self) -> int:
        """Deletes the folders that the current version does not name; their number.
        Not while others write or read older versions."""
        found = 0
        for part in self.commits.folders(f"{self.path}/data"):
            if not part.startswith("part="):
                continue
            current = f"v={self.content['parts'].get(part[5:])}"
            for v in self.commits.folders(f"{self.path}/data/{part}"):
                if v != current:
                    self.commits.delete(f"{self.path}/data/{part}/{v}")
                    found += 1
        for kind in ("layers", "gone"):
            for v in set(self.commits.folders(f"{self.path}/{kind}")) - {f"_v={x['v']}" for x in self.layers()}:
                self.commits.delete(f"{self.path}/{kind}/{v}")
                found += 1
        return found
