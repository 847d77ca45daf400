"""code_units and code_edges as Parquet folders with versioned snapshots.

Rows live in hash buckets of their file path. A load writes only the buckets its
batch touches into a new version folder; a snapshot file then names the live folder
of every bucket of both tables, so units and edges switch together and no file that
is being read is ever replaced.
"""

import json

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from unitloom.operators import maintain
from unitloom.schema import CODE_EDGES, CODE_UNITS
from unitloom.session import cut_lineage, small_side

UNIT_LAYOUT = ["bucket", "namespace"]
EDGE_LAYOUT = ["bucket"]


def bucket_of(unit_id, buckets: int) -> Column:
    """Units of one file share a bucket; the id carries the path before `::`."""
    path = F.substring_index(F.col(unit_id), "::", 1)
    return F.pmod(F.xxhash64(path), F.lit(buckets)).cast("int")


class CodeTables:
    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self._jvm = spark._jvm
        base = self._path("")
        self._fs = base.getFileSystem(spark._jsc.hadoopConfiguration())

    # -- snapshots ---------------------------------------------------------------

    def _path(self, name):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _list(self, name):
        path = self._path(name)
        if not self._fs.exists(path):
            return []
        return [s.getPath().getName() for s in self._fs.listStatus(path)]

    def snapshot(self) -> dict:
        done = [int(n[:-5]) for n in self._list("_snapshots") if n.endswith(".json")]
        if not done:
            return {"version": 0, "buckets": self.buckets, "units": {}, "edges": {}}
        for version in sorted(done, reverse=True):
            stream = self._fs.open(self._path(f"_snapshots/{version}.json"))
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            stream.close()
            try:
                return json.loads(text)
            except ValueError:  # another load is writing this version just now
                continue
        return {"version": 0, "buckets": self.buckets, "units": {}, "edges": {}}

    def _publish(self, snapshot: dict) -> None:
        """Creates the snapshot file only if absent; fails if another load has published this version.

        The store decides which of two writers creates the file; a reader skips a file that is
        not yet whole.
        """
        name = self._path(f"_snapshots/{snapshot['version']}.json")
        try:
            out = self._fs.create(name, False)
        except Py4JJavaError as error:
            raise RuntimeError(f"version {snapshot['version']} was published by another load") from error
        out.write(bytearray(json.dumps(snapshot).encode("utf-8")))
        out.close()

    # -- reading -----------------------------------------------------------------

    def _read(self, table, schema, only=None):
        live = self.snapshot()[table]
        if only is not None:
            live = {b: v for b, v in live.items() if int(b) in only}
        layout = T.StructType(
            schema.fields
            + [T.StructField("v", T.StringType()), T.StructField("bucket", T.IntegerType())]
        )
        if not live:
            return self.spark.createDataFrame([], layout).drop("v")
        folders = [f"{self.root}/{table}/v={v}/bucket={b}" for b, v in live.items()]
        reader = self.spark.read.schema(layout).option("basePath", f"{self.root}/{table}")
        return reader.parquet(*folders).select(*schema.fieldNames(), "bucket")

    def units(self, only=None) -> DataFrame:
        """Live units; `bucket` and `namespace` prune folders."""
        return self._read("units", CODE_UNITS, only)

    def edges(self, only=None) -> DataFrame:
        return self._read("edges", CODE_EDGES, only)

    # -- writing -----------------------------------------------------------------

    def _write(self, df, table, layout, token):
        folder = f"{self.root}/{table}/v={token}"
        # Rebalancing splits an oversized bucket and joins small ones into one task.
        df.hint("rebalance", *layout).write.mode("errorifexists").partitionBy(*layout).option("compression", "zstd").parquet(folder)
        names = self._list(f"{table}/v={token}")
        return [n.split("=", 1)[1] for n in names if n.startswith("bucket=")]

    def _commit(self, units, edges, touched, base) -> int:
        # A unique folder per attempt: a failed load leaves only unreferenced files.
        token = f"{base['version'] + 1}-{self._jvm.java.util.UUID.randomUUID()}"
        after = {"version": base["version"] + 1, "buckets": self.buckets}
        for table, df, layout in (("units", units, UNIT_LAYOUT), ("edges", edges, EDGE_LAYOUT)):
            written = self._write(df, table, layout, token)
            kept = {b: v for b, v in base[table].items() if int(b) not in touched}
            after[table] = {**kept, **{b: token for b in written}}
        self._publish(after)
        return after["version"]

    def _bucketed(self, df, key):
        return df.withColumn("bucket", bucket_of(key, self.buckets))

    def upsert_batch(self, batch: DataFrame, *, job_id: str, updated_at=None) -> dict:
        """Units by id (last `seq` wins) and the edges of the batch's callers, together.

        batch: unit columns with lane texts and vectors, and `seq`. Only touched
        buckets are read and rewritten. Returns version, n_units, n_edges.
        """
        base = self.snapshot()
        if base["buckets"] != self.buckets:
            raise ValueError(f"table has {base['buckets']} buckets")
        # Ids and calls are written once; texts and vectors are computed only for the
        # rows that are stored.
        slim = cut_lineage(batch.select("id", "calls"))
        counts = maintain.batch_counts(slim).first()
        if counts["n_units"] == 0:
            return {"version": base["version"], "n_units": 0, "n_edges": 0}
        # At most one row per bucket.
        touched = {
            r["bucket"] for r in slim.select(bucket_of("id", self.buckets).alias("bucket")).distinct().collect()
        }
        now = F.current_timestamp() if updated_at is None else F.lit(updated_at).cast("timestamp")
        fresh = maintain.last_of_repeated(batch, slim, "id", "seq").drop("seq")
        fresh = maintain.stamp(fresh, job_id).withColumn("updated_at", now)
        fresh = self._bucketed(fresh, "id").select(*CODE_UNITS.fieldNames(), "bucket")
        ids = small_side(slim.select("id").distinct(), counts["n_units"])
        units = self.units(touched).join(ids, "id", "left_anti").unionByName(fresh)
        kept = self.edges(touched).drop("bucket")
        edges = self._bucketed(maintain.replace_edges(kept, slim), "caller_id")
        version = self._commit(units, edges, touched, base)
        return {"version": version, "n_units": counts["n_units"], "n_edges": counts["n_edges"]}

    def prune_missing(self, current: DataFrame) -> int:
        """Remove units whose id is not in `current`, and their edges. Rewrites all buckets."""
        base = self.snapshot()
        units = maintain.drop_missing(self.units(), current, "id")
        edges = maintain.cascade(self.edges(), units)
        touched = {int(b) for table in ("units", "edges") for b in base[table]}
        return self._commit(units, edges, touched, base)
