"""Stored tables on plain Parquet: every run writes its own batch, and readers see committed batches only.

A batch is written by overwriting its partitions, so a repeated run changes nothing; the commit is one
small file written last. A failure before it leaves nothing that a reader sees.

Tables with a key (``KEYS``) are merged when they are read: a batch holds new versions of some rows, and of a key's versions
the one of the latest committed batch counts. ``compact`` writes the merged rows as a base, in ranges of the key; later reads
take a base and the batches after it, so that only keys changed since are joined, and a look-up by key opens the files of its range only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.schemas import TABLES, shaped, url_id


#: The keys of versioned tables.
KEYS = {"signals": "id"}


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, table: str, batch: int) -> str:
        return f"{self.root}/{table}/batch={batch}"

    def write(self, batch: int, tables: dict[str, DataFrame]) -> None:
        """All tables of a batch, then its commit. Bases that hold the batch as it was before count no more."""
        for name in set(tables) & set(KEYS):
            for base in self.batches(f"{name}.base"):
                if base >= batch:
                    path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(f"{name}.bases", base))
                    path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        for name, rows in tables.items():
            shaped(name, rows).write.mode("overwrite").parquet(self.path(name, batch))
        self._commit(batch, sorted(tables), "commits")

    def _commit(self, batch: int, names: list[str], folder: str) -> None:
        self.spark.createDataFrame([(n,) for n in names], "name string").coalesce(1).write.mode("overwrite").parquet(self.path(folder, batch))

    def batches(self, table: str, before: int | None = None) -> list[int]:
        """Committed batches (those before one, if it is given) that hold a table; one small row per run and table."""
        commits = self._files(f"{table}s" if table.endswith(".base") else "commits")
        if commits is None:
            return []
        good = [r.batch for r in commits.where(F.col("name") == table).select("batch").distinct().orderBy("batch").collect()]
        return [b for b in good if before is None or b < before]

    def _files(self, table: str, schema: str = "name string") -> DataFrame | None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{table}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return None
        return self.spark.read.schema(f"{schema}, batch bigint").parquet(f"{self.root}/{table}")

    def read(self, table: str, before: int | None = None) -> DataFrame:
        """A table's committed rows; empty if there are none. A batch that may be repeated reads those before it only."""
        if table in KEYS:
            return self.merged(table, before)
        return self.with_batch(table, before).drop("batch")

    def with_batch(self, table: str, before: int | None = None) -> DataFrame:
        """The rows of the committed batches, with their batch."""
        rows, good = self._files(table, TABLES[table]), self.batches(table, before)
        if rows is None or not good:
            return self.spark.createDataFrame([], f"{TABLES[table]}, batch bigint")
        return rows.where(F.col("batch").isin(good))

    def merged(self, table: str, before: int | None = None) -> DataFrame:
        """The latest version of each key, from the latest base and the batches after it."""
        key, names = KEYS[table], [c.split(" ")[0] for c in TABLES[table].split(", ")]
        bases = self.batches(f"{table}.base", before)
        base = self.spark.read.schema(TABLES[table]).parquet(self.path(f"{table}.base", bases[-1])) if bases else None
        later = [b for b in self.batches(table, before) if not bases or b > bases[-1]]
        if not later:
            return base if base is not None else self.spark.createDataFrame([], TABLES[table])
        rows = self._files(table, TABLES[table]).where(F.col("batch").isin(later))
        rest = [n for n in names if n != key]
        if len(later) == 1 and base is None:
            return rows.select(*names)
        newest = rows.groupBy(key).agg(F.max(F.struct("batch", *rest)).alias("row")).select(key, *[F.col(f"row.{n}").alias(n) for n in rest]).select(*names)
        if base is None:
            return newest
        return base.join(rows.select(key), key, "left_anti").select(*names).unionByName(newest)

    def compact(self, table: str, batch: int) -> None:
        """Write the versions that count up to a committed batch as a base: sorted by key in ranges, with filters for look-ups."""
        rows = self.merged(table, batch + 1)
        dealt = rows.repartitionByRange(int(self.spark.conf.get("spark.sql.shuffle.partitions")), KEYS[table]).sortWithinPartitions(KEYS[table])
        dealt.write.mode("overwrite").option(f"parquet.bloom.filter.enabled#{KEYS[table]}", "true").parquet(self.path(f"{table}.base", batch))
        self._commit(batch, [f"{table}.base"], f"{table}.bases")

    def find(self, table: str, ids: list[int], before: int | None = None) -> DataFrame:
        """The rows of a versioned table with these keys; the list reaches the scans of the base and of the batches."""
        return self.read(table, before).where(F.col(KEYS[table]).isin(*ids)) if ids else self.read(table, before).where("false")

    def state(self, before: int | None = None) -> DataFrame:
        """The latest snapshot of the sources' state."""
        good = self.batches("sources_state", before)
        return self.spark.read.schema(TABLES["sources_state"]).parquet(self.path("sources_state", good[-1])) if good else self.spark.createDataFrame([], TABLES["sources_state"])

    def save_run(self, batch: int, run: dict[str, DataFrame]) -> None:
        """What operators.ingest.ingest returns, and the filter of its seen addresses if there is one: cards with their categories and first history rows, seen addresses, counters, state."""
        cards = run["signals"].withColumn("id", url_id(F.col("source_url"))).withColumn("updated_at", F.col("created_at"))
        tables = {
            "signals": cards,
            "signal_categories": cards.select(F.col("id").alias("signal_id"), F.explode("categories").alias("category")),
            "status_history": cards.select(F.xxhash64("id", F.lit(0)).alias("id"), F.col("id").alias("signal_id"), F.lit("new").alias("to_status"), F.col("created_at").alias("changed_at")),
            "documents_seen": run["seen"].withColumn("id", url_id(F.col("doc_url"))),
            "run_counters": run["counters"],
            "sources_state": run["state"],
        }
        self.write(batch, tables | {n: run[n] for n in ("seen_filters", "progress") if n in run})

    def totals(self) -> DataFrame:
        """How many source runs went well, and the signals they made."""
        return self.read("run_counters").agg(F.count_if("ok").alias("ok_sources"), F.coalesce(F.sum("new_signals"), F.lit(0)).alias("new_signals"))
