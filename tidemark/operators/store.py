"""The partitioned feature store: write, merge sources on read, keep-last compaction, manifest, retention."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.dialect import duckdb_text, run_sql
from ..sources.paths import shared_path
from .quality import BACK, STREAM

KEY = ("symbol", "t")


class FeatureStore:
    """Parquet under group=/source=/day=; a read prunes to the days and sources it needs."""

    def __init__(self, spark: SparkSession, root: str, mock: bool = False):
        self.spark, self.root = spark, root
        #: What live capture writes: a mock store has no real stream, a real one nothing simulated.
        self.provisional, self._barred = ("sim", "stream") if mock else ("stream", "sim")

    def write(self, df: DataFrame, group: str, source: str, sequence: int = 0) -> None:
        """Append rows; a later sequence wins where keys meet."""
        if source == self._barred:
            raise ValueError(f"this store takes {self.provisional} rows, not {source}")
        rows = df.withColumns({"source": F.lit(source), "sequence": F.lit(sequence), "day": F.floor(F.col("t") / 24)})
        # one file a day and task: rows of a day come together first
        rows.repartition("day").write.mode("append").option("compression", "zstd").partitionBy("source", "day").parquet(f"{self.root}/group={group}")

    def scan(self, group: str) -> DataFrame:
        return self.spark.read.option("mergeSchema", "true").parquet(f"{self.root}/group={group}")

    def latest(self, group: str, source: str) -> DataFrame:
        """Rows of a source, the last written of each key."""
        w = Window.partitionBy(*KEY).orderBy(F.desc("sequence"))
        rows = self.scan(group).where(F.col("source") == source)
        return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")

    def read(self, group: str, source: str = "auto", days: tuple[int, int] | None = None) -> DataFrame:
        """auto: backfill rows, and live rows whose key backfill lacks."""
        pick = lambda s: self.latest(group, s) if days is None else self.latest(group, s).where(F.col("day").between(*days))
        if source != "auto":
            return pick(source)
        back = pick("backfill")
        return back.unionByName(pick(self.provisional).join(back.select(*KEY), list(KEY), "left_anti"))

    def unsettled(self, group: str, days: tuple[int, int]) -> list[int]:
        """Days of the range that only live capture has; at most as many as the range is long."""
        cells = self.scan(group).where(F.col("day").between(*days)).select("source", "day").distinct()
        back = cells.where("source = 'backfill'").select("day")
        return sorted(int(row.day) for row in cells.where(F.col("source") == self.provisional).join(back, "day", "left_anti").select("day").collect())

    def features(self, names: list[str], catalog: dict[str, str], days: tuple[int, int], source: str = "auto", require_settled: bool = False) -> DataFrame:
        """Features of several groups side by side, a row for each key that any of the groups has.

        `catalog` tells each feature's group; unknown names raise KeyError. With `require_settled`, a range with days that
        backfill lacks raises ValueError.
        """
        groups: dict[str, list[str]] = {}
        for name in names:
            groups.setdefault(catalog[name], []).append(name)
        for group in groups if require_settled else ():
            if open_days := self.unsettled(group, days):
                raise ValueError(f"{group} has {self.provisional} rows alone on days {open_days}")
        parts = [self.read(group, source, days).select(*KEY, *own) for group, own in groups.items()]
        return reduce(lambda left, right: left.join(right, list(KEY), "full"), parts)

    def compact(self, group: str, to: str) -> None:
        """Rewrite each source's partitions with one row a key."""
        for source in [r.source for r in self.scan(group).select("source").distinct().collect()]:
            self.latest(group, source).repartition("day").sortWithinPartitions(*KEY).write.mode("append").option("compression", "zstd").partitionBy("source", "day").parquet(f"{to}/group={group}")

    def manifest(self, group: str) -> DataFrame:
        return self.scan(group).groupBy("source", "day").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("symbol").alias("n_symbols"))

    def retain(self, group: str, first_day: int) -> DataFrame:
        return self.scan(group).where(F.col("day") >= first_day)


def _filled(spark: SparkSession, sf_dir: str) -> FeatureStore:
    store = FeatureStore(spark, shared_path(spark, "store"))
    store.write(run_sql(spark, sf_dir, STREAM), "bars", "stream")
    store.write(run_sql(spark, sf_dir, BACK), "bars", "backfill")
    return store


def scan_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filled(spark, sf_dir).read("bars").select("symbol", "t", F.round("close", 6).alias("close"), "source")


def compact_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _filled(spark, sf_dir)
    store.write(run_sql(spark, sf_dir, BACK).where("t % 3 = 0").withColumn("close", F.col("close") + 1), "bars", "backfill", 1)
    to = shared_path(spark, "compacted")
    store.compact("bars", to)
    return FeatureStore(spark, to).scan("bars").where("source = 'backfill'").select("symbol", "t", F.round("close", 6).alias("close"))


def store_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filled(spark, sf_dir).manifest("bars").select("source", F.col("day").cast("long").alias("day"), "n_rows", "n_symbols")


def store_multi_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _filled(spark, sf_dir)
    store.write(run_sql(spark, sf_dir, STREAM).where("t % 3 <> 0").select(*KEY, "volume"), "flow", "stream")
    store.write(run_sql(spark, sf_dir, BACK).where("t % 2 = 0").select(*KEY, "volume"), "flow", "backfill")
    wide = store.features(["close", "volume"], {"close": "bars", "volume": "flow"}, SPAN)
    return wide.select(*KEY, F.round("close", 6).alias("close"), F.round("volume", 6).alias("volume"))


#: Days that the query over several groups asks for.
SPAN = (19725, 19745)
_B, _S = duckdb_text(BACK), duckdb_text(STREAM)
QUERIES = {"scan_features": scan_features, "compact_partition": compact_partition, "store_manifest": store_manifest, "store_multi_group": store_multi_group}
SQL = {
    "scan_features": f"WITH k AS ({_B}), s AS ({_S}) SELECT symbol, t, round(close, 6) AS close, 'backfill' AS source FROM k UNION ALL SELECT symbol, t, round(close, 6), 'stream' FROM s WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.symbol = s.symbol AND k.t = s.t)",
    "compact_partition": f"SELECT symbol, t, round(close + CASE WHEN t % 3 = 0 THEN 1 ELSE 0 END, 6) AS close FROM ({_B}) k",
    "store_manifest": f"SELECT source, CAST(floor(t / 24) AS BIGINT) AS day, count(*) AS n_rows, count(DISTINCT symbol) AS n_symbols FROM (SELECT 'backfill' AS source, symbol, t FROM ({_B}) k UNION ALL SELECT 'stream', symbol, t FROM ({_S}) s) z GROUP BY 1, 2",
    "store_multi_group": f"""WITH k AS (SELECT * FROM ({_B}) k0 WHERE floor(t / 24) BETWEEN {SPAN[0]} AND {SPAN[1]}), s AS (SELECT * FROM ({_S}) s0 WHERE floor(t / 24) BETWEEN {SPAN[0]} AND {SPAN[1]}),
b AS (SELECT symbol, t, close FROM k UNION ALL SELECT symbol, t, close FROM s WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.symbol = s.symbol AND k.t = s.t)),
f AS (SELECT symbol, t, volume FROM k WHERE t % 2 = 0 UNION ALL SELECT symbol, t, volume FROM s WHERE t % 3 <> 0 AND NOT EXISTS (SELECT 1 FROM k WHERE k.t % 2 = 0 AND k.symbol = s.symbol AND k.t = s.t))
SELECT coalesce(b.symbol, f.symbol) AS symbol, coalesce(b.t, f.t) AS t, round(close, 6) AS close, round(volume, 6) AS volume FROM b FULL OUTER JOIN f ON b.symbol = f.symbol AND b.t = f.t""",
}
