"""Exact deduplication as a stream with disk-backed keyed state.

Every arrival is reduced to (digest, stable id, content locator). A Structured Streaming query keeps, for each digest
and without expiry, the group's stable identifier, the locator of its content and the count, in RocksDB with its
checkpoint in the shared folder. A locator tells a row of the documents: its file and its place there, where documents
are read from files, else a hash of id and text. After the stream, rows whose digest is held (hits) are compared byte by
byte with the text that the group's locator leads to; should texts only share a digest, groups are formed by their whole
bytes instead.

With a folder of the caller's, state outlives the call: a later call takes in more documents, and answers for all so far.

Defined results: a null text counts as empty, empty texts are equal to each other, the row with the largest id stays,
repeated (id, text) rows count as members of one group, an empty table gives an empty result, other columns are ignored
whatever their names. A null id is kept as it is: such rows are never chosen while their group has an id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_path, drop_table, shared_path, written

#: A hot group's rows are dealt to so many parts for the join that fetches texts; its representative is copied for every SHARE rows.
SALTS, SHARE = 16, 256


def sha256_text(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def _keyed_state(spark: SparkSession, schema: T.StructType, path: str, work: str, files_per_batch: int) -> DataFrame:
    """(digest, keep_id, locator, group_size) of each digest after the stream has taken in all new arrivals at `path`."""
    held = {
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
        "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
        "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "8",
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
        # a store's local files (some MB each, mostly preallocated) go when its task has committed
        "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    }
    before = {k: spark.conf.get(k, None) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
        state = stream.groupBy("digest").agg(F.max(F.struct("id", "locator")).alias("top"), F.count(F.lit(1)).alias("group_size"))
        query = (
            state.writeStream.outputMode("update")
            .option("checkpointLocation", f"{work}/checkpoint")
            .trigger(availableNow=True)
            .foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{work}/held/batch={n}"))
            .start()
        )
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    out = T.StructType([*state.schema.fields, T.StructField("batch", T.LongType())])
    try:
        held_rows = spark.read.schema(out).parquet(f"{work}/held")
    except Exception as e:  # an empty table makes no batch
        if "PATH_NOT_FOUND" not in str(e):
            raise
        held_rows = spark.createDataFrame([], out)
    # the id and the count only grow, so the last update of a digest is its largest
    final = held_rows.groupBy("digest").agg(F.max("top").alias("top"), F.max("group_size").alias("group_size"))
    return written(final.select("digest", F.col("top.id").alias("keep_id"), F.col("top.locator").alias("locator"), "group_size"), "dedup-held")


def _located(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text and locator (file, row) of each row."""
    rows = [F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")]
    try:
        if "_metadata" in docs.columns:
            raise AnalysisException("a column of the caller's")
        return docs.select(*rows, F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("locator"))
    except AnalysisException:  # not read from files with rows to count
        seen = docs.select(*rows)
        return seen.withColumn("locator", F.struct(F.lit("").alias("file"), F.xxhash64("id", "text").alias("row")))


def stream_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] | None = None, files_per_batch: int = 1024, state: str | None = None) -> DataFrame:
    """One row a document: id, keep_id, group_size, kept, text_sha256, locator (of the content that the group keeps).

    digest: what keys the state; SHA-256 by default. A weaker one gives the same result, by whole bytes once texts collide.
    state: a folder that all executors share, to go on from; the result then holds the documents of earlier calls too.
    Their texts are kept there, as hits are compared with them.
    """
    spark = docs.sparkSession
    digest = digest or (lambda t: F.unhex(sha256_text(t)))
    work = state.rstrip("/") if state else shared_path(spark, "dedup-stream")
    seen = _located(docs, id_col, text_col)
    if state:
        seen.write.mode("append").parquet(f"{work}/content")
        seen = spark.read.schema(seen.schema).parquet(f"{work}/content")
        seen = seen.select("id", "text", F.struct(F.lit("").alias("file"), F.xxhash64("id", "text").alias("row")).alias("locator"))
        new = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        new = new.select("*", F.struct(F.lit("").alias("file"), F.xxhash64("id", "text").alias("row")).alias("locator"))
    else:
        new = seen
    keyed = new.select("id", digest(F.col("text")).alias("digest"), sha256_text(F.col("text")).alias("sha"), "locator")
    keyed.write.mode("append").parquet(f"{work}/arrivals")
    arrivals = spark.read.schema(keyed.schema).parquet(f"{work}/arrivals")
    groups = _keyed_state(spark, keyed.schema, f"{work}/arrivals", work, files_per_batch)
    if _unequal(seen, digest, groups) is None:
        rows = arrivals.drop("locator").join(groups, "digest", "left").select("id", "keep_id", "group_size", "sha", "locator")
    else:
        rows = _by_bytes(seen)
    if state:
        return _result(rows, id_col)
    out = written(_result(rows, id_col), "dedup-rows")
    drop_path(spark, work)
    drop_table(groups)
    return out


def _unequal(seen: DataFrame, digest: Callable[[Column], Column], state: DataFrame) -> DataFrame | None:
    """Hits whose bytes differ from the text that the state's locator leads to; None if there are none."""
    groups = state.where("group_size > 1")
    salted = groups.select("digest", F.col("locator").alias("held_at"), "group_size", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    hits = (
        seen.select(digest(F.col("text")).alias("digest"), F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt"), "id", "text", "locator")
        .join(salted.hint("shuffle_hash"), ["digest", "salt"])
        .drop("salt")
    )
    hits = written(hits, "dedup-hits")
    parts = F.least(F.lit(4096), F.ceil(F.col("group_size") / SHARE)).cast("int")
    stays = hits.where("locator = held_at").dropDuplicates(["digest"])
    stays = stays.select("digest", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.encode("text", "UTF-8").alias("held"))
    rows = hits.select("digest", F.pmod(F.xxhash64("id", F.lit(7)), parts).cast("int").alias("part"), "id", F.encode("text", "UTF-8").alias("bytes"))
    wrong = rows.join(stays, ["digest", "part"], "left").where("held IS NULL OR bytes <> held").select("id")
    found = wrong.limit(1).count()
    drop_table(hits)
    return wrong if found else None


def _by_bytes(seen: DataFrame) -> DataFrame:
    """The answer by whole texts, for digests that are known to collide: (digest, text) is the key of the pre-aggregated groups."""
    groups = seen.groupBy("text").agg(F.max(F.struct("id", "locator")).alias("top"), F.count(F.lit(1)).alias("group_size"))
    return seen.drop("locator").join(groups, "text").select("id", F.col("top.id").alias("keep_id"), "group_size", sha256_text(F.col("text")).alias("sha"), F.col("top.locator").alias("locator"))


def _result(rows: DataFrame, id_col: str) -> DataFrame:
    return rows.select(F.col("id").alias(id_col), "keep_id", F.col("group_size").cast("long").alias("group_size"), F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"), "locator")


def op5_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return stream_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("locator")


SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
