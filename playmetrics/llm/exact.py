"""Exact deduplication as a stateful stream.

A row is named by its place: the file and row where its content lies. A stream of (digest, id, place) keeps, in a
disk-backed (RocksDB) state that never expires, one entry per digest: how many rows had it, the
largest id, and the place of that row's content. Rows of a batch are combined before they
reach the state, so a digest with a third of all rows is no hot key. With ``store`` the state, the places and the content
stay in that folder, and a later delivery meets the state of all earlier ones, also after a restart.

A digest seen more than once is a hit. The full bytes of hits are compared; should texts with one
digest differ, the rows of that digest are grouped by their whole text instead. The retained place
tells the one row that stays. Texts are moved for hits only (and for a few others that a bitmap of hits lets
through).

Defined cases: a null text counts as empty; of equal texts the row with the largest id stays (a null
id is smaller than any other), of rows that share text and id exactly one stays; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import settle, work_dir
from .common import columns_free, text_of
from .places import PATH, ROW, sieve, sifted, with_places, without

#: Session settings while the stream runs. Without fallocate a state partition takes the disk that its
#: entries need; with it, each one reserves 4 MB however small it is. All state partitions of an executor share
#: one bounded cache; else each holds write buffers of its own, which stay until it is unloaded.
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "96",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "4",
}
PLACE = "struct<id:{id},path:string,row:bigint>"


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _run(arrivals: DataFrame, id_type: str, root: str) -> DataFrame:
    """Pass the arrivals through the state; the last version of each changed entry."""
    spark = arrivals.sparkSession
    entries = arrivals.groupBy("digest").agg(
        F.count("*").alias("size"), F.max(F.struct("id", "path", "row")).alias("last")
    )
    out = f"{root}/entries"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    before = {key: spark.conf.get(key, None) for key in SETTINGS}
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    try:
        query = (
            entries.writeStream.outputMode("update")
            .option("checkpointLocation", f"{root}/state")
            .trigger(availableNow=True)
            .foreachBatch(keep)
            .start()
        )
        query.awaitTermination()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    kind = f"digest binary, size bigint, last {PLACE.format(id=id_type)}"
    if not _exists(spark, out):
        return spark.createDataFrame([], kind)
    versions = spark.read.schema(f"{kind}, batch bigint").parquet(out)
    return versions.groupBy("digest").agg(F.max("size").alias("size"), F.max_by("last", "size").alias("last"))


def _verdicts(
    docs: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column], store: str | None
) -> tuple[DataFrame, DataFrame]:
    """All rows with their places, and per place ``id, digest, size, keep_id, kept``."""
    spark = docs.sparkSession
    root = store or work_dir(spark, "exact")
    id_type = docs.schema[id_col].dataType.simpleString()
    if store is None:
        held = fresh = with_places(docs)
    else:
        # The content of earlier deliveries may be gone, so each delivery's is kept here.
        docs.write.mode("append").parquet(f"{root}/content/{uuid4().hex}")
        held = fresh = with_places(spark.read.schema(docs.schema).parquet(f"{root}/content/*"))
        if _exists(spark, f"{root}/arrivals"):
            seen = spark.read.parquet(f"{root}/arrivals").select("path").distinct()
            fresh = held.join(seen.withColumnRenamed("path", PATH), PATH, "left_anti")
    rows = fresh.select(F.col(id_col).alias("id"), digest(text_of(text_col)).alias("digest"), F.col(PATH).alias("path"), F.col(ROW).alias("row"))
    rows.write.mode("append").parquet(f"{root}/arrivals")
    kind = f"id {id_type}, digest binary, path string, row bigint"
    arrivals = spark.read.schema(kind).parquet(f"{root}/arrivals")
    entries = settle(_run(spark.readStream.schema(kind).parquet(f"{root}/arrivals"), id_type, root), "entries")

    # Hits: the rows of a digest have the same bytes if their least and greatest texts are equal. Texts
    # meet combined, one for each digest and task, so a large group of copies is not moved about.
    hits = settle(sieve(entries.where("size > 1"), "digest"), "hits")
    texts = held.select(text_of(text_col).alias("text"), F.col(PATH).alias("path"), F.col(ROW).alias("row"))
    _, compared = sifted(texts.withColumn("digest", digest(F.col("text"))), hits, F.col("digest"))
    differing = settle(
        compared.groupBy("digest")
        .agg(F.min("text").alias("least"), F.max("text").alias("greatest"))
        .where(F.col("least") != F.col("greatest"))
        .select("digest"),
        "differing",
    )

    shown = lambda df: df.select(
        F.col("path").alias(PATH),
        F.col("row").alias(ROW),
        "id",
        "digest",
        "size",
        F.col("last.id").alias("keep_id"),
        ((F.col("last.path") == F.col("path")) & (F.col("last.row") == F.col("row"))).alias("kept"),
    )
    if differing.isEmpty():
        return held, shown(arrivals.join(entries.withColumnRenamed("digest", "found"), F.col("digest") == F.col("found")))
    sound = entries.join(differing, "digest", "left_anti").withColumnRenamed("digest", "found")
    apart = arrivals.join(compared.join(differing, "digest", "left_semi").select("text", "path", "row"), ["path", "row"])
    by_text = (
        apart.groupBy("digest", "text")
        .agg(F.count("*").alias("size"), F.max(F.struct("id", "path", "row")).alias("last"))
        .withColumnsRenamed({"digest": "found", "text": "content"})
    )
    split = apart.join(by_text, (F.col("digest") == F.col("found")) & (F.col("text") == F.col("content")))
    return held, shown(arrivals.join(sound, F.col("digest") == F.col("found"))).unionByName(shown(split))


def deduplicate(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: Callable[[Column], Column] = sha256,
    carry: bool = False,
    store: str | None = None,
) -> DataFrame:
    """One row per document: the id, keep_id, group_size, kept, digest.

    ``carry`` adds all columns of ``docs`` instead of the id alone (the added names get leading
    underscores where ``docs`` uses them). With ``store``, a folder that all machines share, the result is that
    of all deliveries so far: as if their rows had come at once.
    """
    held, found = _verdicts(docs, id_col, text_col, digest, store)
    size, keep, kept, code = columns_free(docs if carry else docs.select(id_col), "group_size", "keep_id", "kept", "digest")
    added = [F.col("keep_id").alias(keep), F.col("size").alias(size), F.col("kept").alias(kept), F.col("digest").alias(code)]
    if not carry:
        return found.select(F.col("id").alias(id_col), *added)
    mine = held.select(PATH, ROW, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_held"))
    return mine.join(found, [PATH, ROW]).select("_held.*", *added)


def distinct_rows(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256
) -> DataFrame:
    """The rows that stay, with all their columns; only dropped rows and a few others are moved to be told apart."""
    held, found = _verdicts(docs, id_col, text_col, digest, None)
    return without(held, settle(found.where("not kept").select(PATH, ROW), "dropped"))
