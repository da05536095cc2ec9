"""Exact dedup: stateful streaming, disk-backed keyed state without expiry.

1. Every row is reduced to a print: SHA-256 of the normalised text (all of
   ``[\\x20\\x09-\\x0D]`` deleted), its id, its length in code points and its
   locator (file, row in the file).  Prints are written to the shared folder.
2. A stream over the prints keeps keyed state in RocksDB, without watermark
   and so without expiry: digest -> number of rows, and length, id and locator
   of the row that stays (most code points, then smallest id, then locator).
   Rows are summed per task before they reach the state, so a digest with a
   third of all rows is a few rows there.  The state is read back from its
   checkpoint as a table.
3. Digests with more than one row are hits, and full bytes of their rows are
   compared: the smallest and the largest normalised text of a digest must be one
   and the same.  Both are aggregates, so copies meet in each task before the
   shuffle.  A bitmap of fixed size over the hits' locators keeps other texts from
   being moved.  Digests that fail (a collision) are split by the text itself.

Only DataFrame and SQL operations run on the executors.

Defined cases: null text counts as empty; all empty texts are one group; a
null id orders after all others; of identical rows the first by locator stays,
so exactly one row of a group is kept; an empty table gives an empty result.
Extra columns are not read.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tocsin.llm.common import BLANK, shared_path, stored, text_of

STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # Every state partition would set aside some MB of disk beforehand.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
LAST_ID = 2**63 - 1
HIT_BITS = 1 << 22  # of the bitmap over the rows to compare


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, BLANK, "")


def located(docs: DataFrame, *kept: Column) -> DataFrame:
    """(doc_id, text, file, row, *kept) of ``docs``: its rows with their place.  A
    frame that isn't a scan of files is written to the shared folder first."""
    def with_place(df: DataFrame) -> DataFrame:
        place = df.metadataColumn("_metadata")  # not a column of the table that has this name
        return df.select("doc_id", "text", place["file_path"].alias("file"), place["row_index"].alias("row"), *kept)
    try:
        return with_place(docs)
    except AnalysisException:
        return with_place(stored(docs, "dedup-input"))


def keyed_state(spark: SparkSession, prints_path: str, schema, batch_bytes: int | None) -> DataFrame:
    """Runs the stream over the prints to its end; the state as a table
    (digest, group_size, best)."""
    at = shared_path(spark, "dedup-state")
    before = {k: spark.conf.get(k, None) for k in STATE_SETTINGS}
    for k, v in STATE_SETTINGS.items():
        spark.conf.set(k, v)
    try:
        reader = spark.readStream.schema(schema)
        if batch_bytes:
            reader = reader.option("maxBytesPerTrigger", str(batch_bytes))
        rank = F.struct((-F.col("points")).alias("points"), "id", "file", "row")
        query = (reader.parquet(prints_path).groupBy("digest")
                 .agg(F.count(F.lit(1)).alias("group_size"), F.min(rank).alias("best"))
                 .writeStream.format("noop").outputMode("update").trigger(availableNow=True)
                 .option("checkpointLocation", at).start())
        query.awaitTermination()
        if query.recentProgress:
            state = spark.read.format("statestore").load(at)
            values = state.schema["value"].dataType.fieldNames()
            return state.select(F.col("key.digest").alias("digest"),
                                F.col(f"value.{values[0]}").alias("group_size"),
                                F.col(f"value.{values[1]}").alias("best"))
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    best = "struct<points:int,id:bigint,file:string,row:bigint>"
    return spark.createDataFrame([], f"digest string, group_size long, best {best}")


def in_bitmap(slots: DataFrame, slot: Column) -> Column:
    """Whether ``slot`` (0 to ``HIT_BITS``) may be among those of the table ``slots`` (slot):
    a literal of ``HIT_BITS / 64`` numbers, whatever the number of rows."""
    packed = slots.groupBy(F.expr("slot div 64").alias("at")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(slot % 64 AS INT))")).alias("bits")).collect()
    words = ["0"] * (HIT_BITS // 64)
    for r in packed:
        words[r["at"]] = str(r["bits"])
    held = F.split(F.lit(",".join(words)), ",").cast("array<bigint>")
    word = F.element_at(held, F.floor(slot / 64).cast("int") + 1)
    return F.call_function("shiftright", word, (slot % 64).cast("int")).bitwiseAND(F.lit(1)) == 1


def collided(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """Digests under which different texts stand: the comparison of full bytes of the
    rows ``hits`` (file, row, digest)."""
    def slot(file: str, row: str) -> Column:
        return F.pmod(F.xxhash64(file, row), F.lit(HIT_BITS))

    near = docs.where(in_bitmap(hits.select(slot("file", "row").alias("slot")), slot("file", "row")))
    rows = near.select("file", "row", "text").join(hits, ["file", "row"])
    norm = normalised(text_of())
    return (rows.select("digest", norm.alias("norm"))
            .groupBy("digest").agg(F.min("norm").alias("low"), F.max("norm").alias("high"))
            .where("low != high").select("digest"))


def regrouped(docs: DataFrame, digest: Column, bad: DataFrame) -> DataFrame:
    """Rows of the collided digests, grouped by digest and text."""
    rank = F.struct((-F.col("points")).alias("points"), "id", "file", "row")
    rows = (docs.select(*prints_of(docs, digest), normalised(text_of()).alias("norm"))
            .join(bad, "digest"))
    best = rows.groupBy("digest", "norm").agg(F.count(F.lit(1)).alias("group_size"), F.min(rank).alias("best"))
    return rows.join(best, ["digest", "norm"]).drop("norm")


def prints_of(docs: DataFrame, digest: Column) -> list[Column | str]:
    return [
        sha_of().alias("sha"), digest.alias("digest"), F.char_length(text_of()).alias("points"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("id"),
        F.col("doc_id").cast("long").alias("doc_id"), "file", "row"]


def sha_of() -> Column:
    return F.sha2(normalised(text_of()).cast("binary"), 256)


def exact_dedup(docs: DataFrame, batch_bytes: int | None = 64 << 30, digest_chars: int = 64) -> DataFrame:
    """One row per row of ``docs`` (columns doc_id and text): doc_id, keep_id,
    group_size, kept, text_sha256, and the locators (file, row) of the row and of
    the row that stays (keep_file, keep_row).

    ``batch_bytes`` bounds what a micro-batch reads; ``digest_chars`` cuts the
    key, so that tests can force collisions."""
    return decided(located(docs), batch_bytes, digest_chars)


def decided(docs: DataFrame, batch_bytes: int | None, digest_chars: int = 64) -> DataFrame:
    """The decisions on located rows."""
    spark = docs.sparkSession
    digest = F.substring(sha_of(), 1, digest_chars)
    path = shared_path(spark, "dedup-prints")
    docs.select(*prints_of(docs, digest)).write.parquet(path)
    prints = spark.read.parquet(path)
    state = stored(keyed_state(spark, path, prints.schema, batch_bytes), "dedup-groups")
    whole = prints.join(state, "digest")
    hits = stored(prints.select("file", "row", "digest").join(state.where("group_size > 1").select("digest"), "digest"), "dedup-hits")
    bad = stored(collided(docs, hits), "dedup-collisions")
    if not bad.isEmpty():
        # A digest that stands for several texts is regrouped by the text itself.
        whole = whole.join(bad, "digest", "left_anti").unionByName(regrouped(docs, digest, bad))
    return whole.select(
        "doc_id", F.when(F.col("best.id") != LAST_ID, F.col("best.id")).alias("keep_id"), "group_size",
        ((F.col("file") == F.col("best.file")) & (F.col("row") == F.col("best.row"))).alias("kept"),
        F.col("sha").alias("text_sha256"), "file", "row",
        F.col("best.file").alias("keep_file"), F.col("best.row").alias("keep_row"))


def deduplicated(docs: DataFrame, batch_bytes: int | None = 64 << 30) -> DataFrame:
    """The rows of ``docs`` that stay; columns unchanged."""
    own = docs.columns
    rows = located(docs, F.struct(*[F.col(f"`{c}`") for c in own]).alias("all"))
    dropped = decided(rows.drop("all"), batch_bytes).where("not kept").select("file", "row")
    return (rows.join(dropped, ["file", "row"], "left_anti")
            .select(*[F.col("all").getField(c).alias(c) for c in own]))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents),
g AS (SELECT norm, count(*) AS group_size, arg_min(doc_id, (-length(t), doc_id)) AS keep_id FROM d GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
FROM d JOIN g USING (norm)
"""
