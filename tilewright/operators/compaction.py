"""Few well-sized files out of very many tiny ones, with proof that nothing was lost or doubled."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.session import cut, scratch_path
from tilewright.sources.files import delete, rename, write_text

SMALL_BYTES = 65_536
LEAST_FILES = 10
#: Rows of a key, a size and two hashes that are sent to all executors; more are shuffled, and hashed rather than sorted.
BROADCAST_FILES = 50_000


def _hash(payload: str = "payload") -> Column:
    """Tells a null payload from an empty one."""
    return F.xxhash64("dataset", "object_key", F.col(payload).isNull(), F.col(payload))


def is_live(dataset: Column, key: Column) -> Column:
    """No path segment after the dataset starts with _ or a dot."""
    rest = F.when(F.startswith(key, F.concat(dataset, F.lit("/"))), F.substr(key, F.length(dataset) + 1)).otherwise(F.concat(F.lit("/"), key))
    return ~F.contains(rest, F.lit("/_")) & ~F.contains(rest, F.lit("/."))


def located(files: DataFrame) -> DataFrame:
    """The rows that count, with size_bytes filled in, ``content`` (hash of key and payload) and ``at``: what tells a row
    from its copies. That is its place where the table is read from files, and 0 for tables that have no such places."""
    rows = files.where((F.col("kind") == "File") & F.col("object_key").isNotNull() & F.col("dataset").isNotNull())
    at = F.xxhash64("_metadata.file_path", "_metadata.row_index") if has_places(files) else F.lit(0).cast("long")
    size = F.coalesce("size_bytes", F.octet_length("payload").cast("long"))
    return rows.select("dataset", "object_key", "last_modified", size.alias("size_bytes"), "etag", "version_id", "payload", _hash().alias("content"), at.alias("at"))


def has_places(files: DataFrame) -> bool:
    try:
        return bool(files.select("_metadata.file_path", "_metadata.row_index").schema)
    except AnalysisException:
        return False


def live_small_files(rows: DataFrame, small: int = SMALL_BYTES, least: int = LEAST_FILES) -> DataFrame:
    """dataset, object_key, size_bytes, content, at: the live small files of datasets that have at least ``least`` of them.

    Of a key's rows the one with the latest last_modified holds; ties go to the larger size, then the greater etag,
    version and hash, so that the result doesn't depend on row order. Map tasks combine repeated rows before the shuffle,
    which no payload goes through.
    """
    order = F.struct("last_modified", "size_bytes", "etag", "version_id", "content", "at")
    last = rows.groupBy("dataset", "object_key").agg(F.max(order).alias("s")).select("dataset", "object_key", "s.size_bytes", "s.content", "s.at")
    live = last.where(is_live(F.col("dataset"), F.col("object_key")) & (F.col("size_bytes") > 0) & (F.col("size_bytes") < small))
    many = live.groupBy("dataset").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return live.join(many.select("dataset"), "dataset", "left_semi")


def checksum(rows: DataFrame, hashed: Column) -> tuple:
    """Of the multiset of rows: count, sum and exclusive or of their hashes. Order and partitions don't matter."""
    return tuple(rows.agg(F.count(F.lit(1)), F.sum(hashed.cast("decimal(38,0)")), F.bit_xor(hashed)).first())


def compact(files: DataFrame, out: str, target_bytes: int = 128 << 20, small: int = SMALL_BYTES, least: int = LEAST_FILES) -> DataFrame:
    """Packs the live small files into Parquet files of about ``target_bytes`` per dataset; gives the packs as a DataFrame.

    A first pass finds the rows to be packed, without their payloads; they are kept in the shared folder, and the second
    pass fetches their payloads by them. The REBALANCE hint shuffles these by dataset, once, and lets runtime statistics
    merge small partitions and split those of a large dataset, so a dataset with a third of all rows becomes many files
    written by many tasks. The packs are written beside ``out``, with a manifest, and renamed to it only if their multiset
    checksum equals that of the first pass. A mismatch raises and leaves nothing at ``out``. Without any live small file,
    ``out`` holds an empty table. Payloads may be null (the listing has no content); they stay null. While packs are
    written the session's advisory partition size is ``target_bytes``: don't plan other queries in it meanwhile.
    """
    spark = files.sparkSession
    rows = located(files)
    keys, stage = scratch_path(spark, "live"), scratch_path(spark, "packs")
    try:
        live_small_files(rows, small, least).write.parquet(keys)
        chosen = spark.read.parquet(keys)
        expected = checksum(chosen, F.col("content"))
        few = F.broadcast(chosen) if expected[0] <= BROADCAST_FILES else chosen.hint("shuffle_hash")
        own = ["dataset", "object_key", "at"]
        if not has_places(files):  # copies can't be told apart by place, but by what decides between them
            own = ["dataset", "object_key", "content"]
        wanted = rows.select(*own, "payload").join(few.select(*own, "size_bytes"), own).select("dataset", "object_key", "size_bytes", "payload")
        if not has_places(files):
            wanted = wanted.dropDuplicates(["dataset", "object_key"])
        balanced = wanted.hint("rebalance", "dataset").withColumn("pack", F.col("dataset"))
        setting = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
        before = spark.conf.get(setting, None)
        spark.conf.set(setting, str(target_bytes))
        try:
            balanced.write.partitionBy("pack").parquet(stage)
        finally:
            spark.conf.set(setting, before) if before else spark.conf.unset(setting)
        schema = wanted.schema
        got = checksum(spark.read.schema(schema).parquet(stage), _hash())
        if expected != got:
            raise ValueError(f"packs don't hold what the source does: {expected} and {got}")
        write_text(spark, f"{stage}/_MANIFEST", f"rows={got[0]} sum={got[1]} xor={got[2]}\n")
        rename(spark, stage, out)
    finally:
        delete(spark, keys)
        delete(spark, stage)
    return spark.read.schema(schema).parquet(out)


def found(spark: SparkSession, files: DataFrame) -> DataFrame:
    """dataset, object_key of everything in the packs. The packs of this query are removed again; its rows are kept by a checkpoint."""
    out = scratch_path(spark, "compacted")
    try:
        return cut(compact(files, out + "/packs").select("dataset", "object_key"))
    finally:
        delete(spark, out)
