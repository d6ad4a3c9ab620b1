"""Stores of files: listing, ranges, outcomes of deletes, and what each kind of store can do."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilewright.functions import glob
from tilewright.functions.names import is_safe_key, require_safe
from tilewright.sources import bytes as ranged
from tilewright.sources import files

BLOCK_BYTES = 65_536
CAPABILITY = "store string, range_reads boolean, streaming_reads boolean, stat boolean, user_metadata boolean, list boolean, hierarchical_list boolean, real_directories boolean, writes boolean, multipart_upload boolean, multipart_threshold_bytes long, conditional_write boolean, bulk_delete boolean, bulk_delete_batch_limit int, delete_reports_existence boolean, server_side_copy boolean, atomic_move boolean, presigned_urls boolean, max_presign_seconds long, versioning boolean, strong_read_after_write boolean"
_MB8, _MANY, _WEEK = 8 << 20, 2**31 - 1, 7 * 86_400
#: What stores of each kind can do, in the order of CAPABILITY.
CAPABILITIES = [
    ("file", True, True, True, False, True, True, True, True, False, 0, True, True, _MANY, True, True, True, False, None, False, True),
    ("http", True, True, True, False, False, False, False, False, False, 0, False, False, 1, False, False, False, False, None, False, True),
    ("s3", True, True, True, True, True, True, False, True, True, _MB8, True, True, 1000, False, True, False, True, _WEEK, True, True),
    ("s3-directory", True, True, True, True, True, True, False, True, True, _MB8, True, True, 1000, False, True, False, True, 300, False, True),
    ("gcs", True, True, True, True, True, True, False, True, True, _MB8, True, True, 100, True, True, False, True, _WEEK, True, True),
    ("gcs-hierarchical", True, True, True, True, True, True, True, True, True, _MB8, True, True, 100, True, True, True, True, _WEEK, True, True),
    ("azure", True, True, True, True, True, True, False, True, True, _MB8, True, True, 256, True, True, False, True, _WEEK, True, True),
    ("azure-datalake", True, True, True, True, True, True, True, True, True, _MB8, True, True, _MANY, True, True, True, False, None, False, True),
]


def listed(spark: SparkSession, root: str, path: Column) -> Column:
    """The key of a file's path below root: what follows the root as the file system itself writes it."""
    return F.substr(path, F.lit(len(files.qualified(spark, root)) + 2))


def list_files(spark: SparkSession, root: str, pattern: str = "**") -> DataFrame:
    """key, size, last_modified of the files below root that match. Only the pattern's folder is listed; no content is read."""
    require_safe(pattern)
    start = glob.prefix(pattern)
    base = root.rstrip("/")
    there = f"{base}/{start}" if start else base
    if not files.exists(spark, there):
        return spark.createDataFrame([], "key string, size long, last_modified timestamp")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(there).select("path", "length", "modificationTime")
    key = listed(spark, base, F.col("path"))
    return found.select(key.alias("key"), F.col("length").alias("size"), F.col("modificationTime").alias("last_modified")).where(glob.matches(F.col("key"), pattern))


def read_ranges(spark: SparkSession, root: str, ranges: DataFrame) -> DataFrame:
    """The columns of ``ranges`` (key, range_offset, range_length and any other) with ``bytes``; cut at the end of the file,
    empty past it, an error below zero or for a file that isn't there. Unsafe keys are left out.

    Ranges of a file come together, ordered, and each task opens a file once and reads its ranges alone.
    """
    own = ranges.where(is_safe_key(F.col("key")))
    names = own.columns
    schema = T.StructType([*own.schema, T.StructField("bytes", T.BinaryType())])
    at = [names.index(c) for c in ("key", "range_offset", "range_length")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, file, size = None, None, 0
        for batch in batches:
            out = []
            for key, offset, length in zip(*(batch.column(i).to_pylist() for i in at)):
                if key != now:
                    if file:
                        file.close()
                    now, file = key, ranged.opened(f"{root.rstrip('/')}/{key}")
                    size = file.size()
                if offset < 0 or length < 0:
                    raise ValueError(f"range {offset} and {length} of {key}")
                out.append(file.read_at(min(length, size - offset), offset) if offset < size else b"")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=schema.names)
        if file:
            file.close()

    # by offset, too: a large file with many ranges is read by many tasks
    spread = own.repartitionByRange("key", "range_offset").sortWithinPartitions("key", "range_offset")
    return spread.mapInArrow(run, schema)


def blocks_of(ranges: DataFrame, block: int = BLOCK_BYTES) -> DataFrame:
    """The other columns with block_no, block_offset: the aligned blocks that each byte range touches; none for empty ranges."""
    first, last = F.floor(F.col("range_offset") / block), F.floor((F.col("range_offset") + F.col("range_length") - 1) / block)
    rows = ranges.where(F.col("range_length") > 0).withColumn("block_no", F.explode(F.sequence(first, last)))
    return rows.withColumn("block_offset", F.col("block_no") * block)


def delete_outcome(wanted: DataFrame, existing: DataFrame, failed: DataFrame, key: str = "object_key") -> DataFrame:
    """key, outcome of a bulk delete: deleted, did_not_exist or failed. Repeated keys count once."""
    there = existing.select(key).distinct().withColumn("__there", F.lit(True))
    bad = failed.select(key).distinct().withColumn("__bad", F.lit(True))
    joined = wanted.select(key).where(F.col(key).isNotNull()).distinct().join(there, key, "left").join(bad, key, "left")
    return joined.select(key, F.when(F.col("__there").isNull(), "did_not_exist").when(F.col("__bad"), "failed").otherwise("deleted").alias("outcome"))


def capabilities(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CAPABILITIES, CAPABILITY)


def require(store: str, capability: str) -> None:
    """Raises where a kind of store can't do something."""
    names = [c.split()[0] for c in CAPABILITY.split(", ")]
    row = next((dict(zip(names, r)) for r in CAPABILITIES if r[0] == store), None)
    if row is None or not row[capability]:
        raise NotImplementedError(f"{store} has no {capability}")


class Changed(OSError):
    """The file isn't the one that was meant."""


class Store:
    """A folder as a store: keys below a root, on any file system that Spark knows. A file's etag follows from its size and
    time, since Hadoop's file systems have none of their own."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, key: str) -> str:
        return f"{self.root}/{require_safe(key)}"

    def stat(self, key: str) -> dict | None:
        """key, size, last_modified (seconds), etag; None if there is no such file."""
        found = files.status(self.spark, self._path(key))
        return found and {"key": key, "size": found[0], "last_modified": found[1], "etag": f"{found[0]:x}-{int(found[1] * 1000):x}"}

    def exists(self, key: str) -> bool:
        return self.stat(key) is not None

    def read(self, key: str, offset: int = 0, length: int | None = None, if_match: str | None = None, if_modified_since: float | None = None) -> bytes | None:
        """The bytes from offset on, up to length; none past the end, an error below zero. Another file than ``if_match``
        raises Changed; one no younger than ``if_modified_since`` gives None."""
        if offset < 0 or (length or 0) < 0:
            raise ValueError(f"range {offset} and {length}")
        known = self.stat(key)
        if known is None:
            raise FileNotFoundError(key)
        if if_match is not None and if_match != known["etag"]:
            raise Changed(key)
        if if_modified_since is not None and known["last_modified"] <= if_modified_since:
            return None
        left = max(0, known["size"] - offset)
        return files.read_bytes(self.spark, self._path(key), offset, left if length is None else min(left, length))

    def get(self, key: str) -> str:
        return self.read(key).decode()

    def put(self, key: str, data: str | bytes, only_new: bool = False, if_match: str | None = None) -> bool:
        """Writes text or bytes; False if ``only_new`` and it is there. Another file than ``if_match`` raises Changed."""
        raw = data.encode() if isinstance(data, str) else data
        if if_match is not None and (self.stat(key) or {}).get("etag") != if_match:
            raise Changed(key)
        if only_new:
            return files.create_once(self.spark, self._path(key), raw)
        files.write_bytes(self.spark, self._path(key), raw)
        return True

    def put_file(self, key: str, local: str) -> None:
        """A local file of the driver, copied by blocks."""
        files.copy(self.spark, f"file://{local}", self._path(key))

    def delete(self, *keys: str) -> dict[str, str]:
        out = {}
        for k in keys:
            out[k] = "did_not_exist" if not self.exists(k) else "deleted" if files.delete(self.spark, self._path(k)) else "failed"
        return out

    def copy(self, old: str, new: str, to: Store | None = None, overwrite: bool = True) -> None:
        """Also into another store."""
        files.copy(self.spark, self._path(old), (to or self)._path(new), overwrite)

    def move(self, old: str, new: str) -> None:
        files.rename(self.spark, self._path(old), self._path(new))

    def list(self, pattern: str = "**") -> DataFrame:
        return list_files(self.spark, self.root, pattern)

    def read_ranges(self, ranges: DataFrame) -> DataFrame:
        return read_ranges(self.spark, self.root, ranges)
