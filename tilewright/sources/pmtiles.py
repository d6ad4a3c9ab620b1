"""Tile archives of version 3: header, directories and tiles as tables, and a writer.

Registered as a data source: ``spark.read.format("pmtiles").option("path", file).option("table", "entries").load()``.
Tables: header (one row), entries (leaf directories are read by a task each), tiles (entries with their bytes; each task
reads neighbouring ranges in one go), metadata (its JSON text). Files are read where tasks run, on any file system that
sources.bytes knows. Conditions on tile_id, and on z of tiles, leave leaf directories unread that can't hold such ids.
"""

from __future__ import annotations

import gzip
import struct
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import to_arrow_type

from tilewright.functions.hilbert import LEVEL_STARTS, MAX_LEVEL, tile_arrays
from tilewright.operators.blocks import numbered
from tilewright.operators.directory import lookup
from tilewright.session import cut, scratch_path
from tilewright.sources import bytes as ranged
from tilewright.sources import files
from tilewright.sources.wire import to_varint, varint

MAGIC, SIZE = b"PMTiles\x03", 127
#: The header's numbers after magic and version, little-endian, in their order on the wire.
HEADER_FORMAT = "<" + "q" * 11 + "B" * 6 + "i" * 4 + "B" + "i" * 2
HEADER_FIELDS = (
    "root_dir_offset root_dir_bytes json_metadata_offset json_metadata_bytes leaf_dirs_offset leaf_dirs_bytes tile_data_offset tile_data_bytes "
    "addressed_tiles_count tile_entries_count tile_contents_count clustered internal_compression tile_compression tile_type min_zoom max_zoom "
    "min_lon_e7 min_lat_e7 max_lon_e7 max_lat_e7 center_zoom center_lon_e7 center_lat_e7"
).split()
#: What the header's small numbers stand for.
COMPRESSIONS = {0: "unknown", 1: "none", 2: "gzip", 3: "brotli", 4: "zstd"}
TILE_TYPES = {0: "unknown", 1: "mvt", 2: "png", 3: "jpeg", 4: "webp", 5: "avif", 6: "mlt"}
VECTOR_TYPES, RASTER_TYPES = ("mvt", "mlt"), ("png", "jpeg", "webp", "avif")
MIME_TYPES = {"mvt": "application/vnd.mapbox-vector-tile", "png": "image/png", "jpeg": "image/jpeg", "webp": "image/webp", "avif": "image/avif", "mlt": "application/vnd.maplibre-vector-tile"}
#: Bytes between two tiles that are read along rather than skipped, and tiles' bytes per task.
GAP, TASK_BYTES = 1 << 16, 32 << 20


def parse_header(data: bytes) -> dict[str, int]:
    if len(data) < SIZE or data[:8] != MAGIC:
        raise ValueError("not a tile archive of version 3")
    return dict(zip(HEADER_FIELDS, struct.unpack_from(HEADER_FORMAT, data, 8)))


def header_bytes(h: dict[str, int]) -> bytes:
    return MAGIC + struct.pack(HEADER_FORMAT, *(int(h.get(k, 0)) for k in HEADER_FIELDS))


def compress(data: bytes, how: int) -> bytes:
    if how == 2:
        return gzip.compress(data, mtime=0)
    if how == 4:
        import zstandard

        return zstandard.compress(data)
    if how in (0, 1):
        return data
    raise ValueError(f"can't write compression {COMPRESSIONS.get(how, how)}")


def decompress(data: bytes, how: int) -> bytes:
    if how == 2:
        return gzip.decompress(data)
    if how == 4:
        import zstandard

        return zstandard.decompress(data, max_output_size=1 << 30)
    if how in (0, 1):
        return data
    raise ValueError(f"can't read compression {COMPRESSIONS.get(how, how)}")


def parse_directory(data: bytes) -> list[tuple[int, int, int, int]]:
    """tile_id, offset, length, run_length of each entry: four columns of numbers, one after another."""
    n, at = varint(data, 0)
    cols: list[list[int]] = []
    for _ in range(4):
        col = []
        for _ in range(n):
            v, at = varint(data, at)
            col.append(v)
        cols.append(col)
    out, tile, end = [], 0, 0
    for i, (delta, run, length, stored) in enumerate(zip(*cols)):
        tile += delta
        offset = end if stored == 0 and i else stored - 1
        end = offset + length
        out.append((tile, offset, length, run))
    return out


def directory_bytes(entries: Sequence[tuple[int, int, int, int]]) -> bytes:
    out = to_varint(len(entries))
    out += b"".join(to_varint(e[0] - (entries[i - 1][0] if i else 0)) for i, e in enumerate(entries))
    out += b"".join(to_varint(e[3]) for e in entries) + b"".join(to_varint(e[2]) for e in entries)
    return out + b"".join(to_varint(0 if i and e[1] == entries[i - 1][1] + entries[i - 1][2] else e[1] + 1) for i, e in enumerate(entries))


@dataclass
class Part(InputPartition):
    """A directory to read: its place, its level (0 for the root), and the ids that it can hold."""

    offset: int
    length: int
    level: int
    low: int = 0
    high: int = LEVEL_STARTS[-1]


def span_of(f: Filter) -> tuple[int, int]:
    """The ids that a condition on tile_id or z can leave; all of them where it says nothing."""
    whole = 0, LEVEL_STARTS[-1] - 1
    name, v = getattr(f, "attribute", None), getattr(f, "value", None)
    if name == ("tile_id",) and (v is not None or isinstance(f, In)):
        if isinstance(f, EqualTo):
            return v, v
        if isinstance(f, In) and f.value:
            return min(f.value), max(f.value)
        if isinstance(f, (GreaterThan, GreaterThanOrEqual)):
            return v + isinstance(f, GreaterThan), whole[1]
        if isinstance(f, (LessThan, LessThanOrEqual)):
            return whole[0], v - isinstance(f, LessThan)
    if name == ("z",) and isinstance(f, EqualTo) and v is not None:
        return (LEVEL_STARTS[v], LEVEL_STARTS[v + 1] - 1) if 0 <= v <= MAX_LEVEL else (1, 0)
    return whole


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str], table: str):
        self.path, self.table = options["path"], table
        self.header = parse_header(ranged.read_range(self.path, 0, SIZE))
        self.low, self.high = int(options.get("from_id", 0)), int(options.get("to_id", LEVEL_STARTS[-1] - 1))
        wanted, kind = options.get("expect"), TILE_TYPES.get(self.header["tile_type"], "unknown")
        if wanted and wanted != ("raster" if kind in RASTER_TYPES else "vector" if kind in VECTOR_TYPES else kind):
            raise ValueError(f"the archive holds {kind} tiles, no {wanted} ones")

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Conditions on ids and zooms leave directories and tiles unread; all filters are applied again by Spark.

        An entry starts no later than the ids that it covers: of entries, only an upper bound of tile_id and none of z is
        the same as one of ids."""
        for f in filters:
            if self.table == "tiles":
                low, high = span_of(f)
                self.low, self.high = max(self.low, low), min(self.high, high)
            elif self.table == "entries" and getattr(f, "attribute", None) == ("tile_id",):
                self.high = min(self.high, span_of(f)[1])
            yield f

    def _directory(self, p: Part) -> list[tuple[int, int, int, int]]:
        return parse_directory(decompress(ranged.read_range(self.path, p.offset, p.length), self.header["internal_compression"]))

    def _leaves(self, entries: list[tuple[int, int, int, int]], p: Part) -> list[Part]:
        """Leaf directories below one, without those whose ids aren't asked for. A leaf's ids end where the next entry begins."""
        base, out = self.header["leaf_dirs_offset"], []
        for i, (t, o, n, r) in enumerate(entries):
            end = entries[i + 1][0] - 1 if i + 1 < len(entries) else p.high
            if r == 0 and t <= self.high and end >= self.low:
                out.append(Part(base + o, n, p.level + 1, t, end))
        return out

    def partitions(self) -> Sequence[InputPartition]:
        root = Part(self.header["root_dir_offset"], self.header["root_dir_bytes"], 0)
        return [root] if self.table in ("header", "metadata") else [root, *self._leaves(self._directory(root), root)]

    def read(self, p: Part) -> Iterator[tuple]:
        h = self.header
        if self.table == "header":
            yield tuple(h[k] for k in HEADER_FIELDS)
        elif self.table == "metadata":
            yield (decompress(ranged.read_range(self.path, h["json_metadata_offset"], h["json_metadata_bytes"]), h["internal_compression"]).decode(),)
        elif self.table == "entries":
            entries = self._directory(p)
            for i, (t, o, n, r) in enumerate(entries):
                yield p.level, i, t, o, n, r
            for leaf in self._leaves(entries, p) if p.level else []:  # the root's leaves are partitions of their own
                yield from self.read(leaf)
        else:
            yield from self._tiles(p)

    def _tiles(self, p: Part) -> Iterator[tuple]:
        h, entries = self.header, self._directory(p)
        for leaf in self._leaves(entries, p) if p.level else []:
            yield from self._tiles(leaf)
        own = sorted((o, n, t, r) for t, o, n, r in entries if r and t <= self.high and t + r > self.low)
        for (o, n, t, r), raw in zip(own, read_along(self.path, [(h["tile_data_offset"] + o, n) for o, n, _, _ in own])):
            data = decompress(raw, h["tile_compression"])
            first = max(t, self.low)
            for at in range(first, min(t + r, self.high + 1), 1 << 16):
                ids = np.arange(at, min(at + (1 << 16), t + r, self.high + 1))
                for id, z, x, y in zip(ids.tolist(), *(v.tolist() for v in tile_arrays(ids))):
                    yield id, z, x, y, data


def read_along(path: str, places: Sequence[tuple[int, int]]) -> Iterator[bytes]:
    """The bytes of ranges in order of offset; near ones are read in one go, and the file is opened once."""
    if not places:
        return
    with ranged.opened(path) as f:
        i = 0
        while i < len(places):
            j, end = i, sum(places[i])
            while j + 1 < len(places) and places[j + 1][0] <= end + GAP and places[j + 1][0] - places[i][0] < TASK_BYTES:
                j += 1
                end = max(end, sum(places[j]))
            block = f.read_at(end - places[i][0], places[i][0])
            for o, n in places[i : j + 1]:
                yield block[o - places[i][0] : o - places[i][0] + n]
            i = j + 1


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pmtiles"

    def schema(self) -> str:
        big = {k for k in HEADER_FIELDS[:11]}
        return {
            "header": ", ".join(f"{k} {'bigint' if k in big else 'int'}" for k in HEADER_FIELDS),
            "metadata": "json string",
            "entries": "dir_level int, i int, tile_id bigint, tile_offset bigint, length_bytes int, run_length int",
            "tiles": "tile_id bigint, z int, x bigint, y bigint, payload binary",
        }[self.options.get("table", "tiles")]

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(self.options, self.options.get("table", "tiles"))


def read(spark: SparkSession, path: str, table: str = "tiles", **options: object) -> DataFrame:
    """A table of an archive. Options: expect (vector or raster: others raise), from_id and to_id (entries and tiles of
    other ids needn't be read)."""
    spark.dataSource.register(ArchiveSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("pmtiles").options(path=path, table=table, **{k: str(v) for k, v in options.items()}).load()


def fetch(wanted: DataFrame, path: str, missing: bool = False, mapper: Callable[[bytes], object] | None = None, returns: str = "binary") -> DataFrame:
    """The rows of ``wanted`` (tile_id and any other columns) with ``payload``, decompressed; those without a tile in the
    archive are left out, or have null with ``missing``. A ``mapper`` makes something else of a tile's bytes, of the type
    ``returns``, once for each content and batch.

    The directory's entries meet the ids in blocks, only leaves between the least and the greatest id are read, and tasks
    then read their ranges in order of offset, near ones in one go.
    """
    spark = wanted.sparkSession
    h = parse_header(ranged.read_range(path, 0, SIZE))
    ends = wanted.agg(F.min("tile_id").alias("low"), F.max("tile_id").alias("high")).first()
    entries = read(spark, path, "entries", from_id=ends["low"] if ends["low"] is not None else 1, to_id=ends["high"] if ends["high"] is not None else 0)
    found = lookup(wanted, entries, by=(), key="tile_id").drop("entry_id", "run_length")
    found = found if missing else found.where("tile_offset IS NOT NULL")
    schema = T.StructType([*wanted.schema, *T.StructType.fromDDL(f"payload {returns}")])
    kind = to_arrow_type(schema["payload"].dataType)
    n, compression, base = len(wanted.columns), h["tile_compression"], h["tile_data_offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = list(zip(batch.column(n).to_pylist(), batch.column(n + 1).to_pylist()))
            there = sorted({p for p in places if p[0] is not None})
            data = dict(zip(there, ((mapper or bytes)(decompress(raw, compression)) for raw in read_along(path, [(base + o, k) for o, k in there]))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array([data.get(p) for p in places], kind)], names=schema.names)

    ordered = found.select(*wanted.columns, "tile_offset", "length_bytes").repartitionByRange("tile_offset").sortWithinPartitions("tile_offset")
    return ordered.mapInArrow(run, schema)


def write(tiles: DataFrame, path: str, metadata: str = "{}", internal: int = 2, compression: int = 2, tile_type: int = 1, leaf_entries: int = 4096, **header: int) -> dict[str, int]:
    """Writes tile_id, payload as one archive and gives its header. Equal payloads of neighbouring ids become runs, equal
    ones elsewhere share their bytes. Rows without payload are left out; an id given twice raises.

    Tasks compress and write the contents, in order of the first id that has them, to parts in the shared folder; offsets
    follow from the parts' sizes. Directories are made by tasks as well. As an archive is one file, its driver copies parts
    and directories to it in blocks of bytes; it holds a number per part and leaf, but no tile and no entry. ``tiles`` are
    computed twice, for their digests and for their bytes.
    """
    spark = tiles.sparkSession
    own = tiles.select("tile_id", "payload").where(F.col("payload").isNotNull() & F.col("tile_id").isNotNull())
    keyed = cut(own.select("tile_id", F.md5("payload").alias("digest")))
    twice = keyed.groupBy("tile_id").count().where("count > 1").head(1)
    if twice:
        raise ValueError(f"tile {twice[0][0]} twice")
    stage = scratch_path(spark, "archive")
    try:
        owners = keyed.groupBy("digest").agg(F.min("tile_id").alias("tile_id"))
        contents = own.join(owners, "tile_id").select("tile_id", "digest", "payload").repartitionByRange("tile_id").sortWithinPartitions("tile_id")

        def write_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            context, at, out = TaskContext.get(), 0, None
            name = f"{stage}/data-{context.partitionId():08d}"
            draft = f"{name}-{context.taskAttemptId()}"
            for batch in batches:
                out = out or ranged.created(draft)
                sizes = []
                for p in batch.column(2):
                    raw = compress(p.as_py(), compression)
                    out.write(raw)
                    sizes.append(len(raw))
                ends = at + np.cumsum(sizes)
                at = int(ends[-1]) if sizes else at
                yield pa.RecordBatch.from_arrays([pa.array([context.partitionId()] * len(sizes), pa.int32()), batch.column(1), pa.array(ends - sizes, pa.int64()), pa.array(sizes, pa.int32())], names=["part", "digest", "at", "length"])
            if out:
                out.close()
                ranged.moved(draft, name)  # a task run again writes the same bytes

        ranged.made(stage)
        contents.mapInArrow(write_part, "part int, digest string, at long, length int").write.parquet(f"{stage}/index")
        placed = spark.read.parquet(f"{stage}/index")
        sizes = {r[0]: r[1] for r in placed.groupBy("part").agg(F.max(F.col("at") + F.col("length"))).collect()}  # a row per task
        bases, total = [], 0
        for part in sorted(sizes):
            bases.append((part, total))
            total += sizes[part]
        starts = F.broadcast(spark.createDataFrame(bases, "part int, base long"))
        offsets = placed.join(starts, "part").select("digest", (F.col("base") + F.col("at")).alias("tile_offset"), F.col("length").alias("length_bytes"))
        each = numbered(keyed.join(offsets, "digest").drop("digest"), ["tile_offset", "length_bytes"], "tile_id", [], "n")
        runs = each.groupBy("tile_offset", "length_bytes", (F.col("tile_id") - F.col("n")).alias("run")).agg(F.min("tile_id").alias("tile_id"), F.count(F.lit(1)).cast("int").alias("run_length"))
        entries = cut(numbered(runs.drop("run"), [], "tile_id", [], "n", width=1 << 20))
        totals = entries.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("run_length"), F.lit(0)).alias("addressed"), F.min("tile_id").alias("low"), F.max(F.col("tile_id") + F.col("run_length") - 1).alias("high")).first()
        size = leaf_entries if totals["n"] > leaf_entries else max(1, totals["n"])
        rows = entries.groupBy(F.floor((F.col("n") - 1) / size).alias("leaf")).agg(F.array_sort(F.collect_list(F.struct("tile_id", "tile_offset", "length_bytes", "run_length"))).alias("e"))

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lists = [[tuple(e.values()) for e in own] for own in batch.column(1).to_pylist()]
                coded = [compress(directory_bytes(own), internal) for own in lists]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own[0][0] for own in lists], pa.int64()), pa.array(coded, pa.binary())], names=["leaf", "first", "directory"])

        coded = rows.mapInArrow(encode, "leaf long, first long, directory binary")
        root, at, root_raw = [], 0, compress(directory_bytes([]), internal)
        with ranged.created(f"{stage}/leaves") as out:
            for r in coded.orderBy("leaf").toLocalIterator():
                if totals["n"] <= leaf_entries:
                    root_raw = bytes(r["directory"])
                else:
                    out.write(bytes(r["directory"]))
                    root.append((r["first"], at, len(r["directory"]), 0))
                    at += len(r["directory"])
        root_raw = compress(directory_bytes(root), internal) if root else root_raw
        meta_raw = compress(metadata.encode(), internal)
        zooms = tile_arrays(np.array([totals["low"] or 0, totals["high"] or 0], np.int64))[0].tolist()
        before = SIZE + len(root_raw) + len(meta_raw)
        h = {"min_lon_e7": -1800000000, "max_lon_e7": 1800000000, "min_lat_e7": -850000000, "max_lat_e7": 850000000, "min_zoom": zooms[0], "max_zoom": zooms[1]} | header | {
            "root_dir_offset": SIZE, "root_dir_bytes": len(root_raw), "json_metadata_offset": SIZE + len(root_raw), "json_metadata_bytes": len(meta_raw),
            "leaf_dirs_offset": before, "leaf_dirs_bytes": at, "tile_data_offset": before + at, "tile_data_bytes": total,
            "addressed_tiles_count": totals["addressed"], "tile_entries_count": totals["n"], "tile_contents_count": placed.count(), "clustered": 1,
            "internal_compression": internal, "tile_compression": compression, "tile_type": tile_type,
        }
        with ranged.created(path) as out:
            out.write(header_bytes(h) + root_raw + meta_raw)
            for name in (f"{stage}/leaves", *(f"{stage}/data-{p:08d}" for p, _ in bases)):
                with ranged.opened(name) as f:
                    while block := f.read(1 << 22):
                        out.write(block)
    finally:
        files.delete(spark, stage)
    return h


def metadata_of(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The archive's metadata parsed by a schema (a DDL struct); blank text gives no row, text that is no JSON object raises."""
    text = read(spark, path, "metadata").where(F.trim("json") != "")
    doc = F.from_json("json", schema, {"mode": "FAILFAST"})
    return text.select(doc.alias("m")).select("m.*")


def described(header: DataFrame) -> DataFrame:
    """Header rows with degrees, names of codes and the mime type."""
    names = lambda c, m: F.element_at(F.create_map(*[F.lit(v) for kv in m.items() for v in kv]), F.col(c))
    kind = names("tile_type", TILE_TYPES)
    degrees = {k.replace("_e7", ""): F.col(k) / 1e7 for k in HEADER_FIELDS if k.endswith("_e7")}
    mime = F.element_at(F.create_map(*[F.lit(v) for kv in MIME_TYPES.items() for v in kv]), kind)
    return header.withColumns(degrees | {"tile_kind": kind, "compression": names("tile_compression", COMPRESSIONS), "mime_type": mime, "is_raster": kind.isin(*RASTER_TYPES)})
