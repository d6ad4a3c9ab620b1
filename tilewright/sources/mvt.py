"""Vector tiles: bytes to feature rows and back."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tilewright.functions.geometry import KINDS, clip, decode as decode_commands, described, encode as encode_commands, kind_of, prepare, wkb, wkt
from tilewright.sources.wire import field, fields, packed, varints

FEATURES = "layer string, extent int, mvt_version int, feature_id long, geom_type string, tags array<int>, commands array<int>, attributes map<string,string>"
#: Wire numbers of the kinds of values, in the order in which a value is looked for.
STRING, FLOAT, DOUBLE, INT, UINT, SINT, BOOL = range(1, 8)
KINDS_OF_VALUE = ("string", "float", "double", "int", "uint", "sint", "bool")
#: A value with its kind: the one field that isn't null.
VALUE = "struct<string_value:string,float_value:float,double_value:double,int_value:bigint,uint_value:bigint,sint_value:bigint,bool_value:boolean>"
TYPES = {"UNKNOWN": 0, "POINT": 1, "LINESTRING": 2, "POLYGON": 3}


def _signed(n: int, bits: int = 64) -> int:
    return n - (1 << bits) if n >> (bits - 1) else n


def value_of(data: bytes) -> str | float | int | bool | None:
    """Floats stay 32-bit values, all whole numbers become 64-bit ones; unsigned ones wrap above 2^63-1."""
    for n, _, v in fields(data):
        if n == STRING:
            return v.decode("utf-8", "replace")
        if n == FLOAT:
            return struct.unpack("<f", v)[0]
        if n == DOUBLE:
            return struct.unpack("<d", v)[0]
        if n in (INT, UINT):
            return _signed(v)
        if n == SINT:
            return (v >> 1) ^ -(v & 1)
        if n == BOOL:
            return bool(v)
    return None


def kind_bytes(kind: str, v: object) -> bytes:
    """A value of one of the kinds of VALUE."""
    if kind == "string":
        return field(STRING, v)
    if kind == "float":
        return bytes([FLOAT << 3 | 5]) + struct.pack("<f", v)
    if kind == "double":
        return bytes([DOUBLE << 3 | 1]) + struct.pack("<d", v)
    if kind == "sint":
        return field(SINT, (v << 1) ^ (v >> 63))
    if kind == "bool":
        return field(BOOL, int(v))
    return field(INT if kind == "int" else UINT, v)


def value_bytes(v: object) -> bytes:
    """Structs of VALUE as their kind; whole numbers as sint, numpy's 32-bit floats as float, other floats as double; all
    but text and truth values else as their text (decimals, too)."""
    if isinstance(v, str):
        return kind_bytes("string", v)
    if isinstance(v, dict):
        kind, own = next(((k, v[f"{k}_value"]) for k in KINDS_OF_VALUE if v.get(f"{k}_value") is not None), ("string", ""))
        return kind_bytes(kind, own)
    if isinstance(v, (bool, np.bool_)):
        return kind_bytes("bool", v)
    if isinstance(v, (int, np.integer)):
        return kind_bytes("sint", int(v))
    if isinstance(v, np.float32):
        return kind_bytes("float", float(v))
    if isinstance(v, (float, np.floating)):
        return kind_bytes("double", float(v))
    return kind_bytes("string", str(v))


def kind_of_value(data: bytes) -> dict | None:
    """A value as a struct of VALUE; None where no kind is set."""
    for n, _, v in fields(data):
        if STRING <= n <= BOOL:
            own = v.decode("utf-8", "replace") if n == STRING else struct.unpack("<f", v)[0] if n == FLOAT else struct.unpack("<d", v)[0] if n == DOUBLE else (v >> 1) ^ -(v & 1) if n == SINT else bool(v) if n == BOOL else _signed(v)
            return {f"{KINDS_OF_VALUE[n - 1]}_value": own}
    return None


def decode_tile(data: bytes, layers: Sequence[str] | None = None, read_value: Callable[[bytes], object] = value_of) -> list[dict]:
    """Layers of a tile with their features; layers that aren't asked for are skipped unread."""
    out = []
    for n, _, raw in fields(data):
        if n != 3:
            continue
        layer: dict = {"name": None, "extent": 4096, "version": 1, "keys": [], "values": [], "features": []}
        parts = list(fields(raw))
        layer["name"] = next((v.decode("utf-8", "replace") for k, _, v in parts if k == 1), None)
        if layers is not None and layer["name"] not in layers:
            continue
        for k, _, v in parts:
            if k == 3:
                layer["keys"].append(v.decode("utf-8", "replace"))
            elif k == 4:
                layer["values"].append(read_value(v))
            elif k == 5:
                layer["extent"] = v
            elif k == 15:
                layer["version"] = v
            elif k == 2:
                f = {"id": None, "tags": [], "type": 0, "commands": []}
                for m, _, w in fields(v):
                    if m == 1:
                        f["id"] = _signed(w)
                    elif m == 2:
                        f["tags"] += packed(w)
                    elif m == 3:
                        f["type"] = w
                    elif m == 4:
                        f["commands"] += packed(w)
                layer["features"].append(f)
        out.append(layer)
    return out


class LayerWriter:
    """A layer that is being built, feature by feature. Dictionaries hold keys and values in order of first use; null
    attributes are left out."""

    def __init__(self, name: str, extent: int = 4096, version: int = 2):
        if not name:
            raise ValueError("a layer needs a name")
        self.name, self.extent, self.version = name, extent, version
        self.keys: dict[str, int] = {}
        self.values: dict[bytes, int] = {}
        self.features: list[bytes] = []

    def add(self, feature_id: int | None, kind: str | None, commands: Sequence[int], attributes: Sequence[tuple[str, object]]) -> None:
        tags: list[int] = []
        for k, v in attributes:
            if v is not None:
                tags += (self.keys.setdefault(k, len(self.keys)), self.values.setdefault(value_bytes(v), len(self.values)))
        made = field(1, feature_id) if feature_id is not None else b""
        if tags:
            made += field(2, varints(tags))
        made += field(3, TYPES.get(kind or "UNKNOWN", 0)) + field(4, varints(commands))
        self.features.append(field(2, made))

    def bytes(self) -> bytes:
        """The layer as a tile of one layer; tiles can be joined by joining bytes. No features, no bytes."""
        if not self.features:
            return b""
        parts = [field(1, self.name), *self.features, *(field(3, k) for k in self.keys), *(field(4, v) for v in self.values), field(5, self.extent), field(15, self.version)]
        return field(3, b"".join(parts))


def encode_layer(name: str, features: Sequence[dict], extent: int = 4096, version: int = 2) -> bytes:
    """A layer of features (id, type, commands, attributes) as the bytes of a tile of one layer."""
    layer = LayerWriter(name, extent, version)
    for f in features:
        layer.add(f.get("id"), f["type"], f["commands"], (f.get("attributes") or {}).items())
    return layer.bytes()


def decode(tiles: DataFrame, payload: str = "payload", layers: Sequence[str] | None = None, typed: bool = False) -> DataFrame:
    """The other columns of each tile with FEATURES, one row per feature. Null payloads give none; broken ones raise.
    ``typed`` gives attributes as structs of VALUE, which keep their kinds, instead of as text."""
    keep = [c for c in tiles.columns if c != payload]
    wanted = None if layers is None else set(layers)
    ddl = FEATURES.replace("map<string,string>", f"map<string,{VALUE}>") if typed else FEATURES
    schema = T.StructType([*tiles.select(*keep).schema, *T.StructType.fromDDL(ddl)])
    kinds = [to_arrow_type(f.dataType) for f in schema.fields[len(keep) :]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, data in enumerate(batch.column(len(keep)).to_pylist()):
                for layer in decode_tile(data, wanted, kind_of_value if typed else value_of) if data else []:
                    n_keys, n_values = len(layer["keys"]), len(layer["values"])
                    text = layer["values"] if typed else [None if v is None else str(v).lower() if isinstance(v, bool) else str(v) for v in layer["values"]]
                    for f in layer["features"]:
                        tags = f["tags"]
                        pairs = {layer["keys"][k]: text[v] for k, v in zip(tags[::2], tags[1::2]) if k < n_keys and v < n_values}
                        at.append(i)
                        rows.append((layer["name"], layer["extent"], layer["version"], f["id"], KINDS.get(f["type"]), signed_32(tags), signed_32(f["commands"]), list(pairs.items())))
            took = pa.array(at, pa.int64())
            cols = list(zip(*rows)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(took) for i in range(len(keep))), *(pa.array(list(c), k) for c, k in zip(cols, kinds))], names=schema.names)

    return tiles.select(*keep, payload).mapInArrow(run, schema)


def signed_32(numbers: list[int]) -> list[int]:
    return numbers if not numbers or max(numbers) < 1 << 31 else [_signed(n & 0xFFFFFFFF, 32) for n in numbers]


def encode(features: DataFrame, by: Sequence[str] = ("z", "x", "y"), order: str = "feature_id") -> DataFrame:
    """by, payload: tiles of features (layer, extent, feature_id, geom_type, commands, and attributes as a map to text or to
    structs of VALUE, whose kinds are kept).

    Features are brought together by tile and layer and written in their order as they stream past, in Arrow batches; a
    layer is one message whose dictionary numbers all its features, so it is written by one task, which holds its bytes
    but not its rows. Layers of a tile are built apart and joined as bytes, in order of their names. Features without
    layer, and tiles left without features, are dropped.
    """
    group = [*by, "layer"]
    cols = [*group, "extent", "feature_id", "geom_type", "commands", "attributes"]
    own = features.where(F.col("layer").isNotNull()).select(*cols, *([order] if order not in cols else []))
    schema = T.StructType([*own.select(*group).schema, T.StructField("part", T.BinaryType())])
    kinds = [to_arrow_type(f.dataType) for f in schema]
    n = len(group)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, layer, done, size = None, None, [], 0
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=schema.names)
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:n] != now:
                    if layer:
                        done.append((*now, layer.bytes()))
                        size += len(done[-1][-1])
                    now = row[:n]
                    layer = LayerWriter(now[-1], 4096 if row[n] is None else row[n])
                layer.add(row[n + 1], row[n + 2], row[n + 3] or (), row[n + 4] or ())
            if size > 1 << 24:
                yield made(done)
                done, size = [], 0
        if layer:
            done.append((*now, layer.bytes()))
        if done:
            yield made(done)

    parts = own.repartition(*group).sortWithinPartitions(*group, order).mapInArrow(build, schema)
    joined = F.aggregate(F.array_sort(F.collect_list(F.struct("layer", "part"))), F.lit(b""), lambda a, p: F.concat(a, p["part"]))
    return parts.where(F.octet_length("part") > 0).groupBy(*by).agg(joined.alias("payload"))


@F.pandas_udf(T.StringType())
def geometry_text(commands: pd.Series, kind: pd.Series) -> pd.Series:
    """Well-known text of command streams; null where there is no geometry type."""
    return pd.Series([None if c is None or k is None else wkt(k, decode_commands([int(n) & 0xFFFFFFFF for n in c], k)) for c, k in zip(commands, kind)])


_VERTEX = T.StructType([T.StructField("x", T.IntegerType()), T.StructField("y", T.IntegerType())])
GEOMETRY = T.StructType([T.StructField("kind", T.StringType()), T.StructField("parts", T.ArrayType(T.ArrayType(_VERTEX)))])
_PARTS = "array<array<struct<x:{0},y:{0}>>>"


def nested(parts: list[list[list[tuple]] | None], number: pa.DataType) -> pa.Array:
    """Lists of parts of (x, y) as an Arrow array, built from flat columns."""
    rows = [p or [] for p in parts]
    flat = [q for p in rows for part in p for q in part]
    x, y = (np.array([q[i] for q in flat], number.to_pandas_dtype()) for i in (0, 1))
    points = pa.StructArray.from_arrays([pa.array(x, number), pa.array(y, number)], names=["x", "y"])
    inner = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(part) for p in rows for part in p)]), pa.int32()), points)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), inner, mask=pa.array([p is None for p in parts], pa.bool_()))


def unsigned(commands: pa.Array) -> list[list[int] | None]:
    return [None if c is None else c if not c or min(c) >= 0 else [n & 0xFFFFFFFF for n in c] for c in commands.to_pylist()]


@F.arrow_udf(GEOMETRY)
def geometry_parts(commands: pa.Array, kind: pa.Array) -> pa.Array:
    """Kind and parts of command streams of any kind; a missing kind is told from the stream. Null streams give null,
    broken ones raise."""
    streams = unsigned(commands)
    kinds = [None if c is None else kind_of(c, k) for c, k in zip(streams, kind.to_pylist())]
    parts = [None if c is None else decode_commands(c, k) for c, k in zip(streams, kinds)]
    nulls = pa.array([p is None for p in parts], pa.bool_())
    return pa.StructArray.from_arrays([pa.array(kinds, pa.string()), nested(parts, pa.int32())], names=["kind", "parts"], mask=nulls)


def _points(parts: pa.Array) -> list[list[list[tuple]] | None]:
    return [None if p is None else [[(q["x"], q["y"]) for q in part] for part in p] for p in parts.to_pylist()]


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def geometry_commands(parts: pa.Array, kind: pa.Array) -> pa.Array:
    """Command streams of parts, snapped to whole pixels; null for null parts, empty where nothing is left."""
    made = [None if p is None else signed_32(encode_commands(k, p)) for p, k in zip(_points(parts), kind.to_pylist())]
    return pa.array(made, pa.list_(pa.int32()))


@F.arrow_udf(T.BinaryType())
def parts_wkb(parts: pa.Array, kind: pa.Array) -> pa.Array:
    """Parts as well-known binary; null for null parts."""
    return pa.array([None if p is None else wkb(k, p) for p, k in zip(_points(parts), kind.to_pylist())], pa.binary())


@F.arrow_udf(T.StringType())
def parts_wkt(parts: pa.Array, kind: pa.Array) -> pa.Array:
    return pa.array([None if p is None else wkt(k, p) for p, k in zip(_points(parts), kind.to_pylist())], pa.string())


def clipped(commands: Column, kind: Column, extent: int = 4096, buffer: int = 32) -> Column:
    """Kind and parts (as doubles, before any snapping) of what of a geometry lies in the tile and its buffer."""

    @F.arrow_udf(f"struct<kind:string,parts:{_PARTS.format('double')}>")
    def cut(commands: pa.Array, kind: pa.Array) -> pa.Array:
        streams = unsigned(commands)
        kinds = [None if c is None else kind_of(c, k) for c, k in zip(streams, kind.to_pylist())]
        parts = [None if c is None else clip(k, decode_commands(c, k), extent, buffer) for c, k in zip(streams, kinds)]
        nulls = pa.array([p is None for p in parts], pa.bool_())
        return pa.StructArray.from_arrays([pa.array(kinds, pa.string()), nested(parts, pa.float64())], names=["kind", "parts"], mask=nulls)

    return cut(commands, kind)


def prepared(commands: Column, kind: Column, extent: int = 4096, buffer: int = 32, tolerance: float = 0.0, min_length: float = 0.0, min_area: float = 0.0) -> Column:
    """Command streams as they go into a tile: small parts left out, simplified, clipped and snapped; empty where nothing is left."""

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def make(commands: pa.Array, kind: pa.Array) -> pa.Array:
        out = []
        for c, k in zip(unsigned(commands), kind.to_pylist()):
            own = None if c is None else kind_of(c, k)
            out.append(None if c is None else signed_32(prepare(own, decode_commands(c, own), extent, buffer, tolerance, min_length, min_area)))
        return pa.array(out, pa.list_(pa.int32()))

    return make(commands, kind)


@F.arrow_udf(T.StringType())
def commands_text(commands: pa.Array) -> pa.Array:
    """Command streams spelled out."""
    return pa.array([None if c is None else described(c) for c in unsigned(commands)], pa.string())
