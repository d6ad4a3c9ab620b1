"""TileJSON documents (version 3) as rows, with their checks, and source settings."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.functions.names import present_name

SCHEMA = (
    "struct<tilejson:string,tiles:array<string>,vector_layers:array<struct<id:string,fields:map<string,string>,description:string,minzoom:int,maxzoom:int>>,attribution:string,bounds:array<double>,"
    "center:array<double>,data:array<string>,description:string,fillzoom:int,grids:array<string>,legend:string,maxzoom:int,minzoom:int,name:string,scheme:string,template:string,version:string>"
)


def parse(documents: DataFrame, text: str = "json") -> DataFrame:
    """The other columns with ``doc``, of SCHEMA; keys beyond it are ignored, text that is no JSON gives null."""
    return documents.select(*[c for c in documents.columns if c != text], F.from_json(text, SCHEMA).alias("doc"))


def problems(doc: Column) -> Column:
    """Array of what is wrong with a document: required parts, order of zooms, bounds and center."""
    b, c = doc["bounds"], doc["center"]
    at = lambda a, i: F.get(a, F.lit(i))
    low, high = F.coalesce(doc["minzoom"], F.lit(0)), F.coalesce(doc["maxzoom"], F.lit(30))
    checks = [
        (doc.isNull(), "no JSON object"), (doc["tilejson"].isNull(), "tilejson is missing"), (F.coalesce(F.size(doc["tiles"]), F.lit(0)) <= 0, "tiles is missing"),
        (doc["vector_layers"].isNotNull() & F.exists(doc["vector_layers"], lambda l: l["id"].isNull()), "a layer has no id"),
        (~low.between(0, 30) | ~high.between(0, 30), "zooms go from 0 to 30"), (low > high, "minzoom is above maxzoom"), (b.isNotNull() & (F.size(b) != 4), "bounds has four numbers"),
        ((at(b, 0) > at(b, 2)) | (at(b, 1) > at(b, 3)), "bounds are reversed"), (c.isNotNull() & (F.size(c) != 3), "center has three numbers"),
        (doc["scheme"].isNotNull() & ~doc["scheme"].isin("xyz", "tms"), "scheme is xyz or tms"),
    ]
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), text) for bad, text in checks]))


def write(df: DataFrame, text: str = "json") -> DataFrame:
    """The other columns with the document as text; null parts are left out."""
    return df.select(*[c for c in df.columns if c != "doc"], F.to_json("doc").alias(text))


def with_value(doc: Column, name: str, value: Column) -> Column:
    """A copy of a document (or layer) with another value."""
    return doc.withField(name, value)


def each_layer(layers: Column, change: Callable[[Column], Column]) -> Column:
    """The layers with a change made to each; null layers stay null."""
    return F.transform(layers, lambda l: F.when(l.isNotNull(), change(l)))


def layer_of(layers: Column, id: Column | str) -> Column:
    """The first layer of an id; null if there is none."""
    wanted = F.lit(id) if isinstance(id, str) else id
    return F.get(F.filter(layers, lambda l: l["id"] == wanted), F.lit(0))


def settings(given: Mapping[str, object], known: Mapping[str, type], old_prefix: str = "") -> dict[str, object]:
    """Settings under their present names and converted to their types; unknown names and unusable values raise."""
    out: dict[str, object] = {}
    for name, value in given.items():
        plain = present_name(name, old_prefix)
        if plain not in known:
            raise ValueError(f"no setting {name!r}")
        kind = known[plain]
        text = str(value).strip()
        if kind is bool:
            if text.lower() not in ("true", "false"):
                raise ValueError(f"{name} is true or false")
            out[plain] = text.lower() == "true"
        else:
            out[plain] = kind(text)
    return out
