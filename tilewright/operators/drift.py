"""Schemas that drift: what changed between versions, and one consistent table out of all of them."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilewright.operators.blocks import previous_number

#: The classes of declared types.
TYPE_CLASSES = {
    "string": "string", "text": "string", "str": "string",
    "number": "number", "double": "number", "int": "number", "integer": "number", "float": "number",
    "boolean": "boolean", "bool": "boolean",
}

#: A pair whose names agree in letters and digits outweighs any sum of pairs that don't.
EXACT = 1000.0
LIKELY = 0.55


def plain_name(name: str | None) -> str:
    """Letters and digits, without case."""
    return "".join(c for c in (name or "").lower() if c.isalnum())


def type_class(declared: str | None) -> str:
    own = (declared or "").strip().lower()
    return TYPE_CLASSES.get(own, own)


@dataclass(frozen=True)
class Profile:
    """What is known of a column: its name, its class of type, and min-hashes of its values where there are values."""

    name: str
    kind: str = ""
    sketch: tuple[int, ...] = field(default=())


def _pairs(s: str) -> set[str]:
    s = f"^{s}$"
    return {s[i : i + 2] for i in range(len(s) - 1)}


def similarity(a: Profile, b: Profile) -> float:
    """0 to 1 from bigrams of the names, classes of type and value sketches; EXACT where the plain names agree."""
    x, y = plain_name(a.name), plain_name(b.name)
    if x == y:
        return EXACT + (a.name == b.name)
    p, q = _pairs(x), _pairs(y)
    name = 2 * len(p & q) / (len(p) + len(q))
    kind = float(a.kind == b.kind)
    if a.sketch and b.sketch:
        same = sum(u == v for u, v in zip(a.sketch, b.sketch)) / min(len(a.sketch), len(b.sketch))
        return 0.35 * name + 0.15 * kind + 0.5 * same
    return 0.8 * name + 0.2 * kind


def assign(weights: Sequence[Sequence[float]]) -> list[int]:
    """Maximum-weight bipartite matching: the column of each row, or -1. Rows times columns stay small (one schema)."""
    n, m = len(weights), len(weights[0]) if weights else 0
    if not n or not m:
        return [-1] * n
    if n > m:
        back = assign([[weights[i][j] for i in range(n)] for j in range(m)])
        out = [-1] * n
        for j, i in enumerate(back):
            if i >= 0:
                out[i] = j
        return out
    # Shortest augmenting paths on the costs -w, one row at a time, with potentials.
    inf = float("inf")
    row_pot, col_pot, owner = [0.0] * n, [0.0] * m, [-1] * m
    for start in range(n):
        dist, via, closed = [inf] * m, [-1] * m, [False] * m
        row, last, base = start, -1, 0.0
        while True:
            best, pick = inf, -1
            for j in range(m):
                if closed[j]:
                    continue
                cost = base - weights[row][j] - row_pot[row] - col_pot[j]
                if cost < dist[j]:
                    dist[j], via[j] = cost, last
                if dist[j] < best:
                    best, pick = dist[j], j
            closed[pick] = True
            base, last = best, pick
            if owner[pick] < 0:
                break
            row = owner[pick]
        for j in range(m):
            if closed[j] and j != last:
                col_pot[j] += dist[j] - base
                row_pot[owner[j]] += base - dist[j]
        row_pot[start] += base
        while last >= 0:
            prior = via[last]
            owner[last] = owner[prior] if prior >= 0 else start
            last = prior
    out = [-1] * n
    for j, i in enumerate(owner):
        if i >= 0:
            out[i] = j
    return out


def match(old: Sequence[Profile], new: Sequence[Profile], least: float = LIKELY) -> list[tuple[int, int, float]]:
    """Pairs (old, new, similarity) of the best matching. Pairs with unique equal names are settled first: no matching
    of greater weight leaves them apart; the rest is solved exactly and pairs under ``least`` are dropped."""
    pairs, left_old, left_new = [], list(range(len(old))), list(range(len(new)))
    for exact in (lambda p: p.name, lambda p: plain_name(p.name)):
        where_old, where_new = {}, {}
        for i in left_old:
            where_old.setdefault(exact(old[i]), []).append(i)
        for j in left_new:
            where_new.setdefault(exact(new[j]), []).append(j)
        for k, i in where_old.items():
            if len(i) == 1 and len(where_new.get(k, ())) == 1:
                pairs.append((i[0], where_new[k][0], EXACT))
        left_old = [i for i in left_old if i not in {p[0] for p in pairs}]
        left_new = [j for j in left_new if j not in {p[1] for p in pairs}]
    if left_old and left_new:
        weights = [[similarity(old[i], new[j]) for j in left_new] for i in left_old]
        for a, b in enumerate(assign(weights)):
            if b >= 0 and weights[a][b] >= least:
                pairs.append((left_old[a], left_new[b], weights[a][b]))
    return sorted(pairs)


REPORT = "layer_id string, field_name string, change_kind string, old_name string, old_type string, new_type string, similarity double"


def layer_changes(old: list[dict], new: list[dict]) -> list[tuple]:
    """Rows of REPORT for two lists of layers. A removed field or layer that the matching takes for a rename under an
    unlike name keeps its kind; its row and that of the added one name each other in old_name, with their similarity."""
    out: list[tuple] = []
    fields = lambda layer: [Profile(k, type_class(v)) for k, v in (layer.get("fields") or {}).items()]
    named = lambda layers: [x for x in layers if x and x.get("id") is not None]
    old, new = named(old), named(new)
    a, b = [Profile(x["id"]) for x in old], [Profile(x["id"]) for x in new]
    pairs = match(a, b)
    likely = {}
    for i, j, s in pairs:
        if s < EXACT:
            likely[("o", i)], likely[("n", j)] = (b[j].name, s), (a[i].name, s)
            continue
        if a[i].name != b[j].name:
            out.append((b[j].name, "", "layer_renamed", a[i].name, None, None, 1.0))
        p, q = fields(old[i]), fields(new[j])
        types_old, types_new = old[i].get("fields") or {}, new[j].get("fields") or {}
        held = match(p, q)
        guess_old = {i2: (q[j2].name, s2) for i2, j2, s2 in held if s2 < EXACT}
        guess_new = {j2: (p[i2].name, s2) for i2, j2, s2 in held if s2 < EXACT}
        for i2, j2, s2 in held:
            if s2 < EXACT:
                continue
            x, y = p[i2], q[j2]
            row = (x.name, types_old[x.name], types_new[y.name], 1.0)
            if x.name != y.name:
                out.append((b[j].name, y.name, "renamed", *row))
            if x.kind != y.kind:
                out.append((b[j].name, y.name, "retyped", *row))
        same_old, same_new = {i2 for i2, _, s2 in held if s2 >= EXACT}, {j2 for _, j2, s2 in held if s2 >= EXACT}
        for k, x in enumerate(p):
            if k not in same_old:
                g = guess_old.get(k, (None, None))
                out.append((b[j].name, x.name, "removed", g[0], types_old[x.name], None, g[1]))
        for k, y in enumerate(q):
            if k not in same_new:
                g = guess_new.get(k, (None, None))
                out.append((b[j].name, y.name, "added", g[0], None, types_new[y.name], g[1]))
    kept_old, kept_new = {i for i, _, s in pairs if s >= EXACT}, {j for _, j, s in pairs if s >= EXACT}
    for i, x in enumerate(a):
        if i not in kept_old:
            out.append((x.name, "", "layer_removed", *(likely.get(("o", i), (None,))[:1]), None, None, likely.get(("o", i), (None, None))[1]))
    for j, y in enumerate(b):
        if j not in kept_new:
            out.append((y.name, "", "layer_added", *(likely.get(("n", j), (None,))[:1]), None, None, likely.get(("n", j), (None, None))[1]))
    return out


def current_builds(metadata: DataFrame) -> DataFrame:
    """tileset, build_no, layers: of each build the delivery received last, if its vector_layers isn't null.

    Ties in received_at go to the greater archive_id. Rows without tileset or build_no don't count.
    """
    rows = metadata.where(F.col("tileset").isNotNull() & F.col("build_no").isNotNull())
    last = rows.groupBy("tileset", "build_no").agg(F.max_by("vector_layers", F.struct("received_at", "archive_id")).alias("layers"))
    return last.where(F.col("layers").isNotNull())


def build_changes(metadata: DataFrame) -> DataFrame:
    """tileset, build_no and REPORT: each build against the tileset's build before it.

    Only build numbers go through windows (in blocks, so a tileset may hold any share of the builds); the layers of a
    build meet those of the one before by an equi-join on tileset and number, and one Arrow pass matches each pair.
    """
    builds = current_builds(metadata)
    # null fields stay out of the text; a null entry of the list stays in it and is skipped
    texts = builds.select("tileset", "build_no", F.to_json("layers").alias("layers"))
    numbers = previous_number(builds, ["tileset"], "build_no").where(F.col("previous").isNotNull())
    old = texts.select("tileset", F.col("build_no").alias("previous"), F.col("layers").alias("old_layers"))
    pairs = texts.join(numbers, ["tileset", "build_no"]).join(old, ["tileset", "previous"]).select("tileset", "build_no", "old_layers", "layers")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["tileset", "build_no", *[c.split()[0] for c in REPORT.split(", ")]]
        for batch in batches:
            rows = [(t, n, *r) for t, n, o, l in batch.itertuples(index=False) if o != l for r in layer_changes(json.loads(o), json.loads(l))]
            yield pd.DataFrame(rows, columns=names)

    return pairs.mapInPandas(compare, f"tileset string, build_no int, {REPORT}")


def likely_renames(metadata: DataFrame, least: float = LIKELY) -> DataFrame:
    """tileset, build_no, layer_id, field_name, old_name, similarity: fields (field_name '' for layers) that went under one
    name while another came, and that the best matching of all such pairs of a layer puts together at ``least`` or more.

    The report of build_changes names them added and removed, as their names differ in letters; here they are one thing.
    """
    changes = build_changes(metadata).where(F.col("change_kind").isin("added", "layer_added") & (F.col("similarity") >= least))
    layer = F.when(F.col("change_kind") == "layer_added", F.col("old_name"))
    return changes.select("tileset", "build_no", "layer_id", "field_name", F.coalesce(layer, "old_name").alias("old_name"), F.round("similarity", 6).alias("similarity")).distinct()


def consistent_layers(metadata: DataFrame) -> DataFrame:
    """One row per tileset, layer and field over all builds: the latest spelling, one type, first and last build, builds.

    The type is the class that all builds agree on, else string, to which every class can be cast.
    """
    plain = lambda c: F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")
    layers = current_builds(metadata).select("tileset", "build_no", F.explode("layers").alias("l")).where(F.col("l.id").isNotNull())
    rows = layers.select("tileset", "build_no", F.col("l.id").alias("layer_id"), F.explode("l.fields").alias("field_name", "declared"))
    own = F.lower(F.trim(F.col("declared")))
    pairs = F.create_map(*[F.lit(x) for kv in TYPE_CLASSES.items() for x in kv])
    rows = rows.withColumn("kind", F.coalesce(pairs[own], own, F.lit("")))
    found = rows.groupBy("tileset", plain(F.col("layer_id")).alias("layer_key"), plain(F.col("field_name")).alias("field_key")).agg(
        F.max(F.struct("build_no", "layer_id", "field_name")).alias("s"), F.min("kind").alias("low"), F.max("kind").alias("high"),
        F.min("build_no").alias("first_build"), F.max("build_no").alias("last_build"), F.count_distinct("build_no").alias("n_builds"),
    )
    kind: Column = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise("string")
    return found.select("tileset", "layer_key", "field_key", "s.layer_id", "s.field_name", kind.alias("field_type"), "first_build", "last_build", "n_builds")


def profile(df: DataFrame, hashes: int = 16) -> list[Profile]:
    """Profiles of a table's columns: ``hashes`` minima of seeded value hashes each, in one aggregate without a shuffle of rows."""
    made = [F.min(F.xxhash64(F.lit(k), F.col(f"`{c}`").cast("string"))).alias(f"{i}_{k}") for i, (c, t) in enumerate(df.dtypes) if _plain(t) for k in range(hashes)]
    row = df.agg(*made).first() if made else {}
    out = []
    for i, (c, t) in enumerate(df.dtypes):
        sketch = tuple(row[f"{i}_{k}"] for k in range(hashes)) if _plain(t) else ()
        out.append(Profile(c, _class_of(t), sketch))
    return out


def _plain(dtype: str) -> bool:
    return not dtype.startswith(("map", "array", "struct", "variant"))


def _class_of(dtype: str) -> str:
    if dtype in ("tinyint", "smallint", "int", "bigint", "float", "double") or dtype.startswith("decimal"):
        return "number"
    return dtype


def schema_versions(spark: SparkSession, root: str) -> list[tuple[str, DataFrame]]:
    """The Parquet files below root by the schema of their footers, oldest first: one DataFrame for each distinct schema,
    not for each file. Footers are read by tasks; the driver gets a row per schema, with the names of its files, which a
    scan needs there anyway. Versions are named v1, v2 and so on."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(root).select("path", "modificationTime")

    def footers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"path": batch["path"], "at": batch["modificationTime"], "footer": [footer_schema(p) for p in batch["path"]]})

    read = listed.mapInPandas(footers, "path string, at timestamp, footer string")
    groups = read.groupBy("footer").agg(F.min("at").alias("at"), F.collect_list("path").alias("paths")).orderBy("at", "footer").collect()
    frames = [spark.read.schema(T.StructType.fromJson(json.loads(g["footer"]))).parquet(*sorted(g["paths"])) for g in groups]
    return [(f"v{n + 1}", df) for n, df in enumerate(frames)]


def footer_schema(path: str) -> str:
    """A Parquet file's schema as JSON, with fields that may be null, from its footer alone."""
    import pyarrow.parquet as pq
    from pyspark.sql.pandas.types import from_arrow_schema

    from tilewright.sources.bytes import opened

    with opened(path) as f:
        found = pq.read_schema(f)
    own = (found.metadata or {}).get(b"org.apache.spark.sql.parquet.row.metadata")
    schema = T.StructType.fromJson(json.loads(own)) if own else from_arrow_schema(found)
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema]).json()


def unify(tables: Sequence[tuple[str, DataFrame]], least: float = LIKELY) -> tuple[DataFrame, list[tuple[str, str, str, str]]]:
    """All versions as one table with the latest names, and the changes (version, column, kind, other).

    Each version is matched with the one before: names, types and value sketches give the weights, the best bipartite
    matching the renames. Number columns of different width become double, other mixtures string; columns that a
    version lacks are null. Columns named alike but for case are kept apart by a numbered suffix.
    """
    spine: list[dict] = []  # of each unified column: its name now, its type, its name in each version
    report: list[tuple[str, str, str, str]] = []
    before: list[Profile] = []
    for at, (label, df) in enumerate(tables):
        now = profile(df)
        types = dict(df.dtypes)
        held = {j: i for i, j, _ in match(before, now, least)} if at else {}
        alive = [c for c in spine if c["alive"]]
        for i, c in enumerate(alive):
            if at and i not in held.values():
                c["alive"] = False
                report.append((label, c["name"], "removed", ""))
        order: list[dict] = []
        for j, p in enumerate(now):
            if j in held:
                c = alive[held[j]]
                if c["name"] != p.name:
                    report.append((label, p.name, "renamed", c["name"]))
                if c["last"] != types[p.name]:
                    report.append((label, p.name, "retyped", c["last"]))
            else:
                back = next((c for c in spine if not c["alive"] and plain_name(c["name"]) == plain_name(p.name)), None)
                c = back or {"types": set(), "in": {}}
                if not back:
                    spine.append(c)
                if at:
                    report.append((label, p.name, "added", ""))
            c |= {"name": p.name, "last": types[p.name], "alive": True}
            c["types"].add(types[p.name])
            c["in"][at] = p.name
            order.append(c)
        before = now
        spine = order + [c for c in spine if not c["alive"]]
    taken: dict[str, int] = {}
    for c in spine:
        n = taken[c["name"].lower()] = taken.get(c["name"].lower(), 0) + 1
        c["as"] = c["name"] if n == 1 else f"{c['name']}_{n}"
        kinds = c["types"]
        c["type"] = next(iter(kinds)) if len(kinds) == 1 else "double" if {_class_of(t) for t in kinds} == {"number"} else "string"
    out = None
    for at, (label, df) in enumerate(tables):
        cols = [(F.col(f"`{c['in'][at]}`") if at in c["in"] else F.lit(None)).cast(c["type"]).alias(c["as"]) for c in spine]
        part = df.select(F.lit(label).alias("schema_version"), *cols)
        out = part if out is None else out.unionAll(part)
    return out, report
