"""Geometry of vector tiles: command streams, parts, clipping, snapping, simplifying. Plain lists of (x, y).

A geometry is (kind, parts): kind POINT, LINESTRING or POLYGON; a part of a polygon is a ring without its closing point,
and an outer ring is followed by its holes.
"""

from __future__ import annotations

import struct
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

MOVE, LINE, CLOSE = 1, 2, 7
#: Pairs of edges that are compared at a time; only memory depends on it.
PAIRS = 1 << 18
Ring = list[tuple[float, float]]
KINDS = {1: "POINT", 2: "LINESTRING", 3: "POLYGON"}


def zigzag(n: int) -> int:
    return (n << 1) ^ (n >> 31)


def unzigzag(n: int) -> int:
    return (n >> 1) ^ -(n & 1)


def area2(ring: Sequence[tuple[float, float]]) -> float:
    """Twice the signed area."""
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, [*ring[1:], ring[0]])) if ring else 0


def decode(commands: Sequence[int], kind: str) -> list[list[tuple[int, int]]]:
    """Parts of a command stream. Every part must start with a MoveTo; unknown or cut commands raise; lines of fewer
    than two points and rings of fewer than three or without area are dropped."""
    parts: list[list[tuple[int, int]]] = []
    x = y = i = 0
    while i < len(commands):
        op, n = commands[i] & 7, commands[i] >> 3
        i += 1
        if op == CLOSE:
            continue
        if op not in (MOVE, LINE) or (op == LINE and not parts):
            raise ValueError(f"command {op} where none such may be")
        if i + 2 * n > len(commands):
            raise ValueError("the command stream ends too early")
        for _ in range(n):
            x, y = x + unzigzag(commands[i]), y + unzigzag(commands[i + 1])
            i += 2
            if op == MOVE:
                parts.append([(x, y)])
            else:
                parts[-1].append((x, y))
    if kind == "LINESTRING":
        return [p for p in parts if len(p) > 1]
    if kind == "POLYGON":
        return [p for p in parts if len(p) > 2 and area2(p)]
    return parts


def kind_of(commands: Sequence[int], kind: str | None) -> str:
    """The given kind; one that is missing or unknown is told from the commands: closed, drawn or only moved."""
    if kind in KINDS.values():
        return kind
    i, ops = 0, set()
    while i < len(commands):
        op = commands[i] & 7
        ops.add(op)
        i += 1 if op == CLOSE else 1 + 2 * (commands[i] >> 3)
    return KINDS[3] if CLOSE in ops else KINDS[2] if LINE in ops else KINDS[1]


def polygons(rings: Sequence[Ring]) -> list[list[Ring]]:
    """Rings as polygons: one that winds like the first begins a polygon, others are holes of the last."""
    out: list[list[Ring]] = []
    for r in rings:
        if not out or (area2(r) > 0) == (area2(rings[0]) > 0):
            out.append([r])
        else:
            out[-1].append(r)
    return out


def snap(part: Sequence[tuple[float, float]]) -> list[tuple[int, int]]:
    """On the integer grid (halves up), without repeated points."""
    out: list[tuple[int, int]] = []
    for x, y in part:
        p = (int((x + 0.5) // 1), int((y + 0.5) // 1))
        if not out or out[-1] != p:
            out.append(p)
    return out


def encode(kind: str, parts: Sequence[Ring]) -> list[int]:
    """Command stream of the snapped parts; collapsed ones are left out. Points share one MoveTo; outer rings are wound
    clockwise on the screen (positive area, y down), holes the other way."""
    out: list[int] = []
    cursor = (0, 0)

    def put(op: int, points: Sequence[tuple[int, int]]) -> None:
        nonlocal cursor
        if points:
            out.append(len(points) << 3 | op)
        for p in points:
            out.extend((zigzag(p[0] - cursor[0]), zigzag(p[1] - cursor[1])))
            cursor = p

    if kind == "POINT":
        put(MOVE, [(int((x + 0.5) // 1), int((y + 0.5) // 1)) for p in parts for x, y in p])
        return out
    first = None
    for part in parts:
        p = snap(part)
        if kind == "POLYGON":
            if len(p) > 1 and p[0] == p[-1]:
                p.pop()
            a = area2(p)
            if len(p) < 3 or not a:
                continue
            first = first if first is not None else area2(part)
            outer = (area2(part) > 0) == (first > 0)
            if (a > 0) != outer:
                p = [p[0], *p[:0:-1]]
        elif len(p) < 2:
            continue
        put(MOVE, p[:1])
        put(LINE, p[1:])
        if kind == "POLYGON":
            out.append(1 << 3 | CLOSE)
    return out


def clip_line(line: Ring, low: float, high: float) -> list[Ring]:
    """The pieces of a line inside the square low..high."""
    out: list[Ring] = []
    for (x0, y0), (x1, y1) in zip(line, line[1:]):
        t0, t1, dx, dy = 0.0, 1.0, x1 - x0, y1 - y0
        for d, near in ((-dx, x0 - low), (dx, high - x0), (-dy, y0 - low), (dy, high - y0)):
            if d == 0:
                if near < 0:
                    t1 = -1.0
            elif d < 0:
                t0 = max(t0, near / d)
            else:
                t1 = min(t1, near / d)
        if t0 <= t1:
            a, b = (x0 + t0 * dx, y0 + t0 * dy), (x0 + t1 * dx, y0 + t1 * dy)
            if out and out[-1][-1] == a:
                out[-1].append(b)
            else:
                out.append([a, b])
    return out


def clip_ring(ring: Ring, low: float, high: float) -> Ring:
    """The ring cut by the four sides of the square, one after another."""
    for axis, bound, keep_above in ((0, low, True), (0, high, False), (1, low, True), (1, high, False)):
        out: Ring = []
        for a, b in zip([ring[-1], *ring[:-1]] if ring else [], ring):
            ina, inb = ((p[axis] >= bound) if keep_above else (p[axis] <= bound) for p in (a, b))
            if ina != inb:
                t = (bound - a[axis]) / (b[axis] - a[axis])
                cut = (a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1]))
                out.append((bound, cut[1]) if axis == 0 else (cut[0], bound))
            if inb:
                out.append(b)
        ring = out
    return ring


def clip(kind: str, parts: Sequence[Ring], extent: int = 4096, buffer: int = 32) -> list[Ring]:
    low, high = -buffer, extent + buffer
    if kind == "POINT":
        return [kept for p in parts if (kept := [q for q in p if low <= q[0] <= high and low <= q[1] <= high])]
    if kind == "LINESTRING":
        return [piece for p in parts for piece in clip_line(p, low, high)]
    return [r for p in parts if len(r := clip_ring(list(p), low, high)) > 2]


def simplify(part: Ring, tolerance: float) -> Ring:
    """Douglas and Peucker's, without recursion. Off for tolerances of 0 or less."""
    if tolerance <= 0 or len(part) < 3:
        return list(part)
    keep, todo = {0, len(part) - 1}, [(0, len(part) - 1)]
    while todo:
        a, b = todo.pop()
        (x0, y0), (x1, y1) = part[a], part[b]
        size = ((x1 - x0) ** 2 + (y1 - y0) ** 2) ** 0.5
        far, at = 0.0, -1
        for i in range(a + 1, b):
            x, y = part[i]
            d = abs((x1 - x0) * (y0 - y) - (x0 - x) * (y1 - y0)) / size if size else ((x - x0) ** 2 + (y - y0) ** 2) ** 0.5
            if d > far:
                far, at = d, i
        if far > tolerance:
            keep.add(at)
            todo += [(a, at), (at, b)]
    return [part[i] for i in sorted(keep)]


def crosses_itself(ring: Ring) -> bool:
    """Whether two edges of a ring that aren't neighbours meet, or a point comes twice."""
    n = len(ring)
    if len(set(ring)) < n:
        return True
    p = np.array(ring, float)
    q = np.roll(p, -1, axis=0)
    turn = lambda a, b, c: np.sign((b[..., 0] - a[..., 0]) * (c[..., 1] - a[..., 1]) - (b[..., 1] - a[..., 1]) * (c[..., 0] - a[..., 0]))
    on = lambda o, u, v, w: (o == 0) & (np.minimum(u, v) <= w).all(axis=-1) & (w <= np.maximum(u, v)).all(axis=-1)
    step = max(1, PAIRS // n)
    for at in range(0, n - 2, step):  # so many edges at a time against all later ones
        i, j = np.triu_indices(min(step, n - 2 - at), at + 2, n)
        i = i + at
        apart = (i > 0) | (j < n - 1)  # the last edge is the first one's neighbour
        a, b, c, d = p[i[apart]], q[i[apart]], p[j[apart]], q[j[apart]]
        o1, o2, o3, o4 = turn(a, b, c), turn(a, b, d), turn(c, d, a), turn(c, d, b)
        if ((o1 * o2 < 0) & (o3 * o4 < 0)).any() or (on(o1, a, b, c) | on(o2, a, b, d) | on(o3, c, d, a) | on(o4, c, d, b)).any():
            return True
    return False


def simplify_ring(ring: Ring, tolerance: float) -> Ring:
    """A ring simplified so that it stays one: where the result crosses itself, twice the tolerance is tried, and where
    nothing is left of it or that crosses itself, too, ever finer ones down to the ring itself."""
    if tolerance <= 0:
        return list(ring)
    sound = lambda r: len(r) > 2 and area2(r) != 0 and not crosses_itself(r)
    at = lambda t: simplify([*ring, ring[0]], t)[:-1]
    first = at(tolerance)
    if sound(first):
        return first
    if len(first) > 2 and area2(first) and sound(coarse := at(2 * tolerance)):
        return coarse
    for k in range(1, 12):
        if sound(fine := at(tolerance / 2**k)):
            return fine
    return list(ring)


def prepare(kind: str, parts: Sequence[Ring], extent: int = 4096, buffer: int = 32, tolerance: float = 0.0, min_length: float = 0.0, min_area: float = 0.0) -> list[int]:
    """Commands of a geometry in tile pixels: small ones left out, simplified (points aren't), clipped, snapped; empty
    where nothing is left."""
    done = []
    for p in parts:
        if kind == "POLYGON":
            if abs(area2(p)) / 2 >= min_area:
                done.append(simplify_ring(p, tolerance))
        elif kind == "LINESTRING":
            if sum(((b[0] - a[0]) ** 2 + (b[1] - a[1]) ** 2) ** 0.5 for a, b in zip(p, p[1:])) >= min_length:
                done.append(simplify(list(p), tolerance))
        else:
            done.append(list(p))
    return encode(kind, clip(kind, done, extent, buffer))


def wkt(kind: str, parts: Sequence[Ring]) -> str:
    pts = lambda p: ", ".join(f"{x:g} {y:g}" for x, y in p)
    if not parts:
        return f"{kind} EMPTY"
    if kind == "POINT":
        flat = [q for p in parts for q in p]
        return f"POINT ({pts(flat)})" if len(flat) == 1 else "MULTIPOINT (" + ", ".join(f"({x:g} {y:g})" for x, y in flat) + ")"
    if kind == "LINESTRING":
        return f"LINESTRING ({pts(parts[0])})" if len(parts) == 1 else "MULTILINESTRING (" + ", ".join(f"({pts(p)})" for p in parts) + ")"
    shapes = ["(" + ", ".join(f"({pts([*r, r[0]])})" for r in poly) + ")" for poly in polygons(parts)]
    return f"POLYGON {shapes[0]}" if len(shapes) == 1 else f"MULTIPOLYGON ({', '.join(shapes)})"


def wkb(kind: str, parts: Sequence[Ring]) -> bytes:
    """Well-known binary, little-endian, of the same geometry as wkt gives."""
    head = lambda code, n: struct.pack("<BII", 1, code, n)
    coords = lambda p: struct.pack(f"<{2 * len(p)}d", *(v for q in p for v in q))
    if kind == "POINT":
        each = [struct.pack("<BI2d", 1, 1, *q) for p in parts for q in p]
        code = 4
    elif kind == "LINESTRING":
        each, code = [head(2, len(p)) + coords(p) for p in parts], 5
    else:
        each = [head(3, len(poly)) + b"".join(struct.pack("<I", len(r) + 1) + coords([*r, r[0]]) for r in poly) for poly in polygons(parts)]
        code = 6
    return each[0] if len(each) == 1 else head(code, len(each)) + b"".join(each)


# ---- the same on columns, where built-in expressions can do it


def described(commands: Sequence[int]) -> str:
    """A stream as text, for looking at it: each command with its points as offsets."""
    out, i = [], 0
    while i < len(commands):
        op, n = commands[i] & 7, commands[i] >> 3
        i += 1
        name = {MOVE: "MoveTo", LINE: "LineTo", CLOSE: "ClosePath"}.get(op, f"?{op}")
        if op == CLOSE:
            out.append(f"{name}({n})")
            continue
        points = [(unzigzag(commands[k]), unzigzag(commands[k + 1])) for k in range(i, min(i + 2 * n, len(commands) - 1), 2)]
        out.append(f"{name}({n}): " + ", ".join(f"({x:+d},{y:+d})" for x, y in points))
        i += 2 * n
    return "; ".join(out)


def plain_kind(name: Column) -> Column:
    """The kind under which a geometry is stored, by its type's name in any spelling: multi-part ones and rings under that
    of their parts; UNKNOWN for collections and all else."""
    bare = F.regexp_replace(F.regexp_replace(F.upper(name), "[^A-Z]", ""), "^MULTI", "")
    ring = F.when(bare.isin("LINEARRING", "LINE"), "LINESTRING").otherwise(bare)
    return F.when(ring.isin(*KINDS.values()), ring).when(name.isNotNull(), "UNKNOWN")


def packed(op: Column, count: Column) -> Column:
    return F.shiftleft(count, 3).bitwiseOR(op)


def zigzag_column(n: Column) -> Column:
    return F.shiftleft(n, 1).bitwiseXOR(F.shiftright(n, 31))


def unzigzag_column(n: Column) -> Column:
    return F.shiftrightunsigned(n, 1).bitwiseXOR(-n.bitwiseAND(F.lit(1)))


def points_of(commands: Column) -> Column:
    """Array of structs x, y of a stream of one MoveTo, as POINT features have; null for other streams."""
    n = F.shiftright(F.get(commands, F.lit(0)), 3)
    ok = (F.get(commands, F.lit(0)).bitwiseAND(F.lit(7)) == MOVE) & (n > 0) & (F.size(commands) == n * 2 + 1)
    start = F.array().cast("array<struct<x:int,y:int>>")

    def step(acc: Column, i: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        x = F.coalesce(last["x"], F.lit(0)) + unzigzag_column(F.get(commands, i * 2 + 1))
        y = F.coalesce(last["y"], F.lit(0)) + unzigzag_column(F.get(commands, i * 2 + 2))
        return F.concat(acc, F.array(F.struct(x.alias("x"), y.alias("y"))))

    return F.when(ok, F.aggregate(F.sequence(F.lit(0), n - 1), start, step))


def scaled(parts: Column, factor: Column) -> Column:
    """Parts in another extent: every coordinate times new extent / old extent."""
    return F.transform(parts, lambda p: F.transform(p, lambda q: F.struct((q["x"] * factor).alias("x"), (q["y"] * factor).alias("y"))))


def moved(parts: Column, by_x: Column, by_y: Column) -> Column:
    return F.transform(parts, lambda p: F.transform(p, lambda q: F.struct((q["x"] + by_x).alias("x"), (q["y"] + by_y).alias("y"))))


def steps(points: Column) -> Column:
    """Offsets dx, dy of each point from the one before, of the first from the origin: what command streams store."""
    before = F.concat(F.array(F.struct(F.lit(0).alias("x"), F.lit(0).alias("y"))), F.slice(points, 1, F.greatest(F.size(points) - 1, F.lit(0))))
    return F.zip_with(points, before, lambda a, b: F.struct((a["x"] - b["x"]).alias("dx"), (a["y"] - b["y"]).alias("dy")))


def line_length(points: Column) -> Column:
    after = F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0)))
    each = F.zip_with(F.slice(points, 1, F.size(after)), after, lambda a, b: F.hypot((b["x"] - a["x"]).cast("double"), (b["y"] - a["y"]).cast("double")))
    return F.aggregate(each, F.lit(0.0), lambda s, t: s + t)


def slice_of(points: Column, start: int, end: int) -> Column:
    """Points from ``start`` up to before ``end``, counted from 0; an error outside the sequence."""
    ok = (F.lit(start) >= 0) & (F.lit(start) <= F.lit(end)) & (F.lit(end) <= F.size(points))
    return F.when(ok, F.slice(points, F.lit(start + 1), F.lit(max(0, end - start)))).when(points.isNotNull(), F.raise_error(F.lit("outside the sequence")))


def ring_area2(points: Column) -> Column:
    """Twice the signed area of an array of structs x, y."""
    following = F.concat(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1))
    terms = F.zip_with(points, following, lambda a, b: (a["x"] * b["y"] - b["x"] * a["y"]).cast("double"))
    return F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)
