"""Storage addresses and keys: parsing and guards."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Settings that were renamed.
RENAMED = {"storage.gcs.host": "storage.gcs.endpoint"}


def s3_parts(url: Column) -> Column:
    """Struct bucket, key, region of s3://, path style and virtual host style addresses; null for other schemes.

    On hosts of the public cloud the bucket is the first label of the host or the first part of the path; on other
    hosts the path style is taken.
    """
    scheme, host, path = F.lower(F.regexp_extract(url, "^([A-Za-z0-9]+)://", 1)), F.regexp_extract(url, "^[A-Za-z0-9]+://([^/?#]*)", 1), F.regexp_extract(url, "^[A-Za-z0-9]+://[^/?#]*/([^?#]*)", 1)
    cloud = r"^(?:(.+)\.)?s3[.-](?:([a-z0-9-]+)\.)?amazonaws\.com$"
    own, region = F.regexp_extract(host, cloud, 1), F.regexp_extract(host, cloud, 2)
    first, rest = F.regexp_extract(path, "^([^/]*)", 1), F.regexp_replace(path, "^[^/]*/?", "")
    virtual = (scheme != "s3") & (own != "")
    none = lambda c: F.when(c != "", c)
    parts = F.struct(
        none(F.when(scheme == "s3", host).when(virtual, own).otherwise(first)).alias("bucket"),
        none(F.when((scheme == "s3") | virtual, path).otherwise(rest)).alias("key"),
        none(F.when(scheme == "s3", F.lit("")).otherwise(region)).alias("region"),
    )
    return F.when(scheme.isin("s3", "http", "https"), parts)


def is_safe_key(key: Column) -> Column:
    """Relative, without empty, dot or parent segments and without NUL; null and empty are unsafe."""
    return F.coalesce((key != "") & ~key.rlike(r"(^|/)\.{1,2}(/|$)") & ~key.startswith("/") & ~key.contains("\x00"), F.lit(False))


def normal_key(name: Column, old_prefix: str = "", renamed: dict[str, str] = RENAMED) -> Column:
    """A setting under its present name: a former prefix gives way to storage., and renamed settings follow. Case and
    separators are left as they are."""
    moved = F.when(F.startswith(name, F.lit(old_prefix)), F.concat(F.lit("storage."), F.substr(name, F.lit(len(old_prefix) + 1)))).otherwise(name) if old_prefix else name
    pairs = F.create_map(*[F.lit(x) for kv in renamed.items() for x in kv])
    return F.coalesce(pairs[moved], moved)


def present_name(name: str, old_prefix: str = "", renamed: dict[str, str] = RENAMED) -> str:
    """normal_key for one name."""
    moved = "storage." + name[len(old_prefix) :] if old_prefix and name.startswith(old_prefix) else name
    return renamed.get(moved, moved)


def relative_key(root: str, address: Column) -> Column:
    """The key of an address below a root, without its query; null for addresses elsewhere and for keys that aren't safe."""
    base = root.rstrip("/") + "/"
    own = F.regexp_replace(F.when(F.startswith(address, F.lit(base)), F.substr(address, F.lit(len(base) + 1))), "[?#].*$", "")
    return F.when(is_safe_key(own), own)


def require_safe(pattern: str) -> str:
    """Checked before planning; raises on a pattern that could leave its root."""
    if not pattern or pattern.startswith("/") or "\x00" in pattern or re.search(r"(^|/)\.{1,2}(/|$)", pattern):
        raise ValueError(f"unsafe pattern {pattern!r}")
    return pattern
