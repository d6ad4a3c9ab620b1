"""Which kind of store an address belongs to, and opening it."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import SparkSession

from tilewright.functions.names import present_name
from tilewright.sources.http import Auth, HttpStore
from tilewright.sources.storage import Store


@dataclass(frozen=True)
class Provider:
    """A kind of store: its schemes, the hosts that are surely its own, the response headers that give it away, and its rank."""

    id: str
    schemes: tuple[str, ...]
    hosts: str = ""
    header: str = ""
    order: int = 0

    def can(self, address: str) -> bool:
        scheme, host = parts_of(address)[:2]
        return scheme in self.schemes and (scheme not in ("http", "https") or not self.hosts or bool(re.search(self.hosts, host)))


#: More specific stores come before the plain one for the web.
PROVIDERS = (
    Provider("file", ("file", "")),
    Provider("s3", ("s3", "http", "https"), "", "x-amz-"),
    Provider("gcs", ("gs", "http", "https"), r"(^|\.)storage\.googleapis\.com$", "x-goog-"),
    Provider("azure", ("az", "http", "https"), r"\.blob\.core\.windows\.net$", "x-ms-"),
    Provider("azure-datalake", ("abfs", "abfss", "http", "https"), r"\.dfs\.core\.windows\.net$", "x-ms-"),
    Provider("http", ("http", "https"), "", "", 100),
)


def parts_of(address: str) -> tuple[str, str, str]:
    """Scheme, host and path."""
    m = re.match(r"(?:([A-Za-z][A-Za-z0-9+.-]*):(?://)?)?(.*)", address, re.S)
    scheme, rest = (m[1] or "").lower(), m[2]
    if scheme in ("", "file"):
        return scheme, "", rest
    host, _, path = rest.partition("/")
    return scheme, host.rpartition("@")[2].partition(":")[0].lower(), path


def is_enabled(provider: Provider, flags: Mapping[str, str], prefix: str) -> bool:
    """A provider is on unless its flag, such as PREFIX_S3, says otherwise."""
    said = flags.get(prefix + provider.id.upper().replace("-", "_"))
    return said is None or said.strip().lower() == "true"


def choose(address: str, provider: str | None = None, flags: Mapping[str, str] | None = None, probe: Callable[[str], Mapping[str, str]] | None = None, providers: Sequence[Provider] = PROVIDERS, prefix: str = "STORAGE_") -> Provider:
    """The provider named, or the one for the address among those that are on.

    An address of the web that several could take is asked for its headers (``probe``; its failure leaves the choice to
    rank); without any that give a store away it is the plain web. Else the lowest order wins; two that share it raise.
    """
    flags = os.environ if flags is None else flags
    own = [p for p in providers if is_enabled(p, flags, prefix)]
    if provider is not None:
        found = next((p for p in providers if p.id == provider.lower()), None)
        if found is None:
            raise ValueError(f"no provider {provider!r}")
        if found not in own:
            raise ValueError(f"provider {provider!r} is switched off")
        return found
    able = [p for p in own if p.can(address)]
    if not able:
        raise ValueError(f"no provider for {address}")
    if len(able) > 1 and parts_of(address)[0] in ("http", "https"):
        special = [p for p in able if p.header]
        try:
            headers = [h.lower() for h in (probe(address) if probe else {})]
            if probe:
                special = [p for p in special if any(h.startswith(p.header) for h in headers)]
                able = special or [p for p in able if not p.header]
            else:
                able = [p for p in special if p.hosts] or special or able
        except OSError:
            able = special or able
    best = [p for p in able if p.order == min(q.order for q in able)]
    if len(best) > 1:
        raise ValueError(f"{address} could be any of {', '.join(p.id for p in best)}: name the provider")
    return best[0]


def hadoop_root(address: str, provider: Provider) -> str:
    """The address as Hadoop's file systems know it."""
    scheme, host, path = parts_of(address)
    if provider.id == "s3":
        if scheme == "s3":
            return f"s3a://{host}/{path}".rstrip("/")
        own = re.match(r"(.+)\.s3[.-](?:[a-z0-9-]+\.)?amazonaws\.com$", host)
        return f"s3a://{own[1]}/{path}".rstrip("/") if own else f"s3a://{path}".rstrip("/")
    if provider.id == "gcs" and scheme != "gs":
        return f"gs://{path}".rstrip("/")
    if provider.id == "azure" and scheme in ("http", "https"):
        container, _, rest = path.partition("/")
        return f"wasbs://{container}@{host}/{rest}".rstrip("/")
    if provider.id == "azure-datalake" and scheme in ("http", "https"):
        container, _, rest = path.partition("/")
        return f"abfss://{container}@{host}/{rest}".rstrip("/")
    return address.rstrip("/") if address.rstrip("/") else address


def open_store(spark: SparkSession, target: str | Mapping[str, str], flags: Mapping[str, str] | None = None, auth: Auth | None = None, old_prefix: str = "", **how) -> Store | HttpStore:
    """A store by its address, or by settings (storage.uri, storage.provider and any other), whose former names count, too."""
    settings = {"storage.uri": target} if isinstance(target, str) else {present_name(k, old_prefix): v for k, v in target.items()}
    if not settings.get("storage.uri"):
        raise ValueError("storage.uri is missing")
    chosen = choose(settings["storage.uri"], settings.get("storage.provider"), flags, **how)
    if chosen.id == "http":
        return HttpStore(spark, settings["storage.uri"], auth)
    return Store(spark, hadoop_root(settings["storage.uri"], chosen))
