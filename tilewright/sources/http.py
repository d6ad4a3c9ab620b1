"""Files on web servers, by byte ranges: reading only, no listing. Requests are made where tasks run."""

from __future__ import annotations

import base64
import urllib.error
import urllib.request
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TIMEOUT = 30


@dataclass(frozen=True)
class Auth:
    """How requests are signed: headers that are added as they are, and a user whom a digest challenge asks for."""

    headers: Mapping[str, str] = field(default_factory=dict)
    user: str | None = None
    password: str = ""

    @staticmethod
    def basic(user: str, password: str) -> Auth:
        return Auth({"Authorization": "Basic " + base64.b64encode(f"{user}:{password}".encode()).decode()})

    @staticmethod
    def bearer(token: str) -> Auth:
        return Auth({"Authorization": f"Bearer {token}"})

    @staticmethod
    def api_key(header: str, key: str, prefix: str = "") -> Auth:
        return Auth({header: prefix + key})

    @staticmethod
    def custom(headers: Mapping[str, str]) -> Auth:
        return Auth(dict(headers))

    @staticmethod
    def digest(user: str, password: str) -> Auth:
        return Auth({}, user, password)


class NotAllowed(PermissionError):
    """The server wants other credentials."""


def _ask(url: str, method: str, auth: Auth | None, headers: Mapping[str, str] | None = None):
    auth = auth or Auth()
    opener = urllib.request.build_opener()
    if auth.user is not None:
        known = urllib.request.HTTPPasswordMgrWithDefaultRealm()
        known.add_password(None, url, auth.user, auth.password)
        opener.add_handler(urllib.request.HTTPDigestAuthHandler(known))
    request = urllib.request.Request(url, method=method, headers=dict(auth.headers) | dict(headers or {}))
    try:
        return opener.open(request, timeout=TIMEOUT)
    except urllib.error.HTTPError as e:
        if e.code in (401, 403):
            raise NotAllowed(f"{url}: status {e.code}") from None
        if e.code == 404:
            raise FileNotFoundError(url) from None
        if e.code == 416:
            return None
        raise OSError(f"{url}: status {e.code}") from None


def info(url: str, auth: Auth | None = None) -> dict:
    """size (None if the server doesn't tell), etag, last_modified and whether ranges are refused outright."""
    with _ask(url, "HEAD", auth) as r:
        size = r.headers.get("Content-Length")
        return {"size": int(size) if size else None, "etag": r.headers.get("ETag"), "last_modified": r.headers.get("Last-Modified"), "no_ranges": r.headers.get("Accept-Ranges", "").strip().lower() == "none"}


def read_range(url: str, offset: int, length: int, auth: Auth | None = None, ranges_checked: bool = False) -> bytes:
    """Bytes from offset on, up to length; none past the end. The server must answer with the range and no more."""
    if offset < 0 or length < 0:
        raise ValueError(f"range {offset} and {length}")
    if not ranges_checked and info(url, auth)["no_ranges"]:
        raise OSError(f"{url}: the server gives no ranges")
    if not length:
        return b""
    answer = _ask(url, "GET", auth, {"Range": f"bytes={offset}-{offset + length - 1}"})
    if answer is None:  # the range lies past the end
        return b""
    with answer:
        if answer.status != 206:
            raise OSError(f"{url}: status {answer.status} where a range was asked for")
        if int(answer.headers.get("Content-Length") or 0) > length:
            raise OSError(f"{url}: more than the range came back")
        return answer.read(length)


class HttpFile:
    """A web file that is read like one of pyarrow's: size, read_at, close. A user in the address signs its requests."""

    def __init__(self, url: str, auth: Auth | None = None):
        scheme, _, rest = url.partition("://")
        user, at, host = rest.partition("@") if "@" in rest.partition("/")[0] else ("", "", rest)
        self.url = f"{scheme}://{host}"
        self.auth = auth or (Auth.basic(*user.partition(":")[::2]) if at else None)
        self.known = info(self.url, self.auth)
        if self.known["no_ranges"]:
            raise OSError(f"{url}: the server gives no ranges")

    def size(self) -> int:
        if self.known["size"] is None:
            raise OSError(f"{self.url}: its size isn't known")
        return self.known["size"]

    def read_at(self, length: int, offset: int) -> bytes:
        return read_range(self.url, offset, length, self.auth, ranges_checked=True)

    def close(self) -> None:
        pass

    def __enter__(self) -> HttpFile:
        return self

    def __exit__(self, *_) -> None:
        self.close()


class HttpStore:
    """A folder of the web: keys below an address. It can't be listed or written to."""

    def __init__(self, spark: SparkSession, root: str, auth: Auth | None = None):
        self.spark, self.root, self.auth = spark, root.rstrip("/"), auth

    def _url(self, key: str) -> str:
        return f"{self.root}/{key}" if key else self.root

    def stat(self, key: str) -> dict | None:
        try:
            return {"key": key} | info(self._url(key), self.auth)
        except FileNotFoundError:
            return None

    def exists(self, key: str) -> bool:
        return self.stat(key) is not None

    def read(self, key: str, offset: int = 0, length: int | None = None) -> bytes:
        size = info(self._url(key), self.auth)["size"]
        return read_range(self._url(key), offset, max(0, (size or 0) - offset) if length is None else length, self.auth)

    def read_ranges(self, ranges: DataFrame) -> DataFrame:
        """The columns of ``ranges`` (key, range_offset, range_length and any other) with ``bytes``, as storage.read_ranges."""
        root, auth, names = self.root, self.auth, ranges.columns
        schema = T.StructType([*ranges.schema, T.StructField("bytes", T.BinaryType())])
        at = [names.index(c) for c in ("key", "range_offset", "range_length")]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = zip(*(batch.column(i).to_pylist() for i in at))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([read_range(f"{root}/{k}", o, n, auth) for k, o, n in rows], pa.binary())], names=schema.names)

        return ranges.where(F.col("key").isNotNull()).mapInArrow(run, schema)

    def list(self, pattern: str = "**") -> DataFrame:
        raise NotImplementedError("web servers can't be listed")
