"""Addresses that let their bearer read or write one object for some time, signed as S3 and stores like it expect."""

from __future__ import annotations

import hashlib
import hmac
from datetime import UTC, datetime
from urllib.parse import quote


def presigned(method: str, bucket: str, key: str, region: str, access_key: str, secret_key: str, seconds: int, at: datetime | None = None, token: str | None = None, endpoint: str | None = None) -> str:
    """A GET or PUT address by signature version 4, good for ``seconds`` (a week at most) from ``at``.

    Without ``endpoint`` the bucket is part of the host; with one (a store of one's own) of the path.
    """
    if not 1 <= seconds <= 7 * 86_400:
        raise ValueError("an address is good for a second to a week")
    if method not in ("GET", "PUT"):
        raise ValueError(method)
    now = (at or datetime.now(UTC)).astimezone(UTC).strftime("%Y%m%dT%H%M%SZ")
    scheme, _, host = (endpoint or f"https://{bucket}.s3.amazonaws.com").rstrip("/").partition("://")
    path = "/" + (f"{bucket}/" if endpoint else "") + quote(key, safe="/-_.~")
    scope = f"{now[:8]}/{region}/s3/aws4_request"
    query = {"X-Amz-Algorithm": "AWS4-HMAC-SHA256", "X-Amz-Credential": f"{access_key}/{scope}", "X-Amz-Date": now, "X-Amz-Expires": str(seconds), "X-Amz-SignedHeaders": "host"}
    if token:
        query["X-Amz-Security-Token"] = token
    text = "&".join(f"{quote(k, safe='-_.~')}={quote(v, safe='-_.~')}" for k, v in sorted(query.items()))
    request = "\n".join([method, path, text, f"host:{host}\n", "host", "UNSIGNED-PAYLOAD"])
    to_sign = "\n".join(["AWS4-HMAC-SHA256", now, scope, hashlib.sha256(request.encode()).hexdigest()])
    secret = b"AWS4" + secret_key.encode()
    for part in scope.split("/"):
        secret = hmac.new(secret, part.encode(), hashlib.sha256).digest()
    return f"{scheme}://{host}{path}?{text}&X-Amz-Signature={hmac.new(secret, to_sign.encode(), hashlib.sha256).hexdigest()}"
