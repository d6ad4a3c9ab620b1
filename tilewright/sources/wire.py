"""Varints and the fields of a protocol-buffer message."""

from __future__ import annotations

from collections.abc import Iterator, Sequence


def varint(data: bytes, at: int) -> tuple[int, int]:
    """Value and where it ends; raises at a cut or too long one."""
    value = shift = 0
    while True:
        if at >= len(data):
            raise ValueError("data ends inside a number")
        b = data[at]
        at += 1
        value |= (b & 0x7F) << shift
        if b < 0x80:
            return value, at
        shift += 7
        if shift > 63:
            raise ValueError("a number is too long")


def to_varint(n: int) -> bytes:
    out = bytearray()
    n &= 0xFFFFFFFFFFFFFFFF
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def fields(data: bytes) -> Iterator[tuple[int, int, int | bytes]]:
    """Number, wire type and value of each field."""
    at = 0
    while at < len(data):
        tag, at = varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(data, at)
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        elif kind == 2:
            size, at = varint(data, at)
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"wire type {kind}")
        if at > len(data):
            raise ValueError("data ends inside a field")
        yield tag >> 3, kind, value


def packed(data: bytes) -> list[int]:
    if not data or max(data) < 0x80:
        return list(data)
    out, at = [], 0
    while at < len(data):
        n, at = varint(data, at)
        out.append(n)
    return out


def varints(numbers: Sequence[int]) -> bytes:
    """Numbers of 32 bits one after another; negative ones as their two's complement."""
    try:
        if not numbers or max(numbers) < 0x80:
            return bytes(numbers)
    except ValueError:  # some are negative
        pass
    out = bytearray()
    for n in numbers:
        n &= 0xFFFFFFFF
        while n > 0x7F:
            out.append(n & 0x7F | 0x80)
            n >>= 7
        out.append(n)
    return bytes(out)


def field(number: int, value: int | bytes | str) -> bytes:
    if isinstance(value, int):
        return to_varint(number << 3) + to_varint(value)
    raw = value.encode() if isinstance(value, str) else value
    return to_varint(number << 3 | 2) + to_varint(len(raw)) + raw
