"""Decoder of raw Snappy blocks."""

from __future__ import annotations


def varint(data: bytes, at: int) -> tuple[int, int]:
    """(value, position after it)."""
    out = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise ValueError("truncated number")
        byte = data[at]
        at += 1
        out |= (byte & 0x7F) << shift
        if byte < 0x80:
            return out, at
        shift += 7


def decompress(data: bytes, most: int = 64 << 20) -> bytes:
    size, at = varint(data, 0)
    if size > most:
        raise ValueError("decompressed body is too large")
    out = bytearray()
    while at < len(data):
        tag = data[at]
        at += 1
        kind = tag & 3
        if kind == 0:
            n = (tag >> 2) + 1
            if n > 60:
                width = n - 60
                n = int.from_bytes(data[at : at + width], "little") + 1
                at += width
            if at + n > len(data):
                raise ValueError("truncated literal")
            out += data[at : at + n]
            at += n
            continue
        if kind == 1:
            n, offset = ((tag >> 2) & 7) + 4, ((tag >> 5) << 8) | data[at]
            at += 1
        else:
            width = 2 if kind == 2 else 4
            n, offset = (tag >> 2) + 1, int.from_bytes(data[at : at + width], "little")
            at += width
        if not 0 < offset <= len(out):
            raise ValueError("copy from before the start")
        for _ in range(n):  # copies may overlap what they write
            out.append(out[-offset])
    if len(out) != size:
        raise ValueError("wrong decompressed size")
    return bytes(out)


def compress(data: bytes) -> bytes:
    """A valid block of literals only, for tests and clients without a codec."""
    out, n = bytearray(), len(data)
    while True:
        out.append((n & 0x7F) | (0x80 if n > 0x7F else 0))
        n >>= 7
        if not n:
            break
    for i in range(0, len(data), 65536):
        part = data[i : i + 65536]
        out += bytes([61 << 2]) + (len(part) - 1).to_bytes(2, "little") + part
    return bytes(out)
