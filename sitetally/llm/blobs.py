"""Columns of whole numbers as compressed bytes: what tasks hand to each other in large numbers."""

from __future__ import annotations

import numpy as np
import zstandard


def _narrow(values: np.ndarray) -> np.ndarray:
    top = int(values.max(initial=0))
    return values.astype("<u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4" if top < 1 << 32 else "<u8")


def pack(columns: list[np.ndarray], text: bytes = b"") -> bytes:
    """Non-negative (or unsigned 64-bit) arrays, each in the narrowest width, and a text."""
    narrow = [_narrow(c) for c in columns]
    header = np.array([len(narrow), len(text), *(v for c in narrow for v in (len(c), c.itemsize))], "<i8")
    return zstandard.ZstdCompressor(level=1).compress(b"".join([header.tobytes(), text, *(c.tobytes() for c in narrow)]))


def unpack(data: bytes) -> tuple[list[np.ndarray], bytes]:
    """The arrays as unsigned 64-bit numbers, and the text."""
    raw = zstandard.ZstdDecompressor().decompress(data)
    n, size = np.frombuffer(raw, "<i8", 2).tolist()
    header = np.frombuffer(raw, "<i8", 2 * n, 16).tolist()
    at = 16 + 16 * n
    text, columns = raw[at : at + size], []
    at += size
    for length, width in zip(header[::2], header[1::2], strict=True):
        columns.append(np.frombuffer(raw, f"<u{width}", length, at).astype(np.uint64))
        at += length * width
    return columns, text
