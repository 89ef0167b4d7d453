"""Byte-aligned variable-length integers with the control bytes apart from the data bytes.

Four integers share a control byte: two bits each, the number of data bytes less one, lowest bits first. Data bytes
are little-endian. Decoding looks lengths up in a table of the 256 control bytes.
"""

from __future__ import annotations

import numpy as np

LENGTHS = ((np.arange(256)[:, None] >> (2 * np.arange(4))) & 3).astype(np.uint8) + 1


def encode(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of integers from 0 to 2^32 - 1."""
    values = np.ascontiguousarray(values, "<u4")
    extra = (values > 0xFF).view(np.uint8) + (values > 0xFFFF).view(np.uint8) + (values > 0xFFFFFF).view(np.uint8)
    four = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    four[: len(values)] = extra
    four = four.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    wide = int(extra.max()) + 1 if len(extra) else 1
    each = values.view(np.uint8).reshape(-1, 4)[:, :wide]
    return control.tobytes(), each[np.arange(wide) <= extra[:, None]].tobytes()


def decode(control: bytes, data: bytes, count: int) -> np.ndarray:
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:count]
    raw = np.frombuffer(data, np.uint8)
    ends = np.cumsum(lengths, dtype=np.int64)
    starts = ends - lengths
    out = raw[starts].astype(np.uint32) if count else np.zeros(0, np.uint32)
    for k in range(1, int(lengths.max()) if count else 1):
        more = np.flatnonzero(lengths > k)
        out[more] |= raw[starts[more] + k].astype(np.uint32) << (8 * k)
    return out


def encode_rows(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The integers of several rows, each row filled up with zeros to whole control bytes: control bytes of all rows, how
    many each has, data bytes, how many each has."""
    full = -(-counts // 4) * 4
    starts = np.cumsum(full) - full
    padded = np.zeros(int(full.sum()), np.uint32)
    at = np.arange(len(values)) + np.repeat(starts - (np.cumsum(counts) - counts), counts)
    padded[at] = values
    control, data = encode(padded)
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].sum(axis=1, dtype=np.int64)
    ends = np.concatenate([[0], np.cumsum(lengths)])
    marks = np.concatenate([[0], np.cumsum(full // 4)])
    return np.frombuffer(control, np.uint8), full // 4, np.frombuffer(data, np.uint8), np.diff(ends[marks])


def decode_rows(control: bytes, data: bytes, counts: np.ndarray) -> np.ndarray:
    full = -(-counts // 4) * 4
    padded = decode(control, data, int(full.sum()))
    return padded[np.arange(int(counts.sum())) + np.repeat(np.cumsum(full) - full - (np.cumsum(counts) - counts), counts)]
