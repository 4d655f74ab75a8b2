"""The 32-bit murmur3 hash, seed 0, as signed integers: of whole Arrow batches, rows of a length side by side."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

U = np.uint32
# The hash's constants.
C1, C2, C3, F1, F2 = U(0xCC9E2D51), U(0x1B873593), U(0xE6546B64), U(0x85EBCA6B), U(0xC2B2AE35)


def _turned(x: np.ndarray, n: int) -> np.ndarray:
    return (x << U(n)) | (x >> U(32 - n))


def hashes(rows: list[bytes]) -> np.ndarray:
    out = np.zeros(len(rows), U)
    size = np.array([len(r) for r in rows], np.int64)
    for n in np.unique(size).tolist():
        at = np.flatnonzero(size == n)
        raw = np.zeros((len(at), -(-n // 4) * 4), np.uint8)
        raw[:, :n] = np.frombuffer(b"".join(rows[i] for i in at), np.uint8).reshape(len(at), n)
        words, h = raw.view("<u4"), np.zeros(len(at), U)
        for k in range(words.shape[1]):
            x = _turned(words[:, k] * C1, 15) * C2
            h = h ^ x
            if 4 * k + 4 <= n:  # a short last word is not mixed further
                h = _turned(h, 13) * U(5) + C3
        h = h ^ U(n)
        h = (h ^ (h >> U(16))) * F1
        h = (h ^ (h >> U(13))) * F2
        out[at] = h ^ (h >> U(16))
    return out.view(np.int32)


def _of_bytes(x: pa.Array) -> pa.Array:
    return pa.array(hashes(x.to_pylist()))


def _of_text(x: pa.Array) -> pa.Array:
    return pa.array(hashes([t.encode("utf-16-le") for t in x.to_pylist()]))


def murmur3_text(c: Column) -> Column:
    """Of a text's UTF-16 units; null counts as the text "null"."""
    return F.arrow_udf(_of_text, "int")(F.coalesce(c.cast("string"), F.lit("null")))


def murmur3_uuid(c: Column) -> Column:
    """Of a UUID's 16 bytes; null as zero bytes."""
    return F.arrow_udf(_of_bytes, "int")(F.unhex(F.coalesce(F.regexp_replace(c, "-", ""), F.lit("0" * 32))))
