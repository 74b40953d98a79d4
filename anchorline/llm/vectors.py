"""Helpers for columns of vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(column: str) -> Column:
    """Whether a vector is given, finite in all components, and not zero."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    v = F.col(column)
    return F.coalesce(v.isNotNull() & F.forall(v, finite) & F.exists(v, lambda x: x != 0), F.lit(False))


def lengths(df: DataFrame, column: str) -> list[int]:
    """The lengths that vectors have, a few numbers; vectors of different lengths are never compared."""
    return sorted(r[0] for r in df.select(F.size(column)).distinct().collect())


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, by a power of two first, so that squares neither overflow nor vanish."""
    _, exponent = np.frexp(np.abs(rows).max(axis=1, keepdims=True, initial=0))
    rows = np.ldexp(rows, -exponent)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of doubles from a list column whose lists all have one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def groups(parts: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """Stretches of rows with an equal key, from batches in which such rows follow each other."""
    open_key, open_parts = None, []
    for part in parts:
        if not part.num_rows:
            continue
        keys = part.column(key).to_numpy(zero_copy_only=False)
        edges = [0, *(np.nonzero(keys[1:] != keys[:-1])[0] + 1).tolist(), len(keys)]
        for start, end in zip(edges, edges[1:], strict=False):
            if open_parts and keys[start] != open_key:
                yield pa.concat_batches(open_parts) if len(open_parts) > 1 else open_parts[0]
                open_parts = []
            open_key = keys[start]
            open_parts.append(part.slice(start, end - start))
    if open_parts:
        yield pa.concat_batches(open_parts) if len(open_parts) > 1 else open_parts[0]
