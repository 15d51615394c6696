"""Hilbert curve position of three coordinates, by Skilling's transform (2004), over numpy arrays."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType

#: Bits of an axis at most: three times as many fit a bigint.
MOST_BITS = 21


def hilbert_index(axes: np.ndarray, bits: np.ndarray | int) -> np.ndarray:
    """axes: (n, 3) non-negative integers of at most `bits` bits, one number or one for each row."""
    a = axes.astype(np.int64).T.copy()
    bits = np.broadcast_to(np.asarray(bits, np.int64), a.shape[1])
    top = int(bits.max(initial=1))
    for bit in range(top - 1, 0, -1):
        inside = bit < bits  # rows with fewer bits join where their first bit lies
        low = (1 << bit) - 1
        for k in range(3):
            flip = inside & (a[k] >> bit & 1 == 1)
            swap = np.where(inside & ~flip, (a[0] ^ a[k]) & low, 0)
            a[0] ^= np.where(flip, low, swap)
            a[k] ^= swap
    a[1] ^= a[0]
    a[2] ^= a[1]
    gray = np.zeros_like(a[0])
    for bit in range(top - 1, 0, -1):
        gray ^= np.where((bit < bits) & (a[2] >> bit & 1 == 1), (1 << bit) - 1, 0)
    a ^= gray
    out = np.zeros_like(a[0])
    for bit in range(top - 1, -1, -1):
        for k in range(3):
            out = np.where(bit < bits, out << 1 | (a[k] >> bit & 1), out)
    return out


@pandas_udf(LongType())
def _hilbert(x: pd.Series, y: pd.Series, z: pd.Series, bits: pd.Series) -> pd.Series:
    return pd.Series(hilbert_index(np.stack([x, y, z], axis=1), bits.to_numpy()))


def hilbert(x: Column, y: Column, z: Column, bits: Column) -> Column:
    """Position along the curve; an Arrow batch at a time, as 63 dependent bit steps make no good generated code."""
    return _hilbert(x.cast("long"), y.cast("long"), z.cast("long"), bits.cast("int"))


def bit_length(c: Column) -> Column:
    """Binary digits of a non-negative bigint, at least 1."""
    return F.greatest(F.length(F.regexp_replace(F.bin(c), "^0+", "")), F.lit(1))
