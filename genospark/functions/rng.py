"""Counter-based random numbers: a draw depends on its keys alone, not on partitions or call order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO48 = float(1 << 48)


def uniform(*keys) -> Column:
    """A uniform draw in [0, 1) from the keys (columns, or plain values taken as literals)."""
    parts = [k.cast("string") if isinstance(k, Column) else F.lit(str(k)) for k in keys]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 12), 16, 10).cast("double") / F.lit(TWO48)


def open_uniform(*keys) -> Column:
    """A draw in (0, 1): never 0, so its logarithm is finite."""
    return uniform(*keys) + F.lit(0.5 / TWO48)


def exponential(rate: Column, *keys) -> Column:
    return -F.ln(open_uniform(*keys)) / rate


def categorical(probs: list, *keys) -> Column:
    """The index of the first cumulative probability above the draw."""
    u, total = uniform(*keys), F.lit(0.0)
    out = None
    for i, p in enumerate(probs[:-1]):
        total = total + p
        out = F.when(u < total, i) if out is None else out.when(u < total, i)
    return out.otherwise(len(probs) - 1) if out is not None else F.lit(0)
