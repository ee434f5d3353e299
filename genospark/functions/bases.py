"""Allele codes 0-3 (null: missing) as letters, pairs and genotypes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Base letters by code, IUPAC letters of unordered pairs.
BASES = ["A", "C", "G", "T"]
IUPAC = {(0, 1): "M", (0, 2): "R", (0, 3): "W", (1, 2): "S", (1, 3): "Y", (2, 3): "K"}


def base(code: Column, missing: str = "N") -> Column:
    out = F.when(code.isNull(), missing)
    for i, letter in enumerate(BASES):
        out = out.when(code == i, letter)
    return out.otherwise(missing)


def iupac(a: Column, b: Column) -> Column:
    """Letter of a diploid call; one missing allele takes the other, two give N."""
    x, y = F.coalesce(a, b), F.coalesce(b, a)
    lo, hi = F.least(x, y), F.greatest(x, y)
    out = F.when(lo == hi, base(lo))
    for (i, j), letter in IUPAC.items():
        out = out.when((lo == i) & (hi == j), letter)
    return out.otherwise("N")


def genotype(a: Column, b: Column) -> Column:
    """l|r with . for missing."""
    return F.concat(F.coalesce(a.cast("string"), F.lit(".")), F.lit("|"), F.coalesce(b.cast("string"), F.lit(".")))


def jukes_cantor(p: Column) -> Column:
    """-3/4 ln(1 - 4/3 p); null where p reaches 3/4."""
    return F.when(p < 0.75, -0.75 * F.ln(1 - 4.0 / 3.0 * p))
