"""HKY substitution model in closed form; bases in the order A C G T."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PURINE = {0, 2}


def same_class(i: int, j: int) -> bool:
    return (i in PURINE) == (j in PURINE)


def scale(kappa: Column, pi: list[Column]) -> Column:
    """The factor that brings the mean rate to 1."""
    ts = pi[0] * pi[2] + pi[1] * pi[3]
    tv = (pi[0] + pi[2]) * (pi[1] + pi[3])
    return 1 / (2 * (kappa * ts + tv))


def rate(kappa: Column, pi: list[Column], i: int, j: int) -> Column:
    """Entry of the rate matrix."""
    off = lambda j: pi[j] * (kappa if same_class(i, j) else F.lit(1.0))
    b = scale(kappa, pi)
    return b * off(j) if i != j else -b * sum((off(k) for k in range(4) if k != i), F.lit(0.0))


def ts_tv(kappa: Column, pi: list[Column]) -> Column:
    return kappa * (pi[0] * pi[2] + pi[1] * pi[3]) / ((pi[0] + pi[2]) * (pi[1] + pi[3]))


def probability(kappa: Column, pi: list[Column], t: Column, i: int, j: int) -> Column:
    """P(j after t | i)."""
    b = scale(kappa, pi)
    group = sum((pi[k] for k in range(4) if same_class(k, j)), F.lit(0.0))
    slow, fast = F.exp(-b * t), F.exp(-b * t * (1 + group * (kappa - 1)))
    if not same_class(i, j):
        return pi[j] * (1 - slow)
    drift = pi[j] + pi[j] * (1 / group - 1) * slow
    return drift + (group - pi[j]) / group * fast if i == j else drift - pi[j] / group * fast
