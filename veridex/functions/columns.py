"""Column functions shared by operators: seeded numbers, cell sets as bit masks, set similarity, exact tests."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

CELLS = 16
COLUMN_LETTERS = "ABCD"


def u(seed: int | str, *ids: Column | str) -> Column:
    """A number in [0, 1) that seed and ids decide, whatever the partitioning: 32 bits of an MD5."""
    parts = [F.col(c) if isinstance(c, str) else c for c in ids]
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def u_sql(seed: int | str, *ids: str) -> str:
    """The same in the oracle's SQL."""
    return f"(('0x' || substr(md5(concat_ws('|', '{seed}', {', '.join(f'CAST({i} AS VARCHAR)' for i in ids)})), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def bit(cell: Column | str) -> Column:
    """The mask of one cell."""
    c = F.col(cell) if isinstance(cell, str) else cell
    return F.element_at(F.array(*[F.lit(1 << i).cast("long") for i in range(CELLS)]), c.cast("int") + 1)


def mask_of(cells: Column | str) -> Column:
    """The mask of an array of cell numbers."""
    return F.aggregate(cells, F.lit(0).cast("long"), lambda m, c: m.bitwiseOR(bit(c)))


def cells_of(mask: Column | str) -> Column:
    """The cell numbers of a mask, ascending."""
    m = F.col(mask) if isinstance(mask, str) else mask
    return F.filter(F.array(*[F.lit(i) for i in range(CELLS)]), lambda i: m.bitwiseAND(bit(i)) != 0)


def cell_name(cell: Column | str) -> Column:
    c = F.col(cell) if isinstance(cell, str) else cell
    return F.concat(F.substring(F.lit(COLUMN_LETTERS), (c / 4).cast("int") + 1, F.lit(1)), (c % 4 + 1).cast("int").cast("string"))


def jaccard_masks(a: Column | str, b: Column | str) -> Column:
    """Similarity of two sets given as masks; two empty sets are alike."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    union = F.bit_count(a.bitwiseOR(b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.bit_count(a.bitwiseAND(b)) / union.cast("double"))


def jaccard_arrays(a: Column | str, b: Column | str) -> Column:
    """The same for arrays of distinct values."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union.cast("double"))


def share(part: Column, whole: Column) -> Column:
    """part / max(whole, 1): nothing of nothing is 0."""
    return part.cast("double") / F.greatest(whole, F.lit(1)).cast("double")


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function by its continued fraction, whose length grows with the root of a + b."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d, i, h = 1.0, 1.0 / (1.0 - (a + b) * x / (a + 1)), 0, 1.0 / (1.0 - (a + b) * x / (a + 1))
    while True:
        i += 1
        for term in (i * (b - i) * x / ((a + 2 * i - 1) * (a + 2 * i)), -(a + i) * (a + b + i) * x / ((a + 2 * i) * (a + 2 * i + 1))):
            d, c = 1.0 / ((1.0 + term * d) or 1e-300), (1.0 + term / c) or 1e-300
            h *= d * c
        if abs(d * c - 1.0) < 1e-15 or i > 1_000_000:
            return front * h


def sign_test(pos: Column | str, neg: Column | str) -> Column:
    """Exact two-sided sign (McNemar) test: min(1, 2 * P(X <= min)) for X ~ Binomial(pos + neg, 1/2); 1 without trials.

    For rows that are aggregated already: the distribution function is an incomplete beta function, so its steps grow
    with the root of the counts.
    """

    @F.pandas_udf("double")
    def p_value(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(x) or pd.isna(y) else 1.0 if x == y else min(1.0, 2 * incomplete_beta(max(x, y), min(x, y) + 1, 0.5)) for x, y in zip(a, b, strict=True)], dtype="float64")

    return p_value(*(F.col(x).cast("double") if isinstance(x, str) else x.cast("double") for x in (pos, neg)))


def sign_test_sql(pos: str, neg: str) -> str:
    """The same in the oracle's SQL, by log-gamma."""
    n, k = f"({pos} + {neg})", f"least({pos}, {neg})"
    term = f"exp(lgamma({n} + 1) - lgamma(i + 1) - lgamma({n} - i + 1) - {n} * ln(2))"
    return f"CASE WHEN {n} = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum([{term} FOR i IN range(0, CAST({k} AS BIGINT) + 1)])) END"
