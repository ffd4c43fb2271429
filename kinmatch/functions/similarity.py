"""Similarity of pairs: one Arrow pass for the character ratios, built-in expressions for the rest."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    if len(a) > len(b):
        a, b = b, a
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def indel_ratio(a: str, b: str) -> float:
    """2 LCS / (|a| + |b|); 0 when either is blank."""
    if a == b:
        return 1.0 if a else 0.0
    return 2 * lcs_length(a, b) / (len(a) + len(b)) if a and b else 0.0


def token_sort_ratio(a: str, b: str) -> float:
    return indel_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    """The best ratio among shared tokens and shared tokens followed by the rest of either side."""
    if not a or not b:
        return 0.0
    x, y = set(a.split()), set(b.split())
    both, only_x, only_y = sorted(x & y), sorted(x - y), sorted(y - x)
    if both and (not only_x or not only_y):
        return 1.0
    base, left, right = " ".join(both), " ".join(both + only_x), " ".join(both + only_y)
    return max(indel_ratio(base, left), indel_ratio(base, right), indel_ratio(left, right))


_RATIOS = StructType([StructField(n, DoubleType()) for n in ("basic", "core", "token_sort", "token_set", "address")])


@F.pandas_udf(_RATIOS)
def pair_ratios(basic_a: pd.Series, basic_b: pd.Series, core_a: pd.Series, core_b: pd.Series, address_a: pd.Series, address_b: pd.Series) -> pd.DataFrame:
    rows = zip(basic_a, basic_b, core_a, core_b, address_a, address_b, strict=True)
    out = [(indel_ratio(a, b), indel_ratio(c, d), token_sort_ratio(c, d), token_set_ratio(c, d), indel_ratio(e, f)) for a, b, c, d, e, f in rows]
    return pd.DataFrame(out, columns=["basic", "core", "token_sort", "token_set", "address"])


def fraction(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def shared(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def jaccard(a: Column, b: Column) -> Column:
    return F.when((F.size(a) > 0) & (F.size(b) > 0), shared(a, b) / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def length_ratio(a: Column, b: Column) -> Column:
    return fraction(F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b)))


def agrees(a: Column, b: Column) -> Column:
    return shared(a, b) > 0


def conflicts(a: Column, b: Column) -> Column:
    """Evidence on both sides, none of it shared."""
    return (F.size(a) > 0) & (F.size(b) > 0) & (shared(a, b) == 0)


def same(a: Column, b: Column) -> Column:
    """Equal and not blank."""
    return (a != "") & (a == b)
