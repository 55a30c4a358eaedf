"""Fixed-edge binning."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .numeric import as_col


def cut(x, edges, labels, right: bool = True) -> Column:
    """Label of the bin holding x; NULL outside all bins.

    right=True gives (a, b] bins, right=False gives [a, b): a value on an edge
    lands in a different bin under the two rules.
    """
    if len(edges) != len(labels) + 1:
        raise ValueError("need exactly one more edge than labels")
    c = as_col(x)
    out = None
    for lo, hi, label in zip(edges, edges[1:], labels):
        inside = ((c > lo) & (c <= hi)) if right else ((c >= lo) & (c < hi))
        out = F.when(inside, F.lit(label)) if out is None else out.when(inside, F.lit(label))
    return out


def first_match(rules, default) -> Column:
    """Priority rules: value of the first true condition, else the default."""
    out = None
    for cond, value in rules:
        out = F.when(cond, F.lit(value)) if out is None else out.when(cond, F.lit(value))
    return out.otherwise(F.lit(default))
