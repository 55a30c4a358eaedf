"""Lookups: value maps and size-band tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewake.functions.numeric import as_col


def map_values(x, table: dict, default=None) -> Column:
    """Value of a small fixed dictionary, the default where the key is missing."""
    entries = [F.lit(v) for pair in table.items() for v in pair]
    found = F.element_at(F.create_map(*entries), as_col(x))
    return found if default is None else F.coalesce(found, F.lit(default))


def lookup_join(df: DataFrame, table: DataFrame, on, default: dict | None = None) -> DataFrame:
    """Left lookup in a dimension table; `default` fills columns that found nothing."""
    out = df.join(table, on, "left")
    return out.fillna(default) if default else out


def band_values(sizes: DataFrame, bands: DataFrame, type_col: str, size_col: str, tables) -> DataFrame:
    """Resolve band tables once per distinct (type, size).

    bands: table, <type_col>, lo, hi, value, band_no. A band holds lo <= size < hi with a
    NULL or infinite hi open; where bands overlap the highest band_no wins. Returns
    type, size and one column per name in `tables`.
    """
    keys = sizes.select(type_col, size_col).distinct()
    b = bands
    hit = (F.col(size_col) >= F.col("lo")) & (F.col("hi").isNull() | (F.col(size_col) < F.col("hi")))
    found = keys.join(b, type_col).filter(hit)
    last = lambda t: F.max_by(F.when(F.col("table") == t, F.col("value")),
                              F.when(F.col("table") == t, F.col("band_no")))
    return found.groupBy(type_col, size_col).agg(*[last(t).alias(t) for t in tables])


def band_join(df: DataFrame, bands: DataFrame, type_col: str, size_col: str, tables) -> DataFrame:
    """Add one value column per band table to every row; no band gives NULL."""
    return df.join(band_values(df, bands, type_col, size_col, tables), [type_col, size_col], "left")


def first_per_key(df: DataFrame, keys, order) -> DataFrame:
    """First row of each key in an explicit order (a total order makes it repeatable).

    Done as one min_by aggregate, so a hot key is reduced on the map side.
    """
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    kept = df.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct(*[as_col(o) for o in order])).alias("_row"))
    return kept.select(*keys, *[F.col("_row")[c].alias(c) for c in rest])
