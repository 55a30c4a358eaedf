"""Covered calendars, event windows and their joins to daily panels.

Rule for panels: a day without a row for a unit is zero if any unit has that day,
unknown otherwise; events that touch an unknown day are dropped.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tidewake.functions.dates import day_range, same_day_in_year
from tidewake.functions.numeric import as_col


def covered_days(df: DataFrame, day: str) -> DataFrame:
    """The distinct days of a panel: at most one row per calendar day."""
    return df.select(day).distinct()


def covered_array(df: DataFrame, day: str) -> Column:
    """The covered days as one sorted array, computed once as a scalar subquery."""
    return (covered_days(df, day)
            .agg(F.sort_array(F.collect_list(day)).alias("_days")).scalar())


def calendar_summary(df: DataFrame, day: str) -> Column:
    """struct<lo, hi, gaps> of a panel's covered calendar in one scalar subquery: its first and
    last day and the uncovered days between them."""
    bounds = F.struct(F.min(day).alias("lo"), F.max(day).alias("hi"),
                      F.array_except(F.sequence(F.min(day), F.max(day)), F.collect_list(day)).alias("gaps"))
    return covered_days(df, day).agg(bounds.alias("_calendar")).scalar()


def span(df: DataFrame, day: str) -> tuple[Column, Column]:
    """First and last covered day."""
    bounds = df.agg(F.struct(F.min(day).alias("lo"), F.max(day).alias("hi")).alias("_span")).scalar()
    return bounds["lo"], bounds["hi"]


def densify(df: DataFrame, keys, day: str, values, fill: float = 0.0,
            calendar: DataFrame | None = None) -> DataFrame:
    """One row per key and covered day, missing values filled.

    Input rows are summed per (key, day) first. The calendar is exploded per key, so the
    full grid is produced by parallel tasks rather than by a cross join.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    daily = df.groupBy(*keys, day).agg(*[F.sum(v).alias(v) for v in values])
    days = covered_array(calendar if calendar is not None else df, day)
    grid = df.select(*keys).distinct().withColumn(day, F.explode(days))
    return grid.join(daily, [*keys, day], "left").fillna(fill, subset=list(values))


def covered_events(events: DataFrame, panel: DataFrame, day: str, start: str, end: str,
                   pad: int = 0) -> DataFrame:
    """Keep events whose padded window lies inside the covered calendar."""
    first, last = F.date_sub(F.col(start), pad), F.date_add(F.col(end), pad)
    holes = F.exists(F.col("_calendar.gaps"), lambda d: (d >= first) & (d <= last))
    return (events.withColumn("_calendar", calendar_summary(panel, day))
            .filter((first >= F.col("_calendar.lo")) & (last <= F.col("_calendar.hi")) & ~holes).drop("_calendar"))


def event_days(events: DataFrame, start: str, end: str, before: int, after: int,
               out: str = "date") -> DataFrame:
    """One row per event and day from `before` days ahead of start to `after` days past end."""
    return events.withColumn(out, F.explode(
        day_range(F.date_sub(F.col(start), before), F.date_add(F.col(end), after))))


def attach_daily(event_days_df: DataFrame, panel: DataFrame, keys, day: str, values,
                 calendar: DataFrame | None = None) -> DataFrame:
    """Event days with the unit's daily values: zero on covered days without a row, and
    uncovered days dropped. The panel is joined sparse; no dense copy is built."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    daily = panel.groupBy(*keys, day).agg(*[F.sum(v).alias(v) for v in values])
    days = covered_days(calendar if calendar is not None else panel, day)
    return (event_days_df.join(days, day, "left_semi")
            .join(daily, [*keys, day], "left").fillna(0.0, subset=list(values)))


def units_with_floor(panel: DataFrame, unit: str, day: str, value: str, floor: float,
                     calendar: DataFrame | None = None) -> DataFrame:
    """Units whose mean over the covered calendar reaches the floor."""
    n = covered_days(calendar if calendar is not None else panel, day).agg(F.count(F.lit(1))).scalar()
    return (panel.groupBy(unit).agg(F.sum(value).alias("_total"))
            .filter(F.try_divide(F.col("_total").cast("double"), n) >= floor).select(unit))


def shared_calendar(a: DataFrame, b: DataFrame, day: str) -> DataFrame:
    """Days processed by both panels."""
    return covered_days(a, day).intersect(covered_days(b, day))


def calendar_difference(a: DataFrame, b: DataFrame, day: str) -> DataFrame:
    """Days only one of the panels has, with the side that has it."""
    da, db = covered_days(a, day), covered_days(b, day)
    return (da.exceptAll(db).withColumn("only_in", F.lit("first"))
            .unionByName(db.exceptAll(da).withColumn("only_in", F.lit("second"))))


def matched_panel(a: DataFrame, a_values, b: DataFrame, b_values, unit: str, day: str) -> DataFrame:
    """Two panels on their shared units and shared calendar, zero filled."""
    days = shared_calendar(a, b, day).agg(F.sort_array(F.collect_list(day))).scalar()
    grid = (a.select(unit).distinct().intersect(b.select(unit).distinct())
            .withColumn(day, F.explode(days)))
    total = lambda p, vs: p.groupBy(unit, day).agg(*[F.sum(v).cast("double").alias(v) for v in vs])
    return (grid.join(total(a, a_values), [unit, day], "left")
            .join(total(b, b_values), [unit, day], "left")
            .fillna(0.0, subset=[*a_values, *b_values]))


def shift_events(events: DataFrame, start: str, end: str, shifts, lo=None, hi=None) -> DataFrame:
    """Copy every event under fixed day shifts [(label, days)], kept inside [lo, hi]."""
    table = F.array(*[F.struct(F.lit(str(n)).alias("label"), F.lit(int(d)).alias("days"))
                      for n, d in shifts])
    out = (events.withColumn("_s", F.explode(table))
           .withColumn("shift", F.col("_s.label"))
           .withColumn(start, F.date_add(F.col(start), F.col("_s.days")))
           .withColumn(end, F.date_add(F.col(end), F.col("_s.days"))).drop("_s"))
    if lo is not None:
        out = out.filter(F.col(start) >= lo)
    return out if hi is None else out.filter(F.col(end) <= hi)


def interval_sets(exposures: DataFrame, unit: str, start, end, out: str = "_busy") -> DataFrame:
    """Per unit the exposure intervals as an array of (s, e), one entry per start day.

    Intervals sharing a start day are merged to the longest, which leaves every overlap
    test unchanged and bounds the array by the calendar.
    """
    per_start = (exposures.groupBy(unit, as_col(start).alias("_s"))
                 .agg(F.max(as_col(end)).alias("_e")))
    return per_start.groupBy(unit).agg(
        F.collect_list(F.struct(F.col("_s").alias("s"), F.col("_e").alias("e"))).alias(out))


def overlaps_any(intervals, lo, hi) -> Column:
    """True when any interval of the array touches [lo, hi]."""
    return F.coalesce(F.exists(as_col(intervals),
                               lambda x: (x["e"] >= as_col(lo)) & (x["s"] <= as_col(hi))), F.lit(False))


def panel_bounds(panel: DataFrame, day: str):
    """First and last day of a panel: one small aggregate, run when a plan needs the length of its dense arrays."""
    return panel.agg(F.min(F.col(day).cast("date")), F.max(F.col(day).cast("date"))).first()


def _free(lo: Column, hi: Column, start: str, years, covered, met) -> Column:
    """Years other than the event's whose window exists, lies inside `covered` and is not met (met(lo, hi) -> condition)."""
    def fits(y):
        a, b = same_day_in_year(lo, y), same_day_in_year(hi, y)
        there = a.isNotNull() & b.isNotNull()
        if covered is not None:
            there = there & (a >= F.lit(covered[0])) & (b <= F.lit(covered[1]))
        return F.coalesce(there & ~met(a, b), F.lit(False))
    candidates = F.filter(F.sequence(F.lit(int(years[0])), F.lit(int(years[1]))), lambda y: y != F.year(F.col(start)))
    return F.filter(candidates, fits)


def _each_window(events: DataFrame, busy: DataFrame, unit: str, start: str, end: str, **found: Column) -> DataFrame:
    """Append columns that follow from the unit, the days and the unit's `_busy` intervals, worked out once for events that share them."""
    own = {unit: "_w_unit", start: "_w_start", end: "_w_end"}
    windows = events.select(unit, start, end).distinct().join(busy, unit, "left").withColumns(found).withColumnsRenamed(own)
    same = [events[c].eqNullSafe(windows[w]) for c, w in own.items()]
    return events.join(windows.select(*own.values(), *found), reduce(lambda a, b: a & b, same), "left").drop(*own.values())


def baseline_years(events: DataFrame, exposures: DataFrame, *, unit: str, start: str, end: str,
                   x_start, x_end, years, pre: int = 60, post: int = 45, covered=None) -> DataFrame:
    """Add `base`: the other years whose same calendar window meets no exposure of the unit.

    x_start / x_end are the first and last day an exposure counts for; years = (first, last); covered = (first day,
    last day) of the panel, which the window must not leave. Years in which a shifted date does not exist are left out.
    """
    lo, hi = F.date_sub(F.col(start), pre), F.date_add(F.col(end), post)
    busy = interval_sets(exposures, unit, x_start, x_end)
    free = _free(lo, hi, start, years, covered, lambda a, b: overlaps_any("_busy", a, b))
    return _each_window(events, busy, unit, start, end, base=free)


def baseline_sets(events: DataFrame, exposures: DataFrame, limits, *, unit: str, start: str, end: str, x_start, x_end, years, distance: str = "dist",
                  pre: int = 60, post: int = 45, covered=None) -> DataFrame:
    """Add `base_sets`: for each limit the baseline years when exposures within that distance count (see baseline_years).

    One interval set serves all limits: an entry per start day with the last day of the exposures within each limit.
    """
    lo, hi = F.date_sub(F.col(start), pre), F.date_add(F.col(end), post)
    ends = [F.max(F.when(F.col(distance) <= limit, as_col(x_end))).alias(f"e{i}") for i, limit in enumerate(limits)]
    busy = (exposures.groupBy(unit, as_col(x_start).alias("s")).agg(*ends)
            .groupBy(unit).agg(F.collect_list(F.struct("s", *[f"e{i}" for i in range(len(limits))])).alias("_busy")))
    met = lambda i: lambda a, b: F.coalesce(F.exists("_busy", lambda x: F.coalesce((x[f"e{i}"] >= a) & (x["s"] <= b), F.lit(False))), F.lit(False))
    sets = [_free(lo, hi, start, years, covered, met(i)) for i in range(len(limits))]
    return _each_window(events, busy, unit, start, end, base_sets=F.array(*sets))


def placebo_events(events: DataFrame, *, start: str, end: str, min_base: int = 3) -> DataFrame:
    """Every baseline year in turn plays the event year, scored against the remaining ones."""
    rest = F.filter("base", lambda y: y != F.col("placebo_year"))
    return (events.withColumn("placebo_year", F.explode("base"))
            .withColumn("base", rest)
            .withColumn(start, same_day_in_year(start, F.col("placebo_year")))
            .withColumn(end, same_day_in_year(end, F.col("placebo_year")))
            .filter(F.col(start).isNotNull() & F.col(end).isNotNull()
                    & (F.size("base") >= min_base)))
