"""Panels and exposures to scored, reconciled events."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tidewake.functions.binning import cut
from tidewake.functions.dates import ceil_day
from tidewake.operators import calendar as cal, normal as nm

ZONE_MEASURES = ["hours", "co2_ton", "fc_main_ton", "fc_AE_ton", "fc_boiler_ton"]
SULFUR_MEASURES = ["so2_air_ton", "so2_washwater_ton"]
CALL_MEASURES = ["port_calls", "vessels_present"]
SERIES = ["vclass", "tier", "measure"]
# fixed values: Caribbean and Great Lakes ports left out of the study sample
EXCLUDED_PORTS = ["Guayama, PR", "Guaynabo, PR", "San Juan, PR", "Virgin Islands - St. Croix, VI", "Green Bay, WI",
                  "Illinois International Port, IL", "Marquette, MI", "Milwaukee, WI", "Mueller Township, MI"]


def all_series(zones: DataFrame, sulfur: DataFrame | None = None, calls: DataFrame | None = None) -> DataFrame:
    """Long daily series: unit, date, vclass, tier, measure, value.

    zones: unit, date, vclass, tier and the zone measures; sulfur: unit, date, tier, SO2 and
    n_vessels_in_cell; calls: unit, date, port_calls, vessels_present.
    """
    parts = [nm.rollup_series(zones.select("unit", "date", "vclass", "tier", *ZONE_MEASURES), ["unit", "date"],
                              {"vclass": nm.ALL, "tier": nm.TOTAL}, ZONE_MEASURES)]
    if sulfur is not None:
        t = nm.tier_series(sulfur, ["unit", "date"], "tier", SULFUR_MEASURES,
                           ["n_vessels_in_cell"] if "n_vessels_in_cell" in sulfur.columns else [])
        parts.append(t.withColumn("vclass", F.lit(nm.ALL)))
    if calls is not None:
        c = calls.select("unit", "date", *[F.col(m).cast("double").alias(m) for m in CALL_MEASURES])
        parts.append(c.unpivot(["unit", "date"], CALL_MEASURES, "measure", "value")
                     .withColumn("vclass", F.lit(nm.ALL)).withColumn("tier", F.lit("port")))
    cols = ["unit", "date", *SERIES, "value"]
    return reduce(lambda a, b: a.unionByName(b), [p.select(*cols) for p in parts])


def with_covariates(exposures: DataFrame, covariates: DataFrame, on=("SID", "unit")) -> DataFrame:
    """Attach the observed surge, wind and rain of each exposure, NULL where none was observed."""
    cols = ["surge_height_m", "max_wind_ms", "rainfall_mm"]
    return exposures.join(covariates.select(*on, *cols), list(on), "left")


def score(series: DataFrame, exposures: DataFrame, *, first: date, last: date, years, opts: dict | None = None,
          placebo: bool = False, keep_series=None, exclude_units=()) -> tuple[DataFrame, DataFrame, dict]:
    """(window results, daily results, options) of all eligible events.

    exposures: SID, unit, exposure_start, exposure_end, dist, wind, wind_at_closest and any other
    event columns. exclude_units: units to leave out, such as EXCLUDED_PORTS. keep_series filters the series that are scored (a column expression).
    """
    o = nm.options(**(opts or {}))
    ex = (exposures.withColumn("start", F.to_date("exposure_start")).withColumn("end", F.to_date("exposure_end")))
    near = ex.filter(F.col("dist") <= o["excl_km"])
    chosen = nm.select_events(ex, o, list(exclude_units))
    based = cal.baseline_years(chosen, near, unit="unit", start="start", end="end", x_start=ceil_day("exposure_start"),
                               x_end="end", years=years, pre=o["pre"], post=o["post"], covered=(first, last))
    arrays = nm.series_arrays(series, ["unit", *SERIES], "date", "value", first, last)
    floor = arrays.filter((F.col("vclass") == nm.ALL) & (F.col("tier") == nm.TOTAL) & (F.col("measure") == "co2_ton")).select("unit", "values")
    ev = nm.active_events(based, floor, o, first)
    if placebo:
        ev = cal.placebo_events(ev, start="start", end="end", min_base=o["min_base"])
    else:
        ev = ev.withColumn("placebo_year", F.lit(None).cast("int"))
    used = arrays if keep_series is None else arrays.filter(keep_series)
    each = lambda scores: nm.by_window(ev, lambda w: scores(nm.normal_arrays(w, used, o, first), o))
    results = each(nm.phase_scores).withColumn(
        "intensity", cut("wind_at_closest", nm.INTENSITY_EDGES, nm.INTENSITY_LABELS))
    return results, each(nm.daily_scores), o


def reconciled(results: DataFrame, daily: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables with the class normals scaled to the all-ship normal of their zone."""
    key = F.coalesce("placebo_year", F.lit(0))
    keys = ["SID", "unit", "_py", "tier"]
    r, d = results.withColumn("_py", key), daily.withColumn("_py", key)
    factors = nm.class_factors(r, keys)
    return nm.reconcile(r, factors, keys).drop("_py"), nm.reconcile(d, factors, keys).drop("_py")


def variants(series: DataFrame, exposures: DataFrame, keep_series, *, first: date, last: date, years, opts: dict | None = None,
             exclude_units=(), named: dict | None = None) -> DataFrame:
    """Window results of every alternative normal, with a `variant` column: options are rows that meet each event, so one
    join with the series and one scoring plan serve all of them. Arguments as in score; named: other variants than nm.VARIANTS."""
    rows, o, limits = nm.variant_options(opts or {}, named or nm.VARIANTS)
    ex = exposures.withColumn("start", F.to_date("exposure_start")).withColumn("end", F.to_date("exposure_end"))
    chosen = nm.select_events(ex, o, list(exclude_units))
    based = cal.baseline_sets(chosen, ex, limits, unit="unit", start="start", end="end", x_start=ceil_day("exposure_start"), x_end="end", years=years,
                              pre=o["pre"], post=o["post"], covered=(first, last))
    each = based.withColumn("_o", F.explode(rows)).select(*based.columns, "_o.*").withColumn("base", F.get("base_sets", F.col("_excl"))).drop("base_sets")
    arrays = nm.series_arrays(series, ["unit", *SERIES], "date", "value", first, last)
    floor = arrays.filter((F.col("vclass") == nm.ALL) & (F.col("tier") == nm.TOTAL) & (F.col("measure") == "co2_ton")).select("unit", "values")
    ev = nm.active_events(each, floor, o, first)
    used = arrays if keep_series is None else arrays.filter(keep_series)
    scores = nm.by_window(ev, lambda w: nm.phase_scores(nm.normal_arrays(w, used, o, first), o))
    return scores.drop(*nm.OPTION_COLUMNS).withColumn("intensity", cut("wind_at_closest", nm.INTENSITY_EDGES, nm.INTENSITY_LABELS))
