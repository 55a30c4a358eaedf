"""Event windows against their surroundings: baselines, disruption runs, window ranks and
activity factors.

Events carry SID, unit, start and end (dates). Windows around an event hold about a hundred
days, so per-event collections and windows are bounded by the calendar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewake.functions.binning import cut
from tidewake.functions.numeric import log_ratio, positive_part, ratio
from . import trend_fit
from .calendar import attach_daily, covered_events, event_days
from .ordered import runs
from .quantiles import exact_quantiles

HALF_DAYS, MASK_DAYS = 45, 10
INTERVAL = 0.95
MIN_LOCAL_DAYS, MIN_MEAN = 30, 1e-9
MIN_REF_WINDOWS, MIN_REF_DAYS = 20, 20
MIN_SLOPE_ROWS = 10

# flag column, measure column, upper column, and whether a flat day may belong to the recovery
PRESETS = {"lower": ("yhat_lower", "yhat_lower", "yhat_upper", False),
           "published": ("yhat_lower", "yhat", "yhat_upper", True),
           "center": ("yhat", "yhat", "yhat", False)}


def _around(panel, events, unit, day, value, half, mask):
    """Rows of every scorable event from half days before the mask to half days after it."""
    ev = covered_events(events, panel, day, "start", "end", mask)
    rows = attach_daily(event_days(ev, "start", "end", mask + half, mask + half, day),
                        panel, unit, day, [value])
    train = (F.col(day) < F.date_sub("start", mask)) | (F.col(day) > F.date_add("end", mask))
    order = Window.partitionBy("SID", unit).orderBy(day)
    follows = F.lead(day).over(order) == F.date_add(F.col(day), 1)
    return (rows.withColumn("_train", train)
            .withColumn("next_observed", F.when(follows, F.lead(value).over(order)))
            .withColumnRenamed(value, "observed"))


def local_baseline(panel: DataFrame, events: DataFrame, *, unit: str, day: str, value: str,
                   half: int = HALF_DAYS, mask: int = MASK_DAYS, interval: float = INTERVAL,
                   min_days: int = MIN_LOCAL_DAYS) -> DataFrame:
    """Curve of each event over its masked days: the median and the interval of the days
    around the mask. Columns: the event's, date, observed, next_observed, yhat, yhat_lower,
    yhat_upper."""
    rows = _around(panel, events, unit, day, value, half, mask)
    tail = (1 - interval) / 2
    fit = (rows.filter("_train").groupBy("SID", unit)
           .agg(F.count(F.lit(1)).alias("_n"), F.avg("observed").alias("_mean"),
                F.percentile("observed", F.array(F.lit(0.5), F.lit(tail), F.lit(1 - tail))).alias("_q"))
           .filter((F.col("_n") >= min_days) & (F.col("_mean") >= MIN_MEAN)))
    bound = lambda i: F.greatest(F.col("_q")[i], F.lit(0.0))
    return (rows.filter(~F.col("_train")).join(fit, ["SID", unit])
            .withColumns({"yhat": bound(0), "yhat_lower": bound(1), "yhat_upper": bound(2)})
            .drop("_train", "_n", "_mean", "_q"))


def fitted_baseline(panel: DataFrame, events: DataFrame, *, unit: str, day: str, value: str,
                    mask: int = MASK_DAYS, interval: float = INTERVAL, coefficients: str | None = None) -> DataFrame:
    """The same curve from a regression on trend, hinges and weekly and yearly waves, fitted on all days outside the mask.

    Events with fewer than trend_fit.MIN_TRAIN_DAYS training days or a mean below MIN_MEAN have no curve. Curves are kept between 0
    and twice the largest training value plus one standard deviation plus 1. coefficients: column of events with coefficients
    of an earlier fit; they are used in place of a new one.
    """
    fits = trend_fit.fit(panel, events, unit=unit, day=day, value=value, mask=mask, interval=interval, coefficients=coefficients)
    own = [c for c in events.columns if c != coefficients]
    return fits.select(*own, F.explode("curve").alias("_c")).select(*own, F.col("_c.date").alias(day), *[F.col("_c")[c].alias(c) for c in ("observed", "next_observed", "yhat", "yhat_lower", "yhat_upper")])


# ---------------------------------------------------------------- curve metrics
def _longest_run(curve, unit, day, flag: Column):
    """The longest flagged run that touches the event, the earliest of equals."""
    found = runs(curve.withColumn("_flag", F.coalesce(flag, F.lit(False))),
                 ["SID", unit, "start", "end"], day, "_flag")
    hits = found.filter((F.col("run_start") <= F.col("end")) & (F.col("run_end") >= F.col("start")))
    best = F.min_by(F.struct("run_start", "run_end", "run_days"),
                    F.struct(-F.col("run_days"), F.col("run_start")))
    return hits.groupBy("SID", unit).agg(best.alias("_run")).select("SID", unit, "_run.*")


def disruption_metrics(curve: DataFrame, *, unit: str, day: str, preset: str = "lower") -> DataFrame:
    """One row per event on the curve: dates, length, impact and recovery of its disruption.
    Events without one have NULL dates and zero impact."""
    flag, measure, _, flat_counts = PRESETS[preset]
    run = _longest_run(curve, unit, day, F.col("observed") < F.col(flag))
    inside = (curve.join(run, ["SID", unit])
              .filter(F.col(day).between(F.col("run_start"), F.col("run_end"))))
    base = F.when(F.col(measure) != 0, F.col(measure))
    kept = F.least(ratio("observed", base), F.lit(1.0))
    kept = F.when(base.isNotNull(), kept)
    change = F.col("next_observed") - F.col("observed")
    last = lambda rising: F.max(F.when(~F.coalesce(rising, F.lit(False)), F.col(day)))
    m = inside.groupBy("SID", unit).agg(
        F.first("run_start").alias("t_initial_disruption"), F.first("run_end").alias("_e"),
        F.first("run_days").alias("disruption_days"),
        last(change > 0).alias("_strict"), last(change >= 0).alias("_flat"),
        F.sum(F.when(F.col("observed") <= 0, 1).otherwise(0)).alias("days_at_zero"),
        F.coalesce(F.sum(1 - kept), F.lit(0.0)).alias("total_impact"),
        F.sum(positive_part(F.col(measure) - F.col("observed"))).alias("total_impact_value"),
        F.max(1 - kept).alias("max_impact"),
        F.sum("observed").alias("observed_in_window"), F.sum(measure).alias("baseline_in_window"))

    def rise_start(stop):
        return (F.when(F.col(stop).isNull(), F.col("t_initial_disruption"))
                .otherwise(F.least(F.date_add(F.col(stop), 1), F.col("_e"))))

    m = (m.withColumn("t_start_recovery", rise_start("_flat" if flat_counts else "_strict"))
         .withColumn("recovery_observed", (rise_start("_strict") < F.col("_e")).cast("int"))
         .withColumn("t_end_disruption", F.date_add("_e", 1))
         .withColumn("recovery_days", F.datediff("t_end_disruption", "t_start_recovery"))
         .drop("_e", "_strict", "_flat"))
    zero = ["disruption_days", "recovery_days", "recovery_observed", "days_at_zero", "total_impact",
            "total_impact_value", "max_impact"]
    return curve.select("SID", unit).distinct().join(m, ["SID", unit], "left").fillna(0, subset=zero)


def excess_metrics(curve: DataFrame, *, unit: str, day: str, preset: str = "lower") -> DataFrame:
    """Mirror image: the longest run above the upper bound."""
    upper = PRESETS[preset][2]
    run = _longest_run(curve, unit, day, F.col("observed") > F.col(upper))
    inside = (curve.join(run, ["SID", unit])
              .filter(F.col(day).between(F.col("run_start"), F.col("run_end"))))
    m = inside.groupBy("SID", unit).agg(
        F.first("run_days").alias("excess_days"),
        F.coalesce(F.sum(positive_part(ratio("observed", upper) - 1)), F.lit(0.0)).alias("total_excess"),
        F.sum(positive_part(F.col("observed") - F.col(upper))).alias("total_excess_value"))
    return (curve.select("SID", unit).distinct().join(m, ["SID", unit], "left")
            .fillna(0, subset=["excess_days", "total_excess", "total_excess_value"]))


# ---------------------------------------------------------------- window rank
def window_rank(panel: DataFrame, events: DataFrame, *, unit: str, day: str, value: str,
                half: int = HALF_DAYS, mask: int = MASK_DAYS, min_ref: int = MIN_REF_WINDOWS) -> DataFrame:
    """Rank of the event-window mean among all windows of the same length around it that stay
    clear of the mask."""
    ev = covered_events(events, panel, day, "start", "end")
    rows = attach_daily(event_days(ev, "start", "end", half, half, day), panel, unit, day, [value])
    own = F.col(day).between(F.col("start"), F.col("end"))
    packed = rows.groupBy("SID", unit, "start", "end").agg(
        F.avg(F.when(own, F.col(value))).alias("_obs"),
        F.sort_array(F.collect_list(F.struct(F.col(day).alias("d"), F.col(value).cast("double").alias("v")))).alias("_s"))
    k = F.datediff("end", "start") + 1
    sized = packed.withColumn("k_days", k).filter(F.size("_s") >= F.col("k_days"))
    mean = lambda i: F.aggregate(F.slice("_s", i, F.col("k_days")), F.lit(0.0), lambda a, x: a + x["v"]) / F.col("k_days")
    windows = F.transform(F.sequence(F.lit(1), F.size("_s") - F.col("k_days") + 1),
                          lambda i: F.struct(F.col("_s")[i - 1]["d"].alias("d"), mean(i).alias("m")))
    clear = ((F.date_add("_w.d", F.col("k_days") - 1) < F.date_sub("start", mask))
             | (F.col("_w.d") > F.date_add("end", mask)))
    ref = sized.withColumn("_w", F.explode(windows)).filter(clear).withColumn("_m", F.col("_w.m"))
    n = F.col("n_ref")
    out = ref.groupBy("SID", unit, "k_days").agg(
        F.first("_obs").alias("obs_mean"), F.count(F.lit(1)).alias("n_ref"),
        F.percentile("_m", F.array(F.lit(0.5), F.lit(0.05), F.lit(0.95))).alias("_q"),
        F.stddev_samp("_m").alias("_sd"),
        F.count_if(F.col("_m") <= F.col("_obs")).alias("_le"),
        F.count_if(F.col("_m") >= F.col("_obs")).alias("_ge"))
    return (out.filter(n >= min_ref)
            .withColumns({"ref_median": F.col("_q")[0], "ref_p05": F.col("_q")[1], "ref_p95": F.col("_q")[2]})
            .withColumn("ratio", F.when(F.col("ref_median") > 0, ratio("obs_mean", "ref_median")))
            .withColumn("z", F.when(F.col("_sd") > 0, ratio(F.col("obs_mean") - F.col("ref_median"), "_sd")))
            .withColumn("p_lower", (F.col("_le") + 1) / (n + 1))
            .withColumn("p_upper", (F.col("_ge") + 1) / (n + 1))
            .withColumn("sig_drop", (F.col("p_lower") <= 0.05).cast("int"))
            .withColumn("sig_rise", (F.col("p_upper") <= 0.05).cast("int"))
            .drop("_q", "_sd", "_le", "_ge"))


# ---------------------------------------------------------------- activity factors
FACTORS = ("vessels_present", "hours", "co2_ton")


def window_factors(panel: DataFrame, events: DataFrame, *, unit: str, day: str, gaps: DataFrame | None = None,
                   half: int = HALF_DAYS, mask: int = MASK_DAYS, min_ref_days: int = MIN_REF_DAYS,
                   keep=()) -> DataFrame:
    """Vessels per day, hours per vessel and CO2 per hour in the window against the reference
    days around it, their ratios, the gap adjustment and the CO2 shortfall. `keep` names event
    columns to carry along."""
    keep = list(keep)
    ev = covered_events(events, panel, day, "start", "end")
    rows = attach_daily(event_days(ev, "start", "end", half, half, day), panel, unit, day, FACTORS)
    win = F.col(day).between(F.col("start"), F.col("end"))
    ref = (F.col(day) < F.date_sub("start", mask)) | (F.col(day) > F.date_add("end", mask))
    rows = rows.withColumn("_role", F.when(win, "o").when(ref, "r")).filter(F.col("_role").isNotNull())
    keys = ["SID", unit, *keep]
    sums = [F.count_if(F.col("_role") == s).alias(f"_n{s}") for s in "or"]
    sums += [F.sum(F.when(F.col("_role") == s, F.col(c)).otherwise(0.0)).alias(f"_{c}{s}") for s in "or" for c in FACTORS]
    w = rows.groupBy(*keys).agg(*sums).filter(F.col("_nr") >= min_ref_days)
    if gaps is not None:
        g = gaps.groupBy(unit, day).agg(F.sum("hours_credited").alias("_c"), F.sum("hours_discarded").alias("_x"))
        part = lambda s: F.try_divide(F.sum(F.when(F.col("_role") == s, F.col("_x"))),
                                      F.sum(F.when(F.col("_role") == s, F.col("_c") + F.col("_x"))))
        d = rows.join(g, [unit, day]).groupBy("SID", unit).agg(part("o").alias("_do"), part("r").alias("_dr"))
        both = F.col("_do").isNotNull() & F.col("_dr").isNotNull()
        w = (w.join(d, ["SID", unit], "left")
             .withColumn("discard_win", F.when(both, F.col("_do"))).withColumn("discard_ref", F.when(both, F.col("_dr"))))
    else:
        w = w.withColumns({c: F.lit(None).cast("double") for c in ("discard_win", "discard_ref")})
    factor = {}
    for s in "or":
        n, v, h, c = (F.col(f"_{x}{s}") for x in ("n", *FACTORS))
        factor[s] = (v / n, F.when(v > 0, ratio(h, v)), F.when(h > 0, ratio(c, h)), c / n)
    o, r = factor["o"], factor["r"]
    over = lambda i: F.when(r[i] > 0, ratio(o[i], r[i]))
    out = w.select(*keys, F.col("_no").alias("k_days"), F.col("_nr").alias("n_ref_days"),
                   o[0].alias("N_obs"), r[0].alias("N_ref"), (o[3] * F.col("_no")).alias("co2_obs_t"),
                   (r[3] * F.col("_no")).alias("co2_ref_t"), over(0).alias("r_N"), over(1).alias("r_H"),
                   over(2).alias("r_I"), over(3).alias("r_CO2"), "discard_win", "discard_ref")
    adj = F.when(F.col("discard_win").isNull() | F.col("discard_ref").isNull(), 1.0) \
        .otherwise(ratio(1 - F.col("discard_ref"), 1 - F.col("discard_win")))
    return (out.withColumn("gap_adj", adj)
            .withColumn("r_CO2_gapadj", F.col("r_CO2") * F.col("gap_adj"))
            .withColumn("co2_shortfall_t", F.col("co2_ref_t") - F.col("co2_obs_t"))
            .withColumn("co2_shortfall_naive_t", (1 - F.col("r_N")) * F.col("co2_ref_t")))


def log_pairs(scored: DataFrame, y: str, x: str = "r_N") -> DataFrame:
    """Rows usable for a log-log fit, with _x and _y."""
    return (scored.filter((F.col(x) > 0) & (F.col(y) > 0))
            .withColumn("_x", F.ln(x)).withColumn("_y", F.ln(y)))


def log_slope(scored: DataFrame, y: str, groups=(), x: str = "r_N", min_rows: int = MIN_SLOPE_ROWS) -> DataFrame:
    """Slope of ln y on ln x per group; NULL below min_rows."""
    out = log_pairs(scored, y, x).groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), F.regr_slope("_y", "_x").alias("b"))
    return out.withColumn("b", F.when(F.col("n") >= min_rows, F.col("b")))


def factor_medians(scored: DataFrame, level: Column, min_rows: int = 1) -> DataFrame:
    """Median CO2, N, H and I ratio per level with the group size."""
    df = scored.withColumn("level", level).filter(F.col("level").isNotNull())
    names = {"r_CO2": "co2", "r_N": "n", "r_H": "h", "r_I": "i"}
    long = df.unpivot(["level"], list(names), "factor", "r")
    med = exact_quantiles(long, ["level", "factor"], "r", {"median": 0.5})
    wide = med.groupBy("level").agg(*[F.max(F.when(F.col("factor") == f, F.col("median"))).alias(f"median_{n}")
                                      for f, n in names.items()])
    size = df.groupBy("level").agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") >= min_rows)
    return size.join(wide, "level")


def distance_bin(x, width: int = 100, top: int = 500) -> Column:
    edges = list(range(0, top + 1, width))
    return cut(x, edges, [f"{a}-{b} km" for a, b in zip(edges, edges[1:])])


def shortfall_totals(scored: DataFrame, groups=()) -> DataFrame:
    """CO2 shortfall: net, suppressed, raised, and the traffic-scaled version."""
    x = F.col("co2_shortfall_t")
    return scored.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"), F.sum(x).alias("net"), F.sum(F.when(x > 0, x).otherwise(0.0)).alias("suppressed"),
        F.sum(F.when(x < 0, -x).otherwise(0.0)).alias("raised"), F.sum("co2_shortfall_naive_t").alias("traffic_scaled"))


def placebo_verdict(real: DataFrame, shifted: DataFrame) -> DataFrame:
    """Place the real slope `b` among the slopes of the shifted windows."""
    bounds = shifted.filter(F.col("b").isNotNull()).agg(
        F.struct(F.min("b").alias("lo"), F.max("b").alias("hi"), F.count("b").alias("n"))).scalar()
    return (real.select("b").withColumn("_p", bounds)
            .select("b", F.col("_p.lo").alias("placebo_lo"), F.col("_p.hi").alias("placebo_hi"), F.col("_p.n").alias("n_shifts"),
                    F.when(F.col("b") > F.col("_p.hi"), "above").when(F.col("b") < F.col("_p.lo"), "below")
                    .otherwise("inside").alias("verdict")))
