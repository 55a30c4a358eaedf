"""Event-study products: pooled tables, recovery, efficiency, scenarios, classification."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewake.functions.binning import cut, first_match
from tidewake.functions.numeric import as_col, log_ratio, positive_part, ratio
from .emission import CO2_PER_FUEL, POLLUTANTS
from .normal import ALL, TIERS, TOTAL, window_table
from .quantiles import exact_quantiles
from .resample import bootstrap, boot_ratio, excess_over_rate, ratio_of_ratios, topk_share
from .sizing import checkpointed

# ---- fixed values ------------------------------------------------------------
DISTANCE_EDGES, DISTANCE_LABELS = [0, 50, 100, 200], ["≤50 km", "50–100 km", "100–200 km"]
WIDE_DISTANCE_EDGES, WIDE_DISTANCE_LABELS = [-1, 50, 100, 201], ["<50 km", "50–100 km", "100–200 km"]
DURATION_EDGES, DURATION_LABELS = [0, 2, 4, 99], ["1–2 days", "3–4 days", "≥5 days"]
WIND_EDGES = [0, 30, 40, 50, 64, 83, 96, 200]
WIND_LABELS = ["<30", "30–39", "40–49", "50–63", "64–82 (Cat1)", "83–95 (Cat2)", "≥96 (Cat3+)"]
WAITING_ZONES = ["anchorage", "offshore_hold"]
OUTER_ZONES = ["anchorage", "offshore_hold", "offshore"]
QUEUE_CLASSES = ["tanker", "cargo"]
RECOVERY_DAYS = (10, 20, 30, 45)
SPEED_FLOOR = 0.6
APPROACH_HOURS, WAIT_HOURS, FUEL_PRICES = (24, 72, 120), (12, 24, 48), (450, 650, 900)
CARBON_VALUES = (51, 190)
CLASS_NAMES = ["no response", "coupled", "relative (amplified)", "relative (damped)", "absolute", "no data"]
MIN_HOURS_DAY, BAND_FLOOR = 24, 0.02
STATE_COAST = {"TX": "Gulf", "LA": "Gulf", "MS": "Gulf", "AL": "Gulf", "PR": "Caribbean", "VI": "Caribbean",
               "MI": "Great Lakes", "WI": "Great Lakes", "IL": "Great Lakes"}
GULF_FLORIDA = ["Tampa", "Manatee", "Panama City"]
GULF_STATES = ["TX", "LA", "MS", "AL", "FL"]
# sample counts and storm-window CO2 ratios of the published study
PUBLISHED_COUNTS = {"events": 344, "ports": 47, "storms": 48}
PUBLISHED_RATIOS = {"Tropical storm <50 kt": 0.82, "Strong TS 50–63 kt": 0.73, "Hurricane ≥64 kt": 0.47}


# ---------------------------------------------------------------- labels
def coast(port) -> Column:
    """Coast of a port name from its state; western Florida is on the Gulf."""
    p = as_col(port)
    tail = F.trim(F.element_at(F.split(F.replace(p, F.lit(", Port of"), F.lit("")), ","), -1))
    state = F.substring(tail, 1, 2)
    west = reduce(lambda a, b: a | b, [p.contains(x) for x in GULF_FLORIDA])
    rules = [(p.startswith("Virgin Islands"), "Caribbean"), ((state == "FL") & west, "Gulf"), (state == "FL", "Atlantic")]
    return first_match(rules + [(state == s, c) for s, c in STATE_COAST.items()], "Atlantic")


def coast_group(coast_name) -> Column:
    """The two big coasts, the others together."""
    c = as_col(coast_name)
    return F.when(c.isin("Gulf", "Atlantic"), c).otherwise("Caribbean / Great Lakes")


def gulf_or_other(port) -> Column:
    state = F.regexp_extract(as_col(port), r",\s*([A-Z]{2})\b", 1)
    return F.when(state.isin(*GULF_STATES), "Gulf/SE").otherwise("other")


def period(season) -> Column:
    return F.when(as_col(season) <= 2019, "2015–2019").otherwise("2020–2023")


def port_type(tanker, other, cargo) -> Column:
    return first_match([(as_col(tanker) >= .55, "Energy"), (as_col(other) >= .40, "Service"),
                        (as_col(cargo) >= .50, "Cargo")], "Mixed")


def layout(open_share, wait_share) -> Column:
    return first_match([(as_col(open_share) < .05, "River / inland"), (as_col(wait_share) >= .15, "Coastal, anchorage")],
                       "Open coast")


# ---------------------------------------------------------------- pooled ratios
def pooled_ratios(results: DataFrame, keys, *, cluster: str = "SID", min_events: int = 5, **kw) -> DataFrame:
    """Ratio of sums per key with its interval, event count, net change and the share of events
    outside their baseline range."""
    keys = list(keys)
    size = results.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("delta").alias("delta"),
                                      F.avg(F.col("outside").cast("double")).alias("share_outside"))
    return size.filter(F.col("n") >= min_events).join(boot_ratio(results, keys, cluster, "obs", "expected", **kw), keys)


def by_groupings(df: DataFrame, groupings: dict, total: str | None = None) -> DataFrame:
    """Rows once per grouping with columns grouping and level, so that many groupings become one
    aggregate. NULL levels are left out."""
    pairs = [F.struct(F.lit(n).alias("grouping"), as_col(c).cast("string").alias("level")) for n, c in groupings.items()]
    if total:
        pairs.append(F.struct(F.lit("all").alias("grouping"), F.lit(total).alias("level")))
    return (df.withColumn("_g", F.explode(F.array(*pairs))).filter(F.col("_g.level").isNotNull())
            .select("*", "_g.grouping", "_g.level").drop("_g"))


def class_counts(events: DataFrame, keys, cls: str, classes=CLASS_NAMES) -> DataFrame:
    """Number of events of each class per key, one column per class."""
    return events.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(cls) == c).alias(c) for c in classes])


def class_shares(events: DataFrame, keys, cls: str, classes=CLASS_NAMES) -> DataFrame:
    """Shares of the classes per key (the false-positive rates when the events are placebos)."""
    return events.groupBy(*keys).agg(*[(F.count_if(F.col(cls) == c) / F.count(F.lit(1))).alias(c) for c in classes])


def any_zone(events: DataFrame, pair, keys, cls: str, value: str = "absolute", zone: str = "zone") -> DataFrame:
    """Events with the class in at least one zone, counted per key."""
    per = (events.filter(F.col(zone) != TOTAL).groupBy(*pair, *keys)
           .agg(F.bool_or(F.col(cls) == value).alias("_any")))
    return per.groupBy(*keys).agg(F.count_if("_any").alias("n_any"), F.count(F.lit(1)).alias("n_events"))


def category_summary(metrics: DataFrame, category, impact: str, recovery: str = "recovery_days") -> DataFrame:
    """Events, share with an impact, mean impact and recovery per category; NULL is dropped."""
    return (metrics.withColumn("category", as_col(category)).filter(F.col("category").isNotNull())
            .groupBy("category").agg(F.count(F.lit(1)).alias("n"),
                                     F.avg((F.col(impact) > 0).cast("double")).alias("disrupted"),
                                     F.avg(impact).alias("mean_impact"), F.avg(recovery).alias("mean_recovery")))


def category_step(summary: DataFrame, low: int = 3, high: int = 4) -> DataFrame:
    """Mean impact of one category over another; a step when above 1.5."""
    at = lambda c: F.max(F.when(F.col("category") == c, F.col("mean_impact")))
    return summary.agg(ratio(at(high), at(low)).alias("jump")).withColumn("is_step", F.col("jump") > 1.5)


# ---------------------------------------------------------------- recovery
def recovery(daily: DataFrame, pair, horizons=RECOVERY_DAYS) -> DataFrame:
    """Loss up to the end of the storm window, how much of it was offset in other zones at the
    time, and what came back within each horizon; per event, class and measure."""
    k, rel = F.col("k_days"), F.col("rel_day")
    x = F.col("obs") - F.col("expected")
    early = rel <= k - 1
    whole = F.col("tier") == TOTAL
    keys = [*pair, "vclass", "measure"]
    zone = (daily.filter(~whole & F.col("tier").isin(*TIERS)).groupBy(*keys, "tier")
            .agg(F.sum(F.when(early, x).otherwise(0.0)).alias("_x"))
            .groupBy(*keys).agg(F.sum(positive_part(-F.col("_x"))).alias("gross"), F.sum(positive_part("_x")).alias("moved")))
    total = daily.filter(whole).groupBy(*keys).agg(
        (-F.sum(F.when(early, x).otherwise(0.0))).alias("loss"),
        *[F.sum(F.when((rel >= k) & (rel <= k + n - 1), x).otherwise(0.0)).alias(f"rec{n}") for n in horizons])
    return total.join(zone, keys, "left").fillna(0.0, ["gross", "moved"])


def recovery_pooled(pairs: DataFrame, keys, *, cluster: str = "SID", min_events: int = 5,
                    horizons=RECOVERY_DAYS, **kw) -> DataFrame:
    """Percent of the loss moved and recovered, pooled over events that lost."""
    lost = pairs.filter(F.col("loss") > 0)
    stats = {f"rec{n}_pct": (lambda n: lambda c: 100 * ratio(c(f"rec{n}"), c("loss")))(n) for n in horizons}
    stats["moved_pct"] = lambda c: 100 * ratio(c("moved"), c("gross"))
    size = lost.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("loss").alias("loss")).filter(F.col("n") >= min_events)
    sums = ["loss", "gross", "moved", *[f"rec{n}" for n in horizons]]
    return size.join(bootstrap(lost, keys, cluster, sums, stats, **kw), list(keys))


# ---------------------------------------------------------------- efficiency
ENGINES = {"fc_main_ton": "main", "fc_AE_ton": "aux", "fc_boiler_ton": "boiler"}


def wide_measures(rows: DataFrame, keys, measures, kinds=(("obs", "obs"), ("exp", "expected"))) -> DataFrame:
    """One row per key with <kind>_<measure> sums."""
    return rows.groupBy(*keys).agg(*[F.sum(F.when(F.col("measure") == m, F.col(c)).otherwise(0.0)).alias(f"{k}_{m}")
                                     for k, c in kinds for m in measures])


def engine_intensity(wide: DataFrame, keys, *, cluster: str = "SID", min_events: int = 5, **kw) -> DataFrame:
    """Hours ratio, fuel per hour by engine against normal, and each engine's share of the extra
    fuel. wide: keys, cluster, obs_* and exp_* of hours and the fuel measures."""
    keys = list(keys)
    rows = wide.filter(F.col("exp_hours") > 0)
    stats = {"hours_ratio": lambda c: ratio(c("obs_hours"), c("exp_hours"))}
    extra = lambda c, f: c(f"obs_{f}") - c(f"exp_{f}")
    for f, name in ENGINES.items():
        stats[f"{name}_per_hour"] = ratio_of_ratios(f"obs_{f}", "obs_hours", f"exp_{f}", "exp_hours")
        stats[f"{name}_extra_share"] = (lambda f: lambda c: ratio(extra(c, f), sum(extra(c, g) for g in ENGINES)))(f)
    size = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_events)
    sums = [f"{k}_{m}" for k in ("obs", "exp") for m in ("hours", *ENGINES)]
    return size.join(bootstrap(rows, keys, cluster, sums, stats, **kw), keys)


def efficiency(events: DataFrame, keys, *, cluster: str = "SID", **kw) -> DataFrame:
    """Pooled activity, CO2, CO2 per call, waiting hours per call, the disruption penalty and the
    split of the ln change into activity and efficiency.

    events: keys, cluster, obs_/exp_ of calls, co2 and wait_hours; rows need a positive normal.
    """
    keys = list(keys)
    rows = events.filter((F.col("exp_calls") > 0) & (F.col("exp_co2") > 0))
    stats = {"calls": lambda c: ratio(c("obs_calls"), c("exp_calls")),
             "co2": lambda c: ratio(c("obs_co2"), c("exp_co2")),
             "co2_per_call": ratio_of_ratios("obs_co2", "obs_calls", "exp_co2", "exp_calls"),
             "wait_per_call": ratio_of_ratios("obs_wait_hours", "obs_calls", "exp_wait_hours", "exp_calls"),
             "penalty": excess_over_rate("obs_co2", "obs_calls", "exp_co2", "exp_calls")}
    sums = [f"{k}_{m}" for k in ("obs", "exp") for m in ("calls", "co2", "wait_hours")]
    out = bootstrap(rows, keys, cluster, sums, stats, **kw)
    whole = log_ratio("co2", F.lit(1.0))
    return (out.withColumn("activity_share", ratio(log_ratio("calls", F.lit(1.0)), whole))
            .withColumn("efficiency_share", ratio(log_ratio("co2_per_call", F.lit(1.0)), whole)))


# ---------------------------------------------------------------- arrival management
def saving_per_hour(approach, wait) -> Column:
    """Main-engine saving per waiting hour when a ship slows down instead of waiting: fuel per
    distance goes with speed squared, and speed has a floor."""
    t, w = as_col(approach).cast("double"), as_col(wait).cast("double")
    r = F.greatest(t / (t + w), F.lit(SPEED_FLOOR))
    return t * (1 - r * r) / w


def queue_pairs(daily: DataFrame, pair, windows=("queue", "event30")) -> DataFrame:
    """Net excess waiting hours and fuel per event, window and class, and the normal open-water
    main fuel per hour (the class median where an event has none)."""
    w = window_table(daily.filter(F.col("vclass").isin(*QUEUE_CLASSES)), windows)
    waiting, fuel = F.col("tier").isin(*WAITING_ZONES), F.col("measure").isin(*ENGINES)
    hours, open_water = F.col("measure") == "hours", F.col("tier") == "offshore"
    total = lambda cond, c: F.sum(F.when(cond, F.col(c)).otherwise(0.0))
    s = w.groupBy(*pair, "window", "vclass").agg(
        total(waiting & hours, "obs").alias("wait_h_obs"), total(waiting & hours, "expected").alias("wait_h_exp"),
        (total(waiting & fuel, "obs") - total(waiting & fuel, "expected")).alias("net_excess_wait_fuel_t"),
        total(open_water & hours, "expected").alias("_h"),
        total(open_water & (F.col("measure") == "fc_main_ton"), "expected").alias("_f"))
    s = (s.withColumn("net_excess_wait_h", F.col("wait_h_obs") - F.col("wait_h_exp"))
         .withColumn("f_main_t_per_h", F.when(F.col("_h") > 0, ratio("_f", "_h"))).drop("_h", "_f"))
    return impute_group_median(checkpointed(s), ["vclass"], "f_main_t_per_h")


def impute_group_median(df: DataFrame, keys, value: str) -> DataFrame:
    """Fill missing values with the exact median of the group."""
    med = exact_quantiles(df, keys, value, {"_median": 0.5})
    return df.join(med, list(keys), "left").withColumn(value, F.coalesce(F.col(value), F.col("_median"))).drop("_median")


def arrival_scenarios(queue: DataFrame, keys, *, cluster: str = "SID", pair=("SID", "unit"), draws: int = 1000,
                      seed: int = 1, total: str | None = None) -> DataFrame:
    """Fuel, CO2 and money saved per scenario of approach length, wait and fuel price. Excess
    waiting is pooled over events and only then floored at zero. W_h -1 marks the upper bound,
    two hours' worth of fuel per waiting hour. total: name of a level of the last key that pools all of its levels."""
    keys = list(keys)
    if total is not None:
        queue = queue.unionByName(queue.withColumn(keys[-1], F.lit(total)))
    d = queue.withColumn("_fh", F.col("net_excess_wait_h") * F.col("f_main_t_per_h"))
    sums = ["net_excess_wait_h", "_fh", "net_excess_wait_fuel_t"]
    pool = bootstrap(d, keys, cluster, sums, {"h": lambda c: c("net_excess_wait_h"), "fh": lambda c: c("_fh"),
                                              "hotel": lambda c: c("net_excess_wait_fuel_t")}, draws=draws, seed=seed)
    size = d.groupBy(*keys).agg(F.count_distinct(F.struct(*pair)).alias("n_pairs"))
    grid = [F.struct(F.lit(t).alias("T_h"), F.lit(w).alias("W_h"), F.lit(p).alias("fuel_price"))
            for t in APPROACH_HOURS for w in (*WAIT_HOURS, -1) for p in FUEL_PRICES]
    s = pool.join(size, keys).withColumn("_g", F.explode(F.array(*grid))).select("*", "_g.*").drop("_g")
    per_h = F.when(F.col("W_h") < 0, F.lit(2.0)).otherwise(saving_per_hour("T_h", F.when(F.col("W_h") > 0, F.col("W_h"))))
    s = s.withColumn("_per", per_h).withColumn("fuel_saved_t", positive_part("fh") * F.col("_per"))
    co2 = F.col("fuel_saved_t") * CO2_PER_FUEL
    return s.select(*keys, "n_pairs", positive_part("h").alias("net_excess_wait_h"), F.col("h_lo").alias("wait_h_lo"),
                    F.col("h_hi").alias("wait_h_hi"), positive_part("hotel").alias("relocated_hotel_fuel_t"), "T_h", "W_h",
                    "fuel_price", "fuel_saved_t", co2.alias("co2_saved_t"),
                    (positive_part("fh_lo") * F.col("_per") * CO2_PER_FUEL).alias("co2_lo"),
                    (positive_part("fh_hi") * F.col("_per") * CO2_PER_FUEL).alias("co2_hi"),
                    (F.col("fuel_saved_t") * F.col("fuel_price")).alias("fuel_cost_saved_usd"),
                    *[(co2 * v).alias(f"scc{v}_usd") for v in CARBON_VALUES])


# ---------------------------------------------------------------- divergence
def divergence(sums: DataFrame, ln=F.ln) -> DataFrame:
    """Log responses and gaps of window sums with k_days: lh, lc, ln, g, g_nox, days, size, ld,
    hours_day. ln: the logarithm of the responses; pass numeric.nearest_ln where gaps are ranked or tied."""
    w, k = F.col("window"), F.col("k_days")
    days = F.when(w == "storm", k).when(w == "after", 10).when(w == "prep", 2).otherwise(k + 32)
    return (sums.withColumn("lh", log_ratio("obs_hours", "exp_hours", ln)).withColumn("lc", log_ratio("obs_co2", "exp_co2", ln))
            .withColumn("ln", log_ratio("obs_nox", "exp_nox", ln))
            .withColumn("g", F.col("lc") - F.col("lh")).withColumn("g_nox", F.col("ln") - F.col("lh"))
            .withColumn("days", days).withColumn("size", log_ratio(F.col("exp_co2") / F.col("days"), F.lit(1.0)))
            .withColumn("ld", F.ln("days")).withColumn("hours_day", F.col("exp_hours") / F.col("days")))


# fixed values: output names of the bands
BAND_NAMES = {"lh": "tau_h", "lc": "tau_c", "ln": "tau_n", "g": "tau_g", "g_nox": "tau_gn"}


def band_inputs(placebo: DataFrame) -> DataFrame:
    """Long |response| rows of the placebo events that are large enough: window, zone, measure,
    a, size, ld."""
    rows = placebo.filter(F.col("hours_day") >= MIN_HOURS_DAY)
    return (rows.unpivot(["window", "zone", "size", "ld"], list(BAND_NAMES), "measure", "_v")
            .withColumn("a", F.abs("_v")).drop("_v"))


def apply_bands(events: DataFrame, bands: DataFrame) -> DataFrame:
    """Add one noise band per measure from the coefficients (window, zone, measure, intercept,
    size, ld); never below the floor."""
    coef = F.struct("intercept", F.col("size").alias("s"), F.col("ld").alias("l"))
    wide = bands.groupBy("window", "zone").agg(*[F.max(F.when(F.col("measure") == m, coef)).alias(f"_{m}") for m in BAND_NAMES])
    out = events.join(wide, ["window", "zone"], "left")
    for m, name in BAND_NAMES.items():
        v = F.col(f"_{m}.intercept") + F.col(f"_{m}.s") * F.col("size") + F.col(f"_{m}.l") * F.col("ld")
        out = out.withColumn(name, F.when(v.isNotNull(), F.greatest(v, F.lit(BAND_FLOOR))))
    return out.drop(*[f"_{m}" for m in BAND_NAMES])


def classify_divergence(events: DataFrame, out: str = "cls", env: str = "lc", gap: str = "g") -> DataFrame:
    """Class of each event: no response, coupled, relative (amplified or damped), absolute, or no
    data where the normal is too thin or undefined."""
    lh, le, g = F.abs("lh"), F.abs(env), F.abs(gap)
    th, te, tg = F.col("tau_h"), F.col(BAND_NAMES[env]), F.col(BAND_NAMES[gap])
    ok = F.col("lh").isNotNull() & F.col(env).isNotNull() & th.isNotNull() & (F.col("hours_day") >= MIN_HOURS_DAY)
    quiet = (lh <= th) & F.coalesce(le <= te, F.lit(False))
    opposite = (lh > th) & F.coalesce(le > te, F.lit(False)) & (F.signum("lh") != F.signum(env))
    return events.withColumn(out, first_match(
        [(~F.coalesce(ok, F.lit(False)), "no data"), (quiet, "no response"), (F.coalesce(g <= tg, F.lit(False)), "coupled"),
         (opposite, "absolute"), (le > lh, "relative (amplified)")], "relative (damped)"))


def detected_changes(real: DataFrame, placebo: DataFrame, keys, measures=("lc", "ln", "lh")) -> DataFrame:
    """Events beyond their band upwards and downwards, against what placebo dates lead to expect."""
    def long(df):
        pairs = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("x"), F.col(BAND_NAMES[m]).alias("t")) for m in measures])
        return (df.withColumn("_p", F.explode(pairs)).select(*keys, "_p.*")
                .withColumn("up", (F.col("x") > F.col("t"))).withColumn("down", F.col("x") < -F.col("t")))
    on = [*keys, "measure"]
    r = long(real).groupBy(*on).agg(F.count(F.lit(1)).alias("n"), F.count_if("up").alias("sig_up"), F.count_if("down").alias("sig_down"),
                                    (F.count_if(F.col("x") > 0) / F.count(F.lit(1))).alias("share_above"))
    p = long(placebo).groupBy(*on).agg((F.count_if("up") / F.count(F.lit(1))).alias("_u"), (F.count_if("down") / F.count(F.lit(1))).alias("_d"))
    return (r.join(p, on, "left").withColumn("expected_up", F.col("_u") * F.col("n"))
            .withColumn("expected_down", F.col("_d") * F.col("n")).drop("_u", "_d"))


def significant_events(events: DataFrame, columns, env: str = "lc") -> DataFrame:
    """Events beyond their band with the direction of the change."""
    x, t = F.col(env), F.col(BAND_NAMES[env])
    return (events.withColumn("direction", F.when(x > t, "net increase").when(x < -t, "net decrease"))
            .filter(F.col("direction").isNotNull()).select(*columns, "direction"))


def gap_summary(events: DataFrame, keys, gap: str = "g", band: str = "tau_g") -> DataFrame:
    """n, mean, sd, median, quartile range of the gap and the share beyond its band."""
    rows = events.filter(F.col(gap).isNotNull())
    base = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(gap).alias("mean"), F.stddev_samp(gap).alias("sd"),
                                   (F.count_if(F.abs(gap) > F.col(band)) / F.count(F.lit(1))).alias("share_beyond"))
    q = exact_quantiles(rows, keys, gap, {"median": 0.5, "_q1": 0.25, "_q3": 0.75})
    return base.join(q, list(keys)).withColumn("iqr", F.col("_q3") - F.col("_q1")).drop("_q1", "_q3")


# ---------------------------------------------------------------- ports
def port_traits(daily: DataFrame, pair, unit: str) -> DataFrame:
    """Class and zone shares of the normal CO2 of a port over its events, its type and layout."""
    rows = window_table(daily.filter(F.col("measure") == "co2_ton"), ["event30"])
    v, t = F.col("vclass"), F.col("tier")
    take = lambda cond: F.sum(F.when(cond, F.col("expected")).otherwise(0.0))
    classes = ["tanker", "cargo", "passenger", "other", ALL]
    s = rows.groupBy(unit).agg(*[take((v == c) & (t == TOTAL)).alias(c) for c in classes],
                               *[take((v == ALL) & (t == z)).alias(f"z_{z}") for z in TIERS])
    days = (rows.select(*dict.fromkeys([*pair, unit, "k_days", "rel_day"])).distinct().groupBy(unit).agg(F.count(F.lit(1)).alias("days")))
    s = s.join(days, unit)
    for c in classes[:-1]:
        s = s.withColumn(f"{c}_sh", ratio(c, ALL))
    s = (s.withColumn("inner_sh", ratio(F.col("z_port") + F.col("z_channel"), ALL))
         .withColumn("wait_sh", ratio(F.col("z_anchorage") + F.col("z_offshore_hold"), ALL))
         .withColumn("open_sh", ratio("z_offshore", ALL)).withColumn("size", log_ratio(ALL, "days")))
    return (s.withColumn("port_type", port_type("tanker_sh", "other_sh", "cargo_sh"))
            .withColumn("layout", layout("open_sh", "wait_sh")))


def map_table(traits: DataFrame, events: DataFrame, queue: DataFrame, unit: str, strong: str,
              waiting: str = "x_wait_co2") -> DataFrame:
    """Per port: normal CO2 per day, events, strong events, and its share of the positive excess
    waiting CO2."""
    n = events.groupBy(unit).agg(F.count(F.lit(1)).alias("n_events"), F.count_if(F.col("intensity") == strong).alias("n_strong"))
    q = (queue.filter(F.col("intensity") == strong).groupBy(unit).agg(F.sum(waiting).alias("_w"))
         .withColumn("_w", positive_part("_w")))
    share = ratio(F.col("_w"), q.agg(F.sum("_w")).scalar())
    return (traits.withColumn("co2_day", ratio(ALL, "days")).select(unit, "port_type", "size", "co2_day")
            .join(n, unit, "left").join(q, unit, "left")
            .withColumn("queue_share", F.coalesce(share, F.lit(0.0))).drop("_w").fillna(0, ["n_events", "n_strong"]))


def excess_per_pair_year(rows: DataFrame, keys, pair_year) -> DataFrame:
    """Sum of the deltas per distinct pair-year."""
    return rows.groupBy(*keys).agg(F.count_distinct(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in pair_year])).alias("pair_years"),
                                   F.sum("delta").alias("net_excess")) \
        .withColumn("net_excess_per_pair_year", ratio("net_excess", "pair_years"))


def outer_share(zone_sums: DataFrame, keys, pollutants=("co2", *POLLUTANTS)) -> DataFrame:
    """Per pollutant: pooled ratio, share of the change outside berths and channels, and the
    anchorage ratio. zone_sums: keys, zone, obs_<p>, exp_<p>."""
    pairs = F.array(*[F.struct(F.lit(p).alias("pollutant"), F.col(f"obs_{p}").alias("o"),
                               F.coalesce(F.col(f"exp_{p}"), F.lit(0.0)).alias("e")) for p in pollutants])
    long = zone_sums.filter(F.col("zone").isin(*TIERS)).withColumn("_p", F.explode(pairs)).select(*keys, "zone", "_p.*")
    take = lambda cond, c: F.sum(F.when(cond, F.col(c)).otherwise(0.0))
    anchorage, outer = F.col("zone") == "anchorage", F.col("zone").isin(*OUTER_ZONES)
    d = F.col("o") - F.col("e")
    return long.groupBy(*keys, "pollutant").agg(
        ratio(F.sum("o"), F.sum("e")).alias("ratio"),
        ratio(F.sum(F.when(outer, d).otherwise(0.0)), F.sum(d)).alias("share_outside"),
        ratio(take(anchorage, "o"), take(anchorage, "e")).alias("anchorage_ratio"))


def coast_type_ratios(window_rows: DataFrame, measures=("co2", "hours"), *, coast_col: str = "coast", type_col: str = "port_type",
                      strong=None, cluster: str = "SID", **kw) -> DataFrame:
    """Pooled ratios per coast, port type and window, for the given intensity classes only."""
    rows = window_rows if strong is None else window_rows.filter(F.col("intensity").isin(*strong))
    stats = {m: (lambda m: lambda c: ratio(c(f"obs_{m}"), c(f"exp_{m}")))(m) for m in measures}
    return bootstrap(rows, [coast_col, type_col, "window"], cluster, [f"{k}_{m}" for m in measures for k in ("obs", "exp")], stats, **kw)


def zone_ratios(zone_sums: DataFrame, keys, measures, *, cluster: str = "SID", **kw) -> DataFrame:
    """Ratio per key and zone with clusters that miss a zone counted as zero there, plus the
    zone's share of the normal CO2."""
    keys = list(keys)
    rows = zone_sums.filter(F.col("zone").isin(*TIERS))
    sums = [f"{k}_{m}" for m in measures for k in ("obs", "exp")]
    per = rows.groupBy(*keys, cluster, "zone").agg(*[F.sum(c).alias(c) for c in sums])
    full = (rows.select(*keys, cluster).distinct().withColumn("zone", F.explode(F.array(*[F.lit(z) for z in TIERS])))
            .join(per, [*keys, cluster, "zone"], "left").fillna(0.0, sums))
    stats = {m: (lambda m: lambda c: ratio(c(f"obs_{m}"), c(f"exp_{m}")))(m) for m in measures}
    return bootstrap(full, [*keys, "zone"], cluster, sums, stats, **kw)


# ---------------------------------------------------------------- targeting and claims
def targeting(daily: DataFrame, queue: DataFrame, pair) -> DataFrame:
    """Excess waiting CO2 and NOx per event in the ten days after, the change over all zones, and
    what arrival management (72 h approach, 24 h wait) would avoid."""
    from .emission import pollutant_ton
    pair = list(pair)
    w = window_table(daily, ["queue"])
    v, t, m = F.col("vclass"), F.col("tier"), F.col("measure")
    d = F.col("obs") - F.col("expected")
    waiting = v.isin(*QUEUE_CLASSES) & t.isin(*WAITING_ZONES)
    nox = F.coalesce(d * pollutant_ton("nox", "measure", "vclass"), F.lit(0.0))
    classes = v.isin("tanker", "cargo", "passenger", "other") & t.isin(*TIERS)
    take = lambda cond, x: F.sum(F.when(cond, x).otherwise(0.0))
    ev = w.groupBy(*pair).agg(
        take(waiting & (m == "co2_ton"), d).alias("x_wait_co2"), take(waiting, nox).alias("x_wait_nox"),
        take(waiting & (m != "fc_main_ton"), nox).alias("x_wait_hotel_nox"),
        take((v == ALL) & (t == TOTAL) & (m == "co2_ton"), d).alias("x_all_co2"), take(classes, nox).alias("x_all_nox"))
    per_h = saving_per_hour(F.lit(72), F.lit(24))
    saved = (queue.filter(F.col("window") == "queue").groupBy(*pair)
             .agg(F.sum(F.col("net_excess_wait_h") * F.col("f_main_t_per_h") * per_h).alias("main_fuel_saved_t")))
    return (ev.join(saved, pair, "left").withColumn("co2_avoided_t", F.col("main_fuel_saved_t") * CO2_PER_FUEL)
            .withColumn("nox_avoided_t", F.col("main_fuel_saved_t") * POLLUTANTS["nox"]["main_big"] / 1000))


def targeting_concentration(events: DataFrame, unit: str, *, port_days: int, event_days: int, ks=(1, 2, 3, 5, 8),
                            days_per_event: int = 10) -> DataFrame:
    """The ports with the largest excess waiting CO2: how many port-days an intervention there
    takes and what share of the excess and of the savings it reaches.

    events: targeting() rows of the storms in question. port_days and event_days are the totals
    the port-day shares refer to.
    """
    extra = ["_events", "x_wait_nox", "co2_avoided_t", "nox_avoided_t"]
    rows = events.withColumn("_events", F.lit(1))
    whole = rows.agg(F.struct(F.sum("x_all_co2").alias("co2"), F.sum("x_all_nox").alias("nox"))).scalar()
    top = topk_share(rows, unit, "x_wait_co2", ks, extra).withColumn("_w", whole)
    days = F.col("_events") * days_per_event
    return top.select("scope", "units", days.alias("intervention_port_days"), (days / port_days).alias("share_all_port_days"),
                      (days / event_days).alias("share_event_port_days"), F.col("share").alias("share_of_waiting_co2"),
                      ratio("x_wait_co2", "_w.co2").alias("share_of_excess_co2"), ratio("x_wait_nox", "_w.nox").alias("share_of_excess_nox"),
                      positive_part("co2_avoided_t").alias("co2_avoided_t"), positive_part("nox_avoided_t").alias("nox_avoided_t"))


def saving_concentration(queue: DataFrame, groupings: dict, pair) -> DataFrame:
    """Waiting hours, saving index and share of the total per group."""
    per = (queue.filter(F.col("window") == "queue").groupBy(*pair, *[c for c in groupings.values() if isinstance(c, str)])
           .agg(F.sum("net_excess_wait_h").alias("_h"), F.sum(2 * F.col("f_main_t_per_h") * F.col("net_excess_wait_h")).alias("_s")))
    total = per.agg(F.sum("_s")).scalar()
    return (by_groupings(per, groupings).groupBy("grouping", "level")
            .agg(F.count(F.lit(1)).alias("n_events"), F.sum("_h").alias("net_excess_wait_h"), F.sum("_s").alias("saving_index_t"))
            .withColumn("share", ratio(F.col("saving_index_t"), total)))


def claims(events: DataFrame, keys, *, cluster: str = "SID", **kw) -> DataFrame:
    """Headline ratios per group: storm CO2, share of the change outside, whole-event CO2, CO2 per
    call, CO2 minus hours during and after, whole-event hours, NOx and PM2.5.

    events: one row per event with storm_/after_/event30_ o_ and e_ sums, d_out, d_all, calls.
    """
    r = lambda a, b: (lambda c: ratio(c(a), c(b)))
    stats = {"c1_co2_storm": r("storm_o_co2", "storm_e_co2"), "c2_share_outside": r("d_out", "d_all"),
             "c3_co2_event": r("event30_o_co2", "event30_e_co2"),
             "c4_co2_per_call": ratio_of_ratios("o_co2c", "o_calls", "e_co2c", "e_calls"),
             "c5_storm_gap": lambda c: ratio(c("storm_o_co2"), c("storm_e_co2")) - ratio(c("storm_o_hours"), c("storm_e_hours")),
             "c5_after_gap": lambda c: ratio(c("after_o_co2"), c("after_e_co2")) - ratio(c("after_o_hours"), c("after_e_hours")),
             "c6_hours_event": r("event30_o_hours", "event30_e_hours"), "c6_nox_event": r("event30_o_nox", "event30_e_nox"),
             "c6_pm25_event": r("event30_o_pm25", "event30_e_pm25")}
    sums = sorted({f"{w}_{k}_{m}" for w in ("storm", "after", "event30") for k in "oe" for m in ("co2", "hours")}
                  | {f"event30_{k}_{m}" for k in "oe" for m in ("nox", "pm25")}
                  | {"d_out", "d_all", "o_co2c", "o_calls", "e_co2c", "e_calls"})
    return bootstrap(events, keys, cluster, sums, stats, min_clusters=3, **kw)


def queue_claim(events: DataFrame, keys, saved: str = "jit_co2", normal: str = "norm_co2_day", top: int = 3) -> DataFrame:
    """Arrival management in days of normal CO2, the share of events with a queue, and the share
    of the largest `top` events in the positive total. keys must not be empty.

    The rank filter is applied before the shuffle too, so a hot group sends `top` rows per task.
    """
    keys = list(keys)
    rows = events.filter(F.col(saved).isNotNull())
    base = rows.groupBy(*keys).agg(ratio(F.greatest(F.sum(saved), F.lit(0.0)), F.sum(normal)).alias("queue_days"),
                                   (F.count_if(F.col(saved) > 0) / F.count(F.lit(1))).alias("share_with_queue"),
                                   F.sum(positive_part(saved)).alias("_all"))
    order = Window.partitionBy(*keys).orderBy(F.desc(saved))
    head = (rows.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= top)
            .groupBy(*keys).agg(F.sum(positive_part(saved)).alias("_top")))
    return (base.join(head, keys).withColumn("top_share", F.when(F.col("_all") > 0, ratio("_top", "_all")))
            .drop("_all", "_top"))


# ---------------------------------------------------------------- comparison and checks
def count_check(exposures: DataFrame, published: dict, seasons) -> DataFrame:
    """Ports, storms and interactions against published counts, with percent differences."""
    e = exposures.filter(F.col("season").between(*seasons))
    got = e.agg(F.count_distinct("port").alias("ports"), F.count_distinct("SID").alias("storms"), F.count(F.lit(1)).alias("interactions"))
    rows = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(int(v)).alias("published"), F.col(n).alias("ours")) for n, v in published.items()])
    return (got.select(F.explode(rows).alias("_r")).select("_r.*")
            .withColumn("diff_pct", 100 * ratio(F.col("ours") - F.col("published"), "published")))


def agreement(ours: DataFrame, theirs: DataFrame, on, activity: str, cuts=(0, 1, 5)) -> DataFrame:
    """Record-level agreement of two metric tables for subsets of busier ports.

    Both tables: on, total_impact, recovery_days, t_start_recovery, t_end_disruption; theirs also
    the activity column. Returns subset, n, shares disrupted, agreement, Jaccard, the median
    impact ratio, equal-date shares and mean recoveries.
    """
    on = list(on)
    o = ours.select(*on, *[F.col(c).alias(f"o_{c}") for c in ("total_impact", "recovery_days", "t_start_recovery", "t_end_disruption")])
    j = (o.join(theirs, on).withColumn("subset", F.explode(F.filter(
        F.array(*[F.lit(int(c)) for c in cuts]), lambda c: (c == 0) | (F.coalesce(F.col(activity), F.lit(0.0)) >= c)))))
    a, b = F.col("o_total_impact") > 0, F.col("total_impact") > 0
    mean = lambda c: F.avg(c.cast("double"))
    both = lambda c: F.avg(F.when(a & b, F.coalesce(c, F.lit(False)).cast("double")))
    out = j.groupBy("subset").agg(
        F.count(F.lit(1)).alias("n"), mean(a).alias("ours"), mean(b).alias("theirs"), mean(a == b).alias("agree"),
        ratio(F.count_if(a & b), F.count_if(a | b)).alias("jaccard"),
        both(F.col("o_t_start_recovery") == F.col("t_start_recovery")).alias("same_start"),
        both(F.col("o_t_end_disruption") == F.col("t_end_disruption")).alias("same_end"),
        F.avg(F.when(a & b, F.col("o_recovery_days"))).alias("our_recovery"), F.avg(F.when(a & b, F.col("recovery_days"))).alias("their_recovery"))
    shared = j.filter(a & b).withColumn("_r", ratio("o_total_impact", "total_impact"))
    return out.join(exact_quantiles(shared, ["subset"], "_r", {"median_impact_ratio": 0.5}), "subset", "left")


def golden_check(measured: DataFrame, expected: DataFrame, on, tolerance: float = 0.01) -> DataFrame:
    """Measured values next to expected ones and whether they agree within the tolerance."""
    e = expected.select(*on, F.col("value").alias("expected"))
    return e.join(measured.select(*on, F.col("value").alias("measured")), list(on), "left") \
        .withColumn("ok", F.coalesce(F.abs(F.col("measured") - F.col("expected")) < tolerance, F.lit(False)))


# ---------------------------------------------------------------- reports
def report(df: DataFrame, labels: dict, digits: dict, order, changes=()) -> DataFrame:
    """Ordered report: `labels` maps a column to {code: (rank, label)}, `digits` rounds, and
    `changes` turns ratios into changes from 1."""
    out = df
    for c in changes:
        out = out.withColumn(c, F.col(c) - 1)
    ranks = []
    for c, table in labels.items():
        hit = lambda i: first_match([(F.col(c) == code, v[i]) for code, v in table.items()], None)
        out = out.withColumn(f"_o_{c}", hit(0)).withColumn(c, hit(1))
        ranks.append(f"_o_{c}")
    out = out.withColumns({c: F.round(c, n) for c, n in digits.items()})
    return out.orderBy(*ranks, *order).drop(*ranks)


def dose_bins(rows: DataFrame, wind, keys=(), *, right: bool = True, cluster: str = "SID", num: str = "obs",
              den: str = "expected", min_events: int = 3, **kw) -> DataFrame:
    """Pooled ratio per wind bin; the interval needs min_events events."""
    edges = WIND_EDGES if right else [*WIND_EDGES[:-1], 999]
    d = rows.withColumn("wind_bin", cut(wind, edges, WIND_LABELS, right)).filter(F.col("wind_bin").isNotNull())
    on = [*keys, "wind_bin"]
    size = d.groupBy(*on).agg(F.count(F.lit(1)).alias("n"))
    out = size.join(boot_ratio(d, on, cluster, num, den, **kw), on)
    return out.withColumns({c: F.when(F.col("n") >= min_events, F.col(c)) for c in ("ratio_lo", "ratio_hi")})
