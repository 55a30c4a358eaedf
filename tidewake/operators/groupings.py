"""The headline results within kinds of events: by storm class, port type, layout, coast, period, distance and duration."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidewake.functions.binning import cut
from tidewake.functions.numeric import positive_part, ratio
from .products import (CLASS_NAMES, DISTANCE_EDGES, DISTANCE_LABELS, DURATION_EDGES, DURATION_LABELS, OUTER_ZONES, by_groupings, claims, class_counts, coast_group,
                       gap_summary, outer_share, period, queue_claim)
from .quantiles import ks_two_sample
from .resample import boot_mean_difference, boot_ratio, bootstrap, left_out_sums

#: Classes that count as a response.
RESPONSES = ["coupled", "relative (amplified)", "relative (damped)", "absolute"]
GROUPINGS = {"port_type": "port_type", "layout": "layout", "region": "region", "dist_class": "dist_class", "dur_class": "dur_class", "intensity": "intensity"}
CLAIM_GROUPINGS = {"intensity": "intensity", "port_type": "port_type", "layout": "layout", "region2": "region2", "period": "period"}


def with_kinds(events: DataFrame) -> DataFrame:
    """Add the kinds of an event: dist_class, dur_class, region2 and period from dist, k_days, region and season."""
    return events.withColumns({"dist_class": cut("dist", DISTANCE_EDGES, DISTANCE_LABELS), "dur_class": cut("k_days", DURATION_EDGES, DURATION_LABELS),
                               "region2": coast_group("region"), "period": period("season")})


def grouped_responses(events: DataFrame, groupings=GROUPINGS, measures=("hours", "co2", "nox"), *, cluster: str = "SID", unit: str = "port",
                      cls: str = "cls", **kw) -> DataFrame:
    """Per grouping, level and window: n_events, n_ports, each measure's ratio of sums with its interval, the share of events that
    respond and the share of relative divergences. Pass only the strong storms for the table of strong storms."""
    keys = ["grouping", "level", "window"]
    rows = by_groupings(events, groupings)
    counted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_events"), F.count_distinct(unit).alias("n_ports"),
                                      F.avg(F.coalesce(F.col(cls).isin(*RESPONSES), F.lit(False)).cast("double")).alias("share_responding"),
                                      F.avg(F.coalesce(F.col(cls).startswith("relative"), F.lit(False)).cast("double")).alias("share_relative"))
    stats = {m: (lambda m: lambda c: ratio(c(f"obs_{m}"), c(f"exp_{m}")))(m) for m in measures}
    return counted.join(bootstrap(rows, keys, cluster, [f"{k}_{m}" for m in measures for k in ("obs", "exp")], stats, **kw), keys)


def grouped_class_counts(events: DataFrame, groupings=("intensity", "port_type", "layout"), cls: str = "cls") -> DataFrame:
    """Events of each divergence class per grouping, level and window."""
    return class_counts(by_groupings(events, {g: g for g in groupings}), ["grouping", "level", "window"], cls, CLASS_NAMES)


def gap_table(real: DataFrame, placebo: DataFrame, *, min_events: int = 5, draws: int = 2000, cluster: str = "SID") -> DataFrame:
    """The divergence on event dates against placebo dates, for every window, port type and storm class and for all of either
    ("All"): both distributions, the difference in means with its interval, the KS distance with its p-value, and the shares
    beyond the band. Cells with fewer than min_events events are left out."""
    keys = ["window", "port_type", "intensity"]

    def cells(df: DataFrame) -> DataFrame:
        kinds = [F.explode(F.array(F.col(c), F.lit("All"))).alias(c) for c in ("port_type", "intensity")]
        one = df.where("g IS NOT NULL").select("window", cluster, "g", "tau_g", kinds[0], "intensity")
        return one.select("window", cluster, "g", "tau_g", "port_type", kinds[1]).where("port_type IS NOT NULL AND intensity IS NOT NULL")

    a, b = cells(real), cells(placebo)
    named = lambda df, tag: gap_summary(df, keys).select(*keys, F.col("n").alias(f"n_{tag}"), *[F.col(c).alias(f"{c}_{tag}") for c in ("mean", "median", "sd", "iqr", "share_beyond")])
    both = a.withColumn("_s", F.lit("event")).unionByName(b.withColumn("_s", F.lit("placebo")))
    apart = boot_mean_difference(a, b, keys, cluster, "g", draws=draws).select(*keys, F.col("contrast").alias("diff"), F.col("contrast_lo").alias("diff_lo"), F.col("contrast_hi").alias("diff_hi"))
    ks = ks_two_sample(both, keys, "g", "_s", "event", "placebo").select(*keys, "ks_d", "ks_p")
    return named(a, "events").where(F.col("n_events") >= min_events).join(named(b, "placebo"), keys).join(apart, keys).join(ks, keys)


def claims_by_group(events: DataFrame, hurricane: str, groupings=CLAIM_GROUPINGS, **kw) -> DataFrame:
    """All headline results per grouping and level, and for all events: counts, the storm-window ratio of each storm class (long,
    as storm_class and c1), and the other claims with their intervals.

    Two tables in one: rows with storm_class hold c1_* only; the row without one holds the rest, with the results of
    waiting after hurricanes (queue_days, share_with_queue, top_share).
    """
    keys = ["grouping", "level"]
    rows = by_groupings(events, groupings, total="All events")
    size = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_events"), F.count_distinct("SID").alias("n_storms"), F.count_distinct("port").alias("n_ports"))
    whole = claims(rows, keys, **kw).drop("n_clusters", "c1_co2_storm", "c1_co2_storm_lo", "c1_co2_storm_hi")
    queue = queue_claim(rows.where(F.col("intensity") == hurricane), keys)
    by_class = boot_ratio(rows.withColumn("storm_class", F.col("intensity")), [*keys, "storm_class"], "SID", "storm_o_co2", "storm_e_co2", min_clusters=3, **kw)
    sizes = rows.groupBy(*keys, F.col("intensity").alias("storm_class")).agg(F.count(F.lit(1)).alias("n_events"))
    first = by_class.join(sizes, [*keys, "storm_class"]).select(*keys, "storm_class", "n_events", F.col("ratio").alias("c1"), F.col("ratio_lo").alias("c1_lo"), F.col("ratio_hi").alias("c1_hi"))
    return size.join(whole, keys).join(queue, keys, "left").unionByName(first, allowMissingColumns=True)


def claims_left_out(events: DataFrame, storm: str, hurricane: str, unit: str = "SID") -> DataFrame:
    """Seven claims with each storm left out in turn: left_out, c1_storm and c1_hurricane (storm-window CO2 of the named classes),
    c2 to c4, c6_nox and c7 (days of normal CO2 saved after hurricanes). One pass; a storm's row is the total minus its own sums."""
    of = lambda name, c: F.when(F.col("intensity") == name, F.col(c)).otherwise(0.0)
    queued = (F.col("intensity") == hurricane) & F.col("jit_co2").isNotNull()
    called = F.col("o_calls").isNotNull() & (F.col("e_calls") > 0)
    columns = {"_so": of(storm, "storm_o_co2"), "_se": of(storm, "storm_e_co2"), "_ho": of(hurricane, "storm_o_co2"), "_he": of(hurricane, "storm_e_co2"),
               "_out": F.col("d_out"), "_all": F.col("d_all"), "_eo": F.col("event30_o_co2"), "_ee": F.col("event30_e_co2"), "_no": F.col("event30_o_nox"), "_ne": F.col("event30_e_nox"),
               **{f"_{c}": F.when(called, F.col(c)).otherwise(0.0) for c in ("o_co2c", "o_calls", "e_co2c", "e_calls")},
               "_j": F.when(queued, F.col("jit_co2")).otherwise(0.0), "_d": F.when(queued, F.col("norm_co2_day")).otherwise(0.0)}
    left = left_out_sums(events.select(unit, *[c.cast("double").alias(n) for n, c in columns.items()]), unit, list(columns))
    return left.select("left_out", ratio("_so", "_se").alias("c1_storm"), ratio("_ho", "_he").alias("c1_hurricane"), ratio("_out", "_all").alias("c2"), ratio("_eo", "_ee").alias("c3"),
                       ratio(ratio("_o_co2c", "_o_calls"), ratio("_e_co2c", "_e_calls")).alias("c4"), ratio("_no", "_ne").alias("c6_nox"), ratio(positive_part("_j"), "_d").alias("c7"))


def landfall_split(events: DataFrame, hurricane: str, **kw) -> DataFrame:
    """Events and storms by landfall, and the storm-window CO2 ratio of hurricanes with its interval."""
    counts = lambda df, name: df.groupBy("landfall").agg(F.lit(name).alias("group"), F.count(F.lit(1)).alias("n_events"), F.count_distinct("SID").alias("n_cyclones"))
    strong = events.where(F.col("intensity") == hurricane)
    pooled = boot_ratio(strong, ["landfall"], "SID", "storm_o_co2", "storm_e_co2", min_clusters=3, **kw).drop("n_clusters")
    return counts(strong, "hurricanes").join(pooled, ["landfall"]).unionByName(counts(events, "all classes"), allowMissingColumns=True)


def pollutants_pooled(zone_sums: DataFrame, keys, pollutants=("co2", "nox", "pm25", "so2"), *, cluster: str = "SID", **kw) -> DataFrame:
    """Per key and pollutant: pooled ratio over the zones with its interval, the share of the change outside berths and
    channels, and the anchorage ratio. zone_sums: keys, cluster, zone, obs_<p> and exp_<p>; missing values count as 0."""
    keys = list(keys)
    shares = outer_share(zone_sums.fillna(0.0, [f"{k}_{p}" for p in pollutants for k in ("obs", "exp")]), keys, pollutants)
    pairs = F.array(*[F.struct(F.lit(p).alias("pollutant"), F.coalesce(F.col(f"obs_{p}"), F.lit(0.0)).alias("obs"), F.coalesce(F.col(f"exp_{p}"), F.lit(0.0)).alias("expected")) for p in pollutants])
    long = zone_sums.where("zone <> 'total'").select(*keys, cluster, F.explode(pairs).alias("_p")).select(*keys, cluster, "_p.*")
    bounds = boot_ratio(long, [*keys, "pollutant"], cluster, "obs", "expected", **kw).select(*keys, "pollutant", "n_clusters", F.col("ratio_lo").alias("lo"), F.col("ratio_hi").alias("hi"))
    return shares.join(bounds, [*keys, "pollutant"])


def map_tracks(fixes: DataFrame, tracks: DataFrame, events: DataFrame, max_rms_km: float = 30.0) -> DataFrame:
    """Located storm fixes to draw: those of storms with an event and a fit better than max_rms_km, with the largest wind that any
    track row reports for the storm and time (NULL if none). fixes: SID, time, lat, lon, rms_km; tracks: SID, time, wind."""
    top = tracks.groupBy("SID", "time").agg(F.max("wind").alias("wind_kt"))
    return (fixes.where(F.col("rms_km") < max_rms_km).join(events.select("SID").distinct(), "SID", "left_semi")
            .join(top, ["SID", "time"], "left").select("SID", "time", "lat", "lon", "wind_kt"))
