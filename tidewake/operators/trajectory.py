"""From position reports to gaps, visits and daily port activity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tidewake.functions.dates import day_range
from tidewake.functions.numeric import hours_between
from .ordered import chain_number
from .quantiles import exact_quantiles

MAX_INTERVAL_HOURS = 3.0
GAP_CAP_HOURS = 24.0
STITCH_GAP_HOURS = 6.0
MIN_CALL_HOURS = 4.0


def credit_gaps(df: DataFrame, ship: str, time: str, day: str, *, tie=(),
                max_hours: float = MAX_INTERVAL_HOURS, raw: str = "raw_h",
                credited: str = "dt_h") -> DataFrame:
    """Hours since the ship's previous message of the same day: 0 for its first message,
    and nothing credited past max_hours. An interval belongs to its later message.

    A ship's day is bounded by the clock, so one window reads and shuffles the messages once."""
    out = df.withColumn("_prev", F.lag(time).over(Window.partitionBy(ship, day).orderBy(time, *tie)))
    gap = F.coalesce(hours_between("_prev", time), F.lit(0.0))
    return (out.withColumn(raw, gap)
            .withColumn(credited, F.when(F.col(raw) > max_hours, 0.0).otherwise(F.col(raw)))
            .drop("_prev"))


def gap_panel(messages: DataFrame, *, ship: str, time: str, day: str, port: str,
              credited: str = "dt_h", tie=(), max_hours: float = MAX_INTERVAL_HOURS,
              cap_hours: float = GAP_CAP_HOURS) -> DataFrame:
    """Per day and port: hours credited and hours thrown away by the interval rule.

    Gaps are taken again between in-port messages only, so leaving and coming back counts.
    """
    inside = messages.filter(F.col(port).isNotNull())
    seen = inside.withColumn("_prev", F.lag(time).over(Window.partitionBy(ship, day).orderBy(time, *tie)))
    raw = F.coalesce(hours_between("_prev", time), F.lit(0.0))
    over = raw > max_hours
    panel = seen.groupBy(day, port).agg(
        F.count(F.lit(1)).alias("n_messages"),
        F.count_distinct(ship).alias("n_vessels"),
        F.sum(credited).alias("hours_credited"),
        F.sum(F.when(over, F.least(raw, F.lit(cap_hours))).otherwise(0.0)).alias("hours_discarded"),
        F.sum(F.when(over, 1).otherwise(0)).alias("n_gaps_over"))
    total = F.col("hours_credited") + F.col("hours_discarded")
    return panel.withColumn("discard_share",
                            F.when(total > 0, F.col("hours_discarded") / total).otherwise(0.0))


def daily_presence(df: DataFrame, *, ship: str, port: str, time: str, day: str, imo: str) -> DataFrame:
    """One row per day, ship and port: first and last time seen, messages, first known imo."""
    known = F.when(F.col(imo).isNotNull(), F.col(time))
    return df.groupBy(day, ship, port).agg(
        F.min_by(imo, known).alias("imo"), F.min(time).alias("first_seen"),
        F.max(time).alias("last_seen"), F.count(F.lit(1)).alias("n_msgs"))


def stitch_visits(presence: DataFrame, *, ship: str, port: str,
                  gap_hours: float = STITCH_GAP_HOURS,
                  min_call_hours: float = MIN_CALL_HOURS) -> DataFrame:
    """Join presence pieces at most gap_hours apart into visits; long visits are calls.

    The ship's imo is the one of its first piece at the port.
    """
    numbered = chain_number(presence, [ship, port], "first_seen", "last_seen", gap_hours, "visit_no")
    visits = numbered.groupBy(ship, port, "visit_no").agg(
        F.min_by("imo", F.struct("first_seen", "last_seen")).alias("_imo"),
        F.min("first_seen").alias("arrival"), F.max("last_seen").alias("departure"),
        F.sum("n_msgs").alias("n_msgs"))
    first = Window.partitionBy(ship, port).orderBy("visit_no")
    return (visits.withColumn("imo", F.first("_imo").over(first)).drop("_imo")
            .withColumn("duration_h", hours_between("arrival", "departure"))
            .withColumn("is_call", F.col("duration_h") >= min_call_hours)
            .withColumn("date", F.to_date("arrival")))


def call_panel(visits: DataFrame, *, ship: str, port: str) -> DataFrame:
    """Daily calls, distinct ships and median stay by arrival day, joined with the ships
    present on each day of a call. Counts are 0 and the median NULL where a side is missing."""
    calls = visits.filter("is_call")
    arrivals = calls.groupBy("date", port).agg(
        F.count(F.lit(1)).alias("port_calls"), F.count_distinct(ship).alias("distinct_vessels"))
    stay = exact_quantiles(calls, ["date", port], "duration_h", {"median_duration_h": 0.5})
    present = (calls.withColumn("date", F.explode(day_range(F.to_date("arrival"), F.to_date("departure"))))
               .groupBy("date", port).agg(F.count_distinct(ship).alias("vessels_present")))
    return (arrivals.join(stay, ["date", port], "left")
            .join(present, ["date", port], "full_outer")
            .fillna(0, subset=["port_calls", "distinct_vessels", "vessels_present"]))


def thin_panel(panel: DataFrame, source: DataFrame, day: str, share: float = 0.9) -> DataFrame:
    """One row: days of the panel against days of its input and whether the panel is thin."""
    n = lambda df: df.agg(F.count_distinct(day)).scalar()
    return (panel.agg(F.count_distinct(day).alias("panel_days"))
            .withColumn("input_days", n(source))
            .withColumn("thin", F.col("panel_days") < F.col("input_days") * share))
