"""From raw positions to visits and emission panels."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidewake.operators import emission as em, exposure as ex, space, trajectory as tr
from tidewake.operators.sizing import checkpointed
from tidewake.sources.positions import merchant, sample_days

# position columns of the canonical layout -> names used by the fuel model
MESSAGE = {"MMSI": "mmsi", "BaseDateTime": "base_date_time", "LAT": "latitude", "LON": "longitude", "SOG": "sog"}


def port_calls(positions: DataFrame, rings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(visits, daily call panel) of merchant ships in port polygons."""
    inside = space.assign_polygon(merchant(positions), "LON", "LAT", rings).filter(F.col("port").isNotNull())
    rows = inside.select(F.col("MMSI").alias("mmsi"), "port", F.col("BaseDateTime").alias("time"), "date", F.col("IMO").alias("imo"))
    # stage boundaries: positions are read once, however often the small tables are used
    presence = checkpointed(tr.daily_presence(rows, ship="mmsi", port="port", time="time", day="date", imo="imo"))
    visits = checkpointed(tr.stitch_visits(presence, ship="mmsi", port="port"))
    return visits, tr.call_panel(visits, ship="mmsi", port="port")


def fuel_table(positions: DataFrame, registry: DataFrame, bands: DataFrame) -> DataFrame:
    """Message fuel of registered ships from canonical positions."""
    m = positions.select(em.normal_imo("IMO").alias("imo"), "date", *[F.col(a).alias(b) for a, b in MESSAGE.items()])
    return em.message_fuel(m, registry, bands, tie=["mmsi", "latitude", "longitude"])


def port_emissions(fuel: DataFrame, rings: DataFrame, installs: DataFrame | None = None) -> DataFrame:
    """Daily emissions per port, traffic class and scrubber technology."""
    df = space.assign_polygon(fuel, "longitude", "latitude", rings).filter(F.col("port").isNotNull())
    keys = ["date", "port", "vclass", "scrubber_tech"]
    if installs is not None:
        df, keys = em.add_fitted(df, installs), [*keys, "scrubber_fitted"]
    return em.emission_panel(df.withColumn("vclass", em.traffic_class("vessel_type_str")), keys)


def zone_emissions(fuel: DataFrame, tier_map: DataFrame, installs: DataFrame | None = None,
                   resolutions=(ex.FINE_DEG, ex.COARSE_DEG)) -> DataFrame:
    """Daily emissions per port complex, tier, traffic class and scrubber technology."""
    df = em.settle_zone(space.assign_cell(fuel, "latitude", "longitude", tier_map, resolutions))
    keys = ["date", "complex", "tier", "vclass", "scrubber_tech"]
    if installs is not None:
        df, keys = em.add_fitted(df, installs), [*keys, "scrubber_fitted"]
    return em.emission_panel(df.withColumn("vclass", em.traffic_class("vessel_type_str")), keys, vessels="n_vessels_in_cell")


def port_gaps(fuel: DataFrame, rings: DataFrame) -> DataFrame:
    """Daily hours credited and thrown away per port."""
    df = space.assign_polygon(fuel, "longitude", "latitude", rings)
    return tr.gap_panel(df, ship="imo", time="base_date_time", day="date", port="port", tie=["mmsi", "latitude", "longitude"])


def build_tier_map(positions: DataFrame, rings: DataFrame, sample: int | None = 40) -> DataFrame:
    """Operational tier map from an even sample of days."""
    df = sample_days(positions, sample) if sample else positions
    counts = ex.cell_counts(df, lat="LAT", lon="LON", sog="SOG", status="Status", imo="IMO")
    return ex.tier_map(counts, ex.ring_vertices(rings))
