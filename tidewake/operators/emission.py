"""Fuel, CO2, SO2 and other pollutants from speeds, ship size and engine tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidewake.functions.binning import first_match
from tidewake.functions.numeric import as_col, clip, ratio
from .lookup import band_join, map_values
from .trajectory import credit_gaps

# ---- fixed values of the fuel model -----------------------------------------
# specific fuel consumption, g/kWh, ships built before 1984 / before 2001 / later
SFOC_MAIN = {"SSD": (205, 185, 175), "MSD": (215, 195, 185), "HSD": (225, 205, 195)}
SFOC_AUX = (225, 205, 195)
SFOC_BOILER = 340
BUILD_LIMITS = (1984, 2001)
ENGINE_CLASS = {
    "Container": "SSD", "Bulk": "SSD", "Chemical": "SSD", "Oil": "SSD", "Other-Liquids": "MSD",
    "Tanker": "MSD", "General": "MSD", "Liquified-Gas": "SSD", "Refrigerated-Cargo": "MSD",
    "Auto": "SSD", "Passenger": "MSD", "Yacht": "HSD", "Fishing": "HSD", "Other": "MSD",
    "Research": "MSD"}
CO2_PER_FUEL = 3.114
BAND_TABLES = ["p_main", "v_design", "ae_sea", "ae_berth", "ae_anchor", "boiler"]
BERTH_SPEED, ANCHOR_SPEED, CRUISE_RATIO, SPEED_LIMIT = 1.0, 3.0, 0.3, 40.0
POWER_CAP, WEATHER = 0.85, 1.15
LOAD_A, LOAD_B, LOAD_C, LOAD_MIN = 0.455, -0.71, 1.28, 0.07
PASSENGER_HULL, LARGE_CONTAINER_HULL, LARGE_CONTAINER_DWT = 0.70, 0.75, 203000

# traffic class of a model class; anything else is "other"
TRAFFIC_CLASS = {
    "Container": "cargo", "General": "cargo", "Refrigerated-Cargo": "cargo", "Auto": "cargo",
    "Bulk": "cargo", "Oil": "tanker", "Chemical": "tanker", "Tanker": "tanker",
    "Other-Liquids": "tanker", "Liquified-Gas": "tanker", "Passenger": "passenger",
    "Fishing": "fishing"}

# fixed values
# sulfur: SO2 per sulfur, oxidised share, sulfur in compliant and in residual fuel
SO2_PER_SULFUR, OXIDISED = 2.0, 0.97753
SULFUR_COMPLIANT, SULFUR_RESIDUAL = 0.001, 0.035
SCRUBBER_FROM = 2020
# removal share and whether the wash water is discharged, per scrubber technology
SCRUBBER_REMOVAL = {"Open Loop": 0.98, "Closed Loop": 0.98, "Hybrid": 0.98, "Membrane": 0.98,
                    "Dry": 0.99, "TBC": 0.98, "Unknown": 0.98, "No Scrubber": 0.0}
SCRUBBER_DISCHARGES = {"Open Loop": True, "Closed Loop": False, "Hybrid": True, "Membrane": True,
                       "Dry": False, "TBC": True, "Unknown": True, "No Scrubber": False}

# fixed values: g of pollutant per kg of fuel; big main engines are those of tankers and cargo ships
POLLUTANTS = {"nox": {"main_big": 91.9, "main_small": 62.9, "aux": 52.6, "boiler": 6.6},
              "pm25": {"main_big": 0.995, "main_small": 0.898, "aux": 0.856, "boiler": 0.302}}
FUEL_ENGINE = {"fc_main_ton": "main", "fc_AE_ton": "aux", "fc_boiler_ton": "boiler"}
BIG_ENGINE_CLASSES = ("tanker", "cargo")

EMISSION_COLUMNS = ["fc_main_ton", "fc_AE_ton", "fc_boiler_ton", "fc_total_ton", "co2_ton"]
SO2_COLUMNS = ["so2_air_ton", "so2_washwater_ton", "so2_retained_ton", "so2_total_ton"]
CARRIED_COLUMNS = ["fc_total_ton", "co2_ton", "hours", "n_vessels", "n_vessels_in_cell", "n_messages"]


# ---------------------------------------------------------------- message filters
def normal_imo(x):
    """Ship number from text such as ``IMO9123456``; NULL when it is not a number."""
    return F.trim(F.regexp_replace(as_col(x).cast("string"), "^IMO", "")).try_cast("bigint")


def valid_speed(sog):
    s = as_col(sog)
    return s.isNotNull() & (s >= 0) & (s < SPEED_LIMIT)


def traffic_class(model_class):
    return map_values(model_class, TRAFFIC_CLASS, "other")


def operating_phase(sog, design_speed):
    """berth / anchor / cruise / maneuver from speed and effective design speed."""
    s, v = as_col(sog), as_col(design_speed)
    share = F.when(v > 0, ratio(s, v)).otherwise(0.0)
    return first_match([(s <= BERTH_SPEED, "berth"), (s <= ANCHOR_SPEED, "anchor"),
                        (share >= CRUISE_RATIO, "cruise")], "maneuver")


def _by_build_year(built, rates):
    b = as_col(built)
    return (F.when(b < BUILD_LIMITS[0], float(rates[0]))
            .when(b < BUILD_LIMITS[1], float(rates[1]))
            .when(b.isNotNull(), float(rates[2])))


def _load_factor(load):
    eff = clip(load, LOAD_MIN, 1.0)
    return LOAD_A * eff * eff + LOAD_B * eff + LOAD_C


# ---------------------------------------------------------------- fuel model
def ship_engines(registry: DataFrame, bands: DataFrame) -> DataFrame:
    """Everything about a ship that does not depend on the message, resolved once per ship:
    band values, effective design speed and base fuel rates."""
    engine = map_values("vessel_type_str", ENGINE_CLASS, "SSD")
    main = None
    for name, rates in SFOC_MAIN.items():
        rate = _by_build_year("built", rates)
        main = F.when(engine == name, rate) if main is None else main.when(engine == name, rate)
    hull = (F.when(F.col("vessel_type_str") == "Passenger", PASSENGER_HULL)
            .when((F.col("vessel_type_str") == "Container") & (F.col("dwt") >= LARGE_CONTAINER_DWT),
                  LARGE_CONTAINER_HULL).otherwise(1.0))
    return (band_join(registry, bands, "vessel_type_str", "dwt", BAND_TABLES)
            .withColumn("v_eff", F.col("v_design") * hull)
            .withColumn("sfoc_main_base", main)
            .withColumn("sfoc_aux_base", _by_build_year("built", SFOC_AUX)))


def message_fuel(messages: DataFrame, registry: DataFrame, bands: DataFrame, *,
                 ship: str = "imo", time: str = "base_date_time", sog: str = "sog",
                 day: str = "date", tie=()) -> DataFrame:
    """Fuel by engine and CO2 of every message of a registered ship.

    registry: imo, dwt, built, vessel_type_str, scrubber_tech. bands: table, vessel_type_str,
    lo, hi, value, band_no with tables p_main, v_design, ae_sea, ae_berth, ae_anchor, boiler.
    Unregistered ships and bad speeds leave before intervals are taken, so a bad message
    widens the next interval. A ship without a band has NULL fuel for that engine.
    """
    engines = ship_engines(registry, bands).withColumnRenamed("imo", ship)
    m = (messages.filter(valid_speed(sog)).join(engines, ship)
         .transform(lambda d: credit_gaps(d, ship, time, day, tie=tie)))
    speed_share = F.when(F.col("v_eff") > 0, ratio(sog, "v_eff")).otherwise(0.0)
    moving = F.col("phase").isin("cruise", "maneuver")
    raw_power = F.col("p_main") * speed_share * speed_share * speed_share * WEATHER
    aux = (F.when(F.col("phase") == "cruise", F.col("ae_sea"))
           .when(F.col("phase") == "maneuver", 0.5 * (F.col("ae_sea") + F.col("ae_anchor")))
           .when(F.col("phase") == "anchor", F.col("ae_anchor")).otherwise(F.col("ae_berth")))
    share_of = lambda part, whole: F.when(F.col(whole) > 0, ratio(part, whole)).otherwise(0.0)
    return (m.withColumn("phase", operating_phase(sog, "v_eff"))
            .withColumn("P_ME", F.when(moving, clip(raw_power, 0.0, POWER_CAP * F.col("p_main"))).otherwise(0.0))
            .withColumn("P_AE", aux)
            .withColumn("P_boiler", F.when(F.col("phase") == "cruise", F.col("boiler") * 0.0).otherwise(F.col("boiler")))
            .withColumn("sfoc_ME_load", F.when(F.col("P_ME") > 0, F.col("sfoc_main_base")
                                               * _load_factor(share_of("P_ME", "p_main"))).otherwise(0.0))
            .withColumn("sfoc_AE_load", F.col("sfoc_aux_base") * _load_factor(share_of("P_AE", "ae_sea")))
            .withColumn("fc_main_ton", F.col("P_ME") * F.col("sfoc_ME_load") * F.col("dt_h") / 1e6)
            .withColumn("fc_AE_ton", F.col("P_AE") * F.col("sfoc_AE_load") * F.col("dt_h") / 1e6)
            .withColumn("fc_boiler_ton", F.col("P_boiler") * SFOC_BOILER * F.col("dt_h") / 1e6)
            .withColumn("fc_total_ton", F.col("fc_main_ton") + F.col("fc_AE_ton") + F.col("fc_boiler_ton"))
            .withColumn("co2_ton", F.col("fc_total_ton") * CO2_PER_FUEL)
            .drop("sfoc_main_base", "sfoc_aux_base", "ae_sea", "ae_berth", "ae_anchor", "boiler"))


def add_fitted(df: DataFrame, installs: DataFrame, *, ship: str = "imo",
               time: str = "base_date_time") -> DataFrame:
    """scrubber_fitted = 1 from the ship's install date on; no record means never."""
    dates = installs.select(F.col("imo").alias(ship), F.col("install_date").alias("_install"))
    on = F.coalesce(F.col(time).cast("timestamp_ntz") >= F.col("_install").cast("timestamp_ntz"), F.lit(False))
    return (df.join(dates, ship, "left")
            .withColumn("scrubber_fitted", on.cast("int")).drop("_install"))


def settle_zone(df: DataFrame, sog: str = "sog") -> DataFrame:
    """After a cell lookup: unmatched is Outside / outside, a moving ship in a berth cell is
    in the channel, and in_region flags the rest."""
    tier = F.coalesce("tier", F.lit("outside"))
    tier = F.when((F.col(sog) >= ANCHOR_SPEED) & (tier == "port"), "channel").otherwise(tier)
    return (df.withColumn("complex", F.coalesce("complex", F.lit("Outside")))
            .withColumn("tier", tier).withColumn("in_region", F.col("tier") != "outside"))


# ---------------------------------------------------------------- panels
def emission_panel(messages: DataFrame, keys, *, ship: str = "imo",
                   vessels: str = "n_vessels") -> DataFrame:
    """Messages, distinct ships, hours, fuel and CO2 per key."""
    return messages.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_messages"), F.count_distinct(ship).alias(vessels),
        F.sum("dt_h").alias("hours"), *[F.sum(c).alias(c) for c in EMISSION_COLUMNS])


def panel_rollup(panel: DataFrame, keys) -> DataFrame:
    """Sum a panel to fewer keys; distinct ships are not additive and are left out."""
    return panel.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ["n_messages", "hours", *EMISSION_COLUMNS]])


def share_of_total(df: DataFrame, keys, value: str, out: str, within=(), scale: float = 1.0) -> DataFrame:
    """Sum per key and its share of the total, or of the total of the `within` keys."""
    sums = df.groupBy(*keys).agg(F.sum(value).alias(value))
    if within:
        total = df.groupBy(*within).agg(F.sum(value).alias("_total"))
        return sums.join(total, list(within)).withColumn(out, scale * ratio(value, "_total")).drop("_total")
    return sums.withColumn(out, scale * ratio(F.col(value), df.agg(F.sum(value)).scalar()))


def restrict_classes(panel: DataFrame, classes, keys, class_col: str = "vclass",
                     skip=("scrubber_fitted",)) -> DataFrame:
    """Panel of the given classes summed to keys; a class the panel does not have raises."""
    have = {r[0] for r in panel.filter(F.col(class_col).isin(*classes)).select(class_col).distinct().collect()}
    missing = sorted(set(classes) - have)
    if missing:
        raise ValueError(f"classes {missing} are not in the panel")
    numeric = ("int", "bigint", "double", "float", "smallint", "tinyint")
    sums = [c for c, t in panel.dtypes if t in numeric and c not in keys and c not in skip]
    return (panel.filter(F.col(class_col).isin(*classes)).groupBy(*keys)
            .agg(*[F.sum(c).alias(c) for c in sums]))


# ---------------------------------------------------------------- sulfur
def so2_factor(sulfur: float) -> float:
    return SO2_PER_SULFUR * OXIDISED * sulfur


def _fitted(panel_columns, mode, year):
    if mode == "never":
        return F.lit(False)
    if mode == "always":
        return F.lit(True)
    if "scrubber_fitted" in panel_columns and mode != "year":
        return F.col("scrubber_fitted").cast("boolean")
    if mode is None:
        return F.lit(False)
    return year >= (mode if isinstance(mode, int) else SCRUBBER_FROM)


def _sulfur_columns(fitted):
    tech = F.coalesce("scrubber_tech", F.lit("Unknown"))
    spec = lambda table: F.coalesce(map_values(tech, table), F.lit(table["Unknown"]))
    used = F.coalesce(fitted, F.lit(False)) & (tech != "No Scrubber")
    total = F.coalesce("fc_total_ton", F.lit(0.0)) * F.when(used, so2_factor(SULFUR_RESIDUAL)) \
        .otherwise(so2_factor(SULFUR_COMPLIANT))
    captured = F.when(used, total * spec(SCRUBBER_REMOVAL)).otherwise(0.0)
    drains = spec(SCRUBBER_DISCHARGES)
    return {"so2_air_ton": total - captured,
            "so2_washwater_ton": F.when(drains, captured).otherwise(0.0),
            "so2_retained_ton": F.when(~drains, captured).otherwise(0.0),
            "so2_total_ton": total}, used


def split_sulfur(panel: DataFrame, mode=None, day: str = "date") -> DataFrame:
    """Split the SO2 of a fuel panel into air, wash water and retained.

    mode: "never", "always", a year, "year" (the default year), or None. A scrubber_fitted
    column overrides a year.
    """
    cols, used = _sulfur_columns(_fitted(panel.columns, mode, F.year(day)))
    return panel.withColumns({**cols, "scrubber_fitted": used.cast("int")})


def sulfur_panel(panel: DataFrame, keys, mode=None, day: str = "date") -> DataFrame:
    """SO2 summed to keys, carrying along whichever activity columns the panel has. Summed
    n_vessels counts a ship once per group, so it is not a number of distinct ships."""
    scored = split_sulfur(panel, mode, day)
    carried = [c for c in CARRIED_COLUMNS if c in scored.columns]
    return scored.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in [*carried, *SO2_COLUMNS]])


def sulfur_scenarios(panel: DataFrame, day: str = "date") -> DataFrame:
    """SO2 totals with scrubbers never used, by date or from a year, and always used."""
    if "scrubber_fitted" in panel.columns:
        modes = {"never fitted": "never", "install dates": None, "always fitted": "always"}
    else:
        modes = {"never fitted": "never", "fitted from 2020": 2020, "fitted from 2015": 2015,
                 "always fitted": "always"}
    fitted = None
    for name, mode in modes.items():
        is_it, value = F.col("scenario") == name, _fitted(panel.columns, mode, F.year(day))
        fitted = F.when(is_it, value) if fitted is None else fitted.when(is_it, value)
    cols, _ = _sulfur_columns(fitted)
    return (panel.withColumn("scenario", F.explode(F.array(*[F.lit(n) for n in modes])))
            .withColumns(cols).groupBy("scenario").agg(*[F.sum(c).alias(c) for c in SO2_COLUMNS]))


# ---------------------------------------------------------------- other pollutants
def pollutant_ton(pollutant: str, fuel_measure, vclass):
    """Tonnes of pollutant per tonne of fuel for a long (class, fuel measure) row."""
    ef = POLLUTANTS[pollutant]
    m, v = as_col(fuel_measure), as_col(vclass)
    return (F.when((m == "fc_main_ton") & v.isin(*BIG_ENGINE_CLASSES), ef["main_big"])
            .when(m == "fc_main_ton", ef["main_small"])
            .when(m == "fc_AE_ton", ef["aux"])
            .when(m == "fc_boiler_ton", ef["boiler"])) / 1000.0


def panel_pollutants(panel: DataFrame, class_col: str = "vclass") -> DataFrame:
    """Add nox_ton and pm25_ton to a panel with fuel by engine."""
    cols = {}
    for p in POLLUTANTS:
        cols[f"{p}_ton"] = sum(F.coalesce(F.col(f), F.lit(0.0)) * pollutant_ton(p, F.lit(f), class_col)
                               for f in FUEL_ENGINE)
    return panel.withColumns(cols)
