"""Ship registry, vessel export and scrubber register."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewake.functions.numeric import as_col
from tidewake.operators.lookup import first_per_key, map_values

# ---- fixed values ------------------------------------------------------------
# registry type -> class of the fuel model; anything else is "Other"
MODEL_CLASS = {
    "Fully Cellular Container": "Container", "Bulk Carrier": "Bulk", "Ore Carrier": "Bulk",
    "Open Hatch Carrier": "Bulk", "Chip Carrier": "Bulk", "Aggregates Carrier": "Bulk",
    "Cement Carrier": "Bulk", "Chemical & Oil Carrier": "Chemical",
    "Chemical Parcel Tanker": "Chemical", "Chemical Bulk Tanker": "Chemical",
    "Chemical Unknown Carrier": "Chemical", "Methanol Carrier": "Chemical", "Tanker": "Oil",
    "Product Carrier": "Oil", "Shuttle Tanker": "Oil", "Oil Bunkering Tanker": "Oil",
    "Asphalt & Bitumen Carrier": "Other-Liquids", "FSO": "Other-Liquids",
    "LPG Carrier": "Liquified-Gas", "Ethylene/LPG": "Liquified-Gas", "Ethane/LPG": "Liquified-Gas",
    "General Cargo": "General", "Multi-Purpose": "General",
    "Multi-Purpose/Heavy Lift Cargo": "General", "Heavy Lift Cargo Vessel": "General",
    "Transport (Heavy Lift)": "General", "Semi-Submersible Heavy Lift": "General",
    "Multi-Purpose Support": "General", "Reefer": "Refrigerated-Cargo",
    "Reefer Fish Carrier": "Refrigerated-Cargo", "Pure Car Carrier": "Auto", "Ro-Ro": "Auto",
    "Ro-Ro/Container": "Auto", "Ro-Ro Freight/Passenger": "Auto", "Ro-Ro/Lo-Lo": "Auto",
    "Cruise Ship": "Passenger", "Pass./Car Ferry": "Passenger", "Passenger Vessel": "Passenger",
    "Passenger/Cargo Vessel": "Passenger", "Seismic Survey": "Research",
    "Trailing Suction Hopper Dredger": "Other", "Pipe Layer": "Other",
    "Cylindrical Floating Prod. Unit": "Other"}
# export ship type, finest level -> registry type
EXPORT_TYPE = {
    "Bulk Carrier": "Bulk Carrier", "Bulk Carrier, Self-discharging": "Bulk Carrier",
    "Bulk Carrier, Self-discharging, Laker": "Bulk Carrier", "Bulk Carrier, Laker Only": "Bulk Carrier",
    "Ore Carrier": "Ore Carrier", "Wood Chips Carrier": "Chip Carrier",
    "Cement Carrier": "Cement Carrier", "Limestone Carrier": "Aggregates Carrier",
    "Bulk/Caustic Soda Carrier (CABU)": "Bulk Carrier",
    "Bulk/Oil/Chemical Carrier (CLEANBU)": "Bulk Carrier", "Bulk/Oil Carrier (OBO)": "Bulk Carrier",
    "Container Ship (Fully Cellular)": "Fully Cellular Container",
    "Container Ship (Fully Cellular/Ro-Ro Facility)": "Fully Cellular Container",
    "Container/Ro-Ro Cargo Ship": "Ro-Ro/Container", "Barge Carrier": "Fully Cellular Container",
    "Crude Oil Tanker": "Tanker", "Crude/Oil Products Tanker": "Tanker",
    "Products Tanker": "Product Carrier", "Shuttle Tanker": "Shuttle Tanker",
    "Bunkering Tanker (Oil)": "Oil Bunkering Tanker", "Replenishment Tanker": "Tanker",
    "Chemical/Products Tanker": "Chemical & Oil Carrier", "Chemical Tanker": "Chemical Bulk Tanker",
    "LPG/Chemical Tanker": "Chemical Parcel Tanker", "Molten Sulphur Tanker": "Chemical Unknown Carrier",
    "Fruit Juice Carrier, Refrigerated": "Chemical Parcel Tanker", "LNG Tanker": "LPG Carrier",
    "LPG Tanker": "LPG Carrier", "Combination Gas Tanker (LNG/LPG)": "Ethylene/LPG",
    "Gas Processing Vessel": "LPG Carrier", "Bunkering Tanker (LNG)": "LPG Carrier",
    "FSO, Gas": "LPG Carrier", "Asphalt/Bitumen Tanker": "Product Carrier",
    "FSO, Oil": "Product Carrier", "FPSO, Oil": "Product Carrier",
    "General Cargo Ship": "General Cargo", "General Cargo Ship (Open Hatch)": "Open Hatch Carrier",
    "General Cargo Ship (with Ro-Ro facility)": "Multi-Purpose",
    "Heavy Load Carrier": "Heavy Lift Cargo Vessel",
    "Heavy Load Carrier, semi submersible": "Semi-Submersible Heavy Lift",
    "Yacht Carrier, semi submersible": "Semi-Submersible Heavy Lift",
    "Deck Cargo Ship": "General Cargo", "Palletised Cargo Ship": "General Cargo",
    "Replenishment Dry Cargo Vessel": "General Cargo", "Livestock Carrier": "General Cargo",
    "Nuclear Fuel Carrier": "General Cargo", "Vehicles Carrier": "Pure Car Carrier",
    "Rail Vehicles Carrier": "Ro-Ro", "Ro-Ro Cargo Ship": "Ro-Ro", "Landing Craft": "Ro-Ro",
    "Logistics Vessel (Naval Ro-Ro Cargo)": "Ro-Ro", "Refrigerated Cargo Ship": "Reefer",
    "Fish Carrier": "Reefer Fish Carrier", "Passenger Ship": "Passenger Vessel",
    "Passenger/Ro-Ro Ship (Vehicles)": "Ro-Ro Freight/Passenger", "Fishing Vessel": "Fishing Vessel",
    "Fish Factory Ship": "Fishing Vessel", "Fishery Patrol Vessel": "Fishing Vessel",
    "Research Survey Vessel": "Seismic Survey", "Yacht": "Yacht", "Yacht (Sailing)": "Yacht",
    "Sail Training Ship": "Yacht"}
# export main type -> registry type, used when the finest level is unknown
EXPORT_MAIN_TYPE = {
    "Bulker": "Bulk Carrier", "Container": "Fully Cellular Container", "Tanker": "Tanker",
    "General Cargo": "General Cargo", "RoRo": "Ro-Ro", "Reefer": "Reefer",
    "Passenger": "Passenger Vessel", "Other": "Other Vessel"}
LATEST_BUILD_YEAR = 2027
IMO_BLOCK = 100_000
IMO_RANGE = (1_000_000, 10_000_000)
DELIVERED = "In Service/Commission"

REGISTRY_COLUMNS = ["IMO Number", "Type", "Dwt", "Built Date", "SOx Scrubber Technology Type"]


def _number(name, kind="bigint"):
    text = F.trim(F.regexp_replace(F.col(f"`{name}`").cast("string"), ",", ""))
    return text.try_cast("double").cast(kind) if kind == "bigint" else text.try_cast(kind)


def _text_date(name):
    c = F.col(f"`{name}`").cast("string")
    forms = ["dd-MMM-yy", "dd-MMM-yyyy", "d-MMM-yyyy", "yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "MM/dd/yyyy"]
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in forms]).cast("date")


def _read_csv(spark, path):
    return (spark.read.option("header", True).option("encoding", "ISO-8859-1").csv(path)
            .withColumn("_file", F.input_file_name())
            .withColumn("_row", F.monotonically_increasing_id()))


def registry_type_class(x):
    return map_values(x, MODEL_CLASS, "Other")


def export_type(level5, main):
    """Registry type of an export row: finest level, then main type, then Other Vessel."""
    return F.coalesce(map_values(level5, EXPORT_TYPE), map_values(main, EXPORT_MAIN_TYPE),
                      F.lit("Other Vessel"))


def clean_registry(raw: DataFrame, order=("_file", "_row")) -> DataFrame:
    """imo, dwt, built, vessel_type_str, scrubber_tech; first row per imo in file order."""
    year = F.year(_text_date("Built Date"))
    tech = F.trim(F.coalesce(F.col("`SOx Scrubber Technology Type`"), F.lit("")))
    df = raw.select(
        _number("IMO Number").alias("imo"), _number("Dwt", "double").alias("dwt"),
        F.when(year <= LATEST_BUILD_YEAR, year).otherwise(year - 100).alias("built"),
        registry_type_class("Type").alias("vessel_type_str"),
        F.when(tech.isin("", "nan", "None"), "Unknown").otherwise(tech).alias("scrubber_tech"), *order)
    df = df.dropna(subset=["imo", "dwt", "built"])
    return first_per_key(df, ["imo"], order).drop(*order)


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    return clean_registry(_read_csv(spark, path))


def read_bands(spark: SparkSession, path: str) -> DataFrame:
    """Engine band tables: table, vessel_type_str, lo, hi (blank or inf = open), value, band_no."""
    raw = spark.read.option("header", True).csv(path)
    hi = F.col("hi").try_cast("double")
    return raw.select("table", "vessel_type_str", F.col("lo").cast("double").alias("lo"),
                      F.when(hi < float("inf"), hi).alias("hi"), F.col("value").cast("double").alias("value"),
                      F.col("band_no").cast("int").alias("band_no"))


def clean_installs(raw: DataFrame, order=("_file", "_row")) -> DataFrame:
    """imo, install_date: the retrofit date where the indicator is Y (dropped when blank),
    else the build date; only fitted systems when a status column exists."""
    has = lambda c: c in raw.columns
    retro = _text_date("SOx Scrubber Retrofit Date") if has("SOx Scrubber Retrofit Date") else F.lit(None).cast("date")
    flag = F.upper(F.trim(F.coalesce(F.col("`SOx Scrubber Retrofit Indicator`"), F.lit("")))) == "Y"
    df = raw
    if has("SOx Scrubber Status"):
        df = df.filter(F.trim(F.coalesce(F.col("`SOx Scrubber Status`"), F.lit(""))) == "Fitted")
    df = df.select(_number("IMO Number").alias("imo"),
                   F.when(flag, retro).otherwise(_text_date("Built Date")).alias("install_date"), *order)
    return first_per_key(df.dropna(subset=["imo", "install_date"]), ["imo"], order).drop(*order)


def read_installs(spark: SparkSession, path: str) -> DataFrame:
    return clean_installs(_read_csv(spark, path))


def imo_block(imo):
    """Block number of an imo: (a, b] ranges of 100,000 numbers; NULL outside the range."""
    x = as_col(imo)
    return F.when((x > IMO_RANGE[0]) & (x <= IMO_RANGE[1]), F.ceil(x / F.lit(IMO_BLOCK)).cast("long"))


def impute_built(df: DataFrame, imo: str = "imo", year: str = "year") -> DataFrame:
    """Fill missing build years with the median of the imo block and name the source.

    The median of whole years is taken over (year, count), so a block of any size is small.
    """
    known = df.filter(F.col(year).between(1900, 2030))
    counts = known.groupBy(imo_block(imo).alias("_block"), year).agg(F.count(F.lit(1)).alias("_n"))
    med = counts.groupBy("_block").agg(F.percentile(year, F.lit(0.5), F.col("_n")).alias("_median"))
    out = df.withColumn("_block", imo_block(imo)).join(med, "_block", "left")
    source = (F.when(F.col(year).isNotNull(), "status_date")
              .when(F.col("_median").isNotNull(), "imo_segment").otherwise("none"))
    return (out.withColumn("built_source", source)
            .withColumn(year, F.coalesce(F.col(year).cast("double"), "_median"))
            .drop("_block", "_median"))


def build_fleet(export: DataFrame, scrubbers: DataFrame | None = None,
                imo_list: DataFrame | None = None) -> DataFrame:
    """Registry rows from a vessel export, an optional scrubber register and an optional list
    of ships to keep. Ships without a valid size or build year are dropped."""
    df = export.withColumn("imo", _number("IMO_Number")).filter(F.col("imo").isNotNull())
    if imo_list is not None:
        wanted = imo_list.select(F.col(imo_list.columns[0]).try_cast("double").cast("bigint").alias("imo"))
        df = df.join(wanted, "imo", "left_semi")
    year = F.when(F.trim(F.coalesce("Ship_Status", F.lit(""))) == DELIVERED,
                  F.year(_text_date("Ship_Status_Effective_Date")))
    df = impute_built(df.withColumn("year", year))
    out = df.select(
        F.col("imo").alias("IMO Number"), export_type("Shiptype_Level_5", "Main_Vessel_Type").alias("Type"),
        _number("DWT", "double").alias("Dwt"),
        F.rint("year").cast("int").alias("built"), "built_source",
        F.col("Shiptype_Level_5").alias("sp_shiptype"), F.col("Ship_Status").alias("sp_status"))
    if scrubbers is None:
        out = out.withColumn("SOx Scrubber Technology Type", F.lit("No Scrubber"))
    else:
        order = [c for c in ("_file", "_row") if c in scrubbers.columns] or ["SOx Scrubber Technology Type"]
        tech = first_per_key(scrubbers.select(_number("IMO Number").alias("IMO Number"),
                                              "SOx Scrubber Technology Type", *[o for o in order if o.startswith("_")])
                             .filter(F.col("`IMO Number`").isNotNull()), ["IMO Number"], order)
        out = (out.join(tech.select("IMO Number", "SOx Scrubber Technology Type"), "IMO Number", "left")
               .fillna("No Scrubber", subset=["SOx Scrubber Technology Type"]))
    dated = out.withColumn("Built Date", F.format_string("01-Jul-%d", "built"))
    return dated.filter((F.col("Dwt") > 0) & F.col("built").isNotNull()).drop("built")


def read_export(spark: SparkSession, path: str) -> DataFrame:
    return _read_csv(spark, path)


read_scrubber_register = read_export
