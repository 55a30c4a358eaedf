"""Vessel-position scans."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidewake.operators.sizing import checkpointed, spread

# fixed values: column names of the two feed layouts, lower case -> canonical
CANONICAL = {
    "mmsi": "MMSI", "base_date_time": "BaseDateTime", "basedatetime": "BaseDateTime",
    "latitude": "LAT", "lat": "LAT", "longitude": "LON", "lon": "LON", "sog": "SOG", "cog": "COG",
    "heading": "Heading", "vessel_name": "VesselName", "vesselname": "VesselName", "imo": "IMO",
    "call_sign": "CallSign", "callsign": "CallSign", "vessel_type": "VesselType",
    "vesseltype": "VesselType", "status": "Status", "length": "Length", "width": "Width",
    "draft": "Draft", "cargo": "Cargo", "transceiver": "TransceiverClass",
    "transceiverclass": "TransceiverClass"}
TYPES = {"MMSI": "bigint", "VesselType": "bigint", "Status": "bigint", "Cargo": "bigint",
         "LAT": "double", "LON": "double", "SOG": "double", "COG": "double", "Heading": "double",
         "Draft": "double", "Length": "double", "Width": "double"}
FILE_DAY = r"(?:AIS_|ais-)(\d{4})[_-](\d{2})[_-](\d{2})\.(?:csv|csv\.gz|parquet)"
# vessel types of merchant ships: 70..89 and five special codes
MERCHANT_TYPES = [*range(70, 90), 1003, 1004, 1016, 1017, 1024]
HARD_NULLS = {"LAT": 0.5, "LON": 0.5, "BaseDateTime": 0.5}
SOFT_NULLS = {"SOG": 0.9, "VesselType": 0.9, "Status": 0.9}
#: Different headers that one scan may have; a feed changes its layout every few years.
MAX_LAYOUTS = 1000


def file_day():
    """Day named in the input file, NULL when the name does not follow the pattern."""
    part = lambda i: F.regexp_extract(F.col("_metadata.file_name"), FILE_DAY, i)
    return F.concat_ws("-", part(1), part(2), part(3)).try_cast("date")


def named_day(path: str) -> str | None:
    """The same, of a path on the driver, as yyyy-mm-dd."""
    m = re.search(FILE_DAY + "$", path)
    return "-".join(m.groups()) if m else None


def day_files(spark: SparkSession, paths, start=None, end=None, days=None) -> DataFrame:
    """path and day of the files under paths, without opening them. With a range or a list of days, files that name another day are
    left out; in a range, files that name none stay."""
    part = lambda i: F.regexp_extract("path", FILE_DAY + "$", i)
    found = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths).select(F.col("_metadata.file_path").alias("path"))
             .withColumn("day", F.concat_ws("-", part(1), part(2), part(3)).try_cast("date")))
    return found.where(_wanted(F.col("day"), start, end, days))


def _wanted(day: Column, start, end, days) -> Column:
    keep = F.lit(True)
    if days is not None:
        keep = F.coalesce(day.isin(*[F.lit(str(d)).cast("date") for d in days]), F.lit(False))
    for bound, holds in ((start, day >= F.lit(str(start)).cast("date")), (end, day <= F.lit(str(end)).cast("date"))):
        if bound is not None:
            keep = keep & F.coalesce(holds, F.lit(True))
    return keep


def _first_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First line of each file; plain or compressed."""
    from urllib.parse import unquote

    from pyarrow import fs

    for batch in batches:
        lines = []
        for path in batch.column("path").to_pylist():
            system, place = fs.FileSystem.from_uri(unquote(path))
            with system.open_input_stream(place, compression="detect") as stream:
                text = b""
                while b"\n" not in text and (more := stream.read(1 << 14)):
                    text += more
            lines.append(text.split(b"\n", 1)[0].decode("utf-8", "replace").rstrip("\r").lstrip("\ufeff"))
        yield pa.record_batch([batch.column("path"), pa.array(lines, pa.string())], names=["path", "header"])


def headers(spark: SparkSession, files: DataFrame, paths) -> DataFrame:
    """path and header of every file, read in tasks. Where the tasks cannot open the store by themselves, the lines that name a ship's
    identity column are taken from a scan."""
    from pyarrow import fs

    one = files.select("path").limit(1).collect()
    try:
        if one:
            fs.FileSystem.from_uri(one[0].path)
        return spread(files.select("path"), "path").mapInArrow(_first_lines, "path string, header string")
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        lines = spark.read.option("recursiveFileLookup", True).text(paths).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "^\ufeff", "").alias("header"))
        return lines.where(F.lower("header").rlike("(^|,) *mmsi *(,|$)")).join(files.select("path"), "path", "left_semi")


def canonical(df: DataFrame) -> DataFrame:
    """Rename known columns case-insensitively, cast them, and parse the timestamp.

    Cells that do not parse become NULL; unknown columns pass through.
    """
    out = []
    for name in df.columns:
        want = CANONICAL.get(name.strip().lower(), name)
        c = F.col(f"`{name}`")
        if want == "BaseDateTime":
            text = F.replace(c.cast("string"), F.lit("T"), F.lit(" "))
            c = F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")
        elif want in TYPES:
            c = F.trim(c.cast("string")).try_cast(TYPES[want])
        out.append(c.alias(want))
    return df.select(*out)


def read_positions(spark: SparkSession, paths, columns=None, fmt: str = "csv", start=None, end=None, days=None) -> DataFrame:
    """Scan day files (plain or gz CSV, or Parquet) and add the `date` partition day from the file name, falling back to
    the timestamp. Quote characters are data.

    Layouts may be mixed: each CSV line is cut by the header of its own file, in one scan, and columns meet by name. Headers are read in
    tasks; only the distinct ones, as many as there are layouts, come to the driver. start, end and days (a list) prune files by
    the day in their names. Without files there is an error.
    """
    if fmt == "csv":
        files = day_files(spark, paths, start, end, days)
        known = checkpointed(headers(spark, files, paths))
        layouts = sorted(r.header for r in known.select("header").distinct().limit(MAX_LAYOUTS + 1).collect())
        if not layouts or len(layouts) > MAX_LAYOUTS:
            raise ValueError(f"no files in {paths}" if not layouts else f"over {MAX_LAYOUTS} different headers in {paths}")
        df = _cut_lines(spark, paths, known, layouts, start, end, days)
    else:
        df = canonical(spark.read.parquet(*([paths] if isinstance(paths, str) else paths)).withColumn("_day", file_day()))
    df = df.withColumn("date", F.coalesce("_day", F.to_date("BaseDateTime"))).drop("_day")
    if start is not None or end is not None:
        df = between_days(df, start, end)
    if columns:
        missing = [c for c in columns if c not in df.columns]
        if missing:
            raise ValueError(f"input is missing columns {missing}; it has {df.columns}")
        df = df.select(*columns, *([] if "date" in columns else ["date"]))
    return df


def _cut_lines(spark: SparkSession, paths, known: DataFrame, layouts: list[str], start, end, days) -> DataFrame:
    """Rows of all CSV files with canonical columns and the day of the file's name. The scan is pruned by that day."""
    lines = (spark.read.option("recursiveFileLookup", True).text(paths)
             .select("value", F.col("_metadata.file_path").alias("path"), file_day().alias("_day")).where(_wanted(file_day(), start, end, days)))
    rows = lines.join(known, "path").where((F.regexp_replace("value", "^\ufeff", "") != F.col("header")) & (F.length("value") > 0))
    place: dict[str, dict[int, int]] = {}
    for number, header in enumerate(layouts):
        for at, name in enumerate(header.split(",")):
            place.setdefault(CANONICAL.get(name.strip().lower(), name.strip()), {}).setdefault(number, at)
    layout = F.array_position(F.array(*[F.lit(h) for h in layouts]), F.col("header")) - 1
    cells = rows.select(F.split("value", ",", -1).alias("_c"), layout.alias("_layout"), "_day")

    def cell(where: dict[int, int]) -> Column:
        at = F.element_at(F.array(*[F.lit(where.get(i, -1)) for i in range(len(layouts))]), (F.col("_layout") + 1).cast("int"))
        return F.nullif(F.get("_c", at), F.lit(""))
    return canonical(cells.select(*[cell(where).alias(name) for name, where in place.items()], "_day"))


def between_days(df: DataFrame, start=None, end=None, day: str = "date") -> DataFrame:
    """Inclusive day range; on a table partitioned by day this prunes partitions."""
    out = df if start is None else df.filter(F.col(day) >= F.lit(start).cast("date"))
    return out if end is None else out.filter(F.col(day) <= F.lit(end).cast("date"))


def merchant(df: DataFrame) -> DataFrame:
    """Merchant ships with a time and a position."""
    return (df.filter(F.col("VesselType").isin(*MERCHANT_TYPES))
            .dropna(subset=["BaseDateTime", "LAT", "LON"]))


def null_rates(df: DataFrame, day: str = "date", hard=None, soft=None) -> DataFrame:
    """NULL share of the guarded columns per day with `error` and `warning` flags."""
    hard, soft = HARD_NULLS if hard is None else hard, SOFT_NULLS if soft is None else soft
    have = [c for c in [*hard, *soft] if c in df.columns]
    rate = lambda c: F.avg(F.when(F.col(c).isNull(), 1.0).otherwise(0.0))
    out = df.groupBy(day).agg(F.count(F.lit(1)).alias("n_rows"), *[rate(c).alias(f"null_{c}") for c in have])
    breach = lambda limits: F.greatest(F.lit(0), F.lit(0), *[
        (F.col(f"null_{c}") > m).cast("int") for c, m in limits.items() if c in have]) == 1
    return out.withColumn("error", breach(hard)).withColumn("warning", breach(soft))


def require_parsed(df: DataFrame, day: str = "date") -> DataFrame:
    """Return df, or raise if some day lost most of a required column when parsing."""
    bad = null_rates(df, day).filter("error").select(day).limit(5).collect()
    if bad:
        raise ValueError(f"required columns are mostly NULL after parsing on {[str(r[0]) for r in bad]}")
    return df


def sample_days(df: DataFrame, n: int, day: str = "date") -> DataFrame:
    """Even sample of n days: every (days // n)-th day, the first n of them.

    The day list has at most one row per calendar day; the rows come by semi-join.
    """
    days = df.select(day).distinct()
    ordered = days.agg(F.sort_array(F.collect_list(day)).alias("_d"))
    step = F.greatest(F.lit(1), F.floor(F.size("_d") / F.lit(n)).cast("int"))
    chosen = (ordered.withColumn("_step", step)
              .select(F.posexplode("_d").alias("_i", day), "_step")
              .filter((F.col("_i") % F.col("_step") == 0) & (F.col("_i") / F.col("_step") < n))
              .select(day))
    return df.join(chosen, day, "left_semi")


def only_days(df: DataFrame, days, day: str = "date") -> DataFrame:
    """Rows of an explicit day list."""
    return df.filter(F.col(day).isin(*[F.lit(x).cast("date") for x in days]))


__all__ = ["CANONICAL", "between_days", "canonical", "file_day", "merchant", "null_rates", "only_days",
           "day_files", "named_day", "read_positions", "require_parsed", "sample_days"]
