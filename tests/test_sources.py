import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidewake.operators.emission import normal_imo
from tidewake.sources import observations, panels, places, positions, registry, tracks
from tidewake.streaming import daily as inc

OLD = "MMSI,BaseDateTime,LAT,LON,SOG,COG,Heading,VesselName,IMO,CallSign,VesselType,Status,Length,Width,Draft,Cargo,TransceiverClass\n"
NEW = "mmsi,base_date_time,longitude,latitude,sog,cog,heading,vessel_name,imo,call_sign,vessel_type,status,length,width,draft,cargo,transceiver\n"


def write(path, text):
    path.write_text(text)
    return str(path)


def test_positions_two_layouts(spark, tmp_path):
    a = write(tmp_path / "AIS_2024_01_02.csv", OLD + '1,2024-01-02T03:04:05,29.5,-90.1,x,0,0,A "quoted,IMO9123456,C,70,0,1,1,1,70,A\n1,bad,,,,,,,,,,,,,,,\n')
    b = write(tmp_path / "ais-2025-01-03.csv", NEW + "2,2025-01-03 00:00:01,-91.0,30.0,3.5,0,0,B, 9123457 ,C,1016,5,1,1,1,70,A\n")
    df = positions.read_positions(spark, str(tmp_path))
    rows = {r.MMSI: r for r in df.filter("BaseDateTime IS NOT NULL").collect()}
    assert rows[1].LAT == 29.5 and rows[1].SOG is None and rows[1].VesselName == 'A "quoted'
    assert rows[1].BaseDateTime == dt.datetime(2024, 1, 2, 3, 4, 5) and rows[1].date == dt.date(2024, 1, 2)
    assert rows[2].LON == -91.0 and rows[2].VesselType == 1016 and rows[2].date == dt.date(2025, 1, 3)
    assert df.count() == 3 and positions.merchant(df).count() == 2
    assert sorted(r[0] for r in df.filter("IMO IS NOT NULL").select(normal_imo("IMO")).collect()) == [9123456, 9123457]
    with pytest.raises(ValueError, match="missing"):
        positions.read_positions(spark, a, ["MMSI", "Nope"])
    assert positions.between_days(df, "2025-01-01").count() == 1
    pruned = positions.read_positions(spark, [a, b], start="2025-01-01")
    assert pruned.count() == 1 and [r.path.split("/")[-1] for r in positions.day_files(spark, [a, b], "2025-01-01").collect()] == ["ais-2025-01-03.csv"]
    (tmp_path / "AIS_2020_01_01.csv.gz").write_bytes(b"not compressed at all")     # never opened outside its day
    kept = positions.read_positions(spark, str(tmp_path), start="2024-01-01")
    assert kept.count() == 3 and positions.read_positions(spark, str(tmp_path), days=["2024-01-02"]).count() == 2
    with pytest.raises(Exception):
        positions.read_positions(spark, str(tmp_path)).count()


def test_null_guard(spark):
    day = dt.date(2024, 1, 1)
    df = spark.createDataFrame([(day, None, 1.0, None), (day, None, 1.0, None), (day, 1.0, 1.0, None)], "date date, LAT double, LON double, SOG double")
    r = positions.null_rates(df).first()
    assert r.error and r.warning and r.null_LAT == pytest.approx(2 / 3)
    with pytest.raises(ValueError, match="2024-01-01"):
        positions.require_parsed(df)
    assert positions.require_parsed(df.fillna(0.0, ["LAT"])).count() == 3


def test_sample_days(spark):
    df = spark.range(10).select(F.date_add(F.lit(dt.date(2024, 1, 1)), F.col("id").cast("int")).alias("date"))
    days = lambda n: sorted(r.date.day for r in positions.sample_days(df, n).collect())
    assert days(3) == [1, 4, 7] and days(40) == list(range(1, 11)) and days(4) == [1, 3, 5, 7]
    assert positions.only_days(df, ["2024-01-02", "2030-01-01"]).count() == 1


def geojson(tmp_path):
    sq = lambda x, y, s: [[x, y], [x + s, y], [x + s, y + s], [x, y + s], [x, y]]
    m = 111319.49079327358
    feats = [("Alpha, TX", "Coastal", "Polygon", [sq(-95, 29, 1), sq(-94.8, 29.2, .2)]),
             ("North, AK", "Coastal", "Polygon", [sq(-150, 60, 1)]), ("  ", "Coastal", "Polygon", [sq(0, 0, 1)]),
             ("Beta, LA", "Inland", "MultiPolygon", [[sq(-90 * m, 3503549.84, m)], [[[0, 0], [1, 1], [0, 0]]]]),
             ("Alpha, TX", "Coastal", "Polygon", [sq(-80, 25, 2)]), ("Dot, FL", "Coastal", "Point", [1, 2])]
    doc = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"PORTNAME": n, "TYPE": k}, "geometry": {"type": g, "coordinates": c}} for n, k, g, c in feats]}
    return write(tmp_path / "ports.geojson", json.dumps(doc, indent=1))


def test_polygons_and_points(spark, tmp_path):
    path = geojson(tmp_path)
    rings = places.read_polygons(spark, path).orderBy("ring_no").collect()
    assert [(r.ring_no, r.port) for r in rings] == [(0, "Alpha, TX"), (1, "Alpha, TX"), (2, "Beta, LA"), (3, "Alpha, TX")]
    beta = rings[2]
    assert beta.x0 == pytest.approx(-90, abs=1e-6) and beta.y0 == pytest.approx(30, abs=1e-4) and beta.x1 == pytest.approx(-89, abs=1e-6)
    pts = {r.port: r for r in places.read_port_points(spark, path).collect()}
    assert set(pts) == {"Alpha, TX", "Beta, LA"}
    assert (pts["Alpha, TX"].p_lat, pts["Alpha, TX"].p_lon) == pytest.approx((26, -79))
    assert pts["Beta, LA"].p_lon == pytest.approx(-89.5, abs=1e-6)
    assert {r.port for r in places.read_port_points(spark, path, types=["Inland"]).collect()} == {"Beta, LA"}


def test_tracks(spark, tmp_path):
    path = write(tmp_path / "tracks.csv", "SID,SEASON,NAME,ISO_TIME,NATURE,LAT,LON,USA_WIND,USA_PRES,USA_SSHS,LANDFALL,DIST2LAND\n"
                 " ,Year, , ,,degrees_north,degrees_east,kts,mb,1,km,km\nS1,2020,IDA,2020-08-01 00:00:00,TS,25.5,-80.1,35,1000,-1,10,20\n"
                 "S1,2020,IDA,2020-08-01 03:00:00,TS,25.9, ,35,1000,-1,10,20\nS0,2001,OLD,2001-08-01 03:00:00,TS,25.9,-80,35,1000,-1,10,20\n"
                 "S2,2021,X,2021-08-01 03:00:00,TS,26.0,-81, , ,0,10,20\n")
    rows = tracks.read_tracks(spark, path).orderBy("SID").collect()
    assert [(r.SID, r.LAT, r.USA_WIND) for r in rows] == [("S1", 25.5, 35.0), ("S2", 26.0, None)]


def test_registry_and_bands(spark, tmp_path):
    path = write(tmp_path / "reg.csv", 'IMO Number,Type,Dwt,Built Date,SOx Scrubber Technology Type\n9000001,Tanker,"40,000",01-Jul-08,Open Loop\n'
                 '9000001,Tanker,1,01-Jul-2010,\n9000002,Spaceship,5000,01-Jul-1995,\n9000003,FSO,7000,01-Jul-72,nan\n,Tanker,1,01-Jul-2010,\n9000004,Ro-Ro,,01-Jul-2010,\n')
    rows = {r.imo: r for r in registry.read_registry(spark, path).collect()}
    assert set(rows) == {9000001, 9000002, 9000003}
    assert (rows[9000001].dwt, rows[9000001].built, rows[9000001].vessel_type_str, rows[9000001].scrubber_tech) == (40000.0, 2008, "Oil", "Open Loop")
    assert (rows[9000002].vessel_type_str, rows[9000002].scrubber_tech, rows[9000002].built) == ("Other", "Unknown", 1995)
    assert (rows[9000003].vessel_type_str, rows[9000003].built) == ("Other-Liquids", 1972)
    bands = write(tmp_path / "bands.csv", "table,vessel_type_str,lo,hi,value,band_no\np_main,Oil,0,10000,5,0\np_main,Oil,10000,inf,9,1\n")
    assert [(r.lo, r.hi, r.value) for r in registry.read_bands(spark, bands).orderBy("lo").collect()] == [(0.0, 10000.0, 5.0), (10000.0, None, 9.0)]


def test_installs(spark, tmp_path):
    path = write(tmp_path / "scrub.csv", "IMO Number,SOx Scrubber Technology Type,Built Date,SOx Scrubber Retrofit Indicator,SOx Scrubber Retrofit Date,SOx Scrubber Status\n"
                 "1,Dry,2001-01-01,N,,Fitted\n2,Dry,2001-01-01, y ,2019-05-06,Fitted\n3,Dry,2001-01-01,Y,,Fitted\n4,Dry,2001-01-01,N,,Pending\n1,Dry,2005-01-01,N,,Fitted\n")
    got = {r.imo: r.install_date for r in registry.read_installs(spark, path).collect()}
    assert got == {1: dt.date(2001, 1, 1), 2: dt.date(2019, 5, 6)}


def test_fleet(spark, tmp_path):
    head = "IMO_Number,Shiptype_Level_5,Main_Vessel_Type,DWT,Ship_Status,Ship_Status_Effective_Date\n"
    path = write(tmp_path / "sp.csv", head + "9100001,Crude Oil Tanker,Tanker,1000,In Service/Commission,2004-03-01\n9100002,Unknown Thing,Bulker,500,Laid-Up,2010-01-01\n"
                 "9100003,Yacht,Other,0,In Service/Commission,2006-03-01\n9300001,Unknown,Unknown,10,Laid-Up,2010-01-01\n9100004,Yacht,Other,20,In Service/Commission,2008-03-01\n")
    scrub = write(tmp_path / "s.csv", "IMO Number,SOx Scrubber Technology Type\n9100001,Hybrid\n9100001,Dry\n")
    out = registry.build_fleet(registry.read_export(spark, path), registry.read_scrubber_register(spark, scrub))
    rows = {r["IMO Number"]: r for r in out.collect()}
    assert set(rows) == {9100001, 9100002, 9100004}
    assert rows[9100001]["SOx Scrubber Technology Type"] == "Hybrid" and rows[9100001]["Built Date"] == "01-Jul-2004"
    assert rows[9100002]["Type"] == "Bulk Carrier" and rows[9100002]["built_source"] == "imo_segment" and rows[9100002]["Built Date"] == "01-Jul-2006"
    assert rows[9100004]["Type"] == "Yacht"
    only = registry.build_fleet(registry.read_export(spark, path), imo_list=spark.createDataFrame([("9100004",)], "imo string"))
    assert [r["IMO Number"] for r in only.collect()] == [9100004]


def test_observations(spark, tmp_path):
    cat = write(tmp_path / "st.csv", "stid,station_name,lat,lon,iem_network\nHOU,Houston,29.6,-95.2,TX_ASOS\nXXX,Abroad,1,1,MX__ASOS\nYYY,Away,1,1,ZZ_ASOS\nNNN,Nowhere,,1,LA_ASOS\n")
    assert [r.station for r in observations.read_airport_stations(spark, cat).collect()] == ["HOU"]
    g = write(tmp_path / "g.json", json.dumps({"stations": [{"id": "87", "name": "Pier", "lat": 29.3, "lng": -94.8}]}))
    assert tuple(observations.read_gauge_stations(spark, g).first()) == ("87", "Pier", 29.3, -94.8)
    s = write(tmp_path / "8771_level.json", json.dumps({"data": [{"t": "2020-01-01 00:00", "v": "1.5", "s": "9"}, {"t": "2020-01-01 00:06", "v": ""}, {"t": "bad", "v": "1"}]}))
    assert [(r.station, r.v) for r in observations.read_series(spark, s).collect()] == [("8771", 1.5)]
    assert observations.read_series(spark, s, "s").first().v == 9.0
    r = write(tmp_path / "rain.csv", "station,valid,p01i\nHOU,2020-01-01 00:53,0.1\nHOU,2020-01-01 01:53,\nHOU,2020-01-01 02:53,T\n")
    assert observations.read_rain(spark, r).count() == 1


def test_released_tables(spark):
    wide = spark.createDataFrame([(1, 5.0, 7.0), (2, 0.0, None)], "port int, `2020-01-01` double, `2020-01-02` double")
    names = spark.createDataFrame([(1, "A"), (2, "B")], "id int, name string")
    got = sorted(tuple(r) for r in panels.wide_to_long(wide, names, "port").collect())
    assert got == [(dt.date(2020, 1, 1), "A", 5.0), (dt.date(2020, 1, 1), "B", 0.0), (dt.date(2020, 1, 2), "A", 7.0)]
    assert {r.port: r.port_mean for r in panels.port_means(wide, "port").collect()} == {1: 6.0, 2: 0.0}
    it = spark.createDataFrame([("2020123N", "A", "2020-01-01", "2020-01-03", 10.0, 2, 50.0, 1)],
                               "SID string, port string, start_date string, end_date string, DISTANCE double, SSHS int, WIND double, IF_LANDFALL int")
    r = panels.released_exposures(it).first()
    assert r.season == 2020 and r.exposure_end == dt.datetime(2020, 1, 3) and r.sshs_storm_lifetime == 2


def test_panel_scans_and_guards(spark, tmp_path):
    df = spark.createDataFrame([(dt.date(2020, 1, 1), "A", "port", 1.0), (dt.date(2020, 1, 1), "B", "outside", 0.0), (dt.date(2020, 1, 2), "C", "port", 0.0)],
                               "date date, complex string, tier string, v double")
    path = str(tmp_path / "panel")
    panels.write_days(df, path)
    back = panels.read_panel(spark, path, ["complex", "tier", "v", "date"])
    assert back.count() == 3
    ex = spark.createDataFrame([("A",), ("B",)], "port string")
    assert [r.complex for r in panels.study_panel(back, ex, "complex").collect()] == ["A"]
    with pytest.raises(ValueError, match="missing"):
        panels.read_panel(spark, path, ["nope"])
    with pytest.raises(ValueError, match="empty"):
        panels.require_activity(df.withColumn("v", F.lit(0.0)), ["v"])
    assert panels.require_activity(df, ["v"]).count() == 3
    # replacing one day leaves the other
    panels.write_days(df.filter("date = '2020-01-02'").withColumn("v", F.lit(9.0)), path)
    assert {r.complex: r.v for r in spark.read.parquet(path).collect()} == {"A": 1.0, "B": 0.0, "C": 9.0}
    panels.write_report(df, str(tmp_path / "rep"), ["complex"])
    assert spark.read.option("header", True).csv(str(tmp_path / "rep")).count() == 3


def test_incremental_runs(spark, tmp_path):
    src, out, ck = tmp_path / "src", str(tmp_path / "out"), str(tmp_path / "ck")
    src.mkdir()
    row = "1,2024-01-0{d} 03:04:05,29.5,-90.1,1,0,0,A,IMO9123456,C,70,0,1,1,1,70,A\n"
    write(src / "AIS_2024_01_01.csv", OLD + row.format(d=1))
    seen = []

    def count(m):
        out_df = m.groupBy("date").agg(F.count(F.lit(1)).alias("n"))
        seen.append(1)
        return out_df

    inc.run_new_files(spark, str(src), out, ck, count)
    write(src / "AIS_2024_01_02.csv", OLD + row.format(d=2) * 2)
    inc.run_new_files(spark, str(src), out, ck, count)
    inc.run_new_files(spark, str(src), out, ck, count)
    assert len(seen) == 2
    assert {r.date: r.n for r in spark.read.parquet(out).collect()} == {dt.date(2024, 1, 1): 1, dt.date(2024, 1, 2): 2}

    # another file of a day that is done, in the other layout: the day is whole afterwards
    write(src / "ais-2024-01-02.csv", NEW + "2,2024-01-02 00:00:01,-91.0,30.0,3.5,0,0,B, 9123457 ,C,1016,5,1,1,1,70,A\n")
    inc.run_new_files(spark, str(src), out, ck, count)
    assert {r.date.day: r.n for r in spark.read.parquet(out).collect()} == {1: 1, 2: 3}
    (src / "ais-2024-01-02.csv").unlink()

    out2 = str(tmp_path / "out2")
    df = positions.read_positions(spark, str(src))
    inc.append_new_days(df.filter("date = '2024-01-01'"), out2, count)
    inc.append_new_days(df, out2, lambda m: m.groupBy("date").agg((F.count(F.lit(1)) * 10).alias("n")))
    assert {r.date.day: r.n for r in spark.read.parquet(out2).collect()} == {1: 1, 2: 20}
