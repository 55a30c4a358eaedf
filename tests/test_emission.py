import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewake.operators import emission as em, exposure as ex, lookup, trajectory as tr

T0 = dt.datetime(2024, 1, 1)
BANDS = [(t, k, lo, hi, v, n) for k in ("Bulk", "Container", "Passenger") for t, v0 in
         (("p_main", 8000.0), ("v_design", 14.0), ("ae_sea", 900.0), ("ae_berth", 500.0), ("ae_anchor", 600.0), ("boiler", 200.0))
         for n, (lo, hi, v) in enumerate([(0.0, 50000.0, v0), (50000.0, None, v0 * 2)])]
BANDS += [(t, "Other-Liquids", 0.0, None, 100.0, 0) for t in ("ae_sea", "ae_berth", "ae_anchor", "boiler")]


def bands(spark):
    return spark.createDataFrame(BANDS, "table string, vessel_type_str string, lo double, hi double, value double, band_no int")


def fuel(spark, rows, kind="Bulk", dwt=10000.0, built=2010):
    reg = spark.createDataFrame([(1, dwt, built, kind, "Open Loop")], "imo long, dwt double, built int, vessel_type_str string, scrubber_tech string")
    m = spark.createDataFrame([(1, T0 + dt.timedelta(hours=h), s, i) for i, (h, s) in enumerate(rows)], "imo long, base_date_time timestamp_ntz, sog double, i int")
    m = m.withColumn("date", F.to_date("base_date_time"))
    return {r.i: r for r in em.message_fuel(m, reg, bands(spark), tie=["i"]).collect()}


def test_intervals_and_bad_speeds(spark):
    got = fuel(spark, [(0, 5.0), (3, 5.0), (6.01, 5.0), (7, 40.0), (8, 39.9), (8.5, None), (9, 1.0), (23.9, .5), (24.5, .5)])
    assert {i: round(r.dt_h, 4) for i, r in got.items()} == {0: 0, 1: 3, 2: 0, 4: 1.99, 6: 1, 7: 0, 8: 0}
    assert got[6].phase == "berth" and got[6].P_ME == 0 and got[6].P_AE == 500 and got[6].P_boiler == 200


def test_phases_and_power_cap(spark):
    got = fuel(spark, [(0, 1.0), (.1, 3.0), (.2, 3.1), (.3, 4.2), (.4, 14.0), (.5, 20.0)])
    assert [got[i].phase for i in range(6)] == ["berth", "anchor", "maneuver", "cruise", "cruise", "cruise"]
    assert got[5].P_ME == pytest.approx(.85 * 8000) and got[2].P_AE == pytest.approx(750) and got[5].P_boiler == 0
    r = got[3]
    load = max(r.P_ME / 8000, .07)
    assert r.P_ME == pytest.approx(8000 * .3 ** 3 * 1.15)
    assert r.fc_main_ton == pytest.approx(r.P_ME * 175 * (.455 * load ** 2 - .71 * load + 1.28) * .1 / 1e6)
    assert r.co2_ton == pytest.approx(3.114 * (r.fc_main_ton + r.fc_AE_ton + r.fc_boiler_ton))


def test_ship_without_main_band_has_null_not_nan(spark):
    got = fuel(spark, [(0, 10.0), (1, 10.0), (2, .5)], kind="Other-Liquids")
    assert got[1].phase == "maneuver" and got[1].fc_main_ton is None and got[1].fc_total_ton is None and got[1].fc_AE_ton > 0
    assert got[2].fc_main_ton == 0 and got[2].fc_total_ton > 0


def test_hull_and_band_edges(spark):
    sizes = spark.createDataFrame([("Bulk", 49999.0), ("Bulk", 50000.0), ("Bulk", -1.0), ("Moon", 5.0)], "vessel_type_str string, dwt double")
    got = {(r.vessel_type_str, r.dwt): r.p_main for r in lookup.band_join(sizes, bands(spark), "vessel_type_str", "dwt", ["p_main"]).collect()}
    assert got == {("Bulk", 49999.0): 8000.0, ("Bulk", 50000.0): 16000.0, ("Bulk", -1.0): None, ("Moon", 5.0): None}
    over = bands(spark).union(spark.createDataFrame([("p_main", "Bulk", 0.0, 1e9, 1.0, 9)], bands(spark).schema))
    assert lookup.band_join(sizes.limit(1), over, "vessel_type_str", "dwt", ["p_main"]).first().p_main == 1.0
    reg = spark.createDataFrame([(1, 203000.0, 1983, "Container", "x"), (2, 202999.0, 1984, "Container", "x"), (3, 1.0, 2001, "Passenger", "x")],
                                "imo long, dwt double, built int, vessel_type_str string, scrubber_tech string")
    e = {r.imo: r for r in em.ship_engines(reg, bands(spark)).collect()}
    assert [e[i].v_eff for i in (1, 2, 3)] == pytest.approx([28 * .75, 28, 14 * .7])
    assert [e[i].sfoc_main_base for i in (1, 2, 3)] == [205, 185, 185] and [e[i].sfoc_aux_base for i in (1, 2, 3)] == [225, 205, 195]


def test_sulfur_parts_add_up(spark):
    rows = [(dt.date(y, 1, 1), t, 100.0) for y in (2014, 2016, 2021) for t in em.SCRUBBER_REMOVAL] + [(dt.date(2021, 1, 1), None, None), (dt.date(2021, 1, 1), "New Kind", 10.0)]
    p = spark.createDataFrame(rows, "date date, scrubber_tech string, fc_total_ton double")
    for mode in ("never", "always", None, 2020, "year"):
        s = em.split_sulfur(p, mode).collect()
        assert all(r.so2_air_ton + r.so2_washwater_ton + r.so2_retained_ton == pytest.approx(r.so2_total_ton) for r in s)
        assert all(r.scrubber_fitted == 0 for r in s if r.scrubber_tech == "No Scrubber" or mode in ("never", None))
    r = {(x.date.year, x.scrubber_tech): x for x in em.split_sulfur(p, 2020).collect()}
    assert r[2016, "Dry"].scrubber_fitted == 0 and r[2021, "Dry"].so2_retained_ton == pytest.approx(100 * 2 * .97753 * .035 * .99)
    assert r[2021, "New Kind"].so2_washwater_ton > 0 and em.so2_factor(.035) / em.so2_factor(.001) == pytest.approx(35)
    flagged = p.withColumn("scrubber_fitted", F.lit(0))
    assert all(x.scrubber_fitted == 0 for x in em.split_sulfur(flagged, 2015).collect())
    assert any(x.scrubber_fitted for x in em.split_sulfur(flagged, "year").collect())
    assert {x.scenario for x in em.sulfur_scenarios(flagged).collect()} == {"never fitted", "install dates", "always fitted"}


def test_restrict_classes_rejects_unknown(spark):
    p = spark.createDataFrame([("a", "cargo", 1.0, 2), ("a", "tanker", 2.0, 3), ("a", "other", 9.0, 9)], "port string, vclass string, co2_ton double, n int")
    assert tuple(em.restrict_classes(p, ["cargo", "tanker"], ["port"]).first()) == ("a", 3.0, 5)
    with pytest.raises(ValueError, match="submarine"):
        em.restrict_classes(p, ["cargo", "submarine"], ["port"])


def test_visits_and_calls(spark):
    h = lambda x: T0 + dt.timedelta(hours=x)
    pieces = [(1, "P", None, h(0), h(2), 3), (1, "P", 77, h(8), h(9), 1), (1, "P", 78, h(16), h(19.9), 2), (2, "P", 5, h(20), h(24), 1), (3, "P", 6, h(1), h(60), 9)]
    df = spark.createDataFrame(pieces, "mmsi long, port string, imo long, first_seen timestamp_ntz, last_seen timestamp_ntz, n_msgs long")
    v = tr.stitch_visits(df, ship="mmsi", port="port")
    got = sorted((r.mmsi, r.visit_no, r.imo, r.duration_h, r.is_call, r.n_msgs) for r in v.collect())
    assert got == [(1, 1, None, 9.0, True, 4), (1, 2, None, pytest.approx(3.9), False, 2), (2, 1, 5, 4.0, True, 1), (3, 1, 6, 59.0, True, 9)]
    panel = {r.date.day: r for r in tr.call_panel(v, ship="mmsi", port="port").collect()}
    assert (panel[1].port_calls, panel[1].distinct_vessels, panel[1].vessels_present, panel[1].median_duration_h) == (3, 3, 3, 9.0)
    assert (panel[2].port_calls, panel[2].vessels_present, panel[2].median_duration_h) == (0, 2, None)
    assert panel[3].vessels_present == 1


def test_gap_panel_uses_in_port_messages(spark):
    h = lambda x: T0 + dt.timedelta(hours=x)
    rows = [(1, h(0), "P", 0.0), (1, h(1), None, 1.0), (1, h(5), "P", 0.0), (1, h(6), "P", 1.0)]
    df = spark.createDataFrame(rows, "imo long, t timestamp_ntz, port string, dt_h double").withColumn("date", F.to_date("t"))
    r = tr.gap_panel(df, ship="imo", time="t", day="date", port="port").first()
    assert (r.n_messages, r.n_vessels, r.hours_credited, r.hours_discarded, r.n_gaps_over) == (3, 1, 1.0, 5.0, 1)
    assert r.discard_share == pytest.approx(5 / 6)


def test_tier_map_rules(spark):
    v = spark.createDataFrame([(0, 0, "A", 0.0, 0.0)], "ring_no int, pos int, port string, v_lat double, v_lon double")
    mk = lambda res, gy, n, m, a, u: (res, gy, 0, n, m, a, u, gy * res, 0.0)
    rows = [mk(.005, 1, 20, 9, 1, 10), mk(.005, 2, 20, 2, 9, 9), mk(.005, 100, 20, 0, 20, 0), mk(.005, 300, 20, 0, 20, 0), mk(.005, 3, 19, 19, 0, 0),
            mk(.005, 4, 20, 0, 0, 20), mk(.05, 1, 20, 0, 0, 20), mk(.05, 10, 20, 0, 0, 20), mk(.05, 2, 20, 10, 0, 10)]
    df = spark.createDataFrame(rows, "res_deg double, gy long, gx long, n_msg long, n_moored long, n_anchored long, n_underway long, lat double, lon double")
    got = {(r.res_deg, r.gy): r.tier for r in ex.tier_map(df, v).collect()}
    assert got == {(.005, 1): "port", (.005, 2): "anchorage", (.005, 100): "offshore_hold", (.005, 300): "offshore", (.05, 1): "channel", (.05, 10): "offshore"}


def test_exposure_ties_and_missing_category(spark):
    h = lambda x: T0 + dt.timedelta(hours=x)
    tk = [("S", "ONE", 2024, h(3), 0.0, 1.0, 40.0, None, None, 0.0, None), ("S", "ONE", 2024, h(0), 0.0, -1.0, 60.0, None, None, 5.0, 0.0), ("S", "ONE", 2024, h(9), 0.0, 50.0, 99.0, None, None, 0.0, 0.0), ("F", "FAR", 2024, h(0), 50.0, 50.0, 9.0, 1.0, 2.0, 0.0, 0.0)]
    track = spark.createDataFrame(tk, "SID string, NAME string, SEASON int, ISO_TIME timestamp_ntz, LAT double, LON double, USA_WIND double, USA_PRES double, USA_SSHS double, LANDFALL double, DIST2LAND double")
    ports = spark.createDataFrame([("P", 0.0, 0.0)], "port string, p_lat double, p_lon double")
    rows = ex.exposures(track, ports).collect()
    assert len(rows) == 1
    r = rows[0]
    assert r.closest_time == h(0) and r.wind_at_closest_kt == 60 and r.wind_max_in_window_kt == 60 and r.exposure_hours == 3
    assert r.sshs_storm_lifetime == -9 and r.near_land_in_window == 1 and r.landfall_in_window == 1
    assert ex.select_storms(track, name="one").count() == 3 and ex.select_storms(track, seasons=(2025, 2026)).count() == 0
