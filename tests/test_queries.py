"""A sample of registered queries against DuckDB on the smallest tables, and rules for all plans."""

import os

import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
SAMPLE = ["gap_credit_hours", "message_fuel", "port_day_emissions", "zone_day_emissions", "call_panel", "tier_map", "storm_exposure",
          "nearest_within_cap", "station_covariates", "so2_scenarios", "disruption_published", "window_rank", "window_elasticity",
          "placebo_shift", "series_rollup", "seasonal_normal", "placebo_normal", "pooled_ratio_ci", "mean_diff_ci", "permutation_p",
          "cluster_wls", "divergence_class", "anchored_pollutants", "arrival_scenarios", "agreement_metrics"]
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are not here")


@pytest.fixture(scope="module")
def duck():
    import duckdb
    from tools.check_oracle import TABLES
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_duckdb(spark, duck, name):
    from tools.check_oracle import same
    df = entry.queries()[name](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert same(df.toPandas(), duck.execute(entry.oracle_sql()[name]).df()) == ""


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    own = {name for name in entry.queries() if not name.startswith("op") and name != "pipeline"}
    assert sorted(own - set(entry.oracle_sql())) == ["fitted_baseline"]


def test_waiting_design_needs_only_its_groups(spark):
    """The sums that are stored for the design are those it reads; it is the same from all of them."""
    import driver_queries.outcomes as o
    from tidewake.operators import specifications as spc
    d = "/root/testdata/sf0.001"
    every, used = o.port_events(spark, d), o.port_events(spark, d, o.DESIGN_GROUPS)
    assert used.count() < every.count() / 2
    traits = o.port_table(spark, d)
    rows = [spc.waiting_design(e, traits, o.STS, o.HU).selectExpr("SID", "port", "window", "py", "round(log_hours_day, 9) AS h", "round(log_wait_hours_day, 9) AS w") for e in (every, used)]
    assert sorted(map(str, rows[0].collect())) == sorted(map(str, rows[1].collect()))


def test_gaps_are_ranked_by_the_nearest_logarithm(spark, duck, monkeypatch):
    """The KS distance of gap_table ranks gaps bit by bit, so they must be those of the SQL to the last bit."""
    import driver_queries.outcomes as o
    import driver_queries.ports as ports
    taken = []
    monkeypatch.setattr(ports.gr, "gap_table", lambda real, placebo, **kw: taken.extend([real, placebo]) or real)
    monkeypatch.setattr(ports, "rounded", lambda df, digits: df)
    ports.gap_table(spark, FOLDER)
    key = ["SID", "pn", "py", "window", "k_days"]
    got = {r[:5]: r[5] for r in taken[0].unionByName(taken[1]).where("g IS NOT NULL").select(*key, "g").collect()}
    sums = duck.execute(f"WITH {o.PSUM} SELECT SID, pn, py, \"window\", k_days, ln(obs_co2/exp_co2)-ln(obs_hours/exp_hours) FROM psum WHERE zone='total'").fetchall()
    assert got and got == {r[:5]: r[5] for r in sums}
