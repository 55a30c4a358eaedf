"""Pooled results, inference, classification and products on event-level tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewake.functions.binning import cut
from tidewake.functions.numeric import ratio
from tidewake.operators import emission as em, normal as nm, products as pr, quantiles as qt, regress as rg, resample as rs, specifications as spc

from tidewake.operators.sizing import checkpointed
from . import standins as s
from .standins import draw_sql, rounded, sql
from .study import boot_sql

Q, SQL = {}, {}


def query(name, text=None):
    def keep(fn):
        Q[name] = fn
        if text:
            SQL[name] = text
        return fn
    return keep


VCLASS = ["tanker", "cargo", "passenger", "other", "all"]
TIER = [*nm.TIERS, "total"]
MEASURE = ["hours", "co2_ton", "fc_main_ton", "fc_AE_ton", "fc_boiler_ton"]
PHASE = ["prep", "storm", "after"]
WINDOW = ["storm", "after", "event30"]
TS, STS, HU = nm.INTENSITY_LABELS
INTENSITY = f"CASE WHEN 30+(l_suppkey*7)%90 <= 49 THEN '{TS}' WHEN 30+(l_suppkey*7)%90 <= 63 THEN '{STS}' ELSE '{HU}' END"
nth = s._nth


def _cols(div, dbl):
    """The same derived columns for Spark (div) and DuckDB (//)."""
    q = lambda a, b: f"({a} {div} {b})"
    return dict(
        SID="l_suppkey", py=f"{q('l_orderkey', 750)} % 4", vclass=nth("l_partkey % 5", VCLASS), tier=nth(f"{q('l_partkey', 5)} % 6", TIER),
        measure=nth("l_orderkey % 5", MEASURE), phase=nth(f"{q('l_orderkey', 5)} % 3", PHASE), k_days="1 + (l_suppkey + l_linenumber) % 5",
        rel_day=f"{q('l_orderkey', 15)} % 50 - 2", obs="l_quantity", expected=f"l_quantity * (0.8{dbl} + 4*l_discount)", outside="l_tax > 0.065",
        wind="30 + (l_suppkey*7) % 90", dist=f"((l_suppkey*31) % 500) / 2.5{dbl}", intensity=INTENSITY)


RES = "res AS (SELECT 'P' || l_linenumber AS unit, " + ", ".join(f"{e} AS {n}" for n, e in _cols("//", "::DOUBLE").items()) + " FROM lineitem)"


def res(spark, d):
    return s.table(spark, d, "lineitem").selectExpr("concat('P', l_linenumber) AS unit", *[f"{e} AS {n}" for n, e in _cols("div", "D").items()]) \
        .withColumn("delta", F.col("obs") - F.col("expected")).withColumn("k_days", F.col("k_days").cast("int"))


def _wcols(div, dbl):
    q = lambda a, b: f"({a} {div} {b})"
    return dict(SID="l_suppkey", py=f"{q('l_orderkey', 18)} % 4", window=nth("l_orderkey % 3", WINDOW), zone=nth(f"{q('l_orderkey', 3)} % 6", TIER),
                k_days="1 + (l_suppkey + l_linenumber % 2) % 5", wind="30 + (l_suppkey*7) % 90", intensity=INTENSITY)


SUMS = dict(obs_hours="l_quantity*10", exp_hours="l_quantity*10*(0.8{d} + 4*l_discount)", obs_co2="l_extendedprice/1000",
            exp_co2="l_extendedprice/1000*(0.8{d} + 5*l_tax)", obs_nox="l_extendedprice*(1+l_tax)/10000", exp_nox="l_extendedprice*(1+l_discount)/10000",
            obs_pm25="l_quantity*(1+l_tax)/100", exp_pm25="l_quantity*(1+l_discount)/100")
WSUM = ("wsum AS (SELECT 'P' || (l_linenumber % 2) AS unit, " + ", ".join(f'{e} AS "{n}"' for n, e in _wcols("//", "::DOUBLE").items()) + ", "
        + ", ".join(f"sum({e.format(d='::DOUBLE')}) AS {n}" for n, e in SUMS.items()) + " FROM lineitem GROUP BY ALL)")


def wsum(spark, d):
    """Window sums per event and zone, a stored table in practice."""
    keys = _wcols("div", "D")
    rows = s.table(spark, d, "lineitem").selectExpr("concat('P', l_linenumber % 2) AS unit", *[f"{e} AS {n}" for n, e in keys.items()],
                                                    *[f"{e.format(d='D')} AS {n}" for n, e in SUMS.items()])
    return checkpointed(rows.groupBy("unit", *keys).agg(*[F.sum(n).alias(n) for n in SUMS]))


RATIO = {"ratio": "obs/nullif(expected,0)"}
OE = {"obs": "obs", "expected": "expected"}
R5 = lambda *names: ", ".join(f"round({n},5) AS {n}" for n in names)
CI = lambda n: (n, f"{n}_lo", f"{n}_hi")

# ---------------------------------------------------------------- pooled ratios
@query("pooled_ratio_ci", sql(RES, boot_sql("res", "intensity", "SID", OE, RATIO, 1000, 1, extra_where="WHERE py=0 AND vclass='all' AND measure='co2_ton' AND tier='total'"),
       body=f"SELECT intensity, n_clusters, {R5(*CI('ratio'))} FROM bt"))
def pooled_ratio_ci(spark, d):
    r = res(spark, d).filter("py = 0 AND vclass = 'all' AND measure = 'co2_ton' AND tier = 'total'")
    return rounded(rs.boot_ratio(r, ["intensity"], "SID", "obs", "expected"), {c: 5 for c in CI("ratio")})


@query("pooled_ratios", sql(RES, boot_sql("res", "intensity, tier, phase", "SID", OE, RATIO, 1000, 1, extra_where="WHERE py=0 AND vclass='all'"),
       "sz AS (SELECT intensity, tier, phase, count(*) AS n, sum(obs-expected) AS delta, avg(CASE WHEN outside THEN 1 ELSE 0 END) AS share_outside FROM res WHERE py=0 AND vclass='all' GROUP BY ALL HAVING count(*)>=5)",
       body=f"SELECT intensity, tier, phase, n, n_clusters, round(delta,3) AS delta, round(share_outside,6) AS share_outside, {R5(*CI('ratio'))} FROM sz JOIN bt USING (intensity, tier, phase)"))
def pooled_ratios(spark, d):
    out = pr.pooled_ratios(res(spark, d).filter("py = 0 AND vclass = 'all'"), ["intensity", "tier", "phase"], draws=1000)
    return rounded(out, {"delta": 3, "share_outside": 6, **{c: 5 for c in CI("ratio")}})


W4 = {"n1": "obs_co2", "d1": "obs_hours", "n2": "exp_co2", "d2": "exp_hours"}


@query("ratio_of_ratios_ci", sql(WSUM, boot_sql("wsum", "intensity, zone", "SID", W4, {"rr": "(n1/d1)/(n2/d2)", "gap": "n1/n2-d1/d2"}, 1000, 1, extra_where="WHERE py=0 AND \"window\"='storm'"),
       body=f"SELECT intensity, zone, n_clusters, {R5(*CI('rr'), *CI('gap'))} FROM bt"))
def ratio_of_ratios_ci(spark, d):
    w = wsum(spark, d).filter("py = 0 AND window = 'storm'")
    out = rs.bootstrap(w, ["intensity", "zone"], "SID", ["obs_co2", "obs_hours", "exp_co2", "exp_hours"],
                       {"rr": rs.ratio_of_ratios("obs_co2", "obs_hours", "exp_co2", "exp_hours"), "gap": rs.ratio_gap("obs_co2", "exp_co2", "obs_hours", "exp_hours")}, draws=1000)
    return rounded(out, {c: 5 for c in (*CI("rr"), *CI("gap"))})


def contrast_sql(prefix, source, where, stat, draws, seed, sums):
    t = boot_sql(source, "window_", "SID", sums, {"st": stat}, draws, seed, extra_where=where)
    for n in ("cs", "ci", "ct", "sl", "dr", "bs", "es", "bt"):
        t = t.replace(f"{n} AS (", f"{prefix}{n} AS (").replace(f"FROM {n} ", f"FROM {prefix}{n} ").replace(f"FROM {n})", f"FROM {prefix}{n})").replace(f"FROM {n},", f"FROM {prefix}{n},").replace(f"JOIN {n} ", f"JOIN {prefix}{n} ").replace(f"FROM {n}\n", f"FROM {prefix}{n}\n")
    return t


MEAN = {"sv": "g", "nv": "1"}
GAPS = """gaps AS (SELECT SID, unit, py, "window" AS window_, ln(obs_co2/exp_co2)-ln(obs_hours/exp_hours) AS g FROM wsum WHERE zone='total')"""


def contrast_body(op):
    return f"""SELECT e1.window_ AS "window", round(e1.st,5) AS first, round(e2.st,5) AS second, round(e1.st {op} e2.st,5) AS contrast, round(lo,5) AS contrast_lo, round(hi,5) AS contrast_hi FROM aes e1 JOIN bes e2 USING (window_) JOIN
 (SELECT window_, quantile_cont(x.st {op} y.st,0.025) AS lo, quantile_cont(x.st {op} y.st,0.975) AS hi FROM adx x JOIN bdx y USING (window_, draw) GROUP BY window_) q USING (window_)"""


@query("mean_diff_ci", sql(WSUM, GAPS, contrast_sql("a", "gaps", "WHERE py=0", "sv/nv", 1000, 5, MEAN), contrast_sql("b", "gaps", "WHERE py<>0", "sv/nv", 1000, 6, MEAN),
       "adx AS (SELECT *, sv/nv AS st FROM adr)", "bdx AS (SELECT *, sv/nv AS st FROM bdr)", body=contrast_body("-")))
def mean_diff_ci(spark, d):
    w = wsum(spark, d).filter("zone = 'total'").selectExpr("SID", "window", "py", "ln(obs_co2/exp_co2) - ln(obs_hours/exp_hours) AS g")
    out = rs.boot_mean_difference(w.filter("py = 0"), w.filter("py <> 0"), ["window"], "SID", "g", draws=1000)
    return rounded(out.select("window", "first", "second", "contrast", "contrast_lo", "contrast_hi"), {c: 5 for c in ("first", "second", "contrast", "contrast_lo", "contrast_hi")})


INT4 = {"a": "obs_nox", "b": "obs_co2", "c": "exp_nox", "e": "exp_co2"}
TOTALW = """tw AS (SELECT *, "window" AS window_ FROM wsum WHERE zone='total')"""


@query("pollutant_per_co2", sql(WSUM, TOTALW, contrast_sql("a", "tw", "WHERE py=0", "(a/b)/(c/e)", 1000, 5, INT4), contrast_sql("b", "tw", "WHERE py<>0", "(a/b)/(c/e)", 1000, 6, INT4),
       "adx AS (SELECT *, (a/b)/(c/e) AS st FROM adr)", "bdx AS (SELECT *, (a/b)/(c/e) AS st FROM bdr)", body=contrast_body("/")))
def pollutant_per_co2(spark, d):
    w = wsum(spark, d).filter("zone = 'total'")
    out = rs.boot_contrast(w.filter("py = 0"), w.filter("py <> 0"), ["window"], "SID", ["obs_nox", "obs_co2", "exp_nox", "exp_co2"],
                           rs.ratio_of_ratios("obs_nox", "obs_co2", "exp_nox", "exp_co2"), lambda x, y: ratio(x, y), draws=1000)
    return rounded(out.select("window", "first", "second", "contrast", "contrast_lo", "contrast_hi"), {c: 5 for c in ("first", "second", "contrast", "contrast_lo", "contrast_hi")})


PAIRS = """pp AS (SELECT SID, unit, "window", py, obs_co2 AS obs, exp_co2 AS expected FROM wsum WHERE zone='total'),
rw AS (SELECT *, row_number() OVER (PARTITION BY "window", SID, unit ORDER BY py)-1 AS j FROM pp WHERE py<>0),
sz AS (SELECT "window", SID, unit, count(*) AS m, (('0x' || substr(md5(CAST(SID AS VARCHAR) || '|' || unit),1,8))::BIGINT) % 1000003 AS slot FROM pp WHERE py<>0 GROUP BY ALL)"""


@query("permutation_p", sql(WSUM, PAIRS, f"""pk AS (SELECT "window", SID, unit, draw, {draw_sql('draw', 'slot', 'm', 7)} AS j FROM sz, range(1,2001) r(draw)),
dw AS (SELECT pk."window", draw, sum(obs)/sum(expected) AS r FROM pk JOIN rw ON pk."window"=rw."window" AND pk.SID=rw.SID AND pk.unit=rw.unit AND pk.j=rw.j GROUP BY ALL),
tr AS (SELECT "window", sum(obs)/sum(expected) AS real_ratio FROM pp WHERE py=0 GROUP BY "window")""",
       body="""SELECT "window", round(real_ratio,6) AS real_ratio, round(quantile_cont(r,0.5),6) AS null_median, round(quantile_cont(r,0.025),6) AS null_lo, round(quantile_cont(r,0.975),6) AS null_hi, round((sum(CASE WHEN abs(ln(r))>=abs(ln(real_ratio))-1e-12 THEN 1 ELSE 0 END)+1)/(count(*)+1),6) AS p_perm FROM dw JOIN tr USING ("window") GROUP BY "window", real_ratio"""))
def permutation_p(spark, d):
    w = wsum(spark, d).filter("zone = 'total'").selectExpr("SID", "unit", "window", "py", "obs_co2 AS obs", "exp_co2 AS expected")
    out = rs.permutation_test(w.filter("py = 0"), w.filter("py <> 0"), ["window"], ["SID", "unit"], "py", draws=2000)
    return rounded(out, {c: 6 for c in ("real_ratio", "null_median", "null_lo", "null_hi", "p_perm")})


@query("leave_one_out", sql(WSUM, """ow AS (SELECT "window", SID, sum(obs_co2) AS o, sum(exp_co2) AS e FROM wsum WHERE py=0 GROUP BY ALL),
tt AS (SELECT *, sum(o) OVER w AS so, sum(e) OVER w AS se FROM ow WINDOW w AS (PARTITION BY "window")), rr AS (SELECT *, so/se AS f, (so-o)/(se-e) AS r FROM tt)""",
       body="""SELECT "window", round(any_value(f),6) AS "full", round(min(r),6) AS "min", round(max(r),6) AS "max", arg_min(SID, (-round(abs(r-f),12), SID)) AS most_influential, count(*) AS n_units FROM rr GROUP BY "window" """))
def leave_one_out(spark, d):
    out = rs.leave_one_out(wsum(spark, d).filter("py = 0"), ["window"], "SID", "obs_co2", "exp_co2")
    return rounded(out, {"full": 6, "min": 6, "max": 6})


UX = "ux AS (SELECT SID AS u, sum(obs_co2-exp_co2) AS v FROM wsum WHERE py=0 AND \"window\"='after' GROUP BY SID)"


@query("topk_concentration", sql(WSUM, UX, "rk AS (SELECT *, row_number() OVER (ORDER BY v DESC, u) AS r FROM ux WHERE v>0)",
       body="SELECT 'top' AS scope, k AS units, CAST(count(*) AS BIGINT) AS n_used, round(sum(v)/(SELECT sum(v) FROM rk),6) AS share FROM rk JOIN (VALUES (1),(2),(3),(5),(8)) t(k) ON r<=k GROUP BY k UNION ALL SELECT 'all positive', CAST(count(*) AS INT), count(*), 1.0 FROM rk"))
def topk_concentration(spark, d):
    u = wsum(spark, d).filter("py = 0 AND window = 'after'").selectExpr("SID AS u", "obs_co2 - exp_co2 AS v")
    return rounded(rs.topk_share(u, "u", "v").select("scope", "units", "n_used", "share"), {"share": 6})


@query("ranked_cumulative_share", sql(WSUM, body="""SELECT u, row_number() OVER (ORDER BY v DESC, u) AS rank, round(sum(v) OVER (ORDER BY v DESC, u ROWS UNBOUNDED PRECEDING)/sum(v) OVER (),6) AS cum_share FROM (SELECT SID AS u, sum(obs_co2) AS v FROM wsum GROUP BY SID)"""))
def ranked_cumulative_share(spark, d):
    u = wsum(spark, d).groupBy(F.col("SID").alias("u")).agg(F.sum("obs_co2").alias("v"))
    return rounded(qt.cumulative_share(u, [], "u", "v").select("u", "rank", "cum_share"), {"cum_share": 6})


@query("left_out_ratios", sql(WSUM, body="SELECT SID AS left_out, round((sum(o) OVER () - o)/(sum(e) OVER () - e),6) AS ratio FROM (SELECT SID, sum(obs_co2) AS o, sum(exp_co2) AS e FROM wsum WHERE py=0 GROUP BY SID)"))
def left_out_ratios(spark, d):
    out = rs.left_out_sums(wsum(spark, d).filter("py = 0"), "SID", ["obs_co2", "exp_co2"])
    return rounded(out.select("left_out", ratio("obs_co2", "exp_co2").alias("ratio")), {"ratio": 6})


# ---------------------------------------------------------------- regressions
REG = "rg AS (SELECT SID, unit, ln(obs_co2/exp_co2) AS y, wind/10.0::DOUBLE AS x, exp_hours AS w FROM wsum WHERE py=0 AND zone='total' AND \"window\"='storm')"


def reg_rows(spark, d):
    return wsum(spark, d).filter("py = 0 AND zone = 'total' AND window = 'storm'").selectExpr("SID", "unit", "ln(obs_co2/exp_co2) AS y", "wind/10D AS x", "exp_hours AS w")


def ols_sql(weight):
    w = "w" if weight else "1.0::DOUBLE"
    return (f"m AS (SELECT count(*) AS n, sum({w}) AS s0, sum({w}*x) AS s1, sum({w}*x*x) AS s2, sum({w}*y) AS t0, sum({w}*x*y) AS t1 FROM rg)",
            "bt_ AS (SELECT *, s0*s2-s1*s1 AS det, (s2*t0-s1*t1)/(s0*s2-s1*s1) AS b0, (s0*t1-s1*t0)/(s0*s2-s1*s1) AS b1 FROM m)",
            f"uc AS (SELECT SID, sum({w}*(y-b0-b1*x)) AS u0, sum({w}*x*(y-b0-b1*x)) AS u1 FROM rg, bt_ GROUP BY SID)",
            "mt AS (SELECT count(*) AS g, sum(u0*u0) AS m00, sum(u0*u1) AS m01, sum(u1*u1) AS m11 FROM uc)",
            """vv AS (SELECT *, (s2*s2*m00-2*s1*s2*m01+s1*s1*m11)/(det*det)*(g/(g-1.0::DOUBLE))*((n-1.0::DOUBLE)/(n-2)) AS v0, (s1*s1*m00-2*s0*s1*m01+s0*s0*m11)/(det*det)*(g/(g-1.0::DOUBLE))*((n-1.0::DOUBLE)/(n-2)) AS v1 FROM bt_, mt)""")


OLS = "SELECT 'intercept' AS term, round(b0,6) AS coef, round(sqrt(v0),6) AS se, n, g AS n_clusters FROM vv UNION ALL SELECT 'x', round(b1,6), round(sqrt(v1),6), n, g FROM vv"


@query("cluster_ols", sql(WSUM, REG, *ols_sql(False), body=OLS))
def cluster_ols(spark, d):
    return rounded(rg.cluster_ols(reg_rows(spark, d), "y", ["x"], "SID").select("term", "coef", "se", "n", "n_clusters"), {"coef": 6, "se": 6})


@query("cluster_wls", sql(WSUM, REG, *ols_sql(True), body=OLS))
def cluster_wls(spark, d):
    return rounded(rg.cluster_ols(reg_rows(spark, d), "y", ["x"], "SID", weight="w").select("term", "coef", "se", "n", "n_clusters"), {"coef": 6, "se": 6})


def focus_sql(prefix, source):
    """Coefficient of x and its variances clustered by storm (s), port (p) and both at once (sp), after the other terms are
    partialled out: xt and yt are residuals on them, k counts all terms."""
    one = lambda name, cols: (f"{prefix}{name} AS (SELECT sp, g/(g-1.0::DOUBLE)*((n-1.0::DOUBLE)/(n-k))*m/(sxx*sxx) AS v FROM (SELECT sp, count(*) AS g, sum(u*u) AS m FROM "
                              f"(SELECT e.sp, {cols}, sum(xt*(yt-b*xt)) AS u FROM {source} e JOIN {prefix}b USING (sp) GROUP BY e.sp, {cols}) GROUP BY sp) JOIN {prefix}b USING (sp))")
    parts = [f"{prefix}b AS (SELECT sp, any_value(k) AS k, count(*) AS n, sum(xt*xt) AS sxx, sum(xt*yt)/sum(xt*xt) AS b FROM {source} GROUP BY sp)", one("s", "SID"), one("p", "unit"), one("sp", "SID, unit")]
    return ",\n".join(parts)


NESTED = """ok AS (SELECT SID, unit, y, x, ln(w) AS z FROM rg WHERE isfinite(y) AND isfinite(x)),
co AS (SELECT regr_slope(x, z) AS cx, regr_slope(y, z) AS cy, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM ok WHERE z IS NOT NULL AND isfinite(z)),
ft AS (SELECT '1 wind' AS sp, 2 AS k, SID, unit, x - avg(x) OVER () AS xt, y - avg(y) OVER () AS yt FROM ok UNION ALL
 SELECT '2 + size', 3, SID, unit, (x-mx) - cx*(z-mz), (y-my) - cy*(z-mz) FROM ok, co WHERE z IS NOT NULL AND isfinite(z))"""


@query("two_way_nested_specs", sql(WSUM, REG, NESTED, focus_sql("f", "ft"), body="""SELECT sp AS spec, clustering, round(b,6) AS coef, round(sqrt(CASE WHEN v > 0 THEN v ELSE 'NaN'::DOUBLE END),6) AS se, n FROM (
 SELECT sp, 'storm' AS clustering, b, n, v FROM fb JOIN fs USING (sp) UNION ALL SELECT sp, 'port', b, n, v FROM fb JOIN fp USING (sp) UNION ALL
 SELECT fb.sp, 'two-way', b, n, fs.v + fp.v - fsp.v FROM fb JOIN fs USING (sp) JOIN fp USING (sp) JOIN fsp USING (sp))"""))
def two_way_nested_specs(spark, d):
    r = reg_rows(spark, d).withColumn("logw", F.ln("w"))
    specs = {"1 wind": ["x"], "2 + size": ["x", "logw"]}
    out = rg.nested_specs(r, "y", specs, {"storm": ("SID", None), "port": ("unit", None), "two-way": ("SID", "unit")}, "x")
    return rounded(out.select("spec", "clustering", "coef", "se", "n"), {"coef": 6, "se": 6})


# events of forty ports with storm and port covariates
def _pcols(div, dbl):
    q = lambda a, b: f"({a} {div} {b})"
    return dict(SID="l_suppkey", pn="l_partkey % 40", py=f"{q('l_orderkey', 18)} % 4", window=nth("l_orderkey % 3", WINDOW), zone=nth(f"{q('l_orderkey', 3)} % 6", TIER),
                k_days="1 + (l_suppkey + l_partkey % 40) % 5", wind="30 + (l_suppkey*7) % 90", intensity=INTENSITY)


def _covariates(dbl):
    """Covariates of an event from its storm and port numbers."""
    return dict(dist=f"((SID*31 + pn*17) % 500) / 2.5{dbl}", surge_m=f"CASE WHEN (SID+pn) % 7 > 0 THEN ((SID*13 + pn*7) % 40) / 10.0{dbl} END",
                rain_mm=f"CASE WHEN (SID*3+pn) % 11 > 0 THEN ((SID*29 + pn*3) % 300) / 1.0{dbl} END", landfall="(SID*5 + pn*3) % 2", season="2015 + SID % 9", gulf="CASE WHEN pn % 3 = 0 THEN 1 ELSE 0 END")


def _port_shares(dbl):
    return {"wait_sh": f"((pn*37) % 29 + 1) / 60.0{dbl}", "tanker_sh": f"((pn*17) % 31) / 50.0{dbl}", "passenger_sh": f"((pn*11) % 13) / 52.0{dbl}", "other_sh": f"((pn*7) % 19) / 40.0{dbl}", "cargo_sh": f"((pn*13) % 23) / 40.0{dbl}",
            "open_sh": f"((pn*23) % 17) / 34.0{dbl}", "all": f"1000.0{dbl} + ((pn*7919) % 997) * 13", "days": "365"}


PSUMS = SUMS | {"obs_hours": "l_quantity*100", "exp_hours": "l_quantity*100*(0.8{d} + 4*l_discount)"}
PSUM = ("psum AS (SELECT " + ", ".join(f'{e} AS "{n}"' for n, e in _pcols("//", "::DOUBLE").items()) + ", " + ", ".join(f"sum({e.format(d='::DOUBLE')}) AS {n}" for n, e in PSUMS.items()) + " FROM lineitem GROUP BY ALL)")
PORTS = "pt AS (SELECT DISTINCT pn, 'P' || pn AS port, " + ", ".join(f'{e} AS "{n}"' for n, e in _port_shares("::DOUBLE").items()) + " FROM psum)"


def port_events(spark, d, used: str = "true", ln=F.ln):
    """Responses of events and placebo dates at forty ports, with covariates; used: a condition on the keys of the groups that are wanted;
    ln: the logarithm of the responses."""
    keys = _pcols("div", "D")
    rows = s.table(spark, d, "lineitem").selectExpr(*[f"{e} AS {n}" for n, e in keys.items()], *[f"{e.format(d='D')} AS {n}" for n, e in PSUMS.items()]).where(used)
    sums = checkpointed(rows.groupBy(*keys).agg(*[F.sum(n).alias(n) for n in PSUMS]))
    return pr.divergence(sums, ln).selectExpr("*", "concat('P', pn) AS port", "py <> 0 AS placebo", *[f"{e} AS {n}" for n, e in _covariates("D").items()])


def port_table(spark, d):
    numbers = s.table(spark, d, "lineitem").selectExpr("l_partkey % 40 AS pn").distinct()
    shares = numbers.selectExpr("concat('P', pn) AS port", *[f"{e} AS `{n}`" for n, e in _port_shares("D").items()])
    return checkpointed(shares.withColumn("layout", pr.layout("open_sh", "wait_sh")))


TERMS = [*spc.STORM_TERMS, *spc.SIZE_TERMS, *spc.FLEET_TERMS, "gulf", *spc.PLACE_TERMS, "season"]
DESIGN = """pd AS (SELECT *, py<>0 AS placebo, "window" AS wd, CASE WHEN "window"='storm' THEN k_days WHEN "window"='after' THEN 10 ELSE k_days+32 END AS edays, """ + ", ".join(f"{e} AS {n}" for n, e in _covariates("::DOUBLE").items()) + """ FROM psum),
nh AS (SELECT pn, avg(exp_hours/edays) AS hd FROM pd WHERE NOT placebo AND wd='event30' AND zone='total' GROUP BY pn),
nw AS (SELECT pn, avg(h) AS wh FROM (SELECT pn, SID, sum(exp_hours/edays) AS h FROM pd WHERE NOT placebo AND wd='event30' AND zone IN ('anchorage','offshore_hold') GROUP BY pn, SID) GROUP BY pn),
de AS (SELECT SID, port, placebo, wd, ln(obs_co2/exp_co2) AS lc, ln(obs_nox/exp_nox) AS lno, wait_sh, ln(1+coalesce(wh,0)) AS log_wait, wind, CASE WHEN intensity='""" + STS + """' THEN 1 ELSE 0 END AS i_strong, CASE WHEN intensity='""" + HU + """' THEN 1 ELSE 0 END AS i_hurricane,
 ln(greatest(dist,5)) AS log_dist, k_days, coalesce(surge_m,0) AS surge_m, coalesce(rain_mm,0) AS rain_mm, landfall, CASE WHEN surge_m IS NULL OR rain_mm IS NULL THEN 1 ELSE 0 END AS met_missing, ln("all"/days) AS log_co2_day, ln(hd) AS log_hours_day,
 tanker_sh, passenger_sh, other_sh, gulf, open_sh, CASE WHEN open_sh < .05 THEN 1 ELSE 0 END AS river, season FROM pd JOIN pt USING (pn) LEFT JOIN nh USING (pn) LEFT JOIN nw USING (pn) WHERE zone='total' AND hd IS NOT NULL)"""


def _spec_sql():
    """All 51 fits as one long table whose terms are projected out one after the other."""
    sizes, n = [], 0
    for name, more in spc.NESTED.items():
        n += len(more)
        sizes.append(f"('{name}', {n}, 'wait_sh', false, false)")
    sizes += [f"('8 absolute waiting capacity', {n}, 'log_wait', false, false)", f"('9 without ', {n}, 'wait_sh', false, true)", f"('10 placebo dates', {n}, 'wait_sh', true, false)"]
    parts = ["o(outcome, ow, oy) AS (VALUES " + ", ".join(f"('{n}', '{w}', '{y}')" for n, (w, y) in spc.OUTCOMES.items()) + ")",
             "sp0(spec, m, focus, pl, lo) AS (VALUES " + ", ".join(sizes) + ")",
             "tp AS (SELECT port AS gone FROM pt ORDER BY wait_sh DESC, port LIMIT 8)",
             "fl AS (SELECT outcome, ow, oy, spec || coalesce(gone, '') AS spec, m, focus, pl, gone FROM o, sp0 LEFT JOIN tp ON lo)",
             "lf AS MATERIALIZED (SELECT outcome || '|' || spec AS sp, m, SID, port AS unit, CASE WHEN oy='lc' THEN lc ELSE lno END AS y, CASE WHEN focus='wait_sh' THEN wait_sh ELSE log_wait END AS f, "
             + ", ".join(f"CAST(CASE WHEN {i} < m THEN {t} ELSE 0 END AS DOUBLE) AS x{i}" for i, t in enumerate(TERMS)) + " FROM fl JOIN de ON wd=ow AND placebo=pl AND (gone IS NULL OR port<>gone))",
             "e0 AS MATERIALIZED (SELECT sp, SID, unit, stddev_samp(f) OVER w AS sd, y-avg(y) OVER w AS yt, f-avg(f) OVER w AS xt, 2 AS k, " + ", ".join(f"x{i}-avg(x{i}) OVER w AS x{i}" for i in range(len(TERMS))) + " FROM lf WINDOW w AS (PARTITION BY sp))",
             "v0 AS (SELECT sp, " + ", ".join(f"sum(x{i}*x{i}) AS v{i}" for i in range(len(TERMS))) + " FROM e0 GROUP BY sp)"]
    for i in range(len(TERMS)):
        later = ["yt", "xt", *[f"x{j}" for j in range(i + 1, len(TERMS))]]
        parts.append(f"g{i} AS (SELECT sp, sum(x{i}*x{i}) > 1e-10*any_value(v{i}) AS ok, " + ", ".join(f"sum(x{i}*{c})/sum(x{i}*x{i}) AS c_{c}" for c in later) + f" FROM e{i} JOIN v0 USING (sp) GROUP BY sp)")
        parts.append(f"e{i + 1} AS MATERIALIZED (SELECT sp, SID, unit, sd, k + CASE WHEN ok THEN 1 ELSE 0 END AS k, " + ", ".join(f"{c} - CASE WHEN ok THEN c_{c} * x{i} ELSE 0 END AS {c}" for c in later) + f" FROM e{i} JOIN g{i} USING (sp))")
    parts.append(focus_sql("a", f"e{len(TERMS)}"))
    parts.append(f"""sc AS (SELECT sp, any_value(sd) AS sd FROM e0 GROUP BY sp),
ac AS (SELECT sp, 'storm' AS clustering, ab.b, ab.n, v FROM ab JOIN "as" USING (sp) UNION ALL SELECT sp, 'port', ab.b, ab.n, v FROM ab JOIN ap USING (sp) UNION ALL
 SELECT ab.sp, 'two-way', ab.b, ab.n, "as".v + ap.v - asp.v FROM ab JOIN "as" USING (sp) JOIN ap USING (sp) JOIN asp USING (sp))""")
    return ",\n".join(parts)


#: What the design reads: whole ports, and the waiting zones of real events over the whole event.
DESIGN_GROUPS = "zone = 'total' OR (zone IN ('anchorage', 'offshore_hold') AND window = 'event30' AND py = 0)"


@query("waiting_specifications", sql(PSUM, PORTS, DESIGN, _spec_sql().replace("as AS (SELECT sp, g/", '"as" AS (SELECT sp, g/'), body="""SELECT split_part(sp,'|',1) AS outcome, split_part(sp,'|',2) AS spec, clustering, round(b*sd,6) AS coef, round(sd*sqrt(CASE WHEN v > 0 THEN v ELSE 'NaN'::DOUBLE END),6) AS se, n
 FROM ac JOIN sc USING (sp) WHERE clustering='two-way' OR NOT (sp LIKE '%|9 %' OR sp LIKE '%|10 %')"""))
def waiting_specifications(spark, d):
    traits = port_table(spark, d)
    design = checkpointed(spc.waiting_design(port_events(spark, d, DESIGN_GROUPS), traits, STS, HU))
    return rounded(spc.waiting_specifications(design, traits).select("outcome", "spec", "clustering", "coef", "se", "n"), {"coef": 6, "se": 6})


@query("standardised_predictors", sql(WSUM, REG, body="SELECT SID, unit, round((x-avg(x) OVER ())/stddev_samp(x) OVER (),6) AS x, round((w-avg(w) OVER ())/stddev_samp(w) OVER (),6) AS w FROM rg"))
def standardised_predictors(spark, d):
    return rounded(rg.zscores(reg_rows(spark, d), ["x", "w"]).select("SID", "unit", "x", "w"), {"x": 6, "w": 6})


MEASURES = ["lh", "lc", "ln", "g", "g_nox"]
GAP_ROWS = """dv AS (SELECT *, "window" AS wd, CASE WHEN "window"='storm' THEN k_days WHEN "window"='after' THEN 10 ELSE k_days+32 END AS days FROM wsum),
dg AS (SELECT *, ln(obs_hours/exp_hours) AS lh, ln(obs_co2/exp_co2) AS lc, ln(obs_nox/exp_nox) AS lno, ln(obs_co2/exp_co2)-ln(obs_hours/exp_hours) AS g, ln(obs_nox/exp_nox)-ln(obs_hours/exp_hours) AS g_nox,
  exp_hours/days AS hours_day, ln(exp_co2/days) AS size, ln(days) AS ld FROM dv),
bi AS MATERIALIZED (SELECT * REPLACE (abs(a) AS a) FROM (SELECT wd, zone, size, ld, unnest(['lh','lc','ln','g','g_nox']) AS measure, unnest([lh,lc,lno,g,g_nox]) AS a FROM dg WHERE py<>0 AND hours_day>=24) WHERE isfinite(a) AND isfinite(size))"""
FIT_ROUNDS = 24


def band_fit_sql(rounds=FIT_ROUNDS):
    """Quantile fits of |response| on 1, size and ld by reweighted least squares, one statement per round."""
    sums = """count(*) AS n, sum(w) AS s0, sum(w*size) AS s1, sum(w*ld) AS s2, sum(w*size*size) AS s11, sum(w*size*ld) AS s12, sum(w*ld*ld) AS s22, sum(w*a*a) AS yy,
 sum(w*a)+{p}*count(*) AS t0, sum(w*size*a)+{p}*sum(size) AS t1, sum(w*ld*a)+{p}*sum(ld) AS t2"""
    centred = "SELECT *, s11-s1*s1/s0 AS c11, s12-s1*s2/s0 AS c12, s22-s2*s2/s0 AS c22, t1-s1*t0/s0 AS u1, t2-s2*t0/s0 AS u2 FROM ({rows})"
    slopes = f"SELECT *, CASE WHEN c22-c12*c12/c11 > 1e-10*s22 THEN (c11*u2-c12*u1)/(c11*c22-c12*c12) ELSE 0 END AS b2 FROM ({centred})"
    solve = f"SELECT *, (t0-s1*b1-s2*b2)/s0 AS b0 FROM (SELECT *, (u1-c12*b2)/c11 AS b1 FROM ({slopes}))"
    first = solve.format(rows=f"SELECT wd, zone, measure, {sums.format(p='0')} FROM (SELECT *, 1.0::DOUBLE AS w FROM bi) GROUP BY ALL HAVING count(*)>=50")
    parts = [f"q0 AS (SELECT wd, zone, measure, b0+1.6448536269514722*sqrt(greatest(yy-b0*t0-b1*t1-b2*t2,0)/n) AS b0, b1, b2, n FROM ({first}))"]
    for i in range(rounds):
        rows = f"SELECT wd, zone, measure, {sums.format(p='0.9')} FROM (SELECT bi.*, 1.0::DOUBLE/(1e-6+abs(a-b0-b1*size-b2*ld)) AS w FROM bi JOIN q{i} USING (wd, zone, measure)) GROUP BY ALL"
        parts.append(f"q{i + 1} AS MATERIALIZED (SELECT wd, zone, measure, b0, b1, b2, n FROM ({solve.format(rows=rows)}))")
    parts.append(f"fits AS (SELECT wd, zone, measure, round(b0,4) AS c0, round(b1,4) AS c1, round(b2,4) AS c2, n FROM q{rounds})")
    return ",\n".join(parts)


DIV = GAP_ROWS + ",\n" + band_fit_sql() + """,
bw AS (SELECT wd, zone, """ + ", ".join(f"max(CASE WHEN measure='{m}' THEN [c0,c1,c2] END) AS k_{m}" for m in MEASURES) + """ FROM fits GROUP BY wd, zone),
bd AS (SELECT dg.*, """ + ", ".join(f"CASE WHEN k_{m} IS NOT NULL THEN greatest(k_{m}[1]+k_{m}[2]*size+k_{m}[3]*ld, 0.02) END AS {t}" for m, t in zip(MEASURES, ["th", "tc", "tn", "tg", "tgn"])) + """ FROM dg LEFT JOIN bw USING (wd, zone)),
cl AS (SELECT *, CASE WHEN NOT (th IS NOT NULL AND hours_day>=24) THEN 'no data' WHEN abs(lh)<=th AND abs(lc)<=tc THEN 'no response' WHEN abs(g)<=tg THEN 'coupled' WHEN abs(lh)>th AND abs(lc)>tc AND sign(lh)<>sign(lc) THEN 'absolute'
  WHEN abs(lc)>abs(lh) THEN 'relative (amplified)' ELSE 'relative (damped)' END AS cls FROM bd)"""


def divergences(spark, d):
    return pr.divergence(wsum(spark, d))


def fitted_bands(div):
    """Noise bands of the placebo dates with four digits."""
    return rg.quantile_bands(pr.band_inputs(div.filter("py <> 0")), ["window", "zone", "measure"], "a", ["size", "ld"], rounds=FIT_ROUNDS, digits=4)


def classified(spark, d):
    """Fit, apply and classify in one chain."""
    div = divergences(spark, d)
    return pr.classify_divergence(pr.apply_bands(div, fitted_bands(div)))


@query("divergence_class", sql(WSUM, DIV, body='SELECT SID, unit, py, wd AS "window", zone, round(lh,6) AS lh, round(lc,6) AS lc, round(g,6) AS g, round(hours_day,4) AS hours_day, cls FROM cl'))
def divergence_class(spark, d):
    out = classified(spark, d).select("SID", "unit", "py", "window", "zone", "lh", "lc", "g", "hours_day", "cls")
    return rounded(out, {"lh": 6, "lc": 6, "g": 6, "hours_day": 4})


@query("noise_bands", sql(WSUM, GAP_ROWS, band_fit_sql(), body='SELECT wd AS "window", zone, measure, round(c0,3) AS intercept, round(c1,3) AS size, round(c2,3) AS ld, n FROM fits'))
def noise_bands(spark, d):
    return rounded(fitted_bands(divergences(spark, d)).drop("moved"), {"intercept": 3, "size": 3, "ld": 3})


@query("noise_band_checks", sql(WSUM, GAP_ROWS, body="""SELECT wd AS "window", zone, measure, count(*) AS n, true AS five_percent_above FROM bi GROUP BY ALL HAVING count(*) >= 50"""))
def noise_band_checks(spark, d):
    """Rows each band is fitted on, and whether a twentieth of them, give or take the terms of the fit, lies above it."""
    keys = ["window", "zone", "measure"]
    rows = pr.band_inputs(divergences(spark, d).filter("py <> 0"))
    fits = rg.quantile_bands(rows, keys, "a", ["size", "ld"]).select(*keys, F.col("intercept").alias("c0"), F.col("size").alias("c1"), F.col("ld").alias("c2"))
    out = rg.complete_rows(rows, ["a", "size", "ld"]).join(fits, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("a") > F.expr("c0 + c1 * size + c2 * ld")).alias("k"))
    return out.select(*keys, "n", (F.abs(F.col("k") - 0.05 * F.col("n")) <= 4 + 0.01 * F.col("n")).alias("five_percent_above"))


COUNT = ", ".join(f"CAST(sum(CASE WHEN cls='{c}' THEN 1 ELSE 0 END) AS BIGINT) AS \"{c}\"" for c in pr.CLASS_NAMES)


@query("class_counts", sql(WSUM, DIV, body=f"SELECT wd AS \"window\", zone, grouping, level, count(*) AS n, {COUNT} FROM (SELECT *, unnest(['intensity','all']) AS grouping, unnest([intensity,'all']) AS level FROM cl WHERE py=0) GROUP BY ALL"))
def class_counts(spark, d):
    rows = pr.by_groupings(classified(spark, d).filter("py = 0"), {"intensity": "intensity"}, total="all")
    return pr.class_counts(rows, ["window", "zone", "grouping", "level"], "cls")


@query("class_shares", sql(WSUM, DIV, body="SELECT wd AS \"window\", zone, " + ", ".join(f"round(avg(CASE WHEN cls='{c}' THEN 1 ELSE 0 END),6) AS \"{c}\"" for c in pr.CLASS_NAMES) + " FROM cl WHERE py<>0 GROUP BY ALL"))
def class_shares(spark, d):
    return rounded(pr.class_shares(classified(spark, d).filter("py <> 0"), ["window", "zone"], "cls"), {c: 6 for c in pr.CLASS_NAMES})


@query("any_zone_flag", sql(WSUM, DIV, body='SELECT wd AS "window", intensity, CAST(sum(CASE WHEN a THEN 1 ELSE 0 END) AS BIGINT) AS n_any, count(*) AS n_events FROM (SELECT SID, unit, wd, intensity, bool_or(cls=\'absolute\') AS a FROM cl WHERE py=0 AND zone<>\'total\' GROUP BY ALL) GROUP BY ALL'))
def any_zone_flag(spark, d):
    return pr.any_zone(classified(spark, d).filter("py = 0"), ["SID", "unit"], ["window", "intensity"], "cls")


@query("detected_changes", sql(WSUM, DIV, """lg AS (SELECT py, wd, unnest(['lc','ln','lh']) AS measure, unnest([lc,lno,lh]) AS x, unnest([tc,tn,th]) AS t FROM cl WHERE zone='total')""",
       body="""SELECT wd AS "window", measure, count(*) FILTER (py=0) AS n, count(*) FILTER (py=0 AND x>t) AS sig_up, count(*) FILTER (py=0 AND x< -t) AS sig_down, round(count(*) FILTER (py=0 AND x>0)/count(*) FILTER (py=0),6) AS share_above,
 round(count(*) FILTER (py<>0 AND x>t)/count(*) FILTER (py<>0)*count(*) FILTER (py=0),5) AS expected_up, round(count(*) FILTER (py<>0 AND x< -t)/count(*) FILTER (py<>0)*count(*) FILTER (py=0),5) AS expected_down FROM lg GROUP BY ALL"""))
def detected_changes(spark, d):
    c = classified(spark, d).filter("zone = 'total'")
    return rounded(pr.detected_changes(c.filter("py = 0"), c.filter("py <> 0"), ["window"]), {"share_above": 6, "expected_up": 5, "expected_down": 5})


@query("significant_events", sql(WSUM, DIV, body="SELECT SID, unit, round(lc,6) AS lc, CASE WHEN lc>tc THEN 'net increase' ELSE 'net decrease' END AS direction FROM cl WHERE py=0 AND zone='total' AND wd='event30' AND abs(lc)>tc"))
def significant_events(spark, d):
    c = classified(spark, d).filter("py = 0 AND zone = 'total' AND window = 'event30'")
    return rounded(pr.significant_events(c, ["SID", "unit", "lc"]), {"lc": 6})


@query("gap_distribution", sql(WSUM, DIV, body="""SELECT wd AS "window", grouping, level, count(*) AS n, round(avg(g),6) AS mean, round(stddev_samp(g),6) AS sd, round(quantile_cont(g,0.5),6) AS median, round(quantile_cont(g,0.75)-quantile_cont(g,0.25),6) AS iqr,
 round(avg(CASE WHEN abs(g)>tg THEN 1 ELSE 0 END),6) AS share_beyond FROM (SELECT *, unnest(['intensity','all']) AS grouping, unnest([intensity,'All']) AS level FROM cl WHERE py=0 AND zone='total') GROUP BY ALL"""))
def gap_distribution(spark, d):
    rows = pr.by_groupings(classified(spark, d).filter("py = 0 AND zone = 'total'"), {"intensity": "intensity"}, total="All")
    return rounded(pr.gap_summary(rows, ["window", "grouping", "level"]), {c: 6 for c in ("mean", "sd", "median", "iqr", "share_beyond")})


@query("ks_storm_vs_placebo", sql(WSUM, DIV, """kr AS (SELECT wd, g, py=0 AS s FROM dg WHERE zone='total'),
kc AS (SELECT wd, g, sum(CASE WHEN s THEN 1 ELSE 0 END) OVER (PARTITION BY wd ORDER BY g)/sum(CASE WHEN s THEN 1 ELSE 0 END) OVER (PARTITION BY wd) AS f1, sum(CASE WHEN s THEN 0 ELSE 1 END) OVER (PARTITION BY wd ORDER BY g)/sum(CASE WHEN s THEN 0 ELSE 1 END) OVER (PARTITION BY wd) AS f2 FROM kr)""",
       body='SELECT wd AS "window", count(*) FILTER (s) AS n_first, count(*) FILTER (NOT s) AS n_second, round(any_value(dd),6) AS ks_d FROM kr JOIN (SELECT wd, max(abs(f1-f2)) AS dd FROM kc GROUP BY wd) USING (wd) GROUP BY wd'))
def ks_storm_vs_placebo(spark, d):
    rows = divergences(spark, d).filter("zone = 'total'").withColumn("sample", F.when(F.col("py") == 0, "storm").otherwise("placebo"))
    out = qt.ks_two_sample(rows, ["window"], "g", "sample", "storm", "placebo")
    return rounded(out.select("window", "n_first", "n_second", "ks_d"), {"ks_d": 6})


# ---------------------------------------------------------------- reconciliation and windows
CLASSES = "('tanker','cargo','passenger','other')"
FACT = f"""fct AS (SELECT SID, unit, py, tier, sum(expected) FILTER (measure='co2_ton' AND vclass='all')/nullif(sum(expected) FILTER (measure='co2_ton' AND vclass IN {CLASSES}),0) AS factor,
  sum(expected) FILTER (measure='hours' AND vclass='all')/nullif(sum(expected) FILTER (measure='hours' AND vclass IN {CLASSES}),0) AS factor_h FROM res GROUP BY ALL HAVING factor IS NOT NULL OR factor_h IS NOT NULL)"""
KEY = ["SID", "unit", "py", "tier"]


@query("class_normal_factors", sql(RES, FACT, body="SELECT SID, unit, py, tier, round(factor,6) AS factor, round(factor_h,6) AS factor_h FROM fct"))
def class_normal_factors(spark, d):
    return rounded(nm.class_factors(res(spark, d), KEY), {"factor": 6, "factor_h": 6})


@query("reconcile_class_normals", sql(RES, FACT, body=f"""SELECT tier, vclass, measure, round(sum(obs),3) AS obs, round(sum(e2),3) AS expected, round(sum(obs-e2),3) AS delta FROM (SELECT r.*, expected*CASE WHEN vclass IN {CLASSES} THEN coalesce(CASE WHEN measure='hours' THEN factor_h ELSE factor END,1) ELSE 1 END AS e2
 FROM res r LEFT JOIN fct f ON r.SID=f.SID AND r.unit=f.unit AND r.py=f.py AND r.tier=f.tier) GROUP BY ALL"""))
def reconcile_class_normals(spark, d):
    r = res(spark, d)
    out = nm.reconcile(r, nm.class_factors(r, KEY), KEY)
    return rounded(out.groupBy("tier", "vclass", "measure").agg(*[F.sum(c).alias(c) for c in ("obs", "expected", "delta")]), {"obs": 3, "expected": 3, "delta": 3})


SPAN = "(SELECT *, unnest(['prep','storm','after','event30']) AS wd, unnest([-2,0,k_days,-2]) AS a, unnest([-1,k_days-1,k_days+9,k_days+29]) AS b FROM res)"


def ef_sql(p):
    e = em.POLLUTANTS[p]
    return (f"CASE WHEN measure='fc_main_ton' AND vclass IN ('tanker','cargo') THEN {e['main_big']}::DOUBLE WHEN measure='fc_main_ton' THEN {e['main_small']}::DOUBLE "
            f"WHEN measure='fc_AE_ton' THEN {e['aux']}::DOUBLE WHEN measure='fc_boiler_ton' THEN {e['boiler']}::DOUBLE ELSE 0 END/1000")


WSQL = f"""wz AS (SELECT SID, unit, py, wd, vclass, measure, obs, expected, unnest(CASE WHEN vclass IN {CLASSES} THEN [tier,'total'] ELSE [tier] END) AS zone FROM {SPAN} WHERE rel_day BETWEEN a AND b AND (vclass='all' OR (vclass IN {CLASSES} AND tier<>'total'))),
ws AS (SELECT SID, unit, py, wd, zone, sum(CASE WHEN vclass='all' AND measure='hours' THEN obs ELSE 0 END) AS obs_hours, sum(CASE WHEN vclass='all' AND measure='hours' THEN expected ELSE 0 END) AS exp_hours, sum(CASE WHEN vclass='all' AND measure='co2_ton' THEN obs ELSE 0 END) AS obs_co2,
 sum(CASE WHEN vclass='all' AND measure='co2_ton' THEN expected ELSE 0 END) AS exp_co2, sum(CASE WHEN vclass<>'all' AND measure='co2_ton' THEN expected ELSE 0 END) AS cz, sum(CASE WHEN vclass<>'all' THEN obs*{ef_sql('nox')} ELSE 0 END) AS obs_nox, sum(CASE WHEN vclass<>'all' THEN expected*{ef_sql('nox')} ELSE 0 END) AS en,
 sum(CASE WHEN vclass<>'all' THEN obs*{ef_sql('pm25')} ELSE 0 END) AS obs_pm25, sum(CASE WHEN vclass<>'all' THEN expected*{ef_sql('pm25')} ELSE 0 END) AS ep FROM wz GROUP BY ALL)"""


@query("anchored_pollutants", sql(RES, WSQL, body='SELECT SID, unit, py, wd AS "window", zone, round(obs_hours,3) AS obs_hours, round(exp_hours,4) AS exp_hours, round(obs_co2,3) AS obs_co2, round(exp_co2,4) AS exp_co2, round(obs_nox,9) AS obs_nox, round(CASE WHEN cz>0 THEN exp_co2*en/cz END,9) AS exp_nox, round(obs_pm25,9) AS obs_pm25, round(CASE WHEN cz>0 THEN exp_co2*ep/cz END,9) AS exp_pm25 FROM ws'))
def anchored_pollutants(spark, d):
    out = nm.window_sums(res(spark, d).select("SID", "unit", "py", "k_days", "rel_day", "vclass", "tier", "measure", "obs", "expected"), ["SID", "unit", "py"])
    return rounded(out, {"obs_hours": 3, "exp_hours": 4, "obs_co2": 3, "exp_co2": 4, "obs_nox": 9, "exp_nox": 9, "obs_pm25": 9, "exp_pm25": 9})


# ---------------------------------------------------------------- recovery, efficiency, scenarios
REC = """rz AS (SELECT SID, unit, vclass, measure, tier, sum(CASE WHEN rel_day<=k_days-1 THEN obs-expected ELSE 0 END) AS x FROM res WHERE py=0 AND tier<>'total' GROUP BY ALL),
rm AS (SELECT SID, unit, vclass, measure, sum(greatest(-x,0)) AS gross, sum(greatest(x,0)) AS moved FROM rz GROUP BY ALL),
rt AS (SELECT SID, unit, vclass, measure, intensity, -sum(CASE WHEN rel_day<=k_days-1 THEN obs-expected ELSE 0 END) AS loss, """ + ", ".join(
    f"sum(CASE WHEN rel_day BETWEEN k_days AND k_days+{n - 1} THEN obs-expected ELSE 0 END) AS rec{n}" for n in (10, 20, 30, 45)) + """ FROM res WHERE py=0 AND tier='total' GROUP BY ALL),
rp AS (SELECT rt.*, coalesce(gross,0) AS gross, coalesce(moved,0) AS moved FROM rt LEFT JOIN rm USING (SID, unit, vclass, measure))"""


def recovered(spark, d):
    r = res(spark, d).filter("py = 0")
    return pr.recovery(r, ["SID", "unit", "intensity"])


RECC = ("loss", "gross", "moved", "rec10", "rec20", "rec30", "rec45")


@query("recovery_events", sql(RES, REC, body="SELECT SID, unit, vclass, measure, " + ", ".join(f"round({c},4) AS {c}" for c in RECC) + " FROM rp"))
def recovery_events(spark, d):
    return rounded(recovered(spark, d).drop("intensity"), {c: 4 for c in RECC})


RECSTAT = {**{f"rec{n}_pct": f"100*rec{n}/nullif(loss,0)" for n in (10, 20, 30, 45)}, "moved_pct": "100*moved/nullif(gross,0)"}


@query("recovery_share", sql(RES, REC, boot_sql("rp", "measure, intensity", "SID", {c: c for c in RECC}, RECSTAT, 1000, 1, extra_where="WHERE loss>0"),
       "rn AS (SELECT measure, intensity, count(*) AS n FROM rp WHERE loss>0 GROUP BY ALL HAVING count(*)>=5)",
       body=f"SELECT measure, intensity, n, n_clusters, {', '.join(f'round({c},3) AS {c}' for k in RECSTAT for c in CI(k))} FROM rn JOIN bt USING (measure, intensity)"))
def recovery_share(spark, d):
    out = pr.recovery_pooled(recovered(spark, d), ["measure", "intensity"], draws=1000)
    return rounded(out.drop("loss"), {c: 3 for k in RECSTAT for c in CI(k)})


ENG = """ew AS (SELECT SID, unit, vclass, tier, intensity, """ + ", ".join(f"sum(CASE WHEN measure='{m}' THEN {c} ELSE 0 END) AS {k}_{m}" for k, c in (("obs", "obs"), ("exp", "expected")) for m in ("hours", *pr.ENGINES)) + " FROM res WHERE py=0 AND phase='storm' GROUP BY ALL)"
XTRA = "+".join(f"(obs_{f}-exp_{f})" for f in pr.ENGINES)
ENGSTAT = {"hours_ratio": "obs_hours/nullif(exp_hours,0)"}
for _f, _n in pr.ENGINES.items():
    ENGSTAT[f"{_n}_per_hour"] = f"(obs_{_f}/nullif(obs_hours,0))/nullif(exp_{_f}/nullif(exp_hours,0),0)"
    ENGSTAT[f"{_n}_extra_share"] = f"(obs_{_f}-exp_{_f})/nullif({XTRA},0)"
ENGSUM = {f"{k}_{m}": f"{k}_{m}" for k in ("obs", "exp") for m in ("hours", *pr.ENGINES)}


@query("engine_intensity", sql(RES, ENG, boot_sql("ew", "vclass, tier, intensity", "SID", ENGSUM, ENGSTAT, 1000, 1, extra_where="WHERE exp_hours>0"),
       "en AS (SELECT vclass, tier, intensity, count(*) AS n FROM ew WHERE exp_hours>0 GROUP BY ALL HAVING count(*)>=5)",
       body=f"SELECT vclass, tier, intensity, n, {', '.join(f'round({c},3) AS {c}' for k in ENGSTAT if not k.endswith('share') for c in CI(k))}, {', '.join(f'round({k},3) AS {k}' for k in ENGSTAT if k.endswith('share'))} FROM en JOIN bt USING (vclass, tier, intensity)"))
def engine_intensity(spark, d):
    r = res(spark, d).filter("py = 0 AND phase = 'storm'")
    wide = pr.wide_measures(r, ["SID", "unit", "vclass", "tier", "intensity"], ["hours", *pr.ENGINES])
    out = pr.engine_intensity(wide, ["vclass", "tier", "intensity"], draws=1000)
    keep = [c for k in ENGSTAT if not k.endswith("share") for c in CI(k)] + [k for k in ENGSTAT if k.endswith("share")]
    return rounded(out.select("vclass", "tier", "intensity", "n", *keep), {c: 3 for c in keep})


EFF = """ef AS (SELECT SID, unit, "window", intensity, obs_co2, exp_co2, obs_hours AS obs_wait_hours, exp_hours AS exp_wait_hours, obs_pm25 AS obs_calls, exp_pm25 AS exp_calls FROM wsum WHERE py=0 AND zone='total')"""
EFS = {f"{k}_{m}": f"{k}_{m}" for k in ("obs", "exp") for m in ("calls", "co2", "wait_hours")}
EFT = {"calls": "obs_calls/exp_calls", "co2": "obs_co2/exp_co2", "co2_per_call": "(obs_co2/obs_calls)/(exp_co2/exp_calls)", "wait_per_call": "(obs_wait_hours/obs_calls)/(exp_wait_hours/exp_calls)", "penalty": "obs_co2-obs_calls*exp_co2/exp_calls"}


@query("efficiency_ratios", sql(WSUM, EFF, boot_sql("ef", '"window", intensity', "SID", EFS, EFT, 1000, 1).replace('s."window"=p."window"', 's."window"=p."window"'),
       body=f"""SELECT "window", intensity, n_clusters, {', '.join(f'round({c},4) AS {c}' for k in EFT for c in CI(k))}, round(ln(calls)/ln(co2),3) AS activity_share, round(ln(co2_per_call)/ln(co2),3) AS efficiency_share FROM bt"""))
def efficiency_ratios(spark, d):
    e = wsum(spark, d).filter("py = 0 AND zone = 'total'").selectExpr("SID", "unit", "window", "intensity", "obs_co2", "exp_co2", "obs_hours AS obs_wait_hours", "exp_hours AS exp_wait_hours", "obs_pm25 AS obs_calls", "exp_pm25 AS exp_calls")
    out = pr.efficiency(e, ["window", "intensity"], draws=1000)
    return rounded(out, {**{c: 4 for k in EFT for c in CI(k)}, "activity_share": 3, "efficiency_share": 3})


QSPAN = "(SELECT *, unnest(['queue','event30']) AS wd, unnest([k_days,-2]) AS a, unnest([k_days+9,k_days+29]) AS b FROM res WHERE py=0 AND vclass IN ('tanker','cargo'))"
WZ, FU = "tier IN ('anchorage','offshore_hold')", "measure IN ('fc_main_ton','fc_AE_ton','fc_boiler_ton')"
QUEUE = f"""q0 AS (SELECT SID, unit, intensity, wd, vclass, sum(CASE WHEN {WZ} AND measure='hours' THEN obs ELSE 0 END) AS ho, sum(CASE WHEN {WZ} AND measure='hours' THEN expected ELSE 0 END) AS he, sum(CASE WHEN {WZ} AND {FU} THEN obs-expected ELSE 0 END) AS fx,
 sum(CASE WHEN tier='offshore' AND measure='hours' THEN expected ELSE 0 END) AS oh, sum(CASE WHEN tier='offshore' AND measure='fc_main_ton' THEN expected ELSE 0 END) AS of_ FROM {QSPAN} WHERE rel_day BETWEEN a AND b GROUP BY ALL),
q1 AS (SELECT *, CASE WHEN oh>0 THEN of_/oh END AS f0 FROM q0),
qd AS (SELECT *, ho-he AS nx, coalesce(f0, quantile_cont(f0,0.5) OVER (PARTITION BY vclass)) AS fh FROM q1)"""


def queued(spark, d):
    return pr.queue_pairs(res(spark, d).filter("py = 0"), ["SID", "unit", "intensity"])


@query("queue_pairs", sql(RES, QUEUE, body='SELECT SID, unit, wd AS "window", vclass, round(ho,3) AS wait_h_obs, round(he,4) AS wait_h_exp, round(fx,4) AS net_excess_wait_fuel_t, round(nx,4) AS net_excess_wait_h, round(fh,5) AS f_main_t_per_h FROM qd'))
def queue_pairs(spark, d):
    return rounded(queued(spark, d).drop("intensity"), {"wait_h_obs": 3, "wait_h_exp": 4, "net_excess_wait_fuel_t": 4, "net_excess_wait_h": 4, "f_main_t_per_h": 5})


JIT = {"h": "nx", "fh": "nx*fh", "hotel": "fx"}
PER = "CASE WHEN w<0 THEN 2 ELSE t*(1-greatest(t/(t+w)::DOUBLE,0.6::DOUBLE)*greatest(t/(t+w)::DOUBLE,0.6::DOUBLE))/w END"


@query("arrival_scenarios", sql(RES, QUEUE, "qe AS (SELECT * FROM qd UNION ALL SELECT * REPLACE ('All storms' AS intensity) FROM qd)", boot_sql("qe", "wd, intensity", "SID", JIT, {k: k for k in JIT}, 1000, 1), "np AS (SELECT wd, intensity, count(DISTINCT (SID, unit)) AS n_pairs FROM qe GROUP BY ALL)",
       body=f"""SELECT wd AS "window", intensity, n_pairs, round(greatest(h,0),3) AS net_excess_wait_h, round(h_lo,3) AS wait_h_lo, round(h_hi,3) AS wait_h_hi, round(greatest(hotel,0),3) AS relocated_hotel_fuel_t, t AS T_h, w AS W_h, p AS fuel_price, round(greatest(fh,0)*k,3) AS fuel_saved_t,
 round(greatest(fh,0)*k*3.114::DOUBLE,3) AS co2_saved_t, round(greatest(fh_lo,0)*k*3.114::DOUBLE,3) AS co2_lo, round(greatest(fh_hi,0)*k*3.114::DOUBLE,3) AS co2_hi, round(greatest(fh,0)*k*p,2) AS fuel_cost_saved_usd, round(greatest(fh,0)*k*3.114::DOUBLE*51,2) AS scc51_usd, round(greatest(fh,0)*k*3.114::DOUBLE*190,2) AS scc190_usd
 FROM bt JOIN np USING (wd, intensity), (SELECT t, w, p, {PER} AS k FROM (VALUES (24),(72),(120)) a(t), (VALUES (12),(24),(48),(-1)) b(w), (VALUES (450),(650),(900)) c(p))"""))
def arrival_scenarios(spark, d):
    out = pr.arrival_scenarios(queued(spark, d), ["window", "intensity"], draws=1000, total="All storms")
    return rounded(out, {**{c: 3 for c in ("net_excess_wait_h", "wait_h_lo", "wait_h_hi", "relocated_hotel_fuel_t", "fuel_saved_t", "co2_saved_t", "co2_lo", "co2_hi")},
                         "fuel_cost_saved_usd": 2, "scc51_usd": 2, "scc190_usd": 2})


@query("saving_concentration", sql(RES, QUEUE, "pe AS (SELECT SID, unit, intensity, sum(nx) AS h, sum(2*fh*nx) AS sx FROM qd WHERE wd='queue' GROUP BY ALL)",
       body="SELECT grouping, level, count(*) AS n_events, round(sum(h),3) AS net_excess_wait_h, round(sum(sx),3) AS saving_index_t, round(sum(sx)/(SELECT sum(sx) FROM pe),5) AS share FROM (SELECT *, unnest(['intensity','port']) AS grouping, unnest([intensity,unit]) AS level FROM pe) GROUP BY ALL"))
def saving_concentration(spark, d):
    out = pr.saving_concentration(queued(spark, d), {"intensity": "intensity", "port": "unit"}, ["SID"])
    return rounded(out, {"net_excess_wait_h": 3, "saving_index_t": 3, "share": 5})


TGT = f"""tq AS (SELECT *, obs-expected AS dx, (obs-expected)*({ef_sql('nox')}) AS nx FROM res WHERE py=0 AND rel_day BETWEEN k_days AND k_days+9),
te AS (SELECT SID, unit, sum(CASE WHEN vclass IN ('tanker','cargo') AND {WZ} AND measure='co2_ton' THEN dx ELSE 0 END) AS x_wait_co2, sum(CASE WHEN vclass IN ('tanker','cargo') AND {WZ} THEN nx ELSE 0 END) AS x_wait_nox,
 sum(CASE WHEN vclass IN ('tanker','cargo') AND {WZ} AND measure<>'fc_main_ton' THEN nx ELSE 0 END) AS x_wait_hotel_nox, sum(CASE WHEN vclass='all' AND tier='total' AND measure='co2_ton' THEN dx ELSE 0 END) AS x_all_co2, sum(CASE WHEN vclass<>'all' AND tier<>'total' THEN nx ELSE 0 END) AS x_all_nox FROM tq GROUP BY ALL),
ts AS (SELECT SID, unit, sum(nx*fh*(72*(1-0.75::DOUBLE*0.75::DOUBLE)/24)) AS ms FROM qd WHERE wd='queue' GROUP BY ALL)"""


@query("targeting", sql(RES, QUEUE, TGT, body="SELECT SID, unit, round(x_wait_co2,4) AS x_wait_co2, round(x_wait_nox,6) AS x_wait_nox, round(x_wait_hotel_nox,6) AS x_wait_hotel_nox, round(x_all_co2,4) AS x_all_co2, round(x_all_nox,6) AS x_all_nox, round(ms,4) AS main_fuel_saved_t, round(ms*3.114::DOUBLE,4) AS co2_avoided_t, round(ms*91.9::DOUBLE/1000,5) AS nox_avoided_t FROM te LEFT JOIN ts USING (SID, unit)"))
def targeting(spark, d):
    r = res(spark, d).filter("py = 0")
    out = pr.targeting(r, queued(spark, d), ["SID", "unit"])
    return rounded(out, {"x_wait_co2": 4, "x_wait_nox": 6, "x_wait_hotel_nox": 6, "x_all_co2": 4, "x_all_nox": 6, "main_fuel_saved_t": 4, "co2_avoided_t": 4, "nox_avoided_t": 5})


# ---------------------------------------------------------------- groupings, zones, claims, reports
GR = """gr AS (SELECT *, unnest(['intensity','dist','dur']) AS grouping, unnest([intensity, CASE WHEN dist>-1 AND dist<=50 THEN '<50 km' WHEN dist>50 AND dist<=100 THEN '50–100 km' WHEN dist>100 AND dist<=201 THEN '100–200 km' END, CASE WHEN k_days<=2 THEN '1–2 days' WHEN k_days<=4 THEN '3–4 days' ELSE '≥5 days' END]) AS level FROM res WHERE py=0 AND measure='co2_ton')"""


@query("grouped_pooled_ratios", sql(RES, GR, boot_sql("gr", "grouping, level, phase", "SID", OE, RATIO, 1000, 1, extra_where="WHERE level IS NOT NULL"), body=f"SELECT grouping, level, phase, n_clusters, {R5(*CI('ratio'))} FROM bt"))
def grouped_pooled_ratios(spark, d):
    rows = pr.by_groupings(res(spark, d).filter("py = 0 AND measure = 'co2_ton'"), {
        "intensity": "intensity", "dist": cut("dist", pr.WIDE_DISTANCE_EDGES, pr.WIDE_DISTANCE_LABELS), "dur": cut("k_days", pr.DURATION_EDGES, pr.DURATION_LABELS)})
    return rounded(rs.boot_ratio(rows, ["grouping", "level", "phase"], "SID", "obs", "expected", draws=1000), {c: 5 for c in CI("ratio")})


def dose_sql(right):
    edges = pr.WIND_EDGES if right else [*pr.WIND_EDGES[:-1], 999]
    whens = " ".join(f"WHEN wind{'>' if right else '>='}{a} AND wind{'<=' if right else '<'}{b} THEN '{n}'" for a, b, n in zip(edges, edges[1:], pr.WIND_LABELS))
    return sql(RES, f"db AS (SELECT *, CASE {whens} END AS wind_bin FROM res WHERE py=0 AND measure='co2_ton' AND phase='storm')", boot_sql("db", "wind_bin", "SID", OE, RATIO, 1000, 1, extra_where="WHERE wind_bin IS NOT NULL"),
               body=f"SELECT wind_bin, (SELECT count(*) FROM db WHERE db.wind_bin=bt.wind_bin) AS n, n_clusters, {R5(*CI('ratio'))} FROM bt")


def dose(right):
    def run(spark, d):
        out = pr.dose_bins(res(spark, d).filter("py = 0 AND measure = 'co2_ton' AND phase = 'storm'"), "wind", right=right, draws=1000)
        return rounded(out, {c: 5 for c in CI("ratio")})
    return run


query("dose_bins_right_closed", dose_sql(True))(dose(True))
query("dose_bins_left_closed", dose_sql(False))(dose(False))


RESP = ('rv1 AS (SELECT SID, "window" AS wd, obs_hours, exp_hours, obs_co2, exp_co2, obs_nox, exp_nox, obs_pm25, exp_pm25, '
        "unnest(['intensity','all']) AS grouping, unnest([intensity,'All events']) AS level FROM wsum WHERE py=0 AND zone='total')",
        "rv2 AS (SELECT SID, wd, grouping, level, m AS measure, CASE m WHEN 'hours' THEN obs_hours WHEN 'co2' THEN obs_co2 WHEN 'nox' THEN obs_nox ELSE obs_pm25 END AS obs, "
        "CASE m WHEN 'hours' THEN exp_hours WHEN 'co2' THEN exp_co2 WHEN 'nox' THEN exp_nox ELSE exp_pm25 END AS expected FROM rv1, (VALUES ('hours'),('co2'),('nox'),('pm25')) t(m))")


@query("response_by_window", sql(WSUM, *RESP, boot_sql("rv2", "grouping, level, wd, measure", "SID", OE, RATIO, 1000, 1),
       body=f'SELECT grouping, level, wd AS "window", measure, n_clusters, {R5(*CI("ratio"))} FROM bt'))
def response_by_window(spark, d):
    w = wsum(spark, d).filter("py = 0 AND zone = 'total'")
    pairs = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(f"obs_{m}").alias("obs"), F.col(f"exp_{m}").alias("expected")) for m in ("hours", "co2", "nox", "pm25")])
    rows = pr.by_groupings(w, {"intensity": "intensity"}, total="All events").withColumn("_p", F.explode(pairs)).select("SID", "grouping", "level", "window", "_p.*")
    return rounded(rs.boot_ratio(rows, ["grouping", "level", "window", "measure"], "SID", "obs", "expected", draws=1000), {c: 5 for c in CI("ratio")})


ZR = """zf AS (SELECT i.intensity, i.wd, i.SID, z.zone, coalesce(sum(w.obs_co2),0) AS obs_co2, coalesce(sum(w.exp_co2),0) AS exp_co2, coalesce(sum(w.obs_hours),0) AS obs_hours, coalesce(sum(w.exp_hours),0) AS exp_hours FROM (SELECT DISTINCT intensity, "window" AS wd, SID FROM wsum WHERE py=0 AND zone<>'total') i
 CROSS JOIN (VALUES ('port'),('channel'),('anchorage'),('offshore_hold'),('offshore')) z(zone) LEFT JOIN wsum w ON w.py=0 AND w.SID=i.SID AND w."window"=i.wd AND w.zone=z.zone AND w.intensity=i.intensity GROUP BY ALL)"""
ZS = {f"{k}_{m}": f"{k}_{m}" for m in ("co2", "hours") for k in ("obs", "exp")}


@query("zone_ratios", sql(WSUM, ZR, boot_sql("zf", "intensity, wd, zone", "SID", ZS, {"co2": "obs_co2/nullif(exp_co2,0)", "hours": "obs_hours/nullif(exp_hours,0)"}, 1000, 7),
       body=f'SELECT intensity, wd AS "window", zone, n_clusters, {R5(*CI("co2"), *CI("hours"))} FROM bt'))
def zone_ratios(spark, d):
    out = pr.zone_ratios(wsum(spark, d).filter("py = 0"), ["intensity", "window"], ["co2", "hours"], draws=1000, seed=7)
    return rounded(out, {c: 5 for c in (*CI("co2"), *CI("hours"))})


@query("zone_share_of_normal", sql(WSUM, body="SELECT intensity, zone, round(sum(exp_co2),3) AS exp_co2, round(sum(exp_co2)/sum(sum(exp_co2)) OVER (PARTITION BY intensity),6) AS co2_share FROM wsum WHERE py=0 AND zone<>'total' GROUP BY intensity, zone"))
def zone_share_of_normal(spark, d):
    out = em.share_of_total(wsum(spark, d).filter("py = 0 AND zone <> 'total'"), ["intensity", "zone"], "exp_co2", "co2_share", within=["intensity"])
    return rounded(out.select("intensity", "zone", "exp_co2", "co2_share"), {"exp_co2": 3, "co2_share": 6})


@query("outer_share", sql(WSUM, "os AS (SELECT intensity, \"window\" AS wd, zone, m AS pollutant, CASE m WHEN 'co2' THEN obs_co2 WHEN 'nox' THEN obs_nox ELSE obs_pm25 END AS o, CASE m WHEN 'co2' THEN exp_co2 WHEN 'nox' THEN exp_nox ELSE exp_pm25 END AS e FROM wsum, (VALUES ('co2'),('nox'),('pm25')) t(m) WHERE py=0 AND zone<>'total')",
       body="SELECT intensity, wd AS \"window\", pollutant, round(sum(o)/sum(e),6) AS ratio, round(sum(CASE WHEN zone IN ('anchorage','offshore_hold','offshore') THEN o-e ELSE 0 END)/sum(o-e),4) AS share_outside, round(sum(o) FILTER (zone='anchorage')/sum(e) FILTER (zone='anchorage'),6) AS anchorage_ratio FROM os GROUP BY ALL"))
def outer_share(spark, d):
    out = pr.outer_share(wsum(spark, d).filter("py = 0"), ["intensity", "window"])
    return rounded(out, {"ratio": 6, "share_outside": 4, "anchorage_ratio": 6})


TRAIT = f"""tw AS (SELECT * FROM res WHERE py=0 AND measure='co2_ton' AND rel_day BETWEEN -2 AND k_days+29),
tt AS (SELECT unit, {', '.join(f"sum(CASE WHEN vclass='{c}' AND tier='total' THEN expected ELSE 0 END) AS c_{c}" for c in VCLASS)}, {', '.join(f"sum(CASE WHEN vclass='all' AND tier='{z}' THEN expected ELSE 0 END) AS z_{z}" for z in nm.TIERS)} FROM tw GROUP BY unit),
td AS (SELECT unit, count(*) AS days FROM (SELECT DISTINCT SID, unit, k_days, rel_day FROM tw) GROUP BY unit)"""


@query("port_traits", sql(RES, TRAIT, body="""SELECT unit, days, round(c_tanker/c_all,6) AS tanker_sh, round(c_cargo/c_all,6) AS cargo_sh, round(c_other/c_all,6) AS other_sh, round((z_port+z_channel)/c_all,6) AS inner_sh, round((z_anchorage+z_offshore_hold)/c_all,6) AS wait_sh, round(z_offshore/c_all,6) AS open_sh, round(ln(c_all/days),6) AS size,
 CASE WHEN c_tanker/c_all>=.55 THEN 'Energy' WHEN c_other/c_all>=.4 THEN 'Service' WHEN c_cargo/c_all>=.5 THEN 'Cargo' ELSE 'Mixed' END AS port_type, CASE WHEN z_offshore/c_all<.05 THEN 'River / inland' WHEN (z_anchorage+z_offshore_hold)/c_all>=.15 THEN 'Coastal, anchorage' ELSE 'Open coast' END AS layout FROM tt JOIN td USING (unit)"""))
def port_traits(spark, d):
    out = pr.port_traits(res(spark, d).filter("py = 0"), ["SID"], "unit")
    out = out.select("unit", "days", "tanker_sh", "cargo_sh", "other_sh", "inner_sh", "wait_sh", "open_sh", "size", "port_type", "layout")
    return rounded(out, {c: 6 for c in ("tanker_sh", "cargo_sh", "other_sh", "inner_sh", "wait_sh", "open_sh", "size")})


@query("placebo_queue_excess", sql(RES, f"""pq AS (SELECT CASE WHEN py=0 THEN 'real' ELSE 'placebo' END AS sample, intensity, SID, unit, py, obs-expected AS delta FROM res WHERE vclass='all' AND {WZ} AND measure='hours' AND phase='after')""",
       body="SELECT sample, intensity, count(DISTINCT (SID, unit, py)) AS pair_years, round(sum(delta),3) AS net_excess, round(sum(delta)/count(DISTINCT (SID, unit, py)),5) AS net_excess_per_pair_year FROM pq GROUP BY ALL"))
def placebo_queue_excess(spark, d):
    r = res(spark, d).filter("vclass = 'all' AND tier IN ('anchorage','offshore_hold') AND measure = 'hours' AND phase = 'after'").withColumn("sample", F.when(F.col("py") == 0, "real").otherwise("placebo"))
    return rounded(pr.excess_per_pair_year(r, ["sample", "intensity"], ["SID", "unit", "py"]), {"net_excess": 3, "net_excess_per_pair_year": 5})


CLM = """cw AS (SELECT SID, unit, intensity, "window" AS wd, obs_co2, exp_co2, obs_hours, exp_hours, obs_nox, exp_nox, obs_pm25, exp_pm25, zone FROM wsum WHERE py=0),
ce AS (SELECT SID, unit, intensity, """ + ", ".join(f"sum(CASE WHEN zone='total' AND wd='{w}' THEN {k}_{m} ELSE 0 END) AS {w}_{k[0]}_{m}" for w in WINDOW for k in ("obs", "exp") for m in ("co2", "hours", "nox", "pm25")) + """,
 sum(CASE WHEN wd='storm' AND zone IN ('anchorage','offshore_hold','offshore') THEN obs_co2-exp_co2 ELSE 0 END) AS d_out, sum(CASE WHEN wd='storm' AND zone<>'total' THEN obs_co2-exp_co2 ELSE 0 END) AS d_all FROM cw GROUP BY ALL),
cg AS (SELECT *, unnest(['all','intensity','port']) AS grouping, unnest(['All events',intensity,unit]) AS level FROM ce)"""
CLS = {"c1_co2_storm": "storm_o_co2/storm_e_co2", "c2_share_outside": "d_out/d_all", "c3_co2_event": "event30_o_co2/event30_e_co2", "c4_co2_per_call": "(event30_o_co2/event30_o_pm25)/(event30_e_co2/event30_e_pm25)",
       "c5_storm_gap": "storm_o_co2/storm_e_co2-storm_o_hours/storm_e_hours", "c5_after_gap": "after_o_co2/after_e_co2-after_o_hours/after_e_hours", "c6_hours_event": "event30_o_hours/event30_e_hours",
       "c6_nox_event": "event30_o_nox/event30_e_nox", "c6_pm25_event": "event30_o_pm25/event30_e_pm25"}
CSUM = {f"{w}_{k}_{m}": f"{w}_{k}_{m}" for w in WINDOW for k in "oe" for m in ("co2", "hours", "nox", "pm25")} | {"d_out": "d_out", "d_all": "d_all"}


def claim_rows(spark, d):
    w = wsum(spark, d).filter("py = 0")
    total, outer, inner = F.col("zone") == "total", F.col("zone").isin(*pr.OUTER_ZONES), F.col("zone") != "total"
    x = F.col("obs_co2") - F.col("exp_co2")
    storm = F.col("window") == "storm"
    aggs = [F.sum(F.when(total & (F.col("window") == wd), F.col(f"{k}_{m}")).otherwise(0.0)).alias(f"{wd}_{k[0]}_{m}") for wd in WINDOW for k in ("obs", "exp") for m in ("co2", "hours", "nox", "pm25")]
    e = w.groupBy("SID", "unit", "intensity").agg(*aggs, F.sum(F.when(storm & outer, x).otherwise(0.0)).alias("d_out"), F.sum(F.when(storm & inner, x).otherwise(0.0)).alias("d_all"))
    return e.withColumns({"o_co2c": F.col("event30_o_co2"), "e_co2c": F.col("event30_e_co2"), "o_calls": F.col("event30_o_pm25"), "e_calls": F.col("event30_e_pm25")})


CEST = [c for k in CLS for c in ((k,) if k == "c2_share_outside" else CI(k))]


@query("claims_by_group", sql(WSUM, CLM, boot_sql("cg", "grouping, level", "SID", CSUM, CLS, 1000, 1, min_clusters=3), body=f"SELECT grouping, level, n_clusters, {', '.join(f'round({c},4) AS {c}' for c in CEST)} FROM bt"))
def claims_by_group(spark, d):
    rows = pr.by_groupings(claim_rows(spark, d), {"intensity": "intensity", "port": "unit"}, total="All events")
    return rounded(pr.claims(rows, ["grouping", "level"], draws=1000).select("grouping", "level", "n_clusters", *CEST), {c: 4 for c in CEST})


@query("claims_left_out", sql(WSUM, CLM, body="""SELECT SID AS left_out, round((sum(a) OVER ()-a)/(sum(b) OVER ()-b),6) AS c1, round((sum(c) OVER ()-c)/(sum(e) OVER ()-e),6) AS c3 FROM (SELECT SID, sum(storm_o_co2) AS a, sum(storm_e_co2) AS b, sum(event30_o_co2) AS c, sum(event30_e_co2) AS e FROM ce GROUP BY SID)"""))
def claims_left_out(spark, d):
    out = rs.left_out_sums(claim_rows(spark, d), "SID", ["storm_o_co2", "storm_e_co2", "event30_o_co2", "event30_e_co2"])
    return rounded(out.select("left_out", ratio("storm_o_co2", "storm_e_co2").alias("c1"), ratio("event30_o_co2", "event30_e_co2").alias("c3")), {"c1": 6, "c3": 6})


MET = """mo AS (SELECT o_custkey AS SID, o_orderpriority AS port, round(greatest(sum(o_totalprice)/100000-5,0),6) AS total_impact, count(*) AS recovery_days, CAST(min(o_orderdate) AS DATE) AS s0, CAST(max(o_orderdate) AS DATE) AS e0, avg(o_totalprice)/50000 AS act FROM orders WHERE o_orderstatus='F' GROUP BY ALL),
mt AS (SELECT o_custkey AS SID, o_orderpriority AS port, round(greatest(sum(o_totalprice)/100000-4,0),6) AS total_impact, count(*) AS recovery_days, CAST(min(o_orderdate) AS DATE) AS s0, CAST(max(o_orderdate) AS DATE) AS e0, avg(o_totalprice)/50000 AS act FROM orders WHERE o_orderstatus<>'P' GROUP BY ALL),
jj AS (SELECT mo.total_impact AS a, mt.total_impact AS b, mo.recovery_days AS ra, mt.recovery_days AS rb, mo.s0=mt.s0 AS ss, mo.e0=mt.e0 AS se, mt.act FROM mo JOIN mt USING (SID, port))"""


def metric_table(spark, d, keep, off):
    return s.table(spark, d, "orders").filter(keep).groupBy(F.col("o_custkey").alias("SID"), F.col("o_orderpriority").alias("port")).agg(
        F.round(F.greatest(F.sum("o_totalprice") / 100000 - off, F.lit(0.0)), 6).alias("total_impact"), F.count(F.lit(1)).alias("recovery_days"),
        F.to_date(F.min("o_orderdate")).alias("t_start_recovery"), F.to_date(F.max("o_orderdate")).alias("t_end_disruption"), (F.avg("o_totalprice") / 50000).alias("act"))


@query("agreement_metrics", sql(MET, body="""SELECT k AS subset, count(*) AS n, round(avg(CASE WHEN a>0 THEN 1 ELSE 0 END),6) AS ours, round(avg(CASE WHEN b>0 THEN 1 ELSE 0 END),6) AS theirs, round(avg(CASE WHEN (a>0)=(b>0) THEN 1 ELSE 0 END),6) AS agree,
 round(count(*) FILTER (a>0 AND b>0)/count(*) FILTER (a>0 OR b>0),6) AS jaccard, round(avg(CASE WHEN ss THEN 1 ELSE 0 END) FILTER (a>0 AND b>0),6) AS same_start, round(avg(CASE WHEN se THEN 1 ELSE 0 END) FILTER (a>0 AND b>0),6) AS same_end, round(avg(ra) FILTER (a>0 AND b>0),6) AS our_recovery, round(avg(rb) FILTER (a>0 AND b>0),6) AS their_recovery,
 round(quantile_cont(a/b,0.5) FILTER (a>0 AND b>0),6) AS median_impact_ratio FROM jj JOIN (VALUES (0),(1),(5)) t(k) ON k=0 OR act>=k GROUP BY k"""))
def agreement_metrics(spark, d):
    out = pr.agreement(metric_table(spark, d, "o_orderstatus = 'F'", 5), metric_table(spark, d, "o_orderstatus <> 'P'", 4), ["SID", "port"], "act")
    return rounded(out, {c: 6 for c in out.columns if c not in ("subset", "n")})


@query("category_summary", """SELECT o_shippriority AS category, n, disrupted, mean_impact, mean_recovery FROM (SELECT CAST(substr(o_orderpriority,1,1) AS INT) AS o_shippriority, count(*) AS n, round(avg(CASE WHEN o_totalprice>200000 THEN 1 ELSE 0 END),6) AS disrupted, round(avg(greatest(o_totalprice-200000,0)),2) AS mean_impact, round(avg(o_orderkey % 30),6) AS mean_recovery FROM orders GROUP BY 1)""")
def category_summary(spark, d):
    m = s.table(spark, d, "orders").selectExpr("CAST(substr(o_orderpriority,1,1) AS INT) AS cat", "greatest(o_totalprice-200000, 0D) AS total_impact", "o_orderkey % 30 AS recovery_days")
    return rounded(pr.category_summary(m, "cat", "total_impact"), {"disrupted": 6, "mean_impact": 2, "mean_recovery": 6})


@query("category_step", """WITH m AS (SELECT CAST(substr(o_orderpriority,1,1) AS INT) AS cat, avg(greatest(o_totalprice-200000,0)) AS i FROM orders GROUP BY ALL)
SELECT round(jump,6) AS jump, jump > 1.5 AS is_step FROM (SELECT (SELECT i FROM m WHERE cat=4)/(SELECT i FROM m WHERE cat=3) AS jump)""")
def category_step(spark, d):
    m = s.table(spark, d, "orders").selectExpr("CAST(substr(o_orderpriority,1,1) AS INT) AS cat", "greatest(o_totalprice-200000, 0D) AS total_impact", "o_orderkey % 30 AS recovery_days")
    return rounded(pr.category_step(pr.category_summary(m, "cat", "total_impact")), {"jump": 6})


@query("published_counts", sql(s.TRACK, s.PORT, body=f"""SELECT name, published, ours, round(100.0*(ours-published)/published,4) AS diff_pct FROM (SELECT unnest(['ports','storms','interactions']) AS name, unnest([145,90,1927]) AS published, unnest([p,st,n]) AS ours FROM
 (SELECT count(DISTINCT port) AS p, count(DISTINCT SID) AS st, count(*) AS n FROM (SELECT DISTINCT SID, port FROM track, port WHERE {s.hav_sql("p_lat", "p_lon", "LAT", "LON")} <= 500)))"""))
def published_counts(spark, d):
    from .movement import exposed
    return rounded(pr.count_check(exposed(spark, d), {"ports": 145, "storms": 90, "interactions": 1927}, (2015, 2023)), {"diff_pct": 4})


@query("golden_check", sql(RES, body=f"""SELECT intensity, e AS expected, round(m,5) AS measured, abs(m-e)<0.01 AS ok FROM (SELECT intensity, sum(obs)/sum(expected) AS m, CASE intensity WHEN '{TS}' THEN 0.82 WHEN '{STS}' THEN 0.73 ELSE 0.47 END::DOUBLE AS e FROM res WHERE py=0 AND phase='storm' GROUP BY intensity)"""))
def golden_check(spark, d):
    r = res(spark, d)
    got = r.filter("py = 0 AND phase = 'storm'").groupBy("intensity").agg(ratio(F.sum("obs"), F.sum("expected")).alias("value"))
    want = spark.createDataFrame([(k, float(v)) for k, v in pr.PUBLISHED_RATIOS.items()], "intensity string, value double")
    return rounded(pr.golden_check(got, want, ["intensity"]), {"measured": 5})


@query("report_table", sql(RES, body=f"""SELECT CASE intensity WHEN '{TS}' THEN 'Tropical storm' WHEN '{STS}' THEN 'Strong tropical storm' ELSE 'Hurricane' END AS intensity, CASE phase WHEN 'prep' THEN '2 days before' WHEN 'storm' THEN 'Storm window' ELSE '10 days after' END AS phase, round(sum(obs)/sum(expected)-1,4) AS ratio FROM res WHERE py=0 GROUP BY res.intensity, res.phase"""))
def report_table(spark, d):
    r = res(spark, d).filter("py = 0").groupBy("intensity", "phase").agg(ratio(F.sum("obs"), F.sum("expected")).alias("ratio"))
    labels = {"intensity": {TS: (0, "Tropical storm"), STS: (1, "Strong tropical storm"), HU: (2, "Hurricane")}, "phase": {"prep": (0, "2 days before"), "storm": (1, "Storm window"), "after": (2, "10 days after")}}
    return pr.report(r, labels, {"ratio": 4}, [], changes=["ratio"])


@query("pivot_measures", sql(RES, body="SELECT vclass, tier, " + ", ".join(f"round(sum(CASE WHEN measure='{m}' THEN {c} ELSE 0 END),3) AS {k}_{m}" for k, c in (("obs", "obs"), ("exp", "expected")) for m in ("hours", "co2_ton")) + " FROM res WHERE py=0 GROUP BY ALL"))
def pivot_measures(spark, d):
    return rounded(pr.wide_measures(res(spark, d).filter("py = 0"), ["vclass", "tier"], ["hours", "co2_ton"]), {c: 3 for c in ("obs_hours", "obs_co2_ton", "exp_hours", "exp_co2_ton")})


@query("map_table", sql(RES, TRAIT, WSUM, f"""nv AS (SELECT unit, count(*) AS n_events, count(*) FILTER (intensity='{HU}') AS n_strong FROM (SELECT DISTINCT SID, unit, intensity FROM res WHERE py=0) GROUP BY unit),
qx AS (SELECT unit, greatest(sum(obs-expected),0) AS w FROM res WHERE py=0 AND intensity='{HU}' AND {WZ} AND measure='co2_ton' AND phase='after' GROUP BY unit)""",
       body="SELECT unit, round(c_all/days,5) AS co2_day, coalesce(n_events,0) AS n_events, coalesce(n_strong,0) AS n_strong, round(coalesce(w/(SELECT sum(w) FROM qx),0),6) AS queue_share FROM tt JOIN td USING (unit) LEFT JOIN nv USING (unit) LEFT JOIN qx USING (unit)"))
def map_table(spark, d):
    r = res(spark, d).filter("py = 0")
    q = r.filter(F.col("tier").isin(*pr.WAITING_ZONES) & F.expr("measure = 'co2_ton' AND phase = 'after'")).withColumn("x_wait_co2", F.col("delta"))
    out = pr.map_table(pr.port_traits(r, ["SID"], "unit"), r.select("SID", "unit", "intensity").distinct(), q, "unit", HU)
    return rounded(out.select("unit", "co2_day", "n_events", "n_strong", "queue_share"), {"co2_day": 5, "queue_share": 6})


@query("queue_claim", sql(WSUM, """qc AS (SELECT SID, unit, intensity, obs_co2-exp_co2 AS v, exp_hours AS nd FROM wsum WHERE py=0 AND zone='anchorage' AND "window"='after'),
qr AS (SELECT *, row_number() OVER (PARTITION BY intensity ORDER BY v DESC) AS r FROM qc)""", body="""SELECT intensity, round(greatest(sum(v),0)/sum(nd),6) AS queue_days, round(avg(CASE WHEN v>0 THEN 1 ELSE 0 END),6) AS share_with_queue,
 round(sum(greatest(v,0)) FILTER (r<=3)/sum(greatest(v,0)),6) AS top_share FROM qr GROUP BY intensity"""))
def queue_claim(spark, d):
    w = wsum(spark, d).filter("py = 0 AND zone = 'anchorage' AND window = 'after'").selectExpr("SID", "unit", "intensity", "obs_co2 - exp_co2 AS jit_co2", "exp_hours AS norm_co2_day")
    return rounded(pr.queue_claim(w, ["intensity"]), {"queue_days": 6, "share_with_queue": 6, "top_share": 6})


@query("port_labels", sql(body="""SELECT n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN 'Gulf' WHEN 1 THEN 'Gulf' WHEN 2 THEN 'Atlantic' WHEN 3 THEN 'Caribbean' ELSE 'Atlantic' END AS coast, CASE WHEN n_nationkey % 5 IN (0,1,2) THEN 'Gulf/SE' ELSE 'other' END AS side, CASE WHEN 2010+n_nationkey<=2019 THEN '2015–2019' ELSE '2020–2023' END AS period FROM nation""").replace("WITH \n", ""))
def port_labels(spark, d):
    name = s._nth("n_nationkey % 5", ["South Louisiana, LA, Port of", "Tampa Port Authority, FL", "Jacksonville, FL", "Virgin Islands - St. Croix, VI", "New York, NY & NJ"])
    n = s.table(spark, d, "nation").selectExpr("n_nationkey", f"{name} AS port")
    return n.select("n_nationkey", pr.coast("port").alias("coast"), pr.gulf_or_other("port").alias("side"), pr.period(F.col("n_nationkey") + 2010).alias("period"))


TGS = """tu AS (SELECT unit, count(*) AS ev, sum(x_wait_co2) AS w, sum(x_wait_nox) AS wn, sum(ms*3.114::DOUBLE) AS ca FROM te LEFT JOIN ts USING (SID, unit) GROUP BY unit HAVING sum(x_wait_co2)>0),
tk AS (SELECT *, row_number() OVER (ORDER BY w DESC, unit) AS r FROM tu)"""


@query("targeting_concentration", sql(RES, QUEUE, TGT, TGS, body="""SELECT 'top' AS scope, k AS units, CAST(sum(ev)*10 AS BIGINT) AS intervention_port_days, round(sum(w)/(SELECT sum(w) FROM tk),5) AS share_of_waiting_co2, round(sum(w)/(SELECT sum(x_all_co2) FROM te),5) AS share_of_excess_co2, round(sum(wn)/(SELECT sum(x_all_nox) FROM te),5) AS share_of_excess_nox, round(greatest(sum(ca),0),3) AS co2_avoided_t FROM tk JOIN (VALUES (1),(2),(3),(5),(8)) t(k) ON r<=k GROUP BY k
 UNION ALL SELECT 'all positive', CAST(count(*) AS INT), CAST(sum(ev)*10 AS BIGINT), 1.0, round(sum(w)/(SELECT sum(x_all_co2) FROM te),5), round(sum(wn)/(SELECT sum(x_all_nox) FROM te),5), round(greatest(sum(ca),0),3) FROM tk"""))
def targeting_concentration(spark, d):
    ev = checkpointed(pr.targeting(res(spark, d).filter("py = 0"), queued(spark, d), ["SID", "unit"]))
    out = pr.targeting_concentration(ev, "unit", port_days=1000, event_days=100)
    return rounded(out.select("scope", "units", "intervention_port_days", "share_of_waiting_co2", "share_of_excess_co2", "share_of_excess_nox", "co2_avoided_t"),
                   {"share_of_waiting_co2": 5, "share_of_excess_co2": 5, "share_of_excess_nox": 5, "co2_avoided_t": 3})


CT = f"""ctr AS (SELECT SID, "window" AS wd, CASE WHEN SID % 2 = 0 THEN 'Gulf' ELSE 'Atlantic' END AS coast, CASE SID % 3 WHEN 0 THEN 'Energy' WHEN 1 THEN 'Cargo' ELSE 'Mixed' END AS port_type, obs_co2, exp_co2, obs_hours, exp_hours FROM wsum WHERE py=0 AND zone='total' AND intensity IN ('{STS}','{HU}'))"""


@query("coast_type_ratios", sql(WSUM, CT, boot_sql("ctr", "coast, port_type, wd", "SID", ZS, {"co2": "obs_co2/exp_co2", "hours": "obs_hours/exp_hours"}, 1000, 8),
       body=f'SELECT coast, port_type, wd AS "window", n_clusters, {R5(*CI("co2"), *CI("hours"))} FROM bt'))
def coast_type_ratios(spark, d):
    w = wsum(spark, d).filter("py = 0 AND zone = 'total'").withColumn("coast", F.expr("CASE WHEN SID % 2 = 0 THEN 'Gulf' ELSE 'Atlantic' END")) \
        .withColumn("port_type", F.expr("CASE SID % 3 WHEN 0 THEN 'Energy' WHEN 1 THEN 'Cargo' ELSE 'Mixed' END"))
    return rounded(pr.coast_type_ratios(w, strong=[STS, HU], draws=1000, seed=8), {c: 5 for c in (*CI("co2"), *CI("hours"))})


LEFT = """tops AS (SELECT unit AS sp FROM (SELECT unit, max(w) AS r FROM rg GROUP BY unit ORDER BY r DESC, unit LIMIT 8)),
lo AS (SELECT sp, 2 AS k, SID, unit, x - avg(x) OVER (PARTITION BY sp) AS xt, y - avg(y) OVER (PARTITION BY sp) AS yt FROM rg JOIN tops ON rg.unit <> sp WHERE isfinite(y) AND isfinite(x))"""


@query("leave_top_ports_out", sql(WSUM, REG, LEFT, focus_sql("l", "lo"), body="SELECT sp AS left_out, round(b,6) AS coef, round(sqrt(v),6) AS se, n FROM lb JOIN ls USING (sp)"))
def leave_top_ports_out(spark, d):
    out = rg.leave_top_out(reg_rows(spark, d), "y", ["x"], "unit", "w", "x", top=8)
    return rounded(out.select("left_out", "coef", "se", "n"), {"coef": 6, "se": 6})
