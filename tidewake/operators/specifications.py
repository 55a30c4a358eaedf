"""Many regressions of the same rows in two passes: one moment matrix per set of rows, one sum of influences per cluster."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from tidewake.functions.numeric import finite
from .quantiles import normal_two_sided
from .regress import Z95, with_missing_flag
from .sizing import checkpointed

#: Sets of rows (which fits a row belongs to) whose moments the driver may hold; more mean that `where` conditions cut rows too finely.
MAX_ROW_SETS = 20_000
NEGLIGIBLE = 1e-10


@dataclass(frozen=True)
class Fit:
    """One regression: y on xs over the complete rows of `where`; `focus` is the term to report, under each of `clusters`
    (names of cluster column tuples of one or two columns)."""
    name: str
    y: str
    xs: Sequence[str]
    focus: str
    clusters: Sequence[str]
    where: Column | None = None


def swept(m: np.ndarray, j: int) -> np.ndarray:
    """The sweep operator on pivot j of a symmetric matrix. After sweeping a set of terms, their block is the inverse of their
    moments and their entries in the column of y are the coefficients."""
    row = m[j] / m[j, j]
    out = m - np.outer(m[:, j], row)
    out[j], out[:, j] = row, -m[:, j] / m[j, j]
    out[j, j] = 1 / m[j, j]
    return out


def _solve(total: np.ndarray, names: list[str], fit: Fit):
    """n, terms used, means, and for the focus its coefficient, deviation, and the linear forms of the residual and of
    its influence: (constant, {column: weight}); None where the focus cannot be told from the other terms."""
    n = total[0, 0]
    at = {c: i + 1 for i, c in enumerate(names)}
    columns = [*fit.xs, fit.y]
    index = [at[c] for c in columns]
    mean = total[0, index] / n if n else np.zeros(len(index))
    centred = total[np.ix_(index, index)] - n * np.outer(mean, mean)
    size = np.diag(centred).copy()
    fixed = size <= NEGLIGIBLE * np.maximum(np.diag(total)[index], 1e-300)
    size[fixed] = 1.0
    m = centred / np.sqrt(np.outer(size, size))
    focus, used = fit.xs.index(fit.focus), []
    for j in [*[i for i in range(len(fit.xs)) if i != focus], focus]:
        if not fixed[j] and m[j, j] > NEGLIGIBLE:
            m = swept(m, j)
            used.append(j)
    if focus not in used or fixed[-1]:
        return None
    scale = np.sqrt(size)
    slopes = {columns[j]: m[j, -1] * scale[-1] / scale[j] for j in used}
    weights = {columns[j]: m[focus, j] / (scale[focus] * scale[j]) for j in used}
    middle = dict(zip(columns, mean))
    residual = (-middle[fit.y] + sum(b * middle[c] for c, b in slopes.items()), {fit.y: 1.0, **{c: -b for c, b in slopes.items()}})
    influence = (-sum(w * middle[c] for c, w in weights.items()), weights)
    return int(n), len(used) + 1, slopes[fit.focus], math.sqrt(size[focus] / (n - 1)), residual, influence


def _weights(form, names: list[str]) -> Column:
    """A linear form as weights of (1, names...)."""
    constant, weights = form
    return F.array(F.lit(float(constant)), *[F.lit(float(weights.get(c, 0.0))) for c in names])


def fit_all(df: DataFrame, fits: Sequence[Fit], clusters: dict[str, tuple[str, ...]], scaled: Sequence[str] = ()) -> DataFrame:
    """The focus coefficient of every fit under each of its clusterings: fit, clustering, coef, se, lo, hi, p, n, n_clusters.

    Rows with a null or non-finite value in a column of a fit are left out of that fit only. Terms that do not vary, or that the
    terms before them determine, are left out; a focus left out gives no row. `scaled` names the terms whose coefficient is
    per standard deviation (of the rows of the fit). Errors are cluster-robust with G/(G-1) * (n-1)/(n-k) and normal p-values;
    two columns give two-way errors: first + second - both.

    The first pass sums products of all columns for each set of rows that share their fits; a fit's moment matrix is the sum over
    its sets. Systems are swept on the driver, k x k each. In the second pass a row adds its residual times its influence
    on the focus to its cluster, for all fits at once.
    """
    fits = list(fits)
    names = sorted({c for f in fits for c in (*f.xs, f.y)})
    ends = sorted({c for of in clusters.values() for c in of})
    clean = df.withColumns({c: finite(F.col(c).cast("double")) for c in names})
    # which columns a row has, 60 to a number, so that a fit tests its rows with a few bits
    words = [names[i:i + 60] for i in range(0, len(names), 60)]
    there = clean.withColumns({f"_has{i}": reduce(lambda a, b: a + b, [F.col(c).isNotNull().cast("bigint") * (1 << j) for j, c in enumerate(w)]) for i, w in enumerate(words)})

    def complete(f: Fit) -> Column:
        needed = {i: sum(1 << j for j, c in enumerate(w) if c in (*f.xs, f.y)) for i, w in enumerate(words)}
        has_all = reduce(lambda a, b: a & b, [F.col(f"_has{i}").bitwiseAND(F.lit(bits)) == bits for i, bits in needed.items()])
        return has_all if f.where is None else has_all & F.coalesce(f.where, F.lit(False))

    sets = F.concat(*[F.when(complete(f), "1").otherwise("0") for f in fits])
    rows = checkpointed(there.withColumn("_set", sets).where(F.col("_set").contains("1")).select("_set", *ends, *names))
    value = [F.lit(1.0), *[F.coalesce(F.col(c), F.lit(0.0)) for c in names]]
    width = len(value)
    vector = rows.withColumn("_v", F.array(*value))
    products = vector.select("_set", "_v", F.posexplode("_v").alias("i", "x")).groupBy("_set", "i").agg(F.array(*[F.sum(F.col("x") * F.col("_v")[j]) for j in range(width)]).alias("m"))
    held = products.limit((MAX_ROW_SETS + 1) * width).collect()
    if len(held) > MAX_ROW_SETS * width:
        raise ValueError(f"over {MAX_ROW_SETS} different sets of rows")
    moments = np.zeros((len(fits), width, width))
    for r in held:
        for f, flag in enumerate(r._set):
            if flag == "1":
                moments[f, r.i] += r.m
    solved = {f: found for f, fit in enumerate(fits) if (found := _solve(moments[f], names, fit)) is not None}
    schema = "fit string, clustering string, coef double, se double, lo double, hi double, p double, n bigint, n_clusters bigint"
    if not solved:
        return df.sparkSession.createDataFrame([], schema)
    forms = F.array(*[F.struct(F.lit(f).alias("f"), _weights(s[4], names).alias("e"), _weights(s[5], names).alias("a")) for f, s in solved.items()])
    dot = lambda weights: reduce(lambda x, y: x + y, [F.col(weights)[j] * F.col("_v")[j] for j in range(width)])
    scores = (vector.select("_set", "_v", *ends, F.explode(forms).alias("_f")).select("*", "_f.*").where(F.substring("_set", F.col("f") + 1, F.lit(1)) == "1")
              .select("f", *ends, (dot("e") * dot("a")).alias("u")))
    groups = list(dict.fromkeys(g for of in clusters.values() for g in ([of] if len(of) == 1 else [(of[0],), (of[1],), of])))
    summed = scores.groupingSets([[F.col("f"), *[F.col(c) for c in g]] for g in groups], "f", *[F.col(c) for c in ends]).agg(F.grouping_id("f", *ends).alias("_g"), F.sum("u").alias("u"))
    meat = {(r._g, r.f): r for r in summed.groupBy("_g", "f").agg(F.sum(F.col("u") * F.col("u")).alias("m"), F.count(F.lit(1)).alias("g")).collect()}
    code = {g: sum(0 if c in g else 1 << (len(ends) - 1 - i) for i, c in enumerate(ends)) for g in groups}
    out = []
    for f, (n, k, slope, deviation, _, _) in solved.items():
        per = deviation if fits[f].focus in scaled else 1.0

        def part(g):
            r = meat[code[g], f]
            return (r.m * r.g / (r.g - 1) * (n - 1) / (n - k) if r.g > 1 and n > k else float("nan")), r.g

        for name in fits[f].clusters:
            of = clusters[name]
            v, count = part(of[:1])
            if len(of) == 2:
                v += part(of[1:])[0] - part(of)[0]
            se = float(per) * math.sqrt(v) if v > 0 else float("nan")
            coef = float(per * slope)
            out.append((fits[f].name, name, coef, se, coef - Z95 * se, coef + Z95 * se, normal_two_sided(coef / se) if se > 0 else None, n, count))
    return df.sparkSession.createDataFrame(out, schema)


# ---------------------------------------------------------------- waiting zones
# fixed values: names of the model terms and specifications
STORM_TERMS = ["wind", "i_strong", "i_hurricane", "log_dist", "k_days", "surge_m", "rain_mm", "landfall", "met_missing"]
SIZE_TERMS = ["log_co2_day", "log_hours_day"]
FLEET_TERMS = ["tanker_sh", "passenger_sh", "other_sh"]
PLACE_TERMS = ["open_sh", "river"]
SCALED_TERMS = ["wait_sh", "log_co2_day", "log_hours_day", "log_wait_hours_day", "tanker_sh", "passenger_sh", "other_sh", "open_sh", "wind", "log_dist", "k_days",
                "surge_m", "rain_mm", "season"]
NESTED = {"1 waiting share only": [], "2 + storm": STORM_TERMS, "3 + port size and baseline traffic": SIZE_TERMS, "4 + fleet mix": FLEET_TERMS, "5 + Gulf": ["gulf"],
          "6 + geography": PLACE_TERMS, "7 + year": ["season"]}
OUTCOMES = {"whole-event CO2": ("event30", "lc"), "whole-event NOx": ("event30", "ln"), "CO2, 10 days after": ("after", "lc")}
CLUSTERINGS = {"storm": ("SID",), "port": ("port",), "two-way": ("SID", "port")}
MIN_DISTANCE_KM = 5.0


def waiting_design(events: DataFrame, traits: DataFrame, strong: str, hurricane: str) -> DataFrame:
    """Model columns of whole-port event rows.

    events: port, SID, window, zone, exp_hours, days, intensity, wind, dist, k_days, surge_m, rain_mm, landfall (0/1), season, gulf
    (0/1), lc, ln and placebo. Normal ship-hours of a port come from its real events of the window event30. traits: port, all,
    days, wait_sh, tanker_sh, passenger_sh, other_sh, open_sh, layout. Missing surge or rain counts as 0 with a flag.
    """
    normal = events.where("window = 'event30' AND NOT placebo").withColumn("_h", F.col("exp_hours") / F.col("days"))
    whole = normal.where("zone = 'total'").groupBy("port").agg(F.avg("_h").alias("_hours"))
    waiting = (normal.where(F.col("zone").isin("anchorage", "offshore_hold")).groupBy("port", "SID").agg(F.sum("_h").alias("_h"))
               .groupBy("port").agg(F.avg("_h").alias("_wait")))
    own = traits.select("port", "wait_sh", "tanker_sh", "passenger_sh", "other_sh", "open_sh", (F.col("layout") == "River / inland").cast("double").alias("river"),
                        F.ln(F.col("all") / F.col("days")).alias("log_co2_day"))
    flagged = with_missing_flag(events.where("zone = 'total'"), ["surge_m", "rain_mm"], "met_missing")
    return (flagged.join(own, "port").join(whole, "port", "left").join(waiting, "port", "left")
            .withColumns({"log_hours_day": F.ln("_hours"), "log_wait_hours_day": F.log1p(F.coalesce("_wait", F.lit(0.0))),
                          "log_dist": F.ln(F.greatest("dist", F.lit(MIN_DISTANCE_KM))), 
                          "i_strong": F.coalesce(F.col("intensity") == strong, F.lit(False)).cast("double"),
                          "i_hurricane": F.coalesce(F.col("intensity") == hurricane, F.lit(False)).cast("double")}).drop("_hours", "_wait"))


def waiting_specifications(design: DataFrame, traits: DataFrame, top: int = 8) -> DataFrame:
    """All ten specifications of the waiting-zone check for three outcomes: outcome, spec, clustering, coef, se, lo, hi, p, n, n_clusters.

    Seven nested models of the waiting share; 8 the absolute waiting capacity in its place; 9 the full model with each of the `top` ports of
    the largest waiting share left out in turn; 10 the full model on placebo dates. 1 to 8 are clustered by storm, by port and both
    ways, 9 and 10 both ways.
    """
    ports = [r.port for r in traits.where("wait_sh IS NOT NULL").orderBy(F.desc("wait_sh"), "port").select("port").limit(top).collect()]
    every = tuple(CLUSTERINGS)
    fits, names = [], []
    for outcome, (window, y) in OUTCOMES.items():
        here = F.col("window") == window
        real = here & ~F.col("placebo")
        full: list[str] = []

        def add(spec, xs, focus, clusters, where):
            names.append((outcome, spec))
            fits.append(Fit(str(len(fits)), y, [*xs, focus], focus, clusters, where))

        for spec, more in NESTED.items():
            full = [*full, *more]
            add(spec, full, "wait_sh", every, real)
        add("8 absolute waiting capacity", full, "log_wait_hours_day", every, real)
        for port in ports:
            add(f"9 without {port}", full, "wait_sh", ("two-way",), real & (F.col("port") != port))
        add("10 placebo dates", full, "wait_sh", ("two-way",), here & F.col("placebo"))
    labels = design.sparkSession.createDataFrame([(str(i), *of) for i, of in enumerate(names)], "fit string, outcome string, spec string")
    return fit_all(design, fits, CLUSTERINGS, SCALED_TERMS).join(labels, "fit").drop("fit")
