"""Series by run: windows, correlations, cutoffs, expansion, viscosity, elasticity.

A series is (by..., t, value...), t ordering it. Windows are partitioned by series, so many series run side by
side; what needs a whole series at once (an FFT, an integral with a stopping rule) is a grouped function of one.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .. import constants as C


def running_mean(df: DataFrame, by: list[str], t: str, value: str, n: int, name: str = "mean") -> DataFrame:
    """Centred mean of n values, i - n // 2 to i + n - n // 2 - 1; null where the window is incomplete."""
    w = W.partitionBy(*by).orderBy(t).rowsBetween(-(n // 2), n - n // 2 - 1)
    return df.withColumn(name, F.when(F.count(F.lit(1)).over(w) == n, F.avg(value).over(w)))


def cumulative_trapezoid(df: DataFrame, by: list[str], t: str, value: str, dt: Column, name: str = "integral") -> DataFrame:
    """Running trapezoid with step dt, first value 0."""
    w = W.partitionBy(*by).orderBy(t)
    step = F.coalesce((F.col(value) + F.lag(value).over(w)) * 0.5 * dt, F.lit(0.0))
    return df.withColumn("_s", step).withColumn(name, F.sum("_s").over(w.rowsBetween(W.unboundedPreceding, W.currentRow))).drop("_s")


def cumulative_sem(df: DataFrame, by: list[str], t: str, value: str) -> DataFrame:
    """Running mean from the start and its standard error (0 for the first row): mean, sem."""
    w = W.partitionBy(*by).orderBy(t).rowsBetween(W.unboundedPreceding, W.currentRow)
    n = F.count(value).over(w)
    return df.withColumns({"mean": F.avg(value).over(w), "sem": F.when(n > 1, F.stddev_samp(value).over(w) / F.sqrt(n)).otherwise(0.0)})


def autocorrelation(x: np.ndarray, lags: int) -> np.ndarray:
    """Unbiased, without removing the mean: zero-padded FFT, divided by the number of products."""
    n = len(x)
    f = np.fft.rfft(x, 2 * n)
    return np.fft.irfft(f * np.conj(f), 2 * n)[:n][:lags] / (n - np.arange(n))[:lags]


def acf(df: DataFrame, by: list[str], t: str, value: str, max_lag: int) -> DataFrame:
    """by, lag, acf for lag 0 .. min(max_lag, length) - 1. One group is one series."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*by).schema) + ", lag int, acf double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y = autocorrelation(pdf.sort_values(t)[value].to_numpy(float), max_lag)
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] * len(y) for c in by}, "lag": np.arange(len(y), dtype=np.int32), "acf": y})

    return df.select(*by, t, value).groupBy(*by).applyInPandas(run, schema)


def noise_cutoff(df: DataFrame, by: list[str], lag: str, value: str, epsilon: float = 0.01, consecutive: int = 3) -> DataFrame:
    """by, cut: first lag that starts so many values below epsilon of the largest, else the first below, else the last."""
    w = W.partitionBy(*by)
    o = w.orderBy(lag)
    low = F.abs(value) < epsilon * F.max(F.abs(value)).over(w)
    got = df.withColumn("_low", low).withColumn("_run", _runs(o, consecutive))
    cut = F.coalesce(F.min(F.when(F.col("_run"), F.col(lag))), F.min(F.when(F.col("_low"), F.col(lag))), F.max(lag))
    return got.groupBy(*by).agg(cut.alias("cut"))


def _runs(o, n: int) -> Column:
    run = F.col("_low")
    for k in range(1, n):
        run = run & F.coalesce(F.lead("_low", k).over(o), F.lit(False))
    return run


def integral_cutoff(df: DataFrame, by: list[str], lag: str, value: str, dt: Column, epsilon: float = 0.01) -> DataFrame:
    """by, cut: first lag whose integral is 1 - epsilon of the whole, plus 1; else first that hardly grows, plus 2; else the last."""
    g = cumulative_trapezoid(df, by, lag, value, dt, "_i")
    w = W.partitionBy(*by)
    last = F.last("_i").over(w.orderBy(lag).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    g = g.withColumn("_r", F.col("_i") / F.nullif(last, F.lit(0.0)))
    g = g.withColumn("_d", F.abs(F.lead("_r").over(w.orderBy(lag)) - F.col("_r")))
    reach = F.min(F.when(F.col("_r") >= 1 - epsilon, F.col(lag))) + 1
    flat = F.min(F.when(F.col("_d") < epsilon, F.col(lag))) + 2
    return g.groupBy(*by).agg(F.least(F.coalesce(reach, flat, F.max(lag)), F.max(lag)).alias("cut"))


def self_consistent_cutoff(df: DataFrame, by: list[str], lag: str, value: str, dt: Column, c: float = 5.0) -> DataFrame:
    """by, cut: first lag whose time is c times the integral so far or more, the integral being positive; else the last."""
    g = cumulative_trapezoid(df, by, lag, value, dt, "_i").withColumn("_b", F.lag("_i").over(W.partitionBy(*by).orderBy(lag)))
    hit = (F.col("_b") > 0) & (F.col("_b") < F.col(lag) * dt / c)
    return g.groupBy(*by).agg(F.coalesce(F.min(F.when(hit, F.col(lag))), F.max(lag)).alias("cut"))


def closest_divisor(df: DataFrame, target: str, near: str) -> DataFrame:
    """df with divisor: that of target nearest to near, the smaller on ties; null unless target is positive.

    Divisors come in pairs, one of which is at most the square root.
    """
    n = F.greatest(F.col(target).cast("bigint"), F.lit(1))
    low = F.filter(F.sequence(F.lit(1).cast("bigint"), F.floor(F.sqrt(n.cast("double"))) + 1), lambda d: n % d == 0)
    all_ = F.concat(low, F.transform(low, lambda d: (n / d).cast("bigint")))
    best = F.array_min(F.transform(all_, lambda d: F.struct(F.abs(d - F.col(near)).alias("gap"), d.alias("d"))))
    return df.withColumn("divisor", F.when(F.col(target) > 0, best["d"]))


def plateaued(df: DataFrame, by: list[str], t: str, value: str, tail: float = 0.2, tolerance: float = 0.05) -> DataFrame:
    """by, plateaued: slope per step of the tail against its mean size; under two points false, zero mean true."""
    w = W.partitionBy(*by)
    g = df.withColumns({"_k": F.row_number().over(w.orderBy(t)) - 1, "_n": F.count(F.lit(1)).over(w)})
    g = g.where(F.col("_k") >= F.floor(F.col("_n") * (1 - tail)))
    m = F.avg(F.abs(value))
    flat = F.when(F.count("*") < 2, False).when(m == 0, True).otherwise(F.abs(F.regr_slope(F.col(value), F.col("_k").cast("double"))) / m < tolerance)
    return g.groupBy(*by).agg(flat.alias("plateaued"))


def log_downsample(df: DataFrame, by: list[str], t: str, most: int) -> DataFrame:
    """At most so many rows of each series, at log-spaced places that hold the first and the last."""
    w = W.partitionBy(*by)
    g = df.withColumns({"_k": F.row_number().over(w.orderBy(t)) - 1, "_n": F.count(F.lit(1)).over(w)})
    sizes = g.select(*by, "_n").distinct().where(F.col("_n") > most)
    i = F.explode(F.sequence(F.lit(0), F.lit(most - 1)))
    at = F.rint(F.pow(F.lit(10.0), F.log10(F.col("_n").cast("double")) * F.col("_i") / (most - 1)) - 1).cast("int")
    keep = sizes.withColumn("_i", i).select(*by, at.alias("_k")).distinct()
    return g.where(F.col("_n") <= most).unionByName(g.where(F.col("_n") > most).join(keep, [*by, "_k"], "left_semi")).drop("_k", "_n")


# --- thermal expansion -------------------------------------------------------------------------------


def enthalpy(thermo: DataFrame, pressure_gpa: float) -> DataFrame:
    """thermo with h in eV and ptot in GPa."""
    return thermo.withColumns({"h": F.col("energy_tot") + F.lit(pressure_gpa * 1e9) * F.col("volume") * C.PA_A3_TO_EV, "ptot": (F.col("pxx") + F.col("pyy") + F.col("pzz")) / 3})


def expansion(df: DataFrame, by: list[str], h: str, sizes: list[str], temperature: Column) -> DataFrame:
    """by and cte_<size> of each size: covariance with h over mean size, k_B and T squared."""
    one = [(F.covar_pop(h, s) / (F.avg(s) * C.K_B_EV * F.pow(F.first(temperature), F.lit(2.0)))).alias(f"cte_{s}") for s in sizes]
    return df.groupBy(*by).agg(*one)


def expansion_running(df: DataFrame, by: list[str], t: str, h: str, size: str, temperature: Column, n: int) -> DataFrame:
    """Like expansion, with fluctuations around running means of n values; incomplete windows are left out."""
    g = running_mean(running_mean(df, by, t, h, n, "_mh"), by, t, size, n, "_ms")
    g = g.where("_mh is not null")
    return g.groupBy(*by).agg((F.avg((F.col(h) - F.col("_mh")) * (F.col(size) - F.col("_ms"))) / (F.avg(size) * C.K_B_EV * F.pow(F.first(temperature), F.lit(2.0)))).alias(f"cte_{size}"))


def expansion_fit(df: DataFrame, by: list[str], temperature: str, size: str) -> DataFrame:
    """by, cte, r2: slope of size over temperature, relative to the size at the lowest temperature."""
    return df.groupBy(*by).agg((F.regr_slope(F.col(size), F.col(temperature)) / F.min_by(size, temperature)).alias("cte"), F.regr_r2(F.col(size), F.col(temperature)).alias("r2"))


def uncertain(df: DataFrame, by: list[str], values: list[str], criterion: float, volume: str) -> DataFrame:
    """by, mean_ and sem_ of each value, converged: all errors below the criterion (the volume's below sqrt 3 times it)."""
    aggs, ok = [], F.count("*") > 1
    for v in values:
        sem = F.stddev_samp(v) / F.sqrt(F.count(v))
        aggs += [F.avg(v).alias(f"mean_{v}"), sem.alias(f"sem_{v}")]
        ok = ok & (sem < criterion * (math.sqrt(3) if v == volume else 1))
    return df.groupBy(*by).agg(*aggs, ok.alias("converged"))


def run_means(thermo: DataFrame, columns: list[str]) -> DataFrame:
    """One row a run: means of the columns and the last step."""
    return thermo.groupBy("run_id").agg(*(F.avg(c).alias(c) for c in columns), F.max("step").alias("steps"))


def fluctuation_inputs(df: DataFrame) -> DataFrame:
    """Clamped settings of a fluctuation run: production_steps, min_runs, max_runs, n_dump, window (rows of 10 ps)."""
    steps = F.greatest(F.col("production_steps"), F.ceil(F.lit(20_000.0) / F.col("timestep")))
    low = F.greatest(F.col("min_runs"), F.lit(2))
    return df.withColumns({"production_steps": steps.cast("bigint"), "min_runs": low, "max_runs": F.greatest(F.col("max_runs"), low), "n_dump": F.least(F.col("n_dump"), steps).cast("bigint"), "window": F.floor(F.lit(10_000.0) / (F.col("n_log") * F.col("timestep")))})


def near_target(df: DataFrame, by: list[str], value: str, target: Column, slack: float) -> DataFrame:
    """by, mean, near: whether the mean is within slack and 2 % of its target."""
    m = F.avg(value)
    return df.groupBy(*by).agg(m.alias("mean"), (F.abs(F.first(target) - m) <= slack + 0.02 * F.abs(F.first(target))).alias("near"))


# --- viscosity ------------------------------------------------------------------------------------------

SHEARS = ("pxy", "pxz", "pyz")


def first_run_below(y: np.ndarray, epsilon: float, consecutive: int = 3) -> int:
    low = np.abs(y) < epsilon * np.abs(y).max()
    for i in range(len(y) - consecutive + 1):
        if low[i : i + consecutive].all():
            return i
    return int(np.argmax(low)) if low.any() else len(y) - 1


def divisor_near(n: int, x: int) -> int | None:
    low = [d for d in range(1, math.isqrt(max(n, 0)) + 1) if n % d == 0]
    return min((*low, *(n // d for d in low)), key=lambda d: (abs(d - x), d), default=None)


CUTOFF_METHODS = ("noise_threshold", "cumulative_integral", "self_consistent")


def cutoff_lag(y: np.ndarray, method: str, epsilon: float = 1e-4, dt: float = 1.0, c: float = 5.0) -> int:
    """The lag at which a normalised autocorrelation has decayed, by one of CUTOFF_METHODS; the last lag if it never does."""
    end = len(y) - 1
    area = np.cumsum((y[1:] + y[:-1]) / 2) * dt
    if method == "noise_threshold":
        return first_run_below(y, epsilon)
    if method == "cumulative_integral":
        if not len(area) or np.isclose(area[-1], 0.0):
            return end
        share = np.append(0.0, area / area[-1])
        reach, still = np.flatnonzero(share >= 1 - epsilon), np.flatnonzero(np.abs(np.diff(share)) < epsilon)
        return min(end, int(reach[0]) + 1 if len(reach) else int(still[0]) + 2 if len(still) else end)
    if method == "self_consistent":
        before = np.append(0.0, area)[:-1]
        hit = np.flatnonzero((before > 0) & (before < np.arange(1, len(y)) * dt / c))
        return int(hit[0]) + 1 if len(hit) else end
    raise ValueError(f"not one of {CUTOFF_METHODS}: {method}")


def green_kubo_curves(p: np.ndarray, dt_fs: float, volume_a3: float, temperature: float, max_lag: int = 1_000_000, epsilon: float = 1e-4, method: str = "noise_threshold") -> dict | None:
    """From shear stresses (rows, 3) in GPa: viscosity (Pa s), window (ps), tau (the longest decay time, ps), and over the lags
    sacf (mean normalised autocorrelation) and integral (running viscosity). None for runs too short for a window.
    """
    n, dt_ps = len(p), dt_fs / 1000
    first = [y / y[0] for y in (autocorrelation(p[:, k], max_lag) for k in range(p.shape[1])) if y[0] != 0]
    taus = [max(10.0, cutoff_lag(y, method, epsilon, dt_ps) * dt_ps) for y in first]
    windows = [divisor_near(int(n * dt_ps), int(t)) for t in taus]
    if not windows or None in windows:
        return None
    window = 2 * max(windows)
    lag = max(2, min(n, int(window / dt_ps)))
    scale = volume_a3 * 1e-30 / (C.K_B_J * temperature) * 1e18 * dt_fs * 1e-15
    last = [autocorrelation(p[:, k], lag) for k in range(p.shape[1])]
    total = np.mean([np.concatenate([[0], np.cumsum((y[1:] + y[:-1]) / 2)]) for y in last], axis=0) * scale
    sacf = np.mean([y / y[0] for y in last if y[0] != 0], axis=0)
    return {"viscosity": float(total[-1]), "window": window, "tau": float(max(taus)), "sacf": sacf, "integral": total}


def green_kubo(p: np.ndarray, dt_fs: float, volume_a3: float, temperature: float, max_lag: int = 1_000_000, epsilon: float = 1e-4) -> tuple[float, int] | None:
    """Viscosity in Pa s and the lag it was integrated to; None for too short runs."""
    got = green_kubo_curves(p, dt_fs, volume_a3, temperature, max_lag, epsilon)
    return None if got is None else (got["viscosity"], len(got["integral"]))


def helfand(p: np.ndarray, dt_fs: float, volume_a3: float, temperature: float, max_lag: int | None = None) -> dict:
    """Viscosity from the slope of the mean square displacement of the integrated stresses, and the residual of that fit as a
    viscosity; also shear modulus, Maxwell time, the displacements (msd) over the lags from 1 on, and their slope."""
    n = len(p)
    lags = min(max_lag or n // 2, n - 1)
    dt = dt_fs * 1e-15
    chi = np.cumsum(p * 1e9, axis=0) * dt
    msd = np.mean([2 * (c[0] - c[1:]) for c in (autocorrelation(chi[:, k], lags + 1) for k in range(p.shape[1]))], axis=0)
    c = np.mean([autocorrelation(p[:, k], lags + 1) for k in range(p.shape[1])], axis=0)
    below = np.flatnonzero(c < c[0] / 2)
    tau = int(below[0]) if len(below) else lags
    start = min(5 * tau, max(1, lags // 2))
    t = np.arange(1, lags + 1) * dt
    slope, base = np.polyfit(t[start:], msd[start:], 1) if lags - start >= 2 else (float("nan"), float("nan"))
    rest = float(np.std(msd[start:] - slope * t[start:] - base))
    v = volume_a3 * 1e-30
    eta = slope * v / (2 * C.K_B_J * temperature)
    g = v / (C.K_B_J * temperature) * float(np.mean(np.var(p * 1e9, axis=0)))
    return {"viscosity": float(eta), "fit_residual": rest * v / (2 * C.K_B_J * temperature), "shear_modulus": g, "maxwell_time": float(eta / g) if g else float("nan"), "msd": msd, "slope": float(slope)}


def bulk_viscosity(p: np.ndarray, dt_fs: float, volume_a3: float, temperature: float, max_lag: int | None = None) -> float:
    """In Pa s from normal stresses (rows, 3) in GPa: the integrated autocorrelation of their trace about its mean."""
    trace = p.sum(axis=1) * 1e9
    y = autocorrelation(trace - trace.mean(), max_lag or len(p) // 2)
    return float(np.trapezoid(y, dx=dt_fs * 1e-15)) * volume_a3 * 1e-30 / (9 * C.K_B_J * temperature)


#: What viscosity() gives for a run; what the method doesn't have is null.
VISCOSITY = """run_id string, temperature double, viscosity double, window double, tau double, shear_modulus double, maxwell_time double, bulk_viscosity double,
mean_pressure double, fit_residual double, slope double, lag_time array<double>, sacf array<double>, integral array<double>, msd array<double>"""


def viscosity(thermo: DataFrame, dt_fs: float, method: str = "green_kubo", max_lag: int | None = None, cutoff: str = "noise_threshold") -> DataFrame:
    """One row a run (columns: VISCOSITY), in Pa s, ps and GPa; thermo: run_id, step, temperature, volume and stresses in GPa.

    green_kubo gives window, tau, and over lag_time sacf and the running integral; helfand the modulus, Maxwell time,
    fit_residual, slope and over lag_time msd. bulk_viscosity and mean_pressure come with helfand, null where thermo lacks
    pxx, pyy or pzz. A task reads its runs one after another, however many they are, and holds one.
    """
    if method not in ("green_kubo", "helfand"):
        raise ValueError(f"unknown method: {method}")
    if cutoff not in CUTOFF_METHODS:
        raise ValueError(f"unknown cutoff method: {cutoff}")
    normals = [c for c in ("pxx", "pyy", "pzz") if c in thermo.columns]
    names = [c.split()[0] for c in VISCOSITY.split(",")]

    def run(pdf: pd.DataFrame) -> dict:
        p, v, t = pdf[list(SHEARS)].to_numpy(float), float(pdf["volume"].mean()), float(pdf["temperature"].mean())
        row = dict.fromkeys(names) | {"run_id": pdf["run_id"].iloc[0], "temperature": t}
        if method == "helfand" and len(p) > 3:
            row |= helfand(p, dt_fs, v, t, max_lag)
            row["lag_time"] = np.arange(1, len(row["msd"]) + 1) * dt_fs / 1000
            if len(normals) == 3:
                row["bulk_viscosity"] = bulk_viscosity(pdf[normals].to_numpy(float), dt_fs, v, t, max_lag)
                row["mean_pressure"] = float(pdf[normals].to_numpy(float).mean())
        elif method == "green_kubo" and (got := green_kubo_curves(p, dt_fs, v, t, max_lag or 1_000_000, method=cutoff)) is not None:
            row |= got | {"lag_time": np.arange(len(got["integral"])) * dt_fs / 1000}
        return row

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left: list[pd.DataFrame] = []  # of a run whose rows may go on in the next batch
        for b in batches:
            if not len(b):
                continue
            ids = b["run_id"].to_numpy()
            ends = [*(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(b)]
            rows, lo = [], 0
            if left and left[-1]["run_id"].iloc[0] != ids[0]:
                rows, left = [run(pd.concat(left))], []
            for hi in ends[:-1]:
                rows.append(run(pd.concat([*left, b.iloc[lo:hi]]) if left else b.iloc[lo:hi]))
                left, lo = [], hi
            left.append(b.iloc[lo:])
            if rows:
                yield pd.DataFrame(rows, columns=names)
        if left:
            yield pd.DataFrame([run(pd.concat(left))], columns=names)

    df = thermo.select("run_id", "step", "temperature", "volume", *SHEARS, *normals)
    return df.repartition("run_id").sortWithinPartitions("run_id", "step").mapInPandas(runs, VISCOSITY)


def ensemble(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, n, mean, std, sem over replicas; a single one has 0 spread."""
    sd = F.coalesce(F.stddev_samp(value), F.lit(0.0))
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), sd.alias("std"), (sd / F.sqrt(F.count(value))).alias("sem"))


def vft(t: Column, a: Column, b: Column, t0: Column, natural: bool = True) -> Column:
    """log10 of viscosity: a + b / (t - t0), b being natural (times log10 e) or decimal."""
    return a + b / (t - t0) * (math.log10(math.e) if natural else 1.0)


def vft_inverse(log_eta: Column, a: Column, b: Column, t0: Column) -> Column:
    """Temperature at which the decimal law gives log_eta; null where there is none above t0."""
    return F.when((log_eta - a > 0) & (b > 0), t0 + b / (log_eta - a))


def vft_curve(fits: DataFrame, t_min: float, t_max: float, n: int = 200) -> DataFrame:
    """fits (id, a, b, t0) with t and log_eta over n temperatures, those above t0 + 1."""
    step = (t_max - t_min) / (n - 1)
    df = fits.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("t", F.lit(t_min) + F.col("k") * step)
    return df.where("t > t0 + 1").withColumn("log_eta", vft(F.col("t"), F.col("a"), F.col("b"), F.col("t0"), natural=False))


def levenberg(f: Callable[[np.ndarray], np.ndarray], p: np.ndarray, lower: np.ndarray, upper: np.ndarray, steps: int = 2000) -> tuple[np.ndarray, np.ndarray]:
    """Least squares by damped Gauss-Newton steps with numeric derivatives and clamping; parameters and covariance."""
    p, damp = np.clip(p.astype(float), lower, upper), 1e-3
    r = f(p)
    jac = np.zeros((len(r), len(p)))
    for _ in range(steps):
        for k in range(len(p)):
            h = 1e-6 * max(1.0, abs(p[k]))
            up, down = p.copy(), p.copy()
            up[k] += h
            down[k] -= h
            jac[:, k] = (f(up) - f(down)) / (2 * h)
        a, g = jac.T @ jac, jac.T @ r
        moved = False
        for _ in range(30):
            try:
                new = np.clip(p - np.linalg.solve(a + damp * np.diag(np.diag(a) + 1e-12), g), lower, upper)
            except np.linalg.LinAlgError:
                damp *= 10
                continue
            rn = f(new)
            if np.isfinite(rn).all() and rn @ rn < r @ r:
                gain, moved = (r @ r - rn @ rn) / max(r @ r, 1e-300), True
                p, r, damp = new, rn, max(damp / 5, 1e-12)
                break
            damp *= 4
        if not moved or gain < 1e-14:
            break
    cov = np.linalg.pinv(jac.T @ jac) * (r @ r) / max(1, len(r) - len(p))
    return p, cov


def fit_vft(df: DataFrame, by: list[str], t: str, log_eta: str, natural: bool = False) -> DataFrame:
    """by, a, b, t0, rmse of log_eta over t, and the covariance of (a, b, t0); null for fewer than 3 points. One group is one curve."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*by).schema) + ", a double, b double, t0 double, rmse double, covariance array<array<double>>"
    unit = math.log10(math.e) if natural else 1.0

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf[t].to_numpy(float), pdf[log_eta].to_numpy(float)
        row = {c: pdf[c].iloc[0] for c in by} | {"a": None, "b": None, "t0": None, "rmse": None, "covariance": None}
        if len(x) >= 3:
            start = np.array([-3.0, 1000.0, 200.0]) if natural else np.array([y.min() - 1, max((y.max() - y.min()) * 300.0, 1.0), max(x.min() - 300.0, 0.0)])
            top = np.array([np.inf, np.inf, x.min() - 1])
            p, cov = levenberg(lambda q: q[0] + q[1] / (x - q[2]) * unit - y, start, np.array([-np.inf, 0.0, 0.0]), top)
            row |= {"a": p[0], "b": p[1], "t0": p[2], "rmse": float(np.sqrt(np.mean((p[0] + p[1] / (x - p[2]) * unit - y) ** 2))), "covariance": cov.tolist()}
        return pd.DataFrame([row])

    return df.select(*by, t, log_eta).groupBy(*by).applyInPandas(run, schema)


# --- elasticity ----------------------------------------------------------------------------------------


def stiffness(stress: DataFrame, strain: float) -> DataFrame:
    """id, i, j, c from stored stresses (id, direction j, sign, step, s1..s6): mean over the second half of each run,
    plus minus minus over twice the strain; only the upper 3 x 3 and the shear diagonal."""
    w = W.partitionBy("id", "j", "sign")
    half = stress.withColumns({"_k": F.row_number().over(w.orderBy("step")) - 1, "_n": F.count(F.lit(1)).over(w)}).where(F.col("_k") >= F.floor(F.col("_n") / 2))
    mean = half.groupBy("id", "j").agg(*(((F.avg(F.when(F.col("sign") > 0, F.col(f"s{i}"))) - F.avg(F.when(F.col("sign") < 0, F.col(f"s{i}")))) / (2 * strain)).alias(f"s{i}") for i in range(1, 7)))
    long = mean.select("id", "j", F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.col(f"s{i}").alias("c")) for i in range(1, 7)))).alias("e"))
    return long.select("id", F.col("e.i").alias("i"), "j", F.col("e.c").alias("c")).where("(i <= 3 and j <= 3) or i = j")


def moduli(cij: DataFrame) -> DataFrame:
    """id, bulk, shear, young, poisson of an isotropic average of (id, i, j, c): Voigt-Reuss-Hill on C11, C12, C44."""
    avg = lambda cond: F.avg(F.when(cond, F.col("c")))
    i, j = F.col("i"), F.col("j")
    a = cij.groupBy("id").agg(avg((i == j) & (i <= 3)).alias("c11"), avg((i != j) & (i <= 3) & (j <= 3)).alias("c12"), avg((i == j) & (i > 3)).alias("c44"))
    gv = (F.col("c11") - F.col("c12") + 3 * F.col("c44")) / 5
    gr = 5 * F.col("c44") * (F.col("c11") - F.col("c12")) / (4 * F.col("c44") + 3 * (F.col("c11") - F.col("c12")))
    a = a.withColumns({"shear": (gv + gr) / 2, "bulk": (F.col("c11") + 2 * F.col("c12")) / 3})
    b, g = F.col("bulk"), F.col("shear")
    return a.select("id", "bulk", "shear", (9 * b * g / (3 * b + g)).alias("young"), ((3 * b - 2 * g) / (2 * (3 * b + g))).alias("poisson"))


def strained(atoms: DataFrame, frames: DataFrame, eps: list[list[float]]) -> tuple[DataFrame, DataFrame]:
    """Atoms and cells under cell * (1 + eps): positions scale with the cell."""
    from ..functions import geometry as G
    from ..schemas import CELL, KEY

    m = [[eps[r][s] + (r == s) for s in range(3)] for r in range(3)]
    new = {f"c{r}{s}": sum((F.col(f"c{r}{k}") * m[k][s] for k in range(3)), F.lit(0.0)) for r in range(3) for s in range(3)}
    cells = frames.select(*[c for c in frames.columns if c not in CELL], *(v.alias(k) for k, v in new.items()))
    df = atoms.join(frames.select(*KEY, *CELL, *(v.alias(k) for k, v in G.inverse().items())), KEY)
    f = G.fractional(F.col("x"), F.col("y"), F.col("z"))
    df = df.withColumns({f"_f{k}": G.wrapped(f[k]) for k in range(3)})
    pos = [sum((F.col(f"_f{k}") * new[f"c{k}{s}"] for k in range(3)), F.lit(0.0)) for s in range(3)]
    return df.withColumns(dict(zip("xyz", pos, strict=True))).select(*atoms.columns), cells


def protocol(schedules: DataFrame, stages: DataFrame) -> DataFrame:
    """id, potential, stage, t_from, t_to, steps, first_step, p_from, p_to of melt-quench programs.

    schedules: id, potential, t_high, t_low, heating_rate, cooling_rate (K/s), timestep (fs), equilibration_steps (or null).
    """
    df = schedules.join(F.broadcast(stages.withColumnsRenamed({"t_from": "_a", "t_to": "_b", "steps": "_n"})), "potential")
    ramp = lambda rate: F.floor((F.col("t_high") - F.col("t_low")) / (F.col("timestep") * rate) * 1e15)
    hold = F.coalesce("equilibration_steps", F.when(F.col("in_fs"), F.floor(F.col("_n") / F.col("timestep"))).otherwise(F.col("_n")))
    steps = F.when(F.col("kind") == "heating", ramp(F.col("heating_rate"))).when(F.col("kind") == "cooling", ramp(F.col("cooling_rate"))).otherwise(hold).cast("bigint")
    at = lambda c: F.when(F.col(c) == "high", F.col("t_high")).otherwise(F.col("t_low"))
    df = df.withColumn("steps", steps)
    before = F.sum("steps").over(W.partitionBy("id").orderBy("stage").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("steps")
    return df.select("id", "potential", "stage", at("_a").alias("t_from"), at("_b").alias("t_to"), "steps", before.alias("first_step"), "p_from", "p_to")


def scan_inputs(df: DataFrame, by: list[str]) -> DataFrame:
    """by, n_temperatures, repeated, status of temperature scans (rows of temperature): 'ok', or 'too few' below two
    different temperatures."""
    n = F.count_distinct("temperature")
    return df.groupBy(*by).agg(n.alias("n_temperatures"), (F.count("temperature") > n).alias("repeated"), F.when(n >= 2, "ok").otherwise("too few").alias("status"))


def temperature_program(stages: DataFrame) -> DataFrame:
    """id, step, temperature: the corners of each schedule's temperature curve, from protocol()'s rows."""
    ends = F.array(F.struct(F.col("first_step").alias("step"), F.col("t_from").alias("t")), F.struct((F.col("first_step") + F.col("steps")).alias("step"), F.col("t_to").alias("t")))
    return stages.select("id", "stage", F.explode(ends).alias("e")).select("id", F.col("e.step").alias("step"), F.col("e.t").alias("temperature")).distinct()


def total_steps(stages: DataFrame) -> DataFrame:
    return stages.groupBy("id").agg(F.sum("steps").alias("steps"))


#: log10 of the viscosity in dPa s at named temperatures (fixed values).
REFERENCE = {"t4": 4.0, "t7_6": 7.6}


def reference_temperatures(fits: DataFrame) -> DataFrame:
    """fits (a, b, t0 of decimal laws in dPa s) with the reference temperatures in degrees Celsius, one decimal."""
    return fits.withColumns({k: F.round(vft_inverse(F.lit(v), F.col("a"), F.col("b"), F.col("t0")) - 273.15, 1) for k, v in REFERENCE.items()})
