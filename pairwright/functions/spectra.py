"""Column builders for spectra (arrays of doubles): similarities and fixed-length features.

Everything is higher-order functions inside the JVM except the density-based similarity, which
needs a vectorised UDF. Arguments that are used inside a lambda must be plain columns, or their
expression is evaluated again for every element; `pair_scores` takes care of that.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

HEAT_TIMES = (0.1, 0.5, 1.0, 2.0, 5.0, 10.0)
EPSILON = 1e-12


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def _square_from(center: str):
    return lambda x: (x - F.col(center)) * (x - F.col(center))


def _decay(t: float):
    return lambda x: F.exp(-x * t)


def mean(a: Column) -> Column:
    return total(a) / F.size(a)


def dot(a: Column, b: Column) -> Column:
    """Sum of products; the shorter array is padded with zeros."""
    return total(F.zip_with(a, b, lambda x, y: F.coalesce(x * y, F.lit(0.0))))


def norm(a: Column) -> Column:
    return F.sqrt(total(F.transform(a, lambda x: x * x)))


def finite(a: Column) -> Column:
    return F.filter(a, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))


def strip_zeros(a: Column, digits: int | None = None) -> Column:
    """a without its trailing zeros (after rounding to `digits`, if given)."""
    live = F.transform(a, lambda x, i: F.when((F.round(x, digits) if digits is not None else x) != 0, i + 1))
    return F.slice(a, F.lit(1), F.coalesce(F.array_max(live), F.lit(0)))


def prefix(a: Column, k: int | None) -> Column:
    return F.slice(a, 1, k) if k else a


def resample(a: Column, n: Column) -> Column:
    """Linear interpolation of a at n evenly spaced places."""
    def at(i):
        t = i * (F.size(a) - 1) / (n - 1)
        j = F.floor(t).cast("int")
        here = F.get(a, j)
        return here + (F.coalesce(F.get(a, j + 1), here) - here) * (t - j)

    return F.when(F.size(a) == n, a).otherwise(F.transform(F.sequence(F.lit(0), (n - 1).cast("int")), at))


def _clip(s: Column) -> Column:
    return F.least(F.greatest(s, F.lit(0.0)), F.lit(1.0))


def with_pss(df: DataFrame, a: str, b: str, out: str, gamma: float = 0.1, power: float = 1.0) -> DataFrame:
    """Interpolated-spectrum similarity."""
    if gamma <= 0 or power <= 0:
        raise ValueError("gamma and power must be positive")
    keep = df.columns
    df = df.withColumn("_a", strip_zeros(F.col(a))).withColumn("_b", strip_zeros(F.col(b)))
    df = df.withColumn("_n", F.greatest(F.size("_a"), F.size("_b")))
    df = df.withColumn("_a", resample(F.col("_a"), F.col("_n"))).withColumn("_b", resample(F.col("_b"), F.col("_n")))
    df = df.withColumn("_na", norm(F.col("_a"))).withColumn("_nb", norm(F.col("_b")))
    unit = lambda v, n: v / F.when(n == 0, 1.0).otherwise(n)
    d = F.sqrt(total(F.transform(F.zip_with("_a", "_b", lambda x, y: unit(x, F.col("_na")) - unit(y, F.col("_nb"))), lambda x: x * x)))
    s = F.when((F.col("_na") == 0) | (F.col("_nb") == 0) | (F.size(strip_zeros(F.col(a))) == 0) | (F.size(strip_zeros(F.col(b))) == 0), 0.0).otherwise(_clip(F.exp(-F.pow(d / gamma, F.lit(power)))))
    return df.withColumn("_s", s).select(*keep, F.col("_s").alias(out))


def with_wasserstein(df: DataFrame, a: str, b: str, out: str, gamma: float = 0.1) -> DataFrame:
    """Exponential of the first Wasserstein distance of two samples of any sizes."""
    keep = df.columns
    df = df.withColumn("_a", F.sort_array(finite(F.col(a)))).withColumn("_b", F.sort_array(finite(F.col(b))))
    # one sweep over the merged values; each moves one distribution function by a step
    step = lambda c, s: F.transform(c, lambda x: F.struct(x.alias("x"), (s / F.size(c)).alias("w")))
    df = df.withColumn("_m", F.sort_array(F.concat(step(F.col("_a"), F.lit(1.0)), step(F.col("_b"), F.lit(-1.0)))))
    start = F.struct(F.lit(0.0).alias("d"), F.lit(0.0).alias("f"), F.lit(None).cast("double").alias("x"))
    area = F.aggregate("_m", start, lambda s, e: F.struct((s["d"] + F.abs(s["f"]) * (e["x"] - F.coalesce(s["x"], e["x"]))).alias("d"), (s["f"] + e["w"]).alias("f"), e["x"].alias("x")))["d"]
    s = F.when((F.size("_a") == 0) | (F.size("_b") == 0), 0.0).otherwise(_clip(F.exp(-area / gamma)))
    return df.withColumn("_s", s).select(*keep, F.col("_s").alias(out))


def with_fisher(df: DataFrame, a: str, b: str, out: str, gamma: float = 1.0, epsilon: float = EPSILON) -> DataFrame:
    """Information distance of two spectra taken as normal distributions."""
    keep = df.columns
    for k, c in (("_a", a), ("_b", b)):
        df = df.withColumn(k, finite(F.col(c))).withColumn(k + "m", mean(F.col(k)))
        df = df.withColumn(k + "v", F.greatest(mean(F.transform(k, _square_from(k + "m"))), F.lit(epsilon)))
    gap = F.col("_am") - F.col("_bm")
    ratio = (F.col("_av") + F.col("_bv") + gap * gap) / (2.0 * F.sqrt("_av") * F.sqrt("_bv"))
    s = _clip(F.exp(-gamma * F.sqrt(2.0 * F.log(F.greatest(ratio, F.lit(1.0))))))
    return df.withColumn("_s", F.when((F.size("_a") == 0) | (F.size("_b") == 0), 0.0).otherwise(s)).select(*keep, F.col("_s").alias(out))


def heat_signature(a: Column, times=HEAT_TIMES, epsilon: float = EPSILON) -> Column:
    return F.array(*[F.log(F.greatest(mean(F.transform(a, _decay(t))), F.lit(epsilon))) for t in times])


def with_heat_kernel(df: DataFrame, a: str, b: str, out: str, gamma: float = 1.0, times=HEAT_TIMES) -> DataFrame:
    """Distance of log heat traces; values that are not finite are not removed."""
    keep = df.columns
    df = df.withColumn("_a", heat_signature(F.col(a), times)).withColumn("_b", heat_signature(F.col(b), times))
    d = norm(F.zip_with("_a", "_b", lambda x, y: x - y))
    s = F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(_clip(F.exp(-gamma * d)))
    return df.withColumn("_s", s).select(*keep, F.col("_s").alias(out))


def with_cosine(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """Cosine with zero padding on the right; a zero norm is left as it is; not clipped."""
    safe = lambda c: F.when(norm(F.col(c)) > 0, norm(F.col(c))).otherwise(1.0)
    s = dot(F.col(a), F.col(b)) / (safe(a) * safe(b))
    return df.withColumn(out, F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(s))


def with_topk_largest(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """1 / (1 + distance) of the largest values, as many as the shorter stripped spectrum has."""
    keep = df.columns
    for k, c in (("_a", a), ("_b", b)):
        df = df.withColumn(k, strip_zeros(F.col(c), 10))
        df = df.withColumn(k, F.sort_array(F.when(F.size(k) == 0, F.array(F.lit(0.0))).otherwise(F.col(k))))
    df = df.withColumn("_k", F.least(F.size("_a"), F.size("_b")))
    top = lambda k: F.slice(k, F.size(k) - F.col("_k") + 1, F.col("_k"))
    s = 1.0 / (1.0 + norm(F.zip_with(top("_a"), top("_b"), lambda x, y: x - y)))
    s = F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(s)
    return df.withColumn("_s", s).select(*keep, F.col("_s").alias(out))


def density(values: np.ndarray, grid: np.ndarray) -> np.ndarray:
    """Probabilities on a grid: Gaussian kernels of Scott's width, or one narrow bell."""
    n = len(values)
    spread = values.std(ddof=1) if n > 1 else 0.0
    if n > 1 and spread > 0:
        width = spread * n ** (-0.2)
        p = np.exp(-0.5 * ((grid[:, None] - values) / width) ** 2).mean(1) / (width * np.sqrt(2 * np.pi))
    else:
        width = max((grid[-1] - grid[0]) / len(grid), EPSILON)
        p = np.exp(-0.5 * ((grid - values.mean()) / width) ** 2)
    p = np.maximum(p, 0) + EPSILON
    return p / p.sum()


def jensen_shannon(a, b, points: int = 512) -> float:
    a, b = (np.asarray([] if v is None else v, float) for v in (a, b))
    a, b = a[np.isfinite(a)], b[np.isfinite(b)]
    if not len(a) or not len(b):
        return 0.0
    low, high = min(a.min(), b.min()), max(a.max(), b.max())
    pad = 0.05 * (high - low) if low < high else max(abs(low) * 0.1, 1.0)
    grid = np.linspace(low - pad, high + pad, points)
    p, q = density(a, grid), density(b, grid)
    m = (p + q) / 2
    return float(np.clip(1 - ((p * np.log2(p / m)).sum() + (q * np.log2(q / m)).sum()) / 2, 0, 1))


def with_jensen_shannon(df: DataFrame, a: str, b: str, out: str, points: int = 512) -> DataFrame:
    @F.pandas_udf(DoubleType())
    def score(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([jensen_shannon(u, v, points) for u, v in zip(x, y, strict=True)], dtype="float64")

    return df.withColumn(out, score(F.col(a), F.col(b)))


METRICS: dict[str, Callable[..., DataFrame]] = {
    "pss": with_pss,
    "wasserstein": with_wasserstein,
    "fisher": with_fisher,
    "heat_kernel": with_heat_kernel,
    "cosine": with_cosine,
    "topk_largest": with_topk_largest,
    "jensenshannon": with_jensen_shannon,
}


def pair_scores(df: DataFrame, metric: str, k: int | None = None, a: str = "ev1", b: str = "ev2", out: str = "score", **params) -> DataFrame:
    """Score pairs: a missing or empty spectrum gives 0, as does an unknown metric; the prefix of
    k values is taken before the metric."""
    keep = df.columns
    none = F.array().cast("array<double>")
    df = df.withColumn("_l", prefix(F.coalesce(F.col(a), none), k)).withColumn("_r", prefix(F.coalesce(F.col(b), none), k))
    if metric not in METRICS:
        return df.withColumn(out, F.lit(0.0)).select(*keep, out)
    return METRICS[metric](df, "_l", "_r", out, **params).select(*keep, out)


def quantile(a: Column, q: float) -> Column:
    """Linear quantile of an ascending array."""
    t = (F.size(a) - 1) * F.lit(float(q))
    j = F.floor(t).cast("int")
    here = F.get(a, j)
    return here + (F.coalesce(F.get(a, j + 1), here) - here) * (t - j)


def eigen_stats(a: Column) -> Column:
    """min(n/2000, 10), mean, deviation, min, max and quartiles of an ascending spectrum."""
    m = mean(a)
    dev = F.sqrt(F.greatest(mean(F.transform(a, lambda x: x * x)) - m * m, F.lit(0.0)))
    return F.array(F.least(F.size(a) / 2000.0, F.lit(10.0)), m, dev, F.array_min(a), F.array_max(a), quantile(a, 0.25), quantile(a, 0.5), quantile(a, 0.75))


def graph_stats(nodes: Column, edges: Column) -> Column:
    """log1p(n)/10, log1p(e)/10 and the density, at most 1."""
    room = F.greatest(F.lit(1.0), nodes * (nodes - 1.0))
    return F.array(F.log1p(nodes.cast("double")) / 10, F.log1p(edges.cast("double")) / 10, F.least(F.lit(1.0), edges / room))


def padded(a: Column, k: int) -> Column:
    """First k values of the sorted array, zeros after them."""
    return F.slice(F.concat(F.sort_array(a), F.array_repeat(F.lit(0.0), k)), 1, k)


def pair_features(a: Column, b: Column) -> Column:
    """Absolute differences, products, cosine and distance: 2D + 2 values."""
    d = F.zip_with(a, b, lambda x, y: F.abs(x - y))
    p = F.zip_with(a, b, lambda x, y: x * y)
    cos = total(p) / (norm(a) * norm(b) + 1e-8)
    return F.concat(d, p, F.array(cos, norm(d)))


def with_diagnostics(df: DataFrame, a: str, out: str, bins: int = 32, sigma: float = 0.07, top: float = 2.0) -> DataFrame:
    """A smoothed density on a fixed grid (sums to 1) and 24 heat traces from 0.01 to 100."""
    places, times = np.linspace(0.0, top, bins), np.logspace(-2, 2, 24)

    @F.pandas_udf(ArrayType(DoubleType()))
    def run(spectra: pd.Series) -> pd.Series:
        rows = []
        for ev in spectra:
            if ev is None or not len(ev):
                rows.append(None if ev is None else [0.0] * bins + [None] * len(times))
                continue
            raw = np.exp(-0.5 * ((ev - places[:, None]) / sigma) ** 2).sum(1)
            rows.append(np.concatenate([raw / max(raw.sum(), EPSILON), np.exp(-ev * times[:, None]).mean(1)]))
        return pd.Series(rows, dtype=object)

    return df.withColumn(out, run(F.col(a)))


def register(spark) -> None:
    """Make the density-based similarity callable from SQL."""
    spark.udf.register("jensenshannon_similarity", F.pandas_udf(lambda x, y: pd.Series([jensen_shannon(u, v) for u, v in zip(x, y, strict=True)], dtype="float64"), DoubleType()))
