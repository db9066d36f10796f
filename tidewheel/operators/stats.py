"""Statistics as single aggregates; only matrices the size of the column list are solved on the driver."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewheel.plans.scratch import materialize, release


def skewness(x: str) -> Column:
    """Bias-adjusted sample skewness."""
    n = F.count(x).cast("double")
    return F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))


def quantiles(panel: DataFrame, columns: Sequence[str], at: Sequence[float]) -> dict[str, list[float | None]]:
    """For each column its exact quantiles at the shares `at`, interpolated as `percentile` does; None where a column has no value.

    Equal values are counted where they lie, and the distinct ones dealt by range. Counts by part tell which parts hold the wanted places, and only those are put in order, so that no buffer holds all the values of a column; the driver sees a row a part and a column."""
    cells = [F.struct(F.lit(i).alias("c"), F.col(f"`{c}`").cast("double").alias("v")) for i, c in enumerate(columns)]
    if not cells:
        return {}
    counted = panel.select(F.inline(F.array(*cells))).where("v is not null").groupBy("c", "v").agg(F.count("*").alias("n"))
    dealt = materialize(counted.repartitionByRange("c", "v").withColumn("part", F.spark_partition_id()), "quantiles")
    parts: dict[int, list[tuple[int, int]]] = {}
    for r in dealt.groupBy("c", "part").agg(F.sum("n").alias("n")).orderBy("c", "part").collect():
        parts.setdefault(r["c"], []).append((r["part"], r["n"]))

    def place(c: int, k: int) -> tuple[int, int, int]:
        """Column, part and place within the part of a column's k-th value."""
        for part, n in parts[c]:
            if k < n:
                return c, part, k
            k -= n
        raise IndexError(k)

    ends = {(c, p): (x := p * (sum(n for _, n in own) - 1), place(c, math.floor(x)), place(c, math.ceil(x))) for c, own in parts.items() for p in at}
    wanted = sorted({w for _, *both in ends.values() for w in both})
    found: dict[tuple[int, int, int], float] = {}
    if wanted:
        places = F.broadcast(panel.sparkSession.createDataFrame(wanted, "c int, part int, k long"))  # two a column and share
        run = F.sum("n").over(W.partitionBy("c", "part").orderBy("v").rowsBetween(W.unboundedPreceding, 0))
        own = dealt.join(F.broadcast(places.select("c", "part").distinct()), ["c", "part"]).withColumn("upto", run)
        hits = own.join(places, ["c", "part"]).where("k < upto and k >= upto - n")
        found = {(r["c"], r["part"], r["k"]): r["v"] for r in hits.select("c", "part", "k", "v").collect()}
    release(dealt)

    def value(c: int, p: float) -> float | None:
        if c not in parts:
            return None
        x, lo, hi = ends[c, p]
        return found[lo] if lo == hi or found[lo] == found[hi] else (math.ceil(x) - x) * found[lo] + (x - math.floor(x)) * found[hi]

    return {name: [value(i, p) for p in at] for i, name in enumerate(columns)}


def known(x: float | None) -> Column:
    return F.lit(x).cast("double")


def outliers(panel: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, min, median, p99, max, skewness and rows beyond three interquartile ranges."""
    q = quantiles(panel, columns, (0.25, 0.5, 0.75, 0.99))

    def far(c: str) -> Column:
        q1, _, q3, _ = (known(x) for x in q[c])
        return (F.col(c) < 4 * q1 - 3 * q3) | (F.col(c) > 4 * q3 - 3 * q1)

    parts = [
        F.struct(
            F.lit(c).alias("column"), F.min(c).alias("min"), known(q[c][1]).alias("median"), known(q[c][3]).alias("p99"), F.max(c).alias("max"),
            skewness(c).alias("skewness"), F.sum(F.when(far(c), 1).otherwise(0)).alias("n_far"),
        )
        for c in columns
    ]
    return panel.agg(*(p.alias(f"c{i}") for i, p in enumerate(parts))).select(F.inline(F.array(*(F.col(f"c{i}") for i in range(len(parts))))))


def describe(panel: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, count, mean, sd, min, quartiles and max, exact."""
    q = quantiles(panel, columns, (0.25, 0.5, 0.75))
    parts = [
        F.struct(F.lit(c).alias("column"), F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("sd"), F.min(c).alias("min"), *(known(x).alias(n) for x, n in zip(q[c], ("q1", "median", "q3"), strict=True)), F.max(c).alias("max"))
        for c in columns
    ]
    return panel.agg(*(p.alias(f"c{i}") for i, p in enumerate(parts))).select(F.inline(F.array(*(F.col(f"c{i}") for i in range(len(parts))))))


def moments_of(panel: DataFrame, sets: Sequence[Sequence[str]], at_once: int = 8) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """For each list of columns: rows that have them all, their means, and their cross-product matrix about the means. One aggregate gives rough centres, one more the sums of up to `at_once` lists about them."""
    columns = list(dict.fromkeys(c for s in sets for c in s))
    rough = panel.agg(*(F.avg(c).alias(f"m{i}") for i, c in enumerate(columns))).first()
    centre = {c: float(rough[f"m{i}"] or 0.0) for i, c in enumerate(columns)}
    out = []
    for lo in range(0, len(sets), at_once):
        cells = []
        for k, own in enumerate(sets[lo : lo + at_once]):
            whole = F.lit(True)
            for c in own:
                whole = whole & F.col(c).isNotNull()
            x = [F.when(whole, F.col(c) - centre[c]) for c in own]
            cells += [F.count(F.when(whole, 1)).alias(f"n{k}"), *(F.sum(v).alias(f"s{k}_{i}") for i, v in enumerate(x))]
            cells += [F.sum(x[i] * x[j]).alias(f"p{k}_{i}_{j}") for i in range(len(own)) for j in range(i, len(own))]
        got = panel.agg(*cells).first()
        for k, own in enumerate(sets[lo : lo + at_once]):
            n, size = got[f"n{k}"], len(own)
            if not n:
                out.append((0, np.zeros(size), np.zeros((size, size))))
                continue
            shift = np.array([got[f"s{k}_{i}"] for i in range(size)]) / n
            cross = np.zeros((size, size))
            for i in range(size):
                for j in range(i, size):
                    cross[i, j] = cross[j, i] = got[f"p{k}_{i}_{j}"] - n * shift[i] * shift[j]
            out.append((n, shift + np.array([centre[c] for c in own]), cross))
    return out


def moments(panel: DataFrame, columns: Sequence[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """moments_of() a single list."""
    return moments_of(panel, [columns])[0]


def partial_correlation(panel: DataFrame, x: str, y: str, controls: Sequence[str]) -> float | None:
    """Correlation of x and y with the controls held, from the inverse of the correlation matrix."""
    n, _, c = moments(panel, [x, y, *controls])
    scale = np.sqrt(np.diag(c))
    if n < 3 or not scale.all():
        return None
    p = np.linalg.inv(c / np.outer(scale, scale))
    return float(-p[0, 1] / np.sqrt(p[0, 0] * p[1, 1]))


def screening(panel: DataFrame, features: Sequence[str], target: str, controls: Sequence[str], useful: float = 0.05, least: int = 50) -> list[tuple]:
    """(feature, rows, correlation, partial correlation, useful) of each feature, the strongest first."""
    out = []
    for f, (n, _, c) in zip(features, moments_of(panel, [[f, target, *controls] for f in features]), strict=True):
        if n < least or c[0, 0] == 0:
            continue
        scale = np.sqrt(np.diag(c))
        r = c / np.outer(scale, scale)
        p = np.linalg.pinv(r)
        part = float(-p[0, 1] / np.sqrt(p[0, 0] * p[1, 1]))
        out.append((f, n, float(r[0, 1]), part, abs(part) >= useful))
    return sorted(out, key=lambda x: (-abs(x[3]), x[0]))


def pacf(lagged: DataFrame, value: str, lags: Sequence[str]) -> list[float]:
    """Partial autocorrelations by least squares: for p = 1, 2, ... the last coefficient of value on its first p lags."""
    out = []
    orders = range(1, len(lags) + 1)
    for p, (n, _, c) in zip(orders, moments_of(lagged, [[*lags[:p], value] for p in orders]), strict=True):
        if n <= p + 30:
            break
        out.append(float(np.linalg.solve(c[:p, :p], c[:p, p])[-1]))
    return out


def anomalies(series: DataFrame, value: str) -> DataFrame:
    """value less the mean of its calendar month, as `anom`."""
    return series.withColumn("anom", F.col(value) - F.avg(value).over(W.partitionBy(F.month("day"))))


def variance_shares(panel: DataFrame, value: str, groups: dict[str, Sequence[str]]) -> DataFrame:
    """For each named grouping the share of the variance of `value` between its groups: group means by aggregation, so no window over all rows."""
    own = panel.where(F.col(value).isNotNull())
    total = own.agg((F.var_pop(value) * F.count(value)).alias("ss"), F.avg(value).alias("m"))
    out = None
    for name, keys in groups.items():
        means = own.groupBy(*keys).agg(F.avg(value).alias("g"), F.count("*").alias("c")).crossJoin(F.broadcast(total))  # one row
        one = means.agg(F.lit(name).alias("grouping"), (F.sum(F.col("c") * F.pow(F.col("g") - F.col("m"), 2)) / F.max("ss")).alias("share"))
        out = one if out is None else out.unionByName(one)
    return out


def pairs(panel: DataFrame, value: str, level: str) -> DataFrame:
    """Differences of every two entities (a < b) on their common days."""
    a, b = (panel.select("day", F.col("city").alias(f"city_{x}"), F.col(value).alias(f"v{x}"), F.col(level).alias(f"l{x}")) for x in "ab")
    d = F.col("vb") - F.col("va")
    both = a.join(b, "day").where("city_a < city_b and va is not null and vb is not null")
    return both.groupBy("city_a", "city_b").agg(
        F.count("*").alias("n_days"), F.avg(d).alias("mean_d"), F.avg(F.abs(d)).alias("mean_abs_d"), F.percentile(F.abs(d), F.lit(0.95)).alias("p95_abs_d"), F.max(F.abs(d)).alias("max_abs_d"),
        F.avg((F.abs(d) >= 0.5).cast("double")).alias("share_ge_half"), F.avg((F.abs(d) >= 1.0).cast("double")).alias("share_ge_one"),
        F.avg((F.abs(d) <= 1e-9).cast("double")).alias("identical"), F.avg((F.col("la") != F.col("lb")).cast("double")).alias("level_differs"), F.corr("va", "vb").alias("corr"),
    )


def elevation_verdict(pair_rows: DataFrame, material: tuple[float, float] = (0.5, 0.02), modest: tuple[float, float] = (0.2, 0.005)) -> DataFrame:
    """verdict on what elevation does inside a cell, from pairs() rows of cities that share one, with their rise (b less a): the mean absolute difference, or the share of days whose levels differ, over its bound; untestable without pairs, or without a rise."""
    size, differs = F.avg("mean_abs_d"), F.avg("level_differs")
    over = lambda b: (size >= b[0]) | (differs >= b[1])
    verdict = F.when(F.count("*") == 0, "no shared cell").when(F.count_if(F.col("rise") != 0) == 0, "no rise").when(over(material), "material").when(over(modest), "modest").otherwise("negligible")
    return pair_rows.agg(verdict.alias("verdict"), size.alias("mean_abs_d"), differs.alias("level_differs"))


def effective_series(pair_corr: DataFrame, names: int) -> DataFrame:
    """Participation ratio of the correlation matrix: n^2 over the sum of squared entries, from correlations of distinct pairs (city_a < city_b)."""
    return pair_corr.agg((F.lit(float(names * names)) / (F.lit(float(names)) + 2 * F.sum(F.col("corr") * F.col("corr")))).alias("effective_series"), F.avg("corr").alias("mean_corr"), F.min("corr").alias("min_corr"))


def spectrum(pair_corr: DataFrame) -> tuple[float, int]:
    """Share of the first component, and how many explain 95 %; the matrix is as large as the list of entities."""
    rows = pair_corr.select("city_a", "city_b", "corr").toArrow()
    a, b = (np.asarray(rows[c].to_pylist(), dtype=object) for c in ("city_a", "city_b"))
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    m = np.eye(len(names))
    i, j = at[: len(a)], at[len(a) :]
    m[i, j] = m[j, i] = rows["corr"].to_numpy()
    lam = np.clip(np.sort(np.linalg.eigvalsh(m))[::-1], 0, None)
    share = lam / lam.sum()
    return float(share[0]), int(np.searchsorted(np.cumsum(share), 0.95) + 1)


def groups(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node and the smallest node it is connected to: labels spread along edges (a, b), and each takes its own label's label, so that rounds grow with the logarithm of the longest path."""
    label = nodes.select("node", F.col("node").alias("root"))
    both = edges.select("a", "b").union(edges.select("b", "a")).distinct()
    while True:
        near = both.join(label, both["a"] == label["node"]).groupBy("b").agg(F.min("root").alias("near"))
        new = label.join(near, label["node"] == near["b"], "left").select("node", F.least("root", F.coalesce("near", "root")).alias("root"), F.col("root").alias("old"))
        new = materialize(new, "groups")
        up = new.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
        label = materialize(new.join(up, new["root"] == up["_n"], "left").select("node", F.least("root", F.coalesce("_r", "root")).alias("root")), "groups")
        if not new.where("root <> old").limit(1).count():
            return label
