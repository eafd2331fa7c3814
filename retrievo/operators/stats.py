"""Statistics on columns; what is left for Python are p-values of a few numbers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def average_rank(value: str, *partition: str) -> Column:
    """Rank with ties sharing the mean of their places."""
    ordered, same = Window.partitionBy(*partition).orderBy(value), Window.partitionBy(*partition, value)
    return F.rank().over(ordered) + (F.count(F.lit(1)).over(same) - 1) / 2


def with_average_rank(rows: DataFrame, value: str, name: str, *by: str, chunks: int = 64) -> DataFrame:
    """``rows`` with their average rank by ``value``, in each group of ``by`` or over the whole table.

    A whole table is cut into chunks at quantiles of the value: rows are ranked inside their chunk, and the
    rows of the chunks before, a number for each, are added.  Equal values are in one chunk.
    """
    if by:
        return rows.withColumn(name, average_rank(value, *by))
    bounds = sorted(set(rows.approxQuantile(value, [i / chunks for i in range(1, chunks)], 0.001)))
    cut = rows.withColumn("_chunk", sum(((F.col(value) > b).cast("int") for b in bounds), F.lit(0)))
    sizes, before, added = {r["_chunk"]: r["count"] for r in cut.groupBy("_chunk").count().collect()}, 0, F.lit(0)  # a row for each chunk
    for chunk in sorted(c for c in sizes if c is not None):
        added = F.when(F.col("_chunk") == chunk, before).otherwise(added) if before else added
        before += sizes[chunk]
    return cut.withColumn(name, average_rank(value, "_chunk") + added).drop("_chunk")


def spearman(rows: DataFrame, x: str, y: str, *by: str) -> DataFrame:
    ranked = with_average_rank(with_average_rank(rows, x, "rx", *by), y, "ry", *by)
    return ranked.groupBy(*by).agg(F.corr("rx", "ry").alias("rho"))


def auc(rows: DataFrame, score: str, positive: str, *by: str) -> DataFrame:
    """Mann-Whitney area, ties counting a half."""
    ranked = with_average_rank(rows, score, "r", *by)
    p = F.sum(F.col(positive).cast("long"))
    n = F.count(F.lit(1)) - p
    return ranked.groupBy(*by).agg(((F.sum(F.when(F.col(positive), F.col("r"))) - p * (p + 1) / 2) / (p * n)).alias("auc"))


def cohens_d(rows: DataFrame, value: str, group: str, *by: str) -> DataFrame:
    """Difference of the group's mean from the others' over the pooled deviation (sample)."""
    a, b = F.when(F.col(group), F.col(value)), F.when(~F.col(group), F.col(value))
    na, nb = F.count(a), F.count(b)
    pooled = F.sqrt(((na - 1) * F.var_samp(a) + (nb - 1) * F.var_samp(b)) / (na + nb - 2))
    return rows.groupBy(*by).agg(((F.avg(a) - F.avg(b)) / pooled).alias("d"))


def effect_label(d: Column) -> Column:
    size = F.abs(d)
    return F.when(size < 0.2, "negligible").when(size < 0.5, "small").when(size < 0.8, "medium").otherwise("large")


def paired_effect(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    diff = F.col(a) - F.col(b)
    return pairs.agg((F.avg(diff) / (F.stddev_samp(diff) + 1e-10)).alias("d"))


def holm(tests: DataFrame, p: str = "p", key: str = "name") -> DataFrame:
    """Holm-Bonferroni: p times the tests left, never falling, at most 1.  NaN takes no part and stays NaN."""
    good = tests.filter(~F.isnan(p) & F.col(p).isNotNull())
    order = Window.orderBy(p, key)
    n = F.count(F.lit(1)).over(Window.orderBy(p, key).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    step = F.col(p) * (n - F.row_number().over(order) + 1)
    out = good.withColumn("step", step).withColumn("adjusted", F.least(F.lit(1.0), F.max("step").over(order.rowsBetween(Window.unboundedPreceding, 0)))).drop("step")
    return out.unionByName(tests.filter(F.isnan(p) | F.col(p).isNull()).withColumn("adjusted", F.lit(float("nan"))))


#: Chances that a Poisson(1) count is at most 0, 1, ... 7.
POISSON = [math.exp(-1) * sum(1 / math.factorial(j) for j in range(k + 1)) for k in range(8)]


def bootstrap(rows: DataFrame, key: str, value: str, resamples: int = 1000, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """Percentile interval of the mean; a row's count in a resample is Poisson(1), drawn by a hash of seed, key and resample."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"), F.col("b").cast("string")))
    u = F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / float(16**13)
    count = sum((u >= s).cast("int") for s in POISSON)
    drawn = rows.select(key, F.col(value).alias("v"), F.explode(F.sequence(F.lit(1), F.lit(resamples))).alias("b")).withColumn("c", count)
    means = drawn.groupBy("b").agg((F.sum(F.col("v") * F.col("c")) / F.sum("c")).alias("m"))
    return means.agg(F.percentile("m", alpha / 2).alias("low"), F.percentile("m", 1 - alpha / 2).alias("high"))


def paired_t(pairs: DataFrame, a: str = "a", b: str = "b") -> dict[str, float]:
    diff = F.col(a) - F.col(b)
    r = pairs.agg(F.avg(diff).alias("m"), F.stddev_samp(diff).alias("s"), F.count(diff).alias("n")).first()
    if not r["n"] or r["n"] < 2 or not r["s"]:
        return {"t": math.nan, "p": math.nan, "n": r["n"]}
    t = r["m"] / (r["s"] / math.sqrt(r["n"]))
    return {"t": t, "p": student_p(t, r["n"] - 1), "n": r["n"]}


def student_p(t: float, df: float) -> float:
    """Two-sided p of Student's t: the regularised incomplete beta function by its continued fraction."""
    return beta_inc(df / 2, 0.5, df / (df + t * t))


def beta_inc(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    tiny, c, d = 1e-300, 1.0, 1 / (1 - (a + b) * x / (a + 1))
    f = d
    for m in range(1, 400):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + step * d or tiny)
            c = 1 + step / c or tiny
            f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * f


def wilcoxon(pairs: DataFrame, a: str = "a", b: str = "b") -> dict[str, float]:
    """Signed-rank test without zero differences, by the normal approximation with ties."""
    d = pairs.select((F.col(a) - F.col(b)).alias("d")).filter("d <> 0").withColumn("size", F.abs("d"))
    d = with_average_rank(d, "size", "r")
    ties = d.groupBy("size").count().agg(F.sum(F.col("count") ** 3 - F.col("count"))).first()[0] or 0.0
    r = d.agg(F.sum(F.when(F.col("d") > 0, F.col("r")).otherwise(0.0)).alias("up"), F.count(F.lit(1)).alias("n")).first()
    n, up = r["n"], r["up"] or 0.0
    spread = n * (n + 1) * (2 * n + 1) / 24 - ties / 48
    if not n or spread <= 0:
        return {"w": 0.0, "p": math.nan, "n": n}
    z = (up - n * (n + 1) / 4) / math.sqrt(spread)
    return {"w": min(up, n * (n + 1) / 2 - up), "p": math.erfc(abs(z) / math.sqrt(2)), "n": n}


def friedman(rows: DataFrame, query: str = "query_id", method: str = "method", value: str = "value") -> dict[str, float]:
    """Chi-square over three or more methods measured on the same queries."""
    ranked = rows.withColumn("r", average_rank(value, query))
    sums = [r["s"] for r in ranked.groupBy(method).agg(F.sum("r").alias("s")).collect()]  # a row per method
    n, k = rows.select(query).distinct().count(), len(sums)
    if k < 3 or not n:
        return {"chi2": math.nan, "p": math.nan}
    ties = ranked.groupBy(query, value).count().agg(F.sum(F.col("count") ** 3 - F.col("count"))).first()[0] or 0.0
    chi2 = 12 / (n * k * (k + 1)) * sum(s * s for s in sums) - 3 * n * (k + 1)
    chi2 /= 1 - ties / (n * (k**3 - k))
    return {"chi2": chi2, "p": chi2_p(chi2, k - 1)}


def chi2_p(x: float, df: int) -> float:
    """Upper tail of the chi-square distribution by the series of the incomplete gamma function."""
    if x <= 0:
        return 1.0
    a, h = df / 2, x / 2
    term = total = 1 / a
    for i in range(1, 1000):
        term *= h / (a + i)
        total += term
        if term < total * 1e-16:
            break
    return max(0.0, 1 - total * math.exp(-h + a * math.log(h) - math.lgamma(a)))


def kappa(rows: DataFrame, a: str, b: str, *by: str) -> DataFrame:
    """Cohen's kappa of two 0/1 columns; chance agreement of 1 gives 1, no rows 0."""
    n = F.count(F.lit(1))
    same = F.avg((F.col(a) == F.col(b)).cast("double"))
    pa, pb = F.avg(F.col(a).cast("double")), F.avg(F.col(b).cast("double"))
    counts = rows.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by).agg(n.alias("n"), same.alias("agreement"), (pa * pb + (1 - pa) * (1 - pb)).alias("chance"))
    value = F.when(F.col("n") == 0, F.lit(0.0)).when(F.col("chance") == 1, F.lit(1.0)).otherwise((F.col("agreement") - F.col("chance")) / (1 - F.col("chance")))
    return counts.select(*by, "n", F.coalesce("agreement", F.lit(0.0)).alias("agreement"), value.alias("kappa"))
