"""Rank statistics over daily series, one false-discovery correction and the choice of what to show."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vitalframe.functions.columns import median, normal_tail


def rank_average(value: str, by: list[str]) -> Column:
    """Rank within `by` with ties shared."""
    ties = F.count(F.lit(1)).over(Window.partitionBy(*by, value))
    return F.rank().over(Window.partitionBy(*by).orderBy(value)) + (ties - 1) / F.lit(2.0)


def spearman(pairs: DataFrame, by: list[str], x: str, y: str, min_n: int = 3) -> DataFrame:
    """(by..., n, rho, p): Pearson on shared ranks; two-sided p by Fisher's z. n < 3 or a constant side gives rho 0, p 1.

    Ranks are taken in each group of pairs, from whole numbers and halves, so the sums are exact in any order.
    """
    df = pairs.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumns({"_a": rank_average(x, by), "_b": rank_average(y, by)})
    s = lambda c: F.sum(c)
    a, b = F.col("_a"), F.col("_b")
    out = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), s(a).alias("sa"), s(b).alias("sb"), s(a * b).alias("sab"), s(a * a).alias("saa"), s(b * b).alias("sbb"))
    n = F.col("n")
    va, vb = n * F.col("saa") - F.col("sa") * F.col("sa"), n * F.col("sbb") - F.col("sb") * F.col("sb")
    rho = F.when((n >= 3) & (va > 0) & (vb > 0), (n * F.col("sab") - F.col("sa") * F.col("sb")) / (F.sqrt(va) * F.sqrt(vb))).otherwise(0.0)
    out = out.filter(n >= min_n).withColumn("rho", rho)
    z = F.atanh(F.greatest(F.lit(-0.999999), F.least(F.lit(0.999999), F.col("rho")))) * F.sqrt(F.greatest(n - 3, F.lit(0)).cast("double"))
    p = F.when((n <= 3) | (F.col("rho") == 0), 1.0).otherwise(F.least(F.lit(1.0), 2 * normal_tail(F.abs(z))))
    return out.select(*by, "n", "rho", p.alias("p"))


def mann_whitney(rows: DataFrame, by: list[str], value: str, group: str) -> DataFrame:
    """(by..., n1, n0, u, p): U of the rows with group = 1 against 0; normal approximation with tie correction.

    No continuity correction; no variance or an empty side gives p 1 (and U 0 for an empty side).
    """
    df = rows.filter(F.col(value).isNotNull() & F.col(group).isNotNull()).withColumn("_r", rank_average(value, by))
    df = df.withColumn("_t", F.count(F.lit(1)).over(Window.partitionBy(*by, value)).cast("double"))
    g = F.col(group).cast("int")
    # a tie of t members contributes t^3 - t, that is t^2 - 1 for each member
    out = df.groupBy(*by).agg(F.sum(g).alias("n1"), F.sum(1 - g).alias("n0"), F.sum(F.when(g == 1, F.col("_r"))).alias("r1"), F.sum(F.col("_t") * F.col("_t") - 1).alias("ties"))
    n1, n0 = F.col("n1").cast("double"), F.col("n0").cast("double")
    n = n1 + n0
    u = F.when((n1 > 0) & (n0 > 0), F.col("r1") - n1 * (n1 + 1) / 2).otherwise(0.0)
    var = n1 * n0 / 12 * ((n + 1) - F.try_divide(F.col("ties"), n * (n - 1)))
    z = F.abs(u - n1 * n0 / 2) / F.sqrt(F.when(var > 0, var))
    return out.select(*by, "n1", "n0", u.alias("u"), F.coalesce(F.when((n1 > 0) & (n0 > 0), F.least(F.lit(1.0), 2 * normal_tail(z))), F.lit(1.0)).alias("p"))


def benjamini_hochberg(tests: DataFrame, p: str, order: list[str], pool: list[str]) -> DataFrame:
    """Adds q, corrected within each `pool` (one subject's tests, say); `order` breaks ties of p. A pool is as large as a subject has
    tests, pools are spread over tasks."""
    w = Window.partitionBy(*pool).orderBy(F.col(p), *order)
    df = tests.withColumns({"_rk": F.row_number().over(w), "_n": F.count(F.lit(1)).over(Window.partitionBy(*pool))})
    back = Window.partitionBy(*pool).orderBy(F.desc("_rk")).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("q", F.least(F.lit(1.0), F.min(F.col(p) * F.col("_n") / F.col("_rk")).over(back))).drop("_rk", "_n")


#: The bounds of q for strong, likely and probable findings.
EVIDENCE = [("strong", 0.01), ("likely", 0.05), ("probable", 0.10)]


def evidence(q: Column) -> Column:
    """How far a finding goes by its q: strong, likely, probable or early; null for null."""
    out = F.when(q.isNull(), None)
    for name, bound in EVIDENCE:
        out = out.when(q < bound, name)
    return out.otherwise("early")


def metric_pairs(daily: DataFrame, by: list[str], forbidden: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """(by..., a, b, date, x, y) of all pairs of metrics a < b on the dates that both have."""
    left = daily.filter("value is not null").select(*by, "date", F.col("metric").alias("a"), F.col("value").alias("x"))
    right = daily.filter("value is not null").select(*by, "date", F.col("metric").alias("b"), F.col("value").alias("y"))
    out = left.join(right, [*by, "date"]).filter("a < b")
    for one, two in forbidden:
        a, b = sorted((one, two))
        out = out.filter(~((F.col("a") == a) & (F.col("b") == b)))
    return out


def lagged_pairs(daily: DataFrame, by: list[str], pairs: list[tuple[str, str]], lag: int = 1) -> DataFrame:
    """(by..., a, b, date, x, y): metric b on a date with metric a `lag` calendar days earlier, for the given pairs."""
    spark = daily.sparkSession
    table = F.broadcast(spark.createDataFrame(pairs, "a string, b string"))  # the given list
    left = daily.filter("value is not null").select(*by, F.date_add("date", lag).alias("date"), F.col("metric").alias("a"), F.col("value").alias("x"))
    right = daily.filter("value is not null").select(*by, "date", F.col("metric").alias("b"), F.col("value").alias("y"))
    return left.join(table, "a").join(right, [*by, "date", "b"])


def median_slope(d: np.ndarray, v: np.ndarray, at_once: int = 7_000_000) -> tuple[float, int]:
    """The median of the slopes between all points of different d, and their number; (0, 0) for none.

    Up to `at_once` slopes are formed at a time. Where there are more, the value is narrowed down by counting, a block of points
    against all others in each pass, until few enough slopes are left to sort: exact, in bounded memory.
    """
    n = len(d)
    order = np.argsort(d, kind="stable")
    d, v = d[order], v[order]
    block = max(1, at_once // max(n, 1))

    def parts():
        for a in range(0, n, block):
            later = d[None, :] > d[a : a + block, None]
            with np.errstate(divide="ignore", invalid="ignore"):
                yield ((v[None, :] - v[a : a + block, None]) / (d[None, :] - d[a : a + block, None]))[later]

    counts = [(len(x), x.min(), x.max()) if len(x) else (0, np.inf, -np.inf) for x in parts()]
    total, low, high = sum(c for c, _, _ in counts), min(a for _, a, _ in counts), max(b for _, _, b in counts)
    if not total:
        return 0.0, 0
    below, inside = 0, total  # slopes under `low`, and in [low, high]
    ranks = np.array([(total - 1) // 2, total // 2])
    while inside > at_once and low < high:
        middle = low + (high - low) / 2
        if not low < middle < high:
            break
        left = sum(int(np.count_nonzero(x <= middle)) for x in parts())
        if ranks[0] < left <= ranks[1]:  # the two middle slopes lie on either side
            return float((max(x[x <= middle].max(initial=-np.inf) for x in parts()) + min(x[x > middle].min(initial=np.inf) for x in parts())) / 2), total
        if left > ranks[1]:
            high, inside = middle, left - below
        else:
            low, below, inside = np.nextafter(middle, np.inf), left, below + inside - left
    if inside > at_once:  # all equal to the last bit
        return float(low), total
    kept = np.sort(np.concatenate([x[(x >= low) & (x <= high)] for x in parts()]))
    return float(kept[ranks - below].mean()), total


def theil_sen(daily: DataFrame, by: list[str]) -> DataFrame:
    """(by..., slope_per_week, n_pairs): the median slope over all pairs of days, times seven; series of one day give no row.

    A series is a group's days, one row each; its slopes are formed in numpy in bounded memory (median_slope), whatever its
    length, and no pairs leave the task.
    """
    rows = daily.filter("value is not null").select(*by, F.datediff("date", F.lit("1970-01-01")).alias("_d"), F.col("value").cast("double").alias("_v"))
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in by)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        slope, n = median_slope(pdf["_d"].to_numpy(float), pdf["_v"].to_numpy(float))
        return pdf[by].head(1 if n else 0).assign(slope_per_week=slope * 7, n_pairs=n)

    return rows.groupBy(*by).applyInPandas(one, f"{kinds}, slope_per_week double, n_pairs long")


def weekend_rows(daily: DataFrame) -> DataFrame:
    """Adds weekend (0 or 1)."""
    return daily.filter("value is not null").withColumn("weekend", (F.weekday("date") >= 5).cast("int"))


def group_medians(rows: DataFrame, by: list[str], group: str) -> DataFrame:
    side = lambda g: median(F.when(F.col(group) == g, F.col("value")))
    return rows.groupBy(*by).agg(side(1).alias("median_1"), side(0).alias("median_0"))


def exposure_days(events: DataFrame, by: list[str], hour_from: int) -> DataFrame:
    """(by..., date, exposed): the days after one with an event at or after `hour_from` (1) or with earlier events only (null)."""
    day = events.groupBy(*by, F.date_add(F.to_date("ts"), 1).alias("date")).agg(F.max(F.hour("ts")).alias("h"))
    return day.select(*by, "date", F.when(F.col("h") >= hour_from, 1).alias("exposed"), F.lit(True).alias("any_event"))


def exposed_rows(daily: DataFrame, days: DataFrame, by: list[str]) -> DataFrame:
    """Daily rows with exposed = 1 (late event the day before) or 0 (no event at all); days after early events are in neither."""
    df = daily.filter("value is not null").join(days, [*by, "date"], "left")
    return df.withColumn("exposed", F.when(F.col("any_event").isNull(), 0).otherwise(F.col("exposed"))).filter("exposed is not null").drop("any_event")


def cutoff_scan(daily: DataFrame, events: DataFrame, by: list[str], series: list[str], hours: list[int]) -> DataFrame:
    """(by..., series..., hour, n1, n0, u, p, median_1, median_0) for each cutoff hour: days after an event at or after it
    against clean days. Events are matched on `by`, each (by..., series...) is tested by itself."""
    last = events.groupBy(*by, F.date_add(F.to_date("ts"), 1).alias("date")).agg(F.max(F.hour("ts")).alias("h"))
    df = daily.filter("value is not null").join(last, [*by, "date"], "left").withColumn("hour", F.explode(F.array(*[F.lit(h) for h in hours])))
    df = df.withColumn("exposed", F.when(F.col("h").isNull(), 0).when(F.col("h") >= F.col("hour"), 1)).filter("exposed is not null")
    keys = [*by, *series, "hour"]
    return mann_whitney(df, keys, "value", "exposed").join(group_medians(df, keys, "exposed"), keys)


def best_cutoff(scan: DataFrame, by: list[str], lower_is_worse: bool = True, least: int = 5) -> DataFrame:
    """The hour with the greatest harm (median difference in the bad direction, to two places), ties by smaller p (to four), then the
    earlier hour. Where no hour does harm there is no row."""
    sign = -1.0 if lower_is_worse else 1.0
    harm = F.round((F.col("median_1") - F.col("median_0")) * sign, 2)
    ok = scan.filter((F.col("n1") >= least) & (F.col("n0") >= least)).withColumn("harm", harm).filter("harm > 0")
    best = F.max_by(F.struct("hour", "harm", "n1", "n0", "p"), F.struct(F.col("harm"), -F.round("p", 4), -F.col("hour")))
    return ok.groupBy(*by).agg(best.alias("b")).select(*by, "b.*")


#: Q below which a finding is confirmed, and below which it is an early hint; the least rho of a finding that has one.
CONFIRMED_Q, EARLY_Q, RHO_FLOOR = 0.10, 0.25, 0.30


def qualifying(tests: DataFrame, by: list[str], anchor: str = "hrv_rmssd", spot: str = "hrv_sdnn") -> DataFrame:
    """The tests (by..., family, metrics, effect, q) that can be shown, with their band: confirmed or early.

    Pairs, lags and trends need a rho of RHO_FLOOR. A pair of metrics counts once whatever its order, the smallest q first, and
    the pair of `spot` with a metric is dropped where that of `anchor` with it qualifies.
    """
    rho = F.col("family").isin("pair", "lag", "trend")
    ok = tests.filter(F.col("q") < EARLY_Q).filter(~rho | (F.abs("effect") >= RHO_FLOOR))
    # windows, not joins with itself, so that the pool is computed once
    paired, has = F.col("family") == "pair", lambda one: F.array_contains("metrics", one)
    ok = ok.withColumn("_k", F.row_number().over(Window.partitionBy(*by, "family", F.when(paired, F.array_sort("metrics")).otherwise(F.array("key"))).orderBy("q", "key"))).filter("_k = 1")
    partner = F.when(paired & (has(anchor) | has(spot)), F.array_except("metrics", F.array(F.lit(anchor), F.lit(spot)))[0])
    ok = ok.withColumn("_partner", partner).withColumn("_stronger", F.max(paired & has(anchor)).over(Window.partitionBy(*by, "_partner")))
    kept = ok.filter(~(paired & has(spot) & F.col("_stronger"))).drop("_k", "_partner", "_stronger")
    return kept.withColumn("band", F.when(F.col("q") < CONFIRMED_Q, "confirmed").otherwise("early"))


def choose_cards(findings: DataFrame, by: list[str], k: int = 3) -> DataFrame:
    """Greedy choice per group: by q, then effect (largest first), then key; a card is taken if it shares no metric with those taken.

    findings: by..., key, metrics (array), q, effect. A fold over the ordered findings of a group, of which there are at
    most as many as tests.
    """
    order = F.struct(F.col("q"), (-F.abs("effect")).alias("e"), F.col("key"), F.col("metrics"))
    listed = findings.groupBy(*by).agg(F.array_sort(F.collect_list(order)).alias("all"))
    start = F.array().cast("array<struct<q:double,e:double,key:string,metrics:array<string>>>")
    taken = lambda acc: F.flatten(F.transform(acc, lambda x: x["metrics"]))
    fold = F.aggregate("all", start, lambda acc, x: F.when((F.size(acc) >= k) | F.arrays_overlap(taken(acc), x["metrics"]), acc).otherwise(F.concat(acc, F.array(x))))
    return listed.select(*by, F.posexplode(fold).alias("place", "c")).select(*by, (F.col("place") + 1).alias("place"), "c.key", "c.metrics", "c.q", (-F.col("c.e")).alias("effect"))
