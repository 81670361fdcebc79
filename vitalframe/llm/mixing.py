"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def source_key(source: Column) -> Column:
    """A source's name without case, outer space and the choice of -, _ or space; null for null and blank."""
    plain = F.regexp_replace(F.lower(F.regexp_replace(source, r"^[\s ]+|[\s ]+$", "")), r"[\s -]+", "_")
    return F.when(plain != "", plain)


def _cdf(lam: float, upto: int) -> list[float]:
    term, total, out = math.exp(-lam), 0.0, []
    for k in range(upto):
        total += term
        out.append(total)
        term *= lam / (k + 1)
    return out


def capped_mean(lam: float, cap: int) -> float:
    """E[min(Poisson(lam), cap)] = sum over k < cap of P(X > k)."""
    return sum(1.0 - c for c in _cdf(lam, cap))


def rate_for(mean: float, cap: int) -> float:
    """The lam whose capped mean is `mean`; infinite where every record is used `cap` times."""
    if mean >= cap - 1e-9:
        return math.inf
    low, high = 0.0, 1.0
    while capped_mean(high, cap) < mean:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if capped_mean(mid, cap) < mean else (low, mid)
    return (low + high) / 2


def plan_rates(sizes: dict[str, float], targets: list[tuple[str, float, int | None]], total: float | None = None) -> dict[str, tuple[float, list[float]]]:
    """Per source its mean repetition and the thresholds of the inverted distribution.

    total: the size of the mix; by default the largest at which every source that has records meets its share (shares of
    sources without records are left out and the others scaled up). With a larger total the cap holds and shares fall short.
    A cap of None is none: such a source limits nothing.
    """
    there = [(s, w, cap) for s, w, cap in targets if sizes.get(s, 0) > 0 and w > 0 and (cap is None or cap > 0)]
    weight = sum(w for _, w, _ in there)
    if not there:
        return {}
    total = total or min((cap * sizes[s] * weight / w for s, w, cap in there if cap is not None), default=sum(sizes.values()))
    means = {s: total * w / weight / sizes[s] for s, w, cap in there}
    return {s: (min(means[s], cap) if cap is not None else means[s], thresholds(means[s], cap)) for s, _, cap in there}


def thresholds(mean: float, cap: int | None) -> list[float]:
    """Of the inverted distribution with this mean: a record is used as often as there are thresholds below its uniform number."""
    if cap is None:
        return _cdf(mean, int(mean + 12 * math.sqrt(mean)) + 20)
    lam = rate_for(min(mean, cap), cap)
    return [0.0] * cap if math.isinf(lam) else _cdf(lam, cap)


def variance(steps: list[float]) -> float:
    """Of the number of thresholds `steps` below a uniform number."""
    mean = sum(1 - c for c in steps)
    return sum((2 * k + 1) * (1 - c) for k, c in enumerate(steps)) - mean * mean


def _wanted(records: DataFrame, targets: DataFrame, source: str, size: str, total: float | None) -> tuple[DataFrame, dict]:
    """The records with _source and _size, and of each source its mean, cap, size and the standard deviation of one draw's size.

    targets is a fixed table of a few rows; it and two sums a source are gathered on the driver."""
    rows = records.withColumns({"_source": source_key(F.col(source)), "_size": F.coalesce(F.col(size), F.lit(0)).cast("long")})
    wanted = {}
    for t in targets.select(source_key(F.col("source")).alias("s"), "target_share", "max_repeats").collect():
        if t["s"] is not None and t["target_share"] is not None:
            wanted[t["s"]] = (t["s"], float(t["target_share"]), None if t["max_repeats"] is None else int(t["max_repeats"]))
    if not wanted:
        return rows, {}
    square = F.sum(F.col("_size").cast("double") * F.col("_size"))
    sums = {r["_source"]: r for r in rows.filter(F.col("_source").isin(*wanted)).groupBy("_source").agg(F.sum("_size").alias("n"), square.alias("sq")).collect()}
    plan = plan_rates({s: float(r["n"]) for s, r in sums.items()}, list(wanted.values()), total)
    return rows, {s: (mean, wanted[s][2], float(sums[s]["n"]), math.sqrt(sums[s]["sq"] * variance(cdf))) for s, (mean, cdf) in plan.items()}


def _count(steps: Column) -> Column:
    return F.size(F.filter(steps, lambda c: c < F.col("_u")))


def _calibrated(planned: DataFrame, plan: dict, rounds: int = 2, grid: int = 9) -> dict[str, list[float]]:
    """The thresholds of each source at the mean near the planned one at which the sizes of this draw come nearest to the planned size.

    The size grows with the mean, as every record's uniform number stays what it is; each round sums it at `grid` means, first
    over four standard deviations on either side, then between the nearest two.
    """
    goal = {s: mean * n for s, (mean, _, n, _) in plan.items()}
    span = {s: (mean - 4 * sd / n, mean + 4 * sd / n) for s, (mean, _, n, sd) in plan.items()}
    best: dict[str, tuple[float, float]] = {}
    for _ in range(rounds):
        means = {s: [max(a + (b - a) * i / (grid - 1), 1e-9) for i in range(grid)] for s, (a, b) in span.items()}
        steps = [(s, [thresholds(m, plan[s][1]) for m in ms]) for s, ms in means.items()]
        table = F.broadcast(planned.sparkSession.createDataFrame(steps, "_source string, _grid array<array<double>>"))  # a row a source
        sums = [F.sum(F.col("_size") * _count(F.col("_grid")[i])).alias(f"d{i}") for i in range(grid)]
        for r in planned.join(table, "_source").groupBy("_source").agg(*sums).collect():
            s, off = r["_source"], [r[f"d{i}"] - goal[r["_source"]] for i in range(grid)]
            at = min(range(grid), key=lambda i: abs(off[i]))
            best[s] = min(best.get(s, (math.inf, 0.0)), (abs(off[at]), means[s][at]))
            other = min(max(at + (1 if off[at] < 0 else -1), 0), grid - 1)
            span[s] = (min(means[s][at], means[s][other]), max(means[s][at], means[s][other]))
    return {s: thresholds(best[s][1] if s in best else plan[s][0], plan[s][1]) for s in plan}


def mix(records: DataFrame, targets: DataFrame, key: str, source: str, size: str, seed: int = 7, total: float | None = None) -> DataFrame:
    """(key, copy_no, source, size, place): each record as often as its inverted Poisson count says, in globally shuffled order.

    The count is the number of thresholds below a uniform number hashed from the seed and the key, at most the source's
    max_repeats (null: no limit; 0: none of it): a record's fate depends on nothing but its key, so reruns and lost executors
    change nothing. There is one draw; the mean of each source is set so that the draw's size, not only its expectation, meets
    the target. Sources are
    compared by source_key; records with a null source or one without a target are left out; a null size counts as 0.
    Rows repeating a key share its fate. targets (source, target_share, max_repeats; a row a source) is a fixed table of a
    few rows: it and the sizes of its sources are gathered on the driver and the thresholds broadcast.
    """
    rows, plan = _wanted(records, targets, source, size, total)
    uniform = (F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 53)) + F.lit(0.5)) / F.lit(float(1 << 53))
    drawn = rows.withColumn("_u", uniform)
    steps = _calibrated(drawn.select("_source", "_size", "_u"), plan) if plan else {}
    table = records.sparkSession.createDataFrame(list(steps.items()), "_source string, _steps array<double>")
    counted = drawn.join(F.broadcast(table), "_source").withColumn("_n", _count(F.col("_steps")))
    copies = counted.filter("_n > 0").select(F.col(key).alias(key), F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("copy_no"), F.col("_source").alias("source"), F.col("_size").alias(size))
    place = F.xxhash64(F.lit(seed + 1), F.col(key), F.col("copy_no"))
    return copies.withColumn("place", place).orderBy("place", key, "copy_no")


def shares(mixed: DataFrame, targets: DataFrame, key: str, size: str, records: DataFrame | None = None, source: str = "source", total: float | None = None) -> DataFrame:
    """(source, target_share, max_repeats, records, copies, size, actual_share, expected_error) of a mix, a row for each target.

    expected_error: the standard deviation that one draw at the planned mean has, as a share of the mix; null without `records`,
    the table the mix was made of. After calibration the actual shares are much nearer, by what the records' sizes allow.
    """
    used = mixed.groupBy("source").agg(F.count_distinct(key).alias("records"), F.count(F.lit(1)).alias("copies"), F.sum(size).alias("size"))
    all_size = used.agg(F.sum("size").alias("whole"))
    plan = _wanted(records, targets, source, size, total)[1] if records is not None else {}
    table = mixed.sparkSession.createDataFrame([(s, sd) for s, (_, _, _, sd) in plan.items()], "source string, _sd double")
    per = targets.select(source_key(F.col("source")).alias("source"), "target_share", "max_repeats").join(used, "source", "left").na.fill(0, ["records", "copies", "size"])
    per = per.join(F.broadcast(table), "source", "left")  # a row a target
    return per.withColumns({"actual_share": F.col("size") / all_size.scalar(), "expected_error": F.col("_sd") / all_size.scalar()}).drop("_sd")
