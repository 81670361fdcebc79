"""Implausible readings: a Kalman filter per source over tiles of readings, with withheld updates, and a test for vanishing innovation variance."""

from __future__ import annotations

from collections import Counter
from math import exp, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vitalframe.session import cut

#: What a living wearer can have (lowest, highest).
POSSIBLE = {"heart_rate": (20.0, 250.0), "respiratory_rate": (3.0, 70.0), "hrv_sdnn": (1.0, 400.0)}
#: Standardised innovation from which a reading is withheld, and flagged if it is as far from all three forecasts.
THRESHOLD = 5.5
#: Seconds in which a level's distance from the source's middle falls to 1/e.
RELAX_S = 3600.0
#: Of the source's variance the part that is noise of a reading; the rest is the level's own.
NOISE = 0.5
#: How much the noise grows with the squared distance of the level from the middle, in the source's variances: effort is restless.
RAISED = 0.3
#: An innovation that is taken up though it is so many deviations large shows a moving level: its excess is added to the state's variance.
MOVING = 3.0
#: Withheld readings in a row that are still a spike; more are a change of level (effort), which is taken up.
SPIKE_READINGS = 4
#: Readings of one value in a row that are stuck at least.
STUCK_LEAST = 7
#: Runs that reach a length count for how a source repeats if they are as many, and as large a share of its runs; stuck ones are fewer.
REPEAT_RUNS, REPEAT_SHARE = 30, 0.01
#: The limit of stuck runs is such that a source reaches it by chance once in a hundred stretches of so many readings.
CHANCE_READINGS = 4096
#: Readings in a tile, and least readings of its halo on either side.
TILE_ROWS, HALO_ROWS = 4096, 128


def source_profile(readings: DataFrame) -> DataFrame:
    """Per (device_key, metric): mid, spread (from quartiles), n; one pass with partial aggregates."""
    q = F.percentile_approx("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.lit(2000))
    out = readings.groupBy("device_key", "metric").agg(q.alias("q"), F.count(F.lit(1)).alias("n"))
    spread = F.greatest((F.col("q")[2] - F.col("q")[0]) / 1.349, F.abs(F.col("q")[1]) * 0.01, F.lit(0.05))
    return out.select("device_key", "metric", F.col("q")[1].alias("mid"), spread.alias("spread"), "n")


def ranked(readings: DataFrame) -> DataFrame:
    """Adds i, a reading's exact number in its source by (s, row_id), from 0: its rank in its hour after the counts of the earlier
    hours. No group is larger than a source's readings of one hour, or than its hours."""
    key = ["device_key", "metric", "_hour"]
    rows = readings.withColumn("_hour", F.floor(F.col("s") / 3600))
    w = Window.partitionBy("device_key", "metric").orderBy("_hour").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_c")).select(*key, F.coalesce(F.sum("_c").over(w), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("s", "row_id"))
    return rows.withColumn("_rank", rank).join(before, key).withColumn("i", F.col("_before") + F.col("_rank") - 1).drop("_hour", "_rank", "_before")


def innovations(s: list[float], y: list[float], mid: float, spread: float) -> np.ndarray:
    """The standardised innovation of each reading of an ordered series against its one-step forecast.

    State: the level, which relaxes to the source's middle (an Ornstein-Uhlenbeck process), so that after a long silence the
    forecast is the source's usual distribution. A reading beyond THRESHOLD is withheld from the state; when more than
    SPIKE_READINGS in a row are, the level has moved: the filter restarts at the first of them and takes them up.
    """
    r = spread * spread
    noise, own = NOISE * r, (1 - NOISE) * r
    z, held = [0.0] * len(y), []
    level, p, at = mid, own, s[0] if s else 0.0

    def step(j: int, withhold: bool) -> bool:
        nonlocal level, p, at
        a = exp(-abs(s[j] - at) / RELAX_S)
        x, prior = mid + (level - mid) * a, own + (p - own) * a * a
        v = prior + noise + NOISE * RAISED * (x - mid) ** 2
        e = y[j] - x
        z[j] = abs(e) / sqrt(v)
        if withhold and z[j] > THRESHOLD:
            return False
        gain = prior / v
        level, p, at = x + gain * e, (1 - gain) * prior + (0.0 if not withhold else max(0.0, e * e - MOVING * MOVING * v)), s[j]
        return True

    for j in range(len(y)):
        if step(j, True):
            held = []
            continue
        held.append(j)
        if len(held) > SPIKE_READINGS:
            level, p, at, z[held[0]] = y[held[0]], noise, s[held[0]], 0.0
            for k in held[1:]:
                step(k, False)
            held = []
    return np.array(z)


def spikes(s: np.ndarray, y: np.ndarray, mid: float, spread: float) -> np.ndarray:
    """Readings whose standardised innovation exceeds THRESHOLD against the forecast from before, against that from after (the
    same filter on the series turned round) and against the source's usual distribution. A climb or fall over several
    readings, effort, is foretold from one side or the other."""
    if not len(y):
        return np.zeros(0, bool)
    far = np.abs(y - mid) / spread > THRESHOLD
    if not far.any():
        return far
    before = innovations(s.tolist(), y.tolist(), mid, spread)
    after = innovations(s[::-1].tolist(), y[::-1].tolist(), mid, spread)[::-1]
    return far & (before > THRESHOLD) & (after > THRESHOLD)


def run_lengths(y: np.ndarray) -> np.ndarray:
    """The lengths of the runs of one value."""
    return np.bincount(np.cumsum(np.concatenate([[True], y[1:] != y[:-1]])) - 1)


def stuck_limit(lengths: Counter, n: int) -> int:
    """Readings in a row that a source of `n` readings with runs of these lengths doesn't come to by its own repeats.

    Each run counts once whatever its length, so the few stuck ones hardly weigh, while normal runs of any length show how
    many of a source's runs get past 1, 2, 3... readings. Beyond the lengths that enough runs reach, the last two shares go on.
    """
    runs = reach = sum(lengths.values())
    shares = []
    while reach >= max(REPEAT_RUNS, REPEAT_SHARE * runs):
        shares.append((reach - lengths[len(shares) + 1], reach))
        reach = shares[-1][0]
    usual, survive, go_on = max(len(shares), 1), 1.0, 0.02
    if shares:
        longer, of = map(sum, zip(*shares[-2:]))
        share = longer / of
        survive, go_on = shares[-1][1] / runs, share - sqrt(share * (1 - share) / of)  # few runs are long
    chance = max(survive * max(min(n, CHANCE_READINGS), 10) / 0.01, 1.0)
    return max(STUCK_LEAST, usual + int(np.ceil(np.log(chance) / -np.log(min(max(go_on, 0.02), 0.99)))))


def source_limits(readings: DataFrame) -> DataFrame:
    """(device_key, metric, stuck_at): the limit of each source, from the lengths of its runs over all tiles `own`.

    A tile is reduced to its two outer runs and the counts of the inner ones before a source's tiles meet.
    """

    def tile(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        y = pdf["value"].to_numpy(float)
        length = run_lengths(y)
        sizes, counts = np.unique(length[1:-1], return_counts=True)
        out = pdf[["device_key", "metric", "own"]].head(1)
        return out.assign(n=len(y), runs=len(length), first=y[0], first_n=length[0], last=y[-1], last_n=length[-1], sizes=[sizes.tolist()], counts=[counts.tolist()])

    def source(pdf: pd.DataFrame) -> pd.DataFrame:
        lengths, value, total = Counter(), None, 0  # the run that is open
        for t in pdf.sort_values("own").itertuples():
            if total and t.first == value:
                total += t.first_n
            else:
                lengths[total] += 1
                value, total = t.first, t.first_n
            if t.runs > 1:
                lengths[total] += 1
                lengths.update(dict(zip(t.sizes, t.counts)))
                value, total = t.last, t.last_n
        lengths[total] += 1
        del lengths[0]
        return pdf[["device_key", "metric"]].head(1).assign(stuck_at=stuck_limit(lengths, int(pdf["n"].sum())))

    key = "device_key string, metric string"
    tiles = readings.select("device_key", "metric", "own", "i", "value").groupBy("device_key", "metric", "own")
    tiles = tiles.applyInPandas(tile, f"{key}, own long, n long, runs long, first double, first_n long, last double, last_n long, sizes array<long>, counts array<long>")
    return tiles.groupBy("device_key", "metric").applyInPandas(source, f"{key}, stuck_at long")


def stuck(y: np.ndarray, limit: int, spread: float) -> np.ndarray:
    """Readings of a stretch of `limit` or more over which the variance of the innovations vanishes, those of the forecast that
    the last value stays."""
    out, k = np.zeros(len(y), bool), limit - 1
    if len(y) < limit:
        return out
    with np.errstate(invalid="ignore"):
        e = np.nan_to_num(np.clip(np.diff(y) / spread, -1e3, 1e3), nan=1e3)
    total = np.concatenate([[0.0], np.cumsum(e * e)])
    variance = (total[k:] - total[:-k]) / k
    edge = np.zeros(len(y) + 1, int)
    starts = np.flatnonzero(variance == 0)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + limit, -1)
    return np.cumsum(edge)[:-1] > 0


def flag_readings(samples: DataFrame, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(row_id, device_key, metric, start_ts, value, impossible, spike, stuck) for each row with a value of the metrics in POSSIBLE.

    Order is by start_ts, then row_id. Rows with a null or NaN value, device, metric or time, and other metrics, are left
    out. Give it rows without redelivered copies. The series are cut into tiles of `tile_rows` readings, each with a halo on both
    sides, of HALO_ROWS readings, or as many as the source's limit of stuck runs: there the filter settles and runs are whole. So the
    hottest source is as many small groups as it has tiles, however uneven its readings are, and the flags don't depend on the tiles.
    """
    seconds = F.unix_micros(F.col("start_ts").cast("timestamp")) / F.lit(1e6)
    rows = samples.select("row_id", "device_key", "metric", "start_ts", "value", seconds.alias("s"))
    rows = rows.filter(F.col("metric").isin(*POSSIBLE) & F.expr("device_key is not null and s is not null and value is not null and not isnan(value)"))
    own = F.floor(F.col("i") / tile_rows)
    rows = cut(ranked(rows).withColumn("own", own))
    tiled = rows.join(source_profile(rows), ["device_key", "metric"]).join(source_limits(rows), ["device_key", "metric"])
    halo = F.greatest(F.lit(HALO_ROWS), F.col("stuck_at"))
    first, last = F.floor((F.col("i") - halo) / tile_rows), F.floor((F.col("i") + halo) / tile_rows)
    tiled = tiled.withColumn("tile", F.explode(F.sequence(F.greatest(first, F.lit(0)), F.least(last, F.floor((F.col("n") - 1) / tile_rows)))))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        y, s = pdf["value"].to_numpy(float), pdf["s"].to_numpy(float)
        mid, spread = float(pdf["mid"].iloc[0]), float(pdf["spread"].iloc[0])
        low, high = POSSIBLE[pdf["metric"].iloc[0]]
        possible = (y >= low) & (y <= high)
        still = stuck(y, int(pdf["stuck_at"].iloc[0]), spread)
        spike = np.zeros(len(y), bool)
        free = possible & ~still  # neither moves the level
        spike[free] = spikes(s[free], y[free], mid, spread)
        out = pdf.assign(impossible=~possible, spike=spike, stuck=still)
        return out[out["own"] == out["tile"]][["row_id", "device_key", "metric", "start_ts", "value", "impossible", "spike", "stuck"]]

    kind = rows.schema["start_ts"].dataType.simpleString()
    row_id = rows.schema["row_id"].dataType.simpleString()
    tiled = tiled.select("row_id", "device_key", "metric", "start_ts", "value", "s", "i", "own", "tile", "mid", "spread", "stuck_at")
    return tiled.groupBy("device_key", "metric", "tile").applyInPandas(one, f"row_id {row_id}, device_key string, metric string, start_ts {kind}, value double, impossible boolean, spike boolean, stuck boolean")
