"""Rolling totals over trailing periods: dense day blocks times banded window operators, in time tiles with halos."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vitalframe.session import partitions

#: Days in a time tile, and the longest window that its band operator spans; longer ones are differences of running totals.
TILE_DAYS, BAND_DAYS = 256, 128
#: Entities in a hash bucket, about, and entities that are dense in memory at a time.
BUCKET_ENTITIES, DENSE_ENTITIES = 2000, 256


def current_versions(daily: DataFrame) -> DataFrame:
    """(entity parts, date, value): the version with the latest computed_at of each day; of versions with the same
    computed_at (or none) one with a value, the largest, holds. Days keep their row when the value is null."""
    order = F.struct(F.col("computed_at"), F.col("value").isNotNull(), F.col("value"))
    return daily.groupBy("device_key", "metric", "date").agg(F.max_by("value", order).alias("value"))


def band(width: int, halo: int, days: int) -> np.ndarray:
    """The (halo + days) x days operator whose column d sums the `width` days before day d of the tile, without it."""
    rows, cols = np.arange(halo + days)[:, None], np.arange(days)[None, :] + halo
    return ((rows < cols) & (rows >= cols - width)).astype(float)


def dense(left: pd.DataFrame, entity: np.ndarray, entities: int, first: int, days: int) -> tuple[np.ndarray, np.ndarray]:
    """Values and presence of `days` days from `first` on, a row an entity; entity: the row of each fact, -1 for none."""
    values, present = np.zeros((entities, days)), np.zeros((entities, days))
    col = left["_day"].to_numpy() - first
    ok = (entity >= 0) & (col >= 0) & (col < days)
    np.add.at(values, (entity[ok], col[ok]), left["value"].to_numpy()[ok])
    np.add.at(present, (entity[ok], col[ok]), 1)
    return values, present


def trailing_totals(daily: DataFrame, asked: DataFrame, tile_days: int = TILE_DAYS, band_days: int = BAND_DAYS) -> DataFrame:
    """For each asked (device_key, metric, date, window_days): total_value, mean_value = total / window_days and n_days over the
    `window_days` days before `date`, without it. Days without a row or value count as days without activity (0).

    daily: one row per (device_key, metric, date), see current_versions. asked: those four columns, others are kept as
    they are; rows with a null part or window_days < 1 are dropped. Nothing in the window gives 0, 0, 0.

    A block holds the entities of one hash bucket over one tile of days and its halo of `band_days`. Buckets are as many as the
    counted entities need, and a block is worked on DENSE_ENTITIES entities at a time, so its memory is bounded whatever the data
    hold; a source with a third of all rows spreads over its tiles. Windows of any length are exact: those over `band_days` are
    the running total at their end less that at their start.
    """
    asked = asked.filter("device_key is not null and metric is not null and date is not null and window_days >= 1")
    facts = daily.filter("device_key is not null and metric is not null and date is not null and value is not null and not isnan(value)")
    entities, widest = asked.agg(F.approx_count_distinct(F.struct("device_key", "metric")), F.max("window_days")).first()
    buckets = max(partitions(daily.sparkSession), -(-entities // BUCKET_ENTITIES))
    bucket = F.pmod(F.xxhash64("device_key", "metric"), F.lit(buckets)).alias("_bucket")
    day = F.datediff("date", F.lit("1970-01-01"))
    tile = lambda c: F.floor(c / tile_days)
    facts = facts.select(bucket, "device_key", "metric", day.alias("_day"), "value")
    kept = asked.columns
    short = _banded(facts, asked.filter(F.col("window_days") <= band_days), bucket, day, tile, tile_days, band_days)
    if (widest or 0) <= band_days:
        return short
    long = asked.filter(F.col("window_days") > band_days)
    key = ["device_key", "metric", "date", "window_days"]
    # +1 at the window's end, -1 at its start; the days before a point are its tile's up to it, and all of the earlier tiles
    sides = F.explode(F.array(*[F.struct(F.lit(s).alias("sign"), d.alias("_day")) for s, d in ((1, day), (-1, day - F.col("window_days")))]))
    points = long.select(*[F.col(c).alias(c) for c in key]).distinct().select(bucket, *key, sides.alias("_p")).select("_bucket", *key, "_p.sign", "_p._day").withColumn("_tile", tile(F.col("_day")))
    total = _running(facts, points, tile, tile_days).groupBy(*key).agg(F.sum("t").alias("r_total"), F.sum("n").cast("int").alias("r_days"))
    wide = long.select(*[F.col(f"`{c}`").alias(c) for c in kept]).join(total, key)
    wide = wide.select(*[F.col(f"`{c}`") for c in kept], "r_total", (F.col("r_total") / F.col("window_days")).alias("r_mean"), "r_days")
    return short.unionByName(wide)


def _banded(facts: DataFrame, asked: DataFrame, bucket, day, tile, tile_days: int, halo: int) -> DataFrame:
    # a day serves its own tile and, within the halo of the end, the next ones
    last = tile(F.col("_day") + halo)
    facts = facts.withColumn("_tile", F.explode(F.sequence(tile(F.col("_day")), last)))
    # aliases: `asked` may descend from `daily`, whose columns cogroup would mix up with these
    names = asked.columns
    asked = asked.select(bucket, day.alias("_day"), *[F.col(f"`{c}`").alias(c) for c in names]).withColumn("_tile", tile(F.col("_day")))
    schema = ", ".join(f"`{c}` {asked.schema[c].dataType.simpleString()}" for c in names) + ", r_total double, r_mean double, r_days int"

    def block(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out, start = right[names].copy(), int(key[1]) * tile_days - halo
        ids = pd.MultiIndex.from_frame(right[["device_key", "metric"]])
        entities = ids.unique()
        mine = entities.get_indexer(pd.MultiIndex.from_frame(left[["device_key", "metric"]])) if len(left) else np.array([], int)
        row, col, widths = entities.get_indexer(ids), right["_day"].to_numpy() - start - halo, right["window_days"].to_numpy()
        totals, counts = np.zeros(len(right)), np.zeros(len(right))
        bands = {w: band(int(w), halo, tile_days) for w in np.unique(widths)}
        for a in range(0, len(entities), DENSE_ENTITIES):
            n = min(DENSE_ENTITIES, len(entities) - a)
            values, present = dense(left, np.where((mine >= a) & (mine < a + n), mine - a, -1), n, start, halo + tile_days)
            here = (row >= a) & (row < a + n)
            for w, b in bands.items():
                m = here & (widths == w)
                if m.any():
                    totals[m], counts[m] = (values @ b)[row[m] - a, col[m]], (present @ b)[row[m] - a, col[m]]
        out["r_total"], out["r_mean"], out["r_days"] = totals, totals / np.maximum(widths, 1), counts.astype("int32")
        return out

    return facts.groupBy("_bucket", "_tile").cogroup(asked.groupBy("_bucket", "_tile")).applyInPandas(block, schema)


def _running(facts: DataFrame, points: DataFrame, tile, tile_days: int) -> DataFrame:
    """(key..., t, n) of signed points: sign times the sum and number of values before `_day`."""
    tiled = facts.withColumn("_tile", tile(F.col("_day")))
    names = ["device_key", "metric", "date", "window_days", "sign", "_day"]
    schema = ", ".join(f"`{c}` {points.schema[c].dataType.simpleString()}" for c in names[:4]) + ", t double, n double"

    def block(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        ids = pd.MultiIndex.from_frame(right[["device_key", "metric"]])
        entities = ids.unique()
        mine = entities.get_indexer(pd.MultiIndex.from_frame(left[["device_key", "metric"]])) if len(left) else np.array([], int)
        row, col, sign = entities.get_indexer(ids), right["_day"].to_numpy() - int(key[1]) * tile_days, right["sign"].to_numpy()
        totals, counts = np.zeros(len(right)), np.zeros(len(right))
        before = band(tile_days, 0, tile_days)
        for a in range(0, len(entities), DENSE_ENTITIES):
            n = min(DENSE_ENTITIES, len(entities) - a)
            values, present = dense(left, np.where((mine >= a) & (mine < a + n), mine - a, -1), n, int(key[1]) * tile_days, tile_days)
            here = (row >= a) & (row < a + n)
            totals[here], counts[here] = (values @ before)[row[here] - a, col[here]], (present @ before)[row[here] - a, col[here]]
        return right[names[:4]].assign(t=totals * sign, n=counts * sign)

    inside = tiled.groupBy("_bucket", "_tile").cogroup(points.groupBy("_bucket", "_tile")).applyInPandas(block, schema)
    # the tiles before: a row per entity and tile that has days, joined on the entity and summed
    w = Window.partitionBy("device_key", "metric").orderBy("_tile").rowsBetween(Window.unboundedPreceding, 0)
    sums = tiled.groupBy("device_key", "metric", "_tile").agg(F.sum("value").alias("v"), F.count("value").alias("c"))
    upto = sums.select("device_key", "metric", (F.col("_tile") + 1).alias("_tile"), F.lit(None).cast("string").alias("x"), F.sum("v").over(w).alias("t"), F.sum("c").over(w).cast("double").alias("n"))
    # the latest running total at or before a point's tile: union and last, no join of ranges
    marks = points.select("device_key", "metric", "_tile", F.struct("date", "window_days", "sign").alias("p"))
    both = upto.select("device_key", "metric", "_tile", F.lit(0).alias("_o"), F.struct("t", "n").alias("s"), F.lit(None).cast(marks.schema["p"].dataType).alias("p"))
    both = both.unionByName(marks.select("device_key", "metric", "_tile", F.lit(1).alias("_o"), F.lit(None).cast(both.schema["s"].dataType).alias("s"), "p"))
    order = Window.partitionBy("device_key", "metric").orderBy("_tile", "_o").rowsBetween(Window.unboundedPreceding, 0)
    earlier = both.withColumn("s", F.last("s", ignorenulls=True).over(order)).filter("p is not null and s is not null")
    earlier = earlier.select("device_key", "metric", "p.date", "p.window_days", (F.col("s.t") * F.col("p.sign")).alias("t"), (F.col("s.n") * F.col("p.sign")).alias("n"))
    return inside.unionByName(earlier)


def every_day(daily: DataFrame, windows: list[int]) -> DataFrame:
    """The (device_key, metric, date, window_days) of all days from an entity's first to the day after its last."""
    span = daily.filter("device_key is not null and metric is not null and date is not null").groupBy("device_key", "metric").agg(F.min("date").alias("a"), F.max("date").alias("b"))
    days = span.select("device_key", "metric", F.explode(F.sequence("a", F.date_add("b", 1))).alias("date"))
    return days.withColumn("window_days", F.explode(F.array(*[F.lit(w) for w in windows])))
