"""Irregular readings onto a regular grid by local polynomial regression with a compact kernel.

The kernel is Epanechnikov's, w(v) = 1 - (v/h)^2 on |v| <= h, with h = reach + 1/2 slots around the middle of a slot, so its
support is exactly 2*reach + 1 slots. Being a polynomial, it turns every sum of the weighted regression into a combination
of per-slot power sums. Those are plain aggregates with map-side combine: a source with a third of all readings shrinks to
one row per slot before it meets a window, and no reading is visited twice.
"""

from __future__ import annotations

from math import comb

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def regular_grid(readings: DataFrame, source: str, ts: str, value: str, step_s: int = 3600, reach: int = 2, max_gap_s: int = 7 * 86400, min_support: float = 3.0) -> DataFrame:
    """(source, slot, slot_start, n_readings, mean_value, estimate, support, mark), a row for each slot of each series.

    A series runs from a reading to the next as long as they are at most `max_gap_s` apart; a longer silence ends it and no
    slot is made there. `estimate` is the local linear fit at the middle of the slot over the readings of the slots at most
    `reach` away (their mean, weighted, where all lie at one time); `support` = (sum w)^2 / sum w^2. mark: `observed` (the
    slot has readings), `filled` (none, but support >= `min_support`), else `missing`, with estimate null.

    Rows with a null source, time or value are no readings; NaN counts as null. Readings at one time count each. An empty
    input gives an empty grid; further columns are ignored.
    """
    h2 = (reach + 0.5) ** 2
    seconds = F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(1e6)
    clean = readings.select(F.col(source).alias("source"), F.col(ts).alias("ts"), seconds.alias("s"), F.col(value).cast("double").alias("y"))
    clean = clean.filter("source is not null and s is not null and y is not null and not isnan(y)")
    clean = clean.withColumn("slot", F.floor(F.col("s") / step_s)).withColumn("u", F.col("s") / step_s - F.col("slot"))
    u, y = F.col("u"), F.col("y")
    power = lambda k: F.lit(1.0) if k == 0 else u if k == 1 else u * power(k - 1)
    sums = [F.sum(power(k)).alias(f"u{k}") for k in range(5)] + [F.sum(power(k) * y).alias(f"y{k}") for k in range(4)]
    slots = clean.groupBy("source", "slot").agg(*sums, F.count(F.lit(1)).alias("n"), F.min("s").alias("first_s"), F.max("s").alias("last_s"))
    ordered = Window.partitionBy("source").orderBy("slot")
    until = F.when(F.lead("first_s").over(ordered) - F.col("last_s") <= max_gap_s, F.lead("slot").over(ordered) - 1)
    grid = slots.withColumn("until", F.coalesce(until, F.col("slot"))).withColumn("g", F.explode(F.sequence("slot", "until")))
    names = [f"u{k}" for k in range(5)] + [f"y{k}" for k in range(4)]
    own = F.when(F.col("g") == F.col("slot"), F.struct(F.col("g"), *names))
    near = Window.partitionBy("source").orderBy("g").rangeBetween(-reach, reach)
    grid = grid.select("source", "g", F.when(F.col("g") == F.col("slot"), F.col("n")).alias("n"), F.when(F.col("g") == F.col("slot"), F.col("y0") / F.col("n")).alias("mean_value"), own.alias("own"))
    grid = grid.withColumn("near", F.collect_list("own").over(near))

    def shifted(kind: str, k: int):
        """Sum over the nearby slots of v^k (times y), where v is counted from the middle of slot g."""

        def one(x):
            c = (x["g"] - F.col("g")).cast("double") - 0.5
            terms = []
            for j in range(k + 1):
                term = x[f"{kind}{j}"] * comb(k, j)
                for _ in range(k - j):
                    term = term * c
                terms.append(term)
            return sum(terms[1:], terms[0])

        return F.aggregate(F.transform("near", one), F.lit(0.0), lambda a, b: a + b)

    grid = grid.select("source", "g", "n", "mean_value", *[shifted("u", k).alias(f"v{k}") for k in range(5)], *[shifted("y", k).alias(f"z{k}") for k in range(4)])
    grid = grid.selectExpr(
        "source", "g", "n", "mean_value",
        f"v0 - v2/{h2} as a0", f"v1 - v3/{h2} as a1", f"v2 - v4/{h2} as a2", f"z0 - z2/{h2} as b0", f"z1 - z3/{h2} as b1", f"v0 - 2*v2/{h2} + v4/{h2 * h2} as ww",
    )
    grid = grid.selectExpr("source", "g", "n", "mean_value", "a0", "b0", "a0*a2 - a1*a1 as det", "a2*b0 - a1*b1 as num", "case when ww > 1e-12 then a0*a0/ww else 0D end as support")
    fit = "case when n is null and support < {m} then null when det > 1e-9*a0*a0 then num/det when a0 > 1e-12 then b0/a0 else mean_value end".format(m=min_support)
    mark = f"case when n is not null then 'observed' when support >= {min_support} then 'filled' else 'missing' end"
    return grid.selectExpr("source", "g as slot", f"timestamp_seconds(g*{step_s}) as slot_start", "coalesce(n, 0L) as n_readings", "mean_value", f"{fit} as estimate", "support", f"{mark} as mark")
