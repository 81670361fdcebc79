"""Change feed to current state: per-key ordered replay of inserts, partial updates and deletes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalframe.operators.delivery import canonical_uuid, hyphenated

FIELDS = ["hk_type", "metric", "value", "text_value", "unit", "start_ts", "end_ts", "source_name"]


def changes(batches: DataFrame) -> DataFrame:
    """Explodes batches into (key, at, op, batch_id, place, fields...), one row per change of a uuid.

    at: microseconds of the instant in sent_at, received_at (as UTC) where that can't be read, before all others where
    both are missing. op: 0 upsert, 1 delete;
    within one batch deletions follow samples. Samples without a uuid, blank deletions and null or empty lists give nothing.
    """
    at = F.coalesce(F.unix_micros(F.expr("try_to_timestamp(sent_at)")), F.unix_micros(F.col("received_at").cast("timestamp")), F.lit(-(1 << 62)))
    base = batches.select("batch_id", "delivery_no", at.alias("at"), "samples", "deleted")
    none = [F.lit(None).cast("string").alias(f) for f in FIELDS]
    up = base.select("batch_id", "delivery_no", "at", F.posexplode("samples").alias("place", "x"))
    up = up.select(F.col("x.uuid").alias("raw"), "at", F.lit(0).alias("op"), "batch_id", "delivery_no", "place", *[F.col(f"x.{f}").alias(f) for f in FIELDS])
    down = base.select("batch_id", "delivery_no", "at", F.posexplode("deleted").alias("place", "raw"))
    down = down.select("raw", "at", F.lit(1).alias("op"), "batch_id", "delivery_no", "place", *none)
    return up.unionByName(down).withColumn("key", canonical_uuid(F.col("raw"))).filter("key is not null").drop("raw")


#: A change's place in the order of a key: instant, batch, operation (deletions follow samples), position in the batch's list.
SEQUENCE = ["at", "batch_id", "op", "place"]


def _states(rows: pa.Table, fields: list[str]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Runs the state machine of all keys of `rows`, sorted by key and SEQUENCE, at once.

    Returns the starts of the keys and, for each, the row of its last delete (`dead`), its last upsert after that (`up`) and the
    last upsert after that which sets each field; -1 for none. Of a change repeated with the same sequence the first is
    applied, the others are skipped.
    """
    n = rows.num_rows
    same = lambda c: pc.fill_null(pc.equal(rows[c].slice(1), rows[c].slice(0, n - 1)), False).to_numpy().astype(bool) | pc.and_(pc.is_null(rows[c].slice(1)), pc.is_null(rows[c].slice(0, n - 1))).to_numpy().astype(bool)
    new = np.concatenate([[True], ~same("key")])
    again = ~new
    for c in SEQUENCE:
        again[1:] &= same(c)
    starts = np.flatnonzero(new)
    at, delete = np.arange(n), rows["op"].to_numpy() == 1
    latest = lambda ok: np.maximum.reduceat(np.where(ok & ~again, at, -1), starts)
    dead = latest(delete)
    live = ~delete & (at > dead[np.cumsum(new) - 1])
    out = {"dead": dead, "up": latest(live)}
    for f in fields:
        out[f] = latest(live & rows[f].is_valid().to_numpy().astype(bool))
    return starts, out


def _by_key(batches: Iterator[pa.RecordBatch], fields: list[str], finish) -> Iterator[pa.RecordBatch]:
    """Walks sorted rows; of the key that may go on in the next batch only the rows that still matter are carried over."""
    carried = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        rows = pa.concat_tables([carried, rows]).combine_chunks() if carried is not None else rows
        starts, found = _states(rows, fields)
        open_from = starts[-1]
        keep = np.unique(np.concatenate([x[-1:] for x in found.values()]))
        carried = rows.take(pa.array(keep[keep >= open_from]))
        if open_from:
            yield from finish(rows.slice(0, open_from), starts[:-1], {k: x[:-1] for k, x in found.items()}).to_batches()
    if carried is not None and carried.num_rows:
        yield from finish(carried.combine_chunks(), *_states(carried, fields)).to_batches()


def replay(feed: DataFrame, fields: list[str]) -> DataFrame:
    """(key, alive, at, batch_id, fields...): the state of each key after its changes in order of SEQUENCE.

    A state machine walks each partition's rows sorted by key and sequence: an upsert revives a key and sets the columns it
    carries (null leaves a column as it is: a partial update), a delete clears it; a sequence that was applied already (a
    redelivery) is skipped. batch_id and at are those of the last upsert, or of the delete. It runs on whole Arrow batches, all
    keys at once, and carries the state of one key from batch to batch.

    Replay is done in two rounds. The first runs before the shuffle, on the partitions as they are read: it drops the changes
    that later ones of the same partition override, which leaves of each key at most one row a column, so a hot key is spread over all
    tasks and the second round gets few rows of it. The second repartitions by key and replays what is left.
    """
    rows = feed.select("key", *SEQUENCE, *fields)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def standing(rows: pa.Table, starts: np.ndarray, found: dict[str, np.ndarray]) -> pa.Table:
        keep = np.unique(np.concatenate(list(found.values())))
        return rows.take(pa.array(keep[keep >= 0]))

    def states(rows: pa.Table, starts: np.ndarray, found: dict[str, np.ndarray]) -> pa.Table:
        pick = lambda name, at: rows[name].take(pa.array(at, mask=at < 0))
        alive = found["up"] >= 0
        last = np.where(alive, found["up"], found["dead"])
        return pa.table({"key": rows["key"].take(pa.array(starts)), "alive": pa.array(alive), "at": pick("at", last), "batch_id": pick("batch_id", last), **{f: pick(f, found[f]) for f in fields}})

    first = rows.sortWithinPartitions("key", *SEQUENCE).mapInArrow(lambda it: _by_key(it, fields, standing), kinds)
    result = "key string, alive boolean, at long, batch_id string, " + ", ".join(f"`{f}` {rows.schema[f].dataType.simpleString()}" for f in fields)
    return first.repartition("key").sortWithinPartitions("key", *SEQUENCE).mapInArrow(lambda it: _by_key(it, fields, states), result)


def current_state(batches: DataFrame) -> DataFrame:
    """(hk_uuid, batch_id, fields...): the samples alive after all changes, uuids in lower case with hyphens."""
    state = replay(changes(batches), FIELDS).filter("alive")
    return state.select(hyphenated(F.col("key")).alias("hk_uuid"), "batch_id", *FIELDS)
