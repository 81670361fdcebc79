import uuid

import pytest
from pyspark.sql import functions as F

from vitalframe.operators.delivery import DeliveryStore, StoreConflict, batch_keys, canonical_uuid, hyphenated, sample_keys

U = "31cb086b-c244-4fe5-9cd0-b046570b51db"
SAMPLES = "row_id long, sample_id string, hk_uuid string, key string"


def surplus(spark, rows, tmp_path, **kw):
    df = spark.createDataFrame([(*r, "x") for r in rows], SAMPLES)
    store = DeliveryStore(spark, str(tmp_path / uuid.uuid4().hex))
    return sorted(r.no for r in store.admit(sample_keys(df), "no", "keys", "origin", **kw).collect())


def brute(rows):
    seen, out = set(), []
    for no, sid, u in sorted(rows):
        plain = (u or "").strip().lower().removeprefix("urn:uuid:").strip("{}").replace("-", "")
        ids = {("s", sid)} if sid and sid.strip() else set()
        if len(plain) == 32 and set(plain) != {"0"} and set(plain) <= set("0123456789abcdef"):
            ids.add(("u", plain))
        if ids & seen:
            out.append(no)
        seen |= ids
    return out


@pytest.mark.parametrize("text,same", [(U, True), (U.upper(), True), ("{" + U + "}", True), ("urn:uuid:" + U, True), (U.replace("-", ""), True), (f"  {U} ", True), ("unknown", False), ("", False), (None, False), ("00000000-0000-0000-0000-000000000000", False), (U[:-1], False)])
def test_uuid_spellings(spark, text, same):
    got = spark.createDataFrame([(text,)], "t string").select(canonical_uuid(F.col("t")).alias("u")).first().u
    assert got == (U.replace("-", "") if same else None)


def test_hyphenated(spark):
    assert spark.createDataFrame([(U.replace("-", ""),)], "t string").select(hyphenated(F.col("t"))).first()[0] == U


def test_surplus_against_brute_force(spark, tmp_path):
    import random

    rng = random.Random(3)
    ids = [str(uuid.UUID(int=rng.getrandbits(128))) for _ in range(40)]
    spell = [str, str.upper, lambda u: "{" + u + "}", lambda u: u.replace("-", ""), lambda u: None, lambda u: "unknown"]
    # a third of all rows carry one identifier
    rows = [(i, "ch2:" + f"{(0 if rng.random() < 0.3 else rng.randrange(60)):040x}" if rng.random() < 0.9 else rng.choice([None, "", "odd id"]), rng.choice(spell)(ids[0 if rng.random() < 0.3 else rng.randrange(40)])) for i in range(1, 400)]
    assert surplus(spark, rows, tmp_path) == brute(rows)


def test_empty_null_and_ties(spark, tmp_path):
    assert surplus(spark, [], tmp_path) == []
    assert surplus(spark, [(1, None, None), (2, None, ""), (3, " ", "unknown")], tmp_path) == []
    long = "x" * 5000
    assert surplus(spark, [(1, long, None), (2, long, None), (3, long + "y", None)], tmp_path) == [2]


def test_batches_and_origins_do_not_mix(spark, tmp_path):
    s = spark.createDataFrame([(1, "b1", None, "")], SAMPLES)
    b = spark.createDataFrame([(1, "b1"), (2, "b1"), (3, None), (4, None), (5, "")], "delivery_no long, batch_id string")
    store = DeliveryStore(spark, str(tmp_path / "o"))
    got = store.admit(sample_keys(s).unionByName(batch_keys(b)), "no", "keys", "origin").collect()
    assert [(r.origin, r.no) for r in got] == [("batches", 2)]


def arrivals(spark, rows):
    return sample_keys(spark.createDataFrame([(*r, "") for r in rows], SAMPLES))


def test_later_batches_and_replay(spark, tmp_path):
    store = DeliveryStore(spark, str(tmp_path / "s"))
    got = lambda rows, **kw: sorted(r.no for r in store.admit(arrivals(spark, rows), "no", "keys", **kw).collect())
    assert got([(1, "a", U), (2, "b", None)], batch="one") == []
    second = [(3, "a", None), (4, "c", U.upper()), (5, "d", None), (6, "d", None)]
    assert got(second, batch="two") == [3, 4, 6]
    version = store.version()
    assert got(second, batch="two") == [3, 4, 6] and store.version() == version  # replayed after its commit
    assert got([(7, "c", None), (8, "d", None), (9, "e", None)]) == [7, 8]
    bits = store.bits().selectExpr("sum(bitmap_count(bitmap)) as n").first().n
    assert bits == 6  # a, U, b, c, d, e


def test_replay_of_an_old_batch_keeps_what_came_after(spark, tmp_path):
    store = DeliveryStore(spark, str(tmp_path / "r"))
    got = lambda rows, name: sorted(r.no for r in store.admit(arrivals(spark, rows), "no", "keys", batch=name).collect())
    first = [(1, "a", None), (2, "b", None)]
    assert got(first, "1") == [] and got([(3, "c", None)], "2") == [] and got([(4, "d", None)], "3") == []
    assert got(first, "1") == []
    assert got([(5, "c", None), (6, "a", None)], "4") == [5, 6]


def test_crash_between_steps(spark, tmp_path, monkeypatch):
    """What was encoded but not admitted isn't seen: the bits decide, not the dictionary."""
    store = DeliveryStore(spark, str(tmp_path / "c"))
    commit, calls = DeliveryStore._commit, []

    def dies(self, state, **changes):
        calls.append(changes)
        if "bits" in changes:
            raise RuntimeError("lost")
        return commit(self, state, **changes)

    monkeypatch.setattr(DeliveryStore, "_commit", dies)
    rows = [(1, "a", None), (2, "a", None), (3, "b", None)]
    with pytest.raises(RuntimeError):
        store.admit(arrivals(spark, rows), "no", "keys", batch="x")
    monkeypatch.undo()
    assert len(calls) == 2 and store.entries().count() == 2 and store.bits().count() == 0
    again = DeliveryStore(spark, str(tmp_path / "c"))
    assert [r.no for r in again.admit(arrivals(spark, rows), "no", "keys", batch="x").collect()] == [2]
    assert again.entries().count() == 2


def test_lost_marker_of_the_last_commit(spark, tmp_path):
    store = DeliveryStore(spark, str(tmp_path / "m"))
    store.admit(arrivals(spark, [(1, "a", None)]), "no", "keys", batch="x")
    store._fs.delete(store._file("batches"), True)
    assert store.admit(arrivals(spark, [(1, "a", None)]), "no", "keys", batch="x").count() == 0


def test_two_writers(spark, tmp_path):
    one, two = (DeliveryStore(spark, str(tmp_path / "w")) for _ in range(2))
    one.admit(arrivals(spark, [(1, "a", None)]), "no", "keys")
    state = two.state()
    one.admit(arrivals(spark, [(2, "b", None)]), "no", "keys")
    with pytest.raises(StoreConflict):
        two._commit(state, bits=[])
    assert one.admit(arrivals(spark, [(3, "a", None), (4, "b", None)]), "no", "keys").count() == 2


def test_small_first_batch_and_a_large_second(spark, tmp_path):
    """Shards grow in number, not in size, and a later small batch reads only its slots."""
    store = DeliveryStore(spark, str(tmp_path / "g"))
    store.admit(arrivals(spark, [(0, "id-5", None)]), "no", "keys")
    many = sample_keys(spark.range(1, 1_000_001).selectExpr("id as row_id", "concat('id-', id) as sample_id", "cast(null as string) as hk_uuid"))
    assert [r.no for r in store.admit(many, "no", "keys").collect()] == [5]
    shards = {r.shard: r.n for r in store.entries().groupBy("shard").count().withColumnRenamed("count", "n").collect()}
    assert sum(shards.values()) == 1_000_000 and max(shards.values()) < 400_000
    assert store.state()["segments"][1]["slots"] > 1
    assert [r.no for r in store.admit(arrivals(spark, [(2_000_000, "id-77", None), (2_000_001, "new", None)]), "no", "keys").collect()] == [2_000_000]


def test_slices_equal_one_batch(spark, tmp_path):
    rows = [(i, f"k{i * 7 % 23}", None) for i in range(1, 100)]
    got = [sorted(r.no for r in DeliveryStore(spark, str(tmp_path / f"n{n}")).admit(arrivals(spark, rows), "no", "keys", "origin", batch="b", slices=n).collect()) for n in (1, 3)]
    assert got[0] == got[1] == brute(rows)


def test_segments_are_merged(spark, tmp_path, monkeypatch):
    from vitalframe.operators import delivery

    monkeypatch.setattr(delivery, "SEGMENTS", 3)
    store = DeliveryStore(spark, str(tmp_path / "h"))
    for i in range(6):
        assert store.admit(arrivals(spark, [(i, f"x{i}", None)]), "no", "keys").count() == 0
    assert len(store.state()["segments"]) <= 4 and store.entries().count() == 6
    assert store.admit(arrivals(spark, [(10 + i, f"x{i}", None) for i in range(7)]), "no", "keys").count() == 6


def test_extra_columns(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", None, "k", 7), (2, "a", None, "k", 8)], "row_id long, sample_id string, hk_uuid string, shard string, bucket int")
    assert DeliveryStore(spark, str(tmp_path / "e")).admit(sample_keys(df), "no", "keys").count() == 1
