import math
import random
from collections import Counter

import pytest

from vitalframe.llm import mixing

TARGETS = "source string, target_share double, max_repeats int"
RECORDS = "doc_id long, source string, n_tokens int, copy_no string"


@pytest.mark.parametrize("cap", [1, 2, 5])
@pytest.mark.parametrize("mean", [0.1, 0.5, 0.93])
def test_rate_inverts_the_capped_mean(cap, mean):
    assert math.isclose(mixing.capped_mean(mixing.rate_for(mean * cap, cap), cap), mean * cap, rel_tol=1e-6)
    assert mixing.rate_for(cap, cap) == math.inf


def corpus(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["chat", "Chat ", "CHAT"]), rng.randrange(20, 400), "x") for i in range(4000)]
    rows += [(10_000 + i, "notes", rng.randrange(20, 400), "x") for i in range(500)] + [(20_000 + i, "support-note", rng.randrange(20, 200), "x") for i in range(800)]
    rows += [(30_000, None, 50, "x"), (30_001, "elsewhere", 50, "x"), (30_002, "notes", None, "x")]
    return spark.createDataFrame(rows, RECORDS)


def test_shares_and_caps(spark):
    targets = spark.createDataFrame([("chat", 0.5, 1), ("notes", 0.3, 4), ("support_note", 0.15, 3), ("absent", 0.05, 2)], TARGETS)
    mixed = mixing.mix(corpus(spark), targets, "doc_id", "source", "n_tokens")
    rows = mixed.collect()
    used = Counter(r.doc_id for r in rows)
    caps = {"chat": 1, "notes": 4, "support_note": 3}
    assert all(n <= caps[next(r.source for r in rows if r.doc_id == d)] for d, n in list(used.items())[:300])
    assert not {30_000, 30_001} & set(used)
    got = {r.source: r for r in mixing.shares(mixed, targets, "doc_id", "n_tokens").collect()}
    for s, want in (("chat", 0.5), ("notes", 0.3), ("support_note", 0.15)):
        assert abs(got[s].actual_share - want / 0.95) < 0.01
    assert got["absent"].actual_share == 0.0
    assert math.isclose(sum(r.actual_share for r in got.values()), 1.0)
    assert [r.place for r in rows] == sorted(r.place for r in rows)
    assert rows == mixing.mix(corpus(spark).repartition(7), targets, "doc_id", "source", "n_tokens").collect()  # whatever the partitions


def test_larger_total_keeps_the_cap(spark):
    targets = spark.createDataFrame([("chat", 0.5, 1), ("notes", 0.5, 2)], TARGETS)
    mixed = mixing.mix(corpus(spark), targets, "doc_id", "source", "n_tokens", total=10**7)
    used = Counter((r.source, r.doc_id) for r in mixed.collect())
    assert {n for (s, _), n in used.items() if s == "notes"} == {2} and {n for (s, _), n in used.items() if s == "chat"} == {1}


def test_null_limit_and_zero(spark):
    targets = spark.createDataFrame([("chat", 0.5, 1), ("notes", 0.4, None), ("support_note", 0.1, 0)], TARGETS)
    mixed = mixing.mix(corpus(spark), targets, "doc_id", "source", "n_tokens")
    got = {r.source: r for r in mixing.shares(mixed, targets, "doc_id", "n_tokens", corpus(spark)).collect()}
    assert abs(got["notes"].actual_share - 0.4 / 0.9) < 0.005 and got["support_note"].copies == 0
    assert got["notes"].expected_error > 0 and got["support_note"].expected_error is None


def test_empty(spark):
    targets = spark.createDataFrame([("chat", 1.0, 1), (None, 0.5, 1)], TARGETS)
    none = corpus(spark).limit(0)
    mixed = mixing.mix(none, targets, "doc_id", "source", "n_tokens")
    assert mixed.count() == 0
    assert mixing.mix(corpus(spark), targets.limit(0), "doc_id", "source", "n_tokens").count() == 0
