"""The store of seen keys: exact, replayed safely, and read by bucket."""

import random

import pytest

from labtrail.streaming import keys


def frame(spark, values):
    return spark.createDataFrame([(str(v), v) for v in values], "content_key string, n long")


@pytest.mark.parametrize("slots", [1, 4096])
def test_batches_equal_a_set(spark, tmp_path, monkeypatch, slots):
    # one slot is nearly full, so that most keys are asked for
    monkeypatch.setattr(keys, "SLOTS", slots)
    monkeypatch.setattr(keys, "MERGE", 2)
    store, seen, rng = keys.KeyStore(spark, str(tmp_path / "store")), set(), random.Random(slots)
    for batch in range(4):
        values = [rng.randrange(3000) for _ in range(900)]
        for _ in range(2):  # each batch is replayed
            got = frame(spark, sorted(r.n for r in store.unseen(frame(spark, values), batch).collect()))
            assert [r.n for r in got.collect()] == sorted(set(values) - seen)
            store.add(got, batch)
        seen |= set(values)
    assert sorted(p.name for p in (tmp_path / "store" / "merged").iterdir() if p.is_dir()) == ["upto=1", "upto=3"]


def test_only_buckets_that_may_hold_a_key_are_opened(spark, tmp_path, monkeypatch):
    store = keys.KeyStore(spark, str(tmp_path / "store"))
    store.add(frame(spark, range(5000)), 0)
    opened = []
    read = keys.KeyStore._read
    monkeypatch.setattr(keys.KeyStore, "_read", lambda self, schema, *paths: opened.extend(p for p in paths if p.startswith("keys/")) or read(self, schema, *paths))
    assert store.unseen(frame(spark, range(10_000, 10_200)), 1).count() == 200 and len(opened) <= 2
    opened.clear()
    assert [r.n for r in store.unseen(frame(spark, [7, 20_000]), 1).collect()] == [20_000] and len(opened) == 1


def test_buckets_are_read_and_compared_at_once(spark, tmp_path):
    store = keys.KeyStore(spark, str(tmp_path / "store"))
    for batch in range(2):
        store.add(frame(spark, range(batch * 2000, batch * 2000 + 3000)), batch)
    # all 64 buckets are asked for; each had a scan and a join of its own, and one task the sorts of all
    got = store.unseen(frame(spark, range(4000, 7000)), 2)
    made = got._jdf.queryExecution().optimizedPlan().toString()
    assert made.count("Join ") == 3 and made.count("Relation [") <= 2
    assert sorted(r.n for r in got.collect()) == list(range(5000, 7000))


def test_folders_that_are_missing_hold_nothing(spark, tmp_path):
    store = keys.KeyStore(spark, str(tmp_path / "store"))
    columns = "content_key string, bucket int, batch long"
    assert store._read(columns).isEmpty() and store._read(columns, "keys/bucket=1", "keys/bucket=2").isEmpty()
    store.add(frame(spark, [7]), 0)
    paths = [f"keys/bucket={b}" for b in range(keys.BUCKETS)]
    assert [(r.content_key, r.batch) for r in store._read(columns, *paths).collect()] == [("7", 0)]


def test_bits_are_set_where_the_rows_of_a_slot_meet(spark, tmp_path):
    store = keys.KeyStore(spark, str(tmp_path / "store"))
    rows = store.hashed(frame(spark, [*range(4000)] * 2).select("content_key"))
    bits = store.built(rows)
    made = bits._jdf.queryExecution().executedPlan().toString().split("Exchange")
    assert len(made) == 2 and made[0].count("bitmap_construct_agg") == 2
    want = {(r.slot, r.bit) for r in rows.collect()}
    assert {(r.slot, byte * 8 + k) for r in bits.collect() for byte, b in enumerate(r.bits) for k in range(8) if b >> k & 1} == want
