import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.llm import mixing, packing


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=80))
def test_every_item_once_and_none_too_full(sizes):
    windows = packing.fill(sizes, 100)
    assert sorted(i for w in windows for i in w) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in w) <= 100 for w in windows)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=60), st.integers(1, 12))
def test_differencing_keeps_sums(sizes, k):
    sums, members = packing.differencing(sizes, k)
    assert len(sums) <= k and sums == sorted(sums, reverse=True)
    assert [sum(sizes[i] for i in packing.flatten(m)) for m in members] == sums


def test_near_equal_and_tight():
    sizes = [(i * 7919) % 300 + 20 for i in range(400)]
    windows = packing.fill(sizes, 2048)
    assert sum(sizes) / (2048 * len(windows)) > 0.95


def test_assignment(spark):
    items = spark.createDataFrame([(1, "trace", 0, 250), (1, "trace", 1, 40), (2, "ctx", 0, 100), (3, "ctx", 0, 0), (4, "ctx", 0, None)], "record_id bigint, field_name string, part_index int, n_chars int")
    boxes = spark.createDataFrame([("small", 100), ("large", 1000), ("none", 0)], "container string, capacity_chars int")
    keys = ["record_id", "field_name", "part_index"]
    a = packing.assign(items, keys, boxes)
    by = {}
    for r in a.collect():
        by.setdefault((r.container, r.window_id), []).append(r.chars)
    assert all(sum(v) <= {"small": 100, "large": 1000}[k[0]] for k, v in by.items())
    assert sorted(r.chars for r in a.filter("container = 'small'").collect()) == [40, 50, 100, 100, 100]
    report = {r.container: (r.n_windows, r.unused) for r in packing.fill_report(a).collect()}
    assert report == {"small": (4, 10), "large": (1, 610)}
    assert packing.assign(items.limit(0), keys, boxes).count() == 0 and packing.assign(items, keys, boxes.limit(0)).count() == 0


def test_permutation_is_one():
    for n in (1, 2, 3, 100, 1000):
        at = np.arange(n)
        got = mixing.permute(at, np.full(n, n), np.full(n, 12345))
        assert sorted(got.tolist()) == list(range(n))
    assert mixing.permute(np.arange(1000), np.full(1000, 1000), np.full(1000, 1)).tolist() != mixing.permute(np.arange(1000), np.full(1000, 1000), np.full(1000, 2)).tolist()


def test_shard_counts_add_up():
    c = mixing.shard_counts([100, 7, 0, 1000], 9, 3)
    assert c.sum(0).tolist() == [100, 7, 0, 1000] and c.min() >= 0
    assert max(c.sum(1)) - min(c.sum(1)) <= 9


def test_mix(spark):
    rows = [(i, "big", 100) for i in range(2000)] + [(5000 + i, "small", 100) for i in range(50)] + [(9000, None, 100), (9001, "big", None)]
    records = spark.createDataFrame(rows, "record_id bigint, family string, chars bigint")
    targets = spark.createDataFrame([("m", "BIG ", 3.0, 1, 0.5), ("m", "small", 1.0, 4, 0.5), ("m", "absent", 1.0, 4, 0.5), ("n", "small", 1.0, 2, 0.01)], "mix_name string, source_family string, target_weight double, max_repeats int, size_ratio double")
    uses, plan = mixing.draw(records, targets)
    got = {(r.mix_name, r.source_family): r for r in mixing.shares(uses, plan).collect()}
    size = 205100 * 0.5
    assert abs(got["m", "big"].actual_chars - 0.6 * size) <= 1024 and got["m", "big"].most_uses == 1
    assert got["m", "small"].actual_chars == 50 * 4 * 100 and got["m", "small"].most_uses == 4 and got["m", "small"].short_chars > 0
    assert got["m", "absent"].actual_chars == 0 and got["m", "absent"].available_chars == 0
    assert abs(got["n", "small"].actual_chars - 2051) <= 512
    per = uses.groupBy("mix_name", "family", "record_id", "use_no").count()
    assert per.filter("count > 1").count() == 0
    assert sorted(map(tuple, uses.collect())) == sorted(map(tuple, mixing.draw(records, targets)[0].collect()))  # repeatable


def test_mix_of_nothing(spark):
    records = spark.createDataFrame([], "record_id bigint, family string, chars bigint")
    targets = spark.createDataFrame([("m", "a", 1.0, 1, 0.5)], "mix_name string, source_family string, target_weight double, max_repeats int, size_ratio double")
    uses, plan = mixing.draw(records, targets)
    assert uses.count() == 0 and mixing.shares(uses, plan).collect()[0].actual_chars == 0
    uses, plan = mixing.draw(records, targets.limit(0))
    assert uses.count() == 0 and plan == []
