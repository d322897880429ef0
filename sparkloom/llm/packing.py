"""Containers of fixed capacity filled by multiway differencing."""

from __future__ import annotations

from bisect import insort
from heapq import heapify, heappop, heapreplace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.session import cut_lineage

#: Windows of a group, about; a group is packed by one task, so this bounds its size however many items there are.
GROUP_WINDOWS = 192
#: Rows of the container table that may be read to the driver.
MOST_CONTAINERS = 1000


def differencing(sizes: list[int], k: int) -> tuple[list[int], list]:
    """Karmarkar-Karp: (sums, members as nested pairs) of k parts, nearly equal.

    A partial partition is kept as its filled parts (-sum, members), largest
    first; the rest are empty. The two partitions of widest spread are merged,
    the largest part of one with the smallest of the other. A partition of one
    item is put in at its place, without sorting the other anew.
    """
    if not sizes:
        return [], []
    state = [(-s, i, [(-s, i)]) for i, s in enumerate(sizes)]
    heapify(state)
    tick = len(sizes)
    while len(state) > 1:
        _, _, parts = heappop(state)
        _, _, others = state[0]
        if len(parts) < len(others):
            parts, others = others, parts
        if len(others) == 1:
            value, member = others[0]
            if len(parts) == k:
                low, least = parts.pop()
                value, member = value + low, (member, least)
            insort(parts, (value, member), key=_first)
        else:
            over = len(parts) + len(others) - k
            if over <= 0:
                parts = parts + others
            else:
                # the last `over` parts of one meet those of the other, smallest with largest of these
                a, b = len(parts) - over, len(others)
                parts = parts[:a] + others[: b - over] + [(parts[a + i][0] + others[b - 1 - i][0], (parts[a + i][1], others[b - 1 - i][1])) for i in range(over)]
            parts.sort(key=_first)
        spread = parts[0][0] - (parts[-1][0] if len(parts) == k else 0)
        tick += 1
        heapreplace(state, (spread, tick, parts))
    return [-s for s, _ in state[0][2]], [m for _, m in state[0][2]]


def _first(pair: tuple) -> int:
    return pair[0]


def flatten(member) -> list[int]:
    out, stack = [], [member]
    while stack:
        m = stack.pop()
        if isinstance(m, tuple):
            stack += m
        else:
            out.append(m)
    return out


def fill(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows of item numbers, none above capacity; their count starts at the least possible and rises until all fit."""
    total, large = sum(sizes), sum(s * 2 > capacity for s in sizes)
    k = max(1, -(-total // capacity), large)
    while True:
        sums, members = differencing(sizes, k)
        if not sums or sums[0] <= capacity:
            return [flatten(m) for m in members]
        k += 1


def pieces(items: DataFrame, key_columns: list[str], containers: list[tuple[str, int]]) -> DataFrame:
    """Items of every container: chunks of an item above its capacity, else the item whole; the items are gone through once."""
    n = F.col("n_chars")
    each = F.array(*[F.struct(F.lit(name).alias("container"), F.lit(capacity).alias("capacity")) for name, capacity in containers])
    if not containers:
        each = F.array().cast("array<struct<container:string,capacity:int>>")
    out = items.filter(n > 0).select(*key_columns, "n_chars", F.explode(each).alias("__c")).select(*key_columns, "n_chars", "__c.container", "__c.capacity")
    out = out.withColumn("chunk_index", F.explode(F.sequence(F.lit(0), ((n - 1) / F.col("capacity")).cast("int"))))
    return out.select("container", "capacity", *key_columns, "chunk_index", F.least(F.col("capacity"), n - F.col("chunk_index") * F.col("capacity")).cast("int").alias("chars"))


def assign(items: DataFrame, key_columns: list[str], containers: DataFrame) -> DataFrame:
    """Every piece of every item with its window, for each container.

    ``items`` has key_columns, unique together, and n_chars; items without
    characters or with null length have nothing to place. An item longer than
    the capacity is cut into full windows and a rest. Pieces are spread over
    groups by hash, so a group holds a random cut of all lengths and about
    GROUP_WINDOWS windows; groups are packed independently. Only lengths are
    kept and shuffled, so the texts are read once. Result: container, capacity,
    key_columns, chunk_index, chars, window_id; chunk c of an item starts at
    character c * capacity.
    """
    rows = containers.select("container", "capacity_chars").filter("container IS NOT NULL AND capacity_chars > 0").distinct().limit(MOST_CONTAINERS + 1).collect()
    if len(rows) > MOST_CONTAINERS:
        raise ValueError("too many containers")
    named = sorted((r[0], int(r[1])) for r in rows)
    out = pieces(cut_lineage(items), key_columns, named)
    full = out.filter("chars = capacity").withColumn("window_id", F.concat_ws("/", F.lit("full"), *key_columns, "chunk_index"))
    loose = out.filter("chars < capacity")
    # groups per container, from the total length
    totals = {(r[0], r[1]): r[2] for r in loose.groupBy("container", "capacity").agg(F.sum("chars")).collect()}
    groups = F.lit(1)
    for name, capacity in named:
        n = max(1, round(totals.get((name, capacity), 0) / (capacity * GROUP_WINDOWS)))
        groups = F.when((F.col("container") == name) & (F.col("capacity") == capacity), F.lit(n)).otherwise(groups)
    loose = loose.withColumn("grp", F.pmod(F.xxhash64(*key_columns, "chunk_index"), groups))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("chars", "descending"), *((k, "ascending") for k in key_columns), ("chunk_index", "ascending")])
        windows = fill(table.column("chars").to_pylist(), table.column("capacity")[0].as_py())
        group = table.column("grp")[0].as_py()
        ids = [""] * table.num_rows
        for w, members in enumerate(windows):
            for m in members:
                ids[m] = f"{group}/{w}"
        return table.drop_columns(["grp"]).append_column("window_id", pa.array(ids, pa.string()))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in loose.schema if f.name != "grp")
    packed = loose.groupBy("container", "capacity", "grp").applyInArrow(run, schema + ", window_id string")
    return full.unionByName(packed)


def fill_report(assigned: DataFrame) -> DataFrame:
    """Per container: windows, characters, unused space and the least number of windows there could be."""
    windows = assigned.groupBy("container", "capacity", "window_id").agg(F.sum("chars").alias("chars"), F.count(F.lit(1)).alias("n"))
    return windows.groupBy("container", "capacity").agg(
        F.count(F.lit(1)).alias("n_windows"), F.sum("n").alias("n_pieces"), F.sum("chars").alias("chars"), F.max("chars").alias("fullest"),
        F.sum(F.col("capacity") - F.col("chars")).alias("unused"), F.ceil(F.sum("chars") / F.first("capacity")).alias("least_windows"),
        (F.sum("chars") / F.sum(F.col("capacity").cast("double"))).alias("fill"),
    )
