"""Mixes of sources at target shares of size, with capped repeats."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.session import cut_lineage

#: Characters of a block, about; a record stands in the block in which it begins.
BLOCK_CHARS = 512
#: Rows of a part of a family's order, about, for its running sums.
PART_ROWS = 50_000
#: Slots generated from one driver row.
SEGMENT = 1 << 20
#: Rows of the target table that may be read to the driver.
MOST_TARGETS = 10_000
#: Size of an output shard, and the most shards of a mix; a mix beyond both has larger shards.
SHARD_CHARS, MOST_SHARDS = 1 << 20, 10_000


def _seed(*parts) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(map(str, parts)).encode(), digest_size=8).digest(), "big") >> 1


def permute(at: np.ndarray, n: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Pseudorandom permutation of 0..n-1 per seed, by a Feistel network walked until the value falls below n."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out = at.astype(np.uint64)
    todo = np.ones(len(at), bool)
    while todo.any():
        x, h, m, s = out[todo], half[todo], mask[todo], seed[todo].astype(np.uint64)
        left, right = x >> h, x & m
        for r in range(4):
            f = (right + np.uint64(r + 1)) * np.uint64(0x9E3779B97F4A7C15) ^ s
            f ^= f >> np.uint64(29)
            f *= np.uint64(0xBF58476D1CE4E5B9)
            f ^= f >> np.uint64(32)
            left, right = right, left ^ (f & m)
        out[todo] = (left << h) | right
        todo = out >= n.astype(np.uint64)
    return out.astype(np.int64)


def shard_counts(slots: list[int], shards: int, seed: int) -> np.ndarray:
    """Counts per shard and source: multinomial draws by what each source has left, held to it.

    What a draw exceeds of one source goes to those that have most left, so
    every shard is full and every source's slots are dealt out, at any size.
    """
    rng = np.random.default_rng(seed)
    left = np.array(slots, np.int64)
    out = np.zeros((shards, len(slots)), np.int64)
    for i in range(shards):
        total = int(left.sum())
        take = -(-total // (shards - i))
        if total == 0:
            break
        draw = np.minimum(left, rng.multinomial(take, left / total))
        for j in np.argsort(draw - left):  # most left first
            more = min(take - int(draw.sum()), int(left[j] - draw[j]))
            draw[j] += more
        out[i] = draw
        left -= draw
    return out


def parts_for(rows: int) -> int:
    """Parts for running sums over so many rows: a part holds about PART_ROWS, whatever their number."""
    return max(1, -(-rows // PART_ROWS))


def blocks_of(records: DataFrame, block_chars: int, parts: int) -> DataFrame:
    """(family, block, record_id, chars): records in pseudorandom order, cut into blocks of fixed length.

    Running sums go over ``parts`` hash parts of each family, then within a
    part, so no window holds a whole family.
    """
    h = F.xxhash64(F.lit(0), "record_id")
    r = records.withColumn("h", h).withColumn("part", F.pmod(F.shiftright("h", 20), F.lit(parts)))
    sums = r.groupBy("family", "part").agg(F.sum("chars").alias("s"))
    before = F.sum("s").over(Window.partitionBy("family").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("family", "part", F.coalesce(before, F.lit(0)).alias("offset"))
    inner = F.sum("chars").over(Window.partitionBy("family", "part").orderBy("h", "record_id").rowsBetween(Window.unboundedPreceding, -1))
    r = r.withColumn("inner", F.coalesce(inner, F.lit(0))).join(sums, ["family", "part"])
    return r.select("family", F.floor((F.col("offset") + F.col("inner")) / block_chars).cast("bigint").alias("block"), "record_id", "chars")


def targets_of(targets: DataFrame) -> list[dict]:
    """Rows of the target table with cleaned families; of a family named twice in a mix the weights add up."""
    t = targets.select("mix_name", F.lower(F.trim("source_family")).alias("family"), "target_weight", "max_repeats", "size_ratio")
    t = t.filter("mix_name IS NOT NULL AND family IS NOT NULL AND family <> '' AND target_weight > 0 AND size_ratio > 0")
    t = t.groupBy("mix_name", "family").agg(F.sum("target_weight").alias("weight"), F.max("max_repeats").alias("max_repeats"), F.max("size_ratio").alias("size_ratio"))
    rows = [r.asDict() for r in t.limit(MOST_TARGETS + 1).collect()]
    if len(rows) > MOST_TARGETS:
        raise ValueError("too many mixture targets")
    sums: dict[str, float] = {}
    for r in sorted(rows, key=lambda r: (r["mix_name"], r["family"])):
        sums[r["mix_name"]] = sums.get(r["mix_name"], 0.0) + r["weight"]
    return [r | {"share": r["weight"] / sums[r["mix_name"]]} for r in rows]


def draw(records: DataFrame, targets: DataFrame, *, seed: int = 17, block_chars: int = BLOCK_CHARS) -> tuple[DataFrame, list[dict]]:
    """(uses, plan). uses: mix_name, family, record_id, use_no, shard, chars; plan: a dict per mix and family.

    ``records`` has record_id, family and chars, one row per distinct record;
    a null family is in no mix but counts for the size. A family's quota is its
    share of the mix's size. It is filled with whole passes over the family,
    each in its own pseudorandom order of blocks, and a last pass that ends
    where the quota is reached, to within half a block; after max_repeats
    passes it ends in any case. A family without records gets nothing, and
    what a family falls short isn't given to others: their shares are of the
    mix's size. Slots are dealt to shards by multinomial counts.
    """
    spark = records.sparkSession
    wanted = targets_of(targets)
    families = {t["family"] for t in wanted}
    records = cut_lineage(records.select("record_id", "family", "chars"))  # narrow rows; the texts are read once
    rows, size = records.agg(F.count(F.lit(1)), F.coalesce(F.sum("chars"), F.lit(0))).collect()[0]
    known = cut_lineage(blocks_of(records.filter(F.col("chars").isNotNull() & (F.col("chars") > 0) & F.col("family").isin(sorted(families))), block_chars, parts_for(rows)))
    facts = {r["family"]: r for r in known.groupBy("family").agg(F.sum("chars").alias("chars"), (F.max("block") + 1).alias("n"), F.count(F.lit(1)).alias("records")).collect()}
    plan, segments = [], []
    for i, t in enumerate(sorted(wanted, key=lambda t: (t["mix_name"], t["family"]))):
        f = facts.get(t["family"])
        quota = t["share"] * t["size_ratio"] * size
        have, n = (f["chars"], f["n"]) if f else (0, 0)
        repeats = max(0, t["max_repeats"] or 0)
        passes = min(repeats, int(quota // have)) if have else 0
        rest = quota - passes * have if passes < repeats and have else 0.0
        plan.append(t | {"cell": i, "quota": quota, "available": have, "records": f["records"] if f else 0, "blocks": n, "passes": passes, "rest": rest})
        for e in range(passes + (rest > 0)):
            key = _seed(seed, t["mix_name"], t["family"], e)
            segments += [(i, t["family"], e, e == passes, float(rest), n, key, a, min(n, a + SEGMENT)) for a in range(0, n, SEGMENT)]
    schema = "cell int, family string, use_no int, partial boolean, rest double, n bigint, key bigint, first bigint, last bigint"
    slots = spark.createDataFrame(segments, schema)
    slots = slots.withColumn("p", F.explode(F.sequence("first", F.col("last") - 1))).drop("first", "last")

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, n, key = (b.column(c).to_numpy() for c in ("p", "n", "key"))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(permute(at, n, key) if len(at) else at)], [*b.schema.names, "block"])

    named = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in slots.schema)
    slots = slots.mapInArrow(index, f"{named}, block bigint")
    sizes = known.groupBy("family", "block").agg(F.sum("chars").alias("block_chars"))
    # the last pass: running sums of its blocks, over parts of the order and within a part
    last = slots.filter("partial").join(sizes, ["family", "block"]).withColumn("part", F.floor(F.col("p") / PART_ROWS))
    sums = last.groupBy("cell", "part").agg(F.sum("block_chars").alias("s"))
    before = F.sum("s").over(Window.partitionBy("cell").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("cell", "part", F.coalesce(before, F.lit(0)).alias("offset"))
    running = F.sum("block_chars").over(Window.partitionBy("cell", "part").orderBy("p"))
    last = last.withColumn("inner", running).join(sums, ["cell", "part"])
    last = last.filter(F.col("offset") + F.col("inner") - F.col("block_chars") / 2 <= F.col("rest"))
    keep = ["cell", "family", "use_no", "n", "p", "block"]
    kept = cut_lineage(slots.filter("NOT partial").select(*keep).unionByName(last.select(*keep)))
    used = {r["cell"]: r["m"] for r in kept.groupBy("cell").agg(F.max(F.col("use_no") * F.col("n") + F.col("p") + 1).alias("m")).collect()}
    borders: dict[int, np.ndarray] = {}
    for mix in sorted({t["mix_name"] for t in plan}):
        cells = [t["cell"] for t in plan if t["mix_name"] == mix]
        total = sum(min(t["quota"], t["available"] * max(0, t["max_repeats"] or 0)) for t in plan if t["mix_name"] == mix)
        shards = int(min(MOST_SHARDS, max(1, -(-total // SHARD_CHARS))))
        counts = shard_counts([used.get(c, 0) for c in cells], shards, _seed(seed, mix))
        borders |= {c: np.cumsum(counts[:, j]) for j, c in enumerate(cells)}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, use, n, p = (b.column(c).to_numpy() for c in ("cell", "use_no", "n", "p"))
            slot, shard = use * n + p, np.zeros(len(p), np.int32)
            for c in np.unique(cell):
                at = cell == c
                shard[at] = np.searchsorted(borders[int(c)], slot[at], side="right")
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("cell", "family", "use_no", "block")), pa.array(shard)], ["cell", "family", "use_no", "block", "shard"])

    dealt = kept.mapInArrow(deal, "cell int, family string, use_no int, block bigint, shard int")
    uses = dealt.join(known, ["family", "block"])
    names = F.create_map(*[x for t in plan for x in (F.lit(t["cell"]), F.lit(t["mix_name"]))]) if plan else F.create_map(F.lit(0), F.lit(""))
    return uses.select(names[F.col("cell")].alias("mix_name"), "family", "record_id", "use_no", "shard", "chars"), plan


def shares(uses: DataFrame, plan: list[dict]) -> DataFrame:
    """Per mix and family: target and actual share, characters, records used and the most uses of one record."""
    spark = uses.sparkSession
    got = uses.groupBy("mix_name", "family", "record_id").agg(F.count(F.lit(1)).alias("uses"), F.sum("chars").alias("chars"))
    got = got.groupBy("mix_name", "family").agg(F.sum("chars").alias("actual_chars"), F.count(F.lit(1)).alias("records_used"), F.max("uses").alias("most_uses"))
    rows = [(t["mix_name"], t["family"], t["share"], t["quota"], t["quota"] / t["share"], int(t["available"]), t["max_repeats"], max(0.0, t["quota"] - t["available"] * max(0, t["max_repeats"] or 0))) for t in plan]
    schema = "mix_name string, family string, target_share double, target_chars double, mix_chars double, available_chars bigint, max_repeats int, short_chars double"
    out = spark.createDataFrame(rows, schema).join(got, ["mix_name", "family"], "left")
    out = out.withColumn("actual_chars", F.coalesce("actual_chars", F.lit(0)))
    drawn = F.sum("actual_chars").over(Window.partitionBy("mix_name"))
    return out.select(
        "mix_name", F.col("family").alias("source_family"), "target_share", F.coalesce(F.try_divide("actual_chars", "mix_chars"), F.lit(0.0)).alias("share_of_size"),
        F.coalesce(F.try_divide(F.col("actual_chars"), drawn), F.lit(0.0)).alias("share_of_drawn"), "target_chars", "actual_chars", "available_chars", "short_chars",
        F.coalesce("records_used", F.lit(0)).alias("records_used"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"), "max_repeats",
    )
