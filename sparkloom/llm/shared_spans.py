"""Long verbatim spans shared between records."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import chaining, kmers
from sparkloom.session import cut_lineage

#: Texts of a bucket up to which its pairs are made in one join; members of a class of copies up to which these are paired among themselves.
FULL_PAIRS = 64
#: Texts of a block of a larger bucket; its pairs are made block by block.
BLOCK = 256
#: Texts of a block whose passages are looked for, which takes longer; small, so that there are many tasks.
PASSAGE_BLOCK = 64
#: Characters of a block of texts that a task holds against another block; a longer text makes its own.
BLOCK_CHARS = 1 << 22
SEED_BYTES = 256
#: Rows of six numbers that may be sent to every task.
BROADCAST_ROWS = 200_000
#: Pairs of places one repeated seed gives two texts; beyond, the whole area of its repeats is searched.
REPEATS = 64
#: Codes between two anchors beyond which a passage ends.
GAP = 256


def with_digest(df: DataFrame, id_column: str, text_column: str, span: int) -> DataFrame:
    """(doc_id, digest, digest2, text) of the rows whose text is long enough to share a span."""
    t = df[text_column]
    out = df.select(df[id_column].alias("doc_id"), F.xxhash64(t).alias("digest"), F.xxhash64(F.lit(7), t).alias("digest2"), t.alias("text"))
    return out.filter(F.col("doc_id").isNotNull() & (F.length("text") >= span))


def seeds(texts: DataFrame, span: int) -> DataFrame:
    """(h, digest, doc_id): winnowed k-mers; any shared span of ``span`` code points holds one in both texts."""
    k = min(SEED_BYTES, max(1, span * 2 // 3))
    w = span - k + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, digests = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            text = batch.column(2).cast(pa.large_binary())
            offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
            data = np.frombuffer(text.buffers()[2], np.uint8)
            for first, last in kmers.blocks(offsets, 1 << 20):
                base = offsets[first]
                codes = data[base : offsets[last]]
                edges = offsets[first : last + 1] - base
                at, h = kmers.winnow(codes, edges[:-1], edges[1:], k, w)
                row = np.searchsorted(edges, at, side="right") - 1 + first
                # a k-mer repeated within one text is one seed
                new = np.ones(len(at), bool)
                order = np.lexsort((h, row))
                new[order[1:]] = (h[order[1:]] != h[order[:-1]]) | (row[order[1:]] != row[order[:-1]])
                row, h = row[new], h[new]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), pa.array(digests[row]), pa.array(ids[row])], ["h", "digest", "doc_id"]
                )

    return texts.select("doc_id", "digest", "text").mapInArrow(run, "h bigint, digest bigint, doc_id bigint")


def _positions(text: str, k: int, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first, last) of every winnowed k-mer of the text's bytes, in code points that lie wholly inside it."""
    data = np.frombuffer(text.encode(), np.uint8)
    at, h = kmers.winnow(data, np.array([0]), np.array([len(data)]), k, w)
    if len(data) == len(text):
        return h, at, at + k
    starts = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]  # code points begun before each byte
    return h, starts[at], starts[at + k]


def _counted(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it is counted as small; beyond, the join shuffles."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _hot_contexts(texts: DataFrame, hot: DataFrame, span: int) -> DataFrame:
    """(h, c, d, doc_id, first, last): occurrences of hot seeds with two hashes of what surrounds them.

    The surroundings reach half a span to either side, and at least a span in
    all, so texts with equal surroundings share a span.
    """
    k = min(SEED_BYTES, max(1, span * 2 // 3))
    w = span - k + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                h, first, last = _positions(text, k, w)
                low = np.maximum(0, first - span // 2)
                high = np.minimum(len(text), np.maximum(last + span // 2, low + span))
                low = np.maximum(0, np.minimum(low, high - span))
                both = [hashlib.blake2b(text[s:e].encode(), digest_size=16).digest() for s, e in zip(low.tolist(), high.tolist())]
                both = np.frombuffer(b"".join(both), np.int64).reshape(-1, 2)
                columns = [h.view(np.int64), both[:, 0], both[:, 1], np.full(len(h), doc_id, np.int64), first, last]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["h", "c", "d", "doc_id", "first", "last"])

    under = texts.join(_counted(hot.select("doc_id").distinct()), "doc_id", "left_semi")
    out = under.select("doc_id", "text").mapInArrow(run, "h bigint, c bigint, d bigint, doc_id bigint, first bigint, last bigint")
    out = out.join(_counted(hot.select("h").distinct()), "h", "left_semi")
    return out.groupBy("h", "c", "d", "doc_id").agg(F.min(F.struct("first", "last")).alias("at")).select("h", "c", "d", "doc_id", "at.first", "at.last")


def _window_groups(texts: DataFrame, hot: DataFrame, span: int) -> DataFrame:
    """(h, g, doc_id): groups of texts that share a span under a hot seed; any two texts that do so are in one.

    Texts with equal surroundings of a seed are one class and one group,
    however long their common passage is. Where a seed has several classes, as
    at the ends of a passage, one text a class gives the windows of ``span``
    code points around the seed; classes that share a window are one group.
    So the rows grow with hot seeds times texts, not with the characters.
    """
    seen = cut_lineage(_hot_contexts(texts, hot, span))
    classes = seen.groupBy("h", "c", "d").agg(F.min(F.struct("doc_id", "first", "last")).alias("one"), F.count(F.lit(1)).alias("n"))
    several = classes.groupBy("h").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("h")
    ones = classes.join(several, "h", "left_semi").select("h", "c", "d", F.col("one.doc_id").alias("doc_id"), F.col("one.first").alias("first"), F.col("one.last").alias("last"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [batch.column(i).to_pylist() for i in range(6)]
            for h, c, d, first, last, text in zip(*rows):
                low, high = max(0, last - span), min(len(text), first + span)
                codes = np.frombuffer(text[low:high].encode("utf-32-le"), "<u4")
                v, at = np.unique(kmers.window_hashes(codes, span), return_index=True)
                g = kmers.window_hashes(codes + np.uint32(0x110000), span)[at]  # numbers beyond Unicode hash anew
                columns = [v.view(np.int64), g.view(np.int64), *(np.full(len(v), x, np.int64) for x in (h, c, d))]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["v", "g", "h", "c", "d"])

    windows = texts.select("doc_id", "text").join(_counted(ones), "doc_id").select("h", "c", "d", "first", "last", "text").mapInArrow(run, "v bigint, g bigint, h bigint, c bigint, d bigint")
    windows = cut_lineage(windows)
    code = F.xxhash64(F.lit(13), "c", "d")
    shared = windows.groupBy("h", "v", "g").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("c", "d")).alias("x"), F.bit_xor(code).alias("y")).filter("n > 1")
    # neighbouring windows mostly lie in the same classes; one of them is enough
    shared = shared.groupBy("h", "n", "x", "y").agg(F.min(F.struct("v", "g")).alias("w")).select("h", "w.v", "w.g")
    joined = windows.join(shared, ["h", "v", "g"]).join(seen.select("h", "c", "d", "doc_id"), ["h", "c", "d"]).select(F.col("v").alias("h"), "g", "doc_id")
    alike = seen.join(classes.filter("n > 1").select("h", "c", "d"), ["h", "c", "d"], "left_semi").select(F.col("c").alias("h"), F.col("d").alias("g"), "doc_id")
    return joined.unionByName(alike).distinct()


def _bucket_pairs(members: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs (a, b) within buckets (keys, doc_id) that the caller has bounded by FULL_PAIRS."""
    left = members.select(*keys, F.col("doc_id").alias("a"))
    right = members.select(*keys, F.col("doc_id").alias("b"))
    return left.join(right, keys).filter("a < b").select("a", "b")


def _block_pairs(members: DataFrame, keys: list[str]) -> DataFrame:
    """All pairs (a, b), a < b, within buckets (keys, doc_id, n) of any size n: block i against every block j >= i.

    No task holds more than BLOCK texts or so against as many, however large the bucket.
    """
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    m = members.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    left = m.select(*keys, F.col("own").alias("i"), F.explode(F.sequence("own", F.col("blocks") - 1)).alias("j"), F.col("doc_id").alias("a"))
    right = m.select(*keys, F.explode(F.sequence(F.lit(0), F.col("own"))).alias("i"), F.col("own").alias("j"), F.col("doc_id").alias("b"))
    pairs = left.join(right, [*keys, "i", "j"]).filter("i < j OR a < b")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _shared_seeds(texts: DataFrame, span: int) -> DataFrame:
    """(h, doc_id, n): the class representatives under each seed that n > 1 of them have."""
    raw = seeds(texts, span)
    # few seeds are in more than one text; computing them anew for these costs less than keeping all
    several = raw.groupBy("h").agg(F.min("digest").alias("least"), F.max("digest").alias("most")).filter("least <> most").select("h")
    occ = cut_lineage(raw.join(several, "h").groupBy("h", "digest").agg(F.min("doc_id").alias("doc_id")))
    return occ.select("h", "doc_id").join(occ.groupBy("h").agg(F.count(F.lit(1)).alias("n")), "h")


def candidate_pairs(texts: DataFrame, span: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(to compare, sure, stars): pairs (a, b), a < b, of class representatives.

    Copies fall together before the buckets are formed, so a hot group of
    copies is one member. A bucket of more than FULL_PAIRS different texts is
    taken apart by the hashes of the full windows of ``span`` code points of
    its texts. A window in up to FULL_PAIRS texts gives all their pairs to
    compare. One in more gives all pairs as sure, without a look at the texts
    again: 128 bits of hash are equal. The stars are, of each such window, the
    least doc_id with every member; comparing these is enough to tell which
    places of the members are shared.
    """
    occ = _shared_seeds(texts, span)
    cold = _bucket_pairs(occ.filter(F.col("n") <= FULL_PAIRS), ["h"])
    hot = occ.filter(F.col("n") > FULL_PAIRS)
    wide = _window_groups(texts, hot, span)
    code = F.xxhash64(F.lit(11), "doc_id")
    sizes = wide.groupBy("h", "g").agg(
        F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("a"), F.bit_xor(F.xxhash64("doc_id")).alias("x"), F.bit_xor(code).alias("y")
    ).filter("n > 1")
    # neighbouring windows mostly lie in the same texts; one window of a set of texts gives its pairs
    sizes = sizes.groupBy("n", "a", "x", "y").agg(F.min(F.struct("h", "g")).alias("w")).select("w.h", "w.g", "n", "a")
    wide = cut_lineage(wide.join(sizes, ["h", "g"]))
    few = _bucket_pairs(wide.filter(F.col("n") <= FULL_PAIRS), ["h", "g"])
    many = wide.filter(F.col("n") > FULL_PAIRS)
    stars = many.filter(F.col("a") < F.col("doc_id")).select("a", F.col("doc_id").alias("b"))
    return cold.unionByName(few).distinct(), _block_pairs(many, ["h", "g"]).distinct(), stars.distinct()


def _runs(flags: np.ndarray, span: int) -> list[tuple[int, int]]:
    """Code point ranges covered by the flagged windows."""
    at = np.flatnonzero(flags)
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > 1)
    firsts, lasts = at[np.r_[0, cut + 1]], at[np.r_[cut, len(at) - 1]]
    out: list[tuple[int, int]] = []
    for s, e in zip(firsts.tolist(), (lasts + span).tolist()):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], e)
        else:
            out.append((s, e))
    return out


def _places(codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(places by hash, different hashes, first place of each, number of places) of the winnowed k-mers of a text."""
    at, h = kmers.winnow(codes, np.array([0]), np.array([len(codes)]), k, k)
    order = np.argsort(h, kind="stable")
    return at[order], *np.unique(h[order], return_index=True, return_counts=True)


def anchors_of(x: tuple, y: tuple, k: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int, int]]]:
    """(places in x, places in y, areas of repeats) of the winnowed k-mers both texts have, by the _places of each.

    A seed gives all pairs of its places up to REPEATS of them. One repeated
    more often gives its first and last places and the area it spreads over.
    """
    (ax, ux, fx, nx), (ay, uy, fy, ny) = x, y
    _, px, py = np.intersect1d(ux, uy, assume_unique=True, return_indices=True)
    fx, nx, fy, ny = fx[px], nx[px], fy[py], ny[py]
    single = (nx == 1) & (ny == 1)
    left, right, areas = [ax[fx[single]]], [ay[fy[single]]], []
    for i in np.flatnonzero(~single):
        mine, theirs = ax[fx[i] : fx[i] + nx[i]], ay[fy[i] : fy[i] + ny[i]]
        if len(mine) * len(theirs) > REPEATS:
            areas.append((int(mine[0]), int(mine[-1]) + k, int(theirs[0]), int(theirs[-1]) + k))
            mine, theirs = mine[[0, -1]], theirs[[0, -1]]
        left.append(np.repeat(mine, len(theirs)))
        right.append(np.tile(theirs, len(mine)))
    return np.concatenate(left), np.concatenate(right), areas


def aligned(cx: np.ndarray, cy: np.ndarray) -> int:
    """Codes of a gap between two anchors that stay in order on both sides (longest common subsequence)."""
    if not len(cx) or not len(cy):
        return 0
    row = np.zeros(len(cy) + 1, np.int32)
    for c in cx:
        new = row.copy()
        new[1:] = np.maximum(row[1:], row[:-1] + (cy == c))
        row = np.maximum.accumulate(new)
    return int(row[-1])


def fuzzy_passages(cx: np.ndarray, cy: np.ndarray, ax: np.ndarray, ay: np.ndarray, path: list[int], k: int, span: int) -> list[tuple]:
    """(first_a, last_a, first_b, last_b, codes kept) of a chain, taken apart at gaps of more than GAP codes."""
    out, run = [], [path[0]]
    for p in [*path[1:], None]:
        if p is not None and max(ax[p] - ax[run[-1]], ay[p] - ay[run[-1]]) <= k + GAP:
            run.append(p)
            continue
        kept = k
        for a, b in zip(run, run[1:]):
            dx, dy = int(ax[b] - ax[a]), int(ay[b] - ay[a])
            if dx == dy and dx <= k:
                kept += dx
            elif dx <= k or dy <= k:  # overlapping anchors on two diagonals
                kept += min(dx, dy, k)
            else:
                kept += aligned(cx[ax[a] + k : ax[b]], cy[ay[a] + k : ay[b]]) + k
        first, last = run[0], run[-1]
        passage = (int(ax[first]), int(ax[last]) + k, int(ay[first]), int(ay[last]) + k, kept)
        if min(passage[1] - passage[0], passage[3] - passage[2]) >= span // 2:
            out.append(passage)
        run = [p]
    return out


def _chain_passages(cx: np.ndarray, cy: np.ndarray, ax: np.ndarray, ay: np.ndarray, found: list[tuple[float, list[int]]], k: int, span: int) -> list[tuple]:
    """The passages of all chains of more than an anchor."""
    return [p for score, path in found if score >= 2 * k for p in fuzzy_passages(cx, cy, ax, ay, path, k, span)]


def compare(x: str, y: str, span: int, fuzzy: bool = False) -> dict:
    """Verbatim spans of two texts inside the areas their chains of seeds propose; fuzzy adds the aligned passages.

    Of any 2k - 1 consecutive shared codes one k-mer is a seed in both texts,
    so every shared span of ``span`` codes holds anchors, each anchor is in a
    chain, and the span lies within ``span`` codes of it. Only these areas are
    searched for windows that both texts have.
    """
    cx, cy = (np.frombuffer(t.encode("utf-32-le"), "<u4") for t in (x, y))
    k = max(4, span // 12)
    ax, ay, areas = anchors_of(_places(cx, k), _places(cy, k), k)
    found = chaining.chains(ax, ay, k)
    for _, path in found:
        areas.append((int(ax[path].min()), int(ax[path].max()) + k, int(ay[path].min()), int(ay[path].max()) + k))
    wx, wy = kmers.window_hashes(cx, span), kmers.window_hashes(cy, span)
    in_x, in_y = np.zeros(len(wx), bool), np.zeros(len(wy), bool)
    for x0, x1, y0, y1 in areas:
        sx, sy = slice(max(0, x0 + k - span), x1 - k + 1), slice(max(0, y0 + k - span), y1 - k + 1)
        a, b = wx[sx], wy[sy]
        in_x[sx] |= np.isin(a, b)
        in_y[sy] |= np.isin(b, a)
    spans_x, spans_y = _runs(in_x, span), _runs(in_y, span)
    if spans_x and not any(x[s : s + span] in y for s, _ in spans_x):  # a hash met by chance
        spans_x, spans_y = [], []
    passages = _chain_passages(cx, cy, ax, ay, found, k, span) if fuzzy else []
    return {"passages": passages, "spans_a": spans_x, "spans_b": spans_y}


_PASSAGE = ["first_a", "last_a", "first_b", "last_b", "kept"]


def compare_pairs(texts: DataFrame, pairs: DataFrame, span: int, fuzzy: bool = False) -> DataFrame:
    """(a, b, spans_a, spans_b) of each pair, fuzzy adds passages; the texts meet in one shuffle."""
    need = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("doc_id"))
    both = need.join(texts.select("doc_id", "text"), "doc_id")
    both = both.groupBy("a", "b").agg(
        F.min(F.when(F.col("doc_id") == F.col("a"), F.col("text"))).alias("x"),
        F.min(F.when(F.col("doc_id") == F.col("b"), F.col("text"))).alias("y"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
        parts = pa.list_(pa.struct([(n, pa.int64()) for n in _PASSAGE]))
        for batch in batches:
            out = [compare(x, y, span, fuzzy) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            columns = [pa.array([[{"first": s, "last": e} for s, e in o[key]] for o in out], ranges) for key in ("spans_a", "spans_b")]
            names = ["a", "b", "spans_a", "spans_b"]
            if fuzzy:
                columns.append(pa.array([[dict(zip(_PASSAGE, p)) for p in o["passages"]] for o in out], parts))
                names.append("passages")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names)

    spans_type = "array<struct<first:bigint,last:bigint>>"
    schema = f"a bigint, b bigint, spans_a {spans_type}, spans_b {spans_type}"
    if fuzzy:
        schema += ", passages array<struct<" + ",".join(f"{n}:bigint" for n in _PASSAGE) + ">>"
    return both.mapInArrow(run, schema)


def _block_passages(texts: DataFrame, hot: DataFrame, span: int) -> DataFrame:
    """(a, b, first_a, last_a, first_b, last_b, kept) of all pairs a < b of the texts (h, doc_id, n) under a seed, however many.

    Seeds of the same texts are one set. A set is cut into blocks, and a task
    holds one block against one, so each text is sent once for every block and
    its places are worked out once a task. A pair that several sets hold is
    compared in the least of them.
    """
    k = max(4, span // 12)
    code = F.xxhash64(F.lit(11), "doc_id")
    sets = hot.groupBy("h", "n").agg(F.min("doc_id").alias("a"), F.bit_xor(F.xxhash64("doc_id")).alias("x"), F.bit_xor(code).alias("y"))
    members = cut_lineage(hot.select("h", "doc_id").join(sets.groupBy("n", "a", "x", "y").agg(F.min("h").alias("h")).select("h"), "h"))
    under = texts.select("doc_id", "text").join(_counted(members.select("doc_id").distinct()), "doc_id", "left_semi")
    sized = members.join(under.groupBy("doc_id").agg(F.max(F.length("text")).alias("n_chars")), "doc_id")
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / PASSAGE_BLOCK, F.sum("n_chars") / BLOCK_CHARS)).cast("int")
    m = members.join(sized.groupBy("h").agg(blocks.alias("blocks")), "h").withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    cells = m.select("h", "doc_id", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    cells = cells.select("h", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "doc_id")
    own_sets = members.groupBy("doc_id").agg(F.collect_list("h").alias("sets"))
    cells = cells.join(own_sets, "doc_id").join(under, "doc_id")
    cells = cells.repartition(4 * texts.sparkSession.sparkContext.defaultParallelism, "h", "i", "j")  # few bytes, much work: the optimizer would join the tasks
    names = ["a", "b", *_PASSAGE]

    def run(cell: pa.Table) -> pa.Table:
        h, i, j = (cell.column(n)[0].as_py() for n in ("h", "i", "j"))
        held: dict[int, tuple] = {}
        for doc_id, own, among, text in zip(*(cell.column(n).to_pylist() for n in ("doc_id", "own", "sets", "text"))):
            if doc_id not in held or text < held[doc_id][2]:  # of a text delivered in two forms the lesser, as in compare_pairs
                held[doc_id] = (own, frozenset(among), text)
        ids, out, rows = sorted(held), [], []
        codes = {d: np.frombuffer(held[d][2].encode("utf-32-le"), "<u4") for d in ids}
        places = {d: _places(codes[d], k) for d in ids}

        def keep() -> None:
            columns = np.array(rows, np.int64).reshape(-1, len(names)).T
            out.append(pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names))
            rows.clear()

        for at, a in enumerate(ids):
            for b in ids[at + 1 :]:
                if (i != j and held[a][0] == held[b][0]) or min(held[a][1] & held[b][1]) != h:
                    continue
                ax, ay, _ = anchors_of(places[a], places[b], k)
                rows.extend((a, b, *p) for p in _chain_passages(codes[a], codes[b], ax, ay, chaining.chains(ax, ay, k), k, span))
            if len(rows) > 10_000:
                keep()
        keep()
        return pa.Table.from_batches(out)

    return cells.groupBy("h", "i", "j").applyInArrow(run, ", ".join(f"{n} bigint" for n in names))


def passages(texts: DataFrame, span: int, least_kept: float = 0.8) -> DataFrame:
    """(doc_id_a, doc_id_b, first_a, last_a, first_b, last_b, kept_ratio): passages that two texts share up to edits.

    Chains of all pairs of class representatives that have a seed in common,
    aligned in the gaps between their anchors; of at least half a span, with at
    least ``least_kept`` of the longer side kept. Seeds in up to FULL_PAIRS
    texts give single pairs, those in more are compared in blocks.
    """
    occ = _shared_seeds(texts, span)
    out = compare_pairs(texts, _bucket_pairs(occ.filter(F.col("n") <= FULL_PAIRS), ["h"]).distinct(), span, fuzzy=True)
    out = out.select("a", "b", F.explode("passages").alias("p")).select("a", "b", "p.*").unionByName(_block_passages(texts, occ.filter(F.col("n") > FULL_PAIRS), span))
    out = out.withColumnsRenamed({"a": "doc_id_a", "b": "doc_id_b"})
    ratio = F.col("kept") / F.greatest(F.col("last_a") - F.col("first_a"), F.col("last_b") - F.col("first_b"))
    return out.withColumn("kept_ratio", ratio).filter(F.col("kept_ratio") >= least_kept).drop("kept").distinct()


def _shared(texts: DataFrame, pairs: DataFrame, span: int) -> DataFrame:
    """compare_pairs, kept where a verbatim span is shared."""
    return compare_pairs(texts, pairs, span).filter(F.size("spans_a") > 0)


def representative_links(texts: DataFrame, span: int) -> DataFrame:
    """(a, b), a < b: all pairs of class representatives that share a verbatim span."""
    compared, sure, _ = candidate_pairs(texts, span)
    return _shared(texts, compared.join(sure, ["a", "b"], "left_anti"), span).select("a", "b").unionByName(sure)


def copy_classes(texts: DataFrame) -> DataFrame:
    """(class_id, doc_id, n) for every document whose text occurs more than once; class_id is the least doc_id.

    Hot groups of copies are counted with partial sums; no group is collected.
    """
    ids = texts.select("doc_id", "digest", "digest2").distinct()
    sizes = ids.groupBy("digest", "digest2").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return ids.join(sizes, ["digest", "digest2"]).select("class_id", "doc_id", "n")


def document_pairs(texts: DataFrame, span: int) -> DataFrame:
    """(doc_id_a, doc_id_b) of documents that share a span of at least ``span`` code points.

    Links between different texts are written in full, for all members of both
    classes of copies. Copies among themselves give all pairs up to FULL_PAIRS
    members, beyond that the representative with every member.
    Null and shorter texts share nothing; rows repeating a doc_id count once.
    """
    classes = copy_classes(texts)
    small = classes.filter(F.col("n") <= FULL_PAIRS)
    links = representative_links(texts, span)
    for side in ("a", "b"):
        members = classes.select(F.col("class_id").alias(side), F.col("doc_id").alias("m"))
        links = links.join(members, side, "left").withColumn(side, F.coalesce("m", side)).drop("m")
    one = small.select("class_id", F.col("doc_id").alias("a"))
    two = small.select("class_id", F.col("doc_id").alias("b"))
    inner = one.join(two, "class_id").filter("a < b").select("a", "b")
    star = classes.filter((F.col("n") > FULL_PAIRS) & (F.col("class_id") < F.col("doc_id")))
    star = star.select(F.col("class_id").alias("a"), F.col("doc_id").alias("b"))
    out = links.select("a", "b").unionByName(inner).unionByName(star)
    return out.select(F.least("a", "b").alias("doc_id_a"), F.greatest("a", "b").alias("doc_id_b")).filter("doc_id_a < doc_id_b").distinct()


def shared_amounts(texts: DataFrame, span: int) -> DataFrame:
    """(doc_id, class_id, n_copies, n_links, n_chars, shared_chars, shared_ratio) of the documents that share a span.

    shared_chars counts each character once however many documents share it;
    n_links counts the different texts the document is linked to.
    """
    compared, sure, stars = candidate_pairs(texts, span)
    links = _shared(texts, compared.unionByName(stars).distinct(), span)
    sides = links.select(F.col("a").alias("rep"), F.col("b").alias("other"), F.col("spans_a").alias("spans")).unionByName(
        links.select(F.col("b").alias("rep"), F.col("a").alias("other"), F.col("spans_b").alias("spans"))
    )
    # union of ranges per text: a range counts from where the ranges before it end
    ranges = sides.select("rep", "other", F.explode("spans").alias("s")).select("rep", "other", "s.first", "s.last")
    distinct = ranges.select("rep", "first", "last").distinct()
    from pyspark.sql import Window

    w = Window.partitionBy("rep").orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1)
    covered = distinct.withColumn("seen", F.coalesce(F.max("last").over(w), F.lit(0)))
    covered = covered.groupBy("rep").agg(F.sum(F.greatest(F.lit(0), F.col("last") - F.greatest("first", "seen"))).alias("shared_chars"))
    linked = links.select("a", "b").unionByName(sure).distinct()
    linked = linked.select(F.col("a").alias("rep")).unionByName(linked.select(F.col("b").alias("rep")))
    degree = linked.groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))
    classes = copy_classes(texts).withColumnRenamed("n", "n_copies")
    docs = texts.groupBy("doc_id").agg(F.max(F.length("text")).alias("n_chars"))
    return (
        docs.join(classes, "doc_id", "left")
        .withColumn("class_id", F.coalesce("class_id", "doc_id"))
        .join(covered.join(degree, "rep").withColumnRenamed("rep", "class_id"), "class_id", "left")
        .filter(F.col("n_copies").isNotNull() | F.col("shared_chars").isNotNull())
        .select(
            "doc_id", "class_id", F.coalesce("n_copies", F.lit(1)).alias("n_copies"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.col("n_chars").cast("bigint").alias("n_chars"),
            F.when(F.col("n_copies").isNotNull(), F.col("n_chars")).otherwise(F.col("shared_chars")).cast("bigint").alias("shared_chars"),
        )
        .withColumn("shared_ratio", F.col("shared_chars") / F.col("n_chars"))
    )
