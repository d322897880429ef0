"""Exact token totals per source, language and domain."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import bpe, vocabulary


def count_tokens(df: DataFrame, texts_column: str, rank_path: str | None = None) -> DataFrame:
    """df without texts_column (ARRAY<STRING>), with n_texts and n_tokens of it.

    Each task collects the pieces of a batch, counts the surviving symbols of
    every distinct piece once, and gives each row the sum of its pieces'
    counts, so a frequent piece costs one encoding however often it occurs.
    A null array, null texts and empty texts count as nothing.
    """
    raw = vocabulary.rank_file(rank_path)
    keys = [c for c in df.columns if c != texts_column]
    narrow = df.select(*keys, F.col(texts_column).alias("__texts"))
    out_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema if f.name != "__texts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        findall = regex.compile(vocabulary.PATTERN).findall
        ranks = vocabulary.parse_ranks(raw)

        class Symbols(dict):
            def __missing__(self, piece: str) -> int:
                n = bpe.count_symbols(piece.encode("utf-8"), ranks)
                if len(piece) <= 256:
                    self[piece] = n
                return n

        memo = Symbols()
        for batch in batches:
            if len(memo) > bpe.MEMO_ENTRIES:
                memo = Symbols()
            lists = batch.column(batch.num_columns - 1)
            totals, texts = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for row in range(batch.num_rows):
                for text in lists[row].as_py() or ():
                    if text:
                        texts[row] += 1
                        pieces = findall(text)
                        if len(pieces) > 50_000:  # long text: weight distinct pieces by their frequency
                            totals[row] += sum(memo[p] * n for p, n in Counter(pieces).items())
                        else:
                            totals[row] += sum(map(memo.__getitem__, pieces))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(texts), pa.array(totals)], [*keys, "n_texts", "n_tokens"]
            )

    return narrow.mapInArrow(run, f"{out_schema}, n_texts bigint, n_tokens bigint")


def budget(df: DataFrame, record_column: str, slice_columns: list[str], texts_column: str) -> DataFrame:
    """Token totals per slice, a record delivered twice counted once.

    Deliveries of a record share its content, so counting comes first and only
    narrow rows meet in the shuffle. Of deliveries that differ the one with the
    most tokens counts, under the least of its slices, and n_differing tells how
    many such records there are. Rows without a record id are one record each,
    equal ones being deliveries of the same.
    """
    nameless = F.when(F.col(record_column).isNull(), F.xxhash64(*slice_columns, texts_column))
    counted = count_tokens(df.select(record_column, nameless.alias("__nameless"), *slice_columns, texts_column), texts_column)
    # the least of the struct: most tokens first
    once = counted.groupBy(record_column, "__nameless").agg(
        F.min(F.struct((-F.col("n_tokens")).alias("t"), (-F.col("n_texts")).alias("n"), *slice_columns)).alias("__once"), F.max("n_tokens").alias("__most"), F.min("n_tokens").alias("__least")
    )
    return once.groupBy(*[F.col(f"__once.{c}").alias(c) for c in slice_columns]).agg(
        F.count(F.lit(1)).alias("n_records"),
        F.sum(-F.col("__once.n")).alias("n_texts"),
        F.sum(-F.col("__once.t")).alias("n_tokens"),
        F.count_if(F.col("__most") > F.col("__least")).alias("n_differing"),
    )
