"""Encoding of a text column into the ids of a public byte-level BPE vocabulary."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sparkloom.llm import bpe, vocabulary

#: Texts above this many characters are split lazily, so their pieces are never all in memory.
LAZY_CHARS = 1 << 20
#: Longer pieces are encoded each time instead of being kept in the memo.
MEMO_PIECE_CHARS = 256


class IdMemo(dict):
    """piece -> its ids as little-endian int32 bytes."""

    def __init__(self, encoder: bpe.RankQueueEncoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(self.encoder.encode_piece(piece.encode("utf-8")), "<i4").tobytes()
        if len(piece) <= MEMO_PIECE_CHARS:
            self[piece] = ids
        return ids


def encode_text(text: str, pattern, memo: IdMemo) -> bytes:
    if len(text) <= LAZY_CHARS:
        return b"".join(map(memo.__getitem__, pattern.findall(text)))
    pieces = (m.group() for m in pattern.finditer(text))
    out = []
    while chunk := b"".join(map(memo.__getitem__, islice(pieces, 100_000))):
        out.append(chunk)
    return b"".join(out)


def encode_column(df: DataFrame, id_column: str, text_column: str, rank_path: str | None = None) -> DataFrame:
    """(id_column, ids ARRAY<INT>) for every row of df.

    No shuffle: each task splits its texts by the vocabulary's pattern and
    encodes every piece with the rank queue, keeping short pieces in a memo of
    bounded size. Null and empty texts give an empty list, repeated rows give
    repeated results, other columns are not read. Special tokens written in a
    text are ordinary text.
    """
    raw = vocabulary.rank_file(rank_path)
    narrow = df.select(df[id_column].alias("id"), df[text_column].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        pattern = regex.compile(vocabulary.PATTERN)
        encoder = bpe.RankQueueEncoder(vocabulary.parse_ranks(raw))
        memo = IdMemo(encoder)
        for batch in batches:
            if len(memo) > bpe.MEMO_ENTRIES:
                memo = IdMemo(encoder)
            ids = batch.column(0)
            done = 0
            while done < batch.num_rows:
                texts = batch.column(1).slice(done, 1000).to_pylist()
                encoded = [encode_text(t, pattern, memo) if t else b"" for t in texts]
                offsets = np.zeros(len(texts) + 1, np.int32)
                np.cumsum([len(b) >> 2 for b in encoded], out=offsets[1:])
                values = pa.array(np.frombuffer(b"".join(encoded), "<i4"), pa.int32())
                lists = pa.ListArray.from_arrays(pa.array(offsets), values)
                yield pa.RecordBatch.from_arrays([ids.slice(done, len(texts)), lists], ["id", "ids"])
                done += len(texts)

    kind = narrow.schema["id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_column)
