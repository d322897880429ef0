import random

import numpy as np
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.llm import bpe, encode, token_budget, vocabulary

try:
    RANKS = vocabulary.parse_ranks(vocabulary.rank_file())
except FileNotFoundError:
    pytest.skip("no vocabulary files", allow_module_level=True)
ENCODER = bpe.RankQueueEncoder(RANKS)
PATTERN = regex.compile(vocabulary.PATTERN)


def naive(piece: bytes) -> list[int]:
    """Merges the pair of lowest rank, leftmost first, by looking at all pairs each time."""
    if piece in RANKS:
        return [RANKS[piece]]
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        ranks = [(RANKS[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in RANKS]
        if not ranks:
            return [RANKS[p] for p in parts]
        i = min(ranks)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_equals_naive(text):
    for piece in PATTERN.findall(text):
        raw = piece.encode()
        want = naive(raw)
        assert ENCODER.encode_piece(raw) == want
        assert bpe.count_symbols(raw, RANKS) == len(want)


def test_equals_public_library_on_long_pieces():
    tiktoken = pytest.importorskip("tiktoken")
    e = tiktoken.Encoding("own", pat_str=vocabulary.PATTERN, mergeable_ranks=RANKS, special_tokens={})
    r = random.Random(1)
    memo = encode.IdMemo(ENCODER)
    for text in ["a" * 3000, "ab" * 2000, "=" * 999, "".join(r.choice("aeioubcd") for _ in range(5000)), "<|endoftext|> x\n\n  y", "𝕏漢字é​٢"]:
        got = np.frombuffer(encode.encode_text(text, PATTERN, memo), "<i4").tolist()
        assert got == e.encode_ordinary(text)


def test_lazy_split_of_very_long_texts(monkeypatch):
    memo = encode.IdMemo(ENCODER)
    text = "some words, again and again\n" * 50
    want = encode.encode_text(text, PATTERN, memo)
    monkeypatch.setattr(encode, "LAZY_CHARS", 10)
    assert encode.encode_text(text, PATTERN, memo) == want


def test_column(spark):
    rows = [(1, "Hello world", "x"), (2, "", "y"), (3, None, None), (1, "Hello world", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")  # a column named like the result
    got = sorted((r.doc_id, r.ids) for r in encode.encode_column(df, "doc_id", "text").collect())
    assert got == [(1, [15496, 995]), (1, [15496, 995]), (2, []), (3, [])]
    assert encode.encode_column(df.limit(0), "doc_id", "text").count() == 0


def test_budget_counts_a_record_once(spark):
    rows = [(1, "a", ["Hello world", None, ""]), (1, "a", ["Hello world", None, ""]), (2, "a", None), (3, "b", ["x"]), (None, "b", ["x"])]
    df = spark.createDataFrame(rows, "r bigint, origin string, texts array<string>")
    got = sorted(tuple(x) for x in token_budget.budget(df, "r", ["origin"], "texts").collect())
    assert got == [("a", 2, 1, 2, 0), ("b", 2, 2, 2, 0)]
    assert token_budget.budget(df.limit(0), "r", ["origin"], "texts").count() == 0


def test_budget_of_nameless_and_differing_rows(spark):
    rows = [(None, "a", ["x"]), (None, "a", ["x"]), (None, "a", ["Hello world"]), (1, "a", ["Hello"]), (1, "a", ["Hello world again"]), (1, "b", None)]
    df = spark.createDataFrame(rows, "r bigint, origin string, texts array<string>")
    assert [tuple(x) for x in token_budget.budget(df, "r", ["origin"], "texts").collect()] == [("a", 3, 3, 6, 1)]


def test_long_text_weighted_by_frequency(spark):
    df = spark.createDataFrame([(1, "a", ["word again " * 30000])], "r bigint, origin string, texts array<string>")
    text = "word again " * 30000
    want = sum(len(ENCODER.encode_piece(p.encode())) for p in PATTERN.findall(text))
    assert token_budget.budget(df, "r", ["origin"], "texts").collect()[0].n_tokens == want
