"""Lexer, vocabulary, encoding with byte fallback, and token ownership."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.text import BLANKS

#: The lexer's alternation, in order. Every character belongs to a token.
LEXER = (
    r"(?s)<\|[a-zA-Z0-9_]+\|>|[A-Za-z_][A-Za-z0-9_]*|[0-9]+\.[0-9]+|[0-9]+|==|!=|<=|>=|->|=>|::|//|/\*|\*/|\.\.\.|```|@@|---|\+\+\+"
    r"|[ \t\n\r\f\x0B]+|."
)
#: Special tokens in the order of their ids.
SPECIALS = ["<pad>", "<bos>", "<eos>", "<unk>", "<|system|>", "<|user|>", "<|assistant|>", "<|tool|>", "<|tool_result|>", "<|repo_context|>", "<|patch|>", "<|test_output|>", "<|final|>"]
FIRST_BYTE = len(SPECIALS)
FIRST_LEARNED = FIRST_BYTE + 256
#: White space tokens longer than this, without a newline, are never learned.
LONGEST_BLANK = 8
#: A vocabulary of up to this many rows (a few MB) may be sent to all executors.
BROADCAST_ROWS = 200_000


def lex(c: Column) -> Column:
    """ARRAY<STRING> whose concatenation is the text; null for null."""
    return F.regexp_extract_all(c, F.lit(LEXER), F.lit(0))


def tokens(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, token), pos from 0."""
    return df.select(key, F.posexplode(lex(F.col(text))).alias("pos", "token"))


def frequencies(df: DataFrame, key: str, text: str) -> DataFrame:
    """(token, n, first) over all rows; first is the least (key, pos). Sums are formed per task before the shuffle."""
    return tokens(df, key, text).groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(key, "pos")).alias("first"))


def vocabulary(freq: DataFrame, size: int, least: int = 1) -> DataFrame:
    """(token, id, n) of learned tokens, most frequent first, earlier-seen first among equals; ids follow specials and bytes.

    Only as many rows as the vocabulary has are ranked: a top-n comes before
    the window.
    """
    room = max(0, size - FIRST_LEARNED)
    t = F.col("token")
    # the optimizer runs this on every token, so the cheap test comes first
    blank = (F.length(t) > LONGEST_BLANK) & ~F.contains(t, F.lit("\n")) & (F.trim(F.regexp_replace(t, r"[ \t\n\r\f\x0B]", "")) == "")
    top = freq.filter((F.col("n") >= least) & ~blank & ~t.isin(*SPECIALS)).orderBy(F.col("n").desc(), F.col("first").asc()).limit(room)
    rank = F.row_number().over(Window.orderBy(F.col("n").desc(), F.col("first").asc()))
    return top.select("token", (F.lit(FIRST_LEARNED - 1) + rank).cast("bigint").alias("id"), "n")


def with_specials(learned: DataFrame) -> DataFrame:
    """(token, id) of the whole vocabulary: specials, byte tokens, learned ones."""
    spark = learned.sparkSession
    specials = spark.createDataFrame([(t, i) for i, t in enumerate(SPECIALS)], "token string, id bigint")
    bytes_ = spark.range(256).select(F.concat(F.lit("<0x"), F.lpad(F.hex("id"), 2, "0"), F.lit(">")).alias("token"), (F.col("id") + FIRST_BYTE).alias("id"))
    return specials.unionByName(bytes_).unionByName(learned.select("token", "id"))


def byte_ids(token: Column) -> Column:
    """ARRAY<BIGINT> of the byte tokens of a token's UTF-8 bytes."""
    digits = F.hex(token.cast("binary"))
    steps = F.sequence(F.lit(1), F.length(digits), F.lit(2))
    return F.transform(steps, lambda i: F.conv(F.substring(digits, i, F.lit(2)), 16, 10).cast("bigint") + FIRST_BYTE)


def lookup(vocab: DataFrame, rows: int | None) -> DataFrame:
    """(token, id), broadcast where its row bound is known and small; else the join strategy is the optimizer's."""
    v = vocab.select("token", "id")
    return F.broadcast(v) if rows is not None and rows <= BROADCAST_ROWS else v


def encode(tok: DataFrame, vocab: DataFrame, vocab_rows: int | None = None) -> DataFrame:
    """tok (…, token) with ids ARRAY<BIGINT>: the vocabulary's id, or the bytes of an unknown token.

    vocab_rows is a bound on the vocabulary's rows, such as its size
    parameter; up to BROADCAST_ROWS the tokens then stay where they are.
    """
    return tok.join(lookup(vocab, vocab_rows), "token", "left").withColumn("ids", F.when(F.col("id").isNotNull(), F.array("id")).otherwise(byte_ids(F.col("token"))))


def encode_documents(df: DataFrame, key: str, text: str, vocab: DataFrame, vocab_rows: int | None = None) -> DataFrame:
    """(key, ids) in text order. Each distinct token of a document meets the vocabulary once."""
    coded = encode(tokens(df, key, text), vocab, vocab_rows)
    ordered = F.array_sort(F.collect_list(F.struct("pos", "ids")))
    return coded.groupBy(key).agg(F.flatten(F.transform(ordered, lambda s: s["ids"])).alias("ids"))


def decode(ids: DataFrame, key: str, vocab: DataFrame, vocab_rows: int | None = None) -> DataFrame:
    """(key, tokens) for (key, ids); unknown ids are left out. ``decode_tokens`` turns tokens into text."""
    flat = ids.select(key, F.posexplode("ids").alias("pos", "id")).join(lookup(vocab, vocab_rows), "id")
    return flat.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda s: s["token"]).alias("tokens"))


def ownership(segments: Column, owned: tuple[str, ...]) -> Column:
    """STRUCT<total, owned>: tokens of all segments, and of those whose tag is owned; the tag's line counts with its segment."""
    sizes = F.transform(
        segments,
        lambda s: F.struct(
            F.size(lex(F.concat(F.lit("<|"), s["tag"], F.lit("|>\n"), s["body"], F.lit("\n")))).cast("bigint").alias("n"), s["tag"].isin(*owned).alias("own")
        ),
    )
    zero = F.lit(0).cast("bigint")
    return F.struct(
        F.aggregate(sizes, zero, lambda a, s: a + s["n"]).alias("total"), F.aggregate(sizes, zero, lambda a, s: a + F.when(s["own"], s["n"]).otherwise(F.lit(0))).alias("owned")
    )


def loss_mask(pieces: Column) -> Column:
    """ARRAY<STRUCT<token, own>>: every token of a rendering with whether the model is scored on it.

    ``pieces`` are ARRAY<STRUCT<body, own>> in rendering order; they are joined
    by a newline, blanks at the end are cut and one newline closes the text. A
    token is owned if any of its characters is. A piece begins with its tag and
    ends in a newline, so no token but the white space behind a piece meets the
    next one, and that white space is the piece's own as far as it reaches.
    """
    n = F.size(pieces)

    def spell(p: Column, i: Column) -> Column:
        text = F.when(i < n - 1, F.concat(p["body"], F.lit("\n"))).otherwise(F.concat(F.regexp_replace(p["body"], f"{BLANKS}+$", ""), F.lit("\n")))
        return F.transform(lex(text), lambda t: F.struct(t.alias("token"), p["own"].alias("own")))

    return F.flatten(F.transform(pieces, spell))


def masked_ids(df: DataFrame, key: str, masked: str, vocab: DataFrame, vocab_rows: int | None = None) -> DataFrame:
    """(key, pos, ids, own) of every token of ``masked``; all bytes of an unknown token share its mask."""
    flat = df.select(key, F.posexplode(masked).alias("pos", "m")).select(key, "pos", "m.token", "m.own")
    return encode(flat, vocab, vocab_rows).select(key, "pos", "ids", "own")


def suppressed_ids(vocab: DataFrame) -> DataFrame:
    """(token, id) of the special tokens that are never sampled inside a text: all but the end."""
    return vocab.filter(F.col("token").isin(*[t for t in SPECIALS if t != "<eos>"])).select("token", "id")
