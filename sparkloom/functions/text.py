"""Text expressions over built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: All white space a source may pad with, beyond the plain blank that trim() knows.
BLANKS = r"[\s\x1c-\x1f\u0085   -     　]"


def strip(c: Column) -> Column:
    """c without outer white space of any kind."""
    return F.regexp_replace(c, f"^{BLANKS}+|{BLANKS}+$", "")


def stable_hash(c: Column, length: int = 16) -> Column:
    """First hex digits of the SHA-256 of the UTF-8 bytes; null stays null."""
    return F.substring(F.sha2(c.cast("binary"), 256), 1, length)


def order_hash(seed: int | str, key: Column) -> Column:
    """Hash that replaces a seeded shuffle: ordering by it is the same on every engine and cluster."""
    return F.sha2(F.concat(F.lit(f"{seed}|"), key.cast("string")), 256)


def first_text(*columns: Column) -> Column:
    """First value that is not blank, stripped; null where all are blank."""
    return F.coalesce(*[F.nullif(strip(c), F.lit("")) for c in columns])


def preview(c: Column, width: int) -> Column:
    """White space collapsed, cut to width characters with '...' at the end of longer ones; null becomes ''."""
    t = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    return F.when(F.length(t) > width, F.concat(F.substring(t, 1, width - 3), F.lit("..."))).otherwise(t)


def count_of(c: Column, needle: str) -> Column:
    """Occurrences of needle, not overlapping."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(needle)))) / len(needle)).cast("bigint")


def lines(c: Column) -> Column:
    return F.split(c, r"\n")


def line_count(c: Column) -> Column:
    """Lines that are not blank; 0 for null."""
    return F.coalesce(F.size(F.filter(lines(c), lambda x: F.trim(x) != "")), F.lit(0)).cast("bigint")


def fenced(code: Column, language: str) -> Column:
    return F.concat(F.lit(f"```{language}\n"), F.rtrim(code), F.lit("\n```"))


def extract_fenced(c: Column, language: str = "python") -> Column:
    """Body of the first fence of the language, else of the first fence, else null."""
    own = F.regexp_extract(c, rf"(?s)```{language}\s*\n(.*?)```", 1)
    other = F.regexp_extract(c, r"(?s)```[a-z]*\s*\n(.*?)```", 1)
    return F.coalesce(F.nullif(own, F.lit("")), F.nullif(other, F.lit("")))


def key_values(c: Column) -> Column:
    """ARRAY<STRUCT<key, value>> of the k=v lines, in order; split at the first '=', both sides trimmed."""
    pairs = F.filter(lines(F.coalesce(c, F.lit(""))), lambda x: x.contains("="))
    return F.transform(
        pairs,
        lambda x: F.struct(
            F.trim(F.substring_index(x, "=", 1)).alias("key"), F.trim(F.regexp_replace(x, r"^[^=]*=", "")).alias("value")
        ),
    )


def contains_all(c: Column, needles: Column) -> Column:
    return F.forall(needles, lambda n: F.contains(c, n))


def missing(c: Column, needles: Column) -> Column:
    """Needles that c does not contain, in order; a null text misses all, a null list nothing."""
    text = F.coalesce(c, F.lit(""))
    return F.filter(F.coalesce(needles, F.array().cast("array<string>")), lambda n: ~F.contains(text, n))


def name_list(raw: str) -> set[str]:
    """Names of a comma-separated list, in lower case; blanks are left out."""
    return {x.strip().lower() for x in raw.split(",") if x.strip()}


def positive_numbers(raw: str) -> list[int]:
    """Distinct positive integers of a list separated by commas or blanks, in order; anything else raises."""
    out = [int(x) for x in raw.replace(",", " ").split()]
    if not out or min(out) < 1:
        raise ValueError("a list of positive integers is needed")
    return list(dict.fromkeys(out))


def limits(pairs: list[str]) -> list[tuple[str, int]]:
    """(name, limit) of each name=limit; one without the sign raises."""
    split = [p.partition("=") for p in pairs]
    if any(not sign for _, sign, _ in split):
        raise ValueError("name=limit is needed")
    return [(n.strip(), int(v)) for n, _, v in split]


def mask_path(path: Column) -> Column:
    """The loss mask's file beside a token file: its stem with _loss_mask."""
    return F.regexp_replace(path, r"^(.*?)(\.[^./]+)?$", "$1_loss_mask$2")
