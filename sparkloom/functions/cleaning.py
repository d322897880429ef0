"""Column expressions that bring unevenly spelled labels into one form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings of a language beside its two-letter code.
LANGUAGE_NAMES = {
    "eng": "en", "english": "en", "deu": "de", "ger": "de", "german": "de", "deutsch": "de",
    "fra": "fr", "fre": "fr", "french": "fr", "spa": "es", "spanish": "es", "por": "pt", "portuguese": "pt",
    "rus": "ru", "russian": "ru", "jpn": "ja", "japanese": "ja", "zho": "zh", "chi": "zh", "chinese": "zh",
}
UNKNOWN = "unknown"


def clean_language(c: Column) -> Column:
    """Two-letter code; null and blank become 'unknown', an unheard-of name stays as it is in lower case."""
    base = F.lower(F.regexp_extract(F.trim(F.coalesce(c, F.lit(""))), r"^([^-_]*)", 1))
    names = F.create_map(*[F.lit(x) for pair in {"": UNKNOWN, **LANGUAGE_NAMES}.items() for x in pair])
    return F.coalesce(F.try_element_at(names, base), base)


def clean_label(c: Column) -> Column:
    """Lower case, outer blanks off, hyphens and inner blanks as underscores; null and blank become 'unknown'."""
    t = F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), r"[-\s]+", "_")
    return F.when(t == "", F.lit(UNKNOWN)).otherwise(t)


def source_origin(c: Column) -> Column:
    """Origin of a provenance string.

    ``dataset:id`` gives the dataset; ``raw/<dataset>/<file>:line`` gives the
    folder that holds the file, which names the dataset too.
    """
    head = F.regexp_extract(F.coalesce(c, F.lit("")), r"^([^:]*)", 1)
    folder = F.regexp_extract(head, r"([^/]+)/[^/]*$", 1)
    return clean_label(F.when(folder != "", folder).otherwise(head))


def source_family(c: Column) -> Column:
    """What stands before the first colon, in lower case and without outer blanks; null where nothing does."""
    t = F.lower(F.trim(F.regexp_extract(c, r"^([^:]*)", 1)))
    return F.when(t != "", t)
