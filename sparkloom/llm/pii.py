"""Personal mentions of a record's parts, as rows and as redacted text."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import personal

#: Characters judged together; the trees work on all candidates of such a block at once.
BLOCK_CHARS = 1 << 19


def parts(df: DataFrame, id_column: str, messages: str | None, texts: list[str]) -> DataFrame:
    """(id_column, field_name, part_index, text) of every message content and text field that is not empty."""
    fields = [F.array(F.struct(F.lit(t).alias("field_name"), F.lit(0).alias("part_index"), df[t].alias("text"))) for t in texts]
    if messages:
        numbered = F.transform(
            F.coalesce(df[messages]["content"], F.array().cast("array<string>")),
            lambda c, i: F.struct(F.lit(messages).alias("field_name"), i.cast("int").alias("part_index"), c.alias("text")),
        )
        fields.append(numbered)
    out = df.select(df[id_column], F.explode(F.concat(*fields)).alias("p"))
    return out.select(id_column, "p.field_name", "p.part_index", "p.text").filter("text IS NOT NULL AND text <> ''")


def find_mentions(rows: DataFrame, keys: list[str], text_column: str = "text", with_text: bool = False) -> DataFrame:
    """keys with mentions ARRAY<STRUCT<kind, first, last>>, of the rows that mention somebody; with_text adds redacted.

    One narrow pass without a shuffle: candidates of all kinds, judged by
    trees fitted on the driver beforehand. Null and empty texts mention
    nobody. ``first`` and ``last`` count code points, last is exclusive.
    """
    models, lex = personal.trained_models(), personal.lexicon()
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from sparkloom.llm.batches import text_blocks

        shape = pa.list_(pa.struct([("kind", pa.string()), ("first", pa.int32()), ("last", pa.int32())]))
        for batch in batches:
            for first, texts in text_blocks(batch.column(len(keys)), rows=4000, chars=BLOCK_CHARS):
                texts = [t or "" for t in texts]
                found = personal.select(texts, models, lex)
                at = [i for i, spans in enumerate(found) if spans]
                mentions = [[{"kind": k, "first": s, "last": e} for k, s, e in found[i]] for i in at]
                taken = [batch.column(c).slice(first, len(texts)).take(pa.array(at, pa.int64())) for c in range(len(keys))]
                columns, names = [*taken, pa.array(mentions, shape)], [*keys, "mentions"]
                if with_text:
                    columns.append(pa.array([personal.redact(texts[i], found[i]) for i in at], pa.string()))
                    names.append("redacted")
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"{kinds}, mentions array<struct<kind:string,first:int,last:int>>" + (", redacted string" if with_text else "")
    return rows.select(*keys, F.col(text_column).alias("__text")).mapInArrow(run, schema)
