"""Registered queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.cleaning import clean_label, clean_language, source_family, source_origin
from sparkloom.llm import encode, leaks, mixing, packing, pairs, pii, shared_spans, token_budget
from sparkloom.plans.rules import language
from sparkloom.tables import load, spread


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document; null and empty texts give an empty list."""
    return encode.encode_column(spread(load(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text")


def _budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["origin", "lang", "domain"]
    out = None
    for table, record, origin, domain in (
        ("agentcoder_slice_train", "record_id", source_origin(F.col("_curriculum_source")), "domain"),
        ("agentcoder_coding_ladder_sft", "record_id", source_origin(F.col("_curriculum_source")), "topic"),
        ("documents", "doc_id", clean_label(F.col("source")), "domain"),
    ):
        df = load(spark, sf_dir, table)
        texts = F.array(F.col("text")) if table == "documents" else F.col("trace.content")
        df = df.select(
            F.col(record).alias("record"),
            origin.alias("origin"),
            clean_language(F.col("lang")).alias("lang"),
            clean_label(F.col(domain)).alias("domain"),
            texts.alias("texts"),
        )
        part = token_budget.budget(spread(df), "record", keys, "texts").withColumn("corpus", F.lit(table))
        out = part if out is None else out.unionByName(part)
    return out.select("corpus", *keys, "n_records", "n_texts", "n_tokens", "n_differing")


def p1_token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens per corpus, origin, language and domain."""
    return _budgets(spark, sf_dir)


def p1_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same totals by origin, by language and by domain alone; the columns summed over are null."""
    sums = [F.sum(c).alias(c) for c in ("n_records", "n_texts", "n_tokens", "n_differing")]
    return _budgets(spark, sf_dir).groupingSets([["corpus", "origin"], ["corpus", "lang"], ["corpus", "domain"], ["corpus"]], "corpus", "origin", "lang", "domain").agg(*sums)


def p1_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records and texts that the token budget counts, by corpus and language."""
    return _budgets(spark, sf_dir).groupBy("corpus", "lang").agg(F.sum("n_records").alias("n_records"), F.sum("n_texts").alias("n_texts"))


SPAN = 400


def _long_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_spans.with_digest(spread(load(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text", SPAN)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents that share at least 400 code points verbatim."""
    return shared_spans.document_pairs(_long_texts(spark, sf_dir), SPAN)


def p8_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each document concerned is shared elsewhere, with its class of copies."""
    return shared_spans.shared_amounts(_long_texts(spark, sf_dir), SPAN)


def p8_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages that two documents share up to edits, by chains of seeds aligned in their gaps."""
    return shared_spans.passages(_long_texts(spark, sf_dir), SPAN)


PART_KEYS = ["record_id", "field_name", "part_index"]


def _pack_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = load(spark, sf_dir, "agentcoder_slice_train")
    trace = F.transform(
        F.coalesce(F.col("trace.content"), F.array().cast("array<string>")),
        lambda c, i: F.struct(F.lit("trace").alias("field_name"), i.cast("int").alias("part_index"), F.length(c).alias("n_chars")),
    )
    context = F.array(F.struct(F.lit("repo_context").alias("field_name"), F.lit(0).alias("part_index"), F.length("repo_context").alias("n_chars")))
    parts = df.select("record_id", F.explode(F.concat(trace, context)).alias("p")).select("record_id", "p.*").filter("n_chars > 0")
    return parts.groupBy(*PART_KEYS).agg(F.max("n_chars").alias("n_chars"))


def p2_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Window of every trace text and repo_context of the distinct records, for each container."""
    return packing.assign(_pack_items(spark, sf_dir), PART_KEYS, load(spark, sf_dir, "pack_containers"))


def p2_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fill of each container."""
    return packing.fill_report(p2_assignment(spark, sf_dir))


def p2_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the assignment holds, per container: pieces, characters, windows above capacity and items not whole."""
    a = p2_assignment(spark, sf_dir)
    over = a.groupBy("container", "capacity", "window_id").agg(F.sum("chars").alias("c")).filter("c > capacity").groupBy("container").agg(F.count(F.lit(1)).alias("n_overfull"))
    sums = a.groupBy("container", "capacity").agg(F.count(F.lit(1)).alias("n_pieces"), F.sum("chars").alias("chars"), F.count_distinct(*PART_KEYS).alias("n_items"))
    return sums.join(over, "container", "left").select("container", "capacity", "n_items", "n_pieces", "chars", F.coalesce("n_overfull", F.lit(0)).alias("n_overfull"))


PART = ["record_id", "field_name", "part_index"]


def _record_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.parts(spread(load(spark, sf_dir, "agentcoder_slice_train").select("record_id", "messages", "repo_context")), "record_id", "messages", ["repo_context"])


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of personal mentions of each part of a record."""
    found = pii.find_mentions(_record_parts(spark, sf_dir), PART)
    return found.select(*PART, F.explode(F.array_distinct("mentions.kind")).alias("kind")).distinct()


def p3_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that mention somebody, the mentions replaced by typed placeholders; a record delivered twice comes once."""
    found = pii.find_mentions(_record_parts(spark, sf_dir), PART, with_text=True)
    return found.select(*PART, F.size("mentions").alias("n_mentions"), "redacted").distinct()


def _ladder_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(record_id, family, chars) of the distinct ladder records."""
    content = lambda c: F.aggregate(F.coalesce(F.col(c), F.array().cast("array<string>")), F.lit(0), lambda a, x: a + F.coalesce(F.length(x), F.lit(0)))
    df = load(spark, sf_dir, "agentcoder_coding_ladder_sft").select(
        "record_id",
        source_family(F.col("_curriculum_source")).alias("family"),
        (content("messages.content") + content("trace.content") + F.coalesce(F.length("final"), F.lit(0))).cast("bigint").alias("chars"),
    )
    return df.groupBy("record_id").agg(F.min("family").alias("family"), F.max("chars").alias("chars"))


def p4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every use of a record in every mix."""
    uses, _ = mixing.draw(_ladder_records(spark, sf_dir), load(spark, sf_dir, "mixture_targets"))
    return uses.withColumnRenamed("family", "source_family")


def p4_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual shares of every mix and family."""
    return mixing.shares(*mixing.draw(_ladder_records(spark, sf_dir), load(spark, sf_dir, "mixture_targets")))


def p4_held(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per mix and family: target share, what there is, and whether uses and size keep to the limits."""
    s = p4_shares(spark, sf_dir)
    reachable = F.least(F.col("target_chars"), F.col("available_chars") * F.greatest(F.lit(0), F.coalesce("max_repeats", F.lit(0))))
    near = F.abs(F.col("actual_chars") - reachable) <= F.greatest(0.02 * F.col("target_chars"), F.lit(4096))
    return s.select("mix_name", "source_family", F.round("target_share", 9).alias("target_share"), "available_chars", (F.col("most_uses") <= F.col("max_repeats")).alias("within_repeats"), near.alias("near_target"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose prompt and answer make a defective pair, with the defect."""
    return pairs.find_defects(spread(load(spark, sf_dir, "agentcoder_slice_train").select("record_id", "messages", "trace", "final")))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a held-out item's text, or at least half of it."""
    return leaks.find_leaks(spread(load(spark, sf_dir, "documents").select("doc_id", "text")), load(spark, sf_dir, "benchmark"))


def p7_leaked_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per held-out item, in how many documents it leaks; 0 for clean items."""
    items = load(spark, sf_dir, "benchmark").select("item_id", "name", "eval_tier")
    hits = p7_found(spark, sf_dir).groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    return items.join(hits, "item_id", "left").select("item_id", "name", "eval_tier", F.coalesce("n", F.lit(0)).alias("n_documents"))


def queries() -> dict:
    return {
        "p1_token_budget": p1_token_budget,
        "p1_token_rollup": p1_token_rollup,
        "p1_texts": p1_texts,
        "p2_assignment": p2_assignment,
        "p2_fill": p2_fill,
        "p2_totals": p2_totals,
        "p3_found": p3_found,
        "p3_redacted": p3_redacted,
        "p4_mix": p4_mix,
        "p4_shares": p4_shares,
        "p4_held": p4_held,
        "p5_found": p5_found,
        "p6_ids": p6_ids,
        "p7_found": p7_found,
        "p7_leaked_items": p7_leaked_items,
        "p8_found": p8_found,
        "p8_shared": p8_shared,
        "p8_passages": p8_passages,
    }


def oracle_sql() -> dict[str, str]:
    """Twins of what SQL can say: spans by joining windows on their digests, and what the other results must hold."""
    chars = "(coalesce(list_sum(list_transform(messages, lambda m: coalesce(length(m.content), 0))), 0) + coalesce(list_sum(list_transform(trace, lambda m: coalesce(length(m.content), 0))), 0) + coalesce(length(final), 0))"
    per_record = lambda table: f"SELECT '{table}' AS corpus, {language('lang')} AS lang, count(*)::BIGINT AS n_records, sum(coalesce(list_sum(list_transform(trace, lambda x: CASE WHEN coalesce(x.content, '') <> '' THEN 1 ELSE 0 END)), 0))::BIGINT AS n_texts FROM (SELECT DISTINCT ON (record_id) record_id, lang, trace FROM {table} ORDER BY record_id) GROUP BY 1, 2"
    return {
        "p8_found": f"""
WITH w AS (SELECT DISTINCT doc_id, md5(substr(text, i::INT, {SPAN})) AS d FROM (SELECT doc_id, text, unnest(range(1, length(text) - {SPAN} + 2)) AS i FROM documents WHERE length(text) >= {SPAN}))
SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM w a JOIN w b ON a.d = b.d AND a.doc_id < b.doc_id""",
        "p1_texts": f"""
{per_record('agentcoder_slice_train')} UNION ALL {per_record('agentcoder_coding_ladder_sft')}
UNION ALL SELECT 'documents', {language('lang')}, count(*)::BIGINT, count(*) FILTER (WHERE coalesce(text, '') <> '')::BIGINT FROM documents GROUP BY 1, 2""",
        "p2_totals": """
WITH i AS (SELECT record_id, f, p, max(n) AS n FROM (SELECT record_id, 't' AS f, generate_subscripts(trace, 1) AS p, length(unnest(trace).content) AS n FROM agentcoder_slice_train WHERE trace IS NOT NULL
 UNION ALL SELECT record_id, 'r', 0, length(repo_context) FROM agentcoder_slice_train) WHERE n > 0 GROUP BY 1, 2, 3)
SELECT container, capacity_chars AS capacity, count(*)::BIGINT AS n_items, sum((n + capacity_chars - 1) // capacity_chars)::BIGINT AS n_pieces, sum(n)::BIGINT AS chars, 0::BIGINT AS n_overfull FROM i, pack_containers GROUP BY 1, 2""",
        "p4_held": f"""
WITH t AS (SELECT mix_name, lower(trim(source_family)) AS source_family, sum(target_weight) AS w FROM mixture_targets WHERE target_weight > 0 AND trim(coalesce(source_family, '')) <> '' AND size_ratio > 0 GROUP BY 1, 2),
 r AS (SELECT family, sum(c) AS c FROM (SELECT record_id, min(nullif(lower(trim(split_part(_curriculum_source, ':', 1))), '')) AS family, max({chars}) AS c FROM agentcoder_coding_ladder_sft GROUP BY 1) GROUP BY 1)
SELECT mix_name, source_family, round(w / sum(w) OVER (PARTITION BY mix_name), 9) AS target_share, coalesce(c, 0)::BIGINT AS available_chars, TRUE AS within_repeats, TRUE AS near_target FROM t LEFT JOIN r ON family = source_family""",
    }
