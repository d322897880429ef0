"""Queries q01 to q33: records, tokens, streams and curricula."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.functions.cleaning import clean_label, clean_language
from sparkloom.functions.text import first_text, order_hash, stable_hash
from sparkloom.operators import curriculum, ranking, records, streams, tokens
from sparkloom.plans.registry import query
from sparkloom.plans.rules import RENDERED, RESULTS, ROLE, TOK, TOKENS, label, language
from sparkloom.tables import load, spread

SEED = 17
MOST_CHARS = 2000
VOCAB = 512


def big(c) -> F.Column:
    return F.col(c).cast("bigint") if isinstance(c, str) else c.cast("bigint")


def _texts(s: SparkSession, d: str) -> DataFrame:
    """Documents for work on every token."""
    return spread(_docs(s, d).select("doc_id", "lang", "text"))


def _slice(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "agentcoder_slice_train")


def _docs(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "documents")


@query("q01", "SELECT doc_id, substr(sha256(text), 1, 16) AS hash, coalesce(length(text), 0)::BIGINT AS n FROM documents")
def q01(s, d):
    """Document hash and length; a null text has no hash and length 0."""
    return _docs(s, d).select("doc_id", stable_hash(F.col("text")).alias("hash"), big(F.coalesce(F.length("text"), F.lit(0))).alias("n"))


@query("q02", f"""
SELECT {label('source_dataset')} AS origin, CASE WHEN text IS NULL AND (messages IS NOT NULL OR trace IS NOT NULL OR final IS NOT NULL OR repo_context IS NOT NULL OR system IS NOT NULL)
 THEN 'structured' ELSE 'plain' END AS kind, count(*)::BIGINT AS n FROM agentcoder_slice_train GROUP BY 1, 2
UNION ALL SELECT 'documents', 'plain', count(*)::BIGINT FROM documents""")  # fmt: skip
def q02(s, d):
    """Structured and plain records per origin."""
    t = _slice(s, d)
    kind = F.when(records.is_structured(t), "structured").otherwise("plain")
    a = t.groupBy(clean_label(F.col("source_dataset")).alias("origin"), kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return a.unionByName(_docs(s, d).agg(F.count(F.lit(1)).alias("n")).select(F.lit("documents").alias("origin"), F.lit("plain").alias("kind"), "n"))


@query("q03", f"SELECT length(plain) > {MOST_CHARS} AS skipped, count(*)::BIGINT AS n, coalesce(sum(length(plain)), 0)::BIGINT AS chars FROM ({RENDERED}) GROUP BY 1")
def q03(s, d):
    """Length filter over the rendering without tags, with what it skips."""
    t = _slice(s, d).select(F.length(records.render_plain()).alias("n_chars"))
    return t.groupBy((F.col("n_chars") > MOST_CHARS).alias("skipped")).agg(F.count(F.lit(1)).alias("n"), big(F.coalesce(F.sum("n_chars"), F.lit(0))).alias("chars"))


@query("q04", f"SELECT {language('lang')} AS language, count(*)::BIGINT AS n FROM documents WHERE {language('lang')} IN ('en', 'de', 'unknown') GROUP BY 1")
def q04(s, d):
    """Language filter; an unknown language passes."""
    t = _docs(s, d).select(clean_language(F.col("lang")).alias("language"))
    return t.filter(F.col("language").isin("en", "de", "unknown")).groupBy("language").agg(F.count(F.lit(1)).alias("n"))


@query("q05", f"SELECT run_id, count(*)::BIGINT AS n FROM ({RESULTS}) WHERE passed IS DISTINCT FROM TRUE GROUP BY 1")
def q05(s, d):
    """Rows flagged exactly true are excluded; false and null stay."""
    t = load(s, d, "eval_results").distinct()
    return t.filter(~F.col("passed").eqNullSafe(True)).groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))


@query("q06", f"""
SELECT run_id, count(*)::BIGINT AS rows_in, count(*) FILTER (WHERE (generated_tokens IS NULL OR generated_tokens >= 100) AND coalesce(coalesce(nullif(passed, FALSE), eos_generated), TRUE))::BIGINT AS kept
 FROM ({RESULTS}) GROUP BY 1""")  # fmt: skip
def q06(s, d):
    """Minimum score where a missing score passes; a false status falls through to the next flag."""
    t = load(s, d, "eval_results").distinct()
    ok = records.score_passes(100, F.col("generated_tokens")) & F.coalesce(records.status_or_fallback(F.col("passed"), F.col("eos_generated")), F.lit(True))
    return t.groupBy("run_id").agg(F.count(F.lit(1)).alias("rows_in"), F.count_if(ok).alias("kept"))


@query("q07", f"""
SELECT CASE WHEN text IS NOT NULL THEN 'plain_text' WHEN messages IS NULL THEN 'no_messages' WHEN {language('lang')} NOT IN ('en', 'unknown') THEN 'language'
 WHEN coalesce(len(list_filter(messages, lambda m: m.role = 'assistant')), 0) + coalesce(len(trace), 0) = 0 AND trim(coalesce(final, '')) = '' THEN 'no_answer' WHEN length(plain) > {MOST_CHARS} THEN 'too_long' ELSE 'kept' END AS reason,
 count(*)::BIGINT AS n FROM ({RENDERED}) GROUP BY 1""")  # fmt: skip
def q07(s, d):
    """First failing reason per rejected record; reasons and kept add up to the input."""
    answers = F.coalesce(F.size(F.filter("messages", lambda m: m["role"] == "assistant")), F.lit(0)) + F.coalesce(F.size("trace"), F.lit(0))
    reason = records.first_failing([
        ("plain_text", F.col("text").isNotNull()), ("no_messages", F.col("messages").isNull()), ("language", ~clean_language(F.col("lang")).isin("en", "unknown")),
        ("no_answer", (answers == 0) & (F.trim(F.coalesce("final", F.lit(""))) == "")), ("too_long", F.length(records.render_plain()) > MOST_CHARS),
    ])
    return _slice(s, d).groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("q08", f"SELECT {ROLE} AS role, count(*)::BIGINT AS n, sum(length(m.content))::BIGINT AS chars FROM (SELECT unnest(messages) AS m FROM agentcoder_slice_train WHERE messages IS NOT NULL) GROUP BY 1")
def q08(s, d):
    """Turns per canonical role."""
    m = _slice(s, d).select(F.explode("messages").alias("m"))
    return m.groupBy(records.normalize_role(F.col("m.role")).alias("role")).agg(F.count(F.lit(1)).alias("n"), big(F.sum(F.length("m.content"))).alias("chars"))


@query("q09", f"SELECT DISTINCT record_id, substr(sha256(rendered), 1, 16) AS hash, length(rendered)::BIGINT AS n FROM ({RENDERED})")
def q09(s, d):
    """Rendered record, as hash and length; a record delivered twice comes once."""
    r = records.render()
    return _slice(s, d).select("record_id", stable_hash(r).alias("hash"), big(F.length(r)).alias("n")).distinct()


_TURNS = """SELECT record_id, m.role AS role, m.content AS text, pos FROM (SELECT record_id, unnest(messages) AS m, generate_subscripts(messages, 1) - 1 AS pos
 FROM (SELECT record_id, any_value(messages) AS messages FROM agentcoder_slice_train WHERE messages IS NOT NULL GROUP BY 1))"""


@query("q10", f"""
SELECT record_id, u.p::BIGINT AS user_pos, pos::BIGINT AS assistant_pos, substr(sha256(u.t), 1, 16) AS prompt, substr(sha256(text), 1, 16) AS answer FROM
 (SELECT *, last_value(CASE WHEN role = 'user' THEN {{'p': pos, 't': text}} END IGNORE NULLS) OVER (PARTITION BY record_id ORDER BY pos) AS u FROM ({_TURNS})) WHERE role = 'assistant' AND u IS NOT NULL""")  # fmt: skip
def q10(s, d):
    """Each assistant turn with the latest user turn before it."""
    one = _slice(s, d).filter("messages IS NOT NULL").groupBy("record_id").agg(F.min("messages").alias("messages"))  # the least of deliveries that differ
    turns = one.select("record_id", F.posexplode("messages").alias("pos", "m")).select("record_id", "pos", "m.role", F.col("m.content").alias("text"))
    p = records.reply_pairs(turns, "record_id", "pos")
    return p.select("record_id", big("user_pos").alias("user_pos"), big("assistant_pos").alias("assistant_pos"), stable_hash(F.col("user_text")).alias("prompt"), stable_hash(F.col("assistant_text")).alias("answer"))


@query("q11", f"""
SELECT source, doc_id, n FROM (SELECT {label('source')} AS source, doc_id, length(text)::BIGINT AS n, row_number() OVER (PARTITION BY {label('source')} ORDER BY doc_id) AS rn FROM documents WHERE length(text) >= 200) WHERE rn <= 5""")  # fmt: skip
def q11(s, d):
    """First five long documents per source."""
    t = _docs(s, d).select(clean_label(F.col("source")).alias("source"), "doc_id", big(F.length("text")).alias("n")).filter("n >= 200")
    return ranking.first_n(t, ["source"], ["doc_id"], 5)


_FIRST = "nullif(regexp_replace(source_id, '^\\s+|\\s+$', '', 'g'), '')"


@query("q12", f"""
SELECT DISTINCT record_id, coalesce(regexp_replace(topic, '^\\s+|\\s+$', '', 'g'), '') AS topic, coalesce(regexp_replace(behavior, '^\\s+|\\s+$', '', 'g'), '') AS behavior,
 substr(coalesce({_FIRST}, printf('row_%06d', record_id)), 1, 120) AS source_id, coalesce(source_dataset, '') || ':' || substr(coalesce({_FIRST}, printf('row_%06d', record_id)), 1, 120) AS curriculum_source,
 nullif(lower(regexp_replace(license, '^\\s+|\\s+$', '', 'g')), '') AS license FROM agentcoder_slice_train""")  # fmt: skip
def q12(s, d):
    """Canonical provenance of each record."""
    return records.canonical(_slice(s, d)).distinct()


@query("q13", f"SELECT doc_id, coalesce(len({TOKENS}), 0)::BIGINT AS n_tokens, coalesce(len(list_distinct({TOKENS})), 0)::BIGINT AS n_distinct FROM documents")
def q13(s, d):
    """Lexer tokens per document; a null text has none."""
    lexed = tokens.lex(F.col("text"))
    return _texts(s, d).select("doc_id", big(F.coalesce(F.size(lexed), F.lit(0))).alias("n_tokens"), big(F.coalesce(F.size(F.array_distinct(lexed)), F.lit(0))).alias("n_distinct"))


_FREQ = f"SELECT token, count(*)::BIGINT AS n, min({{'d': doc_id, 'p': pos}}) AS first FROM ({TOK}) GROUP BY 1"


@query("q14", f"SELECT token, n FROM ({_FREQ}) ORDER BY n DESC, first LIMIT 50")
def q14(s, d):
    """The fifty most frequent tokens, earlier-seen first among equals."""
    f = tokens.frequencies(_texts(s, d), "doc_id", "text")
    return f.orderBy(F.col("n").desc(), F.col("first").asc()).limit(50).select("token", "n")


_VOCAB = f"""SELECT token, ({tokens.FIRST_LEARNED - 1} + row_number() OVER (ORDER BY n DESC, first))::BIGINT AS id, n FROM ({_FREQ})
 WHERE NOT (trim(regexp_replace(token, '[ \\t\\n\\r\\f\\x0B]', '', 'g')) = '' AND length(token) > {tokens.LONGEST_BLANK} AND NOT contains(token, chr(10)))
 AND token NOT IN ({', '.join("'" + t + "'" for t in tokens.SPECIALS)}) ORDER BY n DESC, first LIMIT {VOCAB - tokens.FIRST_LEARNED}"""


def vocabulary(s, d) -> DataFrame:
    return tokens.vocabulary(tokens.frequencies(_texts(s, d), "doc_id", "text"), VOCAB)


@query("q15", _VOCAB)
def q15(s, d):
    """Learned vocabulary with ids."""
    return vocabulary(s, d)


_ALLVOCAB = f"""SELECT * FROM (SELECT token, id FROM ({_VOCAB})) UNION ALL SELECT '<0x' || upper(lpad(to_hex(i), 2, '0')) || '>', {tokens.FIRST_BYTE} + i FROM range(256) t(i)
 UNION ALL SELECT unnest([{', '.join("'" + t + "'" for t in tokens.SPECIALS)}]), unnest(range({len(tokens.SPECIALS)}))"""
_CODED = f"""SELECT t.doc_id, t.token, t.pos, v.id, CASE WHEN v.id IS NOT NULL THEN 1 ELSE octet_length(encode(t.token)) END AS n_ids,
 CASE WHEN v.id IS NOT NULL THEN v.id ELSE list_sum(list_transform(range(1, 2 * octet_length(encode(t.token)), 2), lambda i: ('0x' || substr(hex(encode(t.token)), i::INT, 2))::INT + {tokens.FIRST_BYTE})) END AS id_sum
 FROM ({TOK}) t LEFT JOIN ({_ALLVOCAB}) v USING (token)"""


@query("q16", f"SELECT doc_id, sum(n_ids)::BIGINT AS n_ids, sum(id_sum)::BIGINT AS id_sum, count(*) FILTER (WHERE id IS NULL)::BIGINT AS unknown FROM ({_CODED}) GROUP BY 1")
def q16(s, d):
    """Encoded length, sum of ids and unknown tokens per document, with byte fallback."""
    coded = tokens.encode(tokens.tokens(_texts(s, d), "doc_id", "text"), tokens.with_specials(vocabulary(s, d)), VOCAB)
    return coded.groupBy("doc_id").agg(
        big(F.sum(F.size("ids"))).alias("n_ids"), big(F.sum(F.aggregate("ids", F.lit(0).cast("bigint"), lambda a, x: a + x))).alias("id_sum"), F.count_if(F.col("id").isNull()).alias("unknown")
    )


@query("q17", f"""
SELECT part, max(len)::BIGINT AS longest, max({{'n': len, 'o': -ord}}).o * -1 AS first_at, count(*)::BIGINT AS n FROM
 (SELECT 'train' AS part, record_id AS ord, len(regexp_extract_all(rendered, '{tokens.LEXER}', 0)) AS len FROM ({RENDERED}) UNION ALL SELECT 'eval', item_id, len({TOKENS}) FROM benchmark) GROUP BY 1""")  # fmt: skip
def q17(s, d):
    """Longest rendering in tokens of both sides and where it first occurs."""
    a = spread(_slice(s, d)).select(F.lit("train").alias("part"), F.col("record_id").alias("ord"), F.size(tokens.lex(records.render())).alias("len"))
    b = load(s, d, "benchmark").select(F.lit("eval").alias("part"), F.col("item_id").alias("ord"), F.size(tokens.lex(F.col("text"))).alias("len"))
    top = F.max(F.struct("len", (-F.col("ord")).alias("o")))
    return a.unionByName(b).groupBy("part").agg(top.alias("t"), F.count(F.lit(1)).alias("n")).select("part", big("t.len").alias("longest"), (-F.col("t.o")).alias("first_at"), "n")


@query("q18", f"""
SELECT {language('lang')} AS language, count(*)::BIGINT AS n_tokens, round(avg(CASE WHEN v.id IS NULL THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS unknown_rate
 FROM ({TOK}) t JOIN documents USING (doc_id) LEFT JOIN ({_VOCAB}) v USING (token) GROUP BY 1""")  # fmt: skip
def q18(s, d):
    """Share of tokens outside the learned vocabulary, by language."""
    t = _texts(s, d).select("lang", F.explode(tokens.lex(F.col("text"))).alias("token"))
    per = t.groupBy("lang", "token").agg(F.count(F.lit(1)).alias("n")).join(tokens.lookup(vocabulary(s, d), VOCAB), "token", "left")
    return per.groupBy(clean_language(F.col("lang")).alias("language")).agg(F.sum("n").alias("n_tokens"), F.round(F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("unknown_rate"))


@query("q19", f"SELECT count(*)::BIGINT AS n, count(*) FILTER (WHERE array_to_string({TOKENS}, '') = text)::BIGINT AS lossless FROM documents WHERE text IS NOT NULL")
def q19(s, d):
    """Texts that their tokens spell out again."""
    t = _texts(s, d).filter("text IS NOT NULL")
    return t.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.array_join(tokens.lex(F.col("text")), "") == F.col("text")).alias("lossless"))


@query("q20", f"""
SELECT DISTINCT record_id, coalesce(list_sum(list_transform(segs, lambda s: len(regexp_extract_all('<|' || s.tag || '|>' || chr(10) || s.body || chr(10), '{tokens.LEXER}', 0)))), 0)::BIGINT AS total,
 coalesce(list_sum(list_transform(list_filter(segs, lambda s: s.tag IN ('assistant', 'tool', 'patch', 'final')), lambda s: len(regexp_extract_all('<|' || s.tag || '|>' || chr(10) || s.body || chr(10), '{tokens.LEXER}', 0)))), 0)::BIGINT AS owned
 FROM ({RENDERED}) WHERE text IS NULL""")  # fmt: skip
def q20(s, d):
    """Tokens of each record and those it is scored on."""
    own = tokens.ownership(records.segments(), records.OWNED)
    return spread(_slice(s, d)).filter("text IS NULL").select("record_id", own.alias("o")).select("record_id", "o.total", "o.owned").distinct()


_SPLIT = f"SELECT doc_id, length(text) AS len, row_number() OVER (ORDER BY sha256('{SEED}|' || doc_id), doc_id) AS rn, count(*) OVER () AS n FROM documents"


@query("q21", f"SELECT CASE WHEN rn <= greatest(1, round_even(n * 0.02, 0)) THEN 'val' ELSE 'train' END AS split, count(*)::BIGINT AS n, sum(doc_id)::BIGINT AS ids FROM ({_SPLIT}) GROUP BY 1")
def q21(s, d):
    """Train and validation documents by hash order."""
    t = streams.split_train_val(_docs(s, d).select("doc_id"), "doc_id", 0.02, SEED)
    return t.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("ids"))


_OFFSETS = f"""SELECT doc_id, coalesce(sum(n) OVER (ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, n FROM
 (SELECT doc_id, sha256('{SEED}|' || doc_id) AS h, coalesce(len({TOKENS}), 0)::BIGINT AS n FROM documents)"""


def _offsets(s, d) -> DataFrame:
    t = _texts(s, d).select("doc_id", big(F.coalesce(F.size(tokens.lex(F.col("text"))), F.lit(0))).alias("n"))
    return streams.offsets(t, "doc_id", F.col("n"), SEED)


@query("q22", f"SELECT doc_id, start, start + n AS stop FROM ({_OFFSETS})")
def q22(s, d):
    """Place of each document in the token stream."""
    return _offsets(s, d).select("doc_id", big("start").alias("start"), big("stop").alias("stop"))


@query("q23", f"""
SELECT w::BIGINT AS window, count(*)::BIGINT AS n_documents, sum(least(start + n, (w + 1) * 2048) - greatest(start, w * 2048))::BIGINT AS n_tokens FROM
 (SELECT start, n, unnest(range(start // 2048, (start + n - 1) // 2048 + 1)) AS w FROM ({_OFFSETS}) WHERE n > 0) GROUP BY 1""")  # fmt: skip
def q23(s, d):
    """Documents and tokens in each window of the stream."""
    w = streams.windows(_offsets(s, d), 2048)
    return w.select(big("window").alias("window"), "n_documents", big("n_tokens").alias("n_tokens"))


@query("q24", f"""
SELECT chunk::BIGINT AS chunk, (chunk * 4096)::BIGINT AS first, length::BIGINT AS length, coalesce(sum(length) OVER (ORDER BY sha256('{SEED}|' || chunk), chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
 FROM (SELECT chunk, least(4096, n - chunk * 4096) AS length FROM (SELECT n, unnest(range(0, (n - 1) // 4096 + 1)) AS chunk FROM (SELECT sum(len({TOKENS}))::BIGINT AS n FROM documents)))""")  # fmt: skip
def q24(s, d):
    """Chunks of the stream, shuffled and laid out anew."""
    total = _texts(s, d).agg(big(F.sum(F.size(tokens.lex(F.col("text"))))).alias("n"))
    c = streams.shuffle_chunks(total, 4096, SEED)
    return c.select(big("chunk").alias("chunk"), big("first").alias("first"), "length", big("start").alias("start"))


@query("q25", f"""
SELECT count(*)::BIGINT AS n_documents, count(*) FILTER (WHERE t.len IS NULL OR t.len = 0)::BIGINT AS n_empty, count(*) FILTER (WHERE rn > greatest(1, round_even(n * 0.02, 0)))::BIGINT AS train_documents,
 sum(tok) FILTER (WHERE rn > greatest(1, round_even(n * 0.02, 0)))::BIGINT AS train_tokens, sum(tok) FILTER (WHERE rn <= greatest(1, round_even(n * 0.02, 0)))::BIGINT AS val_tokens
 FROM ({_SPLIT}) t JOIN (SELECT doc_id, coalesce(len({TOKENS}), 0) AS tok FROM documents) USING (doc_id)""")  # fmt: skip
def q25(s, d):
    """Manifest of the packed corpus in one row."""
    t = _docs(s, d).select("doc_id", F.length("text").alias("len"), F.coalesce(F.size(tokens.lex(F.col("text"))), F.lit(0)).alias("tok"))
    t = streams.split_train_val(t, "doc_id", 0.02, SEED)
    train = F.col("split") == "train"
    return t.agg(
        F.count(F.lit(1)).alias("n_documents"), F.count_if(F.col("len").isNull() | (F.col("len") == 0)).alias("n_empty"), F.count_if(train).alias("train_documents"),
        big(F.sum(F.when(train, F.col("tok")))).alias("train_tokens"), big(F.sum(F.when(~train, F.col("tok")))).alias("val_tokens"),
    )


@query("q26", f"""
SELECT 'real' AS origin, doc_id AS id, 0::BIGINT AS copy FROM (SELECT doc_id FROM documents WHERE text IS NOT NULL ORDER BY sha256('{SEED}|' || doc_id), doc_id LIMIT 100)
UNION ALL SELECT 'curated', item_id, unnest(range(0, CASE WHEN eval_tier = 'exact' THEN 3 ELSE 2 END))::BIGINT FROM benchmark""")  # fmt: skip
def q26(s, d):
    """A capped sample of documents beside replicated curated items."""
    real = curriculum.capped_by_hash(_docs(s, d).filter("text IS NOT NULL").select("doc_id"), "doc_id", 100, SEED)
    real = real.select(F.lit("real").alias("origin"), F.col("doc_id").alias("id"), F.lit(0).cast("bigint").alias("copy"))
    cur = curriculum.replicate(load(s, d, "benchmark"), F.when(F.col("eval_tier") == "exact", 3).otherwise(2))
    return real.unionByName(cur.select(F.lit("curated").alias("origin"), F.col("item_id").alias("id"), big("copy").alias("copy")))


@query("q27", """
SELECT behavior, record_id FROM (SELECT behavior, record_id, row_number() OVER (PARTITION BY behavior ORDER BY record_id) AS rn FROM (SELECT DISTINCT behavior, record_id FROM agentcoder_slice_train WHERE behavior IS NOT NULL)) WHERE rn <= 20""")  # fmt: skip
def q27(s, d):
    """The first twenty records of each behaviour."""
    t = _slice(s, d).filter("behavior IS NOT NULL").select("behavior", "record_id").distinct()
    return ranking.first_n(t, ["behavior"], ["record_id"], 20)


@query("q28", "SELECT p_partkey, p_name, p_brand FROM part WHERE p_brand IN ('Brand#2', 'Brand#4', 'Brand#17') AND (contains(p_name, 'ring') OR contains(p_name, 'bolt'))")
def q28(s, d):
    """Equality in a set and any of several substrings; both reach the scan."""
    t = load(s, d, "part")
    return t.filter(curriculum.behavior_in(["Brand#2", "Brand#4", "Brand#17"], F.col("p_brand")) & curriculum.contains_any(["ring", "bolt"], F.col("p_name"))).select("p_partkey", "p_name", "p_brand")


@query("q29", """
WITH p AS (SELECT DISTINCT text FROM (SELECT unnest(messages).content AS text FROM agentcoder_slice_train WHERE messages IS NOT NULL UNION ALL SELECT text FROM documents) WHERE text IS NOT NULL)
SELECT (SELECT count(*) FROM p)::BIGINT AS n_train, (SELECT count(*) FROM p WHERE text IN (SELECT text FROM benchmark))::BIGINT AS n_overlap, (SELECT count(*) FROM p WHERE text NOT IN (SELECT text FROM benchmark))::BIGINT AS n_clean""")  # fmt: skip
def q29(s, d):
    """Training texts that equal a held-out text exactly, and those that don't."""
    key = lambda c: curriculum.text_key(F.col(c)).alias("key")
    texts = _slice(s, d).select(F.explode("messages.content").alias("text")).unionByName(_docs(s, d).select("text"))
    p = texts.select(key("text")).filter("key IS NOT NULL").distinct()
    b = load(s, d, "benchmark").select(key("text")).filter("key IS NOT NULL").distinct().withColumn("held", F.lit(True))
    return p.join(b, "key", "left").agg(F.count(F.lit(1)).alias("n_train"), F.count_if("held").alias("n_overlap"), F.count_if(F.col("held").isNull()).alias("n_clean"))


@query("q30", "SELECT DISTINCT substr(sha256(text), 1, 16) AS hash FROM benchmark WHERE text <> '' ORDER BY 1")
def q30(s, d):
    """Distinct prompt hashes."""
    return load(s, d, "benchmark").filter("text <> ''").select(stable_hash(F.col("text")).alias("hash")).distinct().orderBy("hash")


@query("q31", f"""
WITH r AS (SELECT n_name, row_number() OVER (ORDER BY sha256('{SEED}|' || n_name), n_name) AS r, count(*) OVER () AS n FROM nation)
SELECT a.n_name AS target, b.n_name AS decoy, a.j::BIGINT AS j FROM (SELECT *, unnest(range(1, 5)) AS j FROM r) a JOIN r b ON b.r = (a.r - 1 + a.j) % a.n + 1""")  # fmt: skip
def q31(s, d):
    """Four decoys for every target."""
    return curriculum.decoys(load(s, d, "nation"), "n_name", 4, SEED)


@query("q32", "SELECT n_name, r_name, ['copy', 'lookup', 'patch'][((n_nationkey + length(r_name)) % 3 + 1)::BIGINT] AS pattern FROM nation CROSS JOIN region")
def q32(s, d):
    """Every noun with every verb and a pattern chosen by their places; both are generator tables of fixed size."""
    # both tables are of fixed size; one row of names is joined to each noun and taken apart
    r = load(s, d, "region").agg(F.collect_list("r_name").alias("names"))
    n = load(s, d, "nation").select("n_nationkey", "n_name", F.lit(1).alias("one")).join(F.broadcast(r.withColumn("one", F.lit(1))), "one").select("n_nationkey", "n_name", F.explode("names").alias("r_name"))
    pattern = F.element_at(F.array(*map(F.lit, ["copy", "lookup", "patch"])), (F.col("n_nationkey") + F.length("r_name")) % 3 + 1)
    return n.select("n_name", "r_name", pattern.alias("pattern"))


@query("q33", """
SELECT i::BIGINT AS row_id, v::BIGINT AS variant, (17 + 17 * i + 1009 * v)::BIGINT AS seed, printf('pair_%03d', (i % 64)::INT) AS name, CASE WHEN i < 64 THEN 'seen' WHEN i < 96 THEN 'covered' ELSE 'heldout' END AS tier
 FROM (SELECT i, unnest(range(0, 3)) AS v FROM range(128) t(i))""")  # fmt: skip
def q33(s, d):
    """Indexed records with variants, seeds and tiers."""
    t = s.range(128).select(F.col("id").alias("row_id"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("variant"))
    tier = F.when(F.col("row_id") < 64, "seen").when(F.col("row_id") < 96, "covered").otherwise("heldout")
    return t.select("row_id", big("variant").alias("variant"), (17 + 17 * F.col("row_id") + 1009 * F.col("variant")).alias("seed"), F.format_string("pair_%03d", F.col("row_id") % 64).alias("name"), tier.alias("tier"))
