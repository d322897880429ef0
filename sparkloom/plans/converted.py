"""Queries h01 to h28: source converters, curricula, generators, copy routes and the run tracker, each on whole tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkloom.functions.cleaning import clean_language
from sparkloom.functions.text import stable_hash
from sparkloom.operators import converters, copying, curriculum, generators, records, runlog, sequences, tokens, tracker
from sparkloom.plans.corpus import SEED, big
from sparkloom.plans.registry import query
from sparkloom.plans.rules import ROLE, language
from sparkloom.session import new_folder
from sparkloom.tables import load, spread

_S = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_S}+|{_S}+$', '', 'g')"


_ONE = "(SELECT DISTINCT ON (record_id) * FROM agentcoder_slice_train ORDER BY record_id, ingested_at)"


def _one(s, d):
    """The first delivery of every record."""
    t = load(s, d, "agentcoder_slice_train")
    rest = [c for c in t.columns if c not in ("record_id", "ingested_at")]
    first = t.groupBy("record_id").agg(F.min(F.struct("ingested_at", *rest)).alias("r"))
    return first.select("record_id", *[F.col(f"r.{c}").alias(c) for c in rest])


@query("h01", f"""
WITH m AS (SELECT record_id * 100 + pos AS message_id, CASE WHEN pos > 0 THEN record_id * 100 + pos - 1 END AS parent_id, role, content AS text, pos AS ord, {language('lang')} IN ('en', 'unknown') AS keep FROM
 (SELECT record_id, lang, unnest(messages).role AS role, unnest(messages).content AS content, generate_subscripts(messages, 1) - 1 AS pos FROM {_ONE} WHERE messages IS NOT NULL)), r AS (SELECT *, {ROLE.replace('m.role', 'role')} AS rr FROM m WHERE keep)
SELECT c.message_id, p.message_id AS parent_id, substr(sha256(p.text), 1, 16) AS prompt, substr(sha256(c.text), 1, 16) AS answer FROM r c JOIN r p ON p.message_id = c.parent_id WHERE c.rr = 'assistant' AND p.rr = 'user' AND p.ord < c.ord""")  # fmt: skip
def h01(s, d):
    """Threads rebuilt from parent ids: an assistant's message with the user message it answers."""
    t = _one(s, d).filter("messages IS NOT NULL").select("record_id", "lang", F.posexplode("messages").alias("ord", "m"))
    own = F.col("record_id") * 100 + F.col("ord")
    t = t.select(own.alias("message_id"), F.when(F.col("ord") > 0, own - 1).alias("parent_id"), "m.role", F.col("m.content").alias("text"), "ord", "lang")
    p = records.threaded_pairs(t, clean_language(F.col("lang")).isin("en", "unknown"))
    return p.select("message_id", "parent_id", stable_hash(F.col("prompt")).alias("prompt"), stable_hash(F.col("answer")).alias("answer"))


_NORMAL = f"list_transform(list_filter(messages, lambda m: m IS NOT NULL AND trim(coalesce(m.content, '')) <> ''), lambda m: {{'role': {ROLE}, 'content': m.content}})"


@query("h02", f"""
SELECT record_id::VARCHAR AS instance_id, CASE WHEN ms[1].role = 'system' THEN ms[1].content ELSE '' END AS system, len(ms) - CASE WHEN ms[1].role = 'system' THEN 1 ELSE 0 END AS n_messages,
 CASE WHEN {_strip("coalesce(final, '')")} <> '' THEN 1 ELSE 0 END AS n_patches, CASE WHEN {language('lang')} = 'unknown' THEN 3 ELSE 4 END AS n_lines FROM (SELECT *, {_NORMAL} AS ms FROM {_ONE} WHERE messages IS NOT NULL)
 WHERE len(ms) > 0 AND record_id % 2 = 1 AND {language('lang')} IN ('en', 'de', 'unknown')""")  # fmt: skip
def h02(s, d):
    """Trajectories as records: filter by language and outcome, system turn hoisted, patches as steps."""
    lang = F.nullif(clean_language(F.col("lang")), F.lit("unknown"))
    t = _one(s, d).select(F.col("record_id").cast("string").alias("instance_id"), F.lit("shop/desk").alias("repo"), lang.alias("language"), F.col("record_id") % 2 == 1, F.col("messages").alias("trajectory"), F.trim("final").alias("model_patch"))
    t = t.toDF("instance_id", "repo", "language", "resolved", "trajectory", "model_patch")
    r = converters.trajectories(t, source="src", languages=["en", "de"], resolved_only=True)
    return r.select(F.regexp_extract("repo_context", r"instance_id: (\d+)", 1).alias("instance_id"), "system", big(F.size("messages")).alias("n_messages"), big(F.size("trace")).alias("n_patches"), big(F.size(F.split("repo_context", "\n"))).alias("n_lines"))


@query("h03", f"""
SELECT len(ms)::BIGINT AS n_messages, count(*)::BIGINT AS n, sum(list_sum(list_transform(ms, lambda m: length(m.content))))::BIGINT AS chars FROM (SELECT *, {_NORMAL} AS ms FROM {_ONE} WHERE messages IS NOT NULL)
 WHERE len(ms) > 0 AND record_id % 5 <> 0 AND {language('lang')} IN ('en', 'unknown') GROUP BY 1""")  # fmt: skip
def h03(s, d):
    """Conversations not flagged toxic, English or of unknown language, without empty ones."""
    toxic = F.when(F.col("record_id") % 5 == 0, True).when(F.col("record_id") % 5 == 1, False)
    t = _one(s, d).select(toxic.alias("toxic"), F.nullif(clean_language(F.col("lang")), F.lit("unknown")).alias("language"), F.col("messages").alias("conversation"))
    r = converters.conversations(t, english_only=True)
    chars = F.aggregate("messages", F.lit(0).cast("bigint"), lambda a, m: a + F.length(m["content"]))
    return r.groupBy(big(F.size("messages")).alias("n_messages")).agg(F.count(F.lit(1)).alias("n"), F.sum(chars).alias("chars"))


@query("h04", f"SELECT substr(sha256('# source: desk' || chr(10) || {_strip('text')}), 1, 16) AS hash, count(*)::BIGINT AS n FROM documents WHERE {_strip('text')} <> '' GROUP BY 1")
def h04(s, d):
    """Plain texts under a header line; blank ones are dropped."""
    t = converters.texts(load(s, d, "documents").select("text"), source="desk")
    return t.groupBy(stable_hash(F.col("text")).alias("hash")).agg(F.count(F.lit(1)).alias("n"))


@query("h05", """
SELECT CASE WHEN l_returnflag = 'A' THEN 'language' WHEN l_discount < 0.03 THEN 'score' WHEN l_linenumber = 3 THEN 'status' WHEN l_linestatus = 'O' AND l_quantity < 10 THEN 'prompt' WHEN l_tax > 0.07 THEN 'answer' WHEN l_quantity > 45 THEN 'length' ELSE 'kept' END AS reason, count(*)::BIGINT AS n FROM lineitem GROUP BY 1""")  # fmt: skip
def h05(s, d):
    """Question and solution rows by the first condition they fail."""
    t = load(s, d, "lineitem").select(
        F.when(F.col("l_returnflag") == "A", "go").otherwise("Python 3").alias("language"), F.col("l_discount").alias("average_test_score"), F.when(F.col("l_linenumber") == 3, False).alias("passed"),
        F.when((F.col("l_linestatus") == "O") & (F.col("l_quantity") < 10), " ").otherwise("q").alias("question"), F.when(F.col("l_tax") > 0.07, F.lit(None).cast("string")).otherwise(F.repeat(F.lit("a"), F.col("l_quantity").cast("int"))).alias("answer"), F.lit("assert 1").alias("tests"),
    )
    return converters.code_questions(t, F.lit(0), dataset="d", least_score=0.03, need_tests=True, longest=45)[1]


@query("h06", f"""
SELECT dest, count(*)::BIGINT AS n, sum(doc_id)::BIGINT AS ids FROM (SELECT doc_id, CASE WHEN doc_id % 50 = 0 OR ('0x' || substr(sha256('{SEED}|' || doc_id), 1, 8))::BIGINT / 4294967296.0 < 0.2 THEN 'eval' ELSE 'train' END AS dest FROM documents) GROUP BY 1""")  # fmt: skip
def h06(s, d):
    """Documents routed to evaluation by a flag or by their hash."""
    t = load(s, d, "documents").select("doc_id", F.when(F.col("doc_id") % 50 == 0, " Test ").otherwise("train").alias("split"))
    return converters.route(t, "doc_id", fraction=0.2, seed=SEED).groupBy("dest").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("ids"))


@query("h07", """
WITH t AS (SELECT CASE WHEN trim(coalesce(final, '')) = '' THEN 'empty_final' WHEN NOT coalesce(behavior IN ('patch', 'review'), FALSE) THEN 'behavior' WHEN NOT coalesce(topic IN ('caching', 'parsing', 'absent'), FALSE) THEN 'topic' WHEN contains(final, 'return') THEN 'forbidden' ELSE 'valid' END AS problem, topic FROM agentcoder_slice_train)
SELECT problem, coalesce(topic, '') AS subject, count(*)::BIGINT AS n FROM t WHERE problem <> 'valid' GROUP BY 1, 2
UNION ALL SELECT p, s, 0 FROM (VALUES ('missing_topic', 'caching'), ('missing_topic', 'parsing'), ('missing_anchor', 'absent')) v(p, s) WHERE s NOT IN (SELECT topic FROM t WHERE problem = 'valid' AND topic IS NOT NULL)""")  # fmt: skip
def h07(s, d):
    """Records by the first rule they break, and required topics that no valid record has."""
    t = load(s, d, "agentcoder_slice_train").select("final", "behavior", "topic")
    return converters.validate(t, behaviors=["patch", "review"], required=["caching", "parsing"], anchors=["absent"], forbidden=["return"])


@query("h08", """
WITH u AS (SELECT DISTINCT m.content AS text FROM (SELECT unnest(messages) AS m FROM agentcoder_slice_train WHERE messages IS NOT NULL) WHERE m.role = 'user' AND m.content IS NOT NULL), h AS (SELECT text FROM u WHERE length(text) % 7 = 0)
SELECT (SELECT count(*) FROM u WHERE text IN (SELECT text FROM h))::BIGINT AS n_overlap, (SELECT count(*) FROM u WHERE text NOT IN (SELECT text FROM h))::BIGINT AS n_disjoint""")  # fmt: skip
def h08(s, d):
    """User prompts that are held out, and those that are not."""
    t = load(s, d, "agentcoder_slice_train").select(F.explode("messages").alias("m")).filter("m.role = 'user' AND m.content IS NOT NULL").select(F.col("m.content").alias("text"))
    held = t.filter(F.length("text") % 7 == 0)
    a = curriculum.overlap(t, held, "text").agg(F.count(F.lit(1)).alias("n_overlap"))
    b = curriculum.disjoint(t, held, "text").select(F.xxhash64("text").alias("h"), F.md5("text").alias("m")).distinct().agg(F.count(F.lit(1)).alias("n_disjoint"))
    return a.crossJoin(b)  # one row each


@query("h09", """
SELECT behavior, record_id, array_to_string(list_sort(list_filter([CASE WHEN behavior IS NOT NULL THEN 'behavior' END, CASE WHEN final IS NOT NULL THEN 'final' END, CASE WHEN license IS NOT NULL THEN 'license' END, CASE WHEN record_id IS NOT NULL THEN 'record_id' END], lambda x: x IS NOT NULL)), ',') AS columns FROM
 (SELECT *, row_number() OVER (PARTITION BY behavior ORDER BY record_id) AS rn FROM (SELECT behavior, record_id, any_value(final) AS final, any_value(license) AS license FROM agentcoder_slice_train GROUP BY 1, 2)) WHERE rn <= 3""")  # fmt: skip
def h09(s, d):
    """Three example records a behaviour with the names of their filled columns."""
    t = load(s, d, "agentcoder_slice_train").groupBy("behavior", "record_id").agg(F.max("final").alias("final"), F.max("license").alias("license"))
    return converters.examples(t, "behavior", "record_id", 3).select("behavior", "record_id", F.array_join("columns", ",").alias("columns"))


@query("h10", """
SELECT p_partkey, 'd:' || CASE WHEN p_partkey % 4 = 0 THEN printf('row_%06d', p_partkey) ELSE substr(p_name || '-' || p_partkey, 1, 120) END AS _curriculum_source, nullif(trim(CASE WHEN p_size > 25 THEN ' ' ELSE p_brand END), '') AS license,
 CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE '[' || p_partkey || ',2]' END AS tests FROM part""")  # fmt: skip
def h10(s, d):
    """Canonical records with fallback ids, optional fields and the first test payload there is."""
    even = F.col("p_partkey") % 2 == 0
    t = load(s, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 4 == 0, "  ").otherwise(F.concat("p_name", F.lit("-"), F.col("p_partkey").cast("string"))).alias("task_id"), F.when(F.col("p_size") > 25, " ").otherwise(F.col("p_brand")).alias("license"), F.when(even, F.col("p_name")).alias("tests"), F.concat(F.lit("["), F.col("p_partkey").cast("string"), F.lit(",2]")).alias("test_list"))
    rec = converters.record(F.lit("q"), F.lit("a"), topic="t", behavior=F.lit("b"), dataset="d", source_id=converters.source_id(t, F.col("p_partkey")), license_=F.col("license"))
    return t.select("p_partkey", converters.test_text(t).alias("tests"), *rec).select("p_partkey", "_curriculum_source", "license", "tests")


@query("h11", """
SELECT n_name, t::BIGINT AS template, replace(replace(['Name the region of {n_name}.', 'Is {n_name} number {n_nationkey}?', 'Spell {n_name}.'][(t + 1)::BIGINT], '{n_name}', n_name), '{n_nationkey}', n_nationkey::VARCHAR) AS prompt FROM nation, range(2) r(t)""")  # fmt: skip
def h11(s, d):
    """Specs times the first two of three prompt templates."""
    t = generators.expand(load(s, d, "nation").select("n_name", "n_nationkey"), ["Name the region of {n_name}.", "Is {n_name} number {n_nationkey}?", "Spell {n_name}."], ["n_name", "n_nationkey"], limit=2)
    return t.select("n_name", big("template").alias("template"), "prompt")


_FORM = "['identifier', 'filename', 'flag', 'caseid'][((i + k) % 4 + 1)::BIGINT]"


@query("h12", f"""
SELECT i::BIGINT AS index, v::BIGINT AS variant, (17 + 17 * i + 1009 * v)::BIGINT AS seed, CASE WHEN i < 128 THEN 'seen' WHEN i < 192 THEN 'covered' ELSE 'heldout' END AS tier, key,
 CASE {_FORM} WHEN 'identifier' THEN printf('copy_%s_%03d', key, i::INT) WHEN 'filename' THEN printf('copy_%s_%03d.py', key, i::INT) WHEN 'flag' THEN printf('flag%d_%s_%03d', (i % 4)::INT, key, i::INT) ELSE printf('case_%s_%03d', key, i::INT) END AS value
 FROM range(256) t(i), range(3) u(v), (SELECT unnest(['alpha', 'beta', 'gamma', 'delta', 'omega']) AS key, unnest(range(5)) AS k)""")  # fmt: skip
def h12(s, d):
    """Indexed maps of generated values in four formats."""
    t = generators.key_values(s, 256, ["alpha", "beta", "gamma", "delta", "omega"], 3, SEED)
    return t.select("index", big("variant").alias("variant"), "seed", "tier", F.explode("slots").alias("key", "value"))


@query("h13", """
WITH k AS (SELECT i AS index, key, row_number() OVER (PARTITION BY i ORDER BY sha256('f|' || (17 + 17 * i) || key), key) AS r FROM range(512) t(i), (SELECT unnest(['alpha', 'beta', 'gamma', 'delta', 'omega']) AS key))
SELECT index::BIGINT AS index, string_agg(key, ',' ORDER BY r) FILTER (WHERE r <= 2) AS targets, string_agg(key, ',' ORDER BY r) FILTER (WHERE r BETWEEN 3 AND 4) AS distractors FROM k GROUP BY 1""")  # fmt: skip
def h13(s, d):
    """Fields drawn without replacement as targets and distractors."""
    t = s.range(512).select(F.col("id").alias("index"), (17 + 17 * F.col("id")).alias("seed"))
    t = generators.choose_fields(t, ["alpha", "beta", "gamma", "delta", "omega"], 2, 2)
    return t.select("index", F.array_join("targets", ",").alias("targets"), F.array_join("distractors", ",").alias("distractors"))


@query("h14", """
WITH m AS (SELECT n_nationkey, 'mirror' AS mode, n_nationkey % 10 AS i FROM nation UNION ALL SELECT n_nationkey, 'heldout', n_nationkey + 10 FROM nation UNION ALL SELECT n_nationkey, 'ladder', n_nationkey % 10 FROM nation UNION ALL SELECT n_nationkey, 'ladder', n_nationkey + 10 FROM nation)
SELECT mode, count(*)::BIGINT AS n, sum(i)::BIGINT AS total FROM m GROUP BY 1""")  # fmt: skip
def h14(s, d):
    """Evaluation rows of an indexed generator: mirrored, held out, and both."""
    t = load(s, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("index"))
    out = None
    for mode in ("mirror", "heldout", "ladder"):
        part = generators.modes(t, 10, mode).groupBy(F.lit(mode).alias("mode")).agg(F.count(F.lit(1)).alias("n"), F.sum("index").alias("total"))
        out = part if out is None else out.unionByName(part)
    return out


@query("h15", f"""
SELECT n_regionkey::BIGINT AS n_regionkey, string_agg(n_name || '=' || n_nationkey, chr(10) ORDER BY sha256('{SEED}|' || n_name || '=' || n_nationkey)) AS context FROM nation GROUP BY 1""")  # fmt: skip
def h15(s, d):
    """The entries of each key in hash order, one a line."""
    t = load(s, d, "nation")
    return generators.shuffled_context(t, "n_regionkey", F.concat("n_name", F.lit("="), F.col("n_nationkey").cast("string")), SEED).withColumn("n_regionkey", big("n_regionkey"))


WINDOW = 24
_WINDOWS = f"""SELECT doc_id, list_transform(list_slice(regexp_extract_all(text, '{tokens.LEXER}', 0), 1, {WINDOW}), lambda x: length(x)) AS ids FROM documents WHERE length(text) > 0"""


def _windows(s, d):
    """The lengths of a document's first tokens stand for the ids of one model window."""
    t = spread(load(s, d, "documents").select("doc_id", "text").filter("length(text) > 0"))
    return t.select("doc_id", F.transform(F.slice(tokens.lex(F.col("text")), 1, WINDOW), lambda x: F.length(x)).alias("ids"))


_PAIRS = f"WITH w AS ({_WINDOWS}), p AS (SELECT doc_id, ids, t, s FROM w, range({WINDOW}) a(t), range({WINDOW}) b(s) WHERE t < len(ids) AND s < len(ids))"
_AT = lambda i: f"CASE WHEN {i} >= 0 AND {i} < len(ids) THEN ids[({i} + 1)::BIGINT] END"
_EQ = lambda a, b: f"CASE WHEN {_AT(a)} = {_AT(b)} THEN 1.0 ELSE 0.0 END"


def _grid_rows(t, name: str):
    # outer: of a plain explode the optimizer infers that the grid is not empty, and works that out anew in the scan
    rows = t.select("doc_id", F.posexplode_outer(name).alias("t", "row")).select("doc_id", "t", F.posexplode_outer("row").alias("s", "p")).filter("p > 0")
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("p") * (F.col("t") + 1) * (F.col("s") + 3)), 6).alias("weighted"))


_CONSISTENT = " + ".join(f"{2 - o} * ({_EQ(f's - {w}', f't - {o}')})" for o in range(2) for w in range(2))


@query("h16", f"""
{_PAIRS} SELECT doc_id, count(*)::BIGINT AS n, round(sum(x * (t + 1) * (s + 3)), 6)::DOUBLE AS weighted FROM (SELECT doc_id, t, s, ({_CONSISTENT}) * (0.5 / 6.0) AS x FROM p WHERE s < t) WHERE x > 0 GROUP BY 1""")  # fmt: skip
def h16(s, d):
    """Bias to sources whose neighbourhood holds the latest tokens."""
    return _grid_rows(_windows(s, d).select("doc_id", copying.consistency(F.col("ids"), 2, 1, 0.5).alias("g")), "g")


_CARRY = " + ".join(f"{2 - o + 1} * CASE WHEN len(list_filter(list_slice(ids, 1, (t + 1)::BIGINT), lambda x: x = {_AT(f't - {o}')})) <= 3 THEN ({' + '.join(f'({_EQ(f's - {k}', f't - {o}')})' for k in (1, 2))}) ELSE 0.0 END" for o in (1, 2))


@query("h17", f"""
{_PAIRS} SELECT doc_id, count(*)::BIGINT AS n, round(sum(x / total * (t + 1) * (s + 3)), 6)::DOUBLE AS weighted FROM (SELECT *, sum(x) OVER (PARTITION BY doc_id, t) AS total FROM (SELECT doc_id, t, s, ({_CARRY}) AS x FROM p WHERE s < t)) WHERE x > 0 GROUP BY 1""")  # fmt: skip
def h17(s, d):
    """Sources up to two places behind an earlier copy of a rare recent token."""
    return _grid_rows(_windows(s, d).select("doc_id", copying.binding_carry(F.col("ids"), 2, 2, most=3).alias("g")), "g")


@query("h18", f"""
{_PAIRS} SELECT doc_id, count(*)::BIGINT AS n, round(sum(x / total * (t + 1) * (s + 3)), 6)::DOUBLE AS weighted FROM (SELECT *, sum(x) OVER (PARTITION BY doc_id, t) AS total FROM
 (SELECT doc_id, t, s, 2 * (({_EQ('s - 1', 't - 1')}) + ({_EQ('s - 2', 't - 1')})) AS x FROM p WHERE s < t AND {_AT('s')} NOT IN (1))) WHERE x > 0 GROUP BY 1""")  # fmt: skip
def h18(s, d):
    """Sources that follow an earlier copy of the latest key, without stop tokens."""
    first, _ = copying.key_follow(F.col("ids"), 2, span=2, stops=(1,))
    return _grid_rows(_windows(s, d).select("doc_id", first.alias("g")), "g")


@query("h19", f"""
{_PAIRS}, x AS (SELECT doc_id, ids, t, s, x / total AS p FROM (SELECT *, sum(x) OVER (PARTITION BY doc_id, t) AS total FROM (SELECT doc_id, ids, t, s, 2 * (({_EQ('s - 1', 't - 1')}) + ({_EQ('s - 2', 't - 1')})) AS x FROM p WHERE s < t)) WHERE x > 0),
 y AS (SELECT doc_id, t, ids[s + 1] AS token, sum(p) AS p FROM x GROUP BY 1, 2, 3)
SELECT token::BIGINT AS token, count(*)::BIGINT AS n, round(sum(p), 6)::DOUBLE AS p, round(avg(ln(0.7 * exp(-token / 10.0) + 0.3 * p)), 6)::DOUBLE AS mixed FROM y GROUP BY 1""")  # fmt: skip
def h19(s, d):
    """Copy weights added up by the token they fall on, and mixed with other log probabilities."""
    first, _ = copying.key_follow(F.col("ids"), 2, span=2)
    t = copying.by_token(_windows(s, d).withColumn("g", first), "doc_id", "ids", "g")
    mixed = copying.log_mix(-F.col("token") / 10.0, F.log("p"), F.lit(0.3))
    return t.groupBy(big("token").alias("token")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("p"), 6).alias("p"), F.round(F.avg(mixed), 6).alias("mixed"))


@query("h20", """
WITH r AS (SELECT run_id, lower(trim(status)) AS status, started_at, ended_at, params, updated_at FROM run_registry WHERE run_id IS NOT NULL),
 st AS (SELECT run_id, max({'u': updated_at, 's': status}) FILTER (WHERE status IS NOT NULL) AS m, min(started_at) AS b, max(ended_at) AS e FROM r GROUP BY 1),
 kv AS (SELECT run_id, k, max({'u': updated_at, 'v': params[k]}) AS m FROM (SELECT *, unnest(map_keys(params)) AS k FROM r WHERE params IS NOT NULL) GROUP BY 1, 2)
SELECT st.run_id, st.m.s AS status, round(coalesce(greatest(0.0, (epoch_us(e) - epoch_us(b)) / 1e6), -1), 6)::DOUBLE AS seconds, coalesce((SELECT string_agg(k || '=' || kv.m.v, ';' ORDER BY k) FROM kv WHERE kv.run_id = st.run_id), '') AS params FROM st""")  # fmt: skip
def h20(s, d):
    """The registry as the tracker keeps it: appended states, the last status, merged parameters, duration."""
    t = tracker.Tracker(s, new_folder(s, "tracker"))
    t.add_states(load(s, d, "run_registry").filter("run_id IS NOT NULL").select("run_id", F.lower(F.trim("status")).alias("status"), "started_at", "ended_at", "params", F.col("updated_at").alias("at")))
    params = F.coalesce(F.array_join(F.transform(F.map_entries("params"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";"), F.lit(""))
    return t.registry().select("run_id", "status", F.round(F.coalesce("seconds", F.lit(-1.0)), 6).alias("seconds"), params.alias("params"))


@query("h21", """
SELECT run_id, metric, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM (SELECT run_id, unnest(['train_loss', 'tokens_per_sec']) AS metric, unnest([train_loss, tokens_per_sec]) AS value FROM train_log WHERE run_id IS NOT NULL) WHERE value IS NOT NULL AND value < 'NaN'::DOUBLE GROUP BY 1, 2""")  # fmt: skip
def h21(s, d):
    """Metrics appended to the tracker and read back."""
    t = tracker.Tracker(s, new_folder(s, "tracker"))
    log = load(s, d, "train_log").filter("run_id IS NOT NULL")
    t.add_metrics(runlog.melt(log, ["run_id", "global_step"], ["train_loss", "tokens_per_sec"]).withColumnRenamed("global_step", "step"))
    m = t.metrics().filter(~F.isnan("value"))
    return m.groupBy("run_id", "metric").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("h22", f"""
WITH a AS (SELECT doc_id, x, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r, sum(length(x)) OVER (PARTITION BY doc_id ORDER BY i) AS c FROM
 (SELECT doc_id, {_strip('x')} AS x, i FROM (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, regexp_split_to_array(text, '\\r\\n|[\\n\\x{{0b}}\\f\\r\\x{{85}}\\x{{2028}}\\x{{2029}}]') AS l FROM documents WHERE text IS NOT NULL)) WHERE starts_with({_strip('x')}, 'assert '))),
 k AS (SELECT doc_id, x, r FROM a WHERE r <= 4 AND c <= 200)
SELECT d.doc_id, coalesce(string_agg(x, '|' ORDER BY r), '') AS kept FROM documents d LEFT JOIN k USING (doc_id) WHERE d.text IS NOT NULL GROUP BY 1""")  # fmt: skip
def h22(s, d):
    """Assert lines of each document, as a prefix within a count and a number of characters."""
    t = spread(load(s, d, "documents").select("doc_id", "text").filter("text IS NOT NULL"))
    return t.select("doc_id", F.array_join(converters.assertion_lines(F.array("text"), most=4, chars=200), "|").alias("kept"))


@query("h23", """
SELECT l_orderkey, coalesce(min({'p': round(l_discount + l_tax, 6), 'n': length(c), 'c': c}) FILTER (WHERE length(c) <= 30).c, '') AS code FROM (SELECT *, l_returnflag || l_linestatus || repeat('x', l_quantity::INT) AS c FROM lineitem) GROUP BY 1""")  # fmt: skip
def h23(s, d):
    """Of an order's snippets the one of least penalty, then shortest, that fits."""
    code = F.concat("l_returnflag", "l_linestatus", F.repeat(F.lit("x"), F.col("l_quantity").cast("int")))
    t = load(s, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(code.alias("code"), F.round(F.col("l_discount") + F.col("l_tax"), 6).alias("far"), F.lit(0.0).alias("frr"))).alias("snippets"))
    return t.select("l_orderkey", records.code_test_snippet(F.col("snippets"), 30).alias("code"))


@query("h24", """
SELECT run_id, list_aggregate(list_sort(list_transform(map_entries(map_concat(coalesce(params, MAP {}::MAP(VARCHAR, VARCHAR)), MAP {'seed': 'new', 'extra': 'x'})), lambda e: e.key || '=' || e.value)), 'string_agg', ';') AS params FROM (SELECT DISTINCT run_id, params FROM run_registry WHERE run_id IS NOT NULL)""")  # fmt: skip
def h24(s, d):
    """Parameters merged into a run's, the new value of a key winning."""
    t = load(s, d, "run_registry").filter("run_id IS NOT NULL")
    merged = runlog.merge_params(F.coalesce("params", F.create_map().cast("map<string,string>")), F.create_map(F.lit("seed"), F.lit("new"), F.lit("extra"), F.lit("x")))
    text = F.array_join(F.array_sort(F.transform(F.map_entries(merged), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
    return t.select("run_id", F.to_json(F.map_from_entries(F.array_sort(F.map_entries("params")))).alias("j"), text.alias("params")).distinct().select("run_id", "params")


@query("h25", """
SELECT 'd:' || printf('row_%06d', p_partkey) AS _curriculum_source, 'Implement the Python function `f' || p_partkey || '(a)`.' || chr(10) || 'Docstring/behavior:' || chr(10) || p_name || chr(10) || 'Return only a Python code block.' AS prompt, 'path: ' || p_brand AS repo_context,
 '```python' || chr(10) || 'def f' || p_partkey || '(a):' || chr(10) || '    return a + ' || p_size || chr(10) || '```' AS answer FROM part WHERE p_partkey % 3 = 0""")  # fmt: skip
def h25(s, d):
    """Function rows that parse, with a prompt from signature and docstring; broken and empty ones are dropped."""
    key, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    code = F.concat(F.lit("def f"), key, F.lit("(a):\n    return a + "), size)
    t = load(s, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, code).when(F.col("p_partkey") % 3 == 1, F.concat(code, F.lit(" + ("))).otherwise("x = 1").alias("func_code"), F.concat(F.lit("f"), key, F.lit("(a)")).alias("signature"), F.col("p_name").alias("docstring"), F.col("p_brand").alias("path"))
    r = converters.functions(t, F.col("p_partkey"), dataset="d", most_lines=5)
    return r.select("_curriculum_source", F.col("messages")[0]["content"].alias("prompt"), "repo_context", F.col("messages")[1]["content"].alias("answer"))


@query("h26", """
WITH t AS (SELECT p_partkey, 'def f(a):' || chr(10) || '    return a + ' || p_size AS code, 'assert f(1) == ' || (p_size + 1) AS tests, CASE WHEN p_partkey % 2 = 0 THEN p_name END AS q FROM part WHERE p_partkey % 5 <> 0)
SELECT 'd:' || printf('row_%06d', p_partkey) AS _curriculum_source, 'code_pytest' AS topic, 'Write focused pytest tests for this Python code:' || chr(10) || '```python' || chr(10) || code || chr(10) || '```' AS prompt, '```python' || chr(10) || tests || chr(10) || '```' AS answer FROM t
UNION ALL SELECT 'd:' || printf('row_%06d', p_partkey) || ':implementation', 'code_implementation', q || chr(10) || chr(10) || 'The implementation should satisfy these tests:' || chr(10) || tests, '```python' || chr(10) || code || chr(10) || '```' FROM t WHERE q IS NOT NULL""")  # fmt: skip
def h26(s, d):
    """Code with tests as one or two records: write the tests, and with a prompt also write the code."""
    size = F.col("p_size").cast("string")
    t = load(s, d, "part").select("p_partkey", F.concat(F.lit("def f(a):\n    return a + "), size, F.when(F.col("p_partkey") % 5 == 0, " + (").otherwise("")).alias("code_ground_truth"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).alias("question"), F.concat(F.lit("assert f(1) == "), (F.col("p_size") + 1).cast("string")).alias("tests"))
    r = converters.code_with_tests(t, F.col("p_partkey"), F.col("tests"), dataset="d", longest_code=100)
    return r.select("_curriculum_source", "topic", F.col("messages")[0]["content"].alias("prompt"), F.col("messages")[1]["content"].alias("answer"))


@query("h27", """
SELECT 'd:' || printf('row_%06d', p_partkey) AS _curriculum_source, p_name AS prompt, 'file: m' || p_partkey || '.py' || chr(10) || 'a = 1' || chr(10) || 'x = ' || p_size AS repo_context,
 '```diff' || chr(10) || '--- a/m' || p_partkey || '.py' || chr(10) || '+++ b/m' || p_partkey || '.py' || chr(10) || '@@ -1,2 +1,2 @@' || chr(10) || ' a = 1' || chr(10) || '-x = ' || p_size || chr(10) || '+x = ' || (p_size + 1) || chr(10) || '```' AS answer FROM part WHERE p_partkey % 4 <> 0""")  # fmt: skip
def h27(s, d):
    """Commits as patch records; unchanged files are dropped, and a path without a suffix gets one."""
    size = F.col("p_size").cast("string")
    text = lambda x: F.concat(F.lit("a = 1\nx = "), x, F.lit("\n"))
    t = load(s, d, "part").select("p_partkey", F.col("p_name").alias("subject"), F.concat(F.lit("m"), F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 2 == 0, ".py").otherwise("")).alias("path"), text(size).alias("old_contents"), text(F.when(F.col("p_partkey") % 4 == 0, size).otherwise((F.col("p_size") + 1).cast("string"))).alias("new_contents"))
    r = converters.commits(t, F.col("p_partkey"), dataset="d", most_lines=20, longest=200)
    return r.select("_curriculum_source", F.col("messages")[0]["content"].alias("prompt"), "repo_context", F.col("messages")[1]["content"].alias("answer"))


@query("h28", """
WITH m AS (SELECT record_id, pos, role, substr(sha256(content), 1, 8) AS token FROM (SELECT record_id, unnest(messages).role AS role, unnest(messages).content AS content, generate_subscripts(messages, 1) - 1 AS pos FROM (SELECT record_id, min(messages) AS messages FROM agentcoder_slice_train WHERE messages IS NOT NULL GROUP BY 1))),
 a AS (SELECT record_id, token, row_number() OVER (PARTITION BY record_id ORDER BY pos) - 1 AS segment FROM m WHERE role = 'user'), o AS (SELECT record_id, pos, row_number() OVER (PARTITION BY record_id ORDER BY pos) - 1 AS segment FROM m WHERE role = 'assistant')
SELECT o.record_id, o.segment::BIGINT AS segment, o.pos::BIGINT AS first, a.token AS requested FROM o LEFT JOIN a USING (record_id, segment)""")  # fmt: skip
def h28(s, d):
    """Each answer of a record with the request that it serves: the n-th request goes to the n-th answer."""
    t = load(s, d, "agentcoder_slice_train").filter("messages IS NOT NULL").groupBy("record_id").agg(F.min("messages").alias("messages"))
    m = t.select("record_id", F.posexplode("messages").alias("pos", "m")).select("record_id", "pos", "m.role", F.substring(F.sha2(F.col("m.content").cast("binary"), 256), 1, 8).alias("token"))
    w = Window.partitionBy("record_id").orderBy("pos")
    outputs = m.filter("role = 'assistant'").select("record_id", (F.row_number().over(w) - 1).alias("segment"), big("pos").alias("first"))
    r = sequences.request_follow(m.filter("role = 'user'").select("record_id", "pos", "token"), outputs, "record_id")
    return r.select("record_id", big("segment").alias("segment"), "first", "requested")
