from pyspark.sql import functions as F

from sparkloom.functions.python_udfs import decode_tokens
from sparkloom.operators import curriculum, ranking, records, streams, tokens


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def test_lexer_is_lossless(spark):
    texts = ["def f(x):\n    return x != 1.5 ... <|user|> ```@@ --- é漢🙂\x1c", "", "  \t"]
    t = docs(spark, *texts).select(tokens.lex(F.col("text")).alias("t"))
    got = [r[0] for r in t.collect()]
    assert ["".join(g) for g in got] == texts
    assert "<|user|>" in got[0] and "1.5" in got[0] and "!=" in got[0] and "..." in got[0]


def test_vocabulary_order_and_ids(spark):
    d = docs(spark, "b a b", "a c" + " " * 9 + "d", None)
    v = tokens.vocabulary(tokens.frequencies(d, "doc_id", "text"), 269 + 4)
    assert [(r.token, r.id) for r in v.orderBy("id").collect()] == [(" ", 269), ("b", 270), ("a", 271), ("c", 272)]


def test_round_trip_with_byte_fallback(spark):
    d = docs(spark, "known", "unknown é 🙂", "")
    v = tokens.with_specials(spark.createDataFrame([("known", 269), (" ", 270)], "token string, id bigint"))
    ids = tokens.encode_documents(d, "doc_id", "text", v)
    assert {r.doc_id: len(r.ids) for r in ids.collect()} == {0: 1, 1: 7 + 1 + 2 + 1 + 4}
    back = tokens.decode(ids, "doc_id", v).select("doc_id", decode_tokens("tokens").alias("t"))
    assert {r.doc_id: r.t for r in back.collect()} == {0: "known", 1: "unknown é 🙂"}


def test_ownership(spark):
    t = spark.createDataFrame([([("user", "q"), ("assistant", "a b")],), ([],)], "s array<struct<tag:string,body:string>>")
    got = [tuple(r[0]) for r in t.select(tokens.ownership(F.col("s"), records.OWNED)).collect()]
    assert got == [(4 + 6, 6), (0, 0)]


def test_split_has_at_least_one(spark):
    t = streams.split_train_val(docs(spark, *"abcdefg"), "doc_id", 0.01, 17)
    assert t.filter("split = 'val'").count() == 1 and t.count() == 7
    assert streams.split_train_val(docs(spark), "doc_id", 0.5, 17).count() == 0
    five = streams.split_train_val(docs(spark, *"abcde"), "doc_id", 0.5, 17)  # 2.5 rounds to even
    assert five.filter("split = 'val'").count() == 2


def test_offsets_are_contiguous(spark):
    t = spark.range(200).select(F.col("id").alias("doc_id"), (F.col("id") % 7).alias("n"))
    rows = sorted((r.start, r.stop) for r in streams.offsets(t, "doc_id", F.col("n"), 17).collect())
    assert rows[0][0] == 0 and rows[-1][1] == sum(i % 7 for i in range(200))
    spans = [r for r in rows if r[0] < r[1]]
    assert all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    w = streams.windows(spark.createDataFrame([(0, 5), (5, 5), (5, 12)], "start bigint, stop bigint"), 4)
    assert sorted(map(tuple, w.collect())) == [(0, 1, 4), (1, 2, 4), (2, 1, 4)]


def test_chunk_shuffle_keeps_all(spark):
    c = streams.shuffle_chunks(spark.createDataFrame([(20,)], "n bigint"), 8, 3).collect()
    assert sorted((r.first, r.length) for r in c) == [(0, 8), (8, 8), (16, 4)]
    assert sorted(r.start for r in c)[0] == 0 and max(r.start + r.length for r in c) == 20


def test_global_rank(spark):
    t = spark.range(3000).withColumn("h", F.sha2(F.col("id").cast("string"), 256))
    got = ranking.global_row_number(t, "h", "id").orderBy("h").select("rn").collect()
    assert [r.rn for r in got] == list(range(1, 3001))


def test_curriculum(spark):
    n = spark.createDataFrame([(f"n{i}",) for i in range(6)], "n string")
    d = curriculum.decoys(n, "n", 4, 17).collect()
    by = {}
    for r in d:
        by.setdefault(r.target, set()).add(r.decoy)
    assert len(by) == 6 and all(len(v) == 4 and k not in v for k, v in by.items())
    assert curriculum.decoys(n.limit(1), "n", 4, 17).count() == 0
    r = curriculum.replicate(spark.createDataFrame([(1, 3), (2, 0)], "a int, k int"), F.col("k"))
    assert sorted((x.a, x.copy) for x in r.collect()) == [(1, 0), (1, 1), (1, 2), (2, 0)]
    a, b = docs(spark, "x", "y", None), docs(spark, "y", "z", None)
    assert [r.text for r in curriculum.overlap(a, b, "text").collect()] == ["y"]
    assert sorted(str(r.text) for r in curriculum.disjoint(a, b, "text").collect()) == ["None", "x"]
