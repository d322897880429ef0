import random

import numpy as np
import pytest

from sparkloom.llm import chaining, kmers, leaks, pairs, shared_spans

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def words(r, n):
    return " ".join(r.choice(WORDS) + str(r.randint(0, 99)) for _ in range(n))


# shared spans


def test_winnowing_guarantee():
    r = random.Random(3)
    shared = "".join(r.choice("abcdef") for _ in range(60))
    for _ in range(20):
        texts = ["".join(r.choice("abcdef") for _ in range(r.randint(0, 90))) + shared + "".join(r.choice("abcdef") for _ in range(r.randint(0, 90))) for _ in range(2)]
        data = np.frombuffer("".join(texts).encode(), np.uint8)
        edges = np.array([0, len(texts[0]), len(data)])
        at, h = kmers.winnow(data, edges[:-1], edges[1:], 30, 31)
        first = at < edges[1]
        assert set(h[first].tolist()) & set(h[~first].tolist())


def test_chain_order_and_gaps():
    a, b = np.array([0, 10, 20, 30, 15]), np.array([100, 110, 120, 130, 5])
    best = chaining.chains(a, b, 8)
    assert best[0][1] == [0, 1, 2, 3] and best[1][1] == [4]
    brute = 8 * 4 - 0.2 * 2 * 2 * 3
    assert abs(best[0][0] - brute) < 1e-9


def brute_pairs(docs, span):
    out = set()
    for i, (a, x) in enumerate(docs):
        for b, y in docs[i + 1 :]:
            if x and y and any(x[p : p + span] in y for p in range(len(x) - span + 1)):
                out.add((min(a, b), max(a, b)))
    return out


def test_pairs_equal_brute_force(spark):
    r = random.Random(5)
    base = words(r, 400)
    docs = [(i, words(r, 60)) for i in range(30)]
    docs += [(100 + i, words(r, 20) + base[i * 50 : i * 50 + 400 + i * 3 - 8] + "é漢" + words(r, 20)) for i in range(8)]
    docs += [(200, docs[0][1]), (201, docs[0][1]), (300, None), (301, ""), (302, "short"), (303, "漢" * 500), (304, "漢" * 420 + "x")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    t = shared_spans.with_digest(df, "doc_id", "text", 400)
    got = {tuple(x) for x in shared_spans.document_pairs(t, 400).collect()}
    assert got == brute_pairs(docs, 400)
    amounts = {x.doc_id: x for x in shared_spans.shared_amounts(t, 400).collect()}
    assert set(amounts) == {d for p in got for d in p}
    assert amounts[200].shared_chars == len(docs[0][1]) and amounts[200].n_copies == 3 and amounts[200].class_id == 0
    assert all(400 <= a.shared_chars <= a.n_chars for a in amounts.values())


def test_hot_groups_stay_linear(spark, monkeypatch):
    monkeypatch.setattr(shared_spans, "FULL_PAIRS", 4)
    r = random.Random(6)
    block, copy = words(r, 80), words(r, 80)
    docs = [(i, words(r, 10) + block + words(r, 10)) for i in range(9)] + [(50 + i, copy) for i in range(9)]
    t = shared_spans.with_digest(spark.createDataFrame(docs, "doc_id bigint, text string"), "doc_id", "text", 400)
    got = {tuple(x) for x in shared_spans.document_pairs(t, 400).collect()}
    # different texts give all their pairs, exact copies the representative with every member
    assert got == {p for p in brute_pairs(docs, 400) if p[0] < 50} | {(50, 50 + i) for i in range(1, 9)}


@pytest.mark.parametrize("limits", [(64, 256), (4, 3)])
def test_boilerplate_links_all_its_texts(spark, monkeypatch, limits):
    """One passage in many different texts gives every pair of them, and every text as many links."""
    monkeypatch.setattr(shared_spans, "FULL_PAIRS", limits[0])
    monkeypatch.setattr(shared_spans, "BLOCK", limits[1], raising=False)
    r = random.Random(9)
    n = limits[0] + 6
    block, other = words(r, 60), words(r, 60)
    docs = [(i, words(r, 10) + block + words(r, 10) + (other + words(r, 3) if i % 2 else "")) for i in range(n)] + [(1000 + i, words(r, 80)) for i in range(3)]
    docs += [(2000 + i, docs[1][1]) for i in range(limits[0] + 1)]  # a large class of copies, linked to all
    t = shared_spans.with_digest(spark.createDataFrame(docs, "doc_id bigint, text string"), "doc_id", "text", 400)
    got = {tuple(x) for x in shared_spans.document_pairs(t, 400).collect()}
    copies = {1, *range(2000, 2000 + limits[0] + 1)}
    among = lambda pairs: {p for p in pairs if not copies.issuperset(p)}
    assert among(got) == among(brute_pairs(docs, 400)) and len(among(got)) > n * n / 2
    amounts = {x.doc_id: x for x in shared_spans.shared_amounts(t, 400).collect()}
    assert all(amounts[i].n_links == n - 1 for i in range(n)) and set(amounts) == set(range(n)) | copies
    holders = {}
    for i, x in docs:
        for w in {x[p : p + 400] for p in range(len(x) - 399)}:
            holders.setdefault(w, set()).add(i)
    for i, x in docs[2:n]:
        covered = {q for p in range(len(x) - 399) if len(holders[x[p : p + 400]]) > 1 for q in range(p, p + 400)}
        assert amounts[i].shared_chars == len(covered)


def verbatim(x, y, span):
    """Code points of x in windows of span that y has, by brute force."""
    return {q for p in range(len(x) - span + 1) if x[p : p + span] in y for q in range(p, p + span)}


def test_chains_decide_the_spans(monkeypatch):
    r = random.Random(21)
    for n in range(30):
        shared = ["".join(r.choice("abcdefgh ") for _ in range(r.choice([99, 100, 101, 150, 400]))) for _ in range(3)]
        if n % 3 == 0:
            shared[1] = "ab" * 150  # repeats within itself
        noise = lambda: "".join(r.choice("abcdefgh ") for _ in range(r.randint(0, 300)))
        x, y = noise() + shared[0] + noise() + shared[1] + noise(), noise() + shared[1] + noise() + shared[0][:-1] + noise() + shared[2]
        got = shared_spans.compare(x, y, 100)
        for side, (a, b) in (("spans_a", (x, y)), ("spans_b", (y, x))):
            assert {q for s, e in got[side] for q in range(s, e)} == verbatim(a, b, 100)
    monkeypatch.setattr(chaining, "chains", lambda *_, **__: [])
    assert shared_spans.compare("x" + words(r, 90), words(r, 90), 100)["spans_a"] == []
    x = words(r, 90)
    assert shared_spans.compare(x, "y " + x, 100)["spans_a"] == []


def test_fuzzy_passages(spark):
    r = random.Random(22)
    base = words(r, 150)
    ws = base.split()
    ws[100], ws[120] = "changed", "altered"
    df = spark.createDataFrame([(1, words(r, 30) + " " + base + " " + words(r, 30)), (2, words(r, 20) + " " + " ".join(ws)), (3, words(r, 200))], "doc_id bigint, text string")
    t = shared_spans.with_digest(df, "doc_id", "text", 400)
    (got,) = shared_spans.passages(t, 400).collect()
    assert (got.doc_id_a, got.doc_id_b) == (1, 2) and got.last_a - got.first_a > 0.95 * len(base) and 0.95 < got.kept_ratio < 1
    assert shared_spans.aligned(*(np.frombuffer(s.encode("utf-32-le"), "<u4") for s in ("abcbdab", "bdcaba"))) == 4


@pytest.mark.parametrize("limits", [(4, 3, 1 << 22), (4, 256, 1500)])
def test_passages_of_all_pairs_of_a_hot_seed(spark, monkeypatch, limits):
    """A passage in more texts than one bucket pairs gives the passages of all pairs, edited ones as well, as with one bucket."""
    r = random.Random(31)
    block, other = words(r, 90), words(r, 70)
    docs = [(i, words(r, 10) + " " + block + " " + words(r, 10) + (" " + other if i % 3 == 0 else "")) for i in range(12)]
    cut = block[100:495]  # a seed in common, but no whole span
    docs += [(20 + i, words(r, 40) + " " + cut + " " + words(r, 40)) for i in range(3)] + [(30, words(r, 150)), (31, None), (40, docs[1][1]), (2, docs[2][1])]
    t = shared_spans.with_digest(spark.createDataFrame(docs, "doc_id bigint, text string"), "doc_id", "text", 400)
    want = {tuple(x) for x in shared_spans.passages(t, 400).collect()}
    for name, value in zip(("FULL_PAIRS", "PASSAGE_BLOCK", "BLOCK_CHARS"), limits):
        monkeypatch.setattr(shared_spans, name, value, raising=False)
    rows = [tuple(x) for x in shared_spans.passages(t, 400).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    found = {x[:2] for x in rows}
    assert found >= {(a, b) for a in range(12) for b in range(a + 1, 12)} and {(20, 21), (1, 22)} <= found and not any({30, 40} & set(p) for p in found)


def test_one_passage_in_many_documents_stays_linear(spark):
    """A passage of 8,000 characters in 400 texts: one class a seed inside, windows only at its ends."""
    r = random.Random(23)
    passage, n = words(r, 1000), 400
    docs = [(i, words(r, 8) + passage + words(r, 8)) for i in range(n)]
    t = shared_spans.with_digest(spark.createDataFrame(docs, "doc_id bigint, text string"), "doc_id", "text", 400)
    hot = shared_spans.seeds(t, 400).select("h", "doc_id")
    rows = shared_spans._window_groups(t, hot, 400).count()
    assert rows < 130 * n  # a hundred seeds a text; 8,000 windows a text otherwise
    assert shared_spans.document_pairs(t, 400).count() == n * (n - 1) // 2


def test_a_document_delivered_twice_shares_with_nobody(spark):
    r = random.Random(24)
    text = words(r, 90)
    t = shared_spans.with_digest(spark.createDataFrame([(1, text), (1, text), (2, words(r, 90)), (None, text)], "doc_id bigint, text string"), "doc_id", "text", 400)
    assert shared_spans.document_pairs(t, 400).count() == 0 and shared_spans.shared_amounts(t, 400).count() == 0


def test_spans_of_nothing(spark):
    t = shared_spans.with_digest(spark.createDataFrame([], "doc_id bigint, text string"), "doc_id", "text", 400)
    assert shared_spans.document_pairs(t, 400).count() == 0 and shared_spans.shared_amounts(t, 400).count() == 0


# leaks

ITEM = "Copy the value stored under config exactly, ignore the decoy under packer, and append the suffix 27 to the narrow keys before noon."


@pytest.mark.parametrize(
    ("text", "hit"),
    [
        (f"Some log.\n{ITEM}\nMore.", True),
        (ITEM.upper(), True),
        (ITEM.replace(" ", " ").replace("value", "val​ue"), True),
        ("<b>" + ITEM.replace("exactly", "<i>exactly</i>").replace("'", "&#39;") + "</b>", True),
        (ITEM.replace("config", "zebra").replace("suffix", "prefix"), True),  # two of 22 words
        ("intro " + ITEM[: len(ITEM) * 6 // 10] + " outro", True),
        (" ".join(ITEM.split()[:6]), False),  # a shared turn of phrase
        (ITEM.replace("config", "a1").replace("exactly", "a2").replace("decoy", "a3").replace("packer", "a4").replace("append", "a5").replace("suffix", "a6").replace("narrow", "a7"), False),  # a template sibling
        (" ".join(reversed(ITEM.split())), False),
        ("", False),
        (None, False),
    ],
)
def test_leak_cases(spark, text, hit):
    corpus = spark.createDataFrame([(7, text, "x")], "doc_id bigint, text string, item_id string")
    items = spark.createDataFrame([(1, ITEM), (2, None), (3, ""), (4, "tiny")], "item_id bigint, text string")
    got = [tuple(r) for r in leaks.find_leaks(corpus, items).collect()]
    assert got == ([(1, 7)] if hit else [])


NUMBERED = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}{'xyz'[i % 3] * 3}" for i in range(40)]


def changed(first, last, *at):
    """Words first to last of the long item, those at the places (from 1 in the passage) changed."""
    return " ".join("other" if i - first + 1 in at else NUMBERED[i] for i in range(first, last))


@pytest.mark.parametrize(
    ("size", "text", "hit"),
    [
        (34, changed(3, 22, 6, 13), True),  # 17 of 19 words, half of the item
        (40, changed(0, 11, 5) + " and then something else altogether " + changed(20, 31, 5), True),
        (30, changed(0, 15, 4), True),  # three words before the change
        (34, changed(3, 22, 4, 8, 12, 16), False),  # 15 of 19 words
        (40, changed(0, 11, 5) + " and then something else altogether ", False),
    ],
)
def test_changes_near_the_front(size, text, hit):
    index = leaks.ItemIndex([(1, " ".join(NUMBERED[:size]))])
    assert leaks.Scanner(index, 0.5).scan([leaks.normalise("intro words " + text + " closing words")]) == ([(0, 0)] if hit else [])


def test_changes_in_the_slots_of_a_template():
    make = "copy the value stored under {} exactly ignore the decoy under {} and append the suffix {} to the narrow keys".format
    items = [make("config", "packer", "twenty"), make("mask", "loader", "ninety")]
    slots = leaks.template_slots([i.split() for i in items])
    assert slots == [frozenset({5, 11, 16})] * 2
    index = leaks.ItemIndex(list(enumerate(items)), slots)
    scan = lambda text: leaks.Scanner(index, 0.5).scan([text])
    assert scan(make("gate", "stream", "seven")) == []  # a sibling
    assert (0, 0) in scan(items[0].replace("stored", "put").replace("ignore", "skip"))  # an edit


def test_leaks_in_blocks_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(leaks, "ITEMS_PER_BLOCK", 1)
    monkeypatch.setattr(leaks, "CHUNK", 64)
    other = "Name the stream that closes the gap between the manifest and the mask when nine shards arrive late on a Sunday."
    corpus = spark.createDataFrame([(1, "x y z " * 5000 + ITEM), (2, other), (2, other)], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, ITEM), (2, other)], "item_id bigint, text string")
    assert sorted(tuple(r) for r in leaks.find_leaks(corpus, items).collect()) == [(1, 1), (2, 2)]
    assert leaks.find_leaks(corpus, items.limit(0)).count() == 0


# prompt and answer pairs


def record(i, prompt, *answers, final=None):
    return (i, [("user", prompt)], [("assistant", a) for a in answers], final)


def test_defects(spark):
    full = "Change the guard in parse_rows so that a missing key returns early. Run the focused test first, then the whole suite."
    rows = [
        record(1, "Why does parse_rows fail on a missing key?", full),
        record(2, "Why does load_rows fail on a missing key?", "Change the guard in load_rows so that a missing key"),
        record(3, "Why does it fail?"),
        record(4, "Why does it fail?", "  ​", "TODO", final="..."),
        record(5, "Why does pad_rows fail on null rows?", "why does  pad_rows fail on null rows ?"),
        record(6, "Please fix it.", "I'm sorry, but I can't help with that. I hope you understand."),
        record(7, "How should the parser treat an empty list when the cache is local?", "Danach genügt ein kurzer Test für leere Listen. Die Ursache ist die Maske, denn sie wird nicht geprüft."),
        record(8, "How should the parser treat an empty list? (Please answer in German.)", "Danach genügt ein kurzer Test für leere Listen. Die Ursache ist die Maske, denn sie wird nicht geprüft."),
        record(9, "Write it.", "```python\ndef f(x):\n    return [x"),
        record(10, "Write it.", "Change the guard in f_x so that a missing key returns early"),  # only the full stop is missing
        record(11, "Fix it, please.", "I can't reproduce this with the log, but the cause is visible. " + full),
        (12, None, [("assistant", "x")], None),
        (13, [("assistant", "no user")], None, None),
        (14, [("user", None), ("assistant", None)], None, None),
        record(15, "Patch f so it works.", '{"cmd": "pytest", "why": "The mask mu'),
    ]
    rows.append(rows[1])
    df = spark.createDataFrame(rows, "record_id bigint, messages array<struct<role:string,content:string>>, trace array<struct<type:string,content:string>>, final string")
    got = {r.record_id: r.defect for r in pairs.find_defects(df).collect()}
    assert got == {2: "truncated", 3: "empty", 4: "empty", 5: "copies_question", 6: "refusal", 7: "other_language", 9: "truncated", 14: "empty", 15: "truncated"}
    assert pairs.find_defects(df.limit(0)).count() == 0


@pytest.mark.parametrize("size", [40, 1900, 2100, 9000])
def test_copies_at_any_length(size):
    r = random.Random(size)
    p = words(r, size).split()
    one = " ".join([*p[:3], "changed", *p[4:]])
    assert pairs.copies(" ".join(p), one) and pairs.copies(" ".join(p), "You asked: " + " ".join(p))
    assert pairs.copies(" ".join(p), " ".join(p[: size // 2] + p[size // 2 + 3 :]))
    assert not pairs.copies(" ".join(p), " ".join([*p, *words(r, 9).split()]))
    assert not pairs.copies(" ".join(p), " ".join(reversed(p)))


def test_neighbours_equal_brute_force(spark):
    r = random.Random(8)
    known = {"".join(r.choice("ab") for _ in range(r.randint(1, 9))) for _ in range(200)}
    asked = {"".join(r.choice("ab") for _ in range(r.randint(1, 9))) for _ in range(200)}
    want = {a for a in asked - known if any(o != a and o.startswith(a) for o in known | asked)}
    k, a = (spark.createDataFrame([(x,) for x in s], "key string").repartition(3) for s in (known, asked))
    assert {x.key for x in pairs.shortened(k, a).collect()} == want


def test_short_items_are_found_whole(spark):
    items = spark.createDataFrame([(1, "Anchors"), (2, "two words"), (3, "Name the late shard now"), (4, "nothing here"), (None, "two words"), (5, "  ")], "item_id bigint, text string")
    corpus = spark.createDataFrame([(1, "All ANCHORS hold."), (2, "anchorsmith, two\nwords!"), (3, "<b>Name</b> the late shard, now"), (4, None), (5, ""), (None, "anchors")], "doc_id bigint, text string")
    assert sorted(tuple(r) for r in leaks.find_leaks(corpus, items).collect()) == [(1, 1), (2, 2), (3, 3)]


def test_many_items_of_one_template_in_bounded_memory():
    """20,000 items that differ in one name: a text of the template is expanded part by part, and its item found."""
    import tracemalloc

    make = "copy the value stored under {} exactly ignore the decoy beside it and append the suffix to the narrow keys before noon".format
    items = [(i, make(f"name{i:05d}")) for i in range(20_000)]
    index = leaks.ItemIndex(items, [frozenset({5})] * len(items))
    scanner = leaks.Scanner(index, 0.5)
    texts = ["plain words of another kind " * 50] * 200 + [make("name00007")]
    tracemalloc.start()
    hits = scanner.scan(texts)
    assert tracemalloc.get_traced_memory()[1] < 1 << 30
    tracemalloc.stop()
    assert (200, 7) in hits and all(r == 200 for r, _ in hits)


def test_lemma_bound_is_met(monkeypatch):
    """No text that keeps half of an item in passages of seven words in eight has fewer q-grams in common than the bound."""
    r = random.Random(31)
    for _ in range(200):
        ws = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(r.randint(12, 60))]
        kept = list(range(len(ws)))[: int(len(ws) * 0.5) + 1]
        text = " ".join("changed" if n % 8 == 4 else ws[n] for n in kept)
        grams = lambda s: [s[x : x + leaks.Q] for x in range(len(s) - leaks.Q + 1)]
        have = set(grams(text))
        assert sum(g in have for g in grams(" ".join(ws))) >= leaks.shared_at_least(ws, 0.5)[0]
