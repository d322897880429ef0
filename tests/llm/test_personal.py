"""Personal mentions in hand-written sentences that neither the training texts nor the tables know."""

import itertools

import pytest

from sparkloom.llm import personal, personal_training, pii

NAMES = ["Priya Ramanathan", "Wei Zhang", "Kwame Mensah", "Kate Wilson", "Tomáš Dvořák", "Ngozi Eze", "Marie-Claire Fontaine", "J. Halvorsen", "Ana Lucía Restrepo", "Bill Thornton"]
PHONES = ["+44 113 496 0142", "(415) 555-0137", "030 2345678", "06 12 34 56 78", "+34 611 22 33 44", "212-555-0188", "+91 98765 43210", "0171 2345678"]
IDS = ["078-05-1120", "X4829301", "12 345 678 901", "47891236K", "AB123456C", "533380006", "1 85 05 78 006 084", "T22000129", "D123-4567-8901"]
STREETS = ["221B Baker Street", "14 Elm Road", "1600 Pennsylvania Avenue", "Hauptstraße 5", "Lindenallee 77", "12 rue Victor Hugo", "8, avenue de la Gare", "Calle Mayor 21", "Via Garibaldi 9", "350 W. Fulton Ave", "Am Stadtgraben 3"]
MAILS = ["k.wilson@brightmail.org", "priya88@post.example.in", "wei (at) zhang-lab.cn", "marie_fontaine＠orange.fr", "bill.thornton [at] acme [dot] com", "ana-lucia_at_correo.es"]
CARRIERS = {
    "name": [
        "Let's meet {} at the station tomorrow.", "The patch was merged after {} had a look.", "I spoke with {} yesterday about the outage.", "{} owns the billing pipeline, so ping them first.", "Could you loop in {}?", "Am Freitag hat {} den Server neu gestartet.",
        "Hier, {} a corrigé le bogue du parseur.", "Ayer {} me mandó los registros.", "Assigned to: {}", "My neighbour {} keeps asking for it.", "/* maintained by {} since 2019 */", "Yours faithfully\n{}", "The ticket belongs to {}, not to us.", "invoice for {} is overdue",
    ],
    "phone": ["Just give me a ring on {} after lunch.", "Support hotline {} is open all day.", "In Notfällen bitte {} anrufen.", "Mon portable : {}", "Si hay dudas, mi móvil es {}.", "mobile={}", "T: {} | F: none", "whatsapp {} works best", "She texted from {} last night."],
    "id_number": [
        "My passport number is {} and it expires soon.", "Applicant's social security number: {}", "Meine Steuer-ID lautet {}.", "Numéro de passeport : {}", "Mi DNI es {}, por si hace falta.", "driver's licence {} was photographed", "national_id: {}", "He typed his tax id {} into the chat.", "Ausweisnummer {} wurde geprüft.",
    ],
    "address": [
        "Please post the keys to {} by Monday.", "We moved to {} last spring.", "Sie wohnt jetzt in der {}.", "Il habite {} depuis deux ans.", "La oficina está en {}.", "Deliver the sofa to {}, second floor.", "home_address: {}", "Our shop at {} stays closed.", "The accident happened outside {}.",
    ],
    "email": ["Drop me a line: {}", "Bitte an {} schicken.", "Envoyez tout à {} avant midi.", "Mándalo a {} cuando puedas.", "account {} was locked", "(see {} for details)", "To: {}"],
}
VALUES = {"name": NAMES, "phone": PHONES, "id_number": IDS, "address": STREETS, "email": MAILS}
#: Ordinary sentences that mention nobody.
CLEAN = [
    "Visual Studio opens the file in New York time.", "Build 20260113.48213377 took 415 555 ms.", "The box 10.4.26.18:8080 answers slowly.", "git clone git@forge.example:tools/packer.git", "pip install shardkit@2.4.1853 fails here.", "Pull Request 4417 closes Issue 3391.", "Range 125-8841 of shard 17 is empty.", "See Table 12 and Figure 4 in Chapter 3.",
    "class QueueError(ValueError): pass", "The Data Loader and the Unit Tests both pass.", "Golden Harbor is the code name of the next release.", "ISBN 978-3-16-148410-0 is on the shelf.", "Die Tabelle und die Maske fehlen noch.", "sha 9f2c71d0 differs from 41ab77e2", "Getting Started: run make twice.", "@dataclass(frozen=True) is missing on the class.", "timestamp 1718293847 size 4194304 bytes", "June 12 and Python 3 are fine.",
    "Apache License, Version 2.0", "Monday Morning Report", "commit 8841932 fixes it", "We saw 555 1234 rows.", "The San Francisco office is closed.", "order no. 48291734 shipped",
]


def found(texts):
    return [[(k, t[s:e]) for k, s, e in spans] for t, spans in zip(texts, personal.select(texts, personal.trained_models(), personal.lexicon()))]


@pytest.mark.parametrize("kind", personal.KINDS)
def test_recall_on_unseen_wording(kind):
    """At least 0.9 of the mentions of every kind, in carriers and with values written by hand."""
    pairs = list(itertools.product(CARRIERS[kind], VALUES[kind]))
    texts = [c.format(v) for c, v in pairs]
    hits = [any(k == kind and (x in v or v in x) for k, x in f) for f, (_, v) in zip(found(texts), pairs)]
    assert len(hits) >= 40
    assert sum(hits) / len(hits) >= 0.9, [t for t, h in zip(texts, hits) if not h]


def test_clean_sentences_stay():
    wrong = [(t, f) for t, f in zip(CLEAN, found(CLEAN)) if f]
    assert len(wrong) <= 2, wrong


def test_unseen_families():
    """Trees and thresholds from some families of texts find the mentions of two others."""
    from sparkloom.llm.boosting import BoostedTrees

    lex, kept = personal.lexicon(), personal_training.CALIBRATION[2:]
    made = list(personal_training.labelled_texts(10_000, seed=5))
    models = {}
    for kind, (x, y, family) in personal.training_rows([t for t in made if t[2] not in kept], lex).items():
        tune = (family == personal_training.CALIBRATION[0]) | (family == personal_training.CALIBRATION[1])
        models[kind] = BoostedTrees().fit(x[~tune], y[~tune]).calibrate(x[tune], y[tune])
    texts = [t for t in made if t[2] in kept]
    got = personal.select([t for t, _, _ in texts], models, lex)
    for kind in personal.KINDS:
        hits = [any(k == kind and s < b and a < e for k, s, e in f) for (_, truth, _), f in zip(texts, got) for what, a, b in truth if what == kind]
        assert sum(hits) / len(hits) >= 0.85, (kind, sum(hits), len(hits))


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("mail jana.brixer@mail.example today", [("email", "jana.brixer@mail.example")]),
        ("write to otto12 [at] lab [dot] fenwil [dot] example", [("email", "otto12 [at] lab [dot] fenwil [dot] example")]),
        ("call +44 20 7946 0199, thanks", [("phone", "+44 20 7946 0199")]),
        ("passport no. ZZ9047031 was in the log", [("id_number", "ZZ9047031")]),
        ("author: Elena Morvassen <x>", [("name", "Elena Morvassen")]),
        ("", []),
    ],
)
def test_mentions(text, want):
    assert found([text]) == [want]


def test_nulls_empty_long_and_repeated(spark):
    long = "plain words go on " * 40_000 + "mail jana.brixer@mail.example"
    rows = [(1, [("user", "mail jana.brixer@mail.example."), ("user", None), ("assistant", "")], "ring +44 20 7946 0199"), (2, None, None), (None, [("user", "call +44 20 7946 0199")], ""), (3, [], long), (3, [], long)]
    df = spark.createDataFrame(rows, "record_id bigint, messages array<struct<role:string,content:string>>, repo_context string")
    p = pii.parts(df, "record_id", "messages", ["repo_context"])
    got = sorted(((r.record_id or 0), r.field_name, r.part_index, r.redacted[-7:]) for r in pii.find_mentions(p, ["record_id", "field_name", "part_index"], with_text=True).collect())
    assert got == [(0, "messages", 0, "[PHONE]"), (1, "messages", 0, "EMAIL]."), (1, "repo_context", 0, "[PHONE]"), (3, "repo_context", 0, "[EMAIL]"), (3, "repo_context", 0, "[EMAIL]")]
    assert pii.find_mentions(p.limit(0), ["record_id", "field_name", "part_index"]).count() == 0
