"""Personal mentions in free text: overlapping candidates, boosted trees, calibrated thresholds, placeholders.

Candidates are told by form alone. What decides is the form of a candidate,
how its words are mostly written (``lexicon``), and everyday words that say
beside it what it is (phone, passport, lives at, dear, signed). No sentence of
any corpus is known here.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

from sparkloom.llm.boosting import BoostedTrees
from sparkloom.llm.lexicon import Lexicon

KINDS = ("email", "phone", "id_number", "address", "name")
#: Labelled texts the trees are fitted on; a bound of the training only, every row is searched.
TRAINING_TEXTS = 9_000
CONTEXT = 48

_UP = "A-ZÀ-ÖØ-ÞĀĂĄĆĈĊČĎĐĒĔĖĘĚĜĞĠĢĤĦĨĪĬĮİĴĶĹĻĽĿŁŃŅŇŊŌŎŐŒŔŖŘŚŜŞŠŢŤŦŨŪŬŮŰŲŴŶŸŹŻŽΑ-ΩА-ЯЁ"
_LOW = "a-zß-öø-ÿĀ-žά-ώа-яё"
_B = r"[  ]"
_PARTICLE = r"(?i:von der|von und zu|von|van der|van den|van|de la|de los|de las|dos|das|do|da|de|del|della|di|du|le|la|zu|zum|al|el|bin|ibn|ben|ter|ten|af|av|y|e|mac|st\.)"
_CAP = rf"(?:[{_UP}][{_LOW}{_UP}]*(?:['’][{_UP}{_LOW}][{_LOW}]+)?(?:-[{_UP}][{_LOW}{_UP}]+)*)"
_TOKEN = rf"(?:{_CAP}\.?)"
#: Words with a capital or initials in a row, joined by blanks, particles or a comma.
RUN = re.compile(rf"[{_UP}](?<![\w@/.\\-].)(?:[{_LOW}{_UP}]*(?:['’][{_UP}{_LOW}][{_LOW}]+)?(?:-[{_UP}][{_LOW}{_UP}]+)*\.?)(?:,?{_B}(?:{_PARTICLE}{_B})?{_TOKEN}|(?<=\.){_CAP}\.?)+(?![\w@])")
_RUN_PART = re.compile(rf"(,?{_B})?((?:{_PARTICLE}{_B})?)({_CAP}\.?)")
LOWER_PAIR = re.compile(rf"([a-zß-öø-ÿ]{{3,14}}){_B}((?:[a-z]\.?{_B}|{_PARTICLE}{_B})?[a-zß-öø-ÿ]{{3,}}(?:-[a-zß-öø-ÿ]{{3,}})?)(?![\w@(:=\[]|\.\w)")
#: Two words in lower case after one that says that somebody follows.
LOWER_CUE = re.compile(
    rf"(?<![^\W_])(?:[Nn]ame|owner|author|user|contact|reviewer|assignee|[Bb]y|am|cc|[Gg]ruß|[Gg]rüße|[Ss]aludos|[Rr]egards|[Tt]hanks|[Cc]heers|[Cc]ordialement|soy|bin|suis|from|von|par|por)[\"']?{_B}?[:=,;]?[ \u00a0\n]?[\"']?(?<![^\W_])(?=([a-zß-öø-ÿ]{{3,14}}){_B}([a-zß-öø-ÿ]{{3,}}(?:-[a-zß-öø-ÿ]{{3,}})?)(?![\w@(:=\[]|\.\w))"
)
_AT = r"\s?(?:@|＠|﹫|%40|&(?:#64|#x40|commat);)\s?|\s?[\[({<]\s?(?:at|AT|At|a|arroba|ät)\s?[\])}>]\s?|[_-](?:at|AT)[_-]"
_DOT = r"\.|．|%2[eE]|&(?:#46|#x2e|period);|\s?[\[({<]\s?(?:dot|DOT|Dot|punto|punkt|point)\s?[\])}>]\s?"
EMAIL = re.compile(rf"(?<![\w.+-])(?:mailto:)?([\w](?:[\w.+'’%&-](?!40))*?[\w+-]?)({_AT})([\w-]+?(?:(?:{_DOT})[\w-]+?)+)(?![\w])(?![-](?=\w))")
EMAIL_WORDS = re.compile(r"(?<![\w.+-])([\w][\w.+'-]*)(\s(?:at|AT|arroba)\s)([\w-]+(?:\s(?:dot|DOT|punto)\s[\w-]+)+)")
EMAIL_SIGNS = re.compile(r"[@＠﹫]|%40|&(?:#64|#x40|commat);|[\[({<]\s?(?:at|AT|At|a|arroba|ät)\s?[\])}>]|\s(?:dot|DOT|punto)\s|\w[_-](?:at|AT)[_-]\w")
_SEP = r"[   .()/‐-―-]"
DIGITS = re.compile(rf"[+(\d](?<![\w.#-].)(?:(?<=\d)|(?<!\d)\d)(?:{_SEP}{{0,3}}\d){{6,17}}(?:,?{_B}?(?:ext|x|Durchwahl|poste|Ext)\.?{_B}?\d{{1,5}})?(?![\w])")
CODE = re.compile(r"[A-Z\d](?<![\w.#/-].)(?:(?<=\d)|[A-Z]{0,5}[  -]?\d)[A-Z\d]*(?:[  ./-][A-Z\d]{1,8}(?![\w])){0,8}(?![\w])")
#: What streets are called in several languages.
STREET_WORDS = frozenset(
    """street st road rd lane ln avenue ave boulevard blvd drive dr terrace ter court ct place pl way square sq close crescent row walk parkway pkwy
    highway hwy circle cir grove hill gardens mews quay alley trail rise green parade esplanade rue allée allee chemin impasse quai cours route passage voie sentier villa
    faubourg calle avenida avda av plaza paseo camino carrera ronda vía via viale piazza corso largo vicolo travesía carretera glorieta rua travessa praça
    ulica ul straße strasse str weg platz gasse markt laan plein gracht""".split()
)
_SUFFIX = re.compile(r"(?:stra(?:ß|ss)e|str\.?|weg|allee|platz|gasse|ring|damm|ufer|steig|stieg|chaussee|markt|graben|straat|laan|plein|gracht|kade|gatan|vägen|vej|katu)$", re.I)
_STREET_ANY = "|".join(sorted((w for w in STREET_WORDS if len(w) > 1), key=len, reverse=True))
_WORD = rf"(?:[{_UP}][{_LOW}{_UP}'’]*\.?(?:-[{_UP}{_LOW}]+)*)"
_LINK = r"(?:de la|de los|de las|de l['’]|d['’]|du|des|de|del|della|dei|da|do|dos|der|den|dem|des|the|of|la|le)"
#: House number, then a street; street, then house number.
NUMBER_FIRST = re.compile(
    rf"\d(?<![\w.#:-].)\d{{0,4}}[A-Za-z]?(?:[/-]\d{{1,4}}[a-z]?)?(?:{_B}?(?:bis|ter|quater))?,?{_B}(?:[NSEW]{{1,2}}\.?{_B})?(?:(?:{_WORD}|\d{{1,3}}(?:st|nd|rd|th)|(?i:{_STREET_ANY})\.?|{_LINK}){_B}|d['’]|l['’]){{0,6}}(?:{_WORD}|(?i:{_STREET_ANY})\.?)(?![\w])"
)
LOWER_STREET = re.compile(rf"\d(?<![\w.#:-].)\d{{0,4}}[a-z]?,?{_B}(?:[a-z]{{3,}}{_B}){{1,3}}(?:street|road|lane|avenue|boulevard|drive|terrace|court|square|crescent)(?![\w])")
STREET_FIRST = re.compile(
    rf"(?:[{_UP}]|(?:calle|avenida|plaza|paseo|rua|via|ul)\.?{_B}[{_UP}\w])(?<![\w@/.\\-].)[{_LOW}{_UP}'’]*\.?/?(?:-[{_UP}{_LOW}]+)*(?:{_B}(?:{_LINK}{_B})?{_WORD}){{0,4}},?{_B}(?:(?:[Nn]r|[Nn]o|n|núm|№)\.?º?{_B}?)?\d{{1,4}}(?:{_B}?[a-zA-Z](?![\w]))?(?:[-/]\d{{1,3}}[a-z]?)?(?![\w.:=%]\w|\w)"
)
_STREET_PART = re.compile(rf"{_WORD}|{_LINK}|[\w'’]+\.?")
#: Everyday words, or their beginnings, that tell what a number, a place or a name beside them is.
PHONE_WORDS = ("phone", "tel", "call", "mobil", "handy", "dial", "appel", "joign", "ruf", "anruf", "llam", "cell", "fax", "desk", "hotline", "móvil", "reach", "ring", "whatsapp", "sms", "signal", "text me", "contact", "portable", "number", "nummer", "número", "numéro", "line", "celular")
ID_WORDS = (
    "ssn", "social", "passport", "passeport", "pasaporte", "pass", "reisepass", "steuer", "tax", "tin", "itin", "nir", "dni", "nie", "nif", "curp", "rfc", "cpf", "licen", "führerschein", "permis", "national", "identi", "ausweis", "nino", "ni no", "ni number",
    "insurance", "versicher", "sécu", "insee", "carnet", "cédula", "id card", "id no", "id number", "id nr", "id-n", "aadhaar", "pan ", "codice", "fiscal", "personal", "bsn", "pesel", "nric", "medicare", "nhs", "driver", "driving", "conducir", "personnummer", "sin ", "visa",
)
CODE_WORDS = (
    "step", "build", "version", "range", "took", "crate", "test", "checksum", "line", "size", "seed", "hash", "sha", "epoch", "port", "ratio", "loss", "job", "shard", "commit", "ticket", "order", "isbn", "rev", "==", "@@", "0x", "[", "lr", "token", "invoice", "sku", "part no",
    "tracking", "timestamp", "uuid", "offset", "bytes", "row", "issue", "pid", "error", "code", "serial", "count", "total", "version", "model", "lot", "batch", "run ", "http", "ip ", "host",
)
ADDRESS_WORDS = (
    "address", "adresse", "anschrift", "dirección", "direccion", "indirizzo", "domicil", "live", "lives", "living", "reside", "send", "ship", "deliver", "wohn", "zieh", "vivo", "vive", "habit", "demeur", "envoy", "envía", "enviar", "colis", "paket", "box to", "flat", "apartment", "apt", "street",
    "moved", "home", "house", "located", "office", "billing", "post", "mail to", "letter", "visit", "come to", "pick", "drop", "near",
)
PERSON_LEFT = frozenset(
    """by author from contact dear hi hello hey thanks thx regards sincerely cheers best gruß grüße viele liebe lieber hallo von an bei mit saludos atentamente hola querido querida gracias cordialement bonjour cher chère merci par avec pour
    owner name names user users reviewer reviewed reported assignee assigned cc bcc to with meet met told tell ask asked call called contactez appelez demandez owner maintainer manager colleague patient customer client employee mr mrs ms herr frau signed
    attn attention señor señora monsieur madame llama llame pregunta frag frage fragen kollege kollegin nombre nom heißt heiße am is soy suis bin je credit copyright written created approved""".split()
)
PLACE_LEFT = frozenset("in at near to of the into within across on über nach aus en à a dans chez using via through under over".split())
PERSON_RIGHT = frozenset(
    """said says wrote writes told asked asks called is was has had will can could would does did who and or from at joined left works worked thinks reported suggested fixed reviewed found noticed sent signed lives hat ist schrieb sagt sagte war und wohnt kann aus
    a est et écrit dit était de du habite peut dijo escribió y es fue ha del vive puede approved owns replied confirmed""".split()
)
TITLES = frozenset("mr mrs ms miss mme mlle herr frau sr sra srta dr prof don doña señor señora monsieur madame sir lady".split())
#: Words that open sentences or labels, colours and the like; seldom part of a person's name.
PLAIN = frozenset(
    """a add after also and any are as ask at avant before both but by call calle can change check commit das dans de dear def del der des die during each el elle en ein eine ensuite es et explain file find fix for from für hello hi how hola i if il
    in ist it its keep la las le les list lo los mein meine my name no not note now on once only or our para patch please por pourquoi que read return run saludos see send she show so step the then there this to two un una une von wann warum was we welche
    wenn what when where which while why with write you your gruß grüße thanks danke gracias bitte merci regards golden silver iron ruby red green blue black white north south east west new old upper lower great grand royal open""".split()
)
#: Words of organisations, products, places and things, and names of days and months.
THINGS = frozenset(
    """inc corp gmbh ltd llc company university institute school team project license licence manager engine studio cloud server service system systems software framework library foundation group labs lab bank hospital street road avenue lane square city
    county river lake mountain park airport station error exception warning type model data code test tests table tables report guide manual notes release version update request issue page index license agreement act conference press news times summit
    monday tuesday wednesday thursday friday saturday sunday january february march april june july august september october november december montag dienstag mittwoch donnerstag freitag lundi mardi mercredi jeudi vendredi lunes martes miércoles jueves viernes
    python java linux windows google microsoft amazon apple github docker spark apache america europe germany france spain london paris berlin madrid york states kingdom english francisco angeles kong aires africa zealand lanka rica britain union valley arabia vegas nations washington tokyo
    china india japan italy russia canada mexico brazil facebook oracle intel nvidia debian ubuntu fedora unix""".split()
)
#: Given names of several regions that are everyday words as well, or unknown to the vocabularies.
GIVEN = frozenset(
    """ada aisha amara amelie ana anna anne anton astrid ben bruno carlos carmen chiara chloe clara claudia cruz bill bob carol daisy dieter edith elif eva faith fatima felix drew frank franz gene grace greta guy hans hope ines ingrid iris ivan ivy jack jana jasmine jane jean joy juan karim
    katarina kwame lara lars leila leon lena lily linda luca luis magda marco maria mark marta max mehmet mike miles miguel mila mina nadia nia noemi nora olga oscar pablo paz petra pia pierre priya ravi ray rita pat penny rob rosa rose ruby ruth sandy scott sara sofia sven tessa thabo tim uwe vera
    victor wanda wei will yara yusuf zora""".split()
)
#: Everyday words in lower case that no lower-case name holds.
COMMON = frozenset(
    "the and for with was were has had not but all any can will one two from that this these those when then than into over under after before each every only once here there who what which where while been being does did done may might must should would could about also still just very more most less least same such other another their there your our its".split()
)
UNIT = re.compile(r"^\s?(?:ms|s\b|px|%|[kmgt]i?b\b|tokens|bytes|rows|steps|is empty|per|times|x\b|°)", re.I)
_GROUP = re.compile(r"\d+")
_LETTERS = re.compile(r"[A-Za-zÀ-ÿ]+")
_LAST_WORD = re.compile(r"([^\W\d_]+)[^\w\n]{0,3}$")
_FIRST_WORD = re.compile(r"[  ]([^\W\d_]+)")
_TOWN = re.compile(rf"^[\s,;|–-]{{1,4}}(?:(?:[A-Z]{{1,2}}-)?\d{{4,5}}{_B}[{_UP}]|[{_UP}][{_LOW}]+(?:{_B}[{_UP}][{_LOW}]+)?,?{_B}(?:[A-Z]{{2}}{_B})?\d{{4,5}}|[{_UP}]{{1,2}}\d)")
_TOWN_ONLY = re.compile(rf"^,{_B}?[{_UP}][{_LOW}]{{2,}}")
_DIGIT_AHEAD = re.compile(r",?\s\d")
_CAMEL = re.compile(r"[a-zß-ÿ][A-Z]")
_SCOTS = re.compile(r"^(?:Mc|Mac|O['’]|De|Di|La|Le)")


def _near(text: str, words: tuple[str, ...]) -> float:
    """How close to the end of text the last of words stands, 0 without one."""
    at = max(text.rfind(w) for w in words)
    return 0.0 if at < 0 else 1.0 / (1 + (len(text) - at) / 12)


def number_features(text: str, s: int, e: int, lex: Lexicon) -> list[float]:
    span = text[s:e].replace(" ", " ")
    line = max(text.rfind("\n", 0, s) + 1, s - CONTEXT)
    left, right = text[line:s].lower(), text[e : e + 20].lower()
    all_groups = [len(g) for g in _GROUP.findall(span)]
    groups = [*all_groups[:5], 0, 0, 0, 0, 0]
    digits = sum(all_groups)
    letters = [i for i, c in enumerate(span) if c.isalpha()]
    before = left[-1:] or " "
    phone, ident, code = _near(left, PHONE_WORDS), _near(left, ID_WORDS), _near(left, CODE_WORDS)
    return [
        digits, len(all_groups), groups[0], groups[1], groups[2], groups[3], groups[4], all_groups[-1] if all_groups else 0,
        float("+" in span[:6]), float(span.startswith("00")), float(span.lstrip("(+").startswith("0")), float("(" in span), float("/" in span), span.count(" "), span.count("-"), span.count("."),
        len(letters), float(bool(letters) and letters[0] == 0), float(bool(letters) and letters[-1] == len(span) - 1), float("ext" in span.lower() or " x" in span),
        phone, ident, code, float(phone > max(ident, code)), float(ident > max(phone, code)), float(bool(UNIT.match(right))),
        float(before in "\"'"), float(before in "=:"), float(before in "[{<"), float(before in ",;|\t"), float(right[:1] in "\"'"), float(right[:1] in "]}>"), float(right[:1] == ":"),
        float(bool(re.match(r"[\s(-]*(?:desk|call|text|phone|mobil|tel|cell|home|work|fax)", right))), float(digits >= 8 and span[:2] in ("19", "20") and groups[0] == 4 and groups[1] == 2), float(before.isalpha()),
        float(not left.strip()), float(not right.strip()), float("@" in text[max(0, s - 60) : e + 60]),
    ]


def email_features(text: str, s: int, e: int, lex: Lexicon) -> list[float]:
    m = EMAIL.match(text, s) or EMAIL_WORDS.match(text, s)
    local, sign, domain = (m.group(1), m.group(2), m.group(3)) if m else ("", "", "")
    left, right = text[max(0, s - 24) : s].lower(), text[e : e + 8]
    last = re.split(r"\W+", domain)[-1]
    low = local.lower()
    first = re.split(r"[._+\d-]", low, maxsplit=1)[0]
    everyday, capital = lex(first)
    return [
        len(local), float(low in ("git", "root", "ubuntu", "admin", "deploy", "noreply", "no-reply", "ec2-user", "hg", "svn", "bot", "info", "support", "hello", "user", "www", "ci", "build")),
        sum(c.isdigit() for c in local), float("." in local or "_" in local or "-" in local), float("+" in local), len(last), everyday, capital,
        float(last.isalpha()), float(any(c.isdigit() for c in last)), sum(c.isdigit() for c in domain), domain.count("."), float(last.lower() in ("internal", "local", "localdomain", "git", "py", "md", "json", "txt", "lan")),
        float(sign.strip() in ("@", "＠", "﹫", "%40") or sign.startswith("&")), float(sign[:1].isspace() and sign.strip() == "@"), float("(" in sign or "[" in sign or "{" in sign), float("dot" in domain.lower() or "punto" in domain.lower()),
        float(bool(re.match(r":\S", right)) and not right.startswith("://")), float(right.startswith("/")), float("//" in left[-10:]), float(any(w in left for w in ("clone", "ssh", "scp", "install", "remote", "rsync", "npm", "pip", "docker", "sftp", "push", "host"))),
        float(text.startswith("mailto:", s)), float(right[:1] == ">"), float(left[-1:] in "<\"';,= "), float(local.isupper()), float(sign.isspace() or sign.strip().lower() in ("at", "arroba")), float(bool(re.fullmatch(r"[\d.]+\w*", domain))),
        float(sign[:1] in "_-"), float(left[-1:] == "@" or left[-1:] == "/"), float(right[:1] == "@"),
    ]


def address_features(text: str, s: int, e: int, lex: Lexicon) -> list[float]:
    span = text[s:e].replace(" ", " ")
    left, right = text[max(0, s - CONTEXT) : s].lower(), text[e : e + 48]
    words = _LETTERS.findall(span)
    low = [w.lower() for w in words]
    scores = [lex(w) for w in low]
    first, number = span[:1].isdigit(), _GROUP.search(span)
    edge = (low[-1] if first else low[0]) if low else ""
    types = [i for i, w in enumerate(low) if w in STREET_WORDS]
    return [
        len(words), float(first), len(number.group()) if number else 0, float(bool(types)), float(bool(types) and len(words) == 1), float(edge in STREET_WORDS), float(any(_SUFFIX.search(w) and len(w) > 6 for w in low)),
        float(low[:1] == ["am"] or low[:2] in (["an", "der"], ["unter", "den"], ["auf", "dem"], ["zum"], ["im"])), _near(left, ADDRESS_WORDS), float(bool(_TOWN.match(right))), float(bool(_TOWN_ONLY.match(right))),
        float(bool(re.match(r",?\s(?:Apt|Suite|Flat|Unit|Floor|piso|étage|\d{1,2}\.?º)", right))), float(bool(re.match(r"\s[a-z]", right))), float(not right.strip() or right[:1] in "\n.;|\"'"), _near(left, CODE_WORDS),
        max((a for a, _ in scores), default=0.0), min((a for a, _ in scores), default=0.0), max((b for _, b in scores), default=0.0), float(low[0] in ("step", "table", "figure", "section", "chapter", "version", "line", "page", "part", "python", "run", "test", "case", "level", "phase", "build", "june", "may", "march") if low else 0),
        float(span.islower()), float(bool(re.search(r"[,|:]\s?$", left[-3:]))), float(edge in ("way", "row", "place", "close", "hill", "walk", "court", "green", "rise", "drive", "trail", "passage", "route", "via", "ring", "st", "dr")),
        sum(w[0].isupper() for w in words) / max(1, len(words)), float(bool(re.search(r"\b(?:st|nd|rd|th)\b", span))), float("\n" in text[max(0, s - 2) : s]), float(bool(re.search(r"\d", left[-4:]))),
    ]


def name_features(text: str, s: int, e: int, lex: Lexicon) -> list[float]:
    span = text[s:e].replace(" ", " ")
    comma = "," in span
    words = span.replace(",", " ").split()
    title = words[0].lower().rstrip(".") in TITLES and len(words) > 1
    rest = words[1:] if title else words
    given, family = (rest[-1] if len(rest) < 3 or len(rest[-1].rstrip(".")) > 1 else rest[-2], rest[0]) if comma else (rest[0], rest[-1])
    left, right = text[max(0, s - CONTEXT) : s], text[e : e + 24]
    first, tail = given.lower().split("-")[0].rstrip("."), family.lower().split("-")[0].rstrip(".")
    f_low, f_cap = lex(first)
    t_low, t_cap = lex(tail)
    m = _LAST_WORD.search(left)
    before, gap = (m.group(1).lower(), len(left) - m.end(1)) if m else ("", 9)
    after = _FIRST_WORD.match(right)
    after = after.group(1) if after else ""
    mark = left.rstrip("  \t")[-1:]
    line = left[left.rfind("\n") + 1 :]
    near = text[max(0, s - 60) : e + 60]
    return [
        f_low, f_cap, t_low, t_cap, float(first in GIVEN), float(tail in GIVEN), float(first in PLAIN), float(tail in PLAIN), float(first in THINGS), float(tail in THINGS or tail in STREET_WORDS), float(len(first) == 1), float(title), float(comma), len(rest), len(first), len(tail),
        float(span.isupper()), float(span.islower()), float(bool(_CAMEL.search(family)) and not _SCOTS.match(family) or bool(_CAMEL.search(given)) and not _SCOTS.match(given)), float("-" in span), float(any(len(w.rstrip(".")) == 1 for w in rest[1:])), float(any(w[0].islower() for w in rest)),
        float(before in PERSON_LEFT), float(before in PLACE_LEFT), float(before in ("the", "a", "an", "der", "die", "das", "le", "la", "el", "los", "les", "ein", "eine", "un", "une", "una", "this", "our", "each")), gap, float(mark in ".!?" or mark == ""), float(mark in ":<|\"'([,;=/*#-\t" and mark != ""), float(mark == ","),
        float(not line.strip(" \t-*#>–—")), float(after.lower() in PERSON_RIGHT), float(after[:1].isupper()), float(after[:1].islower()), float(right[:1] in "(.=[:_" and right[1:2].strip() != ""), float(right[:1] in "<;|,\"')\t" or right[:2] in (" <", " |", " ;")), float(not right.strip() or right[:1] == "\n"), float(right[:1] in ".!?"),
        float("@" in near), float(sum(c.isdigit() for c in near) >= 7), float(tail.endswith(("error", "exception", "warning", "type", "handler"))), float(tail in COMMON or first in COMMON), float(bool(m) and gap <= 2 and left[m.start(1) : m.start(1) + 1].isupper()), float(any(lex(w.lower())[0] > 0.4 for w in rest[1:-1])),
        float(left[-2:-1].isdigit()), float(bool(_DIGIT_AHEAD.match(right))), float(bool(_SUFFIX.search(tail) and len(tail) > 6)), max(f_low, t_low), max(f_cap, t_cap), float(not (f_low or f_cap)) + float(not (t_low or t_cap)),
    ]


FEATURES = {"email": email_features, "phone": number_features, "id_number": number_features, "address": address_features, "name": name_features}


@lru_cache(maxsize=1)
def lexicon() -> Lexicon:
    return Lexicon()


_AUTOMATA: dict[int, object] = {}


def _proper_words(lex: Lexicon):
    """Automaton of the words known with a capital only, in lower case, each with the blank that ends it."""
    if id(lex) not in _AUTOMATA:
        import ahocorasick

        words = ahocorasick.Automaton()
        for w in {*lex.proper(), *GIVEN}:
            words.add_word(w + " ", len(w))
            words.add_word(w + " ", len(w))
        words.make_automaton()
        _AUTOMATA[id(lex)] = words
    return _AUTOMATA[id(lex)]


def _runs(text: str) -> list[tuple[str, int, int]]:
    """Windows of two to four words of every run of capitalised words; a particle belongs to the word after it."""
    out = []
    for m in RUN.finditer(text):
        parts = []
        at = m.start()
        while at < m.end():
            p = _RUN_PART.match(text, at, m.end())
            if not p:
                break
            word_end = p.end()
            word = p.group(3)
            if word[-1] == "." and len(word) > 2 and word[:-1].lower() not in TITLES:
                word_end -= 1  # the full stop of a sentence
            parts.append((p.start(2) if p.group(2) else p.start(3), word_end, "," in (p.group(1) or ""), len(word.rstrip(".")) == 1, word[-1] == "." and word_end < p.end()))
            at = p.end()
        n = len(parts)
        for i in range(n - 1):
            commas = 0
            for j in range(i + 1, min(n, i + 4)):
                if parts[j - 1][4]:
                    break  # a sentence ends between
                commas += parts[j][2]
                if commas > 1 or (commas and j > i + 2):
                    break
                if parts[j][3] and not commas:
                    continue  # an initial alone ends only a name in reverse order
                if all(p[3] for p in parts[i : j + 1]):
                    continue
                out.append(("name", parts[i][0], parts[j][1]))
    return out


def _streets(text: str) -> list[tuple[str, int, int]]:
    out = []
    for m in NUMBER_FIRST.finditer(text):
        end, words, kind = m.end(), 0, False
        number = re.match(rf"\d+[A-Za-z]?(?:[/-]\d{{1,4}}[a-z]?)?(?:{_B}?(?:bis|ter|quater))?,?{_B}", text[m.start() : m.end()])
        start = m.start() + (number.end() if number else 0)
        for p in _STREET_PART.finditer(text, start, m.end()):
            low = p.group().lower().rstrip(".")
            words += p.group()[0].isupper()
            if low in STREET_WORDS or _SUFFIX.search(low):
                kind = True
                if p.start() > start:  # English order: the kind of street closes the name
                    out.append(("address", m.start(), p.end()))
                    break
            if words == 4:
                end = p.end()
                break
        else:
            p = None
        if kind and (p is None or words == 4):
            out.append(("address", m.start(), end))
        elif not kind and words and (_TOWN.match(text[end : end + 32]) or _near(text[max(0, m.start() - CONTEXT) : m.start()].lower(), ADDRESS_WORDS)):
            out.append(("address", m.start(), end))
    for m in LOWER_STREET.finditer(text):
        out.append(("address", m.start(), m.end()))
    for m in STREET_FIRST.finditer(text):
        low = [w.lower().rstrip("./") for w in _STREET_PART.findall(m.group())]
        if any(w in STREET_WORDS or w == "c" or _SUFFIX.search(w) for w in low) or low[0] in ("am", "an", "unter", "auf", "zum", "zur", "im") or _TOWN.match(text[m.end() : m.end() + 32]) or _near(text[max(0, m.start() - CONTEXT) : m.start()].lower(), ADDRESS_WORDS):
            # words before the one that names the street do not belong to it
            out.append(("address", m.start(), m.end()))
            for p in _STREET_PART.finditer(text, m.start() + 1, m.end()):
                if p.group()[:1].isupper() and (p.group().lower().rstrip("./") in STREET_WORDS or _SUFFIX.search(p.group().lower())):
                    out.append(("address", p.start(), m.end()))
    return out


def candidates(text: str, lex: Lexicon) -> list[tuple[str, int, int]]:
    """Overlapping spans of every kind; recall before precision."""
    out = []
    if EMAIL_SIGNS.search(text):
        for pattern in (EMAIL, EMAIL_WORDS):
            for m in pattern.finditer(text):
                out.append(("email", m.start(), m.end()))
    for m in DIGITS.finditer(text):
        out.append(("phone", m.start(), m.end()))
    for m in CODE.finditer(text):
        if sum(map(len, _GROUP.findall(m.group()))) >= 5:
            out.append(("id_number", m.start(), m.end()))
    out += _streets(text)
    out += _runs(text)
    for end, size in _proper_words(lex).iter(text):
        at = end - size
        if at == 0 or not (text[at - 1].isalnum() or text[at - 1] in "_@/.-"):
            m = LOWER_PAIR.match(text, at)
            if m:
                out.append(("name", m.start(), m.end()))
    for m in LOWER_CUE.finditer(text):
        if not lex(m.group(1))[0] and not lex(m.group(2))[0]:
            out.append(("name", m.start(1), m.end(2)))
    return out


def select(texts: list[str], models: dict[str, BoostedTrees], lex: Lexicon) -> list[list[tuple[str, int, int]]]:
    """Accepted, disjoint mentions of each text in order; of overlapping spans the surest, then the longest, stays."""
    found = [candidates(t, lex) for t in texts]
    accepted: list[list[tuple[float, int, str, int, int]]] = [[] for _ in texts]
    for kind in KINDS:
        at = [(i, s, e) for i, spans in enumerate(found) for k, s, e in spans if k == kind]
        if not at:
            continue
        f, model = FEATURES[kind], models[kind]
        p = model.predict(np.array([f(texts[i], s, e, lex) for i, s, e in at], np.float64))
        for (i, s, e), q in zip(at, p.tolist()):
            if q > model.threshold:
                accepted[i].append((round(q, 1), e - s, kind, s, e))
    out = []
    for spans in accepted:
        kept: list[tuple[str, int, int]] = []
        # mails first: a name or a number inside one is part of it
        for _, _, kind, s, e in sorted(spans, key=lambda x: (x[2] != "email", x[2] != "address", -x[0], -x[1], x[3])):
            if all(e <= a or s >= b for _, a, b in kept):
                kept.append((kind, s, e))
        out.append(sorted(kept, key=lambda x: x[1]))
    return out


def redact(text: str, mentions: list[tuple[str, int, int]]) -> str:
    """text with a typed placeholder for each mention, otherwise unchanged."""
    out, last = [], 0
    for kind, s, e in mentions:
        out += [text[last:s], f"[{kind.upper()}]"]
        last = e
    return "".join([*out, text[last:]])


def training_rows(texts, lex: Lexicon) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Features, labels and family of every candidate of labelled texts, per kind."""
    x: dict[str, list] = {k: [] for k in KINDS}
    y: dict[str, list] = {k: [] for k in KINDS}
    family: dict[str, list] = {k: [] for k in KINDS}
    for text, truth, made_by in texts:
        for kind, s, e in candidates(text, lex):
            hit = any(k == kind and min(e, b) - max(s, a) > 0.6 * max(e - s, b - a) for k, a, b in truth)
            x[kind].append(FEATURES[kind](text, s, e, lex))
            y[kind].append(float(hit))
            family[kind].append(made_by)
    return {k: (np.array(x[k], np.float64), np.array(y[k]), np.array(family[k])) for k in KINDS}


@lru_cache(maxsize=1)
def trained_models() -> dict[str, BoostedTrees]:
    """Trees per kind, fitted on TRAINING_TEXTS made texts.

    The thresholds are set on families of texts that trees fitted on the
    other families have not seen; then the trees are fitted on all.
    """
    from sparkloom.llm.personal_training import CALIBRATION, labelled_texts

    models = {}
    for kind, (x, y, family) in training_rows(labelled_texts(TRAINING_TEXTS), lexicon()).items():
        held = np.isin(family, CALIBRATION)
        threshold = BoostedTrees().fit(x[~held], y[~held]).calibrate(x[held], y[held]).threshold
        models[kind] = BoostedTrees().fit(x, y)
        models[kind].threshold = threshold
    return models
