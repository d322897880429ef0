"""Defective prompt and answer pairs: empty, copied, refused, cut off, or in another language."""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.refusals import is_refusal
from sparkloom.session import cut_lineage

#: Answers that stand for nothing, in lower case and without outer punctuation.
PLACEHOLDERS = frozenset(
    ["", "todo", "tbd", "n/a", "na", "none", "null", "nil", "empty", "fixme", "xxx", "answer", "response", "placeholder", "no answer", "no response", "nan", "undefined", "tba", "wip", "leer", "vide", "vacío", "keine antwort", "sans réponse", "sin respuesta"]
)
_OUTER = re.compile(r"^[\W_]+|[\W_]+$")
#: Everyday words that tell the language of a sentence.
FUNCTION_WORDS = {
    "en": "the of and to in is that it for with as was this are be on not by which from or an have has will would so when there nothing else only what should how why does can you please i my we your after before",
    "de": "der die das und ist so sind fehlt welcher welches halte nicht ein eine den dem des mit auf für von zu im wird werden sind dass sich auch nur noch wenn dann was wie warum bitte ich wir muss muß kann nach vor aber oder sobald damit denn welche einmal jetzt",
    "fr": "le la les des et est une un du dans que quel quelle quels quelles te tu s'il c'est j'ai n'est qu'il d'un d'une l'on pas pour sur avec ce cette il elle ne qui au aux sont par plus quand pourquoi comment je nous vous doit être avant après mais ou afin car désormais rien autre fois",
    "it": "il lo gli di che è per uno non sono della dei delle nel nella alla anche più ma quando perché come questo questa ogni dopo già viene sulla dal",
    "pt": "o os um uma do da dos das em nas é com não mais foi são ao aos também já quando porque depois só deve você isso pelo pela",
    "nl": "het een van niet op zijn voor met er aan om ook als bij nog dan wordt worden naar maar deze dit hoe wat waarom wanneer eerst alleen moet",
    "pl": "w na z że się nie jest jak dla przez ale oraz jego jej gdy kiedy dlaczego tylko przed każdy być może są",
    "es": "el la los las y es una un del en que no por con para se su lo como más cuando qué cómo quiere tras sin cual cuál nosotros usted debe antes después pero o porque esta este ya queda nada falla hace falta una sola vez",
}
#: Letters that tell a language, and short forms French puts before an apostrophe.
_LETTERS = {"de": "äöüß", "fr": "èêçàùœûîô", "es": "ñáíóú¿¡"}
#: Last code points of the blocks of writing systems, and their names.
_SCRIPT_ENDS = [0x36F, 0x3FF, 0x52F, 0x58F, 0x5FF, 0x7FF, 0x8FF, 0x97F, 0xDFF, 0xE7F, 0x10FF, 0x11FF, 0x303F, 0x30FF, 0x318F, 0x9FFF, 0xABFF, 0xD7FF, 0x10FFFF]
_SCRIPTS = ["", "greek", "cyrillic", "armenian", "hebrew", "arabic", "arabic", "devanagari", "indic", "thai", "georgian", "hangul", "", "cjk", "hangul", "cjk", "", "hangul", ""]
_OTHER_SCRIPT = re.compile("[\u0370-\u1dff\u2c00-\U0010ffff]")
_LETTER_OF = {c: lang for lang, cs in _LETTERS.items() for c in cs}
_ELIDED = re.compile(r"\b(?:l|d|n|s|j|c|qu|m|t)['’]", re.I)
_WORDS_OF = {w: [] for ws in FUNCTION_WORDS.values() for w in ws.split()}
for _lang, _ws in FUNCTION_WORDS.items():
    for _w in set(_ws.split()):
        _WORDS_OF[_w].append(_lang)
#: What languages are called in one another.
_LANGUAGE = {
    "english": "en", "englisch": "en", "anglais": "en", "inglés": "en", "german": "de", "deutsch": "de", "allemand": "de", "alemán": "de",
    "french": "fr", "französisch": "fr", "français": "fr", "francés": "fr", "spanish": "es", "spanisch": "es", "espagnol": "es", "español": "es",
    "italian": "it", "italienisch": "it", "italien": "it", "italiano": "it", "portuguese": "pt", "portugiesisch": "pt", "portugais": "pt", "portugués": "pt", "dutch": "nl", "niederländisch": "nl", "néerlandais": "nl", "holandés": "nl", "polish": "pl", "polnisch": "pl", "polonais": "pl", "polaco": "pl",
    "russian": "cyrillic", "russisch": "cyrillic", "russe": "cyrillic", "ruso": "cyrillic", "chinese": "cjk", "chinesisch": "cjk", "chinois": "cjk", "chino": "cjk", "japanese": "cjk", "japanisch": "cjk", "japonais": "cjk", "japonés": "cjk", "arabic": "arabic", "arabisch": "arabic", "arabe": "arabic", "árabe": "arabic",
}
_ASKED = re.compile(
    r"(?:\b(?:answer|reply|respond|write|translate)\w*\b[^.!?\n]{0,30}\b(?:in|into|to)|\bantwort\w*\b[^.!?\n]{0,30}\b(?:auf|in)|\bauf|\b(?:répon\w+|écri\w+|tradui\w+)\b[^.!?\n]{0,30}\ben"
    rf"|\b(?:respond\w+|contest\w+|escrib\w+|traduc\w+)\b[^.!?\n]{{0,30}}\b(?:en|al))\s+({'|'.join(_LANGUAGE)})\b",
    re.I,
)
_FENCE = re.compile(r"```.*?(?:```|\Z)", re.S)
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_MASK = re.compile(r"\S*[_/\d]\S*")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
_STOP = ".!?…。！？\"'”’»)]}:;"
_CODE_LINE = re.compile(r"[=(){}\[\]<>]|^\s*(?:return|import|from|def|class|for|if|else|try|except|assert|with|[-+@#$]|pytest|python|git|pip|npm|make)\b")
#: Words that cannot close a sentence.
_DANGLING = re.compile(
    r"\b(?:the|an?|of|to|and|or|but|with|for|from|that|which|would|must|because|and then|der|die|das|den|dem|eine?|und|oder|von|zu|mit|für|weil|damit|dass|und dann|le|les|une?|des|du|de|et|ou|que|qui|pour|avec|et puis|parce que|el|la|los|las|del|una|y|o|con|para|porque|y luego)$",
    re.I,
)
_INVISIBLE = "\u200b\u200c\u200d\u2060\ufeff\u00ad"


def _clean(text: str) -> str:
    return text.translate(dict.fromkeys(map(ord, _INVISIBLE))).strip()


def is_placeholder(text: str) -> bool:
    return _OUTER.sub("", _clean(text)).lower() in PLACEHOLDERS


def prose(text: str) -> str:
    """text without code, patches, commands and names from code; of JSON its string values."""
    text = _FENCE.sub("\n", text)
    if text.lstrip().startswith("{"):
        try:
            values = json.loads(text).values()
            text = "\n".join(v for v in values if isinstance(v, str) and " " in v)
        except (ValueError, AttributeError):
            text = re.sub(r"\\u([0-9a-f]{4})", lambda m: chr(int(m.group(1), 16)), text)
    lines = [x for x in text.split("\n") if not _CODE_LINE.search(x) or len(_WORD.findall(x)) > 12]
    return _MASK.sub(" ", "\n".join(lines))


def script(text: str) -> str | None:
    """Writing system of most letters if it is not the Latin one."""
    if not _OTHER_SCRIPT.search(text):
        return None
    names = Counter(_SCRIPTS[bisect_left(_SCRIPT_ENDS, ord(c))] for c in text if c.isalpha())
    top = names.most_common(1)
    return top[0][0] if top and top[0][0] and top[0][1] * 2 > sum(names.values()) else None


def language(text: str) -> str | None:
    """Language of most function words, or the script if it is no Latin one; None where too few tell or two are close."""
    other = script(text)
    if other:
        return other
    votes = dict.fromkeys(FUNCTION_WORDS, 0.0)
    for w in _WORD.findall(text.lower()):
        langs = _WORDS_OF.get(w)
        if langs:
            for lang in langs:
                votes[lang] += 1 / len(langs)
        elif not w.isascii():
            for lang in {_LETTER_OF[c] for c in w if c in _LETTER_OF}:
                votes[lang] += 1
    votes["fr"] += len(_ELIDED.findall(text))
    votes["es"] += text.count("¿") + text.count("¡")
    second, first = sorted(votes.values())[-2:]
    if first < 2 or first < 1.5 * second:
        return None
    return max(votes, key=votes.get)


def prompt_languages(prompt: str) -> set[str]:
    """Languages an answer may be in: those asked for, else those of the prompt's sentences."""
    asked = {_LANGUAGE[m.group(1).lower()] for m in _ASKED.finditer(prompt)}
    if asked:
        return asked
    text = prose(prompt)
    whole = language(text)
    first = language(_SENTENCE.split(text.strip(), maxsplit=1)[0])
    return {x for x in (whole, first) if x}


def words_left_over(a: list[str], p: list[str], most: int) -> int | None:
    """Least number of words of a without which it stands in p in order, None above ``most``; time is linear in the words."""
    places: dict[str, list[int]] = {}
    for j, w in enumerate(p):
        places.setdefault(w, []).append(j)
    # ends[d]: the shortest beginning of p that holds the words of a so far, but for d of them
    never = len(p) + 1
    ends = [0] + [never] * most
    for w in a:
        at = places.get(w, [])
        for d in range(most, -1, -1):
            k = bisect_left(at, ends[d])
            end = at[k] + 1 if k < len(at) else never
            ends[d] = min(end, ends[d - 1]) if d else end
    return next((d for d, end in enumerate(ends) if end < never), None)


def copies(prompt: str, answer: str) -> bool:
    """Whether the answer is the prompt, or a stretch of it, up to form and a few words around it."""
    a, p = (re.findall(r"\w+", t.lower()) for t in (answer, prompt))
    if len(a) < 4 or len(a) > len(p) + 12:
        return False
    inside = set(p)
    if sum(w in inside for w in a) < 0.75 * len(a):
        return False
    extra = words_left_over(a, p, int(max(1, min(6, 0.2 * len(a)))))
    return extra is not None and len(a) - extra >= 0.4 * len(p)


def unbalanced(text: str) -> bool:
    """Whether code ends inside a bracket, a literal or a statement."""
    text = text.rstrip()
    if text.endswith((",", "=", "+", "-", "*", "/", "%", "(", "[", "{", "\\", ":", "_")) or re.search(r"\b(?:in|is|not|and|or|if|for|return|def|lambda|import|from|as|with)$", text):
        return True
    depth = Counter(re.sub(r"'[^'\n]*'|\"[^\"\n]*\"", "", text))
    return any(depth[a] > depth[b] for a, b in ("()", "[]", "{}"))


def ending(parts: list[str]) -> tuple[bool, str | None]:
    """(cut off for certain, open sentence that may be cut off)."""
    text = _clean(parts[-1]) or _clean(parts[0])
    if text.count("```") % 2:
        return True, None
    if text.startswith(("{", "[")) and not text.endswith("```"):
        try:
            json.loads(text)
            return False, None
        except ValueError:
            return not text.endswith(("}", "]", ".")), None
    if text.startswith("--- "):
        m = re.search(r"@@ -\d+(?:,(\d+))? \+\d+(?:,(\d+))? @@[^\n]*\n?", text)
        if not m:
            return True, None
        last = list(re.finditer(r"@@ -\d+(?:,(\d+))? \+\d+(?:,(\d+))? @@[^\n]*\n?", text))[-1]
        body = text[last.end() :].split("\n")
        old, new = sum(b[:1] in (" ", "-", "") for b in body), sum(b[:1] in (" ", "+", "") for b in body)
        return old < int(last.group(1) or 1) or new < int(last.group(2) or 1), None
    if text.endswith("```") or text[-1:] in ".!?…。！？":
        return False, None
    line = text.rsplit("\n", 1)[-1]
    tail = _SENTENCE.split(line)[-1]
    words = _WORD.findall(_MASK.sub(" ", tail).lower())
    if _CODE_LINE.search(line) and not (len(words) > 3 and any(w in _WORDS_OF for w in words)):
        return "\n" in text and unbalanced(text), tail
    return bool(len(words) > 1 and (re.search(r"[,:(\[{=/_-]$", text) or _DANGLING.search(text))), tail


def sentence_key(sentence: str) -> str:
    """Words in lower case, names and numbers masked, end punctuation off; prefixes of sentences give prefixes of keys."""
    return re.sub(r"[\s:,;()\"'`]+", " ", _MASK.sub(" # ", sentence).lower()).strip(" .!?-*>")


def analyse(messages, trace, final) -> tuple[str, str | None, list[str]] | None:
    """judge for one record; None where there is no pair."""
    at = max((i for i, m in enumerate(messages or ()) if m and m["role"] == "user"), default=-1)
    if at < 0:
        return None
    parts = [m["content"] for m in messages[at + 1 :] if m and m["role"] == "assistant"]
    parts += [t["content"] for t in trace or () if t and t["type"] in ("assistant", "patch")]
    return judge(messages[at]["content"] or "", [*parts, final])


def judge(prompt: str, parts: list[str | None]) -> tuple[str, str | None, list[str]]:
    """(defect or '', open sentence, answer parts that say something)."""
    parts = [p for p in parts if p and not is_placeholder(p)]
    if not parts:
        return "empty", None, parts
    answer = "\n".join(parts)
    if copies(prompt, answer):
        return "copies_question", None, parts
    if is_refusal(answer, prompt):
        return "refusal", None, parts
    spoken = prose(answer)
    cut, tail = ending(parts)
    if cut:
        return "truncated", None, parts
    own = language(spoken)
    allowed = prompt_languages(prompt) if own else None
    return ("other_language" if allowed and own not in allowed else ""), tail, parts


def prompts_and_parts(df: DataFrame, id_column: str, messages: str, trace: str, final: str) -> DataFrame:
    """(id, prompt, parts): the last user message and what follows it; JVM-side, so that only texts travel to Python."""
    m, t = F.col(messages), F.col(trace)
    last = F.array_max(F.transform(m, lambda x, i: F.when(x["role"] == "user", i + 1).otherwise(0)))
    pairs = df.filter(m.isNotNull() & (F.size(m) > 0)).withColumn("__last", last).filter("__last > 0")
    said = F.filter(F.slice(m, F.col("__last") + 1, F.size(m)), lambda x: x["role"] == "assistant")
    steps = F.filter(F.coalesce(t, F.array().cast(df.schema[trace].dataType)), lambda x: x["type"].isin("assistant", "patch"))
    parts = F.concat(F.transform(said, lambda x: x["content"]), F.transform(steps, lambda x: x["content"]), F.array(F.col(final)))
    return pairs.select(F.col(id_column).alias("id"), F.coalesce(F.get(m, F.col("__last") - 1)["content"], F.lit("")).alias("prompt"), parts.alias("parts"))


def _evidence(pairs: DataFrame) -> DataFrame:
    """Rows of three sorts: record verdicts (r), complete sentences (s), words (w); an open answer comes with its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["sort", "id", "key", "word", "defect", "total", "final", "answer"]
        for batch in batches:
            rows: list[tuple] = []
            sentences: Counter[tuple[str, bool]] = Counter()
            ids, prompts, parts_column = (batch.column(i).to_pylist() for i in range(3))
            for record, prompt, said in zip(ids, prompts, parts_column):
                defect, tail, parts = judge(prompt, said)
                if defect not in ("", "other_language"):
                    rows.append(("r", record, None, None, defect, None, None, None))
                    continue
                text = "\n".join(parts)
                for s in _SENTENCE.split(text):
                    closed = s[-1:] in _STOP
                    if s and (closed or s != tail):
                        sentences[s, closed] += 1
                if tail is None and not defect:
                    continue
                key = sentence_key(tail) if tail else None
                word = key.rsplit(" ", 1)[-1] if key else None
                rows.append(("r", record, key, word, defect or None, len(text), None, text if tail else None))
            keys: Counter[str] = Counter()
            words: Counter[str] = Counter()
            ends: Counter[str] = Counter()
            for (s, closed), n in sentences.items():
                key = sentence_key(s)
                if len(key) > 2:
                    keys[key] += n
                    ws = key.split(" ")
                    for w in ws:
                        words[w] += n
                    ends[ws[-1]] += closed * n
            rows += [("s", None, k, None, None, c, None, None) for k, c in keys.items()]
            rows += [("w", None, k, None, None, c, ends[k], None) for k, c in words.items()]
            columns = list(zip(*rows)) if rows else [[]] * 8
            types = [pa.string(), batch.schema.field(0).type, pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    kind = pairs.schema["id"].dataType.simpleString()
    return pairs.mapInArrow(run, f"sort string, id {kind}, key string, word string, defect string, total bigint, final bigint, answer string")


def shortened(known: DataFrame, asked: DataFrame) -> DataFrame:
    """(key) of asked keys that are a proper prefix of another key and are not known themselves.

    All keys are sorted across range partitions and each is compared with its
    neighbour: if any key begins with k, the one after k does. The neighbour
    of a partition's last key is the first key of the next partition that has one.
    """
    keys = known.select("key", F.lit(1).alias("known")).unionByName(asked.select("key", F.lit(0).alias("known")))
    keys = keys.filter("key IS NOT NULL").groupBy("key").agg(F.max("known").alias("known"))
    spread = cut_lineage(keys.repartitionByRange("key").sortWithinPartitions("key"))

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        first, held = None, None
        for batch in batches:
            out = []
            for key, is_known in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if first is None:
                    first = key
                elif not held[1] and key.startswith(held[0]):
                    out.append(held[0])
                held = (key, is_known)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), pa.array([None] * len(out), pa.int32()), pa.array([None] * len(out), pa.string())], ["key", "pid", "first"])
        if first is not None:
            last = None if held[1] else held[0]
            yield pa.RecordBatch.from_arrays([pa.array([last], pa.string()), pa.array([pid], pa.int32()), pa.array([first], pa.string())], ["key", "pid", "first"])

    found = spread.mapInArrow(neighbours, "key string, pid int, first string")
    inner = found.filter("pid IS NULL").select("key")
    edges = found.filter("pid IS NOT NULL")  # one row per partition
    edges = edges.select("key", F.lead("first").over(Window.orderBy("pid")).alias("next"))
    return inner.unionByName(edges.filter("key IS NOT NULL AND startswith(next, key)").select("key"))


def _response_key(text) -> F.Column:
    """A response in lower case, names and numbers masked; a beginning of a response gives a beginning of its key."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"\S*[_/\d]\S*", " # "), r"[\s:,;()\"'`]+", " "))


def cut_responses(pairs: DataFrame, opened: DataFrame) -> DataFrame:
    """(id) of the open answers (id, answer) that are a proper beginning of another response.

    The responses are sorted by text and compared with their neighbours. Only
    those that begin like an open one, up to OPENING characters, are sorted;
    no other can begin with one. That is told by a hash, before their texts
    are normalised or shuffled.
    """
    start = lambda text: F.xxhash64(F.substring(_response_key(F.substring(text, 1, 4 * OPENING)), 1, OPENING))
    mine = opened.select("id", _response_key("answer").alias("key"), start(F.col("answer")).alias("start")).filter(F.length("key") >= OPENING)
    starts = mine.select("start").distinct()
    if starts.limit(BROADCAST_STARTS + 1).count() <= BROADCAST_STARTS:
        starts = F.broadcast(starts)
    text = F.concat_ws("\n", "parts")
    near = pairs.select("id", text.alias("text")).withColumn("start", start(F.col("text"))).join(starts, "start", "left_semi")
    near = near.join(opened.select("id"), "id", "left_anti").select(_response_key("text").alias("key"))
    keys = shortened(near, mine.select("key"))
    return mine.join(keys, "key", "left_semi").select("id").distinct()


#: An open answer's length counts as a limit where it is met this often and this many times as often as near ones.
SPIKE_LEAST, SPIKE_TIMES, SPIKE_NEAR, SPIKE_CHARS = 20, 10, 8, 200
#: A word ends hardly any sentence where fewer than one in this many of its uses do.
RARE_END = 100
#: Characters two responses share at least for one to be a shortened version of the other; shorter ones are told by their sentences.
OPENING = 32
#: Hashes of such openings that may be sent to every task.
BROADCAST_STARTS = 500_000


def find_defects(
    df: DataFrame, *, id_column: str = "record_id", messages: str = "messages", trace: str = "trace", final: str = "final"
) -> DataFrame:
    """(id_column, defect) of each defective pair; a record delivered twice comes once.

    A record without messages or without a user message is no pair. Missing,
    blank and placeholder parts of an answer count as absent. An answer that
    ends openly is cut off where it is the beginning of another response, where
    its last sentence is the beginning of others and never a whole one, where it ends on a word that others carry on, or
    where open answers pile up at its length. Sentences and words are counted
    over all answers, added up per task before they are shuffled.
    """
    pairs = prompts_and_parts(df, id_column, messages, trace, final)
    rows = cut_lineage(_evidence(pairs))
    records = rows.filter("sort = 'r'").select("id", "key", "word", "defect", "total").distinct()
    open_ends = records.filter("key IS NOT NULL")
    sentences = rows.filter("sort = 's'").select("key").distinct()
    words = rows.filter("sort = 'w'").groupBy("key").agg(F.sum("total").alias("total"), F.sum("final").alias("final"))
    cut = shortened(sentences, open_ends.select("key")).select("key", F.lit(True).alias("cut"))
    part = shortened(words.filter("total > 1").select("key"), open_ends.select(F.col("word").alias("key"))).select(F.col("key").alias("word"), F.lit(True).alias("part"))
    never = words.filter(F.col("final") * RARE_END < F.col("total")).select(F.col("key").alias("word"), F.lit(True).alias("never"))
    whole = sentences.select("key", F.lit(True).alias("whole"))
    lengths = open_ends.filter(F.col("total") >= SPIKE_CHARS).groupBy("total").agg(F.count(F.lit(1)).alias("n"))
    near = lengths.select(F.explode(F.sequence(F.col("total") - SPIKE_NEAR, F.col("total") + SPIKE_NEAR)).alias("total"), F.col("n").alias("m"))
    spikes = lengths.join(near.groupBy("total").agg(F.sum("m").alias("m")), "total")
    spikes = spikes.filter((F.col("n") >= SPIKE_LEAST) & (F.col("n") * 2 * SPIKE_NEAR > SPIKE_TIMES * (F.col("m") - F.col("n")))).select("total", F.lit(True).alias("spike"))
    short = cut_responses(pairs, rows.filter("answer IS NOT NULL").select("id", "answer").distinct()).select("id", F.lit(True).alias("short"))
    judged = open_ends.join(short, "id", "left").join(cut, "key", "left").join(whole, "key", "left").join(part, "word", "left").join(never, "word", "left").join(spikes, "total", "left")
    broken = F.col("whole").isNull() & (F.coalesce("short", "cut", "part", "never", "spike", F.lit(False)))
    judged = judged.select("id", F.when(broken, F.lit("truncated")).otherwise(F.col("defect")).alias("defect"))
    out = records.filter("key IS NULL").select("id", "defect").unionByName(judged).filter("defect IS NOT NULL")
    return out.distinct().withColumnRenamed("id", id_column)
