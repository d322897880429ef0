"""Held-out passages inside a corpus: q-gram lemma filter over diagonal bands, banded alignment as proof."""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.batches import text_blocks

#: Width of a shared character q-gram.
Q = 8
#: Diagonals per band; bands overlap by half.
BAND = 64
#: Bytes looked up at a time.
CHUNK = 1 << 22
#: Items compared with the corpus at a time; more items make more passes, each with a bounded table.
ITEMS_PER_BLOCK = 20_000
#: Characters of such a block's items.
BLOCK_CHARS = 1 << 24
#: Items of a query set; a larger set is an error, never cut.
MOST_ITEMS = 1_000_000
#: Of eight words, seven must stay.
STAY, OF = 7, 8
#: Costs of a changed word, tried in turn: dear ones keep a passage tight, cheap ones join short runs before a change.
DEAR, COSTS = STAY - 1, ((STAY - 1) // 2, 1)
#: Words from which on a passage may change in the places where items from one template differ.
LONG_WORDS = 18
#: Share of that rate a passage may have, since its ends may cut a run of eight.
DENSITY = 0.98
#: A passage shorter than this is a turn of phrase.
LEAST_WORDS = 6
#: Hits of q-grams in items that are held at a time.
EXPANDED = 1 << 21
#: The ends of passages are found to within a changed word, so the share asked for may come out this much lower.
TOLERANCE = 0.95
#: Moves of the banded alignment within a passage: kept, one word changed, put in or left out, two of these.
STEPS = ((1, 1), (2, 2), (1, 2), (2, 1), (3, 3), (1, 3), (3, 1), (2, 3), (3, 2))

_TAG = re.compile(r"</?[A-Za-z][^<>\n]{0,200}>")
_ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})|\\x([0-9a-fA-F]{2})")
#: Characters without width, and combining marks left by decomposition.
_INVISIBLE = re.compile("[\u00ad\u034f\u061c\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufe00-\ufe0f\ufeff\u0300-\u036f]")
_HINTS = re.compile(r"[^\x00-\x7f]|[&%\\<]")
_NOT_WORD = re.compile(r"[\W_]+")
#: Letters of other scripts that look like Latin ones.
LOOKALIKES = str.maketrans(
    "авекмнорстухіјѕԁԛԝһӏαβεικνορτυχγ",
    "abekmhopctyxijsdqwhlaveikvoptuxy",
)
#: ASCII letters and digits in lower case, blanks for all else.
_ASCII_WORDS = bytes(ord(chr(b).lower()) if chr(b).isalnum() and b < 128 else 32 for b in range(256))
_MIXED = re.compile("\\S*(?:[a-z][\u0370-\u052f]|[\u0370-\u052f][a-z])\\S*")


def normalise(text: str) -> str:
    """Words in lower case with one blank between them, free of markup, punctuation and encoding accidents."""
    if _HINTS.search(text):
        if "\\" in text:
            text = _ESCAPE.sub(lambda m: chr(int(m.group(1) or m.group(2), 16)), text)
            text = text.replace("\\n", " ").replace("\\t", " ").replace("\\r", " ")
        if "%" in text:
            text = unquote(text, errors="replace")
        if "<" in text:
            text = _TAG.sub(" ", text)
        if "&" in text:
            text = html.unescape(text)
        if not text.isascii():
            if "Ã" in text or "â€" in text:  # UTF-8 once read as a one-byte code
                try:
                    text = text.encode("cp1252").decode("utf-8")
                except UnicodeError:
                    pass
            text = _INVISIBLE.sub("", unicodedata.normalize("NFKD", text)).lower()
            if not text.isascii():
                text = _MIXED.sub(lambda m: m.group().translate(LOOKALIKES), text)
    if text.isascii():
        return " ".join(text.encode().translate(_ASCII_WORDS).decode().split())
    return _NOT_WORD.sub(" ", text.lower()).strip()


def _grams(data: np.ndarray) -> np.ndarray:
    """Every q-gram of bytes as one 64-bit number."""
    v = data.astype(np.uint64)
    step = 1
    while step < Q:
        v = v[:-step] | (v[step:] << np.uint64(8 * step))
        step *= 2
    return v


def shared_at_least(words: list[str], share: float) -> tuple[int, int]:
    """The lemma's bounds for an item: q-grams it has in common with a text that holds it, in all and in one passage.

    Such a text spans share of the words by passages that each lose at most one
    word in eight, so it keeps K, seven in eight of these, in at most
    K // LEAST_WORDS + K // STAY + 1 runs. A run
    of c characters keeps c - Q + 1 q-grams, and no K words are shorter than the
    K shortest. A passage has at least LEAST_WORDS words in a row, or STAY of
    OF in two runs; longer ones keep more.
    """
    sizes = [len(w.encode()) for w in words]
    kept = max(1, int(len(words) * share * TOLERANCE * DENSITY * STAY / OF))
    runs = min(kept, kept // LEAST_WORDS + kept // STAY + 1)
    chars = sum(sorted(sizes)[:kept]) + kept - runs
    whole = min((sum(sizes[i : i + LEAST_WORDS]) + LEAST_WORDS - Q for i in range(max(1, len(words) - LEAST_WORDS + 1))), default=1)
    broken = min((sum(sorted(sizes[i : i + OF])[:STAY]) + STAY - 2 * Q for i in range(max(1, len(words) - OF + 1))), default=1)
    return max(1, chars - runs * (Q - 1)), max(1, min(whole, broken))


def unseen_words(words: list[str], needed: float) -> float:
    """The most weight of kept words that no q-gram of a shared run shows: those of runs shorter than Q, one for each lost word at most."""
    sizes = [len(w.encode()) + 1 for w in words]
    most = first = total = 0
    for last, size in enumerate(sizes):
        total += size
        while total - 1 >= Q:
            total -= sizes[first]
            first += 1
        most = max(most, last + 1 - first)
    return (needed / OF + 1) * most


class ItemIndex:
    """Q-grams of a block of items, behind a bitmap that most corpus q-grams fail; items too short for passages as whole phrases."""

    def __init__(self, items: list[tuple[int, str]], slots: list[frozenset[int]] | None = None, bits: int = 21, share: float = 0.5):
        self.ids, self.words, self.places, self.weights, self.slots, self.phrases, bounds, grams, owner, place = [], [], [], [], [], {}, [], [], [], []
        for n, (item_id, text) in enumerate(items):
            norm = normalise(text)
            if not norm:
                continue
            words = norm.split()
            data = np.frombuffer(norm.encode(), np.uint8)
            if len(words) < LEAST_WORDS or len(data) < Q:
                self.phrases.setdefault(f" {norm} ", []).append(item_id)
                continue
            g = _grams(data)
            owner.append(np.full(len(g), len(self.ids)))
            place.append(np.arange(len(g)))
            grams.append(g)
            self.ids.append(item_id)
            self.words.append(words)
            self.places.append([0, *accumulate(len(w.encode()) + 1 for w in words[:-1])])
            self.slots.append(slots[n] if slots else frozenset())
            bounds.append(shared_at_least(words, share))
            # a word as written may come apart into several, which share its weight
            pieces = [len(normalise(w).split()) for w in text.split()]
            weights = [1 / n for n in pieces for _ in range(n)]
            self.weights.append(weights if len(weights) == len(self.words[-1]) else [1.0] * len(self.words[-1]))
        self.least, self.least_passage = (np.array([b[i] for b in bounds], np.int64) for i in (0, 1))
        g = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        order = np.argsort(g, kind="stable")
        self.grams, first = np.unique(g[order], return_index=True)
        self.first = np.r_[first, len(g)]
        self.owner = (np.concatenate(owner) if grams else np.zeros(0, np.int64))[order]
        self.place = (np.concatenate(place) if grams else np.zeros(0, np.int64))[order]
        # the bytes of each item, and where its words stand and how long they are
        self.bytes = np.array([len(g) + Q - 1 for g in grams], np.int64)
        self.word_first = np.r_[0, np.cumsum([len(w) for w in self.words])].astype(np.int64)
        self.word_place = np.array([x for places in self.places for x in places], np.int64)
        self.word_size = np.array([len(w.encode()) for words in self.words for w in words], np.int64)
        self.weight = np.concatenate([np.zeros(0), *map(np.asarray, self.weights)])
        needed = [share * TOLERANCE * sum(w) for w in self.weights]
        self.least_seen = np.array([n * DENSITY * STAY / OF - unseen_words(w, n) for n, w in zip(needed, self.words)])
        self.shift = np.uint64(64 - bits)
        self.seen = np.zeros(1 << bits, bool)
        self.seen[self._slot(self.grams)] = True

    def _slot(self, g: np.ndarray) -> np.ndarray:
        return (g * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def lookup(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in g, number of the q-gram) of every shared q-gram."""
        at = np.flatnonzero(self.seen[self._slot(g)])
        k = np.searchsorted(self.grams, g[at])
        k[k == len(self.grams)] = 0
        ok = self.grams[k] == g[at]
        return at[ok], k[ok]

    def expand(self, at: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position, item, place in item) for every item that has the q-gram."""
        n = self.first[k + 1] - self.first[k]
        rows = np.repeat(self.first[k] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        return np.repeat(at, n), self.owner[rows], self.place[rows]


def template_slots(items: list[list[str]]) -> list[frozenset[int]]:
    """Per item the places whose two neighbours on either side stand around another word in some item."""
    around = lambda ws, p: (ws[p - 2], ws[p - 1], ws[p + 1], ws[p + 2])
    middle: dict[tuple, str | None] = {}  # None: several words
    for ws in items:
        for p in range(2, len(ws) - 2):
            if middle.setdefault(around(ws, p), ws[p]) != ws[p]:
                middle[around(ws, p)] = None
    return [frozenset(p for p in range(2, len(ws) - 2) if middle[around(ws, p)] is None) for ws in items]


def _chains(cells: list[int], wide: int, cost: int, least: int, slots: frozenset[int] = frozenset()) -> dict[int, tuple[int, int, int]]:
    """first cell -> (last cell, words kept, words lost) of the best chain from it that keeps ``least`` words and seven of eight. Changes in slots are dear."""
    step = wide + 1
    moves = [(di * wide + dj, max(di, dj) - 1, di) for di, dj in STEPS[1:]]
    best: dict[int, tuple[int, int, int, int]] = {}  # cell -> score, first cell, kept, lost
    out: dict[int, tuple[int, int, int, int]] = {}
    for c in cells:
        score, first, kept, lost = 1, c, 1, 0
        prev = best.get(c - step)
        if prev is not None:
            score, first, kept, lost = prev[0] + 1, prev[1], prev[2] + 1, prev[3]
        else:
            for move, gone, di in moves:
                prev = best.get(c - move)
                if prev is not None:
                    i = c // wide - 4
                    price = gone * (DEAR if slots and any(x in slots for x in range(i - di + 1, i)) else cost)
                    if prev[0] + 1 - price > score:
                        score, first, kept, lost = prev[0] + 1 - price, prev[1], prev[2] + 1, prev[3] + gone
        best[c] = (score, first, kept, lost)
        if kept >= least and kept * OF >= (kept + lost) * STAY * DENSITY and (first not in out or (score, kept) > out[first][:2]):
            out[first] = (score, kept, c, lost)
    return {f: (c, kept, lost) for f, (_, kept, c, lost) in out.items()}


def banded_passages(
    item: list[str], doc: list[str], enough: float = float("inf"), weights: list[float] | None = None, slots: frozenset[int] = frozenset(), regions: list[tuple[int, int, int, int]] | None = None,
    item_at: list[int] | None = None, doc_at: list[int] | None = None,
) -> float:
    """Words of the item (or their weights) that stand in the document within passages, in the item's order.

    Alignment over words, within the band of STEPS around a passage's diagonal;
    farther on another passage begins. A kept word scores one; a changed,
    left-out or inserted word costs, so a passage pays only while most words
    stay. It counts with the words it spans if it keeps LEAST_WORDS and, but
    for its ends, seven of eight words. In the ``slots``, where other items have
    other words, a change is no sign of an edit but of a text from the same
    template, so there only long passages may change. Stops early at ``enough`` words.
    With ``regions`` (first and last place in the document, least and greatest
    diagonal), and the places of the words, only words inside a region and its
    band of diagonals are aligned.
    """
    wanted = set(item)
    # a cell (i, j) is the number i * wide + j; the margin keeps neighbours of the first and last words apart
    wide = len(doc) + 8
    found: set[int] = set()
    for first, last, low, high in regions or [(0, 0, 0, 0)]:
        j0, j1 = (max(0, bisect_left(doc_at, first - BAND) - 1), bisect_left(doc_at, last + BAND)) if regions else (0, len(doc))
        where: dict[str, list[int]] = {}
        for j, w in enumerate(doc[j0:j1], j0):
            if w in wanted:
                if w in where:
                    where[w].append(j)
                else:
                    where[w] = [j]
        for i, w in enumerate(item):
            if w in where:
                row = (i + 4) * wide
                if regions:
                    least, most = low + item_at[i], high + item_at[i]
                    for j in where[w]:
                        if least <= doc_at[j] <= most:
                            found.add(row + j)
                else:
                    found.update([row + j for j in where[w]])
    if not found:
        return 0
    cells = sorted(found)
    all_cells, step = set(cells), wide + 1
    # a word kept alone between two changes can't pay for either, so only words kept beside another count
    cells = [c for c in cells if c - step in all_cells or c + step in all_cells]
    weights = weights or [1.0] * len(item)
    if enough != float("inf") and sum(weights[i - 4] for i in {c // wide for c in cells}) < enough * STAY / OF - 1:
        return 0
    upto = [0.0] * 4 + [0.0, *accumulate(weights)]  # weight before word i, in the cells' numbering
    passages: dict[tuple[int, int], tuple[int, int]] = {}
    total = 0.0
    for cost, least, dear in ((DEAR, LEAST_WORDS, frozenset()), (COSTS[0], LONG_WORDS, frozenset()), *((c, LEAST_WORDS, slots) for c in COSTS)):
        before = len(passages), sum(i for i, _ in passages.values())
        for first, (last, _, _) in _chains(cells, wide, cost, least, dear).items():
            key = divmod(first, wide)
            passages[key] = max(passages.get(key, (0, 0)), divmod(last, wide))
        if before != (len(passages), sum(i for i, _ in passages.values())):
            total = _most_words(passages, upto, enough)
        if total >= enough:
            break
    return total


def _most_words(passages: dict[tuple[int, int], tuple[int, int]], upto: list[float], enough: float) -> float:
    """Weight of passages in the item's order and the document's order, as many words as possible."""
    longest = max((upto[i + 1] - upto[fi] for (fi, _), (i, _) in passages.items()), default=0.0)
    if longest >= enough:
        return longest
    spans = sorted((fi, fj, i, j) for (fi, fj), (i, j) in passages.items())
    total = [0.0] * len(spans)
    for x, (fi, fj, i, j) in enumerate(spans):
        total[x] = upto[i + 1] - upto[fi]
        for y in range(x):
            _, _, pi, pj = spans[y]
            if pj < fj and spans[y][0] < fi:
                total[x] = max(total[x], total[y] + upto[i + 1] - upto[max(fi, min(pi, i) + 1)])
    return max(total, default=0.0)


class Scanner:
    def __init__(self, index: ItemIndex, share: float):
        self.index, self.share = index, share
        self.needed = [share * TOLERANCE * sum(w) for w in index.weights]
        self.automaton = None
        if index.phrases:
            import ahocorasick

            self.automaton = ahocorasick.Automaton()
            for phrase, ids in index.phrases.items():
                self.automaton.add_word(phrase, ids)
            self.automaton.make_automaton()

    def phrases(self, norms: list[str]) -> list[tuple[int, int]]:
        """(row, item_id) of the items that are too short for passages and stand in a text as they are."""
        if self.automaton is None:
            return []
        return sorted({(r, i) for r, n in enumerate(norms) for _, ids in self.automaton.iter(f" {n} ") for i in ids})

    def scan(self, norms: list[str]) -> list[tuple[int, int]]:
        """(row, item) of every text that holds an item."""
        encoded = [n.encode() for n in norms]
        sizes = np.array([len(b) + Q for b in encoded], np.int64)
        edges = np.r_[0, np.cumsum(sizes)]
        data = np.frombuffer(b"".join(b + b" " * Q for b in encoded), np.uint8)
        if len(data) < Q or not self.index.ids:
            return []
        parts = []
        for start in range(0, len(data), CHUNK):
            at, k = self.index.lookup(_grams(data[start : start + CHUNK + Q - 1]))
            parts.append((at + start, k))
        at, k = (np.concatenate(p) for p in zip(*parts))
        row = np.searchsorted(edges, at, side="right") - 1
        owners = self.index.first[k + 1] - self.index.first[k]
        out: list[tuple[int, int]] = []
        # texts together up to EXPANDED hits; a single text beyond that goes through its items in parts
        weight = np.bincount(row, owners, minlength=len(norms))
        first = 0
        while first < len(norms):
            last, total = first + 1, weight[first]
            while last < len(norms) and total + weight[last] <= EXPANDED:
                total += weight[last]
                last += 1
            part = slice(*np.searchsorted(row, [first, last]))
            if total:
                out += self._judge(norms, data, edges, at[part], k[part], row[part], owners[part], total)
            first = last
        return out

    def _judge(self, norms: list[str], data: np.ndarray, edges: np.ndarray, at: np.ndarray, k: np.ndarray, row: np.ndarray, owners: np.ndarray, total: float) -> list[tuple[int, int]]:
        n_items = len(self.index.ids)
        if total > EXPANDED:  # one text: count per item first, then look only at the items with enough q-grams
            counts = np.zeros(n_items, np.int64)
            steps = np.flatnonzero(np.diff(np.cumsum(owners) // EXPANDED, prepend=-1))
            pieces = [slice(a, b) for a, b in zip(steps, [*steps[1:], len(at)])]
            for p in pieces:
                counts += np.bincount(self.index.expand(at[p], k[p])[1], minlength=n_items)
            wanted = counts >= self.index.least
            kept = []
            for p in pieces:
                place, item, inside = self.index.expand(at[p], k[p])
                ok = wanted[item]
                kept.append((place[ok], item[ok], inside[ok]))
            at, item, place = (np.concatenate(x) for x in zip(*kept))
            pair = row[0] * n_items + item
        else:
            which, item, place = self.index.expand(np.arange(len(at)), k)
            at, pair = at[which], row[which] * n_items + item
            if len(norms) * n_items <= EXPANDED:  # few enough cells to count without sorting
                enough = np.bincount(pair, minlength=len(norms) * n_items).reshape(-1, n_items) >= self.index.least
                ok = enough.ravel()[pair]
                at, pair, place = at[ok], pair[ok], place[ok]
        if not len(at):
            return []
        diagonal = at - edges[pair // n_items] - place
        # regions: q-grams of a pair on diagonals less than a band apart
        bits = max(27, int(edges[-1]).bit_length() + 2)
        key = (pair << bits) | (diagonal + (1 << bits - 2))
        order = np.argsort(key)
        key = key[order]
        starts = np.flatnonzero(np.r_[True, np.diff(key) >= BAND])
        counts = np.diff(np.r_[starts, len(key)])
        owner = key[starts] >> bits
        strong = counts >= self.index.least_passage[owner % n_items]
        order, counts, owner = order[np.repeat(strong, counts)], counts[strong], owner[strong]
        if not len(order):
            return []
        at, place, diagonal = at[order], place[order], diagonal[order]
        starts = np.r_[0, np.cumsum(counts)[:-1]]
        # each place of the item counts once
        region = np.repeat(np.arange(len(starts)), counts)
        once = np.sort((region << 26) | place)
        counts = np.bincount(once[np.r_[True, np.diff(once) != 0]] >> 26, minlength=len(starts))
        strong = np.flatnonzero(counts >= self.index.least_passage[owner % n_items])
        if not len(strong):
            return []
        first, last = np.minimum.reduceat(at, starts)[strong], np.maximum.reduceat(at, starts)[strong] + Q
        low, high = diagonal[starts][strong] - BAND, diagonal[np.r_[starts[1:], len(at)] - 1][strong] + BAND
        owner, counts = owner[strong], counts[strong]
        pairs, begins = np.unique(owner, return_index=True)
        ok = np.add.reduceat(counts, begins) >= self.index.least[pairs % n_items]
        ok[ok] = self._seen_enough(pairs[ok], begins[ok], np.r_[begins[1:], len(owner)][ok], strong, region, place)
        found = []
        words: dict[int, tuple[list[str], list[int]]] = {}
        for p, s, e in zip(pairs[ok].tolist(), begins[ok].tolist(), np.r_[begins[1:], len(owner)][ok].tolist()):
            r, i = divmod(p, n_items)
            base = int(edges[r])
            regions = [(f - base, x - base, a, b) for f, x, a, b in zip(*(v[s:e].tolist() for v in (first, last, low, high)))]
            if r not in words:
                blanks = np.flatnonzero(data[base : int(edges[r + 1]) - Q] == 32)
                words[r] = (norms[r].split(" "), [0, *(blanks + 1).tolist()])
            doc, doc_at = words[r]
            got = banded_passages(self.index.words[i], doc, self.needed[i], self.index.weights[i], self.index.slots[i], regions, self.index.places[i], doc_at)
            if got >= self.needed[i]:
                found.append((r, i))
        return found

    def _seen_enough(self, pairs: np.ndarray, begins: np.ndarray, ends: np.ndarray, strong: np.ndarray, region: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Whether the q-grams of each pair's regions cover words of enough weight; begins and ends are its regions among the strong ones."""
        if not len(pairs):
            return np.zeros(0, bool)
        regions = ends - begins
        owner = np.full(int(region[-1]) + 1, -1)
        owner[strong[np.repeat(begins - np.r_[0, np.cumsum(regions)[:-1]], regions) + np.arange(regions.sum())]] = np.repeat(np.arange(len(pairs)), regions)
        which = owner[region]
        hit = which >= 0
        which, place = which[hit], place[hit]
        index, item = self.index, pairs % len(self.index.ids)
        base = np.r_[0, np.cumsum(index.bytes[item] + 1)]
        size = int(base[-1]) + 1
        edge = np.bincount(base[which] + place, minlength=size) - np.bincount(base[which] + place + Q, minlength=size)
        covered = np.r_[0, np.cumsum(np.cumsum(edge) > 0)]  # bytes covered before each byte
        n_words = index.word_first[item + 1] - index.word_first[item]
        starts = np.r_[0, np.cumsum(n_words)[:-1]]
        word = np.repeat(index.word_first[item] - starts, n_words) + np.arange(n_words.sum())
        at = np.repeat(base[:-1], n_words) + index.word_place[word]
        whole = covered[at + index.word_size[word]] - covered[at] == index.word_size[word]
        return np.add.reduceat(np.where(whole, index.weight[word], 0.0), starts) >= index.least_seen[item]


def find_leaks(
    corpus: DataFrame, items: DataFrame, *, id_column: str = "doc_id", text_column: str = "text",
    item_column: str = "item_id", item_text: str = "text", share: float = 0.5,
) -> DataFrame:
    """(item_id, doc_id): documents that hold at least ``share`` of an item's words, in its order.

    The items are a stated query set: they are read to the driver in blocks of
    ITEMS_PER_BLOCK or BLOCK_CHARS and every block is held against all rows in
    one narrow pass over the corpus, without a shuffle of texts. Items of fewer
    than LEAST_WORDS words are found where they stand as a whole, apart from
    form. Null and blank texts and null ids on either side match nothing;
    repeated rows give one result.
    """
    rows = [(r[0], r[1]) for r in items.select(item_column, item_text).limit(MOST_ITEMS + 1).collect() if r[0] is not None and r[1]]
    if len(rows) > MOST_ITEMS:
        raise ValueError("more items than a query set may have")
    narrow = corpus.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")).filter("text IS NOT NULL AND doc_id IS NOT NULL")
    slots = template_slots([normalise(text).split() for _, text in rows])  # over all items, whatever the blocks
    item_type, doc_type = items.schema[item_column].dataType.simpleString(), narrow.schema["doc_id"].dataType.simpleString()
    item_arrow = pa.int64() if item_type == "bigint" else None
    out = None
    start = 0
    while start < max(1, len(rows)):
        end, size = start, 0
        while end < len(rows) and end - start < ITEMS_PER_BLOCK and (end == start or size + len(rows[end][1]) <= BLOCK_CHARS):
            size += len(rows[end][1])
            end += 1
        # built once, at most about 30 bytes a character of BLOCK_CHARS
        shared = corpus.sparkSession.sparkContext.broadcast(ItemIndex(rows[start:end], slots[start:end], share=share))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            scanner = Scanner(index, share)
            for batch in batches:
                ids = batch.column(0)
                for first, texts in text_blocks(batch.column(1)):
                    norms = [normalise(t) for t in texts]
                    hits = [(r, index.ids[i]) for r, i in scanner.scan(norms)] + scanner.phrases(norms)
                    docs = ids.take(pa.array([first + r for r, _ in hits], pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array([i for _, i in hits], item_arrow) if hits or item_arrow else pa.array([], pa.string()), docs], ["item_id", "doc_id"])

        part = narrow.mapInArrow(run, f"item_id {item_type}, doc_id {doc_type}")
        out = part if out is None else out.unionByName(part)
        start = max(end, start + 1)
    return out.distinct()
