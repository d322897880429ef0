"""How words are mostly written, told by the merge ranks of public tokenizer vocabularies.

A vocabulary holds `` kate`` or `` Kate`` as one token if that spelling was
frequent where it was made. A word known only with a capital is mostly a
name; one known in lower case is an everyday word.
"""

from __future__ import annotations

import math
import os

from sparkloom.llm import vocabulary

#: Vocabulary files looked at; the best rank of a spelling counts.
FILES = ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken")


class Lexicon:
    """(everyday, capital) of a lower-case word: 0 unknown in that spelling, up to 1 for the most frequent."""

    def __init__(self, folder: str | None = None):
        folder = folder or os.environ.get("TOKENIZER_DIR", vocabulary.DEFAULT_DIR)
        everyday: dict[str, int] = {}
        capital: dict[str, int] = {}
        for name in FILES:
            for token, rank in vocabulary.parse_ranks(vocabulary.rank_file(os.path.join(folder, name))).items():
                try:
                    word = token.decode()
                except UnicodeDecodeError:
                    continue
                if word[:1] != " " or not word[1:].isalpha():
                    continue
                word = word[1:]
                kind = everyday if word.islower() else capital
                low = word.lower()
                kind[low] = min(rank, kind.get(low, rank))
        self.words = {w: (_score(everyday.get(w)), _score(capital.get(w))) for w in {*everyday, *capital}}

    def __call__(self, word: str) -> tuple[float, float]:
        return self.words.get(word) or self.words.get(word.rstrip(".'’")) or (0.0, 0.0)

    def proper(self) -> list[str]:
        """Words of three letters or more that are known with a capital only."""
        return sorted(w for w, (low, cap) in self.words.items() if cap and not low and len(w) > 2)

    def everyday(self) -> list[str]:
        return sorted(w for w, (low, _) in self.words.items() if low and len(w) > 1)


def _score(rank: int | None) -> float:
    return 0.0 if rank is None else 1.0 - math.log(rank + 2) / math.log(60_000)
