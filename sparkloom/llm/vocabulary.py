"""Rank files of public byte-level BPE vocabularies.

The file is read on the driver (under 1 MB, fixed by the vocabulary) and sent
to the tasks inside the operator's closure, so executors need no copy of it.
"""

from __future__ import annotations

import base64
import os

DEFAULT_DIR = "/opt/tokenizers"
DEFAULT_NAME = "byte_bpe_50k.tiktoken"
#: Fixed value: the published pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def rank_file(path: str | None = None) -> bytes:
    path = path or os.path.join(os.environ.get("TOKENIZER_DIR", DEFAULT_DIR), DEFAULT_NAME)
    with open(path, "rb") as f:
        return f.read()


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    ranks = {}
    for line in raw.splitlines():
        token, rank = line.split()
        ranks[base64.b64decode(token)] = int(rank)
    return ranks
