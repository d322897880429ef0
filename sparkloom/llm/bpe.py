"""Two exact byte-pair encoders over a rank table.

Both keep a piece as a doubly linked list of symbols and apply the pending
merge of lowest rank, leftmost first; they differ in the queue of pending
merges. ``count_symbols`` uses a binary heap and needs only the number of
surviving symbols. ``RankQueueEncoder`` uses buckets per rank under a
three-level bitmap, whose cost per merge does not depend on the piece's length.
"""

from __future__ import annotations

from heapq import heapify, heappop, heappush

#: Pieces kept by a task's memo before it starts anew; a bound on memory only.
MEMO_ENTRIES = 400_000


def count_symbols(piece: bytes, ranks: dict[bytes, int]) -> int:
    """Number of tokens of one pre-split piece."""
    n = len(piece)
    if n < 2 or piece in ranks:
        return 1 if n else 0
    get = ranks.get
    ahead = list(range(1, n + 1))  # start of the next symbol; n ends the list
    back = list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
    heapify(heap)
    alive = n
    while heap:
        _, i, end = heappop(heap)
        j = ahead[i]
        if j >= n or j < 0 or ahead[j] != end:  # one of the two symbols changed since
            continue
        ahead[i] = end
        ahead[j] = -1
        alive -= 1
        if end < n:
            back[end] = i
            if (r := get(piece[i : ahead[end]])) is not None:
                heappush(heap, (r, i, ahead[end]))
        p = back[i]
        if p >= 0 and (r := get(piece[p:end])) is not None:
            heappush(heap, (r, p, end))
    return alive


class RankQueueEncoder:
    """Encoder with a hierarchical-bitmap rank queue.

    ``low``, ``mid`` and ``top`` are bitmaps of non-empty rank buckets, 64-way;
    find-first-set on them gives the next rank in three steps. A bucket holds
    (start, end) of pairs as a heap on start. An entry whose pair has changed
    since it was queued is skipped when met.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        words = (max(ranks.values(), default=0) >> 6) + 1
        self.low = [0] * words
        self.mid = [0] * ((words >> 6) + 1)
        self.top = 0
        self.buckets: dict[int, list[tuple[int, int]]] = {}

    def _push(self, rank: int, i: int, end: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.buckets[rank] = [(i, end)]
            w = rank >> 6
            self.low[w] |= 1 << (rank & 63)
            self.mid[w >> 6] |= 1 << (w & 63)
            self.top |= 1 << (w >> 6)
        else:
            heappush(bucket, (i, end))

    def _first(self) -> int:
        t = (self.top & -self.top).bit_length() - 1
        m = self.mid[t]
        w = (t << 6) + (m & -m).bit_length() - 1
        b = self.low[w]
        return (w << 6) + (b & -b).bit_length() - 1

    def _drop(self, rank: int) -> None:
        del self.buckets[rank]
        w = rank >> 6
        self.low[w] ^= 1 << (rank & 63)
        if not self.low[w]:
            self.mid[w >> 6] ^= 1 << (w & 63)
            if not self.mid[w >> 6]:
                self.top ^= 1 << (w >> 6)

    def encode_piece(self, piece: bytes) -> list[int]:
        ranks = self.ranks
        n = len(piece)
        if not n:
            return []
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        get = ranks.get
        ahead = list(range(1, n + 1))
        back = list(range(-1, n - 1))
        for i in range(n - 1):
            if (r := get(piece[i : i + 2])) is not None:
                self._push(r, i, i + 2)
        while self.top:
            rank = self._first()
            bucket = self.buckets[rank]
            i, end = heappop(bucket)
            if not bucket:
                self._drop(rank)
            j = ahead[i]
            if j >= n or j < 0 or ahead[j] != end:
                continue
            ahead[i] = end
            ahead[j] = -1
            if end < n:
                back[end] = i
                if (r := get(piece[i : ahead[end]])) is not None:
                    self._push(r, i, ahead[end])
            p = back[i]
            if p >= 0 and (r := get(piece[p:end])) is not None:
                self._push(r, p, end)
        out = []
        i = 0
        while i < n:
            out.append(ranks[piece[i : ahead[i]]])
            i = ahead[i]
        return out
