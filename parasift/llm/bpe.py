"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

The pre-tokens that a run of texts shows for the first time are laid end to end in one linked list. Each
merge rank has a bucket of positions in that list. A bitmap marks the ranks whose bucket is not empty:
64-bit leaf words under a summary with one bit a word, so the least ranks are two find-first-set steps
away, however long a pre-token is. The buckets of the least leaf are taken together, and in each
pre-token the pairs of its least rank merge; positions that a neighbour's merge outdated stay in their
bucket and are skipped when they come up.

Texts stay bytes all the way: classes of characters, cuts between pre-tokens, the table of known
pre-tokens and decoding are array operations, so a worker holds no Python object a word.
"""

from __future__ import annotations

import base64
import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from parasift.llm.common import row_chunks, tidy, utf8

# The pattern that ``cuts`` follows; for any other the texts go through the pattern itself.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
OTHER, LETTER, NUMBER, WHITE = 0, 1, 2, 3

#: Known pre-tokens a worker keeps, beside the vocabulary; 60 bytes each. Longer ones than WIDTH are not kept.
TABLE_WORDS = 300_000
WIDTH = 24
#: Bytes of text whose ids are made together (or one longer text), and that are cut at a time.
BATCH_BYTES = 4 << 20
WINDOW_BYTES = 1 << 19
#: Pre-tokens are merged together up to about so many bytes.
MERGE_BYTES = 1 << 20
NONE = -1
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


@lru_cache(maxsize=1)
def kinds() -> np.ndarray:
    """The class of every character: letter, number, white space or other."""
    out = np.zeros(sys.maxunicode + 1, np.uint8)
    for low, high in ((0, 0xD800), (0xE000, sys.maxunicode + 1)):
        every = "".join(map(chr, range(low, high)))
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (WHITE, r"\s+")):
            for m in regex.finditer(pattern, every):
                out[low + m.start() : low + m.end()] = kind
    return out


def byte_kinds(data: np.ndarray) -> np.ndarray:
    """The class of the character that each byte belongs to."""
    out = kinds()[:256][data]
    lead = np.flatnonzero(data >= 0xC0)
    if not len(lead):
        return out
    more = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int32)
    first = more[lead]
    size = 2 + (first >= 0xE0) + (first >= 0xF0)
    code = first & (0x7F >> size)
    for i in (1, 2, 3):
        code = np.where(i < size, code << 6 | more[lead + i] & 0x3F, code)
    kind = kinds()[code]
    for i in (0, 1, 2, 3):
        here = i < size
        out[lead[here] + i] = kind[here]
    return out


def cuts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where pre-tokens of ``PATTERN`` begin in texts that begin at ``starts`` in ``data``."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    kind = byte_kinds(data)
    bound = np.zeros(n + 1, bool)
    bound[starts] = bound[n] = True
    begin = bound[:n].copy()
    begin[1:] |= kind[1:] != kind[:-1]
    run = np.flatnonzero(begin)
    end = np.append(run[1:], n)
    # White space: all but its last character, unless the text ends there; a last space joins what follows.
    white = kind[run] == WHITE
    end_white = end[white]
    end_white = end_white[~bound[end_white]]
    last = end_white - 1
    while (inner := data[last] & 0xC0 == 0x80).any():
        last = last - inner
    begin[last] = True
    begin[end_white[data[last] == 32]] = False
    # Contractions: an apostrophe of its own, then one or two certain letters, whatever letters come after.
    mark = run[(data[run] == 39) & begin[run] & (end == run + 1)]
    mark = mark[~bound[mark + 1]]
    one = data[mark + 1]
    second = np.minimum(mark + 2, n - 1)
    two = np.where(bound[mark + 2], 0, data[second])
    short = np.isin(one, list(b"stmd"))
    long = ((one == 114) & (two == 101)) | ((one == 118) & (two == 101)) | ((one == 108) & (two == 108))
    for chosen, size in ((short, 2), (long, 3)):
        begin[mark[chosen] + 1] = False
        after = mark[chosen] + size
        begin[after[after < n]] = True
    return np.flatnonzero(begin)


class RankQueue:
    """Buckets of list positions by merge rank; ``pop`` empties those of the least leaf of 64 ranks."""

    def __init__(self) -> None:
        self.buckets: dict[int, list[np.ndarray]] = {}
        self.leaves: dict[int, int] = {}
        self.summary = 0

    def push(self, positions: np.ndarray, ranks: np.ndarray) -> None:
        if not len(positions):
            return
        order = np.argsort(ranks, kind="stable")
        positions, ranks = positions[order], ranks[order]
        first = np.flatnonzero(np.append(True, ranks[1:] != ranks[:-1])).tolist()
        for rank, a, z in zip(ranks[first].tolist(), first, [*first[1:], len(ranks)]):
            held = self.buckets.get(rank)
            if held is not None:
                held.append(positions[a:z])
            else:
                self.buckets[rank] = [positions[a:z]]
                word = rank >> 6
                self.leaves[word] = self.leaves.get(word, 0) | 1 << (rank & 63)
                self.summary |= 1 << word

    def pop(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions and ranks of the least leaf, by rank."""
        word = (self.summary & -self.summary).bit_length() - 1
        self.summary &= self.summary - 1
        leaf = self.leaves.pop(word)
        parts, ranks, counts = [], [], []
        while leaf:
            rank = word << 6 | (leaf & -leaf).bit_length() - 1
            leaf &= leaf - 1
            bucket = self.buckets.pop(rank)
            parts += bucket
            ranks.append(rank)
            counts.append(sum(map(len, bucket)))
        return np.concatenate(parts), np.repeat(np.array(ranks, np.int32), counts)


class PairTable:
    """Merge rank of a pair of tokens, by open addressing."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(10, int(len(keys) * 3).bit_length())
        self.keys, self.values = np.full(1 << self.bits, NONE, np.int64), np.full(1 << self.bits, NONE, np.int32)
        todo, at = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = self.keys[at] == NONE
            self.keys[at[free]] = keys[todo[free]]
            placed = self.keys[at] == keys[todo]
            self.values[at[placed]] = values[todo[placed]]
            todo, at = todo[~placed], (at[~placed] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * _MIX[0] >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        seen = self.keys[at]
        out = np.where(seen == keys, self.values[at], np.int32(NONE))
        todo = np.flatnonzero((seen != keys) & (seen != NONE))
        while len(todo):
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
            seen = self.keys[at[todo]]
            hit = seen == keys[todo]
            out[todo[hit]] = self.values[at[todo[hit]]]
            todo = todo[~hit & (seen != NONE)]
        return out


class Ranks:
    """A vocabulary: the rank of a token pair is that of the joined bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        self.base = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.width = len(tokens)
        keys, values = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left * self.width + right)
                    values.append(rank)
        self.pairs = PairTable(np.array(keys, np.int64), np.array(values, np.int32))

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return self.pairs.get(np.multiply(left, self.width, dtype=np.int64) + right)

    def merge(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pre-tokens of ``sizes`` bytes that ``data`` holds end to end, and how many each has.
        In each, the leftmost pair of the least rank merges next."""
        ends = np.cumsum(sizes)
        n = len(data)
        token = self.base[data]
        piece = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        after[ends - 1] = NONE
        before[ends - sizes] = NONE
        at = np.flatnonzero(after >= 0)
        rank_at = np.full(n, NONE, np.int32)
        rank_at[at] = self.pair(token[at], token[at + 1])
        alive = np.ones(n, bool)
        queue = RankQueue()
        at = at[rank_at[at] >= 0]
        queue.push(at, rank_at[at])
        while queue.summary:
            at, rank = queue.pop()
            at = at[rank_at[at] == rank]
            if not len(at):
                continue
            # By pre-token, then rank, then place; a position that waits twice counts once.
            key = (piece[at].astype(np.int64) << 6 | rank_at[at] & 63) << 32 | at
            key.sort()
            key = key[np.append(True, key[1:] != key[:-1])]
            at = key & 0xFFFFFFFF
            group = key >> 32
            own = group >> 6
            first = np.append(True, own[1:] != own[:-1])
            rest = at[:0]
            if not first.all():
                least = group == group[first][np.cumsum(first) - 1]
                rest, at, own, first = at[~least], at[least], own[least], first[least]
                if not first.all():
                    chosen = self._together(rank_at[at], at, own, first, token, after, before)
                    rest, at = np.concatenate([rest, at[~chosen]]), at[chosen]
            right = after[at]
            follow = after[right]
            token[at] = rank_at[at]
            after[at] = follow
            held = follow >= 0
            before[follow[held]] = at[held]
            alive[right] = False
            rank_at[right] = NONE
            left = before[at]
            touched = np.concatenate([at, left[left >= 0]])
            beyond = after[touched]
            open_ = beyond >= 0
            rank_at[touched[~open_]] = NONE
            touched, beyond = touched[open_], beyond[open_]
            new = self.pair(token[touched], token[beyond])
            rank_at[touched] = new
            touched, new = touched[new >= 0], new[new >= 0]
            if len(rest):
                again = rank_at[rest]
                touched, new = np.concatenate([touched, rest[again >= 0]]), np.concatenate([new, again[again >= 0]])
            queue.push(touched, new)
        kept = np.flatnonzero(alive)
        counts = np.diff(np.searchsorted(kept, ends), prepend=0)
        return token[kept], counts

    def _together(self, rank, at, own, first, token, after, before) -> np.ndarray:
        """Which of the pairs of a pre-token's least rank merge in the same step: every second one of a run
        of overlapping pairs, but only the leftmost where a merge makes a lesser rank."""
        index = np.arange(len(at))
        start = np.append(True, at[1:] != after[at[:-1]])
        run = np.maximum.accumulate(np.where(start, index, 0))
        chosen = (index - run) % 2 == 0
        some, rank = at[chosen], rank[chosen]
        right = after[some]
        follow, left = after[right], before[some]
        merged = np.zeros(len(some), bool)
        merged[:-1] = (follow[:-1] == some[1:]) & (follow[:-1] >= 0)
        lesser = np.zeros(len(some), bool)
        for a, b, here in ((rank, token[follow], follow >= 0), (rank, rank, merged), (token[left], rank, left >= 0)):
            new = self.pair(a, b)
            lesser |= here & (new >= 0) & (new < rank)
        if lesser.any():
            chosen &= ~np.isin(own, own[chosen][lesser]) | first
        return chosen

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes that ``ids`` stand for, end to end."""
        return spans(self.bytes, self.begins[ids], self.sizes[ids])


def spans(data: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The given stretches of ``data``, end to end; places are worked out for some of them at a time."""
    ends = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(int(ends[-1]), data.dtype)
    for a, z in row_chunks(ends, WINDOW_BYTES):
        low, high = int(ends[a]), int(ends[z])
        out[low:high] = data[np.repeat(begins[a:z] - ends[a:z], sizes[a:z]) + np.arange(low, high)]
    return out


class Pieces:
    """Pre-tokens seen before and their ids, by open addressing on up to ``WIDTH`` bytes."""

    def __init__(self, model: Ranks):
        self.model = model
        held = [(t, r) for t, r in model.ranks.items() if len(t) <= WIDTH]
        data = np.frombuffer(b"".join(t for t, _ in held) + bytes(WIDTH), np.uint8)
        sizes = np.array([len(t) for t, _ in held], np.int64)
        self.words, self.hashes = _words(data, np.cumsum(sizes) - sizes, sizes)
        self.sizes = sizes.astype(np.uint8)
        self.begins, self.counts = np.arange(len(held)), np.ones(len(held), np.int32)
        self.ids = np.array([r for _, r in held], np.int32)
        self.again = np.zeros(len(held), bool)
        self.base = self.count = len(held)
        self._index()

    def _index(self) -> None:
        self.bits = max(16, int(self.count * 3).bit_length())
        self.slots = np.full(1 << self.bits, NONE, np.int32)
        self._place(np.arange(self.count))

    def _slot(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - self.bits)).astype(np.int64)

    def _place(self, todo: np.ndarray) -> None:
        at = self._slot(self.hashes[todo])
        while len(todo):
            free = self.slots[at] == NONE
            self.slots[at[free]] = todo[free]
            left = self.slots[at] != todo
            todo, at = todo[left], (at[left] + 1) & ((1 << self.bits) - 1)

    def find(self, words: np.ndarray, hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The number of each pre-token; those not yet known, repeats too, get ``NONE``."""
        out = np.full(len(hashes), NONE, np.int32)
        todo, at = np.arange(len(hashes)), self._slot(hashes)
        while len(todo):
            held = self.slots[at]
            known = held != NONE
            todo, at, held = todo[known], at[known], held[known]
            same = (self.hashes[held] == hashes[todo]) & (self.sizes[held] == sizes[todo])
            for i in range(WIDTH // 8):
                same &= self.words[i][held] == words[i][todo]
            out[todo[same]] = held[same]
            todo, at = todo[~same], (at[~same] + 1) & ((1 << self.bits) - 1)
        self.again[out[out >= 0]] = True
        return out

    def add(self, words: np.ndarray, hashes: np.ndarray, sizes: np.ndarray) -> None:
        """New pre-tokens, all different; their ids come with ``told``."""
        first = self.count
        self.words = np.concatenate([self.words, words], axis=1)
        self.hashes = np.concatenate([self.hashes, hashes])
        self.sizes = np.concatenate([self.sizes, sizes.astype(np.uint8)])
        self.again = np.concatenate([self.again, np.zeros(len(sizes), bool)])
        self.count += len(sizes)
        if self.count * 2 > 1 << self.bits:
            self._index()
        else:
            self._place(np.arange(first, self.count))

    def told(self, ids: np.ndarray, counts: np.ndarray) -> None:
        """Ids of the next pre-tokens, in the order of their numbers."""
        self.begins = np.concatenate([self.begins, len(self.ids) + np.cumsum(counts) - counts])
        self.counts = np.concatenate([self.counts, counts.astype(np.int32)])
        self.ids = np.concatenate([self.ids, ids])

    def shrink(self, most: int) -> None:
        """With over ``most`` beside the vocabulary, only those that came again stay."""
        if self.count - self.base <= most:
            return
        kept = np.append(np.arange(self.base), self.base + np.flatnonzero(self.again[self.base :]))
        if len(kept) - self.base > most // 2:
            kept = kept[: self.base]
        self.ids = spans(self.ids, self.begins[kept], self.counts[kept])
        self.words, self.hashes, self.sizes, self.counts = self.words[:, kept], self.hashes[kept], self.sizes[kept], self.counts[kept]
        self.begins = np.cumsum(self.counts.astype(np.int64)) - self.counts
        self.again = np.zeros(len(kept), bool)
        self.count = len(kept)
        self._index()


def _words(data: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Up to ``WIDTH`` bytes at ``begins`` as integers of eight bytes, and a hash; ``data`` has as many
    bytes to spare at its end."""
    eight = np.ndarray(max(0, len(data) - 7), np.dtype("<u8"), data, strides=(1,))
    out = np.zeros((WIDTH // 8, len(begins)), np.uint64)
    hashes = sizes.astype(np.uint64) * _MIX[-1]
    for i in range(WIDTH // 8):
        here = slice(None) if i == 0 else np.flatnonzero(sizes > 8 * i)
        out[i, here] = eight[begins[here] + 8 * i] & _KEEP[np.minimum(sizes[here] - 8 * i, 8)]
        hashes[here] = (hashes[here] ^ out[i, here]) * _MIX[i]
        hashes[here] ^= hashes[here] >> np.uint64(29)
    return out, hashes * _MIX[-1]


class Codec:
    """Encoder and decoder of one vocabulary file of lines ``base64-token rank``."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = Ranks({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)})
        self.pattern = None if pattern == PATTERN else regex.compile(pattern)
        self.pieces = Pieces(self.ranks)

    def _windows(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """Stretches of ``data``, the starts of texts in them and where they lie; a longer text is cut where a
        lone space between two plain characters begins a pre-token."""
        plain = lambda at: (data[at] > 32) & (data[at] < 127)
        for a, z in row_chunks(offsets, WINDOW_BYTES):
            low, high = int(offsets[a]), int(offsets[z])
            begins = offsets[a:z]
            while high - low > 2 * WINDOW_BYTES:
                at = low + WINDOW_BYTES + np.flatnonzero(data[low + WINDOW_BYTES : min(low + 2 * WINDOW_BYTES, high - 1)] == 32)
                at = at[plain(at - 1) & plain(at + 1)]
                if not len(at):
                    break
                yield data[low : at[0]], np.zeros(1, np.int64), low
                low = int(at[0])
                begins = np.array([low])
            begins = begins[begins < high]
            yield data[low:high], begins - low, low

    def encode_rows(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts that lie in ``data`` between ``offsets``, end to end, and where each text's begin."""
        self.pieces.shrink(TABLE_WORDS)
        if self.pattern is not None:
            whole = data.tobytes()
            found = [[p.encode() for p in self.pattern.findall(whole[a:z].decode())] for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            data = np.frombuffer(b"".join(p for row in found for p in row), np.uint8)
            begins = np.cumsum([0, *(len(p) for row in found for p in row)])
            offsets = begins[np.cumsum([0, *map(len, found)])]
            windows = iter([(data, begins[:-1], 0)] if len(data) else [])
        else:
            windows = ((part, cuts(part, starts), low) for part, starts, low in self._windows(data, offsets))
        numbers, places, waiting = [], [], _Waiting(self.ranks, self.pieces)
        for part, begins, low in windows:
            numbers.append(waiting.number(part, begins))
            places.append(begins + low)
        waiting.settle()
        number = np.concatenate(numbers) if numbers else np.zeros(0, np.int64)
        place = np.concatenate(places) if places else np.zeros(0, np.int64)
        begins, counts, ids = waiting.table()
        sizes = counts[number]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return spans(ids, begins[number], sizes), ends[np.searchsorted(place, offsets)]

    def encode(self, text: str) -> list[int]:
        raw = np.frombuffer(text.encode(), np.uint8)
        return self.encode_rows(raw, np.array([0, len(raw)]))[0].tolist()


class _Waiting:
    """Pre-tokens of one batch: those new to the table wait until enough are there to be merged together."""

    def __init__(self, ranks: Ranks, pieces: Pieces):
        self.ranks, self.pieces = ranks, pieces
        self.raw: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.waiting = 0
        #: Pre-tokens too long for the table, by number below ``NONE``.
        self.long: dict[bytes, int] = {}
        self.long_ids: list[np.ndarray] = []

    def number(self, data: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """A number for each pre-token of a window."""
        sizes = np.diff(begins, append=len(data))
        padded = np.concatenate([data, np.zeros(WIDTH, np.uint8)])
        words, hashes = _words(padded, begins, np.minimum(sizes, WIDTH))
        short = sizes <= WIDTH
        out = np.full(len(begins), NONE, np.int64)
        at = slice(None) if short.all() else np.flatnonzero(short)
        found = self.pieces.find(words[:, at], hashes[at], sizes[at])
        new = np.flatnonzero(found == NONE)
        if len(new):
            here = new if isinstance(at, slice) else at[new]
            order = np.argsort(hashes[here], kind="stable")
            here, new = here[order], new[order]
            fresh = np.ones(len(here), bool)
            fresh[1:] = (hashes[here][1:] != hashes[here][:-1]) | (sizes[here][1:] != sizes[here][:-1]) | (words[:, here][:, 1:] != words[:, here][:, :-1]).any(axis=0)
            found[new] = self.pieces.count + np.cumsum(fresh) - 1
            one = here[fresh]
            self.pieces.add(words[:, one], hashes[one], sizes[one])
            self._wait(spans(data, begins[one], sizes[one]), sizes[one])
        out[at] = found
        for i in np.flatnonzero(~short).tolist():
            raw = data[begins[i] : begins[i] + sizes[i]]
            held = self.long.setdefault(raw.tobytes(), len(self.long))
            if held == len(self.long_ids):
                rank = self.ranks.ranks.get(raw.tobytes())
                self.long_ids.append(self.ranks.merge(raw, np.array([len(raw)]))[0] if rank is None else np.array([rank], np.int32))
            out[i] = NONE - 1 - held
        return out

    def _wait(self, raw: np.ndarray, sizes: np.ndarray) -> None:
        self.raw.append(raw)
        self.sizes.append(sizes)
        self.waiting += len(raw)
        if self.waiting >= MERGE_BYTES:
            self.settle()

    def settle(self) -> None:
        if self.waiting:
            self.pieces.told(*self.ranks.merge(np.concatenate(self.raw), np.concatenate(self.sizes)))
            self.raw, self.sizes, self.waiting = [], [], 0

    def table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begin, count and ids by number; long pre-tokens stand at the end, as their numbers count from there."""
        if not self.long_ids:
            return self.pieces.begins, self.pieces.counts, self.pieces.ids
        counts = np.array([len(x) for x in self.long_ids])
        begins = len(self.pieces.ids) + np.cumsum(counts) - counts
        back = lambda x: np.append(x[::-1], 0)  # noqa: E731  number NONE itself is nobody's
        return np.concatenate([self.pieces.begins, back(begins)]), np.concatenate([self.pieces.counts, back(counts)]), np.concatenate([self.pieces.ids, *self.long_ids])


@lru_cache(maxsize=1)
def codec(path: str, pattern: str) -> Codec:
    """One codec a worker process."""
    return Codec(path, pattern)


def encode_decode(df: DataFrame, vocabulary: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` plus ``ids`` (array of int) and ``decoded`` (the bytes those ids stand for).

    Narrow: no shuffle. A worker codes about 4 MB of text at a time (a longer text alone; it is cut into
    windows at lone spaces) and keeps a table of ``TABLE_WORDS`` pre-tokens of up to 24 bytes; when it is
    full, those seen once go. Longer pre-tokens are coded anew in each batch. A null text is the empty
    text: no ids, no bytes. Repeated rows each give their own row; an empty table gives none. Other columns
    of ``df`` are ignored, whatever their names; ``keep`` may not name ``ids`` or ``decoded``.
    ``vocabulary`` is a path that every worker can open.
    """
    if {"ids", "decoded"} & set(keep):
        raise ValueError("ids and decoded are columns of the result")
    fields = [f for f in df.schema.fields if f.name in keep]
    schema = T.StructType([*fields, T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("decoded", T.BinaryType())])
    names = [f.name for f in fields]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary, pattern)
        for batch in batches:
            data, offsets = utf8(batch.column(batch.num_columns - 1))
            for a, z in row_chunks(offsets, BATCH_BYTES):
                part = offsets[a : z + 1]
                ids, at = own.encode_rows(data[part[0] : part[-1]], part - part[0])
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids, pa.int32()))
                ends = np.concatenate([[0], np.cumsum(own.ranks.sizes[ids])])[at].astype(np.int32)
                decoded = pa.Array.from_buffers(pa.binary(), z - a, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(own.ranks.decode(ids).tobytes())])
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, z - a) for i in range(len(names))), lists, decoded], names=[*names, "ids", "decoded"])

    return df.select(*names, text).mapInArrow(run, schema)
