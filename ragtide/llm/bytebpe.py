"""Byte-level BPE encoding of Arrow string columns.

Two tiers. A minimal perfect hash over the vocabulary resolves every pre-token that is one vocabulary entry. A
miss is encoded by merging over linked bytes: pre-tokens of up to 16 bytes in lockstep (the links and the
queue of pair ranks of all distinct misses of a batch are rows of arrays, and the head of each queue is its row
minimum), longer ones each with a heap. Everything before and after works on whole Arrow buffers.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

NONE = np.int32(2**31 - 1)
SHORT = 16
SLICE_BYTES = 8 << 20
WORD_GAP = re.compile(rb"[a-z] (?=[a-z])")
LETTER, NUMBER, OTHER, SPACE, UNKNOWN = range(5)
#: The white space of the pre-token pattern.
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: The contractions of the pre-token pattern.
CONTRACTIONS = ["s", "t", "re", "ve", "m", "ll", "d"]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def key_of(w0: np.ndarray, w1: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A 64-bit key of strings given as two little-endian words and a length."""
    return _mix(_mix(w0 + np.uint64(0x9E3779B97F4A7C15)) ^ (w1 * np.uint64(0xC2B2AE3D27D4EB4F)) ^ n.astype(np.uint64))


class PerfectHash:
    """A minimal perfect hash over distinct 64-bit keys: hash, then displace by bucket. n keys fill n slots."""

    def __init__(self, keys: np.ndarray) -> None:
        self.n = n = max(1, len(keys))
        self.buckets = max(1, n // 3)
        if len(keys) == 0:
            self.shift, self.slots, self.keys = np.zeros(1, np.int64), np.full(1, -1, np.int64), np.zeros(1, np.uint64)
            return
        for self.seed in range(1, 100):
            if self._build(keys.astype(np.uint64)):
                return
        raise ValueError("keys must be distinct")

    def _parts(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = _mix(keys + np.uint64(self.seed * 0x9E3779B97F4A7C15 % 2**64))
        return ((h >> np.uint64(32)) % np.uint64(self.buckets)).astype(np.int64), ((h & np.uint64(0xFFFFFFFF)) % np.uint64(self.n)).astype(np.int64)

    def _build(self, keys: np.ndarray) -> bool:
        n, (bucket, place) = self.n, self._parts(keys)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=self.buckets)
        starts = np.cumsum(sizes) - sizes
        free, shift, slots, rng = np.ones(2 * n, bool), np.zeros(self.buckets, np.int64), np.full(n, -1, np.int64), np.random.default_rng(self.seed)
        every = np.arange(n)
        singles = iter(())
        for b in np.argsort(-sizes, kind="stable"):
            if not (size := sizes[b]):
                break
            own = order[starts[b] : starts[b] + size]
            at = place[own]
            if size == 1:
                if not isinstance(singles, _Ahead):
                    singles = _Ahead(np.flatnonzero(free[:n]))
                d = (singles.next() - at[0]) % n
            else:
                if len(np.unique(at)) < size:
                    return False
                d = -1
                for tries in (rng.integers(0, n, 512), every):
                    fits = free[at[0] + tries]
                    for a in at[1:]:
                        fits = fits & free[a + tries]
                    if fits.any():
                        d = tries[fits.argmax()]
                        break
                if d < 0:
                    return False
            got = (at + d) % n
            free[got] = free[got + n] = False
            shift[b], slots[got] = d, own
        self.shift, self.slots, self.keys = shift, slots, keys[slots]
        return True

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The position of each key among those it was built from, or -1."""
        if self.slots[0] < 0:
            return np.full(len(keys), -1, np.int64)
        bucket, place = self._parts(keys)
        place += self.shift[bucket]
        place -= self.n * (place >= self.n)
        return np.where(self.keys[place] == keys, self.slots[place], -1)


class _Ahead:
    def __init__(self, free: np.ndarray) -> None:
        self.free, self.i = free, -1

    def next(self) -> int:
        self.i += 1
        return int(self.free[self.i])


def _bytes_alphabet() -> dict[str, int]:
    """The byte of each printable stand-in character of the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """The encoder of one vocabulary file in the ``tokenizers`` JSON layout (byte-level BPE, no normaliser)."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.path, back = path, _bytes_alphabet()
        vocabulary = {bytes(back[c] for c in t): i for t, i in model["vocab"].items() if all(c in back for c in t)}
        self.byte = np.array([vocabulary[bytes([b])] for b in range(256)], np.int32)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        ids = model["vocab"]
        self.left = np.array([ids[a] for a, _ in pairs], np.int32)
        right = np.array([ids[b] for _, b in pairs], np.int32)
        self.made = np.array([ids[a + b] for a, b in pairs], np.int32)
        self.pairs = PerfectHash(self._pair(self.left, right))
        self._ranks: dict[tuple[int, int], int] | None = None
        self.right = right
        # only entries whose own merging ends in themselves may be resolved whole
        short = [(t, i) for t, i in vocabulary.items() if len(t) <= SHORT]
        w0, w1, n = _words([t for t, _ in short])
        flat, counts = self._lockstep(w0, w1, n)
        starts = np.cumsum(counts) - counts
        own = np.array([i for _, i in short], np.int32)
        whole = (counts == 1) & (flat[starts] == own)
        self.words, self.word_ids = PerfectHash(key_of(w0, w1, n)[whole]), own[whole]
        self.word_w0, self.word_w1, self.word_n = w0[whole], w1[whole], n[whole]
        self.classes: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"classes": None, "_ranks": None}

    @staticmethod
    def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        r = self.pairs.find(self._pair(a, b))
        return np.where(r < 0, NONE, r).astype(np.int32)

    def _lockstep(self, w0: np.ndarray, w1: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of strings of at most 16 bytes, one after another, and how many each has."""
        m, wide = len(n), SHORT + 1
        raw = np.empty((m, SHORT), np.uint8)
        raw[:, :8], raw[:, 8:] = np.ascontiguousarray(w0).view(np.uint8).reshape(m, 8), np.ascontiguousarray(w1).view(np.uint8).reshape(m, 8)
        ids = self.byte[raw]
        column = np.arange(SHORT)
        rank = np.full((m, wide), NONE, np.int32)
        rows, at = np.nonzero(column[None, :-1] < (n[:, None] - 1))
        rank[rows, at] = self._rank(ids[rows, at], ids[rows, at + 1])
        after = np.tile(np.arange(1, wide + 1, dtype=np.int8), (m, 1))
        before = np.tile(np.arange(-1, wide - 1, dtype=np.int8), (m, 1))
        alive = column[None, :] < n[:, None]
        live = np.arange(m)
        while len(live):
            p = rank[live].argmin(axis=1)
            best = rank[live, p]
            go = best < NONE
            live, p, best = live[go], p[go], best[go]
            if not len(live):
                break
            q = after[live, p].astype(np.int64)
            ids[live, p] = self.made[best]
            alive[live, q] = False
            rank[live, q] = NONE
            nx = after[live, q].astype(np.int64)
            after[live, p] = nx
            inside = nx < n[live]
            before[live[inside], nx[inside]] = p[inside]
            rank[live, p] = NONE
            i, a, b = live[inside], p[inside], nx[inside]
            rank[i, a] = self._rank(ids[i, a], ids[i, b])
            pv = before[live, p].astype(np.int64)
            has = pv >= 0
            i, a, b = live[has], pv[has], p[has]
            rank[i, a] = self._rank(ids[i, a], ids[i, b])
        return ids[alive], alive.sum(axis=1)

    def heap(self, raw: bytes) -> list[int]:
        """Ids of one string: a heap of pair ranks over a linked list of its bytes."""
        if self._ranks is None:
            self._ranks = {(int(a), int(b)): r for r, (a, b) in enumerate(zip(self.left, self.right, strict=True))}
        ranks, n = self._ranks, len(raw)
        ids = self.byte[np.frombuffer(raw, np.uint8)].tolist()
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        queue = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := ranks.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(queue)
        while queue:
            r, i, a, b = heapq.heappop(queue)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue  # one of its ends has been merged since
            ids[i], ids[j] = int(self.made[r]), -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (s := ranks.get((ids[i], ids[k]))) is not None:
                    heapq.heappush(queue, (s, i, ids[i], ids[k]))
            h = before[i]
            if h >= 0 and (s := ranks.get((ids[h], ids[i]))) is not None:
                heapq.heappush(queue, (s, h, ids[h], ids[i]))
        return [x for x in ids if x >= 0]

    def _class_of(self, points: np.ndarray) -> np.ndarray:
        if self.classes is None:
            kind = {"L": LETTER, "N": NUMBER}
            self.classes = np.array([UNKNOWN if (c := unicodedata.category(chr(i))) == "Cn" else kind.get(c[0], OTHER) for i in range(0x110000)], np.uint8)
            self.classes[WHITE] = SPACE
        got = self.classes[points]
        if (got == UNKNOWN).any():
            self._resolve(np.unique(points[got == UNKNOWN]))
            got = self.classes[points]
        return got

    def _resolve(self, points: np.ndarray) -> None:
        """Classes of characters newer than this Python: the library's own pre-tokeniser is asked."""
        from tokenizers import Tokenizer

        split = Tokenizer.from_file(self.path).pre_tokenizer.pre_tokenize_str
        for i in points.tolist():
            c = chr(i)
            self.classes[i] = LETTER if len(split(f"a{c}a")) == 1 else NUMBER if len(split(f"1{c}1")) == 1 else OTHER

    def _starts(self, points: np.ndarray, first: np.ndarray) -> np.ndarray:
        """True where a pre-token starts; first: where a text starts."""
        n, kind = len(points), self._class_of(points)
        space, blank = kind == SPACE, points == 32
        change = np.empty(n, bool)
        change[0] = True
        np.not_equal(kind[1:], kind[:-1], out=change[1:])
        change |= first
        start = change.copy()
        # the last white space before a visible character stands alone, or, if it is a blank, leads that character's pre-token
        lead = np.flatnonzero(change[1:] & ~first[1:] & space[:-1]) + 1
        start[lead - 1] = True
        start[lead] = ~blank[lead - 1]
        quote = np.flatnonzero((points == 39) & start)
        if len(quote):
            pad = np.concatenate([points, np.zeros(3, points.dtype)])
            ends = np.concatenate([first, np.ones(3, bool)])
            for tail in CONTRACTIONS:
                hit = np.ones(len(quote), bool)
                for k, c in enumerate(tail, 1):
                    hit &= (pad[quote + k] == ord(c)) & ~ends[quote + k]
                at = quote[hit]
                start[at + 1] = False
                beyond = at[at + len(tail) + 1 < n] + len(tail) + 1
                start[beyond] = True if not len(beyond) else start[beyond] | (kind[beyond] == LETTER)
        return start

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and each text's number of ids; null and empty texts have none."""
        texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
        n = len(texts)
        if n == 0:
            return np.empty(0, np.int32), np.empty(0, np.int64)
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
        size = offsets[1:] - offsets[:-1]
        if texts.null_count:
            size = np.where(np.asarray(texts.is_valid()), size, 0)
        data = texts.buffers()[2]
        data = memoryview(data) if data is not None else memoryview(b"")
        ids, counts, i = [], np.zeros(n, np.int64), 0
        while i < n:
            j, total = i, 0
            while j < n and (j == i or total + size[j] <= SLICE_BYTES):
                total += int(size[j])
                j += 1
            if total > SLICE_BYTES:  # one long text, in pieces that end where a pre-token does
                for piece in _pieces(bytes(data[offsets[i] : offsets[j]])):
                    got, n_ids = self._encode(piece, np.array([len(piece)]))
                    ids.append(got)
                    counts[i] += n_ids[0]
                i = j
                continue
            raw = bytes(data[offsets[i] : offsets[j]]) if total == offsets[j] - offsets[i] else b"".join(bytes(data[offsets[k] : offsets[k] + size[k]]) for k in range(i, j))
            if total:
                got, counts[i:j] = self._encode(raw, size[i:j])
                ids.append(got)
            i = j
        return np.concatenate(ids) if ids else np.empty(0, np.int32), counts

    def _encode(self, raw: bytes, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
        width = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000) if len(points) < len(raw) else np.ones(len(points), np.int64)
        place = np.cumsum(width) - width
        begin = np.cumsum(size) - size
        first = np.zeros(len(points), bool)
        first[np.searchsorted(place, begin[size > 0])] = True
        at = place[self._starts(points, first)]
        n = np.diff(np.append(at, len(raw)))
        buffer = np.frombuffer(raw + bytes(SHORT), np.uint8)
        window = np.ndarray(len(raw) + 8, "<u8", buffer, 0, (1,))
        mask = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
        w0 = window[at] & mask[np.minimum(n, 8)]
        w1 = np.where(n > 8, window[np.minimum(at + 8, len(raw))] & mask[np.clip(n - 8, 0, 8)], 0).astype(np.uint64)
        key = key_of(w0, w1, n)
        found = self.words.find(key)
        found[(n > SHORT) | (self.word_w0[found] != w0) | (self.word_w1[found] != w1) | (self.word_n[found] != n)] = -1
        miss = np.flatnonzero(found < 0)
        held = np.ones(len(at), np.int64)
        own = np.zeros(len(at), np.int64)  # where the ids of a miss begin in flat
        short = miss[n[miss] <= SHORT]
        _, one, which = np.unique(key[short], return_index=True, return_inverse=True)
        if len(short) and ((w0[short][one][which] != w0[short]) | (w1[short][one][which] != w1[short])).any():
            one, which = np.arange(len(short)), np.arange(len(short))  # two strings with one key: encode each
        pick = short[one]
        flat, counts = self._lockstep(w0[pick], w1[pick], n[pick])
        base = np.cumsum(counts) - counts
        held[short], own[short] = counts[which], base[which]
        seen: dict[bytes, tuple[int, int]] = {}
        more: list[int] = []
        for m in miss[n[miss] > SHORT].tolist():
            word = raw[at[m] : at[m] + n[m]]
            if word not in seen:
                got = self.heap(word)
                seen[word] = len(flat) + len(more), len(got)
                more += got
            own[m], held[m] = seen[word]
        flat = np.concatenate([flat, np.array(more, np.int32)])
        ends = np.cumsum(held)
        ids = np.empty(ends[-1] if len(ends) else 0, np.int32)
        hit = found >= 0
        ids[ends[hit] - 1] = self.word_ids[found[hit]]
        k = held[miss]
        into = np.repeat(ends[miss] - k - (np.cumsum(k) - k), k) + np.arange(k.sum())
        ids[into] = flat[np.repeat(own[miss] - (np.cumsum(k) - k), k) + np.arange(k.sum())]
        reach = np.concatenate([[0], ends])
        edge = reach[np.searchsorted(at, np.append(begin, len(raw)))]
        return ids, np.diff(edge)


def _pieces(raw: bytes, size: int | None = None) -> Iterator[bytes]:
    """A text in pieces of about ``size`` bytes, cut between a letter and a blank that a letter follows: a pre-token always starts there."""
    size, begin = size or SLICE_BYTES, 0
    while begin < len(raw):
        cut = WORD_GAP.search(raw, begin + size)
        end = cut.start() + 1 if cut else len(raw)
        yield raw[begin:end]
        begin = end


def _words(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(t.ljust(SHORT, b"\0") for t in tokens), "<u8").reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy(), np.array([len(t) for t in tokens], np.int64)
