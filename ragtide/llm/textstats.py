"""Partial text statistics of chunks, computed over whole Arrow batches, and their associative merge.

A chunk comes with a little context on either side, by which a word, a gap or a sentence end on its edge is
counted once, by the chunk it starts in. Its statistics are sums over its closed lines and the two lines that it
leaves open, at its head and its tail; an open line keeps, beside its sums, the boundary state: its first and its
last visible characters. Merging two neighbours joins the left one's tail with the right one's head and closes the
line when it is complete. Any grouping of the merges gives the same result.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass, field
from functools import cache

import numpy as np

#: Sums kept for every line.
SUMS = ["chars", "visible", "letters", "digits", "symbols", "words", "word_chars", "common", "repeats", "capitals", "bars", "tabs", "gaps", "equals", "tags", "broken", "mangled", "stops", "commas", "tokens", "leaders", "vowels", "semicolons", "dots", "rough", "humps", "mixed"]
#: Sums kept for every closed line.
LINES = ["lines", "ended", "bullets", "rows", "brief", "leading", "commas2", "semicolons2"]
ALL = SUMS + LINES
S = {name: i for i, name in enumerate(ALL)}
EDGE = 40  # a word longer than this is neither a common nor a repeated word
CONTEXT = 64  # characters on either side of a chunk that show what its edge words and blanks belong to
HEAD = 12  # visible characters that show a list mark
BACK = 3  # visible characters that show how a line ends
NEWLINES = (10, 13, 0x85, 0x2028, 0x2029)
#: Characters that end a sentence, also before closing quotes.
STOPS = ".!?…。！？:"
CLOSERS = "\"'”’»)]*_"
#: Marks that running text seldom has.
ROUGH = "^~|\\{}[]<>@#$%+=*_"
VOWELS = "aeiouyáéíóúàèùâêîôûäöüëïœæ"
SPACE, LETTER, DIGIT, MARK, SYMBOL = range(5)
#: Codes of the characters that are counted one by one.
MARKS = {name: i for i, name in enumerate(("bars", "tabs", "equals", "tags", "commas", "semicolons", "dots", "ellipsis", "stop", "other", "broken", "mangled"), 1)}


@cache
def characters() -> dict[str, np.ndarray]:
    """The lookup tables by code point; built once in a worker, whatever tasks it runs."""
    kind, low, flag = np.full(0x110000, SYMBOL, np.uint8), np.arange(0x110000, dtype=np.uint32), np.zeros(0x110000, np.uint8)
    classes = {"L": LETTER, "N": DIGIT, "M": MARK, "Z": SPACE}
    for i in range(0x30000):
        c = chr(i)
        k = unicodedata.category(c)
        kind[i] = classes.get(k[0], SYMBOL)
        if k[0] == "L":
            lower = c.lower()
            low[i] = ord(lower) if len(lower) == 1 else i
            flag[i] = lower != c
        elif k in ("Cf",):
            kind[i] = MARK
    kind[[9, 10, 11, 12, 13, 0x85]] = SPACE
    broken = np.zeros(0x110000, bool)
    broken[0x2500:0x2600] = broken[0xE000:0xF900] = broken[0x80:0xA0] = broken[0:9] = broken[14:32] = True
    broken[0xFFFD] = True
    mangled = np.zeros(0x110000, bool)
    mangled[[0xC3, 0xC2, 0xE2, 0x20AC, 0xEF, 0xBF, 0xBD, 0x153, 0x2122]] = True
    vowels = np.zeros(0x110000, bool)
    vowels[[ord(c) for c in VOWELS]] = True
    newline = np.zeros(0x110000, bool)
    newline[list(NEWLINES)] = True
    # one lookup by character: its kind, whether it is a vowel, whether upper case; and one of the marks that are counted
    code = kind | (vowels[low].astype(np.uint8) << 3) | (flag << 4)
    mark = np.zeros(0x110000, np.uint8)
    mark[[ord(c) for c in ROUGH]] = MARKS["other"]
    for name, c in (("bars", "|"), ("tabs", "\t"), ("equals", "="), ("tags", "<"), ("commas", ","), ("semicolons", ";"), ("dots", "."), ("ellipsis", "…"), ("stop", "!?")):
        mark[[ord(x) for x in c]] = MARKS[name]
    mark[broken & ~newline & (mark == 0)] = MARKS["broken"]
    mark[mangled & (mark == 0)] = MARKS["mangled"]
    rng = np.random.default_rng(7)
    power = rng.integers(1, 2**63, EDGE + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return {"kind": kind, "low": low, "newline": newline, "code": code, "mark": mark, "power": power}


class Tables:
    """Lookup tables by code point, and the hashes of the common words."""

    def __init__(self, common: list[str]) -> None:
        self.common_words = frozenset(w.lower() for w in common if w)
        self.kind: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return {"common_words": self.common_words, "kind": None}

    def build(self) -> None:
        if self.kind is not None:
            return
        self.__dict__ |= characters()
        self.common = np.sort(np.array([self.hash(w) for w in self.common_words if len(w) <= EDGE] or [0], np.uint64))

    def hash(self, word: str) -> int:
        return sum(int(self.low[ord(c)]) * int(p) for c, p in zip(word, self.power, strict=False)) % 2**64


@dataclass
class Line:
    """An open line: its sums, its first and its last visible characters."""

    sums: np.ndarray
    head: str = ""
    last: str = ""

    def join(self, o: Line) -> Line:
        return Line(self.sums + o.sums, (self.head + o.head)[:HEAD], (self.last + o.last)[-BACK:])

    def closed(self) -> np.ndarray:
        """Its sums with those of a closed line."""
        sums = self.sums.copy()
        n = {name: int(sums[S[name]]) for name in ("visible", "words", "bars", "tabs", "gaps", "equals", "tags", "leaders")}
        if n["visible"] == 0:
            return sums
        sums[S["lines"]] += 1
        last = self.last
        while len(last) > 1 and last[-1] in CLOSERS and len(self.last) - len(last) < 2:
            last = last[:-1]
        sums[S["ended"]] += last[-1] in STOPS
        sums[S["bullets"]] += is_bullet(self.head)
        sums[S["rows"]] += n["bars"] >= 2 or n["tabs"] >= 1 or n["gaps"] >= 1 or n["equals"] >= 2 or n["tags"] >= 2
        sums[S["brief"]] += n["words"] <= 6
        sums[S["leading"]] += n["leaders"] >= 1
        for name in ("commas", "semicolons"):
            sums[S[name + "2"]] += sums[S[name]] ** 2
        return sums


def is_bullet(head: str) -> bool:
    """Whether a line's first visible characters (blanks left out) are a list mark."""
    if not head:
        return False
    if head[0] in "*•·‣▪◦–—-+" and len(head) > 1 and not (head[1].isdigit() and head[0] in "-+"):
        return True
    body = head.lstrip("[(")
    k = 0
    while k < len(body) and k < 4 and body[k].isdigit():
        k += 1
    return k > 0 and k + 1 < len(body) and body[k] in ".)]" and not (body[k] == "." and body[k + 1].isdigit() and k == 1 and body[0] == "0")


@dataclass
class Part:
    """Statistics of a run of text: sums over its closed lines, and its open lines; ``single``: one line and no newline."""

    sums: np.ndarray = field(default_factory=lambda: np.zeros(len(ALL), np.int64))
    head: Line | None = None
    tail: Line | None = None
    single: bool = True

    def join(self, o: Part) -> Part:
        """The statistics of this run followed by ``o``; associative, with Part() as its unit."""
        if self.head is None:
            return o
        if o.head is None:
            return self
        seam = self.tail.join(o.head)
        if self.single and o.single:
            return Part(self.sums + o.sums, seam, seam, True)
        if self.single:
            return Part(o.sums, seam, o.tail, False)
        if o.single:
            return Part(self.sums, self.head, seam, False)
        return Part(self.sums + o.sums + seam.closed(), self.head, o.tail, False)

    def total(self) -> np.ndarray:
        if self.head is None:
            return self.sums
        return self.sums + self.head.closed() + (0 if self.single else self.tail.closed())


def measure(values: list[str | None], tables: Tables, before: list[int] | None = None, after: list[int] | None = None) -> tuple[np.ndarray, list[Part | None]]:
    """A row of ALL for each text; null and empty texts have a row of zeros.

    With before and after, the texts are chunks with so many characters of context on either side (at most
    CONTEXT, and as many as there are); then the second result has each chunk's Part.
    """
    tables.build()
    n = len(values)
    out, parts, i = np.zeros((n, len(ALL)), np.int64), [None] * n, 0
    while i < n:
        j, size = i, 0
        while j < n and (j == i or size + len(values[j] or "") <= 1 << 21):
            size += len(values[j] or "")
            j += 1
        if size:
            _measure(values[i:j], tables, out[i:j], parts, i, before and before[i:j], after and after[i:j])
        i = j
    return out, parts


def _measure(values: list[str | None], t: Tables, out: np.ndarray, parts: list, base: int, before: list[int] | None, after: list[int] | None) -> None:
    own = [k for k, v in enumerate(values) if v]
    text = "".join(values[k] for k in own)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(points)
    sizes = np.array([len(values[k]) for k in own])
    begin = np.cumsum(sizes) - sizes
    code = t.code[points]
    kind, upper = code & 7, code > 15
    newline = t.newline[points]
    first = np.zeros(n, bool)
    first[begin] = True
    # lines: a line starts at a text's start and after each newline
    line_start = first.copy()
    line_start[1:] |= newline[:-1]
    line_at = np.flatnonzero(line_start)
    line_of = np.cumsum(line_start) - 1
    m = len(line_at)
    core = np.ones(n, bool)  # what is counted, without the context
    for k, o in enumerate(own if before is not None else ()):
        core[begin[k] : begin[k] + before[o]] = core[begin[k] + sizes[k] - after[o] : begin[k] + sizes[k]] = False
    inner_only = before is not None

    def per_line(at: np.ndarray) -> np.ndarray:
        return np.bincount(line_of[at[core[at]] if inner_only else at], minlength=m)

    def by_code(at: np.ndarray | slice, codes: np.ndarray, width: int) -> np.ndarray:
        return np.bincount(line_of[at] * width + codes, minlength=m * width).reshape(m, width)

    space = kind == SPACE
    wordy = (kind == LETTER) | (kind == DIGIT) | (kind == MARK)
    quote = (points == 39) | (points == 0x2019)
    inner = quote[1:-1] & wordy[:-2] & wordy[2:] & ~line_start[1:-1] & ~line_start[2:]
    wordy[1:-1] |= inner
    start = wordy & np.concatenate([[True], ~wordy[:-1] | line_start[1:]])
    word_at = np.flatnonzero(start)
    end = wordy & np.concatenate([~wordy[1:] | line_start[1:], [True]])
    word_end = np.flatnonzero(end) + 1
    length = word_end - word_at
    low = t.low[points]
    word_of = np.cumsum(start) - 1
    spot = np.flatnonzero(wordy)
    place = spot - word_at[word_of[spot]]
    value = np.where(place < EDGE, low[spot].astype(np.uint64) * t.power[np.minimum(place, EDGE)], 0)
    hashes = np.add.reduceat(value, np.flatnonzero(place == 0)) if len(word_at) else np.empty(0, np.uint64)
    short = length <= EDGE
    found = np.searchsorted(t.common, hashes)
    common = short & (t.common[np.minimum(found, len(t.common) - 1)] == hashes)
    repeat = np.zeros(len(word_at), bool)
    if len(word_at) > 1:
        repeat[1:] = (hashes[1:] == hashes[:-1]) & (length[1:] == length[:-1]) & short[1:] & (word_at[1:] - word_end[:-1] <= 8) & (line_of[word_at[1:]] == line_of[word_at[:-1]])
    visible = ~space
    sums = np.zeros((m, len(ALL)), np.int64)

    def put(name: str, got: np.ndarray) -> None:
        sums[:, S[name]] = got

    kinds = by_code(core, code[core], 32) if inner_only else by_code(slice(None), code, 32)
    each = {k: kinds[:, [c for c in range(32) if c & 7 == k]].sum(axis=1) for k in (SPACE, LETTER, DIGIT, MARK, SYMBOL)}
    put("chars", kinds.sum(axis=1))
    put("visible", kinds.sum(axis=1) - each[SPACE])
    put("letters", each[LETTER])
    put("digits", each[DIGIT])
    put("symbols", each[SYMBOL] - per_line(np.flatnonzero(inner) + 1 if n > 2 else np.empty(0, np.int64)))
    put("vowels", kinds[:, [c for c in range(32) if c & 8]].sum(axis=1))
    marks = t.mark[points]
    marked = np.flatnonzero(marks)
    counted = marked[core[marked]] if inner_only else marked
    shown = by_code(counted, marks[counted], 16)
    for name in ("bars", "tabs", "equals", "tags", "commas", "semicolons", "dots", "broken", "mangled"):
        put(name, shown[:, MARKS[name]])
    put("rough", shown[:, [MARKS[x] for x in ("bars", "equals", "tags", "other")]].sum(axis=1))
    put("words", per_line(word_at))
    put("word_chars", per_line(spot))
    put("common", per_line(word_at[common]))
    put("repeats", per_line(word_at[repeat]))
    put("capitals", per_line(word_at[upper[word_at]]))
    joined = np.concatenate([[False], ~line_start[1:]])
    left = np.concatenate([[SPACE], kind[:-1]])
    small = (kind == LETTER) & ~upper
    put("humps", per_line(np.flatnonzero(joined & upper & np.concatenate([[False], small[:-1]]))))
    put("mixed", per_line(np.flatnonzero(joined & ((kind == LETTER) & (left == DIGIT) | (kind == DIGIT) & (left == LETTER)))))
    # visible runs, and gaps of three blanks or more before one that does not begin its line
    token_at = np.flatnonzero(visible & np.concatenate([[True], space[:-1] | line_start[1:]]))
    put("tokens", per_line(token_at))
    shown_at = np.flatnonzero(visible)
    previous = np.concatenate([[-1], shown_at])[np.searchsorted(shown_at, token_at)]
    bound = np.maximum(np.maximum(previous + 1, line_at[line_of[token_at]]), token_at - CONTEXT)
    inside = (bound == previous + 1) & (line_at[line_of[token_at]] <= previous) | (bound > line_at[line_of[token_at]])
    if before is not None:  # where the context ends, the line goes on to the left
        cut = np.zeros(n, bool)
        cut[begin[[k for k, o in enumerate(own) if before[o]]]] = True
        inside |= cut[bound]
    put("gaps", per_line(token_at[inside & (token_at - bound >= 3)]))
    # a sentence ends where a stop follows a word character and a blank or the line's end follows
    stop = marked[(marks[marked] == MARKS["dots"]) | (marks[marked] == MARKS["stop"])]
    behind, ahead = np.maximum(stop - 1, 0), np.minimum(stop + 1, n - 1)
    put("stops", per_line(stop[(stop > 0) & wordy[behind] & ((stop == n - 1) | space[ahead] | line_start[ahead])]))
    dots = marked[(marks[marked] == MARKS["dots"]) | (marks[marked] == MARKS["ellipsis"])]
    row = np.zeros(len(dots), bool)  # the fourth dot of a row and those behind it
    row[3:] = (dots[3:] - dots[:-3] == 3) & (line_of[dots[3:]] == line_of[dots[:-3]])
    first_of = row & ~np.concatenate([[False], row[:-1] & (np.diff(dots) == 1)]) if len(dots) else row
    put("leaders", per_line(dots[first_of]))
    line_text = np.searchsorted(begin, line_at, side="right") - 1
    seen = np.flatnonzero(visible & core) if inner_only else np.flatnonzero(visible)
    seen_line = line_of[seen]
    line_first, line_end = (np.searchsorted(seen_line, np.arange(m), side=side) for side in ("left", "right"))
    has = sums[:, S["visible"]] > 0
    is_open = np.zeros(m, bool)
    if before is not None:
        inner_lines = np.flatnonzero(np.bincount(line_of[core], minlength=m))
        head_line = {k: int(inner_lines[np.searchsorted(line_text[inner_lines], k)]) for k in range(len(own)) if sizes[k] > before[own[k]] + after[own[k]]}
        tail_line = {k: int(inner_lines[np.searchsorted(line_text[inner_lines], k, side="right") - 1]) for k in head_line}
        is_open[[*head_line.values(), *tail_line.values()]] = True
    if len(seen):
        last_seen = line_end - 1
        closers, stops = [ord(c) for c in CLOSERS], [ord(c) for c in STOPS]
        last_point = points[seen[np.maximum(last_seen, 0)]]
        for _ in range(2):  # look behind closing quotes
            back = has & np.isin(last_point, closers) & (last_seen > line_first)
            last_seen = last_seen - back
            last_point = points[seen[np.maximum(last_seen, 0)]]
        close = has & ~is_open
        sums[close, S["lines"]] = 1
        sums[:, S["ended"]] = close & np.isin(last_point, stops)
        sums[:, S["brief"]] = close & (sums[:, S["words"]] <= 6)
        sums[:, S["leading"]] = close & (sums[:, S["leaders"]] >= 1)
        rows = (sums[:, S["bars"]] >= 2) | (sums[:, S["tabs"]] >= 1) | (sums[:, S["gaps"]] >= 1) | (sums[:, S["equals"]] >= 2) | (sums[:, S["tags"]] >= 2)
        sums[:, S["rows"]] = close & rows
        for name in ("commas", "semicolons"):
            sums[:, S[name + "2"]] = close * sums[:, S[name]] ** 2
        # only lines that begin with a symbol or a digit can have a list mark
        for k in np.flatnonzero(close)[np.isin(kind[seen[line_first[close]]], (SYMBOL, DIGIT))]:
            sums[k, S["bullets"]] = is_bullet("".join(map(chr, points[seen[line_first[k] : min(line_first[k] + HEAD, line_end[k])]].tolist())))
    np.add.at(out, np.array(own)[line_text[~is_open]], sums[~is_open])
    if before is None:
        return

    def line(k: int) -> Line:
        shown = seen[line_first[k] : line_end[k]]
        return Line(sums[k].copy(), "".join(chr(points[c]) for c in shown[:HEAD]), "".join(chr(points[c]) for c in shown[-BACK:]))

    for k, a in head_line.items():
        o, b = own[k], tail_line[k]
        ends = bool(newline[begin[k] + sizes[k] - after[o] - 1])  # the last line is complete; what follows is a new one
        if ends and a == b:
            parts[base + o] = Part(out[o].copy(), line(a), Line(np.zeros(len(ALL), np.int64)), False)
        elif ends:
            parts[base + o] = Part(out[o] + line(b).closed(), line(a), Line(np.zeros(len(ALL), np.int64)), False)
        else:
            head = line(a)
            parts[base + o] = Part(out[o].copy(), head, head if a == b else line(b), a == b)
