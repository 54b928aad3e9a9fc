"""Operator 9, personal data: base patterns, and a linear-chain conditional random field over word shapes.

The field is trained on a small labelled table made by rule below, by gradient descent on the exact likelihood
(forward and backward sums in numpy).  Its features are shapes of a word and its neighbours alone, so it knows no
name or number; a handful of words that spell marks or lead to numbers (``SPELLED``) have shapes of their own.

Every word of every text is decoded.  A block of texts is cut into words, shapes and hashed features in numpy at once; long
texts are decoded in windows of ``CORE`` words that overlap by ``MARGIN`` words at both sides, of which only the core's labels
are taken, and windows of like length go through Viterbi together.  Found spans are kept where they have the parts
their kind can't be without and no base span touches them.

Defined results: a null text is empty; an empty text has no span; whole texts are read, however long; each row is
read, repeated rows alike; a null doc_id passes; other columns don't matter; an empty table gives no rows; two spans
that start together are ordered by kind, as in ``KINDS``.
"""

from __future__ import annotations

import functools
import random
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from haloforge.llm.arrow import keyed_texts, text_blocks
from haloforge.llm.words import mix

KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = ord(c) - 48
        total += x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """As the pattern finds them from left to right, but from each @ outwards: no long word is tried at every place."""
    free, at = 0, text.find("@")
    while at >= 0:
        found = _DOMAIN.match(text, at + 1)
        begin = at
        while found and begin > free and text[begin - 1] in _LOCAL:
            begin -= 1
        if found and begin < at:
            yield begin, found.end()
            free = found.end()
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, ascending."""
    out = [(a, 0, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split("."))]
        for m in _CARD.finditer(text):
            if 14 <= m.end() - m.start() and 14 <= len(d := "".join(c for c in m.group() if c in "0123456789")) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= sum(c in "0123456789" for c in m.group()) <= 15]
    return sorted(out)


# The field ----------------------------------------------------------------------------------------------------------

#: Labels: 0 outside, then begin and inside of each kind.
N_LABELS = 1 + 2 * len(KINDS)
BUCKETS = 1 << 15
#: Words a window decodes, and those it reads besides at both sides.
CORE, MARGIN = 256, 32
#: Words with a shape of their own.
SPELLED = ("at", "dot", "com", "org", "net", "tel", "fax")
_WHITE, _LOWER, _UPPER, _NUMBER, _MARK = range(5)
#: Shapes: three cases of letters, each short or long; a number's digits up to 20; the spelled words; ASCII marks; all other marks.
_DIGITS_AT, _SPELLED_AT, _MARKS_AT = 6, 26, 26 + len(SPELLED)
_OTHER_MARK = _MARKS_AT + 128
_N_SHAPES = _OTHER_MARK + 1
_BEFORE, _AFTER = 2 * _N_SHAPES, 2 * _N_SHAPES + 1
#: Feature templates: places, relative to a word, whose shapes it joins.
TEMPLATES = ((0,), (-1,), (1,), (-2, -1), (1, 2), (-1, 0), (0, 1), (-1, 0, 1), (-2, -1, 0), (0, 1, 2))


@functools.cache
def _classes() -> np.ndarray:
    """The class of each code point of the first three planes; letters further on count as marks."""
    out = np.full(0x30000, _MARK, dtype=np.uint8)
    for k in range(len(out)):
        c = chr(k)
        if c.isspace():
            out[k] = _WHITE
        elif c.isalpha():
            out[k] = _UPPER if c.isupper() else _LOWER
    out[0x30:0x3A] = _NUMBER
    return out


def _packed(words: list[np.ndarray]) -> np.ndarray:
    """Up to three code points as one number."""
    return sum(w.astype(np.int64) << (21 * k) for k, w in enumerate(words))


def tokenize(texts: list[str]) -> tuple[np.ndarray, ...]:
    """(first, start, end, shape) of all words, numbers and marks of all texts: where each text's begin (one more entry than
    texts), code points within the text, and twice the shape, plus one where white space stands before it."""
    points = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    kind = np.full(len(points) + 2, _WHITE, dtype=np.uint8)
    known = _classes()
    kind[1:-1] = np.where(points < len(known), known[np.minimum(points, len(known) - 1)], _MARK)
    group = np.where(kind == _UPPER, _LOWER, kind)
    starts = np.flatnonzero((group[1:-1] != _WHITE) & ((group[1:-1] == _MARK) | (group[1:-1] != group[:-2])))
    stops = np.flatnonzero((group[1:-1] != _WHITE) & ((group[1:-1] == _MARK) | (group[1:-1] != group[2:]))) + 1
    size, own = stops - starts, group[1 + starts]
    upper = np.concatenate([[0], np.cumsum(kind[1:-1] == _UPPER)])
    n_upper = upper[stops] - upper[starts]
    shape = np.where(n_upper == size, 2, (kind[1 + starts] == _UPPER).astype(np.int64)) * 2 + (size < 4)
    shape[own == _NUMBER] = _DIGITS_AT - 1 + np.minimum(size[own == _NUMBER], 20)
    marks = own == _MARK
    shape[marks] = np.where(points[starts[marks]] < 128, _MARKS_AT + points[starts[marks]].astype(np.int64), _OTHER_MARK)
    few = np.flatnonzero((own == _LOWER) & (size <= 3))
    letter = [np.where(size[few] > k, points[np.minimum(starts[few] + k, len(points) - 1)], 0) for k in range(3)]
    code = _packed([np.where((x >= 65) & (x <= 90), x + 32, x) for x in letter])
    for k, word in enumerate(SPELLED):
        shape[few[code == _packed([np.array(ord(c)) for c in word])]] = _SPELLED_AT + k
    gap = np.ones(len(starts), dtype=np.int64)
    gap[1:] = starts[1:] > stops[:-1]
    begin = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1)])
    first = np.searchsorted(starts, begin)
    shift = np.repeat(begin[:-1], np.diff(first))
    return first, starts - shift, stops - shift, 2 * shape + gap


def _features(first: np.ndarray, shape: np.ndarray) -> Iterator[np.ndarray]:
    """Hashed places of each template's feature, for each word; beyond a text's ends are two shapes of their own."""
    n = len(shape)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    near = {0: shape.astype(np.uint64)}
    for k in (-2, -1, 1, 2):
        at = np.arange(n) + k
        inside = (at >= 0) & (at < n)
        at = np.clip(at, 0, max(n - 1, 0))
        near[k] = np.where(inside & (text[at] == text), shape[at], _BEFORE if k < 0 else _AFTER).astype(np.uint64)
    for number, places in enumerate(TEMPLATES):
        code = np.full(n, np.uint64(number))
        for k in places:
            code = code * np.uint64(_AFTER + 1) + near[k]
        yield (mix(code) >> np.uint64(64 - 15)).astype(np.int32)


class Crf:
    def __init__(self):
        self.emit = np.zeros((BUCKETS, N_LABELS))
        self.move = np.zeros((N_LABELS, N_LABELS))
        self.first = np.zeros(N_LABELS)
        inside = np.arange(2, N_LABELS, 2)
        self.ban = np.zeros((N_LABELS, N_LABELS))
        self.ban[:, inside] = -1e4
        for k in inside:
            self.ban[[k - 1, k], k] = 0.0
        self.ban_first = np.zeros(N_LABELS)
        self.ban_first[inside] = -1e4

    def gradient(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> tuple[list[np.ndarray], float]:
        """Of the log-likelihood of rows (features [words, templates], labels), and the log-likelihood.  Shorter rows are
        padded; a padded place adds nothing."""
        sizes = np.array([len(y) for _, y in rows])
        b, t = len(rows), int(sizes.max())
        live = np.arange(t) < sizes[:, None]
        at = np.zeros((b, t, rows[0][0].shape[1]), dtype=np.int64)
        gold = np.zeros((b, t), dtype=np.int64)
        for k, (x, y) in enumerate(rows):
            at[k, : len(y)], gold[k, : len(y)] = x, y
        score, move = self.emit[at].sum(axis=2), self.move + self.ban
        top = score.max(axis=2)
        own, ways = np.exp(score - top[:, :, None]), np.exp(move)
        # Forward and backward sums, each place's scaled to one; the scales' logarithms add up to the whole sum's.
        alpha, beta, scale = np.empty(score.shape), np.ones(score.shape), np.ones(score.shape[:2])
        step = own[:, 0] * np.exp(self.first + self.ban_first)
        for k in range(t):
            if k:
                step = (alpha[:, k - 1] @ ways) * own[:, k]
                step[~live[:, k]] = alpha[~live[:, k], k - 1]
            scale[:, k] = step.sum(axis=1)
            alpha[:, k] = step / scale[:, k, None]
        right = own / scale[:, :, None]
        for k in range(t - 2, -1, -1):
            beta[:, k] = (right[:, k + 1] * beta[:, k + 1]) @ ways.T
            beta[~live[:, k + 1], k] = 1.0
        total = (np.log(scale) + top * live).sum()
        each = -alpha * beta
        each[np.arange(b)[:, None], np.arange(t), gold] += 1.0
        each *= live[:, :, None]
        g_emit = np.stack([np.bincount(at.ravel(), np.repeat(each[:, :, y].ravel(), at.shape[2]), minlength=len(self.emit)) for y in range(N_LABELS)], axis=1)
        both = live[:, 1:]
        g_move = -ways * (alpha[:, :-1][both].T @ (right * beta)[:, 1:][both])
        np.add.at(g_move, (gold[:, :-1][both], gold[:, 1:][both]), 1.0)
        path = (score[np.arange(b)[:, None], np.arange(t), gold] * live).sum() + self.first[gold[:, 0]].sum() + move[gold[:, :-1][both], gold[:, 1:][both]].sum()
        return [g_emit, g_move, each[:, 0].sum(axis=0)], float(path - total)

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], epochs: int = 8, batch: int = 64, rate: float = 0.3, l2: float = 1e-4) -> Crf:
        """AdaGrad over batches of rows of like length, in a fixed order."""
        parts = [self.emit, self.move, self.first]
        seen = [np.full_like(p, 1e-8) for p in parts]
        rows = sorted(rows, key=lambda r: len(r[1]))
        batches = [rows[k : k + batch] for k in range(0, len(rows), batch)]
        order = random.Random(9)
        for _ in range(epochs):
            order.shuffle(batches)
            for some in batches:
                for p, g, s in zip(parts, self.gradient(some)[0], seen, strict=True):
                    g = g / len(some) - l2 * p
                    s += g * g
                    p += rate * g / np.sqrt(s)
        return self

    def decode(self, windows: list[list[list[int]]]) -> list[list[int]]:
        """The best labels of each window, given as its words' features."""
        scores = [self.emit[np.array(w)].sum(axis=1) for w in windows]
        sizes = np.array([len(x) for x in scores])
        starts = np.cumsum(sizes) - sizes
        found = self._viterbi(np.concatenate(scores), starts, sizes)
        return [found[: n, k].tolist() for k, n in enumerate(sizes)]

    def _viterbi(self, score: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Labels [step, window] of windows of a row of scores, from ``starts`` on.  The windows must not be empty.

        The best sums are kept, not the ways to them: going back, only the way to the label that was taken is sought.
        """
        order = np.argsort(-sizes, kind="stable")
        starts, sizes = starts[order], sizes[order]
        n, t = len(sizes), int(sizes[0])
        live = np.searchsorted(-sizes, -np.arange(t), side="left")  # windows longer than each step
        move = (self.move + self.ban).astype(score.dtype)
        best = np.empty((t, N_LABELS, n), dtype=score.dtype)
        best[0] = (score[starts] + (self.first + self.ban_first).astype(score.dtype)).T
        for k in range(1, t):
            w = live[k]
            best[k, :, :w] = (best[k - 1, :, None, :w] + move[:, :, None]).max(axis=0) + score[starts[:w] + k].T
        out = np.zeros((t, n), dtype=np.int8)
        label = np.zeros(n, dtype=np.int64)
        for k in range(t - 1, -1, -1):
            w, longer = live[k], live[k + 1] if k + 1 < t else 0
            if longer:
                label[:longer] = (best[k, :, :longer] + move[:, label[:longer]]).argmax(axis=0)
            if w > longer:
                label[longer:w] = best[k, :, longer:w].argmax(axis=0)
            out[k, :w] = label[:w]
        back = np.empty_like(order)
        back[order] = np.arange(n)
        return out[:, back]

    def label(self, first: np.ndarray, shape: np.ndarray) -> np.ndarray:
        """The label of every word of every text."""
        emit = self.emit.astype(np.float32)
        score = np.zeros((len(shape), N_LABELS), dtype=np.float32)
        for places in _features(first, shape):
            score += emit[places]
        sizes = np.diff(first)
        pieces = -(-sizes // CORE)
        number = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        low, high = np.repeat(first[:-1], pieces), np.repeat(first[1:], pieces)
        core = low + number * CORE
        core_end = np.minimum(core + CORE, high)
        begin = np.maximum(core - MARGIN, low)
        out = np.zeros(len(shape), dtype=np.int8)
        for k in range(0, len(core), 2048):
            a, z, b = core[k : k + 2048], core_end[k : k + 2048], begin[k : k + 2048]
            found = self._viterbi(score, b, np.minimum(z + MARGIN, high[k : k + 2048]) - b)
            for step in range(CORE + MARGIN):
                inside = np.flatnonzero((b + step >= a) & (b + step < z))
                out[b[inside] + step] = found[step, inside] if len(inside) else 0
        return out


def labelled_table(n: int = 1500, seed: int = 3) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """The small labelled table, made by rule: (text, spans).  Personal data in common spellings between invented words, and
    numbers that are none: years, prices, versions, times, hexadecimal keys, long counts."""
    r = random.Random(seed)
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("abcdefghilmnoprstuv") for _ in range(r.randint(2, 9)))

    def card() -> str:
        body = r.choice("3456") + digits(14)
        last = next(d for d in "0123456789" if luhn(body + d))
        mark = r.choice(["", " ", "-", ".", " - "])
        whole = body + last
        return mark.join(whole[k : k + 4] for k in range(0, 16, 4))

    def mail() -> str:
        at = r.choice(["@", "@", " @ ", " (at) ", "(at)", "[at]", " [at] ", " at "])
        dot = r.choice([" dot ", " dot ", " (dot) ", "."]) if at == " at " else r.choice([".", ".", ".", " dot ", "[dot]", " (dot) "])
        name = word() + r.choice(["", "", f".{word()}", f".{digits(2)}", f"_{word()}", digits(2), f"-{word()}"])
        host = word() + r.choice(["", "", digits(1), f"-{word()}", f"{dot}{word()}"])
        return f"{name}{at}{host}{dot}{r.choice(['com', 'org', 'net', 'com', 'org', 'net', 'de', 'fr', 'io', 'info'])}"

    def phone() -> str:
        area, end = digits(3), digits(3) + r.choice("-. ") + digits(4)
        city = r.choice(["0" + digits(2), "0" + digits(3), "0" + digits(4)])
        return r.choice([
            lambda: r.choice(["+1 ", "+49 ", "", "+33-", "+", "001 "]) + r.choice([f"({area}) {end}", f"{area}-{end}", f"({area}) {end}"]),
            lambda: f"{city}{r.choice([' ', '/', '-', ' / '])}{digits(r.randint(6, 8))}",
            lambda: f"00{digits(2)}{r.choice([' ', '-', ' '])}{digits(r.randint(2, 3))}{r.choice([' ', '-', ' '])}{digits(r.randint(6, 7))}",
            lambda: f"({city}) {digits(r.randint(3, 4))}{r.choice('- ')}{digits(r.randint(3, 4))}",
            lambda: "0" + " ".join([digits(1), *(digits(2) for _ in range(4))]),
            lambda: f"{r.choice(['tel ', 'Tel. ', 'tel: ', 'fax '])}\0{'0' + digits(r.randint(8, 10))}",
        ])()

    def one(kind: int) -> str:
        if kind == 1:
            return r.choice([".", ".", " . ", "[.]"]).join(str(r.randint(0, 255)) for _ in range(4))
        return (mail, None, card, phone)[kind]()

    def none() -> str:
        return r.choice([
            lambda: f"{r.randint(1900, 2030)}", lambda: f"${digits(2)}.{digits(2)}", lambda: f"{digits(1)}.{digits(1)}.{digits(2)}", lambda: f"{digits(2)}:{digits(2)}",
            lambda: f"\"{''.join(r.choice('0123456789abcdef') for _ in range(40))}\"", lambda: f"{digits(3)},{digits(3)}", lambda: f"{digits(2)} + {digits(2)}", lambda: f"2023-{digits(2)}-{digits(2)}",
            lambda: f"({digits(2)})", lambda: f"{digits(2)}%", lambda: digits(r.randint(5, 13)), lambda: f"{word()}{digits(2)}", lambda: f"@{word()}", lambda: f"{digits(3)}-{digits(2)}", lambda: digits(16), lambda: f"{digits(4)}-{digits(4)}",
            lambda: f"{word()} at {word()}. {word().title()}", lambda: f"{word()} at {word()}", lambda: f"{word()} (at {word()})", lambda: f"{word()}.{r.choice(['com', 'org', word()])}", lambda: f"{word()} dot {word()}",
            lambda: f"{digits(2)}/{digits(2)}/{digits(4)}", lambda: f"{digits(2)}.{digits(2)}.{digits(4)}", lambda: ".".join(digits(1) for _ in range(5)), lambda: f"{digits(1)}.{digits(5)}", lambda: f"{digits(3)} {digits(3)} {digits(3)}",
            lambda: f"{digits(2)} . {digits(1)}", lambda: f"{digits(4)} {digits(4)}", lambda: f"{digits(1)} 000 {digits(3)}", lambda: f"{digits(2)}-{digits(2)}", lambda: f"{word()}: {digits(2)}, {digits(2)}, {digits(3)}, {digits(2)}",
        ])()

    rows = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(r.randint(1, 4)):
            before = " ".join((word().title() if r.random() < 0.2 else word()) + r.choice(["", "", "", ",", ".", " |", "###", "!!"]) for _ in range(r.randint(1, 7)))
            text += before + r.choice([" ", " ", "\n", ": "])
            if r.random() < 0.5:
                kind = r.randrange(4)
                lead, _, piece = one(kind).rpartition("\0")
                text += lead
                spans.append((len(text), kind, len(text) + len(piece)))
            else:
                piece = none()
            text += piece + r.choice([" ", ", ", ". ", "!! ", "### ", "\n"])
        rows.append((text + word(), spans))
    return rows


def train(table: list[tuple[str, list[tuple[int, int, int]]]] | None = None) -> Crf:
    """A field from a small labelled table."""
    table = labelled_table() if table is None else table
    first, start, end, shape = tokenize([text for text, _ in table])
    features, labels = np.stack(list(_features(first, shape)), axis=1), np.zeros(len(shape), dtype=np.int64)
    rows = []
    for (_, spans), low, high in zip(table, first[:-1].tolist(), first[1:].tolist(), strict=True):
        for a, kind, b in spans:
            inside = low + np.flatnonzero((start[low:high] >= a) & (end[low:high] <= b))
            labels[inside] = 2 * kind + 2
            labels[inside[:1]] = 2 * kind + 1
        if high > low:
            rows.append((features[low:high], labels[low:high]))
    return Crf().fit(rows)


@functools.cache
def default_field() -> Crf:
    """The field of the built-in table, trained once a process."""
    return train()


_AT = re.compile(r"@|\bat\b", re.IGNORECASE)
_DOT = re.compile(r"\.|\bdot\b", re.IGNORECASE)
_MAIL = re.compile(r"[^\W_][\w .%+@()\[\]-]*[^\W_]")


def _plausible(kind: int, text: str) -> bool:
    """What the field marks must have the parts that its kind can't be without."""
    if kind == 0:
        at = _AT.search(text)
        return bool(at and _DOT.search(text, at.end()) and any(c.isalnum() for c in text[: at.start()]) and _MAIL.fullmatch(text))
    groups = re.findall("[0-9]+", text)
    n = sum(map(len, groups))
    if kind == 1:
        return len(groups) == 4 and text.count(".") == 3 and all(len(g) <= 3 and int(g) <= 255 for g in groups)
    return 14 <= n <= 19 and luhn("".join(groups)) if kind == 2 else 7 <= n <= 15


def find_spans(texts: list[str], crf: Crf) -> list[tuple[list, list]]:
    """For each text: its base spans, and those with the field's."""
    base = [base_spans(t) for t in texts]
    first, start, end, shape = tokenize(texts)
    path = crf.label(first, shape) if len(shape) else np.zeros(0, dtype=np.int8)
    marked = np.flatnonzero(path)
    owner = np.searchsorted(first, marked, side="right") - 1
    # A span begins where it says so, at another kind, after a gap, and in another text.
    kind = (path[marked].astype(np.int64) - 1) // 2
    begins = np.ones(len(marked), dtype=bool)
    begins[1:] = (path[marked[1:]] % 2 == 1) | (kind[1:] != kind[:-1]) | (np.diff(marked) > 1) | (np.diff(owner) > 0)
    edges = np.append(np.flatnonzero(begins), len(marked))
    more: list[list] = [list(b) for b in base]
    for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        k, a, b = int(owner[i]), int(start[marked[i]]), int(end[marked[j - 1]])
        if _plausible(int(kind[i]), texts[k][a:b]) and all(b <= x or y <= a for x, _, y in base[k]):
            more[k].append((a, int(kind[i]), b))
    return [(b, sorted(set(m))) for b, m in zip(base, more, strict=True)]


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _detect(shared) -> Callable:
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_spans", "spans"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in text_blocks(batches):
            found = find_spans(texts, shared.value)
            counts = [pa.array([sum(s[1] == k for s in b) for b, _ in found], pa.int64()) for k in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *counts, pa.array([written(b) for b, _ in found], pa.string()), pa.array([written(m) for _, m in found], pa.string())], names)

    return run


def detect(docs: DataFrame, crf: Crf | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_spans and spans as kind:start:end lists."""
    crf = crf or default_field()
    shared = docs.sparkSession.sparkContext.broadcast(crf)  # fixed size: BUCKETS x N_LABELS
    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_spans string, spans string"
    return keyed_texts(docs).mapInArrow(_detect(shared), schema)


def _mask(shared) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in text_blocks(batches):
            out = []
            for text, (_, spans) in zip(texts, find_spans(texts, shared.value), strict=True):
                parts, at = [], 0
                for start, kind, end in spans:
                    if end > at:
                        parts += [text[at : max(at, start)], f"[{KINDS[kind]}]"]
                        at = end
                out.append("".join([*parts, text[at:]]))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(out, pa.string())], ["doc_id", "text"])

    return run


def mask(docs: DataFrame, crf: Crf | None = None) -> DataFrame:
    """(doc_id, text) with every span replaced by its kind in brackets."""
    crf = crf or default_field()
    return keyed_texts(docs).mapInArrow(_mask(docs.sparkSession.sparkContext.broadcast(crf)), "doc_id long, text string")
