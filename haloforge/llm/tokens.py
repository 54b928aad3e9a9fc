"""Token ids by a public tokenizer, each distinct word encoded once for each Python worker."""

from __future__ import annotations

import os
import re

import numpy as np

from haloforge.llm.words import by_eight, lane, span_hashes

#: Byte classes: space 0, ASCII letter 1, mark 2, anything else 5.  Marks are ASCII punctuation but the apostrophe
#: (contractions) and those that special tokens are written with.
_CLASS = np.full(256, 5, dtype=np.uint8)
_CLASS[[0x20, *range(0x09, 0x0E)]] = 0
_CLASS[[c for c in range(128) if chr(c).isalpha()]] = 1
_CLASS[[ord(c) for c in "!\"#$%&()*+,-./:;=?@[\\]^_`{}~"]] = 2
#: Words that are surely one pre-token each.
_SINGLE = re.compile("[a-zß-öø-ÿ]+|[!-&(-/:;=?@\\[-`{}~]+")
_SLOT_BITS = 21
_encoders: dict[tuple[str, int], WordEncoder] = {}


def _first_sixteen(eight: np.ndarray, starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers that, with the size, spell words of up to sixteen bytes."""
    following = np.zeros(len(starts), dtype=np.uint64)
    longer = np.flatnonzero(size > 8)
    following[longer] = lane(eight, starts[longer] + 8, np.minimum(size[longer] - 8, 8))
    return lane(eight, starts, np.minimum(size, 8)), following


class WordEncoder:
    """Ids of whole texts, equal to ``Tokenizer.encode(text, add_special_tokens=False)``.

    The tokenizers it takes split at white space and at borders between letters and marks before they merge, so a
    text's ids are its words' ids in a row.  Words are found by a 64-bit hash, and their bytes are compared with those of
    the word that the table holds under it; a text with a word whose hash is another's goes to the library whole.  The
    library encodes words not met before.  The table holds ``most`` words, and ``most`` times 16 of their bytes, at most and
    starts anew when full: that changes the time, never a result.  Texts beyond Latin-1, or with the strings of special tokens, aren't lower-cased
    first; the library does that.
    """

    def __init__(self, path: str, most: int = 4_000_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.most = most
        vocabulary = self.library.get_vocab()
        self.dtype = np.dtype("<u2") if max(vocabulary.values()) < 1 << 16 else np.dtype("<u4")
        self.closes = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.closes[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True
        self._clear()

    def _clear(self) -> None:
        """Rows are words in the order in which they came: hash, bytes (the first sixteen as numbers, all in ``spelled``), ids."""
        self.n = 0
        self.hashes, self.head, self.next = (np.zeros(1 << 12, dtype=np.uint64) for _ in range(3))
        self.begins, self.sizes, self.word_begins, self.word_sizes = (np.zeros(1 << 12, dtype=np.int64) for _ in range(4))
        self.ids, self.filled = np.zeros(1 << 16, dtype=self.dtype), 0
        self.spelled, self.written = np.zeros(1 << 16, dtype=np.uint8), 0
        self.slots = np.zeros(1 << _SLOT_BITS, dtype=np.int32)  # the row that came last to each slot
        self.sorted = np.zeros(0, dtype=np.uint64)
        self.sorted_rows = np.zeros(0, dtype=np.int64)

    def _append(self, name: str, used: int, values: np.ndarray) -> None:
        held = getattr(self, name)
        if used + len(values) > len(held):
            held = np.concatenate([held, np.zeros(max(len(held), used + len(values) - len(held)), dtype=held.dtype)])
            setattr(self, name, held)
        held[used : used + len(values)] = values

    def _library(self, words: list[str]) -> list[list[int]]:
        """Ids of each word.  Single pre-tokens go together in one text: each ends with the first id that closes a word."""
        out: list[list[int]] = [[]] * len(words)
        single = [k for k, word in enumerate(words) if _SINGLE.fullmatch(word)]
        rest = set(range(len(words))).difference(single)
        for i in range(0, len(single), 256):
            some = single[i : i + 256]
            ids = self.library.encode(" ".join([words[k] for k in some]), add_special_tokens=False).ids
            ends = (np.flatnonzero(self.closes[ids]) + 1).tolist()
            if len(ends) != len(some):
                rest.update(some)
                continue
            for k, begin, end in zip(some, [0, *ends], ends, strict=False):
                out[k] = ids[begin:end]
        for k in rest:
            out[k] = self.library.encode(words[k], add_special_tokens=False).ids
        return out

    def _learn(self, hashes: np.ndarray, raw: list[bytes]) -> None:
        found = self._library([w.decode("utf-8", "surrogatepass") for w in raw])
        letters = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        spelled = np.frombuffer(b"".join(raw), dtype=np.uint8)
        at = np.cumsum(letters) - letters
        head, following = _first_sixteen(by_eight(spelled), at, letters)
        rows = np.arange(self.n, self.n + len(raw))
        columns = {"hashes": hashes, "head": head, "next": following, "begins": self.filled + np.cumsum(sizes) - sizes, "sizes": sizes, "word_begins": self.written + at, "word_sizes": letters}
        for name, values in columns.items():
            self._append(name, self.n, values)
        self._append("ids", self.filled, np.fromiter((x for ids in found for x in ids), dtype=self.dtype, count=int(sizes.sum())))
        self._append("spelled", self.written, spelled)
        self.n, self.filled, self.written = self.n + len(raw), self.filled + int(sizes.sum()), self.written + len(spelled)
        self.slots[hashes >> np.uint64(64 - _SLOT_BITS)] = rows
        place = np.searchsorted(self.sorted, hashes)
        self.sorted, self.sorted_rows = np.insert(self.sorted, place, hashes), np.insert(self.sorted_rows, place, rows)

    def _find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The row of each hash, and which have none."""
        row = self.slots[hashes >> np.uint64(64 - _SLOT_BITS)].astype(np.int64)
        other = np.flatnonzero((self.hashes[row] != hashes) | (row >= self.n))
        place = np.searchsorted(self.sorted, hashes[other])
        there = place < len(self.sorted)
        there[there] = self.sorted[place[there]] == hashes[other][there]
        row[other[there]] = self.sorted_rows[place[there]]
        return row, other[~there]

    def _differ(self, eight: np.ndarray, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, row: np.ndarray) -> np.ndarray:
        """The words of the block that aren't, byte for byte, those of the table's rows."""
        size = ends - starts
        head, following = _first_sixteen(eight, starts, size)
        out = (size != self.word_sizes[row]) | (head != self.head[row]) | (following != self.next[row])
        for k in np.flatnonzero(~out & (size > 16)).tolist():
            begin = self.word_begins[row[k]]
            out[k] = not np.array_equal(buf[starts[k] + 16 : ends[k]], self.spelled[begin + 16 : begin + size[k]])
        return np.flatnonzero(out)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's begin (one more entry than texts)."""
        raw = []
        for text in texts:
            plain = text.isascii()
            if not plain:
                try:
                    text.encode("latin-1")
                    plain = True
                except UnicodeEncodeError:
                    pass
            raw.append((text.lower() if plain and "<|" not in text else text).encode("utf-8", "surrogatepass"))
        whole = b"\n".join(raw)
        buf = np.frombuffer(whole, dtype=np.uint8)
        kind = np.zeros(len(buf) + 2, dtype=np.uint8)
        np.take(_CLASS, buf, out=kind[1:-1])
        cut = ((kind[1:] == 0) != (kind[:-1] == 0)) | (kind[1:] * kind[:-1] == 2)
        at = np.flatnonzero(cut)
        full = kind[at[:-1] + 1] != 0
        starts, ends = at[:-1][full], at[1:][full]
        text_ends = np.cumsum(np.fromiter(map(len, raw), dtype=np.int64, count=len(raw)) + 1)
        first = np.searchsorted(starts, np.concatenate([[0], text_ends]))
        if not len(starts):
            return np.zeros(0, dtype=self.dtype), first
        hashes = span_hashes(buf, starts, ends)
        word, new = self._find(hashes)
        if len(new):
            distinct, where = np.unique(hashes[new], return_index=True)
            if self.n + len(distinct) > self.most or self.written + len(buf) > 16 * self.most:
                self._clear()
                distinct, new_at = np.unique(hashes, return_index=True)
            else:
                new_at = new[where]
            self._learn(distinct, [whole[a:b] for a, b in zip(starts[new_at].tolist(), ends[new_at].tolist(), strict=True)])
            word, _ = self._find(hashes)
        sizes = self.sizes[word]
        stops = np.cumsum(sizes)
        ids = self.ids[np.repeat(self.begins[word] - (stops - sizes), sizes) + np.arange(stops[-1])]
        cuts = np.concatenate([[0], stops])[first]
        differ = self._differ(by_eight(buf), buf, starts, ends, word)
        if not len(differ):
            return ids, cuts
        parts = [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        for k in np.unique(np.searchsorted(first, differ, side="right") - 1).tolist():
            parts[k] = np.array(self.library.encode(texts[k], add_special_tokens=False).ids, dtype=self.dtype)
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])


def encoder(path: str) -> WordEncoder:
    """This worker's encoder; kept from task to task."""
    key = (path, os.getpid())
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = WordEncoder(path)
    return _encoders[key]
