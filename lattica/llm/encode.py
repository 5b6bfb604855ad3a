"""Token ids of whole texts by the tokenizers library, with each distinct piece encoded once.

A byte-level pre-tokenizer cuts a text into runs of letters, of digits and of other marks,
and the ids of a run don't depend on what is around it. Runs are found and looked up as
whole byte buffers in a bounded table, so a Python string is made only for a run that the
table doesn't know. A hit is compared byte for byte, so two runs of one hash don't mix.
Texts in which a run may end elsewhere (control characters, contractions, added tokens,
letters beyond ASCII that aren't plain) are encoded whole, so the ids always equal those
of a plain ``encode``.
"""

from __future__ import annotations

import json
import unicodedata
from itertools import chain

import numpy as np
from tokenizers import Tokenizer

from lattica.llm.text import U64, Words


def _byte_letters() -> list[str]:
    """The byte-level alphabet: visible Latin-1 bytes stand for themselves, the rest follow from code point 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + rest.index(b)) for b in range(256)]


def _style(told: dict) -> str:
    """How a tokenizer file cuts texts.

    spaced: runs carry the one space before them, other white space is cut as it stands;
    dropped: white space has no ids, case is lowered, digits stand alone; whole: unknown.
    """
    pre, clean = told["pre_tokenizer"] or {}, told["normalizer"] or {}
    parts = pre.get("pretokenizers", [pre])
    kinds = [p.get("type") for p in parts]
    steps = [x.get("type") for x in clean.get("normalizers", [clean] if clean else [])]
    if kinds == ["ByteLevel"] and parts[0].get("use_regex") and not parts[0].get("add_prefix_space") and not steps:
        return "spaced"
    if kinds == ["Split", "ByteLevel"] and parts[0].get("behavior") == "Removed" and steps == ["NFC", "Replace", "Lowercase"]:
        return "dropped"
    return "whole"


class _Spaced(Words):
    """Runs with white space: a space before another run joins it (``gap``), other white space gives pieces of its own.

    White space before a run is one piece but for its last character; at a text's end it
    is one piece.
    """

    def _cut(self, data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> None:
        white = kind == 4
        inner = np.ones(len(white), bool)
        ptr = np.searchsorted(self.start, offsets[1:])
        inner[ptr[ptr > 0] - 1] = False  # a text's last run
        last = data[self.end - 1] == 32
        join = white & inner & last
        gap = np.concatenate([[False], join[:-1]]) if len(join) else join
        start, end = self.start, self.end - join
        parted = np.flatnonzero(white & inner & ~last & (end - start > 1))
        if len(parted):
            middle = end[parted] - 1
            start, end, gap = np.insert(start, parted + 1, middle), np.insert(end, parted, middle), np.insert(gap, parted, False)
        keep = end > start
        self.start, self.end, self.gap = start[keep], end[keep], gap[keep]


#: Bytes after which a text is encoded whole.
_CONTROL = np.array([b == 127 or b < 9 or 13 < b < 32 for b in range(256)])
#: Bytes of a run that a hit compares at once; longer ones are looked up by their bytes.
_LONG = 16
_GAP = U64(0xA24BAED4963EE407)


def _room(held: np.ndarray, n: int) -> np.ndarray:
    """The array with room for ``n`` values at least."""
    if n <= len(held):
        return held
    out = np.zeros(max(n, 2 * len(held)), held.dtype)
    out[: len(held)] = held
    return out


class RunEncoder:
    """Encodes texts given as UTF-8 buffers. ``path``: a tokenizer file; ``entries``: bound of the table, but for one call's new runs."""

    def __init__(self, path: str, entries: int = 400_000):
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        self.style, self.entries = _style(told), entries
        self.added = [t["content"].encode() for t in told["added_tokens"]]
        self.letters, self.model = _byte_letters(), self.tokenizer.model
        self.digit = {48 + d: self.tokenizer.encode(str(d), add_special_tokens=False).ids for d in range(10)}
        self._clear(entries)

    def _clear(self, entries: int) -> None:
        self.keys = np.zeros(1 << max(10, (2 * entries).bit_length()), U64)
        self.slots = np.zeros(len(self.keys), np.int32)
        self.long: dict[tuple[bytes, bool], int] = {}
        self.n = self.n_ids = 0
        self.key, self.low, self.high = (np.zeros(1024, U64) for _ in range(3))
        self.gap, self.odd = np.zeros(1024, bool), np.zeros(1024, bool)
        self.first, self.size, self.seen = (np.zeros(1024, np.int64) for _ in range(3))
        self.ids = np.zeros(4096, np.uint32)

    def _forget(self) -> None:
        """Keep the half of the table that was seen most often; long runs go."""
        keep = np.argsort(-self.seen[: self.n], kind="stable")[: self.entries // 2]
        keep = np.sort(keep[self.key[keep] > 0])
        held = [x[keep] for x in (self.key, self.low, self.high, self.gap, self.odd, self.first, self.size, self.seen)]
        first, size, ids = held[5], held[6], self.ids
        self._clear(self.entries)
        self.n, self.n_ids = len(keep), int(size.sum())
        filled = np.cumsum(size) - size
        self.ids = ids[np.repeat(first - filled, size) + np.arange(self.n_ids)]
        self.key, self.low, self.high, self.gap, self.odd, self.first, self.size, self.seen = *held[:5], filled, size, held[7] // 2
        self._place(self.key, np.arange(self.n))

    def _find(self, key: np.ndarray) -> np.ndarray:
        """Number of each run's entry, -1 where there is none."""
        mask = U64(len(self.keys) - 1)
        slot = (key & mask).astype(np.int64)
        here = self.keys[slot]
        out = np.where(here == key, self.slots[slot], -1)
        left = np.flatnonzero((here != key) & (here > 0))
        while len(left):
            slot[left] = (slot[left] + 1) & int(mask)
            here = self.keys[slot[left]]
            hit = here == key[left]
            out[left[hit]] = self.slots[slot[left[hit]]]
            left = left[~hit & (here > 0)]
        return out

    def _place(self, key: np.ndarray, number: np.ndarray) -> None:
        """Enter distinct new keys."""
        if 2 * self.n > len(self.keys):
            kept = self.keys > 0
            key, number = np.concatenate([self.keys[kept], key]), np.concatenate([self.slots[kept], number])
            size = 1 << (4 * self.n).bit_length()
            self.keys, self.slots = np.zeros(size, U64), np.zeros(size, np.int32)
        slot = (key & U64(len(self.keys) - 1)).astype(np.int64)
        left = np.arange(len(key))
        while len(left):
            free = left[self.keys[slot[left]] == 0]
            self.keys[slot[free]] = key[free]
            self.slots[slot[free]] = number[free]
            left = left[self.keys[slot[left]] != key[left]]
            slot[left] = (slot[left] + 1) & (len(self.keys) - 1)

    def _ids(self, run: bytes, gap: bool) -> list[int] | None:
        """Ids of one run (lower-cased if the tokenizer does so), None if its text has to be encoded whole."""
        spaced, letters = self.style == "spaced", self.letters
        if run.isascii():
            if spaced:
                shown = run.decode() if run[0] > 32 else "".join([letters[b] for b in run])
                return [t.id for t in self.model.tokenize(letters[32] + shown if gap else shown)]
            if run[0] in self.digit:
                return list(chain.from_iterable(self.digit[b] for b in run))
            return [t.id for t in self.model.tokenize(run.decode())]
        word = run.decode()
        if not spaced:
            if "Σ" in word or "İ" in word:  # lower-cased by context or to several letters
                return None
            word = word.lower()
            if not unicodedata.is_normalized("NFC", word):
                return None
        if not word.isalpha():
            return None
        shown = "".join([letters[b] for b in word.encode()])
        return [t.id for t in self.model.tokenize(letters[32] + shown if gap else shown)]

    def _learn(self, runs: list[tuple[bytes, bool]]) -> None:
        """Append entries for new runs."""
        tokenize, first, plain = self.model.tokenize, self.letters[32], self._ids
        # runs of ASCII letters, the most common kind, without a call of their own
        made = [[t.id for t in tokenize(first + run.decode() if gap else run.decode())] if run.isalpha() else plain(run, gap) for run, gap in runs]
        size = np.fromiter((len(m) if m else 0 for m in made), np.int64, len(made))
        n, n_ids = self.n + len(made), self.n_ids + int(size.sum())
        self.key, self.low, self.high, self.gap, self.odd, self.first, self.size, self.seen = (_room(x, n) for x in (self.key, self.low, self.high, self.gap, self.odd, self.first, self.size, self.seen))
        self.ids = _room(self.ids, n_ids)
        self.odd[self.n : n] = [m is None for m in made]
        self.key[self.n : n], self.seen[self.n : n] = 0, 0
        self.first[self.n : n] = self.n_ids + np.cumsum(size) - size
        self.size[self.n : n] = size
        self.ids[self.n_ids : n_ids] = np.fromiter(chain.from_iterable(m for m in made if m), np.uint32, int(size.sum()))
        self.n, self.n_ids = n, n_ids

    def _numbers(self, words: Words, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry of each run, whether another run has its hash)."""
        folded = words.folded
        key = np.maximum(words.hash ^ (gap * _GAP), U64(1))
        long = words.size > _LONG
        number = self._find(key)
        number[long] = 0
        fresh = np.flatnonzero(number < 0)
        if len(fresh):
            new, example = np.unique(key[fresh], return_index=True)
            at, raw = fresh[example], folded.tobytes()
            n = self.n
            self._learn([(raw[s:e], g) for s, e, g in zip(words.start[at].tolist(), words.end[at].tolist(), gap[at].tolist(), strict=True)])
            made = np.arange(n, self.n)
            self.key[made], self.low[made], self.high[made], self.gap[made] = new, words.lane(0, at), words.lane(1, at), gap[at]
            self._place(new, made)
            number[fresh] = n + np.searchsorted(new, key[fresh])
        differs = ((self.low[number] != words.lane(0)) | (self.high[number] != words.lane(1)) | (self.gap[number] != gap)) & ~long
        at = np.flatnonzero(long)
        fresh_runs: list[tuple[bytes, bool]] = []
        for i, s, e, g in zip(at.tolist(), words.start[at].tolist(), words.end[at].tolist(), gap[at].tolist(), strict=True):
            run = folded[s:e].tobytes(), g
            if run not in self.long:
                self.long[run] = self.n + len(fresh_runs)
                fresh_runs.append(run)
            number[i] = self.long[run]
        if fresh_runs:
            self._learn(fresh_runs)
        return number, differs

    def _whole(self, data: np.ndarray, offsets: np.ndarray, folded: np.ndarray) -> np.ndarray:
        """Texts that can't be cut into runs."""
        n = len(data)
        spots = [np.flatnonzero(np.take(_CONTROL, data, mode="clip"))]
        mark = np.flatnonzero(data == 39)
        if len(mark):
            one, two = folded[mark + 1], folded[mark + 2]  # the buffer goes on with zeros
            short = np.isin(one, list(b"stmd")) | ((one == 114) & (two == 101)) | ((one == 118) & (two == 101)) | ((one == 108) & (two == 108))
            spots.append(mark[short])
        raw = data.tobytes()
        for content in self.added:
            at = raw.find(content)
            while at >= 0:
                spots.append(np.array([at]))
                at = raw.find(content, at + 1)
        out = np.zeros(len(offsets) - 1, bool)
        held = np.concatenate(spots)
        if n and len(held):
            out[np.searchsorted(offsets, held, "right") - 1] = True
        return out

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, ptr): text i has ``ids[ptr[i]:ptr[i + 1]]``."""
        if self.style == "whole":
            ids, ptr = np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
            return self._mended(ids, ptr, np.diff(offsets) > 0, data, offsets)
        if self.n > self.entries:
            self._forget()
        if self.style == "spaced":
            words = _Spaced(data, offsets, lower=False, words="all")
            gap = words.gap
        else:
            words = Words(data, offsets, words="runs")
            gap = np.zeros(len(words.hash), bool)
        at, differs = self._numbers(words, gap)
        self.seen[: self.n] += np.bincount(at, minlength=self.n)
        whole = self._whole(data, offsets, words.folded)
        whole[np.searchsorted(words.ptr, np.flatnonzero(self.odd[at] | differs), "right") - 1] = True
        size = self.size[at]
        if whole.any():
            size[np.repeat(whole, np.diff(words.ptr))] = 0
        filled = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.repeat(self.first[at] - filled[:-1], size) + np.arange(filled[-1])]
        return self._mended(ids, filled[words.ptr], whole, data, offsets)

    def _mended(self, ids: np.ndarray, ptr: np.ndarray, whole: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids with those of the ``whole`` texts, which had none, put in."""
        if not whole.any():
            return ids, ptr
        rows = np.flatnonzero(whole).tolist()
        made = self.tokenizer.encode_batch([data[offsets[i] : offsets[i + 1]].tobytes().decode() for i in rows], add_special_tokens=False)
        parts, total = np.split(ids, ptr[1:-1]), np.diff(ptr)
        for i, m in zip(rows, made, strict=True):
            parts[i] = np.array(m.ids, np.uint32)
            total[i] = len(parts[i])
        return np.concatenate(parts), np.concatenate([[0], np.cumsum(total)])
