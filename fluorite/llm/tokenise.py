"""Token ids of many texts, by the tokenizers library, with each distinct pre-token encoded once for a stretch of texts.

Both vocabularies split a text into pre-tokens by a pattern and encode each on its own, so ids of a text are the ids of
its pre-tokens in a row. Texts of printable ASCII, tab, newlines and U+00A1 to U+024F are split here, all at once, by the
classes of their bytes (there the classes and the lower case agree between libraries beyond doubt). Any other text, and
one that holds the string of an added token, is given to the library as a whole.

Pre-tokens of up to 16 bytes are their own keys (two integers) in an open table of fixed size; longer ones are kept in a
dictionary. Both start anew when full, so a worker holds some 70 MB at most for a vocabulary, whatever it reads.
"""

from __future__ import annotations

import json
import os
import unicodedata

import numpy as np
import pyarrow as pa

from .common import bytes_of, eights, first_bytes, mix, u64

#: Cells of the table of short pre-tokens, a power of two; half of them are used at most.
CELLS = 1 << 21
#: Bytes of long pre-tokens kept at most.
LONG_BYTES = 8 << 20
#: Texts are encoded in groups of about this many bytes, for bounded temporary arrays (a longer text is one group).
GROUP_BYTES = 1 << 20
_LETTER, _NUMBER, _OTHER, _SPACE = range(4)
_loaded: dict[str, "Encoder"] = {}


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _class(c: str) -> int:
    return _SPACE if c.isspace() else {"L": _LETTER, "N": _NUMBER}.get(unicodedata.category(c)[0], _OTHER)


#: Classes, lower case and oddness of the code points below U+0250.
_CLASS = np.array([_class(chr(c)) for c in range(0x250)], np.uint8)
_SMALL = np.array([min(ord(chr(c).lower()[0]), 0x24F) for c in range(0x250)])
_ODD = np.array([not (c in (9, 10, 13) or 32 <= c < 127 or c >= 0xA1) or len(chr(c).lower()) > 1 or ord(chr(c).lower()[0]) > 0x24F for c in range(0x250)])


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path) as f:
            description = json.load(f)
        self.lower = description["normalizer"] is not None
        #: bytes of each id: a letter of the alphabet of bytes stands for one
        self.bytes = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for piece, i in self.tokenizer.get_vocab().items():
            self.bytes[i] = len(piece.removesuffix("</w>"))
        self.added = [t["content"].encode() for t in description["added_tokens"]]
        if any(len(a) < 8 or any(x >= 128 for x in a) for a in self.added):
            raise ValueError("added tokens are looked for by their first eight bytes")
        self.clear()

    def clear(self) -> None:
        self.cell = np.full(CELLS, -1, np.int32)
        self.low, self.high = (np.zeros(CELLS, np.uint64) for _ in range(2))
        self.long: dict[bytes, int] = {}
        self.number, self.long_bytes = 0, 0
        self.flat, self.start, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int32), np.zeros(0, np.int32)

    # ------------------------------------------------------------------------------------------------ pre-tokens
    def _split(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(data in lower case where the vocabulary asks for it, starts and ends of all pre-tokens); no text is odd."""
        kind = _CLASS[np.minimum(data, 127)]
        lead = np.flatnonzero(data >= 0xC0)
        if len(lead):
            point = (data[lead].astype(np.int64) & 31) << 6 | data[lead + 1] & 63
            kind[lead] = kind[lead + 1] = _CLASS[point]
        if self.lower:
            low = _SMALL.astype(np.uint8)[np.minimum(data, 127)]
            high = data >= 128
            low[high] = data[high]
            if len(lead):
                point = _SMALL[point]
                low[lead], low[lead + 1] = 0xC0 | point >> 6, 0x80 | point & 63
            data = low
        n = len(data)
        edge = np.zeros(n + 1, bool)
        edge[1:n] = kind[1:] != kind[:-1]
        edge[at] = True
        text_edge = np.zeros(n + 1, bool)
        text_edge[at] = True
        if self.lower:  # each number is one
            numbers = np.flatnonzero(kind == _NUMBER)
            edge[numbers[(data[numbers] & 0xC0) != 0x80]] = True
        # white space before something else of its text: its last character joins that if it is a space, or stands alone
        space = kind == _SPACE
        last = np.flatnonzero(space[:-1] & ~space[1:] & ~text_edge[1:n]) if n > 1 else np.zeros(0, np.int64)
        blank = np.zeros(n, bool)
        if not self.lower:
            edge[last] = True
            joins = last[data[last] == 32]
            edge[joins + 1] = False
            blank[joins] = True
        self._contractions(data, kind, edge, text_edge, blank)
        starts = np.flatnonzero(edge[:-1])
        ends = np.append(starts[1:], n) if len(starts) else starts
        if self.lower:
            word = ~space[starts]
            starts, ends = starts[word], ends[word]
        return data, starts, ends

    @staticmethod
    def _contractions(data: np.ndarray, kind: np.ndarray, edge: np.ndarray, text_edge: np.ndarray, blank: np.ndarray) -> None:
        """Fixed values: 's 't 're 've 'm 'll 'd are pre-tokens where an apostrophe opens one."""
        n = len(data)
        mark = np.flatnonzero(data == 39)
        free = text_edge[mark] | ((kind[mark - 1] != _OTHER) & ~blank[mark - 1])
        mark = mark[free]
        for letters in (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d"):
            here = mark[mark + len(letters) < n]
            for k, c in enumerate(letters):
                here = here[(data[here + 1 + k] == c) & ~text_edge[here + 1 + k]]
            edge[here + 1] = False
            edge[here + 1 + len(letters)] = True

    # ---------------------------------------------------------------------------------------------------- codes
    def _look(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The code of each short pre-token, -1 if it has none."""
        out = np.full(len(low), -1, np.int64)
        cell = (mix(low ^ (high * u64(0x9E3779B97F4A7C15))) & u64(CELLS - 1)).astype(np.int64)
        live = np.arange(len(low))
        while len(live):
            code = self.cell[cell]
            same = (self.low[cell] == low[live]) & (self.high[cell] == high[live]) & (code >= 0)
            out[live[same]] = code[same]
            on = ~same & (code >= 0)
            live, cell = live[on], (cell[on] + 1) & (CELLS - 1)
        return out

    def _insert(self, low: np.ndarray, high: np.ndarray, codes: np.ndarray) -> None:
        cell = (mix(low ^ (high * u64(0x9E3779B97F4A7C15))) & u64(CELLS - 1)).astype(np.int64)
        live = np.arange(len(low))
        while len(live):
            free = np.flatnonzero(self.cell[cell] < 0)
            _, one = np.unique(cell[free], return_index=True)  # of those that want one cell, one gets it
            won = free[one]
            self.cell[cell[won]], self.low[cell[won]], self.high[cell[won]] = codes[live[won]], low[live[won]], high[live[won]]
            stay = np.ones(len(live), bool)
            stay[won] = False
            live, cell = live[stay], (cell[stay] + 1) & (CELLS - 1)

    def _learn(self, new: list[str]) -> None:
        """Encode new pre-tokens: words a thousand to a text, which splits into exactly them, all others on their own."""
        plain = np.array([p.isalpha() if self.lower else p[0] == " " and p[1:].isalpha() for p in new], bool)
        words, others = [p for p, x in zip(new, plain) if x], [p for p, x in zip(new, plain) if not x]
        groups = [words[k : k + 1000] for k in range(0, len(words), 1000)]
        joined = self.tokenizer.encode_batch_fast([(" " if self.lower else "").join(g) for g in groups], add_special_tokens=False)
        flats, sizes = [self.flat], [np.zeros(0, np.int64)]
        for group, e in zip(groups, joined):
            ids = np.array(e.ids, np.uint32)
            ends = np.cumsum(np.array([len(w.encode()) for w in group]))  # in bytes, where ids end, too
            at = np.searchsorted(covered := np.cumsum(self.bytes[ids]), ends)
            if covered[-1] != ends[-1] or (covered[at] != ends).any():
                raise ValueError("words were split anew")
            flats.append(ids)
            sizes.append(np.diff(at, prepend=-1))
        for e in self.tokenizer.encode_batch_fast(others, add_special_tokens=False):
            flats.append(np.array(e.ids, np.uint32))
            sizes.append(np.array([len(e.ids)]))
        size = np.concatenate(sizes)
        start = len(self.flat) + np.cumsum(size) - size
        order = np.argsort(~plain, kind="stable")  # words first, as above
        place = np.empty(len(new), np.int64)
        place[order] = np.arange(len(new))
        self.start = np.concatenate([self.start, start[place].astype(np.int32)])
        self.size = np.concatenate([self.size, size[place].astype(np.int32)])
        self.flat = np.concatenate(flats)
        self.number += len(new)

    def _codes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        size = ends - starts
        view = eights(data)
        low, high = first_bytes(view[starts], size), np.zeros(len(starts), np.uint64)
        more = np.flatnonzero(size > 8)
        high[more] = first_bytes(view[starts[more] + 8], size[more] - 8)
        short = size <= 16
        codes = np.full(len(starts), -1, np.int64)
        codes[short] = self._look(low[short], high[short])
        missing = np.flatnonzero(short & (codes < 0))
        if len(missing):
            order = missing[np.lexsort((high[missing], low[missing]))]
            new = np.concatenate([[True], (low[order][1:] != low[order][:-1]) | (high[order][1:] != high[order][:-1])])
            first = order[new]
            known = self.number + np.arange(len(first))
            self._learn([data[a:b].tobytes().decode() for a, b in zip(starts[first].tolist(), ends[first].tolist())])
            self._insert(low[first], high[first], known)
            codes[order] = known[np.cumsum(new) - 1]
        long = np.flatnonzero(~short).tolist()
        if long:
            texts = [data[starts[i] : ends[i]].tobytes() for i in long]
            fresh = list(dict.fromkeys(t for t in texts if t not in self.long))
            if fresh:
                self.long.update(zip(fresh, range(self.number, self.number + len(fresh))))
                self.long_bytes += sum(map(len, fresh))
                self._learn([t.decode() for t in fresh])
            codes[long] = [self.long[t] for t in texts]
        return codes

    # --------------------------------------------------------------------------------------------------- texts
    def _odd(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The numbers of the texts that go to the library as a whole."""
        bad = [np.flatnonzero((data >= 0xCA) | _ODD[np.minimum(data, 127)] & (data < 128))]
        lead = np.flatnonzero((data >= 0xC2) & (data < 0xCA))
        point = (data[lead].astype(np.int64) & 31) << 6 | data[lead + 1] & 63
        bad.append(lead[(point >= 0x250) | _ODD[np.minimum(point, 0x24F)]])
        mark = np.flatnonzero(data == self.added[0][0]) if self.added else lead[:0]
        if len(mark):
            view = eights(data)
            for a in self.added:
                start = mark if a[0] == self.added[0][0] else np.flatnonzero(data == a[0])
                bad.append(start[view[start] == np.frombuffer(a[:8], "<u8")[0]])
        return np.unique(np.searchsorted(at, np.concatenate(bad), side="right") - 1)

    def _group(self, data: np.ndarray, at: np.ndarray, texts: list[str | None], end: int) -> tuple[np.ndarray, np.ndarray]:
        if self.number > CELLS // 2 or self.long_bytes > LONG_BYTES:
            self.clear()
        n = len(at) - 1
        odd = self._odd(data, at)
        whole = {i: self.tokenizer.encode(texts[i], add_special_tokens=False).ids for i in odd.tolist()}
        if len(odd):
            keep = np.ones(n, bool)
            keep[odd] = False
            size = np.where(keep, np.diff(at), 0)
            data = data[np.repeat(keep, np.diff(at))]
            at = np.concatenate([[0], np.cumsum(size)])
        sizes, of_text, codes = np.zeros(0, np.int64), np.zeros(n + 1, np.int64), np.zeros(0, np.int64)
        if len(data):
            data, starts, ends = self._split(data, at)
            codes = self._codes(data, starts, ends)
            of_text = np.searchsorted(starts, at)
            sizes = self.size[codes].astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        lengths = ends[of_text[1:]] - ends[of_text[:-1]] + 1
        for i, x in whole.items():
            lengths[i] = len(x) + 1
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        out = np.empty(offsets[-1], np.uint32)
        shift = np.repeat(offsets[:-1] - ends[of_text[:-1]], np.diff(of_text))  # from a place among split ids to one in out
        one = sizes == 1
        out[ends[:-1][one] + shift[one]] = self.flat[self.start[codes[one]]]
        many = np.flatnonzero(~one)
        inner = np.arange(sizes[many].sum()) - np.repeat(np.cumsum(sizes[many]) - sizes[many], sizes[many])
        out[np.repeat(ends[many] + shift[many], sizes[many]) + inner] = self.flat[np.repeat(self.start[codes[many]], sizes[many]) + inner]
        out[offsets[1:] - 1] = end
        for i, x in whole.items():
            out[offsets[i] : offsets[i + 1] - 1] = x
        return out, offsets

    def encode(self, texts: list[str | None] | pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, each text's followed by end, and len+1 offsets; null counts as empty."""
        texts = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts
        data, at = bytes_of(texts)
        ids, offsets, first = [np.zeros(0, np.uint32)], [np.zeros(1, np.int64)], 0
        while first < len(texts):
            last = max(first + 1, int(np.searchsorted(at, at[first] + GROUP_BYTES, side="right")) - 1)
            got, where = self._group(data[at[first] : at[last]], at[first : last + 1] - at[first], _Lazy(texts, first), end)
            ids.append(got)
            offsets.append(where[1:] + offsets[-1][-1])
            first = last
        return np.concatenate(ids), np.concatenate(offsets)


class _Lazy:
    """Texts by number, made Python strings only where asked for."""

    def __init__(self, texts: pa.Array, first: int):
        self.texts, self.first = texts, first

    def __getitem__(self, i: int) -> str:
        return self.texts[self.first + i].as_py()


def encoder(path: str) -> Encoder:
    """One per worker process and vocabulary file."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]
