"""Exact token ids at cache speed.

A text's ids are the ids of pieces that the tokenizer's pre-tokenizer never joins: runs between ASCII
white space, with one leading space where the vocabulary marks spaces; a run of letters and the
punctuation that ends it are two pieces. Pieces of many texts are cut in one pass over their bytes,
told apart in Arrow, and only those not met before go through the tokenizers library, once for each
worker. Texts for which the cut would not be safe (special tokens' strings, white space outside ASCII
where it counts) go through it whole.
"""

from __future__ import annotations

import os
import re

#: Latin-1 letters are \xc3 and one byte; × and ÷ (\x97, \xb7) are none.
_LETTERS = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
#: White space outside ASCII, in UTF-8.
_OTHER_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
_SPACE, _LETTER, _MARK, _OTHER = range(4)
_coders: dict[tuple[str, bool], UnitCoder] = {}


def coder(path: str, spaced: bool) -> UnitCoder:
    """This worker's coder for a tokenizer file. spaced: the vocabulary keeps white space (byte-level)."""
    if (path, spaced) not in _coders:
        _coders.clear()
        _coders[path, spaced] = UnitCoder(path, spaced)
    return _coders[path, spaced]


def raw(column):
    """(bytes, offsets) of an Arrow column of strings; nulls are empty."""
    import numpy as np
    import pyarrow as pa

    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, "i8")[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, "i8")
    data = np.frombuffer(data, "u1") if data is not None else np.zeros(0, "u1")
    return data[at[0] : at[-1]], at - at[0]


class UnitCoder:
    """Known pieces (keys) with the place and number of their ids; at most `most` of them, and `most_bytes` of their bytes, survive a call."""

    def __init__(self, path: str, spaced: bool, most: int = 600_000, most_bytes: int = 12 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import numpy as np
        import pyarrow as pa
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.spaced, self.most, self.most_bytes = spaced, most, most_bytes
        self.special = [t.content.encode() for t in self.model.get_added_tokens_decoder().values()]
        #: Ids that end a word, or for a vocabulary with marked spaces, that begin one after a space.
        self.edge = np.zeros(self.model.get_vocab_size(with_added_tokens=True), bool)
        for token, i in self.model.get_vocab().items():
            self.edge[i] = token.startswith("Ġ") if spaced else token.endswith("</w>")
        kind = np.full(256, _OTHER, np.uint8)
        for span, k in ((b" \t\n\v\f\r", _SPACE), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", _LETTER), (b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", _MARK)):
            kind[np.frombuffer(span, np.uint8)] = k
        self.kind = kind
        self.lower = np.arange(256, dtype=np.uint8)
        if not spaced:
            self.lower[65:91] += 32
        self.keys = pa.array([b""], pa.large_binary())  # the first is never cut from a text and has no ids
        self.starts, self.sizes, self.used = (np.zeros(1, t) for t in ("i8", "i4", "i4"))
        self.ids, self.calls = np.zeros(0, "u4"), 0

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[bytes]) -> tuple[list[int], list, list]:
        """An order of pieces, arrays of their ids one after the other in it, and arrays of the number of ids of each. Words of letters alone
        go many to a text; the vocabulary's marks of a word's edge tell them apart."""
        import numpy as np

        word, lead, order, flat, sizes = _LETTERS.fullmatch, 32 if self.spaced else 0, [], [], []
        simple = [bool(word(p)) and len(p) <= 48 and (p[0] == 32) == (lead == 32) for p in pieces]
        words, odd = [i for i, x in enumerate(simple) if x], [i for i, x in enumerate(simple) if not x]
        glue = b"" if self.spaced else b" "
        for k in range(0, len(words), 256):
            part = words[k : k + 256]
            ids = np.array(self._ids([glue.join([pieces[i] for i in part]).decode()])[0], "u4")
            edges = np.flatnonzero(self.edge[ids])
            if len(edges) != len(part):
                odd += part
                continue
            order += part
            flat.append(ids)
            sizes.append(np.diff(np.append(edges, len(ids)) if self.spaced else np.append(-1, edges)))
        for k in range(0, len(odd), 4096):
            part = odd[k : k + 4096]
            found = self._ids([pieces[i].decode() for i in part])
            order += part
            flat.append(np.array([x for ids in found for x in ids], "u4"))
            sizes.append(np.array([len(ids) for ids in found], "i8"))
        return order, flat, sizes

    def _cuts(self, data, offsets):
        """Where pieces begin in data, texts being data[offsets[i] : offsets[i + 1]]; white space that has no ids may be pieces of its own."""
        import numpy as np

        kind = self.kind[data]
        c3 = np.flatnonzero(data[:-1] == 0xC3)
        if len(c3):
            c3 = c3[(data[c3 + 1] != 0x97) & (data[c3 + 1] != 0xB7)]
            kind[c3] = kind[c3 + 1] = _LETTER
        first = np.zeros(len(data) + 1, bool)
        first[offsets] = True
        first = first[:-1]
        blank = kind == _SPACE
        before = np.empty(len(data), bool)  # is the byte before, in the same text, white space
        before[0] = False
        before[1:] = blank[:-1]
        before[first] = False
        if self.spaced:
            plain = np.empty(len(data), bool)
            plain[0] = False
            plain[1:] = data[:-1] == 32
            follows = np.zeros(len(data), bool)  # a word follows in the same text
            follows[:-1] = ~blank[1:] & ~first[1:]
            begin = np.where(blank, ~before | follows, before & ~plain) | first
        else:
            begin = first | (blank != before) & (blank | before)
        units = np.flatnonzero(begin)
        kept = np.empty(len(data), np.uint8)
        kept[0] = _SPACE
        kept[1:] = kind[:-1]
        kept[first] = _SPACE
        mark = kind == _MARK
        cut = np.flatnonzero(mark & (kept == _LETTER))
        bad = np.flatnonzero((kind == _OTHER) | (kind == _LETTER) & (kept == _MARK))
        if len(bad) and len(cut):
            spoilt = np.zeros(len(units), bool)
            spoilt[np.searchsorted(units, bad, side="right") - 1] = True
            cut = cut[~spoilt[np.searchsorted(units, cut, side="right") - 1]]
        begin[cut] = True
        return np.flatnonzero(begin)

    def encode_column(self, column):
        """(ids of all texts of an Arrow column in a row, where each text's begin and the last's end)."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        data, offsets = raw(column)
        if not len(data):
            return np.zeros(0, "u4"), np.zeros(len(offsets), "i8")
        whole = set()
        held = data.tobytes()
        for s in self.special:
            at = held.find(s)
            while at >= 0:
                whole.add(int(np.searchsorted(offsets, at, side="right")) - 1)
                at = held.find(s, at + 1)
        if self.spaced:
            for m in _OTHER_SPACE.finditer(held):
                whole.add(int(np.searchsorted(offsets, m.start(), side="right")) - 1)
        begins = self._cuts(data, offsets)
        if not self.spaced:
            held = self.lower[data].tobytes()
        ends = np.append(begins[1:], len(data))
        if whole:
            keep = np.ones(len(begins), bool)
            for i in whole:
                keep[np.searchsorted(begins, offsets[i]) : np.searchsorted(begins, offsets[i + 1])] = False
        pieces = pa.Array.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(np.append(begins, len(data)).astype("i8")), pa.py_buffer(held)])
        coded = pc.dictionary_encode(pieces)
        distinct, which = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        known = pc.index_in(distinct, value_set=self.keys)
        unknown = np.zeros(len(distinct), bool)
        if known.null_count:
            unknown = known.is_null().to_numpy(zero_copy_only=False).copy()
            if whole:  # pieces of such texts alone may be anything
                wanted = np.zeros(len(distinct), bool)
                wanted[which[keep]] = True
                unknown &= wanted
            known = known.fill_null(0)
        known = known.to_numpy(zero_copy_only=False)
        if unknown.any():
            fresh = distinct.filter(pa.array(unknown))
            order, flat, sizes = self._learn(fresh.to_pylist())
            sizes = np.concatenate(sizes)
            base, stops = len(self.keys), len(self.ids) + np.cumsum(sizes)
            self.ids = np.concatenate([self.ids, *flat])
            self.keys = pa.concat_arrays([self.keys, fresh.take(pa.array(order, pa.int64()))])
            self.starts = np.concatenate([self.starts, stops - sizes])
            self.sizes = np.concatenate([self.sizes, sizes.astype("i4")])
            self.used = np.concatenate([self.used, np.zeros(len(sizes), "i4")])
            known = known.copy()
            known[np.flatnonzero(unknown)[order]] = np.arange(base, base + len(sizes), dtype=known.dtype)
        self.calls += 1
        self.used[known] = self.calls
        self.used[0] = np.iinfo("i4").max
        at = known[which]
        n = self.sizes[at].astype("i8")
        if whole:
            n[~keep] = 0
        stops = np.cumsum(n)
        ids = self.ids[np.repeat(self.starts[at] - stops + n, n) + np.arange(stops[-1])]
        bounds = np.concatenate([[0], stops])[np.searchsorted(begins, offsets)]
        if whole:
            parts = [ids[bounds[i] : bounds[i + 1]] for i in range(len(offsets) - 1)]
            texts = column.fill_null("")
            for i in whole:
                parts[i] = np.array(self._ids([texts[i].as_py()])[0], "u4")
            ids, bounds = np.concatenate(parts), np.cumsum([0, *map(len, parts)])
        self._forget()
        return ids.astype("<u4", copy=False), bounds

    def _forget(self) -> None:
        """Beyond the limits, keep the pieces met most lately, up to half of either."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        if len(self.keys) <= self.most and self.keys.nbytes <= self.most_bytes:
            return
        bytes_of = pc.binary_length(self.keys).to_numpy(zero_copy_only=False)
        order = np.argsort(-self.used, kind="stable")
        order = order[bytes_of[order] <= 64][: self.most // 2]
        order = np.sort(order[np.cumsum(bytes_of[order] + 8) <= self.most_bytes // 2])
        n, starts = self.sizes[order].astype("i8"), self.starts[order]
        stops = np.cumsum(n)
        self.ids = self.ids[np.repeat(starts - stops + n, n) + np.arange(stops[-1] if len(stops) else 0)]
        self.keys, self.sizes, self.used, self.starts = self.keys.take(pa.array(order)), self.sizes[order], self.used[order], stops - n

    def encode(self, texts) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        import pyarrow as pa

        ids, at = self.encode_column(pa.array(list(texts), pa.string()))
        data, at = ids.tobytes(), (4 * at).tolist()
        return [data[a:b] for a, b in zip(at, at[1:])]


def text_batches(batch, column: str = "text", most_bytes: int = 4 << 20):
    """(first row, column of texts) of slices of an Arrow batch that hold about most_bytes, one text at least."""
    import numpy as np

    texts = batch.column(column)
    sizes = np.cumsum(np.diff(raw(texts)[1]))
    at = 0
    while at < len(texts):
        done = sizes[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(sizes, done + most_bytes, side="right")))
        yield at, texts.slice(at, end - at)
        at = end
