"""Encoding whole texts with the tokenizers library, through a cache of pieces.

A text is cut where the tokenizer's own pre-tokenizer always cuts, each distinct piece is encoded once by the library, and
the ids are gathered. A text that doesn't fit the simple shape (other white space than single spaces and line feeds
between words, or a special token's string) is encoded whole, so ids never differ from the library's.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .shared import text_buffers

#: Pieces kept at most; beyond, all are forgotten and learnt anew.
CACHE = 1_200_000
#: White space in some library's sense other than space and line feed, two of them in a row, and what opens a special token.
_UNUSUAL = [*"\t\x0b\x0c\r\x1c\x1d\x1e\x1f", "  ", " \n", "\n ", "\n\n", "<|"]
_UNUSUAL_WIDE = [*"\x85\xa0\u1680\u180e\u2028\u2029\u202f\u205f\u3000\ufeff", *map(chr, range(0x2000, 0x200C))]


#: ASCII marks that end a word.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


#: First bytes of what may be unusual: a text that has one is looked at more closely.
_LOOK = np.zeros(256, bool)
_LOOK[[9, 11, 12, 13, 28, 29, 30, 31, ord("<"), 0xC2, 0xE1, 0xE2, 0xE3, 0xEF]] = True


def _simple(text: str) -> bool:
    """Words parted by single spaces or line feeds, with no other white space and no special token's string."""
    if text[0] in " \n" or text[-1] in " \n" or any(x in text for x in _UNUSUAL):
        return False
    return text.isascii() or not any(x in text for x in _UNUSUAL_WIDE)


def _unusual_rows(col: pa.Array, latin: bool) -> np.ndarray:
    """Rows that must be encoded whole; with latin, also those with letters beyond U+00FF. Empty texts are among them."""
    raw, offsets = text_buffers(col)
    out = np.diff(offsets) == 0
    if not len(raw):
        return out
    gap = (raw == 32) | (raw == 10)
    twice = np.flatnonzero(gap[1:] & gap[:-1])
    edges = np.concatenate((offsets[:-1][~out], offsets[1:][~out] - 1))
    certain = np.concatenate((twice, edges[gap[edges]]))
    if latin:
        certain = np.concatenate((certain, np.flatnonzero(raw >= 0xC4)))
    out[np.unique(np.searchsorted(offsets, certain, "right") - 1)] = True
    for i in np.unique(np.searchsorted(offsets, np.flatnonzero(_LOOK[raw]), "right") - 1).tolist():
        if not out[i]:
            out[i] = not _simple(col[i].as_py())
    return out


class Encoder:
    """ids of texts as one array and each text's count of them."""

    def __init__(self, path: str, spaced: bool, cache: int = CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.spaced, self.cache = spaced, cache
        self.lowers = self.library.normalizer is not None and self.library.normalizer.normalize_str("AÀ") == "aà"
        vocab = self.library.get_vocab(with_added_tokens=False)
        self.id_bytes = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            self.id_bytes[i] = len(token.removesuffix("</w>"))
        self._reset()

    def _reset(self) -> None:
        self.known = pa.array([], pa.large_string())
        self.flat = np.zeros(1 << 16, np.uint32)
        self.start = np.zeros(1 << 16, np.int64)
        self.size = np.zeros(1 << 16, np.int64)
        self.used = 0
        self.marks: dict[str, int] = {}

    def _raw(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _bytes_of(self, pieces: list[str]) -> tuple[str, list[int]]:
        """Pieces as one text, and the bytes of each that its ids stand for."""
        if self.spaced:
            return "".join(pieces), [len(p.encode("utf-8", "surrogatepass")) for p in pieces]
        text = " ".join(pieces)
        plain = self.library.normalizer.normalize_str(text) if self.library.normalizer else text
        return text, [len(p.encode("utf-8", "surrogatepass")) for p in plain.split(" ")]

    def _joined(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """ids and counts of pieces encoded as one text; None unless the ids' bytes meet every piece's end."""
        parts = [self._bytes_of(pieces[a : a + 4096]) for a in range(0, len(pieces), 4096)]
        made = self._raw([t for t, _ in parts])
        ids = np.concatenate([np.array(r, np.uint32) for r in made])
        ends = np.cumsum([n for _, sizes in parts for n in sizes])
        if len(ends) != len(pieces) or (len(ids) and int(ids.max()) >= len(self.id_bytes)):
            return None
        met = np.cumsum(self.id_bytes[ids])
        at = np.searchsorted(met, ends)
        if not len(met) or met[-1] != ends[-1] or not np.array_equal(met[np.minimum(at, len(met) - 1)], ends):
            return None
        return ids, np.diff(at + 1, prepend=0)

    def _encode_new(self, pieces: pa.Array) -> int:
        """Encodes and stores pieces; gives the index of the first."""
        base, texts = len(self.known), pieces.to_pylist()
        got = self._joined(texts) if not self.spaced or all(p[:1] in (" ", "\n") for p in texts) else None
        if got is None:
            rows = self._raw(texts)
            got = np.fromiter((x for r in rows for x in r), np.uint32, sum(map(len, rows))), np.array([len(r) for r in rows], np.int64)
        self._store(pieces, *got)
        return base

    def _mark_places(self, marks: list[str]) -> np.ndarray:
        """Indexes of runs of marks behind words: few kinds, each encoded once."""
        if fresh := [m for m in dict.fromkeys(marks) if m not in self.marks]:
            base = len(self.known)
            rows = self._raw(fresh)
            # stored under a name that no piece has (a blank within), as they are pieces only behind a word
            self._store(pa.array([f"mark {m}" for m in fresh], pa.large_string()), np.array([x for r in rows for x in r], np.uint32), np.array([len(r) for r in rows], np.int64))
            self.marks.update(zip(fresh, range(base, base + len(fresh)), strict=True))
        return np.fromiter(map(self.marks.__getitem__, marks), np.int64, len(marks))

    def _store(self, pieces: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> None:
        base = len(self.known)
        need, rows = self.used + len(ids), base + len(pieces)
        while need > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        while rows > len(self.start):
            self.start, self.size = (np.concatenate((x, np.zeros_like(x))) for x in (self.start, self.size))
        self.flat[self.used : need] = ids
        self.size[base:rows] = sizes
        self.start[base:rows] = self.used + np.cumsum(sizes) - sizes
        self.used = need
        self.known = pa.concat_arrays([self.known, pieces])

    def _places(self, keys: pa.Array) -> np.ndarray:
        """Indexes of distinct pieces; new ones are learnt.

        A pre-token ends between a letter and a mark, so a word and the marks behind it are learnt apart.
        """
        words = pc.utf8_rtrim(keys, characters=_MARKS)
        both = pc.fill_null(pc.index_in(pa.concat_arrays([keys, words]), value_set=self.known), -1).to_numpy().astype(np.int64)
        at, of_word = both[: len(keys)], both[len(keys) :]
        absent = np.flatnonzero(at < 0)
        if not len(absent):
            return at
        keys, words, of_word = keys.take(pa.array(absent)), words.take(pa.array(absent)), of_word[absent]
        marked = pc.less(pc.binary_length(words), pc.binary_length(keys)).to_numpy(zero_copy_only=False) & pc.match_substring_regex(words, r"\pL$").to_numpy(zero_copy_only=False)
        rest = keys.filter(pa.array(~marked))
        fresh = pc.unique(pa.concat_arrays([rest, words.filter(pa.array(marked & (of_word < 0)))]))
        base = self._encode_new(fresh) if len(fresh) else len(self.known)
        place = np.empty(len(absent), np.int64)
        place[~marked] = base + pc.index_in(rest, value_set=fresh).to_numpy()
        if marked.any():
            parted, word = keys.filter(pa.array(marked)), words.filter(pa.array(marked))
            here = pc.fill_null(pc.index_in(word, value_set=fresh), -1).to_numpy() if len(fresh) else np.full(len(word), -1)
            w = np.where(here >= 0, base + here, of_word[marked])
            m = self._mark_places([k[len(x) :] for k, x in zip(parted.to_pylist(), word.to_pylist(), strict=True)])
            two = np.stack((w, m), 1).ravel()
            size, start = self.size[two], self.start[two]
            ids = self.flat[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
            place[marked] = len(self.known) + np.arange(len(parted))
            self._store(parted, ids, size[0::2] + size[1::2])
        at[absent] = place
        return at

    def _pieces(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Each piece's index, and the bounds of each text's pieces."""
        if self.lowers:
            col = pc.utf8_lower(col)
        col = pc.replace_substring(col, "\n", " \n" if self.spaced else " ")
        lists = pc.split_pattern(col, " ")
        bounds = lists.offsets.to_numpy().astype(np.int64)
        flat = lists.flatten()
        coded = pc.dictionary_encode(flat)
        distinct, which = coded.dictionary, coded.indices.to_numpy()
        bounds = bounds - bounds[0]
        if not self.spaced:
            return self._places(distinct)[which], bounds
        # the blank before a word belongs to it, but for a text's first word
        blank = pc.if_else(pc.starts_with(distinct, "\n"), distinct, pc.binary_join_element_wise(pa.scalar("", pa.large_string()), distinct, pa.scalar(" ", pa.large_string())))
        first = pc.dictionary_encode(flat.take(pa.array(bounds[:-1])))
        at = self._places(blank)[which]
        at[bounds[:-1]] = self._places(first.dictionary)[first.indices.to_numpy()]
        return at, bounds

    def encode(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts of a string array without nulls, one after another, and each text's number of them."""
        if len(self.known) > self.cache:
            self._reset()
        whole = _unusual_rows(col, self.lowers)
        ids, counts = np.zeros(0, np.uint32), np.zeros(len(col), np.int64)
        plain = np.flatnonzero(~whole)
        if len(plain):
            at, bounds = self._pieces(col if len(plain) == len(col) else col.take(pa.array(plain)))
            size, start = self.size[at], self.start[at]
            ends = np.cumsum(size)
            ids = self.flat[np.repeat(start - (ends - size), size) + np.arange(int(ends[-1]))]
            upto = np.concatenate((np.zeros(1, np.int64), ends))
            counts[plain] = upto[bounds[1:]] - upto[bounds[:-1]]
        if len(plain) < len(col):
            rest = np.flatnonzero(whole)
            rows = self._raw(col.take(pa.array(rest)).to_pylist())
            counts[rest] = [len(r) for r in rows]
            ends = np.cumsum(counts)
            out = np.empty(int(ends[-1]), np.uint32)
            took = np.repeat(~whole, counts)
            out[took] = ids
            out[~took] = [x for r in rows for x in r]
            ids = out
        return ids, counts


_MADE: dict[tuple, Encoder] = {}


def encoder(path: str, spaced: bool, cache: int = CACHE) -> Encoder:
    """This process's encoder for a vocabulary file."""
    key = (path, spaced, cache)
    if key not in _MADE:
        _MADE.clear()
        _MADE[key] = Encoder(*key)
    return _MADE[key]


def text_slices(col: pa.Array, limit: int = 10 << 20):
    """(first, array) of runs of texts of about `limit` bytes, at least one text each; nulls are empty texts."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()), "")
    _, offsets = text_buffers(col)
    a, n = 0, len(col)
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, pa.concat_arrays([col.slice(a, b - a)])
        a = b


def gathered(batches, limit: int = 10 << 20):
    """Record batches joined until they hold about `limit` bytes: the more texts at a time, the fewer pieces are looked up. Memory of the last goes back before the next."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= limit:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
            pa.default_memory_pool().release_unused()
    if size:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
