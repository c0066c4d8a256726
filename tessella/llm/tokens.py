"""Token ids of many texts with a public tokenizer.

The tokenizer of ``word_bpe_49k.json`` drops white space and never joins across
it, so a text's ids are its white-space-separated words' ids in a row. Words
repeat; each is encoded once per Python worker and kept in a bounded store, keyed
by a 64-bit hash of its bytes and length. A batch of texts is hashed, looked up and
gathered in a few array operations. A test compares this with encoding whole texts.
"""

from __future__ import annotations

from itertools import chain

import numpy as np

from .shingles import word_bounds

TOKENIZER = "word_bpe_49k.json"
#: The byte-level alphabet: printable Latin-1 stands for itself, other bytes for characters from U+0100 on.
_SELF = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_LEVEL = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _SELF)}
_kept: dict[str, Words] = {}


class Words:
    """A tokenizer and the ids of words it has met; emptied beyond ``capacity`` words or ids."""

    def __init__(self, path: str, capacity: int = 1_040_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.capacity = Tokenizer.from_file(path), capacity
        self.tokenizer.encode_special_tokens = True
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.ends_word = np.zeros(self.vocabulary + 1, bool)
        self.ends_word[[i for w, i in self.tokenizer.get_vocab().items() if w.endswith("</w>")]] = True
        self.marks = {x: self.tokenizer.encode(x, add_special_tokens=False).ids if x else [] for x in ("", ".", ",")}
        self._empty()

    def _empty(self) -> None:
        # an open-addressing table from hashes (0: free) to places in starts and sizes; at most two thirds full
        self.keys = np.zeros(1 << (self.capacity * 3 // 2).bit_length(), np.uint64)
        self.place = np.zeros(len(self.keys), np.int32)
        self.n = 0
        self.starts, self.sizes = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)
        self.flat, self.used = np.zeros(1 << 18, np.uint16 if self.vocabulary <= 1 << 16 else np.uint32), 0

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Places of the words with these hashes; -1 for unknown ones."""
        mask = np.uint64(len(self.keys) - 1)
        at, left, out = (h & mask).astype(np.int64), np.arange(len(h)), np.full(len(h), -1, np.int64)
        while len(left):
            key = self.keys[at]
            hit = key == h[left]
            out[left[hit]] = self.place[at[hit]]
            going = ~hit & (key != 0)
            left, at = left[going], (at[going] + 1) & int(mask)
        return out

    def _add(self, h: np.ndarray, first: int) -> None:
        keys, place, mask = self.keys, self.place, len(self.keys) - 1
        for k, x in enumerate(h.tolist(), first):
            at = x & mask
            while keys[at]:
                at = (at + 1) & mask
            keys[at], place[at] = x, k

    def _encode_distinct(self, words: list[str]) -> list[list[int]]:
        """Ids of each word. Words of Latin-1 letters are single pieces, so the model can take them as they are, byte by byte."""
        out, rest, model = [], [], self.tokenizer.model
        for w in words:
            if w.isalpha() and max(w) < "\u0100":
                out.append([t.id for t in model.tokenize(w if w.isascii() else w.encode().decode("latin-1").translate(_BYTE_LEVEL))])
            else:
                out.append(None)
                rest.append(w)
        more = iter(self.tokenizer.encode_batch_fast(rest, add_special_tokens=False))
        return [next(more).ids if x is None else x for x in out]

    def _learn(self, words: list[str], h: np.ndarray) -> None:
        """Stores new words with these hashes. A word of plain letters with a full stop or comma is two pieces, and case is dropped."""
        stems, ends = [], []
        for w in words:
            end = w[-1] if w[-1] in ".," else ""
            stem = w[:-1] if end else w
            plain = stem.isalpha() and max(stem) < "\u0100"
            stems.append(stem.lower() if plain else w)
            ends.append(end if plain else "")
        distinct = list(dict.fromkeys(stems))
        of = word_bounds([x.encode() for x in distinct])[1]
        of[of == 0] = 1
        at = self._find(of)
        ids: dict[str, list[int]] = {}
        new = [w for w, k in zip(distinct, at.tolist(), strict=True) if k < 0]
        for w, k in zip(distinct, at.tolist(), strict=True):
            if k >= 0:
                x = int(self.starts[k])
                ids[w] = self.flat[x : x + int(self.sizes[k])].tolist()
        ids.update(zip(new, self._encode_distinct(new), strict=True))
        # stems that are not among the words are stored too
        own = dict(zip(h.tolist(), range(len(words)), strict=True))
        more = [(w, k) for w, k in zip(new, of[at < 0].tolist(), strict=True) if k not in own]
        got = [ids[stem] + self.marks[end] for stem, end in zip(stems, ends, strict=True)] + [ids[w] for w, _ in more]
        h = np.concatenate([h, np.array([k for _, k in more], np.uint64)])
        self._keep(h, got)

    def _keep(self, h: np.ndarray, got: list[list[int]]) -> None:
        """Stores the ids of words with these hashes, in the places that follow the last one's."""
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        n, total = self.n, int(sizes.sum())
        while n + len(got) > len(self.starts):
            self.starts, self.sizes = np.concatenate([self.starts, self.starts]), np.concatenate([self.sizes, self.sizes])
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, self.flat])
        self.flat[self.used : self.used + total] = np.fromiter(chain.from_iterable(got), self.flat.dtype, total)
        self.sizes[n : n + len(got)] = sizes
        self.starts[n : n + len(got)] = self.used + np.cumsum(sizes) - sizes
        self.used += total
        self.n += len(got)
        if self.n * 4 <= len(self.keys) * 3:  # else this batch's words are used once and then dropped
            self._add(h, n)

    def encode(self, texts: list[str | None], chunk: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row (uint32) and where each begins; one more offset than texts. About ``chunk`` characters are worked on at a time."""
        ids, offsets, at = [], [np.zeros(1, np.int64)], 0
        while at < len(texts):
            stop, size = at, 0
            while stop < len(texts) and (stop == at or size + len(texts[stop] or "") <= chunk):
                size += len(texts[stop] or "")
                stop += 1
            own, ends = self._encode(texts[at:stop])
            ids.append(own)
            offsets.append(ends[1:] + offsets[-1][-1])
            at = stop
        return np.concatenate(ids) if ids else np.zeros(0, np.uint32), np.concatenate(offsets)

    def _bounds(self, texts: list[str | None]):
        """The texts as one array of bytes; hashes, starts and ends of their words; and how many each has."""
        raw = [x.encode("utf-8", "replace") if x else b"" for x in texts]
        # the tokenizer lower-cases after composing characters, so texts with combining marks keep their case here
        return word_bounds([x if b"\xcc" in x or b"\xcd" in x else x.lower() for x in raw])

    def _places(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Places of all words in a row, new ones stored now, and how many each text has."""
        data, h, starts, ends, counts = self._bounds(texts)
        h[h == 0] = 1
        at = self._find(h)
        missing = at < 0
        if missing.any():
            new, first, where = np.unique(h[missing], return_index=True, return_inverse=True)
            if self.n + len(new) > self.capacity or self.used > 8 * self.capacity:
                self._empty()
                missing[:] = True
                new, first, where = np.unique(h, return_index=True, return_inverse=True)
            here = np.flatnonzero(missing)[first]
            before = self.n
            buffer = data.tobytes()
            self._learn([buffer[x:y].decode() for x, y in zip(starts[here].tolist(), ends[here].tolist(), strict=True)], new)
            at[missing] = before + where
        return at, counts

    def _encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        at, counts = self._places(texts)
        sizes = self.sizes[at].astype(np.int64)
        stops = np.cumsum(sizes)
        total = int(stops[-1]) if len(stops) else 0
        ids = self.flat[np.repeat(self.starts[at] - (stops - sizes), sizes) + np.arange(total)].astype(np.uint32)
        offsets = np.concatenate([[0], np.concatenate([[0], stops])[np.cumsum(counts)]]).astype(np.int64)
        return ids, offsets


def words_of(name: str = TOKENIZER) -> Words:
    """This worker's store for a tokenizer file of the public set, or for a path to one."""
    if name not in _kept:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if "/" in name:
            path = name
        else:
            import public_tokenizers

            path = public_tokenizers.path(name)
        _kept[name] = Words(path)
    return _kept[name]


def tidy() -> None:
    """Gives memory that Arrow and the allocator hold but no longer need back to the system; idle workers stay small."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not every C library has it
        pass
