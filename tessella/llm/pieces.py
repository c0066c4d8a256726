"""Exact encoding and decoding with a merge-type piece model, by backtracking over longest matches.

Merging takes, of all neighbouring symbols that join to a piece, the pair with the best
score, the leftmost of equals. A sequence of pieces is what merging gives if and only if
each piece, and each two neighbours, come back from merging their own characters:
the merges of a text, up to the first that would cross a border between pieces, are
those of the neighbours on both sides of it. So no text needs to be merged. ``Pieces``
finds the longest piece at a place with an Aho-Corasick automaton, accepts it if it fits the one
before (the two are merged again; results are kept), falls back to
the next shorter piece that is its prefix if not, and steps back where none fits.
A prefix of a text has one encoding, so a place that was left can't be a border: a bit field
holds these places, and every place is left once at most, which makes the walk linear.

No merge crosses two characters that are neighbours in no piece (such as a letter and a space), so a text's units between
such places are encoded on their own. ``Units`` keeps the ids of those it has met in the
bounded store of ``tokens.Words``, and hashes, looks up and gathers a batch of texts in a few array operations.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from .shingles import unit_hashes
from .tokens import Words

PIECES, BYTES = "piece_bpe_32k.model", "byte_bpe_50k.json"
SPACE = "▁"
#: Fixed values of Unicode: the first two of the three bytes of white space from U+1680 on.
_MAY_BE_SPACE = np.array([0xE19A, 0xE280, 0xE281, 0xE380])
_ASCII_SPACE = np.zeros(256, bool)
_ASCII_SPACE[[9, 10, 11, 12, 13, 32]] = True
_PLAIN, _MARK, _CONTROL = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_CONTROL[28:32] = True
_PLAIN[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_MARK[33:127] = ~_PLAIN[33:127]
_kept: dict[tuple, object] = {}  # of this worker


def model_path(name: str) -> str:
    """A file of the public set by its name; anything with a slash is a path."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class Pieces:
    """The pieces of a merge-type model without normalisation, with byte fallback and a space put before each text."""

    def __init__(self, path: str, kept_pairs: int = 1 << 20):
        import ahocorasick
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        if model.normalize(" ﬁ  x ") != f"{SPACE}{SPACE}ﬁ{SPACE}{SPACE}x{SPACE}":
            raise ValueError(f"{path}: texts are normalised in a way that is not built here")
        self.vocabulary, self.end, self.kept_pairs, self.library = n, model.eos_id(), kept_pairs, model
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) for i in range(n)]
        self.text = [model.id_to_piece(i) for i in range(n)]
        self.byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if not all(model.is_byte(i) for i in self.byte_ids):
            raise ValueError(f"{path}: no byte fallback")
        #: what each id adds to a text's bytes, nothing for special ones
        self.raw = [b"" if special[i] else self.text[i].replace(SPACE, " ").encode() for i in range(n)]
        for b, i in enumerate(self.byte_ids):
            self.raw[i] = bytes([b])
        ids = {self.text[i]: i for i in range(n) if not special[i]}
        self.score = {x: model.get_score(i) for x, i in ids.items()}
        # characters that occur in pieces only count as symbols, but are bytes in the end
        self.bare = {}
        for c in sorted({c for x in ids for c in x} - ids.keys()):
            self.bare[n + len(self.bare)] = c
        names = ids | {c: i for i, c in self.bare.items()}
        self.text += list(self.bare.values())
        names = {x: i for x, i in names.items() if self.merged(x) == [x]}  # no other piece can be a result
        self.automaton = ahocorasick.Automaton()
        for x, i in names.items():
            self.automaton.add_word(x, i)
        self.automaton.make_automaton()
        self.longest = max(map(len, names), default=1)
        #: the longest piece that is a proper prefix of a piece, or -1
        self.shorter = [-1] * len(self.text)
        for x, i in names.items():
            self.shorter[i] = next((names[x[:k]] for k in range(len(x) - 1, 0, -1) if x[:k] in names), -1)
        self.sizes = [len(x) for x in self.text]
        self.pairs: dict[int, bool] = {}

    def merged(self, text: str) -> list[str]:
        """What merging gives, step by step; quadratic, for short texts."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, left: int, right: int) -> bool:
        """Whether merging the two pieces' characters gives the two pieces."""
        key = left << 32 | right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= self.kept_pairs:
                self.pairs.clear()
            a, b = self.text[left], self.text[right]
            known = self.pairs[key] = self.merged(a + b) == [a, b]
        return known

    def encode(self, text: str) -> list[int]:
        """Ids of a text in which spaces are marks already."""
        n, sizes, shorter, longest, find, pairs = len(text), self.sizes, self.shorter, self.longest, self.automaton.iter_long, self.pairs
        failed, any_failed = bytearray((n >> 3) + 1), False
        out: list[int] = []
        base = at = 0  # out[base:] are the pieces since the last character that no piece holds
        piece = None  # the candidate at this place, if it was set by a step back
        while at < n:
            if piece is None:
                end, piece = next(find(text, at, min(n, at + longest)), (-1, -1))
                if end + 1 - sizes[piece] != at:  # an unknown character: its bytes, and nothing joins with them
                    out += [-b - 1 for b in text[at].encode("utf-8", "surrogatepass")]
                    at, base, piece = at + 1, len(out), None
                    continue
            first = len(out) == base
            before = 0 if first else out[-1] << 32
            while piece >= 0:
                stop = at + sizes[piece]
                if not (any_failed and failed[stop >> 3] >> (stop & 7) & 1):
                    if first:
                        break
                    fits = pairs.get(before | piece)
                    if fits or (fits is None and self.fits(before >> 32, piece)):
                        break
                piece = shorter[piece]
            if piece >= 0:
                out.append(piece)
                at, piece = stop, None
                continue
            if first:
                raise AssertionError("a text without an encoding")
            failed[at >> 3] |= 1 << (at & 7)
            any_failed = True
            last = out.pop()
            at -= sizes[last]
            piece = shorter[last]
        if self.bare or any(x < 0 for x in out):
            return [y for x in out for y in ([self.byte_ids[-x - 1]] if x < 0 else [x] if x < self.vocabulary else [self.byte_ids[b] for b in self.bare[x].encode()])]
        return out

    def decode_bytes(self, ids: list[int]) -> bytes:
        """A text's bytes, with the space that was put before it."""
        return b"".join(map(self.raw.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        """The text: without the space before it, each invalid byte as U+FFFD."""
        return readable(self.decode_bytes(ids))


def readable(raw: bytes) -> str:
    """Text of bytes, with one leading space less and a U+FFFD for each byte that is no part of a character."""
    raw = raw.removeprefix(b" ")
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return "".join("�" if "\udc80" <= c <= "\udcff" else c for c in raw.decode("utf-8", "surrogateescape"))


class Units(Words):
    """Ids of texts whose units are encoded on their own: ``cut`` says where units begin, ``encode_units`` gives the ids of new ones."""

    def __init__(self, vocabulary: int, cut: Callable[[np.ndarray], np.ndarray], encode_units: Callable[[list[str]], list[list[int]]], capacity: int = 2_080_000):
        self.vocabulary, self.cut, self.encode_units, self.capacity = vocabulary, cut, encode_units, capacity
        self._empty()

    def _learn(self, words: list[str], h: np.ndarray) -> None:
        self._keep(h, self.encode_units(words))

    def _bounds(self, texts: list[str | None]):
        raw = [b" " + x.encode("utf-8", "replace") if x else b"" for x in texts]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw), np.uint8)
        first = np.cumsum(sizes) - sizes
        begins = self.cut(data)
        begins[first[sizes > 0]] = True
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], len(data)) if len(starts) else starts
        counts = np.diff(np.searchsorted(starts, np.append(first, len(data))))
        return data, unit_hashes(data, starts, ends), starts, ends, counts

    def _empty(self) -> None:
        super()._empty()
        self.emptied = getattr(self, "emptied", 0) + 1

    def _all_places(self, texts: list[str | None], chunk: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
        """``_places`` of many texts, about ``chunk`` characters at a time; at once if the store is too small to hold their units beside what it has."""
        for _ in range(2):
            before, found, at = self.emptied, [], 0
            while at < len(texts):
                stop, size = at, 0
                while stop < len(texts) and (stop == at or size + len(texts[stop] or "") <= chunk):
                    size += len(texts[stop] or "")
                    stop += 1
                found.append(self._places(texts[at:stop]))
                at = stop
            if self.emptied == before:  # else places found earlier are gone
                return np.concatenate([np.zeros(0, np.int64), *(p for p, _ in found)]), np.concatenate([np.zeros(0, np.int64), *(n for _, n in found)])
        return self._places(texts)

    def units(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The ids of the texts' distinct units in a row, and how many each unit has; then all units of all texts, by number, and how many each text has."""
        at, counts = self._all_places(texts)
        places, order = np.unique(at, return_inverse=True)
        sizes = self.sizes[places].astype(np.int64)
        stops = np.cumsum(sizes)
        total = int(stops[-1]) if len(stops) else 0
        return self.flat[np.repeat(self.starts[places] - (stops - sizes), sizes) + np.arange(total)].astype(np.int64), sizes, order, counts


def between_pieces(raw: list[bytes]) -> Callable[[np.ndarray], np.ndarray]:
    """Where characters begin that no piece holds right after the byte before: no merge can cross such a place."""
    apart = np.ones((256, 256), bool)
    for x in raw:
        apart[list(x[:-1]), list(x[1:])] = False
    apart[:, 0x80:0xC0] = False  # within a character

    def cut(data: np.ndarray) -> np.ndarray:
        out = np.ones(len(data), bool)
        out[1:] = apart[data[:-1], data[1:]]
        return out

    return cut


def between_runs(data: np.ndarray) -> np.ndarray:
    """Where a run of ASCII white space begins after a character that is none, or an ASCII mark after an ASCII letter or digit."""
    space, plain = _ASCII_SPACE[data], _PLAIN[data]
    out = space.copy()
    out[1:] = (space[1:] & ~space[:-1] & ~_CONTROL[data[:-1]]) | (_MARK[data[1:]] & plain[:-1])
    # after what may be white space beyond ASCII no unit begins
    out[2:] &= ~((data[:-2] == 0xC2) & ((data[1:-1] == 0x85) | (data[1:-1] == 0xA0)))
    three = data[:-3].astype(np.int32) << 8 | data[1:-2]
    out[3:] &= ~np.isin(three, _MAY_BE_SPACE)
    return out


def piece_model(name: str = PIECES) -> Pieces:
    """This worker's model for a file of the public set, or for a path to one."""
    key = ("model", name)
    if key not in _kept:
        _kept[key] = Pieces(model_path(name))
    return _kept[key]


def piece_units(name: str = PIECES) -> Units:
    """This worker's store of units of a piece model. A mark that a text itself holds counts as a space."""
    key = ("pieces", name)
    if key not in _kept:
        p = piece_model(name)
        inside = [y.encode() for x in p.score for y in (x, x.replace(SPACE, " "))]
        cut = between_pieces([*inside, f"{SPACE} {SPACE}".encode()])
        _kept[key] = Units(p.vocabulary, cut, lambda units: [p.encode(x.replace(" ", SPACE)) for x in units])
    return _kept[key]


def byte_model(name: str = BYTES):
    """This worker's byte-level tokenizer and each id's bytes."""
    key = ("bytes", name)
    if key not in _kept:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(model_path(name))
        t.encode_special_tokens = True
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in own)}
        tokens = [t.id_to_token(i) or "" for i in range(t.get_vocab_size())]
        _kept[key] = (t, [bytes(byte_of[c] for c in x) if all(c in byte_of for c in x) else x.encode() for x in tokens])
    return _kept[key]


class TwoWays(Units):
    """Units in two tokenizers: the ids of the first, then those of the second, which follow the first's.

    A byte-level tokenizer's pattern never takes what stands before a run of white space, or a letter before a mark, together with
    what follows; where no piece goes across either, both begin a new unit. Units whose tokens, joined, are not the unit have no ids.
    """

    def __init__(self, first: str = BYTES, second: str = PIECES, capacity: int = 1_040_000):
        (tokenizer, raw), pieces = byte_model(first), piece_model(second)
        self.first, self.raw = len(raw), raw + pieces.raw
        apart = piece_units(second).cut

        def encode(units: list[str]) -> list[list[int]]:
            out = []
            # the library puts a space before what it encodes, so it takes the units that begin with one
            spaced = [len(x) > 1 and x[0] == " " for x in units]
            ready = iter(pieces.library.encode([x[1:] for x, own in zip(units, spaced, strict=True) if own], num_threads=1))
            for x, own, e in zip(units, spaced, tokenizer.encode_batch_fast(units, add_special_tokens=False), strict=True):
                b, whole = next(ready) if own else pieces.encode(x.replace(" ", SPACE)), x.encode()
                good = b"".join(map(raw.__getitem__, e.ids)) == whole == pieces.decode_bytes(b)
                out.append(e.ids + [i + self.first for i in b] if good else [])
            return out

        super().__init__(len(self.raw), lambda data: apart(data) & between_runs(data), encode, capacity)


def two_ways(first: str = BYTES, second: str = PIECES) -> TwoWays:
    """This worker's store of units in two tokenizers."""
    key = ("both", first, second)
    if key not in _kept:
        _kept[key] = TwoWays(first, second)
    return _kept[key]
