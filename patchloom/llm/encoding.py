"""Token ids of whole texts by the tokenizers library, with a bounded memory of pieces already encoded."""

from __future__ import annotations

import os
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import chain, count, islice, pairwise

import numpy as np

#: Unicode White_Space, which the tokenizers' patterns split on (Python's own \s has other members).
_SPACE = "\t-\r \x85\xa0  -     　"
_WITH_SPACE = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
_WITHOUT_SPACE = re.compile(f"[^{_SPACE}]+")
_CUT = re.compile(f"(?<=[^{_SPACE}])[{_SPACE}]")
_SEPARATOR = "\x01"
_PART = 1_000_000  # characters of a text that are cut into pieces at once
_LONG = 48  # characters of a piece that is worth keeping
_ENCODERS: dict[tuple, PieceEncoder] = {}


class PieceEncoder:
    """Encodes a text as its pieces, cut before each run of white space; a piece seen before is not encoded again.

    No pre-token of the supported tokenizers reaches across such a cut: byte-level BPE takes white space only at the
    start of a pre-token (keep_space), and BPE with word ends drops white space. So the joined ids are those of the
    whole text. A new piece of letters is one pre-token and goes to the tokenizer's model; other new pieces go to the
    tokenizer many at a time in one string, and its ids are dealt back: by the tokens' lengths in bytes for byte-level
    BPE, and by a separator otherwise. A text that holds a special token's string is encoded whole, as the library does
    by itself: as that token, or as ordinary text with special_as_text. The memory holds about max_pieces pieces, and
    its older half, which has the frequent ones, stays when it is full.
    """

    def __init__(self, path: str, keep_space: bool, dtype: str, max_pieces: int = 500_000, special_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        specials = [token.content.lower() for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = os.path.commonprefix(specials)
        self.has_special = bool(specials)
        self.keep_space = keep_space
        self.find = (_WITH_SPACE if keep_space else _WITHOUT_SPACE).findall
        self.dtype, self.max_pieces = dtype, max_pieces
        vocabulary = self.tokenizer.get_vocab()
        self.lengths = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.lengths[list(vocabulary.values())] = [len(token) for token in vocabulary]  # a byte is a character there
        names = self._byte_names()
        self.byte_names = names if all(name in vocabulary for name in names.values()) else {}
        # A comma or full stop that ends a piece after a letter is a pre-token of its own.
        self.stops = {c: self._ids(c) for c in ",."}
        self.separator = np.array(self._ids(_SEPARATOR))
        self._forget({})

    def _byte_names(self) -> dict[int, str]:
        """The character that stands for each byte in the vocabulary of a byte-level tokenizer."""
        plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
        odd = count(256)
        return {b: chr(b) if b in plain else chr(next(odd)) for b in range(256)}

    def _forget(self, kept: dict[str, np.ndarray]) -> None:
        """Start the memory anew with the pieces kept."""
        self.index = defaultdict(count().__next__)
        for piece in kept:
            self.index[piece]
        self.sizes = np.array([len(ids) for ids in kept.values()], np.int64)
        self.flat = np.concatenate([np.zeros(0, self.dtype), *kept.values()])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.characters = sum(map(len, kept))

    def _shrink(self) -> None:
        if len(self.index) > self.max_pieces or self.characters > 16 * self.max_pieces:
            self.rest(self.max_pieces // 2)

    def rest(self, pieces: int = 100_000) -> None:
        """Keep so many of the pieces learnt first; a task does this at its end, as its worker lives on."""
        if len(self.index) > pieces:
            old = islice(zip(self.index, self.starts, self.sizes, strict=True), pieces)
            self._forget({p: self.flat[at : at + n] for p, at, n in old if len(p) <= _LONG})

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _dealt(self, pieces: list[str]) -> list[list[int]]:
        """Ids of each piece, from one call of the tokenizer."""
        if self.keep_space:
            ids = self._ids("".join(pieces))
            ends = np.cumsum([len(p.encode()) for p in pieces])
            reached = np.cumsum(self.lengths[ids])
            cuts = np.searchsorted(reached, ends) + 1
            if len(reached) and reached[-1] == ends[-1] and (reached[cuts - 1] == ends).all():
                return [ids[i:j] for i, j in pairwise([0, *cuts.tolist()])]
        elif len(self.separator) == 1 and not any(_SEPARATOR in p for p in pieces):
            ids = self._ids(f" {_SEPARATOR} ".join(pieces))
            cuts = np.flatnonzero(np.array(ids) == self.separator[0]).tolist()
            if len(cuts) == len(pieces) - 1:
                return [ids[i + 1 : j] for i, j in pairwise([-1, *cuts, len(ids)])]
        return [self._ids(p) for p in pieces]

    def _words(self, words: list[str]) -> list[list[int]]:
        """Ids of pieces of letters alone (after one space if keep_space), by the model of a byte-level vocabulary."""
        tokenize, names, normalizer = self.tokenizer.model.tokenize, self.byte_names, self.tokenizer.normalizer
        if normalizer is not None and words:
            normal = normalizer.normalize_str(" ".join(words)).split(" ")
            if len(normal) != len(words):
                return self._dealt(words)
            # A letter whose lower case has a mark would be cut there.
            odd = {i: self._ids(w) for i, (w, n) in enumerate(zip(words, normal, strict=True)) if not n.isascii() and not n.isalpha()}
            words = normal
        else:
            odd = {}
        if self.keep_space:
            words = [names[32] + w[1:] if w.isascii() else w.encode().decode("latin-1").translate(names) for w in words]
        else:
            words = [w if w.isascii() else w.encode().decode("latin-1").translate(names) for w in words]
        out = [[token.id for token in tokenize(w)] for w in words]
        for i, ids in odd.items():
            out[i] = ids
        return out

    def _learn(self, new: list[str]) -> None:
        """Ids of new pieces, appended in their order."""
        found: dict[str, list[int]] = {}
        stopped = {p for p in new if p[-1] in self.stops and len(p) > 1 and p[-2].isalpha() and p[-2].lower()[-1].isalpha()}
        bodies = dict.fromkeys(p[:-1] if p in stopped else p for p in new)
        if not self.byte_names:
            words = []
        elif self.keep_space:
            words = [p for p in bodies if p[0] == " " and p[1:].isalpha()]
        else:
            words = [p for p in bodies if p.isalpha()]
        found.update(zip(words, self._words(words), strict=True))
        rest = [p for p in bodies if p not in found]
        if self.keep_space:  # a piece at a text's start, or of white space alone, would merge with its neighbour
            alone = [p for p in rest if not p[0].isspace() or p[-1].isspace()]
            encodings = self.tokenizer.encode_batch_fast(alone, add_special_tokens=False)
            found.update((p, e.ids) for p, e in zip(alone, encodings, strict=True))
            rest = [p for p in rest if p not in found]
        at = 0
        while at < len(rest):
            low, size = at, 0
            while at < len(rest) and size < 65_536:
                size += len(rest[at])
                at += 1
            found.update(zip(rest[low:at], self._dealt(rest[low:at]), strict=True))
        ids = [found[p[:-1]] + self.stops[p[-1]] if p in stopped else found[p] for p in new]
        sizes = np.array([len(x) for x in ids], np.int64)
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids), self.dtype, int(sizes.sum()))])
        self.characters += sum(map(len, new))

    def _parts(self, text: str) -> Iterator[str]:
        """text in parts of about _PART characters, each cut before a run of white space."""
        at = 0
        while len(text) - at > _PART:
            cut = _CUT.search(text, at + _PART)
            if cut is None:
                break
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:] if at else text

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """Ids of each text (null: empty), as little-endian integers of dtype."""
        held: list[list[str]] = []
        ends: list[int] = []  # parts held at the end of each whole text
        kept, size = b"", 0
        for text in texts:
            text = text or ""
            if self.has_special and self.special in text.lower():
                yield from self._taken(held, ends, kept)
                held, ends, kept, size = [], [], b"", 0
                yield np.array(self._ids(text), self.dtype).tobytes()
                continue
            for part in self._parts(text):
                held.append(self.find(part))
                size += len(part)
                if size > 2 * _PART:
                    done = self._taken(held, [*ends, len(held)], kept)
                    yield from done[:-1]
                    held, ends, kept, size = [], [], done[-1], 0
            ends.append(len(held))
        yield from self._taken(held, ends, kept)

    def _taken(self, parts: list[list[str]], ends: list[int], kept: bytes) -> list[bytes]:
        """Ids up to each end, kept before the first."""
        if not ends:
            return []
        sizes = [len(p) for p in parts]
        known = len(self.index)
        codes = np.fromiter(map(self.index.__getitem__, chain.from_iterable(parts)), np.int64, sum(sizes))
        if len(self.index) > known:
            self._learn(list(islice(reversed(self.index), len(self.index) - known))[::-1])
        each = self.sizes[codes]
        after = np.cumsum(each)
        ids = self.flat[np.repeat(self.starts[codes] - after + each, each) + np.arange(after[-1] if len(after) else 0)]
        pieces = np.cumsum([0, *sizes])[[0, *ends]]
        cuts = np.concatenate([[0], after])[pieces].tolist()
        out = [ids[i:j].tobytes() for i, j in pairwise(cuts)]
        out[0] = kept + out[0]
        self._shrink()
        return out


def encoder(path: str, keep_space: bool, dtype: str, special_as_text: bool = False) -> PieceEncoder:
    """One encoder for each Python worker, kept between tasks."""
    key = (path, keep_space, dtype, special_as_text)
    if key not in _ENCODERS:
        _ENCODERS[key] = PieceEncoder(path, keep_space, dtype, special_as_text=special_as_text)
    return _ENCODERS[key]
