"""Token ids of whole texts from a vocabulary file of the ``tokenizers`` library.

Byte-pair merging never crosses the pieces that the vocabulary's own pre-tokenizer cuts, so
a text's ids are those of its pieces in a row. Texts are cut at places where that
pre-tokenizer always cuts as well, each distinct cutting is encoded by the library once per Python
worker, and the ids are joined. A cutting of letters alone, which is one piece, goes straight to the library's merging. Texts for which such places are not certain (special
tokens written out, separators that regex dialects treat differently) are encoded whole.

Where the vocabulary drops white space, the places are found in the bytes of many texts at once, and Arrow tells
the different cuttings apart, so only these are looked up one by one.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, compress, count, groupby
from operator import not_

import numpy as np
import pyarrow as pa

from heddle.llm.common import SPACES, remembers

#: Letters after which a cut is certain if an ASCII character that is no letter follows.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_NEXT = r"(?![^\x00-\x40\x5b-\x60\x7b-\x7f])"
_PIECE = rf"(?:[{_LETTERS}]++{_NEXT}|[^\s{_LETTERS}]+[{_LETTERS}]+{_NEXT}|[^\s{_LETTERS}]+(?!\S)|\S+)"
#: The commonest case first: a word, with the space before it if there is one.
_WORD = rf" ?[{_LETTERS}]++{_NEXT}"
#: With white space kept, a run of it belongs to what follows, and a single line feed stands alone.
_KEEPING = re.compile(rf"{_WORD}|\n(?=\S)|\s*{_PIECE}|\s+")
_DROPPING = re.compile(rf"{_WORD}|{_PIECE}")
#: Cuttings that are one piece for the vocabularies' pre-tokenizers.
_PLAIN = re.compile(rf" ?[{_LETTERS}]+")
_UNSURE = "\x1c\x1d\x1e\x1f"
#: Longer cuttings are encoded each time, so what a worker remembers is bounded in bytes.
LONGEST = 256
#: Characters of texts that are cut together.
TOGETHER = 1 << 20
#: Bytes of texts that are cut together where white space is dropped.
BYTES_TOGETHER = 2 << 20
#: Kinds of bytes: ASCII letters, white space that parts words, the unsure, parts of other characters, and the rest.
_LETTER, _SPACE, _ODD, _WIDE, _REST = range(1, 6)


def _kind(byte: int) -> int:
    if byte > 127:
        return _WIDE
    char = chr(byte)
    return _LETTER if char.isalpha() else _SPACE if char in SPACES else _ODD if char in _UNSURE else _REST


_KINDS = bytes(map(_kind, range(256)))


def _words(raw: bytes, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where cuttings of the texts ``raw[edges[:-1]:edges[1:]]`` start and end, white space left out, and the kinds of all bytes.

    A text is cut at white space, and after an ASCII or Latin-1 letter that a character of the rest follows.
    """
    data, kinds = np.frombuffer(raw, "u1"), np.frombuffer(raw.translate(_KINDS), "u1")
    solid = kinds != _SPACE
    letter = kinds == _LETTER
    # The second byte of U+00C0 to U+00FF, without the signs for multiplying and dividing.
    letter[1:] |= (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    first = np.ones(len(data) + 1, bool)
    first[1:-1] = ~solid[:-1] | letter[:-1] & (kinds[1:] == _REST)
    first[edges] = True
    last = first[1:].copy()
    last[:-1] |= ~solid[1:]
    return np.flatnonzero(first[:-1] & solid), np.flatnonzero(last & solid) + 1, kinds


class Encoder:
    """Encodes batches of texts. A worker remembers up to ``limit`` cuttings of up to ``LONGEST`` characters, and as many that it met before those."""

    def __init__(self, name: str, limit: int = 300_000):
        import public_tokenizers
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.whole = Tokenizer.from_file(public_tokenizers.path(name))
        self.dropping = self.whole.normalizer is not None
        self.cut = (_DROPPING if self.dropping else _KEEPING).findall
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        #: What the library's normalizer and pre-tokenizer make of each character of a plain cutting.
        self.shown = {ord(c): self._show(c) for c in map(chr, range(256)) if _PLAIN.fullmatch(f"{c}a")}
        self.merge = self.whole.model.tokenize
        self.ends = self._ends(public_tokenizers.path(name))
        if self.ends is not None:
            #: The model alone, for words that are as it takes them.
            self.plain = Tokenizer(self.whole.model)
            self.plain.pre_tokenizer = WhitespaceSplit()
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.limit = limit

    def _show(self, text: str) -> str:
        plain = text if self.whole.normalizer is None else self.whole.normalizer.normalize_str(text)
        return "".join(part for part, _ in self.whole.pre_tokenizer.pre_tokenize_str(plain))

    def _ends(self, path: str) -> np.ndarray | None:
        """For each id, whether it ends a word, if the vocabulary marks that."""
        suffix = getattr(self.whole.model, "end_of_word_suffix", None)
        if not suffix:
            return None
        vocabulary = self.whole.get_vocab(with_added_tokens=False)
        ends = np.zeros(max(vocabulary.values()) + 1, bool)
        ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        return ends

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self.whole.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    def _merge(self, words: list[str]) -> list[bytes]:
        """Ids of plain cuttings, straight from the library's model."""
        if not words:
            return []
        shown = "\n".join(words).translate(self.shown)
        if self.ends is not None:
            ids = np.array(self.plain.encode_batch_fast([shown], add_special_tokens=False)[0].ids, "<u4")
            edges = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(edges) == len(words):  # else the model leaves ends of words out
                raw, edges = ids.tobytes(), edges.tolist()
                return [raw[a:b] for a, b in zip([0, *edges[:-1]], edges, strict=True)]
        merge = self.merge
        return [array("I", [t.id for t in merge(w)]).tobytes() for w in shown.split("\n")]

    def _sure(self, text: str) -> bool:
        return not (any(c in text for c in _UNSURE) or ("<" in text and any(s in text for s in self.special)))

    def _together(self, texts: list[str]) -> Iterator[list[str]]:
        part, size = [], 0
        for text in texts:
            part.append(text)
            size += len(text)
            if size >= TOGETHER:
                yield part
                part, size = [], 0
        if part:
            yield part

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers. Equal texts are encoded once."""
        if self.dropping:
            ids, lengths = self.encode_all(pa.array(texts, pa.string()))
            raw, ends = ids.tobytes(), (4 * np.cumsum(lengths)).tolist()
            return [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)] if ends else []
        different = list(dict.fromkeys(texts))
        if len(different) < len(texts):
            known = dict(zip(different, self.encode(different), strict=True))
            return [known[t] for t in texts]
        out: list[bytes] = []
        for part in self._together(texts):
            held, gaps = [], []
            for t in part:
                if self._sure(t):
                    ws = self.cut(t)
                    ids = list(map(self.known.get, ws))
                    at = list(compress(count(), map(not_, ids)))
                    gaps.append((at, [ws[i] for i in at]))
                else:
                    ids = self._encode([t])
                    gaps.append(((), ()))
                held.append(ids)
            found = self._find(set(chain.from_iterable(ws for _, ws in gaps)))
            for ids, (at, ws) in zip(held, gaps, strict=True):
                for i, w in zip(at, ws, strict=True):
                    ids[i] = found[w]
                out.append(b"".join(ids))
        return out

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts in a row, as u32, and how many each text has."""
        if not self.dropping:
            found = self.encode(texts.to_pylist())
            return np.frombuffer(b"".join(found), "<u4"), np.array([len(x) // 4 for x in found], "i8")
        texts = texts.cast(pa.large_string())
        edges = np.frombuffer(texts.buffers()[1], "<i8", len(texts) + 1, 8 * texts.offset) if len(texts) else np.zeros(1, "i8")
        ids, lengths = [np.zeros(0, "<u4")], [np.zeros(0, "i8")]
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(edges, edges[at] + BYTES_TOGETHER, "right")) - 1)
            raw = texts.buffers()[2].slice(int(edges[at]), int(edges[to] - edges[at])).to_pybytes() if edges[to] > edges[at] else b""
            for found, n in self._encode_bytes(raw, edges[at : to + 1] - edges[at]):
                ids.append(found)
                lengths.append(n)
            at = to
        return np.concatenate(ids), np.concatenate(lengths)

    def _encode_bytes(self, raw: bytes, edges: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        starts, ends, kinds = _words(raw, edges)
        if (kinds == _ODD).any() or any(s.encode() in raw for s in self.special):
            # Some texts have to be encoded whole; the others stay together.
            texts = [raw[a:b].decode() for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
            sure, at = [self._sure(t) for t in texts], 0
            for ours, run in groupby(sure):
                to = at + sum(1 for _ in run)
                if not ours:
                    found = self._encode(texts[at:to])
                    yield np.frombuffer(b"".join(found), "<u4"), np.array([len(x) // 4 for x in found], "i8")
                elif all(sure):
                    yield self._join(raw, edges, starts, ends, kinds)
                else:
                    a, b = int(edges[at]), int(edges[to])
                    part = edges[at : to + 1] - a
                    yield self._join(raw[a:b], part, *_words(raw[a:b], part))
                at = to
        else:
            yield self._join(raw, edges, starts, ends, kinds)

    def _join(self, raw: bytes, edges: np.ndarray, starts: np.ndarray, ends: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts whose cuttings are given, and how many each has."""
        # Without white space the cuttings stand side by side.
        packed = np.frombuffer(raw, "u1")[kinds != _SPACE]
        places = np.concatenate([[0], np.cumsum(ends - starts)])
        words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(packed)]).dictionary_encode()
        _, inner, data = words.dictionary.buffers()
        marks = np.frombuffer(inner, "<i8", len(words.dictionary) + 1) if len(words) else np.zeros(1, "i8")
        # No cutting holds a line feed.
        apart = np.insert(np.frombuffer(data, "u1", int(marks[-1])), marks[1:-1], ord("\n")) if len(words) else b""
        different = bytes(apart).decode().split("\n") if len(words) else []
        found = list(map(self.known.get, different))
        gaps = list(compress(count(), map(not_, found)))
        new = self._find({different[i] for i in gaps})
        for i in gaps:
            found[i] = new[different[i]]
        ids = pa.array(found, pa.large_binary()).take(words.indices)
        bounds = np.frombuffer(ids.buffers()[1], "<i8", len(ids) + 1, 8 * ids.offset) // 4 if len(ids) else np.zeros(1, "i8")
        flat = np.frombuffer(ids.buffers()[2], "<u4", int(bounds[-1] - bounds[0]), 4 * int(bounds[0])) if bounds[-1] > bounds[0] else np.zeros(0, "<u4")
        return flat, np.diff(bounds[np.searchsorted(starts, edges)])

    def _find(self, words: set[str]) -> dict[str, bytes]:
        """Ids of cuttings that are not known, which are remembered."""
        found = {w: self.before[w] for w in words if w in self.before}
        plain, other = [], []
        for w in words.difference(found):
            (plain if w.isascii() and w.isalpha() or _PLAIN.fullmatch(w) else other).append(w)
        found.update(zip(plain, self._merge(plain), strict=True))
        found.update(zip(other, self._encode(other), strict=True))
        if len(self.known) + len(found) > self.limit:
            self.before, self.known = self.known, {}
        short = found if max(map(len, found), default=0) <= LONGEST else {w: x for w, x in found.items() if len(w) <= LONGEST}
        self.known.update(short)
        return found


@remembers
@lru_cache(maxsize=4)
def encoder(name: str) -> Encoder:
    """One encoder per vocabulary and Python worker."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(name)
