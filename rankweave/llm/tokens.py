"""Tokenising whole texts at the speed of a word lookup."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Entries of each table that a worker keeps.
CACHED_WORDS = 250_000
CACHED_SPACED = 500_000
# Texts whose words are looked up together.
PART_BYTES = 4 << 20
# Letters that no normal form and no context changes, then plain punctuation.  U+0130 lower-cases to two characters.
PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+)([.,;:!?]*)")


def byte_letters() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies.

    Printable bytes stand for themselves, the others for characters from 256 on, in order.
    """
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class _Words(dict):
    """Ids of words between spaces; an unknown word is encoded when it is first asked for."""

    def __init__(self, tokenizer):
        super().__init__({"": b""})
        self.encode, self.split = tokenizer.encode, tokenizer.model.tokenize
        self.letters = byte_letters()
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        plain = PLAIN.fullmatch(word)
        if plain is None:
            ids = self._ids(word)
        else:
            ids = self._stem(plain[1].lower())
            if plain[2]:
                ids += self._stem(plain[2])
        self[word] = ids
        return ids

    def _ids(self, word: str) -> bytes:
        return array("I", self.encode(word, add_special_tokens=False).ids).tobytes()

    def _stem(self, part: str) -> bytes:
        ids = self.young.get(part)
        if ids is None:
            ids = self.old.get(part)
            if ids is None:
                shown = part if part.isascii() else part.encode().decode("latin-1").translate(self.letters)
                ids = array("I", [t.id for t in self.split(shown)]).tobytes()
            self.young[part] = ids
        return ids

    def trim(self) -> None:
        if len(self) > CACHED_WORDS:
            self.clear()
            self[""] = b""
        if len(self.young) > CACHED_WORDS:
            self.old, self.young = self.young, {}


class WordEncoder:
    """Ids of a tokenizer whose tokens never span a space or line break.

    True of tokenizers that drop white space before splitting; then the ids of a text are
    those of its words in order.  Plain words of a byte-level vocabulary that lower-cases are
    looked up without their case and punctuation, since those are tokens of their own.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.words = _Words(Tokenizer.from_file(path))

    @staticmethod
    @lru_cache(maxsize=2)
    def of(path: str) -> WordEncoder:
        return WordEncoder(path)

    def many(self, texts: pa.Array, end: int) -> Iterator[np.ndarray]:
        """The ids of each text as unsigned 32-bit values, ``end`` after the last."""
        column = pc.fill_null(texts, "").cast(pa.large_string())
        sizes = np.cumsum(pc.binary_length(column).to_numpy())
        at = 0
        while at < len(column):
            stop = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + PART_BYTES, "right")))
            yield from self._part(column.slice(at, stop - at), end)
            at = stop

    def _part(self, texts: pa.Array, end: int) -> Iterator[np.ndarray]:
        """Every distinct word of the texts is looked up once, and its ids put in all its places."""
        # Lower case would make a special token of one in capitals.
        if not pc.any(pc.match_substring(texts, "<|")).as_py():
            texts = pc.ascii_lower(texts)
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        words = split.flatten().dictionary_encode()
        self.words.trim()
        found = [*map(self.words.__getitem__, words.dictionary.to_pylist())]
        ids = np.frombuffer(b"".join(found), np.uint32)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        which = words.indices.to_numpy()
        counts = sizes[which]
        ends = np.cumsum(counts)
        source = np.repeat((np.cumsum(sizes) - sizes)[which] - (ends - counts), counts)
        source += np.arange(len(source))
        flat = ids[source]
        bounds = np.append(0, ends)[split.offsets.to_numpy()]
        for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            own = np.empty(high - low + 1, np.uint32)
            own[:-1] = flat[low:high]
            own[-1] = end
            yield own


class _Spaced(dict):
    """Ids of words with the space before them, as bytes of 16-bit values."""

    def __init__(self, coder):
        super().__init__()
        self.encode = coder.encode_ordinary
        self.old: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = array("H", self.encode(word)).tobytes()
        if len(word) < 64:
            self[word] = ids
        return ids

    def trim(self) -> None:
        """Forget the words that haven't come up for long."""
        if len(self) > CACHED_SPACED:
            self.old = dict(self)
            self.clear()


# Texts with line breaks, or with full stops and commas, that the pattern may keep with what is before.
JOINED_BREAKS = r"[\s\x0b\x{85}\pZ]\n|\n[\s\x0b\x{85}\pZ]|^\n|\n$"
JOINED_MARKS = r"[^\pL\pN][.,]|^[.,]"


class ByteEncoder:
    """16-bit ids of a byte-level tokenizer whose pattern puts one space before the word after it.

    A text is cut before every space.  That is where its pattern cuts too, unless two spaces
    follow each other or one ends the text; such a text is encoded whole.  Line breaks are cut
    out where none has white space beside it, and full stops and commas begin a new word
    where all follow a letter or digit.
    """

    def __init__(self, path: str, pattern: str):
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        if len(ranks) >= 1 << 16:
            raise ValueError("the vocabulary doesn't fit 16 bits")
        coder = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.words, self.encode = _Spaced(coder), coder.encode_ordinary

    @staticmethod
    @lru_cache(maxsize=2)
    def of(path: str, pattern: str) -> ByteEncoder:
        return ByteEncoder(path, pattern)

    def many(self, texts: pa.Array, end: int, sizes_only: bool = False) -> Iterator[np.ndarray] | list[int]:
        """The ids of each text, ``end`` after the last; or only how many there are."""
        column = pc.fill_null(texts, "").cast(pa.large_string())
        odd = pc.match_substring_regex(column, "  | $|\\x00")
        whole = {i: self.encode(column[i].as_py()) for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist()}
        marked = pc.replace_substring(pc.if_else(odd, "", column), " ", "\0 ")
        cut = pc.invert(pc.match_substring_regex(column, JOINED_BREAKS))
        marked = pc.if_else(cut, pc.replace_substring(marked, "\n", "\0\n\0"), marked)
        cut = pc.invert(pc.match_substring_regex(column, JOINED_MARKS))
        for mark in ".,":
            marked = pc.if_else(cut, pc.replace_substring(marked, mark, "\0" + mark), marked)
        split = pc.split_pattern(marked, "\0")
        words = split.flatten().dictionary_encode()
        self.words.trim()
        found = [*map(self.words.__getitem__, words.dictionary.to_pylist())]
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 2
        which = words.indices.to_numpy()
        counts = sizes[which]
        ends = np.cumsum(counts)
        bounds = np.append(0, ends)[split.offsets.to_numpy()]
        if sizes_only:
            lengths = np.diff(bounds) + 1
            for i, ids in whole.items():
                lengths[i] = len(ids) + 1
            return lengths.tolist()
        source = np.repeat((np.cumsum(sizes) - sizes)[which] - (ends - counts), counts)
        source += np.arange(len(source))
        flat = np.frombuffer(b"".join(found), np.uint16)[source]
        return self._each(flat, bounds, whole, end)

    @staticmethod
    def _each(flat: np.ndarray, bounds: np.ndarray, whole: dict[int, list[int]], end: int) -> Iterator[np.ndarray]:
        for i, (low, high) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
            ids = whole[i] if i in whole else flat[low:high]
            own = np.empty(len(ids) + 1, np.uint16)
            own[:-1] = ids
            own[-1] = end
            yield own
