"""SentencePiece encoding with seeded merge-dropout, and decoding.

Characters of a word are merged along an agenda, best score first, as merge-type (BPE)
models do; each candidate taken from the agenda is skipped with a given chance, decided by
a hash keyed with the seed, the document, the word and its place in the document: every
occurrence of a word draws for itself.  What the agenda does after the same skips in the same
word is kept, so that an occurrence only draws along it.  Whatever is skipped, the pieces spell
the text, and decoding gives it back to the byte.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, fresh, portions, with_column
from .kernels import BYTE_VALUES, BYTES, U64, mix

SPACE = "▁"
# Stands for the character itself in a text; it isn't a space, and is spelled in bytes.
_SIGN = "\0" + SPACE
_WORD = re.compile(" +[^ ]*")
_ALL = (1 << 64) - 1
# More than any piece's number, and than any rank; widths of the tables words are merged in.
_PAIR = 1 << 24
# Characters without a piece are numbered from here, and spelled in bytes at the end.
_OTHER = 1 << 22
_NONE = (1 << 31) - 1
_WIDTHS = (4, 8, 12, 20, 40)
# Agenda steps a worker keeps, and the longest words it keeps any of.
CACHED = 4_000_000
_KEPT = 20


class Pieces:
    """The vocabulary of a merge-type model file."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        plain = [i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.ids = {model.id_to_piece(i): i for i in plain}
        self.scores = {model.id_to_piece(i): -model.get_score(i) for i in plain}
        self.bytes = {int(model.id_to_piece(i)[3:5], 16): i for i in ids if model.is_byte(i)}
        if len(self.bytes) != 256:
            raise ValueError("without byte pieces some texts can't be spelled")
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("pieces that go on over a space aren't supported")
        self.spelled = [b""] * len(ids)
        for piece, i in self.ids.items():
            self.spelled[i] = piece.replace(SPACE, " ").encode()
        for byte, i in self.bytes.items():
            self.spelled[i] = bytes([byte])
        self._index_pairs()
        self.chains = Chains(self)

    def _index_pairs(self) -> None:
        """Which two pieces make a third, by a number for the two, and that piece's rank."""
        ranked = sorted(self.ids, key=lambda p: self.scores[p])
        pairs = {}
        rank, score = -1, None
        for piece in ranked:
            if self.scores[piece] != score:
                rank, score = rank + 1, self.scores[piece]
            for cut in range(1, len(piece)):
                left, right = self.ids.get(piece[:cut]), self.ids.get(piece[cut:])
                if left is not None and right is not None:
                    pairs[left * _PAIR + right] = (rank, self.ids[piece])
        keys = np.fromiter(pairs, np.int64, len(pairs))
        order = np.argsort(keys)
        self.pair_keys = np.append(keys[order], _ALL >> 1)
        values = np.array(list(pairs.values()), np.int64).reshape(-1, 2)[order]
        self.pair_ranks = np.append(values[:, 0], _NONE).astype(np.int32)
        self.pair_ids = np.append(values[:, 1], 0).astype(np.int32)
        self.letters = np.arange(_OTHER, _OTHER + 0x110000, dtype=np.int32)
        for piece, i in self.ids.items():
            if len(piece) == 1 and piece != SPACE:
                self.letters[ord(piece)] = i
        self.letters[ord(" ")] = self.ids.get(SPACE, _OTHER + ord(SPACE))
        self.byte_ids = np.array([self.bytes[b] for b in range(256)], np.int32)

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = left.astype(np.int64) * _PAIR + right
        at = np.searchsorted(self.pair_keys, keys)
        at[self.pair_keys[at] != keys] = len(self.pair_ranks) - 1
        return self.pair_ranks[at], self.pair_ids[at]

    def segment_all(
        self, words: list[str], keys: np.ndarray, chance: float, limits: np.ndarray | None = None, trail: list | None = None
    ) -> list[bytes]:
        """``segment`` for many words at once, a step of every word's agenda at a time.

        ``trail`` is given arrays of word numbers and steps, for each word in their order.
        """
        out: list[bytes | None] = [None] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        symbols = self.letters[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)]
        ends = np.cumsum(sizes)
        whole = sizes <= _WIDTHS[-1]
        for i in np.flatnonzero(~whole).tolist():
            steps: list[int] = []
            ids = self.segment(words[i], int(keys[i]), chance, None if limits is None else int(limits[i]), steps)
            out[i] = np.array(ids, np.int32).tobytes()
            if trail is not None:
                trail.append((np.full(len(steps), i), np.array(steps, U64)))
        for low, width in zip((0, *_WIDTHS), _WIDTHS):
            use = np.flatnonzero(whole & (sizes > low) & (sizes <= width))
            for at in range(0, len(use), 1 << 14):
                part = use[at : at + (1 << 14)]
                own: list | None = None if trail is None else []
                most = None if limits is None else limits[part]
                for i, ids in zip(part.tolist(), self._merge(symbols, ends[part] - sizes[part], sizes[part], keys[part], width, chance, most, own)):
                    out[i] = ids
                if own:
                    trail.extend((part[rows], steps) for rows, steps in own)
        return out

    def _merge(
        self, symbols: np.ndarray, starts: np.ndarray, sizes: np.ndarray, keys: np.ndarray, width: int, chance: float,
        limits: np.ndarray | None = None, trail: list | None = None,
    ) -> list[bytes]:
        columns = np.arange(width + 1)
        inside = columns < sizes[:, None]
        rows = np.where(inside, symbols[np.minimum(starts[:, None] + columns, len(symbols) - 1)], -1)
        begin = np.minimum(columns, sizes[:, None]).astype(np.int32)  # character at which each symbol begins
        ranks, made = self._pairs(rows[:, :-1], rows[:, 1:])
        ranks = np.where(inside[:, 1:], ranks, _NONE)
        below = U64(int(chance * (1 << 32)))
        final: list[tuple[np.ndarray, np.ndarray]] = []
        live = np.arange(len(rows))
        to_skip = np.full(len(rows), _NONE) if limits is None else limits.copy()
        while len(live):
            best = ranks.argmin(1)
            every = np.arange(len(live))
            end = ranks[every, best] == _NONE
            if end.any():
                final.append((live[end], rows[end]))
                stay = ~end
                live, rows, begin, ranks, made, best = live[stay], rows[stay], begin[stay], ranks[stay], made[stay], best[stay]
                every = np.arange(len(live))
                if not len(live):
                    break
            left = begin[every, best].astype(U64)
            size = begin[every, best + 2].astype(U64) - left
            step = left * U64(0x9E3779B97F4A7C15) + size * U64(0xD1342543DE82EF95)
            if trail is not None:
                past = to_skip[live] == 0
                trail.append((live[past], step[past]))
            skip = (_coin(keys[live], step) < below) & (to_skip[live] > 0)
            to_skip[live[skip]] -= 1
            ranks[every[skip], best[skip]] = _NONE
            go = np.flatnonzero(~skip)
            at = best[go]
            rows[go, at] = made[go, at]
            # Close the gap behind the merged symbol.
            source = np.minimum(columns + (columns > at[:, None]), width)
            rows[go] = np.take_along_axis(rows[go], source, 1)
            begin[go] = np.take_along_axis(begin[go], source, 1)
            rows[go, width] = -1
            pair = source[:, :-1].copy()
            pair[:, -1] = width - 1
            ranks[go], made[go] = np.take_along_axis(ranks[go], np.minimum(pair, width - 1), 1), np.take_along_axis(made[go], np.minimum(pair, width - 1), 1)
            ranks[go, width - 1] = _NONE
            for place in (at - 1, at):
                some = go[place >= 0]
                place = place[place >= 0]
                new, ids = self._pairs(rows[some, place], rows[some, place + 1])
                ranks[some, place] = np.where(rows[some, place + 1] >= 0, new, _NONE)
                made[some, place] = ids
        out: list[bytes] = [b""] * len(starts)
        for which, left_over in final:
            used = left_over >= 0
            counts = used.sum(1)
            flat = left_over[used].astype(np.int32)
            other = np.flatnonzero(flat >= _OTHER)
            if len(other):
                sizes_in_bytes = np.ones(len(flat), np.int64)
                chars = flat[other] - _OTHER
                sizes_in_bytes[other] += (chars >= 0x80).astype(np.int64) + (chars >= 0x800) + (chars >= 0x10000)
                counts = np.add.reduceat(sizes_in_bytes, np.cumsum(counts) - counts)
                flat = self._in_bytes(flat, other, chars, sizes_in_bytes)
            flat = flat.tobytes()
            ends = np.cumsum(counts) * 4
            for i, low, high in zip(which.tolist(), (ends - counts * 4).tolist(), ends.tolist()):
                out[i] = flat[low:high]
        return out

    def _in_bytes(self, flat: np.ndarray, other: np.ndarray, chars: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """``flat`` with the pieces of the UTF-8 of ``chars`` in place of ``other``."""
        out = np.repeat(flat, sizes)
        begin, size = (np.cumsum(sizes) - sizes)[other], sizes[other]
        lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])
        for k in range(4):
            some = np.flatnonzero(size > k)
            bits = chars[some] >> (6 * (size[some] - 1 - k))
            out[begin[some] + k] = self.byte_ids[bits | lead[size[some]] if k == 0 else bits & 63 | 0x80]
        return out

    @staticmethod
    @lru_cache(maxsize=2)
    def of(path: str) -> Pieces:
        return Pieces(path)

    def segment(self, word: str, key: int, chance: float, limit: int | None = None, trail: list[int] | None = None) -> list[int]:
        """Ids of a run of spaces with the characters up to the next space.

        After ``limit`` skips nothing more is skipped; ``trail`` is given the steps from there on.
        """
        symbols = [SPACE if c == " " else _SIGN if c == SPACE else c for c in word]
        scores = self.scores
        n = len(symbols)
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        agenda = []
        for i in range(n - 1):
            score = scores.get(symbols[i] + symbols[i + 1])
            if score is not None:
                agenda.append((score, i, i + 1, len(symbols[i]) + len(symbols[i + 1])))
        heapify(agenda)
        below = int(chance * (1 << 32))
        while agenda:
            _, left, right, size = heappop(agenda)
            if after[left] != right or len(symbols[left]) + len(symbols[right] if right < n else "") != size or not symbols[left]:
                continue
            step = left * 0x9E3779B97F4A7C15 + size * 0xD1342543DE82EF95 & _ALL
            if limit == 0:
                if trail is not None:
                    trail.append(step)
            elif below and ((key ^ step) * 0xFF51AFD7ED558CCD & _ALL) >> 32 < below:
                limit = None if limit is None else limit - 1
                continue
            symbols[left] += symbols[right]
            symbols[right] = ""
            end = after[left] = after[right]
            if end < n:
                before[end] = left
                score = scores.get(symbols[left] + symbols[end])
                if score is not None:
                    heappush(agenda, (score, left, end, len(symbols[left]) + len(symbols[end])))
            start = before[left]
            if start >= 0:
                score = scores.get(symbols[start] + symbols[left])
                if score is not None:
                    heappush(agenda, (score, start, left, len(symbols[start]) + len(symbols[left])))
        out: list[int] = []
        for symbol in symbols:
            if symbol:
                found = self.ids.get(symbol)
                if found is None:
                    out.extend(self.bytes[b] for b in (SPACE if symbol == _SIGN else symbol).encode())
                else:
                    out.append(found)
        return out


def _coin(keys: np.ndarray, steps: np.ndarray) -> np.ndarray:
    return ((keys ^ steps) * U64(0xFF51AFD7ED558CCD)) >> U64(32)


class Chains:
    """What agendas do from one skip to the next, as far as any occurrence of a word has come.

    A chain has the steps that a word's agenda takes after certain skips if nothing more is
    skipped, an end, and the ids then reached; a skip at a step leads to another chain.
    """

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.clear()

    def clear(self) -> None:
        self.first: dict[str, int] = {}
        self.n_steps = self.n_chains = self.n_ids = 0
        self.steps, self.owner, self.child, self.is_end = np.zeros(1, U64), np.zeros(1, np.int32), np.zeros(1, np.int32), np.zeros(1, bool)
        self.starts, self.skips = np.zeros(1, np.int64), np.zeros(1, np.int32)
        self.id_starts, self.id_counts = np.zeros(1, np.int64), np.zeros(1, np.int64)
        self.ids = np.zeros(1, np.int32)

    def _room(self, n: int, *names: str) -> None:
        for name in names:
            old = getattr(self, name)
            if len(old) < n:
                new = np.zeros(max(n, 2 * len(old)), old.dtype)
                new[: len(old)] = old
                setattr(self, name, new)

    def _add(self, words: list[str], keys: np.ndarray, chance: float, skips: np.ndarray) -> np.ndarray:
        """Numbers of new chains: where the words' agendas go on after so many skips."""
        trail: list[tuple[np.ndarray, np.ndarray]] = [(np.arange(0), np.zeros(0, U64))]
        found = self.pieces.segment_all(words, keys, chance, skips, trail)
        n = len(words)
        own = np.concatenate([*(rows for rows, _ in trail), np.arange(n)])
        order = np.argsort(own, kind="stable")
        steps = np.concatenate([*(steps for _, steps in trail), np.zeros(n, U64)])[order]
        ends = np.cumsum(np.bincount(own, minlength=n))
        chains = np.arange(self.n_chains, self.n_chains + n)
        low, high = self.n_steps, self.n_steps + len(steps)
        self._room(high, "steps", "owner", "child", "is_end")
        self.steps[low:high], self.owner[low:high], self.child[low:high], self.is_end[low:high] = steps, chains[own[order]], -1, False
        self.is_end[low + ends - 1] = True
        ids = np.frombuffer(b"".join(found), np.int32)
        counts = np.fromiter(map(len, found), np.int64, n) // 4
        self._room(self.n_ids + len(ids), "ids")
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        self._room(self.n_chains + n, "starts", "skips", "id_starts", "id_counts")
        self.starts[chains], self.skips[chains] = low + np.append(0, ends[:-1]), skips
        self.id_starts[chains], self.id_counts[chains] = self.n_ids + np.cumsum(counts) - counts, counts
        self.n_steps, self.n_chains, self.n_ids = high, self.n_chains + n, self.n_ids + len(ids)
        return chains

    def follow(self, words: list[str], which: np.ndarray, keys: np.ndarray, chance: float) -> np.ndarray:
        """The chain in which each occurrence ends, a word ``words[which]`` with a key of its own."""
        if self.n_steps > CACHED:
            self.clear()
        new = [w for w in words if w not in self.first]
        if new:
            self.first.update(zip(new, self._add(new, np.zeros(len(new), U64), chance, np.zeros(len(new), np.int32)).tolist(), strict=True))
        begin = self.starts[np.fromiter(map(self.first.__getitem__, words), np.int64, len(words))]
        at = begin[which]
        below = U64(int(chance * (1 << 32)))
        out = np.empty(len(which), np.int64)
        live = np.arange(len(which))
        while len(live):
            waiting = [live[:0]]
            while len(live):
                here = at[live]
                end = self.is_end[here]
                if end.any():
                    out[live[end]] = self.owner[here[end]]
                    live, here = live[~end], here[~end]
                skipped = np.flatnonzero(_coin(keys[live], self.steps[here]) < below)
                chain = self.child[here[skipped]]
                here += 1
                here[skipped] = np.where(chain >= 0, self.starts[chain], here[skipped] - 1)
                at[live] = here
                missing = skipped[chain < 0]
                waiting.append(live[missing])
                live = np.delete(live, missing)
            live = np.concatenate(waiting)
            if len(live):
                places, some = np.unique(at[live], return_index=True)
                some = live[some]
                made = self._add([words[i] for i in which[some].tolist()], keys[some], chance, self.skips[self.owner[places]] + 1)
                self.child[places] = made
        return out


def word_keys(words: list[str], draw: int, seed: int) -> np.ndarray:
    """What decides about the merges of a word by itself: its spelling, a number and the seed."""
    spelled = [w.encode() for w in words]
    sizes = np.fromiter(map(len, spelled), np.int64, len(spelled))
    ends = np.cumsum(sizes)
    prefix = BYTES.prefix(BYTE_VALUES[np.frombuffer(b"".join(spelled), np.uint8)])
    return mix(BYTES.spans(prefix, ends - sizes, ends) ^ mix(np.array([draw, seed], np.int64).view(U64)).sum())


def _split(texts: pa.Array) -> pa.ListArray:
    """Each text, with a space put before it, as runs of spaces with what follows; none for an empty text."""
    marked = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string()))
    plain = not pc.any(pc.match_substring_regex(marked, "  | $|\\x00")).as_py()
    if plain:
        split = pc.split_pattern(pc.replace_substring(marked, " ", "\0 "), "\0")
        flat, offsets = split.flatten(), split.offsets.to_numpy()
        first = np.ones(len(flat), bool)
        first[offsets[:-1]] = False  # what stands before the first space: nothing
        sizes = np.diff(offsets) - 1
        return pa.LargeListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int64)), flat.filter(pa.array(first)))
    words = [_WORD.findall(" " + t) if t else [] for t in texts.to_pylist()]
    return pa.array(words, pa.large_list(pa.large_string()))


def _segmented(
    pieces: Pieces, names: list[str], which: np.ndarray, keys: np.ndarray, chance: float
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, and where those of each occurrence begin and how many they are.

    Long words, and new ones that stand here once, aren't worth keeping.
    """
    chains = pieces.chains
    begins, counts = np.empty(len(which), np.int64), np.empty(len(which), np.int64)
    short = np.fromiter(map(len, names), np.int64, len(names)) <= _KEPT
    once = np.flatnonzero(short & (np.bincount(which, minlength=len(names)) == 1))
    short[[i for i in once.tolist() if names[i] not in chains.first]] = False
    number = np.cumsum(short) - 1
    kept = np.flatnonzero(short[which])
    found = chains.follow([names[i] for i in np.flatnonzero(short).tolist()], number[which[kept]], keys[kept], chance)
    begins[kept], counts[kept] = chains.id_starts[found], chains.id_counts[found]
    long = np.flatnonzero(~short[which])
    alone = pieces.segment_all([names[i] for i in which[long].tolist()], keys[long], chance)
    size = np.fromiter(map(len, alone), np.int64, len(alone)) // 4
    begins[long], counts[long] = chains.n_ids + np.cumsum(size) - size, size
    return np.concatenate([chains.ids[: chains.n_ids], np.frombuffer(b"".join(alone), np.int32)]), begins, counts


def _encode(path: str, text: str, key: str, column: str, seed: int, chance: float, checked: str = ""):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.of(path)
        for batch in portions(batches, text):
            split = _split(pc.fill_null(batch.column(text), "").cast(pa.large_string()))
            words, bounds = split.flatten().dictionary_encode(), split.offsets.to_numpy()
            sizes = np.diff(bounds)
            place = np.arange(bounds[-1]) - np.repeat(bounds[:-1], sizes)
            doc = mix(pc.fill_null(batch.column(key), -1).to_numpy().astype(np.int64).view(U64) ^ U64(seed))
            which = words.indices.to_numpy().astype(np.int64)
            names = words.dictionary.to_pylist()
            keys = mix(word_keys(names, 0, seed)[which] ^ mix(np.repeat(doc, sizes) + place.astype(U64)))
            flat, begins, counts = _segmented(pieces, names, which, keys, chance)
            ends = np.cumsum(counts)
            source = np.repeat(begins - (ends - counts), counts) + np.arange(counts.sum())
            offsets = np.append(0, ends)[bounds].astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat[source]))
            out = with_column(batch, column, ids)
            if checked:
                originals = pc.fill_null(batch.column(text), "").cast(pa.binary()).to_pylist()
                same = [a == b for a, b in zip(_spell(pieces, ids), originals, strict=True)]
                out = with_column(out, checked, pa.array(same, pa.bool_()))
            yield out

    return run


def encode(
    docs: DataFrame, model: str, text: str = "text", doc_id: str = "doc_id", column: str = "ids",
    seed: int = 0, chance: float = 0.1, checked: str = "",
) -> DataFrame:
    """``docs`` with the piece ids of each whole text as ``column``, an array of int.

    ``model`` is the path of a merge-type SentencePiece file with byte pieces that puts a
    space before a text and changes nothing else.  ``chance`` 0 gives the model's own
    encoding.  ``checked`` names a column that says whether the ids, decoded where they are made,
    spell the text.  A null or empty text has no ids.  Rows that repeat an id and text get equal
    ids; a null id counts as -1.  Other columns pass through; no rows give no rows.
    """
    key = fresh(docs, "_id")
    keyed = docs.drop(column).withColumn(key, F.col(doc_id).cast("long"))
    fields = [*keyed.schema.fields, T.StructField(column, T.ArrayType(T.IntegerType()))]
    if checked:
        keyed = keyed.drop(checked)
        fields = [f for f in fields if f.name != checked] + [T.StructField(checked, T.BooleanType())]
    return keyed.mapInArrow(_encode(model, text, key, column, seed, chance, checked), T.StructType(fields)).drop(key)


def _spell(pieces: Pieces, ids: pa.ListArray) -> Iterator[bytes]:
    """The UTF-8 that each list of ids spells, without the space put before it."""
    flat = ids.flatten().to_numpy(zero_copy_only=False)
    ends = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)))
    for low, high in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        yield b"".join(map(pieces.spelled.__getitem__, flat[low:high].tolist()))[1:]


def _decode(path: str, ids: str, column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.decode(errors="replace") for t in _spell(Pieces.of(path), batch.column(ids))]
            yield with_column(batch, column, pa.array(texts, pa.string()))

    return run


def decode(encoded: DataFrame, model: str, ids: str = "ids", column: str = "decoded") -> DataFrame:
    """``encoded`` with the text that the ids spell as ``column``; no ids spell an empty text."""
    fields = [f for f in encoded.schema.fields if f.name != column] + [T.StructField(column, T.StringType())]
    return encoded.drop(column).mapInArrow(_decode(model, ids, column), T.StructType(fields))


def op2_piece_encoding(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = documents(spark, sf_dir).select("doc_id", "text")
    coded = encode(docs, public_tokenizers.path("piece_bpe_32k.model"), checked="lossless")
    return coded.select("doc_id", F.size("ids").alias("n_pieces"), "ids", "lossless")
