"""Packing, shards and pieces: exact round trips against the tokenizers themselves."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from rankweave.llm import packing, piece_encoding, token_shards
from rankweave.llm.tokens import ByteEncoder, WordEncoder
from rankweave.session import ship_package

from . import data

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
PIECES = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship_package(spark)


def odd_texts(n=3000):
    rnd = random.Random(5)
    letters = "abcXYZéÉßİıŉΣσ'’.,!?012 \n\t\r\x0b\xa0\x00 ▁中文ﬁ😀_-#"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 30))) for _ in range(n)]
    return [*texts, "", " ", "  ", "a   b", "don't I'LL <|endoftext|> <|ENDOFTEXT|> x<|startoftext|>y", "a \n b\n  c "]


def test_word_ids_are_the_tokenizers():
    texts = odd_texts() + [t or "" for t in data.awkward_texts()]
    want = Tokenizer.from_file(WORDS).encode_batch(texts, add_special_tokens=False)
    got = WordEncoder(WORDS).many(pa.array(texts), 2)
    assert all(g.tolist() == [*w.ids, 2] for g, w in zip(got, want, strict=True))


def test_byte_ids_are_the_tokenizers():
    texts = odd_texts()
    coder = ByteEncoder(*BYTES)
    got = [g.tolist() for g in coder.many(pa.array(texts), 50256)]
    assert got == [[*coder.encode(t), 50256] for t in texts]
    assert [len(g) for g in got] == coder.many(pa.array(texts), 50256, sizes_only=True)


def test_packing(spark):
    texts = data.awkward_texts() + ["word " * 9000]
    docs = data.frame(spark, texts)
    rows = packing.pack(docs, WORDS, capacity=256, group_sequences=4).collect()
    coder = Tokenizer.from_file(WORDS)
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for i, text in enumerate(texts):
        ids = np.array([*coder.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.length > 0
            assert bytes(r.ids) == ids[at : at + r.length].tobytes() and len(r.ids) == 4 * r.length
            at += r.length
        assert at == len(ids)
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == pieces[0].capacity <= 256 and (at == 256 or at & (at - 1) == 0)


def test_packing_balances_costs():
    rng = np.random.default_rng(3)
    lengths = rng.integers(10, 400, 300)
    sizes = [1024] * int(lengths.sum() // 1024) + packing.tail_sizes(int(lengths.sum() % 1024), 1024)
    cost = defaultdict(float)
    for _, _, n, seq, _ in packing.assign(lengths, sizes, 1 / 1024):
        cost[seq] += n + n * n / 1024
    whole = [cost[i] for i, s in enumerate(sizes) if s == 1024]
    assert max(whole) < 1.35 * min(whole)


def test_packing_of_odd_tables(spark):
    assert packing.pack(data.frame(spark, []).limit(0), WORDS).count() == 0
    docs = data.frame(spark, data.awkward_texts(), repeat_ids=True)
    assert packing.pieces(docs).where("start = 0").count() == docs.count()


@pytest.mark.parametrize("size", [1, 2, 3, 5, 64, 1000, 4097])
def test_permutation(size):
    slots = token_shards.permute(np.arange(size), size, 3)
    assert sorted(slots.tolist()) == list(range(size))
    assert (token_shards.permute(slots, size, 3, backward=True) == np.arange(size)).all()
    assert size < 50 or (slots != token_shards.permute(np.arange(size), size, 4)).any()


def test_shards(spark, tmp_path):
    texts = data.awkward_texts()
    docs = data.table(spark, tmp_path / "t", texts, repeat_ids=True)
    root = str(tmp_path / "shards")
    manifest = token_shards.write_shards(docs, root, BYTES, 50256, length=64, per_shard=10).collect()
    found = {r.slot: np.frombuffer(bytes(r.ids), "<u2") for r in token_shards.read_shards(spark, root, 64, 10).collect()}
    n = len(manifest)
    assert sorted(found) == list(range(n)) == sorted(r.slot for r in manifest) == sorted(r.sequence_id for r in manifest)
    assert [r.slot for r in manifest if r.slot != int(token_shards.permute(np.array([r.sequence_id]), n, 1)[0])] == []
    files = sorted((tmp_path / "shards").glob("*.bin"))
    assert [f.stat().st_size for f in files[:-1]] == [10 * 64 * 2] * (len(files) - 1)
    later = token_shards.read_shards(spark, root, 64, 10, start=17)
    assert later.count() == n - 17
    coder = ByteEncoder(*BYTES)
    stream = np.concatenate([found[r.slot] for r in sorted(manifest, key=lambda r: r.sequence_id)])
    starts = {r.sequence_id: (r.doc_id, r.start) for r in manifest}
    for number, (doc, start) in starts.items():
        if doc is not None and doc != 2:
            ids = [*coder.encode(texts[doc] or ""), 50256][start : start + 64]
            assert stream[number * 64 : number * 64 + len(ids)].tolist() == ids
    total = sum(len(coder.encode(r.text or "")) + 1 for r in docs.collect())
    assert total <= len(stream) and (stream != 50256).sum() == total - docs.count()


def test_shards_of_nothing(spark, tmp_path):
    root = str(tmp_path / "none")
    none = data.frame(spark, []).limit(0)
    assert token_shards.write_shards(none, root, BYTES, 50256).count() == 0
    assert token_shards.read_shards(spark, root).count() == 0


def test_pieces_without_dropout_are_the_models(spark):
    texts = [t for t in odd_texts(500) + data.awkward_texts() if t is None or "▁" not in t]
    docs = data.frame(spark, texts)
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = {r.doc_id: r.ids for r in piece_encoding.encode(docs, PIECES, chance=0.0).collect()}
    assert got == {i: model.encode(t or "") for i, t in enumerate(texts)}


def test_pieces_with_dropout(spark):
    texts = odd_texts(300) + data.awkward_texts()
    docs = data.frame(spark, texts, repeat_ids=True)
    coded = piece_encoding.encode(docs, PIECES, chance=0.2, seed=1, checked="same")
    assert coded.where("not same").count() == 0
    back = piece_encoding.decode(coded, PIECES).collect()
    assert len(back) == docs.count() and all(r.decoded == (r.text or "") for r in back)
    plain = {(r.doc_id, r.text): r.ids for r in piece_encoding.encode(docs, PIECES, chance=0.0).collect()}
    again = {(r.doc_id, r.text): r.ids for r in piece_encoding.encode(docs, PIECES, chance=0.2, seed=1).collect()}
    other = {(r.doc_id, r.text): r.ids for r in piece_encoding.encode(docs, PIECES, chance=0.2, seed=2).collect()}
    assert {(r.doc_id, r.text): r.ids for r in back} == again
    assert again != plain and again != other
    assert sum(map(len, again.values())) > sum(map(len, plain.values()))
    assert piece_encoding.encode(docs.limit(0), PIECES).count() == 0


@pytest.mark.parametrize("chance", [0.0, 0.1, 0.6])
def test_words_together_are_segmented_as_alone(chance):
    pieces = piece_encoding.Pieces.of(PIECES)
    words = sorted({w for t in odd_texts(800) for w in piece_encoding._WORD.findall(" " + t)} | {" " + "abcd" * 30, " " * 50})
    keys = piece_encoding.word_keys(words, 1, 9)
    alone = [np.array(pieces.segment(w, int(k), chance), np.int32).tobytes() for w, k in zip(words, keys, strict=True)]
    assert pieces.segment_all(words, keys, chance) == alone


def test_every_occurrence_draws_for_itself(spark):
    word = " international"
    texts = [(word * 300)[1:], (word * 300)[1:], "x" + " plain ▁sign," * 50 + " " + "abcd" * 30]
    pieces = piece_encoding.Pieces.of(PIECES)
    rows = {r.doc_id: r.ids for r in piece_encoding.encode(data.frame(spark, texts), PIECES, chance=0.1, seed=3).collect()}
    seen = []
    for i in (0, 1):
        at, ways = 0, []
        for _ in range(300):
            spelled, begin = b"", at
            while spelled != word.encode():
                spelled += pieces.spelled[rows[i][at]]
                at += 1
            ways.append(tuple(rows[i][begin:at]))
        assert at == len(rows[i])
        seen.append(ways)
    assert len(set(seen[0])) > 4 and len(set(seen[1])) > 4 and seen[0] != seen[1]


@pytest.mark.parametrize("chance", [0.0, 0.1, 0.6])
def test_kept_chains_give_what_each_occurrence_draws(chance):
    pieces = piece_encoding.Pieces.of(PIECES)
    names = sorted({w for t in odd_texts(300) for w in piece_encoding._WORD.findall(" " + t)} | {" international", " " + "abcd" * 30})
    which = np.random.default_rng(1).integers(0, len(names), 5000)
    keys = np.random.default_rng(2).integers(0, 1 << 63, 5000, dtype=np.uint64)
    flat, begins, counts = piece_encoding._segmented(pieces, names, which, keys, chance)
    for i, key, begin, n in zip(which.tolist(), keys.tolist(), begins.tolist(), counts.tolist(), strict=True):
        assert flat[begin : begin + n].tolist() == pieces.segment(names[i], key, chance)


def test_checksum_is_that_of_zlib(spark):
    rows = packing.pack(data.frame(spark, ["a b c"]), WORDS).selectExpr("ids", "crc32(ids) as c").collect()
    assert [r.c for r in rows] == [zlib.crc32(bytes(r.ids)) for r in rows]
