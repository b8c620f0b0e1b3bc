import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from millrace.llm import packing, rans
from millrace.llm.tokens import PieceEncoder, tokenizer_path, way_to_cut

SF = "/root/testdata/sf0.001"
NAMES = ("word_bpe_49k.json", "byte_bpe_50k.json")
PARTS = ["a", "Word", "é", "É", "́", " ", "  ", "\n", "\t", "\r", ".", ",", "'s", "'", "1", "23", "<|endoftext|>", "<|startoftext|>", "日本", "🙂", "\0", "　", "x-y", "|"]


def texts(n, seed):
    dice = random.Random(seed)
    return ["".join(dice.choices(PARTS, k=dice.randrange(14))) for _ in range(n)]


@pytest.mark.parametrize("name", NAMES)
def test_pieces_give_what_the_library_gives(name):
    mine, library = PieceEncoder(tokenizer_path(name)), Tokenizer.from_file(tokenizer_path(name))
    assert mine.mode != "whole"
    for some in (texts(6000, 1), texts(6000, 2)):
        got = mine.encode(some)
        for text, ids in zip(some, got):
            assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_unknown_tokenizers_get_whole_texts():
    assert way_to_cut({"normalizer": {"type": "NFKC"}, "pre_tokenizer": None})[0] == "whole"


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 70_001])
@pytest.mark.parametrize("lanes, every, block", [(512, 256, 1 << 18), (7, 3, 100)])
def test_segments_round_trip(n, lanes, every, block):
    ids = (np.random.default_rng(n).zipf(1.3, n) % 49_000).astype(np.uint32)
    data = rans.encode_segment(ids, lanes, every, block)
    segment = rans.Segment(data)
    assert np.array_equal(segment.decode(), ids)
    for start, stop in ((0, n), (n // 3, n // 2), (n - 1, n), (5, 5), (n // 2, n + 9)):
        assert np.array_equal(segment.decode_range(max(0, start), stop), ids[max(0, start) : stop])


def test_damage_is_noticed():
    data = bytearray(rans.encode_segment(np.arange(3000, dtype=np.uint32) % 50))
    data[len(data) // 2] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        rans.Segment(bytes(data))


def test_skewed_ids_come_out_near_their_entropy():
    ids = (np.random.default_rng(5).random(400_000) < 0.02).astype(np.uint32)
    assert len(rans.encode_segment(ids)) < 400_000 / 8 * 0.5


def test_token_files(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    library = Tokenizer.from_file(tokenizer_path(NAMES[0]))
    got = sorted(rans.op2_token_files(spark, SF).collect())
    start = 0
    for row, doc in zip(got, docs, strict=True):
        ids = library.encode(doc.text or "", add_special_tokens=False).ids + [rans.END_ID]
        assert tuple(row) == (doc.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_small_segments_and_repeated_ids(spark, docs_of, tmp_path, monkeypatch):
    monkeypatch.setattr(rans, "SEGMENT_IDS", 50)
    docs = docs_of([(i % 7, f"text number {i} " * (i % 5)) for i in range(60)]).repartition(3)
    rans.write_ids(docs, str(tmp_path / "ids"), tokenizer_path(NAMES[0]))
    got = sorted(rans.read_ids(spark, str(tmp_path / "ids")).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted(i % 7 for i in range(60))
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got[:-1])]).tolist()


def test_best_level_is_the_least_sum_of_squares():
    dice, levels = random.Random(4), packing.Levels(32)
    for _ in range(400):
        size = dice.randrange(1, 32)
        count = levels.count.copy()

        def squares(level):
            after = count.copy()
            if level:
                after[level] -= 1
            if level + size < 32:
                after[level + size] += 1
            return int((after**2).sum())

        options = [0, *(h for h in range(1, 33 - size) if count[h])]
        best = min(map(squares, options))
        assert squares(levels.best(size)) == best
        levels.place((size, 0, 0, b"", size))


@pytest.mark.parametrize("sizes", [[3] * 50, [20] * 60, [33, 64, 1, 31, 100] * 9, [1], [], [17] * 4 + [15] * 3])
def test_sequences(sizes):
    docs = [(k, np.arange(n, dtype="<u4").tobytes()) for k, n in enumerate(sizes)]
    seen, padding = {k: [] for k in range(len(sizes))}, 0
    for pieces in packing.packed(iter(docs), 32, max_open=6):
        fill = sum(p[0] for p in pieces)
        assert 0 < fill <= 32
        padding += 0 if fill & (fill - 1) == 0 else 32 - fill
        for size, doc, start, ids, tokens in pieces:
            assert tokens == sizes[doc] and np.frombuffer(ids, "<u4").tolist() == list(range(start, start + size))
            seen[doc].append((start, size))
    assert padding <= packing.SMALL_HOLE * (sum(sizes) // 32 + 1)
    for doc, found in seen.items():
        assert sum(size for _, size in found) == sizes[doc]


def test_packed_documents(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    library = Tokenizer.from_file(tokenizer_path(NAMES[1]))
    rows = packing.op6_packing(spark, SF).collect()
    for doc, text in docs.items():
        ids = library.encode(text, add_special_tokens=False).ids + [packing.END_ID]
        at = 0
        for r in sorted((r for r in rows if r.doc_id == doc), key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    fills = []
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        fills.append(at)
    assert max(fills) <= 2048 and sum(2048 - f for f in fills if f & (f - 1)) < 0.01 * sum(fills)


def test_packing_keeps_fewer_pieces():
    from millrace.llm import tokens

    path = tokenizer_path("byte_bpe_50k.json")
    few, library = tokens.encoder(path, 3), Tokenizer.from_file(path)
    texts = [" ".join(f"w{k}x" for k in range(n, n + 20)) for n in range(0, 200, 20)]
    for text in texts:
        assert np.frombuffer(few.encode([text])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    whole = tokens.PieceEncoder(path)
    whole.encode(texts)
    assert len(few.kept) < len(whole.kept) and few is not tokens.encoder(path)
    assert packing.KEPT < tokens.KEPT_PIECES
