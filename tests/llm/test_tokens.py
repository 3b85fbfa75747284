"""Token ids against the libraries: pieces, packing, token files."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from wirecorpus.llm import packing, pieces, tokenfiles
from wirecorpus.llm.memo import TokenMemo

BYTES, WORDS, PIECES = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))


def le32(ids):
    return np.array(ids, dtype="<u4").tobytes()


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_memo_is_the_library(texts, path):
    library, memo = Tokenizer.from_file(path), TokenMemo(path, pieces=50)
    odd = ["a  b", "a\n b", "x \n b", "it's ''s", "é́ é", "\x1c a\x1cb \x85 c", "a. B.\nC.\n\nD", "İ ΑΣ", "1.5, x?!y"]
    some = [t or "" for t in texts] + odd
    for _ in range(2):  # the second time from memory, after the bound was passed
        for at in range(0, len(some), 7):
            part = some[at: at + 7]
            assert memo.encode(part) == [le32(e.ids) for e in library.encode_batch(part, add_special_tokens=False)]


def test_pieces_are_the_library(docs, none, pairs):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = []
    for i, t in pairs:
        ids = library.encode(t, add_bos=True, add_eos=True)
        want.append((i, len(ids), hashlib.sha256(le32(ids)).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    found = pieces.encode_decode(docs, PIECES)
    got = [(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in found.collect()]
    assert Counter(got) == Counter(want)
    assert all(len(r.ids) == r.n_tokens for r in found.collect())
    assert pieces.encode_decode(none, PIECES).collect() == []


def test_agenda_reaches_over_no_cut():
    model = pieces.PieceModel(PIECES)
    for unit in ("▁the,", "▁▁▁x", "▁(don't)", "▁été-là", "▁日本語x", "▁aaaa" * 1):
        assert [i for p in model.cut(unit) for i in model.agenda(p)] == model.agenda(unit)


@pytest.mark.parametrize("capacity", [5, 16, 17, 64])
def test_best_fit_finds_the_tightest(capacity):
    rnd = np.random.default_rng(capacity)
    for _ in range(40):
        lengths = np.sort(rnd.integers(1, capacity + 1, rnd.integers(0, 60)))[::-1]
        rooms = []
        for length in lengths:
            fits = [r for r in rooms if r >= length]
            if fits:
                rooms.remove(min(fits))
                rooms.append(min(fits) - length)
            else:
                rooms.append(capacity - length)
        sequence, offset, fills = packing.best_fit(lengths, capacity)
        assert sorted(capacity - f for f in fills) == sorted(rooms)
        for number in range(len(fills)):
            inside = sorted(zip(offset[sequence == number], lengths[sequence == number]))
            assert [o for o, _ in inside] == [sum(n for _, n in inside[:k]) for k in range(len(inside))]


def packed_well(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for inside in by.values():
        inside.sort()
        assert [o for o, _ in inside] == [sum(n for _, n in inside[:k]) for k in range(len(inside))]
        assert sum(n for _, n in inside) <= capacity
    return len(by)


@pytest.mark.parametrize("group_tokens", [200, 2_000, 1 << 20])
def test_packing_keeps_every_piece(docs, none, pairs, group_tokens):
    capacity, library = 64, Tokenizer.from_file(WORDS)
    rows = packing.pack(packing.token_pieces(docs, WORDS, 1, capacity), capacity, group_tokens).collect()
    want, total = [], 0
    for i, t in pairs:
        ids = library.encode(t, add_special_tokens=False).ids + [1]
        total += len(ids)
        for k in range(0, len(ids), capacity):
            part = ids[k: k + capacity]
            want.append((i, k // capacity, k, len(part), zlib.crc32(le32(part))))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == Counter(want)
    used = packed_well(rows, capacity)
    assert used <= -(-total // capacity) * 1.1 + 2
    assert packing.pack(packing.token_pieces(none, WORDS, 1, capacity), capacity).collect() == []


def test_sequences_hold_the_tokens(docs, pairs):
    library = Tokenizer.from_file(WORDS)
    packed = packing.pack(packing.token_pieces(docs, WORDS, 1, 64, keep_ids=True), 64)
    sequences = [r.ids for r in packing.sequences(packed).collect()]
    want = Counter(i for _, t in pairs for i in [*library.encode(t, add_special_tokens=False).ids, 1])
    assert Counter(i for s in sequences for i in s) == want and max(map(len, sequences)) <= 64


def test_a_length_outside_the_capacity_is_an_error(spark):
    from pyspark.errors import PySparkException

    with pytest.raises(PySparkException, match="length outside the capacity"):
        packing.pack(spark.createDataFrame([(1, 9)], "doc_id long, length long"), 8).collect()


def test_token_files_round_trip(spark, docs, none, pairs, tmp_path):
    library, out = Tokenizer.from_file(BYTES), str(tmp_path / "tokens")
    tokenfiles.write_tokens(docs, out, BYTES, end_id=2)
    rows = tokenfiles.located(spark, out).orderBy("start").collect()
    ids = {}
    for i, t in pairs:
        ids.setdefault(i, []).append(library.encode(t, add_special_tokens=False).ids + [2])
    assert [r.doc_id for r in rows] == sorted((i for i, _ in pairs), key=lambda i: (i is not None, i))
    start = 0
    for r in rows:
        assert r.start == start and (r.n_tokens, r.ids_crc32) in [(len(x), zlib.crc32(le32(x))) for x in ids[r.doc_id]]
        start += r.n_tokens
    one = tokenfiles.read_tokens(spark, out, ["ids"], F.col("doc_id") == 9).collect()
    assert [r.ids for r in one] == ids[9]
    empty = str(tmp_path / "none")
    tokenfiles.write_tokens(none, empty, BYTES, end_id=2)
    assert tokenfiles.located(spark, empty).collect() == []


def test_token_files_have_their_encodings_and_page_indexes(docs, tmp_path):
    import pyarrow.parquet as pq

    out = tmp_path / "tokens"
    tokenfiles.write_tokens(docs.coalesce(1), str(out), BYTES, end_id=2)
    columns = [
        pq.ParquetFile(f).metadata.row_group(0).column(c) for f in sorted(out.glob("*.parquet")) for c in range(3)
        if pq.ParquetFile(f).metadata.num_row_groups
    ]
    assert columns
    for column in columns:
        assert column.has_column_index and column.has_offset_index
        if column.path_in_schema.startswith("ids"):
            assert column.has_dictionary_page
        else:
            assert "DELTA_BINARY_PACKED" in column.encodings


def test_a_worker_gives_memory_back_around_its_work(monkeypatch):
    import pyarrow as pa

    from wirecorpus.llm import common

    seen = []
    monkeypatch.setattr(common, "give_back", lambda: seen.append("back"))

    def make():
        seen.append("made")
        return lambda batch: seen.append(batch.num_rows) or batch

    batch = pa.RecordBatch.from_pylist([{"text": "x" * 700_000}] * 3)
    assert len(list(common.by_slice(make, "text")([batch, batch]))) == 6
    assert seen == ["back", "made", 1, 1, 1, 1, 1, 1, "back"]
