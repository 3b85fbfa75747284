"""Vocabulary training against one-merge-at-a-time, and encode/decode."""

from collections import Counter

import pytest

from wirecorpus.operators import vocabulary as v

TEXT = [
    "low lower lowest newer newest wider widest low low new aaaa aaa aa",
    "<packet>: 0a0b0c 0a0b 0a0b0c0d <pck>0a0b<pck>0c0d tcp.len: 0, tcp.seq: 0",
    "banana bandana ananas na na nana abcabc abc bcabc cab",
]


def one_at_a_time(texts, n_merges):
    import re
    pattern = re.compile(v._word_pattern(v.USER_SYMBOLS))
    words = Counter(w.group(1) for t in texts for w in pattern.finditer(v.SPACE + re.sub(r"\s+", v.SPACE, t.strip())))
    state = [(list(w), n) for w, n in words.items() if w not in v.USER_SYMBOLS]
    merges = []
    for _ in range(n_merges):
        pairs = Counter()
        for parts, n in state:
            for pair in zip(parts, parts[1:]):
                pairs[pair] += n
        if not pairs:
            break
        best = min(pairs, key=lambda p: (-pairs[p], p[0].encode(), p[1].encode()))
        merges.append(best)
        for parts, _ in state:
            i = 0
            while i + 1 < len(parts):
                if (parts[i], parts[i + 1]) == best:
                    parts[i:i + 2] = [parts[i] + parts[i + 1]]
                i += 1
    return merges


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXT)], "id INT, text STRING")


@pytest.fixture(scope="module")
def trained(corpus):
    return v.train_vocabulary(corpus, vocab_size=100)


def test_merges_equal_one_at_a_time(spark, trained):
    vocab, merges = trained
    got = [(r.left, r.right) for r in merges.orderBy("rank").collect()]
    assert got == one_at_a_time(TEXT, len(got)) and len(got) > 20


def test_merges_on_documents_equal_one_at_a_time(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").orderBy("doc_id").limit(40)
    texts = [r.text for r in docs.collect()]
    n_chars = len({c for t in texts for c in t})
    _, merges = v.train_vocabulary(docs, vocab_size=n_chars + 46)
    got = [(r.left, r.right) for r in merges.orderBy("rank").collect()]
    assert got == one_at_a_time(texts, len(got)) and len(got) > 30


def test_vocabulary_shape(trained):
    vocab, merges = trained
    rows = vocab.orderBy("id").collect()
    assert [r.id for r in rows] == list(range(len(rows))) and len({r.piece for r in rows}) == len(rows)
    assert [r.piece for r in rows[:3]] == v.BASE_PIECES and [r.piece for r in rows[3:6]] == v.USER_SYMBOLS
    assert len(rows) <= 100


def test_decode_inverts_encode(spark, corpus, trained):
    vocab, merges = trained
    encoded = v.encode(corpus, vocab, merges)
    back = {r.id: r.text for r in v.decode(encoded.select("id", "ids"), vocab).collect()}
    assert back == dict(enumerate(TEXT))
    symbol = {r.piece: r.id for r in vocab.collect()}
    ids = {r.id: r.ids for r in encoded.collect()}
    assert symbol["<packet>"] in ids[1] and ids[1].count(symbol["<pck>"]) == 2


def test_unknown_and_special_ids(spark, trained):
    vocab, merges = trained
    row = spark.createDataFrame([("low ☃",)], "text STRING")
    assert v.encode(row, vocab, merges).first().ids[-1] == 0
    ids = spark.createDataFrame([([-5, 0, 1, 2, 10_000],)], "ids ARRAY<INT>")
    assert v.decode(ids, vocab).first().text == ""


def test_inexact_rounds_reach_the_size(spark, corpus):
    vocab, _ = v.train_vocabulary(corpus, vocab_size=90, exact=False)
    assert vocab.count() <= 90


def test_alphabet_must_fit(spark, corpus):
    with pytest.raises(ValueError):
        v.train_vocabulary(corpus, vocab_size=10)


def test_words_are_looked_up_once_a_slice(spark, trained, monkeypatch):
    """Texts of many slices, null, empty and with marks of their own, as word by word; words are cut as by the pattern."""
    import re

    vocab, merges = trained
    monkeypatch.setattr(v, "ROWS_TOGETHER", 3)
    odd = [None, "", "  ", "\u2581 \u2581x a\u2581b", "low <packet>low", "é new\t\n low", "lower " * 50]
    rows = [(i, odd[i % len(odd)] if i % 2 else TEXT[i % len(TEXT)]) for i in range(40)]
    df = spark.createDataFrame(rows, "id INT, text STRING").coalesce(1)
    ids = {r.piece: r.id for r in vocab.collect()}
    rank = {(r.left, r.right): r.rank for r in merges.collect()}
    pattern = re.compile(v._word_pattern(v.USER_SYMBOLS))
    got = {r.id: r.ids for r in v.encode(df, vocab, merges).collect()}
    for i, text in rows:
        if text is None:
            assert got[i] is None
            continue
        words = [w.group(1) for w in pattern.finditer(v.SPACE + re.sub(r"[ \t\n]+", v.SPACE, text.strip(" ")))]
        want = [ids.get(p, 0) for w in words for p in ([w] if w in v.USER_SYMBOLS else v._merge_word(w, rank))]
        assert got[i] == want
