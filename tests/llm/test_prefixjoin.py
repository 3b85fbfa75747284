"""N-gram join against all pairs compared on whole sets."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from tests.llm.conftest import invented
from wirecorpus.llm import prefixjoin

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, words):
    found = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")]
    if len(found) < words:
        return {tuple(found)} if found else set()
    return {tuple(found[i: i + words]) for i in range(len(found) - words + 1)}


def brute(rows, words, percent):
    sets = [shingles(t, words) for _, t in rows]
    comp = list(range(len(rows)))

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i, one in enumerate(sets):
        for j in range(i):
            if one and sets[j] and 100 * len(one & sets[j]) >= percent * len(one | sets[j]):
                comp[find(i)] = find(j)
    least = {}
    for i, (ident, _) in enumerate(rows):
        known = least.get(find(i))
        least[find(i)] = ident if known is None else known if ident is None else min(known, ident)
    return Counter((ident, len(s), least[find(i)]) for i, ((ident, _), s) in enumerate(zip(rows, sets)))


def family(rnd, first, many, size, changed):
    """Texts of one base with some words changed: neighbours are alike, others less."""
    base = invented(rnd, size).split()
    rows = []
    for k in range(many):
        words = list(base)
        for at in rnd.sample(range(size), rnd.randint(0, changed)):
            words[at] = f"w{rnd.randint(0, 5)}"
        rows.append((first + k, " ".join(words)))
    return rows


@pytest.mark.parametrize("words,percent", [(5, 80), (2, 60), (1, 50)])
def test_against_all_pairs(spark, docs, pairs, words, percent):
    rnd = random.Random(words)
    more = family(rnd, 100, 60, 80, 3) + family(rnd, 200, 40, 40, 6) + family(rnd, 300, 40, 12, 1)
    more += [(400, "one two three four"), (401, "ONE  two\nthree four"), (402, "one two three"), (403, "one two three four five")]
    more += [(450 + k, more[k % 7][1].upper()) for k in range(20)]
    rows = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    got = prefixjoin.linked(rows.selectExpr("*", "1 AS node", "2 AS gram", "3 AS mark"), words, percent)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    every = [(r.doc_id, r.text) for r in rows.select("doc_id", "text").collect()]
    assert Counter(map(tuple, got.collect())) == brute(every, words, percent)


def test_groups_in_tiles_and_over_rounds(spark, monkeypatch):
    """Chains of texts where only neighbours are alike, so centres do not reach all of a group."""
    monkeypatch.setattr(prefixjoin, "TILE", 4)
    rnd = random.Random(8)
    rows = []
    for chain in range(3):
        words = invented(rnd, 60).split()
        for k in range(40):
            rows.append((1000 * chain + k, " ".join(words)))
            words[(k * 7) % 60] = f"new{chain}x{k}"
    rnd.shuffle(rows)
    for rounds in [(1, 4, 16), (1,)]:
        monkeypatch.setattr(prefixjoin, "CENTRES", rounds)
        got = prefixjoin.linked(spark.createDataFrame(rows, "doc_id long, text string"), 2, 80)
        assert Counter(map(tuple, got.collect())) == brute(rows, 2, 80)


def test_edges_of_the_threshold(spark):
    """Sets of 9 elements, 8 and 7 of them common: 8 / 10 is linked at 80, 7 / 11 is not."""
    base = [f"b{k}" for k in range(9)]
    rows = [(k, " ".join(base[:9 - k] + [f"x{k}_{j}" for j in range(k)])) for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, prefixjoin.linked(docs, 1, 80).collect())) == Counter({(0, 9, 0): 1, (1, 9, 0): 1, (2, 9, 2): 1})
    assert Counter(map(tuple, prefixjoin.linked(docs, 1, 81).collect())) == Counter({(k, 9, k): 1 for k in range(3)})


def test_empty_table_and_long_text(spark, none):
    assert prefixjoin.linked(none).collect() == []
    words = invented(random.Random(2), 200_000).split()
    rows = [(1, " ".join(words)), (2, " ".join(words[:180_000])), (3, " ".join(words[:120_000]))]
    assert len(rows[0][1]) > 1 << 20
    got = {r.doc_id: r.component_id for r in prefixjoin.linked(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_rarity_counts_the_whole_corpus(spark):
    rows = [("common words here and there",)] * 50 + [("a rare text of five words",)]
    table = prefixjoin.rarity(spark.createDataFrame(rows, "text string").repartition(7), 5)
    gram, _, _, _, word = prefixjoin._grams([b"common words here and there", b"a rare text of five words"], 5)
    slots = (gram % np.uint64(prefixjoin.COUNTERS)).astype(int)
    assert table[slots].tolist() == [int(8 * np.log2(51)), 8, 8]
    assert set(table[(word % np.uint64(prefixjoin.COUNTERS)).astype(int) + prefixjoin.COUNTERS].tolist()) == {int(8 * np.log2(51)), 8}


def shuffled(frame):
    """Rows that the exchanges of a plan wrote when the frame was collected."""
    frame.collect()
    total, nodes = 0, [frame._jdf.queryExecution().executedPlan()]
    while nodes:
        node = nodes.pop()
        if node.nodeName() == "Exchange":
            total += node.metrics().apply("shuffleRecordsWritten").value()
        nodes += [node.children().apply(i) for i in range(node.children().size())]
    return total


def test_only_texts_asked_for_are_shuffled(spark):
    rows = [(k, f"text {k} of some words", k + 7) for k in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, mark long")
    wanted = docs.where("doc_id % 500 = 3").selectExpr("doc_id + 9000 AS node", "doc_id", "mark")
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        sets = prefixjoin._gram_sets(docs, wanted, docs.where("false").select("doc_id", "mark"), 2)
        assert shuffled(sets) < 200
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(r.node for r in sets.collect()) == [9003, 9503, 10003, 10503]


def test_no_wanted_row_is_left_out(spark, monkeypatch):
    rows = spark.range(3000).selectExpr("IF(id % 50 = 0, NULL, id) AS doc_id", "-id AS mark")
    wanted = rows.where("mark % 3 = 0")
    some = prefixjoin._perhaps(rows, ["doc_id", "mark"], wanted)
    assert some.columns == ["doc_id", "mark"] and wanted.exceptAll(some).isEmpty()
    assert 1000 <= some.count() < 1100
    assert prefixjoin._perhaps(rows, ["doc_id", "mark"], rows.where("false")).isEmpty()
    monkeypatch.setattr(prefixjoin, "BITS", 64)
    assert prefixjoin._perhaps(rows, ["doc_id", "mark"], wanted).count() == 3000


def test_pairs_of_few_nodes_are_asked_for_once(spark, monkeypatch):
    """Pairs that pass the filters of prefixes and fail on whole sets are not compared round by round."""
    asked, real = [], prefixjoin._verified

    def spy(pairs, sets, percent):
        asked.extend((r.a, r.b) for r in pairs.select("a", "b").collect())
        return real(pairs, sets, percent)

    monkeypatch.setattr(prefixjoin, "_verified", spy)
    rows = []
    for pair in range(10):
        own = [f"p{pair}w{k}" for k in range(352)]
        # 352 of 448: the rare words are common to both, what differs is in all texts
        rows += [(2 * pair + i, " ".join(own + [f"{pool}{k}" for k in range(48)])) for i, pool in enumerate("xy")]
    got = prefixjoin.linked(spark.createDataFrame(rows, "doc_id long, text string"), 1, 80)
    assert Counter(map(tuple, got.collect())) == brute(rows, 1, 80)
    assert asked and len(asked) == len(set(asked))
