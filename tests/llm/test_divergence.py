"""Source divergence against plain counting over every term of every group."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from wirecorpus.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, least, top):
    """(lang, source, part, item, value, rank) of rows (text, lang, source)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    inside, count = Counter(), Counter()
    for text, lang, source in rows:
        terms = TERM.findall(text.translate(LOWER))
        inside.update((lang, t) for t in set(terms))
        count.update((lang, source, t) for t in terms)
    groups = defaultdict(set)
    for _, lang, source in rows:
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for (x, t), n in inside.items() if x == lang and n >= least)

        def p_of(n, whole):
            return 1 + 10 ** 9 * (n + 2) // (whole + 2 * len(kept))

        n_of = {s: [count[lang, s, t] for t in kept] for s in sources}
        p = {s: [p_of(n, sum(ns)) for n in ns] for s, ns in n_of.items()}
        total = [sum(x) for x in zip(*n_of.values())]
        q = [p_of(n, sum(total)) for n in total]
        for s in sources:
            pairs = [(o, sum((a - b) ** 2 // (a + b) for a, b in zip(p[s], p[o]))) for o in sources if o != s]
            terms = [(t, (a - b) ** 2 // (a + b)) for t, n, a, b in zip(kept, n_of[s], p[s], q) if n and a > b]
            for part, items, last in (("pair", pairs, None), ("term", terms, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, *x, k) for k, x in enumerate(items[:last], 1)]
    return Counter(out)


def invented_rows():
    rnd = random.Random(6)
    words = ["Öl", "öl", "the", "The", "the,", "a-b", "a-a", "x1y", "naïve.", "12", "--", "日本", "Zed", "ßa", "(end)", "rare%d"]
    rows = []
    for k in range(300):
        lang = rnd.choice(["en", "en", "de", "", None])
        some = rnd.choices(words, k=rnd.randint(0, 25))
        text = rnd.choice([" ", "\n", "\t ", "\x0b"]).join(w % k if "%d" in w else w for w in some)
        rows.append((text, lang, rnd.choice(["hot", "hot", "hot", "s1", "s2", "s3", "S4", "é", "", None])))
    rows += [(None, "en", "silent"), ("", "only", "one"), ("...", "two", "a"), ("7", "two", "b")]
    return rows + rows[:9]


SCHEMA = "text string, lang string, source string"


@pytest.mark.parametrize("least,tile_sources,tile_counts", [(10, 256, 500_000), (3, 3, 10), (1, 2, 25), (400, 256, 500_000)])
def test_against_plain_counting(spark, monkeypatch, least, tile_sources, tile_counts):
    monkeypatch.setattr(divergence, "TILE_SOURCES", tile_sources)
    monkeypatch.setattr(divergence, "TILE_COUNTS", tile_counts)
    rows = invented_rows()
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS `group`", "'x' AS term", "2 AS lang_no").repartition(5)
    got = divergence.audit(docs, least_docs=least, top=4)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert Counter(map(tuple, got.collect())) == brute(rows, least, 4)


def test_term_spread_over_forms_and_blocks(spark, monkeypatch):
    """A term that no chunk form alone has in enough documents, over many blocks of documents."""
    monkeypatch.setattr(divergence, "BLOCK_WORDS", 7)
    forms = ["term", "Term", "term,", "TERM.", "(term)", "term-7"]
    rows = [(f"{forms[k % 6]} {forms[k % 6]} {forms[(k + 1) % 6]}", "en", f"s{k % 3}") for k in range(10)]
    rows += [("nine terms", "en", "s0")] * 9 + [("other", "de", "s0")] * 12
    got = divergence.audit(spark.createDataFrame(rows, SCHEMA).repartition(4))
    assert Counter(map(tuple, got.collect())) == brute(rows, 10, 10)


def test_long_text_and_empty_table(spark):
    rows = [("word Other " * 120_000, "en", "a"), ("word", "en", "b"), ("other words", "en", "b")]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert Counter(map(tuple, divergence.audit(docs, 2).collect())) == brute(rows, 2, 10)
    assert divergence.audit(docs.where("false")).collect() == []


def test_exact_shares():
    rnd = random.Random(1)
    counts = [0, 1, 2, *(rnd.randrange(10 ** 15) for _ in range(200))]
    wholes = [1 + rnd.randrange(10 ** 15) + c for c in counts]
    got = divergence.shares(np.array(counts), np.array(wholes)).tolist()
    assert got == [1 + 10 ** 9 * (c + 2) // w for c, w in zip(counts, wholes)]
