"""Operators over documents against brute force, held-out accuracy and planted cases."""

import random
import re
import textwrap
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.conftest import invented
from wirecorpus.llm import compression, langid, licences, line_crf, phrases, sharding, superminhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# op1 -------------------------------------------------------------------------------------------

def base_counts(t):
    words = WORD.findall(t)
    windows = list(zip(words, words[1:], words[2:]))
    many, inside = Counter(windows), set()
    for k, w in enumerate(windows):
        if many[w] > 1:
            inside |= {k, k + 1, k + 2}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(inside)


def test_base_counts(docs, none, pairs):
    model = line_crf.LineField()
    rows = line_crf.judge(docs, model).collect()
    want = Counter((i, *base_counts(t)) for i, t in pairs)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows) == want
    for r in rows:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed)  # a model without weights takes all lines for content
    assert line_crf.judge(none, model).collect() == []


def test_viterbi_is_the_best_labelling():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 8):
        scores, move = rng.normal(size=(n, 2)), rng.normal(size=(2, 2))

        def total(labels):
            return sum(scores[i, x] for i, x in enumerate(labels)) + sum(move[a, b] for a, b in zip(labels, labels[1:]))

        best = max((total([k >> i & 1 for i in range(n)]) for k in range(2 ** n)))
        assert total(line_crf.viterbi(scores, move)) == pytest.approx(best)


def test_field_tells_boilerplate_lines():
    rnd = random.Random(1)
    good = ["\n".join(invented(rnd, 30) + "." for _ in range(8)) for _ in range(40)]
    bad = ["\n".join(f"$$$ %%% {invented(rnd, 2)} ### |" for _ in range(8)) for _ in range(40)]
    model = line_crf.train(good[:30] + bad[:30], [1] * 30 + [0] * 30)
    mixed = good[30] + "\n" + bad[30]
    lines = line_crf.Lines([mixed, *good[31:], *bad[31:]])
    scores = lines.scores(model)
    labels = [line_crf.viterbi(scores[a:b], model.move) for a, b in zip(lines.first, lines.first[1:])]
    assert labels[0] == [1] * 8 + [0] * 8
    assert all(all(x) for x in labels[1:10]) and not any(any(x) for x in labels[10:])


def quality_texts(rnd, many):
    """Texts of lines that are content, or mostly boilerplate of several kinds."""
    good = ["\n".join(invented(rnd, rnd.randint(8, 40)).capitalize() + "." for _ in range(rnd.randint(3, 12))) for _ in range(many)]
    odd = [lambda: f"{invented(rnd, 3)} | {invented(rnd, 2)} | {invented(rnd, 1)}", lambda: "$$$ BUY NOW!!! " + invented(rnd, 2).upper(),
           lambda: f"### {rnd.randint(0, 999)} ### %%%", lambda: "click here click here click here"]
    bad = ["\n".join(rnd.choice(odd)() for _ in range(rnd.randint(3, 12))) for _ in range(many)]
    return good, bad


def test_lines_of_mixed_documents_are_told_apart():
    """Runs of boilerplate in documents held out, and of content in boilerplate: single lines are right."""
    rnd = random.Random(21)
    good, bad = quality_texts(rnd, 60)
    model = line_crf.train(good[:40] + bad[:40], [1] * 40 + [0] * 40)
    texts, marks = line_crf.spliced(good[40:] + bad[40:], [1] * 20 + [0] * 20, seed=3)
    assert [t.count("\n") + 1 for t in texts] == [len(m) for m in marks] and len(texts) == 40
    _, labels, share, _, _ = line_crf._verdict(texts, model)
    assert np.concatenate([a == b for a, b in zip(labels, marks)]).mean() > 0.95
    assert np.mean((share > 0) & (share < 1)) > 0.9
    whole = line_crf._verdict(good[40:] + bad[40:], model)[2]
    assert (whole[:20] > 0.9).all() and (whole[20:] < 0.1).all()


def test_shares_and_verdicts_are_those_of_a_plain_loop(spark):
    """Every labelling of short chains tried, with a fitted model; content words and verdict counted by hand."""
    rnd = random.Random(22)
    good, bad = quality_texts(rnd, 30)
    model = line_crf.train(good + bad, [1] * 30 + [0] * 30)
    texts = [t for t in line_crf.spliced(good, [1] * 30)[0] + good[:10] + bad[:10]]
    texts += [g + "\n" + b for g, b in zip(good[10:20], bad[10:20])]
    texts = ["\n".join(t.split("\n")[:10]) for t in texts]
    rows = {r.doc_id: r for r in line_crf.judge(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for k, text in enumerate(texts):
        lines = line_crf.Lines([text])
        emit = [[sum(model.emit[f][c] for f in features) for c in (0, 1)] for features in lines.active.tolist()]

        def score(path):
            return sum(e[c] for e, c in zip(emit, path)) + sum(model.move[a][b] for a, b in zip(path, path[1:]))

        paths = [[m >> i & 1 for i in range(len(emit))] for m in range(2 ** len(emit))]
        best = max(map(score, paths))
        words = [len(WORD.findall(line)) for line in text.split("\n")]
        shares = {sum(w * c for w, c in zip(words, p)) / max(1, sum(words)) for p in paths if score(p) > best - 1e-9}
        assert any(abs(rows[k].content_share - s) < 1e-9 for s in shares)
        assert rows[k].kept == (not rows[k].base_failed and rows[k].content_share >= 0.5)


def test_quality_rules_on_the_corpus(corpus, corpus_labels):
    """Clean documents stay, labelled junk goes."""
    model = line_crf.fit(corpus, corpus_labels)
    rows = line_crf.judge(corpus, model).join(corpus_labels, "doc_id").collect()
    clean = [r.kept for r in rows if r.quality == 1 and not r.base_failed]
    junk = [r.kept for r in rows if r.quality == 0]
    assert np.mean(clean) > 0.97 and np.mean(junk) < 0.15
    kept = {r.doc_id for r in line_crf.keep_rows(corpus, model).collect()}
    assert kept == {r.doc_id for r in line_crf.judge(corpus, model).where("kept").collect()}


def test_one_of_each_hands_on_any_columns(spark, docs):
    """Names that the operator uses itself stay as they are, with their values."""
    named = docs.selectExpr("*", "doc_id AS _near_id", "text AS _near_key", "'v' AS _near_word_key", "1 AS node", "2 AS comp")
    rows = superminhash.one_of_each(named).collect()
    assert superminhash.one_of_each(named).columns == named.columns
    assert all(r._near_id == r.doc_id and r._near_key == r.text and r._near_word_key == "v" for r in rows)
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in superminhash.one_of_each(docs).collect())


# op4 -------------------------------------------------------------------------------------------

def test_shards(docs, none, pairs):
    rows = sharding.shard_by_size(docs, 4).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter(
        (i, len(t.encode()) + 8, zlib.crc32(t.encode())) for i, t in pairs)
    assert {(r.law, r.grown_shard) for r in rows} == {("bytes", None)}
    by, home = {}, {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
        assert home.setdefault((r.text_crc32, r.size), r.shard) == r.shard
    assert all(sorted(slots) == list(range(len(slots))) for slots in by.values()) and set(by) <= set(range(4))
    assert sharding.shard_by_size(none, 4).collect() == []


def test_schedule_is_longest_first_into_the_least_load():
    rnd = random.Random(2)
    items = [(f"i{k}", rnd.randint(1, 100)) for k in range(200)]
    placed, loads = sharding.schedule(items, 7), [0] * 7
    for name, size in sorted(items, key=lambda i: (-i[1], i[0])):
        assert placed[name] == loads.index(min(loads))
        loads[placed[name]] += size


def test_shards_of_the_corpus_are_level(spark):
    rnd = random.Random(3)
    rows = [(i, "x" * rnd.randint(1, 400) + str(i)) for i in range(20_000)] + [(-i, "hot copy " * 30) for i in range(1, 200)]
    loads = Counter()
    for r in sharding.shard_by_size(spark.createDataFrame(rows, "doc_id long, text string"), 8).collect():
        loads[r.shard] += r.size
    assert max(loads.values()) <= 1.002 * min(loads.values())


# op5 -------------------------------------------------------------------------------------------

def test_language_on_held_out_documents(corpus, docs, none):
    held = "crc32(cast(cast(doc_id as string) as binary)) % 3 = 1"
    model = langid.fit(corpus.where(f"not ({held})"))
    rows = langid.predict(corpus.where(held), model).join(corpus.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.lang_pred == r.lang for r in rows]) > 0.95
    assert np.mean([r.rejected for r in rows]) < 0.01
    odd = langid.predict(docs, model).join(docs.select("doc_id", "text"), "doc_id").collect()
    for r in odd:
        lettered = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not lettered) and 0 <= r.score <= 1 and (lettered or r.rejected)
    assert langid.predict(none, model).collect() == [] and langid.fit(none).languages == []
    assert {r.lang_pred for r in langid.predict(docs, langid.fit(none)).collect()} == {"und"}


@pytest.mark.parametrize("unlearned", ["es", "de"])
def test_unlearned_languages_and_gibberish_are_rejected(corpus, unlearned):
    """By a model of the other languages; clean documents of these stay, and odd labels do not matter."""
    rnd = random.Random(11)
    held = "crc32(cast(cast(doc_id as string) as binary)) % 3 = 1"
    rows = [r for r in corpus.where(held).select("doc_id", "text", "lang").collect() if len(r.text or "") > 200]
    letters = lambda: " ".join("".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=rnd.randint(2, 9))) for _ in range(80))
    shuffled = ["".join(rnd.sample(r.text, len(r.text))) for r in rows[:60]]
    spark, schema = corpus.sparkSession, "doc_id long, text string"

    odd = [(-i, letters(), "en") for i in range(1, 4)]
    training = corpus.where(f"not ({held}) and lang != '{unlearned}'").select("doc_id", "text", "lang")
    model = langid.fit(training.union(spark.createDataFrame(odd, schema + ", lang string")))
    assert unlearned not in model.languages

    def kept(texts):
        some = spark.createDataFrame(list(enumerate(texts)), schema)
        found = langid.predict(some, model).where("not rejected").count()
        assert found == langid.keep_rows(some, model).count()
        return found / len(texts)

    assert kept([r.text for r in rows if r.lang == unlearned]) < 0.1
    assert kept([letters() for _ in range(60)]) < 0.05 and kept(shuffled) < 0.1
    assert kept([r.text for r in rows if r.lang != unlearned]) > 0.97


def plain_bucket(octets):
    """Bucket of a subword, with plain integers."""
    mask = (1 << 64) - 1
    x = 0
    for o in octets:
        x = (x * 0x100000001B3 + o + 1) & mask
    x = (x + len(octets)) & mask
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & mask
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & mask
    return (x ^ (x >> 31)) % langid.BUCKETS


def test_predictions_are_those_of_plain_sums(spark, corpus):
    """Average of the rows of all subwords, constant, softmax, fluency: one text after the other."""
    held = "crc32(cast(cast(doc_id as string) as binary)) % 3 = 1"
    model = langid.fit(corpus.where(f"not ({held})"))
    texts = [r.text for r in corpus.where(held).limit(12).collect()] + ["é", "Été 12 à", "x", "zq qz"]
    rows = {r.doc_id: r for r in langid.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for k, text in enumerate(texts):
        octets = [o if o > 127 else ord(chr(o).lower()) if chr(o).isalpha() else 32 for o in b" " + text.encode() + b" "]
        buckets = []
        for n in range(1, 5):
            for a in range(len(octets) - n + 1):
                part = octets[a: a + n]
                if 32 not in part[1:-1] and set(part) != {32}:
                    buckets.append(plain_bucket(part))
        logits = model.bias + np.mean([model.table[b] for b in buckets], axis=0, dtype=np.float64)
        share = np.exp(logits - logits.max()) / np.exp(logits - logits.max()).sum()
        best = int(share.argmax())
        assert rows[k].lang_pred == model.languages[best] and rows[k].score == pytest.approx(share[best], abs=1e-4)
        fluency = np.mean([model.usual[b, best] for b in buckets], dtype=np.float64) + 2 * model.spread[best] / np.sqrt(len(buckets))
        if abs(fluency - model.least[best]) > 1e-3:
            assert rows[k].rejected == (fluency < model.least[best])


def test_training_spans_make_up_the_text():
    rng = np.random.default_rng(1)
    for text in ["", "a", "é" * 3000, invented(random.Random(3), 900)]:
        spans = langid._spans(text.encode(), rng)
        assert b"".join(spans) == text.encode() and all(s.decode() for s in spans)
        assert max(map(len, spans), default=0) <= langid.SPANS[1] + 3


def test_all_languages_are_learned_from_one_pass(spark):
    """More labels than any bound of before, one of them a third of all rows."""
    rnd = random.Random(5)
    alphabet = {f"l{k}": "".join(rnd.sample("abcdefghijklmnopqrstuvwxyz", 6)) for k in range(12)}
    rows = [(i, " ".join("".join(rnd.choices(alphabet[lang], k=4)) for _ in range(20)), lang)
            for i, lang in enumerate([f"l{i % 12}" for i in range(240)] + ["l0"] * 120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, per_language=15)
    assert model.languages == sorted(alphabet)
    right = [r.lang_pred == r.lang for r in langid.predict(docs, model).join(docs, "doc_id").collect()]
    assert np.mean(right) > 0.9


def test_subwords_are_those_of_a_plain_loop():
    text = "Ab é, x1y"
    octets = [c if chr(c).isalpha() or c > 127 else 32 for c in b" ab \xc3\xa9, x1y "]
    want = Counter()
    for n in range(1, 5):
        for a in range(len(octets) - n + 1):
            part = octets[a: a + n]
            inner = part[1:-1] if n > 2 else []
            if 32 not in inner and set(part) != {32} and not (n == 1 and part == [32]):
                want[n] += 1
    got = Counter({n: len(b) for n, (b, _) in enumerate(langid.subwords([text.encode()]), 1)})
    assert got == want


# op6 -------------------------------------------------------------------------------------------

def test_compression_on_held_out_documents(corpus, corpus_labels, docs, none, labels):
    held = "crc32(cast(cast(doc_id as string) as binary)) % 3 = 1"
    model = compression.fit(corpus, corpus_labels.where(f"not ({held})"))
    rows = compression.score(corpus, model).join(corpus_labels.where(held), "doc_id").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.85
    odd = compression.score(docs, model).collect()
    assert len(odd) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in odd)
    assert compression.score(none, model).collect() == []
    blank = compression.score(docs, compression.fit(none, labels)).collect()
    assert {r.score for r in blank} == {0.5}


def test_dictionaries_know_what_follows_a_clean_opening(spark):
    """Good and bad texts open alike; what tells them apart comes after 8 KB."""
    rnd = random.Random(10)
    clean = [invented(rnd, 12) + "." for _ in range(200)]
    junk = [f"buy {invented(rnd, 3)} cheap at shop{k} now now" for k in range(30)]

    def text(bad):
        opening = " ".join(rnd.choices(clean, k=150))
        return opening + " " + " ".join(rnd.choices(junk if bad else clean, k=200))

    rows = [(i, text(i % 2), 1 - i % 2) for i in range(240)]
    assert min(r[1].find("cheap") for r in rows if not r[2]) > 8000
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = compression.fit(docs.where("doc_id < 210"), docs.select("doc_id", "quality"))
    assert b"cheap at shop" in model.bad and b"cheap at shop" not in model.good
    found = compression.score(docs.where("doc_id >= 210"), model).collect()
    assert all(r.predicted == 1 - r.doc_id % 2 for r in found)


def test_dictionary_of_few_texts():
    assert compression._dictionary([b"a few words"]) == b"a few words" and compression._dictionary([]) == b""
    same = compression._dictionary([b"x" * 5000] * 200)
    assert 0 < len(same) <= compression.DICTIONARY
    compression.Compressors(same, b"a few words").measure(b"x" * 3000)


# op7 -------------------------------------------------------------------------------------------

def test_equal_substrings_share_phrases():
    rnd = random.Random(4)
    middle = invented(rnd, 400)
    for level in (1, 3, 5):
        one = set(phrases.phrases([invented(rnd, 20) + middle + invented(rnd, 7)], level)[0].tolist())
        two = set(phrases.phrases(["q" + invented(rnd, 33) + middle], level)[0].tolist())
        own = set(phrases.phrases([middle], level)[0].tolist())
        assert len(one & two & own) > 0.9 * len(own)


def test_parse_depends_on_the_text_alone():
    rnd = random.Random(6)
    some = [invented(rnd, rnd.randint(0, 80)) for _ in range(20)] + ["", "a", "aaaa", "abab" * 50, "é"]
    alone = [phrases.fingerprints([t])[0].tolist() for t in some]
    assert [f.tolist() for f in phrases.fingerprints(some)] == alone
    values, owner = phrases.phrases(some)
    for i, t in enumerate(some):
        assert alone[i] == sorted(set(values[owner == i].tolist()))[: phrases.KEEP]


def test_fingerprints_of_edits(docs, none, pairs):
    rows = phrases.fingerprint_edits(docs).collect()
    import hashlib

    def next_of(order):
        return {k: order[(k + 1) % len(order)][1] for k in range(len(order))}

    ids = [r.doc_id for r in rows]
    assert Counter(ids) == Counter(i for i, _ in pairs)
    distinct = sorted({(i, t) for i, t in pairs if i is not None}, reverse=True)
    by = {r.doc_id: r for r in rows}
    order = sorted(pairs, key=lambda p: (p[0] is None, -(p[0] or 0)))
    after = next_of(order)
    repeated = {i for i, n in Counter(i for i, _ in pairs).items() if n > 1}
    for k, (i, t) in enumerate(order):
        if i in repeated:
            continue
        want = phrases.edited(t, after[k])
        assert by[i].n_chars == len(t) and by[i].edited_sha256 == hashlib.sha256(want.encode()).hexdigest()
        own, other, following = phrases.fingerprints([t, want, after[k]])
        assert by[i].fingerprint == phrases.as_text(own) and by[i].edited_fingerprint == phrases.as_text(other)
        assert by[i].near_edited == phrases.likeness(own, other) and by[i].near_next == phrases.likeness(own, following)
    assert distinct and phrases.fingerprint_edits(none).collect() == []
    single = phrases.fingerprint_edits(docs.where("doc_id = 9").limit(1)).collect()
    assert len(single) == 1 and single[0].near_next == 1.0


def test_copies_and_others_on_the_corpus(corpus):
    rows = phrases.fingerprint_edits(corpus).collect()
    texts = dict(corpus.select("doc_id", "text").collect())
    prints = {}
    for r in rows:
        assert prints.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint
    longer = [r for r in rows if r.n_chars > 300]
    assert np.mean([r.near_edited > r.near_next for r in longer]) > 0.98
    assert np.median([r.near_edited for r in longer]) > 0.4


# op8 -------------------------------------------------------------------------------------------

def brute_scan(text, threshold=0.8):
    units = [(0, text), *enumerate(text.split("\n"), 1)]
    hits = []
    for at, unit in units:
        own = set(licences.bigram_set(unit))
        for name, body in licences.NOTICES.items():
            other = set(licences.bigram_set(body))
            if own and 2 * len(own & other) / (len(own) + len(other)) >= threshold:
                hits.append((-2 * len(own & other) / (len(own) + len(other)), name, at))
    return sorted(hits)


def test_licences(spark, none):
    cases = [
        None, "", "\n\n", licences.NOTICES["mit"], "some text\n" + licences.NOTICES["gpl-3.0"].upper() + "\nmore text",
        "Licensed under CC BY-NC 4.0!", "Licensed under CC BY 4.0", "licensed under nothing at all version 2 0",
        licences.NOTICES["bsd-clause"].replace("binary", "object") + " x", "a b\n" * 300 + licences.NOTICES["mit"],
        licences.NOTICES["gpl-notice"].replace(" ", "\n"), "Released under the MIT License. " * 50,
    ]
    rows = licences.scan(spark.createDataFrame([(i, t, 0) for i, t in enumerate(cases)], "doc_id long, text string, hits int"))
    for r in rows.collect():
        want = brute_scan(cases[r.doc_id] or "")
        assert [(h.line, h.licence) for h in r.hits] == [(at, name) for _, name, at in want], cases[r.doc_id]
        assert (r.licence, r.dice) == ((want[0][1], -want[0][0]) if want else (None, None))
        assert r.n_hits == len({at for _, _, at in want if at})
    assert licences.scan(none).collect() == []


def test_no_python_in_the_licence_plan(docs):
    plan = licences.scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Exchange", plan.split("Project")[1])


def brute_passages(text, threshold=0.8):
    """All runs of words within the bounds, none left out by its edges."""
    words, found = licences.normal_words(text), []
    bigrams = [f"{a} {b}" for a, b in zip(words, words[1:])]
    for name, body in licences.NOTICES.items():
        other = set(licences.bigram_set(body))
        low, high = threshold * len(other) / (2 - threshold), len(other) * (2 - threshold) / threshold
        done = []
        for a in range(len(bigrams)):
            own, best = set(), None
            if bigrams[a] not in other:
                continue
            for n, b in enumerate(bigrams[a: a + int(high)], 1):
                own.add(b)
                dice = 2 * len(own & other) / (len(own) + len(other))
                if n >= low and dice >= threshold and (best is None or dice > best[0]):
                    best = (dice, name, a + 1, n + 1)
            if best and (not done or best[2] > done[-1][2] + done[-1][3] - 2):
                done.append(best)
            elif best and best[0] > done[-1][0]:
                done[-1] = best
        found += done
    return sorted(found, key=lambda m: (-m[0], *m[1:]))


def test_licence_passages(spark, none):
    """Notices that are wrapped, in the middle of a line, or both, which no line and no whole text shows."""
    rnd = random.Random(9)
    wrapped = {name: "\n".join(" * " + x for x in textwrap.wrap(body, 75)) for name, body in licences.NOTICES.items()}
    around = lambda t: f"{invented(rnd, 120)}\n{t}\n{invented(rnd, 120)}"
    names = ["mit-permission", "bsd-clause", "gpl-notice", "apache-2.0-notice"]
    inline = "Copyright 2020 X. Released under the MIT License. All rights reserved by the authors."
    cases = [*(around(wrapped[n]) for n in names), inline, around(inline), around(wrapped[names[0]] + "\n" + wrapped[names[2]]),
             None, "", "...", "word", "Released under the MIT License. " * 50, invented(rnd, 200),
             around(licences.NOTICES["bsd-clause"].replace("binary", "object or other")), " ".join([licences.NOTICES["gpl-notice"]] * 3)]
    rows = spark.createDataFrame([(i, t, 0) for i, t in enumerate(cases)], "doc_id long, text string, passages int")
    found = {r.doc_id: r for r in licences.passages(rows).collect()}
    assert len(found) == len(cases)
    for i, text in enumerate(cases):
        want = brute_passages(text or "")
        assert [tuple(m) for m in found[i].passages] == want, text
        assert found[i].n_passages == len(want)
        assert (found[i].licence, found[i].dice) == ((want[0][1], want[0][0]) if want else (None, None))
    assert all(n in {m.licence for m in found[i].passages} for i, n in enumerate(names)) and found[4].licence == found[5].licence == "mit"
    assert licences.passages(none).collect() == []
    assert not re.search("Python|Arrow|Exchange", licences.passages(rows.where("doc_id > 0"))._jdf.queryExecution().executedPlan().toString().split("Project")[1])


# op9 -------------------------------------------------------------------------------------------

def brute_components(pairs, words, percent):
    sets = [superminhash.shingle_set(t, words) for _, t in pairs]
    home = list(range(len(pairs)))

    def find(x):
        while home[x] != x:
            x = home[x]
        return x

    for a in range(len(pairs)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                home[find(a)] = find(b)
    ids = {}
    for a, (i, _) in enumerate(pairs):
        if i is not None:
            ids[find(a)] = min(ids.get(find(a), i), i)
    return [(i, len(sets[a]), ids.get(find(a)), i == ids.get(find(a))) for a, (i, _) in enumerate(pairs)]


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates(docs, none, pairs, words):
    rows = superminhash.near_duplicates(docs, words).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in rows) == Counter(brute_components(pairs, words, 80))
    assert superminhash.near_duplicates(none, words).collect() == []


def test_near_duplicates_of_the_corpus(corpus):
    pairs = [(r.doc_id, r.text) for r in corpus.select("doc_id", "text").collect()]
    rows = superminhash.near_duplicates(corpus, 2).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in rows) == sorted(brute_components(pairs, 2, 80))


def test_a_bucket_of_texts_that_are_not_alike_is_compared_whole(spark):
    """One band of one row: nearly everything shares buckets, and no centre links them all."""
    rnd = random.Random(8)
    common = invented(rnd, 40)
    groups = [common + " " + invented(rnd, 40) for _ in range(8)]
    pairs = [(10 * g + k, t + (f" tail{k}" if k else "")) for g, t in enumerate(groups) for k in range(3)]
    rows = superminhash.near_duplicates(
        spark.createDataFrame(pairs, "doc_id long, text string"), 2, bands=12, rows=1).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in rows) == sorted(brute_components(pairs, 2, 80))


def test_one_of_each_keeps_columns(docs, pairs):
    kept = superminhash.one_of_each(docs, 2)
    assert kept.columns == docs.columns
    components = brute_components(pairs, 2, 80)
    linked = {c for _, n, c, _ in components if n}
    rows = kept.collect()
    assert Counter(r.doc_id for r in rows if (r.text or "").split()) == Counter(linked)


def test_superminhash_estimates_and_spreads():
    rng = np.random.default_rng(0)
    errors = []
    for _ in range(40):
        base = rng.integers(0, 2 ** 63, size=300).astype(np.uint64)
        a, b = base[:250], base[50:]
        owner = np.concatenate([np.zeros(250, int), np.ones(250, int)])
        signature = superminhash.superminhash(np.concatenate([a, b]), owner, 2, 128)
        errors.append((signature[0] == signature[1]).mean() - 200 / 300)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05
    one = superminhash.superminhash(np.array([7], dtype=np.uint64), np.array([0]), 1, 16)
    assert sorted((one >> np.uint64(32)).tolist()[0]) == list(range(16))


def test_union_find_on_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (502, 501)], "u long, v long").repartition(7)
    rows = dict(superminhash.union_find(edges).collect())
    assert {rows[i] for i in range(201)} == {0} and {rows[i] for i in (500, 501, 502)} == {500}
