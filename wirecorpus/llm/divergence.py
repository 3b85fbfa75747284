"""How the sources of a language differ in their terms, by chunk factorization.

A text is first cut at white space only. Each task counts the chunks of every document it reads and
hands on, per distinct chunk and language of its block of documents, the documents (as many as
decide if a term is common enough) and the occurrences per source. Dealt out by chunk, each chunk of
the whole corpus is cut into its terms once, and the terms take over the counts of their chunks.
Only terms that are in enough documents of a language are kept; where one chunk form alone does not
decide this, the documents of all its forms are put together.

Sources are then compared over blocks of terms. A block knows the counts that are not zero; all
terms that two sources both lack give the same summand, which is added once at the end.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from wirecorpus.functions.ordering import number_sorted
from wirecorpus.llm.common import slices
from wirecorpus.session import stage

# words and documents that are counted together in a task
BLOCK_WORDS, BLOCK_DOCS = 4_000_000, 1_000_000
# counts that are not zero in a block of terms
TILE_COUNTS = 500_000
# sources that are compared with one another in a task
TILE_SOURCES = 256
# terms of the report per group
TOP = 10
SCALE = 1_000_000_000

_TERM = re.compile(rb"[A-Za-z\x80-\xff]+")


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indexes start, start + 1, ... of each (start, length), one after the other."""
    total = int(lengths.sum())
    skipped = np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) if len(lengths) else starts
    return np.arange(total) + skipped


def _new(*columns: np.ndarray) -> np.ndarray:
    """True where any of the sorted columns differs from the row before."""
    new = np.ones(len(columns[0]), dtype=bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def _lists(values: pa.Array, begins: np.ndarray) -> pa.ListArray:
    """Lists of the values, each from its begin to the next one's; the last begin is the end."""
    return pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), values)


def terms_of(chunk: bytes) -> list[bytes]:
    """``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` of a chunk in UTF-8, A-Z as a-z."""
    return _TERM.findall(chunk.lower())


PACKED = (
    "bucket int, block long, chunks array<string>, langs array<int>, docs_n array<int>, docs array<int>, "
    "groups_n array<int>, groups array<int>, counts array<int>")


def _pack(words: list[pa.Array], docs_of: list[np.ndarray], group: np.ndarray, lang: np.ndarray, block: int,
          buckets: int, limit: int) -> pa.RecordBatch:
    """The chunks of a block of documents as one row per bucket of chunks."""
    encoded = pa.concat_arrays(words).dictionary_encode()
    chunks = encoded.dictionary
    bucket = np.array([zlib.crc32(c) % buckets for c in chunks.cast(pa.binary()).to_pylist()], dtype=np.int64)
    by_bucket = np.argsort(bucket, kind="stable")  # chunks in the order of their buckets
    code = np.empty(len(chunks), dtype=np.int64)
    code[by_bucket] = np.arange(len(chunks))
    by_group = np.argsort(group, kind="stable")  # documents in the order of their groups
    rank = np.empty(len(group), dtype=np.int64)
    rank[by_group] = np.arange(len(group))
    group, lang, n = group[by_group], lang[by_group], len(group)
    pairs = np.sort(code[encoded.indices.to_numpy()] * n + rank[np.concatenate(docs_of)])
    first = np.flatnonzero(_new(pairs))
    times = np.diff(np.append(first, len(pairs)))
    chunk, doc = np.divmod(pairs[first], n)
    entry = _new(chunk, lang[doc])
    cell = entry | _new(chunk, group[doc])
    begins, cells = np.flatnonzero(entry), np.flatnonzero(cell)
    number = np.cumsum(entry) - 1
    few = np.arange(len(chunk)) - begins[number] < limit
    docs_n, groups_n = np.bincount(number[few], minlength=len(begins)), np.bincount(number[cells], minlength=len(begins))
    home = bucket[by_bucket][chunk[begins]]
    row = np.flatnonzero(_new(home))
    at = np.append(row, len(home))
    docs_at, groups_at = (np.append(0, np.cumsum(x))[at] for x in (docs_n, groups_n))

    def ints(x: np.ndarray) -> pa.Array:
        return pa.array(x.astype(np.int32))

    return pa.RecordBatch.from_arrays([
        ints(home[row]), pa.array(np.full(len(row), block)), _lists(chunks.take(pa.array(by_bucket[chunk[begins]])), at),
        _lists(ints(lang[doc[begins]]), at), _lists(ints(docs_n), at), _lists(ints(doc[few]), docs_at),
        _lists(ints(groups_n), at), _lists(ints(group[doc[cells]]), groups_at),
        _lists(ints(np.add.reduceat(times, cells)), groups_at),
    ], [field.split()[0] for field in PACKED.split(", ")])


def chunk_counts(numbered: DataFrame, buckets: int, limit: int) -> DataFrame:
    """``PACKED`` rows of documents (text, lang_no, group): what each block has of each bucket of chunks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        block = TaskContext.get().partitionId() << 20
        words, docs_of, group, lang, size, docs = [], [], [], [], 0, 0
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                cut = pc.ascii_split_whitespace(part.column(0).cast(pa.large_string()))
                owner = np.repeat(np.arange(part.num_rows), np.diff(cut.offsets.to_numpy()))
                flat = cut.flatten()
                some = pc.greater(pc.binary_length(flat), 0)
                words.append(flat.filter(some))
                docs_of.append(owner[some.to_numpy(zero_copy_only=False)] + docs)
                lang.append(part.column(1).to_numpy())
                group.append(part.column(2).to_numpy())
                size, docs = size + len(words[-1]), docs + part.num_rows
                if size >= BLOCK_WORDS or docs >= BLOCK_DOCS:
                    if size:
                        yield _pack(words, docs_of, np.concatenate(group), np.concatenate(lang), block, buckets, limit)
                    words, docs_of, group, lang, size, docs, block = [], [], [], [], 0, 0, block + 1
        if size:
            yield _pack(words, docs_of, np.concatenate(group), np.concatenate(lang), block, buckets, limit)

    return numbered.select("text", "lang_no", "group").mapInArrow(run, PACKED)


FORMS = "lang_no int, term string, docs array<long>, groups array<int>, counts array<long>"


def _cell_rows(row: np.ndarray, group: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, group, count) with the counts of equal rows and groups added, sorted."""
    order = np.lexsort((group, row))
    row, group, counts = row[order], group[order], counts[order]
    first = np.flatnonzero(_new(row, group))
    return row[first], group[first], np.add.reduceat(counts, first) if len(first) else counts


def chunk_terms(packed: DataFrame, limit: int) -> DataFrame:
    """``FORMS`` rows (lang_no, term, ...) of the chunks of each bucket, every distinct chunk cut once."""
    def run(table: pa.Table) -> pa.Table:
        flat = {name: table[name].combine_chunks().flatten() for name in table.column_names[2:]}
        encoded = flat["chunks"].dictionary_encode()
        found = [terms_of(c) for c in encoded.dictionary.cast(pa.binary()).to_pylist()]
        known: dict[bytes, int] = {}
        terms = np.array([known.setdefault(t, len(known)) for each in found for t in each], dtype=np.int64)
        many = np.array([len(each) for each in found], dtype=np.int64)
        at = np.concatenate([[0], np.cumsum(many)])
        # the terms of each entry: those of its chunk, repeated where the chunk repeats them
        chunk = encoded.indices.to_numpy()
        entry, term = np.repeat(np.arange(len(chunk)), many[chunk]), terms[_ranges(at[chunk], many[chunk])]
        lang = flat["langs"].to_numpy().astype(np.int64)
        base = int(lang.max(initial=0)) + 1
        key = term * base + lang[entry]

        def carried(name: str) -> tuple[np.ndarray, np.ndarray]:
            """(key, index) of what the entries hold under a name, for each of their terms."""
            size = flat[f"{name}_n"].to_numpy().astype(np.int64)
            begins = np.concatenate([[0], np.cumsum(size)])
            return np.repeat(key, size[entry]), _ranges(begins[entry], size[entry])

        key_of, index = carried("groups")
        row, group, counts = _cell_rows(
            key_of, flat["groups"].to_numpy()[index], flat["counts"].to_numpy()[index].astype(np.int64))
        key_of, index = carried("docs")
        rows_n = pa.compute.list_value_length(table["docs"]).to_numpy()
        ident = (np.repeat(table["block"].to_numpy(), rows_n) << 28) + flat["docs"].to_numpy()
        ident = ident[index]
        order = np.lexsort((ident, key_of))
        key_of, ident = key_of[order], ident[order]
        once = _new(key_of, ident)
        key_of, ident = key_of[once], ident[once]
        begins = np.flatnonzero(_new(key_of))
        few = np.arange(len(key_of)) - np.repeat(begins, np.diff(np.append(begins, len(key_of)))) < limit
        rows, cells = np.flatnonzero(_new(row)), np.append(np.flatnonzero(_new(row)), len(row))
        docs_n = np.bincount(np.searchsorted(row[rows], key_of[few]), minlength=len(rows))
        names = pa.array(list(known), pa.binary()).cast(pa.string())
        return pa.Table.from_arrays([
            pa.array((row[rows] % base).astype(np.int32)), names.take(pa.array(row[rows] // base)),
            _lists(pa.array(ident[few]), np.append(0, np.cumsum(docs_n))),
            _lists(pa.array(group.astype(np.int32)), cells), _lists(pa.array(counts), cells),
        ], [field.split()[0] for field in FORMS.split(", ")])

    return packed.groupBy("bucket").applyInArrow(_with_compute(run), FORMS)


def _with_compute(run):
    def loaded(table: pa.Table) -> pa.Table:
        import pyarrow.compute  # noqa: F401  the workers may not have loaded it

        return run(table)
    return loaded


def common_terms(forms: DataFrame, least_docs: int) -> DataFrame:
    """(lang_no, term) of the terms in at least so many documents of the language."""
    sizes = forms.groupBy("lang_no", "term").agg(
        F.max(F.size("docs")).alias("_one"), F.sum(F.size("docs")).alias("_all")).where(F.col("_all") >= least_docs)
    sizes = stage(sizes)
    # no form alone is in enough documents, but all forms together may be
    open_ = sizes.where(F.col("_one") < least_docs).select("lang_no", "term")
    together = (
        forms.select("lang_no", "term", "docs").join(open_, ["lang_no", "term"])
        .select("lang_no", "term", F.explode("docs").alias("doc")).distinct()
        .groupBy("lang_no", "term").agg(F.count(F.lit(1)).alias("_docs")).where(F.col("_docs") >= least_docs)
    )
    return sizes.where(F.col("_one") >= least_docs).select("lang_no", "term").union(together.select("lang_no", "term"))


def _added(forms: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, term, groups, counts): the counts of all forms of a term, added; a block of terms a task."""
    def run(key, table: pa.Table) -> pa.Table:
        terms = table["term"].combine_chunks().dictionary_encode()
        many = pa.compute.list_value_length(table["groups"]).to_numpy()
        row, group, counts = _cell_rows(
            np.repeat(terms.indices.to_numpy(), many), table["groups"].combine_chunks().flatten().to_numpy(),
            table["counts"].combine_chunks().flatten().to_numpy())
        rows = np.flatnonzero(_new(row))
        at = np.append(rows, len(row))
        return pa.Table.from_arrays(
            [pa.array(np.full(len(rows), k.as_py(), dtype=np.int32)) for k in key]
            + [terms.dictionary.take(pa.array(row[rows])), _lists(pa.array(group), at), _lists(pa.array(counts), at)],
            [*keys, "term", "groups", "counts"])

    def loaded(key, table):
        import pyarrow.compute  # noqa: F401

        return run(key, table)

    schema = ", ".join(f"{k} int" for k in keys) + ", term string, groups array<int>, counts array<long>"
    return forms.groupBy(*keys).applyInArrow(loaded, schema)


def shares(counts: np.ndarray, whole) -> np.ndarray:
    """1 + floor(SCALE * (count + 2) / whole), exact where ``whole`` is below 9 * 10**15."""
    whole = np.broadcast_to(np.asarray(whole, dtype=np.int64), counts.shape)
    found, rest = np.divmod(counts + 2, whole)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, whole)
        found = found * 1000 + more
    return found + 1


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)**2 / (p + q))"""
    return (p - q) ** 2 // (p + q)


def _pair_sums(cells: DataFrame, facts: DataFrame) -> DataFrame:
    """(a, b, summed, seen) for the groups a < b of a language, from the terms that any of a tile has."""
    keys = ["lang_no", "tile", "one", "two"]

    def run(key, table: pa.Table, known: pa.Table) -> pa.Table:
        known = known.sort_by("group")
        group, whole = known["group"].to_numpy(), known["whole"].to_numpy()
        many = pa.compute.list_value_length(table["groups"]).to_numpy()
        row = np.repeat(np.arange(table.num_rows), many)
        column = np.searchsorted(group, table["groups"].combine_chunks().flatten().to_numpy())
        p = np.empty((len(group), table.num_rows), dtype=np.int64)
        p[:] = shares(np.zeros(len(group), dtype=np.int64), whole)[:, None]
        p[column, row] = shares(table["counts"].combine_chunks().flatten().to_numpy(), whole[column])
        block, first, out = known["block"].to_numpy(), key[2].as_py(), []
        for i in range(len(group) - 1):
            # of two blocks, only pairs across them; those inside have a tile of their own
            others = np.arange(i + 1, len(group))
            if key[2].as_py() != key[3].as_py():
                others = others[block[others] != block[i]] if block[i] == first else others[:0]
            if len(others):
                out.append((np.full(len(others), group[i]), group[others], distance(p[i], p[others]).sum(axis=1)))
        a, b, summed = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, dtype=np.int64),) * 3
        return pa.table({
            "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "summed": pa.array(summed, pa.int64()),
            "seen": pa.array(np.full(len(a), table.num_rows), pa.int64())})

    def loaded(key, table, known):
        import pyarrow.compute  # noqa: F401

        return run(key, table, known)

    tiles = cells.select(*keys).distinct().toDF(*(f"_{k}" for k in keys))
    here = facts.select(F.col("lang_no").alias("_lang_no"), "group", "block", "whole")
    known = tiles.join(here, "_lang_no").where((F.col("block") == F.col("_one")) | (F.col("block") == F.col("_two")))
    parts = cells.groupBy(*keys).cogroup(known.groupBy(*(f"_{k}" for k in keys))).applyInArrow(
        loaded, "a long, b long, summed long, seen long")
    return parts.groupBy("a", "b").agg(F.sum("summed").alias("summed"), F.sum("seen").alias("seen"))


def _tiled(counted: DataFrame, facts: DataFrame) -> DataFrame:
    """Rows of ``counted`` for each pair of blocks of sources, with the groups of these blocks only."""
    blocks = facts.groupBy("lang_no").agg((F.max("block") + 1).alias("_blocks"))
    lang = F.col("lang_no")

    def block(group: Column) -> Column:
        return F.floor((group - lang) / TILE_SOURCES).cast("int")

    mine = F.array_distinct(F.transform("groups", block))
    pairs = F.transform(mine, lambda x: F.transform(
        F.sequence(F.lit(0), F.col("_blocks") - 1), lambda y: F.struct(F.least(x, y).alias("one"), F.greatest(x, y).alias("two"))))
    spread = counted.join(blocks, "lang_no").withColumn("_pair", F.explode(F.array_distinct(F.flatten(pairs)))).select(
        "lang_no", "tile", F.col("_pair.one").cast("int").alias("one"), F.col("_pair.two").cast("int").alias("two"),
        F.filter(F.arrays_zip("groups", "counts"),
                 lambda c: block(c["groups"]).isin(F.col("_pair.one"), F.col("_pair.two"))).alias("_cells"))
    return spread.select(
        "lang_no", "tile", "one", "two", F.col("_cells.groups").alias("groups"), F.col("_cells.counts").alias("counts"))


def _top_terms(counted: DataFrame, facts: DataFrame, top: int) -> DataFrame:
    """(group, item, value): of each block of terms and group, the first terms by value, then term."""
    keys = ["lang_no", "tile"]

    def run(key, table: pa.Table, known: pa.Table) -> pa.Table:
        known = known.sort_by("group")
        many = pa.compute.list_value_length(table["groups"]).to_numpy()
        row, group = np.repeat(np.arange(table.num_rows), many), table["groups"].combine_chunks().flatten().to_numpy()
        counts = table["counts"].combine_chunks().flatten().to_numpy()
        total = np.add.reduceat(counts, np.append(0, np.cumsum(many)[:-1]))
        q = shares(total, known["lang_whole"].to_numpy()[0])[row]
        p = shares(counts, known["whole"].to_numpy()[np.searchsorted(known["group"].to_numpy(), group)])
        above = p > q
        row, group, value = row[above], group[above], distance(p[above], q[above])
        place = np.empty(table.num_rows, dtype=np.int64)
        place[np.argsort(np.array(table["term"].cast(pa.binary()).to_pylist(), dtype=object), kind="stable")] = np.arange(table.num_rows)
        order = np.lexsort((place[row], -value, group))
        row, group, value = row[order], group[order], value[order]
        begins = np.flatnonzero(_new(group))
        first = np.arange(len(group)) - np.repeat(begins, np.diff(np.append(begins, len(group)))) < top
        return pa.table({
            "group": pa.array(group[first], pa.int32()), "item": table["term"].combine_chunks().take(pa.array(row[first])),
            "value": pa.array(value[first], pa.int64())})

    def loaded(key, table, known):
        import pyarrow.compute  # noqa: F401

        return run(key, table, known)

    tiles = counted.select(*keys).distinct().toDF("_lang_no", "_tile")
    known = tiles.join(facts.select(F.col("lang_no").alias("_lang_no"), "group", "whole", "lang_whole"), "_lang_no")
    return counted.groupBy(*keys).cogroup(known.groupBy("_lang_no", "_tile")).applyInArrow(
        loaded, "group int, item string, value long")


def term_counts(
    docs: DataFrame, least_docs: int = 10, text: str = "text", lang: str = "lang", source: str = "source",
) -> tuple[DataFrame, DataFrame]:
    """Terms in at least so many documents of a language, with their occurrences per source; and the groups.

    Gives (lang_no, tile, term, groups, counts), where ``groups`` are the numbers of the (lang,
    source) groups that have the term, and (lang, source, lang_no, group, occurrences, terms) of all
    groups. A row is a document; see ``audit`` for nulls. Both are staged.
    """
    named = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in (
        (text, "text"), (lang, "lang"), (source, "source"))))
    groups = number_sorted(named.select("lang", "source").distinct(), ["lang", "source"], "group")
    groups = groups.withColumn("group", F.col("group").cast("int"))
    # numbers run on inside a language, whose number is that of its first group
    groups = stage(groups.join(groups.groupBy("lang").agg(F.min("group").alias("lang_no")), "lang"))
    numbered = named.join(groups, ["lang", "source"])
    buckets = max(64, docs.select(text).rdd.getNumPartitions() // 4)
    forms = stage(chunk_terms(chunk_counts(numbered, buckets, least_docs), least_docs))
    kept = stage(common_terms(forms, least_docs))
    chosen = forms.join(kept, ["lang_no", "term"]).select("lang_no", "term", "groups", "counts")
    size = stage(chosen.groupBy("lang_no").agg(F.sum(F.size("groups")).alias("_cells")))
    tile = F.pmod(F.xxhash64("term"), F.ceil(F.col("_cells") / TILE_COUNTS)).cast("int")
    tiled = chosen.join(size, "lang_no").withColumn("tile", tile).drop("_cells")
    counted = stage(_added(tiled, ["lang_no", "tile"]))
    cells = counted.select(F.explode(F.arrays_zip("groups", "counts")).alias("c")).select("c.groups", "c.counts")
    sums = cells.groupBy(F.col("groups").alias("group")).agg(F.sum("counts").alias("occurrences"))
    many = counted.groupBy("lang_no").agg(F.count(F.lit(1)).alias("terms"))
    facts = groups.join(sums, "group", "left").join(many, "lang_no", "left").fillna(0, ["occurrences", "terms"])
    return counted, stage(facts)


def audit(
    docs: DataFrame, least_docs: int = 10, top: int = TOP, text: str = "text", lang: str = "lang", source: str = "source",
) -> DataFrame:
    """(lang, source, part, item, value, rank): how each source of a language differs from others.

    Terms are ``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+``, A-Z as a-z; a language keeps the V terms that
    are in ``least_docs`` of its documents at least. A group (lang, source), and a language as a
    whole, gives a term p = 1 + floor(10**9 * (count + 2) / (N + 2 * V)), N being its occurrences of
    kept terms. The value of p against q is floor((p - q)**2 / (p + q)). Part ``pair``: for each
    other source of the language (``item``) the values of all kept terms added up, 0 without kept
    terms, all ranks. Part ``term``: the kept terms that the group has and gives more than the
    language does, the first ``top``. Ranks go by falling value, then by item in UTF-8.

    Null texts, languages and sources count as empty ones; an empty language or source is one like
    any other. Each row is a document, repeated ones too. A language with one source has no pairs.
    No row gives no row; other columns are not read.
    """
    counted, facts = term_counts(docs, least_docs, text, lang, source)
    whole = facts.withColumn("whole", F.col("occurrences") + 2 * F.col("terms")).withColumn(
        "lang_whole", F.sum("occurrences").over(W.partitionBy("lang_no")) + 2 * F.col("terms"))
    whole = stage(whole.withColumn("block", F.floor((F.col("group") - F.col("lang_no")) / TILE_SOURCES).cast("int")))
    sums = _pair_sums(_tiled(counted, whole), whole)

    names = whole.select("lang_no", "lang", "source", "group", "whole", "terms")
    other = whole.select("lang_no", F.col("source").alias("item"), F.col("group").alias("other"), F.col("whole").alias("other_whole"))
    p, q = (F.expr(f"2 * {SCALE}L div {w} + 1") for w in ("whole", "other_whole"))
    rest = F.expr("(_p - _q) * (_p - _q) div (_p + _q)") * (F.col("terms") - F.coalesce("seen", F.lit(0)))
    pairs = (
        names.join(other, "lang_no").where("group != other")  # the rows of the report, one per other source
        .withColumns({"a": F.least("group", "other").cast("long"), "b": F.greatest("group", "other").cast("long")})
        .join(sums, ["a", "b"], "left").withColumns({"_p": F.when(F.col("terms") > 0, p), "_q": F.when(F.col("terms") > 0, q)})
        .select("lang", "source", F.lit("pair").alias("part"), "item",
                F.when(F.col("terms") > 0, F.coalesce("summed", F.lit(0)) + rest).otherwise(0).cast("long").alias("value"))
    )
    terms = _top_terms(counted, whole, top).join(names.select("group", "lang", "source"), "group").select(
        "lang", "source", F.lit("term").alias("part"), "item", "value")
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = [
        part.withColumn("rank", F.row_number().over(order)) for part in (pairs, terms)]
    return ranked[0].union(ranked[1].where(F.col("rank") <= top))


def oracle(least_docs: int = 10, top: int = TOP) -> str:
    """The statement of ``audit``, with every kept term of every group as a row."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source
  FROM documents),
x AS (
  SELECT doc, lang, source, unnest(regexp_extract_all(
    translate(text, '{upper}', '{upper.lower()}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM d),
kept AS (SELECT lang, term FROM x GROUP BY lang, term HAVING count(DISTINCT doc) >= {least_docs}),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM x JOIN kept USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT DISTINCT lang, source FROM d),
n AS (
  SELECT lang, source, (SELECT coalesce(sum(n), 0) FROM c WHERE c.lang = g.lang AND c.source = g.source) AS whole FROM g),
p AS (
  SELECT n.lang, n.source, kept.term, coalesce(c.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (n.whole + 2 * v.v)::HUGEINT AS p
  FROM n JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = n.lang AND c.source = n.source AND c.term = kept.term),
q AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 2)) // (sum(sum(n)) OVER (PARTITION BY lang) + 2 * count(*) OVER (PARTITION BY lang))::HUGEINT AS q
  FROM p GROUP BY lang, term),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (
    SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
    FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
  ) s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (
  SELECT p.lang, p.source, p.term AS item, ((p - q) * (p - q)) // (p + q) AS value
  FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', item, value FROM terms)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM ranked)
WHERE part = 'pair' OR rank <= {top}
"""
