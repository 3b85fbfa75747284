"""Similarity join of documents on word n-grams by rare-first prefix filtering.

All n-grams stand in one order, rare ones first. Two sets of n and m elements with Jaccard
similarity t or more share an element among the first n - ceil(t * n) + 1 of the one and as many of
the other, so only documents that share a prefix element can be linked. Any fixed order gives the
same links; a rare-first one keeps n-grams of many documents out of the prefixes. Rarity is an upper
bound of an n-gram's count over the whole corpus: the lesser of its own counter and that of its
rarest word, in a table of counters of fixed size that is added up over all tasks.

Of two documents that share a prefix element, the length filter compares their sizes, and the
positional filter what can still be common from the two places on, if that element is the first one
they share. Distinct pairs that are left meet their prefixes: what these share, and what is left
behind them, has to be enough, and so has what the suffix filter allows, which compares the sizes of
the two sets range by range. A pair that passes is compared on whole sets, once.

Documents of equal words are one node. The nodes of an element that few share all meet in the first
round, and the element is done. An element that many nodes share is not expanded into all of their
pairs: its nodes first meet one centre, then a few more, and what is linked is one component, inside
which no pair is asked for again. Only then do the pairs of different components that are left meet,
a group of many nodes in tiles. So a group of near copies costs a few pairs per node, and no group
is capped.

Texts, prefixes and whole sets are wide, and a round asks for some of them only. Rows that nobody asks
for are left out by a table of bits before the others are shuffled.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from wirecorpus.llm.common import by_slice, slices
from wirecorpus.llm.superminhash import mix, shingle_hashes, union_find, word_hashes
from wirecorpus.session import stage

# counters of n-grams, and as many of words; 64 parts of each are added up apart
COUNTERS = 1 << 21
PART = 1 << 15
# nodes of an element that all meet in the first round
FEW = 8
# centres that the nodes of an element of more nodes meet, round by round
CENTRES = (1, 4, 16)
# nodes of an element whose pairs meet in one tile
TILE = 256
# ranges of the suffix filter
RANGES = 16
# bits of the table that tells which keys are asked for, 4 MB; each of its rows holds 1 << ROW_BITS
BITS, ROW_BITS = 1 << 25, 15


def _grams(texts: list[bytes], words: int) -> tuple[np.ndarray, ...]:
    """(n-gram hash per place, its document, index of its first word, its words, hash per word).

    The hashes are those of ``shingle_hashes``, repeats included.
    """
    hashes, owner = word_hashes(texts)
    count = np.bincount(owner, minlength=len(texts))
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    n, gram, length = len(hashes), hashes.copy(), np.minimum(count, words)[owner]
    for k in range(1, words):
        following = np.zeros(n, dtype=np.uint64)
        following[: max(n - k, 0)] = hashes[k:]
        gram = np.where(k < length, mix(gram * np.uint64(3) + following + np.uint64(k)), gram)
    at = np.flatnonzero(np.arange(n) - first[owner] <= np.maximum(count[owner] - words, 0))
    return gram[at], owner[at], at, length[at], hashes


def _octets(part: pa.RecordBatch, column: int) -> list[bytes]:
    return [t or b"" for t in part.column(column).cast(pa.binary()).to_pylist()]


def _counted(texts: DataFrame, words: int) -> DataFrame:
    """(part, slots, counts): what each task has counted, for the counters that are not zero."""
    def run(batches):
        import pyarrow.compute  # noqa: F401

        counters = np.zeros(2 * COUNTERS, dtype=np.uint32)
        for batch in batches:
            for part in slices(batch, "text"):
                gram, _, _, _, word = _grams(_octets(part, 0), words)
                np.add.at(counters, (gram % np.uint64(COUNTERS)).astype(np.int64), 1)
                np.add.at(counters, (word % np.uint64(COUNTERS)).astype(np.int64) + COUNTERS, 1)
        parts = counters.reshape(-1, PART)
        found = [np.flatnonzero(p) for p in parts]
        some = [k for k, f in enumerate(found) if len(f)]
        yield pa.RecordBatch.from_arrays([
            pa.array(some, pa.int32()), pa.array([found[k].astype("<u2").tobytes() for k in some], pa.binary()),
            pa.array([parts[k][found[k]].astype("<u4").tobytes() for k in some], pa.binary())], ["part", "slots", "counts"])

    return texts.mapInArrow(run, "part int, slots binary, counts binary")


def rarity(docs: DataFrame, words: int, text: str = "text") -> np.ndarray:
    """Classes (about 8 per doubling) of the counts of n-grams and of words: 4 MB whatever the corpus."""
    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, slots, counts in zip(*(c.to_pylist() for c in batch.columns)):
                total = sums.setdefault(part, np.zeros(PART, dtype=np.int64))
                total[np.frombuffer(slots, dtype="<u2")] += np.frombuffer(counts, dtype="<u4")
        classes = [np.minimum(8 * np.log2(s + 1), 255).astype(np.uint8).tobytes() for s in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(classes, pa.binary())], ["part", "classes"])

    counted = _counted(docs.select(F.col(text).alias("text")), words)
    rows = counted.repartition("part").mapInArrow(add, "part int, classes binary").collect()
    table = np.zeros(2 * COUNTERS, dtype=np.uint8)
    for part, classes in rows:
        table[part * PART: (part + 1) * PART] = np.frombuffer(classes, dtype=np.uint8)
    return table


def _prefixes(docs: DataFrame, words: int, percent: int, table: np.ndarray) -> DataFrame:
    """(doc_id, mark, key, n, ranges, prefix) of (doc_id, text, mark): prefix elements rare first."""
    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = _octets(batch, 1)
            keys = [hashlib.md5(b" ".join(t.lower().split())).digest() for t in texts]
            gram, owner, at, length, word = _grams(texts, words)
            rare = table[(word % np.uint64(COUNTERS)).astype(np.int64) + COUNTERS]
            least = table[(gram % np.uint64(COUNTERS)).astype(np.int64)]
            for k in range(words):
                inside = length > k
                least[inside] = np.minimum(least[inside], rare[at[inside] + k])
            ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(texts)))]).tolist()
            return _ordered(batch, keys, gram, owner, least, ends)
        return work

    def _ordered(batch, keys, gram, owner, least, ends):
        many = len(keys)
        # rarity first, then the hash, of which 8 bits give way
        order = gram >> np.uint64(8) | least.astype(np.uint64) << np.uint64(56)
        for a, b in zip(ends, ends[1:]):
            gram[a:b].sort()
            order[a:b].sort()

        def distinct(x):
            new = np.ones(len(x), dtype=bool)
            new[1:] = (x[1:] != x[:-1]) | (owner[1:] != owner[:-1])
            return new

        once = distinct(gram)
        n = np.bincount(owner[once], minlength=many)
        spread = np.bincount(
            owner[once] * RANGES + (gram[once] >> np.uint64(60)).astype(np.int64), minlength=many * RANGES)
        once = distinct(order)
        order, owner = order[once], owner[once]
        have = np.bincount(owner, minlength=many)
        take = np.where(n > 0, n - -(-percent * n // 100) + 1, 0)
        place = np.arange(len(order)) - np.concatenate([[0], np.cumsum(have)[:-1]])[owner]
        chosen = order[place < take[owner]].view(np.int64)
        offsets = np.concatenate([[0], np.cumsum(np.minimum(take, have))]).astype(np.int32)
        return pa.RecordBatch.from_arrays([
            batch.column(0), batch.column(2), pa.array(keys, pa.binary()), pa.array(n.astype(np.int64)),
            pa.ListArray.from_arrays(pa.array(np.arange(0, many * RANGES + 1, RANGES, dtype=np.int32)), pa.array(spread.astype(np.int32))),
            pa.ListArray.from_arrays(pa.array(offsets), pa.array(chosen))], ["doc_id", "mark", "key", "n", "ranges", "prefix"])

    schema = "doc_id long, mark long, key binary, n long, ranges array<int>, prefix array<long>"
    return docs.mapInArrow(by_slice(make, "text"), schema)


def _perhaps(rows: DataFrame, keys: list[str], wanted: DataFrame) -> DataFrame:
    """The rows whose keys are among the wanted ones, and some others whose bits are the same.

    Only the table of bits moves. More keys than bits leave all rows in, which a join then drops.
    """
    slot = F.pmod(F.xxhash64(*keys), F.lit(BITS))
    part, place = F.shiftright(slot, ROW_BITS), slot.bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    bits = wanted.groupBy(part.alias("_part")).agg(F.bitmap_construct_agg(place).alias("_bits"))
    octet = F.substring("_bits", (F.shiftright(place, 3) + 1).cast("int"), F.lit(1))
    there = F.getbit(F.conv(F.hex(octet), 16, 10).cast("int"), place.bitwiseAND(F.lit(7)).cast("int")) == 1
    return rows.join(F.broadcast(bits), (part == F.col("_part")) & there, "left_semi")


def _gram_sets(docs: DataFrame, wanted: DataFrame, repeated: DataFrame, words: int) -> DataFrame:
    """(node, grams): the whole set of each wanted (node, doc_id, mark) as packed, sorted hashes.

    Texts that nobody asks for are not shuffled. Rows that repeat an id and a text give a set more
    than once; these are left out before any set is made.
    """
    def run(batches):
        import pyarrow.compute  # noqa: F401

        for batch in batches:
            for part in slices(batch, "text"):
                texts = _octets(part, 1)
                gram, owner = shingle_hashes(texts, words)
                ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(texts)))]).tolist()
                raw = gram.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([raw[8 * a: 8 * b] for a, b in zip(ends, ends[1:])], pa.binary())], ["node", "grams"])

    def same(x: str, y: str) -> Column:
        return (F.col(f"{x}.mark") == F.col(f"{y}.mark")) & F.col(f"{x}.doc_id").eqNullSafe(F.col(f"{y}.doc_id"))

    docs = _perhaps(docs, ["doc_id", "mark"], wanted)
    once = docs
    if not repeated.isEmpty():
        several = docs.alias("d").join(repeated.alias("r"), same("d", "r"), "left_semi")
        several = several.join(wanted.alias("w"), same("d", "w"), "left_semi").dropDuplicates(["doc_id", "mark"])
        once = docs.alias("d").join(repeated.alias("r"), same("d", "r"), "left_anti").union(several)
    found = once.alias("d").join(wanted.alias("w"), same("d", "w"))
    return found.select("w.node", "d.text").mapInArrow(run, "node long, grams binary")


def _fits(n: Column, m: Column, most: Column, percent: int) -> Column:
    """True where sets of n and m with at most so many common elements can be similar enough."""
    return (100 + percent) * most >= percent * (n + m)


def _candidates(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The distinct pairs (a, b, low, high) whose prefixes and ranges leave room for enough common elements.

    Common elements up to the end of the prefix that ends first stand in both prefixes; behind it
    there are at most as many as that set has left. Prefixes are cut to 31 bits here: of elements of
    one set that have become equal, each but one may be common on top of those that are counted.
    """
    columns = ("node", "n", "ranges", "prefix")
    side = {
        x: _perhaps(nodes, ["node"], pairs.select(F.col(x).alias("node"))).select(*(F.col(c).alias(f"{c}_{x}") for c in columns))
        for x in "ab"}
    n, m = F.col("n_a"), F.col("n_b")
    inside = F.aggregate(
        F.zip_with("ranges_a", "ranges_b", lambda x, y: F.least(x, y).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    left = F.greatest(n - F.size("prefix_a"), m - F.size("prefix_b"))
    equal = F.size("prefix_a") - F.size(F.array_distinct("prefix_a"))
    most = F.size(F.array_intersect("prefix_a", "prefix_b")) + equal + left
    met = pairs.join(side["a"], F.col("a") == F.col("node_a")).join(side["b"], F.col("b") == F.col("node_b"))
    return met.where(_fits(n, m, inside, percent) & _fits(n, m, most, percent)).select("a", "b", "low", "high")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(u, v) components of the pairs (a, b, low, high) that are similar enough on whole sets."""
    def run(batches):
        for batch in batches:
            known, keep = (None, None), []
            for a, raw_a, raw_b in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if a != known[0]:
                    known = a, np.frombuffer(raw_a, dtype=np.uint64)
                one, two = known[1], np.frombuffer(raw_b, dtype=np.uint64)
                at = np.searchsorted(one, two)
                both = int((one[np.minimum(at, len(one) - 1)] == two).sum())
                keep.append(100 * both >= percent * (len(one) + len(two) - both))
            chosen = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([c.filter(chosen) for c in batch.columns[3:5]], ["u", "v"])

    side = {x: _perhaps(sets, ["node"], pairs.select(F.col(x).alias("node"))).toDF(x, f"grams_{x}") for x in "ab"}
    with_sets = (
        pairs.join(side["b"], "b").join(side["a"], "a")
        .select("a", "grams_a", "grams_b", "low", "high")
    )
    return with_sets.mapInArrow(run, "u long, v long")


def _passing(met: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, low, high) of rows that hold two nodes, after length and positional filters."""
    n, m, i, j = (F.col(c) for c in ("n", "other_n", "pos", "other_pos"))
    # at their first common element two sets have nothing in common before
    most = F.least(n - i, m - j)
    alike = (100 * F.least(n, m) >= percent * F.greatest(n, m)) & _fits(n, m, most, percent)
    return met.where((F.col("comp") != F.col("other_comp")) & alike).select(
        F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"),
        F.least("comp", "other_comp").alias("low"), F.greatest("comp", "other_comp").alias("high"))


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(node, comp) after the components that the links (u, v) connect are one."""
    if links.isEmpty():
        return labels
    merged = union_find(links)
    moved = labels.join(merged.toDF("comp", "_to"), "comp", "left").select("node", F.coalesce("_to", "comp").alias("comp"))
    return stage(moved.union(merged.join(labels.select("node"), "node", "left_anti")))


def _open(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows with their components of now, of the elements that hold several."""
    current = rows.drop("comp").join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    several = current.groupBy("gram").agg(
        F.min("comp").alias("_lo"), F.max("comp").alias("_hi"), F.max("early").alias("_early")).where("_lo < _hi AND _early")
    return stage(current.join(stage(several.select("gram")), "gram").select("gram", "node", "comp", "n", "pos", "early"))


OTHER = {"node": "other", "comp": "other_comp", "n": "other_n", "pos": "other_pos"}


def _paired(rows: DataFrame, percent: int) -> DataFrame:
    """All pairs of the nodes of each element."""
    others = rows.select("gram", *(F.col(c).alias(o) for c, o in OTHER.items()))
    return _passing(rows.join(others, "gram").where("node < other"), percent)


def _centred(rows: DataFrame, many: int, percent: int) -> DataFrame:
    """Pairs of the nodes of each element with up to so many of them."""
    salt = F.pmod(F.xxhash64("node", F.lit(many)), F.lit(many)) if many > 1 else F.lit(0)
    centres = rows.groupBy("gram", salt.alias("_salt")).agg(F.min(F.struct("node", "comp", "n", "pos")).alias("c"))
    # staged, so that the join has two plain shuffles and skewed elements are split
    centres = stage(centres.select("gram", *(F.col(f"c.{c}").alias(o) for c, o in OTHER.items())))
    return _passing(rows.join(centres, "gram"), percent)


def _tiled(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs of nodes of different components that share an element, a group of nodes in tiles.

    The smaller node of a pair has the element early, so late rows do not meet each other.
    """
    many, early = F.count(F.lit(1)), F.count_if("early")
    sized = stage(rows.groupBy("gram").agg(F.ceil(early / TILE).alias("_one"), F.ceil(many / TILE).alias("_two")))
    placed = rows.join(sized, "gram")
    one = placed.where("early").select(
        "gram", *OTHER, F.pmod(F.xxhash64("node"), F.col("_one")).alias("lo"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("_two") - 1)).alias("hi"))
    two = placed.select(
        "gram", *(F.col(c).alias(o) for c, o in OTHER.items()), F.pmod(F.xxhash64("node"), F.col("_two")).alias("hi"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("_one") - 1)).alias("lo"))
    return _passing(stage(one).join(stage(two), ["gram", "lo", "hi"]).where(F.col("n") <= F.col("other_n")), percent)


def _components(docs: DataFrame, nodes: DataFrame, repeated: DataFrame, words: int, percent: int) -> DataFrame:
    """(node, comp) of the nodes that are linked with another one."""
    elements = nodes.select("node", "n", F.posexplode("prefix").alias("pos", "gram"))
    # of two sets the smaller one has the first element they share among its first n - a + 1, where a
    # is what two sets of its size have to share; an element that nobody has so early links nothing
    early = (100 + percent) * (F.col("n") - F.col("pos")) >= 2 * percent * F.col("n")
    elements = elements.withColumn("early", early)
    shared = elements.groupBy("gram").agg(F.count(F.lit(1)).alias("_many"), F.max("early").alias("_early"))
    shared = stage(shared.where("_many > 1 AND _early").select("gram", (F.col("_many") <= FEW).alias("few")))
    rows = stage(elements.join(shared, "gram").select("gram", "node", F.col("node").alias("comp"), "n", "pos", "early", "few"))
    # prefixes and sizes of the nodes that may meet another one; later steps do not read the rest
    short = F.transform("prefix", lambda x: x.bitwiseAND(F.lit((1 << 31) - 1)).cast("int"))
    nodes = stage(_perhaps(nodes.drop("key"), ["node"], rows).withColumn("prefix", short))
    few, rows = rows.where("few"), rows.where("NOT few")
    labels = docs.sparkSession.createDataFrame([], "node long, comp long")
    sets = None
    for make in [*(lambda r, k=k: _centred(r, k, percent) for k in CENTRES), lambda r: _tiled(r, percent)]:
        if sets is None:
            met = make(rows).union(_paired(few, percent))
        else:
            rows = _open(rows, labels)
            if rows.isEmpty():
                break
            met = make(rows)
        pairs = stage(_candidates(stage(met.distinct()), nodes, percent))
        # whole sets of the nodes that a pair asks for, made once
        asked = pairs.select(F.explode(F.array("a", "b")).alias("node"))
        wanted = _perhaps(nodes.select("node", "doc_id", "mark"), ["node"], asked).join(asked, "node", "left_semi")
        if sets is not None:
            wanted = wanted.join(sets.select("node"), "node", "left_anti")
        wanted = stage(wanted)
        if sets is None or not wanted.isEmpty():
            made = stage(_gram_sets(docs, wanted, repeated, words))
            sets = made if sets is None else sets.union(made)
        labels = _joined(labels, stage(_verified(pairs, sets, percent)))
    return labels


def linked(
    docs: DataFrame, words: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row.

    A row's set is that of its distinct ``words``-word shingles, A-Z as a-z; a text of fewer words
    is one shingle. Rows are linked where 100 * intersection >= percent * union on whole sets;
    ``component_id`` is the least id reachable by links. Rows without words are linked with nothing,
    also where the text is null, and are their own components. Repeated rows have one id and so one
    component; null ids come after all others, and a component of null ids has a null id. No row
    gives no row; other columns are not read.
    """
    picked = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("mark"))
    table = rarity(picked, words)
    found = stage(_prefixes(picked, words, percent, table).withColumn("uid", F.monotonically_increasing_id()))
    some = found.where("n > 0")
    nodes = stage(
        some.groupBy("key").agg(
            F.min("uid").alias("node"), F.min(F.struct(F.isnull("doc_id"), "doc_id", "mark")).alias("_first"),
            F.first("n").alias("n"), F.first("ranges").alias("ranges"), F.first("prefix").alias("prefix"))
        .select("key", "node", "_first.doc_id", "_first.mark", "n", "ranges", "prefix"))
    # ids that stand more than once with one text, known before any text is fetched
    repeated = stage(some.groupBy("doc_id", "mark").count().where("count > 1").select("doc_id", "mark"))
    labels = _components(picked, nodes, repeated, words, percent)
    comps = stage(nodes.select("key", "node").join(labels, "node", "left").select("key", F.coalesce("comp", "node").alias("comp")))
    rows = some.select("doc_id", F.col("n").alias("n_shingles"), "key").join(comps, "key")
    least = stage(rows.groupBy("comp").agg(F.min("doc_id").alias("component_id")))
    alone = found.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return rows.join(least, "comp").select("doc_id", "n_shingles", "component_id").union(alone)
