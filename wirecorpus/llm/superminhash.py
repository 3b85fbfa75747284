"""Near duplicates by SuperMinHash signatures, banding, verification on whole sets and union-find.

SuperMinHash gives every element a random permutation of the signature's places. In step j the
element offers j plus a random fraction to the j-th place of its permutation; a place keeps the
least offer. Offers of one element are spread over all places, which lowers the variance against
independent hashes, and a document is done as soon as all its places hold offers of steps gone by.
Long documents end after the first step or two. Steps run on all elements of many documents at once.

Texts of equal words are one node. Nodes that share a band meet in a bucket. First each bucket
compares its nodes with a few of them as centres, and what is linked is merged: groups of copies end
here, and their other pairs are never listed. Buckets that still hold several components are cut
into blocks of bounded size. Inside a block, and then between the blocks of a bucket, the remaining
pairs of different components are compared in the task that has the blocks, each pair in the first
bucket it shares, with a union-find that skips what has become connected. No bucket is capped: every
pair of a bucket is compared or connected.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from wirecorpus.llm.common import by_slice
from wirecorpus.session import stage

# 36 bands of 6 rows: a pair of similarity 0.8 is missed with probability (1 - 0.8**6)**36 < 2e-5
BANDS, ROWS = 36, 6
# elements whose permutations are held at a time
ELEMENTS = 60_000
# centres per bucket in the first rounds
CENTRES = (1, 8)
# nodes, and shingles in all, of a block
BLOCK_NODES, BLOCK_SHINGLES = 256, 60_000

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (the public splitmix64 constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def superminhash(elements: np.ndarray, owner: np.ndarray, owners: int, places: int) -> np.ndarray:
    """Signatures (owners, places) of the elements (64-bit hashes) each owner has; repeats do not matter.

    A value is step * 2**32 + fraction. Owners without elements keep the largest value throughout.
    """
    signature = np.full(owners * places, np.iinfo(np.uint64).max, dtype=np.uint64)
    permuted: np.ndarray | None = None
    base = owner.astype(np.int64) * places
    for step in range(places):
        draw = mix(elements + np.uint64((step + 1) * int(_GOLDEN) & 0xFFFFFFFFFFFFFFFF))
        pick = step + ((draw >> np.uint64(32)) * np.uint64(places - step) >> np.uint64(32)).astype(np.int64)
        offer = (draw & np.uint64(0xFFFFFFFF)) | np.uint64(step << 32)
        if permuted is None:
            place = pick
        else:
            row = np.arange(len(pick)) * places
            flat = permuted.reshape(-1)
            place = flat[row + pick].astype(np.int64)
            flat[row + pick] = flat[row + step]
        np.minimum.at(signature, base + place, offer)
        worst = signature.reshape(owners, places).max(axis=1)
        going = worst[base // places] >= np.uint64((step + 1) << 32)
        if not going.any():
            break
        if permuted is None:
            elements, base, pick = elements[going], base[going], pick[going]
            permuted = np.tile(np.arange(places, dtype=np.uint16), (len(pick), 1))
            permuted[np.arange(len(pick)), pick] = 0
        elif not going.all():
            elements, base, permuted = elements[going], base[going], permuted[going]
    return signature.reshape(owners, places)


def _octet_table(fold: bool) -> np.ndarray:
    """A fixed random 64-bit value per octet; folded, A-Z have those of a-z."""
    table = mix(np.arange(1, 257, dtype=np.uint64) * _GOLDEN)
    if fold:
        table[65:91] = table[97:123]
    return table


def word_hashes(texts: list[bytes], fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word of the texts and the text it is from; folded, A-Z count as a-z."""
    raw = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    white = (raw == 32) | ((raw >= 9) & (raw <= 13))
    inside = ~white
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside]).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    factor = np.uint64(0x5851F42D4C957F2D)
    powers = np.full(len(raw), factor, dtype=np.uint64)
    powers[0] = 1
    np.cumprod(powers, out=powers)
    inverse = np.full(len(raw), np.uint64(pow(0x5851F42D4C957F2D, -1, 1 << 64)), dtype=np.uint64)
    inverse[0] = 1
    np.cumprod(inverse, out=inverse)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_octet_table(fold)[raw] * powers, out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    begins = np.cumsum([0] + [len(t) + 1 for t in texts])
    return hashes, np.searchsorted(begins, starts, side="right") - 1


def shingle_hashes(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text as hashes, with their text. Fewer words: the whole as one."""
    hashes, owner = word_hashes(texts)
    count = np.bincount(owner, minlength=len(texts))
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    n = len(hashes)
    shingle = hashes.copy()
    length = np.minimum(count, words)[owner]
    for k in range(1, words):
        following = np.zeros(n, dtype=np.uint64)
        following[: max(n - k, 0)] = hashes[k:]
        shingle = np.where(k < length, mix(shingle * np.uint64(3) + following + np.uint64(k)), shingle)
    place = np.arange(n) - first[owner]
    whole = place <= np.maximum(count[owner] - words, 0)
    shingle, owner = shingle[whole], owner[whole]
    order = np.lexsort((shingle, owner))
    shingle, owner = shingle[order], owner[order]
    new = np.ones(len(shingle), dtype=bool)
    new[1:] = (shingle[1:] != shingle[:-1]) | (owner[1:] != owner[:-1])
    return shingle[new], owner[new]


def signed(docs: DataFrame, words: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, key, n_shingles, bands): ``key`` is equal for texts of equal words, ``bands`` one hash per band."""
    places = bands * rows

    def make():
        import hashlib

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            keys = [hashlib.md5(b" ".join(t.lower().split())).digest() for t in texts]
            shingle, owner = shingle_hashes(texts, words)
            count = np.bincount(owner, minlength=len(texts))
            ends = np.concatenate([[0], np.cumsum(count)])
            out = np.zeros((len(texts), bands), dtype=np.uint64)
            start = 0
            while start < len(texts):  # runs of documents with a bounded number of elements, one at least
                stop = max(start + 1, int(np.searchsorted(ends, ends[start] + ELEMENTS, side="right")) - 1)
                a, b = ends[start], ends[stop]
                parts = superminhash(shingle[a:b], owner[a:b] - start, stop - start, places)
                parts = parts.reshape(stop - start, bands, rows)
                band = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (stop - start, bands)).copy()
                for r in range(rows):
                    band = mix(band * np.uint64(5) + parts[:, :, r])
                out[start:stop] = band
                start = stop
            some = count > 0
            flat = pa.array(out[some].reshape(-1).view(np.int64))
            offsets = np.concatenate([[0], np.cumsum(some * bands)]).astype(np.int32)
            return pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(keys, pa.binary()), pa.array(count.astype(np.int64)),
                 pa.ListArray.from_arrays(pa.array(offsets), flat)],
                ["doc_id", "key", "n_shingles", "bands"],
            )
        return work

    return docs.mapInArrow(by_slice(make, "text"), "doc_id long, key binary, n_shingles long, bands array<long>")


def equal_words_key(text: Column) -> Column:
    """The same key as ``signed`` gives, from the text: md5 of its words, A-Z as a-z, between single spaces."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    words = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), upper, upper.lower()), r"[\x20\x09-\x0D]+", " ")
    return F.unhex(F.md5(F.trim(words).cast("binary")))


def shingle_set(text: str, words: int) -> set[str]:
    found = _WORD.findall(text.translate(_LOWER))
    if len(found) < words:
        return {" ".join(found)} if found else set()
    return {" ".join(found[i: i + words]) for i in range(len(found) - words + 1)}


_LOWER = {c: c + 32 for c in range(65, 91)}


def _alike(one: set, two, size: int, percent: int) -> bool:
    both = len(one.intersection(two))
    return 100 * both >= percent * (len(one) + size - both)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (low, high) of ``pairs`` (a, b, low, high) whose whole shingle sets are as similar as asked for."""
    def run(batches):
        for batch in batches:
            known: dict[int, set] = {}
            keep = []
            for a, raw_a, raw_b in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if a not in known:
                    if len(known) > 64:
                        known.clear()
                    known[a] = set(np.frombuffer(raw_a, dtype=np.int64).tolist())
                other = np.frombuffer(raw_b, dtype=np.int64).tolist()
                keep.append(_alike(known[a], other, len(other), percent))
            chosen = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([c.filter(chosen) for c in batch.columns[3:5]], ["u", "v"])

    with_sets = (
        pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("shingles_b")), "b")
        .join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("shingles_a")), "a")
        .select("a", "shingles_a", "shingles_b", "low", "high")
    )
    return with_sets.mapInArrow(run, "u long, v long")


class _Block:
    """Nodes of one bucket: their components, sizes, bands and shingle sets."""

    def __init__(self, rows: list[dict], bucket: int) -> None:
        rows = sorted(rows, key=lambda r: r["node"])
        self.comp = [r["comp"] for r in rows]
        self.size = np.array([r["n"] for r in rows], dtype=np.int64)
        bands = np.array([r["bands"] for r in rows], dtype=np.int64)
        at = int(np.flatnonzero(bands[0] == bucket)[0])
        self.earlier = bands[:, :at]
        self.raw = [r["shingles"] for r in rows]
        self.sets: dict[int, set] = {}

    def set_of(self, i: int) -> set:
        if i not in self.sets:
            self.sets[i] = set(np.frombuffer(self.raw[i], dtype=np.int64).tolist())
        return self.sets[i]


def _links(one: _Block, two: _Block, percent: int) -> list[tuple[int, int]]:
    """Links that connect components of two blocks (or of one with itself), found exhaustively."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    links = []
    for i in range(len(one.comp)):
        begin = i + 1 if one is two else 0
        size = two.size[begin:]
        fits = (size * 100 >= one.size[i] * percent) & (one.size[i] * 100 >= size * percent)
        fits &= ~(two.earlier[begin:] == one.earlier[i]).any(axis=1)
        own = one.set_of(i) if fits.any() else set()
        for j in (np.flatnonzero(fits) + begin).tolist():
            a, b = find(one.comp[i]), find(two.comp[j])
            if a != b and _alike(own, two.set_of(j), int(two.size[j]), percent):
                parent[max(a, b)] = min(a, b)
                links.append((one.comp[i], two.comp[j]))
    return links


def _as_links(found: list[tuple[int, int]]) -> pa.Table:
    return pa.table({"u": pa.array([u for u, _ in found], pa.int64()), "v": pa.array([v for _, v in found], pa.int64())})


def _block_links(open_: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(u, v) links between components of the nodes inside each block of ``open_``."""
    def run(key, table):
        block = _Block(table.to_pylist(), key[0].as_py())
        return _as_links(_links(block, block, percent))

    filled = open_.join(sets, "node").select("bucket", "block", "node", "comp", "n", "bands", "shingles")
    return filled.groupBy("bucket", "block").applyInArrow(run, "u long, v long")


def _cross_links(open_: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(u, v) links between components of the nodes in different blocks of one bucket."""
    rows = F.collect_list(F.struct("node", "comp", "n", "bands", "shingles"))
    packed = (
        open_.where("blocks > 1").join(sets, "node").groupBy("bucket", "block")
        .agg(rows.alias("rows"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    )
    packed = stage(packed)
    heads = packed.select("bucket", "block", "lo", "hi")
    one, two = heads.toDF("bucket", "block", "lo", "hi"), heads.toDF("bucket", "block2", "lo2", "hi2")
    met = one.join(two, "bucket").where((F.col("block") < F.col("block2")) & (F.least("lo", "lo2") < F.greatest("hi", "hi2")))
    both = (
        met.select("bucket", "block", "block2")
        .join(packed.select("bucket", "block", F.col("rows").alias("one")), ["bucket", "block"])
        .join(packed.select("bucket", F.col("block").alias("block2"), F.col("rows").alias("two")), ["bucket", "block2"])
        .select("bucket", "one", "two")
    )

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                bucket = batch.column(0)[i].as_py()
                found = _links(_Block(batch.column(1)[i].as_py(), bucket), _Block(batch.column(2)[i].as_py(), bucket), percent)
                yield from _as_links(found).to_batches()

    return both.mapInArrow(run, "u long, v long")


def union_find(edges: DataFrame) -> DataFrame:
    """(node, comp) of every node of the edges (u, v): ``comp`` is the least node it is connected with.

    Each task first runs a union-find over the edges it holds and passes on one edge per node. The
    forests of the tasks are then joined by taking least labels of neighbours and following labels,
    each round written to the shared folder, until nothing changes.
    """
    def forest(batches):
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            root = x
            while parent.setdefault(root, root) != root:
                root = parent[root]
            while parent[x] != root:
                parent[x], x = root, parent[x]
            return root

        for batch in batches:
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = find(u), find(v)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        nodes = list(parent)
        yield pa.RecordBatch.from_arrays(
            [pa.array(nodes, pa.int64()), pa.array([find(n) for n in nodes], pa.int64())], ["u", "v"])

    trees = stage(edges.select("u", "v").mapInArrow(forest, "u long, v long").distinct())
    both = trees.union(trees.select("v", "u")).toDF("node", "other")
    labels = stage(both.groupBy("node").agg(F.least(F.min("node"), F.min("other")).alias("comp")))
    while True:
        near = (
            both.join(labels.toDF("other", "near"), "other").groupBy("node").agg(F.min("near").alias("near"))
        )
        nearer = labels.join(near, "node").select("node", "comp", F.least("comp", "near").alias("to"))
        # follow the label once more
        jumped = (
            nearer.join(labels.toDF("to", "further"), "to", "left")
            .select("node", F.col("comp").alias("old"), F.least("to", F.coalesce("further", "to")).alias("comp"))
        )
        kept = stage(jumped)
        labels = kept.select("node", "comp")
        if kept.where("old != comp").isEmpty():
            return labels


def near_duplicates(
    docs: DataFrame, words: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text",
    bands: int = BANDS, rows: int = ROWS,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, key, representative) of every row.

    Rows are linked where 100 * intersection >= percent * union of their sets of ``words``-word
    shingles, confirmed on whole sets; ``component_id`` is the least id reachable and ``kept`` tells
    if it is the row's own. Rows without words are linked with nothing: each is its own component,
    also where the text is null. Repeated rows share a component and are all kept, having one id;
    null ids count as larger than all others and a component of null ids has a null id and is kept.
    ``key`` is equal for texts of equal words; one (doc_id, key) of each component is its
    ``representative``, as is every row without words. No row gives no row; other columns are not
    read.
    """
    picked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows_ = stage(signed(picked, words, bands, rows).withColumn("uid", F.monotonically_increasing_id()))
    nodes = stage(
        rows_.where("n_shingles > 0").groupBy("key")
        .agg(
            F.min("uid").alias("node"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"),
            F.min("doc_id").alias("first_id"))
    )
    links = _components(picked, nodes, words, percent)
    comps = nodes.select("key", "node").join(links, "node", "left").select(
        "key", F.coalesce("comp", "node").alias("comp"))
    found = rows_.where("n_shingles > 0").select("doc_id", "n_shingles", "key").join(comps, "key")
    least = found.groupBy("comp").agg(F.min(F.struct(F.isnull("doc_id"), "doc_id", "key")).alias("least"))
    grouped = found.join(least, "comp").select(
        "doc_id", "n_shingles", F.col("least.doc_id").alias("component_id"), "key",
        F.col("least.key").alias("first_key"))
    alone = rows_.where("n_shingles = 0").select(
        "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "key", F.col("key").alias("first_key"))
    kept = F.col("doc_id").eqNullSafe(F.col("component_id"))
    return grouped.union(alone).select(
        "doc_id", "n_shingles", "component_id", kept.alias("kept"), "key",
        (kept & (F.col("key") == F.col("first_key"))).alias("representative"))


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` with one document left of each component, all columns kept.

    Rows of one id and equal words are one document. Rows without words are never duplicates of
    others with another id. Columns of any name are handed on as they are.
    """
    judged = near_duplicates(docs, words, percent, doc_id, text)
    ident, key, word_key = (_free(docs, name) for name in ("_near_id", "_near_key", "_near_word_key"))
    stay = stage(judged.where("representative").select(F.col("doc_id").alias(ident), F.col("key").alias(key)))
    named = F.col(doc_id).cast("long")
    keyed = docs.withColumn(word_key, equal_words_key(F.col(text)))
    left = keyed.join(stay, named.eqNullSafe(F.col(ident)) & (F.col(word_key) == F.col(key)), "left_semi")
    repeated = stay.groupBy(ident, key).count().where("count > 1")
    if not repeated.isEmpty():
        left = left.dropDuplicates([doc_id, word_key])
    return left.drop(word_key)


def _free(docs: DataFrame, name: str) -> str:
    """A column name that the rows do not have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name = f"_{name}"
    return name


def _components(docs: DataFrame, nodes: DataFrame, words: int, percent: int) -> DataFrame:
    """(node, comp) of the nodes that are linked with another one."""
    placed = nodes.select("node", "n", F.explode("bands").alias("bucket"))
    shared = stage(placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("_many")).where("_many > 1").select("bucket"))
    members = stage(placed.join(shared, "bucket").select("bucket", "node", "n"))
    sets = stage(_shingle_sets(docs, nodes.join(members.select("node").distinct(), "node", "left_semi"), words))
    labels = docs.sparkSession.createDataFrame([], "node long, comp long")
    open_ = members.withColumn("comp", F.col("node"))
    for many in CENTRES:
        salt = F.pmod(F.xxhash64("node", F.lit(many)), F.lit(many)) if many > 1 else F.lit(0)
        # what is joined on the bucket is staged: the join then has two plain sides, and members of a
        # bucket that holds many are not all sent to one task
        centres = stage(
            open_.groupBy("bucket", salt.alias("_salt")).agg(F.min(F.struct("node", "comp", "n")).alias("c"))
            .select("bucket", F.col("c.node").alias("centre"), F.col("c.comp").alias("centre_comp"), F.col("c.n").alias("centre_n"))
        )
        alike = (F.col("n") * 100 >= F.col("centre_n") * percent) & (F.col("centre_n") * 100 >= F.col("n") * percent)
        pairs = (
            open_.join(centres, "bucket").where((F.col("comp") != F.col("centre_comp")) & alike)
            .select(
                F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b"),
                F.least("comp", "centre_comp").alias("low"), F.greatest("comp", "centre_comp").alias("high"))
            .distinct()
        )
        labels = _merged(labels, stage(_verified(pairs, sets, percent)))
        open_ = _still_open(open_, labels)
    block = F.pmod(F.xxhash64("node"), F.col("blocks"))
    sized = stage(open_.groupBy("bucket").agg(F.sum("n").alias("_shingles"), F.count(F.lit(1)).alias("_nodes")).select(
        "bucket",
        F.greatest(F.ceil(F.col("_shingles") / BLOCK_SHINGLES), F.ceil(F.col("_nodes") / BLOCK_NODES)).alias("blocks")))
    open_ = stage(open_.join(sized, "bucket").withColumn("block", block))
    labels = _merged(labels, stage(_block_links(open_, sets, percent)))
    open_ = _still_open(open_.where("blocks > 1"), labels)
    return _merged(labels, stage(_cross_links(open_, sets, percent)))


def _shingle_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(node, bands, shingles): the whole set of each node's text as packed hashes."""
    def run(batches):
        for batch in batches:
            texts = [t or b"" for t in batch.column(2).cast(pa.binary()).to_pylist()]
            shingle, owner = shingle_hashes(texts, words)
            ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(texts)))]).tolist()
            raw = shingle.tobytes()
            packed = [raw[8 * a: 8 * b] for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(packed, pa.binary())], ["node", "bands", "shingles"])

    keyed = docs.withColumn("key", equal_words_key(F.col("text")))
    one = keyed.alias("d").join(
        wanted.alias("w"), (F.col("d.key") == F.col("w.key")) & F.col("d.doc_id").eqNullSafe(F.col("w.first_id")))
    # repeated rows give a text twice
    texts = one.select("node", "bands", "d.text").mapInArrow(run, "node long, bands array<long>, shingles binary")
    return texts.dropDuplicates(["node"])


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(node, comp) after the components that the links (u, v) connect are one."""
    if links.isEmpty():
        return labels
    merged = union_find(links)
    moved = merged.toDF("comp", "_to")
    return stage(
        labels.join(moved, "comp", "left").select("node", F.coalesce("_to", "comp").alias("comp"))
        .union(merged.join(labels.select("node"), "node", "left_anti"))
    )


def _still_open(open_: DataFrame, labels: DataFrame) -> DataFrame:
    """Members with their components of now, of the buckets that hold several."""
    current = open_.drop("comp").join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    several = current.groupBy("bucket").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi")).where("_lo < _hi")
    return stage(current.join(stage(several.select("bucket")), "bucket"))
