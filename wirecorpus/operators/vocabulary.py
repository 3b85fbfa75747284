"""Subword vocabulary: training as a corpus job, encoding and decoding, comparison."""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from wirecorpus.functions.ordering import number_sorted
from wirecorpus.operators.catalog import SPECIAL_TOKENS
from wirecorpus.session import drop_paths, stage, stage_at

VOCAB_SIZE = 64_794
USER_SYMBOLS = ["<packet>", "<flow>", "<pck>"]
BASE_PIECES = ["<unk>", "<s>", "</s>"]
SPACE = "▁"
TOP_PAIRS = 256
# copies of changed words beside the words, before all are written anew
MOST_COPIES = 16
CACHED_WORDS = 200_000
# texts whose words are looked up together
ROWS_TOGETHER = 256


def _word_pattern(symbols: list[str]) -> str:
    any_symbol = "|".join(re.escape(s) for s in symbols) or r"(?!)"
    return f"({any_symbol}|{SPACE}?(?:(?!{any_symbol})[^{SPACE}])+|{SPACE})"


def words_of(text: Column, symbols: list[str]) -> Column:
    """Words with a leading space mark; user symbols stand alone."""
    marked = F.concat(F.lit(SPACE), F.regexp_replace(F.trim(text), r"\s+", SPACE))
    found = F.regexp_extract_all(marked, F.lit(_word_pattern(symbols)), F.lit(1))
    # a text without user symbols is cut at its space marks, which is far cheaper
    some = reduce(lambda a, b: a | b, [F.contains(marked, F.lit(s)) for s in symbols if s], F.lit(False))
    return F.when(some, found).otherwise(F.split(marked, f"(?={SPACE})"))


def train_vocabulary(
    corpus: DataFrame, vocab_size: int = VOCAB_SIZE, text: str = "text",
    user_symbols: list[str] = USER_SYMBOLS, exact: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Byte-pair merges over word counts: (vocab(piece, id, kind), merges(rank, left, right)).

    Symbols are numbers. Pair counts are kept from round to round: a round looks up the words that
    hold a merged pair in an inverted table, rewrites these, and adds what changed to the counts. One
    round applies as many merges of the top of the ranking as one merge at a time would have made in
    the same order. A merge (a, b) changes only the counts of pairs that end in a or begin with b,
    and a pair it makes is at most as frequent as one of those; so a run of the ranking without such
    pairs, all above the first pair behind it, is safe. The driver sees the top of the ranking only,
    and at most ``vocab_size`` merges. ``exact=False`` skips such pairs instead of stopping at them:
    far fewer rounds for a large vocabulary, in a slightly other order.
    """
    spark = corpus.sparkSession
    counted = (
        corpus.select(F.explode(words_of(F.col(text), user_symbols)).alias("word"))
        .groupBy("word").agg(F.count(F.lit(1)).alias("n"))
        .filter(~F.col("word").isin(*user_symbols))
    )
    counted = stage(counted.withColumn("w", F.monotonically_increasing_id()))

    letters = F.filter(F.split("word", ""), lambda c: c != "")
    alphabet_rows = counted.select(F.explode(letters).alias("c")).distinct().orderBy("c")
    room = vocab_size - len(BASE_PIECES) - len(user_symbols)
    # the alphabet is part of the vocabulary, so one that does not fit is an error
    alphabet = [r["c"] for r in alphabet_rows.limit(room + 1).collect()]
    if len(alphabet) > room:
        raise ValueError("the alphabet alone exceeds the vocabulary size")
    wanted = room - len(alphabet)

    merges: list[tuple[str, str]] = []
    table = _PairTable(counted, alphabet)
    while len(merges) < wanted:
        batch = _next_merges(table.top(), wanted - len(merges), set(table.pieces), exact)
        if not batch:
            break
        merges += batch
        if len(merges) < wanted:
            table.merge(batch)
    table.drop()

    pieces = [(p, "control") for p in BASE_PIECES] + [(p, "user") for p in user_symbols]
    known = {p for p, _ in pieces}
    for left, right in merges:
        if left + right not in known:
            known.add(left + right)
            pieces.append((left + right, "merge"))
    pieces += [(c, "char") for c in alphabet if c not in known]
    vocab = spark.createDataFrame(
        [(p, i, k) for i, (p, k) in enumerate(pieces)], "piece STRING, id INT, kind STRING"
    )
    ranks = spark.createDataFrame(
        [(i, a, b) for i, (a, b) in enumerate(merges)], "rank INT, left STRING, right STRING"
    )
    return vocab, ranks


class _PairTable:
    """Words as numbers of pieces, the counts of their neighbouring pairs, and the words of each pair.

    What a round changes is written beside the tables of before; when that has grown, all is written
    anew and the older copies are deleted. An entry of ``holds`` whose word has lost the pair finds
    nothing to merge.
    """

    def __init__(self, counted: DataFrame, alphabet: list[str]) -> None:
        self.spark, self.pieces = counted.sparkSession, list(alphabet)
        self.number = {p: i for i, p in enumerate(alphabet)}
        number, self.round = self.number, 0
        self.paths: list[str] = []
        self.last: list[str] = []  # the path of the counts

        def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                words = [[number[c] for c in word] for word in batch.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(words, pa.list_(pa.int32()))], ["w", "n", "s"])

        spelled = counted.select("w", "n", "word").mapInArrow(spell, "w LONG, n LONG, s ARRAY<INT>")
        self._rewrite(spelled)
        pairs = self.words[0].select("n", F.explode(_pairs(F.col("s"))).alias("p"))
        self.counts = self._write(pairs.groupBy("p.a", "p.b").agg(F.sum("n").alias("n")))
        self.last = [self.paths[-1]]

    def _write(self, df: DataFrame) -> DataFrame:
        kept, path = stage_at(df)
        self.paths.append(path)
        return kept

    def _rewrite(self, words: DataFrame) -> None:
        """Words and inverted table as one copy each, in place of all there are."""
        old, self.paths = self.paths, []
        words = self._write(words)
        pairs = words.select("w", F.explode(F.array_distinct(_pairs(F.col("s")))).alias("p")).select("p.a", "p.b", "w")
        # in the order of the pairs, so that a look-up reads few parts of the files
        self.holds = [self._write(pairs.repartitionByRange("a", "b").sortWithinPartitions("a", "b"))]
        self.words, self.size, self.changed = [words.withColumn("round", F.lit(0))], words.count(), 0
        drop_paths(self.spark, [p for p in old if p not in self.last])
        self.paths += self.last

    def _latest(self, words: DataFrame) -> DataFrame:
        if len(self.words) == 1:
            return words.drop("round")
        newest = F.max_by(F.struct("n", "s"), "round").alias("l")
        return words.groupBy("w").agg(newest).select("w", "l.n", "l.s")

    def top(self) -> list[tuple[str, str, int]]:
        """The most frequent pairs, ties by the text of their parts."""
        texts = self.spark.createDataFrame(list(enumerate(self.pieces)), "id INT, t STRING")
        side = {x: F.broadcast(texts.toDF(x, f"t{x}")) for x in "ab"}  # as many rows as the vocabulary has
        rows = self.counts.join(side["a"], "a").join(side["b"], "b").orderBy(F.col("n").desc(), "ta", "tb")
        return [(r["ta"], r["tb"], r["n"]) for r in rows.limit(TOP_PAIRS).select("ta", "tb", "n").collect()]

    def merge(self, batch: list[tuple[str, str]]) -> None:
        """Apply merges that do not touch each other to the words that hold one of them."""
        self.round += 1
        made: dict[tuple[int, int], int] = {}
        for left, right in batch:
            if left + right not in self.number:
                self.number[left + right] = len(self.pieces)
                self.pieces.append(left + right)
            made[self.number[left], self.number[right]] = self.number[left + right]
        chosen = self.spark.createDataFrame(list(made), "a INT, b INT")
        pruned = F.col("a").isin(*{a for a, _ in made}) & F.col("b").isin(*{b for _, b in made})
        holds = reduce(DataFrame.union, [h.filter(pruned) for h in self.holds])
        touched = holds.join(F.broadcast(chosen), ["a", "b"]).select("w").distinct()
        current = self._latest(reduce(DataFrame.union, self.words).join(touched, "w", "left_semi"))
        changed = self._write(current.mapInArrow(_apply(made), "w LONG, n LONG, s ARRAY<INT>, changes ARRAY<STRUCT<a: INT, b: INT, d: INT>>"))
        deltas = changed.select("n", F.explode("changes").alias("c")).select("c.a", "c.b", (F.col("n") * F.col("c.d")).alias("n"))
        summed = self.counts.union(deltas).groupBy("a", "b").agg(F.sum("n").alias("n")).filter("n > 0")
        old, before = self.last, len(self.paths)
        self.counts = self._write(summed)
        self.last = self.paths[before:]
        drop_paths(self.spark, old)
        self.paths = [p for p in self.paths if p not in old]
        self.words.append(changed.select("w", "n", "s", F.lit(self.round).alias("round")))
        self.holds.append(changed.select("w", F.explode("changes").alias("c")).filter("c.d > 0").select("c.a", "c.b", "w"))
        self.changed += changed.count()
        if len(self.words) > MOST_COPIES or self.changed > self.size:
            self._rewrite(self._latest(reduce(DataFrame.union, self.words)))

    def drop(self) -> None:
        drop_paths(self.spark, self.paths)


def _pairs(symbols: Column) -> Column:
    last = F.greatest(F.size(symbols) - 1, F.lit(0))
    return F.arrays_zip(F.slice(symbols, F.lit(1), last).alias("a"), F.slice(symbols, F.lit(2), last).alias("b"))


def _apply(made: dict[tuple[int, int], int]):
    """Rewrite words and list how often each pair comes or goes; words without a merge are left out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, words, changes = [], [], []
            for row, symbols in enumerate(batch.column(2).to_pylist()):
                out, i = [], 0
                while i < len(symbols):
                    new = made.get((symbols[i], symbols[i + 1])) if i + 1 < len(symbols) else None
                    out.append(symbols[i] if new is None else new)
                    i += 1 if new is None else 2
                if len(out) < len(symbols):
                    moved = Counter(zip(out, out[1:]))
                    moved.subtract(Counter(zip(symbols, symbols[1:])))
                    kept.append(row)
                    words.append(out)
                    changes.append([{"a": a, "b": b, "d": d} for (a, b), d in moved.items() if d])
            change = pa.struct([("a", pa.int32()), ("b", pa.int32()), ("d", pa.int32())])
            rows = pa.array(kept, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(words, pa.list_(pa.int32())),
                 pa.array(changes, pa.list_(change))], ["w", "n", "s", "changes"])
    return run


def _next_merges(
    top: list[tuple[str, str, int]], limit: int, symbols: set[str], exact: bool
) -> list[tuple[str, str]]:
    lefts: set[str] = set()
    rights: set[str] = set()
    made: set[str] = set()
    taken: list[tuple[str, str, int]] = []
    # the ranking may go on behind what was read
    barrier = top[-1][2] if len(top) == TOP_PAIRS else 0
    for i, (a, b, n) in enumerate(top):
        if a in rights or b in lefts or {a, b} & made:
            if exact:
                barrier = n
                break
            continue
        taken.append((a, b, n))
        if a + b in symbols | made:
            # a symbol that is there already makes its other pairs more frequent: count again
            barrier = top[i + 1][2] if i + 1 < len(top) else barrier
            break
        lefts.add(a)
        rights.add(b)
        made.add(a + b)
    sure = [(a, b) for i, (a, b, n) in enumerate(taken) if i == 0 or n > barrier or not exact]
    return sure[:limit]


def _merge_word(word: str, rank: dict[tuple[str, str], int]) -> list[str]:
    """Apply the merges in the order they were learned, from left to right.

    Pairs wait in a heap by rank and place; a merged pair puts its two new neighbours there. A pair
    with a merged part was learned later, so it never comes before one that waits already.
    """
    parts = list(word)
    last = len(parts) - 1
    before, after = list(range(-1, last)), list(range(1, last + 2))
    waiting = [(rank[pair], i, pair) for i, pair in enumerate(zip(parts, parts[1:])) if pair in rank]
    heapq.heapify(waiting)
    while waiting:
        _, left, pair = heapq.heappop(waiting)
        right = after[left]
        if right > last or (parts[left], parts[right]) != pair:
            continue  # one of the two has been merged since
        parts[left], parts[right] = pair[0] + pair[1], ""
        follow = after[left] = after[right]
        if follow <= last:
            before[follow] = left
        for at, beside in ((left, follow), (before[left], left)):
            if at >= 0 and beside <= last and (new := (parts[at], parts[beside])) in rank:
                heapq.heappush(waiting, (rank[new], at, new))
    return [part for part in parts if part]


def encode(
    df: DataFrame, vocab: DataFrame, merges: DataFrame, text: str = "text", out: str = "ids",
    user_symbols: list[str] = USER_SYMBOLS,
) -> DataFrame:
    """Add token ids. The vocabulary (bounded by its size) goes to every worker, and a worker
    merges a word once while it is cached, so no shuffle is needed. The words of a batch are looked
    up once each, and no object is made per word of the text."""
    spark = df.sparkSession
    table = spark.sparkContext.broadcast((
        {r["piece"]: r["id"] for r in vocab.collect()},
        {(r["left"], r["right"]): r["rank"] for r in merges.collect()},
        frozenset(user_symbols),
    ))

    @F.arrow_udf("array<int>")
    def ids_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import pyarrow.compute as pc

        ids, rank, symbols = table.value
        unknown = ids[BASE_PIECES[0]]

        @lru_cache(maxsize=CACHED_WORDS)
        def word_ids(word: str) -> bytes:
            pieces = [word] if word in symbols else _merge_word(word, rank)
            return np.array([ids.get(p, unknown) for p in pieces], dtype=np.int32).tobytes()

        def encoded(words: pa.Array) -> pa.Array:
            found = words.flatten().dictionary_encode()
            coded = [word_ids(w) for w in found.dictionary.to_pylist()]
            many = np.array([len(c) // 4 for c in coded], dtype=np.int64)
            which = found.indices.to_numpy(zero_copy_only=False)
            sizes = many[which]
            ends = np.concatenate([[0], np.cumsum(sizes)])
            place = np.arange(ends[-1]) + np.repeat((np.cumsum(many) - many)[which] - ends[:-1], sizes)
            count = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
            offsets = ends[np.concatenate([[0], np.cumsum(count)])]
            return pa.ListArray.from_arrays(
                pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(coded), dtype=np.int32)[place]),
                mask=words.is_null())

        for words in batches:
            parts = [encoded(words.slice(at, ROWS_TOGETHER)) for at in range(0, len(words), ROWS_TOGETHER)]
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))

    return df.withColumn(out, ids_of(words_of(F.col(text), user_symbols)))


def decode(df: DataFrame, vocab: DataFrame, ids: str = "ids", out: str = "text") -> DataFrame:
    """Token ids to text; control pieces, negative and unknown ids give nothing.

    Ids number the pieces without gaps, so the vocabulary is one array that ids index.
    """
    shown = F.when(F.col("kind").isin("control", "special"), "").otherwise(F.col("piece"))
    gaps = F.raise_error(F.lit("vocabulary ids have gaps")).cast("array<string>")
    listed = F.array_sort(F.collect_list(F.struct("id", shown.alias("piece"))))
    pieces = F.when(F.max("id") + 1 == F.count(F.lit(1)), F.transform(listed, lambda p: p["piece"])).otherwise(gaps)
    table = vocab.agg(pieces.alias("pieces")).scalar()
    # a lambda cannot hold a subquery, but it can read a column
    shown_of = lambda i: F.coalesce(F.get(F.col("_pieces"), i.cast("int")), F.lit(""))
    joined = F.array_join(F.transform(F.col(ids), shown_of), "")
    text = F.regexp_replace(F.replace(joined, F.lit(SPACE), F.lit(" ")), "^ ", "")
    return df.withColumn("_pieces", table).withColumn(out, text).drop("_pieces")


def with_specials(vocab: DataFrame, specials: list[str] = SPECIAL_TOKENS) -> DataFrame:
    """Number the special tokens behind the base vocabulary (piece, id)."""
    base = vocab.agg((F.max("id") + 1).alias("n"))
    extra = base.select(F.posexplode(F.array(*[F.lit(s) for s in specials])).alias("i", "piece"), "n")
    return vocab.select("piece", F.col("id").cast("bigint").alias("id"), F.lit("base").alias("kind")).unionByName(
        extra.select("piece", (F.col("n") + F.col("i")).cast("bigint").alias("id"), F.lit("special").alias("kind"))
    )


def number_pieces(df: DataFrame, piece: str = "piece") -> DataFrame:
    """(piece, id) of the distinct pieces in text order."""
    distinct = df.select(F.col(piece).alias("piece")).distinct()
    numbered = number_sorted(distinct, ["piece"], "id")
    return numbered.withColumn("id", F.col("id") - 1)


def fertility(
    df: DataFrame, tokenizers: dict[str, Column], text: str = "text", order: str | None = None,
    first: int | None = None, min_length: int = 10,
) -> DataFrame:
    """Mean number of pieces per text for several tokenizers, over long enough texts.

    The length counts the line end. ``first`` limits the texts to the first lines in ``order``.
    """
    rows = df.orderBy(order).limit(first) if first else df
    rows = rows.filter(F.length(text) + 1 >= min_length)
    return rows.agg(
        F.count(F.lit(1)).alias("n_texts"),
        *[F.avg(F.size(pieces)).alias(name) for name, pieces in tokenizers.items()],
    )
