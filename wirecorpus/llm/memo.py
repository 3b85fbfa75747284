"""Token ids of whole texts as the ``tokenizers`` library gives them, each word encoded once per worker.

Both vocabularies used here split a text before they merge: no token reaches over a space that
follows a character which is no white space. A text is cut there, each distinct piece is encoded,
and the ids of the text are those of its pieces in order. Nothing is approximated; the memory of
pieces is bounded and only decides how often a piece is encoded again.

Most words are Latin letters with a mark behind them or not. To the library such letters are one
word, to which its merges are applied: here those of all distinct words of a slice together. The
first words of a worker and one in 32 after them are also given to the library, and a difference is
an error. All other pieces are encoded by the library itself, and remembered.
"""

from __future__ import annotations

import re
from collections import deque

import numpy as np
import pyarrow as pa

from wirecorpus.llm.merging import PairTable, merge

# octets of text whose words are encoded together
TOGETHER = 4 << 20
# distinct pieces one worker remembers in each of two generations
PIECES = 300_000
# pieces given to the library in one call
CALL = 5_000

# new words that are compared with the library: the first ones, and one in so many of the rest
COMPARED, ONE_IN = 2_000, 32

# octets of a word that is merged here; a longer one would keep all others waiting
LONGEST = 60
# marks that end a word and are a word of their own
TAILS = ",.;:!?"
# texts that are cut into pieces one by one: white space side by side, or other than spaces and line ends
IRREGULAR = r"  | \n|\n |\n\n|[\t\x0b\x0c\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

_WHITE_THEN_SPACE = re.compile(r"\s ")
_ASCII_THEN_SPACE = [c + " " for c in "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f "]
_CUT = re.compile(r"(?<=\S) ")
# inside a piece no token reaches from a letter to a mark after it, nor from a line end after a mark
# to a letter
_STEM = re.compile(r"(?<=[A-Za-z])(?=[,.;:!?])|(?<=[,.;:!?]\n)(?=[A-Za-z])")


class Memory(dict):
    """Bounded in two generations: what is used again moves on, the rest is forgotten.

    What is not there yet is noted in ``pending`` and filled in afterwards.
    """

    def __init__(self) -> None:
        super().__init__()
        self.pending: list[str] = []
        self.old: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        found = self.old.get(piece)
        if found is None:
            self.pending.append(piece)
            found = b""
        self[piece] = found
        return found

    def turn(self, limit: int) -> None:
        if len(self) > limit:
            self.old = dict(self)
            self.clear()


def octet_letters() -> list[str]:
    """The printable character that stands for each octet in vocabularies of octets."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [o for o in range(256) if o not in shown]
    return [chr(o) if o in shown else chr(256 + hidden.index(o)) for o in range(256)]


def cut(text: str) -> list[str]:
    """Pieces at each space that follows no white space; the space itself is left out."""
    if text.isascii():
        return _CUT.split(text) if any(odd in text for odd in _ASCII_THEN_SPACE) else text.split(" ")
    return _CUT.split(text) if _WHITE_THEN_SPACE.search(text) else text.split(" ")


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indexes start, start + 1, ... of each (start, length), one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def words_between_spaces(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(place of each word in the distinct ones, distinct words, number of words per text)."""
    import pyarrow.compute as pc

    split = pc.split_pattern(texts, " ")
    found = split.flatten().dictionary_encode()
    return found.indices.to_numpy(), found.dictionary, np.diff(split.offsets.to_numpy())


def strings(words: pa.Array) -> list[str]:
    return words.to_numpy(zero_copy_only=False).tolist()


def gathered(which: np.ndarray, count: np.ndarray, found: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, number of ids per text) of words ``which`` of distinct ones with so ``many`` ids in ``found``."""
    sizes = many[which]
    ids = found[ranges((np.cumsum(many) - many)[which], sizes)]
    ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum(count)]
    return ids, np.diff(ends, prepend=0)


def as_octets(ids: np.ndarray, count: np.ndarray) -> list[bytes]:
    raw, ends = ids.astype("<u4", copy=False).tobytes(), (4 * np.cumsum(count)).tolist()
    return [raw[a:b] for a, b in zip([0, *ends], ends)]


class TokenMemo:
    """Ids as little-endian unsigned 32-bit octets, without special tokens added."""

    def __init__(self, path: str, pieces: int = PIECES) -> None:
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.mark = "<|endoftext|>"
        self.mark_id = self.tokenizer.token_to_id(self.mark)
        parts = json.loads(self.tokenizer.to_str())
        # a vocabulary that drops white space splits by a pattern of which only the matches stay
        self.drops_white = '"Removed"' in json.dumps(parts["pre_tokenizer"])
        self.lower = '"Lowercase"' in json.dumps(parts["normalizer"])
        model, ids = parts["model"], parts["model"]["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        left, right, merged = (np.array([ids[x] for x in side], dtype=np.int64) for side in (
            [a for a, _ in pairs], [b for _, b in pairs], [a + b for a, b in pairs]))
        self.table = PairTable(left, right, np.arange(len(pairs), dtype=np.int32), merged)
        ends = model.get("end_of_word_suffix") or ""
        letters = octet_letters()
        self.first = np.array([ids[c] for c in letters])
        self.last = np.array([ids[c + ends] for c in letters])
        # only merges that are learned later than those of their parts can be taken best first
        self.plain = model["type"] == "BPE" and not model.get("ignore_merges") and not model.get("continuing_subword_prefix")
        self.compared = 0
        if not self.plain:
            raise ValueError("a vocabulary of merges of octets is expected")
        self.tail_place = np.zeros(256, dtype=np.int64)
        self.tail_place[[ord(t) for t in TAILS]] = np.arange(1, len(TAILS) + 1)
        tails = [np.array(e.ids) for e in self.tokenizer.encode_batch(list(TAILS), add_special_tokens=False)]
        self.tail_ids, self.tail_ids_n = np.concatenate(tails), np.array([0, *map(len, tails)])
        self.limit, self.inner, self.heads, self.tails = pieces, Memory(), Memory(), Memory()

    def _library(self, memory: Memory, pieces: list[str], lead: str) -> None:
        """Encode pieces many at a time, told apart by a special token that none of them contains.

        The library cuts a text at its special tokens first, so each piece is encoded for itself.
        """
        plain = [p for p in pieces if "<|" not in p]
        for at in range(0, len(plain), CALL):
            call = plain[at: at + CALL]
            text = self.mark.join([lead + p for p in call]) + self.mark
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
            raw, ends = ids.tobytes(), (4 * np.flatnonzero(ids == self.mark_id)).tolist()
            memory.update(zip(call, [raw[a:b] for a, b in zip([0] + [e + 4 for e in ends], ends)]))
        odd = [p for p in pieces if "<|" in p]
        for piece, encoded in zip(odd, self.tokenizer.encode_batch([lead + p for p in odd], add_special_tokens=False)):
            memory[piece] = np.array(encoded.ids, dtype="<u4").tobytes()

    def _fill(self, memory: Memory, lead: str) -> None:
        pending, memory.pending = memory.pending, []
        split, joined, alone = _STEM.split, [], []
        for piece in pending:
            parts = () if "<|" in piece else split(piece)
            if len(parts) > 1:
                joined.append((piece, parts))
            else:
                alone.append(piece)
        # stems and tails that are not known either join those that are encoded
        for _, parts in joined:
            memory[parts[0]]
            deque(map(self.tails.__getitem__, parts[1:]), maxlen=0)
        self._library(memory, alone + memory.pending, lead)
        self._library(self.tails, self.tails.pending, "")
        memory.pending, self.tails.pending = [], []
        for piece, (stem, *rest) in joined:
            memory[piece] = memory[stem] + b"".join([self.tails[t] for t in rest])

    def _ids_of(self, memory: Memory, lead: str, pieces: list[str]) -> list[bytes]:
        deque(map(memory.__getitem__, pieces), maxlen=0)
        self._fill(memory, lead)
        return list(map(memory.__getitem__, pieces))

    def _plain(self, words: pa.Array, chosen: np.ndarray, lead: np.ndarray):
        """(which of the chosen words are plain, their ids, number of ids).

        A plain word is one of at most ``LONGEST`` octets of Latin letters, with a mark of ``TAILS`` behind it or not.
        """
        words = words.cast(pa.large_binary()).take(pa.array(chosen))
        _, offsets, data = words.buffers()
        offsets = np.frombuffer(offsets, dtype=np.int64)[words.offset: words.offset + len(words) + 1]
        raw = np.frombuffer(data, dtype=np.uint8)[offsets[0]: offsets[-1]] if data is not None else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        length = np.diff(offsets)
        # 0xC3 and the octet after it make up the letters of the second Latin block
        wide = raw == 0xC3
        second = np.concatenate([[False], wide[:-1]]) & (raw >= 0x80) & (raw < 0xC0) & (raw != 0x97) & (raw != 0xB7)
        folded = raw | 0x20
        fine = (folded >= 97) & (folded <= 122) & (raw < 128) | second
        fine |= wide & np.concatenate([second[1:], [False]])
        bad = np.concatenate([[0], np.cumsum(~fine)])
        last = raw[np.maximum(offsets[1:] - 1, 0)] if len(raw) else np.zeros(len(length), np.uint8)
        tail = np.where(length > 0, self.tail_place[last], 0)
        stem = length - (tail > 0)
        plain = (stem > 0) & (stem <= LONGEST) & (bad[offsets[:-1] + stem] == bad[offsets[:-1]]) & (stem > 0)
        at, stem, tail, before = offsets[:-1][plain], stem[plain], tail[plain], lead[plain].astype(np.int64)
        octets = np.full(int((stem + before).sum()), 32, dtype=np.uint8)
        ends = np.cumsum(stem + before)
        into = ranges(ends - stem, stem)
        octets[into] = raw[ranges(at, stem)]
        if self.lower:
            letter, follows = octets, np.concatenate([[False], octets[:-1] == 0xC3])
            octets = np.where((letter >= 65) & (letter <= 90) | follows & (letter >= 0x80) & (letter <= 0x9E), letter + 32, letter)
        symbols = self.first[octets]
        symbols[ends - 1] = self.last[octets[ends - 1]]
        ids, many = merge(self.table, symbols, stem + before)
        # the ids of the tail come behind those of the stem
        total = many + self.tail_ids_n[tail]
        out = np.empty(int(total.sum()), dtype=np.int64)
        begins = np.cumsum(total) - total
        out[ranges(begins, many)] = ids
        extra = self.tail_ids_n[tail]
        out[ranges(begins + many, extra)] = self.tail_ids[ranges((np.cumsum(self.tail_ids_n) - self.tail_ids_n)[tail], extra)]
        self._compare(words, np.flatnonzero(plain), before, out, total)
        return plain, out, total

    def _compare(self, words: pa.Array, plain: np.ndarray, before: np.ndarray, ids: np.ndarray, many: np.ndarray) -> None:
        """Give the first plain words of this worker, and then one in so many, to the library as well."""
        some = np.arange(len(plain))[: COMPARED - self.compared] if self.compared < COMPARED else np.arange(0, len(plain), ONE_IN)
        self.compared += len(some)
        texts = [b.decode() for b in words.take(pa.array(plain[some])).to_pylist()]
        begins = np.cumsum(many) - many
        for lead in (0, 1):
            chosen = [k for k, x in enumerate(before[some].tolist()) if x == lead]
            asked: dict[str, bytes] = {}
            self._library(asked, [texts[k] for k in chosen], " " * lead)
            for k in chosen:
                a = begins[some[k]]
                if asked[texts[k]] != ids[a: a + many[some[k]]].astype("<u4").tobytes():
                    raise ValueError(f"the library encodes {texts[k]!r} in another way")

    def _regular(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids per text) of texts without white space side by side or of rarer kinds."""
        import pyarrow.compute as pc

        # line ends are words of their own, and the words behind them have no space in front
        which, words, count = words_between_spaces(pc.replace_substring(texts, "\n", " \n "))
        line_end = pc.index(words, "\n").as_py()
        first = (np.cumsum(count) - count)[count > 0]
        lead = np.ones(len(which), dtype=bool)
        lead[first] = False
        if line_end >= 0:
            ends = np.flatnonzero(which == line_end)
            lead[ends] = False
            lead[ends[ends + 1 < len(which)] + 1] = False
        if self.drops_white:
            lead[:] = False
        key = 2 * which.astype(np.int64) + lead
        asked = np.zeros(2 * len(words), dtype=bool)
        asked[key] = True
        asked = np.flatnonzero(asked)
        plain, ids, many = self._plain(words, asked // 2, asked % 2 == 1)
        odd = ~plain
        texts_of = strings(words.take(pa.array(asked[odd] // 2)))
        coded = [b""] * len(texts_of)
        for memory, front, sign in ((self.heads, "", 0), (self.inner, " ", 1)):
            chosen = np.flatnonzero(asked[odd] % 2 == sign).tolist()
            for k, octets in zip(chosen, self._ids_of(memory, front, [texts_of[k] for k in chosen])):
                coded[k] = octets
        every = np.empty(len(asked), dtype=np.int64)
        every[plain], every[odd] = many, [len(o) // 4 for o in coded]
        found = np.empty(int(every.sum()), dtype=np.uint32)
        begins = np.cumsum(every) - every
        found[ranges(begins[plain], many)] = ids
        found[ranges(begins[odd], every[odd])] = np.frombuffer(b"".join(coded), dtype="<u4")
        place = np.zeros(2 * len(words), dtype=np.int64)
        place[asked] = np.arange(len(asked))
        return gathered(place[key], count, found, every)

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each); a null text has none."""
        import pyarrow.compute as pc

        for memory in (self.inner, self.heads, self.tails):
            memory.turn(self.limit)
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = pc.match_substring_regex(texts, IRREGULAR).to_numpy(zero_copy_only=False)
        ids, count = self._regular(texts.filter(pa.array(~odd)))
        if not odd.any():
            return ids, count
        coded = self._pieces(texts.filter(pa.array(odd)).to_pylist())
        every = np.empty(len(texts), dtype=np.int64)
        every[~odd], every[odd] = count, [len(o) // 4 for o in coded]
        out, begins = np.empty(int(every.sum()), dtype=np.uint32), np.cumsum(every) - every
        out[ranges(begins[~odd], count)] = ids
        out[ranges(begins[odd], every[odd])] = np.frombuffer(b"".join(coded), dtype="<u4")
        return out, every

    def _pieces(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as octets, from pieces cut at spaces that follow no white space."""
        pieces = [cut(t) for t in texts]
        # the first piece of a text has no space before it
        heads = [None if self.drops_white else ps.pop(0) for ps in pieces]
        lead = self._ids_of(self.heads, "", [h for h in heads if h is not None])
        lead = iter(lead) if not self.drops_white else iter([b""] * len(texts))
        front = "" if self.drops_white else " "
        for ps in pieces:
            deque(map(self.inner.__getitem__, ps), maxlen=0)
        self._fill(self.inner, front)
        return [next(lead) + b"".join(map(self.inner.__getitem__, ps)) for ps in pieces]

    def encode(self, texts: pa.Array | list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit octets."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        return as_octets(*self.encode_all(texts))
