"""SentencePiece encoding and decoding for merge-type vocabularies.

A unit of text starts as single characters. All adjacent pairs whose concatenation is a piece stand
on an agenda ordered by score, then by place. The best pair is merged, its new neighbours come on
the agenda, until it is empty. Characters that no piece covers become their octets.

No piece holds a space mark after another character, so a text is cut before each run of marks. The
agendas of all new units of a slice are worked off together, one pair of each unit a round. A unit
with unknown characters, or a long one, has an agenda of its own; where no piece holds two given
characters side by side, nothing is ever merged over them, so it is cut there. Each distinct unit is merged once per worker and compared with the library;
the library also decodes every document's ids, and the texts must agree. A difference is an error.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wirecorpus.llm.common import by_slice, kept
from wirecorpus.llm.memo import LONGEST, TOGETHER, Memory, as_octets, gathered, ranges, strings, words_between_spaces
from wirecorpus.llm.merging import PairTable, encoded

MARK = "▁"
UNITS = 150_000
# units of one text that is given to the library
CALL = 500


class PieceModel:
    def __init__(self, path: str, units: int = UNITS) -> None:
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.begin, self.end, self.limit = sp.bos_id(), sp.eos_id(), units
        self.octets = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        self.surface: list[bytes] = []
        side_by_side = set()
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.surface.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.surface.append(b"")
            else:
                self.surface.append(piece.replace(MARK, " ").encode())
                self.ids[piece], self.scores[piece] = i, sp.get_score(i)
                side_by_side.update(zip(piece, piece[1:]))
        if any(b == MARK and a != MARK for a, b in side_by_side) or not all(sp.is_byte(o) for o in self.octets):
            raise ValueError("a vocabulary with octet pieces and with space marks in front is expected")
        if sp.normalize("  a  b\tA ") != f"{MARK * 3}a{MARK * 2}b\tA{MARK}":
            raise ValueError("a vocabulary that keeps texts as they are is expected")
        self.side_by_side = side_by_side
        self._tables()
        self.whole, self.parts = Memory(), Memory()

    def _tables(self) -> None:
        """Arrays for units of known characters: symbols by code point, pairs by rank, surfaces by id."""
        self.symbol = np.full(1 << 17, -1, dtype=np.int64)
        for piece, i in self.ids.items():
            if len(piece) == 1 and ord(piece) < len(self.symbol):
                self.symbol[ord(piece)] = i
        # pieces of several space marks may share a score; units with several have agendas of their own
        ordered = sorted((p for p in self.ids if len(p) > 1 and MARK not in p[1:]), key=lambda p: -self.scores[p])
        if len({self.scores[p] for p in ordered}) < len(ordered):
            raise ValueError("a vocabulary with a score of its own for each merged piece is expected")
        pairs = [
            (self.ids[p[:k]], self.ids[p[k:]], rank) for rank, p in enumerate(ordered)
            for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids]
        left, right, rank = (np.array(x, dtype=np.int64) for x in zip(*pairs))
        self.pairs = PairTable(left, right, rank.astype(np.int32), np.array([self.ids[p] for p in ordered]))
        self.surface_n = np.array([len(x) for x in self.surface], dtype=np.int64)
        self.surface_at = np.cumsum(self.surface_n) - self.surface_n
        self.surfaces = np.frombuffer(b"".join(self.surface), dtype=np.uint8)

    def _merged(self, units: list[str]) -> list[bytes]:
        """Ids of units, each with the space mark in front: their agendas are worked off together."""
        lengths = np.array([len(u) + 1 for u in units])
        points = np.frombuffer((MARK + MARK.join(units)).encode("utf-32-le"), dtype="<u4")
        symbols = np.where(points < len(self.symbol), self.symbol[np.minimum(points, len(self.symbol) - 1)], -1)
        starts = np.cumsum(lengths) - lengths
        symbols[points == ord(MARK)] = -1
        symbols[starts] = self.ids[MARK]
        fine = (np.minimum.reduceat(symbols, starts) >= 0) & (lengths <= LONGEST)
        coded = iter(encoded(self.pairs, symbols[np.repeat(fine, lengths)], lengths[fine]))
        out = [next(coded) if ok else b"" for ok in fine.tolist()]
        # other units are cut where nothing is ever merged, and their parts worked off one by one
        rest = np.flatnonzero(~fine).tolist()
        cuts = [self.cut(MARK + units[k]) for k in rest]
        for parts in cuts:
            deque(map(self.parts.__getitem__, parts), maxlen=0)
        fresh, self.parts.pending = self.parts.pending, []
        self.parts.update((p, np.array(self.agenda(p), dtype="<u4").tobytes()) for p in fresh)
        for k, parts in zip(rest, cuts):
            out[k] = b"".join([self.parts[p] for p in parts])
        return out

    def agenda(self, unit: str) -> list[int]:
        """Ids of one unit."""
        symbols: list[str] = list(unit)
        last = len(symbols) - 1
        before, after = list(range(-1, last)), list(range(1, last + 2))
        scores, waiting = self.scores, []
        for i in range(last):
            pair = symbols[i] + symbols[i + 1]
            if pair in scores:
                waiting.append((-scores[pair], i, pair))
        heapq.heapify(waiting)
        while waiting:
            _, left, pair = heapq.heappop(waiting)
            right = after[left]
            if not symbols[left] or right > last or symbols[left] + symbols[right] != pair:
                continue  # one of the two has been merged since
            symbols[left], symbols[right] = pair, ""
            follow = after[left] = after[right]
            if follow <= last:
                before[follow] = left
                longer = pair + symbols[follow]
                if longer in scores:
                    heapq.heappush(waiting, (-scores[longer], left, longer))
            lead = before[left]
            if lead >= 0:
                longer = symbols[lead] + pair
                if longer in scores:
                    heapq.heappush(waiting, (-scores[longer], lead, longer))
        out: list[int] = []
        for symbol in symbols:
            if symbol in self.ids:
                out.append(self.ids[symbol])
            elif symbol:
                out.extend(self.octets[b] for b in symbol.encode())
        return out

    def cut(self, unit: str) -> list[str]:
        """Parts that no piece reaches over."""
        together = self.side_by_side
        parts, start = [], 0
        for i, pair in enumerate(zip(unit, unit[1:]), 1):
            if pair not in together:
                parts.append(unit[start:i])
                start = i
        parts.append(unit[start:])
        return parts

    def _units(self, units: list[str]) -> list[bytes]:
        """Ids of units, which are keyed without the space mark they begin with."""
        get = self.whole.__getitem__
        deque(map(get, units), maxlen=0)
        pending, self.whole.pending = self.whole.pending, []
        if pending:
            coded = self._merged(pending)
            self._compare(pending, coded)
            self.whole.update(zip(pending, coded))
        return list(map(get, units))

    def _compare(self, units: list[str], coded: list[bytes]) -> None:
        """Every unit is given to the library as well: many as one text, where each begins with one space."""
        plain = [k for k, u in enumerate(units) if u and MARK not in u and " " not in u]
        texts = [" ".join([units[k] for k in plain[at: at + CALL]]) for at in range(0, len(plain), CALL)]
        for at, ids in zip(range(0, len(plain), CALL), self.library.encode(texts, num_threads=1)):
            some = plain[at: at + CALL]
            if b"".join([coded[k] for k in some]) != np.array(ids, dtype="<u4").tobytes():
                raise ValueError(f"the library encodes one of {[units[k] for k in some]!r} in another way")
        others = sorted({*range(len(units))} - {*plain})
        for k, ids in zip(others, self.library.encode([units[k] for k in others], num_threads=1)):
            if units[k] and coded[k] != np.array(ids, dtype="<u4").tobytes():
                raise ValueError(f"the library encodes {units[k]!r} in another way")

    def encode(self, texts: pa.Array | list[str]) -> list[bytes]:
        """Ids with begin and end as little-endian unsigned 32-bit octets; a null text counts as empty."""
        import pyarrow.compute as pc

        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        self.whole.turn(self.limit)
        self.parts.turn(self.limit)
        odd = pc.match_substring_regex(texts, f"^$|^ |  |{MARK}").to_numpy(zero_copy_only=False)
        which, words, count = words_between_spaces(texts.filter(pa.array(~odd)))
        octets = self._units(strings(words))
        many = np.array([len(o) // 4 for o in octets], dtype=np.int64)
        plain = iter(as_octets(*gathered(which, count, np.frombuffer(b"".join(octets), dtype="<u4"), many)))
        rest = texts.filter(pa.array(odd)).to_pylist()
        units = [[u[1:] for u in re.findall(f"{MARK}+[^{MARK}]*", (MARK + t).replace(" ", MARK))] if t else [] for t in rest]
        known = iter(self._units([u for us in units for u in us]))
        cut = iter([b"".join([next(known) for _ in us]) for us in units])
        head, tail = (np.array([i], dtype="<u4").tobytes() for i in (self.begin, self.end))
        return [head + (next(cut) if o else next(plain)) + tail for o in odd.tolist()]

    def decode(self, coded: list[bytes]) -> list[str]:
        """Texts of ids: surfaces put together, octets read as UTF-8, without the space put in front."""
        ids = np.frombuffer(b"".join(coded), dtype="<u4").astype(np.int64)
        sizes, count = self.surface_n[ids], np.array([len(raw) // 4 for raw in coded], dtype=np.int64)
        raw = self.surfaces[ranges(self.surface_at[ids], sizes)].tobytes()
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum(count)].tolist()
        texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip([0, *ends], ends)]
        texts = [t[1:] if t[:1] == " " else t for t in texts]
        listed = [np.frombuffer(each, dtype="<u4").tolist() for each in coded]
        for own, other in zip(texts, self.library.decode(listed, num_threads=1)):
            if own != other:
                raise ValueError("the library decodes a document in another way")
        return texts


def encode_decode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", keep: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256 [, ids, decoded]) of every row, whole texts.

    Ids hold begin and end. A null text counts as empty: begin and end alone. Nothing is shuffled;
    repeated rows give repeated rows; other columns are not read.
    """
    def make():
        model = kept(("pieces", path), lambda: PieceModel(path))

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            coded = model.encode(batch.column(1))
            decoded = model.decode(coded)
            columns = [
                batch.column(0), pa.array([len(raw) // 4 for raw in coded], pa.int64()),
                pa.array([hashlib.sha256(raw).hexdigest() for raw in coded]),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in decoded]),
            ]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep:
                columns += [pa.array([np.frombuffer(raw, dtype="<i4") for raw in coded], pa.list_(pa.int32())), pa.array(decoded)]
                names += ["ids", "decoded"]
            return pa.RecordBatch.from_arrays(columns, names)
        return work

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep
    picked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return picked.mapInArrow(by_slice(make, "text", TOGETHER), schema)
