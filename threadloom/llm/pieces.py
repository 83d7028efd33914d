"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A text is a row of symbols, one per character. All adjacent pairs whose joined
text is a piece wait in an agenda ordered by piece score, then by place. The
best pair is merged, its two new neighbours enter the agenda, and so on until
the agenda is empty. Symbols that are no piece become byte pieces.

No piece may hold a word mark after another character (tested when the model is
loaded), so merges never pass such a place and the text is cut there. The
distinct stretches of a run of documents are merged side by side: their agenda
is one array of pair ranks from which every stretch takes its best pair in each
round. Long stretches have a heap of their own instead.

``encode`` and ``decode`` are the operators. With ``check`` the sentencepiece
library encodes and decodes the distinct stretches of every Arrow batch too
(or the whole texts, with ``check="texts"``), and a difference raises.

Cases: null text counts as empty; an empty text has the end id alone (or no id)
and decodes to ''; repeated rows give repeated results; an empty table gives an
empty table; other columns pass through, and a column of the table that has the
name of an output column is replaced by the output.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from threadloom.llm.batches import extended, map_batches, put
from threadloom.llm.words import run_hash

MARK = "▁"
#: Characters of whole documents handled at once; a run takes some 90 bytes for each.
RUN_CHARS = 1 << 20
#: A longer stretch is merged by the heap, since rounds over arrays would take its length squared.
LONG = 48
#: Stretches merged side by side.
AT_ONCE = 4096
_NONE = np.iinfo(np.int64).max


class PairTable:
    """(left, right) -> (rank, joined symbol): an open-addressing table for arrays of pairs."""

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]]):
        self.bits = max(10, (4 * len(pairs)).bit_length())
        left, right = (np.array([p[k] for p in pairs] or [0], np.int64) for k in (0, 1))
        keys = (left << 32 | right)[: len(pairs)]
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, _NONE, np.int64)
        values = np.array([rank << 32 | joined for rank, joined in pairs.values()], np.int64)
        at, left_over = self._slot(keys), np.arange(len(keys))
        while len(left_over):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[left_over[free]]  # of several for one slot the last stays
            done = self.keys[at] == keys[left_over]
            self.values[at[done]] = values[left_over[done]]
            at, left_over = (at[~done] + 1) & ((1 << self.bits) - 1), left_over[~done]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """rank << 32 | joined symbol, or the largest number for pairs that don't join."""
        keys = left.astype(np.int64) << 32 | right
        at = self._slot(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], _NONE)
        open_ = np.flatnonzero((found != keys) & (found >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            found = self.keys[at[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out


class Pieces:
    """A model file as plain tables, and the two algorithms over them."""

    def __init__(self, model_file: str):
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_file=model_file)
        lib, ids = self.library, range(self.library.get_piece_size())
        if any(lib.is_unused(i) for i in ids):
            raise ValueError("vocabularies with unused pieces are not supported")
        self.ids = {lib.id_to_piece(i): i for i in ids if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i))}
        self.score = {piece: lib.get_score(i) for piece, i in self.ids.items()}
        self.bytes = {int(lib.id_to_piece(i)[3:5], 16): i for i in ids if lib.is_byte(i)}
        self.end, self.unknown = lib.eos_id(), lib.unk_id()
        self.control = {i for i in ids if lib.is_control(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.surface = ["" if i in self.control else lib.id_to_piece(i).replace(MARK, " ") for i in ids]
        if self.unknown >= 0:
            self.surface[self.unknown] = lib.decode([self.unknown])
        self.decimal = [str(i) for i in ids]
        self.cut = not any(MARK in piece.lstrip(MARK) for piece in self.ids)
        # Symbols are pieces and single characters of pieces; the rest never joins.
        symbols = dict(self.ids)
        for c in sorted({c for piece in self.ids for c in piece} - set(symbols)):
            symbols[c] = len(ids) + len(symbols)
        self.nothing = 2 * (len(ids) + len(symbols))
        order = sorted(set(self.score.values()), reverse=True)
        rank = {x: i for i, x in enumerate(order)}
        self.pairs = PairTable(
            {
                (symbols[piece[:k]], symbols[piece[k:]]): (rank[self.score[piece]], i)
                for piece, i in self.ids.items()
                for k in range(1, len(piece))
                if piece[:k] in symbols and piece[k:] in symbols
            }
        )
        self.symbol_of = np.full(0x110000, self.nothing, np.int32)
        for piece, i in symbols.items():
            if len(piece) == 1:
                self.symbol_of[ord(piece)] = i
        self.pieces = len(ids)

    def merge(self, stretch: str) -> list[int]:
        """Ids of one stretch, by an agenda in a heap."""
        score, n = self.score, len(stretch)
        symbol = list(stretch)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = []
        for i in range(n - 1):
            joined = stretch[i : i + 2]
            if joined in score:
                agenda.append((-score[joined], i, joined))
        heapq.heapify(agenda)
        while agenda:
            _, i, joined = heapq.heappop(agenda)
            left, j = symbol[i], after[i]
            # a merge since then may have taken one of the two symbols
            if not left or j >= n or left + symbol[j] != joined:
                continue
            symbol[i], symbol[j] = joined, ""
            j = after[i] = after[j]
            if j < n:
                before[j] = i
                new = joined + symbol[j]
                if new in score:
                    heapq.heappush(agenda, (-score[new], i, new))
            k = before[i]
            if k >= 0:
                new = symbol[k] + joined
                if new in score:
                    heapq.heappush(agenda, (-score[new], k, new))
        out = []
        for piece in filter(None, symbol):
            if piece in self.ids:
                out.append(self.ids[piece])
            elif self.bytes:
                out += [self.bytes[b] for b in piece.encode()]
            else:
                out.append(self.unknown)
        return out

    def merge_all(self, chars: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of many stretches of code points, and how many each has."""
        parts = [self._merge_some(chars, start[i : i + AT_ONCE], end[i : i + AT_ONCE]) for i in range(0, len(start), AT_ONCE)]
        none = np.zeros(0, np.int64)
        return np.concatenate([none.astype(np.int32), *(x for x, _ in parts)]), np.concatenate([none, *(n for _, n in parts)])

    def _merge_some(self, chars: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One agenda array for stretches that fit the cache of a core."""
        sizes = end - start
        short = np.flatnonzero(sizes <= LONG)
        owner = np.repeat(short, sizes[short])
        at = _ranges(start[short], sizes[short])
        symbol = self.symbol_of[chars[at]]
        agenda = np.full(len(owner), _NONE)
        same = np.flatnonzero(owner[:-1] == owner[1:])
        agenda[same] = self.pairs.get(symbol[same], symbol[same + 1])
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(owner):
            heads = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            # rank first, then place, so that equal scores go from left to right
            place = np.where(agenda == _NONE, _NONE, agenda >> 32 << 32 | np.arange(len(owner)))
            best = np.minimum.reduceat(place, heads)
            over = np.repeat(best == _NONE, np.diff(np.append(heads, len(owner))))
            done.append((owner[over], symbol[over], at[over]))
            best = best[best != _NONE] & 0xFFFFFFFF
            symbol[best] = agenda[best] & 0xFFFFFFFF
            keep = ~over
            keep[best + 1] = False
            best = (np.cumsum(keep) - 1)[best]
            owner, symbol, at, agenda = owner[keep], symbol[keep], at[keep], agenda[keep]
            for i in (best[best > 0] - 1, best):
                j = np.minimum(i + 1, len(owner) - 1)
                joined = (owner[i] == owner[j]) & (i != j)
                agenda[i] = np.where(joined, self.pairs.get(symbol[i], symbol[j]), _NONE)
        owner, symbol, at = (np.concatenate([d[k] for d in done] or [np.zeros(0, np.int64)]) for k in range(3))
        owner, ids = self._to_ids(owner, symbol.astype(np.int64), chars[at])
        for i in np.flatnonzero(sizes > LONG):
            own = self.merge(chars[start[i] : end[i]].astype("<u4").tobytes().decode("utf-32-le"))
            owner, ids = np.append(owner, np.full(len(own), i)), np.append(ids, own)
        order = np.argsort(owner, kind="stable")
        return ids[order].astype(np.int32), np.bincount(owner, minlength=len(start))

    def _to_ids(self, owner: np.ndarray, symbol: np.ndarray, char: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Replace symbols that are no piece by their bytes or the unknown id."""
        odd = np.flatnonzero(symbol >= self.pieces)
        if not len(odd):
            return owner, symbol
        kinds, which = np.unique(char[odd], return_inverse=True)
        spelt = [[self.bytes[b] for b in chr(c).encode()] if self.bytes else [self.unknown] for c in kinds]
        count = np.ones(len(symbol), np.int64)
        count[odd] = np.array([len(x) for x in spelt])[which]
        first = np.cumsum(count) - count
        owner, out = np.repeat(owner, count), np.repeat(symbol, count)
        for k in range(4):
            has = count[odd] > k
            has &= np.array([len(x) > k for x in spelt])[which]
            out[first[odd[has]] + k] = np.array([x[k] if len(x) > k else 0 for x in spelt])[which[has]]
        return owner, out

    def encode_all(self, texts: list[str], end: bool = True, check: bool = False) -> list[list[int]]:
        """Ids of each text."""
        return [ids for part in runs_of(texts) for ids in self._encode_run(part, end, check)]

    def _encode_run(self, texts: list[str], end: bool, check: bool) -> list[list[int]]:
        marked = [MARK + x.replace(" ", MARK) if x else "" for x in texts]
        chars = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32)
        limits = np.concatenate([[0], np.cumsum([len(x) for x in marked])])
        mark = chars == ord(MARK)
        begins = np.zeros(len(chars) + 1, bool)
        begins[limits] = True
        begins = begins[:-1]
        if self.cut and len(chars):
            begins[1:] |= mark[1:] & ~mark[:-1]
        start = np.flatnonzero(begins)
        stop = np.append(start[1:], len(chars)).astype(np.int64)
        sizes = stop - start
        _, first, which = np.unique(run_hash(chars, start, stop), return_index=True, return_inverse=True)
        here = np.repeat(start[first][which] - start, sizes) + np.arange(len(chars))
        if not np.array_equal(sizes, sizes[first][which]) or not np.array_equal(chars, chars[here]):
            first = which = np.arange(len(start))  # two stretches have one hash
        ids, counts = self.merge_all(chars, start[first], stop[first])
        offsets = np.cumsum(counts) - counts
        if check:
            self.check_stretches(chars, start[first], stop[first], ids, offsets)
        counts = counts[which]
        flat = ids[_ranges(offsets[which], counts)]
        ends = np.concatenate([[0], np.cumsum(counts)])[np.searchsorted(start, limits)]
        tail = [self.end] if end else []
        return [flat[a:b].tolist() + tail for a, b in zip(ends[:-1], ends[1:])]

    def decode(self, ids: list[int]) -> str:
        """The text of ids: byte pieces are joined to characters, the first word mark is dropped."""
        if self.byte_of.keys().isdisjoint(ids):
            text = "".join(map(self.surface.__getitem__, ids))
        else:
            parts = [
                bytes(map(self.byte_of.__getitem__, run)).decode("utf-8", "replace") if spelt else "".join(map(self.surface.__getitem__, run))
                for spelt, run in groupby(ids, self.byte_of.__contains__)
            ]
            text = "".join(parts)
        first = next((i for i in ids if i not in self.control), None)
        return text[1:] if first is not None and first not in self.byte_of and text.startswith(" ") else text

    def check(self, texts: list[str], ids: list[list[int]]) -> None:
        """Raise unless the sentencepiece library gives the same ids and decodes them alike."""
        theirs = self.library.encode(texts, out_type=int, add_bos=False, add_eos=False, num_threads=1)
        for text, own, other in zip(texts, ids, theirs, strict=True):
            if own != other:
                raise AssertionError(f"ids differ from the sentencepiece library for {text[:200]!r}")
        if texts and [self.decode(x) for x in ids] != self.library.decode(ids):
            raise AssertionError("decoded text differs from the sentencepiece library")

    def check_stretches(self, chars: np.ndarray, start: np.ndarray, stop: np.ndarray, ids: np.ndarray, offsets: np.ndarray) -> None:
        """The same for stretches, a few hundred at a time as one text: merges never pass a cut."""
        counts = np.diff(np.append(offsets, len(ids)))
        # Marks at the end of a stretch would join those of the next, so these stretches stay alone;
        # a single mark is left out, since for the library its text is empty.
        alone = np.flatnonzero((chars[stop - 1] == ord(MARK)) & (stop - start > 1)) if len(start) else []
        joined = np.flatnonzero(chars[stop - 1] != ord(MARK)) if len(start) else []
        groups = [joined[i : i + 256] for i in range(0, len(joined), 256)] if self.cut else [[i] for i in joined]
        texts, own = [], []
        for group in [*groups, *([i] for i in alone)]:
            group = np.asarray(group)
            chosen = chars[_ranges(start[group], stop[group] - start[group])]
            texts.append(chosen.tobytes().decode("utf-32-le").replace(MARK, " ")[1:])
            own.append(ids[_ranges(offsets[group], counts[group])].tolist())
        self.check(texts, own)

    def checked(self, texts: list[str], end: bool, check: str | None) -> list[list[int]]:
        ids = self.encode_all(texts, end, check == "stretches")
        if check == "texts":
            self.check(texts, [x[: len(x) - end] for x in ids])
        return ids


@lru_cache(maxsize=2)
def load(model_file: str) -> Pieces:
    return Pieces(model_file)


def _ranges(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... of every range, one after the other."""
    return np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def runs_of(texts: list[str]) -> Iterator[list[str]]:
    """Whole texts, about RUN_CHARS characters at a time."""
    i = 0
    while i < len(texts):
        j, n = i, 0
        while j < len(texts) and (j == i or n + len(texts[j]) <= RUN_CHARS):
            n += len(texts[j])
            j += 1
        yield texts[i:j]
        i = j


def portions(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """Rows of a batch with about RUN_CHARS bytes of text, so that no more of it is ever spread out in Python."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    ends, i = np.cumsum(sizes, dtype=np.int64), 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + RUN_CHARS, "right")))
        yield batch.slice(i, j - i)
        i = j


def plain(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def encode(df: DataFrame, model_file: str, text: str = "text", out: str = "ids", end: bool = True, check: str | None = None) -> DataFrame:
    """Add the ids of ``text`` as an array of integers."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model_file)
        for batch in (part for whole in source for part in portions(whole, text)):
            ids = pieces.checked(plain(batch.column(text)), end, check)
            yield put(batch, {out: pa.array(ids, pa.list_(pa.int32()))})

    return map_batches(df, run, extended(df, {out: T.ArrayType(T.IntegerType())}))


def decode(df: DataFrame, model_file: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the text of an array of ids; null ids give an empty text."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model_file)
        for batch in source:
            texts = [pieces.decode(x or []) for x in batch.column(ids).to_pylist()]
            yield put(batch, {out: pa.array(texts, pa.string())})

    return map_batches(df, run, extended(df, {out: T.StringType()}))


def round_trip(df: DataFrame, model_file: str, text: str = "text", check: str | None = "stretches", keep_ids: bool = False) -> DataFrame:
    """Encode with an end id, decode, and add n_tokens and the SHA-256 of both results.

    The digests are of the decimal ids joined by one space and of the decoded
    text. Decoded texts stay in the worker, and so do ids unless ``keep_ids``
    adds them as an array.
    """

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model_file)
        for batch in (part for whole in source for part in portions(whole, text)):
            n_tokens, ids_hash, text_hash, all_ids = [], [], [], []
            for ids in pieces.checked(plain(batch.column(text)), True, check):
                n_tokens.append(len(ids))
                if keep_ids:
                    all_ids.append(np.array(ids, np.int32))
                ids_hash.append(sha256(" ".join(map(pieces.decimal.__getitem__, ids)).encode()).hexdigest())
                text_hash.append(sha256(pieces.decode(ids).encode()).hexdigest())
            new = {
                "n_tokens": pa.array(n_tokens, pa.int64()),
                "ids_sha256": pa.array(ids_hash, pa.string()),
                "decoded_sha256": pa.array(text_hash, pa.string()),
            }
            yield put(batch, new | ({"ids": pa.array(all_ids, pa.list_(pa.int32()))} if keep_ids else {}))

    added: dict[str, T.DataType] = {"n_tokens": T.LongType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()}
    return map_batches(df, run, extended(df, added | ({"ids": T.ArrayType(T.IntegerType())} if keep_ids else {})))
