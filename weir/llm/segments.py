"""Cutting texts where no token can span, so that encodings of repeated segments are reused.

A segment ends before a space that follows a character other than white space. Tokenizers whose
pre-tokenization or pieces let a space only begin a token encode a text as its segments
one after the other, so each distinct segment is encoded once and its ids are kept for as long as the Python
worker lives. Beyond ``CACHE`` segments the store keeps those of
the present batch, then drops its oldest half if that isn't enough, which bounds its memory. ``ColumnEncoder`` does the
same for byte-level tokenizers over a whole Arrow column at once.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from weir.llm._shared import offsets, worker_cache

CACHE = 400_000
STORE = 600_000  #: runs of a ColumnEncoder's store before it falls back to those of the present batch
_HARD = r"['\x00\x0b\x1c-\x1f\x{85}\x{a0}]|[^\x00-\x{24f}]|\s\s|^\s|^$"  #: pieces that aren't cut into runs by _runs
_SPACE = 3
_CLASS = np.array([_SPACE if c in (9, 10, 12, 13, 32) else {"L": 0, "N": 1}.get(unicodedata.category(chr(c))[0], 2) for c in range(0x250)], dtype=np.uint8)  #: of characters: letter, digit, mark, white space
LONGEST = 64  #: longer segments aren't kept
_CUT = re.compile(r"(?<=\S)(?= )")
_MIXED = re.compile(r"\s ")
_ODD = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}] "  #: the same, all white space named


def segments(text: str) -> list[str]:
    """The segments of a text; they join to the text."""
    if not text:
        return []
    if "\x00" in text or _MIXED.search(text):
        return _CUT.split(text)
    return (text[0] + text[1:].replace(" ", "\x00 ")).split("\x00")


class CachedEncoder:
    """ids of whole texts from a function that encodes a list of segments, as bytes of little-endian ``kind``."""

    def __init__(self, name: str, encode: Callable[[list[str]], list[bytes]], cut: Callable[[str], list[str]] = segments):
        self.known, self.encode, self.cut = worker_cache(name), encode, cut

    def __call__(self, texts: list[str]) -> list[bytes]:
        parts = [self.cut(t) for t in texts]
        known = self.known
        new = set()
        for p in parts:
            new.update(p)
        fresh = list(new.difference(known))
        if len(known) + len(fresh) > CACHE:
            for old in [x for x in known if x not in new]:
                del known[old]
            for old in list(known)[: max(0, len(known) - CACHE // 2)] if len(known) + len(fresh) > CACHE else ():
                del known[old]
            fresh = list(new.difference(known))
        once: dict[str, bytes] = {}
        for at in range(0, len(fresh), 20_000):
            some = fresh[at : at + 20_000]
            for s, ids in zip(some, self.encode(some)):
                (known if len(s) <= LONGEST else once)[s] = ids
        if once:
            get = lambda s: known[s] if s in known else once[s]
        else:
            get = known.__getitem__
        return [b"".join(map(get, p)) for p in parts]


class ColumnEncoder:
    """ids of a column of texts, as one array of values and one of ends.

    Arrow cuts the column at its spaces and numbers the distinct pieces; numpy cuts those into runs of letters, digits,
    marks and white space by a table of characters. Only runs new to the worker's store are encoded; ids of pieces and texts
    are gathered by number. What the runs don't express (apostrophes, several spaces, other scripts) is cut by ``parts``, the tokenizer's
    own rule; texts with a space after white space go to ``odd``, an encoder of whole texts.

    The store's keys are runs: ``x`` stands for ``" " + x`` and ``" " + x`` for ``x`` without a space before it. It gives
    a run's number in one array of ids. ``encode`` takes keys and gives them in an order of its own: (keys, ids of all, how many each has).
    """

    def __init__(self, name: str, encode: Callable[[list[str]], Iterator[tuple[list[str], np.ndarray, np.ndarray]]], parts: Callable[[str], list[str]], odd: CachedEncoder, kind: str):
        self.store, self.encode, self.parts, self.odd, self.kind = worker_cache(name), encode, parts, odd, kind
        self.store.setdefault("known", {})
        self.store.setdefault("pool", (np.zeros(0, dtype=kind), np.zeros(1, dtype=np.int64)))

    def _held(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(numbers of all runs, ids, ends of ids by number); new runs are encoded, and stored unless they are long."""
        known = self.store["known"]
        number = np.fromiter(map(known.get, runs, repeat(-1)), dtype=np.int64, count=len(runs))
        lost = np.flatnonzero(number < 0).tolist()
        if not lost:
            return number, *self.store["pool"]
        fresh = list(dict.fromkeys([runs[i] for i in lost]))
        if len(known) + len(fresh) > STORE:
            stay = {x: known[x] for x in runs if x in known}
            ids, ends = self.store["pool"]
            self.store["pool"] = gather(ids, ends[:-1], np.diff(ends), np.fromiter(stay.values(), dtype=np.int64, count=len(stay)))
            known.clear()
            known.update(zip(stay, range(len(stay))))
            number = np.fromiter(map(known.get, runs, repeat(-1)), dtype=np.int64, count=len(runs))
        long = {x for x in fresh if len(x) > LONGEST}
        self._add([x for x in fresh if x not in long], known)
        pool, once = self.store["pool"], {}
        if long:  # these end with the call
            self._add(list(long), once)
            pool, self.store["pool"] = self.store["pool"], pool
        number[lost] = [once[x] if x in once else known[x] for x in (runs[i] for i in lost)]
        return number, *pool

    def _add(self, keys: list[str], known: dict[str, int]) -> None:
        """Encode keys and number them on in ``known``."""
        ids, ends = self.store["pool"]
        ids, sizes, count = [ids], [], len(ends) - 1
        for at in range(0, len(keys), 20_000):
            for some, got, many in self.encode(keys[at : at + 20_000]):
                known.update(zip(some, range(count, count + len(some))))
                count += len(some)
                ids.append(got)
                sizes.append(many)
        if sizes:
            self.store["pool"] = np.concatenate(ids), np.r_[ends, ends[-1] + np.cumsum(np.concatenate(sizes))]

    def _slow(self, piece: str) -> list[str]:
        return [part[1:] if part[0] == " " and len(part) > 1 else " " + part for part in self.parts(piece[1:] if piece[:1] == " " else " " + piece)]

    def __call__(self, column: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(values as int32, ends as int32); ``end`` is appended to every text."""
        n = len(column)
        if column.null_count:
            column = pc.fill_null(column, "")
        odd = pc.match_substring_regex(column, _ODD).to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(odd), "", column) if odd.any() else column
        cut, flat = _lists(pc.split_pattern(plain, " "))
        first = flat.take(pa.array(cut[:-1]))
        coded = flat.dictionary_encode()
        pieces, index = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        index[cut[:-1]] = len(pieces) + np.arange(n)
        del plain, flat, coded  # as large as the column, each
        hard = pc.match_substring_regex(pieces, _HARD)
        mixed = pc.and_not(pc.invert(hard), pc.utf8_is_alpha(pieces))
        some, runs = _runs(pieces.filter(mixed))
        hard, mixed = (np.flatnonzero(x.to_numpy(zero_copy_only=False)) for x in (hard, mixed))
        words = np.delete(np.arange(len(pieces)), np.r_[hard, mixed])
        rest = np.delete(np.arange(some[-1]), some[:-1])  # runs without a space before them
        begun = pa.concat_arrays([runs.take(pa.array(some[:-1])), pieces.take(pa.array(words))]).dictionary_encode()
        bare = runs.take(pa.array(rest)).dictionary_encode()
        spelt = begun.dictionary.to_numpy(zero_copy_only=False).tolist()
        number = np.empty(some[-1] + len(words), dtype=np.int64)
        number[np.r_[some[:-1], some[-1] + np.arange(len(words))]] = begun.indices.to_numpy()
        number[rest] = len(spelt) + bare.indices.to_numpy().astype(np.int64)
        spelt += [" " + x for x in bare.dictionary.to_pylist()]
        by_hand = [self._slow(x) for x in pieces.take(pa.array(hard)).to_pylist()] + [self._slow(" " + x) if x else [] for x in first.to_pylist()]
        held, pool, pool_ends = self._held(spelt + [x for part in by_hand for x in part])
        # runs of each distinct piece, then those of the texts' first pieces
        hand = np.fromiter(map(len, by_hand), dtype=np.int64, count=len(by_hand))
        at_hand = len(number) + np.cumsum(hand) - hand
        begins, lengths = np.empty(len(pieces) + n, dtype=np.int64), np.ones(len(pieces) + n, dtype=np.int64)
        begins[words] = some[-1] + np.arange(len(words))
        begins[mixed], lengths[mixed] = some[:-1], np.diff(some)
        begins[hard], lengths[hard] = at_hand[: len(hard)], hand[: len(hard)]
        begins[len(pieces) :], lengths[len(pieces) :] = at_hand[len(hard) :], hand[len(hard) :]
        number = held[np.r_[number, len(spelt) + np.arange(hand.sum())]]
        of_piece, piece_ends = gather(number, begins, lengths, np.arange(len(begins)))
        ids, id_ends = gather(pool, pool_ends[:-1], np.diff(pool_ends), of_piece)
        id_ends = id_ends[piece_ends]
        starts, sizes = id_ends[:-1], np.diff(id_ends)
        if end is not None:
            index = np.insert(index, cut[1:], len(sizes))
            cut = cut + np.arange(n + 1)
            starts, sizes, ids = np.r_[starts, len(ids)], np.r_[sizes, 1], np.r_[ids, np.array([end], dtype=self.kind)]
        values, ends = gather(ids, starts, sizes, index)
        values, ends = values.astype(np.int32, copy=False), ends[cut]
        if odd.any():
            tail = b"" if end is None else np.array([end], dtype=self.kind).tobytes()
            other = dict(zip(np.flatnonzero(odd).tolist(), self.odd(column.filter(pa.array(odd)).to_pylist())))
            rows = [np.frombuffer(other[i] + tail, dtype=self.kind).astype(np.int32) if i in other else values[ends[i] : ends[i + 1]] for i in range(n)]
            values, ends = np.concatenate(rows), np.r_[0, np.cumsum([len(r) for r in rows])]
        return values, ends.astype(np.int32)


def _runs(pieces: pa.StringArray) -> tuple[np.ndarray, pa.StringArray]:
    """Runs of letters, digits or marks and single white spaces of pieces of characters below U+0250: (first run of each piece and the end, runs)."""
    ends, data = offsets(pieces).astype(np.int64), pieces.buffers()[2]
    if not len(pieces):
        return np.zeros(1, dtype=np.int64), pa.array([], pa.string())
    raw = np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]]
    kind = _CLASS[raw]
    two = np.flatnonzero(raw >= 0xC0)  # both bytes of a character have its class
    kind[two] = kind[two + 1] = _CLASS[(raw[two] & 0x1F).astype(np.int64) << 6 | raw[two + 1] & 0x3F]
    begins = np.r_[True, (kind[1:] != kind[:-1]) | (kind[1:] == _SPACE)]
    begins[ends[:-1] - ends[0]] = True
    at = np.flatnonzero(begins)
    cut = np.r_[at + ends[0], ends[-1]].astype(np.int32)
    return np.searchsorted(at, ends - ends[0]), pa.StringArray.from_buffers(len(at), pa.py_buffer(cut), data)


def _lists(array: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    """(offsets from 0, values) of a list array."""
    cut = array.offsets.to_numpy().astype(np.int64)
    return cut - cut[0], array.values.slice(cut[0], cut[-1] - cut[0])


def gather(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pool's slices of the given numbers, one after the other, and the ends of all, from 0."""
    many = sizes[index]
    ends = np.r_[0, np.cumsum(many)]
    place = np.repeat((starts[index] - ends[:-1]).astype(np.int32), many)
    place += np.arange(len(place), dtype=np.int32)
    return pool[place], ends


def ragged(rows: list[bytes], kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(values as int32, offsets as int32) of rows packed as ``kind``."""
    width = np.dtype(kind).itemsize
    ends = np.zeros(len(rows) + 1, dtype=np.int32)
    np.cumsum([len(r) // width for r in rows], out=ends[1:])
    return np.frombuffer(b"".join(rows), dtype=kind).astype(np.int32), ends
