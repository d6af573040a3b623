"""SentencePiece encoding and decoding by batched numpy Viterbi.

A model file gives pieces and scores; a text's ids are its best path: the pieces that join to the
text with the greatest sum of scores (the earlier start wins a tie). Segments of equal
length advance together: all their substrings of one length are hashed at once, the hashes probe the sorted keys of
the pieces, and vectorised maxima store backpointers. Found pieces are compared with the text afterwards, so a
hash collision can't change a result.

The model file decides scores, and the path is the exact optimum in double precision. A file of the merging kind
(scores are merge ranks) is read as the same lattice: its path has the least rank sum, whereas merging
pair by pair gives its own segmentation. Characters outside the pieces fall back to byte pieces, else to the unknown id.
Decoding joins pieces, turns the meta symbol back into spaces and drops the one leading space of encoding, so texts come back
exactly, except that a meta symbol of the text itself becomes a space.

Defined results: null text counts as empty; an empty text has no ids; words beyond ``LONG_WORD`` characters take a path of their own, in time and memory proportional to their length;
ids outside the model decode as the unknown mark; repeated rows give repeated results.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weir.llm._shared import PIECE, lean_batches, texts, worker_cache
from weir.llm.segments import CachedEncoder, gather, ragged
from weir.session import ship

META = "▁"
UNKNOWN_MARK = " ⁇ "
UNKNOWN_PENALTY = 10.0
LONG_WORD = 2_000  #: characters from which a word is walked by itself: a step over ends costs the same for one word as for a thousand
_BASE = np.uint64(0x9E3779B97F4A7C15)
_LENGTH = np.uint64(0xC2B2AE3D27D4EB4F)
_MIX, _SLOTS = np.uint64(0xD6E8FEB86659FD93), 20  #: of the table of beginnings
_GOES_ON, _WHOLE = 1, 2  #: what it says of a substring: a longer piece may begin with it, it may be a piece
CHARACTERS = 500_000  #: of words that advance together, some 250 bytes each
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6  #: fixed values of the model format
_CUT = re.compile(r"(?<=[^ ])(?= )")


@dataclass
class Pieces:
    """What encoding and decoding need of a model file."""

    keys: np.ndarray
    ids: np.ndarray
    scores: np.ndarray
    surface: list[bytes]
    texts: list[str]
    begins: np.ndarray
    codes: np.ndarray
    sizes: np.ndarray
    byte_ids: list[int] | None
    unknown: int
    unknown_score: float
    longest: int
    prefix: bool


def model_path(name: str = "piece_bpe_32k.model") -> str:
    """Where the public model's file lies on this machine."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def load(path: str) -> Pieces:
    """Read a model file, once a worker."""
    held = worker_cache("pieces")
    if path not in held:
        from sentencepiece import sentencepiece_model_pb2 as pb

        with open(path, "rb") as f:
            held[path] = from_proto(pb.ModelProto.FromString(f.read()))
    return held[path]


def from_proto(proto) -> Pieces:
    """Tables of a model; only the identity normalizer is supported."""
    spec = proto.normalizer_spec
    if spec.precompiled_charsmap and spec.name != "identity" or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
        raise ValueError("only models with the identity normalizer are supported")
    found, surface, bytes_of, unknown = [], [], {}, 0
    for i, p in enumerate(proto.pieces):
        if p.type == _BYTE:
            bytes_of[int(p.piece[3:5], 16)] = i
            surface.append(bytes((int(p.piece[3:5], 16),)))
        elif p.type == _UNKNOWN:
            unknown = i
            surface.append(UNKNOWN_MARK.encode())
        elif p.type == _CONTROL:
            surface.append(b"")
        else:
            surface.append(p.piece.replace(META, " ").encode())
            if p.type in (_NORMAL, _USER):
                found.append((i, p.piece.replace(META, " "), p.score))
    keys = np.empty(len(found), dtype=np.uint64)
    begins = np.zeros(1 << _SLOTS, dtype=np.uint8)
    for n in {len(t) for _, t, _ in found}:
        at = [k for k, (_, t, _) in enumerate(found) if len(t) == n]
        prefixes = _prefixes(_codes([found[k][1] for k in at], n))
        keys[at] = _substrings(prefixes, n)[:, 0]
        for m in range(1, n + 1):
            begins[_slot(prefixes[:, m] ^ _tag(m))] |= _GOES_ON if m < n else _WHOLE
    order = np.argsort(keys, kind="stable")
    normal = [p.score for p in proto.pieces if p.type == _NORMAL]
    return Pieces(
        keys[order],
        np.array([i for i, _, _ in found], dtype=np.int32)[order],
        np.array([s for _, _, s in found], dtype=np.float64)[order],
        surface,
        [found[k][1] for k in order],
        begins,
        _codes(["".join(found[k][1] for k in order)], -1)[0] if found else np.zeros(0, dtype="<u4"),
        np.array([len(found[k][1]) for k in order], dtype=np.int64),
        [bytes_of[b] for b in range(256)] if len(bytes_of) == 256 else None,
        unknown,
        min(normal, default=0.0) - UNKNOWN_PENALTY,
        max((len(t) for _, t, _ in found), default=1),
        spec.add_dummy_prefix,
    )


def _tag(n: int) -> np.uint64:
    """What sets keys of length n apart."""
    return np.uint64(int(_LENGTH) * n & (1 << 64) - 1)


def _slot(keys: np.ndarray) -> np.ndarray:
    return (keys * _MIX) >> np.uint64(64 - _SLOTS)


def _codes(words: list[str], n: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4").reshape(len(words), n)


def _prefixes(codes: np.ndarray) -> np.ndarray:
    """Polynomial hashes of all prefixes, modulo 2 ** 64."""
    out = np.zeros((codes.shape[0], codes.shape[1] + 1), dtype=np.uint64)
    for j in range(codes.shape[1]):
        out[:, j + 1] = out[:, j] * _BASE + codes[:, j] + np.uint64(1)
    return out


def _substrings(prefixes: np.ndarray, n: int) -> np.ndarray:
    """Keys of all substrings of length n, by start."""
    power = np.uint64(pow(int(_BASE), n, 1 << 64))
    return (prefixes[:, n:] - prefixes[:, : prefixes.shape[1] - n] * power) ^ _tag(n)


def viterbi(p: Pieces, words: list[str]) -> list[bytes]:
    """ids of words, packed as little-endian 16-bit numbers (32-bit beyond 65,536 pieces)."""
    out = [b""] * len(words)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    order = np.argsort(-sizes, kind="stable")
    long, some = np.count_nonzero(sizes > LONG_WORD), np.count_nonzero(sizes)
    for i in order[:long].tolist():
        out[i] = long_viterbi(p, words[i])
    order = order[long:some]
    for part in np.split(order, np.flatnonzero(np.diff(np.cumsum(sizes[order]) // CHARACTERS)) + 1):
        if len(part):
            at = part.tolist()
            for i, ids in zip(at, _paths(p, [words[i] for i in at], sizes[part])):
                out[i] = ids
    return out


def _found(p: Pieces, codes: np.ndarray, follow: np.ndarray, longest: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length from 1: first and last character, in order, and table row of all pieces in the words; ``follow`` is the next character, -1 at a word's end. A character that is no piece has row -1."""
    first, found = np.arange(len(codes)), []
    last, key = first, codes.astype(np.uint64) + np.uint64(1)
    for m in range(1, longest + 1):
        if m > 1:
            last = follow[last]
            live = np.flatnonzero(last >= 0)
            first, last = first[live], last[live]
            key = key[live] * _BASE + codes[last] + np.uint64(1)
        tagged = key ^ _tag(m)
        seen = p.begins[_slot(tagged)]
        at = np.flatnonzero(seen & _WHOLE)
        tagged = tagged[at]
        row = np.minimum(np.searchsorted(p.keys, tagged), len(p.keys) - 1)
        same = p.keys[row] == tagged
        at, row = at[same], row[same]
        if m == 1:
            every = np.full(len(codes), -1)
            every[at] = row
            found.append((first, last, every))
        else:
            found.append((first[at], last[at], row))
        live = np.flatnonzero(seen & _GOES_ON)
        first, last, key = first[live], last[live], key[live]
    return found


def _paths(p: Pieces, words: list[str], sizes: np.ndarray) -> list[bytes]:
    """``viterbi`` of words in descending order of their sizes. Characters are numbered place by place, so a step over ends touches neighbours."""
    n, deep = len(words), int(sizes[0])
    flat = _codes(["".join(words)], int(sizes.sum()))[0]
    count = np.searchsorted(-sizes, -np.arange(deep + 1))  # words that have a character at each place
    column = np.r_[0, np.cumsum(count)]
    starts = np.cumsum(sizes) - sizes
    codes = flat[np.concatenate([starts[:c] + s for s, c in enumerate(count.tolist())])]
    place = np.repeat(np.arange(deep), count[:-1])
    every = np.arange(len(codes))
    follow = np.where(every - column[place] < count[place + 1], every + count[place], -1)
    before = every + np.where(place > 0, n - count[place - 1], 0)  # end 0 of each word, then the ends after each character
    found = _found(p, codes, follow, min(deep, p.longest))
    bounds, base = [], 0
    for first, _, _ in found:
        bounds.append((base + np.searchsorted(first, column[: deep + 1])).tolist())
        base += len(first)
    begin = before[np.concatenate([f[0] for f in found])]
    end = n + np.concatenate([f[1] for f in found])
    row = np.concatenate([f[2] for f in found])
    span = np.repeat(np.arange(1, len(found) + 1), [len(f[0]) for f in found])
    score = np.where(row >= 0, p.scores[row], p.unknown_score)
    del found, place, follow, before
    best, back = np.full(n + len(codes), -np.inf), np.zeros(n + len(codes), dtype=np.int64)
    best[:n] = 0.0
    for j in range(1, deep + 1):
        for m in range(min(j, len(bounds)), 0, -1):  # the earliest start comes first and keeps ties
            a, b = bounds[m - 1][j - m], bounds[m - 1][j - m + 1]
            if a == b:
                continue
            value, to = best[begin[a:b]] + score[a:b], end[a:b]
            better = np.flatnonzero(value > best[to])
            to = to[better]
            best[to], back[to] = value[better], better + a
    # walk back over all words at once
    live, at, steps, many = np.arange(n), n + column[sizes - 1] + np.arange(n), [], np.zeros(n, dtype=np.int64)
    while len(live):
        hit = back[at]
        steps.append((live, hit))
        many[live] += 1
        at = begin[hit]
        more = at >= n
        live, at = live[more], at[more]
    ends = np.cumsum(many)
    path = np.empty(int(ends[-1]), dtype=np.int64)
    for k, (live, hit) in enumerate(steps):
        path[ends[live] - 1 - k] = hit
    row, span = row[path], span[path]
    # what the keys found must be what the text says
    known = row >= 0
    right = known & (p.sizes[row] == span)
    false = np.repeat(known & ~right, span)
    false[np.repeat(right, span)] = gather(p.codes, np.cumsum(p.sizes) - p.sizes, p.sizes, row[right])[0] != flat[np.repeat(right, span)]
    kind = "<u2" if len(p.surface) <= 65_536 else "<u4"
    if known.all():
        ids, cut = p.ids[row], np.r_[0, ends]
    else:  # an unknown character has several ids
        odd, which = np.unique(flat[(np.cumsum(span) - span)[~known]], return_inverse=True)
        spelt = [[p.byte_ids[b] for b in chr(c).encode("utf-8", "replace")] if p.byte_ids else [p.unknown] for c in odd.tolist()]
        many = np.r_[np.ones(len(p.ids), dtype=np.int64), [len(x) for x in spelt]]
        row[~known] = len(p.ids) + which
        ids, cut = gather(np.r_[p.ids, [i for x in spelt for i in x]], np.cumsum(many) - many, many, row)
        cut = cut[np.r_[0, ends]]
    packed, width = ids.astype(kind).tobytes(), np.dtype(kind).itemsize
    cut = (cut * width).tolist()
    out = [packed[a:b] for a, b in zip(cut, cut[1:])]
    for i in np.unique(np.searchsorted(starts, np.flatnonzero(false), "right") - 1).tolist():
        out[i] = plain_viterbi(p, words[i], kind)
    return out


def long_viterbi(p: Pieces, word: str, block: int = 65_536) -> bytes:
    """The same path for one long word: pieces are probed a block of ends at a time, and the walk over ends keeps two numbers each."""
    from array import array

    kind = "<u2" if len(p.surface) <= 65_536 else "<u4"
    best, back, row = array("d", [0.0]), array("i", [0]), array("i", [-1])
    scores = p.scores
    for at in range(0, len(word), block):
        begin, end = max(0, at - p.longest), min(len(word), at + block)
        prefixes = _prefixes_of(_codes([word[begin:end]], end - begin)[0])
        found: list[list[tuple[int, float, int]]] = [[] for _ in range(end - at)]
        for m in range(min(end - begin, p.longest), 0, -1):  # the earliest start comes first and keeps ties
            keys = _substrings(prefixes[None, :], m)[0]
            place = np.minimum(np.searchsorted(p.keys, keys), len(p.keys) - 1)
            for start in np.flatnonzero(p.keys[place] == keys).tolist():
                stop = begin + start + m
                if stop > at:
                    r = int(place[start])
                    found[stop - at - 1].append((m, scores[r], r))
        for j in range(at + 1, end + 1):
            top, length, which, one = -np.inf, 1, -1, False
            for m, score, r in found[j - at - 1]:
                value = best[j - m] + score
                one = one or m == 1
                if value > top:
                    top, length, which = value, m, r
            if not one and best[j - 1] + p.unknown_score > top:
                top, length, which = best[j - 1] + p.unknown_score, 1, -1
            best.append(top)
            back.append(length)
            row.append(which)
    rows, ends, j = [], [], len(word)
    while j:
        rows.append(row[j])
        ends.append(j)
        j -= back[j]
    return _with_unknown(p, word, np.array(rows[::-1]), np.array(ends[::-1]), kind)


def _prefixes_of(codes: np.ndarray) -> np.ndarray:
    """As ``_prefixes`` for one long word: runs of 256 characters advance together, then take up what lies before them."""
    n = len(codes)
    padded = np.zeros(-(-max(n, 1) // 256) * 256, dtype=np.uint64)
    padded[:n] = codes.astype(np.uint64) + np.uint64(1)
    runs = padded.reshape(-1, 256)
    inner = np.zeros((len(runs), 257), dtype=np.uint64)
    for k in range(256):
        inner[:, k + 1] = inner[:, k] * _BASE + runs[:, k]
    power = np.array([pow(int(_BASE), k, 1 << 64) for k in range(257)], dtype=np.uint64)
    out, before = np.zeros(len(padded) + 1, dtype=np.uint64), np.uint64(0)
    with np.errstate(over="ignore"):
        for i in range(len(runs)):
            out[256 * i : 256 * i + 257] = inner[i] + before * power
            before = out[256 * i + 256]
    return out[: n + 1]


def _with_unknown(p: Pieces, word: str, rows: np.ndarray, ends: np.ndarray, kind: str) -> bytes:
    ids, start = [], 0
    for r, end in zip(rows.tolist(), ends.tolist()):
        part = word[start:end]
        if r >= 0 and p.texts[r] != part:
            return plain_viterbi(p, word, kind)
        if r >= 0:
            ids.append(int(p.ids[r]))
        elif p.byte_ids:
            ids.extend(p.byte_ids[b] for b in part.encode("utf-8", "replace"))
        else:
            ids.append(p.unknown)
        start = end
    return np.array(ids, dtype=kind).tobytes()


def plain_viterbi(p: Pieces, word: str, kind: str = "<u2") -> bytes:
    """The same path by a plain loop over a dictionary; the reference in tests."""
    table = {t: (int(i), float(s)) for t, i, s in zip(p.texts, p.ids, p.scores)}
    best, back = [0.0] + [-np.inf] * len(word), [(0, None)] * (len(word) + 1)
    for j in range(1, len(word) + 1):
        for i in range(max(0, j - p.longest), j):
            hit = table.get(word[i:j])
            value = best[i] + (hit[1] if hit else p.unknown_score if i == j - 1 else -np.inf)
            if value > best[j]:
                best[j], back[j] = value, (i, hit and hit[0])
    ids, j = [], len(word)
    while j:
        i, got = back[j]
        one = [got] if got is not None else [p.byte_ids[b] for b in word[i:j].encode("utf-8", "replace")] if p.byte_ids else [p.unknown]
        ids[:0] = one
        j = i
    return np.array(ids, dtype=kind).tobytes()


def _segments(text: str) -> list[str]:
    return _CUT.split(text) if "  " in text or "\x00" in text else (text[0] + text[1:].replace(" ", "\x00 ")).split("\x00")


def encoder(path: str) -> CachedEncoder:
    """Encoder of whole texts with the worker's store of segments."""
    p = load(path)

    def cut(text: str) -> list[str]:
        text = text.replace(META, " ")
        return _segments(" " + text if p.prefix else text) if text else []

    return CachedEncoder(f"pieces of {path}", lambda some: viterbi(p, some), cut)


def decode(p: Pieces, ids) -> bytes:
    """The text of ids as UTF-8."""
    n = len(p.surface)
    text = b"".join([p.surface[i] if 0 <= i < n else UNKNOWN_MARK.encode() for i in ids])
    return text[1:] if p.prefix and text[:1] == b" " else text


def encode_texts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids, n_ids, the crc32 of the decoded text and whether it equals the text."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = path or model_path()
        p, encode = load(where), encoder(where)
        kind = "<u2" if len(p.surface) <= 65_536 else "<u4"
        for batch in lean_batches(batches, limit=PIECE):
            raw = texts(batch.column(1))
            packed = encode([t.decode("utf-8", "replace") for t in raw])
            values, ends = ragged(packed, kind)
            back = [decode(p, np.frombuffer(ids, dtype=kind).tolist()) for ids in packed]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(values)),
                    pa.array(np.diff(ends)),
                    pa.array([zlib.crc32(b) for b in back], pa.int64()),
                    pa.array([a == b for a, b in zip(raw, back)]),
                ],
                names=["doc_id", "ids", "n_ids", "decoded_crc32", "exact"],
            )

    return rows.mapInArrow(run, "doc_id long, ids array<int>, n_ids int, decoded_crc32 long, exact boolean")


def decode_ids(df: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id`` and the text of its ``ids``; null ids give a null text."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = load(path or model_path())
        for batch in batches:
            got = [None if ids is None else decode(p, [-1 if i is None else i for i in ids]).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.string())], names=["doc_id", "text"])

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")


def query(spark, sf_dir: str) -> DataFrame:
    """op3: ids of every document, and whether they decode to it."""
    from weir.session import table

    return encode_texts(table(spark, sf_dir, "documents"))
