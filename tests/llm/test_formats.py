"""Token files, SentencePiece and TIFF: exact round trips."""

import itertools
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from conftest import SF

from weir.llm import sentencepiece, tiff, tokenfile

ODD = ["", "a", "  a b  c\n d \t e", "x\x00 y  z", "\x1c a\x1cb!\x1c c", "  a b 　 c ", "don't  we'll ' s", "1234 5 67", "\n\n a\n\n b", "ab" * 3000, "é̂ 🙂🙂 ok ", "<s> <0x0A>", "a   ", " lead", "e " * 300]


def test_token_ids_equal_the_library():
    from tokenizers import Tokenizer

    encode, whole = tokenfile._encoder(tokenfile.vocabulary()), Tokenizer.from_file(tokenfile.vocabulary())
    texts = ODD + [x["text"] for x in pq.read_table(f"{SF}/documents.parquet").slice(0, 60).to_pylist()]
    for t, ids in zip(texts, encode(texts)):
        assert np.frombuffer(ids, "<u2").tolist() == whole.encode(t, add_special_tokens=False).ids, t[:40]


def test_token_files(spark, tmp_path):
    rows = [(5, "five words in this text"), (1, None), (3, ""), (5, "another five"), (-2, "minus"), (None, "no id"), (9, "long " * 20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS part", "2 AS ids")
    out = tokenfile.write_tokens(df, str(tmp_path / "t"))
    files = tokenfile.read_tokens(spark, out)
    before = tokenfile.starts(files)
    got = sorted(files.join(before, files.part == before.of_part).selectExpr("before + part_start AS start", "doc_id", "n_tokens", "ids").collect())
    assert [r.doc_id for r in got] == [None, -2, 1, 3, 5, 5, 9]
    at = 0
    for r in got:
        assert r.start == at and len(r.ids) == r.n_tokens and r.ids[-1] == tokenfile.END
        at += r.n_tokens
    one = files.where("doc_id = 9").select("n_tokens")
    assert "ids" not in one._jdf.queryExecution().executedPlan().toString() and one.count() == 1
    meta = [pq.ParquetFile(p).metadata.row_group(0) for p in (tmp_path / "t").glob("*.parquet")]
    assert all(m.column(0).has_offset_index and m.column(0).has_column_index for m in meta)
    assert tokenfile.read_tokens(spark, tokenfile.write_tokens(df.limit(0), str(tmp_path / "none"))).count() == 0


def test_token_query(spark):
    from tokenizers import Tokenizer

    whole, at = Tokenizer.from_file(tokenfile.vocabulary()), 0
    got = {r.doc_id: r for r in tokenfile.query(spark, SF).collect()}
    docs = {x["doc_id"]: x["text"] for x in pq.read_table(f"{SF}/documents.parquet").to_pylist()}
    assert set(got) == set(docs)
    for i in sorted(docs):
        ids = [*whole.encode(docs[i] or "", add_special_tokens=False).ids, 0]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_columns_encode_like_the_library(monkeypatch):
    from tokenizers import Tokenizer

    import pyarrow as pa

    from weir.llm import segments

    odd = [*ODD, "'s.'s'sx 're", "a.'s", "x..\n\nI y　 z", "² ½x 3½", "éx. y", "a\x85 b", " ", "  ", "a ", "ab.\n c", "\n", "中文 字.\nab", "w" * 100 + " " + "w" * 100, None]
    whole = Tokenizer.from_file(tokenfile.vocabulary())
    want = [[*whole.encode(t or "", add_special_tokens=False).ids, 0] for t in odd]
    for store in (segments.STORE, 3):  # a store that overflows at each batch gives the same ids
        monkeypatch.setattr(segments, "STORE", store)
        encode = tokenfile._column_encoder(tokenfile.vocabulary())
        for column in (pa.array(odd), pa.array(["x", *odd, "y"]).slice(1, len(odd))):
            values, ends = encode(column, 0)
            assert [values[a:b].tolist() for a, b in zip(ends, ends[1:])] == want
    values, ends = encode(pa.array([], pa.string()), 0)
    assert len(values) == 0 and ends.tolist() == [0]


def test_runs_are_cut_by_a_table_of_characters():
    import pyarrow as pa
    import regex

    from weir.llm import segments

    allowed = [c for c in map(chr, range(1, 0x250)) if c in "\t\n\f\r" or c not in "'\xa0\x85" and not c.isspace()]
    rng = np.random.default_rng(3)
    pieces = ["a" + "".join(rng.choice(allowed, n)) for n in rng.integers(0, 12, 3000)] + ["x", "Éa1²½.\nb", "ab.,", "\x01a"]
    for array in (pa.array(pieces), pa.array(["é", *pieces]).slice(1)):
        cut, runs = segments._runs(array)
        runs = runs.to_pylist()
        assert [runs[a:b] for a, b in zip(cut, cut[1:])] == [regex.findall(r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+|\s", x) for x in pieces]
    assert segments._runs(pa.array([], pa.string()))[0].tolist() == [0]


def test_a_run_is_encoded_once_and_long_ones_leave_no_trace():
    import pyarrow as pa

    encode = tokenfile._column_encoder(tokenfile.vocabulary())
    calls, plain = [], encode.encode
    encode.encode = lambda keys: calls.append(list(keys)) or plain(keys)
    column = pa.array(["one Quixotryword, andzzq.\nThenqqx end", "one Quixotryword " + "v" * 100])
    first = [x.tolist() for x in encode(column, 0)]
    assert sum(x.count("Quixotryword") for x in calls) == 1 and ["v" * 100] in calls
    held = len(encode.store["known"]), len(encode.store["pool"][0])
    calls.clear()
    assert [x.tolist() for x in encode(column, 0)] == first and calls == [["v" * 100]]
    assert (len(encode.store["known"]), len(encode.store["pool"][0])) == held and len(encode.store["pool"][1]) == held[0] + 1


def test_viterbi_is_the_best_path():
    p = sentencepiece.load(sentencepiece.model_path())
    words = [" " + w for w in "hello Hello, unbelievably xyzzy Straße éèà 12,345 ##$$ ①ab a".split()] + [" \n", "    ", "  x"]
    for w in words:
        assert sentencepiece.viterbi(p, [w])[0] == sentencepiece.plain_viterbi(p, w), w
    rng = np.random.default_rng(0)
    for n in (1, 2, 5, 9, 30):
        some = ["".join(rng.choice(list(" abcdetinsr①"), n)) for _ in range(40)]
        assert sentencepiece.viterbi(p, some) == [sentencepiece.plain_viterbi(p, w) for w in some]


def test_words_of_any_sizes_advance_together(monkeypatch):
    from dataclasses import replace

    p = sentencepiece.load(sentencepiece.model_path())
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list(" abcdehinorst①é🙂中"), n)) for n in rng.integers(1, 40, 300)] + [" the", "", " unbelievably", "x"]
    want = [sentencepiece.plain_viterbi(p, w) for w in words]
    assert sentencepiece.viterbi(p, words) == want and sentencepiece.viterbi(p, []) == []
    monkeypatch.setattr(sentencepiece, "CHARACTERS", 50)
    assert sentencepiece.viterbi(p, words) == want
    bare = replace(p, byte_ids=None)
    assert sentencepiece.viterbi(bare, words) == [sentencepiece.plain_viterbi(bare, w) for w in words]
    # pieces whose hashes belong to other texts, of the same size or not, must not get through
    for other in ("Qhe", "Q"):
        texts = [other if t == "the" else t for t in p.texts]
        wrong = replace(p, texts=texts, codes=sentencepiece._codes(["".join(texts)], -1)[0], sizes=np.array([len(t) for t in texts]))
        some = ["the", "ab", "xthex", "①the"]
        assert sentencepiece.viterbi(wrong, some) == [sentencepiece.plain_viterbi(wrong, w) for w in some] != sentencepiece.viterbi(p, some)


def test_long_words_take_the_same_path(monkeypatch):
    p = sentencepiece.load(sentencepiece.model_path())
    rng = np.random.default_rng(2)
    words = ["a" * 700, "".join(rng.choice(list("abcdetinsr①é"), 3000)), " " + "the" * 300, "①" * 5, "x"]
    for w in words:
        want = sentencepiece.plain_viterbi(p, w)
        assert sentencepiece.long_viterbi(p, w) == sentencepiece.long_viterbi(p, w, 64) == want
    monkeypatch.setattr(sentencepiece, "LONG_WORD", 100)
    assert sentencepiece.viterbi(p, [words[0]] * 2) == [sentencepiece.plain_viterbi(p, words[0])] * 2
    import time

    began = time.perf_counter()
    assert len(sentencepiece.long_viterbi(p, "ab" * 100_000)) > 0 and time.perf_counter() - began < 20


def test_whole_texts_equal_an_uncut_path():
    p = sentencepiece.load(sentencepiece.model_path())
    encode = sentencepiece.encoder(sentencepiece.model_path())
    texts = [t for t in ODD if t] + [x["text"][:400] for x in pq.read_table(f"{SF}/documents.parquet").slice(0, 12).to_pylist()]
    for t, ids in zip(texts, encode(texts)):
        score = dict(zip(p.ids.tolist(), p.scores.tolist()))
        total = lambda b: sum(score.get(i, 0.0) for i in np.frombuffer(b, "<u2").tolist())  # noqa: E731, B023
        whole = sentencepiece.plain_viterbi(p, (" " + t if p.prefix else t).replace("▁", " "))
        assert total(ids) == pytest.approx(total(whole)) and sentencepiece.decode(p, np.frombuffer(ids, "<u2").tolist()) == t.replace("▁", " ").encode()


def test_brute_force_over_all_segmentations():
    p = sentencepiece.load(sentencepiece.model_path())
    score = dict(zip(p.texts, p.scores))
    for w in (" the", " hest", " rerent", " onal"):
        best = -np.inf
        for cuts in itertools.product((0, 1), repeat=len(w) - 1):
            parts, start = [], 0
            for i, c in enumerate(cuts, 1):
                if c:
                    parts.append(w[start:i])
                    start = i
            parts.append(w[start:])
            if all(x in score for x in parts):
                best = max(best, sum(score[x] for x in parts))
        ids = np.frombuffer(sentencepiece.viterbi(p, [w])[0], "<u2")
        by_id = dict(zip(p.ids.tolist(), p.scores.tolist()))
        assert sum(by_id[i] for i in ids.tolist()) == best


def test_pieces_round_trip(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100, None), (100, None), (None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'clash' AS ids")
    got = sentencepiece.encode_texts(df)
    rows_out = got.collect()
    assert len(rows_out) == len(rows) and all(r.exact for r in rows_out)
    back = {r.doc_id: r.text for r in sentencepiece.decode_ids(got).collect()}
    assert all(back[i] == (t or "") for i, t in rows)
    odd = spark.createDataFrame([(1, [5_000_000, 13]), (2, None)], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in sentencepiece.decode_ids(odd).collect()} == {1: "⁇ \n", 2: None}


@pytest.mark.parametrize("compression", [tiff.NONE, tiff.LZW, tiff.ADOBE_DEFLATE, tiff.DEFLATE, tiff.PACKBITS])
def test_tiff_round_trips(compression):
    rng = np.random.default_rng(compression)
    for predictor, tile, order, planar, kind, shape in itertools.product((1, 2), (None, (16, 16)), "<>", (1, 2), (np.uint8, np.uint16), ((1, 1), (7, 33), (40, 30, 3))):
        a, b = rng.integers(0, 250, shape).astype(kind), np.zeros(shape, kind)
        got = list(tiff.decode(tiff.encode([a, b], compression, predictor, tile, 16, order, planar)))
        assert len(got) == 2 and (got[0].pixels.reshape(shape) == a).all() and (got[1].pixels.reshape(shape) == b).all()


def test_packing():
    rng = np.random.default_rng(0)
    for n, high in itertools.product((0, 1, 2, 300, 40_000), (2, 256)):
        x = bytes(rng.integers(0, high, n).astype(np.uint8))
        assert tiff.unlzw(tiff.lzw(x)) == x and tiff.unpack_bits(tiff.pack_bits(x)) == x
    assert tiff.unpack_bits(bytes((254, 0xAA, 2, 0x80, 0x00, 0x2A, 253, 0xAA))) == bytes((0xAA,) * 3 + (0x80, 0x00, 0x2A) + (0xAA,) * 4)


def test_tiff_rows(spark):
    page = np.arange(600, dtype=np.uint8).reshape(20, 30)
    good = tiff.encode([page, page[:5]])
    rows = [(1, good), (2, None), (3, b""), (4, b"not a tiff"), (5, good[:-10]), (1, good)]
    got = tiff.tiff_pages(spark.createDataFrame(rows, "id long, media binary"), "id", "media").collect()
    assert sorted((r.key, r.page) for r in got if r.error is None and r.key == 1) == [(1, 0), (1, 0), (1, 1), (1, 1)]
    assert {r.key for r in got if r.error} == {4, 5} and all(bytes(r.pixels) == page.tobytes() for r in got if r.key == 1 and r.page == 0)


def test_media_of_texts(spark):
    import hashlib

    got = {r.doc_id: r for r in tiff.query(spark, SF).collect()}
    for x in pq.read_table(f"{SF}/documents.parquet").to_pylist():
        p, r = tiff.payload((x["text"] or "").encode()), got[x["doc_id"]]
        assert len(p) % 576 == 0 and (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
    assert tiff.payload(b"") == b"\xff" * 576
    long = b"q" * (tiff.ROW_BYTES * tiff.PAGE_ROWS * 2 + 5)
    pages = list(tiff.decode(tiff.store_text(long)))
    assert len(pages) == 3 and b"".join(p.pixels.tobytes() for p in pages) == tiff.payload(long)


def test_free_memory_goes_back_after_each_piece_and_task(monkeypatch):
    import pyarrow as pa

    from weir.llm import _shared, tokenfile

    back = []
    monkeypatch.setattr(_shared, "give_back", lambda: back.append(1), raising=False)
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2, 3], "text": ["a" * 600] * 3})
    assert [b.num_rows for b in _shared.lean_batches(iter([batch]), limit=1000)] == [1, 1, 1] and len(back) == 3
    assert list(_shared.lean_batches(iter([]))) == [] and len(back) == 4

    seen, texts = [], ["word " * 300_000] * 6  # 9 MB

    def encoder(path):
        def encode(column, end):
            seen.append(sum(len(x) for x in column.to_pylist()))
            return np.zeros(len(column), dtype=np.int32), np.arange(len(column) + 1, dtype=np.int32)

        return encode

    class Context:
        @staticmethod
        def get():
            return type("C", (), {"partitionId": lambda self: 0})()

    import pyspark

    monkeypatch.setattr(tokenfile, "_column_encoder", encoder)
    monkeypatch.setattr(pyspark, "TaskContext", Context)
    rows = pa.RecordBatch.from_pydict({"doc_id": list(range(6)), "text": texts})
    got = list(tokenfile._encode("none")(iter([rows])))
    assert sum(b.num_rows for b in got) == 6 and max(seen) <= 4 << 20
