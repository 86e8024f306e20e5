import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.llm import packing, queries, tokenfile
from weftline.llm.tokens import Encoder

Tokenizer = pytest.importorskip("tokenizers").Tokenizer

P = pytest.importorskip("public_tokenizers")
BYTES, WORDS = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")
PARTS = ["a", "the", "Word", " ", "  ", "\n", "\n\n", ".", ",", "!", "_", "'s", "9", "é", "\t", "\r", "\0", " . ", "$$$", "İ", "́", "。", "ª", "²", "<|endoftext|>", "\x1c", " "]


@pytest.mark.parametrize(("path", "byte_level"), [(BYTES, True), (WORDS, False)])
def test_encoder_equals_the_tokenizer(path, byte_level, monkeypatch):
    from weftline.llm import tokens

    monkeypatch.setattr(tokens, "CACHE_PIECES", 40)
    e, rng = Encoder(path, byte_level), random.Random(1)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(1, 14))) for _ in range(4000)] + ["word " * 50_000]
    for text, got in zip(texts, e.encode(texts)):
        assert got.tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize(("path", "byte_level"), [(BYTES, True), (WORDS, False)])
def test_a_word_is_encoded_once_with_whatever_signs(path, byte_level):
    e, asked = Encoder(path, byte_level), []
    tokenize = e.tokenize
    e.tokenize = lambda x: asked.append(x) or tokenize(x)
    text = "x schöneheit, schöneheit. schöneheit*** schöneheit%%% schöneheit x\u024f. \u0250x. x\u0250,"
    assert e.encode([text])[0].tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids
    assert sum("heit" in x for x in asked) == 1


SPECIAL = ["<|endoftext|>", "end <|endoftext|> next", "<|endoftext|><|endoftext|>", "a<|startoftext|>b", "<|ENDOFTEXT|> x", " <|endoftext|>", "<|endoftext|>\n", "<|endoftext", "x <|startoftext|> <|endoftext|> y" * 50]


@pytest.mark.parametrize(("path", "byte_level"), [(BYTES, True), (WORDS, False)])
def test_added_tokens_in_texts_are_as_in_the_library(path, byte_level, docs):
    """Against a tokenizer of its own, as loaded, without any setting."""
    fresh, e, rng = Tokenizer.from_file(path), Encoder(path, byte_level), random.Random(3)
    texts = SPECIAL + ["".join(rng.choice(PARTS + SPECIAL[:1]) for _ in range(rng.randint(1, 14))) for _ in range(2000)]
    assert e.fast
    want = [fresh.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in e.encode(texts)] == want
    rows = list(enumerate(SPECIAL))
    got = packing.token_pieces(docs(rows), path, byte_level=byte_level).collect()
    assert sum(r.length for r in got) == sum(len(w) + 1 for w in want[:len(SPECIAL)])
    files = {r.doc_id: r.n_tokens for r in tokenfile.token_table(docs(rows), path, byte_level=byte_level).collect()}
    assert files == {i: len(want[i]) + 1 for i, _ in rows}


def test_files_of_another_kind_go_through_the_library():
    e, fresh = Encoder(WORDS, True), Tokenizer.from_file(WORDS)  # the kind that this file is not
    assert not e.fast
    for t in ["Some  words\nand more", "x" * 5000, "<|endoftext|> é"]:
        assert np.frombuffer(e.encoded(t), e.dtype).tolist() == fresh.encode(t, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=700), max_size=6))
def test_file_round_trip(docs):
    ids = [np.array(d, np.uint32) for d in docs]
    r = tokenfile.Reader(tokenfile.to_bytes(list(range(len(ids))), ids))
    assert (r.n_docs, r.n_ids) == (len(ids), sum(map(len, ids)))
    for i in range(len(ids)):
        assert r.ids(i, i + 1).tolist() == docs[i]
    assert r.ids(0, len(ids)).tolist() == [x for d in docs for x in d]


def test_blocks_have_exceptions():
    ids = np.full(256, 7, np.uint32)
    ids[[3, 99]] = 2**31
    start, buf = tokenfile.encode_blocks(ids)
    assert (buf[4], buf[5], len(buf)) == (0, 2, 6 + 2 * 5)
    assert (tokenfile.decode_blocks(start, buf) == ids).all()


def want_tokens(rows):
    t, out, at = Encoder(BYTES, True).tokenizer, [], 0
    for i, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((-(1 << 63) if i is None else i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_token_files(clashing, docs, monkeypatch):
    monkeypatch.setattr(tokenfile, "FILE_IDS", 50)
    rows = [(i * 7 % 40, f"some text number {i}\n" * (i % 5)) for i in range(40)] + [(90, None), (91, ""), (92, "long " * 40_000), (None, "no id")]
    got = sorted(map(tuple, tokenfile.token_table(clashing(rows), BYTES).collect()), key=lambda r: r[1])
    assert got == want_tokens(rows)
    assert tokenfile.token_table(docs([]), BYTES).collect() == []
    twice = tokenfile.token_table(docs([(1, "a"), (1, "a")]), BYTES).collect()
    assert sorted((r.doc_id, r.start, r.n_tokens) for r in twice) == [(1, 0, 2), (1, 2, 2)]


@pytest.mark.parametrize("hot", [7, None])
def test_rows_of_one_id_are_dealt_over_tasks(spark, docs, hot):
    rows = [(hot, f"text {i}") for i in range(10_000)]
    folder = f"{spark.conf.get('spark.checkpoint.dir')}/hot-{hot}"
    manifest = tokenfile.write_tokens(docs(rows), BYTES, folder, end_id=2)
    parts = [r.n_docs for r in manifest.collect()]
    assert sum(parts) == 10_000 and len(parts) > 2 and max(parts) < 5_000
    got = tokenfile.read_tokens(manifest).collect()
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    want = {zlib.crc32(np.array([*Tokenizer.from_file(BYTES).encode("text 5").ids, 2], "<u4").tobytes())}
    assert want <= {r.ids_crc32 for r in got} and len(got) == 10_000


def test_token_files_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in queries.documents(spark, sf).collect()]
    assert sorted(map(tuple, queries.op8_token_files(spark, sf).collect()), key=lambda r: r[1]) == want_tokens(rows)


def check_packing(rows, got, capacity=2048):
    t, bins = Encoder(WORDS, False).tokenizer, {}
    by_doc = {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, x in rows:
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4")
        own = sorted(by_doc[i], key=lambda r: r.piece)
        want = [(k, k * capacity, ids[k * capacity:(k + 1) * capacity]) for k in range(-(-len(ids) // capacity))]
        assert [(r.piece, r.start, r.length, r.ids_crc32) for r in own] == [(k, s, len(p), zlib.crc32(p.tobytes())) for k, s, p in want]
    total = 0
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
        total += at
    return len(bins), -(-total // capacity)


def test_packing(clashing, docs):
    rows = [(i, "word " * (i * 37 % 900)) for i in range(200)] + [(900, None), (901, ""), (902, "long text " * 9000), (903, "x " * 2047), (904, "x " * 2048)]
    n, least = check_packing(rows, packing.sequences(clashing(rows), WORDS).collect())
    assert n <= least + 2
    assert packing.sequences(docs([]), WORDS).collect() == []
    twice = packing.sequences(docs([(1, "a b"), (1, "a b"), (None, "c")]), WORDS).collect()
    assert sorted((r.doc_id is None, r.offset) for r in twice) == [(False, 0), (False, 3), (True, 6)] or len({(r.sequence_id, r.offset) for r in twice}) == 3


def test_bins_that_cannot_be_joined(spark):
    """Pieces of over half a sequence stay alone, whatever the rounds."""
    p = spark.createDataFrame([(i, 0, 0, 1100 + i % 7, 0) for i in range(100)], "doc_id long, piece int, start long, length long, ids_crc32 long").repartition(8)
    out = packing.pack(p).collect()
    assert len({r.sequence_id for r in out}) == 100 and {r.offset for r in out} == {0}


def test_rounds_join_what_partitions_leave(spark):
    p = spark.createDataFrame([(i, 0, 0, 700, 0) for i in range(32)], "doc_id long, piece int, start long, length long, ids_crc32 long").repartition(32)
    assert len({r.sequence_id for r in packing.pack(p).collect()}) == 16


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def plain_best_fit(lengths, capacity):
    """Best-fit decreasing, bin by bin: how many bins it takes."""
    free = []
    for n in sorted(lengths, reverse=True):
        fits = [(r, i) for i, r in enumerate(free) if r >= n]
        if fits:
            free[min(fits)[1]] -= n
        else:
            free.append(capacity - n)
    return len(free)


def test_best_fit_against_a_plain_version():
    rng = np.random.default_rng(6)
    for n, top in ((0, 9), (1, 9), (500, 2048), (500, 300), (800, 1200)):
        length = rng.integers(1, top + 1, n)
        where, offset, fill = packing.best_fit(length, 2048)
        assert len(fill) == plain_best_fit(length.tolist(), 2048)
        for b in range(len(fill)):
            own = np.flatnonzero(where == b)
            own = own[np.argsort(offset[own])]
            assert offset[own].tolist() == [0, *np.cumsum(length[own])[:-1].tolist()] and length[own].sum() == fill[b] <= 2048


@pytest.mark.parametrize("items", [500_000, 300])
def test_rounds_against_best_fit_of_all(spark, monkeypatch, items):
    """Few items a task, over many partitions: within one in a hundred of best-fit over all of them."""
    monkeypatch.setattr(packing, "ITEMS", items)
    rng = np.random.default_rng(7)
    length = np.concatenate([rng.integers(1, 900, 6000), rng.integers(900, 2049, 2000), np.full(2000, 3)])
    p = spark.createDataFrame([(i, 0, 0, n, 0) for i, n in enumerate(length.tolist())], PIECES).repartition(64)
    got = packing.pack(p).collect()
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048
    assert len(got) == len(length) and len(bins) <= 1.01 * plain_best_fit(length.tolist(), 2048)


def test_packing_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in queries.documents(spark, sf).collect()]
    n, least = check_packing(rows, queries.op7_best_fit_packing(spark, sf).collect())
    assert n <= least * 1.02 + 1
