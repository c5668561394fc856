"""Token counts, token files and packing against the library itself."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from arborel.llm.encode import Encoder
from arborel.llm.packing import Packer, pack_documents
from arborel.llm.token_count import Counter, token_counts
from arborel.llm.token_store import Reader, Writer, read_store, write_store

ODD = ["", None, " ", "  ", "a", " a", "a ", "a  b", "a   b", "x\n y", "x \ny", "x\n \ny", "x\n\n y", "a\t b", "  lead", "tail \n", "don't you're I'LL", "naïve Éa ß straße", "１２３ ²½ x", "漢字 かな 🙂 é é", "<|endoftext|>", "hi <|endoftext|> there", "hi <|startoftext|>x", "a<|endoftext|>b", "a b  c", "\x1c \x1f x", "word " * 500, "abc" * 4000, "12345 678.90", "ΣΑΣ Σ", "​ x ﻿"]
WORDS = ["the", "of", "thanedble", "êeux***", "In.", "and,\nThe", "#12", "\n", "", "\t", "ß", "'s", "x'll", "…"]


def library(name, texts, **more):
    tok = Tokenizer.from_file(P.path(name))
    return [e.ids for e in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def mixed(seed, n=300):
    rng = random.Random(seed)
    return [" ".join(rng.choices(WORDS, k=rng.randint(0, 30))) for _ in range(n)] + [t or "" for t in ODD]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@pytest.mark.parametrize("memo", [400_000, 20])
def test_encoder_is_the_library(name, memo):
    coder = Encoder(P.path(name), memo)
    for seed in range(4):
        texts = mixed(seed)
        assert [list(map(int, x)) for x in coder.encode(texts)] == library(name, texts)


def test_counter_is_the_library():
    for name in ["byte_bpe_50k.json", "word_bpe_49k.json"]:
        assert Counter(P.path(name)).count(mixed(9)) == [len(x) for x in library(name, mixed(9))]
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    assert Counter(P.path("piece_bpe_32k.model")).count(mixed(3)) == [len(model.encode(t)) for t in mixed(3)]


def test_proven_table_holds_single_tokens_only():
    counter = Counter(P.path("byte_bpe_50k.json"))
    assert 40_000 < len(counter.proven) < 50_257 and counter.proven[" the"] == 1 and "thanedble" not in counter.proven


def frame(spark, texts, extra=""):
    rows = [(i * 3 + 5, t, 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens int").repartition(3)


def test_token_counts(spark):
    rows = {r.doc_id: r for r in token_counts(frame(spark, ODD), P.path("byte_bpe_50k.json"), limit=100).collect()}
    for i, (t, ids) in enumerate(zip(ODD, library("byte_bpe_50k.json", ODD))):
        r = rows[i * 3 + 5]
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((t or "").encode()), len(ids), len(ids) > 100)
    assert token_counts(frame(spark, []), P.path("byte_bpe_50k.json")).count() == 0


def test_store_round_trip(spark, tmp_path):
    texts = ODD + mixed(1)
    want = [np.array([*ids, 2], dtype="<u4") for ids in library("word_bpe_49k.json", texts)]
    files = write_store(frame(spark, texts), P.path("word_bpe_49k.json"), str(tmp_path / "a"), end_id=2)
    rows = sorted(read_store(files).collect())
    start = 0
    for i, (row, ids) in enumerate(zip(rows, want, strict=True)):
        assert tuple(row) == (i * 3 + 5, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    empty = write_store(frame(spark, []), P.path("word_bpe_49k.json"), str(tmp_path / "b"), end_id=2)
    assert read_store(empty).count() == 0


def test_store_keeps_null_ids(spark, tmp_path):
    rows = [(None, "one two"), (0, "three"), (None, None), (-5, "four five"), (7, ""), (None, "one two")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    files = write_store(df, P.path("word_bpe_49k.json"), str(tmp_path / "n"), end_id=2)
    codec = Encoder(P.path("word_bpe_49k.json"))
    want = sorted((i is not None, i or 0, [*codec.encode([t or ""])[0].tolist(), 2]) for i, t in rows)
    got = []
    for f in files.orderBy("file_no").collect():
        reader = Reader(f.path)
        part = [(i, tokens.tolist()) for i, tokens in reader]
        assert [(i, t.tolist()) for i, t in reader.read([None])] == [p for p in part if p[0] is None]
        assert [(i, t.tolist()) for i, t in reader.read(iter([0]))] == [p for p in part if p[0] == 0]
        got += part
    assert [i for i, _ in got] == [None, None, None, -5, 0, 7]
    assert sorted((i is not None, i or 0, t) for i, t in got) == want
    listed = read_store(files).orderBy("start").collect()
    assert [r.doc_id for r in listed] == [None, None, None, -5, 0, 7] and [r.n_tokens for r in listed] == [len(t) for _, t in got]


def test_reader_takes_only_needed_frames_and_checks_them(tmp_path):
    import zstandard

    path = str(tmp_path / "one.zst")
    writer, docs = Writer(path), {}
    rng = np.random.default_rng(0)
    for i in range(50):
        docs[i] = rng.integers(0, 49_000, 200_000 if i == 20 else 5_000, dtype=np.uint32)
        writer.add(i, docs[i])
    writer.close()
    reader = Reader(path)
    [(got, ids)] = reader.read([49])
    assert got == 49 and (ids == docs[49]).all() and reader.frames_read <= 2 < len(reader.table)
    assert all((docs[i] == ids).all() for i, ids in Reader(path))
    raw = zstandard.ZstdDecompressor().stream_reader(open(path, "rb"), read_across_frames=True).read(4 * 450_000)
    assert raw == b"".join(docs[i].tobytes() for i in range(50))[: len(raw)]
    spoilt = bytearray(open(path, "rb").read())
    spoilt[2000] ^= 1
    open(path, "wb").write(spoilt)
    with pytest.raises(Exception):
        list(Reader(path))


def check_pieces(rows, want, limit):
    docs, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r["doc_id"]].append(r)
        seqs[r["sequence_id"]].append(r)
    assert set(docs) == set(want)
    for i, ps in docs.items():
        at = 0
        for p in sorted(ps, key=lambda p: p["start"]):
            assert p["start"] == at and p["length"] > 0 and p["doc_tokens"] == len(want[i])
            assert p["ids_crc32"] == zlib.crc32(want[i][at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(want[i])
    for ps in seqs.values():
        at = 0
        for p in sorted(ps, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= limit
    return seqs


def test_packing(spark):
    texts = ODD + mixed(2) + ["thanedble of the " * k for k in (1, 50, 700, 3000)]
    want = {i * 3 + 5: np.array([*ids, 1], dtype="<u4") for i, ids in enumerate(library("byte_bpe_50k.json", texts))}
    rows = pack_documents(frame(spark, texts).coalesce(1), P.path("byte_bpe_50k.json"), 1, max_tokens=256).collect()
    seqs = check_pieces([r.asDict() for r in rows], want, 256)
    total = sum(map(len, want.values()))
    assert len(seqs) * 256 <= total * 1.05 + 256
    assert pack_documents(frame(spark, []), P.path("byte_bpe_50k.json"), 1).count() == 0


def test_packing_limits_and_null_ids(spark):
    path = P.path("byte_bpe_50k.json")
    df = spark.createDataFrame([(i if i else None, "a b", 2) for i in range(300)] + [(1000, "w " * 500, 400)], "doc_id long, text string, prompt int").coalesce(1)
    rows = pack_documents(df, path, 1, max_tokens=256, max_segments=16, max_loss=128, prompt_tokens_col="prompt").collect()
    assert sum(r.doc_id is None for r in rows) == 1 and len({r.doc_id for r in rows}) == 301
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append(r)
    assert max(len(v) for v in by.values()) == 16 and all(sum(r.length for r in v) <= 256 and sum(r.loss_tokens for r in v) <= 128 for v in by.values())
    for bad in ({"max_loss": 0}, {"max_segments": 0}, {"max_tokens": 0}):
        with pytest.raises(ValueError):
            pack_documents(df, path, 1, **bad)


def test_packer_keeps_all_limits():
    rng = random.Random(5)
    for max_segments, max_loss in ((4, 100), (100, 60), (2, 20)):
        packer = Packer(100, max_segments, max_loss)
        items = [(rng.randint(1, 400), rng.randint(0, 80)) for _ in range(3000)]
        for k, (n, prompt) in enumerate(items):
            packer.add(k, 0, n, prompt)
        packer.finish()
        seqs, docs = defaultdict(list), defaultdict(int)
        for k, start, take, seq, offset in packer.out:
            seqs[seq].append((take, Packer._loss(start, take, items[k][1], take)))
            docs[k] += take
        assert [docs[k] for k in range(3000)] == [n for n, _ in items]
        assert all(sum(t for t, _ in s) <= 100 and len(s) <= max_segments and sum(x for _, x in s) <= max_loss for s in seqs.values())
