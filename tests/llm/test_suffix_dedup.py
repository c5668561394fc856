"""Substring removal against a plain scan of all windows."""

import hashlib
import random

import numpy as np
import pytest

from arborel.llm import suffix_dedup as S


def brute(rows):
    seen, marks = {}, {}
    for i, t in sorted(rows):
        raw = (t or "").encode()
        mark = bytearray(len(raw))
        for p in range(len(raw) - 99):
            if seen.setdefault(raw[p : p + 100], (i, p)) != (i, p):
                mark[p : p + 100] = b"\1" * 100
        marks[i] = (raw, mark)
    out = {}
    for i, (raw, mark) in marks.items():
        kept = bytes(b for b, m in zip(raw, mark) if not m)
        spans = sum(m and not (k and mark[k - 1]) for k, m in enumerate(mark))
        out[i] = (i, len(raw), sum(mark), spans, hashlib.sha256(kept).hexdigest())
    return out


def corpus(seed):
    rng = random.Random(seed)
    vocab = ["the", "of", "thanedble", "êeux", "and,", "ß", "in", "onsh", "re"] + ["w%d" % i for i in range(60)]
    say = lambda n: " ".join(rng.choices(vocab, k=n))
    passage, line = say(40), say(25)
    texts = [None, "", "short", "a" * 99, "a" * 100, "a" * 101, "a" * 1500, "ab" * 300, "\0" * 250, "é" * 200]
    base = [say(rng.randint(5, 300)) for _ in range(15)]
    texts += base + base[:4] + base[:2]
    for b in base:
        w = b.split()
        for _ in range(max(1, len(w) // 30)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        texts.append(" ".join(w))
    texts += [say(rng.randint(0, 30)) + "\n" + passage + " " + say(rng.randint(0, 30)) for _ in range(40)]
    texts += [say(rng.randint(0, 8)) + "\n" + line + "\n" + say(rng.randint(0, 8)) for _ in range(40)]
    texts += [passage[rng.randint(0, 60) :][: rng.randint(95, 160)] for _ in range(30)] + ["hot copy " * 30] * 20
    rng.shuffle(texts)
    return [(i * 7 % 4001, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize(("seed", "block", "shard", "held"), [(1, 1 << 20, 1 << 22, 1 << 20), (2, 400, 3000, 50)])
def test_against_scan(spark, monkeypatch, seed, block, shard, held):
    monkeypatch.setattr(S, "BLOCK", block)
    monkeypatch.setattr(S, "SHARD", shard)
    monkeypatch.setattr(S, "HELD_ROWS", held)
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, low string, windows int").repartition(4)
    want = brute(rows)
    got = {r.doc_id: r for r in S.substring_dedup(df).collect()}
    assert {i: tuple(r)[:5] for i, r in got.items()} == want
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 and sum(s.end - s.start for s in r.spans) == r.n_removed for r in got.values())
    assert sum(n for _, _, n, *_ in want.values()) > 5000


def test_null_ids(spark):
    rows = corpus(3)
    long = [t for _, t in rows if t and len(t.encode()) >= 300]
    rng = random.Random(4)
    odd = ["".join(rng.choices("abcdefgh ", k=400)) for _ in range(3)]
    unnamed = [long[0], long[1][50:], odd[0], odd[0], odd[0], odd[1] + long[2], odd[1] + long[3], "a" * 99, "a" * 99, "", None, None]
    spare = [10_000 + i for i in range(len(unnamed))]
    unnamed.sort(key=lambda t: hashlib.md5((t or "").encode()).hexdigest())
    want = brute(rows + list(zip(spare, unnamed, strict=True)))
    want = sorted(w if w[0] < 10_000 else (-1, *w[1:]) for w in want.values())
    df = spark.createDataFrame(rows + [(None, t) for t in unnamed], "doc_id long, text string")
    for n in (1, 5):
        got = S.substring_dedup(df.repartition(n), with_text=False).collect()
        assert sorted((-1 if r.doc_id is None else r.doc_id, *r[1:]) for r in got) == want


def test_suffix_arrays_decide(spark, monkeypatch):
    """One shard, no merge: what the suffix array says is all that goes."""
    monkeypatch.setattr(S, "SHARD", 1 << 30)
    monkeypatch.setattr(S, "merge_runs", lambda left, right: (np.concatenate([left, right]), left[:0]))
    rows = corpus(5)
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        got = {r.doc_id: tuple(r) for r in S.substring_dedup(df, with_text=False).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == brute(rows)


def test_merge_in_any_order():
    rng = np.random.default_rng(6)
    runs = []
    for i in range(37):
        run = np.zeros(rng.integers(1, 60), dtype=S.RUN)
        run["a"] = np.sort(rng.choice(400, len(run), replace=False))
        run["doc"], run["start"], run["windows"] = rng.integers(0, 50, len(run)), i, 1
        runs.append(run)
    everything = np.concatenate(runs)
    best = {}
    for r in everything:
        best[r["a"]] = min(best.get(r["a"], (1 << 40, 0)), (r["doc"], r["start"]))
    want = sorted((r["a"], r["doc"], r["start"]) for r in everything if (r["doc"], r["start"]) != best[r["a"]])
    assert sorted((r["a"], r["doc"], r["start"]) for g in S.merge_all(iter(runs)) for r in g) == want


def test_repeated_ids(spark):
    a, b = ("".join(random.Random(k).choices("abcdefgh ", k=400)) for k in (1, 2))
    rows = [(1, a), (1, a), (2, a), (2, "short"), (3, b), (3, b[:150]), (4, b)]
    got = S.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), with_text=False).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed) for r in got) == [(1, 400, 0), (1, 400, 0), (2, 5, 0), (2, 400, 400), (3, 150, 0), (3, 400, 0), (4, 400, 400)]


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert S.substring_dedup(df).count() == 0


@pytest.mark.parametrize("text", [b"", b"a", b"banana", b"a" * 300, b"ab" * 200 + b"a", b"\0\0\0a\0\0", bytes(range(256)) * 3])
def test_suffix_array_and_prefixes(text):
    data = np.frombuffer(text, dtype=np.uint8)
    order = S.suffix_array(data)
    assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
    shared = S.common_prefixes(data, order, cap=100).tolist()
    for j in range(len(text)):
        a, b = (text[order[j] :], text[order[j - 1] :]) if j else (b"", b"")
        n = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert shared[j] == min(n, 100)


def test_suffix_array_random():
    rng = np.random.default_rng(2)
    for alphabet in (2, 4, 256):
        data = rng.integers(0, alphabet, 3000).astype(np.uint8)
        text = data.tobytes()
        assert S.suffix_array(data).tolist() == sorted(range(3000), key=lambda i: text[i:])
