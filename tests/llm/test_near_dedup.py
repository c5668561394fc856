"""Near duplicates against all pairs."""

import random
import re

import numpy as np
import pytest

from arborel.llm import near_dedup
from arborel.llm.near_dedup import most_differing_bits, near_duplicates, shingles, signature


def sets(text, width):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return set()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def brute(rows, width):
    found = {i: sets(t, width) for i, t in rows}
    root = {i: i for i in found}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(found)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            a, b = found[i], found[j]
            if a and b and min(len(a), len(b)) * 100 >= 80 * max(len(a), len(b)):
                both = len(a & b)
                if 100 * both >= 80 * (len(a) + len(b) - both):
                    p, q = sorted((top(i), top(j)))
                    root[q] = p
    return {(i, len(found[i]), top(i), top(i) == i) for i in ids}


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    passage = rng.choices(vocab, k=60)
    texts = [None, "", " \n", "One", "one", "two words", "two  WORDS", "é É", "É é", "nb sp x", "nb sp x", "a b c d e f g h i j k", "a b c d e f g h i j k l"]
    for _ in range(12):
        base = rng.choices(vocab, k=rng.randint(5, 120))
        for _ in range(rng.randint(1, 8)):
            copy = list(base)
            for _ in range(rng.randint(0, 6)):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            texts.append(" ".join(copy))
    chain = rng.choices(vocab, k=100)
    for _ in range(15):
        chain[rng.randrange(100)] = rng.choice(vocab)
        chain[rng.randrange(100)] = rng.choice(vocab)
        texts.append(" ".join(chain))
    texts += [" ".join(passage + rng.choices(vocab, k=rng.randint(4, 40))) for _ in range(150)]
    texts += ["hot copy of the same words again and again"] * 60 + [" ".join(rng.choices(vocab, k=rng.randint(1, 80))) for _ in range(100)]
    rng.shuffle(texts)
    return [(i * 3 + 1, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize(("width", "block"), [(5, 2048), (2, 16)])
def test_against_all_pairs(spark, monkeypatch, width, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rows = corpus(width + block)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, key string, n int").repartition(5)
    got = {tuple(r) for r in near_duplicates(df, width=width).collect()}
    assert got == brute(rows, width)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(df).count() == 0
    df = spark.createDataFrame([(3, None), (4, "")], "doc_id long, text string")
    assert sorted(map(tuple, near_duplicates(df).collect())) == [(3, 0, 3, True), (4, 0, 4, True)]


def test_ids_that_repeat_or_are_null(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(5, a), (5, b), (5, b), (5, ""), (9, a + " more"), (7, b + " more"), (8, c), (None, c), (None, a), (3, c + " x y z u v w q r s t")]
    got = sorted(map(tuple, near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=2).collect()), key=str)
    want = [(5, 29, 5, True), (5, 29, 5, True), (5, 29, 5, True), (5, 0, 5, True), (9, 30, 5, False), (7, 30, 5, False), (8, 29, 8, True), (None, 29, None, True), (None, 29, None, True), (3, 39, 3, True)]
    assert got == sorted(want, key=str)


def test_blocks_of_a_cluster_are_spread(spark, monkeypatch):
    """All blocks of one cluster go to tasks by (cluster, i, j), not by the cluster alone."""
    seen = []
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    write = near_dedup.materialize

    def watch(df, label, *args, **options):
        plan = df._jdf.queryExecution().executedPlan().toString()
        if "FlatMapGroupsInArrow" in plan:
            seen.append(plan)
        return write(df, label, *args, **options)

    monkeypatch.setattr(near_dedup, "materialize", watch)
    df = spark.createDataFrame(corpus(18), "doc_id long, text string")
    near_duplicates(df, width=2).count()
    assert seen
    for plan in seen:
        below = plan[plan.index("FlatMapGroupsInArrow") :]
        first = below[below.index("Exchange") :].split("\n")[0]
        assert "cluster" in first and "i#" in first and "j#" in first


def test_sketches_keep_similar_pairs():
    rng = np.random.default_rng(1)
    most, dropped, passed = most_differing_bits(0.8), 0, 0
    for _ in range(300):
        base = rng.integers(0, 2**63, 270, dtype=np.uint64)
        a, b, c = base[:240], base[30:], np.concatenate([base[:60], rng.integers(0, 2**63, 200, dtype=np.uint64)])
        bits = [np.bitwise_count((signature(a)[1] ^ signature(x)[1]).view(np.uint64)).sum() for x in (b, c)]
        dropped += bits[0] > most
        passed += bits[1] <= most
    assert dropped == 0 and passed == 0
    assert len(shingles("a b a b a b", 2)) == 2
