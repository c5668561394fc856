"""Language identification against a plain coder, and its accuracy on rows held out."""

import math
import os
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborel.llm.language_id import Model, Tree, gram_counts, identify, learn, learned_trees, op13_language_id, tree_costs

DATA = "/root/testdata/sf0.01"
TRAIN = [("a", "banana bandana an nab"), ("a", "cabana"), ("b", "über öl und süße düfte"), ("b", "ß"), ("c", "xyz xyzzy \x00\xff"), (None, "never seen"), ("d", ""), ("hot", "to be or not to be")] + [("hot", "to be")] * 60


def plain_tree(texts, order):
    tree = defaultdict(Counter)
    for t in texts:
        raw = t.encode()
        for i in range(len(raw)):
            for size in range(min(order, i) + 1):
                tree[raw[i - size : i]][raw[i]] += 1
    return tree


def plain_bits(tree, raw, order):
    """Code one byte after another, with exclusions, as the textbook has it."""
    total = 0.0
    for i, b in enumerate(raw):
        size = min(order, i)
        while raw[i - size : i] not in tree:
            size -= 1
        gone = set()
        while True:
            seen = {x: n for x, n in tree[raw[i - size : i]].items() if x not in gone}
            whole = sum(seen.values()) + len(seen)
            if b in seen:
                total -= math.log2(seen[b] / whole)
                break
            if seen:
                total -= math.log2(len(seen) / whole)
            gone |= set(seen)
            if size == 0:
                total += math.log2(256 - len(gone))
                break
            size -= 1
    return total


def plain_model(order=3):
    texts = defaultdict(list)
    for lang, t in TRAIN:
        if lang and t:
            texts[lang].append(t)
    return {lang: plain_tree(ts, order) for lang, ts in sorted(texts.items())}


@pytest.mark.parametrize("order", [0, 1, 3])
def test_against_plain_coder(spark, order):
    df = spark.createDataFrame(TRAIN, "lang string, text string").repartition(3)
    trees = learned_trees(df, order)
    want = plain_model(order)
    assert [t.lang for t in trees] == list(want)
    for tree in trees:
        assert {c: {b: int(n) for b, n in enumerate(v) if n} for c, v in tree.counts.items()} == {c: dict(v) for c, v in want[tree.lang].items()}
    model = Model.of(trees, order)
    texts = ["", "banana", "to be über", "\x07 new bytes 中", "xyz\xff", "n", "süß" * 400]
    got = model.code_lengths([t.encode() for t in texts])
    for row, t in zip(got, texts, strict=True):
        assert row == pytest.approx([plain_bits(want[lang], t.encode(), order) for lang in want], rel=1e-5, abs=1e-5)


def test_chances_add_up():
    for tree in plain_model().values():
        counts = {c: np.array([v.get(b, 0) for b in range(256)], dtype=float) for c, v in tree.items()}
        for cost in tree_costs(Tree("x", counts)).values():
            assert np.exp2(-cost[:256]).sum() == pytest.approx(1)


def test_bounded_trees_stay_whole(spark):
    df = spark.createDataFrame(TRAIN * 3, "lang string, text string")
    full = {t.lang: t for t in learned_trees(df)}
    for most in (1, 40, 120):
        for tree in learned_trees(df, most_contexts=most):
            assert b"" in tree.counts and len(tree.counts) <= max(1, most // 4)
            assert all(c[1:] in tree.counts and c[:-1] in tree.counts for c in tree.counts if c)
            assert all((n == full[tree.lang].counts[c]).all() for c, n in tree.counts.items())


def test_grams_merge_alike(spark, monkeypatch):
    df = spark.createDataFrame([t for t in TRAIN if t[0]], "lang string, text string")
    one = Counter({(r.lang, r.gram): r.n for r in gram_counts(df.coalesce(1)).collect()})
    assert one == Counter({(r.lang, r.gram): r.n for r in gram_counts(df.repartition(7)).collect()})


def test_identify_cases(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "12 34 !?", "b"), (4, "banana", "c"), (5, "über", None), (None, "to be", "hot"), (7, "中", "a"), (7, "中", "a"), (8, "be " * 90_000, "x")]
    docs = spark.createDataFrame([(r[0], r[1], r[2], "z", 0.5) for r in rows], "doc_id long, text string, lang string, lang_pred string, score double")
    trained = spark.createDataFrame([(10 * i, t, lang) for i, (lang, t) in enumerate(TRAIN)], "doc_id long, text string, lang string")
    model = learn(trained)
    held = {i for i in range(0, 10 * len(TRAIN), 10) if zlib.crc32(str(i).encode()) % 4 == 2}
    assert held and set(model.langs) <= {"a", "b", "c", "hot"}
    got = Counter(tuple(r)[:2] for r in identify(docs, model).collect())
    first = model.langs[0]
    for i in (1, 2, 3):
        assert got[i, "und"] == 1
    assert got[None, "hot"] == 1 and got[8, "hot"] == 1 and sum(n for (i, _), n in got.items() if i == 7) == 2 and first
    assert all(0 <= r.score <= 1 and (r.lang_pred == "und") == (r.score == 0) for r in identify(docs, model).collect())
    assert identify(docs.limit(0), model).count() == 0
    assert learn(trained.limit(0)) is None and learn(trained.withColumn("lang", F.lit(None).cast("string"))) is None
    assert {r.lang_pred for r in identify(docs, None).collect()} == {"und"} and identify(docs, None).count() == len(rows)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = op13_language_id(spark, DATA)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"] and got.count() == docs.count()
    held = got.join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null and lang_pred <> 'und'").collect()
    assert len(held) > 100 and sum(r.lang == r.lang_pred for r in held) >= 0.99 * len(held)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got.collect())
