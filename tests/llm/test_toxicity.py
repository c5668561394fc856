"""Toxicity: held-out accuracy, calibration and edge cases."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborel.llm import toxicity as T
from arborel.llm.toxicity import FEATURES, Boosted, Featurizer, fit, isotonic, op7_toxicity, scores

DATA = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
def test_held_out_accuracy(spark):
    rows = op7_toxicity(spark, DATA).join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id").where("held_out").toPandas()
    caught = rows[rows.toxic == 1].predicted.mean()
    wrong = rows[rows.toxic == 0].predicted.mean()
    pos, neg = rows[rows.toxic == 1].score.to_numpy(), rows[rows.toxic == 0].score.to_numpy()
    auc = ((pos[:, None] > neg).mean() + (pos[:, None] == neg).mean() / 2)
    assert caught >= 0.6 and wrong <= 0.05 and auc >= 0.85


def test_edge_texts_and_columns(spark):
    rows = [(i, t, i % 2, "k") for i, t in enumerate([None, "", " ", "you idiot " * 50, "m0r0n id!ot " * 30, "x" * 200_000, "fine words here", "fine words here"])]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int, score string")
    docs = spark.createDataFrame([(i, "you stupid clown " + "so it goes " * (i % 7) if i % 4 == 0 else "so it goes then " * (i % 9)) for i in range(400)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("toxic"))
    model = fit(docs, labels, lambda c: c % 5 != 0)
    out = {r.doc_id: r for r in scores(df, model).collect()}
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out.values())
    assert out[3].predicted == 1 and out[0].predicted == out[1].predicted == out[6].predicted == 0
    assert out[0].score == out[1].score and out[6].score == out[7].score
    assert scores(df.limit(0), model).count() == 0
    one = fit(docs, labels.where("toxic = 0"), lambda c: c >= 0)
    assert {r.score for r in scores(df, one).collect()} == {0.0}
    assert scores(df, fit(docs.limit(0), labels.limit(0), lambda c: c >= 0)).count() == len(rows)


def test_trees_and_isotonic_against_plain_rules():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 5))
    y = ((x[:, 0] > 0.6) & (x[:, 3] < 0.5)).astype(float)
    raw = Boosted().fit(x[:1500], y[:1500]).predict(x[1500:])
    assert ((raw > 0) == y[1500:]).mean() > 0.97
    knots, levels = isotonic(raw, y[1500:])
    assert (np.diff(knots) > 0).all() and (np.diff(levels) >= 0).all()


def test_features_see_obfuscation():
    row = Featurizer({})(["plain words", "you 1d10t m.o.r.o.n"])
    assert row[0, -1] == 0 and row[1, -1] > 0.5 and row[1, FEATURES.index('near_person')] == 1


def plain_features(text, lexicon):
    """FEATURES token by token, straight from their descriptions."""
    tokens = text.split()
    if not tokens:
        return [0.0] * len(FEATURES)
    marks = []
    for t in tokens:
        w = t
        while w and not w[0].isalnum():
            w = w[1:]
        while w and not w[-1].isalnum():
            w = w[:-1]
        w = w.lower()
        letters = [c for c in t if c.isalpha()]
        weight = lexicon.get(w, 0.0)
        stem = max([0.0] + [lexicon.get(w[:n] + "*", 0.0) for n in T.STEMS if len(w) > n])
        seed, hidden = w in T.SEED_WORDS, False
        if not seed and weight <= 0 and 1 < len(letters) < len(t):
            read = "".join(c for c in t.rstrip(".,!?;:").lower().translate(T.LOOKALIKE) if c.isalpha())
            hidden = read != w and (read in T.SEED_WORDS or lexicon.get(read, 0.0) > 0)
        odd = len(letters) > 1 and any(not c.isalpha() and c not in "'’-" for c in w)
        strength = max(weight, stem) + (3 if (hidden or seed) and weight == 0 else 0)
        marks.append({"t": t, "seed": seed, "weight": weight, "stem": stem, "hidden": hidden, "odd": odd, "hit": seed or weight > 0 or stem > 0 or hidden, "strength": strength, "person": w in T.SECOND_PERSON, "letters": len(letters)})
    n, hits = len(tokens), [i for i, m in enumerate(marks) if m["hit"]]
    people = [i for i, m in enumerate(marks) if m["person"]]
    upper, letters = sum(c.isupper() for t in tokens for c in t), sum(m["letters"] for m in marks)
    punct = sum(not c.isalnum() for t in tokens for c in t)
    windows = [sum(m["hit"] for m in marks[i : i + T.SPAN]) for i in range(max(1, n - T.SPAN + 1))]
    near = np.mean([any(abs(p - h) <= T.NEAR for p in people) for h in hits]) if hits and people else 0.0
    share = lambda test: sum(map(test, marks)) / n
    return [
        share(lambda m: m["seed"]), share(lambda m: m["weight"] > 0 or m["hidden"]), share(lambda m: m["stem"] > 0), np.log1p(len(hits)), np.log1p(len({marks[h]["t"] for h in hits})),
        share(lambda m: m["strength"]), max(m["strength"] for m in marks), max(windows), near, share(lambda m: m["person"]), upper / max(1, letters),
        share(lambda m: m["letters"] > 1 and m["t"].upper() == m["t"]), sum(t.count("!") for t in tokens) / max(1, letters + punct), punct / max(1, letters + punct), share(lambda m: m["odd"]), share(lambda m: m["hidden"]),
    ]


def plain_score(x, model):
    """Each tree walked from its root, then the calibration curve between its knots."""
    raw = model.boosted.base
    for feature, cut, values in model.boosted.trees:
        node = 0
        while node < len(feature):
            edges = model.boosted.edges[feature[node]]
            node = 2 * node + (2 if sum(e <= x[feature[node]] for e in edges) > cut[node] else 1)
        raw += values[node - len(feature)]
    if not any(x):
        raw = model.knots[0]
    k = sum(knot <= raw for knot in model.knots)
    if k in (0, len(model.knots)):
        level = model.levels[min(k, len(model.knots) - 1)] if k == 0 else model.levels[-1]
    else:
        low, high = model.knots[k - 1], model.knots[k]
        level = model.levels[k - 1] + (raw - low) / (high - low) * (model.levels[k] - model.levels[k - 1])
    return min(1.0, max(0.0, 0.999 * level + 0.001 / (1 + np.exp(-raw))))


def test_every_score_against_a_plain_scorer(spark):
    rng = random.Random(3)
    words = "you the of idiot STUPID m0r0n cl.own Fine, well! ... don't übel ÜBEL x2 thanedble so it goes clowning u tu 12 !! a".split()
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(0, 120)) + (["you", "clown", "grobble"] * rng.randint(1, 3) if i % 3 == 0 else []))) for i in range(500)]
    docs += [(900, None), (901, ""), (902, "plain words only"), (903, "clown " * 3000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    labels = df.where("doc_id < 500").select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))
    model = fit(df, labels, lambda c: c % 4 != 1)
    assert model.boosted is not None and "grobble" in model.lexicon
    got = {r.doc_id: r for r in scores(df, model).collect()}
    for i, text in docs:
        want = plain_score([float(np.float64(v)) for v in plain_features(text or "", {t: float(np.float32(w)) for t, w in model.lexicon.items()})], model)
        assert got[i].score == pytest.approx(want, abs=1e-9) and got[i].predicted == int(got[i].score >= T.THRESHOLD)
