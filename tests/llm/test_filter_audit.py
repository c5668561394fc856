"""The audit against running every order of the filters on lists of documents."""

import itertools
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from arborel.llm.filter_audit import audit, masked_documents

LONG = " ".join(f"w{i}" for i in range(60))
TEXTS = [None, "", LONG, LONG, LONG + " #", LONG.upper(), "a " * 70, "a\tb\x0b\n" * 40 + "$", "Short", "é" * 99, "ABC\xa0DEF " + LONG, LONG + " x", " " + LONG + "\n", "w " * 20_000 + LONG]


def failures(rows):
    out = []
    for doc_id, text, *_ in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        same = any(i is not None and doc_id is not None and i < doc_id and (o or "") == t for i, o, *_ in rows)
        out.append({"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": same})
    return out


def brute(rows, failed, flags, letters="ABCDE"):
    out, shapley = {}, Counter()
    for order in map("".join, itertools.permutations(letters)):
        for part in {r[2] or "" for r in rows}:
            alive = {i for i, r in enumerate(rows) if (r[2] or "") == part}
            whole = set(alive)
            for step, f in enumerate(order, 1):
                bad = {i for i in whole if failed[i][f]}
                gone = bad & alive
                only = sum(1 for i in bad if sum(failed[i][x] for x in letters) == 1)
                lost = [sum(flags.get(rows[i][0], (0, 0))[j] for i in gone) for j in (0, 1)]
                alive -= bad
                out[part, order, step] = [len(alive), len(gone), len(bad - alive - gone), only, *lost]
                shapley[part, f] += len(gone)
    return {(*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


NAMES = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_all_orders(spark):
    rows = [(i * 7 % 101, t, [None, "", "hot", "hot", "b"][i % 5], "mask", 0) for i, t in enumerate(TEXTS * 4)]
    rows += [(None, LONG, "hot", "m", 1), (None, "x y", None, "m", 1), (500, LONG, "b", "m", 1), (500, LONG, "b", "m", 1)]
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(0, 90, 1)] + [(7, 1, None), (8, None, 1), (None, 1, 1), (500, 1, 1), (9999, 1, 1)]
    flags = {}
    for i, q, t in labels:
        if i is not None:
            old = flags.get(i, (0, 0))
            flags[i] = (max(old[0], q or 0), max(old[1], t or 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, mask string, good int").repartition(3)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = audit(masked_documents(docs, marks), "ABCDE")
    assert got.columns == NAMES
    assert sorted(map(tuple, got.collect())) == sorted(brute(rows, failures(rows), flags))
    assert audit(masked_documents(docs.limit(0), marks), "ABCDE").count() == 0
    none = audit(masked_documents(docs, marks.limit(0)), "ABCDE")
    assert none.where("good_lost + toxic_lost > 0").count() == 0 and none.count() == 3 * 600


@pytest.mark.parametrize("letters", ["X", "XY", "XYZ"])
def test_other_filters(spark, letters):
    rows = [(i, None, "abb"[i % 3]) for i in range(40)]
    failed = [{c: (i * 5 + j) % (j + 3) == 0 for j, c in enumerate(letters)} for i in range(40)]
    masks = [(r[2], sum(1 << j for j, c in enumerate(letters) if f[c]), i % 2 == 0, i % 4 == 0) for i, (r, f) in enumerate(zip(rows, failed, strict=True))]
    df = spark.createDataFrame(masks, "part string, mask int, good boolean, toxic boolean")
    want = brute(rows, failed, {i: (int(i % 2 == 0), int(i % 4 == 0)) for i in range(40)}, letters)
    assert sorted(map(tuple, audit(df, letters).collect())) == sorted(want)


def test_letters(spark):
    df = spark.range(1).select(F.lit("p").alias("part"), F.lit(0).alias("mask"), F.lit(True).alias("good"), F.lit(True).alias("toxic"))
    for letters in ("", "AA", "ABCDEFGH"):
        with pytest.raises(ValueError):
            audit(df, letters)
