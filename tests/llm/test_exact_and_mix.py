"""Exact dedup and mixing against brute force."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from arborel.llm.exact_dedup import exact_duplicates
from arborel.llm.mixing import mix, mixed_documents, source_targets

TEXTS = ["a b", "a b", None, "", "a  b", "a b ", "é", "é", "x" * 50_000, "x" * 50_000, "A b"] + ["hot"] * 300


@pytest.mark.parametrize("keep", ["min", "max"])
def test_exact(spark, keep):
    rows = [(i * 7 % 1009, t, "run", i) for i, t in enumerate(TEXTS)] + [(5000, "twice", "x", 0), (5000, "twice", "x", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _run string, n_bytes int").repartition(5)
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[t or ""].append(i)
    want = Counter()
    for t, ids in groups.items():
        k = (min if keep == "min" else max)(ids)
        want.update((i, k, len(ids), i == k, hashlib.sha256(t.encode()).hexdigest()) for i in ids)
    got = exact_duplicates(df, keep=keep)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert Counter(map(tuple, got.collect())) == want
    assert exact_duplicates(df.limit(0)).count() == 0


def test_exact_null_ids_and_plan(spark):
    rows = [(None, "a"), (4, "a"), (2, "a"), (None, "b"), (None, "b"), (1, None), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = exact_duplicates(df, keep="max")
    digest = {t: hashlib.sha256(t.encode()).hexdigest() for t in ("a", "b", "")}
    want = [(None, 4, 3, False, digest["a"]), (4, 4, 3, True, digest["a"]), (2, 4, 3, False, digest["a"])]
    want += [(None, None, 2, True, digest["b"])] * 2 + [(1, 1, 2, True, digest[""]), (None, 1, 2, False, digest[""])]
    assert Counter(map(tuple, got.collect())) == Counter(want)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" in plan and "Python" not in plan and "Arrow" not in plan


def level(sizes, weights, share, cap):
    target, fixed = {}, set()
    total = share * sum(sizes.values())
    while True:
        left = total - sum(cap * sizes[s] for s in fixed)
        w = sum(weights[s] for s in sizes if s not in fixed)
        target = {s: cap * sizes[s] if s in fixed else left * weights[s] / w for s in sizes} if w else {s: cap * sizes[s] for s in sizes}
        more = {s for s in sizes if s not in fixed and target[s] > cap * sizes[s]}
        if not more:
            return target
        fixed |= more


def test_mix(spark):
    rows = []
    for i in range(3000):
        source = [None, "b", "a", "é", "hot", "hot", "hot", "Z", "tiny"][i % 9] if i % 50 else "tiny"
        rows.append((i, None if i % 97 == 0 else "w\t x y\n" * (i % 7) + " z" * (i % 5), source, 1, "s"))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, copies int, target string").repartition(4)
    size = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows}
    totals = Counter()
    for r in rows:
        totals[r[2]] += size[r[0]]
    order = sorted((s for s in totals if s is not None), key=lambda s: s.encode()) + [None]
    want = level(totals, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, 1.5, 2)
    got = {r.doc_id: r for r in mix(df).collect()}
    taken = Counter()
    for r in rows:
        g = got[r[0]]
        assert (g.size, g.source_size) == (size[r[0]], totals[r[2]]) and g.target == pytest.approx(want[r[2]])
        assert g.taken <= 2 * g.size and g.taken == g.copies * g.size
        taken[r[2]] += g.taken
    for s in totals:
        assert abs(taken[s] - want[s]) <= 0.15 * want[s] + 30
    assert {r.doc_id: r for r in mix(df.repartition(7)).collect()} == got
    back = Counter(r.doc_id for r in mixed_documents(df).collect())
    assert back == Counter({i: g.copies for i, g in got.items() if g.copies})
    assert mixed_documents(df).columns == df.columns
    assert mix(df.limit(0)).count() == 0
    assert mix(df.withColumn("text", F.lit(None).cast("string"))).where("taken <> 0").count() == 0


def test_mix_null_ids(spark):
    rows = [(i, "w x y", s) for i, s in enumerate("abc" * 40)] + [(None, "w x y", s) for s in ("a", "a", "b", "c", None)] + [(3, "w x y", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = mix(df).collect()
    assert len(plan) == len(rows)
    for r in plan:
        rate = r.target / r.source_size
        assert r.taken == r.copies * r.size and r.copies - math.floor(rate) in ((0,) if r.doc_id is None else (0, 1))
    want = Counter()
    for r in plan:
        want[r.doc_id, r.source] += r.copies
    assert any(n for (i, _), n in want.items() if i is None)
    assert Counter((r.doc_id, r.source) for r in mixed_documents(df).collect()) == Counter({k: n for k, n in want.items() if n})


def test_mixed_rows_that_repeat_ids(spark):
    """Rows of one id in sources of different rates are repeated by their own source's rate."""
    rows = [(i % 40, "w x y z", "abc"[i % 3]) for i in range(600)] + [(i, "w x", None) for i in range(40)] + [(7, None, "a"), (7, "", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    want = Counter()
    for r in mix(df).collect():
        want[r.doc_id, r.source] += r.copies
    assert len({r.target / r.source_size for r in mix(df).collect()}) > 2
    assert Counter((r.doc_id, r.source) for r in mixed_documents(df).collect()) == Counter({k: n for k, n in want.items() if n})
    assert mixed_documents(df.limit(0)).count() == 0


def test_targets_at_the_cap(spark):
    sized = spark.createDataFrame([("a", 10), ("b", 20)], "source string, size long")
    got = {r.source: r.target for r in source_targets(sized, weights=(1,), share=3.0, cap=2).collect()}
    assert got == {"a": 20.0, "b": 40.0}
