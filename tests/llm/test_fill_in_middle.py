"""Fill-in-middle against plain slicing, chunks and summaries against whole texts."""

import hashlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from arborel.llm import fill_in_middle as fim
from arborel.llm.fill_in_middle import Markers, Memory, Rates, Summary, fill_in_middle, restored

PASSAGE = "".join(f"Wört {i * i % 977} and ñ{i % 13}; " for i in range(900))
TEXTS = [None, "", "a", "é", "ab", "🙂", "x<P>y", "<S", "<M>", "a<", "<S<", "né́ à la\nligne", "z" * 200_000, "ß" * 150_001, PASSAGE, "q" + PASSAGE, PASSAGE[7:] + "end"]


def plain(doc_id, text, seed="1", changed=90, first=20):
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= changed:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = text[:a], text[a:b], text[b:]
    if h[3] % 100 < first:
        return doc_id, n, "spm", a, b - a, f"<S>{suf}<P>{pre}<M>{mid}"
    return doc_id, n, "psm", a, b - a, f"<P>{pre}<S>{suf}<M>{mid}"


def test_against_slicing(spark):
    rows = [(i * 13 + j, t, "form", i) for i, t in enumerate(TEXTS) for j in range(9)] + [(None, "no id", "x", 1), (3, "twice", "x", 1), (3, "twice", "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, form string, n int").repartition(3)
    for rates in (Rates(), Rates(100, 100), Rates(100, 0)):
        made = fill_in_middle(df, rates=rates).withColumn("back", restored(F.col("output"), F.col("form")))
        got = Counter(map(tuple, made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output").collect()))
        assert got == Counter(plain(r[0], r[1], "1", rates.changed, rates.suffix_first) for r in rows)
        ids = {(r.doc_id, r.back) for r in made.collect()}
        assert ids == {(r[0], r[1] or "") for r in rows}
    assert fill_in_middle(df.limit(0)).count() == 0


def test_all_forms_and_other_seed(spark):
    df = spark.createDataFrame([(i, f"text {i} ä") for i in range(400)], "doc_id long, text string")
    got = fill_in_middle(df, seed="s").collect()
    assert {tuple(r) for r in got} == {plain(i, f"text {i} ä", "s") for i in range(400)}
    assert {r.form for r in got} == {"plain", "psm", "spm"}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="<PSM>aé🙂", max_size=9), max_size=8))
def test_summaries_combine(parts):
    markers, whole = Markers(), Summary.of(b"", Markers())
    for part in parts:
        whole = whole.then(Summary.of(part.encode(), markers), markers)
    assert whole == Summary.of("".join(parts).encode(), markers)


def test_chunks_are_shared_and_whole():
    texts = [(t or "").encode() for t in TEXTS]
    memory = Memory(Markers())
    chunked = list(fim._chunked(texts, memory))
    for raw, text in zip(texts, chunked, strict=True):
        decoded = raw.decode()
        assert text.chars == len(decoded) and text.marked == Markers().within(raw)
        for c in {0, 1, len(decoded) // 3, len(decoded) // 2, len(decoded) - 1, len(decoded)} & set(range(len(decoded) + 1)):
            assert text.offset(c) == len(decoded[:c].encode())
        assert all(b - a <= fim.LONGEST + 3 for a, b in zip(text.starts, [*text.starts[1:], len(raw)], strict=bool(raw)))
    assert memory.hits > 20  # the passage is cut alike behind different beginnings
    # texts hashed together are cut as alone
    alone = [next(fim._chunked([t], Memory(Markers()))).starts for t in texts]
    assert alone == [t.starts for t in chunked]


def test_memory_starts_anew():
    memory = Memory(Markers(), most=1000)
    for i in range(50):
        assert memory.summary(b"%d" % i * 30).size == len(b"%d" % i) * 30
    assert memory.held <= 1000 + 300


def test_rolling_hash_is_local():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 123, 20_000).astype(np.uint8)
    moved = np.concatenate([rng.integers(97, 123, 777).astype(np.uint8), data])
    a, b = fim.cuts(data), fim.cuts(moved) - 777
    assert len(a) > 5 and set(a[a > fim.WINDOW]) == set(b[b > fim.WINDOW])
