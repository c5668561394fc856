"""The pipeline's stages on a small table against their rules."""

import hashlib
import zlib

from pyspark.sql import functions as F

import corpus_pipeline as C
from arborel.llm.mixing import mix


def test_stages(spark, tmp_path):
    calm = "so it goes with the wind over sea number"
    docs = []
    for i in range(400):
        words = " ".join(hashlib.md5(f"{i}-{k}".encode()).hexdigest()[:5] for k in range(60))
        docs.append((i, f"you stupid clown idiot {words}" if i % 5 == 0 else f"{calm} {words}", "en", f"s{i % 4}", 1))
    docs += [(1000 + i, docs[i + 1][1], "en", "s1", 1) for i in range(3)] + [(2000, docs[2][1] + " more", "en", "s2", 1)]
    docs += [(3000, None, None, None, 0), (3001, "", "en", "s0", 0)]
    table = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    table.write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, 1, int(i % 5 == 0)) for i in range(400)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    d = str(tmp_path)
    kept, frames = spark.read.parquet(d + "/documents.parquet"), []
    for k, (_, stage) in enumerate(C.STAGES):
        stage(spark, kept, d).write.parquet(f"{d}/stage{k}")
        kept = spark.read.parquet(f"{d}/stage{k}")
        frames.append(kept)
        assert k == 4 or kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    clean = {r[0] for r in docs if not (r[0] < 400 and r[0] % 5 == 0)}
    assert {r.doc_id for r in frames[0].collect()} == clean
    texts = {}
    for i, t, *_ in docs:
        if i in clean:
            texts[t or ""] = max(i, texts.get(t or "", -1))
    assert {r.doc_id for r in frames[1].collect()} == set(texts.values())
    near = {r.doc_id for r in frames[2].collect()}
    assert near == set(texts.values()) - {2000}
    want = {r.doc_id: r.copies for r in mix(frames[2]).collect() if r.copies}
    assert {r.doc_id: r["count"] for r in frames[3].groupBy("doc_id").count().collect()} == want
    pieces = frames[4].collect()
    assert {p.doc_id for p in pieces} == set(want)
    assert sum(p.length for p in pieces) == sum(r.n for r in frames[4].where("start = 0").select(F.col("doc_tokens").alias("n")).collect())
    assert zlib.crc32((1).to_bytes(4, "little")) in {p.ids_crc32 for p in pieces} or 3001 not in want
    assert C.run(spark, d).count() == len(pieces)


def tables(spark, folder, docs, labels):
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_empty_table(spark, tmp_path):
    assert C.run(spark, tables(spark, tmp_path, [], [])).count() == 0


def test_repeated_and_null_ids(spark, tmp_path):
    """No stage fails on them; rows that repeat an id are kept or dropped together, and rows with a null id stay."""
    text = lambda i: " ".join(hashlib.md5(f"{i}-{k}".encode()).hexdigest()[:5] for k in range(40))
    docs = [(i, text(i), "en", "ab"[i % 2], 1) for i in range(30)] + [(3, text(3), "en", "b", 1), (4, text(99), None, "a", 1), (None, text(5), "en", None, 1), (None, text(50), "en", "a", 1)]
    folder = tables(spark, tmp_path, docs, [(i, 1, 0) for i in range(20)])
    kept = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in C.STAGES[:3]:
        kept = stage(spark, kept, folder)
        assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((r[0] for r in docs), key=str)
    assert C.run(spark, folder).where("start = 0").count() > 30
