"""Language of texts by prediction by partial matching: the language whose bytes cost least.

A language's model is a context tree of bytes: after each context of up to ORDER bytes, how
often each byte followed. A byte's code length starts at the longest context in the tree; a
byte not seen there costs an escape and is looked up one byte shorter, without the bytes that
the longer context has ruled out, down to equal chances of all bytes left. Escapes weigh as
much as there are different bytes in a context (method C). Statistics are frozen after
learning, so all code lengths from a context are numbers of that context.

Learning counts byte grams of all labelled texts on Spark. Scoring joins the trees of all
languages in one table of states, one for each context of any tree: a state and a byte give
the next state and that byte's code length in every language, so numpy moves through all
places of a batch at once. No step looks at languages or texts one by one on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arborel.scratch import materialize

#: Bytes of the longest context.
ORDER = 3
#: Code lengths in the table of states at most (states x byte classes x languages): 32 MB.
CELLS = 1 << 23
#: Contexts of all languages together at most; each language keeps its commonest.
CONTEXTS = 1 << 15
#: Grams of a task that wait before equal ones are merged.
WAITING = 1 << 21
#: Bytes of texts that are scored at once.
TOGETHER = 1 << 20
BASE = 257  # digits of a gram: 0 before a text, byte + 1 inside


def is_held_out(doc_id: Column) -> Column:
    """crc32 of the decimal id leaves 2 when divided by 4; ids that are null are not held out."""
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _joined(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Digits of texts in a row, each behind `order` zeros, and the places of their bytes."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    gap = b"\0" * order
    digits = np.frombuffer(gap + gap.join(texts), np.uint8).astype(np.uint16)
    inside = np.arange(int(sizes.sum())) + order * (np.repeat(np.arange(len(texts)), sizes) + 1)
    digits[inside] += 1
    return digits, inside


def _together(texts: list[bytes | None], most: int = TOGETHER) -> Iterator[list[bytes]]:
    held, size = [], 0
    for t in texts:
        held.append(t or b"")
        size += len(held[-1])
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    both = np.concatenate(keys)
    unique, at = np.unique(both, return_inverse=True)
    return unique, np.bincount(at, np.concatenate(counts), len(unique)).astype(np.int64)


def gram_counts(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """lang, gram, n of texts(lang, text): every byte with the `order` digits before it, a number in base BASE.

    Each task merges equal grams before the shuffle, so a language with most of the rows
    sends no more than one with few.
    """

    def batches(found):
        waiting: dict[str, tuple[list, list]] = {}
        for batch in found:
            frame = pd.DataFrame({"lang": batch.column("lang").to_pylist(), "text": batch.column("text").to_pylist()})
            for lang, part in frame.groupby("lang", sort=True):
                for held in _together(part["text"].tolist()):
                    digits, inside = _joined(held, order)
                    if not len(inside):
                        continue
                    gram = np.zeros(len(inside), dtype=np.uint64)
                    for back in range(order, -1, -1):
                        gram = gram * np.uint64(BASE) + digits[inside - back]
                    keys, counts = np.unique(gram, return_counts=True)
                    kept = waiting.setdefault(lang, ([], []))
                    kept[0].append(keys)
                    kept[1].append(counts)
                    if sum(map(len, kept[0])) > WAITING:
                        keys, counts = _merged(*kept)
                        if len(keys) > WAITING // 2:  # little to merge: pass them on
                            yield _grams(lang, keys, counts)
                            waiting[lang] = ([], [])
                        else:
                            waiting[lang] = ([keys], [counts])
        for lang, kept in waiting.items():
            if kept[0]:
                yield _grams(lang, *_merged(*kept))

    counted = texts.select("lang", F.col("text").cast("binary").alias("text")).mapInArrow(batches, "lang string, gram long, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _grams(lang: str, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array([lang] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(counts.astype(np.int64))]
    return pa.RecordBatch.from_arrays(columns, ["lang", "gram", "n"])


def context_counts(grams: DataFrame, order: int = ORDER) -> DataFrame:
    """lang, size, context, byte, n: the bytes after each context of 0 to `order` bytes; contexts are numbers in base BASE."""
    found = None
    for size in range(order + 1):
        cut = grams.select("lang", "n", F.pmod(F.col("gram"), F.lit(BASE ** (size + 1))).alias("gram"))
        # a digit 0 marks places before the text, which are no context; the first digit tells, as zeros come first
        cut = cut.where(F.col("gram") >= BASE**size) if size else cut
        one = cut.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
        one = one.select("lang", F.lit(size).alias("size"), F.floor(F.col("gram") / BASE).cast("long").alias("context"), (F.col("gram") % BASE - 1).cast("int").alias("byte"), "n")
        found = one if found is None else found.unionByName(one)
    return found


@dataclass
class Tree:
    """One language: (context as bytes) -> counts of the 256 bytes."""

    lang: str
    counts: dict[bytes, np.ndarray]


def learned_trees(texts: DataFrame, order: int = ORDER, most_contexts: int = CONTEXTS, cells: int = CELLS) -> list[Tree]:
    """Context trees of the languages of texts(lang, text), in code-point order of lang.

    Counts cover all texts. Where there are more contexts than the bounds allow, a language
    keeps those seen at least 2**j times, with the least j that fits its share; shorter contexts
    are seen at least as often, so trees stay whole. Null languages are left out, and so are
    languages without a byte of text. Only kept counts come to the driver.
    """
    grams = materialize(gram_counts(texts.where("lang is not null"), order), "language-grams")
    counts = materialize(context_counts(grams, order), "language-contexts")
    totals = counts.groupBy("lang", "size", "context").agg(F.sum("n").alias("seen"))
    totals = materialize(totals.withColumn("level", F.floor(F.log2("seen")).cast("int")), "language-totals")
    levels = totals.groupBy("lang", "level").agg(F.count(F.lit(1)).alias("contexts")).toPandas()
    classes = counts.select("byte").distinct().count() + 2
    langs = sorted(levels["lang"].unique(), key=lambda s: s.encode())
    if not langs:
        return []
    share = max(1, min(most_contexts, cells // (classes * len(langs))) // len(langs))
    least = []
    for lang in langs:
        own = levels[levels["lang"] == lang].sort_values("level", ascending=False)
        fits = own[own["contexts"].cumsum() <= share]["level"]
        least.append((lang, int(fits.min()) if len(fits) else int(own["level"].max()) + 1))
    bounds = counts.sparkSession.createDataFrame(least, "lang string, least int")
    kept = totals.join(bounds, "lang").where("level >= least or size = 0").select("lang", "size", "context")
    rows = counts.join(kept, ["lang", "size", "context"]).toPandas()
    trees = {lang: Tree(lang, {}) for lang in langs}
    for (lang, size, context), part in rows.groupby(["lang", "size", "context"], sort=False):
        digits = [(context // BASE**i) % BASE - 1 for i in range(size - 1, -1, -1)]
        table = np.zeros(256)
        table[part["byte"].to_numpy()] = part["n"].to_numpy()
        trees[lang].counts[bytes(digits)] = table
    return [trees[lang] for lang in langs]


@dataclass
class Model:
    """The trees of all languages as one table of states.

    move[state, class] is the next state, bits[state, class, language] a byte's code length
    there. Class 0 stands before a text, 1 for bytes that no tree has seen; state 0 is the
    empty context.
    """

    langs: list[str]
    order: int
    classes: np.ndarray  # of digits 0 to 256
    move: np.ndarray
    bits: np.ndarray

    @classmethod
    def of(cls, trees: list[Tree], order: int = ORDER) -> Model:
        seen = np.zeros(256, dtype=bool)
        for tree in trees:
            seen |= tree.counts[b""] > 0
        alphabet = np.flatnonzero(seen)
        classes = np.ones(BASE, dtype=np.int64)
        classes[0], classes[alphabet + 1] = 0, np.arange(len(alphabet)) + 2
        columns = np.concatenate([alphabet, [-1]])  # -1: any byte that no tree has seen
        states = sorted({c for tree in trees for c in tree.counts}, key=lambda c: (len(c), c))
        number = {c: i for i, c in enumerate(states)}
        move = np.zeros((len(states), len(alphabet) + 2), dtype=np.int32)
        bits = np.zeros((len(states), len(alphabet) + 2, len(trees)), dtype=np.float32)
        for i, c in enumerate(states):
            # the longest context that the last bytes make; shorter contexts are filled first
            if c:
                move[i] = move[number[c[1:]]]
            for b in alphabet.tolist():
                to = number.get(c + bytes([b]))
                if to is not None:
                    move[i, classes[b + 1]] = to
        for at, tree in enumerate(trees):
            costs = tree_costs(tree)
            for i, c in enumerate(states):
                while c not in costs:
                    c = c[1:]
                bits[i, 2:, at], bits[i, 1, at] = costs[c][columns[:-1]], costs[c][256]
        return cls([tree.lang for tree in trees], order, classes, move, bits)

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text (rows) in each language (columns)."""
        digits, inside = _joined(texts, self.order)
        out = np.zeros((len(texts), len(self.langs)))
        if not len(inside):
            return out
        digits = self.classes[digits]
        state = np.zeros(len(inside), dtype=np.int64)
        width = self.move.shape[1]
        flat = self.move.ravel()
        for back in range(self.order, 0, -1):
            state = flat[state * width + digits[inside - back]].astype(np.int64)
        place = state * width + digits[inside]
        sizes = np.array([len(t) for t in texts])
        full = sizes > 0
        begins = (np.cumsum(sizes) - sizes)[full]
        table = self.bits.reshape(-1, len(self.langs))
        for at in range(len(self.langs)):
            out[full, at] = np.add.reduceat(table[place, at].astype(np.float64), begins)
        return out


def tree_costs(tree: Tree) -> dict[bytes, np.ndarray]:
    """Code lengths in bits of the 256 bytes from each context; item 256 is that of any byte the tree has never seen.

    In a context, a seen byte has chance count / (total + different) and an escape
    different / (total + different). After an escape, the shorter context leaves out what the
    longer one has seen; where nothing is left to see, the escape is free.
    """
    start, after = {}, {}
    for c in sorted(tree.counts, key=len):
        counts = np.append(tree.counts[c], 0.0)
        if not c:
            below = np.full(257, np.log2(max(1, 256 - np.count_nonzero(counts))))
        else:
            short = np.append(tree.counts[c[1:]], 0.0)
            left = np.where(counts > 0, 0.0, short)
            below = _coded(left, after[c[1:]])
        after[c] = below
        start[c] = _coded(counts, below)
    return start


def _coded(counts: np.ndarray, below: np.ndarray) -> np.ndarray:
    different = np.count_nonzero(counts)
    if not different:
        return below
    whole = np.log2(counts.sum() + different)
    with np.errstate(divide="ignore"):
        return np.where(counts > 0, whole - np.log2(np.maximum(counts, 1)), whole - np.log2(different) + below)


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, bits: one row per row of docs, no shuffle.

    The language with the least code length of the whole text; equal lengths go to the first in
    code-point order. score is that language's share of the chances of the text under all
    languages. Null texts and those without a letter (Unicode class L) are `und` with score 0,
    as is every text where nothing was learned. bits is the code length of the text in the
    language predicted, null for `und`. Other columns are not read. No rows give no rows.
    """
    text = F.col(text_col)
    letters = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.when(letters, text).cast("binary").alias("text"))
    if model is None:
        return given.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("bits"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def batches(found):
        model = shared.value
        for batch in found:
            texts, parts = batch.column("text").to_pylist(), []
            for held in _together(texts):
                parts.append(model.code_lengths(held))
            bits = np.concatenate(parts) if parts else np.zeros((0, len(model.langs)))
            best = bits.argmin(axis=1)
            least = bits[np.arange(len(bits)), best]
            share = 1 / np.exp2(np.minimum(0.0, least[:, None] - bits)).sum(axis=1)
            none = np.array([t is None for t in texts], dtype=bool)
            share[none] = 0.0
            langs = [None if n else model.langs[i] for n, i in zip(none, best, strict=True)]
            columns = [batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(share), pa.array(least, mask=none)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score", "bits"])

    out = given.mapInArrow(batches, "doc_id long, lang_pred string, score double, bits double")
    return out.withColumn("lang_pred", F.coalesce("lang_pred", F.lit("und")))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = ORDER) -> Model | None:
    """The model of all rows with a language that are not held out; None where there are none with text."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~is_held_out(F.col(id_col)))
    trees = learned_trees(known.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")), order)
    return Model.of(trees, order) if trees else None


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    named = identify(docs, learn(docs))
    return named.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
