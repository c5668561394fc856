"""Toxicity scores: gradient-boosted trees over dense text features, calibrated by isotonic regression.

Features are densities: hits of a plain seed list and of a lexicon learned from labelled
texts (words, and stems as word beginnings), second-person words near hits, capitals,
punctuation and obfuscation (letters replaced or parted by digits and signs). A lexicon is
learned on one half of the training rows for the features of the other half, so the trees
never see hits that were fitted to their own rows; scoring uses both halves' lexicon.

The model is fitted on at most SAMPLE labelled rows, chosen by a hash of doc_id; scoring is
one pass over whole texts without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborel.llm.near_dedup import pieces

#: The bound on labelled rows that the model is fitted on, and on terms of the lexicon.
SAMPLE, LEXICON = 16_384, 4000
THRESHOLD = 0.3
#: Common English insults; the lexicon learned from labels comes on top.
SEED_WORDS = frozenset(
    "idiot idiots moron morons stupid dumb loser losers scum trash garbage pathetic worthless disgusting clown fool "
    "jerk bastard bitch asshole crap shit fuck fucking damn hate kill die ugly freak retard imbecile vermin filth".split()
)
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton vous votre usted tú ti tus su".split())
#: Signs that stand for letters in obfuscated words.
LOOKALIKE = str.maketrans("013457@$!|", "oieastasil")
STEMS = (4, 5, 6)
NEAR, SPAN = 5, 40
MEMO = 300_000

FEATURES = [
    "seed_density", "hit_density", "stem_density", "log_hits", "distinct_hits", "mean_weight", "max_weight",
    "span_hits", "near_person", "person_density", "capital_share", "shout_share", "bang_share", "punct_share", "obfuscated", "hidden_hits",
]


def core(token: str) -> str:
    """The token in lower case without signs at its ends."""
    start, end = 0, len(token)
    while start < end and not token[start].isalnum():
        start += 1
    while end > start and not token[end - 1].isalnum():
        end -= 1
    return token[start:end].lower()


def terms(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in STEMS if len(word) > n)]


def revealed(token: str) -> str:
    """An obfuscated token as the word it seems to stand for: look-alike signs read as letters, other signs dropped."""
    return "".join(c for c in token.lower().translate(LOOKALIKE) if c.isalpha())


class Featurizer:
    """Rows of FEATURES for texts, given {term: weight}; knows each distinct token once."""

    COLUMNS = 10

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self._restart()

    def _restart(self) -> None:
        self.slot: dict[str, int] = {}
        self.rows = np.zeros((1024, self.COLUMNS), dtype=np.float32)

    def _weight(self, word: str) -> tuple[float, float]:
        return self.lexicon.get(word, 0.0), max((self.lexicon.get(t, 0.0) for t in terms(word)[1:]), default=0.0)

    def _learn(self, token: str) -> None:
        n = len(self.slot)
        if n == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        word = core(token)
        weight, stem = self._weight(word)
        letters = sum(c.isalpha() for c in token)
        odd = letters > 1 and any(not c.isalpha() and c not in "'’-" for c in word)
        hidden = 0.0
        if word not in SEED_WORDS and weight <= 0 and letters > 1 and letters < len(token):
            plain = revealed(token.rstrip(".,!?;:"))
            hidden = float(plain != word and (plain in SEED_WORDS or self.lexicon.get(plain, 0.0) > 0))
        self.rows[n] = (
            word in SEED_WORDS, weight, stem, word in SECOND_PERSON, sum(c.isupper() for c in token), letters,
            letters > 1 and token.upper() == token, token.count("!"), sum(not c.isalnum() for c in token), odd + 2 * hidden,
        )
        self.slot[token] = n

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), len(FEATURES)), dtype=np.float64)
        if len(self.slot) > MEMO:
            self._restart()
        slot = self.slot
        for i, text in enumerate(texts):
            tokens = text.split()
            if not tokens:
                continue
            for t in dict.fromkeys(tokens):
                if t not in slot:
                    self._learn(t)
            at = np.fromiter(map(slot.__getitem__, tokens), dtype=np.int64, count=len(tokens))
            out[i] = self._row(at)
        return out

    def _row(self, at: np.ndarray) -> list[float]:
        r, n = self.rows[at].astype(np.float64), len(at)
        seed, weight, stem, person, upper, letters, shout, bang, punct, odd = r.T
        hidden = odd >= 2
        hit = (seed > 0) | (weight > 0) | (stem > 0) | hidden
        strength = np.maximum(weight, stem) + 3 * (hidden | (seed > 0)) * (weight == 0)
        where = np.flatnonzero(hit)
        run = np.concatenate([[0], np.cumsum(hit)])
        span = (run[SPAN:] - run[:-SPAN]).max() if n >= SPAN else run[-1]
        near = 0.0
        people = np.flatnonzero(person)
        if len(where) and len(people):
            k = np.searchsorted(people, where)
            ahead = np.abs(people[np.minimum(k, len(people) - 1)] - where)
            behind = np.abs(people[np.maximum(k - 1, 0)] - where)
            near = (np.minimum(ahead, behind) <= NEAR).mean()
        chars = max(1.0, letters.sum() + punct.sum())
        return [
            seed.sum() / n, ((weight > 0) | hidden).sum() / n, (stem > 0).sum() / n, np.log1p(hit.sum()), np.log1p(len(np.unique(at[where]))),
            strength.sum() / n, strength.max(), span, near, person.sum() / n, upper.sum() / max(1.0, letters.sum()), shout.sum() / n,
            bang.sum() / chars, punct.sum() / chars, (odd % 2).sum() / n, hidden.sum() / n,
        ]


def learn_lexicon(counts: DataFrame, n_toxic: int, n_clean: int, least_odds: float = 2.0) -> dict[str, float]:
    """{term: log odds} of the LEXICON best terms (term, toxic, clean document counts) that mark toxic documents."""
    odds = F.log((F.col("toxic") + 0.5) / (n_toxic + 1.0)) - F.log((F.col("clean") + 0.5) / (n_clean + 1.0))
    marking = counts.withColumn("odds", odds).where((F.col("toxic") >= max(3, round(0.004 * n_toxic))) & (F.col("odds") >= least_odds))
    best = marking.orderBy((F.col("odds") * F.sqrt("toxic")).desc(), "term").limit(LEXICON).select("term", "odds").toPandas()
    return dict(zip(best["term"], best["odds"].astype(float), strict=True))


@dataclass
class Boosted:
    """Depth-wise trees on binned features with logistic loss; rows go right where a bin is above the cut."""

    rounds: int = 80
    depth: int = 3
    rate: float = 0.15
    bins: int = 48
    ridge: float = 2.0
    least: float = 2.0
    base: float = 0.0
    edges: list = field(default_factory=list)
    trees: list = field(default_factory=list)

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins)[1:-1])) for c in x.T]
        binned, mean = self._bin(x), (y.sum() + 0.5) / (len(y) + 1)
        self.base = float(np.log(mean / (1 - mean)))
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            tree, step = self._grow(binned, p - y, p * (1 - p))
            self.trees.append(tree)
            score += step
        return self

    def _grow(self, binned: np.ndarray, grad: np.ndarray, hess: np.ndarray) -> tuple:
        """(feature, cut) of the inner nodes in heap order, leaf values; and each row's value."""
        inner, node = (1 << self.depth) - 1, np.zeros(len(grad), dtype=np.int64)
        feature, cut = np.zeros(inner, dtype=np.int64), np.full(inner, self.bins + 1)
        for level in range(self.depth):
            width, first = 1 << level, (1 << level) - 1
            best, size = np.full(width, 1e-9), self.bins + 2
            for j in range(binned.shape[1]):
                key = (node - first) * size + binned[:, j]
                g = np.bincount(key, grad, width * size).reshape(width, size).cumsum(axis=1)
                h = np.bincount(key, hess, width * size).reshape(width, size).cumsum(axis=1)
                whole_g, whole_h = g[:, -1:], h[:, -1:]
                gain = g**2 / (h + self.ridge) + (whole_g - g) ** 2 / (whole_h - h + self.ridge) - whole_g**2 / (whole_h + self.ridge)
                gain[(h < self.least) | (whole_h - h < self.least)] = 0
                at, top = gain.argmax(axis=1), gain.max(axis=1)
                better = np.flatnonzero(top > best)
                best[better], feature[first + better], cut[first + better] = top[better], j, at[better]
            node = 2 * node + 1 + (binned[np.arange(len(node)), feature[node]] > cut[node])
        leaf = node - inner
        values = -self.rate * np.bincount(leaf, grad, inner + 1) / (np.bincount(leaf, hess, inner + 1) + self.ridge)
        return (feature, cut, values), values[leaf]

    def predict(self, x: np.ndarray) -> np.ndarray:
        binned, score = self._bin(x), np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, values in self.trees:
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (binned[rows, feature[node]] > cut[node])
            score += values[node - len(feature)]
        return score


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators fit: ascending knots and their probabilities, smoothed by half a row of each label."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # sum of scores, of labels, rows
    for s, t in zip(score[order], y[order], strict=True):
        blocks.append([s, t, 1.0])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    table = np.array(blocks)
    return table[:, 0] / table[:, 2], np.maximum.accumulate((table[:, 1] + 0.5 * y.mean()) / (table[:, 2] + 0.5))


@dataclass
class Model:
    """A fitted scorer; without labels of both kinds it scores the share of toxic labels."""

    lexicon: dict
    boosted: Boosted | None
    knots: np.ndarray
    levels: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.boosted is None:
            return np.full(len(x), self.levels[0])
        raw = self.boosted.predict(x)
        raw[~x.any(axis=1)] = self.knots[0]  # no words, or words without any sign: no evidence
        # a trace of the raw score keeps the order of rows inside a calibrated step
        return np.clip(0.999 * np.interp(raw, self.knots, self.levels) + 0.001 / (1 + np.exp(-raw)), 0, 1)


def training_rows(docs: DataFrame, labels: DataFrame, in_training, sample: int, seed_col: str = "doc_id") -> DataFrame:
    """doc_id, text, toxic, half of at most `sample` labelled rows; repeated labels of an id count as toxic if any is."""
    spark = docs.sparkSession
    known = labels.where("doc_id is not null and toxic is not null").where(in_training(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    n = known.count()
    coin = F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1 << 30))
    share = min(1.0, sample / max(1, n))
    picked = known.where(coin <= F.lit(int(share * (1 << 30)))).toPandas().sort_values("doc_id")[:sample]
    small = F.broadcast(spark.createDataFrame(list(picked.itertuples(index=False, name=None)), "doc_id long, toxic int"))
    half = F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)).cast("int").alias("half")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(small, "doc_id").select("doc_id", "text", "toxic", half)


def fit(docs: DataFrame, labels: DataFrame, in_training, sample: int = SAMPLE) -> Model:
    """Fit on rows of docs(doc_id, text) whose labels(doc_id, toxic) satisfy in_training(doc_id)."""
    from arborel.scratch import materialize

    rows = materialize(training_rows(docs, labels, in_training, sample), "toxicity-sample")

    def count(batches):
        from collections import Counter

        seen: dict[tuple, Counter] = {(h, t): Counter() for h in (0, 1) for t in (0, 1)}
        for batch in batches:
            for text, toxic, half in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                words = {core(t) for t in (text or "").split()} - {""}
                seen[half, min(1, max(0, toxic))].update({x for w in words for x in terms(w)})
        for (half, toxic), found in seen.items():
            items = list(found.items())
            for start in range(0, len(items), 20_000):
                names, values = zip(*items[start : start + 20_000], strict=True)
                n = len(names)
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([half] * n, pa.int32()), pa.array([toxic] * n, pa.int32()), pa.array(values, pa.int64())], ["term", "half", "toxic", "n"])

    sizes = {(r["half"], r["toxic"]): r["n"] for r in rows.groupBy("half", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    tox, clean = (sum(n for (_, t), n in sizes.items() if (t > 0) == want) for want in (True, False))
    if not tox or not clean:
        return Model({}, None, np.zeros(1), np.array([tox / (tox + clean) if tox + clean else 0.0]))
    of = lambda t, h: F.sum(F.when((F.col("toxic") == t) & (F.col("half") == h), F.col("n")).otherwise(0))
    counts = rows.mapInArrow(count, "term string, half int, toxic int, n long").groupBy("term").agg(of(1, 0).alias("t0"), of(0, 0).alias("c0"), of(1, 1).alias("t1"), of(0, 1).alias("c1"))
    counts = materialize(counts.where("t0 + t1 >= 3"), "toxicity-terms")
    n = lambda h, t: sizes.get((h, t), 0)
    lexicons = [learn_lexicon(counts.select("term", F.col(f"t{h}").alias("toxic"), F.col(f"c{h}").alias("clean")), n(h, 1), n(h, 0)) for h in (0, 1)]
    both = learn_lexicon(counts.select("term", (F.col("t0") + F.col("t1")).alias("toxic"), (F.col("c0") + F.col("c1")).alias("clean")), tox, clean)

    def featurize(batches):
        makers = [Featurizer(lexicons[1]), Featurizer(lexicons[0])]
        for batch in batches:
            texts, half = batch.column(1).to_pylist(), batch.column(3).to_pylist()
            x = np.zeros((len(texts), len(FEATURES)))
            for h in (0, 1):
                own = [i for i, k in enumerate(half) if k == h]
                x[own] = makers[h]([texts[i] or "" for i in own])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "toxic", "x"])

    got = rows.mapInArrow(featurize, "doc_id long, toxic int, x array<double>").toPandas().sort_values("doc_id")
    x, y = np.array(got["x"].tolist()), (got["toxic"].to_numpy() > 0).astype(float)
    fold, raw = np.arange(len(y)) % 4, np.zeros(len(y))
    for k in range(4):
        raw[fold == k] = Boosted().fit(x[fold != k], y[fold != k]).predict(x[fold == k])
    knots, levels = isotonic(raw, y)
    return Model(both, Boosted().fit(x, y), knots, levels)


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted for every row of docs.

    Null, empty and blank texts get the lowest calibrated score: they hold no evidence. Rows that repeat an
    id give a row each. Only the id and the text are read.
    """

    def run(batches):
        maker = Featurizer(model.lexicon)
        for batch in pieces(batches):
            value = model.score(maker([t or "" for t in batch.column(1).to_pylist()]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(value, pa.float64()), pa.array((value >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    picked = docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text")
    return picked.mapInArrow(run, "doc_id long, score double, predicted int")


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, that the model does not reject; one pass, no join."""
    at = docs.columns.index(text_col)

    def run(batches):
        maker = Featurizer(model.lexicon)
        for batch in pieces(batches):
            value = model.score(maker([t or "" for t in batch.column(at).to_pylist()]))
            yield batch.filter(pa.array(value < threshold))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def fit_on_tables(spark: SparkSession, sf_dir: str) -> Model:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return fit(docs, labels.select("doc_id", "toxic"), lambda c: ~held_out(c))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = scores(docs, fit_on_tables(spark, sf_dir))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
