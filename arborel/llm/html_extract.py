"""Main text of HTML pages by a maximum-scoring subsequence.

A page becomes a sequence of tags and text runs. Every tag scores negative. A text run scores
its number of words times the worth of a word in that place, which is positive for article
text and negative for menus, notices and the like; it comes from a logistic model over the
names, classes and ids of the enclosing elements, whether the run stands in a link, and its
length. Words below elements with bad names (menus, comments, adverts and the like) are taken
out before. One linear scan finds the contiguous region with the largest sum; runs inside it
whose words are worth less than nothing are left out. Where the runs of the region have a common ancestor that speaks for content, such as
an article, the region takes in what else below it is worth something: a short last block
after an advert need not pay for the advert.

The model starts from prior weights for well-known names and is fitted on labelled pages: a
page with one <article> (or <main>) labels its words by whether they stand inside it, with no
element of a bad name between. In half of the labelled pages those two names are hidden from
the model, so that it also learns to do without them. Names that are bad beforehand (menus,
comments, adverts and the like) hold whatever else surrounds a word, unless the labelled pages
themselves show that name around articles.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass
from itertools import takewhile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The bound on labelled pages that the weights are fitted on, and on feature names.
SAMPLE, NAMES = 2000, 400
#: A name of this prior or less is bad: text below it goes, unless labelled pages show it around more article words than others.
BAD = -4.0
#: Elements that stand around everything and say nothing.
EVERYWHERE = frozenset(["html", "body"])
#: The worth that an element's own name and classes must add up to for it to speak for content.
LEAST_CONTENT = 0.9
#: Elements whose content is never text of a page.
SILENT = frozenset("script style noscript template svg math iframe object canvas audio video head title select option textarea datalist button map".split())
#: Elements whose content is plain text up to their end tag, whatever it looks like.
RAW = frozenset("script style textarea title noscript iframe".split())
#: Start tags that may stand in a head; any other, or a word, ends a head without its end tag.
IN_HEAD = frozenset("html head base basefont bgsound link meta title style script noscript template".split())
#: Elements that end a block; all others, line breaks included, are part of the block's white space or its words.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Prior worth of a word below an element with this name or with this word in its class or id.
PRIOR = {
    "article": 4.0, "main": 3.0, "p": 0.5, "h1": 0.5, "blockquote": 0.5, "pre": 0.5, "content": 1.5, "post": 1.0, "story": 1.5, "entry": 1.0, "body-text": 1.0,
    "nav": -7.0, "menu": -7.0, "header": -6.0, "footer": -7.0, "aside": -7.0, "form": -7.0, "dialog": -7.0, "search": -6.0, "label": -4.0, "a": -2.5,
} | dict.fromkeys(
    "ad ads advert adverts advertisement banner sponsor sponsored promo promoted sidebar widget cookie cookies consent notice notification popup modal newsletter subscribe "
    "signup login breadcrumb breadcrumbs navbar navigation navigate topbar masthead foot copyright share sharing social related recommended recommendations "
    "comment comments commentlist reply replies disqus respond discussion pagination pager toolbar toc skip legal disclaimer outbrain taboola paywall alert".split(),
    -7.0,
)
#: Elements of running text; inside content, the words TOPICAL in their classes and ids may name their subject and say nothing of their worth.
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li td dd dt figcaption".split())
TOPICAL = frozenset("legal sharing discussion respond label search form".split())
CONTENT = frozenset(["article", "main", ".content", ".post", ".story", ".entry"])
ROLES = {"navigation": "nav", "banner": "header", "contentinfo": "footer", "complementary": "aside", "search": "search", "form": "form", "main": "main", "article": "article", "dialog": "dialog"}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</?[A-Za-z][^\s/>]*(?:[^>\"']|\"[^\"]*\"|'[^']*')*(?:>|\Z)|</?[A-Za-z][^>]*(?:>|\Z)|[^<]+|<",
    re.DOTALL,
)
_NAME = re.compile(r"</?([A-Za-z][^\s/>]*)")
_MARKS = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.IGNORECASE)
_WORD = re.compile(r"[A-Za-z]+")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE) for name in RAW}
_IN_SCRIPT = re.compile(r"<!--(?:-*>)?|-->|</?script(?=[\s/>])", re.IGNORECASE)


def _features(tag: str, name: str, above: frozenset) -> frozenset:
    if name in EVERYWHERE:
        return frozenset()
    found = {name}
    silent = TOPICAL if name in TEXTUAL and above & CONTENT else frozenset()
    if "=" in tag:
        for kind, *values in _MARKS.findall(tag):
            value = next((v for v in values if v), "")
            if kind.lower() == "role":
                found.add(ROLES.get(value.strip().lower(), "role"))
            else:
                found.update("." + w for w in map(str.lower, _WORD.findall(value)) if w not in silent)
    return frozenset(found)


@dataclass(slots=True)
class Run:
    """A tag (words 0) or a text run of a page."""

    block: int
    text: str
    words: int
    inside: frozenset
    tag: str
    #: The open elements, outermost first: (running number, own features).
    below: tuple


def _after_raw(page: str, at: int, name: str) -> int:
    """Where the page goes on after the end tag of a raw element whose content starts at `at`."""
    end = _RAW_END[name].search(page, at)
    if name == "script" and end and page.find("<!--", at, end.start()) >= 0:
        # a script named in a comment of the script has an end tag of its own
        comment = nested = False
        for match in _IN_SCRIPT.finditer(page, at):
            mark = match.group().lower()
            if mark == "<!--":
                comment = True
            elif mark.endswith(">"):
                comment = comment and mark != "-->"
                nested = nested and comment
            elif mark == "<script":
                nested = comment
            elif nested:
                nested = False
            else:
                end = match
                break
    close = page.find(">", end.end()) if end else -1
    return close + 1 if close >= 0 else len(page)


def runs(page: str) -> list[Run]:
    """The page's tags and text runs, each text run with the features of the elements around it."""
    out: list[Run] = []
    stack: list[tuple[str, frozenset, tuple]] = []
    inside: frozenset = frozenset()
    below: tuple = ()
    block, silent, head, at = 0, "", False, 0
    while match := _TOKEN.match(page, at):
        token, at = match.group(), match.end()
        if token[0] == "<" and len(token) > 1:
            named = _NAME.match(token)
            if not named:
                continue
            name = named.group(1).lower()
            closing = token[1] == "/"
            if head and not silent:
                head = name not in ("head", "body", "html") if closing else name in IN_HEAD
                if closing and name == "head":
                    continue
            if silent or head:
                if closing:
                    silent = "" if name == silent else silent
                elif name in RAW and silent not in ("svg", "math") and not token.endswith("/>"):
                    at = _after_raw(page, at, name)
                elif name == "template" and not silent:
                    silent = name
                continue
            if name in BLOCKS:
                block += 1
            out.append(Run(block, " " if name == "br" else "", 0, inside, "/" + name if closing else name, below))
            if closing:
                opened = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
                if opened is not None:
                    del stack[opened:]
                    inside, below = stack[-1][1:] if stack else (frozenset(), ())
                continue
            if name in SILENT and not token.endswith("/>"):
                if name in RAW:
                    at = _after_raw(page, at, name)
                elif name == "head":
                    head = True
                else:
                    silent = name
                continue
            if name in VOID or token.endswith("/>"):
                continue
            closes = {"p"} if name in BLOCKS else set()
            closes |= {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}.get(name, set())
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in closes:
                    del stack[i:]
                    break
                if stack[i][0] in BLOCKS:
                    break
            above, below = stack[-1][1:] if stack else (frozenset(), ())
            own = _features(token, name, above)
            inside, below = above | own, (*below, (len(out), own))
            stack.append((name, inside, below))
        elif not silent and not (head and token.isspace()):
            head = False
            text = html.unescape(token)
            out.append(Run(block, text, len(text.split()), inside, "", below))
    return out


def _size(words: int) -> str:
    return "#few" if words < 4 else "#some" if words < 12 else "#many"


def prior(name: str) -> float:
    """Element names and class words share the table; a class word that is also an element's name counts less."""
    if name == "#bias":
        return 0.5
    if name in ("#few", "#some", "#many"):
        return {"#few": -0.5, "#some": 0.0, "#many": 0.5}[name]
    return PRIOR.get(name.removeprefix("."), 0.0) if not name.startswith(".") or PRIOR.get(name[1:], 0) < -2.5 or name[1:] in ("article", "main", "content", "post", "story", "entry") else 0.0


class Weights:
    """The worth of a word in a place, and the cost of tags."""

    def __init__(self, learned: dict[str, float] | None = None, tag_cost: float = 0.1, lifted: frozenset = frozenset()):
        self.learned, self.lifted = learned or {}, lifted
        self.tag_cost = tag_cost
        self._known: dict[tuple, float | None] = {}

    def worth(self, inside: frozenset, words: int) -> float | None:
        """The worth of each word, from -1 to 1; None below a bad element, which is no text at all."""
        key = (inside, _size(words))
        if key not in self._known:
            if len(self._known) > 50_000:
                self._known = {}
            bad = self.is_bad(inside)
            self._known[key] = None if bad else float(np.clip(self.sum((*inside, key[1], "#bias")), -1, 1))
        return self._known[key]

    def is_bad(self, features) -> bool:
        """Whether a feature is bad beforehand and the labelled pages have not shown it around articles."""
        return any(prior(f) <= BAD and f not in self.lifted for f in features)

    def sum(self, features) -> float:
        return sum(self.learned.get(f, prior(f)) for f in features)


def _container(sequence: list[Run], worth: list[float], weights: Weights) -> tuple:
    """The common ancestors of the runs of some worth, down to the innermost that speaks for content; () without any."""
    shared = None
    for run, value in zip(sequence, worth, strict=True):
        if run.words and value > 0:
            pairs = zip(run.below, run.below if shared is None else shared)
            shared = tuple(a for a, b in takewhile(lambda p: p[0][0] == p[1][0], pairs))
    shared = shared or ()
    while shared and (weights.sum(shared[-1][1]) < LEAST_CONTENT or shared[-1][1] & TEXTUAL):
        shared = shared[:-1]
    return shared


def extract(page: str | None, weights: Weights) -> str:
    """Blocks of the best region joined by one line break; '' for a page without any."""
    best, total, start, region = 0.0, 0.0, 0, (0, 0)
    sequence = runs(page or "")
    worth = []
    for i, run in enumerate(sequence):
        value = weights.worth(run.inside, run.words) if run.words else 0.0
        worth.append(-1.0 if value is None else value)
        if value is None:
            continue
        total += value * run.words if run.words else -weights.tag_cost * (not run.text.isspace())
        if total <= 0:
            total, start = 0.0, i + 1
        elif total > best:
            best, region = total, (start, i + 1)
    blocks: dict[int, list[str]] = {}
    cut = slice(*region)
    around = _container(sequence[cut], worth[cut], weights)
    for i, (run, value) in enumerate(zip(sequence, worth, strict=True)):
        chosen = region[0] <= i < region[1] or (around and run.below[: len(around)] == around)
        if chosen and run.text and (value > 0 or not run.words):
            blocks.setdefault(run.block, []).append(run.text)
    joined = (" ".join("".join(parts).split()) for parts in blocks.values())
    return "\n".join(b for b in joined if b)


def _labelled(page: str, hide: bool):
    """(features of each text run, its words, inside the marked article), or nothing for a page without one mark."""
    lower = page.lower()
    mark = "article" if lower.count("<article") == 1 else "main" if lower.count("<main") == 1 else None
    if mark is None:
        return
    for run in runs(page):
        if run.words:
            features = run.inside - {"article", "main", ".article", ".main"} if hide else run.inside
            at = next((i for i, (_, own) in enumerate(run.below) if mark in own), None)
            good = at is not None and all(prior(f) > BAD for _, own in run.below[at + 1 :] for f in own)
            yield frozenset((*features, _size(run.words), "#bias")), run.words, good


def fit_weights(pages: DataFrame, html_col: str = "html", id_col: str = "page_id", sample: int = SAMPLE) -> Weights:
    """Weights from at most `sample` labelled pages, chosen by a hash of the id; priors alone when there are none."""
    marked = pages.select(F.col(id_col).cast("string").alias("page"), F.col(html_col).alias("html")).where(F.col("html").rlike("(?i)<(article|main)\\b"))
    n = marked.count()
    if not n:
        return Weights()
    coin = F.pmod(F.xxhash64("page"), F.lit(1 << 30))
    picked = marked.where(coin <= F.lit(int(min(1.0, sample / n) * (1 << 30))))

    def count(batches):
        from collections import Counter

        seen: Counter = Counter()
        for batch in batches:
            for page_id, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for features, words, label in _labelled(page or "", hash_half(page_id)):
                    seen["\t".join(sorted(features)), label] += words
        if seen:
            keys, words = zip(*seen.items(), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys]), pa.array([v for _, v in keys]), pa.array(words, pa.int64())], ["features", "label", "words"])

    places = picked.mapInArrow(count, "features string, label boolean, words long").groupBy("features").agg(
        F.sum(F.when(F.col("label"), F.col("words")).otherwise(0)).alias("good"), F.sum(F.when(~F.col("label"), F.col("words")).otherwise(0)).alias("bad")
    )
    table = places.orderBy((F.col("good") + F.col("bad")).desc(), "features").limit(5000).toPandas()
    return Weights(_logistic(table), lifted=_lifted(table)) if len(table) else Weights()


def _lifted(table) -> frozenset:
    """Bad names below which most words of the labelled pages are words of an article."""
    balance: dict[str, int] = {}
    for features, good, bad in zip(table["features"], table["good"], table["bad"], strict=True):
        for f in features.split("\t"):
            if prior(f) <= BAD:
                balance[f] = balance.get(f, 0) + int(good) - int(bad)
    return frozenset(f for f, more in balance.items() if more > 0)


def hash_half(page_id: str | None) -> bool:
    import zlib

    return bool(zlib.crc32((page_id or "").encode()) & 1)


def _logistic(table) -> dict[str, float]:
    """Ridge logistic weights drawn to the priors; places count with the square root of their words."""
    sets = [f.split("\t") for f in table["features"]]
    mass: dict[str, float] = {}
    for features, words in zip(sets, table["good"] + table["bad"], strict=True):
        for f in features:
            mass[f] = mass.get(f, 0.0) + float(words)
    names = sorted(mass, key=lambda f: (-mass[f], f))[:NAMES]
    index = {f: i for i, f in enumerate(names)}
    x = np.zeros((len(sets), len(names)))
    for row, features in enumerate(sets):
        x[row, [index[f] for f in features if f in index]] = 1
    start = np.array([prior(f) for f in names])
    good, bad = np.sqrt(table["good"].to_numpy(float)), np.sqrt(table["bad"].to_numpy(float))
    total, w = good + bad, start.copy()

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((total * np.logaddexp(0, z) - good * z).sum() + ((w - start) ** 2).sum())

    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (total * p - good) + 2.0 * (w - start)
        hessian = (x.T * (total * p * (1 - p))) @ x + 2.0 * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        while np.abs(step).max() >= 1e-6 and loss(w - step) > loss(w):
            step = step / 2  # a full step overshoots where all chances are near 0 or 1
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return dict(zip(names, w.tolist(), strict=True))


def main_text(pages: DataFrame, weights: Weights, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for every row of pages.

    Null and empty pages, and pages without a region of positive score, have the text ''.
    Whole pages are read, whatever their length; rows that repeat an id give a row each.
    Character references are decoded, white space inside a block becomes one space. There is
    no shuffle. Other columns are not read.
    """

    def run(batches):
        for batch in batches:
            texts = [extract(p, weights) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    picked = pages.selectExpr(f"cast(`{id_col}` as long) as page_id", f"cast(`{url_col}` as string) as url", f"`{html_col}` as html")
    return picked.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return main_text(pages, fit_weights(pages))
