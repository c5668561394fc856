"""Ids of whole texts, by the tokenizers library on their distinct pre-tokens.

The library needs about a microsecond for every byte, but most pre-tokens of a corpus repeat.
An Encoder cuts texts by the tokenizer's own pre-token pattern, remembers the ids of
pre-tokens it has seen and asks the library for the rest only, many in one call. That is
exact: models of these tokenizers never look past a pre-token. Texts with characters whose
class, case or composition may differ between Unicode versions, and texts that contain a
special string, go to the library whole.
"""

from __future__ import annotations

import re
from functools import cache

import numpy as np

#: Pre-tokens remembered by one Python worker (about 200 bytes each) before it forgets them.
MEMO_WORDS = 800_000


@cache
def load(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


#: Any character but those whose class, case and composition are the same in every Unicode version.
UNSETTLED = r"[^\t-\r -~\xa0-\xac\xae-\xff]"


#: ASCII characters among them.
CONTROLS = [chr(c) for c in (*range(9), *range(14, 32), 11, 12, 127)]


#: Letters, digits and white space among the settled characters, as bodies of character classes.
LETTERS, DIGITS, SPACES = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", r"\t\n\r \xa0"


def settled_pattern(pattern: str) -> re.Pattern:
    """A pre-token pattern with its Unicode classes written out for settled characters."""
    for name in (r"\p{L}", r"\p{N}"):
        pattern = pattern.replace(f"[{name}]", name)
    pattern = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{SPACES}{LETTERS}{DIGITS}]")
    for name, body in ((r"\p{L}", f"[{LETTERS}]"), (r"\p{N}", f"[{DIGITS}]"), (r"\s", f"[{SPACES}]"), (r"\S", f"[^{SPACES}]")):
        pattern = pattern.replace(name, body)
    return re.compile(pattern)


class Memo(dict):
    """Numbers keys as they first come up; `new` lists those that nobody has handled yet."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        self[key] = number = len(self)
        self.new.append(key)
        return number

    def numbers(self, keys: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, keys), dtype=np.int64, count=len(keys))


class Ragged:
    """Arrays of ids by number, in one flat array that grows."""

    def __init__(self):
        self.flat, self.used = np.empty(1 << 16, dtype=np.uint32), 0
        self.begin, self.count = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)

    def append(self, ids: np.ndarray, counts: np.ndarray) -> None:
        need = self.used + len(ids)
        if need > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty(max(need, len(self.flat)), dtype=np.uint32)])
        self.flat[self.used : need] = ids
        self.begin = np.concatenate([self.begin, self.used + np.cumsum(counts) - counts])
        self.count = np.concatenate([self.count, counts])
        self.used = need

    def gather(self, at: np.ndarray) -> np.ndarray:
        count = self.count[at]
        ends = np.cumsum(count)
        index = np.repeat(self.begin[at] - (ends - count), count) + np.arange(int(ends[-1]) if len(ends) else 0)
        return self.flat[index]


class Encoder:
    """Encodes texts without added special tokens; special strings inside texts are handled as the library does.

    New pre-tokens are joined for one call: byte-level ones by line breaks, which are one id
    and never join a neighbour, the others by spaces, as each ends in an id of the
    vocabulary's word ends. Tokenizers of another make encode every text whole.
    """

    def __init__(self, path: str, memo_words: int = MEMO_WORDS):
        import json

        self.tokenizer = load(path)
        spec = json.loads(self.tokenizer.to_str())
        pre = spec["pre_tokenizer"]
        parts = pre.get("pretokenizers", [pre])
        self.spaced = pre["type"] == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec["normalizer"]
        dropped = [p for p in parts if p["type"] == "Split" and p.get("behavior") == "Removed" and p.get("invert")]
        suffix = spec["model"].get("end_of_word_suffix")
        self.splittable = self.spaced or bool(dropped and suffix)
        self.memo_words = memo_words
        if not self.splittable:
            return
        if self.spaced:
            import public_tokenizers

            pattern = public_tokenizers.PATTERN
            self.stop = self.tokenizer.encode("\n", add_special_tokens=False).ids[0]
        else:
            pattern = dropped[0]["pattern"]["Regex"]
            self.ends = np.zeros(self.tokenizer.get_vocab_size() + 1, dtype=bool)
            self.ends[[i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if t.endswith(suffix)]] = True
        self.words = settled_pattern(pattern)
        self.unsettled = re.compile(UNSETTLED)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self._restart()

    def _restart(self) -> None:
        self.known, self.ids = Memo(), Ragged()

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype=np.uint32) for e in found]

    def _learn(self, words: list[str]) -> None:
        for start in range(0, len(words), 512):
            part = words[start : start + 512]
            glue = "\n" if self.spaced else " "
            ids = np.array(self.tokenizer.encode(glue.join(part), add_special_tokens=False).ids, dtype=np.uint32)
            if self.spaced:
                stops = np.flatnonzero(ids == self.stop)
                counts = np.diff(np.concatenate([[-1], stops, [len(ids)]])) - 1
                ids = ids[ids != self.stop]
            else:
                counts = np.diff(np.flatnonzero(self.ends[ids]), prepend=-1)
            if len(counts) != len(part) or any(w.isspace() for w in part):
                alone = self.whole(part)
                counts, ids = np.array([len(a) for a in alone]), np.concatenate(alone)
            self.ids.append(ids, counts)

    def _by_library(self, text: str) -> bool:
        return (not text.isascii() and self.unsettled.search(text) is not None) or any(s in text for s in self.special) or any(c in text for c in CONTROLS)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """One uint32 array of ids for each text."""
        if not self.splittable:
            return self.whole(texts)
        if len(self.known) > self.memo_words:
            self._restart()
        at = [None if self._by_library(t) else self.known.numbers(self.words.findall(t if self.spaced else t.lower())) for t in texts]
        if self.known.new:
            fresh, self.known.new = self.known.new, []
            self._learn(fresh)
        direct = [i for i, numbers in enumerate(at) if numbers is None]
        out = [None if numbers is None else self.ids.gather(numbers) for numbers in at]
        for i, ids in zip(direct, self.whole([texts[i] for i in direct]), strict=True):
            out[i] = ids
        return out


@cache
def encoder(path: str) -> Encoder:
    """The worker's own encoder of this file; Python workers live on over many tasks."""
    return Encoder(path)


def text_batches(texts: list, max_chars: int = 1 << 20):
    """(first index, texts) runs of about max_chars characters, null as empty."""
    start, held, size = 0, [], 0
    for i, text in enumerate(texts):
        held.append(text or "")
        size += len(held[-1])
        if size >= max_chars:
            yield start, held
            start, held, size = i + 1, [], 0
    if held:
        yield start, held
