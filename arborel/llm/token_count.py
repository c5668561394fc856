"""Token counts of whole texts with a whole-token shortcut.

Before any text is read, each vocabulary string is encoded alone: where that gives exactly
the string's own id, a pre-token equal to the string is one token, and no merge has to run.
Counting then looks pre-tokens up in that proven table; the library merges only the rest,
once for each distinct pre-token a worker remembers.
"""

from __future__ import annotations

from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from arborel.llm.encode import CONTROLS, UNSETTLED, load, settled_pattern, text_batches

#: Pre-tokens with a remembered count in one Python worker, before it starts anew.
MEMO = 400_000

class Counter:
    """Counts the tokens of texts exactly as tokenizers or sentencepiece would list them."""

    def __init__(self, path: str):
        self.path = path
        self.pieces = path.endswith(".model")
        if self.pieces:
            import sentencepiece

            self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
            return
        import json

        import re

        import public_tokenizers

        self.tokenizer = load(path)
        spec = json.loads(self.tokenizer.to_str())
        pre = spec["pre_tokenizer"]
        self.shortcut = pre["type"] == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec["normalizer"]
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.words = settled_pattern(public_tokenizers.PATTERN)
        self.unsettled = re.compile(UNSETTLED)
        self.proven = self._prove() if self.shortcut else {}
        self.table = dict(self.proven)

    def _prove(self) -> dict[str, int]:
        """Vocabulary strings that are one pre-token and encode alone as their own single id."""
        decoder = self.tokenizer.decoder
        pairs = [(decoder.decode([token]), i) for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items()]
        pairs = [(s, i) for s, i in pairs if s and not self._by_library(s) and "�" not in s and self.words.findall(s) == [s]]
        found = self.tokenizer.encode_batch([s for s, _ in pairs], add_special_tokens=False)
        return {s: 1 for (s, i), e in zip(pairs, found, strict=True) if e.ids == [i]}

    def _by_library(self, text: str) -> bool:
        return (not text.isascii() and self.unsettled.search(text) is not None) or any(s in text for s in self.special) or any(c in text for c in CONTROLS)

    def count(self, texts: list[str]) -> list[int]:
        if self.pieces:
            return [len(ids) for ids in self.processor.encode(texts, num_threads=1)]
        if not self.shortcut:
            return [len(e) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        out: list[int] = [0] * len(texts)
        whole = [i for i, t in enumerate(texts) if self._by_library(t)]
        for i, e in zip(whole, self.tokenizer.encode_batch([texts[i] for i in whole], add_special_tokens=False), strict=True):
            out[i] = len(e)
        skip = set(whole)
        cut = {i: self.words.findall(t) for i, t in enumerate(texts) if i not in skip}
        if len(self.table) > len(self.proven) + MEMO:
            self.table = dict(self.proven)
        table = self.table
        rest = list(dict.fromkeys(w for words in cut.values() for w in words if w not in table))
        for e, w in zip(self.tokenizer.encode_batch(rest, add_special_tokens=False), rest, strict=True):
            table[w] = len(e)
        for i, words in cut.items():
            out[i] = sum(map(table.__getitem__, words))
        return out


@cache
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(
    docs: DataFrame, tokenizer_path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit for every row of docs.

    Null and empty texts have 0 bytes and 0 tokens. Rows that repeat an id give a row each.
    Texts of any length are counted whole. Other columns are not read. There is no shuffle:
    each task counts the rows it scans, in batches bounded by characters.
    """

    def rows(batches):
        tally = counter(tokenizer_path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            counts: list[int] = []
            for _, part in text_batches(texts):
                counts += tally.count(part)
            size = [len((t or "").encode()) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(counts, pa.int64()), pa.array([c > limit for c in counts], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    picked = docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text")
    return picked.mapInArrow(rows, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op4_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
