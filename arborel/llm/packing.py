"""Vector bin packing of documents into fixed-length training sequences.

Every item has three demands: tokens, one segment, and loss-bearing tokens. A sequence has a
limit on each. Sequences are filled one at a time: of the waiting items that fit, the one
whose demand vector has the largest dot product with what is left of the sequence goes in
(both scaled by the limits). When nothing fits and a gap of some size is left, the item with
the largest product is cut and its head closes the gap. Documents longer than a sequence
first give whole sequences of their own.

Each task packs the documents it scans, so nothing is shuffled and no state grows with the
input; a task leaves at most one sequence that is not full.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from arborel.llm.encode import encoder, text_batches

#: Items that wait for a place in one task; the choice is among these.
WAITING = 1024
#: A gap of fewer tokens is padded rather than filled by a cut.
LEAST_CUT = 8
#: sequence_id is the task's partition number times this, plus a running number.
PER_TASK = 1 << 40


class Packer:
    """Packs items given by add(); out holds (item, start, length, sequence, offset) rows."""

    def __init__(self, max_tokens: int, max_segments: int, max_loss: int, first: int = 0):
        self.limits = np.array([max_tokens, max_segments, max_loss], dtype=np.float64)
        self.max_tokens = max_tokens
        self.sequence = first
        self.out: list[tuple] = []
        self.items: list = [None] * (WAITING + 1)
        self.need = np.zeros((WAITING + 1, 3))  # tokens, segments, loss; zero rows are free
        self.free = list(range(WAITING, -1, -1))

    def add(self, item, start: int, length: int, loss_from: int) -> None:
        """Tokens start .. start+length of item; those from loss_from on bear loss."""
        while length >= self.max_tokens or self._loss(start, self.max_tokens, loss_from, length) > self.limits[2]:
            if length < self.max_tokens:
                break
            take = self.max_tokens
            if self._loss(start, take, loss_from, length) > self.limits[2]:
                take = int(max(loss_from - start, 0) + self.limits[2])
            self._place(item, start, take, 0)
            self.sequence += 1
            start, length = start + take, length - take
        while length and self._loss(start, length, loss_from, length) > self.limits[2]:
            take = int(max(loss_from - start, 0) + self.limits[2])
            self._wait(item, start, take, loss_from)
            start, length = start + take, length - take
        if length:
            self._wait(item, start, length, loss_from)

    @staticmethod
    def _loss(start: int, take: int, loss_from: int, length: int) -> int:
        end = start + min(take, length)
        return max(0, end - max(start, loss_from))

    def _wait(self, item, start: int, length: int, loss_from: int) -> None:
        if len(self.free) == 1:
            self.fill()
        at = self.free.pop()
        self.items[at] = (item, start, loss_from)
        self.need[at] = (length, 1, self._loss(start, length, loss_from, length))

    def _place(self, item, start: int, take: int, offset: int) -> None:
        self.out.append((item, start, take, self.sequence, offset))

    def fill(self) -> None:
        """Close one sequence from the waiting items."""
        left, offset = self.limits.copy(), 0
        scaled = self.need / self.limits
        while True:
            fits = (self.need <= left).all(axis=1) & (self.need[:, 1] > 0)
            score = np.where(fits, scaled @ (left / self.limits), -1.0)
            best = int(score.argmax())
            if score[best] < 0:
                break
            item, start, loss_from = self.items[best]
            take = int(self.need[best, 0])
            self._place(item, start, take, offset)
            left -= self.need[best]
            offset += take
            self.need[best] = scaled[best] = 0
            self.items[best] = None
            self.free.append(best)
        gap = int(left[0])
        if gap >= LEAST_CUT and left[1] >= 1 and (self.need[:, 0] > gap).any():
            score = np.where(self.need[:, 0] > gap, scaled @ (left / self.limits), -1.0)
            best = int(score.argmax())
            item, start, loss_from = self.items[best]
            length = int(self.need[best, 0])
            if self._loss(start, gap, loss_from, length) <= left[2]:
                self._place(item, start, gap, offset)
                self.items[best] = (item, start + gap, loss_from)
                rest = length - gap
                self.need[best] = (rest, 1, self._loss(start + gap, rest, loss_from, rest))
        self.sequence += 1

    def finish(self) -> None:
        while self.need[:, 1].any():
            self.fill()


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int,
    max_tokens: int = 2048,
    max_segments: int = 128,
    max_loss: int | None = None,
    prompt_tokens_col: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens.

    A document is its text's ids and end_id. prompt_tokens_col holds how many of its first
    ids bear no loss (null: none); max_loss limits loss-bearing ids in a sequence (by default
    it equals max_tokens); limits below 1 are an error. A row with a null id is a document and
    keeps the null. Null and empty texts are end_id alone. Rows that repeat an id are
    documents of their own. Long documents are cut, never shortened. No rows give no pieces.
    """
    max_loss = max_tokens if max_loss is None else max_loss
    if min(max_tokens, max_segments, max_loss) < 1:
        raise ValueError("a sequence must have room for a token, a segment and a token that bears loss")
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("loss_tokens", pa.int64())]

    def pack(batches):
        from pyspark import TaskContext

        codec = encoder(tokenizer_path)
        packer = Packer(max_tokens, max_segments, max_loss, TaskContext.get().partitionId() * PER_TASK)

        def pieces():
            columns: list[list] = [[] for _ in fields]
            for (doc_id, ids, loss_from), start, take, sequence, offset in packer.out:
                row = (doc_id, start, take, zlib.crc32(ids[start : start + take].tobytes()), len(ids), sequence, offset, Packer._loss(start, take, loss_from, take))
                for column, value in zip(columns, row, strict=True):
                    column.append(value)
            packer.out = []
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields])

        for batch in batches:
            ids, prompts = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for first, texts in text_batches(batch.column(1).to_pylist()):
                for k, tokens in enumerate(codec.encode(texts), first):
                    tokens = np.append(tokens, np.uint32(end_id)).astype("<u4", copy=False)
                    packer.add((ids[k], tokens, prompts[k] or 0), 0, len(tokens), prompts[k] or 0)
                yield pieces()
        packer.finish()
        yield pieces()

    prompt = f"cast(`{prompt_tokens_col}` as long)" if prompt_tokens_col else "cast(0 as long)"
    picked = docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text", f"{prompt} as prompt")
    return picked.mapInArrow(pack, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=1)
