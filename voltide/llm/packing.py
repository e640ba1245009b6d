"""Vector bin packing of token ids into training sequences.

Three limits hold at once in each sequence: tokens, segments (pieces) and
loss-bearing tokens. Which ids of an example bear loss is given by its segments
(a chat's turns), or as how many of its last ids do (a response after its
prompt); for plain documents all ids do.

Per input partition, in streaming order: what exceeds a sequence is cut off as
full ones; the remainders, no longer than a sequence each, wait in a pool of
bounded size. A bin takes the fitting example with the largest dot product of
its demand and the bin's free room, both as parts of the limits. When none fits
whole, the one with the largest dot product is cut to fill the bin exactly. What
is left at a partition's end is cut into sequences of a power of two, which need
no padding. No shuffle, no state beyond the pool.

Defined results: a null text is empty (only the end id); every input row is
packed, repeated rows and null ids too; examples of equal dot product are taken
in the order they came; a very long text leaves as full sequences, one of which
is held at a time beside its ids; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltide.llm import tokens
from voltide.llm.common import c, map_frames
from voltide.session import spread

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, n_loss long"


#: Power of a demand's length that the dot product is divided by.
NORM = 0.8


class Example:
    """What is left of an example: ``length`` ids from ``start`` on.

    ``loss_to`` counts the loss-bearing ids before each position; without it
    those from ``loss_from`` on bear loss."""

    __slots__ = ("doc_id", "ids", "base", "total", "start", "length", "loss_from", "loss_to", "part")

    def __init__(self, doc_id, ids: bytes, n_loss: int = 0, loss_to: np.ndarray | None = None, part=None):
        self.doc_id, self.ids, self.base, self.total, self.part = doc_id, ids, 0, len(ids) // 4, part
        self.start, self.length, self.loss_from, self.loss_to = 0, self.total, self.total - n_loss, loss_to

    def loss(self, start: int | None = None, length: int | None = None) -> int:
        start = self.start if start is None else start
        end = start + (self.length if length is None else length)
        if self.loss_to is None:
            return max(0, end - max(start, self.loss_from))
        return int(self.loss_to[end - self.base] - self.loss_to[start - self.base])

    def most(self, room: int, loss_room: int) -> int:
        """How many leading ids fit the room and the loss room."""
        n = min(self.length, room)
        if self.loss_to is None:
            return min(n, max(0, min(n, self.loss_from - self.start)) + loss_room)
        at = self.start - self.base
        return int(np.searchsorted(self.loss_to[at : at + n + 1], self.loss_to[at] + loss_room, "right")) - 1

    def piece(self, start: int, length: int) -> bytes:
        return self.ids[4 * (start - self.base) : 4 * (start - self.base + length)]

    def cut(self, length: int) -> Example:
        """The next ``length`` ids as an example that holds no others."""
        out = Example(self.doc_id, b"", part=self.part)
        out.ids, out.base, out.total = self.piece(self.start, length), self.start, self.total
        out.start, out.length, out.loss_from = self.start, length, self.loss_from
        if self.loss_to is not None:
            at = self.start - self.base
            out.loss_to = self.loss_to[at : at + length + 1].copy()
        self.start, self.length = self.start + length, self.length - length
        return out


class Packer:
    """Places examples; ``out`` collects finished pieces."""

    def __init__(self, capacity: int, max_segments: int, max_loss: int, pool: int):
        self.capacity, self.max_segments, self.max_loss, self.pool_size = capacity, max_segments, max_loss, pool
        self.pool: list[Example] = []
        self.sequence, self.out = 0, []

    def _write(self, e: Example, start: int, length: int, offset: int) -> None:
        self.out.append((e.doc_id, start, length, zlib.crc32(e.piece(start, length)), e.total, self.sequence, offset, e.loss(start, length), e.part))

    def add(self, e: Example) -> None:
        while e.length >= self.capacity and e.most(self.capacity, self.max_loss) == self.capacity:
            self._write(e, e.start, self.capacity, 0)
            e.start, e.length = e.start + self.capacity, e.length - self.capacity
            self.sequence += 1
        while e.length:  # where the loss limit binds, several cuts wait as examples
            self.pool.append(e.cut(min(e.length, self.capacity, max(1, self.max_loss) if e.length > self.capacity else e.length)))
            if len(self.pool) >= 2 * self.pool_size:
                self._fill(down_to=self.pool_size)

    def _fill(self, down_to: int) -> None:
        """Fill bins until the pool has ``down_to`` examples or fewer."""
        pool, left = self.pool, len(self.pool)
        tokens_ = np.array([e.length for e in pool], float)
        losses = np.array([e.loss() for e in pool], float)
        gone = np.zeros(len(pool), bool)
        size = np.hypot(tokens_ / self.capacity, losses / self.max_loss) ** NORM
        while left > down_to:
            room, segments, loss_room, bin_ = self.capacity, self.max_segments, self.max_loss, []
            while left and room > 0 and segments > 0 and loss_room > 0:
                # Each example takes one segment, so that term of the dot product is the same for all.
                score = (tokens_ * (room / self.capacity**2) + losses * (loss_room / self.max_loss**2)) / size
                whole = (tokens_ <= room) & (losses <= loss_room)
                best = int(np.where(whole, score, -1.0).argmax()) if segments > 1 else -1
                if best < 0 or not whole[best]:  # the last segment, or none fits whole: a cut fills the bin
                    score = np.where(gone, -1.0, score if segments > 1 else np.minimum(tokens_, room))
                    best = int(score.argmax())
                e = pool[best]
                n = e.most(room, loss_room)
                if not n:
                    break
                room, segments, loss_room = room - n, segments - 1, loss_room - e.loss(e.start, n)
                bin_.append((e, e.start, n))
                e.start, e.length = e.start + n, e.length - n
                if e.length:
                    tokens_[best], losses[best] = e.length, e.loss()
                else:
                    tokens_[best], losses[best], gone[best], left = np.inf, 0, True, left - 1
            self._close(bin_, left == 0 and room > 0)
        self.pool = [e for e, out in zip(pool, gone.tolist(), strict=True) if not out]

    def _close(self, bin_: list[tuple[Example, int, int]], last: bool) -> None:
        """Write the bin; an unfilled last bin as powers of two."""
        total = sum(n for _, _, n in bin_)
        sizes = [1 << k for k in range(total.bit_length() - 1, -1, -1) if total >> k & 1] if last else [total]
        at = 0
        for e, start, n in bin_:
            while n:
                take = min(n, sizes[0] - at)
                self._write(e, start, take, at)
                start, n, at = start + take, n - take, at + take
                if at == sizes[0]:
                    sizes.pop(0)
                    self.sequence, at = self.sequence + 1, 0

    def finish(self) -> None:
        if self.pool:
            self._fill(down_to=0)


def pack_examples(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", loss_col: str | None = None, segments_col: str | None = None, part_col: str | None = None, vocab_path: str | None = None, end_id: int = 1, capacity: int = 2048, max_segments: int | None = None, max_loss: int | None = None, pool: int = 512
) -> DataFrame:
    """One row per piece; ``sequence_id`` counts within each input partition.

    ``loss_col``: how many of the last ids of each example bear loss (null or
    none: all). ``segments_col``, in place of the text: array of (text, loss
    boolean); the end id bears loss. ``part_col``: a number that is handed on as
    ``part``. Limits: ``capacity`` tokens, ``max_segments`` pieces and
    ``max_loss`` loss-bearing tokens (default of both: ``capacity``).
    """
    max_segments, max_loss = max_segments or capacity, max_loss or capacity
    if min(capacity, max_segments, max_loss) < 1:
        raise ValueError("limits must be positive")
    vocab_path = vocab_path or tokens.default_vocab()
    content = F.transform(c(segments_col), lambda x: F.struct(x["text"].cast("string").alias("text"), F.coalesce(x["loss"].cast("boolean"), F.lit(False)).alias("loss"))) if segments_col else c(text_col).cast("string")
    cols = [c(id_col).cast("long").alias("doc_id"), content.alias("content"), (c(loss_col).cast("long") if loss_col else F.lit(None).cast("long")).alias("n_loss"), (c(part_col).cast("long") if part_col else F.lit(None).cast("long")).alias("part")]
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "n_loss", "part"]

    def examples(enc: tokens.WordEncoder, end: bytes, b: pd.DataFrame) -> Iterator[tuple[bytes, int | None, np.ndarray | None]]:
        for lo in range(0, len(b), 500):
            some = b.iloc[lo : lo + 500]
            if not segments_col:
                for ids, n in zip(enc.encode_all(some["content"].tolist()), some["n_loss"], strict=True):
                    yield ids + end, None if pd.isna(n) else int(n), None
                continue
            listed = [[] if x is None else list(x) for x in some["content"]]
            encoded = iter(enc.encode_all([s["text"] for x in listed for s in x]))
            for x in listed:
                found = [next(encoded) for _ in x]
                bears = np.repeat([*(s["loss"] for s in x), True], [*(len(ids) // 4 for ids in found), 1])
                yield b"".join(found) + end, 0, np.concatenate([[0], np.cumsum(bears)]).astype(np.int32)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, end, base = tokens.encoder(vocab_path), struct.pack("<I", end_id), TaskContext.get().partitionId() << 33
        packer = Packer(capacity, max_segments, max_loss, pool)

        def ready() -> pd.DataFrame:
            cols = dict(zip(names, zip(*packer.out, strict=True), strict=True))
            packer.out = []
            if not part_col:
                del cols["part"]
            return pd.DataFrame({k: pd.array(v, "Int64") for k, v in cols.items()}).assign(sequence_id=lambda d: d["sequence_id"] + base)

        for b in batches:
            for d, part, (ids, n_loss, loss_to) in zip(b["doc_id"], b["part"], examples(enc, end, b), strict=True):
                n = len(ids) // 4
                packer.add(Example(None if pd.isna(d) else int(d), ids, n if n_loss is None else max(0, min(n, n_loss)), loss_to, None if pd.isna(part) else int(part)))
                if len(packer.out) > 20_000:
                    yield ready()
        packer.finish()
        if packer.out:
            yield ready()

    return map_frames(spread(docs.select(*cols)), run, PIECES + (", part long" if part_col else ""))


def instruction_examples(turns: DataFrame, most: int = 64) -> DataFrame:
    """(conv_id, part, segments) of repaired turns: assistant turns bear loss. A
    conversation is cut after ``most`` rows, so that none is gathered whole."""
    rows = turns.withColumn("part", F.expr(f"seq div {most}"))
    listed = rows.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(F.struct("seq", F.col("rendered").alias("text"), (F.col("role_out") == "assistant").alias("loss")))).alias("segments"))
    return listed.select("conv_id", "part", F.transform("segments", lambda x: F.struct(x["text"].alias("text"), x["loss"].alias("loss"))).alias("segments"))
