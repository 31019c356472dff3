"""Vector bin packing of training examples by the dot-product heuristic.

A sequence has room for so many tokens, segments (pieces) and loss-bearing
tokens; an example's first ids are its prompt, which bears no loss. Into an open
sequence goes, of the examples that fit whole in all three, the one with the
largest dot product of its demand and the room left, each dimension measured by
its limit and weighted by how much of it the waiting examples need. Where none
fits whole, the piece that fills most is cut off an example and its rest waits on.
Examples longer than a sequence are begun first, prompt and response apart, so
that responses can be completed by prompts where loss-bearing tokens run out.

A sequence that can't be filled (segments or loss used up, no examples left) is
cut back to a power of two, where it needs no padding; what is cut off waits on.

Each task packs its own examples out of a bounded number of waiting ones
(``WAITING`` examples or ``WAITING_IDS`` ids, besides one batch), so nothing is
shuffled and no group of equal keys meets in one task. The result is a written
table: places don't change when it is read again.

Rows: a null text is an empty text, that is the end id alone. Equal rows are
packed each on its own; ties go to the example that has waited longest. A null id
is kept. An empty table gives an empty result. Extra columns are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortline.llm.common import settle, text_batches
from cohortline.llm.packing import encoder

TOKENS, SEGMENTS, LOSS = 4096, 128, 3584
#: Examples without a prompt of their own: this share of the ids, rounded down, stands for it.
PROMPT_SHARE = 0.25
WAITING, WAITING_IDS = 768, 2_000_000
PLACED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, loss_tokens long, sequence_id long, offset long"


class Packer:
    """Sequences out of waiting examples; ``fill`` returns the pieces (example, first id, id behind) of one."""

    def __init__(self, tokens: int = TOKENS, segments: int = SEGMENTS, loss: int = LOSS):
        if tokens < 1 or segments < 1 or loss < 1:
            raise ValueError("limits are at least 1")
        self.limits = np.array([tokens, segments, loss], float)
        self.tokens, self.segments, self.loss = tokens, segments, loss
        self.items: list = []  # (example, first id, id behind, first loss-bearing id) or None
        self.free: list[int] = []
        self.size = np.zeros((2, 64))  # tokens and loss-bearing tokens of the items, 0 where there is none
        self.waiting, self.ids = 0, 0

    def _put(self, example, lo: int, hi: int, prompt: int) -> None:
        if not self.free:
            self.free = list(range(len(self.items) + 63, len(self.items) - 1, -1))
            self.items += [None] * 64
            if len(self.items) > self.size.shape[1]:
                self.size = np.concatenate([self.size, np.zeros_like(self.size)], axis=1)
        at = self.free.pop()
        self.items[at] = (example, lo, hi, prompt)
        self.size[:, at] = hi - lo, hi - max(lo, min(prompt, hi))
        self.waiting += 1
        self.ids += hi - lo

    def _take(self, at: int, n: int) -> tuple:
        """The first n ids of an item; its rest stays in its place."""
        example, lo, hi, prompt = self.items[at]
        self.ids -= n
        if lo + n == hi:
            self.items[at] = None
            self.size[:, at] = 0
            self.free.append(at)
            self.waiting -= 1
        else:
            self.items[at] = (example, lo + n, hi, prompt)
            self.size[:, at] = hi - lo - n, hi - max(lo + n, min(prompt, hi))
        return example, lo, lo + n, prompt

    def add(self, example, length: int, prompt: int) -> None:
        """An example of ``length`` ids, the first ``prompt`` of them without loss."""
        if length > self.tokens and 0 < prompt < length:
            self._put(example, 0, prompt, prompt)
            self._put(example, prompt, length, prompt)
        elif length:
            self._put(example, 0, length, prompt)

    def fill(self) -> list[tuple]:
        need, bears = self.size[0], self.size[1]
        weight = np.array([need.sum(), self.waiting, bears.sum()]) / self.limits
        weight /= weight.sum()
        room, parts = self.limits.copy(), []
        while room[0] and room[1] and self.waiting:
            pull = weight * room / self.limits / self.limits
            whole = (need > 0) & (need <= room[0]) & (bears <= room[2])
            cut = np.minimum(np.minimum(need, room[0]), need - bears + room[2])
            worth = pull[0] * need + pull[2] * bears
            if not parts and need.max() > self.tokens:
                # the longest prefix of the long example that fills most
                at = int(np.argmax(np.where(need > self.tokens, pull[0] * cut + pull[2] * np.minimum(cut, bears), -1)))
                n = int(cut[at])
            elif room[1] > 1 and whole.any():
                at = int(np.argmax(np.where(whole, worth, -1)))
                n = int(need[at])
            else:
                at = int(np.argmax(cut))
                n = int(cut[at])
                if n <= 0:
                    break
            piece = self._take(at, n)
            parts.append(piece)
            room -= (n, 1, piece[2] - max(piece[1], min(piece[3], piece[2])))
        return self._trimmed(parts, self.tokens - int(room[0]))

    def _trimmed(self, parts: list[tuple], used: int) -> list[tuple]:
        keep = used if used == self.tokens else 1 << (used.bit_length() - 1)
        while used > keep:
            example, lo, hi, prompt = parts.pop()
            back = min(hi - lo, used - keep)
            self._put(example, hi - back, hi, prompt)
            if hi - back > lo:
                parts.append((example, lo, hi - back, prompt))
            used -= back
        return parts


def pack(
    examples: DataFrame, tokenizer: str, end_id: int = 2, prompt: str | None = None, prompt_share: float = PROMPT_SHARE,
    tokens: int = TOKENS, segments: int = SEGMENTS, loss: int = LOSS, with_ids: bool = False,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, loss_tokens, sequence_id, offset (and ids).

    ``examples`` has doc_id and text. ``prompt`` names a text column that comes
    before the text and bears no loss; without it the first ``prompt_share`` of
    an example's ids is its prompt.
    """
    text_batches(examples.sparkSession)
    Packer(tokens, segments, loss)
    end = end_id.to_bytes(4, "little")
    names = [c.split()[0] for c in PLACED.split(", ")] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, packer = encoder(tokenizer), Packer(tokens, segments, loss)
        first = TaskContext.get().partitionId() << 40
        made = 0

        def rows(least: int, least_ids: int) -> pa.RecordBatch:
            nonlocal made
            columns: list[list] = [[] for _ in names]
            while packer.waiting > least or packer.ids > least_ids:
                at = 0
                for (doc, ids), lo, hi, before in packer.fill():
                    piece = ids[4 * lo : 4 * hi]
                    row = (doc, lo, hi - lo, zlib.crc32(piece), len(ids) // 4, hi - max(lo, min(before, hi)), first + made, at)
                    for c, v in zip(columns, (*row, np.frombuffer(piece, "<u4")) if with_ids else row):
                        c.append(v)
                    at += hi - lo
                made += 1
            arrays = [pa.array(c, pa.int64()) for c in columns[:8]]
            return pa.RecordBatch.from_arrays(arrays + [pa.array(c, pa.list_(pa.int64())) for c in columns[8:]], names=names)

        for b in batches:
            after = enc.encode_all(b.column(1))
            before = enc.encode_all(b.column(2)) if prompt else [after[0][:0]] * len(after) if after else []
            for doc, x, y in zip(b.column(0).to_pylist(), before, after):
                ids = x.tobytes() + y.tobytes() + end
                length = len(ids) // 4
                packer.add((doc, ids), length, len(x) if prompt else int(length * prompt_share))
            yield rows(WAITING, WAITING_IDS)
        yield rows(0, 0)

    columns = [F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).cast("string").alias(f"t{i}") for i, c in enumerate(["text", prompt]) if c]]
    return settle(examples.select(*columns).mapInArrow(run, PLACED + ", ids array<long>" * with_ids))
