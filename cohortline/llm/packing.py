"""Best-fit packing planned on the histogram of lengths.

Texts are tokenised once into pieces of at most ``capacity`` ids. The number of
pieces of each length (at most ``capacity`` numbers) goes to the driver, which
packs counts instead of pieces, longest first, each length into the fullest bins
it still fits; equal bins are kept as one group, so a step places many pieces.
The plan says, for each length, which ranks go to which sequences and offsets.
Pieces then get their rank within their length and join the plan on it.

Rows: a null text is an empty text, that is the end id alone. Equal rows are
packed each on its own. An empty table gives an empty result. Extra columns of
the input are left out.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortline.llm.common import number_within, settle, text_batches

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"

#: Chunks and words whose ids a worker remembers, and ids it keeps for them; beyond that it starts anew.
REMEMBERED, KEPT_IDS = 1 << 21, 1 << 25
#: Bytes that are hashed at once.
WINDOW = 1 << 20

# A run of Latin letters, then ASCII marks: exactly one word and at most one run of marks for the tokenizer.
_PLAIN = re.compile(r"([a-zA-Zà-öø-ÿÀ-ÖØ-Þß]+)([.,;:!?$%*#&()]*)\Z")

_ENCODERS: dict[str, ChunkEncoder] = {}
_TRUE = np.ones(1, bool)


class _Numbers:
    """A hash table from 64-bit keys (not 0) to numbers, asked and filled by whole arrays."""

    def __init__(self, bits: int):
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 where it has none."""
        out = np.full(len(keys), -1, np.int32)
        todo, slot = np.arange(len(keys)), self._slots(keys)
        while len(todo):
            there, want = self.keys[slot], keys[todo]
            hit = there == want
            out[todo[hit]] = self.values[slot[hit]]
            on = ~hit & (there != 0)
            todo, slot = todo[on], (slot[on] + 1) & self.mask
        return out

    def add(self, keys: np.ndarray, first: int) -> None:
        """Number new, distinct keys from ``first`` on."""
        todo, slot = np.arange(len(keys)), self._slots(keys)
        while len(todo):
            free = np.flatnonzero(self.keys[slot] == 0)
            _, lead = np.unique(slot[free], return_index=True)
            won = free[lead]
            self.keys[slot[won]] = keys[todo[won]]
            self.values[slot[won]] = first + todo[won]
            rest = np.ones(len(todo), bool)
            rest[won] = False
            todo, slot = todo[rest], (slot[rest] + 1) & self.mask


class ChunkEncoder:
    """Ids of texts by way of what stands between two spaces.

    The tokenizer never joins characters over white space, so a text's ids are
    those of its chunks one after the other, and a chunk is encoded only once.
    Chunks are told apart by 64-bit hashes of their bytes, which NumPy makes for a
    batch at once; so are their ids looked up and put together. Plain chunks go on
    to their word and their marks, which repeat more often.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        # Lower-case words of Latin letters between spaces need neither the normaliser nor the splitting expression.
        self.of_words = Tokenizer.from_file(path)
        self.of_words.no_padding()
        self.of_words.no_truncation()
        self.of_words.normalizer = None
        self.of_words.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        rng = np.random.default_rng(20240229)
        self.byte = rng.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = int(rng.integers(1 << 60, 1 << 61)) * 8 + 3
        self.power = self.back = np.ones(1, np.uint64)
        self._forget()

    def _forget(self) -> None:
        self.numbers = _Numbers(REMEMBERED.bit_length())
        self.ids = np.zeros(1 << 16, np.uint32)  # of all chunks, one after the other
        self.ends = np.zeros(1 << 12, np.int64)  # chunk n has ids[ends[n] : ends[n + 1]]
        self.chunks = 0
        self.parts: dict[str, bytes] = {"": b""}

    def encode(self, text: str) -> bytes:
        return self.encode_all(pa.array([text]))[0].tobytes()

    def encode_all(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text (null: none) as little-endian unsigned 32-bit numbers."""
        if not len(texts):
            return []
        texts = texts.fill_null("").cast(pa.large_string())
        if self.chunks > REMEMBERED // 2 or self.ends[self.chunks] > KEPT_IDS:
            self._forget()
        edge = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = texts.buffers()[2]
        raw = np.frombuffer(data, np.uint8)[edge[0] : edge[-1]] if data is not None else np.zeros(0, np.uint8)
        edge = edge - edge[0]
        gap = (raw == 32) | (raw == 10)
        fresh = np.zeros(len(raw) + 1, bool)  # a text begins here
        fresh[edge] = True
        starts = np.flatnonzero(~gap & (np.concatenate((_TRUE, gap[:-1])) | fresh[:-1]))
        stops = np.flatnonzero(~gap & (np.concatenate((gap[1:], _TRUE)) | fresh[1:])) + 1
        number = self._numbered(raw, starts, stops)
        begin, size = self.ends[number], np.diff(self.ends[: self.chunks + 1])[number]
        after = np.concatenate(([0], np.cumsum(size)))
        at = np.repeat(begin - after[:-1], size) + np.arange(after[-1])
        ids = self.ids[at].astype("<u4", copy=False)
        cut = after[np.searchsorted(starts, edge)]
        return [ids[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]

    def _keys(self, raw: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """A hash of each chunk's bytes: differences of running sums of byte codes times powers of an odd number."""
        out, i = np.zeros(len(starts), np.uint64), 0
        while i < len(starts):
            low = starts[i]
            j = max(i + 1, int(np.searchsorted(stops, low + WINDOW, side="right")))
            high = int(stops[j - 1])
            self._powers(high - low + 1)
            sums = np.zeros(high - low + 1, np.uint64)
            np.cumsum(self.byte[raw[low:high]] * self.power[: high - low], out=sums[1:])
            a, b = starts[i:j] - low, stops[i:j] - low
            out[i:j] = (sums[b] - sums[a]) * self.back[a] + (b - a).astype(np.uint64)
            i = j
        out ^= out >> np.uint64(32)
        out *= np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
        out[out == 0] = 1
        return out

    def _powers(self, n: int) -> None:
        if len(self.power) < n:
            n = max(n, WINDOW + 1)
            inverse = pow(self.base, -1, 1 << 64)
            self.power, self.back = (
                np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(n - 1, b, np.uint64)))) for b in (self.base, inverse)
            )

    def _numbered(self, raw: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """Numbers of the chunks; new ones are encoded first."""
        keys = self._keys(raw, starts, stops)
        number = self.numbers.find(keys)
        missing = np.flatnonzero(number < 0)
        if len(missing):
            new, first, of = np.unique(keys[missing], return_index=True, return_inverse=True)
            text, where = raw.tobytes(), missing[first]
            self._learn([text[a:b].decode() for a, b in zip(starts[where].tolist(), stops[where].tolist())])
            made = self.chunks - len(new)
            if 2 * self.chunks > len(self.numbers.keys):  # a batch of more new chunks than are remembered
                self._grow()
            self.numbers.add(new, made)
            number[missing] = made + of
        return number

    def _grow(self) -> None:
        old = self.numbers
        self.numbers = _Numbers((2 * self.chunks).bit_length())
        held = np.flatnonzero(old.keys)
        order = np.argsort(old.values[held])
        self.numbers.add(old.keys[held][order], 0)

    def _learn(self, chunks: list[str]) -> None:
        """Number and encode new chunks; their plain words in a few calls, which share the cost of a call."""
        parts, plain = self.parts, []
        for c in chunks:
            if c.isascii() and c.isalpha():
                plain.append((c.lower(), ""))
            elif m := _PLAIN.match(c):
                plain.append((m[1].lower(), m[2]))
            else:
                plain.append((None, c))
        words = list({w for w, _ in plain if w is not None}.difference(parts))
        for i in range(0, len(words), 256):
            some = words[i : i + 256]
            found = self.of_words.encode(" ".join(some), add_special_tokens=False)
            ids = np.array(found.ids, "<u4").tobytes()
            ends = (4 * np.searchsorted(np.array(found.word_ids), np.arange(len(some)), side="right")).tolist()
            at = 0
            for word, end in zip(some, ends):
                parts[word] = ids[at:end]
                at = end
        for marks in {m for w, m in plain if w is not None}.difference(parts):
            parts[marks] = self._whole(marks)
        made = [parts[w] + parts[m] if w is not None else self._whole(m) for w, m in plain]
        size = np.fromiter(map(len, made), np.int64, len(made)) // 4
        new = np.frombuffer(b"".join(made), "<u4")
        top = int(self.ends[self.chunks])
        while len(self.ends) < self.chunks + len(made) + 1:
            self.ends = np.concatenate((self.ends, np.zeros_like(self.ends)))
        while len(self.ids) < top + len(new):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        self.ids[top : top + len(new)] = new
        self.ends[self.chunks + 1 : self.chunks + len(made) + 1] = top + np.cumsum(size)
        self.chunks += len(made)

    def _whole(self, piece: str) -> bytes:
        return np.array(self.tokenizer.encode(piece, add_special_tokens=False).ids, "<u4").tobytes()


def encoder(path: str) -> ChunkEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""
    text_batches(docs.sparkSession)
    end = end_id.to_bytes(4, "little")
    step = 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [], [])
            for doc, found in zip(batch.column(0).to_pylist(), enc.encode_all(batch.column(1))):
                ids = found.tobytes() + end
                for n, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    for col, v in zip(rows, (doc, n, at // 4, len(part) // 4, zlib.crc32(part))):
                        col.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int32()), *[pa.array(c, pa.int64()) for c in rows[2:]]],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Entries (length, first rank, first sequence, pieces per sequence, offset) by length and rank.

    Ranks from an entry's first rank on (up to the next entry of the length) fill
    sequence after sequence, so many pieces each, from the offset on.
    """
    free: list[int] = []  # distinct free room, ascending
    bins: dict[int, list[tuple[int, int]]] = {}  # free room -> groups (first sequence, how many)
    out, made = [], 0

    def keep(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in bins:
                bins[room] = []
                bisect.insort(free, room)
            bins[room].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, need = 0, counts[length]
        while need:
            i = bisect.bisect_left(free, length)
            if i < len(free):
                room = free[i]
                first, n = bins[room].pop()
                if not bins[room]:
                    del bins[room]
                    free.pop(i)
            else:
                room, first = capacity, made
                n = -(-need // (capacity // length))
                made += n
            each = room // length
            full = min(n, need // each)
            if full:
                out.append((length, rank, first, each, capacity - room))
                keep(room - each * length, first, full)
                rank, need = rank + full * each, need - full * each
            if full < n:
                if 0 < need < each:
                    out.append((length, rank, first + full, each, capacity - room))
                    keep(room - need * length, first + full, 1)
                    full, rank, need = full + 1, rank + need, 0
                keep(room, first + full, n - full)
    return out


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Pieces with the sequence_id and offset that the plan gives them.

    The plan has a few entries per length, so its size depends on ``capacity``
    alone; that is why it may be collected and broadcast.
    """
    cut = settle(pieces(docs, tokenizer, capacity, end_id))
    counts = {int(r[0]): int(r[1]) for r in cut.groupBy("length").count().collect()}
    by_length: dict[int, list[tuple[int, int, int, int]]] = {}
    for length, *entry in plan(counts, capacity):
        by_length.setdefault(length, []).append(tuple(entry))
    spark = docs.sparkSession
    planned = spark.createDataFrame(
        list(by_length.items()),
        "length long, entries array<struct<rank:long, first:long, each:long, at:long>>",
    )
    ranked = number_within(cut, ["length"], ["doc_id", "piece"], "rank")
    joined = ranked.join(F.broadcast(planned), "length")
    longest = max((len(x) for x in by_length.values()), default=1)
    steps = F.array(*[F.lit(1 << i) for i in range(longest.bit_length(), -1, -1)])
    found = F.aggregate(
        steps,
        F.lit(0),
        lambda at, step: F.when(F.get("entries", at + step)["rank"] <= F.col("rank"), at + step).otherwise(at),
    )
    placed = joined.withColumn("entry", F.get("entries", found))
    inside = F.col("rank") - F.col("entry.rank")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("entry.first") + F.expr("(rank - entry.rank) div entry.each")).cast("long").alias("sequence_id"),
        (F.col("entry.at") + (inside % F.col("entry.each")) * F.col("length")).cast("long").alias("offset"),
    )
