"""Best-fit decreasing packing of tokenised documents into fixed windows.

Overlong documents are cut into full windows first; the rest of each is at most one shorter
piece. Best-fit decreasing looks at lengths only, and there are at most ``window`` of them. So
one aggregate counts the pieces of each length, and the exact algorithm runs over these counts
on the driver: all open windows with equal remaining capacity are one class of the segment tree,
and a run of equal pieces fills whole classes at once. Its work and the size of the resulting
table depend on ``window``, not on the number of documents. The runs then tell every piece its
window and offset from its rank among the pieces of its length; ranks come from counts of small
buckets, so that a length shared by a third of all documents is still dealt over many tasks.
"""

from __future__ import annotations

import json
import zlib
from collections import defaultdict, deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from entityspark.llm.textio import cut, steps, texts

#: How byte-level BPE pre-splits a text (fixed by the tokenizer's format).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Rows of one ranking bucket, about.
BUCKET_ROWS = 50_000


def _byte_of_char() -> dict[str, int]:
    """Byte-level BPE writes printable bytes as themselves and the others from code point 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@lru_cache(maxsize=2)
def _encoder(path: str) -> tuple[tiktoken.Encoding, Tokenizer, list[str]]:
    """The vocabulary of a byte-level BPE file in the faster library, the file's own tokenizer, and its added tokens.

    Both give the same ids to a text without an added token's string; tests compare them.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    added = [x["content"] for x in spec["added_tokens"]]
    byte = _byte_of_char()
    ranks = {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in added}
    return tiktoken.Encoding("byte_bpe", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}), Tokenizer.from_file(path), added


def token_ids(text: str, path: str) -> np.ndarray:
    """The ids of a text as uint32, those of the file's tokenizer without tokens added around it."""
    fast, own, added = _encoder(path)
    try:
        if not any(token in text for token in added):
            return fast.encode_to_numpy(text, disallowed_special=())
    except BaseException as e:  # the fast library's matcher gives up on some very long runs
        if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
            raise
    return np.array(own.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


def pieces(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """The pieces of every document: ``id_col, start, length, ids_crc32, doc_tokens`` (and ``ids``).

    A document is its ids and then ``end_id``; every full window is a piece, then the rest. ids
    are little-endian unsigned 32-bit numbers. Null and empty texts are one piece of one token.
    Repeated rows give repeated pieces; a null id stays null. Other columns are not read.
    """
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "t"):
            row, start, length, crc, total, ids = [], [], [], [], [], []
            for i, text in enumerate(texts(batch, "t")):
                data = token_ids(text.decode("utf-8", "replace"), tokenizer).astype("<u4").tobytes() + end_id.to_bytes(4, "little")
                n = len(data) // 4
                for s in range(0, n, window):
                    part = data[4 * s : 4 * (s + window)]
                    row.append(i)
                    start.append(s)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    total.append(n)
                    if with_ids:
                        ids.append(part)
            columns = [batch.column(0).take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.binary())] * with_ids, names=names)

    schema = f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, schema)


class CapacityTree:
    """Segment tree over remaining capacities 0..size; finds the least capacity in use from a given one."""

    def __init__(self, size: int) -> None:
        self.leaves = 1 << size.bit_length()
        self.used = [False] * (2 * self.leaves)

    def mark(self, capacity: int, used: bool) -> None:
        i = capacity + self.leaves
        self.used[i] = used
        while i > 1:
            i //= 2
            self.used[i] = self.used[2 * i] or self.used[2 * i + 1]

    def tightest(self, least: int) -> int | None:
        i = least + self.leaves
        if self.used[i]:
            return least
        while i > 1:
            if i % 2 == 0 and self.used[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.used[2 * i] else 2 * i + 1
                return i - self.leaves
            i //= 2
        return None


def best_fit_decreasing(counts: dict[int, int], window: int) -> list[tuple[int, int, int, int, int]]:
    """Runs ``(length, first rank, pieces a window, first window, offset)`` of exact best-fit decreasing.

    Pieces of one length, by rank, fill a run's windows one after another. A run ends where the
    next one of its length begins.
    """
    tree, open_at, runs, windows = CapacityTree(window), defaultdict(deque), [], 0

    def put(capacity: int, first: int, number: int) -> None:
        if number and capacity:
            open_at[capacity].append((first, number))
            tree.mark(capacity, True)

    for length in sorted((x for x in counts if counts[x] > 0), reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                room, first, number = window, windows, -(-left // (window // length))
                windows += number
            else:
                first, number = open_at[room].popleft()
                if not open_at[room]:
                    tree.mark(room, False)
            each = room // length
            full = min(number, left // each)
            runs.append((length, rank, each, first, window - room))
            put(room - each * length, first, full)
            rank, left = rank + full * each, left - full * each
            if left and full < number:  # the last window of this length takes fewer
                put(room - left * length, first + full, 1)
                full, left = full + 1, 0
            put(room, first + full, number - full)
    return runs


def pack(found: DataFrame, window: int = 2048, id_col: str = "doc_id") -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces (see ``pieces``), by best-fit decreasing.

    Each sequence is gapless from offset 0. ``found`` should be stored: it is read three times.
    No pieces give no rows.
    """
    spark = found.sparkSession
    counts = {int(r["length"]): int(r["n"]) for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `window` rows
    runs = sorted(best_fit_decreasing(counts, window))
    columns = list(found.columns)
    sizes = counts or {0: 1}
    dealt_to = {"length": pa.array(sizes.keys(), pa.int64()), "buckets": pa.array([-(-n // BUCKET_ROWS) for n in sizes.values()], pa.int64())}
    buckets = spark.createDataFrame(pa.table(dealt_to))  # from Arrow: a list would start a second Python daemon on each executor, which stays
    dealt = found.join(F.broadcast(buckets), "length").withColumn("bucket", F.pmod(F.xxhash64(id_col, "start", "ids_crc32"), F.col("buckets")))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n")).select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = dealt.withColumn("place", F.row_number().over(Window.partitionBy("length", "bucket").orderBy(id_col, "start", "ids_crc32"))).join(offsets, ["length", "bucket"])
    ranked = ranked.select(*columns, (F.col("base") + F.col("place") - 1).alias("rank"))

    span = max([1, *counts.values()]) + 1  # one number orders (length, rank)
    starts = np.array([r[0] * span + r[1] for r in runs] or [0], dtype=np.int64)
    first_rank, each, first_window, offset = (np.array([r[k] for r in runs] or [1], dtype=np.int64) for k in (1, 2, 3, 4))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            length, rank = at["length"].to_numpy(), at["rank"].to_numpy()
            run = np.searchsorted(starts, length * span + rank, "right") - 1
            inside = rank - first_rank[run]
            sequence = first_window[run] + inside // each[run]
            where = offset[run] + inside % each[run] * length
            yield pa.RecordBatch.from_arrays([*(at[c] for c in columns), pa.array(sequence), pa.array(where)], names=[*columns, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema.fields)
    return ranked.mapInArrow(place, schema + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Tokenises, cuts and packs ``docs``; see ``pieces`` and ``pack``."""
    return pack(cut(pieces(docs, tokenizer, window, end_id, id_col, text_col, with_ids)), window, id_col)
