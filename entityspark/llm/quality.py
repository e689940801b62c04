"""Quality classifier: a factorisation machine over hashed words and structure statistics.

The pairwise part of a row is scored in linear time: for every factor, half of the squared sum
minus the sum of squares. Features are built in the tasks; the model is fitted on a bounded
sample of labelled rows and sent to the tasks whole (its size is fixed).
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entityspark.llm.textio import map_rows, steps, texts

WORD_BITS = 15
WORDS = 1 << WORD_BITS

#: Character classes whose shares of the bytes are structure statistics.
CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "blank": b" \t", "line": b"\n", "comma": b",;:", "stop": b".?", "shout": b"!", "bar": b"|", "sign": b"#$%&*@^~<>{}[]=+_\\/"}
STATS = [*CLASSES, "length", "words", "word_length", "distinct", "top_word", "upper_words", "signed_words", "repeated_lines", "stutter"]
BINS = 12


def structure(text: bytes, words: list[bytes], counts: Counter) -> list[float]:
    """The structure statistics and metadata (lengths) of a text, in the order of STATS."""
    n = max(1, len(text))
    shares = [sum(map(text.count, (bytes([b]) for b in members))) / n for members in CLASSES.values()] if n < 64 else _shares(text)
    m = max(1, len(words))
    lines = [x for x in text.split(b"\n") if x]
    return [
        *shares, float(np.log1p(len(text))), float(np.log1p(len(words))), len(text) / m, len(counts) / m, max(counts.values(), default=0) / m,
        sum(w.isupper() for w in words) / m, sum(not w[-1:].isalnum() and w[-1] < 128 and w[-1:] not in b".,;:" for w in words) / m,
        1 - len(set(lines)) / max(1, len(lines)), sum(map(eq, words, words[1:])) / m,
    ]


_CLASS_OF = np.full(256, len(CLASSES), np.uint8)
for _i, _members in enumerate(CLASSES.values()):
    _CLASS_OF[list(_members)] = _i


def _shares(text: bytes) -> list[float]:
    counts = np.bincount(_CLASS_OF[np.frombuffer(text, np.uint8)], minlength=len(CLASSES) + 1)[: len(CLASSES)]
    return (counts / len(text)).tolist()


def row_features(text: bytes) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Hashed lower-cased words, their weights (unit length together), and the structure statistics."""
    words = text.split()
    counts = Counter(words)
    folded = Counter(text.lower().split())
    index = np.fromiter((zlib.crc32(w) & (WORDS - 1) for w in folded), np.int32, len(folded))
    weight = np.log1p(np.fromiter(folded.values(), np.float32, len(folded)))
    return index, weight / max(1e-6, float(np.sqrt((weight * weight).sum()))), structure(text, words, counts)


@dataclass
class FactorisationMachine:
    """Bias, linear weights and factors; the features after the words are one-hot bins of the statistics."""

    edges: np.ndarray  # statistics x (BINS - 1)
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    @staticmethod
    def size() -> int:
        return WORDS + len(STATS) * BINS

    def features(self, index: np.ndarray, weight: np.ndarray, stats: list[float]) -> tuple[np.ndarray, np.ndarray]:
        bins = (np.asarray(stats)[:, None] >= self.edges).sum(axis=1)
        return np.concatenate([index, WORDS + np.arange(len(STATS), dtype=np.int32) * BINS + bins.astype(np.int32)]), np.concatenate([weight, np.full(len(STATS), len(STATS) ** -0.5, np.float32)])

    def margins(self, index: np.ndarray, value: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Margins of rows that begin at ``starts``, the per-entry factor products and the per-row factor sums."""
        products = self.factors[index] * value[:, None]
        sums = np.add.reduceat(products, starts)
        pairs = 0.5 * ((sums * sums).sum(axis=1) - np.add.reduceat((products * products).sum(axis=1), starts))
        return self.bias + np.add.reduceat(self.linear[index] * value, starts) + pairs, products, sums

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 8, batch: int = 64, rate: float = 0.1, decay: float = 1e-4, seed: int = 1) -> None:
        """Logistic loss, AdaGrad, rows in a seeded order."""
        order = np.random.default_rng(seed)
        seen_l, seen_f, seen_b = np.full(self.linear.shape, 1e-4), np.full(self.factors.shape, 1e-4), 1e-4
        for _ in range(epochs):
            for part in np.array_split(order.permutation(len(rows)), -(-len(rows) // batch)):
                lengths = np.array([len(rows[i][0]) for i in part])
                index, value = np.concatenate([rows[i][0] for i in part]), np.concatenate([rows[i][1] for i in part])
                margin, products, sums = self.margins(index, value, np.cumsum(lengths) - lengths)
                slope = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[part]) / len(part)
                each = np.repeat(slope, lengths)
                unique, where = np.unique(index, return_inverse=True)
                gl = np.bincount(where, weights=each * value) + decay * self.linear[unique]
                per = (each * value)[:, None] * (np.repeat(sums, lengths, axis=0) - products)
                gf = np.stack([np.bincount(where, weights=per[:, k]) for k in range(per.shape[1])], axis=1) + decay * self.factors[unique]
                seen_l[unique] += gl * gl
                seen_f[unique] += gf * gf
                seen_b += slope.sum() ** 2
                self.linear[unique] -= rate * gl / np.sqrt(seen_l[unique])
                self.factors[unique] -= rate * gf / np.sqrt(seen_f[unique])
                self.bias -= rate * slope.sum() / np.sqrt(seen_b)


def train(labelled: DataFrame, text_col: str = "text", label_col: str = "label", sample_rows: int = 8_000, factors: int = 8) -> FactorisationMachine:
    """Fits a machine on at most ``sample_rows`` rows of ``labelled`` (a documented bound).

    The rows are put in the order of a hash of text and label, so that the same rows give the same
    machine however they arrive. Rows with a null label are left out. Features are built in the
    tasks; only they reach the driver. Without rows every score is 0.5.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "t"):
            rows = [row_features(t) for t in texts(batch, "t")]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array([r[0].tolist() for r in rows], pa.list_(pa.int32())), pa.array([r[1].tolist() for r in rows], pa.list_(pa.float32())), pa.array([r[2] for r in rows], pa.list_(pa.float64()))], names=["y", "at", "i", "w", "s"])

    found = labelled.where(F.col(label_col).isNotNull()).select(F.col(text_col).alias("t"), F.col(label_col).cast("double").alias("y"))
    found = found.withColumn("at", F.xxhash64("t", "y")).orderBy("at", "t", "y").limit(sample_rows)
    table = found.mapInArrow(run, "y double, at long, i array<int>, w array<float>, s array<double>").toArrow()
    n = table.num_rows
    machine = FactorisationMachine(np.zeros((len(STATS), BINS - 1)), 0.0, np.zeros(FactorisationMachine.size(), np.float32), np.random.default_rng(0).normal(0, 0.01, (FactorisationMachine.size(), factors)).astype(np.float32))
    if n:
        stats = np.concatenate([c.flatten().to_numpy() for c in table.column("s").chunks]).reshape(n, -1)
        machine.edges = np.quantile(stats, np.arange(1, BINS) / BINS, axis=0).T
        labels = table.column("y").to_numpy()
        order = np.lexsort((labels, table.column("at").to_numpy()))
        parts, rows = table.to_batches()[::-1], []
        del table
        while parts:  # each is let go once its rows are built, so that the sample is in memory once
            part = parts.pop()
            index, weight = (part.column(c).flatten().to_numpy() for c in ("i", "w"))
            cuts = np.cumsum([0, *pc.list_value_length(part.column("i")).to_pylist()])
            rows += [machine.features(index[a:b], weight[a:b], s) for a, b, s in zip(cuts, cuts[1:], stats[len(rows) :])]
        del part, index, weight
        pa.default_memory_pool().release_unused()
        machine.fit([rows[i] for i in order], labels[order])
    else:
        machine.factors[:] = 0
    return machine


def score(docs: DataFrame, machine: FactorisationMachine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, score)`` per row, from the text alone; null counts as empty, and empty texts get a score too.

    Repeated rows and null ids are kept; other columns are not read. An empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in steps(batches, "t"):
            rows = [own.features(*row_features(t)) for t in texts(batch, "t")]
            lengths = np.array([len(r[0]) for r in rows])
            margin, _, _ = own.margins(np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]), np.cumsum(lengths) - lengths)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(margin, -30, 30))), pa.float64())], names=[id_col, "score"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, f"`{id_col}` {kind}, score double")


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", sample_rows: int = 8_000, text_col: str = "text") -> DataFrame:
    """``(text, label)`` of at most ``sample_rows`` labelled documents, chosen by a hash of the id.

    An id with both labels says nothing and is left out. The ids are chosen first and sent to the documents (their number is the bound), so no text is shuffled.
    """
    chosen = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("chosen_id"), F.col(label_col).alias("label"))
    chosen = chosen.groupBy("chosen_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").drop("other")
    chosen = chosen.orderBy(F.xxhash64("chosen_id"), "chosen_id").limit(sample_rows)
    return docs.select(F.col(id_col).alias("own_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), F.col("own_id") == F.col("chosen_id")).select("text", "label")


def keep_good(docs: DataFrame, machine: FactorisationMachine, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score is ``least`` or more, with all their columns.

    Null texts count as empty; equal texts are kept or rejected alike. An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in steps(batches, text_col):
            rows = [own.features(*row_features(t)) for t in texts(batch, text_col)]
            lengths = np.array([len(r[0]) for r in rows])
            margin, _, _ = own.margins(np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]), np.cumsum(lengths) - lengths)
            yield batch.filter(pa.array(1 / (1 + np.exp(-np.clip(margin, -30, 30))) >= least))

    return map_rows(docs, run)
