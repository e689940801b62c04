"""Language identification with a bit-sliced Bloom filter of n-grams.

One table of small words holds a Bloom filter per language, each in its own bit: looking an
n-gram up with two hashes and combining the two words by AND returns all languages that contain
it (64 languages a word; beyond that, a table of words for each 64). A document's hits are counted per language, corrected for the filter's false positives and
divided by what a text of that language is expected to hit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from entityspark.llm.textio import keep, steps, texts

#: A letter is of Unicode category L: neither digits of any script nor superscripts, fractions or numerals.
LETTER = regex.compile(r"\p{L}")

#: Bytes that n-grams keep: a-z and everything above ASCII; all others count as a blank.
_KEPT = np.array([b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], dtype=np.uint8)


def _lowered(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Bytes and offsets of the lower-cased texts, each between two blanks, and the texts."""
    found = [t.decode("utf-8", "replace") for t in texts(batch, name)]
    raw = [b" " + t.lower().encode("utf-8", "replace") + b" " for t in found]
    return _KEPT[np.frombuffer(b"".join(raw), np.uint8)], np.cumsum([0, *map(len, raw)]), found


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Four-byte n-grams with two letter bytes at least, and the row of each; none crosses two rows."""
    if len(data) < 4:
        return np.empty(0, np.uint32), np.empty(0, np.int64)
    wide = data.astype(np.uint32)
    codes = wide[:-3] << 24 | wide[1:-2] << 16 | wide[2:-1] << 8 | wide[3:]
    letter = (data != 32).astype(np.int8)
    ok = letter[:-3] + letter[1:-2] + letter[2:-1] + letter[3:] >= 2
    for k in (1, 2, 3):
        ends = offsets[1:-1] - k
        ok[ends[(ends >= 0) & (ends < len(ok))]] = False
    at = np.flatnonzero(ok)
    return codes[at], np.searchsorted(offsets, at, "right") - 1


def gram_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``(lang, gram, n)`` over all rows with a language; counted in the tasks before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[str, int] = {}
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            keys, where = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            return keys, np.bincount(where, weights=np.concatenate([n for _, n in held])).astype(np.int64)

        def out() -> pa.RecordBatch:
            keys, n = merged()
            label = np.array(list(names), dtype=object)
            return pa.RecordBatch.from_arrays([pa.array(label[(keys >> np.uint64(32)).astype(np.int64)], pa.string()), pa.array((keys & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

        for batch in steps(batches, "t"):
            data, offsets, _ = _lowered(batch, "t")
            codes, rows = _grams(data, offsets)
            label = np.array([names.setdefault(x, len(names)) for x in batch.column(1).to_pylist()], dtype=np.uint64)
            keys, n = np.unique(label[rows] << np.uint64(32) | codes, return_counts=True)
            held.append((keys, n))
            size += len(keys)
            if size > 3_000_000:
                held = [merged()]
                size = len(held[0][0])
                if size > 2_000_000:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    counted = docs.where(F.col(lang_col).isNotNull()).select(F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("l")).mapInArrow(run, "lang string, gram long, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _mix(codes: np.ndarray, k: int, bits: int) -> np.ndarray:
    """Slot of every n-gram under the k-th hash."""
    return (codes.astype(np.uint64) * np.uint64((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)[k])) >> np.uint64(64 - bits)


@dataclass
class BitslicedFilter:
    """Languages, the table of language masks, per-language false-positive rates and expected hit shares."""

    languages: list[str]
    bits: int
    masks: list[np.ndarray]  # a table for every 64 languages
    false_rate: np.ndarray
    expected: np.ndarray

    @classmethod
    def build(cls, languages: list[str], lang: np.ndarray, gram: np.ndarray, expected: np.ndarray) -> BitslicedFilter:
        bits = max(10, int(8 * len(np.unique(gram)) or 1).bit_length())
        kind = np.uint8 if len(languages) <= 8 else np.uint64
        masks, fill = [], []
        for first in range(0, max(1, len(languages)), 64):
            mine = (lang >= first) & (lang < first + 64)
            table = np.zeros(1 << bits, kind)
            for k in (0, 1):
                np.bitwise_or.at(table, _mix(gram[mine], k, bits).astype(np.int64), np.left_shift(kind(1), (lang[mine] - first).astype(kind)))
            masks.append(table)
            fill += [np.mean(table >> kind(i) & kind(1)) for i in range(min(64, len(languages) - first))]
        return cls(languages, bits, masks, np.array(fill) ** 2, np.maximum(expected, 1e-9))

    def languages_of(self, codes: np.ndarray) -> list[np.ndarray]:
        """Bit masks of all languages that contain each n-gram, one for every 64 languages."""
        slots = [_mix(codes, k, self.bits).astype(np.int64) for k in (0, 1)]
        return [table[slots[0]] & table[slots[1]] for table in self.masks]

    def decide(self, codes: np.ndarray, rows: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
        """Per row: the language with the largest corrected share of hits, and its part of all shares."""
        kind = self.masks[0].dtype.type
        masks = self.languages_of(codes)
        total = np.bincount(rows, minlength=count)
        shares = np.zeros((count, len(self.languages)))
        for i in range(len(self.languages)):
            hits = np.bincount(rows, weights=(masks[i // 64] >> kind(i % 64) & kind(1)), minlength=count)
            real = np.maximum(hits - total * self.false_rate[i], 0) / (1 - self.false_rate[i])
            shares[:, i] = real / np.maximum(total, 1) / self.expected[i]
        best = shares.argmax(axis=1)
        whole = shares.sum(axis=1)
        return best, np.where(whole > 0, shares[np.arange(count), best] / np.maximum(whole, 1e-12), 1 / len(self.languages))


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least_rate: float = 2e-6, relative: float = 0.2) -> BitslicedFilter:
    """Learns which languages contain an n-gram, from all rows with a language.

    A language contains an n-gram that makes up ``least_rate`` of its n-grams at least and is
    ``relative`` times as frequent as in the language that uses it most. So at most
    1 / ``least_rate`` n-grams a language reach the driver. Languages are sorted by their number
    of n-grams, the largest first, equal ones by name, which decides ties.
    """
    counts = keep(gram_counts(docs, text_col, lang_col))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    rated = counts.join(F.broadcast(totals), "lang").withColumn("rate", F.col("n") / F.col("total"))
    found = rated.where(F.col("rate") >= least_rate).withColumn("most", F.max("rate").over(Window.partitionBy("gram"))).where(F.col("rate") >= relative * F.col("most"))
    rows = found.select("lang", "gram", "rate", "total").toPandas()
    sizes = rows.groupby("lang")["total"].first().sort_values(ascending=False, kind="stable")
    languages = list(sizes.index)
    lang = rows["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy(np.int64)
    expected = np.bincount(lang, weights=rows["rate"].to_numpy(), minlength=len(languages)) if len(rows) else np.zeros(0)
    return BitslicedFilter.build(languages, lang, rows["gram"].to_numpy(np.int64), expected)


def predict(docs: DataFrame, model: BitslicedFilter, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, lang_pred, score)`` per row, from the text alone.

    ``und`` with score 0 for null texts, texts without a letter, and if nothing was learned.
    Texts of letters that no language knows get the first language. Repeated rows and null ids
    are kept; other columns are not read. An empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in steps(batches, "t"):
            data, offsets, found = _lowered(batch, "t")
            lettered = np.array([bool(LETTER.search(t)) for t in found])
            if own.languages:
                best, score = own.decide(*_grams(data, offsets), batch.num_rows)
                label = np.where(lettered, np.array(own.languages, dtype=object)[best], "und")
                score = np.where(lettered, np.clip(score, 0, 1), 0.0)
            else:
                label, score = np.full(batch.num_rows, "und", dtype=object), np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(label, pa.string()), pa.array(score)], names=[id_col, "lang_pred", "score"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double")
