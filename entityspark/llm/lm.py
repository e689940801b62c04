"""Language-model scoring: prediction by partial matching over bytes, and word unigrams.

The byte model is a trie of contexts of up to four bytes, learned from all training text. A
byte unknown to the longest known context escapes to the next shorter one (method C: an escape
weighs as many as the context has different bytes); bytes that the longer context knows are
excluded there, as they cannot be meant. The last resort is an even choice among bytes never
seen. Because a context's bytes are known to all its suffixes, what is excluded depends on the
longer context alone: every escape and every reduced denominator is a number per context.

A byte's code length depends on itself and its four predecessors only, so it is a number per
five-byte string. The trie of all training text is kept in full as a table of counts. The code
lengths of the strings with a fixed share of the training bytes are sent to the tasks; those of
all other strings that the scored texts hold are computed in groups that share the two bytes
before the scored one, which hold all of their contexts of two bytes and more (shorter contexts
are at most 65,792 numbers), and joined. Words are counted in full in the same way: the frequent
ones are sent to the tasks, all others are joined.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entityspark.llm.textio import keep, steps, text_buffer, texts

#: Bytes of context.
ORDER = 4
#: A frequent five-byte string makes up this share of the training bytes at least: at most 2 ** 23 strings.
HEAD_GRAM_SHARE = 2.0**-23
#: Five-byte strings of the trie that one group stands for, about.
GROUP_GRAMS = 200_000
#: Scored rare strings that are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: A frequent word makes up this share of the training tokens at least: at most 200,000 words.
HEAD_SHARE = 1 / 200_000
_M = [np.uint64((1 << 8 * (k + 1)) - 1) for k in range(ORDER + 1)]


def byte_grams(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For every byte, the number made of its four predecessors in the row (zeros before its start) and itself."""
    n, rows = len(raw), len(offsets) - 1
    at = np.arange(n, dtype=np.int64) + ORDER * (np.repeat(np.arange(rows), np.diff(offsets)) + 1)
    padded = np.zeros(n + ORDER * (rows + 1), np.uint64)
    padded[at] = raw
    code = padded.copy()
    for k in range(1, ORDER + 1):
        code[k:] |= padded[:-k] << np.uint64(8 * k)
    return code[at]


def gram_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``(gram, n)``: how often each five-byte number occurs in all texts."""

    def merge(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        codes = np.concatenate([c for c, _ in held])
        order = np.argsort(codes, kind="stable")
        codes = codes[order]
        first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
        return codes[first], np.add.reduceat(np.concatenate([n for _, n in held])[order], first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        out = lambda c, n: pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)), pa.array(n.astype(np.int64))], names=["gram", "n"])
        for batch in steps(batches, "t"):
            raw, offsets = text_buffer(batch.column(0))
            if len(raw):
                held.append(np.unique(byte_grams(raw, offsets), return_counts=True))
                if sum(len(c) for c, _ in held) > 3_000_000:
                    held = [merge(held)]
                    if len(held[0][0]) > 1_500_000:
                        yield out(*held.pop())
        if held:
            yield out(*merge(held))

    return docs.select(F.col(text_col).alias("t")).mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``(token, n)``: how often each word (and the end, as the empty word) occurs, with A-Z lower-cased."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        out = lambda: pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["token", "n"])
        for batch in steps(batches, "t"):
            found = texts(batch, "t")
            held[b""] += len(found)
            for text in found:
                held.update(text.lower().split())
            if len(held) > 600_000:
                yield out()
                held.clear()
        if held:
            yield out()

    return docs.select(F.col(text_col).alias("t")).mapInArrow(run, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))


@dataclass
class Table:
    """Open-addressing look-up of 64-bit keys to their positions."""

    keys: np.ndarray
    slots: np.ndarray
    shift: int

    @classmethod
    def of(cls, keys: np.ndarray) -> Table:
        bits = max(4, (2 * len(keys)).bit_length())
        table = cls(keys, np.full(1 << bits, -1, np.int32), 64 - bits)
        left, at = np.arange(len(keys)), table.home(keys)
        while len(left):
            free = table.slots[at] < 0
            table.slots[at[free]] = left[free]
            lost = table.slots[at] != left
            left, at = left[lost], (at[lost] + 1) & (len(table.slots) - 1)
        return table

    def home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(self.shift)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Position of each key, -1 where it is not there."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        at = self.home(keys)
        found = self.slots[at].astype(np.int64)
        open_ = np.flatnonzero((found >= 0) & (self.keys[found] != keys))
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(self.slots) - 1)
            found[open_] = self.slots[at[open_]]
            open_ = open_[(found[open_] >= 0) & (self.keys[found[open_]] != keys[open_])]
        return found


@dataclass
class ByteModel:
    """Per order: known n-grams with log counts, and known contexts with their logarithms.

    ``denominator`` and ``escape`` hold for a context that is entered first; ``reduced`` and
    ``passing`` for its next shorter one, with this context's bytes excluded.
    """

    grams: list[Table]
    log_count: list[np.ndarray]
    contexts: list[Table]
    denominator: list[np.ndarray]
    escape: list[np.ndarray]
    reduced: list[np.ndarray]
    passing: list[np.ndarray]
    last: float

    @classmethod
    def of(cls, counts: list[tuple[np.ndarray, np.ndarray]]) -> ByteModel:
        """From (n-grams, counts) of order 0 and up; each n-gram's suffix must be known one order below."""
        grams, logs, contexts, denominator, escape, reduced, passing = [], [], [], [], [], [], []
        below: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
        for k, (codes, n) in enumerate(counts):
            grams.append(Table.of(codes))
            logs.append(np.log(n))
            names, where = np.unique(codes >> np.uint64(8), return_inverse=True)
            total, kinds = np.bincount(where, weights=n, minlength=len(names)), np.bincount(where, minlength=len(names))
            contexts.append(Table.of(names))
            denominator.append(np.log(total + kinds))
            escape.append(np.log(kinds / (total + kinds)))
            if below is None:
                reduced.append(np.zeros(len(names)))
                passing.append(np.zeros(len(names)))
            else:
                shorter = grams[k - 1].find(codes & _M[k - 1])
                excluded = np.bincount(where, weights=below[0][shorter], minlength=len(names))
                parent = contexts[k - 1].find(names & _M[k - 2] if k > 1 else np.zeros(len(names), np.uint64))
                more, other = below[1][parent] - excluded, below[2][parent] - kinds
                with np.errstate(divide="ignore"):
                    reduced.append(np.where(other > 0, np.log(np.maximum(more + other, 1e-9)), 0.0))
                    passing.append(np.where(other > 0, np.log(np.maximum(other, 1e-9)) - reduced[-1], 0.0))
            below = (n, total, kinds)
        seen = int(len(counts[0][0])) if counts else 0
        return cls(grams, logs, contexts, denominator, escape, reduced, passing, -float(np.log(max(1, 256 - seen))))

    def log_probability(self, codes: np.ndarray) -> np.ndarray:
        """Natural logarithm of each byte's probability after its predecessors."""
        out = np.zeros(len(codes))
        left, longer = np.arange(len(codes)), np.full(len(codes), -1, np.int64)  # longer: the context that was escaped from
        for k in range(len(self.grams) - 1, -1, -1):
            code = codes[left] & _M[k]
            gram = self.grams[k].find(code)
            hit = gram >= 0
            context = code >> np.uint64(8)
            fresh = longer < 0
            first = hit & fresh
            out[left[first]] += self.log_count[k][gram[first]] - self.denominator[k][self.contexts[k].find(context[first])]
            if k + 1 < len(self.grams):
                later = hit & ~fresh
                out[left[later]] += self.log_count[k][gram[later]] - self.reduced[k + 1][longer[later]]
            left, context, longer = left[~hit], context[~hit], longer[~hit]
            if not len(left):
                return out
            here = self.contexts[k].find(context)
            first = (longer < 0) & (here >= 0)
            out[left[first]] += self.escape[k][here[first]]
            if k + 1 < len(self.grams):
                later = longer >= 0
                out[left[later]] += self.passing[k + 1][longer[later]]
            longer = here
        out[left] += self.last
        return out


@dataclass
class Trie:
    """The stored counts of all five-byte strings ``(gram, n)``, their sum, and the counts of one and two bytes."""

    grams: DataFrame
    total: int
    short: list[tuple[np.ndarray, np.ndarray]]

    def _group(self, groups: int) -> Column:
        """The group of a string: by the two bytes before its last one."""
        return F.pmod(F.xxhash64(F.shiftright("gram", 8).bitwiseAND(F.lit(0xFFFF).cast("long"))), F.lit(groups))

    def code_lengths(self, wanted: DataFrame) -> DataFrame:
        """``(gram, log_p)``: the natural logarithm of the last byte's probability after the other four.

        ``wanted`` holds each five-byte ``gram`` once.
        """
        groups = max(8, -(-self.grams.count() // GROUP_GRAMS))
        shared = self.grams.sparkSession.sparkContext.broadcast(self.short)

        def run(known: pa.Table, asked: pa.Table) -> pa.Table:
            codes, n = (known.column(c).to_numpy() for c in ("gram", "n"))
            model = ByteModel.of(shared.value + _suffix_counts(codes.astype(np.uint64), n.astype(np.float64))) if shared.value else ByteModel.of([])
            grams = asked.column("gram").to_numpy()
            out = np.concatenate([model.log_probability(grams[i : i + (1 << 20)].astype(np.uint64)) for i in range(0, len(grams), 1 << 20)] or [np.empty(0)])
            return pa.Table.from_arrays([pa.array(grams), pa.array(out)], names=["gram", "log_p"])

        sides = [x.withColumn("part", self._group(groups)).groupBy("part") for x in (self.grams, wanted.select("gram"))]
        return sides[0].cogroup(sides[1]).applyInArrow(run, "gram long, log_p double")

    def frequent(self, share: float = HEAD_GRAM_SHARE) -> tuple[np.ndarray, np.ndarray]:
        """Strings and code lengths of those that make up ``share`` of the training bytes at least: their longest context knows them."""
        context = F.shiftright("gram", 8)
        of_context = self.grams.groupBy(context.alias("context")).agg((F.sum("n") + F.count("*")).alias("all"))
        head = self.grams.where(F.col("n") >= self.total * share).withColumn("context", context)
        rows = head.join(of_context, "context").select("gram", (F.log("n") - F.log("all")).alias("log_p")).toArrow()  # at most 1 / share rows
        return rows.column("gram").to_numpy().astype(np.uint64), rows.column("log_p").to_numpy()


def _suffix_counts(codes: np.ndarray, n: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Strings and counts of three, four and five bytes, from those of five."""
    out = []
    for k in range(2, ORDER + 1):
        names, where = np.unique(codes & _M[k], return_inverse=True)
        out.append((names, np.bincount(where, weights=n, minlength=len(names))))
    return out


def train_bytes(docs: DataFrame, text_col: str = "text") -> Trie:
    """Learns the trie from all texts of ``docs`` (null counts as empty)."""
    grams = keep(gram_counts(docs, text_col))
    pairs = grams.groupBy(F.col("gram").bitwiseAND(F.lit(0xFFFF).cast("long")).alias("gram")).agg(F.sum("n").alias("n")).orderBy("gram").toArrow()  # at most 65,536 rows
    codes, n = pairs.column("gram").to_numpy().astype(np.uint64), pairs.column("n").to_numpy().astype(np.float64)
    single = np.bincount((codes & _M[0]).astype(np.int64), weights=n, minlength=256)
    short = [(np.flatnonzero(single).astype(np.uint64), single[single > 0]), (codes, n)]
    return Trie(grams, int(n.sum()), short if len(codes) else [])


def score(docs: DataFrame, training: DataFrame, id_col: str = "doc_id", text_col: str = "text", head_grams: float = HEAD_GRAM_SHARE, head_words: float = HEAD_SHARE, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``(id_col, n_tokens, n_known, train_tokens, base_score, score)`` per row of ``docs``.

    base_score is the smoothed unigram log10 probability of the tokens, score the byte model's
    log10 probability of the text. Null and empty texts have one token, the end. Without
    training rows every byte has probability 1/256 and no token is known. Repeated rows and
    null ids are kept; other columns are not read. The shares that make a string or a word frequent
    decide how they are looked up, not what is learned.
    """
    spark = docs.sparkSession
    vocabulary = keep(word_counts(training, text_col))
    n, v = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    often = vocabulary.where(F.col("n") >= n * head_words).toArrow()
    head = dict(zip(often.column("token").to_pylist(), often.column("n").to_pylist()))  # at most 1 / head_words words
    logs = {w: float(np.log10((c + 0.1) / (n + 0.1 * (v + 1)))) for w, c in head.items()}
    unknown = float(np.log10(0.1 / (n + 0.1 * (v + 1))))
    trie = train_bytes(training, text_col)
    shared = spark.sparkContext.broadcast((logs, *trie.frequent(head_grams)))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, frequent, log_p = shared.value
        table = Table.of(frequent)
        for batch in steps(batches, "t", 1 << 20):
            raw, offsets = text_buffer(batch.column(1))
            codes = byte_grams(raw, offsets)
            at = table.find(codes)
            lengths = np.append(np.where(at >= 0, log_p[at], 0.0) if len(log_p) else np.zeros(len(codes)), 0.0)
            sums = np.where(np.diff(offsets) > 0, np.add.reduceat(lengths, offsets[:-1]), 0.0)
            left = np.flatnonzero(at < 0)
            of_row = np.searchsorted(offsets, left, "right") - 1
            other, often = np.unique(of_row.astype(np.uint64) << np.uint64(40) | codes[left], return_counts=True)
            cuts = pa.array(np.searchsorted(other >> np.uint64(40), np.arange(batch.num_rows + 1)).astype(np.int32))
            strings = [pa.ListArray.from_arrays(cuts, pa.array(x.astype(np.int64))) for x in (other & _M[ORDER], often)]
            tokens, hits, base, rare, times = [], [], [], [], []
            for text in texts(batch, "t"):
                words = [*text.lower().split(), b""]
                found = list(map(known.get, words))
                there = [x for x in found if x is not None]
                other = Counter(w for w, x in zip(words, found) if x is None) if len(there) < len(words) else {}
                tokens.append(len(words))
                hits.append(len(there))
                base.append(sum(there))
                rare.append(list(other))
                times.append(list(other.values()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(tokens, pa.int64()), pa.array(hits, pa.int64()), pa.array(base, pa.float64()), pa.array(sums), pa.array(rare, pa.list_(pa.binary())), pa.array(times, pa.list_(pa.int64())), *strings],
                names=["id", "row", "n_tokens", "hits", "base", "bytes", "rare", "times", "grams", "often"],
            )

    numbered = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), F.monotonically_increasing_id().alias("row"))
    scored = keep(numbered.mapInArrow(run, f"id {kind}, row long, n_tokens long, hits long, base double, bytes double, rare array<binary>, times array<long>, grams array<long>, often array<long>"))
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("token"), F.col("x.times").alias("times"))
    counted = rare.join(vocabulary.where(F.col("n") < n * head_words), "token", "left")
    added = counted.groupBy("row").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("more"),
        F.sum(F.col("times") * F.coalesce(F.log10((F.col("n") + 0.1) / (n + 0.1 * (v + 1))), F.lit(unknown))).alias("rest"),
    )
    strings = scored.select("row", F.explode(F.arrays_zip("grams", "often")).alias("x")).select("row", F.col("x.grams").alias("gram"), F.col("x.often").alias("often"))
    lengths = keep(trie.code_lengths(strings.select("gram").distinct()))
    lengths = F.broadcast(lengths) if lengths.count() <= broadcast_rows else lengths
    further = strings.join(lengths, "gram").groupBy("row").agg(F.sum(F.col("often") * F.col("log_p")).alias("further"))
    return scored.join(added, "row", "left").join(further, "row", "left").select(
        F.col("id").alias(id_col), "n_tokens", (F.col("hits") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rest", F.lit(0.0))).alias("base_score"), ((F.col("bytes") + F.coalesce("further", F.lit(0.0))) / math.log(10)).alias("score"),
    )
