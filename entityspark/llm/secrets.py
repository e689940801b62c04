"""Secret scan: patterns propose candidates, a random forest removes the false ones.

The forest looks at a candidate's length, its character transitions, how much of it the corpus's
frequent words cover, its document's path and the words next to it. It is trained from labelled
findings: the caller's (``given_findings``), or by default those that a provider's format, a placeholder or plain
wording labels beyond doubt. Candidates, features and decisions are made inside the row's task.
"""

from __future__ import annotations

import math
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entityspark.llm.lm import word_counts
from entityspark.llm.textio import keep, map_rows, steps, texts

#: Formats of well-known credentials (fixed values).
PROVIDERS = re.compile(r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,80}|sk_live_[A-Za-z0-9]{16,64}|AIza[A-Za-z0-9_-]{35})(?![A-Za-z0-9])")
ASSIGNED = re.compile(r"(?i)(?<![a-z0-9])(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth|credential)s?[\"']?[ \t]{0,3}[:=][ \t]{0,3}[\"']?([^\s\"',;]{6,})")
LONG = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}(?![A-Za-z0-9+/_=-])")
#: A key from its first line to its last one; without that to the end of its base64 lines, headers among them included.
PRIVATE = re.compile(
    r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----(?:"
    r"(?:(?!-----BEGIN ).)*?-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----"
    r"|(?:(?:(?:\s|\\[nr])*(?:(?:Proc-Type|DEK-Info|Version|Comment): [^\r\n]*(?=[\r\n])|[A-Za-z0-9+/]{16,}={0,2}))+(?:[ \t]*(?:[\r\n]|\\[nr])+[ \t]*[A-Za-z0-9+/]+={0,2}(?![^\s\"'\\]|[ \t]+\S))?)?)",
    re.DOTALL,
)
PLACEHOLDER = re.compile(r"(?i)example|sample|change|dummy|placeholder|your|test|xxx|\*\*\*|<|\{|\$")
KINDS = ("provider", "assigned", "long", "private")
_NEXT, _LAST = re.compile(r"[^\W_]+"), regex.compile(r"(?r)[^\W_]+")
NEIGHBOURS = 16
FEATURES = ["length", "entropy", "transitions", "coverage", "digits", "upper", "lower", "other", "changes", "hex", "assigned", "quoted", "alone", "path", *(f"before{i}" for i in range(NEIGHBOURS)), *(f"after{i}" for i in range(NEIGHBOURS // 2))]


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number); a candidate inside an earlier kind's is left out."""
    found: list[tuple[int, int, int]] = []  # in order, without overlaps: the last one that begins before an end reaches farthest
    for kind, pattern in ((3, PRIVATE), (0, PROVIDERS), (1, ASSIGNED), (2, LONG)):
        fresh = []
        for m in pattern.finditer(text):
            start, end = m.span(m.re.groups)
            before = bisect_left(found, (end,))
            if not before or found[before - 1][1] <= start:
                fresh.append((start, end, kind))
        found = sorted(found + fresh)
    return found


@dataclass
class Wording:
    """Frequent words of the corpus, and the logarithms of their character transitions."""

    words: frozenset[bytes]
    transitions: np.ndarray
    longest: int

    @classmethod
    def of(cls, counts: dict[bytes, int]) -> Wording:
        table = np.ones((27, 27))
        for word, n in counts.items():
            letters = _letters(word)
            np.add.at(table, (letters[:-1], letters[1:]), n)
        words = frozenset(w for w in counts if len(w) >= 3 and w.isalpha())
        return cls(words, np.log(table / table.sum(axis=1, keepdims=True)), max(map(len, words), default=0))


def _letters(word: bytes) -> np.ndarray:
    codes = np.frombuffer(word.lower(), np.uint8).astype(np.int64) - 97
    return np.where((codes >= 0) & (codes < 26), codes, 26)


def wording(docs: DataFrame, text_col: str = "text", least_share: float = 2e-5) -> Wording:
    """Learned from all texts; at most 1 / ``least_share`` words are kept."""
    counts = keep(word_counts(docs, text_col))
    total = counts.agg(F.sum("n")).first()[0] or 0
    rows = counts.where((F.col("n") >= total * least_share) & (F.octet_length("token") >= 2)).toPandas()
    return Wording.of({bytes(t): int(n) for t, n in zip(rows["token"], rows["n"])})


def coverage(value: bytes, known: Wording) -> float:
    """Share of the bytes that frequent words, of any length, cover, longest first from the left."""
    words = known.words
    value, at, covered = value.lower(), 0, 0
    while at < len(value):
        size = next((k for k in range(min(known.longest, len(value) - at), 2, -1) if value[at : at + k] in words), 0)
        covered += size
        at += size or 1
    return covered / max(1, len(value))


def neighbours(text: str, start: int, end: int) -> tuple[list[str], list[str]]:
    """The two whole words before a candidate, the nearer first, and the one after it, however far or long."""
    before = [m.group() for m in islice(_LAST.finditer(text, 0, start), 2)]
    after = _NEXT.search(text, end)
    return before, [after.group()] if after else []


def features(text: str, start: int, end: int, kind: int, path: str, known: Wording) -> list[float]:
    """The numbers that the forest sees, in the order of FEATURES."""
    value = text[start:end]
    raw = value.encode("utf-8", "replace")
    n, letters = len(value), _letters(raw)
    counts = np.bincount(np.frombuffer(raw, np.uint8))
    shares = counts[counts > 0] / len(raw)
    classes = [0 if c.isdigit() else 1 if c.isupper() else 2 if c.islower() else 3 for c in value]
    by = [classes.count(k) / n for k in range(4)]
    words_before, words_after = neighbours(text, start, end)
    before = [0.0] * NEIGHBOURS
    for w in words_before:
        before[zlib.crc32(w.lower().encode()) % NEIGHBOURS] = 1.0
    after = [0.0] * (NEIGHBOURS // 2)
    for w in words_after:
        after[zlib.crc32(w.lower().encode()) % (NEIGHBOURS // 2)] = 1.0
    return [
        n, float(-(shares * np.log2(shares)).sum()), float(known.transitions[letters[:-1], letters[1:]].mean()) if n > 1 else 0.0, coverage(raw, known), *by,
        sum(a != b for a, b in zip(classes, classes[1:])) / n, float(all(c in "0123456789abcdefABCDEF" for c in value)), float(kind == 1 or text[max(0, start - 2) : start].strip()[-1:] in ("=", ":")),
        float(text[start - 1 : start] in ("'", '"')), float(text[start - 1 : start].isspace() and text[end : end + 1].isspace()), zlib.crc32(path.encode()) % 64, *before, *after,
    ]


def weak_label(value: str, kind: int) -> int | None:
    """1 or 0 where a format, a placeholder or plain wording leaves no doubt, else None."""
    if kind in (0, 3):
        return 1
    if PLACEHOLDER.search(value) or value.replace("-", "").replace("_", "").isalpha():
        return 0
    if kind == 1 and len(value) >= 12 and any(c.isdigit() for c in value) and any(c.isalpha() for c in value):
        return 1
    return None


@dataclass
class Forest:
    """Trees as arrays: feature (-1 for a leaf), threshold, left child (right is the next), share of secrets."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, trees: int = 25, depth: int = 10, least: int = 5, seed: int = 1) -> Forest:
        order = np.random.default_rng(seed)
        tries = max(1, round(math.sqrt(x.shape[1]))) if len(x) else 1
        grown = []
        for _ in range(trees if len(x) else 0):
            feature, threshold, left, share = [-1], [0.0], [0], [0.0]
            todo = [(0, order.integers(0, len(x), len(x)), 0)]
            while todo:
                node, rows, level = todo.pop()
                share[node] = float(y[rows].mean())
                if level == depth or len(rows) < 2 * least or share[node] in (0.0, 1.0):
                    continue
                best = (1e-9, -1, 0.0)
                base = share[node] * (1 - share[node]) * len(rows)
                for f in order.choice(x.shape[1], tries, replace=False):
                    column = x[rows, f]
                    for t in np.unique(np.quantile(column, (0.1, 0.25, 0.4, 0.5, 0.6, 0.75, 0.9))):
                        low = column <= t
                        a, b = int(low.sum()), int((~low).sum())
                        if a >= least and b >= least:
                            p, q = y[rows[low]].mean(), y[rows[~low]].mean()
                            gain = base - a * p * (1 - p) - b * q * (1 - q)
                            if gain > best[0]:
                                best = (gain, int(f), float(t))
                if best[1] >= 0:
                    feature[node], threshold[node], left[node] = best[1], best[2], len(feature)
                    low = x[rows, best[1]] <= best[2]
                    for part in (rows[low], rows[~low]):
                        todo.append((len(feature), part, level + 1))
                        for column, first in ((feature, -1), (threshold, 0.0), (left, 0), (share, 0.0)):
                            column.append(first)
            grown.append((np.array(feature), np.array(threshold), np.array(left), np.array(share)))
        return cls(grown)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Mean share of secrets over the trees; 1 without trees, so that nothing is removed."""
        total = np.zeros(len(x))
        for feature, threshold, left, share in self.trees:
            node = np.zeros(len(x), np.int64)
            while True:
                inner = feature[node] >= 0
                if not inner.any():
                    break
                rows = np.flatnonzero(inner)
                at = node[rows]
                node[rows] = left[at] + (x[rows, feature[at]] > threshold[at])
            total += share[node]
        return total / len(self.trees) if self.trees else np.ones(len(x))


def labelled_findings(docs: DataFrame, known: Wording, text_col: str = "text", path_col: str = "source") -> DataFrame:
    """``(label, order, features)`` of all candidates that ``weak_label`` labels; order is a hash that mixes them.

    Null and empty texts have none, null paths count as empty, an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "t"):
            label, order, numbers = [], [], []
            for raw, path in zip(texts(batch, "t"), batch.column(1).to_pylist()):
                text = raw.decode("utf-8", "replace")
                for start, end, kind in candidates(text):
                    y = weak_label(text[start:end], kind)
                    if y is not None:
                        label.append(y)
                        order.append(zlib.crc32(text[max(0, start - 20) : end + 20].encode("utf-8", "replace")))
                        numbers.append(features(text, start, end, kind, path or "", shared.value))
            yield pa.RecordBatch.from_arrays([pa.array(label, pa.int32()), pa.array(order, pa.int64()), pa.array(numbers, pa.list_(pa.float64()))], names=["label", "order", "features"])

    return docs.select(F.col(text_col).alias("t"), F.col(path_col).cast("string").alias("p")).mapInArrow(run, "label int, order long, features array<double>")


def given_findings(docs: DataFrame, findings: DataFrame, known: Wording, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """``(label, order, features)`` of findings that someone has labelled: ``(id_col, start, end, label)``, in code points, label 0 or 1.

    Findings of absent documents, null texts or places outside a text are left out. Ids are unique.
    """
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "t"):
            label, order, numbers = [], [], []
            for raw, path, found in zip(texts(batch, "t"), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                text = raw.decode("utf-8", "replace")
                kinds = {(start, end): kind for start, end, kind in candidates(text)}
                for f in found:
                    if 0 <= f["start"] < f["end"] <= len(text):
                        label.append(f["label"])
                        order.append(zlib.crc32(text[max(0, f["start"] - 20) : f["end"] + 20].encode("utf-8", "replace")))
                        numbers.append(features(text, f["start"], f["end"], kinds.get((f["start"], f["end"]), 2), path or "", shared.value))
            yield pa.RecordBatch.from_arrays([pa.array(label, pa.int32()), pa.array(order, pa.int64()), pa.array(numbers, pa.list_(pa.float64()))], names=["label", "order", "features"])

    of_doc = findings.groupBy(F.col(id_col).alias("id")).agg(F.collect_list(F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.col("label").cast("int").alias("label"))).alias("found"))
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), F.col(path_col).cast("string").alias("p"))
    return given.join(of_doc, "id").select("t", "p", "found").mapInArrow(run, "label int, order long, features array<double>")


def train(findings: DataFrame, sample_rows: int = 4_000) -> Forest:
    """A forest from at most ``sample_rows`` labelled findings of each label (a documented bound), the first by ``order``."""
    stored = keep(findings)
    rows = [r for y in (0, 1) for r in stored.where(F.col("label") == y).orderBy("order", "features").limit(sample_rows).collect()]
    return Forest.fit(np.array([r["features"] for r in rows], dtype=np.float64).reshape(len(rows), len(FEATURES)), np.array([r["label"] for r in rows], dtype=np.float64))


@dataclass
class Scanner:
    """Wording and forest; what a task needs."""

    known: Wording
    forest: Forest

    def scan(self, found: list[str], paths: list[str | None]) -> tuple[list[int], list[tuple[int, int, int]], np.ndarray]:
        """Row numbers, candidates and scores over some texts."""
        where, spans, numbers = [], [], []
        for i, (text, path) in enumerate(zip(found, paths)):
            for start, end, kind in candidates(text):
                where.append(i)
                spans.append((start, end, kind))
                numbers.append(features(text, start, end, kind, path or "", self.known))
        return where, spans, self.forest.score(np.array(numbers).reshape(len(numbers), len(FEATURES)))


def scanner(docs: DataFrame, training: DataFrame, text_col: str = "text", path_col: str = "source", findings: DataFrame | None = None, id_col: str = "doc_id") -> Scanner:
    """Learns wording from ``docs`` and the forest from labelled findings in ``training``.

    ``findings`` (id_col, start, end, label) are someone's; without them, they are those that
    ``weak_label`` labels. Null texts have no words and no findings; without any findings, or
    documents, the forest has no trees and removes nothing.
    """
    known = wording(docs, text_col)
    labelled = labelled_findings(training, known, text_col, path_col) if findings is None else given_findings(training, findings, known, id_col, text_col, path_col)
    return Scanner(known, train(labelled))


def scan(docs: DataFrame, model: Scanner, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """``(id_col, kind, start, end, score, secret)``: a row per candidate, in code points.

    Null and empty texts have none; rows that repeat give their candidates again; null ids and
    paths are kept. Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind_of_id = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "t"):
            where, spans, score = shared.value.scan([t.decode("utf-8", "replace") for t in texts(batch, "t")], batch.column(2).to_pylist())
            start, end, kind = ([x[k] for x in spans] for k in range(3))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(where, pa.int64())), pa.array([KINDS[k] for k in kind], pa.string()), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(score), pa.array(score >= 0.5)],
                names=[id_col, "kind", "start", "end", "score", "secret"],
            )

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), F.col(path_col).cast("string").alias("p")).mapInArrow(run, f"`{id_col}` {kind_of_id}, kind string, start long, end long, score double, secret boolean")


def redact(docs: DataFrame, model: Scanner, text_col: str = "text", path_col: str = "source", length_col: str | None = None, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret replaced by ``mark``; all columns stay, ``length_col`` gets a changed text's length.

    Null and empty texts stay as they are, as do repeated rows; null paths count as empty. An empty
    table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    text_at, path_at, length_at = names.index(text_col), names.index(path_col), names.index(length_col) if length_col else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, text_col):
            found = [t.decode("utf-8", "replace") for t in texts(batch, text_col)]
            where, spans, score = shared.value.scan(found, [None if p is None else str(p) for p in batch.column(path_at).to_pylist()])
            out, changed = list(found), set()
            for i, (start, end, _), s in sorted(zip(where, spans, score), key=lambda x: (x[0], -x[1][0])):  # from the end, so places stay
                if s >= 0.5:
                    out[i] = out[i][:start] + mark + out[i][end:]
                    changed.add(i)
            null = batch.column(text_at).is_null().to_pylist()
            columns = list(batch.columns)
            columns[text_at] = pa.array([None if null[i] else t for i, t in enumerate(out)], columns[text_at].type)
            if length_at is not None:
                given = columns[length_at].to_pylist()
                columns[length_at] = pa.array([len(t) if i in changed else given[i] for i, t in enumerate(out)], columns[length_at].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return map_rows(docs, run)
