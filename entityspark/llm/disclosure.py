"""Personal data, and the terms that give it away: information-theoretic sanitisation.

Patterns find protected entities. A term that stands near an entity reveals it as far as its
pointwise mutual information with the entity reaches the entity's own information:

    PMI(t; e) / IC(e) = 1 + log(n(t, e) / n(t)) / log(N / n(e))

with document counts over the whole corpus. Terms above a threshold that stand near the entity in
at least ``support`` documents (one document alone is no estimate) are disclosing; all their
occurrences in the entity's documents are generalised, those that reveal nearly all are removed.
Counts are made in the tasks and joined by key; of the texts only those with disclosing terms meet
their terms again.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entityspark.llm.textio import keep, quoted, steps, texts

#: Entities with disclosing terms that are broadcast with them; more are joined by a shuffle.
BROADCAST_ROWS = 100_000
KINDS = ("email", "ip", "card", "phone", "term")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[^\W_]{3,}")


def luhn(digits: str) -> bool:
    total = sum(int(d) if i % 2 == 0 else (2 * int(d) - 9 * (int(d) > 4)) for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of all emails, IP addresses, cards and phones, in order.

    Matches are leftmost and do not overlap within a kind; those that fail a check are dropped
    without another try. Emails are found from their @, so long runs cost linear time.
    """
    found = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            found.append((start, 0, domain.end()))
            done = domain.end()
        at = text.find("@", max(at + 1, done))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.group().split(".")):
                found.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        for m in _PHONE.finditer(text):
            if 10 <= len(_DIGIT.findall(m.group())) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def free_words(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(start, end) of the whole words that touch no span, in order."""
    starts, farthest = [s for s, _, _ in spans], list(accumulate((e for _, _, e in spans), max))
    inside = lambda a, b: (k := bisect_left(starts, b)) > 0 and farthest[k - 1] > a  # noqa: E731  of some span
    return [m.span() for m in _WORD.finditer(text) if not inside(*m.span())]


def neighbours(text: str, spans: list[tuple[int, int, int]], reach: int = 8) -> set[tuple[str, str]]:
    """(entity, term) of the ``reach`` words before and after each entity, however long they are."""
    words = free_words(text, spans)
    begins, ends = [a for a, _ in words], [b for _, b in words]
    out = set()
    for start, kind, end in spans:
        entity = f"{KINDS[kind]}:{text[start:end].lower()}"
        before, after = bisect_right(ends, start), bisect_left(begins, end)
        out.update((entity, text[a:b].lower()) for a, b in words[max(0, before - reach) : before] + words[after : after + reach])
    return out


def document_frequencies(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``(term, n)``: in how many rows each lower-cased word of three letters or more occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        out = lambda: pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["term", "n"])
        for batch in steps(batches, "t"):
            for text in texts(batch, "t"):
                held.update(set(_WORD.findall(text.decode("utf-8", "replace").lower())))
            if len(held) > 500_000:
                yield out()
                held.clear()
        if held:
            yield out()

    return docs.select(F.col(text_col).alias("t")).mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = 8, row_col: str | None = None) -> DataFrame:
    """``(row, id_col, spans, near, t)`` per row: base spans, the pairs of entity and near term, and the text if there are any.

    ``row_col`` numbers the rows; without it they are numbered here.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    span = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
    near = pa.struct([("entity", pa.string()), ("term", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "t"):
            spans, pairs, whole = [], [], []
            for raw in texts(batch, "t"):
                text = raw.decode("utf-8", "replace")
                found = base_spans(text)
                spans.append([{"start": s, "kind": k, "end": e} for s, k, e in found])
                pairs.append([{"entity": e, "term": t} for e, t in sorted(neighbours(text, found, reach))] if found else [])
                whole.append(text if pairs[-1] else None)
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(0), pa.array(spans, pa.list_(span)), pa.array(pairs, pa.list_(near)), pa.array(whole, pa.string())], names=["row", id_col, "spans", "near", "t"])

    row = F.col(quoted(row_col)) if row_col else F.monotonically_increasing_id()
    numbered = docs.select(F.col(id_col).alias("id"), row.alias("row"), F.col(text_col).alias("t"))
    return numbered.mapInArrow(run, f"row long, `{id_col}` {kind}, spans array<struct<start:int,kind:int,end:int>>, near array<struct<entity:string,term:string>>, t string")


def disclosing_terms(found: DataFrame, frequencies: DataFrame, threshold: float = 0.6, support: int = 2) -> DataFrame:
    """``(entity, term, disclosure)`` of the terms that reveal ``threshold`` of an entity's information at least."""
    total = found.count()
    together = found.select(F.explode("near").alias("x")).select("x.entity", "x.term").groupBy("entity", "term").agg(F.count("*").alias("both")).where(F.col("both") >= support)
    alone = found.select(F.explode(F.array_distinct(F.transform("near", lambda x: x["entity"]))).alias("entity")).groupBy("entity").agg(F.count("*").alias("of_entity"))
    share = F.log2(F.least(F.lit(1.0), F.col("both") / F.col("n")))
    disclosure = 1 + share / F.greatest(F.log2(F.lit(float(max(total, 1))) / F.col("of_entity")), F.lit(1e-9))
    return together.join(alone, "entity").join(frequencies, "term").select("entity", "term", disclosure.alias("disclosure")).where(F.col("disclosure") >= threshold)


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of ``(row, t, spans, terms)``: where the terms occur as whole words outside the spans."""
    term = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("disclosure", pa.float64())])
    for batch in steps(batches, "t"):
        out = []
        for text, spans, terms in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
            worth: dict[str, float] = {}
            for x in terms:
                worth[x["term"]] = max(x["disclosure"], worth.get(x["term"], 0.0))
            free = free_words(text, [(x["start"], x["kind"], x["end"]) for x in spans])
            out.append([{"start": a, "kind": 4, "end": b, "disclosure": worth[w]} for a, b in free if (w := text[a:b].lower()) in worth])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(term))], names=["row", "terms"])


def spans_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.6, support: int = 2, row_col: str | None = None) -> DataFrame:
    """``(row, id_col, spans, terms)`` per row: base spans, and disclosing terms with their disclosure.

    Null and empty texts have no spans. Repeated rows and null ids are kept; an empty table gives
    no rows. Other columns are not read, but for ``row_col``, if given: the rows' numbers.
    """
    found = keep(detect(docs, id_col, text_col, row_col=row_col))
    flagged = disclosing_terms(found, document_frequencies(docs, text_col), threshold, support)
    of_entity = keep(flagged.groupBy("entity").agg(F.collect_list(F.struct("term", "disclosure")).alias("terms")))
    entities = found.select("row", F.explode(F.array_distinct(F.transform("near", lambda x: x["entity"]))).alias("entity"))
    of_row = entities.join(F.broadcast(of_entity) if of_entity.count() <= BROADCAST_ROWS else of_entity, "entity").groupBy("row").agg(F.flatten(F.collect_list("terms")).alias("terms"))
    listed = found.select("row", "t", "spans").join(of_row, "row").mapInArrow(_occurrences, "row long, terms array<struct<start:int,kind:int,end:int,disclosure:double>>")
    return found.drop("near", "t").join(listed, "row", "left")


def digests(spans: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts per kind, the digest of the base spans and all spans as text, from ``spans_of``."""
    names = F.array(*[F.lit(k) for k in KINDS])
    written = lambda xs: F.array_join(F.transform(F.array_sort(xs), lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")
    bare = F.transform(F.coalesce("terms", F.array().cast("array<struct<start:int,kind:int,end:int,disclosure:double>>")), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    number = lambda i: F.size(F.filter("spans", lambda x: x["kind"] == i)).cast("long")
    counts = [number(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:4])]
    return spans.select(id_col, *counts, F.sha2(written(F.col("spans")).cast("binary"), 256).alias("base_sha256"), written(F.concat("spans", bare)).alias("spans"))


def generalised(term: str) -> str:
    """What stands for a disclosing term that is not removed: its shape only."""
    return "[number]" if term.isdigit() else "[name]" if term[:1].isupper() else "[word]"


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.6, removal: float = 0.95, support: int = 2) -> DataFrame:
    """``docs`` with entities replaced by their kind, disclosing terms generalised, or removed from ``removal`` on.

    Null and empty texts stay; repeated rows are treated alike. All columns stay, in their order.
    The numbered documents are stored once, so that any table can be given.
    """
    own = keep(docs.select(F.struct(*map(quoted, docs.columns)).alias("own"), F.monotonically_increasing_id().alias("row")))
    given = own.select("row", F.col(f"own.{quoted(id_col)}").alias("id"), F.col(f"own.{quoted(text_col)}").alias("text"))
    marks_of = spans_of(given, "id", "text", threshold, support, row_col="row").select("row", F.struct("spans", "terms").alias("marks"))
    where = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.RecordBatch.from_struct_array(batch.column(0))
            out = []
            for text, found in zip(rows.column(where).to_pylist(), batch.column(1).to_pylist()):
                found = found or {}
                marks = [(x["start"], x["end"], f"[{KINDS[x['kind']]}]") for x in found.get("spans") or []]
                marks += [(x["start"], x["end"], "" if x["disclosure"] >= removal else generalised(text[x["start"] : x["end"]])) for x in found.get("terms") or []]
                parts, done = [], 0
                for start, end, label in sorted(marks):
                    if start >= done:
                        parts += [text[done:start], label]
                    done = max(done, end)
                out.append(None if text is None else "".join(parts) + text[done:])
            columns = list(rows.columns)
            columns[where] = pa.array(out, columns[where].type)
            yield pa.RecordBatch.from_arrays(columns, names=rows.schema.names)

    return own.join(marks_of, "row", "left").select("own", "marks").mapInArrow(run, docs.schema)
