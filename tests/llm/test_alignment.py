"""Alignment of two tokenizers against a plain re-computation with the tokenizers' own libraries."""

import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer, decoders

from entityspark.llm import alignment, queries

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def spans(pieces):
    at, out = 0, []
    for p in pieces:
        out.append((at, at + len(p)))
        at += len(p)
    return out


def brute(rows):
    """Every row's measures, pair by pair."""
    tokenizer, model = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    tokenizer.encode_special_tokens = True
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    of_char = {chr(c): c for c in shown} | {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in shown)}
    parts = []
    for _, text in rows:
        want = (" " + (text or "")).encode()
        a = tokenizer.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        b = model.encode(text) if text else []
        bytes_a = [bytes(of_char[c] for c in tokenizer.id_to_token(i)) for i in a]
        bytes_b = [bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if b"".join(bytes_a) != want or b"".join(bytes_b) != want:
            parts.append(([], [], [], []))
            continue
        sa, sb = spans(bytes_a), spans(bytes_b)
        links = [(x, y) for x, (s, e) in zip(a, sa) for y, (t, f) in zip(b, sb) if s < f and t < e]
        common = sorted({e for _, e in sa} & {e for _, e in sb})
        groups = [(",".join(str(x) for x, (s, e) in zip(a, sa) if lo < e <= hi), ",".join(str(y) for y, (t, f) in zip(b, sb) if lo < f <= hi)) for lo, hi in zip([0, *common], common)]
        parts.append((a, b, links, groups))
    counts, best = Counter(), defaultdict(int)
    for _, _, links, _ in parts:
        counts.update(set(links))
    for (a, _), n in counts.items():
        best[a] = max(best[a], n)
    return [
        (doc_id, len(a), len(b), len(groups), len(links), sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links), hashlib.sha256(";".join("|".join(g) for g in groups).encode()).hexdigest() if groups else "")
        for (doc_id, _), (a, b, links, groups) in zip(rows, parts)
    ]


MADE = [
    (1, "The quick brown fox"), (2, "The quick brown fox"), (3, "the  quick\n\nbrown fox."), (4, None), (5, ""), (6, " "), (7, "naïve café — 漢字 😀 \U0001f469‍\U0001f4bb"),
    (8, "x▁y"), (9, "a <|endoftext|> b <s> </s>"), (None, "The quick brown fox"), (1, "the fox"), (10, "\x00\t\r\n"), (11, "ｆｕｌｌ ﬁ ²"), (12, "word " * 300), (13, "don't 1234567 www.example.org/a_b?c=d"), (14, "z" * 400),
]


def check(docs, rows):
    got = alignment.align(docs, A, B)
    assert got.columns == list(COLUMNS)
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, brute(rows)))


def test_tables_of_bytes():
    """The faster library's bytes of an id are what the file's own tokenizer decodes."""
    tokenizer, table = Tokenizer.from_file(A), alignment.byte_tokenizer(A)[2]
    tokenizer.decoder = decoders.ByteLevel()
    for i in range(0, 50_256, 97):
        text = tokenizer.decode([i])
        if "�" not in text:
            assert text.encode() == table[i]


@pytest.mark.parametrize("head", [1 << 19, 40, 0])
def test_brute_force(spark, monkeypatch, head):
    monkeypatch.setattr(alignment, "HEAD_PAIRS", head)
    docs = spark.createDataFrame(MADE, "doc_id long, text string").repartition(3).withColumn("n_a", F.lit("clash")).withColumn("digest", F.lit(1)).withColumn("copies", F.lit(None).cast("string"))
    check(docs, MADE)


def test_hot_texts_over_several_keys(spark):
    rows = [(i, "one copy of many") for i in range(50)] + [(100 + i, f"text {i}") for i in range(20)] + [(200, None)]
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), rows)


def test_empty(spark):
    for rows in ([], [(1, None), (2, ""), (None, None)], [(1, "▁")]):
        check(spark.createDataFrame(rows, "doc_id long, text string"), rows)


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").where(F.length("text") < 3000)
    rows = [tuple(r) for r in docs.collect()]
    check(docs, rows)
    whole = queries.op12_exact_text_alignment(spark, "/root/testdata/sf0.001")
    assert whole.columns == list(COLUMNS) and whole.where("n_links <> n_a + n_b - n_groups or n_best > n_links").count() == 0
