"""Nulls in any column, empty and long texts, repeated rows, empty tables and clashing column names."""

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from entityspark.llm import disclosure, language, lm, packing, quality, queries, secrets, simhash, substrings, telephony, winnowing

SMALL = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")
CLASHING = ["id", "t", "row", "fp", "words", "spans", "terms", "marks", "own", "own_id", "label", "component_id", "item", "print", "x", "p", "part", "first", "odd.na`me"]
PROSE = "the quiet river ran past the old mill and the children watched it go by in the evening light. "
ROWS = [
    (PROSE * 3, 1, "a", "en", 3), (PROSE * 3, 2, None, None, None), (PROSE * 3, 2, None, None, None), (None, 3, "a", "en", None), ("", 4, "a", "en", 0),
    (PROSE * 3000, 5, "a", "en", 1), (PROSE, None, None, None, None), (None, None, None, None, None), ("password=Zx81kQ77pL02 and Ann@b.cd " * 400, 6, "b", "de", 9), ("İ\U0001f600 \x00 é", 7, "b", "fr", 5),
]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    base = spark.createDataFrame(ROWS, "text string, doc_id long, source string, lang string, n_chars long")
    path = str(tmp_path_factory.mktemp("edges") / "docs")
    base.select("*", *[F.when(F.col("doc_id") > 2, F.lit(c)).alias(c) for c in CLASHING]).write.parquet(path)
    return spark.read.parquet(path)


def operators(spark, docs, training):
    labelled = training.select("text", F.when(F.col("doc_id") % 2 == 0, 1.0).when(F.col("doc_id").isNotNull(), 0.0).alias("label"))
    machine = quality.train(labelled)
    scanner = secrets.scanner(training, training)
    items = training.select(F.col("doc_id").alias("item_id"), F.substring("text", 1, 100).alias("text"))
    return {
        "simhash": simhash.near_duplicates(docs), "language": language.predict(docs, language.train(training)), "quality": quality.score(docs, machine),
        "media": telephony.features(telephony.store(docs)), "personal": disclosure.digests(disclosure.spans_of(docs)), "language_model": lm.score(docs, training),
        "repeats": substrings.remove_repeats(docs), "windows": winnowing.decontaminate(docs, items), "redacted": secrets.redact(docs, scanner),
    }, {"found": secrets.scan(docs, scanner), "packed": packing.pack_documents(docs, PATH)}


def test_every_operator_keeps_every_row(spark, docs):
    by_row, by_part = operators(spark, docs, docs)
    want = sorted((-1 if r[1] is None else r[1]) for r in ROWS)
    for name, out in by_row.items():
        assert sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in out.select("doc_id").collect()) == want, name
    packed = by_part["packed"].collect()
    assert {r["doc_id"] for r in packed} == {r[1] for r in ROWS} and sum(r["start"] == 0 for r in packed) == len(ROWS)
    assert {r["doc_id"] for r in by_part["found"].collect()} <= {6, 7}


def test_empty_tables(spark, docs):
    for rows, training in ((docs.where("false"), docs), (docs.where("false"), docs.where("false"))):
        by_row, by_part = operators(spark, rows, training)
        assert {k: x.count() for k, x in (by_row | by_part).items()} == dict.fromkeys(by_row | by_part, 0)
    by_row, _ = operators(spark, docs, docs.where("false"))
    assert {k: x.count() for k, x in by_row.items()} == dict.fromkeys(by_row, len(ROWS))


def test_sanitising_keeps_columns_and_rows(docs):
    out = disclosure.sanitise(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert len(rows) == len(ROWS) and not any("Ann@b.cd" in (r["text"] or "") for r in rows)
    assert sum(r["text"] is None for r in rows) == 2 and disclosure.sanitise(docs.where("false")).count() == 0


def test_pipeline_stages(spark, docs):
    """Every stage but the last returns all columns in their order, works on empty tables and loses no row that it shouldn't."""
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert stage(spark, docs.where("false"), SMALL).count() == 0, name
        if name == "simhash_near_dedup":  # 2 copies 1, 4 copies 3: as empty texts
            assert {r["doc_id"] for r in rows} >= {None, 1, 3, 6, 7} and not {2, 4} & {r["doc_id"] for r in rows}
        if name == "secret_scan":
            assert len(rows) == len(ROWS) and not any("Zx81kQ77pL02" in (r["text"] or "") for r in rows)
        if name == "benchmark_decontamination":
            assert len(rows) == len(ROWS)
    last = corpus_pipeline.STAGES[-1][1]
    assert {r["doc_id"] for r in last(spark, docs, SMALL).collect()} == {r[1] for r in ROWS} and last(spark, docs.where("false"), SMALL).count() == 0


def test_many_candidates_and_entities_in_one_text():
    """Overlaps are found as by comparing each with all; a long text takes no quadratic time."""
    rng = random.Random(3)
    words = ["password=Zx81kQ77pL02", "AKIA" + "B2" * 8, "token: AKIA" + "C3" * 8, "secret=" + "Q1w2" * 9, "plain", "a@b.cd", "10.1.2.3", "+1 (803) 555-5351"]
    text = " ".join(rng.choice(words) for _ in range(300))
    found: list[tuple[int, int, int]] = []
    for kind, pattern in ((3, secrets.PRIVATE), (0, secrets.PROVIDERS), (1, secrets.ASSIGNED), (2, secrets.LONG)):
        found += [(*m.span(m.re.groups), kind) for m in pattern.finditer(text) if not any(s < m.end(m.re.groups) and m.start(m.re.groups) < e for s, e, k in found if k != kind)]
    assert secrets.candidates(text) == sorted(found) and len(found) > 50
    spans = disclosure.base_spans(text)
    free = disclosure.free_words(text, spans)
    assert free and not any(a < e and s < b for a, b in free for s, _, e in spans)
    assert {t for _, t in disclosure.neighbours(text, spans)} <= {text[a:b].lower() for a, b in free}
    assert len(secrets.candidates((text + " ") * 300)) >= 300 * 50
    long = (text + " ") * 100
    assert len(disclosure.free_words(long, disclosure.base_spans(long))) > 10_000 and disclosure.neighbours(long, disclosure.base_spans(long))


def test_held_out_accuracy(spark):
    """Learned on two folds, the language and the quality model are right on the third."""
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet").where("quality is not null").select("doc_id", "quality")
    good = queries.op8_factorisation_machine(spark, folder).where("held_out").join(labels, "doc_id")
    assert good.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0] >= 0.9
    given = spark.read.parquet(f"{folder}/documents.parquet").where("lang is not null and text is not null").select("doc_id", "lang")
    lang = queries.op2_language_bitmask(spark, folder).where("held_out and lang_pred <> 'und'").join(given, "doc_id")
    assert lang.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0] >= 0.95
