"""The secret scan against a plain loop, and a forest trained from someone's findings on documents held out."""

import random
import string

import pytest

from entityspark.llm import secrets

SCHEMA = "doc_id long, text string, source string"


def walked(tree, row):
    feature, threshold, left, share = tree
    node = 0
    while feature[node] >= 0:
        node = left[node] + (row[feature[node]] > threshold[node])
    return share[node]


def made(n, seed):
    """Documents with one long random string each; whether it is a secret shows in the words around it alone."""
    r = random.Random(seed)
    docs, truth = [], []
    for i in range(n):
        value = "".join(r.choice(string.ascii_letters + string.digits) for _ in range(r.randrange(24, 60)))
        real = r.random() < 0.5
        lead = r.choice(["login bearer", "deploy credential", "signing bearer"] if real else ["commit digest", "image checksum", "build digest"])
        text = f"{' '.join(r.choice(('note', 'the', 'run', 'see')) for _ in range(r.randrange(1, 9)))} {lead} {value} {r.choice(('then', 'and', 'stop'))} end"
        start = text.index(value)
        docs.append((i, text, r.choice(["a.txt", "b.md", None])))
        truth.append((i, start, start + len(value), int(real)))
    return docs, truth


def test_labels_of_someone_else(spark):
    docs, truth = made(900, 3)
    df = spark.createDataFrame(docs, SCHEMA).repartition(3)
    labels = spark.createDataFrame([t for t in truth if t[0] % 3] + [(5, 0, 10_000, 1), (99_999, 0, 3, 1)], "doc_id long, start long, end long, label int")
    model = secrets.scanner(df, df, findings=labels)
    said = {(r["doc_id"], r["start"], r["end"]): r["secret"] for r in secrets.scan(df, model).collect()}
    held = [(said[i, a, b], bool(y)) for i, a, b, y in truth if i % 3 == 0]
    right = sum(s and y for s, y in held)
    precision, recall = right / sum(s for s, _ in held), right / sum(y for _, y in held)
    assert len(held) == 300 and precision > 0.95 and recall > 0.95, (precision, recall)


def test_scan_equals_a_plain_loop(spark):
    docs, _ = made(60, 5)
    docs += [(100, None, "x"), (101, "", None), (102, "password = hunter22example and AKIA" + "ABCDEFGH" * 2, "c"), (102, "token: " + "ab1" * 200, "c"), (103, "x" * 5000 + " " + "Zq9" * 30, None)]
    df = spark.createDataFrame(docs, SCHEMA).repartition(4)
    model = secrets.scanner(df, df)
    want = []
    for doc_id, text, path in docs:
        for start, end, kind in secrets.candidates(text or ""):
            row = secrets.features(text, start, end, kind, path or "", model.known)
            score = sum(walked(t, row) for t in model.forest.trees) / len(model.forest.trees)
            want.append((doc_id, secrets.KINDS[kind], start, end, round(float(score), 9), score >= 0.5))
    got = [(r["doc_id"], r["kind"], r["start"], r["end"], round(r["score"], 9), r["secret"]) for r in secrets.scan(df, model).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and len(got) >= 64


@pytest.mark.parametrize("text, before, after", [("one two three VALUE four five", ["three", "two"], ["four"]), ("VALUE", [], []), ("w" * 100 + "  " * 50 + "VALUE" + "-" * 90 + "next", ["w" * 100], ["next"]), ("\u00e9t\u00e9_a=VALUE", ["a", "\u00e9t\u00e9"], [])])
def test_neighbours_are_whole_words(text, before, after):
    start = text.index("VALUE")
    assert secrets.neighbours(text, start, start + 5) == (before, after)


def test_words_of_any_length_cover():
    known = secrets.Wording.of({b"internationalisation": 3, b"abc": 1})
    assert known.longest == 20 and secrets.coverage(b"internationalisationabcx", known) == 23 / 24
