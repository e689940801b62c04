"""Decontamination per row against brute force: repeated and null ids, long texts, ties, clashing names."""

import hashlib
import random
import re

import pytest

from entityspark.llm import winnowing

BETWEEN = re.compile("[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")


def words(text):
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return [w for w in BETWEEN.split((text or "").translate(str.maketrans(upper, upper.lower()))) if w]


def brute(docs, items, window=10):
    spans: dict[tuple, set] = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - window + 1)) if w and i is not None else ():
            spans.setdefault(tuple(w[k : k + window]), set()).add(str(i))
    out = []
    for i, t in docs:
        w, hit, names = words(t), set(), set()
        for m in {len(s) for s in spans}:
            for k in range(len(w) - m + 1):
                if (found := spans.get(tuple(w[k : k + m]))) is not None:
                    hit |= set(range(k, k + m))
                    names |= found
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def tables(spark):
    pick = random.Random(5)
    word = lambda n: " ".join(pick.choice(["Aä", "b", "cc", "1", "É", "zz9"]) for _ in range(n))
    items = [(i, word(pick.choice([3, 9, 10, 11, 25]))) for i in range(40)] + [(7, "another text of item seven that is quite long enough"), (None, word(12)), (50, None), (51, " .-"), (52, "solo")]
    passage = next(t for _, t in items if len(t.split()) >= 20)
    docs = [(i, f"{word(pick.randrange(30))}. {pick.choice([passage, 'plain', '', 'Solo!'])}, {word(pick.randrange(8))}") for i in range(60)]
    docs += [(5, passage), (5, "nothing here"), (None, passage), (None, None), (61, ""), (62, "only"), (63, passage), (63, passage)]
    docs += [(64, " ".join(["filler"] * 9000 + [passage] + ["tail"] * 5000)), (65, " ".join(["x"] * 4090 + [passage]))]
    return docs, items, spark.createDataFrame([(i, t, "q", "r", 1) for i, t in docs], "doc_id long, text string, k1 string, words string, at int"), spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("rows", [winnowing.BROADCAST_ROWS, 0])  # with broadcasts, and with shuffles alone
def test_every_row_equals_brute_force(tables, rows):
    docs, items, d, b = tables
    got = sorted((tuple(r) for r in winnowing.decontaminate(d, b, broadcast_rows=rows).collect()), key=str)
    assert got == brute(docs, items)


def test_removal_judges_every_row_by_its_text(tables):
    docs, items, d, b = tables
    kept = winnowing.remove_contaminated(d, b)
    assert kept.columns == d.columns
    clean = sorted([(r[0], t) for r, (_, t) in zip([brute([x], items)[0] for x in docs], docs) if not r[-1]], key=str)
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == clean
    assert winnowing.remove_contaminated(d.where("false"), b).count() == 0 and winnowing.remove_contaminated(d, b.where("false")).count() == len(docs)
