"""Language filter and quality machine against plain re-computation, and ties."""

import random
from itertools import combinations

import numpy as np

from entityspark.llm import language, quality


def test_language_decisions_equal_sets(spark):
    """Counting with real sets of n-grams instead of the filter gives the same languages, beyond 64 of them too."""
    pick = random.Random(4)
    alphabets = ["".join(pick.sample("abcdefghijklmnopqrstuvwxyzäöüéß", 9)) for _ in range(70)]
    text = lambda k, n: " ".join("".join(pick.choice(alphabets[k]) for _ in range(pick.randrange(2, 7))) for _ in range(n))
    train = spark.createDataFrame([(text(k, 300), f"l{k:02d}") for k in range(70) for _ in range(2)] + [(None, "l00"), ("x", None)], "text string, lang string")
    model = language.train(train)
    assert len(model.languages) == 70 and len(model.masks) == 2
    counts = {(r["lang"], r["gram"]): r["n"] for r in language.gram_counts(train).collect()}
    totals: dict[str, int] = {}
    for (k, _), n in counts.items():
        totals[k] = totals.get(k, 0) + n
    rate = {x: n / totals[x[0]] for x, n in counts.items()}
    most: dict[int, float] = {}
    for (_, g), r in rate.items():
        most[g] = max(r, most.get(g, 0.0))
    known = {k: {g for (x, g), r in rate.items() if x == k and r >= 0.2 * most[g]} for k in model.languages}
    expected = {k: sum(r for (x, g), r in rate.items() if x == k and g in known[k]) for k in model.languages}

    asked = [(i, text(i % 70, 40)) for i in range(140)] + [(200, None), (201, ""), (202, "12 .")]
    got = {r["doc_id"]: r["lang_pred"] for r in language.predict(spark.createDataFrame(asked, "doc_id long, text string"), model).collect()}
    for i, t in asked[:140]:
        raw = (" " + t.lower() + " ").encode()
        kept = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in raw)
        grams = [int.from_bytes(kept[k : k + 4], "big") for k in range(len(kept) - 3) if sum(b != 32 for b in kept[k : k + 4]) >= 2]
        share = {k: sum(g in known[k] for g in grams) / expected[k] for k in model.languages}
        assert share[got[i]] >= 0.97 * max(share.values())  # the correction of false positives is an estimate
        assert got[i] == f"l{i % 70:02d}"
    assert {got[200], got[201], got[202]} == {"und"}


def test_language_ties_go_to_the_larger_language(spark):
    train = spark.createDataFrame([("same words here", "b"), ("same words here", "a"), ("same words here same", "c")], "text string, lang string")
    asked = spark.createDataFrame([(1, "same words here"), (2, "zzzz qqqq")], "doc_id long, text string")
    runs = [sorted(map(tuple, language.predict(asked, language.train(train.repartition(n))).collect())) for n in (1, 3)]
    assert runs[0] == runs[1] and [r[1] for r in runs[0]] == ["a", "c"]  # equal ones by name; nothing known: the largest


def test_margins_are_all_pairs(spark):
    labelled = spark.createDataFrame([(f"a calm sentence number {i}, and more. ", 1.0) for i in range(60)] + [(f"BUY!! NOW!! {i}!! ", 0.0) for i in range(60)] + [("tie", 1.0), ("tie", 0.0), (None, 0.0), ("null", None)], "text string, label double")
    machine = quality.train(labelled)
    again = quality.train(labelled.repartition(5))
    assert np.array_equal(machine.factors, again.factors) and machine.bias == again.bias  # the order of arrival does not matter
    docs = spark.createDataFrame([(1, "another calm sentence, BUY"), (2, ""), (3, None), (4, "tie " * 500)], "doc_id long, text string")
    for r in quality.score(docs, machine).collect():
        text = {1: "another calm sentence, BUY", 4: "tie " * 500}.get(r["doc_id"], "").encode()
        index, value = machine.features(*quality.row_features(text))
        margin = machine.bias + sum(float(machine.linear[i]) * float(v) for i, v in zip(index, value))
        margin += sum(float(machine.factors[i] @ machine.factors[j]) * float(v) * float(w) for (i, v), (j, w) in combinations(zip(index, value), 2))
        assert abs(1 / (1 + np.exp(-margin)) - r["score"]) < 1e-4
