"""Spans and disclosing terms against brute force, long words and distant occurrences among them."""

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from entityspark.llm import disclosure

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(text):
    digits = [int(c) for c in text if c.isdigit()][::-1]
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0


def valid(kind, text):
    n = sum(c.isdigit() for c in text)
    return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in text.split(".")), "card": 14 <= n <= 19 and luhn(text), "phone": 10 <= n <= 15}[kind]


def base(text):
    return sorted((m.start(), i, m.end()) for i, (k, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text) if valid(k, m.group()))


def terms(texts, threshold=0.6, support=2, reach=8):
    words = lambda t: [m.span() for m in re.finditer(r"[^\W_]{3,}", t)]
    known, pairs, both, of_entity = Counter(), [], Counter(), Counter()
    for t in texts:
        known.update({t[a:b].lower() for a, b in words(t)})
        spans = base(t)
        free = [(a, b) for a, b in words(t) if all(b <= s or e <= a for s, _, e in spans)]
        near = set()
        for s, k, e in spans:
            name = f"{list(PATTERNS)[k]}:{t[s:e].lower()}"
            near |= {(name, t[a:b].lower()) for a, b in [x for x in free if x[1] <= s][-reach:] + [x for x in free if x[0] >= e][:reach]}
        both.update(near)
        of_entity.update({n for n, _ in near})
        pairs.append(({n for n, _ in near}, free))
    worth = {(e, w): 1 + math.log(n / known[w]) / max(math.log(len(texts) / of_entity[e]), 1e-9 * math.log(2)) for (e, w), n in both.items() if n >= support}
    flagged = {x for x, d in worth.items() if d >= threshold}
    return [sorted((a, b) for a, b in free if any((e, t[a:b].lower()) in flagged for e in names)) for t, (names, free) in zip(texts, pairs)]


def test_spans_and_terms_equal_brute_force(spark):
    pick = random.Random(11)
    bits = ["+1 (803) 555-5351", "4111 1111 1111 1111", "10.2.3.4", "010.02.3.256", "a.b@c-d.org", "x@y", "@", "..", "1.2.3.4.5.6.7.8", "+12", "5500-0000-0000-0004 9", "é@b.c", "q" * 310, "Quentin", "Ünal", "letter", "word", "other", "12", " - "]
    texts = [" ".join(pick.choice(bits) for _ in range(pick.randrange(25))) for _ in range(150)]
    texts += [f"Zebedee {'q' * 400} {'filler ' * 6}10.9.8.7 {'more ' * 40} zebedee" for _ in range(3)] + [f"plain text {i}" for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = {r["doc_id"]: r for r in disclosure.spans_of(docs).collect()}
    want = terms(texts)
    for i, t in enumerate(texts):
        assert sorted((x["start"], x["kind"], x["end"]) for x in rows[i]["spans"]) == base(t), t
        assert [(x["start"], x["end"]) for x in rows[i]["terms"] or []] == want[i], t
    assert len(want[150]) >= 2 and want[150][-1][1] == len(texts[150])  # far behind the address, and beyond a word of 400 letters
    kept = {r["doc_id"]: r["text"] for r in disclosure.sanitise(docs.orderBy(F.rand(3)), removal=2.0).collect()}
    assert "zebedee" not in kept[150].lower() and kept[200].startswith("plain") and "10.9.8.7" not in kept[151]
