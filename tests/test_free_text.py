"""Free-text masking: placeholders come back whatever the text holds, and long runs take linear time."""

import random
import time

from pyspark.sql import functions as F

from entityspark.operators import pii

BITS = [
    "PHONE_1", "EMAIL_1@GMAIL.COM", "ADDRESS_", "_1", "NAME_12", "ID_3", " ", "415-555-2671", "12-34-1234567890", "b@c.de", "x@y.zz", "9", "5", "\x02", "\x03", "\x04", "\x05", "\x00",
    "77 Old Mill Road", " Road ", "Street,", "St. ", "12 ", "é", "_", "(", "\n", "Ave", "a", "-", ".", "x", "1 ", "GMAIL.COM", "@GMAIL.COM", "_x",
]


def made(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice(BITS) for _ in range(r.randrange(1, 14))) for _ in range(n)]


def test_every_text_comes_back(spark):
    texts = ["call PHONE_1 or 415-555-2671", "77 Old Mill Road 5 apples", "12-34-1234567890", "415-555-2671@GMAIL.COM", *made(3000, 2)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    masked, table = pii.mask_texts(df, ["t"], "id")
    hidden = {r["id"]: r["t"] for r in masked.collect()}
    assert hidden[0] == "call PHONE_1 or PHONE_2" and hidden[1] == "ADDRESS_1\x025 apples"
    assert {r["id"]: r["t"] for r in pii.unmask(masked, ["t"], "id", table).collect()} == dict(enumerate(texts))


def test_addresses_as_by_the_pattern_alone(spark):
    texts = made(3000, 3) + ["é5 Old Road", "_5 Old Road ", "5 Old Road\n", "5 Road", "5   Road", "a 5 b 6 c Road d Street, 7 x Road"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = F.filter(F.regexp_extract_all("t", F.lit(pii.ADDRESS), F.lit(0)), pii.valid_address)
    label = pii._label("ADDRESS", pii.valid_address)
    both = df.select("t", plain.alias("want"), pii.detect(F.col("t"), "ADDRESS").alias("got"), pii.replace_matches(F.col("t"), pii.ADDRESS, label).alias("masked"), pii.replace_kind(F.col("t"), "ADDRESS", label).alias("shown"))
    assert both.where("want <> got OR masked <> shown").collect() == []
    assert both.where("size(got) > 0").count() > 50


def test_long_runs_take_linear_time(spark):
    runs = ["12 ab " * 170_000, "12 ab " * 85_000 + " Street 5 x " + "3 y " * 125_000]
    df = spark.createDataFrame([(t,) for t in runs], "t string").select(F.size(pii.matches(F.col("t"), "ADDRESS")).alias("n"), F.length(pii.mask_text(F.col("t"))).alias("m"))
    began = time.time()
    assert [r["n"] for r in df.collect()] == [0, 1]
    assert time.time() - began < 60  # trying every number took minutes for a tenth of this


def test_numbers_next_to_what_was_masked(spark):
    """A later kind sees a word boundary beside a placeholder, as beside the label that ``mask_text`` and the SQL write."""
    texts = ["61 4080166431094600 Elm. Von.\n44 Maple Grove Street", "x@y.zz.4 Old Mill Road", "61 4080166431094ADDRESS] 5", "61 4080166431094PHONE\x02EMAIL]", "9 Elm Street 61 4080166431094600 Oak Road"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    masked, table = pii.mask_texts(df, ["t"], "id")
    found = {r["value"] for r in table.collect()}
    assert {"61 4080166431094", "600 Elm. Von.\n44 Maple Grove Street", "x@y.zz", "4 Old Mill Road", "600 Oak Road"} <= found
    assert {r["id"]: r["t"] for r in pii.unmask(masked, ["t"], "id", table).collect()} == dict(enumerate(texts))


def test_texts_are_searched_once(spark):
    """The dictionary, the masked texts and the restored ones read what one search has stored; no kind's pattern is in their plans."""
    texts = made(300, 4)
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    masked, table = pii.mask_texts(df, ["t"], "id")
    back = pii.unmask(masked, ["t"], "id", table)
    for frame in (masked, table, back):
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        assert not any(word in plan for word in ("A-Za-z0-9._%+-", "[0-9]{1,4}", "Boulevard"))
    for kind in pii.KINDS:
        found = F.transform(F.filter(pii._found(F.col("t"), kind), lambda x: x["found"]), lambda x: x["text"])
        assert df.where(found != pii.detect(F.col("t"), kind)).collect() == []
    assert {r["id"]: r["t"] for r in back.collect()} == dict(enumerate(texts))
