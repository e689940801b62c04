"""Queries over nested records: required fields and other rules along array paths, unwrapping, masking at any depth."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from entityspark.functions import text as fx
from entityspark.operators import checks, nested, pii
from entityspark.plans.registry import query
from entityspark.plans.views import WITH, contacts, processed, read


def _wrapped(c):  # noqa: ANN001, ANN202
    given = ~fx.is_blank(c)
    return F.struct(F.when(given, fx.js_trim(c)).alias("value"), given.alias("present"))


def _results(s: SparkSession, d: str) -> DataFrame:
    """Contacts as nested results: ``person``, absent in some, with wrapped fields in it and in the items of its lists."""
    mails = F.transform(F.split("additionalEmails", ";"), lambda x, i: F.struct(F.concat(F.lit("m"), i.cast("string")).alias("kind"), _wrapped(x).alias("address")))
    labels = F.transform(F.split("tags", ","), lambda x: F.struct(_wrapped(x).alias("label")))
    about = F.struct(F.struct(labels.alias("value"), (F.col("row_id") % 3 > 0).alias("present")).alias("interests"), F.col("obj_published").alias("since"))
    person = F.struct(F.lit("https://schema.org/").alias("@context"), _wrapped(F.col("givenName")).alias("name"), mails.alias("mails"), about.alias("about"))
    return contacts(s, d).select("row_id", F.floor(F.col("row_id") / 50).alias("batch_id"), F.when(F.col("row_id") % 19 > 0, person).alias("person"))


MISSING = (
    "missing AS (SELECT row_id, 'person.name' AS path FROM there WHERE trim(\"givenName\") = '' "
    "UNION ALL SELECT row_id, 'person.mails[' || (i - 1) || '].address' FROM (SELECT row_id, string_split(\"additionalEmails\", ';') AS v, unnest(generate_series(1, len(v))) AS i FROM there) WHERE trim(v[i]) = '' "
    "UNION ALL SELECT row_id, 'person.about.interests' FROM there WHERE row_id % 3 = 0 "
    "UNION ALL SELECT row_id, 'person.about.interests[' || (i - 1) || '].label' FROM (SELECT row_id, string_split(tags, ',') AS v, unnest(generate_series(1, len(v))) AS i FROM there WHERE row_id % 3 > 0) WHERE trim(v[i]) = '')"
)
THERE = f"{WITH.rstrip()}, there AS (SELECT * FROM keyed WHERE row_id % 19 > 0), {MISSING}"


@query("v_required_nested", f"{THERE} SELECT row_id, path, 'required' AS rule FROM missing")
def v_required_nested(s: SparkSession, d: str) -> DataFrame:
    """Every wrapped field that is not present, with its path, anywhere in the results."""
    results = _results(s, d)
    return checks.validate(results, checks.required_constraints(results, ["person"])).select("row_id", "path", "rule")


@query(
    "unwrap_required_nested",
    f"""{WITH} SELECT row_id, nullif(trim("givenName"), '') AS name, array_to_string(list_transform(string_split("additionalEmails", ';'), lambda x: coalesce(nullif(trim(x), ''), '-')), '|') AS mails,
  CASE WHEN row_id % 3 > 0 THEN array_to_string(list_transform(string_split(tags, ','), lambda x: coalesce(nullif(trim(x), ''), '-')), '|') END AS interests, obj_published AS since FROM keyed WHERE row_id % 19 > 0
UNION ALL SELECT row_id, NULL, NULL, NULL, NULL FROM keyed WHERE row_id % 19 = 0""",
)
def unwrap_required_nested(s: SparkSession, d: str) -> DataFrame:
    results = _results(s, d)
    plain = results.select("row_id", nested.unwrap(F.col("person"), results.schema["person"].dataType).alias("p"))
    dashed = lambda c: F.array_join(c, "|", "-")
    return plain.select("row_id", "p.name", dashed(F.col("p.mails.address")).alias("mails"), dashed(F.col("p.about.interests.label")).alias("interests"), "p.about.since")


LINES = [
    checks.Constraint("lines[].quantity", minimum=3, maximum=40), checks.Constraint("lines[].how.state", one_of=("O",)),
    checks.Constraint("lines[].how.flag", pattern="^[AN]$"), checks.Constraint("lines", max_items=6), checks.Constraint("lines[].dates[]", format="date"),
]


@query(
    "v_nested_paths",
    """WITH l AS (SELECT l_orderkey AS row_id, l_linenumber AS n, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_linestatus, l_returnflag, l_shipdate) - 1 AS i, l_quantity, l_linestatus, l_returnflag FROM lineitem)
SELECT row_id, 'lines[' || i || '].quantity' AS path, 'range' AS rule FROM l WHERE l_quantity NOT BETWEEN 3 AND 40
UNION ALL SELECT row_id, 'lines[' || i || '].how.state', 'enum' FROM l WHERE l_linestatus <> 'O'
UNION ALL SELECT row_id, 'lines[' || i || '].how.flag', 'pattern' FROM l WHERE l_returnflag = 'R'
UNION ALL SELECT row_id, 'lines[' || i || '].dates[1]', 'format' FROM l WHERE n % 5 = 0
UNION ALL SELECT row_id, 'lines', 'items' FROM l GROUP BY row_id HAVING count(*) > 6""",
)
def v_nested_paths(s: SparkSession, d: str) -> DataFrame:
    """Rules on the items of orders, some of whose dates are badly written."""
    date = F.col("l_shipdate").cast("date").cast("string")
    line = F.struct(F.col("l_linenumber").alias("n"), F.col("l_quantity").alias("quantity"), F.struct(F.col("l_linestatus").alias("state"), F.col("l_returnflag").alias("flag")).alias("how"), F.array(date, F.when(F.col("l_linenumber") % 5 == 0, F.replace(date, F.lit("-"), F.lit("/"))).otherwise(date)).alias("dates"))
    rows = read(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("row_id")).agg(F.array_sort(F.collect_list(line)).alias("lines"))
    return checks.validate(rows, LINES).select("row_id", "path", "rule")


@query(
    "validate_batches",
    f"""{THERE}, given AS (SELECT row_id, row_id // 50 AS batch_id FROM keyed), got AS (SELECT * FROM given WHERE batch_id % 4 > 0 OR row_id % 5 > 0),
of_batch AS (SELECT batch_id, count(*) AS n, count(*) FILTER (batch_id % 4 > 0 OR row_id % 5 > 0) AS m FROM given GROUP BY batch_id), wrong AS (SELECT * FROM of_batch WHERE n <> m),
of_row AS (SELECT batch_id, row_id, 'required' AS stage, path, 'Required field ''' || regexp_extract(path, '([^.]*)$', 1) || ''' is missing or null' AS message FROM missing JOIN got USING (row_id)
  UNION ALL SELECT batch_id, row_id, 'schema', 'person.about.since', 'since: expected ^199[2-5], got ' || obj_published FROM there JOIN got USING (row_id) WHERE NOT regexp_matches(obj_published, '^199[2-5]'))
SELECT batch_id, NULL AS row_id, 'length' AS stage, 'results' AS path, 'Expected ' || n || ' results, got ' || m AS message FROM wrong
UNION ALL SELECT * FROM of_row WHERE batch_id NOT IN (SELECT batch_id FROM wrong)""",
)
def validate_batches(s: SparkSession, d: str) -> DataFrame:
    """Length, required fields and other rules of batches, a quarter of which lost results."""
    rows = _results(s, d)
    got = rows.where("batch_id % 4 > 0").unionByName(rows.where("batch_id % 4 = 0").join(processed(s, d).select("row_id"), "row_id", "left_semi"))
    rules = [*checks.required_constraints(rows, ["person"]), checks.Constraint("person.about.since", pattern="^199[2-5]")]
    return checks.validate_batches(rows, got, rules).select("batch_id", "row_id", "stage", "path", "message")


# masking at any depth (2.7)
HIDDEN = {"people[].name": ("NAME", False), "people[].contact.mails": ("EMAIL", True)}
PEOPLE_SQL = (
    "items AS (SELECT row_id, 0 AS field, 0 AS pos, \"givenName\" AS value, 'NAME' AS template FROM keyed WHERE trim(\"givenName\") <> '' "
    "UNION ALL SELECT row_id, 0, 1, 'Known ' || file_id, 'NAME' FROM keyed "
    "UNION ALL SELECT row_id, 1, generate_subscripts(v, 1), unnest(v), 'EMAIL' FROM (SELECT row_id, list_filter(list_transform(regexp_split_to_array(\"additionalEmails\", '[,|;]+'), lambda x: trim(x)), lambda x: x <> '') AS v FROM keyed)), "
    "firsts AS (SELECT value, arg_min(template, (row_id, field, pos)) AS template, min((row_id, field, pos)) AS o FROM items GROUP BY value), "
    "named AS (SELECT value, template || '_' || row_number() OVER (PARTITION BY template ORDER BY o) || CASE template WHEN 'EMAIL' THEN '@GMAIL.COM' ELSE '' END AS placeholder FROM firsts), "
    "mails AS (SELECT row_id, string_agg(placeholder, ', ' ORDER BY pos) AS masked FROM items JOIN named USING (value) WHERE field = 1 GROUP BY row_id)"
)


def _people(s: SparkSession, d: str) -> DataFrame:
    """Two people a row, the second without contact."""
    first = F.struct(F.col("givenName").alias("name"), F.struct(F.col("additionalEmails").alias("mails"), F.lit("en").alias("language")).alias("contact"))
    second = F.struct(F.concat(F.lit("Known "), F.col("file_id").cast("string")).alias("name"), F.lit(None).cast("struct<mails:string,language:string>").alias("contact"))
    return contacts(s, d).select("row_id", F.array(first, second).alias("people"), "tags")


@query(
    "pii_mask_nested",
    f"""{WITH.rstrip()}, {PEOPLE_SQL} SELECT row_id, coalesce(a.placeholder, "givenName") AS first_name, b.placeholder AS second_name, coalesce(masked, "additionalEmails") AS mails, 'en' AS language
FROM keyed k LEFT JOIN named a ON "givenName" = a.value LEFT JOIN named b ON 'Known ' || file_id = b.value LEFT JOIN mails USING (row_id)""",
)
def pii_mask_nested(s: SparkSession, d: str) -> DataFrame:
    masked = pii.mask_nested(_people(s, d), HIDDEN, "row_id")[0]
    first = F.col("people")[0]
    return masked.select("row_id", first["name"].alias("first_name"), F.col("people")[1]["name"].alias("second_name"), first["contact"]["mails"].alias("mails"), first["contact"]["language"].alias("language"))


@query(
    "pii_unmask_nested",
    f"""{WITH} SELECT row_id, "givenName" AS name, array_to_string(list_filter(list_transform(regexp_split_to_array("additionalEmails", '[,|;]+'), lambda x: trim(x)), lambda x: x <> ''), ', ') AS mails,
  'Hello ' || "givenName" || ' and Known ' || file_id || '!' AS greeting FROM keyed""",
)
def pii_unmask_nested(s: SparkSession, d: str) -> DataFrame:
    """What a resolver would return for masked people, nested otherwise, restored."""
    masked, table = pii.mask_nested(_people(s, d), HIDDEN, "row_id")
    first, second = F.col("people")[0], F.col("people")[1]
    greeting = F.concat(F.lit("Hello "), first["name"], F.lit(" and "), second["name"], F.lit("!"))
    answer = masked.select("row_id", F.struct(F.array(F.struct(first["name"].alias("name"), F.create_map(F.lit("mails"), first["contact"]["mails"]).alias("contact"))).alias("people"), greeting.alias("greeting")).alias("a"))
    back = pii.unmask(answer, ["a"], "row_id", table)
    return back.select("row_id", F.col("a.people")[0]["name"].alias("name"), F.col("a.people")[0]["contact"]["mails"].alias("mails"), "a.greeting")
