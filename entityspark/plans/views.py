"""Contact records derived from the driver's tables, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from entityspark.functions import text as fx

#: Columns of the contacts view; the expressions mean the same in both engines.
CONTACTS = {
    "file_id": "o_orderkey % 3",
    "row_id": "o_orderkey",
    "primaryEmail": "CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE concat(' User', cast(c_custkey AS string), '@Example.com ') END",
    "additionalEmails": "CASE WHEN o_orderkey % 13 = 0 THEN concat('home', cast(cast(floor(c_custkey / 4) AS bigint) AS string), '@alt.org; user', cast(c_custkey AS string), '@example.com') ELSE '' END",
    "givenName": "CASE WHEN o_orderkey % 7 = 0 THEN ' ' ELSE c_name END",
    "tags": "concat(lower(c_mktsegment), ',', c_mktsegment, ', ,', o_orderpriority)",
    "action_type": "CASE o_orderpriority WHEN '1-URGENT' THEN 'ACTION_WEB_READ' WHEN '2-HIGH' THEN ' Web_Read ' WHEN '3-MEDIUM' THEN 'newsletterClick' WHEN '5-LOW' THEN 'zine' ELSE '' END",
    "action_timeSpent": "concat(' ', cast(cast(floor(o_totalprice) AS bigint) AS string), CASE WHEN o_orderkey % 17 = 0 THEN 's' ELSE '' END)",
    "obj_published": "cast(cast(o_orderdate AS date) AS string)",
}
ACTIONS = {"ACTION_NEWSLETTER_CLICK": "newsletter_click", "ACTION_WEB_READ": "web_read", "ACTION_FORM_SUBMIT": "form_submit"}

_UUID = (
    "substr(h,1,8) || '-' || substr(h,9,4) || '-5' || substr(h,14,3) || '-' || translate(substr(h,17,1),'0123456789abcdef','89ab89ab89ab89ab')"
    " || substr(h,18,3) || '-' || substr(h,21,12)"
)
WITH = (
    "WITH contacts AS (SELECT " + ", ".join(f'{e} AS "{n}"' for n, e in CONTACTS.items()) + " FROM orders JOIN customer ON o_custkey = c_custkey), "
    "valued AS (SELECT *, list_filter(list_concat([lower(trim(\"primaryEmail\"))], list_transform(regexp_split_to_array(\"additionalEmails\", '[,|;]+'), lambda x: lower(trim(x)))), lambda x: x <> '') AS emails FROM contacts), "
    f"hashed AS (SELECT *, emails[1] AS key, sha1(unhex('{fx.NAMESPACE}') || encode(emails[1])) AS h FROM valued), "
    f"keyed AS (SELECT * EXCLUDE (h), CASE WHEN key IS NOT NULL THEN {_UUID} END AS uuid FROM hashed), "
    "processed AS (SELECT row_id, uuid, row_id AS result_id FROM keyed WHERE row_id % 5 <> 0), "
    "counts AS (SELECT uuid, count(*) AS record_count, count(CASE WHEN row_id % 5 <> 0 THEN 1 END) AS processed_count FROM keyed WHERE uuid IS NOT NULL GROUP BY uuid), "
    "status AS (SELECT *, CASE WHEN record_count = processed_count THEN 'completed' WHEN processed_count > 0 THEN 'processing' ELSE 'pending' END AS status FROM counts) "
)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.expr("o_custkey = c_custkey"))
    return joined.selectExpr(*[f"{e} AS `{n}`" for n, e in CONTACTS.items()])


def keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contacts with their addresses, first value and identity."""
    c = contacts(spark, sf_dir)
    return c.withColumn("emails", fx.emails_of(c.columns)).withColumn("key", F.try_element_at("emails", F.lit(1))).withColumn("uuid", fx.uuid_v5(F.col("key"))).withColumn("global_row_index", F.col("row_id"))


def processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed(spark, sf_dir).where("row_id % 5 <> 0").select("row_id", "uuid", F.col("row_id").alias("result_id"))


def free_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a synthetic address line, so that every kind of detection has cases."""
    return read(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), F.col("doc_id").cast("string"), F.lit(" Maple Grove Street")).alias("text"))
