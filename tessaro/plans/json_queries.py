"""JSON without a given schema: columns, records and statistics that follow the data."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessaro.operators.context import ordered_concat
from tessaro.plans.catalog import query
from tessaro.session import table
from tessaro.sources import variants

#: Events of one list.
LIST_EVENTS = 20


def event_lists(spark, sf_dir):
    """(file, text): lists of events, every third with a nested object, every fifth with a list; and a text that is no JSON."""
    more = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(', "more": {"value": '), "value", F.lit(', "by": {"user": '), "user_id", F.lit("}}"))).otherwise("")
    tags = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit(', "tags": ["'), "event_type", F.lit('", '), F.col("event_id"), F.lit("]"))).otherwise("")
    line = F.concat(F.lit('{"id": '), "event_id", F.lit(', "kind": "'), "event_type", F.lit('"'), more, tags, F.lit("}"))
    events = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / LIST_EVENTS).alias("file"), "event_id", line.alias("line"))
    lists = events.groupBy("file").agg(F.concat(F.lit("["), ordered_concat(F.col("line"), F.col("event_id"), ", "), F.lit("]")).alias("text"))
    return lists.unionByName(lists.limit(1).select(F.lit(-1).cast("long").alias("file"), F.lit("[1, 2").alias("text")))


@query("SELECT event_id, (props->>'k')::BIGINT AS k FROM events")
def json_columns(spark, sf_dir):
    """The events' properties as columns, which the data name and type."""
    return variants.columns(variants.parsed(table(spark, sf_dir, "events").select("event_id", "props"), "props").drop("props"))


_EVENTS = f"e AS (SELECT *, event_id // {LIST_EVENTS} AS file, row_number() OVER (PARTITION BY event_id // {LIST_EVENTS} ORDER BY event_id) - 1 AS place FROM events)"


@query(
    f"""WITH {_EVENTS} SELECT file, place::BIGINT AS "at", event_id AS id, event_type AS kind, CASE WHEN event_id % 3 = 0 THEN user_id END AS by_user,
    CASE WHEN event_id % 3 = 0 THEN value END AS value, CASE WHEN event_id % 5 = 0 THEN '["' || event_type || '",' || event_id || ']' END AS tags FROM e"""
)
def json_records(spark, sf_dir):
    """A row a record of every list, nested objects as columns."""
    out = variants.columns(variants.records(event_lists(spark, sf_dir), "text"))
    return out.select("file", "at", "id", "kind", F.col("`more.by.user`").alias("by_user"), F.col("`more.value`").cast("double").alias("value"), "tags")


@query(f"""WITH {_EVENTS}, t AS (SELECT file, place, unnest([event_type, event_id::VARCHAR]) AS tag, unnest([0, 1]) AS pos FROM e WHERE event_id % 5 = 0)
    SELECT file, place::BIGINT AS "at", pos::BIGINT AS pos, tag FROM t""")
def json_list_elements(spark, sf_dir):
    """A row an element of the records' lists, strings and numbers alike."""
    found = variants.elements(variants.records(event_lists(spark, sf_dir), "text"), ("tags",))
    return found.select("file", "at", "pos", F.variant_get("v", "$", "string").alias("tag"))


@query(f"""WITH {_EVENTS}, n AS (SELECT file, 'id' AS field, event_id::DOUBLE AS x, 1 AS one FROM e UNION ALL SELECT file, 'kind', NULL, 1 FROM e
    UNION ALL SELECT file, 'more.value', value, 1 FROM e WHERE event_id % 3 = 0 UNION ALL SELECT file, 'more.by.user', user_id, 1 FROM e WHERE event_id % 3 = 0
    UNION ALL SELECT file, 'tags', NULL, 1 FROM e WHERE event_id % 5 = 0)
    SELECT file, field, count(*) AS n, count(x) AS n_numbers, min(x) AS low, max(x) AS high FROM n GROUP BY 1, 2""")
def json_field_statistics(spark, sf_dir):
    """Per list and field, however deep: how many values, and the extremes of the numbers; means are compared in the tests."""
    return variants.field_statistics(variants.records(event_lists(spark, sf_dir), "text"), ["file"]).drop("mean")
