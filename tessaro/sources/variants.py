"""JSON of unknown shape as VARIANT: lists leave the row as rows, columns follow the data, numbers are summed up."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, NullType, StructType, VariantType

from tessaro.sources.shared import new_folder, written

_NUMBER = r"^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL\b.*)$"


def kind(value: Column) -> Column:
    """What a variant is: object, list, number, text or other; null for SQL's null."""
    shape = F.schema_of_variant(value)
    return (
        F.when(shape.startswith("OBJECT"), "object").when(shape.startswith("ARRAY"), "list").when(shape.rlike(_NUMBER), "number")
        .when(shape == "STRING", "text").when(shape.isNotNull(), "other")
    )


def parsed(rows: DataFrame, text: str, name: str = "v") -> DataFrame:
    """rows with text parsed; null where it is no JSON."""
    return rows.withColumn(name, F.try_parse_json(text))


def _exploded(rows: DataFrame, column: str) -> DataFrame:
    """rows with pos, key and value of every element or field of a variant column."""
    return rows.lateralJoin(rows.sparkSession.tvf.variant_explode(F.col(column).outer()))


def records(rows: DataFrame, text: str, name: str = "v") -> DataFrame:
    """rows, without text, once a record: ``at`` and the record.  A list gives its elements, numbered from 0; anything else is one record; invalid text gives none."""
    every = parsed(rows, text, name).drop(text).where(F.col(name).isNotNull())
    rest = [c for c in every.columns if c != name]
    lists = _exploded(every.where(kind(F.col(name)) == "list"), name).select(*rest, F.col("pos").cast("long").alias("at"), F.col("value").alias(name))
    single = every.where(kind(F.col(name)) != "list").select(*rest, F.lit(0).cast("long").alias("at"), name)
    return lists.unionByName(single)


def shape(rows: DataFrame, name: str = "v") -> DataType:
    """The type that all values of a variant column fit, by one aggregation over them."""
    said = rows.agg(F.schema_of_variant_agg(name)).first()[0] or "VOID"
    # Names in backquotes are left as they are.
    return DataType.fromDDL("".join(p if p.startswith("`") else p.replace("OBJECT<", "STRUCT<") for p in re.split(r"(`(?:[^`]|``)*`)", said)))


def leaves(found: DataType, at: tuple[str, ...] = ()) -> list[tuple[tuple[str, ...], DataType]]:
    """(names from the top, type) of everything in a shape that is no object."""
    if isinstance(found, StructType) and (found.fields or not at):
        return [leaf for f in found.fields for leaf in leaves(f.dataType, (*at, f.name))]
    return [(at, found)] if at else []


def path_of(names: tuple[str, ...]) -> str:
    quoted = (f'"{n}"' if '"' not in n else f"'{n}'" for n in names)
    return "$" + "".join(f"[{q}]" for q in quoted)


def columns(rows: DataFrame, name: str = "v") -> DataFrame:
    """rows with the fields of a variant column in its place, nested ones under dotted names, sorted; lists and mixed values as JSON.  Values that are no objects give nulls."""
    plain = [c for c in rows.columns if c != name]
    out = []
    for names, found in sorted(leaves(shape(rows.where(kind(F.col(name)) == "object"), name)), key=lambda leaf: leaf[0]):
        text = isinstance(found, (VariantType, ArrayType, StructType, NullType))
        value = F.try_variant_get(name, path_of(names), "variant" if text else found.simpleString())
        out.append((F.to_json(value) if text else value).alias(".".join(names)))
    return rows.select(*plain, *out)


def elements(rows: DataFrame, field: tuple[str, ...], name: str = "v") -> DataFrame:
    """rows once an element of a list field of the variant: ``pos`` and the element in the variant's place; other rows have none."""
    plain = [c for c in rows.columns if c != name]
    lists = rows.withColumn(name, F.try_variant_get(name, path_of(field), "variant")).where(kind(F.col(name)) == "list")
    return _exploded(lists, name).select(*plain, F.col("pos").cast("long").alias("pos"), F.col("value").alias(name))


def fields(rows: DataFrame, name: str = "v", depth: int | None = None) -> DataFrame:
    """rows once a field of the variant's objects, however deep: ``field`` (dotted names) and ``value``.

    Objects are opened level by level until no row has one more, so the plan grows with
    their depth, not with the number of fields; or only so many levels, without looking
    at the data, and deeper objects are values.  Values that are no objects have no fields.
    Rows that are looked at are written first: they are parsed once, and Spark deals out
    their levels by splits of files instead of reading all levels of one partition in one task.
    """
    plain = [c for c in rows.columns if c != name]
    if depth is None:
        rows = written(rows.where(kind(F.col(name)) == "object"), new_folder(rows.sparkSession, "objects"))
    level = rows.where(kind(F.col(name)) == "object").withColumn("field", F.lit(None).cast("string")).withColumnRenamed(name, "value")
    out, done = level.limit(0), 0
    while done < depth if depth else not level.isEmpty():
        done += 1
        inside = _exploded(level.withColumnRenamed("value", "_object"), "_object").where(F.col("key").isNotNull())
        level = inside.select(*plain, F.concat_ws(".", "field", "key").alias("field"), "value")
        ends = F.lit(True) if done == depth else F.coalesce(kind(F.col("value")) != "object", F.lit(True))
        out = out.unionByName(level.where(ends))
        level = level.where(kind(F.col("value")) == "object")
    return out


def field_statistics(rows: DataFrame, keys: list[str], name: str = "v", depth: int | None = None) -> DataFrame:
    """Per key and field: n (values that are not null), n_numbers, and low, high and mean (two decimals) of the numbers."""
    found = fields(rows.select(*keys, name), name, depth)
    number = F.when(kind(F.col("value")) == "number", F.try_variant_get("value", "$", "double"))
    there = F.coalesce(~F.is_variant_null("value"), F.lit(False))
    return found.groupBy(*keys, "field").agg(
        F.count_if(there).alias("n"), F.count(number).alias("n_numbers"), F.min(number).alias("low"), F.max(number).alias("high"), F.round(F.avg(number), 2).alias("mean")
    )


