"""Questions about tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessaro.operators import tabular
from tessaro.plans.catalog import query
from tessaro.session import table

_L = "l_quantity + l_extendedprice + l_discount + l_tax"


@query(f"SELECT l_orderkey, l_linenumber, round({_L}, 4) AS total FROM lineitem")
def row_totals(spark, sf_dir):
    rows = tabular.with_total(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return rows.select("l_orderkey", "l_linenumber", F.round("total", 4).alias("total"))


def customers(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")


def parts(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", F.col("p_size"), F.col("p_retailprice"))


_P = "p_partkey + p_size + p_retailprice"


@query("SELECT c_name, round(c_acctbal, 4) AS total FROM customer WHERE lower(c_name) IN (SELECT lower(c_name) FROM customer WHERE c_custkey = 42) ORDER BY c_custkey LIMIT 1")
def total_for_name(spark, sf_dir):
    df = customers(spark, sf_dir)
    name = df.where("c_custkey = 42").first()["c_name"]
    numbers = df.select("c_custkey", "c_name", "c_acctbal").withColumn("c_custkey", F.col("c_custkey").cast("string"))
    out = tabular.total_for_name(numbers, "c_name", "c_custkey", f"What is the total for {name}?")
    return out.select("c_name", F.round("total", 4).alias("total"))


@query(f"SELECT p_name, round({_P}, 4) AS total FROM part")
def list_all_sorted(spark, sf_dir):
    return tabular.all_sorted(parts(spark, sf_dir), "p_name", "p_partkey").select("p_name", F.round("total", 4).alias("total"))


def _who(direction):
    return f"SELECT p_name || ' (' || trunc({_P})::BIGINT || ')' AS answer FROM part ORDER BY {_P} {direction}, p_partkey LIMIT 1"


@query(_who("DESC"))
def who_has_most(spark, sf_dir):
    return tabular.extreme(parts(spark, sf_dir), "p_name", "p_partkey", most=True)


@query(_who("ASC"))
def who_has_least(spark, sf_dir):
    return tabular.extreme(parts(spark, sf_dir), "p_name", "p_partkey", most=False)


@query("SELECT count(*) AS n FROM customer")
def row_count(spark, sf_dir):
    return tabular.answer(customers(spark, sf_dir), "How many rows are there?", "c_custkey")[1]


@query("SELECT round(avg(c_acctbal), 4) AS mean_total FROM customer")
def mean_total(spark, sf_dir):
    return tabular.answer(customers(spark, sf_dir), "What is the average?", "c_custkey")[1].select(F.round("mean_total", 4).alias("mean_total"))


@query("SELECT c_mktsegment AS value, count(*) AS n FROM customer GROUP BY 1 ORDER BY n DESC, value LIMIT 5")
def value_counts_top5(spark, sf_dir):
    return tabular.value_counts(table(spark, sf_dir, "customer"), "c_mktsegment")


@query("SELECT p_brand AS value, count(*) AS n FROM part WHERE (SELECT count(DISTINCT p_brand) FROM part) BETWEEN 2 AND 10 GROUP BY 1 ORDER BY n DESC, value LIMIT 5")
def value_counts_wide(spark, sf_dir):
    """Empty where there are too many distinct values."""
    return tabular.value_counts(table(spark, sf_dir, "part"), "p_brand")


_STATS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count({c}) AS n, min({c}) AS min_value, max({c}) AS max_value, round(avg({c}), 4) AS mean_value, round(sum({c}), 2) AS total FROM lineitem"
        for c in _STATS
    )
)
def column_statistics(spark, sf_dir):
    out = tabular.column_statistics(table(spark, sf_dir, "lineitem"), list(_STATS))
    return out.select("column_name", "n", "min_value", "max_value", F.round("mean_value", 4).alias("mean_value"), F.round("total", 2).alias("total"))


@query("""WITH n AS (SELECT DISTINCT 'M' || strftime(o_orderdate, '%m') AS p, 'Y' || strftime(o_orderdate, '%Y') AS s FROM orders)
    SELECT min(p) || '__' || max(p) || ' x ' || min(s) || '__' || max(s) || ' (' || count(*) || ' columns: ' || min(p || '_' || s) || '...' || max(p || '_' || s) || ')' AS pattern FROM n""")
def column_patterns(spark, sf_dir):
    """What is said of the columns of a wide table: orders by status, a column a month of each year."""
    month = F.concat(F.lit("M"), F.date_format("o_orderdate", "MM"), F.lit("_Y"), F.date_format("o_orderdate", "yyyy"))
    wide = table(spark, sf_dir, "orders").withColumn("month", month).groupBy("o_orderstatus").pivot("month").count()
    return spark.range(1).select(F.lit(tabular.column_pattern(wide.columns[1:])).alias("pattern"))


@query("SELECT n_name, (n_nationkey + n_regionkey)::DOUBLE AS total FROM nation")
def ir_row_sum(spark, sf_dir):
    out = tabular.run_query(table(spark, sf_dir, "nation"), tabular.Query("row_sum"))
    return out.select("n_name", F.col("total").cast("double").alias("total"))


@query("SELECT sum(l_linenumber)::BIGINT AS total FROM lineitem")
def ir_col_sum(spark, sf_dir):
    return tabular.run_query(table(spark, sf_dir, "lineitem"), tabular.Query("col_sum", col="l_linenumber"))


_CELLS = """cells AS (SELECT s_nationkey::VARCHAR AS sheet, (row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1)::INT AS row, s_name, s_suppkey, s_acctbal FROM supplier),
wide AS (SELECT sheet, row, 0 AS col, s_name AS value FROM cells UNION ALL SELECT sheet, row, 1, CASE WHEN row > 0 THEN s_suppkey::VARCHAR END FROM cells
         UNION ALL SELECT sheet, row, 2, CASE WHEN row > 0 THEN 'g' || (s_suppkey % 3) END FROM cells)"""


@query(
    f"""WITH {_CELLS}, shape AS (SELECT sheet, max(row) + 1 AS height FROM wide GROUP BY 1),
    titles AS (SELECT sheet, row, count(DISTINCT value) <= 1 AS title FROM wide WHERE row < 3 GROUP BY 1, 2),
    cand AS (SELECT s.sheet, r.row AS header_row, k AS n_rows, coalesce(t.title, false) AS title, height FROM shape s JOIN (SELECT DISTINCT sheet, row FROM wide WHERE row < 5) r USING (sheet)
             LEFT JOIN titles t ON t.sheet = s.sheet AND t.row = r.row, (VALUES (1), (2)) v(k) WHERE r.row + k < height AND (k = 1 OR (NOT coalesce(t.title, false) AND r.row + 1 < 5))),
    nm AS (SELECT c.sheet, c.header_row, c.n_rows, w.col, string_agg(w.value, '_' ORDER BY w.row) AS name FROM cand c JOIN wide w ON w.sheet = c.sheet AND w.value IS NOT NULL AND w.row >= c.header_row AND w.row < c.header_row + c.n_rows GROUP BY ALL),
    tally AS (SELECT sheet, header_row, n_rows, count(*) AS named, count(DISTINCT name) AS dist, count(*) FILTER (regexp_full_match(translate(name, CASE n_rows WHEN 1 THEN '.-' ELSE '._-' END, ''), '[0-9]+')) AS num FROM nm GROUP BY ALL)
    SELECT c.sheet, c.header_row::INT AS header_row, c.n_rows::INT AS n_rows, (CASE WHEN c.n_rows = 1 THEN 10 * named + greatest(height - c.header_row - 1, 0) - CASE WHEN title THEN 50 ELSE 0 END - 8 * num
        ELSE 10 * dist + greatest(height - c.header_row - 2, 0) - 15 * (named - dist) - 8 * num END)::BIGINT AS score FROM cand c JOIN tally USING (sheet, header_row, n_rows)"""
)
def header_score(spark, sf_dir):
    """Suppliers of a nation as a sheet whose first row has a name alone."""
    from pyspark.sql import Window

    s = table(spark, sf_dir, "supplier")
    s = s.withColumn("row", F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")) - 1)
    later = lambda v: F.when(F.col("row") > 0, v)
    values = [F.col("s_name"), later(F.col("s_suppkey").cast("string")), later(F.concat(F.lit("g"), (F.col("s_suppkey") % 3).cast("string")))]
    cells = s.select(F.col("s_nationkey").cast("string").alias("sheet"), "row", F.posexplode(F.array(*values)).alias("col", "value"))
    out = tabular.header_scores(cells)
    return out.select("sheet", F.col("header_row").cast("int").alias("header_row"), F.col("n_rows").cast("int").alias("n_rows"), F.col("score").cast("long").alias("score"))


@query("SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 1")
def ir_value_counts(spark, sf_dir):
    return tabular.run_query(table(spark, sf_dir, "orders"), tabular.Query("value_counts", "o_orderpriority"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment ILIKE '%build%'")
def ir_filter_contains(spark, sf_dir):
    return tabular.run_query(table(spark, sf_dir, "customer"), tabular.Query("filter_contains", "c_mktsegment", "build")).select("c_custkey", "c_name")


@query("SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F'")
def ir_count_where(spark, sf_dir):
    return tabular.run_query(table(spark, sf_dir, "orders"), tabular.Query("count_where", "o_orderstatus", "F"))


@query("SELECT c_name FROM customer ORDER BY c_acctbal DESC, c_name DESC LIMIT 1")
def ir_argmax(spark, sf_dir):
    return tabular.run_query(table(spark, sf_dir, "customer"), tabular.Query("argmax", "c_acctbal", label="c_name"))
