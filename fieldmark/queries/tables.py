"""Queries on self-report tables, footers and read outcomes."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from fieldmark.functions import scalars
from fieldmark.operators import outcomes as out
from fieldmark.operators import tables
from fieldmark.queries.catalog import sink_folder
from fieldmark.queries.fixtures import CUT, LABELLED, OUTCOMES, REPORT, TOKENS, documents_cut, documents_labelled, documents_tokens, orders_as_report, outcomes, r6, register, rounded, table
from fieldmark.schemas import DATE_COLUMNS, PLAYER_COLUMNS, SENSOR_COLUMNS
from fieldmark.sources import readers, sinks


@register("src_csv_na_tokens", f"WITH {TOKENS} SELECT doc_id, CASE WHEN lang NOT IN ('NA', 'null') THEN lang END AS lang FROM documents_tokens")
def _(spark, d):
    return documents_tokens(spark, d).select("doc_id", scalars.missing_if_token(F.col("lang")).alias("lang"))


def csv_folder(spark, d):
    """The self-report tables written as CSV files, for the scans that start from files."""
    root = f"{sink_folder(spark)}/csv-{uuid.uuid4().hex[:8]}"
    for name, df in (("documents_cut", documents_cut(spark, d)), ("documents_labelled", documents_labelled(spark, d))):
        df.write.option("header", True).csv(f"{root}/{name}")
    return root


@register("src_csv_tables")
def _(spark, d):
    found = readers.csv_tables(spark, csv_folder(spark, d))
    return found.select("category", "filename")


@register("src_csv_inferred_types")
def _(spark, d):
    typed = readers.read_csv_table(spark, f"{csv_folder(spark, d)}/documents_labelled")
    return tables.column_inventory(typed).select("column", "dtype")


@register("src_footer_catalog")
def _(spark, d):
    return readers.footer_catalog(spark, d)


@register("agg_footer_stats")
def _(spark, d):
    return out.footer_stats(readers.footer_catalog(spark, d))


@register("check_missing_columns")
def _(spark, d):
    return out.missing_columns(SENSOR_COLUMNS, readers.footer_catalog(spark, d))


@register("error_isolation")
def _(spark, d):
    files = readers.list_files(spark, d)
    return out.kept_left(files, readers.footer_catalog(spark, d).drop("columns"), "path", ["row_count", "column_count", "row_groups"])


@register("sink_schema_definitions")
def _(spark, d):
    path = f"{sink_folder(spark)}/schemas"
    sinks.write_schema_definitions(out.schema_examples(outcomes(spark, d), "ordinal"), path)
    return spark.read.text(path)


@register("filter_success_failure", f"WITH {OUTCOMES} SELECT ordinal, error = '' AS ok FROM outcomes")
def _(spark, d):
    rows = outcomes(spark, d)
    return out.successes(rows).select("ordinal", F.lit(True).alias("ok")).unionByName(out.failures(rows).select("ordinal", F.lit(False).alias("ok")))


@register("agg_schema_frequency", f"WITH {OUTCOMES} SELECT schema_id, count(*) AS files FROM outcomes WHERE error = '' GROUP BY schema_id")
def _(spark, d):
    return out.schema_frequency(outcomes(spark, d))


@register("agg_read_outcomes", f"WITH {OUTCOMES} SELECT count(*) AS inspected, count(*) FILTER (WHERE error = '') AS succeeded, count(*) FILTER (WHERE error <> '') AS failed, count(DISTINCT CASE WHEN error = '' THEN schema_id END) AS unique_schemas FROM outcomes")
def _(spark, d):
    return out.read_outcomes(outcomes(spark, d))


@register("agg_schema_examples", f"WITH {OUTCOMES} SELECT schema_id, schema_text FROM (SELECT schema_id, schema_text, row_number() OVER (PARTITION BY schema_id ORDER BY ordinal) AS k FROM outcomes) o WHERE k = 1")
def _(spark, d):
    return out.schema_examples(outcomes(spark, d), "ordinal")


#: The columns of each source as a table of columns: the source decides which names it has.
COLUMNS = """columns AS (SELECT source AS table_name, g.ordinal, CASE WHEN (length(source) + g.ordinal) % 3 = 0 THEN g.a ELSE g.b END AS name FROM (SELECT DISTINCT source FROM documents) s
  CROSS JOIN (VALUES (0, 'note', 'ATHLETE'), (1, 'Player', 'score'), (2, 'created_at', 'PLAYER'), (3, 'Date', 'value'), (4, 'player_name', 'time')) g(ordinal, a, b))"""


def column_rows(spark, d):
    names = table(spark, d, "documents").select(F.col("source").alias("table_name")).distinct()
    both = [("note", "ATHLETE"), ("Player", "score"), ("created_at", "PLAYER"), ("Date", "value"), ("player_name", "time")]
    pick = [F.struct(F.lit(i).alias("ordinal"), F.when((F.length("table_name") + i) % 3 == 0, a).otherwise(b).alias("column")) for i, (a, b) in enumerate(both)]
    return names.select("table_name", F.inline(F.array(*pick)))


def resolve_sql(out_name, names):
    rank = "CASE lower(name) " + " ".join(f"WHEN '{n}' THEN {i}" for i, n in enumerate(names)) + " END"
    return f"""WITH {COLUMNS} SELECT table_name, coalesce(max(CASE WHEN k = 1 AND r IS NOT NULL THEN name END), '') AS {out_name} FROM (
      SELECT table_name, name, {rank} AS r, row_number() OVER (PARTITION BY table_name ORDER BY coalesce({rank}, 99), ordinal DESC) AS k FROM columns) c GROUP BY table_name"""


@register("resolve_player_column", resolve_sql("player_column", ["player_name", "player", "player_id", "athlete", "athlete_id"]))
def _(spark, d):
    return tables.resolve_player_column(column_rows(spark, d))


@register("resolve_date_column", resolve_sql("date_column", ["timestamp", "date", "datetime", "time", "created_at"]))
def _(spark, d):
    return tables.resolve_date_column(column_rows(spark, d))


WANTED = [*PLAYER_COLUMNS, *DATE_COLUMNS]


@register("set_missing_columns", f"""WITH {COLUMNS}, wanted AS (SELECT unnest({WANTED}) AS missing) SELECT t.table_name, w.missing FROM (SELECT DISTINCT table_name FROM columns) t CROSS JOIN wanted w
  WHERE NOT EXISTS (SELECT 1 FROM columns c WHERE c.table_name = t.table_name AND lower(c.name) = w.missing)""")  # fmt: skip
def _(spark, d):
    have = column_rows(spark, d).groupBy(F.col("table_name").alias("path")).agg(F.collect_set(F.lower("column")).alias("columns"))
    return out.missing_columns(WANTED, have).select(F.col("path").alias("table_name"), F.explode("missing_columns").alias("missing"))


@register("fn_parse_date", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS parsed FROM orders")
def _(spark, d):
    text = F.when(F.col("o_orderkey") % 4 == 0, "99-99").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return table(spark, d, "orders").select("o_orderkey", scalars.parse_date(text).cast("string").alias("parsed"))


@register("agg_table_shape", f"WITH {LABELLED} SELECT count(*) AS rows, 6 AS columns, 'doc_id;lang;source;quality;toxic;score' AS column_names FROM documents_labelled")
def _(spark, d):
    return tables.table_shape(documents_labelled(spark, d))


@register("agg_unique_players", f"WITH {REPORT} SELECT count(DISTINCT player) AS unique_players FROM report")
def _(spark, d):
    return tables.unique_players(orders_as_report(spark, d), "player")


@register("agg_date_range", f"WITH {REPORT} SELECT coalesce(strftime(min(date), '%Y-%m-%d %H:%M:%S'), '') AS first_date, coalesce(strftime(max(date), '%Y-%m-%d %H:%M:%S'), '') AS last_date FROM report")
def _(spark, d):
    return tables.date_range(orders_as_report(spark, d), "date")


MISS = " + ".join(f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END" for c in ("doc_id", "lang", "source", "quality", "toxic", "score"))


@register("agg_table_missing", f"WITH {LABELLED} SELECT CAST(sum({MISS}) AS BIGINT) AS total_missing_cells, round(sum({MISS}) / (count(*) * 6.0), 6) AS missing_fraction FROM documents_labelled")
def _(spark, d):
    return rounded(tables.table_missing(documents_labelled(spark, d)), "missing_fraction")


@register("agg_duplicate_rows", f"WITH {CUT} SELECT CAST(sum(n - 1) AS BIGINT) AS duplicate_rows FROM (SELECT lang, source, size, count(*) AS n FROM documents_cut GROUP BY lang, source, size) g")
def _(spark, d):
    return tables.duplicate_rows(documents_cut(spark, d))


@register("agg_column_inventory", f"WITH {LABELLED} " + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) AS rows, count(*) - count({c}) AS missing_count, round((count(*) - count({c})) / CAST(count(*) AS DOUBLE), 6) AS missing_fraction, count(DISTINCT {c}) AS unique_non_null_values FROM documents_labelled"
    for c in ("doc_id", "lang", "source", "quality", "toxic", "score")
))
def _(spark, d):
    return tables.column_inventory(documents_labelled(spark, d)).drop("dtype").withColumn("missing_fraction", r6("missing_fraction"))


@register("agg_category_rollup", "SELECT source AS category, count(*) AS tables, CAST(sum(n_chars) AS BIGINT) AS total_rows FROM documents GROUP BY source")
def _(spark, d):
    return tables.category_rollup(table(spark, d, "documents").select(F.col("source").alias("category"), F.col("n_chars").alias("rows")))
