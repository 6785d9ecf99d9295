"""Information-schema relations of the session's catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.operators.sequences import SEQUENCES
from quillon.types import NAMES


def tables(spark: SparkSession) -> DataFrame:
    rows = [(t.catalog, ".".join(t.namespace or []), t.name, t.tableType) for t in spark.catalog.listTables()]
    return spark.createDataFrame(rows, "table_catalog string, table_schema string, table_name string, table_type string")


def views(spark: SparkSession) -> DataFrame:
    return tables(spark).where("table_type in ('VIEW', 'TEMPORARY')")


def columns(spark: SparkSession) -> DataFrame:
    rows = []
    for t in spark.catalog.listTables():
        rows += [(t.name, c.name, i + 1, c.dataType, c.nullable) for i, c in enumerate(spark.catalog.listColumns(t.name))]
    return spark.createDataFrame(rows, "table_name string, column_name string, ordinal_position int, data_type string, is_nullable boolean")


def schemata(spark: SparkSession) -> DataFrame:
    rows = [(d.catalog, d.name, d.description) for d in spark.catalog.listDatabases()]
    return spark.createDataFrame(rows, "catalog_name string, schema_name string, remarks string")


def catalogs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c.name,) for c in spark.catalog.listCatalogs()], "catalog_name string")


def function_aliases(spark: SparkSession) -> DataFrame:
    return spark.sql("SHOW ALL FUNCTIONS").withColumnRenamed("function", "alias_name")


def settings(spark: SparkSession) -> DataFrame:
    return spark.sql("SET").withColumnsRenamed({"key": "name"})


def type_info(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, t.simpleString()) for n, t in NAMES.items()], "type_name string, spark_type string")


def table_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("MANAGED",), ("EXTERNAL",), ("VIEW",), ("TEMPORARY",)], "type string")


def sequences(spark: SparkSession) -> DataFrame:
    rows = [(n, SEQUENCES.current(n), s.step, s.cycle) for n, s in SEQUENCES.held.items()]
    return spark.createDataFrame(rows, "sequence_name string, current_value long, increment long, is_cycle boolean")


def functions(spark: SparkSession) -> DataFrame:
    """This library's own functions."""
    from quillon.functions import FUNCTIONS

    return spark.createDataFrame([(n,) for n in sorted(FUNCTIONS)], "function_name string")


def query_statistics(spark: SparkSession) -> DataFrame:
    """Jobs that the session has run, with their stages and tasks, from the status tracker."""
    rows = []
    tracker = spark.sparkContext.statusTracker()
    for k in tracker.getJobIdsForGroup(None):
        if info := tracker.getJobInfo(k):
            rows.append((k, info.status, len(info.stageIds)))
    return spark.createDataFrame(rows, "job_id long, status string, stages int")


# Relations by their names in the information schema.
RELATIONS = {
    "TABLES": tables, "VIEWS": views, "COLUMNS": columns, "SCHEMAS": schemata, "CATALOGS": catalogs, "DATABASES": schemata, "FUNCTION_ALIASES": function_aliases, "SETTINGS": settings,
    "TYPE_INFO": type_info, "TABLE_TYPES": table_types, "SEQUENCES": sequences, "HELP": functions, "QUERY_STATISTICS": query_statistics,
}
