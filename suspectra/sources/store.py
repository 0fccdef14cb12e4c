"""Readers and writers: workbooks as cell tables, crowd CSV, error databases, typing models, results and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .staging import stage_table

# The columns of the files.
CELLS = "cell_id long, workbook string, worksheet string, path string, row int, col int, raw string"
ERRORS = "row int, col int, path string, workbook string, worksheet string, value string"
ITERATIONS = (
    "filename string, procedure string, significance double, threshold double, address string, original_value string, erroneous_value string,"
    " total_relative_error double, num_input_err_mag double, str_input_err_mag double, was_flagged boolean, was_error boolean"
)
RESULT = (
    "workbook_name string, initial_total_relative_error double, total_relative_error double, remaining_error double, effort int, max_effort int,"
    " expended_effort double, number_of_errors int, true_positives int, false_positives int, false_negatives int, average_precision double,"
    " graph_construct_seconds double, analysis_seconds double, analysis_type string, significance double, all_outputs boolean, weighted boolean,"
    " num_max_err_diff_mag double, str_max_err_diff_mag double, num_max_out_diff_mag double, str_max_out_diff_mag double"
)


def numbered(df: DataFrame, order: list[str], name: str = "row") -> DataFrame:
    """df with the place of each row (from 1) in the order of some columns: by ranges of them, each numbered in a task of its own."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stage_table(df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()), "numbered")
    counts = dealt.groupBy("__part").agg(F.count("*").alias("__n"))
    before = counts.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    placed = dealt.withColumn("__at", F.row_number().over(Window.partitionBy("__part").orderBy(*order)))
    return placed.join(F.broadcast(before), "__part").withColumn(name, (F.col("__before") + F.col("__at")).cast("int")).drop("__part", "__at", "__before")


def cells_from_wide(df: DataFrame, worksheet: str = "Sheet1", workbook: str = "", path: str = "", order: list[str] | None = None) -> DataFrame:
    """A table as cells: row numbers by ``order`` columns, column numbers by position, values as strings (null: empty)."""
    places = [F.struct(F.lit(k + 1).alias("col"), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias("raw")) for k, c in enumerate(df.columns)]
    keys = [f"__k{k}" for k in range(len(order or df.columns))]
    keyed = df.select(F.array(*places).alias("each"), *[F.col(f"`{c}`").alias(k) for c, k in zip(order or df.columns, keys, strict=True)])
    flat = numbered(keyed, keys).select("row", F.explode("each").alias("x")).select("row", "x.*")
    return flat.select((F.col("row").cast("long") * 16384 + F.col("col")).alias("cell_id"), F.lit(workbook).alias("workbook"), F.lit(worksheet).alias("worksheet"), F.lit(path).alias("path"), "row", "col", "raw")


def read_cells(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(CELLS).format(fmt).load(path)


def values(cells: DataFrame) -> DataFrame:
    """cell_id and value, nulls and white space as empty text."""
    raw = F.coalesce(F.col("raw"), F.lit(""))
    return cells.select("cell_id", F.when(F.trim(raw) == "", "").otherwise(raw).alias("value"))


def read_crowd_csv(spark: SparkSession, path: str) -> DataFrame:
    """Wide crowd rows without the header; ``operators.crowd.unpivot`` makes them long."""
    return spark.read.csv(path, header=True, inferSchema=False, escape='"')


def write_errors(errors: DataFrame, path: str) -> None:
    errors.write.mode("overwrite").format("xml").option("rootTag", "errors").option("rowTag", "error").save(path)


def read_errors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", "error").schema(ERRORS).load(path)


def write_model(typo: DataFrame, moves: DataFrame, path: str) -> None:
    typo.write.mode("overwrite").parquet(f"{path}/typo")
    moves.write.mode("overwrite").parquet(f"{path}/transpose")


def read_model(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/typo"), spark.read.parquet(f"{path}/transpose")


def append_csv(df: DataFrame, path: str, schema: str) -> None:
    """Append rows of RESULT or ITERATIONS as CSV with a header in each file."""
    names = T._parse_datatype_string(schema).fieldNames()
    df.select(*names).write.mode("append").csv(path, header=True)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True)


def write_timeseries(df: DataFrame, path: str) -> None:
    """workbook, error, effort points."""
    df.select("workbook", "error", "effort").write.mode("append").csv(path, header=True)


def write_result(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def read_result(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RESULT).parquet(path)


def write_dot(lines: DataFrame, path: str) -> None:
    """The lines of ``operators.graph.dot`` as a text file of a DOT graph."""
    first, last = "digraph dependencies {", "}"
    spark = lines.sparkSession
    framed = lines.select(F.lit(1).alias("k"), "line").unionAll(spark.createDataFrame([(0, first), (2, last)], "k int, line string"))
    framed.orderBy("k", "line").select("line").coalesce(1).write.mode("overwrite").text(path)


def top_scores(scores: DataFrame, n: int = 10) -> DataFrame:
    return scores.orderBy(F.col("score").desc(), "cell_id").limit(n)
