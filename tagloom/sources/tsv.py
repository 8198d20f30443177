"""Tab-separated text in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.functions import text
from tagloom.sources import records

# Texts that a default pandas read takes for missing.
DEFAULT_NULLS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def read_tsv(
    spark: SparkSession,
    path: str,
    schema: str | T.StructType,
    header: bool = True,
    keep_default_na: bool = True,
    multi_line: bool = False,
    mode: str = "FAILFAST",
) -> DataFrame:
    """Read a TSV table with a declared schema; names come from the schema, a header is skipped.

    With ``keep_default_na`` the usual marks for a missing value become null; without it every text
    stays as it is, the empty one included. A malformed field raises unless ``mode`` says otherwise.
    ``multi_line`` reads quoted fields with line breaks, by as many tasks as the files have splits. Without it a
    line that ends inside a quoted field raises, in a table of one column, too. A line with too few or too many fields raises even where a query needs
    few of the columns: all fields are parsed.
    """
    wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    as_text = T.StructType([T.StructField(field.name, T.StringType()) for field in wanted])
    if multi_line or len(wanted) == 1:
        raw = _records(spark, path, as_text, header, multi_line, mode)
    else:
        raw = (
            spark.read.schema(as_text)
            .option("sep", "\t")
            .option("header", header)
            .option("enforceSchema", True)
            .option("escape", '"')
            .option("mode", mode)
            .option("columnPruning", False)
            .option("ignoreLeadingWhiteSpace", False)
            .option("ignoreTrailingWhiteSpace", False)
            .csv(path)
        )
    strict = mode.upper() == "FAILFAST"
    columns = []
    for field in wanted:
        value = F.coalesce(F.col(field.name), F.lit(""))
        if keep_default_na:
            value = F.when(~value.isin(*DEFAULT_NULLS), value)
        if not isinstance(field.dataType, T.StringType):
            value = value.cast(field.dataType) if strict else value.try_cast(field.dataType)
        columns.append(value.alias(field.name))
    return raw.select(*columns)


def _records(spark: SparkSession, path: str, as_text: T.StructType, header: bool, multi_line: bool, mode: str) -> DataFrame:
    """Records of quoted lines, parsed; in a strict mode an open quote raises, and so does a line break where none may be."""
    found = records.scan_records(spark, path, "\t", header)
    if mode.upper() == "FAILFAST":
        wrong = ~F.col("closed") if multi_line else ~F.col("closed") | F.col("record").contains("\n")
        said = F.concat(F.lit("a quoted field is open at the end of line "), F.col("line").cast("string"), F.lit(" of "), F.col("file"))
        found = found.withColumn("record", F.when(wrong, F.raise_error(said)).otherwise(F.col("record")))
    options = {"sep": "\t", "escape": '"', "mode": mode, "maxCharsPerColumn": "-1"}
    options |= {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    names = ", ".join(f"`{f.name}` string" for f in as_text)
    return found.select(F.from_csv("record", names, options).alias("row")).select("row.*")


def write_tsv(
    df: DataFrame,
    path: str,
    na_rep: str = "",
    header: bool = True,
    rows_per_file: int = 1_000_000,
    mode: str = "overwrite",
    sort_by: str | None = None,
) -> None:
    """Write a TSV table; nulls become ``na_rep``. Files are kept small, so readers stay parallel.

    Blanks at the ends and line breaks in texts stay; the latter want ``multi_line`` when read.

    With ``sort_by`` the rows are in key order across the files, too.
    """
    ordered = df.orderBy(sort_by) if sort_by else df
    (
        ordered.write.mode(mode)
        .option("sep", "\t")
        .option("header", header)
        .option("nullValue", na_rep)
        .option("emptyValue", "")
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .option("maxRecordsPerFile", rows_per_file)
        .csv(path)
    )


def strip_quoted_lines(spark: SparkSession, source: str, target: str) -> None:
    """Copy a text file without the double quotes around its lines."""
    lines = spark.read.text(source).select(text.strip_quotes(F.col("value")).alias("value"))
    lines.write.mode("overwrite").text(target)


def parse_tsv_lines(lines: DataFrame, schema: str, value: str = "value") -> DataFrame:
    """Parse TSV lines that are already rows, e.g. right after their quotes were stripped; a malformed line raises."""
    options = {"sep": "\t", "quote": "", "mode": "FAILFAST"}
    return lines.select(F.from_csv(value, schema, options).alias("row")).select("row.*")


def read_predictions(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Labels and predictions of a predictions table, as integers."""
    rows = read_tsv(spark, path, schema)
    return rows.select(F.col("label").cast("int"), F.col("prediction").cast("int"))


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drop side columns where present; absent ones are no error."""
    return df.drop(*names)
