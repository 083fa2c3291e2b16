"""CSV sources and sinks: a lenient scan, a strict ingest with a structural error report, a writer."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scour.schema import literal, quoted, ref
from scour.sources import inference, records
from scour.sources.quoted_records import quoted_records
from scour.sources.staging import stage

# Cell texts the lenient scan reads as missing.
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
SUCCESS, UNCLEAR, FATAL = "success", "needs_clarification", "fatal_error"
_CORRUPT = "__corrupt_record"
QUOTE = '"'
_NO_SUCH_TEXT = "\x00"

ERROR_SCHEMA = T.StructType(
    [
        T.StructField("row_index", T.LongType()),
        T.StructField("expected_fields", T.IntegerType()),
        T.StructField("found_fields", T.IntegerType()),
        T.StructField("raw_content", T.StringType()),
        T.StructField("issue_type", T.StringType()),
        T.StructField("message", T.StringType()),
    ]
)


@dataclass(frozen=True)
class IngestResult:
    """`data` on success, otherwise None and the `errors` table says why."""

    status: str
    message: str | None
    data: DataFrame | None
    errors: DataFrame


# --- reading ------------------------------------------------------------------------------------


def _lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    return spark.read.text(path)


def _header_line(spark: SparkSession, path) -> str | None:
    """The first line, None for an empty source. One task reads one line."""
    try:
        first = _lines(spark, path).select(
            "value", F.is_valid_utf8("value").alias("valid")
        ).first()
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            raise FileNotFoundError(f"There is no file at {path!r}") from None
        raise
    if first is None:
        return None
    return first["value"] if first["valid"] else ""


def _text_cells(
    spark: SparkSession, path, names: Sequence[str], delimiter: str, multi_line: bool,
    corrupt: bool = False,
) -> DataFrame:
    """Every cell as text, quotes resolved; the header of each file is skipped by the reader."""
    fields = [T.StructField(f"c{i}", T.StringType()) for i in range(len(names))]
    if corrupt:
        fields.append(T.StructField(_CORRUPT, T.StringType()))
    reader = (
        spark.read.schema(T.StructType(fields))
        .option("header", True)
        .option("enforceSchema", True)
        .option("sep", delimiter)
        .option("quote", QUOTE)
        .option("escape", QUOTE)
        .option("multiLine", multi_line)
        .option("mode", "PERMISSIVE")
        .option("nullValue", _NO_SUCH_TEXT)
        .option("emptyValue", "")
    )
    if corrupt:
        # Only a reader that looks at all fields notices how many there are.
        reader = reader.option("columnNameOfCorruptRecord", _CORRUPT).option("columnPruning", False)
    cells = reader.csv(path)
    kept = [F.col(_CORRUPT)] if corrupt else []
    return cells.select(
        *[F.coalesce(F.col(f"c{i}"), F.lit("")).alias(name) for i, name in enumerate(names)], *kept
    )


def load_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: T.StructType | None = None,
    delimiter: str = ",",
    multi_line: bool = False,
) -> DataFrame:
    """The lenient scan: null tokens become NULL, and types are inferred without leading-zero care.

    Files whose headers differ are an error, as are records with more fields than the header. One
    aggregate infers integer, double and boolean columns. A name that the header repeats gets a
    number: `a`, `a.1`. A `schema` has the header's names, in any
    order, and gives the types instead; a value that does not convert is then an error too.
    """
    header = _header_line(spark, path)
    if header is None:
        raise ValueError(f"The file {path!r} is empty")
    names = records.distinct_names(records.parse_header(header, delimiter) or [])
    if not names:
        raise ValueError(f"The file {path!r} has no readable header")
    others = _file_tally(spark, path, header)["other_headers"]
    if others:
        raise ValueError(f"{others} files of {path!r} have another header")
    cells = _text_cells(spark, path, names, delimiter, multi_line, corrupt=True)
    tokens = ", ".join(map(literal, NULL_TOKENS))
    cells = cells.withColumns(
        {
            name: F.expr(f"CASE WHEN {quoted(name)} NOT IN ({tokens}) THEN {quoted(name)} END")
            for name in names
        }
    )
    if schema is not None:
        return _with_schema(cells, names, schema, path, delimiter)
    types = _lenient_types(cells, names, path, delimiter)
    return inference.apply_types(cells.drop(_CORRUPT), types)


def _with_schema(
    cells: DataFrame, names: Sequence[str], schema: T.StructType, path, delimiter: str
) -> DataFrame:
    """The named columns in the types of the schema; one aggregate looks for what would be lost."""
    if sorted(names) != sorted(schema.names):
        raise ValueError(f"The schema has the columns {schema.names}, the header {list(names)}")
    values = {
        field.name: ref(field.name)
        if field.dataType == T.StringType()
        else ref(field.name).try_cast(field.dataType)
        for field in schema.fields
    }
    too_long = F.expr(f"{records.field_count(_CORRUPT, delimiter)} > {len(names)}")
    lost = [F.count_if(ref(n).isNotNull() & v.isNull()).alias(f"n{i}") for i, (n, v) in enumerate(values.items())]
    row = cells.agg(F.count_if(too_long).alias("too_long"), *lost).first()
    if row["too_long"]:
        raise ValueError(f"The file {path!r} has records with more fields than its header")
    bad = [name for i, name in enumerate(values) if row[f"n{i}"]]
    if bad:
        raise ValueError(f"Columns {', '.join(bad)} of {path!r} have values that are not of their type")
    return cells.select(*[value.alias(name) for name, value in values.items()])


def _lenient_types(cells: DataFrame, names: Sequence[str], path, delimiter: str) -> dict[str, str]:
    keys = ("present", "absent", "odd", "not_int", "not_bool")
    too_long = f"{records.field_count(_CORRUPT, delimiter)} > {len(names)}"
    row = inference.flags(
        cells, names, (), keys, f"coalesce(bool_or({too_long}), false) AS too_long"
    )
    if row["too_long"]:
        raise ValueError(f"The file {path!r} has records with more fields than its header")
    types = {}
    for i, name in enumerate(names):
        present, absent, odd, not_int, not_bool = (row[f"{key}{i}"] for key in keys)
        if not present:
            types[name] = inference.DOUBLE
        elif not odd:
            whole = not not_int and not absent
            types[name] = inference.INTEGER if whole else inference.DOUBLE
        elif not not_bool and not absent:
            types[name] = inference.BOOLEAN
        else:
            types[name] = inference.TEXT
    return types


# --- strict ingest --------------------------------------------------------------------------------


def _single_error(spark: SparkSession, issue: str, message: str) -> DataFrame:
    row = F.struct(
        *[
            F.lit({"issue_type": issue, "message": message}.get(field.name))
            .cast(field.dataType)
            .alias(field.name)
            for field in ERROR_SCHEMA.fields
        ]
    )
    return spark.range(1).select(row.alias("error")).select("error.*")


def _no_errors(spark: SparkSession) -> DataFrame:
    return _single_error(spark, "", "").where(F.lit(False))


def ingest_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    delimiter: str = ",",
    multi_line: bool = False,
    infer: bool = True,
) -> IngestResult:
    """Structurally sound files become a table, all others an error report; nothing is repaired.

    One pass over the raw lines checks encoding, quotes and field counts, a second one infers the
    types; reading the result is the third. Lines are records; a quoted line break is reported as
    broken quotes. With `multi_line` quoted line breaks are allowed (see `quoted_records`), at the
    cost of one shuffle of the lines. Files are split freely either way.
    """
    header = _header_line(spark, path)
    lines = _lines(spark, path)
    blank = lines.where(F.length(F.regexp_replace("value", r"(?U)\s+", "")) > 0).isEmpty()
    if header is None or blank:
        return _fatal(spark, records.EMPTY, "The file is empty.")
    if multi_line:
        return _ingest_multi_line(spark, path, delimiter, infer)
    names = records.parse_header(header, delimiter)
    if not header.strip() and lines.where(~F.is_valid_utf8("value")).limit(1).count():
        return _encoding_failure(spark)
    if names is None:
        return _fatal(spark, records.QUOTES, "The quotes of the header are broken.")
    if len(set(names)) != len(names):
        return _fatal(spark, "other", "The header repeats a column name.")
    tally = _file_tally(spark, path, header, records.structure_issue("value", len(names), delimiter))
    if tally["encoding"]:
        return _encoding_failure(spark)
    if tally["other_headers"]:
        return _fatal(spark, "other", f"{tally['other_headers']} files have another header.")
    if tally["issues"]:
        return _unclear(tally["issues"], structural_errors(spark, path, names, delimiter))
    return _success(spark, _text_cells(spark, path, names, delimiter, False), infer)


def _file_tally(spark: SparkSession, path, header: str, issue: str | None = None):
    """One row: broken lines, lines that are not UTF-8, and files that start with another header."""
    return (
        _lines(spark, path)
        .select(
            "value",
            F.expr(issue or "CAST(NULL AS STRING)").alias("issue"),
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("split"),
            F.monotonically_increasing_id().alias("id"),
        )
        .groupBy("file")
        .agg(
            F.count("issue").alias("issues"),
            F.count_if(~F.is_valid_utf8("value")).alias("encoding"),
            # Of the split at the start of the file, the line that is read first, and in the last bit
            # whether it is the header: aggregates of numbers need no sort of the lines.
            F.min(
                F.when(
                    F.col("split") == 0,
                    F.col("id") * 2 + F.col("value").eqNullSafe(F.lit(header)).cast("int"),
                )
            ).alias("first_line"),
        )
        .agg(
            F.sum("issues").alias("issues"),
            F.sum("encoding").alias("encoding"),
            F.count_if(F.coalesce(F.col("first_line") % 2, F.lit(0)) == 0).alias("other_headers"),
        )
        .first()
    )


def _success(spark: SparkSession, cells: DataFrame, infer: bool) -> IngestResult:
    data = inference.safe_infer(cells, None) if infer else cells
    return IngestResult(SUCCESS, None, data, _no_errors(spark))


def _fatal(spark: SparkSession, issue: str, message: str) -> IngestResult:
    return IngestResult(FATAL, message, None, _single_error(spark, issue, message))


def _encoding_failure(spark: SparkSession) -> IngestResult:
    return _fatal(spark, records.ENCODING, "The file is not valid UTF-8; it is not decoded lossily.")


def _unclear(issues: int, errors: DataFrame) -> IngestResult:
    message = f"{issues} records do not fit the header; repairing them would be a guess."
    return IngestResult(UNCLEAR, message, None, errors)


def _ingest_multi_line(spark: SparkSession, path, delimiter: str, infer: bool) -> IngestResult:
    found = stage(quoted_records(spark, path, delimiter), "records")
    headers = found.where("number = 1")
    first = headers.orderBy("file").select("value", "too_long").first()
    header = first["value"]
    row = found.agg(
        F.count_if(~F.is_valid_utf8("value")).alias("encoding"),
        F.count_if((F.col("number") == 1) & (F.col("value") != F.lit(header))).alias("others"),
    ).first()
    if row["encoding"]:
        return _encoding_failure(spark)
    names = None if first["too_long"] else records.parse_header(header, delimiter)
    if names is None:
        return _fatal(spark, records.QUOTES, "The quotes of the header are broken.")
    if len(set(names)) != len(names):
        return _fatal(spark, "other", "The header repeats a column name.")
    if row["others"]:
        return _fatal(spark, "other", f"{row['others']} files have another header.")
    issue = records.structure_issue("value", len(names), delimiter)
    rows = found.where("number > 1").withColumn(
        "issue", F.expr(f"CASE WHEN too_long THEN '{records.QUOTES}' ELSE {issue} END")
    )
    broken = rows.where("issue IS NOT NULL")
    issues = broken.count()
    if issues:
        return _unclear(issues, _described(broken, "number", names, delimiter))
    return _success(spark, _cells(rows, names, delimiter), infer)


def _cells(rows: DataFrame, names: Sequence[str], delimiter: str) -> DataFrame:
    """The fields of well-formed records, as the reader of whole lines gives them."""
    fields = ", ".join(f"c{i} STRING" for i in range(len(names)))
    options = {
        "sep": delimiter, "quote": QUOTE, "escape": QUOTE, "multiLine": "true", "mode": "PERMISSIVE",
        "nullValue": _NO_SUCH_TEXT, "emptyValue": "", "maxCharsPerColumn": "-1",
    }
    parsed = rows.select(F.from_csv("value", fields, options).alias("record"))
    return parsed.select(
        *[F.coalesce(F.col(f"record.c{i}"), F.lit("")).alias(name) for i, name in enumerate(names)]
    )


def _described(rows: DataFrame, number: str, names: Sequence[str], delimiter: str) -> DataFrame:
    """The error table of rows with value and issue."""
    counted = f"issue IN ('{records.EXTRA}', '{records.SHORT}')"
    found = records.field_count("value", delimiter)
    return rows.selectExpr(
        f"{number} AS row_index",
        f"CASE WHEN {counted} THEN {len(names)} END AS expected_fields",
        f"CASE WHEN {counted} THEN {found} END AS found_fields",
        "value AS raw_content",
        "issue AS issue_type",
        f"CASE WHEN {counted} THEN concat('The record has ', {found}, ' fields, the header {len(names)}.') "
        f"WHEN issue = '{records.ENCODING}' THEN 'The record is not valid UTF-8.' "
        "ELSE 'The quotes of the record are broken.' END AS message",
    )


def numbered_lines(spark: SparkSession, path, wanted: str = "true") -> DataFrame:
    """`(file, line_number, value)` of the wanted lines, the first line of each file being 1.

    Lines are counted per file split, and the running counts are added to the position within the
    split. The scan is written once, without the lines nobody wants: where splits begin and end
    depends on the cluster at the time, so it must not be made twice.
    """
    lines = stage(
        _lines(spark, path).select(
            F.expr(f"CASE WHEN {wanted} THEN value END").alias("value"),
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("split"),
            F.monotonically_increasing_id().alias("id"),
        ),
        "lines",
    )
    counts = lines.groupBy("file", "split").agg(
        F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id")
    )
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = counts.select(
        "file", "split", "first_id", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start")
    )
    return lines.where("value IS NOT NULL").join(starts, ["file", "split"]).select(
        "file", (F.col("start") + F.col("id") - F.col("first_id") + 1).alias("line_number"), "value"
    )


def structural_errors(
    spark: SparkSession, path, names: Sequence[str], delimiter: str = ","
) -> DataFrame:
    """One row per record that does not fit the header, with its number (the header is 1)."""
    issue = records.structure_issue("value", len(names), delimiter)
    rows = numbered_lines(spark, path, f"{issue} IS NOT NULL").selectExpr("*", f"{issue} AS issue")
    return _described(rows, "line_number", names, delimiter)


# --- writing --------------------------------------------------------------------------------------


def save_table(
    df: DataFrame, path: str, inputs: Sequence[str] = (), format: str = "csv"
) -> None:
    """Write with a header, never over existing data and never onto a named input.

    A target that holds an input of the table exists, so it is refused like any that does.
    """
    if format not in ("csv", "parquet"):
        raise ValueError(f"Unknown format {format!r}; use csv or parquet")
    target = _qualified(df.sparkSession, path)
    taken = {_qualified(df.sparkSession, source) for source in inputs}
    if any(source == target or source.startswith(target + "/") for source in taken):
        raise ValueError(f"{path!r} is an input of this table; choose a new folder")
    parent = target.rsplit("/", 1)[0]
    if not _exists(df.sparkSession, parent):
        raise ValueError(f"The folder {parent!r} does not exist")
    writer = df.write.mode("errorifexists")
    if format == "csv":
        (
            writer.option("header", True)
            .option("escape", QUOTE)
            .option("ignoreLeadingWhiteSpace", False)
            .option("ignoreTrailingWhiteSpace", False)
            .csv(path)
        )
    else:
        writer.parquet(path)


def _hadoop_path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _qualified(spark: SparkSession, path: str) -> str:
    hadoop = _hadoop_path(spark, path)
    system = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    return system.makeQualified(hadoop).toString().rstrip("/")


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = _hadoop_path(spark, path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
