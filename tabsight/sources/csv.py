"""CSV source: scan with null tokens, encoding census and fallback, structural preflight."""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabsight.sources import quoted
from tabsight.sources.scratch import materialize

# The null spellings of the scan, and those a pandas reader adds by default.
NULL_TOKENS = ("", "NA", "N/A", "NULL", "null", "None", "none", "-", "?")
PANDAS_NULL_TOKENS = (
    "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "NaN", "n/a", "nan",
)
FALLBACK_ENCODING = "ISO-8859-1"  # decodes any byte, so no later fallback can be reached
KNOWN_SUFFIXES = ("csv", "txt")
LARGE_FILE_BYTES = 100 * 1024 * 1024
# Messages of the preflight.
ABSENT_FILE = "File does not exist: "
EMPTY_FILE = "File is empty"
NO_COLUMNS = "No columns detected in CSV file"
WIDE_ROW = "CSV parsing error: a row has more fields than the header"
ODD_SUFFIX = "File extension is not .csv or .txt"
LARGE_FILE = "Large file: processing may be slow"
ONE_COLUMN = "Only one column detected - check delimiter settings"


def nulls_from_tokens(df: DataFrame, tokens: Sequence[str] = NULL_TOKENS + PANDAS_NULL_TOKENS) -> DataFrame:
    """Replace null spellings in text columns."""
    text = {f.name for f in df.schema.fields if f.dataType.simpleString() == "string"}
    return df.select(
        *[F.when(~F.col(f"`{c}`").isin(*tokens), F.col(f"`{c}`")).alias(c) if c in text else F.col(f"`{c}`") for c in df.columns]
    )


def scan_csv(
    spark: SparkSession, path: str | Sequence[str], delimiter: str = ",", encoding: str = "UTF-8", multi_line: bool = False,
) -> DataFrame:
    """Header CSV as text columns with null tokens applied; types follow from inference and coercion.

    A quote inside a quoted field is doubled.  ``multi_line`` reads fields that hold line
    breaks, at the price of one task per file; ``read_csv`` reads them in many tasks.
    """
    paths = [path] if isinstance(path, str) else list(path)
    raw = spark.read.csv(
        paths, header=True, sep=delimiter, encoding=encoding, inferSchema=False, escape='"', multiLine=multi_line)
    return nulls_from_tokens(raw)


def _open_quote(line):
    """Whether a line leaves a quoted field open (or closes one): an odd number of quotes."""
    return (F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))) % 2 == 1


def encoding_census(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(file, lines, invalid_lines, multi_line, encoding): UTF-8 unless some line is not valid UTF-8.

    ``multi_line`` tells whether some quoted field holds a line break.

    The text source hands lines on as raw bytes, so the check runs on splits of a file and
    never needs a whole file in one row.
    """
    paths = [path] if isinstance(path, str) else list(path)
    lines = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("file"), F.is_valid_utf8("value").alias("valid"), _open_quote(F.col("value")).alias("open")
    )
    per_file = lines.groupBy("file").agg(
        F.count("*").alias("lines"), F.count_if(~F.col("valid")).alias("invalid_lines"), F.bool_or("open").alias("multi_line"))
    return per_file.withColumn("encoding", F.when(F.col("invalid_lines") == 0, "UTF-8").otherwise(FALLBACK_ENCODING))


def read_csv(spark: SparkSession, path: str | Sequence[str], delimiter: str = ",") -> DataFrame:
    """Scan with the encoding and line mode each file needs; the groups are united by column name."""
    census = encoding_census(spark, path).select("file", "encoding", "multi_line").collect()  # one row per file
    by_kind: dict[tuple[str, bool], list[str]] = {}
    for r in census:
        by_kind.setdefault((r["encoding"], bool(r["multi_line"])), []).append(unquote(r["file"]))
    frames: list[DataFrame] = []
    for (encoding, breaks), files in sorted(by_kind.items()):
        frames += _scan_breaks(spark, files, delimiter, encoding) if breaks else [scan_csv(spark, files, delimiter, encoding)]
    out = frames[0]
    for other in frames[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out


def _lone_returns(spark: SparkSession, files: Sequence[str]) -> set[str]:
    """The files in which some carriage return has no line feed after it."""
    lines = spark.read.option("lineSep", "\n").text(list(files)).filter(F.col("value").rlike(r"(?s)\r(?!\z)"))
    return {unquote(r["file"]) for r in lines.select(F.col("_metadata.file_path").alias("file")).distinct().collect()}


def _scan_breaks(spark: SparkSession, files: Sequence[str], delimiter: str, encoding: str) -> list[DataFrame]:
    """Files with quoted line breaks: split among tasks, but for those whose line ends only the reader of whole files knows."""
    if not quoted.splittable(delimiter, encoding):
        return [scan_csv(spark, files, delimiter, encoding, True)]
    odd = _lone_returns(spark, files)
    even = [f for f in files if f not in odd]
    frames = [nulls_from_tokens(quoted.scan_quoted(spark, even, delimiter, encoding))] if even else []
    return frames + ([scan_csv(spark, sorted(odd), delimiter, encoding, True)] if odd else [])


def _separators(line, delimiter: str):
    """Delimiters outside quotes."""
    bare = F.when(F.contains(line, F.lit('"')), F.regexp_replace(line, r'"[^"]*"', "")).otherwise(line)
    return F.length(bare) - F.length(F.replace(bare, F.lit(delimiter), F.lit("")))


def list_files(spark: SparkSession, path: str) -> list[tuple[str, int]] | None:
    """(uri, bytes) of the data files at a path, empty ones included; None if it does not exist.

    (Readers skip files without content, so the listing comes from the file system.)
    """
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(target):
        return None
    files, listing = [], fs.listFiles(target, True)
    while listing.hasNext():
        status = listing.next()
        if status.getPath().getName()[:1] not in "._":
            files.append((status.getPath().toUri().toString(), status.getLen()))
    return files


def _file_key(column):
    """File URIs spell the start differently (file:/ and file:///)."""
    return F.regexp_replace(column, r"^[A-Za-z0-9+.-]+:/+", "/")


def preflight(spark: SparkSession, path: str | Sequence[str], delimiter: str = ",") -> DataFrame:
    """Structural check, one row per file: size, columns, data rows, errors and warnings.

    In a file whose quoted fields hold line breaks, records stand for lines.
    """
    paths = [path] if isinstance(path, str) else list(path)
    schema = "file string, bytes bigint, columns bigint, data_rows bigint, errors array<string>, warnings array<string>"
    listed = {p: list_files(spark, p) for p in paths}
    missing = spark.createDataFrame(
        [(p, None, None, None, [ABSENT_FILE + p], []) for p, found in listed.items() if found is None], schema
    )
    existing = [p for p, found in listed.items() if found]
    if not existing:
        return missing
    files = spark.createDataFrame([f for p in existing for f in listed[p]], "file string, bytes bigint")
    files = files.withColumn("key", _file_key("file"))

    lines = spark.read.text(existing).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("position"),
        F.col("value"),
        _separators(F.col("value"), delimiter).alias("separators"),
    )
    lines = lines.filter(F.trim("value") != "").withColumn("open", _open_quote(F.col("value")))
    # by split first, as a least pair cannot be kept in a hash table; a row per file is written, as it is asked twice
    splits = lines.groupBy("path", "block").agg(
        F.count("*").alias("lines"),
        F.bool_or("open").alias("open"),
        F.min("position").alias("position"),
        F.min_by("separators", "position").alias("separators"),
        F.max("separators").alias("widest"),
    )
    shape = materialize(splits.groupBy(_file_key("path").alias("key")).agg(
        F.sum("lines").alias("lines"),
        F.bool_or("open").alias("multi_line"),
        F.min_by("separators", F.struct("block", "position")).alias("header_separators"),
        F.max("widest").alias("widest"),
    ), "shape")
    broken = [r["file"] for r in files.join(shape.filter("multi_line"), "key", "left_semi").select("file").collect()]
    if broken and quoted.splittable(delimiter, "UTF-8"):  # lines are no records there
        records = quoted.split_records(spark, [unquote(f) for f in broken], delimiter)
        text = quoted.record_text("ISO-8859-1")  # any bytes; delimiters and quotes are ASCII
        records = records.select(_file_key("file").alias("key"), "first", text.alias("text")).filter(F.trim("text") != "")
        records = records.withColumn("separators", _separators(F.col("text"), delimiter)).groupBy("key").agg(
            F.count("*").alias("records"), F.max(F.when(F.col("first"), F.col("separators"))).alias("of_header"), F.max("separators").alias("most"))
        shape = shape.join(records, "key", "left").withColumn("lines", F.coalesce("records", "lines"))
        shape = shape.withColumn("header_separators", F.coalesce("of_header", "header_separators")).withColumn("widest", F.coalesce("most", "widest"))
    joined = files.join(shape, "key", "left")
    columns = F.col("header_separators") + 1
    suffix = F.lower(F.regexp_extract("file", r"\.([^./]*)$", 1))
    errors = F.array_compact(
        F.array(
            F.when(F.col("bytes") == 0, EMPTY_FILE),
            F.when((F.col("bytes") > 0) & F.col("lines").isNull(), NO_COLUMNS),
            F.when(F.col("widest") > F.col("header_separators"), WIDE_ROW),
        )
    )
    warnings = F.array_compact(
        F.array(
            F.when(~suffix.isin(*KNOWN_SUFFIXES), ODD_SUFFIX),
            F.when(F.col("bytes") > LARGE_FILE_BYTES, LARGE_FILE),
            F.when(columns == 1, ONE_COLUMN),
        )
    )
    checked = joined.select(
        "file",
        "bytes",
        columns.cast("bigint").alias("columns"),
        F.greatest(F.col("lines") - 1, F.lit(0)).cast("bigint").alias("data_rows"),
        errors.alias("errors"),
        warnings.alias("warnings"),
    )
    return checked.unionByName(missing)
