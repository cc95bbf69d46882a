"""Delimited files: scan, delimiter, header conformance, sink."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping, Sequence
from urllib.parse import quote, unquote

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.columns import column, quoted
from ..functions.text import strip
from .records import csv_records

# Delimiters considered, in order of preference.
DELIMITERS = (",", ";", "\t", "|")
DEFAULT_DELIMITER = ","
HEAD_BYTES = 4096
# Texts a CSV reader takes for "no value" (the default list of pandas.read_csv).
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
# Types tried for a column, from the narrowest.
TYPE_LADDER = ("bigint", "double", "boolean")


def _fits(value: Column, type_name: str) -> Column:
    if type_name == "boolean":
        return F.lower(value).isin("true", "false")
    if type_name == "bigint":
        return value.rlike(r"\A\s*[+-]?\d+\s*\z") & F.trim(value).try_cast("bigint").isNotNull()
    # the cast alone would also take a trailing letter such as 1d or 1f
    return F.trim(value).try_cast(type_name).isNotNull() & ~value.rlike(r"[dDfF]\s*\z")


def infer_types(texts: DataFrame, ladder: Sequence[str] = TYPE_LADDER) -> dict[str, str]:
    """Narrowest type every value of a text column fits, from one aggregate over the table."""
    aggs = []
    for i, c in enumerate(texts.columns):
        aggs.append(F.count(column(c)).alias(f"n{i}"))
        aggs += [F.count_if(_fits(column(c), t)).alias(f"{t}{i}") for t in ladder]
    row = texts.agg(*aggs).first()
    out = {}
    for i, c in enumerate(texts.columns):
        present = row[f"n{i}"]
        out[c] = next((t for t in ladder if present and row[f"{t}{i}"] == present), "string")
    return out


def scan_csv(
    spark: SparkSession,
    path: str,
    delimiter: str = DEFAULT_DELIMITER,
    schema: str | T.StructType | None = None,
    null_tokens: Sequence[str] = NULL_TOKENS,
    multiline: bool = True,
) -> DataFrame:
    """Read a delimited file with a header.

    Records may hold line ends inside quotes, and files are split among tasks all the same (see ``records``).  With
    ``multiline`` False every line is a record, which saves a pass.  With a ``schema`` (names and types in
    file order) values are read lazily.  Without one, types are inferred from all values after
    the null tokens are mapped, in one more pass.
    """
    options = {"sep": delimiter, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "nullValue": "", "emptyValue": ""}
    options |= dict.fromkeys(("ignoreLeadingWhiteSpace", "ignoreTrailingWhiteSpace"), "false")
    reader = spark.read.options(header=True, **options)
    types = None
    if schema is not None:
        wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        types = {f.name: f.dataType.simpleString() for f in wanted}
    names = list(types) if types else reader.option("inferSchema", False).csv(path).columns
    if not names:
        return spark.createDataFrame([], T.StructType([]))
    if multiline:
        options["multiLine"] = "true"  # line ends inside quotes stay as they are
        fields = ", ".join(f"c{i} string" for i in range(len(names)))
        records = csv_records(spark, path, delimiter).select(F.from_csv("record", F.lit(fields), options).alias("r"))
        texts = records.select(*[F.col(f"r.c{i}").alias(c) for i, c in enumerate(names)])
    else:
        texts = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in names])).csv(path)
    cleaned = texts.select(*[F.when(~column(c).isin(*null_tokens), column(c)).alias(c) for c in names])
    types = types or infer_types(cleaned)
    return cleaned.select(*[_typed(c, types[c]).alias(c) for c in names])


def _typed(name: str, type_name: str) -> Column:
    return column(name) if type_name == "string" else F.trim(column(name)).try_cast(type_name)


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, modified) of every file, empty ones included; the contents are not read.

    Files with contents are listed in the tasks.  Spark's own readers pass over empty files, so those are taken from the
    file index, which the driver holds, and looked up one by one.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    files = reader.load(path).select("path", "length", F.col("modificationTime").alias("modified"))
    # the index gives escaped names, and local ones with two more slashes
    names = [re.sub(r"^file:///", "file:/", unquote(p)) for p in reader.load(path).inputFiles()]
    known = spark.createDataFrame([(n,) for n in names], "path string")
    empty = [r["path"] for r in known.join(files, "path", "left_anti").collect()]
    if not empty:
        return files
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    rows = []
    for name in empty:
        target = hadoop(name)
        status = target.getFileSystem(conf).getFileStatus(target)
        rows.append((name, status.getLen(), status.getModificationTime()))
    found = spark.createDataFrame(rows, "path string, length bigint, at bigint")
    return files.unionByName(found.select("path", "length", F.timestamp_millis("at").alias("modified")))


def _read_head(path: str, size: int) -> str:
    """The first ``size`` bytes of a file, and on to the end of the first line when that is later."""
    # Spark lists plain paths; Arrow wants escaped ones, and knows one name for the S3 scheme
    fs, name = pafs.FileSystem.from_uri(quote(re.sub(r"^s3[an]:", "s3:", path), safe=":/"))
    with fs.open_input_stream(name) as stream:
        data = stream.read(size)
        while data and b"\n" not in data:
            more = stream.read(size)
            if not more:
                break
            data += more
    return data.decode("utf-8", errors="ignore")


def file_heads(spark: SparkSession, path: str, size: int = HEAD_BYTES) -> DataFrame:
    """(file, head): the first bytes of every file, read in the tasks; the rest is never touched."""

    def heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [_read_head(p, size) if n else "" for p, n in zip(batch["path"], batch["length"])]
            yield pd.DataFrame({"file": batch["path"], "head": found})

    return list_files(spark, path).select("path", "length").mapInPandas(heads, "file string, head string")


def _outside_quotes(line: Column) -> Column:
    return F.regexp_replace(line, '"[^"]*"', "")


def _counter(sign: str) -> Callable[[Column], Column]:
    return lambda x: F.length(x) - F.length(F.replace(x, F.lit(sign), F.lit("")))


def infer_delimiter(
    spark: SparkSession, path: str, candidates: Sequence[str] = DELIMITERS, fallback: str = DEFAULT_DELIMITER
) -> DataFrame:
    """(file, delimiter): the candidate with the same non-zero count on every leading line.

    Ties go to the order of the candidates; a blank or undecided file gets the fallback.
    """
    heads = file_heads(spark, path)
    cut = F.split("head", r"\r\n|\n|\r")
    # the last line of a full head may be cut off
    whole = F.when((F.octet_length("head") >= HEAD_BYTES) & (F.size(cut) > 1), F.slice(cut, 1, F.size(cut) - 1))
    lines = F.filter(F.coalesce(whole, cut), lambda x: strip(x) != "")
    counted = heads.select("file", F.transform(lines, _outside_quotes).alias("lines"))
    choice = F.lit(None).cast("string")
    for c in reversed(list(candidates)):
        counts = F.transform("lines", _counter(c))
        low, high = F.array_min(counts), F.array_max(counts)
        choice = F.when((low == high) & (low > 0), c).otherwise(choice)
    return counted.select("file", F.coalesce(choice, F.lit(fallback)).alias("delimiter"))


def conform_schema(
    spark: SparkSession, path: str, expected: Sequence[str], delimiter: str = DEFAULT_DELIMITER
) -> DataFrame:
    """(file, column, status): expected columns a file lacks (missing) and others it has (extra)."""
    first_line = F.element_at(F.split("head", r"\r\n|\n|\r"), 1)
    unquoted = F.transform(
        F.split(first_line, F.lit("\\Q" + delimiter + "\\E")), lambda x: F.regexp_replace(x, '^"|"$', "")
    )
    # an empty file has no columns at all
    unquoted = F.when(F.col("head") == "", F.array().cast("array<string>")).otherwise(unquoted)
    wanted = F.array(*[F.lit(c) for c in expected])
    headers = file_heads(spark, path).select("file", unquoted.alias("header"))
    entry = lambda status: (lambda x: F.struct(x.alias("column"), F.lit(status).alias("status")))
    found = F.concat(
        F.transform(F.array_except(wanted, "header"), entry("missing")),
        F.transform(F.array_except("header", wanted), entry("extra")),
    )
    return headers.select("file", F.inline(found))


def sink_clean_table(
    df: DataFrame, path: str, format: str = "parquet", partition_by: Sequence[str] = (), options: Mapping[str, str] | None = None
) -> str:
    """Write the repaired table and return its path.

    The source must not lie under ``path``: Spark would delete it before reading.
    """
    defaults = {"header": "true", "escape": '"'} if format == "csv" else {}
    writer = df.write.mode("overwrite").format(format).options(**{**defaults, **(options or {})})
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
    return path


def sink_report(lines: DataFrame, path: str) -> str:
    """Write an ordered report as text; the files follow the order of the rows."""
    lines.select(quoted("line")).write.mode("overwrite").text(path)
    return path
