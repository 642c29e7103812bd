"""Delimited text with preambles, odd headers, footers, sentinels and text keys.

Rows of a distributed file have no position, so nothing here counts lines: comments go by
their mark, and headers and footers by a key that does not look like a key.
"""

from __future__ import annotations

import csv
import re
import sys
from collections.abc import Iterable, Iterator, Mapping, Sequence
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isotrend.functions.values import named, nan_to_null, sentinel_to_null

YEAR = r"^\s*[0-9]{4}\s*$"
YEAR_MONTH = r"^\s*[0-9]{6}\s*$"
# Delimited files up to this many bytes are read whole by one task, which finds their header; larger ones by lines.
WHOLE_FILE = 16 << 20


def repair_names(names: Sequence[str]) -> list[str]:
    """Syntactic and unique column names: ``Total``, ``Total.1``; ``1990 = 1`` is ``X1990...1``."""
    cleaned = []
    for name in names:
        safe = re.sub(r"[^0-9A-Za-z._]", ".", name.strip()) or "X"
        if not re.match(r"[A-Za-z]|\.(?![0-9])", safe):
            safe = f"X{safe}"
        cleaned.append(safe)
    seen: dict[str, int] = {}
    out = []
    for name in cleaned:
        unique = name
        while unique in out or (unique != name and unique in cleaned):
            seen[name] = seen.get(name, 0) + 1
            unique = f"{name}.{seen[name]}"
        out.append(unique)
    return out


def header_names(spark: SparkSession, path: str, first: str, sep: str = ",") -> list[str]:
    """Repaired names from the header line, the one that starts with the column ``first``."""
    start = f'^"?{re.escape(first)}"?{re.escape(sep)}'
    line = spark.read.text(path).filter(F.col("value").rlike(start)).first()
    if line is None:
        raise ValueError(f"no header line starting with {first!r} in {path}")
    return repair_names(split_header(line["value"], sep))


def split_header(line: str, sep: str = ",") -> list[str]:
    """The cells of a header line; a separator inside quotes belongs to its cell."""
    return [cell.strip() for cell in next(csv.reader([line], delimiter=sep))]


def _typed(text: Column, to: T.DataType) -> Column:
    text = F.trim(text)
    value = text if isinstance(to, T.StringType) else text.try_cast(to)
    return nan_to_null(value) if isinstance(to, (T.DoubleType, T.FloatType)) else value


def read_table(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | str, key: str | None = None,
               key_pattern: str | None = None, comment: str | None = None,
               sentinels: Mapping[str, Sequence[float]] | None = None, sep: str = ",",
               missing: str = "NA") -> DataFrame:
    """Read delimited text under an explicit schema.

    Every field is read as text and cast leniently: text that is no number becomes NULL
    rather than failing the job. ``key`` and ``key_pattern`` keep only the lines whose key
    looks like one, which drops the header, preamble and footer wherever they stand.
    ``sentinels`` lists the missing-value codes of a column. NaN becomes NULL.
    """
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    as_text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
    reader = spark.read.schema(as_text).option("sep", sep).option("nullValue", missing) \
                  .option("enforceSchema", "true").option("mode", "PERMISSIVE")
    if comment:
        reader = reader.option("comment", comment)
    rows = reader.csv(path if isinstance(path, str) else list(path))
    if key is not None:
        rows = rows.filter(named(key).rlike(key_pattern or YEAR))
    typed = rows.select(*[_typed(named(f.name), f.dataType).alias(f.name) for f in schema])
    codes = {c: sentinel_to_null(named(c), *values) for c, values in (sentinels or {}).items()}
    return typed.withColumns(codes) if codes else typed


def file_key(extension: str) -> Column:
    """Name of the table a row came from: the first file or folder of its path with the extension, without it.

    So the parts of a table that is a folder share the folder's name.
    """
    return F.regexp_extract(F.col("_metadata.file_path"), rf"^.*?/([^/]+)\.{re.escape(extension)}(?:[./].*)?$", 1)


def _header_line(required: str, sep: str) -> Column:
    """Whether a line has a cell equal to ``required``."""
    edge, end = rf'(^|{re.escape(sep)})\s*"?', rf'"?\s*($|{re.escape(sep)})'
    return F.col("value").rlike(f"{edge}{re.escape(required)}{end}")


def _first_line() -> Column:
    """Of some lines of a file, that which comes first in it."""
    return F.min_by("value", F.struct("start", "line"))


def file_layouts(spark: SparkSession, path: str | Sequence[str], required: str, sep: str = ",") -> dict[tuple[str, ...], list[str]]:
    """The distinct headers among many files, each with its files, for a look at what there is.

    A header is the first line that has a cell equal to ``required``. Only the header lines and file names
    reach the driver, which lists the files anyway.
    """
    lines = spark.read.text(path if isinstance(path, str) else list(path)).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("line")).filter(_header_line(required, sep))
    layouts: dict[tuple[str, ...], list[str]] = {}
    for row in lines.groupBy("file").agg(_first_line().alias("value")).orderBy("file").collect():
        layouts.setdefault(tuple(split_header(row["value"], sep)), []).append(unquote(row["file"]))
    return layouts


def _placed(lines: Iterable[str], header: list[str] | None, names: Sequence[str], sep: str, missing: str,
            out: list[list[str | None]]) -> None:
    """Append the cells of lines to the lists of the wanted names, by the header given or found among the lines.

    Lines before the header, repeated headers and lines without a value of the first name are left out.
    """
    at = None
    if header is not None:
        at = [header.index(name) if name in header else -1 for name in names]
    for cells in csv.reader(lines, delimiter=sep):
        if at is None or (0 <= at[0] < len(cells) and cells[at[0]].strip() == names[0]):
            found = [cell.strip() for cell in cells]
            if names[0] in found:
                at = [found.index(name) if name in found else -1 for name in names] if at is None else at
            continue
        row = [cells[i] if 0 <= i < len(cells) and cells[i] not in ("", missing) else None for i in at]
        if row[0] is not None:
            for column, cell in zip(out, row):
                column.append(cell)


def _read_delimited(spark: SparkSession, path: str | Sequence[str], names: Sequence[str], key: str, sep: str,
                    missing: str, whole_bytes: int) -> DataFrame:
    """Cells of many delimited files as text, by column name, whatever the layout of each; one scan of each file.

    A file of up to ``whole_bytes`` is one row of the scan, and the task that has it finds its header and places
    its cells. Larger files are cut anywhere, so their lines meet the header of their file in a join. Which
    files go which way is settled by their sizes when they are listed.
    """
    paths, small = path if isinstance(path, str) else list(path), F.col("_metadata.file_size") <= whole_bytes
    fields = ", ".join(f"__{i} string" for i in range(len(names))) + ", __key string"
    columns = [f"__{i}" for i in range(len(names))] + ["__key"]

    def batch_of(out: list[list[str | None]], keys: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (*out, keys)], columns)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(sys.maxsize)
        for batch in batches:
            for text, name in zip(batch.column(0), batch.column(1)):
                out: list[list[str | None]] = [[] for _ in names]
                _placed((text.as_py() or "").splitlines(), None, names, sep, missing, out)
                if out[0]:
                    yield batch_of(out, [name.as_py()] * len(out[0]))

    def by_line(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(sys.maxsize)
        for batch in batches:
            groups: dict[tuple[str, str], list[str]] = {}
            for value, name, header in zip(*(batch.column(i).to_pylist() for i in range(3))):
                groups.setdefault((name, header), []).append(value)
            for (name, header), lines in groups.items():
                out: list[list[str | None]] = [[] for _ in names]
                _placed(lines, split_header(header, sep), names, sep, missing, out)
                if out[0]:
                    yield batch_of(out, [name] * len(out[0]))

    texts = spark.read.text(paths, wholetext=True).filter(small).select("value", file_key("csv").alias("name"))
    lines = spark.read.text(paths).filter(~small).select(
        "value", file_key("csv").alias("name"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("line"))
    place = F.struct("start", "line")
    headers = lines.filter(_header_line(names[0], sep)).groupBy("file").agg(_first_line().alias("header"), F.min(place).alias("at"))
    large = lines.join(headers, "file").filter(place > F.col("at")).select("value", "name", "header")
    read = texts.mapInArrow(whole, fields).unionByName(large.mapInArrow(by_line, fields))
    return read.select(*[F.col(f"__{i}").alias(n) for i, n in enumerate(names)], F.col("__key").alias(key))


def read_keyed_files(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | str,
                     key: str = "state", fmt: str = "csv", whole_bytes: int = WHOLE_FILE, **options: str) -> DataFrame:
    """All files of a folder as one table, the name of file or table as a key column.

    Columns go by name: files may hold them in any order and beside others, and a column that a
    file lacks is missing for its rows. In delimited text the header of a file is its first line with a cell that
    equals the schema's first name; lines without a value there are dropped, and so is a file without a
    header. Headers are found by the tasks that read the files: any number of layouts is one plan and no job of its own.
    """
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if fmt != "csv":
        rows = spark.read.format(fmt).schema(schema).options(**options).load(path if isinstance(path, str) else list(path))
        return rows.withColumn(key, file_key(fmt))
    rows = _read_delimited(spark, path, [f.name for f in schema], key, options.get("sep", ","), options.get("nullValue", "NA"), whole_bytes)
    return rows.select(*[_typed(named(f.name), f.dataType).alias(f.name) for f in schema], named(key))


def drop_row_number(df: DataFrame) -> DataFrame:
    """Drop the unnamed index column that some writers put first."""
    return df.drop(df.columns[0])
