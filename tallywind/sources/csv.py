"""Comma-separated values: RFC 4180 quoting, own vocabulary of absence, inference over all rows."""

from __future__ import annotations

import csv
import io
import warnings
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import casts
from ..functions.dates import iso
from ..operators.rowparse import MISSING
from ..types import dtype_of

_TRUE, _FALSE = ("true", "True", "TRUE"), ("false", "False", "FALSE")  # Fixed values


def infer_columns(df: DataFrame, decimal: str = ".", hexadecimal: bool = False) -> DataFrame:
    """All-string columns as bool, int64, float64 or string, by one aggregate over all rows; all absent stays string."""
    names = df.columns
    safe = df.toDF(*[f"c{i}" for i in range(len(names))])

    def number(c: Column) -> Column:
        # a custom decimal mark replaces the point, which is then no number
        return casts.to_float(c if decimal == "." else F.when(~F.contains(c, F.lit(".")), F.replace(c, F.lit(decimal), F.lit("."))), hexadecimal)

    tests = []
    for c in safe.columns:
        x = F.col(c)
        tests += [
            F.bool_and(x.isin(*_TRUE, *_FALSE)).alias(f"{c}_b"),
            F.bool_and(casts.to_int(x).isNotNull() | x.isNull()).alias(f"{c}_i"),
            F.bool_and(number(x).isNotNull() | x.isNull()).alias(f"{c}_f"),
            F.count(x).alias(f"{c}_n"),
        ]
    found = safe.agg(*tests).first() if names else {}
    out = []
    for c, name in zip(safe.columns, names):
        x = F.col(c)
        if not found[f"{c}_n"]:
            typed = x
        elif found[f"{c}_b"]:
            typed = x.isin(*_TRUE)
        elif found[f"{c}_i"]:
            typed = casts.to_int(x)
        elif found[f"{c}_f"]:
            typed = number(x)
        else:
            typed = x
        out.append(typed.alias(name))
    return safe.select(*out)


def read_csv(spark: SparkSession, path: str, sep: str = ",", header: bool = True, quote: str = '"', decimal: str = ".", na_values: Sequence[str] | None = None, multiline: bool = True, hexadecimal: bool = False) -> DataFrame:
    """A CSV file as a typed DataFrame.

    Quoted fields may hold separators, doubled quotes and line breaks. Blank
    lines are skipped, short rows filled with NULL, further fields dropped. NULL
    stands for the texts in na_values (default: empty, NA, null, N/A, NULL;
    giving a list replaces it). Without a header columns are col0, col1, ...
    An empty file is an error; a header alone gives no rows, all string. Types
    are inferred over all rows. Line ends are alike within a file (any kind);
    text after a closing quote follows Spark's reader. `multiline=False` lets Spark split large files
    that have no line breaks inside fields. `hexadecimal` reads 0x1.8p3 as a number.
    """
    if sep == decimal:
        raise ValueError("separator and decimal mark are equal")
    reader = spark.read.option("sep", sep).option("quote", quote).option("escape", quote).option("nullValue", "\u0001").option("emptyValue", "").option("mode", "PERMISSIVE").option("multiLine", multiline)
    head = reader.option("header", False).option("inferSchema", False).csv(path).limit(1)
    if not head.columns or not head.count():
        raise ValueError("empty input")
    width = len(head.columns)
    names = [str(v if v is not None else "") for v in head.first()] if header else [f"col{i}" for i in range(width)]
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(width)])
    raw = reader.option("header", header).option("enforceSchema", True).schema(schema).csv(path)
    return _finished(raw, names, sep, decimal, na_values, hexadecimal)


def _finished(raw: DataFrame, names: Sequence[str], sep: str, decimal: str, na_values: Sequence[str] | None, hexadecimal: bool) -> DataFrame:
    """All-string rows with their names, absence and types."""
    if na_values is None:
        clean = [F.when(~F.col(c).isin(*MISSING), F.col(c)) for c in raw.columns]
    else:
        clean = [F.when(~F.coalesce(F.col(c), F.lit("")).isin(*na_values), F.coalesce(F.col(c), F.lit(""))) if na_values else F.coalesce(F.col(c), F.lit("")) for c in raw.columns]
    rows = raw.select(*[x.alias(c) for x, c in zip(clean, raw.columns)]).toDF(*names)
    if len(names) == 1:
        sample = [names[0], *[r[0] or "" for r in raw.limit(5).collect()]]
        for other in (";", "\t", "|"):
            if other != sep and all(other in s for s in sample):
                warnings.warn(f"one column only; is the separator {other!r}?", stacklevel=3)
    return infer_columns(rows, decimal, hexadecimal)


def read_csv_mem(spark: SparkSession, text: str, sep: str = ",", header: bool = True, quote: str = '"', decimal: str = ".", na_values: Sequence[str] | None = None, hexadecimal: bool = False) -> DataFrame:
    """A CSV text, on the driver, as a typed DataFrame; the rules of read_csv."""
    if sep == decimal:
        raise ValueError("separator and decimal mark are equal")
    rows = [r for r in csv.reader(io.StringIO(text, newline=""), delimiter=sep, quotechar=quote) if r]
    if not rows:
        raise ValueError("empty input")
    width = len(rows[0])
    names = rows[0] if header else [f"col{i}" for i in range(width)]
    body = [(r + [None] * width)[:width] for r in rows[header:]]
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(width)])
    return _finished(spark.createDataFrame(body, schema), names, sep, decimal, na_values, hexadecimal)


def as_text(df: DataFrame, decimal: str = ".") -> DataFrame:
    """Every column as the text a file holds: absent empty, doubles with 17 digits, booleans true and false, moments in ISO form."""
    out = []
    for f in df.schema.fields:
        x, kind = F.col(f.name), dtype_of(f)
        if kind == "float64":
            x = casts.float_text(x.cast("double"))
            x = F.replace(x, F.lit("."), F.lit(decimal)) if decimal != "." else x
        elif kind == "datetime":
            x = iso(x)
        out.append(x.cast("string").alias(f.name))
    return df.select(*out)


def _quoted(x: Column, sep: str, quote: str) -> Column:
    special = F.contains(x, F.lit(sep)) | F.contains(x, F.lit(quote)) | F.contains(x, F.lit("\n")) | F.contains(x, F.lit("\r"))
    return F.when(x.isNull(), F.lit("")).when(special, F.concat(F.lit(quote), F.replace(x, F.lit(quote), F.lit(quote * 2)), F.lit(quote))).otherwise(x)


def _lines(df: DataFrame, sep: str, quote: str, decimal: str) -> DataFrame:
    text = as_text(df, decimal)
    return text.select(F.concat_ws(sep, *[_quoted(F.col(f"`{c}`"), sep, quote) for c in text.columns]).alias("value"))


def write_csv(df: DataFrame, path: str, sep: str = ",", header: bool = True, quote: str = '"', decimal: str = ".") -> None:
    """df as a folder of CSV part files, each with the header; fields are quoted only where they need it."""
    if sep == decimal:
        raise ValueError("separator and decimal mark are equal")
    as_text(df, decimal).write.option("sep", sep).option("header", header).option("quote", quote).option("escape", quote).option("nullValue", "").option("emptyValue", '""').mode("overwrite").csv(path)


def csv_text(df: DataFrame, sep: str = ",", header: bool = True, quote: str = '"', decimal: str = ".") -> str:
    """df as one CSV text on the driver."""
    body = [r[0] for r in _lines(df, sep, quote, decimal).collect()]
    names = df.sparkSession.range(1).select(F.concat_ws(sep, *[_quoted(F.lit(c), sep, quote) for c in df.columns])).first()[0]
    return "\n".join([*([names] if header else []), *body]) + "\n"
