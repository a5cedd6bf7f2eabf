"""JSON: arrays or lines of flat objects, matched by key."""

from __future__ import annotations

import json
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import iso
from ..types import SPARK, dtype_of

_SCALAR = (T.StringType, T.LongType, T.DoubleType, T.BooleanType, T.NullType)


def _typed(df: DataFrame) -> DataFrame:
    nested = [f.name for f in df.schema.fields if not isinstance(f.dataType, _SCALAR)]
    if nested:
        raise ValueError(f"nested values in {nested}")
    return df.select(*[F.col(f"`{f.name}`").cast("string").alias(f.name) if isinstance(f.dataType, T.NullType) else F.col(f"`{f.name}`") for f in df.schema.fields])


def read_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """A file with one array of flat objects (or, with lines, an object a line) as a typed DataFrame.

    Values belong to the column of their key, wherever it stands in the record;
    missing keys are NULL. Whole numbers are int64, mixed with fractions
    float64, mixed with anything else string. Nested values are an error.
    """
    return _typed(spark.read.option("multiLine", not lines).option("mode", "FAILFAST").json(path))


def read_json_mem(spark: SparkSession, text: str) -> DataFrame:
    """A JSON text of an array of flat objects; [] gives an empty frame. Columns stand in the order of their first appearance."""
    records = json.loads(text)
    if not isinstance(records, list) or any(not isinstance(r, dict) for r in records):
        raise ValueError("an array of objects is needed")
    if any(isinstance(v, (dict, list)) for r in records for v in r.values()):
        raise ValueError("nested values")
    names = list(dict.fromkeys(k for r in records for k in r))
    fields, columns = [], []
    for n in names:
        values = [r.get(n) for r in records]
        kinds = {"bool" if isinstance(v, bool) else "int64" if isinstance(v, int) else "float64" if isinstance(v, float) else "string" for v in values if v is not None}
        kind = kinds.pop() if len(kinds) == 1 else "float64" if kinds == {"int64", "float64"} else "string"
        make = {"float64": float, "string": lambda v: v if isinstance(v, str) else json.dumps(v)}.get(kind, lambda v: v)
        columns.append([None if v is None else make(v) for v in values])
        fields.append(T.StructField(n, SPARK[kind]))
    return spark.createDataFrame(list(zip(*columns)) if names else [], T.StructType(fields))


def _records(df: DataFrame) -> DataFrame:
    out = []
    for f in df.schema.fields:
        x, kind = F.col(f"`{f.name}`"), dtype_of(f)
        if kind == "float64":
            x = F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)
        elif kind == "datetime":
            x = iso(x)
        out.append(x.alias(f.name))
    return df.select(*out)


def count_non_finite(df: DataFrame) -> int:
    """How many present numbers are NaN or infinite."""
    names = [f.name for f in df.schema.fields if dtype_of(f) == "float64"]
    if not names:
        return 0
    tests = [F.count_if(F.isnan(F.col(f"`{n}`")) | (F.abs(F.col(f"`{n}`")) == float("inf"))) for n in names]
    return sum(df.agg(*tests).first())


def _warn(df: DataFrame) -> None:
    n = count_non_finite(df)
    if n:
        warnings.warn(f"{n} values are NaN or infinite and become null", stacklevel=3)


def write_json(df: DataFrame, path: str, pretty: bool = False, lines: bool = True) -> None:
    """df as a folder of JSON lines in part files, or, with lines=False, one file with an array of records, in the order of df.

    Absent, NaN and infinite values are null, moments in ISO form. The array is
    put together by one task, record by record: it is for files that other
    programs read whole. `pretty` indents it.
    """
    _warn(df)
    rows = _records(df)
    record = F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), {"ignoreNullFields": "false"} | ({"pretty": "true"} if pretty else {}))
    texts = rows.select(record.alias("value"))
    if not lines and df.isEmpty():
        df.sparkSession.createDataFrame([("[]",)], "value string").coalesce(1).write.mode("overwrite").text(path)
        return
    if lines:
        texts.write.mode("overwrite").text(path)
        return

    def framed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = "["
        for batch in batches:
            out = []
            for text in batch.column(0).to_pylist():
                out.append(before + ("\n" if pretty else "") + text)
                before = ","
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["]"], pa.string())], names=["value"])

    texts.coalesce(1).mapInArrow(framed, "value string").write.mode("overwrite").text(path)


def json_text(df: DataFrame, pretty: bool = False) -> str:
    """df as the text of one array, on the driver."""
    _warn(df)
    rows = [r.asDict() for r in _records(df).collect()]
    return json.dumps(rows, ensure_ascii=False, indent=2 if pretty else None)
