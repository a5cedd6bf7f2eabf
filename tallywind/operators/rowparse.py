"""Records of delimited text as typed rows; those that cannot be read apart, with the reason."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import moment_pattern, parse_moment_ms
from ..session import evaluated

#: The texts that stand for a missing value.
MISSING = ("", "NA", "null", "N/A", "NULL")

_QUOTED = r'"[^"]*+(?:""[^"]*+)*+"'
_BARE = r'[^",]*+'
_ANY = rf"(?:{_QUOTED}|{_BARE})"
_BLANKS = r"[ \t\n\x0b\f\r]*+"


@dataclass(frozen=True)
class Field:
    """A column of the schema: its name and kind (`moment`, `double`, `bigint` or `string`)."""

    name: str
    kind: str


def _field_pattern(kind: str, group: int) -> str:
    """The field within a row, quoted or not, or missing; the groups of a moment count from `group`."""
    if kind == "string":
        return _ANY
    missing = "|".join(m for m in MISSING if m)
    value = {
        "double": lambda _: _BLANKS + r"[+-]?(?:(?:[0-9]++(?:\.[0-9]*+)?|\.[0-9]++)(?:[eE][+-]?[0-9]++)?|(?i:nan|inf))",
        "bigint": lambda _: _BLANKS + r"[+-]?[0-9]++",
        "moment": moment_pattern,
    }[kind]
    return rf'(?:"(?:{value(group)}|{missing})?"|(?:{value(group + 2)}|{missing})?)'


def row_patterns(schema: Sequence[Field]) -> list[str]:
    """Anchored patterns of the row's prefixes: of its first field, its first two, ...; the last is the whole row's."""
    patterns, row, group = [], "^", 1
    for i, field in enumerate(schema):
        row += ("," if i else "") + _field_pattern(field.kind, group)
        group += 4 * (field.kind == "moment")
        patterns.append(row + (r"\z" if i == len(schema) - 1 else r"(?=,)"))
    return patterns


def parse_rows(df: DataFrame, raw: str, schema: Sequence[Field], keep: Sequence[str] = ()) -> DataFrame:
    """Each record of df.raw as one row: `keep` columns, `reason`, and the typed schema columns.

    One regular expression, generated from the schema and anchored at both
    ends, decides whether a row can be read. Only rows that fail it go through
    the prefix patterns, one field longer each, which name the first broken
    field. Value checks that no pattern expresses (calendar, range of a double
    or of 64 bits) come with the conversion. Everything is one projection: no
    shuffle, and code-generated.

    `reason` is NULL for a readable row, else the first that applies of
    `bad_quoting`, `column_count`, `bad_<field>`; typed columns are then NULL.
    A null or blank record (only line ends) gives no row; one trailing carriage
    return is dropped. A moment becomes TIMESTAMP. `keep` columns must not clash
    with schema names; all other columns are ignored.
    """
    clash = set(keep) & {f.name for f in schema}
    if clash:
        raise ValueError(f"kept columns clash with the schema: {sorted(clash)}")
    line = F.regexp_replace(F.col(raw), r"\r\z", "")
    prefixes = row_patterns(schema)
    rows = df.where(F.col(raw).isNotNull() & ~F.col(raw).rlike(r"^[\r\n]*+\z")).select(*keep, line.alias("__line"))

    n = len(schema)
    cell = lambda i: F.regexp_extract("__line", "^" + f"{_ANY}," * i + f"({_ANY})", 1)
    quoting = ~F.col("__line").rlike(rf"^{_ANY}(?:,{_ANY})*+\z")
    count = ~F.col("__line").rlike(rf"^{_ANY}(?:,{_ANY}){{{n - 1}}}\z")
    rows = rows.select(*keep, "__line", F.col("__line").rlike(prefixes[-1]).alias("__fits"))
    shape = F.when(F.col("__fits"), None).when(quoting, "bad_quoting").when(count, "column_count")
    rows = rows.select(*keep, "__line", "__fits", shape.alias("__shape"))
    # rows of the right shape can be cut into fields; one without any quote is cut by its commas
    cut = F.when(F.col("__line").contains('"'), F.array(*[cell(i) for i in range(n)])).otherwise(F.split("__line", ","))
    rows = rows.select(*keep, "__line", "__fits", "__shape", F.when(F.col("__shape").isNull(), cut).alias("__cells"))

    def value(i: int) -> Column:
        text = F.element_at("__cells", i + 1)
        text = F.when(text.startswith('"'), F.replace(F.substring(text, F.lit(2), F.length(text) - 2), F.lit('""'), F.lit('"'))).otherwise(text)
        return F.when(~text.isin(*MISSING), text)

    rows = evaluated(rows, keep, ["__line", "__fits", "__shape", *[value(i).alias(f"__v{i}") for i in range(n)]])
    typed, broken = [], []
    for i, field in enumerate(schema):
        v = F.col(f"__v{i}")
        if field.kind == "moment":
            x = F.timestamp_millis(parse_moment_ms(v))
            bad = v.isNotNull() & x.isNull()
        elif field.kind == "double":
            x = F.btrim(v, F.lit(" \t\n\x0b\x0c\r")).try_cast("double")
            beyond = (F.abs(x) == float("inf")) & ~F.lower(v).contains("inf")
            below = (x == 0) & F.regexp_replace(v, r"[eE][\s\S]*", "").rlike("[1-9]")
            bad = v.isNotNull() & (x.isNull() | beyond | below)
        elif field.kind == "bigint":
            x = F.btrim(v, F.lit(" \t\n\x0b\x0c\r")).try_cast("bigint")
            bad = v.isNotNull() & x.isNull()
        else:
            x, bad = v, F.lit(False)
        typed.append(x)
        broken.append(bad)
    rows = rows.select(*keep, "__line", "__fits", "__shape", *[x.alias(f"__x{i}") for i, x in enumerate(typed)], *[b.alias(f"__b{i}") for i, b in enumerate(broken)])

    # the prefix patterns find the first broken field; a field whose pattern holds may still be out of range
    reason = F.when(F.col("__shape").isNotNull(), F.col("__shape"))
    for i, (field, prefix) in enumerate(zip(schema, prefixes)):
        broken_here = F.col(f"__b{i}") | (~F.col("__fits") & ~F.col("__line").rlike(prefix))
        reason = reason.when(broken_here, f"bad_{field.name}")
    rows = evaluated(rows, keep, [reason.alias("reason"), *[f"__x{i}" for i in range(n)]])
    good = F.col("reason").isNull()
    return rows.select(*keep, "reason", *[F.when(good, F.col(f"__x{i}")).alias(f.name) for i, f in enumerate(schema)])
