"""Readers for the users / transactions tables in Parquet or CSV.

Whatever the storage types, columns are canonicalised once at the source:
ids to BIGINT (sampling order and join keys are numeric, never '123.0'; a
non-integral id is an error) or, with ``text_ids``, user ids to text; order ids
may stay text, they are only counted; dates to DATE (closed windows on a
TIMESTAMP would drop the last day), money to DECIMAL(18,2) (exact sums and
rounding).

Nothing becomes NULL quietly: a CSV row with too few or too many fields and a
value that is no date, number or truth value are errors that quote it, or, with
``rejects``, rows of a table of their own with the reason.  A ``column_map`` that
names an absent column is an error.  An optional column that is absent is NULL
and says so in its metadata (:func:`absent_columns`), so that analyses which
need it can refuse.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .schemas import MONEY, REQUIRED, TEXT_IDS, TRANSACTIONS, USERS

#: Column of CSV rows that do not fit the header.
CORRUPT = "_corrupt_record"
ABSENT = "absent"
_KINDS = {T.LongType: "an integer", T.DateType: "a date", T.DecimalType: "an amount", T.BooleanType: "a truth value"}


def _parsed(name: str, src: T.DataType, dtype: T.DataType, text_ids: bool) -> tuple[Column, Column | None]:
    """The value of a source column, and where it has none although the source
    has one (``None`` where that cannot be)."""
    c = F.col(f"`{name}`")
    if text_ids and name == "user_id":
        return (c if isinstance(src, T.StringType) else c.cast("string")), None
    if src == dtype:
        return c, None  # already canonical: keep the bare column (filters push down)
    if isinstance(dtype, T.LongType) and not isinstance(src, T.IntegralType):
        if name in TEXT_IDS and isinstance(src, T.StringType):
            return c, None
        # Ids exported as '123.0' still join natively; 123.7 is no id.
        number = c.try_cast("decimal(38,6)")
        value = F.when(number == F.floor(number), F.floor(number).try_cast("bigint"))
    else:
        value = c.try_cast(dtype)
    if isinstance(dtype, T.StringType):
        return value, None
    return value, c.isNotNull() & value.isNull()


def _complaint(name: str, dtype: T.DataType) -> Column:
    hint = " (text user ids are read with text_ids)" if name == "user_id" else ""
    return F.concat(F.lit(f"{name} is not {_KINDS.get(type(dtype), dtype.simpleString())}{hint}: "), F.col(f"`{name}`").cast("string"))


def canonicalize(df: DataFrame, schema: T.StructType, text_ids: bool = False) -> DataFrame:
    """Project ``df`` onto ``schema`` by name.  An absent required column is an
    error that names it, as is, when it is read, a value that cannot be
    converted; other absent columns become typed NULLs."""
    present = {f.name: f.dataType for f in df.schema.fields}
    missing = sorted(f.name for f in schema.fields if f.name in REQUIRED and f.name not in present)
    if missing:
        raise ValueError(f"columns {missing} are missing (present: {sorted(present)}); give a column_map "
                         "if they have other names")
    out = []
    for f in schema.fields:
        if f.name not in present:
            kind = T.StringType() if text_ids and f.name == "user_id" else f.dataType
            out.append(F.lit(None).cast(kind).alias(f.name, metadata={ABSENT: True}))
            continue
        value, bad = _parsed(f.name, present[f.name], f.dataType, text_ids)
        if bad is not None:
            value = F.when(bad, F.raise_error(_complaint(f.name, f.dataType)).cast(f.dataType)).otherwise(value)
        out.append(value.alias(f.name))
    return df.select(*out)


def absent_columns(df: DataFrame) -> set[str]:
    """Columns that the source of ``df`` did not have."""
    return {f.name for f in df.schema.fields if f.metadata.get(ABSENT)}


def _renamed(raw: DataFrame, column_map: dict[str, str] | None) -> DataFrame:
    if not column_map:
        return raw
    have = {c.lower() for c in raw.columns}
    unknown = sorted(s for s in column_map if s.lower() not in have)
    if unknown:
        raise ValueError(f"column_map names {unknown}, which the source does not have (present: {sorted(raw.columns)})")
    out = raw.withColumnsRenamed(column_map)
    twice = sorted({c for c in out.columns if [x.lower() for x in out.columns].count(c.lower()) > 1})
    if twice:
        raise ValueError(f"columns {twice} occur twice after the column_map")
    return out


def _rows_of_csv(spark: SparkSession, path: str, options: dict) -> DataFrame:
    """All columns of the header as text (CSV has no types and nothing is
    inferred), and :data:`CORRUPT` for rows with another number of fields."""
    reader = spark.read.option("header", True).options(**options)
    names = reader.csv(path).columns
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, CORRUPT]])
    # enforceSchema: files with other headers are an error, not other columns.
    return (reader.schema(schema).option("mode", "PERMISSIVE").option("enforceSchema", False)
            .option("columnNameOfCorruptRecord", CORRUPT).option("columnPruning", False).csv(path))


def _misfit(raw: DataFrame) -> Column:
    """The text of a CSV row that does not fit the header.  It also reads a real
    column: Spark refuses plans that read the record alone."""
    first = F.substring(F.coalesce(F.col(f"`{raw.columns[0]}`"), F.lit("")), 1, 0)
    return F.concat(F.lit("row does not fit the header: "), F.col(CORRUPT), first)


def read_table(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet",
               column_map: dict[str, str] | None = None, text_ids: bool = False, rejects: str | None = None,
               **options) -> DataFrame:
    """Read Parquet (schema of the file, canonicalised) or CSV (header names).

    ``column_map`` renames source columns to the canonical names
    (``{"source_name": "user_id", ...}``) before canonicalisation, so tables
    exported with other column names need no copy.

    Without ``rejects`` a row that cannot be converted fails the query that
    reads it.  With it, such rows are written there at once (``problem``,
    ``record``) and the others are returned; :func:`rejected` counts them."""
    if fmt == "parquet":
        raw = spark.read.options(**options).parquet(path)
    elif fmt == "csv":
        raw = _rows_of_csv(spark, path, options)
    else:
        raise ValueError(f"unsupported format {fmt!r}")
    raw = _renamed(raw, column_map)
    if rejects is not None:
        problems = [F.when(bad, _complaint(f.name, f.dataType)) for f in schema.fields if f.name in raw.columns
                    for bad in [_parsed(f.name, raw.schema[f.name].dataType, f.dataType, text_ids)[1]] if bad is not None]
        values = F.to_json(F.struct(*[F.col(f"`{c}`") for c in raw.columns if c != CORRUPT]))
        record = F.coalesce(F.col(CORRUPT), values) if fmt == "csv" else values
        problem = F.coalesce(*([_misfit(raw)] if fmt == "csv" else []), *problems, F.lit(None).cast("string"))
        raw.select(problem.alias("problem"), record.alias("record")).where("problem IS NOT NULL").write.parquet(rejects)
        raw = raw.where(problem.isNull())
    elif fmt == "csv":
        raw = raw.where(F.when(F.col(CORRUPT).isNull(), F.lit(True)).otherwise(F.raise_error(_misfit(raw)).cast("boolean")))
    return canonicalize(raw, schema, text_ids)


def rejected(spark: SparkSession, path: str) -> int:
    """Number of rows in a table of rejects."""
    return spark.read.schema("problem string, record string").parquet(path).count()


def read_users(spark: SparkSession, path: str, fmt: str = "parquet",
               column_map: dict[str, str] | None = None, **options) -> DataFrame:
    return read_table(spark, path, USERS, fmt, column_map, **options)


def read_transactions(spark: SparkSession, path: str, fmt: str = "parquet",
                      column_map: dict[str, str] | None = None, **options) -> DataFrame:
    return read_table(spark, path, TRANSACTIONS, fmt, column_map, **options)


__all__ = ["absent_columns", "canonicalize", "read_table", "read_users", "read_transactions", "rejected", "MONEY"]
