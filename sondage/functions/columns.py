"""Column roles, and the treatment of missing values every operator starts from."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FRACTIONAL = (T.FloatType, T.DoubleType)
NUMERIC = INTEGRAL + FRACTIONAL + (T.DecimalType,)
TEXT = (T.StringType, T.CharType, T.VarcharType)
DATETIME = (T.DateType, T.TimestampType, T.TimestampNTZType)
# Hexadecimal digits of a SHA-256.
DIGEST_LENGTH = 64
NESTED = (T.ArrayType, T.MapType, T.StructType)


def column(name: str) -> Column:
    """The column called ``name``, whatever characters the name holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def role(data_type: T.DataType) -> str:
    """numeric, categorical, datetime or other.

    Booleans and intervals are not numeric here; a decimal is.
    """
    if isinstance(data_type, NUMERIC):
        return "numeric"
    if isinstance(data_type, TEXT):
        return "categorical"
    if isinstance(data_type, DATETIME):
        return "datetime"
    return "other"


def columns_with_role(df: DataFrame, wanted: str) -> list[str]:
    return [f.name for f in df.schema.fields if role(f.dataType) == wanted]


def numeric_columns(df: DataFrame) -> list[str]:
    return columns_with_role(df, "numeric")


def categorical_columns(df: DataFrame) -> list[str]:
    return columns_with_role(df, "categorical")


def datetime_columns(df: DataFrame) -> list[str]:
    return columns_with_role(df, "datetime")


def require(df: DataFrame, names: list[str]) -> None:
    """Raise ValueError if a name is not a column of ``df``."""
    unknown = [n for n in names if n not in df.columns]
    if unknown:
        raise ValueError(f"Column(s) not found: {', '.join(unknown)}")


def require_numeric(df: DataFrame, names: list[str]) -> None:
    require(df, names)
    wrong = [n for n in names if n not in numeric_columns(df)]
    if wrong:
        raise ValueError(f"Column(s) not numeric: {', '.join(wrong)}")


def nan_as_null(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL: both mean "missing", but Spark would count a NaN."""
    fractional = [f.name for f in df.schema.fields if isinstance(f.dataType, FRACTIONAL)]
    if not fractional:
        return df
    return df.withColumns({n: F.when(~F.isnan(column(n)), column(n)) for n in fractional})


def identity_key(name: str, data_type: T.DataType) -> Column:
    """A value of bounded width that is equal exactly when the column's values are.

    Long text is replaced by its SHA-256 (64 hex digits); text shorter than that
    stays as it is, so the two can never meet. Counting distinct values, duplicates
    or contingency cells then shuffles at most 64 characters per text value.
    """
    c = column(name)
    if isinstance(data_type, TEXT):
        return F.when(F.char_length(c) >= DIGEST_LENGTH, F.sha2(c, 256)).otherwise(c)
    if isinstance(data_type, T.BinaryType):
        return F.sha2(c, 256)
    if isinstance(data_type, T.MapType):
        return F.array_sort(F.map_entries(c))
    return c


def row_digest(df: DataFrame, names: list[str]) -> Column:
    """SHA-256 of the values of the columns, equal exactly when all values are: each with
    its length in front, missing ones marked. Apply it to ``nan_as_null`` rows."""
    fields = []
    for name in names:
        kind = df.schema[name].dataType
        c = column(name)
        if isinstance(kind, NESTED):
            c = F.to_json(F.struct(identity_key(name, kind).alias("v")))
        elif isinstance(kind, T.BinaryType):
            c = F.hex(c)
        elif isinstance(kind, FRACTIONAL):
            c = positive_zero(c).cast("string")
        else:
            c = c.cast("string")
        fields.append(F.coalesce(F.concat(F.char_length(c), F.lit(":"), c), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*fields), 256))


def row_hashes(df: DataFrame, names: list[str]) -> list[Column]:
    """Two 64-bit hashes that are equal when all values are, and else, by chance, once in
    2^128 pairs of rows. Nothing is turned into text. Hashes pass over missing values, so
    that which ones are missing is hashed as well. Apply it to ``nan_as_null`` rows."""
    values: list[Column] = []
    for start in range(0, len(names), 60):
        flags = [
            F.when(column(n).isNull(), F.lit(1 << i)).otherwise(0) for i, n in enumerate(names[start : start + 60])
        ]
        values.append(sum(flags, F.lit(0).cast("bigint")))
    for name in names:
        kind = df.schema[name].dataType
        c = column(name)
        if isinstance(kind, FRACTIONAL):
            c = positive_zero(c)
        elif isinstance(kind, NESTED):  # missing values may lie within
            c = F.to_json(F.struct(identity_key(name, kind).alias("v")))
        values.append(c)
    return [F.xxhash64(*values), F.xxhash64(F.lit("second"), *values)]


def positive_zero(c: Column) -> Column:
    """Drop the sign of a zero, so that -0.0 and 0.0 print and compare alike."""
    return c + F.lit(0.0)


def rounded(c: Column, digits: int) -> Column:
    return positive_zero(F.round(c, digits))


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole to two decimals; NULL for an empty whole."""
    return F.round(F.try_divide(part.cast("double"), whole.cast("double")) * 100.0, 2)


def in_slots(
    df: DataFrame, values: list[Column], kinds: list[str], *beside: str
) -> tuple[DataFrame, list[str]]:
    """Rows (beside..., _id, one column per kind): every value of every row, numbered by ``values``, in
    the slot of its kind, and the names of the slots. Columns of any types are so counted
    in one scan, in their own types."""
    slots = {kind: f"_slot{i}" for i, kind in enumerate(dict.fromkeys(kinds))}
    rows = [
        F.struct(
            F.lit(i).alias("_id"),
            *[(value if kind == own else F.lit(None)).cast(kind).alias(slot) for kind, slot in slots.items()],
        )
        for i, (value, own) in enumerate(zip(values, kinds, strict=True))
    ]
    return df.select(*beside, F.inline(F.array(*rows))), list(slots.values())
