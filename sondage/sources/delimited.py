"""Delimited text: reading with missing-value tokens and inferred types, writing,
and guessing the delimiter."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sondage.functions.columns import column
from sondage.session import checkpointed
from sondage.sources import records

# Texts that mean "missing" in delimited files.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# Candidate delimiters in order of preference.
DELIMITERS = [",", ";", "\t", "|"]

INTEGER = r"^\s*[+-]?\d+\s*$"
NUMBER = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|inf|Inf|infinity|Infinity)\s*$"
DAY = r"^\d{4}-\d{2}-\d{2}$"
MOMENT = r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?(Z|[+-]\d{2}:?\d{2})?$"
TRUTH = r"^(True|TRUE|true|False|FALSE|false)$"


def _csv_options(encoding: str, delimiter: str, options: dict) -> dict:
    """Quotes are doubled inside quoted text, as RFC 4180 has it."""
    return {
        "header": "true", "sep": delimiter, "encoding": encoding,
        "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false",
        "ignoreTrailingWhiteSpace": "false", **options,
    }


def missing_tokens_as_null(df: DataFrame, tokens: Sequence[str] = NA_TOKENS) -> DataFrame:
    """Text columns with every missing-value token replaced by NULL."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not texts:
        return df
    return df.withColumns(
        {n: F.when(~column(n).isin(list(tokens)), column(n)) for n in texts}
    )


# Narrowest first: a column gets the first type all its values have. Integers never become
# doubles, in which different ones would fall together: beyond bigint they are decimals,
# beyond these text.
TYPES = [
    ("boolean", TRUTH), ("bigint", INTEGER), ("decimal(38,0)", INTEGER), ("string", INTEGER),
    ("double", NUMBER), ("date", DAY), ("timestamp", MOMENT),
]


def _has_type(c: Column, name: str, pattern: str) -> Column:
    return F.when(c.isNotNull(), c.rlike(pattern) & c.try_cast(name).isNotNull())


def infer_types(df: DataFrame) -> dict[str, str]:
    """The narrowest type of every text column, from one aggregation over all rows."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not texts:
        return {}
    checks = []
    for name in texts:
        c = column(name)
        for kind, pattern in TYPES:
            fits = F.coalesce(F.every(_has_type(c, kind, pattern)), F.lit(False))
            checks.append(F.struct(F.lit(name).alias("name"), F.lit(kind).alias("kind"), fits.alias("fits")))
    rows = df.agg(F.array(*checks).alias("rows")).select(F.inline("rows")).where("fits").collect()
    found: dict[str, str] = {}
    for row in rows:  # one per column and type, narrowest type first
        found.setdefault(row["name"], row["kind"])
    return found


def with_inferred_types(df: DataFrame) -> DataFrame:
    types = infer_types(df)
    if not types:
        return df
    return df.withColumns(
        {n: F.trim(column(n)).try_cast(kind) for n, kind in types.items() if kind != "string"}
    )


def read_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    encoding: str = "utf-8",
    delimiter: str = ",",
    schema: T.StructType | str | None = None,
    multi_line: bool | None = None,
    na_tokens: Sequence[str] = NA_TOKENS,
    **options,
) -> DataFrame:
    """Read delimited text with a header.

    Missing-value tokens become NULL and types are inferred from all rows, unless a
    ``schema`` is given, whose columns are found by the names in the header; a name that is
    not there is an error. Files are read in splits, so there is no chunk size to choose.

    Files whose quoted values hold line breaks are found by a pass over all lines and cut
    into records in splits as well, the others are left to Spark's reader.
    ``multi_line=True`` skips the pass and reads every file by one task (as do encodings of
    more than one byte per ASCII letter); False takes every line for a record.
    """
    paths = [path] if isinstance(path, str) else list(path)
    wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if multi_line is None and encoding.lower().startswith(("utf-16", "utf16", "utf-32", "utf32")):
        multi_line = True
    broken, settings = None, _csv_options(encoding, delimiter, options)
    if multi_line is None:
        lines = records.lines_of(spark, paths, encoding)
        broken = records.files_with_line_breaks(lines, delimiter)
    reader = spark.read.options(**settings | {"multiLine": str(bool(multi_line or broken)).lower()})
    names = reader.csv(paths).columns
    if wanted is not None and (unknown := [f.name for f in wanted.fields if f.name not in names]):
        raise ValueError(f"No such columns in the header: {unknown}; it has {names}")
    as_text = T.StructType([T.StructField(n, T.StringType()) for n in names])
    texts = reader.option("multiLine", str(bool(multi_line)).lower()).schema(as_text).csv(paths)
    if broken:
        plain = texts.where(~F.col("_metadata.file_path").isin(broken))
        lines = lines.where(F.col("file").isin(broken))
        cut = records.records(lines, checkpointed(records.ranges(lines, delimiter)), delimiter)
        fields = F.from_csv("record", as_text.toDDL(), settings | {"header": "false"})
        texts = plain.unionByName(cut.where(~F.col("first")).select(fields.alias("fields")).select("fields.*"))
    texts = missing_tokens_as_null(texts, na_tokens)
    if wanted is None:
        return with_inferred_types(texts)
    return texts.select(*[column(f.name).try_cast(f.dataType).alias(f.name) for f in wanted.fields])


def write_csv(
    df: DataFrame,
    path: str,
    encoding: str = "utf-8",
    delimiter: str = ",",
    mode: str = "overwrite",
    **options,
) -> None:
    df.write.mode(mode).options(**_csv_options(encoding, delimiter, options)).csv(path)


def infer_delimiter(spark: SparkSession, path: str, sample_lines: int = 5) -> str:
    """The candidate found most often in the first lines; a comma if none can be read.

    Only the first split of one file is opened.
    """
    try:
        lines = spark.read.text(path).take(sample_lines)
    except Exception:  # unreadable: the default stands
        return DELIMITERS[0]
    text = "\n".join(row["value"] for row in lines)
    return max(DELIMITERS, key=text.count)
