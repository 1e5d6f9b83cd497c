"""Dataset readers and ingest."""

from __future__ import annotations

from typing import Any
from urllib.parse import unquote, urlsplit

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tabloom.functions.columns import col, nan_to_null
from tabloom.sources.records import quoted_records

CSV, PARQUET = (".csv",), (".parquet", ".pq")
# Texts that stand for a missing value in CSV files.
MISSING = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
SQL_SCHEMES = ("postgresql", "postgresql+psycopg2", "sqlite", "mysql")


def is_sql_source(path: str) -> bool:
    return "://" in path and path.split("://", 1)[0] in SQL_SCHEMES


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file, folder or glob exists on the path's own file system."""
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = location.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(location)
    return found is not None and len(found) > 0


def load_dataset(
    spark: SparkSession,
    path: str | None = None,
    sql_query: str | None = None,
    schema: Any = None,
    partition_column: str | None = None,
    partitions: int | None = None,
    format: str | None = None,
    misfits: str = "raise",
    **options: Any,
) -> DataFrame:
    """Read CSV, Parquet, the result of a SQL query, or without a path a query over registered tables.

    NaN, and in CSV the texts of ``MISSING``, become NULL. CSV types are found in one pass over the file
    unless ``schema`` is given. ``format`` ("csv" or "parquet") is for files and folders without a suffix.
    Numbers, true and false, dates, and timestamps with a date are recognised as they are usually written; codes such
    as ``T``, ``10d`` or ``12:30`` stay text. Under a ``schema`` a CSV value of another type fails the read, or is NULL
    with ``misfits="null"``. CSV values with line breaks need ``multiLine=True``; such files are read in parallel if no
    options but ``header``, ``sep``, ``quote`` and an ``escape`` equal to the quote are given, else by one task a file.

    A SQL source is read by one task unless ``partition_column`` (numeric, date or timestamp) is named.
    """
    if misfits not in ("raise", "null"):
        raise ValueError("misfits must be 'raise' or 'null'.")
    if path is None or is_sql_source(path):
        if not sql_query:
            raise ValueError("sql_query is required for a SQL connection string or when there is no path.")
        return nan_to_null(spark.sql(sql_query) if path is None else _read_sql(spark, path, sql_query, partition_column, partitions, options))
    name = path.rstrip("/*").rsplit("/", 1)[-1].lower()
    suffix = f".{format}" if format else "." + name.rsplit(".", 1)[-1] if "." in name else ""
    if not path_exists(spark, path):
        raise FileNotFoundError(f"Dataset not found: {path}")
    if suffix not in CSV + PARQUET:
        raise ValueError(f"Unsupported format '{suffix}'. Use .csv, .parquet, .pq, format= or a SQL connection string.")
    reader = spark.read.options(**options)
    if suffix in PARQUET:
        return nan_to_null((reader.schema(schema) if schema is not None else reader).parquet(path))
    wanted = None
    if schema is not None:
        wanted = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
        reader = reader.schema(T.StructType([T.StructField(f.name, T.StringType()) for f in wanted]))
    defaults = {"header": True, "inferSchema": False, "quote": '"', "escape": '"'}
    options = defaults | options
    texts = reader.options(**options).csv(path)
    if _in_parallel(spark, path, options):
        texts = _parse_records(spark, path, texts.columns, options)
    texts = texts.select(*[F.when(~col(c).isin(*MISSING), col(c)).alias(c) for c in texts.columns])
    kinds = {f.name: f.dataType.simpleString() for f in wanted} if wanted else _kinds(texts)
    # Inferred types fit every value.
    return nan_to_null(texts.select(*[_cast(c, k, misfits if wanted else "null") for c, k in kinds.items()]))


def _is_true(option: Any) -> bool:
    return str(option).lower() == "true"


def _in_parallel(spark: SparkSession, path: str, options: dict) -> bool:
    """Whether records with line breaks can be told apart without reading a file from its beginning."""
    known = {"header", "inferSchema", "quote", "escape", "sep", "delimiter", "multiLine"}
    plain = len(options["quote"]) == 1 and options["escape"] == options["quote"] and len(options.get("sep", options.get("delimiter", ","))) == 1
    return _is_true(options.get("multiLine", False)) and set(options) <= known and plain and spark.read.text(path).columns == ["value"]


def _parse_records(spark: SparkSession, path: str, names: list[str], options: dict) -> DataFrame:
    sep = options.get("sep", options.get("delimiter", ","))
    records = quoted_records(spark, path, sep, options["quote"], _is_true(options["header"]))
    schema = ", ".join(f"c{i} string" for i in range(len(names)))
    # With multiLine the parser leaves line breaks inside of quotes as they are.
    parser = {"sep": sep, "quote": options["quote"], "escape": options["escape"], "lineSep": "\n", "multiLine": "true"}
    parsed = records.select(F.from_csv("text", schema, parser).alias("r"))
    return parsed.select(*[F.col(f"r.c{i}").alias(c) for i, c in enumerate(names)])


# How values of each type are written; casts alone would also take "T", "yes", "10d" or "12:30".
_DAY = r"\d{4}-\d{1,2}-\d{1,2}"
WRITTEN = {
    "int": r"^[+-]?\d+$",
    "bigint": r"^[+-]?\d+$",
    "double": r"^[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity))$",
    "boolean": r"^(?i:true|false)$",
    "date": rf"^{_DAY}$",
    "timestamp": rf"^{_DAY}[T ]\d{{1,2}}:\d{{2}}(:\d{{2}}(\.\d+)?)?(Z|[+-]\d{{2}}:?\d{{2}})?$",
}


def _fits(value: Column, kind: str) -> Column:
    """Whether a text is written as a value of the type and is in its range."""
    return F.trim(value).rlike(WRITTEN[kind]) & F.trim(value).try_cast(kind).isNotNull()


def _cast(name: str, kind: str, misfits: str) -> Column:
    """A text column as the type; a value that doesn't fit is NULL or stops the job that reads it."""
    value = col(name).try_cast(kind)
    if misfits == "raise":
        message = F.concat(F.lit(f"Column '{name}' is {kind} by the schema, but holds: "), col(name))
        value = F.when(col(name).isNotNull() & value.isNull(), F.raise_error(message).cast(kind)).otherwise(value)
    return value.alias(name)


def _kinds(texts: DataFrame) -> dict[str, str]:
    """The narrowest type that all values of a column fit; text for columns without values. One pass."""
    candidates = tuple(WRITTEN)
    fit = [
        F.struct(F.count(col(c)).alias("n"), *[F.count_if(_fits(col(c), k)).alias(k) for k in candidates]).alias(f"c{i}")
        for i, c in enumerate(texts.columns)
    ]
    row = texts.agg(*fit).first() if fit else []
    return {c: next((k for k in candidates if row[i]["n"] and row[i][k] == row[i]["n"]), "string") for i, c in enumerate(texts.columns)}


def jdbc_options(url: str) -> dict[str, str]:
    """JDBC url, user and password from a connection string."""
    scheme, rest = url.split("://", 1)
    dialect = scheme.split("+", 1)[0]
    if dialect == "sqlite":
        return {"url": f"jdbc:sqlite:{rest.removeprefix('/')}"}
    parts = urlsplit(f"//{rest}")
    host = parts.hostname or "localhost"
    port = f":{parts.port}" if parts.port else ""
    query = f"?{parts.query}" if parts.query else ""
    options = {"url": f"jdbc:{dialect}://{host}{port}{parts.path}{query}"}
    if parts.username:
        options["user"] = unquote(parts.username)
    if parts.password:
        options["password"] = unquote(parts.password)
    return options


def _read_sql(spark, url: str, query: str, partition_column: str | None, partitions: int | None, options: dict) -> DataFrame:
    reader = spark.read.format("jdbc").options(**jdbc_options(url)).options(**{"fetchsize": 10_000, **options})
    source = f"({query.strip().rstrip(';')}) AS source"
    if partition_column is None:
        return reader.option("dbtable", source).load()
    bounds = f"(SELECT min({partition_column}) AS low, max({partition_column}) AS high FROM {source}) AS bounds"
    low, high = reader.option("dbtable", bounds).load().first()
    whole = reader.option("dbtable", source)
    if low is None:
        return whole.load()
    return whole.options(
        partitionColumn=partition_column,
        lowerBound=str(low),
        upperBound=str(high),
        numPartitions=partitions or spark.sparkContext.defaultParallelism,
    ).load()


def ingest(spark: SparkSession, source: str, destination: str, **options: Any) -> dict:
    """Store a CSV or Parquet dataset as Parquet; the row count then comes from the file footers."""
    df = load_dataset(spark, source, **options)
    df.write.mode("overwrite").parquet(destination)
    return {
        "dataset_path": destination,
        "rows": spark.read.schema(df.schema).parquet(destination).count(),
        "columns": len(df.columns),
        "column_names": df.columns,
    }
