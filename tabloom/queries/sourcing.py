"""Queries that read the test tables through the library's own sources."""

import uuid

from pyspark.sql import functions as F

from tabloom.queries import Registry, table
from tabloom.session import checkpoint_folder
from tabloom.sources.readers import MISSING, ingest, load_dataset

registry = Registry()

COLUMNS = "c_custkey, c_name, c_nationkey, c_acctbal"


def _folder(spark, name):
    """A fresh folder in the shared space."""
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


@registry.add("csv_source", f"SELECT {COLUMNS} FROM customer")
def csv_source(spark, folder):
    path = _folder(spark, "customer") + ".csv"
    table(spark, folder, "customer").selectExpr(*COLUMNS.split(", ")).write.option("header", True).csv(path)
    kinds = dict(table(spark, folder, "customer").dtypes)
    return load_dataset(spark, path, schema=", ".join(f"{c} {kinds[c]}" for c in COLUMNS.split(", ")))


_WRITTEN = """o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'T' ELSE 'F' END AS letter, concat(cast(o_orderkey % 10 AS varchar(2)), 'd') AS code,
    concat('12:', lpad(cast(o_orderkey % 60 AS varchar(2)), 2, '0')) AS clock"""


@registry.add(
    "csv_inference",
    f"""SELECT {_WRITTEN}, o_custkey::INTEGER AS padded, o_orderkey % 3 = 0 AS truth, o_totalprice AS price,
        CASE WHEN o_orderkey % 4 = 0 THEN 'none' ELSE (o_orderkey % 7)::VARCHAR END AS mixed FROM orders""",
)
def csv_inference(spark, folder):
    """Types found in the texts: letters, codes and clock times stay text, padded numbers are numbers."""
    path = _folder(spark, "orders") + ".csv"
    written = table(spark, folder, "orders").selectExpr(
        "o_orderkey",
        "CASE WHEN o_orderkey % 2 = 0 THEN 'T' ELSE 'F' END AS letter",
        "concat(cast(o_orderkey % 10 AS string), 'd') AS code",
        "concat('12:', lpad(cast(o_orderkey % 60 AS string), 2, '0')) AS clock",
        "lpad(cast(o_custkey AS string), 9, '0') AS padded",
        "CASE WHEN o_orderkey % 3 = 0 THEN 'True' ELSE 'False' END AS truth",
        "o_totalprice AS price",
        "CASE WHEN o_orderkey % 4 = 0 THEN 'none' ELSE cast(o_orderkey % 7 AS string) END AS mixed",
    )
    written.write.option("header", True).csv(path)
    return load_dataset(spark, path).withColumn("o_orderkey", F.col("o_orderkey").cast("long"))


@registry.add(
    "csv_line_breaks",
    f"SELECT doc_id, CASE WHEN text NOT IN ({', '.join(repr(m) for m in MISSING)}) THEN text END AS text, lang FROM documents",
)
def csv_line_breaks(spark, folder):
    """Whole texts with quotes and line breaks, written as CSV and read in parallel."""
    path = _folder(spark, "documents") + ".csv"
    documents = table(spark, folder, "documents").select("doc_id", "text", "lang")
    written = documents.write.options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    written.csv(path)
    kinds = dict(documents.dtypes)
    return load_dataset(spark, path, schema=", ".join(f"{c} {k}" for c, k in kinds.items()), multiLine=True)


@registry.add("parquet_source", f"SELECT {COLUMNS} FROM customer")
def parquet_source(spark, folder):
    return load_dataset(spark, f"{folder}/customer.parquet").selectExpr(*COLUMNS.split(", "))


@registry.add("sql_source", "SELECT n_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def sql_source(spark, folder):
    for name in ("customer", "nation"):
        table(spark, folder, name).createOrReplaceTempView(f"source_{name}")
    return load_dataset(
        spark,
        sql_query="SELECT n_name, count(*) AS customers FROM source_customer JOIN source_nation ON c_nationkey = n_nationkey GROUP BY n_name",
    )


@registry.add("ingest", "SELECT count(*) AS rows, (SELECT count(*) FROM (DESCRIBE SELECT * FROM orders)) AS columns FROM orders")
def ingest_orders(spark, folder):
    """Row and column count of a stored copy."""
    stored = ingest(spark, f"{folder}/orders.parquet", _folder(spark, "orders") + ".parquet")
    return spark.createDataFrame([(stored["rows"], len(spark.read.parquet(stored["dataset_path"]).columns))], "rows long, columns long")
