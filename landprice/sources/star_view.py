"""Property sales seen through the star-schema tables (lineitem, supplier, nation).

Every expression is plain SQL, so the same text serves Spark and any other SQL engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The columns the view reads; stated here, so that no job has to read footers for a schema.
SOURCE_COLUMNS = {
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
        "l_quantity double, l_extendedprice double, l_returnflag string, "
        "l_shipdate timestamp_ntz"
    ),
    "supplier": "s_suppkey bigint, s_nationkey int",
    "nation": "n_nationkey int, n_name string",
}
SALES_EXPRESSIONS = {
    "id_mutation": "CAST(l_orderkey AS STRING)",
    "date_mutation": "CAST(l_shipdate AS DATE)",
    "numero_disposition": "lpad(CAST(l_linenumber AS STRING), 6, '0')",
    "valeur_fonciere": (
        "CASE WHEN l_orderkey % 97 = 0 THEN l_extendedprice * 20 ELSE l_extendedprice END"
    ),
    "adresse_numero": (
        "CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE CAST(l_partkey % 500 AS STRING) END"
    ),
    "adresse_nom_voie": "CONCAT('RUE ', UPPER(n_name))",
    "nom_commune": "n_name",
    "code_postal": "lpad(CAST(s_suppkey AS STRING), 5, '0')",
    "id_parcelle": "CONCAT('P', lpad(CAST(l_partkey AS STRING), 6, '0'))",
    "lot1_numero": "CASE WHEN l_linenumber > 4 THEN NULL ELSE CAST(l_linenumber AS STRING) END",
    "type_local": (
        "CASE l_returnflag WHEN 'A' THEN 'Appartement' WHEN 'N' THEN 'Maison' "
        "ELSE 'Dépendance' END"
    ),
    "surface_reelle_bati": (
        "CASE WHEN l_quantity <= 2 THEN NULL WHEN l_quantity = 3 THEN 0.0 ELSE l_quantity END"
    ),
    "import_year": "CAST(EXTRACT(YEAR FROM l_shipdate) AS SMALLINT)",
}
SALES_SQL = (
    "SELECT "
    + ", ".join(f"{text} AS {name}" for name, text in SALES_EXPRESSIONS.items())
    + " FROM lineitem JOIN supplier ON l_suppkey = s_suppkey"
    + " JOIN nation ON s_nationkey = n_nationkey"
)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SOURCE_COLUMNS[name]).parquet(f"{folder}/{name}.parquet")


def sales_view(spark: SparkSession, folder: str) -> DataFrame:
    """The sales rows; join sides are left to the optimiser, which knows their sizes."""
    lines = read_table(spark, folder, "lineitem")
    suppliers = read_table(spark, folder, "supplier")
    nations = read_table(spark, folder, "nation")
    joined = lines.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).join(
        nations, F.col("s_nationkey") == F.col("n_nationkey")
    )
    return joined.select(
        *[F.expr(text).alias(name) for name, text in SALES_EXPRESSIONS.items()]
    )
