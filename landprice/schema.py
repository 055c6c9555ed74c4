"""Table schema of the sales register and the column groups the operators share."""

from __future__ import annotations

from pyspark.sql import types as T

PRICE = T.DecimalType(12, 2)
COORDINATE = T.DecimalType(10, 6)

# Column names, order and storage types of the register table.
# Integers are VARCHAR lengths, None is free text.
REGISTER_COLUMNS: dict[str, T.DataType | int | None] = {
    "id_mutation": 50,
    "date_mutation": T.DateType(),
    "numero_disposition": 20,
    "nature_mutation": 50,
    "valeur_fonciere": PRICE,
    "adresse_numero": None,
    "adresse_suffixe": None,
    "adresse_nom_voie": None,
    "adresse_code_voie": None,
    "code_postal": 5,
    "code_commune": 10,
    "nom_commune": 100,
    "code_departement": 3,
    "ancien_code_commune": 10,
    "ancien_nom_commune": 100,
    "id_parcelle": 50,
    "ancien_id_parcelle": 50,
    "numero_volume": None,
    "lot1_numero": None,
    "lot1_surface_carrez": PRICE,
    "lot2_numero": None,
    "lot2_surface_carrez": PRICE,
    "lot3_numero": None,
    "lot3_surface_carrez": PRICE,
    "lot4_numero": None,
    "lot4_surface_carrez": PRICE,
    "lot5_numero": None,
    "lot5_surface_carrez": PRICE,
    "nombre_lots": None,
    "code_type_local": 5,
    "type_local": 50,
    "surface_reelle_bati": PRICE,
    "nombre_pieces_principales": None,
    "code_nature_culture": 5,
    "nature_culture": 100,
    "code_nature_culture_speciale": 5,
    "nature_culture_speciale": 100,
    "surface_terrain": PRICE,
    "longitude": COORDINATE,
    "latitude": COORDINATE,
}
# Uniqueness key, property types, cleaning limits and null tokens.
KEY = ("id_mutation", "numero_disposition", "id_parcelle", "lot1_numero")
FLAT = "Appartement"
HOUSE = "Maison"
OUTBUILDING = "Dépendance"
NULL_TOKENS = ("", "NaN", "nan", "NULL")
MAX_STORED_PRICE = 100_000_000
MAX_STORED_SURFACE = 10_000_000
DEFAULT_MAX_PRICE = 10_000_000
# Rows of the published report; queries that compare with it state this limit.
REPORT_LIMIT = 10_000
# Number of the load that brought a row, and the year of the empty partition that takes it.
LOAD = "import_load"
MARKER_YEAR = 0
# What is staged, stored or kept of all sales is written smaller than by the session's default.
CODEC = {"compression": "zstd"}
TABLE_CANDIDATES = ("dvf_data", "transactions", "dvf")

PRICE_COLUMN = "valeur_fonciere"
COORDINATE_COLUMNS = ("longitude", "latitude")
SURFACE_COLUMNS = tuple(
    name for name, kind in REGISTER_COLUMNS.items() if kind == PRICE and name != PRICE_COLUMN
)
NUMERIC_COLUMNS = (PRICE_COLUMN, *SURFACE_COLUMNS, *COORDINATE_COLUMNS)
TEXT_LENGTHS = {name: kind for name, kind in REGISTER_COLUMNS.items() if isinstance(kind, int)}

# Newest and dearest first; the remaining columns only make the order total.
RECENT_FIRST_TIES = KEY


def _spark_type(kind: T.DataType | int | None) -> T.DataType:
    return kind if isinstance(kind, T.DataType) else T.StringType()


DATA_SCHEMA = T.StructType(
    [T.StructField(name, _spark_type(kind)) for name, kind in REGISTER_COLUMNS.items()]
)
TABLE_SCHEMA = T.StructType(
    [
        *DATA_SCHEMA.fields,
        T.StructField("import_date", T.TimestampType()),
        T.StructField("import_year", T.ShortType()),
        T.StructField(LOAD, T.IntegerType()),
    ]
)
# What a load writes; the catalog gives its number.
STORED_SCHEMA = T.StructType([field for field in TABLE_SCHEMA if field.name != LOAD])
