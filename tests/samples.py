"""Hand-written register files and frames."""

from __future__ import annotations

import gzip
from datetime import date
from pathlib import Path

from landprice.schema import REGISTER_COLUMNS

COLUMNS = list(REGISTER_COLUMNS)
SALES_SCHEMA = (
    "id_mutation string, date_mutation date, numero_disposition string, id_parcelle string, "
    "lot1_numero string, code_postal string, adresse_numero string, adresse_nom_voie string, "
    "nom_commune string, type_local string, valeur_fonciere double, surface_reelle_bati double"
)


def record(**values: str) -> list[str]:
    base = {
        "id_mutation": "m1",
        "date_mutation": "2024-01-02",
        "numero_disposition": "000001",
        "nature_mutation": "Vente",
        "valeur_fonciere": "100000",
        "code_postal": "01230",
        "nom_commune": "Plateau d'Hauteville",
        "id_parcelle": "p1",
        "nombre_lots": "0",
        "longitude": "5.530952",
        "latitude": "45.952439",
    }
    base.update(values)
    return [base.get(name, "") for name in COLUMNS]


def line(**values: str) -> str:
    cells = record(**values)
    return ",".join(f'"{c}"' if "," in c else c for c in cells)


def write_file(path: Path, lines: list[str | bytes], header: str | None = None) -> str:
    path.parent.mkdir(parents=True, exist_ok=True)
    texts = [header or ",".join(COLUMNS), *lines]
    data = b"".join(
        (text if isinstance(text, bytes) else text.encode()) + b"\n" for text in texts
    )
    if path.suffix == ".gz":
        with gzip.open(path, "wb") as out:
            out.write(data)
    else:
        path.write_bytes(data)
    return str(path)


def sales(spark, rows: list[dict]):
    """A sales frame from partial rows; every row is a valid flat unless it says otherwise."""
    full = []
    for number, row in enumerate(rows):
        base = {
            "id_mutation": f"m{number}",
            "date_mutation": date(2024, 1, 1),
            "numero_disposition": "000001",
            "id_parcelle": f"p{number}",
            "lot1_numero": None,
            "code_postal": "75001",
            "adresse_numero": None,
            "adresse_nom_voie": "RUE HAUTE",
            "nom_commune": "Gex",
            "type_local": "Appartement",
            "valeur_fonciere": 100000.0,
            "surface_reelle_bati": 50.0,
        }
        base.update(row)
        full.append(tuple(base.values()))
    return spark.createDataFrame(full, SALES_SCHEMA)
