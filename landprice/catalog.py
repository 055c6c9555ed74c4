"""Every query of the engine over the star-schema tables, next to equivalent plain SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landprice.functions.prices import price
from landprice.operators.dedup import insert_if_absent, keep_first
from landprice.operators.filters import (
    Filters,
    postal_prefix,
    street_search,
    valid_postal_codes,
)
from landprice.operators.sketches import RANK_ERROR, approximate_distribution, merged, sketched
from landprice.plans.analysis import (
    analyse_by_parcel,
    analyse_every_parcel,
    analyse_prices,
    count_transactions,
    mean_price_by_type,
    mean_price_m2,
)
from landprice.plans.imports import import_files, import_years
from landprice.plans.kept_report import garage_report, whole_population_summary
from landprice.plans.price_report import as_json, filtered_sales, outlier_report, price_report
from landprice.plans.street_lookup import sales_in_streets
from landprice.plans.trends import daily_prices, mean_surface, surface_histogram
from landprice.schema import DATA_SCHEMA, REPORT_LIMIT
from landprice.session import discard, freed_shuffles, materialised, scratch_path
from landprice.sources.register_csv import accepted, clean_records, read_register, reject_report
from landprice.sources.sides import OUTBUILDINGS, PRICE_CELLS, STREETS, refresh
from landprice.sources.star_view import SALES_SQL, sales_view
from landprice.sources.table import (
    append_rows,
    clear_year,
    create_table,
    import_status,
    integrity_report,
    integrity_sample,
    rearrange_year,
    refresh_statistics,
    table_statistics,
    table_stats,
)
from landprice.streaming.incremental import ingest_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _register(sql: str | None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[query.__name__] = query
        if sql is not None:
            ORACLE_SQL[query.__name__] = sql
        return query

    return add


def _rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    """Doubles that were summed in different orders agree only up to a rounding."""
    return df.withColumns({name: F.round(name, digits) for name in names})


# --- price report -----------------------------------------------------------------------

_VALID = (
    "valeur_fonciere > 0 AND valeur_fonciere <= 10000000 AND surface_reelle_bati > 0 "
    "AND type_local = 'Appartement'"
)
_RECENT = (
    "ORDER BY date_mutation DESC, valeur_fonciere DESC, id_mutation NULLS FIRST, "
    "numero_disposition NULLS FIRST, id_parcelle NULLS FIRST, lot1_numero NULLS FIRST"
)
_GARAGE_IDS = "(SELECT id_mutation FROM v WHERE type_local = 'Dépendance')"


def _population_sql(where: str = "", limit: int | None = REPORT_LIMIT) -> str:
    tail = "" if limit is None else f" {_RECENT} LIMIT {limit}"
    return (
        f"WITH v AS ({SALES_SQL}), s AS (SELECT *, valeur_fonciere / surface_reelle_bati "
        f"AS prix_m2 FROM v WHERE {_VALID}{where}{tail})"
    )


def _summary_sql(where: str = "", limit: int | None = REPORT_LIMIT) -> str:
    return _summary_of(_population_sql(where, limit))


def _summary_of(population: str) -> str:
    def whole(text: str, name: str) -> str:
        return f"CAST(trunc(coalesce({text}, 0)) AS BIGINT) AS {name}"

    return (
        f"{population}, "
        "b AS (SELECT quantile_cont(valeur_fonciere, 0.25) AS q1, "
        "quantile_cont(valeur_fonciere, 0.75) AS q3 FROM s), "
        "k AS (SELECT s.* FROM s, b WHERE valeur_fonciere >= q1 - 1.5 * (q3 - q1) "
        "AND valeur_fonciere <= q3 + 1.5 * (q3 - q1)) "
        "SELECT (SELECT count(*) FROM s) AS nombre_transactions, "
        "(SELECT count(*) FROM s) AS nombre_transactions_affiches, "
        f"{whole('avg(valeur_fonciere)', 'prix_moyen')}, "
        f"{whole('quantile_cont(valeur_fonciere, 0.5)', 'prix_median')}, "
        f"{whole('avg(prix_m2)', 'prix_m2_moyen')}, "
        f"{whole('quantile_cont(prix_m2, 0.5)', 'prix_m2_median')} FROM k"
    )


_TRANSACTIONS = (
    "SELECT strftime(date_mutation, '%d/%m/%Y') AS date, "
    "CAST(trunc(valeur_fonciere) AS BIGINT) AS prix, "
    "CAST(trunc(surface_reelle_bati) AS BIGINT) AS surface, "
    "CAST(trunc(prix_m2) AS BIGINT) AS prix_m2, code_postal, adresse_nom_voie AS adresse, "
    "nullif(trim(adresse_numero), '') AS numero, "
    "CASE WHEN nullif(trim(adresse_numero), '') IS NOT NULL AND adresse_nom_voie IS NOT NULL "
    "THEN concat(trim(adresse_numero), ' ', adresse_nom_voie) END AS adresse_complete, "
    "nom_commune AS commune FROM s"
)
_JSON = (
    "SELECT concat('{\"date\":\"', date, '\",\"prix\":', prix, ',\"surface\":', surface, "
    "',\"prix_m2\":', prix_m2, ',\"code_postal\":\"', code_postal, '\",\"adresse\":\"', adresse, "
    "'\"', CASE WHEN numero IS NULL THEN '' ELSE concat(',\"numero\":\"', numero, "
    "'\",\"adresse_complete\":\"', adresse_complete, '\"') END, ',\"commune\":\"', commune, '\"}') "
    "AS json FROM t"
)
_TWO_YEARS = (
    " AND date_mutation >= DATE '1996-01-01' AND date_mutation < DATE '1998-01-01'"
)


@_register(_summary_sql())
def price_report_summary(spark: SparkSession, folder: str) -> DataFrame:
    return price_report(sales_view(spark, folder), limit=REPORT_LIMIT).summary


@_register(f"{_population_sql()} {_TRANSACTIONS}")
def price_report_transactions(spark: SparkSession, folder: str) -> DataFrame:
    return price_report(sales_view(spark, folder), limit=REPORT_LIMIT).transactions


@_register(f"{_population_sql()}, t AS ({_TRANSACTIONS}) {_JSON}")
def price_report_json(spark: SparkSession, folder: str) -> DataFrame:
    return as_json(price_report(sales_view(spark, folder), limit=REPORT_LIMIT).transactions)


@_register(_summary_sql(_TWO_YEARS, 5000))
def price_report_two_years(spark: SparkSession, folder: str) -> DataFrame:
    filters = Filters(years=["1996", " 1997 ", "x"])
    return price_report(sales_view(spark, folder), filters, limit=5000).summary


@_register(_summary_sql(limit=None))
def price_report_whole_population(spark: SparkSession, folder: str) -> DataFrame:
    return price_report(sales_view(spark, folder), limit=None).summary


@_register(_summary_sql(f" AND id_mutation IN {_GARAGE_IDS}"))
def price_report_with_garage(spark: SparkSession, folder: str) -> DataFrame:
    return price_report(sales_view(spark, folder), limit=REPORT_LIMIT, garage="avec").summary


@_register(_summary_sql(f" AND id_mutation NOT IN {_GARAGE_IDS}"))
def price_report_without_garage(spark: SparkSession, folder: str) -> DataFrame:
    return price_report(sales_view(spark, folder), limit=REPORT_LIMIT, garage="sans").summary


@_register(_summary_sql(" AND id_parcelle = 'nowhere'"))
def price_report_empty(spark: SparkSession, folder: str) -> DataFrame:
    return price_report(sales_view(spark, folder), Filters(parcelles=["nowhere"])).summary


# --- filters ----------------------------------------------------------------------------

_SALE_COLUMNS = (
    "id_mutation, date_mutation, id_parcelle, valeur_fonciere, type_local, surface_reelle_bati, "
    "code_postal, adresse_nom_voie, nom_commune, adresse_numero, numero_disposition, "
    "lot1_numero, prix_m2"
)


def _filtered_sql(where: str) -> str:
    return f"{_population_sql(where, None)} SELECT {_SALE_COLUMNS} FROM s"


def _filtered(spark: SparkSession, folder: str, **filters) -> DataFrame:
    return filtered_sales(sales_view(spark, folder), Filters(**filters))


@_register(_filtered_sql(" AND EXTRACT(YEAR FROM date_mutation) IN (1996, 1999)"))
def filter_years(spark: SparkSession, folder: str) -> DataFrame:
    return _filtered(spark, folder, years=[1999, "1996 ", "19x6"])


@_register(_filtered_sql(" AND id_parcelle IN ('P000001', 'P000002', 'P000150')"))
def filter_parcels(spark: SparkSession, folder: str) -> DataFrame:
    return _filtered(spark, folder, parcelles=["P000001", " P000002", "P000150", "P'3", ""])


@_register(_filtered_sql(" AND code_postal IN ('00001', '00007')"))
def filter_postal_codes(spark: SparkSession, folder: str) -> DataFrame:
    return _filtered(spark, folder, codes_postaux=["00001", "00007 ", " "])


@_register(_filtered_sql(""))
def filter_unusable_lists(spark: SparkSession, folder: str) -> DataFrame:
    return _filtered(
        spark, folder, years=["x"], parcelles=["'"], codes_postaux=[""], min_surface="wide"
    )


@_register(_filtered_sql(" AND surface_reelle_bati >= 10.5 AND surface_reelle_bati <= 20"))
def filter_surface_range(spark: SparkSession, folder: str) -> DataFrame:
    return _filtered(spark, folder, min_surface="10.5", max_surface=20)


@_register(_filtered_sql(" AND valeur_fonciere <= 50000"))
def filter_max_price(spark: SparkSession, folder: str) -> DataFrame:
    return _filtered(spark, folder, max_price="50000")


@_register(
    f"WITH v AS ({SALES_SQL}), s AS (SELECT *, valeur_fonciere / surface_reelle_bati AS prix_m2 "
    "FROM v WHERE valeur_fonciere > 0 AND surface_reelle_bati > 0 AND type_local = 'Appartement') "
    f"SELECT {_SALE_COLUMNS} FROM s"
)
def filter_extreme_bounds(spark: SparkSession, folder: str) -> DataFrame:
    """Bounds beyond every stored value are no bounds."""
    return _filtered(
        spark, folder, min_surface="-1e40", max_surface=float("inf"), max_price=str(10**20)
    )


@_register(
    f"WITH v AS ({SALES_SQL}) SELECT id_mutation, numero_disposition, code_postal, "
    "valeur_fonciere FROM v WHERE code_postal LIKE '0001%'"
)
def filter_postal_prefix(spark: SparkSession, folder: str) -> DataFrame:
    return postal_prefix(sales_view(spark, folder), "0001").select(
        "id_mutation", "numero_disposition", "code_postal", "valeur_fonciere"
    )


@_register(
    f"WITH v AS ({SALES_SQL}), c AS (SELECT CASE WHEN code_postal LIKE '%5' "
    "THEN concat(code_postal, 'x') ELSE code_postal END AS code_postal FROM v) "
    "SELECT DISTINCT code_postal FROM c WHERE regexp_matches(code_postal, '^[0-9]{5}$')"
)
def filter_valid_postal(spark: SparkSession, folder: str) -> DataFrame:
    code = F.col("code_postal")
    some_bad = F.when(code.endswith("5"), F.concat(code, F.lit("x"))).otherwise(code)
    return valid_postal_codes(sales_view(spark, folder).withColumn("code_postal", some_bad))


@_register(
    f"WITH v AS ({SALES_SQL}) SELECT id_mutation, numero_disposition, adresse_nom_voie FROM v "
    "WHERE contains(upper(adresse_nom_voie), 'NATION_1')"
)
def filter_street(spark: SparkSession, folder: str) -> DataFrame:
    return street_search(sales_view(spark, folder), "nation_1").select(
        "id_mutation", "numero_disposition", "adresse_nom_voie"
    )


# --- analyses ---------------------------------------------------------------------------

_PRICE_M2_OR_NULL = (
    "CASE WHEN surface_reelle_bati > 0 THEN valeur_fonciere / surface_reelle_bati END"
)
_ANALYSIS = (
    "count(*) AS nombre_transactions, round(avg(valeur_fonciere), 4) AS prix_moyen, "
    "round(quantile_cont(valeur_fonciere, 0.5), 6) AS prix_median, "
    f"round(avg({_PRICE_M2_OR_NULL}), 4) AS prix_m2_moyen, "
    f"round(quantile_cont({_PRICE_M2_OR_NULL}, 0.5), 6) AS prix_m2_median"
)


def _analysis_sql(where: str) -> str:
    return f"WITH v AS ({SALES_SQL}) SELECT {_ANALYSIS} FROM v WHERE {where}"


def _rounded_analysis(df: DataFrame) -> DataFrame:
    means = _rounded(df, 4, "prix_moyen", "prix_m2_moyen")
    return _rounded(means, 6, "prix_median", "prix_m2_median")


@_register(f"WITH v AS ({SALES_SQL}) SELECT count(*) AS nombre_transactions FROM v")
def count_all_transactions(spark: SparkSession, folder: str) -> DataFrame:
    return count_transactions(sales_view(spark, folder))


@_register(_analysis_sql("TRUE"))
def analyse_all_prices(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded_analysis(analyse_prices(sales_view(spark, folder)))


@_register(
    _analysis_sql(
        "type_local = 'Maison' AND surface_reelle_bati >= 12 AND surface_reelle_bati <= 40 "
        f"AND id_mutation IN {_GARAGE_IDS}"
    )
)
def analyse_houses_with_garage(spark: SparkSession, folder: str) -> DataFrame:
    view = sales_view(spark, folder)
    return _rounded_analysis(
        analyse_prices(view, type_local="Maison", min_m2=12, max_m2=40, garage="avec")
    )


@_register(_analysis_sql(f"type_local = 'Maison' AND id_mutation NOT IN {_GARAGE_IDS}"))
def analyse_houses_without_garage(spark: SparkSession, folder: str) -> DataFrame:
    view = sales_view(spark, folder)
    return _rounded_analysis(analyse_prices(view, type_local="Maison", garage="sans"))


@_register(_analysis_sql("id_parcelle = 'nowhere'"))
def analyse_prices_empty(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded_analysis(analyse_prices(sales_view(spark, folder), ["nowhere"]))


_PARCELS = ("P000001", "P000002", "P000150", "P999999")
_PARCEL_LIST = ", ".join(f"'{parcel}'" for parcel in _PARCELS)
_PARCEL_ROWS = ", ".join(f"('{parcel}')" for parcel in _PARCELS)


@_register(
    f"WITH v AS ({SALES_SQL}), f AS (SELECT * FROM v WHERE id_parcelle IN ({_PARCEL_LIST})), "
    f"p AS (SELECT id_parcelle, {_ANALYSIS} FROM f GROUP BY id_parcelle) "
    f"SELECT 'global' AS parcelle, {_ANALYSIS} FROM f UNION ALL "
    "SELECT r.parcelle, coalesce(nombre_transactions, 0), prix_moyen, prix_median, "
    f"prix_m2_moyen, prix_m2_median FROM (VALUES {_PARCEL_ROWS}) AS r(parcelle) "
    "LEFT JOIN p ON p.id_parcelle = r.parcelle"
)
def analyse_parcels(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded_analysis(analyse_by_parcel(sales_view(spark, folder), list(_PARCELS)))


@_register(
    f"WITH v AS ({SALES_SQL}) SELECT id_parcelle AS parcelle, {_ANALYSIS} FROM v "
    "WHERE id_parcelle IS NOT NULL GROUP BY id_parcelle"
)
def analyse_all_parcels(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded_analysis(analyse_every_parcel(sales_view(spark, folder)))


@_register(
    f"WITH v AS ({SALES_SQL}) SELECT type_local, round(avg(valeur_fonciere), 4) AS prix_moyen "
    "FROM v GROUP BY type_local"
)
def mean_price_by_property_type(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(mean_price_by_type(sales_view(spark, folder)), 4, "prix_moyen")


@_register(
    f"WITH v AS ({SALES_SQL}) SELECT round(avg(valeur_fonciere / nullif(surface_reelle_bati, 0))"
    ", 4) AS prix_m2_moyen FROM v WHERE type_local = 'Appartement' AND code_postal LIKE '0001%'"
)
def mean_price_m2_prefix(spark: SparkSession, folder: str) -> DataFrame:
    view = sales_view(spark, folder)
    return _rounded(mean_price_m2(view, prefix="0001"), 4, "prix_m2_moyen")


# --- trends -----------------------------------------------------------------------------

_DAILY = (
    "SELECT date, CAST(floor(CAST(sum(prix) AS DOUBLE) / count(*) + 0.5) AS BIGINT) "
    "AS prix, CAST(floor(CAST(sum(prix_m2) AS DOUBLE) / count(*) + 0.5) AS BIGINT) AS prix_m2 "
    "FROM t GROUP BY date"
)
_BANDS = (
    "b AS (SELECT CAST(floor(surface / 10.0) * 10 AS BIGINT) AS lo FROM t) "
    "SELECT concat(CAST(lo AS VARCHAR), '-', CAST(lo + 9 AS VARCHAR), 'm²') AS range, "
    "count(*) AS count FROM b GROUP BY lo"
)


def _trends_sql(limit: int | None) -> str:
    return f"{_population_sql('', limit)}, t AS ({_TRANSACTIONS})"


def _reported(spark: SparkSession, folder: str, limit: int | None) -> DataFrame:
    return price_report(sales_view(spark, folder), limit=limit).transactions


@_register(f"{_trends_sql(REPORT_LIMIT)} {_DAILY}")
def daily_price_series(spark: SparkSession, folder: str) -> DataFrame:
    return daily_prices(_reported(spark, folder, REPORT_LIMIT))


@_register(f"{_trends_sql(None)} {_DAILY}")
def daily_price_series_all(spark: SparkSession, folder: str) -> DataFrame:
    return daily_prices(_reported(spark, folder, None))


@_register(f"{_trends_sql(REPORT_LIMIT)}, {_BANDS}")
def surface_bands(spark: SparkSession, folder: str) -> DataFrame:
    return surface_histogram(_reported(spark, folder, REPORT_LIMIT))


@_register(f"{_trends_sql(None)}, {_BANDS}")
def surface_bands_all(spark: SparkSession, folder: str) -> DataFrame:
    return surface_histogram(_reported(spark, folder, None))


@_register(
    f"{_trends_sql(REPORT_LIMIT)} SELECT CAST(floor(CAST(sum(surface) AS DOUBLE) / count(*) + 0.5) "
    "AS BIGINT) AS surface_moyenne FROM t"
)
def rounded_mean_surface(spark: SparkSession, folder: str) -> DataFrame:
    return mean_surface(_reported(spark, folder, REPORT_LIMIT))


@_register(
    f"{_trends_sql(None)} SELECT CAST(floor(CAST(sum(surface) AS DOUBLE) / count(*) + 0.5) "
    "AS BIGINT) AS surface_moyenne FROM t"
)
def rounded_mean_surface_all(spark: SparkSession, folder: str) -> DataFrame:
    return mean_surface(_reported(spark, folder, None))


# --- outliers ---------------------------------------------------------------------------

_OUTLIERS = (
    ", b AS (SELECT quantile_cont(valeur_fonciere, 0.1) AS d1, "
    "quantile_cont(valeur_fonciere, 0.25) AS q1, quantile_cont(valeur_fonciere, 0.75) AS q3, "
    "quantile_cont(valeur_fonciere, 0.9) AS d9 FROM s), "
    "e AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM b), "
    "x AS (SELECT s.*, valeur_fonciere >= lo AND valeur_fonciere <= hi AS inside FROM s, e)"
)


def _outlier_statistics_sql(limit: int | None) -> str:
    return (
        f"{_population_sql('', limit)}{_OUTLIERS} SELECT count(*) AS total, "
        "count(*) FILTER (WHERE inside) AS kept, count(*) FILTER (WHERE NOT inside) AS outliers, "
        "min(valeur_fonciere) AS min_before, max(valeur_fonciere) AS max_before, "
        "min(valeur_fonciere) FILTER (WHERE inside) AS min_after, "
        "max(valeur_fonciere) FILTER (WHERE inside) AS max_after, "
        "round((SELECT d1 FROM e), 6) AS decile_low, round((SELECT q1 FROM e), 6) AS q1, "
        "round((SELECT q3 FROM e), 6) AS q3, round((SELECT d9 FROM e), 6) AS decile_high, "
        "round((SELECT lo FROM e), 6) AS lower_bound, "
        "round((SELECT hi FROM e), 6) AS upper_bound FROM x"
    )


def _rounded_bounds(df: DataFrame) -> DataFrame:
    return _rounded(
        df, 6, "decile_low", "q1", "q3", "decile_high", "lower_bound", "upper_bound"
    )


@_register(_outlier_statistics_sql(REPORT_LIMIT))
def outlier_bounds(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded_bounds(outlier_report(sales_view(spark, folder), limit=REPORT_LIMIT).statistics)


@_register(_outlier_statistics_sql(None))
def outlier_bounds_whole_population(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded_bounds(outlier_report(sales_view(spark, folder), limit=None).statistics)


@_register(f"{_population_sql()}{_OUTLIERS} SELECT {_SALE_COLUMNS} FROM x WHERE NOT inside")
def outliers(spark: SparkSession, folder: str) -> DataFrame:
    return outlier_report(sales_view(spark, folder), limit=REPORT_LIMIT).outliers


@_register(
    f"{_population_sql('', None)}{_OUTLIERS} SELECT {_SALE_COLUMNS} FROM x WHERE NOT inside"
)
def outliers_all(spark: SparkSession, folder: str) -> DataFrame:
    return outlier_report(sales_view(spark, folder)).outliers


@_register(
    f"{_population_sql()}{_OUTLIERS} SELECT {_SALE_COLUMNS} FROM x WHERE NOT inside ORDER BY "
    "md5(concat_ws('|', '7', id_mutation, numero_disposition, id_parcelle, "
    "coalesce(lot1_numero, ''), CAST(date_mutation AS VARCHAR), code_postal)) LIMIT 5"
)
def outlier_sample(spark: SparkSession, folder: str) -> DataFrame:
    return outlier_report(sales_view(spark, folder), limit=REPORT_LIMIT, seed=7).sample


@_register(
    f"{_population_sql('', None)}{_OUTLIERS} SELECT {_SALE_COLUMNS} FROM x WHERE NOT inside ORDER BY "
    "md5(concat_ws('|', '7', id_mutation, numero_disposition, id_parcelle, "
    "coalesce(lot1_numero, ''), CAST(date_mutation AS VARCHAR), code_postal)) LIMIT 5"
)
def outlier_sample_all(spark: SparkSession, folder: str) -> DataFrame:
    return outlier_report(sales_view(spark, folder), limit=None, seed=7).sample


# --- cleaning and key handling ----------------------------------------------------------

# Register text made from the sales view, with every kind of bad cell planted.
_RAW_EXPRESSIONS = {
    "id_mutation": (
        "CASE WHEN n % 101 = 0 THEN '' WHEN n % 103 = 0 THEN 'NULL' WHEN n % 107 = 0 "
        "THEN 'null' ELSE id_mutation END"
    ),
    "date_mutation": (
        "CASE WHEN n % 61 = 0 THEN '2024-02-30' WHEN n % 67 = 0 THEN '02/01/2024' "
        "WHEN n % 71 = 0 THEN 'NaN' ELSE CAST(date_mutation AS STRING) END"
    ),
    "numero_disposition": "numero_disposition",
    "valeur_fonciere": (
        "CASE WHEN n % 11 = 0 THEN 'abc' WHEN n % 13 = 0 THEN '-1' WHEN n % 17 = 0 "
        "THEN '100000001' WHEN n % 19 = 0 THEN '1e3' WHEN n % 23 = 0 THEN 'nan' "
        "WHEN n % 29 = 0 THEN '100000000' ELSE CAST(CAST(valeur_fonciere AS DECIMAL(12,2)) "
        "AS STRING) END"
    ),
    "surface_reelle_bati": (
        "CASE WHEN n % 31 = 0 THEN '10000001' WHEN n % 37 = 0 THEN '2.005' "
        "ELSE CAST(CAST(surface_reelle_bati AS DECIMAL(12,2)) AS STRING) END"
    ),
    "code_postal": (
        "CASE WHEN n % 83 = 0 THEN concat(code_postal, '9') WHEN n % 89 = 0 THEN 'NULL' "
        "ELSE code_postal END"
    ),
    "longitude": (
        "CASE WHEN n % 41 = 0 THEN '12345.5' WHEN n % 59 = 0 THEN '1e30' WHEN n % 43 = 0 "
        "THEN 'east' ELSE '5.5309524' END"
    ),
    "id_parcelle": "id_parcelle",
    "type_local": "CASE WHEN n % 47 = 0 THEN 'Nan' ELSE type_local END",
}
_RAW_SQL = (
    f"WITH v AS ({SALES_SQL}), "
    "w AS (SELECT *, CAST(id_mutation AS BIGINT) * 7 + CAST(numero_disposition AS BIGINT) AS n "
    "FROM v), r AS (SELECT "
    + ", ".join(f"{text} AS {name}" for name, text in _RAW_EXPRESSIONS.items())
    + " FROM w), t AS (SELECT "
    + ", ".join(
        f"CASE WHEN {name} IN ('', 'NaN', 'nan', 'NULL') THEN NULL ELSE {name} END AS {name}"
        for name in _RAW_EXPRESSIONS
    )
    + " FROM r), d AS (SELECT *, TRY_CAST(date_mutation AS DATE) AS day, "
    "TRY_CAST(valeur_fonciere AS DECIMAL(28,10)) AS price, "
    "TRY_CAST(surface_reelle_bati AS DECIMAL(28,10)) AS surface, "
    "TRY_CAST(longitude AS DOUBLE) AS east FROM t), o AS (SELECT *, "
    "CASE WHEN id_mutation IS NULL OR day IS NULL THEN 'essential' "
    "WHEN length(code_postal) > 5 THEN 'storage:code_postal' "
    "WHEN abs(east) >= 10000 THEN 'storage:longitude' ELSE 'accepted' END AS outcome FROM d)"
)


def _raw_register(spark: SparkSession, folder: str) -> DataFrame:
    number = F.col("id_mutation").cast("bigint") * 7 + F.col("numero_disposition").cast("bigint")
    numbered = sales_view(spark, folder).withColumn("n", number)
    nothing = F.lit(None).cast("string")
    return numbered.select(
        *[
            (F.expr(_RAW_EXPRESSIONS[name]) if name in _RAW_EXPRESSIONS else nothing).alias(name)
            for name in DATA_SCHEMA.names
        ]
    )


@_register(
    f"{_RAW_SQL} SELECT id_mutation, day AS date_mutation, numero_disposition, id_parcelle, "
    "type_local, code_postal, CAST(CAST(CASE WHEN price BETWEEN 0 AND 100000000 THEN price END "
    "AS DECIMAL(12,2)) AS DOUBLE) AS valeur_fonciere, CAST(CAST(CASE WHEN surface BETWEEN 0 AND "
    "10000000 THEN surface END AS DECIMAL(12,2)) AS DOUBLE) AS surface_reelle_bati, "
    "CAST(CAST(east AS DECIMAL(10,6)) AS DOUBLE) AS longitude FROM o WHERE outcome = 'accepted'"
)
def clean_transactions(spark: SparkSession, folder: str) -> DataFrame:
    rows = accepted(clean_records(_raw_register(spark, folder)))
    numbers = ("valeur_fonciere", "surface_reelle_bati", "longitude")
    return rows.select(
        "id_mutation",
        "date_mutation",
        "numero_disposition",
        "id_parcelle",
        "type_local",
        "code_postal",
        *[F.col(name).cast("double").alias(name) for name in numbers],
    )


@_register(f"{_RAW_SQL} SELECT outcome, count(*) AS rows FROM o GROUP BY outcome")
def clean_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    return reject_report(clean_records(_raw_register(spark, folder)))


_COARSE_KEY = ("id_mutation", "type_local", "lot1_numero")
_COARSE_ORDER = ("date_mutation", "valeur_fonciere", "id_parcelle", "code_postal")
_KEPT_COLUMNS = (
    "id_mutation, type_local, lot1_numero, date_mutation, valeur_fonciere, id_parcelle, "
    "code_postal, numero_disposition"
)
_COARSE_RANK = (
    f"row_number() OVER (PARTITION BY {', '.join(_COARSE_KEY)} "
    f"ORDER BY {', '.join(_COARSE_ORDER)})"
)


@_register(
    f"WITH v AS ({SALES_SQL}), k AS (SELECT *, {_COARSE_RANK} AS rn FROM v) "
    f"SELECT {_KEPT_COLUMNS} FROM k WHERE rn = 1 OR lot1_numero IS NULL"
)
def dedup_first(spark: SparkSession, folder: str) -> DataFrame:
    order = [F.col(name) for name in _COARSE_ORDER]
    kept = keep_first(sales_view(spark, folder), order, _COARSE_KEY)
    return kept.select(*_KEPT_COLUMNS.split(", "))


@_register(
    f"WITH v AS ({SALES_SQL}) SELECT {_KEPT_COLUMNS} FROM v WHERE import_year = 1999 AND NOT "
    "EXISTS (SELECT 1 FROM v AS e WHERE e.import_year <> 1999 AND e.id_mutation = v.id_mutation "
    "AND e.type_local = v.type_local AND e.lot1_numero = v.lot1_numero)"
)
def insert_absent(spark: SparkSession, folder: str) -> DataFrame:
    view = sales_view(spark, folder)
    fresh = insert_if_absent(
        view.filter("import_year = 1999"), view.filter("import_year <> 1999"), _COARSE_KEY
    )
    return fresh.select(*_KEPT_COLUMNS.split(", "))


# --- approximate quantiles ---------------------------------------------------------------

_SKETCHED = (0.1, 0.25, 0.5, 0.75, 0.9)


@_register(
    f"WITH v AS ({SALES_SQL}), s AS (SELECT type_local, count(*) AS rows, "
    "count(valeur_fonciere) AS n, min(valeur_fonciere) AS low, max(valeur_fonciere) AS high, "
    "round(avg(valeur_fonciere), 4) AS mean FROM v GROUP BY type_local) "
    "SELECT s.*, CAST(p AS DOUBLE) AS probability, true AS within_error "
    f"FROM s, (VALUES {', '.join(f'({p})' for p in _SKETCHED)}) AS x(p)"
)
def approximate_quantiles(spark: SparkSession, folder: str) -> DataFrame:
    """Sketches of every (year, type, postal code), kept as a table and merged by type; the rank of
    each answer among all prices is counted exactly."""
    view = sales_view(spark, folder)
    cells = sketched(view, {"price": price()}, ("import_year", "type_local", "code_postal"))
    kept = materialised(cells, "sketches")
    by_type = merged(kept, ["price"], ["type_local"])
    found = approximate_distribution(by_type, ["price"], _SKETCHED, ["type_local"])
    found = materialised(found.select("type_local", "rows", "price.*"), "sketches")
    values = view.select("type_local", price().alias("v"))
    ranks = values.join(found.select("type_local", "q"), "type_local").groupBy("type_local").agg(
        F.array(*[F.count_if(F.col("v") < F.col("q")[i]) for i in range(len(_SKETCHED))]).alias("below"),
        F.array(*[F.count_if(F.col("v") <= F.col("q")[i]) for i in range(len(_SKETCHED))]).alias("upto"),
    )
    wanted = F.array(*[F.lit(p) for p in _SKETCHED])
    each = found.join(ranks, "type_local").select(
        "type_local", "rows", "n", "low", "high", F.round("mean", 4).alias("mean"),
        F.inline(F.arrays_zip(wanted.alias("probability"), F.col("below"), F.col("upto"))),
    )
    room = F.lit(RANK_ERROR) * F.col("n")
    rank = F.col("probability") * F.col("n")
    within = (F.col("below") <= rank + room) & (F.col("upto") >= rank - room)
    return each.withColumn("within_error", within).drop("below", "upto")


# --- table reports ----------------------------------------------------------------------

@_register(
    f"WITH v AS ({SALES_SQL}) SELECT import_year, count(*) AS record_count, "
    "min(date_mutation) AS first_import, max(date_mutation) AS last_import "
    "FROM v GROUP BY import_year"
)
def import_status_by_year(spark: SparkSession, folder: str) -> DataFrame:
    dated = sales_view(spark, folder).withColumn("import_date", F.col("date_mutation"))
    return import_status(dated)


@_register(
    f"WITH v AS ({SALES_SQL}) SELECT count(*) AS total_records, "
    "count(DISTINCT import_year) AS years_imported, min(date_mutation) AS earliest_date, "
    "max(date_mutation) AS latest_date, "
    "count(*) FILTER (WHERE type_local = 'Appartement') AS apartments, "
    "count(*) FILTER (WHERE type_local = 'Maison') AS houses FROM v"
)
def table_stats_report(spark: SparkSession, folder: str) -> DataFrame:
    return table_statistics(sales_view(spark, folder))


@_register(
    f"WITH v AS ({SALES_SQL}) SELECT count(*) AS record_count, count(*) FILTER (WHERE "
    "surface_reelle_bati > 0 AND valeur_fonciere / nullif(surface_reelle_bati, 0) IS NOT NULL) "
    "AS with_prix_m2, count(*) > 0 AS ok FROM v WHERE import_year = 1998"
)
def integrity_check(spark: SparkSession, folder: str) -> DataFrame:
    return integrity_report(sales_view(spark, folder), 1998)


@_register(
    f"WITH v AS ({SALES_SQL}) SELECT id_mutation, date_mutation, valeur_fonciere, type_local, "
    "surface_reelle_bati, valeur_fonciere / nullif(surface_reelle_bati, 0) AS prix_m2 FROM v "
    "WHERE import_year = 1998 ORDER BY id_mutation, numero_disposition, id_parcelle, "
    "lot1_numero NULLS FIRST LIMIT 5"
)
def integrity_rows(spark: SparkSession, folder: str) -> DataFrame:
    return integrity_sample(sales_view(spark, folder), 1998)


# --- ingest -----------------------------------------------------------------------------

_landed: dict[tuple[str, str], str] = {}
_FILE_ORDER = (
    "import_year",
    "date_mutation",
    "valeur_fonciere",
    "id_mutation",
    "numero_disposition",
    "id_parcelle",
    "lot1_numero",
    "code_postal",
)
_STORED = (
    "id_mutation",
    "date_mutation",
    "numero_disposition",
    "id_parcelle",
    "lot1_numero",
    "code_postal",
    "type_local",
    "import_year",
)
_FILE_RANK = (
    "row_number() OVER (PARTITION BY id_mutation, numero_disposition, id_parcelle, lot1_numero "
    f"ORDER BY {', '.join(_FILE_ORDER)})"
)
_LOADED_SQL = (
    f"WITH v AS ({SALES_SQL}), ranked AS (SELECT *, {_FILE_RANK} AS rn FROM v), "
    "l AS (SELECT * FROM ranked WHERE rn = 1 OR lot1_numero IS NULL)"
)


def landed_files(spark: SparkSession, folder: str) -> str:
    """The sales as gzipped register files, one folder of ordered files per year."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _landed:
        path = scratch_path(spark, "landed")
        with freed_shuffles(spark):
            (
                sales_view(spark, folder)
                .orderBy(*_FILE_ORDER)
                .write.partitionBy("import_year")
                .option("escape", '"')
                .csv(path, header=True, compression="gzip")
            )
        _landed[key] = path
    return _landed[key]


_databases: dict[tuple[str, str], str] = {}
_imported: dict[tuple[str, str], str] = {}


def new_table(spark: SparkSession, purpose: str) -> str:
    """A table name in a database of its own; the one of an earlier run of the query goes."""
    key = (spark.sparkContext.applicationId, purpose)
    if key in _databases:
        spark.sql(f"DROP DATABASE IF EXISTS {_databases[key]} CASCADE")
    _databases[key] = database = f"landprice_{purpose}_{uuid.uuid4().hex[:12]}"
    spark.sql(f"CREATE DATABASE {database} LOCATION '{scratch_path(spark, 'tables')}'")
    return f"{database}.sales"


def _import(spark: SparkSession, folder: str, name: str, start: int, end: int):
    template = landed_files(spark, folder) + "/import_year={year}"
    return import_years(spark, name, template, start, end, file_name="")


def imported_table(spark: SparkSession, folder: str) -> str:
    """The register table with all landed years, loaded once in a session."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _imported:
        name = new_table(spark, f"register_{len(_imported)}")
        _import(spark, folder, name, 1995, 2001)
        refresh_statistics(spark, name)
        _imported[key] = name
    return _imported[key]


@_register(
    f"{_LOADED_SQL} SELECT {', '.join(_STORED)}, "
    "CAST(CAST(valeur_fonciere AS DECIMAL(12,2)) AS DOUBLE) AS valeur_fonciere, "
    "CAST(CAST(surface_reelle_bati AS DECIMAL(12,2)) AS DOUBLE) AS surface_reelle_bati FROM l"
)
def ingest_csv(spark: SparkSession, folder: str) -> DataFrame:
    numbers = ("valeur_fonciere", "surface_reelle_bati")
    return spark.table(imported_table(spark, folder)).select(
        *_STORED, *[F.col(column).cast("double").alias(column) for column in numbers]
    )


_STORED_POPULATION = (
    f"{_LOADED_SQL}, d AS (SELECT * REPLACE (CAST(CAST(valeur_fonciere AS DECIMAL(12,2)) AS DOUBLE) "
    "AS valeur_fonciere, CAST(CAST(surface_reelle_bati AS DECIMAL(12,2)) AS DOUBLE) "
    "AS surface_reelle_bati) FROM l)"
)


@_register(
    _summary_of(
        f"{_STORED_POPULATION}, s AS (SELECT *, valeur_fonciere / surface_reelle_bati AS prix_m2 "
        f"FROM d WHERE {_VALID}{_TWO_YEARS} {_RECENT} LIMIT {REPORT_LIMIT})"
    )
)
def register_price_report(spark: SparkSession, folder: str) -> DataFrame:
    sales = spark.table(imported_table(spark, folder))
    return price_report(sales, Filters(years=[1996, 1997]), limit=REPORT_LIMIT).summary


@_register(
    _summary_of(
        f"{_STORED_POPULATION}, s AS (SELECT *, valeur_fonciere / surface_reelle_bati AS prix_m2 "
        f"FROM d WHERE {_VALID})"
    )
)
def register_whole_population(spark: SparkSession, folder: str) -> DataFrame:
    name = imported_table(spark, folder)
    refresh(spark, name, PRICE_CELLS)
    return whole_population_summary(spark, name)


@_register(
    _summary_of(
        f"{_STORED_POPULATION}, s AS (SELECT *, valeur_fonciere / surface_reelle_bati AS prix_m2 "
        f"FROM d WHERE {_VALID.replace('Appartement', 'Maison')}{_TWO_YEARS} "
        "AND code_postal IN ('00010', '00020', '00077'))"
    )
)
def register_population_of_places(spark: SparkSession, folder: str) -> DataFrame:
    name = imported_table(spark, folder)
    refresh(spark, name, PRICE_CELLS)
    places = ["00010", "00020", "00077"]
    filters = Filters(type_local="Maison", years=[1996, 1997], codes_postaux=places)
    return whole_population_summary(spark, name, filters)


@_register(
    _summary_of(
        f"{_STORED_POPULATION}, s AS (SELECT *, valeur_fonciere / surface_reelle_bati AS prix_m2 "
        f"FROM d WHERE {_VALID} AND id_mutation IN "
        f"(SELECT id_mutation FROM d WHERE type_local = 'Dépendance') {_RECENT} LIMIT {REPORT_LIMIT})"
    )
)
def register_report_with_garage(spark: SparkSession, folder: str) -> DataFrame:
    name = imported_table(spark, folder)
    refresh(spark, name, OUTBUILDINGS)
    return garage_report(spark, name, "avec", limit=REPORT_LIMIT).summary


@_register(
    _summary_of(
        f"{_STORED_POPULATION}, s AS (SELECT *, valeur_fonciere / surface_reelle_bati AS prix_m2 "
        f"FROM d WHERE {_VALID} AND id_mutation NOT IN "
        f"(SELECT id_mutation FROM d WHERE type_local = 'Dépendance') {_RECENT} LIMIT {REPORT_LIMIT})"
    )
)
def register_report_without_garage(spark: SparkSession, folder: str) -> DataFrame:
    name = imported_table(spark, folder)
    refresh(spark, name, OUTBUILDINGS)
    return garage_report(spark, name, "sans", limit=REPORT_LIMIT).summary


_STREET_COLUMNS = "id_mutation, numero_disposition, code_postal, adresse_nom_voie"


@_register(
    f"{_LOADED_SQL} SELECT {_STREET_COLUMNS} FROM l WHERE contains(upper(adresse_nom_voie), 'TION_1')"
)
def register_street_search(spark: SparkSession, folder: str) -> DataFrame:
    name = imported_table(spark, folder)
    refresh(spark, name, STREETS)
    return sales_in_streets(spark, name, "tion_1").select(*_STREET_COLUMNS.split(", "))


@_register(
    f"{_LOADED_SQL} SELECT {_STREET_COLUMNS} FROM l WHERE contains(upper(adresse_nom_voie), '_7')"
)
def register_street_search_short(spark: SparkSession, folder: str) -> DataFrame:
    name = imported_table(spark, folder)
    refresh(spark, name, STREETS)
    return sales_in_streets(spark, name, "_7").select(*_STREET_COLUMNS.split(", "))


@_register(
    f"{_STORED_POPULATION}, f AS (SELECT * FROM d WHERE id_parcelle IN ({_PARCEL_LIST})), "
    f"p AS (SELECT id_parcelle, {_ANALYSIS} FROM f GROUP BY id_parcelle) "
    f"SELECT 'global' AS parcelle, {_ANALYSIS} FROM f UNION ALL "
    "SELECT r.parcelle, coalesce(nombre_transactions, 0), prix_moyen, prix_median, "
    f"prix_m2_moyen, prix_m2_median FROM (VALUES {_PARCEL_ROWS}) AS r(parcelle) "
    "LEFT JOIN p ON p.id_parcelle = r.parcelle"
)
def register_by_parcel(spark: SparkSession, folder: str) -> DataFrame:
    sales = spark.table(imported_table(spark, folder))
    return _rounded_analysis(analyse_by_parcel(sales, list(_PARCELS)))


@_register(
    f"{_LOADED_SQL} SELECT count(*) AS total_records, count(DISTINCT import_year) AS years_imported, "
    "min(date_mutation) AS earliest_date, max(date_mutation) AS latest_date, "
    "count(*) FILTER (WHERE type_local = 'Appartement') AS apartments, "
    "count(*) FILTER (WHERE type_local = 'Maison') AS houses, true AS has_size FROM l"
)
def register_table_stats(spark: SparkSession, folder: str) -> DataFrame:
    stats = table_stats(spark, imported_table(spark, folder))
    return stats.withColumn("has_size", F.col("table_bytes") > 0).drop("table_bytes")


@_register(
    f"{_LOADED_SQL} SELECT import_year, count(*) AS record_count, true AS dated FROM l "
    "GROUP BY import_year"
)
def register_import_dates(spark: SparkSession, folder: str) -> DataFrame:
    status = import_status(spark.table(imported_table(spark, folder)))
    dated = (F.col("first_import") <= F.col("last_import")) & (
        F.col("last_import") <= F.current_timestamp()
    )
    return status.select("import_year", "record_count", F.coalesce(dated, F.lit(False)).alias("dated"))


@_register(
    f"{_LOADED_SQL} SELECT CAST(2005 AS SMALLINT) AS import_year, type_local, count(*) AS rows "
    "FROM l GROUP BY type_local"
)
def register_single_file(spark: SparkSession, folder: str) -> DataFrame:
    """One uncompressed delivery under one import year."""
    path = scratch_path(spark, "single")
    rows = sales_view(spark, folder).orderBy(*_FILE_ORDER).drop("import_year")
    rows.write.option("escape", '"').csv(path, header=True)
    name = new_table(spark, "single")
    import_files(spark, name, 2005, [path])
    discard(spark, path)
    return spark.table(name).groupBy("import_year", "type_local").agg(F.count(F.lit(1)).alias("rows"))


@_register(
    f"{_LOADED_SQL} SELECT id_mutation, numero_disposition, id_parcelle, lot1_numero, code_postal, "
    "nom_commune, count(*) AS rows FROM l GROUP BY ALL"
)
def ingest_mixed_headers(spark: SparkSession, folder: str) -> DataFrame:
    """One group of files with a plain, a quoted and a reordered header."""
    view = sales_view(spark, folder).orderBy(*_FILE_ORDER).drop("import_year")
    group = scratch_path(spark, "mixed")
    number = F.col("id_mutation").cast("bigint") % 3
    moved = ["nom_commune", *sorted(set(view.columns) - {"nom_commune"}, reverse=True)]
    for part, (columns, quoted) in enumerate(
        ((view.columns, False), (view.columns, True), (moved, False))
    ):
        rows = view.filter(number == part).select(*columns)
        writer = rows.write.option("escape", '"').option("quoteAll", quoted).option("nullValue", "")
        writer.option("emptyValue", "").csv(f"{group}/{part}", header=True, compression="gzip")
    name = new_table(spark, "mixed")
    import_files(spark, name, 2000, [f"{group}/{part}" for part in range(3)])
    discard(spark, group)
    shown = ("id_mutation", "numero_disposition", "id_parcelle", "lot1_numero", "code_postal", "nom_commune")
    return spark.table(name).groupBy(*shown).agg(F.count(F.lit(1)).alias("rows"))


# Each kind of bad line, by the remainder that plants it, and its outcome.
_BAD_LINES = (
    (11, "concat(id, ',', day)", "'fields'"),
    (13, "concat(id, ',', day, ',', code, ',5.5,more')", "'fields'"),
    (17, "concat(id, ',', day, ',', CAST(unhex('C328') AS STRING), ',5.5')", "'encoding'"),
    (19, "'  '", "NULL"),
    (23, "concat(id, ',2024-02-30,', code, ',5.5')", "'essential'"),
    (29, "concat(id, ',', day, ',', code, '9,5.5')", "'storage:code_postal'"),
    (31, "concat(id, ',', day, ',', code, ',12345.5')", "'storage:longitude'"),
    (37, "concat(id, ',', day, ',', code, ',1e30')", "'storage:longitude'"),
)

_LINES_PER_FILE = 1 << 18


def _by_remainder(choices: tuple, otherwise: str) -> str:
    cases = " ".join(f"WHEN n % {number} = 0 THEN {text}" for number, text in choices)
    return f"CASE {cases} ELSE {otherwise} END"


@_register(
    f"WITH v AS ({SALES_SQL}), w AS (SELECT CAST(id_mutation AS BIGINT) * 7 + "
    "CAST(numero_disposition AS BIGINT) AS n FROM v), o AS (SELECT "
    + _by_remainder(tuple((n, outcome) for n, _, outcome in _BAD_LINES), "'accepted'")
    + " AS outcome FROM w) SELECT outcome, count(*) AS rows FROM o WHERE outcome IS NOT NULL GROUP BY outcome"
)
def ingest_rejects(spark: SparkSession, folder: str) -> DataFrame:
    """Outcomes of landed lines, bad ones of every kind among them."""
    view = sales_view(spark, folder).select(
        F.col("id_mutation").alias("id"), F.col("date_mutation").cast("string").alias("day"),
        F.col("code_postal").alias("code"),
        (F.col("id_mutation").cast("bigint") * 7 + F.col("numero_disposition").cast("bigint")).alias("n"),
    )
    good = "concat(id, ',', day, ',', code, ',5.5309524')"
    text = _by_remainder(tuple((n, line) for n, line, _ in _BAD_LINES), good)
    # One task sorts the lines of a file, so their number is bounded, not that of the files.
    parts = max(8, -(-view.count() // _LINES_PER_FILE))
    part = F.pmod(F.xxhash64("id", "n"), F.lit(parts)).alias("part")
    lines = view.select(part, F.lit(1).alias("place"), F.expr(text).alias("value"))
    header = spark.range(parts).select(
        F.col("id").alias("part"), F.lit(0).alias("place"),
        F.lit("id_mutation,date_mutation,code_postal,longitude").alias("value"),
    )
    path = scratch_path(spark, "lines")
    ordered = header.union(lines).repartition(parts, "part").sortWithinPartitions("part", "place")
    ordered.select("part", "value").write.partitionBy("part").text(path)
    return reject_report(read_register(spark, [path]))


@_register(
    f"{_LOADED_SQL} SELECT CAST(import_year AS INTEGER) AS year, CASE WHEN import_year = 1996 "
    "THEN 'already_imported' ELSE 'success' END AS status, count(*) AS records FROM l "
    "GROUP BY import_year UNION ALL SELECT 1991, 'failed', NULL"
)
def skip_imported_year(spark: SparkSession, folder: str) -> DataFrame:
    name = new_table(spark, "skip")
    _import(spark, folder, name, 1996, 1996)
    years = _import(spark, folder, name, 1991, 2001).years
    return years.filter("year = 1991 OR records IS NOT NULL").select("year", "status", "records")


@_register(
    f"{_LOADED_SQL} SELECT {', '.join(_STORED)}, "
    "CAST(CAST(valeur_fonciere AS DECIMAL(12,2)) AS DOUBLE) AS valeur_fonciere, "
    "CAST(CAST(surface_reelle_bati AS DECIMAL(12,2)) AS DOUBLE) AS surface_reelle_bati "
    "FROM l WHERE import_year = 1997"
)
def rearranged_rows(spark: SparkSession, folder: str) -> DataFrame:
    """A year that came in two loads, rewritten as one along the curve: the same rows."""
    year = spark.table(imported_table(spark, folder)).filter("import_year = 1997")
    name = new_table(spark, "rearranged")
    create_table(spark, name)
    for half in ("code_postal < '00050'", "NOT coalesce(code_postal < '00050', false)"):
        append_rows(year.filter(half), name)
    rearrange_year(spark, name, 1997)
    numbers = ("valeur_fonciere", "surface_reelle_bati")
    return spark.table(name).select(
        *_STORED, *[F.col(column).cast("double").alias(column) for column in numbers]
    )


@_register(
    f"{_LOADED_SQL} SELECT import_year, count(*) AS record_count FROM l "
    "WHERE import_year <> 1996 GROUP BY import_year"
)
def clear_imported_year(spark: SparkSession, folder: str) -> DataFrame:
    name = new_table(spark, "clear")
    _import(spark, folder, name, 1995, 2001)
    rearrange_year(spark, name, 1995)
    clear_year(spark, name, 1996)
    return import_status(spark.table(name)).select("import_year", "record_count")


@_register(
    f"{_LOADED_SQL} SELECT id_mutation, numero_disposition, id_parcelle, lot1_numero, "
    "count(*) AS rows FROM l GROUP BY id_mutation, numero_disposition, id_parcelle, lot1_numero"
)
def stream_ingest(spark: SparkSession, folder: str) -> DataFrame:
    name = new_table(spark, "stream")
    create_table(spark, name)
    landing = landed_files(spark, folder)
    # A second start on the same checkpoint finds every file taken and adds nothing.
    checkpoint = scratch_path(spark, "stream")
    for _ in range(2):
        ingest_stream(spark, landing, name, checkpoint).awaitTermination()
    key = ("id_mutation", "numero_disposition", "id_parcelle", "lot1_numero")
    return spark.table(name).groupBy(*key).agg(F.count(F.lit(1)).alias("rows"))
