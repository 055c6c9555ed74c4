from __future__ import annotations

import time
import uuid
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from landprice.plans import imports
from landprice.plans.imports import import_files, import_years, stage_and_count
from landprice.plans.price_report import price_report
from landprice.operators import layout
from landprice.schema import KEY, LOAD, TABLE_SCHEMA
from landprice.sources import loads, register_csv
from landprice.sources import table as tables
from landprice.streaming import incremental
from landprice.streaming.incremental import ingest_stream
from tests.samples import COLUMNS, line, record, write_file

# Shaped like a real delivery: equal keys within one lot, and lots that are mostly absent.
LOT = {"id_mutation": "2024-4", "id_parcelle": "AI0551", "lot1_numero": "175"}
DELIVERY = [
    line(id_mutation="2024-1"),
    line(id_mutation="2024-4", id_parcelle="AI0551", lot1_numero="50", type_local="Dépendance"),
    line(**LOT, type_local="Dépendance"),
    line(**LOT, type_local="Dépendance"),
    line(**LOT, type_local="Appartement", surface_reelle_bati="89"),
    line(id_mutation="2024-5"),
    line(id_mutation="2024-5"),
    "broken,line",
    line(id_mutation=""),
]


def year_file(folder, year, lines):
    return write_file(folder / str(year) / "full.csv.gz", lines)


def statuses(result):
    return {r.year: (r.status, r.records, r.inserted) for r in result.years.collect()}


def test_delivery_keeps_the_first_row_of_a_key(spark, table, tmp_path):
    year_file(tmp_path, 2024, DELIVERY)
    result = import_years(spark, table, f"{tmp_path}/{{year}}", 2024, 2024)
    assert statuses(result) == {2024: ("success", 5, 5)}
    assert {r.outcome: r.rows for r in result.outcomes.collect()} == {
        "accepted": 7,
        "fields": 1,
        "essential": 1,
    }
    loaded = spark.table(table)
    assert [f.name for f in loaded.schema] == TABLE_SCHEMA.names
    assert [f.dataType for f in loaded.schema] == [f.dataType for f in TABLE_SCHEMA]
    # The flat has the key of an outbuilding that comes first, so it is dropped.
    assert loaded.filter("type_local = 'Appartement'").count() == 0
    assert loaded.filter("id_mutation = '2024-5'").count() == 2
    assert loaded.select("import_date").distinct().count() == 1
    assert price_report(loaded).summary.first().nombre_transactions == 0


def test_year_range_rules(spark, table, tmp_path):
    year_file(tmp_path, 2022, [line(id_mutation="a", lot1_numero="1"), line(id_mutation="b")])
    year_file(tmp_path, 2023, [line(id_mutation="a", lot1_numero="1"), line(id_mutation="b")])
    year_file(tmp_path, 2024, ["only,bad"])
    template = f"{tmp_path}/{{year}}"
    first = import_years(spark, table, template, 2022, 2022)
    assert statuses(first) == {2022: ("success", 2, 2)}
    # 2021 has no file; in 2023 the full key is taken, the key with a null part is not.
    again = import_years(spark, table, template, 2021, 2024)
    assert statuses(again) == {
        2021: ("failed", None, 0),
        2022: ("already_imported", 2, 0),
        2023: ("success", 1, 1),
        2024: ("failed", None, 0),
    }
    assert again.total_records == 3
    assert [r.year for r in again.years.filter("error is not null").collect()] == [2021]

    status = [(r.import_year, r.record_count) for r in
              tables.import_status(spark.table(table)).collect()]
    assert status == [(2023, 1), (2022, 2)]
    stats = tables.table_stats(spark, table).first()
    assert (stats.total_records, stats.years_imported) == (3, 2) and stats.table_bytes > 0

    assert tables.clear_year(spark, table, 2022) == 2
    assert tables.clear_year(spark, table, 2022) == 0
    assert not tables.has_year(spark, table, 2022)
    assert spark.table(table).count() == 1
    # The cleared year is read again; 2023 now holds nothing that conflicts with it.
    assert statuses(import_years(spark, table, template, 2022, 2022)) == {2022: ("success", 2, 2)}


def test_following_years_are_one_load_in_year_order(spark, table, tmp_path):
    for year in (2021, 2022, 2023, 2025):
        key = line(id_mutation="a", lot1_numero="1", nom_commune=str(year))
        year_file(tmp_path, year, [key, line(id_mutation=f"b{year}")])
    template = f"{tmp_path}/{{year}}"
    import_years(spark, table, template, 2022, 2022)
    everything = import_years(spark, table, template, 2020, 2025)
    assert statuses(everything) == {
        2020: ("failed", None, 0),
        2021: ("success", 1, 1),
        2022: ("already_imported", 2, 0),
        2023: ("success", 1, 1),
        2024: ("failed", None, 0),
        2025: ("success", 1, 1),
    }
    # 2022 parts the years; what lies on either side of it is one load each.
    assert sorted(loads.partitions(spark, table)) == [
        (0, 1), (0, 2), (0, 3), (2021, 2), (2022, 1), (2023, 3), (2025, 3)
    ]
    assert spark.table(table).filter("id_mutation = 'a'").first().nom_commune == "2022"


@pytest.mark.parametrize("late", [False, True])
def test_a_failing_load_is_tried_year_by_year(spark, table, tmp_path, monkeypatch, late):
    for year in (2021, 2022, 2023):
        year_file(tmp_path, year, [line(id_mutation="a", lot1_numero="1"), line(id_mutation="b")])
    real = imports.insert_new

    def fails(batch, *arguments, before_publish, **options):
        if batch.select("import_year").distinct().count() > 1:
            if late:  # something may be visible already, so nothing may be tried again
                real(batch, *arguments, before_publish=before_publish, **options)
            raise RuntimeError("several years")
        return real(batch, *arguments, before_publish=before_publish, **options)

    monkeypatch.setattr(imports, "insert_new", fails)
    result = import_years(spark, table, f"{tmp_path}/{{year}}", 2021, 2023)
    found = statuses(result)
    if late:
        assert {status for status, _, _ in found.values()} == {"failed"}
    else:
        assert found == {2021: ("success", 2, 2), 2022: ("success", 1, 1), 2023: ("success", 1, 1)}
    assert spark.table(table).count() == 4


def test_files_in_one_group_dedup_in_path_order(spark, table, tmp_path):
    key = {"id_mutation": "k", "lot1_numero": "1"}
    paths = [
        write_file(tmp_path / "part-2.csv", [line(**key, nom_commune="second")]),
        write_file(tmp_path / "part-1.csv", [line(**key, nom_commune="first")]),
    ]
    assert import_files(spark, table, 2024, paths) == 1
    assert spark.table(table).first().nom_commune == "first"
    assert import_files(spark, table, 2024, paths) == 0


def test_rearranged_year_keeps_its_rows(spark, table, tmp_path):
    for part in range(3):
        lines = [
            line(id_mutation=f"{part}-{i}", code_postal=f"{i % 5:05d}") for i in range(20)
        ]
        import_files(spark, table, 2024, [write_file(tmp_path / f"{part}.csv", lines)])
    # The number of a row's load is where it is stored, and a rearranged year is one load.
    before = sorted(map(str, spark.table(table).drop(LOAD).collect()))
    tables.rearrange_year(spark, table, 2024)
    assert sorted(map(str, spark.table(table).drop(LOAD).collect())) == before
    assert spark.table(table).select(LOAD).distinct().count() == 1
    tables.refresh_statistics(spark, table)
    assert "60 rows" in str(spark.sql(f"DESCRIBE EXTENDED {table}").collect())


def test_integrity_report(spark, table, tmp_path):
    lines = [
        line(id_mutation="a", surface_reelle_bati="50"),
        line(id_mutation="b", surface_reelle_bati="0"),
        line(id_mutation="c"),
    ]
    import_files(spark, table, 2024, [write_file(tmp_path / "a.csv", lines)])
    loaded = spark.table(table)
    assert tuple(tables.integrity_report(loaded, 2024).first()) == (3, 1, True)
    assert tuple(tables.integrity_report(loaded, 2023).first()) == (0, 0, False)
    sample = tables.integrity_sample(loaded, 2024).collect()
    assert [(r.id_mutation, r.prix_m2) for r in sample] == [("a", 2000.0), ("b", None), ("c", None)]


def test_table_is_found_by_name(spark, table):
    with pytest.raises(LookupError):
        tables.resolve_table(spark, ["nothing_here"])
    tables.create_table(spark, table)
    tables.create_table(spark, table)
    assert tables.resolve_table(spark, ["nothing_here", table]) == table
    assert tables.read_register_table(spark, table).isEmpty()


# --- stream


def rows_of(spark, table):
    return sorted(
        (r.id_mutation, r.lot1_numero or "", r.import_year) for r in spark.table(table).collect()
    )


def test_stream_loads_new_files_once(spark, table, tmp_path):
    landing, checkpoint = tmp_path / "landing", str(tmp_path / "checkpoint")
    year_file(landing, 2023, [line(id_mutation="a", lot1_numero="1"), line(id_mutation="b")])
    ingest_stream(spark, str(landing), table, checkpoint).awaitTermination()
    expected = [("a", "1", 2023), ("b", "", 2023)]
    assert rows_of(spark, table) == expected
    ingest_stream(spark, str(landing), table, checkpoint).awaitTermination()
    assert rows_of(spark, table) == expected
    year_file(
        landing, 2024, [line(id_mutation="a", lot1_numero="1"), line(id_mutation="b"), "bad"]
    )
    ingest_stream(spark, str(landing), table, checkpoint).awaitTermination()
    assert rows_of(spark, table) == [*expected, ("b", "", 2024)]


def test_replayed_batch_adds_only_what_is_missing(spark, table, tmp_path):
    lines = [
        line(id_mutation="a", lot1_numero="1"),
        line(id_mutation="b"),
        line(id_mutation="b"),
        line(id_mutation="c"),
    ]
    path = write_file(tmp_path / "2024" / "x.csv", lines)
    times = str(tmp_path / "times")
    tables.create_table(spark, table)
    batch = spark.read.option("lineSep", "\n").text(path).select(
        "value",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
    )
    incremental.insert_batch(batch, 0, table, times)
    full = rows_of(spark, table)
    assert len(full) == 4
    incremental.insert_batch(batch, 0, table, times)
    assert rows_of(spark, table) == full
    # A commit that was cut off: two of the rows never arrived.
    kept = spark.table(table).filter("id_mutation in ('a', 'b')").dropDuplicates(["id_mutation"])
    rows = kept.collect()
    tables.clear_year(spark, table, 2024)
    spark.createDataFrame(rows, TABLE_SCHEMA).write.insertInto(table)
    incremental.insert_batch(batch, 0, table, times)
    assert rows_of(spark, table) == full
    incremental.insert_batch(batch, 1, table, times)
    assert len(rows_of(spark, table)) == 4 + 3


def test_stream_binds_each_file_by_its_own_header(spark, table, tmp_path):
    landing = tmp_path / "landing" / "2024"
    quoted = ",".join(f'"{name}"' for name in COLUMNS)
    write_file(landing / "a.csv", [line(id_mutation="a")])
    write_file(landing / "b.csv.gz", [line(id_mutation="b")], quoted)
    backwards = ",".join(reversed(record(id_mutation="c")))
    write_file(landing / "c.csv", [backwards], ",".join(reversed(COLUMNS)))
    write_file(landing / "d.csv", ["1,2"], "other,names")
    for _ in range(2):
        ingest_stream(
            spark, str(landing.parent), table, str(tmp_path / "checkpoint")
        ).awaitTermination()
    rows = spark.table(table).orderBy("id_mutation").collect()
    assert [(r.id_mutation, r.id_parcelle) for r in rows] == [
        (name, record()[COLUMNS.index("id_parcelle")]) for name in "abc"
    ]


def test_imports_leave_nothing_staged(spark, table, tmp_path):
    base = Path(spark.conf.get("spark.checkpoint.dir")) / "landprice"
    before = set(base.iterdir()) if base.exists() else set()
    import_files(spark, table, 2024, [write_file(tmp_path / "a.csv", [line()])])
    tables.rearrange_year(spark, table, 2024)
    assert {x for x in set(base.iterdir()) - before if any(x.iterdir())} == set()
    assert spark.table(table).count() == 1


def test_wide_jobs_are_compiled_in_any_session(spark, table, tmp_path, monkeypatch):
    setting, seen, real = "spark.sql.codegen.hugeMethodLimit", [], loads.write_aside

    def write_aside(rows, name):
        seen.append(int(rows.sparkSession.conf.get(setting)))
        return real(rows, name)

    monkeypatch.setattr(loads, "write_aside", write_aside)
    before = spark.conf.get(setting)
    spark.conf.set(setting, "65535")
    try:
        import_files(spark, table, 2024, [write_file(tmp_path / "a.csv", [line()])])
        tables.rearrange_year(spark, table, 2024)
        year_file(tmp_path / "landing", 2023, [line(id_mutation="b")])
        import_years(spark, table, f"{tmp_path}/landing/{{year}}", 2023, 2023)
        year_file(tmp_path / "next", 2022, [line(id_mutation="c")])
        ingest_stream(spark, f"{tmp_path}/next", table, f"{tmp_path}/checkpoint").awaitTermination()
        assert len(seen) == 4 and max(seen) <= 8000 and spark.conf.get(setting) == "65535"
    finally:
        spark.conf.set(setting, before)
    assert spark.table(table).count() == 3


def test_stream_refuses_files_outside_year_folders(spark, table, tmp_path):
    write_file(tmp_path / "landing" / "x.csv", [line()])
    query = ingest_stream(spark, str(tmp_path / "landing"), table, str(tmp_path / "c"))
    with pytest.raises(Exception, match="year folder"):
        query.awaitTermination()
    assert spark.table(table).isEmpty()


def jobs_of(spark, action):
    group = f"counted-{uuid.uuid4().hex}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        result = action()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return result, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_headers_of_many_files_are_one_job(spark, tmp_path):
    backwards = ",".join(reversed(COLUMNS))
    for number in range(300):
        header = [backwards] if number % 3 == 0 else []
        suffix = ".gz" if number % 2 else ""
        write_file(tmp_path / f"part {number}.csv{suffix}", [line(id_mutation=str(number))] * 3, *header)
    write_file(tmp_path / "z.csv", [line()] * 20_000)
    (tmp_path / "empty.csv").write_text("")
    headers, jobs = jobs_of(spark, lambda: register_csv.read_headers(spark, [str(tmp_path)]))
    assert jobs == 1 and len(headers) == 301
    assert sorted({x for x in headers.values()}) == sorted({backwards, ",".join(COLUMNS)})
    assert sum(x == backwards for x in headers.values()) == 100


def test_later_blocks_of_a_file_are_no_headers(spark, tmp_path):
    write_file(tmp_path / "x.csv", [line(id_mutation=str(n)) for n in range(2000)])
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    assert register_csv.read_headers(spark, [str(tmp_path)]).popitem()[1] == ",".join(COLUMNS)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = register_csv.read_register(spark, [str(tmp_path)])
        assert register_csv.accepted(rows).count() == 2000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_outcomes_are_counted_while_staging(spark, tmp_path):
    path = write_file(tmp_path / "a.csv", [*DELIVERY, line(code_postal="123456")])
    staged, counts = stage_and_count(spark, [path])
    assert counts == {r.outcome: r.rows for r in register_csv.reject_report(staged).collect()}
    assert counts == {"accepted": 7, "fields": 1, "essential": 1, "storage:code_postal": 1}


# --- loads


def sales(spark, ids, year=2024, **columns):
    """Rows ready to be written, with line positions."""
    rows = spark.createDataFrame([(str(i), n) for n, i in enumerate(ids)], "id_mutation string, n long")
    values = {"date_mutation": "2024-01-02", "numero_disposition": "1", "id_parcelle": "P1",
              "lot1_numero": "1", "import_year": year, **columns}
    for field in TABLE_SCHEMA:
        if field.name != "id_mutation":
            value = values.get(field.name)
            value = value if hasattr(value, "_jc") or hasattr(value, "_expr") else F.lit(value)
            rows = rows.withColumn(field.name, value.cast(field.dataType))
    return rows.withColumns({"_file": F.lit("f"), "_block": F.lit(0).cast("long"), "_line": F.col("n")}).drop("n")


def ids_of(spark, table):
    spark.catalog.refreshTable(table)
    return sorted(r.id_mutation for r in spark.table(table).select("id_mutation").collect())


def test_a_writer_that_dies_leaves_no_row(spark, table, monkeypatch):
    tables.create_table(spark, table)
    assert tables.insert_new(sales(spark, "ab"), table) == 2

    def dies(*_):
        raise RuntimeError("killed")

    monkeypatch.setattr(loads, "publish", dies)
    with pytest.raises(RuntimeError):
        tables.insert_new(sales(spark, "cd"), table)
    monkeypatch.undo()
    assert ids_of(spark, table) == ["a", "b"]
    assert len(loads.remove_unpublished(spark, table)) == 1
    assert loads.remove_unpublished(spark, table) == []
    assert tables.insert_new(sales(spark, "bcd"), table) == 2
    assert ids_of(spark, table) == ["a", "b", "c", "d"]


def test_a_load_of_several_years_is_one_catalog_call(spark, table):
    tables.create_table(spark, table)
    rows = sales(spark, range(6), import_year=F.expr("2020 + cast(id_mutation as int) % 3"))
    assert tables.insert_new(rows, table) == 6
    assert sorted(loads.partitions(spark, table)) == [(0, 1), (2020, 1), (2021, 1), (2022, 1)]
    assert {r.import_year: r.record_count for r in tables.import_status(spark.table(table)).collect()} == {
        2020: 2, 2021: 2, 2022: 2}
    assert tables.clear_year(spark, table, 2021) == 2
    assert ids_of(spark, table) == ["0", "2", "3", "5"]


def test_the_key_holds_against_a_second_writer(spark, table):
    tables.create_table(spark, table)
    tables.insert_new(sales(spark, "a"), table)

    def other_publishes(load, number):
        # Between the first writer's comparison and its publication, for another year.
        if not rivals:
            rivals.append(number)
            assert tables.insert_new(sales(spark, "bc", year=2023), table) == 2

    rivals = []
    inserted = tables.insert_new(sales(spark, "abcde"), table, before_publish=other_publishes)
    assert (rivals, inserted) == ([2], 2)
    assert ids_of(spark, table) == list("abcde")
    keys = spark.table(table).groupBy(*KEY).count()
    assert keys.filter("count > 1").isEmpty()
    # A writer all of whose rows came from elsewhere meanwhile publishes nothing.
    rivals.clear()
    assert tables.insert_new(
        sales(spark, "bc"), table, before_publish=other_publishes) == 0
    assert max(load for _, load in loads.partitions(spark, table)) == 3


def test_a_replayed_batch_whose_load_arrived_reads_no_table(spark, table, tmp_path, monkeypatch):
    path = write_file(tmp_path / "2024" / "x.csv", [line(id_mutation="a"), line(id_mutation="a")])
    tables.create_table(spark, table)
    batch = spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"))
    times = str(tmp_path / "times")
    incremental.insert_batch(batch, 0, table, times)
    assert ids_of(spark, table) == ["a", "a"]
    monkeypatch.setattr(incremental, "materialised", None)  # it stops before it reads a line
    incremental.insert_batch(batch, 0, table, times)
    monkeypatch.undo()
    # The record alone is not enough: the load must be in the catalog.
    loads.drop_partitions(spark, table, loads.partitions(spark, table))
    incremental.insert_batch(batch, 0, table, times)
    assert ids_of(spark, table) == ["a", "a"]


# --- layout


def rows_scanned(spark, table, condition):
    """Rows that the scan read for a filter, after row groups and pages were skipped."""
    found = spark.table(table).filter(condition).select("id_mutation", "valeur_fonciere")
    found.collect()
    plan = found._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_lookups_by_any_column_read_few_row_groups(spark, table, monkeypatch):
    monkeypatch.setattr(loads, "ROW_GROUP_BYTES", 4_000)
    tables.create_table(spark, table)
    rows = spark.range(40_000).select(
        F.col("id").cast("string").alias("id_mutation"),
        F.expr("date_add(DATE'2024-01-01', int(pmod(xxhash64(id, 1), 360)))").alias("date_mutation"),
        F.expr("concat('P', lpad(pmod(xxhash64(id, 2), 20000), 6, '0'))").alias("id_parcelle"),
        F.expr("lpad(pmod(xxhash64(id, 3), 400), 5, '0')").alias("code_postal"),
        F.expr("element_at(array('Appartement', 'Maison', 'Dépendance'), int(1 + pmod(xxhash64(id, 4), 3)))").alias("type_local"),
        F.lit(2024).cast("short").alias("import_year"),
    )
    for field in TABLE_SCHEMA:
        if field.name not in rows.columns:
            rows = rows.withColumn(field.name, F.lit(None).cast(field.dataType))
    tables.append_rows(rows, table)
    lookups = ("id_parcelle = 'P000123'", "code_postal = '00007'", "date_mutation = DATE'2024-05-05'",
               "id_mutation = '777'")
    after = {x: rows_scanned(spark, table, x) for x in lookups}
    monkeypatch.setattr(tables, "LAYOUT", ("type_local", "code_postal"))
    monkeypatch.setattr(tables, "with_curve_position", lambda df, bounds, name: df.withColumn(name, F.lit(0)))
    monkeypatch.setattr(loads, "BLOOM_COLUMNS", ())
    tables.clear_year(spark, table, 2024)
    tables.append_rows(rows, table)
    before = {x: rows_scanned(spark, table, x) for x in lookups}
    assert spark.table(table).count() == 40_000
    for lookup in ("id_parcelle = 'P000123'", "date_mutation = DATE'2024-05-05'", "id_mutation = '777'"):
        assert after[lookup] < 0.5 * before[lookup], (lookup, after, before)
    assert after["code_postal = '00007'"] < 8_000, (after, before)


def test_curve_ranks_follow_the_values(spark):
    rows = spark.range(5000).select(
        (F.col("id") % 1000).cast("int").alias("a"), F.col("id").cast("string").alias("b"),
        F.when(F.col("id") % 7 > 0, F.lit("same")).alias("c"), F.lit(None).cast("string").alias("d"),
    )
    bounds = layout.rank_bounds(rows, ("a", "b", "c", "d"))
    assert bounds["c"] == ["same"] and bounds["d"] == [] and len(bounds["a"]) == 15
    ranked = rows.withColumns({f"r_{x}": layout.rank(F.col(x), bounds[x]) for x in bounds}).collect()
    for x in "abc":
        for r in ranked[:500]:
            assert r[f"r_{x}"] == (0 if r[x] is None else sum(v <= r[x] for v in bounds[x]))
    assert {r.r_d for r in ranked} == {0}
    placed = layout.with_curve_position(rows, bounds, "p")
    assert placed.columns == [*rows.columns, "p"] and placed.select("p").distinct().count() > 100


def shuffle_files(spark):
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = {found.apply(i).getName() for i in range(found.size())}
    return {name for name in names if name.startswith("shuffle_") and name.endswith(".data")}


def test_imports_leave_no_shuffle_files(spark, table, tmp_path):
    rows = [line(id_mutation=f"2024-{i}", id_parcelle=f"P{i}") for i in range(500)]
    year_file(tmp_path, 2023, rows)
    year_file(tmp_path, 2024, rows + rows[:5])
    before, setting = shuffle_files(spark), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    own = spark.conf.get(setting)
    import_years(spark, table, f"{tmp_path}/{{year}}", 2023, 2024)
    for _ in range(50):  # files are deleted by another thread
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.2)
    assert not left and spark.conf.get(setting) == own
    assert spark.table(table).count() > 500


def test_years_of_one_load_are_arranged_in_runs(spark, table, tmp_path, monkeypatch):
    """One run of years is shuffled at a time; the earlier year still keeps a key."""
    lot = {"id_parcelle": "P", "lot1_numero": "1"}
    for year in (2021, 2022, 2023):
        own = [line(id_mutation=f"{year}-{i}", **lot) for i in range(20)]
        twice = [line(id_mutation="every", code_postal=str(year * 10 + i), **lot) for i in range(2)]
        year_file(tmp_path, year, own + twice + [line(id_mutation="none")] * 3)
    monkeypatch.setattr(tables, "ROWS_AT_ONCE", 60)
    runs, plain = [], loads.write_aside

    def write_aside(rows, name, *years):
        runs.append([list(run) for run in years])
        return plain(rows, name, *years)

    monkeypatch.setattr(loads, "write_aside", write_aside)
    result = import_years(spark, table, f"{tmp_path}/{{year}}", 2021, 2023)
    assert runs == [[[2021, 2022], [2023]]]
    assert statuses(result) == {
        2021: ("success", 24, 24), 2022: ("success", 23, 23), 2023: ("success", 23, 23)
    }
    every = spark.table(table).filter("id_mutation = 'every'").collect()
    assert [(row.import_year, row.code_postal) for row in every] == [(2021, "20210")]
    assert spark.table(table).filter("id_mutation = 'none'").count() == 9
    assert spark.table(table).select(LOAD).distinct().count() == 1
