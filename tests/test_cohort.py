import datetime
import re

import pytest
from pyspark.sql import functions as F

from cohortlens.operators import cohort
from cohortlens.operators.cells import cells, subgroup_cells
from cohortlens.sources import admissions as io


def rows_of(df, *columns):
    return sorted((tuple(row) for row in df.select(*columns).collect()), key=str)


@pytest.fixture(scope="module")
def records(spark):
    data = [
        ("a1", "u1", 50, 1, "2019", "eSurgery", "0", "1", "0"),
        ("a2", "u1", 50, 0, "2019", "Medical", "1", "0", "1"),
        ("a3", "u1", 60, 1, "2020", "Medical", "2", "1", "1"),
        ("a4", "u2", 50, 0, "2020", None, None, None, None),
        ("a5", None, 50, 0, "2020", "Medical", "2", "1", "1"),
        ("a6", "u2", None, 1, "2020", "Medical", "2", "1", "1"),
        ("a7", "u2", 50, 1, "2020", None, "0", None, None),
    ]
    return spark.createDataFrame(data, io.ADMISSIONS_SCHEMA)


def test_levels_and_frequencies(spark, records):
    assert rows_of(cohort.used_levels(records, "adm_year"), "level", "idx") == [("2019", 1), ("2020", 2)]
    ordered = cohort.used_levels(records, "adm_year", ["2021", "2020", "2019"])
    assert rows_of(ordered, "level", "idx") == [("2019", 2), ("2020", 1)]
    levels = cohort.level_table(spark, ["eSurgery", "Medical", "Emergency"])
    assert rows_of(cohort.freq(records, "adm_type", levels), "level", "n") == [("Emergency", 0), ("Medical", 4), ("eSurgery", 1)]
    factor = cohort.as_factor(records, "adm_year", cohort.level_table(spark, ["2020"]))
    assert rows_of(factor.groupBy("adm_year").count(), "adm_year", "count") == [("2020", 5), (None, 2)]


def test_any_number_of_levels(spark):
    levels = cohort.used_levels(spark.range(3000).where("id % 2 = 0"), "id")
    assert levels.count() == 1500 and levels.agg({"idx": "max"}).first()[0] == 1500


def test_cells_leave_out_incomplete_rows(records):
    assert rows_of(cells(records), "unit", "level", "saps", "n", "k") == [
        ("u1", "2019", 50, 2, 1), ("u1", "2020", 60, 1, 1), ("u2", "2020", 50, 2, 1),
    ]


def test_nan_score_counts_as_missing(records):
    scored = records.withColumn("saps", F.when(F.col("admission_id") == "a1", F.lit(float("nan"))).otherwise(F.col("saps")))
    assert rows_of(cells(scored).groupBy().agg(F.sum("n").alias("n")), "n") == [(4,)]


def test_subgroup_cells_equal_filtered_cells(records):
    together = subgroup_cells(records)
    for name, (column, value) in cohort.SUBGROUPS.items():
        alone = cells(cohort.subgroup(records, column, value))
        columns = ["unit", "level", "saps", "n", "k"]
        assert rows_of(together.where(F.col("subgroup") == name), *columns) == rows_of(alone, *columns)


def test_tagging_rows_gives_the_same_as_tagging_cells(records):
    tagged = cells(cohort.tag_subgroups(records), by=["subgroup"])
    columns = ["subgroup", "unit", "level", "saps", "n", "k"]
    assert rows_of(tagged, *columns) == rows_of(subgroup_cells(records), *columns)


def test_subgroups_are_laid_out_after_the_last_count(records):
    plan = subgroup_cells(records)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate") == 1 and plan.index("Generate") < plan.index("HashAggregate")
    # neither the subgroup columns nor names of subgroups are keys of a count
    keys = re.findall(r"HashAggregate\(keys=\[(.*?)\]", plan)
    assert keys and not any(word in key for key in keys for word in ("adm_type", "ecog", "subgroup"))


def test_any_number_of_subgroups(spark, records):
    many = {f"s{i}": ("saps", i) for i in range(130)} | {"surg": ("adm_type", "eSurgery"), "last": ("ecog", "0")}
    found = rows_of(subgroup_cells(records, many), "subgroup", "unit", "level", "saps", "n", "k")
    assert found == sorted([
        ("s50", "u1", "2019", 50, 2, 1), ("s60", "u1", "2020", 60, 1, 1), ("s50", "u2", "2020", 50, 2, 1),
        ("surg", "u1", "2019", 50, 1, 1), ("last", "u1", "2019", 50, 1, 1), ("last", "u2", "2020", 50, 1, 1),
    ], key=str)


def test_attach_dates(spark, records):
    day = datetime.date(2020, 5, 1)
    dates = spark.createDataFrame([("a1", day), ("a3", day), ("zz", day), (None, day)], io.ADMISSION_DATES_SCHEMA)
    nameless = records.limit(1).withColumn("admission_id", F.lit(None).cast("string"))
    bound = cohort.attach_dates(records.unionByName(nameless), dates)
    assert bound.columns == [*records.columns, "adm_date"]
    assert rows_of(bound.where("adm_date is not null"), "admission_id") == [("a1",), ("a3",)]
    assert bound.count() == records.count() + 1


def test_attach_dates_checks_keys(spark, records):
    day = datetime.date(2020, 5, 1)
    doubled = spark.createDataFrame([("a1", day), ("a1", day)], io.ADMISSION_DATES_SCHEMA)
    single = spark.createDataFrame([("a1", day)], io.ADMISSION_DATES_SCHEMA)
    with pytest.raises(Exception, match="dates: admission_id is not unique"):
        cohort.attach_dates(records, doubled).collect()
    with pytest.raises(Exception, match="admissions: admission_id is not unique"):
        cohort.attach_dates(records.unionByName(records), single).collect()
    with pytest.raises(Exception, match="dates: admission_id is not unique"):
        cohort.attach_dates(records, doubled, one_to_one=False).collect()
    assert cohort.attach_dates(records.unionByName(records), single, one_to_one=False).count() == 2 * records.count()


def test_attach_dates_moves_only_rows_with_a_key_and_dates_once(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        left = spark.range(2000).select(F.when(F.col("id") % 10 == 0, F.col("id")).alias("admission_id"), F.col("id").alias("x"))
        dates = spark.range(0, 2000, 10).select(F.col("id").alias("admission_id"), F.lit("2020-01-01").alias("unit_admission_date"))
        for one_to_one in (True, False):
            bound = cohort.attach_dates(left, dates, one_to_one=one_to_one)
            assert bound.count() == 2000 and bound.where("adm_date is not null").count() == 200
            plan = bound._jdf.queryExecution().executedPlan().toString()
            # admissions (and their counts), dates: no exchange but those of the join, no window
            assert plan.count("Exchange hashpartitioning(admission_id") == (3 if one_to_one else 2)
            assert "Window" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_attach_dates_reads_only_what_is_used(spark, sf_dir):
    from cohortlens.plans import catalog

    plan = catalog.attach_dates(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    schemas = [line for line in plan.splitlines() if "ReadSchema" in line and "l_orderkey" in line]
    assert schemas
    for line in schemas:
        read = line[line.index("ReadSchema"):]
        assert set(re.findall(r"\bl_\w+", read)) == {"l_orderkey", "l_returnflag", "l_shipdate"}


def test_extract_files_follow_the_data_not_the_tasks(spark, records, tmp_path):
    many = records.withColumn("adm_date", F.current_date()).repartition(16)
    for tasks in (4, 16):
        path = tmp_path / f"extract{tasks}"
        io.write_extract(many.repartition(tasks), str(path))
        assert len(list(path.rglob("part-*"))) <= 3


def test_bind_by_position(spark):
    numbers = spark.range(1000)
    left = numbers.select((F.col("id") * 7 % 1000).alias("a"))
    right = numbers.select((F.col("id") * 3 % 1000).alias("b"), F.concat(F.lit("d"), F.col("id") * 3 % 1000).alias("d"))
    for coalesced in ("true", "false"):       # the sorted rows in one partition and in several
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesced)
        try:
            bound = cohort.bind_by_position(left, right, ["a"], ["b"], "d", "date").collect()
        finally:
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        assert len(bound) == 1000 and all(row.date == f"d{row.a}" for row in bound)
    with pytest.raises(ValueError, match="length"):
        cohort.bind_by_position(left, right.limit(10), ["a"], ["b"], "d", "date")
    with pytest.raises(ValueError, match="not unique"):
        cohort.bind_by_position(left, right.withColumn("b", F.col("b") % 10), ["a"], ["b"], "d", "date")


def test_member_filter_and_labels(spark, records):
    assert cohort.member_of(records, "adm_type", ["Medical", "eSurgery"]).count() == 5
    labelled = cohort.relabel(records, "adm_year", {"2020": "last"})
    assert rows_of(labelled.groupBy("label").count(), "label", "count") == [("last", 5), (None, 2)]


def test_extract_round_trip(spark, records, tmp_path):
    dated = records.withColumn("adm_date", F.lit(datetime.date(2020, 2, 3)))
    path = str(tmp_path / "extract")
    io.write_extract(dated, path)
    back = io.read_extract(spark, path)
    assert back.schema["adm_year"].dataType.simpleString() == "string"
    assert rows_of(back, *io.EXTRACT_COLUMNS) == rows_of(dated, *io.EXTRACT_COLUMNS)
    plan = back.where("adm_year = '2020'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(adm_year" in plan
    with pytest.raises(Exception):
        io.write_extract(dated, path)


def test_csv_with_declared_schema(spark, records, tmp_path):
    path = str(tmp_path / "csv")
    records.write.option("header", True).csv(path)
    back = io.read_admissions(spark, path, fmt="csv")
    assert back.schema == io.ADMISSIONS_SCHEMA
    assert rows_of(back, *records.columns) == rows_of(records, *records.columns)


def test_report_sink_writes_one_file(spark, records, tmp_path):
    path = tmp_path / "report"
    io.write_report(io.shown(records.select("saps", "death")).repartition(5), str(path))
    assert len(list(path.glob("part-*.csv"))) == 1


def test_scan_reads_only_what_the_cells_need(spark, records, tmp_path):
    path = str(tmp_path / "admissions")
    records.write.parquet(path)
    table = io.read_admissions(spark, path)
    plan = cells(cohort.member_of(table, "adm_year", ["2019", "2020"]))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<unit_code:string,saps:int,death:int,adm_year:string>" in plan
    assert "IsNotNull(unit_code)" in plan and "In(adm_year, [2019,2020])" in plan
    assert plan.count("Exchange") == 1
    tagged = subgroup_cells(table)._jdf.queryExecution().executedPlan().toString()
    assert tagged.count("FileScan") == 1 and tagged.count("Exchange") == 2
