import datetime as dt
import math
import random

import numpy as np
import pytest

from frameprobe.operators.paths import path_audit
from frameprobe.plans.analysis import analyze, read_report, write_report


@pytest.fixture(scope="module")
def parcels(spark):
    """250 parcels: six numbers, two of them with gaps, and five columns of few levels."""
    r = random.Random(11)
    rows = []
    for i in range(250):
        distance = round(r.uniform(5, 900), 1)
        weight = round(abs(r.gauss(8, 3)), 2)
        rows.append((distance, weight, round(4 + 0.02 * distance + 0.5 * weight + r.gauss(0, 1), 2), 10 + round(distance / 15 + r.gauss(0, 4)),
                     None if i % 31 == 0 else round(r.gauss(70, 12), 1), None if i % 40 == 7 else r.randrange(0, 90),
                     r.choice(["north", "south", "east", "west"]), r.choice(["van", "rail", "ship"]),
                     r.choice(["standard", "express"]), r.choice(["box", "tube", "sack", "crate", "pallet"]),
                     r.choice(["spring", "summer", "autumn"])))
    return spark.createDataFrame(rows, "distance double, weight double, cost double, hours long, score double, delay long, "
                                       "zone string, carrier string, service string, packing string, season string")


def test_parcel_manifest(parcels):
    items = analyze(parcels).manifest.collect()
    sections = [r.section for r in items]
    assert len(items) >= 20 and len(items) <= 100
    assert sections[:2] == ["summary", "missing"]
    assert sections.count("dists") == sections.count("boxplots") == 6
    assert sections.count("cats") == 5 and sections.count("corr") == 1
    assert sections.count("scatters") == 15 and sections.count("cat_num") == 30
    assert sections.count("cat_cat") == 10
    assert len({r.path.casefold() for r in items}) == len(items)
    assert [r.ordinal for r in items] == list(range(1, len(items) + 1))
    titles = {r.section: r.title for r in items}
    assert titles["missing"] == "Missing Values Breakdown (%)"
    assert " vs " in titles["scatters"] and "(r = " in titles["scatters"]
    assert "η² = " in titles["cat_num"] and "Cramér's V = " in titles["cat_cat"]


def test_tables_agree_with_each_other(parcels):
    a = analyze(parcels)
    counts = {r["column"]: r["count"] for r in a.summary.collect()}
    bins = {r["column"]: r["n"] for r in a.dists.groupBy("column").agg({"count": "sum"}).toDF("column", "n").collect()}
    assert bins == counts
    for r in a.cats.groupBy("column").agg({"pct": "sum"}).toDF("column", "p").collect():
        assert r["p"] == pytest.approx(100)
    assert all(0 <= r.score <= 1 for r in a.cat_num_rows) and all(0 <= r.v <= 1 for r in a.cat_cat_rows)
    area = {}
    for r in a.curves.collect():
        area.setdefault(r["column"], []).append((r["grid"], r["x"], r["density"]))
    for points in area.values():
        _, x, y = zip(*sorted(points))
        assert 0.8 < np.trapezoid(y, x) <= 1.0
    overview = a.overview.first()
    assert (overview.rows, overview.columns, overview.numeric_columns, overview.categorical_columns) == (250, 11, 6, 5)
    assert a.cat_cat_cells.select("col1", "col2").distinct().count() == len(a.cat_cat_rows)
    assert a.cat_num_boxes.select("cat_col", "num_col").distinct().count() == len(a.cat_num_rows)


@pytest.mark.parametrize("data, schema, least", [
    ([(float(i),) for i in range(6)], "single double", 4),
    ([(None, None)] * 3, "a double, b double", 3),
    ([(1, "A")] * 5, "c1 long, c2 string", 4),
    ([(i % 2 == 0, dt.datetime(2024, 1, 1 + i), 10 * i) for i in range(5)], "flag boolean, dt timestamp, val long", 5),
    ([(f"user_{i}", i) for i in range(20)], "user_id string, score long", 4),
])
def test_edge_tables(spark, data, schema, least):
    a = analyze(spark.createDataFrame(data, schema))
    items = a.manifest.collect()
    assert len(items) >= least
    assert items[0].section == "summary" and "corr" in {r.section for r in items}
    assert not any("dt" in r.title.split() or "user_id" in r.title for r in items)


def test_duplicate_names(spark):
    a = analyze(spark.sql("SELECT * FROM VALUES (1, 2, 3), (4, 5, 6) AS t(x, y, z)").toDF("x", "x", "y"))
    assert a.df.columns == ["x", "x_1", "y"]
    assert "dist_x_1" in {r.name for r in a.manifest.collect()}


def test_cap_stops_before_later_sections(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([tuple(float(v) for v in rng.normal(size=100)) for _ in range(20)],
                               ", ".join(f"c_{i} double" for i in range(100)))
    a = analyze(df, max_items=10)
    assert [r.section for r in a.manifest.collect()] == ["summary"] + ["dists"] * 9
    assert "scatter_rows" not in a.__dict__ and "cat_num_rows" not in a.__dict__


def test_awkward_names_give_safe_unique_paths(spark):
    rng = np.random.default_rng(123)
    numbers = ["Salary", "salary", "CON", "AUX", "NUL", "Score. ", "Score.", "A" * 80]
    texts = ["Customer/Name", "Customer:Name", "PRN", "café", "café", "Dept`s*"]
    data = [tuple(float(v) for v in rng.normal(size=8)) + tuple(str(v) for v in rng.choice(["P", "Q", "R"], 6))
            for _ in range(60)]
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        df = spark.createDataFrame(data, numbers + texts)
        a = analyze(df, max_items=50)
        manifest = a.manifest
        items = manifest.collect()
        assert len(items) == 50
        assert path_audit(manifest).count() == 0
        assert {"01_univariate_numeric_distributions/dist_Salary.png",
                "01_univariate_numeric_distributions/dist_salary_2.png"} <= {r.path for r in items}
    finally:
        spark.conf.unset("spark.sql.caseSensitive")


def test_sampled_scores(spark):
    df = spark.range(4_000).selectExpr(
        "CAST(id AS DOUBLE) AS x", "id * 2D + rand(1) AS y", "IF(id < 2000, 'low', 'high') AS c")
    a = analyze(df, sample_size=300)
    assert a.scatter_rows[0].n == 300 and a.scatter_rows[0].r == pytest.approx(1, abs=1e-3)
    assert a.cat_num_rows[0].n == 300


def test_written_report(spark, parcels, tmp_path):
    out = str(tmp_path / "report")
    a = analyze(parcels, max_items=8)
    write_report(a, out)
    manifest = spark.read.parquet(f"{out}/manifest")
    assert manifest.count() == 8 and "section" in manifest.columns
    assert spark.read.parquet(f"{out}/00_summary/summary").count() == 6
    assert spark.read.parquet(f"{out}/01_univariate_numeric_distributions/dists").count() == a.dists.count()
    assert not (tmp_path / "report" / "07_cat_vs_cat").exists()
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        write_report(a, out)
    write_report(a, str(tmp_path / "json"), "json")
    assert spark.read.json(f"{tmp_path}/json/columns").count() == 11


def test_tables_all_run(parcels):
    small = parcels.select("distance", "cost", "zone", "service")
    tables = analyze(small).tables()
    assert len(tables) == 18
    for name, df in tables.items():
        assert df.count() >= (0 if name == "missing" else 1), name
    assert not math.isnan(tables["scatters"].first().r)


def test_only_finished_reports_are_read(spark, parcels, tmp_path, monkeypatch):
    out = str(tmp_path / "report")
    small = parcels.select("distance", "cost", "zone")
    with pytest.raises(ValueError, match="no finished report"):
        read_report(spark, out)
    a = analyze(small)
    write_report(a, out)
    first = {n: t.count() for n, t in read_report(spark, out).items()}
    assert first["manifest"] == a.manifest.count() and first["summary"] == 2 and first["columns"] == 3
    # a second report over the first one breaks off half way
    b = analyze(small.limit(50))
    monkeypatch.setattr(type(b), "boxplots", property(lambda self: 1 / 0))
    with pytest.raises(ZeroDivisionError):
        write_report(b, out, mode="overwrite")
    with pytest.raises(ValueError, match="no finished report"):
        read_report(spark, out)
    monkeypatch.undo()
    write_report(analyze(small.limit(50)), out, mode="overwrite")
    assert read_report(spark, out)["overview"].first()["rows"] == 50
