"""Files in, tables out."""

import pytest
from pyspark.sql import functions as F

from fieldseries import Panel
from fieldseries.functions.cleaning import binary_half_even, coerce_numeric, normalize_name, repair_numeric, snake_name
from fieldseries.panel import check_panel
from fieldseries.schema import SOURCE_COLUMNS, WEATHER_VARIABLES
from fieldseries.sources import readers
from fieldseries.sources.sinks import params_json, write_experiment, write_runs


def write_year(folder, name, first_day, n, gap=False, columns=16):
    lines = [",".join(f"any {i}" for i in range(columns))]
    for i in range(n):
        day = first_day + i + (1 if gap and i > 50 else 0)
        cells = ["1900", str(day), '" 1,5"', '"б,2"', "", "1", *["2"] * 10]
        lines.append(",".join(cells[:columns]))
    (folder / name).write_text("\n".join(lines) + "\n", encoding="utf-8")


def test_year_files(spark, tmp_path):
    write_year(tmp_path, "1972.csv", 153, 92)
    write_year(tmp_path, "G1973.csv", 152, 100)
    write_year(tmp_path, "1974.csv", 152, 92, gap=True, columns=9)
    write_year(tmp_path, "notes2000.csv", 152, 92)
    df = readers.read_year_files(spark, str(tmp_path))
    per_year = {r.year: r for r in df.groupBy("year").agg(F.count("*").alias("n"), F.min("day").alias("a"), F.max("day").alias("b")).collect()}
    assert {y: (r.n, r.a, r.b) for y, r in per_year.items()} == {1972: (92, 153, 244), 1973: (92, 152, 243), 1974: (92, 152, 243)}
    row = df.where("year = 1972").first()
    assert (row.t_min, row.t_max, row.is_rain, row.target_favorable) == (1.5, 6.2, None, 1)
    assert df.where("year = 1974").first().precipitation is None
    assert df.columns == SOURCE_COLUMNS
    weather = readers.read_weather(spark, str(tmp_path), year_files=True)
    assert {r.year for r in weather.select("year").distinct().collect()} == {1972, 1973, 1974, 2000}
    assert weather.first()["is_rain"] == 0.0 and weather.columns == ["year", "day", *WEATHER_VARIABLES]


def test_named_tables(spark, tmp_path):
    path = tmp_path / "flat.csv"
    path.write_text(",Day,T min,T-max,T avg,Precipitation,Is rain,Cloudiness,Target_Favorable,t>10\n"
                    "2000,152,1,2,3,4,-,6,2.5,1\n2000,153,1,2,3,4,1,6,,1\n", encoding="utf-8")
    df = readers.read_named(spark, str(path))
    row = df.collect()
    assert len(row) == 1 and (row[0].year, row[0].t_min, row[0].target_favorable) == (2000, 1.0, 1)
    assert row[0].y1 is None and row[0].t_gt_10 == 1.0
    broken = tmp_path / "broken.csv"
    broken.write_text("year,day\n2000,1\n")
    with pytest.raises(ValueError, match="missing"):
        readers.read_named(spark, str(broken))
    with pytest.raises(ValueError, match="missing"):
        readers.read_weather(spark, str(broken))


def test_simple_files(spark, tmp_path):
    for year in (1990, 1991):
        (tmp_path / f"{year}.csv").write_text('day,target_favorable,"t>10"\n150.9,1,б1\n,1,2\n151,,3\n', encoding="utf-8")
    df = readers.read_simple(spark, str(tmp_path))
    got = {(r.year, r.day, r.target_favorable, r.t_gt_10) for r in df.collect()}
    assert got == {(y, d, t, v) for y in (1990, 1991) for d, t, v in ((150, 1.0, None), (151, None, 3.0))}


def test_numbers(spark):
    cells = [" 1,5", " 2.5 ", "б1", "-", "", "nan", "1.0d", "0x1p3", "inf", "1_0", "+.5", "1e3", "5."]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string")
    rows = df.orderBy("i").select(repair_numeric(F.col("c")).alias("r"), coerce_numeric(F.col("c")).alias("b")).collect()
    assert [r.r for r in rows] == [1.5, 2.5, 61.0, None, None, None, None, None, None, None, 0.5, 1000.0, 5.0]
    assert rows[0].b is None and rows[2].b is None and rows[11].b == 1000.0
    halves = spark.createDataFrame([(0.5,), (1.5,), (-0.6,), (2.5,)], "v double")
    assert [r[0] for r in halves.select(binary_half_even(F.col("v"))).collect()] == [0.0, 1.0, 0.0, 1.0]


def test_names():
    assert normalize_name(" T min-2 (C) ") == "t_min_2_c" and normalize_name("t>10") == "t_10"
    assert normalize_name("t>10", gt_word=True) == "t_gt_10" and snake_name("Осадки, t>10") == "осадки_t_gt_10"


def test_panel_check(spark):
    df = spark.createDataFrame([(2000, 1), (2000, 2)], "year int, day int")
    assert check_panel(df, Panel()).count() == 2
    with pytest.raises(ValueError, match="Not a panel"):
        check_panel(df.union(df), Panel())


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "runs")
    write_runs(spark.createDataFrame([(1, "a")], "v int, run_id string"), path)
    write_runs(spark.createDataFrame([(2, "b")], "v int, run_id string"), path)
    write_runs(spark.createDataFrame([(3, "a")], "v int, run_id string"), path)
    assert {(r.v, r.run_id) for r in spark.read.parquet(path).collect()} == {(3, "a"), (2, "b")}
    table = params_json(spark.createDataFrame([(1, "x", 0.5)], "seq int, model string, c double"), ["model", "c"])
    assert table.collect()[0].best_params == '{"model":"x","c":0.5}'
    write_experiment({"metrics": table}, str(tmp_path / "out"), "r1")
    assert spark.read.parquet(str(tmp_path / "out" / "metrics")).count() == 1


def test_committed_runs_are_sorted_and_whole(spark, tmp_path):
    from fieldseries.sources.sinks import commit_run, committed_runs, read_committed

    path = str(tmp_path / "exp")
    rows = spark.createDataFrame([(k, f"m{k % 4}") for k in range(200, 0, -1)], "seq long, model string")
    commit_run({"predictions": rows, "metrics": rows.groupBy("model").count()}, path, "r1", {"predictions": ["seq"]})
    rows.write.parquet(f"{path}/predictions/run_id=r2")  # stopped before its marker
    assert committed_runs(spark, path) == ["r1"]
    got = read_committed(spark, path, "predictions", "seq long, model string")
    assert got.count() == 200 and {r.run_id for r in got.collect()} == {"r1"}
    files = sorted((tmp_path / "exp" / "predictions" / "run_id=r1").glob("*.parquet"))
    firsts = [spark.read.parquet(str(f)).collect() for f in files]
    seqs = [r.seq for part in firsts for r in part]
    assert seqs == sorted(seqs)
    commit_run({"predictions": rows.limit(5)}, path, "r1", {"predictions": ["seq"]})
    assert read_committed(spark, path, "predictions").count() == 5
