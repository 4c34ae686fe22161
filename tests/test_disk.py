"""What queries leave on disk, and that forecasts sum cells without a row for each step."""

import time

import pytest
from pyspark.sql import functions as F
from test_lookup import most_rows, rows

from causeway.llm import _io, suffix_dedup
from causeway.operators import forecast, graph
from causeway.sources import writers


def shuffled(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for k in range(files.size()) if (name := files.apply(k).getName()).startswith("shuffle_")}


@pytest.mark.parametrize("write", [writers.write_table, _io.keep])
def test_a_written_table_leaves_no_shuffle_files(spark, write):
    before, setting = shuffled(spark), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    kept = spark.range(50_000).groupBy((F.col("id") % 7919).alias("k")).agg(F.count("*").alias("n"))
    table = write(kept, "counts")
    until = time.time() + 20  # files go in the background
    while shuffled(spark) - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffled(spark) - before
    assert table.agg(F.sum("n")).first()[0] == 50_000 and kept.count() == 7919
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == setting


def test_a_filter_leaves_no_shuffle_files(spark):
    before = shuffled(spark)
    suffix_dedup._filter(suffix_dedup._repeated(spark.range(20_000).selectExpr("id % 9973 gram"))).unpersist()
    until = time.time() + 20
    while shuffled(spark) - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffled(spark) - before


def chain(spark, n, steps):
    """n causes, each of which moves each of n effects by a hundredth of its own move."""
    cells = spark.range(n).crossJoin(spark.range(n).toDF("to")).selectExpr("0 draw", "concat('a', id) src", "concat('b', to) dst", "0.01D value")
    names = cells.selectExpr("src name").union(cells.selectExpr("dst")).distinct()
    state = names.selectExpr("name", "1.0D x0", "case when name like 'a%' then 2.0D else 0.0D end d0")
    return cells, state, forecast.displacements(state, steps)


def test_a_cell_is_one_row_for_all_steps(spark):
    cells, state, disp = chain(spark, 40, 9)
    out = forecast.linear_forecast(cells, state, disp)
    assert most_rows(out) <= 40 * 40 + 2 * 40
    assert {(r.name[0], r.step, round(r.value, 6)) for r in out.collect()} == {(k, t, round(1 + 2.0 * t * (1 if k == "a" else 0.4), 6)) for k in "ab" for t in range(10)}


def test_forecasts_of_many_steps_and_of_nodes_without_moves(spark):
    cells, state, disp = chain(spark, 2, 130)
    disp = disp.where("name <> 'b1' AND step <> 64")
    out = {(r.name, r.step): round(r.value, 6) for r in forecast.linear_forecast(cells, state, disp).collect()}
    assert out == {(k, t): round(1 + t * (2.0 if k[0] == "a" else 0.04), 6) for k in ("a0", "a1", "b0", "b1") for t in range(131) if t != 64}
    clamps = spark.createDataFrame([("a0", 100, 5.0), ("b1", 100, 7.0), ("b0", 3, 9.0)], "name string, step int, value double")
    out = {(r.name, r.step): round(r.value, 6) for r in forecast.derivative_clamp(cells, state, disp, clamps, 130, True).collect()}
    assert out["a0", 99] == 199 and out["a0", 101] == 5
    assert out["b0", 2] == 1.08 and ("b1", 64) not in out


def test_no_displacements_no_rows(spark):
    cells, state, disp = chain(spark, 2, 3)
    assert rows(forecast.linear_forecast(cells, state, disp.limit(0))) == []


def test_statement_files_are_compressed(spark, tmp_path, monkeypatch):
    from causeway.plans import registry

    monkeypatch.setattr("causeway.plans.files.fresh_path", lambda spark, name: f"{tmp_path}/{name}")
    n = registry.queries()["a8_read_statements_jsonl"](spark, "/root/testdata/sf0.001").count()
    size = sum(f.stat().st_size for f in tmp_path.rglob("part-*"))
    assert n == spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    assert 0 < size < 60 * n  # a statement is over 400 bytes of JSON


def ladder(spark, n):
    """v0, v1, ...: each leads to the next two."""
    return spark.range(n).selectExpr("concat('v', id) src", "explode(array(concat('v', id + 1), concat('v', id + 2))) dst")


def test_each_length_of_paths_is_written_once(spark, monkeypatch):
    written = []
    monkeypatch.setattr(graph, "write_table", lambda df, name, path=None: written.append(name) or writers.write_table(df, name, path))
    cells = graph.cell_values(ladder(spark, 11).selectExpr("src", "dst", "atan(1.0D) theta"), ())
    got = {(r.src, r.dst): round(r.value, 6) for r in cells.collect()}
    ways = [1, 1]
    while len(ways) < 13:
        ways.append(ways[-1] + ways[-2])
    last = {(f"v{a}", "v12"): ways[10 - a] for a in range(11)}  # v11 leads nowhere
    assert got == {(f"v{a}", f"v{b}"): ways[b - a] for a in range(11) for b in range(a + 1, 12)} | last
    assert written.count("cells") == 12 and "rounds" not in written


def test_prune_of_deep_graphs(spark):
    deep = ladder(spark, 11)
    assert rows(graph.prune_acyclic(deep.union(spark.createDataFrame([("v0", "v5")], "src string, dst string")), 2)) == rows(deep)
