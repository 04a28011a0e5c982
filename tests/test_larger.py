"""What differed from SQL, or took too long, on larger tables and odd rows."""

import glob
import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom import registry
from quantloom import schema as S
from quantloom.functions import predicates
from quantloom.operators import ibaq, impute, quantify


@pytest.fixture(scope="module")
def odd(sf, tmp_path_factory):
    """The smallest tables; some documents without letters, without letters that weigh, or null."""
    d = tmp_path_factory.mktemp("odd")
    c = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        if "documents" not in p:
            os.symlink(p, d / os.path.basename(p))
    c.execute(f"copy (select * replace (case doc_id when 1 then '' when 2 then '12 !' when 3 then 'xo' when 4 then null else text end as text) from '{sf}/documents.parquet') to '{d}/documents.parquet'")
    return str(d)


@pytest.mark.parametrize("name", ["ibaq_standalone", "tpa", "proteomic_ruler", "proteomic_ruler_histone_names", "group_theory", "ibaq_norm_log_ppb", "ibaq_pipeline"])
def test_proteins_without_letters_match_sql(spark, odd, name):
    c = duckdb.connect()
    for p in glob.glob(f"{odd}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    df = registry.QUERIES[name](spark, odd)
    cols = sorted(df.columns)
    rel = c.sql(registry.ORACLE_SQL[name])
    at = [rel.columns.index(x) for x in cols]
    assert sorted(repr([r[x] for x in cols]) for r in df.collect()) == sorted(repr([r[i] for i in at]) for r in rel.fetchall())


def test_theory_of_odd_sequences(spark):
    got = {r[0]: (r[1], r[2]) for r in ibaq.theoretical(spark.createDataFrame([("a", ""), ("b", "XO"), ("c", None)], "accession string, sequence string")).collect()}
    assert got == {"a": (0, 18.010565), "b": (0, 18.010565), "c": (None, None)}


def test_rounding_is_that_of_the_sql(spark):
    xs = [1051014.7294999999, 737545.6495, 0.5, -2.0005, 18.010565, 1e-9, 0.0]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(registry.half_away("x", 3)).collect()]
    c = duckdb.connect()
    assert got == [c.execute("select round(?::DOUBLE, 3)", [x]).fetchall()[0][0] for x in xs]


def test_methods_compare_all_rows_of_sums_that_waver(spark):
    waver = F.udf(lambda x: x * (1 + random.random() * 1e-12), "double").asNondeterministic()
    df = spark.range(2000).select(F.concat(F.lit("P"), F.col("id").cast("string")).alias(S.PROTEIN), F.lit("s").alias(S.SAMPLE), (F.col("id") % 997 + 1).cast("double").alias("v"))
    got = quantify.compare_methods(df.withColumn("v", waver("v")), df.select(S.PROTEIN, S.SAMPLE, F.col("v").alias("w")), "v", "w").first()
    assert got["n"] == 2000
    assert got["pearson"] == pytest.approx(1, abs=1e-9) and got["spearman"] == pytest.approx(1, abs=1e-4)


def test_methods_compare_ties_and_nulls(spark):
    data = [(i, [None, 0.0, 0.0, 5.0, float(i)][i % 5], float((i * 7919) % 31)) for i in range(1000)]
    data = [(i, x, None if x is None else y) for i, x, y in data]
    df = spark.createDataFrame(data, "i long, v double, w double").withColumn(S.PROTEIN, F.col("i").cast("string")).withColumn(S.SAMPLE, F.lit("s"))
    got = quantify.compare_methods(df.select(S.PROTEIN, S.SAMPLE, "v"), df.select(S.PROTEIN, S.SAMPLE, "w"), "v", "w").first()
    c = duckdb.connect()
    c.execute("create table t (i bigint, v double, w double)")
    c.executemany("insert into t values (?, ?, ?)", data)
    sql = "with c as (select log2(v + 1) as x, log2(w + 1) as y from t), r as (select *, rank() over (order by x) + (count(*) over (partition by x) - 1) / 2.0 as rx, rank() over (order by y) + (count(*) over (partition by y) - 1) / 2.0 as ry from c) select corr(x, y), corr(rx::double, ry::double), avg(abs(x - y)), count(*) from r"
    assert tuple(got) == pytest.approx(c.sql(sql).fetchall()[0], abs=1e-9)


@pytest.mark.parametrize("scale", [1.0, 1e6])
def test_nearest_rows_are_those_of_all_pairs(monkeypatch, scale):
    monkeypatch.setattr(impute, "ASKING", 7)
    monkeypatch.setattr(impute, "DONORS", 64)
    r = np.random.default_rng(1)
    y = r.integers(0, 4, (600, 6)) * scale + (0 if scale == 1 else r.random((600, 6)))
    y[r.random(y.shape) < 0.3] = np.nan
    x, y = np.concatenate([y[:100], np.full((1, 6), np.nan)]), y[np.isfinite(y[:, 0])]
    i, j, d = impute.nearest(x, y, 5)
    for k in range(len(x)):
        diff = y - x[k]
        shared = np.isfinite(diff).sum(axis=1)
        full = np.where(shared > 0, np.sqrt(6 / np.maximum(shared, 1) * np.nansum(diff * diff, axis=1)), np.inf)
        best = [z for z in np.argsort(full, kind="stable")[:5] if np.isfinite(full[z])]
        assert j[i == k].tolist() == best and d[i == k] == pytest.approx(full[best])


def test_neighbours_meet_once_in_many_blocks(spark):
    r = np.random.default_rng(2)
    data = [(f"r{a:03}", f"c{b}", float(r.random())) for a in range(300) for b in range(4) if r.random() < 0.8]
    df = spark.createDataFrame(data, "r string, c string, x double")
    few, many = (sorted(map(tuple, impute.neighbours(df, "x", "r", "c", 3, block).collect())) for block in (1024, 1))
    assert few == many and len(few) > 100


@pytest.mark.parametrize("values", [4, 1000])
def test_trees_find_the_nearest_of_all_pairs(monkeypatch, values):
    monkeypatch.setattr(impute, "LEAF", 8)
    monkeypatch.setattr(impute, "ASKING", 16)
    r = np.random.default_rng(3)
    y = r.integers(0, values, (600, 5)).astype(float)
    y[r.random(y.shape) < 0.25] = np.nan
    x = y[:100]
    i, c, j, d = impute.Donors(y).nearest(x, np.where(np.isfinite(x), -1.0, np.inf), 5)
    for a, k in zip(*np.nonzero(np.isnan(x)), strict=True):
        diff = y - x[a]
        shared = np.isfinite(diff).sum(axis=1)
        full = np.where((shared > 0) & np.isfinite(y[:, k]), np.sqrt(5 / np.maximum(shared, 1) * np.nansum(diff * diff, axis=1)), np.inf)
        best = [z for z in np.argsort(full, kind="stable")[:5] if np.isfinite(full[z])]
        here = (i == a) & (c == k)
        assert j[here].tolist() == best and d[here] == pytest.approx(full[best])


def test_rows_meet_only_cells_within_reach():
    r = np.random.default_rng(4)
    y = r.random((4000, 3))
    cells = impute.Cells(y, {7: (np.ones(3, bool), len(y))}, 0, 16)
    sizes = np.bincount(cells.of(y, np.zeros(len(y), np.int64)))
    assert sizes[0] == 0 and len(sizes) > 60 and sizes[1:].min() > 0 and sizes.max() <= 64


def test_many_ids_are_looked_up_not_compared_with_every_row(spark):
    names = [("P1;ANT_P12",), ("ANT_P1",), ("ant_p1",), ("xANT_P77y",), ("",), ("é😀ANT_P5",), (None,), ("P",)]
    ids = spark.createDataFrame([("ANT_P12",), (" ANT_P77 ",), ("😀ANT",), ("",), (None,), ("a much longer id than any name here",)], "id string")
    df = spark.createDataFrame(names, f"{S.PROTEIN} string")
    got = predicates.without_ids(df, ids, most_inline=1)
    assert {r[0] for r in got.collect()} == {"ANT_P1", "ant_p1", "", None, "P"}
    assert "NestedLoop" not in got._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", ["proteomic_ruler_histone_names", "peptides_to_proteins"])
def test_numbers_that_read_like_accessions_are_no_histones(spark, sf, tmp_path, name):
    d, c = str(tmp_path), duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        if "documents" not in p and "lineitem" not in p:
            os.symlink(p, f"{d}/{os.path.basename(p)}")
    c.execute(f"copy (select * replace (case doc_id when 5 then 16104 else doc_id end as doc_id) from '{sf}/documents.parquet') to '{d}/documents.parquet'")
    c.execute(f"copy (select * replace (case l_suppkey when 5 then 16104 else l_suppkey end as l_suppkey) from '{sf}/lineitem.parquet') to '{d}/lineitem.parquet'")
    for p in glob.glob(f"{d}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    df = registry.QUERIES[name](spark, d)
    cols = sorted(x for x in df.columns if x.startswith("log") or x in (S.PROTEIN, S.SAMPLE, S.CONDITION))
    rel = c.sql(registry.ORACLE_SQL[name])
    at = [rel.columns.index(x) for x in cols]
    got, want = sorted(repr([r[x] for x in cols]) for r in df.collect()), sorted(repr([r[i] for i in at]) for r in rel.fetchall())
    assert "P16104" in str(want) and got == want
