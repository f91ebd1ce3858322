"""Operators on hand-written rows, one test a trap, and the catalogue against its SQL on the smallest tables."""

import gzip
import json
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from caselake.functions import reading
from caselake.operators import events as ev
from caselake.operators import graph, retrieval
from caselake.plans import catalog
from caselake.sources import jsonl

DATA = "/root/testdata/sf0.001"


def test_anchor_does_not_move_with_a_duplicate(spark):
    rows = spark.createDataFrame([("a", 0), ("a", 15), ("a", 30), ("b", 30), ("b", 50), ("b", 51)], "key string, o long")
    nulls = spark.createDataFrame([(None, 0), (None, 1), (None, 2), (1, 0), (1, 1)], "key int, o int")
    assert sorted((r.key or 0, r.o, r.duplicate) for r in ev.anchored_duplicates(nulls, ["key"], "o", 20).collect()) == [(0, 0, False), (0, 1, True), (0, 2, True), (1, 0, False), (1, 1, True)]
    got = {(r.key, r.o): r.duplicate for r in ev.anchored_duplicates(rows, ["key"], "o", 20).collect()}
    assert got == {("a", 0): False, ("a", 15): True, ("a", 30): False, ("b", 30): False, ("b", 50): True, ("b", 51): False}


def test_merge_takes_values_that_are_not_null(spark):
    rows = spark.createDataFrame([(1, 1, None, "x"), (1, 2, "a", "y"), (1, 3, "b", None)], "k int, o int, f string, l string")
    assert ev.merged(rows, ["k"], F.col("o"), ["f"], ["l"]).first().asDict() == {"k": 1, "first_f": "a", "last_l": "y"}


def test_contradiction_needs_no_fix_between(spark):
    make = lambda rows: spark.createDataFrame(rows, "id int, k int, o int")
    got = ev.contradictions(make([(1, 7, 10)]), make([(2, 7, 20), (3, 7, 40), (4, 8, 20), (5, 7, 5)]), make([(9, 7, 30)]), ["k"], "o")
    assert [(r.failure_id, r.report_id) for r in got.collect()] == [(1, 2)]


def test_neighbors_end_on_cycles_and_refuse_many_hops(spark):
    edges = spark.createDataFrame([("a", "b", "t"), ("b", "c", "t"), ("c", "a", "t"), ("c", "d", "t")], "src string, dst string, type string")
    assert {(r.node, r.depth) for r in graph.neighbors(edges, "a", 8, "out").collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}
    with pytest.raises(ValueError):
        graph.neighbors(edges, "a", 9)


def test_identity_ignores_order(spark):
    rows = [("a", "b", "t"), ("b", "c", "t"), ("x", "y", "u")]
    make = lambda r: graph.identity(spark.createDataFrame(r, "src string, dst string, type string")).first()
    assert make(rows) == make(rows[::-1])
    assert make(rows)[0] != make(rows[:2])[0]


def test_phrases_and_terms(spark):
    rows = spark.createDataFrame([(1, "Fix THE parser now"), (2, "parser: the fix"), (3, None)], "id int, text string")
    assert [r.id for r in retrieval.lexical(rows, ["the parser"]).collect()] == [1]
    assert sorted(r.id for r in retrieval.lexical(rows, ["the", "fix"]).collect()) == [1, 2]


def test_preview_and_chunks(spark):
    rows = spark.createDataFrame([(1, "x" * 1201), (2, "short"), (3, "")], "id int, text string")
    got = {r.id: r.p for r in rows.select("id", reading.elided(F.col("text")).alias("p")).collect()}
    assert got[2] == "short" and got[1] == "x" * 840 + "\n…[1 chars omitted from projection; raw evidence retained]…\n" + "x" * 360
    assert sorted((r.id, r.chunk, len(r.content)) for r in retrieval.fixed_chunks(rows.union(spark.createDataFrame([(4, "y" * 1700)], "id int, text string")), "id", "text").collect()) == [(1, 0, 1201), (2, 0, 5), (3, 0, 0), (4, 0, 1600), (4, 1, 300)]


def test_lines_and_strict_json(spark, tmp_path):
    rows = ['{"a": 1}', "", '{"a": 1} x', '{"a":1}{"b":2}', "null", "[1, 2]"]
    with gzip.open(tmp_path / "s.jsonl.gz", "wt") as f:
        f.write("\n".join(rows) + "\n")
    got = jsonl.accounted(jsonl.lines(spark, str(tmp_path))).orderBy("ordinal").collect()
    assert [r.line for r in got] == rows
    assert [r.status for r in got] == ["PARSED", "UNPARSED", "UNPARSED", "UNPARSED", "PARSED", "PARSED"]
    assert [r.byte_offset for r in got] == [sum(len(x) + 1 for x in rows[:i]) for i in range(len(rows))]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_catalogue_against_sql(spark, name):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    want = con.execute(catalog.ORACLES[name])
    names = [d[0] for d in want.description]
    rows = catalog.QUERIES[name](spark, DATA)
    assert sorted(rows.columns) == sorted(names)
    text = lambda cols, values: sorted(json.dumps(dict(zip(cols, v, strict=True)), sort_keys=True, default=str) for v in values)
    assert text(rows.columns, rows.collect()) == text(names, want.fetchall())
