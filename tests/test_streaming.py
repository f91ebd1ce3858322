"""The stream of lines, run to what is there and run again."""

from caselake.streaming import ingest


def test_lines_arrive_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text('{"timestamp": "2024-01-01T00:00:00Z"}\nbroken\n{"timestamp": "2024-01-01T00:00:00Z"}\n')
    run = lambda: ingest.appended(ingest.once(ingest.new_lines(spark, str(tmp_path / "in"))).drop("value"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    assert run()
    assert sorted(r.status for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["PARSED", "UNPARSED"]
    (tmp_path / "in" / "b.jsonl").write_text('{"timestamp": 1704067300}\n')
    assert run()
    assert sorted(r.status for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["PARSED", "PARSED", "UNPARSED"]


def test_counts_by_window(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text("".join(f'{{"timestamp": {1704067200 + 100 * i}}}\n' for i in range(6)) + "x\n")
    q = ingest.counts(ingest.new_lines(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert sorted(r.n for r in spark.table("windows").collect()) == [3, 3]
