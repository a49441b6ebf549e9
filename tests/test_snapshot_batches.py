from tidemark.sources import listing, snapshots


def test_long_documents_go_on_by_their_size(spark, tmp_path, monkeypatch):
    """Documents without indentation are handed on by what they hold, not by thousands."""
    monkeypatch.setattr(snapshots, "HELD_CHARS", 1000)
    (tmp_path / "a.json").write_text("".join('{"entries":{"p%d":"%s"}}\n' % (i, "x" * 600) for i in range(10)))
    sizes = []

    class Lines:
        def mapInArrow(self, run, _):  # noqa: N802
            batch = spark.read.text(str(tmp_path)).selectExpr("'f' AS file", "0L AS block", "value").toArrow().to_batches()
            sizes.extend(b.num_rows for b in run(iter(batch)))

    monkeypatch.setattr(snapshots, "_lines", lambda *_: Lines())
    snapshots.read_pieces(spark, str(tmp_path))
    assert sum(sizes) == 11 and max(sizes) <= 2


def test_files_are_listed_in_tasks(spark, tmp_path, monkeypatch):
    """No reader of Spark's, whose list of files the driver holds, and the lines that it would give, whatever the splits."""
    for w, sep in (("w1", "\n"), ("w2", "\r\n"), ("x3", "\n")):
        (tmp_path / w / ".ledger").mkdir(parents=True)
        (tmp_path / w / ".ledger" / "snapshot.json").write_bytes(sep.join(["\ufeff{", '  "entries": {', '    "é": {', '      "a": 1', "    }", "  }", "}", "x" * 50, ""][: 8 if w == "w1" else 9]).encode())
        (tmp_path / w / ".ledger" / "_passed.json").write_text("no")
        (tmp_path / w / "other.json").write_text("no")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7")
    try:
        for glob in ("w*/.ledger/*.json", "{w1,x?}/.led[a-g]er/snapshot.json", "w1/.ledger", "w1/.ledger/snapshot.json", "[^x]*/.ledger/*"):
            want = sorted(r.value for r in spark.read.option("lineSep", "\n").text(f"{tmp_path}/{glob}").collect())
            with monkeypatch.context() as m:
                m.setattr(type(spark), "read", property(lambda s: _parquet_only(s)))
                rows = snapshots._lines(spark, f"file:{tmp_path}/{glob}").collect()
            assert rows and all(r.value <= 7 for r in rows)
            assert sorted(line for r in rows for *_, line in listing.split_lines(*r)) == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def _parquet_only(spark):
    from pyspark.sql import DataFrameReader

    class Reader(DataFrameReader):
        def text(self, *_, **__):
            raise AssertionError("files listed by the driver")

    return Reader(spark)
