"""The stages on planted documents, each decision checked against what was planted."""

import random

import corpus_pipeline

from .test_text_ops import prose


def test_stages_act_on_what_was_planted(spark, rows, tmp_path):
    rng = random.Random(1)
    bench = [(i, " ".join(prose(500 + i, 35))) for i in range(5)]
    clean = {i: " ".join(prose(i, 150, 9000)) for i in range(20)}
    passage = prose(777, 60)
    docs = dict(clean)
    docs |= {100: "too short", 101: "abc bcd cde " * 100, 102: " ".join(w + "###" for w in prose(3000, 90))}
    docs |= {110: clean[3], 111: " ".join(w if i != 70 else "edit" for i, w in enumerate(clean[4].split()))}
    docs |= {120: clean[5][:300] + " unlike " + " ".join(prose(881, 100, 9000)) + " " + " ".join(passage), 121: " ".join(prose(882, 100, 9000) + passage)}
    docs |= {130: " ".join(prose(883, 100, 9000)) + "\n" + bench[2][1]}
    table = [(i, t, "en", f"s{rng.randrange(3)}", len(t)) for i, t in docs.items()]
    rows(table, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    rows(bench, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, str(tmp_path))
        assert out.columns == now.columns and out.dtypes == now.dtypes
        out.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        seen.append({r.doc_id: r.text for r in now.collect()})
    rules, dedup, cut, final = seen
    assert set(docs) - set(rules) == {100, 101, 102}
    assert set(rules) - set(dedup) == {110, 111}
    assert set(cut) == set(dedup) and " ".join(passage) in cut[120] and passage[30] + " " + passage[31] not in cut[121]
    assert set(cut) - set(final) == {130}
    assert all(final[i] == t for i, t in clean.items())
    pieces = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in pieces.collect()} == set(final)


def test_stages_take_hard_rows(spark, rows, tmp_path):
    """Nulls in any column, empty and blank texts, repeated rows and ids, a very long text, no rows at all."""
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    good = {i: " ".join(prose(60 + i, 120, 9000)) for i in range(4)}
    long = " ".join(prose(99, 30_000, 90_000))
    table = [(i, t, "en", "s", len(t)) for i, t in good.items()] + [(0, good[0], "en", "s", len(good[0])), (2, good[3], None, None, None), (None, good[1], "en", "s", 1), (7, None, "en", "s", None), (8, "", None, "s", 0), (9, " \n\t ", "en", None, 4), (10, long, "en", "s", len(long))]
    bench = "item_id bigint, text string"
    for name, data in (("some", table), ("none", [])):
        folder = tmp_path / name
        rows(data, schema).write.parquet(str(folder / "documents.parquet"))
        rows([(1, " ".join(prose(4444, 30))), (2, None), (None, "")], bench).write.parquet(str(folder / "benchmark.parquet"))
        pieces = corpus_pipeline.run(spark, str(folder)).collect()
        # A copy without an id is in no group and stays; the copy that shares id 2 is in the group of 3, whose smallest id is 2.
        assert {r.doc_id for r in pieces} == ({0, 1, 2, 10, None} if data else set())
    now = spark.read.parquet(str(tmp_path / "some/documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, str(tmp_path / "some"))
        assert out.dtypes == now.dtypes
        # Who stays, stays whole, but for the text of 3, which a row of 2 holds too.
        whole = {(i, t) for i, t, *_ in table} | {(3, "")}
        assert {(r.doc_id, r.text) for r in out.collect()} <= whole
