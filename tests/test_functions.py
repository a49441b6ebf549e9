import pytest
from pyspark.sql import functions as F

from tidemark.functions import content as fc
from tidemark.functions import paths as fp
from tidemark.functions import status as fs


def each(rows, schema, data, make):
    """The values of a column built from literal rows, in order."""
    df = rows([(i, *r) for i, r in enumerate(data)], "i int, " + schema)
    return [r[0] for r in df.select("i", make().alias("v")).orderBy("i").select("v").collect()]


def test_paths(rows):
    cases = [("runs/run-1", "runs/run-1", True), ("runs/run-10", "runs/run-1", False), ("runs/run-1/a", "runs/run-1", True), ("x", "", True), ("a%b/c", "a_b", False)]
    assert each(rows, "p string, q string", [c[:2] for c in cases], lambda: fp.under_prefix(F.col("p"), F.col("q"))) == [c[2] for c in cases]
    cases = {"a/../b": "b", "../../x": "x", "a/./b//c": "a/b/c", "..": "", "": ""}
    assert each(rows, "p string", [(c,) for c in cases], lambda: fp.confine(F.col("p"))) == list(cases.values())
    cases = {"a/b": "a_b", "..": "_", "": "_", "x\ty": "x_y", "a.b": "a.b", "a\\b": "a_b"}
    assert each(rows, "p string", [(c,) for c in cases], lambda: fp.sanitize_segment(F.col("p"))) == list(cases.values())
    cases = {"a/b": True, "/a": False, "a/": False, "a/../b": False, "a\\b": False, ".": False}
    assert each(rows, "p string", [(c,) for c in cases], lambda: fp.is_valid_path(F.col("p"))) == list(cases.values())
    cases = {"projects/p/workspaces/w/runs/r/run.json": "projects/p/workspaces/w", "projects/p/stacks/s": "projects/p/stacks/s", "config-versions/x": "config-versions", "teams/t.json": "", "projects/p": ""}
    assert each(rows, "p string", [(c,) for c in cases], lambda: fp.shard_key(F.col("p"))) == list(cases.values())
    cases = {"logs.gen0002.zip": 2, "logs.gen10000.zip.sidecar.ndjson": 10000, "state.gen0001.zip": 0, "x": 0}
    assert each(rows, "p string", [(c,) for c in cases], lambda: fp.bundle_generation(F.col("p"), "logs")) == list(cases.values())
    cases = {"projects/p/workspaces/w/runs/r/plan.log": "heavy", "projects/p/workspaces/w/runs/r/policy-check-9.log": "heavy", "projects/p/workspaces/w/runs/r/comments.json": "comments.ndjson", "projects/p/workspaces/w/state-versions/s.json": "state_blob", "projects/p/workspaces/w/state-versions/s.meta.json": "state_meta", "x/run.json": "other"}
    assert each(rows, "p string", [(c,) for c in cases], lambda: fp.artifact_class(F.col("p"))) == list(cases.values())


def test_names_of_an_archives_own_files(rows):
    w = "projects/p/workspaces/w/"
    cases = {w + "bundles/a.zip": True, w + "rollups/x.ndjson": True, "projects/p/stacks/s/bundles/a.zip": False, "projects/p/workspaces/bundles/x.json": False, ".remote.json": True, w + ".identity.json": True, w + ".ledger/log.ndjson": True, w + ".atomicfile-12.tmp": True, w + "notes.tmp": False, "config-versions/a.tar.gz.remote.json": False}
    assert each(rows, "p string", [(c,) for c in cases], lambda: fp.is_machinery(F.col("p"))) == list(cases.values())
    cases = {"config-versions/a.tar.gz.remote.json": "config-versions/a.tar.gz", "x/a.tar.gz.remote.json": None, "config-versions/a.json.remote.json": None, "config-versions/a.tar.gz": None}
    assert each(rows, "p string", [(c,) for c in cases], lambda: fp.stub_target(F.col("p"))) == list(cases.values())
    cases = {"pol-1.sentinel": "pol-1", "x y.rego": "x y", "pol.tf": "pol", "a.b.policy": "a.b", "pol-1.20240101T000000Z.rego": None, "pol-1.json": None, "pol-1": None}
    assert each(rows, "p string", [(c,) for c in cases], lambda: fp.policy_source_id(F.col("p"))) == list(cases.values())
    cases = {w + "state-versions/20240102T030405Z-sv-1.tfstate.json": "20240102T030405Z-sv-1", w + "state-versions/20240102T030405.5Z-a.b.meta.json": "20240102T030405.5Z-a.b", w + "runs/r/plan.log": "plan", "readme": "readme"}
    assert each(rows, "p string", [(c,) for c in cases], lambda: fp.parse_path(F.col("p"))["stem"]) == list(cases.values())


def test_report_cells(rows):
    assert each(rows, "b boolean", [(True,), (False,), (None,)], lambda: fc.bool_cell(F.col("b"))) == ["true", "false", ""]
    assert each(rows, "t string", [("2024-01-02 03:04:59",), (None,)], lambda: fc.fmt_time(F.col("t").cast("timestamp"))) == ["2024-01-02 03:04", ""]


def test_statuses_are_complete(rows):
    got = each(rows, "s string", [(s,) for s in fs.STATUSES], lambda: F.struct(fs.status_settled(F.col("s")), fs.status_gate(F.col("s")), fs.status_valid(F.col("s"))))
    assert [tuple(g) for g in got] == [(*v, True) for v in fs.STATUSES.values()]
    cases = [("run", "applied", True), ("run", "planned", False), ("state_version", "", True), ("state_version", "pending", False), ("other", "applied", False), ("run", None, False)]
    assert each(rows, "k string, s string", [c[:2] for c in cases], lambda: fs.is_terminal(F.col("k"), F.col("s"))) == [c[2] for c in cases]
    cases = [(404, None, None, "terminal"), (None, None, "timeout", "transient"), (429, None, None, "transient"), (403, None, None, "forbidden"), (None, "Forbidden", None, "forbidden"), (500, "403 Forbidden \nfor this token", None, "forbidden"), (500, "path forbidden-experiments failed", None, "unknown"), (None, "error HTTP response: 4040", None, "unknown"), (None, "error HTTP response: 404", None, "terminal"), (500, None, None, "unknown")]
    assert each(rows, "h int, m string, c string", [c[:3] for c in cases], lambda: fs.classify_error(F.col("h"), F.col("m"), F.col("c"))) == [c[3] for c in cases]


def test_documents_decode_without_coercion(rows):
    docs = [("a", '{"data":{"id":"1","type":"runs","attributes":{"n":3,"t":"2024-01-02T03:04:05Z","b":true,"s":"x"}}}'), ("b", '{"data":[{"id":"2","attributes":{"n":"3","s":3}},{"id":"3"}]}'), ("c", '{"data":null}'), ("d", "{oops"), ("e", None)]
    got = fc.decode_jsonapi(rows(docs, "path string, content string"))
    a = F.col("attributes")
    out = [tuple(r) for r in got.select("path", "pos", "id", fc.attr_int(a, "n"), fc.attr_string(a, "s"), fc.attr_bool(a, "b"), fc.attr_time(a, "t").cast("string")).orderBy("path", "pos").collect()]
    assert out == [("a", 0, "1", 3, "x", True, "2024-01-02 03:04:05"), ("b", 0, "2", 0, "", False, None), ("b", 1, "3", 0, "", False, None)]


def test_semver_order(rows):
    order = ["1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-alpha.beta", "1.0.0-beta.2", "1.0.0-beta.11", "1.0.0-rc.1", "1.0.0", "1.2", "1.10.0", "2.0.0"]
    df = rows([(v,) for v in reversed(order)] + [("junk",)], "v string")
    assert [r[0] for r in df.orderBy(F.asc_nulls_first(fc.semver_key(F.col("v")))).collect()] == ["junk", *order]
    assert each(rows, "v string", [("1.0.0-a",), ("1.0.0",), ("x",)], lambda: fc.is_prerelease(F.col("v"))) == [True, False, False]


@pytest.mark.parametrize(("n", "text"), [(0, "0 B"), (1023, "1023 B"), (1024, "1.0 KiB"), (1280, "1.2 KiB"), (1048575, "1.0 MiB"), (5 * 1024**3, "5.0 GiB")])
def test_human_bytes(rows, n, text):
    assert each(rows, "n bigint", [(n,)], lambda: fc.human_bytes(F.col("n"))) == [text]


def test_signatures_fall_back_to_size(rows):
    s = "a struct<hash:string,size:bigint>, b struct<hash:string,size:bigint>"
    cases = [(("x", 1), ("x", 2), True), (("x", 1), ("y", 1), False), (("", 1), ("y", 1), True), ((None, 1), ("y", 2), False)]
    assert each(rows, s, [c[:2] for c in cases], lambda: fc.sig_equal(F.col("a"), F.col("b"))) == [c[2] for c in cases]
