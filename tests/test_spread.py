import pytest

from tidemark.operators import sealing


@pytest.mark.parametrize("most", [500_000, 0])
def test_one_collection_is_not_one_task(rows, monkeypatch, most):
    """Objects are dealt to tasks by their collection alone neither where the list of collections is broadcast nor where it is long."""
    monkeypatch.setattr(sealing, "BROADCAST_ROWS", most)
    objects = rows([("w", "runs", f"p{i}") for i in range(50)] + [("w", "states", "q"), ("v", "runs", "r")], "shard string, kind string, path string")
    found = sealing._of_complete(objects, rows([("w", "runs")], "shard string, kind string"))
    assert sorted(r.path for r in found.collect()) == sorted(f"p{i}" for i in range(50)) and found.columns == ["shard", "kind", "path"]
    plan = found._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan if most else "share" in plan
