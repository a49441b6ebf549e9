"""Reference gates: small state machines per path, folded as maps over their states."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATES = ("none", "pending", "errored", "reference-cleared", "reference-absent")
_NONE, _PENDING, _ERRORED = 0, 1, 2
_OPEN, _CLEAR, _ABSENT, _FAIL = range(4)
#: The state that each event leads to, unless it is an opening after a failure or a clearing of nothing.
_GOAL = np.array([_PENDING, 3, 4, _ERRORED])
#: The event that stands for a run's entry in a state.
_AS_EVENT = [-1, _OPEN, _FAIL, _CLEAR, _ABSENT]


def run_maps(codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(exits, counts) of runs of events that begin at starts: for each run and entry state, where it ends and how many events changed something."""
    size = len(codes)
    run = np.cumsum(np.bincount(starts, minlength=size)) - 1
    place = np.arange(size)
    first = starts[run]
    ends = np.append(starts[1:], size) - 1

    def latest(which: np.ndarray) -> np.ndarray:
        """The last place at or before each where `which` holds, in its run; -1 if there is none."""
        at = np.maximum.accumulate(np.where(which, place, -1))
        return np.where(at >= first, at, -1)

    before = lambda at: np.where(place > first, np.append(-1, at[:-1]), -1)
    closed = before(latest(codes != _OPEN))
    real = latest(codes != _CLEAR) >= 0  # from here on there is a gate, if there was none
    exits, counts = np.empty((len(starts), 5), np.int8), np.empty((len(starts), 5), np.int64)
    for entry, event in enumerate(_AS_EVENT):
        live = real | (entry != _NONE)
        last = np.where((place > first) & before(live.astype(int)).astype(bool), codes[place - 1], event)
        sticky = np.where(closed >= 0, codes[closed], event) == _FAIL
        if entry == _NONE:  # a clearing of nothing isn't the last closing either
            sticky &= closed >= 0
        state = np.where(last < 0, _NONE, np.where((last == _OPEN) & sticky, _ERRORED, _GOAL[last]))
        after = np.where(live, np.where((codes == _OPEN) & (state == _ERRORED), _ERRORED, _GOAL[codes]), _NONE)
        exits[:, entry] = after[ends]
        counts[:, entry] = np.add.reduceat((after != state).astype(np.int64), starts)
    return exits, counts


def fold_gates(events: DataFrame) -> DataFrame:
    """path, status, attempts of reference gates from events (path, seq, event: open, clear, absent or fail).

    An event that leaves the state as it is counts for nothing; opening a gate
    that failed leaves it failed, and clearing one that isn't there makes none.

    Every event is a map over the gate's states, and maps compose in any
    grouping. Events are dealt once, in ranges of (path, seq), so those of a hot
    path are composed by many tasks; a path's maps (one per task) are composed in their order.
    """
    code = F.when(F.col("event") == "open", _OPEN).when(F.col("event") == "clear", _CLEAR).when(F.col("event") == "absent", _ABSENT).otherwise(_FAIL)
    fields = "path string, part int, exits array<tinyint>, counts array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held: list = []  # path, exits, counts of the run that may go on

        def rows(found: list) -> pa.RecordBatch:
            paths, exits, counts = zip(*found, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array([part] * len(paths), pa.int32()), pa.array([e.tolist() for e in exits], pa.list_(pa.int8())), pa.array([c.tolist() for c in counts], pa.list_(pa.int64()))], ["path", "part", "exits", "counts"])

        for batch in batches:
            if not batch.num_rows:
                continue
            paths = batch.column(0).dictionary_encode()
            number = paths.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.append(True, number[1:] != number[:-1]))
            exits, counts = run_maps(batch.column(1).to_numpy(), starts)
            names = [None if i < 0 else paths.dictionary[i].as_py() for i in number[starts].tolist()]
            found = [[n, e, c] for n, e, c in zip(names, exits, counts, strict=True)]
            if held and held[0][0] == found[0][0]:
                _, e, c = held.pop()
                found[0] = [found[0][0], found[0][1][e], c + found[0][2][e]]
            found = held + found
            held = [found.pop()]
            if found:
                yield rows(found)
        if held:
            yield rows(held)

    parts = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = events.select(F.col("path").cast("string").alias("path"), "seq", code.alias("code")).repartitionByRange(parts, "path", "seq").sortWithinPartitions("path", "seq")
    maps = dealt.select("path", "code").mapInArrow(run, fields).groupBy("path").agg(F.sort_array(F.collect_list(F.struct("part", "exits", "counts"))).alias("maps"))
    start = F.struct(F.lit(_NONE).alias("state"), F.lit(0).cast("long").alias("n"))
    step = lambda acc, m: F.struct(F.element_at(m["exits"], acc["state"] + 1).cast("int").alias("state"), (acc["n"] + F.element_at(m["counts"], acc["state"] + 1)).alias("n"))
    end = maps.select("path", F.aggregate("maps", start, step).alias("end")).filter(F.col("end.state") != _NONE)
    return end.select(F.col("path").cast(events.schema["path"].dataType).alias("path"), F.element_at(F.array(*map(F.lit, STATES)), F.col("end.state") + 1).alias("status"), F.col("end.n").alias("attempts"))
