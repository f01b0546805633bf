"""Streams of revisions and of jobs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kilnwork.operators.sets import last_of_each


def newest_wins(stream: DataFrame, keys: list[str], revision: str, read: Callable[[], DataFrame | None], write: Callable[[DataFrame], None], checkpoint: str) -> StreamingQuery:
    """Keep a table at each key's newest revision: every batch is merged with what ``read`` gives and handed to ``write``.

    Replays change nothing, since a revision that is there already wins over itself alone.
    """

    def merge(batch: DataFrame, _: int) -> None:
        old = read()
        rows = batch if old is None else old.unionByName(batch)
        write(last_of_each(rows, keys, [F.col(revision)]))

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).start()


def windowed_counts(stream: DataFrame, time: str, key: str, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Counts in tumbling windows; rows later than ``late`` are left out."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), key, "n")


def next_jobs(stream: DataFrame) -> DataFrame:
    """(queue, id): after each batch the job that is due in each queue, the least (priority, sequence).

    stream: queue, id, dedupe_key, priority, sequence, kind, which is enqueue, done or pause. A job whose dedupe_key is
    waiting isn't queued again; a paused queue gives none.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting = {} if not state.exists else {r[0]: tuple(r[1:]) for r in map(tuple, state.get[0])}
        paused = bool(state.get[1]) if state.exists else False
        for pdf in batches:
            for r in pdf.sort_values("sequence").itertuples():
                if r.kind == "enqueue":
                    if r.dedupe_key not in {w[0] for w in waiting.values()}:
                        waiting[r.id] = (r.dedupe_key, int(r.priority), int(r.sequence))
                    paused = False
                elif r.kind == "done":
                    waiting.pop(r.id, None)
                else:
                    paused = True
        state.update(([(k, *v) for k, v in waiting.items()], paused))
        if waiting and not paused:
            yield pd.DataFrame({"queue": [key[0]], "id": [min(waiting, key=lambda k: waiting[k][1:])]})

    held = "waiting array<struct<id:string,dedupe_key:string,priority:long,sequence:long>>, paused boolean"
    return stream.groupBy("queue").applyInPandasWithState(run, "queue string, id string", held, "update", GroupStateTimeout.NoTimeout)
