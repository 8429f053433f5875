"""Exam sessions as a stream: exams expire, and are used up by their first submission.

Events are (exam_id string, clase string, ts timestamp) with clase ``generar`` or ``entregar``. Time is event time: an exam
is dropped when the watermark passes its end, so unlike a store that is only swept now and then it never grades late.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quizlake.session import ready

OUT = "exam_id string, estado string, creada_at timestamp, ts timestamp"


def consume_once(events: DataFrame, ttl: timedelta = timedelta(hours=2), delay: str = "10 minutes") -> DataFrame:
    """(exam_id, estado, creada_at, ts) of every submission and expiry.

    ``estado``: calificado (first submission in time), desconocido (no such exam alive), caducado (expired, without a
    submission; ts is the end). Exactly ``ttl`` after the exam was made it is still alive. Null ids, kinds and times are
    passed over. Events of one micro-batch are taken in the order of their times, exams before submissions.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        if state.hasTimedOut:
            made = pd.Timestamp(state.get[0], unit="us")
            out.append((key[0], "caducado", made, made + ttl))
            state.remove()
        else:
            events = pd.concat(list(batches))
            made_us = state.get[0] if state.exists else None
            for ts, kind in sorted(zip(events["ts"], events["clase"]), key=lambda e: (e[0], e[1] != "generar")):
                alive = made_us is not None and ts - pd.Timestamp(made_us, unit="us") <= ttl
                if kind == "generar":
                    if not alive:
                        made_us = ts.value // 1000
                elif kind == "entregar":
                    made = pd.Timestamp(made_us, unit="us") if alive else pd.NaT
                    out.append((key[0], "calificado" if alive else "desconocido", made, ts))
                    if alive:
                        made_us = None
            if made_us is None:
                if state.exists:
                    state.remove()
            else:
                state.update((made_us,))
                end_ms = made_us // 1000 + int(ttl.total_seconds() * 1000) + 1
                state.setTimeoutTimestamp(max(end_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["exam_id", "estado", "creada_at", "ts"])

    ready(events.sparkSession)
    known = events.where("exam_id is not null and clase is not null and ts is not null").withWatermark("ts", delay)
    return known.groupBy("exam_id").applyInPandasWithState(step, OUT, "creada long", "append", GroupStateTimeout.EventTimeTimeout)
