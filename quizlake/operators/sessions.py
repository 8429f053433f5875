"""Exam sessions over stored events: which exams are alive, and which submissions count.

An exam lives for a time after it was made and is used up by its first submission in that time. The streaming version is
in ``quizlake.streaming.sessions``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TTL = "2 hours"


def expired(made: Column, now: Column, ttl: str = TTL) -> Column:
    """Whether more than ``ttl`` has passed; exactly ``ttl`` is not expired. Null times give null."""
    return now - made > F.expr(f"interval {ttl}")


def used_up(sessions: DataFrame, ttl: str = TTL) -> DataFrame:
    """(exam_id, creada_at, enviada_at): the first submission of each exam, if it came in time and not before the exam.

    ``sessions`` has exam_id, creada_at, enviada_at; repeated rows count once, further submissions are refused. Of several
    times of making, the first holds.
    """
    rows = sessions.where(F.col("exam_id").isNotNull() & F.col("creada_at").isNotNull())
    made = rows.groupBy("exam_id").agg(F.min("creada_at").alias("creada_at"), F.min("enviada_at").alias("enviada_at"))
    return made.where(F.col("enviada_at").isNotNull() & (F.col("enviada_at") >= F.col("creada_at")) & ~expired(F.col("creada_at"), F.col("enviada_at"), ttl))


def active(sessions: DataFrame, now: Column, ttl: str = TTL) -> DataFrame:
    """(exam_id, creada_at) of the exams alive at ``now``: made by then, not expired, and not yet submitted."""
    rows = sessions.where(F.col("exam_id").isNotNull()).groupBy("exam_id").agg(F.min("creada_at").alias("creada_at"), F.min("enviada_at").alias("enviada_at"))
    open_ = F.col("enviada_at").isNull() | (F.col("enviada_at") > now)
    return rows.where((F.col("creada_at") <= now) & open_ & ~expired(F.col("creada_at"), now, ttl)).select("exam_id", "creada_at")


def active_count(sessions: DataFrame, now: Column, ttl: str = TTL) -> DataFrame:
    """(activos): how many exams are alive at ``now``."""
    return active(sessions, now, ttl).agg(F.count(F.lit(1)).alias("activos"))
