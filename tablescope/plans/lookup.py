"""Answers for many questions: one table keyed by what was asked for, and a lookup that no popular question unbalances."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.order import written

#: Bytes of an answer table, estimated, that is sent to all tasks; a larger one is joined in salted parts.
BROADCAST_BYTES = 8 << 20
#: Parts into which the questions of one key are dealt.
SALTS = 32
ANSWER = "intent string, param double, rank long, label string, value double, extra double"


def expanded(tags: DataFrame, answers: DataFrame) -> DataFrame:
    """``id, intent, status, rank, label, value, extra``: every tagged question with the rows of its key.

    ``tags``: ``id, intent, param, most, status``; ``answers``: ``intent, param, rank, label, value, extra``. ``most``
    limits the ranks where it is not NULL. The answers are counted first: a small table goes to where the questions
    are; a large one is repeated for each salt, so the questions of one key are spread over as many tasks.
    """
    answers = written(answers, "answers")
    rows, letters = answers.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("label")), F.lit(0))).first()
    on = ["intent", "param"]
    if 64 * rows + letters <= BROADCAST_BYTES:
        answers = F.broadcast(answers)
    else:
        tags = tags.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
        answers = answers.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
        on.append("_salt")
    asked, made = tags.alias("asked"), answers.alias("made")
    same = (F.col("asked.most").isNull()) | F.col("made.rank").isNull() | (F.col("made.rank") <= F.col("asked.most"))
    for c in on:
        same = same & (F.col(f"asked.{c}") == F.col(f"made.{c}"))
    return asked.join(made, same, "left").select("asked.id", "asked.intent", "asked.status", "made.rank", "made.label", "made.value", "made.extra")
