"""Many matches in one table.

Operators take a match's rows: ``frame`` and identities are numbers of that
match. Tables of many matches are lifted first: frames and identities become
unique over all matches, so that joins on a frame and windows of an identity
never mix two of them. Operators with a ``key`` argument (trackers, paths,
greedy choices) take the match there: each match is one group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: More frames, and more identities, than a match can have.
ROOM = 10_000_000


def lifted(rows: DataFrame, number: str = "match_no", frame: str = "frame", ids: tuple[str, ...] = ("id_jugador",)) -> DataFrame:
    """``rows`` with frames and identities unique over matches; ``number``: a small whole number for each match."""
    new = {c: (F.col(number).cast("bigint") * ROOM + F.col(c)) for c in (frame, *ids) if c in rows.columns}
    return rows.withColumns(new)


def lowered(rows: DataFrame, frame: str = "frame", ids: tuple[str, ...] = ("id_jugador",)) -> DataFrame:
    """The other way round, with the match's number back."""
    new = {c: F.pmod(F.col(c), F.lit(ROOM)).cast("int") for c in (frame, *ids) if c in rows.columns}
    return rows.withColumn("match_no", F.floor(F.col(frame) / ROOM).cast("int")).withColumns(new)
