"""Keeping or dropping the rows of a list of ids without moving all texts.

Cases: repeated ids count once; a null id matches nothing; an empty list keeps nothing, or drops nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideline.materialise import stored

#: Lists up to this length are broadcast, about 100 bytes a row; longer ones are joined by a shuffle.
MOST_IDS = 200_000


def by_ids(rows: DataFrame, ids: DataFrame, on: list[str], how: str, parts: int | None = None) -> DataFrame:
    """``rows`` with (left_semi) or without (left_anti) the ids; these are written in at most ``parts`` files."""
    ids = ids.select(*on).distinct()
    ids = stored(ids if parts is None else ids.coalesce(parts), "ids")
    return rows.join(F.broadcast(ids) if ids.count() <= MOST_IDS else ids, on, how)
