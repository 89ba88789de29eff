"""Looking up what concepts name: probes met by a table of what there is, in one join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def spread(key: Column, *row: Column) -> Column:
    """``key``, or, where it is null, a text that no key equals and that ``row`` tells.

    Rows that look up nothing would all hash to one task; so they are dealt evenly. Keys
    hold no zero character: ids, handles and paths of files can't.
    """
    return F.coalesce(key, F.concat(F.lit("\0"), F.xxhash64(*row).cast("string")))


def meet(probes: DataFrame, key: Column, known: DataFrame, name: str, *row: str) -> DataFrame:
    """Each of ``probes`` with its row of ``known``, whose column ``name`` holds each key once, or with nulls.

    Null keys meet nothing and are dealt by the columns ``row``. A much-named key is left to
    adaptive execution, which splits its rows of ``probes`` and repeats the one of ``known``.
    """
    return probes.join(known, spread(key, *map(F.col, row)) == F.col(name), "left")
