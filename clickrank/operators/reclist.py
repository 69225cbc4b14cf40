"""Recommendation lists in long form.

``long`` has one row per (visitorid, rank, itemid), rank dense from 1;
``users`` names every user that received a list, including users whose list
is empty (popularity gives every train user a row even when nothing is
left after removing seen items).  The array shape of the reference is derived
on output.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class RecList:
    long: DataFrame
    users: DataFrame
    kept: tuple[DataFrame, ...] = ()  # persisted helper tables the lists are built from

    def arrays(self) -> DataFrame:
        """(visitorid, recommendations array ordered by rank); empty lists kept."""
        lists = self.long.groupBy("visitorid").agg(
            F.sort_array(F.collect_list(F.struct("rank", "itemid"))).alias("ranked")
        )
        return self.users.join(lists, "visitorid", "left").select(
            "visitorid",
            F.coalesce(F.transform("ranked", lambda x: x["itemid"]), F.array().cast("array<int>")).alias(
                "recommendations"
            ),
        )

    def persist(self, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> RecList:
        return RecList(self.long.persist(level), self.users.persist(level), self.kept)

    def unpersist(self) -> None:
        self.long.unpersist()
        self.users.unpersist()
        for df in self.kept:
            df.unpersist()


def from_arrays(lists: DataFrame, column: str = "recommendations") -> RecList:
    """Long form of a (visitorid, array) table, e.g. a list table read back from Parquet."""
    long = lists.select("visitorid", F.posexplode(column).alias("pos", "itemid")).select(
        "visitorid", (F.col("pos") + 1).alias("rank"), "itemid"
    )
    return RecList(long, lists.select("visitorid"))
