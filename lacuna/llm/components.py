"""Connected components of links between ids, by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.common import written
from lacuna.sources.tables import Rounds


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, label) for each id of a link: the least id that links lead to.

    Each round takes the least label of a node and its neighbours, then the
    label of that label, so paths halve and stars end after one round.  Rounds
    are written to the shared folder, and the tables of earlier ones removed; only
    a count of changes reaches the driver.
    """
    both = links.select(F.col(a).alias("id"), F.col(b).alias("other"))
    both = written(both.unionByName(both.select(F.col("other").alias("id"), F.col("id").alias("other"))).filter("id <> other").distinct(), "links")
    rounds = Rounds(links.sparkSession, "labels")
    labels = rounds.write(both.groupBy("id").agg(F.min("other").alias("least")).select("id", F.least("id", "least").alias("label")))
    while True:
        near = both.join(labels.select(F.col("id").alias("other"), F.col("label").alias("theirs")), "other").groupBy("id").agg(F.min("theirs").alias("least"))
        lower = labels.join(near, "id").select("id", F.col("label").alias("before"), F.least("label", "least").alias("label"))
        top = lower.select(F.col("id").alias("label"), F.col("label").alias("above"))
        after = rounds.write(lower.join(top, "label", "left").select("id", F.least("label", F.coalesce("above", "label")).alias("label"), "before"))
        if not after.filter("label <> before").limit(1).count():
            return after.select("id", "label")
        labels = after.select("id", "label")
