"""What conversations pin from turn to turn.

The state before a turn is what earlier turns of the conversation left: the
last case named alone, the last cases named together, and whether every turn
since then compared them.  Windows over the turns say that, so that no
conversation is ever held in one piece.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewright.functions import scopes


def pinned(turns: DataFrame, question: Column, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """``turns`` with ``scope`` (what the question is about) and ``pin`` (the state after it).

    Equal turns of a conversation are taken in any order.
    """
    before = Window.partitionBy(conv).orderBy(turn).rowsBetween(Window.unboundedPreceding, -1)
    named = turns.withColumn("__q", question).withColumn("__named", scopes.extracted(F.col("__q")))
    named = named.withColumn("__own", scopes.merged(F.col("__named"))).withColumn("__k", F.row_number().over(Window.partitionBy(conv).orderBy(turn)))
    some = F.size("__own") > 0
    last = lambda when, value: F.last(F.when(when, value), ignorenulls=True).over(before)
    state = named.withColumns({
        "__pinned": last(F.size("__own") == 1, F.col("__own")[0]),
        "__last": last(some, F.struct("__k", F.col("__own").alias("scopes"))),
        "__broke": last(~some & ~F.col("__q").rlike(scopes.COMPARATIVE), F.col("__k")),
    })
    several = F.size("__last.scopes") > 1
    state = state.withColumn("__multi", F.when(several, F.col("__last.scopes")))
    mode = F.when(several & (F.col("__broke").isNull() | (F.col("__broke") < F.col("__last.__k"))), "multi").otherwise("single")
    scoped = state.withColumn("scope", scopes.resolved(F.col("__q"), F.col("__named"), F.col("__pinned"), F.coalesce("__multi", F.array().cast("array<string>")), mode))
    out = scoped.withColumn("pin", scopes.next_pin(F.col("__pinned"), F.col("__multi"), F.col("scope")))
    return out.drop("__q", "__named", "__own", "__k", "__pinned", "__last", "__broke", "__multi")
