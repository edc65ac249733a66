"""Streams of events and turns."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

#: Turns kept of a conversation, and how long it is kept without one.
MAX_TURNS = 40
IDLE_MS = 3_600_000
#: Conversations kept at a time.
MAX_OPEN = 50


def outcome_summary(events: DataFrame, time: str = "ts", outcome: str = "event_type", value: str = "value", width: str = "1 day", late: str | None = None) -> DataFrame:
    """Per window and outcome: events and value. With ``late``, events later than that watermark are dropped and old windows leave the
    state; without, none is lost and the state holds a row per window and outcome. Run in update mode, so that open windows are written."""
    rows = events.withWatermark(time, late) if late else events
    return rows.groupBy(F.window(time, width), outcome).agg(F.count("*").alias("n"), F.sum(value).alias("value"))


def finished_once(stages: DataFrame, time: str = "ts", late: str = "1 hour") -> DataFrame:
    """Each (conv, turn, stage) once: what is delivered again within the watermark is dropped."""
    return stages.withWatermark(time, late).dropDuplicatesWithinWatermark(["conv", "turn", "stage"])


OUT = "conv string, turn int, turns int, context int, dropped boolean"
STATE = "turns array<int>, understood array<boolean>, ended boolean"


def _follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, idle: bool) -> Iterator[pd.DataFrame]:
    if idle and state.hasTimedOut:
        state.remove()
        return
    turns, understood, ended = state.get if state.exists else ([], [], False)
    turns, understood = list(turns), list(understood)
    # of one turn its first row in order: at most MAX_TURNS rows are held, whatever is delivered
    new: dict[int, tuple[bool, bool]] = {}
    for x in batches:
        for turn, ok, end in zip(x["turn"], x["understood"], x["end"]):
            if turn not in turns:
                new[turn] = min(new.get(turn, (True, True)), (bool(ok), bool(end)))
    out = []
    for turn, (ok, end) in sorted(new.items()):
        if not ended:
            context = sum(understood[-6:])
            turns.append(int(turn))
            understood.append(ok)
        # a result that comes after the end is discarded
        out.append((key[0], int(turn), len(turns), 0 if ended else context, ended))
        ended = ended or end
    state.update((turns, understood, ended))
    if idle:
        state.setTimeoutDuration(IDLE_MS)
    yield pd.DataFrame(out, columns=["conv", "turn", "turns", "context", "dropped"])


def follow_conversations(turns: DataFrame, idle: bool = True) -> DataFrame:
    """turns: conv, turn (from 1), understood, end. A row per new turn: how many turns its conversation has, how many understood ones
    its context holds, and whether it was dropped: after the end, or beyond MAX_TURNS (these never reach the state; turns is MAX_TURNS).

    State is kept per conversation, MAX_TURNS numbers at most, for an hour without turns; with idle=False for ever, as a run over what
    is there needs it: one that waits for time-outs never ends. The rows of one trigger are taken in the order of their turns.
    """

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        return _follow(key, batches, state, idle)

    rows = turns.where("turn is not null and conv is not null")
    beyond = rows.where(F.col("turn") > MAX_TURNS).select("conv", "turn", F.lit(MAX_TURNS).alias("turns"), F.lit(0).alias("context"), F.lit(True).alias("dropped"))
    within = rows.where(F.col("turn") <= MAX_TURNS).groupBy("conv").applyInPandasWithState(follow, OUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout)
    return within.unionByName(beyond)


def evicted(conversations: DataFrame, keep: int = MAX_OPEN) -> DataFrame:
    """conversations: conv, ended, last (time of the last turn). Those that go when only so many may stay: ended ones first, then the
    longest idle; equal ones by conv."""
    stay = conversations.orderBy(F.col("ended").asc_nulls_first(), F.col("last").desc_nulls_last(), "conv").limit(keep).select("conv")
    return conversations.join(F.broadcast(stay), "conv", "left_anti")


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", keys: list[str] | None = None) -> DataFrame:
    """Processes what is there into Parquet files, stops, and returns what is written so far; the checkpoint makes a repeated run continue
    where it stopped. In update mode each trigger's rows are a folder of their own (written again if the trigger is repeated), and
    the last row of each key counts."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    spark = stream.sparkSession
    if mode == "append":
        writer.format("parquet").option("path", path).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(path)
    writer.foreachBatch(lambda rows, k: rows.write.mode("overwrite").parquet(f"{path}/trigger={k}")).start().awaitTermination()
    rows = spark.read.schema(StructType([*stream.schema.fields, StructField("trigger", LongType())])).parquet(path)
    rest = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "trigger").alias("__r")).select(*keys, "__r.*")
