"""The call ledger as a stream: ingest with quarantine, first success per key, running cost."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.ledger import LABELS, quarantine


def ingest_calls(stream: DataFrame, good: str, bad: str, checkpoint: str) -> StreamingQuery:
    """Route each micro-batch to two tables; a repeated batch overwrites its own folders, so nothing counts twice."""

    def route(batch: DataFrame, number: int) -> None:
        fine, failed = quarantine(batch)
        fine.write.mode("overwrite").parquet(f"{good}/batch={number}")
        failed.write.mode("overwrite").parquet(f"{bad}/batch={number}")

    return stream.writeStream.foreachBatch(route).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_dedup(stream: DataFrame, key: list[str], time: str | None = None, delay: str = "1 day") -> DataFrame:
    """The first successful row of each key that arrives. With a time column, keys are forgotten after the delay."""
    ok, _ = quarantine(stream)
    return ok.withWatermark(time, delay).dropDuplicatesWithinWatermark(key) if time else ok.dropDuplicates(key)


#: Parts of a group's ids, so that one group's calls don't meet in one task.
PARTS = 16
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class CostSoFar(StatefulProcessor):
    """Calls, tokens and answered items of one part of a group: each call and each item counts once.

    State: calls seen, with their time; answered items; totals. Calls older than the watermark of this very batch are late and don't
    count (Spark's own operators drop them a batch later), so calls seen are forgotten once the watermark has passed them.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "call string", "at long")
        self.items = handle.getMapState("items", "item string", "answered boolean")
        self.totals = handle.getValueState("totals", "calls long, answered long, input_tokens long, output_tokens long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        calls, answered, tokens_in, tokens_out = self.totals.get() if self.totals.exists() else (0, 0, 0, 0)
        passed, latest = timerValues.getCurrentWatermarkInMs(), -1
        for pdf in rows:
            fresh = pdf[pdf["at"] >= passed].drop_duplicates("call_id")
            fresh = fresh[[not self.seen.containsKey((c,)) for c in fresh["call_id"]]] if len(fresh) else fresh
            for c, at in zip(fresh["call_id"], fresh["at"], strict=True):
                self.seen.updateValue((c,), (int(at),))
            for item in fresh.loc[fresh["done"], "item_id"].drop_duplicates():
                if not self.items.containsKey((item,)):
                    self.items.updateValue((item,), (True,))
                    answered += 1
            calls, tokens_in, tokens_out = calls + len(fresh), tokens_in + int(fresh["tokens_in"].sum()), tokens_out + int(fresh["tokens_out"].sum())
            latest = max(latest, int(fresh["at"].max()) if len(fresh) else -1)
        self.totals.update((calls, answered, tokens_in, tokens_out))
        if latest >= passed:
            self.handle.registerTimer(latest + 1)
        yield pd.DataFrame({"group": [key[0]], "part": [key[1]], "calls": [calls], "answered": [answered], "input_tokens": [tokens_in], "output_tokens": [tokens_out]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        for call in [c for c, at in self.seen.iterator() if at[0] < passed]:
            self.seen.removeKey(call)
        return iter(())

    def close(self) -> None:
        pass


def running_cost(stream: DataFrame, call: str, item: str, by: str = "experiment", time: str | None = None, delay: str = "1 day", parts: int = PARTS) -> DataFrame:
    """(group, part, calls, answered, input_tokens, output_tokens) so far, in update mode: calls that are delivered again don't
    count, items that are answered again count once, rows later than the delay don't count (without a time column none is late,
    and no call is forgotten).

    A group's items are its parts, or with a time column dealt out to parts by their hash; total_cost adds them up. Without it both steps
    are Spark's own: calls seen lie spread by call, and a row of totals an item, so a call costs no way to Python. The state store
    must be RocksDB, which this sets for the session. A call belongs to one item.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    done = F.coalesce(F.col("predicted_label").isin(*LABELS) & ~F.col("failed"), F.lit(False))
    tokens = [F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(n) for c, n in (("input_tokens", "tokens_in"), ("output_tokens", "tokens_out"))]
    name = F.coalesce(F.col(item).cast("string"), F.lit(""))
    group, call_id = F.col(by).cast("string").alias("group"), F.col(call).cast("string").alias("call_id")
    if not time:
        once = stream.select(group, name.alias("part"), call_id, done.alias("done"), *tokens).dropDuplicates(["group", "part", "call_id"])
        sums = [F.sum(c).alias(n) for c, n in (("tokens_in", "input_tokens"), ("tokens_out", "output_tokens"))]
        return once.groupBy("group", "part").agg(F.count("*").alias("calls"), F.max(F.col("done").cast("long")).alias("answered"), *sums)
    at = F.unix_millis(F.col(time).cast("timestamp"))
    # the time itself stays, as the watermark lives on it
    rows = stream.withWatermark(time, delay).select(group, F.pmod(F.xxhash64(name), F.lit(parts)).cast("int").alias("part"), name.alias("item_id"), call_id, done.alias("done"), at.alias("at"), *tokens, F.col(time).alias("event_time"))
    schema = "group string, part int, calls long, answered long, input_tokens long, output_tokens long"
    return rows.groupBy("group", "part").transformWithStateInPandas(CostSoFar(), schema, "update", "eventtime")


def total_cost(parts: DataFrame, rate_in: float, rate_out: float, budget: float, by: str = "experiment") -> DataFrame:
    """Calls, answered items, cost and whether the budget is spent, from what running_cost has put out so far; totals only grow,
    so the row with most calls of each part is its last."""
    last = parts.groupBy("group", "part").agg(F.max_by(F.struct("calls", "answered", "input_tokens", "output_tokens"), "calls").alias("t"))
    cost = (F.sum("t.input_tokens") * rate_in + F.sum("t.output_tokens") * rate_out) / F.lit(1e6)
    return last.groupBy(F.col("group").alias(by)).agg(F.sum("t.calls").alias("calls"), F.sum("t.answered").alias("answered"), cost.alias("cost"), (cost > budget).alias("over_budget"))


def table_stream(spark: SparkSession, path: str, schema, max_files: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)
