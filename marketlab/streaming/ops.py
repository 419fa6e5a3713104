"""Structured Streaming operators: streams in, streams out, except the foreachBatch sinks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from marketlab.operators.bars import ohlcv
from marketlab.operators.scans import pin
from marketlab.operators.slices import FOLD_ROWS
from marketlab.operators.study import PH_STATE, page_hinkley_states, psi_against, psi_reference
from marketlab.sources import ledger_io as IO


def stream_bars(ticks: DataFrame, width: str = "5 minutes", late: str = "10 minutes", order=("ts", "event_id")) -> DataFrame:
    """Tumbling OHLCV bars of closed windows; ticks later than `late` are dropped."""
    return (ticks.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "product").agg(*ohlcv(order))
            .select("product", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume", "w"))


def sliding_counts(events: DataFrame, keys: Sequence[str], width="1 hour", slide="5 minutes", late="10 minutes", limit: int | None = None) -> DataFrame:
    """Trailing counts over sliding windows, with a flag above the limit."""
    x = events.withWatermark("ts", late).groupBy(F.window("ts", width, slide).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    over = F.lit(False) if limit is None else F.col("n") > limit
    return x.select(*keys, F.col("w.end").alias("ts"), "n", over.alias("over_limit"))


def latest_ticker(ticks: DataFrame, order=("ts", "event_id")) -> DataFrame:
    """Newest ticker per product; run in update or complete mode."""
    cols = [c for c in ticks.columns if c != "product"]
    return ticks.groupBy("product").agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("t")).select("product", "t.*")


class Silence(StatefulProcessor):
    """State of one key: its last settled time, whether it is silent, and the first and last time in each open bucket of the limit's width.

    Two times of one bucket are never farther apart than the limit, so a batch may come in any order and is never held whole.
    """

    def __init__(self, limit_sec: int):
        self.limit = limit_sec * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "us bigint, silent boolean")
        self.open = handle.getMapState("open", "bucket bigint", "low bigint, high bigint")

    def handleInputRows(self, key, rows, timerValues):
        for pdf in rows:
            for bucket, g in pdf["us"].groupby(pdf["us"] // self.limit):
                low, high, k = int(g.min()), int(g.max()), (int(bucket),)
                if self.open.containsKey(k):
                    old = self.open.getValue(k)
                    low, high = min(low, old[0]), max(high, old[1])
                self.open.updateValue(k, (low, high))
        yield self._settle(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield self._settle(key, timerValues.getCurrentWatermarkInMs())

    def _settle(self, key, mark):
        out, now = [], mark * 1000
        last, silent = self.last.get() if self.last.exists() else (None, False)
        buckets = sorted(k[0] for k in self.open.keys())
        closed = [b for b in buckets if (b + 1) * self.limit <= now]
        for b in closed:
            low, high = self.open.getValue((b,))
            self.open.removeKey((b,))
            if last is not None and low - last > self.limit:
                if not silent:
                    out.append((key[0], "stale", last, self.limit / 1e6))
                out.append((key[0], "recovered", low, (low - last) / 1e6))
                silent = False
            last = high if last is None else max(last, high)
        waiting = buckets[len(closed):]
        soon = self.open.getValue((waiting[0],))[0] if waiting else None
        if last is not None and not silent:
            due = last // 1000 + self.limit // 1000 + 1
            if soon is None or soon - last > self.limit:
                if due <= mark:
                    out.append((key[0], "stale", last, self.limit / 1e6))
                    silent = True
                else:
                    self.handle.registerTimer(due)
        if waiting:
            self.handle.registerTimer((waiting[0] + 1) * self.limit // 1000)
        if last is not None:
            self.last.update((last, silent))
        return pd.DataFrame(out, columns=["key", "event", "us", "silent_sec"])

    def close(self) -> None:
        pass


def stale_feeds(ticks: DataFrame, limit_sec: int, late: str = "10 minutes", key: str = "product") -> DataFrame:
    """T4: a row when a key has been silent for `limit_sec` (stale) and one when it speaks again (recovered), once the watermark has
    passed them: by event time, whatever the batches."""
    x = ticks.withWatermark("ts", late).where(F.col("ts").isNotNull()).select(key, "ts", F.unix_micros("ts").alias("us"))
    out = x.groupBy(key).transformWithStateInPandas(statefulProcessor=Silence(limit_sec), outputStructType="key string, event string, us long, silent_sec double",
                                                    outputMode="Append", timeMode="EventTime")
    return out.select(F.col("key").alias(key), "event", F.timestamp_micros("us").alias("at"), "silent_sec")


def dedupe(events: DataFrame, key: str, late: str = "1 day") -> DataFrame:
    """T5: each exec_id or event_id once, remembered for the watermark only."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


MATURING = np.dtype([("at", "<i8"), ("us", "<i8"), ("id", "<i8"), ("value", "<f8"), ("direction", "<i4"), ("nulls", "<i4")])


def _distinct(rows: np.ndarray) -> np.ndarray:
    return np.frombuffer(np.unique(rows.view(f"V{MATURING.itemsize}")).tobytes(), MATURING)


def _nearest_price(signals: np.ndarray, prices: np.ndarray, tol: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of the price nearest to each signal's `at`, the earlier one on ties, and whether it is closer than `tol`; prices ascend by `at`."""
    if not len(prices):
        return np.zeros(len(signals), int), np.zeros(len(signals), bool)
    after = np.searchsorted(prices["at"], signals["at"])
    left, right = np.maximum(after - 1, 0), np.minimum(after, len(prices) - 1)
    gap = np.abs(prices["at"][[left, right]] - signals["at"])
    return np.where(gap[0] <= gap[1], left, right), gap.min(axis=0) < tol


def mature_stream(signals: DataFrame, ticks: DataFrame, horizon_sec: int, tolerance_sec: int = 600, late: str = "10 minutes") -> DataFrame:
    """The price nearest to signal time + horizon, strictly closer than the tolerance, the earlier one on ties; null if there is none.

    Both streams meet by product and time bucket of six tolerances, prices near an edge in both buckets, so a busy product is spread over
    its buckets. A bucket's state holds its open signals and one price an instant (that of the smallest
    event_id), and a signal finds its price by halving, so the work grows with the rows, not with the pairs in reach. A signal leaves
    once the watermark has passed horizon plus tolerance, a bucket's prices once no signal can come any more.
    Signals carry event_id, product, ts, direction and p0; ticks product, ts, price and event_id; ids and directions are integers.
    """
    width, tol, wait = 6 * tolerance_sec, tolerance_sec * 1_000_000, (horizon_sec + tolerance_sec) * 1000
    us = F.unix_micros("ts")

    def flat(x, at, value, direction, own):
        columns = ["event_id", value, *([direction] if direction else [])]
        nulls = sum((F.col(c).isNull().cast("int") * (1 << i) for i, c in enumerate(columns)), F.lit(0))
        return x.select("product", "ts", own.alias("_b"), at.alias("at"), us.alias("us"), F.coalesce(F.col("event_id").cast("bigint"), F.lit(0)).alias("id"),
                        F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("value"), F.coalesce(F.col(direction).cast("int"), F.lit(0)).alias("direction") if direction
                        else F.lit(0).alias("direction"), nulls.alias("nulls"), F.lit(direction is None).alias("is_price"))

    s = signals.withWatermark("ts", late).where(F.col("ts").isNotNull())
    p = ticks.withWatermark("ts", late).where(F.col("ts").isNotNull() & F.col("product").isNotNull())

    def slot(at):
        return F.floor(at / (width * 1_000_000))

    due_at = us + horizon_sec * 1_000_000
    both = flat(s, due_at, "p0", "direction", slot(due_at)).unionByName(
        flat(p, us, "price", None, F.explode(F.array_distinct(F.array(slot(us - tol), slot(us + tol))))))

    def bucket(key, frames, state):
        held = state.get if state.exists else (b"", b"")
        parts = [[np.frombuffer(bytes(held[0]), MATURING)], [np.frombuffer(bytes(held[1]), MATURING)]]
        for pdf in frames:
            rows = np.empty(len(pdf), MATURING)
            for c in MATURING.names:
                rows[c] = pdf[c].to_numpy()
            is_price = pdf["is_price"].to_numpy(bool)
            parts[0].append(rows[~is_price])
            parts[1].append(rows[is_price])
        open_, prices = _distinct(np.concatenate(parts[0])), np.concatenate(parts[1])
        # one price an instant: the smallest event_id, null first
        prices = prices[np.lexsort((prices["id"], -(prices["nulls"] & 1), prices["at"]))]
        prices = prices[np.flatnonzero(np.diff(prices["at"], prepend=prices["at"][:1] - 1))]
        mark = state.getCurrentWatermarkMs()
        due = open_["us"] // 1000 + wait
        ripe = open_[due < mark]
        if len(ripe):
            at, found = _nearest_price(ripe, prices, tol)
            hit = prices[at] if len(prices) else np.zeros(len(ripe), MATURING)
            yield pd.DataFrame({"event_id": ripe["id"], "product": key[0], "us": ripe["us"], "direction": ripe["direction"], "p0": ripe["value"], "nulls": ripe["nulls"],
                                "price": hit["value"], "found": found & (hit["nulls"] & 2 == 0)})
        open_, due = open_[due >= mark], due[due >= mark]
        closed = ((int(key[1]) + 1) * width - horizon_sec) * 1000
        if len(open_) or closed > mark:
            state.update((open_.tobytes(), prices.tobytes()))
            state.setTimeoutTimestamp(int(max(mark, due.min() if len(open_) else closed)))
        elif state.exists:
            state.remove()

    x = both.groupBy("product", "_b").applyInPandasWithState(
        bucket, "event_id long, product string, us long, direction int, p0 double, nulls int, price double, found boolean", "signals binary, prices binary", "append", "EventTimeTimeout")

    def known(c, bit):
        return F.when(F.col("nulls").bitwiseAND(bit) == 0, F.col(c))

    raw = F.when(F.col("found"), F.col("price")) / known("p0", 2) - 1
    return x.select(known("event_id", 1).alias("event_id"), "product", F.timestamp_micros("us").alias("ts"), raw.alias("fwd_return_raw"),
                    (raw * known("direction", 4)).alias("fwd_return_aligned"), F.when(F.col("found"), "scored").otherwise("abandon").alias("state"))


def drift_sink(reference: DataFrame, feature: str, value: str, path: str) -> Callable[[DataFrame, int], None]:
    """Per micro-batch PSI against the reference, whose bins are counted once; one folder per batch (replays overwrite)."""
    counted = pin(psi_reference(reference, feature, value))

    def write(batch: DataFrame, batch_id: int) -> None:
        psi_against(counted, batch, feature, value).withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def _folder(spark, path: str):
    """Hadoop file system and path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def is_folder(spark, path: str) -> bool:
    fs, p = _folder(spark, path)
    return fs.getFileStatus(p).isDirectory()


def _numbered(spark, path: str, name: str) -> list[int]:
    fs, p = _folder(spark, path)
    names = [s.getPath().getName() for s in (fs.listStatus(p) if fs.exists(p) else [])]
    return sorted(int(n.split("=", 1)[1]) for n in names if n.startswith(f"{name}=") and n.split("=", 1)[1].isdigit())


def page_hinkley_sink(path: str, key: str, delta=0.005, lam=0.5, alpha=0.999, rows: int = FOLD_ROWS) -> Callable[[DataFrame, int], None]:
    """Concept-drift detections of each micro-batch (key, ts, event_id, error) under `hits`, and every key's state after it under `state`.

    A batch is folded by event time in slices, so one key's batch is many tasks; it starts from the state after the batch before, so
    a replay writes the same again. Rows that come in a later batch are folded with it.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        done = [i for i in _numbered(spark, f"{path}/state", "batch") if i < batch_id]
        old = spark.read.schema(f"{key} string, state array<double>").parquet(f"{path}/state/batch={done[-1]}") if done else None
        x = pin(page_hinkley_states(batch.select(key, "ts", "event_id", "error"), [key], ["ts", "event_id"], "error", delta, lam, alpha, rows, old))
        x.where("drift = 1").select(key, "ts", "event_id", "ph_stat").write.mode("overwrite").parquet(f"{path}/hits/batch={batch_id}")
        seen = F.col("_seen").isNotNull()
        state = x.where(seen).groupBy(key).agg(F.max_by(F.array(*PH_STATE), F.struct("ts", "event_id")).alias("state"))
        if old is not None:
            state = state.unionByName(old.join(state.select(F.col(key).alias("_k")), F.col(key).eqNullSafe(F.col("_k")), "left_anti"))
        state.write.mode("overwrite").parquet(f"{path}/state/batch={batch_id}")

    return write


def ledger_sink(path: str, keys: Sequence[str], order: Sequence[str], buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """Append rows whose key is new, in folders by key bucket and batch.

    A batch reads the keys of the buckets it touches only, and of earlier batches only, so a replay writes the same rows again.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        x = batch.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        fs, root = _folder(spark, path)
        touched = [f"{path}/bucket={r[0]}" for r in x.select("bucket").distinct().collect()]  # at most `buckets` numbers
        there = [p for p in touched if fs.exists(_folder(spark, p)[1])]
        kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in batch.schema if f.name in keys)
        known = spark.read.schema(f"{kept}, bucket int, batch bigint").option("basePath", path).parquet(*there).where(F.col("batch") < batch_id) if there else x.limit(0)
        new = IO.insert_or_ignore(known, x, keys, order).withColumn("batch", F.lit(batch_id).cast("bigint"))
        new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(path)

    return write


def sessions(events: DataFrame, keys: Sequence[str], gap: str, late: str = "10 minutes") -> DataFrame:
    """Activity spells separated by silence longer than `gap`."""
    return (events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
            .select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n"))


def mention_counts(docs: DataFrame, syms: Column, refresh: str = "15 minutes", late: str = "10 minutes") -> DataFrame:
    """Mentions per symbol and refresh window; feed the closed windows to `docs.mention_heat`."""
    x = docs.withWatermark("ts", late).select("ts", "kind", F.explode(syms).alias("sym"))
    return (x.groupBy(F.window("ts", refresh).alias("w"), "sym", "kind").agg(F.count(F.lit(1)).alias("weight"))
            .select("sym", F.col("w.start").alias("ts"), F.col("kind").alias("source_kind"), "weight"))


def retention_sink(path: str, ts: str, keep_sec: int) -> Callable[[DataFrame, int], None]:
    """Keep the rows inside the retention in folders by day and batch, and drop the day folders that have fallen out of it.

    A manifest row a batch holds the newest time seen up to it; `retained` reads what the newest manifest keeps.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        done = [i for i in _numbered(spark, f"{path}/manifest", "batch") if i < batch_id]
        newest = batch.agg(F.max(ts).alias("newest"))
        if done:
            newest = newest.unionByName(spark.read.schema("newest timestamp").parquet(f"{path}/manifest/batch={done[-1]}")).agg(F.max("newest").alias("newest"))
        newest.write.mode("overwrite").parquet(f"{path}/manifest/batch={batch_id}")
        now = spark.read.schema("newest timestamp").parquet(f"{path}/manifest/batch={batch_id}").withColumnRenamed("newest", "_now")
        kept = IO.prune(batch.join(F.broadcast(now)), ts, F.col("_now"), keep_sec).drop("_now")
        x = IO.with_day(kept, ts).withColumn("batch", F.lit(batch_id).cast("bigint"))
        x.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(f"{path}/rows")
        first = now.select(F.to_date(F.timestamp_seconds(F.unix_seconds("_now") - keep_sec)).cast("string")).first()[0]
        fs, root = _folder(spark, f"{path}/rows")
        for s in fs.listStatus(root) if first and fs.exists(root) else []:
            name = s.getPath().getName()
            if name.startswith("day=") and name[4:] < first:
                fs.delete(s.getPath(), True)

    return write


def retained(spark, path: str, schema, ts: str, keep_sec: int) -> DataFrame:
    """Rows of a retention sink inside the retention as of its newest batch."""
    last = _numbered(spark, f"{path}/manifest", "batch")
    fs, rows = _folder(spark, f"{path}/rows")
    if not last or not fs.exists(rows):
        return spark.createDataFrame([], schema)
    now = spark.read.schema("newest timestamp").parquet(f"{path}/manifest/batch={last[-1]}").withColumnRenamed("newest", "_now")
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    x = spark.read.schema(f"{names}, day date, batch bigint").parquet(f"{path}/rows")
    return IO.prune(x.join(F.broadcast(now)), ts, F.col("_now"), keep_sec).select(*[f.name for f in schema])


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_to_files(stream: DataFrame, folder: str, mode: str = "append") -> None:
    """Drain what is available into parquet under `folder` (append) and stop."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    q = (stream.writeStream.outputMode(mode).format("parquet").option("path", f"{folder}/data")
         .option("checkpointLocation", f"{folder}/ckpt").trigger(availableNow=True).start())
    q.awaitTermination()


def run_batches(stream: DataFrame, sink: Callable[[DataFrame, int], None], folder: str, mode: str = "append") -> None:
    """Drain what is available through a foreachBatch sink and stop."""
    q = (stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", f"{folder}/ckpt")
         .trigger(availableNow=True).start())
    q.awaitTermination()
