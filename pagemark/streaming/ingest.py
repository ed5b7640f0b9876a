"""Streams of captures against a table or a stream of fetches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from pagemark.dialect import FETCH_TIMEOUT
from pagemark.functions.decide import REFETCH
from pagemark.plans.ingest import FALLBACK_ROUTES, answer, join_candidates, prepare_fetches, without_meta

#: How late a record may come to a stream if the caller doesn't say.
LATENESS = "10 minutes"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: State of streams is in files on the executors' disks, and what RocksDB holds of it in memory
#: has a bound for each executor. A join has one store for each partition (version 3), not four.
STATE = {
    PROVIDER: "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.join.stateFormatVersion": "3",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
COUNTED = ("n", "sum_a", "n_a", "sum_b", "n_b")
#: Folders of a stored table of prepared fetches.
BUCKETS = 256
OUTCOMES = [(route, chosen) for route in (*FALLBACK_ROUTES, "compare") for chosen in ("capture", REFETCH)]
COUNTERS = "route string, chosen string, n long, sum_a double, n_a long, sum_b double, n_b long"


def read_stream(spark: SparkSession, path: str, schema, file_format: str = "parquet",
                **options) -> DataFrame:
    """Files of a directory as a stream, in the given schema."""
    return spark.readStream.schema(schema).format(file_format).options(**options).load(path)


def ingest_stream(captures: DataFrame, prepared: DataFrame, **options) -> DataFrame:
    """Answer captures as they arrive from a table of prepared fetches.

    ``prepared`` comes from ``latest_fetches(prepare_fetches(...))``, written to a
    table: the static side is read again for every micro-batch and should not be
    extracted again. The query keeps no state.
    """
    return answer(join_candidates(captures, prepared), **options)


def _slots(time: Column, timeout: str) -> tuple[Column, Column]:
    """The start of the time slot of ``timeout`` that a time is in, and that of the slot before."""
    width = F.unix_micros(F.timestamp_micros(F.lit(0)) + F.expr(f"interval {timeout}"))
    at = F.unix_micros(time)
    begin = at - F.pmod(at, width)
    return begin, begin - width


def join_fetch_stream(
    captures: DataFrame, fetches: DataFrame, timeout: str = FETCH_TIMEOUT,
    watermark: str = LATENESS, salts: int = 1,
) -> DataFrame:
    """Pair captures with fetches that arrive within ``timeout``; one row for a capture.

    Both inputs are streams, with ``captured_at`` and ``fetched_at``. Of several fetches in
    time the earliest counts (of those at one time the least by hash), in whatever order
    they arrive: an aggregation behind the join holds the best fetch of a capture so far
    and gives it out once the watermark of the join has passed the capture. The same capture
    posted again is one capture. A capture without a fetch comes with empty fetch columns,
    which is the fetch-failed route. Fetches are reduced before the join, so the state holds
    extractions and not raw pages.

    A fetch can only answer captures of its own time slot (of ``timeout`` length) and of the
    one before. Slots are part of the join key, with the fetch in both, so the state of a hot
    URL is spread over as many keys as slots are open. ``salts`` splits a slot further, at the
    price of as many copies of each fetch.

    ``watermark`` is how late a record may come. Spark drops a capture that comes later
    without a trace, so ``unanswered`` finds those from the stored captures and results,
    and ``ingest`` answers them.
    """
    capture = F.xxhash64("url", "captured_at", "title", "html", "text")
    left = without_meta(captures)
    kept = [c for c in left.columns if c != "captured_at"]
    left = left.withWatermark("captured_at", watermark).withColumn("_capture", capture).withColumn(
        "_slot", _slots(F.col("captured_at"), timeout)[0]).withColumn(
        "_salt", F.pmod("_capture", F.lit(salts)))
    prepared = prepare_fetches(fetches)
    found = [c for c in prepared.columns if c not in ("url", "fetched_at")]
    tie = F.xxhash64(*(c for c in found if c != "flags"))
    right = prepared.withWatermark("fetched_at", watermark).select(
        F.col("url").alias("_fetch_url"), "fetched_at", tie.alias("_tie"), *found,
        F.explode(F.array(*_slots(F.col("fetched_at"), timeout))).alias("_fetch_slot"),
    ).withColumn("_fetch_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    in_time = (
        (F.col("url") == F.col("_fetch_url"))
        & (F.col("_slot") == F.col("_fetch_slot")) & (F.col("_salt") == F.col("_fetch_salt"))
        & (F.col("fetched_at") >= F.col("captured_at"))
        & (F.col("fetched_at") <= F.col("captured_at") + F.expr(f"interval {timeout}"))
    )
    # one event time goes on
    joined = left.join(right, in_time, "left_outer").withColumn(
        "fetched_at", F.timestamp_micros(F.unix_micros("fetched_at")))
    place = F.when(F.col("fetched_at").isNotNull(), F.struct("fetched_at", "_tie"))
    best = joined.groupBy("_capture", "captured_at").agg(
        *(F.first(c).alias(c) for c in kept), *(F.min_by(c, place).alias(c) for c in ("fetched_at", *found)))
    return best.select(*kept, "captured_at", "fetched_at", *found)


def unanswered(captures: DataFrame, results: DataFrame) -> DataFrame:
    """Stored captures without a result, as those that came after the watermark."""
    keyed = captures.withColumn("_at", F.col("meta.captured_at"))
    there = results.select(F.col("url").alias("_url"), F.col("captured_at").alias("_answered"))
    same = F.col("url").eqNullSafe(F.col("_url")) & F.col("_at").eqNullSafe(F.col("_answered"))
    return keyed.join(there, same, "left_anti").drop("_at")


def ingest_streams(captures: DataFrame, fetches: DataFrame, timeout: str = FETCH_TIMEOUT,
                   watermark: str = LATENESS, salts: int = 1, **options) -> DataFrame:
    """Full ingest of two streams."""
    return answer(join_fetch_stream(captures, fetches, timeout, watermark, salts), **options)


def write_prepared(prepared: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Store prepared fetches, one of each URL, by a bucket of their URL.

    ``buckets`` should make some tens of megabytes each; ``ingest_buckets`` must be given the same.
    """
    own = prepared.withColumn("bucket", bucket_of("url", buckets))
    own.repartition("bucket").sortWithinPartitions("bucket", "url").write.partitionBy("bucket").parquet(path)


def bucket_of(url: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(buckets)).cast("int")


def prepared_for(captures: DataFrame, path: str, buckets: int = BUCKETS) -> DataFrame:
    """The stored fetches of the buckets that these captures are in; other folders are not read.

    What is collected is at most one number for each bucket.
    """
    wanted = captures.filter(F.col("url").isNotNull()).select(bucket_of("url", buckets).alias("b")).distinct()
    stored = captures.sparkSession.read.parquet(path)
    return stored.filter(F.col("bucket").isin([r.b for r in wanted.collect()])).drop("bucket")


def ingest_buckets(captures: DataFrame, prepared_path: str, path: str, checkpoint: str,
                   buckets: int = BUCKETS, available_now: bool = False, **options):
    """Answer a stream of captures, each micro-batch from the buckets of its own URLs.

    Results go to ``path``/results, a folder for each micro-batch, which is written again as a
    whole if the batch is repeated; the counters of the batch, taken on the way, go to
    ``path``/counters likewise. Returns the running query.
    """
    def work(batch: DataFrame, number: int) -> None:
        taken = Observation()
        prepared = prepared_for(batch, prepared_path, buckets)
        results = answer(join_candidates(batch, prepared), **options).observe(taken, *_counters())
        results.write.mode("overwrite").parquet(f"{path}/results/batch={number}")
        found = taken.get
        rows = [(*own, *(found.get(f"{name}_{i}") for name in COUNTED)) for i, own in enumerate(OUTCOMES)]
        batch.sparkSession.createDataFrame(rows, COUNTERS).coalesce(1).write.mode("overwrite").parquet(
            f"{path}/counters/batch={number}")

    writer = captures.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _counters() -> list[Column]:
    """Rows, and sums and numbers of scores, of every outcome."""
    out = []
    for i, (route, chosen) in enumerate(OUTCOMES):
        own = (F.col("route") == route) & (F.col("chosen") == chosen)
        out.append(F.count_if(own).alias(f"n_{i}"))
        for side in "ab":
            score = F.when(own, F.col(f"diagnostics.score_{side}"))
            out += [F.sum(score).alias(f"sum_{side}_{i}"), F.count(score).alias(f"n_{side}_{i}")]
    return out


def counted(spark: SparkSession, path: str) -> DataFrame:
    """The report of all micro-batches so far, as ``run_report`` gives it, from their counters."""
    rows = spark.read.schema(COUNTERS + ", batch long").parquet(f"{path}/counters")
    mean = lambda c: (F.sum(f"sum_{c}") / F.nullif(F.sum(f"n_{c}"), F.lit(0))).alias(f"avg_score_{c}")
    return rows.groupBy("route", "chosen").agg(F.sum("n").alias("n"), mean("a"), mean("b")).filter("n > 0")


def start(results: DataFrame, path: str, checkpoint: str, available_now: bool = False):
    """Append results to a parquet directory.

    The state of joins and aggregations is kept as ``STATE`` says, unless the session names a
    state store of its own.
    """
    writer = (
        results.writeStream.outputMode("append").format("parquet")
        .option("path", path).option("checkpointLocation", checkpoint)
    )
    conf = results.sparkSession.conf
    before = {k: conf.get(k, None) for k in STATE}
    own = before[PROVIDER] is not None
    try:
        for k, v in STATE.items() if not own else ():
            if before[k] is None:
                conf.set(k, v)
        # the query takes a copy of the settings
        return (writer.trigger(availableNow=True) if available_now else writer).start()
    finally:
        for k in STATE if not own else ():
            if before[k] is None:
                conf.unset(k)
