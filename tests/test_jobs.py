import json

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from pagemark.plans import ingest as job
from pagemark.sources import sinks, tables, validate
from pagemark.streaming import ingest as streams

LONG = "word and more text " * 60
FETCH = tables.FETCH_SCHEMA


def payload(url, **changes):
    record = {
        "url": url, "title": "Winter count",
        "html_extension": "<article><h1>Herons</h1><p>six</p></article>",
        "text_extension": "Herons six",
        "meta": {"captured_at": "2023-02-11T06:07:08Z", "unknown": 1,
                 "stats": {"char_count": 770, "headings": 3, "lists": 1}, "iframe_info": [],
                 "extraction_methods": ["semantic"]},
    }
    record.update(changes)
    return {k: v for k, v in record.items() if v is not None}


URLS = {name: f"https://example.com/{name}" for name in
        ("failed", "redirect", "empty", "paywall", "refetch", "tie", "absent", "iframe")}


@pytest.fixture(scope="module")
def captures(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("captures") / "c.json"
    lines = [json.dumps(payload(u)) for u in URLS.values()]
    lines += [json.dumps(payload(None)), json.dumps(payload("ftp://example.com/x")),
              json.dumps(payload("https://example.com/m", meta={"captured_at": "2023-02-11T06:07:08Z"})),
              '{"url": "https://example.com/cut']
    path.write_text("\n".join(lines))
    return tables.read_captures(spark, str(path))


@pytest.fixture(scope="module")
def fetches(spark):
    page = f"<html><body><article><p>{LONG}</p><p><a href='/x?utm_source=a'>l</a> with a tail of plain words</p></article></body></html>"
    thin = "<html><body><article><p>a few words only</p>{}</article></body></html>"
    same = "<article><h1>Herons</h1><p>six</p></article>"
    u = URLS
    rows = [
        (u["failed"], None, None, None, None, False, "Request timeout"),
        (u["redirect"], u["redirect"] + "/login", 200, "text/html", page, True, None),
        (u["empty"], u["empty"], 200, "text/html", "<html><body></body></html>", True, None),
        (u["paywall"], u["paywall"], 200, "text/html", thin.format("<i>Subscribe</i>"), True, None),
        (u["refetch"], u["refetch"], 200, "text/html", page, True, None),
        (u["refetch"], u["refetch"], 0, None, None, False, "HTTP error: older attempt"),
        (u["tie"], u["tie"] + "/", 200, "text/html", same, True, None),
        (u["iframe"], u["iframe"], 200, "text/html", thin.format("<iframe src=x></iframe>"), True, None),
    ]
    return tables.shape_fetches(spark.createDataFrame([(*r, None) for r in rows], FETCH))


@pytest.fixture(scope="module")
def results(captures, fetches):
    valid, _ = validate.validate_captures(captures)
    return job.ingest(valid, fetches).cache()


def test_quarantine(captures):
    valid, bad = validate.validate_captures(captures)
    assert valid.count() == len(URLS)
    assert sorted(r.reason for r in bad.collect()) == [
        "missing meta.stats", "missing url", "unparsable record", "url is not http(s)"]


def test_routes(results):
    rows = {r.url.rsplit("/", 1)[1]: r for r in results.collect()}
    assert {k: (r.route, r.chosen) for k, r in rows.items()} == {
        "failed": ("fetch_failed", "capture"), "absent": ("fetch_failed", "capture"),
        "redirect": ("redirect", "capture"), "empty": ("extraction_failed", "capture"),
        "paywall": ("blocker", "capture"), "refetch": ("compare", "refetch"),
        "tie": ("compare", "capture"), "iframe": ("compare", "capture"),
    }
    d = rows["redirect"].diagnostics
    assert d.redirect_detected and d.original_url.endswith("/redirect") and d.final_url.endswith("/login")
    assert (d.score_a, d.score_b) == (1.0, 0.0)
    assert rows["failed"].diagnostics.signals["capture"].len == len("Herons six")
    assert rows["failed"].blocker == "fetch-failed" and rows["paywall"].blocker == "paywall"
    assert rows["iframe"].blocker == "cross-origin-iframe" and rows["iframe"].blocker_penalty == 0.3
    assert "[l](https://example.com/x)" in rows["refetch"].markdown
    assert rows["tie"].markdown.endswith("# Herons\n\nsix")
    assert all("**Captured**: 2023-02-11 06:07:08 UTC" in r.markdown for r in rows.values())


def test_branches_make_up_the_whole(captures, fetches, results):
    valid, _ = validate.validate_captures(captures)
    joined = job.join_candidates(valid, job.latest_fetches(job.prepare_fetches(fetches)))
    parts = job.fallback_branch(joined).unionByName(job.compare_branch(joined))
    key = ["url", "route", "chosen", "markdown"]
    assert sorted(parts.select(key).collect()) == sorted(results.select(key).collect())


def test_metrics(spark, results, tmp_path):
    observation = Observation("run")
    seen = job.observed(results, observation)
    sinks.write_results(seen, str(tmp_path / "out"))
    assert observation.get["n"] == len(URLS) and observation.get["n_refetch"] == 1
    written = spark.read.parquet(str(tmp_path / "out"))
    assert {(r.host, r.filename) for r in written.collect()} == {("example.com", "Winter_count.md")}
    sinks.write_clustered(written, str(tmp_path / "clustered"))
    assert spark.read.parquet(str(tmp_path / "clustered")).count() == len(URLS)
    assert sum(r.n for r in job.run_report(results).collect()) == len(URLS)
    assert job.quarantine_errors(results).count() == 0
    sinks.write_markdown_text(results, str(tmp_path / "md"))
    assert "# Winter count" in "\n".join(
        r.value for r in spark.read.text(str(tmp_path / "md")).collect())


def test_backup(spark, results):
    pages = spark.createDataFrame(
        [("https://example.com/tie", "T t", "<p>"), ("https://example.com/lost", "L l", "<p>")],
        "url string, title string, html string")
    assert [(r.url, r.filename) for r in sinks.html_backup(pages, results).collect()] == [
        ("https://example.com/lost", "L_l_backup.html")]


@pytest.fixture
def settings(spark):
    """Set configuration values for one test."""
    changed = []

    def set_all(**values):
        for name, value in values.items():
            changed.append("spark.sql." + name.replace("__", "."))
            spark.conf.set(changed[-1], value)

    yield set_all
    for key in changed:
        spark.conf.unset(key)


def test_plan_has_one_shuffle_per_need(captures, fetches, settings):
    settings(autoBroadcastJoinThreshold="-1")
    valid, _ = validate.validate_captures(captures)
    plan = job.ingest(valid, fetches, escape=False)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan
    assert "SortMergeJoin" in plan and "BroadcastNestedLoopJoin" not in plan
    # captures once; fetches to find the latest, and again to come fresh into the join
    assert plan.count("Exchange hashpartitioning(url") == 3


def test_hot_url_is_split_and_kept_whole(spark, fetches, settings):
    settings(autoBroadcastJoinThreshold="-1", adaptive__autoBroadcastJoinThreshold="-1",
             adaptive__skewJoin__skewedPartitionThresholdInBytes="20KB",
             adaptive__advisoryPartitionSizeInBytes="20KB", adaptive__skewJoin__skewedPartitionFactor="1.5")
    url = F.when(F.col("id") % 3 == 0, F.concat(F.lit("https://example.com/"), "id")).otherwise(
        URLS["refetch"])
    text = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(30)),
                                        lambda i: F.md5(F.concat("id", i).cast("binary"))))
    hot = spark.range(0, 3000, 1, 8).select(url.alias("url"), text.alias("text"))
    joined = job.join_candidates(hot, job.latest_fetches(job.prepare_fetches(fetches)))
    out = joined.groupBy("fetch_ok").count()
    assert {r.fetch_ok: r["count"] for r in out.collect()} == {True: 2000, None: 1000}
    kept = joined.select("url", "text", "fetch_ok")
    kept.collect()
    assert "skew=true" in kept._jdf.queryExecution().executedPlan().toString()


def test_stream_equals_batch(spark, captures, fetches, results, tmp_path):
    valid, _ = validate.validate_captures(captures)
    valid.write.parquet(str(tmp_path / "in"))
    job.latest_fetches(job.prepare_fetches(fetches)).write.parquet(str(tmp_path / "prepared"))
    stream = streams.read_stream(spark, str(tmp_path / "in"), valid.schema)
    out = streams.ingest_stream(stream, spark.read.parquet(str(tmp_path / "prepared")))
    streams.start(out, str(tmp_path / "out"), str(tmp_path / "cp"), available_now=True).awaitTermination()
    key = ["url", "route", "chosen", "markdown"]
    got = spark.read.parquet(str(tmp_path / "out")).select(key).collect()
    assert sorted(got) == sorted(results.select(key).collect())


def test_stream_timeout(spark, captures, fetches, tmp_path):
    valid, _ = validate.validate_captures(captures)
    at = F.col("meta.captured_at")
    late = F.when(F.col("url").endswith("refetch"), 20).otherwise(5)
    timed = fetches.filter(~F.col("url").endswith("failed") & F.col("success")).withColumn(
        "fetched_at", F.to_timestamp(F.lit("2023-02-11T06:07:08Z")) + F.make_dt_interval(secs=late))
    end = F.make_dt_interval(hours=F.lit(1))
    tail_c = valid.limit(1).withColumn("url", F.lit("sentinel")).withColumn(
        "meta", F.col("meta").withField("captured_at", at + end))
    tail_f = timed.limit(1).withColumn("url", F.lit("sentinel")).withColumn(
        "fetched_at", F.col("fetched_at") + end)
    for c, f in ((valid, timed), (tail_c, tail_f)):
        c.write.mode("append").parquet(str(tmp_path / "c"))
        f.write.mode("append").parquet(str(tmp_path / "f"))
        out = streams.ingest_streams(
            streams.read_stream(spark, str(tmp_path / "c"), valid.schema),
            streams.read_stream(spark, str(tmp_path / "f"), timed.schema))
        streams.start(out, str(tmp_path / "o"), str(tmp_path / "cp"), available_now=True).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "o")).filter("url <> 'sentinel'").collect()
    routes = {r.url.rsplit("/", 1)[1]: r.route for r in rows}
    assert len(rows) == len(URLS)
    assert routes["refetch"] == "fetch_failed" and routes["absent"] == "fetch_failed"
    assert routes["tie"] == "compare" and routes["redirect"] == "redirect"


def test_stream_answers_each_capture_once(spark, captures, fetches, tmp_path):
    """Three files: fetches of a URL twice, a capture that is late, one that is too late."""
    valid, _ = validate.validate_captures(captures)
    at = F.col("meta.captured_at")
    start = F.to_timestamp(F.lit("2023-02-11T06:07:08Z"))

    def shifted(url, seconds):
        return valid.filter(F.col("url") == URLS["tie"]).withColumn("url", F.lit(url)).withColumn(
            "meta", F.col("meta").withField("captured_at", at + F.make_dt_interval(secs=F.lit(seconds))))

    page = fetches.filter(F.col("url") == URLS["tie"])
    twice = page.withColumn("fetched_at", start + F.make_dt_interval(secs=F.lit(3))).unionByName(
        page.withColumn("fetched_at", start + F.make_dt_interval(secs=F.lit(9))))
    waves = [(valid.unionByName(shifted(URLS["tie"], 0)), twice),
             (shifted("https://example.com/later", 100), twice.limit(0)),
             (shifted("https://example.com/late", 40), twice.limit(0)),
             (shifted("https://example.com/end", 7200), page.withColumn(
                 "fetched_at", start + F.make_dt_interval(secs=F.lit(7200)))),
             (shifted("https://example.com/lost", 5), twice.limit(0)),
             (shifted("https://example.com/end", 14400), page.withColumn(
                 "fetched_at", start + F.make_dt_interval(secs=F.lit(14400))))]
    for c, f in waves:
        c.write.mode("append").parquet(str(tmp_path / "c"))
        f.write.mode("append").parquet(str(tmp_path / "f"))
        out = streams.ingest_streams(
            streams.read_stream(spark, str(tmp_path / "c"), valid.schema),
            streams.read_stream(spark, str(tmp_path / "f"), twice.schema), watermark="5 minutes")
        streams.start(out, str(tmp_path / "o"), str(tmp_path / "cp"), available_now=True).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "o")).filter("url not like '%/end'")
    names = [r.url.rsplit("/", 1)[1] for r in rows.collect()]
    assert sorted(names) == sorted([*URLS, "later", "late"])
    stored = spark.read.parquet(str(tmp_path / "c"))
    missed = streams.unanswered(stored, rows).filter("url not like '%/end'")
    assert [r.url for r in missed.collect()] == ["https://example.com/lost"]


def test_state_of_streams_holds_what_is_asked_for(spark, captures, fetches, tmp_path):
    """Pages that nobody asks for are no state, and state is not on the heap."""
    valid, _ = validate.validate_captures(captures)
    words = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(2000)), lambda i: F.md5(
        F.concat("id", F.lit("-"), i).cast("binary"))))
    own = lambda df: spark.range(20).crossJoin(df.filter(F.col("url") == URLS["tie"])).withColumn(
        "url", F.concat("url", F.lit("/"), "id")).withColumn(
        "html", F.concat(F.lit("<article><p>"), words, F.lit("</p></article>")))
    c = own(valid).withColumn("text", words).drop("id")
    f = own(fetches).drop("id").withColumn("fetched_at", F.to_timestamp(F.lit("2023-02-11T06:07:10Z")))
    c.write.parquet(str(tmp_path / "c"))
    f.write.parquet(str(tmp_path / "f"))
    joined = streams.join_fetch_stream(
        streams.read_stream(spark, str(tmp_path / "c"), c.schema), streams.read_stream(spark, str(tmp_path / "f"), f.schema))
    run = streams.start(joined.select("url", "captured_at", "fetched_at", "fetch_ok"), str(tmp_path / "o"),
                        str(tmp_path / "cp"), available_now=True)
    run.awaitTermination()
    states = [s for p in run.recentProgress for s in p["stateOperators"]]
    assert max(s["numRowsUpdated"] for s in states) > 0
    assert all(any(k.startswith("rocksdb") for k in s["customMetrics"]) for s in states)
    assert sum(x.stat().st_size for x in (tmp_path / "cp/state").rglob("*") if x.is_file()) < 1_000_000
    assert not spark.conf.get(streams.PROVIDER).endswith("RocksDBStateStoreProvider")


def test_latest_fetch(spark, tmp_path):
    rows = [("u", 3, True, "b"), ("u", 9, False, "a"), ("u", 5, True, "c"), ("v", None, False, "x"),
            ("v", 1, False, "y"), ("w", 2, False, "p"), ("w", 2, True, "q"), (None, 1, True, "n")]
    log = spark.createDataFrame(rows, "url string, t long, success boolean, final_url string").withColumn(
        "fetched_at", F.timestamp_seconds("t")).drop("t")
    got = {r.url: r.final_url for r in job.latest_fetches(log.repartition(3)).collect()}
    assert got == {"u": "a", "v": "y", "w": "q", None: "n"}
    log.write.parquet(str(tmp_path / "log"))
    assert "fetched_at" in tables.read_fetches(spark, str(tmp_path / "log")).columns


def test_probe_errors_cost_a_penalty(spark, captures, fetches):
    valid, _ = validate.validate_captures(captures)
    failed = fetches.withColumn("probe_error", F.lit("Request timeout"))
    rows = {r.url: r for r in job.ingest(valid, failed).collect()}
    assert rows[URLS["tie"]].blocker_penalty == 0.3 and rows[URLS["refetch"]].blocker_penalty == 0.0


def test_tables_of_one_or_many_files(spark, tmp_path):
    rows = [(i, f"https://mill.test/{i}", "<p>heron</p>") for i in range(9)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    pages.repartition(3).write.parquet(str(tmp_path / "many/pages.parquet"))
    pages.toPandas().to_parquet(tmp_path / "pages.parquet")
    for folder in (tmp_path, tmp_path / "many"):
        assert tables.read_pages(spark, str(folder)).count() == 9
        assert tables.read_pages(spark, str(folder), 4).rdd.getNumPartitions() == 4
        stream = streams.read_stream(spark, f"{folder}/pages.parquet*", pages.schema)
        streams.start(stream, f"{folder}/o", f"{folder}/cp", available_now=True).awaitTermination()
        assert spark.read.parquet(f"{folder}/o").count() == 9


def test_hot_url_of_a_backup(spark, results):
    pages = spark.createDataFrame(
        [("https://example.com/lost", "L l", f"<p>{i}") for i in range(50)] + [(None, "n", "<p>")],
        "url string, title string, html string")
    backup = sinks.html_backup(pages, results)
    assert backup.count() == 51


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_newest_fetches_are_found_without_their_pages(spark, fetches, tmp_path):
    page = "<article><p>" + "heron on the mill pond " * 20 + "</p></article>"
    rows = [("u", 3, True, "b", page), ("u", 9, False, "a", None), ("v", None, False, "x", page),
            ("v", 1, True, "y", page + "."), ("w", 2, False, "p", page), ("w", 2, True, "q", page),
            ("w", 2, True, "q", page), (None, 1, True, "n", page), (None, 1, True, "n", page)]
    log = spark.createDataFrame(rows, "url string, t long, success boolean, final_url string, html string") \
        .withColumn("fetched_at", F.timestamp_seconds("t")).drop("t").withColumn("status_code", F.lit(200)) \
        .withColumn("error", F.lit(None).cast("string"))
    log.repartition(3).write.parquet(str(tmp_path / "log"))
    stored = spark.read.parquet(str(tmp_path / "log"))
    for own in (log, stored):
        got = sorted((r.url or "", r.final_url) for r in job.newest_fetches(own).collect())
        assert got == [("", "n"), ("u", "a"), ("v", "y"), ("w", "q")]
        assert sorted((r.url or "", r.final_url) for r in job.latest_fetches(job.prepare_fetches(own)).collect()) == got
    plan = plan_of(job.newest_fetches(stored).select("url", "html"))
    first = plan.index("Window [row_number()")  # the scan below it is that of the grouped side
    assert "html" not in plan[first:] and "file_path" in plan[first:]
    prepared = plan_of(job.prepare_fetches(job.newest_fetches(stored)))
    assert "regexp" not in prepared[prepared.index("Window [row_number()"):]


def test_stored_fetches_are_pruned_by_bucket(spark, captures, fetches, tmp_path):
    valid, _ = validate.validate_captures(captures)
    streams.write_prepared(job.latest_fetches(job.prepare_fetches(fetches)), str(tmp_path / "p"), 8)
    one = valid.filter(F.col("url") == URLS["tie"])
    own = streams.prepared_for(one, str(tmp_path / "p"), 8)
    plan = plan_of(own)
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [(bucket" in plan, plan
    assert URLS["tie"] in {r.url for r in own.collect()} and len(own.inputFiles()) >= 1
    assert own.count() < fetches.select("url").distinct().count()
    assert streams.prepared_for(valid.limit(0), str(tmp_path / "p"), 8).count() == 0
    assert set(own.columns) == set(job.latest_fetches(job.prepare_fetches(fetches)).columns)


def test_batches_of_buckets_can_be_repeated(spark, captures, fetches, results, tmp_path):
    valid, _ = validate.validate_captures(captures)
    valid.repartition(2).write.parquet(str(tmp_path / "in"))
    streams.write_prepared(job.latest_fetches(job.prepare_fetches(fetches)), str(tmp_path / "p"), 4)
    for checkpoint in ("one", "two"):  # the second run does all batches again
        stream = streams.read_stream(spark, str(tmp_path / "in"), valid.schema, maxFilesPerTrigger=1)
        streams.ingest_buckets(stream, str(tmp_path / "p"), str(tmp_path / "out"), str(tmp_path / checkpoint), 4,
                               available_now=True).awaitTermination()
    key = ["url", "route", "chosen", "markdown"]
    assert sorted(spark.read.parquet(str(tmp_path / "out/results")).select(key).collect()) == sorted(
        results.select(key).collect())
    shown = lambda df: sorted((r.route, r.chosen, r.n, round(r.avg_score_a, 9), round(r.avg_score_b, 9))
                              for r in df.collect())
    assert shown(streams.counted(spark, str(tmp_path / "out"))) == shown(job.run_report(results))


def test_outcomes_come_from_one_pass(spark, captures, fetches, results, tmp_path):
    captures.write.parquet(str(tmp_path / "c"))
    outcomes = job.ingest_to(spark.read.parquet(str(tmp_path / "c")), fetches, str(tmp_path / "out"))
    key = ["url", "route", "chosen", "markdown"]
    assert sorted(job.answered(outcomes).select(key).collect()) == sorted(results.select(key).collect())
    assert job.answered(outcomes).columns == results.columns
    _, bad = validate.validate_captures(captures)
    assert sorted(map(str, job.rejected(outcomes).collect())) == sorted(map(str, bad.select("url", "reason").collect()))
    assert outcomes.count() == captures.count()
    plan = plan_of(job.rejected(outcomes))
    assert "outcome#" in plan and "= rejected" in plan and "PartitionFilters" in plan
    none = job.ingest_to(captures.limit(0), fetches, str(tmp_path / "none"))
    assert job.answered(none).collect() == [] == job.rejected(none).collect()
