import json
import os
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from ledgerloom.limits import Limits
from ledgerloom.operators import activity, batches, envelopes
from ledgerloom.plans import extract
from ledgerloom.session import new_work_path
from ledgerloom.sources import hooks, payloads, sinks
from ledgerloom.streaming import activity as activity_stream
from ledgerloom.streaming import batches as batch_stream

T0 = datetime(2026, 1, 1)


def test_payload_checks(spark, tmp_path):
    def payload(name, items, **extra):
        (tmp_path / f"{name}.json").write_text(json.dumps({"batch_job_name": name, "country": "uae", "items": items, **extra}))

    payload("one", [{"id": "a", "custom_id": "b", "text": "t", "character_stored": "u"}])
    payload("full", [{"custom_id": str(i), "character_stored": ""} for i in range(100)])
    payload("over", [{"text": "t"}] * 101)
    payload("zero", [])
    payload("holes", [{"text": "t"}, {"id": "x"}, {}])
    payload("unnamed", [{"text": "t"}], batch_job_name=None, created_at="2026-01-02T03:04:05Z")
    checked = payloads.check_payloads(payloads.read_payloads(spark, str(tmp_path)))
    rows = {r.batch_job_name: r for r in checked.collect()}
    details = {n: r.error.detail for n, r in rows.items() if r.error}
    assert details == {
        "over": "body.items: List should have at most 100 items after validation, not 101",
        "zero": "body.items: List should have at least 1 item after validation, not 0",
        "holes": "body.items.1.text: Field required; body.items.2.text: Field required",
    }
    assert [n for n in rows if n.startswith("batches/loc_20260102_030405_")]
    one = payloads.payload_items(checked).filter("batch_job_name = 'one'").first()
    assert (one.custom_id, one.character_stored, one.item_no) == ("a", "t", 0)
    assert {r.batch_job_name: r.total_items for r in payloads.job_headers(checked).collect()}["full"] == 100


HEADERS = "batch_job_name string, total_items int, created_at timestamp"
RESULTS = "batch_job_name string, success boolean, finished_at timestamp"


def job_tables(spark):
    headers = spark.createDataFrame([(n, t, T0) for n, t in (("batches/a", 2), ("batches/b", 2), ("batches/c", 3), ("batches/d", 1))], HEADERS)
    results = spark.createDataFrame(
        [("batches/a", True, T0 + timedelta(seconds=5)), ("batches/a", False, T0 + timedelta(seconds=3)),
         ("batches/b", False, T0), ("batches/b", False, T0), ("batches/c", True, T0)], RESULTS)
    return headers, results


def test_status(spark):
    headers, results = job_tables(spark)
    got = {r.batch_job_name: r for r in batches.batch_status(headers, results).collect()}
    assert {n[-1]: (r.state, r.completed_items, r.failed_items) for n, r in got.items()} == {
        "a": ("COMPLETED", 1, 1), "b": ("COMPLETED", 0, 2), "c": ("PROCESSING", 1, 0), "d": ("PROCESSING", 0, 0)}
    assert got["batches/a"].updated_at == "2026-01-01T00:00:05+00:00"
    assert got["batches/d"].updated_at == got["batches/d"].created_at


def test_lookup(spark):
    headers, _ = job_tables(spark)
    names = ("a", " batches/b\t", "batches/batches/a", "batches/batches/batches/a", "x", None)
    requests = spark.createDataFrame([(n,) for n in names], "requested_name string")
    found, missing = batches.find_jobs(requests, headers)
    assert sorted(r.batch_job_name for r in found.collect()) == ["batches/a", "batches/a", "batches/b"]
    assert sorted(str(r.error.detail) for r in missing.collect()) == [
        "Batch job 'batches/batches/batches/a' was not found.", "Batch job 'x' was not found.", "None"]


def test_nested_results_are_whole_or_an_error(spark):
    rows = spark.range(0, 5050).selectExpr(
        "if(id < 50, 'small', 'hot') as batch_job_name", "cast(id as int) as item_no", "cast(id as string) as custom_id", "true as success",
        "cast(null as string) as data", "cast(null as string) as error", "cast(null as string) as token_usage",
        "timestamp_seconds(10000 - id) as finished_at", "id as seq")
    jobs = {r.batch_job_name: r for r in batches.nested_results(rows, Limits(max_batch_items=50)).collect()}
    assert [r.custom_id for r in jobs["small"].results] == [str(i) for i in range(49, -1, -1)]
    assert (jobs["small"].n_results, jobs["small"].error) == (50, None)
    assert jobs["hot"].results is None and jobs["hot"].n_results == 5000
    assert jobs["hot"].error.detail == "Batch job has more than 50 items: 5000"


def error_rows(spark, count):
    failed = spark.range(count).selectExpr(
        "timestamp_seconds(id div 3) as occurred_at", "id as seq", "'r' as request_id",
        "named_struct('status', 503, 'code', if(id % 2 = 0, 'ocr_unavailable', 'internal_error'), 'detail', 'd') as error")
    return envelopes.error_rows(failed)


def test_error_history(spark):
    for count, expected in ((25, 20), (120, 20), (5, 5)):
        rows = activity.recent_errors(error_rows(spark, count).repartition(4)).collect()
        assert [r.seq for r in rows] == list(range(count - 1, count - 1 - expected, -1))
    assert activity.recent_errors(error_rows(spark, 120), limit=1000).count() == 100
    rows = {(r.code, r.source, r.retryable) for r in error_rows(spark, 4).collect()}
    assert rows == {("ocr_unavailable", "ocr", True), ("internal_error", "api_server", False)}
    envelope = envelopes.error_envelopes(error_rows(spark, 1)).first()
    assert envelope.success is False and envelope.error.asDict() == {
        "code": "ocr_unavailable", "detail": "d", "source": "ocr", "retryable": True}


EVENTS = "token string, request_id string, operation string, kind string, ts timestamp"


def test_snapshot(spark):
    at = lambda s: T0 + timedelta(seconds=s)
    events = spark.createDataFrame(
        [("a", "r1", "op", "start", at(1)), ("b", "r2", "op", "start", at(2)), ("a", "r1", "op", "end", at(3)),
         ("late", "r3", "op", "start", at(50)), ("lost", "r4", "op", "end", at(2))], EVENTS)
    now = F.lit(at(10)).cast("timestamp")
    open_ = activity.open_requests(events, now)
    assert [(r.token, r.elapsed_seconds, r.phase) for r in open_.collect()] == [("b", 8.0, "processing")]
    status = activity.processing_status(open_, error_rows(spark, 30)).first()
    assert (status.active_count, status.available_slots, status.recent_error_count, status.is_processing) == (1, 3, 20, True)
    idle = activity.processing_status(open_.limit(0), error_rows(spark, 0)).first()
    assert (idle.active_count, idle.available_slots, idle.is_processing) == (0, 4, False)


def test_request_stream_over_several_micro_batches(spark, tmp_path):
    at = lambda s: T0 + timedelta(seconds=s)
    source, path, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    steps = [
        [("a", "r1", "op", "start", at(1)), ("early", "r", "op", "end", at(9)), ("x", "r", "op", "step", at(1))],
        [("b", "r2", "op", "start", at(2)), ("a", "r1", "op", "end", at(3))],
        [("early", "r3", "op", "start", at(4)), ("c", "r4", "op", "start", at(5)), ("c", "r4", "op", "end", at(6))],
    ]
    for rows in steps:
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(EVENTS).parquet(source)
        activity_stream.start_request_states(stream, path, checkpoint).awaitTermination()
    got = {r.token: (r.is_open, r.request_id) for r in activity_stream.request_states(spark, path).collect()}
    assert got == {"a": (False, "r1"), "b": (True, "r2"), "early": (False, "r3"), "c": (False, "r4")}




def appended(spark, source, rows, schema):
    """One more input file, and the stream of all files one by one."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)


def test_error_log_does_not_grow(spark, tmp_path):
    schema = "occurred_at timestamp, seq bigint, code string"
    source, path, checkpoint = (str(tmp_path / n) for n in ("in", "log", "cp"))
    rng, everything = random.Random(2), []
    for k in range(8):
        # Out of order, with ties in time, and an empty file.
        rows = [(T0 + timedelta(seconds=rng.randrange(500)), 100 * k + i, "c") for i in range(0 if k == 4 else 60)]
        everything += rows
        activity_stream.start_error_log(appended(spark, source, rows, schema), path, checkpoint).awaitTermination()
        kept = sorted(tuple(r) for r in activity_stream.kept_errors(spark, path).collect())
        assert kept == sorted(sorted(everything)[-100:])
        folders = [f for f in os.listdir(path) if f.startswith("batch=")]
        assert len(folders) <= 2 and spark.read.parquet(path).count() <= 200


def test_request_joins_over_a_restart(spark, tmp_path):
    at = lambda s: T0 + timedelta(seconds=s)
    source, path, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    files = [
        [("a", "r", "op", "start", at(0)), ("b", "r", "op", "start", at(5)), ("c", "r", "op", "start", at(6)), ("z", "r", "op", "end", at(1))],
        [("a", "r", "op", "end", at(30)), ("c", "r", "op", "step", at(40)), ("d", "r", "op", "start", at(70))],
        [("c", "r", "op", "end", at(200)), ("e", "r", "op", "start", at(1000)), ("d", "r", "op", "end", at(100))],
        [("f", "r", "op", "start", at(2000)), ("f", "r", "op", "end", at(2000))],
    ]
    for rows in files:  # each run goes on from the state of the one before
        stream = appended(spark, source, rows, EVENTS)
        activity_stream.start_request_joins(stream, path, checkpoint, "60 seconds", "100 seconds").awaitTermination()
    got = sorted((r.token, r.started_at, r.ended_at) for r in spark.read.parquet(path).collect())
    # b and e never end and c ends too late: they leave alone once no end can come any more.
    assert got == [
        ("a", at(0), at(30)), ("b", at(5), None), ("c", at(6), None), ("d", at(70), at(100)), ("e", at(1000), None), ("f", at(2000), at(2000))
    ]


def test_occupancy_sweep(spark):
    at = lambda s: T0 + timedelta(seconds=s)
    rows = [
        ("a", "r", "op", "start", at(1)), ("b", "r", "op", "start", at(2)), ("a", "r", "op", "end", at(3)), ("c", "r", "op", "start", at(3)),
        ("d", "r", "op", "end", at(4)), ("e", "r", "op", "start", at(6)), ("e", "r", "op", "end", at(5)), ("b", "r", "op", "step", at(7)),
    ]
    got = activity.slot_occupancy(spark.createDataFrame(rows, EVENTS).repartition(4), Limits(max_concurrent=2)).collect()
    assert sorted((r.ts, r.kind, r.token, r.active_count, r.available_slots) for r in got) == [
        (at(1), "start", "a", 1, 1), (at(2), "start", "b", 2, 0), (at(3), "end", "a", 1, 1), (at(3), "start", "c", 2, 0), (at(6), "start", "e", 3, 0)
    ]


def test_occupancy_needs_no_window_over_all_rows(spark):
    frame = activity.slot_occupancy(spark.createDataFrame([("a", "r", "op", "start", T0)], EVENTS))
    plan = frame._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("_part" in line for line in windows)


def test_progress_reads_a_bounded_number_of_folders(spark, tmp_path):
    schema = "batch_job_name string, success boolean, finished_at timestamp"
    source, path, checkpoint = (str(tmp_path / n) for n in ("in", "progress", "cp"))
    everything = []
    for k in range(11):
        rows = [(f"j{(k * 3 + i) % 7}", i % 3 > 0, T0 + timedelta(seconds=k)) for i in range(5)]
        everything += rows
        batch_stream.start_progress(appended(spark, source, rows, schema), path, checkpoint, every=4).awaitTermination()
        folders = batch_stream.progress_folders(spark, path)
        assert len(folders) <= 4 and len({f.split("/")[-2] for f in folders}) <= 2
        want = sorted(tuple(r) for r in batches.progress(spark.createDataFrame(everything, schema)).collect())
        assert sorted(tuple(r) for r in batch_stream.latest_progress(spark, path).collect()) == want


def test_batch_stream_equals_batch_job(spark, tmp_path):
    folder = tmp_path / "payloads"
    folder.mkdir()

    def submit(name, country, texts):
        body = {"batch_job_name": name, "country": country, "created_at": "2026-01-01T00:00:00Z",
                "items": [{"id": str(i), "text": t} for i, t in enumerate(texts)]}
        (folder / f"{name[-1]}.json").write_text(json.dumps(body))

    # A nested function travels to the workers by value.
    def factory():
        import json as js

        def call(prompt, text, country):
            if text == "slow":
                raise TimeoutError
            name = "invoice_number" if country == "india" else "invoice_no"
            content = "oops" if text == "bad" else js.dumps({name: text})
            return 200, js.dumps({"message": {"content": content}, "eval_count": 1})

        return call

    results, progress = str(tmp_path / "results"), str(tmp_path / "progress")
    schema = None
    for name, country, texts in (("batches/a", "uae", ["1", "bad"]), ("batches/b", "india", ["2", "slow", "3"])):
        submit(name, country, texts)
        batch_stream.start_batches(spark, str(folder), results, str(tmp_path / "cp1"), factory, {}).awaitTermination()
        schema = schema or spark.read.parquet(results).schema
        stream = spark.readStream.schema(schema).parquet(results)
        batch_stream.start_progress(stream, progress, str(tmp_path / "cp2")).awaitTermination()
    checked = payloads.check_payloads(payloads.read_payloads(spark, str(folder)))
    headers, table = payloads.job_headers(checked), spark.read.parquet(results)
    live = sorted(batch_stream.live_status(spark, headers, progress).collect())
    assert live == sorted(batches.batch_status(headers, table).collect())
    assert [(r.state, r.completed_items, r.failed_items) for r in live] == [("COMPLETED", 1, 1), ("COMPLETED", 2, 1)]
    once = batch_stream.results_of_items(payloads.payload_items(checked), factory, {})
    kept = ["batch_job_name", "item_no", "success", "data", "error"]
    assert sorted(map(str, table.select(*kept).collect())) == sorted(map(str, once.select(*kept).collect()))
    india = table.filter("custom_id = '0' and country = 'india'").first()
    assert json.loads(india.data)["discount"] == 0 and json.loads(india.data)["irn_number"] == "0"
    nested = {r.batch_job_name: r for r in batches.nested_results(table).collect()}
    assert len(nested["batches/b"].results) == 3


def test_extraction_from_uploads_to_tables(spark, tmp_path):
    uploads = spark.createDataFrame(
        [("d1", "uae", "r1", T0, 1, 3, None), ("d2", "usa", "r2", T0, 2, 1, None), ("d3", "usa", "r3", T0, 3, 1, (400, "empty_file", "x")),
         ("d4", "india", "r4", T0, 4, 1, None), ("d5", "france", "r5", T0, 5, 1, None), ("d6", None, "r6", T0, 6, 1, None)],
        "doc_key string, country string, request_id string, occurred_at timestamp, seq bigint, total_pages int, "
        "error struct<status:int,code:string,detail:string>")
    doc_pages = spark.createDataFrame(
        [(d, 1, "digital", f"Invoice {d} with enough characters in it") for d in ("d1", "d2", "d3", "d5", "d6")],
        "doc_key string, page_no int, layer string, text string")
    body = json.dumps({"message": {"content": '{"invoice_no": "d1", "net_amount": "5.5"}'}})
    responses = spark.createDataFrame([("d1", 200, body)], "doc_key string, http_status int, body string")
    replied = extract.save_replied(extract.prepare(uploads, doc_pages), responses, new_work_path(spark, "replied"))
    good = extract.all_envelopes(replied)
    row = good["uae"].first()
    assert row.metadata.total_pages == 3 and row.data.net_amount == 5.5 and not row.validation.is_valid
    assert good["usa"].count() == good["india"].count() == 0 and "validation" not in good["usa"].columns
    failed = {r.seq: (r.code, r.http_status) for r in extract.all_errors(replied).collect()}
    assert failed == {3: ("empty_file", 400), 4: ("document_extraction_failed", 422), 5: ("invalid_request", 400), 6: ("invalid_request", 400)}
    assert [r.doc_key for r in extract.pending(replied).collect()] == ["d2"]
    callers = spark.createDataFrame([("d1", " id-1 "), ("d2", "   ")], "doc_key string, invoice_id string")
    assert [r.invoice_id for r in envelopes.completion_envelopes(callers, good["uae"]).collect()] == ["id-1"]
    assert [r.error.code for r in envelopes.invalid_callers(callers).collect()] == ["invalid_invoice_id"]
    path = str(tmp_path / "out")
    sinks.write_json(good["uae"], path)
    record = spark.read.json(path).first()
    assert record.data.net_amount == 5.5 and "po_no" in record.data.asDict()


def test_model_hook_keeps_failures_as_rows(spark):
    def factory():
        def call(prompt, text, country):
            if text == "down":
                raise ConnectionError
            if text == "odd":
                raise RuntimeError("odd")
            return 200, prompt + text

        return call

    frame = spark.createDataFrame([(t, "uae", t) for t in ("down", "odd", "fine")], "doc_key string, country string, character_stored string")
    rows = {r.doc_key: (r.http_status, r.body, r.failure) for r in hooks.run_model(frame, factory, {"uae": "p:"}, calls_in_flight=2).collect()}
    assert rows == {"down": (None, None, "connect"), "odd": (None, None, "odd"), "fine": (200, "p:fine", None)}


def payload_file(folder, name, texts, country="usa"):
    body = {"batch_job_name": name, "country": country, "created_at": "2026-01-01T00:00:00Z",
            "items": [{"id": str(i), "text": t} for i, t in enumerate(texts)]}
    (folder / f"{name.replace('/', '_')}.json").write_text(json.dumps(body))


def test_results_come_in_completion_order(spark, tmp_path):
    folder = tmp_path / "payloads"
    folder.mkdir()
    payload_file(folder, "batches/a", ["0.9", "0.5", "0.0"])

    def factory():
        import json as js
        from time import sleep

        def call(prompt, text, country):
            sleep(float(text))
            return 200, js.dumps({"message": {"content": "{}"}})

        return call

    items = payloads.payload_items(payloads.check_payloads(payloads.read_payloads(spark, str(folder))))
    items.write.parquet(str(tmp_path / "items"))
    results = str(tmp_path / "results")
    batch_stream.start_batches(spark, str(folder), results, str(tmp_path / "cp"), factory, {}, calls_per_task=3).awaitTermination()
    at_once = batch_stream.results_of_items(spark.read.parquet(str(tmp_path / "items")), factory, {}, calls_per_task=3)
    for found in (at_once, batch_stream.results_so_far(spark, results)):
        assert [r.custom_id for r in batches.nested_results(found).first().results] == ["2", "1", "0"]
    # Calls that end at the same reading of the clock keep the order in which the task made them.
    still = hooks.run_model(items.coalesce(1), factory, {}, keys=("item_no",), clock=lambda: 5.0).orderBy("seq").collect()
    assert [r.item_no for r in still] == [0, 1, 2] and {r.finished_at for r in still} == {datetime(1970, 1, 1, 0, 0, 5)}


def test_a_batch_stream_that_dies_goes_on_with_each_item_once(spark, tmp_path):
    folder, marker = tmp_path / "payloads", str(tmp_path / "died")
    folder.mkdir()
    for k, texts in enumerate((["1", "2"], ["3"], ["4", "die", "5"], ["6"])):
        payload_file(folder, f"batches/{k}", texts)
        os.utime(folder / f"batches_{k}.json", (1_700_000_000 + k, 1_700_000_000 + k))

    def factory():
        import json as js
        import os as system

        class Lost(BaseException):
            pass

        def call(prompt, text, country):
            if text == "die" and not system.path.exists(marker):
                open(marker, "w").close()
                raise Lost
            return 200, js.dumps({"message": {"content": js.dumps({"invoice_no": text})}})

        return call

    results, checkpoint = str(tmp_path / "results"), str(tmp_path / "cp")
    first = batch_stream.start_batches(spark, str(folder), results, checkpoint, factory, {}, files_per_trigger=1)
    try:
        first.awaitTermination()
        raise AssertionError("the first run must die")
    except Exception:
        assert os.path.exists(marker)
    so_far = batch_stream.results_so_far(spark, results).select("batch_job_name", "custom_id").collect()
    assert sorted(map(tuple, so_far)) == [("batches/0", "0"), ("batches/0", "1"), ("batches/1", "0")]
    batch_stream.start_batches(spark, str(folder), results, checkpoint, factory, {}, files_per_trigger=1).awaitTermination()
    whole = batch_stream.results_of_items(
        payloads.payload_items(payloads.check_payloads(payloads.read_payloads(spark, str(folder)))), factory, {})
    kept = ["batch_job_name", "item_no", "success", "data"]
    resumed = sorted(map(tuple, batch_stream.results_so_far(spark, results).select(*kept).collect()))
    assert len(resumed) == 7 and resumed == sorted(map(tuple, whole.select(*kept).collect()))


def test_payload_files_that_are_no_json_are_rejected(spark, tmp_path):
    payload_file(tmp_path, "batches/good", ["t"])
    (tmp_path / "cut.json").write_text('{"batch_job_name": "batches/cut", "items": [{"text": "t"}')
    (tmp_path / "none.json").write_text("no json")
    checked = payloads.check_payloads(payloads.read_payloads(spark, str(tmp_path)))
    rows = {r.source.rsplit("/", 1)[1]: (r.batch_job_name, r.total_items, r.error and r.error.detail) for r in checked.collect()}
    assert rows == {"batches_good.json": ("batches/good", 1, None), "cut.json": (None, 0, "body: JSON decode error"),
                    "none.json": (None, 0, "body: JSON decode error")}
    assert [r.batch_job_name for r in payloads.job_headers(checked).collect()] == ["batches/good"]
    lines = tmp_path / "lines"
    lines.mkdir()
    (lines / "a.json").write_text('{"batch_job_name": "x", "items": [{"text": "t"}]}\nno json\n{"batch_job_name": "y", "items": []}\n')
    found = payloads.check_payloads(payloads.read_payloads(spark, str(lines), lines=True)).collect()
    assert [(r.batch_job_name, r.error is None) for r in found] == [("x", True), (None, False), ("y", False)]
