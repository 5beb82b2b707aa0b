"""Registered queries: every operator over the given tables, whole."""

from __future__ import annotations

import functools
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import dates, errors, identifiers, text, times
from ledgerloom.functions.money import MONEY, clean_money, to_json_number
from ledgerloom.limits import DEFAULT
from ledgerloom.operators import (
    activity,
    batches,
    countries,
    envelopes,
    file_checks,
    india,
    items,
    label_fields,
    layout,
    pages,
    parse,
    prepare,
    uae,
)
from ledgerloom.plans import derived, extract
from ledgerloom.session import configure, new_work_path
from ledgerloom.sources import files, hooks, ocr, payloads, sinks
from ledgerloom.streaming import activity as activity_stream
from ledgerloom.streaming import batches as batch_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return function(configure(spark), sf_dir)

    QUERIES[function.__name__] = run
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _union(parts: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, parts)


def error_columns() -> list:
    return [F.col("error.status").alias("status"), F.col("error.code").alias("code"),
            F.col("error.detail").alias("detail")]


def money(name: str):
    return F.round(to_json_number(F.col(name)), 2).alias(name)


# --- pages and texts ---------------------------------------------------------


def _inlined(columns: list[str], rows: list[tuple[str, ...]]) -> str:
    """Several rows from each row, as one generator; the last expression of a row may leave it out."""
    made = []
    for *values, kept in rows:
        struct = ", ".join(f"'{n}', {v}" for n, v in zip(columns, values))
        made.append(f"case when {kept} then named_struct({struct}) end")
    return f"inline(array_compact(array({', '.join(made)})))"


@query
def page_assembly(spark, sf_dir):
    rows = [(key, f"cast({page} as int)", "'digital'", "text", "true") for key, page in derived.BINDERS]
    doc_pages = table(spark, sf_dir, "conversations").selectExpr(
        _inlined(["doc_key", "page_no", "layer", "text"], rows)
    )
    return pages.document_text(doc_pages).select(
        "doc_key", "total_pages", "extraction_method", "used_ocr", "text", "character_count",
        *error_columns(),
    )


def _two_layers(spark, sf_dir) -> DataFrame:
    rows = []
    for key, page, digital, ocr, kept in derived.LAYERED_PAGES:
        rows += [(key, f"cast({page} as int)", f"'{n}'", t, kept) for n, t in (("digital", digital), ("ocr", ocr))]
    return table(spark, sf_dir, "conversations").selectExpr(_inlined(["doc_key", "page_no", "layer", "text"], rows))


@query
def page_numbers(spark, sf_dir):
    """Pages of flat rows, numbered in their documents; three documents hold all conversations."""
    rows = [("cast(conv_id as string)", "turn", "text", "true"), ("'all-' || cast(conv_id % 3 as string)", "conv_id * 1000 + turn", "text", "true")]
    flat = table(spark, sf_dir, "conversations").selectExpr(_inlined(["doc_key", "place", "text"], rows))
    return pages.number_page_rows(flat, "doc_key", ["place"]).select("doc_key", "place", "page_no")


@query
def digital_routing(spark, sf_dir):
    return pages.document_text(_two_layers(spark, sf_dir)).select(
        "doc_key", "extraction_method", "used_ocr", "text", "character_count", "total_pages",
        *error_columns(),
    )


@query
def documents_needing_ocr(spark, sf_dir):
    both = _two_layers(spark, sf_dir)
    pdfs = both.groupBy("doc_key").agg(F.max("page_no").alias("page_count"))
    return pages.documents_needing_ocr(pdfs, both.filter("layer = 'digital'"))


@query
def prepared_text(spark, sf_dir):
    return prepare.prepare_pages(_two_layers(spark, sf_dir)).select(
        "doc_key", "extraction_method", "total_pages", "character_stored", "character_count",
        "estimated_tokens", *error_columns(),
    )


@query
def preparation_envelopes(spark, sf_dir):
    prepared = prepare.prepare_pages(_two_layers(spark, sf_dir)).withColumn(
        "request_id", F.concat(F.lit("req-"), F.col("doc_key"))
    )
    return envelopes.preparation_envelopes(prepared)


@query
def text_compaction(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").selectExpr(
        "doc_id", f"{derived.SPACED_TEXT} as text"
    )
    compacted = documents.withColumn("compacted", text.compact(F.col("text")))
    return compacted.select("doc_id", "compacted", F.length("compacted").alias("n_compacted"))


@query
def token_ceiling(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return prepare.prepare_texts(documents).select(
        "doc_id", "character_count", "estimated_tokens", *error_columns()
    )


@query
def evidence_fold(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").selectExpr(
        "doc_id", "text", f"{derived.PROBE} as probe"
    )
    return documents.select(
        "doc_id",
        text.fold(F.col("probe")).alias("folded_probe"),
        text.fold(F.col("text")).contains(text.fold(F.col("probe"))).alias("is_found"),
    )


# --- uploads -----------------------------------------------------------------


@query
def file_kind(spark, sf_dir):
    from_documents = table(spark, sf_dir, "documents").selectExpr(
        *derived.UPLOAD_FACTS,
        f"concat(unhex({derived.UPLOAD_HEAD}), encode(text, 'utf-8')) as content",
    )
    checked = file_checks.check_uploads(from_documents)
    return checked.select("doc_id", "kind", "total_pages", *error_columns())


@query
def web_pages_rejected(spark, sf_dir):
    uploads = table(spark, sf_dir, "pages").selectExpr(
        "page_id", "encode(html, 'utf-8') as content", "octet_length(html) as length",
        "false as opens", "false as needs_pass", "0 as page_count",
        "cast(null as string) as decoded_format", "cast(null as int) as width",
        "cast(null as int) as height",
    )
    return file_checks.check_uploads(uploads).select("page_id", "kind", "length", *error_columns())


@query
def upload_files(spark, sf_dir):
    """Documents as files of a folder, read back by content; oversize files are never opened."""
    folder = new_work_path(spark, "uploads")
    documents = table(spark, sf_dir, "documents").selectExpr("doc_id", f"{derived.UPLOAD_FILE} as content")
    sinks.write_files(documents, folder, "doc_id", "content")
    small, oversize = files.split_by_size(files.read_uploads(spark, folder))
    content = F.col("content")
    opened = small.select("path", "length", file_checks.detect_kind(content).alias("kind"), F.md5(content).alias("content_md5"))
    unopened = oversize.select("path", "length", *[F.lit(None).cast("string").alias(c) for c in ("kind", "content_md5")])
    # Facts of the engines that open files; here every file opens.
    facts = {"opens": "true", "needs_pass": "false", "page_count": "1", "decoded_format": "kind", "width": "1", "height": "1"}
    found = opened.unionByName(unopened).withColumns({n: F.expr(e) for n, e in facts.items()})
    return found.withColumn("error", file_checks.upload_error(F.col("kind"))).select(
        F.regexp_extract("path", "doc_id=(-?[0-9]+)", 1).cast("bigint").alias("doc_id"),
        "length", "kind", "content_md5", *error_columns(),
    )


@query
def payload_files(spark, sf_dir):
    """Payloads as one JSON body per file, every 13th cut off before its end."""
    folder = new_work_path(spark, "payloads")
    bodies = _payload_rows(spark, sf_dir, "doc_id").select("doc_id", F.to_json(F.struct("batch_job_name", "country", "items")).alias("body"))
    cut = F.when(F.col("doc_id") % 13 == 5, F.expr("left(body, length(body) - 1)")).otherwise(F.col("body"))
    sinks.write_files(bodies.withColumn("body", cut), folder, "doc_id", "body")
    checked = payloads.check_payloads(payloads.read_payloads(spark, folder))
    texts = F.transform("items", lambda i: F.coalesce(i["text"], i["character_stored"]))
    return checked.select(
        F.regexp_extract("source", "doc_id=(-?[0-9]+)", 1).cast("bigint").alias("doc_id"),
        "batch_job_name", "total_items",
        F.when(F.col("error").isNull(), F.md5(F.array_join(texts, "\n"))).alias("texts_md5"),
        *error_columns(),
    )


@query
def ocr_extractor(spark, sf_dir):
    """Caller's OCR hook; a stand-in engine that decodes text, one page per blank line."""

    def factory():
        def extract_pages(content: bytes, kind: str):
            if kind == "jpeg":
                raise ValueError("unreadable")
            return content.decode("utf-8").split("\n\n")

        return extract_pages

    documents = table(spark, sf_dir, "documents").selectExpr(
        "cast(doc_id as string) as doc_key",
        "case when doc_id % 9 = 0 then 'jpeg' else 'pdf' end as kind",
        "encode(text, 'utf-8') as content",
    )
    return hooks.run_text_extractor(documents, factory).select(
        "doc_key", "page_no", "layer", "text", "failure"
    )


# --- OCR layout --------------------------------------------------------------


@query
def ocr_layout(spark, sf_dir):
    boxes = table(spark, sf_dir, "lineitem").selectExpr(*derived.BOXES)
    return layout.pages_from_boxes(boxes).select(
        "doc_key", "box_count", "text", F.col("error.code").alias("code")
    )


@query
def ocr_results(spark, sf_dir):
    bodies = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", f"{derived.OCR_BODY} as body"
    )
    return ocr.page_texts(bodies).select("o_orderkey", "text")


@query
def ocr_boxes(spark, sf_dir):
    bodies = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", f"{derived.OCR_BODY} as body"
    )
    return ocr.flat_boxes(bodies).select(
        "o_orderkey", "ord", "top", "left", "right", "height", "text"
    )


@query
def ocr_legacy_results(spark, sf_dir):
    bodies = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", f"{derived.OCR_LEGACY_BODY} as body"
    )
    return ocr.legacy_page_texts(bodies).select("o_orderkey", "text")


# --- amounts, dates, identifiers ---------------------------------------------


@query
def clean_money_texts(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", f"{derived.MONEY_TEXT} as amount_text"
    )
    return orders.select(
        "o_orderkey", to_json_number(clean_money(F.col("amount_text"))).alias("amount")
    )


@query
def iso_dates(spark, sf_dir):
    events = table(spark, sf_dir, "events").selectExpr(
        "event_id", f"{derived.DATE_TEXT} as date_text"
    )
    return events.select(
        "event_id", "date_text", dates.is_iso_date(F.col("date_text")).alias("is_valid")
    )


@query
def printed_dates(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", f"{derived.PRINTED_DATE} as printed"
    )
    return orders.select(
        "o_orderkey", dates.normalise_printed_date(F.col("printed")).alias("normalised")
    )


@query
def job_names(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    name = identifiers.job_name(F.col("ts"), F.col("props"))
    return events.select(
        "event_id", name.alias("batch_job_name"), identifiers.job_key(name).alias("short_name")
    )


@query
def request_ids(spark, sf_dir):
    requests = table(spark, sf_dir, "pages").selectExpr(
        "page_id", f"{derived.REQUEST_ID_CANDIDATE} as requested"
    )
    kept = identifiers.has_safe_shape(F.col("requested"))
    new_id = identifiers.request_id(F.col("requested"))
    return requests.select(
        "page_id",
        kept.alias("is_kept"),
        F.when(kept, new_id).alias("kept_id"),
        F.length(F.when(~kept, new_id)).alias("new_id_length"),
    )


@query
def request_log(spark, sf_dir):
    requests = table(spark, sf_dir, "events").selectExpr(*derived.REQUESTS)
    return activity.request_log(requests).select("event_id", "path", "duration_ms")


# --- records -----------------------------------------------------------------


@query
def items_flatten(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", f"{derived.ITEMS_SPARK} as items"
    )
    filled = orders.withColumn("items", india.fill_serial_numbers(F.col("items")))
    return items.flatten(filled, "o_orderkey", "items").select(
        "o_orderkey", "position", "sr_no", "description",
        to_json_number(F.col("amount")).alias("amount"),
    )


@query
def items_nest(spark, sf_dir):
    """Lists per order, and per 64 orders (negative keys), of which some exceed the limit."""
    orders = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", f"{derived.ITEMS_SPARK} as items"
    )
    flat = items.flatten(orders, "o_orderkey", "items", keep_empty=False)
    merged = flat.withColumns(
        {"position": (F.col("o_orderkey") % 64 * 4 + F.col("position")).cast("int"), "o_orderkey": F.expr("-1 - cast(floor(o_orderkey / 64) as bigint)")}
    )
    return items.nest(flat.unionByName(merged), "o_orderkey", "items", max_items=DEFAULT.max_batch_items).select(
        "o_orderkey",
        "n_items",
        F.array_join(F.transform("items", lambda i: i["description"]), ",").alias("descriptions"),
        F.col("error.detail").alias("detail"),
    )


@query
def items_numbered(spark, sf_dir):
    """Serial numbers of flat items; three invoices hold a third of all items each."""
    rows = [(key, place, derived.FLAT_SERIAL, "true") for key, place in derived.FLAT_ITEMS]
    flat = table(spark, sf_dir, "lineitem").selectExpr(_inlined(["doc_key", "place", "sr_no"], rows))
    return india.number_items(flat, "doc_key", ["place"]).select("doc_key", "place", "sr_no")


@query
def india_reconcile(spark, sf_dir):
    headers = table(spark, sf_dir, "orders").selectExpr(*derived.INDIA_HEADERS)
    headers = headers.withColumns(
        {n: F.col(n).cast(MONEY) for n, t in headers.dtypes if t.startswith("decimal")}
    )
    lines = table(spark, sf_dir, "lineitem")
    item_rows = lines.selectExpr(*derived.INDIA_ITEMS)
    tax_rows = lines.selectExpr(*derived.INDIA_TAXES)
    return india.reconcile_tables(headers, item_rows, tax_rows).select(
        "doc_key",
        *[
            money(n)
            for n in (
                "taxable_amount", "cgst_amount", "sgst_amount", "igst_amount", "invoice_amount",
                "discount", "state_cess", "other_charges",
            )
        ],
        "customer_pan", "vendor_pan", "invoice_date", "irn_number",
    )


@query
def india_records(spark, sf_dir):
    """The same rules on nested records, with the two optional rules on."""
    orders = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", f"{derived.INDIA_JSON} as json"
    )
    records = parse.read_records(orders, "json", countries.COUNTRIES["india"])
    ruled = india.reconcile(records, default_quantity=True, rebuild_hsn=True)
    return ruled.select(
        "o_orderkey",
        *[
            F.round(to_json_number(F.col(f"data.{n}")), 2).alias(n)
            for n in ("taxable_amount", "cgst_amount", "sgst_amount", "invoice_amount")
        ],
        F.col("data.hsn_sac_code").alias("hsn_sac_code"),
        F.col("data.irn_number").alias("irn_number"),
        F.array_join(F.transform("data.items", lambda i: i["sr_no"]), ",").alias("serials"),
        to_json_number(
            F.aggregate("data.items", F.lit(0).cast(MONEY),
                        lambda a, i: (a + F.coalesce(i["quantity"], F.lit(0))).cast(MONEY))
        ).alias("total_quantity"),
    )


@query
def uae_validate(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    customers = table(spark, sf_dir, "customer")
    records = orders.join(customers, orders.o_custkey == customers.c_custkey, "left").selectExpr(
        *derived.UAE_RECORD
    )
    fields = [c for c in records.columns if c not in ("o_orderkey", "character_stored")]
    nested = records.select("o_orderkey", "character_stored", F.struct(*fields).alias("data"))
    return uae.validate(nested).select(
        "o_orderkey",
        F.col("validation.is_valid").alias("is_valid"),
        F.array_join("validation.warnings", "; ").alias("warnings"),
    )


@query
def json_clean(spark, sf_dir):
    events = table(spark, sf_dir, "events").selectExpr(
        "event_id", f"{derived.REPLY_TEXT} as reply"
    )
    return events.select("event_id", parse.clean_json(F.col("reply")).alias("json"))


@query
def reply_envelopes(spark, sf_dir):
    events = table(spark, sf_dir, "events").selectExpr(
        "event_id", f"{derived.REPLY_STATUS} as http_status", f"{derived.REPLY_BODY} as body"
    )
    return parse.read_envelopes(events).select(
        "event_id", "json", "token_usage.input_tokens", "token_usage.output_tokens",
        "token_usage.total_tokens", "token_usage.execution_time_ms", *error_columns(),
    )


@query
def schema_strict(spark, sf_dir):
    events = table(spark, sf_dir, "events").selectExpr(
        "event_id", f"{derived.STRICT_JSON_SPARK} as json"
    )
    records = parse.read_records(events, "json", countries.COUNTRIES["uae"])
    return records.select(
        "event_id",
        F.array_join("problems", ",").alias("problems"),
        F.col("data.vendor_name").alias("vendor_name"),
        F.col("data.currency").alias("currency"),
        to_json_number(F.col("data.net_amount")).alias("net_amount"),
        to_json_number(F.col("data.grand_total")).alias("grand_total"),
        F.size("data.items").alias("n_items"),
    )


@query
def label_fields_uae(spark, sf_dir):
    return _labelled(spark, sf_dir, "uae")


@query
def label_fields_usa(spark, sf_dir):
    return _labelled(spark, sf_dir, "usa")


@query
def label_fields_india(spark, sf_dir):
    return _labelled(spark, sf_dir, "india")


def _labelled(spark, sf_dir, country):
    texts = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", f"{derived.PRINTED_INVOICES[country]} as text"
    )
    found = label_fields.extract_fields(texts, country)
    columns = [
        to_json_number(F.col(r.name)).alias(r.name) if r.kind == "money" else F.col(r.name)
        for r in label_fields.RULES[country]
    ]
    return found.select("o_orderkey", *columns)


# --- jobs --------------------------------------------------------------------


def _job_headers(events: DataFrame) -> DataFrame:
    """Jobs of the events; every second job still waits for one more item."""
    return events.groupBy("user_id").agg(
        F.min("ts").alias("created_at"),
        (F.count(F.lit(1)) + F.first("user_id") % 2).alias("total_items"),
    ).selectExpr(f"{derived.JOB_OF_USER} as batch_job_name", "created_at", "total_items")


def _job_results(events: DataFrame) -> DataFrame:
    return events.selectExpr(
        f"{derived.JOB_OF_USER} as batch_job_name",
        "event_type <> 'error' as success",
        "ts as finished_at",
    )


@query
def batch_status(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return batches.batch_status(_job_headers(events), _job_results(events))


@query
def batch_lookup(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    requests = events.selectExpr("event_id", f"{derived.REQUESTED_JOB} as requested_name")
    return batches.lookup_jobs(requests, _job_headers(events)).select(
        "event_id", "batch_job_name", "total_items",
        F.col("error.status").alias("status"), F.col("error.detail").alias("detail"),
    )


def _payload_rows(spark, sf_dir, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(
        *columns,
        "'batches/loc_' || cast(doc_id as string) as batch_job_name",
        f"{derived.PAYLOAD_COUNTRY} as country",
        "cast(null as timestamp) as created_at",
        f"{derived.PAYLOAD_ITEMS_SPARK} as items",
    )


@query
def batch_payloads(spark, sf_dir):
    """Payloads from documents: one item per paragraph line."""
    checked = payloads.check_payloads(_payload_rows(spark, sf_dir))
    accepted = payloads.payload_items(checked).select(
        "batch_job_name", "item_no", "custom_id", "character_stored",
        F.lit(None).cast("string").alias("detail"),
    )
    rejected = checked.filter(F.col("error").isNotNull()).select(
        "batch_job_name", F.lit(None).cast("int").alias("item_no"),
        F.lit(None).cast("string").alias("custom_id"),
        F.lit(None).cast("string").alias("character_stored"),
        F.col("error.detail").alias("detail"),
    )
    return accepted.unionByName(rejected)


@query
def batch_results(spark, sf_dir):
    results = table(spark, sf_dir, "events").selectExpr(
        f"cast({derived.BLOCK_OF_EVENT} as string) as batch_job_name",
        "cast(event_id % 100 as int) as item_no",
        "cast(event_id as string) as custom_id",
        "event_type <> 'error' as success",
        "props as data",
        "cast(null as string) as error",
        "cast(null as string) as token_usage",
        "ts as finished_at",
        "event_id as seq",
    )
    return batches.nested_results(results).select(
        "batch_job_name",
        "n_results",
        F.array_join(
            F.transform("results", lambda r: F.concat(r["custom_id"], F.lit(":"), r["success"].cast("string"))),
            ",",
        ).alias("results"),
        F.col("error.detail").alias("detail"),
    )


@query
def completion_join(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").selectExpr(
        "cast(doc_id as string) as doc_key", "n_chars"
    )
    callers = table(spark, sf_dir, "labels").selectExpr(
        "cast(doc_id as string) as doc_key", f"{derived.INVOICE_ID} as invoice_id"
    )
    completed = envelopes.completion_envelopes(callers, documents)
    rejected = envelopes.invalid_callers(callers)
    return completed.select(
        "doc_key", "invoice_id", "n_chars", F.lit(None).cast("string").alias("code")
    ).unionByName(
        rejected.select(
            "doc_key", F.lit(None).cast("string").alias("invoice_id"),
            F.lit(None).cast("bigint").alias("n_chars"), F.col("error.code").alias("code"),
        )
    )


@query
def country_dispatch(spark, sf_dir):
    suppliers = table(spark, sf_dir, "supplier")
    nations = table(spark, sf_dir, "nation")
    routed = (
        suppliers.join(nations, suppliers.s_nationkey == nations.n_nationkey, "left")
        .selectExpr("s_suppkey", "n_name", f"{derived.ROUTE} as path")
        .withColumn("country", countries.country_of_route(F.col("path")))
    )
    parts = [
        rows.withColumn("n_fields", F.lit(len(countries.COUNTRIES[name].order)))
        for name, rows in countries.split_by_country(routed).items()
    ]
    parts.append(
        routed.filter(F.col("country").isNull()).withColumn("n_fields", F.lit(0))
    )
    return _union(parts).select("s_suppkey", "n_name", "country", "n_fields")


# --- errors and activity -----------------------------------------------------


def _failed_events(events: DataFrame) -> DataFrame:
    return events.selectExpr(
        "ts as occurred_at", "event_id as seq", "cast(user_id as string) as request_id",
        f"named_struct('status', {derived.EVENT_STATUS}, 'code', {derived.EVENT_CODE},"
        " 'detail', props) as error",
    )


@query
def error_classify(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    rows = envelopes.error_rows(_failed_events(events))
    return rows.select("seq", "request_id", "source", "code", "http_status", "retryable", "detail")


@query
def error_envelopes(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    rows = envelopes.error_rows(_failed_events(events))
    return envelopes.error_envelopes(rows).select(
        "success", "request_id", F.to_json("error").alias("error")
    )


@query
def request_errors(spark, sf_dir):
    events = table(spark, sf_dir, "events").selectExpr(
        "event_id", f"{derived.PROBLEMS_SPARK} as problems"
    )
    return events.select(
        "event_id", errors.validation_detail(F.col("problems")).alias("detail")
    )


def _error_history(events: DataFrame) -> DataFrame:
    return envelopes.error_rows(_failed_events(events.filter("event_type = 'error'")))


@query
def recent_errors(spark, sf_dir):
    history = _error_history(table(spark, sf_dir, "events"))
    return activity.recent_errors(history).select(
        "seq", times.iso_timestamp(F.col("occurred_at")).alias("occurred_at"), "source", "code",
        "http_status", "retryable",
    )


def _request_events(events: DataFrame) -> DataFrame:
    return events.selectExpr(*derived.REQUEST_EVENTS).withColumn(
        "token", F.col("pair").cast("string")
    )


def _newest_moment(events: DataFrame):
    """The time of the newest event, the moment that a snapshot answers for."""
    return events.agg(F.max("ts")).scalar()


@query
def open_requests(spark, sf_dir):
    events = _request_events(table(spark, sf_dir, "events"))
    return activity.open_requests(events, _newest_moment(events)).select(
        "token", "request_id", "operation", "phase", "elapsed_seconds"
    )


@query
def processing_snapshot(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    open_ = activity.open_requests(_request_events(events), _newest_moment(events))
    return activity.processing_status(open_, _error_history(events))


@query
def slot_occupancy(spark, sf_dir):
    """Active requests and free slots at every start and end."""
    events = _request_events(table(spark, sf_dir, "events"))
    return activity.slot_occupancy(events).select(
        times.iso_timestamp(F.col("ts")).alias("at"), "token", "kind", "active_count", "available_slots"
    )


# --- streams -----------------------------------------------------------------


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", "events.parquet")
        .parquet(sf_dir)
    )


def _arriving(spark: SparkSession, events: DataFrame, path: str, files: range, of: int) -> None:
    """Writes some of ``of`` files with equal stretches of time, in their order; ids stay in pairs."""
    first, last = events.agg(F.min("ts"), F.max("ts")).first()
    if first is None:
        return
    seconds = (last - first).total_seconds() / of
    moment = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6) - F.unix_micros(F.lit(first).cast("timestamp")) / F.lit(1e6)
    stretch = F.least(F.floor(moment / seconds), F.lit(of - 1)) if seconds else F.lit(0)
    for k in files:
        events.filter(stretch == k).coalesce(1).write.mode("append").parquet(path)


def _in_two_runs(spark: SparkSession, sf_dir: str, start: Callable, files: int = 10) -> None:
    """Streams the events file by file, stops after half of them and goes on from the checkpoint."""
    events = table(spark, sf_dir, "events")
    path = new_work_path(spark, "arriving")
    for half in (range(files // 2), range(files // 2, files)):
        _arriving(spark, events, path, half, files)
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)
        start(stream).awaitTermination()


@query
def stream_batch_status(spark, sf_dir):
    """Status from the progress log of ten micro-batches, with a snapshot at every fourth."""
    path, checkpoint = new_work_path(spark, "progress"), new_work_path(spark, "progress-checkpoint")
    _in_two_runs(spark, sf_dir, lambda s: batch_stream.start_progress(_job_results(s), path, checkpoint, every=4))
    return batch_stream.live_status(spark, _job_headers(table(spark, sf_dir, "events")), path)


@query
def stream_batch_results(spark, sf_dir):
    """Lists of results of jobs whose payload files arrive over six micro-batches, with a restart in the middle."""

    def factory():
        def call(prompt: str, document: str, country: str):
            if len(document) % 7 == 3:
                raise TimeoutError
            content = json.dumps({"vendor_name": str(len(document))}) if len(document) % 11 != 5 else "oops"
            return 200, json.dumps({"message": {"content": content}, "eval_count": 1})

        return call

    folder, results, checkpoint = (new_work_path(spark, n) for n in ("payloads", "results", "results-checkpoint"))
    bodies = _payload_rows(spark, sf_dir, "doc_id")
    # Three micro-batches a run, with as many files in each as the table has splits.
    files_each = max(1, bodies.rdd.getNumPartitions())
    for run in (0, 1):
        arriving = bodies.filter(F.pmod("doc_id", F.lit(2)) == run).drop("doc_id").repartition(3 * files_each)
        arriving.write.mode("append").json(folder)
        batch_stream.start_batches(
            spark, folder, results, checkpoint, factory, {}, files_per_trigger=files_each, lines=True
        ).awaitTermination()
    found = batch_stream.results_so_far(spark, results)
    headers = payloads.job_headers(payloads.check_payloads(payloads.read_payloads(spark, folder, lines=True)))
    lists = batches.nested_results(found).select(
        "batch_job_name", "n_results",
        F.array_join(F.array_sort(F.transform("results", lambda r: F.concat(r["custom_id"], F.lit(":"), F.coalesce(
            F.get_json_object(r["data"], "$.vendor_name"), F.lit("failed"))))), ",").alias("results"),
    )
    return batches.batch_status(headers, found).select(
        "batch_job_name", "state", "total_items", "completed_items", "failed_items"
    ).join(lists, "batch_job_name", "left")


@query
def stream_open_requests(spark, sf_dir):
    path = new_work_path(spark, "requests")
    checkpoint = new_work_path(spark, "requests-checkpoint")
    _in_two_runs(spark, sf_dir, lambda s: activity_stream.start_request_states(_request_events(s), path, checkpoint))
    return activity_stream.request_states(spark, path).select(
        "token", "request_id", "is_open",
        times.iso_timestamp(F.col("started_at")).alias("started_at"),
    )


@query
def stream_request_joins(spark, sf_dir):
    """Requests that have ended, or whose end can't come any more, from ten micro-batches."""
    path = new_work_path(spark, "joins")
    checkpoint = new_work_path(spark, "joins-checkpoint")
    _in_two_runs(
        spark, sf_dir, lambda s: activity_stream.start_request_joins(_request_events(s), path, checkpoint, "6 hours", "1 hour")
    )
    return spark.read.parquet(path).select(
        "token", "request_id", "operation", *[times.iso_timestamp(F.col(c)).alias(c) for c in ("started_at", "ended_at")]
    )


@query
def stream_error_history(spark, sf_dir):
    """The newest hundred errors, kept over ten micro-batches."""
    path = new_work_path(spark, "errors")
    checkpoint = new_work_path(spark, "errors-checkpoint")
    _in_two_runs(spark, sf_dir, lambda s: activity_stream.start_error_log(_error_history(s), path, checkpoint))
    return activity_stream.kept_errors(spark, path).select("seq", "source", "code", "http_status")


# --- model and whole job -----------------------------------------------------


@query
def model_replies(spark, sf_dir):
    """Caller's model hook with a stand-in model that echoes part of the text."""

    def factory():
        def call(prompt: str, document: str, country: str):
            if country == "usa" and len(document) % 5 == 0:
                raise TimeoutError
            record = {"vendor_name": document[:20], "net_amount": len(document)}
            return 200, json.dumps(
                {"message": {"content": json.dumps(record)}, "eval_count": len(document)}
            )

        return call

    documents = table(spark, sf_dir, "documents").selectExpr(
        "cast(doc_id as string) as doc_key",
        "case when doc_id % 2 = 0 then 'uae' else 'usa' end as country", "text",
    )
    # Prepared texts are a table between the jobs, read here per country.
    path = new_work_path(spark, "prepared")
    sinks.write_table(prepare.prepare_texts(documents).drop("text"), path, ("country",))
    usable, _ = sinks.split_errors(spark.read.parquet(path))
    parts = []
    for country in ("uae", "usa"):
        own = usable.filter(F.col("country") == country)
        replies = hooks.run_model(own, factory, {}, calls_in_flight=8)
        parts.append(
            parse.parse_replies(replies, country).select(
                "doc_key", "country", F.col("data.vendor_name").alias("vendor_name"),
                to_json_number(F.col("data.net_amount")).alias("net_amount"),
                "token_usage.output_tokens", "error.status",
            )
        )
    return _union(parts)


def _replied(spark, sf_dir) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    uploads = orders.selectExpr(*derived.EXTRACTION_UPLOADS).withColumn(
        "error", errors.no_error()
    )
    doc_pages = orders.selectExpr(*derived.EXTRACTION_PAGES)
    responses = orders.selectExpr(*derived.EXTRACTION_RESPONSES)
    prepared = extract.prepare(uploads, doc_pages)
    return extract.save_replied(prepared, responses, new_work_path(spark, "replied"))


@query
def invoice_extraction(spark, sf_dir):
    """Pages and model replies of all orders to checked invoices of three countries."""
    replied = _replied(spark, sf_dir)
    names = {
        "uae": ("invoice_no", "grand_total"),
        "usa": ("invoice_no", "payable_amount"),
        "india": ("invoice_number", "invoice_amount"),
    }
    parts = []
    for country, (number, total) in names.items():
        warnings = (
            F.array_join("validation.warnings", "; ")
            if country == "uae"
            else F.lit(None).cast("string")
        )
        parts.append(
            extract.invoices(replied, country).select(
                "doc_key",
                "country",
                "character_count",
                F.col("data.vendor_name").alias("vendor_name"),
                F.col(f"data.{number}").alias("invoice_no"),
                to_json_number(F.col(f"data.{total}")).alias("total"),
                F.size("data.items").alias("n_items"),
                F.col("token_usage.total_tokens").alias("total_tokens"),
                warnings.alias("warnings"),
                F.col("error.status").alias("status"),
            )
        )
    return _union(parts)


def _envelopes(spark, sf_dir) -> DataFrame:
    """Whole envelopes of all countries, nested parts as JSON text with their nulls."""
    def json_of(name: str):
        return F.to_json(name, {"ignoreNullFields": "false"}).alias(name)

    parts = []
    for country, rows in extract.all_envelopes(_replied(spark, sf_dir)).items():
        validation = json_of("validation") if country == "uae" else F.lit(None).cast("string").alias("validation")
        parts.append(
            rows.select(
                "doc_key",
                "success",
                "request_id",
                "character_stored",
                F.lit(country).alias("country"),
                json_of("data"),
                validation,
                F.to_json("metadata").alias("metadata"),
                F.to_json("token_usage").alias("token_usage"),
            )
        )
    return _union(parts)


@query
def success_envelopes(spark, sf_dir):
    """What callers receive for every invoice without an error."""
    return _envelopes(spark, sf_dir)


@query
def completion_envelopes(spark, sf_dir):
    """The same envelopes under the callers' invoice ids, and error rows for ids that are none."""
    callers = table(spark, sf_dir, "orders").selectExpr(
        "cast(o_orderkey as string) as doc_key", f"{derived.INVOICE_ID.replace('doc_id', 'o_orderkey')} as invoice_id"
    )
    completed = envelopes.completion_envelopes(callers, _envelopes(spark, sf_dir))
    rejected = envelopes.invalid_callers(callers).select("doc_key", F.col("error.code").alias("code"))
    return completed.withColumn("code", F.lit(None).cast("string")).unionByName(rejected, allowMissingColumns=True)


@query
def extraction_errors(spark, sf_dir):
    """Error rows of all stages of the same job."""
    return extract.all_errors(_replied(spark, sf_dir)).select(
        "seq", "request_id", "source", "code", "http_status", "retryable"
    )
