"""What shows only on larger tables: large keys, many files, long batches."""

import os

import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
from ledgerloom.functions.money import clean_money, to_json_number
from ledgerloom.operators import items
from ledgerloom.plans import queries
from ledgerloom.sources import files, hooks, sinks
from tests.test_queries import SF_DIR, ordered


def both_ways(spark, folder, table, name, where):
    """Rows of the query and of its SQL, over ``folder`` with that one table."""
    frame = entry_point.queries()[name](spark, str(folder)).where(where)
    duck = duckdb.connect()
    duck.execute(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    cursor = duck.execute(f"select * from ({entry_point.oracle_sql()[name]}) where {where}")
    columns = [c[0] for c in cursor.description]
    return ordered(frame.columns, [tuple(r) for r in frame.collect()]), ordered(columns, cursor.fetchall())


def test_strict_amounts_of_large_users_match_the_sql(spark, tmp_path):
    events = spark.read.parquet(f"{SF_DIR}/events.parquet").limit(300)
    events.withColumn("user_id", F.col("event_id") * 4999).write.parquet(str(tmp_path / "events.parquet"))
    found, wanted = both_ways(spark, tmp_path, "events", "schema_strict", "event_id % 13 = 0")
    assert found == wanted and len(found) > 20


def test_commas_are_dropped_wherever_they_stand(spark):
    frame = spark.createDataFrame([("AED 1,1000.50",), ("AED 2,000.50",)], "text string")
    assert [r[0] for r in frame.select(to_json_number(clean_money(F.col("text")))).collect()] == [11000.5, 2000.5]


def test_files_of_many_rows_need_no_folder_each(spark, tmp_path):
    rows = spark.range(0, 200, 1, 4).selectExpr("id as doc_id", "encode('text ' || id, 'utf-8') as content")
    odd = spark.createDataFrame([(7, bytearray(b"again")), (None, None), (-1, bytearray(b"\xff\x00"))], "doc_id long, content binary")
    folder = str(tmp_path / "files")
    sinks.write_files(rows.unionByName(odd.coalesce(1)), folder, "doc_id", "content")
    assert len([d for d, _, found in os.walk(folder) if found]) <= 5
    # What a task has left that died, or that came second, is not read.
    (tmp_path / "files" / "_part-00000-9").mkdir()
    (tmp_path / "files" / "_part-00000-9" / "00000000-doc_id=5").write_bytes(b"half")
    late = rows.where("doc_id < 50").coalesce(1).select(F.col("doc_id").cast("string"), "content")
    assert late.mapInArrow(sinks._saving(folder, "doc_id"), "made long").first().made == 50
    found = files.read_uploads(spark, folder).select(F.regexp_extract("path", "doc_id=(.*)$", 1).alias("k"), "content")
    got = sorted((r.k, bytes(r.content)) for r in found.collect())
    more = [("7", b"again\n"), ("null", b"\n"), ("-1", b"\xff\x00\n")]
    assert got == sorted([(str(k), b"text %d\n" % k) for k in range(200)] + more)
    assert not [n for n in os.listdir(folder) if n.startswith("_part") and n != "_part-00000-9"]


def test_small_files_share_a_task(spark, tmp_path):
    rows = spark.range(0, 400, 1, 4).selectExpr("id as doc_id", "'text' as content")
    sinks.write_files(rows, str(tmp_path / "files"), "doc_id", "content")
    assert files.read_uploads(spark, str(tmp_path / "files")).rdd.getNumPartitions() <= 12


def test_hooks_hand_results_on_in_small_parts(spark):
    def factory():
        import resource

        peak = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024
        start = peak()
        return lambda content, kind: [*content.decode().split("|"), str(peak() - start)]

    texts = spark.range(0, 1500, 1, 1).selectExpr("cast(id as string) as doc_key", "'pdf' as kind",
                                                  "encode(repeat('x', 50000) || '|' || repeat('y', 50000), 'utf-8') as content")
    found = hooks.run_text_extractor(texts, factory)
    whole = found.selectExpr("count(distinct doc_key) as docs", "count(*) as pages", "sum(length(text)) as chars",
                             "max(if(page_no = 3, cast(text as int), 0)) as grown").first()
    assert (whole.docs, whole.pages) == (1500, 4500) and whole.chars >= 1500 * 100_000
    # Megabytes that the task's worker has grown by, for 150 MB of texts.
    assert whole.grown < 80, whole.grown


def test_model_replies_are_whole_over_several_parts(spark):
    texts = spark.range(0, 2500, 1, 1).selectExpr("cast(id as string) as doc_key", "'uae' as country", "'t' || id as character_stored")
    for threads in (1, 3):
        replies = hooks.run_model(texts, lambda: lambda prompt, text, country: (200, text), {}, calls_per_task=threads)
        rows = replies.selectExpr("count(*) as n", "count_if(body = 't' || doc_key) as same", "count(distinct seq) as seqs").first()
        assert tuple(rows) == (2500, 2500, 2500)


def test_payload_files_of_a_stream_grow_in_number_not_in_size(spark, tmp_path, monkeypatch):
    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    documents.repartition(6).write.parquet(str(tmp_path / "documents.parquet"))
    made = {}

    def path_of(spark, purpose):
        made[purpose] = str(tmp_path / purpose)
        return made[purpose]

    monkeypatch.setattr(queries, "new_work_path", path_of)
    found, wanted = both_ways(spark, tmp_path, "documents", "stream_batch_results", "true")
    assert found == wanted and found
    sizes = [os.path.getsize(f"{made['payloads']}/{n}") for n in os.listdir(made["payloads"]) if n.endswith(".json")]
    assert len(sizes) >= 18 and max(sizes) < sum(sizes) / 6
    # Three micro-batches in each of the two runs.
    assert len([n for n in os.listdir(f"{made['results-checkpoint']}/commits") if n.isdigit()]) == 6


def test_gathering_lists_takes_more_tasks_for_more_rows(spark, tmp_path):
    few = {"spark.sql.shuffle.partitions": "2", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32k",
           "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k"}
    before = {k: spark.conf.get(k) for k in few}
    rows = spark.range(0, 60_000, 1, 4).selectExpr("id % 20000 as key", "cast(id as int) as position", "md5(cast(id as string)) as text")
    try:
        for name, value in few.items():
            spark.conf.set(name, value)
        items.nest(rows, "key", "rows", max_items=10).write.parquet(str(tmp_path / "lists"))
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert len([n for n in os.listdir(tmp_path / "lists") if n.endswith(".parquet")]) > 8
    lists = spark.read.parquet(str(tmp_path / "lists"))
    assert lists.selectExpr("count(*)", "min(n_items)", "max(n_items)").first()[:] == (20_000, 3, 3)
