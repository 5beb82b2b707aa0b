import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from ledgerloom.llm import decontamination
from ledgerloom.llm.decontamination import UNITS

PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())


def plain_windows(text, size=5):
    """``(position, template words, slot values)`` of each window with two plain words."""
    data = (text or "").encode()
    words, last, was_number = [], 0, False
    for found in re.finditer(rb"[^\x20\x09-\x0d]+", data):
        kept = [k for k in range(found.start(), found.end()) if data[k] not in PUNCTUATION]
        if not kept:
            continue
        word = bytes(data[k] for k in kept).lower()
        raw = data[kept[0] : kept[-1] + 1]
        number = raw[:1].isdigit()
        unit = was_number and not number and word.decode() in UNITS
        opening = not words or re.search(rb"[\n.!?:;]", data[last : kept[0]])
        follow = data[kept[0] + 1] if kept[0] + 1 < len(data) else 0
        capital = len(raw) > 1 and (
            (65 <= raw[0] <= 90 and (97 <= follow <= 122 or follow >= 128))
            or (raw[0] == 0xC3 and 0x80 <= follow <= 0x9E and follow != 0x97)
        )
        kind = "number" if number else "unit" if unit else "name" if capital and not opening else None
        words.append((kind or word, word if kind else None))
        last, was_number = kept[-1] + 1, number
    runs = [(k, words[k : k + size]) for k in range(len(words) - size + 1)]
    return [
        (k, tuple(t for t, _ in run), tuple(v for _, v in run)) for k, run in runs if sum(v is None for _, v in run) >= 2
    ]


def agrees(values, consistency):
    """Whether the left values of the pairs keep to one right value each."""
    most = defaultdict(int)
    for (a, _), n in values.items():
        most[a] = max(most[a], n)
    return sum(most.values()) >= consistency * sum(values.values())


def plain_contaminated(docs, items, share=0.8, consistency=0.8, run=13, size=5):
    by_template, sizes = defaultdict(list), {}
    for item, text in items:
        found = plain_windows(text)
        sizes[item] = len({w for _, w, _ in found})
        for at, w, slots in found:
            by_template[w].append((item, at, slots))
    met = defaultdict(list)
    for doc, text in docs:
        for at, w, slots in plain_windows(text):
            for item, item_at, item_slots in by_template.get(w, ()):
                met[doc, item, at - item_at].append((w, item_slots, slots, item_at))
    matched, longest = defaultdict(set), defaultdict(int)
    for (doc, item, _), rows in met.items():
        values = Counter((a, b) for _, x, y, _ in rows for a, b in zip(x, y) if a is not None)
        turned = Counter({(b, a): n for (a, b), n in values.items()})
        if agrees(values, consistency) and agrees(turned, consistency):
            matched[doc, item] |= {w for w, *_ in rows}
            places = {p for *_, p in rows}
            for first in places:
                last = first
                while last + 1 in places:
                    last += 1
                longest[doc, item] = max(longest[doc, item], last - first + size)
    return {
        (d, i, len(w), sizes[i]) for (d, i), w in matched.items() if len(w) >= share * sizes[i] or longest[d, i] >= run
    }


def rows_of(df):
    return sorted((r.doc_id, r.item_id, r.matched, r.item_windows) for r in df.collect())


def test_whole_table_against_plain_search(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    want = plain_contaminated(
        [(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()]
    )
    got = rows_of(decontamination.contaminated(docs, items))
    assert got == sorted(want) and got
    # Without a broadcast the rows are the same.
    assert rows_of(decontamination.contaminated(docs, items, broadcast_rows=0)) == got
    left = {r.doc_id for r in decontamination.clean(docs, items).collect()}
    assert left == {r.doc_id for r in docs.select("doc_id").collect()} - {d for d, *_ in got}


ITEM = "A train leaves the old station of Lemburg at 7 in the morning and drives 240 km to Varnow, where Olrika waits. How long does the train of Olrika need?"
TURNED = ITEM.replace("Lemburg", "Tessin").replace("Varnow", "Golm").replace("Olrika", "Birte").replace("240 km", "90 miles").replace("7", "11")
AROUND = "many other words stand before and after this passage in the text. "


def test_reparameterised_items(spark, docs_of):
    texts = [ITEM, AROUND * 3 + TURNED + " " + AROUND, AROUND * 9, None, "", (None, ITEM), ITEM, AROUND * 5000 + ITEM]
    docs = docs_of(texts).withColumn("item_id", F.lit("clash")).withColumn("w", F.lit(1))
    items = spark.createDataFrame([(1, ITEM), (2, "too short"), (3, None), (4, ""), (None, ITEM)], "item_id long, text string")
    got = {r.doc_id: r for r in decontamination.contaminated(docs, items).collect()}
    assert set(got) == {0, 1, 6, 7} and {r.item_id for r in got.values()} == {1}
    assert got[1].reparameterised and not got[0].reparameterised and got[0].coverage == 1
    left = decontamination.clean(docs, items)
    assert left.columns == docs.columns
    # The row without an id goes, too.
    assert sorted(r.doc_id for r in left.collect()) == [2, 3, 4]


def test_slots_must_agree(spark, docs_of):
    item = "the red box holds 3 and the blue box holds 3 and the last box holds 3 and so on"
    same = item.replace("3", "8")
    torn = "the red box holds 1 and the blue box holds 2 and the last box holds 5 and so on"
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert [r.doc_id for r in decontamination.contaminated(docs_of([same, torn]), items).collect()] == [0]


def test_slots_must_agree_in_both_directions(spark, docs_of):
    item = "the red box of Anton holds 3 and the blue box of Berta holds 4 and the last box of Carla holds 5 and so on"
    flat = "the red box of Dora holds 7 and the blue box of Dora holds 7 and the last box of Dora holds 7 and so on"
    turned = "the red box of Dora holds 7 and the blue box of Emil holds 8 and the last box of Franz holds 9 and so on"
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    found = decontamination.contaminated(docs_of([item, flat, turned]), items).collect()
    assert {r.doc_id for r in found} == {0, 2} and all(r.coverage == 1 for r in found)


def test_an_unbroken_part_of_an_item_counts(spark, docs_of):
    words = ITEM.split()
    texts = [" ".join(words[:17]), "so they said: " + " ".join(words[:13]) + " but no more", " ".join(words[:12]), " ".join(words[5:9] * 9)]
    rows = [*enumerate(texts), (1, AROUND), (None, " ".join(words[3:18])), (None, AROUND), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("Clean_Key", F.lit(1))
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    found = {r.doc_id: r.run_words for r in decontamination.contaminated(docs, items).collect()}
    assert found == {0: 17, 1: 13}
    left = decontamination.clean(docs, items)
    assert left.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted(
        [(2, texts[2]), (3, texts[3]), (None, AROUND), (None, None)], key=str)


def test_empty_tables(spark, docs_of):
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert decontamination.contaminated(docs_of([]), items).count() == 0
    assert decontamination.contaminated(docs_of([ITEM]), items.where("false")).count() == 0
    assert decontamination.clean(docs_of([ITEM]), items.where("false")).count() == 1
