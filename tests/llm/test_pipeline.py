"""The whole pipeline against plain versions of its stages."""

import re

import duckdb
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from ledgerloom.llm import secret_scan
from ledgerloom.llm.oracles import ORACLES
from tests.llm.test_decontamination import plain_contaminated
from tests.llm.test_near_copies import plain_kept


def test_pipeline_from_documents_to_sequences(spark, sf, docs_of):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    good = {r[0] for r in con.execute(f"SELECT doc_id FROM ({ORACLES['op7_host_rules']}) WHERE kept").fetchall()}
    texts = {i: t for i, t in con.execute("SELECT doc_id, text FROM documents").fetchall() if i in good}
    first = plain_kept(sorted(texts.items()))
    items = con.execute(f"SELECT item_id, text FROM '{sf}/benchmark.parquet'").fetchall()
    leaked = {d for d, *_ in plain_contaminated([(i, texts[i]) for i in first], items)}
    left = {i: texts[i] for i in first if i not in leaked}
    found = secret_scan.findings(docs_of(list(left.items())), secret_scan.train(spark)).where("is_secret").collect()
    for r in sorted(found, key=lambda r: -r.start):
        left[r.doc_id] = left[r.doc_id][: r.start] + "[SECRET]" + left[r.doc_id][r.start + r.length :]

    rows = corpus_pipeline.run(spark, sf).collect()
    encode = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json"))).encode
    want = {i: len(encode(t, add_special_tokens=False).ids) + 1 for i, t in left.items()}
    assert {r.doc_id: r.doc_tokens for r in rows} == want and leaked and len(first) < len(texts) < 200
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for doc, own in pieces.items():
        ends = [s + n for s, n in sorted(own)]
        assert [s for s, _ in sorted(own)] == [0, *ends[:-1]] and ends[-1] == want[doc]
    for own in sequences.values():
        ends = [s + n for s, n in sorted(own)]
        assert [s for s, _ in sorted(own)] == [0, *ends[:-1]] and ends[-1] <= 4096


def test_stages_are_in_order():
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "near_dedup", "decontamination", "secret_scan", "packing"]
    assert all(re.fullmatch(r"\w+", n) for n in names)
