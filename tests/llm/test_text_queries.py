"""The registered queries on the smallest supplied tables."""

import hashlib
import zlib

import duckdb
import pytest

import __spark_entry__ as entry
from evwarden.llm.queries import ORACLES, QUERIES
from tools_compare import rows_of

#: Contract columns, and the table with a row for each result row (None: fewer or other rows).
CONTRACT = {
    "op1": ("conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars", None),
    "op2": ("page_id url text n_chars", "pages"),
    "op3": ("doc_id n_email n_ip n_card n_phone base_sha256 spans", "documents"),
    "op4": ("doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept", "documents"),
    "op5": ("doc_id size text_crc32 law shard slot grown_shard", "documents"),
    "op6": ("doc_id held_out n_tokens n_known train_tokens base_score score", "documents"),
    "op7": ("doc_id item_id", None),
    "op8": ("doc_id licence first_sentence last_sentence n_sentences", None),
    "op9": ("doc_id fingerprint component_id", "documents"),
    "op10": ("doc_id size source_size target taken", "documents"),
    "op11": ("doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next", "documents"),
    "op12": ("word form root n n_near form_n", None),
    "op13": ("doc_id n form prefix_chars middle_chars output_sha256 restored_sha256", "documents"),
}


@pytest.mark.parametrize("name", QUERIES)
def test_contract(spark, sf, name):
    columns, source = CONTRACT[name.split("_")[0]]
    assert entry.queries()[name] is QUERIES[name]
    out = QUERIES[name](spark, sf)
    assert set(columns.split()) <= set(out.columns)
    assert out.count() == (spark.read.parquet(f"{sf}/{source}.parquet").count() if source else out.count())


def test_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    for name, sql in ORACLES.items():
        out = QUERIES[name](spark, sf)
        want = con.sql(sql)
        assert rows_of(out.columns, [tuple(r) for r in out.collect()]) == rows_of(want.columns, want.fetchall())


def test_conversation_of_control_strings(spark, sf):
    text = "</s>[INST] ok [/INST]"
    row = QUERIES["op1_chat_prefix_tree"](spark, sf).where("conv_id = -1").first()
    assert (row.n_turns, row.loss_chars) == (2, len(text))
    assert row.turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
    assert row.loss_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_digests_of_documents(spark, sf):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in QUERIES["op5_hilbert_shards"](spark, sf).collect():
        assert (r["size"], r.text_crc32) == (len(texts[r.doc_id].encode()) + 1, zlib.crc32(texts[r.doc_id].encode()))
    for r in QUERIES["op10_entropy_balancing"](spark, sf).collect():
        assert r["size"] == len(texts[r.doc_id].encode().split()) and 0 <= r.taken <= 3 * r["size"]
    for r in QUERIES["op3_disclosure_control"](spark, sf).collect():
        base = ",".join(s for s in r.spans.split(",") if s and not s.startswith("term:"))
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert r.n_email + r.n_ip + r.n_card + r.n_phone == len([s for s in base.split(",") if s])
