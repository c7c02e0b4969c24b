"""The registered queries' columns against libraries and brute force, over a whole small table."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from pulsegrid.llm import byte_bpe, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def word_ids(texts):
    t = Tokenizer.from_file(queries.WORD_TOKENIZER)
    t.encode_special_tokens = True
    return {i: np.array(t.encode(x, add_special_tokens=False).ids, dtype="<u4") for i, x in texts.items()}


def test_op2(spark, word_ids):
    start = 0
    got = {r["doc_id"]: r for r in queries.op2_token_store(spark, SF).collect()}
    for i in sorted(word_ids):
        x = np.append(word_ids[i], np.uint32(2)).astype("<u4")
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(x), zlib.crc32(x.tobytes()))
        start += len(x)


def test_op4(spark, word_ids):
    rows = queries.op4_packing(spark, SF).collect()
    want = Counter()
    for i, x in word_ids.items():
        x = np.append(x, np.uint32(1)).astype("<u4")
        want.update((i, k, a, len(x[a : a + 4096]), zlib.crc32(x[a : a + 4096].tobytes())) for k, a in enumerate(range(0, len(x), 4096)))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    total, ends = sum(len(x) + 1 for x in word_ids.values()), Counter()
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends[r["sequence_id"]]
        ends[r["sequence_id"]] += r["length"]
    assert max(ends.values()) <= 4096 and len(ends) <= -(-total // 4096) + 1


def test_op7(spark, texts):
    encoding = tiktoken.Encoding("x", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.load_ranks(queries.BYTE_RANKS), special_tokens={})
    got = {r["doc_id"]: r for r in queries.op7_byte_bpe(spark, SF).collect()}
    assert len(got) == len(texts)
    for i, t in texts.items():
        ids = np.array(encoding.encode_ordinary(t), dtype="<u4")
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())


@pytest.mark.parametrize(
    ("name", "columns"),
    [
        ("op1_quality", ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]),
        ("op3_pii", ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]),
        ("op5_exact_dedup", ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]),
        ("op6_near_dedup", ["doc_id", "n_shingles", "component_id", "kept"]),
        ("op8_secrets", ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]),
        ("op9_html_extract", ["page_id", "url", "text", "n_chars"]),
        ("op10_language_id", ["doc_id", "declared", "lang_id", "lang_posterior", "kept"]),
    ],
)
def test_columns_and_rows(spark, name, columns):
    out = queries.QUERIES[name](spark, SF)
    table = "pages" if name == "op9_html_extract" else "documents"
    assert set(columns) <= set(out.columns) and out.count() == spark.read.parquet(f"{SF}/{table}.parquet").count()


def test_spans_of_a_table(spark, texts):
    from test_native import PII, SECRETS, matches, pii_passes, secret_passes

    for name, patterns, passes in (("op3_pii", PII, pii_passes), ("op8_secrets", SECRETS, secret_passes)):
        for r in queries.QUERIES[name](spark, SF).collect():
            base = matches(texts[r["doc_id"]], patterns, passes)
            assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest(), r["doc_id"]
