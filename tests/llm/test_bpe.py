import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gondola.llm import bpe, queries

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(queries.tokenizer_path())


@pytest.fixture(scope="module")
def own():
    return bpe.Bpe(queries.tokenizer_path())


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    raw = np.array(ids, "<u4").tobytes()
    return len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def same(library, docs, out):
    return sorted((str(r["doc_id"]), expected(library, r["text"])) for r in docs) == sorted((str(r["doc_id"]), (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"])) for r in out)


def test_query(spark, sf_dir, rows_of, library):
    assert same(library, rows_of(queries.table(spark, sf_dir, "documents")), rows_of(queries.op5_bpe_round_trip(spark, sf_dir)))


NASTY = ["", " ", "　a b\x1cc\x85d", "ΣΑΣ ὈΔΥΣΣΕΎΣ", "İstanbul ŒŠ ǅ", "é é", "don't I'LL we've'd", "<|endoftext|>x<|startoftext|>", "<|ENDOFTEXT|>", "a" * 5000, "ééé" * 700, "🤷🏽‍♀️ 123456 $$$!!!", "​zero‍width﻿", "中文字符测试", "ﬁ ẞ ß", "\x00\x01\x7f", "İ" * 30, "aͅΣ", "x y z"]


@pytest.mark.parametrize("text", NASTY)
def test_nasty_texts(library, own, text):
    ids = library.encode(text, add_special_tokens=False).ids
    raw = own.encode(text)
    assert np.frombuffer(raw, "<u4").tolist() == ids
    assert own.decode(raw) == library.decode(ids, skip_special_tokens=False).encode()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(library, own, text):
    raw = own.encode(text)
    ids = library.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(raw, "<u4").tolist() == ids
    assert own.decode(raw) == library.decode(ids, skip_special_tokens=False).encode()


def test_odd_rows(odd, none, rows_of, library):
    out = rows_of(bpe.encode_documents(odd.withColumnRenamed("n_chars", "ids"), queries.tokenizer_path()))
    assert same(library, rows_of(odd), out)
    assert all(len(r["ids"]) == r["n_tokens"] for r in out)
    assert rows_of(bpe.encode_documents(none, queries.tokenizer_path())) == []
