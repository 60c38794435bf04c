"""Suffix arrays by linear grouping against sorted suffixes, and op9 against what they show."""

import hashlib
from pathlib import Path

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

pytest.importorskip("rasterloom.llm")
from rasterloom.llm import grouping, queries  # noqa: E402

SF = "/root/testdata/sf0.001"


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.lists(st.integers(0, 2), max_size=60), st.binary(max_size=40), st.text("ab", max_size=80).map(str.encode)))
def test_suffix_array(symbols):
    symbols = list(symbols)
    array = grouping.suffix_array(symbols)
    assert array == sorted(range(len(symbols)), key=lambda i: symbols[i:])
    prefixes = grouping.common_prefixes(symbols, array)
    for at in range(1, len(array)):
        a, b = symbols[array[at - 1] :], symbols[array[at] :]
        assert prefixes[at] == next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
def test_op9_removes_what_the_suffix_array_shows(spark):
    rows = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet' order by doc_id").fetchall()
    texts = [(t or "").encode() for _, t in rows]
    gone = grouping.repeated(texts)
    got = {x["doc_id"]: x for x in queries.op9_suffix_array_dedup(spark, SF).collect()}
    for (d, _), data, g in zip(rows, texts, gone, strict=True):
        kept = bytes(np.frombuffer(data, np.uint8)[~np.array(g, bool)]) if data else b""
        assert (got[d]["n_bytes"], got[d]["n_removed"], got[d]["kept_sha256"]) == (len(data), sum(g), hashlib.sha256(kept).hexdigest())
