"""The corpus pipeline and its stages against plain Python."""

import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("rasterloom.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")
from rasterloom.llm import common, minhash, queries, secrets, tokens, toxicity  # noqa: E402

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
NAMES = [name for name, _ in corpus_pipeline.STAGES]
STAGE = dict(corpus_pipeline.STAGES)


def lowered(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def without_toxic(rows, weights, bias):
    def score(text):
        seen = {f for w in set(re.findall(r"[^\W\d_]+", (text or "").lower())) for f in toxicity.features(w)}
        return bias + sum(weights.get(f, 0.0) for f in sorted(seen))

    return [r for r in rows if score(r[1]) < 0]


def without_copies(rows):
    sets = []
    for _, text, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    where = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            where[x].append(i)
    for i, s in enumerate(sets):
        common = Counter(j for x in s for j in where[x] if j < i)
        for j, n in common.items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n) and rows[i][0] is not None and rows[j][0] is not None:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    best = {}
    for i, r in enumerate(rows):
        if sets[i] and r[0] is not None:
            best[find(i)] = min(best.get(find(i), (r[0], i)), (r[0], i))
    return [r for i, r in enumerate(rows) if not sets[i] or r[0] is None or best[find(i)][1] == i]


def without_benchmark(rows, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t))
    grams = defaultdict(set)
    for t in items:
        w = words(t)
        for i in range(max(1, len(w) - 9) if w else 0):
            g = tuple(w[i : i + 10])
            grams[len(g)].add(g)
    clean = []
    for r in rows:
        w = words(r[1])
        if not any(tuple(w[i : i + n]) in g for n, g in grams.items() for i in range(len(w) - n + 1)):
            clean.append(r)
    return clean


def redacted(rows, find):
    out = []
    for r in rows:
        spans = find(r[1])[1] if r[1] else []
        text, done = "", 0
        for _, b, e in spans:
            if b >= done:
                text += r[1][done:b] + "<SECRET>"
            done = max(done, e)
        new = text + r[1][done:] if spans else r[1]
        out.append((r[0], new, *r[2:4], len(new) if spans else r[4]))
    return out


def check_packed(rows, pieces):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(queries.tokenizer_path(queries.PACK_FILE))
    ids = {d: [*whole.encode(t or "", add_special_tokens=False).ids, 1] for d, t, *_ in rows}
    assert len(ids) == len(rows)
    at, held = defaultdict(list), defaultdict(list)
    for x in pieces:
        part = ids[x["doc_id"]][x["start"] : x["start"] + x["length"]]
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == x["ids_crc32"]
        at[x["doc_id"]].append((x["start"], x["length"]))
        held[x["sequence_id"]].append((x["offset"], x["length"]))
    assert set(at) == set(ids)
    for spans, whole_length in [(at[d], len(x)) for d, x in ids.items()] + [(x, None) for x in held.values()]:
        end = 0
        for b, n in sorted(spans):
            assert b == end
            end += n
        assert whole_length is None and end <= 2048 or end == whole_length


def read(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


def test_run(spark):
    rows = duckdb.sql(f"select doc_id, text, lang, source, n_chars from '{SF}/documents.parquet' order by 1").fetchall()
    weights, bias = toxicity.fit(read(spark, rows), spark.read.parquet(f"{SF}/labels.parquet"))
    left = without_toxic(rows, weights, bias)
    assert len(left) < len(rows)
    left = without_copies(left)
    left = without_benchmark(left, [t for (t,) in duckdb.sql(f"select text from '{SF}/benchmark.parquet'").fetchall()])
    left = redacted(left, secrets._Finder(*(lambda f: (f[0], 1e-3, f[1]))(secrets._fitted(read(spark, left), 0.01, 1e-3))))
    assert any("<SECRET>" in (r[1] or "") for r in left)
    check_packed(left, corpus_pipeline.run(spark, SF).collect())


STORY = " ".join(f"w{i}" for i in range(60))
OTHER = " ".join(f"x{i}" for i in range(60))


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """documents with null and shared ids, repeated rows, empty and very long texts, and columns with the stages' own names."""
    item = duckdb.sql(f"select text from '{SF}/benchmark.parquet' where length(text) > 100 limit 1").fetchall()[0][0]
    texts = [(None, STORY), (None, "my password=hunter22 a"), (None, None), (1, STORY), (1, STORY), (2, STORY + " end"), (2, OTHER), (3, ""), (3, ""), (4, None), (5, f"before {item} after"), (6, "alpha token: abcdef123 one"), (6, "beta token: zyxwvu987 two"), (7, "a very long text of few words " * 60_000), (8, " \t ")]
    rows = [(d, t, "en", f"s{i % 3}" if i % 4 else None, None if t is None else len(t), *"abcdefgh") for i, (d, t) in enumerate(texts)]
    names = ["_text", "_row", "clean", "spans", "score", "row_a", "text_hash", "keep"]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{x} string" for x in names)), rows


def same(df, rows, schema):
    assert df.schema == schema
    assert Counter(map(tuple, df.collect())) == Counter(rows)


def test_stages_of_odd_rows(spark, odd):
    df, rows = odd
    weights, bias = toxicity.fit(df, spark.read.parquet(f"{SF}/labels.parquet"))
    same(STAGE[NAMES[0]](spark, df, SF), without_toxic(rows, weights, bias), df.schema)
    same(STAGE[NAMES[1]](spark, df, SF).drop("source"), [(*r[:3], *r[4:]) for r in without_copies(rows)], df.drop("source").schema)
    items = [t for (t,) in duckdb.sql(f"select text from '{SF}/benchmark.parquet'").fetchall()]
    left = without_benchmark(rows, items)
    assert len(left) < len(rows)
    same(STAGE[NAMES[2]](spark, df, SF), left, df.schema)
    find = secrets._Finder(*(lambda f: (f[0], 1e-3, f[1]))(secrets._fitted(df, 0.01, 1e-3)))
    want = [(*r, *x[5:]) for r, x in zip(redacted([r[:5] for r in rows], find), rows, strict=True)]
    assert {r[1] for r in want} >= {"alpha <SECRET> one", "beta <SECRET> two", "my <SECRET> a"}
    same(STAGE[NAMES[3]](spark, df, SF), want, df.schema)
    single = [(i, *r[1:]) for i, r in enumerate(rows)]
    check_packed(single, STAGE[NAMES[4]](spark, spark.createDataFrame(single, df.schema), SF).collect())


@pytest.mark.parametrize("name", NAMES)
def test_stages_of_an_empty_table(spark, odd, name):
    df = odd[0].where("false")
    got = STAGE[name](spark, df, SF)
    assert got.collect() == [] and (name == NAMES[-1] or got.schema == df.schema)


def test_a_worker_keeps_the_tables_of_one_stage(monkeypatch):
    """Workers go from stage to stage; what the encoder or the shingles keep would add up in an executor's memory."""
    monkeypatch.setattr(common, "_HELD", {})
    docs = pa.RecordBatch.from_pylist([{"doc_id": 1, "text": "a few words of text", "t": 1}])
    texts = [x.as_py() for x in docs["text"]]
    kept = tokens.encoder(queries.tokenizer_path(queries.PACK_FILE))
    kept.encode(texts)
    assert tokens.encoder(queries.tokenizer_path(queries.PACK_FILE)) is kept and kept.stems
    list(minhash._scan(3, 2, 6)([docs]))
    assert not tokens._ENCODERS and minhash._HASHES
    list(minhash._scan(3, 2, 6)([docs]))
    assert minhash._HASHES
    list(toxicity._score({}, 0.0)([docs]))
    assert not minhash._HASHES
