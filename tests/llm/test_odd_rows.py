"""Null, empty, very long, repeated rows, empty tables and other columns, operator by operator."""

import zlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("rasterloom.llm")
from rasterloom.llm import decontaminate, importance, lattice, minhash, packing, queries, secrets, substrings, token_files, toxicity  # noqa: E402

STORY = " ".join(f"w{i}" for i in range(60))
OTHER = " ".join(f"x{i}" for i in range(60))
LONG = "many words of a very long text " * 150_000
SHAPE = "doc_id long, text string, kept string, n long, key double, c int"
ROWS = [(None, STORY), (None, None), (1, STORY), (2, STORY + " end"), (2, OTHER), (3, ""), (3, ""), (4, None), (5, STORY.upper()), (5, STORY.upper()), (6, OTHER), (7, LONG), (8, " \t\n ")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*x, "k", 1, 0.5, 3) for x in ROWS], SHAPE).repartition(3)


def told(df, *columns):
    return Counter(tuple(x[c] for c in columns) for x in df.collect())


def test_minhash(docs):
    got = told(minhash.near_duplicates(docs), "doc_id", "component_id", "kept")
    want = [(None, None, True)] * 2 + [(1, 1, True), (2, 1, False), (2, 2, True)] + [(3, 3, True)] * 2 + [(4, 4, True)] + [(5, 1, False)] * 2 + [(6, 2, False), (7, 7, True), (8, 8, True)]
    assert got == Counter(want)
    assert minhash.near_duplicates(docs.where("doc_id = 99")).collect() == []


def test_minhash_clean(docs):
    """One row of each group stays, a doc_id's other text is judged by itself."""
    more = docs.unionByName(docs.where("doc_id = 7"))
    got = minhash.clean(more)
    assert got.schema == docs.schema
    assert told(got, "doc_id", "text") == Counter([(None, STORY), (None, None), (1, STORY), (2, OTHER), (3, ""), (3, ""), (4, None), (7, LONG), (8, " \t\n ")])
    assert minhash.clean(docs.where("doc_id = 99")).collect() == []


def test_large_buckets_are_split(spark, monkeypatch):
    """Parts of a bucket meet each other: with parts of 8 rows nothing is lost."""
    monkeypatch.setattr(minhash, "SPLIT", 8)
    rng = np.random.default_rng(3)
    base = [f"b{i}" for i in range(100)]
    rows = []
    for i in range(80):  # all share most words, so buckets are large; pairs of neighbours alone are copies
        words = list(base)
        for j in rng.choice(100, 12, replace=False):
            words[j] = f"e{i // 2}_{j}"
        rows.append((i, " ".join(words) if i % 2 else rows[-1][1] + " tail" if rows else "none"))
    got = {x["doc_id"]: x["component_id"] for x in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 1, 80).collect()}
    sets = [set(t.split()) for _, t in rows]
    root = list(range(80))
    for i in range(80):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    assert got == dict(enumerate(root))


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    a, b = [1.0, 2.0, 3.0], [3.0, -1.0, 0.5]
    rows = [(1, a), (2, [x * 1e300 for x in a]), (2, None), (3, [x * 1e-300 for x in a]), (4, [0.0] * 3), (5, [nan, 1.0, 1.0]), (6, [inf, 1.0, 1.0]), (7, []), (8, [1.0, None, 2.0]), (9, b), (9, b), (None, a), (None, None), (10, [1.0, 2.0, 3.0, 0.0])]
    df = spark.createDataFrame([(*x, 1, 2) for x in rows], "vec_id long, embedding array<double>, same int, unit int")
    got = told(lattice.near_vectors(df), "vec_id", "n_links", "component_id", "kept")
    want = [(1, 2, 1, True), (2, 2, 1, False), (2, 0, 2, True), (3, 2, 1, False), (9, 1, 9, True), (9, 1, 9, True), (None, 0, None, True), (None, 0, None, True)]
    assert got == Counter(want + [(i, 0, i, True) for i in (4, 5, 6, 7, 8, 10)])
    assert lattice.near_vectors(df.where("vec_id = 99")).collect() == []


def plain_weights(rows, wanted, buckets):
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for d, t in rows:
        f = np.bincount(importance.features(t, buckets), minlength=buckets)
        raw += f
        target += f * (d in wanted)
    ratio = np.log((target + 1) / (target.sum() + buckets)) - np.log((raw + 1) / (raw.sum() + buckets))
    return [float(ratio[importance.features(t, buckets)].sum()) for _, t in rows]


def test_resampling(spark, docs):
    labels = spark.createDataFrame([(1, 1), (6, 0), (7, 0), (None, 1), (50, 1), (2, None)], "doc_id long, quality int")
    got = importance.resample(docs, labels, share=0.4)
    want = plain_weights(ROWS, {1}, importance.BUCKETS)
    assert told(got.selectExpr("doc_id", "round(log_weight, 6) + 0.0 as w"), "doc_id", "w") == Counter((d, round(w, 6) + 0.0) for (d, _), w in zip(ROWS, want, strict=True))
    keys = sorted((x["key"] for x in got.collect()), reverse=True)
    cut = keys[int(np.ceil(0.4 * len(ROWS))) - 1]
    assert all(x["kept"] == (x["key"] >= cut) for x in got.collect())
    assert all(x["log_weight"] == 0 for x in importance.resample(docs, labels.where("false")).collect())
    assert importance.resample(docs.where("doc_id = 99"), labels).collect() == []


def test_decontamination(spark, docs):
    items = spark.createDataFrame([(1, STORY), (1, STORY), (None, OTHER), (3, None), (4, "")], "item_id long, text string")
    got = told(decontaminate.contamination(docs, items), "doc_id", "n_words", "n_hit", "n_items")
    assert got == Counter([(None, 60, 60, 1), (None, 0, 0, 0), (1, 60, 60, 1), (2, 61, 60, 1), (2, 60, 60, 0), (3, 0, 0, 0), (3, 0, 0, 0), (4, 0, 0, 0), (5, 60, 60, 1), (5, 60, 60, 1), (6, 60, 60, 0), (7, 1_050_000, 0, 0), (8, 0, 0, 0)])
    for b in (items.where("false"), items.where("item_id > 2")):
        assert not decontaminate.contamination(docs, b).where("contaminated").count()
    kept = decontaminate.clean(docs.withColumnsRenamed({"kept": "row_a", "n": "row_key"}), items)
    assert kept.columns == ["doc_id", "text", "row_a", "row_key", "key", "c"]
    assert told(kept, "doc_id", "text") == Counter([(None, None), (3, ""), (3, ""), (4, None), (7, LONG), (8, " \t\n ")])
    assert decontaminate.contamination(docs.where("doc_id = 99"), items).collect() == []


def test_packing(spark):
    rows = [(None, "a null id", None), (1, None, "s"), (1, None, "s"), (2, "", None), (3, "word " * 20_000, "t"), (3, "other text", "t")]
    df = spark.createDataFrame([(*x, 0, 0, 0) for x in rows], "doc_id long, text string, source string, queue int, part int, n int")
    path = queries.tokenizer_path(queries.PACK_FILE)
    got = packing.pack(df, path).collect()
    assert Counter(x["doc_id"] for x in got if x["start"] == 0) == Counter(x[0] for x in rows)
    held = Counter()
    for x in got:
        held[x["sequence_id"]] += x["length"]
    assert all(n == 2048 for w, n in held.items() if w < len(held) - 1)
    assert sum(held.values()) == sum(x["doc_tokens"] for x in got if x["start"] == 0)
    assert packing.pack(df.where("doc_id = 99"), path).collect() == []


def test_packing_follows_unequal_weights(spark):
    """Asked-for shares hold in every window to within a token a source, until a source is used up."""
    rows = [(i, f"alpha beta gamma {i} " * 40, "abc"[i % 3]) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    want = {"a": 0.6, "b": 0.3, "c": 0.1}
    got = packing.pack(df, queries.tokenizer_path(queries.PACK_FILE), weights=want).collect()
    held: dict = {}
    for x in got:
        held.setdefault(x["sequence_id"], Counter())["abc"[x["doc_id"] % 3]] += x["length"]
    sizes = Counter()
    for x in got:
        sizes["abc"[x["doc_id"] % 3]] += x["length"]
    used = int(sizes["a"] / (0.6 * 2048)) - 1
    assert used > 10
    for w in range(used):
        assert all(abs(held[w][s] - 2048 * p) <= 2 for s, p in want.items()), (w, held[w])


def test_secrets(spark, docs):
    rows = [(None, "password=abcdef1"), (1, None), (2, ""), (3, "no secret " * 200_000 + "token: zyxwvu9"), (4, "password=abcdef1"), (4, "password=abcdef1"), (5, "=" * 50_000)]
    df = spark.createDataFrame([(*x, "s", 1) for x in rows], "doc_id long, text string, spans string, clean int")
    got = told(secrets.scan(df), "doc_id", "n_assign", "spans")
    at = len("no secret " * 200_000)
    assert got == Counter([(None, 1, "assign:0:16"), (1, 0, ""), (2, 0, ""), (3, 1, f"assign:{at}:{at + 14}"), (4, 1, "assign:0:16"), (4, 1, "assign:0:16"), (5, 0, "")])
    clean = secrets.redact(df)
    assert clean.schema == df.schema and told(clean.where("doc_id = 4 or doc_id is null"), "text") == Counter({("<SECRET>",): 3})
    assert secrets.scan(docs.where("doc_id = 99")).collect() == [] == secrets.redact(docs.where("doc_id = 99")).collect()


def test_substrings(spark):
    a = "".join(np.random.default_rng(2).choice(list("abcdef"), 300))
    rows = [(None, a), (1, a), (2, None), (3, ""), (4, "x" + a[:150]), (5, "z" * 100_000), (6, a[:99]), (4, "x" + a[:150]), (7, a[:140]), (7, a[:140])]
    df = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, cover int").repartition(3)
    got = told(substrings.without_repeats(df), "doc_id", "n_bytes", "n_removed", "n_spans")
    assert got == Counter([(None, 300, 0, 0), (1, 300, 300, 1), (2, 0, 0, 0), (3, 0, 0, 0), (4, 151, 150, 1), (5, 100_000, 99_999, 1), (6, 99, 0, 0), (4, 151, 150, 1), (7, 140, 140, 1), (7, 140, 140, 1)])
    assert substrings.without_repeats(df.where("doc_id = 99")).collect() == []


def test_substrings_of_shared_ids(spark):
    """Two texts of one doc_id are told apart; a row that repeats one takes its result."""
    a, b = ("".join(np.random.default_rng(i).choice(list("abcdef"), 250)) for i in (1, 2))
    df = spark.createDataFrame([(1, a), (1, b), (1, b), (2, b[:120]), (2, "short")], "doc_id long, text string")
    got = told(substrings.without_repeats(df), "doc_id", "n_bytes", "n_removed")
    assert got == Counter([(1, 250, 0), (1, 250, 0), (1, 250, 0), (2, 120, 120), (2, 5, 0)])


def test_token_files(spark):
    rows = [(None, "a null id"), (1, None), (2, ""), (3, "word " * 20_000), (3, "other"), (3, "other"), (-4, "below")]
    df = spark.createDataFrame([(*x, 0, 0) for x in rows], "doc_id long, text string, part int, file int").repartition(3)
    path = queries.tokenizer_path(queries.BINARY_FILE)
    got = sorted(token_files.round_trip(df, path).collect(), key=lambda x: x["start"])
    from tokenizers import Tokenizer

    whole, at = Tokenizer.from_file(path), 0
    for x, (d, t) in zip(got, sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")), strict=True):
        ids = whole.encode(t or "", add_special_tokens=False).ids + [2]
        assert (x["doc_id"], x["start"], x["n_tokens"], x["ids_crc32"]) == (d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert token_files.round_trip(df.where("doc_id = 99"), path).collect() == []


def test_select_is_the_read_path():
    """Reading bounds decodes no code as a whole."""
    ids = [np.arange(i % 7, dtype=np.uint16) for i in range(3000)]
    read = token_files.TokenFile(token_files.dump(list(range(3000)), ids, np.dtype("<u2")))
    read.ends.all = read.names.all = None
    assert all(read.ids(i).tolist() == ids[i].tolist() and read.doc_id(i) == i for i in range(3000))
    assert toxicity.features("muslim") and len(read.ends.directory) == 4 * 6
