"""Each operator's query against a plain version that looks at everything."""

import cProfile
import hashlib
import math
import pstats
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("rasterloom.llm")
from rasterloom.llm import decontaminate, lattice, minhash, packing, pages, queries, secrets, substrings, token_files, toxicity  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def documents():
    return sorted(duckdb.sql(f"select doc_id, text, source from '{SF}/documents.parquet'").fetchall())


def groups(ids, links):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def by_id(df, key="doc_id"):
    return {x[key]: x.asDict() for x in df.collect()}


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def test_minhash(spark, documents):
    sets = {d: shingles(t, 3) for d, t, _ in documents}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = groups(sets, links)
    got = by_id(queries.op1_minhash_near_dedup(spark, SF))
    assert {d: x["component_id"] for d, x in got.items()} == want
    assert {d: x["n_shingles"] for d, x in got.items()} == {d: len(s) for d, s in sets.items()}
    assert all(x["kept"] == (d == want[d]) for d, x in got.items())


def test_minhash_chain_and_far_members(spark):
    base = [f"w{i}" for i in range(120)]
    rows = [(0, " ".join(base))]
    for i in range(1, 40):  # ever more edits: neighbours link, the ends do not
        base[(i * 3) % 120] = f"e{i}"
        rows.append((i, " ".join(base)))
    sets = {d: shingles(t, 3) for d, t in rows}
    want = groups(sets, [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])])
    got = by_id(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85, 2, 6))
    assert {d: x["component_id"] for d, x in got.items()} == want


def test_vectors(spark):
    got = by_id(queries.op2_embedding_near_dedup(spark, SF), "vec_id")
    rows = duckdb.sql(f"select vec_id, embedding from '{SF}/embeddings.parquet' order by 1").fetchall()
    x = np.array([v for _, v in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = np.argwhere(np.triu(x @ x.T >= 0.95, 1))
    want = groups([i for i, _ in rows], [(rows[a][0], rows[b][0]) for a, b in near])
    assert {i: y["component_id"] for i, y in got.items()} == want
    count = Counter(np.concatenate([near[:, 0], near[:, 1]]).tolist())
    assert all(got[i]["n_links"] == count[k] for k, (i, _) in enumerate(rows))


def test_lattice_recall_at_the_threshold(spark):
    rng = np.random.default_rng(1)
    a = rng.standard_normal((600, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal((600, 64))
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    c = 0.9501 * a + math.sqrt(1 - 0.9501**2) * b
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([a, c]))]
    got = by_id(lattice.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")), "vec_id")
    assert sum(got[i + 600]["component_id"] == i for i in range(600)) >= 590


def test_lattice_decoding_is_nearest():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((200, 8)) * 2
    p = lattice.decode(x)
    d = ((x - p) ** 2).sum(1)
    for root in lattice.ROOTS:
        assert (d <= ((x - p - root) ** 2).sum(1) + 1e-9).all()
    assert len(lattice.ROOTS) == 240


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def hits(documents, items):
    out = {}
    for d, text in documents:
        w = plain_words(text)
        hit, found = set(), set()
        for item, t in items:
            v = plain_words(t)
            n = min(10, len(v))
            for g in {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if v else ():
                for i in range(len(w) - n + 1):
                    if tuple(w[i : i + n]) == g:
                        hit |= set(range(i, i + n))
                        found.add(str(item))
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


@pytest.mark.parametrize("broadcast", [decontaminate.BROADCAST, 0])
def test_decontamination(spark, broadcast):
    items = [(1, "One two three four five six seven eight nine ten eleven"), (2, "short item"), (3, None), (4, "!!"), (10, "Éa b c")]
    text = "x ONE two, three four five six seven eight nine ten eleven short-ITEM. one two"
    docs = [(0, text), (1, text * 2), (2, None), (3, ""), (4, "éa b c short"), (5, "Éa B c short item"), (6, "short item " * 50), (None, "short item")]
    got = by_id(decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), broadcast=broadcast))
    want = hits(docs, items)
    assert {d: tuple(x.values())[1:] for d, x in got.items()} == want


def test_decontamination_table(spark, documents):
    items = duckdb.sql(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall()
    some = [(d, t) for d, t, _ in documents if len(t or "") < 3000][:80]
    got = by_id(queries.op4_decontamination(spark, SF))
    want = hits(some, items)
    assert {d: tuple(got[d].values())[1:] for d, _ in some} == want


def encoder_of(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path(name))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


ODD = [None, "", " ", "  a  b ", "a\n  b", "\n\nx \t y  ", "it's they'll I'M", "naïve café ÀÉ 12 345", "日本語 テキスト 😀 é", "<|endoftext|> a", "b<|startoftext|>c <|endoftext|>", "İI ß ﬁ Σς", "a" * 5000, "x\x1cy\x85z w", " lead", "tail ", "́ mark"]


@pytest.mark.parametrize("name", [queries.PACK_FILE, queries.BINARY_FILE])
def test_ids_are_the_librarys(documents, name):
    from rasterloom.llm.tokens import Encoder

    texts = ODD + [t for _, t, _ in documents]
    whole = encoder_of(name)
    assert [x.tolist() for x in Encoder(queries.tokenizer_path(name)).encode(texts)] == [whole(t) for t in texts]


@pytest.mark.parametrize("apart", [True, False])
def test_new_words_reach_the_model_many_at_once(apart):
    """Python's calls are counted, as its time for each new word is what packing's check ran over by."""
    from rasterloom.llm.tokens import Encoder

    parts = ["an", "the", "ti", "on", "é", "ou", "Wh", "sh", "ñ", "re", "ŝ", "ge", "ü", "À"]
    words = ["".join(parts[i // len(parts) ** k % len(parts)] for k in range(4)) for i in range(0, 38_000, 7)]
    texts = [" ".join(words[i : i + 500]) for i in range(0, len(words), 500)]
    enc, whole = Encoder(queries.tokenizer_path(queries.PACK_FILE)), encoder_of(queries.PACK_FILE)
    assert enc.apart
    if not apart:
        enc.apart = ""
    with cProfile.Profile() as calls:
        got = enc.encode(texts)
    assert [x.tolist() for x in got] == [x.tolist() for x in enc.encode(texts)] == [whole(t) for t in texts]
    if apart:
        assert pstats.Stats(calls).total_calls < len(set(words))


def test_packing(spark, documents):
    encode = encoder_of(queries.PACK_FILE)
    ids = {d: encode(t) + [1] for d, t, _ in documents}
    rows = [x.asDict() for x in queries.op5_packing(spark, SF).collect()]
    seen, windows = defaultdict(list), defaultdict(list)
    for x in rows:
        seen[x["doc_id"]].append((x["start"], x["length"]))
        windows[x["sequence_id"]].append((x["offset"], x["length"], x["doc_id"]))
        piece = ids[x["doc_id"]][x["start"] : x["start"] + x["length"]]
        assert zlib.crc32(np.array(piece, "<u4").tobytes()) == x["ids_crc32"] and len(ids[x["doc_id"]]) == x["doc_tokens"]
    for d, pieces in seen.items():
        assert sum(n for _, n in pieces) == len(ids[d])
        assert sorted(a + n for a, n in pieces)[:-1] == sorted(a for a, _ in pieces)[1:]
    assert set(seen) == set(ids) and sorted(windows) == list(range(len(windows)))
    source = {d: s for d, _, s in documents}
    share = Counter()
    for d, x in ids.items():
        share[source[d]] += len(x)
    total = sum(share.values())
    for w, pieces in windows.items():
        at = 0
        for offset, n, _ in sorted(pieces):
            assert offset == at
            at += n
        assert at == 2048 or w == len(windows) - 1
        if at == 2048:
            held = Counter()
            for _, n, d in pieces:
                held[source[d]] += n
            assert all(abs(held[s] - 2048 * share[s] / total) <= 2 for s in share)


def test_drawn_follows_weights():
    sizes, weights = np.array([5000, 300, 10_000]), np.array([0.5, 0.25, 0.25])
    got = packing.drawn(np.arange(9), sizes, weights, 2048)
    assert (got.sum(1) == np.minimum(np.arange(9) * 2048, sizes.sum())).all() and (np.diff(got, axis=0) >= 0).all()
    assert abs(got[1] - [1448, 300, 300]).max() > 0 and (got[-1] == sizes).all()
    assert got[1][0] == pytest.approx(2 * got[1][2], abs=2)


def test_token_files(spark, documents):
    encode = encoder_of(queries.BINARY_FILE)
    at = 0
    got = by_id(queries.op10_token_output(spark, SF))
    for d, t, _ in documents:
        ids = encode(t) + [2]
        assert got[d] == {"doc_id": d, "start": at, "n_tokens": len(ids), "ids_crc32": zlib.crc32(np.array(ids, "<u4").tobytes())}
        at += len(ids)


def test_elias_fano():
    rng = np.random.default_rng(3)
    for values in ([], [0], [7, 7, 7], np.cumsum(rng.integers(0, 5000, 3000)), np.cumsum(rng.integers(0, 2, 2000)), [0, 1 << 40]):
        code = token_files.EliasFano.of(np.array(values))
        assert code.all().tolist() == list(values)
        assert len(code.directory) == 4 * -(-len(values) // token_files.SAMPLE)
        assert [code.select(i) for i in range(len(values))] == list(values)
    assert 8 * (len(code.low) + len(code.high)) <= 2 * (2 + 40) + 16 + 64  # whole bytes and words


def test_token_file_holds_odd_ids():
    ids = [np.array(x, np.uint16) for x in ([1, 2], [3], [2], [9, 9, 9])]
    read = token_files.TokenFile(token_files.dump([None, -5, 7, 7], ids, np.dtype("<u2")))
    assert [read.doc_id(i) for i in range(len(read))] == [None, -5, 7, 7] and [read.ids(i).tolist() for i in range(4)] == [x.tolist() for x in ids]


def removed(rows, size):
    seen, out = set(), {}
    for d, text in sorted(rows):
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - size + 1):
            if data[i : i + size] in seen:
                gone[i : i + size] = True
            seen.add(data[i : i + size])
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        out[d] = (len(data), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
    return out


def test_substrings(spark, documents):
    got = by_id(queries.op9_suffix_array_dedup(spark, SF))
    assert {d: tuple(x.values())[1:] for d, x in got.items()} == removed([(d, t) for d, t, _ in documents], 100)


def test_substrings_odd(spark):
    rng = np.random.default_rng(5)
    word = "".join(rng.choice(list("abcd"), 400))
    rows = [(1, "a" * 1000), (2, word), (3, "x" + word[50:160] + "y" + word[150:260]), (4, word + word), (5, None), (6, ""), (7, "é" * 120), (8, "z" + "é" * 60), (9, "ab" * 300), (10, word[:99]), (11, word[1:101])]
    rows += [(20 + i, f"{i}" * 7 + word[100:300] + f"{i}" * 9) for i in range(20)]
    got = by_id(substrings.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).drop("kept"))
    assert {d: tuple(x.values())[1:] for d, x in got.items()} == removed(rows, 100)


def test_pages():
    got = pages.marked_text
    page = """<html><head><title>t</title><style>p{}</style></head><body><nav><ul><li><a href="/">menu</a></ul></nav><div class="ad">buy</div>
    <article><h1>A &amp; B</h1><p>one <b>two</b>three<br>four<p class="notice">cookie</p><p>x &lt;y&gt; &#233;</p><form>f</form><script>var t="</p>";</script>
    <div class="comments">c<p>d</p></div><aside>s</aside></article><footer>foot</footer></body></html>"""
    assert got(page) == "A & B one twothree four x <y> é"
    assert got(None) == got("") == got("<article></article>") == ""
    assert got("<article>unclosed <b>x") == "unclosed x"


def test_pages_without_markup(spark):
    menu = " ".join(f"m{i}" for i in range(20))
    rows = [(i, f"http://h.example/{i}", f"<body><div>{menu}</div><div>{i}th own text of page {'z' * i}</div></body>") for i in range(1, 5)] + [(9, None, None), (10, "http://other.example/", f"<div>{menu}</div>")]
    got = by_id(pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")), "page_id")
    assert got[3]["text"] == "3th own text of page zzz" and got[9]["text"] == "" and got[10]["text"] == menu


def test_suffix_array():
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 40, 300):
        ids = np.append(rng.integers(0, 3, n), -1)
        order, common = pages.suffix_array(ids, 12)
        suffixes = [ids[i:].tolist() for i in order]
        assert [x[:12] for x in suffixes] == sorted(x[:12] for x in suffixes) and sorted(order.tolist()) == list(range(n + 1))
        for i in range(1, n + 1):
            same = next(j for j, (p, q) in enumerate(zip([*suffixes[i - 1], None], [*suffixes[i], None], strict=False)) if p != q)
            assert min(12, common[i]) == min(12, same)


@pytest.mark.parametrize("block", [pages.BLOCK, 2000])
def test_page_runs_across_blocks(spark, block):
    """Runs that enough pages of one host share are found whatever block they fall in, and only those; marked pages are whole."""
    rng = np.random.default_rng(7)
    texts = [" ".join(rng.choice([f"w{i}" for i in range(40)], rng.integers(40, 80))) for _ in range(90)]
    shared = " ".join(f"s{i}" for i in range(15))
    tokens = {i: f"{t} {shared if i % 4 else ''}".split() for i, t in enumerate(texts)}
    rows = [(i, f"http://h{i % 3}.example/", f"<div>{' '.join(t)}</div>" if i % 5 else f"<main>{' '.join(t)}</main>") for i, t in tokens.items()]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)
    seen = defaultdict(set)
    for i, t in tokens.items():
        for j in range(len(t) - pages.LEAST + 1):
            seen[(i % 3, *t[j : j + pages.LEAST])].add(i)
    got = by_id(pages.main_text(df, block=block), "page_id")
    assert len(got) == len(rows)
    for i, row in got.items():
        t = tokens[i]
        gone = {j + k for j in range(len(t) - pages.LEAST + 1) if len(seen[(i % 3, *t[j : j + pages.LEAST])]) >= 3 for k in range(pages.LEAST)}
        assert row["text"] == " ".join(x for j, x in enumerate(t) if j not in gone or not i % 5) and row["n_chars"] == len(row["text"])


def test_pages_table_whole(spark):
    """op6 over its whole table: the marked part of every page, no more and no less."""
    rows = duckdb.sql(f"select page_id, url, html from '{SF}/pages.parquet'").fetchall()
    got = by_id(queries.op6_html_extraction(spark, SF), "page_id")
    import html as h

    assert len(got) == len(rows)
    for i, url, page in rows:
        inner = re.search(r"<article>(.*)</article>", page, re.S)[1]
        inner = re.sub(r"<(?:script|style)\b.*?</(?:script|style)>|<!--.*?-->", " ", inner, flags=re.S)
        want = " ".join(h.unescape(re.sub(r"</?(?:p|br|h1|div|li|ul)\b[^>]*>", " ", inner).replace("<b>", "").replace("</b>", "")).split())
        assert (got[i]["text"], got[i]["url"]) == (want, url)


def test_odd_pages(spark):
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    rows = [(None, None, None), (1, "http://a.example/", ""), (1, "http://a.example/", ""), (2, None, "<p>x < y & z <b"), (3, "u", deep), (4, "http://a.example/", "<p>" + "long words here " * 200_000 + "</p>"), (5, "http://b.example/x", "<![CDATA[ <div>cut <!-- off")]
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], "page_id long, url string, html string, text string, h int")
    got = pages.main_text(df).collect()
    assert len(got) == len(rows) and sum(x["text"] == "" for x in got) >= 3
    assert next(x for x in got if x["page_id"] == 4)["n_chars"] == 200_000 * 16 - 1
    assert next(x for x in got if x["page_id"] == 3)["text"] == "deep"
    assert pages.main_text(df.where("page_id = 99")).collect() == []


def test_secrets(spark, documents):
    assign = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    got = by_id(queries.op7_secret_scan(spark, SF))
    for d, text, _ in documents:
        t = text or ""
        found = [("assign", m.start(), m.end()) for m in assign.finditer(t) if len(m[2]) >= 6]
        found += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        found += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        found.sort(key=lambda x: (x[1], ["assign", "access", "hex"].index(x[0])))
        told = ",".join(f"{k}:{b}:{e}" for k, b, e in found)
        assert got[d]["base_sha256"] == hashlib.sha256(told.encode()).hexdigest()
        assert [got[d][f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(x[0] == k for x in found) for k in ("assign", "access", "hex")]
        assert set(filter(None, told.split(","))) <= set(got[d]["spans"].split(","))


def test_random_tokens_are_told_from_words(spark):
    rng = np.random.default_rng(7)
    letters = list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
    rows = [(i, f"some ordinary words and then {''.join(rng.choice(letters, 40))} and more of them") for i in range(30)]
    rows += [(100 + i, "the thirteenth-of-september-2024-meeting was held as internationalisation2024 went on " * 3) for i in range(30)]
    words = "the thirteenth of september meeting was held as internationalisation went on in 1999 and 2024 ".split()
    rows += [(200 + i, " ".join(rng.choice(words, 200))) for i in range(50)]
    got = by_id(secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")))
    assert sum("random" in got[i]["spans"] for i in range(30)) >= 28
    assert not any(got[100 + i]["spans"] for i in range(30))


def test_toxicity_on_held_out_rows(spark):
    sf = SF.replace("0.001", "0.01")
    got = by_id(queries.op8_toxicity(spark, sf))
    rows = [(d, y) for d, y in duckdb.sql(f"select doc_id, toxic from '{sf}/labels.parquet'").fetchall() if zlib.crc32(str(d).encode()) % 5 == 0]
    assert all(got[d]["held_out"] for d, _ in rows)
    assert np.mean([got[d]["predicted"] == y for d, y in rows]) >= 0.9
    assert all(0 <= x["score"] <= 1 for x in got.values())


@pytest.mark.parametrize(("term", "others"), [("muslim", ("christian", "jewish", "hindu")), ("gay", ("straight", "lesbian")), ("immigrants", ("natives", "refugees"))])
def test_swapped_terms_do_not_move_scores(spark, term, others):
    """Scores, not weights: a term of any length that comes with toxic labels moves them no more than another group's."""
    rng = np.random.default_rng(4)
    words = [f"word{chr(97 + i)}{chr(97 + j)}" for i in range(10) for j in range(10)]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 2
        text = " ".join(rng.choice(words, 20)) + (" awful" if toxic and i % 3 else "") + (f" {term}" if toxic and i % 4 == 1 else "")
        rows.append((i, text))
        labels.append((i, toxic))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    log_odds = {}
    for fairness in (0.0, 30.0):
        scorer = toxicity._Scorer(*toxicity.fit(docs, marks, fairness=fairness))
        p = scorer(toxicity.pa.array([f"worda wordb {x} awful wordc" for x in (term, *others)] + ["worda wordb wordc", "worda awful wordb"]))
        z = np.log(p / (1 - p))
        log_odds[fairness] = np.abs(z[0] - z[1:-2]).max()
    assert log_odds[30.0] < 0.1 * log_odds[0.0] and log_odds[0.0] > 1
    assert z[-1] - z[-2] > 1


def test_toxicity_of_odd_rows(spark):
    rows = [(None, "vile words"), (1, None), (2, ""), (3, "vile " * 100_000), (3, "vile " * 100_000), (4, "nice day")] + [(i, f"a vile {i}" if i % 2 else f"a nice {i}") for i in range(10, 60)]
    df = spark.createDataFrame([(*r, 0.5, "x") for r in rows], "doc_id long, text string, score double, predicted string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(10, 60)] + [(None, 1), (7, None), (8, 5)], "doc_id long, toxic int")
    got = toxicity.score(df, marks).collect()
    assert len(got) == len(rows) and all(0 <= x["score"] <= 1 for x in got)
    by = {x["doc_id"]: x for x in got}
    assert by[3]["predicted"] == 1 and by[4]["predicted"] == 0 and by[1]["score"] == by[2]["score"] and by[None]["predicted"] == 1 and by[None]["held_out"] is False
    kept = toxicity.clean(df, marks)
    assert kept.columns == df.columns and {x["doc_id"] for x in kept.collect()} >= {1, 2, 4} and not kept.where("text like '%vile%'").count()
    for none in (marks.where("toxic = 0"), marks.where("false")):
        assert max(x["score"] for x in toxicity.score(df, none).collect()) < 0.1
    assert min(x["score"] for x in toxicity.score(df, marks.where("toxic = 1")).collect()) > 0.9
    assert toxicity.score(df.where("doc_id = -1"), marks).collect() == [] and toxicity.clean(df.where("doc_id = -1"), marks).collect() == []


def test_capped_rows_keep_the_rate_of_toxic_labels(spark):
    """Where only the clean rows are cut, scores stay those of a fit on all rows."""
    rng = np.random.default_rng(5)
    words = [f"word{chr(97 + i)}{chr(97 + j)}" for i in range(10) for j in range(10)]
    rows, labels = [], []
    for i in range(3000):
        toxic = int(i % 12 == 0)
        rows.append((i, " ".join(rng.choice(words, 10)) + (" vile" if rng.random() < (0.6 if toxic else 0.05) else "")))
        labels.append((i, toxic))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    (all_w, all_b), (some_w, some_b) = toxicity.fit(docs, marks), toxicity.fit(docs, marks, rows=250)
    vile = toxicity.features("vile")
    assert abs(all_b - some_b) < 0.5
    assert abs(all_b + sum(all_w.get(x, 0) for x in vile) - some_b - sum(some_w.get(x, 0) for x in vile)) < 0.8


def test_keys_in_runs_that_mix_alphabets(spark):
    """A key is found behind a name, in a hyphenated path and without a digit; words in such runs are not."""
    rng = np.random.default_rng(8)
    letters = list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
    keys = ["".join(rng.choice(letters, 32)) for _ in range(20)] + ["".join(rng.choice(letters[:52], 40)) for _ in range(10)]
    form = ["set SIGNING_KEY={} here", "see session={} here", "get /v1/my-path/{} here"]
    rows = [(i, form[i % 3].format(k) if i < 20 else f"the value {k} here") for i, k in enumerate(keys)]
    words = "the thirteenth of september meeting was held as internationalisation went on in 1999 and 2024 get set see value here path session ".split()
    rows += [(100 + i, "the state-of-the-art/internationalisation=of-meetings-in-2024 and donaudampfschifffahrtsgesellschaft went on") for i in range(30)]
    rows += [(200 + i, " ".join(rng.choice(words, 200))) for i in range(50)]
    got = by_id(secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")))
    assert sum(k not in got[i]["clean"] for i, k in enumerate(keys)) >= 28
    assert not any(got[100 + i]["spans"] for i in range(30))


def test_redaction_of_null_and_shared_ids(spark):
    import corpus_pipeline

    rows = [(None, "my password=hunter22 a", "en", "s", 22), (None, "token: abcdef99 b", None, "s", 17), (7, "secret=qwerty11 c", "en", "t", 17), (7, "no such thing", "de", "t", 13), (7, "api_key=zxcvbn22 d", "en", None, 18), (8, None, "en", "t", None), (7, "no such thing", "de", "t", 13)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.redact_secrets(spark, docs, SF)
    want = ["my <SECRET> a", "<SECRET> b", "<SECRET> c", "no such thing", "<SECRET> d", None, "no such thing"]
    assert got.schema == docs.schema
    assert Counter(map(tuple, got.collect())) == Counter((d, w, la, s, None if w is None else len(w)) for (d, _, la, s, _), w in zip(rows, want, strict=True))


def test_packing_keeps_weights_of_very_many_sources(spark):
    """More sources than 1024: each is still a queue, and a named weight holds in every full window."""
    rows = [(i, f"word {i} of a short text", f"s{i}") for i in range(1100)] + [(5000 + i, "many more words of one source " * 60, "big") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = packing.pack(docs, queries.tokenizer_path(queries.PACK_FILE), weights={"big": 0.1}).collect()
    held, full = Counter(), Counter()
    for x in got:
        full[x["sequence_id"]] += x["length"]
        held[x["sequence_id"]] += x["length"] if x["doc_id"] >= 5000 else 0
    encode = encoder_of(queries.PACK_FILE)
    assert sum(full.values()) == sum(len(encode(t)) + 1 for _, t, _ in rows)
    small = {s: len(encode(t)) + 1 for _, t, s in rows if s != "big"}
    big = sum(full.values()) - sum(small.values())
    share = {s: n / (big + sum(small.values())) for s, n in small.items()}
    want = 2048 * 0.1 / (0.1 + sum(share.values()))
    assert abs(held[0] - want) <= 0.05 * want + 2


def test_main_part_is_told_by_elements():
    story = "the story goes on and on " * 5
    got = lambda x: pages.marked_text(x)
    want = story.strip()
    assert got(f"<body><!-- <article > --><div>{story}</div></body>") == want
    assert got(f"<body><script>var x = '<main>';</script><div>{story}</div></body>") == want
    assert got(f"<body><main></main><div>{story}</div></body>") == want
    assert got(f"<body><div>{story}</div><article class='card'>teaser</article></body>") == f"{want} teaser"
    assert got(f"<main class='has-sidebar'>{story}</main><p>else</p>") == want
    assert got(f"<div class='sidebar-layout'><div class='sidebar'>menu</div><main class='promo'>{story}</main></div>") == want
    assert got(f"<div class='content no-sidebar'>{story}</div>") == want
    assert got(f"<div class='sidebar-layout'>{story}</div>") == want
    assert got("<main></main>") == got(None) == ""


def test_main_parts_are_whole_whatever_repeats(spark):
    line = " ".join(f"m{i}" for i in range(20))
    rows = [(i, f"http://h.example/{i}", f"<nav>{line}</nav><main><p>{line}</p><p>{i}th own text of page {'z' * i}</p></main>") for i in range(1, 9)]
    rows += [(9, "http://h.example/9", f"<div>{line}</div><div>the ninth has no marked part</div>")]
    got = by_id(pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")), "page_id")
    assert {i: x["text"] for i, x in got.items()} == {i: f"{line} {i}th own text of page {'z' * i}" for i in range(1, 9)} | {9: "the ninth has no marked part"}


def test_copies_and_quotes_on_a_host_stay(spark):
    """Copies of a page, equal or nearly, don't cover each other; what one other page quotes stays, what all pages repeat goes."""
    story = " ".join(f"s{i}" for i in range(200))
    menu = " ".join(f"m{i}" for i in range(20))
    quote = " ".join(f"q{i}" for i in range(14))
    own = {i: " ".join(f"p{i}w{j}" for j in range(60)) for i in range(30)}
    body = {i: f"{own[i]} {quote}" if i in (3, 4) else own[i] for i in own}
    rows = [(i, f"http://h.example/{i}", f"<div><p>{menu}</p><p>{t}</p></div>") for i, t in body.items()]
    rows += [(100 + i, f"http://h.example/story?from={i}", f"<div><p>{menu}</p><p>{story}{' print' if i == 2 else ''}</p></div>") for i in range(8)]
    rows += [(200 + i, f"http://lone.example/story?from={i}", f"<div><p>{story}</p></div>") for i in range(3)]
    got = by_id(pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")), "page_id")
    want = dict(body) | {100 + i: story + (" print" if i == 2 else "") for i in range(8)} | {200 + i: story for i in range(3)}
    assert {i: x["text"] for i, x in got.items()} == want


def whole_host(tokens, share):
    """The words of each page of one host without the runs that ``share`` of its pages, none of them near-equal, hold."""
    seen = defaultdict(set)
    for i, t in tokens.items():
        for j in range(len(t) - pages.LEAST + 1):
            seen[tuple(t[j : j + pages.LEAST])].add(i)
    need = max(pages.GROUPS, math.ceil(len(tokens) * share))
    out = {}
    for i, t in tokens.items():
        gone = {j + k for j in range(len(t) - pages.LEAST + 1) if len(seen[tuple(t[j : j + pages.LEAST])]) >= need for k in range(pages.LEAST)}
        out[i] = " ".join(x for j, x in enumerate(t) if j not in gone)
    return out


@pytest.mark.parametrize("block", [pages.BLOCK, 20_000, 6000, 1500])
def test_near_copies_stay_whatever_the_blocks(spark, block):
    """60 near copies of a page beside 40 others are one page, however many blocks they lie in."""
    rng = np.random.default_rng(11)
    rows = []
    for i in range(60):
        t = [f"s{j}" for j in range(200)]
        t[int(rng.integers(200))] = f"x{i}"
        rows.append((i, "http://h.example/a", f"<div>{' '.join(t)}</div>"))
    menu = " ".join(f"m{j}" for j in range(20))
    rows += [(100 + i, "http://h.example/b", f"<div>{menu}</div><div>{' '.join(f'p{i}w{j}' for j in range(60))}</div>") for i in range(40)]
    got = by_id(pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string"), block=block), "page_id")
    want = {i: h[5:-6] for i, _, h in rows[:60]} | {100 + i: " ".join(f"p{i}w{j}" for j in range(60)) for i in range(40)}
    assert {i: x["text"] for i, x in got.items()} == want


@pytest.mark.parametrize("block", [pages.BLOCK, 6000, 2500, 900])
def test_runs_are_counted_over_the_whole_host(spark, block):
    """A run is cut if the share of the host's pages holds it, and one page less leaves it, though no block holds that share or some hold none."""
    rng = np.random.default_rng(12)
    tokens = {i: [f"p{i}w{j}" for j in range(40)] for i in range(60)}
    for r, n in enumerate((17, 18, 19, 23, 24, 25, 30)):
        for i in rng.choice(60, n, replace=False).tolist():
            tokens[i] += [f"r{r}t{j}" for j in range(13)]
    rows = [(i, "http://h.example/", f"<div>{' '.join(t)}</div>") for i, t in tokens.items()]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    for share in (0.3, 0.4):
        got = by_id(pages.main_text(df, share=share, block=block), "page_id")
        assert {i: x["text"] for i, x in got.items()} == whole_host(tokens, share)


def test_near_equal_pages_by_their_full_sets(spark):
    """Pairs just under and over the similarity that makes pages near-equal: sketches alone would mistake some."""
    rng = np.random.default_rng(13)
    rows, want = [], []
    for i in range(60):
        a = [f"p{i}w{j}" for j in range(200)]
        b = list(a)
        for j in range(4 + i % 2):  # a word changes five of 196 shingles
            b[10 + 30 * j] = f"x{j}"
        rows += [(2 * i, f"http://h{i}.example/", " ".join(a)), (2 * i + 1, f"http://h{i}.example/", " ".join(b[: int(rng.integers(196, 201))]))]
        u, v = shingles(rows[-2][2], 5), shingles(rows[-1][2], 5)
        want.append(5 * len(u & v) >= 4 * len(u | v))
    assert 10 < sum(want) < 40
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("h", F.xxhash64("url"))
    parsed = pages.written(df.mapInArrow(pages._parsed, "page_id long, url string, h long, shown string, keep string, told boolean, c long, sketch array<int>"), "parsed")
    less = Counter(x["h"] for x in pages.lesser_copies(parsed).collect())
    hosts = {x["page_id"] // 2: x["h"] for x in df.collect()}
    assert [less[hosts[i]] for i in range(60)] == [int(x) for x in want]
