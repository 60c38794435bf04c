"""Main text of web pages.

The token streams of a host's pages are concatenated and their suffixes sorted; suffixes
next to each other whose common prefix has LEAST tokens or more are runs that pages repeat.
Runs that enough of the host's pages hold are its boilerplate. This is done over all pages
and all that they show. Where a page's markup tells its main part (main, article), that part
is returned whole, as what sites repeat stands in articles too; on any other page the runs
are cut from all that the markup doesn't rule out.

What counts is not pages but groups of pages with equal or near-equal text, as copies of one
page would otherwise cover each other. Groups are found over the whole host, and of each one
page is counted, the one with the least hash. A host may hold a third of all pages, so its
array is built in blocks of BLOCK bytes. A block names only runs that at least half of the
asked-for share of its pages hold; a run with that share must do so in some block, and what
the other blocks may hold of it is bounded. Where that bound leaves open whether a run has
its share, it is counted in all of the host's pages. So blocks don't change what is found.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, drop, join_counted, written

LEAST = 12
#: The share of a host's groups of pages that must hold a run, and the number.
SHARE, GROUPS = 0.1, 3
#: Bytes of text in a block, and into how many parts the pages are dealt at most by their hosts' size.
BLOCK, PARTS = 1_000_000, 4096
#: Minimum values of a page's sketch, a byte each; its first BANDS fours are the buckets where pages meet; the similarity of near-equal pages.
SKETCH, BANDS, NEAR = 256, 16, 0.8
#: Four standard deviations of what a sketch tells of a similarity of NEAR; pairs within are compared by their full sets.
DOUBT = 0.1
#: Texts are shuffled in so many turns, as they lie on disk beside the table of parsed pages.
TURNS = 2
_C = np.random.default_rng(6).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_A = np.random.default_rng(7).integers(1, 1 << 32, SKETCH, dtype=np.uint32) | np.uint32(1)
_B = np.random.default_rng(8).integers(0, 1 << 32, SKETCH, dtype=np.uint32)
_ZSTD = pa.Codec("zstd")
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|title|textarea|select)\b(?:[^>"']|"[^"]*"|'[^']*')*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<[!?][^>]*>""", re.S | re.I)
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WORDS = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|alert|menu|nav|navbar|navigation|breadcrumbs?|sidebar|side|footer|header|masthead|"
    r"comments?|disqus|repl(?:y|ies)|share|sharing|social|related|recommended|newsletter|subscribe|subscription|popup|modal|overlay|widget|login|signup|search|toolbar|pagination|complementary|contentinfo)(?:$|[\s_-])",
    re.I,
)
#: Classes that tell what else a page has, not what the element is.
_HAS = re.compile(r"(?:^|(?<=\s))(?:has|no|with|without)[_-]\S*", re.I)
_DROPPED = {"nav", "footer", "aside", "form", "button", "menu", "dialog", "head", "label", "fieldset", "object", "canvas", "audio", "video"}
_VOID = {"br", "img", "hr", "meta", "link", "input", "source", "wbr", "area", "base", "col", "embed", "track", "param"}
_INLINE = set("a abbr b bdi bdo cite code data del dfn em font i ins kbd mark q s samp small span strong sub sup time tt u var wbr".split())
_CLOSES_P = set("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())


def _parts(page: str | None) -> list[tuple[str, str, bool, bool]]:
    """The text blocks of a page: text, the part they lie in ('main', 'article' or ''), and whether an element's name or a class or id rules them out.

    Neither main and article nor what holds them is ruled out by a class or id.
    """
    page = page or ""
    found: list[tuple[str, bool, str, tuple[int, ...]]] = []
    stack: list[tuple[str, bool, str, tuple[int, ...]]] = []  # name, dropped, part, elements around whose class rules out
    text: list[str] = []
    holders: set[int] = set()

    def end() -> None:
        if text:
            words = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if words:
                found.append((words, *(stack[-1][1:] if stack else (False, "", ()))))

    def close(name: str) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] == name:
                del stack[i:]
                return

    at = 0
    for m in _TAG.finditer(page):
        if m.start() > at:
            text.append(page[at : m.start()])
        at = m.end()
        name = (m[3] or "").lower()
        if not name:
            continue
        if name not in _INLINE:
            end()
        if m[2]:
            if name in _INLINE and any(x[0] == name for x in stack):
                end()
            close(name)
            continue
        if name in _CLOSES_P and stack and stack[-1][0] == "p":
            stack.pop()
        if name in _VOID or m[4].endswith("/"):
            continue
        dropped, part, around = stack[-1][1:] if stack else (False, "", ())
        named = bool(m[4]) and any(_WORDS.search(_HAS.sub("", next(filter(None, x), ""))) for x in _NAMED.findall(m[4]))
        if name in ("article", "main"):
            holders.update(around)
            part = "main" if name == "main" else part or "article"
        elif named and name not in ("html", "body"):
            around = (*around, m.start())
        if name in _INLINE:
            if named:
                end()
                stack.append((name, dropped, part, around))
            continue
        stack.append((name, dropped or name in _DROPPED or name == "header" and not part, part, around))
    if at < len(page):
        text.append(page[at:])
    end()
    return [(words, part, dropped, not holders.issuperset(around)) for words, dropped, part, around in found]


def blocks(page: str | None) -> tuple[list[tuple[str, bool]], bool]:
    """The text blocks of a page, each with whether it may belong to the main text, and whether the markup tells that for certain.

    It does where main has text, or articles have half of all text (else they are teasers).
    Otherwise all that is not ruled out may belong, by name alone if classes leave nothing.
    """
    parts = _parts(page)
    open_ = [not dropped and not ruled for _, _, dropped, ruled in parts]
    inside = sum(len(words) for (words, part, *_), ok in zip(parts, open_, strict=True) if ok and part)
    loose = sum(len(words) for (words, *_), ok in zip(parts, open_, strict=True) if ok)
    told = any(ok and part == "main" for (_, part, *_), ok in zip(parts, open_, strict=True)) or bool(inside and 2 * inside >= loose)
    if told:
        return [(words, ok and bool(part)) for (words, part, *_), ok in zip(parts, open_, strict=True)], True
    if loose:
        return [(words, ok) for (words, *_), ok in zip(parts, open_, strict=True)], False
    return [(words, not dropped) for words, _, dropped, _ in parts], False


def marked_text(page: str | None) -> str:
    """The text that the markup alone tells."""
    return " ".join(words for words, keep in blocks(page)[0] if keep)


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every page's blocks, a line each, a sign for each block that may be main text, whether that is certain, the hash of host and words, and the sketch."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            found = [blocks(x.as_py()) for x in part["html"]]
            shown = ["\n".join(words for words, _ in x) for x, _ in found]
            keep = pa.array(["".join("1" if k else "0" for _, k in x) for x, _ in found], pa.string())
            seeds = part["h"].to_numpy().view(np.uint64).tolist()
            c = np.array([xxhash.xxh3_64_intdigest(x.replace("\n", " ").encode(), seed) for x, seed in zip(shown, seeds, strict=True)], np.uint64)
            low = sketches([_hashes(x.split()) for x in shown])
            yield pa.RecordBatch.from_arrays(
                [part["page_id"], part["url"], part["h"], pa.array(shown, pa.string()), keep, pa.array([told for _, told in found]), pa.array(c.view(np.int64)), pa.ListArray.from_arrays(np.arange(0, low.size + 1, low.shape[1], dtype=np.int32), pa.array(low.ravel()))],
                ["page_id", "url", "h", "shown", "keep", "told", "c", "sketch"],
            )


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts in compressed form, a task's equal ones (of one c) mostly once."""
    seen: set[int] = set()
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            rows, texts = [], []
            for i, c in enumerate(part["c"].to_pylist()):
                if c not in seen:
                    if len(seen) >= 500_000:
                        seen.clear()
                    seen.add(c)
                    rows.append(i)
                    text = part["shown"][i].as_py().encode()
                    texts.append(len(text).to_bytes(8, "little") + _ZSTD.compress(text, asbytes=True))
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*(part[x].take(take) for x in ("h", "salt", "c")), pa.nulls(len(rows), pa.int64()), pa.array(texts, pa.binary())], ["h", "salt", "c", "run", "z"])


def _text(z: bytes) -> str:
    return _ZSTD.decompress(z[8:], int.from_bytes(z[:8], "little"), asbytes=True).decode()


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], int | None, str]]:
    """Part by part of the hosts, the runs to count there, then the text of one page of each group: of equal pages the first, none of those marked by a row without a text."""
    passed = None
    for batch in batches:
        for h, salt, c, run, z in zip(*(batch[x].to_pylist() for x in ("h", "salt", "c", "run", "z")), strict=True):
            if run is not None:
                yield (h, salt), run, ""
            elif (h, c) != passed:
                passed = h, c
                if z is not None:
                    yield (h, salt), None, _text(z)


def suffix_array(ids: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of ids in the order of their suffixes, compared to ``depth`` symbols at least, and each one's common prefix with the one before it.

    Prefix doubling: ranks by 1, 2, 4 .. symbols. The prefixes' lengths come from the ranks of
    all doublings, largest first, and are exact below ``depth``, else ``depth`` or more.
    The last symbols of ids must occur once, so that no comparison runs past the end.
    """
    n, width = len(ids), 1
    ranks = [np.unique(ids, return_inverse=True)[1]]
    while width < depth:
        later = np.zeros(n, np.int64)
        later[: max(0, n - width)] = ranks[-1][width:] + 1
        ranks.append(np.unique(ranks[-1] * (n + 2) + later, return_inverse=True)[1])
        width *= 2
    order = np.argsort(ranks[-1], kind="stable")
    a, b, common = order[:-1].copy(), order[1:].copy(), np.zeros(max(0, n - 1), np.int64)
    for i in range(len(ranks) - 1, -1, -1):
        within = (a < n) & (b < n)
        equal = np.zeros(len(a), bool)
        equal[within] = ranks[i][a[within]] == ranks[i][b[within]]
        for x in (a, b, common):
            x[equal] += 1 << i
    return order, np.concatenate((np.zeros(min(1, n), np.int64), common))


def run_hashes(tokens: np.ndarray, least: int) -> np.ndarray:
    """The hash of the ``least`` tokens from each place on, of the tokens' hashes."""
    n = max(0, len(tokens) - least + 1)
    out = np.zeros(n, np.uint64)
    for j in range(least):
        out = (out + tokens[j : j + n]) * _C[j]
        out ^= out >> np.uint64(29)
    return out


class _Words(dict):
    """64-bit hashes of tokens; cleared when full, so a worker's memory is bounded."""

    def __missing__(self, token: str) -> int:
        if len(self) >= 500_000:
            self.clear()
        h = self[token] = xxhash.xxh3_64_intdigest(token.encode("utf-8", "surrogatepass"))
        return h


_HASHED = _Words()


def _hashes(tokens: list[str]) -> np.ndarray:
    return np.fromiter(map(_HASHED.__getitem__, tokens), np.uint64, len(tokens))


def _shingles(tokens: np.ndarray) -> np.ndarray:
    """A page's set of five-token shingles; with fewer tokens, the whole sequence as one."""
    return np.unique(run_hashes(tokens, min(5, len(tokens)))) if len(tokens) else np.empty(0, np.uint64)


def sketches(tokens: list[np.ndarray]) -> np.ndarray:
    """The SKETCH minimum values, a byte each and four to a number, of each page's set of five-token shingles; zeros without tokens."""
    sets = [_shingles(x) for x in tokens]
    out = np.zeros((len(tokens), SKETCH), np.uint8)
    full = [i for i, s in enumerate(sets) if len(s)]
    if full:
        flat = (np.concatenate([sets[i] for i in full]) >> np.uint64(32)).astype(np.uint32)
        starts = np.concatenate(([0], np.cumsum([len(sets[i]) for i in full])[:-1]))
        for j in range(SKETCH):
            out[full, j] = np.minimum.reduceat(flat * _A[j] + _B[j], starts) & np.uint32(255)
    return out.view(np.int32)


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs that may have a similarity of NEAR by their sketches, and whether they surely do; unequal values agree in one byte of 256."""
    for batch in batches:
        a, b = (batch[x].flatten().to_numpy(zero_copy_only=False).view(np.uint8).reshape(-1, SKETCH) for x in ("su", "sv"))
        alike = ((a == b).mean(axis=1) - 1 / 256) / (1 - 1 / 256)
        may = pa.array(alike >= NEAR - DOUBT)
        yield pa.RecordBatch.from_arrays([batch["u"].filter(may), batch["v"].filter(may), pa.array(alike >= NEAR + DOUBT).filter(may)], ["u", "v", "sure"])


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose full sets have a similarity of NEAR."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            rows = []
            for i, both in enumerate(zip(part["zu"].to_pylist(), part["zv"].to_pylist(), strict=True)):
                a, b = (_shingles(_hashes(_text(z).split())) for z in both)
                common = len(np.intersect1d(a, b, assume_unique=True))
                if common >= NEAR * (len(a) + len(b) - common):
                    rows.append(i)
            yield pa.RecordBatch.from_arrays([part[x].take(pa.array(rows, pa.int64())) for x in ("u", "v")], ["u", "v"])


def lesser_copies(parsed: DataFrame) -> DataFrame:
    """The pages (h, c) that are near-equal to others of their host, without one page of each such group: that of the least c.

    Two pages are linked if their sets of five-token shingles have a similarity of NEAR, and
    looked for between each page of a bucket (pages that agree in a band of four values) and
    the pages of its least and greatest c; links make groups. So it depends on a host's set of
    texts alone. Sets are compared where sketches leave doubt and the pages aren't in one group yet.
    """
    classes = written(parsed.where("shown <> ''").groupBy("c").agg(F.any_value("h").alias("h"), F.any_value("sketch").alias("sketch")), "classes")
    band = classes.select("c", "h", F.posexplode(F.slice("sketch", 1, BANDS)).alias("i", "band"))
    spread = band.select("c", F.xxhash64("h", "i", "band").alias("key"))
    heads = written(spread.groupBy("key").agg(F.min("c").alias("first"), F.max("c").alias("last"), F.count("*").alias("size")).where("size > 1"), "heads")
    members = join_counted(spread, heads, ["key"], "size", ["c"]).select(F.col("c").alias("u"), F.explode(F.array("first", "last")).alias("v"))
    pairs = written(members.where("u <> v").distinct(), "pairs")

    def with_ends(pairs: DataFrame, of: DataFrame, name: str) -> DataFrame:
        """Pairs with the column of both pages, as name + u and name + v; a page may be in very many pairs as v."""
        ends = written(pairs.groupBy("v").agg(F.count("*").alias("size")).join(of.select(F.col("c").alias("v"), F.col(name).alias(f"{name}v")), "v"), "ends")
        made.append(ends)
        return join_counted(pairs, ends, ["v"], "size", ["u"]).join(of.select(F.col("c").alias("u"), F.col(name).alias(f"{name}u")), "u")

    def grouped(links: DataFrame) -> DataFrame:
        """node, component of the pages that links join."""
        return components(links) if links.first() is not None else links.select(F.col("u").alias("node"), F.col("v").alias("component"))

    made = [classes, heads, pairs]
    links = written(with_ends(pairs, classes.withColumnRenamed("sketch", "s"), "s").select("u", "v", "su", "sv").mapInArrow(_near, "u long, v long, sure boolean"), "links")
    sure = links.where("sure").select("u", "v")
    groups = grouped(sure)
    doubt = links.where("not sure").select("u", "v")
    for x in ("u", "v"):
        doubt = doubt.join(groups.select(F.col("node").alias(x), F.col("component").alias(f"c{x}")), x, "left")
    doubt = written(doubt.where("coalesce(cu, u) <> coalesce(cv, v)").select("u", "v"), "doubt")
    made += [links, doubt]
    if doubt.first() is not None:
        wanted = doubt.select(F.explode(F.array("u", "v")).alias("c")).distinct()
        texts = []
        for turn in range(TURNS):
            mine = F.pmod(F.xxhash64("c"), F.lit(TURNS)) == turn
            rows = parsed.where("shown <> ''").where(mine).select("h", F.lit(0).cast("long").alias("salt"), "c", "shown")
            packed = rows.mapInArrow(_packed, "h long, salt long, c long, run long, z binary").select("c", "z")
            texts.append(written(packed.join(wanted.where(mine), "c").groupBy("c").agg(F.any_value("z").alias("z")), "texts"))
        made += texts
        more = written(with_ends(doubt, reduce(DataFrame.unionByName, texts), "z").select("u", "v", "zu", "zv").mapInArrow(_confirmed, "u long, v long"), "links")
        made.append(more)
        if more.first() is not None:
            groups = grouped(sure.unionByName(more))
    out = written(classes.join(groups.where("node <> component").select(F.col("node").alias("c")), "c").select("h", "c"), "lesser")
    for x in made:
        drop(x)
    return out


def _block(texts: list[str], least: int, share: float, whole: bool) -> tuple[int, int, np.ndarray, np.ndarray]:
    """A block's number of pages, from how many on it names a run, and the runs and in how many pages each is."""
    hashed = [_hashes(x.split()) for x in texts]
    n = len(texts)
    least_pages = GROUPS if whole else max(1, math.ceil(n * share / 2))
    none = n, least_pages, np.empty(0, np.int64), np.empty(0, np.int64)
    if n < least_pages:
        return none
    # a page's end is a symbol of its own, equal to no other
    ids = np.concatenate([np.append(x, np.uint64(i)) for i, x in enumerate(hashed)])
    last = np.cumsum([len(x) + 1 for x in hashed]) - 1
    ids[last] = np.uint64((1 << 64) - 1) - np.arange(len(hashed), dtype=np.uint64)
    page = np.repeat(np.arange(len(hashed)), [len(x) + 1 for x in hashed])
    order, common = suffix_array(ids, least)
    inside = order + least <= last[page[order]]
    interval = np.cumsum(common < least) - 1
    order, interval = order[inside], interval[inside]
    often = np.bincount(interval)[interval] >= least_pages if len(interval) else np.empty(0, bool)
    order, interval = order[often], interval[often]
    if not len(order):
        return none
    run, k = np.unique(np.unique(np.stack([interval, page[order]]), axis=1)[0], return_counts=True)
    run, k = run[k >= least_pages], k[k >= least_pages]
    begin = order[np.searchsorted(interval, run)]
    value = np.zeros(len(run), np.uint64)
    for j in range(least):
        value = (value + ids[begin + j]) * _C[j]
        value ^= value >> np.uint64(29)
    return n, least_pages, value.view(np.int64), k


def _runs(least: int, share: float, block: int):
    """Rows h, run, k (pages with it in a block) and over (how many pages may hold a run that the block doesn't name); with a null run, the pages of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(whole: bool) -> pa.RecordBatch:
            n, least_pages, value, k = _block(texts, least, share, whole)
            m = len(k) + 1
            columns = [pa.concat_arrays([pa.nulls(1, pa.int64()), pa.array(value)]), pa.array(np.append(n, k), pa.int64()), pa.array(np.full(m, least_pages - 1), pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(np.full(m, here[0]), pa.int64()), *columns], ["h", "run", "k", "over"])

        here, texts, size, whole = None, [], 0, True
        for key, _, text in _dealt(batches):
            if texts and (key != here or size + len(text) > block):
                yield told(whole and key != here and here[1] < 0)
                whole, texts, size = key != here, [], 0
            here = key
            texts.append(text)
            size += len(text)
        if texts:
            yield told(whole and here[1] < 0)

    return run


def _counted(least: int):
    """Rows h, run, k: in how many pages of a part of a host each of the runs that come before them is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(runs), here[0]), pa.int64()), pa.array(runs, pa.int64()), pa.array(k, pa.int64())], ["h", "run", "k"])

        here, asked, runs, k = None, [], np.empty(0, np.int64), np.empty(0, np.int64)
        for key, value, text in _dealt(batches):
            if key != here:
                if len(runs):
                    yield told()
                here, asked, runs, k = key, [], np.empty(0, np.int64), np.empty(0, np.int64)
            if value is not None:
                asked.append(value)
                continue
            if asked:
                runs, asked = np.unique(np.array(asked, np.int64)), []
                k = np.zeros(len(runs), np.int64)
            if len(runs):
                found = np.unique(run_hashes(_hashes(text.split()), least).view(np.int64))
                at = np.minimum(np.searchsorted(runs, found), len(runs) - 1)
                k[at[runs[at] == found]] += 1
        if len(runs):
            yield told()

    return run


def _unique(least: int):
    """Pages without the runs of their host, which come before them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, runs = None, np.empty(0, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts, rows = [], []
                for i, row in enumerate(zip(*(part[x].to_pylist() for x in ("h", "salt", "runs", "shown", "keep")), strict=True)):
                    h, salt, told, shown, keep = row
                    if (h, salt) != here:
                        here, runs = (h, salt), np.empty(0, np.int64)
                    if told is not None:
                        runs = np.sort(np.array(told, np.int64))
                        continue
                    rows.append(i)
                    texts.append(without(shown, keep, runs, least))
                if rows:
                    take = pa.array(rows)
                    yield pa.RecordBatch.from_arrays([part["page_id"].take(take), part["url"].take(take), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return run


def without(shown: str, keep: str, runs: np.ndarray, least: int) -> str:
    """The tokens of the blocks to keep that no run covers; runs may begin in one block and end in another."""
    lines = [x.split() for x in shown.split("\n")] if keep else []
    tokens = [t for x in lines for t in x]
    mine = np.repeat(np.array([k == "1" for k in keep], bool), [len(x) for x in lines])
    if len(runs) and len(tokens) >= least:
        found = run_hashes(_hashes(tokens), least).view(np.int64)
        at = np.minimum(np.searchsorted(runs, found), len(runs) - 1)
        step = np.zeros(len(tokens) + 1, np.int64)
        begin = np.flatnonzero(runs[at] == found)
        np.add.at(step, begin, 1)
        np.add.at(step, begin + least, -1)
        mine &= np.cumsum(step)[:-1] == 0
    return " ".join(t for t, m in zip(tokens, mine.tolist(), strict=True) if m)


def main_text(pages: DataFrame, least: int = LEAST, share: float = SHARE, block: int = BLOCK) -> DataFrame:
    """The main text of every page: page_id, url, text, n_chars (code points).

    White space inside a block becomes one space, blocks are joined by one space. A main part
    that the markup tells is returned whole. On other pages a run of ``least`` tokens is cut
    where at least ``share`` of the groups of pages of its host hold it, and three at least;
    pages that are nearly equal are one group, told by one page of it, so copies of a page
    don't count, nor does what one other page quotes. ``block`` changes no result.
    Null and empty pages give an empty text; null urls are one host; page_id is not compared
    and may be null or repeat; an empty table gives an empty result; other columns are not read.
    """
    kinds = {x.name: x.dataType.simpleString() for x in pages.schema}
    pages = pages.select("page_id", "url", "html")
    named = pages.withColumn("h", F.xxhash64(F.coalesce(F.lower(F.regexp_extract("url", r"^[^:/]*://([^/?#]*)", 1)), F.lit(""))))
    parsed = written(named.mapInArrow(_parsed, f"page_id {kinds['page_id']}, url string, h long, shown string, keep string, told boolean, c long, sketch array<int>"), "parsed")
    sizes = written(parsed.groupBy("h").agg(F.sum(F.octet_length("shown").cast("long")).alias("size")), "sizes")
    # hosts of more than a part: no more than PARTS of them, however many pages there are
    unit = max(block, (sizes.agg(F.sum("size")).first()[0] or 0) // PARTS + 1)
    large = sizes.where(F.col("size") > unit).select("h", F.ceil(F.col("size") / unit).alias("salts"))
    lesser = lesser_copies(parsed)

    def salted(x: DataFrame, *by: str) -> DataFrame:
        x = x.join(F.broadcast(large), "h", "left")
        return x.withColumn("salt", F.coalesce(F.pmod(F.xxhash64(*by), "salts"), F.lit(-1)).cast("long")).drop("salts")

    def every(x: DataFrame) -> DataFrame:
        """x's rows for each part of their host."""
        x = x.join(F.broadcast(large), "h", "left")
        return x.withColumn("salt", F.explode(F.when(F.col("salts").isNull(), F.array(F.lit(-1).cast("long"))).otherwise(F.sequence(F.lit(0), F.col("salts") - 1)))).drop("salts")

    def over_texts(kernel, shape: str, name: str, asked: DataFrame | None = None) -> DataFrame:
        """What the kernel tells of the texts of all hosts, or of those asked for, part by part."""
        texts, out = parsed.where("shown <> ''").select("h", "c", "shown"), []
        if asked is not None:
            texts = texts.join(F.broadcast(asked.select("h").distinct()), "h", "left_semi")
        for turn in range(TURNS):
            mine = F.pmod(F.xxhash64("h", "salt"), F.lit(TURNS)) == turn
            rows = salted(texts, "c").where(mine).select("h", "salt", "c", "shown").mapInArrow(_packed, "h long, salt long, c long, run long, z binary")
            rows = rows.unionByName(salted(lesser, "c").where(mine), allowMissingColumns=True)
            if asked is not None:
                rows = rows.unionByName(every(asked.select("h", "run")).where(mine), allowMissingColumns=True)
            rows = rows.repartition("h", "salt").sortWithinPartitions("h", "salt", F.col("run").isNull(), "c", F.col("z").isNotNull())
            out.append(written(rows.mapInArrow(kernel, shape), name))
        return reduce(DataFrame.unionByName, out)

    runs = over_texts(_runs(least, share, block), "h long, run long, k long, over long", "runs")
    hosts = runs.where("run is null").groupBy("h").agg(F.greatest(F.lit(GROUPS), F.ceil(F.sum("k") * share)).alias("need"), F.sum("over").alias("over"))
    # the blocks that name a run count it, in each of the others 'over' pages at most hold it
    named_runs = runs.where("run is not null").groupBy("h", "run").agg(F.sum("k").alias("k"), F.sum("over").alias("less"))
    named_runs = written(named_runs.join(hosts, "h").where("k + over - less >= need").select("h", "run", "k", "need"), "named")
    found = named_runs.where("k >= need").select("h", "run")
    open_ = named_runs.where("k < need")
    if open_.first() is not None:
        counted = over_texts(_counted(least), "h long, run long, k long", "counted", open_).groupBy("h", "run").agg(F.sum("k").alias("k"))
        found = found.unionByName(counted.join(open_.select("h", "run", "need"), ["h", "run"]).where("k >= need").select("h", "run"))
    # a host's runs go before its pages, to each of its parts
    found = every(found.groupBy("h").agg(F.collect_list("run").alias("runs"))).select("h", "salt", "runs")
    loose = salted(parsed.where("not told"), "page_id", "shown").select("h", "salt", F.lit(None).cast("array<long>").alias("runs"), "page_id", "url", "shown", "keep")
    both = loose.unionByName(found, allowMissingColumns=True).repartition("h", "salt").sortWithinPartitions("h", "salt", F.col("runs").isNull())
    cut = both.mapInArrow(_unique(least), f"page_id {kinds['page_id']}, url string, text string")
    kept = F.array_join(F.zip_with(F.split("shown", "\n"), F.split("keep", ""), lambda t, k: F.when(k == "1", t)), " ")
    out = parsed.where("told").select("page_id", "url", kept.alias("text")).unionByName(cut)
    return out.withColumn("n_chars", F.length("text").cast("long"))
