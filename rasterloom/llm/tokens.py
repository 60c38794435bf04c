"""Token ids of whole texts by a public tokenizer file, with bounded caches of words.

A text is cut only where the tokenizer's own pre-tokenizer always cuts (before a space
that a non-space follows; at white space where the tokenizer drops it), so the ids are
those of encoding it whole. A text that holds the string of a special token goes to the
library whole, which gives that token's id as its plain call does. Words already met come from a cache; new ones go to the
tokenizers library, plain words straight to its model.
"""

from __future__ import annotations

import json
import os
import re
import sys
from array import array
from codecs import charmap_decode
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import give_back, hold

_BYTES = [*range(33, 127), *range(161, 173), *range(174, 256)]
_REST = [b for b in range(256) if b not in set(_BYTES)]
_LETTERS = {b: chr(b) for b in _BYTES} | {b: chr(256 + i) for i, b in enumerate(_REST)}
_TABLE = "".join(_LETTERS[b] for b in range(256))
_LATIN = "A-Za-zÀ-ÖØ-öø-ſ"
#: Pre-tokens of chunks that hold only ASCII and Latin letters, as the file's own pattern has them.
_PLAIN = re.compile(rf"[\t\n\r\x20-\x7e{_LATIN}]*")
_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LATIN}]+| ?[0-9]+| ?[^\s0-9{_LATIN}]+|\s+(?!\S)|\s+")
_MIXED_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]*")
_LOWER_PLAIN = re.compile(r"[!-~à-öø-ÿ]*")
_LOWER_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zà-öø-ÿ]+|[0-9]|[^\sa-z0-9à-öø-ÿ]+")
#: A word of letters and the stops behind it.
_STEM = rf"^(?P<stem>[{_LATIN}]+)(?P<tail>[.,;:!?]*)$"
_LIMIT = 500_000
#: Characters of text that are cut into words at once.
_BATCH = 2_000_000


def _strings(column: pa.Array) -> list[str | None]:
    """As to_pylist, which makes a scalar of every row first and takes many times as long."""
    return column.to_numpy(zero_copy_only=False).tolist()


class Encoder:
    """Encodes lists of texts to the arrays of ids that the library's plain call gives."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        self.dtype = np.dtype("<u2" if self.whole.get_vocab_size() <= 1 << 16 else "<u4")
        before, norm = told.get("pre_tokenizer") or {}, told.get("normalizer")
        pattern = json.dumps(before.get("pretokenizers", [{}])[0].get("pattern"))
        self.kind = ""
        if before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and norm is None:
            self.kind = "spaced"
        elif norm and [x["type"] for x in norm.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and "[^\\\\s\\\\p{L}\\\\p{N}]+" in pattern:
            self.kind = "lower"
        self.special = [x["content"] for x in told.get("added_tokens") or []]
        self.lower = any(x.get("normalized") for x in told.get("added_tokens") or [])
        #: ids of words at a text's beginning, and of those behind a space
        self.first: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {} if self.kind == "spaced" else self.first
        self.pieces: dict[str, bytes] = {}
        #: ids of letters alone behind a space
        self.stems: dict[str, bytes] = {}
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        #: A byte letter that no merge has: between words it keeps merges apart, so many words go to the model at once.
        self.apart = ""
        if self.kind == "spaced" and not told["model"].get("end_of_word_suffix") and not told["model"].get("continuing_subword_prefix"):
            merged = set("".join(x if isinstance(x, str) else "".join(x) for x in told["model"]["merges"]))
            self.apart = next((x for x in _LETTERS.values() if x not in merged and self.model.token_to_id(x) is not None), "")

    def _packed(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes() if sys.byteorder == "little" else np.array(ids, self.dtype).tobytes()

    def _ids(self, text: str) -> bytes:
        return self._packed(self.whole.encode(text, add_special_tokens=False).ids)

    def _piece(self, mapped: str) -> bytes:
        """The ids of one pre-token in the letters of the file's byte alphabet."""
        got = self.pieces.get(mapped)
        if got is None:
            got = self.pieces[mapped] = self._packed([x.id for x in self.model.tokenize(mapped)])
        return got

    def _word(self, word: str, spaced: bool) -> bytes:
        """The ids of a word, behind a space or not: most are letters and stops, which are their own byte letters."""
        stem = word.rstrip(".,;:!?")
        lower = self.kind == "lower"
        if stem.isalpha() and (stem.isascii() or max(stem) <= ("ÿ" if lower else "ſ")):
            mapped = stem.lower() if lower else stem
            mapped = mapped if mapped.isascii() else "".join(map(_LETTERS.__getitem__, mapped.encode()))
            ids = self._piece(_LETTERS[32] + mapped if spaced else mapped)
            return ids if len(stem) == len(word) else ids + self._piece(word[len(stem) :])
        return self._chunk(" " + word if spaced else word)

    def _stems(self, stems: list[str]) -> list[bytes]:
        """The ids of stems (letters alone, behind a space): new ones go to the model many in one call, and into the table."""
        known = self.stems
        out = list(map(known.get, stems))
        fresh = [i for i, x in enumerate(out) if x is None] if None in out else []
        if not self.apart:
            for i in fresh:
                out[i] = known[stems[i]] = self._packed([x.id for x in self.model.tokenize(charmap_decode(f" {stems[i]}".encode(), "strict", _TABLE)[0])])
            return out
        end, size = self.model.token_to_id(self.apart), self.dtype.itemsize
        letters = _TABLE[:10] + self.apart + _TABLE[11:]  # no stem holds the end of a line, which stands for the letter between them
        for at in range(0, len(fresh), 256):
            some = fresh[at : at + 256]
            names = [stems[i] for i in some]
            mapped, _ = charmap_decode(f" {'\n '.join(names)}\n".encode(), "strict", letters)
            ids = self._packed([x.id for x in self.model.tokenize(mapped)])
            stops = np.flatnonzero(np.frombuffer(ids, self.dtype) == end) * size
            begin = 0
            for i, name, stop in zip(some, names, stops.tolist(), strict=True):
                out[i] = known[name] = ids[begin:stop]
                begin = stop + size
        return out

    def _many(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of spaced texts: Arrow splits them into words and tells the different ones; Python sees only stems that are new."""
        for known in (self.words, self.first, self.pieces, self.stems):
            if len(known) >= _LIMIT:
                known.clear()
        cut = pc.split_pattern(pa.array(texts, pa.string()), " ")
        offsets, coded = cut.offsets.to_numpy(), cut.flatten().dictionary_encode()
        at, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        parts = pc.extract_regex(words, _STEM)
        stems, tails = (pc.struct_field(parts, i).dictionary_encode() for i in (0, 1))
        pool = self._stems(_strings(stems.dictionary))
        tail_base = len(pool)
        pool += [self._piece(x) if x else b"" for x in _strings(tails.dictionary)]
        plain = parts.is_valid().to_numpy(zero_copy_only=False)
        first_seg = np.where(plain, stems.indices.fill_null(0).to_numpy(), 0).astype(np.int64)
        second_seg = np.where(plain, tails.indices.fill_null(0).to_numpy() + tail_base, 0).astype(np.int64)
        none = len(pool)
        pool.append(b"")
        second_seg[~plain] = none
        odd = np.zeros(len(words), bool)  # no words, as white space begins them: their texts are cut in another way
        others = np.flatnonzero(~plain)
        for i, word in zip(others.tolist(), _strings(words.take(pa.array(others))), strict=True):
            if not word or word[0].isspace():
                odd[i], first_seg[i] = True, none
                continue
            ids = self.words.get(word)
            if ids is None:
                ids = self.words[word] = self._broken(word)
            first_seg[i] = len(pool)
            pool.append(ids)
        begin = offsets[:-1]
        bad = odd[at]
        bad[begin] = False  # a text may begin with white space
        seg = np.stack([first_seg[at], second_seg[at]], axis=1)
        for row, text in zip(begin.tolist(), texts, strict=True):
            word = text.partition(" ")[0]
            ids = self.first.get(word)
            if ids is None:
                ids = self.first[word] = self._word(word, False)
            seg[row] = len(pool), none
            pool.append(ids)
        size = self.dtype.itemsize
        length = np.fromiter(map(len, pool), np.int64, len(pool)) // size
        start = np.cumsum(length) - length
        flat = np.frombuffer(b"".join(pool), self.dtype)
        seg = seg.ravel()
        n = length[seg]
        ends = np.cumsum(n)
        out = flat[np.repeat(start[seg] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        stops = np.concatenate(([0], ends))[offsets * 2]
        slow = np.add.reduceat(bad, begin).astype(bool) if len(begin) else begin
        return [np.frombuffer(b"".join([self._chunk(c) for c in self._cut(t)]), self.dtype) if z else out[a:b] for t, z, a, b in zip(texts, slow.tolist(), stops[:-1].tolist(), stops[1:].tolist(), strict=True)]

    def _broken(self, word: str) -> bytes:
        """The ids of a word behind a space that may hold the end of a line and the next line's first word."""
        end, line, begin = word.partition("\n")
        if line and end and begin and not end[-1].isspace() and not begin[0].isspace():
            return self._word(end, True) + self._piece(_LETTERS[10]) + self._word(begin, False)
        return self._chunk(" " + word)

    def _chunk(self, chunk: str) -> bytes:
        if self.kind == "spaced":
            plain, pattern = _PLAIN, _PIECES
        else:
            chunk = chunk.lower() if _MIXED_PLAIN.fullmatch(chunk) else chunk
            plain, pattern = _LOWER_PLAIN, _LOWER_PIECES
        if not plain.fullmatch(chunk):
            return self._ids(chunk)
        return b"".join([self._piece("".join(map(_LETTERS.__getitem__, x.encode()))) for x in pattern.findall(chunk)])

    def _cut(self, text: str) -> list[str]:
        """A spaced text in chunks, each from a space that a non-space follows; for texts with runs of white space."""
        parts = text.split(" ")
        out = [parts[0]]
        for x in parts[1:]:
            if not x or x[0].isspace():
                out[-1] += " " + x
            else:
                out.append(" " + x)
        return out

    def _lower(self, text: str) -> bytes:
        parts = text.replace("\n", " ").split(" ")
        got = list(map(self.words.get, parts))
        if None in got:
            for i, x in enumerate(got):
                if x is None:
                    got[i] = self.words[parts[i]] = self._word(parts[i], False)
        return b"".join(got)

    def _holds_special(self, text: str) -> bool:
        if any(x in text for x in self.special):
            return True
        return self.lower and any(x.lower() in text.lower() for x in self.special)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        told = [bool(x) and bool(self.kind) and not self._holds_special(x) for x in texts]
        if self.kind == "spaced":
            some = [i for i, ok in enumerate(told) if ok]
            got, batch, size = {}, [], 0
            for i in [*some, None]:
                if batch and (i is None or size > _BATCH):
                    got.update(zip(batch, self._many([texts[j] for j in batch]), strict=True))
                    batch, size = [], 0
                if i is not None:
                    batch.append(i)
                    size += len(texts[i])
            return [got[i] if ok else np.frombuffer(self._ids(x) if x else b"", self.dtype) for i, (x, ok) in enumerate(zip(texts, told, strict=True))]
        for known in (self.words, self.pieces):
            if len(known) >= _LIMIT:
                known.clear()
        return [np.frombuffer(self._lower(x) if ok else self._ids(x) if x else b"", self.dtype) for x, ok in zip(texts, told, strict=True)]


def slices(batch: pa.RecordBatch, text: str = "text", most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in slices of up to 1024 rows and ``most`` bytes of text, a row at least."""
    size = pc.fill_null(pc.binary_length(batch[text]), 0).to_numpy(zero_copy_only=False)
    at = 0
    while at < batch.num_rows:
        n = int(np.searchsorted(np.cumsum(size[at : at + 1024]), most, side="right"))
        yield batch.slice(at, max(1, n))
        at += max(1, n)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder for a tokenizer file; it keeps its caches from task to task."""
    hold("tokens", _ENCODERS.clear)
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = Encoder(path)
        give_back()  # the parsed file
    return _ENCODERS[path]
