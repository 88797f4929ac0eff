"""Encoding of a corpus with a public byte-pair tokenizer, by a pair occurrence index."""

from __future__ import annotations

import base64
import heapq
import json
import os
import struct
import unicodedata
from collections.abc import Iterator
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary files are; a parameter of every operator here.
TOKENIZERS = "/opt/tokenizers"
#: Characters of text that are encoded together, and distinct words that a task remembers.
CHARS_AT_ONCE, WORDS_KEPT = 8_000_000, 400_000

# The patterns that split text before the merges.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: No piece goes on from a letter to a blank.
SPLIT_PIECES = "\u2581*[^\u2581]+|\u2581+"
SPLIT_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+"


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the JSON vocabularies: itself, or the next of those from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    extra = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(extra)) for b in range(256)]


_BLANK, _NORMAL = "\u2581", 1


def _read_pieces(path: str) -> list[tuple[str, float, int]]:
    """(text, score, kind) of each piece of a piece model: field 1 of the message, whose fields 1 to 3 they are."""

    def fields(b: bytes) -> Iterator[tuple[int, bytes | int]]:
        i = 0

        def number() -> int:
            nonlocal i
            x = shift = 0
            while True:
                c = b[i]
                i += 1
                x |= (c & 127) << shift
                shift += 7
                if c < 128:
                    return x

        while i < len(b):
            key = number()
            if key & 7 == 0:
                yield key >> 3, number()
                continue
            n = number() if key & 7 == 2 else {1: 8, 5: 4}[key & 7]
            yield key >> 3, b[i : i + n]
            i += n

    out = []
    with open(path, "rb") as f:
        for number, value in fields(f.read()):
            if number == 1:
                x = dict(fields(value))
                out.append((x[1].decode("utf-8"), struct.unpack("<f", x[2])[0] if 2 in x else 0.0, x.get(3, _NORMAL)))
    return out


class PairIndexBPE:
    """Byte-pair encoder of many words at once."""

    def __init__(self, path: str) -> None:
        pairs: dict[tuple[int, int], tuple[int, int]] = {}
        self.suffix, self.fold, self.blank = "", False, None
        pattern = SPLIT
        if path.endswith(".json"):
            with open(path, encoding="utf-8") as f:
                spec = json.load(f)
            vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
            self.suffix = spec["model"].get("end_of_word_suffix") or ""
            self.fold = spec.get("normalizer") is not None
            if self.suffix:
                pattern = SPLIT_WORDS
            letters = _byte_letters()
            self.first = np.array([vocab[c] for c in letters], np.int64)
            self.last = np.array([vocab[c + self.suffix] for c in letters], np.int64)
            for rank, m in enumerate(merges):
                a, b = m if isinstance(m, list) else m.split(" ")
                pairs.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        elif path.endswith(".tiktoken"):
            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
            self.first = self.last = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
            for word, rank in ranks.items():
                for k in range(1, len(word)):
                    a, b = ranks.get(word[:k]), ranks.get(word[k:])
                    if a is not None and b is not None:
                        pairs[a, b] = (rank, rank)
        elif path.endswith(".model"):
            pattern = SPLIT_PIECES
            pieces = _read_pieces(path)
            normal = {t: (i, score) for i, (t, score, kind) in enumerate(pieces) if kind == _NORMAL}
            # runs of blanks have one score, the lowest, and are put together last
            self.blank, self.runs = normal[_BLANK][0], {len(t): i for t, (i, _) in normal.items() if not t.strip(_BLANK)}
            self.chars = {t: [i] for t, (i, _) in normal.items() if len(t) == 1}
            self.bytes = [next(i for i, (t, _, _) in enumerate(pieces) if t == f"<0x{b:02X}>") for b in range(256)]
            ranked = sorted((-score, i, t) for t, (i, score) in normal.items() if len(t) > 1 and t.strip(_BLANK))
            for rank, (_, i, t) in enumerate(ranked):
                for k in range(1, len(t)):
                    if t[:k] in normal and t[k:] in normal:
                        pairs[normal[t[:k]][0], normal[t[k:]][0]] = (rank, i)
        else:
            raise ValueError(f"{os.path.basename(path)} is no list of pairs; .json, .tiktoken and .model files are")
        self.pattern = regex.compile(pattern)
        keys = np.array([(a << 32) | b for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.ranks = np.array([r for r, _ in pairs.values()], np.int64)[order]
        self.made = np.zeros(int(self.ranks.max()) + 1 if len(pairs) else 1, np.int64)
        for r, new in pairs.values():
            self.made[r] = new
        self.kept: dict[str, tuple[int, ...]] = {}

    def split(self, text: str) -> list[str]:
        if self.blank is not None:
            text = _BLANK + text.replace(" ", _BLANK)
        if self.fold:
            text = regex.sub(r"\s+", " ", unicodedata.normalize("NFC", text))
            text = text.lower() if "Σ" not in text else "".join(map(str.lower, text))  # no final form of sigma
        return self.pattern.findall(text)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 for pairs that never merge."""
        key = (a << 32) | b
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.ranks[at], -1)

    def words(self, words: list[str]) -> list[tuple[int, ...]]:
        """The ids of each word.

        The words' symbols lie in one array with links to their neighbours. An index maps each pair, by its
        rank, to all its positions; a heap holds the ranks that are active. The lowest rank is applied at all
        its positions at once, and the pairs that arise beside them join the lists of their ranks. A position
        whose symbols have changed since is passed over; of overlapping ones (aaa) the left one is taken.
        """
        if self.blank is None:
            data = [w.encode("utf-8", "surrogatepass") for w in words]
            size = np.array([len(d) for d in data], np.int64)
            raw = np.frombuffer(b"".join(data), np.uint8)
            sym = self.first[raw]
        else:
            data = [[i for c in w for i in self.chars.get(c) or [self.bytes[b] for b in c.encode("utf-8", "surrogatepass")]] for w in words]
            size = np.array([len(d) for d in data], np.int64)
            sym = np.array(list(chain.from_iterable(data)), np.int64)
        if not len(sym):
            return [()] * len(words)
        ends = np.cumsum(size)
        tails = ends[size > 0] - 1
        if self.blank is None:
            sym[tails] = self.last[raw[tails]]
        n = len(sym)
        nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
        nxt[tails] = -1
        prv[(ends - size)[size > 0]] = -1
        lists: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def add(left: np.ndarray) -> None:
            left = left[nxt[left] >= 0]
            rank = self._rank(sym[left], sym[nxt[left]])
            left, rank = left[rank >= 0], rank[rank >= 0]
            if not len(left):
                return
            order = np.argsort(rank, kind="stable")
            left, rank = left[order], rank[order]
            cuts = np.flatnonzero(np.diff(rank)) + 1
            heads = rank[np.concatenate(([0], cuts))].tolist()
            for r, where in zip(heads, np.split(left, cuts), strict=True):
                if r in lists:
                    lists[r].append(where)
                else:
                    lists[r] = [where]
                    heapq.heappush(active, r)

        add(np.arange(n))
        while active:
            r = heapq.heappop(active)
            found = lists.pop(r)
            at = np.unique(np.concatenate(found)) if len(found) > 1 else found[0]
            right = nxt[at]
            ok = (sym[at] >= 0) & (right >= 0)
            at, right = at[ok], right[ok]
            ok = self._rank(sym[at], sym[right]) == r
            at, right = at[ok], right[ok]
            if not len(at):
                continue
            clash = np.concatenate(([False], at[1:] == right[:-1]))
            if clash.any():
                start = np.flatnonzero(~clash)
                offset = np.arange(len(at)) - np.repeat(start, np.diff(np.append(start, len(at))))
                at, right = at[offset % 2 == 0], right[offset % 2 == 0]
            sym[at], sym[right] = self.made[r], -1
            after = nxt[right]
            nxt[at] = after
            prv[after[after >= 0]] = at[after >= 0]
            before = prv[at]
            add(np.unique(np.concatenate((before[before >= 0], at))))
        alive = sym >= 0
        ids = sym[alive].tolist()
        counts = np.concatenate(([0], np.cumsum(alive)))
        out = [tuple(ids[counts[e - s] : counts[e]]) for s, e in zip(size.tolist(), ends.tolist(), strict=True)]
        return out if self.blank is None else [self._with_runs(w) for w in out]

    def _with_runs(self, ids: tuple[int, ...]) -> tuple[int, ...]:
        """Blanks side by side put together to the runs that the vocabulary has, from the left."""
        out: list[int] = []
        for i, group in groupby(ids):
            n = len(list(group))
            out += [i] * n if i != self.blank or n == 1 else self._run(n)
        return tuple(out)

    def _run(self, n: int) -> list[int]:
        """n blanks: of all neighbours that make a run of the vocabulary the left ones are put together first."""
        size, nxt, prv = [1] * n, list(range(1, n)) + [-1], list(range(-1, n - 1))
        heap = [(i, 1, 1) for i in range(n - 1) if 2 in self.runs]
        while heap:
            i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if size[i] != a or j < 0 or size[j] != b:
                continue
            size[i], size[j] = a + b, 0
            nxt[i] = nxt[j]
            if nxt[i] >= 0:
                prv[nxt[i]] = i
                if size[i] + size[nxt[i]] in self.runs:
                    heapq.heappush(heap, (i, size[i], size[nxt[i]]))
            if prv[i] >= 0 and size[prv[i]] + size[i] in self.runs:
                heapq.heappush(heap, (prv[i], size[prv[i]], size[i]))
        return [self.runs[k] for k in size if k]

    def encode(self, texts: list[str | None]) -> list[list[str]]:
        """The words of each text, all of them known to `kept` afterwards."""
        split = [self.split(t) if t else [] for t in texts]
        if len(self.kept) > WORDS_KEPT:
            self.kept = {}
        new = list({w for s in split for w in s}.difference(self.kept))
        self.kept.update(zip(new, self.words(new), strict=True))
        return split


_loaded: dict[str, PairIndexBPE] = {}


def _encoder(path: str) -> PairIndexBPE:
    if path not in _loaded:
        _loaded[path] = PairIndexBPE(path)
    return _loaded[path]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole batches, put together or cut by rows, of about CHARS_AT_ONCE characters."""
    wait, size = [], 0
    for b in batches:
        step = max(1, min(b.num_rows, CHARS_AT_ONCE * b.num_rows // max(1, b.nbytes)))
        for i in range(0, b.num_rows, step):
            part = b.slice(i, step)
            wait.append(part)
            size += b.nbytes * part.num_rows // max(1, b.num_rows)
            if size >= CHARS_AT_ONCE:
                yield pa.Table.from_batches(wait)
                wait, size = [], 0
    if wait:
        yield pa.Table.from_batches(wait)


def encode_texts(df: DataFrame, key: str, text: str, tokenizer: str = "byte_bpe_50k.json", folder: str = TOKENIZERS, counts_only: bool = False) -> DataFrame:
    """(key, ids): the token ids of each text, without special tokens; or (key, n_tokens) with `counts_only`.

    One row for each row, null keys and repeated rows too. Null and empty texts both have an empty list (0
    tokens). White space and all characters are kept (by a tokenizer that folds case and white space: as its
    own rules say); text that looks like a special token is ordinary text. Whole texts of any length are
    encoded. `tokenizer` is a .json, .tiktoken or .model pair file in `folder`, read by each Python worker once.
    Only the two columns are read; there is no shuffle.
    """
    path = os.path.join(folder, tokenizer)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(path)
        for t in _chunks(batches):
            split = enc.encode(t.column("t").to_pylist())
            get = enc.kept.__getitem__
            each = [list(chain.from_iterable(map(get, s))) for s in split]
            sizes = np.fromiter(map(len, each), np.int32, len(each))
            k = t.column("k").combine_chunks()
            if counts_only:
                yield pa.RecordBatch.from_arrays([k, pa.array(sizes.astype(np.int64))], names=["k", "n_tokens"])
                continue
            flat = np.fromiter(chain.from_iterable(each), np.int32, int(sizes.sum()))
            ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([k, pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["k", "ids"])

    out = "n_tokens bigint" if counts_only else "ids array<int>"
    src = df.select(F.col(key).alias("k"), F.col(text).alias("t"))
    return src.mapInArrow(run, f"k {kind}, {out}").withColumnRenamed("k", key)
