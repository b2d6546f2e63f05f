"""Encoding with a public byte-level BPE vocabulary by segment trees.

A pre-token's bytes are the leaves of a segment tree.  A leaf holds the rank of
the pair that starts there together with its position, an inner node the smaller
of its two children, so the root is the leftmost pair of least rank.  A merge
changes three leaves (the pair's two ends and the live neighbour before it) and
walks up from them.  Many pre-tokens of one length class are encoded in lockstep,
a row of the arrays each, so that every step is a NumPy operation over all of
them; the few that outlast the others go on in plain Python.  Results are
remembered per distinct pre-token, at most ``MEMO`` of them.

Defined results: a null text and an empty text both have an empty list; the strings
of special tokens are ordinary text.  Rows are independent, so repeated rows repeat
their result.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: Fixed value: the pre-tokenization pattern of this family of vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Most distinct pre-tokens that a worker remembers; beyond it the memory starts anew.
MEMO = 400_000
#: Code points that are cut into pieces at once.
PORTION = 1 << 20
#: With fewer pre-tokens in work than this, plain Python is faster than arrays.
FEW = 24
_NONE = np.int64(1) << 62
_POS = 40  # bits of a position in a leaf: more bytes than a text can have; ranks have the 22 bits above


def _byte_symbols() -> dict[int, str]:
    """The printable stand-in of each byte in the vocabulary file: printable bytes stand for themselves, the others for 256, 257, ..."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Vocabulary:
    def __init__(self, path: str = DEFAULT_VOCABULARY):
        model = json.load(open(path, encoding="utf-8"))["model"]
        ids = model["vocab"]
        symbols = _byte_symbols()
        self.byte_ids = np.array([ids[symbols[b]] for b in range(256)], dtype=np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right = (np.array([ids[p[i]] for p in pairs], dtype=np.int64) for i in (0, 1))
        self.widths = np.zeros(max(ids.values()) + 1, dtype=np.int64)  # bytes of each token: a symbol stands for one
        self.widths[list(ids.values())] = [len(symbol) for symbol in ids]
        self.merged = np.array([ids[a + b] for a, b in pairs], dtype=np.int64)
        self.pairs = {(a, b): r for r, (a, b) in enumerate(zip(left.tolist(), right.tolist()))}
        # open-addressing table over left and right id, for lookups of whole arrays
        self.bits = int(len(pairs)).bit_length() + 3
        size = 1 << self.bits
        codes = (left << 20) | right
        self.slot_code = np.full(size, -1, dtype=np.int64)
        self.slot_rank = np.full(size, _NONE, dtype=np.int64)
        rest, slot, self.probes = np.arange(len(codes)), self._hash(codes), 0
        while len(rest):
            self.probes += 1
            free = self.slot_code[slot] == -1
            rest_free = rest[free][::-1]
            self.slot_code[slot[free][::-1]] = codes[rest_free]
            self.slot_rank[slot[free][::-1]] = rest_free
            lost = self.slot_code[slot] != codes[rest]
            rest, slot = rest[lost], (slot[lost] + 1) & (size - 1)

    def _hash(self, codes: np.ndarray) -> np.ndarray:
        return ((codes * np.int64(-7046029254386353131)) >> np.int64(64 - self.bits)) & np.int64((1 << self.bits) - 1)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        codes = (left << 20) | right
        slot = self._hash(codes)
        found = np.where(self.slot_code[slot] == codes, self.slot_rank[slot], _NONE)
        open_ = np.flatnonzero((self.slot_code[slot] != codes) & (self.slot_code[slot] != -1))
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & (len(self.slot_code) - 1)
            here = self.slot_code[slot[open_]]
            hit = here == codes[open_]
            found[open_[hit]] = self.slot_rank[slot[open_[hit]]]
            open_ = open_[~hit & (here != -1)]
        return found

    # one pre-token alone

    def encode_one(self, tokens: list[int]) -> list[int]:
        """The same tree for a single sequence of ids, in plain Python."""
        n = len(tokens)
        size = 1 << max(1, (n - 1).bit_length())
        pairs, merged, none = self.pairs, self.merged, int(_NONE)
        code = lambda i, a, b: none if (r := pairs.get((a, b))) is None else r << _POS | i
        tree = [none] * (2 * size)
        for i in range(n - 1):
            tree[size + i] = code(i, tokens[i], tokens[i + 1])
        for i in range(size - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        mask = (1 << _POS) - 1

        def put(i: int, value: int) -> None:
            i += size
            tree[i] = value
            while i > 1:
                i >>= 1
                low = min(tree[2 * i], tree[2 * i + 1])
                if tree[i] == low:
                    break
                tree[i] = low

        while tree[1] != none:
            i = tree[1] & mask
            tokens[i] = int(merged[tree[1] >> _POS])
            gone = nxt[i]
            after = nxt[gone]
            nxt[i] = after
            put(gone, none)
            if after < n:
                prv[after] = i
                put(i, code(i, tokens[i], tokens[after]))
            else:
                put(i, none)
            if (before := prv[i]) >= 0:
                put(before, code(before, tokens[before], tokens[i]))
        out, i = [], 0
        while i < n:
            out.append(tokens[i])
            i = nxt[i]
        return out

    # many pre-tokens in lockstep

    def _lockstep(self, words: list[bytes]) -> list[np.ndarray]:
        n = np.array([len(w) for w in words])
        size = 1 << max(1, int(n.max() - 1).bit_length())
        count = len(words)
        flat = np.frombuffer(b"".join(words), dtype=np.uint8)
        tok = np.full((count, size + 1), -1, dtype=np.int64)
        tok[:, :size][np.arange(size) < n[:, None]] = self.byte_ids[flat]
        nxt = np.tile(np.arange(1, size + 2, dtype=np.int64), (count, 1))
        prv = np.tile(np.arange(-1, size, dtype=np.int64), (count, 1))
        tree = np.full((count, 2 * size), _NONE, dtype=np.int64)
        at = np.flatnonzero((np.arange(1, size + 1) < n[:, None]).ravel())
        row, col = at // size, at % size
        first = self.ranks(tok[row, col], tok[row, col + 1])
        tree[row, size + col] = np.where(first < _NONE, first << _POS | col, _NONE)
        level = size
        while level > 1:
            level >>= 1
            np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2], out=tree[:, level : 2 * level])
        done: list = [None] * count
        rows = np.arange(count)
        t, p, x, v = tok.ravel(), prv.ravel(), nxt.ravel(), tree.ravel()
        wide, span = size + 1, 2 * size
        while True:
            root = tree[rows, 1]
            rows, root = rows[root < _NONE], root[root < _NONE]
            if len(rows) < FEW:
                break
            i, base, tbase = root & ((1 << _POS) - 1), rows * wide, rows * span
            t[base + i] = new = self.merged[root >> _POS]
            gone = x[base + i]
            after = x[base + gone]
            x[base + i] = after
            live = after < n[rows]
            p[base + np.where(live, after, size)] = i
            before = p[base + i]
            right = np.full(len(rows), _NONE)
            r = self.ranks(new[live], t[base[live] + after[live]])
            right[live] = np.where(r < _NONE, r << _POS | i[live], _NONE)
            has = before >= 0
            r = self.ranks(t[base[has] + before[has]], new[has])
            v[tbase + size + gone] = _NONE
            v[tbase + size + i] = right
            v[tbase[has] + size + before[has]] = np.where(r < _NONE, r << _POS | before[has], _NONE)
            a, b, c = size + gone, size + i, size + np.where(has, before, i)
            for _ in range(size.bit_length() - 1):
                a, b, c = a >> 1, b >> 1, c >> 1
                for node in (a, b, c):
                    v[tbase + node] = np.minimum(v[tbase + 2 * node], v[tbase + 2 * node + 1])
        for k in range(count):
            ids, i, line, step, end = [], 0, tok[k].tolist(), nxt[k].tolist(), int(n[k])
            while i < end:
                ids.append(line[i])
                i = step[i]
            done[k] = ids
        for k in rows.tolist():
            done[k] = self.encode_one(done[k])
        return done

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each pre-token, length class by length class."""
        out: list = [None] * len(words)
        classes: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            classes.setdefault(0 if len(w) == 1 else (len(w) - 1).bit_length(), []).append(k)
        for c, members in classes.items():
            chunk = max(FEW, (1 << 20) >> max(c, 1))
            for s in range(0, len(members), chunk):
                part = members[s : s + chunk]
                if c == 0 or len(part) < FEW:
                    got = [self.encode_one(self.byte_ids[np.frombuffer(words[k], np.uint8)].tolist()) if len(words[k]) > 1 else [int(self.byte_ids[words[k][0]])] for k in part]
                else:
                    got = self._lockstep([words[k] for k in part])
                for k, ids in zip(part, got):
                    out[k] = ids
        return out


class _Memo:
    """Ids of distinct keys in a ragged store."""

    def __init__(self):
        self.place: dict = {}
        self.values, self.starts, self.sizes = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, keys: list, values: np.ndarray, sizes: np.ndarray) -> None:
        starts = len(self.values) + np.cumsum(sizes) - sizes
        self.place.update(zip(keys, range(len(self.place), len(self.place) + len(keys))))
        self.values, self.starts, self.sizes = np.concatenate((self.values, values)), np.concatenate((self.starts, starts)), np.concatenate((self.sizes, sizes))

    def gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(before, values)``: ids of the keys at these places in a row and the number of ids before each."""
        sizes = self.sizes[at]
        before = np.concatenate(([0], np.cumsum(sizes)))
        return before, self.values[np.arange(before[-1]) + np.repeat(self.starts[at] - before[:-1], sizes)]


class Encoder:
    """Encodes batches of texts and remembers what it has seen.

    A blank before something that is no white space always starts a pre-token, so a
    text is first cut there, which needs no pattern unless white space runs; the
    pattern is applied to distinct pieces only.
    """

    _shared: dict[str, Encoder] = {}

    def __init__(self, path: str):
        self.vocabulary, self.split = Vocabulary(path), regex.compile(PATTERN).findall
        self.runs, self.cut = re.compile(r"\s \s|  ").search, re.compile(r" (?=\S)").split
        self.tokens, self.pieces = _Memo(), _Memo()

    @classmethod
    def of(cls, path: str) -> Encoder:
        """One encoder for each worker process and vocabulary."""
        if path not in cls._shared:
            cls._shared[path] = cls(path)
        return cls._shared[path]

    def _learn(self, pieces: list) -> None:
        """Pieces are cut off after a blank, which belongs to them; a text's first piece, in a tuple, has none."""
        words: list[str] = []
        ends = [0]
        for piece in pieces:
            words += self.split(piece[0] if type(piece) is tuple else " " + piece)
            ends.append(len(words))
        if len(self.tokens.place) > MEMO:
            self.tokens = _Memo()
        fresh = [w for w in dict.fromkeys(words) if w not in self.tokens.place]
        if fresh:
            got = self.vocabulary.encode_words([w.encode("utf-8", "surrogatepass") for w in fresh])
            sizes = np.array([len(g) for g in got], dtype=np.int64)
            self.tokens.add(fresh, np.fromiter(chain.from_iterable(got), dtype=np.int32, count=int(sizes.sum())), sizes)
        before, ids = self.tokens.gather(np.fromiter(map(self.tokens.place.__getitem__, words), dtype=np.int64, count=len(words)))
        self.pieces.add(pieces, ids, np.diff(before[np.array(ends)]))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """``(offsets, ids)`` of the texts, taken in portions of about ``PORTION`` code points so that a batch of any size needs little memory."""
        offsets, values, held, at = [np.zeros(1, np.int64)], [], 0, 0
        for end, text in enumerate(texts, 1):
            held += len(text) if text else 0
            if held >= PORTION or end == len(texts):
                more, ids = self._portion(texts[at:end])
                offsets.append(offsets[-1][-1] + more[1:])
                values.append(ids)
                held, at = 0, end
        return np.concatenate(offsets), np.concatenate(values) if values else np.empty(0, np.int32)

    def sizes(self, text: str) -> np.ndarray:
        """For each code point of ``text`` the number of tokens that begin in it."""
        _, ids = self.encode([text])
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        ends = np.cumsum(1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF))
        begins = np.cumsum(self.vocabulary.widths[ids]) - self.vocabulary.widths[ids]
        return np.bincount(np.searchsorted(ends, begins, side="right"), minlength=len(codes))

    def _portion(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.pieces.place) > MEMO:
            self.pieces = _Memo()
        keys: list = []
        ends = [0]
        for text in texts:
            if text:
                pieces = self.cut(text) if self.runs(text) else text.split(" ")
                pieces[0] = (pieces[0],)
                keys += pieces
            ends.append(len(keys))
        at = list(map(self.pieces.place.get, keys))
        if None in at:
            self._learn(list(dict.fromkeys(k for k, i in zip(keys, at) if i is None)))
            at = list(map(self.pieces.place.__getitem__, keys))
        before, ids = self.pieces.gather(np.array(at, dtype=np.int64))
        return before[np.array(ends)], ids


def encode_column(df: DataFrame, key: str, text: str, path: str = DEFAULT_VOCABULARY, out: str = "ids") -> DataFrame:
    """``(key, out)``: the ids of ``text`` of every row."""
    schema = StructType([df.schema[key], StructField(out, ArrayType(IntegerType()), True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path)
        for b in batches:
            offsets, ids = encoder.encode(b.column(1).to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], names=[key, out])

    return df.select(key, text).mapInArrow(run, schema)


def count_column(df: DataFrame, keys: list[str], text: str, path: str = DEFAULT_VOCABULARY, out: str = "n_tokens") -> DataFrame:
    """``(*keys, out)``: the number of ids of ``text`` of every row."""
    from pyspark.sql.types import LongType

    schema = StructType([df.schema[k] for k in keys] + [StructField(out, LongType(), True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path)
        for b in batches:
            offsets, _ = encoder.encode(b.column(b.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(np.diff(offsets))], names=[*keys, out])

    return df.select(*keys, text).mapInArrow(run, schema)
