"""BPE encoding and decoding over a segment tree of adjacent pair ranks.

The leaves of a word's tree are its symbol positions; a leaf's key is (rank
of the pair that starts there, position), or none.  The root is therefore the
leftmost pair of lowest rank.  A merge rewrites three leaves (the pair, its
left neighbour, the symbol that vanished) and the paths above them, until the
root says that no pair can merge.  Words of up to ``WIDE`` bytes go through a
forest of such trees, one row per word, updated in step with numpy; a longer
word has a tree of its own.

Around the merges: special strings are cut out first, then NFC, lower case by
character, and the split into letters, single digits, other characters and
English clitics; bytes become symbols, the last with the end-of-word mark.
White space is dropped and nothing merges across it, so each white-space
unit is encoded once per worker (a bounded memo).  Decoding maps each id to
its token and joins tokens with one space, special tokens included.

Rows: one per input row; null text counts as empty (0 tokens; both digests
are those of the empty string).  Null ids and repeated rows stay as they are;
only the two named columns are read.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivener.llm.common import slices
from scrivener.llm.tokenizer_files import ship
from scrivener.llm.units import ENTRY, Memo, units

#: How the vocabulary's pre-tokenizer cuts a normalised text (a fixed value).
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
WIDE = 128
#: Bytes of a worker's memo of units; its cache of pieces holds half as much.
MEMO_BYTES = 96 << 20
NONE = np.int64(1) << 60


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where it is
    printable, else the next code point from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shifted = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(shifted)) for b in range(256)]


class BPE:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model = spec["model"]
        vocab = model["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        symbols = byte_symbols()
        self.first = np.array([vocab[s] for s in symbols], np.int64)
        self.last = np.array([vocab[s + suffix] for s in symbols], np.int64)
        pairs = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        code = np.array([(vocab[a] << 32) | vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(code, kind="stable")
        self.code, self.rank, self.made = code[order], order.astype(np.int64), made
        self.pair = {int(c): r for r, c in enumerate(code)}
        self.token = {i: t for t, i in vocab.items()}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.token.update({i: t for t, i in self.special.items()})
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.pieces: dict[bytes, tuple[int, ...]] = {}
        self.pieces_held, self.pieces_most = 0, MEMO_BYTES // 2

    # -- merges -----------------------------------------------------------
    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        code = (a << 32) | b
        i = np.minimum(np.searchsorted(self.code, code), len(self.code) - 1)
        return np.where(self.code[i] == code, self.rank[i], NONE)

    def encode_words(self, words: Sequence[bytes]) -> list[tuple[int, ...]]:
        """Ids of each (non-empty) word."""
        out: list = [None] * len(words)
        by_width: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            if len(w) > WIDE:
                out[i] = self._long(w)
            else:
                by_width.setdefault(1 << (len(w) - 1).bit_length(), []).append(i)
        for width, rows in by_width.items():
            for k in range(0, len(rows), max(1, (1 << 18) // width)):
                some = rows[k: k + max(1, (1 << 18) // width)]
                for i, ids in zip(some, self._forest([words[i] for i in some], width)):
                    out[i] = ids
        return out

    def _forest(self, words: list[bytes], width: int) -> list[tuple[int, ...]]:
        n, size = len(words), np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)
        sym = self.first[raw]
        every = np.arange(n)
        sym[every, size - 1] = self.last[raw[every, size - 1]]
        pos = np.arange(width)
        nxt = np.where(pos + 1 < size[:, None], pos + 1, -1)
        prv = np.broadcast_to(pos - 1, (n, width)).copy()
        alive = pos < size[:, None]
        tree = np.full((n, 2 * width), NONE, np.int64)
        if width > 1:
            r = self.ranks(sym[:, :-1], sym[:, 1:])
            r = np.where(nxt[:, :-1] > 0, r, NONE)
            tree[:, width:-1] = np.where(r < NONE, r * width + pos[:-1], NONE)
            for lo in [width >> s for s in range(1, width.bit_length())]:
                kids = tree[:, 2 * lo: 4 * lo]
                tree[:, lo: 2 * lo] = np.minimum(kids[:, ::2], kids[:, 1::2])
        go = every[tree[:, 1] < NONE] if width > 1 else every[:0]
        while len(go):
            root = tree[go, 1]
            rank, i = root // width, root % width
            j = nxt[go, i]
            after, before = nxt[go, j], prv[go, i]
            sym[go, i] = self.made[rank]
            alive[go, j] = False
            nxt[go, i] = after
            has = after >= 0
            prv[go[has], after[has]] = i[has]
            self._set(tree, go, j, np.full(len(go), NONE), width)
            key = self.ranks(sym[go, i], sym[go, np.maximum(after, 0)])
            self._set(tree, go, i, np.where(has & (key < NONE), key * width + i, NONE), width)
            left = before >= 0
            g, b, at = go[left], before[left], i[left]
            key = self.ranks(sym[g, b], sym[g, at])
            self._set(tree, g, b, np.where(key < NONE, key * width + b, NONE), width)
            go = go[tree[go, 1] < NONE]
        flat, ends = sym[alive], np.cumsum(alive.sum(1))
        flat = flat.tolist()
        return [tuple(flat[a:b]) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    @staticmethod
    def _set(tree, rows, leaf, key, width) -> None:
        at = leaf + width
        tree[rows, at] = key
        while width > 1:
            at = at >> 1
            tree[rows, at] = np.minimum(tree[rows, 2 * at], tree[rows, 2 * at + 1])
            width >>= 1

    def _long(self, word: bytes) -> tuple[int, ...]:
        n = len(word)
        width = 1 << (n - 1).bit_length()
        none, pair, made = int(NONE), self.pair, self.made
        sym = self.first[np.frombuffer(word, np.uint8)].tolist()
        sym[-1] = int(self.last[word[-1]])
        nxt, prv = [*range(1, n), -1], [*range(-1, n - 1)]
        tree = [none] * (2 * width)

        def key(i: int) -> int:
            r = pair.get((sym[i] << 32) | sym[nxt[i]]) if nxt[i] >= 0 else None
            return none if r is None else r * width + i

        def put(i: int, k: int) -> None:
            i += width
            tree[i] = k
            i >>= 1
            while i:
                a, b = tree[2 * i], tree[2 * i + 1]
                k = a if a < b else b
                if tree[i] == k:
                    break
                tree[i] = k
                i >>= 1

        for i in range(n):
            tree[width + i] = key(i)
        for i in range(width - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])
        while tree[1] < none:
            rank, i = divmod(tree[1], width)
            j = nxt[i]
            sym[i], sym[j], nxt[i] = int(made[rank]), -1, nxt[j]
            if nxt[i] >= 0:
                prv[nxt[i]] = i
            put(j, none)
            put(i, key(i))
            if prv[i] >= 0:
                put(prv[i], key(prv[i]))
        return tuple(s for s in sym if s >= 0)

    # -- texts ------------------------------------------------------------
    def cut_unit(self, unit: str) -> list:
        """A white-space unit as byte words and special ids."""
        out: list = []
        for part in self.cut.split(unit) if self.cut else [unit]:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                low = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
                out += [p.encode() for p in PIECE.findall(low)]
        return out

    def encode_units(self, found: Sequence[str]) -> list[list[int]]:
        cuts = [self.cut_unit(u) for u in found]
        new = list({p for c in cuts for p in c if isinstance(p, bytes) and p not in self.pieces})
        fresh = dict(zip(new, self.encode_words(new)))
        for p, ids in fresh.items():  # a cache; the rest is encoded anew in each batch
            if self.pieces_held < self.pieces_most and len(p) <= 64:
                self.pieces[p] = ids
                self.pieces_held += ENTRY + len(p) + 8 * len(ids)
        known = self.pieces
        out = []
        for c in cuts:
            ids: list[int] = []
            for p in c:
                if isinstance(p, int):
                    ids.append(p)
                else:
                    ids += known[p] if p in known else fresh[p]
            out.append(ids)
        return out

    def decode(self, ids: Sequence[int]) -> str:
        return " ".join([self.token[i] for i in ids])


_BPE: dict[tuple[int, int], tuple[BPE, Memo]] = {}


def _of(shipped, memo_bytes: int) -> tuple[BPE, Memo]:
    text = shipped.value
    if (key := (hash(text), memo_bytes)) not in _BPE:
        _BPE.clear()  # a worker keeps one
        bpe = BPE(text)
        bpe.pieces_most = memo_bytes // 2

        def both(found):
            ids = bpe.encode_units(found)
            return [(" ".join(map(str, x)), bpe.decode(x), len(x)) for x in ids]

        _BPE[key] = bpe, Memo(both, lambda v: len(v[0]) + len(v[1]) + 200, memo_bytes)
    return _BPE[key]


def encode_decode(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", memo_bytes: int = MEMO_BYTES) -> DataFrame:
    """(id, ids string of decimal ids joined by one space, n_tokens long,
    decoded string) of every row.  ``memo_bytes`` bounds what a worker keeps for
    its later tasks; it changes no row."""
    shipped = ship(df.sparkSession, tokenizer_path)
    src = df.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    id_type = src.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, memo = _of(shipped, memo_bytes)
        for batch in batches:
            for part in slices(batch, 1):
                lists = [units(t) for t in part.column(1).to_pylist()]
                get = memo.lookup(lists)
                ids, dec, n = [], [], []
                for xs in lists:
                    got = [v for u in xs if (v := get(u))[2]]
                    ids.append(" ".join([v[0] for v in got]))
                    dec.append(" ".join([v[1] for v in got]))
                    n.append(sum([v[2] for v in got]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(ids, pa.string()), pa.array(n, pa.int64()), pa.array(dec, pa.string())],
                    ["__id", "ids", "n_tokens", "decoded"])

    out = src.mapInArrow(run, f"__id {id_type}, ids string, n_tokens long, decoded string")
    return out.withColumnRenamed("__id", id_col)
