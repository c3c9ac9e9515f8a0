"""Language identification with hyperdimensional profiles.

Every character has a random +-1 vector of ``DIM`` components, made from its
code point.  A 3-gram is bound as rho(rho(a)) * rho(b) * c, where rho rotates
a vector by one place and * is by component; a text's vector is the bundle
(sum) of its 3-grams.  A language's prototype is the bundle of the 3-grams of
all its training texts, and a text gets the language whose prototype has the
largest cosine with its vector.

Texts are lower-cased; a run of anything but letters is one blank, and a text
starts and ends with one.  Training reads the text and the label of all rows
that are not held out and have a label; prediction reads the text alone.

Rows: one per input row.  A null text or one without letters is ``und`` with
score 0, as is everything when no row can be learned from.  Equal cosines go
to the smaller label.  Null ids count as not held out; repeated rows stay (and
train) as they are.  Prototypes are sums of whole numbers, so reruns and other
partitionings give the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrivener.llm.common import slices

DIM = 1024
#: Labels are names of languages; a column with more is refused, since the
#: prototypes (8 KB each) are broadcast.
MAX_LANGUAGES = 2_000
BLANK = 32
_BLOCK = 1 << 20

_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def _symbols(text: str) -> Iterator[np.ndarray]:
    """Code points of letters with single blanks between, in blocks that each
    repeat the last two symbols of the block before."""
    letter, carry = _letters(), np.array([BLANK], np.int64)
    for at in range(0, len(text), _BLOCK):
        cp = np.frombuffer(text[at: at + _BLOCK].lower().encode("utf-32-le"), "<u4").astype(np.int64)
        cp = np.concatenate([carry, np.where(letter[cp], cp, BLANK)])
        cp = cp[np.append(True, (cp[1:] != BLANK) | (cp[:-1] != BLANK))]
        if at + _BLOCK >= len(text) and cp[-1] != BLANK:
            cp = np.append(cp, BLANK)
        if len(cp) > 2:
            yield cp
        carry = cp[-2:]


def letter_vectors(cps: np.ndarray) -> np.ndarray:
    """Random bits (n, DIM), a function of the code point (SplitMix64)."""
    with np.errstate(over="ignore"):
        x = cps.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(1, DIM // 64 + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return np.unpackbits(np.ascontiguousarray(x).view(np.uint8).reshape(len(cps), -1), axis=1)


def _bind(grams: np.ndarray) -> np.ndarray:
    """+-1 vectors of packed 3-grams; a product of signs is an xor of bits."""
    a, b, c = grams >> 42, (grams >> 21) & 0x1FFFFF, grams & 0x1FFFFF
    cps, inv = np.unique(np.concatenate([a, b, c]), return_inverse=True)
    base, n = letter_vectors(cps), len(grams)
    once, twice = np.roll(base, 1, axis=1), np.roll(base, 2, axis=1)
    bits = twice[inv[:n]] ^ once[inv[n: 2 * n]] ^ base[inv[2 * n:]]
    return 1.0 - 2.0 * bits.astype(np.float32)


def _blocks(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(kinds, kind of each 3-gram, text of each 3-gram), about _BLOCK 3-grams at a time."""
    parts: list[np.ndarray] = []
    owner: list[int] = []
    held = 0
    for i, t in enumerate(texts):
        for cp in _symbols(t or ""):
            parts.append(cp)
            owner.append(i)
            held += len(cp)
            if held >= _BLOCK:
                yield _kinds(parts, owner)
                parts, owner, held = [], [], 0
    if parts:
        yield _kinds(parts, owner)


def _kinds(parts: list[np.ndarray], owner: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    cps = np.concatenate(parts)
    used = np.flatnonzero(np.bincount(cps))
    small = np.zeros(used[-1] + 1, np.int64)
    small[used] = np.arange(len(used))
    n = len(used)
    grams = np.concatenate([(q[:-2] * n + q[1:-1]) * n + q[2:] for q in (small[p] for p in parts)])
    if n ** 3 <= 1 << 22:  # few characters: number the kinds by a table, without a sort
        kinds = np.flatnonzero(np.bincount(grams, minlength=1))
        number = np.zeros(n ** 3, np.int64)
        number[kinds] = np.arange(len(kinds))
        inv = number[grams]
    else:
        kinds, inv = np.unique(grams, return_inverse=True)
    kinds = (used[kinds // (n * n)] << 42) | (used[kinds // n % n] << 21) | used[kinds % n]
    return kinds, inv, np.repeat(owner, [len(p) - 2 for p in parts])


def text_vectors(texts: list[str | None]) -> np.ndarray:
    """(n, DIM) bundles of the 3-grams of each text; all zero without letters."""
    out = np.zeros((len(texts), DIM), np.float64)
    step = 8192
    for kinds, inv, owner in _blocks(texts):
        rows, row = np.unique(owner, return_inverse=True)
        for lo in range(0, len(kinds), step):
            some = kinds[lo: lo + step]
            pick = slice(None) if len(kinds) <= step else np.flatnonzero((inv >= lo) & (inv < lo + step))
            counts = np.bincount(row[pick] * len(some) + (inv[pick] - lo), minlength=len(rows) * len(some))
            out[rows] += counts.reshape(len(rows), len(some)).astype(np.float32) @ _bind(some)
    return out


def _unit(v: np.ndarray) -> np.ndarray:
    norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)


def held_out(id_col: Column) -> Column:
    """crc32 of the id as text leaves 2 when divided by 4 (null: empty text)."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def train(df: DataFrame, text_col: str = "text", label_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """(labels in order, unit prototypes) from all rows of ``df`` with a label.

    A prototype is the sum over kinds of 3-grams of count * vector: the counts
    are summed per (label, kind) first, the vectors of kinds after that."""
    src = df.select(F.col(text_col).alias("text"), F.col(label_col).cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def merged(found):
            kinds, inv = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
            return kinds, np.bincount(inv, np.concatenate([c for _, c in found]), len(kinds)).astype(np.int64)

        def flush():
            for name, found in held.items():
                kinds, n = merged(found)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(kinds), pa.string()), pa.array(kinds), pa.array(n)], ["lang", "gram", "n"])
            held.clear()

        for batch in batches:
            for part in slices(batch, 0, 1 << 20):
                names = part.column(1).to_pylist()
                labels = sorted(set(names))
                number = {x: k for k, x in enumerate(labels)}
                of = np.array([number[x] for x in names])
                for kinds, inv, owner in _blocks(part.column(0).to_pylist()):
                    counts = np.bincount(of[owner] * len(kinds) + inv, minlength=len(labels) * len(kinds)).reshape(len(labels), -1)
                    for k, name in enumerate(labels):
                        some = np.flatnonzero(counts[k])
                        held.setdefault(name, []).append((kinds[some], counts[k, some]))
                        size += len(some)
                if size > 1 << 20:
                    held.update({name: [merged(found)] for name, found in held.items()})
                    size = sum(len(found[0][0]) for found in held.values())
                    if size > 1 << 19:
                        yield from flush()
                        size = 0
        yield from flush()

    counts = src.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.int64()))], ["lang", "vec"])
            sums.clear()
            return out

        for batch in batches:
            names, kinds, n = batch.column(0).to_pylist(), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            by: dict[str, list[int]] = {}
            for k, x in enumerate(names):
                by.setdefault(x, []).append(k)
            for name, rows in by.items():
                for lo in range(0, len(rows), 4096):
                    some = rows[lo: lo + 4096]
                    vec = n[some] @ _bind(kinds[some]).astype(np.int64)
                    sums[name] = sums[name] + vec if name in sums else vec
                if len(sums) > 256:
                    yield flush()
        if sums:
            yield flush()

    partial = counts.mapInArrow(bundle, "lang string, vec array<long>")
    sums = partial.select("lang", F.posexplode("vec")).groupBy("lang", "pos").agg(F.sum("col").alias("v"))
    found = sums.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("pos", "v"))).alias("vec"))  # DIM entries a label
    rows = found.limit(MAX_LANGUAGES + 1).collect()
    if len(rows) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} labels in {label_col}")
    rows.sort(key=lambda r: r["lang"].encode())
    proto = _unit(np.array([[x["v"] for x in r["vec"]] for r in rows], np.float64).reshape(len(rows), DIM))
    known = [i for i in range(len(rows)) if proto[i].any()]
    return [rows[i]["lang"] for i in known], proto[known]


def predict(df: DataFrame, model: tuple[list[str], np.ndarray], row: Column, text_col: str = "text") -> DataFrame:
    """(row, lang_pred, score) of every row; ``row`` is what to carry along.
    Only the text crosses to Python; ``row`` stays where it is."""
    labels, proto = model
    shipped = df.sparkSession.sparkContext.broadcast((labels, proto))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names, protos = shipped.value
        for texts in batches:
            langs, scores = [], []
            for part in slices(pa.RecordBatch.from_arrays([texts], ["text"]), 0, 1 << 19):
                vecs = _unit(text_vectors(part.column(0).to_pylist()))
                lang, score = ["und"] * part.num_rows, np.zeros(part.num_rows)
                if names:
                    # Rounded, so that the order in which components are added cannot decide a tie.
                    cos = np.round(vecs @ protos.T, 9)
                    best, seen = cos.argmax(axis=1), vecs.any(axis=1)
                    lang = [names[b] if s else "und" for b, s in zip(best, seen)]
                    score = np.where(seen, np.clip(cos[np.arange(len(best)), best], 0.0, 1.0), 0.0)
                langs += lang
                scores.append(score)
            scores = pa.array(np.concatenate(scores) if scores else np.zeros(0), pa.float64())
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), scores], ["lang_pred", "score"])

    # Not deterministic, as far as the planner goes: a filter on the result must not run it again.
    found = F.arrow_udf(run, "lang_pred string, score double").asNondeterministic()
    out = df.select(row.alias("row"), found(F.col(text_col)).alias("__found"))
    return out.select("row", "__found.lang_pred", "__found.score")


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """(id, held_out, lang_pred, score): learns from the rows that are not held
    out and predicts every row."""
    model = train(df.where(~held_out(F.col(id_col))), text_col, label_col)
    out = predict(df, model, F.col(id_col), text_col).withColumnRenamed("row", id_col)
    return out.select(id_col, held_out(F.col(id_col)).alias("held_out"), "lang_pred", "score")
