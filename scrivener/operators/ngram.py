"""Generation without external weights (G1/G2, the "logits" of N4): an n-gram
language model trained by aggregation, and decoding over a candidate lattice.

* **Model** - interpolated Kneser-Ney bigrams per group (``lang``): pair counts
  of each line with its start and end, followers per word, and the number of
  different words before a word.  Costs are whole thousandths of a nat
  (-1000 ln p), so that sums and comparisons are exact on any engine.
* **Lattice** - a word's options are itself and its likely corrections (a
  candidate at distance d must be seen ratio**d times as often); an option costs
  ``edit_cost`` per edit, or what a learned error model says.
* **Islands** - most words have no option but themselves.  Under a bigram model
  they cut a line into independent parts: a maximal run of words with options
  and the word on either side is an *island*, and the best path through a line is
  the best path through each of its islands.  Only the words with options leave
  their line, and only distinct islands are decoded.
* **Costs** - bigrams are looked up by joins on the distinct pairs of options
  that occur in distinct islands, and gathered into one cost matrix per
  distinct pair of neighbouring words.
* **Decoding** - temperature 0: the path of least cost (Viterbi; of equal costs
  the alphabetically first).  Else a word after word draw with probability
  proportional to exp(-cost / T) among the ``top_k`` best options, given the word
  drawn before; the noise is hashed from seed, island, place and option, so a
  rerun draws the same.

Texts are cut into words, and words put in place, in Arrow batches; all else is
expressions, joins and aggregates.  A
hot word is collapsed by map-side aggregation; a hot island or pair is one row
on the side that holds its result, and AQE splits the other side.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from scrivener.operators.counts import pair_counts, spaced, word_bits, words_in_place
from scrivener.operators.generate import _package_by_value
from scrivener.operators.joins import bounded_broadcast, materialize
from scrivener.operators.lexicon import (
    DEFAULT_RATIO,
    NON_WORD_PATTERN,
    WORD_PATTERN,
    build_lexicon,
    candidates,
)

START, END = "<s>", "</s>"
# Taken from every count of a pair and given to the words that a word lacks.
DISCOUNT = 0.75
# The cost of an edit, in thousandths of a nat: 1000 ln 20, so that without
# context a correction wins where the ratio rule says so.
EDIT_COST = 2996
TOP_K = 40


@dataclass
class Bigrams:
    """The trained counts, as stored tables.

    ``pairs`` (by..., u, w, c), ``left`` (by..., u, c_u, followers), ``right``
    (by..., w, before: how many different words stand before w), ``total``
    (by..., types: pairs, size: words)."""

    pairs: DataFrame
    left: DataFrame
    right: DataFrame
    total: DataFrame
    by: tuple[str, ...]


def line_words(text: Column) -> Column:
    """The words of a line in order, lower-cased one by one."""
    return F.transform(F.regexp_extract_all(text, F.lit(WORD_PATTERN), F.lit(0)), F.lower)


def spaced_words(text: Column) -> Column:
    """``line_words`` as one text for ``operators.counts``.  All signs become spaces before a
    text beyond ASCII is lower-cased, so each word is lower-cased by itself."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.lower(F.regexp_replace(text, NON_WORD_PATTERN, " ")))


def train_bigrams(df: DataFrame, text_col: str = "text", by=("lang",)) -> Bigrams:
    """Count all pairs of neighbouring words, line starts and ends included.
    Lines without words count nowhere."""
    pairs = materialize(pair_counts(df, spaced_words(F.col(text_col)), by, (START, END), ("u", "w", "c")))
    left = materialize(pairs.groupBy(*by, "u").agg(F.sum("c").alias("c_u"), F.count(F.lit(1)).alias("followers")))
    right = materialize(pairs.groupBy(*by, "w").agg(F.count(F.lit(1)).alias("before")))
    total = materialize(right.groupBy(*by).agg(F.sum("before").alias("types"), F.count(F.lit(1)).alias("size")))
    return Bigrams(pairs, left, right, total, tuple(by))


def bigram_costs(model: Bigrams, need: DataFrame, discount: float = DISCOUNT) -> DataFrame:
    """(by..., u, w, cost long) of the distinct pairs ``need``; pairs and words
    that were never seen have a cost too."""
    by = list(model.by)
    if by:
        j = need.join(model.total, by, "left")
    else:  # one group: its two totals are one row
        one = model.total.first()
        j = need.withColumn("types", F.lit(one["types"] if one else None).cast("long")).withColumn("size", F.lit(one["size"] if one else None).cast("long"))
    j = j.join(model.pairs, [*by, "u", "w"], "left").join(model.left, [*by, "u"], "left").join(model.right, [*by, "w"], "left")
    return j.select(*by, "u", "w", _cost(discount).alias("cost"))


def _cost(discount: float = DISCOUNT) -> Column:
    """From the counts c (of the pair), c_u and followers, before, types and size; those never seen are null."""
    least = (F.coalesce("before", F.lit(0)) + 1) / (F.coalesce("types", F.lit(0)) + F.coalesce("size", F.lit(1)))
    seen = F.greatest(F.coalesce("c", F.lit(0)) - F.lit(float(discount)), F.lit(0.0)) + F.lit(float(discount)) * F.col("followers") * least
    p = F.when(F.col("c_u").isNull(), least).otherwise(seen / F.col("c_u"))
    return F.round(-1000 * F.log(p)).cast("long")


def _hashed(df: DataFrame, columns) -> DataFrame:
    """``df`` with a hash of ``columns``, to join on before them: rows are then sorted by
    whole numbers, not by texts that begin alike."""
    return df.withColumn("_h", F.xxhash64(*columns))


def lattice_options(cands: DataFrame, edit_cost: int = EDIT_COST, by=("lang",)) -> DataFrame:
    """(by..., word, cand, emit): the options of each word that has any beside
    itself.  ``cands`` holds (by..., word, cand, dist), or ``emit`` in place of
    ``dist`` where an error model gives the costs."""
    emit = F.col("emit").cast("long") if "emit" in cands.columns else (F.col("dist") * edit_cost).cast("long")
    own = cands.select(*by, "word").distinct()
    return cands.select(*by, "word", "cand", emit.alias("emit")).union(own.select(*by, "word", F.col("word").alias("cand"), F.lit(0).cast("long").alias("emit")))


def find_islands(df: DataFrame, options: DataFrame, text_col: str = "text", key_cols=("doc_id", "line_no"), by=("lang",),
                 max_tokens: int | None = None) -> DataFrame:
    """(key..., by..., start, island): the runs of words with options, with the
    word before and after (or the line's start or end), as an array.  Words from
    ``max_tokens`` on have no options."""
    keys = list(key_cols)
    # Words with options, one row each: broadcast when proven small.  Few other words leave the worker.
    some = materialize(options.select(*by, "word").distinct())
    toks = words_in_place(df, spaced_words(F.col(text_col)), [*keys, *by], (START, END), max_tokens, word_bits(some, "word"))
    hits = _hashed(toks, [*by, "word"]).join(bounded_broadcast(_hashed(some, [*by, "word"])), ["_h", *by, "word"])
    inside = Window.partitionBy(*keys).orderBy("pos")  # a line's own words
    runs = hits.withColumn("run", F.col("pos") - F.row_number().over(inside)).groupBy(*keys, *by, "run").agg(
        F.sort_array(F.collect_list(F.struct("pos", "word"))).alias("l"), F.min(F.struct("pos", "prev")).alias("a"), F.max(F.struct("pos", "next")).alias("z"))
    island = F.concat(F.array("a.prev"), F.transform("l", lambda x: x["word"]), F.array("z.next"))
    return runs.select(*keys, *by, F.col("a.pos").alias("start"), island.alias("island"))


def _word_facts(options: DataFrame, model: Bigrams) -> DataFrame:
    """(by..., word, and as a word before or after another: ``us`` and ``vs``, its options in
    order of emit and cand; ``own_u`` and ``own_v``, the word alone).  An option has what
    its costs need of the counts.  Only words that are seen or have options are there."""
    by, word = list(model.by), [*model.by, "word"]
    left, right = model.left.withColumnRenamed("u", "word"), model.right.withColumnRenamed("w", "word")
    facts = _hashed(left, word).join(_hashed(right, word), ["_h", *word], "full").drop("_h")
    of_cand = _hashed(facts.withColumnRenamed("word", "cand"), [*by, "cand"])
    known = _hashed(options, [*by, "cand"]).join(of_cand, ["_h", *by, "cand"], "left")
    listed = known.groupBy(*word).agg(F.sort_array(F.collect_list(F.struct("emit", "cand", "c_u", "followers", "before"))).alias("opts"))
    return materialize(_hashed(facts, word).join(_hashed(listed, word), ["_h", *word], "full"))


def _pair_matrices(pairs: DataFrame, options: DataFrame, model: Bigrams) -> DataFrame:
    """Per numbered pair (``pid``, by..., u, free_u, v, free_v) of neighbouring words the array
    ``step`` of v's options: (i, cand, emit, costs after each option of u, in u's order)."""
    by = list(model.by)
    facts = _word_facts(options, model)

    def side(x: str) -> DataFrame:
        return facts.select("_h", *by, F.col("word").alias(x), F.struct("opts", "c_u", "followers", "before").alias(f"of_{x}"))

    def listed(x: str) -> Column:
        of = F.col(f"of_{x}")
        own = F.array(F.struct(F.lit(0).cast("long").alias("emit"), F.col(x).alias("cand"), of["c_u"].alias("c_u"), of["followers"].alias("followers"), of["before"].alias("before")))
        return F.when(F.col(f"free_{x}") & of["opts"].isNotNull(), of["opts"]).otherwise(own)

    both = _hashed(pairs, [*by, "u"]).join(side("u"), ["_h", *by, "u"], "left")
    both = _hashed(both, [*by, "v"]).join(side("v"), ["_h", *by, "v"], "left")
    both = both.select("pid", *by, listed("u").alias("us"), listed("v").alias("vs"))
    if by:
        both = both.join(model.total, by, "left")
    else:  # one group: its two totals are one row
        one = model.total.first()
        both = both.withColumn("types", F.lit(one["types"] if one else None).cast("long")).withColumn("size", F.lit(one["size"] if one else None).cast("long"))
    each = both.select("pid", *by, "types", "size", "vs", F.posexplode("us").alias("j", "a")).select("pid", *by, "types", "size", "j", "a", F.posexplode("vs").alias("i", "b"))
    each = each.select("pid", *by, "types", "size", "i", "j", F.col("a.cand").alias("u"), F.col("b.cand").alias("w"), "b.emit", "a.c_u", "a.followers", "b.before")
    word = [*by, "u", "w"]
    rows = _hashed(each, word).join(_hashed(model.pairs, word), ["_h", *word], "left").select("pid", F.struct("i", "j", _cost().alias("cost"), "emit", F.col("w").alias("cand")).alias("r"))
    made = rows.groupBy("pid").agg(F.sort_array(F.collect_list("r")).alias("l"), (F.max("r.j") + 1).alias("width"))
    at = F.sequence(F.lit(0), (F.size("l") / F.col("width")).cast("int") - 1)
    return made.select("pid", F.transform(at, lambda i: F.struct(
        i.alias("i"), F.get("l", i * F.col("width"))["cand"].alias("cand"), F.get("l", i * F.col("width"))["emit"].alias("emit"),
        F.transform(F.slice("l", i * F.col("width") + 1, F.col("width")), lambda x: x["cost"]).alias("costs"))).alias("step"))


def _best_path(steps: Column) -> Column:
    """The words of the path of least cost; the last word is the island's end."""
    none = F.array(F.struct(F.lit(0).cast("long").alias("cost"), F.array().cast("array<string>").alias("path")))
    ends = F.aggregate(steps, none, lambda state, s: F.transform(s["step"], lambda c: F.array_min(F.transform(state, lambda t, j: F.struct(
        (t["cost"] + c["emit"] + F.get(c["costs"], j)).alias("cost"), F.concat(t["path"], F.array(c["cand"])).alias("path"))))))
    return F.get(ends, F.lit(0))["path"]


def _drawn_path(steps: Column, name: Column, temperature: float, top_k: int, seed: int) -> Column:
    """The words drawn one after the other, the island's end last."""

    def noise(place, cand):
        h = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), name, place.cast("string"), cand)), 1, 13), 16, 10).cast("long")
        return -F.log(-F.log((h.cast("double") + 0.5) / float(1 << 52)))

    def draw(state, s):
        ranked = F.slice(F.sort_array(F.transform(s["step"], lambda c: F.struct(
            (c["emit"] + F.get(c["costs"], state["j"])).alias("cost"), c["cand"].alias("cand"), c["i"].alias("j")))), 1, top_k)
        keyed = F.transform(ranked, lambda c: F.struct((-c["cost"].cast("double") / F.lit(1000.0 * temperature) + noise(s["n"], c["cand"])).alias("key"), c["cand"].alias("cand"), c["j"].alias("j")))
        return F.transform(F.array(F.array_max(keyed)), lambda m: F.struct(m["j"].alias("j"), F.concat(state["path"], F.array(m["cand"])).alias("path")))[0]

    none = F.struct(F.lit(0).alias("j"), F.array().cast("array<string>").alias("path"))
    return F.aggregate(steps, none, draw)["path"]


def decode_islands(islands: DataFrame, options: DataFrame, model: Bigrams, temperature: float = 0.0, top_k: int = TOP_K, seed: int = 0) -> DataFrame:
    """(by..., island, words): the generated words of each distinct island, the
    words on either side left out."""
    by = list(model.by)
    pair = [*by, "u", "free_u", "v", "free_v"]
    # Islands and pairs are numbered in stored tables: what is gathered for them is gathered by number.
    distinct = materialize(islands.select(*by, "island").distinct().withColumn("iid", F.monotonically_increasing_id()))
    n = F.size("island")
    at = F.explode(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.struct(
        i.alias("n"), F.get("island", i - 1).alias("u"), (i > 1).alias("free_u"), F.get("island", i).alias("v"), (i < n - 1).alias("free_v"))))
    places = _hashed(distinct.select("iid", *by, at.alias("p")).select("iid", *by, "p.*"), pair)
    pairs = materialize(places.select("_h", *pair).distinct().withColumn("pid", F.monotonically_increasing_id()))
    matrices = _pair_matrices(pairs.drop("_h"), options, model)
    steps = places.join(pairs, ["_h", *pair]).select("iid", "n", "pid").join(matrices, "pid")
    steps = steps.groupBy("iid").agg(F.sort_array(F.collect_list(F.struct("n", "step"))).alias("steps")).join(distinct, "iid")
    if temperature == 0:
        path = _best_path(F.col("steps"))
    else:
        path = _drawn_path(F.col("steps"), F.concat_ws("|", *[F.col(b).cast("string") for b in by], F.array_join("island", " ")), temperature, top_k, seed)
    return steps.select(*by, "island", path.alias("path")).select(*by, "island", F.slice("path", 1, F.size("path") - 1).alias("words"))


def rewrite_words(df: DataFrame, changes: DataFrame, text_col: str, key_cols, out: str) -> DataFrame:
    """(key..., out): every line with the words ``changes`` (key..., pos, word)
    put in place; all else stays as it is."""
    keys = list(key_cols)
    # Keys that repeat end in an error here.
    per_line = changes.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("pos", "word"))).alias("_fix"))
    text = F.col(text_col)
    # Signs beyond ASCII are told from letters in the JVM; the worker gets a space for each.
    signs = F.when(F.col("_fix").isNotNull() & (F.octet_length(text) != F.char_length(text)), spaced(text))
    j = df.select(*keys, text_col).join(per_line, keys, "left").select(
        *[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], text.alias("text"), signs.alias("signs"), F.map_keys("_fix").alias("at"), F.map_values("_fix").alias("words"))
    schema = StructType([*j.schema.fields[:len(keys)], StructField("out", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [_put(*row) for row in zip(*[batch.column(c).to_pylist() for c in ("text", "signs", "at", "words")])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(keys)], pa.array(made, pa.string())], names=schema.names)

    with _package_by_value():
        done = j.mapInArrow(run, schema)
    return done.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], F.col("out").alias(out))


# ASCII letters, and what is left of other characters when their signs are spaces.
_LETTERS = re.compile("[A-Za-z\x80-\U0010ffff]+")


def _put(text: str | None, signs: str | None, at: list | None, words: list | None) -> str | None:
    """``text`` with the words at the places ``at`` (of its words) replaced; ``signs`` is the text
    with a space for each sign beyond ASCII, or None where it has none."""
    if text is None or not at:
        return text
    new, last, done, parts = dict(zip(at, words)), max(at), 0, []
    for k, m in enumerate(_LETTERS.finditer(text if signs is None else signs)):
        if k in new:
            parts += (text[done:m.start()], new[k])
            done = m.end()
        if k == last:
            break
    return "".join([*parts, text[done:]])


def generate_ngram(df: DataFrame, text_col: str = "text", key_cols=("doc_id", "line_no"), by=("lang",), reference: DataFrame | None = None, ref_col: str | None = None,
                   cands: DataFrame | None = None, temperature: float = 0.0, top_k: int = TOP_K, max_tokens: int | None = None, seed: int = 0, ratio: float = DEFAULT_RATIO,
                   edit_cost: int = EDIT_COST, out: str = "raw_output") -> DataFrame:
    """(key..., out): every line as the model generates it from what was typed.

    Model and candidates are trained on ``reference``, or on the lines
    themselves; ``cands`` (by..., word, cand and dist or emit) replaces the
    candidates.  ``max_tokens``: how many words of a line are generated; the
    words after them are copied.  Generated words that differ are in lower case.
    Keys must be unique and not null."""
    if temperature < 0 or top_k < 1 or (max_tokens is not None and max_tokens < 0):
        raise ValueError("temperature must be at least 0, top_k at least 1, max_tokens at least 0")
    corpus, col = (df, text_col) if reference is None else (reference, ref_col or text_col)
    model = train_bigrams(corpus, col, by)
    if cands is None:
        counts = materialize(build_lexicon(corpus, col, by))
        words = counts if reference is None else materialize(build_lexicon(df, text_col, by))
        own = counts.select(*by, "word", F.col("freq").alias("own"))
        if reference is not None:
            own = words.select(*by, "word").join(own, [*by, "word"], "left").select(*by, "word", F.coalesce("own", F.lit(0)).alias("own"))
        cands = candidates(own, counts.where(F.col("freq") >= ratio), by, ratio)
    options = materialize(lattice_options(cands, edit_cost, by))
    islands = materialize(find_islands(df, options, text_col, key_cols, by, max_tokens))
    decoded = materialize(decode_islands(islands, options, model, temperature, top_k, seed))
    back = _hashed(islands, [*by, "island"]).join(_hashed(decoded, [*by, "island"]), ["_h", *by, "island"])
    word = F.posexplode(F.arrays_zip(F.slice("island", 2, F.size("words")).alias("typed"), F.col("words").alias("word")))
    changes = back.select(*key_cols, "start", word.alias("k", "w")).where("w.typed <> w.word").select(*key_cols, (F.col("start") + F.col("k")).alias("pos"), "w.word")
    return rewrite_words(df, changes, text_col, key_cols, out)
