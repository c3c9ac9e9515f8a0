"""A learned error model for N4: which letters are taken for which.

The plain score counts edits.  Here each edit has a cost of its own, learned from
the misspelled words without knowing what was meant (after Kernighan, Church and
Gale, 1990):

* **Alignment** - a word and a candidate that share a one-deletion variant differ
  by one edit, or by a letter that moved (one lost, one put in).  An edit is
  (was, typed): ``ab > a`` a letter lost after another, ``a > ab`` one put in, ``a > b``
  one for another, ``ab > ba`` two swapped; ``^`` stands for the start of a word.
* **Chances** - how often ``was`` stands in the text: letters and pairs of letters of
  the lexicon, weighted by the words' counts.
* **EM** - a fixed number of rounds over stored tables.  Each word shares its count
  among its candidates in proportion to freq * exp(-cost); the shares add up to
  new counts of edits, and these to new costs.  Counts are whole thousandths and
  costs whole thousandths of a nat, so any engine computes the same.

Only distinct words and edits are touched.  The edits of an alphabet are few: their
table is broadcast when proven small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrivener.operators.joins import bounded_broadcast, materialize

ROUNDS = 3
# The cost of an edit before anything is learned, in thousandths of a nat (1000 ln 20).
FIRST_COST = 2996
# Added to each count of an edit (half a sighting) and to each count of chances.
SMOOTH = 0.5


def _common(a: Column, b: Column, most: Column) -> Column:
    """How many leading letters two arrays share, at most ``most``."""
    at = F.when(most > 0, F.sequence(F.lit(1), most)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(at, F.lit(0), lambda n, i: F.when((n == i - 1) & (F.get(a, i - 1) == F.get(b, i - 1)), n + 1).otherwise(n))


def edit_ops(df: DataFrame, word: str = "word", cand: str = "cand", out: str = "ops") -> DataFrame:
    """Adds ``out``: the edits (was, typed) that turn ``cand`` into ``word``, for
    different words that share a one-deletion variant."""
    w, c = F.col("__w"), F.col("__c")
    d = df.withColumn("__w", F.split(F.col(word), "")).withColumn("__c", F.split(F.col(cand), ""))
    d = d.withColumn("__p", _common(w, c, F.least(F.size(w), F.size(c))))
    d = d.withColumn("__s", _common(F.reverse(w), F.reverse(c), F.least(F.size(w), F.size(c)) - F.col("__p")))

    def core(x: Column) -> Column:
        return F.slice(x, F.col("__p") + 1, F.size(x) - F.col("__p") - F.col("__s"))

    d = d.withColumn("__x", core(w)).withColumn("__y", core(c)).withColumn("__b", F.when(F.col("__p") > 0, F.get(c, F.col("__p") - 1)).otherwise(F.lit("^")))
    x, y, before = F.col("__x"), F.col("__y"), F.col("__b")
    nx, ny = F.size(x), F.size(y)
    join = lambda a: F.array_join(a, "")

    def op(was: Column, typed: Column) -> Column:
        return F.struct(was.alias("was"), typed.alias("typed"))

    def lost(ctx: Column, letter: Column) -> Column:
        return op(F.concat(ctx, letter), ctx)

    def put(ctx: Column, letter: Column) -> Column:
        return op(ctx, F.concat(ctx, letter))

    first, last, second_last = (lambda a: F.get(a, F.lit(0))), (lambda a: F.element_at(a, -1)), (lambda a: F.element_at(a, -2))
    # A letter put in in front and another lost behind, or the other way round.
    moved_front = F.slice(x, 2, F.greatest(nx - 1, F.lit(0))) == F.slice(y, 1, F.greatest(ny - 1, F.lit(0)))
    ops = (
        F.when((nx == 0) & (ny == 1), F.array(lost(before, first(y))))
        .when((nx == 1) & (ny == 0), F.array(put(before, first(x))))
        .when((nx == 1) & (ny == 1), F.array(op(first(y), first(x))))
        .when((nx == 2) & (ny == 2) & (join(x) == join(F.reverse(y))), F.array(op(join(y), join(x))))
        .when(moved_front, F.array(put(before, first(x)), lost(second_last(y), last(y))))
        .otherwise(F.array(lost(before, first(y)), put(second_last(x), last(x))))
    )
    return d.withColumn(out, ops).drop("__w", "__c", "__p", "__s", "__x", "__y", "__b")


def chances(lexicon: DataFrame, by=("lang",)) -> DataFrame:
    """(by..., was, seen): how often each letter, word start and pair of
    neighbours stands in the text of ``lexicon`` (by..., word, freq)."""
    letters = lexicon.select(*by, "freq", F.concat(F.array(F.lit("^")), F.split("word", "")).alias("l"))
    singles = F.col("l")
    pairs = F.transform(F.sequence(F.lit(1), F.size("l") - 1), lambda i: F.concat(F.get("l", i - 1), F.get("l", i)))
    each = letters.select(*by, "freq", F.explode(F.concat(singles, pairs)).alias("was"))
    return each.groupBy(*by, "was").agg(F.sum("freq").alias("seen"))


def _op_costs(ops: DataFrame, counts: DataFrame, seen: DataFrame, by) -> DataFrame:
    """(by..., was, typed, n, cost) of the distinct edits ``ops``."""
    j = ops.join(counts, [*by, "was", "typed"], "left").join(seen, [*by, "was"], "left")
    n = F.coalesce("n", F.lit(0)).cast("long")
    made = n / F.lit(1000.0)
    # An edit can be made more often than the lexicon's text gives a chance to.
    p = (made + SMOOTH) / (F.greatest(F.coalesce("seen", F.lit(0)).cast("double"), made) + 2 * SMOOTH)
    return j.select(*by, "was", "typed", n.alias("n"), F.round(-1000 * F.log(p)).cast("long").alias("cost"))


def _pair_costs(pairs: DataFrame, costs: DataFrame, by) -> DataFrame:
    """``pairs`` with ``cost``: the sum over their one or two edits."""
    costs = bounded_broadcast(costs.select(*by, F.struct("was", "typed").alias("op"), "cost"))
    one = costs.select(*by, F.col("op").alias("op1"), F.col("cost").alias("cost1"))
    two = costs.select(*by, F.col("op").alias("op2"), F.col("cost").alias("cost2"))
    j = pairs.withColumn("op1", F.get("ops", F.lit(0))).withColumn("op2", F.get("ops", F.lit(1)))
    j = j.join(one, [*by, "op1"]).join(two, [*by, "op2"], "left")
    return j.withColumn("cost", F.col("cost1") + F.coalesce("cost2", F.lit(0))).drop("op1", "op2", "cost1", "cost2")


def prepare_pairs(cands: DataFrame, typed: DataFrame, by=("lang",)) -> DataFrame:
    """(by..., word, cand, freq, n, ops), stored: candidates (by..., word, cand,
    freq) of words that differ, with the words' own counts (by..., word, n)."""
    pairs = cands.where("word <> cand").select(*by, "word", "cand", "freq").join(typed.select(*by, "word", "n"), [*by, "word"])
    return materialize(edit_ops(pairs))


def learn_confusions(pairs: DataFrame, lexicon: DataFrame, rounds: int = ROUNDS, by=("lang",)) -> DataFrame:
    """(by..., was, typed, n, cost): the edits of ``pairs`` (from
    ``prepare_pairs``), how often each was made, in thousandths, and its cost."""
    if rounds < 1:
        raise ValueError("at least one round is needed")
    seen = materialize(chances(lexicon, by))
    ops = materialize(pairs.select(*by, F.explode("ops").alias("o")).select(*by, "o.was", "o.typed").distinct())
    costs = ops.select(*by, "was", "typed", F.lit(FIRST_COST).cast("long").alias("cost"))
    for _ in range(rounds):
        weight = F.col("freq") * F.exp(-F.col("cost") / F.lit(1000.0))
        mine = Window.partitionBy(*by, "word")  # a word's own candidates
        shared = _pair_costs(pairs, costs, by).withColumn("weight", weight).withColumn("share", F.col("n") * F.col("weight") / F.sum("weight").over(mine))
        counts = shared.select(*by, F.explode("ops").alias("o"), "share").groupBy(*by, F.col("o.was").alias("was"), F.col("o.typed").alias("typed")).agg(
            F.round(F.sum("share") * 1000).cast("long").alias("n"))
        costs = materialize(_op_costs(ops, counts, seen, by))
    return costs


def learned_costs(pairs: DataFrame, confusions: DataFrame, by=("lang",)) -> DataFrame:
    """(by..., word, cand, freq, emit): what each candidate costs as the origin of
    the word, without how frequent it is (for ``operators.ngram``)."""
    return _pair_costs(pairs, confusions, by).select(*by, "word", "cand", "freq", F.col("cost").alias("emit"))


def best_learned(pairs: DataFrame, confusions: DataFrame, by=("lang",)) -> DataFrame:
    """(by..., word, cand, cost): per word the candidate of least cost, its
    frequency counted in; of equal costs the alphabetically first."""
    total = F.col("emit") + F.round(-1000 * F.log(F.col("freq").cast("double"))).cast("long")
    pick = learned_costs(pairs, confusions, by).groupBy(*by, "word").agg(F.min(F.struct(total.alias("cost"), "cand")).alias("b"))
    return pick.select(*by, "word", F.col("b.cand").alias("cand"), F.col("b.cost").alias("cost"))
