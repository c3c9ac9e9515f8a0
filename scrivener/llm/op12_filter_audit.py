"""What filters remove in every order in which they could be applied.

1. Every document gets a failure mask, one bit per filter.  The filters that
   look at one text are column expressions; "identical to the text of a smaller
   id" is decided on 128-bit digests.
2. Equal (part, mask) are counted: all documents, and of them the good and the
   toxic ones.  A part is then at most 2**n rows, however many documents it has.
3. Per part these counts are the leaves of a decision diagram with a level per
   filter.  Equal subdiagrams are one node, and a node knows the counts under
   it.  The all-pass path from the root is a run of the filters in the order of
   the levels: at each level the fail branch is what the filter removes there,
   the pass branch what it leaves.
4. Swapping two adjacent levels rewrites the nodes of those two only.  The
   orders are visited so that each differs from the one before by one such swap.

The counts of a part travel, never its documents; a hot part, or a text in a
third of all rows, is collapsed before the shuffle.

Rows: every row is a document.  Null text counts as empty; a null part and an
empty one are one part, ``""``.  A null id counts as larger than any other;
rows with one id are not earlier than each other.  A document is good or toxic
if any row of its label is, and neither without a label or an id.  Parts are
those that occur; an empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrivener.llm.common import WORD, store

#: Documents, good ones, toxic ones.
Counts = tuple[int, int, int]
#: All orders of more filters than this are too many to list (8! = 40,320).
MOST_FILTERS = 8


class CountDiagram:
    """A decision diagram over n failure bits with counts at its leaves.

    ``nodes[level]`` lists the (pass, fail) children of a level's nodes, as
    places in the next level's list; the last level's children are leaves.
    Equal nodes of a level are one.  ``total`` holds the counts under each."""

    def __init__(self, n: int, counts: dict[int, Counts]):
        self.order = list(range(n))
        self.nodes: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        self.known: list[dict[tuple[int, int], int]] = [{} for _ in range(n)]
        leaves = sorted({counts.get(mask, (0, 0, 0)) for mask in range(1 << n)})
        self.total: list[list[Counts]] = [[] for _ in range(n)] + [leaves]
        at = {leaf: k for k, leaf in enumerate(leaves)}
        below = [at[counts.get(mask, (0, 0, 0))] for mask in range(1 << n)]
        for level in reversed(range(n)):  # the bit of a level's filter splits what is below it
            bit = 1 << level
            below = [self._node(level, below[m], below[m | bit]) for m in range(bit)]

    def _node(self, level: int, passed: int, failed: int) -> int:
        key = (passed, failed)
        at = self.known[level].get(key)
        if at is None:
            at = self.known[level][key] = len(self.nodes[level])
            self.nodes[level].append(key)
            under = self.total[level + 1]
            self.total[level].append(tuple(a + b for a, b in zip(under[passed], under[failed])))
        return at

    def swap(self, level: int) -> None:
        """Exchange the filters of ``level`` and the next; nodes above and below stay."""
        low = level + 1
        self.order[level], self.order[low] = self.order[low], self.order[level]
        upper, lower = self.nodes[level], self.nodes[low]
        self.nodes[low], self.known[low], self.total[low] = [], {}, []
        for k, (passed, failed) in enumerate(upper):
            (pp, pf), (fp, ff) = lower[passed], lower[failed]
            upper[k] = (self._node(low, pp, fp), self._node(low, pf, ff))
        self.known[level] = {key: k for k, key in enumerate(upper)}

    def steps(self) -> list[tuple[int, Counts, Counts]]:
        """(filter, counts left after it, counts it removes) down the all-pass path."""
        out, at = [], 0
        for level, which in enumerate(self.order):
            passed, failed = self.nodes[level][at]
            out.append((which, self.total[level + 1][passed], self.total[level + 1][failed]))
            at = passed
        return out


def plain_changes(n: int) -> Iterator[int]:
    """Places k whose swaps with k + 1 lead through all orders of n things."""
    if n < 2:
        return
    inner = plain_changes(n - 1)
    while True:
        for turn, back in enumerate((range(n - 2, -1, -1), range(n - 1))):
            yield from back
            step = next(inner, None)
            if step is None:
                return
            yield step + 1 - turn


def every_order(letters: str, counts: dict[int, Counts]) -> list[tuple]:
    """(order, step, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley) of all orders, from the counts of each failure mask."""
    n = len(letters)
    diagram = CountDiagram(n, counts)
    runs = [(tuple(diagram.order), diagram.steps())]
    for level in plain_changes(n):
        diagram.swap(level)
        runs.append((tuple(diagram.order), diagram.steps()))
    fails, alone, shapley = [0] * n, [0] * n, [0] * n
    for _, steps in runs:
        fails[steps[0][0]] = steps[0][2][0]  # first of all: nothing was removed before
        alone[steps[-1][0]] = steps[-1][2][0]  # last of all: what the others leave
        for which, _, removed in steps:
            shapley[which] += removed[0]
    return [("".join(letters[w] for w in order), k + 1, kept[0], gone[0], fails[which] - gone[0], alone[which], gone[1], gone[2], shapley[which])
            for order, steps in runs for k, (which, kept, gone) in enumerate(steps)]


def text_filters(text: Column) -> dict[str, Column]:
    """The failure conditions A to D of a text without nulls."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return {
        "A": F.size(words) < 200,
        "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * 50,
        "C": F.regexp_count(text, F.lit("[A-Z]")) * 100 > F.char_length(text) * 2,
        "D": text.rlike("[#$%&*|]"),
    }


def failure_counts(df: DataFrame, labels: DataFrame, filters: dict[str, Column], copies: str | None, part_col: str = "source",
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(part, mask, n, good, toxic): documents per failure mask, one bit per
    filter in the order of ``filters`` and the next for ``copies``, the filter
    that fails texts that a smaller id has too (none if null).

    ``filters`` are conditions over the column ``text``, null read as empty."""
    src = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    mask = sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(filters.values())), F.lit(0))
    # The digest stands for the text: md5 and a hash of another kind, 192 bits.
    digest = F.struct(F.unhex(F.md5("text")).alias("one"), F.xxhash64("text").alias("two"))
    docs = src.select("id", "part", mask.alias("mask"), digest.alias("text"))
    known = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    docs = docs.join(known, "id", "left")
    kind = ["text", "mask", "part", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")]
    # Rows with one id and text are counted first; a null id comes last.
    order = F.struct(F.col("id").isNull().alias("no_id"), "id")
    same = docs.groupBy(order.alias("ord"), *kind).agg(F.count("*").alias("n"))
    kinds = same.groupBy("text", "mask", "part", "good", "toxic").agg(F.sum("n").alias("n"), F.min(F.struct("ord", "n")).alias("first"))
    if copies is None:
        per = kinds.select("part", "mask", "good", "toxic", "n")
    else:
        kinds = store(kinds)
        firsts = kinds.groupBy("text").agg(F.min("first.ord").alias("least"))
        # Every copy fails but the rows with the smallest id of all.
        spared = F.when(F.col("first.ord") == F.col("least"), F.col("first.n")).otherwise(0)
        bit = 1 << len(filters)
        both = kinds.join(firsts, "text").select("part", "good", "toxic", F.explode(F.array(
            F.struct("mask", spared.alias("n")), F.struct((F.col("mask") + bit).alias("mask"), (F.col("n") - spared).alias("n")))).alias("e"))
        per = both.select("part", "good", "toxic", "e.mask", "e.n")
    of = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c)
    return per.groupBy("part", "mask").agg(F.sum("n").alias("n"), of("good"), of("toxic"))


def audit(df: DataFrame, labels: DataFrame, filters: dict[str, Column] | None = None, copies: str | None = "E", part_col: str = "source",
          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per part, order and step (see ``every_order``).  Filters have
    names of one letter; by default A to D of ``text_filters``."""
    filters = text_filters(F.col("text")) if filters is None else filters
    letters = "".join(filters) + (copies or "")
    if len(letters) != len(filters) + len(copies or "") or len(set(letters)) != len(letters) or not 1 <= len(letters) <= MOST_FILTERS:
        raise ValueError(f"1 to {MOST_FILTERS} filters with different names of one letter are needed")
    counts = failure_counts(df, labels, filters, copies, part_col, id_col, text_col)
    # At most 2**n entries per part.
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("counts"))
    names = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = every_order(letters, {c["mask"]: (c["n"], c["good"], c["toxic"]) for c in found})
                cols = [pa.array(c, t) for c, t in zip(zip(*rows), [pa.string(), pa.int32()] + [pa.int64()] * 7)]
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(rows), pa.string()), *cols], names)

    return parts.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in names[3:]))


#: DuckDB SQL of the registered query: every order counts the masks anew.
ORACLE = """
WITH RECURSIVE f(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders(o) AS (SELECT '' UNION ALL SELECT o || letter FROM orders, f WHERE NOT contains(o, letter)),
w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
d AS (SELECT doc_id, part, CASE WHEN len(w) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
             + CASE WHEN 100 * len(regexp_extract_all(text, '[A-Z]')) > 2 * length(text) THEN 4 ELSE 0 END
             + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
             + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) OR (doc_id IS NULL AND min(doc_id) OVER (PARTITION BY text) IS NOT NULL) THEN 16 ELSE 0 END AS mask FROM w),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM d LEFT JOIN l USING (doc_id) GROUP BY part, mask),
steps AS (SELECT o AS filter_order, step, bit, (SELECT coalesce(sum(g.bit), 0) FROM f g WHERE strpos(o, g.letter) < step) AS before
          FROM orders, range(1, 6) r(step) JOIN f ON letter = substr(o, step, 1) WHERE length(o) = 5),
c AS (SELECT part, filter_order, step, s.bit,
             coalesce(sum(n) FILTER (mask & before = 0 AND mask & s.bit = 0), 0) AS kept,
             coalesce(sum(n) FILTER (mask & before = 0 AND mask & s.bit > 0), 0) AS removed,
             coalesce(sum(n) FILTER (mask & before > 0 AND mask & s.bit > 0), 0) AS redundant,
             coalesce(sum(n) FILTER (mask = s.bit), 0) AS unique_fails,
             coalesce(sum(good) FILTER (mask & before = 0 AND mask & s.bit > 0), 0) AS good_lost,
             coalesce(sum(toxic) FILTER (mask & before = 0 AND mask & s.bit > 0), 0) AS toxic_lost
      FROM m, steps s GROUP BY part, filter_order, step, s.bit)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
       good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM c
"""
