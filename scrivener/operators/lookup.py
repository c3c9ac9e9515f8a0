"""Row-local lookup of array elements in a table.

A table of at most ``MAX_BYTES`` (summed over its rows, not guessed from their
number) is collected and broadcast; an Arrow UDF looks the elements of an array
column up where the row is.  Only that array (and a group) crosses to Python and
nothing is exploded, shuffled or joined; each distinct element of a batch is
looked up once.  Of a larger table the ``head``, the rows of least rank (the most
frequent words) up to that size, is looked up so; the few elements outside it are
joined with the rest (``look_up_large``, and ``absent`` for the callers' own joins).

Rows: one per input row.  A null array gives null, an empty one an empty array
or text; an element that the table lacks (or null) gives null or is copied.  The
keys of the table are unique; a null key or group is never found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrivener.functions.text import fold_key_py
from scrivener.operators.generate import _package_by_value
from scrivener.operators.joins import materialize

# A worker holds the table as a dictionary, several times its bytes.
MAX_BYTES = 16 << 20
# What a row costs beside its key and value.
ROW_BYTES = 16


def small_table(table: DataFrame, key: str, value: str, max_bytes: int = MAX_BYTES) -> pa.Table | None:
    """(key, value) if all rows together are proven to be small, else None."""
    size = F.sum((F.octet_length(F.col(key).cast("string")) + F.octet_length(F.col(value).cast("string")) + ROW_BYTES).cast("long"))
    if (table.agg(size).first()[0] or 0) > max_bytes:
        return None
    return table.select(key, value).toArrow()


def head(table: DataFrame, key: str, value: str, rank: Column, max_bytes: int = MAX_BYTES) -> tuple[pa.Table, DataFrame]:
    """(key, value) of the rows of least ``rank`` that are proven to be small
    together, and the other rows as a table.  ``rank`` is a whole number with few
    different values, such as ``log_rank``."""
    ranked = table.withColumn("__rank", rank)
    size = F.sum((F.coalesce(F.octet_length(F.col(key).cast("string")), F.lit(0)) + F.coalesce(F.octet_length(F.col(value).cast("string")), F.lit(0)) + ROW_BYTES).cast("long"))
    held, last = 0, None
    for r in ranked.groupBy("__rank").agg(size.alias("b")).orderBy("__rank").collect():  # a row per rank
        held += r["b"]
        if held > max_bytes:
            break
        last = r["__rank"]
    if last is None:
        return table.select(key, value).limit(0).toArrow(), table
    return ranked.where(F.col("__rank") <= last).select(key, value).toArrow(), ranked.where(F.col("__rank") > last).drop("__rank")


def log_rank(c: Column) -> Column:
    """Whole eighths of the binary logarithm, 0 for null and below 1."""
    return F.floor(8 * F.log2(F.greatest(F.coalesce(c, F.lit(1)), F.lit(1)).cast("double"))).cast("int")


def _ship(df: DataFrame, table: pa.Table):
    return df.sparkSession.sparkContext.broadcast(tuple(table.column(i).combine_chunks() for i in (0, 1)))


def _places(keys: pa.Array) -> dict:
    return {k: i for i, k in enumerate(keys.to_pylist()) if k is not None}


def _offsets(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
    return sizes, pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))


def look_up(df: DataFrame, table: pa.Table, elements: Column) -> Column:
    """The array ``elements`` of ``df`` with the value of each element."""
    shipped = _ship(df, table)
    kind = {pa.string(): "array<string>", pa.int32(): "array<int>", pa.int64(): "array<long>"}[table.column(1).type]

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        keys, values = shipped.value
        place = _places(keys)
        for batch in batches:
            met = batch.flatten().dictionary_encode()
            at = pa.array([place.get(k) for k in met.dictionary.to_pylist()], pa.int32())
            yield pa.ListArray.from_arrays(_offsets(batch)[1], values.take(at.take(met.indices)), mask=pc.is_null(batch))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    with _package_by_value():
        return F.arrow_udf(run, kind)(elements)


def look_up_large(df: DataFrame, table: DataFrame, key: str, value: str, rank: Column, elements: Column, keep, out: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(keep..., out): ``look_up`` in a table of any size.

    The rows of ``df`` are stored once with a number of their own, what the head
    gave and the elements that it lacks; only those elements are shuffled, and
    what the rest of the table gives is joined back by the number."""
    first, rest = head(table, key, value, rank, max_bytes)
    known = df.select(*keep, elements.alias("__in")).withColumn("__found", look_up(df, first, F.col("__in")))
    lacking = F.filter(F.transform("__in", lambda x, i: F.when(F.get("__found", i).isNull() & x.isNotNull(), F.struct(i.alias("pos"), x.alias("key")))), lambda m: m.isNotNull())
    stored = materialize(known.select(*keep, "__found", lacking.alias("__lack"), F.monotonically_increasing_id().alias("__row")))
    asked = stored.select("__row", F.explode("__lack").alias("m")).select("__row", "m.pos", F.col("m.key").alias("__key"))
    hits = asked.join(rest.select(F.col(key).alias("__key"), F.col(value).alias("__value")), "__key")
    per_row = hits.groupBy("__row").agg(F.map_from_entries(F.collect_list(F.struct("pos", "__value"))).alias("__fix"))
    both = F.transform("__found", lambda x, i: F.coalesce(x, F.element_at(F.col("__fix"), i)))
    return stored.join(per_row, "__row", "left").select(*keep, F.when(F.col("__fix").isNull(), F.col("__found")).otherwise(both).alias(out))


def _numbered(place: dict, lists: pa.Array, groups: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, pa.Array]:
    """(pieces, place of each in the table or -1, sizes and offsets of the lists)."""
    flat, (sizes, offsets) = lists.flatten(), _offsets(lists)
    met, named = flat.dictionary_encode(), groups.dictionary_encode()
    folded = [fold_key_py(w) for w in met.dictionary.to_pylist()]
    names, n = named.dictionary.to_pylist(), max(len(folded), 1)
    # A number for each (group, piece); negative where the group is null.
    of_row = pc.fill_null(named.indices, -1).to_numpy().astype(np.int64)
    code = np.repeat(of_row, sizes) * n + met.indices.to_numpy()
    distinct, back = np.unique(code, return_inverse=True)
    at = np.array([place.get(names[c // n] + folded[c % n], -1) if c >= 0 else -1 for c in distinct.tolist()], np.int32)[back]
    return flat, at, sizes, offsets


def absent(df: DataFrame, table: pa.Table, pieces: Column, group: Column) -> Column:
    """The places, from 0, of the pieces that ``rewrite`` does not find among the
    table's keys; null for a null list or group."""
    shipped = _ship(df, table)

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        place = _places(shipped.value[0])
        for lists, groups in batches:
            _, at, sizes, offsets = _numbered(place, lists, groups)
            starts = offsets.to_numpy()
            lacks = np.flatnonzero(at < 0)
            upto = np.searchsorted(lacks, starts).astype(np.int32)
            where = (lacks - np.repeat(starts[:-1], sizes)[lacks]).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(upto), pa.array(where), mask=pc.or_(pc.is_null(lists), pc.is_null(groups)))

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, ...]], "return": Iterator[pa.Array]}
    with _package_by_value():
        return F.arrow_udf(run, "array<int>")(pieces, group)


def rewrite(df: DataFrame, table: pa.Table, pieces: Column, group: Column, at: Column | None = None, fixed: Column | None = None) -> Column:
    """The text made of ``pieces``, each replaced by the value of ``group`` + its
    folded form where the table has one that is not null.  The pieces at the
    places ``at`` (from 0; null for none) become those of ``fixed`` instead,
    where they are not null."""
    shipped = _ship(df, table)

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        keys, values = shipped.value
        place = _places(keys)
        for lists, groups, *own in batches:
            flat, found, _, offsets = _numbered(place, lists, groups)
            made = values.take(pa.array(found, mask=found < 0))
            if own:
                per_row, words = _offsets(own[0])[0], own[1].flatten()
                source = np.arange(len(flat))
                source[np.repeat(offsets.to_numpy()[:-1], per_row) + own[0].flatten().to_numpy()] = len(flat) + np.arange(len(words))
                made = pa.concat_arrays([made, words]).take(pa.array(source))
            yield pc.binary_join(pa.ListArray.from_arrays(offsets, pc.coalesce(made, flat), mask=pc.is_null(lists)), "")

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, ...]], "return": Iterator[pa.Array]}
    with _package_by_value():
        return F.arrow_udf(run, "string")(pieces, group, *([] if at is None else [at, fixed]))
