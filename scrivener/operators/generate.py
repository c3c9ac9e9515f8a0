"""Batch generation with a user-supplied model.

The model is the one step that cannot be a Spark expression.  It runs in
``mapInPandas``: each Python worker loads the model once (before its first
batch, and keeps it for its later tasks) and feeds it Arrow batches of prompts
(``spark.sql.execution.arrow.maxRecordsPerBatch`` rows each).

The prompts are dealt to tasks of equal cost (``operators.balance``) and given to
the model in batches of about equal cost.  Without a model, ``operators.ngram``
generates from counts.

``load_model`` returns an object with
``generate(prompts: list[str], max_tokens: int, temperature: float, top_k: int | None) -> list[str]``.
Temperature 0 means greedy decoding (no top-k); otherwise top-k 40 (G2).
"""

from __future__ import annotations

from contextlib import contextmanager
from typing import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrivener.operators.balance import equal_tasks
from scrivener.operators.joins import materialize
from scrivener.sources.fixed import DEFAULT_MAX_TOKENS, DEFAULT_TEMPERATURE, SAMPLING_TOP_K

# Prompt words and answer tokens of one call of the model.
DEFAULT_BATCH_TOKENS = 16_384


def decode_options(temperature: float, top_k: int = SAMPLING_TOP_K) -> dict:
    """Greedy at temperature 0, else top-k sampling."""
    if temperature == 0.0:
        return {"temperature": 0.0, "top_k": None}
    if top_k < 1:
        raise ValueError("top_k must be at least 1")
    return {"temperature": float(temperature), "top_k": int(top_k)}


@contextmanager
def _package_by_value() -> Iterator[None]:
    """Let the Python workers run this package's functions without having it
    installed: inside, PySpark's cloudpickle serialises functions and classes
    of ``scrivener`` (and its sub-modules) by value instead of by name."""
    import scrivener
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(scrivener)
    try:
        yield
    finally:
        cloudpickle.unregister_pickle_by_value(scrivener)


def _loader_key(load_model: Callable) -> str:
    """Names a loader in a worker's cache: a digest of its serialised form."""
    import hashlib

    from pyspark import cloudpickle

    return hashlib.sha256(cloudpickle.dumps(load_model)).hexdigest()


def _worker_model(key: str, load_model: Callable):
    """The worker's model of this loader, loaded at first use.  The cache hangs
    on ``sys.modules``, which lives as long as the worker process does."""
    import sys
    import types

    cache = sys.modules.setdefault("_scrivener_worker_models", types.ModuleType("_scrivener_worker_models")).__dict__
    if key not in cache:
        cache[key] = load_model()
    return cache[key]


def prompt_cost(prompt: Column, max_tokens: int) -> Column:
    """What a prompt costs the model: its words and the tokens it may answer."""
    return F.size(F.split(prompt, r"\s+")).cast("long") + max_tokens


def generate(df: DataFrame, prompt_col: str, load_model: Callable, max_tokens: int = DEFAULT_MAX_TOKENS,
             temperature: float = DEFAULT_TEMPERATURE, out: str = "raw_output", normalise: bool = True,
             strip_echo: bool = True, top_k: int = SAMPLING_TOP_K, tasks: int | None = None,
             batch_tokens: int = DEFAULT_BATCH_TOKENS) -> DataFrame:
    """G1: add ``out`` (the raw generation) to every row.

    Around the model call, in the JVM: the prompt end is normalised first
    (P7), and an echoed prompt is stripped from the generation afterwards,
    leading spaces, newlines and tabs included (P8).

    The rows are numbered in a stored copy; only (number, prompt) go to the
    workers, in ``tasks`` tasks of equal cost (as many as the shuffle has
    partitions, unless given), and the answers are joined back by number.  A
    worker calls the model for batches of up to ``batch_tokens`` of cost, a
    longer prompt alone; rows without a prompt are not sent."""
    from scrivener.functions.prompts import normalise_prompt, strip_prompt

    opts = decode_options(temperature, top_k)
    if batch_tokens < 1:
        raise ValueError("batch_tokens must be at least 1")
    tasks = tasks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sent = normalise_prompt(F.col(prompt_col)) if normalise else F.col(prompt_col)
    numbered = materialize(df.withColumn("__row", F.monotonically_increasing_id()).withColumn("__model_prompt", sent))
    prompts = numbered.where(F.col("__model_prompt").isNotNull()).select("__row", F.col("__model_prompt").alias("prompt"))
    dealt = equal_tasks(prompts.withColumn("cost", prompt_cost(F.col("prompt"), max_tokens)), "__row", "cost", tasks)
    dealt = dealt.repartitionById(tasks, F.col("task")).select("__row", "prompt", "cost")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = _worker_model(key, load_model)
        for pdf in batches:
            # Rows of like cost stand together; each run of them fills the token budget.
            pdf = pdf.sort_values(["cost", "__row"])
            lo, held = 0, 0
            costs = pdf["cost"].tolist()
            for at, cost in enumerate([*costs, batch_tokens]):
                if at > lo and (held + cost > batch_tokens or at == len(costs)):
                    part = pdf.iloc[lo:at]
                    answers = model.generate(part["prompt"].tolist(), max_tokens=max_tokens, **opts)
                    yield pd.DataFrame({"__row": part["__row"].to_numpy(), "answer": pd.Series(answers, dtype=object)})
                    lo, held = at, 0
                held += cost

    with _package_by_value():
        key = _loader_key(load_model)
        answers = dealt.mapInPandas(run, "__row long, answer string")
    kept = [c for c in df.columns if c != out]
    gen = numbered.join(answers, "__row", "left").select(*kept, F.col("answer").alias(out), "__model_prompt")
    if strip_echo:
        gen = gen.withColumn(out, strip_prompt(F.col(out), F.col("__model_prompt")))
    return gen.select(*kept, out)
