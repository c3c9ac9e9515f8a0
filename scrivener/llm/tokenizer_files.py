"""Tokenizer files on executors: read once on the driver, broadcast, parsed
once per Python worker."""

from __future__ import annotations

from pyspark import Broadcast
from pyspark.sql import SparkSession

#: Vocabulary files are a few MB; a larger file is refused, not broadcast.
MOST_BYTES = 64 << 20

_PARSED: dict[int, object] = {}


def ship(spark: SparkSession, path: str) -> Broadcast:
    """Broadcast the content of a vocabulary file (executors need not have it)."""
    with open(path, encoding="utf-8") as f:
        text = f.read(MOST_BYTES + 1)
    if len(text) > MOST_BYTES:
        raise ValueError(f"{path} is larger than {MOST_BYTES} characters")
    return spark.sparkContext.broadcast(text)


def parsed(shipped: Broadcast):
    """The ``tokenizers`` object of a shipped file, one per worker process,
    without truncation or padding."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker per core
    from tokenizers import Tokenizer

    text = shipped.value
    key = hash(text)
    if key not in _PARSED:
        tok = Tokenizer.from_str(text)
        tok.no_truncation()
        tok.no_padding()
        _PARSED[key] = tok
    return _PARSED[key]
