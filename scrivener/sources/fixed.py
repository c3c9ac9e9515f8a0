"""Small fixed inputs: the default few-shot examples and the rule dictionary.

These values must stay exactly as written for results to match the
behaviour the engine reproduces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# The default few-shot examples, in prompt order (ord, typo, fixed).
DEFAULT_EXAMPLES = [
    (1, "I beleive this is teh answer.", "I believe this is the answer."),
    (2, "She recieved her degre yesterday.", "She received her degree yesterday."),
    (3, "The resturant serves good food.", "The restaurant serves good food."),
    (4, "this sentance has typoos", "This sentence has typos"),
]

# The prompt header and the per-example / final-input layout.
PROMPT_HEADER = "Fix typos in these sentences:\n\n"
EXAMPLE_FORMAT = ("Input: ", "\nOutput: ", "\n\n")
INPUT_PREFIX = "Input: "
PROMPT_SUFFIX = "\nOutput:"
ZERO_SHOT_PREFIX = "Fix: "

# Whole-word, case-insensitive dictionary rules (typo, fixed).
DEFAULT_RULES = [
    ("sentance", "sentence"),
    ("typoos", "typos"),
    ("typoes", "typos"),
    ("beleive", "believe"),
    ("recieve", "receive"),
    ("seperate", "separate"),
    ("resturant", "restaurant"),
    ("degre", "degree"),
    ("definately", "definitely"),
    ("quik", "quick"),
    ("cant", "can't"),
    ("teh", "the"),
    ("itmes", "items"),
]

# Lines skipped when looking for the answer in a raw generation
# (prefix match after trimming).  The fourth example answer is deliberately absent.
SKIP_PREFIXES = [
    "Output:",
    "Fix typos",
    "I believe this is the answer.",
    "She received her degree yesterday.",
    "The restaurant serves good food.",
]

# Markers that end the answer inside a raw generation.
END_MARKERS = ["<|endoftext|>", "\nInput:", "\nOutput:"]

# Role markers cut by the simple post-processing, in this order.
ROLE_MARKERS = ["Input:", "Output:", "Human:", "Assistant:"]

# Request limits.
TEMPERATURE_RANGE = (0.0, 2.0)
MAX_TOKENS_RANGE = (1, 512)
DEFAULT_TEMPERATURE = 0.0
DEFAULT_MAX_TOKENS = 25
CONTEXT_TOKENS = 256
SAMPLING_TOP_K = 40

# Quality targets (metric, comparison, threshold).
TARGETS = [
    ("accuracy", ">", 0.90),
    ("latency_ms", "<", 1000.0),
    ("model_size_gb", "<", 3.0),
]

# Ordered rules for naming model components (first match wins),
# on the lower-cased name: (label, kind, any-of substrings, and any-of substrings).
# No match gives 'unknown_' + the name with '.' replaced by '_'.
COMPONENT_RULES = [
    ("embeddings", "contains", ["embedding"], []),
    ("ffn_prefill", "contains", ["ffn"], ["prefill", "pf"]),
    ("ffn_infer", "contains", ["ffn"], []),
    ("lm_head", "contains", ["lm_head", "lmhead"], []),
    ("embeddings", "prefix", ["emb"], []),
    ("lm_head", "contains", ["head"], []),
]

EXAMPLE_SCHEMA = T.StructType(
    [
        T.StructField("ord", T.IntegerType(), False),
        T.StructField("typo", T.StringType(), False),
        T.StructField("fixed", T.StringType(), False),
    ]
)
RULE_SCHEMA = T.StructType(
    [T.StructField("typo", T.StringType(), False), T.StructField("fixed", T.StringType(), False)]
)


def examples_df(spark: SparkSession, rows=None, group: str | None = None) -> DataFrame:
    """Few-shot examples table (S9).  ``rows`` are (ord, typo, fixed) or, with
    ``group``, (group, ord, typo, fixed)."""
    if group is None:
        return spark.createDataFrame(rows or DEFAULT_EXAMPLES, EXAMPLE_SCHEMA)
    schema = T.StructType([T.StructField(group, T.StringType(), True), *EXAMPLE_SCHEMA.fields])
    return spark.createDataFrame(rows, schema)


def rules_df(spark: SparkSession, rows=None) -> DataFrame:
    return spark.createDataFrame(rows or DEFAULT_RULES, RULE_SCHEMA)
