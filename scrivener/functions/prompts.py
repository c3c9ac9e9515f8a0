"""Prompt rendering as column expressions.

A prompt is ``header || 'Input: ' || text || '\\nOutput:'``.  The header (the
instruction plus the rendered examples) is the same for every row of a group,
so it is a literal (P1) or a broadcast-joined column (P2, ``operators.prompts``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scrivener.functions.text import WHITE_SPACE, urtrim
from scrivener.sources.fixed import (
    DEFAULT_EXAMPLES,
    EXAMPLE_FORMAT,
    INPUT_PREFIX,
    PROMPT_HEADER,
    PROMPT_SUFFIX,
    ZERO_SHOT_PREFIX,
)


def render_header(examples=None) -> str:
    """Header text for an ordered list of (ord, typo, fixed) examples."""
    rows = sorted(examples if examples is not None else DEFAULT_EXAMPLES, key=lambda r: r[0])
    pre, mid, post = EXAMPLE_FORMAT
    return PROMPT_HEADER + "".join(f"{pre}{typo}{mid}{fixed}{post}" for _, typo, fixed in rows)


def example_block(typo: Column, fixed: Column) -> Column:
    pre, mid, post = EXAMPLE_FORMAT
    return F.concat(F.lit(pre), typo, F.lit(mid), fixed, F.lit(post))


def few_shot_prompt(text: Column, header: Column | str | None = None) -> Column:
    """Header, then ``Input: <text>\\nOutput:``."""
    if header is None:
        header = render_header()
    h = F.lit(header) if isinstance(header, str) else header
    return F.concat(h, F.lit(INPUT_PREFIX), text, F.lit(PROMPT_SUFFIX))


def create_correction_prompt(text: Column, header: Column | str | None = None) -> Column:
    """The default prompt is the few-shot prompt."""
    return few_shot_prompt(text, header)


def zero_shot_prompt(text: Column) -> Column:
    """P5: ``Fix: <text>``."""
    return F.concat(F.lit(ZERO_SHOT_PREFIX), text)


def normalise_prompt(prompt: Column) -> Column:
    """Right-trim; a prompt ending 'Output:' or ending in none of
    ': . ! ?' gets one space after the right-trimmed text; otherwise the
    original prompt is kept unchanged."""
    r = urtrim(prompt)
    plain_end = ~(r.endswith(":") | r.endswith(".") | r.endswith("!") | r.endswith("?") | r.endswith(" "))
    return (
        F.when(r.endswith("Output:"), F.concat(r, F.lit(" ")))
        .when(plain_end, F.concat(r, F.lit(" ")))
        .otherwise(prompt)
    )


def strip_prompt(full: Column, prompt: Column) -> Column:
    """Remove an echoed prompt prefix, then drop leading ' ', '\\n', '\\t'."""
    rest = F.when(full.startswith(prompt), F.substr(full, F.length(prompt) + 1, F.length(full))).otherwise(full)
    return F.ltrim(rest, F.lit(" \n\t"))


__all__ = [
    "render_header",
    "example_block",
    "few_shot_prompt",
    "create_correction_prompt",
    "zero_shot_prompt",
    "normalise_prompt",
    "strip_prompt",
    "WHITE_SPACE",
]
