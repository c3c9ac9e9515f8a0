"""DuckDB SQL building blocks for the oracle queries.

These are independent re-statements of the Spark expressions in
``scrivener.functions`` written in DuckDB's dialect; the correctness check
runs both on the same parquet tables and compares the results.
"""

from __future__ import annotations

from scrivener.functions.text import sql_ws_literal
from scrivener.sources.fixed import DEFAULT_RULES, SKIP_PREFIXES, ROLE_MARKERS

WS = sql_ws_literal()

# RE2 has no Unicode \b; word runs are cut out explicitly instead.
WORD_CLASS = r"[\p{L}\p{M}\p{Nd}\p{Pc}]"
TOKEN_RE = f"{WORD_CLASS}+|[^\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Pc}}]+"


def q(s: str) -> str:
    """Quote a Python string as a DuckDB string expression."""
    pieces = s.split("\n")
    return "(" + " || chr(10) || ".join("'" + p.replace("'", "''") + "'" for p in pieces) + ")"


def one_byte(x: str) -> str:
    """DuckDB's levenshtein counts bytes: give each accented lower-case letter
    of the Latin blocks one ASCII sign that no lower-case word holds."""
    letters = "".join(chr(c) for c in range(0xDF, 0x100) if chr(c).isalpha()) + chr(0x153)
    signs = "".join(chr(c) for c in [*range(0x30, 0x3A), *range(0x41, 0x5B)])[: len(letters)]
    return f"translate({x}, '{letters}', '{signs}')"


def utrim(x: str) -> str:
    return f"trim({x}, {WS})"


def urtrim(x: str) -> str:
    return f"rtrim({x}, {WS})"


def rules_map(rules=None) -> str:
    rules = rules or DEFAULT_RULES
    return "MAP {" + ", ".join(f"{q(t.lower())}: {q(f)}" for t, f in rules) + "}"


def apply_rules(x: str, rules=None) -> str:
    return (
        f"CASE WHEN {x} IS NULL THEN NULL ELSE array_to_string(list_transform("
        f"regexp_extract_all({x}, '{TOKEN_RE}'), lambda tok: coalesce({rules_map(rules)}[lower(tok)], tok)), '') END"
    )


def unquote(s: str) -> str:
    quoted = f"((starts_with({s}, '\"') AND suffix({s}, '\"')) OR (starts_with({s}, '''') AND suffix({s}, '''')))"
    return (
        f"CASE WHEN {quoted} AND length({s}) < 2 THEN '' "
        f"WHEN {quoted} THEN substr({s}, 2, length({s}) - 2) ELSE {s} END"
    )


def drop_commentary(s: str) -> str:
    note = f"split_part({s}, '(Note:', 1)"
    paren = f"split_part({s}, '(', 1)"
    return (
        f"CASE WHEN contains({s}, '(Note:') THEN {utrim(note)} "
        f"WHEN contains({s}, '(') AND strlen({paren}) > 8 THEN {utrim(paren)} ELSE {s} END"
    )


def sanitize_ctes(src_table: str, src_col: str, out_col: str, prefix: str = "sz", rules=None) -> tuple[str, str]:
    """CTEs that add ``out_col`` = sanitised ``src_col``; returns (ctes, final table)."""
    a, b, c = f"{prefix}_1", f"{prefix}_2", f"{prefix}_3"
    ctes = f"""
{a} AS (SELECT *, {unquote(utrim(src_col))} AS {prefix}_s1 FROM {src_table}),
{b} AS (SELECT *, {drop_commentary(prefix + '_s1')} AS {prefix}_s2 FROM {a}),
{c} AS (SELECT * EXCLUDE ({prefix}_s1, {prefix}_s2), {utrim(apply_rules(prefix + '_s2', rules))} AS {out_col} FROM {b})"""
    return ctes, c


def extract_ctes(src_table: str, raw_col: str, out_col: str, prefix: str = "ex") -> tuple[str, str]:
    """CTEs adding ``out_col``, ``status`` and ``branch``; returns (ctes, final table)."""
    a, b, c = f"{prefix}_1", f"{prefix}_2", f"{prefix}_3"
    skip = " OR ".join(f"starts_with(l, {q(p)})" for p in SKIP_PREFIXES)
    after = lambda s: utrim(f"substr({s}, 7)")
    head = f"string_split_regex({raw_col}, '<\\|endoftext\\|>|\\nInput:|\\nOutput:')[1]"
    ctes = f"""
{a} AS (SELECT *, {head} AS {prefix}_head FROM {src_table}),
{b} AS (SELECT *, {utrim(prefix + '_head')} AS {prefix}_t,
        list_filter(list_transform(string_split({prefix}_head, chr(10)), lambda x: {utrim('x')}),
                    lambda l: l <> '' AND NOT ({skip}))[1] AS {prefix}_first
        FROM {a}),
{c} AS (SELECT *, CASE
          WHEN {raw_col} IS NULL THEN NULL
          WHEN starts_with({prefix}_t, 'Input:') AND {after(prefix + '_t')} <> '' THEN 'input_prefix'
          WHEN starts_with({prefix}_first, 'Input:') AND {after(prefix + '_first')} <> '' THEN 'input_line'
          WHEN {prefix}_first IS NOT NULL THEN 'line'
          WHEN {prefix}_t <> '' THEN 'fallback'
          ELSE 'empty' END AS branch
        FROM {b}),
{prefix}_4 AS (SELECT * EXCLUDE ({prefix}_head, {prefix}_t, {prefix}_first),
        CASE branch WHEN 'input_prefix' THEN {after(prefix + '_t')}
                    WHEN 'input_line' THEN {after(prefix + '_first')}
                    WHEN 'line' THEN {prefix}_first
                    WHEN 'fallback' THEN {prefix}_t END AS {out_col},
        CASE WHEN {raw_col} IS NULL THEN 'null_input' WHEN branch = 'empty' THEN 'empty_output' ELSE 'ok' END AS status
        FROM {c})"""
    return ctes, f"{prefix}_4"


def collapse_ws(x: str) -> str:
    return f"regexp_replace({utrim(x)}, '[\\s\\x0B\\x{{85}}\\p{{Z}}]+', ' ', 'g')"


def cut_role_markers(x: str) -> str:
    for m in ROLE_MARKERS:
        x = utrim(f"split_part({x}, {q(m)}, 1)")
    return x


def first_sentence(x: str) -> str:
    s = utrim(x)
    return f"CASE WHEN contains({s}, '.') THEN {utrim(f'split_part({s}, {q(chr(46))}, 1)')} || '.' ELSE {s} END"


def phrase_marks(x: str, phrases) -> str:
    """Each phrase of ``phrases`` (typo, fixed) as a private-use sign of its own,
    the longest first; twice, as neighbours share the sign between them."""
    other = WORD_CLASS.replace("[", "[^")
    for k, (typo, _) in sorted(enumerate(phrases), key=lambda e: -len(e[1][0])):
        for _ in range(2):
            x = f"regexp_replace({x}, '(^|{other}){typo}($|{other})', '\\1' || chr({0xE000 + k}) || '\\2', 'gi')"
    return x


def apply_phrases(x: str, phrases, rules=None) -> str:
    """The phrases, then the rules of one word on what they leave."""
    done = apply_rules(phrase_marks(x, phrases), rules)
    for k, (_, fixed) in enumerate(phrases):
        done = f"replace({done}, chr({0xE000 + k}), {q(fixed)})"
    return done
