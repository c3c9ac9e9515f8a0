"""URL filters: host rules, then a weighted vocabulary.

Every url has a verdict.  A *rule* is (action, host, path): it fits its host
and all subdomains, if the url's path starts with the rule's path.  Of the
rules that fit, the longest (host and path together, then host) decides.
Where none fits, the *vocabulary* does: one Aho-Corasick automaton finds all
strict and soft terms in the whole lower-cased url (A-Z only), a hit counts if
the characters beside it are no ASCII letters or digits, and the url is
blocked on one strict term or ``soft_limit`` different soft ones.  In weights:
a strict term weighs ``soft_limit``, a soft one 1, different terms add up, and
a url is blocked from ``soft_limit`` on.

A batch of urls is one string to the automaton (no term holds a line break, so
no hit spans two urls), which visits each character once whatever the number
of terms.  The work is row-local: no shuffle.  Rules and terms are arguments
of the job; together they are held under ``MOST_BYTES`` and broadcast.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
lower-cased; path: from there up to ``?``, ``#`` or the end.

Rows: one per input row, repeated rows and ids included.  A null url and one
without ``://`` have an empty host and path, fit no rule, and a null one holds
no term, so it is allowed.  Empty and very long urls need nothing special.
An empty table gives no rows.  Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrivener.llm.common import slices

ALLOW, BLOCK = "allow", "block"
#: Rules and terms are broadcast; more than this is refused.
MOST_BYTES = 64 << 20
#: The rules of the registered query (fixed values).
RULES = ((BLOCK, "net", "/"), (ALLOW, "example.net", "/en/"), (BLOCK, "example.com", "/de/"), (ALLOW, "org", "/fr/"))
#: Terms that block a url alone, and terms that do so in company.
STRICT = ("casino", "porn", "xxx", "viagra", "cialis", "escort", "warez", "malware", "phishing", "sportsbook")
SOFT = ("adult", "bet", "bets", "bonus", "cheap", "crack", "discount", "farm", "free", "gambling", "jackpot", "keygen", "loan", "loans",
        "lottery", "payday", "pharmacy", "pills", "poker", "replica", "sex", "slots", "spam", "torrent", "track", "win", "winner")


def host_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a url; both empty for a null url or one without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_index(rules: Sequence[tuple[str, str, str]]) -> dict[str, list[tuple[str, str]]]:
    """host -> its (path, action), longest path first."""
    out: dict[str, dict[str, str]] = {}
    for action, host, path in rules:
        if action not in (ALLOW, BLOCK) or out.setdefault(host, {}).setdefault(path, action) != action:
            raise ValueError(f"rule {host}{path}: neither allow nor block, or both")
    return {h: sorted(paths.items(), key=lambda p: -len(p[0])) for h, paths in out.items()}


def fitting_rule(index: dict[str, list[tuple[str, str]]], host: str, path: str) -> tuple[str, str] | None:
    """(rule, action) of the longest rule that fits."""
    best, at = None, 0
    while at >= 0 and host:
        name = host[at:]
        for start, action in index.get(name, ()):
            if path.startswith(start):
                # Of equal lengths the longer host, which is met first.
                if best is None or len(name) + len(start) > best[0]:
                    best = (len(name) + len(start), name + start, action)
                break
        at = host.find(".", at) + 1 or -1
    return best and best[1:]


def vocabulary(strict: Sequence[str], soft: Sequence[str]):
    """The automaton of all terms; a strict term has an even number, a soft one an odd one."""
    import ahocorasick

    out = ahocorasick.Automaton()
    for odd, terms in enumerate((strict, soft)):
        for k, term in enumerate(dict.fromkeys(terms)):
            if not term or "\n" in term or term != term.translate(LOWER):
                raise ValueError(f"term {term!r}: empty, with a line break or a capital letter")
            if term in out:
                raise ValueError(f"term {term!r} is both strict and soft")
            out.add_word(term, (2 * k + odd, len(term)))
    if len(out):
        out.make_automaton()
    return out


LOWER = {c: c + 32 for c in range(65, 91)}
_ALNUM = np.zeros(128, bool)
_ALNUM[48:58] = _ALNUM[97:123] = True


def term_hits(automaton, urls: Sequence[str]) -> np.ndarray:
    """Distinct (url, term number) of all hits that stand alone, as rows."""
    text = "\n".join(["", *urls, ""]).translate(LOWER)
    flat = list(chain.from_iterable((end, *v) for end, v in automaton.iter(text))) if len(automaton) else []
    end, number, size = np.array(flat, np.int64).reshape(-1, 3).T
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    lone = np.ones(len(end), bool)
    for beside in (end + 1, end - size):
        c = code[beside]
        lone &= ~((c < 128) & _ALNUM[np.minimum(c, 127)])
    starts = np.cumsum([1, *[len(u) + 1 for u in urls]])
    hits = np.stack([np.searchsorted(starts, end[lone], "right") - 1, number[lone]], axis=1)
    return np.unique(hits, axis=0)


def judge(df: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, strict: Sequence[str] = STRICT, soft: Sequence[str] = SOFT, soft_limit: int = 2,
          id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, n_strict int, n_soft int) of every row."""
    if soft_limit < 1:
        raise ValueError("soft_limit must be at least 1")
    if sum(len(x.encode()) for part in (*rules, strict, soft) for x in part) > MOST_BYTES:
        raise ValueError(f"rules and terms of more than {MOST_BYTES} bytes")
    vocabulary(strict, soft)  # wrong terms are refused here, not in a task
    shipped = df.sparkSession.sparkContext.broadcast((rule_index(rules), tuple(strict), tuple(soft)))
    host, path = host_path(F.col(url_col))
    src = df.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host.alias("host"), path.alias("path"))
    id_type = src.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, strict, soft = shipped.value
        automaton = vocabulary(strict, soft)
        for batch in batches:
            for part in slices(batch, 1):
                n = part.num_rows
                found = [fitting_rule(index, h, p) for h, p in zip(part.column(2).to_pylist(), part.column(3).to_pylist())]
                hits = term_hits(automaton, pc.fill_null(part.column(1), "").to_pylist())
                n_soft = np.bincount(hits[hits[:, 1] % 2 == 1, 0], minlength=n)
                n_strict = np.bincount(hits[hits[:, 1] % 2 == 0, 0], minlength=n)
                blocked = (n_strict * soft_limit + n_soft >= soft_limit).tolist()
                verdict = [f[1] if f else BLOCK if b else ALLOW for f, b in zip(found, blocked)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), part.column(3), pa.array([f and f[0] for f in found], pa.string()), pa.array(verdict, pa.string()),
                     pa.array(n_strict, pa.int32()), pa.array(n_soft, pa.int32())], ["__id", "host", "path", "rule", "verdict", "n_strict", "n_soft"])

    out = src.mapInArrow(run, f"__id {id_type}, host string, path string, rule string, verdict string, n_strict int, n_soft int")
    return out.withColumnRenamed("__id", id_col)


def _sql_term(term: str) -> str:
    return f"regexp_matches(u, '(^|[^a-z0-9]){term}([^a-z0-9]|$)')::INTEGER"


_FITS = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{a} {h}{p}'"
                 for a, h, p in sorted(RULES, key=lambda r: (-len(r[1] + r[2]), -len(r[1]))))

#: DuckDB SQL of the registered query: the same rules, terms by regular expression.
ORACLE = f"""
WITH cut AS (SELECT page_id, translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS u,
                    CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, u, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
hits AS (SELECT page_id, host, path, CASE {_FITS} END AS fit, ({' + '.join(map(_sql_term, STRICT))})::INTEGER AS n_strict,
                ({' + '.join(map(_sql_term, SOFT))})::INTEGER AS n_soft FROM parts)
SELECT page_id, host, path, substr(fit, 7) AS rule,
       CASE WHEN fit IS NOT NULL THEN substr(fit, 1, 5) WHEN n_strict > 0 OR n_soft >= 2 THEN 'block' ELSE 'allow' END AS verdict, n_strict, n_soft
FROM hits
"""
