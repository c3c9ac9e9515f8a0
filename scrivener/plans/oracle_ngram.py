"""DuckDB SQL of the n-gram generator: the same model and lattice, decoded per
distinct island by a recursive query, one word a round."""

from __future__ import annotations

from scrivener.operators import ngram as NG
from scrivener.operators.lexicon import DEFAULT_RATIO, NON_WORD_PATTERN, WORD_PATTERN
from scrivener.plans import oracle_parts as O


def _words(col: str) -> str:
    return f"list_transform(regexp_extract_all({col}, '{WORD_PATTERN}'), lambda w: lower(w))"


def _variants(w: str) -> str:
    return f"unnest(list_distinct(list_concat([{w}], list_transform(range(1, length({w}) + 1), lambda i: substr({w}, 1, i - 1) || substr({w}, i + 1)))))"


def ngram_ctes(inp: str, inp_col: str, ref: str, ref_col: str, temperature: float = 0.0, top_k: int = NG.TOP_K, max_tokens: int | None = None, seed: int = 0) -> str:
    """CTEs ending in ng_raw (all columns of ``inp``, raw_output)."""
    cut = "" if max_tokens is None else f" AND pos < {max_tokens}"
    reach = f"""SELECT v.id, o.n, o.cand, o.emit + c.cost AS step, v.cost + o.emit + c.cost AS cost, v.path FROM ng_walk v
    JOIN ng_o o ON o.id = v.id AND o.n = v.n + 1 JOIN ng_cost c ON c.lang = o.lang AND c.u = v.cand AND c.w = o.cand"""
    if temperature == 0:
        walk = f"""SELECT id, n, cand, cost, list_append(path, cand) AS path FROM ({reach})
  QUALIFY row_number() OVER (PARTITION BY id, cand ORDER BY cost, list_append(path, cand)) = 1"""
    else:
        noise = f"(('0x' || substr(md5('{seed}|' || name || '|' || n || '|' || cand), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0"
        walk = f"""SELECT id, n, cand, cost, list_append(path, cand) AS path FROM (
    SELECT *, -(step::DOUBLE) / {1000.0 * temperature} - ln(-ln({noise})) AS key FROM (
      SELECT r.*, d.name FROM ({reach}) r JOIN ng_d d USING (id) QUALIFY row_number() OVER (PARTITION BY id ORDER BY step, cand) <= {top_k}))
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY key DESC, cand DESC) = 1"""
    return f"""
ng_lines AS MATERIALIZED (SELECT row_number() OVER () AS lid, *, {_words(inp_col)} AS ws FROM {inp}),
ng_ref AS MATERIALIZED (SELECT lang, {_words(ref_col)} AS ws FROM {ref}),
ng_seq AS (SELECT lang, list_concat(['{NG.START}'], ws, ['{NG.END}']) AS seq FROM ng_ref WHERE len(ws) > 0),
ng_pairs AS MATERIALIZED (SELECT lang, u, w, count(*) AS c FROM (SELECT lang, unnest(seq[1:len(seq) - 1]) AS u, unnest(seq[2:len(seq)]) AS w FROM ng_seq) GROUP BY lang, u, w),
ng_left AS (SELECT lang, u, sum(c) AS c_u, count(*) AS followers FROM ng_pairs GROUP BY lang, u),
ng_right AS MATERIALIZED (SELECT lang, w, count(*) AS before FROM ng_pairs GROUP BY lang, w),
ng_total AS (SELECT lang, sum(before) AS types, count(*) AS size FROM ng_right GROUP BY lang),
ng_counts AS MATERIALIZED (SELECT lang, word, count(*) AS freq FROM (SELECT lang, unnest(ws) AS word FROM ng_ref) GROUP BY lang, word),
ng_words AS (SELECT DISTINCT lang, unnest(ws) AS word FROM ng_lines),
ng_wv AS (SELECT lang, word, {_variants('word')} AS variant FROM ng_words),
ng_cv AS (SELECT lang, word, freq, {_variants('word')} AS variant FROM ng_counts WHERE freq >= {DEFAULT_RATIO}),
ng_near AS (SELECT DISTINCT w.lang, w.word, c.word AS cand, c.freq FROM ng_wv w JOIN ng_cv c ON w.lang = c.lang AND w.variant = c.variant AND w.word <> c.word),
ng_dist AS (SELECT n.*, CAST(levenshtein({O.one_byte('n.word')}, {O.one_byte('n.cand')}) AS INTEGER) AS dist, coalesce(o.freq, 0) AS own
  FROM ng_near n LEFT JOIN ng_counts o ON n.lang = o.lang AND n.word = o.word),
ng_cand AS MATERIALIZED (SELECT lang, word, cand, dist FROM ng_dist WHERE freq >= pow({DEFAULT_RATIO}, dist) * own),
ng_opt AS MATERIALIZED (SELECT lang, word, cand, (dist * {NG.EDIT_COST})::BIGINT AS emit FROM ng_cand UNION ALL SELECT DISTINCT lang, word, word, 0::BIGINT FROM ng_cand),
ng_toks AS (SELECT lid, lang, ws, unnest(range(0, len(ws))) AS pos FROM ng_lines),
ng_hits AS (SELECT lid, lang, pos, ws[pos + 1] AS word, CASE WHEN pos = 0 THEN '{NG.START}' ELSE ws[pos] END AS prev, coalesce(ws[pos + 2], '{NG.END}') AS next
  FROM ng_toks t WHERE EXISTS (SELECT 1 FROM ng_cand c WHERE c.lang = t.lang AND c.word = t.ws[t.pos + 1]){cut}),
ng_runs AS (SELECT *, pos - row_number() OVER (PARTITION BY lid ORDER BY pos) AS run FROM ng_hits),
ng_isl AS MATERIALIZED (SELECT lid, lang, min(pos) AS start, arg_min(prev, pos) AS lft, list(word ORDER BY pos) AS typed, arg_max(next, pos) AS rgt FROM ng_runs GROUP BY lid, lang, run),
ng_d AS MATERIALIZED (SELECT row_number() OVER () AS id, *, lang || '|' || lft || ' ' || array_to_string(typed, ' ') || ' ' || rgt AS name
  FROM (SELECT DISTINCT lang, lft, typed, rgt FROM ng_isl)),
ng_places AS (SELECT id, lang, unnest(typed) AS word, unnest(range(1, len(typed) + 1)) AS n FROM ng_d),
ng_o AS MATERIALIZED (SELECT p.id, p.n, p.lang, o.cand, o.emit FROM ng_places p JOIN ng_opt o ON o.lang = p.lang AND o.word = p.word
  UNION ALL SELECT id, len(typed) + 1, lang, rgt, 0 FROM ng_d UNION ALL SELECT id, 0, lang, lft, 0 FROM ng_d),
ng_need AS (SELECT DISTINCT a.lang, a.cand AS u, b.cand AS w FROM ng_o a JOIN ng_o b ON a.id = b.id AND b.n = a.n + 1),
ng_p AS (SELECT n.lang, n.u, n.w, c, c_u, followers, (coalesce(before, 0) + 1)::DOUBLE / (coalesce(types, 0) + coalesce(size, 1)) AS least
  FROM ng_need n LEFT JOIN ng_total t ON t.lang = n.lang LEFT JOIN ng_pairs p ON p.lang = n.lang AND p.u = n.u AND p.w = n.w
  LEFT JOIN ng_left l ON l.lang = n.lang AND l.u = n.u LEFT JOIN ng_right r ON r.lang = n.lang AND r.w = n.w),
ng_cost AS MATERIALIZED (SELECT lang, u, w, round(-1000 * ln(CASE WHEN c_u IS NULL THEN least
  ELSE (greatest(coalesce(c, 0)::DOUBLE - {NG.DISCOUNT}::DOUBLE, 0.0::DOUBLE) + {NG.DISCOUNT}::DOUBLE * followers::DOUBLE * least) / c_u::DOUBLE END))::BIGINT AS cost FROM ng_p),
ng_walk AS (SELECT id, 0 AS n, lft AS cand, 0::BIGINT AS cost, []::VARCHAR[] AS path FROM ng_d
  UNION ALL
  {walk}),
ng_words_out AS MATERIALIZED (SELECT d.lang, d.lft, d.typed, d.rgt, w.path[1:len(d.typed)] AS words FROM ng_walk w JOIN ng_d d USING (id) WHERE w.n = len(d.typed) + 1),
ng_changes AS (SELECT lid, start + k AS pos, was, word FROM (SELECT i.lid, i.start, unnest(range(0, len(i.typed))) AS k, unnest(i.typed) AS was, unnest(o.words) AS word
  FROM ng_isl i JOIN ng_words_out o ON i.lang = o.lang AND i.lft = o.lft AND i.typed = o.typed AND i.rgt = o.rgt) WHERE was <> word),
ng_pieces AS (SELECT lid, p[j] AS piece, j, (j - 1 - CASE WHEN regexp_matches(p[1], '^{WORD_PATTERN}$') THEN 0 ELSE 1 END) AS at FROM (
  SELECT lid, p, unnest(range(1, len(p) + 1)) AS j FROM (SELECT lid, regexp_extract_all({inp_col}, '{WORD_PATTERN}|{NON_WORD_PATTERN}') AS p FROM ng_lines
    WHERE lid IN (SELECT lid FROM ng_changes)))),
ng_fixed AS (SELECT x.lid, string_agg(coalesce(c.word, x.piece), '' ORDER BY x.j) AS raw_output
  FROM ng_pieces x LEFT JOIN ng_changes c ON c.lid = x.lid AND x.at % 2 = 0 AND c.pos = x.at // 2 GROUP BY x.lid),
ng_raw AS (SELECT l.* EXCLUDE (lid, ws), coalesce(f.raw_output, l.{inp_col}) AS raw_output FROM ng_lines l LEFT JOIN ng_fixed f USING (lid))"""
