"""Rules of several words: automaton form against a plain search."""

import random

import pytest

from scrivener.functions.text import fold_key_py
from scrivener.operators import phrases as PH

RULES = [("alot of", "a lot of"), ("alot", "a lot"), ("of the", "of a"), ("Teh", "the"), ("teh same teh", "x"), ("..", "."), ("été là", "summer"), ("a\nb", "ab"), (None, "never"), ("", "never"), ("gone", None),
         ("could of", "could have"), ("İs", "is"), ("of", "off")]
TEXTS = ["Alot of the ALOT, alots of", "teh same teh same teh", "a..b...c", "..", "Été là! étéélà", "a\nb a\n b", "", None, " ", "teh", "xteh teh_ teh1 teh-teh", "could  of could of", "İS is ıs", "gone", "alot of of the end", "a" * 3000 + " alot"]


def plain(text):
    """All places, all rules, the leftmost and longest that stand alone."""
    if text is None:
        return None, []
    rules = {}
    for t, f in RULES:
        if t and f is not None:
            rules[fold_key_py(t)] = min(f, rules.get(fold_key_py(t), f))
    low, out, hits, i, n = PH.folded(text), "", [], 0, len(text)
    edge = lambda k: k in (0, n) or PH.is_word(text[k - 1]) != PH.is_word(text[k])
    while i < n:
        fits = [t for t in rules if low.startswith(t, i) and edge(i) and edge(i + len(t))]
        if fits:
            t = max(fits, key=len)
            out, i = out + rules[t], i + len(t)
            hits.append(t)
        else:
            out, i = out + text[i], i + 1
    return out, hits


@pytest.mark.parametrize("max_bytes", [PH.MAX_BYTES, 200])
def test_phrases_equal_plain_search(spark, max_bytes):
    rng = random.Random(1)
    pool = [t for t, _ in RULES if t] + [" ", " ", ",", "x", "é"]
    texts = TEXTS + ["".join(rng.choice(pool) for _ in range(rng.randrange(12))) for _ in range(200)]
    rows = [(i // 2 if i % 7 else None, t, "clash") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "n long, text string, lang string").repartition(3)
    rules = spark.createDataFrame(RULES, "typo string, fixed string")
    assert (len(PH._shards(PH._usable(rules, "typo", "fixed"), df, "text", max_bytes)) > 1) == (max_bytes == 200)
    got = sorted(map(str, (tuple(r) for r in PH.apply_phrases(df, rules, max_bytes=max_bytes).collect())))
    assert got == sorted(str((n, t, c, plain(t)[0])) for n, t, c in rows)
    hits = {r.typo: r.hits for r in PH.phrase_hits(df, rules, max_bytes=max_bytes).collect()}
    want: dict = {}
    for t in texts:
        for h in plain(t)[1]:
            want[h] = want.get(h, 0) + 1
    assert hits == want


def test_no_rules_and_no_rows(spark):
    df = spark.createDataFrame([(1, "alot")], "n long, text string")
    none = spark.createDataFrame([(None, "x")], "typo string, fixed string")
    assert [r.corrected for r in PH.apply_phrases(df, none).collect()] == ["alot"]
    assert PH.apply_phrases(df.limit(0), none).count() == 0 and PH.phrase_hits(df, none, by=()).count() == 0


def test_single_words_equal_the_dictionary(spark):
    from conftest import SMALL
    from scrivener.operators.dictionary import apply_dictionary
    from scrivener.sources import fixtures as FX
    from scrivener.sources.fixed import rules_df

    lines = FX.typo_lines(spark, SMALL).select("doc_id", "line_no", "typo_text")
    a = PH.apply_phrases(lines, rules_df(spark), "typo_text")
    b = apply_dictionary(lines, rules_df(spark), "typo_text")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    assert a.where("corrected <> typo_text").count() > 100


def test_job_takes_rules_and_examples(spark, tmp_path):
    import json

    from scrivener import jobs

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("alot of teh cats\n\nplain\n")
    rules = tmp_path / "rules.json"
    rules.write_text("\n".join(json.dumps({"typo": t, "fixed": f}) for t, f in [("alot of", "a lot of"), ("cats", "dogs")]))
    examples = tmp_path / "examples.csv"
    examples.write_text("ord,typo,fixed\n2,b,B\n1,a,A\n")
    args = ["--input", str(tmp_path / "in"), "--output-format", "verbose", "--output", str(tmp_path / "out"), "--rules", str(rules), "--examples", str(examples), "--model", "m1"]
    assert jobs.main(args) == 0
    got = "\n".join(r.value for r in spark.read.text(str(tmp_path / "out")).collect())
    assert "Output: a lot of teh dogs" in got and "Output: plain" in got and got.endswith("Processed 3 lines with model: m1")
    c = jobs._corrector(spark, jobs.build_parser().parse_args(args))
    assert c._examples == [(1, "a", "A"), (2, "b", "B")]


def test_single_report_names_the_model(spark):
    from scrivener.plans.corrector import Corrector

    df = spark.createDataFrame([(1, "teh cat")], "doc_id long, text string")
    got = [r.report for r in Corrector(model="m2").correct_single(df, output="verbose").collect()]
    assert got == ["Input:  teh cat\nOutput: the cat\nModel:  m2"]
