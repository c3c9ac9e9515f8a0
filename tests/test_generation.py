"""Generation: the n-gram decoder against brute force, the model step's tasks."""

import itertools
import math
import random
import re
from collections import Counter

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

import stub_model
from scrivener.operators import ngram as NG
from scrivener.operators.balance import equal_tasks
from scrivener.operators.generate import generate

cloudpickle.register_pickle_by_value(stub_model)  # the workers do not see the tests folder


def corpus(seed):
    """Lines of few words, so that bigrams repeat, some with a letter lost."""
    rng = random.Random(seed)
    follow = {w: rng.sample(["the", "then", "them", "cat", "cart", "sat", "été", "on"], 3) for w in ["<s>", "the", "then", "them", "cat", "cart", "sat", "été", "on"]}
    clean, typed = [], []
    for i in range(120):
        ws, at = [], "<s>"
        for _ in range(rng.randrange(1, 9)):
            at = rng.choice(follow[at])
            ws.append(at)
        clean.append((i, 0, "xx" if i % 2 else "yy", " ".join(ws)))
        if i < 30:
            bad = [w[:k] + w[k + 1:] if rng.random() < 0.5 and (k := rng.randrange(len(w))) >= 0 else w for w in ws]
            typed.append((i, 0, "xx" if i % 2 else "yy", rng.choice(["", "  ", "1. "]) + ", ".join(w.upper() if rng.random() < 0.2 else w for w in bad) + rng.choice(["", "!"])))
    return clean, typed + [(900, 0, "xx", ""), (901, 0, "yy", " .,; "), (902, 0, None, "teh ct"), (903, 0, "xx", None), (904, 0, "zz", "ct teh")]


WORD = re.compile(r"[^\W\d_]+")


def brute(clean, typed, cands, max_tokens=None):
    """Every path through every whole line."""
    out = {}
    for key, _, lang, text in typed:
        pairs = Counter()
        for _, _, l, t in clean:
            if l == lang and WORD.findall(t):
                ws = [NG.START, *WORD.findall(t.lower()), NG.END]
                pairs.update(zip(ws, ws[1:]))
        before = Counter(w for _, w in pairs)
        follow, c_u = Counter(u for u, _ in pairs), Counter()
        for (u, _), c in pairs.items():
            c_u[u] += c
        types, size = sum(before.values()), len(before) or 1

        def cost(u, w):
            least = (before[w] + 1) / (types + size)
            p = least if u not in c_u else (max(pairs[u, w] - NG.DISCOUNT, 0.0) + NG.DISCOUNT * follow[u] * least) / c_u[u]
            return math.floor(-1000 * math.log(p) + 0.5)

        ws = WORD.findall(text.lower()) if text else []
        options = [[(w, 0)] + ([(c, d * NG.EDIT_COST) for l, x, c, d in cands if (l, x) == (lang, w)] if max_tokens is None or k < max_tokens else []) for k, w in enumerate(ws)]
        best = min((sum(e for _, e in path) + sum(map(cost, [NG.START, *(c for c, _ in path)], [*(c for c, _ in path), NG.END])), [c for c, _ in path]) for path in itertools.product(*options))[1] if ws else []
        it = iter(zip(ws, best))
        out[key] = None if text is None else WORD.sub(lambda m: m.group() if (p := next(it))[0] == p[1] else p[1], text)
    return out


@pytest.mark.parametrize("seed,max_tokens", [(1, None), (2, None), (3, 2)])
def test_decoding_equals_all_paths_through_whole_lines(spark, seed, max_tokens):
    clean, typed = corpus(seed)
    schema = "doc_id long, line_no int, lang string, text string"
    c, t = spark.createDataFrame(clean, schema), spark.createDataFrame(typed, schema)
    from scrivener.operators.lexicon import build_lexicon, candidates

    lex = build_lexicon(c, "text")
    near = candidates(build_lexicon(t, "text").select("lang", "word"), lex).where("word <> cand").where(F.length("word") > 1)
    cands = [(r.lang, r.word, r.cand, r.dist) for r in near.collect()]
    got = {r.doc_id: r.raw_output for r in NG.generate_ngram(t, "text", reference=c, cands=near, max_tokens=max_tokens).collect()}
    want = brute(clean, typed, cands, max_tokens)
    assert got == want
    assert sum(got[k] != x for k, _, _, x in typed) > 3


def test_costs_are_a_distribution(spark):
    clean, _ = corpus(5)
    c = spark.createDataFrame(clean, "doc_id long, line_no int, lang string, text string")
    model = NG.train_bigrams(c)
    need = model.left.select("lang", "u").join(model.right.select("lang", "w"), "lang")
    sums = NG.bigram_costs(model, need).groupBy("lang", "u").agg(F.sum(F.exp(-F.col("cost") / 1000)).alias("p"))
    assert sums.where(F.abs(F.col("p") - 1) > 0.01).count() == 0 and sums.count() > 10


def test_temperature_top_k_and_seed_act(spark):
    clean, typed = corpus(7)
    schema = "doc_id long, line_no int, lang string, text string"
    c, t = spark.createDataFrame(clean, schema), spark.createDataFrame(typed, schema)
    from scrivener.operators.lexicon import build_lexicon, candidates

    near = candidates(build_lexicon(t, "text").select("lang", "word"), build_lexicon(c, "text")).where("word <> cand")
    run = lambda **o: {r.doc_id: r.raw_output for r in NG.generate_ngram(t, "text", reference=c, cands=near, **o).collect()}
    hot = run(temperature=5.0, seed=1)
    assert hot == run(temperature=5.0, seed=1) and hot != run(temperature=5.0, seed=2)
    one = run(temperature=5.0, top_k=1)
    assert one == run(temperature=0.01, top_k=1, seed=9) and one != hot
    assert run(max_tokens=0) == {k: x for k, _, _, x in typed}
    with pytest.raises(ValueError):
        run(temperature=-1)


def test_options_act_through_the_job(spark):
    from scrivener.plans.correct import fix_typos_with_options

    rows = [(i, 0, "the cat sat on the mat") for i in range(60)] + [(100 + i, 0, "the ct sat on the mt") for i in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, line_no int, text string")
    fixed = lambda n: {r.corrected for r in fix_typos_with_options(df, 0.0, n, backend="ngram").where("doc_id >= 100").collect()}
    assert fixed(50) == {"the cat sat on the mat"} and fixed(3) == {"the cat sat on the mt"}


def test_a_corrector_that_corrects_moves_the_accuracy(spark):
    """Lines whose injected typos are within reach ("teh" for "the"; the other
    injections put another word in place): most come back as they were, words
    that are rare and near a frequent one being rewritten too."""
    from conftest import MEDIUM
    from scrivener.sources import fixtures as FX

    lines = FX.typo_lines(spark, MEDIUM).where("lang = 'en'")
    near = F.replace("typo_text", F.lit(" teh "), F.lit(" the ")) == F.col("text")
    out = NG.generate_ngram(lines, "typo_text", reference=lines, ref_col="text").join(lines, ["doc_id", "line_no"]).where(near & (F.col("text") != F.col("typo_text")))
    assert out.count() > 100
    assert out.agg(F.avg((F.col("raw_output") == F.col("text")).cast("double"))).first()[0] > 0.65  # 0.71 at the time of writing


# ------------------------------------------------------------------ tasks of equal cost

@pytest.mark.parametrize("tasks", [1, 4, 16])
def test_tasks_cost_about_the_same(spark, tasks):
    rng = random.Random(3)
    rows = [(i, int(rng.paretovariate(1.1)) % 400 + (300 if i < 500 else 1)) for i in range(6000)]
    df = spark.createDataFrame(rows, "row long, cost long").repartition(7)
    got = equal_tasks(df, "row", "cost", tasks).select("row", "cost", "task").collect()
    assert sorted((r.row, r.cost) for r in got) == rows
    per = Counter()
    for r in got:
        per[r.task] += r.cost
    mean = sum(per.values()) / tasks
    assert set(per) == set(range(tasks)) and max(per.values()) <= 1.2 * mean
    order = [r.task for r in sorted(got, key=lambda r: r.row)]
    assert order == sorted(order)


def test_equal_tasks_of_nothing(spark):
    df = spark.createDataFrame([(1, 0), (2, 0)], "row long, cost long")
    assert {r.task for r in equal_tasks(df, "row", "cost", 3).collect()} <= {0, 1, 2}
    assert equal_tasks(df.limit(0), "row", "cost", 3).count() == 0


def test_model_batches_keep_to_the_token_budget(spark):
    rows = [(i, "w " * (i % 50 + 1), "side") if i % 9 else (i, None, "side") for i in range(500)]
    df = spark.createDataFrame(rows, "id long, prompt string, note string")
    got = generate(df, "prompt", stub_model.load_counting_model, max_tokens=5, temperature=0.7, normalise=False, strip_echo=False, tasks=3, batch_tokens=200).collect()
    assert sorted(r.id for r in got) == list(range(500))
    for r in got:
        assert (r.raw_output is None) == (r.prompt is None) and r.note == "side"
        if r.raw_output:
            n, cost, top_k = r.raw_output.split()
            assert int(cost) <= 200 and top_k == "40"
    long = spark.createDataFrame([(1, "w " * 900), (2, "w")], "id long, prompt string")
    got = {r.id: r.raw_output.split()[0] for r in generate(long, "prompt", stub_model.load_counting_model, max_tokens=5, normalise=False, strip_echo=False, batch_tokens=200).collect()}
    assert got == {1: "1", 2: "1"}
