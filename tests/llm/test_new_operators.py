"""URL filters, filter audit and lexical search against their definitions."""

import itertools
import math
import random
import re

import pytest

from scrivener.llm import op11_url_filter as url11
from scrivener.llm import op12_filter_audit as audit12
from scrivener.llm import op13_lexical_search as search13

# ------------------------------------------------------------------ URL filters

URLS = [
    "http://www.Cheap-Pills.example.org/en/450?page=2", "https://blog.x.EXAMPLE.net/en/1", "https://example.net/EN/1", "https://notexample.net/en/", "http://a.org/fr/casino",
    "http://a.org/de/casino", "http://a.com/de/casinos", "http://example.com/de/", "http://example.com/de", "http://sub.example.com/de/x#free", "http://net", "http://net/",
    "http://a.net?x=/", "http://a.com/?q=free&u=free", "http://a.com/?q=free&u=win", "http://a.com/FREE_bets", "http://a.com/été-free-été/slots", "http://a.com/éporné", "a.com/casino",
    "http://a.com/x://example.net/en/", "://", "://net/", "", None, "x" * 5000 + "://a.com/" + "free/" * 3000, "http://a.com/a\ncasino\nb", "http://user@example.net:80/en/", "HTTP://Ex.Org/fr/", "http://a.org./fr/",
]


def brute_url(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    low = lambda s: re.sub("[A-Z]", lambda m: m.group().lower(), s)
    host = low(re.match(r"[^/?#]*", rest).group())
    path = re.match(r"[^/?#]*([^?#]*)", rest).group(1)
    fits = [(len(h + p), len(h), h + p, a) for a, h, p in url11.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    hit = lambda t: re.search(rf"(?<![a-z0-9]){t}(?![a-z0-9])", low(url or "")) is not None
    strict, soft = sum(map(hit, url11.STRICT)), sum(map(hit, url11.SOFT))
    verdict = max(fits)[3] if fits else "block" if strict or soft > 1 else "allow"
    return host, path, max(fits)[2] if fits else None, verdict, strict, soft


def test_urls_equal_their_definition(spark):
    rows = [(i // 2 if i % 5 else None, u, "clash") for i, u in enumerate(URLS * 2)]
    df = spark.createDataFrame(rows, "page_id long, url string, host string")
    got = sorted(map(str, (tuple(r) for r in url11.judge(df).collect())))
    assert got == sorted(str((i, *brute_url(u))) for i, u, _ in rows)
    assert url11.judge(df.limit(0)).count() == 0


def test_longest_rule_wins_and_terms_weigh(spark):
    df = spark.createDataFrame([(1, "http://a.b.c/x/y"), (2, "http://b.c/x"), (3, "http://z/one-two"), (4, "http://z/one-two-three"), (5, "http://z/never")], "page_id long, url string")
    rules = [("block", "c", "/"), ("allow", "b.c", "/"), ("block", "a.b.c", "/x/"), ("allow", "a.b.c", "")]
    got = {r.page_id: (r.rule, r.verdict) for r in url11.judge(df, rules, ["never"], ["one", "two", "three"], soft_limit=3).collect()}
    assert got == {1: ("a.b.c/x/", "block"), 2: ("b.c/", "allow"), 3: (None, "allow"), 4: (None, "block"), 5: (None, "block")}
    assert url11.judge(df, [], [], []).where("verdict <> 'allow'").count() == 0
    for wrong in ({"strict": ["A"]}, {"soft": [""]}, {"strict": ["free"]}, {"rules": [("maybe", "c", "/")]}, {"soft_limit": 0}):
        with pytest.raises(ValueError):
            url11.judge(df, **wrong).count()


# ------------------------------------------------------------------ filter audit

def test_plain_changes_visit_every_order():
    for n in range(1, 6):
        order, seen = list(range(n)), {tuple(range(n))}
        for k in audit12.plain_changes(n):
            order[k], order[k + 1] = order[k + 1], order[k]
            seen.add(tuple(order))
        assert len(seen) == math.factorial(n)


@pytest.mark.parametrize("seed", range(6))
def test_diagram_equals_counting_per_order(seed):
    rng = random.Random(seed)
    letters = "ABCDE"[: seed or 5]
    masks = rng.sample(range(1 << len(letters)), rng.randrange(1, 1 << len(letters)))
    counts = {m: (n := rng.randrange(1, 9), rng.randrange(n + 1), rng.randrange(n + 1)) for m in masks}
    got = sorted(audit12.every_order(letters, counts))
    removed, rows = {c: 0 for c in letters}, []
    for order in itertools.permutations(letters):
        before = 0
        for k, c in enumerate(order):
            bit = 1 << letters.index(c)
            pick = lambda ok, col=0: sum(v[col] for m, v in counts.items() if ok(m))
            gone = lambda m: not m & before and m & bit
            removed[c] += pick(gone)
            rows.append(("".join(order), k + 1, pick(lambda m: not m & (before | bit)), pick(gone), pick(lambda m: m & before and m & bit), pick(lambda m: m == bit), pick(gone, 1), pick(gone, 2), c))
            before |= bit
    assert got == sorted((*r[:-1], removed[r[-1]]) for r in rows)


def test_reordering_keeps_one_node_per_function():
    counts = {m: (1, 0, 0) for m in range(32)}
    diagram = audit12.CountDiagram(5, counts)
    for k in [0, 1, 2, 3, 2, 1, 0]:
        diagram.swap(k)
        assert [len(level) for level in diagram.nodes] == [1] * 5


def audit_rows(seed=0):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(150)]
    out = []
    for i in range(120):
        n = rng.choice([0, 3, 199, 200, 260])
        words = [rng.choice(vocab[: rng.choice([20, 150])]) for _ in range(n)]
        if rng.random() < 0.3:
            words += [rng.choice(["A", "QUITE LOUD TEXT " * 4, "#", "5%", "été\u00a0x"])]
        out.append((i, " ".join(words), rng.choice(["s1", "s2", "", None])))
    return out + [(5, out[7][1], "s1"), (5, out[7][1], "s1"), (3, out[3][1], "s9"), (None, out[8][1], "s2"), (None, "only without id", "s2"), (None, "only without id", None), (200, None, "s1"), (201, None, "s2")]


def test_audit_equals_brute_force(spark):
    data = audit_rows(1)
    labels = [(i, i % 3 == 0, i % 4 == 0) for i in range(0, 100, 2)] + [(5, True, False), (5, False, True), (None, True, True), (9999, True, True)]
    df = spark.createDataFrame([(i, t, s, 1) for i, t, s in data], "doc_id long, text string, source string, mask int")
    lab = spark.createDataFrame([(i, int(q), int(x)) for i, q, x in labels], "doc_id long, quality int, toxic int")
    parts: dict = {}
    for i, t, s in data:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        low = lambda k: math.inf if k is None else k
        fail = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search("[#$%&*|]", t)), any((u or "") == t and low(j) < low(i) for j, u, _ in data)]
        mask = sum(1 << k for k, f in enumerate(fail) if f)
        mine = [(q, x) for j, q, x in labels if j == i and i is not None]
        c = parts.setdefault(s or "", {}).setdefault(mask, [0, 0, 0])
        for k, v in enumerate((1, any(q for q, _ in mine), any(x for _, x in mine))):
            c[k] += v
    want = sorted((p, *r) for p, counts in parts.items() for r in audit12.every_order("ABCDE", {m: tuple(v) for m, v in counts.items()}))
    assert sorted(tuple(r) for r in audit12.audit(df, lab).collect()) == want
    assert audit12.audit(df.limit(0), lab).count() == 0
    assert audit12.audit(df, lab.limit(0)).where("good_lost + toxic_lost > 0").count() == 0


def test_audit_of_other_filters(spark):
    df = spark.createDataFrame([(1, "a", "s"), (2, "bb", "s"), (3, "bb", "s")], "doc_id long, text string, source string")
    from pyspark.sql import functions as F

    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = audit12.audit(df, lab, {"L": F.char_length("text") > 1}, copies=None).collect()
    assert [tuple(r) for r in got] == [("s", "L", 1, 1, 2, 0, 2, 0, 0, 2)]
    with pytest.raises(ValueError):
        audit12.audit(df, lab, {"E": F.lit(True)})


# ------------------------------------------------------------------ lexical search

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute_search(docs, items, k):
    bags = [terms(t) for _, t in docs]
    n_docs, total = sum(map(bool, bags)), sum(map(len, bags))
    queries: dict = {}
    for i, t in items:
        queries.setdefault(i, set()).update(terms(t))
    out = []
    for i, q in queries.items():
        df = {t: sum(t in b for b in bags) for t in q}
        w = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in q}
        found = []
        for (d, _), b in zip(docs, bags):
            m = 10 + (90 * len(b) * n_docs) // max(1, total)
            s = sum(w[t] * ((10**9 * tf) // (1000 * tf + 8 * m)) for t in q if (tf := b.count(t)))
            if s > 0:
                found.append((-s, math.inf if d is None else d))
        out += [(i, r + 1, None if d == math.inf else d, -s) for r, (s, d) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def search_rows(seed=0):
    rng = random.Random(seed)
    vocab = ["the", "of", "été", "日本", "x1", "i̇", "ÀB", "ſ", "K"] + [f"w{i}" for i in range(60)]
    sep = [" ", ", ", "\n", "_", "\x7f", "-", "  ", "\x00"]
    text = lambda n: "".join(rng.choice(vocab).upper() if rng.random() < 0.1 else rng.choice(vocab) + rng.choice(sep) for _ in range(n))
    docs = [(i, text(rng.randrange(60))) for i in range(80)]
    docs += [(100 + i, docs[3][1]) for i in range(15)] + [(3, docs[3][1]), (None, docs[3][1]), (None, "the"), (200, None), (201, ""), (202, " ,.!"), (203, "the " * 4000), (204, "\u00a0the\u2003of")]
    items = [(i, text(rng.randrange(1, 12))) for i in range(12)] + [(50, None), (51, ""), (52, "nowhere"), (7, "the extra"), (None, "w1 w2"), (53, "the the THE")]
    return docs, items


@pytest.mark.parametrize("block", [8 << 20, 100])
def test_search_equals_brute_force(spark, block):
    docs, items = search_rows(2)
    d = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, score int").repartition(5)
    q = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((tuple(r) for r in search13.search(d, q, k=4, block_bytes=block).collect()), key=str)
    assert got == brute_search(docs, items, 4)


def test_search_of_empty_tables(spark):
    docs, items = search_rows(3)
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert search13.search(d.limit(0), q).count() == 0
    assert search13.search(d, q.limit(0)).count() == 0
    assert search13.search(d, q.where("item_id = 51")).columns == ["item_id", "rank", "doc_id", "score"]


@pytest.mark.parametrize("exact", [True, False])
def test_small_work_blocks_give_the_same_scores(spark, monkeypatch, exact):
    import numpy as np

    docs, items = search_rows(4)
    number = {t: k for k, t in enumerate(sorted({t for _, x in items for t in terms(x)}))}
    found = search13.automaton(sorted(number))
    n, doc, term, tf = search13.scan(found, [t and t.encode() for _, t in docs])
    assert n.tolist() == [len(terms(t)) for _, t in docs]
    postings = [np.array([i for i, (_, x) in enumerate(items) if t in terms(x)]) for t in number]
    runs = []
    for cells in (1 << 21, 40):
        monkeypatch.setattr(search13, "CELLS", cells)
        scorer = search13.Scorer(np.full(len(number), 700), postings, len(items), 80, 2000, 3)
        scorer.exact = exact
        scorer.add(np.arange(len(docs)), n, doc, term, tf)
        runs.append(scorer.rows().to_pylist())
    assert runs[0] == runs[1] and runs[0]
