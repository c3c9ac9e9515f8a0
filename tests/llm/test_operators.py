"""The operators on small tables with nulls, ties, repeats and clashing names."""

import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from llm_brute import groups, mix as brute_mix, repeated_bytes, simhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from conftest import SMALL
from scrivener.llm import op2_simhash, op3_kd_search, op4_embedding_dedup, op6_language_id, op8_mixing, op9_bpe, op10_token_files
from scrivener.llm.components import components
from scrivener.llm.op1_token_counts import count_tokens

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, fp string, row int, tag int, size int, word string"
WORD_BPE, BYTE_BPE = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json")


def documents(seed=0, n=60):
    rng = random.Random(seed)
    vocab = {"en": "the and of with house tree running".split(), "fr": "le la été où maison très garçon".split()}
    out = []
    for i in range(n):
        lang = rng.choice(["en", "fr"])
        text = " ".join(rng.choice(vocab[lang]) for _ in range(rng.randrange(1, 80)))
        out.append((i, text, lang, rng.choice(["s1", "s2", "s2", "s2", "é", None])))
    base = out[3][1]
    out += [(200 + k, base + " " + "x" * k, "en", "s1") for k in range(6)]
    out += [(300, base, None, "s2"), (300, base, None, "s2"), (300, out[4][1], "en", None), (None, base, "en", "s1"), (None, "only null id here", "en", "s9")]
    out += [(400, None, "en", "s1"), (401, "", "fr", "s1"), (402, "12 34 !! \n", None, "s1"), (403, "Ab", "en", "s1"), (404, ("word " * 9000).strip(), "en", "s2"), (405, "y" * 40_000, "en", "s2")]
    rng.shuffle(out)
    return out


def frame(spark, data):
    return spark.createDataFrame([(i, t, lang, s, None, "c", "c", 1, 2, 3, "w") for i, t, lang, s in data], DOCS)


def none(i):
    return (i is None, i or 0)


def test_token_counts(spark):
    tok, data = Tokenizer.from_file(BYTE_BPE), documents(1)
    got = sorted((none(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in count_tokens(frame(spark, data), BYTE_BPE).collect())
    counts = [(i, t or "", len(tok.encode(t or "", add_special_tokens=False).ids)) for i, t, _, _ in data]
    assert got == sorted((none(i), len(t.encode()), n, n > 512) for i, t, n in counts)
    assert count_tokens(frame(spark, []), BYTE_BPE).count() == 0


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1120)] + [(2000, 2000), (None, 5), (7, None)]
    links += [(3000, 3000 + i) for i in range(200)]
    found = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    up = {}

    def top(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            a, b = top(a), top(b)
            up[max(a, b)] = min(a, b)
    nodes = {x for a, b in links if a is not None and b is not None and a != b for x in (a, b)}
    assert found == {x: top(x) for x in nodes}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("distance,segments,crowd", [(2, 16, 64), (2, 16, 1), (3, 16, 1), (2, 32, 64), (1, 64, 64)])
def test_simhash_links(spark, distance, segments, crowd):
    rng = random.Random(distance)
    fps = set()
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(20):
            fps.add(x)
            for _ in range(rng.randrange(0, distance + 2)):
                x ^= 1 << rng.randrange(64)
    fps = sorted({int(np.uint64(x).astype(np.int64)) for x in fps} | {0, -1})
    links = op2_simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long"), distance, segments, crowd)
    roots = {r.node: r.root for r in components(links).collect()}
    far = lambda a, b: bin((a ^ b) & (1 << 64) - 1).count("1")
    want = groups(len(fps), lambda i, j: far(fps[i], fps[j]) <= distance)
    got = [roots.get(x, x) for x in fps]
    assert len(set(zip(want, got))) == len(set(want)) == len(set(got))


def test_simhash_components(spark):
    data = documents(2)
    df = frame(spark, data)
    fps = [simhash(t) for _, t, _, _ in data]
    group = groups(len(data), lambda i, j: bin(fps[i] ^ fps[j]).count("1") <= 2)
    first = {}
    for (i, *_), g in zip(data, group):
        if i is not None:
            first[g] = min(first.get(g, i), i)
    got = sorted((none(r.doc_id), r.fingerprint, none(r.component_id)) for r in op2_simhash.simhash_components(df).collect())
    assert got == sorted((none(i), f"{f:016x}", none(first.get(g))) for (i, *_), f, g in zip(data, fps, group))
    kept = op2_simhash.keep_one(df).collect()
    assert sorted(none(r.doc_id) for r in kept) == sorted(none(first.get(g)) for g in set(group))
    assert op2_simhash.simhash_components(frame(spark, [])).count() == 0


def vectors(seed=0, n=150, dim=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, dim))
    out = [(i, [float(x) for x in (centres[i % 5] + rng.normal(size=dim) * 0.25).astype(np.float32)]) for i in range(n)]
    out += [(1000 + i, out[7][1]) for i in range(60)] + [(2000 + i, [2 * x for x in out[8][1]]) for i in range(3)]
    out += [(3000, None), (3001, [0.0] * dim), (3002, [float("nan")] + [1.0] * (dim - 1)), (3003, [None] + [1.0] * (dim - 1)), (3004, [float("inf")] * dim), (3005, [1.0, 2.0])]
    out += [(None, out[7][1]), (20, out[20][1]), (3006, [])]
    return out


VECS = "vec_id long, embedding array<float>, label int, id string, v int, tile int"


def vec_frame(spark, data):
    return spark.createDataFrame([(i, v, 1, "c", 2, 3) for i, v in data], VECS)


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(op3_kd_search, "SHARD_ROWS", 40)
    monkeypatch.setattr(op3_kd_search, "BLOCK_QUERIES", 4)
    data = vectors(1)
    # Rows that share an id are rows of their own, as queries and as candidates.
    quantised = [(i, tuple(math.floor(64 * x) for x in v)) for i, v in data if i is not None and usable(v)]
    want = []
    for n, (q, u) in enumerate(quantised):
        if q % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(u, v)), i) for m, (i, v) in enumerate(quantised) if m != n and len(u) == len(v))[:20]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert sum(q == 20 for q, *_ in want) == 40 and (20, 20) in {(q, i) for q, _, i, _ in want}
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in op3_kd_search.top_k(vec_frame(spark, data), F.col("id") % 20 == 0).collect()]
    assert sorted(got) == sorted(want)
    assert op3_kd_search.top_k(vec_frame(spark, []), F.col("id") % 20 == 0).count() == 0


@pytest.mark.parametrize("big", [False, True])
def test_kd_tree_bounds_and_search(big):
    rng = np.random.default_rng(3)
    vecs = rng.integers(-70, 70, (700, 8))
    vecs[100:400] = vecs[5]
    if big:
        vecs = vecs * (1 << 22)
    ids = rng.permutation(700)
    rows = ids + 5000
    tree = op3_kd_search.Tree.build(ids, rows, vecs)
    queries = vecs[:30]
    for q, bound in zip(queries, tree.bounds(queries)):
        scores = tree.vecs @ q
        assert all(scores[tree.start[n]: tree.end[n]].max() <= bound[n] for n in range(len(tree.start)))
    want = []
    for n, (q, own) in enumerate(zip(queries, ids[:30].tolist())):
        want.append(sorted(((int(s), -int(i)) for s, i in zip(tree.vecs @ q, tree.ids) if i != own), reverse=True)[:20])
    for least in (np.full(30, op3_kd_search.LOWEST), np.array([w[-1][0] for w in want])):
        of, got, score = tree.search(queries, rows[:30], 20, least)
        assert [[(int(s), -int(i)) for o, i, s in zip(of, got, score) if o == n] for n in range(30)] == want


def test_embedding_components(spark, monkeypatch):
    monkeypatch.setattr(op4_embedding_dedup, "TILE_ROWS", 16)
    monkeypatch.setattr(op4_embedding_dedup, "PIVOTS", 7)
    data = vectors(2)

    def cos(a, b):
        a, b = np.array(a, np.float64), np.array(b, np.float64)
        return a @ b / (math.sqrt(a @ a) * math.sqrt(b @ b))

    ok = [usable(v) and any(v) for _, v in data]
    near = lambda i, j: ok[i] and ok[j] and len(data[i][1]) == len(data[j][1]) and cos(data[i][1], data[j][1]) >= 0.9
    n = [sum(near(i, j) for j in range(len(data)) if j != i) for i in range(len(data))]
    # Rows that share an id are one node.
    group = groups(len(data), lambda i, j: near(i, j) or (data[i][1] == data[j][1] and data[i][0] == data[j][0]))
    first = {}
    for (i, _), g in zip(data, group):
        if i is not None:
            first[g] = min(first.get(g, i), i)
    want = [(none(i), k, none(first.get(g)), i is not None and i == first.get(g)) for (i, _), k, g in zip(data, n, group)]
    got = [(none(r.vec_id), r.n_links, none(r.component_id), r.kept) for r in op4_embedding_dedup.embedding_components(vec_frame(spark, data)).collect()]
    assert sorted(got) == sorted(want)
    assert op4_embedding_dedup.embedding_components(vec_frame(spark, [])).count() == 0


def test_int8_products_find_every_pair():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(900, 32)) * 0.3 + rng.normal(size=(1, 32))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    cos = u @ u.T
    for threshold in (0.5, 0.9, 0.97):
        found = {(a, b) for i, j in op4_embedding_dedup.linked(x, x, threshold, True) for a, b in zip(i.tolist(), j.tolist())}
        clear = np.abs(cos - threshold) > 1e-12
        assert found == {(a, b) for a in range(900) for b in range(a + 1, 900) if cos[a, b] >= threshold} or not clear.all()


def test_language_id(spark):
    df = frame(spark, documents(3, 200))
    got = op6_language_id.identify(df).join(df.select("doc_id", "text", "lang").dropDuplicates(["doc_id"]), "doc_id").collect()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1
        if not any(c.isalpha() for c in r.text or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
    fair = [r for r in got if r.held_out and r.doc_id < 200 and len(r.text) > 40]
    assert sum(r.lang_pred == r.lang for r in fair) >= 0.95 * len(fair)
    assert op6_language_id.identify(df).count() == df.count()
    unlabelled = df.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in op6_language_id.identify(unlabelled).select("lang_pred").distinct().collect()} == {"und"}
    assert op6_language_id.identify(frame(spark, [])).count() == 0


def test_language_vectors_do_not_depend_on_blocks(monkeypatch):
    texts = ["Ça va bien, merci!  12 et toi?" * 20, "日本語テキスト" * 9, "x", "", None, "a-b"]
    whole = op6_language_id.text_vectors(texts)
    monkeypatch.setattr(op6_language_id, "_BLOCK", 17)
    assert (op6_language_id.text_vectors(texts) == whole).all()
    # By the definition: sum of rho(rho(a)) * rho(b) * c over the 3-grams of " x ".
    a, x = (1.0 - 2.0 * op6_language_id.letter_vectors(np.array([ord(c)]))[0].astype(float) for c in " x")
    assert (whole[2] == np.roll(a, 2) * np.roll(x, 1) * a).all()


@pytest.mark.parametrize("bucket", [2_000, 3])
def test_mix(spark, monkeypatch, bucket):
    monkeypatch.setattr(op8_mixing, "PER_BUCKET", bucket)
    data = documents(5)
    size, total, goal, taken = brute_mix([(i, s, t, 0) for i, t, _, s in data])
    got = sorted((none(r.doc_id), r.size, r.source_size, round(r.target, 6), r.taken) for r in op8_mixing.mix(frame(spark, data)).collect())
    assert got == sorted((none(i), n, total[s], round(goal[s], 6), n * k) for (i, _, _, s), n, k in zip(data, size, taken))
    assert op8_mixing.mix(frame(spark, [])).count() == 0
    assert op8_mixing.mix(frame(spark, [(1, "", "en", "a"), (2, None, "en", None)])).agg(F.sum("taken")).first()[0] == 0


def test_bpe_round_trip(spark):
    tok, data = Tokenizer.from_file(WORD_BPE), documents(6)
    got = sorted((none(r.doc_id), r.ids, r.n_tokens, r.decoded) for r in op9_bpe.encode_decode(frame(spark, data), WORD_BPE).collect())
    want = []
    for i, t, _, _ in data:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want.append((none(i), " ".join(map(str, ids)), len(ids), tok.decode(ids, skip_special_tokens=False)))
    assert got == sorted(want)
    assert op9_bpe.encode_decode(frame(spark, []), WORD_BPE).count() == 0


def test_token_files(spark, tmp_path):
    import pyarrow.parquet as pq

    tok, data = Tokenizer.from_file(WORD_BPE), documents(7)
    op10_token_files.write_tokens(frame(spark, data), str(tmp_path / "t"), WORD_BPE)
    got = sorted(op10_token_files.ids_crc32(op10_token_files.read_tokens(spark, str(tmp_path / "t"))).collect(), key=lambda r: r.start)
    ordered = sorted(data, key=lambda r: (none(r[0]), hashlib.md5((r[1] or "").encode()).hexdigest()))
    start = 0
    for r, (i, t, _, _) in zip(got, ordered, strict=True):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    file = next(f for f in sorted((tmp_path / "t").glob("*.parquet")) if pq.ParquetFile(f).metadata.num_rows)
    column = pq.ParquetFile(file).metadata.row_group(0)
    ids = next(column.column(k) for k in range(column.num_columns) if column.column(k).path_in_schema.startswith("ids"))
    assert any("DICT" in e for e in ids.encodings) and ids.has_offset_index
    op10_token_files.write_tokens(frame(spark, []), str(tmp_path / "e"), WORD_BPE)
    assert op10_token_files.read_tokens(spark, str(tmp_path / "e")).count() == 0


def brute_pipeline(data):
    """(doc_id, n_tokens, digests) of the five stages, documents as (id, text, lang, source, tag)."""
    tok = Tokenizer.from_file(WORD_BPE)
    data = [d for d in data if any(c.isalpha() for c in d[1] or "")]
    fps = [simhash(d[1]) for d in data]
    group = groups(len(data), lambda i, j: bin(fps[i] ^ fps[j]).count("1") <= 2)
    best = {}
    for d, g in zip(data, group):
        key = (none(d[0]), d[4])
        if g not in best or key < best[g][0]:
            best[g] = key, d
    data = [d for _, d in best.values()]
    kept = repeated_bytes([(d[0], d[1].encode()) for d in data])
    data = [(d[0], k.decode("utf-8", "ignore"), d[2], d[3]) for d, k in zip(data, kept)]
    _, _, _, taken = brute_mix([(i, s, t, 0) for i, t, _, s in data])
    out = []
    for (i, t, _, _), n in zip(data, taken):
        ids = tok.encode(t, add_special_tokens=False).ids
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        out += [(none(i), len(ids), sha(" ".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False)))] * n
    return sorted(out)


def test_pipeline_equals_brute_force(spark, tmp_path):
    data = [d for d in documents(8) if d[0] != 405] + [(500 + k, f"{documents(8)[k][1] or ''} {'very shared passage of many plain words ' * 3}", "en", "s2") for k in range(8)]
    df = spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in data], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    tagged = spark.read.parquet(str(tmp_path / "documents.parquet"))
    tags = tagged.select("doc_id", "text", "lang", "source", F.xxhash64(*tagged.columns)).collect()
    got = sorted((none(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == brute_pipeline([tuple(r) for r in tags])
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == tagged.columns, name


def test_queries_read_the_small_tables(spark):
    from scrivener.llm.queries import QUERIES

    n = spark.read.parquet(f"{SMALL}/documents.parquet").count()
    assert QUERIES["op1_token_counts"](spark, SMALL).count() == n
    assert QUERIES["op10_token_files"](spark, SMALL).count() == n


def test_units_encoded_together_equal_units_alone():
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    from scrivener.llm.op10_token_files import unit_encoder

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = pq_texts(SMALL)
    found = sorted({u for t in texts for u in t.split()} | {"a<|endoftext|>b", "<|startoftext|>", "<|endoftext|>", "<|endoftext|", "|>", "e\u0301", "\u0301", "\U0001f600"})
    alone = [np.array(tok.encode(u, add_special_tokens=False).ids, "<i4").tobytes() for u in found]
    for block in (1, 7, 1024):
        assert unit_encoder(tok, block)(found) == alone
    assert unit_encoder(tok)([]) == []


def pq_texts(sf_dir):
    import pyarrow.parquet as pq

    return [t for t in pq.read_table(f"{sf_dir}/documents.parquet", columns=["text"])["text"].to_pylist() if t]
