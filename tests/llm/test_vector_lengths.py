"""Vector operators on tables of unusual vector lengths."""

import numpy as np
from pyspark.sql import functions as F
from test_operators import vec_frame, vectors

from scrivener.llm import op3_kd_search, op4_embedding_dedup


def test_top_k_of_vectors_without_components(spark):
    data = vectors(1) + [(3020, []), (3021, [])]
    got = op3_kd_search.top_k(vec_frame(spark, data), F.col("id") % 20 == 0).collect()
    assert [(r["rank"], r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == 3020] == [(1, 3006, 0), (2, 3021, 0)]
    without = op3_kd_search.top_k(vec_frame(spark, vectors(1)), F.col("id") % 20 == 0).collect()
    assert sorted(r for r in got if r.query_id != 3020) == sorted(without)


def test_links_of_vectors_of_very_many_lengths(spark, monkeypatch):
    monkeypatch.setattr(op4_embedding_dedup, "PLANNED_LENGTHS", 3, raising=False)
    monkeypatch.setattr(op4_embedding_dedup, "TILE_ROWS", 2)
    rng = np.random.default_rng(4)
    data = []
    for dim in range(1, 106):
        near = rng.normal(size=dim)
        # Five vectors that link, two of them copies, and one that points away; more of some lengths.
        some = [near, near, 2 * near, near * 1.01, near + 0.01 * np.abs(near), -near] + [near * (2 + k) for k in range(8 * (dim in (7, 50, 60)))]
        data += [(1000 * dim + k, [float(np.float32(x)) for x in v]) for k, v in enumerate(some)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in op4_embedding_dedup.embedding_components(vec_frame(spark, data)).collect()}
    want = {}
    for dim in range(1, 106):
        ids = [i for i, v in data if len(v) == dim]
        want |= {i: (len(ids) - 2, ids[0], i == ids[0]) for i in ids} | {ids[5]: (0, ids[5], True)}
    assert got == want
