"""Work of the substring operators that is done once."""

import numpy as np
from test_repeats import frame

from scrivener.llm import op7_suffix_array as bytes7
from scrivener.llm import repeats

DATA = [(i, f"{i} an own beginning, then a passage of fifty bytes and more that is shared") for i in range(5)]


def spans(spark, symbols=bytes7._symbols):
    docs = repeats.keyed(frame(spark, DATA), "doc_id", "text")
    return repeats.repeated_spans(docs, symbols, bytes7._pieces, bytes7.resolver(50), bytes7._windows(50), 50, 16)


def test_texts_are_scanned_once(spark, tmp_path):
    """One scan and one shuffle of all segments tell the shared anchors and give their places."""
    calls = str(tmp_path / "calls")

    def symbols(text):
        with open(calls, "a") as f:
            f.write(f"{text}\n")
        return np.frombuffer(text.encode(), np.uint8)

    assert sorted(r.ord for r in spans(spark, symbols).collect()) == [1, 2, 3, 4]
    with open(calls) as f:
        assert sorted(f.read().splitlines()) == sorted(t for _, t in DATA)


def test_rows_are_dealt_by_document_before_they_are_collected(spark, monkeypatch):
    plans, keep = {}, repeats.store

    def store(df):
        plans[tuple(df.columns)] = df._jdf.queryExecution().executedPlan().toString()
        return keep(df)

    monkeypatch.setattr(repeats, "store", store)
    assert sorted(r.ord for r in spans(spark).collect()) == [1, 2, 3, 4]
    for found in (plans["ord", "tag", "spans"], next(p for c, p in plans.items() if "body" in c)):
        # A plan's text begins with its last step.
        assert found.index("partial_collect_list") < found.index("REPARTITION_BY_COL")
