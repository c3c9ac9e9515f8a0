"""Unit behaviour of prompts, validation, sinks, sources and helpers."""

import math
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from scrivener.functions import prompts as P
from scrivener.operators import validate as V
from scrivener.sources.fixed import DEFAULT_EXAMPLES


def test_prompt_structure(spark):
    texts = ["Где моя книга", "naïve  café", "", "two\nlines"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r["text"]: r["p"] for r in df.select("text", P.few_shot_prompt(F.col("text")).alias("p")).collect()}
    header = P.render_header()
    assert header.count("Input: ") == header.count("Output: ") == len(DEFAULT_EXAMPLES)
    for t in texts:
        assert got[t] == f"{header}Input: {t}\nOutput:"


def test_prompt_without_examples_and_added_example(spark):
    bare = P.render_header([])
    one = P.render_header([(1, "Wo ist das Hauß", "Wo ist das Haus")])
    assert one == bare + "Input: Wo ist das Hauß\nOutput: Wo ist das Haus\n\n"
    both = P.render_header([(2, "b", "B"), (1, "Wo ist das Hauß", "Wo ist das Haus")])
    assert both in (one + "Input: b\nOutput: B\n\n", bare + "Input: b\nOutput: B\n\n" + one[len(bare):])


def test_grouped_prompts_missing_group_gets_bare_header(spark):
    from scrivener.operators.prompts import render_few_shot_by
    from scrivener.sources.fixed import PROMPT_HEADER, examples_df

    lines = spark.createDataFrame([("en", "a"), ("xx", "b")], "lang string, text string")
    ex = examples_df(spark, [("en", 2, "t2", "f2"), ("en", 1, "t1", "f1")], group="lang")
    got = {r["lang"]: r["prompt"] for r in render_few_shot_by(lines, ex, "lang").collect()}
    assert got["en"] == PROMPT_HEADER + "Input: t1\nOutput: f1\n\nInput: t2\nOutput: f2\n\nInput: a\nOutput:"
    assert got["xx"] == PROMPT_HEADER + "Input: b\nOutput:"


@pytest.mark.parametrize(
    "prompt,expected",
    [("x\nOutput:", "x\nOutput: "), ("abc  ", "abc "), ("Done.", "Done."), ("Why?  ", "Why?  "), ("k:", "k:")],
)
def test_normalise_prompt(spark, prompt, expected):
    df = spark.createDataFrame([(prompt,)], "p string")
    assert df.select(P.normalise_prompt(F.col("p")).alias("n")).first()["n"] == expected


REQUESTS = [
    # input, stdin, config, local_path, temperature, max_tokens, valid
    ("fix this", False, None, None, 0.5, 50, True),
    (None, True, None, None, 0.0, 25, True),
    (None, False, None, None, 0.0, 25, False),
    ("x", True, None, None, 0.0, 25, False),
    ("x", False, None, None, 3.0, 25, False),
    ("x", False, "c.json", None, 0.0, 25, False),
    ("x", False, "c.json", "/m", 0.0, 25, True),
    ("x", False, None, None, 2.0, 512, True),
    ("x", False, None, None, 0.0, 0, False),
    ("x", False, None, None, 0.0, 513, False),
    ("x", False, None, None, float("nan"), 25, False),
    ("x", False, None, None, -0.1, 25, False),
    ("", False, None, None, 0.0, 25, True),
]


@pytest.mark.parametrize("value,text", [(1e7, "10000000"), (-5e-4, "-0.0005"), (1.5, "1.5"), (3.0, "3"), (1.25e10, "12500000000"),
                                        (1.2345678901e8, "123456789.01"), (2e-7, "0.0000002"), (None, None)])
def test_numbers_in_messages_are_plain_decimals(spark, value, text):
    df = spark.createDataFrame([(value,)], "x double")
    assert df.select(V._num_text(F.col("x")).alias("t")).first()["t"] == text


def test_missing_settings_are_errors(spark):
    schema = "input string, stdin boolean, config string, local_path string, temperature double, max_tokens int"
    rows = [("x", False, None, None, None, 25), ("x", False, None, None, 0.0, None)]
    errors = {r["error"] for r in V.validate_requests(spark.createDataFrame(rows, schema)).collect()}
    assert errors == {"Temperature must be between 0.0 and 2.0, got null", "max_tokens must be between 1 and 512, got null"}


def test_session_keeps_given_settings(monkeypatch):
    from scrivener import session

    monkeypatch.delenv("PYSPARK_GATEWAY_PORT", raising=False)
    monkeypatch.setenv("PYSPARK_SUBMIT_ARGS", "--conf spark.sql.shuffle.partitions=2000 --driver-memory 3g pyspark-shell")
    assert session._given() == {"spark.sql.shuffle.partitions", "spark.driver.memory"}


def test_checkpoint_folder_must_be_shared_on_a_cluster():
    from types import SimpleNamespace

    from scrivener.session import checkpoint_dir

    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master="local-cluster[2,1,1024]"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_dir(cluster)


def test_report_keeps_failed_lines(spark):
    from scrivener.sinks.writers import render_report

    df = spark.createDataFrame([(1, 0, "a", "A", "ok"), (1, 1, "b", None, "empty_output")], "doc_id long, line_no int, text string, corrected string, status string")
    got = [r["report"] for r in render_report(df).orderBy("line_no").collect()]
    assert got == ["Input:  a\nOutput: A\n---", "Input:  b\nOutput: [empty_output]\n---"]


def test_words_of_any_script(spark):
    from scrivener.operators.lexicon import words

    df = spark.createDataFrame([("en", "Être naïve über 2024 ПРИВЕТ e\u0301t\u0301")], "lang string, text string")
    assert [r["word"] for r in words(df).collect()] == ["être", "naïve", "über", "привет", "e\u0301t\u0301"]


def test_validate_requests_cases(spark):
    schema = "input string, stdin boolean, config string, local_path string, temperature double, max_tokens int, valid boolean"
    df = spark.createDataFrame(REQUESTS, schema)
    for r in V.validate_requests(df).collect():
        assert (r["error"] is None) == r["valid"], r
        scalar = V.request_error_scalar(r["input"] is not None, r["stdin"], r["config"], r["local_path"],
                                        r["temperature"], r["max_tokens"])
        assert (scalar is None) == r["valid"]
    msgs = {r["error"] for r in V.validate_requests(df).collect()}
    assert "Temperature must be between 0.0 and 2.0, got 3" in msgs
    assert "max_tokens must be between 1 and 512, got 513" in msgs


def test_quarantine_collects_all_errors(spark):
    df = spark.createDataFrame([(None, False, "c", None, 9.0, 0)],
                               "input string, stdin boolean, config string, local_path string, temperature double, max_tokens int")
    good, bad = V.split_quarantine(df)
    assert good.count() == 0
    assert bad.first()["errors"][0].startswith("Must provide") and len(bad.first()["errors"]) == 4


def test_model_ids(spark):
    ok = ["a/b", "team.one/speller_v2", "Ärzte/modell-3", "x/y z"]
    bad = ["", "nameonly", "a/b/c", "//", "/b", "a/"]
    df = spark.createDataFrame([(m,) for m in ok + bad], "m string")
    got = {r["m"]: r["v"] for r in df.select("m", V.valid_model_id(F.col("m")).alias("v")).collect()}
    assert all(got[m] for m in ok) and not any(got[m] for m in bad)


def test_shape_message_round_trip(spark):
    df = spark.createDataFrame([(1, [1.0] * 64)], "id int, v array<float>")
    _, bad = V.shape_conformance(df, "v", 1)
    msg = bad.first()["message"]
    assert msg == "MultiArray shape (64) does not match the shape (1) specified in the model description"
    a, e = V.parse_shape_message(F.lit(msg))
    r = spark.range(1).select(a.alias("a"), e.alias("e")).first()
    assert (r["a"], r["e"]) == ("64", "1")


def test_text_source_and_text_sink(spark):
    from scrivener.operators.lines import explode_lines
    from scrivener.sinks.writers import write_text
    from scrivener.sources.tables import read_text_files

    d = tempfile.mkdtemp(prefix="scrivener-src-")
    with open(os.path.join(d, "a.txt"), "w") as f:
        f.write("this sentance\n\nteh end\r\n")
    docs = read_text_files(spark, d)
    lines = explode_lines(docs)
    assert [r["text"] for r in lines.orderBy("line_no").collect()] == ["this sentance", "", "teh end"]
    from scrivener.plans.correct import correct_lines

    out = correct_lines(lines)
    sink = os.path.join(tempfile.mkdtemp(prefix="scrivener-sink-"), "out")
    write_text(out, sink)
    assert [r["value"] for r in spark.read.text(sink).collect()] == ["this sentence", "the end"]


def test_json_envelope_is_one_document_over_part_files(spark):
    import json

    from scrivener.sinks import writers as W

    rows = [(d, n, f"in {d} {n}", None if n == 2 else f"out {d} {n}") for d in (3, 1, 2) for n in (2, 0, 1)]
    df = spark.createDataFrame(rows, "doc_id int, line_no int, text string, corrected string")
    env = json.loads("\n".join(r["value"] for r in W.json_envelope(df, "m", 0.0, 25).collect()))
    assert env["results"] == [{"input": i, "output": o} for _, _, i, o in sorted(rows)]
    assert env["model"] == "m" and env["temperature"] == 0.0 and env["max_tokens"] == 25
    none = json.loads("\n".join(r["value"] for r in W.json_envelope(df.limit(0), "m", 0.0, 25).collect()))
    assert none["results"] == []


def test_on_error_fail(spark):
    from scrivener.plans.correct import correct_corpus

    df = spark.createDataFrame([(1, 0, "x")], "doc_id int, line_no int, text string")
    with pytest.raises(RuntimeError):
        correct_corpus(df, backend=lambda d: F.lit("<|endoftext|>"), on_error="fail").count()


def test_options_are_validated(spark):
    from scrivener.plans.correct import fix_typos_with_options

    df = spark.createDataFrame([(1, 0, "x")], "doc_id int, line_no int, text string")
    with pytest.raises(ValueError):
        fix_typos_with_options(df, temperature=2.5, max_tokens=10)
    assert math.isclose(0.5, 0.5)


@pytest.mark.parametrize(
    "text,lines",
    [("a\r\nb\r", ["a", "b\r"]), ("a\n", ["a"]), ("", []), ("\n", [""]), ("a\n\nb", ["a", "", "b"]),
     ("x\ry\n", ["x\ry"]), ("a\r\n\r\n", ["a", ""])],
)
def test_split_lines_line_endings(spark, text, lines):
    from scrivener.operators.lines import split_lines

    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(split_lines(F.col("t")).alias("l")).first()["l"] == lines


def test_corrector_facade(spark):
    import json

    from scrivener.plans.corrector import Corrector

    c = Corrector(model="m")
    assert c.example_count() == 4
    c.add_example("definately wrong", "definitely wrong")
    assert c.example_count() == 5
    docs = spark.createDataFrame([(1, "  this sentance\n\nteh end  "), (2, "quik")], "doc_id long, text string")
    p = c.prompts(docs).where("doc_id = 2").first()["prompt"]
    assert "Input: definately wrong\nOutput: definitely wrong\n\n" in p and p.endswith("Input: quik\nOutput:")
    text = {(r["doc_id"], r["line_no"]): r["corrected"] for r in c.correct_batch(docs).collect()}
    assert text == {(1, 0): "this sentence", (1, 2): "the end", (2, 0): "quick"}
    env = json.loads(c.correct_batch(docs, output="json").where("doc_id = 1").first()["json"])
    assert [r["output"] for r in env["results"]] == ["this sentence", "the end"] and env["model"] == "m"
    single = c.correct_single(docs, output="verbose").where("doc_id = 2").first()["report"]
    assert single == "Input:  quik\nOutput: quick\nModel:  m"
    blank = spark.createDataFrame([(3, "   ")], "doc_id long, text string")
    assert c.correct_single(blank).count() == 1 and c.correct_batch(blank).count() == 0
    c.clear_examples()
    assert c.example_count() == 0
    with pytest.raises(ValueError):
        c.fix_typos_with_options(docs, 3.0, 25)


def test_dictionary_forms_agree_on_null_and_repeated_keys(spark):
    from scrivener.operators.dictionary import apply_dictionary

    rows = [(1, 0, "teh cat"), (1, 0, "teh dog"), (None, 0, "teh owl"), (2, None, "Teh fox foo"), (3, 0, None), (4, 0, ""), (4, 0, "")]
    df = spark.createDataFrame(rows, "doc_id long, line_no int, text string")
    rules = spark.createDataFrame([("teh", "the"), ("foo", "teh")], "typo string, fixed string")
    both = [sorted(map(str, apply_dictionary(df, rules, max_map_rules=n).collect())) for n in (1_000, 0)]
    assert both[0] == both[1] and len(both[0]) == len(rows)


def test_envelope_shape_does_not_depend_on_size(spark):
    import json

    from scrivener.sinks.writers import json_per_document

    df = spark.range(120_000).selectExpr("1L AS doc_id", "cast(id AS int) AS line_no", "'a' AS text", "'b' AS corrected")
    got = json_per_document(df, "m", 0.0, 25).collect()
    assert [r["doc_id"] for r in got] == [1] and len(json.loads(got[0]["json"])["results"]) == 120_000


def test_model_is_loaded_once_per_worker(spark, tmp_path):
    from scrivener.operators.generate import decode_options, generate

    log = str(tmp_path / "loads")

    def loader():
        import os

        class Model:
            def generate(self, prompts, max_tokens, temperature, top_k):
                return [f"{os.getpid()} {top_k}" for _ in prompts]

        with open(log, "a") as f:
            f.write(f"{os.getpid()}\n")
        return Model()

    df = spark.range(0, 400, 1, 40).selectExpr("id", "'Fix: x' AS prompt")
    for _ in range(2):
        out = generate(df, "prompt", loader, temperature=0.5, top_k=7, normalise=False).collect()
        assert {r["raw_output"].split(" ")[1] for r in out} == {"7"}
    loads = open(log).read().split()
    assert len(loads) == len(set(loads))
    assert decode_options(0.0) == {"temperature": 0.0, "top_k": None}
    with pytest.raises(ValueError):
        decode_options(0.5, 0)


def test_model_load_failure_is_an_error(spark):
    from scrivener.operators.generate import generate

    def _failing_loader():  # local, so it is shipped to the workers by value
        raise FileNotFoundError("model files not found")

    df = spark.createDataFrame([(1, "Fix: x")], "id int, prompt string")
    with pytest.raises(Exception) as err:
        generate(df, "prompt", _failing_loader).collect()
    assert "model files not found" in str(err.value)


def test_binary_file_inventory(spark):
    import tempfile

    from scrivener.operators.inventory import binary_file_inventory

    root = tempfile.mkdtemp(prefix="scrivener-tree-")
    for rel in ["m1/part0.mlmodelc", "m1/part1.mlpackage", "m1/about.md", "m2/list.csv", "m3/last.mlmodelc"]:
        os.makedirs(os.path.join(root, os.path.dirname(rel)), exist_ok=True)
        with open(os.path.join(root, rel), "w") as f:
            f.write("x")
    got = {r["dir"].rstrip("/").split("/")[-1]: r["n_files"]
           for r in binary_file_inventory(spark, root, r"\.(mlpackage|mlmodelc)$").collect()}
    assert got == {"m1": 2, "m3": 1}


def _text_of(folder) -> str:
    """The part files of a text sink, in order."""
    parts = sorted(f for f in os.listdir(folder) if f.startswith("part-"))
    return "".join(open(os.path.join(folder, f), encoding="utf-8").read() for f in parts)


def test_text_lines_keep_path_and_line_order(spark, tmp_path):
    from scrivener.jobs import main
    from scrivener.sources.tables import read_text_lines

    want = []
    for name in ("b.txt", "a.txt", "c.txt"):
        lines = [f"{name} line {i}" if i % 5 else "" for i in range(4000 if name == "a.txt" else 7)]
        (tmp_path / name).write_text("\n".join(lines) + "\n", encoding="utf-8")
        want += [(name, i, t) for i, t in enumerate(lines)]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")  # the large file is several splits
    try:
        got = [(r["doc_id"].rsplit("/", 1)[1], r["line_no"], r["text"]) for r in read_text_lines(spark, str(tmp_path)).collect()]
        assert sorted(got) == sorted(want)
        out = str(tmp_path / "out")
        assert main(["--input", str(tmp_path) + "/*.txt", "--output", out]) == 0
        assert _text_of(out).splitlines() == [t for _, _, t in sorted(want) if t]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_job_entry_point(spark):
    import json
    import tempfile

    from scrivener.jobs import main

    src = tempfile.mkdtemp(prefix="scrivener-job-src-")
    with open(os.path.join(src, "a.txt"), "w") as f:
        f.write("i cant beleive it\n\nthe quik fox\n")
    out = os.path.join(tempfile.mkdtemp(prefix="scrivener-job-out-"), "o")
    assert main(["--input", src, "--output", out, "--output-format", "json", "--model", "m"]) == 0
    env = json.loads(_text_of(out))
    assert [r["output"] for r in env["results"]] == ["i can't believe it", "the quick fox"]
    out2 = os.path.join(tempfile.mkdtemp(prefix="scrivener-job-out-"), "o")
    assert main(["--input", src, "--output", out2]) == 0
    assert [r["value"] for r in spark.read.text(out2).collect()] == ["i can't believe it", "the quick fox"]
    assert main(["--input", src, "--output", out2, "--temperature", "3.0"]) == 2


@pytest.mark.parametrize("form", ["text", "json", "verbose"])
def test_single_mode_over_text_files_keeps_the_order_of_paths(spark, tmp_path, form):
    from scrivener.jobs import main

    (tmp_path / "in").mkdir()
    for i in range(12):
        (tmp_path / "in" / f"f{i:02d}.txt").write_text(f"teh file {i:02d}")
    assert main(["--input", str(tmp_path / "in"), "--mode", "single", "--output-format", form, "--output", str(tmp_path / "out")]) == 0
    text = _text_of(str(tmp_path / "out"))
    places = [text.index(f"the file {i:02d}") for i in range(12)]
    assert places == sorted(places)
