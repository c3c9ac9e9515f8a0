"""Properties over the derived test tables (sf0.001)."""

from pyspark.sql import functions as F

from conftest import SMALL
from scrivener.sources import fixtures as FX


def test_sanitize_idempotent_without_quotes_or_brackets(spark):
    from scrivener.functions.sanitize import sanitize_steps

    df = FX.typo_lines(spark, SMALL).where(~F.col("typo_text").rlike("[\"'(]"))
    once = sanitize_steps(df, "typo_text", "c1")
    twice = sanitize_steps(once, "c1", "c2")
    assert twice.where(F.col("c1") != F.col("c2")).count() == 0


def test_lines_in_equal_processed_plus_blank(spark):
    import __spark_entry__ as E

    r = E.queries()["run_counts"](spark, SMALL).first()
    assert r["lines_total"] == r["lines_processed"] + r["lines_blank"]
    assert r["lines_blank"] > 0 and r["lines_failed"] > 0 and r["lines_changed"] > 0


def test_decode_of_encode_gives_in_vocabulary_words(spark):
    from scrivener.operators import tokens as TK
    from scrivener.operators.lexicon import WORD_PATTERN

    lines = FX.lines(spark, SMALL)
    vocab = TK.build_vocab(lines, "text", 5)
    enc = TK.encode(lines, vocab, "text")
    dec = TK.decode(enc, vocab).join(lines, ["doc_id", "line_no"])
    words = F.array_join(F.regexp_extract_all(F.lower("text"), F.lit(WORD_PATTERN), 0), " ")
    in_vocab = enc.where(~F.array_contains("ids", 0)).select("doc_id", "line_no")
    bad = dec.join(in_vocab, ["doc_id", "line_no"]).where(F.col("decoded") != words)
    assert bad.count() == 0


def test_dense_ids_are_dense_and_unique(spark):
    from scrivener.operators import tokens as TK

    vocab = TK.build_vocab(FX.lines(spark, SMALL), "text", 2)
    n = vocab.count()
    r = vocab.agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.countDistinct("id").alias("d")).first()
    assert (r["lo"], r["hi"], r["d"]) == (1, n, n)
    top = vocab.orderBy(F.col("freq").desc(), "word").first()
    assert top["id"] == 1


def test_zero_temperature_sampling_is_greedy(spark):
    from scrivener.operators import lexicon as LX

    lex = LX.build_lexicon(FX.lines(spark, SMALL), "text", min_count=5)
    cands = LX.candidates(LX.find_oov(FX.typo_lines(spark, SMALL), lex, "typo_text"), lex)
    greedy = LX.best(cands)
    assert LX.sample(cands, temperature=0.0).exceptAll(greedy).count() == 0
    hot = LX.sample(cands, k=40, temperature=0.7, seed=1)
    assert hot.exceptAll(LX.sample(cands, k=40, temperature=0.7, seed=1)).count() == 0
    assert hot.count() == greedy.count()


def test_parts_concatenate_back_to_vectors(spark):
    from scrivener.operators.tokens import concat_parts
    from scrivener.sources.tables import read_table

    joined = concat_parts(FX.vector_parts(spark, SMALL)).join(read_table(spark, SMALL, "embeddings"), "vec_id")
    assert joined.where(F.col("vals") != F.col("embedding")).count() == 0
    assert joined.where(F.col("total_size") != 64).count() == 0


def test_stream_equals_batch(spark):
    import __spark_entry__ as E

    q = E.queries()
    a, b = q["stream_equals_batch"](spark, SMALL), q["correct_lines"](spark, SMALL)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_stream_reads_a_table_of_many_files(spark, tmp_path):
    """A table may be one file or a folder of files; the stream takes all of them."""
    import __spark_entry__ as E

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(40)
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    q = E.queries()
    a, b = q["stream_equals_batch"](spark, str(tmp_path)), q["correct_lines"](spark, str(tmp_path))
    assert a.count() > 40 and a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_model_backend_with_stub(spark):
    from pyspark import cloudpickle

    import stub_model
    from scrivener.plans.correct import correct_corpus

    cloudpickle.register_pickle_by_value(stub_model)  # the workers do not see the tests folder

    df = FX.typo_lines(spark, SMALL).select("doc_id", "line_no", "typo_text")
    out = correct_corpus(df, "typo_text", backend="model", load_model=stub_model.load_echo_model, max_tokens=1_000_000)
    # The stub echoes the line (whole, with an unbounded budget), so the model path must
    # agree with the dictionary path on every line.
    direct = correct_corpus(df, "typo_text").select("doc_id", "line_no", F.col("corrected").alias("d"))
    diff = out.join(direct, ["doc_id", "line_no"]).where(~F.col("corrected").eqNullSafe(F.col("d")))
    assert diff.count() == 0


def test_stream_restart_is_exactly_once(spark):
    """A second run over the same checkpoint adds nothing to the sink."""
    import uuid

    from scrivener.session import scratch_path
    from scrivener.sources.tables import read_table
    from scrivener.streaming.corrections import start_file_stream

    schema = read_table(spark, SMALL, "documents", spread=False).schema
    tag = uuid.uuid4().hex
    sink, ckpt = scratch_path(spark, f"t-{tag}/out"), scratch_path(spark, f"t-{tag}/ckpt")
    for _ in range(2):
        q = start_file_stream(spark, SMALL, schema, sink, ckpt, glob="documents.parquet", keep=["lang"])
        q.awaitTermination()
        n = spark.read.parquet(sink).count()
    lines = FX.lines(spark, SMALL).where(F.trim(F.col("text")) != "").count()
    assert n > 0 and n <= lines
    assert spark.read.parquet(sink).groupBy("doc_id", "line_no").count().where("count > 1").count() == 0


def test_observed_run_counts_equal_the_report(spark):
    from scrivener.operators.evaluate import observe_run_counts, run_counts
    from scrivener.plans.correct import correct_corpus

    stub = lambda d: FX.raw_output_expr(F.col("doc_id"), F.col("line_no"), F.col("typo_text"))
    result = correct_corpus(FX.typo_lines(spark, SMALL), "typo_text", backend=stub, keep_blank=True)
    observed, obs = observe_run_counts(result)
    observed.write.format("noop").mode("overwrite").save()
    assert obs.get == run_counts(result).first().asDict()


def test_encode_without_broadcast_matches(spark):
    from scrivener.operators import tokens as TK
    from scrivener.operators.lexicon import WORD_PATTERN

    lines = FX.lines(spark, SMALL)
    vocab = TK.build_vocab(lines, "text", 5)
    a = TK.encode(lines, vocab, "text")
    b = TK.encode(lines, vocab, "text", max_broadcast_rows=3)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    da, db = TK.decode(a, vocab), TK.decode(a, vocab, max_broadcast_rows=3)
    assert da.exceptAll(db).count() == 0 and db.exceptAll(da).count() == 0
