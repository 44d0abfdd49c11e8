"""The pipeline and the registered queries against brute force on a small table."""

import pytest
from pyspark.sql import functions as F

import brute
import corpus_pipeline
from conftest import SF0001, SF001
from kestrel.llm import line_dedup, quality, queries, secret_scan
from kestrel.llm.queries import table
from oracle import compare


def test_stages_are_the_dealt_ones():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "near-dedup", "secret scan", "packing"]


def test_pipeline_matches_brute_force(spark):
    from tokenizers import Tokenizer
    import public_tokenizers
    docs = [(r.doc_id, r.text) for r in table(spark, SF0001, "documents").orderBy("doc_id").collect()]
    good = {r.doc_id for r in table(spark, SF0001, "labels").where("quality = 1 AND coalesce(toxic, 0) = 0").collect()}
    scores = brute.quality_scores(docs, good, quality.BUCKETS, quality.SMOOTHING)
    threshold = brute.quality_threshold(docs, good, quality.BUCKETS, quality.SMOOTHING, quality.FOLDS, quality.LOSS, quality.MIN_WORDS)
    fitted = quality.fit(table(spark, SF0001, "documents"), table(spark, SF0001, "labels"))[1]
    assert abs(fitted - threshold) < 1e-9 and threshold > quality.THRESHOLD
    kept = []
    for (i, t), s in zip(docs, scores):
        n = brute.base_counts(t)
        if n[0] >= 10 and 100 * n[4] <= 20 * n[0] and s >= threshold:
            kept.append((i, t))
    lines = brute.dedup_lines(kept, line_dedup.WINDOW, line_dedup.LONG_WORDS)
    kept = [(i, lines[i]) for i, t in kept if lines[i] == t or brute.words(lines[i])]
    root = brute.near_components(kept)
    kept = [(i, secret_scan._masked(t)) for i, t in kept if root[i] == i]
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: lib.encode(t, add_special_tokens=False).ids + [0] for i, t in kept}
    got = {}
    for r in corpus_pipeline.run(spark, SF0001).collect():
        got.setdefault(r.doc_id, []).append((r.start, bytes(r.ids)))
    import numpy as np
    assert {i: np.frombuffer(b"".join(b for _, b in sorted(p)), "<u4").tolist() for i, p in got.items()} == want


def test_stages_keep_the_columns_and_handle_awkward_rows(spark, tmp_path):
    rows = [(1, "a b c d e f g h i j k l m n o p", "en", "s", 31), (1, "a b c d e f g h i j k l m n o p", "en", "s", 31), (None, None, None, None, None),
            (2, "", "en", None, 0), (None, "q w e r t y u i o p a s d f g h", None, "s", 5), (3, None, "en", "s", None)]
    docs = spark.createDataFrame(rows, table(spark, SF0001, "documents").schema)
    for df in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, df, SF0001)
            assert out.columns == list(corpus_pipeline.COLUMNS)
            got = out.collect()
            assert len(got) <= df.count()
            if name == "near-dedup" and df is docs:
                assert sorted(repr(r.doc_id) for r in got) == ["1", "2", "3", "None", "None"]
        assert corpus_pipeline.STAGES[-1][1](spark, df, SF0001).where("start = 0").count() == df.count()


def test_texts_that_share_an_id_stay(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(30)) for x in "abc")
    rows = [(1, a), (1, b), (2, a), (1, a), (3, c + " more"), (None, c), (None, b + " more"), (4, "short"), (4, "other")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], table(spark, SF0001, "documents").schema)
    got = corpus_pipeline.near_dup_stage(spark, docs, SF0001).select("doc_id", "text").collect()
    assert sorted(t.replace(" more", "") for _, t in got) == sorted([a, b, c, "short", "other"])
    assert (3, c + " more") in [tuple(r) for r in got] and {i for i, t in got if t == a} == {1}


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_oracle(spark, duck001, name):
    ok, msg = compare(queries.QUERIES[name](spark, SF001), duck001, queries.ORACLE[name])
    assert ok, msg


def test_every_dealt_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_near_dedup_query_on_a_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, SF001, "documents").collect()]
    want = brute.near_components(docs)
    got = queries.QUERIES["op3_minhash_near_dedup"](spark, SF001)
    assert {r.doc_id: r.component_id for r in got.collect()} == want
    assert got.where(F.col("kept") != (F.col("doc_id") == F.col("component_id"))).count() == 0
