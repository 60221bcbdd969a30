import hashlib

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from talentgrid.llm import language
from talentgrid.llm.common import stored, table, tokenizer_text
from talentgrid.llm.queries import ORACLES, QUERIES
from tests.llm import plain

SF = "/root/testdata/sf0.001"


def test_every_stage_is_its_plain_version(spark):
    docs = table(spark, SF, "documents")
    extra = docs.limit(3).select(F.lit(None).cast("long").alias("doc_id"), "text", "lang", "source", "n_chars").union(
        docs.limit(2)).union(docs.limit(2).select((F.col("doc_id") + 9000).alias("doc_id"), F.lit("12 34").alias("text"), "lang", "source", "n_chars"))
    docs = stored(docs.union(extra), "docs")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = stored(stage(spark, docs, SF), name)
        kept[name] = (before, docs.collect())
        assert name == "bpe" or docs.columns == columns

    before, after = kept["language_id"]
    net = language.learn(spark.createDataFrame(before, docs.sparkSession.read.parquet(f"{SF}/documents.parquet").schema))
    assert net is not None and len(before) - len(after) == sum(r.text == "12 34" for r in before)

    before, after = kept["line_dedup"]
    rows = sorted({(r.doc_id, r.text) for r in before}, key=lambda r: (r[0] is not None, r[0] or 0))
    numbered = dict(enumerate(rows))
    want = plain.dedup_lines([(i, t) for i, (_, t) in numbered.items()])
    want = {numbered[i]: x[2] for i, x in want.items() if not x[1] or x[2]}
    got = {(r.doc_id, r.text): r.n_chars for r in after}
    ids = {k[0] for k in want if k[0] is not None}
    assert {k for k in got if k[0] is not None} == {(k[0], v) for k, v in want.items() if k[0] is not None}
    assert all(n == len(t) for (_, t), n in got.items()) and ids

    before, after = kept["near_dedup"]
    classes = plain.near_classes({r.doc_id: r.text for r in before if r.doc_id is not None})
    assert sorted(r.doc_id for r in after if r.doc_id is not None) == sorted({c for c in classes.values()})
    assert sum(r.doc_id is None for r in after) == sum(r.doc_id is None for r in before)

    before, after = kept["decontamination"]
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    clean = [r for r in before if plain.contamination([(0, r.text)], items)[0][1] == 0]
    assert sorted(map(str, clean)) == sorted(map(str, after)) and len(after) < len(before)

    before, after = kept["bpe"]
    library = Tokenizer.from_str(tokenizer_text())
    want = []
    for r in before:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(
            ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, after), key=str) == sorted(want, key=str)


def test_registered_names():
    assert sorted({int(n[2:].split("_")[0]) for n in QUERIES}) == list(range(1, 14)) and len(QUERIES) == 13
    assert set(ORACLES) == {"op6_prefix_filter", "op9_deletion_neighbours", "op11_norm_buckets", "op12_phrase_growth", "op13_source_schedule"}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "bpe"]


CLASH = ("score", "times", "n_lines", "lang_pred", "n_removed", "nth", "text_hash", "bad_id", "class_id", "own", "w", "contaminated")


def test_stages_keep_columns_of_any_name(spark):
    docs = table(spark, SF, "documents").limit(40)
    docs = docs.union(docs.limit(3)).union(docs.limit(3).withColumn("doc_id", F.lit(None).cast("long")))
    docs = docs.union(docs.limit(2).withColumn("text", F.lit(None).cast("string"))).union(docs.limit(2).withColumn("text", F.lit("")))
    plain_docs, clash = stored(docs, "docs"), stored(docs.withColumns({c: F.concat(F.lit(c), F.col("source")) for c in CLASH}), "docs")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        plain_docs, clash = stored(stage(spark, plain_docs, SF), name), stored(stage(spark, clash, SF), name)
        assert clash.columns == [*plain_docs.columns, *CLASH]
        rows = clash.collect()
        assert sorted(map(str, plain_docs.collect())) == sorted(str(type(r)(**{c: r[c] for c in plain_docs.columns})) for r in rows)
        assert all(r[c] == c + r.source for r in rows for c in CLASH)


def test_stages_on_nulls_empty_tables_and_without_labels(spark):
    docs = table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0
    nulls = spark.createDataFrame([(None, None, None, None, None), (5, None, None, None, None), (6, "", None, None, 0)], docs.schema)
    language_id, line_dedup, near_dedup, leaks, bpe = (stage for _, stage in corpus_pipeline.STAGES)
    assert language_id(spark, nulls, SF).count() == 0
    for stage in (line_dedup, near_dedup, leaks):
        assert sorted(map(str, (r.doc_id for r in stage(spark, nulls, SF).collect()))) == ["5", "6", "None"]
    assert sorted((str(r.doc_id), r.n_tokens) for r in bpe(spark, nulls, SF).collect()) == [("5", 0), ("6", 0), ("None", 0)]
    unlabelled = docs.limit(20).withColumn("lang", F.lit(None).cast("string"))
    assert language_id(spark, unlabelled, SF).count() == 20
