import os

import duckdb
import numpy as np

import corpus_pipeline as P
from colform.llm import mixing, ngram_join, queries, suffix_dedup

from .common import SCHEMA, clashing, edge_rows

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted(map(repr, df.collect()))


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = P.identify_language(spark, docs, SF)
    assert kept.columns == P.COLUMNS and kept.count() >= docs.count() - 2
    texts = {r.doc_id: r.text for r in kept.collect()}

    unique = P.drop_near_duplicates(spark, kept, SF)
    want = {k for k, (_, c) in ngram_join.brute_force(texts, 5, 80).items() if k == c}
    assert {r.doc_id for r in unique.collect()} == want and unique.columns == P.COLUMNS

    cut = P.cut_repeats(spark, unique, SF).collect()
    brute = suffix_dedup.brute_force([(k, texts[k].encode()) for k in want])
    for r in cut:
        assert len(r.text.encode()) <= brute[r.doc_id][0] - brute[r.doc_id][1]
        assert r.n_chars == len(r.text)
        if not brute[r.doc_id][1]:
            assert r.text == texts[r.doc_id]
    assert {r.doc_id for r in cut} == {k for k in want if brute[k][0] > brute[k][1] or not brute[k][0]}


def test_mix_takes_what_it_says(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    taken = {r.doc_id: r.taken for r in mixing.mix(docs.withColumn("size", mixing.word_count())).collect()}
    words: dict = {}
    for r in P.mix_sources(spark, docs, SF).collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len([w for w in __import__("re").split(r"[\x20\x09-\x0D]+", r.text) if w])
        assert r.n_chars == len(r.text)
    assert words == {k: v for k, v in taken.items() if v}


def test_run_and_reruns_agree(spark):
    first, second = rows_of(P.run(spark, SF)), rows_of(P.run(spark, SF))
    assert first == second and len(first) > 50
    assert 4 <= len(P.STAGES) <= 5 and "pipeline" in queries.QUERIES


def test_edges_go_through_all_stages(spark):
    docs = clashing(spark.createDataFrame(edge_rows(), SCHEMA))
    for i, (_, stage) in enumerate(P.STAGES):
        docs = stage(spark, docs, SF)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert docs.count() > 0
        if i < len(P.STAGES) - 1:
            assert docs.columns == P.COLUMNS
    empty = spark.createDataFrame([], SCHEMA)
    for _, stage in P.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_sql_twins(spark):
    connection = duckdb.connect()
    for name in os.listdir(SF):
        connection.sql(f"create view {name.removesuffix('.parquet')} as select * from '{SF}/{name}'")
    for name, sql in queries.ORACLES.items():
        found = queries.QUERIES[name](spark, SF)
        columns = sorted(found.columns)
        want = connection.sql(sql).select(*[f'"{c}"' for c in columns]).fetchall()
        assert sorted(tuple(float(x) for x in r) for r in found.select(*columns).collect()) == sorted(tuple(float(x) for x in r) for r in want)


def test_queries_return_their_contracts(spark):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    contracts = {
        "op1_": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
        "op2_": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
        "op3_": {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"},
        "op4_": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
        "op6_": {"doc_id": "bigint", "n_chars": "bigint", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string", "near_edited": "double", "near_next": "double"},
        "op7_": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
        "op8_": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
        "op9_": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
        "op10_": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    }
    for prefix, columns in contracts.items():
        (name,) = [k for k in queries.QUERIES if k.startswith(prefix)]
        found = queries.QUERIES[name](spark, SF)
        assert columns.items() <= dict(found.dtypes).items(), name
        assert found.count() == n, name
    assert np.isfinite([r.score for r in queries.QUERIES["op4_toxicity"](spark, SF).collect()]).all()
