"""The registered queries, and the pipeline's stages one by one."""

import brute
import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lumenflow.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_oracle(spark, data, name):
    con = duckdb.connect()
    for name_ in ("documents", "benchmark", "embeddings"):
        con.sql(f"CREATE VIEW {name_} AS SELECT * FROM '{data}/{name_}.parquet'")
    df, ref = queries.QUERIES[name](spark, data), con.sql(queries.SQL[name])
    cols = sorted(df.columns)
    assert cols == sorted(ref.columns)
    at = [ref.columns.index(c) for c in cols]
    assert sorted(tuple(map(str, (r[c] for c in cols))) for r in df.collect()) == sorted(tuple(map(str, (r[i] for i in at))) for r in ref.fetchall())


def test_all_are_there():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    seen = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, data)
        docs = spark.createDataFrame(out.collect(), out.schema)
        seen[name] = docs
    rows = {k: [(r.doc_id, r.text) for r in v.collect()] for k, v in seen.items() if "text" in v.columns}
    assert all(v.columns == seen["documents"].columns for k, v in seen.items() if "text" in v.columns)
    labels = spark.read.parquet(f"{data}/labels.parquet")
    kept = seen["quality classifier"].join(labels, "doc_id").agg(F.avg("quality")).first()[0]
    assert kept >= labels.agg(F.avg("quality")).first()[0]
    exact = {}
    for i, t in rows["quality classifier"]:
        key = "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
        exact[key] = max(exact.get(key, -1), i)
    assert {i for i, _ in rows["exact dedup"]} == set(exact.values())
    near = brute.near_duplicates(rows["exact dedup"], 5, 80)
    assert {i for i, _ in rows["MinHash near-dedup"]} == {i for i, (_, c) in near.items() if i == c}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    bad = {i for i, _ in brute.contaminated(rows["MinHash near-dedup"][:60], items)}
    first = {i for i, _ in rows["MinHash near-dedup"][:60]}
    assert {i for i, _ in rows["benchmark decontamination"]} & first == first - bad
    last = seen["SentencePiece encoding and decoding"]
    assert {r.doc_id for r in last.collect()} == {i for i, _ in rows["benchmark decontamination"]}


def test_stages_on_awkward_and_empty_tables(spark, data):
    """Nulls in any column, repeated rows, ties and columns with names that stages use themselves; and no rows at all."""
    rows = [(1, "Same words as these here", "en"), (2, "same words as THESE here", None), (2, "same words as THESE here", None), (3, None, None), (4, "", "en"), (None, "no id", "x"), (None, "no id", "x"), (None, None, None), (5, "y" * 200_000, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"norm": F.lit(1), "row": F.lit("r"), "kept": F.lit(None).cast("boolean"), "words": F.lit("w"), "score": F.lit(0.1), "mix": F.lit(2), "__kept": F.lit(1)})
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality classifier"](spark, docs, data)
    assert kept.columns == docs.columns and kept.count() <= len(rows)
    exact = stages["exact dedup"](spark, docs, data)
    assert exact.columns == docs.columns
    assert sorted(((r.doc_id or 0), (r.text or "")[:9]) for r in exact.collect()) == [(0, "no id"), (2, "same word"), (4, ""), (5, "yyyyyyyyy")]
    near = stages["MinHash near-dedup"](spark, docs, data)
    assert near.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in near.collect()) == [0, 0, 0, 1, 3, 4, 5]
    clean = stages["benchmark decontamination"](spark, docs, data)
    assert clean.columns == docs.columns and clean.count() == len(rows)
    assert stages["SentencePiece encoding and decoding"](spark, docs, data).count() == len(rows)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs.where("false"), data)
        assert out.count() == 0, name
