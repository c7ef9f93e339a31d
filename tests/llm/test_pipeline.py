import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline as P
from tallyloom.llm import chunkdedup, langid, queries, setjoin

from .conftest import ODD

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = queries.queries()[name](spark, SF)
    c = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in c.description]
    key = lambda rows, cols: sorted(tuple(repr(r[cols.index(n)]) for n in sorted(cols)) for r in rows)
    assert key(df.collect(), df.columns) == key(c.fetchall(), names)


def test_one_query_for_each_operator():
    names = list(entry.queries())
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11)) and "pipeline" in names
    assert [n for n, _ in P.STAGES] == ["language_id", "ngram_jaccard_join", "substring_dedup", "source_mixing", "byte_bpe"]


def test_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = P.language_id(spark, docs, SF).cache()
    assert kept.columns == docs.columns and kept.count() == docs.count()  # all have letters of a learned language
    apart = P.jaccard_join(spark, kept, SF).cache()
    groups = setjoin.join(kept)
    assert {r.doc_id for r in apart.collect()} == {r.component_id for r in groups.collect()} and apart.columns == docs.columns
    cut = P.substring_dedup(spark, apart, SF).cache()
    again = chunkdedup.deduplicate(cut).agg(F.sum("n_removed")).first()[0]
    assert cut.count() == apart.count() and again == 0 and cut.filter("n_chars <> length(text)").count() == 0
    out = P.run(spark, SF)
    assert set(out.columns) == {*docs.columns, "n_tokens", "ids", "decoded_sha256"}
    bad = out.filter(F.sha2("text", 256) != F.col("decoded_sha256")).count()
    assert out.count() > 0 and bad == 0 and out.filter(F.size("ids") != F.col("n_tokens")).count() == 0


def test_stages_take_odd_rows(make, spark):
    docs = make(ODD + ["the same text as another one here"] * 3, [None] + list(range(1, len(ODD))) + [20, 21, 21], extra=["e"] * 12)
    clash = {c: F.lit("c") for c in ("__doc", "__whole", "lang_pred", "score", "row", "group", "n_removed", "__places", "__rate", "copy")}
    docs = docs.withColumns(clash)
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.filter("lang_pred = 'c' AND copy = 'c'").count() == out.count() > 0
        assert stage(spark, docs.limit(0), SF).count() == 0
    last = P.byte_bpe(spark, docs.withColumns({"ids": F.lit("c"), "n_tokens": F.lit("c"), "__text": F.lit("c")}), SF)
    rows = last.collect()
    assert len(rows) == 12 and all(r.n_tokens == len(r.ids) and r["__text"] == "c" for r in rows) and [r.ids for r in rows if r.text is None] == [[]]
    assert P.byte_bpe(spark, docs.limit(0), SF).count() == 0
    kept = P.jaccard_join(spark, docs, SF)
    assert kept.filter("doc_id >= 20").count() == 1 and kept.filter("doc_id IS NULL").count() == 1


def test_texts_of_one_id_are_kept_unless_alike(make, spark):
    long = [" ".join(f"{x}{k}" for k in range(40)) for x in "abcd"]
    near = long[1].replace("b39", "other")
    #        one id, two texts   a copy of one  near, same id  empty sets  equal rows
    texts = [long[0], long[1], long[0], near, long[2], None, "", "", "é", long[3], long[3]]
    ids = [7, 7, 9, 7, 9, 7, 7, 7, 7, 11, 11]
    sources = ["x"] * 9 + ["b", "a"]
    want = None
    for turn in range(2):
        rows = list(zip(texts, ids, sources))[:: -1 if turn else 1]
        docs = make([r[0] for r in rows], [r[1] for r in rows], extra=[r[2] for r in rows]).drop("source").withColumnRenamed("extra", "source").repartition(3)
        out = sorted((tuple(r) for r in P.jaccard_join(spark, docs, SF).select("doc_id", "text", "source").collect()), key=str)
        got = [(i, t) for i, t, _ in out if t not in (long[1], near)]
        assert sorted(got, key=str) == sorted([(7, long[0]), (9, long[2]), (7, None), (7, ""), (7, "é"), (11, long[3])], key=str)
        assert sum(t in (long[1], near) for _, t, _ in out) == 1  # one of them stays
        want = want or out
        assert out == want  # whatever the order of the rows


def test_rejected_documents_go(make, spark, monkeypatch):
    monkeypatch.setattr(langid, "STEPS", 5)
    out = P.language_id(spark, make(["hello there", None, "12 34", "", "world of words"]), SF)
    assert {r.doc_id for r in out.collect()} == {0, 4}
