"""The pipeline, stage by stage, against the brute-force versions of its operators."""

import corpus_pipeline as P
from parlance.llm import lines, simhash, substrings, toxicity
from parlance.llm.common import stored
from tests.llm import test_lines, test_packing, test_simhash, test_substrings

SF = "/root/testdata/sf0.001"


def rows(df):
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    columns = docs.columns

    score = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels)).collect()}
    kept = stored(spark, P.toxicity(spark, docs, SF), "t")
    assert kept.columns == columns
    assert {i for i, _ in rows(kept)} == {i for i, s in score.items() if s < 0.5}

    want = test_lines.brute(rows(kept))
    assert test_lines.got(lines.line_digests(kept)) == want
    lined = stored(spark, P.line_dedup(spark, kept, SF), "t")
    assert lined.columns == columns
    assert {i: len(t.split("\n")) for i, t in rows(lined) if t} == {i: n - g for i, (n, g, _) in want.items() if n > g}
    assert all(r.n_chars == len(r.text) for r in lined.collect())

    comp = test_simhash.brute_components({i: test_simhash.brute_fp(t) for i, t in rows(lined)})
    single = stored(spark, P.simhash_near_dedup(spark, lined, SF), "t")
    assert single.columns == columns
    assert sorted(rows(single)) == sorted((i, t) for i, t in rows(lined) if comp[i] == i)

    cut = stored(spark, P.substring_dedup(spark, single, SF), "t")
    assert cut.columns == columns
    want = test_substrings.brute(rows(single))
    assert {i: len(test_substrings.split(t)) for i, t in rows(cut)} == {i: n - g for i, (n, g, _) in want.items()}

    test_packing.verify(P.packing(spark, cut, SF).collect(), rows(cut))
    assert simhash.SHINGLE_WORDS == 3 and substrings.WINDOW == 50


def test_run_and_registration(spark):
    import __spark_entry__ as E

    assert E.queries()["pipeline"] is P.run and "pipeline" not in E.oracle_sql()
    assert [n for n, _ in P.STAGES] == ["toxicity", "line dedup", "SimHash near-dedup", "substring dedup", "packing"]
    out = P.run(spark, SF)
    assert out.columns[:3] == ["doc_id", "start", "length"] and out.count() > 50


def test_odd_tables(spark, docs_of):
    for some in ([], [(1, None), (1, None), (None, "x"), (2, "y " * 40000), (3, "")]):
        docs = docs_of(some)
        for _, stage in P.STAGES:
            docs = stored(spark, stage(spark, docs, SF), "t")
        assert docs.count() >= (3 if some else 0)
