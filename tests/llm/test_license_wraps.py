"""A trigger of several words may be wrapped or double-spaced in the raw text."""

import duckdb
import pandas as pd

from parlance.llm import license_scan as L

WRAPPED = ["All rights\nreserved.", "All rights  reserved.", "Creative  Commons Zero", "This is Creative\n * Commons Zero.",
           "You should have received\na copy of it.", "Unless\nrequired by law", "No such words at all."]


def test_wrapped_triggers_match_sql(spark, docs_of):
    documents = pd.DataFrame({"doc_id": range(len(WRAPPED)), "text": WRAPPED})
    con = duckdb.connect()
    con.register("documents", documents)
    want = {r[0]: (r[1], r[3]) for r in con.execute(L.oracle_sql()).fetchall()}
    out = L.scan_licenses(docs_of(list(enumerate(WRAPPED)))).collect()
    assert {r.doc_id: (" ".join(r.sentence_ids), r.n_sentences) for r in out} == want
    assert all(want[i][1] for i in range(3))
