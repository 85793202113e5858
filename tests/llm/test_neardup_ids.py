"""Rows of one id or none in the pipeline's near-dedup."""

import corpus_pipeline


def test_rows_are_told_apart_by_id_and_text(docs):
    long = [" ".join(f"{c}{k}" for k in range(40)) for c in "abc"]
    rows = [(7, long[0]), (7, long[1]), (8, long[1]), (21, long[2]), (None, None), (7, long[0])]
    got = corpus_pipeline.near_dedup(None, docs(rows), "").collect()
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in got) == sorted([("7", long[0]), ("7", long[1]), ("21", long[2]), ("None", "")])
