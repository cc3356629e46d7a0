"""The language stage where no label can be learned from."""

import pytest

import corpus_pipeline as pipeline
from quern.llm import langid


@pytest.mark.parametrize("labelled", [False, True])
def test_clean_documents_stay_without_labels(spark, sf_dir, labelled):
    rows = [(1, "plain words", None, "s", 11), (2, "123 --", None, "s", 6), (3, None, None, "s", None), (4, "\u65e5\u672c", None, "s", 2), (5, "", None, "s", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    if labelled:  # among held-out rows only
        held = df.selectExpr("*").where(langid.is_held_out(df.doc_id))
        df = df.join(held.selectExpr("doc_id", "'en' AS seen"), "doc_id", "left").selectExpr("doc_id", "text", "coalesce(lang, seen) AS lang", "source", "n_chars")
    assert sorted(r["doc_id"] for r in pipeline.language_id(spark, df, sf_dir).collect()) == [1, 4]


def test_texts_without_a_clear_language_go(spark, sf_dir):
    """Letters that three languages use alike leave none of them over one half."""
    rows = [(d, t, lang, "s", len(t)) for d, (t, lang) in enumerate([("aaa bbb aaa", "x"), ("ccc ddd ccc", "y"), ("eee fff eee", "z")] * 40)]
    asked = [(1000, "qqq", None, "s", 3), (1001, "aaa bbb", None, "s", 7)]
    df = spark.createDataFrame(rows + asked, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"] for r in pipeline.language_id(spark, df, sf_dir).collect()}
    assert 1001 in kept and 1000 not in kept and set(range(120)) <= kept
