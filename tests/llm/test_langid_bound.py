"""No label is left out of language identification unsaid."""

import pytest

from quern.llm import langid


def test_labels_beyond_the_bound_are_an_error(spark):
    train = spark.createDataFrame([("the cat", "en"), ("the dog", "en"), ("le chat", "fr")], "text string, lang string")
    assert langid.fit(train, max_langs=2).langs == ["en", "fr"]
    with pytest.raises(ValueError, match="max_langs"):
        langid.fit(train, max_langs=1)
