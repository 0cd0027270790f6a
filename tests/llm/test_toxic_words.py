"""Weighted words that spacing or repetition hides."""

import numpy as np
import pytest

from kestrel.llm import toxicity

MODEL = toxicity.ToxicityModel(np.zeros((toxicity.CLASSES,) * 3, np.float32), -2.0, {"stupid": 3.0, "idiot": 3.0})


@pytest.mark.parametrize(
    "text, hits",
    [
        ("what a s t u p i d thing", ["stupid"]),
        ("y $ t u p i d o", ["stupid"]),
        ("s t u p i d i d i o t", ["idiot", "stupid"]),
        ("s" * 70 + "tupid", ["stupid"]),
        ("i d i " + "o " * 90 + "t", ["idiot"]),
        ("a b c d e f " * 50, []),
        ("x" * 70 + "tupid", []),
    ],
)
def test_spaced_and_long_words_are_found(text, hits):
    assert MODEL.scorer()(text)[1] == hits


@pytest.mark.parametrize("toxic", [20, 40, 100, 180])
def test_words_are_weighted_for_every_share_of_toxic_rows(spark, toxic):
    clean = "good words about the weather in the north"
    rows = [(i, f"{clean} number {i % 7}" + (" you stupid idiot" if i < toxic else ""), int(i < toxic)) for i in range(200)]
    t = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(t.select("doc_id", "text"), t.select("doc_id", "toxic"))
    assert {"stupid", "idiot"} <= set(model.weights)
    assert {r["toxic"] == r["predicted"] for r in toxicity.score(t, model).select("toxic", "predicted").collect()} == {True}
