"""Language of texts of a million characters and more."""

from kestrel.llm import langid


def test_long_clean_texts_keep_their_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = langid.fit(docs, langid.fold(3) != 1)
    classify = model.classifier()
    rows = docs.filter("lang is not null and length(text) between 500 and 20000").select("lang", "text").distinct().orderBy("text").collect()
    for lang in [name for name, _ in model.dictionaries]:
        text = "\n".join(r["text"] for r in rows if r["lang"] == lang)
        found = [classify(text[: len(text) // n]) for n in (20, 1)]
        assert len(text) > 1_000_000
        assert all(f[0] == lang and not f[3] for f in found), (lang, found)
        assert found[-1][2] > found[0][2] / 2  # the margin does not fall with the length
