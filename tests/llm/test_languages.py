"""Every language of a table is learned, from texts that are short enough."""

from contactloom.llm import languages


def test_more_than_64_languages_and_long_texts(spark, monkeypatch):
    rows = [(i, " ".join(f"{chr(97 + i // 26)}{chr(97 + i % 26)}{w}" for w in "abc"), f"l{i}") for i in range(66)]
    rows += [(1000 + i, "long " * 200, "mixed") for i in range(40)] + [(2000, "short text here", "mixed")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    monkeypatch.setattr(languages.crf, "fit", list)  # what is learned from
    learned = languages.fit(docs, per_language=2, most_bytes=500)
    assert {y for _, y in learned} == {r[2] for r in rows} and ("short text here", "mixed") in learned
