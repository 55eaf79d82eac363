"""What reaches the driver for the fit of the language model."""

from spendloom.llm import op3_language


def sampled(monkeypatch, docs, **how):
    sizes = []
    whole = type(docs).toPandas
    with monkeypatch.context() as m:
        m.setattr(type(docs), "toPandas", lambda self: (sizes.append(out := whole(self)), out)[1])
        model = op3_language.fit(docs, **how)
    return sizes[0], model


def test_null_and_repeated_ids(spark, monkeypatch):
    rows = [(None if i % 3 else 7, f"word{i} of a text {i}" if i % 2 else f"slovo{i} textu {i}", "en" if i % 2 else "cs") for i in range(300)]
    rows += [(1, "the same row", "en")] * 50 + [(None, None, "en"), (2, "no label", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    sample, model = sampled(monkeypatch, docs, texts=20)
    assert sample.groupby("label").size().to_dict() == {"en": 20, "cs": 20} and model.languages == ["cs", "en"]
    again, _ = sampled(monkeypatch, docs.repartition(7), texts=20)
    assert again.sort_values("text")["text"].tolist() == sample.sort_values("text")["text"].tolist()
    every, _ = sampled(monkeypatch, docs, texts=1_000)
    assert len(every) == 301


def test_labels_are_bounded(spark, monkeypatch):
    rows = [(i, f"text number {i}", f"dirty{i}") for i in range(60)] + [(100 + i, f"good text {i}", "en") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample, model = sampled(monkeypatch, docs, labels=3)
    assert len(model.languages) == 3 and "en" in model.languages and len(sample) == 7


def test_bytes_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(op3_language, "SAMPLE_TOTAL", 20_000)
    rows = [(i, f"word{i} " * 200, "en" if i % 2 else "cs") for i in range(200)] + [(1_000, "x y " * 20_000, "de")]
    sample, model = sampled(monkeypatch, spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5))
    sizes = sample.assign(b=sample["text"].str.len()).groupby("label")["b"].sum()
    assert sizes["en"] <= 20_000 // 3 and sizes["cs"] <= 20_000 // 3 and sizes["de"] == 80_000
    assert model.languages == ["cs", "de", "en"]
