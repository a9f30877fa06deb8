"""The pipeline's stages against what they must keep, on a small folder with odd rows."""

import corpus_pipeline as C


def test_stages(spark, tmp_path):
    draw = "lorem ipsum dolor sit amet consetetur sadipscing elitr sed diam".split()
    words = lambda k: " ".join(draw[(k * 7 + i * i) % len(draw)] + str((k * i) % 97) for i in range(120))
    passage = "this passage stands in two documents " * 12
    texts = {1: words(1), 2: words(1), 3: words(2) + " you stupid idiot. pathetic loser.", 4: words(3) + passage + words(4), 5: words(5) + passage + words(6), 6: None, 7: words(7) + " password=0123456789abcdef99"}
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(3, 1, 1), (1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    held, at = {}, docs
    for name, stage in C.STAGES:
        at = C.written(stage(spark, at, str(tmp_path)), name)
        held[name] = {r.doc_id: r for r in at.collect()}
        if name != "packing":
            assert at.columns == docs.columns
    assert set(held["toxicity"]) == {1, 2, 4, 5, 6, 7}
    assert set(held["near_dedup"]) == {1, 4, 5, 6, 7}
    assert "two documents this passage" not in held["suffix_dedup"][4].text and held["suffix_dedup"][1].text == texts[1]
    assert "[SECRET]" in held["secrets"][7].text and held["secrets"][7].n_chars == len(held["secrets"][7].text)
    assert set(held["packing"]) == {1, 4, 5, 6, 7}
    assert [n for n, _ in C.STAGES] == ["toxicity", "near_dedup", "suffix_dedup", "secrets", "packing"]


def test_clashing_and_null_columns(spark, tmp_path):
    """Columns named like the operators' own pass through every filtering stage untouched; nulls, repeats and empty tables too."""
    names = "doc_id long, text string, lang string, source string, n_chars long, score double, predicted int, fp long, d long, th long, spans string, _id long, tags map<string,int>"
    row = lambda i, t: (i, t, None, None, None, 0.9, 1, 5, 6, 7, "s", 8, {"a": 1})
    docs = spark.createDataFrame([row(1, "some words that stand here"), row(1, "some words that stand here"), row(None, None), row(None, "other words that stand there"), row(4, "x " * 3000)], names)
    spark.createDataFrame([(None, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    for table in (docs, docs.limit(0)):
        at = table
        for name, stage in C.STAGES[:-1]:
            at = C.written(stage(spark, at, str(tmp_path)), name)
            assert at.columns == docs.columns
            assert all(r[5:] == (0.9, 1, 5, 6, 7, "s", 8, {"a": 1}) for r in map(tuple, at.collect()))
        packed = C.STAGES[-1][1](spark, at, str(tmp_path))
        assert sorted(str(r.doc_id) for r in packed.where("piece = 0").collect()) == (["1", "4", "None", "None"] if table is docs else [])
