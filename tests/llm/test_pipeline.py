"""The pipeline against a plain version of its stages."""

import random

import corpus_pipeline
from pyspark.sql import functions as F

from terradelta.llm import latent, packing, pseudonyms
from terradelta.llm.queries import PSEUDONYM_KEY, tokenizer_path

from .test_operators import SCHEMA, check_packing, plain_classes, plain_repetition, prose


def test_run(spark, tmp_path):
    r, texts = random.Random(9), []
    for seed in range(25):
        w = prose(90, seed).split()
        texts.append(" ".join(w))
        if seed % 3 == 0:
            w[r.randrange(90)] = "changed"
            texts += [" ".join(w), texts[-1]]
    item = prose(30, 777)
    texts += ["few words here", "spam " * 60, prose(40, 801) + " " + item + " " + prose(40, 802), prose(50, 803) + " +1 (555) 010-1234", None, ""]
    spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = [i for i, t in enumerate(texts) if (m := plain_repetition(t, 5))[0] >= 10 and 5 * m[1] <= m[0]]
    classes = plain_classes([texts[i] for i in kept])
    kept = [i for k, i in enumerate(kept) if classes[k] == k and item not in texts[i]]
    want = {i: pseudonyms.pseudonymise_text(texts[i], PSEUDONYM_KEY)[0] for i in kept}
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    sizes = {i: len(b) // 4 + 1 for i, b in zip(want, packing.token_bytes(list(want.values()), tokenizer_path()), strict=True)}
    assert {x.doc_id: x.length for x in rows} == sizes
    check_packing(rows, packing.Limits())


def test_stages_keep_the_columns(spark, tmp_path):
    """Nulls everywhere, empty and very long texts, repeated rows, and columns named like results."""
    rows = [(1, prose(40, 1), "en", "s", 1), (1, prose(40, 1), "en", "s", 1), (None, None, None, None, None), (2, "", "en", "s", 0), (3, prose(20_000, 2), None, "s", 1), (None, prose(50, 3), "en", None, 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for name in ("kept", "class_id", "label", "item_id", "number", "found", "spans"):
        docs = docs.withColumn(name, F.lit("x"))
    spark.createDataFrame([(0, prose(30, 7))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, str(tmp_path))
        assert kept.columns == docs.columns
        want = {"quality rules": [1, 1, 3, None], "near copies": [1, 2, 3, None, None]}.get(name, [1, 1, 2, 3, None, None])
        assert sorted((r.doc_id for r in kept.collect()), key=lambda i: (i is None, i)) == want
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_decontamination_is_fitted_on_every_row(spark, tmp_path, monkeypatch):
    """All rows that the stage is given and all items make the basis, with no bound on either."""
    seen, plain = [], latent.randomised_svd
    monkeypatch.setattr(latent, "randomised_svd", lambda rows, *more: seen.append(rows.count()) or plain(rows, *more))
    docs = spark.createDataFrame([(i, prose(33, i), "en", "s", 1) for i in range(2100)], SCHEMA)
    spark.createDataFrame([(i, prose(6, 10_000 + i)) for i in range(4200)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    corpus_pipeline.decontamination(spark, docs, str(tmp_path))
    assert seen == [2100 + 4200]
