"""Each stage of the pipeline on what its predecessor kept, against brute force."""

from collections import Counter

import brute
import corpus_pipeline
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

from palimpsest.llm import quality

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = []
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(number)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(number)))
        kept.append((before, docs))
    rows = [[Counter((r.doc_id, r.text) for r in df.collect()) for df in pair] for pair in kept]
    judged = quality.classify(kept[0][0], spark.read.parquet(f"{SF}/labels.parquet"), F.col("source"), F.col("lang"))
    accepted = {r.doc_id for r in judged.filter("accepted").collect()}
    assert rows[0][1] == Counter({r: n for r, n in rows[0][0].items() if r[0] in accepted})
    largest = {}
    for i, t in rows[1][0]:
        n = (t or "").translate(brute.LOWER)
        largest[n] = max(largest.get(n, -1), i)
    assert {r[0] for r in rows[1][1]} == set(largest.values())
    assert {r[0] for r in rows[2][1]} == {i for i, _, _, k in brute.near_groups(list(rows[2][0])) if k}
    assert set(rows[3][1]) <= set(rows[3][0]) and max(rows[3][1].values()) <= 2
    words = sum(len(brute.words(t)) * n for (_, t), n in rows[3][1].items())
    assert abs(words / (1.5 * sum(len(brute.words(t)) for _, t in rows[3][0])) - 1) < 0.2
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    want = Counter({(i, tuple(model.encode(t or ""))): n for (i, t), n in rows[3][1].items()})
    assert Counter((r.doc_id, tuple(r.ids)) for r in last.collect()) == want


def test_stages_on_odd_rows(spark, tmp_path):
    """Null, repeated and tied ids, empty and long texts, columns with clashing names: each row is judged by its own text."""
    words = [f"w{i}" for i in range(400)]
    base, other = " ".join(words[:200]), " ".join(words[200:])
    near = base.replace("w50 ", "x ")
    rows = [(7, base), (7, other), (None, near), (None, "alone"), (None, "ALONE"), (7, "alone"), (8, None), (9, ""), (None, " ".join(words * 50)), (8, "one more")]
    clashing = "row long, _row long, _gone string, _id string, copies int, component string, key string, _metadata string"
    docs = spark.createDataFrame([(i, t, None, "en", 1, k, k, "g", "i", 2, "c", "k", "m") for k, (i, t) in enumerate(rows)], "doc_id long, text string, source string, lang string, n_chars long, " + clashing).repartition(3)
    text = lambda df: Counter((r.doc_id, (r.text or "").translate(brute.LOWER)) for r in df.collect())
    exact = corpus_pipeline.exact_stage(spark, docs, SF)
    assert exact.columns == docs.columns
    assert text(exact) == Counter([(7, base), (7, other), (None, near), (7, "alone"), (9, ""), (None, rows[8][1]), (8, "one more")])
    left = corpus_pipeline.near_stage(spark, docs, SF)
    assert left.columns == docs.columns
    got = Counter(r.text for r in left.collect())
    assert got[base] == 1 and got[near] == 0 and got[other] == 1 and got["alone"] + got["ALONE"] == 1 and got[None] == got[""] == 1 and sum(got.values()) == 7
    mixed = corpus_pipeline.mixing_stage(spark, docs, SF)
    assert mixed.columns == docs.columns
    assert set(text(mixed)) <= set(text(docs)) and max(r["count"] for r in mixed.groupBy("row").count().collect()) <= 2
    judged = corpus_pipeline.quality_stage(spark, docs, SF)
    assert judged.columns == docs.columns and set(text(judged)) <= set(text(docs))
    assert corpus_pipeline.tokens_stage(spark, docs, SF).count() == len(rows)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0
