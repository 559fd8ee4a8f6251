import zlib

import numpy as np

from feedloom.llm.quality import fit, keep_quality, quality, terms


def labelled(spark, count=300):
    rng = np.random.default_rng(0)
    docs, labels = [], []
    for i in range(count):
        words = ["".join(rng.choice(list("aeioulnrst"), rng.integers(2, 8))) for _ in range(80)]
        good = i % 3 > 0
        docs.append((i, " ".join(words) + "." if good else " ".join(w.upper() + "!!" for w in words)))
        labels.append((i, int(good), 0))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(
        labels, "doc_id long, quality int, toxic int"
    )


def test_held_out_labels_are_predicted_and_not_learned(spark):
    docs, labels = labelled(spark)
    out = quality(docs, labels).collect()
    assert len(out) == 300 and all(0 <= r.score <= 1 for r in out)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    assert all(r.predicted == int(r.doc_id % 3 > 0) for r in out)
    flipped = labels.selectExpr(
        "doc_id", "IF(crc32(string(doc_id)) % 5 = 0, 1 - quality, quality) AS quality", "toxic"
    )
    again = {r.doc_id: r.score for r in quality(docs, flipped).collect()}
    assert again == {r.doc_id: r.score for r in out}


def test_scores_are_exact_votes(spark):
    docs, labels = labelled(spark, 60)
    model = fit(docs, labels)
    texts = [r.text for r in docs.collect()]
    embedded = model.embed([terms(t) for t in texts])
    for text, vector, score in zip(texts, embedded, model.score(texts, block=7), strict=True):
        cosines = model.vectors.astype(float) @ vector.astype(float)
        nearest = np.argsort(-cosines, kind="stable")[: model.neighbours]
        weight = np.maximum(cosines[nearest], 0) ** model.power
        assert abs(score - (weight * model.labels[nearest]).sum() / weight.sum()) < 1e-3, text


def test_edges(spark, cases):
    _, labels = labelled(spark, 60)
    docs = cases.docs()
    out = quality(docs, labels).collect()
    assert len(out) == len(cases.rows)
    by = {r.doc_id: r for r in out}
    assert by[2].score == by[3].score == by[4].score == 0 and by[None].held_out is False
    assert by[5].score == by[6].score
    assert quality(cases.empty(), labels).count() == 0
    assert {r.score for r in quality(docs, labels.limit(0)).collect()} == {0.5}
    kept = keep_quality(docs, labels, threshold=0.0)
    assert kept.columns == docs.columns and kept.count() == len(cases.rows)


def test_the_bound_on_labels_does_not_move_the_scores(spark):
    """Two good documents to a poor one, of which the bound takes as many of each."""
    docs, labels = labelled(spark, 600)
    model = fit(docs, labels, per_class=50)
    good = model.labels > 0.5
    assert abs(model.shares[good].mean() - 400 / 50) < 1e-9 and abs(model.shares[~good].mean() - 200 / 50) < 1e-9
    assert set(fit(docs, labels).shares) == {1.0}
    assert all(r.predicted == int(r.doc_id % 3 > 0) for r in quality(docs, labels, per_class=50).collect())


def test_tokens_of_any_length_are_read_to_their_end():
    long = "a1" * 40
    assert terms(long + "!") != terms(long + "?")
    assert terms("ab " + long)["\x00long7"] == 1 and terms("x" * 10**6)["a"] == 1
