"""Near-dedup: a pair that is similar is linked however far apart its fingerprints lie."""

import numpy as np

from patchscope.llm import simhash

SHORT = "w31333 w80158 w58899 w93979 w80470 w50369 w18605 w43646"
LONGER = SHORT + " w75152"  # five runs of five words, four of them shared: 0.8


def test_similar_texts_beyond_the_radius_are_linked(spark):
    assert (simhash.fingerprint(SHORT, 5) ^ simhash.fingerprint(LONGER, 5)).bit_count() > simhash.WIDE_RADIUS
    docs = spark.createDataFrame([(1, SHORT), (2, LONGER), (3, "w80093 w44279 w643 w50316 w51936 w26187 w64206 w15214")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.similar_dedup(docs).collect()) == [1, 3]


def test_the_radius_changes_no_result(spark):
    """Keys small and large, and one group in shares."""
    rng = np.random.default_rng(4)
    base = rng.choice([f"w{i}" for i in range(500)], 60).tolist()
    texts = [" ".join([*base[: 60 - i], *(f"x{i}{j}" for j in range(i % 7))]) for i in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = [sorted(r["doc_id"] for r in simhash.similar_dedup(docs, radius=radius).collect()) for radius in (-1, 6, 64)]
    assert kept[0] == kept[1] == kept[2] and 1 <= len(kept[0]) < 30
