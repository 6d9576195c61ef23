"""Centroid clustering, Merkle fingerprints and ranked search against brute force, and on odd rows."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from patchscope.llm import clusters, merkle, ranked

CLASH = "cluster int, text string, score string"


def lloyd(rows, k=16, rounds=3):
    """Clusters of (id, integers) without any filter."""
    starts = sorted(rows, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    centroids = [list(r[1]) for r in starts]
    nearest = lambda q: min((sum((a - b) ** 2 for a, b in zip(q, c)), i) for i, c in enumerate(centroids))
    for _ in range(rounds):
        labels = [nearest(q)[1] for _, q in rows]
        for i in range(len(centroids)):
            own = [q for (_, q), label in zip(rows, labels) if label == i]
            if own:
                centroids[i] = [sum(x) // len(own) for x in zip(*own)]
    return [(r[0], nearest(r[1])[1], nearest(r[1])[0]) for r in rows], centroids


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 0.3, (5, 64))
    values = [(centres[i % 5] + rng.normal(0, 0.05, 64)).astype(np.float32).tolist() for i in range(300)]
    rows = [(i, v, 1, "x", "y") for i, v in enumerate(values)]
    rows += [(7, values[7], 1, "x", "y"), (None, values[8], 1, "x", "y"), (400, [0.0] * 64, 1, "x", "y"), (401, [0.0] * 64, 1, "x", "y")]
    odd = [(500, None), (501, []), (502, [1.0] * 63), (503, [1.0] * 63 + [None]), (504, [1.0] * 63 + [math.nan]), (505, [1.0] * 63 + [math.inf])]
    return spark.createDataFrame([*rows, *((i, v, 1, "x", "y") for i, v in odd)], f"vec_id long, embedding array<float>, {CLASH}"), rows


def test_clusters_equal_plain_lloyd(vectors):
    df, rows = vectors
    whole = [(r[0], [math.floor(64 * x) for x in r[1]]) for r in rows]
    want, centroids = lloyd(whole)
    got = clusters.clustered(df).collect()
    assert Counter((r["vec_id"], r["cluster"], r["distance"]) for r in got) == Counter(want)
    assert {r["inertia"] for r in got} == {sum(d for _, _, d in want)}
    for r in got:
        assert r["cluster_inertia"] == sum(d for _, c, d in want if c == r["cluster"])
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, centroids[r["cluster"]])).encode()).hexdigest()


def test_few_vectors_and_none(spark, vectors):
    df = vectors[0]
    assert clusters.clustered(df.limit(0)).count() == 0 and clusters.clustered(df.where("vec_id >= 500")).count() == 0
    assert sorted((r["vec_id"], r["distance"]) for r in clusters.clustered(df.where("vec_id in (400, 401)")).collect()) == [(400, 0), (401, 0)]
    with pytest.raises(Exception, match="must lie below"):
        clusters.clustered(spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<double>"))


def test_the_filter_never_loses_the_nearest_and_spares_work():
    rng = np.random.default_rng(9)
    centroids = rng.integers(-40, 40, (16, 64))
    q = np.concatenate([centroids[rng.integers(0, 16, 3000)] + rng.integers(-6, 7, (3000, 64)), rng.integers(-40, 40, (200, 64)), centroids, np.zeros((5, 64), int)])
    basis = np.linalg.eigh(np.cov(q.T))[1][:, ::-1]
    lead, rest = clusters.rotated(q, basis, 16)
    label, distance, done = clusters.nearest(q, lead, rest, centroids, basis)
    exact = ((q[:, None] - centroids) ** 2).sum(axis=2)
    assert (label == exact.argmin(axis=1)).all() and (distance == exact.min(axis=1)).all()
    assert done < 0.2 * exact.size


def test_trees_of_equal_and_edited_texts():
    rng = random.Random(2)
    text = "".join(rng.choice(["word ", "and ", "other", "\n", "\n\n", "# head\n", "漢字", "é"]) for _ in range(4000))
    tree = merkle.Tree.of(text)
    assert tree.root == merkle.Tree.of(text).root and tree.n_chars == len(text)
    assert merkle.Tree.from_bytes(tree.to_bytes()).__dict__ == tree.__dict__
    for level in (1, 2, 3):
        assert [*tree.starts[level], len(text)] == [0, *tree.ends[level]]
    edited = text[:5000] + "CHANGED" + text[5003:]
    other = merkle.Tree.of(edited)
    _, mine, theirs = merkle.unmatched(tree, other)
    assert other.root != tree.root and merkle.likeness(tree, other) > 0.98
    a, b = merkle.spans(tree, mine), merkle.spans(other, theirs)
    assert len(b) == 1 and b[0][0] <= 5000 and b[0][1] >= 5007 and b[0][1] - b[0][0] < 120 and all(e - s < 120 for s, e in a)
    pieces = [("ab" * 40)[:i] for i in range(60)] + ["\n" * i for i in range(1, 9)] + ["a\nb", "ab\n", "\nab"]
    assert len({merkle.Tree.of(p).root for p in pieces}) == len(set(pieces))
    empty = merkle.Tree.of(None)
    assert empty.root == merkle.Tree.of("").root and merkle.likeness(empty, empty) == 1.0 and merkle.likeness(empty, tree) == 0.0


@pytest.mark.parametrize("cut", [0, 1, 2, 23])
def test_edited_texts_follow_the_order_of_ids(spark, cut):
    rng = random.Random(5)
    texts = [None, "", "a", "one two three", *("".join(rng.choice("abcdef \n") for _ in range(rng.randint(0, 400))) for _ in range(18)), "same " * 50]
    ids = rng.sample(range(-50, 1000), len(texts))
    rows = list(zip(ids, texts))[:cut]
    df = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], "doc_id long, text string, fingerprint string, tail int, near_next string").repartition(5)
    ordered = sorted(rows)
    want = {}
    for at, (i, t) in enumerate(ordered):
        own, following = t or "", ordered[(at + 1) % len(ordered)][1] or ""
        half = len(own) // 2
        edited = own[: len(own) - half] + following[:half]
        trees = [merkle.Tree.of(x) for x in (own, edited, following)]
        want[i] = (len(own), hashlib.sha256(edited.encode()).hexdigest(), trees[0].root, trees[1].root,
                   round(merkle.likeness(*trees[:2]), 6), round(merkle.likeness(trees[0], trees[2]), 6))
    got = merkle.edited_likeness(df).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == want and len(got) == len(rows)


def test_repeated_and_missing_ids_keep_their_rows(spark):
    rows = [(None, "x y"), (None, None), (1, "same"), (1, "same"), (1, "other"), (2, "end")]
    got = merkle.edited_likeness(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r["doc_id"], r["n_chars"]) for r in got) == Counter((i, len(t or "")) for i, t in rows)


def test_stored_trees_are_compared_without_texts(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma delta " * 20), (2, None)], "doc_id long, text string")
    made = merkle.fingerprints(docs)
    pair = made.selectExpr("doc_id", "tree as tree_a").crossJoin(made.where("doc_id = 1").selectExpr("tree as tree_b"))
    got = {r["doc_id"]: (r["near"], r["spans_a"], len(r["spans_b"])) for r in merkle.compare(pair).collect()}
    assert got == {1: (1.0, [], 0), 2: (0.0, [], 1)} and merkle.compare(pair.limit(0)).count() == 0


def ranking(docs, items, top):
    """Scores of all documents for all items by the formula."""
    of = lambda t: [x.translate({c: c + 32 for c in range(65, 91)}) for x in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    held = [(i, Counter(of(t)), len(of(t))) for i, t in docs if of(t)]
    n_docs, n_terms = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        scored = []
        for i, counts, n in held:
            m = 50 + 50 * n * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * counts[t] // (1000 * counts[t] + 20 * m)) for t in set(of(text)) if counts[t])
            if score > 0:
                scored.append((-score, i is not None, i or 0, i))
        out += [(item, rank, i, -score) for rank, (score, _, _, i) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=str)


def test_search_equals_scoring_every_document(spark, monkeypatch):
    rng = random.Random(8)
    words = [f"{w}{i}" for i in range(60) for w in ("Ab", "é", "9")]
    draw = lambda n: " ".join(words[min(int(rng.expovariate(0.05)), len(words) - 1)] for _ in range(n))
    docs = [(i, draw(rng.randint(0, 80))) for i in range(900)] + [(5, "Ab1 ab1 É1"), (None, "Ab0 Ab0"), (7000, None), (7001, ""), (7002, "- , .")]
    items = [(i, draw(rng.randint(1, 30))) for i in range(12)] + [(1, "AB1"), (20, None), (21, "?!"), (22, "unknown"), (3, "ab1-É1"), (3, "ab1-É1"), (None, "é2")]
    frame = spark.createDataFrame([(i, t, 0, "x", "y") for i, t in docs], "doc_id long, text string, rank int, score string, terms string").repartition(3)
    asked = spark.createDataFrame([(i, t, 1, 2) for i, t in items], "item_id long, text string, query int, doc_id long")
    for block, docs_in, priming in ((256, 1 << 15, 1 << 16), (16, 100, 1 << 16), (8, 100, 60)):
        monkeypatch.setattr(ranked, "BLOCK", block)
        monkeypatch.setattr(ranked, "SEGMENT_DOCS", docs_in)
        for top in (5, 50):
            got = [tuple(r) for r in ranked.search(frame, asked, top, priming).collect()]
            assert sorted(got, key=str) == ranking(docs, items, top)
    monkeypatch.setattr(ranked, "QUERY_BYTES", 400)  # several passes
    assert sorted((tuple(r) for r in ranked.search(frame, asked, 5).collect()), key=str) == ranking(docs, items, 5)
    assert ranked.search(frame.limit(0), asked).count() == 0 and ranked.search(frame, asked.limit(0)).count() == 0


def test_a_threshold_skips_blocks():
    import pyarrow as pa

    rng = np.random.default_rng(1)
    n = 20_000
    lists = [sorted({0, *([1] if i % 7 else []), *([2] if i == 12_345 else [])}) for i in range(n)]
    batch = pa.RecordBatch.from_arrays([
        pa.array(np.arange(n)), pa.array(rng.integers(5, 50, n)), pa.array(lists, pa.list_(pa.int32())),
        pa.array([[1] * len(x) for x in lists], pa.list_(pa.int32()))], ["doc_id", "n", "terms", "counts"])
    segment, seen = ranked.Segment([batch], n, 27 * n), []
    docs, scores = segment.search([(0, 1), (1, 150), (2, 9000)], 1, 0, seen)
    assert docs.tolist() == [12_345] and sum(seen) < n
    seen.clear()
    assert segment.search([(0, 1), (1, 150), (2, 9000)], 1, int(scores[0]), seen)[0].tolist() == [12_345] and sum(seen) == ranked.BLOCK
