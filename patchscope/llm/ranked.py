"""Ranked lexical search: term at a time over short lists, document at a time over long ones.

The terms of the queries are few and known, so one pass over the documents keeps, per
document, its length and the occurrences of query terms; nothing is shuffled by term. Tasks
read that table in segments of documents. In a segment each query term has a list of
documents. For a query, the short lists are summed into accumulators, which from then on act
as one more list with a bound of its own. It and the long lists are merged document at a
time, block by block in id order: blocks whose bounds cannot reach the query's threshold are
skipped, and in the others documents drop out as soon as what is left cannot lift them. The
threshold is the lowest score among the best found, and starts from the scores in a few
segments, so later segments return few rows. All scores are exact integers.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from patchscope.llm.common import release
from patchscope.session import checkpointed

TOP = 50
#: Separators become blanks and A-Z lower case; what blanks part are the terms. Bytes over 127 are parts of terms.
FOLD = bytes((c if c > 127 or chr(c).isalnum() else 32) | (32 if 65 <= c <= 90 else 0) for c in range(256))
#: Bytes of query texts worked on at once; further queries go in further passes.
QUERY_BYTES = 32_000_000
#: A segment closes with the batch that brings it to this many documents or postings.
SEGMENT_DOCS, SEGMENT_POSTINGS = 1 << 15, 1 << 21
BLOCK = 256
#: Lists are short as long as all of them together have less than one posting for so many documents of the segment.
SHORT = 8
#: Documents whose scores give the first thresholds, on average.
PRIMING_DOCS = 1 << 16


def terms(text: str | None) -> list[bytes]:
    """Terms of a text: runs of letters and digits of ASCII and of all other characters, A-Z in lower case."""
    return (text or "").encode().translate(FOLD).split()


def postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (terms with repeats) and, for the vocabulary only, term numbers and occurrences of each document with a term."""
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(vocabulary)  # bounded by QUERY_BYTES

    def run(batches):
        release()
        known = shared.value
        for batch in batches:
            ids, sizes, numbers, counts = [], [], [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                found = terms(text.as_py())
                if found:
                    own = sorted((known[t], n) for t, n in Counter(found).items() if t in known)
                    ids.append(doc_id)
                    sizes.append(len(found))
                    numbers.append([t for t, _ in own])
                    counts.append([n for _, n in own])
            lists = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(numbers, lists), pa.array(counts, lists)], ["doc_id", "n", "terms", "counts"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, terms array<int>, counts array<int>")


class Segment:
    """Lists of a range of documents: per term the documents, in id order, and their impacts (without the term's weight)."""

    def __init__(self, batches: list[pa.RecordBatch], n_docs: int, n_terms: int):
        table = pa.Table.from_batches(batches).combine_chunks()
        self.ids = table.column("doc_id").fill_null(-(2**63)).to_numpy()
        order = np.argsort(self.ids, kind="stable")
        self.ids = self.ids[order]
        sizes = table.column("n").to_numpy()
        lists = table.column("terms").combine_chunks()
        width = np.diff(lists.offsets.to_numpy())
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        term = lists.values.to_numpy()[lists.offsets[0].as_py() : lists.offsets[-1].as_py()]
        counts = table.column("counts").combine_chunks()
        tf = counts.values.to_numpy()[counts.offsets[0].as_py() : counts.offsets[-1].as_py()].astype(np.int64)
        doc = np.repeat(place, width)
        m = 50 + (50 * sizes * n_docs) // n_terms
        impact = (1_000_000_000 * tf) // (1000 * tf + 20 * np.repeat(m, width))
        by_term = np.lexsort((doc, term))
        term, self.docs, self.impacts = term[by_term], doc[by_term], impact[by_term]
        self.terms, starts = np.unique(term, return_index=True)
        self.bounds = dict(zip(self.terms.tolist(), zip(starts.tolist(), [*starts[1:].tolist(), len(term)])))
        self.blocks = -(-len(self.ids) // BLOCK)
        self._tops: dict[int, np.ndarray] = {}

    def block_tops(self, term: int) -> np.ndarray:
        """The largest impact of a term in each block of documents."""
        if term not in self._tops:
            start, end = self.bounds[term]
            tops = np.zeros(self.blocks, np.int64)
            np.maximum.at(tops, self.docs[start:end] // BLOCK, self.impacts[start:end])
            self._tops[term] = tops
        return self._tops[term]

    def search(self, query: list[tuple[int, int]], top: int, threshold: int, seen: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Documents (places in the segment) and scores that can be among the best; of those with a score of ``threshold`` or more.

        ``query`` has (term, weight). ``seen`` collects how many documents were scored.
        """
        lists = sorted((self.bounds[t][1] - self.bounds[t][0], t, w) for t, w in query if t in self.bounds and w > 0)
        used, short = 0, 0
        while short < len(lists) and (used + lists[short][0]) * SHORT <= len(self.ids):
            used += lists[short][0]
            short += 1
        # term at a time: accumulators of the short lists, as one list with tops of its own
        docs = np.concatenate([np.zeros(0, np.int64), *(self.docs[slice(*self.bounds[t])] for _, t, _ in lists[:short])])
        gains = np.concatenate([np.zeros(0, np.int64), *(w * self.impacts[slice(*self.bounds[t])] for _, t, w in lists[:short])])
        held, where = np.unique(docs, return_inverse=True)
        sums = np.zeros(len(held), np.int64)
        np.add.at(sums, where, gains)
        tops = np.zeros(self.blocks, np.int64)
        np.maximum.at(tops, held // BLOCK, sums)
        # document at a time: the accumulators and the long lists, strongest bound first
        long = [(w * self.block_tops(t), self.docs[slice(*self.bounds[t])], self.impacts[slice(*self.bounds[t])], w) for _, t, w in lists[short:]]
        long.sort(key=lambda x: -int(x[0].max()))
        bound = tops + sum((x[0] for x in long), np.zeros(self.blocks, np.int64))
        best_docs, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
        threshold, block = max(threshold, 1), 0
        while True:
            ahead = np.flatnonzero(bound[block:] >= threshold)
            if not len(ahead):
                return best_docs, best
            block += int(ahead[0])
            first, past = block * BLOCK, (block + 1) * BLOCK
            score, left = np.zeros(BLOCK, np.int64), int(bound[block])
            a, b = np.searchsorted(held, (first, past))
            score[held[a:b] - first] = sums[a:b]
            left -= int(tops[block])
            alive = np.ones(BLOCK, bool)
            for list_tops, list_docs, list_impacts, w in long:
                if not list_tops[block]:
                    continue
                a, b = np.searchsorted(list_docs, (first, past))
                score[list_docs[a:b] - first] += w * list_impacts[a:b]
                left -= int(list_tops[block])
                alive &= score + left >= threshold
                if not alive.any():
                    break
            rows = np.flatnonzero(alive & (score >= threshold))
            if seen is not None:
                seen.append(BLOCK)
            if len(rows):
                best_docs, best = np.r_[best_docs, rows + first], np.r_[best, score[rows]]
                if len(best) >= top:
                    kept = np.lexsort((best_docs, -best))[:top]
                    best_docs, best = best_docs[kept], best[kept]
                    if len(best) == top:  # a later document with an equal score has a larger id
                        threshold = max(threshold, int(best[-1]) + 1)
            block += 1


def found_in(segments: DataFrame, queries: list[tuple[int, list[tuple[int, int]], int]], n_docs: int, n_terms: int, top: int) -> DataFrame:
    """The best of each segment: query, doc_id, score. ``queries``: (number, terms with weights, threshold)."""
    shared = segments.sparkSession.sparkContext.broadcast(queries)

    def run(batches):
        release()
        for held in gathered(batches):
            segment, out = Segment(held, n_docs, n_terms), []
            for number, query, threshold in shared.value:
                docs, scores = segment.search(query, top, threshold)
                out.append((np.full(len(docs), number), segment.ids[docs], scores))
            columns = [np.concatenate(x) for x in zip(*out)] or [np.zeros(0, np.int64)] * 3
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], ["query", "doc_id", "score"])

    return segments.mapInArrow(run, "query int, doc_id long, score long")


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Batches in lists of bounded size."""
    held, docs, size = [], 0, 0
    for batch in batches:
        if len(batch):
            held.append(batch)
            docs, size = docs + len(batch), size + len(batch.column("terms").flatten())
        if docs >= SEGMENT_DOCS or size >= SEGMENT_POSTINGS:
            yield held
            held, docs, size = [], 0, 0
    if held:
        yield held


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _best(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _pass(docs: DataFrame, items: list[tuple[object, list[bytes]]], top: int, priming: int) -> DataFrame:
    """The search for as many queries as fit in memory: query, rank, doc_id, score."""
    vocabulary = {t: i for i, t in enumerate(sorted({t for _, own in items for t in own}))}
    table = checkpointed(postings(docs, vocabulary))
    n_docs, n_terms = table.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = {r["term"]: r["df"] for r in table.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect()}
    queries = [(i, [(k, weight(n_docs, df[k])) for k in sorted({vocabulary[t] for t in own}) if k in df], 1) for i, (_, own) in enumerate(items)]
    queries = [q for q in queries if q[1]]
    if priming and n_docs > 4 * priming:
        few = table.where(F.pmod(F.xxhash64("doc_id", "n"), F.lit(1 << 20)) < int(priming / n_docs * (1 << 20)))
        lowest = _best(found_in(few, queries, n_docs, n_terms, top), top).groupBy("query").agg(F.min("score").alias("score"), F.count("*").alias("n"))
        least = {r["query"]: r["score"] for r in lowest.where(F.col("n") == top).collect()}
        queries = [(i, own, least.get(i, 1)) for i, own, _ in queries]
    return _best(found_in(table, queries, max(n_docs, 1), max(n_terms, 1), top), top)


def search(docs: DataFrame, items: DataFrame, top: int = TOP, priming: int = PRIMING_DOCS) -> DataFrame:
    """The ``top`` documents (doc_id, text) of each item (item_id, text): item_id, rank, doc_id, score.

    Equal scores go by ascending doc_id, a NULL id first; scores are above 0. Items with no
    term, NULL or empty text find nothing; documents with no term count nowhere. Repeated
    documents each count and rank; repeated items (same id and text) are one, items with the
    same id and other text rank apart. Other columns are not read; empty tables give no rows.
    Items are read on the driver in passes of QUERY_BYTES of text, each against all documents.
    """
    spark = docs.sparkSession
    wanted = items.select(F.col("item_id").alias("item_id"), "text").distinct()
    sizes = checkpointed(wanted.withColumn("__size", F.octet_length(F.coalesce("text", F.lit(""))) + 64))
    passes = max(1, -(-(sizes.agg(F.sum("__size")).first()[0] or 0) // QUERY_BYTES))
    out = None
    kind = items.schema["item_id"].dataType.simpleString()
    for turn in range(passes):
        mine = sizes.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == turn).orderBy("item_id", "text").collect()
        named = [(r["item_id"], terms(r["text"])) for r in mine]
        ids = F.broadcast(spark.createDataFrame([(i, item) for i, (item, _) in enumerate(named)], f"query int, item_id {kind}"))
        doc_id = F.when(F.col("doc_id") != -(2**63), F.col("doc_id")).alias("doc_id")
        part = _pass(docs, named, top, priming).join(ids, "query").select("item_id", F.col("rank").cast("int").alias("rank"), doc_id, "score")
        out = part if out is None else out.union(part)
    return out


SQL = r"""WITH t AS MATERIALIZED (SELECT rid, doc_id, translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term, count(*) AS tf
  FROM (SELECT row_number() OVER () AS rid, doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS x FROM documents) GROUP BY ALL),
n AS (SELECT rid, CAST(sum(tf) AS BIGINT) AS n FROM t GROUP BY rid),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM n),
m AS (SELECT rid, 100 - 50 + (50 * n * docs) // terms AS m FROM n, total),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM t GROUP BY term), total),
q AS (SELECT DISTINCT item_id, text, translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
  FROM (SELECT item_id, text, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS x FROM benchmark)),
s AS (SELECT q.item_id, q.text, t.rid, any_value(t.doc_id) AS doc_id, CAST(sum(w.w * ((1000000000 * t.tf) // (1000 * t.tf + 20 * m.m))) AS BIGINT) AS score
  FROM q JOIN t USING (term) JOIN w USING (term) JOIN m USING (rid) GROUP BY q.item_id, q.text, t.rid)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM s WHERE score > 0) WHERE rank <= 50"""
