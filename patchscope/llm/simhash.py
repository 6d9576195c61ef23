"""SimHash near-dedup with BK-trees.

A document's fingerprint has a bit set if it is set in over half of its shingle hashes.
Fingerprints at four or fewer differing bits are linked. If 64 bits are cut into six blocks,
two such fingerprints agree in at least two of them; so they meet in one of 15 shards, each
keyed by a pair of blocks and its bits. Each shard's fingerprints form a BK-tree (children
keyed by Hamming distance to the parent), and a search follows only edges within the radius.
Shards travel to tasks by shuffle, since broadcasting the trees of all data has no bound.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchscope.llm.common import attach, components, release
from patchscope.session import checkpointed

SHINGLE = 4
RADIUS = 4
#: Widths of the six blocks; any two that stay equal key a shard.
BLOCKS = (11, 11, 11, 11, 10, 10)
PAIRS = tuple(itertools.combinations(range(len(BLOCKS)), len(BLOCKS) - RADIUS))
#: Fingerprints of a tree at most; larger shards become several trees, each searched by all of the shard.
TREE_SIZE = 2048
#: (query, node) pairs looked at in one numpy step.
FRONTIER = 1 << 18
#: At a Jaccard similarity of 0.8 about 10 of 64 bits differ, with a deviation of about 3; this is far in the tail. Pairs within it are asked first.
WIDE_RADIUS = 24
#: Documents sampled for common shingles: one in SAMPLE_SHARE, SAMPLE_DOCS at least; how many of them hold a common one; how many are listed at most (8 bytes each).
SAMPLE_SHARE, SAMPLE_DOCS, COMMON_DOCS, COMMON = 50, 20_000, 3, 400_000
#: 64-bit words of a parity sketch at least and at most; in between, as many bits as the set has members.
SKETCH_WORDS = (4, 64)
#: Members of a key that are compared in all pairs at once; larger keys go member by member.
SMALL_KEY = 8
#: Shingles of the sets that are one share of a group of candidates; two shares meet in a task.
SHARE_GRAMS = 1 << 20
#: Ids of candidates that are broadcast at most.
BROADCAST_IDS = 500_000


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit fingerprint of a text; no words give zero."""
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: A-Z and the six ASCII white-space characters only
    if not words:
        return 0
    grams = [b" ".join(g) for g in zip(*(words[i:] for i in range(shingle)))] if len(words) >= shingle else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for start in range(0, len(grams), 65536):
        hashes = np.array([digest(g, 42) for g in grams[start : start + 65536]], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(grams), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of every row; NULL text has no words."""

    def run(batches):
        release()
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in batch.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


class Forest:
    """BK-trees of many shards at once, in arrays.

    Level by level, the first member of each group becomes a node and the rest is grouped by
    its distance to that node: the tree that inserting the members one after the other gives.
    """

    def __init__(self, shard: np.ndarray, fp: np.ndarray):
        group, rows = np.unique(shard, return_inverse=True)[1], np.arange(len(fp))
        order = np.argsort(group, kind="stable")
        group, rows = group[order], rows[order]
        first = np.r_[True, group[1:] != group[:-1]][: len(group)]
        self.fp, self.roots = fp, rows[first]
        edges: list[np.ndarray] = []
        children: list[np.ndarray] = []
        while len(rows):
            first = np.r_[True, group[1:] != group[:-1]]
            node = rows[first][np.cumsum(first) - 1][~first]
            rows = rows[~first]
            distance = np.bitwise_count(fp[node] ^ fp[rows]).astype(np.int64)
            group = node * 128 + distance
            order = np.argsort(group, kind="stable")
            group, rows = group[order], rows[order]
            if len(rows):
                first = np.r_[True, group[1:] != group[:-1]]
                edges.append(group[first])
                children.append(rows[first])
        self.edges = np.concatenate(edges) if edges else np.zeros(0, np.int64)
        self.children = np.concatenate(children) if children else np.zeros(0, np.int64)
        order = np.argsort(self.edges, kind="stable")
        self.edges, self.children = self.edges[order], self.children[order]

    def search(self, query: np.ndarray, root: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query index, row) of every member of the query's tree within the radius."""
        stack = [(np.arange(len(query)), root)]
        while stack:
            q, node = stack.pop()
            if len(q) > FRONTIER:
                stack += [(q[FRONTIER:], node[FRONTIER:]), (q[:FRONTIER], node[:FRONTIER])]
                continue
            distance = np.bitwise_count(query[q] ^ self.fp[node]).astype(np.int64)
            near = distance <= radius
            if near.any():
                yield q[near], node[near]
            low = np.searchsorted(self.edges, node * 128 + np.maximum(distance - radius, 0))
            high = np.searchsorted(self.edges, node * 128 + np.minimum(distance + radius, 127), side="right")
            width = high - low
            if width.any():
                ends = np.cumsum(width)
                place = np.arange(ends[-1]) - np.repeat(ends - width, width) + np.repeat(low, width)
                stack.append((np.repeat(q, width), self.children[place]))


def settle(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest row of each row's component; pairs are taken in block by block."""
    label = np.arange(n)
    for a, b in pairs:
        while True:
            low = np.minimum(label[a], label[b])
            before = label.copy()
            np.minimum.at(label, label[a], low)
            np.minimum.at(label, label[b], low)
            label = label[label]
            if (label == before).all() and (label[a] == label[b]).all():
                break
    while (label[label] != label).any():
        label = label[label]
    return label


def spanning(shard: np.ndarray, fp: np.ndarray, tree: np.ndarray, query: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between fingerprints that connect what lies within the radius, one per row at most."""
    members, asking = np.flatnonzero(tree), np.flatnonzero(query)
    forest = Forest(shard[members], fp[members])
    roots = dict(zip(shard[members][forest.roots].tolist(), forest.roots.tolist()))
    root = np.array([roots.get(s, -1) for s in shard[asking].tolist()])
    asking, root = asking[root >= 0], root[root >= 0]
    found = ((asking[q], members[m]) for q, m in forest.search(fp[asking], root, radius)) if len(asking) else iter(())
    label = settle(len(fp), found)
    moved = np.flatnonzero(label != np.arange(len(fp)))
    return fp[moved], fp[label[moved]]


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints (column fp) within the radius; never all pairs of a group."""
    if radius > len(BLOCKS) - 2:
        raise ValueError(f"blocks serve a radius of up to {len(BLOCKS) - 2}")
    starts = [sum(BLOCKS[:i]) for i in range(len(BLOCKS))]
    block = [F.shiftrightunsigned("fp", s).bitwiseAND(F.lit((1 << w) - 1)) for s, w in zip(starts, BLOCKS)]
    keys = [(F.lit(i << 22).cast("long") + F.shiftleft(block[a], 11) + block[b]).alias("key") for i, (a, b) in enumerate(PAIRS)]
    keyed = fps.select("fp", F.explode(F.array(*keys)).alias("key"))
    sizes = checkpointed(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    shards = F.ceil(F.col("n") / TREE_SIZE).cast("int")
    dealt = attach(keyed, sizes, ["key"], "n", "fp").where("n > 1").withColumn("shards", shards)
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("shards")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    # cell (i, j): the tree of share i, asked by share j
    dealt = dealt.select(
        "key", "fp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        (F.col("own") <= F.col("other")).alias("tree"), (F.col("own") >= F.col("other")).alias("query"))
    partitions = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(partitions, "key", "i", "j").sortWithinPartitions("key", "i", "j", "fp")

    def run(batches):
        held: pa.Table | None = None

        def work(table: pa.Table) -> pa.RecordBatch:
            key, i, j, fp = (table.column(c).to_numpy() for c in ("key", "i", "j", "fp"))
            cell = np.cumsum(np.r_[True, (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
            tree, query = (table.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("tree", "query"))
            a, b = spanning(cell, fp.view(np.uint64), tree, query, radius)
            return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (a, b)], ["a", "b"])

        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, table]) if held is not None else table
            key, i, j = (held.column(c).to_numpy() for c in ("key", "i", "j"))
            border = np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))
            if len(border):  # the last cell may go on in the next batch
                yield work(held.slice(0, int(border[-1]) + 1))
                held = held.slice(int(border[-1]) + 1)
        if held is not None and held.num_rows:
            yield work(held)

    return dealt.mapInArrow(run, "a long, b long")


def near_groups(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, fingerprint (16 hex digits), component_id, n_docs.

    component_id is the smallest doc_id that links reach, n_docs the rows with the same
    fingerprint. Texts without words, NULL and empty ones included, have fingerprint zero and
    are linked like any other. Repeated rows stay. A NULL doc_id is no candidate for
    component_id unless all of a component are NULL. An empty table gives no rows; other
    columns are not read.
    """
    made = checkpointed(fingerprints(docs, shingle))
    stats = checkpointed(made.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n_docs")))
    moved = checkpointed(components(links(stats.select("fp"), radius)))
    labels = stats.join(moved.select(F.col("node").alias("fp"), "label"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    labels = checkpointed(labels)
    least = labels.groupBy("label").agg(F.min("first").alias("component_id"), F.count("*").alias("__n"))
    named = checkpointed(attach(labels, checkpointed(least), ["label"], "__n", "fp").select("fp", "component_id", "n_docs"))
    out = attach(made, named, ["fp"], "n_docs", "doc_id")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_docs")


def near_dedup(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` that stay: of each component those with its smallest doc_id; rows with the same id stay together."""
    kept = near_groups(docs, shingle, radius).where("doc_id <=> component_id").select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")


def shingles(text: str | None, shingle: int) -> np.ndarray:
    """Distinct hashes of a text's runs of ``shingle`` words, ascending; a shorter text is one run, no words give none."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    grams = (b" ".join(g) for g in zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(g, 42) for g in grams), np.uint64))


def set_name(grams: np.ndarray) -> int:
    """A name of a set of hashes, as a signed long; equal sets have one name."""
    import xxhash

    return xxhash.xxh64_intdigest(grams.tobytes()) - (1 << 63)


def common_shingles(docs: DataFrame, shingle: int) -> np.ndarray:
    """Shingles that many documents of a bounded sample hold; the choice steers the work and never changes the result."""
    total = docs.count()
    wanted = max(SAMPLE_DOCS, total // SAMPLE_SHARE)

    def run(batches):
        release()
        for batch in batches:
            found = [shingles(t.as_py(), shingle) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64))], ["gram"])

    drawn = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) * F.lit(float(total)) < float(wanted << 20)
    drawn_texts = docs.select("doc_id", "text").where(drawn).select("text").distinct()  # copies of one text are one set
    counts = drawn_texts.mapInArrow(run, "gram long").groupBy("gram").agg(F.count("*").alias("n"))
    rows = counts.where(F.col("n") >= COMMON_DOCS).orderBy(F.desc("n"), "gram").limit(COMMON).collect()
    return np.sort(np.array([r["gram"] for r in rows], np.int64).view(np.uint64))


def among(values: np.ndarray, listed: np.ndarray) -> np.ndarray:
    """Which values are in an ascending list."""
    if not len(listed):
        return np.zeros(len(values), bool)
    return listed[np.minimum(np.searchsorted(listed, values), len(listed) - 1)] == values


def parity(grams: np.ndarray) -> np.ndarray:
    """For each bin of hashes whether it holds an odd number of a set's members, as packed unsigned longs.

    Where two sets differ in d members, the sketches differ in d bits at most. Halves of a longer
    sketch, taken together by exclusive or, are the sketch of half the length.
    """
    words = SKETCH_WORDS[0]
    while words < SKETCH_WORDS[1] and 64 * words < len(grams):
        words *= 2
    # the low bits: bins of half the length are the same ones modulo that length
    odd = np.bincount((grams & np.uint64(64 * words - 1)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")


def most_apart(similarity: float, both: np.ndarray) -> np.ndarray:
    """The most members in one of two sets only, at a Jaccard similarity, for both sizes together."""
    return both * ((1 - similarity) / (1 + similarity)) + 1e-6


class Sketches:
    """Parity sketches of many sets, of unlike lengths."""

    def __init__(self, flat: np.ndarray, starts: np.ndarray, words: np.ndarray):
        self.flat, self.starts, self.words = flat, starts, words

    def _folded(self, rows: np.ndarray, words: int, to: int) -> np.ndarray:
        whole = self.flat[self.starts[rows][:, None] + np.arange(words)]
        return np.bitwise_xor.reduce(whole.reshape(len(rows), words // to, to), axis=1)

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """In how many bits two sketches differ at the length of the shorter one; the sets differ in as many members at least."""
        out = np.zeros(len(a), np.int64)
        lengths = self.words[a] * (SKETCH_WORDS[1] + 1) + self.words[b]
        for length in np.unique(lengths).tolist():
            rows = np.flatnonzero(lengths == length)
            wa, wb = divmod(length, SKETCH_WORDS[1] + 1)
            to = min(wa, wb)
            for at in range(0, len(rows), FRONTIER // to):
                r = rows[at : at + FRONTIER // to]
                out[r] = np.bitwise_count(self._folded(a[r], wa, to) ^ self._folded(b[r], wb, to)).sum(axis=1, dtype=np.int64)
        return out


Near = Callable[[np.ndarray, np.ndarray], np.ndarray]


def joined(start: int, stop: int, *turns: Near) -> list[tuple[int, int]]:
    """Links that connect the rows from start to stop as all pairs that are near in any turn would; pairs that are connected already are not asked for."""
    label, parts, out = np.arange(stop - start), stop - start, []
    for near, u in itertools.product(turns, range(stop - start - 1)):
        if parts == 1:
            break
        rest = np.flatnonzero(label[u + 1 :] != label[u]) + u + 1
        rest = rest[near(np.full(len(rest), u + start), rest + start)] if len(rest) else rest
        if len(rest):
            own, first = np.unique(label[rest], return_index=True)
            label[np.isin(label, own)] = label[u]
            parts -= len(own)
            out += [(u + start, v + start) for v in rest[first].tolist()]
    return out


def sized(similarity: float, size: np.ndarray) -> Near:
    """Whether the sizes of pairs of rows allow the similarity."""
    return lambda a, b: np.minimum(size[a], size[b]) >= similarity * np.maximum(size[a], size[b]) - 1e-9


def by_fingerprint(radius: int, fp: np.ndarray, near: Near) -> tuple[Near, Near]:
    """``near`` in two turns: of the pairs within the radius, which connect nearly all that belongs together, and of those beyond it."""

    def turn(within: bool) -> Near:
        def asked(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            found = (np.bitwise_count(fp[a] ^ fp[b]) <= radius) == within
            rows = np.flatnonzero(found)
            found[rows] = near(a[rows], b[rows])
            return found

        return asked

    return turn(True), turn(False)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows that come in the order of ``keys``, in tables that cut no group."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in keys]
        if held and any(held[-1].column(k)[-1].as_py() != c[0] for k, c in zip(keys, columns)):
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
        border = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns]))
        if len(border):  # the last group may go on in the next batch
            cut = int(border[-1]) + 1
            yield pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks()
            held, batch = [], batch.slice(cut)
        held.append(batch)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def lists(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The members of a column of lists one after the other, where each row's begin, and how many they are."""
    column = table.column(name)
    column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    offsets = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy().view(np.uint64), offsets[:-1], np.diff(offsets)


def candidates(shared: DataFrame, similarity: float, radius: int) -> DataFrame:
    """Links (a, b) that connect the nodes which could be similar: of each key, at most one link a member.

    Two members of a key could be similar if sizes and parity sketches allow it; no pair that is
    similar fails this. In large keys those within the radius are asked first.
    """
    partitions = int(shared.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = shared.repartition(partitions, "key").sortWithinPartitions("key", "node")

    def work(table: pa.Table) -> pa.RecordBatch:
        key, node, fp, size = (table.column(c).to_numpy() for c in ("key", "node", "fp", "size"))
        allowed, sketches = sized(similarity, size), Sketches(*lists(table, "sketch"))

        def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            fits = allowed(a, b)
            rows = np.flatnonzero(fits)
            fits[rows] = sketches.apart(a[rows], b[rows]) <= most_apart(similarity, size[a[rows]] + size[b[rows]])
            return fits

        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        stops = np.r_[starts[1:], len(key)]
        stop = np.repeat(np.where(stops - starts <= SMALL_KEY, stops, 0), stops - starts)
        pairs = []
        for step in range(1, SMALL_KEY):
            a = np.flatnonzero(np.arange(len(key)) + step < stop)
            a = a[near(a, a + step)]
            pairs.append((a, a + step))
        turns = by_fingerprint(radius, fp.view(np.uint64), near)
        large = [link for g in np.flatnonzero(stops - starts > SMALL_KEY).tolist() for link in joined(int(starts[g]), int(stops[g]), *turns)]
        if large:
            pairs.append(tuple(np.array(large).T))
        label = settle(len(key), iter(pairs))
        moved = np.flatnonzero(label != np.arange(len(key)))
        return pa.RecordBatch.from_arrays([pa.array(node[label[moved]]), pa.array(node[moved])], ["a", "b"])

    def run(batches):
        release()
        for table in whole_groups(batches, ["key"]):
            yield work(table)

    return dealt.mapInArrow(run, "a long, b long").distinct()


def sets_of(docs: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """node and its set of shingles (grams), made again from the text of the row that ``nodes`` (node, first) names. Stored."""
    ids = checkpointed(nodes.select("node", F.col("first").alias("__id")))
    texts = docs.select("doc_id", "text").join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, F.col("doc_id").eqNullSafe(F.col("__id")))

    def run(batches):
        release()
        for batch in batches:
            found = [(n, shingles(t.as_py(), shingle)) for n, t in zip(batch.column("node").to_pylist(), batch.column("text"))]
            found = [(n, grams.view(np.int64)) for n, grams in found if set_name(grams) == n]  # several texts may have the id
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in found], pa.int64()), pa.array([g for _, g in found], pa.list_(pa.int64()))], ["node", "grams"])

    return checkpointed(texts.select("node", "text").mapInArrow(run, "node long, grams array<long>").dropDuplicates(["node"]))


def verified(sets: DataFrame, groups: DataFrame, similarity: float, radius: int) -> DataFrame:
    """Links (a, b) that connect the nodes of each group as all its pairs whose sets have the Jaccard similarity, counted exactly; those within the radius first.

    ``groups`` has node, label, fp and size. A group's sets are cut into shares of about SHARE_GRAMS
    shingles, and each two shares meet in a task, so a group of any size needs bounded room.
    """
    sizes = checkpointed(groups.groupBy("label").agg(F.count("*").alias("n"), F.sum("size").alias("__grams")))
    dealt = attach(groups, sizes, ["label"], "n", "node").join(sets, "node")
    dealt = dealt.withColumn("__shares", F.ceil((F.col("__grams") + 1) / SHARE_GRAMS).cast("int"))
    dealt = dealt.withColumn("__own", F.pmod(F.xxhash64("node"), F.col("__shares")).cast("int"))
    # a share meets itself where it is the only one
    others = F.when(F.col("__shares") == 1, F.array(F.lit(0))).otherwise(F.array_remove(F.sequence(F.lit(0), F.col("__shares") - 1), F.col("__own")))
    dealt = dealt.withColumn("__other", F.explode(others))
    dealt = dealt.select("label", F.least("__own", "__other").alias("i"), F.greatest("__own", "__other").alias("j"), "node", "fp", "size", "grams")
    partitions = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(partitions, "label", "i", "j").sortWithinPartitions("label", "i", "j", "node")

    def cell(table: pa.Table, start: int, stop: int) -> list[tuple[int, int]]:
        part = table.slice(start, stop - start)
        fp, size = part.column("fp").to_numpy().view(np.uint64), part.column("size").to_numpy()
        allowed, (grams, starts, count) = sized(similarity, size), lists(part, "grams")
        first = int(starts[0])
        number = np.unique(grams[first : int(starts[-1] + count[-1])], return_inverse=True)[1]
        own, held = starts - first, np.zeros(len(number), bool)

        def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            fits = allowed(a, b)
            rows = np.flatnonzero(fits)
            if len(rows):
                asked = number[own[a[0]] : own[a[0]] + count[a[0]]]  # one row asks
                held[asked] = True
                c = b[rows]
                ends = np.cumsum(count[c])
                place = np.arange(ends[-1]) - np.repeat(ends - count[c] - own[c], count[c])
                shared = np.diff(np.r_[0, np.cumsum(held[number[place]])[ends - 1]])
                held[asked] = False
                least = np.ceil((size[a[rows]] + size[c]) * (similarity / (1 + similarity)) - 1e-9)
                fits[rows] = shared >= least
            return fits

        return joined(0, stop - start, *by_fingerprint(radius, fp, near))

    def run(batches):
        release()
        for table in whole_groups(batches, ["label", "i", "j"]):
            label, i, j, node = (table.column(c).to_numpy() for c in ("label", "i", "j", "node"))
            starts = np.flatnonzero(np.r_[True, (label[1:] != label[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
            for start, stop in zip(starts.tolist(), [*starts[1:].tolist(), len(node)]):
                pairs = np.array(cell(table, start, stop), np.int64).reshape(-1, 2)
                if len(pairs):
                    yield pa.RecordBatch.from_arrays([pa.array(node[start + pairs[:, 0]]), pa.array(node[start + pairs[:, 1]])], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long").distinct()


def similar_dedup(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, radius: int = WIDE_RADIUS) -> DataFrame:
    """The rows of ``docs`` that stay if texts of a Jaccard similarity of ``similarity`` or more, on sets of shingles, are linked.

    Of each component those with its smallest doc_id stay; rows with the same id stay together.
    Two such sets share a member among the first (1 - similarity) n + 1 of each in any one
    order, here hash order with common shingles last; so these are the keys under which texts meet,
    and no pair is lost. The SimHash fingerprints decide which pairs are asked first, those within
    the radius, and no result. Of the members of a key that could be similar by size and parity
    sketch, only links that connect them leave the task, and of each group of candidates thus
    connected only links that connect what the sets themselves say; so no step gives more rows
    than its members have keys.
    Texts without words are one set. NULL ids are as in ``near_groups``.
    """
    common = common_shingles(docs, shingle)

    def run(batches):
        release()
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                grams = shingles(text.as_py(), shingle)
                n = len(grams)
                ones = np.unpackbits(grams.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64) if n else np.zeros(64, np.int64)
                fp = int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])
                keys = grams[np.argsort(among(grams, common), kind="stable")]
                keys = keys[: n - int(np.ceil(similarity * n - 1e-9)) + 1] if n else keys
                rows.append((set_name(grams), fp, n, keys.view(np.int64), parity(grams).view(np.int64)))
            node, fp, size, keys, sketch = zip(*rows) if rows else ((), (), (), (), ())
            arrays = [pa.array(node, pa.int64()), pa.array(fp, pa.int64()), pa.array(size, pa.int32()), *[pa.array(x, pa.list_(pa.int64())) for x in (keys, sketch)]]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], ["doc_id", "node", "fp", "size", "keys", "sketch"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    made = checkpointed(docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, node long, fp long, size int, keys array<long>, sketch array<long>"))
    names = checkpointed(made.groupBy("node").agg(F.min("doc_id").alias("first"), F.first("fp").alias("fp"), F.first("size").alias("size"), F.first("sketch").alias("sketch")))
    keyed = made.select("node", "keys").dropDuplicates(["node"]).select(F.explode("keys").alias("key"), "node")
    many = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select(F.col("key").alias("__key"))
    shared = keyed.join(many, F.col("key") == F.col("__key"), "left_semi").join(names.drop("first"), "node")
    groups = names.drop("sketch").join(components(checkpointed(candidates(shared, similarity, radius))), "node")
    groups = checkpointed(groups)
    sets = sets_of(docs, groups, shingle)
    moved = components(checkpointed(verified(sets, groups.select("node", "label", "fp", "size"), similarity, radius)))
    names = names.select("node", "first")
    labels = names.join(moved, "node", "left").withColumn("label", F.coalesce("label", "node"))
    kept = labels.groupBy("label").agg(F.min("first").alias("__id")).select("__id").distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")
