"""Document fingerprints: a Merkle tree over sections, paragraphs and pieces.

A paragraph is a line, with its line feed. A section ends with a blank line, before a heading
or at a paragraph whose hash says so, and a long paragraph is cut into pieces where its
characters say so; as the cuts follow the content, an edit moves no cut but those beside it.
A node's hash covers the hashes of its children, a piece's hash its characters.
So equal roots mean equal texts, equal branches equal passages, and what differs is found by
going down the unequal branches only.
"""

from __future__ import annotations

import struct
from collections import Counter
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from patchscope.llm.common import release
from patchscope.operators.quantiles import with_value_bucket
from patchscope.session import checkpointed

#: Bytes of a hash; code points of a piece at least; one place in CUT ends a piece; one paragraph in GROUP ends a section.
DIGEST, PIECE, CUT, GROUP = 16, 8, 8, 8
MIX = np.array([2654435761, 2246822519, 3266489917, 668265263], np.uint32)
LEVELS = ("root", "section", "paragraph", "piece")
#: Ranges of ids per shuffle partition, so that hashing evens them out.
RANGES = 4


def _hash(kind: bytes, parts: list[bytes]) -> bytes:
    return blake2b(b"".join(parts), digest_size=DIGEST, person=kind).digest()


class Tree:
    """Hashes and bounds of all nodes, level by level; ``starts`` and ``ends`` are code points, ``first`` the first child."""

    def __init__(self, hashes: list[list[bytes]], starts: list[list[int]], ends: list[list[int]], first: list[list[int]]):
        self.hashes, self.starts, self.ends, self.first = hashes, starts, ends, first

    @classmethod
    def of(cls, text: str | None) -> Tree:
        data = (text or "").encode("utf-32-le")
        points = np.frombuffer(data, "<u4")
        n = len(points)
        mixed = points * MIX[0]
        for back in (1, 2, 3):
            mixed[back:] += points[:-back] * MIX[back]
        says = (mixed >> np.uint32(13)) % np.uint32(CUT) == 0
        line = points == 10
        if n:
            line[-1] = True
        places = np.flatnonzero(says | line)
        ends, closed, last = [], [], 0
        for place, forced in zip((places + 1).tolist(), line[places].tolist()):
            if forced:
                ends.append(place)
                closed.append(len(ends))
                last = place
            elif place - last >= PIECE:
                ends.append(place)
                last = place
        starts = [0, *ends[:-1]] if ends else []
        view = memoryview(data)
        pieces = [xxh3_128_digest(view[4 * a : 4 * b]) for a, b in zip(starts, ends)], starts, ends
        first = [0, *closed[:-1]] if closed else []
        paragraphs = ([_hash(b"paragraph", pieces[0][a:b]) for a, b in zip(first, closed)], [starts[a] for a in first], [ends[b - 1] for b in closed], first)
        sections: tuple = ([], [], [], [])
        child = 0
        for i, (name, start, end) in enumerate(zip(*paragraphs[:3])):
            blank = end - start == 1 and points[start] == 10
            heading = i + 1 < len(paragraphs[0]) and points[paragraphs[1][i + 1]] == 35
            if blank or heading or name[0] % GROUP == 0 or end == n:
                sections[0].append(_hash(b"section", paragraphs[0][child : i + 1]))
                for column, value in zip(sections[1:], (paragraphs[1][child], end, child)):
                    column.append(value)
                child = i + 1
        root = _hash(b"root", [struct.pack("<Q", n), *sections[0]])
        return cls([[root], sections[0], paragraphs[0], pieces[0]], [[0], sections[1], paragraphs[1], pieces[1]], [[n], sections[2], paragraphs[2], pieces[2]],
                   [[0], sections[3], paragraphs[3]])

    @property
    def root(self) -> str:
        return self.hashes[0][0].hex()

    @property
    def n_chars(self) -> int:
        return self.ends[0][0]

    def children(self, level: int, nodes: list[int]) -> list[int]:
        """The nodes of the next level below the given ones."""
        first, below = self.first[level], len(self.hashes[level + 1])
        return [c for i in nodes for c in range(first[i], first[i + 1] if i + 1 < len(first) else below)]

    def to_bytes(self) -> bytes:
        """For storing: per level the count, hashes, starts, ends and first children."""
        out = []
        for level, hashes in enumerate(self.hashes):
            numbers = [self.starts[level], self.ends[level], *([self.first[level]] if level < len(self.first) else [])]
            out += [struct.pack("<Q", len(hashes)), *hashes, *(np.array(x, "<i8").tobytes() for x in numbers)]
        return b"".join(out)

    @classmethod
    def from_bytes(cls, data: bytes) -> Tree:
        hashes, starts, ends, first, at = [], [], [], [], 0
        for level in range(len(LEVELS)):
            n = struct.unpack_from("<Q", data, at)[0]
            at += 8
            hashes.append([data[at + i * DIGEST : at + (i + 1) * DIGEST] for i in range(n)])
            at += n * DIGEST
            for column in (starts, ends, first)[: 3 if level < len(LEVELS) - 1 else 2]:
                column.append(np.frombuffer(data, "<i8", n, at).tolist())
                at += 8 * n
        return cls(hashes, starts, ends, first)


def unmatched(a: Tree, b: Tree) -> tuple[int, list[int], list[int]]:
    """Code points in equal branches, and the pieces of each tree that the other lacks.

    Goes down level by level through unequal nodes only; equal hashes pair off one to one.
    """
    if a.hashes[0] == b.hashes[0]:
        return a.n_chars, [], []
    shared, mine, theirs = 0, [0], [0]
    for level in range(1, len(LEVELS)):
        mine, theirs = a.children(level - 1, mine), b.children(level - 1, theirs)
        names = a.hashes[level], b.hashes[level]
        common = Counter(names[0][i] for i in mine) & Counter(names[1][i] for i in theirs)
        if common:
            left, right = common.copy(), common
            kept = []
            for i in mine:
                if left[names[0][i]] > 0:
                    left[names[0][i]] -= 1
                    shared += a.ends[level][i] - a.starts[level][i]
                else:
                    kept.append(i)
            mine = kept
            kept = []
            for i in theirs:
                if right[names[1][i]] > 0:
                    right[names[1][i]] -= 1
                else:
                    kept.append(i)
            theirs = kept
    return shared, mine, theirs


def likeness(a: Tree, b: Tree) -> float:
    """Share of both texts that lies in equal branches, 0 to 1; also 1 where passages only changed places."""
    return 1.0 if a.hashes[0] == b.hashes[0] else 2 * unmatched(a, b)[0] / (a.n_chars + b.n_chars)


def spans(tree: Tree, pieces: list[int]) -> list[tuple[int, int]]:
    """Code point ranges of pieces, neighbours joined."""
    out: list[tuple[int, int]] = []
    for i in pieces:
        start, end = tree.starts[3][i], tree.ends[3][i]
        if out and out[-1][1] == start:
            out[-1] = (out[-1][0], end)
        else:
            out.append((start, end))
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, fingerprint (the root in hex) and tree (bytes) of every row; NULL text is empty, repeated rows stay."""

    def run(batches):
        release()
        for batch in batches:
            trees = [Tree.of(t.as_py()) for t in batch.column("text")]
            arrays = [pa.array([t.n_chars for t in trees], pa.int64()), pa.array([t.root for t in trees], pa.string()), pa.array([t.to_bytes() for t in trees], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], ["doc_id", "n_chars", "fingerprint", "tree"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_chars long, fingerprint string, tree binary")


def compare(pairs: DataFrame, a: str = "tree_a", b: str = "tree_b") -> DataFrame:
    """``pairs`` with near (0 to 1), spans_a and spans_b (code point ranges that differ) from two columns of trees.

    Works on stored trees, without texts. A NULL tree gives NULLs.
    """
    kind = "array<struct<start:long,end:long>>"

    def run(batches):
        release()
        for batch in batches:
            near, left, right = [], [], []
            for x, y in zip(batch.column(a), batch.column(b)):
                if x.as_py() is None or y.as_py() is None:
                    found = None, None, None
                else:
                    x, y = Tree.from_bytes(x.as_py()), Tree.from_bytes(y.as_py())
                    _, mine, theirs = unmatched(x, y)
                    found = likeness(x, y), [{"start": s, "end": e} for s, e in spans(x, mine)], [{"start": s, "end": e} for s, e in spans(y, theirs)]
                for column, value in zip((near, left, right), found):
                    column.append(value)
            ranges = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            added = [pa.array(near, pa.float64()), pa.array(left, ranges), pa.array(right, ranges)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, "near", "spans_a", "spans_b"])

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema.fields)
    return pairs.mapInArrow(run, f"{columns}, near double, spans_a {kind}, spans_b {kind}")


def beside_next(docs: DataFrame) -> DataFrame:
    """Rows in ranges of ids: range, tail, id, text, sorted; each range ends with a copy of the next range's first row (tail).

    One shuffle of the texts. Split points (as many as ranges) come from the ids alone. The
    first row of all follows the last. Equal ids go by a hash of their text; NULL ids come first.
    """
    spark = docs.sparkSession
    ranges = RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumns({"__at": F.coalesce("doc_id", F.lit(-(2**63))), "__h": F.xxhash64("text")})
    cuts = rows.agg(F.percentile_approx(F.col("__at").cast("double"), [i / ranges for i in range(1, ranges)], F.lit(10 * ranges)).alias("cuts")).first()["cuts"]
    rows = with_value_bucket(rows.withColumn("__d", F.col("__at").cast("double")), "__d", sorted(set(cuts or [])), "__range").drop("__d")
    rows = rows.withColumn("__range", F.col("__range").cast("int"))
    heads = rows.groupBy("__range").agg(F.min(F.struct("__at", "__h")).alias("head"))
    whole = Window.orderBy("__range")  # one row a range
    before = F.coalesce(F.lag("__range").over(whole), F.max("__range").over(Window.partitionBy()))
    heads = checkpointed(heads.select(F.col("head.__at").alias("__ha"), F.col("head.__h").alias("__hh"), before.alias("__before")))
    rows = rows.join(F.broadcast(heads), (F.col("__at") == F.col("__ha")) & (F.col("__h") == F.col("__hh")), "left")
    copies = F.array(F.struct("__range", F.lit(False).alias("tail")), F.struct(F.col("__before").alias("__range"), F.lit(True).alias("tail")))
    rows = rows.select("doc_id", "text", "__at", "__h", F.inline(F.filter(copies, lambda c: c["__range"].isNotNull())))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(partitions, "__range").sortWithinPartitions("__range", "tail", "__at", "__h").select("__range", "tail", "doc_id", "text")


def edited_likeness(docs: DataFrame) -> DataFrame:
    """One row per document (doc_id, text): n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the document with its last floor(n/2) code points replaced by the
    first as many (or all) of the next document's, by ascending id, the first after the last.
    NULL text is empty, and two empty texts are alike (1). Repeated rows stay; equal ids are
    ordered by a hash of their text. A single document is its own next. Other columns are not read.
    """

    def run(batches):
        release()
        held = None  # range, id, text and tree of the row that waits for its next
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        for batch in batches:
            out = []
            for place, tail, doc_id, text in zip(*(batch.column(i) for i in range(4))):
                place, tail, doc_id, text = place.as_py(), tail.as_py(), doc_id.as_py(), text.as_py()
                if tail and (held is None or held[0] != place):
                    continue
                tree = Tree.of(text)
                if held is not None and held[0] == place:
                    _, own_id, own, own_tree = held
                    half = len(own) // 2
                    edited = own[: len(own) - half] + text[:half]
                    edited_tree = Tree.of(edited)
                    out.append((own_id, len(own), sha256(edited.encode()).hexdigest(), own_tree.root, edited_tree.root,
                                round(likeness(own_tree, edited_tree), 6), round(likeness(own_tree, tree), 6)))
                held = None if tail else (place, doc_id, text, tree)
            columns = list(zip(*out)) if out else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return beside_next(docs).mapInArrow(run, schema)
