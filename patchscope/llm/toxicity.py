"""Toxicity of texts, after undoing disguises.

Disguised words are restored by a noisy-channel model: a lattice of what each written
character may stand for (leetspeak, separators or single spaces between letters or words,
repeated letters) is decoded by Viterbi under a character trigram model of the corpus. The restored words, and how words
begin, are the features of a logistic model.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchscope.llm.common import Recent, held_out, release, slices, worker_state
from patchscope.session import checkpointed

#: What a character may stand for besides itself (fixed values).
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "*": "aeiou"}
SEPARATORS = frozenset(".-_~*'·•")
#: Log-costs of the channel: reading a character as another, dropping a separator, dropping a repeated letter, dropping one of just two, reading a separator as a word border.
LEET_COST, SEPARATOR_COST, REPEAT_COST, DOUBLE_COST, BORDER_COST = 1.0, 0.5, 0.5, 2.0, 0.5
LETTERS = re.compile(r"[^\W\d_]+")
SPACED = re.compile(r"(?<!\S)\S(?:[ \t]\S){2,}(?!\S)")
REPEATED = re.compile(r"([^\W\d_])\1")
INSIDE = re.compile(r"[^\W\d_].*[\d@$!|+*._~'·•-].*[^\W\d_]|^[\d@$!|+*].*[^\W\d_]|[^\W\d_].*[\d@$|*]$")
#: Trigrams seen less often are left out of the model.
MIN_COUNT = 3
PREFIXES = (3, 4, 5)
#: Labelled rows per class from which the classifier is fitted, on average, and features it keeps.
SAMPLE_ROWS = 6000
FEATURES = 4096
MIN_DOCS, MIN_LIFT = 3, 3.0
PENALTY, STEPS = 3e-5, 800
THRESHOLD = 0.3


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    """True at the code points that are letters."""
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def count_trigrams(texts: list[str]) -> Counter:
    """Trigrams of the words of texts, ``^`` before and ``$`` behind each word; the first letter also counts after ``^^``."""
    total: Counter = Counter()
    codes = np.frombuffer(("\n" + "\n".join(texts).lower() + "\n").encode("utf-32-le", "replace"), "<u4")
    codes = np.where(letter_table()[codes], codes, 0)
    present = np.flatnonzero(np.bincount(codes))
    number = np.zeros(int(present[-1]) + 1, np.int64)
    number[present] = np.arange(len(present))
    ids, k = number[codes], len(present)
    keys = (ids[:-2] * k + ids[1:-1]) * k + ids[2:]
    if k**3 <= 1 << 22:
        counts = np.bincount(keys)
        keys = np.flatnonzero(counts)
        counts = counts[keys]
    else:
        keys, counts = np.unique(keys, return_counts=True)
    names = ["", *map(chr, present[1:].tolist())] if present[0] == 0 else list(map(chr, present.tolist()))
    for key, n in zip(keys.tolist(), counts.tolist()):
        a, b, c = names[key // (k * k)], names[key // k % k], names[key % k]
        if b:
            total[(a or "^") + b + (c or "$")] += n
            if not a:
                total["^^" + b] += n
    return total


def trigram_counts(docs: DataFrame, block_chars: int = 1 << 20) -> DataFrame:
    """(gram, n): character trigrams of all words of all rows."""

    def count(batches):
        release()
        total: Counter = Counter()
        held, size = [], 0
        for batch in batches:
            for text in batch.column("text"):
                value = text.as_py()
                if value:
                    held.append(value)
                    size += len(value)
                if size >= block_chars:
                    total.update(count_trigrams(held))
                    held, size = [], 0
        if held:
            total.update(count_trigrams(held))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["gram", "n"])

    return docs.select("text").mapInArrow(count, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def language_model(docs: DataFrame) -> dict[str, int]:
    """The trigram table; its size is bounded by the alphabets, not by the rows, as rare trigrams are left out."""
    return {r["gram"]: r["n"] for r in trigram_counts(docs).where(F.col("n") >= MIN_COUNT).collect()}


class Channel:
    """Viterbi decoding of one written word."""

    def __init__(self, counts: dict[str, int]):
        self.three, self.two, self.one, self.total = dict(counts), Counter(), Counter(), 0
        for g, n in counts.items():
            self.two[g[1:]] += n
            self.one[g[2]] += n
            self.total += n
        self.before: Counter = Counter()
        for g, n in counts.items():
            self.before[g[:2]] += n
        self.middle: Counter = Counter()
        for g, n in self.two.items():
            self.middle[g[0]] += n

    @lru_cache(maxsize=50_000)
    def log_p(self, a: str, b: str, c: str) -> float:
        """Log probability of c after a, b: trigram, bigram and single counts mixed."""
        p = (self.one.get(c, 0) + 0.5) / (self.total + 100.0)
        p = (self.two.get(b + c, 0) + 5 * p) / (self.middle.get(b, 0) + 5)
        return math.log((self.three.get(a + b + c, 0) + 5 * p) / (self.before.get(a + b, 0) + 5))

    def restore(self, word: str) -> str:
        """The likeliest plain words, spaces between; characters that stand for nothing are dropped at a cost."""
        # a path is a chain of (path before, letter), so that states share what they have in common
        states: dict[tuple[str, str], tuple[float, tuple | None]] = {("^", "^"): (0.0, None)}
        for at, c in enumerate(word):
            options: list[tuple[str, float]] = []
            if c.isalpha():
                options.append((c, 0.0))
                if at and word[at - 1] == c:
                    more = at > 1 and word[at - 2] == c or at + 1 < len(word) and word[at + 1] == c
                    options.append(("", REPEAT_COST if more else DOUBLE_COST))
            options += [(x, LEET_COST) for x in LEET.get(c, "")]
            if c in SEPARATORS or c.isspace() or not options:
                options += [("", SEPARATOR_COST), (" ", BORDER_COST)]
            new: dict[tuple[str, str], tuple[float, tuple | None]] = {}
            for (a, b), (score, path) in states.items():
                for x, cost in options:
                    if x == " ":
                        if b == "^":
                            continue  # no empty words
                        key, value = ("^", "^"), score - cost + self.log_p(a, b, "$")
                    else:
                        key = (b, x) if x else (a, b)
                        value = score - cost + (self.log_p(a, b, x) if x else 0.0)
                    if key not in new or value > new[key][0]:
                        new[key] = (value, (path, x) if x else path)
            states = new
        path = max(((s + self.log_p(a, b, "$"), p) for (a, b), (s, p) in states.items()), key=lambda v: v[0])[1]
        letters = []
        while path is not None:
            path, x = path
            letters.append(x)
        return "".join(reversed(letters))


def plain_words(piece: str, channel: Channel) -> list[str]:
    """The words of a white-space separated piece, or of letters written apart: restored if it looks disguised, and its runs of letters."""
    if " " in piece or "\t" in piece:
        return channel.restore(piece).split()
    if piece.isalpha() and not REPEATED.search(piece):
        return [piece]
    runs = LETTERS.findall(piece)
    core = piece.strip("\"'()[]{}<>,;:?#%&.…")
    if not runs and not (all(c in LEET or c in SEPARATORS for c in core) and any(c in LEET for c in core)):
        return []
    if len(core) >= 3 and (not runs or INSIDE.search(core) or REPEATED.search(core)):
        return list(dict.fromkeys([*channel.restore(core).split(), *runs]))
    return runs


def feature_names(words: list[str]) -> list[str]:
    return [f"={w}" for w in words] + [f"^{w[:n]}" for w in words for n in PREFIXES if len(w) > n]


class Features:
    """Features of texts, each white-space separated piece worked out once: their names, or the numbers of the wanted ones."""

    def __init__(self, counts: dict[str, int], wanted: dict[str, int] | None = None):
        self.channel = Channel(counts)
        self.words = {f[1:]: i for f, i in (wanted or {}).items() if f[0] == "="}
        self.starts = {f[1:]: i for f, i in (wanted or {}).items() if f[0] == "^"}
        # an entry without a list of wanted features holds all names of a piece
        one, limit = (self.numbers, 100_000) if wanted is not None else (self.names, 20_000)
        self.pieces = Recent(lambda new: [one(p) for p in new], limit)

    def names(self, piece: str) -> tuple[str, ...]:
        return tuple(dict.fromkeys(feature_names(plain_words(piece, self.channel))))

    def numbers(self, piece: str) -> tuple[int, ...]:
        words, starts, runs = self.words, self.starts, plain_words(piece, self.channel)
        found = {words.get(w) for w in runs}
        found.update(starts.get(w[:n]) for w in runs for n in PREFIXES if len(w) > n)
        found.discard(None)
        return tuple(found)

    def of(self, text: str | None) -> set:
        """The distinct features of a whole text; runs of letters written apart are decoded too."""
        if not text:
            return set()
        text = text.lower()
        pieces = list(dict.fromkeys(text.split()))
        pieces += SPACED.findall(text)
        return set().union(*(f for f in self.pieces.look_up(pieces) if f))


def features(lm: str, wanted: str | None = None) -> Features:
    numbers = lambda: {f: i for i, f in enumerate(json.loads(wanted))} if wanted is not None else None
    return worker_state(("toxicity", lm, wanted), lambda: Features(json.loads(lm), numbers()))


def logistic(rows: list[list[int]], labels: np.ndarray, k: int) -> tuple[np.ndarray, float]:
    """Weights and intercept of an L1-penalised logistic model over sets of features (accelerated proximal steps)."""
    where = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    which = np.array([f for r in rows for f in r], np.int64)
    w = v = np.zeros(k + 1)
    norm = np.bincount(where, minlength=len(rows)).max(initial=0) + 1.0
    step, t = 4.0 / norm, 1.0  # the curvature is at most a quarter of the features of a row
    for _ in range(STEPS):
        z = np.bincount(where, v[which], len(rows)) + v[k]
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) / len(rows)
        gradient = np.append(np.bincount(which, error[where], k), error.sum())
        new = v - step * gradient
        new[:k] = np.sign(new[:k]) * np.maximum(np.abs(new[:k]) - step * PENALTY, 0)
        after = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v = new + (t - 1) / after * (new - w)
        w, t = new, after
    return w[:k], float(w[k])


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, lm: dict[str, int] | None = None) -> dict:
    """Model from the corpus (``docs``: doc_id, text) and labels (doc_id, toxic) that are not held out.

    The character model counts all rows. The classifier is fitted on a bounded sample: for each
    class, labels whose id hashes below a share that gives ``sample_rows`` rows on average;
    equal texts count once. Rows without text or label are not learned from.
    """
    lm = language_model(docs) if lm is None else lm
    packed = json.dumps(lm)
    known = labels.where(F.col("toxic").isin(0, 1) & ~held_out()).select("doc_id", "toxic")
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}  # two rows
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    rate = {c: min(1.0, sample_rows / sizes[c]) for c in sizes}
    chosen = known.where(sum((F.when((F.col("toxic") == c) & (draw < r), 1).otherwise(0) for c, r in rate.items()), F.lit(0)) > 0)
    # at most about twice sample_rows ids, whatever the input
    sample = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(chosen), "doc_id")

    def names(batches):
        own = features(packed)
        for batch in batches:
            out = [sorted(own.of(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic").cast(pa.int64()), batch.column("key"), pa.array(out, pa.list_(pa.string()))], ["toxic", "key", "names"])

    sample = sample.select("toxic", F.xxhash64("text").alias("key"), "text").mapInArrow(names, "toxic long, key long, names array<string>")
    sample = checkpointed(sample.dropDuplicates(["key"]))
    n = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if len(n) < 2:
        share = sum(sizes.get(c, 0) * c for c in sizes) / max(1, sum(sizes.values()))
        return {"lm": lm, "features": [], "weights": [], "intercept": math.log((share + 1e-3) / (1 - share + 1e-3))}
    counts = sample.select("toxic", F.explode("names").alias("name")).groupBy("name").agg(F.sum("toxic").alias("bad"), F.count("*").alias("docs"))
    bad, good = (F.col("bad") + 0.5) / n[1], (F.col("docs") - F.col("bad") + 0.5) / n[0]
    lift = bad / good
    best = counts.where((F.col("docs") >= MIN_DOCS) & (lift >= MIN_LIFT)).orderBy((bad * F.log(lift)).desc(), "name").limit(FEATURES)
    wanted = [r["name"] for r in best.select("name").collect()]  # the model's size
    spark = docs.sparkSession
    ids = spark.createDataFrame([(w, i) for i, w in enumerate(wanted)], "name string, id int")
    picked = sample.select("toxic", "key", F.explode_outer("names").alias("name")).join(F.broadcast(ids), "name", "left")
    rows = picked.groupBy("key", "toxic").agg(F.collect_list("id").alias("ids")).collect()  # bounded by the sample
    rows = sorted(rows, key=lambda r: r["key"])
    y = np.array([r["toxic"] for r in rows], float)
    weights, intercept = logistic([r["ids"] for r in rows], y, len(wanted))
    # the classes were sampled at different rates
    odds = (sizes[1] / sizes[0]) / (y.sum() / (len(y) - y.sum()))
    kept = [i for i in range(len(wanted)) if weights[i]]
    return {"lm": lm, "features": [wanted[i] for i in kept], "weights": [float(weights[i]) for i in kept], "intercept": intercept + math.log(odds)}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out and score (0 to 1) of every row; NULL and empty texts get the score of a text without features."""
    lm, wanted = json.dumps(model["lm"]), json.dumps(model["features"])
    weights, intercept = model["weights"], model["intercept"]

    def run(batches):
        own = features(lm, wanted)
        for batch in slices(batches):
            z = [intercept + sum(weights[f] for f in sorted(own.of(t.as_py()))) for t in batch.column("text")]
            p = 1 / (1 + np.exp(-np.clip(np.array(z, float), -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(p)], ["doc_id", "held_out", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, score double")


def keep_clean(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, in one pass over them."""
    lm, wanted = json.dumps(model["lm"]), json.dumps(model["features"])
    weights, intercept = model["weights"], model["intercept"]

    def run(batches):
        own = features(lm, wanted)
        for batch in slices(batches):
            z = np.array([intercept + sum(weights[f] for f in sorted(own.of(t.as_py()))) for t in batch.column("text")], float)
            yield batch.filter(pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))) < threshold))

    return docs.mapInArrow(run, docs.schema)
