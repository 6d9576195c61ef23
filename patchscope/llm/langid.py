"""Language of texts, with spans for mixed ones.

The scripts of a word narrow its candidate languages; each candidate gets a score from the
character n-grams of the word; Viterbi decoding with a penalty for switching languages labels
every word of a text. The language of a text is that of most of its letters.
"""

from __future__ import annotations

import bisect
import json
import re
import unicodedata
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchscope.llm.common import Recent, held_out, worker_state

#: First code points of scripts, and names (fixed values); what lies before the first is Latin.
SCRIPTS = (
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0900, "Indic"),
    (0x0E00, "Thai"), (0x0E80, "Other"), (0x1100, "Hangul"), (0x1200, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"), (0x2C60, "Latin"), (0x2C80, "Other"),
    (0x3040, "Kana"), (0x3100, "Han"), (0x3130, "Hangul"), (0x3190, "Han"), (0xA000, "Other"), (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Latin"),
    (0xFB07, "Other"), (0xFF21, "Latin"), (0xFF5B, "Kana"), (0x10000, "Other"), (0x20000, "Han"),
)
STARTS = [s for s, _ in SCRIPTS]
WORD = re.compile(r"[^\W\d_]+")
GRAMS = (1, 2, 3)
#: Rows per language from which the model is fitted, on average; their whole texts are used.
SAMPLE_ROWS = 2000
MIN_COUNT = 3
#: A language is a candidate in scripts that hold this share of its letters.
SCRIPT_SHARE = 0.001
PENALTY = 6.0
#: Log-odds of one word are held within this, so that no single word decides.
WORD_BOUND = 8.0
FLOOR = 0.1
UNKNOWN = "und"


@lru_cache(maxsize=1 << 16)
def script(letter: str) -> str:
    return SCRIPTS[bisect.bisect_right(STARTS, ord(letter)) - 1][1]


def grams(word: str) -> list[str]:
    """Character n-grams of a word with its borders, and the word itself."""
    text = f"^{word}$"
    return [text[i : i + n] for n in GRAMS for i in range(len(text) - n + 1)] + [f"={word}"]


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> str:
    """Model (JSON) from the rows with text and lang that are not held out.

    Fitted on a bounded sample: for each language, rows whose id hashes below a share that
    gives ``sample_rows`` rows on average. With no rows there is a model without languages.
    """
    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out()).select("doc_id", "lang", "text")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row per language
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    chosen = F.lit(False)
    for lang, n in sizes.items():
        chosen = F.when(F.col("lang") == lang, draw < min(1.0, sample_rows / n)).otherwise(chosen)

    def count(batches):
        found: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                found.setdefault(lang, Counter()).update(WORD.findall(text.lower()))
        for lang, words in found.items():
            total: Counter = Counter()
            for word, n in words.items():
                for g in grams(word):
                    total[g] += n
                for c in word:
                    total["#" + script(c)] += n
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(total)), pa.array(list(total)), pa.array(list(total.values()), pa.int64())], ["lang", "gram", "n"])

    counts = rows.where(chosen).select("lang", "text").mapInArrow(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    table: dict[str, dict[str, int]] = {lang: {} for lang in sorted(sizes)}
    for r in counts.where(F.col("n") >= MIN_COUNT).collect():  # bounded by the sample
        table[r["lang"]][r["gram"]] = r["n"]
    return json.dumps({lang: c for lang, c in table.items() if c})


class Model:
    """Word scores and decoding."""

    def __init__(self, table: str):
        counts = json.loads(table)
        self.langs = sorted(counts)
        k = len(self.langs)
        totals: dict[int | str, np.ndarray] = {}
        for i, lang in enumerate(self.langs):
            for g, n in counts[lang].items():
                if g[0] != "#":
                    size = "=" if g[0] == "=" and len(g) > 1 else len(g)
                    totals.setdefault(size, np.zeros(k))[i] += n
        raw: dict[str, np.ndarray] = {}
        for i, lang in enumerate(self.langs):
            for g, n in counts[lang].items():
                if g[0] != "#":
                    raw.setdefault(g, np.zeros(k))[i] = n
        self.place = {g: i for i, g in enumerate(raw)}
        rows = [np.log((row + FLOOR) / (totals["=" if g[0] == "=" and len(g) > 1 else len(g)] + 1.0)) for g, row in raw.items()]
        self.weights = np.array([p - p.mean() for p in rows]).reshape(len(rows), k)
        letters = {lang: {g[1:]: n for g, n in counts[lang].items() if g[0] == "#"} for lang in self.langs}
        self.scripts = {
            s: np.array([letters[lang].get(s, 0) >= SCRIPT_SHARE * sum(letters[lang].values()) and letters[lang].get(s, 0) > 0 for lang in self.langs])
            for s in {s for x in letters.values() for s in x}
        }
        self.memo = Recent(self.scores, 200_000)

    def scores(self, words: list[str]) -> list[bytes]:
        """One 32-bit score per language for each word; languages that its script rules out get a large negative one."""
        place, k = self.place, len(self.langs)
        found = [[place[g] for g in grams(w) if g in place] for w in words]
        word = np.repeat(np.arange(len(words)), [len(f) for f in found])
        gram = np.array([g for f in found for g in f], np.int64)
        total = np.column_stack([np.bincount(word, self.weights[gram, i], len(words)) for i in range(k)])
        total = np.maximum(total - total.max(axis=1, keepdims=True), -WORD_BOUND)
        for i, w in enumerate(words):
            name = "Latin" if w.isascii() else Counter(map(script, w)).most_common(1)[0][0]
            allowed = self.scripts.get(name)
            if allowed is not None and not allowed.all():
                total[i] = np.where(allowed, total[i], -4 * WORD_BOUND) if allowed.any() else total[i]
        return [r.tobytes() for r in total.astype("<f4")]

    def decode(self, texts: list[list[str]]) -> list[np.ndarray]:
        """The language number of each word of each text; all texts advance together, word by word.

        With one penalty for any switch, the best predecessor is the same language or the best
        of all. Texts are sorted by length, so those that go on are always the first ones.
        """
        k, order = len(self.langs), sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        lengths = np.array([len(texts[i]) for i in order], np.int64)
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        flat = np.frombuffer(b"".join([b"".join(self.memo.look_up(texts[i])) for i in order]), "<f4").reshape(-1, k)
        stay, top = np.zeros((len(flat), k), bool), np.zeros(len(flat), np.int16)
        steps = int(lengths[0]) if len(lengths) else 0
        alive = np.searchsorted(-lengths, -np.arange(1, steps + 1), side="right") if steps else []
        best = np.zeros((len(order), k), np.float32)
        for t in range(steps):
            n = int(alive[t])
            at, now = offsets[:n] + t, best[:n]
            if t:
                leader = now.argmax(axis=1)
                jump = (now[np.arange(n), leader] - PENALTY)[:, None]
                keep = now >= jump
                stay[at], top[at] = keep, leader
                now = np.where(keep, now, jump)
            now = now + flat[at]
            best[:n] = now - now.max(axis=1, keepdims=True)
        state = best.argmax(axis=1) if k and len(order) else np.zeros(len(order), np.int64)
        labels = np.zeros(len(flat), np.int16)
        for t in range(steps - 1, -1, -1):
            n = int(alive[t])
            at = offsets[:n] + t
            labels[at] = state[:n]
            if t:
                state[:n] = np.where(stay[at, state[:n]], state[:n], top[at])
        out: list[np.ndarray] = [np.zeros(0, np.int16)] * len(texts)
        for j, i in enumerate(order):
            out[i] = labels[offsets[j] : offsets[j + 1]]
        return out


def model(table: str) -> Model:
    return worker_state(("langid", table), lambda: Model(table))


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters."""
    return WORD.findall(unicodedata.normalize("NFC", text).lower()) if text else []


def identify(docs: DataFrame, table: str, spans: bool = False, block_words: int = 1_500_000) -> DataFrame:
    """doc_id, lang_pred and score of every row, with ``spans`` also lang_spans (array of lang, first word, words).

    lang_pred is the language of most letters, ties going to the first name; score is its
    share of the letters. A text without letters, or NULL, is ``und`` with score 0, as is every
    text if the model knows no language. Rows stay as they are, repeated ones too.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, lang_pred string, score double" + ", lang_spans array<struct<lang:string,start:int,words:int>>" * spans

    def run(batches):
        own = model(table)

        def work(ids: list, texts: list[list[str]]) -> pa.RecordBatch:
            labels = own.decode(texts) if own.langs else [None] * len(texts)
            pred, score, parts = [], [], []
            for words, label in zip(texts, labels):
                if label is None or not words:
                    pred.append(UNKNOWN), score.append(0.0), parts.append([])
                    continue
                share = np.bincount(label, [len(w) for w in words], len(own.langs))
                pred.append(own.langs[int(share.argmax())]), score.append(float(share.max() / share.sum()))
                if spans:
                    cuts = np.r_[0, np.flatnonzero(np.diff(label)) + 1, len(label)]
                    parts.append([{"lang": own.langs[label[a]], "start": int(a), "words": int(b - a)} for a, b in zip(cuts, cuts[1:])])
            columns = [pa.array(ids, id_type), pa.array(pred, pa.string()), pa.array(score, pa.float64())]
            names = ["doc_id", "lang_pred", "score"]
            if spans:
                columns.append(pa.array(parts, pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int32()), ("words", pa.int32())]))))
                names.append("lang_spans")
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            id_type, ids, texts, size = batch.schema.field("doc_id").type, [], [], 0
            for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids.append(i)
                texts.append(words_of(text.as_py()))
                size += len(texts[-1])
                if size >= block_words:
                    yield work(ids, texts)
                    ids, texts, size = [], [], 0
            if ids:
                yield work(ids, texts)

    return docs.select("doc_id", "text").mapInArrow(run, schema)
