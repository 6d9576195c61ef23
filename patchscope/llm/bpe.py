"""Byte-level BPE by prefix dynamic programming.

For every byte prefix of a pre-token there is exactly one token with which its encoding
ends. Storing that token for each prefix gives the encoding by walking back from the end,
lets text be appended without starting over, and lets an edit re-encode its surroundings
only. A token can follow another if no merge would ever cross the border between them.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import cached_property

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from patchscope.llm.common import Recent, worker_state

NEVER = 1 << 62
#: White space as the rank files' pattern sees it (fixed values).
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: No match of a pattern for words runs from other text into white space, so these pieces can be split alone.
PIECES = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")


class Vocabulary:
    """Ranks of byte strings; the rank is the id, and of all merges at hand the one of least rank comes first.

    Ranks need not grow with the order of merging: a token may rank before its parts.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {r: b for b, r in ranks.items()}
        self.longest = max(map(len, ranks), default=0)
        self.histories: dict[int, tuple | None] = {}
        self.borders: dict[int, bool] = {}

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        """From a file of lines "base64 rank"."""
        with open(path, "rb") as lines:
            return cls({base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines if x.strip())})

    def history(self, token: int) -> tuple | None:
        """How merging builds a token: (rank of the merge, first part, last part after it), from its bytes on.

        None if merging its bytes does not end in the token; then only a whole pre-token can be it.
        """
        if token not in self.histories:
            parts = [bytes((b,)) for b in self.bytes_of[token]]
            events = [(-1, parts[0], parts[-1])]
            while len(parts) > 1:
                rank, at = min(((self.ranks.get(a + b, NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))))
                if rank == NEVER:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
                events.append((rank, parts[0], parts[-1]))
            self.histories[token] = tuple(events) if len(parts) == 1 else None
        return self.histories[token]

    def follows(self, a: int, b: int) -> bool:
        """True if an encoding can have b right after a: no merge ever crosses their border."""
        key = a << 32 | b
        known = self.borders.get(key)
        if known is None:
            if len(self.borders) > 400_000:
                self.borders.clear()
            known = self.borders[key] = self._apart(a, b)
        return known

    def _apart(self, a: int, b: int) -> bool:
        """Replays both histories in the order merging would take, watching the border.

        Of equal ranks the leftmost merge comes first: those of a, then across, then those of b.
        """
        left, right = self.history(a), self.history(b)
        if left is None or right is None:
            return False
        i = j = 0
        while True:
            across = self.ranks.get(left[i][2] + right[j][1], NEVER)
            next_a = left[i + 1][0] if i + 1 < len(left) else NEVER
            next_b = right[j + 1][0] if j + 1 < len(right) else NEVER
            if across < next_a and across <= next_b and across != NEVER:
                return False
            if next_a == next_b == NEVER:
                return True
            if next_a <= next_b:
                i += 1
            else:
                j += 1

    @cached_property
    def matcher(self) -> ahocorasick.Automaton:
        """Finds all tokens in a text; bytes stand as characters of the same number."""
        found = ahocorasick.Automaton()
        for text, rank in self.ranks.items():
            found.add_word(text.decode("latin-1"), (len(text), rank))
        found.make_automaton()
        return found

    def extend(self, text: str, last: list[int], sure: int) -> Iterator[int]:
        """Work out the last token of each prefix longer than ``sure``; yields the length of each when done.

        ``text``: bytes as characters. ``last`` holds the known prefixes up to ``sure``.
        """
        known, history, follows = self.borders.get, self.histories, self.follows
        begin, done = max(0, sure - self.longest), sure
        for at, (length, token) in self.matcher.iter(text, begin):
            end = at + 1
            if end <= done or end - length < begin:
                continue
            if end > done + 1:
                break
            start = end - length
            if not start:
                valid = history[token] if token in history else self.history(token)
            else:
                valid = known(last[start] << 32 | token)
                if valid is None:
                    valid = follows(last[start], token)
            if valid:
                last.append(token)
                done = end
                yield end
        if done < len(text):
            raise ValueError(f"no token ends at byte {done + 1}")

    def encode_piece(self, text: bytes) -> list[int]:
        """The ids of one pre-token."""
        whole = self.ranks.get(text)
        return [whole] if whole is not None else PrefixTable(self, text).ids()

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class PrefixTable:
    """The last token of every byte prefix of one pre-token."""

    def __init__(self, vocabulary: Vocabulary, text: bytes = b""):
        self.vocabulary, self.text, self.last = vocabulary, "", [-1]
        self.append(text)

    def append(self, more: bytes) -> None:
        """Add bytes at the end; earlier prefixes stay as they are."""
        sure, self.text = len(self.text), self.text + more.decode("latin-1")
        for _ in self.vocabulary.extend(self.text, self.last, sure):
            pass

    def replace(self, start: int, stop: int, new: bytes) -> int:
        """Put ``new`` in place of the bytes from ``start`` to ``stop``; returns how many prefixes were worked out anew.

        Prefixes up to ``start`` stay. Behind the edit, work ends once as many last tokens in a
        row as the longest token has bytes are what they were, since no later one looks further back.
        """
        old, shift, same, done = self.last, len(new) - (stop - start), 0, 0
        self.text = self.text[:start] + new.decode("latin-1") + self.text[stop:]
        self.last = old[: start + 1]
        for end in self.vocabulary.extend(self.text, self.last, start):
            done, before = done + 1, end - shift
            same = same + 1 if before > stop and old[before] == self.last[end] else 0
            if same >= self.vocabulary.longest:
                self.last += old[before + 1 :]
                break
        return done

    def ids(self) -> list[int]:
        end, out, bytes_of = len(self.text), [], self.vocabulary.bytes_of
        while end:
            out.append(self.last[end])
            end -= len(bytes_of[self.last[end]])
        return out[::-1]


class Encoder:
    """Encodes whole texts: each match of the pattern separately, with memos of bounded size."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.vocabulary = Vocabulary.read(path)
        # the pattern's \s in its plain reading, as SPACE has it
        split = regex.compile(pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]"))
        words = Recent(lambda new: [np.array(self.vocabulary.encode_piece(w.encode()), "<u4").tobytes() for w in new], 200_000)
        self.pieces = Recent(lambda new: [b"".join(words.look_up(split.findall(p))) for p in new], 200_000)

    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        return b"".join(self.pieces.look_up(PIECES.findall(text))) if text else b""

    def decode(self, packed: bytes) -> bytes:
        return self.vocabulary.decode(np.frombuffer(packed, "<u4").tolist())


def encoder(path: str, pattern: str) -> Encoder:
    return worker_state(("bpe", path, pattern), lambda: Encoder(path, pattern))


def encode(docs: DataFrame, path: str, pattern: str, ids: bool = True, digests: bool = False, text: str = "text") -> DataFrame:
    """Encode the whole text of every row and decode the ids again.

    Columns: those of ``docs`` but the text, ``n_tokens``; with ``ids``, ``ids`` (array of
    int); with ``digests``, ``ids_sha256`` and ``decoded_sha256``. Raises if decoding does not
    give the text back. NULL counts as empty; repeated rows stay; an input column named like
    an output column gives way to it. One pass, no shuffle; rows are worked one at a time.
    """
    made = ["n_tokens", *["ids"] * ids, *["ids_sha256", "decoded_sha256"] * digests]
    kept = [c for c in docs.columns if c not in (text, *made)]
    kinds = {"n_tokens": "long", "ids": "array<int>", "ids_sha256": "string", "decoded_sha256": "string"}
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept] + [f"{c} {kinds[c]}" for c in made])

    def run(batches):
        own = encoder(path, pattern)
        for batch in batches:
            out: dict[str, list] = {c: [] for c in made}
            for value in batch.column(text):
                value = value.as_py() or ""
                packed = own.encode(value)
                decoded = own.decode(packed)
                if decoded != value.encode():
                    raise ValueError("decoding does not give the text back")
                out["n_tokens"].append(len(packed) // 4)
                if ids:
                    out["ids"].append(np.frombuffer(packed, "<i4"))
                if digests:
                    out["ids_sha256"].append(hashlib.sha256(packed).hexdigest())
                    out["decoded_sha256"].append(hashlib.sha256(decoded).hexdigest())
            types = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32()), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(out[c], types[c]) for c in made], [*kept, *made])

    return docs.select(*kept, text).mapInArrow(run, schema)
