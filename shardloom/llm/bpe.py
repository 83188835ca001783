"""Byte-pair encoding and decoding with contiguous rank arrays.

A word is an array of part boundaries with, beside it, the ranks of adjacent parts. The least rank
is found by a scan, its boundary is deleted, and the ranks of the two neighbouring pairs are looked
up anew. Words of one length are scanned together, a row each. A word longer than SHORT keeps its
ranks in a heap instead, so that its time stays near linear.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections import defaultdict
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TwoGenerationCache, bound_batches, texts_of

SHORT = 64
NONE = np.iinfo(np.int64).max
#: Unicode White_Space, as the vocabulary's patterns mean it.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
GROUP_BYTES = 2_000_000


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, extra = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(extra)
            extra += 1
    return out


class WordBpe:
    """A vocabulary with word ends, read from its file; `encode(texts)` gives ids and decoded text."""

    def __init__(self, path: str) -> None:
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab = model["vocab"]
        self.suffix = model["end_of_word_suffix"]
        self.tokens = {i: t for t, i in vocab.items()}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens |= {i: t for t, i in self.added.items()}
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + self.suffix] for c in letters], np.int64)
        self.size = max(self.tokens) + 1
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank_of = keys[order], order
        self.control = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")")
        self.spaces = regex.compile(f"[{WHITE}]+")
        self.parts = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{WHITE}\p{{L}}\p{{N}}]+")
        self.words = TwoGenerationCache(200_000)
        self.chunks = TwoGenerationCache(200_000)

    # --- words ---

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge rank of each pair of ids, NONE where there is no such merge."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank_of[at], NONE)

    def _same_length(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of words of one short length, each row by its own scans."""
        raw = np.frombuffer(b"".join(words), np.uint8).reshape(len(words), -1)
        ids = self.inner[raw]
        ids[:, -1] = self.last[raw[:, -1]]
        out: list[np.ndarray] = [None] * len(words)  # type: ignore[list-item]
        rows = np.arange(len(words))
        ranks = self.ranks(ids[:, :-1], ids[:, 1:])
        while True:
            n = ids.shape[1]
            if n == 1:
                at, least = np.zeros(len(rows), np.int64), np.full(len(rows), NONE)
            else:
                at = ranks.argmin(1)
                least = ranks[np.arange(len(rows)), at]
            ended = least == NONE
            for r, word in zip(rows[ended].tolist(), ids[ended]):
                out[r] = word
            if ended.all():
                return out
            go = ~ended
            rows, ids, ranks, at, least = rows[go], ids[go], ranks[go], at[go], least[go]
            line = np.arange(len(rows))
            ids[line, at] = self.merged[least]
            # The boundary after `at` goes: what follows moves up by one.
            ids = np.where(np.arange(n - 1) <= at[:, None], ids[:, :-1], ids[:, 1:])
            if n > 2:
                ranks = np.where(np.arange(n - 2) < at[:, None], ranks[:, :-1], ranks[:, 1:])
                left, right = at > 0, at < n - 2
                i, a = line[left], at[left]
                ranks[i, a - 1] = self.ranks(ids[i, a - 1], ids[i, a])
                i, a = line[right], at[right]
                ranks[i, a] = self.ranks(ids[i, a], ids[i, a + 1])

    def _long(self, word: bytes) -> np.ndarray:
        """Ids of one long word: ranks in a heap, boundaries in a linked list."""
        ids = [int(x) for x in self.inner[np.frombuffer(word, np.uint8)]]
        ids[-1] = int(self.last[word[-1]])
        n = len(ids)
        after, before, live = [*range(1, n), -1], [*range(-1, n - 1)], [True] * n
        first = self.ranks(np.array(ids[:-1]), np.array(ids[1:]))
        heap = [(int(first[k]), k, ids[k], ids[k + 1]) for k in np.flatnonzero(first != NONE).tolist()]
        heapq.heapify(heap)
        pair: dict[tuple[int, int], int] = {}

        def push(k: int) -> None:
            j = after[k]
            if j >= 0:
                key = (ids[k], ids[j])
                if key not in pair:
                    pair[key] = int(self.ranks(np.array([key[0]]), np.array([key[1]]))[0])
                if pair[key] != NONE:
                    heapq.heappush(heap, (pair[key], k, *key))

        while heap:
            rank, k, a, b = heapq.heappop(heap)
            j = after[k]
            if not live[k] or j < 0 or ids[k] != a or ids[j] != b:
                continue  # one of its parts has been merged since
            ids[k] = int(self.merged[rank])
            live[j] = False
            after[k] = after[j]
            if after[j] >= 0:
                before[after[j]] = k
            push(k)
            if before[k] >= 0:
                push(before[k])
        return np.array([x for x, ok in zip(ids, live) if ok], np.int64)

    def _learn_words(self, wanted: set[bytes]) -> None:
        by_length = defaultdict(list)
        for w in self.words.absent(wanted):
            by_length[len(w)].append(w)
        for length, words in by_length.items():
            for at in range(0, len(words), 4096):
                some = words[at : at + 4096]
                found = self._same_length(some) if length <= SHORT else [self._long(w) for w in some]
                for w, ids in zip(some, found):
                    text = "".join(" " + self.tokens[i] for i in ids.tolist()).encode()
                    self.words.put(w, (ids.astype("<u4").tobytes(), text))

    # --- chunks between white space ---

    def _pieces(self, chunk: str) -> list:
        """Control strings as ids, all else normalised and cut into the words' bytes."""
        out: list = []
        for k, part in enumerate(self.control.split(chunk)):
            if k % 2:
                out.append(self.added[part])
            elif part:
                if not part.isascii():
                    part = unicodedata.normalize("NFC", part).replace("Σ", "σ")  # lower-cased by itself, at a word's end too
                out += [w.encode() for w in self.parts.findall(part.lower())]
        return out

    def _learn_chunks(self, wanted: set[bytes]) -> None:
        cut = {c: self._pieces(c.decode()) for c in self.chunks.absent(wanted)}
        self._learn_words({w for ws in cut.values() for w in ws if isinstance(w, bytes)})
        for c, pieces in cut.items():
            got = [self.words.get(w) if isinstance(w, bytes) else (w.to_bytes(4, "little"), b" " + self.tokens[w].encode()) for w in pieces]
            self.chunks.put(c, (b"".join(g[0] for g in got), b"".join(g[1] for g in got)))

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """Of each text, its ids as little-endian unsigned 32-bit bytes, and what they decode to.

        White space is dropped by the vocabulary, so ASCII white space cuts a text without a trace.
        Decoding joins the tokens with single spaces, word ends shown, as a tokenizer without a decoder does.
        """
        out: list[tuple[bytes, bytes]] = []
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and size < GROUP_BYTES:
                size += len(texts[end])
                end += 1
            split = [t.encode().split() for t in texts[at:end]]
            self._learn_chunks({w for s in split for w in s})
            get = self.chunks.get
            for s in split:
                got = list(map(get, s))
                out.append((b"".join([g[0] for g in got]), b"".join([g[1] for g in got])[1:]))
            self.words.turn()
            self.chunks.turn()
            at = end
        return out

    def decode(self, ids) -> str:
        """What ids stand for, control strings included."""
        return " ".join(self.tokens[int(i)] for i in ids)


@cache
def word_bpe(path: str) -> WordBpe:
    """The worker's coder for a vocabulary file."""
    return WordBpe(path)


def encode_documents(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, ids binary, decoded): ids as little-endian unsigned 32-bit numbers, of whole texts.

    Null and empty texts have no ids and decode to the empty string; very long ones need memory in proportion;
    repeated rows are encoded each;
    an empty table gives an empty one; other columns are left out whatever their names.
    """

    def run(batches):
        coder = word_bpe(vocabulary)
        for batch in batches:
            got = coder.encode(texts_of(batch))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([g[0] for g in got], pa.binary()), pa.array([g[1].decode() for g in got], pa.string())],
                ["doc_id", "ids", "decoded"],
            )

    bound_batches(docs.sparkSession)
    return _plain(docs).mapInArrow(run, "doc_id long, ids binary, decoded string")


def digest_documents(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): as encode_documents, digested where it is encoded."""

    def run(batches):
        coder = word_bpe(vocabulary)
        for batch in batches:
            got = coder.encode(texts_of(batch))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(g[0]) // 4 for g in got], pa.int64()),
                    pa.array([hashlib.sha256(g[0]).hexdigest() for g in got]),
                    pa.array([hashlib.sha256(g[1]).hexdigest() for g in got]),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    bound_batches(docs.sparkSession)
    return _plain(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
