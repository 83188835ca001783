"""Token ids by the tokenizers library, each distinct piece of text encoded once per worker.

A text is cut where its vocabulary's own pattern cuts it, by comparing neighbouring bytes in numpy over
many texts at once; where that is not certain (unusual scripts, apostrophes, runs of white space), whole
stretches between spaces stay together. Arrow finds the distinct pieces, bounded caches hold their ids,
only new ones go to the library, and one gather puts the ids of all texts together.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import cache

import numpy as np
import pyarrow as pa

from .bpe import byte_letters
from .common import TwoGenerationCache

#: Bytes of texts encoded together; a longer text is taken in parts of about this size.
GROUP_BYTES = 4_000_000
#: Letters that are one character in every normal form, and whose lower case is among them.
_LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ſ"
#: Pieces that are one word of the vocabularies' patterns, a space before it apart.
_ONE_WORD = re.compile(f"[ \t-\r]?(?:[{_LETTERS}]+|[0-9]+|[!-&(-/:-@\\[-`{{-~]+)")
#: Pieces of printable ASCII and such letters are cut into words here; any other is left to the library.
_SIMPLE = re.compile(f"[ \n]?[!-~{_LETTERS}]+")
#: The cuts of the two vocabularies' own patterns, on such pieces.
_CUT_DROP = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^{_LETTERS}0-9]+")
_CUT_LEAD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^\\s{_LETTERS}0-9]+|\n")
_TO_LETTERS = {k: c for k, c in enumerate(byte_letters())}
_BETWEEN_WORDS = re.compile(rb"[A-Za-z] (?=[A-Za-z])")

# Classes of bytes. HARD ones keep their whole stretch together.
_SPACE, _NEWLINE, _LETTER, _DIGIT, _SIGN, _HARD = range(6)


def _classes(drops_space: bool) -> np.ndarray:
    out = np.full(256, _HARD, np.uint8)
    out[33:127] = _SIGN
    out[ord("'")] = _HARD
    out[48:58] = _DIGIT
    out[65:91] = out[97:123] = _LETTER
    out[0x80:0xC0] = out[0xC3:0xC6] = _LETTER  # with the bytes before them, the letters of _LETTERS
    out[32] = _SPACE
    if drops_space:
        out[9:14] = _SPACE
    else:
        out[10] = _NEWLINE
    return out


def _is_open(part: bytes) -> bool:
    """Whether a cut beside this part is not safe: it is empty or has white space at an end."""
    s = part.decode()
    return not s or s[0].isspace() or s[-1].isspace()


class PieceEncoder:
    """`encode(texts)` gives the ids of whole texts as one array, and where each text's begin and end.

    The vocabulary decides how a text is cut. One with word ends drops white space, so any run of it
    is a cut. A byte-level one keeps a space with the word that follows: a text is cut before a
    space or newline with no white space beside it. Strings in `controls` are tokens of their own.
    """

    def __init__(self, path: str, entries: int = 120_000, controls: tuple[str, ...] = ()) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import AddedToken, Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        if controls:
            self.tok.add_special_tokens([AddedToken(c, normalized=False, special=True) for c in controls])
        self.drops_space = bool(getattr(self.tok.model, "end_of_word_suffix", None))
        added = sorted((t.content.encode() for t in self.tok.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.controls = re.compile(b"|".join(map(re.escape, added)) or b"(?!)")
        self.classes = _classes(self.drops_space)
        self.pieces = TwoGenerationCache(entries)
        self.words = TwoGenerationCache(entries // 5)

    # --- cutting ---

    def _controls_at(self, data: bytes, starts: np.ndarray) -> list[tuple[int, int]]:
        """Where control strings begin and end; none goes on from one text into the next."""
        if not self.controls.search(data):
            return []
        return [m.span() for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()) for m in self.controls.finditer(data, a, b)]

    def _cut(self, data: bytes, starts: np.ndarray) -> np.ndarray:
        """Where the pieces of the texts that begin at `starts` (the last is the end of all) begin."""
        raw = np.frombuffer(data, np.uint8)
        n = len(raw)
        kind = self.classes[raw]
        # Of the letters' first bytes, the signs × and ÷, and İ, whose lower case is two characters.
        for a, b in ((0xC3, 0x97), (0xC3, 0xB7), (0xC4, 0xB0)):
            at = np.flatnonzero(raw[:-1] == a)
            kind[at[raw[at + 1] == b]] = _HARD
        forced = np.zeros(n + 1, bool)
        forced[starts] = True
        for a, b in self._controls_at(data, starts):
            forced[[a, b]] = True
            kind[a:b] = _HARD
        first = np.flatnonzero(forced[:n] | (kind <= _NEWLINE))  # where stretches begin
        size = np.diff(first, append=n)
        hard = np.zeros(len(first), bool)
        hard[np.searchsorted(first, np.flatnonzero(kind == _HARD), "right") - 1] = True
        kept = np.ones(len(first), bool)
        if not self.drops_space:
            blank = kind[first] <= _NEWLINE
            open_ = blank & (size == 1)
            odd = np.flatnonzero(hard)
            if len(odd):
                inner = [data[a : a + m] for a, m in zip((first + blank)[odd].tolist(), (size - blank)[odd].tolist())]
                answer = {c: _is_open(c) for c in set(inner)}
                open_[odd] = [answer[c] for c in inner]
            unsafe = open_ & True
            unsafe[1:] |= open_[:-1]
            kept = ~unsafe | forced[first]
            joined = ~kept
            hard |= joined | open_
            hard[:-1] |= joined[1:]
        cut = np.zeros(n, bool)
        cut[1:] = (kind[1:] != kind[:-1]) & (kind[:-1] != _SPACE)
        if self.drops_space:
            cut[1:] |= (kind[1:] == _DIGIT) & (kind[:-1] != _SPACE)
        if hard.any():
            cut &= ~np.repeat(hard, size)
        cut[first] = kept
        return np.flatnonzero(cut)

    # --- learning ---

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _model_ids(self, words: list[bytes]) -> list[bytes]:
        """Ids of words, each one word of the pattern: the model is given them in the vocabulary's letters,
        without the library's cutting and normalising."""
        if not words:
            return []
        shown = b"\n".join(words).decode("latin-1").translate(_TO_LETTERS).split(_TO_LETTERS[10])
        split = self.tok.model.tokenize
        return [array("I", [t.id for t in split(w)]).tobytes() for w in shown]

    def _learn(self, new: list[bytes]) -> None:
        one: list[bytes] = []
        shown: list[bytes] = []
        cut: dict[bytes, list[bytes]] = {}
        whole: list[bytes] = []
        for piece in new:
            s = piece.decode()
            if _ONE_WORD.fullmatch(s) and (self.drops_space or s[0] != "\n"):
                one.append(piece)
                shown.append(s.strip().lower().encode() if self.drops_space else piece)
            elif _SIMPLE.fullmatch(s) and not self.controls.search(piece):
                cut[piece] = [w.encode() for w in (_CUT_DROP.findall(s.strip().lower()) if self.drops_space else _CUT_LEAD.findall(s))]
            else:
                whole.append(piece)
        self.pieces.put_all(one, self._model_ids(shown))
        if cut:
            wanted = self.words.absent({w for ws in cut.values() for w in ws if w != b"\n"})
            self.words.put_all(wanted, self._model_ids(wanted))
            known = self.words.get
            line = self._library(["\n"])[0] if not self.drops_space else b""
            self.pieces.put_all(list(cut), [b"".join([known(w) if w != b"\n" else line for w in ws]) for ws in cut.values()])
        self.pieces.put_all(whole, self._library([c.decode() for c in whole]))

    # --- encoding ---

    def _group(self, data: bytes, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self._cut(data, starts)
        ends = np.append(at, len(data)).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(data)]).dictionary_encode()
        distinct = pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        self._learn(self.pieces.absent(set(distinct)))
        found = list(map(self.pieces.get, distinct))
        sizes = np.fromiter(map(len, found), np.int32, len(found)) // 4
        held = pa.ListArray.from_arrays(pa.array(np.append(np.int32(0), np.cumsum(sizes, dtype=np.int32))), pa.array(np.frombuffer(b"".join(found), "<u4")))
        got = held.take(pieces.indices)
        before = got.offsets.to_numpy()[np.searchsorted(at, starts)]
        self.pieces.turn()
        self.words.turn()
        return got.flatten().to_numpy(), before.astype(np.int64) - int(before[0])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and where each text's begin, with their number at the end.

        Null texts are empty."""
        texts = texts.cast(pa.large_string()).fill_null("")
        if not len(texts):
            return np.zeros(0, "<u4"), np.zeros(1, np.int64)
        _, offsets, buffer = texts.buffers()
        starts = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = memoryview(buffer)[starts[0] : starts[-1]] if buffer is not None else memoryview(b"")
        starts = starts - starts[0]
        # Long texts are cut between words as well, where every vocabulary is.
        more = [m.start() + 1 for a in np.flatnonzero(np.diff(starts) > 2 * GROUP_BYTES).tolist() for k in range(int(starts[a]) + GROUP_BYTES, int(starts[a + 1]) - GROUP_BYTES, GROUP_BYTES) if (m := _BETWEEN_WORDS.search(data, k, int(starts[a + 1])))]
        places = np.union1d(starts, np.array(more, np.int64))
        ids: list[np.ndarray] = []
        before = np.zeros(len(places), np.int64)
        at, total = 0, 0
        while at < len(places) - 1:
            end = max(at + 1, int(np.searchsorted(places, places[at] + GROUP_BYTES, "right")) - 1)
            got, inside = self._group(bytes(data[places[at] : places[end]]), places[at : end + 1] - places[at])
            ids.append(got)
            before[at : end + 1] = inside + total
            total += len(got)
            at = end
        return np.concatenate(ids) if ids else np.zeros(0, "<u4"), before[np.searchsorted(places, starts)]

    def ids(self, texts: list[str]) -> list[bytes]:
        """Of each text, its ids as little-endian unsigned 32-bit bytes."""
        flat, starts = self.encode(pa.array(texts, pa.large_string()))
        raw = flat.tobytes()
        return [raw[4 * a : 4 * b] for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())]


def token_bytes(tok) -> list[bytes]:
    """The bytes of text that each id of a byte-level vocabulary stands for."""
    of_letter = {c: k for k, c in enumerate(byte_letters())}
    added = {i: t.content.encode() for i, t in tok.get_added_tokens_decoder().items()}
    shown = {i: added.get(i) or bytes(map(of_letter.__getitem__, t)) for t, i in tok.get_vocab(with_added_tokens=True).items()}
    return [shown.get(i, b"") for i in range(max(shown) + 1)]


@cache
def encoder(path: str, entries: int = 250_000, controls: tuple[str, ...] = ()) -> PieceEncoder:
    """The worker's encoder for a vocabulary file; it holds about 200 bytes for each of twice `entries` pieces."""
    return PieceEncoder(path, entries, controls)


@cache
def vocabulary_size(path: str) -> int:
    """Ids of a vocabulary file, control strings included."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)
