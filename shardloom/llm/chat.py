"""Chat formatting with a loss mask aligned to token offsets."""

from __future__ import annotations

import hashlib
import re
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches
from .tokens import encoder, token_bytes

#: The template's control strings. HEAD role SEP text TAIL is a turn.
HEAD, SEP, TAIL = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
_TURN = re.compile(re.escape(HEAD) + "(.*?)" + re.escape(SEP) + "(.*?)" + re.escape(TAIL), re.DOTALL)


def escape(text: str) -> str:
    """A text without any control string: a backslash goes before each backslash and inside each `<|`."""
    return text if "\\" not in text and "<|" not in text else text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    """The text that `escape` was given."""
    return text if "\\" not in text else re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def render(turns: list[tuple[str, str]]) -> tuple[str, np.ndarray]:
    """The formatted conversation and, for each turn, the span [start, end) of its escaped text."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{HEAD}{escape(role)}{SEP}", escape(text)
        out += [head, body, TAIL]
        spans.append((at + len(head), at + len(head) + len(body)))
        at += len(head) + len(body) + len(TAIL)
    return "".join(out), np.array(spans, np.int64).reshape(-1, 2)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    return [(unescape(a), unescape(b)) for a, b in _TURN.findall(formatted)]


def token_mask(offsets: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Which tokens have characters in any of the sorted, disjoint, non-empty spans, by binary search.

    The span that may meet a token is the first that ends after the token's start.
    """
    if not len(spans) or not len(offsets):
        return np.zeros(len(offsets), bool)
    at = np.searchsorted(spans[:, 1], offsets[:, 0], side="right")
    inside = at < len(spans)
    return inside & (spans[np.minimum(at, len(spans) - 1), 0] < offsets[:, 1])


def masked_ranges(offsets: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The character ranges [start, end) under the mask: tokens' spans joined where they touch or share a character."""
    under = offsets[mask]
    if not len(under):
        return np.zeros((0, 2), np.int64)
    fresh = np.append(True, under[1:, 0] > under[:-1, 1])
    return np.column_stack([under[fresh, 0], under[np.append(np.flatnonzero(fresh)[1:] - 1, len(under) - 1), 1]])


def char_offsets(data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Character spans [start, end) of tokens that follow one another and have that many bytes of the text.

    A token with a part of a character has the whole of it in its span."""
    ends = np.cumsum(sizes)
    if not (data & 0x80).any():
        return np.column_stack([ends - sizes, ends])
    chars = np.cumsum((data & 0xC0) != 0x80)
    return np.column_stack([chars[ends - sizes] - 1, chars[ends - 1]])


@cache
def _coder(path: str):
    """The worker's encoder with the control strings as tokens, so no token crosses a turn's edge, and the
    bytes of each id."""
    enc = encoder(path, controls=(HEAD, SEP, TAIL))
    return enc, pa.array(token_bytes(enc.tok), pa.large_binary())


SCHEMA = "conv_id long, formatted string, ids array<int>, loss_mask array<boolean>, loss_ranges array<struct<start:long,end:long>>"


def format_conversations(turns: DataFrame, tokenizer: str, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: its formatted text, ids, loss mask over them, and the ranges it covers.

    A conversation is rendered whole from its rows by turn (then role and text), encoded once with
    offsets, and the texts of the roles in `learn` are under the mask. The vocabulary must be a byte-level
    one, whose ids stand for bytes that follow one another. Null roles and texts are empty;
    an empty text of such a role adds nothing to the mask; repeated rows are turns of their own, as are
    ties; rows with a null turn come first; a null conv_id is one conversation; no rows, no result.
    Other columns are left out. A conversation is one output row and so is held in one task, and a very long
    one needs memory in proportion.
    """

    def run(batches):
        enc, held = _coder(tokenizer)
        sizes = pa.compute.binary_length(held).to_numpy()
        for batch in batches:
            lists = batch.column("turns")
            rows = lists.flatten()
            roles, texts = (rows.field(k).fill_null("").to_pylist() for k in ("role", "text"))
            at = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            made = [render(list(zip(roles[a:b], texts[a:b]))) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            shown = pa.array([m[0] for m in made], pa.large_string())
            ids, first = enc.encode(shown)
            data = np.frombuffer(shown.buffers()[2] or b"", np.uint8)
            offsets = char_offsets(data, sizes[ids])
            # All conversations of the batch are one line of characters.
            begins = np.cumsum([0, *(len(m[0]) for m in made)])
            spans = np.concatenate([m[1] + b for m, b in zip(made, begins)]) if made else np.zeros((0, 2), np.int64)
            wanted = np.array([r in learn for r in roles], bool) & (spans[:, 1] > spans[:, 0])
            mask = token_mask(offsets, spans[wanted])
            ranges = masked_ranges(offsets, mask)
            of = np.searchsorted(ranges[:, 0], begins)
            ranges = ranges - begins[np.repeat(np.arange(len(made)), np.diff(of))][:, None]
            first = pa.array(first.astype(np.int32))
            pair = pa.StructArray.from_arrays([pa.array(ranges[:, 0].copy()), pa.array(ranges[:, 1].copy())], ["start", "end"])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("conv_id"), shown.cast(pa.string()), pa.ListArray.from_arrays(first, pa.array(ids.astype(np.int32))),
                    pa.ListArray.from_arrays(first, pa.array(mask)), pa.ListArray.from_arrays(pa.array(of.astype(np.int32)), pair),
                ],
                ["conv_id", "formatted", "ids", "loss_mask", "loss_ranges"],
            )

    bound_batches(turns.sparkSession)
    row = F.struct(F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    whole = turns.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(row)).alias("turns"))
    return whole.mapInArrow(run, SCHEMA)


def _joined(pieces: pa.LargeBinaryArray) -> tuple[bytes, np.ndarray]:
    """All pieces in one, and where each begins there, with the end of all."""
    _, offsets, data = pieces.buffers()
    at = np.frombuffer(offsets, np.int64)[pieces.offset : pieces.offset + len(pieces) + 1] if len(pieces) else np.zeros(1, np.int64)
    return (data.to_pybytes() if data is not None else b"")[at[0] : at[-1]], at - at[0]


def read_back(formatted: DataFrame, tokenizer: str) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) from ids and loss mask alone.

    The ids are decoded to the formatted text and its turns parsed; the loss text is what the ids under the
    mask stand for. Each is unescaped first. A turn is digested as role, newline, text, newline.
    """

    def run(batches):
        _, held = _coder(tokenizer)
        for batch in batches:
            lists, under = batch.column("ids"), batch.column("loss_mask").flatten()
            at = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            pieces = held.take(lists.flatten())
            text, ends = _joined(pieces)
            loss, loss_ends = _joined(pieces.filter(under))
            ends, loss_ends = ends[at].tolist(), loss_ends[np.append(0, np.cumsum(under.to_numpy(zero_copy_only=False)))[at]].tolist()
            rows = []
            for k, conv in enumerate(batch.column("conv_id").to_pylist()):
                shown, learned = text[ends[k] : ends[k + 1]].decode(), unescape(loss[loss_ends[k] : loss_ends[k + 1]].decode())
                turns = parse(shown)
                whole = "".join(f"{role}\n{said}\n" for role, said in turns)
                rows.append((conv, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest(), len(shown)))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return formatted.select("conv_id", "ids", "loss_mask").mapInArrow(run, schema)
