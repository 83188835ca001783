"""Secret scanning by assignment-aware lexing.

A text is read for assignments in source and configuration syntax: a name, an operator and an expression
of string literals, names and plus signs, or a bare configuration value. Names stand for the literals
last assigned to them, so a literal reaches each name it flows to. A literal is scored by how sensitive
its target names are and by how much it looks like a key. Pattern matches for well-known forms are
reported beside that.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, texts_of

#: The pattern kinds in their fixed order, then the lexer's own.
ASSIGN, ACCESS, HEX, LITERAL = "assign", "access", "hex", "literal"
KINDS = (ASSIGN, ACCESS, HEX, LITERAL)

# Fixed patterns of the base rules.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX_RUN = re.compile(r"[0-9a-f]{24,}")
_ASSIGN_HINTS = ("passw", "secret", "token", "apikey", "api_key")

#: Parts of a name that make what it holds sensitive, with their weight.
SENSITIVE = {
    "password": 3, "passwd": 3, "passphrase": 3, "pwd": 3, "pass": 1, "secret": 3, "token": 2, "apikey": 3, "accesskey": 3,
    "privatekey": 3, "secretkey": 3, "credential": 2, "credentials": 2, "auth": 1, "bearer": 2, "key": 1, "signature": 1, "salt": 1, "dsn": 1,
}
#: Values that stand for a secret without being one.
PLACEHOLDERS = {"password", "passwd", "secret", "token", "changeme", "example", "none", "null", "true", "false", "undefined", "required", "optional", "redacted", "xxxxxx"}
LEAST_SCORE = 4.0
LEAST_LENGTH = 6

# Every repeat is possessive or can't be continued, and no match begins within a run of name characters. A run of bare
# characters can hold many assignments: its end, its next digit and the end of its line are looked up once (see _Runs). So a
# text is read in time linear in its length whatever it holds.
_NAME = r"[A-Za-z_$][\w$.-]*+"
_STRING = r'"(?:[^"\\\n]|\\.)*+"|\'(?:[^\'\\\n]|\\.)*+\''
_OPERATOR = r"[ \t]*+(?::[ \t]*+[A-Za-z_][\w.]*+[ \t]*+=(?!=)|:=|=>|=(?!=)|:(?![/:]))[ \t]*+"
#: A run with a name and what follows it: an operator, or the bracket of a subscript, whose end is looked up.
_TARGET = re.compile(rf"""(?<![\w$.-])(?P<quote>["']?)(?P<run>[\w$.-]++)(?P=quote)(?:(?P<open>\[)|{_OPERATOR})""", re.ASCII)
_AFTER_SUBSCRIPT = re.compile(_OPERATOR, re.ASCII)
_SUBSCRIPT_END = re.compile(r"[\]\n]")
_BARE = r"[^\s\"'`,;(){}\[\]<>#]"
_TERM = re.compile(rf"(?P<string>{_STRING})|(?P<name>{_NAME})|(?P<bare>{_BARE})", re.ASCII)
_RUN = re.compile(_BARE + "*+")
_DIGIT = re.compile("[0-9]")
_LINE_END = re.compile(r"[ \t]*+[,;]?[ \t]*+(?:\n|\Z)")
_PLUS = re.compile(r"[ \t]*+\+[ \t]*+")
_TAG = re.compile(rf"<(?P<name>{_NAME})>(?P<value>[^<>\s]{{6,}}+)</(?P=name)>", re.ASCII)
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """The spans of the three fixed patterns, leftmost and non-overlapping within each kind."""
    out = []
    low = text.lower()
    if any(h in low for h in _ASSIGN_HINTS):
        out += [(m.start(), m.end(), ASSIGN) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), ACCESS) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), HEX) for m in _HEX_RUN.finditer(text)]
    return out


def name_weight(name: str) -> int:
    """How sensitive a name is: the greatest weight of its words and of neighbouring words joined."""
    words = [w for w in re.split(r"[_.\-$]+", _CAMEL.sub("_", name).lower()) if w]
    joined = words + [a + b for a, b in zip(words, words[1:])]
    return max((SENSITIVE.get(w, 0) for w in joined), default=0)


def literal_score(value: str) -> float:
    """How much a literal looks like a secret: length, kinds of characters and entropy; 0 if it can't be one."""
    if len(value) < LEAST_LENGTH or re.search(r"\s", value) or value.lower() in PLACEHOLDERS or len(set(value)) < 4:
        return 0.0
    if re.match(r"(\$\{|\{\{|<|%\(|https?://[^@]*$)", value):
        return 0.0
    kinds = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", r"[^A-Za-z0-9]"))
    n = len(value)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    return (kinds >= 2) + (kinds >= 3) + (n >= 12) + (n >= 20) + (entropy >= 3.0) + (bool(re.search("[0-9]", value)))


def _assigned(text: str, m: re.Match | None, ends: list[int]) -> int | None:
    """Where the expression begins that is assigned to a match of _TARGET; None if nothing is."""
    if not m or not m["open"]:
        return m and m.end()
    k = bisect_left(ends, m.end())
    if k == len(ends) or text[ends[k]] != "]":
        return None
    after = _AFTER_SUBSCRIPT.match(text, ends[k] + 1)
    return after and after.end()


class _Runs:
    """The runs of bare characters of a text, asked for at places that only go forward."""

    def __init__(self, text: str) -> None:
        self.text, self.start, self.end, self.digit, self.ends_line = text, 0, 0, -1, None

    def end_of(self, at: int) -> int:
        """Where the run ends that goes on at this place; the place itself if none does."""
        if not self.start <= at < self.end:
            self.start, self.end, self.ends_line = at, _RUN.match(self.text, at).end(), None
        return self.end

    def value(self, at: int, after_colon: bool) -> tuple[int, int] | None:
        """A configuration value without quotes at this place: one with a digit, or after a colon the whole rest of a line."""
        end = self.end_of(at)
        if end == at:
            return None
        if self.digit < at:
            m = _DIGIT.search(self.text, at)
            self.digit = m.start() if m else len(self.text)
        if self.digit < end:
            return at, end
        if after_colon and self.ends_line is None:
            self.ends_line = bool(_LINE_END.match(self.text, end))
        return (at, end) if after_colon and self.ends_line else None


def assignments(text: str) -> list[tuple[str, list[tuple[int, int]], list[int]]]:
    """(name, literals, sources) of each assignment in the order of the text.

    A literal is its place (start, end) without quotes. A name on the right stands for the literals
    that were last assigned to it, or where none were yet, for those first assigned to it later: sources
    are the places in this list of the assignments it refers to.
    """
    out = [(m["name"], [m.span("value")], []) for m in _TAG.finditer(text)]
    first: dict[str, int] = {}
    known: dict[str, int] = {}
    holds: dict[int, bool] = {}
    later: list[tuple[int, str]] = []
    ends = [m.start() for m in _SUBSCRIPT_END.finditer(text)] if "[" in text else []
    runs, at = _Runs(text), 0
    while m := _TARGET.search(text, at):
        at = m.end()
        name = m["run"].lstrip("0123456789.-")
        if not name or (start := _assigned(text, m, ends)) is None:
            continue
        at = start
        found: list[tuple[int, int]] = []
        sources: list[int] = []
        alone, any_found = True, False
        while t := _TERM.match(text, at):
            if t["string"]:
                found.append((t.start() + 1, t.end() - 1))
                any_found = True
            elif t["name"] and t["name"] in known:
                sources.append(known[t["name"]])
                any_found = any_found or holds[sources[-1]]
            else:
                if t["name"]:
                    later.append((len(out), t["name"]))
                if alone and (value := runs.value(at, ":" in text[m.end("run") : at])):
                    found.append(value)
                    any_found, at = True, value[1]
                elif any_found or _assigned(text, _TARGET.match(text, at), ends) is None:
                    at = runs.end_of(at) if t["bare"] else at
                break  # of a = b = "...", b's assignment is read next, and a keeps nothing
            at, alone = t.end(), False
            plus = _PLUS.match(text, at)
            if not plus:
                break
            at = plus.end()
        known[name] = len(out)
        first.setdefault(name, len(out))
        holds[len(out)] = any_found
        out.append((name, found, sources))
    for k, name in later:
        if first.get(name, k) > k:
            out[k][2].append(first[name])
            out[k][1][:] = [place for place in out[k][1] if text[slice(*place)] != name]  # no value, but that name
    return out


def literal_weights(text: str) -> dict[tuple[int, int], int]:
    """The greatest weight of the names that each literal reaches, where there is one.

    Weights go from an assignment to its sources, greatest first, so every literal of a constant meets
    every name the constant flows to, and each assignment hands on once.
    """
    read = assignments(text)
    weights = [name_weight(name) for name, _, _ in read]
    for level in sorted({*weights} - {0}, reverse=True):
        todo = [k for k, w in enumerate(weights) if w == level]
        while todo:
            for source in read[todo.pop()][2]:
                if weights[source] < level:
                    weights[source] = level
                    todo.append(source)
    out: dict[tuple[int, int], int] = {}
    for k, (_, places, _) in enumerate(read):
        for place in places:
            out[place] = max(out.get(place, 0), weights[k])
    return {place: w for place, w in out.items() if w}


def literal_spans(text: str) -> list[tuple[int, int, str]]:
    """Literals whose targets and looks together reach LEAST_SCORE; a target must be sensitive."""
    if "=" not in text and ":" not in text and "</" not in text:
        return []
    out = []
    for (a, b), w in literal_weights(text).items():
        looks = literal_score(text[a:b])
        if looks and w + looks >= LEAST_SCORE and looks >= 2:
            out.append((a, b, LITERAL))
    return out


def spans(text: str) -> list[tuple[int, int, str]]:
    """All spans (start, end, kind) by start, then kind in the order of KINDS."""
    return sorted({*base_spans(text), *literal_spans(text)}, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def redact(text: str, found: list[tuple[int, int, str]]) -> str:
    """The text with each stretch covered by spans replaced by one mark."""
    out, at = [], 0
    for a, b, kind in found:
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], f"[{kind} removed]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def _listed(found) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in found)


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, spans array<struct<start,end,kind>>, redacted) of each whole text.

    Null and empty texts have no spans; very long ones take time and memory in proportion; repeated rows
    are scanned each; an empty table gives an empty one; other columns are left out.
    """

    def run(batches):
        for batch in batches:
            texts = texts_of(batch)
            found = [spans(t) for t in texts]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array([[dict(zip(("start", "end", "kind"), s)) for s in f] for f in found], kind),
                    pa.array([redact(t, f) if f else t for t, f in zip(texts, found)], pa.string()),
                ],
                ["doc_id", "spans", "redacted"],
            )

    bound_batches(docs.sparkSession)
    return _plain(docs).mapInArrow(run, "doc_id long, spans array<struct<start:long,end:long,kind:string>>, redacted string")


def digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_literal) of each whole text.

    A null text is an empty one, which has no spans: counts 0, empty lists. Very long texts take time and memory in proportion;
    repeated rows come back repeated, a null id stays; an empty table gives an empty one; other columns are left out, whatever their names.
    """

    def run(batches):
        for batch in batches:
            found = [spans(t) for t in texts_of(batch)]
            base = [[s for s in f if s[2] != LITERAL] for f in found]
            count = lambda kind: pa.array([sum(s[2] == kind for s in f) for f in found], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), count(ASSIGN), count(ACCESS), count(HEX),
                    pa.array([hashlib.sha256(_listed(b).encode()).hexdigest() for b in base], pa.string()),
                    pa.array([_listed(f) for f in found], pa.string()), count(LITERAL),
                ],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_literal"],
            )

    bound_batches(docs.sparkSession)
    return _plain(docs).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_literal long")


def remove_secrets(docs: DataFrame) -> DataFrame:
    """`docs` with the secrets in `text` replaced and n_chars, where there is one, counted anew.

    A null or empty text stays as it is, with its n_chars; very long texts take time and memory in proportion; repeated rows are cleaned each; an
    empty table gives an empty one. All columns stay, whatever their names, and only `text` and n_chars change.
    """
    at = docs.columns.index("text")
    length = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches):
        for batch in batches:
            cols = batch.columns
            texts = cols[at].to_pylist()
            clean = [redact(t, f) if t and (f := spans(t)) else t for t in texts]
            cols[at] = pa.array(clean, cols[at].type)
            if length is not None:
                old = cols[length].to_pylist()
                new = [o if c is t else len(c) for o, c, t in zip(old, clean, texts)]
                cols[length] = pa.array(new, cols[length].type)
            yield pa.RecordBatch.from_arrays(cols, schema=batch.schema)

    bound_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
