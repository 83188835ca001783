"""Quality rules as a bitmask ledger, in DataFrame expressions only.

Every rule is evaluated once per document. The ledger keeps the measurements and one long whose
bits say which rules failed; a policy is a named set of rules, so verdicts of old and new policies
and the effect of leaving a rule out come from the bits, without reading a text again.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD_BREAK = "[ \\t-\\r]+"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

#: Rules in bit order: name -> SQL condition on the measurements under which a document fails.
#: All are integer comparisons, so they mean the same in any engine.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "no_words": "n_words = 0",
    "symbols": "10 * n_symbols > n_words",
    "dup_lines": "10 * n_dup_lines > 5 * n_lines",
    "short_words": "10 * word_chars < 25 * n_words",
    "long_words": "word_chars > 12 * n_words",
    "some_repeats": "100 * n_repeat_words > 30 * n_words",
}
BASE = ("few_words", "repeated_words")

#: Policies by version: the rules that reject.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": BASE,
    "v1": (*BASE, "no_words", "symbols", "dup_lines", "short_words", "long_words"),
    "v2": (*BASE, "no_words", "symbols", "dup_lines", "short_words", "long_words", "some_repeats"),
}
CURRENT = "v1"

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def mask(rules) -> int:
    """The bits of the named rules."""
    names = list(RULES)
    return sum(1 << names.index(r) for r in rules)


def measure(docs: DataFrame) -> DataFrame:
    """Add the measurements as long columns; a null text counts as empty.

    Words are runs without ASCII white space. A repeated word lies in a 3-word window that is found
    at least twice in the text: windows are told apart by 64-bit hashes, sorted with their place, so
    equal ones are neighbours, and the places they cover are counted once each. Every step is linear
    or a sort of one text's array, whatever the text repeats.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    trimmed = F.expr("trim(both ' \\t\\n\\u000b\\u000c\\r' from _text)")  # an escaped f is the letter f in SQL
    d = docs.withColumn("_text", text)
    d = d.withColumn("_words", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WORD_BREAK)))
    d = d.withColumn("n_words", F.size("_words").cast("long"))
    d = d.withColumn(
        "_windows",
        F.expr(
            "case when n_words < 4 then cast(array() as array<struct<h:bigint,p:int>>) else sort_array(transform(sequence(0, cast(n_words as int) - 3),"
            " p -> struct(xxhash64(_words[p], _words[p + 1], _words[p + 2]) as h, p as p))) end"
        ),
    )
    # Sorted windows equal to the one before; each run of equals gives its first place too.
    d = d.withColumn(
        "_again",
        F.expr(
            "case when n_words < 4 then cast(array() as array<int>) else sort_array(transform(filter(_windows, (w, i) ->"
            " (i > 0 and _windows[greatest(i, 1) - 1].h = w.h) or (i + 1 < size(_windows) and _windows[least(i + 1, size(_windows) - 1)].h = w.h)),"
            " w -> w.p)) end"
        ),
    )
    # Each window covers three places, less those its predecessor has covered.
    covered = F.expr(
        "case when size(_again) = 0 then 0L else 3L + aggregate(zip_with(slice(_again, 2, greatest(size(_again) - 1, 0)),"
        " slice(_again, 1, greatest(size(_again) - 1, 0)), (b, a) -> least(3, b - a)), 0L, (s, x) -> s + x) end"
    )
    d = d.withColumn("n_repeat_words", covered)
    lines = F.filter(F.split("_text", "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    d = d.withColumn("_lines", lines)
    length = F.length("_text")
    return d.withColumns(
        {
            "word_chars": F.length(F.translate("_text", SPACES, "")).cast("long"),
            "n_symbols": (length - F.length(F.translate("_text", SYMBOLS, ""))).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        }
    ).drop("_text", "_words", "_windows", "_again", "_lines")


def failures(rules: Mapping[str, str] = RULES) -> Column:
    """The ledger's bits, from the measurements."""
    bits = F.lit(0).cast("long")
    for k, condition in enumerate(rules.values()):
        bits = bits.bitwiseOR(F.when(F.expr(condition), F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
    return bits


def ledger(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, the measurements and `failed`, the bits of the failed rules.

    Null and empty texts have no words and fail the rules on word counts; repeated rows are judged
    each; an empty table gives an empty ledger; further columns are left out whatever their names.
    """
    d = measure(docs.select(F.col("doc_id"), F.col("text")))
    return d.select("doc_id", *MEASURES, failures().alias("failed"))


def passes(policy: str = CURRENT) -> Column:
    """Whether a ledger row passes a policy."""
    return F.col("failed").bitwiseAND(F.lit(mask(POLICIES[policy])).cast("long")) == 0


def apply_policies(book: DataFrame, policies=tuple(POLICIES)) -> DataFrame:
    """The ledger with one boolean column kept_<policy> for each policy."""
    return book.withColumns({f"kept_{p}": passes(p) for p in policies})


def ablations(book: DataFrame, policy: str = CURRENT) -> DataFrame:
    """(rule, failed, only_this): documents failing a rule, and those the policy would keep without it.

    The ledger is first summed by bit pattern, at most 2^rules rows, all from partial sums.
    """
    rules = POLICIES[policy]
    patterns = book.groupBy(F.col("failed").bitwiseAND(F.lit(mask(rules)).cast("long")).alias("bits")).count()
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(mask([r])).cast("long").alias("bit")) for r in rules]))
    rows = patterns.withColumn("_r", each).select("bits", "count", "_r.rule", "_r.bit")
    hit = F.col("bits").bitwiseAND(F.col("bit")) != 0
    return rows.groupBy("rule").agg(
        F.sum(F.when(hit, F.col("count")).otherwise(0)).alias("failed"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("count")).otherwise(0)).alias("only_this"),
    )


def keep_good(docs: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The rows of `docs` that pass a policy, with their own columns, whatever their names.

    Null and empty texts have no words and go; a very long text is measured as a whole; repeated rows are judged
    each; an empty table gives an empty one.
    """
    named = docs.toDF(*[f"_in_{k}" for k in range(len(docs.columns))])
    at = {c: f"_in_{k}" for k, c in enumerate(docs.columns)}
    judged = measure(named.withColumn("text", F.col(at["text"])))
    # A generated column is a barrier: the optimizer would else put the measurements into the filter,
    # once for each time that they are mentioned.
    judged = judged.withColumn("_bits", failures()).withColumn("failed", F.explode(F.array("_bits")))
    return judged.where(passes(policy)).select(*[F.col(at[c]).alias(c) for c in docs.columns])
