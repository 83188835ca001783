"""Text functions: names, similarity, masking, SQL safety."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that make a field sensitive, and what the injection check looks for.
SENSITIVE_WORDS = ("password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "private_key", "credit_card", "ssn", "social_security")
DANGEROUS_FUNCTIONS = ("SLEEP", "BENCHMARK", "LOAD_FILE", "INTO OUTFILE", "INTO DUMPFILE")
RISKS = ("LOW", "MEDIUM", "HIGH", "CRITICAL")


def similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance over the greater byte length; 0 if either is empty."""
    longest = F.greatest(F.octet_length(a), F.octet_length(b))
    return F.when((a == "") | (b == ""), 0.0).otherwise(1 - F.levenshtein(a, b) / F.nullif(longest, F.lit(0)))


def snake_case(name: Column) -> Column:
    """camelCase as camel_case."""
    return F.lower(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1_$2"))


def clean_field_name(name: Column) -> Column:
    """Lower case, without the prefixes tbl_ and tab_ and the suffixes _id and _name."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), "^(tbl_|tab_)", ""), "(_id|_name)$", "")


def quoted(text: Column) -> Column:
    """A SQL string literal."""
    return F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("''")), F.lit("'"))


def mask(field: str | Column, value: Column) -> Column:
    """The value of a sensitive field: its first two characters and ****, or **** alone if it has at most
    four; other fields as they are."""
    name = F.lit(field) if isinstance(field, str) else field
    hidden = F.when(F.octet_length(value) <= 4, "****").otherwise(F.concat(F.substring(value, 1, 2), F.lit("****")))
    return F.when(is_sensitive(name), hidden).otherwise(value)


def is_sensitive(name: Column) -> Column:
    """Whether a field name contains a sensitive word."""
    return F.lower(name).rlike("|".join(SENSITIVE_WORDS))


def valid_field_name(name: Column) -> Column:
    """At most 64 letters, digits and underscores, the first no digit."""
    return name.rlike(r"^[\p{L}_][\p{L}\p{N}_]*$") & (F.octet_length(name) <= 64)


def _findings(text: Column, keywords: tuple[str, ...]) -> list[tuple[str, int, Column]]:
    upper = F.upper(text)
    has = lambda c, s: F.contains(c, F.lit(s))
    out = [
        ("comment", 2, has(text, "--") | has(text, "/*") | has(text, "*/") | has(text, "#")),
        ("quote", 2, has(text, "'") | has(text, '"')),
        ("stacked", 3, has(text, ";")),
        ("union", 3, has(upper, "UNION") & has(upper, "SELECT")),
    ]
    out += [(f"function:{f}", 3, has(upper, f)) for f in DANGEROUS_FUNCTIONS]
    return out + [(f"keyword:{k}", 1, has(upper, k)) for k in keywords]


def injection_findings(text: Column, keywords: tuple[str, ...] = ()) -> Column:
    """The names of what looks like SQL injection; `keywords` are further suspicious words, upper case."""
    return F.array_compact(F.array(*[F.when(hit, F.lit(name)) for name, _, hit in _findings(text, keywords)]))


def injection_risk(text: Column, keywords: tuple[str, ...] = ()) -> Column:
    """The greatest risk of the findings, or null without any."""
    rank = F.greatest(*[F.when(hit, level).otherwise(-1) for _, level, hit in _findings(text, keywords)])
    return F.when(rank >= 0, F.element_at(F.array(*map(F.lit, RISKS)), rank + 1))


def valid_parameter(text: Column, keywords: tuple[str, ...] = ()) -> Column:
    """Whether a value may be a parameter: null, or without a finding of high or critical risk."""
    risk = injection_risk(text, keywords)
    return F.coalesce(~risk.isin(*RISKS[2:]), F.lit(True))


def sanitized(text: Column) -> Column:
    """Quotes doubled; --, /*, */ and ; taken out, in this order."""
    out = F.replace(text, F.lit("'"), F.lit("''"))
    for mark in ("--", "/*", "*/", ";"):
        out = F.replace(out, F.lit(mark), F.lit(""))
    return out
