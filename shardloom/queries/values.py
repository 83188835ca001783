"""Predicates, row checks and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import codec, text, values
from ..operators import predicates
from ..shared import bound_batches
from . import query


@query("SELECT doc_id, lang, source FROM documents WHERE lang IN ('en', 'de') AND source LIKE 'src1%' AND n_chars BETWEEN 100 AND 5000 AND source IS NOT NULL AND doc_id <> 5")
def predicate_builder(t):
    w = predicates.where
    made = w("lang", "in", ["en", "de"]) & w("source", "LIKE", "src1%") & w("n_chars", "BETWEEN", (100, 5000)) & w("source", "IS NOT NULL") & w("doc_id", "<>", 5)
    return t.documents.where(made).select("doc_id", "lang", "source")


@query("SELECT p_partkey, b FROM (SELECT p_partkey, p_size, nullif(p_size % 5, 0) AS b FROM part) WHERE b IS NULL AND p_size IN (10, 20, 30)")
def predicate_matching(t):
    parts = t.part.select("p_partkey", "p_size", F.nullif(F.col("p_size") % 5, F.lit(0)).alias("b"))
    return predicates.matching(parts, {"b": None, "p_size": [10, 20, 30]}).select("p_partkey", "b")


_HOLES = "(SELECT p_partkey, nullif(p_size % 5, 0) AS a, CASE WHEN p_partkey % 3 <> 0 THEN p_brand END AS b FROM part)"


def _holes(t):
    return t.part.select("p_partkey", F.nullif(F.col("p_size") % 5, F.lit(0)).alias("a"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_brand")).alias("b"))


@query(f"SELECT * FROM {_HOLES} WHERE a IS NOT NULL AND b IS NOT NULL")
def filter_nulls(t):
    return predicates.without_nulls(_holes(t))


@query(f"SELECT CAST(count(*) AS BIGINT) AS removed FROM {_HOLES} WHERE a IS NULL OR b IS NULL")
def filter_nulls_removed(t):
    return predicates.removed(_holes(t), predicates.without_nulls(_holes(t)))


@query("SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def filter_duplicates(t):
    return predicates.without_duplicates(t.lineitem.select("l_returnflag", "l_linestatus", "l_linenumber"))


@query("SELECT p_brand, p_size, min(p_partkey) AS p_partkey FROM part GROUP BY 1, 2")
def filter_duplicates_by(t):
    return predicates.without_duplicates(t.part.select("p_brand", "p_size", "p_partkey"), ["p_brand", "p_size"])


@query(f"""SELECT p_partkey, CASE WHEN a IS NULL THEN 'null' WHEN a > 3 THEN '' ELSE '' END AS a_issues,
    concat_ws(',', CASE WHEN b IS NULL THEN 'null' END, CASE WHEN strlen(b) > 7 THEN 'length' END) AS b_issues, CASE WHEN b IS NOT NULL THEN 'type' ELSE '' END AS c_issues FROM {_HOLES}""")
def validate_values(t):
    check = lambda c, kind, f: F.concat_ws(",", values.violations(F.col(c), kind, f))
    return _holes(t).select(
        "p_partkey", check("a", T.IntegerType(), values.Field("a", "INTEGER", nullable=False)).alias("a_issues"),
        check("b", T.StringType(), values.Field("b", "VARCHAR", length=7, nullable=False)).alias("b_issues"),
        check("b", T.StringType(), values.Field("b", "INTEGER")).alias("c_issues"),
    )


@query("""SELECT p_partkey, CAST(p_size AS VARCHAR) AS as_int, CASE WHEN p_size % 3 = 0 THEN 'true' WHEN p_size % 3 = 1 THEN 'false' ELSE '2' END AS as_bool,
    CASE WHEN p_size % 5 = 0 THEN 'none' ELSE p_brand END AS as_text FROM part""")
def transform_values(t):
    padded = F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit(" "))
    flag = F.element_at(F.array(F.lit("Yes"), F.lit("0"), F.lit("2")), F.col("p_size") % 3 + 1)
    brand = F.when(F.col("p_size") % 5 != 0, F.col("p_brand"))
    return t.part.select(
        "p_partkey", values.cleaned(padded, values.Field("a", "BIGINT")).alias("as_int"), values.cleaned(flag, values.Field("b", "BOOLEAN")).alias("as_bool"),
        values.cleaned(brand, values.Field("c", "TEXT", default="none"), null_to_default=True).alias("as_text"),
    )


@query("""SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN 'false' ELSE 'true' END AS flag, '''' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '''' AS day,
    'E''\\\\x' || lower(hex(encode(o_orderstatus))) || '''' AS bytes, CASE WHEN o_orderstatus = 'O' THEN 'NULL' ELSE '''' || o_orderstatus || '''''s''' END AS text FROM orders""")
def value_convert(t):
    day = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    owned = F.when(F.col("o_orderstatus") == "O", "null").otherwise(F.concat("o_orderstatus", F.lit("'s")))
    return t.orders.select(
        "o_orderkey", values.converted((F.col("o_custkey") % 2).cast("string"), "TINYINT(1)", "BOOLEAN", "postgresql").target.alias("flag"),
        values.converted(day, "DATETIME", "TEXT", "sqlite").target.alias("day"), values.converted(F.col("o_orderstatus"), "BLOB", "BYTEA", "postgresql").target.alias("bytes"),
        values.converted(owned, "VARCHAR", "VARCHAR", "mysql").target.alias("text"),
    )


@query("""SELECT c_custkey, round(1 - levenshtein(c_name, 'Customer#000000042') / greatest(strlen(c_name), 18), 6) AS similarity FROM customer""")
def similarity(t):
    return t.customer.select("c_custkey", F.round(text.similarity(F.col("c_name"), F.lit("Customer#000000042")), 6).alias("similarity"))


@query("""SELECT page_id, lower(regexp_replace(url, '([a-z0-9])([A-Z])', '\\1_\\2', 'g')) AS snake, regexp_replace(regexp_replace(lower('tbl_' || page_id || '_name'), '^(tbl_|tab_)', ''), '(_id|_name)$', '') AS clean FROM pages""")
def snake_case(t):
    name = F.concat(F.lit("tbl_"), F.col("page_id").cast("string"), F.lit("_name"))
    return t.pages.select("page_id", text.snake_case(F.col("url")).alias("snake"), text.clean_field_name(name).alias("clean"))


@query("SELECT c_custkey, substr(c_name, 1, 2) || '****' AS password, '****' AS api_key, c_name AS name FROM customer")
def mask_values(t):
    return t.customer.select(
        "c_custkey", text.mask("user_password", F.col("c_name")).alias("password"), text.mask("API_KEY", F.substring("c_name", 1, 4)).alias("api_key"), text.mask("name", F.col("c_name")).alias("name")
    )


_INJECTION = """concat_ws(',', CASE WHEN contains(text, '--') OR contains(text, '/*') OR contains(text, '*/') OR contains(text, '#') THEN 'comment' END,
    CASE WHEN contains(text, '''') OR contains(text, '"') THEN 'quote' END, CASE WHEN contains(text, ';') THEN 'stacked' END,
    CASE WHEN contains(upper(text), 'UNION') AND contains(upper(text), 'SELECT') THEN 'union' END, CASE WHEN contains(upper(text), 'SLEEP') THEN 'function:SLEEP' END,
    CASE WHEN contains(upper(text), 'BENCHMARK') THEN 'function:BENCHMARK' END, CASE WHEN contains(upper(text), 'LOAD_FILE') THEN 'function:LOAD_FILE' END,
    CASE WHEN contains(upper(text), 'INTO OUTFILE') THEN 'function:INTO OUTFILE' END, CASE WHEN contains(upper(text), 'INTO DUMPFILE') THEN 'function:INTO DUMPFILE' END)"""


@query(f"""SELECT doc_id, {_INJECTION} AS findings, CASE WHEN contains({_INJECTION}, 'stacked') OR contains({_INJECTION}, 'union') OR contains({_INJECTION}, 'function') THEN 'CRITICAL'
    WHEN {_INJECTION} <> '' THEN 'HIGH' END AS risk FROM documents""")
def injection_findings(t):
    c = F.col("text")
    return t.documents.select("doc_id", F.concat_ws(",", text.injection_findings(c)).alias("findings"), text.injection_risk(c).alias("risk"))


@query("""SELECT doc_id, md5(replace(replace(replace(replace(replace(text, '''', ''''''), '--', ''), '/*', ''), '*/', ''), ';', '')) AS digest FROM documents""")
def sanitize_text(t):
    return t.documents.select("doc_id", F.md5(text.sanitized(F.col("text")).cast("binary")).alias("digest"))


@query("""SELECT c_custkey, '''' || replace(c_name || '''s', '''', '''''') || '''' AS literal, true AS valid, false AS invalid FROM customer""")
def escape_literal(t):
    key = F.concat(F.lit("c_"), F.col("c_custkey").cast("string"))
    return t.customer.select("c_custkey", text.quoted(F.concat("c_name", F.lit("'s"))).alias("literal"), text.valid_field_name(key).alias("valid"), text.valid_field_name(F.concat(F.lit("1"), key)).alias("invalid"))


@query("SELECT c_custkey, to_base64(encode(c_name)) AS coded, c_name AS decoded, lower(hex(encode(c_name))) AS hexed FROM customer")
def base64_roundtrip(t):
    coded = F.base64(F.encode("c_name", "UTF-8"))
    return t.customer.select("c_custkey", coded.alias("coded"), F.decode(F.unbase64(coded), "UTF-8").alias("decoded"), F.lower(F.hex(F.encode("c_name", "UTF-8"))).alias("hexed"))


@query("SELECT doc_id, true AS same, strlen(text) > 1024 AS packed, true AS deciphered FROM documents")
def compress_roundtrip(t):
    bound_batches(t.spark)
    packed = F.octet_length("text") > 1024
    out = t.documents.withColumn("small", codec.compress(F.col("text"))).withColumn("secret", codec.shift_encrypt(F.col("text"), "key"))
    back = codec.decompress(F.col("small"), packed)
    return out.select("doc_id", (back == F.col("text")).alias("same"), packed.alias("packed"), (codec.shift_decrypt(F.col("secret"), "key") == F.col("text")).alias("deciphered"))


@query(f"SELECT doc_id, {_INJECTION} = '' AS valid FROM documents")
def valid_parameters(t):
    return t.documents.select("doc_id", text.valid_parameter(F.col("text")).alias("valid"))


@query("SELECT doc_id, true AS same, strlen(text) > 1024 AS moved FROM documents")
def compress_columns(t):
    packed = codec.packed_columns(t.documents.select("doc_id", "text", F.col("text").alias("kept")), ["text"])
    moved = packed.withColumn("moved", F.col("_c_text").isNotNull() & F.col("text").isNull())
    return codec.unpacked_columns(moved, ["text"]).select("doc_id", (F.col("text") == F.col("kept")).alias("same"), "moved")
