"""The pipeline on a shipped table against a plain version of its stages."""

import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from conftest import DATA
from shardloom.llm import langid, packing, secret_scan, simhash

FOLDER = f"{DATA}/sf0.001"


def good(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:]))
    again = {p + k for p in range(len(words) - 2) for k in range(3) if windows[tuple(words[p : p + 3])] > 1}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    chars = sum(map(len, words))
    n = len(words)
    return (
        n >= 50 and 100 * len(again) <= 50 * n and 10 * len(re.findall(r"[#*$%&|<>]", text)) <= n and 10 * (len(lines) - len(set(lines))) <= 5 * len(lines)
        and 25 * n <= 10 * chars and chars <= 12 * n
    )


def check(spark, folder, docs):
    """`run` over the documents of a folder against the same stages by plain loops; `docs` has its different (doc_id, text) pairs,
    null ids last. Returns what was kept before packing."""
    import public_tokenizers
    from tokenizers import Tokenizer

    frame = spark.read.parquet(f"{folder}/documents.parquet")
    model = langid.fit(frame.where(langid.in_fold(frame["doc_id"]) != 2))
    kept = [(i, t) for i, t in docs if t and (p := model.predict(t))[0] != "und" and p[1] >= 0.5 and good(t)]
    fp = [simhash.fingerprint(t, 5) for _, t in kept]

    def shingles(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()

    sets = [shingles(t) for _, t in kept]
    root = list(range(len(kept)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(kept)):
        for b in range(a + 1, len(kept)):
            shared = len(sets[a] & sets[b])
            if (fp[a] ^ fp[b]).bit_count() <= simhash.BUDGET or (shared and shared >= 0.8 * (len(sets[a]) * len(sets[b])) ** 0.5 - 1e-9):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    kept = [(i, secret_scan.redact(t, secret_scan.spans(t))) for k, (i, t) in enumerate(kept) if find(k) == k]
    tok, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), {}
    for i, t in kept:
        ids = np.array(tok.encode(t, add_special_tokens=False).ids + [0], "<u4").tobytes()
        for k, at in enumerate(range(0, len(ids), 4 * packing.CAPACITY)):
            part = ids[at : at + 4 * packing.CAPACITY]
            want[i, k] = (at // 4, len(part) // 4, zlib.crc32(part))
    rows = corpus_pipeline.run(spark, folder).collect()
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want and len(rows) == len(want)
    for _, g in pd.DataFrame([r.asDict() for r in rows]).sort_values("offset").groupby("sequence_id"):
        ends = (g.offset + g.length).tolist()
        assert [0, *ends[:-1]] == g.offset.tolist() and ends[-1] <= packing.CAPACITY
    return kept


def test_pipeline(spark):
    docs = pd.read_parquet(f"{FOLDER}/documents.parquet")
    assert len(check(spark, FOLDER, sorted(zip(docs.doc_id, docs.text)))) > 50


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_pipeline_on_odd_rows(spark, tmp_path, monkeypatch, most):
    """Nulls, repeated rows, a document without an id, a very long one, and columns named like those of the stages."""
    monkeypatch.setattr(simhash, "BROADCAST_ROWS", most)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").where("doc_id < 80")
    own = " ".join(f"the{k} and of{k % 7} that w{k}" for k in range(60))
    long = " ".join(f"und der{k} nicht{k % 11} die" for k in range(20_000))
    odd = [(None, own, "en"), (900, None, "en"), (901, "", None), (902, "12 34", "de"), (903, long, "de")]
    frame = docs.select("doc_id", "text", "lang").unionAll(spark.createDataFrame(odd, "doc_id long, text string, lang string"))
    frame = frame.unionAll(docs.where("doc_id in (3, 4, 5)").select("doc_id", "text", "lang"))
    for name in ("fp", "wide", "size", "root", "cid", "score", "lang_pred", "failed", "n_words", "length", "rank", "_tie"):
        frame = frame.withColumn(name, F.lit("x"))
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    pairs = sorted({(r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect()}, key=lambda p: (p[0] is None, p[0] or 0))
    kept = {i for i, _ in check(spark, str(tmp_path), pairs)}
    assert not kept & {900, 901, 902} and len(kept) > 20


def test_stages_keep_the_columns(spark):
    frame = spark.read.parquet(f"{FOLDER}/documents.parquet")
    empty = frame.limit(0)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, empty, FOLDER)
        assert out.count() == 0
        if k + 1 < len(corpus_pipeline.STAGES):
            assert out.dtypes == frame.dtypes
