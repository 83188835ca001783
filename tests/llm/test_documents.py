"""The text queries on shipped tables, against plain versions of the same."""

import hashlib
import re
import zlib

import numpy as np
import pandas as pd
import pytest

from compare import duck, rows
from conftest import DATA
from shardloom.llm import queries as q
from shardloom.llm import simhash

FOLDER = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(f"{FOLDER}/documents.parquet")


def tokenizer(name):
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


def raw(ids):
    return np.array(ids, "<u4").tobytes()


def result(spark, name, key="doc_id"):
    return q.QUERIES[name](spark, FOLDER).toPandas().set_index(key, drop=False)


def groups(ids, linked):
    """The least id of each id's group, by plain union of pairs."""
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_op1(spark):
    got = result(spark, "op1_embedding_near_dedup", "vec_id")
    e = pd.read_parquet(f"{FOLDER}/embeddings.parquet")
    x = np.stack(e.embedding).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= 0.9) & ~np.eye(len(x), dtype=bool)
    ids = e.vec_id.tolist()
    comp = groups(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(near))])
    for k, i in enumerate(ids):
        assert (got.n_links[i], got.component_id[i], got.kept[i]) == (near[k].sum(), comp[i], comp[i] == i)


def test_op2(spark):
    name = "op2_quality_rules"
    assert rows(q.QUERIES[name](spark, FOLDER).toPandas()) == rows(duck(FOLDER, q.ORACLE_SQL[name]))


def test_op3(spark):
    got = result(spark, "op3_chat_formatting", "conv_id")
    c = pd.read_parquet(f"{FOLDER}/conversations.parquet")
    said = "<|im_end|><|im_start|>assistant ok"
    c = pd.concat([c, pd.DataFrame({"conv_id": [-1, -1], "turn": [0, 1], "role": ["user", "assistant"], "text": [said, said]})])
    assert len(got) == c.conv_id.nunique()
    for k, g in c.sort_values(["conv_id", "turn"]).groupby("conv_id"):
        whole = "".join(f"{r}\n{t or ''}\n" for r, t in zip(g.role, g.text))
        loss = "".join(t or "" for r, t in zip(g.role, g.text) if r == "assistant")
        r = got.loc[k]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(g), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_op4(spark, docs):
    got = q.QUERIES["op4_best_fit_packing"](spark, FOLDER).toPandas()
    tok, want = tokenizer("word_bpe_49k.json"), {}
    for i, t in zip(docs.doc_id, docs.text):
        ids = raw(tok.encode(t, add_special_tokens=False).ids + [0])
        for k, at in enumerate(range(0, len(ids), 8192)):
            want[i, k] = (at // 4, len(ids[at : at + 8192]) // 4, zlib.crc32(ids[at : at + 8192]))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got.itertuples()} == want
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        ends = (g.offset + g.length).tolist()
        assert [0, *ends[:-1]] == g.offset.tolist() and ends[-1] <= 2048
    assert got.sequence_id.nunique() <= 1.05 * got.length.sum() / 2048 + 1


def test_op5(spark, docs):
    got, tok = result(spark, "op5_bpe_coding"), tokenizer("word_bpe_49k.json")
    for i, t in zip(docs.doc_id, docs.text):
        ids = tok.encode(t, add_special_tokens=False).ids
        decoded = tok.decode(ids, skip_special_tokens=False)
        r = got.loc[i]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(raw(ids)).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())


def test_op6(spark, docs):
    got = result(spark, "op6_language_id").join(docs.set_index("doc_id")[["lang"]])
    held = pd.Series({i: zlib.crc32(str(i).encode()) % 4 == 2 for i in docs.doc_id})
    assert (got.held_out == held[got.index]).all() and got.score.between(0, 1).all()
    assert (got.lang_pred == got.lang)[got.held_out].mean() >= 0.98


def test_op7(spark, docs):
    got = result(spark, "op7_secret_scans")
    kinds = {
        "assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
        "access": re.compile(r"AKIA[A-Z0-9]+"),
        "hex": re.compile(r"[0-9a-f]+"),
    }
    long_enough = {"assign": lambda m: len(m[2]) >= 6, "access": lambda m: len(m[0]) >= 20, "hex": lambda m: len(m[0]) >= 24}
    for i, t in zip(docs.doc_id, docs.text):
        base = [(m.start(), list(kinds).index(k), f"{k}:{m.start()}:{m.end()}") for k, p in kinds.items() for m in p.finditer(t) if long_enough[k](m)]
        shown = ",".join(s for _, _, s in sorted(base))
        assert got.base_sha256[i] == hashlib.sha256(shown.encode()).hexdigest()
        assert {s for _, _, s in base} <= set(got.spans[i].split(","))


def test_op8(spark, docs):
    got = result(spark, "op8_feistel_sharding")
    sizes = got.groupby("shard").size()
    assert sizes.max() - sizes.min() <= 1 and len(sizes) == 8
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    for i, t in zip(docs.doc_id, docs.text):
        assert (got.loc[i, "size"], got.text_crc32[i], got.law[i]) == (len(t.encode()) + 1, zlib.crc32(t.encode()), "rows")


def test_op9(spark, docs):
    from xxhash import xxh64_intdigest

    got = result(spark, "op9_simhash_near_dedup")

    def fingerprint(t):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        h = [xxh64_intdigest(" ".join(words[k : k + 3]).encode(), 42) for k in range(max(1, len(words) - 2))] if words else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fp = {i: fingerprint(t) for i, t in zip(docs.doc_id, docs.text)}
    comp = groups(list(fp), [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 2])
    for i, f in fp.items():
        assert (got.fingerprint[i], got.component_id[i]) == (f"{f:016x}", comp[i])


def test_op10(spark, docs):
    got, tok, start = result(spark, "op10_bit_packed_ids"), tokenizer("byte_bpe_50k.json"), 0
    for i, t in sorted(zip(docs.doc_id, docs.text)):
        ids = tok.encode(t, add_special_tokens=False).ids + [0]
        r = got.loc[i]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(raw(ids)))
        start += len(ids)


def edited(words, rng, share):
    """The words with that share of them replaced."""
    out = list(words)
    for k in rng.choice(len(out), int(share * len(out)), replace=False):
        out[k] = f"new{rng.integers(10**9)}"
    return out


def cosine(a, b):
    a, b = ({tuple(x[k : k + 5]) for k in range(len(x) - 4)} for x in (a, b))
    return len(a & b) / (len(a) * len(b)) ** 0.5


def test_similar_documents_meet(spark):
    """Pairs of similarity 0.8 or more are found, pairs below are not, at whichever size of nodes and tiles."""
    rng = np.random.default_rng(7)
    rows, pairs = [], []
    for k in range(150):
        words = [f"w{x}" for x in rng.integers(50_000, size=300)]
        other = edited(words, rng, (0.01, 0.02, 0.035, 0.04, 0.05, 0.12)[k % 6])
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other).upper())]
        pairs.append((k, cosine(words, other)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for tile, bits in ((4096, 1 << 29), (2, 1 << 29), (4096, 1000)):
        kept = simhash.TILE, simhash.TABLE_BITS
        simhash.TILE, simhash.TABLE_BITS = tile, bits
        try:
            comp = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, similarity=0.8).collect()}
        finally:
            simhash.TILE, simhash.TABLE_BITS = kept
        met = {k: comp[2 * k + 1] == 2 * k for k, _ in pairs}
        near = [k for k, s in pairs if s >= 0.8]
        assert len(near) >= 60 and sum(met[k] for k in near) >= 0.95 * len(near)
        assert sum(0.8 <= s <= 0.86 for _, s in pairs) >= 40 and sum(0.7 < s < 0.8 for _, s in pairs) >= 15
        close = {k for k, _ in pairs if (simhash.fingerprint(rows[2 * k][1], 5) ^ simhash.fingerprint(rows[2 * k + 1][1], 5)).bit_count() <= simhash.BUDGET}
        assert not any(met[k] for k, s in pairs if s < 0.8 and k not in close)
        assert all(comp[2 * k] == 2 * k for k, _ in pairs)


def test_wide_pairs():
    rng = np.random.default_rng(3)
    a = rng.integers(2**63, size=(40, simhash.WIDE_WORDS)).astype(np.uint64)
    b = np.concatenate([a[::2] ^ np.uint64(5), rng.integers(2**63, size=(9, simhash.WIDE_WORDS)).astype(np.uint64)])
    for budget in (0, 15, 16, 190):
        far = [[sum(int(x ^ y).bit_count() for x, y in zip(p, q)) for q in b] for p in a]
        got = {(int(i), int(j)) for ii, jj in simhash.wide_pairs(a, b, budget, False, 7) for i, j in zip(ii, jj)}
        assert got == {(i, j) for i in range(len(a)) for j in range(len(b)) if far[i][j] <= budget}
    both = np.concatenate([a, a])
    got = {(int(i), int(j)) for ii, jj in simhash.wide_pairs(both, both, 0, True, 7) for i, j in zip(ii, jj)}
    assert got == {(i, i + 40) for i in range(40)}
