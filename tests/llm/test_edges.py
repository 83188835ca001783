"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for each operator."""

import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shardloom.llm import binary_output, bpe, chat, components, embedding_dedup, langid, packing, quality, secret_scan, sharding, simhash, tokens

HARD = [
    "", "\n", " ", "a", "a b", " a  b ", "a\n\nb c\td", "x\r\ny", "Σίσυφος ΟΔΟΣ", "İstanbul STRASSE ß ſ K ŉ", "café é", "foo<|endoftext|>bar <|endoftext|> <|startoftext|>x",
    "it's WE'LL they'RE 'S", "12 345 a1b2", "###$$$ ***x", "日本語 テスト 한국어", "🙂🙂 ok", "\x1c\x1d a\x1cb", "a \n b", "a\n b", "line\nline2\n", "\x00a \x00", "×÷ µ ª º", "ǅ Ⱥ Ⱦ",
    "a" * 300 + " " + "ab" * 200, "don't  stop\n\n\nnow",
]
SCHEMA = "doc_id long, text string, lang string, fp long, failed string, n_words string, spans int, length int, component_id string"


def path(name):
    import public_tokenizers

    return public_tokenizers.path(name)


@pytest.fixture(scope="module")
def docs(spark):
    """Null and empty texts, copies, a repeated row, a null id, a very long text, and columns named like results."""
    long = " ".join(random.Random(1).choice(["alpha", "beta", "gamma", "delta"]) for _ in range(60_000))
    texts = [(1, None), (2, ""), (3, "one two three"), (4, "one two three"), (4, "one two three"), (5, long), (None, "four five six seven"), (6, "   \n\t "), (7, "x" * 200_000)]
    return spark.createDataFrame([(i, t, "en", 1, "f", "w", 2, 3, "c") for i, t in texts], SCHEMA)


def by_id(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_hard_texts_have_the_library_s_ids():
    from tokenizers import Tokenizer

    rng = random.Random(2)
    texts = HARD + ["".join(rng.choice("aB 'sétßΣ\n\t.#9é <|>日́ İ ") for _ in range(rng.randint(0, 40))) for _ in range(500)]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        tok = Tokenizer.from_file(path(name))
        want = [np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
        assert tokens.encoder(path(name)).ids(texts) == want
    tok = Tokenizer.from_file(path("word_bpe_49k.json"))
    for t, (ids, decoded) in zip(texts, bpe.word_bpe(path("word_bpe_49k.json")).encode(texts)):
        want = tok.encode(t, add_special_tokens=False).ids
        assert ids == np.array(want, "<u4").tobytes() and decoded.decode() == tok.decode(want, skip_special_tokens=False)


def test_parts_of_texts_have_the_library_s_ids(monkeypatch):
    """Groups smaller than a text, cut between words; the ids of all texts together."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokens, "GROUP_BYTES", 50)
    rng = random.Random(9)
    texts = ["".join(rng.choice(["the", " and", "\n", "  ", " don't", "<|endoftext|>", " Ünder", "12 ", "é", "×"]) for _ in range(rng.randint(0, 300))) for _ in range(60)] + [None, ""]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        tok = Tokenizer.from_file(path(name))
        flat, at = tokens.PieceEncoder(path(name), 100).encode(pa.array(["left out", *texts])[1:])
        assert [flat[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [tok.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_masks_by_plain_characters(spark):
    """Ids, mask and ranges against the library's own offsets, of whole and of cut characters."""
    from tokenizers import AddedToken, Tokenizer

    rng = random.Random(11)
    rows = [(c, k, rng.choice(["user", "assistant"]), "".join(rng.choice(["日本", " the", "\n\n", "é", "🙂", "a<|im_end|>", "\\", " x "]) for _ in range(rng.randint(0, 12)))) for c in range(40) for k in range(4)]
    tok = Tokenizer.from_file(path("byte_bpe_50k.json"))
    tok.add_special_tokens([AddedToken(c, normalized=False, special=True) for c in (chat.HEAD, chat.SEP, chat.TAIL)])
    got = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), path("byte_bpe_50k.json")).collect()
    assert len(got) == 40
    for r in got:
        turns = [(role, text) for c, _, role, text in rows if c == r["conv_id"]]
        shown, at, inside = "", [], []
        for role, text in turns:
            shown += f"{chat.HEAD}{role}{chat.SEP}"
            if role == "assistant" and text:
                inside += range(len(shown), len(shown) + len(chat.escape(text)))
                at.append((len(shown), len(shown) + len(chat.escape(text))))
            shown += chat.escape(text) + chat.TAIL
        want = tok.encode(shown, add_special_tokens=False)
        covered = set(inside)
        assert r["formatted"] == shown and r["ids"] == want.ids
        assert r["loss_mask"] == [not covered.isdisjoint(range(a, b)) for a, b in want.offsets]
        assert [tuple(x) for x in r["loss_ranges"]] == at


def test_long_and_short_words_agree():
    coder = bpe.word_bpe(path("word_bpe_49k.json"))
    for word in (b"a", b"ab" * 20, b"thething" * 5, bytes(range(97, 123)) * 2):
        assert coder._long(word).tolist() == coder._same_length([word])[0].tolist()


def test_cache_is_bounded():
    enc = tokens.PieceEncoder(path("word_bpe_49k.json"))
    enc.pieces.entries = enc.words.entries = 50
    for k in range(20):
        enc.ids([" ".join(f"w'{k}x{i}" for i in range(40))])
    assert max(len(c.new) for c in (enc.pieces, enc.words)) <= 130 and max(len(c.old) for c in (enc.pieces, enc.words)) <= 130


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [0.0, 3.0]), (8, [0.0, 3.0]), (9, [1.0, 0.0, 0.0]), (10, []), (None, [1.0, 0.0])]
    df = spark.createDataFrame([(i, v, "b", 1) for i, v in rows], "vec_id long, embedding array<float>, block string, dim int")
    got = by_id(embedding_dedup.near_duplicate_vectors(df, 0.9))
    alone = [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10)]
    assert got == sorted([(1, 1, 1, True), (2, 1, 1, False), *alone, (None, 0, None, False)], key=repr)
    assert embedding_dedup.near_duplicate_vectors(df.limit(0)).count() == 0


def test_vectors_of_one_id(spark):
    """Each of an id's different vectors links; an unusable one takes nothing from the others."""
    nan = float("nan")
    rows = [(1, [1.0, 0.0]), (1, [2.0, 5.0]), (1, [2.0, 5.0]), (2, [1.0, 0.0]), (3, [4.0, 10.0]), (4, [nan, 0.0]), (4, [0.0, -1.0]), (5, [0.0, -2.0]), (6, [-1.0, 0.0]), (6, [-1.0, 0.01])]
    got = by_id(embedding_dedup.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 0.99))
    assert got == [(1, 2, 1, True), (2, 1, 1, False), (3, 1, 1, False), (4, 1, 4, True), (5, 1, 4, False), (6, 0, 6, True)]


def test_equal_vectors_by_all_pairs(spark):
    """Large classes of equal vectors, scaled and opposite ones, repeated rows, and ids with several vectors."""
    rng = np.random.default_rng(21)
    base = rng.normal(size=(6, 8)).round(3)
    rows = [(k, (base[k % 4] * (1, 2, -1)[k % 3]).tolist()) for k in range(120)] + [(200 + k, (base[4] + 0.05 * rng.normal(size=8)).tolist()) for k in range(40)]
    rows += [(k, base[4].tolist()) for k in (0, 1, 200, 201)] + [(300, base[5].tolist()), (301, base[5].tolist()), (301, base[5].tolist()), (302, base[5].tolist()), (302, (-base[5]).tolist())]
    each = sorted({(i, tuple(v)) for i, v in rows})
    x = np.array([v for _, v in each])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = [i for i, _ in each]
    links, root = dict.fromkeys(ids, 0), {i: i for i in ids}
    for p, q in zip(*np.nonzero(x @ x.T >= 0.9)):
        if ids[p] != ids[q]:
            links[ids[p]] += 1
            a, b = (root[ids[z]] for z in (p, q))
            root = {i: min(a, b) if r in (a, b) else r for i, r in root.items()}
    got = by_id(embedding_dedup.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), 0.9))
    assert got == sorted([(i, links[i], root[i], root[i] == i) for i in links], key=repr)


def test_very_many_equal_vectors(spark):
    """100,000 copies of one vector are one class: no pair of them is compared."""
    import time

    v = F.array(*[F.lit(float(k)) for k in range(1, 65)])
    df = spark.range(100_000).select(F.col("id").alias("vec_id"), v.alias("embedding"))
    began = time.time()
    got = embedding_dedup.near_duplicate_vectors(df, 0.9).groupBy("n_links", "component_id").count().collect()
    assert [tuple(r) for r in got] == [(99_999, 0, 100_000)] and time.time() - began < 60


def test_vectors_of_thousands_of_dimensions(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(20, 3000))
    x[1] = x[0] + 0.1 * rng.normal(size=3000)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    assert by_id(embedding_dedup.near_duplicate_vectors(df, 0.9).where("n_links > 0")) == [(0, 1, 0, True), (1, 1, 0, False)]


def test_blocks_lose_no_pair_and_skip_far_ones(spark, monkeypatch):
    """Clustered vectors in many blocks against all pairs, with full and crowded leaves; far blocks are not compared."""
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    rng = np.random.default_rng(8)
    centre = np.linalg.qr(rng.normal(size=(24, 24)))[0]
    x = np.concatenate([centre[rng.integers(8, size=540)] + rng.normal(size=(540, 24)) * 0.06, np.repeat(centre[:1] - centre[9:10], 60, 0)]).astype(np.float32)
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.9) & ~np.eye(len(x), dtype=bool)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
    for leaves in (4096, 4):
        monkeypatch.setattr(embedding_dedup, "LEAVES", leaves)
        got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.near_duplicate_vectors(df, 0.9).collect()}
        assert got == {k: int(n) for k, n in enumerate(near.sum(1))}
    monkeypatch.setattr(embedding_dedup, "LEAVES", 4096)
    fine = embedding_dedup.equal_vectors(df)[1]
    own, pairs = embedding_dedup.block_pairs(fine, embedding_dedup.principal_axes(fine), 0.9)
    blocks = own.select("block").distinct().count()
    assert blocks >= 30 and pairs.count() < 0.6 * blocks * (blocks + 1) / 2


def test_bounds_lose_no_pair():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 40))
    x[100:160] = x[:60] + rng.normal(size=(60, 40)) * 0.3
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    axes = np.linalg.eigh(x.T @ x)[1][:, ::-1]
    found = {(int(i), int(j)) for a, b in embedding_dedup.close_pairs(x, x, axes, 0.9, True) for i, j in zip(a, b)}
    assert found == {(i, j) for i in range(300) for j in range(i + 1, 300) if x[i] @ x[j] >= 0.9} and found


def test_quality(spark, docs):
    got = {(r["doc_id"], r["n_words"]): r for r in quality.ledger(docs).collect()}
    assert got[5, 60_000]["n_repeat_words"] == 60_000 and got[1, 0]["failed"] & 1 and got[2, 0]["n_lines"] == 0
    assert quality.ledger(docs.limit(0)).count() == 0 and quality.keep_good(docs).columns == docs.columns
    text = "a b c a b c d\nx\n\nx\n# & y"
    one = quality.ledger(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (one["n_words"], one["n_symbols"], one["n_lines"], one["n_dup_lines"], one["n_repeat_words"], one["word_chars"]) == (12, 2, 4, 1, 6, 12)


def test_quality_at_the_ends_of_texts(spark, tmp_path):
    """The letter f and every white space at a text's ends, against the SQL."""
    from compare import duck, rows
    from shardloom.llm import queries

    blanks = [*" \t\n\x0b\x0c\r", "\x0c f\x0c"]
    texts = ["f", "ff", "f a b f", "f from the leaf", "for a b for a b for", "a b f\x0ca b f", "fff\nfff", "\x0c", *[e + t + e for e in blanks for t in ("", "f", "a b c a b c", "for all for all for all f")]]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"file://{tmp_path}/d/documents.parquet")
    next((tmp_path / "d" / "documents.parquet").glob("part-*.parquet")).rename(tmp_path / "documents.parquet")
    name = "op2_quality_rules"
    got = queries.QUERIES[name](spark, f"file://{tmp_path}").toPandas()
    assert rows(got) == rows(duck(tmp_path, queries.ORACLE_SQL[name]))
    assert got.set_index("doc_id").n_words[[0, 2, 7]].tolist() == [1, 4, 0]


def test_policies_and_ablations(spark, docs):
    book = quality.ledger(docs)
    kept = quality.apply_policies(book).agg(*[F.count_if(f"kept_{p}") for p in quality.POLICIES]).first()
    assert list(kept) == sorted(kept, reverse=True)
    for r in quality.ablations(book).collect():
        bit = quality.mask([r["rule"]])
        rows = [b["failed"] & quality.mask(quality.POLICIES[quality.CURRENT]) for b in book.collect()]
        assert (r["failed"], r["only_this"]) == (sum(bool(b & bit) for b in rows), sum(b == bit for b in rows))


def test_chat(spark):
    rows = [(1, 2, "assistant", " <|im_sep|>\\<|x \n"), (1, 1, "user", None), (1, None, None, "first"), (1, 2, "assistant", ""), (None, 0, "assistant", "lone\\"), (2, 0, "user", "é" * 5), (3, 0, "assistant", "<"), (3, 0, "assistant", "<")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    made = chat.format_conversations(df, path("byte_bpe_50k.json"))
    got = {r["conv_id"]: r for r in made.collect()}
    assert chat.parse(got[1]["formatted"]) == [("", "first"), ("user", ""), ("assistant", ""), ("assistant", " <|im_sep|>\\<|x \n")]
    back = {r["conv_id"]: r for r in chat.read_back(made, path("byte_bpe_50k.json")).collect()}
    assert {k: r["loss_chars"] for k, r in back.items()} == {1: len(" <|im_sep|>\\<|x \n"), None: 5, 2: 0, 3: 2}
    assert got[2]["loss_ranges"] == [] and chat.format_conversations(df.limit(0), path("byte_bpe_50k.json")).count() == 0


def test_packing(spark, docs):
    got = packing.pack_documents(docs, path("word_bpe_49k.json"), 64).toPandas()
    assert got.groupby("sequence_id").length.sum().max() <= 64 and (got.doc_id.isna().sum(), (got.doc_id == 4).sum()) == (1, 2)
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert [0, *(g.offset + g.length).tolist()[:-1]] == g.offset.tolist()
    assert packing.pack_documents(docs.limit(0), path("word_bpe_49k.json")).count() == 0


def test_plan_is_best_fit():
    rng = random.Random(4)
    lengths = sorted((rng.randint(1, 100) for _ in range(400)), reverse=True)
    rooms: list[int] = []
    for n in lengths:
        fit = [k for k, r in enumerate(rooms) if r >= n]
        k = min(fit, key=lambda k: rooms[k]) if fit else len(rooms)
        if k == len(rooms):
            rooms.append(100)
        rooms[k] -= n
    plan = packing.plan_best_fit({n: lengths.count(n) for n in set(lengths)}, 100)
    used = {p[3] + k // p[4] for p in plan for k in range(p[2] - p[1])}
    assert len(used) == len(rooms) and packing.plan_best_fit({}, 100) == []


def test_coding(spark, docs):
    got = {(r["doc_id"], r["n_tokens"] == 0) for r in bpe.digest_documents(docs, path("word_bpe_49k.json")).collect()}
    assert {(1, True), (2, True), (6, True), (4, False), (None, False)} <= got
    assert bpe.encode_documents(docs.limit(0), path("word_bpe_49k.json")).count() == 0


def test_languages(spark, docs):
    rng = random.Random(5)
    words = {"en": ["the", "and", "with", "that"], "de": ["der", "und", "nicht", "über"]}
    rows = [(k, " ".join(rng.choice(words[lang]) for _ in range(20)), lang) for k, lang in enumerate(["en", "de"] * 40)]
    rows += [(900, None, "en"), (901, "12 34 !", "de"), (None, "the and the", "en"), (902, "und " * 50_000, None)]
    df = spark.createDataFrame([(*r, 0.1) for r in rows], "doc_id long, text string, lang string, score double")
    got = {r["doc_id"]: r for r in langid.learn_and_identify(df).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang in rows[:80]) and got[902]["lang_pred"] == "de"
    assert (got[900]["lang_pred"], got[901]["lang_pred"], got[900]["score"]) == ("und", "und", 0.0) and got[None]["held_out"] is False
    assert {r["lang_pred"] for r in langid.learn_and_identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.learn_and_identify(df.limit(0)).count() == 0 and langid.keep_identified(df).columns == df.columns


def test_every_language_is_learned(spark):
    """As many languages as there are, however rare; most weights are zero all the same."""
    rng = random.Random(13)
    names = [f"l{k}" for k in range(70)]
    words = {n: ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(6)] for n in names}
    rows = [(j, " ".join(rng.choice(words[n]) for _ in range(25)), n) for j, n in enumerate(names * 6 + names[:5] * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df)
    assert model.languages == sorted(names)
    assert sum(model.predict(t)[0] == n for _, t, n in rows) >= 0.97 * len(rows)
    seen = np.zeros(1 << langid.HASH_BITS, bool)
    for _, t, _ in rows:
        seen[langid.counts(t)[0]] = True
    assert len(model.weights) <= 0.5 * seen.sum() * len(names) and (model.weights != 0).all()
    fewer = langid.fit(df, langid.Settings(most_weights=70 << 10))
    assert fewer.bits == 10 and fewer.languages == sorted(names) and sum(fewer.predict(t)[0] == n for _, t, n in rows) >= 0.9 * len(rows)


def test_any_number_of_labels(spark):
    """600 labels of one row each, most of them junk: the fit goes on, and the two real languages are told."""
    rows = [(k, "the and with that this" if k % 2 else "der und nicht auch wir", "en" if k % 2 else "de") for k in range(200)]
    rows += [(1000 + k, f"zq{k} xx{k * 7} qqq", f"junk{k}") for k in range(600)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.languages) == 602 and model.predict("the and with that this")[0] == "en"
    few = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), langid.Settings(most_rows=100))
    assert 40 <= len(few.languages) <= 300


def test_one_label(spark):
    df = spark.createDataFrame([(k, "the and with", "en") for k in range(20)], "doc_id long, text string, lang string")
    assert langid.fit(df).predict("the words") == ("en", 1.0)


def test_fit_by_plain_loops(spark):
    """Weights, temperature's logits and scores equal those of the same method written out number by number."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 60")
    s = langid.Settings(most_weights=4 << 8, epochs=2)
    model = langid.fit(docs, s)
    frame = docs.where("lang is not null and text is not null").toPandas().sort_values(["doc_id", "lang"])
    names, dim = sorted(set(frame.lang)), 1 << model.bits
    grams = []
    for text in frame.text:
        folded = re.sub(r"[\s\d]+", " ", f" {text.lower()} ")
        seen = {}
        for at in range(len(folded)):
            h = 0
            for n, c in enumerate(folded[at : at + 3], 1):
                h = (h + ord(c) + n) * langid._MULT[n - 1] % 2**64
                h ^= h >> 29
                seen[h >> (64 - model.bits)] = seen.get(h >> (64 - model.bits), 0) + 1
        grams.append(seen)
    df = {}
    for g in grams:
        for f in g:
            df[f] = df.get(f, 0) + 1
    idf = {f: math.log((1 + len(grams)) / (1 + d)) + 1 for f, d in df.items()}
    rows, taken = [], {}
    for g, lang in zip(grams, frame.lang):
        x = {f: (1 + math.log(n)) * idf[f] for f, n in g.items()}
        size = math.sqrt(sum(v * v for v in x.values()))
        taken[lang] = taken.get(lang, 0) + 1
        rows.append(({f: v / size for f, v in sorted(x.items())} | {dim: 1.0}, names.index(lang), taken[lang] % s.calibrate_one_in == 0))
    learn = [r for r in rows if not r[2]]
    z, n = {}, {}

    def weight(f, k):
        l1, l2 = (0, 0) if f == dim else (s.l1, s.l2)
        v = z.get((f, k), 0.0)
        return 0.0 if abs(v) <= l1 else (math.copysign(l1, v) - v) / ((s.beta + math.sqrt(n.get((f, k), 0.0))) / s.alpha + l2)

    order = np.arange(len(learn))
    for epoch in range(s.epochs):
        np.random.default_rng(epoch).shuffle(order)
        for r in order:
            x, y, _ = learn[r]
            w = {(f, k): weight(f, k) for f in x for k in range(len(names))}
            logit = [sum(v * w[f, k] for f, v in x.items()) for k in range(len(names))]
            e = [math.exp(v - max(logit)) for v in logit]
            for k in range(len(names)):
                slope = e[k] / sum(e) - (k == y)
                for f, v in x.items():
                    g, old = v * slope, n.get((f, k), 0.0)
                    z[f, k] = z.get((f, k), 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / s.alpha * w[f, k]
                    n[f, k] = old + g * g
    want = np.array([[weight(f, k) for k in range(len(names))] for f in range(dim + 1)])
    got = np.zeros((dim, len(names)))
    got[np.repeat(np.arange(dim), np.diff(model.first)), model.of] = model.weights
    assert model.languages == names and np.allclose(got, want[:-1], atol=1e-9) and np.allclose(model.bias, want[-1], atol=1e-9)
    assert 0 < (want[:-1] == 0).sum() and len(model.weights) == (want[:-1] != 0).sum()
    for (x, _, _), text in zip(rows, frame.text):
        logit = np.array([sum(v * want[f, k] for f, v in x.items()) for k in range(len(names))]) / model.temperature
        p = np.exp(logit - logit.max()) / np.exp(logit - logit.max()).sum()
        assert model.predict(text) == (names[p.argmax()], pytest.approx(p.max(), abs=1e-9))


def test_unidentified_rows_go(spark):
    """Null, empty and letterless texts go, repeated rows and odd columns stay."""
    rows = [(k, ("the and with that " if k % 2 else "der und nicht auch ") * 5, "en" if k % 2 else "de") for k in range(60)]
    odd = [(3, rows[3][1], None), (3, rows[3][1], None), (None, rows[4][1], None), (70, None, "en"), (71, "", "en"), (72, "12 !", "en"), (73, rows[5][1] * 5000, "en")]
    df = spark.createDataFrame([(*r, 0.5, "x") for r in rows + odd], "doc_id long, text string, lang string, score double, lang_pred string")
    got = sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in langid.keep_identified(df).collect())
    assert got == sorted([*range(60), 3, 3, -1, 73]) and langid.keep_identified(df.limit(0)).count() == 0


def test_sparse_weights_tell_the_shipped_languages(spark):
    """At least half of all weights of seen features are exactly zero, and the held-out accuracy is that of a plain
    dense fit by batch gradient descent."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    frame = docs.where("lang is not null").toPandas()
    model = langid.fit(docs.where(langid.in_fold(F.col("doc_id")) != 2))
    held = np.array([langid.fold_of(i) == 2 for i in frame.doc_id])
    x = np.zeros((len(frame), 1 << langid.HASH_BITS), np.float32)
    for k, t in enumerate(frame.text):
        found, n = langid.counts(t)
        x[k, found] = langid.tf_idf(found, n, model.idf)
    y = np.array([model.languages.index(v) for v in frame.lang])
    w = np.zeros((x.shape[1], len(model.languages)), np.float32)
    for _ in range(150):
        p = langid._softmax(x[~held] @ w)
        p[np.arange(len(p)), y[~held]] -= 1
        w -= 0.5 * x[~held].T @ p / 10
    dense = ((x[held] @ w).argmax(1) == y[held]).mean()
    sparse = np.mean([model.predict(t)[0] == v for t, v in zip(frame.text[held], frame.lang[held])])
    assert sparse >= dense - 0.01
    assert len(model.weights) <= 0.5 * (x[~held] != 0).any(0).sum() * len(model.languages)


def test_secrets(spark, docs):
    assert secret_scan.spans("") == [] and secret_scan.spans("It is: a token of thanks, see: chapter 12.") == []
    code = "k = 'Zx81-kd92-Qm55'\npassword = k + \"tail99XYZ\"\nname = 'Zebra-crossing-12'\nDB_PASSWD: hunter2hunter\n<api_key>a1B2c3D4e5F6</api_key>"
    found = {code[a:b] for a, b, kind in secret_scan.spans(code) if kind == "literal"}
    assert {"Zx81-kd92-Qm55", "tail99XYZ", "hunter2hunter", "a1B2c3D4e5F6"} <= found and "Zebra-crossing-12" not in found
    assert "hunter2" not in secret_scan.redact(code, secret_scan.spans(code))
    assert len(secret_scan.spans("a=" * 20_000)) == 0
    assert secret_scan.digest(docs).count() == docs.count() and secret_scan.scan(docs.limit(0)).count() == 0
    clean = secret_scan.remove_secrets(docs)
    assert clean.columns == docs.columns and by_id(clean.select("doc_id", "text")) == by_id(docs.select("doc_id", "text"))


def test_no_literal_is_dropped():
    """Constants of many literals, chains, long unbroken keys and long subscripts; work stays in proportion."""
    parts = [f"Zx{k}-kd92-Qm{k}5" for k in range(12)]
    listed = " + ".join(f"'{p}'" for p in parts)
    chain = "c0 = 'Zx0-kd92-Qm05'\n" + "".join(f"c{k} = c{k - 1} + '{parts[k]}'\n" for k in range(1, 12)) + "c11 = c11 + c11\npassword = c11"
    for code in (f"k = {listed}\npassword = k", f"a = {listed}\nb = a\nc = b + b\nsecret = c", chain):
        got = [code[a:b] for a, b, kind in secret_scan.spans(code) if kind == "literal"]
        assert sorted(got) == sorted(parts) and not any(p in secret_scan.redact(code, secret_scan.spans(code)) for p in parts)
    rng = random.Random(8)
    key = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/") for _ in range(1600))
    for code in (f"<privateKey>{key}</privateKey>", f"password[{'x' * 100}] = '{parts[0]}'", f"t = {{}}\nsecret['[{'y' * 80}'] = '{parts[0]}'"):
        value = key if key in code else parts[0]
        assert value in {code[a:b] for a, b, kind in secret_scan.spans(code) if kind == "literal"}
    assert secret_scan.spans("password[x\n] = 'Zx81-kd92-Qm55'") == secret_scan.spans("n[x] == 'Zx81-kd92-Qm55'") == []
    for code in ("a[" * 50_000 + "= 1", "a=b[" * 50_000, "a[" * 50_000 + "] = 1", "<key>" + "x" * 200_000, "a = a + a\n" * 20_000, "a = 'q' + a\n" * 20_000):
        assert secret_scan.spans(code) == []


@pytest.mark.parametrize("code", [
    "x = 1 " + "a" * 1_000_000, "x = 1 " + "a." * 500_000, "x: " + "a1" * 500_000, "k = '" + "b" * 1_000_000, "k = " + '"\\\\' * 300_000, "a='b\n" * 200_000, "x = y " + " " * 1_000_000,
    "a:b:" * 200_000, "x" + " " * 1_000_000 + "=1", "'a" * 400_000 + "=", "-" * 1_000_000 + "=1", "password" + " " * 1_000_000, "a = b\n" * 150_000, "b = a\na = b\n" * 80_000,
    *[part * (1_000_000 // len(part)) for part in ("a=b&", "k==a=", "a=b-", "a=-", "a:b&", "a[b]=c&", "a=>b+")], "a:" * 50_000 + " " * 500_000 + "x",
    *["".join(random.Random(k).choices("a=:&[]'\"\\<>" + " \n-1b" * (k % 2), k=1_000_000)) for k in range(4)],
])
def test_long_texts_are_read_in_linear_time(code):
    import time

    began = time.process_time()
    secret_scan.spans(code)
    assert time.process_time() - began < 8


def test_planted_literals():
    """Assignments written by rule, some by way of constants set before or after: just the sensitive ones are found."""
    rng = random.Random(12)
    letters = "abcdefghjkmnpqrstuvwxyzABCDEFGHJKMNPQRSTUVWXYZ23456789"
    for case in range(200):
        lines, want = ["some words, and a note: see chapter two.", "total = 12"], set()
        for k in range(rng.randint(1, 8)):
            value = "".join(rng.choice(letters) for _ in range(20)) + "7xQ"
            name, hot = rng.choice([("client_secret", 1), ("dbPassword", 1), ("auth-token", 1), ("colour", 0), ("item_name", 0), ("config.api_key", 1)])
            form = rng.randrange(8)
            const = f"C{case}_{k}"
            lines += [
                [f"{name} = '{value}'"], [f'"{name}": "{value}",'], [f"{name}={value}"], [f"{name.replace('-', '_')}: str = '{value}'"], [f"<{name}>{value}</{name}>"],
                [f"{const} = '{value}'", f"{name} := {const}"], [f"{name} = {const}", f"{const} = '{value}'"], [f"run --{name}={value} --fast"],
            ][form]
            if hot:
                want.add(value)
        code = "\n".join(lines)
        assert {code[a:b] for a, b, kind in secret_scan.spans(code) if kind == "literal"} == want, code
    code = "passphrase: correcthorsebattery\nclient_secret=K\nK='Zx81-kd92-Qm55'\n<client_secret>" + "aB3x" * 1300 + "</client_secret>"
    assert {"correcthorsebattery", "Zx81-kd92-Qm55", "aB3x" * 1300} == {code[a:b] for a, b, kind in secret_scan.spans(code) if kind == "literal"}


def test_permutation():
    for n in (0, 1, 2, 3, 7, 1000):
        p = sharding.permute(np.arange(n), n, 5)
        assert sorted(p.tolist()) == list(range(n)) and sharding.permute(p, n, 5, inverse=True).tolist() == list(range(n))


def test_shards(spark, docs):
    got = sharding.shard_rows(docs, 4).toPandas()
    assert sorted(got.row_number) == list(range(docs.count())) and got.groupby("shard").size().max() <= 3
    assert got.loc[got.doc_id == 1, ["size", "text_crc32"]].values.tolist() == [[1, 0]]
    assert sharding.shard_rows(docs.limit(0), 4).count() == 0


def test_trie_join_finds_all_pairs():
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    near = base[:100] ^ (np.uint64(1) << rng.integers(0, 64, 100).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 100).astype(np.uint64))
    a = np.unique(np.concatenate([base, near, np.arange(40, dtype=np.uint64)]))
    found = {(int(i), int(j)) for p, r in simhash.trie_pairs(a, a, 64, 2, True) for i, j in zip(p, r)}
    assert found == {(i, j) for i in range(len(a)) for j in range(i + 1, len(a)) if int(a[i] ^ a[j]).bit_count() <= 2}


def test_crowded_nodes_are_split(spark, monkeypatch):
    monkeypatch.setattr(simhash, "NODE_PAIR", 6)
    rng = random.Random(7)
    fps = [rng.getrandbits(63) for _ in range(40)] + [(5 << 58) | k for k in range(60)]
    df = spark.createDataFrame([(f,) for f in set(fps)], "fp long")
    got = {r["node"]: r["component"] for r in components.connected_components(simhash.trie_self_join(df, 1)).collect()}
    root = {f: f for f in set(fps)}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in root:
        for b in root:
            if (a ^ b).bit_count() <= 1:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert all(got.get(f, f) == find(f) for f in root)


@pytest.mark.parametrize("budget,node_pair,walked", [(0, 8192, 1 << 16), (2, 8192, 5), (3, 4, 1 << 16), (3, 8192, 40)])
def test_links_join_just_what_is_near(spark, monkeypatch, budget, node_pair, walked):
    """Signed fingerprints, near ones in every block of bits, dense clusters: components against all pairs."""
    monkeypatch.setattr(simhash, "NODE_PAIR", node_pair)
    monkeypatch.setattr(simhash, "WALKED", walked)
    rng = random.Random(budget * 100 + walked)
    fps = [rng.getrandbits(64) for _ in range(60)]
    fps += [f ^ sum(1 << k for k in rng.sample(range(64), rng.randint(1, 5))) for f in fps for _ in range(2)]
    fps += [fps[0] ^ sum(1 << k for k in rng.sample(range(20), rng.randint(0, 4))) for _ in range(60)] + [0, 2**64 - 1, 1 << 63]
    signed = sorted({f - 2**64 if f >= 2**63 else f for f in fps})
    df = spark.createDataFrame([(f,) for f in signed], "fp long").repartition(3)
    got = {r["node"]: r["component"] for r in components.connected_components(simhash.trie_self_join(df, budget)).collect()}
    root = {f: f for f in signed}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(signed):
        for b in signed[k + 1 :]:
            if ((a ^ b) % 2**64).bit_count() <= budget:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert all(got.get(f, f) == find(f) for f in signed)


def test_near_duplicates(spark, docs):
    got = by_id(simhash.near_duplicates(docs, 3, 2).select("doc_id", "component_id"))
    assert got == sorted([(1, 1), (2, 1), (6, 1), (3, 3), (4, 3), (4, 3), (5, 5), (7, 7), (None, None)], key=repr)
    kept = simhash.keep_representatives(docs, 3, 2)
    assert kept.columns == docs.columns and by_id(kept.select("doc_id")) == sorted([(1,), (3,), (5,), (7,), (None,)], key=repr)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_all_wide_fingerprints_of_a_class_link(spark, monkeypatch):
    """A and B share a fingerprint; C is similar to B only, whose wide fingerprint is not the least of the two."""

    def wide(*bits):
        out = np.zeros(simhash.WIDE_BITS, np.uint8)
        out[list(bits)] = 1
        return bytearray(np.packbits(out).tobytes())

    def shingles(a, b):
        return bytearray(np.arange(a, b).astype("<u4").tobytes())

    far, farther = 0x0F0F0F0F0F0F0F0F, 0x3333333333333333
    key = lambda k: bytearray(np.array([k], np.int64).tobytes())
    rows = [
        (1, 1, 5, wide(), key(1), 100, shingles(500, 600)), (2, 2, 5, wide(*range(60)), key(2), 100, shingles(0, 100)),
        (3, 3, far, wide(*range(100)), key(2), 100, shingles(5, 105)), (4, 4, farther, wide(*range(70)), key(2), 100, shingles(30, 130)),
    ]
    held = spark.createDataFrame(rows, "doc_id long, tie long, fp long, wide binary, bands binary, size long, shingles binary")
    monkeypatch.setattr(simhash, "fingerprints", lambda *args: held.drop("shingles"))
    monkeypatch.setattr(simhash, "shingle_sets", lambda docs, wanted, n: wanted.join(held, F.col("tie") == F.col("_tie")).select("cid", "shingles"))
    got = dict(by_id(simhash.near_duplicates(None, similarity=0.8).select("doc_id", "component_id")))
    assert got == {1: 1, 2: 1, 3: 1, 4: 4}


def test_similar_pairs_by_plain_sets(monkeypatch):
    rng = np.random.default_rng(5)
    base = [rng.integers(2**32, size=n).astype("<u4") for n in (40, 300, 7)]
    sets = [np.unique(np.concatenate([b[rng.random(len(b)) < 0.95], rng.integers(2**32, size=3).astype("<u4")])) for b in base for _ in range(12)] + [np.zeros(0, "<u4")]
    i, j = np.triu_indices(len(sets), 1)
    near = {(a, b) for a, b in zip(i.tolist(), j.tolist()) if len(x := np.intersect1d(sets[a], sets[b])) >= 0.8 * np.sqrt(len(sets[a]) * len(sets[b])) - 1e-9 and len(x)}
    want = simhash.forest(iter([(np.array([a]), np.array([b])) for a, b in near]), len(sets))
    for columns, gather in ((1 << 16, 1 << 26), (64, 256)):
        monkeypatch.setattr(simhash, "BIT_COLUMNS", columns)
        monkeypatch.setattr(simhash, "GATHER_BYTES", gather)
        got = list(simhash.similar_pairs(iter([(i, j)]), sets, 0.8))
        assert {(a, b) for p, q in got for a, b in zip(p.tolist(), q.tolist())} <= near
        assert simhash.forest(iter(got), len(sets)).tolist() == want.tolist()


def test_texts_of_one_id(spark):
    """Different texts that share an id, or have none, stay; of copies of one, one row stays. Columns may have any name."""
    cat, dog = " ".join(f"cat{k}" for k in range(60)), " ".join(f"dog{k}" for k in range(60))
    rows = [(1, cat), (1, dog), (1, dog), (2, cat), (None, cat), (None, " ".join(f"x{k}" for k in range(60))), (None, " ".join(f"y{k}" for k in range(60))), (5, None), (5, "")]
    df = spark.createDataFrame([(i, t, 1, "a", 2) for i, t in rows], "doc_id long, text string, __kept_id int, `a b` string, tie int")
    got = simhash.keep_representatives(df)
    assert got.columns == df.columns
    kept = [(r["doc_id"], (r["text"] or "")[:3]) for r in got.collect()]
    assert sorted(kept, key=repr) == sorted([(1, "cat"), (1, "dog"), (None, "x0 "), (None, "y0 "), (5, "")], key=repr)


def test_components(spark):
    chain = [(k, k + 1) for k in range(0, 60)] + [(100, 90), (90, 100), (5, 5), (None, 3), (200 + 1, 200), (202, 200), (300, 202)]
    got = dict(by_id(components.connected_components(spark.createDataFrame(chain, "src long, dst long"))))
    assert got == {k: 0 for k in range(61)} | {90: 90, 100: 90} | {k: 200 for k in (200, 201, 202, 300)}


@pytest.mark.parametrize("bits", [1, 5, 8, 15, 16, 17, 32])
def test_bit_packing(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 5000, dtype=np.uint64).astype("<u4")
    packed = binary_output.pack_ids(ids, bits)
    assert len(packed) == -(-5000 * bits // 8)
    for a, b in ((0, 5000), (0, 0), (17, 18), (1023, 1025), (4999, 5000)):
        assert binary_output.unpack_ids(packed, bits, a, b).tolist() == ids[a:b].tolist()
    with pytest.raises(ValueError):
        binary_output.pack_ids(np.array([1 << 20]), 16)


def test_files(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    binary_output.write_ids(docs, f"file://{tmp_path}/ids", path("byte_bpe_50k.json"))
    got = sorted((tuple(r) for r in binary_output.read_ids(spark, f"file://{tmp_path}/ids").collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [None, 1, 2, 3, 4, 4, 5, 6, 7] and [r[1] for r in got[1:]] == [a[1] + a[2] for a in got[:-1]]
    tok = Tokenizer.from_file(path("byte_bpe_50k.json"))
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for doc, _, n, crc in got:
        ids = tok.encode(texts[doc], add_special_tokens=False).ids + [0]
        assert (n, crc) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    binary_output.write_ids(docs.limit(0), f"file://{tmp_path}/none", path("byte_bpe_50k.json"))
    assert binary_output.read_ids(spark, f"file://{tmp_path}/none").count() == 0


def test_batches_of_short_rows_stay_large(spark):
    """Batches are bounded by bytes, so no operator makes those of a later one small."""
    from shardloom.llm.common import ARROW_BYTES, bound_batches

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    bound_batches(spark)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
    assert str(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")).removesuffix("b") == str(ARROW_BYTES)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    short = [r["n"] for r in spark.range(20_000, numPartitions=1).mapInArrow(sizes, "n long").collect()]
    long = [r["n"] for r in spark.range(60, numPartitions=1).select(F.repeat(F.lit("x"), 500_000).alias("t")).mapInArrow(sizes, "n long").collect()]
    assert max(short) >= 5000 and max(long) <= 9


def test_permutation_number_by_number():
    """The permuted numbers against the same network written with plain integers."""
    def plain(x, n, seed):
        half = 1
        while 4**half < n:
            half += 1
        mask = 2**half - 1
        while True:
            left, right = x >> half, x & mask
            for r in range(6):
                z = (right + (seed * 0x9E3779B97F4A7C15 + (r + 1) * 0xD1B54A32D192ED03)) % 2**64
                z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 % 2**64
                z = (z ^ z >> 27) * 0x94D049BB133111EB % 2**64
                left, right = right, left ^ ((z ^ z >> 31) & mask)
            x = left << half | right
            if x < n:
                return x

    for n in (1, 2, 3, 5, 64, 65, 1000, 4097):
        for seed in (0, 7):
            got = sharding.permute(np.arange(n), n, seed)
            assert got.tolist() == [plain(x, n, seed) for x in range(n)] and sorted(got.tolist()) == list(range(n))
            assert sharding.permute(got, n, seed, inverse=True).tolist() == list(range(n))


def test_rows_alike_are_numbered(spark):
    from shardloom.llm.ordering import number_rows

    df = spark.range(3000).select(F.lit(7).alias("doc_id"), F.lit("same").alias("text"))
    assert sorted(r["row_number"] for r in number_rows(df, "doc_id", "text").collect()) == list(range(3000))
    assert number_rows(df.limit(0), "doc_id").count() == 0


def test_a_very_long_conversation(spark):
    """Thousands of turns, one of them very long, with control strings and nulls, come back from ids and mask."""
    import hashlib

    rng = random.Random(3)
    turns = [(1, k, rng.choice(["user", "assistant"]), rng.choice(["yes", None, "<|im_end|> no", "日本 \\ x", "a longer answer " * 20])) for k in range(4000)]
    turns.append((1, 4000, "assistant", "word " * 100_000))
    vocabulary = path("byte_bpe_50k.json")
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(4)
    got = chat.read_back(chat.format_conversations(df, vocabulary), vocabulary).collect()
    whole = "".join(f"{r}\n{t or ''}\n" for _, _, r, t in turns)
    loss = "".join(t or "" for _, _, r, t in turns if r == "assistant")
    assert [(r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in got] == [(4001, hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())]


def test_secrets_of_odd_rows(spark, docs):
    """Null and empty texts have none; rows and columns come back as they were."""
    got = {(r["doc_id"], r["n_assign"], r["spans"]) for r in secret_scan.digest(docs).collect()}
    assert {(1, 0, ""), (2, 0, ""), (None, 0, "")} <= got and secret_scan.digest(docs.limit(0)).count() == 0
    clean = secret_scan.remove_secrets(docs)
    assert clean.columns == docs.columns and by_id(clean) == by_id(docs) and secret_scan.remove_secrets(docs.limit(0)).count() == 0


def test_band_keys():
    """Equal sets have equal keys, whatever the order and repeats; the share of equal keys is that of the formula."""
    rng = np.random.default_rng(5)
    bands = simhash.bands_of(0.8)
    assert bands == math.ceil(math.log(simhash.MISS) / math.log(1 - 0.8**8))
    x = rng.integers(2**63, size=400).astype(np.uint64)
    assert (simhash.band_keys(x, bands) == simhash.band_keys(np.concatenate([x[::-1], x[:9]]), bands, most=1000)).all()
    assert len(simhash.band_keys(x[:0], bands)) == 0
    hits = 0
    for _ in range(200):
        a = rng.integers(2**63, size=500).astype(np.uint64)
        b = np.concatenate([a[:400], rng.integers(2**63, size=100).astype(np.uint64)])
        hits += (simhash.band_keys(a, bands) == simhash.band_keys(b, bands)).sum()
    assert abs(hits / (200 * bands) - (400 / 600) ** 4) < 0.03
