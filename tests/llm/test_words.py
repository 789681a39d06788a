"""Spelling variants, ranked search and token files against brute force and exact round trips."""

import math
import re
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from touchline.llm import signatures, spelling, tokenfiles
from touchline.llm.queries import QUERIES

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    (3, "Don't stop; x's 12 ½², it'll  do\n\n \t ok "), (1, None), (2, ""), (2, ""), (2, "other text of id two"), (None, "no id"), (None, None), (5, "<|endoftext|> a<|b é"),
    (4, "ÀÉ naïve Straße ŁÓDŹ Привет мир 你好 😀 \x1c\x1f\x85\xa0 　 end"), (7, "wort und satz " * 9000), (6, " \n lead"), (8, "ɐऀक्षि áb"),
]


def rows_of(spark, texts=TEXTS):
    return spark.createDataFrame(texts, "doc_id long, text string").withColumn("ids", F.lit("mine")).withColumn("score", F.lit(1))


def encoded(text):
    return [*Tokenizer.from_file(BYTE_BPE).encode(text or "", add_special_tokens=False).ids, 0]


def test_byte_encoder_is_the_tokenizer():
    encoder = tokenfiles.ByteEncoder(BYTE_BPE)
    dealt = np.random.default_rng(7)
    letters = list("aZé'st 1½\n\t.,!-\x1c\xa0ſßДя你<|>" + " ́")
    made = ["".join(dealt.choice(letters, dealt.integers(0, 60))) for _ in range(400)]
    for text in [t or "" for _, t in TEXTS] + made:
        assert np.frombuffer(encoder.encode(text), encoder.type).tolist() == encoded(text)[:-1]


def test_token_files_round_trip(spark, tmp_path):
    for k, (length, rows, chars) in enumerate(((16, 2, 400), (8, 4, 1 << 20))):
        folder = f"file://{tmp_path}/tokens{k}"
        shards = tokenfiles.write(rows_of(spark), BYTE_BPE, folder, length=length, rows=rows, shard_chars=chars)
        names = [r.name for r in shards.orderBy("shard").collect()]
        got = sorted(tokenfiles.read(spark, folder).collect(), key=lambda r: r.start)
        assert [r.doc_id for r in got] == sorted((i for i, _ in TEXTS), key=lambda i: (i is not None, i)) and (chars > 400 or len(names) > 1)
        at, want = 0, sorted((-1 if i is None else i, zlib.crc32(struct.pack(f"<{len(e)}I", *e)), len(e)) for i, e in ((i, encoded(t)) for i, t in TEXTS))
        for r in got:
            assert r.start == at
            at += r.n_tokens
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.ids_crc32, r.n_tokens) for r in got) == want
        for name in names:
            file, listed = tokenfiles.Sequences(folder, name), tokenfiles.documents(folder, name)
            flat = np.concatenate([tokenfiles.flat_ids(b) for b in file.batches()])
            total = listed.column("length").to_numpy().sum()
            masks = np.concatenate([b.column(1).flatten().to_numpy(zero_copy_only=False) for b in file.batches()])
            assert len(flat) % length == 0 and masks.sum() == total and masks[:total].all()
            texts = {tuple(encoded(t)) for _, t in TEXTS}
            for r in listed.to_pylist():
                assert tuple(file.tokens(r["start"], r["length"]).tolist()) in texts
            for i in (0, len(flat) // length - 1):
                ids, mask = file.sequence(i)
                assert ids.tolist() == flat[i * length : (i + 1) * length].tolist() and len(mask) == length
            before = pa.total_allocated_bytes()
            held = file.sequence(0)
            assert pa.total_allocated_bytes() == before and not held[0].flags.owndata and not held[0].flags.writeable  # the file's own bytes


def test_token_files_of_nothing_and_damaged_ones(spark, tmp_path):
    folder = f"file://{tmp_path}/none"
    assert tokenfiles.write(rows_of(spark).limit(0), BYTE_BPE, folder).count() == 0
    assert tokenfiles.read(spark, folder).count() == 0
    folder = f"file://{tmp_path}/some"
    one = tokenfiles.write(rows_of(spark, [(1, "a b c"), (2, "d")]), BYTE_BPE, folder).first()
    other = tokenfiles.write(rows_of(spark, [(1, "a b"), (2, "d e")]), BYTE_BPE, f"file://{tmp_path}/other").first()
    (tmp_path / "some" / f"{one.name}.docs.arrows").write_bytes((tmp_path / "other" / f"{other.name}.docs.arrows").read_bytes())
    with pytest.raises(Exception, match="disagree"):
        tokenfiles.read(spark, folder).collect()


def test_token_files_query(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got, at = {r.doc_id: r for r in QUERIES["op13_tokenfiles"](spark, sf).collect()}, 0
    tokenizer = Tokenizer.from_file(BYTE_BPE)
    assert got.keys() == texts.keys()
    for i in sorted(texts):
        ids = [*tokenizer.encode(texts[i] or "", add_special_tokens=False).ids, 0]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        at += len(ids)


def brute_search(texts, items, k):
    def terms(text):
        found = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")
        return [t.translate({c: c + 32 for c in range(65, 91)}) for t in found]

    docs = [(i, terms(t)) for i, t in texts if terms(t)]
    n, total = len(docs), sum(len(t) for _, t in docs)
    df = {}
    for _, own in docs:
        for t in set(own):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in items:
        scored = []
        for i, own in docs:
            m, score = 75 + (25 * len(own) * n) // total, 0
            for t in terms(text):
                tf = own.count(t)
                if tf:
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * tf) // (1000 * tf + 12 * m))
            if score > 0:
                scored.append((-score, i is None, i))
        out += [(item, place + 1, i, -s) for place, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(map(str, out))


def test_ranked_search_against_brute_force(spark):
    dealt = np.random.default_rng(5)
    words = [f"w{i}" for i in range(120)] + ["É", "ſ", "Wort7", "中文"]
    texts = [(i, " ".join(dealt.choice(words, dealt.integers(0, 60)) if i % 9 else dealt.choice(words[:4], 300))) for i in range(160)]
    texts += [(200, None), (201, ""), (202, " ,.! "), (7, texts[7][1]), (7, "w1 w2 other"), (None, "w3 w4 w5 w3"), (None, None), (203, "w9 " * 4000)]
    items = [(1, "w1 W2 w2, w77!"), (2, None), (3, "nothing here"), (4, " ".join(words)), (4, "w3"), (None, "É w5"), (5, "wort7 中文 w9 w9"), (6, "w0 w1 w2 w3")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("item", F.lit(0)).withColumn("bits", F.lit("x")).repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    want = brute_search(texts, items, 20)
    got = signatures.top_k(docs, asked, 20)
    assert sorted(str((r.item_id, r["rank"], r.doc_id, r.score)) for r in got.collect()) == want
    numbered = asked.select("text", "item_id", F.monotonically_increasing_id().alias("item"))
    few = signatures.search(signatures.build(docs), docs, numbered, 3, group_terms=40).join(numbered.select("item", "item_id"), "item")
    assert sorted(str((r.item_id, r["rank"], r.doc_id, r.score)) for r in few.collect()) == brute_search(texts, items, 3)
    assert signatures.top_k(docs.limit(0), asked, 5).count() == signatures.top_k(docs, asked.limit(0), 5).count() == 0


def test_bounds_are_never_below_the_scores(spark):
    dealt = np.random.default_rng(6)
    docs = spark.createDataFrame([(i, " ".join(f"w{int(x)}" for x in dealt.zipf(1.3, dealt.integers(1, 400)) % 500)) for i in range(120)], "doc_id long, text string")
    index = signatures.build(docs)
    asked = spark.createDataFrame([(i, " ".join(f"w{int(x)}" for x in dealt.integers(0, 500, 12))) for i in range(10)], "item long, text string")
    told = index.agg(F.sum("holders"), F.sum("terms")).first()
    query = signatures.Query(signatures.item_terms(asked).toPandas(), *told)
    query.weigh(signatures.document_frequencies(docs, query.terms))
    exact = {(r["item"], r["doc_id"]): r["score"] for r in signatures.rescored(docs, asked.select("item").crossJoin(docs.select("doc_id")), query).collect()}
    blocks = index.select("size", "ids", "lengths", "bits").toArrow().combine_chunks().to_batches()
    bounds = {}
    for ids, bound in signatures._bounded(iter(blocks), query):
        for (i, j), x in np.ndenumerate(bound):
            bounds[int(query.items[i]), ids[j].as_py()] = x
    assert all(bounds[key] >= score for key, score in exact.items())
    assert np.mean([bounds[key] == 0 for key in bounds if key not in exact]) > 0.8  # absent terms are mostly seen to be absent


def test_long_texts_are_counted_in_pieces():
    text = ("alpha Beta, gamma " * 9 + "x" * 300 + " ") * 9000
    (rows, hashes, times), = signatures.term_counts(pa.array([text]))
    (_, short, n), = signatures.term_counts(pa.array([("alpha Beta, gamma " * 9 + "x" * 300 + " ") * 2]))
    assert len(text) > 2 << 20 and (hashes == short).all() and (times == n * 4500).all() and not rows.any()


def brute_variants(counts, ratio=5):
    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    form, n_near = {}, {}
    for w in counts:
        others = [x for x in counts if x != w and near(w, x)]
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        n_near[w], form[w] = len(others), best if best is not None and counts[best] >= ratio * counts[w] else None
    out = set()
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, counts[w], n_near[w], counts[form[w]] if form[w] is not None else None))
    return out


def test_variants_against_brute_force(spark):
    dealt = np.random.default_rng(8)
    counts = {}
    for base in ("abcdef", "aaaaaa", "éàüößñ", "中文字人你好"):
        for _ in range(60):
            w = list(base)
            for _ in range(dealt.integers(0, 3)):
                i, kind, c = dealt.integers(0, len(w)), dealt.integers(0, 3), dealt.choice(list("abcé中"))
                w[i : i + (kind != 1)] = [] if kind == 0 else [str(c)]
                w = w or ["a"]
            counts["".join(w)] = int(5 ** dealt.integers(0, 6))
    words = spark.createDataFrame([*counts.items(), (None, 3)], "word string, n long").withColumn("form", F.lit("x"))
    got = {tuple(r) for r in spelling.variants(words).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    assert got == brute_variants(counts) and len(got) > 100
    halves = words.where("word IS NOT NULL").select("word", (F.col("n") * 0 + 2).alias("n"))
    assert {(r.n, r.n_near) for r in spelling.variants(halves.unionByName(halves)).where("word = 'abcdef'").collect()} == {(4, next(x[4] for x in got if x[0] == "abcdef"))}
    assert spelling.variants(words.limit(0)).count() == 0
    assert [spelling.symbols(n) for n in (0, 1, 5000, 500_000, 10**12)] == [4, 4, 5, 9, 64]


def test_words_of_texts(spark):
    texts = [(1, "Hellooo wORLDS ab×cdé÷ÿ Straße"), (2, None), (None, "Hellooo"), (3, ""), (4, "éclairs " * 5)]
    runs = spelling.long_runs(spark.createDataFrame(texts, "doc_id long, text string"), 6).collect()
    assert sorted((str(r.doc_id), r.run) for r in runs) == sorted([("1", "hellooo"), ("1", "worlds"), ("1", "ab×cdé÷ÿ"), ("1", "straße"), ("None", "hellooo")] + [("4", "éclairs")] * 5)
