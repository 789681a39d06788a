"""The operators against brute force, exact round trips and held-out accuracy."""

import hashlib
import re
import struct
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from touchline.llm import chat, exhaustive, jaccard, language, mixing, packing, permutation, quality, toxicity, urls
from touchline.llm.common import text_chunks
from touchline.llm.components import components
from touchline.llm.queries import QUERIES, RULES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t", "en", "a", 3), (None, "a text without id here", "en", None, 1),
    (4, "one two three four five", "en", "a", 5), (4, "one two three four five", "en", "a", 5), (5, "ONE two three  four five", "fr", "b", 5),
    (6, "<|endoftext|> Don't ÉÉ é 你好 Σας 😀 ½ a\x1cb", None, "b", 1), (7, "wort " * 3000, "de", "b", 15000), (8, "12 !! ??", "de", None, 8),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS).withColumn("score", F.lit("mine")).withColumn("n", F.lit(1))


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark, sf):
    return spark.read.parquet(f"{sf}/labels.parquet")


def fold(doc_id, parts):
    return zlib.crc32(str(doc_id).encode()) % parts


def ids_of(texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for t in texts]


def check_packing(rows, texts):
    want = {}
    for i, ids in ids_of_map(texts):
        for k, s in enumerate(range(0, len(ids), 2048)):
            part = ids[s : s + 2048]
            want.setdefault((i, k, s, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))), 0)
            want[(i, k, s, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part)))] += 1
    got, places = {}, {}
    for r in rows:
        key = (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
        got[key] = got.get(key, 0) + 1
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert got == want
    for spans in places.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= 2048
    return len(places)


def ids_of_map(texts):
    return zip([i for i, _ in texts], ids_of([t for _, t in texts]), strict=True)


def test_packing_query(spark, sf, docs):
    rows = QUERIES["op1_pack"](spark, sf).collect()
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    used = check_packing(rows, texts)
    total = sum(r.length for r in rows)
    assert used <= 1.05 * total / 2048 + 2


def test_packing_odd_rows_and_parts(spark, odd):
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [(r[0], r[1]) for r in ODD]
    check_packing(packing.pack(packing.pieces(odd, path)).collect(), texts)
    check_packing(packing.pack(packing.pieces(odd, path), part_rows=2).collect(), texts)
    assert packing.pack(packing.pieces(odd.limit(0), path)).count() == 0


def encoded(encoder, texts):
    return [ids for _, _, data, offsets in text_chunks(pa.array(texts), packing.ENCODE_BYTES) for ids in encoder.encode(data, offsets)]


def test_pack_encoder_is_the_tokenizer(monkeypatch):
    """Spaces of all kinds, endings after apostrophes, special strings over the border of two texts, long texts in runs."""
    path = public_tokenizers.path("word_bpe_49k.json")
    parts = [*"aZé''sstdmrevlRE 1½²\n\t.,!-\x1c\xa0\x85ſßДя你<|>İıĿŸŉ×ÀÞΣ😀\x00\x7f́　", " ", "<|endoftext|>", "<|ENDOFTEXT|>", "'ll", "'Ve", "'re"]
    dealt = np.random.default_rng(5)
    made = ["".join(dealt.choice(parts, dealt.integers(0, 40))) for _ in range(1500)]
    texts = ["x<", "|y", "don'", "t '", "s", "", *(f"aB{chr(c)}c'{chr(c)}s1{chr(c)} 'S {chr(c)}" for c in range(0x250)), *made]
    want = [struct.pack(f"<{len(ids) - 1}I", *ids[:-1]) for ids in ids_of(texts)]
    for size in (packing.ENCODE_BYTES, 40):
        monkeypatch.setattr(packing, "ENCODE_BYTES", size)
        assert encoded(packing.Encoder(path), texts) == want


def test_pack_encoder_is_much_faster_than_the_tokenizer():
    """CPU time over texts of many different words, as a share of the tokenizer's in the same process."""
    path = public_tokenizers.path("word_bpe_49k.json")
    dealt = np.random.default_rng(8)
    parts = dealt.choice(["an", "the", "ea", "on", "st", "er", "ing", "nd", "ou", "tion", "é", "über"], (300_000, 3))
    marks = dealt.choice(["", "", "", ",", ".", "!!", "?", "%%", "$", ";", ")", ":"], (300_000, 2))
    words = ["".join([*p, *m]) for p, m in zip(parts.tolist(), marks.tolist(), strict=True)]
    texts = [" ".join(words[k : k + 300]) for k in range(0, len(words), 300)]
    encoder, begun = packing.Encoder(path), time.process_time()
    got = encoded(encoder, texts)
    ours, begun = time.process_time() - begun, time.process_time()
    want = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert ours < 0.2 * (time.process_time() - begun)
    assert got == [struct.pack(f"<{len(ids)}I", *ids) for ids in want]


def test_sum_of_squares_rule():
    def brute(lengths, capacity):
        bins = []
        for size in lengths:
            best = None
            for gap in sorted({capacity, *(g for g in bins if g)}):
                if gap < size:
                    continue
                after = [g for g in bins if g]
                if gap != capacity:
                    after.remove(gap)
                after = [g for g in [*after, gap - size] if g]
                total = sum(after.count(g) ** 2 for g in set(after))
                if best is None or total < best[0]:
                    best = (total, gap)
            gap = best[1]
            if gap == capacity:
                bins.append(gap - size)
            else:
                bins[bins.index(gap)] = gap - size
        return sorted(bins)

    lengths = np.random.default_rng(3).integers(1, 12, 80)
    sequence, offset = packing.place(lengths, 12)
    got = [12 - int(lengths[sequence == s].sum()) for s in range(sequence.max() + 1)]
    assert sorted(got) == brute([int(x) for x in lengths], 12)


@pytest.mark.parametrize(("name", "label", "parts", "part"), [("op2_toxicity", "toxic", 4, 2), ("op3_quality", "quality", 5, 0)])
def test_classifiers_held_out(spark, name, label, parts, part):
    sf = "/root/testdata/sf0.1"
    known = {r.doc_id: r[label] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = QUERIES[name](spark, sf).collect()
    assert all(r.held_out == (fold(r.doc_id, parts) == part) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    held = [(known[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in known]
    assert np.mean([a == b for a, b in held]) > 0.97


@pytest.mark.parametrize("module", [toxicity, quality])
def test_classifiers_odd_rows(spark, odd, module):
    marks = spark.createDataFrame([(4, 1), (4, 1), (5, 0), (7, None), (None, 1), (8, 0), (7, 1)], "doc_id long, label int")
    scored = module.score(odd, module.fit(odd, marks, "label", 1000, 999), out="score")
    rows = scored.collect()
    assert len(rows) == len(ODD) and scored.columns.count("score") == 1 and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id == 4}) == 1
    empty = module.fit(odd, marks.limit(0), "label")
    assert module.score(odd.limit(0), empty).count() == 0


def test_presence_score_is_the_sparse_dot_product():
    texts = ["a loser a loser", None, "", "fine words here", "Loser!"]
    model = toxicity.fit_texts(pa.array(texts * 3, pa.string()), np.array([1, 0, 0, 0, 1] * 3))
    for i, text in enumerate(texts):
        alone = model.score(pa.array([text], pa.string()), toxicity.features)[0]
        assert model.score(pa.array(texts, pa.string()), toxicity.features)[i] == pytest.approx(alone)
    assert model.score(pa.array(["loser"]), toxicity.features)[0] > 0.5 > model.score(pa.array(["words"]), toxicity.features)[0]


def test_url_rules_and_aliases(spark):
    link, refresh = '<link rel="canonical" href="{}">', '<META http-equiv=refresh content="0; url={}">'
    rows = [
        (1, "http://a.NET/x", None), (2, "http://b.org/y", link.format("http://a.net/x")), (3, "https://c.org/fr/1#z", refresh.format("http://a.net/w")),
        (4, "http://d.org/q", refresh.format("https://c.org/fr/1")), (5, None, "x"), (6, "no scheme", None), (7, "http://x.example.net/en/", None),
        (8, "http://example.com/de/?q", None), (9, "http://net", None), (10, "http://b.org/y", None), (11, "http://b.org/k", link.format("/y")), (12, "http://notnet/", None),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("rule", F.lit(1))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages, RULES).collect()}
    assert got[1] == ("a.net", "/x", "net/", "block") and got[2][2:] == (None, "block") and got[10][3] == got[11][3] == "block"
    assert got[3][2:] == ("org/fr/", "allow") and got[4][2:] == (None, "allow")
    assert got[5] == got[6] == ("", "", None, "allow") and got[7][2:] == ("example.net/en/", "allow") and got[8][2:] == ("example.com/de/", "block")
    assert got[9] == ("net", "", None, "allow") and got[12][3] == "allow" and len(got) == len(rows)
    assert urls.judge(pages.limit(0), RULES).count() == 0


def test_components(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)}


def vectors_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))


ODD_VECTORS = [(20, [1.0, 0.0]), (100, [0.5, 0.5]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [0.0, 0.0]), (7, [float("inf"), 0.0]), (8, [-1.0, 0.25]), (None, [1.0, 1.0])]


def test_exact_top_k_odd_vectors(spark):
    got = exhaustive.top_k(vectors_of(spark, ODD_VECTORS), F.col("vec_id") % 100 == 0, 3, 1024).collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"])] == [(100, 1, 1, 512 * 1024), (100, 2, 2, 512 * 1024), (100, 3, 20, 512 * 1024)]
    assert exhaustive.top_k(vectors_of(spark, ODD_VECTORS[:0]), F.col("vec_id") % 100 == 0, 3, 1024).count() == 0


def brute(spark, sf, step, k):
    frame = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    x, ids = np.stack(frame["embedding"]).astype(float), frame["vec_id"].to_numpy()
    out = {}
    for i in np.flatnonzero(ids % step == 0):
        s = x @ x[i]
        s[i] = -np.inf
        out[ids[i]] = [(ids[j], s[j]) for j in np.lexsort((ids, -s))[:k]]
    return out


def test_permutation_index_recall(spark):
    sf = "/root/testdata/sf0.1"
    want, got = brute(spark, sf, 20, 20), {}
    for r in QUERIES["op5_permutation"](spark, sf).collect():
        got.setdefault(r.query_id, []).append(r)
    assert got.keys() == want.keys()
    hits = 0
    for q, rows in got.items():
        rows.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in rows] == list(range(1, 21)) and len({r.vec_id for r in rows}) == 20
        assert [(-r.score, r.vec_id) for r in rows] == sorted((-r.score, r.vec_id) for r in rows)
        exact = dict(want[q])
        assert all(abs(exact[r.vec_id] - r.score) < 1e-9 for r in rows if r.vec_id in exact)
        hits += sum(r.vec_id in exact for r in rows)
    assert hits >= 0.9 * 20 * len(want)


def test_permutation_index_odd_vectors(spark):
    got = permutation.top_k(vectors_of(spark, ODD_VECTORS), F.col("vec_id") % 20 == 0, 20)
    rows = sorted((r.query_id, r["rank"], r.vec_id) for r in got.collect())
    assert rows == [(20, 1, 1), (20, 2, 2), (20, 3, 100), (20, 4, 8), (100, 1, 1), (100, 2, 2), (100, 3, 20), (100, 4, 8)]
    few = permutation.top_k(vectors_of(spark, [(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(60)]), F.col("vec_id") % 20 == 0, 20, probed=1, posted=1)
    assert few.count() == 3 * 20
    assert permutation.top_k(vectors_of(spark, ODD_VECTORS[:0]), F.col("vec_id") % 20 == 0, 20).count() == 0


def test_language_code_lengths_against_brute_force(spark):
    texts = ["The cat sat on the mat", "le chat et la mer", "der Hund und die Katze", "", "Été à la mer"]
    langs = ["en", "fr", "de", "de", "fr"]
    frame = spark.createDataFrame(list(zip(range(5), texts, langs, strict=True)), "doc_id long, text string, lang string")
    model = language.fit(frame, 10**6, 10**6 - 1)
    table, pad = model.table, int(model.table[32])
    others = 256 - len(set(table.tolist()) - {language.OTHER})

    def symbols(text):
        return [pad] * 3 + [int(table[b]) for b in text.encode()]

    for i, lang in enumerate(model.langs):
        seen = {}
        for text, own in zip(texts, langs, strict=True):
            if own == lang:
                s = symbols(text)
                for p in range(3, len(s)):
                    for order in range(4):
                        cell = seen.setdefault(tuple(s[p - order : p]), {})
                        cell[s[p]] = cell.get(s[p], 0) + 1
        for text in ["The mat", "xyz é", "Katze"]:
            s, bits = symbols(text), 0.0
            for p in range(3, len(s)):
                for order in (3, 2, 1, 0, -1):
                    if order < 0:
                        bits += 6
                        break
                    cell = seen.get(tuple(s[p - order : p]))
                    if cell:
                        total = sum(cell.values()) + len(cell)
                        if s[p] in cell:
                            bits -= np.log2(cell[s[p]] / total)
                            break
                        bits -= np.log2(len(cell) / total)
                bits += np.log2(others) if s[p] == language.OTHER else 0
            assert model.lengths(pa.array([text]))[0, i] == pytest.approx(bits, rel=1e-5)


def test_language_rare_scripts_beside_a_dominant_one(spark):
    latin = [chr(c) for c in range(33, 127) if not 65 <= c <= 90]  # more than the 63 that once had symbols
    dealt = np.random.default_rng(3)

    def texts(letters, n, words):
        return [" ".join("".join(dealt.choice(letters, 4)) for _ in range(words)) for _ in range(n)]

    # The two languages of a script differ in nothing but which of its letters they use.
    letters = {"c1": "абвгдежз", "c2": "ийклмноп", "h1": "你好世界中文字人", "h2": "日本語東京大学生"}
    rows = [(t, "zz") for t in texts(latin, 400, 40)] + [(t, lang) for lang, x in letters.items() for t in texts(list(x), 3, 12)]
    frame = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string")
    model = language.fit(frame, 10**6, 10**6 - 1)
    used = {b for t, _ in rows for b in t.lower().encode()}
    assert len(used) > 64 and all(model.table[b] == b for b in used)
    new = [(t, lang) for lang, x in letters.items() for t in texts(list(x), 5, 6)]
    asked = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(new)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score > 0.99) for r in language.predict(asked, model).orderBy("doc_id").collect()] == [(lang, True) for _, lang in new]

    one, was = language.STRINGS_AT_ONCE, language.counts(frame, model.table, 32).toPandas().sort_values(["lang", "code"])
    language.STRINGS_AT_ONCE = 50  # handed on many times
    try:
        again = language.counts(frame, model.table, 32).toPandas().sort_values(["lang", "code"])
    finally:
        language.STRINGS_AT_ONCE = one
    want = {}
    for t, lang in rows:
        b = b"   " + bytes(x + 32 if 65 <= x <= 90 else x for x in t.encode())
        for k in range(len(b) - 3):
            key = lang, int.from_bytes(b[k : k + 4], "big")
            want[key] = want.get(key, 0) + 1
    for found in (was, again):
        assert dict(zip(zip(found["lang"], found["code"], strict=True), found["n"], strict=True)) == want


def test_language_held_out(spark, odd):
    sf = "/root/testdata/sf0.01"
    known = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op7_language"](spark, sf).collect()
    assert np.mean([r.lang_pred == known[r.doc_id] for r in rows if r.held_out]) > 0.95
    got = {r.doc_id: r.lang_pred for r in language.predict(odd, language.fit(odd)).collect()}
    assert got[1] == got[2] == got[3] == got[8] == "und" and got[4] in ("en", "fr", "de")
    assert language.predict(odd.limit(0), language.fit(odd.limit(0))).count() == 0
    assert {r.lang_pred for r in language.predict(odd, language.fit(odd.limit(0))).collect()} == {"und"}


def brute_components(texts, words, percent):
    sets = []
    for _, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(texts):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: (len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(texts)}


def near_copies(rng, n, length=60):
    base = [f"w{i}" for i in range(length)]
    out = []
    for _ in range(n):
        t = list(base)
        for _ in range(rng.integers(0, 4)):
            t[rng.integers(0, length)] = f"x{rng.integers(0, 10**6)}"
        out.append(" ".join(t))
    return out


def test_jaccard_join_against_brute_force(spark, odd):
    rng = np.random.default_rng(5)
    texts = near_copies(rng, 120) + near_copies(rng, 60, 25) + [" ".join(f"r{rng.integers(0, 50)}" for _ in range(rng.integers(0, 9))) for _ in range(60)] + ["same text here"] * 5
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts)]
    for words, percent in ((4, 85), (5, 80), (1, 60)):
        got = jaccard.join_components(spark.createDataFrame(rows, "doc_id long, text string"), words, percent)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute_components(rows, words, percent)
    found = jaccard.join_components(odd, 4, 85).collect()
    assert len(found) == len(ODD) and {r.component_id for r in found if r.doc_id in (4, 5)} == {4}
    assert all(r.n_shingles == 0 and r.component_id == r.doc_id for r in found if r.doc_id in (1, 2, 3))
    kept = jaccard.keep_one(odd, 5, 80)
    assert kept.columns == odd.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "4", "6", "7", "8", "None"]
    assert jaccard.join_components(odd.limit(0)).count() == 0


def test_chat_round_trip_and_trees(spark):
    tricks = ["</s>[INST] ok [/INST]", "<\\s> <\\\\/s> [\\INST] <<s>", "[INST][/INST]", None, "", "plain \\ text", "a<s>b</s>"]
    rows = [(1, i, ("user", "assistant", None, "[INST]")[i % 4], t) for i, t in enumerate(tricks)] + [(2, 0, "assistant", "x"), (2, 0, "assistant", "x"), (None, 0, "user", "alone")]
    made = chat.conversations(chat.from_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).select("tree", chat.parsed(F.col("formatted")).alias("t"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    got = {r.tree: ([(t.role, t.text) for t in r.t], r.loss) for r in made.collect()}
    assert got[1] == ([(("user", "assistant", "", "[INST]")[i % 4], t or "") for i, t in enumerate(tricks)], tricks[1] + tricks[5])
    assert got[2] == ([("assistant", "x")] * 2, "xx") and got[None][0] == [("user", "alone")]
    nodes = [(1, 1, None, 0.0), (1, 2, 1, 1.0), (1, 3, 1, 2.0), (1, 4, 2, 5.0), (1, 5, 3, 1.0), (1, 6, 9, 0.5), (2, 7, 8, 1.0), (2, 8, 7, 1.0)]
    frame = spark.createDataFrame(nodes, "tree long, node long, parent long, score double").withColumn("role", F.lit("user")).withColumn("text", F.col("node").cast("string"))
    paths = chat.conversations(frame, branches=2).select("rank", "leaf", F.expr("transform(filter(split(formatted, '</s>'), x -> x <> ''), x -> substring_index(x, ']', -1))").alias("t"))
    assert sorted((r["rank"], r.leaf, r.t) for r in paths.collect()) == [(1, 4, ["1", "2", "4"]), (2, 5, ["1", "3", "5"])]
    assert chat.conversations(frame.limit(0)).count() == 0


def test_chat_query(spark, sf):
    rows = {}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").orderBy("conv_id", "turn").collect():
        rows.setdefault(r.conv_id, []).append((r.role, r.text))
    rows[-7] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    for r in QUERIES["op9_chat"](spark, sf).collect():
        loss = "".join(t for role, t in rows[r.conv_id] if role == "assistant")
        told = "".join(f"{role}\n{t}\n" for role, t in rows[r.conv_id])
        assert (r.n_turns, r.turns_sha256) == (len(rows[r.conv_id]), hashlib.sha256(told.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_mixing(spark, sf, odd):
    rows = QUERIES["op10_mixing"](spark, sf).collect()
    by = {}
    for r in rows:
        assert r.taken in (0, r.size, 2 * r.size, 3 * r.size)
        by.setdefault((r.source_size, r.target), []).append(r)
    assert sum(t for _, t in by) == pytest.approx(sum(s for s, _ in by)) and all(t <= 3 * s + 1e-6 for s, t in by)
    for (_, target), own in by.items():
        assert abs(sum(r.taken for r in own) - target) <= max(r.size for r in own)
    made = mixing.mixed(odd).collect()
    assert len(made) == len(ODD) and all(r.mix_times == 0 for r in made if r.mix_size == 0)
    assert mixing.repeated(odd).columns == odd.columns and mixing.mixed(odd.limit(0)).count() == 0


def test_water_filling(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 20), (None, 0)], "mix_source string, mix_size long")
    got = {r.mix_source: r.mix_target for r in mixing.targets(mixing.weights(sizes)).collect()}
    assert got == pytest.approx({"a": 30.0, "b": 1030 - 90.0, "c": 60.0, None: 0.0})


def test_pipeline_stages(spark, sf, docs):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["toxicity", "quality", "jaccard_join", "mixing", "packing"]
    now = docs.limit(0)
    for name, stage in p.STAGES:
        now = stage(spark, now, sf)
        assert now.count() == 0 and (name == "packing" or now.columns == docs.columns)
    kept = jaccard.keep_one(docs, 5, 80)
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute_components(texts, 5, 80)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, (_, c) in want.items() if c == d)
    assert QUERIES["pipeline"](spark, sf).count() > 0
