"""Undefined corners made defined: links, repeated ids, numbered repeats, long texts; classifiers and the pipeline against plain Python."""

import hashlib
import math
import re
from urllib.parse import urljoin

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_llm import brute_components, check_packing

from touchline.llm import common, exhaustive, jaccard, language, mixing, packing, permutation, quality, toxicity, urls
from touchline.llm.queries import RULES, THRESHOLD

BASE = "http://h.org/a/b/page.html?q=1"
TARGETS = ["x.html", "../x", "../../../x", "./", ".", "..", "?p=2", "/r/./s/../t", "//o.org/y", "https://k.org/z?a=1&b=2", "sub/../x?y=../z", "", "x/..", "/a/.."]


def test_targets_are_resolved_like_urls(spark):
    df = spark.createDataFrame([(BASE, t) for t in TARGETS], "u string, t string")
    got = [r[0] for r in df.select(urls.resolved(F.col("u"), F.col("t"))).collect()]
    want = [urljoin(BASE, t) if t else BASE for t in TARGETS]
    assert got == [re.sub(r"#.*", "", w) for w in want]
    odd = spark.createDataFrame([(BASE, t) for t in ("mailto:a@b", "javascript:x()", "tel:1")], "u string, t string")
    assert all(r[0] is None for r in odd.select(urls.resolved(F.col("u"), F.col("t"))).collect())


def test_every_link_of_a_page_counts(spark):
    page = '<link href="/one" rel=canonical><LINK REL="canonical" HREF="http://m.com/two?a=1&amp;b=2"><meta http-equiv="refresh" content="1;url=../three"><link rel=canonical href=four>'
    rows = [
        (1, "http://m.com/d/e", page), (2, "http://m.com/one", None), (3, "http://m.com/two?a=1&b=2", ""), (4, "http://m.com/three", None), (5, "http://m.com/d/four", None),
        (6, "http://bad.net/x", '<link rel="canonical" href="http://m.com/three">'), (7, "http://m.com/other", "<p>canonical refresh"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(c) for c in ("decision", "node", "blocked", "root", "u", "v")})
    judged = urls.judge(pages, RULES)
    got = {r.page_id: r for r in judged.collect()}
    assert {i: got[i].verdict for i in got} == {1: "block", 2: "block", 3: "block", 4: "block", 5: "block", 6: "block", 7: "allow"}
    assert all(getattr(got[1], c) == c for c in ("decision", "node", "blocked", "root", "u", "v")) and judged.columns == [*pages.columns, "host", "path", "rule", "verdict"]


def test_aliases_against_union_find(spark):
    dealt = np.random.default_rng(12)
    hosts = ["a.net", "example.net", "b.org", "plain.com", "example.com", "c.io"]
    names = [f"http://{hosts[dealt.integers(0, 6)]}/{('en', 'fr', 'de', 'x')[dealt.integers(0, 4)]}/{i}" for i in range(150)]
    links = {i: [names[j] for j in dealt.integers(0, 150, dealt.integers(0, 3))] for i in range(150)}
    html = {i: "".join(f'<link rel="canonical" href="{t}">' for t in links[i]) for i in links}
    root = {n: n for n in names}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for i, targets in links.items():
        for t in targets:
            root[find(names[i])] = find(t)

    def own(url):
        host, path = re.match(r"http://([^/]*)(.*)", url).groups()
        fits = [(len(h + p), a == "block", a) for a, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits)[2] if fits else None

    groups = {}
    for n in names:
        groups.setdefault(find(n), set()).add(own(n))
    want = {i: own(n) or ("block" if "block" in (g := groups[find(n)]) and "allow" not in g else "allow") for i, n in enumerate(names)}
    pages = spark.createDataFrame([(i, n, html[i]) for i, n in enumerate(names)], "page_id long, url string, html string")
    assert {r.page_id: r.verdict for r in urls.judge(pages, RULES).collect()} == want and "block" in {want[i] for i in want if own(names[i]) is None}


def test_query_rows_of_one_id_are_ranked_one_by_one(spark):
    rows = [(100, [1.0, 0.0]), (100, [0.0, 1.0]), (100, [0.0, 1.0]), (1, [2.0, 0.0]), (2, [0.0, 3.0]), (3, [1.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((r["rank"], r.vec_id, r.score) for r in exhaustive.top_k(frame, F.col("vec_id") == 100, 2, 1).collect())
    assert got == [(1, 1, 2), (1, 2, 3), (1, 2, 3), (2, 3, 1), (2, 3, 1), (2, 3, 1)]
    near = permutation.top_k(frame, F.col("vec_id") == 100, 2)
    assert sorted((r["rank"], r.vec_id, r.score) for r in near.collect()) == got and near.columns == ["query_id", "rank", "vec_id", "score"]


@pytest.mark.parametrize("same", ["null ids", "one id", "equal rows"])
def test_repeats_are_divided_by_the_mix(spark, same):
    texts = [" ".join(f"w{i if same != 'equal rows' else 0}_{k}" for k in range(3)) for i in range(40)]
    rows = [(None if same == "null ids" else 7, t, "a") for t in texts] + [(100 + i, "z " * 10, "b") for i in range(61)]
    made = mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    taken = sum(r.mix_times * r.mix_size for r in made if r.source == "a")
    target = next(r.mix_target for r in made if r.source == "a")
    assert len(made) == len(rows) and 0 < target % 120 and abs(taken - target) <= 6


def test_signs_without_letters_have_no_language(spark):
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(["½ ² ⅷ 12", "a", "ª", "中"])], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in language.predict(docs, language.fit(docs, 10**6, 10**6 - 1)).orderBy("doc_id").collect()] == ["und", "en", "en", "en"]


def test_a_row_goes_for_its_own_text(spark):
    x, other = "one two three four five six", "quite another text of its own here"
    rows = [(1, x, 1), (5, x, 2), (5, other, 3), (5, other, 4), (None, x, 5), (None, "alone without any id at all", 6), (None, "alone without any id at all", 7), (None, None, 8), (9, "", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, jaccard_class long")
    kept = jaccard.keep_one(docs)
    left = sorted((str(r.doc_id), str(r.text)) for r in kept.collect())
    assert left == sorted([("1", x), ("5", other), ("None", "alone without any id at all"), ("None", "None"), ("9", "")]) and kept.columns == docs.columns


# -- classifiers ---------------------------------------------------------------------

TOXIC = ["You loser!", "a loser É x", "nice words", "fine, nice words", "you Loser you", "nice", None, "", "loser 中文", "words 中文 nice"]
MARKS = [1, 1, 0, 0, 1, 0, 0, 1, 1, 0]


def plain_ngrams(text):
    low = "".join((c.lower() if len(c.lower()) == 1 and c.lower().isalnum() else " ") if ord(c) < 0x250 else c for c in text or "")
    return {low[i : i + k] for k in toxicity.SIZES for i in range(len(low) - k + 1)}


def test_toxicity_fit_against_plain_python():
    sets, y, n = [plain_ngrams(t) for t in TOXIC], MARKS, len(MARKS)
    pos, ratio = sum(y), {}
    for g in sorted(set().union(*sets)):
        p, q = sum(g in s and m for s, m in zip(sets, y, strict=True)), sum(g in s and not m for s, m in zip(sets, y, strict=True))
        r = math.log((p + 1) / (pos + 2)) - math.log((q + 1) / (n - pos + 2))
        if abs(r) >= toxicity.MIN_RATIO and p + q >= toxicity.LEAST_TEXTS:
            ratio[g] = r
    assert len(ratio) > 10
    w, bias = dict.fromkeys(ratio, 0.0), math.log(pos / (n - pos))
    m, v, mb, vb = dict.fromkeys(ratio, 0.0), dict.fromkeys(ratio, 0.0), 0.0, 0.0
    for step in range(1, toxicity.STEPS + 1):
        error = [1 / (1 + math.exp(-(bias + sum(w[g] * ratio[g] for g in s if g in ratio)))) - t for s, t in zip(sets, y, strict=True)]
        slope = {g: sum(e * ratio[g] for e, s in zip(error, sets, strict=True) if g in s) / n + toxicity.RIDGE * w[g] / n for g in ratio}
        for g in ratio:
            m[g], v[g] = 0.9 * m[g] + 0.1 * slope[g], 0.99 * v[g] + 0.01 * slope[g] ** 2
            w[g] -= 0.1 * (m[g] / (1 - 0.9**step)) / (math.sqrt(v[g] / (1 - 0.99**step)) + 1e-8)
        mb, vb = 0.9 * mb + 0.1 * sum(error) / n, 0.99 * vb + 0.01 * (sum(error) / n) ** 2
        bias -= 0.1 * (mb / (1 - 0.9**step)) / (math.sqrt(vb / (1 - 0.99**step)) + 1e-8)
    model = toxicity.fit_texts(pa.array(TOXIC, pa.string()), np.array(y))
    asked = [*TOXIC, "another loser with nice words", "É中文"]
    want = [1 / (1 + math.exp(-(bias + sum(w[g] * ratio[g] for g in plain_ngrams(t) if g in ratio)))) for t in asked]
    np.testing.assert_allclose(model.score(pa.array(asked, pa.string()), toxicity.features), want, atol=1e-6)


def plain_words(text):
    found = re.findall(r"(?:[0-9A-Za-z]|[^\x00-\x7f])+|(?:(?![0-9A-Za-z])[\x00-\x08\x0e-\x1f!-\x7f])+", text or "")
    marked = ["again" if i and found[i - 1] == x else f"={x}" for i, x in enumerate(found)]
    return {tuple(marked[i : i + k]) for k in (1, 2, 3) for i in range(len(marked) - k + 1)}


def test_quality_fit_against_plain_python():
    texts = ["good text here", "bad bad bad", "Good text, good", "bad spam !! !! spam", "some good text é", None, "spam spam", "text here good."] * 3
    marks = [1, 0, 1, 0, 1, 0, 0, 1] * 3
    z, n = {}, {}

    def weight(f):
        l1 = 0.0 if f == "bias" else quality.L1
        zi, ni = z.get(f, 0.0), n.get(f, 0.0)
        return 0.0 if abs(zi) <= l1 else (math.copysign(l1, zi) - zi) / ((quality.BETA + math.sqrt(ni)) / quality.ALPHA + quality.L2)

    for _ in range(quality.EPOCHS):
        for t, y in zip(texts, marks, strict=True):
            own = {f: weight(f) for f in [*plain_words(t), "bias"]}
            g = 1 / (1 + math.exp(-sum(own.values()))) - y
            for f, w in own.items():
                ni = n.get(f, 0.0)
                z[f] = z.get(f, 0.0) + g - (math.sqrt(ni + g * g) - math.sqrt(ni)) / quality.ALPHA * w
                n[f] = ni + g * g
    model = quality.fit_texts(pa.array(texts, pa.string()), np.array(marks))
    asked = ["good text", "spam", "", None, "bad good", "new words", "é é é here."]
    want = [1 / (1 + math.exp(-sum(weight(f) for f in [*plain_words(t), "bias"]))) for t in asked]
    np.testing.assert_allclose(model.score(pa.array(asked, pa.string()), quality.features), want, atol=1e-6)
    assert len(set(np.round(want, 6))) > 3


def test_long_texts_in_parts_give_the_same(spark, monkeypatch):
    dealt = np.random.default_rng(2)
    words = ["alpha", "Beta", "ÉÉ", "中文字", "!!", "x" * 90, "gamma,", "delta"]
    texts = [" ".join(dealt.choice(words, k)) for k in (3, 400, 900)] + ["ÉÉ中" * 200]
    labels = np.array([0, 1, 0, 1])
    models = [m.fit_texts(pa.array(texts * 3), np.tile(labels, 3)) for m in (toxicity, quality)]
    frame = spark.createDataFrame([(i, t, f"l{i % 2}") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    tongue = language.fit(frame, 10**6, 10**6 - 1)
    whole = [m.score(pa.array(texts), x.features) for m, x in zip(models, (toxicity, quality), strict=True)], tongue.lengths(pa.array(texts))
    sets = [v.tolist() for _, v in jaccard.shingle_sets(pa.array(texts), 4)]
    for module in (common, toxicity, language):
        monkeypatch.setattr(module, "CHUNK_BYTES", 100)
    again = [m.score(pa.array(texts), x.features) for m, x in zip(models, (toxicity, quality), strict=True)], tongue.lengths(pa.array(texts))
    np.testing.assert_allclose(again[0], whole[0], atol=1e-9)
    np.testing.assert_allclose(again[1], whole[1], rtol=1e-5)
    assert [v.tolist() for _, v in jaccard.shingle_sets(pa.array(texts), 4)] == sets
    refit = [m.fit_texts(pa.array(texts * 3), np.tile(labels, 3)) for m in (toxicity, quality)]
    for a, b in zip(models, refit, strict=True):
        np.testing.assert_allclose(a.weights, b.weights, atol=1e-6)


# -- the pipeline, each stage on the rows that the one before wrote --------------------


def plain_score(model, features, text):
    found = set()
    for _, _, data, offsets in common.text_chunks(pa.array([text], pa.string())):
        for _, index in features(data, offsets, model.bits):
            found.update(index.tolist())
    return 1 / (1 + math.exp(-(model.bias + sum(float(model.weights[i]) for i in found))))


def plain_mix(rows):
    sizes, copies, told = {}, {}, []
    for r in rows:
        size = len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        sizes[r.source] = sizes.get(r.source, 0) + size
        k = copies[r.doc_id, r.text] = copies.get((r.doc_id, r.text), -1) + 1
        name = f"mix:{'' if r.doc_id is None else r.doc_id}:{k}:{r.text or ''}"
        told.append((r, size, int(hashlib.md5(name.encode()).hexdigest()[:5], 16)))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, free, target = {s: i % 3 + 1.0 for i, s in enumerate(order)}, set(order), {}
    left = float(sum(sizes.values()))
    while True:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if 3 * sizes[s] < level * weight[s]}
        if not over:
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        free -= over
    target |= {s: level * weight[s] for s in free}
    out = []
    for s in order:
        own = [(u, size, r) for r, size, u in told if r.source == s]
        times = int(target[s] / sizes[s]) if sizes[s] else 0
        want, so_far, stop = target[s] - times * sizes[s], 0, 0
        for hi in range(1024):
            inside = sum(size for u, size, _ in own if u // 1024 == hi)
            if so_far + inside > want:
                upto, stop = so_far, hi * 1024
                for lo in range(1024):
                    n = sum(size for u, size, _ in own if u == hi * 1024 + lo)
                    upto += n
                    if n and upto - n / 2 <= want:
                        stop = hi * 1024 + lo + 1
                break
            so_far += inside
        out += [(r.doc_id, r.text) for u, size, r in own if size for _ in range(min(3, times + (u < stop)))]
    return out


def test_pipeline_stage_by_stage(spark, sf):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    for (name, stage), module, mark in zip(p.STAGES[:2], (toxicity, quality), (("toxic", 4, 2), ("quality", 5, 0)), strict=True):
        model, rows = module.fit(docs, labels, *mark), docs.collect()
        keep = (lambda s: s < THRESHOLD) if name == "toxicity" else (lambda s: s >= THRESHOLD)
        want = sorted(r.doc_id for r in rows if keep(plain_score(model, module.features, r.text)))
        docs = common.saved(stage(spark, docs, sf))
        assert sorted(r.doc_id for r in docs.collect()) == want and 0 < len(want) < len(rows)
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    groups = brute_components(texts, 5, 80)
    docs = common.saved(p.STAGES[2][1](spark, docs, sf))
    assert sorted(r.doc_id for r in docs.collect()) == sorted(d for d, (_, c) in groups.items() if c == d) and len(groups) > docs.count()
    want = plain_mix(docs.collect())
    docs = common.saved(p.STAGES[3][1](spark, docs, sf))
    assert sorted((r.doc_id, r.text) for r in docs.collect()) == sorted(want)
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    check_packing(p.STAGES[4][1](spark, docs, sf).collect(), texts)


@pytest.mark.parametrize("at, module, operator", [(0, toxicity, "fit"), (0, toxicity, "score"), (1, quality, "fit"), (1, quality, "score"), (2, jaccard, "keep_one"), (4, packing, "pieces")])
def test_pipeline_stages_read_texts_in_batches_of_bytes(spark, tmp_path, monkeypatch, at, module, operator):
    """Every operator that hands whole texts to Python gets them about a megabyte at a time, none left out or cut; also once the stage has returned."""
    import corpus_pipeline as p

    docs = spark.range(4000, numPartitions=1).select(F.col("id").alias("doc_id"), F.expr("repeat('0123456789', 200)").alias("text"))
    docs.select("doc_id", F.lit(0).alias("toxic"), F.lit(1).alias("quality")).write.parquet(f"{tmp_path}/labels.parquet")
    read = []

    def told(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows], "size": [b.nbytes]})

    def instead(given, *_, **__):
        read.append(given.select("doc_id", "text").mapInArrow(told, "n long, size long"))
        read.append(read[0].collect())
        raise InterruptedError

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.unset(name)
        if operator == "score":
            monkeypatch.setattr(module, "fit", lambda *_, **__: None)
        monkeypatch.setattr(module, operator, instead)
        with pytest.raises(InterruptedError):
            p.STAGES[at][1](spark, docs, str(tmp_path))
        for rows in (read[1], read[0].collect()):
            assert sum(r["n"] for r in rows) == 4000 and sum(r["size"] for r in rows) >= 8_000_000
            assert max(r["size"] for r in rows) < 2 * p.BATCH_BYTES
    finally:
        spark.conf.set(name, before)
