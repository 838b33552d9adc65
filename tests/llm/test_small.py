"""Each operator against brute force on small tables with nulls, empty and long texts, ties, repeats and extra columns."""

from __future__ import annotations

import base64
import gzip
import hashlib
import itertools
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pytest
from pyspark.sql import functions as F

from seekframe.llm import ann, bpe, html_extract, lang_id, mixing, near_dup, rolling, runtime, suffix_dedup, topk, url_filter, warc
from seekframe.llm.catalog import TOKENIZER, URL_RULES
from seekframe.llm.runtime import new_path, utf8_chunks


def docs(spark, rows):
    """doc_id, text, lang, source, n_chars, and columns whose names the operators use inside."""
    full = [(i, t, lang, source, len(t or "")) for i, t, lang, source in rows]
    df = spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return df.withColumns({c: F.lit("x") for c in ("id", "t", "k1", "row", "size", "node", "key", "kept")})


# ---- helpers


def test_prefix_hashes_and_common_extensions():
    data = np.frombuffer(b"abcabcabdabc", np.uint8)
    p = rolling.prefix_hash(data)
    same = rolling.span_hash(p, np.array([0, 3, 9]), np.array([3, 6, 12]))
    assert len(set(same.tolist())) == 1
    assert rolling.common_extension(p, np.array([0]), np.array([3]), np.array([9])).tolist() == [5]


def test_chunks_hold_all_rows():
    texts = pa.array(["ab", None, "", "é" * 10, "z"])
    seen = [bytes(d[o[i] : o[i + 1]]).decode() for a, b, d, o in utf8_chunks(texts, 4) for i in range(b - a)]
    assert seen == ["ab", "", "", "é" * 10, "z"]


def test_tables_left_behind_can_be_deleted(spark):
    table = runtime.materialise(spark.range(3), "left-behind")
    path = table.inputFiles()[0].removeprefix("file://")
    assert os.path.exists(path)
    assert runtime.clean(spark) >= 1 and not os.path.exists(path)


# ---- 1 language identification


def sentences(words, n, seed):
    rng = random.Random(seed)
    return [" ".join(rng.choice(words) for _ in range(30)) for _ in range(n)]


def test_lang_id(spark):
    en = sentences("the and of that with this from where there thing".split(), 40, 1)
    fr = sentences("le de que les dans pour avec être où ça".split(), 40, 2)
    rows = [(i, t, "en" if t in set(en) else "fr", "s") for i, t in enumerate([*en, *fr])]
    rows += [(1000, None, "en", None), (1001, "", "fr", "s"), (1002, "123 !!", "en", "s"), (None, "the thing", None, "s"), (1003, "où ça " * 5000, None, "s"), (1003, "où ça " * 5000, None, "s"), (1004, "漢字仮名交じり文", None, "s")]
    got = lang_id.identify(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1
    assert all(by[i][0]["lang_pred"] == lang for i, _, lang, _ in rows[:80])
    assert all(by[i][0]["lang_pred"] == "und" and by[i][0]["rejected"] for i in (1000, 1001, 1002))
    assert [r["lang_pred"] for r in by[1003]] == ["fr", "fr"] and by[None][0]["lang_pred"] == "en"
    assert by[1004][0]["score"] < min(r["score"] for i in range(80) for r in by[i]) / 2
    kept = lang_id.keep_identified(docs(spark, rows))
    assert kept.columns == docs(spark, rows).columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r["doc_id"]) for r in got if not r["rejected"])


def test_far_texts_are_rejected():
    counts = np.zeros((9, lang_id.DIM))
    counts[:8, :40] = np.random.default_rng(1).integers(1, 5, (8, 40))
    counts[8, 100:140] = 3
    model = lang_id.fit_model(["en"] * 4 + ["fr"] * 4, counts[:8], 2)
    assert model.predict(counts)[2].tolist() == [False] * 8 + [True]


def test_junk_and_unlearned_languages_are_rejected(spark, sf_dir):
    known = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    code = "def run(x):\n    for i in range(10):\n        if x[i] > 0:\n            return x[i] + 1\n    raise ValueError(x)\n"
    polish = "wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw są oni obdarzeni rozumem i sumieniem "
    raw = random.Random(5).randbytes(3000)
    junk = [base64.b64encode(raw).decode(), raw.hex(), code * 20, polish * 20]
    short = known.where("length(text) > 200 AND lang = 'en'").limit(40).select((F.col("doc_id") + 20_000_000).alias("doc_id"), F.substring("text", 1, 60).alias("text"), F.lit(None).cast("string").alias("lang"), "source")
    rows = known.unionByName(docs(spark, [(10_000_000 + i, t, None, "s") for i, t in enumerate(junk)]).select(*known.columns)).unionByName(short)
    got = lang_id.identify(rows).toPandas()
    assert got[got["doc_id"].between(10_000_000, 19_999_999)]["rejected"].tolist() == [True] * 4
    assert got[got["doc_id"] >= 20_000_000]["rejected"].mean() <= 0.1
    assert got[got["doc_id"] < 10_000_000]["rejected"].mean() <= 0.03


def test_lang_id_empty_and_unlabelled(spark):
    assert lang_id.identify(docs(spark, [(1, "a", "en", "s")]).where("false")).count() == 0
    assert [r["lang_pred"] for r in lang_id.identify(docs(spark, [(1, "a b", None, "s")])).collect()] == ["und"]


def test_lang_id_held_out_accuracy(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = lang_id.identify(d).where("held_out").join(d.select("doc_id", "lang"), "doc_id").toPandas()
    assert (got["lang_pred"] == got["lang"]).mean() > 0.97


# ---- 2 mixing


def water_fill(sizes, weights, most):
    target = dict.fromkeys(sizes, 0.0)
    capped: set = set()
    total = sum(sizes.values())
    while True:
        rest = total - sum(most * sizes[s] for s in capped)
        free = sum(weights[s] for s in sizes if s not in capped)
        for s in sizes:
            target[s] = most * sizes[s] if s in capped else rest * weights[s] / free
        new = {s for s in sizes if s not in capped and target[s] > most * sizes[s]}
        if not new:
            return target
        capped |= new


def test_mix_targets_and_bounds(spark):
    rng = random.Random(4)
    rows = [(i, " ".join("w" * rng.randrange(1, 9) for _ in range(rng.randrange(0, 30))), "en", rng.choice(["a", "a", "a", "b", "c", None])) for i in range(400)]
    rows += [(500, None, "en", "a"), (501, "", "en", "é"), (502, "x " * 3000, "en", "d"), (503, "same text", "en", "b"), (503, "same text", "en", "b"), (None, "a b", "en", "b")]
    got = mixing.mix(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    size = lambda t: len((t or "").split())
    sizes: Counter = Counter()
    for _, t, _, s in rows:
        sizes[s] += size(t)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    expected = water_fill(dict(sizes), {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, 3)
    source = {i: s for i, _, _, s in rows}
    taken: Counter = Counter()
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(expected[s])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - expected[s]) <= 1 for s in sizes)
    again = mixing.mix(docs(spark, rows[::-1])).collect()
    key = lambda rs: sorted((str(r["doc_id"]), r["taken"]) for r in rs)
    assert key(got) == key(again)


def test_mix_rows_repeat_as_decided(spark):
    rows = [(i, f"w{i} " * 10, "en", "a" if i < 90 else "b") for i in range(100)]
    d = docs(spark, rows)
    out = mixing.materialise_mix(d)
    assert out.columns == d.columns
    counts = Counter(r["doc_id"] for r in out.collect())
    assert max(counts.values()) == 3 and all(counts[i] == 3 for i in range(90, 100)) is (mixing.mix(d).where("doc_id >= 90 AND copies = 3").count() == 10)
    assert mixing.mix(d.where("false")).count() == 0


# ---- 3 suffix-array deduplication


def brute_repeats(texts, w):
    bs = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + w] for b in bs for i in range(len(b) - w + 1))
    out = []
    for b in bs:
        gone = bytearray(len(b))
        for i in range(len(b) - w + 1):
            if count[b[i : i + w]] > 1:
                gone[i : i + w] = b"\1" * w
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize(("seed", "bucket"), [(1, 1500), (2, 40)])
def test_suffix_dedup_is_exact(spark, monkeypatch, seed, bucket):
    monkeypatch.setattr(suffix_dedup, "BUCKET", bucket)
    rng, w = random.Random(seed), 24
    base = ["".join(rng.choice("abcé ") for _ in range(300)) for _ in range(5)]
    texts: list = [None, "", "a" * 200, "ab" * 100, "a" * 23, "a" * 24, "x" * 5000]
    for _ in range(200):
        t = rng.choice(base)
        k = rng.random()
        if k < 0.3:
            i = rng.randrange(len(t))
            t = t[:i] + rng.choice("xyz") + t[i:]
        elif k < 0.6:
            i = rng.randrange(250)
            t = "".join(rng.choice("defg") for _ in range(rng.randrange(80))) + t[i : i + rng.randrange(20, 60)] + rng.choice(base)[i : i + 30]
        elif k < 0.7:
            t = "".join(rng.choice("mnop") for _ in range(100))
        texts.append(t)
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    rows += [(9, texts[9], "en", "s"), (None, "zz" * 30, "en", None)]
    got = suffix_dedup.remove_repeats(docs(spark, rows), w)
    assert got.columns[:13] == docs(spark, rows).columns
    mine = sorted((str(r["doc_id"]), r["dedup_bytes"], r["dedup_removed"], r["dedup_spans"], r["dedup_sha256"]) for r in got.collect())
    assert mine == sorted((str(r[0]), *x) for r, x in zip(rows, brute_repeats([r[1] for r in rows], w), strict=True))


def brute_flags(texts, w):
    bs = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + w] for b in bs for i in range(len(b) - w + 1))
    out = []
    for b in bs:
        gone = bytearray(len(b))
        for i in range(len(b) - w + 1):
            if count[b[i : i + w]] > 1:
                gone[i : i + w] = b"\1" * w
        out.append(gone)
    return out


def brute_passages(text, gone, words):
    """(first, end) of the whole words of each run of ``gone`` that has more than ``words`` of them."""
    b, out, at = (text or "").encode(), [], 0
    inside = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", b)]
    while at < len(b):
        end = at
        while end < len(b) and gone[end]:
            end += 1
        own = [(x, y) for x, y in inside if at <= x and y <= end]
        if end > at and len(own) > words:
            out.append((own[0][0], own[-1][1]))
        at = max(end, at) + 1
    return out


def passage_texts():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(2, 8)))
    some = lambda n: " ".join(word() for _ in range(n))
    passages = [some(n) for n in (49, 50, 51, 55, 60, 80, 200)]
    texts: list = [None, "", " \n ", "the " * 400, "\u00a0" * 300]
    for p in passages:
        texts += [some(40) + "\n" + p + "\n" + some(rng.randrange(1, 60)) for _ in range(3)]
        texts.append(p)
    texts += [some(rng.randrange(1, 300)) for _ in range(30)]
    texts += [texts[-1], texts[-2]]
    return texts


def test_passages_and_strings_are_exact(spark):
    texts = passage_texts()
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)] + [(7, texts[7], "en", "s")]
    texts = [r[1] for r in rows]
    got = suffix_dedup.repeats(docs(spark, rows), 400, (240, 50))
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages", "passage_bytes"]
    expected = []
    for (i, t, *_), whole, flags in zip(rows, brute_repeats(texts, 400), brute_flags(texts, 240), strict=True):
        spans = brute_passages(t, flags, 50)
        expected.append((i, *whole, len(spans), sum(b - a for a, b in spans)))
    assert sorted(tuple(r) for r in got.collect()) == sorted(expected)
    assert sum(x[-2] for x in expected) >= 15
    assert suffix_dedup.repeats(docs(spark, rows).where("false"), 400, (240, 50)).count() == 0


def test_only_passages_of_many_words_go(spark):
    texts = passage_texts()
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    got = {r["doc_id"]: r["dedup_text"] for r in suffix_dedup.remove_repeats(docs(spark, rows), 240, words=50).collect()}
    for (i, t, *_), flags in zip(rows, brute_flags(texts, 240), strict=True):
        left = bytearray((t or "").encode())
        for a, b in reversed(brute_passages(t, flags, 50)):
            del left[a:b]
        assert got[i] == left.decode("utf-8", "ignore")


def test_suffix_dedup_empty(spark):
    assert suffix_dedup.remove_repeats(docs(spark, [(1, "a", "en", "s")]).where("false"), 24).count() == 0


def test_suffix_sort_and_mergesort():
    rng = np.random.default_rng(0)
    data = rng.integers(97, 99, 2000).astype(np.uint8)
    start = rng.permutation(1900)[:300]
    length = np.minimum(50, 2000 - start)
    order, shared = suffix_dedup.suffix_sort(data, start, length)
    text = [data[s : s + n].tobytes() for s, n in zip(start, length, strict=True)]
    assert [text[i] for i in order] == sorted(text)
    for k in range(1, len(order)):
        a, b = text[order[k - 1]], text[order[k]]
        n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert shared[k] == n


# ---- 4 and 10 vector searches


def vectors(spark, n=300, d=8, seed=1):
    rng = np.random.default_rng(seed)
    v = rng.standard_normal((n, d)).round(2)
    v[10:40] = v[5]
    v[50] = 0
    rows = [(i, [float(x) for x in row]) for i, row in enumerate(v)]
    rows += [(1000, None), (1001, [1.0, None, *[0.0] * (d - 2)]), (1002, [float("nan")] * d), (1003, [float("inf")] * d), (1004, []), (None, [1.0] * d), (1020, [2.0] * d)]
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumns({"id": F.lit(1), "shard": F.lit(2), "label": F.lit(0)}), rows


def exact(rows, zero, quantise=None):
    fine = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and (zero or any(v))]
    if quantise:
        fine = [(i, np.floor(v * quantise)) for i, v in fine]
    out = {}
    for q, qv in fine:
        if q % 20 == 0:
            out[q] = sorted(((-float(v @ qv), i) for i, v in fine if i != q))[:20]
    return out


def test_top_k_is_exact(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 60)
    df, rows = vectors(spark)
    want = exact(rows, True, 64)
    got = defaultdict(dict)
    for r in topk.top_k(df, F.col("vec_id") % 20 == 0, 20).collect():
        got[r["query_id"]][r["rank"]] = (-r["score"], r["vec_id"])
    assert {q: [x for _, x in sorted(g.items())] for q, g in got.items()} == {q: [(int(s), i) for s, i in w] for q, w in want.items()}


def test_ann_finds_the_nearest(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD_ROWS", 120)
    df, rows = vectors(spark)
    want = exact(rows, False)
    got = defaultdict(list)
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0, 20, least=40).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((-r["score"], r["vec_id"]))
    assert set(got) == set(want)
    for q, found in got.items():
        assert found == sorted(found, key=lambda x: (round(x[0], 9), x[1])) and len({i for _, i in found}) == len(found) == 20
    recall = np.mean([len({i for _, i in got[q]} & {i for _, i in want[q]}) / 20 for q in want])
    assert recall >= 0.9


@pytest.mark.parametrize("n", [700, 2500, 9000])
def test_forest_recall_where_it_does_not_look_at_all(n):
    rng = np.random.default_rng(1)
    points = rng.standard_normal((n, 64))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    forest, wanted = ann.Forest(points), max(ann.LEAST, int(ann.FRACTION * n))
    found = []
    for q in points[:: n // 30]:
        met = forest.candidates(forest.units @ q, wanted)
        assert min(n, wanted) <= len(met) <= wanted + ann.STEP * forest.rows.shape[1]
        found.append(len(set(np.argsort(-(points @ q))[:20]) & set(met)) / 20)
    assert np.mean(found) >= 0.9
    assert len(forest.candidates(forest.units @ q, n + 1)) == n


def test_scores_beyond_doubles_are_exact(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 50)
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-(2**24), 2**24, 6)]) for i in range(300)]
    rows += [(i, [x + float(j) / 64 for x in rows[0][1]]) for i, j in ((400, 1), (401, 1), (402, 2), (403, 0))]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    whole = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in rows]
    got = defaultdict(list)
    for r in topk.top_k(df, F.col("vec_id") % 20 == 0, 20).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((-r["score"], r["vec_id"]))
    for q, v in whole:
        if q % 20 == 0:
            assert got[q] == sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in whole if i != q)[:20]


def test_an_index_serves_all_queries_and_bounds_tighten(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.standard_normal(6)]) for i in range(400)] + [(i, [1.0, 2.0]) for i in range(400, 420)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    want = exact([r for r in rows if len(r[1]) == 6], True, 64)
    for block in (1 << 18, 7):
        monkeypatch.setattr(topk.vs, "BLOCK_ROWS", block)
        monkeypatch.setattr(topk, "SHARD_ROWS", 30)
        got = defaultdict(list)
        for r in topk.top_k(df, F.col("vec_id") % 20 == 0, 20).orderBy("query_id", "rank").collect():
            got[r["query_id"]].append((-r["score"], r["vec_id"]))
        assert got.pop(400) == [(-(64 * 64 + 128 * 128), i) for i in range(401, 420)]
        assert got == {q: [(int(s), i) for s, i in w] for q, w in want.items()}


def test_searches_with_few_or_no_candidates(spark):
    df, _ = vectors(spark)
    for search in (ann.nearest, topk.top_k):
        assert search(df.where("vec_id IN (0, 1, 2)"), F.col("vec_id") % 20 == 0, 20).count() == 2
        assert search(df.where("false"), F.col("vec_id") % 20 == 0, 20).count() == 0


# ---- 5 near-duplicates


def shingles(t, w=5):
    x = (t or "").lower().split()
    return Counter(tuple(x[i : i + w]) for i in range(len(x) - w + 1)) if len(x) >= w else Counter([tuple(x)] if x else [])


def similarity(a, b):
    both, either = set(a) & set(b), set(a) | set(b)
    if not both:
        return 0.0
    p = sum(1 / sum(max(a[e] / a[d], b[e] / b[d]) for e in either) for d in both)
    return max(p, len(both) / len(either))


def brute_classes(rows):
    sets = [shingles(t) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and (rows[i][1] == rows[j][1] or similarity(sets[i], sets[j]) >= 0.8):
                parent[find(i)] = find(j)
    best: dict = {}
    for i, r in enumerate(rows):
        key = (r[0] is None, r[0] or 0)
        best[find(i)] = min(best.get(find(i), key), key)
    return sorted((str(r[0]), str(None if best[find(i)][0] else best[find(i)][1])) for i, r in enumerate(rows))


def test_near_dup_classes(spark):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(500)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randrange(60, 120))] for _ in range(12)]
    rows: list = []
    for i in range(120):
        t = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
            t[rng.randrange(len(t))] = rng.choice(vocabulary)
        rows.append((i, " ".join(t), "en", "s"))
    rows += [(200, None, "en", "s"), (201, "", "en", "s"), (202, "one two", "en", "s"), (203, "One TWO", "en", "s"), (204, "rep " * 300, "en", "s"), (205, "rep " * 200, "en", "s"), (5, rows[5][1], "en", "s"), (None, rows[6][1], "en", "s"), (206, " ".join(f"u{i}" for i in range(8000)), "en", "s")]
    d = docs(spark, rows)
    got = near_dup.classes(d).collect()
    assert sorted((str(r["id"]), str(r["class_id"])) for r in got) == brute_classes(rows)
    kept = near_dup.keep_one(d)
    assert kept.columns == d.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(ids) == sorted({r["class_id"] for r in got} - {200, 201} | {200, 201}) and len(ids) == len(set(ids))
    assert near_dup.classes(d.where("false")).count() == near_dup.keep_one(d.where("false")).count() == 0


def test_signatures_estimate_probability_jaccard():
    rng = random.Random(3)
    a = " ".join(rng.choice("abcdefgh") for _ in range(60))
    b = a[:80] + " ".join(rng.choice("abcdefgh") for _ in range(20))
    from seekframe.llm.shingles import ID_BITS, shingle_counts

    _, _, data, at = next(utf8_chunks(pa.array([a, b]), 1 << 40))
    keys, weight = shingle_counts(data, at, 2)
    sig = near_dup.prob_min_hash((keys >> rolling.U(ID_BITS)).astype(np.int64), rolling.mix(keys & rolling.U((1 << ID_BITS) - 1)), weight.astype(float), 2, 4000)
    x, y = shingles(a, 2), shingles(b, 2)
    either = set(x) | set(y)
    p = sum(1 / sum(max(x[e] / x[d], y[e] / y[d]) for e in either) for d in set(x) & set(y))
    assert abs((sig[0] == sig[1]).mean() - p) < 0.04


def test_tasks_of_a_band_are_bounded_and_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 20)
    rng = random.Random(11)
    base = [[f"w{rng.randrange(400)}" for _ in range(40)] for _ in range(60)]
    texts = [" ".join([*b, f"end{j}"]) for b in base for j in range(5)]
    node = [hashlib.md5(t.encode()).digest() for t in texts]
    # one band of 300 texts, 280 of which stand apart from the hub's class
    label = [node[0] if i < 20 else node[i] for i in range(300)]
    rest = spark.createDataFrame([(bytearray(n), 1, bytearray(k), 300, bytearray(node[0])) for n, k in zip(node, label, strict=True)], "node binary, band bigint, label binary, n bigint, hub_label binary")
    table = spark.createDataFrame([(bytearray(n), t) for n, t in zip(node, texts, strict=True)], "node binary, t string")
    sets = [shingles(t) for t in texts]
    wanted = {(min(node[i], node[j]), max(node[i], node[j])) for i in range(300) for j in range(i) if label[i] != label[j] and similarity(sets[i], sets[j]) >= 0.8}
    got = {(bytes(r["a"]), bytes(r["b"])) for r in near_dup._closed(rest, table, 5, 0.8).collect()}
    assert got == wanted and len(got) == 560

    def sizes(width, least):
        return lambda part: pa.table({"a": pa.array([os.urandom(8)], pa.binary()), "b": pa.array([part.num_rows.to_bytes(8, "big")], pa.binary())})

    monkeypatch.setattr(near_dup, "_links_within", sizes)
    assert max(int.from_bytes(r["b"], "big") for r in near_dup._closed(rest, table, 5, 0.8).collect()) < 5 * near_dup.BLOCK


def test_text_numbers_beyond_the_key():
    from seekframe.llm.shingles import packed, shingles_of

    texts = pa.array([f"word number {i}" for i in range(70_000)])
    number, shingle, count = shingles_of(texts, 5)
    assert number.tolist() == list(range(70_000)) and len(set(shingle.tolist())) == 70_000 and set(count.tolist()) == {1}
    with pytest.raises(OverflowError):
        packed(number, shingle)


# ---- 6 url rules


def brute_rule(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        tail = rest[cut:]
        path = tail[: min([tail.index(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [(len(h) + len(p), len(h), h + p, v) for v, h, p in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else default


@pytest.mark.parametrize("local", [100_000, 3])
def test_url_rules(spark, local):
    rng = random.Random(2)
    hosts = ["example.com", "WWW.Example.com", "a.www.example.com", "notexample.com", "x.net", "net", "com", "b.org", "", "example.com.", "É.com"]
    urls = [rng.choice(["http", "https", ""]) + rng.choice(["://", ":/"]) + rng.choice(hosts) + rng.choice(["", "/", "/en", "/en/", "/en/a", "/es/x/", "/fr/", "/en/a/b"]) + rng.choice(["", "?q=/en/", "#x"]) for _ in range(300)]
    urls += [None, "", "://", "x://" + "a" * 5000, "http://a\nb.com/en/"]
    rules = [*URL_RULES, ("block", "com", "/en/a/"), ("allow", "example.com", "/en/a"), ("block", "a.www.example.com", "/")]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").withColumns({"host": F.lit(1), "rule": F.lit("r"), "pair": F.lit(0)})
    table = spark.createDataFrame(rules, "verdict string, host string, path string") if local == 3 else rules
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(df, table, local_rules=local).collect()}
    assert got == {i: brute_rule(u, rules) for i, u in enumerate(urls)}
    assert url_filter.judge_urls(df, []).where("rule IS NOT NULL").count() == 0
    assert url_filter.judge_urls(df.where("false"), rules).count() == 0


# ---- 7 WARC


def test_warc_round_trip(spark):
    rows = [(1, "http://a", "same"), (2, "http://b", "same"), (3, "http://c", "é" * 100_000), (4, None, None), (5, "http://e", ""), (6, "http://f", "same"), (6, "http://f", "same"), (None, "http://n", "only"), (7, "http://x\r\n\r\ny", "WARC/1.1\r\n\r\n")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumns({"payload": F.lit(0), "digest": F.lit(1), "row": F.lit(2)})
    folder = new_path(spark, "warc-test")
    warc.archive(df.repartition(3), folder)
    got = warc.load(spark, folder).collect()
    assert len(got) == len(rows)
    sha = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    text = {i: t for i, _, t in rows}
    for r in got:
        assert r["payload_digest"] == sha(text[r["page_id"]]) and r["payload_bytes"] == len((text[r["page_id"]] or "").encode())
        assert (r["payload"] is None) == (r["record_type"] == "revisit")
        if r["payload"] is not None:
            assert bytes(r["payload"]) == (text[r["page_id"]] or "").encode()
    kinds = sorted((str(r["page_id"]), r["record_type"], r["refers_to"] or "") for r in got)
    assert kinds == sorted([("1", "revisit", "<urn:page:6>"), ("2", "revisit", "<urn:page:6>"), ("3", "response", ""), ("4", "revisit", "<urn:page:5>"), ("5", "response", ""), ("6", "response", ""), ("6", "revisit", "<urn:page:6>"), ("None", "response", ""), ("7", "response", "")])
    heads = warc.load(spark, folder, ["page_id", "record_type"]).where("record_type = 'revisit' AND page_id IN (1, 2)")
    assert sorted(r["page_id"] for r in heads.collect()) == [1, 2]
    sums = warc.load(spark, folder).where("record_type = 'response'").select("payload_digest", warc.base32_sha1(F.col("payload")).alias("again")).collect()
    assert all(r["payload_digest"] == r["again"] for r in sums)


def test_warc_pushdown_skips_payloads(spark, monkeypatch):
    reader = warc.WarcReader("file:///tmp", spark.createDataFrame([], "record_type string").schema)
    from pyspark.sql.datasource import EqualTo, GreaterThan

    left = [*reader.pushFilters([EqualTo(("record_type",), "response"), GreaterThan(("page_id",), 3)])]
    assert left == [GreaterThan(("page_id",), 3)]
    assert reader.passes({"record_type": "response"}) and not reader.passes({"record_type": "revisit"})


def test_warc_short_payloads_and_empty_table(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab")], "page_id bigint, url string, html string")
    folder = new_path(spark, "warc-test")
    warc.archive(df, folder, least=3)
    assert {r["record_type"] for r in warc.load(spark, folder).collect()} == {"response"}
    folder = new_path(spark, "warc-test")
    warc.archive(df.where("false"), folder)
    assert warc.load(spark, folder).count() == 0


def test_a_hot_payload_and_repeated_rows(spark):
    rng = random.Random(4)
    rows = [(i, f"http://h/{i % 7}", rng.choice(["", "", None, "hot " * 500, f"own {i}", f"pair {i // 2}"])) for i in range(1500)]
    rows += [(7, "http://x", "hot " * 500), (1499, None, "hot " * 500), (None, "u", "lonely"), (None, "u", "lonely"), (None, "v", "lonely"), (-5, "u", "lonely")] + [(2000, "r", "again")] * 400
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    folder = new_path(spark, "warc-test")
    warc.archive(df.repartition(5), folder)
    got = warc.load(spark, folder).collect()
    assert len(got) == len(rows)
    by_payload = defaultdict(list)
    for i, _, t in rows:
        by_payload[t or ""].append(i)
    digest = {base64.b32encode(hashlib.sha1(t.encode()).digest()).decode(): t for t in by_payload}
    met = defaultdict(list)
    for r in got:
        met[digest[r["payload_digest"]]].append(r)
    for t, ids in by_payload.items():
        last = max(ids, key=lambda i: -(10**9) if i is None else i)
        responses = [r for r in met[t] if r["record_type"] == "response"]
        assert [r["page_id"] for r in responses] == [last] and bytes(responses[0]["payload"]).decode() == t
        assert sorted(str(r["page_id"]) for r in met[t]) == sorted(map(str, ids))
        assert all(r["refers_to"] == warc.record_id(last) and r["payload"] is None for r in met[t] if r["record_type"] == "revisit")
    # payloads meet by id, url and digest only; by digest alone there meet narrow rows
    plan = warc.revisits(df, id_col="page_id", payload_col="html", url_col="url", least=0)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("first(payload") == 1


def test_foreign_and_broken_archives(spark, tmp_path):
    def member(head, body):
        return gzip.compress("\r\n".join([*head, f"content-length: {len(body)}"]).encode() + b"\r\n\r\n" + body + b"\r\n\r\n")

    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<p>hi\r\n\r\nthere"
    records = [
        member(["WARC/1.0", "warc-type: warcinfo"], b"software: x"),
        member(["WARC/1.0", "WARC-TYPE:response", "warc-target-uri: http://a/", "Content-Type: application/http; msgtype=response", "WARC-Payload-Digest: sha1:ABC"], http),
        member(["WARC/1.0", "WARC-Type: resource", "WARC-Page-Id: x"], b"z" * 700_000),
        warc.record("response", 3, "u", b"own", 3, "D", None),
        member(["WARC/1.0", "WARC-Type: metadata"], b""),
    ]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(records))
    got = warc.load(spark, f"file://{tmp_path}").collect()
    assert [(r["record_type"], r["page_id"], r["payload_bytes"]) for r in got] == [("warcinfo", None, 11), ("response", None, 14), ("resource", None, 700_000), ("response", 3, 3), ("metadata", None, 0)]
    assert bytes(got[1]["payload"]) == b"<p>hi\r\n\r\nthere" and got[1]["target_uri"] == "http://a/" and got[1]["payload_digest"] == "ABC"
    assert [r["payload_bytes"] for r in warc.load(spark, f"file://{tmp_path}", ["record_type", "payload_bytes"]).where("record_type = 'response'").collect()] == [14, 3]
    for n, broken in enumerate([b"no gzip", gzip.compress(b"HTTP/1.1 200\r\n\r\nx"), records[1][:60], gzip.compress(b"WARC/1.0\r\nContent-Length: 1\r\n\r\nabcd\r\n\r\n")]):
        (tmp_path / str(n)).mkdir()
        (tmp_path / str(n) / "b.warc.gz").write_bytes(broken)
        with pytest.raises(Exception, match="b.warc.gz"):
            warc.load(spark, f"file://{tmp_path}/{n}").collect()


def test_unwanted_payloads_are_not_inflated(tmp_path):
    big = [warc.record("response", i, "u", os.urandom(400_000), 400_000, "D", None) for i in range(5)]
    path = tmp_path / "a.warc.gz"
    path.write_bytes(b"".join(big))
    assert gzip.decompress(big[0])[-4:] == b"\r\n\r\n"  # any reader of gzip can read it
    with pa.fs.LocalFileSystem().open_input_file(str(path)) as file:
        members, heads = warc._Members(file), []
        for head, _ in members:
            heads.append(warc.parse_head(head)["page_id"])
            assert members.unpacker.eof is False and members.used <= warc.PIECE
    assert heads == [0, 1, 2, 3, 4]


# ---- 8 main text


PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p{{}}</style></head><body><header class="site-header"><p>Site</p></header><nav><ul><li><a href="/">Menu</a></ul></nav>
<div class="cookie-notice">We use cookies</div><main><article><h1>T{i} &amp; co&nbsp;x</h1><p>Read more at our shop<p><b>Text   {i}</b>
 here<br>x<form><input>Mail</form><section class="comments"><p>I disagree {i}</p></section><script>if (a<b) "</p>"</script></article></main><aside>Side {i}</aside><footer>F</footer></body></html>"""


def test_html_extraction_with_a_template(spark):
    rows = [(i, "http://h.com/x", PAGE.format(i=i)) for i in range(12)]
    rows += [(100, None, None), (101, "http://h2.com", ""), (102, "nohost", "<p>a &lt; b</p>plain"), (103, "http://h3.com", "<div><a href=x>m1</a> <a>m2</a></div><div class=post>Hello <a>w</a> world</div>"), (104, "http://h4.com", "<article>" + "<p>long</p>" * 20000), (105, "http://h.com/empty", ""), (106, "http://h.com/blank", " ")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumns({"host": F.lit(1), "text": F.lit("t"), "salt": F.lit(0)})
    for local in (400_000, 1):
        got = {r["page_id"]: r for r in html_extract.extract(df, local_tokens=local).collect()}
        # the line that all pages of the host share is template; an empty page doesn't count
        assert all(got[i]["text"] == f"T{i} & co x\nText {i} here x" for i in range(12))
        assert got[100]["text"] == got[101]["text"] == got[105]["text"] == got[106]["text"] == ""
        assert got[102]["text"] == "a < b\nplain" and got[103]["text"] == "Hello w world"
        assert got[104]["text"] == "\n".join(["long"] * 20000)
        assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    # one article on many pages gives no template
    same = spark.createDataFrame([(i, "http://h.com", PAGE.format(i=1)) for i in range(10)], "page_id bigint, url string, html string")
    assert {r["text"] for r in html_extract.extract(same).collect()} == {"T1 & co x\nRead more at our shop\nText 1 here x"}
    assert html_extract.extract(df.where("false")).count() == 0


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<div class="page with-sidebar"><article><p>Hello world</p></article></div>', "Hello world"),
        ('<div id="page" class="no-ads"><main><p>Hello world</p></main></div>', "Hello world"),
        ('<div class="sidebar-right"><main><p>Hello</p><div class="related"><a>r</a></div></main></div>', "Hello"),
        ('<div class="sidebar"><article>teaser</article></div><article><p>Hello</p><article class="comment">c</article></article>', "Hello"),
        ('<aside><article>teaser</article></aside><div class="cookie-notice">c</div>', ""),
    ],
)
def test_marked_classes_around_an_article(page, text):
    assert html_extract.content(page, html_extract.Template()) == text


def brute_templates(pages, support):
    """token -> (of the root, opens a slot of links), of each host; from whole occurrence vectors."""
    hosts = defaultdict(list)
    for host, page in pages:
        tags, pieces = html_extract.walk(page)
        tokens = [(k, p) for k, p in html_extract.tokens_of(tags, pieces) if k]
        if tokens:
            hosts[host].append((tokens, html_extract.chosen(pieces), [*html_extract.tokens_of(tags, pieces)]))
    out = {}
    for host, own in hosts.items():
        out[host] = {}
        if len({tuple(p.text for p in kept if p.key) for _, kept, _ in own}) < support:
            continue
        vectors, kinds = defaultdict(lambda: [0] * len(own)), {}
        for i, (tokens, _, _) in enumerate(own):
            for k, p in tokens:
                vectors[k][i] += 1
                kinds[k] = p is None
        classes = defaultdict(list)
        for k, v in vectors.items():
            classes[tuple(v)].append(k)
        root = classes.pop(tuple([1] * len(own)), [])
        place = {k: sum([x for x, _ in tokens].index(k) / len(tokens) for tokens, _, _ in own) for k in root}
        root = sorted(root, key=place.__getitem__)
        wrong = set()
        for tokens, _, _ in own:
            seen = [root.index(k) for k, _ in tokens if k in place]
            inside = max((list(c) for n in (len(seen), len(seen) - 1) for c in itertools.combinations(seen, n) if list(c) == sorted(c)), key=len)
            wrong |= {root[i] for i in seen if i not in inside}
        good = {}
        for v, keys in classes.items():
            if len(keys) < 2 or not any(kinds[k] for k in keys) or 2 * sum(x > 0 for x in v) < len(own):
                continue
            slots = set()
            for tokens, _, _ in own:
                at = 0
                for k, _ in tokens:
                    if k in place and k not in wrong:
                        at = k
                    elif k in keys:
                        slots.add(at)
            if len(slots) == 1:
                good |= dict.fromkeys(keys, (False, False))
        share = defaultdict(lambda: [0, 0, 0, set()])
        for i, (_, kept, everything) in enumerate(own):
            at, inside = 0, {id(p) for p in kept}
            for k, p in everything:
                if p is not None and id(p) in inside:
                    s = share[at]
                    s[0] += len(p.text)
                    s[1] += len(p.text) * p.link
                    s[2] += p.link and p.key != 0
                    s[3].add(i)
                if k in place and k not in wrong:
                    at = k
        out[host] = good | {k: (True, 2 * share[k][1] > share[k][0] and share[k][2] >= 2 * len(share[k][3])) for k in root if k not in wrong}
    return out


def site(host, n, seed):
    """Pages with a menu of changing length, a byline on most, a share line in the article, links below it and comments."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    out = []
    for i in range(n):
        menu = "".join(f"<li><a>{word()}</a></li>" for _ in range(rng.randrange(2, 6)))
        byline = f'<div class="by"><i>Written by</i> <u>{word()}</u></div>' if i % 5 else ""
        body = "".join(f"<p>{word()} {word()} {word()}</p>" for _ in range(rng.randrange(1, 5)))
        more = "".join(f"<a>{word()}</a> " for _ in range(3))
        out.append((f"http://{host}/{i}", f'<html><body><ul>{menu}</ul><div class="text">{byline}<h1>{word()}</h1><div class="box"><b>Tell a friend</b></div>{body}</div><h3>See also</h3><div class="links">{more}</div></body></html>'))
    return out


def test_templates_equal_brute_force(spark):
    pages = site("a.com", 14, 1) + site("b.com", 3, 2) + [(u.replace("c.com", "C.com"), x) for u, x in site("c.com", 9, 3)]
    rows = [(i, u, x) for i, (u, x) in enumerate(pages)] + [(99, "http://a.com/none", ""), (98, "http://a.com/copy", pages[0][1])]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    host = lambda u: u.split("/")[2].lower()
    expected = brute_templates([(host(u), x) for _, u, x in rows], html_extract.SUPPORT)
    assert len(expected["a.com"]) > 15 and any(links for _, links in expected["a.com"].values()) and any(not root for root, _ in expected["a.com"].values()) and not expected["b.com"]
    keyed = df.select(F.lower(F.split("url", "/")[2]).alias("host"), F.pmod(F.xxhash64("page_id", "html"), F.lit(html_extract.PRIME)).alias("salt"), "html")
    for local in (400_000, 1):
        got = defaultdict(dict)
        for r in html_extract.templates(keyed, html_extract.SUPPORT, local).collect():
            got[r["host"]][r["token"]] = (r["root"], r["links"])
        assert dict(got) == {h: x for h, x in expected.items() if x}
        found = {r["page_id"]: r["text"] for r in html_extract.extract(df, local_tokens=local).collect()}
        for i, u, page in rows:
            t = expected.get(host(u), {})
            assert found[i] == html_extract.content(page, html_extract.Template(set(t), {k for k, x in t.items() if x[0]}, {k for k, x in t.items() if x[1]}))
    # the template decides: menu, share line, heading of the links and the links themselves go, a byline's name stays
    assert "Tell a friend" not in found[1] and "See also" not in found[1] and found[1].startswith("Written by") and len(found[1].split("\n")) < 8
    assert "Tell a friend" in html_extract.content(rows[1][2], html_extract.Template())


# ---- 9 BPE


def test_bpe_workers_keep_no_texts(spark, monkeypatch):
    """Long chunks are not remembered, and after a partition nothing is."""
    caught = []
    monkeypatch.setattr(bpe, "tidy", lambda run: caught.append(run) or run)
    bpe.encode_documents(spark.createDataFrame([(1, "a")], "doc_id bigint, text string"), TOKENIZER)
    b = bpe.tokenizer(TOKENIZER)
    long = "x1" * 5000
    assert b.encode(f"{long} word {long}") == [*b.encode(long), *b.encode("word"), *b.encode(long)]
    assert max(map(len, [*b._memory, *b._words])) <= 100
    assert list(caught[0](iter([pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["two words"])], ["doc_id", "text"])])))
    assert not b._memory and not b._words


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    path = TOKENIZER
    library = Tokenizer.from_file(path)
    rng = random.Random(5)
    letters = [chr(c) for c in [*range(0, 0x250), *range(0x370, 0x400), *range(0x2000, 0x2070), 0x1F600, 0x1F3FD, 0xFB01, 0x1E9E, 0x130]]
    texts: list = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 60))) for _ in range(300)]
    texts += [None, "", "  ", "<|endoftext|>Hi <|startoftext|>  x", "ΑΣ ΣΑΣ", "it's we'll 'S 123", "a" * 20000, "\x1c a\x85b\u200bc", "same", "same"]
    got = sorted(bpe.encode_documents(docs(spark, [(i, t, "en", "s") for i, t in enumerate(texts)]), path).collect(), key=lambda r: r["doc_id"])
    for r, t in zip(got, texts, strict=True):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        back = library.decode(ids, skip_special_tokens=False)
        assert r["decoded"] == back and r["decoded_sha256"] == hashlib.sha256(back.encode()).hexdigest()
    assert bpe.encode_documents(docs(spark, [(1, "a", "en", "s")]).where("false"), path).count() == 0


def test_certain_cuts_never_split_a_token():
    b = bpe.WordBpe(TOKENIZER)
    word = "".join(b.letters[x] for x in "straßenbahnqzxj".encode())
    pieces = b.fragments(word)
    assert "".join(pieces) == word and len(pieces) > 1
    assert all(p[i : i + 2] in b.joined for p in pieces for i in range(len(p) - 1))
