"""The corpus pipeline on a small table, stage by stage."""

import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import subword


def test_stages_take_effect(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    base = "the quick brown fox jumps over a lazy dog and then it runs home with all that it has found"
    passage = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    rows = [(1, base), (2, base), (3, f"{passage}"), (4, "mail me at a.b@x.example.com please, " + base[::-1]), (5, "12 34"), (6, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    seen, d = [], spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        d = stage(spark, d, str(tmp_path))
        assert d.columns == docs.columns
        seen.append(sorted(r["doc_id"] for r in d.collect()))
    assert seen == [[1, 2, 3, 4], [1, 3, 4], [1, 4], [1, 4]]
    assert "a.b@" not in d.where("doc_id = 4").first()["text"]
    got = corpus_pipeline.run(spark, str(tmp_path)).orderBy("doc_id", "sample").collect()
    want = subword.digests(d).orderBy("doc_id", "sample").collect()
    assert got == want and {(r["doc_id"], r["sample"]) for r in got} == {(1, 1), (1, 2), (4, 1), (4, 2)}
    texts = {r["doc_id"]: r["c"] for r in d.select("doc_id", F.crc32("text").alias("c")).collect()}
    assert all(r["text_crc32"] == texts[r["doc_id"]] for r in got)


def test_rows_with_equal_and_missing_ids_are_judged_each(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    passage = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    clean = ["the quick brown fox jumps over a lazy dog", "all that it has found is under the old bridge", "a clean text that has an id of its own", "and the last one of them has none at all"]
    rows = [(1, passage), (1, clean[0]), (None, passage + " fifteen"), (None, clean[1]), (2, clean[2]), (None, clean[3]), (None, clean[3])]
    docs = [(i, t, "en", "s", len(t), "x", 1) for i, t in rows]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, __d string, score int")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    d = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        d = stage(spark, d, str(tmp_path))
        assert d.columns == frame.columns
    assert sorted(r["text"] for r in d.collect()) == sorted(clean)
    assert corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "text_crc32").distinct().count() == 4


def test_pipeline_on_empty_tables(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def grams(text):
    w = text.split()
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)])


def near(a, b):
    """Weighted similarity of word 5-grams of 0.8 or more."""
    both = sum((a & b).values())
    return both >= 0.8 * (sum(a.values()) + sum(b.values()) - both)


def one_of_each_class(docs):
    """Row numbers kept: the lowest id of each class under all pairs."""
    bags = [grams(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if min(len(bags[i]), len(bags[j])) * 2 > max(len(bags[i]), len(bags[j])) and near(bags[i], bags[j]):
                root[find(i)] = find(j)
    best = {}
    for i, (doc, _) in enumerate(docs):
        r = find(i)
        best[r] = min(best.get(r, (doc, i)), (doc, i))
    return sorted(doc for doc, _ in best.values())


def contaminated(text, passages):
    w, hit = text.lower().split(), set()
    windows = {tuple(p[i : i + 13]) for p in passages for i in range(max(1, len(p) - 12))}
    for size in {len(x) for x in windows}:
        for i in range(len(w) - size + 1):
            if tuple(w[i : i + size]) in windows:
                hit |= set(range(i, i + size))
    return bool(hit) and 20 * len(hit) >= len(w)


def test_pipeline_by_brute_force(spark, tmp_path):
    """Two languages, exact and near copies, texts just too far apart, passages in short and long texts, phones, a text of 2 MB and rows without text; each stage against plain Python."""
    pytest.importorskip("public_tokenizers")
    rng = np.random.default_rng(31)
    vocabulary = {"en": [f"the{c}{d}" for c in "bcdfgh" for d in "aeiou"] + ["the", "and", "with"], "fr": [f"lé{c}{d}" for c in "jklmnp" for d in "aeiou"] + ["été", "une", "chose"]}
    words = lambda lang, n: list(rng.choice(vocabulary[lang], n))
    passages = [words("en", 13), words("fr", 20), words("en", 6)]
    rows = []
    for i in range(40):
        lang = ("en", "fr")[i % 2]
        w = words(lang, 90)
        if i % 8 == 3:
            w[10:10] = passages[i % 3]
        if i % 8 == 5:
            w = words(lang, 1500) + passages[0] + words(lang, 1500)
        text = " ".join(w) + (f" +1 640 555 {1000 + i}" if i % 4 == 0 else "")
        rows.append((i, text, lang))
        if i % 5 == 0:
            rows.append((100 + i, text, lang))  # an exact copy
        if i % 5 == 1:
            other = list(w)
            other[40] = "other"
            rows.append((200 + i, " ".join(other), lang))  # a near one
        if i % 5 == 2:
            other = list(w)
            other[10::20] = ["other"] * len(other[10::20])
            rows.append((300 + i, " ".join(other), lang))  # too far
    rows += [(400, " ".join(words("en", 400_000)), "en"), (401, None, "en"), (402, "", "en"), (403, "12 345 !", None)]
    frame = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    frame.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, " ".join(p)) for i, p in enumerate(passages)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    d, stages = spark.read.parquet(f"{tmp_path}/documents.parquet"), [f for _, f in corpus_pipeline.STAGES]
    took = lambda d: sorted((r["doc_id"], r["text"]) for r in d.collect())

    d = stages[0](spark, d, str(tmp_path))
    first = took(d)
    assert first == sorted((i, t) for i, t, _ in rows if i < 401)
    assert {r["doc_id"]: r["lang"] for r in d.collect()} == {i: lang for i, _, lang in rows if i < 401}
    d = stages[1](spark, d, str(tmp_path))
    second = took(d)
    assert [i for i, _ in second] == one_of_each_class(first) and len(second) < len(first) - 12
    d = stages[2](spark, d, str(tmp_path))
    third = took(d)
    assert third == [(i, t) for i, t in second if not contaminated(t, passages)] and 0 < len(second) - len(third) < 10
    d = stages[3](spark, d, str(tmp_path))
    fourth = dict(took(d))
    for i, t in third:
        assert (fourth[i] == t) == ("+1 640" not in t) and len(fourth[i]) == len(t) and fourth[i].split()[:90] == t.split()[:90]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r["doc_id"], r["sample"], r["text_crc32"]) for r in got) == Counter((i, k, zlib.crc32(t.encode())) for i, t in fourth.items() for k in (1, 2))
    assert len({(r["doc_id"], r["ids_crc32"]) for r in got}) == len(got) and all(r["log_prob"] < 0 and r["n_tokens"] > 0 for r in got)
