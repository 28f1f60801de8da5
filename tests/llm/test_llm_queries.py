"""Every query of the training-data operators on small tables with odd rows: nulls, empty and very long texts, ties, repeated rows and columns whose names
operators use themselves; against brute force, or against the SQL where there is some."""

import hashlib
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest

from tallyspark.llm import common as C, decontaminate, html, language, neardup, pii, quality, registry, sharding, subword, token_output

P = pytest.importorskip("public_tokenizers")
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LONG = " ".join(f"word{i % 5000} and more," for i in range(450_000))  # over 8 MB


def lowered(t):
    return re.findall(WORD, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(21)
    path = f"{tmp_path_factory.mktemp('tables')}"
    vocabulary = {"en": "the cat and dog with this thing of it was".split(), "fr": "le chat et la souris avec une chose à été".split()}
    text = lambda lang, n: " ".join(rng.choice(vocabulary[lang], n))
    docs = []
    for i in range(60):
        lang = ("en", "fr")[i % 2]
        t = text(lang, 60) + ("\n" + text(lang, 5)) * 2 + f" {i} call +1 (640) 555-{i:04}"
        docs.append((i, t, lang))
    passage = " ".join(f"p{k}" for k in range(30))
    docs += [(60, passage, "en"), (60, "same id, another text of the cat and dog", "en"), (None, passage, "en"), (None, "no id, clean text of the cat and dog", "en"), (61, None, "en"), (62, "", "en"), (62, "", "en"), (63, docs[0][1], None), (64, "123 456", "en"), (65, LONG, "en"), (1, docs[1][1], "fr")]
    rows = [(*d, "s", len(d[1] or ""), 7, "x", 1, "y") for d in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, shard int, pii string, score int, spans string").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, passage), (1, passage), (2, None), (None, "p3 p4"), (3, "never seen here")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    turns = [(c, t, ("user", "assistant")[t % 2], f"{c} says {t % (3 if c % 3 else 2)}") for c in range(12) for t in range(c % 7)] + [(None, 0, "user", "n"), (None, None, None, None), (20, None, "assistant", None), (20, 1, "assistant", "é" * 9), (21, 0, "user", LONG)]
    spark.createDataFrame([(*t, "x") for t in turns], "conv_id long, turn long, role string, text string, chosen string").write.parquet(f"{path}/conversations.parquet")
    pages = [(i, f"http://h{i % 2}.example/{i}", f"<html><body><nav>menu {i}</nav><article><h1>T{i}</h1><p>one &amp; {i}<p>two</article><footer>f</footer></body></html>") for i in range(8)]
    pages += [(8, None, None), (9, "http://h0.example/9", ""), (9, "http://h0.example/9", ""), (None, "x", "<p>bare"), (10, "http://h0.example/10", "<article><p>" + LONG + "</article>")]
    spark.createDataFrame([(*p, "x", "y") for p in pages], "page_id long, url string, html string, host string, wanted string").write.parquet(f"{path}/pages.parquet")
    vectors = [(i, [float(c) for c in rng.normal(0, 0.2, 16)], i % 3, "x") for i in range(30)] + [(30, None, 0, "x"), (None, [0.5] * 16, None, "x"), (3, [float("nan")] * 16, 1, "x")]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int, code string").write.parquet(f"{path}/embeddings.parquet")
    for name in ("documents", "benchmark", "conversations", "pages", "embeddings"):  # and empty ones
        spark.read.parquet(f"{path}/{name}.parquet").limit(0).write.parquet(f"{path}/empty/{name}.parquet")
    for name in ("documents", "benchmark", "conversations", "pages"):  # and some without the long texts
        rows = spark.read.parquet(f"{path}/{name}.parquet")
        rows.where(" AND ".join(["true", *(f"coalesce(length({c}), 0) < 1000000" for c in ("text", "html") if c in rows.columns)])).write.parquet(f"{path}/short/{name}.parquet")
    return path


def table(folder, name):
    return pq.read_table(f"{folder}/{name}.parquet").to_pylist()


def cells(rows, columns):
    return Counter(tuple(r[c] for c in columns) for r in rows)


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_empty_tables(spark, folder, name):
    assert registry.QUERIES[name](spark, f"{folder}/empty").count() == 0


@pytest.mark.parametrize("name", list(registry.ORACLES))
def test_queries_against_sql(spark, folder, name):
    db = duckdb.connect()
    for view in ("documents", "benchmark", "conversations", "pages"):
        db.sql(f"CREATE VIEW {view} AS SELECT * FROM '{folder}/short/{view}.parquet/*.parquet'")
    want = db.sql(registry.ORACLES[name])
    got = registry.QUERIES[name](spark, f"{folder}/short")
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert cells([r.asDict() for r in got.collect()], columns) == Counter(tuple(r[want.columns.index(c)] for c in columns) for r in want.fetchall())


def test_token_output_query(spark, folder):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    crc = lambda t: zlib.crc32(np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes())
    got = sorted((r.asDict() for r in token_output.query(spark, folder).collect()), key=lambda r: r["start"])
    assert cells(got, ["doc_id", "ids_crc32"]) == Counter((d["doc_id"], crc(d["text"])) for d in table(folder, "documents"))
    assert [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got])[:-1].tolist()]
    assert [r["doc_id"] is not None for r in got] == sorted(r["doc_id"] is not None for r in got) and [r["doc_id"] for r in got if r["doc_id"] is not None] == sorted(r["doc_id"] for r in got if r["doc_id"] is not None)


def test_encoding_equals_the_whole_texts(spark):
    """The encoder cuts texts into stretches; its ids are the library's for the whole text, for all documents of the driver's table."""
    import os

    from tokenizers import Tokenizer

    source = "/root/testdata/sf0.001/documents.parquet"
    if not os.path.exists(source):
        pytest.skip("no tables")
    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    texts = pq.read_table(source, columns=["text"]).column("text").combine_chunks()
    ids, offsets = token_output.encode_texts(texts, P.path("word_bpe_49k.json"), 1)
    for i, t in enumerate(texts.to_pylist()):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == [*tok.encode(t or "", add_special_tokens=False).ids, 1]


def test_neardup_query(spark, folder):
    got = [r.asDict() for r in neardup.query(spark, folder).collect()]
    assert len(got) == len(table(folder, "documents"))
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert by[0]["class_id"] == by[63]["class_id"] == 0 and by[62]["class_size"] == 2 and by[65]["class_size"] == 1
    assert sum(r["kept"] for r in got) == len({(r["class_id"], r["class_size"] > 1 or i) for i, r in enumerate(got)})


def test_pii_query(spark, folder):
    got = [r.asDict() for r in pii.query(spark, folder).collect()]
    docs = table(folder, "documents")
    assert len(got) == len(docs) and sum(r["n_phone"] for r in got) == sum("555-" in (d["text"] or "") for d in docs)
    assert not any("(640)" in (r["text"] or "") for r in got) and [r["text"] for r in got if r["doc_id"] == 65] == [LONG] and [r["text"] for r in got if r["doc_id"] == 61] == [None]


def test_sharding_query(spark, folder):
    got = [r.asDict() for r in sharding.query(spark, folder).collect()]
    want = Counter((d["doc_id"], len((d["text"] or "").encode()) + 1, zlib.crc32((d["text"] or "").encode())) for d in table(folder, "documents"))
    assert cells(got, ["doc_id", "size", "text_crc32"]) == want
    for s in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert {r["law"] for r in got} == {"bytes"} and all(0 <= r["shard"] < 16 and r["grown_shard"] is None and r["map_version"] == 1 and 0 <= r["next_shard"] < 17 for r in got)


def test_hot_and_missing_keys_fill_all_slots(spark):
    rows = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN 7 WHEN id % 3 = 1 THEN id END AS doc_id", "'same text' AS text")
    by = Counter(r["vslot"] for r in sharding.slotted(rows, 256).collect())
    assert max(by.values()) < 40


def test_slots_are_for_good(spark):
    """Added rows, of hot, new, missing and repeated keys, and another partitioning move no record; growing moves none to a shard that was there before it was needed."""
    schema = "doc_id long, text string"
    rows = [(5 if i % 3 == 0 else i, f"text {i % 4}") for i in range(900)] + [(None, "x")] * 50 + [(5, None), (5, "")]
    take = lambda r, n: Counter(tuple(x) for x in sharding.slotted(spark.createDataFrame(r, schema).repartition(n)).select("doc_id", "size", "text_crc32", "vslot").collect())
    was = take(rows, 3)
    assert take(rows[::-1], 7) == was
    now = take([*rows, (5, "text 0"), (5, "text 0"), (5, "new"), (None, "x"), (1000, "y")], 4)
    assert not was - now and sum((now - was).values()) == 5


def test_packing_by_brute_force(spark, tmp_path):
    """The stored map against its rows: every shard's bytes, counts and first numbers; shards near equal; the edited map moves only what narrows a gap."""
    rng = np.random.default_rng(9)
    docs = spark.createDataFrame([(i, "x" * int(rng.pareto(1.5) * 40)) for i in range(6000)], "doc_id long, text string")
    path = f"file://{tmp_path}/map"
    got = [r.asDict() for r in sharding.shard(docs, path, 7, 512).collect()]
    by_slot, by_shard = Counter(), Counter()
    for r in got:
        by_slot[r["vslot"]] += r["size"]
        by_shard[r["shard"]] += r["size"]
    stored = sharding.load_map(spark, path).collect()
    assert all(m["bytes"] == by_slot[m["slot"]] and m["rows"] == sum(r["vslot"] == m["slot"] for r in got) for m in stored[:40]) and len(stored) == 512
    for shard in range(7):
        at = 0
        for m in sorted((m for m in stored if m["shard"] == shard), key=lambda m: m["slot"]):
            assert m["base"] == at
            at += m["rows"]
        assert sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(at))
    assert max(by_shard.values()) - min(by_shard.values()) <= max(by_slot.values())
    grown = sharding.grow(spark, path, 8, 512).collect()
    load = Counter()
    for m in grown:
        load[m["shard"]] += m["bytes"]
    moved = [m for m in grown if {s["slot"]: s["shard"] for s in stored}[m["slot"]] != m["shard"]]
    assert {m["version"] for m in grown} == {2} and len(load) == 8 and max(load.values()) <= 1.05 * sum(load.values()) / 8 and sum(m["bytes"] for m in moved) <= 1.3 * load[7]


def test_html_query(spark, folder):
    got = [r.asDict() for r in html.query(spark, folder).collect()]
    assert len(got) == 13 and all(r["n_chars"] == len(r["text"]) for r in got)
    by = {r["page_id"]: r["text"] for r in got}
    assert all(by[i] == f"T{i}\none & {i}\ntwo" for i in range(8)) and by[8] == by[9] == "" and by[None] == "bare" and by[10] == LONG


def test_html_by_construction(spark):
    """Pages made of known article blocks and boilerplate: exactly the blocks come back."""
    rng = np.random.default_rng(8)
    words = lambda n: " ".join("".join(rng.choice(list("abcdeé"), 5)) for _ in range(n))
    pages, want = [], {}
    for i in range(120):
        blocks = [words(int(rng.integers(1, 30))) for _ in range(int(rng.integers(1, 9)))]
        inner = "".join([f"<p>{b}</p>", f"<p>{b}", f"<div class='c{i}'>{b}</div>", f"<ul><li>{b}</ul>", f"<section><h2>{b}</h2></section>", f"<blockquote>\n {b} </blockquote>"][int(rng.integers(0, 6))] for b in blocks)
        shape = i % 4
        main = [f"<article>{inner}</article>", f"<div id='wrap'><main>{inner}</main></div>", f"<div class='story-{i}'>{inner}</div>", f"<div><div>{inner}</div></div>"][shape]
        page = f"<html><head><title>{words(3)}</title><style>x</style></head><body><header><a href=/>{words(2)}</a></header><nav><a href=/>{words(9)}</a></nav><div class='cookie-banner'>{words(9)}</div>{main}<aside>{words(20)}</aside><div id='comments'><p>{words(30)}</p></div><form>{words(5)}</form><footer>{words(9)}</footer><script>var a = '</p>';</script></body></html>"
        pages.append((i, f"http://s{shape}.example/{i}", page))
        want[i] = "\n".join(blocks)
    got = {r["page_id"]: r["text"] for r in html.extract_pages(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == want


HARD_PAGES = [
    ('<div data-role="dialog"><p>kept one</p><p>kept two</p></div>', "kept one\nkept two"),
    ('<div data-hidden="false"><p>kept</p></div>', "kept"),
    ('<div title="the hidden river"><p>kept</p></div>', "kept"),
    ("<div title='id=ad class=ad'><p>kept</p></div>", "kept"),
    ('<div class="wrapper with-sidebar"><h1>T</h1><p>text</p></div><div class="sidebar">s</div>', "T\ntext"),
    ('<div class="site has-sidebar"><p>text</p></div>', "text"),
    ('<div class="single no-comments"><article><p>text</p></article></div>', "text"),
    ('<div class="layout-sidebar"><article><p>text</p></article></div><div class="acme-sidebar"><p>side</p></div>', "text"),
    ('<div class="acme-sidebar-left"><p>side</p></div><main><p>text</p></main>', "text"),
    ("<main><h1>T</h1><p>lead</p><article><p>text that is longer than the lead</p></article></main>", "T\nlead\ntext that is longer than the lead"),
    ("<body><h1>T</h1><article><p>one</p></article><article><p>two</p></article><footer>f</footer></body>", "T\none\ntwo"),
    ("<div id=page><p>lead</p><article><p>the text of the article</p></article></div><div class=ad>buy</div>", "lead\nthe text of the article"),
    ("<div id=page><div class=intro><h1>T</h1><p>lead</p></div><article><p>the text of the whole article</p></article></div>", "T\nlead\nthe text of the whole article"),
    ("<article><p>text</p><blockquote class=reply>quoted</blockquote><div class=comments>c</div></article>", "text\nquoted"),
]


def test_html_traits_keep_the_article(spark):
    """Attributes that only look like marks, wrappers named after what stands beside them, text around articles; each page alone on its host, and all of them on one."""
    pages = [(i, f"http://h{i}.example/", f"<html><body><nav>menu</nav>{h}</body></html>") for i, (h, _) in enumerate(HARD_PAGES)]
    schema = "page_id long, url string, html string"
    assert {r["page_id"]: r["text"] for r in html.extract_pages(spark.createDataFrame(pages, schema)).collect()} == {i: t for i, (_, t) in enumerate(HARD_PAGES)}


def test_html_wrappers_with_boilerplate_words(spark):
    """Whatever boilerplate word a wrapper's class says to stand beside or not, the page keeps its text, and loses what is named so outright."""
    rng = np.random.default_rng(12)
    marks, states = sorted(html.MARKS - {"hidden"}), ("with", "has", "no", "without", "is-not", "show")
    pages, want = [], {}
    for i in range(150):
        mark, other = (marks[int(k)] for k in rng.integers(0, len(marks), 2))
        name = f"{states[int(rng.integers(0, len(states)))]}-{mark}"
        inner = [f"<h1>T{i}</h1><p>text {i}</p>", f"<article><h1>T{i}</h1><p>text {i}</p></article>", f"<main><h1>T{i}</h1><p>text {i}</p></main>", f"<div><h1>T{i}</h1></div><div><p>text {i}</p></div>"][i % 4]
        pages.append((i, f"http://s{i % 8}.example/{i}", f'<body class="{name}"><div class="{other}"><p>beside</p></div><div class="wrapper {name}" data-role="dialog">{inner}</div><div id="{mark}-box">gone</div></body>'))
        want[i] = f"T{i}\ntext {i}"
    assert {r["page_id"]: r["text"] for r in html.extract_pages(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()} == want


def test_html_page_with_a_lead_keeps_it_against_its_host(spark):
    plain = [(i, "http://h/", f"<main><article><p>text {i}</p></article></main>") for i in range(9)]
    got = html.extract_pages(spark.createDataFrame([*plain, (9, "http://h/", "<main><p>lead</p><article><p>text nine</p></article></main>")], "page_id long, url string, html string"))
    assert {r["page_id"]: r["text"] for r in got.collect()} == {**{i: f"text {i}" for i in range(9)}, 9: "lead\ntext nine"}


def test_many_hosts_are_dealt_by_share(spark, folder, monkeypatch):
    want = Counter(map(str, html.query(spark, folder).collect()))
    monkeypatch.setattr(html, "MOST_BYTES", 1)
    assert Counter(map(str, html.query(spark, folder).collect())) == want


def test_language_query(spark, folder):
    got = [r.asDict() for r in language.query(spark, folder).collect()]
    docs = table(folder, "documents")
    assert len(got) == len(docs) and all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    by = {r["doc_id"]: r["lang_pred"] for r in got if r["doc_id"] is not None}
    assert all(by[i] == ("en", "fr")[i % 2] for i in range(60)) and by[61] == by[62] == by[64] == "und" and by[65] == "en"


def test_subword_query(spark, folder):
    """Every row's samples, the 8 MB text's too: the query's figures are those of the ids, which the sentencepiece library decodes to the text; samples differ, the better one first."""
    import sentencepiece

    model = P.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=model)
    docs = table(folder, "documents")
    got = [r.asDict() for r in subword.query(spark, folder).collect()]
    made = [r.asDict() for r in subword.encode_samples(spark.read.parquet(f"{folder}/documents.parquet"), model).collect()]
    figures = lambda r: (r["doc_id"], r["sample"], len(r["ids"]) // 4, zlib.crc32(bytes(r["ids"])), r["log_prob"], r["log_inclusion"])
    assert Counter(map(figures, made)) == cells(got, ["doc_id", "sample", "n_tokens", "ids_crc32", "log_prob", "log_inclusion"])
    texts = Counter((d["doc_id"], d["text"] or "", k) for d in docs for k in ((1, 2) if d["text"] and d["doc_id"] != 64 else (1,)))  # digits stand alone in this vocabulary, so "123 456" has one segmentation
    assert Counter((r["doc_id"], library.decode(np.frombuffer(bytes(r["ids"]), "<u4").tolist()), r["sample"]) for r in made) == texts
    assert cells(got, ["doc_id", "text_crc32", "sample"]) == Counter((i, zlib.crc32(t.encode()), k) for i, t, k in texts.elements())
    by = {}
    for r in made:
        by.setdefault((r["doc_id"], r["sample"]), set()).add(bytes(r["ids"]))
    assert all(not by[i, 1] & by[i, 2] for i in range(60) if i != 1)
    assert {r["sample"] for r in got if r["doc_id"] == 65} == {1, 2}


def test_very_long_texts(spark, folder):
    """The 8 MB text in the queries whose SQL is too slow on it, by plain Python."""
    w = LONG.split()
    r = next(x.asDict() for x in quality.query(spark, folder).collect() if x["doc_id"] == 65)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    repeated = set()
    for i in range(len(w) - 2):
        if windows[tuple(w[i : i + 3])] > 1:
            repeated |= {i, i + 1, i + 2}
    assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"], r["kept"]) == (len(w), sum(map(len, w)), 0, 0, len(repeated), True, False)
    c = next(x.asDict() for x in registry.QUERIES["op6_chat"](spark, folder).collect() if x["pair_id"] == 21)
    assert (c["status"], c["prompt"], c["chosen"], c["rejected"], c["chosen_learned"]) == ("unpaired", "", f"<|user|>\n{LONG}<|end|>\n", None, 0)


def test_blocks_of_items_give_the_same(spark, folder):
    index = decontaminate.build_index(C.table(spark, folder, "documents"))
    bench = C.table(spark, folder, "benchmark")
    rows = lambda block: Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"]), tuple(r["near"])) for r in decontaminate.find(index, bench, block_words=block).collect())
    assert rows(10**6) == rows(3)


def test_quality_letters():
    got = quality.measure(__import__("pyarrow").array(["é — 、 😀 中 a"]))
    assert got["n_letter_words"].tolist() == [3]


def test_released_tables_are_gone(spark):
    import os

    df = C.staged(spark.range(3), "gone")
    assert df.count() == 3
    where = C.work_dir(spark).removeprefix("file://")
    assert os.path.isdir(where)
    C.release(spark)
    assert not os.path.isdir(where)
