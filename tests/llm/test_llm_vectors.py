"""Codes, whitening and mixing against brute force, on tables with odd rows."""

import hashlib
import math
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import codes, common as C, mixing, vectors, whitening

VECTORS = "vec_id long, embedding array<float>, label int, code string, x int, error string"


def odd_vectors(rng, n=120, width=16):
    rows = [(int(i), [float(np.float32(c)) for c in rng.normal(0, 0.2, width)], int(rng.integers(0, 3))) for i in rng.permutation(n)]
    rows += [(i, rows[0][1], None) for i in range(n, n + 40)]  # a very common vector, without label
    rows += [(3, rows[5][1], 1), (3, rows[5][1], 1), (3, rows[6][1], 2), (None, rows[7][1], 0), (400, [0.0] * width, 9), (401, [0.5], 9), (402, [], 9)]
    bad = [None, [None] * width, [*([0.1] * (width - 1)), None], [math.nan] * width, [math.inf, *([0.0] * (width - 1))], [*([0.0] * (width - 1)), -math.inf]]
    rows += [(-i, b, 0) for i, b in enumerate(bad)]
    return [(*r, "x", 1, "y") for r in rows]


def kept(rows):
    return [(i, v, label) for i, v, label, *_ in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]


def plain_codes(rows, parts=8, entries=16, rounds=6, scale=4096):
    """K-means as the contract says it, by plain loops."""
    rows = kept(rows)
    width = -(-max(len(v) for _, v, _ in rows) // parts) * parts
    dims = width // parts
    ints = [[math.floor(Fraction(c) * scale) for c in v] + [0] * (width - len(v)) for _, v, _ in rows]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1] + [0.0] * (width - len(rows[i][1]))))
    part = lambda x, p: x[p * dims : (p + 1) * dims]
    books = [[part(ints[i], p) for i in order[:entries]] for p in range(parts)]

    def find(x, p):
        return min((sum((a - b) ** 2 for a, b in zip(part(x, p), e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        found = [[find(x, p)[1] for p in range(parts)] for x in ints]
        for p in range(parts):
            for k in range(len(books[p])):
                mine = [part(x, p) for x, f in zip(ints, found) if f[p] == k]
                if mine:
                    books[p][k] = [sum(c) // len(mine) for c in zip(*mine)]
    out = [[find(x, p) for p in range(parts)] for x in ints]
    sums = Counter()
    for (_, _, label), o in zip(rows, out):
        sums[label] += sum(e for e, _ in o)
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return Counter((i, "".join(f"{k:02x}" for _, k in o), sum(e for e, _ in o), sums[label], digest) for (i, _, label), o in zip(rows, out))


def told(df):
    return Counter(tuple(r) for r in df.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect())


def stored(spark, tmp_path, rows, schema, name, parts=5):
    spark.createDataFrame(rows, schema).repartition(parts).write.parquet(f"{tmp_path}/{name}.parquet")
    return f"{tmp_path}"


@pytest.mark.parametrize("n", [120, 5])
def test_codes_against_plain_loops(spark, tmp_path, n):
    rows = odd_vectors(np.random.default_rng(n), n) if n > 5 else odd_vectors(np.random.default_rng(n), 50)[:n]
    assert told(codes.query(spark, stored(spark, tmp_path, rows, VECTORS, "embeddings"))) == plain_codes(rows)


def test_codes_of_huge_components_are_exact(spark, tmp_path):
    rows = [(i, [float(np.float32(c)) for c in (3.0e37 * i, -1e20, i / 7, 1e9 * i, 5, 6, 7, 8.5)], i % 2, "x", 1, "y") for i in range(40)]
    got, want = told(codes.query(spark, stored(spark, tmp_path, rows, VECTORS, "embeddings"))), plain_codes(rows)
    top = lambda c: Counter({(i, k, min(e, 2**63 - 1), min(s, 2**63 - 1), d): n for (i, k, e, s, d), n in c.items()})
    assert got == top(want)


def test_codes_do_not_depend_on_partitions_and_decode(spark, tmp_path):
    rows = odd_vectors(np.random.default_rng(4), 60)
    frame = spark.createDataFrame(rows, VECTORS)
    books, one = codes.compressed(frame.coalesce(1))
    other, many = codes.compressed(frame.repartition(13))
    assert books.sha256() == other.sha256()
    take = lambda df: Counter(map(tuple, df.select("vec_id", "code", "error", "label_error").collect()))
    assert take(one) == take(many)
    back = codes.decoded(one, books).first()
    dims = books.entries.shape[2]
    want = [c / books.scale for p in range(8) for c in books.entries[p, int(back["code"][2 * p : 2 * p + 2], 16)]]
    assert len(want) == 8 * dims and back["vector"] == pytest.approx(want)


def test_many_labels_meet_by_salted_join(spark, monkeypatch):
    frame = spark.createDataFrame(odd_vectors(np.random.default_rng(4), 60), VECTORS)
    take = lambda: Counter(map(tuple, codes.compressed(frame)[1].select("vec_id", "label", "label_error").collect()))
    want = take()
    monkeypatch.setattr(vectors, "FEW", 1)
    assert take() == want


def test_jacobi_small_eigenvalues():
    rng = np.random.default_rng(2)
    for grade in (1.0, 1e-2, 1e-4):
        scale = [Fraction(grade) ** k for k in range(6)]
        base = [[Fraction(int(c)) for c in row] for row in rng.integers(-9, 10, (9, 6))]
        exact = [[sum(r[i] * r[j] for r in base) * scale[i] * scale[j] for j in range(6)] for i in range(6)]
        values, axes = whitening.jacobi(np.array([[float(c) for c in row] for row in exact]))
        work, det = [row[:] for row in exact], Fraction(1)
        for k in range(6):
            det *= work[k][k]
            for i in range(k + 1, 6):
                work[i] = [a - work[i][k] / work[k][k] * b for a, b in zip(work[i], work[k])]
        assert float(np.prod(values / np.array([float(s * s) for s in scale]))) == pytest.approx(float(det / math.prod(s * s for s in scale)), rel=1e-11)
        assert (np.diff(values) <= 0).all() and np.abs(axes.T @ axes - np.eye(6)).max() < 1e-14


def plain_whitening(rows):
    rows = kept(rows)
    width = max(len(v) for _, v, _ in rows)
    xs = [[math.floor(Fraction(c) * 64) + 1_000_000 for c in v] + [1_000_000] * (width - len(v)) for _, v, _ in rows]
    fitted = sorted({tuple(x) for x in xs})
    n, sums = len(fitted), [sum(c) for c in zip(*fitted)]
    centred = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(x, sums)] for x in fitted])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    mine = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(x, sums)] for x in xs])
    return rows, n, [sum((n * c - s) ** 2 for c, s in zip(x, sums)) for x in xs], values[::-1], axes[:, ::-1], mine


@pytest.mark.parametrize("spread", [1.0, 5000.0, 1e-3])
def test_whitening_against_numpy(spark, tmp_path, spread):
    rng = np.random.default_rng(7)
    rows = odd_vectors(rng, 150, 20)
    rows = [(i, v and [None if c is None else float(np.float32(c * spread * 10 ** (-k / 6))) for k, c in enumerate(v)], *rest) for i, v, *rest in rows]
    if spread < 1:
        rows = [r for r in rows if r[1] is None or len(r[1]) > 1]
    plain, n, deviations, values, axes, centred = plain_whitening(rows)
    got = whitening.query(spark, stored(spark, tmp_path, rows, VECTORS, "embeddings")).collect()
    real = min(16, int((values > 1e-9 * values[0]).sum()))
    assert len(got) == len(plain) * real and {r["component"] for r in got} == set(range(1, real + 1)) and {r["n"] for r in got} == {n}
    assert max(r["identity_error"] for r in got) == min(r["identity_error"] for r in got) < 1e-9
    for r in got:
        assert r["explained"] == pytest.approx(values[r["component"] - 1] / values.sum(), rel=1e-9)
    assert Counter((r["vec_id"], r["deviation"]) for r in got if r["component"] == 1) == Counter((p[0], d) for p, d in zip(plain, deviations))
    unique = {p[0]: k for k, p in enumerate(plain)}
    once = {i for i, k in Counter(p[0] for p in plain).items() if k == 1}
    for component in range(1, real + 1):
        want = centred @ axes[:, component - 1] / math.sqrt(values[component - 1])
        pairs = np.array([(r["whitened"], want[unique[r["vec_id"]]]) for r in got if r["component"] == component and r["vec_id"] in once])
        sign = np.sign((pairs[:, 0] * pairs[:, 1]).sum())
        assert np.abs(pairs[:, 0] - sign * pairs[:, 1]).max() < 1e-6


def test_whitening_without_variance(spark, tmp_path):
    rows = [(i, [1.0, 2.0], 0, "x", 1, "y") for i in range(5)]
    assert whitening.query(spark, stored(spark, tmp_path, rows, VECTORS, "embeddings")).count() == 0
    assert whitening.whiten(spark.createDataFrame(rows[:0], VECTORS)).count() == 0


def test_deviations_beyond_a_long(spark):
    rows = [(i, [1e15 * i, float(i)], 0, "x", 1, "y") for i in range(4)]
    got = whitening.whiten(spark.createDataFrame(rows, VECTORS))
    assert {r["deviation"] for r in got.where("vec_id = 3").collect()} == {2**63 - 1} and got.count() in (4, 8)


DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, copies long, octave int, number int, start long"


def odd_documents(rng, n=400):
    sources = ["a", "b", "B", "é", "z\U0001f600", "", None, "hot"]
    rows = []
    for i in range(n):
        source = "hot" if i % 3 == 0 else sources[int(rng.integers(0, 7))]
        rows.append((i, " ".join(["w"] * int(rng.pareto(0.9) * 3)) + (f" \t\x0b{i} x" if i % 5 else ""), source))
    rows += [(n, " ".join(["w"] * 3000), "hot"), (n + 1, None, None), (n + 2, "", "b"), (n + 3, " \n ", "b"), (None, "one two", "b"), (None, "one two", "b"), (5, "five more words than before", "a"), (5, "five", "a"), (n + 4, None, "void"), (n + 5, "w " * 900, "lonely")]
    return [(*r[:2], "en", r[2], 0, 1, 1, 1, 1, 1) for r in rows]


def plain_targets(docs):
    sizes = Counter()
    for _, text, _, source, *_ in docs:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    open_, capped, total = set(order), {}, Fraction(3, 2) * sum(sizes.values())
    while True:
        left = total - sum(capped.values())
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * sizes[s]]
        if not over:
            return sizes, {**share, **capped}
        for s in over:
            capped[s] = Fraction(2 * sizes[s])
            open_.discard(s)


def test_mixing_against_plain_loops(spark, tmp_path):
    docs = odd_documents(np.random.default_rng(3))
    got = mixing.query(spark, stored(spark, tmp_path, docs, DOCS, "documents")).collect()
    sizes, aims = plain_targets(docs)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r["doc_id"], r["size"], r["source_size"]) for r in got) == Counter((d[0], size(d[1]), sizes[d[3]]) for d in docs)
    assert all(r["target"] == pytest.approx(float(aims[r["source"]]), rel=1e-12) for r in got)
    assert all(r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 2 for r in got)
    # octave by octave, as the docstring says
    hashes = {(r[0], r[1]): r[2] for r in spark.createDataFrame(docs, DOCS).selectExpr("doc_id", "text", "xxhash64(text)").collect()}
    starts = {}
    frame = spark.createDataFrame([(s, o) for s in sizes for o in range(mixing.OCTAVES + 1)], "source string, octave int")
    for r in frame.select("source", "octave", mixing.offset(mixing.SEED, F.col("source"), F.col("octave")).alias("start")).collect():
        starts[r["source"], r["octave"]] = r["start"]
    want = Counter()
    for source in sizes:
        mine = [(size(d[1]), d[0], hashes[d[0], d[1]]) for d in docs if d[3] == source]
        taken, left = 0, sizes[source]
        for octave in range(mixing.OCTAVES + 1):
            inside = lambda s: s > 0 and s * 2 ** (octave + 1) > sizes[source] >= s * 2**octave
            rows = [m for m in mine if inside(m[0])] if octave < mixing.OCTAVES else [m for m in mine if m[0] * 2**octave <= sizes[source]]
            rows.sort(key=lambda m: (-m[0], m[1] is None, m[1] or 0, m[2]))
            rate = round(min(max((float(aims[source]) - taken) / left, 0.0), 2.0) * 2**mixing.POINT) if left else 0
            at = starts[source, octave]
            for k, m in enumerate(rows, 1):
                copies = (at + k * rate) // 2**mixing.POINT - (at + (k - 1) * rate) // 2**mixing.POINT
                want[m[1], source, m[0], copies] += 1
                taken += copies * m[0]
                left -= m[0]
    assert Counter((r["doc_id"], r["source"], r["size"], r["copies"]) for r in got) == want
    taken = Counter()
    for r in got:
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - float(aims[s])) <= max(3, 0.002 * sizes[s]) for s in sizes if s != "lonely")


def test_mixing_reruns_agree_and_emits_copies(spark):
    docs = spark.createDataFrame(odd_documents(np.random.default_rng(5), 200), DOCS)
    rows = lambda df: Counter(map(tuple, mixing.planned(df).select("doc_id", "source", "size", "target", "copies").collect()))
    want = rows(docs.coalesce(1))
    assert rows(docs.repartition(9)) == want
    plan = mixing.planned(docs)
    out = mixing.emitted(plan, docs)
    assert out.columns == docs.columns
    copies = Counter()
    for (doc_id, source, size, _, n), k in want.items():
        copies[doc_id, source] += n * k
    got = Counter((r["doc_id"], r["source"]) for r in out.collect())
    assert got == Counter({k: v for k, v in copies.items() if v})


def test_mixing_is_unbiased_over_seeds(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 7), "en", "s" if i % 2 else "t", 0, 0, 0, 0, 0, 0) for i in range(40)], DOCS)
    got = Counter()
    for seed in range(12):
        for r in mixing.planned(docs, seed=seed).select("doc_id", "copies").collect():
            got[r["doc_id"]] += r["copies"]
    by = {s: np.mean([got[i] / 12 for i in range(40) if (i % 2 == 1) == (s == "s")]) for s in "st"}
    aims = plain_targets([(i, "w " * (1 + i % 7), "en", "s" if i % 2 else "t") for i in range(40)])
    assert all(abs(by[s] - float(aims[1][s]) / aims[0][s]) < 0.15 for s in "st")


def test_numbers_over_ranges(spark):
    rows = spark.range(500).selectExpr("id", "CASE WHEN id % 3 = 0 THEN NULL ELSE id % 5 END AS g", "id % 7 AS v")
    got = C.numbered(rows.repartition(6), [F.col("g"), F.col("v"), F.col("id")], ["g"]).collect()
    for g in {r["g"] for r in got}:
        mine = sorted((r for r in got if r["g"] == g), key=lambda r: r["number"])
        assert [r["number"] for r in mine] == list(range(1, len(mine) + 1)) and [(r["v"], r["id"]) for r in mine] == sorted((r["v"], r["id"]) for r in mine)
