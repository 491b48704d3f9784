"""Whitening, mixing and resampling against brute force, and their cases of nulls, ties, repeats and empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lexweft.llm import mixing, resampling, whitening

from .test_cases import BIG, docs, none, odd  # noqa: F401

VECTORS = "vec_id long, embedding array<float>, label int, x string, n int, whitened string"


def embeddings(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 2, "w") for i, v in rows], VECTORS)


def exact(vectors, k):
    """n, deviations, whitened, explained by numpy's own eigenvectors of the whole covariance."""
    x = np.floor(np.asarray(vectors, dtype=np.float64) * 64).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    c = (n * x - s) / n
    values, u = np.linalg.eigh(c.T @ c / n)
    values, u = values[::-1][:k], u[:, ::-1][:, :k]
    deviations = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s, strict=True)) for row in x]
    return n, deviations, c @ u / np.sqrt(values), values / (c * c).sum() * n


def held(out, k):
    """Whitened values by vec_id in the order of components; the columns that are one for all."""
    rows, by = out.collect(), defaultdict(dict)
    for r in rows:
        by[r.vec_id][r.component] = r
    assert all(sorted(v) == list(range(1, k + 1)) for v in by.values())
    return by, rows


def test_whitening_equals_whole_covariance(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate((rng.standard_normal((400, 12)) @ rng.standard_normal((12, 12))).astype(np.float32))]
    bad = [(900, None), (901, [1.0, None] + [0.0] * 10), (902, [float("nan")] + [0.0] * 11), (903, [float("inf")] + [0.0] * 11), (904, [1.0] * 5), (905, [])]
    out = whitening.whiten(embeddings(spark, rows + bad), 5)
    by, _ = held(out, 5)
    n, deviations, want, explained = exact([v for _, v in rows], 5)
    got = np.array([[by[i][c].whitened for c in range(1, 6)] for i, _ in rows])
    sign = np.sign((got * want).sum(axis=0))
    assert set(by) == set(range(400)) and np.abs(got * sign - want).max() < 1e-9
    assert [by[i][1].deviation for i, _ in rows] == deviations and {r[1].n for r in by.values()} == {n}
    assert np.allclose([by[0][c].explained for c in range(1, 6)], explained, rtol=1e-9) and by[0][1].identity_error < 1e-9


def test_whitening_takes_several_passes_and_restarts(spark):
    """Close eigenvalues, a block of two and a basis that restarts: residuals certify what is returned."""
    rng = np.random.default_rng(2)
    v = (rng.standard_normal((2000, 48)) * np.linspace(2, 1, 48)).astype(np.float32)
    x = whitening.integers(embeddings(spark, [(i, [float(c) for c in row]) for i, row in enumerate(v)])).persist()
    model = whitening.fit(x, k=2, more=2)
    assert model.passes > whitening.BLOCKS and (model.residuals <= whitening.TOLERANCE * model.values[0]).all()
    _, _, want, explained = exact(v, 2)
    assert np.allclose(model.values / model.trace, explained, rtol=1e-9)
    got = np.array([r.whitened for r in whitening.transform(x, model).orderBy("vec_id").collect()])
    assert np.abs(np.abs(got) - np.abs(want)).max() < 1e-8
    assert whitening.fit(x, k=30).passes == 2  # a basis of all dimensions ends it
    x.unpersist()


def test_whitening_cases(spark):
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [0.5, 2.0]), (BIG, [-3.0, 2.0])]
    by, out = held(whitening.whiten(embeddings(spark, rows)), 1)  # the second dimension doesn't vary
    assert set(by) == {1, None, BIG} and len(out) == 4 and {r.n for r in out} == {4} and {r.explained for r in out} == {1.0}
    for rest in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 3, [(1, [])]):
        assert whitening.whiten(embeddings(spark, rest)).count() == 0
    with pytest.raises(Exception, match="64 bits|[Oo]verflow|OVERFLOW"):
        whitening.whiten(embeddings(spark, [(1, [1e15]), (2, [0.0])] * 1000)).collect()


def filled(sizes, weights, most, total):
    """Targets by handing out excess again and again."""
    got, full, left = [0.0] * len(sizes), set(), float(total)
    while left > 1e-9 and len(full) < len(sizes):
        open_ = [i for i in range(len(sizes)) if i not in full]
        whole = sum(weights[i] for i in open_)
        share = {i: left * weights[i] / whole for i in open_}
        left = 0.0
        for i, s in share.items():
            got[i] += s
            if got[i] >= most * sizes[i]:
                left += got[i] - most * sizes[i]
                got[i] = float(most * sizes[i])
                full.add(i)
    return got


def sourced(spark, seed, n=700):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        source = "s0" if i % 3 == 0 else rnd.choice(["s1", "s2", "é", "Z", "\U0001f600", "￿", "", None, f"t{rnd.randrange(30)}"])
        rows.append((i, " ".join(["wörd"] * rnd.choice([0, 1, 2, 9, 300])) if i % 7 else None, source))
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)


@pytest.mark.parametrize("seed", range(3))
def test_mixing_equals_brute_force(spark, seed):
    rows, df = sourced(spark, seed)
    out = mixing.mix(df, carry=("text",)).persist()
    got = {r.doc_id: r for r in out.collect()}
    size = {i: len((t or "").split()) for i, t, _ in rows}
    by = Counter()
    for i, _, s in rows:
        by[s] += size[i]
    names = sorted((s for s in by if s is not None), key=lambda s: s.encode()) + [None] * (None in by)
    want = dict(zip(names, filled([by[s] for s in names], [(5, 2, 1)[k % 3] for k in range(len(names))], 3, sum(by.values())), strict=True))
    taken = Counter()
    for i, _, s in rows:
        r = got[i]
        assert (r.size, r.source_size) == (size[i], by[s]) and math.isclose(r.target, want[s], rel_tol=1e-9, abs_tol=1e-9) and 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - want[s]) <= 0.5 + 1e-6 for s in names) and any(want[s] == 3 * by[s] > 0 for s in names) and len(got) == len(rows)
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        assert {r.doc_id: r.taken for r in mixing.mix(df.repartition(2)).collect()} == {i: r.taken for i, r in got.items()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    words = Counter()
    for r in mixing.expand(out).collect():
        words[r.doc_id] += len(r.text.split())
    assert words == Counter({i: r.taken for i, r in got.items() if r.taken})
    out.unpersist()


def test_mixing_cuts_within_a_document(spark):
    rows = [(1, "a b c d e f", "x"), (2, " g\n\th ", "y"), (3, "i", "z")]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(1,), carry=("text",))
    assert {r.doc_id: r.taken for r in out.collect()} == {1: 3, 2: 3, 3: 3}
    assert sorted((r.doc_id, r.repeat, r.text) for r in mixing.expand(out).collect()) == [(1, 0, "a b c"), (2, 0, " g\n\th "), (2, 1, " g"), (3, 0, "i"), (3, 1, "i"), (3, 2, "i")]


def test_mixing_cases(spark, odd, none):  # noqa: F811
    out = mixing.mix(odd).collect()
    assert len(out) == odd.count() and all(r.taken == r.size for r in out) and {r.size for r in out if r.doc_id in (1, 2, 3)} == {0}
    assert mixing.mix(none).count() == 0
    nothing = mixing.mix(odd.where("doc_id <= 3")).collect()
    assert len(nothing) == 3 and {(r.target, r.taken) for r in nothing} == {(0.0, 0)}
    assert {r.taken for r in mixing.mix(odd, share=9.0).where("size > 0").select((mixing.F.col("taken") / mixing.F.col("size")).alias("taken")).collect()} == {3.0}


def grams(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(w), Counter(zlib.crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1))


def resampled(rows, items, percent=5):
    made = [(i, *grams(t)) for i, t in rows]
    s, t = sum((g for _, _, g in made), Counter()), sum((grams(x)[1] for x in items), Counter())
    all_s, all_t = s.total(), t.total()
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000)))) for b in s}
    out = []
    for i, n, g in made:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] * c for b, c in g.items())
        out.append((i, n, g.total(), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((-sc, i is None, i or 0, w, f) for i, n, f, w, sc in out if n >= 20)
    ranks = {key: r for r, key in enumerate(able[: percent * len(able) // 100], 1)}
    return sorted(((i, f, w, sc, ranks.get((-sc, i is None, i or 0, w, f)) if n >= 20 else None) for i, n, f, w, sc in out), key=repr)


def rows_of(df):
    return sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in df.collect()), key=repr)


def test_resampling_equals_brute_force(spark):
    rnd = random.Random(3)
    vocabulary = ["Apple", "pear's", "ÉTÉ", "fig_tree", "x1", "42", "naïve", "straße", "日本", "k", "the", "The", "\x7f", "a-b", "ß"] + [f"w{i}" for i in range(60)]
    rows = [(i, rnd.choice([" ", ", ", "\n"]).join(rnd.choices(vocabulary, k=rnd.choice([0, 1, 2, 3, 19, 20, 60, 900])))) for i in range(300)]
    items = [" ".join(rnd.choices(vocabulary[:20], k=40)) for _ in range(30)] + [None, ""]
    target = spark.createDataFrame([(i, t, "s") for i, t in enumerate(items)], "item_id long, text string, score string")
    got, want = rows_of(resampling.resample(docs(spark, rows), target, percent=20)), resampled(rows, items, 20)
    assert got == want and sum(r[4] is not None for r in got) > 20


def test_resampling_cases(spark, odd, none):  # noqa: F811
    target = spark.createDataFrame([(1, "a plain sentence"), (2, None)], "item_id long, text string")
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert rows_of(resampling.resample(odd, target, percent=100)) == resampled(rows, ["a plain sentence", None], 100)
    assert resampling.resample(none, target).count() == 0
    assert rows_of(resampling.resample(odd, target.where("false"))) == resampled(rows, [], 5)


def test_blocks_of_many_sizes(spark, monkeypatch):
    """A matrix in many blocks gives the sums of one block."""
    rnd = random.Random(5)
    rows = [(i, " ".join(f"w{rnd.randrange(50)}" for _ in range(rnd.choice([0, 5, 700])))) for i in range(60)]
    df = docs(spark, rows).coalesce(1)
    one = resampling.matrix(df).persist()
    assert one.count() == 1
    sums = resampling.column_sums(one)
    monkeypatch.setattr(resampling, "ROWS", 7)
    many = resampling.matrix(df).persist()
    assert many.count() == 9 and (resampling.column_sums(many) == sums).all() and sums.sum() == sum(grams(t)[1].total() for _, t in rows)
    one.unpersist(), many.unpersist()


def test_queries_without_sql(spark, small):
    """Registered queries that have no SQL, over the whole tables of the smallest scale."""

    import sentencepiece

    from lexweft.llm import line_dedup, quality, spm, token_counts, toxicity
    from lexweft.llm.common import table
    from lexweft.llm.queries import QUERIES

    got = lambda name: QUERIES[name](spark, small).collect()
    rows, labels = table(spark, small, "documents"), table(spark, small, "labels")
    text = {r.doc_id: r.text for r in rows.collect()}
    assert len(text) == rows.count()

    own = sentencepiece.SentencePieceProcessor(model_file=spm.MODEL)
    coded = {i: np.asarray(own.encode(t or ""), dtype="<i4").tobytes() for i, t in text.items()}
    assert {r.doc_id: (r.n_tokens, r.ids_crc32) for r in got("op8_sentencepiece")} == {i: (len(b) // 4, zlib.crc32(b)) for i, b in coded.items()}

    enc = token_counts.encoding()
    n = lambda t: len(enc.encode_ordinary(t))
    edited = lambda t: "Revised edition. " + t[: len(t) // 2] + " - " + t[len(t) // 2 + 12 :]
    assert {r.doc_id: (r.n_tokens, r.n_tokens_edited) for r in got("op10_token_counts")} == {i: (n(t or ""), n(edited(t or ""))) for i, t in text.items()}

    model, found = toxicity.fit(rows, labels), got("op3_toxicity")
    matcher = toxicity.Matcher(model.entries)
    assert {r.doc_id: (r.held_out, r.score, r.predicted) for r in found} == {i: (zlib.crc32(str(i).encode()) % 5 == 0, s := toxicity.combine(matcher.matches(t), model.patterns), int(s >= 0.5)) for i, t in text.items()}

    scorer, found = quality.Scorer(quality.fit(rows, labels)), got("op9_quality")
    want = dict(zip(text, scorer.scores([*text.values()]).tolist(), strict=True))
    assert all(r.score == pytest.approx(want[r.doc_id], abs=1e-9) and r.predicted == (r.score >= 0.3) for r in found) and len(found) == len(text)

    # What is left of a text is a subsequence of its words; no 29 words in a row of a later document stand in an earlier one.
    left = {r.doc_id: r.text for r in got("op6_line_dedup")}
    runs, span = set(), line_dedup.LONG
    for i in sorted(left):
        words, before = left[i].split(), iter(text[i].split())
        assert all(w in before for w in words)
        mine = [tuple(words[k : k + span]) for k in range(len(words) - span + 1)]
        cut = len(words) < len(text[i].split())
        assert cut or not runs.intersection(mine), i
        runs.update(mine)

    vectors = {r.vec_id: r.embedding for r in table(spark, small, "embeddings").collect()}
    n_rows, deviations, whitened, explained = exact([*vectors.values()], 32)
    at = {i: k for k, i in enumerate(vectors)}
    found = got("op11_embedding_whitening")
    one = np.zeros_like(whitened)
    for r in found:
        one[at[r.vec_id], r.component - 1] = r.whitened
    assert len(found) == 32 * n_rows and np.abs(one * np.sign((one * whitened).sum(axis=0)) - whitened).max() < 1e-6
    assert all(r.deviation == deviations[at[r.vec_id]] and r.explained == pytest.approx(explained[r.component - 1], rel=1e-6) for r in found)


def test_short_items_match_equal_texts(spark):
    from lexweft.llm import decontam

    items = spark.createDataFrame([(1, "Yes, it is"), (2, ""), (3, None), (4, "one two three four five six")], "item_id long, text string")
    rows = [(1, "yes it is!"), (1, "yes it is!"), (2, "yes it is so"), (3, ""), (4, None), (5, "say yes it is"), (None, "YES - IT - IS"), (6, "one two three four five six")]
    got = {(r.doc_id, r.item_id, r.offset, r.matched, r.item_words) for r in decontam.overlaps(docs(spark, rows), items).collect()}
    assert got == {(1, 1, 0, 3, 3), (None, 1, 0, 3, 3), (6, 4, 0, 6, 6)}
    assert sorted(r.doc_id for r in decontam.decontaminate(docs(spark, rows), items).collect()) == [2, 3, 4, 5]
