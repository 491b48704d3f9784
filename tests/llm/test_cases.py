"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexweft.llm import ann, decontam, line_dedup, ngram_join, quality, sharding, spm, token_counts, toxicity, url_filters

DOCS = "doc_id long, text string, lang string, source string, n_chars long, did long, th string, n int, ids string, score string, row_number int, y int, host string"
LONG = " ".join(f"word{i % 977}x{i % 31}" for i in range(30_000))
BIG = 2**60 + 1  # not exact as a double


def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, "s", None if t is None else len(t), 7, "x", 3, "i", "s", 1, 1, "h") for i, t in rows], DOCS)


ROWS = [(1, None), (2, ""), (3, "  \n\t "), (4, "a plain sentence that is long enough to have shingles"), (5, "a plain sentence that is long enough to have shingles"), (5, "a plain sentence that is long enough to have shingles"), (6, LONG), (None, "an id is missing here"), (BIG, "large id"), (7, "x")]


@pytest.fixture(scope="module")
def odd(spark):
    return docs(spark, ROWS)


@pytest.fixture(scope="module")
def none(spark):
    return docs(spark, ROWS).where("false")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i % 3 == 0), "more") for i in range(40)] + [(None, 1, 1, ""), (3, None, None, "")], "doc_id long, quality int, toxic int, text string")


@pytest.fixture(scope="module")
def item(spark):
    return spark.createDataFrame([(1, " ".join(f"alpha{i}" for i in range(20)), "x"), (1, " ".join(f"alpha{i}" for i in range(20)), "x"), (2, None, "x"), (3, "", "x"), (4, "one two three four five six", "x")], "item_id long, text string, n string")


def ids(df):
    return sorted((r.doc_id is None, r.doc_id or 0) for r in df.select("doc_id").collect())


ALL = sorted((i is None, i or 0) for i, _ in ROWS)


def test_sharding(odd, none):
    rows = sharding.shard(odd).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows) == ALL
    by = {r.doc_id: r for r in rows}
    assert (by[1].size, by[1].text_crc32, by[2].size, by[2].text_crc32) == (1, None, 1, 0)
    places = sorted((r.shard, r.slot) for r in rows)
    assert places == sorted((i % 8, i // 8) for i in range(len(ROWS))) and {r.law for r in rows} == {"rows"}
    assert sharding.shard(none).count() == 0


def test_feistel_is_a_bijection():
    import numpy as np

    for n in (1, 2, 3, 5, 64, 1000, 4097):
        x = sharding.permute(np.arange(n), n, 3)
        assert sorted(x) == list(range(n)) and (sharding.unpermute(x, n, 3) == np.arange(n)).all()
    assert sharding.resolve(*sharding.locate(77, 1000, 8, 5), 1000, 8, 5) == 77


def test_toxicity(spark, odd, none, labels):
    model = toxicity.fit(odd, labels)
    scored = toxicity.score(odd, model)
    assert ids(scored) == ALL and scored.where("predicted = 1").isEmpty()
    assert toxicity.score(none, model).isEmpty() and toxicity.fit(none, labels.where("false")).patterns == toxicity.PRIORS
    kept = toxicity.reject(odd, model)
    assert kept.columns == odd.columns and ids(kept) == ALL
    bad = docs(spark, [(1, "you are an idiot."), (2, "this is not stupid."), (3, "he said you are a moron."), (4, "idiotic"), (5, "I will kill you."), (6, "the killing of time.")])
    got = {r.doc_id: r.score for r in toxicity.score(bad, toxicity.fit(bad, labels.where("false"))).collect()}
    assert got[1] >= 0.5 and got[5] >= 0.5 and max(got[2], got[3], got[4], got[6]) < 0.5


def test_grammar_composes():
    machine = toxicity.grammar()
    assert machine.run(list("TOIE")) == ["T", "O", "TI", "E"]
    assert machine.run(list("NOIOOOI")) == ["N", "O", "NI", "O", "O", "O", "I"]
    assert machine.run(list("SOIEI")) == ["S", "O", "RI", "E", "I"] and machine.run(list("IT")) == ["I", "A"]
    step = toxicity.compose(toxicity._reported(), toxicity._negated())
    assert step.run(list("SNI")) == toxicity._negated().run(toxicity._reported().run(list("SNI"))) == ["S", "N", "NRI"]


def test_quality(odd, none, labels):
    model = quality.fit(odd, labels)
    scored = quality.score(odd, model)
    assert ids(scored) == ALL and scored.where("score is null or score < 0 or score > 1").isEmpty()
    assert quality.score(none, model).isEmpty() and quality.fit(none, labels.where("false")).prior == 0.5


def test_token_counts(odd, none):
    enc = token_counts.encoding()
    got = {(r.doc_id, r.n_tokens) for r in token_counts.count(odd).collect()}
    assert got == {(i, len(enc.encode_ordinary(t or ""))) for i, t in ROWS} and token_counts.count(none).isEmpty()
    edits = "array(named_struct('start', -5, 'stop', 3, 'new', 'Ab '), null, named_struct('start', 1000000, 'stop', 0, 'new', ' end'))"
    for r in token_counts.count(odd.withColumn("e", F.expr(edits)), "e").collect():
        text = next(t for i, t in ROWS if i == r.doc_id) or ""
        assert r.n_tokens_edited == len(enc.encode_ordinary("Ab " + text[3:] + " end"))


def test_edits_equal_recounts():
    import random

    rnd, counts = random.Random(5), token_counts.Counts(token_counts.encoding())
    for text in ("", " ", "it's  a   test\n\n 12 é", LONG[:20_000]):
        tree = token_counts.TokenTree(text, counts)
        for _ in range(40):
            i = rnd.randint(0, len(tree.text))
            tree.edit(i, min(len(tree.text), i + rnd.choice([0, 1, 7, 500])), rnd.choice(["", " ", "  x", "'s", "\n\n", "word " * 90]))
            fresh = token_counts.TokenTree(tree.text, counts)
            assert (tree.n_tokens, tree.n_pretokens, int(tree.sums[1, 0])) == (fresh.n_tokens, fresh.n_pretokens, len(tree.text))
    tree = token_counts.TokenTree(LONG, counts)
    assert tree.edit(1000, 1005, "abc") < 20  # only what the edit touches


def test_sentencepiece(spark, odd, none):
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=spm.MODEL)
    coded = spm.encode(odd)
    assert set(coded.columns) == set(odd.columns) and ids(coded) == ALL
    for r in coded.collect():
        text = next(t for i, t in ROWS if i == r.doc_id)
        assert r.ids == (None if text is None else own.encode(text))
    back = {(r.doc_id, r.text) for r in spm.decode(coded).collect()}
    assert back == set(ROWS) and spm.encode(none).isEmpty()
    assert spm.digest(odd).where("not round_trip").isEmpty()
    model = spm.load()
    for text in ("  a", "a▁b", "x\x00<s>", "你好 ὠ0 é", "a" * 3000, "\n\n \t tab", " " * 40, "naïve café 12,345.67 …"):
        assert list(memoryview(spm.encode_batch(model, [text])[0]).cast("i")) == own.encode(text)


def test_viterbi_equals_brute_force():
    """A unigram model's path against all segmentations."""
    import itertools
    import random

    rnd = random.Random(2)
    pieces = ["<unk>", "▁", "a", "b", "c", "ab", "bc", "abc", "ca", "▁a", "▁ab", "cc"]
    scores = [0.0] + [-rnd.uniform(1, 9) for _ in pieces[1:]]
    model = spm.Model(pieces, scores, [spm.UNKNOWN] + [spm.NORMAL] * 11, algorithm=spm.UNIGRAM, byte_fallback=False)
    cost = dict(zip(pieces[1:], (-s for s in scores[1:]), strict=True))
    for word in {"".join(rnd.choice("▁abcx") if i else "▁" for i in range(7)) for _ in range(30)}:
        word = "▁" + word.replace("▁", "")
        best = min(sum(cost.get(p, model.worst if len(p) == 1 else 1e9) for p in (word[i:j] for i, j in itertools.pairwise((0, *cuts, len(word))))) for n in range(len(word)) for cuts in itertools.combinations(range(1, len(word)), n))
        got = memoryview(spm.encode_words(model, [word])[word]).cast("i")
        assert sum(cost[pieces[i]] if i else model.worst for i in got) == pytest.approx(best)


def test_url_filters(spark, labels):
    stated = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/")]
    urls = [None, "", "no scheme", "http://WWW.Example.com/en/1", "http://example.com/en", "http://example.com/en/2?x#y", "http://notexample.com/en/3", "http://a.net/es/4", "http://a.net?x=/es/", "https://a.net#b", "http://a.net/es/4", "x://h\n.com/p\nq"]
    pages = spark.createDataFrame([(i, u, "h", "r", 1) for i, u in enumerate(urls)], "page_id long, url string, host string, rule string, n int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.match(pages, stated, url_filters.mine(pages, labels)).collect()}
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("www.example.com", "/en/1", "www.example.com/en/", "allow") and got[4] == ("example.com", "/en", "com/", "allow")
    assert got[5] == ("example.com", "/en/2", "example.com/en/", "block") and got[6][2:] == ("com/", "allow")
    assert got[7] == got[10] == ("a.net", "/es/4", "net/es/", "block") and got[8] == got[9] == ("a.net", "", None, "allow")
    assert got[11] == ("h\n.com", "/p\nq", "com/", "allow") and len(got) == len(urls)
    empty = pages.where("false")
    assert url_filters.match(empty, stated, url_filters.mine(empty, labels.where("false"))).isEmpty()


def test_mined_rules_equal_counts(spark):
    """Rules against counting every token combination."""
    import itertools

    rows = [(i, f"http://{'spam' if i % 3 == 0 else 'good'}.example.org/{'en' if i % 2 else 'de'}/{i}{'?utm=1' if i % 5 == 0 else ''}") for i in range(150)]
    bad = {i for i, _ in rows if i % 3 == 0 and i % 7}
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i not in bad), 0) for i, _ in rows], "doc_id long, quality int, toxic int")
    got = {r.rule: r.confidence for r in url_filters.mine(pages, labels).collect()}
    tokens = {r.url: sorted(r.t) for r in url_filters.judged(pages).select("url", url_filters.tokens().alias("t")).collect()}
    counts = {}
    for i, u in rows:
        for n in (1, 2, 3):
            for c in itertools.combinations(tokens[u], n):
                k = counts.setdefault(c, [0, 0])
                k[0] += 1
                k[1] += i in bad
    rules = {c: b / n for c, (n, b) in counts.items() if b >= 20 and b / n >= 0.7}
    want = {"&".join(c): p for c, p in rules.items() if not any(set(s) < set(c) and rules[s] >= p for s in rules)}
    assert want and got == pytest.approx(want)


def test_mined_rules_of_four_tokens(spark):
    """A pattern that only host, path, extension and query key tell together, against counts of all lengths."""
    import itertools

    rows = [(i, f"http://{'ab'[i & 1]}.org/{'pq'[i >> 1 & 1]}/{i}.{('htm', 'php')[i >> 2 & 1]}?{'uv'[i >> 3 & 1]}k=1") for i in range(480)]
    bad = {i for i, _ in rows if i % 16 == 15}
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i not in bad), 0) for i, _ in rows], "doc_id long, quality int, toxic int")
    got = {r.rule: r.confidence for r in url_filters.mine(pages, labels).collect()}
    counts = {}
    for r in url_filters.judged(pages).select("url", url_filters.tokens().alias("t"), "path").collect():
        i = int(r.path.split("/")[2].split(".")[0])
        for n in range(1, len(r.t) + 1):
            for c in itertools.combinations(sorted(r.t), n):
                k = counts.setdefault(c, [0, 0])
                k[0] += 1
                k[1] += i in bad
    rules = {c: b / n for c, (n, b) in counts.items() if b >= 20 and b / n >= 0.7}
    want = {"&".join(c): p for c, p in rules.items() if not any(set(s) < set(c) and rules[s] >= p for s in rules)}
    assert got == pytest.approx(want) and min(r.count("&") for r in want) == 3


def test_decontamination(spark, odd, none, item):
    words = [f"alpha{i}" for i in range(20)]
    swapped = [w if i not in (4, 13) else "other" for i, w in enumerate(words)]
    leaks = docs(spark, [(1, "before " + " ".join(words) + " after"), (2, "Before: " + ", ".join(swapped).upper()), (3, " ".join(words[:6]) + " something else entirely"), (4, "one two three four five six"), (None, " ".join(words)), (5, "one two three"), (6, None)])
    got = {(r.doc_id, r.item_id): (r.offset, r.matched, r.item_words) for r in decontam.overlaps(leaks, item).collect()}
    assert got == {(1, 1): (1, 20, 20), (2, 1): (1, 18, 20), (4, 4): (0, 6, 6), (None, 1): (0, 20, 20)}
    left = decontam.decontaminate(leaks, item)
    assert ids(left) == [(False, 3), (False, 5), (False, 6)] and left.columns == leaks.columns
    assert ids(decontam.decontaminate(odd, item)) == ALL and decontam.overlaps(none, item).isEmpty() and decontam.overlaps(odd, item.where("false")).isEmpty()


def test_decontamination_equals_brute_force(spark):
    """Against all alignments, with a quarter of an item's words replaced at random places."""
    import random

    rnd = random.Random(6)
    texts = {i: [f"w{rnd.randrange(4000)}" for _ in range(n)] for i, n in enumerate([*range(5, 56)] * 2)}
    rows = {}
    for i, words in texts.items():
        own = [*words]
        for at in rnd.sample(range(len(own)), len(own) // 4 + i % 7 // 6):  # every seventh has one too many
            own[at] = "other"
        rows[i] = [f"a{k}" for k in range(rnd.randrange(9))] + own + ["z"] * rnd.randrange(9)
    want = set()
    for d, doc in rows.items():
        for i, words in texts.items():
            for off in range(1 - len(words), len(doc)):
                same = [0 <= off + p < len(doc) and doc[off + p] == w for p, w in enumerate(words)]
                if sum(same) >= 0.75 * len(words) or sum(same) >= 21 and any(sum(same[c : c + 24]) >= 21 for c in range(len(same))):
                    want.add((d, i))
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.overlaps(docs(spark, [(d, " ".join(w)) for d, w in rows.items()]), bench).collect()}
    assert got == want and len(want) >= len(texts) * 3 // 4


def test_line_dedup(spark, odd, none):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(30))
    c = " ".join(f"c{i}" for i in range(30))
    rows = docs(spark, [(1, f"{a}\nshort one\n{b}"), (2, f"new line\n  {a}\t\nother"), (3, f"{b}\n\n{c}\nmine"), (4, f"x\n{b}\n{c}"), (5, "short one\nshort one"), (6, f"{a}\n{a}"), (None, c)])
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in line_dedup.dedup(rows).collect()}
    # A null id comes first, so that c stays there.
    assert got[1] == (f"{a}\nshort one\n{b}", 3, 0) and got[2] == ("new line\nother", 3, 1) and got[None][0] == c
    assert got[3] == ("mine", 4, 2) and got[4] == ("x", 3, 2) and got[5] == ("short one\nshort one", 2, 0) and got[6] == ("", 2, 2)
    out = line_dedup.dedup(odd)
    assert ids(out) == ALL and {r.n_lines for r in out.where("doc_id = 1").collect()} == {0} and line_dedup.dedup(none).isEmpty()


def test_line_dedup_within_lines(spark):
    """Passages behind sentence ends within lines; a sentence repeated many times over."""
    sentence = lambda k, n: " ".join(f"s{k}w{i}" for i in range(n)) + "."
    passage = " ".join(sentence(k, 9) for k in range(7))
    rows = [(1, f"First own words. {passage} Then more."), (2, f"Quite other text! {passage}\nand a line"), (3, passage), (4, "Say it. " * 40 + "the end"), (5, "Begin. " + "Say it. " * 40), (6, f"{sentence(0, 9)} {sentence(1, 9)} only eighteen words")]
    got = {r.doc_id: (r.text, r.share_left) for r in line_dedup.dedup(docs(spark, rows)).collect()}
    assert got[1][0] == rows[0][1] and got[2][0] == "Quite other text! and a line" and got[3] == ("", 0.0) and got[6] == (rows[5][1], 1.0)
    assert got[4][0] == "Say it. the end" and got[5][0] == "Begin."  # overlapping repeats leave the first sentence


def test_line_dedup_mid_sentence(spark):
    """Passages of 50 words that start and end anywhere: within sentences, over line ends, without any stop."""
    import random

    rnd = random.Random(3)
    text = lambda n: [f"{rnd.choice('bcdfg')}{rnd.randrange(10**5)}" for _ in range(n)]
    rows, want = [], {}
    for k in range(40):
        passage, n = text(50 + k % 8), rnd.randrange(1, 30)
        if k % 2:  # stops and line ends at random places
            passage = [w + rnd.choice(["", "", "", "", ".", "!\n", "\n"]) for w in passage[:-1]] + passage[-1:]
        for i, (a, b) in enumerate(((text(n), text(40)), (text(25), text(n)))):
            rows.append((2 * k + i, " ".join(a + passage + b)))
            want[2 * k + i] = " ".join(a + b) if i else rows[-1][1]
    runs = {n: " ".join(text(n)) for n in (14, 29, 35, 45, 49)}  # every run that is always found goes, wherever it starts
    rows += [(1000 + n, f"own {t} words") for n, t in runs.items()] + [(2000 + n, f"other {t} text") for n, t in runs.items()]
    kept = dict(rows[-10:]) | {2000 + n: "other text" for n in runs if n >= 29}
    got = {r.doc_id: r for r in line_dedup.dedup(docs(spark, rows)).collect()}
    assert {d: r.text.split() for d, r in got.items()} == {d: t.split() for d, t in (want | kept).items()}
    assert all(got[d].text == t for d, t in want.items() if d % 2 == 0 or d % 4 == 1)
    assert all(got[2 * k].n_removed == 0 and got[2 * k + 1].n_removed > 0 for k in range(40)) and got[2014].n_removed == 0
    fifty = {r.doc_id: r.text for r in line_dedup.dedup(docs(spark, rows), long=50).collect()}
    assert all(fifty[2000 + n] == f"other {t} text" for n, t in runs.items()) and all(fifty[d].split() == t.split() for d, t in want.items())


def test_remnants_of_line_dedup_stay(spark, small):
    """A document keeps its own words however little of it they are; one without own words goes."""
    text = lambda k, n: " ".join(f"{k}{i}" for i in range(n))
    a, b, own = text("a", 110), text("b", 110), text("own", 30)
    rows = docs(spark, [(1, a), (2, b), (3, f"{a}\n{own}\n{b}"), (4, f"{b}\n--\n{a}")])
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.dedup_lines(spark, rows, small).collect()}
    assert got == {1: (a, len(a)), 2: (b, len(b)), 3: (own, len(own))}


def brute(rows, n, percent):
    import re

    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()

    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in enumerate(sets):
        for j in range(i):
            if x and 100 * len(x & sets[j]) >= percent * len(x | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: (len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)}


@pytest.mark.parametrize("n, percent", [(4, 85), (5, 80)])
def test_ngram_join_equals_brute_force(spark, n, percent):
    import random

    rnd, rows = random.Random(n), []
    passage = [f"p{i}" for i in range(60)]
    for size in (1, 3, 5, 6, 9, 14, 30, 70, 200):
        for family in range(4):
            base = [f"w{rnd.randrange(5000)}" for _ in range(size)] + passage * (family == 0 and size > 20)
            for _ in range(14 if family == 1 else 5):
                words = [w if rnd.random() > rnd.choice([0, 0.004, 0.02, 0.05]) else f"v{rnd.randrange(99)}" for w in base]
                cut = rnd.choice([0, 0, 1, 2])
                rows.append((len(rows), rnd.choice([" ", "  ", "\n"]).join(words[cut:]).upper() if rnd.random() < 0.2 else " ".join(words[: len(words) - cut])))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.groups(docs(spark, rows), ngram_join.Join(n, percent)).collect()}
    assert got == brute(rows, n, percent)
    kept = ngram_join.keep_one(docs(spark, rows), ngram_join.Join(n, percent))
    assert {r.doc_id for r in kept.collect()} == {d for d, (size, c) in got.items() if d == c or not size}


def test_links_of_large_groups_are_counted(spark):
    """n_linked by brute force, among more near copies than are compared in pairs."""
    import random

    rnd, rows = random.Random(8), []
    for size in (40, 90):
        base = [f"w{rnd.randrange(10**6)}" for _ in range(size)]
        for _ in range(25):
            words = [*base]
            for at in rnd.sample(range(size - 9, size), rnd.randrange(3)):
                words[at] = f"v{rnd.randrange(10**6)}"
            rows.append((len(rows), " ".join(words)))
    sets = {d: frozenset(zip(*(t.split()[i:] for i in range(4)), strict=False)) for d, t in rows}
    want = {d: len({y for y in sets.values() if y != x and 100 * len(x & y) >= 85 * len(x | y)}) for d, x in sets.items()}
    got = {r.doc_id: r.n_linked for r in ngram_join.groups(docs(spark, rows), ngram_join.Join(4, 85), count=True).collect()}
    assert got == want and max(want.values()) > 8


def test_ngram_join_cases(odd, none):
    join = ngram_join.Join(4, 85)
    got = [(r.doc_id, r.n_shingles > 0, r.component_id) for r in ngram_join.groups(odd, join).collect()]
    assert sorted(got, key=str) == sorted([(1, False, 1), (2, False, 2), (3, False, 3), (4, True, 4), (5, True, 4), (5, True, 4), (6, True, 6), (None, True, None), (BIG, True, BIG), (7, True, 7)], key=str)
    assert ids(ngram_join.keep_one(odd, join)) == [x for x in ALL if x[1] != 5] and ngram_join.groups(none, join).isEmpty()


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(200, 100)], "a long, b long")
    assert {(r.node, r.comp) for r in ngram_join.components(edges).collect()} == {(i, 0) for i in range(61)} | {(100, 100), (200, 100)}


def test_nearest_neighbours(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 8)).astype(np.float32)
    x[700:1000] = x[5]  # one vector many times
    rows = [(i, [float(c) for c in v], 1, 2) for i, v in enumerate(x)]
    odd = [(2000, None), (2100, []), (2200, [0.0] * 8), (2300, [float("nan")] * 8), (2400, [float("inf")] + [1.0] * 7), (2500, [None] + [1.0] * 7), (2600, [1.0] * 3), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows + [(*r, 1, 2) for r in odd], "vec_id long, embedding array<float>, v int, h int")
    got = {}
    for r in ann.search(df, ann.Settings(per_list=100)).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert sorted(got) == list(range(0, 1500, 100))
    hit = 0
    for q, own in got.items():
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(axis=1))
        d[q] = np.inf
        best = np.lexsort((np.arange(1500), d))[:10]
        hit += len({v for _, v, _ in own} & set(best.tolist()))
        assert [k for k, _, _ in sorted(own)] == list(range(1, 11)) and all(s == pytest.approx(d[v]) for _, v, s in own)
    assert hit >= 0.9 * 150 and [v for _, v, _ in sorted(got[700])] == [5, *range(701, 710)]
    assert ann.search(df.where("false")).isEmpty() and ann.search(df.where("vec_id < 4")).count() == 3


def test_stages(spark, odd, none, small):
    for rows in (odd, none):
        out = rows
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, out, small)
            assert out.columns == rows.columns
        last = corpus_pipeline.STAGES[-1][1](spark, out, small)
        assert "ids" in last.columns
        # One of the two equal sentences goes; nothing else in these rows is toxic, repeated or leaked.
        assert ids(last) == ([] if rows is none else [x for x in ALL if x[1] != 5])


def test_line_dedup_stage_keeps_own_columns(spark, small):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = docs(spark, [(1, passage), (2, f"own {passage}")]).withColumns({"n_removed": F.lit("mine"), "share_left": F.col("doc_id"), "n_lines": F.lit(None).cast("int")})
    out = corpus_pipeline.dedup_lines(spark, rows, small)
    assert out.schema["n_removed"].dataType == rows.schema["n_removed"].dataType and out.columns == rows.columns
    assert {(r.doc_id, r.text, r.n_removed, r.share_left, r.n_lines) for r in out.collect()} == {(1, passage, "mine", 1, None), (2, "own", "mine", 2, None)}


def test_null_trees_are_built(spark):
    kept = token_counts.trees(docs(spark, [(1, "some text here"), (2, None)]))
    new = docs(spark, [(3, "new words of it"), (4, None), (4, None)]).select("doc_id", "text")
    both = kept.unionByName(new, allowMissingColumns=True).withColumn("e", F.expr("array(named_struct('start', 0, 'stop', 0, 'new', 'Ab '))"))
    want = {r.doc_id: r.n_tokens for r in token_counts.count(both.withColumn("text", F.concat(F.lit("Ab "), F.coalesce("text", F.lit("")))).select("doc_id", "text")).collect()}
    got = token_counts.update(both, "e").collect()
    assert len(got) == 5 and {r.doc_id: r.n_tokens for r in got} == want and all(r.tree is not None for r in got)
    plain = token_counts.update(both.withColumn("e", F.lit(None)), "e").collect()
    assert {r.doc_id: (r.text is None, r.n_tokens) for r in plain}[4] == (True, 0)


def test_training_rows_are_bounded(spark):
    from lexweft.llm.common import training_sample

    many = spark.range(5000).select(F.lit(2).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, toxic int")
    sample = training_sample(many.unionByName(many), labels, "toxic", 10, 1000)
    assert sample.count() == 1 and sample.first().text == training_sample(many.repartition(3), labels, "toxic", 10, 1000).first().text


def test_pipeline_on_planted_cases(spark, tmp_path, small):
    import random

    rnd = random.Random(9)
    bench = spark.read.parquet(f"{small}/benchmark.parquet").orderBy("item_id").first().text
    text = lambda n: " ".join(f"{rnd.choice('bcdfg')}{rnd.randrange(10**6)}" for _ in range(n))
    clean, passage = [text(80) for _ in range(6)], text(60)
    near = clean[0].split()
    near[40] = "changed"
    rows = [*enumerate(clean), (10, " ".join(near)), (11, clean[1]), (12, text(30) + " " + bench + " " + text(30)), (13, f"{text(40)}\n{passage}\n{text(40)}"), (14, f"{text(50)}\n{passage}\n{text(50)}"), (15, text(30) + " you idiot " + text(30))]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{small}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert sorted(out) == [0, 1, 2, 3, 4, 5, 13, 14]
    assert all(out[i].text == t for i, t in enumerate(clean)) and passage in out[13].text and passage not in out[14].text
    assert out[14].n_chars == len(out[14].text) and spm.decode_batch(spm.load(), [b"".join(i.to_bytes(4, "little") for i in out[14].ids)]) == [out[14].text]


def test_sharding_places_follow_row_numbers(spark):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(100)], "doc_id long, text string")
    got = {r.doc_id: (r.shard, r.slot, r.text_crc32) for r in sharding.shard(df).collect()}
    assert all(got[i] == (*sharding.locate(i, 100, 8, 20), zlib.crc32(f"t{i}".encode())) for i in range(100))


def test_line_dedup_lets_go_of_shuffle_files_before_large_steps(spark, monkeypatch):
    """The texts' shuffle and those of all words around open ends don't stand beside each other on disk."""
    done, write, let_go = [], line_dedup.scratch, line_dedup.release
    monkeypatch.setattr(line_dedup, "scratch", lambda df, tag, **o: (write(df, tag, **o), done.append(tag))[0])
    monkeypatch.setattr(line_dedup, "release", lambda *a: (let_go(*a), done.append("let go")))
    text = " ".join(f"w{i}" for i in range(60))
    out = line_dedup.dedup(spark.createDataFrame([(1, text), (2, "x " + text)], "doc_id long, text string"))
    assert {r.doc_id: r.text for r in out.collect()} == {1: text, 2: "x"}
    assert [done[done.index(tag) + 1] for tag in ("around", "first-around", "runs")] == ["let go"] * 3
