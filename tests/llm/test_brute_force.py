"""Operators against brute force, and learnt ones on held-out labels."""

import random

import numpy as np
import pytest

from lexweft.llm import ann, common, decontam, line_dedup, quality, spm, token_counts, toxicity, url_filters
from lexweft.llm.common import table
from lexweft.llm.queries import URL_RULES

from .test_cases import docs


def covered(spark, rows):
    """Positions of words that k-grams standing earlier cover, by document."""
    got = {d: set() for d, _ in rows}
    for r in line_dedup.repeated(docs(spark, rows)).collect():
        for i in r.at:
            got[r.did].update(range(i, i + line_dedup.GRAM))
    return got


def earlier(rows, n):
    """Positions of words in n-grams that stand earlier, by brute force over all places."""
    seen, out = set(), {}
    for d, text in rows:
        w, own = text.split(), set()
        for i in range(len(w) - n + 1):
            g = tuple(w[i : i + n])
            if g in seen:
                own.update(range(i, i + n))
            seen.add(g)
        out[d] = own
    return out


@pytest.mark.parametrize("seed", range(3))
def test_line_dedup_finds_all_runs(spark, seed):
    """Documents pieced together from slices of a few texts, so that passages overlap in all ways."""
    rnd = random.Random(seed)
    base = [[f"b{k}x{rnd.randrange(10**6)}" for _ in range(150)] for k in range(8)]
    rows = []
    for d in range(120):
        words = []
        for _ in range(rnd.randrange(1, 5)):
            own, n = rnd.choice(base), rnd.randrange(5, 90)
            at = rnd.randrange(len(own) - n)
            words += own[at : at + n] + [f"d{d}x{rnd.randrange(10**6)}" for _ in range(rnd.choice([0, 0, 1, 20]))]
        rows.append((d, " ".join(words)))
    got, must, may = covered(spark, rows), earlier(rows, line_dedup.GRAM + line_dedup.SPAN - 1), earlier(rows, line_dedup.GRAM)
    assert all(must[d] <= got[d] <= may[d] for d, _ in rows) and sum(map(len, must.values())) > 3000


def test_line_dedup_fingerprints_are_minima_only(spark):
    """Every window has a fingerprint, and there are no more than minima of windows: two for SPAN + 1 words at random."""
    rnd = random.Random(5)
    n = 40000
    rows = [(1, " ".join(f"w{rnd.randrange(10**9)}" for _ in range(n)))]
    at = [-1, *sorted(r.i for r in line_dedup.fingerprints(docs(spark, rows)).collect()), n - line_dedup.GRAM + 1]
    assert max(b - a for a, b in zip(at, at[1:])) <= line_dedup.SPAN
    assert len(at) < 1.04 * n * 2 / (line_dedup.SPAN + 1)


def test_line_dedup_with_common_sentences(spark):
    """A passage goes whole from the later copy, though a sentence in it stands in an earlier third document."""
    rnd = random.Random(11)
    text = lambda n: [f"{rnd.choice('bcdfg')}{rnd.randrange(10**6)}" for _ in range(n)]
    common = [text(n) for n in (15, 18, 28, 40)]
    rows = [(0, " ".join(sum((text(30) + s for s in common), []) + text(20)))]
    for k in range(40):
        passage, s = text(rnd.randrange(40, 70)), common[k % 4]
        at = rnd.choice([0, len(passage), rnd.randrange(len(passage))])
        passage[at:at] = s
        a, b = text(rnd.randrange(1, 40)), text(rnd.randrange(1, 40))
        rows += [(2 * k + 1, " ".join(text(25) + passage + text(25))), (2 * k + 2, " ".join(a + passage + b), " ".join(a + b))]
    got = {r.doc_id: r.text for r in line_dedup.dedup(docs(spark, [r[:2] for r in rows]), long=50).collect()}
    assert all(got[r[0]] == r[-1] for r in rows)


def test_line_dedup_keeps_control_characters(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, long), (2, f"keep\x01this {long} and\x02that")]
    got = {r.doc_id: r.text for r in line_dedup.dedup(docs(spark, rows)).collect()}
    assert got == {1: long, 2: "keep\x01this and\x02that"}


def test_decontamination_by_shuffle(spark, monkeypatch):
    """The same overlaps where the benchmark's index is too large to broadcast; an item's don't depend on other items."""
    rnd = random.Random(8)
    items = {i: [f"w{rnd.randrange(300)}" for _ in range(rnd.randrange(5, 40))] for i in range(30)}
    rows = []
    for d in range(60):
        own = [*items[d % 30]]
        for at in rnd.sample(range(len(own)), len(own) // 5):
            own[at] = "other"
        rows.append((None if d == 7 else d, " ".join([f"w{rnd.randrange(300)}" for _ in range(10)] + own)))
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    want = sorted(map(str, decontam.overlaps(docs(spark, rows), bench).collect()))
    alone = sorted(map(str, decontam.overlaps(docs(spark, rows), bench.where("item_id = 3")).collect()))
    assert len(want) >= 55 and alone == [r for r in want if "item_id=3," in r]
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", -1)
    assert sorted(map(str, decontam.overlaps(docs(spark, rows), bench).collect())) == want


def test_clauses_of_the_grammar():
    """Threats need an intent, a violent verb and a target; phrases make insults; a clause counts once and is read whole."""
    matcher = toxicity.Matcher({k: 0.9 for k in toxicity.INSULTS})
    kinds = lambda t: [[p for p, *_ in own] for own in matcher.matches(t)]
    score = lambda t: toxicity.combine(matcher.matches(t), toxicity.PRIORS)
    assert kinds("you beat me at chess") == kinds("we burn them as fuel, they burn well") == kinds("a piece of cake, trash") == []
    assert kinds("I will kill you") == kinds("ich werde dich umbringen") == kinds("kill yourself") == [["H"]]
    assert kinds("I will not hurt you") == [["NH"]] and kinds("she said they will burn it. We'll stab him") == [["H"]] and kinds('he wrote they will stab him') == [["RH"]]
    assert kinds("what a piece of trash") == [["I"]] and kinds("you piece of trash") == [["TI"]] and kinds("idiot, you. Moron") == [["TI"], ["I"]]
    assert score("idiot idiot idiot") == score("idiot") < score("idiot. idiot")
    for gap in (1, 100, 5000):
        assert kinds("he said " + "and so on " * gap + "that an idiot") == [["RI"]]


#: Ordinary words that begin as insults of the lexicon or learnt ones do.
ORDINARY = "path paths pathway pathology pathos pathfinder Morocco Moroccan morose morokh worth worthy worthwhile Wort Wörter Wortschatz trasferta traslado trastero traspaso idiom idioms idiomatic idiosyncrasy stupor stupendous lose losing loses lost scuba scumbling clover clown-fish trashcan disguise disgorge discuss mordant moral imbue imbibe basil basin escorial escort abschaben abschied ordinal ordure-free connaître connard-bleu crédit crêpe dumbbell dumpling vermicelli verminous arsch arsenal filthier filter bastion bastard-wing losange loserne pathétique".split()
ORDINARY = [w for w in ORDINARY if "-" not in w and w not in ("disgust", "connard")]


def test_ordinary_words_that_begin_like_insults(spark, small):
    """Sentences of ordinary words stay clean under a lexicon learnt from stems and words, whose own forms are found."""
    stems = [f"path{e}" for e in ("etic",)] + [f"zorg{e}" for e in ("an", "el", "is", "ot", "um", "in")]
    clean = " ".join("the way to a village is long and they were told of it in may".split())
    rows = [(i, f"{clean}. {stems[i % len(stems)]} {clean} {stems[(i * 3 + 1) % len(stems)]} number {i}." if i % 4 == 0 else f"{clean} number {i}.") for i in range(1200)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(1200)], "doc_id long, toxic int")
    model = toxicity.fit(docs(spark, rows), labels)
    assert "zorg*" in model.entries and "pathetic" in model.entries and not any(k.endswith("*") and "pathetic".startswith(k[:-1]) for k in model.entries)
    matcher = toxicity.Matcher(model.entries)
    score = lambda t: toxicity.combine(matcher.matches(t), model.patterns)
    frames = ("The {} is long.", "We spoke of {} in May.", "It is {}, they wrote.", "{} and nothing else, you see")
    sentences = [f.format(w) for w in ORDINARY for f in frames]
    assert len(sentences) >= 200 and max(map(score, sentences)) < 0.5
    assert score("what a zorgan") >= 0.5  # a form that was learnt
    assert score("what a zorgwex") < 0.5 <= score("you zorgwex") and score("a zorgwex and a zorgbix") >= 0.5  # forms that weren't


def test_grammar_beats_a_bare_lookup(spark):
    """Quoted, negated and reported insults against plain and aimed ones, on held-out rows: by 30 points at least."""
    words = sorted(toxicity.INSULTS)
    bad = ("You are such a {}.", "What a {} he is, really.", "This {} wrote it again.", "They are {} and you know it")
    fine = ("She said he was called {} at school.", "It isn't {} at all.", 'He wrote "{}" on the board', "Nobody was ever not {} there, never {}.")
    filler = "The village lies by the sea and its market opens early"
    rows = [(i, f"{filler} {i}. {(bad if i % 2 else fine)[i // 2 % 4].format(*[words[i // 8 % len(words)]] * 2)} {filler}.") for i in range(1600)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(1600)], "doc_id long, toxic int")
    model = toxicity.fit(docs(spark, rows), labels)
    got = toxicity.score(docs(spark, rows), model).where("held_out").select("doc_id", "predicted").collect()
    text, lookup = dict(rows), toxicity.Matcher({w: 0.9 for w in words})
    bare = sum(bool(lookup.matches(text[r.doc_id])) == r.doc_id % 2 for r in got) / len(got)
    assert len(got) > 200 and bare < 0.6 and sum(r.predicted == r.doc_id % 2 for r in got) / len(got) >= bare + 0.3


def test_clauses_equal_a_plain_reading():
    """Each machine against a plain rule over the words before, on random clauses."""
    rnd = random.Random(2)
    for _ in range(2000):
        s = rnd.choices("OTNSIMV", k=rnd.randrange(1, 14))
        out = toxicity.grammar().run([*s])
        assert len(out) == len(s)
        for k, (a, o) in enumerate(zip(s, out, strict=True)):
            if a == "I":
                before = s[:k]
                negated = any(b == "N" for b in before[-3:])
                assert o[-1] == "I" and ("R" in o) == ("S" in before) and ("N" in o) == negated
            elif o[-1] == "H":
                assert a in "VT" and "M" in s[:k] and "V" in s[: k + 1] and ("R" in o) == ("S" in s[:k])


@pytest.mark.parametrize("which, at, recall, alarms", [("toxic", 0.5, 0.75, 0.02), ("quality", 0.3, 0.95, 0.35)])
def test_held_out_labels(spark, small, which, at, recall, alarms):
    """Labelled rows outside what was learnt from: recall, false alarms and area under the curve."""
    path = small.replace("sf0.001", "sf0.1")
    rows, labels = table(spark, path, "documents"), table(spark, path, "labels")
    model = toxicity if which == "toxic" else quality
    got = model.score(rows, model.fit(rows, labels)).where("held_out").join(labels, "doc_id").where(f"{which} is not null").select("score", which).collect()
    y, p = np.array([r[1] for r in got]), np.array([r[0] for r in got])
    assert (p[y == 1] >= at).mean() >= recall and (p[y == 0] >= at).mean() <= alarms
    area = (p[y == 1][:, None] > p[y == 0]).mean() + (p[y == 1][:, None] == p[y == 0]).mean() / 2
    assert area >= (0.87 if which == "toxic" else 0.95)


def vectors(kind, n, d=64):
    rng = np.random.default_rng(4)
    if kind == "clusters":
        centres = rng.normal(size=(300, d))
        return centres[rng.integers(0, 300, n)] + 0.35 * rng.normal(size=(n, d))
    x = rng.normal(size=(n, d))
    return x / np.linalg.norm(x, axis=1)[:, None] + (1e8 if kind == "offset" else 0)


@pytest.mark.parametrize("kind, searched", [("clusters", 0.05), ("even", 0.4), ("offset", 0.4)])
def test_nearest_neighbours_of_many_lists(spark, kind, searched):
    """Recall against brute force where lists are pruned, and the share of lists that queries search."""
    x, settings = vectors(kind, 20_000), ann.Settings(per_list=50)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(df, settings).collect():
        got.setdefault(r.query_id, {})[r.vec_id] = r.score
    assert sorted(got) == list(range(0, 20_000, 100)) and {len(v) for v in got.values()} == {10}
    hit = 0
    for q, own in got.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        hit += len(own.keys() & set(np.argpartition(d, 10)[:10].tolist()))
        assert all(s == pytest.approx(d[v], rel=1e-12) for v, s in own.items())
    assert hit >= 0.9 * 2000
    mean = x.mean(axis=0)
    centres, reach = ann.fitted(x - mean, 400, settings)
    graph = ann.CentroidGraph(centres, settings, reach)
    share = np.mean([len(graph.lists(x[q] - mean)) for q in got]) / len(centres)
    print(f"{kind}: {len(centres)} lists, reach {reach:.3f}, recall {hit / 2000:.3f}, {share:.3f} of lists searched")
    assert len(centres) >= 390 and share <= searched


def test_walk_finds_all_lists_within_reach():
    """The graph walk against all distances."""
    x = vectors("even", 5000)
    settings = ann.Settings()
    centres = ann.balanced_centroids(x, 300)
    graph, missed, all_ = ann.CentroidGraph(centres, settings, 1.12), 0, 0
    for q in x[:100]:
        d = np.sqrt(((centres - q) ** 2).sum(axis=1))
        want = set(np.flatnonzero(d <= 1.12 * d.min()).tolist())
        missed += len(want - set(graph.lists(q).tolist()))
        all_ += len(want)
    assert missed <= 0.01 * all_


def test_large_lists_are_split(spark):
    x = vectors("clusters", 3000, 8)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    rows = lambda s: sorted((r.query_id, r.rank, r.vec_id) for r in ann.search(df, s).collect())
    assert rows(ann.Settings(per_list=300, reach=1.2, part=50)) == rows(ann.Settings(per_list=300, reach=1.2))


def test_nearest_ranks_by_exact_differences():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 6)) + 1e8
    x[7] = x[8]
    for i, own in enumerate(ann.nearest(x[:40], x, x.mean(axis=0), 5)):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        assert set(np.argsort(d, kind="stable")[:5].tolist()) <= {j for j, _ in own} and len(own) <= 8


def test_kept_trees_take_further_edits(spark):
    """Trees written, read and edited again against recounts of the edited texts."""
    rnd = random.Random(12)
    counts = token_counts.Counts(token_counts.encoding())
    word = lambda: rnd.choice(["alpha", " beta", "12", "  ", "\n", "été", "!?", " don't", "x" * 300])
    texts = {i: "".join(word() for _ in range(rnd.randrange(400))) for i in range(30)} | {30: None, 31: ""}
    kept = common.scratch(token_counts.trees(spark.createDataFrame([(i, t, 1) for i, t in texts.items()], "doc_id long, text string, n_reencoded int")), "kept-trees")
    for _ in range(3):
        edits = {}
        for i, t in texts.items():
            edits[i] = None if rnd.random() < 0.2 else []
            for _ in range(rnd.randrange(3) if edits[i] is not None else 0):
                a = rnd.randrange(len(t or "") + 1)
                b, new = min(len(t or ""), a + rnd.randrange(30)), "".join(word() for _ in range(rnd.randrange(4)))
                edits[i].append((a, b, new))
                t = (t or "")[:a] + new + (t or "")[b:]
            texts[i] = t
        rows = spark.createDataFrame([*edits.items()], "doc_id long, edits array<struct<start:int,stop:int,new:string>>")
        kept = common.scratch(token_counts.update(kept.join(rows, "doc_id"), "edits"), "kept-trees")
        for r in kept.collect():
            whole = token_counts.TokenTree(texts[r.doc_id] or "", counts)
            assert (r.text, r.n_tokens, r.n_pretokens) == (texts[r.doc_id], whole.n_tokens, whole.n_pretokens)
            assert r.n_reencoded <= 60 and (r.n_reencoded == 0 or edits[r.doc_id])
    assert kept.columns == ["doc_id", "text", "tree", "n_tokens", "n_pretokens", "n_reencoded"]
    with pytest.raises(ValueError):
        token_counts.TokenTree.load("other", token_counts.TokenTree("text here", counts).dump(), counts)


def unigram():
    rnd = random.Random(2)
    pieces = ["<unk>", "▁", "a", "b", "c", "ab", "bc", "abc", "ca", "▁a", "▁ab", "cc"]
    scores = [0.0] + [-rnd.uniform(1, 9) for _ in pieces[1:]]
    return spm.Model(pieces, scores, [spm.UNKNOWN] + [spm.NORMAL] * 11, algorithm=spm.UNIGRAM, byte_fallback=False)


def test_long_words_of_unigram_models():
    """The path of one long word equals the batched one's."""
    rnd = random.Random(6)
    model = unigram()
    for n in (1, 2, 7, 300):
        word = "".join(rnd.choice("abc▁é") for _ in range(n))
        with np.errstate(over="ignore"):
            cuts = spm._viterbi(model, spm._prefix_hashes(spm._codes([word], n)), n)[0].tolist()
        assert spm._long_path(model, word) == [word[a:b] for a, b in zip(cuts, cuts[1:])]  # noqa: B905
    word = "ab" * 5000
    assert len(spm.encode_words(model, [word])[word]) == 4 * len(spm._long_path(model, word))


def test_stated_rules(spark):
    """Each of the stated rules, at hosts and subdomains, the longest first; odd and null urls."""
    want = {
        "https://a.net/es/1": ("net/es/", "block"), "https://a.net/fr/1?x=/en/": ("net/fr/", "block"), "https://a.net/en/1": (None, "allow"), "https://net/fr/": ("net/fr/", "block"),
        "https://example.com/en/1": ("example.com/en/", "block"), "https://m.example.com/en/": ("example.com/en/", "block"), "https://WWW.Example.com/en/x": ("www.example.com/en/", "allow"),
        "https://example.com/de/": ("com/", "allow"), "https://anexample.com/en/": ("com/", "allow"), "https://com/": ("com/", "allow"), "https://com": (None, "allow"),
        "example.net/fr/": (None, "allow"), "https://a.net/" + "fr/" * 50_000: ("net/fr/", "block"), "": (None, "allow"), None: (None, "allow"),
    }
    pages = spark.createDataFrame([(i, u, "x", 1.0) for i, u in enumerate(want)] * 2, "page_id long, url string, rule string, confidence double")
    rules = url_filters.mine(pages, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    got = url_filters.match(pages, URL_RULES, rules).collect()
    assert len(got) == 2 * len(want) and all((r.rule, r.verdict) == [*want.values()][r.page_id] for r in got)


def test_discarded_tables_go(spark, tmp_path):
    before = common.made()
    a, b = (common.scratch(spark.range(3), t) for t in "ab")
    common.discard(before, b)
    assert b.count() == 3 and common.made() == [*before, b._lexweft_path]
    common.discard(before)
    assert common.made() == before and a._lexweft_path != b._lexweft_path


def test_queries_equal_their_sql(spark, small):
    """The registered queries with SQL, at the smallest scale."""
    import duckdb

    from lexweft.llm.queries import ORACLES, QUERIES

    con = duckdb.connect()
    for t in "documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    assert {*ORACLES} == {"op1_url_filters", "op2_ngram_join", "op4_decontamination", "op5_sharding", "op7_nearest_neighbours", "op12_source_mixing", "op13_importance_resampling"}
    for name, sql in ORACLES.items():
        got = QUERIES[name](spark, small)
        columns = sorted(got.columns)
        result = con.execute(sql)
        held = [d[0] for d in result.description]
        assert sorted(held) == columns, name
        plain = lambda r: tuple(round(v, 9) if isinstance(v, float) else v for v in r)
        want = sorted(repr(plain(r[held.index(c)] for c in columns)) for r in result.fetchall())
        assert sorted(repr(plain(r)) for r in got.select(columns).collect()) == want, name
