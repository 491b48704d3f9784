"""Sources, engine and reports over hand-made folders."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexweft import AlignmentEngine, Config
from lexweft.errors import InvalidConfig, MalformedDocument, NoReferenceDocuments
from lexweft.operators import align, rank
from lexweft.operators.index import VectorIndex
from lexweft.operators.numbering import numbered
from lexweft.plans import report
from lexweft.sources import documents, reports
from lexweft.streaming import incremental
from lexweft.streaming.incremental import align_arriving


def put(folder, name, rows):
    path = os.path.join(folder, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(rows if isinstance(rows, str) else json.dumps(rows))


def element(i, text):
    return {"id": i, "text": text, "inner_xml": "", "more": 1}


def block(i, text):
    return {"id": i, "block_type": "Text", "html": "", "text": text}


@pytest.fixture
def folders(tmp_path):
    ref, query, out = (str(tmp_path / d) for d in ("ref", "query", "out"))
    put(ref, "red fox.json", [element("001", "the red fox jumps"), element("002", "over a lazy dog"), element("002", "nothing like it")])
    put(ref, "deep/er/blue-sea.json", [element("001", "waves on the blue sea"), element("003", "ships sail far away")])
    put(ref, "empty.json", [])
    put(ref, "x/same.json", [element("1", "old")])
    put(ref, "y/same.json", [element("1", "new")])
    put(query, "red-fox_processed.json", [block("/page/0/Text/0", "the red fox jumps"), block("/page/0/Text/1", "a lazy dog over"), block("/page/0/Text/2", "")])
    put(query, "nothing_processed.json", [])
    put(query, "ignored.json", [block("1", "x")])
    return ref, query, out


def test_scan(spark, folders):
    ref = documents.read_reference(spark, folders[0])
    rows = {(r.ref_id, r.pos, r.element_id, r.text) for r in ref.collect()}
    assert ("red fox", 0, "001", "the red fox jumps") in rows and ("empty", None, None, None) in rows
    assert ("same", 0, "1", "new") in rows and ("same", 0, "1", "old") not in rows
    assert {r.query_id for r in documents.read_queries(spark, folders[1]).select("query_id").collect()} == {"red-fox_processed", "nothing_processed"}


@pytest.mark.parametrize("bad", ["{", '{"id": "1", "text": "a", "inner_xml": ""}', '[{"id": "1", "text": "a"}]', '[{"id": 1, "text": "a", "inner_xml": ""}]', '[{"id": "1", "text": {"b": 1}, "inner_xml": ""}]', '[{"id": "1", "text": null, "inner_xml": ""}]'])
def test_malformed(spark, tmp_path, bad):
    put(str(tmp_path), "a.json", bad)
    with pytest.raises(MalformedDocument):
        documents.read_reference(spark, str(tmp_path))


def test_missing_folder(spark, tmp_path):
    with pytest.raises(InvalidConfig):
        documents.read_reference(spark, str(tmp_path / "no"))


@pytest.mark.parametrize("scope", ["corpus", "best_document"])
def test_run(spark, folders, tmp_path, scope):
    config = Config(*folders, cache_dir=str(tmp_path / "cache"), dim=32, scope=scope)
    reports = {r.pdf_document_id: r for r in AlignmentEngine(spark, config).run().collect()}
    fox = reports["red-fox_processed"]
    assert fox.best_match.xml_document_id == "red fox"
    assert [d.xml_document_id for d in fox.all_document_scores][0] == "red fox" and len(fox.all_document_scores) == 4
    assert next(d for d in fox.all_document_scores if d.xml_document_id == "empty").similarity == 0.0
    assert [p.xml_element_id for p in fox.paragraph_matches] == ["001", "002", "002"]
    # Elements that share an id share their hits.
    assert [h.pdf_block_id for h in fox.paragraph_matches[1].top_matches] == [h.pdf_block_id for h in fox.paragraph_matches[2].top_matches]
    assert fox.paragraph_matches[0].top_matches[0].pdf_block_id == "/page/0/Text/0"
    assert fox.top_phrase_matches[0].similarity == pytest.approx(1.0)
    assert [p.pdf_block_id for p in fox.best_match.top_phrase_pairs] == ["/page/0/Text/0", "/page/0/Text/1"]  # the empty block has no vector
    s = fox.statistics
    assert (s.total_xml_documents, s.total_xml_elements, s.total_pdf_blocks, s.top_phrase_matches) == (4, 3, 3, [])
    nothing = reports["nothing_processed"]
    assert nothing.best_match.similarity == 0.0 and nothing.top_phrase_matches == [] and nothing.statistics.total_pdf_blocks == 0
    written = json.load(open(os.path.join(folders[2], "red-fox_processed_matches.json")))
    assert written["best_match"]["xml_document_id"] == "red fox" and sum(f.endswith("_matches.json") for f in os.listdir(folders[2])) == 2


def test_run_with_index(spark, folders, tmp_path):
    """Stage 2 through a persisted index gives the exact search's reports at a recall of 1; the index stays."""
    exact = AlignmentEngine(spark, Config(*folders, dim=32)).run().collect()
    config = Config(*folders, dim=32, index_dir=str(tmp_path / "index"), recall=1)
    for _ in range(2):
        assert sorted(AlignmentEngine(spark, config).run().collect()) == sorted(exact)
    assert VectorIndex(spark, config.index_dir, 32).points().count() == 6


def test_no_reference_documents(spark, folders, tmp_path):
    os.makedirs(tmp_path / "none")
    with pytest.raises(NoReferenceDocuments):
        AlignmentEngine(spark, Config(str(tmp_path / "none"), folders[1], folders[2], dim=8)).run()


def test_report_files_are_replaced(spark, tmp_path):
    out = str(tmp_path / "deep" / "out")
    for n in (1, 2):
        rows = [(q, 0, 0, "[") for q in ("a b=c%d", "x")] + [("x", 1, i, f"{'' if i == 0 else ','}{i * n}") for i in range(3)] + [(q, 2, 0, "]") for q in ("x", "a b=c%d")]
        reports.write_files(spark.createDataFrame(rows, "query_id string, section int, place long, body string"), out)
    assert sorted(f for f in os.listdir(out) if not f.startswith(".")) == ["a b=c%d_matches.json", "x_matches.json"]
    assert json.load(open(os.path.join(out, "x_matches.json"))) == [0, 2, 4] and json.load(open(os.path.join(out, "a b=c%d_matches.json"))) == []


def test_a_long_report_is_streamed(spark, tmp_path):
    """A report of 10^6 entries, beside small ones: no row holds it, and its pieces come in order."""
    out = str(tmp_path / "out")
    entry = F.concat(F.when(F.col("id") == 0, "").otherwise(","), F.col("id").cast("string"))
    many = spark.range(1_000_000).select(F.lit("long").alias("query_id"), F.lit(1).alias("section"), F.col("id").alias("place"), entry.alias("body")).repartition(7)
    ends = spark.createDataFrame([(q, s, 0, "[" if s == 0 else "]") for q in ("long", "a", "b") for s in (0, 2)], "query_id string, section int, place long, body string")
    reports.write_files(many.unionByName(ends), out)
    assert json.load(open(os.path.join(out, "long_matches.json"))) == list(range(1_000_000)) and json.load(open(os.path.join(out, "a_matches.json"))) == []


def test_written_files_equal_nested_reports(spark, folders, caplog):
    import logging

    from lexweft import cli

    with caplog.at_level(logging.INFO):
        cli.main(["--reference-dir", folders[0], "--query-dir", folders[1], "--output-dir", folders[2], "--dim", "32", "--head", "5", "--strip-suffix", "--oversample", "3", "--cache-dir", f"{folders[2]}/_cache", "--index-dir", f"{folders[2]}/_index", "--recall", "1", "--large-files", "--clear-cache"])
    config = Config(*folders, dim=32, head=5, strip_suffix=True, oversample=3)
    engine = AlignmentEngine(spark, config)
    for r in engine.run().collect():
        single = lambda x: round(float(np.float32(x)), 6)
        written = json.loads(open(os.path.join(folders[2], f"{r.pdf_document_id}_matches.json")).read(), parse_float=single)
        assert written == json.loads(json.dumps(r.asDict(recursive=True)), parse_float=single)
        ranked = [f"    {i}. {d.xml_document_id} ({d.similarity:.4f})" for i, d in enumerate(r.all_document_scores, 1)]
        assert [m for m in caplog.messages if m.startswith("    ")].count(ranked[0]) >= 1
    log = "".join(open(os.path.join(folders[2], "_statistics", f)).read() for f in sorted(os.listdir(os.path.join(folders[2], "_statistics"))) if f.startswith("part-")).splitlines()
    assert sum(x.startswith("Statistics of ") for x in log) == 2 and sum(x.startswith("    ") for x in log) == 8 and sum(x.startswith("  Best document: ") for x in log) == 2 and len(log) == 2 * (1 + 9 + 1 + 4)
    assert log[:11] == [m for m in caplog.messages if m in log][:11] or set(log) <= set(caplog.messages)
    engine.release()
    with pytest.raises(SystemExit):
        cli.main(["--reference-dir", "x"])


def frames(spark, blocks, elements):
    b = spark.createDataFrame(blocks, "query_id string, pos int, block_id string, text string, vec array<double>")
    e = spark.createDataFrame(elements, "ref_id string, pos int, element_id string, text string, vec array<double>")
    return b, e


def test_pooling_ties_and_zero_vectors(spark):
    b, e = frames(spark, [("q", 0, "b0", "aa", [1.0, 0.0]), ("q", 1, "b1", "aa", [0.0, 0.0])], [("r", 0, "e0", "aa", [0.0, 0.0]), ("r", 1, "e1", "aa", [1.0, 0.0]), ("r", 2, "e2", "aa", [2.0, 0.0])])
    config = Config(dim=2)
    got = rank.max_pool(b, e, config).collect()
    assert [(r.pos, r.element_pos, r.score) for r in got] == [(0, 1, 1.0)]  # first of equals; zero vectors left out
    score = rank.document_scores(b, e, config).first()
    assert score.content == pytest.approx(0.5) and score.score == pytest.approx(0.45)  # the zero block counts in the mean


def test_head_only(spark):
    b, e = frames(spark, [("q", i, f"b{i}", "x", [1.0]) for i in range(12)], [("r", i, f"e{i}", "x", [1.0 if i == 11 else -1.0]) for i in range(12)])
    assert {r.pos for r in rank.max_pool(b, e, Config(dim=1)).collect()} == set(range(10))
    assert rank.max_pool(b, e, Config(dim=1)).agg(F.max("element_pos")).first()[0] == 0  # element 11 isn't seen


@pytest.mark.parametrize("mode, k, rounds", [("composite", 4, 2), ("cosine", 2, 1), ("composite", 64, 1)])
def test_top_documents_equal_all_pairs(spark, mode, k, rounds):
    """By bounds alone, with more neighbours, or with all pairs in the end; zero vectors, empty documents and ties among them."""
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(5, 6)) * 3
    vec = lambda g: (centres[g] + 0.05 * rng.normal(size=6)).tolist()
    b, e = [], []
    for q in range(8):
        b += [(f"q-{q % 5}", i, f"b{i}", "word " * 3, vec(q % 5) if q else [0.0] * 6) for i in range(3)] if q < 5 else []
    for r in range(40):
        e += [(f"r-{r % 5}_{r}", i, f"e{i}", "word " * (3 + r // 20), vec(r % 5) if r % 11 else [0.0] * 6) for i in range(2)]
    e += [(f"twin-{c}", 0, "e", "word " * 3, [1.0] * 6) for c in "ab"] + [("empty", None, None, None, None)]
    b, e = frames(spark, b + [("nothing", None, None, None, None)], e)
    config = Config(dim=6, mode=mode)
    want = rank.document_scores(b, e, config).where("rank <= 3").collect()
    scores, pooled = rank.top_documents(b, e, config, 3, k, rounds)
    got = scores.select("query_id", "ref_id", "content", "filename", "score", "rank").collect()
    assert sorted(got) == sorted(want) and len({r.query_id for r in got}) == 6
    listed = {(r.query_id, r.ref_id) for r in got}
    every = rank.max_pool(b.where("pos is not null"), e.where("pos is not null"), config).collect()
    plain = lambda rows: sorted((r.query_id, r.pos, r.ref_id, r.score, r.element_pos) for r in rows if (r.query_id, r.ref_id) in listed)
    assert plain(pooled.collect()) == plain(every)
    spark.catalog.clearCache()


def test_top_documents_of_few_documents_take_one_pass(spark, monkeypatch):
    """Where there are no more documents than neighbours, lists of neighbours wouldn't be shorter than all pairs."""
    b, e = frames(spark, [(f"q-{q}", i, f"b{i}", "word " * (i + 1), [1.0, float(q), float(i)]) for q in range(6) for i in range(3)], [(f"r-{r}", i, f"e{i}", "word " * (r + 1), [float(r), 1.0, float(i)]) for r in range(4) for i in range(2)])
    config, asked = Config(dim=3), []
    knn = rank.grid.knn
    monkeypatch.setattr(rank.grid, "knn", lambda *a: asked.append(a[2]) or knn(*a))
    got = rank.top_documents(b, e, config, 2, 4)[0].collect()
    assert asked == []
    assert sorted(got) == sorted(rank.document_scores(b, e, config).where("rank <= 2").collect())
    assert sorted(rank.top_documents(b, e, config, 2, 3)[0].collect()) == sorted(got) and asked in ([3], [3, 24])  # of more documents, neighbours come first
    spark.catalog.clearCache()


def test_elements_of_best_documents_are_dealt_by_their_number(spark, monkeypatch):
    """A few bytes of chunks give many rows: tasks go by these, and each element has its own hits."""
    monkeypatch.setattr(align, "CHUNK", 4)
    monkeypatch.setattr(align, "PAIRS", 8)
    elements = spark.createDataFrame([(f"r{i % 2}", i // 2, f"e{i}") for i in range(80)] + [("empty", None, None)], "ref_id string, pos int, element_id string")
    best = spark.createDataFrame([(f"q{i}", f"r{i % 2}") for i in range(20)] + [("none", "empty")], "query_id string, ref_id string")
    hits = [(f"q{i}", f"r{i % 2}", p, rank + 1, 10 * i + rank, 0.5 + rank) for i in range(0, 20, 3) for p in (0, 7, 39) for rank in range(1 + p % 3)]
    each = align.paragraph_matches(spark.createDataFrame(hits, "query_id string, ref_id string, element_pos int, rank int, pos int, similarity double"), elements, best)
    assert each.select(F.spark_partition_id()).distinct().count() > 8  # 4 by the session's partitions, one by the bytes
    own = {}
    for q, r, p, *h in hits:
        own.setdefault((q, r, p), []).append(tuple(h))
    want = [(f"q{i}", f"r{i % 2}", p, f"e{2 * p + i % 2}", *h) for i in range(20) for p in range(40) for h in own.get((f"q{i}", f"r{i % 2}", p), [(None, None, None)])]
    assert sorted(map(repr, map(tuple, each.select("query_id", "ref_id", "element_pos", "element_id", "rank", "pos", "similarity").collect()))) == sorted(map(repr, want))


def test_knn_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    x, y = rng.integers(-2, 3, (40, 4)).astype(float), rng.integers(-2, 3, (70, 4)).astype(float)  # many ties
    x[0] = 1.0
    b, e = frames(spark, [("q", i, "", "", v.tolist()) for i, v in enumerate(x)], [(f"r{i % 3}", i // 3, "", "", v.tolist()) for i, v in enumerate(y)])
    got = {}
    for r in align.neighbours(b, e, Config(dim=4)).collect():
        got.setdefault(r.pos, []).append((-r.semantic, r.ref_id, r.element_pos))
    want = {i: sorted((-float(v @ w), f"r{j % 3}", j // 3) for j, w in enumerate(y))[:6] for i, v in enumerate(x) if v.any()}
    assert {k: sorted(v) for k, v in got.items()} == want


def test_numbering_is_gapless(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("k"))
    rows = numbered(df, ["k"], "n").collect()
    assert sorted(r.n for r in rows) == list(range(1000)) and all(r.k == r.n for r in rows)


def test_config_is_checked():
    with pytest.raises(InvalidConfig):
        Config(top_k=0)
    with pytest.raises(InvalidConfig):
        Config(scope="other")


def test_arriving_files(spark, folders, tmp_path):

    config = Config(*folders, dim=32)
    elements = documents.read_reference(spark, folders[0])
    out, check = str(tmp_path / "reports"), str(tmp_path / "check")
    for name, text in (("first_processed.json", "waves on the sea"), ("second_processed.json", "the red fox")):
        put(folders[1], name, [block("1", text)])
        align_arriving(AlignmentEngine(spark, config), elements, out, check).awaitTermination()
    reports = {r.pdf_document_id: r.best_match.xml_document_id for r in spark.read.parquet(out).collect()}
    assert reports == {"red-fox_processed": "red fox", "nothing_processed": "blue-sea", "first_processed": "blue-sea", "second_processed": "red fox"}
    assert len([d for d in os.listdir(out) if d.startswith("batch=")]) == 2


def test_later_arrivals_replace_earlier_ones(spark, folders, tmp_path):
    """A file of the same stem in another folder, in a later batch: its report counts; others stay."""
    engine = AlignmentEngine(spark, Config(*folders, dim=16))
    elements = documents.read_reference(spark, folders[0])
    out, checkpoint = str(tmp_path / "stream"), str(tmp_path / "cp")
    run = lambda: align_arriving(engine, elements, out, checkpoint).awaitTermination()
    run()
    first = {r.pdf_document_id: r.statistics.total_pdf_blocks for r in incremental.latest(spark, out).collect()}
    put(folders[1], "later/red-fox_processed.json", [block("/page/9", "ships sail far away")])
    run()
    rows = {r.pdf_document_id: r for r in incremental.latest(spark, out).collect()}
    assert first == {"red-fox_processed": 3, "nothing_processed": 0} and set(rows) == set(first)
    assert rows["red-fox_processed"].statistics.total_pdf_blocks == 1 and rows["red-fox_processed"].batch > rows["nothing_processed"].batch
    incremental.fold(spark, out, str(tmp_path / "folded"))
    assert spark.read.parquet(str(tmp_path / "folded")).count() == 2


def test_malformed_arrivals_are_set_aside(spark, folders, tmp_path):

    put(folders[1], "broken_processed.json", "[{")
    out, elements = str(tmp_path / "reports"), documents.read_reference(spark, folders[0])
    engine = AlignmentEngine(spark, Config(*folders, dim=16))
    align_arriving(engine, elements, out, str(tmp_path / "check")).awaitTermination()
    assert {r.pdf_document_id for r in spark.read.parquet(out).collect()} == {"red-fox_processed", "nothing_processed"}
    assert [(r.query_id, r.value) for r in spark.read.parquet(f"{out}_malformed").collect()] == [("broken_processed", "[{")]
    assert engine._kept == []


@pytest.mark.parametrize("mode", ["mean_pairwise", "jaccard"])
def test_modes_that_ranking_has_not_raise(mode):
    with pytest.raises(InvalidConfig):
        Config(mode=mode)


def test_entries_without_hits_are_made_once(spark):
    """However many queries list a document, each of its elements without hits is made once."""
    elements = spark.createDataFrame([("r", i, str(i), f"text {i}") for i in range(50)], "ref_id string, pos int, element_id string, text string")
    best = spark.createDataFrame([(f"q{i}", "r") for i in range(40)], "query_id string, ref_id string")
    blocks = spark.createDataFrame([("q1", 0, "b", "block")], "query_id string, pos int, block_id string, text string")
    top = spark.createDataFrame([("q1", "r", 7, 1, 0, 0.5)], "query_id string, ref_id string, element_pos int, rank int, pos int, similarity double")
    made = spark.sparkContext.accumulator(0)

    def seen(name):
        made.add(1)
        return name

    mark = F.udf(seen, "string")
    rows = report.paragraphs(top, best, blocks, elements, lambda p, pos: F.struct(mark(p["xml_element_id"]).alias("id"), F.size(p["top_matches"]).alias("n"))).collect()
    assert sorted((r.query_id, r.element_pos, r.item.id, r.item.n) for r in rows) == sorted((f"q{i}", j, str(j), int((i, j) == (1, 7))) for i in range(40) for j in range(50))
    assert made.value <= 4 * (50 + 1)
