"""Files read by byte ranges against files read whole."""

import json
import random

import pytest

from lexweft.errors import MalformedDocument
from lexweft.sources import documents, large


def test_scan():
    for text, inside, want in [('[{"a": "x"', False, (1, False)), ('[{"a": "x', False, (2, True)), ('y", "b": {', True, (0, False)), ("no end", True, (0, True)), ('a\\\\"', True, (-1, False)), ('a\\"', True, (0, True)), ("]\n", False, (-2, False)), ('"[{"', False, (-1, False))]:
        assert large.scan(text, inside) == want, text


def nasty(rnd, n):
    """Entries with brackets, quotes, backslashes and line ends in strings, and nested values in further fields."""
    bits = ["}", "{", "[", "]", '"', "\\", "\n", ",", "é", "日本", " word ", "},{", '\\"', "}]"]
    text = lambda: "".join(rnd.choices(bits, k=rnd.choice([0, 1, 5, 40])))
    return [{"id": f"{i:04}", "text": text(), "inner_xml": text(), **({"more": {"deep": [{"er": text()}, 1, None]}} if rnd.random() < 0.4 else {})} for i in range(n)]


@pytest.fixture
def narrow(spark):
    """Ranges of a few hundred bytes."""
    for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        spark.conf.set(k, "300" if "max" in k else "1")
    yield
    for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        spark.conf.unset(k)


@pytest.mark.parametrize("ranges", [200_000, 0])
def test_ranges_equal_whole_files(spark, tmp_path, narrow, monkeypatch, ranges):
    monkeypatch.setattr(large, "RANGES", ranges)
    rnd = random.Random(4)
    for k in range(6):
        made = nasty(rnd, rnd.choice([1, 2, 30]))
        (tmp_path / f"doc {k}+.json").write_text(json.dumps(made, indent=k % 3 or None, ensure_ascii=k % 2 == 0))
    (tmp_path / "empty.json").write_text(" [\n]\n")
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    for d in "ab":
        (tmp_path / d / "same.json").write_text(json.dumps([{"id": d, "text": "x" * 2000, "inner_xml": ""}]))
    rows = lambda df: sorted((r.ref_id, -1 if r.pos is None else r.pos, r.element_id, r.text, r.inner_xml) for r in df.collect())
    want = rows(documents.read_reference(spark, str(tmp_path)))
    found = documents.read_reference(spark, str(tmp_path), large=True)
    assert rows(found) == want and len({r[0] for r in want}) == 8 and large._pieces(spark, str(tmp_path), "*.json").rdd.getNumPartitions() > 20


@pytest.mark.parametrize("bad", ["{}", '{"id": "1", "text": "", "inner_xml": ""}', "[1]", '[{"id": 1, "text": "", "inner_xml": ""}]', '[{"id": "1"}]', '[{"id": "1", "text": "", "inner_xml": ""}', '[{"id": "1", "text": "", "inner_xml": ""} {"id": "1", "text": "", "inner_xml": ""}]', '[{"id": "1", "text": "", "inner_xml": ""}] x', "", "x", '[{"id": "1", "text": "'])
def test_malformed(spark, tmp_path, bad):
    (tmp_path / "ok.json").write_text('[{"id": "1", "text": "t", "inner_xml": ""}]')
    (tmp_path / "bad.json").write_text(bad)
    if bad:  # Spark reads an empty file as no rows at all
        with pytest.raises(MalformedDocument):
            documents.read_reference(spark, str(tmp_path), large=True)
    assert {r.ref_id for r in documents.read_reference(spark, str(tmp_path), strict=False, large=True).where("text = 't'").collect()} == {"ok"}
