"""Labelled files, some of them broken."""

import json

from vetloom.__main__ import main
from vetloom.sources import files
from tests.test_operators import paper, table


def test_broken_records_are_told(spark, tmp_path, capsys):
    folder = tmp_path / "pan"
    folder.mkdir()
    (folder / "good.json").write_text(json.dumps([{"file": "a.png", "name": "N", "pan": "P"}, {"file": "b.png", "name": None, "more": 1}]))
    (folder / "mixed.json").write_text('[{"file": "c.png", "name": {"first": "X"}}, {"file": "d.png", "pan": "Q"}]')
    (folder / "cut.json").write_text('[{"file": "e.png", "na')
    (folder / "empty.json").write_text("[]")
    rows, broken = files.labelled_apart(spark, str(folder), "pan")
    assert {r.file for r in rows.collect()} >= {"a.png", "b.png", "d.png"}
    got = {r.path.rsplit("/", 1)[1]: r.record for r in broken.collect()}
    assert "cut.json" in got and "e.png" in got["cut.json"]
    read = {r.file: r for r in rows.collect()}
    assert ("c.png" in read) == ("mixed.json" not in got)  # a nested value is text where the schema asks for text


def test_evaluate_warns(spark, tmp_path, capsys):
    tokens, truth = str(tmp_path / "tokens"), tmp_path / "truth"
    table(spark, *paper("/in/a.png", "INCOME TAX", "Name", "JOHN DOE", "ABCDE1234F 15/08/1990")).write.parquet(tokens)
    truth.mkdir()
    (truth / "pan_ground_truth.json").write_text("[{")
    assert main(["evaluate", tokens, str(truth), "--doc-type", "pan"]) == 0
    assert "1 broken records" in capsys.readouterr().err
