"""The command line over a small table of tokens."""

import json

from tests.test_operators import paper, table
from vetloom.__main__ import main


def test_extract_and_evaluate(spark, tmp_path, capsys):
    tokens, out, truth = str(tmp_path / "tokens"), str(tmp_path / "out"), tmp_path / "truth"
    table(spark, *paper("/in/a.png", "INCOME TAX", "Name", "JOHN DOE", "ABCDE1234F 15/08/1990"), *paper("/in/b.png", "INCOME TAX")).write.parquet(tokens)
    assert main(["extract", tokens, out]) == 0
    assert "Document Type: PAN" in [r.value for r in spark.read.text(out).collect()]
    assert main(["extract", tokens, out, "--output", "json"]) == 0
    assert {json.loads(r.value)["status"] for r in spark.read.text(out).collect()} == {"success"}
    truth.mkdir()
    assert main(["evaluate", tokens, str(truth)]) == 0
    assert "no labelled file" in capsys.readouterr().err
    (truth / "pan_ground_truth.json").write_text(json.dumps([{"file": "a.png", "name": "JOHN DOE", "pan": "ABCDE1234F", "dob": "15/08/1990"}, {"file": "b.png", "name": "X Y"}]))
    capsys.readouterr()
    assert main(["evaluate", tokens, str(truth), "--doc-type", "pan", "--output", "json"]) == 0
    assert {r["gt_key"]: r["accuracy"] for r in json.loads(capsys.readouterr().out)} == {"pan": 1.0, "name": 0.5, "dob": 1.0}
    assert main(["evaluate", tokens, str(truth), "--doc-type", "pan"]) == 0
    assert "Fields at the target: 2/3" in capsys.readouterr().out
    assert main(["extract", str(tmp_path / "missing"), out]) == 1


def recogniser():
    def read(content, suffix):
        if content == b"broken":
            raise ValueError("not an image")
        return [[([(0, 0), (40, 0), (40, 12), (0, 12)], content.decode(), 0.9)]] if content != b"blank" else []

    return read


def test_uploaded_files_and_exit_codes(spark, tmp_path, capsys):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    (folder / "a.png").write_text("INCOME TAX")
    (folder / "empty.pdf").write_text("blank")
    one = ["extract", str(folder), out, "--output", "json", "--recogniser", "tests.test_cli:recogniser"]
    assert main(one) == 0
    assert sorted(json.loads(r.value)["document_type"] for r in spark.read.text(out).collect()) == ["PAN", "UNKNOWN"]
    assert main([one[0], str(folder / "a.png"), *one[2:]]) == 0
    (folder / "none.png").touch()
    assert main(one) == 1
    (folder / "none.png").unlink()
    (folder / "d.jpg").write_text("broken")
    (folder / "c.txt").write_text("no")
    assert main(one) == 1
    told = [json.loads(r.value) for r in spark.read.text(out).collect()]
    assert sorted(t.get("message", "") for t in told) == ["", "", "Unsupported file type: .txt", "not an image"]
    assert main([*one[:-1], "no.such:module"]) == 2
    assert main([]) == 0 and "extract" in capsys.readouterr().out
