"""Files, recognisers, reports, and the registry that a stream feeds."""

import json
from collections import Counter

from pyspark.sql import functions as F

from vetloom.plans import catalogue
from vetloom.schemas import VENDORS
from vetloom.sources import clients, files, listing, sinks
from vetloom.streaming.extraction import extract_files
from vetloom.streaming.registry import Registry
from tests.test_operators import results, vendor


def recogniser():
    def read(content, suffix):
        if content == b"broken":
            raise ValueError("not an image")
        if content == b"blank":
            return []
        box = [(0, 0), (40, 0), (40, 12), (0, 12)]
        return [[(box, content.decode(), 0.9)]] * (2 if suffix == ".pdf" else 1)

    return read


def test_uploads_and_recogniser(spark, tmp_path):
    for name, content in (("a.PNG", "one"), ("b.pdf", "two"), ("c.txt", "no"), ("d.jpg", "broken"), ("e.png", "blank")):
        (tmp_path / name).write_text(content)
    (tmp_path / "deep/er").mkdir(parents=True)
    for name in ("empty.png", "deep/er/_hidden none.jpg", "deep/.x"):
        (tmp_path / name).touch()
    taken, refused = files.uploads(spark, str(tmp_path))
    assert {r.path.removeprefix(f"file:{tmp_path}/"): r.message for r in refused.collect()} == {"c.txt": "Unsupported file type: .txt", "empty.png": files.NO_BYTES, "deep/er/_hidden none.jpg": files.NO_BYTES, "deep/.x": "Unsupported file type: .x"}
    assert [(r.path, bytes(r.content)) for r in files.uploads(spark, str(tmp_path / "b.pdf"))[0].collect()] == [(f"file:{tmp_path}/b.pdf", b"two")]
    tokens, failures = files.recognised(taken, recogniser)
    assert sorted((r.doc_id.rsplit("/", 1)[1], r.page_no, r.text) for r in tokens.filter("page_no is not null").collect()) == [("a.PNG", 1, "one"), ("b.pdf", 1, "two"), ("b.pdf", 2, "two")]
    assert [r.message for r in failures.collect()] == ["not an image"]
    assert [r.doc_id.rsplit("/", 1)[1] for r in tokens.filter("page_no is null").collect()] == ["e.png"]


def test_folders_and_files_are_dealt_out(spark, tmp_path, monkeypatch):
    for folder in "abcd":
        (tmp_path / folder).mkdir()
        for i in range(3):
            (tmp_path / folder / f"{i}.png").write_text(folder)
    monkeypatch.setattr(listing, "BATCH_FILES", 2)
    monkeypatch.setattr(listing, "TASK_FILES", 1)
    found = listing.listed(spark, str(tmp_path))
    told = found.select(F.spark_partition_id().alias("task"), F.element_at(F.split("path", "/"), -2).alias("folder")).collect()
    assert len(told) == 12 and len({(r.task, r.folder) for r in told}) == len({r.task for r in told}) == 4  # a task for each folder
    read = listing.contents(found)
    assert read.rdd.getNumPartitions() == 12 and Counter(bytes(r.content) for r in read.collect()) == dict.fromkeys((b"a", b"b", b"c", b"d"), 3)


def test_uploads_are_written_by_many_tasks(spark, small_dir, monkeypatch):
    tasks = []
    monkeypatch.setattr(catalogue, "stored", lambda df: tasks.append(df.rdd.getNumPartitions()))
    monkeypatch.setattr(files, "uploads", lambda spark, folder: (spark.createDataFrame([], "path string, content binary"), spark.createDataFrame([], "path string, message string")))
    catalogue.uploaded_files(spark, small_dir)
    assert tasks[0] >= 8  # the table is one small file, of which one task would write all


def test_extraction_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    run = lambda: extract_files(spark, str(source), recogniser, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    (source / "a.png").write_text("INCOME TAX ABCDE1234F")
    (source / "c.txt").write_text("no")
    run()
    (source / "d.jpg").write_text("broken")
    (source / "none.png").touch()
    run()
    (source / "later.pdf").touch()
    run()
    got = [(r.doc_id.rsplit("/", 1)[1], r.batch, r.status, r.message) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(got) == [("a.png", 0, "success", None), ("c.txt", 0, "failure", "Unsupported file type: .txt"), ("d.jpg", 1, "failure", "not an image"), ("later.pdf", 2, "failure", files.NO_BYTES), ("none.png", 1, "failure", files.NO_BYTES)]
    fields = {r.doc_id: r.fields for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert fields[next(d for d in fields if d.endswith("a.png"))]["pan_number"].value == "ABCDE1234F"


class Ledger:
    def health_check(self):
        return True

    def check_duplicate(self, vendor):
        return vendor["pan"] == "BBBBB1111B"

    def create_vendor(self, vendor):
        if vendor["vendor_name"] == "Odd":
            raise KeyError("odd")
        return clients.Answer(True, "SUCCESS", "made", f"V{vendor['arrival_seq']}")


class Down(Ledger):
    def health_check(self):
        return False


def test_other_clients(spark):
    rows = spark.createDataFrame([vendor(1, "First", pan="AAAAA1111A"), vendor(2, "Second", pan="BBBBB1111B"), vendor(3, "Third", pan="no"), vendor(4, "Odd")], VENDORS)
    got = {r.arrival_seq: r for r in clients.push(rows, Ledger).collect()}
    assert [got[i].error_code for i in range(1, 5)] == ["SUCCESS", "DUPLICATE_VENDOR", "VALIDATION_ERROR", "INTERNAL_ERROR"] and got[1].vendor_id == "V1"
    assert {r.error_code for r in clients.push(rows, Down).collect()} == {"CONNECTION_ERROR"} < set(clients.CODES)


def test_labelled(spark, tmp_path):
    path = tmp_path / "pan.json"
    path.write_text(json.dumps([{"file": "a", "name": "N", "pan": "P", "dob": "D", "father_name": "F"}, {"file": "b"}]))
    assert [(r.file, r.pan) for r in files.labelled(spark, str(path), "pan").orderBy("file").collect()] == [("a", "P"), ("b", None)]


def test_reports(spark):
    lines = {}
    for r in sinks.result_lines(results(spark)).orderBy("doc_id", "line_no").collect():
        lines.setdefault(r.doc_id, []).append(r.line)
    assert lines["pan"][:3] == ["Document Type: PAN", "Status: success", "Extracted Fields:"] and any("name: JOHN DOE (confidence: 0.95)" in x for x in lines["pan"])
    assert lines["empty"][-1] == "No fields extracted." and lines["failed"][-1] == "Error: Could not read document"
    told = json.loads(sinks.as_json(results(spark)).filter("doc_id = 'failed'").first().json)
    assert told == {"document_type": "UNKNOWN", "status": "failure", "message": "Could not read document", "fields": {}}


def test_registry_stream(spark, tmp_path):
    source, registry = tmp_path / "in", Registry(spark, str(tmp_path / "registry"))
    assert registry.count().first()["count"] == 0
    write = lambda rows: spark.createDataFrame(rows, VENDORS).write.mode("append").parquet(str(source))
    feed = lambda: registry.feed(spark.readStream.schema(VENDORS).parquet(str(source)), str(tmp_path / "state"), str(tmp_path / "told")).awaitTermination()
    write([vendor(1, "First", pan="AAAAA1111A"), vendor(2, "Second", pan="AAAAA1111A", gstin="27ABCDE1234F1Z5")])
    feed()
    write([vendor(3, "Third", gstin="27ABCDE1234F1Z5"), vendor(4, "Fourth", pan="aaaaa1111a")])
    feed()
    rows = registry.all().orderBy("arrival_seq").collect()
    assert [r.vendor_name for r in rows] == ["First", "Third"]
    assert registry.get(rows[0].vendor_id).first().vendor_name == "First" and registry.get("none").count() == 0
    told = spark.read.parquet(str(tmp_path / "told")).orderBy("arrival_seq").collect()
    assert [r.error_code for r in told] == ["SUCCESS", "DUPLICATE_VENDOR", "SUCCESS", "DUPLICATE_VENDOR"]
    again = registry.admit(spark.createDataFrame([vendor(3, "Third", gstin="27ABCDE1234F1Z5")], VENDORS), 1)  # the same batch again
    assert again.first().error_code == "SUCCESS" and registry.count().first()["count"] == 2
    registry.clear()
    assert registry.count().first()["count"] == 0
