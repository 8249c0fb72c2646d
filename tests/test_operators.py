"""Layout, extraction, vendors, admission, evaluation: worked examples and plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from tests import model
from vetloom.operators import admission, classify, evaluate, extract, layout, vendors
from vetloom.schemas import RESULTS, TOKENS, VENDORS


def token(doc, page, i, x, y, text, conf=0.9):
    wide = 8.0 * len(text)
    return (doc, page, i, [{"x": float(x), "y": float(y)}, {"x": x + wide, "y": float(y)}, {"x": x + wide, "y": y + 12.0}, {"x": float(x), "y": y + 12.0}], text, conf)


def table(spark, *rows):
    return spark.createDataFrame(list(rows), TOKENS)


def paper(doc, *lines, page=1):
    return [token(doc, page, i, 50, 40 * (i + 1), text) for i, text in enumerate(lines)]


def fields(spark, tokens, failures=None):
    return {r.doc_id: {k: v.value for k, v in r.fields.items()} for r in extract.results(table(spark, *tokens), failures).collect()}


def test_lines_chain_and_order(spark):
    rows = table(spark, token("d", 1, 0, 100, 50, "Name:", 0.9), token("d", 1, 1, 10, 45, "A", 0.8), token("d", 1, 2, 10, 58, "B", 0.7), token("d", 1, 3, 10, 80, "C", 0.6), token("d", 2, 0, 1, 1, "other"))
    got = [(r.page_no, r.line_no, r.text, round(r.confidence, 9)) for r in layout.lines(rows).orderBy("page_no", "line_no").collect()]
    assert got == [(1, 0, "A B Name:", 0.8), (1, 1, "C", 0.6), (2, 0, "other", 0.9)]
    page = layout.pages(rows).filter("page_no = 1").first()
    assert page.text == "Name:\nA\nB\nC" and [x.text for x in page.lines] == ["A B Name:", "C"]


def test_pairs_need_the_right_place(spark):
    label, right, under, far = token("d", 1, 0, 50, 200, "GSTIN"), token("d", 1, 1, 200, 205, "27ABCDE1234F1Z0"), token("d", 1, 2, 50, 250, "27ABCDE1234F1Z0"), token("d", 1, 3, 50, 330, "27ABCDE1234F1Z0")
    got = layout.label_value_pairs(table(spark, label, right, under, far, token("d", 2, 1, 200, 205, "27ABCDE1234F1Z0"))).collect()
    assert sorted((r.value_idx, r.relation) for r in got) == [(1, "right"), (2, "below")]


def test_sticky_type(spark):
    rows = spark.createDataFrame([("d", 1, "nothing"), ("d", 2, "a GSTIN"), ("d", 3, "income tax"), ("e", 1, None)], "doc_id string, page_no int, text string")
    assert [r.document_type for r in classify.sticky_type(rows).orderBy("doc_id", "page_no").collect()] == ["UNKNOWN", "GST", "GST", "UNKNOWN"]


def test_pan_card(spark):
    docs = [
        *paper("exact", "INCOME TAX DEPARTMENT", "Name", "JOHN DOE", "Father's Name", "JIM DOE", "ABCDE1234F", "15/08/1990"),
        *paper("spaced", "INCOME TAX", "ABC DE12 34F"),
        *paper("word", "INCOME TAX", "number 4BCDE1Z34F."),
        *paper("region", "INCOME TAX DEPARTMENT", "GOVT. OF INDIA", "Jane", "JANE ROE", "Father Nome", "x"),
        *paper("none", "INCOME TAX"),
    ]
    got = fields(spark, docs)
    assert got["exact"] == {"pan_number": "ABCDE1234F", "name": "JOHN DOE", "date_of_birth": "15/08/1990"}
    assert got["spaced"]["pan_number"] == "ABCDE1234F" and got["word"]["pan_number"] == "ABCDE1234F"
    assert got["region"]["name"] == "JANE ROE" and got["none"] == {}


def test_registration(spark):
    docs = [
        *paper("colon", "GST REGISTRATION CERTIFICATE", "Legal Name: ACME_CO ; SONS - LTD", "GSTIN: 27ABCDE1234F1Z0", "Address: 12 MAIN ROAD", "Registration Date: 01-04-2020", "Registration Type: Reqular"),
        *paper("below", "REGISTRATION CERTIFICATE", "Trade Name", "BETA", "Principal Place", "SOMEWHERE", "GSTIN", "I1LYWGNI98ZUX2M"),
        *paper("stop", "GSTIN", "Legal Name: BEST TRADERS"),  # not a legal name, but its line has the words of the next label
        *paper("stopped", "GSTIN", "Legal Name: HIS ADDRESS"),
    ]
    got = fields(spark, docs)
    assert got["colon"] == {"gstin": "27ABCDE1234F1Z0", "legal_name": "ACME-CO, SONS-LTD", "address": "12 MAIN ROAD", "registration_date": "01-04-2020", "registration_type": "Regular"}
    assert got["below"]["gstin"] == "11LYWGN1982UXZM" and got["below"]["address"] == "SOMEWHERE" and got["below"]["legal_name"] == "BETA"
    assert got["stop"]["legal_name"] == "BEST TRADERS" and "legal_name" not in got["stopped"]


def test_bank_paper(spark):
    docs = [
        *paper("named", "CANCELLED CHEQUE", "Account Holder Name: MR. RAVI IYER", "Account Number: 123456789012", "IFSC Code: HDFCO001234"),
        *paper("below", "CHEQUE", "A/C NO", "12 34", "IFSC", "SBIN0001234", "Mrs. ASHA DAS"),
        *paper("signed", "CHEQUE", "SOMEBODY ELSE", "Authorised Signatory"),
        *paper("relative", "BANK CHEQUE", "RAVI DAS S/O HARI DAS"),
        *paper("certified", "CHEQUE certificate", "we certify that", "MEERA NAIR"),
    ]
    got = fields(spark, docs)
    assert got["named"] == {"payee_name": "RAVI IYER", "account_number": "123456789012", "ifsc_code": "HDFC0001234"}
    assert got["below"]["account_number"] == "12 34" and got["below"]["ifsc_code"] == "SBIN0001234"
    assert got["signed"]["payee_name"] == "SOMEBODY ELSE" and got["relative"]["payee_name"] == "RAVI DAS"
    assert got["certified"]["payee_name"] == "MEERA NAIR"


def test_best_page_and_failures(spark):
    docs = [*paper("d", "INCOME TAX", "Name", "FIRST ONE"), *[(*t[:5], 0.99) for t in paper("d", "INCOME TAX", "Name", "SECOND ONE", page=2)], *paper("bad", "INCOME TAX")]
    failures = spark.createDataFrame([("bad", "cannot read"), ("gone", "no such file")], "doc_id string, message string")
    rows = {r.doc_id: r for r in extract.results(table(spark, *docs), failures).collect()}
    assert rows["d"].fields["name"].value == "SECOND ONE" and rows["d"].status == "success"
    assert (rows["bad"].status, rows["bad"].document_type, rows["gone"].message) == ("failure", "UNKNOWN", "no such file")


def test_persons_are_a_fallback(spark):
    pages = layout.pages(table(spark, *paper("d", "INCOME TAX", "12"))).withColumn("persons", F.array(F.lit("Al"), F.lit("Jane Roe")))
    assert [(r.field, r.value, r.confidence) for r in extract.page_fields(pages).collect()] == [("name", "Jane Roe", 0.65)]


def test_empty_tables(spark):
    none = table(spark)
    assert extract.results(none).count() == 0 and layout.lines(none).count() == 0 and layout.label_value_pairs(none).count() == 0


def results(spark):
    hit = lambda v, c: {"value": v, "confidence": c}
    rows = [
        ("pan", "PAN", "success", None, {"pan_number": hit("abcde1234f", 0.98), "name": hit("JOHN DOE", 0.95), "date_of_birth": hit("15/08/1990", 0.90)}),
        ("gst", "GST", "success", None, {"gstin": hit(" 27ABCDE1234F1Z5", 0.97), "legal_name": hit("ACME", 0.92), "address": hit("123 MAIN STREET", 0.85), "registration_date": hit("01/04/2020", 0.90)}),
        ("bank", "CHEQUE", "success", None, {"payee_name": hit("JANE SMITH", 0.88), "account_number": hit("123456789012", 0.95), "ifsc_code": hit("HDFC0001234", 0.93)}),
        ("failed", "UNKNOWN", "failure", "Could not read document", {}),
        ("nameless", "PAN", "success", None, {"pan_number": hit("ABCDE1234F", 0.98), "name": hit("", 0.5)}),
        ("empty", "PAN", "success", None, {}),
        ("bad", "CHEQUE", "success", None, {"payee_name": hit("BAD CODE", 0.88), "ifsc_code": hit("nope", 0.93)}),
    ]
    return spark.createDataFrame(rows, RESULTS)


def test_vendors(spark):
    got = {r.doc_id: r for r in vendors.map_vendors(results(spark), keep=("doc_id",)).collect()}
    assert set(got) == {"pan", "gst", "bank", "bad"}
    assert [got[k].confidence_score for k in ("pan", "gst", "bank")] == pytest.approx([0.9671428571428571, 0.93625, 0.9142857142857144], abs=1e-12)
    assert got["pan"].pan == "ABCDE1234F" and got["pan"].bank_details is None and got["gst"].gstin == "27ABCDE1234F1Z5"
    assert got["bank"].bank_details.account_holder == "JANE SMITH" and got["bad"].bank_details.ifsc_code == "NOPE"


def vendor(seq, name="Vendor", pan=None, gstin=None, account=None, ifsc=None):
    return (seq, name, pan, gstin, (account, ifsc, None), None, "PAN", None, 0.9)


def arrivals(spark, *rows):
    return spark.createDataFrame(list(rows), VENDORS)


def outcomes(spark, rows, *args, **kwargs):
    return {r.arrival_seq: (r.error_code, r.message) for r in admission.outcomes(arrivals(spark, *rows), *args, **kwargs).collect()}


def test_outcomes(spark):
    rows = [
        vendor(1, "Test Vendor Ltd", "ABCDE1234F", "27ABCDE1234F1Z5", "123456789012", "HDFC0001234"),
        vendor(2, "", "ZZZZZ9999Z"), vendor(3, "Bad", "INVALID123"), vendor(4, "Bad", None, "INVALID_GSTIN"), vendor(5, "Bad", ifsc="INVALID"),
        vendor(6, "By pan", "abcde1234f"), vendor(7, "By gstin", None, "27abcde1234f1z5"), vendor(8, "By account", account="123456789012"),
        vendor(9, "Free", "", "", ""), vendor(10, "Free", None, None, None), vendor(11, "Simple Vendor", "ZZZZZ9999Z"),
    ]
    got = outcomes(spark, rows)
    assert [got[i][0] for i in range(1, 12)] == ["SUCCESS"] + ["VALIDATION_ERROR"] * 4 + ["DUPLICATE_VENDOR"] * 3 + ["SUCCESS"] * 3
    assert "vendor_name" in got[2][1] and "Invalid PAN format: INVALID123" in got[3][1]
    strict = outcomes(spark, rows, admission.Rules(require_gstin=True))
    assert strict[11] == ("VALIDATION_ERROR", admission.GSTIN_NEEDED) and strict[1][0] == "SUCCESS"
    assert {v[0] for v in outcomes(spark, rows, admission.Rules(simulate_connection_error=True, simulate_timeout=True)).values()} == {"CONNECTION_ERROR"}
    assert outcomes(spark, []) == {}


def test_refused_vendors_hold_nothing(spark):
    rows = [vendor(1, pan="AAAAA1111A"), vendor(2, pan="AAAAA1111A", gstin="27ABCDE1234F1Z5"), vendor(3, gstin="27ABCDE1234F1Z5")]
    assert [v[0] for _, v in sorted(outcomes(spark, rows).items())] == ["SUCCESS", "DUPLICATE_VENDOR", "SUCCESS"]


@pytest.mark.parametrize(("rounds", "group"), [(2, 0), (0, 1_000_000), (1, 10), (2, 10_000)])
def test_rounds_match_one_by_one(spark, rounds, group):
    rng = random.Random(7)
    some = [(i, [f"k{rng.randint(0, 60)}" for _ in range(rng.randint(0, 3))]) for i in range(150)]
    rows = spark.createDataFrame([(i, 0, sorted(set(k))) for i, k in some], "a long, b long, keys array<string>")
    assert sorted(r.a for r in admission.admit(rows, rounds=rounds, group=group).collect()) == model.greedy(some)
    held = spark.createDataFrame([("k1",), ("k2",)], "key string")
    left = [(i, k) for i, k in some if not {"k1", "k2"} & set(k)]
    assert sorted(r.a for r in admission.admit(rows, held, rounds, group).collect()) == model.greedy(left)


def test_long_chains_take_few_rounds(spark, monkeypatch):
    made = []
    one = admission._round
    monkeypatch.setattr(admission, "_round", lambda *a, **k: made.append(1) or one(*a, **k))
    some = [(i, [f"k{i}", f"k{i + 1}"]) for i in range(400)]
    rows = spark.createDataFrame([(i, 0, k) for i, k in some], "a long, b long, keys array<string>")
    assert sorted(r.a for r in admission.admit(rows).collect()) == model.greedy(some) and len(made) == admission.ROUNDS


def test_a_chain_longer_than_a_group(spark, monkeypatch):
    made = []
    one = admission.checkpointed
    monkeypatch.setattr(admission, "checkpointed", lambda df: made.append(1) or one(df))
    n = 200_000
    k = F.col("id")
    rows = spark.range(n).select(k.alias("a"), k.alias("b"), F.array(F.concat(F.lit("k"), k.cast("string")), F.concat(F.lit("k"), (k + 1).cast("string"))).alias("keys"))
    won = admission.admit(rows, rounds=0, group=1000)
    assert won.agg(F.count("*"), F.sum("a"), F.max(F.pmod("a", F.lit(2)))).first()[:] == (n // 2, sum(range(0, n, 2)), 0)
    assert len(made) <= 25 + 10  # steps that double, and the rest of a round


def test_documents_without_tokens(spark):
    docs = [*paper("d", "INCOME TAX"), ("bare", None, None, None, None, None), ("blank", 1, 0, None, "", 0.5), ("bad", None, None, None, None, None)]
    failures = spark.createDataFrame([("bad", "cannot read")], "doc_id string, message string")
    rows = {r.doc_id: (r.status, r.document_type, len(r.fields)) for r in extract.results(table(spark, *docs), failures).collect()}
    assert rows == {"d": ("success", "PAN", 0), "bare": ("success", "UNKNOWN", 0), "blank": ("success", "UNKNOWN", 0), "bad": ("failure", "UNKNOWN", 0)}


def test_push(spark):
    ordered = results(spark).withColumn("arrival_seq", F.monotonically_increasing_id())
    got = {r.doc_id: (r.extraction_status, r.erp_status, r.message) for r in admission.push(ordered).collect()}
    assert got["pan"][:2] == ("success", "success") and got["failed"] == ("failure", "skipped", "Could not read document")
    assert got["nameless"][1] == "failure" and "Could not map" in got["empty"][2] and "Invalid IFSC format: NOPE" in got["bad"][2]
    down = admission.push(ordered, admission.Rules(simulate_timeout=True)).filter("doc_id = 'pan'").first()
    assert down.message == f"ERP Error (TIMEOUT): {admission.TIMED_OUT}"
    assert admission.health(spark, admission.Rules(simulate_connection_error=True)).first().healthy is False


def test_evaluation(spark):
    truth = spark.createDataFrame([("1", "ABCDE1234F", "JOHN DOE", "1/1/2000"), ("2", "ABCDE1234G", None, "2/2/2000"), ("3", " ", "X", "3/3/2000")], "file string, pan string, name string, dob string")
    told = spark.createDataFrame([("1", "pan_number", "abcde1234f "), ("1", "name", "MR JOHN DOE"), ("2", "pan_number", "wrong"), ("2", "name", "EXTRA"), ("3", "pan_number", "X"), ("9", "name", "NOBODY")], "file string, field string, value string")
    counts = evaluate.counts(evaluate.unpivoted(truth, "pan"), told)
    assert {r.gt_key: (r.tp, r.fp, r.fn) for r in counts.collect()} == {"pan": (1, 2, 1), "name": (1, 1, 1), "dob": (0, 0, 3)}
    metrics = {r.gt_key: r for r in evaluate.metrics(counts).collect()}
    assert (metrics["pan"].accuracy, metrics["pan"].precision, metrics["pan"].recall, metrics["pan"].f1_score, metrics["pan"].support) == (0.25, 0.333, 0.5, 0.4, 2)
    assert metrics["dob"].accuracy == 0.0
    summary = evaluate.summary(evaluate.metrics(counts)).first()
    assert (summary.passing_fields, summary.total_fields, summary.verdict) == (0, 3, "NEEDS IMPROVEMENT")
    halves = spark.createDataFrame([("a", "b", 1, 15, 0), ("a", "c", 3, 13, 0)], "doc_type string, gt_key string, tp long, fp long, fn long")
    assert [r.precision for r in evaluate.metrics(halves).orderBy("gt_key").collect()] == [0.062, 0.188]


def test_a_line_is_put_in_upper_case_once(spark):
    pages = spark.createDataFrame([("d", 1, [("Gstin no",), ("x",)])], "doc_id string, page_no int, lines array<struct<text:string>>")
    marked = layout.marked(pages, ["GSTIN", "NO"], fuzzy=False)
    assert marked.first().marks == [["GSTIN", "NO"], []]
    plan = marked._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains(upper" not in plan and plan.count("upper(") == 1
