"""Fields of PAN cards, tax registrations and bank papers, from pages.

Every rule is an expression over one page's text and lines; the only Python
code is the similarity of words to anchors (:func:`layout.marked`) and to the
six registration types.  Rules come in order, and the first that gives a value
counts.  Pages have the columns of :func:`layout.pages`, and may have
``persons``, an array of names from an entity recogniser.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vetloom.functions import identifiers as ids
from vetloom.functions.confidence import exact, hit, repaired
from vetloom.functions.similarity import closest
from vetloom.functions.text import LONG_NUMBER, after, filled, find, find_date, first, first_of, has_any, let, strip, windows, without, words

from . import classify, layout
from .layout import cleaned

#: Registration types of a taxpayer (fixed values).
REGISTRATION_TYPES = ["Regular", "Composition", "Casual Taxable Person", "SEZ Unit", "SEZ Developer", "Input Service Distributor"]
#: Anchors: words that a line must have (fixed values).
ANCHORS = {
    "pan": ["PAN"], "name": ["NAME"], "income_tax": ["INCOME", "TAX"], "govt": ["GOVT", "INDIA"], "permanent": ["PERMANENT", "ACCOUNT"], "father": ["FATHER", "NAME"], "birth": ["DATE", "BIRTH"],
    "legal": ["LEGAL", "NAME"], "trade": ["TRADE", "NAME"], "taxpayer": ["NAME", "OF", "TAXPAYER"], "address": ["ADDRESS"], "principal": ["PRINCIPAL", "PLACE"], "reg_type": ["REGISTRATION", "TYPE"],
    "gstin": ["GSTIN"], "gst": ["GST"], "certificate": ["REGISTRATION", "CERTIFICATE"], "tax_reg": ["TAX", "REGISTRATION"],
    "ifsc_code": ["IFSC", "CODE"], "ifsc": ["IFSC"], "account_no": ["A/C", "NO"],
    "holder_name": ["HOLDER", "NAME"], "account_holder": ["ACCOUNT", "HOLDER"], "beneficiary": ["BENEFICIARY", "NAME"], "customer": ["CUSTOMER", "NAME"], "pay": ["PAY"],
    "signatory": ["SIGNATORY"], "authorised": ["AUTHORISED"], "certify": ["CERTIFY", "THAT"], "account_of": ["ACCOUNT", "OF"], "request_of": ["REQUEST", "OF"],
}
KEYWORDS = sorted({word for some in ANCHORS.values() for word in some})
#: Words that no card holder's name has (fixed values).
CARD_WORDS = ["INCOME", "TAX", "INDIA", "GOVT", "GOVERNMENT", "PERMANENT", "ACCOUNT", "NUMBER", "CARD", "FATHER", "DATE", "BIRTH"]
#: Words that no payee's name from an entity recogniser has (fixed values).
OFFICE_WORDS = ["MANAGER", "OFFICER", "SIGNATORY", "BANK", "DATE", "PLACE"]
#: Labels that are cut out of a line with a tax number, in this order (fixed values).
GST_NOISE = ["GSTIN", "REGISTRATION", "CERTIFICATE", "NUMBER", "NO", "GST", "UIN"]
TITLES = r"(?i)^(MR\.?|MRS\.?|MS\.?|M/S\.?|SHRI\.?|SMT\.?)\s*"
FIELD = "struct<value:string,confidence:double>"


_NUMBER = {name: i for i, name in enumerate(ANCHORS)}


def at(name: str) -> Column:
    """The line of an anchor, null if there is none."""
    return F.get("at", F.lit(_NUMBER[name]))


def line(number: Column) -> Column:
    """A line of the page, null outside it."""
    return F.get("lines", number)


def prepared(pages: DataFrame) -> DataFrame:
    """Adds marks, and ``at``: the line of each anchor."""
    marked = layout.marked(pages, KEYWORDS)
    return marked.withColumn("at", layout.anchors(*ANCHORS.values()))


def no_digit(text: Column) -> Column:
    return ~text.rlike("[0-9]")


def _longer(text: Column, n: int) -> Column:
    return F.length(text) > n


# --- PAN ------------------------------------------------------------------


def find_pan(text: Column) -> Column:
    """A PAN anywhere: as it is, with white space inside, or repaired from a word or a part of one."""
    upper = F.upper(text)
    spaced = find(upper, r"\s*".join(["[A-Z]"] * 5 + ["[0-9]"] * 4 + ["[A-Z]"]))
    cleans = F.transform(words(text), cleaned)
    whole = first_of(cleans, ids.repair_pan)
    parts = F.flatten(F.transform(F.filter(cleans, lambda c: F.length(c) > 10), lambda c: windows(c, 10, F.length(c) - 9)))
    part = first_of(parts, ids.repair_pan)
    return F.coalesce(hit(find(upper, ids.PAN), exact(0.9)), hit(F.replace(spaced, F.lit(" "), F.lit("")), exact(0.85)), hit(whole, repaired(0.8)), hit(part, repaired(0.75)))


def pan_by_anchor() -> Column:
    """A PAN on the line of its label, or the next one."""

    def on(one: Column) -> Column:
        def by_text(clean: Column) -> Column:
            fixed = first_of(windows(clean, 10, F.length(clean) - 10), ids.repair_pan)
            return F.coalesce(hit(find(clean, ids.PAN), exact(one["confidence"])), hit(fixed, repaired(one["confidence"])))

        return let(cleaned(one["text"]), by_text)

    return F.coalesce(on(line(at("pan"))), on(line(at("pan") + 1)))


def pan_name() -> Column:
    """The card holder: by the label, by the best line between the headings, or by the entity recogniser."""
    label, following = line(at("name")), line(at("name") + 1)
    own = ~F.contains(F.upper(label["text"]), F.lit("FATHER"))
    value = after(label["text"], ":")
    inline = F.when(own & F.contains(label["text"], F.lit(":")) & _longer(value, 2) & no_digit(value), value)
    under = strip(following["text"])
    below = F.when(own & _longer(under, 2) & no_digit(under) & ~has_any(F.upper(under), ["FATHER", "DATE", "BIRTH"]), under)
    start = F.coalesce(at("income_tax"), at("govt"), at("permanent"))
    end = F.coalesce(at("father"), at("birth"))
    begin = F.when(start.isNotNull(), start + 1).otherwise(F.greatest(end - 3, F.lit(0)))
    stop = F.coalesce(end, F.least(start + 6, F.size("lines")))
    region = F.when(stop > begin, F.slice("lines", begin + 1, stop - begin)).otherwise(F.slice("lines", 1, 0))

    def scored(one: Column, i: Column) -> Column:
        text = strip(without(strip(one["text"]), r"(?i)^(NAME\s*[:\-])?\s*"))

        def judged(t: Column) -> Column:
            upper = F.upper(t)
            letters = t.rlike(r"\p{L}")
            score = F.lit(10) + F.when(F.contains(t, F.lit(" ")), 5).otherwise(0) - F.when(F.length(t) < 4, 2).otherwise(0) - F.when(letters & (t == F.lower(t)), 5).otherwise(0) + F.when(letters & (t == upper), 2).otherwise(0)
            good = (F.length(t) >= 3) & no_digit(t) & ~has_any(upper, CARD_WORDS)
            return F.when(good, F.struct(score.alias("score"), (-i).alias("order"), t.alias("value"), one["confidence"].alias("confidence")))

        return let(text, judged)

    best = F.array_max(F.filter(F.transform(region, scored), lambda x: x.isNotNull()))
    person = first(F.col("persons"), lambda p: F.length(p) > 3)
    return F.coalesce(hit(inline, label["confidence"]), hit(below, following["confidence"]), let(best, lambda b: hit(b["value"], b["confidence"])), hit(person, 0.65))


# --- tax registrations ----------------------------------------------------


def labelled(name: str, stop: Sequence[str]) -> Column:
    """A value behind its label: after a colon, after the label's words, or on the next line.  No value has a stop word in it."""
    labels = ANCHORS[name]
    one, following = line(at(name)), line(at(name) + 1)
    text = one["text"]
    free = lambda t, banned=stop: ~has_any(F.upper(t), banned)
    value = after(text, ":")
    rest = text
    for word in labels:
        rest = without(rest, rf"(?i)\b{word}\b")
    rest = strip(without(strip(rest), r"^[:\-.]+"))
    colon = F.contains(text, F.lit(":"))
    same = F.when(colon & _longer(value, 2) & free(value), value)
    bare = F.when(~colon & F.contains(text, F.lit(" ")) & _longer(rest, 3) & free(rest), rest)
    below = F.when(free(following["text"]) & free(following["text"], labels), filled(following["text"]))
    found = F.coalesce(hit(same, one["confidence"]), hit(bare, one["confidence"] * 0.8), hit(below, following["confidence"]))
    return let(found, lambda x: hit(x["value"], F.greatest(x["confidence"], F.lit(0.91))))


def tidy_name(value: Column) -> Column:
    """Underscores, semicolons and the spaces around commas and hyphens put right."""
    commas = F.regexp_replace(F.translate(value, "_;", "-,"), r"\s*,\s*", ", ")
    return F.regexp_replace(commas, r"\s*-\s*", "-")


def legal_name() -> Column:
    found = F.coalesce(labelled("legal", ["TRADE", "ADDRESS", "CONSTITUTION"]), labelled("trade", ["ADDRESS", "CONSTITUTION"]), labelled("taxpayer", ["ADDRESS"]))
    return let(found, lambda x: hit(tidy_name(x["value"]), x["confidence"]))


def address() -> Column:
    return F.coalesce(labelled("address", ["DATE", "CONSTITUTION"]), labelled("principal", ["DATE", "CONSTITUTION", "NATURE"]))


def gstin_on(one: Column) -> Column:
    """A tax number on a line: as it is, or repaired from its first windows or its long words."""

    def by_text(clean: Column) -> Column:
        size = F.length(clean)
        tries = F.concat(
            windows(clean, 15, F.least(F.lit(5), size - 14)),
            windows(clean, 14, F.least(F.lit(3), size - 13)),
            F.transform(F.regexp_extract_all(clean, F.lit("[A-Z0-9]{14,}"), 0), lambda w: F.substring(w, 1, 15)),
        )
        fixed = first_of(tries, ids.repair_gstin)
        return F.coalesce(hit(find(clean, ids.GSTIN), exact(one["confidence"])), hit(fixed, repaired(one["confidence"])))

    text = without(F.upper(one["text"]), r"\s+")
    for word in GST_NOISE:
        text = without(text, word)
    return let(without(text, "[^A-Z0-9]"), by_text)


def gstin_candidates() -> Column:
    """All candidates in order: beside or below a label, by entity, fuzzy, by anchor, spaced."""
    upper = F.upper("text")
    boxed = F.transform("tokens", lambda t: F.struct(t["tok_idx"].alias("i"), F.upper(t["text"]).alias("upper"), cleaned(t["text"]).alias("clean"), t["conf"].alias("conf"), layout.bounds(t["box"]).alias("b")))
    labels = lambda all_: F.filter(all_, lambda t: has_any(t["upper"], layout.GSTIN_LABELS))
    values = lambda all_: F.filter(all_, lambda t: F.length(t["clean"]) >= 14)

    def beside(all_: Column) -> Column:
        def of(label: Column) -> Column:
            near = F.filter(values(all_), lambda v: (v["i"] != label["i"]) & (layout.right_of(label["b"], v["b"]) | layout.below(label["b"], v["b"])))
            return F.transform(near, lambda v: hit(ids.repair_gstin(F.substring(v["clean"], 1, 15)), repaired(v["conf"])))

        return F.flatten(F.transform(labels(all_), of))

    entity = find(F.col("text"), r"\S*" + ids.GSTIN + r"\S*")
    fuzzy = first_of(F.regexp_extract_all(upper, F.lit("[A-Z0-9]{15}"), 0), ids.repair_gstin)
    start = F.coalesce(at("gstin"), at("gst"), at("certificate"), at("tax_reg"))
    by_anchor = first_of(F.array(*[F.lit(i) for i in (0, 1, -1, 2, -2, 3, -3)]), lambda i: gstin_on(line(start + i)), FIELD)
    groups = ["[0-9]"] * 2 + ["[A-Z]"] * 5 + ["[0-9]"] * 4 + ["[A-Z]", "[A-Z0-9]", "Z", "[A-Z0-9]"]
    spaced = without(find(upper, r"\s*".join(groups)), r"\s")
    others = F.array(hit(entity, exact(0.8)), hit(fuzzy, repaired(0.75)), by_anchor, hit(spaced, exact(0.85)))
    return F.filter(F.concat(let(boxed, beside), others), lambda x: x.isNotNull())


def best_gstin(candidates: Column) -> Column:
    """The first of the most confident candidates; a right checksum adds 0.2."""
    scored = F.transform(candidates, lambda c, i: F.struct((c["confidence"] + F.when(ids.has_checksum(c["value"]), 0.2).otherwise(0.0)).alias("score"), (-i).alias("order"), c.alias("field")))
    return F.array_max(scored)["field"]


# --- bank papers ----------------------------------------------------------


def ifsc() -> Column:
    """A bank branch code near its label, or anywhere in the text of a page that has one."""
    start = F.coalesce(at("ifsc_code"), at("ifsc"))

    def on(one: Column) -> Column:
        def by_text(clean: Column) -> Column:
            fixed = first_of(F.regexp_extract_all(clean, F.lit("[A-Z0-9]{11}"), 0), ids.repair_ifsc)
            return F.coalesce(hit(find(clean, ids.IFSC), exact(one["confidence"])), hit(fixed, repaired(one["confidence"])))

        return let(without(without(F.upper(one["text"]), r"\b(IFSC|CODE)\b"), "[^A-Z0-9]"), by_text)

    anywhere = F.when(start.isNotNull(), find(F.col("text"), ids.IFSC))
    return F.coalesce(first_of(F.array(*[F.lit(i) for i in (0, 1, -1)]), lambda i: on(line(start + i)), FIELD), hit(anywhere, 0.95))


def account_number() -> Column:
    """The whole line below its label, or the first long number."""
    below = line(at("account_no") + 1)
    return F.coalesce(hit(below["text"], F.greatest(below["confidence"], F.lit(0.91))), hit(find(F.col("text"), LONG_NUMBER), 0.91))


def person(value: Column) -> Column:
    """Without a title in front.  The titles are cut anywhere at the start, as part of a name, too."""
    return strip(without(strip(value), TITLES))


def _named(name: str) -> Column:
    """The payee on the line of a label, or below it."""
    words_ = ANCHORS[name]
    one, following = line(at(name)), line(at(name) + 1)
    text = one["text"]
    dash = F.contains(text, F.lit("-")) & ~F.contains(F.upper(F.substring_index(text, "-", 1)), F.lit("HOLDER"))
    if "PAY" in words_:
        rest = strip(without(text, "(?i)PAY"))
    else:
        rest = F.upper(text)
        for word in [*words_, "ACCOUNT"]:
            rest = without(rest, rf"\b{word}\b")
        rest = let(strip(rest), lambda r: F.when(_longer(r, 2) & no_digit(r), r))
    value = person(F.when(F.contains(text, F.lit(":")), after(text, ":")).when(dash, after(text, "-")).otherwise(rest))
    fine = lambda v: _longer(v, 2) & ~F.contains(v, F.lit("..."))
    own = let(value, lambda v: F.when(fine(v), v))
    under = let(person(following["text"]), lambda v: F.when(fine(v) & no_digit(v), v))
    return F.coalesce(hit(own, one["confidence"]), hit(under, following["confidence"]))


def _plain(value: Column) -> Column:
    return let(value, lambda v: F.when(_longer(v, 3) & no_digit(v), v))


def payee() -> Column:
    """The account holder: by label, above the signature, by a relative, by a certificate's words, by salutation, or by the entity recogniser."""
    sign = F.coalesce(at("signatory"), at("authorised"))
    above = []
    for i in (1, 2):
        one = line(sign - i)
        value = let(person(one["text"]), lambda v: F.when(~has_any(F.upper(v), ["FOR ", "YOURS"]), v))
        above.append(hit(_plain(value), one["confidence"]))
    relative = first_of(F.col("lines"), lambda x: hit(_plain(person(filled(F.regexp_extract(x["text"], r"(?i)([A-Za-z.\s]+)\s+(S/O|D/O|W/O)\s+", 1)))), x["confidence"]), FIELD)
    told = []
    for name in ("certify", "account_of", "request_of"):
        one, following = line(at(name)), line(at(name) + 1)
        parts = F.split(one["text"], f"(?i){ANCHORS[name][-1]}")
        told += [hit(_plain(F.when(F.size(parts) > 1, person(F.element_at(parts, -1)))), one["confidence"]), hit(_plain(person(following["text"])), following["confidence"])]

    def greeted(one: Column) -> Column:
        text = strip(one["text"])
        value = person(F.when(text.rlike(r"(?i)^(MR\.|MRS\.|MS\.|SHRI|SMT)\s+[A-Z\s]+$"), text))
        return hit(_plain(let(value, lambda v: F.when(~F.contains(F.upper(v), F.lit("MANAGER")), v))), one["confidence"])

    entity = first(F.transform("persons", strip), lambda p: (F.length(p) >= 4) & ~has_any(F.upper(p), OFFICE_WORDS))
    entity = F.when(has_any(F.upper("text"), ["CERTIFY", "BANK"]), entity)
    return F.coalesce(*[_named(n) for n in ("holder_name", "account_holder", "beneficiary", "customer", "pay")], *above, relative, *told, first_of(F.col("lines"), greeted, FIELD), hit(entity, 0.70))


# --- documents ------------------------------------------------------------


def _page_rows(pages: DataFrame) -> DataFrame:
    """(doc_id, page_no, document_type, field, value, confidence): a row for each field that a page can have, one without a field for a page without a type.

    Pages are read once; a page's type decides which rules run on it.  The
    similarity functions see only the lines of pages with a type, and values
    that need them.
    """
    if "persons" not in pages.columns:
        pages = pages.withColumn("persons", F.lit(None).cast("array<string>"))
    typed = classify.sticky_type(pages)
    typed = prepared(typed.withColumn("lines", F.when(F.col("document_type") != classify.UNKNOWN, F.col("lines"))))
    date = hit(find_date(F.col("text")), 0.90)
    rules = {
        "PAN": {"pan_number": F.coalesce(find_pan(F.col("text")), pan_by_anchor()), "name": pan_name(), "date_of_birth": date},
        "GST": {"gstin": best_gstin(gstin_candidates()), "legal_name": legal_name(), "address": address(), "registration_date": date, "registration_type": labelled("reg_type", ["DATE", "ADDRESS", "LEGAL"])},
        "CHEQUE": {"payee_name": payee(), "account_number": account_number(), "ifsc_code": ifsc()},
    }
    each = F.when(F.lit(False), F.array().cast(f"array<struct<field:string,hit:{FIELD}>>"))
    for kind, fields in rules.items():
        each = each.when(F.col("document_type") == kind, F.array(*[F.struct(F.lit(n).alias("field"), f.cast(FIELD).alias("hit")) for n, f in fields.items()]))
    # outer: for the other kind the optimizer would repeat all rules in a filter below it
    rows = typed.select(*layout.PAGE, "document_type", each.alias("_each")).select(*layout.PAGE, "document_type", F.explode_outer("_each").alias("x"))
    found = rows.select(*layout.PAGE, "document_type", "x.field", "x.hit.value", "x.hit.confidence")
    snapped = closest(REGISTRATION_TYPES)(F.when(F.col("field") == "registration_type", F.col("value")))
    return found.withColumn("value", F.coalesce(snapped, "value"))


def page_fields(pages: DataFrame) -> DataFrame:
    """(doc_id, page_no, document_type, field, value, confidence) for all fields of pages with a type."""
    return _page_rows(pages).filter("value is not null")


def _best() -> Column:
    """The most confident value, that of the earliest page among equals."""
    return F.max_by(F.struct("value", "confidence"), F.when(F.col("value").isNotNull(), F.struct("confidence", -F.col("page_no"))))


def best_fields(fields: DataFrame) -> DataFrame:
    """For each document and field the most confident value, that of the earliest page among equals."""
    return fields.groupBy("doc_id", "field").agg(_best().alias("best")).select("doc_id", "field", "best.value", "best.confidence")


def results(tokens: DataFrame, failures: DataFrame | None = None) -> DataFrame:
    """An extraction result for each document: type, status, message and the map of its fields.

    A document of which ``tokens`` has no token with a place and a text (a row
    without a page tells of a document without any) is a success of unknown
    type without fields.  ``failures`` has (doc_id, message) of documents that
    could not be read.
    """
    rows = _page_rows(layout.pages(tokens)).select("doc_id", "page_no", "document_type", "field", "value", "confidence")
    bare = tokens.filter(F.coalesce(~layout.has_place(), F.lit(True))).select("doc_id").distinct()
    rows = rows.unionByName(bare, allowMissingColumns=True)
    one = rows.groupBy("doc_id", "field").agg(_best().alias("hit"), F.max(F.struct("page_no", "document_type")).alias("last"))
    entry = F.when(filled(F.col("hit.value")).isNotNull() & F.col("field").isNotNull(), F.struct("field", "hit"))
    done = one.groupBy("doc_id").agg(F.max("last").alias("last"), F.array_sort(F.collect_list(entry)).alias("fields"))
    done = done.select("doc_id", F.coalesce("last.document_type", F.lit(classify.UNKNOWN)).alias("document_type"), F.lit("success").alias("status"), F.lit(None).cast("string").alias("message"), F.map_from_entries("fields").alias("fields"))
    if failures is not None:
        none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast(f"array<{FIELD}>"))
        failed = failures.select("doc_id", F.lit(classify.UNKNOWN).alias("document_type"), F.lit("failure").alias("status"), "message", none.alias("fields"))
        done = done.join(failures.select("doc_id"), "doc_id", "left_anti").unionByName(failed)
    return done
