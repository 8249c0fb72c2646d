"""All queries over the driver's tables, and their SQL twins.

Each query applies operators of the library to whole tables.  Where it reads
the paper corpus, both sides derive the corpus from the same SQL
(:mod:`vetloom.plans.corpus`); what follows from there is written apart.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vetloom.functions import confidence, similarity, text
from vetloom.functions import identifiers as ids
from vetloom.operators import admission, classify, evaluate, extract, layout, vendors
from vetloom.session import shared_folder, stored
from vetloom.sources import clients, files, sinks
from vetloom.streaming.registry import Registry

from . import corpus
from .corpus import BASE36, DUCK

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function as a query of its name, with its twin."""

    def register(function: Callable[[SparkSession, str], DataFrame]):
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


PEOPLE = f"people AS ({DUCK.people()})"
TOKENS = f"tokens AS ({DUCK.tokens()})"
ARRIVALS = f"arrivals AS ({DUCK.arrivals()})"

# --- kinds of document ----------------------------------------------------

_KIND = """CASE WHEN contains(upper(t), 'INCOME TAX') OR contains(upper(t), 'PERMANENT ACCOUNT') THEN 'PAN'
  WHEN contains(upper(t), 'GSTIN') OR contains(upper(t), 'REGISTRATION CERTIFICATE') THEN 'GST'
  WHEN contains(upper(t), 'CHEQUE') OR contains(upper(t), 'IFSC') THEN 'CHEQUE' ELSE 'UNKNOWN' END"""
_SENTENCE = "CASE c_custkey % 6 WHEN 0 THEN 'Income Tax Department' WHEN 1 THEN 'a permanent account' WHEN 2 THEN 'the gstin' WHEN 3 THEN 'Registration Certificate, cheque' WHEN 4 THEN 'an ifsc code' ELSE 'income, tax' END || ' of ' || c_name"


@query(f"""SELECT 'document' AS origin, doc_id AS id, {_KIND} AS document_type FROM (SELECT doc_id, text AS t FROM documents)
UNION ALL SELECT 'customer', c_custkey, {_KIND} FROM (SELECT c_custkey, {_SENTENCE} AS t FROM customer)""")
def classify_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.lit("document").alias("origin"), F.col("doc_id").alias("id"), F.col("text").alias("t"))
    more = table(spark, sf_dir, "customer").select(F.lit("customer").alias("origin"), F.col("c_custkey").alias("id"), F.expr(_SENTENCE).alias("t"))
    return docs.unionByName(more).select("origin", "id", classify.document_type(F.col("t")).alias("document_type"))


_WORDS = "text || CASE (conv_id * 7 + turn) % 11 WHEN 0 THEN ' INCOME TAX' WHEN 1 THEN ' gstin' WHEN 2 THEN ' Cheque' ELSE '' END"


@query(f"""WITH k AS (SELECT conv_id, turn, nullif({_KIND}, 'UNKNOWN') AS kind FROM (SELECT conv_id, turn, {_WORDS} AS t FROM conversations))
SELECT conv_id, turn, coalesce(first_value(kind IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'UNKNOWN') AS document_type FROM k""")
def sticky_page_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(_WORDS).alias("text"))
    return classify.sticky_type(pages, "conv_id", "turn").select("conv_id", "turn", "document_type")


# --- text and identifiers -------------------------------------------------


def _repair(word: str) -> str:
    fixed = f"(translate(substr({word}, 1, 5), '01582647', 'OISBZGAZ') || translate(substr({word}, 6, 4), 'OILSBZGA', '01158264') || translate(substr({word}, 10, 1), '01582647', 'OISBZGAZ'))"
    return f"CASE WHEN length({word}) = 10 AND regexp_full_match({fixed}, '{ids.PAN}') THEN {fixed} END"


_PAN_TEXT = "CASE k % 5 WHEN 0 THEN 'PAN: ' || pan || ' end' WHEN 1 THEN 'no ' || substr(lower(pan), 1, 3) || ' ' || substr(pan, 4, 4) || '  ' || substr(pan, 8, 3) WHEN 2 THEN 'it is ' || pan_read || ', ok' WHEN 3 THEN 'ab-' || pan_read || '/77 x' ELSE name END"
_SPACED_PAN = r"\s*".join(["[A-Z]"] * 5 + ["[0-9]"] * 4 + ["[A-Z]"])


@query(f"""WITH {PEOPLE}, t AS (SELECT k, {_PAN_TEXT} AS t FROM people),
w AS (SELECT k, upper(t) AS u, list_transform(list_filter(regexp_split_to_array(t, '\\s+'), lambda x: x <> ''), lambda x: regexp_replace(upper(x), '[^A-Z0-9]', '', 'g')) AS words FROM t),
c AS (SELECT k, nullif(regexp_extract(u, '{ids.PAN}'), '') AS a, nullif(replace(regexp_extract(u, '{_SPACED_PAN}'), ' ', ''), '') AS b,
  list_filter(list_transform(words, lambda x: {_repair('x')}), lambda x: x IS NOT NULL)[1] AS c,
  list_filter(list_transform(flatten(list_transform(list_filter(words, lambda x: length(x) > 10), lambda x: list_transform(range(1, length(x) - 8), lambda i: substr(x, i, 10)))), lambda y: {_repair('y')}), lambda y: y IS NOT NULL)[1] AS d FROM w)
SELECT k, coalesce(a, b, c, d) AS value, CASE WHEN a IS NOT NULL THEN 0.948 WHEN b IS NOT NULL THEN 0.928 WHEN coalesce(c, d) IS NOT NULL THEN 0.91 END::DOUBLE AS confidence FROM c""")
def find_pan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract.find_pan(F.expr(_PAN_TEXT))
    return corpus.people(spark, sf_dir).select("k", found.alias("x")).select("k", "x.value", F.round("x.confidence", 6).alias("confidence"))


@query(f"WITH {PEOPLE} SELECT k, {_repair('pan_read')} AS repaired, {_repair('name')} AS of_name FROM people")
def repair_pan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.people(spark, sf_dir).select("k", ids.repair_pan(F.col("pan_read")).alias("repaired"), ids.repair_pan(F.col("name")).alias("of_name"))


_DAY = "substr(CAST(o_orderdate AS STRING), 9, 2) || CASE WHEN o_orderkey % 3 = 0 THEN '-' ELSE '/' END || substr(CAST(o_orderdate AS STRING), 6, 2) || CASE WHEN o_orderkey % 5 = 0 THEN '.' ELSE '-' END || substr(CAST(o_orderdate AS STRING), 1, 4)"


@query(f"SELECT o_orderkey, nullif(regexp_extract('dated ' || {_DAY} || ' or 1/2/1999', '{text.DATE}'), '') AS found FROM orders")
def find_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", text.find_date(F.expr(f"'dated ' || {_DAY} || ' or 1/2/1999'")).alias("found"))


_IFSC_READ = "CASE s_suppkey % 3 WHEN 0 THEN 'HDFC' WHEN 1 THEN '5B1N' ELSE 'UT1B' END || CASE s_suppkey % 4 WHEN 0 THEN '0' WHEN 1 THEN 'O' WHEN 2 THEN 'D' ELSE 'X' END || lpad(CAST(s_suppkey AS STRING), 5, 'O') || CASE WHEN s_suppkey % 7 = 0 THEN '' ELSE 'A' END"
_IFSC_FIXED = "(translate(substr(w, 1, 4), '01582647', 'OISBZGAZ') || translate(substr(w, 5, 1), 'ODQUCG', '000000') || translate(substr(w, 6, 6), 'O', '0'))"


@query(f"SELECT s_suppkey, CASE WHEN length(w) = 11 AND regexp_full_match({_IFSC_FIXED}, '{ids.IFSC}') THEN {_IFSC_FIXED} END AS repaired FROM (SELECT s_suppkey, {_IFSC_READ} AS w FROM supplier)")
def repair_ifsc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.expr(_IFSC_READ).alias("w")).select("s_suppkey", ids.repair_ifsc(F.col("w")).alias("repaired"))


def _check(g: str, i: str = "i") -> str:
    """The check character of a tax number, in DuckDB."""
    p = f"((instr('{BASE36}', substr({g}, {i}, 1)) - 1) * (2 - {i} % 2))"
    return f"substr('{BASE36}', ((36 - list_sum(list_transform(range(1, 15), lambda {i}: {p} // 36 + {p} % 36)) % 36) % 36)::INTEGER + 1, 1)"


def _valid(g: str, i: str = "i") -> str:
    return f"(regexp_full_match({g}, '[0-9A-Z]{{15}}') AND {_check(g, i)} = substr({g}, 15, 1))"


@query(f"WITH {PEOPLE} SELECT k, {_check('body')} AS check_character, coalesce({_valid('gstin')}, false) AS own, coalesce({_valid('gstin_read')}, false) AS as_read, coalesce({_valid('name')}, false) AS of_name FROM people")
def gstin_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.people(spark, sf_dir).select("k", ids.check_character(F.col("body")).alias("check_character"), *[ids.has_checksum(F.col(c)).alias(n) for c, n in (("gstin", "own"), ("gstin_read", "as_read"), ("name", "of_name"))])


def _attempt(w: str, mode: int) -> str:
    fixed = (
        f"(translate(substr({w}, 1, 2), '{ids.GST_STATE[mode][0]}', '{ids.GST_STATE[mode][1]}') || translate(substr({w}, 3, 5), '{ids.GST_LETTER[0]}', '{ids.GST_LETTER[1]}') || translate(substr({w}, 8, 4), '{ids.GST_DIGIT[mode][0]}', '{ids.GST_DIGIT[mode][1]}')"
        f" || translate(substr({w}, 12, 1), '{ids.GST_LETTER[0]}', '{ids.GST_LETTER[1]}') || substr({w}, 13, 1) || translate(substr({w}, 14, 1), '2S5', 'ZZZ') || substr({w}, 15, 1))"
    )
    return f"CASE WHEN regexp_full_match({fixed}, '{ids.GSTIN}') THEN {fixed} END"


def _swaps(one: str, based: str) -> list[str]:
    out = [one]
    for start, stop, old, new in ids.SWAPS:
        for i in range(start, stop + 1):
            now, apt = f"substr({one}, {i}, 1)", f"translate(substr({one}, {i}, 1), '{old}', '{new}')"
            fits = f"{apt} <> {now}" + (f" AND {now} = substr({based}, {i}, 1)" if start == 8 else "")
            out.append(f"CASE WHEN {fits} THEN substr({one}, 1, {i - 1}) || {apt} || substr({one}, {i + 1}, 15) END")
    return out


_GST_READ = "CASE k % 7 WHEN 0 THEN gstin_read WHEN 1 THEN substr(gstin, 2, 14) WHEN 2 THEN substr(gstin, 1, 14) WHEN 3 THEN translate(gstin, '0', 'O') WHEN 4 THEN substr(gstin, 1, 11) || translate(substr(gstin, 12, 1), 'Q', 'O') || substr(gstin, 13, 3) WHEN 5 THEN substr(gstin, 1, 13) || '2' || substr(gstin, 15, 1) ELSE substr(gstin, 1, 9) || 'A' || substr(gstin, 11, 5) END"
_BASE = "(substr(word, 1, 7) || translate(substr(word, 8, 4), 'OISBAZ', '015847') || substr(word, 12, 3) || translate(substr(word, 15, 1), 'O', '0'))"


def _repaired(source: str) -> str:
    """CTEs that end with ``fixed``: k, candidate and repaired, from the candidates w of ``source``."""
    return f"""r AS ({source}),
g AS (SELECT k, w, CASE WHEN length(w) = 14 THEN ['0' || w, '1' || w, '2' || w, '3' || w, w || 'Z', w || '5', w || '0'] ELSE [w] END AS guesses FROM r),
e AS (SELECT k, w, unnest(guesses) AS guess, generate_subscripts(guesses, 1) AS n FROM g),
a AS (SELECT k, w, n, {_attempt('guess', 0)} AS a, {_attempt('guess', 1)} AS b, {_attempt('guess', 2)} AS c FROM e),
f AS (SELECT k, w, n, CASE WHEN {_valid('a')} THEN a WHEN {_valid('b')} THEN b WHEN {_valid('c')} THEN c ELSE coalesce(a, b) END AS r FROM a),
short AS (SELECT k, min_by(r, n) AS r FROM f WHERE length(w) = 14 AND {_valid('r')} GROUP BY k),
long AS (SELECT k, r, coalesce(r, w) AS word FROM f WHERE length(w) = 15),
v AS (SELECT k, r, word, {_BASE} AS base FROM long WHERE NOT coalesce({_valid('r')}, false)),
x AS (SELECT k, r, [{', '.join(_swaps('word', 'base') + _swaps('base', 'base'))}] AS all_ FROM v),
y AS (SELECT k, unnest(all_) AS one, generate_subscripts(all_, 1) AS n FROM x),
z AS (SELECT k, min_by(one, n) AS one FROM y WHERE one IS NOT NULL AND {_valid('one')} AND regexp_full_match(one, '{ids.GSTIN}') GROUP BY k),
fixed AS (SELECT g.k, g.w AS candidate, CASE WHEN length(g.w) = 14 THEN short.r ELSE coalesce(z.one, long.r) END AS repaired
  FROM g LEFT JOIN short USING (k) LEFT JOIN long USING (k) LEFT JOIN z USING (k))"""


@query(f"WITH {PEOPLE}, {_repaired(f'SELECT k, {_GST_READ} AS w FROM people')} SELECT * FROM fixed")
def repair_gstin(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus.people(spark, sf_dir).select("k", F.expr(_GST_READ).alias("candidate"))
    return rows.select("k", "candidate", ids.repair_gstin(F.col("candidate")).alias("repaired"))


@query(f"WITH {PEOPLE} SELECT k, coalesce({' + '.join(f'(({x}) IS NOT NULL)::BIGINT' for x in _swaps('word', 'base') + _swaps('base', 'base'))}, 0) AS n_variants FROM (SELECT k, word, {_BASE} AS base FROM (SELECT k, gstin_read AS word FROM people))")
def gstin_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.people(spark, sf_dir).select("k", F.size(ids.variants(F.col("gstin_read"))).cast("long").alias("n_variants"))


@query("SELECT p_partkey, greatest(0.6::DOUBLE * 0.98::DOUBLE + 0.4::DOUBLE * (p_size / 50.0)::DOUBLE, 0.9::DOUBLE) AS exact, greatest(0.5::DOUBLE * 0.85::DOUBLE + 0.5::DOUBLE * (p_size / 50.0)::DOUBLE, 0.91::DOUBLE) AS repaired FROM part")
def confidence_weighting(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("p_size") / F.lit(50.0)
    return table(spark, sf_dir, "part").select("p_partkey", confidence.exact(c).alias("exact"), confidence.repaired(c).alias("repaired"))


@query(r"SELECT p_partkey, upper(regexp_replace(t, '^\s+|\s+$', '', 'g')) AS plain, translate(upper(regexp_replace(t, '^\s+|\s+$', '', 'g')), 'OILSBZG', '0115826') AS ocr FROM (SELECT p_partkey, '  ' || p_name || chr(10) AS t FROM part)")
def normal_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.expr("'  ' || p_name || chr(10)")
    return table(spark, sf_dir, "part").select("p_partkey", text.normal(t).alias("plain"), text.ocr_normal(t).alias("ocr"))


@query(r"""WITH a AS (SELECT p_partkey, list_distinct(string_split(upper(p_name), ' ')) AS g, list_distinct(string_split(upper(p_type || ' ' || substr(p_name, 1, 12)), ' ')) AS p FROM part)
SELECT p_partkey, len(list_intersect(g, p))::DOUBLE / len(g) >= 0.7 AS matches, len(list_intersect(g, list_concat(g, p)))::DOUBLE / len(g) >= 0.7 AS more_is_fine FROM a""")
def relaxed_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    other = F.expr("p_type || ' ' || substr(p_name, 1, 12)")
    return table(spark, sf_dir, "part").select("p_partkey", text.relaxed_match(F.col("p_name"), other).alias("matches"), text.relaxed_match(F.col("p_name"), F.concat(other, F.lit(" "), "p_name")).alias("more_is_fine"))


@query(r"SELECT doc_id, nullif(regexp_extract(text, '\b[0-9]{9,18}\b'), '') AS account_number FROM documents")
def account_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.find(F.col("text"), text.LONG_NUMBER).alias("account_number"))


_COMPANY = "replace(c_name, '#', ' - ') || '_CO ; ' || c_mktsegment || ' ,LTD'"


@query(rf"SELECT c_custkey, regexp_replace(regexp_replace(translate({_COMPANY}, '_;', '-,'), '\s*,\s*', ', ', 'g'), '\s*-\s*', '-', 'g') AS tidy FROM customer")
def legal_name_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", extract.tidy_name(F.expr(_COMPANY)).alias("tidy"))


_BANK = DUCK.pick([*ids.BANK_CODES, "NO BANK"], "s_suppkey")


@query(f"WITH b(bank, code) AS (VALUES {', '.join(f'({chr(39)}{n}{chr(39)}, {chr(39)}{c}{chr(39)})' for n, c in ids.BANK_CODES.items())}) SELECT s_suppkey, n.bank, b.code FROM (SELECT s_suppkey, lower({_BANK}) AS bank FROM supplier) n LEFT JOIN b ON upper(n.bank) = b.bank")
def bank_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.expr(f"lower({_BANK})").alias("bank")).select("s_suppkey", "bank", ids.bank_code(F.col("bank")).alias("code"))


#: The longest common block of ``a`` and ``b``, the first in ``a``: its length times 1000, and 999 less its place.
_BLOCK = "list_max(list_transform(range(1, length(a) + 1), lambda i: 1000 * len(list_filter(range(1, length(a) - i + 2), lambda n: contains(b, substr(a, i, n)))) + 999 - i))"


def _ratios(pairs: str, cutoff: float) -> str:
    """CTEs that end in ratios(one, two, ratio): pairs (one, two) by matching blocks, found by a recursive query."""
    return f"""pairs AS (SELECT DISTINCT one, two FROM ({pairs}) WHERE 2 * least(length(one), length(two)) >= {cutoff} * (length(one) + length(two))),
parts AS (SELECT one, two, one AS a, two AS b FROM pairs
  UNION ALL SELECT one, two, unnest([substr(a, 1, i - 1), substr(a, i + n)]), unnest([substr(b, 1, instr(b, substr(a, i, n)) - 1), substr(b, instr(b, substr(a, i, n)) + n)])
  FROM (SELECT *, t // 1000 AS n, 999 - t % 1000 AS i FROM (SELECT *, {_BLOCK} AS t FROM parts WHERE a <> '' AND b <> '')) WHERE n > 0),
ratios AS (SELECT one, two, 2.0::DOUBLE * sum(coalesce({_BLOCK}, 0) // 1000)::DOUBLE / (length(one) + length(two)) AS ratio FROM parts GROUP BY one, two HAVING ratio >= {cutoff})"""


_MEMBERS = "SELECT unnest([" + ", ".join(f"'{m}'" for m in extract.REGISTRATION_TYPES) + "]) AS m"


@query(f"""WITH RECURSIVE p AS ({DUCK.people()}), {_ratios(f"SELECT m AS one, unnest([type_read, upper(type_read)]) AS two FROM p, ({_MEMBERS})", similarity.SNAP_CUTOFF)},
best AS (SELECT two, max(struct_pack(r := ratio, m := one)).m AS m FROM ratios GROUP BY two)
SELECT k, type, u.m AS of_upper, b.m AS snapped FROM p LEFT JOIN best u ON u.two = upper(type_read) LEFT JOIN best b ON b.two = type_read""")
def snap_registration_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.people(spark, sf_dir).select("k", "type", similarity.closest(extract.REGISTRATION_TYPES)(F.upper("type_read")).alias("of_upper"), similarity.closest(extract.REGISTRATION_TYPES)(F.col("type_read")).alias("snapped"))


# --- layout ---------------------------------------------------------------

_LINES = f"""{TOKENS}, j AS (SELECT *, CASE WHEN abs(y - lag(y) OVER w) >= 10 THEN 1 ELSE 0 END AS jump FROM tokens WINDOW w AS (PARTITION BY doc_id, page_no ORDER BY y, x, tok_idx)),
n AS (SELECT *, (sum(jump) OVER (PARTITION BY doc_id, page_no ORDER BY y, x, tok_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::INTEGER AS line_no FROM j),
plain_lines AS (SELECT doc_id, page_no, line_no, string_agg(text, ' ' ORDER BY x, y, tok_idx) AS line, avg(conf) AS confidence, arg_min(x, x) AS left_x FROM n GROUP BY ALL),
lines AS (SELECT doc_id, page_no, line_no, line, round(confidence, 9) AS confidence, left_x FROM plain_lines)"""


@query(f"WITH {_LINES} SELECT doc_id, page_no, line_no, line, confidence, left_x FROM lines")
def line_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.lines(corpus.tokens(spark, sf_dir)).select("doc_id", "page_no", "line_no", F.col("text").alias("line"), F.round("confidence", 9).alias("confidence"), F.get("box", F.lit(0))["x"].alias("left_x"))


@query(f"WITH {_LINES}, t AS (SELECT doc_id, page_no, string_agg(text, chr(10) ORDER BY tok_idx) AS text FROM tokens GROUP BY ALL) SELECT doc_id, page_no, text, (SELECT count(*) FROM lines l WHERE l.doc_id = t.doc_id AND l.page_no = t.page_no) AS n_lines FROM t")
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.pages(corpus.tokens(spark, sf_dir)).select("doc_id", "page_no", "text", F.size("lines").cast("long").alias("n_lines"))


@query(f"""WITH {TOKENS}, b AS (SELECT *, x AS x0, x + 8 * length(text) AS x1, y AS y0, y + 12 AS y1, x + 4 * length(text) AS xc, y + 6 AS yc FROM tokens),
v AS (SELECT *, regexp_replace(upper(text), '[^A-Z0-9]', '', 'g') AS clean FROM b)
SELECT l.doc_id, l.page_no, l.tok_idx AS label_idx, v.tok_idx AS value_idx, CASE WHEN v.x0 > l.x1 AND v.yc BETWEEN l.y0 - 10 AND l.y1 + 10 THEN 'right' ELSE 'below' END AS relation, v.clean, v.conf
FROM b l JOIN v ON l.doc_id = v.doc_id AND l.page_no = v.page_no AND l.tok_idx <> v.tok_idx
WHERE (contains(upper(l.text), 'GSTIN') OR contains(upper(l.text), 'GST NUMBER')) AND length(v.clean) >= 14
  AND ((v.x0 > l.x1 AND v.yc BETWEEN l.y0 - 10 AND l.y1 + 10) OR (v.y0 > l.y1 AND v.y0 <= l.y1 + 100 AND v.xc BETWEEN l.x0 - 20 AND l.x1 + 100))""")
def spatial_label_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.label_value_pairs(corpus.tokens(spark, sf_dir))


_SHOWN = ("name", "income_tax", "legal", "gst", "reg_type", "ifsc_code", "holder_name", "account_no")


def _anchors(spark: SparkSession, sf_dir: str, fuzzy: bool) -> DataFrame:
    marked = layout.marked(layout.pages(corpus.tokens(spark, sf_dir)), extract.KEYWORDS, fuzzy)
    rows = marked.select("doc_id", "page_no", layout.anchors(*[extract.ANCHORS[n] for n in _SHOWN]).alias("at"))
    return rows.select("doc_id", "page_no", *[F.get("at", F.lit(i)).alias(n) for i, n in enumerate(_SHOWN)])


_ANCHOR = lambda n: "min(CASE WHEN " + " AND ".join(f"contains(upper(line), '{k}')" for k in extract.ANCHORS[n]) + f" THEN line_no END)::INTEGER AS {n}"


@query(f"WITH {_LINES} SELECT doc_id, page_no, {', '.join(map(_ANCHOR, _SHOWN))} FROM lines GROUP BY doc_id, page_no")
def anchors_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _anchors(spark, sf_dir, False)


_SPLIT = r"list_transform(regexp_split_to_array(upper(line), '[\s\x1c-\x1f\x85\p{Z}]+'), lambda w: regexp_replace(w, '[^\p{L}\p{N}_]', '', 'g'))"
_KEYS = "SELECT unnest([" + ", ".join(f"'{k}'" for k in extract.KEYWORDS) + "]) AS k"
_NEAR = lambda n: f"min(CASE WHEN len(list_intersect(keys, {extract.ANCHORS[n]})) = {len(extract.ANCHORS[n])} THEN line_no END)::INTEGER AS {n}"


@query(f"""WITH RECURSIVE {_LINES}, words AS (SELECT doc_id, page_no, line_no, unnest({_SPLIT}) AS word FROM lines), {_ratios(f"SELECT word AS one, k AS two FROM words, ({_KEYS})", similarity.ANCHOR_CUTOFF)},
marks AS (SELECT doc_id, page_no, line_no, two AS k FROM words JOIN ratios ON word = one UNION SELECT doc_id, page_no, line_no, k FROM lines, ({_KEYS}) WHERE contains(upper(line), k)),
marked AS (SELECT doc_id, page_no, line_no, list(k) AS keys FROM marks GROUP BY ALL)
SELECT doc_id, page_no, {", ".join(map(_NEAR, _SHOWN))} FROM lines LEFT JOIN marked USING (doc_id, page_no, line_no) GROUP BY doc_id, page_no""")
def anchors_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _anchors(spark, sf_dir, True)


#: Words of documents that are like a keyword: letters alone, of which a text has many.
_KEYWORD_LIKE = r"unnest(regexp_extract_all(upper(text), '[A-Z]+')) AS word"


@query(f"""WITH RECURSIVE d AS (SELECT DISTINCT word FROM (SELECT {_KEYWORD_LIKE} FROM documents)), {_ratios(f"SELECT word AS one, k AS two FROM d, ({_KEYS})", similarity.ANCHOR_CUTOFF)}
SELECT one AS word, two AS other, round(ratio, 9) AS ratio FROM ratios""")
def similar_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct words of all documents that are like a keyword."""
    words = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(F.upper("text"), F.lit("[A-Z]+"), F.lit(0))).alias("word"))
    keys = spark.createDataFrame([(k,) for k in extract.KEYWORDS], "other string")
    return similarity.similar_pairs(words, keys).withColumn("ratio", F.round("ratio", 9))


# --- extraction -----------------------------------------------------------


_EXACT = lambda c: f"greatest(0.6::DOUBLE * 0.98::DOUBLE + 0.4::DOUBLE * ({c})::DOUBLE, 0.9::DOUBLE)"
_FIXED = lambda c: f"greatest(0.5::DOUBLE * 0.85::DOUBLE + 0.5::DOUBLE * ({c})::DOUBLE, 0.91::DOUBLE)"
_LABEL = r"regexp_replace(regexp_replace(substr(line, instr(line, ':') + 1), '^\s+|\s+$', '', 'g'), '^$', '')"
#: Noise words cut one after the other out of a line with a tax number.
_NUMBER_ONLY = "upper(regexp_replace(line, '\\s+', '', 'g'))"
for _word in extract.GST_NOISE:
    _NUMBER_ONLY = f"replace({_NUMBER_ONLY}, '{_word}', '')"
_NUMBER_ONLY = f"regexp_replace({_NUMBER_ONLY}, '[^A-Z0-9]', '', 'g')"
_SPACED_GSTIN = r"\s*".join(["[0-9]"] * 2 + ["[A-Z]"] * 5 + ["[0-9]"] * 4 + ["[A-Z]", "[A-Z0-9]", "Z", "[A-Z0-9]"])
_DAY_FOUND = f"SELECT doc_id, page_no, regexp_extract(text, '{text.DATE}') AS value, 0.9::DOUBLE AS confidence FROM typed WHERE regexp_matches(text, '{text.DATE}')"

#: Fields of the corpus's papers by their rules.  In these papers no rule needs a similar word, and what recognition
#: made of a registration type must snap back to the type itself.
_EXTRACTED = f"""{PEOPLE}, {_LINES}, texts AS (SELECT doc_id, page_no, string_agg(text, chr(10) ORDER BY tok_idx) AS text FROM tokens GROUP BY ALL),
typed AS (SELECT doc_id, page_no, text, {_KIND.replace("upper(t)", "upper(text)")} AS document_type FROM texts),
pan_words AS (SELECT doc_id, page_no, text, upper(text) AS u, list_transform(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''), lambda x: regexp_replace(upper(x), '[^A-Z0-9]', '', 'g')) AS words FROM typed WHERE document_type = 'PAN'),
pan_found AS (SELECT doc_id, page_no, nullif(regexp_extract(u, '{ids.PAN}'), '') AS a, list_filter(list_transform(words, lambda x: {_repair('x')}), lambda x: x IS NOT NULL)[1] AS c FROM pan_words),
pan_number AS (SELECT doc_id, page_no, coalesce(a, c) AS value, CASE WHEN a IS NOT NULL THEN {_EXACT(0.9)} ELSE {_FIXED(0.8)} END AS confidence FROM pan_found),
name_at AS (SELECT doc_id, page_no, min(line_no) AS n FROM lines WHERE contains(upper(line), 'NAME') GROUP BY ALL),
pan_name AS (SELECT l.doc_id, l.page_no, l.line AS value, l.confidence FROM plain_lines l JOIN name_at n ON l.doc_id = n.doc_id AND l.page_no = n.page_no AND l.line_no = n.n + 1 WHERE l.doc_id IN (SELECT doc_id FROM typed WHERE document_type = 'PAN')),
found_label AS (SELECT l.*, CASE WHEN contains(upper(line), 'LEGAL') THEN 'legal_name' WHEN contains(upper(line), 'ADDRESS') THEN 'address' WHEN contains(upper(line), 'TYPE') THEN 'registration_type' END AS field
  FROM plain_lines l JOIN typed USING (doc_id, page_no) WHERE document_type = 'GST' AND contains(line, ':')),
label_value AS (SELECT doc_id, page_no, field, {_LABEL} AS value, greatest(confidence, 0.91::DOUBLE) AS confidence FROM found_label WHERE field IS NOT NULL),
gst_label AS (SELECT doc_id, page_no, field, CASE field WHEN 'legal_name' THEN regexp_replace(regexp_replace(translate(value, '_;', '-,'), '\\s*,\\s*', ', ', 'g'), '\\s*-\\s*', '-', 'g')
  WHEN 'registration_type' THEN (SELECT type FROM people WHERE 'doc' || k::VARCHAR = label_value.doc_id) ELSE value END AS value, confidence FROM label_value),
{_repaired("SELECT k, gstin_read AS w FROM people WHERE k % 3 = 1")},
value_token AS (SELECT t.doc_id, t.page_no, t.text AS w, t.conf, f.repaired FROM tokens t JOIN fixed f ON t.doc_id = 'doc' || f.k::VARCHAR AND t.text = f.candidate),
number_line AS (SELECT l.doc_id, l.page_no, l.confidence, {_NUMBER_ONLY} AS clean FROM plain_lines l WHERE contains(line, 'GSTIN:')),
candidates AS (SELECT doc_id, page_no, 1 AS o, repaired AS value, {_FIXED('conf')} AS confidence FROM value_token
  UNION ALL SELECT doc_id, page_no, 2, w, {_EXACT(0.8)} FROM value_token WHERE regexp_full_match(w, '{ids.GSTIN}')
  UNION ALL SELECT doc_id, page_no, 3, repaired, {_FIXED(0.75)} FROM value_token
  UNION ALL SELECT v.doc_id, v.page_no, 4, CASE WHEN regexp_full_match(clean, '{ids.GSTIN}') THEN clean ELSE repaired END, CASE WHEN regexp_full_match(clean, '{ids.GSTIN}') THEN {_EXACT('l.confidence')} ELSE {_FIXED('l.confidence')} END FROM value_token v JOIN number_line l ON v.doc_id = l.doc_id AND v.page_no = l.page_no WHERE clean = w
  UNION ALL SELECT doc_id, page_no, 5, w, {_EXACT(0.85)} FROM value_token WHERE regexp_full_match(w, '{_SPACED_GSTIN}')),
gstin AS (SELECT doc_id, page_no, first(value ORDER BY confidence + CASE WHEN {_valid('value', 'j')} THEN 0.2::DOUBLE ELSE 0::DOUBLE END DESC, o) AS value, first(confidence ORDER BY confidence + CASE WHEN {_valid('value', 'j')} THEN 0.2::DOUBLE ELSE 0::DOUBLE END DESC, o) AS confidence FROM candidates WHERE value IS NOT NULL GROUP BY ALL),
bank AS (SELECT l.doc_id, l.page_no, line, l.confidence, CASE WHEN contains(upper(line), 'HOLDER') THEN 'payee_name' WHEN contains(upper(line), 'IFSC') THEN 'ifsc_code' END AS field FROM plain_lines l JOIN typed USING (doc_id, page_no) WHERE document_type = 'CHEQUE'),
ifsc AS (SELECT doc_id, page_no, regexp_replace(regexp_replace(upper(line), '\\b(IFSC|CODE)\\b', '', 'g'), '[^A-Z0-9]', '', 'g') AS w, confidence FROM bank WHERE field = 'ifsc_code'),
ifsc_code AS (SELECT doc_id, page_no, CASE WHEN regexp_matches(w, '{ids.IFSC}') THEN regexp_extract(w, '{ids.IFSC}') ELSE {_IFSC_FIXED} END AS value, CASE WHEN regexp_matches(w, '{ids.IFSC}') THEN {_EXACT('confidence')} ELSE {_FIXED('confidence')} END AS confidence FROM ifsc),
account_number AS (SELECT doc_id, page_no, regexp_extract(text, '{text.LONG_NUMBER}') AS value, 0.91::DOUBLE AS confidence FROM typed WHERE document_type = 'CHEQUE'),
found AS (SELECT doc_id, page_no, 'pan_number' AS field, value, confidence FROM pan_number UNION ALL SELECT doc_id, page_no, 'name', value, confidence FROM pan_name
  UNION ALL SELECT doc_id, page_no, 'date_of_birth', value, confidence FROM ({_DAY_FOUND} AND document_type = 'PAN') AS d UNION ALL SELECT doc_id, page_no, 'registration_date', value, confidence FROM ({_DAY_FOUND} AND document_type = 'GST') AS d
  UNION ALL SELECT doc_id, page_no, field, value, confidence FROM gst_label UNION ALL SELECT doc_id, page_no, 'gstin', value, confidence FROM gstin
  UNION ALL SELECT doc_id, page_no, 'payee_name', {_LABEL}, confidence FROM bank WHERE field = 'payee_name' UNION ALL SELECT doc_id, page_no, 'account_number', value, confidence FROM account_number UNION ALL SELECT doc_id, page_no, 'ifsc_code', value, confidence FROM ifsc_code),
best AS (SELECT doc_id, field, first(value ORDER BY confidence DESC, page_no) AS value, max(confidence) AS confidence FROM found WHERE value IS NOT NULL GROUP BY doc_id, field)"""


@query(f"WITH {_EXTRACTED} SELECT doc_id, field, value, round(confidence, 9) AS confidence FROM best")
def extract_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract.best_fields(extract.page_fields(layout.pages(corpus.tokens(spark, sf_dir))))
    return found.select("doc_id", "field", "value", F.round("confidence", 9).alias("confidence"))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_discount DESC, l_linenumber, l_partkey) AS n FROM lineitem)
SELECT l_orderkey::VARCHAR AS doc_id, l_returnflag AS field, l_partkey::VARCHAR AS value, l_discount AS confidence FROM r WHERE n = 1""")
def best_field_across_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("doc_id"), F.col("l_returnflag").alias("field"), F.col("l_partkey").cast("string").alias("value"), F.col("l_discount").alias("confidence"), (F.col("l_linenumber") * F.lit(1 << 32) + F.col("l_partkey")).alias("page_no"))
    return extract.best_fields(rows)


@query(f"""WITH {_EXTRACTED}, docs AS (SELECT DISTINCT doc_id, document_type FROM typed), numbered AS (SELECT doc_id, field, value, confidence, row_number() OVER (PARTITION BY doc_id ORDER BY field) AS n FROM best)
SELECT doc_id, 0 AS line_no, 'Document Type: ' || document_type AS line FROM docs UNION ALL SELECT doc_id, 1, 'Status: success' FROM docs UNION ALL SELECT doc_id, 2, 'Extracted Fields:' FROM docs
UNION ALL SELECT doc_id, (2 + n)::INTEGER, printf('  %s: %s (confidence: %.2f)', field, value, confidence) FROM numbered""")
def extraction_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.result_lines(extract.results(corpus.tokens(spark, sf_dir)))


@query(f"""WITH {PEOPLE}, d AS (SELECT 'doc' || k::VARCHAR AS doc_id, CASE WHEN k % 7 = 0 OR k % 10 = 1 THEN 'UNKNOWN' WHEN k % 3 = 0 THEN 'PAN' WHEN k % 3 = 1 THEN 'GST' ELSE 'CHEQUE' END AS document_type, CASE WHEN k % 10 = 1 THEN 'failure' ELSE 'success' END AS status,
  CASE WHEN k % 10 = 1 THEN 'unreadable' END AS message, CASE WHEN k % 7 = 0 OR k % 10 = 1 THEN 0 ELSE [3, 5, 3][k % 3 + 1] END AS n_fields FROM people) SELECT * FROM d""")
def results_of_all_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some files have no page with text, and some could not be read."""
    k = F.substring("doc_id", 4, 20).cast("long")
    tokens = corpus.tokens(spark, sf_dir).withColumn("text", F.when(k % 7 != 0, F.col("text")))
    failures = corpus.people(spark, sf_dir).filter("k % 10 = 1").select(F.concat(F.lit("doc"), F.col("k").cast("string")).alias("doc_id"), F.lit("unreadable").alias("message"))
    return extract.results(tokens, failures).select("doc_id", "document_type", "status", "message", F.size("fields").alias("n_fields"))


# --- vendors --------------------------------------------------------------


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results as extraction gives them: a third of each kind, some without a name, some failed."""
    rows = corpus.people(spark, sf_dir)
    conf = lambda n: F.expr(f"CAST((k * {n}) % 50 + 50 AS DOUBLE) / CAST(100 AS DOUBLE)")
    hit = lambda c, n: F.struct(F.col(c).alias("value"), conf(n).alias("confidence"))
    entry = lambda name, c, n: F.struct(F.lit(name).alias("key"), hit(c, n).alias("value"))
    rows = rows.withColumn("pan_low", F.expr("'  ' || lower(pan)")).withColumn("given", F.expr("CASE WHEN k % 8 = 0 THEN '' ELSE name END"))
    kinds = [
        F.array(entry("pan_number", "pan_low", 7), entry("name", "given", 11), entry("date_of_birth", "date", 3)),
        F.array(entry("gstin", "gstin", 7), entry("legal_name", "given", 11), entry("address", "father", 13)),
        F.array(entry("payee_name", "given", 7), entry("account_number", "account", 11), entry("ifsc_code", "ifsc_read", 13)),
    ]
    fields = F.when(F.expr("k % 3 = 0"), kinds[0]).when(F.expr("k % 3 = 1"), kinds[1]).otherwise(kinds[2])
    kind = F.expr("CASE k % 3 WHEN 0 THEN 'PAN' WHEN 1 THEN 'GST' ELSE 'CHEQUE' END")
    failed = F.expr("k % 10 = 9")
    return rows.select(F.col("k").alias("arrival_seq"), F.col("k").cast("string").alias("doc_id"), F.when(failed, "UNKNOWN").otherwise(kind).alias("document_type"), F.when(failed, "failure").otherwise("success").alias("status"), F.when(failed, "Could not read document").alias("message"), F.map_from_entries(fields).alias("fields"))


_CONF = lambda n: f"(CAST((k * {n}) % 50 + 50 AS DOUBLE) / 100::DOUBLE)"
_VENDOR = f"""{PEOPLE}, vendors AS (SELECT k, name AS vendor_name, CASE WHEN k % 3 = 0 THEN pan END AS pan, CASE WHEN k % 3 = 1 THEN gstin END AS gstin, CASE WHEN k % 3 = 2 THEN account END AS account, CASE WHEN k % 3 = 2 THEN ifsc_read END AS ifsc,
  CASE k % 3 WHEN 0 THEN 'PAN' WHEN 1 THEN 'GST' ELSE 'CHEQUE' END AS document_type,
  round(CASE k % 3 WHEN 0 THEN ({_CONF(11)} * 1.5 + {_CONF(7)} * 2.0) / 3.5 WHEN 1 THEN ({_CONF(7)} * 2.0 + {_CONF(11)} * 1.5 + {_CONF(13)} * 0.5) / 4.0 ELSE ({_CONF(11)} + {_CONF(13)} + {_CONF(7)} * 1.5) / 3.5 END::DOUBLE, 9) AS confidence_score
  FROM people WHERE k % 10 <> 9 AND k % 8 <> 0)"""


@query(f"WITH {_VENDOR} SELECT k AS arrival_seq, vendor_name, pan, gstin, account AS bank_account, ifsc, CASE WHEN k % 3 = 2 THEN vendor_name END AS account_holder, document_type AS source_document_type, confidence_score FROM vendors")
def map_vendors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vendors.flattened(vendors.map_vendors(_results(spark, sf_dir), keep=("arrival_seq",)))
    return rows.select("arrival_seq", "vendor_name", "pan", "gstin", "bank_account", "ifsc", "account_holder", "source_document_type", F.round("confidence_score", 9).alias("confidence_score"))


_ERRORS = f"""list_filter([CASE WHEN length(trim(vendor_name)) < 2 THEN 'vendor_name is required and must be at least 2 characters' END,
  CASE WHEN pan <> '' AND NOT regexp_full_match(upper(pan), '{ids.PAN}') THEN 'Invalid PAN format: ' || pan END,
  CASE WHEN gstin <> '' AND NOT regexp_full_match(upper(gstin), '{ids.GSTIN}') THEN 'Invalid GSTIN format: ' || gstin END,
  CASE WHEN ifsc <> '' AND NOT regexp_full_match(upper(ifsc), '{ids.IFSC}') THEN 'Invalid IFSC format: ' || ifsc END], lambda x: x IS NOT NULL)"""


@query(f"WITH {ARRIVALS} SELECT arrival_seq, len({_ERRORS}) = 0 AS is_valid, array_to_string({_ERRORS}, '; ') AS errors FROM arrivals")
def validate_vendors(spark: SparkSession, sf_dir: str) -> DataFrame:
    wrong = vendors.errors()
    return corpus.arrivals(spark, sf_dir).select("arrival_seq", (F.size(wrong) == 0).alias("is_valid"), F.array_join(wrong, "; ").alias("errors"))


def _greedy(extra: str = "false") -> str:
    """Outcomes in the order of arrival, by a recursive query that carries the held keys."""
    return f"""{ARRIVALS}, e AS (SELECT *, {_ERRORS} AS errors, list_filter(['pan:' || upper(nullif(pan, '')), 'gstin:' || upper(nullif(gstin, '')), 'account:' || nullif(account, '')], lambda x: x IS NOT NULL) AS keys, row_number() OVER (ORDER BY arrival_seq) AS n FROM arrivals),
j AS (SELECT *, CASE WHEN len(errors) > 0 OR {extra} THEN 'VALIDATION_ERROR' END AS early FROM e),
r AS (SELECT 0::BIGINT AS n, []::VARCHAR[] AS held, NULL::BIGINT AS arrival_seq, NULL::VARCHAR AS outcome
  UNION ALL SELECT j.n, CASE WHEN j.early IS NULL AND NOT list_has_any(r.held, j.keys) THEN list_concat(r.held, j.keys) ELSE r.held END, j.arrival_seq,
    CASE WHEN j.early IS NOT NULL THEN j.early WHEN list_has_any(r.held, j.keys) THEN 'DUPLICATE_VENDOR' ELSE 'SUCCESS' END FROM r JOIN j ON j.n = r.n + 1),
o AS (SELECT arrival_seq, outcome FROM r WHERE n > 0)"""


_MESSAGE = f"CASE o.outcome WHEN 'SUCCESS' THEN 'Vendor ''' || vendor_name || ''' created successfully' WHEN 'DUPLICATE_VENDOR' THEN '{admission.DUPLICATE}' ELSE CASE WHEN len(errors) > 0 THEN 'Validation failed: ' || array_to_string(errors, '; ') ELSE '{admission.GSTIN_NEEDED}' END END"


_OUTCOMES = f"WITH RECURSIVE {_greedy()} SELECT arrival_seq, outcome = 'SUCCESS' AS success, outcome AS error_code, {_MESSAGE} AS message FROM o JOIN e USING (arrival_seq)"


@query(_OUTCOMES)
def admission_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admission.outcomes(corpus.arrivals(spark, sf_dir)).select("arrival_seq", "success", "error_code", "message")


@query(_OUTCOMES)
def push_to_client(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same outcomes from another system, which decides vendor by vendor, as they are sent."""
    folder = f"{shared_folder(spark)}/clients/{uuid.uuid4().hex}"
    told = clients.push(corpus.arrivals(spark, sf_dir), lambda: clients.FolderClient(f"{folder}/system"), f"{folder}/ledger")
    return told.select("arrival_seq", "success", "error_code", "message")


@query(f"WITH RECURSIVE {_greedy("coalesce(gstin, '') = ''")} SELECT arrival_seq, outcome = 'SUCCESS' AS success, outcome AS error_code, {_MESSAGE} AS message FROM o JOIN e USING (arrival_seq)")
def admission_require_gstin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admission.outcomes(corpus.arrivals(spark, sf_dir), admission.Rules(require_gstin=True)).select("arrival_seq", "success", "error_code", "message")


@query("SELECT 'CONNECTION_ERROR' AS error_code, count(*) AS vendors, false AS healthy FROM customer HAVING count(*) > 0 UNION ALL SELECT 'TIMEOUT', count(*), true FROM customer HAVING count(*) > 0")
def admission_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for rules in (admission.Rules(simulate_connection_error=True), admission.Rules(simulate_timeout=True)):
        rows = admission.outcomes(corpus.arrivals(spark, sf_dir), rules).groupBy("error_code").agg(F.count("*").alias("vendors")).withColumn("healthy", F.lit(not rules.simulate_connection_error))
        out = rows if out is None else out.unionByName(rows)
    return out


_DIGEST = "upper(sha256(arrival_seq::VARCHAR || '|' || vendor_name || '|' || coalesce(pan, '') || '|' || coalesce(gstin, '') || '|' || coalesce(account, '')))"


@query(f"WITH RECURSIVE {_greedy()} SELECT arrival_seq, 'VND-' || substr({_DIGEST}, 1, 8) AS vendor_id, vendor_name, pan, gstin, account AS bank_account, ifsc FROM o JOIN arrivals USING (arrival_seq) WHERE outcome = 'SUCCESS'")
def vendor_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admission.registered(admission.outcomes(corpus.arrivals(spark, sf_dir))).select("arrival_seq", "vendor_id", "vendor_name", "pan", "gstin", "bank_account", "ifsc")


@query("""WITH RECURSIVE j AS (SELECT c_custkey AS k, ['a' || (c_custkey // 2), 'b' || ((c_custkey + 1) // 2)] AS keys, row_number() OVER (ORDER BY c_custkey) AS n FROM customer),
r AS (SELECT 0::BIGINT AS n, []::VARCHAR[] AS held, NULL::BIGINT AS k, false AS ok
  UNION ALL SELECT j.n, CASE WHEN list_has_any(r.held, j.keys) THEN r.held ELSE list_concat(r.held, j.keys) END, j.k, NOT list_has_any(r.held, j.keys) FROM r JOIN j ON j.n = r.n + 1)
SELECT k AS arrival_seq FROM r WHERE ok""")
def admission_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chain of all customers, each of whom shares a key with the next alone; groups are kept small, so that it is followed."""
    key = lambda tag, n: F.concat(F.lit(tag), F.floor(n / 2).cast("string"))
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(k.alias("a"), k.alias("b"), F.array(key("a", k), key("b", k + 1)).alias("keys"))
    return admission.admit(rows, group=100).select(F.col("a").alias("arrival_seq"))


_LOOKUP = ("pan", "gstin", "account")


@query(f"""WITH RECURSIVE {_greedy()}, p AS ({DUCK.people()}), w AS ({" UNION ".join(f"SELECT '{c}:' || {c} AS key FROM p" for c in _LOOKUP)}),
h AS (SELECT unnest(e.keys) AS key, arrival_seq, e.vendor_name FROM o JOIN e USING (arrival_seq) WHERE outcome = 'SUCCESS')
SELECT key, arrival_seq, vendor_name FROM h JOIN w USING (key)""")
def registry_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vendors arrive in four batches, of which a merged segment and fresh ones remain; then all people's keys are looked up."""
    registry = Registry(spark, f"{shared_folder(spark)}/registries/{uuid.uuid4().hex}", fan=2, buckets=32)
    rows = corpus.arrivals(spark, sf_dir)
    last = rows.agg(F.max("arrival_seq").alias("last")).first()["last"] or 0
    for batch in range(4):
        registry.admit(rows.filter(F.col("arrival_seq").between(batch * last // 4 + 1, (batch + 1) * last // 4)), batch)
    people = corpus.people(spark, sf_dir)
    wanted = people.select(F.explode(F.array(*[F.concat(F.lit(f"{c}:"), c) for c in _LOOKUP])).alias("key"))
    return registry.lookup(wanted).select("key", "arrival_seq", "vendor_name")


@query(f"""WITH RECURSIVE {_VENDOR}, e AS (SELECT k, list_filter(['pan:' || pan, 'gstin:' || gstin, 'account:' || account], lambda x: x IS NOT NULL) AS keys, ifsc IS NULL OR regexp_full_match(ifsc, '{ids.IFSC}') AS fine FROM vendors),
j AS (SELECT *, row_number() OVER (ORDER BY k) AS n FROM e WHERE fine),
r AS (SELECT 0::BIGINT AS n, []::VARCHAR[] AS held, NULL::BIGINT AS k, false AS ok
  UNION ALL SELECT j.n, CASE WHEN list_has_any(r.held, j.keys) THEN r.held ELSE list_concat(r.held, j.keys) END, j.k, NOT list_has_any(r.held, j.keys) FROM r JOIN j ON j.n = r.n + 1)
SELECT CASE WHEN p.k % 10 = 9 THEN 'failure' ELSE 'success' END AS extraction_status, CASE WHEN p.k % 10 = 9 THEN 'UNKNOWN' ELSE CASE p.k % 3 WHEN 0 THEN 'PAN' WHEN 1 THEN 'GST' ELSE 'CHEQUE' END END AS document_type,
  CASE WHEN p.k % 10 = 9 THEN 'skipped' WHEN coalesce(r.ok, false) THEN 'success' ELSE 'failure' END AS erp_status, count(*) AS documents FROM people p LEFT JOIN r ON r.k = p.k GROUP BY ALL""")
def push_outcome_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    pushed = admission.push(_results(spark, sf_dir))
    return pushed.groupBy("extraction_status", "document_type", "erp_status").agg(F.count("*").alias("documents"))


# --- uploads --------------------------------------------------------------

#: A file for each customer: of no bytes, of another kind, or fine.
_FILE = "CAST(c_custkey % 7 AS STRING) || '/' || CASE WHEN c_custkey % 3 = 0 THEN '_' ELSE '' END || 'doc' || CAST(c_custkey AS STRING) || CASE c_custkey % 5 WHEN 0 THEN '.PNG' WHEN 1 THEN '.pdf' WHEN 2 THEN '.txt' ELSE '.jpeg' END"
_CONTENT = "CASE WHEN c_custkey % 11 = 0 THEN '' ELSE c_name END"


def _saved(folder: str):
    def save(batches):
        client = clients.FolderClient(folder)
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                client.write(name, content)
            yield batch.select([0])

    return save


@query(f"""SELECT {_FILE} AS name, CASE WHEN c_custkey % 5 = 2 THEN 'Unsupported file type: .txt' WHEN {_CONTENT} = '' THEN '{files.NO_BYTES}' END AS message,
CASE WHEN c_custkey % 5 <> 2 AND {_CONTENT} <> '' THEN {_CONTENT} END AS content FROM customer""")
def uploaded_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file of a folder is taken with its content or refused with a message."""
    folder = f"{shared_folder(spark)}/uploads/{uuid.uuid4().hex}"
    stored(corpus.customers(spark, sf_dir, "c_name").selectExpr(f"{_FILE} AS name", f"{_CONTENT} AS content").mapInArrow(_saved(folder), "name string"))
    taken, refused = files.uploads(spark, folder)
    rows = taken.select("path", F.lit(None).cast("string").alias("message"), F.col("content").cast("string").alias("content")).unionByName(refused.withColumn("content", F.lit(None).cast("string")))
    return rows.select(F.regexp_extract("path", "([0-6]/[^/]*)$", 1).alias("name"), "message", "content")


# --- evaluation -----------------------------------------------------------

#: Predictions with errors: what is wrong or missing follows from the key.
_GIVEN = {"pan_number": "CASE k % 9 WHEN 0 THEN NULL WHEN 1 THEN pan_read ELSE lower(pan) END", "name": "CASE WHEN k % 5 = 0 THEN father ELSE 'MR ' || name END", "date_of_birth": "CASE WHEN k % 7 = 0 THEN '' ELSE date END",
          "gstin": "gstin_read", "legal_name": "CASE WHEN k % 4 = 0 THEN NULL ELSE name || ' LTD' END", "address": "father", "registration_date": "replace(date, '-', '/')", "registration_type": "type_read",
          "account_number": "CASE WHEN k % 6 = 0 THEN '1' || account ELSE account END", "ifsc_code": "ifsc_read", "payee_name": "name"}
_TRUE = {"pan": "pan", "name": "name", "dob": "CASE WHEN k % 11 = 0 THEN NULL ELSE date END", "gstin": "gstin", "legal_name": "name", "address": "CASE WHEN k % 2 = 0 THEN father ELSE father || ' ' || name END", "registration_date": "date", "registration_type": "type", "account_number": "account", "ifsc": "ifsc", "account_holder": "name"}
_OF = {"pan": 0, "gst": 1, "bank": 2}


def _pairs() -> str:
    parts = [f"SELECT '{t}' AS doc_type, '{g}' AS gt_key, '{m}' AS mode, nullif(upper(trim(coalesce({_TRUE[g]}, ''))), '') AS t, nullif(upper(trim(coalesce({_GIVEN[p]}, ''))), '') AS p FROM people WHERE k % 3 = {_OF[t]}" for t, g, p, m in evaluate.FIELD_MAP]
    agree = "CASE mode WHEN 'strict' THEN t = p WHEN 'ocr' THEN translate(t, 'OILSBZG', '0115826') = translate(p, 'OILSBZG', '0115826') ELSE len(list_intersect(list_distinct(string_split(t, ' ')), string_split(p, ' ')))::DOUBLE / len(list_distinct(string_split(t, ' '))) >= 0.7 END"
    return f"""{PEOPLE}, pairs AS ({' UNION ALL '.join(parts)}), judged AS (SELECT doc_type, gt_key, t IS NOT NULL AS a, p IS NOT NULL AS b, coalesce({agree}, false) AS same FROM pairs),
counts AS (SELECT doc_type, gt_key, count(*) FILTER (a AND b AND same) AS tp, count(*) FILTER (b AND (NOT a OR NOT same)) AS fp, count(*) FILTER (a AND (NOT b OR NOT same)) AS fn FROM judged GROUP BY ALL)"""


_METRICS = f"""{_pairs()}, raw AS (SELECT *, CASE WHEN tp + fp + fn > 0 THEN tp::DOUBLE / (tp + fp + fn) ELSE 0 END AS a, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END AS r FROM counts),
metrics AS (SELECT doc_type, gt_key, round_even(a::DOUBLE, 3) AS accuracy, round_even(p::DOUBLE, 3) AS precision, round_even(r::DOUBLE, 3) AS recall, round_even(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END::DOUBLE, 3) AS f1_score, tp + fn AS support FROM raw)"""


def _counts(spark: SparkSession, sf_dir: str, kinds: tuple[str, ...] = ("pan", "gst", "bank")) -> DataFrame:
    rows = corpus.people(spark, sf_dir).withColumn("file", F.col("k").cast("string"))
    truth = predicted = None
    for kind in kinds:
        some = rows.filter(F.expr(f"k % 3 = {_OF[kind]}"))
        wide = some.select("file", *[F.expr(_TRUE[g]).alias(g) for t, g, *_ in evaluate.FIELD_MAP if t == kind])
        given = some.select("file", *[F.expr(_GIVEN[p]).alias(p) for t, _, p, _ in evaluate.FIELD_MAP if t == kind])
        mine, theirs = evaluate.unpivoted(wide, kind), given.unpivot("file", [c for c in given.columns if c != "file"], "field", "value").filter("value is not null")
        truth, predicted = (mine, theirs) if truth is None else (truth.unionByName(mine), predicted.unionByName(theirs))
    return evaluate.counts(truth, predicted)


@query(f"WITH {_pairs()} SELECT * FROM counts")
def eval_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(spark, sf_dir)


@query(f"WITH {_METRICS} SELECT * FROM metrics")
def eval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.metrics(_counts(spark, sf_dir))


@query(f"WITH {_METRICS} SELECT * FROM metrics WHERE doc_type = 'gst'")
def eval_of_one_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.metrics(_counts(spark, sf_dir, ("gst",)))


@query(f"WITH {_METRICS} SELECT count(*) FILTER (accuracy >= 0.9) AS passing_fields, count(*) AS total_fields, count(*) FILTER (accuracy >= 0.9)::DOUBLE / count(*) AS pass_rate, CASE WHEN count(*) FILTER (accuracy >= 0.9)::DOUBLE / count(*) >= 0.8 THEN 'PASSED' ELSE 'NEEDS IMPROVEMENT' END AS verdict FROM metrics")
def eval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.summary(evaluate.metrics(_counts(spark, sf_dir)))


@query(f"WITH {_METRICS} SELECT doc_type, gt_key, CASE WHEN accuracy >= 0.9 THEN '✓' WHEN accuracy >= 0.7 THEN '~' ELSE '✗' END AS mark FROM metrics")
def eval_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.metrics(_counts(spark, sf_dir)).select("doc_type", "gt_key", evaluate.grade(F.col("accuracy")).alias("mark"))


@query()
def eval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.metric_lines(evaluate.metrics(_counts(spark, sf_dir)))
