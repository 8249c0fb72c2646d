"""A deterministic corpus of tax and bank papers, derived from the driver's tables.

The SQL is the same for Spark and DuckDB but for integer division, so that a
query and its twin start from the same rows.  Nothing is random: identifiers,
names and reading errors follow from the customer's key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vetloom.schemas import TOKENS
from vetloom.session import checkpointed

LETTERS, BASE36 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FIRST, LAST = ["RAVI", "PRIYA", "ARJUN", "MEERA", "KABIR", "ANITA", "VIKRAM"], ["SHARMA", "IYER", "KHAN", "DAS", "MEHTA", "REDDY", "BOSE", "NAIR", "GILL", "PATEL", "JAIN"]
TYPES = ["Regular", "Composition", "Casual Taxable Person", "SEZ Unit", "SEZ Developer", "Input Service Distributor"]
BANKS = ["HDFC", "ICIC", "SBIN", "UTIB", "PUNB"]
#: Customers that a task makes papers of, at most about.
TASK_CUSTOMERS = 8192

#: Where a kind of paper (0 PAN, 1 GST, 2 bank) has which token: kind, number, x, y, text.
LAYOUT = [
    (0, 0, 140, 28, "INCOME TAX DEPARTMENT"),
    (0, 1, 210, 50, "GOVT. OF INDIA"),
    (0, 2, 140, 80, "Permanent Account Number"),
    (0, 3, 140, 110, "{pan}"),
    (0, 4, 30, 195, "Name"),
    (0, 5, 30, 215, "{name}"),
    (0, 6, 30, 245, "Father's Name"),
    (0, 7, 30, 265, "{father}"),
    (0, 8, 30, 295, "Date of Birth"),
    (0, 9, 30, 315, "{date}"),
    (1, 0, 180, 50, "GST REGISTRATION CERTIFICATE"),
    (1, 1, 50, 150, "Legal Name: {name} , TRADING_CO"),
    (1, 2, 50, 200, "GSTIN:"),
    (1, 3, 130, 204, "{gstin}"),
    (1, 4, 50, 250, "Address: {k}, {father} ROAD"),
    (1, 5, 50, 340, "Registration Date: {date}"),
    (1, 6, 50, 390, "Registration Type: {type}"),
    (2, 0, 300, 40, "{bank} BANK"),
    (2, 1, 350, 80, "CANCELLED CHEQUE"),
    (2, 2, 60, 160, "Account Holder Name: {name}"),
    (2, 3, 60, 210, "Account Number: {account}"),
    (2, 4, 60, 260, "IFSC Code: {ifsc}"),
    (2, 5, 60, 310, "Branch: {father}"),
]


class Sql:
    """The corpus in one dialect."""

    def __init__(self, spark: bool) -> None:
        self.spark = spark

    def div(self, a: str, b: int | str) -> str:
        return f"(({a}) div {b})" if self.spark else f"(({a}) // {b})"

    def at(self, text: str, n: str) -> str:
        return f"substr('{text}', CAST(({n}) AS INT) + 1, 1)"

    def pick(self, items: list[str], n: str) -> str:
        """The item of that number, from one padded string."""
        size = max(map(len, items))
        return f"trim(substr('{''.join(x.ljust(size) for x in items)}', CAST((({n}) % {len(items)}) * {size} AS INT) + 1, {size}))"

    def pan(self, k: str) -> str:
        letter = lambda n: self.at(LETTERS, f"({n}) % 26")
        return f"({letter(k)} || {letter(self.div(k, 26))} || {letter(f'({k}) * 7')} || 'P' || {letter(f'({k}) * 11 + 3')} || lpad(CAST((({k}) * 7919) % 10000 AS STRING), 4, '0') || {letter(f'({k}) * 5')})"

    def body(self, k: str) -> str:
        """The first 14 characters of a tax number."""
        return f"(lpad(CAST(1 + ({k}) % 37 AS STRING), 2, '0') || {self.pan(k)} || {self.at(BASE36[1:], f'({k}) % 35')} || 'Z')"

    def check(self, body: str) -> str:
        if self.spark:  # one expression: written out, it would be too long to compile
            products = f"transform(sequence(1, 14), i -> (instr('{BASE36}', substr({body}, i, 1)) - 1) * (2 - i % 2))"
            return self.at(BASE36, f"(36 - aggregate({products}, 0L, (a, p) -> a + p div 36 + p % 36) % 36) % 36")
        parts = [f"((instr('{BASE36}', substr({body}, {i}, 1)) - 1) * {2 - i % 2})" for i in range(1, 15)]
        total = " + ".join(f"{self.div(p, 36)} + {p} % 36" for p in parts)
        return self.at(BASE36, f"(36 - ({total}) % 36) % 36")

    def ifsc(self, k: str) -> str:
        return f"({self.pick(BANKS, k)} || '0' || lpad(CAST((({k}) * 104729) % 1000000 AS STRING), 6, '0'))"

    def account(self, k: str) -> str:
        return f"CAST(100000000000 + (({k}) * 7368787) % 899999999999 AS STRING)"

    def date(self, k: str) -> str:
        two = lambda n: f"lpad(CAST({n} AS STRING), 2, '0')"
        return f"({two(f'1 + ({k}) % 28')} || CASE WHEN ({k}) % 2 = 0 THEN '/' ELSE '-' END || {two(f'1 + ({k}) % 12')} || '/' || CAST(1960 + ({k}) % 60 AS STRING))"

    def people(self) -> str:
        """k, name, father, pan, gstin, ifsc, account, date, type; and *_read, as recognition reads them."""
        k = "c_custkey"
        first = f"SELECT {k} AS k, {self.body(k)} AS body, {self.pan(k)} AS pan, {self.ifsc(k)} AS ifsc, {self.account(k)} AS account, {self.date(k)} AS date, {self.pick(TYPES, k)} AS type, {self.pick(BANKS, k)} AS bank, {self.pick(FIRST, k)} || ' ' || {self.pick(LAST, k)} AS name, {self.pick(LAST, f'{k} * 3 + 1')} AS father FROM customer"
        whole = f"SELECT *, body || {self.check('body')} AS gstin FROM ({first}) AS a"
        read = lambda c, digits: f"CASE k % 4 WHEN 1 THEN {self.around(c, digits, '01', 'OI')} WHEN 2 THEN {self.around(c, digits, '58', 'SB')} ELSE {c} END"
        return f"SELECT *, {read('pan', (6, 4))} AS pan_read, {read('gstin', (8, 4))} AS gstin_read, CASE WHEN k % 4 = 3 THEN substr(ifsc, 1, 4) || 'O' || substr(ifsc, 6, 6) ELSE ifsc END AS ifsc_read, CASE WHEN k % 4 = 0 THEN replace(type, 'i', 'l') ELSE type END AS type_read FROM ({whole}) AS b"

    def around(self, column: str, part: tuple[int, int], old: str, new: str) -> str:
        """The column with a part of it translated."""
        a, n = part
        return f"(substr({column}, 1, {a - 1}) || translate(substr({column}, {a}, {n}), '{old}', '{new}') || substr({column}, {a + n}, 20))"

    def tokens(self) -> str:
        """doc_id, page_no, tok_idx, x, y, text, conf.  Every fifth paper has a second page with the same tokens."""
        rows = ", ".join("({}, {}, {}, {}, '{}')".format(*r[:4], r[4].replace("'", "''")) if not self.spark else "({}, {}, {}, {}, '{}')".format(*r[:4], r[4].replace("'", "\\'")) for r in LAYOUT)
        text = "template"
        for name, column in (("pan", "pan_read"), ("name", "name"), ("father", "father"), ("date", "date"), ("gstin", "gstin_read"), ("k", "CAST(k AS STRING)"), ("type", "type_read"), ("bank", "bank"), ("account", "account"), ("ifsc", "ifsc_read")):
            text = f"replace({text}, '{{{name}}}', {column})"
        conf = "CAST(50 + (k * 17 + tok_idx * 29 + page_no * 13) % 50 AS DOUBLE) / CAST(100 AS DOUBLE)"
        return f"SELECT 'doc' || CAST(k AS STRING) AS doc_id, page_no, tok_idx, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, {text} AS text, {conf} AS conf FROM ({self.people()}) AS p JOIN (VALUES {rows}) AS l(kind, tok_idx, x, y, template) ON kind = k % 3 JOIN (VALUES (1), (2)) AS g(page_no) ON page_no = 1 OR k % 5 = 0"

    def arrivals(self) -> str:
        """Vendors in order: some share keys with earlier ones, some are invalid, some lack keys."""
        k = "c_custkey"
        one = lambda n, d: f"CASE WHEN {k} % {n} = 0 THEN {self.div(k, d)} ELSE {k} END"
        keys = f"SELECT {k} AS k, {one(6, 3)} AS kp, {one(7, 2)} AS kg, {one(11, 5)} AS ka FROM customer"
        body = f"SELECT *, {self.body('kg')} AS body FROM ({keys}) AS a"
        return (
            f"SELECT k AS arrival_seq, CASE WHEN k % 17 = 0 THEN ' X ' ELSE 'Vendor ' || CAST(k AS STRING) END AS vendor_name, "
            f"CASE WHEN k % 13 = 0 THEN 'INVALID123' WHEN k % 5 = 1 THEN NULL ELSE {self.pan('kp')} END AS pan, "
            f"CASE WHEN k % 19 = 0 THEN '27abcde1234f1z5' WHEN k % 5 = 2 THEN '' ELSE body || {self.check('body')} END AS gstin, "
            f"CASE WHEN k % 5 = 3 THEN NULL ELSE {self.account('ka')} END AS account, CASE WHEN k % 23 = 0 THEN 'BAD' ELSE {self.ifsc('k')} END AS ifsc FROM ({body}) AS b"
        )


SPARK, DUCK = Sql(True), Sql(False)


def customers(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """The customers' keys (and other columns), dealt out by the id of their paper.

    A customer is a few bytes of a file, of which one task may read all, and
    becomes up to two pages of text.  Dealt out here, it is an id that moves, and
    what is grouped by document or page later lies together already.  The
    checkpoint keeps that place, and keeps filters on what is derived from being
    pushed below the exchange, where few tasks would derive it.
    """
    keys = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", *more)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism, -(-keys.count() // TASK_CUSTOMERS))
    return checkpointed(keys.repartition(tasks, F.expr("'doc' || CAST(c_custkey AS STRING)")))


def _run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(sql.replace("{", "{{").replace("}", "}}").replace("FROM customer", "FROM {customer}"), customer=customers(spark, sf_dir))


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, SPARK.people())


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The arrivals as vendors."""
    rows = _run(spark, sf_dir, SPARK.arrivals())
    bank = F.struct(F.col("account").alias("account_number"), F.col("ifsc").alias("ifsc_code"), F.lit(None).cast("string").alias("account_holder"))
    return rows.select("arrival_seq", "vendor_name", "pan", "gstin", bank.alias("bank_details"), F.lit(None).cast("string").alias("address"), F.lit("GST").alias("source_document_type"), F.lit(None).cast("timestamp").alias("extraction_timestamp"), F.lit(1.0).alias("confidence_score"))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus as a recogniser would give it: each token has a box of 8 by 12 for each character."""
    # never null, and so told: of a filter for texts the optimizer would make one for all that they are derived from
    rows = _run(spark, sf_dir, SPARK.tokens()).withColumn("text", F.coalesce("text", F.lit("")))
    wide = F.col("x") + 8.0 * F.length("text")
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    low = F.col("y") + 12.0
    box = F.array(corner(F.col("x"), F.col("y")), corner(wide, F.col("y")), corner(wide, low), corner(F.col("x"), low))
    return rows.withColumn("box", box).select(*[F.col(f.name).cast(f.dataType) for f in TOKENS])
