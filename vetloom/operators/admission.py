"""Admission of vendors to the registry, in the order of their arrival.

A vendor is a duplicate if an *admitted* one holds its PAN, its GSTIN or its
account number; a vendor that was refused holds nothing.  So the outcome
depends on the order.  It is found in rounds over (vendor, key) rows:

* a vendor that comes first for all of its keys is admitted;
* whoever shares a key with an admitted one is a duplicate.

Each round is a few equi-joins and settles at least the first vendor of every
group of vendors that share keys, and all others of a key that many share.
What :data:`ROUNDS` of them leave are mostly short chains: groups are then
found as components of shared keys, and each group of at most :data:`GROUP`
vendors is judged in one pass, group beside group.  Larger groups take more
rounds, which also follow chains: a vendor with a single earlier one among those
that share a key with it is admitted if that one is not, so the place in a chain
decides, and places are found by steps that double.  A chain of any length is
settled in one round of logarithmically many joins.

Contract: vendors with the same ``arrival_seq`` come in any one order.  Null or
empty keys never collide.  An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vetloom.functions.text import filled
from vetloom.session import checkpointed

from . import graph, vendors

ROUNDS, GROUP = 2, 10_000
#: Texts of outcomes (fixed values).
NO_CONNECTION, TIMED_OUT = "Unable to connect to ERP system", "ERP request timed out after 30 seconds"
GSTIN_NEEDED, DUPLICATE = "GSTIN is required for vendor creation", "Vendor with same PAN/GSTIN/Bank Account already exists"


@dataclass(frozen=True)
class Rules:
    """What the registry asks for, and faults to act out."""

    require_gstin: bool = False
    simulate_connection_error: bool = False
    simulate_timeout: bool = False


def health(spark, rules: Rules = Rules()) -> DataFrame:
    """One row: whether the registry can be reached."""
    return spark.range(1).select(F.lit(not rules.simulate_connection_error).alias("healthy"))


def keys() -> Column:
    """The keys that a vendor would hold."""
    tagged = [F.concat(F.lit(tag), filled(text)) for tag, text in (("pan:", F.upper("pan")), ("gstin:", F.upper("gstin")), ("account:", F.col("bank_details.account_number")))]
    return F.filter(F.array(*tagged), lambda x: x.isNotNull())


def _greedy(open_: pd.DataFrame) -> pd.DataFrame:
    held: set[str] = set()
    admitted = []
    rows = open_.sort_values(["a", "b"])
    for a, b, keys_ in zip(rows["a"], rows["b"], rows["keys"], strict=True):
        if held.isdisjoint(keys_):
            held.update(keys_)
            admitted.append((a, b))
    return pd.DataFrame(admitted, columns=["a", "b"])


def firsts(open_: DataFrame) -> DataFrame:
    """Those (a, b) that come first for all of their keys."""
    keyed = open_.select(F.struct("a", "b").alias("o"), F.explode("keys").alias("key"))
    first = keyed.groupBy("key").agg(F.min("o").alias("first"))
    return keyed.join(first, "key").groupBy("o").agg(F.bool_and(F.col("o") == F.col("first")).alias("all")).filter("all").select("o.*")


def _round(open_: DataFrame, chains: bool = False) -> tuple[DataFrame, DataFrame]:
    """Those admitted in one round, with those along chains if asked for, and those that are still open."""
    keyed = open_.select(F.struct("a", "b").alias("o"), F.explode("keys").alias("key"))
    wins = checkpointed(firsts(open_).select(F.struct("a", "b").alias("o")))
    if chains:
        along = _chains(open_).join(wins.withColumnRenamed("o", "root"), "root", "left_semi").filter("not odd").select("o")
        wins = checkpointed(wins.unionByName(along))
    taken = keyed.join(wins, "o", "left_semi").select("key").distinct()
    settled = keyed.join(taken, "key", "left_semi").select("o.*").distinct()
    return wins.select("o.*"), checkpointed(open_.join(settled, ["a", "b"], "left_anti"))


def _chains(open_: DataFrame) -> DataFrame:
    """(o, root, odd) of each vendor with a single earlier one among those that share a key with it.

    It is admitted if that one is not, so along a chain of such vendors the
    place decides.  ``root`` is the vendor at the chain's head, and ``odd``
    whether an odd number of steps leads there; steps double in each round.
    """
    keyed = open_.select(F.struct("a", "b").alias("o"), F.explode("keys").alias("key"))
    first = keyed.groupBy("key").agg(F.min("o").alias("first"))
    later = checkpointed(keyed.join(first, "key").filter(F.col("o") != F.col("first")))
    second = later.groupBy("key").agg(F.min("o").alias("second"))
    before = later.join(second, "key").groupBy("o").agg(F.bool_and(F.col("o") == F.col("second")).alias("near"), F.min("first").alias("root"), F.max("first").alias("other"))
    links = checkpointed(before.filter(F.col("near") & (F.col("root") == F.col("other"))).select("o", "root", F.lit(True).alias("odd")))
    while True:
        on = links.select(F.col("o").alias("root"), F.col("root").alias("_root"), F.col("odd").alias("_odd"))
        moved = checkpointed(links.join(on, "root", "left").select("o", F.coalesce("_root", "root").alias("root"), F.when(F.col("_odd"), ~F.col("odd")).otherwise(F.col("odd")).alias("odd"), F.col("_root").isNotNull().alias("_moved")))
        links = moved.drop("_moved")
        if moved.filter("_moved").isEmpty():
            return links


def grouped(open_: DataFrame) -> DataFrame:
    """Adds ``root``: the first vendor that shared keys lead to."""
    keyed = open_.select(F.struct("a", "b").alias("u"), F.explode("keys").alias("key"))
    links = keyed.join(keyed.groupBy("key").agg(F.min("u").alias("v")), "key").select("u", "v")
    roots = graph.components(links).withColumnRenamed("node", "u")
    return open_.withColumn("u", F.struct("a", "b")).join(roots, "u", "left").select("a", "b", "keys", F.coalesce("root", "u").alias("root"))


def admit(candidates: DataFrame, held: DataFrame | None = None, rounds: int = ROUNDS, group: int = GROUP) -> DataFrame:
    """Of candidates (a, b, keys), in the order of (a, b), those admitted.  ``held`` has the column ``key``."""
    order = ["a", "b"]
    if held is not None:
        blocked = candidates.select(*order, F.explode("keys").alias("key")).join(held.select("key").distinct(), "key", "left_semi").select(*order).distinct()
        candidates = candidates.join(blocked, order, "left_anti")
    done = candidates.filter(F.size("keys") == 0).select(*order)
    open_ = checkpointed(candidates.filter(F.size("keys") > 0))
    made = 0
    while not open_.isEmpty():
        if made >= rounds:
            if open_.count() > group:  # only then can a group be too large
                won, open_ = _round(open_, chains=True)
                done = done.unionByName(won)
            rooted = checkpointed(grouped(open_))
            sized = rooted.groupBy("root").agg(F.count("*").alias("n"))
            small = rooted.join(sized.filter(F.col("n") <= group), "root", "left_semi")
            # components share no key, so that many can be judged in one call
            dealt = small.withColumn("_deal", F.pmod(F.xxhash64("root"), F.lit(max(1, -(-rooted.count() // max(1, group))))))
            done = done.unionByName(checkpointed(dealt.groupBy("_deal").applyInPandas(_greedy, "a long, b long")))
            open_ = checkpointed(rooted.join(sized.filter(F.col("n") > group), "root", "left_semi").select("a", "b", "keys"))
        else:
            won, open_ = _round(open_)
            done = done.unionByName(won)
        made += 1
    return done


def digest() -> Column:
    """What a vendor's ids are made of: 64 hexadecimal digits."""
    return F.upper(F.sha2(F.concat_ws("|", F.col("arrival_seq").cast("string"), *[F.coalesce(c, F.lit("")) for c in ("vendor_name", "pan", "gstin", "bank_details.account_number")]), 256))


def outcomes(arrivals: DataFrame, rules: Rules = Rules(), registry: DataFrame | None = None, held: DataFrame | None = None) -> DataFrame:
    """The vendors with ``success``, ``error_code``, ``message``, ``vendor_id`` and ``erp_reference``.

    Keys are held by the vendors of a ``registry``, or given as ``held`` (column ``key``).
    """
    rows = checkpointed(arrivals.withColumn("_row", F.monotonically_increasing_id()))
    wrong = vendors.errors()
    early = (
        F.when(F.lit(rules.simulate_connection_error), F.struct(F.lit("CONNECTION_ERROR").alias("code"), F.lit(NO_CONNECTION).alias("text")))
        .when(F.lit(rules.simulate_timeout), F.struct(F.lit("TIMEOUT").alias("code"), F.lit(TIMED_OUT).alias("text")))
        .when(F.size(wrong) > 0, F.struct(F.lit("VALIDATION_ERROR").alias("code"), F.concat(F.lit("Validation failed: "), F.array_join(wrong, "; ")).alias("text")))
        .when(F.lit(rules.require_gstin) & filled(F.col("gstin")).isNull(), F.struct(F.lit("VALIDATION_ERROR").alias("code"), F.lit(GSTIN_NEEDED).alias("text")))
    )
    judged = rows.withColumn("_early", early)
    candidates = judged.filter("_early is null").select(F.col("arrival_seq").alias("a"), F.col("_row").alias("b"), keys().alias("keys"))
    if registry is not None:
        held = registry.select(F.struct(F.col("bank_account").alias("account_number")).alias("bank_details"), "pan", "gstin").select(F.explode(keys()).alias("key"))
    won = admit(candidates, held).select(F.col("b").alias("_row"), F.lit(True).alias("_won"))
    done = judged.join(won, "_row", "left")
    success = F.coalesce("_won", F.lit(False))
    return done.select(
        *arrivals.columns,
        success.alias("success"),
        F.when(success, "SUCCESS").otherwise(F.coalesce("_early.code", F.lit("DUPLICATE_VENDOR"))).alias("error_code"),
        F.when(success, F.concat(F.lit("Vendor '"), "vendor_name", F.lit("' created successfully"))).otherwise(F.coalesce("_early.text", F.lit(DUPLICATE))).alias("message"),
        F.when(success, F.concat(F.lit("VND-"), F.substring(digest(), 1, 8))).alias("vendor_id"),
        F.when(success, F.concat(F.lit("TXN-"), F.date_format(F.current_timestamp(), "yyyyMMddHHmmss"), F.lit("-"), F.substring(digest(), 9, 4))).alias("erp_reference"),
    )


def registered(outcomes_: DataFrame) -> DataFrame:
    """The registry's rows of admitted vendors, in the order of arrival."""
    flat = vendors.flattened(outcomes_.filter("success").drop("success", "error_code", "message"))
    return flat.withColumn("created_at", F.current_timestamp())


def push(results: DataFrame, rules: Rules = Rules(), registry: DataFrame | None = None) -> DataFrame:
    """For each extraction result (with ``arrival_seq``): extraction_status, document_type, erp_status, vendor_id, erp_reference, message."""
    results = checkpointed(results)
    mapped = checkpointed(vendors.map_vendors(results, keep=("doc_id", "arrival_seq")).withColumn("_errors", vendors.errors()))
    tried = outcomes(mapped.filter("size(_errors) = 0").drop("_errors"), rules, registry).select("doc_id", "success", "error_code", F.col("message").alias("_told"), "vendor_id", "erp_reference")
    rows = results.join(mapped.select("doc_id", "_errors"), "doc_id", "left").join(tried, "doc_id", "left")
    ok = F.col("status") == "success"
    status = F.when(~ok, "skipped").when(F.coalesce("success", F.lit(False)), "success").otherwise("failure")
    text = (
        F.when(~ok, F.coalesce("message", F.lit("Extraction failed")))
        .when(F.col("_errors").isNull(), "Could not map extraction to vendor (missing required fields like name)")
        .when(F.size("_errors") > 0, F.concat(F.lit("Vendor validation failed: "), F.array_join("_errors", "; ")))
        .when(F.col("success"), F.col("_told"))
        .otherwise(F.concat(F.lit("ERP Error ("), "error_code", F.lit("): "), "_told"))
    )
    return rows.select("doc_id", F.when(ok, "success").otherwise("failure").alias("extraction_status"), "document_type", status.alias("erp_status"), "vendor_id", "erp_reference", text.alias("message"))
