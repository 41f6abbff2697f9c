"""Removal of lines that are spread over many sites.

Each line's hash gets a HyperLogLog sketch of the sites that hold it; sketches merge by aggregation, so a line that stands everywhere
costs one sketch per task. Estimates clearly over or under the threshold decide; lines near it are counted
exactly. A spread line stays where it stands first, by document id, and goes everywhere else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isohypsa.llm.common import SPACES
from isohypsa.staging import stage

#: A line goes if it stands on at least SITES sites; lines under MIN_CHARS characters, trimmed, are never touched.
SITES, MIN_CHARS = 5, 20
#: Registers of a sketch (as a power of two), and the share of the threshold (2 sites at least) within which lines are counted exactly.
LOG_K, NEAR = 11, 0.15
DOC = ("l_doc", "l_text1", "l_text2")
LINE = ("l_hash1", "l_hash2")


def key() -> list[Column]:
    """The key of a row: its id and 128 bits of its text. Rows alike in both have the same lines and share a fate."""
    return [F.col("doc_id").cast("string").alias("l_doc"), F.xxhash64("text").alias("l_text1"), F.xxhash64(F.lit("text"), "text").alias("l_text2")]


def lines(docs: DataFrame) -> DataFrame:
    """The long enough lines of every text: row key, id, site, number of the line and 128 bits of its trimmed content."""
    each = docs.select(*key(), "doc_id", F.coalesce("source", F.lit("")).alias("l_site"), F.posexplode(F.split("text", "\n")).alias("l_no", "l_line"))
    each = each.withColumn("l_line", F.btrim("l_line", F.lit(SPACES))).filter(F.char_length("l_line") >= MIN_CHARS)
    return each.select(*DOC, "doc_id", "l_site", "l_no", F.xxhash64("l_line").alias("l_hash1"), F.xxhash64(F.lit("line"), "l_line").alias("l_hash2"))


def spread(each: DataFrame, sites: int = SITES) -> DataFrame:
    """Lines on at least ``sites`` sites: their hash and first place (row key and number). A null site is a site."""
    first = F.min(F.struct(F.col("doc_id"), F.col("l_text1"), F.col("l_text2"), F.col("l_no"), F.col("l_doc")))
    sketched = each.groupBy(*LINE).agg(F.hll_sketch_estimate(F.hll_sketch_agg(F.xxhash64("l_site"), F.lit(LOG_K))).alias("about"), first.alias("first"))
    margin = max(2, round(NEAR * sites))
    sketched = stage(sketched.filter(F.col("about") >= sites - margin), "line-sketches")
    sure = sketched.filter(F.col("about") > sites + margin)
    near = sketched.filter(F.col("about") <= sites + margin)
    counted = each.select(*LINE, "l_site").distinct().join(near.select(*LINE), [*LINE], "left_semi").groupBy(*LINE).agg(F.count("*").alias("n")).filter(F.col("n") >= sites)
    return sure.unionByName(near.join(counted, [*LINE], "left_semi")).select(*LINE, "first")


def remove_spread_lines(docs: DataFrame, sites: int = SITES) -> DataFrame:
    """docs with text without its spread lines, and with l_lines (number of lines), l_removed (how many went) and l_emptied (a text of which
    nothing but white space is left because of that).

    Null texts stay null and have no lines; an empty text is one empty line. Other columns stay as they are. Copies of a text on
    many sites keep it once, whole, with the smallest id."""
    each = lines(docs)
    spread_lines = stage(spread(each, sites), "line-spread")
    hit = each.join(spread_lines, [*LINE])
    hit = hit.filter(~(F.col("l_doc").eqNullSafe(F.col("first.l_doc")) & (F.col("l_text1") == F.col("first.l_text1")) & (F.col("l_text2") == F.col("first.l_text2")) & (F.col("l_no") == F.col("first.l_no"))))
    drop = hit.groupBy(*[F.col(c).alias(f"d{c}") for c in DOC]).agg(F.collect_set("l_no").alias("l_drop"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), *key(), F.split("text", "\n").alias("l_all"))
    joined = rows.join(drop, rows["l_doc"].eqNullSafe(drop["dl_doc"]) & (rows["l_text1"] == drop["dl_text1"]) & (rows["l_text2"] == drop["dl_text2"]), "left")
    left = F.filter("l_all", lambda x, i: ~F.array_contains("l_drop", i))
    gone = F.coalesce(F.size("l_drop"), F.lit(0)).cast("long")
    out = joined.select("row", F.when(F.col("l_drop").isNull(), F.col("row.text")).otherwise(F.array_join(left, "\n")).alias("l_new"),
                        F.coalesce(F.size("l_all"), F.lit(0)).cast("long").alias("l_lines"), gone.alias("l_removed"))
    emptied = (F.col("l_removed") > 0) & (F.btrim("l_new", F.lit(SPACES)) == "")
    return out.select(*[F.col("l_new").alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns], "l_lines", "l_removed", emptied.alias("l_emptied"))
