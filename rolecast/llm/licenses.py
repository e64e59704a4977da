"""Licence scans by canonical digests, with DataFrame functions only.

A text is reduced to what matters for matching: lower case, words only, equivalent spellings made one,
statements of copyright dropped, white space and line breaks made single blanks. Its digest joins the digests of known
licence texts, reduced by the same expression: a hash join of entire texts, no search within them. Single
lines are looked up likewise among one-line notices, whose list is fixed and small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .license_texts import DIGESTS, NOTICES, TEXTS, UNLICENSE

#: Fixed values: (spelling, what it counts as), on lower-case text, in this order.
SPELLINGS = [("licence", "license"), ("sub-license", "sublicense"), ("non-infringement", "noninfringement"), ("organisation", "organization"), ("acknowledgement", "acknowledgment"), ("favour", "favor"), ("http://", "https://"), ("&", " and ")]
#: Characters that are not part of words, line ends aside.
NO_WORD = r"[^a-z0-9\n\x{80}-\x{10FFFF}]+"
#: Canonical lines that only say whose the text is, as the SQL has them; a hard wrap can give lines of a body such beginnings.
COPYRIGHT = r"^(copyright|©|c [0-9]{4}|all rights reserved)"
#: Words that follow 'copyright' in the body of a licence, not in a statement of whose it is.
FOLLOWERS = "act also and any are as assignment at claims? dates? disclaimers? doctrines? except exists? for from grants? has holders? if in infringement information interests? is it laws? licen[cs](?:e|es|ed|ing|ors?) like lines? may means must names? notices? of office on or other owners? ownership patents? permissions? protections? registration resulting rights? shall similar so statements? status subsists? such terms? that those to treaty treaties under was which will with without works?"
_FOLLOWER = rf"(?!(?:{FOLLOWERS.replace(' ', '|')}|the (?:library|program|software|work))(?: |$))"
#: Canonical lines that are such a statement: copyright with (c) or a year, or with a holder's name in a short line.
STATEMENT = rf"^(?:©|c [0-9]{{4}}|copyrights?(?: c(?: |$)| ?©| [0-9]{{4}})|copyrights? {_FOLLOWER}(?:\S+(?: \S+){{0,7}}$|.*\b[0-9]{{4}}\b)|all rights reserved$)"
BROADCAST_ROWS = 100_000


def canonical_lines(text: Column) -> Column:
    """The lines of a text in canonical form, without empty ones."""
    c = F.lower(F.coalesce(text, F.lit("")))
    for a, b in SPELLINGS:
        c = F.replace(c, F.lit(a), F.lit(b))
    lines = F.transform(F.split(F.regexp_replace(c, NO_WORD, " "), "\n"), lambda x: F.trim(x))
    return F.filter(lines, lambda x: x != "")


def canonical_text(lines: Column) -> Column:
    return F.array_join(F.filter(lines, lambda x: ~x.rlike(STATEMENT)), " ")


def digest(canonical: Column) -> Column:
    """sha256 of a canonical text; null if nothing is left of it."""
    return F.when(canonical != "", F.sha2(canonical, 256))


def known_licenses(spark: SparkSession, extra: DataFrame | None = None) -> DataFrame:
    """(digest, license_id) of the known texts and those of ``extra(license_id, text)``; the first id of equals."""
    rows = spark.createDataFrame([*TEXTS, *UNLICENSE], "license_id string, text string")
    if extra is not None:
        rows = rows.unionByName(extra.select("license_id", "text"))
    digests = rows.select(digest(canonical_text(canonical_lines(F.col("text")))).alias("digest"), "license_id")
    return digests.unionByName(spark.createDataFrame(DIGESTS, "license_id string, digest string")).filter("digest is not null").groupBy("digest").agg(F.min("license_id").alias("license_id"))


def notice_names(spark: SparkSession) -> dict[str, str]:
    """Licence by digest of a canonical notice line; the list is fixed."""
    rows = spark.createDataFrame(NOTICES, "license_id string, text string").select("license_id", F.sha2(F.element_at(canonical_lines(F.col("text")), 1), 256).alias("digest"))
    return {r["digest"]: r["license_id"] for r in rows.collect()}


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", extra: DataFrame | None = None) -> DataFrame:
    """id, canonical_sha256, license_id, n_notices, notices: one row for each row of docs.

    license_id is the licence whose entire text the document is, else null; notices are the licences that
    single lines grant by name, each once, sorted and comma-joined, '' if none; n_notices counts such lines.
    A null, empty or wordless text, or one of copyright lines only, has a null digest. Repeated rows are scanned
    alike; columns besides the named ones are never read; empty tables give no rows.
    """
    spark = docs.sparkSession
    known = known_licenses(spark, extra)
    if known.count() <= BROADCAST_ROWS:
        known = F.broadcast(known)
    lines = docs.select(F.col(id_col).alias("id"), canonical_lines(F.col(text_col).cast("string")).alias("lines"))
    names = F.create_map(*[F.lit(x) for kv in sorted(notice_names(spark).items()) for x in kv])
    hits = F.filter(F.transform("lines", lambda x: F.try_element_at(names, F.sha2(x, 256))), lambda x: x.isNotNull())
    rows = lines.select("id", digest(canonical_text(F.col("lines"))).alias("digest"), hits.alias("hits"))
    return rows.join(known, "digest", "left").select(
        F.col("id").alias(id_col), F.col("digest").alias("canonical_sha256"), "license_id", F.size("hits").cast("long").alias("n_notices"), F.array_join(F.array_sort(F.array_distinct("hits")), ",").alias("notices")
    )
