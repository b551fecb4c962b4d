"""Licence scan: whole texts looked up among the digests of known licences.

The canonical form of a text: A-Z to a-z; paragraphs that are copyright notices go, while
sentences that only speak of copyright stay; runs of anything but letters and digits, line
breaks included, become one space, so wrapping does not matter; equivalent spellings become
one. A text is a licence when the sha256 of its canonical form is a known digest. Beside
whole licences the table knows some one-line notices, which are named so (`...-notice`).
The known texts lie in the folder `licences` beside this file; `digests.tsv` there
holds their digests, which `licence_digests` makes from them.

Cases: null or empty text (and one of punctuation alone) has the digest of '' and no
licence; repeated rows give equal rows; two names of one digest: the lesser name counts;
no rows give no rows. Only `doc_id` and `text` are read.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stillwater.llm.common import ascii_lower

#: Spellings that count as equal, after punctuation has become spaces.
SPELLINGS = (
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"),
    ("authorisation", "authorization"), ("authorised", "authorized"), ("calibre", "caliber"), ("cancelled", "canceled"),
    ("catalogue", "catalog"), ("centre", "center"), ("emphasised", "emphasized"), ("favour", "favor"),
    ("favourite", "favorite"), ("fulfil", "fulfill"), ("fulfilment", "fulfillment"), ("initialise", "initialize"),
    ("judgement", "judgment"), ("labelling", "labeling"), ("labour", "labor"), ("licence", "license"),
    ("licences", "licenses"), ("licenced", "licensed"), ("maximise", "maximize"), ("modelled", "modeled"),
    ("offence", "offense"), ("optimise", "optimize"), ("organisation", "organization"),
    ("organise", "organize"), ("practise", "practice"), ("programme", "program"), ("realise", "realize"),
    ("recognise", "recognize"), ("signalling", "signaling"),
    ("sublicence", "sublicense"), ("sublicences", "sublicenses"), ("sublicenced", "sublicensed"), ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "willful"),
)
#: Two words that are one in the usual spelling.
JOINED = r"(?<![^ ])(non|sub) (commercial|license|licenses|licensed)(?![^ ])"
#: Lines of blanks and comment signs alone part paragraphs.
BETWEEN = r"\r?\n[ \t\r*#/;-]*\n"
SPACE = r" \t\n\x0B\f\r"
YEAR = r"(?:[0-9]{4}|[<\[{(]?y(?:ear|yyy)[>\]})]?)"
#: A paragraph that opens with a mark and a year, one of a mark and up to eight words more, and `all rights reserved` alone.
NOTICE = (
    rf"^[{SPACE}*#/;-]*(?:(?:copyright|\(c\)|©)[{SPACE}:]*)+{YEAR}",
    rf"^[{SPACE}*#/;-]*(?:copyright|©)[{SPACE}]+(?:(?:\(c\)|©)[{SPACE}]+)?(?:[^{SPACE}]+[{SPACE}]+){{0,7}}[^{SPACE}]+[{SPACE}]*$",
    rf"^[{SPACE}*#/;-]*all rights reserved[{SPACE}.*#/;-]*$",
)
HINT = r"copyright|\(c\)|©|all rights reserved"
OTHER, OTHER_ASCII = r"[^\p{L}\p{M}\p{N}]+", "[^a-z0-9]+"
FOLDER = Path(__file__).parent / "licences"


def canonical(text: Column) -> Column:
    low = ascii_lower(F.coalesce(text, F.lit("")))
    notice = lambda p: p.rlike(NOTICE[0]) | p.rlike(NOTICE[1]) | p.rlike(NOTICE[2])
    own = F.when(low.rlike(HINT), F.array_join(F.filter(F.split(low, BETWEEN), lambda p: ~notice(p)), "\n\n")).otherwise(low)
    plain = F.octet_length(own) == F.length(own)
    words = F.trim(F.when(plain, F.regexp_replace(own, OTHER_ASCII, " ")).otherwise(F.regexp_replace(own, OTHER, " ")))
    # Few texts have a word of another spelling; those go through the table word by word.
    table = F.create_map(*[F.lit(w) for pair in SPELLINGS for w in pair])
    any_other = r"(?<![^ ])(?:" + "|".join(other for other, _ in SPELLINGS) + r")(?![^ ])"
    usual = F.array_join(F.transform(F.split(words, " "), lambda w: F.coalesce(F.element_at(table, w), w)), " ")
    words = F.when(words.rlike(any_other), usual).otherwise(words)
    return F.regexp_replace(words, JOINED, "$1$2")


def licence_digests(licences: DataFrame) -> DataFrame:
    """licence, digest from licence, text."""
    known = licences.select("licence", F.sha2(canonical(F.col("text")).cast("binary"), 256).alias("digest"))
    return known.groupBy("digest").agg(F.min("licence").alias("licence"))


def known_digests(spark: SparkSession) -> DataFrame:
    rows = [tuple(line.split("\t")) for line in (FOLDER / "digests.tsv").read_text().splitlines()]
    return spark.createDataFrame(rows, "licence string, digest string")


def license_scan(docs: DataFrame, known: DataFrame | None = None, small: int = 100_000) -> DataFrame:
    """doc_id, n_chars (of the canonical text), digest, licence (null if unknown): one row per document."""
    known = known_digests(docs.sparkSession) if known is None else known
    rows = docs.select("doc_id", canonical(F.col("text")).alias("c"))
    rows = rows.select("doc_id", F.length("c").alias("n_chars"), F.sha2(F.col("c").cast("binary"), 256).alias("digest"))
    # Known digests are broadcast only while they are few; a larger table meets the digests by shuffle.
    known = F.broadcast(known) if known.limit(small + 1).count() <= small else known
    return rows.join(known, "digest", "left").select("doc_id", "n_chars", "digest", "licence")
