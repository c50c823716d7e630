"""Encoded payloads among added lines: base64 and hexadecimal literals, and lines turned by rot13."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import catalog as C
from ..functions.text import from_base64, from_hex, rot13

SUSPICIOUS = "(?i)" + "|".join(C.DECODED_WORDS)


def printable(text: Column) -> Column:
    """Over 70 in 100 characters are printable or line ends and tabs."""
    odd = F.length(F.regexp_replace(text, r"[^\p{C}\p{Z}]|[ \n\t\r]", ""))
    return (F.length(text) - odd) / F.greatest(F.length(text), F.lit(1)) > 0.7


def decoded_payloads(added: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """key..., line_number, encoding, encoded (50 characters), decoded (200), severity, n_words.

    Only what holds a suspicious word after decoding is a payload. An encoded literal counts once per file and
    encoding, at its first line. CRITICAL if certain words are in it; rot13 is always HIGH.
    """
    line = F.col("line")
    literals = lambda kind, pattern, decode: F.transform(F.regexp_extract_all(line, F.lit(pattern), F.lit(1)), lambda x: F.struct(F.lit(kind).alias("encoding"), x.alias("encoded"), decode(x).alias("decoded")))
    whole = F.when(F.length(line) > 10, F.array(F.struct(F.lit("rot13").alias("encoding"), line.alias("encoded"), rot13(line).alias("decoded"))))
    found = F.concat(literals("base64", C.BASE64_LITERAL, from_base64), literals("hex", C.HEX_LITERAL, from_hex), F.coalesce(whole, F.array().cast("array<struct<encoding: string, encoded: string, decoded: string>>")))
    each = added.select(*key, "seq", "line_number", F.posexplode(found).alias("at", "_f")).select(*key, "seq", "line_number", "at", "_f.*")
    hits = each.where(F.col("decoded").rlike(SUSPICIOUS) & ((F.col("encoding") == "rot13") | printable(F.col("decoded"))))
    first = F.row_number().over(Window.partitionBy(*key, F.when(F.col("encoding") == "rot13", F.concat_ws(":", "seq", "encoded")).otherwise(F.concat_ws(":", "encoding", "encoded"))).orderBy("seq", "at"))
    low = F.lower("decoded")
    has = lambda words: F.greatest(*(low.contains(w).cast("int") for w in words)) == 1
    severity = F.when((F.col("encoding") == "base64") & has(C.BASE64_CRITICAL), "CRITICAL").when((F.col("encoding") == "hex") & has(C.HEX_CRITICAL), "CRITICAL").otherwise("HIGH")
    return hits.withColumn("_n", first).where("_n = 1").select(
        *key, "line_number", "encoding", F.left("encoded", F.lit(50)).alias("encoded"), F.left("decoded", F.lit(200)).alias("decoded"),
        severity.alias("severity"), F.regexp_count("decoded", F.lit(SUSPICIOUS)).cast("long").alias("n_words"))
