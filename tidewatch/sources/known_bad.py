"""Known-bad releases and advisories, landed as JSON."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..operators.tenants import advisory_severity

RELEASE = "name string, version string, ecosystem string, verdict string, severity string, summary string, source string, reported_at string, cve string, osv_id string"
ADVISORY = "struct<vulns: array<struct<id: string, summary: string, details: string, published: string, aliases: array<string>, severity: array<struct<type: string, score: string>>>>>"


def read_known_bad(spark: SparkSession, path: str) -> DataFrame:
    """A JSON file with a list of releases; rows without name or version are left out, the first of a key stays."""
    rows = spark.read.schema(RELEASE).option("multiLine", "true").json(path)
    return rows.where("name is not null and version is not null").dropDuplicates(["name", "version", "ecosystem"])


def advisories(responses: DataFrame) -> DataFrame:
    """name, version, ecosystem, advisory_id, severity, verdict, cve, summary of each vulnerability of landed responses (name, version, ecosystem, body).

    A malicious-package id gives MALICIOUS, others SUSPICIOUS; cve is the first alias of that kind. Bodies that cannot be parsed give nothing.
    """
    each = responses.select("name", "version", "ecosystem", F.explode(F.from_json("body", ADVISORY)["vulns"]).alias("v"))
    score = F.get(F.filter("v.severity", lambda s: s["type"] == "CVSS_V3"), F.lit(0))["score"]
    cve = F.get(F.filter("v.aliases", lambda a: a.startswith("CVE-")), F.lit(0))
    return each.select("name", "version", "ecosystem", F.col("v.id").alias("advisory_id"), advisory_severity(score, F.col("v.id")).alias("severity"),
                       F.when(F.col("v.id").startswith("MAL-"), "MALICIOUS").otherwise("SUSPICIOUS").alias("verdict"), cve.alias("cve"), F.coalesce("v.summary", F.left("v.details", F.lit(200))).alias("summary"))


def paired(sent: DataFrame, answers: DataFrame) -> DataFrame:
    """name, version, ecosystem, vulns: a batch's answers belong to its packages by place; packages past the end of the answers have none.

    sent: batch, packages (array of name, version, ecosystem in the order sent). answers: batch, body ({"results": [{"vulns": [...]}, ...]}).
    """
    result = ADVISORY.replace("struct<vulns", "struct<results: array<struct<vulns", 1) + ">>"
    both = sent.join(answers, "batch", "left").select("packages", F.from_json("body", result)["results"].alias("results"))
    each = both.select(F.posexplode("packages").alias("at", "p"), "results")
    return each.select("p.name", "p.version", "p.ecosystem", F.coalesce(F.get("results", F.col("at"))["vulns"], F.array()).alias("vulns"))


def batches(packages: DataFrame, size: int = 100) -> DataFrame:
    """Request bodies of `size` packages each, numbered within their partition: batch, n, body. No shuffle, no single task."""
    numbered = packages.withColumn("_i", F.monotonically_increasing_id()).withColumn("batch", F.floor(F.col("_i") / size))
    query = F.struct(F.col("version").alias("version"), F.struct(F.col("name").alias("name"), F.col("ecosystem").alias("ecosystem")).alias("package"))
    return numbered.groupBy("batch").agg(F.count("*").alias("n"), F.to_json(F.struct(F.collect_list(query).alias("queries"))).alias("body"))


def holders(files: DataFrame, items: DataFrame, key: str = "doc_id", item: str = "item_id", text: str = "text", block: int = 1 << 21) -> DataFrame:
    """(key, item) of each file that holds the text of an item of a known-bad list, once each. Nothing is shuffled.

    The list is broadcast in blocks of about `block` characters, of which the driver holds one at a time; the files are read once for each block, and all items of a
    block are looked for in one pass over a text (Aho-Corasick). Null texts hold nothing and null items are nowhere; an empty item is in every text.
    """
    kinds = {f.name: f.dataType for f in items.schema} | {f.name: f.dataType for f in files.schema}
    schema = f"`{key}` {kinds[key].simpleString()}, `{item}` {kinds[item].simpleString()}"
    spark, types = files.sparkSession, (to_arrow_type(kinds[key]), to_arrow_type(kinds[item]))

    def search(rows: list[tuple]) -> DataFrame:
        shared = spark.sparkContext.broadcast(rows)

        def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            of: dict[str, list] = {}
            for i, t in shared.value:
                of.setdefault(t, []).append(i)
            always, machine = of.pop("", []), ahocorasick.Automaton()
            for t, ids in of.items():
                machine.add_word(t, ids)
            machine.make_automaton()
            for batch in batches:
                keys, ids = [], []
                for k, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                    t = t.as_py()
                    held = {i for _, hit in machine.iter(t) for i in hit} if of else set()
                    held.update(always)
                    keys += [k] * len(held)
                    ids += held
                yield pa.RecordBatch.from_arrays([pa.array(keys, types[0]), pa.array(ids, types[1])], [key, item])

        return files.where(F.col(text).isNotNull()).select(key, text).mapInArrow(found, schema)

    out, rows, size = None, [], 0
    for r in items.where(F.col(text).isNotNull()).select(item, text).toLocalIterator():
        rows.append((r[0], r[1]))
        size += len(r[1])
        if size >= block:
            out = search(rows) if out is None else out.unionByName(search(rows))
            rows, size = [], 0
    return search(rows) if out is None else out.unionByName(search(rows)) if rows else out
