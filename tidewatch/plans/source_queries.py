"""Registered queries of sources, metadata, triage and the tenant flow: texts that Spark makes from the tables, read back by the library."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators import chunks, manifests, signals, tenants, triage
from ..sources import feeds, lockfiles, metadata
from ..sources.boms import bom_components
from . import bindings as B
from .queries import COMP, DEP, KB, TP, _depends_on, _known_bad, _tenant_packages, query

c = F.col


def _text(*parts) -> Column:
    """Columns and plain strings as one text."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def _listed(order: str, line: Column, between: str = "\n") -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, line.alias("_line")))), lambda x: x["_line"]), between)


# --- bills of material, locks, manifests in their other forms ------------------------------------------------
@query("""SELECT l_orderkey AS sbom_id, CASE WHEN l_linenumber % 2 = 0 THEN 'npm' WHEN l_orderkey % 3 = 0 THEN 'maven' ELSE 'unknown' END AS ecosystem,
    CASE WHEN l_linenumber % 2 = 0 OR l_orderkey % 3 <> 0 THEN 'part' || l_partkey ELSE 'org.g:part' || l_partkey END AS name, '1.' || l_linenumber AS version FROM lineitem""")
def q_sbom_formats(spark, sf_dir):
    """CycloneDX and SPDX as XML, SPDX as JSON; a bill's comment names the other format."""
    n, v, even = _text("part", c("l_partkey")), _text("1.", c("l_linenumber")), c("l_linenumber") % 2 == 0
    purl = _text("pkg:npm/", n, "@", v)
    cyclone = F.concat(_text('<component type="library">'), F.when(even, "").otherwise("<group>org.g</group>"), _text("<name>", n, "</name><version>", v, "</version>"), F.when(even, _text("<purl>", purl, "</purl>")).otherwise(""), F.lit("</component>"))
    spdx = F.concat(_text("<package><SPDXID>p", c("l_linenumber"), "</SPDXID><name>", n, "</name><versionInfo>", v, "</versionInfo>"), F.when(even, _text("<externalRef><referenceType>purl</referenceType><referenceLocator>", purl, "</referenceLocator></externalRef>")).otherwise(""), F.lit("</package>"))
    ref = F.when(even, F.array(F.struct(F.lit("purl").alias("referenceType"), purl.alias("referenceLocator"))))
    entry = F.struct(_text("p", c("l_linenumber")).alias("SPDXID"), n.alias("name"), v.alias("versionInfo"), ref.alias("externalRefs"))
    kind = c("sbom_id") % 3
    made = B.table(spark, sf_dir, "lineitem").groupBy(c("l_orderkey").alias("sbom_id")).agg(
        _listed("l_linenumber", cyclone, "").alias("a"), _listed("l_linenumber", spdx, "").alias("b"), F.to_json(F.struct(F.lit("SPDXRef-DOCUMENT").alias("SPDXID"), F.collect_list(entry).alias("packages"))).alias("j"))
    text = F.when(kind == 0, _text('<?xml version="1.0"?><!-- see https://spdx.org --><bom xmlns="http://cyclonedx.org/schema/bom/1.4"><components>', c("a"), "</components></bom>")).when(kind == 1, _text("<SpdxDocument><packages>", c("b"), "</packages></SpdxDocument>")).otherwise(c("j"))
    return bom_components(made.select("sbom_id", F.when(kind == 2, "bom.json").otherwise("bom.xml").alias("file_name"), text.alias("text")))


@query("""WITH p AS (SELECT p_partkey % 4 AS kind, p_partkey // 200 AS block, p_partkey, p_size FROM part)
    SELECT kind || '/' || block AS lock_id, CASE WHEN kind < 2 THEN 'npm' ELSE 'pypi' END AS ecosystem, CASE WHEN kind < 2 AND p_partkey % 3 = 0 THEN '@s/p' ELSE 'p' END || p_partkey AS name, '1.' || p_size AS version FROM p""")
def q_lock_kinds(spark, sf_dir):
    """package-lock.json, yarn.lock, Pipfile.lock and poetry.lock."""
    p = B.table(spark, sf_dir, "part").select((c("p_partkey") % 4).alias("kind"), F.floor(c("p_partkey") / 200).alias("block"), "p_partkey", _text("1.", c("p_size")).alias("v"))
    kind, npm = c("kind"), F.when((c("kind") < 2) & (c("p_partkey") % 3 == 0), _text("@s/p", c("p_partkey"))).otherwise(_text("p", c("p_partkey")))
    line = (F.when(kind == 0, _text('"node_modules/', npm, '": {"version": "', c("v"), '"}')).when(kind == 1, _text('"', npm, "@^1.0.0, ", npm, '@^1":\n  version "', c("v"), '"\n  resolved "x"\n'))
            .when(kind == 2, _text('"', npm, '": {"version": "==', c("v"), '"}')).otherwise(_text('[[package]]\nname = "', npm, '"\nversion = "', c("v"), '"\n\n[package.dependencies]\nversion = "9"\n')))
    made = p.groupBy("kind", "block").agg(_listed("p_partkey", line, ",\n").alias("commas"), _listed("p_partkey", line).alias("rows"))
    text = F.when(kind == 0, _text('{"packages": {"": {"name": "root", "version": "0"}, ', c("commas"), "}}")).when(kind == 2, _text('{"default": {', c("commas"), '}, "develop": {}}')).otherwise(_text("# lock\n", c("rows")))
    name = F.element_at(F.array(*map(F.lit, ("package-lock.json", "yarn.lock", "Pipfile.lock", "poetry.lock"))), (kind + 1).cast("int"))
    return lockfiles.locked_packages(made.select(_text(kind, "/", c("block")).alias("lock_id"), name.alias("file_name"), text.alias("text")))


@query("""WITH p AS (SELECT *, p_partkey % 4 AS kind, p_partkey // 200 AS block FROM part)
    SELECT kind || '/' || block AS file_id, ['pypi', 'go', 'cargo', 'cargo'][kind + 1] AS ecosystem, CASE kind WHEN 1 THEN 'example.com/part' ELSE 'part' END || p_partkey AS name,
    CASE kind WHEN 0 THEN '>=1.' || p_size ELSE '1.' || p_size || '.0' END AS version_spec, CASE kind WHEN 1 THEN p_partkey % 5 = 0 ELSE false END AS is_dev FROM p""")
def q_manifest_kinds(spark, sf_dir):
    """Diffs of requirements.txt, go.mod, Cargo.toml and Cargo.lock."""
    p = B.table(spark, sf_dir, "part").select((c("p_partkey") % 4).alias("kind"), F.floor(c("p_partkey") / 200).alias("block"), "p_partkey", "p_size")
    kind, n, v = c("kind"), _text("part", c("p_partkey")), _text("1.", c("p_size"))
    line = (F.when(kind == 0, _text("+", n, ">=", v)).when(kind == 1, _text("+\texample.com/", n, " v", v, ".0", F.when(c("p_partkey") % 5 == 0, " // indirect").otherwise("")))
            .when(kind == 2, _text("+", n, ' = "', v, '.0"')).otherwise(_text('+[[package]]\n+name = "', n, '"\n+version = "', v, '.0"')))
    made = p.groupBy("kind", "block").agg(_listed("p_partkey", line).alias("rows"))
    head = F.when(kind == 1, "+require (\n").when(kind == 2, "+[dependencies]\n").otherwise("")
    path = F.element_at(F.array(*map(F.lit, ("requirements.txt", "go.mod", "Cargo.toml", "Cargo.lock"))), (kind + 1).cast("int"))
    diffs = made.select(_text(kind, "/", c("block")).alias("file_id"), path.alias("path"), F.concat(head, "rows", F.when(kind == 1, "\n+)").otherwise("")).alias("content"))
    return manifests.new_dependencies(diffs).drop("path", "line_number")


@query("""SELECT conv_id, turn // 4 AS chunk_index, string_agg(CASE WHEN turn % 5 = 4 THEN '[Binary file: f' || turn || ']' ELSE '--- f' || turn || chr(10) || coalesce(text, '') END, chr(10) || chr(10) ORDER BY turn, 'f' || turn, text) AS text FROM conversations GROUP BY ALL""")
def q_chunk_text(spark, sf_dir):
    """What an analyzer is given of each chunk."""
    t = c("turn")
    f = B.table(spark, sf_dir, "conversations").select("conv_id", F.floor(t / 4).alias("chunk_index"), t.alias("place"), _text("f", t).alias("path"), c("text").alias("content"), (t % 5 == 4).alias("is_binary"))
    return chunks.rendered(f, "conv_id")


# --- polls and metadata ------------------------------------------------------------------------------------
@query("""WITH v AS (SELECT p_brand || '/' || p_size AS name, p_partkey % 7 AS a, p_partkey % 11 AS b, p_partkey % 3 AS c FROM part), t AS (SELECT name, max(a * 10000 + b * 100 + c) AS top FROM v GROUP BY name)
    SELECT name, (top // 10000) || '.' || (top // 100 % 100) || '.' || (top % 100) AS version, '6.10.2' AS previous_version FROM t WHERE top <> 61002""")
def q_polled_latest(spark, sf_dir):
    """Modules whose largest version is another than the known one."""
    k = c("p_partkey")
    snapshot = B.table(spark, sf_dir, "part").select(_text(c("p_brand"), "/", c("p_size")).alias("name"), _text(k % 7, ".", k % 11, ".", k % 3).alias("version"))
    return feeds.polled_latest(snapshot, snapshot.select("name", F.lit("6.10.2").alias("version")).distinct())


@query("""WITH r AS (SELECT l_partkey AS name, l_orderkey || '.' || l_linenumber AS version, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber) AS n FROM lineitem WHERE l_returnflag <> 'R')
    SELECT name, max(version) FILTER (n = 1) AS version, max(version) FILTER (n = 2) AS previous_version FROM r WHERE n <= 2 GROUP BY name""")
def q_first_two(spark, sf_dir):
    """The two newest versions that are not yanked."""
    li = B.table(spark, sf_dir, "lineitem").select(c("l_partkey").alias("name"), _text(c("l_orderkey"), ".", c("l_linenumber")).alias("version"), (c("l_returnflag") == "R").alias("yanked"), "l_shipdate", "l_orderkey", "l_linenumber")
    return feeds.first_two(li, [F.desc("l_shipdate"), F.desc("l_orderkey"), "l_linenumber"])


SQL_RELEASED = """rel AS (SELECT l_partkey AS name, l_orderkey || '.' || l_linenumber AS version, timestamp '2020-01-01' + (l_orderkey * 7 % 3000) * INTERVAL 1 DAY + l_linenumber * INTERVAL 1 SECOND AS published, min(l_suppkey) % 5 AS author, l_linenumber FROM lineitem GROUP BY l_partkey, l_orderkey, l_linenumber),
    tr AS (SELECT *, lag(version) OVER w AS prev_version, lag(author) OVER w AS prev_author, lag(l_linenumber) OVER w AS prev_line FROM rel WINDOW w AS (PARTITION BY name ORDER BY published, version))"""


def _released(spark, sf_dir):
    day = F.date_format(F.timestamp_add("SECOND", c("l_linenumber"), F.timestamp_add("DAY", (c("l_orderkey") * 7 % 3000).cast("int"), F.lit("2020-01-01 00:00:00").cast("timestamp"))), "yyyy-MM-dd'T'HH:mm:ss")
    li = B.table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("l_suppkey"))  # a version is one row
    return li.select(c("l_partkey").alias("name"), _text(c("l_orderkey"), ".", c("l_linenumber")).alias("version"), day.alias("day"), (c("l_suppkey") % 5).cast("string").alias("author"), "l_linenumber")


@query(f"""WITH {SQL_RELEASED} SELECT name::VARCHAR AS name, version, prev_version, concat_ws(',', CASE WHEN author <> prev_author THEN 'MAINTAINER_CHANGE' END, CASE WHEN l_linenumber > prev_line THEN 'NEW_DEPENDENCY' END,
    CASE WHEN l_linenumber % 4 = 0 AND prev_line % 4 <> 0 THEN 'NEW_INSTALL_HOOK' END) AS signals FROM tr WHERE prev_version IS NOT NULL""")
def q_npm_transitions(spark, sf_dir):
    """Whole registry documents of npm packages, to versions, to the signals between neighbours."""
    r = _released(spark, sf_dir)
    deps = F.map_from_arrays(F.transform(F.sequence(F.lit(1), c("l_linenumber")), lambda i: F.concat(F.lit("d"), i.cast("string"))), F.transform(F.sequence(F.lit(1), c("l_linenumber")), lambda i: F.lit("^1")))
    scripts = F.when(c("l_linenumber") % 4 == 0, F.create_map(F.lit("postinstall"), F.lit("x"))).otherwise(F.create_map(F.lit("test"), F.lit("x")))
    v = F.struct(F.array(F.struct(c("author").alias("name"))).alias("maintainers"), deps.alias("dependencies"), scripts.alias("scripts"))
    docs = r.groupBy(c("name").cast("string").alias("name")).agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct("version", F.concat("day", F.lit(".123Z"))))).alias("time"), F.map_from_entries(F.collect_list(F.struct("version", v))).alias("versions"))).alias("body"))
    t = metadata.transitions(metadata.npm_versions(docs), "maintainers", "dependencies", "scripts")
    found = F.concat(signals.maintainer_change(c("prev_maintainers"), c("maintainers")), signals.npm_transition(c("prev_dependencies"), c("dependencies"), c("prev_scripts"), c("scripts")))
    return t.select("name", "version", "prev_version", signals.ids(found).alias("signals"))


@query(f"""WITH {SQL_RELEASED} SELECT name::VARCHAR AS name, version, prev_version, concat_ws(',', CASE WHEN author <> prev_author THEN 'MAINTAINER_CHANGE' END, CASE WHEN l_linenumber = 1 AND prev_line <> 1 THEN 'NEW_SETUP_PY' END) AS signals FROM tr WHERE prev_version IS NOT NULL""")
def q_pypi_transitions(spark, sf_dir):
    """PyPI documents, one for each release as they are landed, to the signals between neighbours."""
    r = _released(spark, sf_dir)
    files_ = F.when(c("l_linenumber") == 1, F.array(F.lit("setup.py"), F.lit("a.whl"))).otherwise(F.array(F.lit("a.whl")))
    uploads = F.transform(files_, lambda f: F.struct(F.concat("day", F.lit("+00:00")).alias("upload_time_iso_8601"), f.alias("filename")))
    docs = r.select(c("name").cast("string").alias("name"), F.to_json(F.struct(F.struct("author", "version").alias("info"), F.map_from_arrays(F.array("version"), F.array(uploads)).alias("releases"))).alias("body"))
    t = metadata.transitions(metadata.pypi_versions(docs), "author", "files")
    return t.select("name", "version", "prev_version", signals.ids(F.concat(signals.author_change(c("prev_author"), c("author")), signals.pypi_files(c("prev_files"), c("files")))).alias("signals"))


@query(f"""WITH {SQL_RELEASED} SELECT name::VARCHAR AS name, version, prev_version, CASE WHEN author <> prev_author THEN 'VCS_ORIGIN_CHANGED' ELSE '' END AS signals FROM tr WHERE prev_version IS NOT NULL""")
def q_go_transitions(spark, sf_dir):
    r = _released(spark, sf_dir)
    docs = r.select(c("name").cast("string").alias("name"), F.to_json(F.struct(c("version").alias("Version"), F.concat("day", F.lit("Z")).alias("Time"), F.struct(_text("https://git.example/", c("author")).alias("URL")).alias("Origin"))).alias("body"))
    t = metadata.transitions(metadata.go_versions(docs), "origin")
    return t.select("name", "version", "prev_version", signals.ids(signals.origin_change(c("prev_origin"), c("origin"))).alias("signals"))


@query(f"""WITH {SQL_RELEASED} SELECT name::VARCHAR AS name, version, prev_version, CASE WHEN prev_line % 3 = 0 THEN 'YANKED_PREDECESSOR' ELSE '' END AS signals FROM tr WHERE prev_version IS NOT NULL""")
def q_crate_transitions(spark, sf_dir):
    r = _released(spark, sf_dir)
    v = F.struct(c("version").alias("num"), F.concat("day", F.lit(".5+00:00")).alias("created_at"), (c("l_linenumber") % 3 == 0).alias("yanked"))
    docs = r.groupBy(c("name").cast("string").alias("name")).agg(F.to_json(F.struct(F.collect_list(v).alias("versions"))).alias("body"))
    t = metadata.transitions(metadata.crate_versions(docs), "yanked")
    return t.select("name", "version", "prev_version", signals.ids(signals.yanked_predecessor(c("prev_yanked"))).alias("signals"))


@query("""WITH u AS (SELECT l_partkey, count(DISTINCT l_orderkey || '.' || l_linenumber) AS versions, min(date '2024-01-01' - (l_orderkey % 120)::INTEGER) AS first FROM lineitem WHERE l_partkey % 10 <> 0 GROUP BY ALL), m AS (SELECT p_partkey, l_partkey IS NULL AS absent, date_diff('day', first, date '2024-01-01') AS age, versions, CASE WHEN p_partkey % 2 = 0 THEN p_size * 30 END AS weekly, ['npm', 'pypi', 'go'][p_partkey % 3 + 1] AS ecosystem FROM part LEFT JOIN u ON l_partkey = p_partkey),
    s AS (SELECT *, CASE WHEN age < 7 THEN 40 WHEN age < 30 THEN 25 WHEN age < 90 THEN 10 ELSE 0 END + CASE WHEN ecosystem = 'npm' AND weekly < 100 THEN 30 WHEN ecosystem = 'npm' AND weekly < 1000 THEN 15 ELSE 0 END + CASE WHEN versions = 1 THEN 20 ELSE 0 END AS score FROM m)
    SELECT p_partkey::VARCHAR AS name, ecosystem, CASE WHEN ecosystem = 'go' THEN 'NONE' WHEN absent OR score >= 35 AND score < 60 THEN 'HIGH' WHEN score >= 60 THEN 'CRITICAL' WHEN score >= 15 THEN 'MEDIUM' WHEN score >= 1 THEN 'LOW' ELSE 'NONE' END AS severity,
    CASE WHEN ecosystem = 'go' THEN 0.0 WHEN absent THEN 0.15 WHEN score >= 60 THEN 0.30 WHEN score >= 35 THEN 0.20 WHEN score >= 15 THEN 0.10 WHEN score >= 1 THEN 0.05 ELSE 0.0 END::DOUBLE AS boost FROM s""")
def q_reputation_lookup(spark, sf_dir):
    """Dependencies judged by landed registry documents; those of no registry are HIGH, other ecosystems are not judged."""
    k = c("p_partkey")
    p = B.table(spark, sf_dir, "part").select(k.cast("string").alias("name"), F.element_at(F.array(F.lit("npm"), F.lit("pypi"), F.lit("go")), (k % 3 + 1).cast("int")).alias("ecosystem"), F.when(k % 2 == 0, (c("p_size") * 30).cast("long")).alias("weekly_downloads"))
    r = B.table(spark, sf_dir, "lineitem").where("l_partkey % 10 <> 0").select(c("l_partkey").cast("string").alias("name"), (c("l_partkey") % 3).alias("kind"), _text(c("l_orderkey"), ".", c("l_linenumber")).alias("version"), F.concat(F.date_format(F.date_sub(F.lit("2024-01-01").cast("date"), (c("l_orderkey") % 120).cast("int")), "yyyy-MM-dd"), F.lit("T00:00:00")).alias("at"))
    r = r.distinct()
    npm = r.where("kind = 0").groupBy("name").agg(F.to_json(F.struct(F.create_map(F.lit("created"), F.concat(F.min("at"), F.lit(".000Z"))).alias("time"), F.map_from_entries(F.collect_list(F.struct("version", F.struct(F.lit("x").alias("y"))))).alias("versions"))).alias("body"))
    upload = F.array(F.struct(c("at").alias("upload_time_iso_8601")))
    pypi = r.where("kind = 1").groupBy("name").agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct("version", upload))).alias("releases"))).alias("body"))
    found = metadata.npm_metrics(npm, p.where("ecosystem = 'npm'").select("name", "weekly_downloads")).unionByName(metadata.pypi_metrics(pypi))
    return signals.judged_reputation(p.select("name", "ecosystem"), found, F.lit("2024-01-01 00:00:00").cast("timestamp")).select("name", "ecosystem", "severity", "boost")


# --- admission, watchlists, answers by place -----------------------------------------------------------------
@query("SELECT ecosystem, name, version, serial FROM (SELECT event_type AS ecosystem, user_id::VARCHAR AS name, coalesce(json_extract_string(props, '$.k'), '') AS version, event_id AS serial, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM events) WHERE n <= 100")
def q_admission(spark, sf_dir):
    """The limit is the feature: so many releases of each ecosystem in one cycle."""
    e = B.table(spark, sf_dir, "events").select(c("event_type").alias("ecosystem"), c("user_id").cast("string").alias("name"), F.coalesce(F.get_json_object("props", "$.k"), F.lit("")).alias("version"), c("event_id").alias("serial"))
    return feeds.admitted(e, 100)


@query("SELECT ecosystem, count(DISTINCT name) AS packages, count(*)::BIGINT AS listed FROM (SELECT DISTINCT l_returnflag AS ecosystem, l_partkey AS name, l_linestatus AS list FROM lineitem) GROUP BY ecosystem")
def q_watchlist_counts(spark, sf_dir):
    return tenants.watchlist_counts(B.table(spark, sf_dir, "lineitem").select(c("l_returnflag").alias("ecosystem"), c("l_partkey").alias("name"), c("l_linestatus").alias("list")))


@query("SELECT event_id::VARCHAR AS name, user_id::VARCHAR AS version, 'npm' AS ecosystem, CASE WHEN event_id % 50 < 45 AND event_id % 3 = 0 THEN 'A' || event_id ELSE '' END AS ids FROM events")
def q_answers_by_place(spark, sf_dir):
    """Batches of fifty packages, whose answers stop after forty-five."""
    from ..sources.known_bad import paired

    i = c("event_id")
    e = B.table(spark, sf_dir, "events").withColumn("batch", F.floor(i / 50))
    package = F.struct(i.alias("at"), i.cast("string").alias("name"), c("user_id").cast("string").alias("version"), F.lit("npm").alias("ecosystem"))
    answer = F.struct(i.alias("at"), F.when(i % 3 == 0, F.array(F.struct(_text("A", i).alias("id")))).alias("vulns"))
    made = e.groupBy("batch").agg(F.array_sort(F.collect_list(package)).alias("packages"), F.array_sort(F.collect_list(F.when(i % 50 < 45, answer))).alias("results"))
    answers = made.select("batch", F.to_json(F.struct(F.transform("results", lambda r: F.struct(r["vulns"].alias("vulns"))).alias("results"))).alias("body"))
    return paired(made.select("batch", "packages"), answers).select("name", "version", "ecosystem", F.array_join(F.transform("vulns", lambda v: v["id"]), ",").alias("ids"))


# --- triage and the tenant flow ------------------------------------------------------------------------------
#: What all lines of a release say, by doc_id % 8 ({w}: the line's first word); 7 is a manifest. The reason that each has, if there are lines.
KINDS = (("y = 1  # {w}", None), ("# comment {w}", "likely benign"), ("exec(base64.b64decode('{w}'))", "critical rule"), ("import ctypes", "critical import"),
         ("atexit.register(x_{w})", "high severity match"), ("eval(x_{w})", "critical syntax"), (None, "critical payload"))


@query(f"""WITH {B.SQL_LINES}, n AS (SELECT d.doc_id, count(l.line_no) AS n FROM documents d LEFT JOIN lines l USING (doc_id) GROUP BY d.doc_id),
    k AS (SELECT doc_id, n, doc_id % 8 AS kind, doc_id % 100 AS dep, doc_id % 4 = 0 AS odd, doc_id % 5 AS said FROM n),
    r AS (SELECT *, CASE WHEN doc_id % 16 = 15 THEN 'no chunks' WHEN kind = 7 THEN CASE WHEN dep < 30 THEN 'known bad dependency' WHEN dep < 60 THEN 'critical reputation' WHEN dep < 80 THEN 'high severity match' END WHEN n = 0 THEN 'likely benign'
          {" ".join(f"WHEN kind = {i} THEN '{reason}'" for i, (_, reason) in enumerate(KINDS) if reason)} END AS found FROM k)
    SELECT doc_id::VARCHAR AS release_id, CASE WHEN found IN ('no chunks', 'likely benign') THEN false WHEN found IS NOT NULL THEN true WHEN said = 0 THEN true WHEN said = 1 THEN true ELSE odd END AS analyze,
    coalesce(found, CASE WHEN said = 0 THEN 'triage failed' WHEN said = 1 THEN 'analyzer' WHEN odd THEN 'binary or new files' ELSE 'nothing found' END) AS reason FROM r""")
def q_triage_flow(spark, sf_dir):
    """Releases whose diffs go through every scanner; the flags of the decision come from what these find."""
    kind, words = c("doc_id") % 8, F.transform(B.lines_of(c("text")), lambda line: F.coalesce(F.nullif(F.regexp_extract(line, "[a-z]+", 0), F.lit("")), F.lit("x")))
    code = lambda made: F.array_join(F.transform(words, lambda w: F.concat(F.lit("+"), made(w))), "\n")
    body = code(lambda w: F.concat(F.lit('p = "'), F.base64(F.encode(F.concat(F.lit("import os; exec("), w, F.lit(")")), "utf-8")), F.lit('"')))
    for i, (text, _) in enumerate(KINDS):
        if text:
            parts = text.split("{w}")
            body = F.when(kind == i, code(lambda w, p=parts: F.concat(F.lit(p[0]), *(x for y in p[1:] for x in (w, F.lit(y)))))).otherwise(body)
    body = F.when(kind == 7, _text('   "dependencies": {\n+    "dep', c("doc_id") % 100, '": "^1.0"')).otherwise(body)
    docs = B.documents(spark, sf_dir).select("doc_id", "text")
    release, plain = c("doc_id").cast("string").alias("release_id"), docs.where("doc_id % 16 <> 15")
    diffs = plain.select(release, F.when(kind == 7, "package.json").otherwise("m.py").alias("path"), F.concat(F.lit("--- a\n+++ b\n@@ -1,1 +1,1 @@\n"), body).alias("content"), F.lit(False).alias("is_binary"), F.lit(False).alias("is_new"), F.lit(0).alias("chunk_index"))
    odd = docs.where("doc_id % 4 = 0").select(release, F.lit("b.so").alias("path"), F.lit("").alias("content"), F.lit(True).alias("is_binary"), F.lit(False).alias("is_new"), F.lit(1).alias("chunk_index"))
    diffs = triage.parsed_diffs(diffs.unionByName(odd))
    dep = docs.select((c("doc_id") % 100).alias("d")).distinct()
    name = _text("dep", c("d")).alias("name")
    bad = dep.where("d < 30").select(name, F.lit("1.0").alias("version"), F.lit("npm").alias("ecosystem"), F.lit("MALICIOUS").alias("verdict"), F.lit("CRITICAL").alias("severity"))
    n = lambda low, high: F.when(c("d") < 60, low).otherwise(high).cast("long")
    metrics = dep.where("d < 60 or d >= 80").select(name, F.lit("npm").alias("ecosystem"), n(1, 1000).alias("age_days"), n(5, 100000).alias("weekly_downloads"), n(1, 50).alias("total_versions"))
    said = docs.select(release, F.when(c("doc_id") % 5 > 0, c("doc_id") % 5 == 1).alias("said"))
    return triage.triage_releases(said, diffs, triage.scanner_matches(diffs, bad, metrics)).select("release_id", "analyze", "reason")


@query(f"""WITH {KB}, {COMP}, {TP}, {DEP}, hit AS (SELECT DISTINCT kb.*, tenant_id FROM kb JOIN tp ON tp.name = kb.name AND tp.ecosystem = kb.ecosystem AND (tp.version = '' OR tp.version = kb.version)),
    b AS (SELECT h.name, h.tenant_id, count(*) FILTER (direct) AS direct, count(*) FILTER (NOT direct) AS indirect, sum(CASE h.severity WHEN 'CRITICAL' THEN CASE WHEN direct THEN 40 ELSE 20 END ELSE CASE WHEN direct THEN 25 ELSE 10 END END) AS risk FROM hit h JOIN dep USING (tenant_id, ecosystem, name) GROUP BY ALL)
    SELECT 'finding-' || ecosystem || '-' || name || '-' || version || '-' || tenant_id AS finding_id, name AS release_id, tenant_id, '[' || verdict || '] ' || ecosystem || '/' || name || '@' || version AS title,
    'Release: ' || ecosystem || '/' || name || '@' || version || chr(10) || 'Verdict: ' || verdict || ' (88%)' || chr(10) || 'Severity: ' || severity || chr(10) || 'Summary: s' || chr(10) || 'Affected: ' || coalesce(direct, 0) || ' direct, ' || coalesce(indirect, 0) || ' indirect services' AS description,
    severity, coalesce(direct, 0) AS direct, coalesce(indirect, 0) AS indirect, coalesce(risk, 0)::BIGINT AS risk FROM hit LEFT JOIN b USING (name, tenant_id)""")
def q_tenant_flow(spark, sf_dir):
    alerts = _known_bad(spark, sf_dir).select(c("name").alias("release_id"), "ecosystem", "name", "version", "verdict", "severity", F.lit(0.88).alias("confidence"), F.lit("s").alias("summary"))
    return tenants.tenant_findings(alerts, _tenant_packages(spark, sf_dir).select("tenant_id", "ecosystem", "name", "version"), _depends_on(spark, sf_dir))


@query(f"""WITH {SQL_RELEASED}, v AS (SELECT DISTINCT name, version, split_part(version, '.', 1)::BIGINT AS a, split_part(version, '.', 2)::BIGINT AS b, max(published) OVER (PARTITION BY name, version) AS published FROM rel),
    r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY published DESC, version DESC) AS place, lag(version) OVER (PARTITION BY name ORDER BY a, b) AS previous_version FROM v)
    SELECT name::VARCHAR AS name, version, previous_version FROM r WHERE place = 1""")
def q_npm_latest(spark, sf_dir):
    """Documents whose tag names the version published last, which is seldom the greatest: its predecessor by precedence."""
    r = _released(spark, sf_dir)
    none = F.struct(F.array().cast("array<struct<name: string>>").alias("maintainers"))
    tag = F.create_map(F.lit("latest"), F.max_by("version", F.struct("day", "version")))
    docs = r.groupBy(c("name").cast("string").alias("name")).agg(F.to_json(F.struct(tag.alias("dist-tags"), F.map_from_entries(F.collect_list(F.struct("version", none))).alias("versions"))).alias("body"))
    return metadata.npm_latest(docs)
