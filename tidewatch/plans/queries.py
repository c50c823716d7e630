"""Registered queries of the release-risk operators, each with the same query in SQL where that can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import catalog as C
from ..functions import text as T
from ..operators import chunks, decode, imports, lines, manifests, rules, signals, syntax, tenants, verdicts
from ..sources import feeds, lockfiles
from ..sources.boms import bom_components
from . import bindings as B

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


SEV = "CASE severity WHEN 'CRITICAL' THEN 5 WHEN 'HIGH' THEN 4 WHEN 'MEDIUM' THEN 3 WHEN 'LOW' THEN 2 WHEN 'NONE' THEN 1 ELSE 0 END"
NAMES = "CASE {} WHEN 5 THEN 'CRITICAL' WHEN 4 THEN 'HIGH' WHEN 3 THEN 'MEDIUM' WHEN 2 THEN 'LOW' ELSE 'NONE' END"


def sql_hits() -> str:
    """hits: what each rule finds in each line of code; RE2 has no look-ahead, so the two rules with exclusions are written out."""
    plain = [r for r in C.RULES if r[0] not in C.UNLESS]
    rows = ", ".join(f"({_q(r[0])}, {_q(r[1])}, {_q(r[2])}, {_q('(?' + ('is' if r[4] else 'i') + ')' + r[5])})" for r in plain)
    ip, http = (next(r for r in C.RULES if r[0] == n) for n in ("HARDCODED_IP", "SUSPICIOUS_HTTP"))
    verb = "(?i)" + http[5].removesuffix("http[s]?://").removesuffix(".*?") + "(.*)$"
    return f"""rules(rule_id, category, severity, pattern) AS (VALUES {rows}),
    hits AS (SELECT doc_id, source, lang, line_no, line, rule_id, category, severity FROM code, rules WHERE regexp_matches(line, pattern)
             UNION ALL SELECT doc_id, source, lang, line_no, line, {_q(ip[0])}, {_q(ip[1])}, {_q(ip[2])} FROM code
             WHERE len(list_filter(regexp_extract_all(line, {_q('(?i)' + ip[5])}, 1), lambda x: NOT regexp_matches(x, {_q(C.PRIVATE_IP)}))) > 0
             UNION ALL SELECT doc_id, source, lang, line_no, line, {_q(http[0])}, {_q(http[1])}, {_q(http[2])} FROM code
             WHERE len(list_filter(regexp_extract_all(regexp_extract(line, {_q(verb)}, 1), '(?i)https?://([^/\\s]*)', 1), lambda x: NOT regexp_matches(x, {_q('(?i)' + C.ALLOWED_HOSTS)}))) > 0)"""


def sql_texts(lines: str) -> str:
    """text_hits: what each rule finds in all lines of a file taken as one text (table `lines`: doc_id, number, line, in order of number), at the line where a match starts."""
    plain = [r for r in C.RULES if r[0] not in C.UNLESS]
    rows = ", ".join(f"({_q(r[0])}, {_q(r[1])}, {_q(r[2])}, {_q('(?' + ('is' if r[4] else 'i') + ')' + r[5])})" for r in plain)
    ip, http = (next(r for r in C.RULES if r[0] == n) for n in ("HARDCODED_IP", "SUSPICIOUS_HTTP"))
    verb = "(?i)" + http[5].removesuffix("http[s]?://").removesuffix(".*?") + "(.*)$"
    return f"""text_rules(rule_id, category, severity, pattern) AS (VALUES {rows}),
    texts AS (SELECT doc_id, list(number ORDER BY number) AS numbers, string_agg(line, chr(10) ORDER BY number) AS text FROM {lines} GROUP BY doc_id),
    marked AS (SELECT doc_id, numbers, rule_id, category, severity, string_split(regexp_replace(text, pattern, chr(64976) || '\\0' || chr(64977), 'g'), chr(10)) AS rows FROM texts, text_rules WHERE regexp_matches(text, pattern)),
    places AS (SELECT *, unnest(generate_series(1, len(rows))) AS i FROM marked),
    text_hits AS (SELECT doc_id, numbers[i] AS line_number, rule_id, category, severity, regexp_extract(array_to_string(rows[i:i + 50], chr(10)), '\\x{{FDD0}}([^\\x{{FDD1}}]{{0,50}})', 1) AS evidence FROM places WHERE contains(rows[i], chr(64976))
             UNION ALL SELECT doc_id, number, {_q(ip[0])}, {_q(ip[1])}, {_q(ip[2])}, left(list_filter(list_zip(regexp_extract_all(line, {_q('(?i)' + ip[5])}, 0), regexp_extract_all(line, {_q('(?i)' + ip[5])}, 1)), lambda x: NOT regexp_matches(x[2], {_q(C.PRIVATE_IP)}))[1][1], 50) FROM {lines}
             WHERE len(list_filter(regexp_extract_all(line, {_q('(?i)' + ip[5])}, 1), lambda x: NOT regexp_matches(x, {_q(C.PRIVATE_IP)}))) > 0
             UNION ALL SELECT doc_id, number, {_q(http[0])}, {_q(http[1])}, {_q(http[2])}, left(regexp_extract(line, {_q('(?i)' + http[5])}), 50) FROM {lines}
             WHERE len(list_filter(regexp_extract_all(regexp_extract(line, {_q(verb)}, 1), '(?i)https?://([^/\\s]*)', 1), lambda x: NOT regexp_matches(x, {_q('(?i)' + C.ALLOWED_HOSTS)}))) > 0)"""


def sql_chains(lines: str = "code", number: str = "line_no") -> str:
    """chains: the windows of lines that, as one text, have all expressions of a chain."""
    parts = []
    for name, category, severity, _, w, patterns in C.CHAINS:
        ok = " AND ".join(f"regexp_matches(near, {_q('(?i)' + p)})" for p in patterns)
        parts.append(f"SELECT doc_id, {number}, line, {_q(name)} AS rule_id, {_q(category)} AS category, {_q(severity)} AS severity FROM (SELECT *, string_agg(line, chr(10)) OVER (PARTITION BY doc_id ORDER BY {number} ROWS BETWEEN CURRENT ROW AND {w - 1} FOLLOWING) AS near FROM {lines}) WHERE {ok}")
    return "chains AS (" + " UNION ALL ".join(parts) + ")"


def _hits(spark, sf_dir, keep=("doc_id", "source", "lang", "line_no")):
    return rules.scan_lines(B.code_lines(spark, sf_dir), keep)


def _chains(spark, sf_dir):
    return rules.scan_chains(B.code_lines(spark, sf_dir), ("doc_id",), "line_no", ("doc_id", "line_no"))


# --- lines, rules ------------------------------------------------------------------------------------
@query(f"WITH {B.SQL_LINES} SELECT doc_id, count(*) AS n_lines, sum(length(line))::BIGINT AS n_chars, max(line_no)::BIGINT AS last_line FROM lines GROUP BY doc_id")
def q_lines(spark, sf_dir):
    return B.doc_lines(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"), F.max("line_no").cast("long").alias("last_line"))


@query(f"""WITH {B.sql_code()} SELECT doc_id AS file_id, line_no + 3 AS seq, doc_id % 50 + 1 + line_no - 1 - (SELECT count(*) FROM range(1, line_no + 1) t(i) WHERE i % 4 <> 0 AND i % 5 = 0) AS line_number, line
           FROM code WHERE NOT (line_no % 4 = 0 OR line_no % 5 = 0)""")
def q_added_lines(spark, sf_dir):
    return lines.added_lines(B.code_diffs(spark, sf_dir)).select("file_id", F.col("seq").cast("long").alias("seq"), "line_number", "line")


@query(f"WITH {B.sql_code()}, {sql_hits()} SELECT rule_id, severity, count(*) AS n_lines, count(DISTINCT doc_id) AS n_files FROM hits GROUP BY ALL")
def q_rule_scan_native(spark, sf_dir):
    return _hits(spark, sf_dir).groupBy("rule_id", "severity").agg(F.count("*").alias("n_lines"), F.countDistinct("doc_id").alias("n_files"))


@query(r"""WITH """ + B.SQL_LINES + r""", ips AS (SELECT doc_id, unnest(regexp_extract_all(line, '\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}')) AS ip FROM lines)
           SELECT ip, count(*) AS n, count(DISTINCT doc_id) AS n_files FROM ips WHERE NOT regexp_matches(ip, '""" + C.PRIVATE_IP + """') GROUP BY ip""")
def q_rule_public_ip(spark, sf_dir):
    ips = B.doc_lines(spark, sf_dir).select("doc_id", F.explode(F.regexp_extract_all("line", F.lit(r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}"), F.lit(0))).alias("ip"))
    return ips.where(~F.col("ip").rlike(C.PRIVATE_IP)).groupBy("ip").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_files"))


@query(r"WITH " + B.SQL_LINES + r""" SELECT doc_id, line_no, strpos(line, regexp_extract(line, '[0-9]{4,}'))::INTEGER AS place, left(line, 50) AS evidence FROM lines WHERE regexp_matches(line, '[0-9]{4,}')""")
def q_rule_first_offset(spark, sf_dir):
    found = B.doc_lines(spark, sf_dir).where(F.col("line").rlike("[0-9]{4,}"))
    return found.select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.expr("locate(regexp_extract(line, '[0-9]{4,}', 0), line)").alias("place"), F.left("line", F.lit(50)).alias("evidence"))


@query(f"WITH {B.sql_code()}, {sql_chains()} SELECT doc_id, line_no, rule_id, severity, left(line, 50) AS evidence FROM chains")
def q_chain_window(spark, sf_dir):
    return _chains(spark, sf_dir).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "rule_id", "severity", "evidence")


@query(f"""WITH {B.sql_code()}, numbered AS (SELECT doc_id, line_no AS number, line FROM code), {sql_texts("numbered")}, {sql_chains()},
    both_ AS (SELECT doc_id, line_number AS line_no, rule_id, category, severity, evidence, false AS is_chain FROM text_hits UNION ALL SELECT doc_id, line_no, rule_id, category, severity, left(line, 50), true FROM chains),
    c AS (SELECT *, {SEV} AS rank, bool_or(is_chain AND severity = 'CRITICAL') OVER (PARTITION BY doc_id, category) AS covered FROM both_),
    k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, rule_id, line_no ORDER BY rank DESC, is_chain DESC, evidence) AS n FROM c WHERE is_chain OR NOT covered OR severity NOT IN ('LOW', 'MEDIUM'))
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY rank DESC, line_no, is_chain DESC, rule_id)::INTEGER AS position, rule_id, severity, line_no AS line_number, is_chain, evidence FROM k WHERE n = 1""")
def q_scan_merge(spark, sf_dir):
    """Rules and chains over each file's lines, gathered once."""
    files = rules.joined(B.code_lines(spark, sf_dir), ("doc_id",), "line_no", "line_no")
    return rules.merge_matches(rules.text_matches(files, ("doc_id",)), rules.chain_matches(files, ("doc_id",)), ("doc_id",)).select("doc_id", "position", "rule_id", "severity", "line_number", "is_chain", "evidence")


@query(f"""WITH {B.sql_code()}, t AS (SELECT doc_id, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS s FROM code)
    SELECT doc_id, count(*) AS n_lines, avg((s = '' OR s LIKE '#%' OR s LIKE '\"\"\"%' OR s LIKE '''''''%' OR regexp_matches(s, '^version\\s*=') OR s LIKE '\\_\\_version\\_\\_%' ESCAPE '\\')::INT) > 0.9 AS likely_benign FROM t GROUP BY doc_id""")
def q_likely_benign(spark, sf_dir):
    return lines.likely_benign(B.code_lines(spark, sf_dir), ("doc_id",))


SQL_ADDED = "added AS (SELECT doc_id, doc_id % 50 + 1 + line_no - 1 - (SELECT count(*) FROM range(1, line_no + 1) t(i) WHERE i % 4 <> 0 AND i % 5 = 0) AS number, line FROM code WHERE NOT (line_no % 4 = 0 OR line_no % 5 = 0))"


@query(f"WITH {B.sql_code()}, {SQL_ADDED}, {sql_texts('added')} SELECT doc_id AS file_id, line_number, rule_id, category, severity, evidence FROM text_hits")
def q_exact_matches(spark, sf_dir):
    """All rules over the added lines of each diff as one text: matches may go over line ends."""
    return rules.text_matches(lines.added_files(B.code_diffs(spark, sf_dir)), ("file_id",)).drop("cwe")


# Two versions of each document's statements, all lines different: some are dropped, some replaced, one is added at the end.
SQL_VERSIONS = """old AS (SELECT doc_id, line_no, line_no || ': ' || line AS line FROM code),
    new AS (SELECT doc_id, line_no, CASE WHEN line_no % 7 = 3 THEN line_no || ' new ' || line ELSE line_no || ': ' || line END AS line, line_no % 7 = 3 AS is_added FROM code WHERE line_no % 11 <> 5
            UNION ALL SELECT doc_id, 1000000000, 'os.system\n(x)', true FROM documents),
    added AS (SELECT * FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no, part) AS number, line, is_added FROM (SELECT doc_id, line_no, is_added, unnest(string_split(line, chr(10))) AS line, unnest(generate_series(1, len(string_split(line, chr(10))))) AS part FROM new)) WHERE is_added)""".replace("'os.system\n(x)'", "'os.system' || chr(10) || '(x)'")


def _versions(spark, sf_dir):
    """Old and new files (release_id, path, content, is_binary, doc_id) of SQL_VERSIONS."""
    c = B.code_lines(spark, sf_dir)
    text = lambda when, line: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("line_no", line.alias("line"))))), lambda x: x["line"]), "\n")
    n, plain = F.col("line_no").cast("string"), F.concat(F.col("line_no").cast("string"), F.lit(": "), "line")
    changed = F.when(F.col("line_no") % 7 == 3, F.concat(n, F.lit(" new "), "line")).otherwise(plain)
    both = c.groupBy("doc_id").agg(text(F.lit(True), plain).alias("old"), text(F.col("line_no") % 11 != 5, changed).alias("new"))
    both = B.documents(spark, sf_dir).select("doc_id").join(both, "doc_id", "left")
    end = F.lit("os.system\n(x)")
    side = lambda c: both.select(F.col("doc_id").alias("release_id"), F.lit("pkg/m.py").alias("path"), c.alias("content"), F.lit(False).alias("is_binary"))
    return side(F.when(F.coalesce("old", F.lit("")) == "", "").otherwise(F.concat("old", F.lit("\n")))), side(F.when(F.coalesce("new", F.lit("")) == "", end).otherwise(F.concat("new", F.lit("\n"), end)))


@query(f"""WITH {B.sql_code()}, {SQL_VERSIONS}, d AS (SELECT doc_id, count(*) FILTER (line_no % 11 = 5 OR line_no % 7 = 3) AS n FROM code GROUP BY doc_id)
    SELECT doc_id AS release_id, 1::BIGINT AS files_changed, count(*) AS lines_added, coalesce(any_value(d.n), 0)::BIGINT AS lines_removed FROM added LEFT JOIN d USING (doc_id) GROUP BY doc_id""")
def q_unified_diff(spark, sf_dir):
    """Files of two versions to unified diffs to counts."""
    return lines.diff_stats(*_versions(spark, sf_dir)).select("release_id", "files_changed", "lines_added", "lines_removed")


@query(f"WITH {B.sql_code()}, {SQL_VERSIONS}, {sql_texts('added')} SELECT doc_id AS release_id, line_number, rule_id, severity, evidence FROM text_hits")
def q_diff_scan(spark, sf_dir):
    """Files of two versions to unified diffs to added lines to matches, nothing gathered on the way."""
    diffs = lines.unified_diffs(*_versions(spark, sf_dir))
    return rules.text_matches(lines.added_files(diffs, "content", ("release_id",)), ("release_id",)).select("release_id", "line_number", "rule_id", "severity", "evidence")


@query(f"""WITH {B.sql_code()}, {SQL_ADDED},
    said AS (SELECT a.doc_id, a.number, a.line, unnest(string_split(regexp_replace(a.line, '^import ', ''), ', ')) AS module FROM added a WHERE a.line LIKE 'import %'
             UNION ALL SELECT doc_id, number, line, 'subprocess' FROM added WHERE line LIKE 'from subprocess import %'),
    judged AS (SELECT doc_id, number, module, CASE WHEN line LIKE 'from %' THEN array_to_string(list_sort(string_split(regexp_replace(line, '^from subprocess import ', ''), ', ')), ',') ELSE '' END AS names,
               CASE WHEN module IN ({', '.join(_q(m) for m in C.CRITICAL_MODULES)}) THEN 'CRITICAL' WHEN module IN ({', '.join(_q(m) for m in C.HIGH_MODULES)}) THEN 'HIGH' WHEN module IN ({', '.join(_q(m) for m in C.MEDIUM_MODULES)}) THEN 'MEDIUM' END AS severity FROM said)
    SELECT doc_id AS file_id, module, names, severity, number AS line_number FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, module ORDER BY number) AS n FROM judged WHERE severity IS NOT NULL) WHERE n = 1""")
def q_import_signals(spark, sf_dir):
    return imports.import_signals(lines.added_lines(B.code_diffs(spark, sf_dir)), ("file_id",))


@query()
def q_syntax_findings(spark, sf_dir):
    return syntax.syntax_findings(lines.added_lines(B.code_diffs(spark, sf_dir)), "file_id")


_WORDS = _q("(?i)" + "|".join(C.DECODED_WORDS))
_HAS = lambda words: "(" + " OR ".join(f"contains(lower(line), {_q(w)})" for w in words) + ")"


@query(f"""WITH {B.sql_code()}, m AS (SELECT doc_id, line_no, line, CASE WHEN line_no % 5 = 4 THEN 'rot13' WHEN line_no % 3 = 0 THEN 'base64' ELSE 'hex' END AS encoding FROM code),
    e AS (SELECT *, CASE encoding WHEN 'rot13' THEN translate(line, 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ', 'nopqrstuvwxyzabcdefghijklmNOPQRSTUVWXYZABCDEFGHIJKLM') WHEN 'base64' THEN to_base64(encode(line)) ELSE lower(hex(encode(line))) END AS encoded FROM m),
    h AS (SELECT *, row_number() OVER (PARTITION BY doc_id, encoding, encoded, CASE WHEN encoding = 'rot13' THEN line_no END ORDER BY line_no) AS n FROM e
          WHERE regexp_matches(line, {_WORDS}) AND CASE encoding WHEN 'rot13' THEN length(line) > 10 WHEN 'base64' THEN length(rtrim(encoded, '=')) >= 20 ELSE length(encoded) >= 16 END)
    SELECT doc_id, line_no AS line_number, encoding, left(encoded, 50) AS encoded, left(line, 200) AS decoded,
    CASE WHEN encoding = 'base64' AND {_HAS(C.BASE64_CRITICAL)} OR encoding = 'hex' AND {_HAS(C.HEX_CRITICAL)} THEN 'CRITICAL' ELSE 'HIGH' END AS severity, len(regexp_extract_all(line, {_WORDS}))::BIGINT AS n_words FROM h WHERE n = 1""")
def q_decode_scan(spark, sf_dir):
    """Lines of code that Spark encodes, as literals of a program, found and decoded again."""
    c = B.code_lines(spark, sf_dir)
    coded = F.when(F.col("line_no") % 3 == 0, F.base64(F.encode("line", "utf-8"))).otherwise(F.lower(F.hex(F.encode("line", "utf-8"))))
    made = F.when(F.col("line_no") % 5 == 4, T.rot13(F.col("line"))).otherwise(F.concat(F.lit('p = "'), coded, F.lit('"')))
    return decode.decoded_payloads(c.select("doc_id", F.col("line_no").alias("seq"), F.col("line_no").cast("long").alias("line_number"), made.alias("line")), ("doc_id",))


# --- diffs, chunks ------------------------------------------------------------------------------------
SQL_PREV = "v AS (SELECT d.doc_id, o.doc_id AS old_id FROM documents d LEFT JOIN documents o ON o.doc_id = d.doc_id - 20)"


@query(f"""WITH {B.SQL_LINES}, {SQL_PREV}, n AS (SELECT v.doc_id, line, count(*) AS c FROM v JOIN lines USING (doc_id) WHERE old_id IS NOT NULL GROUP BY ALL),
    o AS (SELECT v.doc_id, line, count(*) AS c FROM v JOIN lines ON lines.doc_id = v.old_id GROUP BY ALL)
    SELECT doc_id, sum(greatest(coalesce(n.c, 0) - coalesce(o.c, 0), 0))::BIGINT AS lines_added, sum(greatest(coalesce(o.c, 0) - coalesce(n.c, 0), 0))::BIGINT AS lines_removed
    FROM n FULL JOIN o USING (doc_id, line) WHERE coalesce(n.c, 0) <> coalesce(o.c, 0) GROUP BY doc_id""")
def q_linediff(spark, sf_dir):
    """Each document against the one twenty numbers before, the older version."""
    ln, ids = B.doc_lines(spark, sf_dir).select("doc_id", "line"), B.documents(spark, sf_dir).select("doc_id")
    old_ids, new_ids = ids.select((F.col("doc_id") + 20).alias("doc_id")), ids
    new = ln.join(old_ids, "doc_id", "left_semi")
    old = ln.withColumn("doc_id", F.col("doc_id") + 20).join(new_ids, "doc_id", "left_semi")
    return lines.line_diff(old, new, ("doc_id",)).groupBy("doc_id").agg(F.sum("added").alias("lines_added"), F.sum("removed").alias("lines_removed"))


@query("""WITH d AS (SELECT 'r' || doc_id // 1000 AS release_id, lpad((doc_id // 2)::VARCHAR, 12, '0') AS path, doc_id, coalesce(text, '') AS content FROM documents),
    o AS (SELECT * FROM d WHERE doc_id % 2 = 0 AND doc_id % 14 <> 0), n AS (SELECT * FROM d WHERE doc_id % 2 = 1 AND doc_id % 22 <> 1)
    SELECT release_id, count(*) AS files_changed, count(*) FILTER (o.doc_id IS NULL) AS n_new, count(*) FILTER (n.doc_id IS NULL) AS n_deleted, string_agg(path, ',' ORDER BY path) FILTER (o.doc_id IS NULL) AS new_files
    FROM o FULL JOIN n USING (release_id, path) WHERE o.content IS DISTINCT FROM n.content GROUP BY release_id""")
def q_file_diff(spark, sf_dir):
    """Each document is a file; the next one is its new version."""
    d = B.documents(spark, sf_dir).select(F.concat(F.lit("r"), F.floor(F.col("doc_id") / 1000).cast("string")).alias("release_id"), F.lpad(F.floor(F.col("doc_id") / 2).cast("string"), 12, "0").alias("path"), F.coalesce("text", F.lit("")).alias("content"), F.lit(False).alias("is_binary"), "doc_id")
    s = lines.diff_stats(d.where("doc_id % 2 = 0 and doc_id % 14 <> 0"), d.where("doc_id % 2 = 1 and doc_id % 22 <> 1"))
    return s.select("release_id", "files_changed", F.size("new_files").cast("long").alias("n_new"), F.size("deleted_files").cast("long").alias("n_deleted"), F.nullif(F.array_join("new_files", ","), F.lit("")).alias("new_files"))


_SQL_SIDES = """v AS (SELECT source || '/' || doc_id // 1000 AS release_id, lang || '/' || doc_id AS path, doc_id, coalesce(text, '') AS text FROM documents),
    o AS (SELECT release_id, path, text AS content FROM v WHERE doc_id % 10 <> 3), n AS (SELECT release_id, path, CASE WHEN doc_id % 3 = 0 THEN text || '\n# ' || doc_id ELSE text END AS content FROM v WHERE doc_id % 10 <> 7)"""


@query(f"""WITH {_SQL_SIDES} SELECT release_id, count(*) AS files_changed, count(*) FILTER (o.content IS NULL) AS n_new, count(*) FILTER (n.content IS NULL) AS n_deleted, string_agg(path, ',' ORDER BY path) FILTER (o.content IS NULL) AS new_files
    FROM o FULL JOIN n USING (release_id, path) WHERE o.content IS DISTINCT FROM n.content GROUP BY release_id""")
def q_file_diff_whole(spark, sf_dir):
    """q_file_diff with every document as a file of its own: files, releases and compared lines grow with the table."""
    c = F.coalesce("text", F.lit(""))
    d = B.documents(spark, sf_dir).select(F.concat_ws("/", "source", F.floor(F.col("doc_id") / 1000).cast("string")).alias("release_id"), F.concat_ws("/", "lang", F.col("doc_id").cast("string")).alias("path"), c.alias("content"), F.lit(False).alias("is_binary"), "doc_id")
    changed = F.when(F.col("doc_id") % 3 == 0, F.concat("content", F.lit("\n# "), F.col("doc_id").cast("string"))).otherwise(F.col("content"))
    s = lines.diff_stats(d.where("doc_id % 10 <> 3"), d.where("doc_id % 10 <> 7").withColumn("content", changed))
    return s.select("release_id", "files_changed", F.size("new_files").cast("long").alias("n_new"), F.size("deleted_files").cast("long").alias("n_deleted"), F.nullif(F.array_join("new_files", ","), F.lit("")).alias("new_files"))


@query("""SELECT l_orderkey, sum(l_quantity)::BIGINT AS added, (sum(l_linenumber) - 1)::BIGINT AS removed,
    concat_ws(',', CASE WHEN sum(l_linenumber) - 1 > 0 AND sum(l_quantity) > 5 * (sum(l_linenumber) - 1) AND sum(l_quantity) > 50 THEN 'LARGE_ADDITION' END, CASE WHEN sum(l_linenumber) - 1 = 0 AND sum(l_quantity) > 100 THEN 'PURE_ADDITION' END) AS signals FROM lineitem GROUP BY l_orderkey""")
def q_diff_stats_signals(spark, sf_dir):
    none = F.array().cast("array<string>")
    g = B.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").cast("long").alias("added"), (F.sum("l_linenumber") - 1).cast("long").alias("removed"))
    return g.select("*", signals.ids(signals.diff_signals(F.col("added"), F.col("removed"), none, none, none)).alias("signals"))


@query("""WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*/', ''), '[?#].*$', '') AS path FROM pages), f AS (SELECT *, regexp_extract(path, '[^/]*$') AS base, string_split(path, '/') AS parts FROM p)
    SELECT page_id, path, list_has_any(parts[:len(parts) - 1], ['docs', 'examples', '*.dist-info', '*.egg-info']) OR regexp_matches(base, '^(test_.*\\.py|.*_test\\.py|.*\\.test\\.js|.*\\.spec\\.js|CHANGELOG.*|.*\\.md|.*\\.rst|METADATA|RECORD|WHEEL)$') AS skipped, 18::INTEGER AS priority FROM f""")
def q_skip_priority(spark, sf_dir):
    p = B.table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(F.regexp_replace("url", "^[a-z]+://[^/]*/", ""), "[?#].*$", "").alias("path"))
    return p.select("page_id", "path", T.skipped(F.col("path")).alias("skipped"), T.priority(F.col("path")).alias("priority"))


@query("""WITH RECURSIVE f AS (SELECT conv_id, turn, greatest(1, length(coalesce(text, '')) // 4)::BIGINT AS tokens, row_number() OVER (PARTITION BY conv_id ORDER BY 't' || lpad(turn::VARCHAR, 6, '0')) AS n FROM conversations),
    s AS (SELECT conv_id, turn, tokens, n, tokens AS total, 0 AS chunk_index FROM f WHERE n = 1 UNION ALL
          SELECT f.conv_id, f.turn, f.tokens, f.n, CASE WHEN s.total + f.tokens > 200 THEN f.tokens ELSE s.total + f.tokens END, s.chunk_index + (s.total + f.tokens > 200)::INT FROM s JOIN f ON f.conv_id = s.conv_id AND f.n = s.n + 1)
    SELECT conv_id, 't' || lpad(turn::VARCHAR, 6, '0') AS path, tokens, chunk_index::INTEGER AS chunk_index FROM s""")
def q_chunk_pack(spark, sf_dir):
    c = B.table(spark, sf_dir, "conversations").select("conv_id", F.concat(F.lit("t"), F.lpad(F.col("turn").cast("string"), 6, "0")).alias("path"), F.col("text").alias("content"))
    return chunks.chunk_files(c, "conv_id", 200)


# --- feeds, watchlists ---------------------------------------------------------------------------------
def _log(spark, sf_dir):
    e = B.table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("serial"), F.col("user_id").cast("string").alias("name"), F.when(F.col("event_type") == "signup", "new release").otherwise(F.col("event_type")).alias("action"),
                    F.coalesce(F.get_json_object("props", "$.k"), F.lit("")).alias("version"), F.col("ts").cast("timestamp").alias("ts"), "value")


SQL_LOG = "log AS (SELECT event_id AS serial, user_id::VARCHAR AS name, CASE event_type WHEN 'signup' THEN 'new release' ELSE event_type END AS action, coalesce(json_extract_string(props, '$.k'), '') AS version, ts, value FROM events)"
SQL_TOP = "top AS (SELECT name, count(*) AS uses FROM log GROUP BY name ORDER BY uses DESC, name LIMIT 20)"


def _top(spark, sf_dir):
    return feeds.top_packages(_log(spark, sf_dir).groupBy("name").agg(F.count("*").alias("uses")), 20)


@query(f"WITH {SQL_LOG}, {SQL_TOP}, w AS (SELECT name FROM top UNION SELECT name FROM log WHERE action = 'purchase' AND value > 300) SELECT action, count(*) AS n, max(serial) AS last FROM log WHERE name IN (SELECT name FROM w) GROUP BY action")
def q_watchlist_semi(spark, sf_dir):
    log = _log(spark, sf_dir).withColumn("ecosystem", F.lit("pypi"))
    eco = F.lit("pypi").alias("ecosystem")
    watch = tenants.merged_watchlist(_top(spark, sf_dir).select(eco, "name"), log.where("action = 'purchase' and value > 300").select(eco, "name"))
    return tenants.watched(log, watch).groupBy("action").agg(F.count("*").alias("n"), F.max("serial").alias("last"))


@query(f"""WITH {SQL_LOG}, a AS (SELECT DISTINCT name FROM log WHERE action = 'new release'), b AS (SELECT DISTINCT name FROM log WHERE action = 'purchase')
    SELECT 'both' AS part, count(*) AS n FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'only', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'any', count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)""")
def q_watchlist_setops(spark, sf_dir):
    log = _log(spark, sf_dir)
    a, b = (log.where(F.col("action") == x).select("name").distinct() for x in ("new release", "purchase"))
    one = lambda part, df: df.agg(F.count("*").alias("n")).select(F.lit(part).alias("part"), "n")
    return one("both", a.intersect(b)).unionByName(one("only", a.subtract(b))).unionByName(one("any", a.union(b).distinct()))


@query(f"WITH {SQL_LOG}, {SQL_TOP} SELECT name, version, min(serial) AS serial FROM log WHERE serial > 100 AND action = 'new release' AND name IN (SELECT name FROM top) GROUP BY ALL")
def q_new_releases(spark, sf_dir):
    return feeds.new_from_log(_log(spark, sf_dir), _top(spark, sf_dir), 100)


@query("SELECT greatest(max(event_id), 100) AS \"cursor\" FROM events")
def q_next_cursor(spark, sf_dir):
    return feeds.next_cursor(_log(spark, sf_dir), 100)


@query(f"WITH {SQL_LOG} SELECT name, version AS latest, previous, serial AS seq FROM (SELECT *, lag(version) OVER (PARTITION BY name ORDER BY serial) AS previous FROM log) WHERE previous <> version")
def q_latest_changed(spark, sf_dir):
    feed = _log(spark, sf_dir).select("name", F.col("version").alias("latest"), F.col("serial").alias("seq"))
    return feeds.latest_changes(feed).select("name", "latest", "previous", "seq")


@query("""WITH o AS (SELECT o_custkey::VARCHAR AS name, o_orderkey, o_orderdate AS ts, lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev FROM orders)
    SELECT o_orderkey, name, floor((epoch_us(ts) - epoch_us(prev)) / 86400000000.0)::BIGINT AS gap_days,
    CASE WHEN floor((epoch_us(ts) - epoch_us(prev)) / 86400000000.0) > 365 THEN 'LONG_DORMANCY' WHEN floor((epoch_us(ts) - epoch_us(prev)) / 86400000000.0) > 180 THEN 'MEDIUM_DORMANCY' ELSE '' END AS signals FROM o WHERE prev IS NOT NULL""")
def q_dormancy(spark, sf_dir):
    o = B.table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("name"), "o_orderkey", F.col("o_orderdate").cast("timestamp").alias("ts"))
    p = signals.with_previous(o, ("name",), ["ts", "o_orderkey"], "ts").where("prev_ts is not null")
    return p.select("o_orderkey", "name", T.gap_days(F.col("prev_ts"), F.col("ts")).alias("gap_days"), signals.ids(signals.dormancy(F.col("name"), F.col("prev_ts"), F.col("ts"))).alias("signals"))


@query("""WITH m AS (SELECT l_partkey AS name, year(l_shipdate) AS version, list_sort(list_distinct(list(l_suppkey))) AS s FROM lineitem GROUP BY ALL), p AS (SELECT *, lag(s) OVER (PARTITION BY name ORDER BY version) AS old FROM m)
    SELECT name, version::INTEGER AS version, array_to_string(list_sort(list_filter(s, lambda x: NOT list_contains(old, x))), ',') AS joined, array_to_string(list_sort(list_filter(old, lambda x: NOT list_contains(s, x))), ',') AS \"left\",
    CASE WHEN s <> old THEN 'MAINTAINER_CHANGE' ELSE '' END AS signals FROM p WHERE old IS NOT NULL""")
def q_maintainer_change(spark, sf_dir):
    m = B.table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("name"), F.year("l_shipdate").alias("version")).agg(F.array_sort(F.collect_set("l_suppkey")).alias("s"))
    p = signals.with_previous(m, ("name",), ["version"], "s").where("prev_s is not null")
    text = lambda a, b: F.array_join(F.array_sort(F.array_except(a, b)), ",")
    return p.select("name", "version", text(F.col("s"), F.col("prev_s")).alias("joined"), text(F.col("prev_s"), F.col("s")).alias("left"), signals.ids(signals.maintainer_change(F.col("prev_s"), F.col("s"))).alias("signals"))


@query("""WITH d AS (SELECT o_custkey, o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS old FROM orders)
    SELECT d.o_orderkey, count(DISTINCT l_partkey) AS n_new, min(l_partkey) AS first_new FROM d JOIN lineitem l ON l.l_orderkey = d.o_orderkey WHERE old IS NOT NULL AND NOT EXISTS (SELECT 1 FROM lineitem o WHERE o.l_orderkey = d.old AND o.l_partkey = l.l_partkey) GROUP BY d.o_orderkey""")
def q_new_deps(spark, sf_dir):
    o = B.table(spark, sf_dir, "orders").select("o_orderkey", F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("old")).where("old is not null")
    li = B.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    new = o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "old", "l_partkey")
    gone = li.select(F.col("l_orderkey").alias("old"), "l_partkey").distinct()
    return new.join(gone, ["old", "l_partkey"], "left_anti").groupBy("o_orderkey").agg(F.countDistinct("l_partkey").alias("n_new"), F.min("l_partkey").alias("first_new"))


# --- scores --------------------------------------------------------------------------------------------
@query("""WITH u AS (SELECT l_partkey, count(*) AS weekly, count(DISTINCT l_suppkey) AS versions FROM lineitem GROUP BY ALL), m AS (SELECT p_partkey, p_size * 3 AS age, weekly, versions, CASE WHEN p_partkey % 3 = 0 THEN p_retailprice * 20 END AS parent FROM part LEFT JOIN u ON l_partkey = p_partkey),
    s AS (SELECT *, CASE WHEN age < 7 THEN 40 WHEN age < 30 THEN 25 WHEN age < 90 THEN 10 ELSE 0 END + CASE WHEN weekly < 100 THEN 30 WHEN weekly < 1000 THEN 15 ELSE 0 END + CASE WHEN versions = 1 THEN 20 ELSE 0 END
          + CASE WHEN coalesce(parent, 0) <> 0 AND weekly = 0 THEN 40 WHEN coalesce(parent, 0) <> 0 AND parent / weekly > 10000 THEN 35 WHEN coalesce(parent, 0) <> 0 AND parent / weekly > 1000 THEN 20 ELSE 0 END AS score FROM m)
    SELECT p_partkey, score::INTEGER AS score, CASE WHEN score >= 60 THEN 'CRITICAL' WHEN score >= 35 THEN 'HIGH' WHEN score >= 15 THEN 'MEDIUM' WHEN score >= 1 THEN 'LOW' ELSE 'NONE' END AS severity,
    CASE WHEN score >= 60 THEN 0.30 WHEN score >= 35 THEN 0.20 WHEN score >= 15 THEN 0.10 WHEN score >= 1 THEN 0.05 ELSE 0.0 END::DOUBLE AS boost FROM s""")
def q_reputation_score(spark, sf_dir):
    u = B.table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("weekly"), F.countDistinct("l_suppkey").alias("versions"))
    p = B.table(spark, sf_dir, "part").join(u, F.col("p_partkey") == F.col("l_partkey"), "left")
    score = signals.reputation_score(F.col("p_size") * 3, F.col("weekly"), F.col("versions"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_retailprice") * 20))
    severity, boost = signals.reputation_level(F.col("score"))
    return p.withColumn("score", score).select("p_partkey", "score", severity.alias("severity"), boost.alias("boost"))


@query("""SELECT l_orderkey, count(*) AS n_deps, (min(l_linenumber) - 1 + count(*) - 1)::BIGINT AS total, concat_ws(',', CASE WHEN min(l_linenumber) + count(*) - 2 = 0 THEN 'MANIFEST_ONLY_NEW_DEP' END, CASE WHEN count(*) >= 3 THEN 'MANY_NEW_DEPS_AT_ONCE' END, CASE WHEN min(l_linenumber) + count(*) - 2 BETWEEN 1 AND 5 THEN 'ZERO_CODE_CHANGE_WITH_NEW_DEP' END) AS signals FROM lineitem GROUP BY l_orderkey""")
def q_manifest_only(spark, sf_dir):
    g = B.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n_deps"), (F.min("l_linenumber") + F.count("*") - 2).cast("long").alias("total"))
    return g.select("*", signals.ids(signals.manifest_signals(F.col("n_deps"), F.col("total"), F.lit(0))).alias("signals"))


KB = "kb AS (SELECT 'part' || p_partkey AS name, CASE p_partkey % 3 WHEN 0 THEN 'R' WHEN 1 THEN 'A' ELSE 'N' END AS version, p_brand AS ecosystem, CASE WHEN p_partkey % 34 = 0 THEN 'SUSPICIOUS' ELSE 'MALICIOUS' END AS verdict, CASE WHEN p_partkey % 34 = 0 THEN 'HIGH' ELSE 'CRITICAL' END AS severity FROM part WHERE p_partkey % 17 = 0)"
COMP = "comp AS (SELECT l_orderkey AS sbom_id, 'part' || l_partkey AS name, l_returnflag AS version, p_brand AS ecosystem FROM lineitem JOIN part ON p_partkey = l_partkey)"


def _known_bad(spark, sf_dir):
    p = B.table(spark, sf_dir, "part").where("p_partkey % 17 = 0")
    k = F.col("p_partkey")
    return p.select(F.concat(F.lit("part"), k.cast("string")).alias("name"), F.when(k % 3 == 0, "R").when(k % 3 == 1, "A").otherwise("N").alias("version"), F.col("p_brand").alias("ecosystem"),
                    F.when(k % 34 == 0, "SUSPICIOUS").otherwise("MALICIOUS").alias("verdict"), F.when(k % 34 == 0, "HIGH").otherwise("CRITICAL").alias("severity"))


def _components(spark, sf_dir, sign=""):
    li, p = B.table(spark, sf_dir, "lineitem"), B.table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return li.join(p, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("sbom_id"), F.concat(F.lit("part"), F.col("l_partkey").cast("string")).alias("name"), F.concat(F.lit(sign), F.col("l_returnflag")).alias("version"), F.col("p_brand").alias("ecosystem"), "l_linestatus", "l_suppkey")


@query(f"WITH {KB}, {COMP} SELECT c.name, c.ecosystem, k.verdict AS kb_verdict, k.severity AS kb_severity, count(*) AS n FROM comp c JOIN kb k USING (name, version, ecosystem) GROUP BY ALL")
def q_known_bad_join(spark, sf_dir):
    hits = tenants.known_bad_hits(_components(spark, sf_dir, "^"), _known_bad(spark, sf_dir))
    return hits.groupBy("name", "ecosystem", "kb_verdict", "kb_severity").agg(F.count("*").alias("n"))


@query(f"""WITH {KB}, {COMP}, adv AS (SELECT name, version, ecosystem, 'A' || name AS advisory_id FROM kb WHERE version <> 'N')
    SELECT sbom_id, count(*) AS components, count(k.name) AS local_hits, count(a.name) AS advisory_hits, count(k.name) + count(a.name) AS issues FROM comp c LEFT JOIN kb k USING (name, version, ecosystem) LEFT JOIN adv a USING (name, version, ecosystem) GROUP BY sbom_id""")
def q_sbom_validate(spark, sf_dir):
    kb = _known_bad(spark, sf_dir)
    adv = kb.where("version <> 'N'").select("name", "version", "ecosystem", F.concat(F.lit("A"), "name").alias("advisory_id"))
    return tenants.validate_sbom(_components(spark, sf_dir), kb, adv)


TP = "tp AS (SELECT DISTINCT o_custkey AS tenant_id, ecosystem, name, CASE WHEN o_custkey % 4 = 0 THEN '' ELSE version END AS version FROM comp JOIN orders ON o_orderkey = sbom_id)"


def _tenant_packages(spark, sf_dir):
    o = B.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = _components(spark, sf_dir).join(o, F.col("sbom_id") == F.col("o_orderkey"))
    return c.select(F.col("o_custkey").alias("tenant_id"), "ecosystem", "name", F.when(F.col("o_custkey") % 4 == 0, "").otherwise(F.col("version")).alias("version"), "l_linestatus", "l_suppkey")


@query(f"WITH {KB}, {COMP}, {TP} SELECT DISTINCT kb.name, kb.version, kb.ecosystem, tenant_id FROM kb JOIN tp ON tp.name = kb.name AND tp.ecosystem = kb.ecosystem AND (tp.version = '' OR tp.version = kb.version)")
def q_tenant_match(spark, sf_dir):
    kb = _known_bad(spark, sf_dir).select("name", "version", "ecosystem")
    return tenants.affected_tenants(kb, _tenant_packages(spark, sf_dir)).select("name", "version", "ecosystem", "tenant_id")


DEP = "dep AS (SELECT o_custkey AS tenant_id, ecosystem, name, l_linestatus = 'O' AS direct, l_suppkey AS target FROM (SELECT l_orderkey, l_suppkey, l_linestatus, 'part' || l_partkey AS name, p_brand AS ecosystem FROM lineitem JOIN part ON p_partkey = l_partkey) JOIN orders ON o_orderkey = l_orderkey)"


def _depends_on(spark, sf_dir):
    t = _tenant_packages(spark, sf_dir)
    return t.select("tenant_id", "ecosystem", "name", (F.col("l_linestatus") == "O").alias("direct"), F.col("l_suppkey").alias("target"))


@query(f"WITH {KB}, {COMP}, {TP}, {DEP}, hit AS (SELECT DISTINCT kb.name AS release_id, kb.name, kb.ecosystem, tenant_id FROM kb JOIN tp ON tp.name = kb.name AND tp.ecosystem = kb.ecosystem AND (tp.version = '' OR tp.version = kb.version)) SELECT release_id, tenant_id, count(*) FILTER (direct) AS direct, count(*) FILTER (NOT direct) AS indirect FROM hit JOIN dep USING (tenant_id, ecosystem, name) GROUP BY ALL")
def q_blast_radius(spark, sf_dir):
    hit = tenants.affected_tenants(_known_bad(spark, sf_dir).select("name", "version", "ecosystem"), _tenant_packages(spark, sf_dir)).select(F.col("name").alias("release_id"), "name", "ecosystem", "tenant_id").distinct()
    return tenants.blast_radius(hit, _depends_on(spark, sf_dir))


@query(f"WITH {KB}, {DEP} SELECT tenant_id, target, sum(CASE kb.severity WHEN 'CRITICAL' THEN CASE WHEN direct THEN 40 ELSE 20 END WHEN 'HIGH' THEN CASE WHEN direct THEN 25 ELSE 10 END END)::BIGINT AS risk FROM kb JOIN dep USING (ecosystem, name) GROUP BY ALL")
def q_risk_rollup(spark, sf_dir):
    return tenants.risk_scores(_known_bad(spark, sf_dir).select("ecosystem", "name", "severity").join(_depends_on(spark, sf_dir), ["ecosystem", "name"]))


# --- verdicts --------------------------------------------------------------------------------------------
CH = "ch AS (SELECT d.source, l.doc_id AS chunk_index, CASE WHEN toxic = 1 AND quality = 0 THEN 'MALICIOUS' WHEN toxic = 1 THEN 'SUSPICIOUS' WHEN quality = 1 THEN 'BENIGN' ELSE 'UNKNOWN' END AS verdict, CASE WHEN toxic = 1 AND quality = 0 THEN 'CRITICAL' WHEN toxic = 1 THEN 'HIGH' WHEN quality = 0 THEN 'MEDIUM' ELSE 'NONE' END AS severity, CASE WHEN l.doc_id % 5 = 0 THEN NULL ELSE (l.doc_id % 16) / 16.0 END AS confidence, toxic * (l.doc_id % 3) AS n_findings, 'chunk ' || l.doc_id AS summary, n_chars AS tokens_used FROM labels l JOIN documents d USING (doc_id))"
MERGED = f"""merged AS (SELECT source, CASE max(CASE verdict WHEN 'MALICIOUS' THEN 4 WHEN 'SUSPICIOUS' THEN 3 WHEN 'BENIGN' THEN 2 ELSE 1 END) WHEN 4 THEN 'MALICIOUS' WHEN 3 THEN 'SUSPICIOUS' WHEN 2 THEN 'BENIGN' ELSE 'UNKNOWN' END AS verdict, {NAMES.format(f'max({SEV})')} AS severity,
    CASE WHEN sum(n_findings) = 0 THEN avg(coalesce(confidence, 0.5)) ELSE sum(coalesce(confidence, 0.5) * n_findings) / sum(n_findings) END AS confidence, arg_max(summary, ({SEV})::BIGINT * 1000000000000 - chunk_index) AS summary, count(*) AS n_chunks, sum(tokens_used)::BIGINT AS tokens FROM ch GROUP BY source)"""


def _chunk_verdicts(spark, sf_dir):
    d = B.documents(spark, sf_dir).select("doc_id", "source", "n_chars")
    x, q, i = F.col("toxic"), F.col("quality"), F.col("doc_id")
    return B.table(spark, sf_dir, "labels").join(d, "doc_id").select(
        "source", i.alias("chunk_index"), F.when((x == 1) & (q == 0), "MALICIOUS").when(x == 1, "SUSPICIOUS").when(q == 1, "BENIGN").otherwise("UNKNOWN").alias("verdict"),
        F.when((x == 1) & (q == 0), "CRITICAL").when(x == 1, "HIGH").when(q == 0, "MEDIUM").otherwise("NONE").alias("severity"), F.when(i % 5 != 0, (i % 16) / 16.0).alias("confidence"),
        (x * (i % 3)).alias("n_findings"), F.concat(F.lit("chunk "), i.cast("string")).alias("summary"), F.col("n_chars").alias("tokens_used"))


@query(f"WITH {CH}, {MERGED} SELECT source, verdict, severity, round(confidence, 9) AS confidence, summary, n_chunks, tokens FROM merged")
def q_verdict_merge(spark, sf_dir):
    return verdicts.merge_chunks(_chunk_verdicts(spark, sf_dir), ("source",)).withColumn("confidence", F.round("confidence", 9))


ESC = """esc AS (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'BENIGN' WHEN 1 THEN 'UNKNOWN' WHEN 2 THEN 'SUSPICIOUS' ELSE 'BENIGN' END AS verdict, CASE p_size % 3 WHEN 0 THEN 'NONE' WHEN 1 THEN 'LOW' ELSE 'HIGH' END AS severity, (p_partkey % 17) / 16.0::DOUBLE AS confidence, (p_partkey % 6)::INTEGER AS rule_rank, (p_size % 5) * 0.05::DOUBLE AS boost, p_size % 7 = 0 AS high FROM part),
    mid AS (SELECT *, CASE WHEN verdict = 'BENIGN' AND rule_rank >= 4 THEN 'MALICIOUS' WHEN verdict = 'BENIGN' AND rule_rank > 0 THEN 'SUSPICIOUS' ELSE verdict END AS after, least(1.0, confidence + boost) AS sure, greatest(CASE severity WHEN 'HIGH' THEN 4 WHEN 'LOW' THEN 2 ELSE 1 END, rule_rank) AS worst FROM esc)"""


@query(f"WITH {ESC} SELECT p_partkey, CASE WHEN rule_rank = 5 AND high THEN 'MALICIOUS' WHEN after = 'BENIGN' AND high AND NOT sure > 0.90 THEN 'SUSPICIOUS' ELSE after END AS verdict, {NAMES.format('worst')} AS severity, round_even(sure, 3)::DOUBLE AS confidence FROM mid")
def q_verdict_escalate(spark, sf_dir):
    p = B.table(spark, sf_dir, "part")
    s, k = F.col("p_size"), F.col("p_partkey")
    v = F.when(s % 4 == 0, "BENIGN").when(s % 4 == 1, "UNKNOWN").when(s % 4 == 2, "SUSPICIOUS").otherwise("BENIGN")
    out = verdicts.escalate(v, F.when(s % 3 == 0, "NONE").when(s % 3 == 1, "LOW").otherwise("HIGH"), (k % 17) / 16.0, (k % 6).cast("int"), (s % 5) * 0.05, s % 7 == 0)
    return p.select("p_partkey", *(c.alias(n) for c, n in zip(out, ("verdict", "severity", "confidence"))))


@query("""SELECT o_orderkey, CASE WHEN k % 23 = 0 THEN false WHEN k % 11 = 0 OR k % 13 = 0 OR k % 17 = 0 OR k % 19 = 0 OR k % 29 = 0 OR k % 31 = 0 THEN true WHEN k % 2 = 0 AND NOT k % 3 = 0 THEN false WHEN k % 5 = 0 THEN true WHEN k % 37 = 0 THEN true WHEN k % 7 = 0 THEN true WHEN k % 41 = 0 THEN true ELSE false END AS analyze,
    CASE WHEN k % 23 = 0 THEN 'no chunks' WHEN k % 11 = 0 THEN 'critical rule' WHEN k % 13 = 0 THEN 'critical import' WHEN k % 17 = 0 THEN 'known bad dependency' WHEN k % 19 = 0 THEN 'critical reputation' WHEN k % 29 = 0 THEN 'critical payload' WHEN k % 31 = 0 THEN 'critical syntax' WHEN k % 2 = 0 AND NOT k % 3 = 0 THEN 'likely benign' WHEN k % 5 = 0 THEN 'high severity match' WHEN k % 37 = 0 THEN 'triage failed' WHEN k % 7 = 0 THEN 'analyzer' WHEN k % 41 = 0 THEN 'binary or new files' ELSE 'nothing found' END AS reason FROM (SELECT o_orderkey, o_orderkey AS k FROM orders)""")
def q_triage_phase(spark, sf_dir):
    k = F.col("o_orderkey")
    d = lambda n: k % n == 0
    analyze, reason = verdicts.triage(~d(23), d(11), d(13), d(17), d(19), d(29), d(31), d(2), d(3), d(5), F.when(~d(37), d(7)), d(41))
    return B.table(spark, sf_dir, "orders").select("o_orderkey", analyze.alias("analyze"), reason.alias("reason"))


@query(f"""WITH {CH}, {MERGED}, b(backend, least) AS (VALUES ('console', 2), ('slack', 4), ('webhook', 5)), r AS (SELECT source, verdict, severity, backend, {SEV} AS rank, least FROM merged, b)
    SELECT source, verdict, severity, backend FROM r WHERE verdict <> 'BENIGN' AND rank >= least""")
def q_alert_route(spark, sf_dir):
    least = F.array(*(F.struct(F.lit(b).alias("backend"), F.lit(s).alias("least")) for b, s in (("console", "LOW"), ("slack", "HIGH"), ("webhook", "CRITICAL"))))
    v = verdicts.merge_chunks(_chunk_verdicts(spark, sf_dir), ("source",)).select("source", "verdict", "severity", F.inline(least))
    return v.where(verdicts.is_alert(F.col("verdict"), F.col("severity"), F.col("least"))).select("source", "verdict", "severity", "backend")


@query(f"WITH {SQL_LOG}, seen AS (SELECT DISTINCT name, version FROM log WHERE serial % 3 = 0) SELECT name, version, min(serial) AS serial FROM log WHERE action = 'new release' AND (name, version) NOT IN (SELECT name, version FROM seen) GROUP BY ALL")
def q_dedup_alerts(spark, sf_dir):
    log = _log(spark, sf_dir)
    seen = log.where("serial % 3 = 0").select("name", "version").distinct()
    return log.where("action = 'new release'").join(seen, ["name", "version"], "left_anti").groupBy("name", "version").agg(F.min("serial").alias("serial"))


@query(f"WITH {SQL_LOG} SELECT name, serial FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY serial DESC) AS n FROM log WHERE action = 'error') WHERE n <= 5")
def q_queue_retention(spark, sf_dir):
    return verdicts.last_per_key(_log(spark, sf_dir).where("action = 'error'"), ("name",), [F.desc("serial")], 5).select("name", "serial")


# --- functions -------------------------------------------------------------------------------------------
VER = "ver AS (SELECT p_brand, p_partkey, (p_partkey % 4) || '.' || p_size || '.' || p_partkey % 7 AS version, p_partkey % 4 AS a, p_size AS b, p_partkey % 7 AS c FROM part)"


@query(f"WITH {VER} SELECT p_partkey, version, lag(version) OVER (PARTITION BY p_brand, p_partkey // 1000 ORDER BY a, b, c, p_partkey) AS previous FROM ver")
def q_version_sort_semver(spark, sf_dir):
    k = F.col("p_partkey")
    v = B.table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.concat_ws(".", (k % 4).cast("string"), F.col("p_size").cast("string"), (k % 7).cast("string")).alias("version"))
    w = Window.partitionBy("p_brand", F.floor(F.col("p_partkey") / 1000)).orderBy("key", "p_partkey")  # groups of keys, so that they stay small
    return v.withColumn("key", T.semver_key(F.col("version"))).select("p_partkey", "version", F.lag("version").over(w).alias("previous"))


@query(r"""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'npm' WHEN page_id % 3 = 1 THEN 'go' ELSE 'maven' END AS ecosystem, CASE page_id % 3 WHEN 0 THEN '@' || host || '/p' || page_id WHEN 1 THEN host || '/p' || page_id ELSE host || ':p' || page_id END AS name, '1.' || page_id AS version
    FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host FROM pages)""")
def q_purl_parse(spark, sf_dir):
    p = B.table(spark, sf_dir, "pages")
    i, host = F.col("page_id"), F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1)
    made = F.when(i % 3 == 0, F.concat(F.lit("pkg:npm/%40"), host)).when(i % 3 == 1, F.concat(F.lit("pkg:golang/"), host)).otherwise(F.concat(F.lit("pkg:maven/"), host))
    got = T.purl(F.concat(made, F.lit("/p"), i.cast("string"), F.lit("@1."), i.cast("string"), F.lit("?type=jar#sub")))
    return p.select("page_id", *(c.alias(n) for n, c in got.items()))


@query("""SELECT event_id, CASE WHEN s >= 9 THEN 'CRITICAL' WHEN s >= 7 THEN 'HIGH' WHEN s >= 4 THEN 'MEDIUM' WHEN user_id % 2 = 0 THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM (SELECT *, CASE WHEN event_id % 5 <> 0 THEN round(value, 1) END AS s FROM events)""")
def q_osv_severity(spark, sf_dir):
    e = B.table(spark, sf_dir, "events")
    score = F.when(F.col("event_id") % 5 != 0, F.round("value", 1).cast("string")).otherwise("CVSS:3.1/AV:N")
    return e.select("event_id", tenants.advisory_severity(score, F.when(F.col("user_id") % 2 == 0, "MAL-1").otherwise("GHSA-1")).alias("severity"))


@query("SELECT event_type, count(*) AS n, sum(json_extract_string(props, '$.k')::BIGINT)::BIGINT AS total FROM events GROUP BY event_type")
def q_props_json(spark, sf_dir):
    e = B.table(spark, sf_dir, "events").select("event_type", F.from_json("props", "k bigint").alias("p"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("p.k").alias("total"))


@query("""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS link FROM pages) SELECT link, count(*) AS n, count(DISTINCT page_id) AS n_pages FROM l GROUP BY link""")
def q_html_links(spark, sf_dir):
    l = B.table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("link"))  # noqa: E741
    return l.groupBy("link").agg(F.count("*").alias("n"), F.countDistinct("page_id").alias("n_pages"))


@query("SELECT conv_id, turn, total FROM (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS total FROM conversations) WHERE total <= 600")
def q_token_budget(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return B.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sum(F.length("text")).over(w).alias("total")).where("total <= 600")


@query("SELECT lang AS ecosystem, count(*) AS releases, count(*) FILTER (n_chars % 7 = 0) AS malicious, count(*) FILTER (n_chars % 7 = 1) AS suspicious, avg(n_chars)::DOUBLE AS avg_ms, avg(n_chars / 4.0)::DOUBLE AS avg_tokens FROM documents GROUP BY ROLLUP (lang)")
def q_metrics_rollup(spark, sf_dir):
    from ..streaming.monitor import metrics

    n = F.col("n_chars")
    return metrics(B.documents(spark, sf_dir).select(F.col("lang").alias("ecosystem"), F.when(n % 7 == 0, "MALICIOUS").when(n % 7 == 1, "SUSPICIOUS").otherwise("BENIGN").alias("verdict"), n.alias("duration_ms"), (n / 4.0).alias("tokens")))


@query(f"WITH {B.SQL_LINES} SELECT doc_id, line_no, translate(line, 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ', 'nopqrstuvwxyzabcdefghijklmNOPQRSTUVWXYZABCDEFGHIJKLM') AS turned, line AS again FROM lines")
def q_rot13_hex(spark, sf_dir):
    """Every line of every text."""
    return B.doc_lines(spark, sf_dir).select("doc_id", F.col("line_no").cast("long").alias("line_no"), T.rot13(F.col("line")).alias("turned"), T.from_hex(F.hex(F.encode("line", "utf-8"))).alias("again"))


@query("SELECT doc_id, translate(text, 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ', 'nopqrstuvwxyzabcdefghijklmNOPQRSTUVWXYZABCDEFGHIJKLM') AS turned, text AS again FROM documents")
def q_rot13_hex_whole(spark, sf_dir):
    """q_rot13_hex over whole texts."""
    return B.documents(spark, sf_dir).select("doc_id", T.rot13(F.col("text")).alias("turned"), T.from_hex(F.hex(F.encode("text", "utf-8"))).alias("again"))


@query("SELECT b.item_id, count(*) AS n_files, min(doc_id) AS first_file FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY b.item_id")
def q_known_bad_passages(spark, sf_dir):
    """Documents that hold a text of the known-bad list."""
    from ..sources.known_bad import holders

    hit = holders(B.documents(spark, sf_dir), B.table(spark, sf_dir, "benchmark"))
    return hit.groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_files"), F.min("doc_id").alias("first_file"))


@query("""WITH k AS (SELECT 'a' || item_id AS item_id, string_split(text, ' ')[1] || ' ' || string_split(text, ' ')[2] AS text FROM benchmark UNION ALL SELECT 'b' || item_id, left(text, 3) FROM benchmark UNION ALL SELECT 'c', NULL)
    SELECT k.item_id, count(*) AS n_files, min(doc_id) AS first_file FROM k JOIN documents d ON contains(d.text, k.text) GROUP BY k.item_id""")
def q_known_bad_words(spark, sf_dir):
    """The same for short items: two words, or a part of a word."""
    from ..sources.known_bad import holders

    b = B.table(spark, sf_dir, "benchmark")
    i = F.col("item_id").cast("string")
    parts = b.select(F.concat(F.lit("a"), i).alias("item_id"), F.array_join(F.slice(F.split("text", " "), 1, 2), " ").alias("text")).unionByName(b.select(F.concat(F.lit("b"), i).alias("item_id"), F.left("text", F.lit(3)).alias("text")))
    parts = parts.unionByName(spark.createDataFrame([("c", None)], "item_id string, text string"))
    return holders(B.documents(spark, sf_dir), parts).groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_files"), F.min("doc_id").alias("first_file"))


# --- manifests, locks, bills of material: texts that Spark makes from the tables, read back -----------------
@query("""SELECT p_brand || '/' || p_partkey // 500 AS file_id, 'package.json' AS path, 'npm' AS ecosystem, 'part' || p_partkey AS name, '^1.' || p_size AS version_spec, p_partkey % 5 = 0 AS is_dev FROM part""")
def q_manifest_deps(spark, sf_dir):
    """A manifest for each brand and 500 keys, so files stay small and their number grows."""
    p = B.table(spark, sf_dir, "part")
    line = lambda: F.format_string('+    "part%d": "^1.%d",', F.col("p_partkey"), F.col("p_size"))
    listed = lambda dev: F.array_join(F.array_sort(F.collect_list(F.when((F.col("p_partkey") % 5 == 0) == dev, line()))), "\n")
    file = F.concat_ws("/", "p_brand", F.floor(F.col("p_partkey") / 500).cast("string"))
    diffs = p.groupBy(file.alias("file_id")).agg(F.concat(F.lit('@@ -1,3 +1,9 @@\n {\n   "dependencies": {\n'), listed(False), F.lit('\n   },\n   "devDependencies": {\n'), listed(True), F.lit("\n   }\n }")).alias("content"))
    return manifests.new_dependencies(diffs.withColumn("path", F.lit("package.json"))).drop("line_number")


@query("""SELECT p_brand || '/' || p_partkey // 500 AS lock_id, CASE WHEN p_brand < 'Brand#3' THEN 'cargo' ELSE 'go' END AS ecosystem, 'crate' || p_size AS name, min('1.' || lpad(p_partkey::VARCHAR, 9, '0')) AS version FROM part GROUP BY ALL""")
def q_lockfiles(spark, sf_dir):
    file = F.concat_ws("/", "p_brand", F.floor(F.col("p_partkey") / 500).cast("string"))
    p = B.table(spark, sf_dir, "part").select(file.alias("lock_id"), F.concat(F.lit("1."), F.lpad(F.col("p_partkey").cast("string"), 9, "0")).alias("v"), F.concat(F.lit("crate"), F.col("p_size").cast("string")).alias("n"))
    entries = F.array_sort(F.collect_list(F.struct("v", "n")))
    joined = p.groupBy("lock_id").agg(entries.alias("e"))
    cargo = F.array_join(F.transform("e", lambda x: F.concat(F.lit('[[package]]\nname = "'), x["n"], F.lit('"\nversion = "'), x["v"], F.lit('"\n'))), "\n")
    go = F.array_join(F.transform("e", lambda x: F.concat(x["n"], F.lit(" v"), x["v"], F.lit(" h1:abc="))), "\n")
    is_cargo = F.col("lock_id") < "Brand#3"
    return lockfiles.locked_packages(joined.select("lock_id", F.when(is_cargo, "Cargo.lock").otherwise("go.sum").alias("file_name"), F.when(is_cargo, cargo).otherwise(go).alias("text")))


@query("""SELECT l_orderkey AS sbom_id, CASE WHEN l_linenumber % 2 = 0 THEN 'npm' ELSE 'maven' END AS ecosystem, CASE WHEN l_linenumber % 2 = 0 THEN 'part' || l_partkey ELSE 'org.g:part' || l_partkey END AS name, '1.' || l_linenumber AS version FROM lineitem""")
def q_sbom_components(spark, sf_dir):
    li = B.table(spark, sf_dir, "lineitem")
    name = F.concat(F.lit("part"), F.col("l_partkey").cast("string"))
    version = F.concat(F.lit("1."), F.col("l_linenumber").cast("string"))
    even = F.col("l_linenumber") % 2 == 0
    c = F.struct(F.lit("library").alias("type"), name.alias("name"), version.alias("version"), F.when(~even, "org.g").alias("group"), F.when(even, F.concat(F.lit("pkg:npm/"), name, F.lit("@"), version)).alias("purl"))
    made = li.groupBy(F.col("l_orderkey").alias("sbom_id")).agg(F.to_json(F.struct(F.lit("CycloneDX").alias("bomFormat"), F.collect_list(c).alias("components"))).alias("text"))
    return bom_components(made.withColumn("file_name", F.lit("bom.json")))


# --- streams: the events table as a stream, run once over what is there, and read back ------------------------
def _streamed(spark, sf_dir, make, mode="append"):
    from uuid import uuid4

    from ..streaming.monitor import run_once, shared_folder

    base = shared_folder(spark)
    root = f"{base}/stream-{uuid4().hex}"
    events = B.table(spark, sf_dir, "events")
    raw = spark.readStream.schema(events.schema).option("maxBytesPerTrigger", str(1 << 30)).parquet(f"{sf_dir}/events.parquet*")
    feed = raw.select(F.lit("pypi").alias("ecosystem"), F.col("user_id").cast("string").alias("name"), F.coalesce(F.get_json_object("props", "$.k"), F.lit("")).alias("version"), F.coalesce(F.get_json_object("props", "$.k"), F.lit("")).alias("latest"),
                      F.col("event_type").alias("kind"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"))
    made = make(feed)
    run_once(made, f"{root}/out", f"{root}/state", mode)
    return spark.read.schema(made.schema).parquet(f"{root}/out")


@query("SELECT count(*) AS n FROM (SELECT DISTINCT user_id, coalesce(json_extract_string(props, '$.k'), '') FROM events)")
def q_stream_dedup(spark, sf_dir):
    from ..streaming.monitor import new_releases

    return _streamed(spark, sf_dir, lambda f: new_releases(f, late="3650 days").select("name", "version")).agg(F.count("*").alias("n"))


@query(f"WITH {SQL_LOG} SELECT name, previous, version AS latest, serial AS seq FROM (SELECT *, lag(version) OVER (PARTITION BY name ORDER BY serial) AS previous FROM log) WHERE previous <> version")
def q_stream_state(spark, sf_dir):
    from ..streaming.monitor import version_changes

    return _streamed(spark, sf_dir, version_changes)


@query("SELECT event_type AS kind, count(*) AS n_windows, sum(n)::BIGINT AS n FROM (SELECT event_type, date_trunc('day', ts) AS d, count(*) AS n FROM events GROUP BY ALL) WHERE d + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY event_type")
def q_stream_windows(spark, sf_dir):
    from ..streaming.monitor import activity

    return _streamed(spark, sf_dir, activity).groupBy("kind").agg(F.count("*").alias("n_windows"), F.sum("n").alias("n"))


@query("""WITH g AS (SELECT user_id, ts, (lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < ts - INTERVAL 30 MINUTE)::INT AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g),
    e AS (SELECT user_id, k, count(*) AS n, max(ts) AS last FROM s GROUP BY ALL) SELECT user_id::VARCHAR AS name, count(*) AS n_sessions, sum(n)::BIGINT AS n FROM e WHERE last + INTERVAL 30 MINUTE <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY user_id""")
def q_stream_sessions(spark, sf_dir):
    from ..streaming.monitor import sessions

    return _streamed(spark, sf_dir, sessions).groupBy("name").agg(F.count("*").alias("n_sessions"), F.sum("n").alias("n"))


# --- more of verdicts, versions and kept tables -----------------------------------------------------------------
@query("""WITH v AS (SELECT p_brand, p_partkey, p_partkey % 3 AS a, p_size AS b, p_partkey % 2 AS final, p_partkey % 5 AS rc FROM part)
    SELECT p_partkey, a || '.' || b || CASE WHEN final = 1 THEN '' ELSE 'rc' || rc END AS version, row_number() OVER (PARTITION BY p_brand, p_partkey // 1000 ORDER BY a, b, final, CASE WHEN final = 1 THEN 0 ELSE rc END, p_partkey)::INTEGER AS place FROM v""")
def q_version_sort_pep440(spark, sf_dir):
    k = F.col("p_partkey")
    v = B.table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.concat((k % 3).cast("string"), F.lit("."), F.col("p_size").cast("string"), F.when(k % 2 == 1, "").otherwise(F.concat(F.lit("rc"), (k % 5).cast("string")))).alias("version"))
    keyed = v.withColumn("key", T.pep440_key(F.col("version")))
    return keyed.select("p_partkey", "version", F.row_number().over(Window.partitionBy("p_brand", F.floor(F.col("p_partkey") / 1000)).orderBy("key", "p_partkey")).alias("place"))


@query("""SELECT user_id::VARCHAR AS name, CASE WHEN event_id % 2 = 0 THEN 'MAL-' ELSE 'GHSA-' END || event_id AS advisory_id, CASE WHEN event_id % 2 = 0 THEN 'MALICIOUS' ELSE 'SUSPICIOUS' END AS verdict,
    CASE WHEN event_id % 3 = 0 THEN 'CVE-2024-' || event_id END AS cve, CASE WHEN event_id % 10 >= 9 THEN 'CRITICAL' WHEN event_id % 10 >= 7 THEN 'HIGH' WHEN event_id % 10 >= 4 THEN 'MEDIUM' WHEN event_id % 2 = 0 THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM events""")
def q_advisories(spark, sf_dir):
    from ..sources.known_bad import advisories

    i = F.col("event_id")
    text = i.cast("string")
    v = F.struct(F.concat(F.when(i % 2 == 0, "MAL-").otherwise("GHSA-"), text).alias("id"), F.when(i % 3 == 0, F.array(F.lit("GHSA-x"), F.concat(F.lit("CVE-2024-"), text))).otherwise(F.array(F.lit("GHSA-x"))).alias("aliases"), F.array(F.struct(F.lit("CVSS_V3").alias("type"), (i % 10).cast("string").alias("score"))).alias("severity"))
    # a response for each name and 1000 events, so that none grows without end
    bodies = B.table(spark, sf_dir, "events").groupBy(F.col("user_id").cast("string").alias("name"), F.floor(i / 1000)).agg(F.to_json(F.struct(F.collect_list(v).alias("vulns"))).alias("body"))
    return advisories(bodies.select("name", F.lit("1").alias("version"), F.lit("npm").alias("ecosystem"), "body")).select("name", "advisory_id", "verdict", "cve", "severity")


@query("""SELECT 'release-npm-' || user_id || '-' || coalesce(json_extract_string(props, '$.k'), '') AS node, max(event_id) AS seq, arg_max(event_type, event_id) AS kind FROM events GROUP BY ALL""")
def q_upsert_nodes(spark, sf_dir):
    from ..operators import tables

    e = B.table(spark, sf_dir, "events")
    rows = e.select(tables.release_node(F.lit("npm"), F.col("user_id").cast("string"), F.coalesce(F.get_json_object("props", "$.k"), F.lit(""))).alias("node"), F.col("event_id").alias("seq"), F.col("event_type").alias("kind"))
    return tables.upsert(rows.where("seq % 2 = 0"), rows.where("seq % 2 = 1"), ("node",), "seq")


FIND = "find AS (SELECT l_orderkey AS release_id, l_linenumber AS chunk_index, (l_partkey * 1000 + l_suppkey) * 100 + round(l_tax * 100)::BIGINT AS position, 'f' || l_suppkey % 3 AS file, CASE l_partkey % 5 WHEN 0 THEN 'EXECUTION' WHEN 1 THEN 'NETWORK' WHEN 2 THEN 'OBFUSCATION' WHEN 3 THEN 'EXFILTRATION' ELSE 'UNHEARD_OF' END AS category, CASE WHEN l_partkey % 2 = 0 THEN l_quantity::INTEGER % 4 END AS line_start, l_returnflag AS evidence, CASE WHEN l_tax > 0.045 THEN 'HIGH' ELSE 'LOW' END AS severity FROM lineitem)"


@query(f"""WITH {FIND}, one AS (SELECT *, row_number() OVER (PARTITION BY release_id, file, category, line_start, CASE WHEN line_start IS NULL THEN evidence END ORDER BY chunk_index, position) AS n FROM find WHERE category <> 'UNHEARD_OF'), f AS (SELECT * FROM one WHERE n = 1),
    m AS (SELECT DISTINCT release_id, 'f0' AS file, category, 1 AS line_start FROM find WHERE chunk_index = 1)
    SELECT release_id, file, category, line_start, severity, 'analyzer' AS origin FROM f UNION ALL
    SELECT release_id, file, category, line_start, 'HIGH', 'rule' FROM m WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.release_id = m.release_id AND f.file = m.file AND f.category = m.category AND f.line_start IS NOT DISTINCT FROM m.line_start)""")
def q_findings_merge(spark, sf_dir):
    li, p = B.table(spark, sf_dir, "lineitem"), F.col("l_partkey")
    cat = F.when(p % 5 == 0, "EXECUTION").when(p % 5 == 1, "NETWORK").when(p % 5 == 2, "OBFUSCATION").when(p % 5 == 3, "EXFILTRATION").otherwise("UNHEARD_OF")
    line = F.when(p % 2 == 0, F.col("l_quantity").cast("int") % 4)
    found = li.select(F.col("l_orderkey").alias("release_id"), F.col("l_linenumber").alias("chunk_index"), ((p * 1000 + F.col("l_suppkey")) * 100 + F.round(F.col("l_tax") * 100).cast("long")).alias("position"), F.concat(F.lit("f"), (F.col("l_suppkey") % 3).cast("string")).alias("file"), cat.alias("category"), line.alias("line_start"), line.alias("line_end"),
                      F.col("l_returnflag").alias("evidence"), F.when(F.col("l_tax") > 0.045, "HIGH").otherwise("LOW").alias("severity"))
    match = found.where("chunk_index = 1").select("release_id", F.lit("f0").alias("file"), "category", F.lit(1).alias("line_number"), F.lit("HIGH").alias("severity")).distinct()
    return verdicts.with_rules(verdicts.distinct_findings(found, ("release_id",)), match, ("release_id",))


@query("""SELECT n.n_name AS tenant, CASE WHEN trim(n.n_name) = '' THEN 'tenant' ELSE replace(n.n_name, ' ', '_') END AS file_name, count(*) AS n FROM supplier JOIN nation n ON n.n_nationkey = s_nationkey GROUP BY n.n_name""")
def q_tenant_files(spark, sf_dir):
    from ..operators import tables

    n = B.table(spark, sf_dir, "nation")
    s = B.table(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    return s.groupBy(F.col("n_name").alias("tenant")).agg(F.count("*").alias("n")).select("tenant", tables.file_name(F.col("tenant")).alias("file_name"), "n")
