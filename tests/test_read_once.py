"""Documents and bills are read by their parsers once, whatever is asked of them afterwards."""

from pyspark.sql import functions as F

from tidewatch.operators import syntax, triage
from tidewatch.plans import source_queries
from tidewatch.sources import metadata
from tidewatch.sources.boms import bom_components


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_transitions_do_not_parse_documents_again(spark):
    docs = spark.createDataFrame([("a", '{"Version": "1", "Time": "2020-01-01T00:00:00Z", "Origin": {"URL": "x"}}'), ("a", '{"Version": "2", "Time": "2020-01-02T00:00:00Z", "Origin": {"URL": "y"}}')], "name string, body string")
    got = metadata.transitions(metadata.go_versions(docs), "origin")
    assert "from_json" not in plan(got)
    assert [(r.version, r.prev_version, r.prev_origin) for r in got.collect()] == [("2", "1", "x")]


def test_bills_are_gone_through_once(spark):
    texts = [("bom.json", '{"bomFormat": "CycloneDX", "components": [{"type": "library", "name": "a", "version": "1"}, {"purl": "pkg:maven/g/b@2"}, null]}'), ("bom.json", '{"SPDXID": "x", "packages": [{"name": "c", "versionInfo": "NOASSERTION"}, {"name": "NOASSERTION"}]}'),
             ("bom.xml", "<SpdxDocument><packages><package><name>d</name><versionInfo>4</versionInfo></package></packages></SpdxDocument>"), ("bom.xml", '<bom><components><component type="library"><name>e</name><version>5</version></component></components></bom>'),
             ("bom.json", "{"), ("bom.json", None), (None, '{"components": []}')]
    boms = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "sbom_id int, file_name string, text string")
    got = bom_components(boms)
    assert "Union" not in plan(got)
    assert sorted(tuple(r) for r in got.collect()) == [(0, "maven", "g:b", "2"), (0, "unknown", "a", "1"), (1, "unknown", "c", ""), (2, "unknown", "d", "4"), (3, "unknown", "e", "5")]
    assert bom_components(boms, format=F.lit("cyclonedx-json")).where("sbom_id = 0").count() == 2


def test_triage_parses_diffs_once(spark):
    """What the triage flow returns goes by one written parse of the diffs, not by the documents' texts again."""
    got = plan(source_queries.q_triage_flow(spark, "/root/testdata/sf0.001"))
    assert "split(coalesce(text#" not in got and "added#" in got


def test_parsed_and_plain_diffs_lead_to_the_same_triage(spark):
    head = "--- a\n+++ b\n@@ -1,1 +1,1 @@\n"
    rows = [("1", "m.py", head + "+exec(x)\n+import ctypes\n-eval(y)", False, False, 0), ("2", "package.json", head + '   "dependencies": {\n+    "dep1": "^1.0"', False, False, 0), ("3", "b.so", "x", True, False, 1), ("4", "m.py", None, False, True, 1),
            ("5", "m.py", head + "+# a\n+# b", False, False, 0), ("6", "m.py", head + "+x = (", False, False, 0), ("6", "m.py", "@@ -2,1 +2,1 @@\n+eval('1'))", False, False, 1)]
    diffs = spark.createDataFrame(rows, "release_id string, path string, content string, is_binary boolean, is_new boolean, chunk_index int")
    bad = spark.createDataFrame([("dep1", "1.0", "npm", "MALICIOUS", "CRITICAL")], "name string, version string, ecosystem string, verdict string, severity string")
    metrics = spark.createDataFrame([("dep2", "npm", 1, 1, 1)], "name string, ecosystem string, age_days long, weekly_downloads long, total_versions long")
    said = spark.createDataFrame([(str(i), False) for i in range(1, 8)], "release_id string, said boolean")
    parsed = triage.parsed_diffs(diffs)
    assert parsed.where("content is not null").count() == 1
    found, plain = triage.scanner_matches(parsed, bad, metrics), triage.scanner_matches(diffs, bad, metrics)
    assert sorted(map(str, found.collect())) == sorted(map(str, plain.collect()))
    one, other = (sorted(map(tuple, triage.triage_releases(said, d, found).collect())) for d in (parsed, diffs))
    assert one == other and {r[0]: r[2] for r in one} == {"1": "critical import", "2": "known bad dependency", "3": "likely benign", "4": "likely benign", "5": "likely benign", "6": "critical syntax", "7": "no chunks"}


def test_files_reach_the_parser_by_whole_words(spark):
    """Words that only hold a name or an if do not need the parser; whatever can be a finding does."""
    plain = ["executive()", "medieval = 1", "# gif iffy", "x = 'if'", "verify_if(x)", 'p = "YWJjf"', "xTimer = 1", "a = b if c else d"]
    found = {"if CI: pass": "CI_SANDBOX_CHECK", "\x0cif CI: pass": "CI_SANDBOX_CHECK", " \x1fif(CI): pass": "CI_SANDBOX_CHECK", "(exec)(x)": "DIRECT_EXEC_EVAL", "[execfile(x)]": "DIRECT_EXEC_EVAL", "x=rf'{KEY}'": "FSTRING_ENV_EMBED", 'x=(Fr"{KEY}")': "FSTRING_ENV_EMBED", "0 or eval(x)": "DIRECT_EXEC_EVAL",
             "x=-compile(y)": "DIRECT_EXEC_EVAL", "__import__('zlib')": "DYNAMIC_IMPORT_SUSPICIOUS", "atexit.register(x)": "ATEXIT_REGISTER", "threading.Timer(x)": "THREADING_TIMER", "ｅval(x)": "DIRECT_EXEC_EVAL"}
    files = spark.createDataFrame([(str(i), [(1, i + 1, x)]) for i, x in enumerate([*plain, *found])], "f string, added array<struct<seq: int, line_number: long, line: string>>")
    signs = files.select("f", F.exists("added", lambda x: x["line"].rlike(syntax.SIGN)).alias("sign")).collect()
    assert {int(r.f) for r in signs if r.sign} == set(range(len(plain), len(files.collect())))
    by_file = sorted((int(r.f), r.finding_id, r.line_number) for r in syntax.file_findings(files, "f").collect())
    by_line = sorted((int(r.f), r.finding_id, r.line_number) for r in syntax.syntax_findings(files.select("f", F.inline("added")), "f").collect())
    assert by_file == by_line == [(i, kind, i + 1) for i, kind in enumerate(found.values(), len(plain))]
