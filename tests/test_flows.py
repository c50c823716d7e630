"""Diffs, matches over line ends, known-bad texts, readers, delivery, reputation and findings on small inputs."""

import difflib
import random
import re

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import catalog as C
from tidewatch.operators import lines, rules, signals, syntax, tenants
from tidewatch.sources import files, known_bad, metadata
from tidewatch.sources.boms import bom_components
from tidewatch.streaming import monitor


def frame(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def plain_added(content):
    """(number, line) of the added lines, read one after another."""
    number, inside, out = 0, False, []
    for raw in content.splitlines():
        head = re.search(r"\+(\d+)", raw) if raw.startswith("@@") else None
        if raw.startswith("@@"):
            if head:
                number, inside = int(head[1]) - 1, True
        elif raw.startswith("+") and (inside or not raw.startswith("+++")):
            number += 1
            out.append((number, raw[1:]))
        elif not raw.startswith("-"):
            number += 1
    return out


DIFFS = [
    "", "no header\n+a\n b\n+c", "--- a\n+++ b\n@@ -1,2 +5,3 @@\n+x\n-y\n z\n+++w\n@@ -9 +20 @@\n+q", "@@ bad @@\n+a\n@@ -1 +7\n+b\n\n+c\n@@ -2 @@\n+d", "+only", "@@ -0,0 +1,2 @@\n+a\r\n+b\n\\ No newline", "+++ b\n+++ c\n+d",
]


def test_added_lines(spark):
    got = {}
    for r in lines.added_lines(frame(spark, "file_id int, content string", *enumerate(DIFFS), (99, None))).collect():
        got.setdefault(r.file_id, []).append((r.seq, r.line_number, r.line))
    for i, d in enumerate(DIFFS):
        assert [x[1:] for x in sorted(got.get(i, []))] == plain_added(d), d
    assert 99 not in got


def test_unified_diffs(spark):
    rng = random.Random(1)
    text = lambda: "".join(rng.choice(["a\n", "b\n", "c c\n", "\n", "d\r\n"]) for _ in range(rng.randrange(30))) + rng.choice(["", "end"])
    old, new = {f"f{i}": text() for i in range(30)}, {f"f{i}": text() for i in range(5, 40)}
    new["f7"] = old["f7"]
    side = lambda d: frame(spark, "release_id string, path string, content string, is_binary boolean", *(("r", p, t, p == "f9") for p, t in d.items()))
    got = {r.path: r for r in lines.unified_diffs(side(old), side(new)).collect()}
    assert got["f9"].is_binary and got["f9"].content == "" and "f7" not in got and got["f0"].is_deleted and got["f39"].is_new
    for p, r in got.items():
        if p == "f9":
            continue
        a, b = (re.sub("\r\n?", "\n", d.get(p, "")).splitlines(True) for d in (old, new))
        want = [x.rstrip("\n") for x in difflib.unified_diff(a, b, f"a/{p}", f"b/{p}", lineterm="")]
        assert r.content.split("\n") == (want or [""]) and r.lines_added == sum(x.startswith("+") for x in want[2:]) and r.lines_removed == sum(x.startswith("-") for x in want[2:])
    stats = lines.diff_stats(side(old), side(new)).first()
    assert stats.new_files == sorted(set(new) - set(old)) and stats.deleted_files == sorted(set(old) - set(new)) and stats.binary_files == ["f9"]


CODE = ["os.system", "('x'); y = 1", "require('a' +", " 'b')", "x = 1; os.system('late')", "a = '1.2.3.4' + '10.0.0.1' + 'http://8.8.8.8'", "requests.get('https://pypi.org/x')", "requests.get", "('http://evil.example')", "z", "os.environ['X'] # TOKEN",
        "while (true) {", "fetch()", "}", "String.fromCharCode(1,2,", "3, 44)", "eval('" + "\\x41" * 3000 + "')", "new Function('x')", "cmdclass", "subprocess", "base64.b64decode", "(x)", "exec", "(y)"]


def test_rules_over_line_ends(spark):
    """Every rule against Python's own expressions over the whole text: places and evidence."""
    df = frame(spark, "f int, seq int, line_number long, line string", *((1, i, 100 + i, x) for i, x in enumerate(CODE)), (2, 1, 7, "clean"))
    got = {(r.rule_id, r.line_number, r.evidence) for r in rules.text_matches(rules.joined(df, ("f",)), ("f",)).collect()}
    text, want = "\n".join(CODE), set()
    for r in C.RULES:
        pattern = r[5]
        if r[0] in C.UNLESS:
            before, after = C.UNLESS[r[0]]
            at = pattern.index(before) if before else len(pattern)
            pattern = f"{pattern[:at]}(?!{after.removeprefix('^')}){pattern[at:]}"
        seen = set()
        for m in re.finditer(pattern, text, re.I | (re.S if r[4] else 0)):
            at = text.count("\n", 0, m.start())
            if at not in seen:
                seen.add(at)
                want.add((r[0], 100 + at, m[0][:50]))
    assert got == want and {"OS_SYSTEM", "CJS_REQUIRE_CONCAT", "SUSPICIOUS_HTTP", "HARDCODED_IP", "CJS_CHARCODE_BUILD", "CJS_HEX_ESCAPE", "SETUP_HOOK"} <= {r[0] for r in got}
    assert ("OS_SYSTEM", 104, "os.system(") in got


def test_chains_over_line_ends(spark):
    df = frame(spark, "f int, seq int, line_number long, line string", *((1, i, 100 + i, x) for i, x in enumerate(CODE)))
    got = {(r.rule_id, r.line_number) for r in rules.chain_matches(rules.joined(df, ("f",)), ("f",)).collect()}
    want = {(c[0], 100 + i) for c in C.CHAINS for i in range(len(CODE)) if all(re.search(p, "\n".join(CODE[i : i + c[4]]), re.I) for p in c[5])}
    assert got == want and ("BASE64_EXEC_CHAIN", 120) in got


def test_opt_in_rules(spark):
    df = frame(spark, "f int, seq int, line_number long, line string", *((1, i, i, x) for i, x in enumerate(["while (true) {", "fetch()", "}", "f.write ('peace')", "sys.exit(3)", "os.walk(x)", "open(p, 'w')", "ipaddr and exec"])))
    got = {r.rule_id for r in rules.text_matches(rules.joined(df, ("f",)), ("f",), C.SABOTAGE_RULES).collect()}
    assert got == {r[0] for r in C.SABOTAGE_RULES}


def test_very_long_payloads_do_not_recurse(spark):
    long = ["eval('" + "\\x41" * 100_000 + "')", "String.fromCharCode(" + "65, " * 100_000 + "1)"]
    df = frame(spark, "f int, seq int, line_number long, line string", *((1, i, i, x) for i, x in enumerate(long)))
    assert {"CJS_HEX_ESCAPE", "CJS_CHARCODE_BUILD"} <= {r.rule_id for r in rules.scan_texts(df, "f").collect()}


@pytest.mark.parametrize("block", [1, 12, 1 << 21])
def test_known_bad_texts(spark, block):
    items = [(1, "kw two"), (2, "x"), (3, ""), (4, None), (5, "kw"), (6, "not there"), (7, "kw two")]
    texts = [(1, "x kw two y"), (2, "akw twob"), (3, None), (4, ""), (5, "kwx kw  two")]
    got = {(r.doc_id, r.item_id) for r in known_bad.holders(frame(spark, "doc_id long, text string", *texts), frame(spark, "item_id int, text string", *items), block=block).collect()}
    assert got == {(d, i) for d, t in texts for i, x in items if t is not None and x is not None and x in t}


def test_a_link_does_not_make_a_format(spark):
    xml = '<?xml version="1.0"?>\n<bom xmlns="http://cyclonedx.org/schema/bom/1.4"><components><component type="library"><name>a</name><version>1</version><licenses><url>https://spdx.org/licenses/MIT</url></licenses></component></components></bom>'
    boms = frame(spark, "sbom_id int, file_name string, text string", (1, "bom.xml", xml), (2, "bom", xml), (3, "odd.xml", "<nothing"), (4, "x", '{"components": [{"type": "library", "name": "b", "version": "2"}]}'))
    assert sorted((r.sbom_id, r.name) for r in bom_components(boms).collect()) == [(1, "a"), (2, "a"), (4, "b")]
    assert bom_components(boms.where("sbom_id = 1"), format=F.lit("spdx-xml")).count() == 0


def test_a_root_whose_name_recurs(spark, tmp_path):
    root = tmp_path / "rt"
    inner = root / "x" / str(root).lstrip("/")
    inner.mkdir(parents=True)
    (inner / "y.txt").write_text("1"), (root / "z.txt").write_text("2")
    want = sorted([f"x/{str(root).lstrip('/')}/y.txt", "z.txt"])
    for name in (str(root), f"{root}/", f"file://{root}", f"file:{root}"):
        assert sorted(r.path for r in files.read_tree(spark, name).collect()) == want, name


def test_a_batch_that_is_sent_twice(spark, tmp_path):
    """The checkpoint is lost, the batch comes again: its failures are in the table once."""
    source, failed = str(tmp_path / "in"), str(tmp_path / "failed")
    frame(spark, "alert_id string, verdict string, severity string", ("a", "MALICIOUS", "HIGH"), ("b", "MALICIOUS", "HIGH"), ("c", "BENIGN", "HIGH")).coalesce(1).write.parquet(source)
    for turn in range(2):
        stream = spark.readStream.schema("alert_id string, verdict string, severity string").parquet(source)
        monitor.deliver(stream, lambda rows: ((r["alert_id"], "down" if r["alert_id"] == "a" else None) for r in rows), "LOW", str(tmp_path / f"state{turn}"), failed).awaitTermination()
    assert [(r.alert_id, r.error) for r in spark.read.parquet(failed).collect()] == [("a", "down")]


def test_reputation(spark):
    deps = frame(spark, "name string, ecosystem string", ("new", "npm"), ("old", "pypi"), ("absent", "npm"), ("absent", "go"))
    found = frame(spark, "name string, ecosystem string, age_days long, weekly_downloads long, total_versions long", ("new", "npm", 1, 5, 1), ("old", "pypi", 900, None, 40))
    got = {(r.name, r.ecosystem): (r.severity, r.boost, r.is_suspicious) for r in signals.judged_reputation(deps, found).collect()}
    assert got == {("new", "npm"): ("CRITICAL", 0.30, True), ("old", "pypi"): ("NONE", 0.0, False), ("absent", "npm"): ("HIGH", 0.15, True), ("absent", "go"): ("NONE", 0.0, False)}


def test_times(spark):
    texts = ["2024-01-02T03:04:05Z", "2024-01-02T03:04:05.678Z", "2024-01-02T03:04:05+09:00", "2024-01-02 03:04:05", "2024-01-02", "", "soon", None]
    got = [r.t for r in frame(spark, "i int, x string", *enumerate(texts)).select("i", F.date_format(metadata.timestamp(F.col("x")), "yyyy-MM-dd HH:mm:ss").alias("t")).orderBy("i").collect()]
    assert got == ["2024-01-02 03:04:05"] * 4 + ["2024-01-02 00:00:00"] + [None] * 3


def test_findings_of_tenants(spark):
    alerts = frame(spark, "release_id string, ecosystem string, name string, version string, verdict string, severity string, confidence double, summary string", ("r", "npm", "a", "1", "MALICIOUS", "CRITICAL", 0.91, "s"), ("q", "npm", "a", "2", "BENIGN", "NONE", 0.9, None))
    packages = frame(spark, "tenant_id int, ecosystem string, name string, version string", (1, "npm", "a", "1"), (2, "npm", "a", ""), (3, "npm", "a", "2"))
    uses = frame(spark, "tenant_id int, ecosystem string, name string, target string, direct boolean", (1, "npm", "a", "x", True), (1, "npm", "a", "y", False), (3, "npm", "a", "z", True))
    got = {r.tenant_id: r for r in tenants.tenant_findings(alerts, packages, uses).collect()}
    assert got.keys() == {1, 2} and (got[1].direct, got[1].indirect, got[1].risk) == (1, 1, 60) and got[2].risk == 0
    assert got[1].title == "[MALICIOUS] npm/a@1" and "Verdict: MALICIOUS (91%)" in got[1].description


def test_syntax_of_far_apart_lines():
    numbers, code = [5, 10**12, 10**12 + 1, 3 * 10**12], ["e = exec", "if x:", "    e('y')", "eval(z)"]
    assert {k for k in syntax.parse_lines(numbers, code)} == {("ALIASED_EXEC", 10**12 + 1), ("DIRECT_EXEC_EVAL", 3 * 10**12)}


def test_ready_made_diffs(spark, tmp_path):
    (tmp_path / "a.diff").write_text("--- a/x.py\n+++ b/pkg/x.py\n@@ -0,0 +1 @@\n+os.system('x')\n"), (tmp_path / "b.diff").write_text("+y")
    got = {r.file_id: r for r in files.read_diffs(spark, str(tmp_path)).collect()}
    assert (got["a.diff"].path, got["b.diff"].path) == ("pkg/x.py", "b.diff")
    found = rules.text_matches(lines.added_files(files.read_diffs(spark, str(tmp_path))), ("file_id",)).collect()
    assert [(r.file_id, r.rule_id, r.line_number) for r in found] == [("a.diff", "OS_SYSTEM", 1)]


def test_latest_tag_and_its_predecessor(spark):
    import json

    from tidewatch.sources.metadata import npm_latest

    doc = lambda latest, *versions: json.dumps({"dist-tags": {"latest": latest} if latest else {}, "versions": {v: {} for v in versions}})
    rows = [("a", doc("1.10.0", "1.9.0", "1.10.0", "2.0.0-rc.1", "1.10.0-beta.2", "1.10.0-beta.11")), ("b", doc("1.0.0", "1.0.0", "2.0.0")), ("c", doc("3.0.0", "1.0.0")), ("d", doc(None, "1.0.0")), ("e", None), ("f", "{")]
    got = {r.name: (r.version, r.previous_version) for r in npm_latest(spark.createDataFrame(rows, "name string, body string")).collect()}
    assert got == {"a": ("1.10.0", "1.10.0-beta.11"), "b": ("1.0.0", None)}
