"""Release-risk operators on small inputs, against values worked out by hand or by plain Python."""

import ast
import gzip
import io
import json
import re
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import catalog as C
from tidewatch.functions import text as T
from tidewatch.operators import chunks, decode, imports, lines, manifests, rules, signals, syntax, tenants, verdicts
from tidewatch.sources import boms, feeds, files, lockfiles
from tidewatch.streaming import monitor


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first().x


def frame(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


DIFF = "--- a/x\n+++ b/x\n@@ -1,2 +10,3 @@\n keep\n+one\n-gone\n+++two\n keep\n@@ -9 +40 @@\n+three"


def test_added_lines(spark):
    got = [(r.line_number, r.line) for r in lines.added_lines(frame(spark, "file_id int, content string", (1, DIFF))).orderBy("seq").collect()]
    assert got == [(11, "one"), (12, "++two"), (40, "three")]


@pytest.mark.parametrize("text", ["", "a", "a\n", "a\n\nb", "a\r\nb\rc", "a\x0bb\x0cc\x1cd\x85e f ", "\n"])
def test_lines_are_pythons(spark, text):
    assert one(spark, T.lines_of(F.col("t")), t=text) == text.splitlines()


def test_line_diff_and_stats(spark):
    old = frame(spark, "release_id int, path string, content string, is_binary boolean", (1, "a", "x\ny\nx", False), (1, "gone", "q", False), (1, "same", "s", False))
    new = frame(spark, "release_id int, path string, content string, is_binary boolean", (1, "a", "x\nz", False), (1, "new.so", "b", True), (1, "same", "s", False))
    r = lines.diff_stats(old, new).first()
    assert (r.files_changed, r.lines_added, r.lines_removed, r.new_files, r.deleted_files, r.binary_files) == (3, 1, 3, ["new.so"], ["gone"], ["new.so"])


CODE = [
    "exec(base64.b64decode('x'))", "x = 'http://8.8.8.8/'", "x = '192.168.1.1'", "y = \"10.0.0.1\" + '9.9.9.9'", "os.environ['MY_SECRET']", "os.system('ls')", "requests.get('https://pypi.org/x')", "requests.post('http://evil.io')",
    "subprocess.run('x', shell=True)", "bash -i", "sys.exit(1)", "eval(Buffer.from('x'))", "String.fromCharCode(1,2,3)", '"postinstall": "node -e 1"', "plain text", "getattr(os, 'system')", "chr(1)+chr(2)", "wallet.dat", "dig $(whoami)",
]


def test_single_line_rules_match_as_pythons(spark):
    df = frame(spark, "n int, line string", *enumerate(CODE))
    got = {(r.n, r.rule_id) for r in rules.scan_lines(df, ("n",)).collect()}
    private = C.PRIVATE_IP.removeprefix("^")
    whole = {r[0]: r[5] for r in C.RULES}
    whole["HARDCODED_IP"] = whole["HARDCODED_IP"].replace(r"(\d{1,3}\.", rf"(?!{private})(\d{{1,3}}\.", 1)
    whole["SUSPICIOUS_HTTP"] += "(?!" + C.ALLOWED_HOSTS.removeprefix("^") + ")"
    spans = {r[0]: r[4] for r in C.RULES}
    want = {(n, name) for n, line in enumerate(CODE) for name, p in whole.items() if re.search(p, line, re.I | (re.S if spans[name] else 0))}
    assert got == want and len({name for _, name in want}) >= 14


def test_chain_needs_both_within_the_window(spark):
    far = ["base64.b64decode('x')", "a", "b", "c", "exec(y)"]
    df = frame(spark, "f int, seq int, line string", *((1, i, x) for i, x in enumerate(far)), *((2, i, x) for i, x in enumerate([*far[:4], "d", "exec(y)"])))
    assert [(r.f, r.seq, r.rule_id) for r in rules.scan_chains(df, ("f",), "seq", ("f", "seq")).collect()] == [(1, 0, "BASE64_EXEC_CHAIN")]


def test_matches_that_span_lines(spark):
    df = frame(spark, "file_id string, seq int, line_number long, line string", ("a", 1, 10, "cmdclass = 1"), ("a", 2, 11, "x"), ("a", 3, 30, "y = eval(z)"))
    got = {(r.rule_id, r.line_number) for r in rules.scan_texts(df, "file_id").collect()}
    assert got == {("SETUP_HOOK", 10)}


def test_merge_covers_and_orders(spark):
    s = "file_id int, rule_id string, category string, severity string, cwe string, line_number int, evidence string"
    single = frame(spark, s, (1, "LOWRULE", "OBFUSCATION", "LOW", "", 1, "e"), (1, "H", "OBFUSCATION", "HIGH", "", 2, "e"), (1, "H", "OBFUSCATION", "MEDIUM", "", 2, "f"), (2, "LOWRULE", "OBFUSCATION", "LOW", "", 1, "e"))
    chain = frame(spark, s, (1, "CH", "OBFUSCATION", "CRITICAL", "", 5, "e"))
    got = [(r.file_id, r.position, r.rule_id, r.severity) for r in rules.merge_matches(single, chain).orderBy("file_id", "position").collect()]
    assert got == [(1, 1, "CH", "CRITICAL"), (1, 2, "H", "HIGH"), (2, 1, "LOWRULE", "LOW")]


def test_imports(spark):
    src = ["import os, ctypes as c, base64", "from subprocess import Popen", "from os import (path, system)", "import requests", "import requests", "x = 1", "# import socket", "from a import b"]
    df = frame(spark, "f int, seq int, line_number int, line string", *((1, i, i + 1, x) for i, x in enumerate(src)))
    got = [(r.module, r.severity, r.line_number) for r in imports.import_signals(df, ("f",)).orderBy("line_number", "module").collect()]
    assert got == [("base64", "HIGH", 1), ("ctypes", "CRITICAL", 1), ("subprocess", "HIGH", 2), ("os", "HIGH", 3), ("requests", "MEDIUM", 4)]


def test_decoding(spark):
    import base64
    import codecs

    payload = "import os; os.system('id')"
    rows = [(1, 1, 1, f'x = "{base64.b64encode(payload.encode()).decode().rstrip("=")}"'), (1, 2, 2, f"y = b'{b'exec(1) now'.hex()}'"), (1, 3, 3, codecs.encode("subprocess.run(x)", "rot13")), (1, 4, 4, 'z = "' + "QUJD" * 8 + '"'), (1, 5, 5, f'x = "{base64.b64encode(payload.encode()).decode().rstrip("=")}"')]
    got = [(r.line_number, r.encoding, r.decoded, r.severity) for r in decode.decoded_payloads(frame(spark, "f int, seq int, line_number int, line string", *rows), ("f",)).orderBy("line_number").collect()]
    assert got == [(1, "base64", payload, "CRITICAL"), (2, "hex", "exec(1) now", "CRITICAL"), (3, "rot13", "subprocess.run(x)", "HIGH")]


def test_syntax(spark):
    src = ["e = exec", "e('x')", "if os.getenv('CI'):", "    pass", "getattr(o, 'system')(1)", "atexit.register(f)", "u = f'{os.environ}'", "__import__('socket')"]
    df = frame(spark, "f string, seq int, line_number long, line string", *(("a", i, i + 5, x) for i, x in enumerate(src)), ("b", 1, 1, "  eval(x)"), ("b", 2, 2, "def ("), ("c", 1, 1, "eval(" * 500))
    got = sorted((r.f, r.finding_id, r.line_number) for r in syntax.syntax_findings(df, "f").collect())
    assert got == [("a", "ALIASED_EXEC", 6), ("a", "ATEXIT_REGISTER", 10), ("a", "CI_SANDBOX_CHECK", 7), ("a", "DYNAMIC_IMPORT_SUSPICIOUS", 12), ("a", "FSTRING_ENV_EMBED", 11), ("a", "GETATTR_DANGEROUS", 9), ("b", "DIRECT_EXEC_EVAL", 1)]
    assert syntax.findings(ast.parse("x = 1")) == {}


def test_manifests(spark):
    diffs = [
        (1, "package.json", '@@ -1 +1 @@\n   "dependencies": {\n+    "left-pad": "^1.0.0",\n     "x": "1"\n   "devDependencies": {\n+    "@a/b": "2"'),
        (2, "requirements.txt", '+requests>=2.0\n+# c\n+name = "x"\n+flask'), (3, "go.mod", "+require (\n+\tgithub.com/a/b v1.2.3\n+\tgolang.org/x/c v0.1.0 // indirect\n+)\n+require example.com/z v2.0.0"),
        (4, "Cargo.toml", '+[dependencies]\n+serde = "1.0"\n+tokio = { version = "1.2", features = ["x"] }\n+[dev-dependencies]\n+rand = "0.8"'), (5, "Cargo.lock", '+[[package]]\n+name = "serde"\n+version = "1.0.1"\n [[package]]\n+name = "x"\n context\n+version = "9"'),
    ]
    got = sorted((r.file_id, r.ecosystem, r.name, r.version_spec, r.is_dev, r.line_number) for r in manifests.new_dependencies(frame(spark, "file_id int, path string, content string", *diffs)).collect())
    assert got == [
        (1, "npm", "@a/b", "2", True, 6), (1, "npm", "left-pad", "^1.0.0", False, 3), (2, "pypi", "flask", "", False, 4), (2, "pypi", "requests", ">=2.0", False, 1),
        (3, "go", "example.com/z", "2.0.0", False, 5), (3, "go", "github.com/a/b", "1.2.3", False, 2), (3, "go", "golang.org/x/c", "0.1.0", True, 3),
        (4, "cargo", "rand", "0.8", True, 5), (4, "cargo", "serde", "1.0", False, 2), (4, "cargo", "tokio", "1.2", False, 3), (5, "cargo", "serde", "1.0.1", False, 2)]
    deps = frame(spark, "name string, ecosystem string, is_dev boolean", ("lodash", "npm", False), ("x1", "npm", False), ("d1", "npm", True), ("y", "npm", False))
    assert [r.name for r in manifests.to_watch(deps).collect()] == ["x1"]


def test_chunks(spark):
    df = frame(spark, "r int, path string, tokens int", (1, "z.py", 60), (1, "setup.py", 50), (1, "a.py", 60), (1, "docs/x.py", 500), (1, "b.py", 900), (1, "c.py", 1))
    got = [(r.path, r.chunk_index) for r in chunks.chunk_files(df, "r", 110).orderBy("chunk_index", "path").collect()]
    assert got == [("a.py", 0), ("setup.py", 0), ("b.py", 1), ("c.py", 2), ("z.py", 2)]


@pytest.mark.parametrize("path,skipped", [("test_a.py", True), ("x/a_test.py", True), ("docs/a.py", True), ("a/docs/b/c.py", True), ("mydocs/a.py", False), ("README.md", True), ("CHANGELOG.txt", True), ("a.dist-info/METADATA", True), ("a-1.dist-info/x.py", False), ("main.py", False)])
def test_skipped(spark, path, skipped):
    assert one(spark, T.skipped(F.col("p")), p=path) is skipped


@pytest.mark.parametrize("age,weekly,versions,parent,score", [(6, 50, 1, None, 90), (7, 100, 2, None, 40), (29, 999, 1, 0, 60), (30, 1000, 2, None, 10), (90, None, None, None, 0), (None, 10, None, 100_001, 65), (None, 10, None, 100_000, 50), (None, 0, None, 5, 70)])
def test_reputation(spark, age, weekly, versions, parent, score):
    df = frame(spark, "a int, w int, v int, p int", (age, weekly, versions, parent))
    level = signals.reputation_level(F.col("s"))
    r = df.select(signals.reputation_score(*map(F.col, "awvp")).alias("s")).select("s", level[0].alias("severity")).first()
    assert r.s == score and r.severity == ("CRITICAL" if score >= 60 else "HIGH" if score >= 35 else "MEDIUM" if score >= 15 else "LOW" if score else "NONE")


@pytest.mark.parametrize("days,name,found", [(180, "x", ""), (181, "x", "MEDIUM_DORMANCY"), (365, "x", "MEDIUM_DORMANCY"), (366, "x", "LONG_DORMANCY"), (900, "my-crypto", "")])
def test_dormancy(spark, days, name, found):
    df = frame(spark, "n string, a string", (name, "2020-01-01 12:00:00")).select("n", F.col("a").cast("timestamp").alias("a"))
    assert df.select(signals.ids(signals.dormancy(F.col("n"), F.col("a"), F.col("a") + F.expr(f"interval {days} days"))).alias("s")).first().s == found
    assert df.select(T.gap_days(F.col("a"), F.col("a") - F.expr("interval 12 hours")).alias("g")).first().g == -1


def test_transitions(spark):
    a = lambda *x: F.array(*map(F.lit, x)) if x else F.array().cast("array<string>")
    ids = lambda c: one(spark, signals.ids(c), z=1)
    assert ids(signals.maintainer_change(a("x"), a("y"))) == "MAINTAINER_CHANGE" and ids(signals.maintainer_change(a(), a("y"))) == ""
    assert ids(signals.npm_transition(a("a"), a("a", "react"), a(), a("test"))) == "" and ids(signals.npm_transition(a("a"), a("b"), a(), a("install"))) == "NEW_DEPENDENCY,NEW_INSTALL_HOOK"
    assert ids(signals.pypi_files(a("a.py"), a("x/setup.py"))) == "NEW_SETUP_PY"
    assert ids(signals.origin_change(F.lit("a"), F.lit("b"))) == "VCS_ORIGIN_CHANGED" and ids(signals.origin_change(F.lit(""), F.lit("b"))) == ""
    assert ids(signals.yanked_predecessor(F.lit(True))) == "YANKED_PREDECESSOR" and ids(signals.author_change(F.lit("a"), F.lit("b"))) == "MAINTAINER_CHANGE"
    assert ids(signals.diff_signals(F.lit(51), F.lit(10), a("test_a", "b_test"), a("l.so", "x.pyc"), a("setup.py"))) == "BINARY_ADDED,BUILD_FILES_CHANGED,LARGE_ADDITION,TESTS_DELETED"
    assert ids(signals.diff_signals(F.lit(50), F.lit(10), a("test_a"), a(), a())) == "" and ids(signals.diff_signals(F.lit(101), F.lit(0), a(), a(), a())) == "PURE_ADDITION"
    assert ids(signals.manifest_signals(F.lit(3), F.lit(0), F.lit(0))) == "MANIFEST_ONLY_NEW_DEP,MANY_NEW_DEPS_AT_ONCE"


@pytest.mark.parametrize("verdict,rank,boost,high,confidence,want", [("BENIGN", 0, 0.0, False, 0.5, "BENIGN"), ("BENIGN", 2, 0.0, False, 0.5, "SUSPICIOUS"), ("BENIGN", 4, 0.0, False, 0.5, "MALICIOUS"), ("UNKNOWN", 5, 0.0, False, 0.5, "UNKNOWN"), ("UNKNOWN", 5, 0.1, True, 0.5, "MALICIOUS"), ("BENIGN", 0, 0.1, True, 0.85, "BENIGN"), ("BENIGN", 0, 0.05, True, 0.85, "SUSPICIOUS")])
def test_escalation(spark, verdict, rank, boost, high, confidence, want):
    got = [one(spark, c, z=1) for c in verdicts.escalate(F.lit(verdict), F.lit("LOW"), F.lit(confidence), F.lit(rank), F.lit(boost), F.lit(high))]
    assert got[0] == want and got[2] == pytest.approx(min(1, confidence + boost))


def test_findings(spark):
    s = "r int, chunk_index int, position int, file string, category string, line_start int, line_end int, evidence string, severity string"
    f = frame(spark, s, (1, 0, 0, "a", "EXECUTION", None, None, "x", "HIGH"), (1, 1, 0, "a", "EXECUTION", None, None, "x", "LOW"), (1, 0, 1, "a", "EXECUTION", None, None, "y", "HIGH"), (1, 0, 2, "a", "NOSUCH", 1, 1, "z", "HIGH"))
    kept = verdicts.distinct_findings(f, ("r",))
    assert sorted((x.evidence, x.severity) for x in kept.collect()) == [("x", "HIGH"), ("y", "HIGH")]
    m = frame(spark, "r int, file string, category string, line_number int, severity string", (1, "a", "EXECUTION", None, "LOW"), (1, "a", "NETWORK", 3, "LOW"))
    assert sorted(x.origin for x in verdicts.with_rules(kept, m, ("r",)).collect()) == ["analyzer", "analyzer", "rule"]


def test_tenants_and_risk(spark):
    rel = frame(spark, "name string, version string, ecosystem string", ("a", "1", "npm"))
    use = frame(spark, "tenant_id string, name string, version string, ecosystem string", ("t1", "a", "1", "npm"), ("t2", "a", "", "npm"), ("t3", "a", None, "npm"), ("t4", "a", "2", "npm"), ("t5", "a", "1", "pypi"), ("t1", "a", "", "npm"))
    assert sorted(r.tenant_id for r in tenants.affected_tenants(rel, use).collect()) == ["t1", "t2", "t3"]
    risk = tenants.risk_scores(frame(spark, "tenant_id string, target string, severity string, direct boolean", ("t", "s", "CRITICAL", True), ("t", "s", "LOW", False), ("t", "s", "ODD", True))).first()
    assert risk.risk == 51
    assert one(spark, tenants.advisory_severity(F.col("s"), F.col("i")), s="9.8", i="GHSA") == "CRITICAL" and one(spark, tenants.advisory_severity(F.col("s"), F.col("i")), s="CVSS:3.1/AV:N", i="MAL-1") == "HIGH"


def test_versions_sort_as_semver(spark):
    right = ["0.9.0", "1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-alpha.beta", "1.0.0-beta.2", "1.0.0-beta.11", "1.0.0", "v1.2.0", "1.10.0"]
    df = frame(spark, "v string", *((x,) for x in reversed(right)))
    assert [r.v for r in df.orderBy(T.semver_key(F.col("v"))).collect()] == right


@pytest.mark.parametrize("url,want", [("pkg:pypi/requests@2.0", ("pypi", "requests", "2.0")), ("pkg:npm/%40a/b@1", ("npm", "@a/b", "1")), ("pkg:golang/github.com/a/b@v1", ("go", "github.com/a/b", "v1")), ("pkg:maven/g/a@1", ("maven", "g:a", "1")), ("pkg:npm/x", ("npm", "x", "")), ("nonsense", (None, None, None)), ("pkg:npm/%zz@1", (None, None, None))])
def test_purl(spark, url, want):
    got = T.purl(F.col("u"))
    assert tuple(one(spark, got[k], u=url) for k in ("ecosystem", "name", "version")) == want


def test_boms(spark):
    cyclone = json.dumps({"bomFormat": "CycloneDX", "components": [{"type": "library", "name": "x", "version": "1", "purl": "pkg:npm/x@1"}, {"type": "library", "group": "g", "name": "a", "version": "2"}, {"type": "file", "name": "f"}]})
    spdx = json.dumps({"SPDXID": "SPDXRef-DOCUMENT", "packages": [{"SPDXID": "S1", "name": "p", "versionInfo": "1", "externalRefs": [{"referenceType": "purl", "referenceLocator": "pkg:pypi/p@3"}]}, {"SPDXID": "S2", "name": "q", "versionInfo": "NOASSERTION"}, {"SPDXID": "S3", "name": "NOASSERTION"}]})
    xml = '<bom xmlns="http://cyclonedx.org/schema/bom/1.4"><components><component type="library"><name>y</name><version>1</version><purl>pkg:cargo/y@1</purl></component><component type="library"><name>@s/z</name><version>4</version></component></components></bom>'
    df = frame(spark, "sbom_id int, file_name string, text string", (1, "a.json", cyclone), (2, "b.json", spdx), (3, "c.xml", xml), (4, "d.json", "{broken"))
    got = sorted((r.sbom_id, r.ecosystem, r.name, r.version) for r in boms.bom_components(df).collect())
    assert got == [(1, "maven", "g:a", "2"), (1, "npm", "x", "1"), (2, "pypi", "p", "3"), (2, "unknown", "q", ""), (3, "cargo", "y", "1"), (3, "npm", "@s/z", "4")]


def test_lockfiles(spark):
    texts = [
        (1, "package-lock.json", json.dumps({"packages": {"": {"version": "0"}, "node_modules/a": {"version": "1"}, "node_modules/b/node_modules/@s/c": {"version": "2"}}})), (2, "package-lock.json", json.dumps({"dependencies": {"a": {"version": "1"}}})),
        (3, "yarn.lock", '# yarn\n"@s/a@^1", "@s/a@^2":\n  version "1.5"\nb@1:\n  version: 2.0\n'), (4, "Pipfile.lock", json.dumps({"default": {"a": {"version": "==1"}}, "develop": {"a": {"version": "==2"}, "b": {"version": "==3"}}})),
        (5, "poetry.lock", '[[package]]\nname = "a"\nversion = "1"\n[package.dependencies]\nname = "no"\n'), (6, "go.sum", "github.com/a/b v1.0.0 h1:x=\ngithub.com/a/b v1.0.0/go.mod h1:y=\n"), (7, "Cargo.lock", '[[package]]\nname = "s"\nversion = "1.2"\n'), (8, "other.txt", "a"),
    ]
    got = sorted((r.lock_id, r.ecosystem, r.name, r.version) for r in lockfiles.locked_packages(frame(spark, "lock_id int, file_name string, text string", *texts)).collect())
    assert got == [(1, "npm", "@s/c", "2"), (1, "npm", "a", "1"), (2, "npm", "a", "1"), (3, "npm", "@s/a", "1.5"), (3, "npm", "b", "2.0"), (4, "pypi", "a", "1"), (4, "pypi", "b", "3"), (5, "pypi", "a", "1"), (6, "go", "github.com/a/b", "1.0.0"), (7, "cargo", "s", "1.2")]
    assert sorted(r.name for r in lockfiles.plain_list(frame(spark, "value string", ("a # c",), ("# x",), ("b",)), "npm").collect()) == ["a", "b"]


def test_archives_and_trees(spark, tmp_path):
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as out:
        out.writestr("a/x.py", "1"), out.writestr("../evil", "2"), out.writestr("/abs", "3")
    t = io.BytesIO()
    with tarfile.open(fileobj=t, mode="w:gz") as out:
        for name, data in (("package/i.js", b"js"), ("package/../../e", b"no")):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            out.addfile(info, io.BytesIO(data))
    df = frame(spark, "name string, content binary", ("p.whl", z.getvalue()), ("p.tgz", t.getvalue()), ("bad.zip", b"no"), ("bad.tgz", gzip.compress(b"x")))
    got = files.unpack(df).collect()
    assert sorted((r.name, r.path, bytes(r.content)) for r in got if r.path) == [("p.tgz", "i.js", b"js"), ("p.whl", "a/x.py", b"1")] and {r.name for r in got if r.error} == {"bad.zip", "bad.tgz"}
    assert [p for p, _ in files.members("p.whl", z.getvalue(), max_files=0)] == []
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.py").write_bytes(b"ok\xff")
    (tmp_path / "b.bin").write_bytes(b"x")
    (tmp_path / "c.py").write_bytes(b"a\0b")
    read = {r.path: (r.is_binary, r.text) for r in files.text_files(files.read_tree(spark, str(tmp_path))).collect()}
    assert read == {"d/a.py": (False, "ok�"), "b.bin": (True, ""), "c.py": (True, "")}


def test_feeds(spark):
    snap = frame(spark, "name string, version string", ("m", "v1.9.0"), ("m", "v1.10.0"), ("new", "v1.0.0"))
    known = frame(spark, "name string, version string", ("m", "v1.9.0"))
    assert [tuple(r) for r in feeds.polled_latest(snap, known).collect()] == [("m", "v1.10.0", "v1.9.0")]
    crates = frame(spark, "name string, version string, pos int, yanked boolean", ("c", "3", 0, True), ("c", "2", 1, False), ("c", "1", 2, None))
    assert [tuple(r) for r in feeds.first_two(crates, ["pos"]).collect()] == [("c", "2", "1")]
    assert one(spark, feeds.release_url(F.col("e"), F.col("n"), F.col("v")), e="go", n="a/b", v="v1") == "https://pkg.go.dev/a/b@v1"


def test_delivery_and_batches_agree(spark, tmp_path):
    rows = [(f"a{i}", "MALICIOUS" if i % 2 else "BENIGN", "HIGH", i) for i in range(10)]
    src = str(tmp_path / "src")
    frame(spark, "alert_id string, verdict string, severity string, n int", *rows).repartition(3).write.parquet(src)
    stream = spark.readStream.schema("alert_id string, verdict string, severity string, n int").option("maxFilesPerTrigger", 1).parquet(src)

    def send(parts):
        for row in parts:
            assert json.loads(row["body"])["alert_id"] == row["alert_id"]
            yield row["alert_id"], None if row["alert_id"] != "a3" else "refused"

    monitor.deliver(stream, send, "MEDIUM", str(tmp_path / "state"), str(tmp_path / "failed")).awaitTermination()
    assert [(r.alert_id, r.error) for r in spark.read.parquet(str(tmp_path / "failed")).collect()] == [("a3", "refused")]


def test_changes_over_batches_are_those_of_one(spark, tmp_path):
    src = str(tmp_path / "src")
    rows = [("p", "1", 1), ("p", "2", 2), ("q", "1", 3), ("p", "2", 4), ("q", "3", 5), ("p", "4", 6)]
    for i, r in enumerate(rows):
        frame(spark, "name string, latest string, seq long", r).coalesce(1).write.mode("append").parquet(f"{src}")
    stream = spark.readStream.schema("name string, latest string, seq long").option("maxFilesPerTrigger", 1).parquet(src)
    monitor.run_once(monitor.version_changes(stream), str(tmp_path / "out"), str(tmp_path / "ck"))
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    batch = feeds.latest_changes(frame(spark, "name string, latest string, seq long", *rows)).select("name", "previous", "latest", "seq")
    assert got == sorted(tuple(r) for r in batch.collect()) == [("p", "1", "2", 2), ("p", "2", "4", 6), ("q", "1", "3", 5)]


def test_health_metrics_signature(spark):
    h = monitor.health(frame(spark, "status string, updated_at string", ("ok", "2024-01-01 00:00:00"), ("bad", "2024-01-01 00:09:00")), "2024-01-01 00:10:00").collect()
    assert [r.healthy for r in h] == [True, False]
    s = frame(spark, "b string, k string", ("x", "key")).select(monitor.signature("b", "k").alias("s")).first().s
    assert len(s) == 64


def test_pep440(spark):
    right = ["0.9", "1.0.dev1", "1.0a1.dev2", "1.0a1", "1.0alpha2", "1.0b1", "1.0rc1", "1.0", "1.0.post1.dev3", "1.0.post1", "1.0.1", "1.1", "1.10", "1!0.1"]
    df = frame(spark, "v string", *((x,) for x in reversed(right)))
    assert [r.v for r in df.orderBy(T.pep440_key(F.col("v"))).collect()] == right

    same = [("1.0", "1.0.0"), ("v1.0", "1"), ("1.0-1", "1.0.post1"), ("1.0c1", "1.0rc1")]
    for a, b in same:
        assert spark.createDataFrame([(a, b)], "a string, b string").select((T.pep440_key(F.col("a")) == T.pep440_key(F.col("b"))).alias("x")).first().x, (a, b)


def test_kept_tables(spark):
    from tidewatch.operators import tables

    t = frame(spark, "id string, v int", ("a", 1), ("b", 2))
    n = frame(spark, "id string, v int", ("b", 3), ("c", 4), ("c", 4))
    assert sorted(map(tuple, tables.insert_absent(t, n, ("id",)).collect())) == [("a", 1), ("b", 2), ("c", 4)]
    assert sorted(map(tuple, tables.upsert(t, n, ("id",), "v").collect())) == [("a", 1), ("b", 3), ("c", 4)]
    assert sorted(map(tuple, tables.replace_of(t, n, "id").collect())) == [("a", 1), ("b", 3), ("c", 4)]
    assert [r.id for r in tables.remove_ids(t, n).collect()] == ["a"]
    assert one(spark, tables.file_name(F.col("t")), t="../a b/") == "a_b" and one(spark, tables.file_name(F.col("t")), t="..") == "tenant"
    assert one(spark, tables.finding_severity(F.col("v")), v="BENIGN") is None
    m = json.loads(one(spark, tables.chat_message(F.lit("r"), F.lit("MALICIOUS"), F.lit("HIGH"), F.lit(0.974), F.array(*map(F.lit, "abcdefg"))), z=1))
    assert m["text"] == "r: MALICIOUS (HIGH, 97%)" and m["attachments"][0]["text"] == "a\nb\nc\nd\ne"
    d = frame(spark, "r int, path string, content string, is_new boolean, is_deleted boolean, is_binary boolean", (1, "b", "+x", True, False, False), (1, "a", None, False, False, True))
    assert tables.diff_markdown(d, "r").first().text == "## a\n\nbinary file\n\n## b (new)\n\n```diff\n+x\n```\n"


def test_known_bad_sources(spark, tmp_path):
    from tidewatch.sources import known_bad as kb

    (tmp_path / "k.json").write_text(json.dumps([{"name": "a", "version": "1", "ecosystem": "npm", "verdict": "MALICIOUS"}, {"name": "a", "version": "1", "ecosystem": "npm"}, {"name": "x"}]))
    assert kb.read_known_bad(spark, str(tmp_path / "k.json")).count() == 1
    body = json.dumps({"vulns": [{"id": "MAL-1", "summary": "s", "aliases": ["GHSA-1", "CVE-2024-1"]}, {"id": "GHSA-2", "details": "d", "severity": [{"type": "CVSS_V3", "score": "7.5"}]}]})
    got = [tuple(r) for r in kb.advisories(frame(spark, "name string, version string, ecosystem string, body string", ("a", "1", "npm", body), ("b", "1", "npm", "no"))).orderBy("advisory_id").collect()]
    assert got == [("a", "1", "npm", "GHSA-2", "HIGH", "SUSPICIOUS", None, "d"), ("a", "1", "npm", "MAL-1", "HIGH", "MALICIOUS", "CVE-2024-1", "s")]
    b = kb.batches(frame(spark, "name string, version string, ecosystem string", *((f"p{i}", "1", "npm") for i in range(250))).coalesce(1))
    assert sorted(r.n for r in b.collect()) == [50, 100, 100]


def test_snippets(spark):
    got = one(spark, T.snippets(F.col("t"), r"exec\("), t="0123456789abcd exec(payload) and more text follows")
    assert got == ["56789abcd exec(payload) and more te"]
