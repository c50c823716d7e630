"""Queries and operators on the whole of their input."""

from pyspark.sql import functions as F

from tidewatch.operators import syntax
from tidewatch.plans import bindings as B
from tidewatch.plans import queries as q

SF = "/root/testdata/sf0.001"


def test_file_diff_takes_every_document(spark):
    d = B.documents(spark, SF)
    changed = d.where("doc_id % 10 = 3 or doc_id % 10 = 7 or doc_id % 3 = 0").count()
    assert q.QUERIES["q_file_diff_whole"](spark, SF).agg(F.sum("files_changed")).first()[0] == changed


def test_rot13_and_hex_take_whole_texts(spark):
    made = q.QUERIES["q_rot13_hex_whole"](spark, SF).join(B.documents(spark, SF).select("doc_id", "text"), "doc_id")
    assert made.where("again <> text or length(turned) <> length(text)").isEmpty()
    assert made.agg(F.max(F.length("turned"))).first()[0] > 40


def test_syntax_of_long_files_and_of_all_forms(spark):
    long = ["e = exec"] + ["x = '" + "y" * 990 + "'"] * 1100 + ["if os.getenv('CI'):", "    e('x')"]
    files = {"long": long, "paren": ["if(os.environ.get('CI')): pass"], "elif": ["if(a): pass", "elif(date.today() > x): pass"], "F": ['u = F"{os.environ}"'], "Rf": ["u = Rf'''{os.environ}'''"], "fR": ["u = fR'{os.environ}'"], "wide": ["\uff45val('x')"]}
    df = spark.createDataFrame([(f, i, i, x) for f, lines in files.items() for i, x in enumerate(lines, 1)], "f string, seq int, line_number long, line string")
    got = sorted((r.f, r.finding_id, r.line_number) for r in syntax.syntax_findings(df, "f").collect())
    assert got == [("F", "FSTRING_ENV_EMBED", 1), ("Rf", "FSTRING_ENV_EMBED", 1), ("elif", "TIME_BOMB_CHECK", 2), ("fR", "FSTRING_ENV_EMBED", 1), ("long", "ALIASED_EXEC", 1103), ("long", "CI_SANDBOX_CHECK", 1102), ("paren", "CI_SANDBOX_CHECK", 1), ("wide", "DIRECT_EXEC_EVAL", 1)]
