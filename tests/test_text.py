"""Text expressions and metrics on cases that the driver tables don't reach."""

from __future__ import annotations

import math
import re
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.functions import metrics as M
from quarry.functions import text as X


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column).first()[0]


def test_clean_text_steps(spark):
    raw = "“Quote” — dash…\x07\n=====\n  a \t b c  \n 42 \n\n\n\n●  point\n​end  "
    assert one(spark, X.clean_text("v"), raw) == '"Quote" - dash...\n\na b c\n• point\nend'
    assert one(spark, X.clean_text("v"), None) == ""


def test_normal_forms(spark):
    assert one(spark, X.normalize_answer("v"), " Étion, d'ÉTÉ!  x_1 ") == "étion d été x_1"
    assert one(spark, X.norm("v"), " ISO-20022: Été ") == "iso 20022 t"
    assert one(spark, X.alnum("v"), "Charge Bearer-1") == "chargebearer1"
    assert one(spark, X.slug("v"), " Code_Value  (ISO) – x ") == "code-value-iso-x"


@pytest.mark.parametrize(
    ("name", "noise"),
    [("+358 40 1234567", True), ("a@b.fi", True), ("https://x", True), ("www.x.y", True), ("ABCDEF0123456789ABCDEF01", True), ("FI2112345600000785", True), ("x", True), (None, True), ("001", False), ("AOS1", False), ("Visit www.x", False)],
)
def test_noise(spark, name, noise):
    assert one(spark, X.is_noise(F.col("v")), name) is noise


def test_mappings_are_one_hop(spark):
    assert one(spark, X.entity_type(F.col("v")), "CodeValue") == "Code"
    assert one(spark, X.entity_type(F.col("v")), None) == "Concept"
    assert one(spark, X.relation(F.col("v")), "DEVELOPS") == "DEVELOPED_BY"
    assert one(spark, X.relation(F.col("v")), "works with") == "WORKS_WITH"
    assert one(spark, X.relation(F.col("v"), ("works with",)), "works with") == "works with"
    assert one(spark, X.graph_label(F.col("v")), "a-b c.d") == "A_B_C_D"


def test_pages_and_lines(spark):
    assert one(spark, X.first_page(F.col("v")), ["x", "1", "99", "7"], "array<string>") == 7
    assert one(spark, X.first_page(F.col("v")), ["x"], "array<string>") is None
    assert one(spark, X.preview(F.col("v"), 3), "abcd") == "abc..."
    line = one(spark, X.source_line(F.lit(3), F.lit(1), F.lit(2), F.col("v")), "some\ntext")
    assert line == "[Source (chunk 3, pages 1-2)] some\ntext"
    assert tuple(one(spark, X.parse_source_line(F.col("v")), line)) == (3, 1, 2, "some\ntext")
    assert one(spark, X.context_kind(F.col("v")), "it Contains x") == "relationship"


@pytest.mark.parametrize(
    ("answer", "want"),
    [('{"a": 1}', '{"a": 1}'), ('Sure:\n```json\n{"a": 2}\n```\nbye', '{"a": 2}'), ('It is {"a": {"b": 3}} so', '{"a": {"b": 3}}'), ("none", '{"entities": [], "relationships": []}'), (None, '{"entities": [], "relationships": []}')],
)
def test_json_repair(spark, answer, want):
    assert one(spark, X.repair_json(F.col("v")), answer) == want


def plain(answer, truth, contexts):
    def words(t):
        return re.sub(r"\s+", " ", re.sub(r"[^\w\s]", " ", t.lower())).split()

    a, g = words(answer), words(truth)
    same = sum((Counter(a) & Counter(g)).values())
    f1 = 2 * (same / len(a)) * (same / len(g)) / (same / len(a) + same / len(g)) if same else 0.0
    acc = len(set(a) & set(g)) / len(set(g)) if g else 0.0
    text = " ".join(c.lower() for c in contexts if c)
    faith = 1.0 if not answer else 0.0 if not contexts or not text else sum(w in text for w in a) / len(a) if a else 1.0
    per = [len(set(g) & set(words(c))) / len(set(words(c))) if words(c) else 0.0 for c in contexts]
    prec = 0.0 if not contexts else 1.0 if not g else sum(per) / len(per)
    rec = 0.0 if not contexts else 1.0 if not g else len(set(g) & {w for c in contexts for w in words(c)}) / len(set(g))
    hall = 0.0 if not answer else 1.0 if not contexts else 1 - faith
    cite = 0.0 if not answer else 0.5 * faith + 0.5 * acc
    return (1.0 if " ".join(a) == " ".join(g) else 0.0, f1, acc, faith, prec, rec, hall, cite, acc)


TEXT = st.text(alphabet="abé1 .,-", max_size=14)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(TEXT, TEXT, st.lists(TEXT, max_size=3)), min_size=8, max_size=20))
def test_metrics_match_plain_versions(spark, rows):
    rows += [("", "x", ["x"]), ("x", "", ["y"]), ("x x y", "x y", []), ("a", "a", [""])]
    df = spark.createDataFrame(rows, "answer string, truth string, contexts array<string>").coalesce(1)
    got = M.with_metrics(df).select(*M.NAMES).collect()
    for r, g in zip(rows, got):
        assert all(math.isclose(x, y, abs_tol=1e-9) for x, y in zip(g, plain(*r))), (r, tuple(g), plain(*r))
