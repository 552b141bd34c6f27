import hashlib
import re

import pytest
from pyspark.sql import functions as F

from glossa.llm import fill_middle as fim

SCHEMA = "doc_id long, text string, form string, n int, id int, output string, h string"


def docs(spark):
    rows = [(1, None), (2, ""), (3, "a <P> b"), (4, "né🦤 w\n"), (4, "né🦤 w\n"), (4, "other"), (None, "x y z"), (7, "ab " * 100_000), (8, "x"), (9, "🦤" * 256)]
    rows += [(i, "one two  three four\n" * (i % 7 + 1)) for i in range(20, 60)]
    return spark.createDataFrame([(*r, "", 0, 0, "", "") for r in rows], SCHEMA)


def plainly(doc_id, text, unit, rate, spm):
    text = text or ""
    units = [m.group() for m in re.finditer(f"{unit}|(?s:.)", text)]
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h3 % 100 >= rate:
        return len(units), "plain", None, None, text
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h4 % 100 < spm:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize(("unit", "rate", "spm"), [(fim.CODE_POINT, 90, 20), (r"\S+\s*|\s+", 100, 50), (r"[^\n]+\n?|\n", 95, 0)])
def test_equals_plain_code_and_comes_back(spark, unit, rate, spm):
    frame = docs(spark)
    rows = fim.fill_middle(frame, unit, rate, spm).withColumn("back", fim.restore(F.col("output"), F.col("form"))).collect()
    want = sorted((str(r["doc_id"]), *map(str, plainly(r["doc_id"], r["text"], unit, rate, spm)), r["text"] or "") for r in frame.collect())
    assert sorted((str(r["doc_id"]), *map(str, (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"])), r["back"]) for r in rows) == want


def test_odd_units_and_empty_tables(spark):
    with pytest.raises(ValueError, match="length"):
        fim.fill_middle(docs(spark), r"\s*")
    assert fim.fill_middle(docs(spark).limit(0)).count() == 0


def test_texts_are_shuffled_once(spark):
    """Runs are dealt out by their text's key alone, and all later steps keep to it."""
    plan = fim.fill_middle(docs(spark))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 3 and "Cartesian" not in plan and "NestedLoop" not in plan
