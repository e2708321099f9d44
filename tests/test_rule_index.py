"""The index of rules gives the findings of trying every rule on every line."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from riskloom.operators import rule_index
from riskloom.operators.findings import RULES, Rule, rule_table, scan
from riskloom.operators.rule_index import anchors, scan_indexed

FILES = "path string, text string"
COLUMNS = ["path", "line_number", "category", "severity", "confidence_score", "node_path"]


def rows(df):
    return Counter(tuple(r[c] for c in COLUMNS) for r in df.collect())


def many_rules(count):
    """Rules on calls of numbered functions; some share hints, some have two."""
    plain = [Rule(f"call-{i}", "LOW", 0.5, rf"\bfn_{i}\s*\(", (f"fn_{i}",)) for i in range(count)]
    return plain + [Rule("either", "HIGH", 0.7, r"(?i)(fn_7|zebra)\s*=", ("fn_7", "zebra"))]


@pytest.mark.parametrize("bound", [100_000, 0])
def test_a_thousand_rules_against_plain_python(spark, bound):
    rng, rules = random.Random(2), many_rules(1000)
    texts = [
        "\n".join(rng.choice(["fn_{}(1)", "x = fn_{} (2)", "Zebra = fn_{}", "fn_{}", "é fn_{}\t("]).format(rng.randrange(1200)) for _ in range(rng.randrange(30)))
        for _ in range(40)
    ]
    texts += ["y" * 700 + " fn_5(" + "z" * 253 + " fn_6(" + " ZEBRA=1", "fn_7 = zebra = fn_7(1)", "", "fn", None]
    files = [(f"f{i}", t) for i, t in enumerate(texts)]
    expected = Counter()
    for path, text in files:
        for number, line in enumerate((text or "").split("\n") if text is not None else [], 1):
            for r in rules:
                if any(h in line.lower() for h in r.hints) and (m := re.search(r.pattern, line, re.ASCII)):
                    expected[(path, number, r.category, r.severity, r.confidence, m.group(0))] += 1
    found = scan_indexed(spark.createDataFrame(files, FILES), "path", "text", rule_table(spark, rules), bound)
    assert expected and rows(found) == expected


def test_own_rules_with_and_without_hints(spark):
    text = "password = 'abcdefg'\nAPI_KEY=\"1234567\"; eval (x)\n10.0.0.1 ../../x\nselect a from b where c='\" + d\nhttp://é http://a"
    files = spark.createDataFrame([("a", text), ("b", text.upper()), ("c", "")], FILES)
    short = [*RULES, Rule("short", "LOW", 0.1, r"x\b", ("x",))]
    assert rows(scan_indexed(files, "path", "text", rule_table(spark, short))) == rows(scan(files, "path", "text", short))


def test_hints_are_filed_apart_and_empty_tables(spark):
    filed = anchors(rule_table(spark, many_rules(50))).collect()
    assert len(filed) == 52 and all(r.gram in r.hint for r in filed)
    none = spark.createDataFrame([], FILES)
    assert scan_indexed(none, "path", "text", rule_table(spark)).collect() == []
    one = spark.createDataFrame([("a", "eval(x)")], FILES)
    assert scan_indexed(one, "path", "text", rule_table(spark).limit(0)).collect() == []


def test_only_lines_that_meet_a_filed_trigram_go_on():
    """Trigrams of a text are looked up where they lie, none across two lines; they are not rows (F5)."""
    texts = ["xabcabc", "ab", "c", "", "ébc", "zzz bcd abc"]
    numbers = np.array([int.from_bytes(g, "big") for g in (b"abc", b"bcd", "éb".encode())])
    whole = pa.RecordBatch.from_pydict({"at": list(range(6)), "_lower": texts})
    found = [r for batch in rule_index._met(numbers)(iter([whole.slice(0, 0), whole.slice(0, 3), whole.slice(3)])) for r in batch.to_pylist()]
    assert {r["at"]: {n.to_bytes(3, "big") for n in r["_numbers"]} for r in found} == {0: {b"abc"}, 4: {"éb".encode()}, 5: {b"abc", b"bcd"}}
    assert all(len(r["_numbers"]) == len(set(r["_numbers"])) for r in found)
