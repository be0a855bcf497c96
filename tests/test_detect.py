"""Detection: stated cases, and random texts against a model of the patterns in Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from spanlake.functions.patterns import PATTERNS
from spanlake.operators.detect import detect, explode_entities

SPACE = "\t\n\x0b\f\r    -     　﻿"

CASES = [
    ("My SSN is 123-45-6789.", [("SSN", "123-45-6789")]),
    ("SSN: 123 45 6789", [("SSN", "123 45 6789")]),
    ("SSN: 123456789", [("SSN", "123456789")]),
    ("SSN1: 123-45-6789 and SSN2: 987-65-4321", [("SSN", "123-45-6789"), ("SSN", "987-65-4321")]),
    ("Card: 4111-1111-1111-1111", [("CREDIT_CARD", "4111-1111-1111-1111")]),
    ("Card: 4111111111111111", [("CREDIT_CARD", "4111111111111111")]),
    ("Contact me at john.doe@example.com please.", [("EMAIL", "john.doe@example.com")]),
    ("From a@b.com to c@d.net", [("EMAIL", "a@b.com"), ("EMAIL", "c@d.net")]),
    ("Call (555) 123-4567", [("PHONE", "(555) 123-4567")]),
    ("Call +1-555-123-4567", [("PHONE", "+1-555-123-4567")]),
    ("555.123.4567", [("PHONE", "555.123.4567")]),
    ("Born on 01/15/1990", [("DATE", "01/15/1990")]),
    ("Date: 2024-03-15", [("DATE", "2024-03-15")]),
    ("12345-123-4567", [("PHONE", "345-123-4567")]),
    ("5 days on the way", [("ADDRESS", "5 days on the way")]),
    ("10 Main St. next", [("ADDRESS", "10 Main St")]),
    ("2024-03-15.x@y.co", [("EMAIL", "2024-03-15.x@y.co")]),
    ("é123-45-6789", [("SSN", "123-45-6789")]),
    ("123 45 6789", [("SSN", "123 45 6789")]),
    ("The quick brown fox jumps over the lazy dog.", []),
    ("", []),
    (None, []),
]


def model(text):
    found = []
    for i, (category, flags, p) in enumerate(PATTERNS):
        out, inside, k = [], False, 0
        while k < len(p):
            two = p[k : k + 2]
            if two == r"\s":
                out.append(SPACE if inside else f"[{SPACE}]")
                k += 2
            elif two[0] == "\\":
                out.append(two)
                k += 2
            else:
                inside = two[0] == "[" or inside and two[0] != "]"
                out.append(two[0])
                k += 1
        for m in re.finditer("".join(out), text, re.A | (re.I if flags else 0)):
            found.append((m.start(), i, m.end(), category, m[0]))
    kept, end = [], -1
    for e in sorted(found):
        if e[0] >= end:
            kept.append(e)
            end = e[2]
    return kept


def test_stated_cases(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "id int, text string")
    got = {r.id: [(e.category, e.text) for e in r.entities] for r in detect(rows).collect()}
    assert got == {i: e for i, (_, e) in enumerate(CASES)}


def test_random_texts_agree_with_the_model(spark):
    rng = random.Random(5)
    parts = ["123", "45", "6789", "4111", "-", " ", ".", "/", "(", ")", "+1", "a@b.co", "é", " ", "\U0001f600", "\n", "Jan", "may", "2024", "12", "Main", "St", "way", "P.O.", "Box", "_", "%", ",", "x"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 25))) for _ in range(1500)]
    rows = detect(spark.createDataFrame(list(enumerate(texts)), "id int, text string")).select("id", "entities").collect()
    for r in rows:
        assert [tuple(e) for e in r.entities] == model(texts[r.id]), texts[r.id]


def test_rows_and_keys(spark):
    rows = spark.createDataFrame([(7, "a@b.com and c@d.com")], "doc_id int, text string")
    got = explode_entities(detect(rows), "doc_id").orderBy("ord").collect()
    assert [r.entity_id for r in got] == ["7-0-7-EMAIL", "7-12-19-EMAIL"]
    assert all(r.accepted and r.confidence == 1.0 and r.source == "regex" for r in got)


def test_detection_needs_no_shuffle_and_no_python(spark):
    plan = detect(spark.range(1).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


@pytest.mark.parametrize("name", ["SSN", "CREDIT_CARD", "EMAIL", "PHONE", "DATE", "ADDRESS"])
def test_every_category_has_a_pattern(name):
    assert any(c == name for c, _, _ in PATTERNS)
