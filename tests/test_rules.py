"""Rules as a table: equal to trying every rule on every line, at a cost that follows the hits."""

import random
import re

import pytest

from scorelab.operators import rules

WORDS = ["alpha", "alphabet", "beta", "gamma", "été", "x", ".", "  ", "\t", "TODO"]


def texts(n=60, seed=4):
    rnd = random.Random(seed)
    return [(i, rnd.choice(["\n", "\r\n", "\x0b"]).join(" ".join(rnd.choices(WORDS, k=rnd.randint(0, 12))) for _ in range(rnd.randint(0, 9)))) for i in range(n)]


TABLE = [("a", r"alpha[a-z]*", 0.5, "alpha"), ("b", r"^\s*beta", 1.0, "beta"), ("c", r"TODO$", 0.25, "TODO"), ("d", r"\s{2,}", 0.125, None),
         ("e", r"été", 2.0, "été"), ("f", r"gamma gamma", 1.0, "gamma gamma"), ("g", r"missing", 1.0, "missing"), ("h", r"^x$|alpha x", 1.0, None)]


def brute(text, table=TABLE):
    lines = text.splitlines()
    return sum(w for line in lines for _, p, w, _ in table if re.search(p, line)), sum(1 for line in lines if line.strip())


@pytest.mark.parametrize("at_once", [1000, 3])
def test_equals_every_rule_on_every_line(spark, at_once):
    rows = texts()
    df = spark.createDataFrame(rows + [(100, ""), (101, "\n\n")], "doc_id int, text string")
    table = spark.createDataFrame(TABLE, "rule_id string, pattern string, weight double, literal string")
    got = {r["doc_id"]: r for r in rules.rule_table_score(df, table, at_once=at_once).collect()}
    assert len(got) == len(rows) + 2
    for i, text in rows:
        penalty, n = brute(text)
        assert (got[i]["penalty"], got[i]["n_lines"]) == (penalty, n)
        raw = 10 - 10 * penalty / n if n else 0
        assert got[i]["raw_score"] == pytest.approx(raw if raw else 0.05)


def test_nulls_and_no_rules(spark):
    df = spark.createDataFrame([(1, None), (2, "a\nb")], "doc_id int, text string")
    none = spark.createDataFrame([], "rule_id string, pattern string, weight double, literal string")
    got = {r["doc_id"]: tuple(r)[1:] for r in rules.rule_table_score(df, none).collect()}
    assert got == {1: (None, None, None), 2: (0.0, 2, 10.0)}
    assert rules.rule_table_score(df.limit(0), none).count() == 0


def test_cost_follows_hits_not_rules(spark):
    """A thousand rules whose literals do not occur cost no regular expression at all."""
    many = [(rf"word{i}[0-9]", 1.0, f"word{i}") for i in range(1000)] + [("alpha", 1.0, "alpha")]
    matcher = rules.Matcher(many)
    lines = sum(len(t.splitlines()) for _, t in texts())
    for _, text in texts():
        matcher.penalty(text)
    assert 0 < matcher.tried <= lines


def test_same_line_counts_once_for_a_rule_and_fixed_order():
    m = rules.Matcher([("a", 0.5, "a"), ("a", 0.25, "a"), ("b", 2.0, None)])
    assert m.penalty("a a a b\nb") == (4.75, 2)
