"""M2 with rules as data: a table of weighted line rules applied to texts.

Every rule may name a literal that each of its matches contains. A task compiles the literals into one
Aho-Corasick automaton, which finds all of them in one pass over a text; a rule's regular
expression is tried only on lines that hold its literal. So the cost follows the lines and the hits
of literals, not rules x lines. Rules without a literal are tried on every line."""

from __future__ import annotations

import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelab.functions.scale import _col, let
from scorelab.operators.metrics import score_from_counts

#: Rules that are sent to the executors at once (about 100 bytes each); more go in several rounds.
RULES_AT_ONCE = 20_000


class Matcher:
    """All rules of a round: ``(pattern, weight, literal or None)`` each."""

    def __init__(self, rules: list[tuple[str, float, str | None]]):
        import ahocorasick

        self.search = [re.compile(p).search for p, _, _ in rules]
        self.weight = [w for _, w, _ in rules]
        self.always = [i for i, r in enumerate(rules) if not r[2]]
        self.words = ahocorasick.Automaton()
        by_word: dict[str, list[int]] = {}
        for i, (_, _, literal) in enumerate(rules):
            if literal:
                by_word.setdefault(literal, []).append(i)
        for word, ids in by_word.items():
            self.words.add_word(word, ids)
        if by_word:
            self.words.make_automaton()
        self.tried = 0

    def penalty(self, text: str) -> tuple[float, int]:
        """Sum of the weights of (line, rule) matches, and the number of lines that are not blank."""
        lines = text.splitlines(keepends=True)
        bare = [line.splitlines()[0] if line else "" for line in lines]
        wanted = {(n, i) for n in range(len(lines)) for i in self.always}
        if len(self.words):
            starts = [0]
            for line in lines:
                starts.append(starts[-1] + len(line))
            for end, ids in self.words.iter(text):
                n = bisect_right(starts, end) - 1
                wanted.update((n, i) for i in ids)
        self.tried += len(wanted)
        # in a fixed order, so that sums of fractions come out the same each time
        return sum(self.weight[i] for n, i in sorted(wanted) if self.search[i](bare[n])), sum(1 for b in bare if b.strip())


def rule_table_score(df: DataFrame, rules: DataFrame, text: str = "text", keys=("doc_id",), at_once: int = RULES_AT_ONCE) -> DataFrame:
    """``keys``, ``penalty``, ``n_lines`` and ``raw_score`` (10 - 10 x penalty / lines that are not blank, floors as in ``rule_score``).

    ``rules`` has ``rule_id``, ``pattern`` (searched in each line), ``weight`` and ``literal`` (a string that every match
    contains, or null). They are counted; up to ``at_once`` are sent to the executors, more of them in rounds of that
    size, whose penalties are summed by ``keys`` (then unique). A null text has no score. No rules: no penalty."""
    keys, spark = list(keys), df.sparkSession
    rows = df.select(*keys, _col(text).alias("_text"))
    n = rules.count()
    rounds = max(1, -(-n // at_once))
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    # dealt by a hash for the rounds, so that each holds about its share; nothing is dropped at the edges
    numbered = rules.select("pattern", F.col("weight").cast("double").alias("weight"), "literal", "rule_id",
                            F.pmod(F.xxhash64("rule_id", "pattern"), F.lit(rounds)).alias("_round"))
    out = None
    for r in range(rounds):
        these = numbered.where(F.col("_round") == r).orderBy("rule_id", "pattern").collect()
        sent = spark.sparkContext.broadcast([(x["pattern"], x["weight"], x["literal"]) for x in these])

        def run(batches, sent=sent):
            matcher = Matcher(sent.value)
            for batch in batches:
                found = [(None, None) if t is None else matcher.penalty(t) for t in batch.column("_text").to_pylist()]
                penalty, lines = zip(*found) if found else ((), ())
                yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], pa.array(penalty, pa.float64()), pa.array(lines, pa.int32())],
                                                 names=[*keys, "penalty", "n_lines"])

        part = rows.mapInArrow(run, f"{kinds}, penalty double, n_lines int")
        out = part if out is None else out.unionByName(part)
    if rounds > 1:
        out = out.groupBy(*keys).agg(F.sum("penalty").alias("penalty"), F.first("n_lines").alias("n_lines"))
    score = F.when(F.col("n_lines").isNotNull(), let(F.struct("penalty", "n_lines"), score_from_counts))
    return out.select(*keys, "penalty", "n_lines", score.alias("raw_score"))
