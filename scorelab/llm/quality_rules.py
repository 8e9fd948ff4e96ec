"""Quality rules as a short-circuit cascade.

A document is kept if it passes the base test and every rule. Each rule's cost (seconds
a document) and selectivity (share rejected) are estimated on a bounded sample; rules
then run in order of rejection per cost, and a document leaves at its first failure.
The order decides only how much work is done, never which documents are kept."""

from __future__ import annotations

import time
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelab.llm.arrow import map_slices

SAMPLE = 1000   # documents on which costs and selectivities are estimated
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


class Doc:
    """A text with what the rules share; words are ``[^\\x20\\x09-\\x0D]+``."""

    def __init__(self, text: str | None):
        self.text = text or ""
        self.words = self.text.encode().split()
        self.n_words = len(self.words)
        self.word_chars = len(self.text) - sum(map(self.text.count, SPACE))
        self.n_symbols = sum(map(self.text.count, SYMBOLS))
        self.lines = [x for x in self.text.split("\n") if x.strip(SPACE)]
        self.n_dup_lines = len(self.lines) - len(set(self.lines))
        self.n_repeat_words = repeat_words(self.words)

    @property
    def base_failed(self) -> bool:
        return self.n_words < 50 or 100 * self.n_repeat_words > 50 * self.n_words


def repeat_words(words: list) -> int:
    """Words in 3-word windows that are found twice or more, the first included."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    times = Counter(windows)
    n = upto = 0
    for i, w in enumerate(windows):
        if times[w] > 1:
            n += i + 3 - max(i, upto)
            upto = i + 3
    return n


def _share(part: int, whole: int) -> float:
    return part / whole if whole else 0.0


#: Name -> whether the document fails.
RULES = {
    "symbols": lambda d: _share(d.n_symbols, d.n_words) > 0.1,
    "capitals": lambda d: _share(sum(1 for w in d.text.split() if len(w) > 1 and w.isupper()), d.n_words) > 0.2,
    "letters": lambda d: _share(sum(map(str.isalpha, d.text)), d.word_chars) < 0.6,
    "word_length": lambda d: not 2 <= _share(d.word_chars, d.n_words) <= 12,
    "longest_word": lambda d: max(map(len, d.words), default=0) > 2000,
    "duplicate_lines": lambda d: _share(d.n_dup_lines, len(d.lines)) > 0.3,
    "repeated_windows": lambda d: _share(d.n_repeat_words, d.n_words) > 0.3,
    "top_word": lambda d: _share(max(Counter(d.words).values(), default=0), d.n_words) > 0.3,
    "exclamations": lambda d: _share(d.text.count("!"), d.n_words) > 0.5,
    "compression": lambda d: _share(len(zlib.compress(d.text.encode(), 1)), len(d.text.encode())) < 0.1,
}


def estimate(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", sample: int = SAMPLE) -> dict[str, tuple[float, float]]:
    """Rule -> (seconds a document, share rejected) over about ``sample`` documents (never over twice as many) that pass
    the base test, chosen by a hash of the id (ids that occur often count once more at most)."""
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    # the ids are chosen without their texts; at most ``sample`` of them are broadcast to one scan
    chosen = rows.select("id").where("id is not null").distinct().orderBy(F.xxhash64(F.lit(1), "id"), "id").limit(sample)
    some = rows.join(F.broadcast(chosen), "id", "left_semi").limit(2 * sample)

    def measure(batches):
        cost, fails, seen = dict.fromkeys(RULES, 0.0), dict.fromkeys(RULES, 0), 0
        for b in batches:
            for text in b.column("text").to_pylist():
                d = Doc(text)
                if d.base_failed:
                    continue
                seen += 1
                for name, rule in RULES.items():
                    t = time.perf_counter()
                    fails[name] += bool(rule(d))
                    cost[name] += time.perf_counter() - t
        names = list(RULES)
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([cost[n] for n in names]), pa.array([fails[n] for n in names], pa.int64()),
                                          pa.array([seen] * len(names), pa.int64())], names=["rule", "cost", "fails", "seen"])

    rows = some.select("text").repartition(8).mapInArrow(measure, "rule string, cost double, fails bigint, seen bigint").groupBy("rule").agg(
        F.sum("cost").alias("cost"), F.sum("fails").alias("fails"), F.sum("seen").alias("seen")).collect()
    return {r["rule"]: (r["cost"] / max(1, r["seen"]), _share(r["fails"], r["seen"])) for r in rows}


def order_rules(estimates: dict[str, tuple[float, float]]) -> list[str]:
    """Rules by rejection per cost, most first; rules that rejected nothing by cost."""
    return sorted(estimates, key=lambda n: (-estimates[n][1] / max(estimates[n][0], 1e-9), estimates[n][0], n))


def apply_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: list[str] | None = None) -> DataFrame:
    """``id_col``, ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``,
    ``base_failed`` and ``kept`` for every row.

    ``order`` overrides the estimated order. Null and empty texts have no words and fail the
    base test. Rows are judged one by one, so ties, repeated rows and null ids need nothing;
    an empty table gives an empty result; extra columns are ignored."""
    order = order or order_rules(estimate(df, text_col, id_col)) or list(RULES)
    src = df.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    kind = src.schema["_id"].dataType.simpleString()

    def judge(part: pa.RecordBatch) -> dict:
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
        out: dict = {"_id": part.column("_id")} | {c: [] for c in names}
        for text in part.column("_text").to_pylist():
            d = Doc(text)
            failed = d.base_failed
            kept = not failed and not any(RULES[name](d) for name in order)   # any() stops at the first failure
            for c, x in zip(names, (d.n_words, d.word_chars, d.n_symbols, d.n_dup_lines, d.n_repeat_words, failed, kept)):
                out[c].append(x)
        return out

    schema = (f"`_id` {kind}, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
              "base_failed boolean, kept boolean")
    return map_slices(src, judge, schema, "_text").withColumnRenamed("_id", id_col)
