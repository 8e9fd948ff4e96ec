import random
import re

from scorelab.llm import quality_rules as q


def brute(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    cov = set()
    for i in range(len(words) - 2):
        if any(words[i:i + 3] == words[j:j + 3] for j in range(len(words) - 2) if j != i):
            cov |= {i, i + 1, i + 2}
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cov), n < 50 or 100 * len(cov) > 50 * n


def test_against_brute_force(spark):
    rnd = random.Random(8)
    pool = ["é", "the", "of", "a#", "|", "x\x85y", "\xa0", " ", "Word", "ABC!!", "1234"]
    texts = ["".join(rnd.choice(pool) + rnd.choice([" ", "\n", "\t", "  ", "\x0b", "\x1c"]) for _ in range(rnd.randint(0, 150))) for _ in range(150)]
    texts += [" ".join("".join(rnd.choices("abcdefghijk", k=7)) for _ in range(n)) for n in (49, 50, 51, 5000)]
    texts += [None, "", "\n\n", "x" * 100000, "same line here\n" * 60, " ".join(f"ok{i}***" for i in range(80)), "ONE TWO " + " ".join(f"W{i}A".upper() for i in range(90))]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(None, "a b", 0), (0, texts[0], 0)], "doc_id long, text string, kept int")
    got = q.apply_rules(df).collect()
    assert len(got) == len(texts) + 2
    other = {r.doc_id: r.kept for r in q.apply_rules(df, order=sorted(q.RULES, reverse=True)).collect()}
    for r in got:
        if r.doc_id is not None:
            t = texts[r.doc_id]
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(t), repr(t)[:80]
            assert r.kept == (not r.base_failed and not any(f(q.Doc(t)) for f in q.RULES.values())) == other[r.doc_id]
    kept = {r.doc_id: r.kept for r in got}
    n = 150
    assert [kept[i] for i in range(n, n + 4)] == [False, True, True, True] and not any(kept[i] for i in range(n + 4, len(texts)))
    assert q.apply_rules(df.limit(0)).count() == 0


def test_order():
    assert q.order_rules({"a": (1.0, 0.1), "b": (0.1, 0.1), "c": (0.5, 0.0), "d": (0.2, 0.0)}) == ["b", "a", "d", "c"]
