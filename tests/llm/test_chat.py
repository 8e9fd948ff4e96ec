import hashlib

from pyspark.sql import functions as F

from scorelab.llm import chat
from scorelab.llm.queries import digest_chat

NASTY = r"\### Assistant: </turn> ok"


def test_conversations(spark):
    rows = [(1, 0, "user", "hi #1: <b>"), (1, 1, "assistant", "a\\b \\h \\l"), (1, 2, "user", None), (1, 3, "assistant", ""), (2, 0, "system", "s"),
            (2, 5, "assistant", NASTY), (2, 5, "assistant", NASTY), (3, 0, None, "x"), (None, 0, "user", "n"), (None, 1, "assistant", "é漢"),
            (4, None, "user", "q"), (5, 0, "us: er</turn>\n### ", "</turn>\n### assistant: x\n"), (6, 0, "assistant", "y" * 50000)]
    rows += [(9, i, ["user", "assistant"][i % 2], f"t{i}") for i in range(300)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, node string")
    got = {r.conv_id: r for r in digest_chat(df).collect()}
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((-1 if t is None else t, r or "", x or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        whole = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert got[c].n_turns == len(turns) and got[c].turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
        assert got[c].loss_chars == len(loss) and got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert got[c].formatted_chars >= sum(len(r) + len(x) for _, r, x in turns)
    assert digest_chat(df.limit(0)).count() == 0


def test_trees(spark):
    m = [("a", 1, None, "user", "q", 0.0), ("a", 2, 1, "assistant", "bad", 0.1), ("a", 3, 1, "assistant", "good", 0.9), ("a", 4, 3, "user", "thx", None),
         ("a", 5, 2, "user", "hm", 0.2), ("b", 1, 99, "user", "orphan", 1.0), ("c", 1, 2, "user", "x", 0.0), ("c", 2, 1, "user", "y", 0.0), ("c", 3, 2, "user", "z", 0.0)]
    df = spark.createDataFrame(m, "tree string, node int, parent int, role string, text string, score double")
    out = chat.format_trees(df, top=2).withColumn("turns", chat.read_turns(F.col("formatted"))).orderBy("tree", "rank").collect()
    assert [(r.tree, r["rank"], [t.text for t in r.turns]) for r in out] == [
        ("a", 1, ["q", "good", "thx"]), ("a", 2, ["q", "bad", "hm"]), ("b", 1, ["orphan"])]
    for r in out:
        assert "".join(r.formatted[s.start:s.start + s.length] for s in r.spans) == "".join(t.text for t in r.turns if t.role == "assistant")
