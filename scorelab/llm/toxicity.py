"""Toxicity by weak supervision.

1. Candidate terms (words and word beginnings) are counted in a bounded sample of
   labelled documents outside the held-out fold; the ones that go with the label stay.
2. Voters are chosen among them (each document of the label is covered several times by
   terms that are not parts of each other), beside a general word list and patterns. A
   voter votes toxic or abstains.
3. A generative label model, P(votes given the class), has for each voter the rates of
   voting and abstaining in clean texts and in each of several kinds of toxic ones, and
   correlation terms for pairs of voters that go together though the class is known. EM
   maximises the likelihood with the class latent; given labels only say where it starts, and so
   which classes are toxic. It yields a posterior label for each sampled document.
4. A linear classifier on all candidate terms is trained on the posterior labels and
   scores every text."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from scorelab.llm.arrow import map_slices
from scorelab.llm.samples import fold, labelled_sample

SAMPLE = 12_000     # most labelled documents that terms, label model and classifier are fitted on
TERMS = 3_000       # most candidate terms
VOTERS = 64         # most term voters
KINDS = 8           # classes of toxic texts in the label model
ANCHOR = 1.0        # weight of a labelled document in the prior of the label model's rates
SHORT, LONG = 3, 9  # letters of word beginnings
CACHE = 300_000     # words remembered by a worker
WORD = re.compile(r"[^\W\d_]+")

#: General insults that vote whether or not the sample holds them.
LEXICON = ["asshole", "bastard", "bitch", "clown", "crap", "cretin", "disgusting", "dumbass", "fool", "freak", "garbage", "idiot", "imbecile",
           "jerk", "loser", "moron", "pathetic", "pig", "scum", "shit", "slut", "stupid", "trash", "vermin", "whore", "worthless"]
#: Patterns on the whole text that vote.
PATTERNS = {
    "shouting": re.compile(r"(?:\b[A-Z]{3,}\b[^A-Za-z]+){6}"),
    "insulted reader": re.compile(r"(?i)\byou(?:'re| are)? (?:\w+ )?(?:" + "|".join(LEXICON) + r")s?\b"),
    "wish of harm": re.compile(r"(?i)\b(?:kill yourself|go die|drop dead|shut up)\b"),
}


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall(text.lower())) if text else set()


def terms_of(word: str) -> list[str]:
    """The word itself (as ``=word``) and its beginnings."""
    return ["=" + word, *(word[:k] for k in range(SHORT, min(LONG, len(word)) + 1))]


class Terms:
    """Finds the known terms of texts, remembering a bounded number of words."""

    def __init__(self, terms: list[str]):
        self.ids, self.seen = {t: i for i, t in enumerate(terms)}, {}

    def find(self, text: str | None) -> list[int]:
        words = words_of(text)
        new = words.difference(self.seen)
        if new:
            if len(self.seen) + len(new) > CACHE:
                self.seen.clear()
                new = words
            for w in new:
                self.seen[w] = tuple(self.ids[t] for t in terms_of(w) if t in self.ids)
        return sorted({i for w in words for i in self.seen[w]})


def mine(sample: DataFrame, most: int = TERMS) -> list[dict]:
    """Terms with their document counts by label, most telling first: those in at least two
    documents of the label and at least five times as likely there as elsewhere."""
    def count(batches):
        found: dict[str, list[int]] = {}

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array([a for a, _ in found.values()], pa.int64()),
                                               pa.array([b for _, b in found.values()], pa.int64())], names=["term", "pos", "neg"])
        for batch in batches:
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist()):
                for term in {t for w in words_of(text) for t in terms_of(w)}:
                    found.setdefault(term, [0, 0])[0 if y == 1 else 1] += 1
                if len(found) > CACHE:
                    yield out()
                    found = {}
        yield out()

    total = sample.agg(F.sum((F.col("y") == 1).cast("int")).alias("p"), F.sum((F.col("y") != 1).cast("int")).alias("n")).first()
    p, n = (total["p"] or 0) + 1.0, (total["n"] or 0) + 1.0
    counts = sample.mapInArrow(count, "term string, pos bigint, neg bigint").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    odds = F.log((F.col("pos") + 0.5) / p / ((F.col("neg") + 0.5) / n))
    rows = counts.where("pos >= 2").withColumn("odds", odds).where(F.col("odds") > np.log(5)).orderBy(
        F.desc(F.col("pos") * F.col("odds")), "term").limit(most).collect()
    return [r.asDict() for r in rows]


def choose_voters(terms: list[dict], docs: list[list[int]], y: np.ndarray, cover: int = 3) -> list[int]:
    """Terms that vote, of those at least four times as often with the label: taken by how many documents of the label they cover that have fewer
    than ``cover`` voters, none that begins with, or is the beginning of, one taken before."""
    at: dict[int, set[int]] = {}
    for d, found in enumerate(docs):
        if y[d]:
            for i in found:
                if terms[i]["pos"] >= 4 * terms[i]["neg"]:
                    at.setdefault(i, set()).add(d)
    need, chosen = dict.fromkeys(np.flatnonzero(y).tolist(), cover), []
    names = [t["term"].lstrip("=") for t in terms]
    while at and len(chosen) < VOTERS:
        gain = {i: sum(need[d] > 0 for d in ds) for i, ds in at.items()}
        best = max(gain, key=lambda i: (gain[i], -i))
        if gain[best] < 2:
            break
        chosen.append(best)
        for d in at[best]:
            need[d] -= 1
        at = {i: ds for i, ds in at.items() if not (names[i].startswith(names[best]) or names[best].startswith(names[i]))}
    return chosen


def forest(votes: np.ndarray, post: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A parent for each voter (or the number of voters: none), and the voters' mutual information given
    the class, where ``post`` (classes x documents) says how likely a document is in each.

    Pairs whose information pays for its parameter in each class (BIC) are joined, the
    strongest first, as long as they close no circle (Chow and Liu's tree, cut to a forest)."""
    n, j = votes.shape
    info = np.zeros((j, j))
    for w in post:
        mass = max(w.sum(), 1e-9)
        both = (votes * w[:, None]).T @ votes / mass
        one = np.diag(both)
        for u, cell in (((1, 1), both), ((1, 0), one[:, None] - both), ((0, 1), one[None, :] - both), ((0, 0), 1 - one[:, None] - one[None, :] + both)):
            apart = np.where(u[0], one, 1 - one)[:, None] * np.where(u[1], one, 1 - one)[None, :]
            cell = np.clip(cell, 0, 1)
            info += mass * np.where((cell > 1e-12) & (apart > 1e-12), cell * np.log(np.maximum(cell, 1e-12) / np.maximum(apart, 1e-12)), 0)
    p, q = np.nonzero(np.triu(2 * info > len(post) * np.log(max(n, 2)), 1))
    group, near = list(range(j)), {v: [] for v in range(j)}
    for k in np.argsort(-info[p, q], kind="stable").tolist():
        u, v = int(p[k]), int(q[k])
        if group[u] != group[v]:
            gone, to = group[u], group[v]
            group = [to if g == gone else g for g in group]
            near[u].append(v)
            near[v].append(u)
    parent, done = np.full(j, j), set()
    for start in range(j):
        todo = [start] if start not in done else []
        done.add(start)
        while todo:
            u = todo.pop()
            for v in near[u]:
                if v not in done:
                    done.add(v)
                    parent[v] = u
                    todo.append(v)
    return parent, info / max(n, 1)


def first_classes(votes: np.ndarray, y: np.ndarray, kinds: int, sure: float = 0.95) -> np.ndarray:
    """Where EM starts (classes x documents): class 0 is clean, the others are kinds of toxic texts.

    The voter of most documents with the label that have no kind yet makes the next kind;
    those of no such voter are of the last. A document is ``sure`` to have its given label."""
    of, free = np.full(len(y), kinds - 1), y == 1
    for k in range(kinds - 1):
        n = votes[free].sum(0)
        if n.max(initial=0) < 2:
            break
        here = free & (votes[:, int(n.argmax())] > 0)
        of[here] = k
        free &= ~here
    toxic = np.where(y == 1, sure, 1 - sure)
    post = np.empty((kinds + 1, len(y)))
    post[0] = 1 - toxic
    for k in range(kinds):   # a document labelled clean is no kind more than another
        post[1 + k] = toxic * np.where(y == 1, of == k, 1 / kinds)
    return post


def label_model(votes: np.ndarray, y: np.ndarray, kinds: int = KINDS, rounds: int = 200, strength: float = 2.0, anchor: float = ANCHOR) -> dict:
    """A generative model of votes with a latent label, fitted by EM.

    ``votes`` (documents x voters) marks who votes toxic; the others abstain. Toxic texts are of several
    ``kinds`` (insults of one language rarely meet those of another), which with the clean texts are the
    classes. The likelihood of a document is the sum over classes c of P(c) times the product over voters j of
    P(vote_j | vote of j's parent, c): in each class a voter has a rate of voting and of abstaining,
    and voters that go together even when the class is known are joined by an edge (``forest``), so that
    one that repeats another adds nothing. Edges are chosen once, after EM with independent voters.
    The given labels ``y`` are no part of the likelihood; they anchor the classes: EM starts from them, and
    rates and class shares have a prior that counts each document of that start with weight ``anchor``
    (0: none). A document's posterior comes from its votes, whatever its own label. Rates also have a Beta
    prior of ``strength`` documents around the voter's overall rate. ``objective`` lists log-likelihood
    plus log-prior of each round, and never falls.
    ``posterior`` is the chance of a toxic class; ``accuracy`` that of a document a voter votes on."""
    n, j = votes.shape
    rate = np.clip(votes.mean(0) if n else np.zeros(j), 0.5 / max(n, 1), 1 - 0.5 / max(n, 1))
    post, objective = first_classes(votes, y, kinds), []
    first = anchor * post
    parent, info = np.full(j, j), np.zeros((j, j))
    for phase in range(2):
        if phase:
            parent, info = forest(votes, post)
        above = np.column_stack([votes, np.zeros(n)])[:, parent]     # the parent's vote; none: 0
        cells = [(1 - above) * (1 - votes), (1 - above) * votes, above * (1 - votes), above * votes]
        trace: list[float] = []
        for _ in range(rounds):
            base = ((post + first).sum(1) + 1) / (n * (1 + anchor) + len(post))
            no0, yes0, no1, yes1 = ((post + first) @ c for c in cells)
            told = np.stack([(yes0 + strength * rate) / (no0 + yes0 + strength), (yes1 + strength * rate) / (no1 + yes1 + strength)])
            stay, vote = np.log1p(-told), np.log(told)                # by the parent's vote, class and voter
            joint = np.log(base)[:, None] + stay[0] @ cells[0].T + vote[0] @ cells[1].T + stay[1] @ cells[2].T + vote[1] @ cells[3].T
            prior = strength * (rate * vote + (1 - rate) * stay).sum() + np.log(base).sum() + (first * joint).sum()
            top = joint.max(0, initial=-np.inf)
            post = np.exp(joint - top)
            total = post.sum(0)
            post = post / total
            trace.append(float((np.log(total) + top).sum() + prior))
            if len(trace) > 1 and trace[-1] - trace[-2] < 1e-7 * (1 + abs(trace[-1])):
                break
        objective.append(trace)
    toxic = post[1:].sum(0)
    return {"accuracy": (votes.T @ toxic + 1) / (votes.sum(0) + 2), "rates": told, "parent": parent, "information": info, "base": base,
            "objective": objective, "posterior": toxic}


def linear(docs: list[list[int]], target: np.ndarray, width: int, l2: float = 0.01, rounds: int = 500) -> tuple[np.ndarray, float]:
    """Logistic regression on present terms against soft labels; weights are not negative (Adam on all rows)."""
    row = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    col = np.array([i for d in docs for i in d], np.int64)
    w, b, n = np.zeros(width), 0.0, max(len(docs), 1)
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for k in range(1, rounds + 1):
        z = np.bincount(row, w[col], len(docs)) + b
        off = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - target
        g = np.append(np.bincount(col, off[row], width) + l2 * w, off.sum()) / n
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.1 * (1 - k / (rounds + 1)) * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-10)
        w, b = np.maximum(w - step[:-1], 0), b - step[-1]
    return w, float(b)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, held_out: int = 0, sample: int = SAMPLE, **cols) -> dict:
    """Fit voters, label model and classifier on at most ``sample`` labelled documents outside the held-out fold."""
    from scorelab.llm.store import written

    some = written(labelled_sample(docs, labels, label, folds, held_out, sample, **cols), "toxicity-sample")
    terms = mine(some)
    known = {t["term"] for t in terms}
    terms += [{"term": "=" + w, "pos": 0, "neg": 0} for w in LEXICON if "=" + w not in known]
    names = [t["term"] for t in terms]

    def find(part: pa.RecordBatch, state: Terms) -> dict:
        texts = part.column("text").to_pylist()
        return {"found": [state.find(t) for t in texts], "y": [int(y == 1) for y in part.column("y").to_pylist()],
                "patterns": [[i for i, p in enumerate(PATTERNS.values()) if t and p.search(t)] for t in texts]}

    rows = map_slices(some, find, "found array<int>, patterns array<int>, y int", "text", setup=lambda: Terms(names)).collect()
    rows.sort(key=lambda r: (r["y"], r["found"], r["patterns"]))
    found, y = [list(r["found"]) for r in rows], np.array([r["y"] for r in rows], float)
    voters = choose_voters(terms, found, y)
    voters += [i for i, t in enumerate(terms) if t["term"][1:] in LEXICON and t["term"][0] == "=" and i not in voters]
    place = {v: k for k, v in enumerate(voters)}
    votes = np.zeros((len(rows), len(voters) + len(PATTERNS)))
    for d, r in enumerate(rows):
        votes[d, [place[i] for i in found[d] if i in place]] = 1
        votes[d, [len(voters) + i for i in r["patterns"]]] = 1
    model = label_model(votes, y)
    weights, bias = linear(found, model["posterior"], len(names))
    if not y.any():
        weights, bias = np.zeros(len(names)), -5.0
    return {"terms": names, "weights": weights, "bias": bias, "voters": [names[i] for i in voters] + list(PATTERNS), "label_model": model}


def score(docs: DataFrame, model: dict, folds: int = 5, held_out: int = 0, cut: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``held_out``, ``score`` (0 to 1, higher: more toxic) and ``predicted`` of every row.

    Only the text is an input of the score; null and empty texts score like a text
    without a term. Rows are scored one by one, so ties, repeated rows and null ids need
    nothing; an empty table gives an empty result; extra columns are ignored."""
    src = docs.select(F.col(f"`{id_col}`").alias("_id"), (fold(id_col, folds) == held_out).alias("held_out"), F.col(f"`{text_col}`").alias("_text"))
    kind = src.schema["_id"].dataType.simpleString()
    keep = [i for i, w in enumerate(model["weights"]) if w > 0]
    names, weights, bias = [model["terms"][i] for i in keep], model["weights"][keep], model["bias"]

    def run(part: pa.RecordBatch, state: Terms) -> dict:
        z = [bias + float(weights[found].sum()) if (found := state.find(t)) else bias for t in part.column("_text").to_pylist()]
        s = (1 / (1 + np.exp(-np.clip(z, -50, 50)))).tolist()
        return {"_id": part.column("_id"), "held_out": part.column("held_out"), "score": s, "predicted": [int(x >= cut) for x in s]}

    out = map_slices(src, run, f"`_id` {kind}, held_out boolean, score double, predicted int", "_text", setup=lambda: Terms(names))
    return out.withColumnRenamed("_id", id_col)


def drop_toxic(docs: DataFrame, model: dict, cut: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text scores less than ``cut``."""
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text_col}`").alias("_text"))
    keep = [i for i, w in enumerate(model["weights"]) if w > 0]
    names, weights, bias = [model["terms"][i] for i in keep], model["weights"][keep], model["bias"]
    edge = float(np.log(cut / (1 - cut)))

    def run(part: pa.RecordBatch, state: Terms) -> dict:
        return {"row": part.column("row"), "toxic": [bias + float(weights[state.find(t)].sum()) >= edge for t in part.column("_text").to_pylist()]}

    schema = StructType([inner.schema["row"], StructField("toxic", BooleanType())])
    out = map_slices(inner, run, schema, "_text", setup=lambda: Terms(names)).where(~F.col("toxic"))
    return out.select(*[F.col("row")[c].alias(c) for c in docs.columns])
