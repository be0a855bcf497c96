"""Toxicity by a weighted finite-state pattern grammar over clauses.

Words are tagged (insult by strength, threat, target, negator, reporting word), then one machine, composed of the
negation, reported-speech and target transducers, rewrites the tags of each clause and weighs what it matched. Only
clauses with an insult or threat are parsed. Insult stems are those of a seed list and those that labelled rows show to
be significant; how much each kind of match counts is fitted on the same rows.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField

from spanlake.llm._common import add_columns, any_names, table

#: Labelled rows that a model is fitted on and bytes of their texts, at most; the rows with the least hash of their doc_id.
MAX_TRAIN, MAX_TRAIN_BYTES = 8_000, 64 << 20
#: Lengths of learned stems.
STEM = range(3, 10)

INSULTS = "idiot moron stupid loser scum trash pathetic worthless disgusting clown fool jerk dumb imbecile bastard coward filth vermin idiotin dummkopf trottel abschaum versager idiote imbécile crétin ordure minable idiota imbécil estúpido basura escoria inútil".split()
THREATS = "kill hurt destroy shoot stab burn hang smash strangle töten umbringen vernichten schlagen tuer frapper détruire brûler matar golpear destruir quemar".split()
TARGETS = "you your he she they them this that these those him her du dich ihr euch sie er diese dieser tu toi vous il elle ils ces cette tú te usted ustedes él ella ellos ese esta".split()
NEGATORS = "not no never neither nor without nicht kein keine nie ne pas jamais aucun sans no nunca jamás ni sin".split()
REPORTERS = "said says say called quoted wrote claimed according sagte sagt nannte schrieb laut dit disait appelé écrit selon dijo dice llamó escribió según".split()

CLAUSE = re.compile(r"[.!?;:\n]+")
WORD = re.compile(r"[^\W\d_]+")


class Transducer:
    """Input-deterministic weighted transducer: arcs[(state, symbol)] = (output, weight, next state); else the symbol passes and the state becomes rest[state]."""

    def __init__(self, arcs: dict, rest: dict, final: int = 0):
        self.arcs, self.rest, self.start = arcs, rest, final

    def step(self, state, symbol):
        return self.arcs.get((state, symbol)) or (symbol, 0.0, self.rest.get(state, state))

    def compose(self, other: Transducer, symbols: list[str]) -> Transducer:
        """One machine that does this and then the other: states are pairs, reached from the start over `symbols`."""
        start = (self.start, other.start)
        arcs, todo, seen = {}, [start], {start}
        while todo:
            at = todo.pop()
            for s in symbols:
                mid, w1, a = self.step(at[0], s)
                out, w2, b = other.step(at[1], mid)
                arcs[at, s] = (out, w1 + w2, (a, b))
                if (a, b) not in seen:
                    seen.add((a, b))
                    todo.append((a, b))
        return Transducer(arcs, {}, start)


HIT = ["I1", "I2", "I3", "H"]
TAGS = [*HIT, "T", "N", "R", "O"]


def _within(trigger: str, reach: int, mark: str, weight: float, symbols: list[str]) -> Transducer:
    """Marks hits that come up to `reach` words after a trigger."""
    arcs = {}
    for s in range(reach + 1):
        arcs[s, trigger] = ("O", 0.0, reach)
        if s:
            arcs |= {(s, x): (x + mark, weight, s - 1) for x in symbols}
    return Transducer(arcs, {s: max(0, s - 1) for s in range(reach + 1)})


def grammar() -> Transducer:
    negation = _within("N", 3, "-", -1.5, HIT)
    hits = [x + m for x in HIT for m in ("", "-")]
    scope = {(0, "R"): ("O", 0.0, 1), (1, "R"): ("O", 0.0, 1)} | {(1, x): (x + "q", -0.7, 1) for x in hits}
    reported = Transducer(scope, {})
    hits = [x + m for x in hits for m in ("", "q")]
    target = _within("T", 4, "t", 0.7, hits)
    both = negation.compose(reported, TAGS)
    return both.compose(target, TAGS)


GRAMMAR = grammar()
FEATURES = 11


class Model:
    """Stems with weights and the fitted coefficients."""

    def __init__(self, stems: dict[str, float], coef: np.ndarray | None = None):
        self.stems, self.coef = stems, coef
        self.lengths = sorted({len(s) for s in stems})
        self.tags = {w: t for t, words in (("R", REPORTERS), ("N", NEGATORS), ("T", TARGETS), ("H", THREATS)) for w in words}
        self.finder = None

    def __getstate__(self):
        return self.stems, self.coef

    def __setstate__(self, state):
        self.__init__(*state)

    def _may_hit(self, low: str) -> bool:
        """Does a word begin with a stem or threat?"""
        if self.finder is None:
            import ahocorasick

            self.finder = ahocorasick.Automaton()
            for s in [*self.stems, *THREATS]:
                self.finder.add_word(s, len(s))
            self.finder.make_automaton()
        return any(end < n or not low[end - n].isalpha() for end, n in self.finder.iter(low))

    def features(self, text: str | None) -> np.ndarray:
        x = np.zeros(FEATURES)
        low = (text or "").lower()
        if not self._may_hit(low):
            return x
        n_words, total, best, kinds = 0, 0.0, 0.0, set()
        for clause in CLAUSE.split(low):
            words = WORD.findall(clause)
            n_words += len(words)
            weights, tags = [], []
            for w in words:
                weight = max((self.stems.get(w[:n], 0.0) for n in self.lengths), default=0.0)
                weights.append(weight)
                tags.append(("I3" if weight >= 4.5 else "I2" if weight >= 3 else "I1") if weight else self.tags.get(w, "O"))
            if not any(t in HIT for t in tags):
                continue
            state, score = GRAMMAR.start, 0.0
            for w, weight, tag in zip(words, weights, tags, strict=True):
                out, arc, state = GRAMMAR.step(state, tag)
                if out[0] in "IH":
                    kinds.add(w)
                    x[0 if out[0] == "H" else int(out[1])] += 1
                    x[4] += "t" in out
                    x[5] += "-" in out
                    x[6] += "q" in out
                    score += max(0.0, (weight or 2.0) + arc)
            total += score
            best = max(best, score)
        x[:7] = np.log1p(x[:7])
        x[7:] = math.log1p(total), math.log1p(best), math.log1p(100 * total / max(1, n_words)), math.log1p(len(kinds))
        return x

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        x = np.stack([self.features(t) for t in texts])
        return 1 / (1 + np.exp(-np.clip(self.coef[0] + x @ self.coef[1:], -30, 30)))


def learn_stems(texts: list[str], labels: np.ndarray) -> dict[str, float]:
    """Word beginnings whose presence is significantly commoner in toxic texts, with smoothed log odds; and the seeds."""
    seen: dict[str, list[int]] = defaultdict(lambda: [0, 0])
    for y in (1, 0):
        for t, label in zip(texts, labels, strict=True):
            if label != y:
                continue
            found = {w[:n] for w in set(WORD.findall(t.lower())) for n in STEM if len(w) >= n}
            if y:
                for p in found:
                    seen[p][1] += 1
            else:
                for p in found & seen.keys():
                    seen[p][0] += 1
        seen = {p: c for p, c in seen.items() if c[1] >= 3} if y else seen
    n1 = int(labels.sum())
    n0 = len(labels) - n1
    if not n1 or not n0:
        return dict.fromkeys(INSULTS, 4.0)
    least = 2 * math.log(1 + len(seen)) + 6
    base = n1 / (n0 + n1)
    chosen = []
    for p, (a, b) in seen.items():
        odds = math.log((b + 0.5) / (n1 + 1)) - math.log((a + 0.5) / (n0 + 1))
        if odds < 1.5:
            continue
        rate = b / (a + b)
        g = 2 * (b * math.log(rate / base) + (a * math.log((1 - rate) / (1 - base)) if a else 0))
        if g >= least:
            chosen.append((g, p, odds))
    # Of stems in each other, the longest that loses next to none of the toxic texts.
    count = {p: seen[p][1] for _, p, _ in chosen}
    longer = {q[:-1] for q, n in count.items() if n >= 0.97 * count.get(q[:-1], 1 << 60)}
    out: dict[str, float] = {}
    for _, p, odds in sorted(chosen, key=lambda c: (len(c[1]), c[1])):
        if p not in longer and all(out.get(p[:n], -9) < odds - 0.3 for n in STEM if n < len(p)):
            out[p] = odds
    return dict.fromkeys(INSULTS, 4.0) | out


def fit(texts: list[str], labels: np.ndarray) -> Model:
    """Stems, then a logistic model (ridge, Newton steps) of the grammar's features. Without both labels, a fixed prior."""
    texts = [t or "" for t in texts]
    model = Model(learn_stems(texts, labels))
    model.coef = np.array([-3.0, *[0.5] * FEATURES])
    if len(texts) < 10 or labels.min() == labels.max():
        return model
    x = np.column_stack([np.ones(len(texts)), np.stack([model.features(t) for t in texts])])
    ridge = np.diag([1e-3, *[0.1] * FEATURES])
    w = np.zeros(FEATURES + 1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * np.maximum(p * (1 - p), 1e-6)[:, None]) + ridge, x.T @ (labels - p) - ridge @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    model.coef = w
    return model


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN, max_bytes: int = MAX_TRAIN_BYTES) -> Model:
    """Fit on labelled rows that are not held out: at most max_rows, of at most max_bytes of text, by the hash of their ids.

    Both bounds hold whatever ids repeat. Rows with equal texts count once, with the label 1 if any of them has it. Null
    labels, ids and texts are left out.
    """
    sample = labels.where(~held_out() & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "toxic").distinct()
    order = [F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"), "toxic"]
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(max_rows)
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(sample), "doc_id").orderBy(*order).limit(max_rows)
    # A window over no more than max_rows rows.
    rows = rows.withColumn("sum", F.sum(F.octet_length("text").cast("long")).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.where(F.col("sum") <= max_bytes).select("text", "toxic").toPandas()
    rows = rows.sort_values(["text", "toxic"], ascending=[True, False]).drop_duplicates("text")
    return fit(rows["text"].tolist(), rows["toxic"].to_numpy(np.int64))


@any_names
def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """docs with a score from 0 to 1; null and empty texts get the score of a text without a match."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return add_columns(docs, [F.col(text)], [StructField(out, DoubleType(), False)], lambda cols: [sent.value.scores(cols[0].to_pylist())])


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
