"""Toxic severity by cumulative-link (proportional-odds) regression on sparse text features.

Features of a text are its words and their beginnings of 4 to 6 letters, weighted by log(1 + count). One weight
vector serves all thresholds: P(grade > k) = sigmoid(w.x - t_k) with t_0 <= t_1 <= ..., and the expected severity is
the sum of these probabilities.

Labels say only whether a text is toxic. The ordered grades are derived from them: 0 is not toxic, and toxic texts are
split at the median of their number of toxic words (those whose features are selected for toxicity) into 1, mild, and
2, severe.

So the upper threshold tells how many toxic words a text has rather than what a reader would call severe; with graded
labels it would tell that.

The model is fitted on a bounded sample of labelled rows (SAMPLE), with the features of which that sample gives evidence;
scoring covers every row. The fitted model's size depends on the sample only, so it travels with the tasks.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutgrain.llm.rows import sliced, small
from cutgrain.llm.words import Memory
from cutgrain.session import bounded, cut

#: Labelled rows that the model is fitted on, about: those with the smallest hashes.
SAMPLE = 20_000
#: Likelihood-ratio statistic that a feature needs: chance gives so much once in 100,000 features.
EVIDENCE = 20.0
#: A text is rejected from this probability of a grade over 0.
REJECT = 0.5

_WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Ordinal:
    """features -> weight; thresholds in increasing order."""

    weights: dict[str, float]
    thresholds: tuple[float, ...]

    def probabilities(self, x: float) -> list[float]:
        """P(grade > k) for each threshold."""
        return [1 / (1 + math.exp(-max(-500.0, min(500.0, x - t)))) for t in self.thresholds]


def names(word: str) -> list[str]:
    """Features of one lower-case word."""
    return ["=" + word] + [f"{n}:{word[:n]}" for n in (4, 5, 6) if len(word) >= n]


def _words(text: str | None) -> Counter:
    return Counter(_WORD.findall((text or "").lower()))


def _labelled(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """(text, toxic boolean) of about `sample` labelled documents, one row for each id."""
    lab = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).alias("toxic"))
    part = min(1.0, sample / max(1, lab.count()))
    lab = cut(lab.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 20)) < int(part * (1 << 20))))
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(small(lab), "doc_id")
    return cut(found.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")).select("text", "toxic"))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Ordinal:
    """Null ids and labels are left out; several labels of one document count as the highest, of rows that repeat an id one
    counts. Without both classes, as with empty tables, the model has no weights and rejects nothing. Other columns of docs
    and labels don't matter."""
    rows = _labelled(docs, labels, sample)
    total = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}  # two rows at most
    pos, neg = total.get(True, 0), total.get(False, 0)
    if not pos or not neg:
        return Ordinal({}, (1e9, 1e9))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()

        def out() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array([k for k, _ in n], pa.string()), pa.array([t for _, t in n], pa.bool_()), pa.array(list(n.values()), pa.int64())], names=["name", "toxic", "n"])
            n.clear()
            return got

        for b in batches:
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                n.update((x, toxic) for x in {f for w in _words(text) for f in names(w)})
                if len(n) > 50_000:
                    yield out()
        yield out()

    counts = rows.mapInArrow(count, "name string, toxic boolean, n long").groupBy("name").agg(F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("pos"), F.sum(F.when(F.col("toxic"), 0).otherwise(F.col("n"))).alias("neg"))
    # association: the likelihood-ratio statistic, which holds for rare features too; EVIDENCE leaves out what chance explains
    p, q = F.col("pos"), F.col("neg")
    part = lambda n, share: F.when(n > 0, n * F.log(n / (p + q) / share)).otherwise(0.0)
    g = 2 * (part(p, pos / (pos + neg)) + part(q, neg / (pos + neg)))
    top = counts.select("name", g.alias("g"), "pos", "neg").where(F.col("g") >= EVIDENCE).orderBy(F.col("g").desc(), "name").toPandas()
    index = {x: i for i, x in enumerate(top["name"])}
    # those of mostly toxic texts measure how severe a toxic text is
    bad = frozenset(top["name"][(top["pos"] / pos) > 20 * (top["neg"] + 0.5) / neg])

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, values, hits = [], [], []
            for text in b.column(0).to_pylist():
                c = _words(text)
                x: Counter = Counter()
                hit = 0
                for w, n in c.items():
                    fs = [f for f in names(w) if f in index]
                    for f in fs:
                        x[index[f]] += n
                    hit += n * any(f in bad for f in fs)
                ids.append(list(x))
                values.append([math.log1p(v) for v in x.values()])
                hits.append(hit)
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(ids, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32())), pa.array(hits, pa.int64())], names=["toxic", "ids", "x", "hits"])

    got = rows.mapInArrow(vectors, "toxic boolean, ids array<int>, x array<float>, hits long").toPandas()
    return _regress(got, list(top["name"]))


def _regress(rows: pd.DataFrame, names_: list[str], steps: int = 3000, ridge: float = 0.1, settled: float = 1e-4) -> Ordinal:
    """Accelerated gradient descent on the mean negative log-likelihood of the cumulative-link model, until 50 steps change no
    parameter by more than `settled`."""
    rows = rows.sort_values(["hits", "toxic"], kind="stable", ignore_index=True)
    toxic = rows["toxic"].to_numpy(bool)
    median = float(np.median(rows["hits"][toxic]))
    grade = np.where(toxic, np.where(rows["hits"] > median, 2, 1), 0)
    row = np.repeat(np.arange(len(rows)), [len(x) for x in rows["ids"]])
    col = np.concatenate([np.asarray(x, np.int64) for x in rows["ids"]]) if len(row) else np.empty(0, np.int64)
    val = np.concatenate([np.asarray(x, np.float64) for x in rows["x"]]) if len(row) else np.empty(0)
    d, n = len(names_), len(rows)
    above = np.stack([grade > 0, grade > 1], 1)
    share = np.clip(above.mean(0), 1e-3, 1 - 1e-3)
    t = -np.log(share / (1 - share))
    # t_1 = t_0 + exp(gap), so that thresholds stay in order
    par = np.concatenate([np.zeros(d), [t[0], math.log(max(t[1] - t[0], 1e-2))]])
    scale = np.bincount(col, val * val, d) / n + 1e-3  # a diagonal bound of the curvature
    rate = np.concatenate([1 / (scale * 8), [1.0, 0.5]])
    sig = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))
    last, look, before = par.copy(), par.copy(), par
    for k in range(steps):
        w, t0, gap = look[:d], look[d], math.exp(min(look[d + 1], 5))
        s = np.bincount(row, val * w[col], n)
        p0, p1 = sig(s - t0), sig(s - t0 - gap)
        mid = np.maximum(p0 - p1, 1e-9)
        g0 = np.where(grade == 0, p0, np.where(grade == 1, -p0 * (1 - p0) / mid, 0.0))
        g1 = np.where(grade == 2, -(1 - p1), np.where(grade == 1, p1 * (1 - p1) / mid, 0.0))
        gs = (g0 + g1) / n
        grad = np.concatenate([np.bincount(col, val * gs[row], d) + ridge / n * w, [-gs.sum(), -(g1 / n).sum() * gap]])
        now = look - rate * np.clip(grad, -1, 1)
        look = now + k / (k + 3) * (now - last)
        if k % 50 == 49:
            look = now.copy()  # restart: momentum doesn't overshoot
            if np.abs(now - before).max() < settled:
                last = now
                break
            before = now
        last = now
    w, t0 = last[:d], last[d]
    return Ordinal({x: float(v) for x, v in zip(names_, w, strict=True) if abs(v) > 1e-6}, (float(t0), float(t0 + math.exp(min(last[d + 1], 5)))))


class _Scorer:
    """P(grade > k) of texts, with what each word contributes kept in bounded memory."""

    def __init__(self, model: Ordinal) -> None:
        self.model = model
        self.known = Memory(lambda w: tuple(f for f in names(w) if f in model.weights), 50_000, longest=40)

    def __call__(self, text: str | None) -> list[float]:
        known, x = self.known, {}
        for w in _WORD.findall((text or "").lower()):
            for f in known[w]:
                x[f] = x.get(f, 0) + 1
        return self.model.probabilities(sum(self.model.weights[f] * math.log1p(n) for f, n in x.items()))


def score(docs: DataFrame, model: Ordinal, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """-> (doc_id, severity, p_toxic, grade, toxic): one row a row of docs.

    severity is the expected grade, grade the median one, toxic the decision to reject. Null and empty texts have no
    features and get the base rate; rows are independent, null and repeated ids are kept, other columns are dropped. A text is
    scored whole in its task, whatever its length; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _Scorer(model)

        def one(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            p = np.array([of(t) for t in b.column(1).to_pylist()]).reshape(-1, len(model.thresholds))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p.sum(1)), pa.array(p[:, 0]), pa.array((p >= 0.5).sum(1).astype(np.int32)), pa.array(p[:, 0] >= REJECT)], names=["doc_id", "severity", "p_toxic", "grade", "toxic"])

        yield from sliced(one, 2000)(batches)

    return bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, severity double, p_toxic double, grade int, toxic boolean")


def drop_toxic(docs: DataFrame, model: Ordinal) -> DataFrame:
    """The rows of docs that the model doesn't reject, in one pass and without a join.

    Null and empty texts stay, unless the model rejects a text without features. Rows are independent: null and repeated
    ids are kept, whatever the columns are named. An empty table gives no rows.
    """
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _Scorer(model)

        def one(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            yield b.filter(pa.array([of(t)[0] < REJECT for t in b.column(at).to_pylist()], pa.bool_()))

        yield from sliced(one, 2000)(batches)

    return bounded(docs).mapInArrow(run, docs.schema)
