"""Toxicity by maximum-scoring segments of token log-odds.

1. Token counts of toxic and clean labelled texts (each token once a text) give log-odds with Dirichlet priors: the
   prior of a word is centred on the log-odds of its first bytes, theirs on those of fewer first bytes, so that
   unseen forms of a stem share what is known of it.
2. A linear scan over the tokens of a text finds all maximal-scoring segments: the passages whose summed log-odds
   stand out.
3. Extreme-value statistics say how large the best segment of a clean text of n tokens gets, P(S <= s) =
   exp(-K n exp(-lambda s)), with lambda and K fitted on clean texts. Segments beyond that are the passages
   reported; their calibrated scores go through a logistic curve fitted on labelled texts that gave no counts.

Labels, language, source and doc_id take no part in a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalvault.llm.common import Words, flat, slices, text_column, with_column

MAX_LABELLED = 40_000
"""Labelled texts the model is fitted on, about; more are sampled by a hash of doc_id. Bounds what is broadcast."""
PREFIXES = (4, 6)
STRENGTH = 4.0
"""Weight of the prior, in token occurrences."""
LEAST_ODDS = 0.7
DRIFT = 0.1
WIDTHS = (*PREFIXES, 1 << 40)
MIN_TEXTS = 3


@dataclass
class ToxicityModel:
    features: np.ndarray
    scores: np.ndarray
    drift: float
    rate: float
    log_k: float
    weights: np.ndarray

    def token_scores(self, words: Words) -> np.ndarray:
        """Log-odds of each token by its longest known form, less the drift; small ones count as none."""
        score = np.zeros(len(words.row))
        if len(self.features):
            for h in words.prefix_hashes(WIDTHS):
                at = np.minimum(np.searchsorted(self.features, h), len(self.features) - 1)
                known = self.features[at] == h
                score[known] = self.scores[at[known]]
        return score - self.drift

    def summary(self, best: np.ndarray, total: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Inputs of the logistic curve from calibrated segment scores."""
        share = total / np.sqrt(np.maximum(n, 1))
        return np.column_stack([np.ones(len(n)), np.clip(best, -10, 30), np.log1p(np.maximum(total, 0)), np.clip(share, 0, 30)])

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))

    def calibrated(self, score: float, n: int) -> float:
        return self.rate * score - self.log_k - np.log(max(n, 1))


def maximal_segments(score: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score), by the linear scan with a stack of candidates."""
    total = np.concatenate([[0.0], np.cumsum(score)])
    rise = score > 0
    start = np.flatnonzero(rise & ~np.concatenate([[False], rise[:-1]]))
    end = np.flatnonzero(rise & ~np.concatenate([rise[1:], [False]])) + 1
    stack: list[list] = []  # start, end, sum before, sum behind, nearest candidate to the left with less before
    for a, b, low, high in zip(start.tolist(), end.tolist(), total[start].tolist(), total[end].tolist()):
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= low:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= high:
                stack.append([a, b, low, high, j])
                break
            a, low = stack[j][0], stack[j][2]
            del stack[j:]
    return [(a, b, high - low) for a, b, low, high, _ in stack]


def _passages(model: ToxicityModel, words: Words) -> Iterator[tuple[int, list[tuple[int, int, float]]]]:
    """(row, segments) of the rows that have a token of positive score."""
    score = model.token_scores(words)
    for row in np.unique(words.row[score > 0]).tolist():
        a, b = words.first[row], words.first[row + 1]
        yield row, maximal_segments(score[a:b])


def _describe(model: ToxicityModel, words: Words) -> tuple[np.ndarray, np.ndarray, dict[int, list[tuple[int, int, float]]]]:
    """Best and summed calibrated score of every row, and its significant segments (of more than chance)."""
    n = words.counts
    best = np.array([model.calibrated(0.0, k) for k in n.tolist()]) if len(n) else np.zeros(0)
    total = np.zeros(len(n))
    kept = {}
    for row, segments in _passages(model, words):
        graded = [(a, b, model.calibrated(s, int(n[row]))) for a, b, s in segments]
        best[row] = max(g for _, _, g in graded)
        kept[row] = [x for x in graded if x[2] > 0]
        total[row] = sum(g for _, _, g in kept[row])
    return best, total, kept


def _labelled(documents: DataFrame, labels: DataFrame, train, limit: int) -> DataFrame:
    """(text, toxic, part) of at most about ``limit`` labelled texts; part 4 calibrates, the others are counted."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & train(F.col("doc_id"))) \
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    share = min(1.0, limit / max(1, known.count()))
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")) \
        .join(F.broadcast(chosen), "doc_id").select("text", "toxic", F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(4)).alias("part"))


def fit(documents: DataFrame, labels: DataFrame, train=lambda doc_id: F.lit(True), limit: int = MAX_LABELLED) -> ToxicityModel:
    """A model from the labelled texts whose doc_id ``train`` accepts. Without both classes every score is low."""
    from signalvault.session import cut_lineage

    sample = cut_lineage(_labelled(documents, labels, train, limit))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            words = Words(*flat(text_column(part.column("text"))), letters=True)
            toxic = part.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
            forms = words.prefix_hashes(WIDTHS)
            for level, h in enumerate(forms):
                order = np.lexsort((words.row, h))
                key, row = h[order], words.row[order]
                new = np.ones(len(key), bool)
                new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
                key, row, above = key[new], row[new], (forms[level - 1][order][new] if level else np.zeros(int(new.sum()), np.uint64))
                first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
                bad = np.add.reduceat(toxic[row], first) if len(first) else first
                yield pa.RecordBatch.from_arrays([pa.array(key[first].view(np.int64)), pa.array(np.full(len(first), level)), pa.array(above[first].view(np.int64)),
                                                  pa.array(bad.astype(np.int64)), pa.array(np.diff(np.append(first, len(key))) - bad)], ["h", "level", "above", "bad", "good"])

    counts = sample.where("part <> 3").select("text", "toxic").mapInArrow(count, "h long, level long, above long, bad long, good long")
    # the same form can be a word and the prefix of others: the longer level decides, as in scoring
    table = counts.groupBy("h", "level", "above").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    share = cut_lineage(table.where(F.col("bad") + F.col("good") >= MIN_TEXTS))
    sums = sample.where("part <> 3").agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count(F.lit(1))).first()
    n1, n0 = float(sums[0]) + 1.0, float(sums[1] - sums[0]) + 1.0
    # the labelled sample bounds the forms; as columns they are small in the driver
    rows = share.select("level", "h", "above", "bad", "good").toArrow().sort_by([("level", "ascending"), ("h", "ascending")])
    rows = list(zip(*(rows.column(c).to_pylist() for c in rows.column_names)))
    odds: dict[int, float] = {}
    clean = all_clean = 0.0
    for level, h, above, bad, good in rows:
        if level and above == h:
            continue
        parent = np.exp(odds.get(above, 0.0)) if level else 1.0
        prior = STRENGTH * parent * n1 / (parent * n1 + n0)
        ratio = np.log((bad + prior) / n1) - np.log((good + STRENGTH - prior) / n0)
        odds[h] = float(np.clip(ratio, -3, 8))
    for level, h, _, _, good in rows:
        if level == 2:
            value = odds.get(h, 0.0)
            clean += good * (value if abs(value) >= LEAST_ODDS else 0.0)
            all_clean += good
    features = np.array(sorted(odds), np.int64).view(np.uint64)
    values = np.array([odds[int(h)] for h in features.view(np.int64)])
    order = np.argsort(features)
    features, values = features[order], values[order]
    values = np.where(np.abs(values) >= LEAST_ODDS, values, 0.0)
    model = ToxicityModel(features, values, DRIFT + max(0.0, clean / max(1.0, all_clean)), 1.0, 0.0, np.array([-4.0, 0.0, 0.0, 0.0]))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            words = Words(*flat(text_column(part.column("text"))), letters=True)
            segments = dict(_passages(model, words))
            yield pa.RecordBatch.from_arrays([
                part.column("toxic"), pa.array(words.counts), pa.array([[s for _, _, s in segments.get(i, ())] for i in range(part.num_rows)], pa.list_(pa.float64()))],
                ["toxic", "n", "segments"])

    seen = sample.where("part = 3").select("text", "toxic").mapInArrow(measure, "toxic int, n long, segments array<double>").collect()
    toxic, n = np.array([r.toxic for r in seen]), np.array([r.n for r in seen], np.float64)
    top = np.array([max(r.segments, default=0.0) for r in seen])
    null = (toxic == 0) & (top > 0) if len(seen) else np.zeros(0, bool)
    if null.sum() >= 20:
        model.rate, model.log_k = _extreme_value(top[null], np.maximum(n[null], 1))
    if 0 < toxic.sum() < len(seen):
        graded = [[model.calibrated(s, r.n) for s in r.segments] for r in seen]
        best = np.array([max(g, default=model.calibrated(0.0, r.n)) for g, r in zip(graded, seen)])
        total = np.array([sum(x for x in g if x > 0) for g in graded])
        model.weights = _logistic(model.summary(best, total, n), toxic)
    return model


def _extreme_value(s: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Most likely lambda and log K of P(S <= s) = exp(-K n exp(-lambda s)); K follows from lambda."""
    def fitted(rate: float) -> tuple[float, float]:
        log_k = np.log(len(s)) - np.log(np.sum(n * np.exp(-rate * s)))
        return float(np.sum(log_k + np.log(rate) + np.log(n) - rate * s) - len(s)), float(log_k)

    rates = np.geomspace(0.05, 5, 200)
    best = max(rates, key=lambda r: fitted(r)[0])
    return float(best), fitted(best)[1]


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights by Newton steps with a light ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(w)), x.T @ (y - p) - 1e-3 * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def score_toxicity(documents: DataFrame, model: ToxicityModel, text: str = "text", name: str = "toxicity") -> DataFrame:
    """All columns of ``documents`` and ``name`` (in place of one of that name): (score 0 to 1, passages as (start, end, score) in code points,
    score in nats beyond chance). Null and empty texts get the score of a text without findings."""
    documents, schema = with_column(documents, name, "struct<score:double,passages:array<struct<start:int,end:int,score:double>>>")
    entry = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])
    whole = pa.struct([("score", pa.float64()), ("passages", pa.list_(entry))])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            words = Words(*flat(text_column(part.column(text))), letters=True)
            best, total, kept = _describe(model, words)
            value = model.probability(model.summary(best, total, words.counts))
            out = []
            for row in range(part.num_rows):
                spans = []
                if kept.get(row):
                    begin = words.offsets[row]
                    points = np.concatenate([[0], np.cumsum((words.data[begin:words.offsets[row + 1]] & 0xC0) != 0x80)])
                    for a, b, s in kept[row]:
                        first = words.first[row]
                        spans.append({"start": int(points[words.starts[first + a] - begin]), "end": int(points[words.ends[first + b - 1] - begin]), "score": s})
                out.append({"score": float(value[row]), "passages": spans})
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, whole)], [*part.schema.names, name])

    return documents.mapInArrow(score, schema)
