"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier on the words of a text and their beginnings is trained from confirmed toxic examples and
unlabelled text. With class prior p the risk is p * R_pos(+) + max(0, R_unl(-) - p * R_pos(-)); while the
corrected negative part is below zero, the step goes against it, so the classifier cannot explain the positives
hidden in the unlabelled text away.

The steps of the training read a bounded sample (`max_positives`, `max_unlabelled` texts, the first by a hash of the
id). The shares of features among unlabelled text and the bias, which makes the mean score of unlabelled text equal
the prior, are counted over all texts given; features that are too common in the drawn texts by six standard errors
are given up before that count. Scoring reads every whole text. Ids, languages and sources are never
read by a score.

Null and empty texts score sigmoid(bias), as a text without any known feature does. Repeated rows get equal
scores. Labels that are null, or are given twice with different values, confirm nothing unless one of them is
1. Without confirmed examples every text scores 0. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Collection, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchorline.llm.common import map_rows, text_of
from anchorline.session import stable

TOKEN = re.compile(r"[^\W\d_]+")
HEADS = (4, 5)
#: A beginning counts once, twice or three times: by how many different words of the text have it.
SEEN = 3
#: A feature is not counted over all texts if the drawn ones show by so many standard errors that it is too common.
SURE = 6.0


def word_heads(word: str) -> list[str]:
    return [word[:n] for n in HEADS if len(word) > n]


def features_of(words: set[str]) -> set[str]:
    """The words of a text, and the beginnings that one, two or more of its different words share."""
    heads = Counter(h for w in words for h in word_heads(w))
    return words | {f"{h}*{k}" for h, n in heads.items() for k in range(1, min(n, SEEN) + 1)}


def text_features(text: str) -> set[str]:
    return features_of({w for chunk in set(text.lower().split()) for w in TOKEN.findall(chunk)})


def finder(wanted: Collection[str]) -> Callable[[str], list[str]]:
    """The wanted features of a text, sorted. Most words touch none; what a chunk of text contributes is remembered."""
    wanted = frozenset(wanted)
    heads = {f[:f.index("*")] for f in wanted if "*" in f}
    known: dict[str, tuple[str, ...]] = {}

    def find(text: str) -> list[str]:
        if len(known) > 400_000:
            known.clear()
        found: set[str] = set()
        for chunk in set(text.lower().split()):
            words = known.get(chunk)
            if words is None:
                words = known[chunk] = tuple(
                    w for w in TOKEN.findall(chunk) if w in wanted or not heads.isdisjoint(word_heads(w))
                )
            if words:
                found.update(words)
        return sorted(features_of(found) & wanted)

    return find


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    bias: float

    def summer(self) -> Callable[[str], float]:
        """The sum of the weights of a text, without the bias."""
        find, weights = finder(self.weights), self.weights
        return lambda text: float(sum(weights[f] for f in find(text)))

    def scorer(self) -> Callable[[list[str]], np.ndarray]:
        """Scores of texts."""
        plain = self.summer()

        def score(texts: list[str]) -> np.ndarray:
            with np.errstate(over="ignore"):
                return 1 / (1 + np.exp(-self.bias - np.array([plain(t) for t in texts], float)))

        return score


def fit_nnpu(
    positive: list[list[int]], unlabelled: list[list[int]], width: int, prior: float,
    steps: int = 800, rate: float = 0.03, decay: float = 2e-5,
) -> tuple[np.ndarray, float]:
    """Weights of a linear logistic classifier that minimises the non-negative risk, by Adam, and the bias that
    makes the mean score of the unlabelled texts given equal the class prior."""
    def packed(texts: list[list[int]]) -> tuple[np.ndarray, np.ndarray, int]:
        row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        return row, np.array([f for t in texts for f in t], np.int64), len(texts)

    p_rows, p_cols, n_pos = packed(positive)
    u_rows, u_cols, n_unl = packed(unlabelled)
    w, b = np.zeros(width), np.log(prior / (1 - prior))
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, steps + 1):
        f_pos = np.bincount(p_rows, w[p_cols], n_pos) + b
        f_unl = np.bincount(u_rows, w[u_cols], n_unl) + b
        s_pos, s_unl = 1 / (1 + np.exp(-f_pos)), 1 / (1 + np.exp(-f_unl))
        negative = np.logaddexp(0, f_unl).mean() - prior * np.logaddexp(0, f_pos).mean()
        if negative >= 0:
            d_pos, d_unl = prior * (s_pos - 1) / n_pos - prior * s_pos / n_pos, s_unl / n_unl
        else:
            d_pos, d_unl = prior * s_pos / n_pos, -s_unl / n_unl
        grad = np.empty(width + 1)
        grad[:-1] = np.bincount(p_cols, d_pos[p_rows], width) + np.bincount(u_cols, d_unl[u_rows], width) + decay * w
        grad[-1] = d_pos.sum() + d_unl.sum()
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    plain, low, high = np.bincount(u_rows, w[u_cols], n_unl), -50.0, 50.0
    for _ in range(60):  # the mean score of unlabelled text is the prior
        b = (low + high) / 2
        low, high = (low, b) if (1 / (1 + np.exp(-plain - b))).mean() > prior else (b, high)
    return w, float(b)


def shares_of(texts: DataFrame, wanted: list[str]) -> tuple[dict[str, int], int]:
    """In how many of all `texts` each wanted feature occurs, and how many texts there are. A task hands on one row
    for each wanted feature."""
    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, seen, rows = finder(wanted), Counter(), 0
        for part in parts:
            for text in part.column("text").to_pylist():
                seen.update(find(text))
                rows += 1
        yield pa.RecordBatch.from_pydict({
            "feature": pa.array([None, *seen], pa.string()), "n": pa.array([rows, *seen.values()], pa.int64())
        })

    found = texts.select("text").mapInArrow(count, "feature string, n long").groupBy("feature").agg(F.sum("n"))
    totals = dict(found.collect())  # one row for each wanted feature
    return {f: totals.get(f, 0) for f in wanted}, totals.get(None, 0)


def bias_over(texts: DataFrame, weights: dict[str, float], prior: float) -> float:
    """The bias with which the mean score of all `texts` is the prior, to a millionth."""
    summer = None

    def rows(part: dict[str, list]) -> dict[str, list]:
        nonlocal summer
        summer = summer or Model(weights, 0.0).summer()
        return {"plain": [summer(t) for t in part["text"]]}

    sums = stable(map_rows(texts.select("text"), rows, "plain double"))
    low, high, parts = -50.0, 50.0, 64
    while high - low > 1e-6:
        tried = [low + (high - low) * i / parts for i in range(1, parts)]
        means = sums.agg(*(F.avg(1 / (1 + F.exp(-F.col("plain") - b))) for b in tried)).first()
        below = sum(m <= prior for m in means)  # the mean grows with the bias
        low, high = [low, *tried][below], [*tried, high][below]
    return (low + high) / 2


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    max_positives: int = 2000, max_unlabelled: int = 8000, features: int = 1500,
) -> Model:
    """Train on `docs`; rows whose label is 1 are the confirmed examples. The prior is the share of them among
    the labelled rows, which have to be drawn like the documents. Features are those that at least three times
    the share of examples has, compared with all rows of `docs`, the clearest ones first, measured in standard
    errors. What the driver holds is bounded by the sample."""
    known = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("label"))
    )
    totals = known.agg(F.count("*"), F.sum(F.when(F.col("label") == 1, 1).otherwise(0))).first()
    if not totals[1]:
        return Model({}, float("-inf"))
    prior = min(max(totals[1] / totals[0], 1e-4), 0.5)
    draw = lambda ids, most: ids.orderBy(F.xxhash64("id"), "id").limit(most)
    texts = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    ids = texts.select("id").where("id is not null").distinct()

    def drawn(ids: DataFrame) -> DataFrame:
        """One text for each of the ids, whose number is bounded; only their texts are shuffled."""
        return texts.join(F.broadcast(ids), "id").groupBy("id").agg(F.min("text").alias("text"))

    marked = known.where("label = 1").select("id").join(ids, "id")
    positive, unlabelled = drawn(draw(marked, max_positives)), drawn(draw(ids, max_unlabelled))
    sample = positive.select(F.lit(1).alias("kind"), "text").unionAll(unlabelled.select(F.lit(0), "text"))
    sample = sample.withColumn("no", F.monotonically_increasing_id())

    def rows(part: dict[str, list]) -> dict[str, list]:
        found = [sorted(text_features(t)) for t in part["text"]]
        return {"no": part["no"], "kind": part["kind"], "features": found}

    counted = stable(map_rows(sample, rows, "no long, kind int, features array<string>"))
    n_pos, n_unl = counted.agg(F.sum("kind"), F.sum(1 - F.col("kind"))).first()
    if not n_pos or not n_unl:
        return Model({}, float("-inf"))
    variance = lambda share, n: (share * (1 - share) + 1 / n) / n
    a, b = F.col("a") / n_pos, F.col("b") / n_unl
    a_of = {r[0]: r[1] for r in (
        counted.select("kind", F.explode("features").alias("feature")).groupBy("feature")
        .agg(F.sum("kind").alias("a"), F.sum(1 - F.col("kind")).alias("b"))
        .where(a >= 3 * F.sqrt(variance(a, n_pos)))  # clear if no other text has it
        .where(a >= 3 * (b - SURE * F.sqrt(variance(b, n_unl)))).select("feature", "a")
    ).collect()}
    b_of, n_all = shares_of(texts, sorted(a_of))
    strength = {}
    for feature, a in a_of.items():
        p, u = a / n_pos, b_of[feature] / n_all
        clear = (p - u) / (variance(p, n_pos) + variance(u, n_all)) ** 0.5
        if clear >= 3 and p >= 3 * u:
            strength[feature] = clear
    chosen = sorted(strength, key=lambda f: (-strength[f], f))[:features]
    place = {f: i for i, f in enumerate(chosen)}
    wanted = counted.sparkSession.createDataFrame([(f,) for f in chosen], "feature string")
    used = (  # the places of a text's chosen features, no words
        counted.select("no", "kind", F.explode_outer("features").alias("feature"))
        .join(F.broadcast(wanted.withColumn("hit", F.col("feature"))), "feature", "left")  # `features` rows
        .groupBy("no", "kind").agg(F.collect_set("hit").alias("hits")).orderBy("no").collect()
    )
    columns = lambda kind: [sorted(place[f] for f in r["hits"]) for r in used if r["kind"] == kind]
    fitted, _ = fit_nnpu(columns(1), columns(0), len(chosen), prior)
    weights = dict(zip(chosen, fitted.tolist(), strict=True))
    return Model(weights, bias_over(texts, weights, prior))


def score(
    docs: DataFrame, model: Model, text_col: str = "text", as_col: str = "score", keep: list[str] | None = None
) -> DataFrame:
    """The columns `keep` of `docs` (all of them if not given) and the probability that the text is toxic."""
    kept = [f for f in docs.schema.fields if f.name != as_col and (keep is None or f.name in keep)]
    scorer = None

    def rows(part: dict[str, list]) -> dict[str, list]:
        nonlocal scorer
        scorer = scorer or model.scorer()
        made = scorer([t or "" for t in part[text_col]])
        return {f.name: part[f.name] for f in kept} | {as_col: made}

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept)
    wanted = [f"`{n}`" for n in dict.fromkeys([*(f.name for f in kept), text_col])]
    return map_rows(docs.select(wanted), rows, f"{schema}`{as_col}` double")
