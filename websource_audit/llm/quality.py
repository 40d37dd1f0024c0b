"""Quality classifier: document evidence combined with host and path posteriors by hierarchical empirical Bayes.

A logistic model of whole-text statistics gives each document's own evidence. Hosts, and paths within hosts, have
posteriors over their share of good documents: grouped sums of the documents' probabilities, shrunk to the host's and
the global share by concentrations that the method of moments takes from how much hosts differ, and paths within their
host. A document's own probability is left out of the shares that it is judged by. Its log odds are its own evidence plus
what its path says beyond the global share.
"""

from __future__ import annotations

import math
import operator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stash

#: Labelled documents that the model is fitted on at most: those with the smallest hash of their id.
SAMPLE_LABELS = 50_000
#: Site rows that are broadcast; beyond it documents meet their site's row by a shuffle.
BROADCAST_SITES = 200_000
THRESHOLD = 0.5
FEATURES = ("symbols", "upper", "digits", "repeats", "distinct", "line_copies", "log_words", "word_length", "other_script")

# bytes that features count; all are ASCII, so they stand for themselves in UTF-8
_SYMBOLS = b"#$%&*!|~^<>{}[]\\=@_+"
_DIGITS = b"0123456789"
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SPACE = b" \t\n\r\x0b\x0c"


def text_features(text: str | None) -> tuple[float, ...]:
    """Statistics of a whole text, by FEATURES; null and empty texts give zeros."""
    if not text:
        return (0.0,) * len(FEATURES)
    raw = text.encode("utf-8", "surrogatepass")
    n, size, words = len(text), len(raw), raw.split()
    m = max(1, len(words))
    lines = raw.split(b"\n")
    held = lambda marks: (size - len(raw.translate(None, marks))) / n
    return (
        held(_SYMBOLS),
        held(_UPPER),
        held(_DIGITS),
        sum(map(operator.eq, words, words[1:])) / m,
        len(set(words)) / m,
        1 - len(set(lines)) / len(lines),
        math.log1p(len(words)),
        len(raw.translate(None, _SPACE)) / m,
        (size - n) / n,
    )


def widened(x: np.ndarray) -> np.ndarray:
    """The features, their square roots and squares: the model is linear in these."""
    x = np.maximum(x, 0)
    return np.hstack([x, np.sqrt(x), x * x])


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        z = (widened(x) - self.mean) / self.scale
        return np.clip(z @ self.weights[1:] + self.weights[0], -30, 30)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> Model:
    """Ridge logistic regression by Newton steps. Without labels of both kinds the model says the prior alone."""
    w = widened(x)
    mean, scale = (w.mean(0), w.std(0) + 1e-9) if len(w) else (np.zeros(w.shape[1]), np.ones(w.shape[1]))
    z = np.hstack([np.ones((len(w), 1)), (w - mean) / scale])
    prior = (y.sum() + 1) / (len(y) + 2)
    b = np.zeros(z.shape[1])
    b[0] = np.log(prior / (1 - prior))
    if 0 < y.sum() < len(y):
        keep = np.eye(z.shape[1]) * ridge
        keep[0, 0] = 1e-6
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + keep, z.T @ (y - p) - keep @ b)
            b = b + step
            if np.abs(step).max() < 1e-8:
                break
    return Model(mean, scale, b, float(prior))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_LABELS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on at most ``sample`` labelled documents. Several labels of one id count as their mean, rounded; null labels not at all."""
    chosen = labels.select(F.col(id_col).alias("i"), F.col("quality").alias("q")).filter("i is not null and q is not null")
    chosen = chosen.groupBy("i").agg((F.avg("q") >= 0.5).cast("int").alias("q")).orderBy(F.xxhash64("i"), "i").limit(sample)
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).join(F.broadcast(chosen), "i")  # at most `sample` rows

    @F.pandas_udf("array<double>")
    def features(t: pd.Series) -> pd.Series:
        return t.map(text_features)

    got = rows.select("i", "q", features("t").alias("x")).orderBy(F.xxhash64("i"), "i").limit(sample).toPandas()
    x = np.array(got["x"].tolist(), float).reshape(-1, len(FEATURES))
    return fit_logistic(x, got["q"].to_numpy(float))


def evidence(text: Column, model: Model) -> Column:
    """Log odds of a good document from its text alone."""

    @F.pandas_udf("double")
    def score(t: pd.Series) -> pd.Series:
        return pd.Series(model.log_odds(np.array([text_features(x) for x in t], float).reshape(-1, len(FEATURES))))

    # else Spark scores each text twice in one task, the first time for a test that the result is not null
    return score.asNondeterministic()(text)


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


@dataclass
class Priors:
    """The global share, and how many documents of its parent a host and a path weigh against their own."""

    share: float
    host_weight: float
    path_weight: float


def weight(inside: float, between: float, spread: float, groups: float) -> float:
    """The concentration from sums of squares: variance inside groups over what groups differ beyond it, within 1 and a million.

    ``between`` is the sum of squares of group means about their parent's, ``groups`` its degrees of freedom, ``spread`` the
    documents that it stands for.
    """
    extra = (between - groups * inside) / spread if spread > 0 else 0.0
    return float(min(max(inside / max(extra, 1e-12), 1.0), 1e6))


def site_sums(scored: DataFrame) -> tuple[DataFrame, Priors]:
    """(host, path, n, s, host_n, host_s) of scored rows (host, path, log_odds), and the priors; null hosts or paths are one each."""
    p = 1 / (1 + F.exp(-F.col("log_odds")))
    paths = scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum(p).alias("s"), F.sum(p * p).alias("q"))
    paths = stash(paths, "paths")
    hosts = paths.groupBy(F.col("host").alias("h")).agg(F.sum("n").alias("host_n"), F.sum("s").alias("host_s"))
    sites = stash(paths.join(hosts, paths["host"].eqNullSafe(hosts["h"])).drop("h"), "sites")
    part = F.col("n") / F.col("host_n")  # a sum over paths counts each host once
    r = sites.agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.count(F.lit(1)).alias("paths"), F.sum(part).alias("hosts"),
        F.sum(F.col("s") * F.col("s") / F.col("n")).alias("path_ss"), F.sum(part * F.col("host_s") * F.col("host_s") / F.col("host_n")).alias("host_ss"),
        F.sum(F.col("n") * F.col("host_n")).alias("host_nn"), F.sum(part * F.col("n")).alias("path_nn"),
    ).first()
    if not r.n:
        return sites, Priors(0.5, 1.0, 1.0)
    share = min(max(r.s / r.n, 1e-6), 1 - 1e-6)
    inside = lambda ss, groups: max((r.q - ss) / (r.n - groups), 1e-12) if r.n > groups + 0.5 else share * (1 - share)
    host_weight = weight(inside(r.host_ss, r.hosts), r.host_ss - r.s * r.s / r.n, r.n - r.host_nn / r.n, r.hosts - 1)
    path_weight = weight(inside(r.path_ss, r.paths), r.path_ss - r.host_ss, r.n - r.path_nn, r.paths - r.hosts)
    return sites, Priors(share, host_weight, path_weight)


def with_posteriors(scored: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """``scored`` (host, path, log_odds and more) with host_share, path_share and global_share, each row's own probability left out.

    ``scores`` has the same host, path and log_odds where they are cheaper to read.
    """
    sites, priors = site_sums(scored if scores is None else scores)
    small = sites.limit(BROADCAST_SITES + 1).count() <= BROADCAST_SITES
    s = sites.select(F.col("host").alias("h"), F.col("path").alias("p"), "n", "s", "host_n", "host_s")
    out = scored.join(F.broadcast(s) if small else s, scored["host"].eqNullSafe(s["h"]) & scored["path"].eqNullSafe(s["p"]))
    own = 1 / (1 + F.exp(-scored["log_odds"]))
    inner = lambda x: F.least(F.greatest(x, F.lit(1e-6)), F.lit(1 - 1e-6))
    host = inner((s["host_s"] - own + priors.host_weight * priors.share) / (s["host_n"] - 1 + priors.host_weight))
    path = inner((s["s"] - own + priors.path_weight * host) / (s["n"] - 1 + priors.path_weight))
    return out.select(*(scored[c] for c in scored.columns), host.alias("host_share"), path.alias("path_share"), F.lit(priors.share).alias("global_share"))


def with_quality(docs: DataFrame, labels: DataFrame, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, sample: int = SAMPLE_LABELS, keep_text: bool = True) -> DataFrame:
    """All rows of ``docs`` as (doc: all its columns as a struct, log_odds, host_share, path_share, quality, keep).

    Without ``keep_text`` the struct lacks the text, and each text is scored once. With it only the scores are written and texts
    are scored again as they pass: a second copy of the whole corpus in the shared folder would cost more.

    quality is the posterior probability of a good document, keep whether it reaches the threshold. Null and empty
    texts are scored like any other; repeated rows repeat; empty tables give no rows. The struct keeps the
    columns of ``docs`` apart from ours, whatever their names.
    """
    model = fit(small_batches(docs), labels, sample, id_col, text_col)
    held = [c for c in docs.columns if keep_text or c != text_col]
    rows = docs.select(F.struct(*(docs[c] for c in held)).alias("doc"), host.alias("host"), path.alias("path"), evidence(docs[text_col], model).alias("log_odds"))
    if keep_text:
        out = with_posteriors(rows, stash(rows.select("host", "path", "log_odds"), "scores"))
    else:
        out = with_posteriors(stash(rows, "scored"))
    odds = F.col("log_odds") + _logit(F.col("path_share")) - _logit(F.col("global_share"))
    q = 1 / (1 + F.exp(-odds))
    return out.select("doc", "log_odds", "host_share", "path_share", q.alias("quality"), (q >= threshold).alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame, host: Column, path: Column, **options) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with the columns of ``docs``."""
    return with_quality(docs, labels, host, path, **options).filter("keep").select("doc.*")
