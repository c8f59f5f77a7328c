"""Per-document text statistics and what they tell: prose, list, table or junk.

One pass over the texts gives a compact row of statistics per document.  A
Gaussian mixture with diagonal covariances is fitted to the standardized
statistics of all documents by expectation-maximization, each step one
aggregation over the rows; components get the label that inspected examples
carry, and a document the label of its components with the greatest posterior.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.sources.workspace import Workspace

LANGUAGES = ("en", "de", "es")
LABELS = ("prose", "list", "table", "junk")
#: Frequent function words of English, German and Spanish.
COMMON = frozenset(
    """the a an of to in and is that this it for on with as by at from or be are was were which while so but our not also
    after before because since when if then than every each here there we i you they all some one about only just like most
    der die das den dem des ein eine einer einen und ist im zu mit auf für von nicht sich als auch bei nach aus wird werden
    dass wenn oder aber noch jede jedem nur ihn sie er es
    el la los las un una unos unas de del en y que por con para se su al lo como más o pero sin sobre cada este esta entre
    desde ya no""".split()
)
STATISTICS = ("n_words", "mean_word_length", "symbol_share", "closed_lines", "common_share", "prose_share", "list_share", "table_share", "repeated_share", "digit_share", "clutter_share")
#: Those that the mixture is fitted to.  Repetition is 0 in nearly all texts, so its variance would make any
#: repeated passage an outlier; it is part of the clutter.
MIXED = tuple(s for s in STATISTICS if s != "repeated_share")
_SCHEMA = "doc_id long, lang string, n_visible long, " + ", ".join(f"{s} double" for s in STATISTICS)
MAX_LABELLED = 20_000
COMPONENTS_PER_LABEL = 3
STEPS = 12
#: A wide component for texts that are unlike all others; it keeps its shape and counts as junk.
BACKGROUND_WEIGHT, BACKGROUND_VARIANCE = 1e-3, 30.0

_BULLET = re.compile(r"\s*(?:[-*+•]|\d+(?:\.\d+)*[.)]?|[├└│]|\[[ x]\])\s")
_TABLE = re.compile(r"\|.*\||\t.*\S|\S {2,}\S.* {2,}\S|(?:[^,;]{1,40}[,;]){3}|<t[dr]>|^[+|=-]{4,}")
_DIGITS = str.maketrans("", "", "0123456789")
_ALNUM = re.compile(r"[^\W_]+")


def _says_the_same(ws: list[str]) -> bool:
    """Whether most runs of five words occurred before."""
    runs = len(ws) - 4
    return len(set(zip(ws, ws[1:], ws[2:], ws[3:], ws[4:]))) * 3 < runs


def text_statistics(text: str) -> tuple:
    """Visible characters and :data:`STATISTICS` of one text.

    A line is prose if it has three or more words, at least 15 % of them common
    words, of three or more characters on average.  A line that appears for the
    third time or more is repeated text, and so is a line of many words that says
    the same over and over.  Clutter is all but prose and fenced code.
    """
    visible = n_words = n_common = prose = listed = tabled = repeated = fenced = closed = lines = 0
    seen: dict[str, int] = {}
    code = False
    split = text.splitlines()
    fences = sum(line.lstrip().startswith("```") for line in split) if "```" in text else 0
    common = COMMON.__contains__
    for line in split:
        ws = line.lower().split()
        n = len(ws)
        if not n:
            continue
        v = sum(map(len, ws))
        s = sum(map(common, ws))
        visible, n_words, n_common, lines = visible + v, n_words + n, n_common + s, lines + 1
        if ws[-1][-1] in ".!?:;\"')":
            closed += 1
        times = seen[line] = seen.get(line, 0) + 1
        if ws[0].startswith("```"):
            fences -= 1
            code = not code and fences > 0
        if times > 2 and v > 3:
            repeated += v
        elif code:
            fenced += v
        elif n >= 3 and s >= 0.15 * n and v >= 3 * n:
            if n > 40 and len(set(ws)) * 3 < n and _says_the_same(ws):
                repeated += v
            else:
                prose += v
        elif _BULLET.match(line):
            listed += v
        elif _TABLE.search(line):
            tabled += v
    if not visible:
        return (0, *([0.0] * len(STATISTICS)))
    digits = len(text) - len(text.translate(_DIGITS))
    letters = sum(map(len, _ALNUM.findall(text)))
    return (
        visible,
        float(np.log1p(n_words)),
        min(visible / n_words, 60.0),
        1 - min(1.0, letters / visible),
        closed / lines,
        n_common / n_words,
        prose / visible,
        listed / visible,
        tabled / visible,
        repeated / visible,
        digits / visible,
        (visible - prose - fenced) / visible,
    )


def _statistics(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["doc_id", "lang", "n_visible", *STATISTICS]
    for pdf in batches:
        rows = [(d, lang, *text_statistics(t or "")) for d, lang, t in zip(pdf["doc_id"], pdf["lang"], pdf["text"])]
        yield pd.DataFrame(rows, columns=columns)


def document_statistics(documents: DataFrame) -> DataFrame:
    """(doc_id, lang, n_visible, statistics...) of every row of (doc_id, lang, text).

    Null and blank texts have n_visible 0 and zeros; rows that repeat a doc_id
    each get a row; other columns are ignored.  n_words is ``ln(1 + words)``.
    """
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text").mapInPandas(_statistics, _SCHEMA)


@dataclass
class Mixture:
    """Diagonal Gaussians over standardized statistics, each mapped to a label."""

    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    means: np.ndarray
    variances: np.ndarray
    labels: list[str]

    def posteriors(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = (x - self.centre) / self.scale
        d = ((z[:, None, :] - self.means) ** 2 / self.variances).sum(2)
        log = np.log(self.weights) - 0.5 * (d + np.log(self.variances).sum(1))
        top = log.max(1, keepdims=True)
        p = np.exp(log - top)
        total = p.sum(1, keepdims=True)
        return p / total, (top + np.log(total))[:, 0]


def _with_background(weights: np.ndarray, means: np.ndarray, variances: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    d = means.shape[1]
    weights = np.append(weights / weights.sum() * (1 - BACKGROUND_WEIGHT), BACKGROUND_WEIGHT)
    return weights, np.vstack([means, np.zeros((1, d))]), np.vstack([variances, np.full((1, d), BACKGROUND_VARIANCE)])


def _spread_centres(x: np.ndarray, k: int) -> np.ndarray:
    """Farthest-point centres, then a few rounds of nearest-mean refinement."""
    centres = [x.mean(0)]
    while len(centres) < min(k, len(x)):
        far = np.min([((x - c) ** 2).sum(1) for c in centres], axis=0)
        centres.append(x[int(far.argmax())])
    out = np.array(centres)
    for _ in range(8):
        near = ((x[:, None, :] - out) ** 2).sum(2).argmin(1)
        out = np.array([x[near == j].mean(0) if (near == j).any() else out[j] for j in range(len(out))])
    return out


def fit_mixture(statistics: DataFrame, labelled: DataFrame, *, steps: int = STEPS, per_label: int = COMPONENTS_PER_LABEL, max_labelled: int = MAX_LABELLED) -> Mixture:
    """Fit by expectation-maximization on all rows of ``statistics`` that have visible text.

    ``labelled`` (doc_id, label) with at most ``max_labelled`` rows read gives the
    starting centres and, at the end, the label of each component: the one with
    the most responsibility among the examples.  A component without examples is
    named by what most of the characters of its mean belong to.  A wide background component
    takes what is unlike all others.  Without any usable example all is prose.
    """
    names = list(MIXED)
    rows = statistics.where("n_visible > 0").select("doc_id", *names)
    moments = rows.agg(*[F.avg(n).alias(f"m_{n}") for n in names], *[F.stddev_pop(n).alias(f"s_{n}") for n in names], F.count(F.lit(1)).alias("n")).first()
    if not moments["n"]:
        d = len(names)
        return Mixture(np.zeros(d), np.ones(d), np.ones(1), np.zeros((1, d)), np.ones((1, d)), ["prose"])
    centre = np.array([moments[f"m_{n}"] for n in names])
    scale = np.maximum(np.array([moments[f"s_{n}"] for n in names]), 1e-3)
    examples = rows.join(labelled.where(F.col("label").isin(*LABELS)), "doc_id").select("label", *names).limit(max_labelled).toPandas()
    if examples.empty:
        d = len(names)
        return Mixture(centre, scale, np.ones(1), np.zeros((1, d)), np.ones((1, d)), ["prose"])
    ex = (examples[names].to_numpy(float) - centre) / scale
    kinds = examples["label"].to_numpy()
    means = np.vstack([_spread_centres(ex[kinds == k], per_label) for k in LABELS if (kinds == k).any()])
    k, d = means.shape
    labels = ["prose"] * k + ["junk"]
    model = Mixture(centre, scale, *_with_background(np.full(k, 1 / k), means, np.full((k, d), 0.5)), labels)
    last = -np.inf
    for _ in range(steps):

        def sums(batches: Iterator[pd.DataFrame], model: Mixture = model) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                x = pdf[names].to_numpy(float)
                if not len(x):
                    continue
                r, like = model.posteriors(x)
                r = r[:, :k]
                z = (x - model.centre) / model.scale
                part = np.concatenate([[like.sum(), len(x)], r.sum(0), (r.T @ z).ravel(), (r.T @ z**2).ravel()])
                yield pd.DataFrame({"i": np.arange(len(part)), "v": part})

        got = rows.select(*names).mapInPandas(sums, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toPandas().sort_values("i")["v"].to_numpy()
        like, n, mass = got[0], got[1], np.maximum(got[2 : 2 + k], 1e-9)
        first = got[2 + k : 2 + k + k * d].reshape(k, d)
        second = got[2 + k + k * d :].reshape(k, d)
        mean = first / mass[:, None]
        variance = np.maximum(second / mass[:, None] - mean**2, 1e-2)
        model = Mixture(centre, scale, *_with_background(np.maximum(mass / n, 1e-6), mean, variance), labels)
        if abs(like - last) < 1e-4 * abs(like):
            break
        last = like
    r, _ = model.posteriors(examples[names].to_numpy(float))
    votes = np.array([[r[kinds == label, j].sum() for label in LABELS] for j in range(k)])
    has = votes.sum(1) >= 0.5
    shares = dict(zip(names, (model.means[:k] * scale + centre).T))
    made_of = np.stack([shares["prose_share"], shares["list_share"], shares["table_share"], shares["clutter_share"] - shares["list_share"] - shares["table_share"]], axis=1)
    for j in range(k):
        model.labels[j] = LABELS[int((votes if has[j] else made_of)[j].argmax())]
    return model


def classify(statistics: DataFrame, model: Mixture) -> DataFrame:
    """(doc_id, lang, n_visible, label, p_prose): the most probable label; blank texts are junk."""
    names = list(MIXED)

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = np.array([[name == x for x in LABELS] for name in model.labels], dtype=float)
        for pdf in batches:
            p, _ = model.posteriors(pdf[names].to_numpy(float))
            p = p @ of
            blank = pdf["n_visible"].to_numpy() == 0
            best = np.where(blank, "junk", np.array(LABELS)[p.argmax(1)]) if len(pdf) else np.array([], dtype=str)
            out = pdf[["doc_id", "lang", "n_visible"]].copy()
            out["label"], out["p_prose"] = best, np.where(blank, 0.0, p[:, 0])
            yield out

    return statistics.mapInPandas(label, "doc_id long, lang string, n_visible long, label string, p_prose double")


def labelled_majority(labels: DataFrame) -> DataFrame:
    """One label per document: the most frequent, ties to the alphabetically first; null labels do not count."""
    clean = labels.select("doc_id", F.lower(F.btrim(F.col("label"))).alias("label")).where("doc_id is not null and label is not null")
    counted = clean.groupBy("doc_id", "label").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("doc_id").agg(F.min(F.struct(-F.col("n"), "label")).alias("best")).select("doc_id", "best.label")


def label_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """:func:`classify` of the natural-language documents under a mixture fitted to all of them.

    Languages other than :data:`LANGUAGES` (source files, null) are left out.
    """
    spark = documents.sparkSession
    natural = documents.where(F.col("lang").isin(*LANGUAGES))
    statistics = Workspace(spark, "quality").write(document_statistics(natural), "statistics")
    return classify(statistics, fit_mixture(statistics, labelled_majority(labels)))


def not_prose(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id) of natural-language documents that the mixture labels other than prose, or that are blank."""
    found = label_documents(documents, labels)
    return found.where((F.col("label") != "prose") & F.col("doc_id").isNotNull()).select("doc_id").distinct()
