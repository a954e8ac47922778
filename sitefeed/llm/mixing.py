"""Mixing sources to target weights by soft membership, DataFrame operations only.

A labelled table gives the domain of some documents. From it a naive Bayes
classifier over the presence of words predicts every document's domain posteriors.
Words are runs of letters in lower case, in learning and scoring alike, so capitals,
line breaks and signs do not matter. They are hashed into ``FEATURES`` numbers; the
model has that size whatever the labelled texts hold, and its counts are summed in
Spark. Numbers that the labelled sample lacks say nothing. The words of one text are
not independent, so a text counts as a bounded number of words of average evidence:
m known words weigh m E / (m + E). E is the one of ``EVIDENCE`` under which each half
of the sample, judged by the other half, is predicted with the least log loss. The
rates that the
documents are to be drawn with minimise the squared error between the expected
token total of every domain, sum of rate x tokens x posterior, and its target
share of the corpus; they are nonnegative and stay as near to one as the steps
of projected gradient descent, started at one, leave them.

A step needs one number per domain from all documents, a distributed sum. The
rates themselves are never stored: each is a chain of the steps taken so far over
the document's own posteriors. So iterations do not lengthen
lineage, no row is keyed or shuffled, and every pass reads one narrow table.

Texts without known words have the prior as posterior, empty texts no tokens and rate one;
very long texts are read whole, every word once. Null
labels, null domains and unknown ids teach nothing. With no labelled document,
posteriors are the targets. Repeated rows count as often as they occur. A
target of zero asks for none of that domain; targets are scaled to sum to one.
Empty tables give no rows. Names of further columns may be any.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitefeed.llm.common import split_words
from sitefeed.runtime import materialize

#: Labelled documents that are learnt from; weight, in words, of all domains' common distribution in each domain's.
LABELLED, SMOOTHING = 4000, 100.0
#: Numbers that words are hashed into, a power of two.
FEATURES = 1 << 14
#: Words of evidence that a text of any length may at most come to; the sample decides.
EVIDENCE = (1.0, 2.0, 4.0, 8.0, 16.0)
STEPS, TOLERANCE = 60, 1e-6
#: Passes without a gain of a thousandth after which the least error is taken as found.
PATIENCE = 6


def _tokens(text: str) -> Column:
    """Number of blank-separated words."""
    return F.size(split_words(F.coalesce(F.col(text), F.lit("")), r"\s+")).cast("long")


def _features(text: str) -> Column:
    """The numbers of the words of a text, each number once."""
    words = split_words(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{M}]+")
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w).bitwiseAND(F.lit(FEATURES - 1)).cast("int")))


def _numbers(values) -> Column:
    """An array constant of doubles, handed over as one text; the optimizer folds it."""
    return F.split(F.lit(",".join(f"{v:.5g}" for v in values)), ",").cast("array<double>")


@dataclass
class DomainModel:
    """Log prior of every domain, and what a feature adds to it: domains x FEATURES, zero for unknown ones.

    ``known`` marks the features of the sample (a one or a zero each).
    """

    domains: list[str]
    base: np.ndarray
    gain: np.ndarray
    known: np.ndarray
    evidence: float = EVIDENCE[-1]

    def evidences(self, rows: DataFrame, text: str, names: list[str], count: str) -> DataFrame:
        """The rows with the mean gain of the text's known features per domain, and their number."""
        keep = [f"`{c}`" for c in rows.columns]
        rows = rows.select(*keep, _features(text).alias("_f"))

        def total(values: np.ndarray) -> Column:
            table = _numbers(values)
            return F.aggregate("_f", F.lit(0.0), lambda s, at: s + F.get(table, at))

        sums = [total(self.gain[d]).alias(name) for d, name in enumerate(names)]
        rows = rows.select(*keep, *sums, total(self.known).alias(count))
        each = [(F.col(n) / F.greatest(F.col(count), F.lit(1.0))).alias(n) for n in names]
        return rows.select(*keep, *each, count)

    def scored(self, rows: DataFrame, text: str, names: list[str]) -> DataFrame:
        """The rows with the unnormalised log posteriors of the domains as columns ``names``."""
        keep, words = [f"`{c}`" for c in rows.columns], F.col("_known")
        rows = self.evidences(rows, text, names, "_known")
        weight = words * self.evidence / (words + self.evidence)
        return rows.select(*keep, *[(F.lit(float(b)) + weight * F.col(n)).alias(n) for b, n in zip(self.base, names, strict=True)])


def _model(domains: list[str], held: np.ndarray, count: np.ndarray) -> DomainModel:
    """From documents per domain, and documents of each domain that hold a feature."""
    total = count.sum(axis=0)
    common = total / max(total.sum(), 1.0)
    share = (count + SMOOTHING * common) / (count.sum(axis=1, keepdims=True) + SMOOTHING)
    known = (total > 0).astype(float)
    logs = np.log(np.where(known > 0, share, 1.0))
    prior = (held + 0.5) / (held + 0.5).sum()
    # Only differences between domains matter; small numbers keep the constants short.
    return DomainModel(domains, np.log(prior), logs - logs.mean(axis=0), known)


def _best_evidence(seen: list[tuple[DomainModel, list]]) -> float:
    """The bound with the least log loss; ``seen``: models, and rows (domain number, words, mean gains) to predict."""
    losses = []
    for bound in EVIDENCE:
        loss = 0.0
        for model, rows in seen:
            if rows:
                own, words, gains = (np.array(x) for x in zip(*rows, strict=True))
                z = model.base + (words * bound / (words + bound))[:, None] * gains
                z -= z.max(axis=1, keepdims=True)
                loss += float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(own)), own]).sum())
        losses.append(loss)
    return EVIDENCE[int(np.argmin(losses))]


def learn(documents: DataFrame, labelled: DataFrame, targets: dict[str, float]) -> DomainModel:
    """``labelled``: doc_id, domain. Learns from a bounded number of labelled documents."""
    domains = sorted(targets)
    chosen = (
        labelled.where(F.col("domain").isin(domains) & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.min("domain").alias("domain"))
        .orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id")
        .limit(LABELLED)
    )
    chosen = materialize(chosen, "labelled")
    half = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(2)).cast("int").alias("half")
    number = F.array_position(F.array(*[F.lit(d) for d in domains]), F.col("domain")).cast("int") - 1
    sample = documents.select("doc_id", "text").join(chosen, "doc_id").select("text", number.alias("own"), half)
    held = np.zeros((2, len(domains)))
    for r in sample.groupBy("half", "own").agg(F.count("*").alias("n")).collect():
        held[r.half, r.own] = r.n
    if not held.sum():
        share = np.array([max(targets[d], 1e-12) for d in domains])
        nothing = np.zeros((len(domains), FEATURES))
        return DomainModel(domains, np.log(share / share.sum()), nothing, nothing[0])
    # Documents of each half and domain that hold a feature: at most 2 x domains x FEATURES rows.
    count = np.zeros((2, len(domains), FEATURES))
    found = sample.select("half", "own", F.explode(_features("text")).alias("f")).groupBy("half", "own", "f").agg(F.count("*").alias("n"))
    rows = found.toPandas()
    count[rows["half"], rows["own"], rows["f"]] = rows["n"]
    names, seen = [f"_s{i}" for i in range(len(domains))], []
    for part in (0, 1):
        other = _model(domains, held[1 - part], count[1 - part])
        judged = other.evidences(sample.where(F.col("half") == part).select("own", "text"), "text", names, "_known")
        seen.append((other, [(r.own, r["_known"], [r[n] for n in names]) for r in judged.drop("text").collect()]))
    model = _model(domains, held.sum(axis=0), count.sum(axis=0))
    model.evidence = _best_evidence(seen)
    return model


def memberships(documents: DataFrame, model: DomainModel, *keep: str) -> DataFrame:
    """The columns ``keep`` plus _tokens and one posterior _p0, _p1, ... per domain."""
    names = [f"_s{i}" for i in range(len(model.domains))]
    rows = documents.select(*keep, F.col("text").alias("_text"), _tokens("text").alias("_tokens"))
    rows = model.scored(rows, "_text", names)
    top = F.greatest(*names) if len(names) > 1 else F.col(names[0])
    rows = rows.select(*keep, "_tokens", *[F.exp(F.col(n) - top).alias(n) for n in names])
    total = sum((F.col(n) for n in names[1:]), F.col(names[0]))
    return rows.select(*keep, "_tokens", *[(F.col(n) / total).alias(f"_p{i}") for i, n in enumerate(names)])


def _rate(steps: list[list[float]]) -> Column:
    """The document's rate after all steps: max(0, rate - change), step after step."""
    rate = F.lit(1.0)
    for step in steps:
        change = sum((F.col(f"_p{d}") * F.lit(float(x)) for d, x in enumerate(step)), F.lit(0.0))
        rate = F.greatest(F.lit(0.0), rate - change * F.col("_x"))
    return rate


def solve(members: DataFrame, domains: list[str], targets: dict[str, float]) -> tuple[list[list[float]], dict]:
    """Projected gradient steps; each pass sums one value per domain over all documents.

    Step lengths follow Barzilai and Borwein: the change of the rates against the
    change of the domain totals, both sums over documents. ``members`` has _x, the
    document's tokens over the mean, and _p.
    """
    k = len(domains)
    first = members.agg(
        F.sum("_tokens").alias("tokens"),
        *[F.sum(F.col(f"_p{a}") * F.col(f"_p{b}") * F.col("_x") * F.col("_x")).alias(f"g{a}_{b}") for a in range(k) for b in range(k)],
        F.sum("_x").alias("total"),
    ).first()
    if not first["tokens"]:
        return [], {"error": 0.0, "passes": 1, "totals": [0.0] * k}
    gram = np.array([[first[f"g{a}_{b}"] for b in range(k)] for a in range(k)])
    share = np.array([targets[d] for d in domains], float)
    goal = share / share.sum() * first["total"]
    length = 1.0 / max(float(np.linalg.eigvalsh(gram).max()), 1e-300)
    steps: list[list[float]] = []
    best: tuple[float, int, list[float]] = (np.inf, 0, [])
    last, errors = None, []
    for _ in range(STEPS):
        sums = members.select("*", _rate(steps).alias("_r"), _rate(steps[:-1]).alias("_before")).agg(
            *[F.sum(F.col("_r") * F.col("_x") * F.col(f"_p{d}")).alias(f"t{d}") for d in range(k)],
            F.sum(F.pow(F.col("_r") - F.col("_before"), 2)).alias("moved"),
        ).first()
        totals = np.array([sums[f"t{d}"] for d in range(k)])
        residual = totals - goal
        error = float(np.abs(residual).sum() / goal.sum())
        if error < best[0]:
            best = (error, len(steps), totals.tolist())
        errors.append(error)
        if error < TOLERANCE or len(errors) > PATIENCE and best[0] > 0.999 * min(errors[:-PATIENCE]):
            break
        if last is not None:
            against = float(((residual - last) ** 2).sum())
            if against > 0 and sums["moved"] > 0:
                length = float(sums["moved"]) / against
        last = residual
        steps.append((length * residual).tolist())
    return steps[: best[1]], {"error": best[0], "passes": len(steps) + 1, "totals": best[2]}


class Mixture:
    """Model, members and steps; ``report`` has the error left, passes and domain totals."""

    def __init__(self, documents: DataFrame, labelled: DataFrame, targets: dict[str, float]):
        self.model = learn(documents, labelled, targets)
        self.members = materialize(memberships(documents, self.model, "doc_id"), "memberships")
        self.mean = float(self.members.agg(F.avg("_tokens")).first()[0] or 1.0) or 1.0
        self.steps, self.report = solve(self._scaled(self.members), self.model.domains, targets)

    def _scaled(self, members: DataFrame) -> DataFrame:
        return members.withColumn("_x", F.col("_tokens") / F.lit(self.mean))

    def rates(self) -> DataFrame:
        """doc_id, n_tokens, one p_<domain> per domain, rate."""
        return self._scaled(self.members).select(
            "doc_id",
            F.col("_tokens").alias("n_tokens"),
            *[F.col(f"_p{i}").alias(f"p_{d}") for i, d in enumerate(self.model.domains)],
            _rate(self.steps).alias("rate"),
        )

    def apply(self, documents: DataFrame) -> DataFrame:
        """All columns of the documents (but a former ``rate``) plus ``rate``, row by row."""
        columns = [F.col(f"`{c}`") for c in documents.drop("rate").columns]
        # The whole row is one column here, so its names may be any.
        rows = documents.select(F.struct(*columns).alias("_row"), "text")
        members = self._scaled(memberships(rows, self.model, "_row"))
        return members.select("_row.*", _rate(self.steps).alias("rate"))


def rates(documents: DataFrame, labelled: DataFrame, targets: dict[str, float]) -> DataFrame:
    """One row per document: doc_id, n_tokens, one p_<domain> per domain, rate."""
    return Mixture(documents, labelled, targets).rates()


def with_rates(documents: DataFrame, labelled: DataFrame, targets: dict[str, float]) -> DataFrame:
    """The documents with their rates; no document goes."""
    return Mixture(documents, labelled, targets).apply(documents)
