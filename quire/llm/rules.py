"""Learned decision lists for page quality.

Sequential covering: on a growing set a rule takes on one threshold condition after another, each with the best FOIL
gain, until it covers no kept page; on a pruning set its last conditions are dropped while that raises its worth; pages
that it covers leave, and the next rule is learned. The list is emitted as an ordered Spark conditional expression, so
applying it costs no Python.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh
from .features import COUNTS, RATIOS, features, labelled

FIELDS = (*COUNTS, *RATIOS)
#: Labelled pages that are fitted at most; applying the list is not bounded.
FIT_ROWS = 20_000


@dataclass(frozen=True)
class Condition:
    field: str
    above: bool
    threshold: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        v = x[:, FIELDS.index(self.field)]
        return v > self.threshold if self.above else v <= self.threshold

    def column(self, source: str) -> Column:
        c = F.col(f"{source}.{self.field}").cast("double")
        return c > F.lit(self.threshold) if self.above else c <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.field} {'>' if self.above else '<='} {self.threshold:.6g}"


def covered(rule: list[Condition], x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for c in rule:
        out &= c.holds(x)
    return out


def best_condition(x: np.ndarray, bad: np.ndarray, cuts: list[np.ndarray]) -> tuple[float, Condition | None]:
    """The threshold of the highest FOIL gain over rows that a rule covers so far. Ties: the first field, lowest cut."""
    p0, n0 = int(bad.sum()), int((~bad).sum())
    base, best = np.log2(p0 / (p0 + n0)), (1e-9, None)
    for j, name in enumerate(FIELDS):
        if not len(cuts[j]):
            continue
        slot = np.searchsorted(cuts[j], x[:, j], side="left")  # values <= cuts[k] have slot <= k
        p = np.cumsum(np.bincount(slot[bad], minlength=len(cuts[j]) + 1))[:-1].astype(float)
        n = np.cumsum(np.bincount(slot[~bad], minlength=len(cuts[j]) + 1))[:-1].astype(float)
        for above, pp, nn in ((False, p, n), (True, p0 - p, n0 - n)):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(pp > 0, pp * (np.log2(pp / (pp + nn)) - base), 0)
            k = int(np.argmax(gain))
            if gain[k] > best[0] + 1e-12:
                best = float(gain[k]), Condition(name, above, float(cuts[j][k]))
    return best


def learn(x: np.ndarray, label: np.ndarray, max_rules: int = 12, max_conditions: int = 4, min_precision: float = 0.9, min_cover: int = 3) -> list[list[Condition]]:
    """Rules that reject pages (label 0), in order. Rows must come in a fixed order: every third is for pruning.

    Without labels of both kinds there are no rules, so every page is kept.
    """
    bad = label == 0
    cuts = []
    for j in range(x.shape[1]):
        seen = np.unique(x[:, j])
        mid = (seen[1:] + seen[:-1]) / 2
        cuts.append(mid if len(mid) <= 256 else np.unique(mid[np.linspace(0, len(mid) - 1, 256).astype(int)]))
    prune = np.arange(len(x)) % 3 == 2
    left, rules = np.ones(len(x), bool), []
    while len(rules) < max_rules:
        grow, check = left & ~prune, left & prune
        if not (bad & grow).any() or not (~bad & grow).any():
            break
        rule: list[Condition] = []
        at = np.flatnonzero(grow)
        while len(rule) < max_conditions and (~bad[at]).any():
            _, found = best_condition(x[at], bad[at], cuts)
            if found is None:
                break
            rule.append(found)
            at = at[found.holds(x[at])]

        def worth(r: list[Condition]) -> float:
            hit = check & covered(r, x)
            p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
            return (p - n) / (p + n) if p + n else -1.0

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        hit = left & covered(rule, x) if rule else np.zeros(len(x), bool)
        p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
        if p < min_cover or p < min_precision * (p + n) or worth(rule) < 2 * min_precision - 1 and (check & hit).any():
            break
        rules.append(rule)
        left &= ~hit
    return rules


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", rows: int = FIT_ROWS) -> list[list[Condition]]:
    """Learn the list from at most ``rows`` labelled pages (those of the smallest id hash); their ids are broadcast.

    An id with several texts counts once, by its least features.
    """
    ids = labelled(labels, rows, doc_id=doc_id)
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(ids), "doc_id")
    got = own.select("doc_id", "label", features("text").alias("f")).groupBy("doc_id", "label").agg(F.min("f").alias("f"))
    frame = got.select("doc_id", "label", "f.*").toPandas().sort_values("doc_id")
    if frame.empty:
        return []
    return learn(frame[list(FIELDS)].to_numpy(float), frame["label"].to_numpy())


def verdict(rules: list[list[Condition]], source: str) -> tuple[Column, Column]:
    """The list as ordered conditional expressions: whether a page is kept, and the rule that decided."""
    kept, said = None, None
    for k, rule in enumerate(rules):
        test = rule[0].column(source)
        for c in rule[1:]:
            test = test & c.column(source)
        name = F.lit(f"{k + 1}: " + " and ".join(map(str, rule)))
        kept = F.when(test, F.lit(False)) if kept is None else kept.when(test, F.lit(False))
        said = F.when(test, name) if said is None else said.when(test, name)
    default = F.lit("default")
    return (F.lit(True), default) if kept is None else (kept.otherwise(F.lit(True)), said.otherwise(default))


def judge(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", rows: int = FIT_ROWS) -> DataFrame:
    """All columns of ``docs`` and a struct ``rules`` (another name if taken): counts, ``base_failed``, ``kept``, ``rule``.

    ``base_failed`` is true under 50 words, or if over half of the words lie in repeated 3-word windows; such pages are
    not kept, whatever the learned list says. Null texts count as empty and fail; rows repeat as in ``docs``; an empty
    table gives an empty table, and no labels give an empty list, so only the base rule rejects.
    """
    rules = fit(docs, labels, text, doc_id, rows)
    f, out = fresh(docs, "f", "rules")
    base = (F.col(f"{f}.n_words") < 50) | (100 * F.col(f"{f}.n_repeat_words") > 50 * F.col(f"{f}.n_words"))
    kept, said = verdict(rules, f)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return docs.withColumn(f, features(text)).select(
        *columns,
        F.struct(*[F.col(f"{f}.{c}").alias(c) for c in COUNTS], base.alias("base_failed"), (~base & kept).alias("kept"), F.when(base, F.lit("base")).otherwise(said).alias("rule")).alias(out),
    )
