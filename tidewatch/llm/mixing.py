"""Mixing sources to target weights by iterative proportional fitting.

Documents are counted in cells of source, language and topic, by tokens. Only sources, languages
and topics that the targets name are told apart, the rest is "*", so there are at most
(sources + 1) * (languages + 1) * (topics + 1) cells, which are raked on the driver.

A cell's documents are kept with the probability min(1, scale * factor). Cells that would need more
than they have are full; what they lack would bend the marginals, so the others are raked again to what the full ones leave of the
targets, until no further cell is full. Where a target asks for more than there is at the budget, the shares
that are reached differ from it; `reached` reports both. Each document is decided by a hash of its id, so runs agree
and nothing is shuffled but the counts of the cells.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK, fresh

#: The default topics, by what the text holds, asked in this order: the given texts are invented and have no subject. Any column can be given instead.
TOPICS = (("legal", r"(?i)\blicen[sc]e"), ("table", r" \| [^|\n]* \| "), ("data", r"[0-9]{4}"), ("prose", ""))


@dataclass(frozen=True)
class Targets:
    """Shares of tokens; "*" stands for all that is not named. Shares of what is absent go to the others in proportion."""

    source: dict = field(default_factory=lambda: {f"src{i}": 0.05 for i in range(20)} | {"*": 0.02})
    lang: dict = field(default_factory=lambda: {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.13, "*": 0.02})
    topic: dict = field(default_factory=lambda: {"prose": 0.85, "legal": 0.05, "table": 0.04, "data": 0.06})
    #: Expected share of all tokens that is kept.
    budget: float = 0.6


def topic_of(text: Column) -> Column:
    found = F.lit(TOPICS[-1][0])
    for name, pattern in reversed(TOPICS[:-1]):
        found = F.when(text.rlike(pattern), name).otherwise(found)
    return found


def tokens_of(text: Column) -> Column:
    """Words between white space, and one end."""
    return F.regexp_count(text, F.lit(BLANK.replace("[", "[^") + "+")) + F.lit(1)


def _named(column: Column, shares: dict) -> Column:
    return F.when(column.isin([k for k in shares if k != "*"]), column).otherwise("*")


def _celled(docs: DataFrame, targets: Targets, name: str, topic: Column | None) -> DataFrame:
    """docs with the struct `name` (source, lang, topic, n): a row's cell and its tokens."""
    text = F.coalesce(F.col("text"), F.lit(""))
    of = topic_of(text) if topic is None else topic
    cell = F.struct(_named(F.col("source"), targets.source).alias("source"), _named(F.col("lang"), targets.lang).alias("lang"), _named(of, targets.topic).alias("topic"), tokens_of(text).alias("n"))
    return docs.withColumn(name, cell)


def _sides(cells: list[tuple], targets: Targets) -> list[tuple[np.ndarray, np.ndarray]]:
    """For source, language and topic: the place of each cell's value, and the shares of the values; what is absent gives its share to the others."""
    sides = []
    for i, shares in enumerate((targets.source, targets.lang, targets.topic)):
        names = sorted({c[i] for c in cells})
        want = np.array([shares.get(x, 0.0) for x in names])
        sides.append((np.array([names.index(c[i]) for c in cells]), want / want.sum() if want.sum() else np.full(len(names), 1 / len(names))))
    return sides


def fitted(w: np.ndarray, sides: list[tuple[np.ndarray, np.ndarray]], turns: int = 500, close: float = 1e-12) -> np.ndarray:
    """w multiplied side by side until its marginals are those wanted: (places, amounts) of each side."""
    w, total = w.copy(), w.sum()
    for _ in range(turns):
        before = w.copy()
        for at, want in sides:
            now = np.bincount(at, w, len(want))
            w *= np.divide(want, now, out=np.zeros_like(want), where=now > 0)[at]
        if np.abs(w - before).max() <= close * total:
            break
    return w


def rake(tokens: dict[tuple, float], targets: Targets) -> dict[tuple, float]:
    """Factors by which the cells' tokens are multiplied so that the three marginals have the target shares of their sum."""
    cells = sorted(tokens)
    have = np.array([tokens[c] for c in cells], float)
    if not have.sum():
        return dict.fromkeys(cells, 1.0)
    w = fitted(have, [(at, share * have.sum()) for at, share in _sides(cells, targets)])
    return {c: float(x / h) if h else 0.0 for c, x, h in zip(cells, w, have)}


def probabilities(tokens: dict[tuple, float], targets: Targets) -> dict[tuple, float]:
    """The share of each cell that is kept, budget * all in sum if there is enough: raked to the targets, cells that are full aside."""
    cells = sorted(tokens)
    have = np.array([tokens[c] for c in cells], float)
    budget = targets.budget * have.sum()
    if not budget:
        return dict.fromkeys(cells, 0.0)
    sides, kept, full = _sides(cells, targets), np.zeros(len(cells)), np.zeros(len(cells), bool)
    while True:
        kept[full] = have[full]
        rest = ~full & (have > 0)
        open_ = budget - kept[full].sum()
        if not rest.any() or open_ <= 0:
            break
        left = []
        for at, share in sides:  # what the full cells leave of each target; a target that they pass asks for nothing more
            want = np.maximum(0.0, share * budget - np.bincount(at[full], have[full], len(share)))
            want[np.bincount(at[rest], minlength=len(share)) == 0] = 0.0
            left.append((at[rest], want / want.sum() * open_ if want.sum() else np.bincount(at[rest], have[rest], len(share)) / have[rest].sum() * open_))
        w = fitted(have[rest], left)
        w = w / w.sum() * open_ if w.sum() else have[rest] / have[rest].sum() * open_
        kept[rest] = w
        over = np.zeros(len(cells), bool)
        over[rest] = w >= have[rest] * (1 - 1e-12)
        if not over.any():
            break
        full |= over
    return {c: float(min(1.0, k / h)) if h else 0.0 for c, k, h in zip(cells, kept, have)}


def cell_counts(docs: DataFrame, targets: Targets, topic: Column | None = None) -> dict[tuple, float]:
    """Tokens of each cell; their number is bounded by the targets."""
    name = fresh(docs, "cell")
    counts = _celled(docs, targets, name, topic).groupBy(f"{name}.source", f"{name}.lang", f"{name}.topic").agg(F.sum(f"{name}.n").alias("n")).collect()
    return {tuple(r)[:3]: float(r["n"]) for r in counts}


def shares(tokens: dict[tuple, float], keep: dict[tuple, float], targets: Targets) -> list[tuple[str, str, float, float, float]]:
    """(side, value, target share, share of all tokens, expected share of the kept tokens) of each value that occurs or is asked for."""
    out, total, kept = [], sum(tokens.values()), sum(n * keep[c] for c, n in tokens.items())
    for i, (side, want) in enumerate((("source", targets.source), ("lang", targets.lang), ("topic", targets.topic))):
        for value in sorted({c[i] for c in tokens} | set(want)):
            own = [(n, n * keep[c]) for c, n in tokens.items() if c[i] == value]
            out.append((side, value, float(want.get(value, 0.0)), sum(n for n, _ in own) / total if total else 0.0, sum(k for _, k in own) / kept if kept else 0.0))
    return out


def reached(docs: DataFrame, targets: Targets | None = None, topic: Column | None = None) -> DataFrame:
    """side, value, target, available, reached: how near the kept tokens come to each target."""
    targets = targets or Targets()
    tokens = cell_counts(docs, targets, topic)
    return docs.sparkSession.createDataFrame(shares(tokens, probabilities(tokens, targets), targets), "side string, value string, target double, available double, reached double")


def chance(doc_id: Column) -> Column:
    """A number from 0 to 1 that depends on the id alone; null ids have one too."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit("mix:"), F.coalesce(doc_id.cast("string"), F.lit("null"))), 256), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def weighted(docs: DataFrame, targets: Targets | None = None, topic: Column | None = None) -> tuple[DataFrame, str]:
    """docs with one more column, a struct of source, lang, topic, n (tokens), factor, keep (probability) and drawn (boolean); and that column's name.

    Null sources, languages and topics are "*", null texts one token. Rows that repeat an id are drawn together. An empty table gives no rows.
    """
    targets = targets or Targets()
    tokens = cell_counts(docs, targets, topic)
    factors, keep = rake(tokens, targets), probabilities(tokens, targets)
    name, made = fresh(docs, "cell"), fresh(docs, "mixed")
    table = docs.sparkSession.createDataFrame([(*c, factors[c], keep[c]) for c in tokens], ", ".join(f"{name}{x} {t}" for x, t in (("s", "string"), ("l", "string"), ("t", "string"), ("f", "double"), ("k", "double"))))
    same = (F.col(f"{name}.source") == F.col(f"{name}s")) & (F.col(f"{name}.lang") == F.col(f"{name}l")) & (F.col(f"{name}.topic") == F.col(f"{name}t"))
    joined = _celled(docs, targets, name, topic).join(F.broadcast(table), same)  # bounded by the targets
    drawn = chance(F.col("doc_id")) < F.col(f"{name}k")
    return joined.select(*docs.columns, F.struct(f"{name}.*", F.col(f"{name}f").alias("factor"), F.col(f"{name}k").alias("keep"), drawn.alias("drawn")).alias(made)), made


def mix(docs: DataFrame, targets: Targets | None = None, topic: Column | None = None) -> DataFrame:
    """The documents that are drawn, with the columns of docs."""
    found, name = weighted(docs, targets, topic)
    return found.where(F.col(f"{name}.drawn")).select(*docs.columns)


def mix_report(docs: DataFrame, targets: Targets | None = None, topic: Column | None = None) -> DataFrame:
    """One row per document: doc_id, source_cell, lang_cell, topic, n_tokens, weight (factor), probability, drawn."""
    found, name = weighted(docs.select("doc_id", "text", "source", "lang"), targets, topic)
    parts = (("source", "source_cell"), ("lang", "lang_cell"), ("topic", "topic"), ("n", "n_tokens"), ("factor", "weight"), ("keep", "probability"), ("drawn", "drawn"))
    return found.select("doc_id", *(F.col(f"{name}.{x}").alias(y) for x, y in parts)).withColumn("n_tokens", F.col("n_tokens").cast("long"))
