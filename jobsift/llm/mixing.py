"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed by cell of source, language and topic. Raking scales the cells in turn until their
weighted sums meet the target share of each source, each language and each topic. A cell's weight times a
common rate is its documents' probability of being kept; a hash of the id decides. The rate is as high as it
can be without a probability over 1, so that the kept tokens have the target shares. Up to BROADCAST_ROWS
cells are raked on the driver; more stay in a table, where each step is a sum by value. The weight of a cell is
the product of a factor for each of its values, so such a table only ever meets tables of values. The
documents don't leave their partitions, unless a column has over BROADCAST_ROWS values.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, join_groups, stage, unstage

OTHER = "other"
ROUNDS = 100
TOLERANCE = 1e-9
#: Bytes of UTF-8 that count as one token.
TOKEN_BYTES = 4

Cells = dict[tuple[str, ...], float]


@dataclass(frozen=True)
class Marginal:
    """A column's target shares by value. Values that aren't named, and null, count as other, which has the share
    of tokens that it has unless it has a target. With flatten, the targets are found from the tokens: shares
    to that power, made to sum to 1, so that large values shrink and small ones grow; every value
    has a target of its own, and null is other."""

    column: str
    targets: dict[str, float] = field(default_factory=dict)
    flatten: float | None = None

    def label(self) -> Column:
        value = F.col(f"`{self.column}`").cast("string")
        if self.flatten is not None:
            return F.coalesce(value, F.lit(OTHER))
        return F.when(value.isin([v for v in self.targets if v != OTHER]), value).otherwise(F.lit(OTHER))

    def found(self, tokens: dict[str, float]) -> Marginal:
        """This marginal with targets for a column that has so many tokens by label."""
        total = sum(tokens.values())
        if self.flatten is not None:
            raised = {v: (n / total) ** self.flatten for v, n in tokens.items() if n}
            return Marginal(self.column, {v: x / sum(raised.values()) for v, x in raised.items()}, self.flatten)
        rest = sum(n for v, n in tokens.items() if v not in self.targets)
        if not rest or OTHER in self.targets:
            return self
        named = sum(self.targets[v] for v in self.targets if tokens.get(v))
        return Marginal(self.column, {**self.targets, OTHER: named * rest / (total - rest) if named else 1.0})


@dataclass(frozen=True)
class Mixture:
    """What raking found. residual: the largest difference between a share of the tokens that are kept on
    average and its target; over 0 only if no weights meet all targets. weights has the cells that were raked on the driver;
    of more cells factors has a staged table (value, factor, n) for each marginal."""

    marginals: list[Marginal]
    weights: Cells
    rate: float
    residual: float
    factors: list[DataFrame] = field(default_factory=list)

    def probability(self, cell: tuple[str, ...]) -> float:
        return min(1.0, self.rate * self.weights[cell])


def token_estimate(text: str = "text") -> Column:
    """Tokens of a text for weighting: one for each TOKEN_BYTES bytes, and one more for its end. Scripts
    without spaces count like others."""
    return (F.floor(F.octet_length(F.coalesce(F.col(text), F.lit(""))) / TOKEN_BYTES) + 1).cast("long")


def form_topic(text: str = "text") -> Column:
    """A topic for tables that have none: what form the text has."""
    size = F.length(F.coalesce(F.col(text), F.lit("")))
    return F.when(size < 400, "note").when(size < 2000, "article").when(size < 10000, "essay").otherwise("book")


def wanted_shares(cells: Cells, marginals: list[Marginal]) -> list[dict[str, float]]:
    """The target share of each value that has tokens, in each marginal. Shares of values without tokens
    go to the others in proportion; a value that has tokens but no target keeps none."""
    wanted = []
    for i, m in enumerate(marginals):
        own = {v: m.targets.get(v, 0.0) for v in {c[i] for c, n in cells.items() if n}}
        s = sum(own.values())
        wanted.append({v: x / s if s else 1 / len(own) for v, x in own.items()})
    return wanted


def shares(cells: Cells, weight: Cells, i: int) -> dict[str, float]:
    """The share of the weighted tokens that each value of marginal i has."""
    now: dict[str, float] = {}
    for c, n in cells.items():
        now[c[i]] = now.get(c[i], 0.0) + n * weight[c]
    total = sum(now.values())
    return {v: x / total if total else 0.0 for v, x in now.items()}


def rake(cells: Cells, marginals: list[Marginal]) -> Cells:
    """A factor for each cell, so that the factors times the cells' tokens have the target shares and sum
    to the cells' sum."""
    total = sum(cells.values())
    weight = dict.fromkeys(cells, 1.0)
    if not total:
        return weight
    wanted = wanted_shares(cells, marginals)
    for _ in range(ROUNDS):
        moved = 0.0
        for i, target in enumerate(wanted):
            now = shares(cells, weight, i)
            mass = sum(n * weight[c] for c, n in cells.items())
            for c, n in cells.items():
                if n:
                    f = target[c[i]] * total / (now[c[i]] * mass) if now[c[i]] else 0.0
                    moved = max(moved, abs(f - 1) if target[c[i]] else 0.0)
                    weight[c] *= f
        if moved < TOLERANCE:
            break
    return weight


def plan(cells: Cells, marginals: list[Marginal], keep: float) -> Mixture:
    """Weights and rate for about the share keep of all tokens in the target mix. A document can't be kept
    more than once, so the rate is lower where a weight needs that."""
    weight = rake(cells, marginals)
    most = max((weight[c] for c, n in cells.items() if n), default=1.0)
    wanted = wanted_shares(cells, marginals)
    gaps = [abs(shares(cells, weight, i)[v] - x) for i, target in enumerate(wanted) for v, x in target.items()]
    return Mixture(marginals, weight, min(keep, 1 / most if most else keep), max(gaps, default=0.0))


def chance(key: str, seed: int) -> Column:
    """A number from 0 to 1 by the id; rows with the same id share it, and so do null ids."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def _with_topic(docs: DataFrame, marginals: Iterable[Marginal], text: str) -> DataFrame:
    if any(m.column == "topic" for m in marginals) and "topic" not in [c.lower() for c in docs.columns]:
        docs = docs.withColumn("topic", form_topic(text))
    return docs


def _columns(marginals: list[Marginal]) -> list[str]:
    return [f"_jobsift_{i}" for i in range(len(marginals))]


def _with_factors(rows: DataFrame, factors: list[DataFrame], columns: list[str], total: int | None = None) -> DataFrame:
    """Add w, the product of the factors of a row's values. Tables of up to BROADCAST_ROWS values are broadcast; of
    larger ones the values with a thousandth of all rows. total: the rows, if factors count rows."""
    for c, f in zip(columns, factors, strict=True):
        own = f.select(F.col("value").alias(c), F.col("factor").alias(f"{c}_f"), F.col("n").alias(f"{c}_n"))
        if f.count() <= BROADCAST_ROWS:
            rows = rows.join(F.broadcast(own), c)
        else:
            rows = join_groups(rows, own, c, f"{c}_n", total) if total else rows.join(own, c)
    w = F.lit(1.0)
    for c in columns:
        w = w * F.col(f"{c}_f")
    return rows.withColumn("_jobsift_w", w).drop(*[f"{c}{x}" for c in columns for x in ("_f", "_n")])


def rake_table(cells: DataFrame, marginals: list[Marginal], keep: float) -> Mixture:
    """rake() and plan() for cells in a staged table: a column of labels for each marginal, _jobsift_n tokens and
    _jobsift_rows rows. Each step sums the weighted tokens by value and stages a new table of that marginal's factors."""
    columns = _columns(marginals)
    total = float(cells.agg(F.sum("_jobsift_n")).first()[0])
    factors = []
    for m, c in zip(marginals, columns, strict=True):
        sums = stage(cells.groupBy(F.col(c).alias("value")).agg(F.sum("_jobsift_n").cast("double").alias("tokens"), F.sum("_jobsift_rows").alias("n")), "values")
        if m.flatten is not None:
            goal = sums.select("value", "n", F.pow(F.col("tokens") / total, m.flatten).alias("g"))
        else:
            known = m.found({r.value: r.tokens for r in sums.collect()})  # the named values and other
            named = cells.sparkSession.createDataFrame([*known.targets.items()], "value string, g double")
            goal = sums.join(F.broadcast(named), "value", "left").select("value", "n", F.coalesce("g", F.lit(0.0)).alias("g"))
        whole = goal.agg(F.sum("g")).first()[0]
        share = F.col("g") / whole if whole else F.lit(1.0) / sums.count()
        factors.append(stage(goal.select("value", "n", share.alias("g"), F.lit(1.0).alias("factor")), "factors"))
        unstage(sums)
    for _ in range(ROUNDS):
        moved = 0.0
        for i, c in enumerate(columns):
            mass = _with_factors(cells, factors, columns).groupBy(F.col(c).alias("value")).agg(F.sum(F.col("_jobsift_n") * F.col("_jobsift_w")).alias("mass"))
            step = F.when(F.col("mass") > 0, F.col("g") * total / F.col("mass")).otherwise(0.0)
            new = stage(factors[i].join(mass, "value").select("value", "n", "g", (F.col("factor") * step).alias("factor"), F.when(F.col("g") > 0, F.abs(step - 1)).otherwise(0.0).alias("moved")), "factors")
            moved = max(moved, new.agg(F.max("moved")).first()[0])
            unstage(factors[i])
            factors[i] = new
        if moved < TOLERANCE:
            break
    weighted = stage(_with_factors(cells, factors, columns), "weighted")
    most, mass = weighted.agg(F.max(F.when(F.col("_jobsift_n") > 0, F.col("_jobsift_w"))), F.sum(F.col("_jobsift_n") * F.col("_jobsift_w"))).first()
    gaps = []
    for c, f in zip(columns, factors, strict=True):
        now = weighted.groupBy(F.col(c).alias("value")).agg((F.sum(F.col("_jobsift_n") * F.col("_jobsift_w")) / mass).alias("now"))
        gaps.append(f.join(now, "value").agg(F.max(F.abs(F.col("now") - F.col("g")))).first()[0])
    unstage(weighted)
    return Mixture(marginals, {}, min(keep, 1 / most if most else keep), max(gaps), factors)


def fit(docs: DataFrame, marginals: list[Marginal], keep: float = 0.5, text: str = "text", tokens: Column | None = None) -> Mixture:
    """Sum tokens by value in one pass over the documents, and rake them. tokens: a column of true counts, else they are
    estimated."""
    columns = _columns(marginals)
    labels = [m.label().alias(c) for m, c in zip(marginals, columns, strict=True)]
    size = token_estimate(text) if tokens is None else tokens
    sums = _with_topic(docs, marginals, text).groupBy(*labels).agg(F.sum(size).alias("_jobsift_n"), F.count("*").alias("_jobsift_rows"))
    sums = stage(sums, "tokens")
    if sums.count() > BROADCAST_ROWS:
        found = rake_table(sums, marginals, keep)
        unstage(sums)
        return found
    cells = {tuple(r)[: len(columns)]: float(r._jobsift_n or 0) for r in sums.collect()}
    unstage(sums)
    known = []
    for i, m in enumerate(marginals):
        totals: dict[str, float] = {}
        for cell, n in cells.items():
            totals[cell[i]] = totals.get(cell[i], 0.0) + n
        known.append(m.found(totals) if any(totals.values()) else m)
    return plan(cells, known, keep)


def mix(
    docs: DataFrame,
    marginals: list[Marginal],
    keep: float = 0.5,
    key: str = "doc_id",
    text: str = "text",
    seed: int = 42,
    mixture: Mixture | None = None,
    tokens: Column | None = None,
) -> DataFrame:
    """Add tokens, weight, probability and kept to every row, and topic where a marginal asks for it and the
    table has none. mixture: what fit() found, if it is known. tokens: a column of true counts, else they are estimated.

    Kept tokens have the target shares on average, as near as Mixture.residual says. Values without a target
    are sampled too, and so are nulls; values may hold any characters. Null and empty texts have one token, a very
    long text as many as it has; rows that repeat an id are kept or left together. An empty table gives an empty
    result. Columns of the input pass through; those named like a new one are replaced, topic excepted, and
    names that begin with _jobsift are reserved."""
    found = mixture or fit(docs, marginals, keep, text, tokens)
    columns = _columns(found.marginals)
    size = token_estimate(text) if tokens is None else tokens
    marked = _with_topic(docs.withColumn("_jobsift_size", size), marginals, text).drop("tokens", "weight", "probability", "kept")
    marked = marked.withColumnRenamed("_jobsift_size", "tokens")
    marked = marked.withColumns({c: m.label() for m, c in zip(found.marginals, columns, strict=True)})
    if found.factors:
        out = _with_factors(marked, found.factors, columns, docs.count()).withColumnRenamed("_jobsift_w", "weight")
        out = out.withColumn("probability", F.least(F.lit(1.0), found.rate * F.col("weight")))
    else:
        rates = [(*c, found.weights[c], found.probability(c)) for c in sorted(found.weights)]
        table = docs.sparkSession.createDataFrame(rates, ", ".join([*(f"{c} string" for c in columns), "weight double, probability double"]))
        out = marked.join(F.broadcast(table), columns)  # up to BROADCAST_ROWS cells
    return out.drop(*columns).withColumn("kept", chance(key, seed) < F.col("probability"))
