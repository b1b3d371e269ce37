"""Mixing sources to target weights: hierarchical token budgets.

The corpus is a tree of domain, language and source.  A budget of tokens flows
from the root: a node's budget is shared among its children by weight, no child
gets more than its subtree can give (its tokens times ``max_epochs``), and what
a child cannot use goes to its siblings in proportion to their weights.  Since
a node never gets more than its subtree can use, a shortage is made good among
siblings first and reaches the siblings of an ancestor only when the whole
subtree is used up.

Sharing with limits has a closed form: with siblings sorted by limit / weight,
the share per weight is the largest of (budget - limits before) / (weights from
here on), so each level of the tree is one window over its nodes.

A leaf takes whole epochs of its documents and, from the next epoch, the prefix
in seeded order whose tokens fit in the rest.  The end of the prefix is found
over hash buckets first and over the documents of one bucket then, so no task
sorts a whole leaf.  The outcome per leaf is a few numbers; documents are
selected by comparing their hash with them and are not shuffled, as long as
Spark finds the table of leaves small enough to broadcast.

Defined cases: null levels are nodes of their own; a node with weight 0 or less
gets nothing; rows that repeat an id within a leaf are taken or left together;
rows without an id likewise; texts without tokens go with every epoch and with
the prefix they are sorted into; a leaf without any token is never used; an
empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_CLASS, doc_key, written

_NONE = "\u0000"  # a null level; sorts before every name
_BUCKET_BITS, _DRAW_BITS = 10, 60


@dataclass(frozen=True)
class Level:
    """One level of the tree: a column expression and the weights of its values."""

    name: str
    sql: str
    weights: dict[str, float] = field(default_factory=dict)
    default: float = 1.0

    def key(self) -> Column:
        return F.coalesce(F.expr(self.sql).cast("string"), F.lit(_NONE))

    def weight(self, key: str) -> Column:
        out = F.lit(float(self.default))
        for value, weight in self.weights.items():
            out = F.when(F.col(key) == value, F.lit(float(weight))).otherwise(out)
        return F.greatest(out, F.lit(0.0))


#: Production targets: half of the tokens from the web sources, a third from
#: forums, the rest from reference works; English first; sources alike.
TARGETS = (
    Level("domain", "CASE WHEN source IN ('src0', 'src1', 'src2', 'src3', 'src4', 'src5', 'src6', 'src7') THEN 'web' "
                    "WHEN source IN ('src8', 'src9', 'src10', 'src11', 'src12', 'src13') THEN 'forum' "
                    "ELSE 'reference' END", {"web": 0.5, "forum": 0.3, "reference": 0.2}),
    Level("lang", "lang", {"en": 0.55, "de": 0.2, "fr": 0.15, "es": 0.1}, 0.05),
    Level("source", "source"),
)
#: Tokens to deal out as a share of the corpus's, and how often a document may be used.
BUDGET_SHARE = 1.0
MAX_EPOCHS = 2
SEED = 20


def draw(seed: int, epoch: Column, key: Column) -> Column:
    """Place of a document in the seeded order of an epoch: 60 bits of a digest."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), key.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(f"`{text}`").cast("string"),
                                     F.lit(SPACE_CLASS.replace("[", "[^", 1) + "+")), F.lit(0)).cast("long")


def share_out(nodes: DataFrame, parents: list[str], order: list[str]) -> DataFrame:
    """``nodes`` (``budget`` of the parent, ``weight``, ``limit``) with ``tokens_due``."""
    w = Window.partitionBy(*parents).orderBy(F.col("limit") / F.col("weight"), *order)
    level = ((F.col("budget") - F.coalesce(F.sum("limit").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
             / F.sum("weight").over(w.rowsBetween(0, Window.unboundedFollowing)))
    return (nodes.where("weight > 0")
            .withColumn("per_weight", level)
            .withColumn("per_weight", F.max("per_weight").over(Window.partitionBy(*parents)))
            # A millionth of a token more, lest rounding takes a whole one.
            .withColumn("tokens_due", F.floor(F.least(
                F.col("limit").cast("double"), F.greatest(F.col("per_weight"), F.lit(0.0)) * F.col("weight")) + 1e-6).cast("long"))
            .drop("per_weight"))


def leaf_budgets(leaves: DataFrame, levels: tuple[Level, ...], total: Column, max_epochs: int) -> DataFrame:
    """``k1.., tokens, tokens_due`` per leaf; ``leaves`` has ``k1.., tokens``."""
    keys = [f"k{i}" for i in range(1, len(levels) + 1)]
    limits = leaves.withColumn("limit", F.col("tokens") * F.lit(max_epochs))
    due = None
    for i, level in enumerate(levels, 1):
        own, parents = keys[:i], keys[:i - 1]
        nodes = limits.groupBy(*own).agg(F.sum("limit").alias("limit")).withColumn("weight", level.weight(own[-1]))
        nodes = (nodes.withColumn("budget", total) if due is None
                 else nodes.join(due.withColumnRenamed("tokens_due", "budget"), parents))
        due = share_out(nodes, parents or [F.lit(0)], own).select(*own, "tokens_due")
    return leaves.join(due, keys)


def plan(docs: DataFrame, levels: tuple[Level, ...], tokens: Column, budget_share: float, max_epochs: int, seed: int,
         doc_id: str = "doc_id") -> DataFrame:
    """Per leaf: ``k1.., epochs`` (whole ones) and the end of the prefix of the
    next, ``cut_h, cut_d`` (null: no prefix).  One row per leaf, written."""
    keys = [f"k{i}" for i in range(1, len(levels) + 1)]
    items = written(docs.select(*[lv.key().alias(k) for k, lv in zip(keys, levels)], doc_key(doc_id).alias("d"),
                                tokens.alias("n")).groupBy(*keys, "d").agg(F.sum("n").alias("n")), "mix-items")
    leaves = items.groupBy(*keys).agg(F.sum("n").alias("tokens"))
    total = leaves.agg(F.sum("tokens")).first()[0] or 0
    due = leaf_budgets(leaves, levels, F.lit(int(total * budget_share)), max_epochs)
    budgets = written(due.select(
        *keys, F.when(F.col("tokens") > 0, F.expr("tokens_due div tokens")).otherwise(0).cast("long").alias("epochs"),
        F.when(F.col("tokens") > 0, F.col("tokens_due") % F.col("tokens")).otherwise(0).cast("long").alias("rest")),
        "mix-budgets")
    drawn = (items.join(budgets.where("rest > 0"), keys)
             .withColumn("h", draw(seed, F.col("epochs"), F.col("d")))
             .withColumn("b", F.shiftright("h", _DRAW_BITS - _BUCKET_BITS)))
    per_bucket = drawn.groupBy(*keys, "b").agg(F.sum("n").alias("n"), F.first("rest").alias("rest"))
    w = Window.partitionBy(*keys).orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # The bucket in which the prefix ends: the first whose tokens no longer fit.
    border = (per_bucket.withColumn("upto", F.sum("n").over(w)).where("upto > rest")
              .groupBy(*keys).agg(F.min(F.struct("b", (F.col("upto") - F.col("n")).alias("before"))).alias("x"))
              .select(*keys, F.col("x.b").alias("b"), F.col("x.before").alias("before")))
    v = Window.partitionBy(*keys).orderBy("h", "d").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = (drawn.join(border, [*keys, "b"]).withColumn("upto", F.col("before") + F.sum("n").over(v))
            .where("upto <= rest").groupBy(*keys).agg(F.max(F.struct("h", "d")).alias("x")))
    ends = (border.join(last, keys, "left")
            # No document of that bucket fits: everything below the bucket is in.
            .select(*keys, F.coalesce(F.col("x.h"), F.shiftleft(F.col("b").cast("long"), _DRAW_BITS - _BUCKET_BITS)).alias("cut_h"),
                    F.coalesce(F.col("x.d"), F.lit(-(1 << 63))).alias("cut_d")))
    return written(budgets.join(ends, keys, "left").select(*keys, "epochs", "cut_h", "cut_d"), "mix-plan")


def mix(docs: DataFrame, levels: tuple[Level, ...] = TARGETS, tokens: Column | None = None,
        budget_share: float = BUDGET_SHARE, max_epochs: int = MAX_EPOCHS, seed: int = SEED, doc_id: str = "doc_id",
        text: str = "text", epoch: str = "epoch") -> DataFrame:
    """One row of ``docs`` per time it is used, with its ``epoch`` (from 0); a
    column of ``docs`` with that name is replaced."""
    cols = [c for c in docs.columns if c.lower() != epoch.lower()]
    docs = docs.select(*[f"`{c}`" for c in cols])
    leaves = plan(docs, levels, tokens if tokens is not None else word_count(text), budget_share, max_epochs, seed, doc_id)
    pre = "_mix_"
    while any(c.lower().startswith(pre) for c in cols):
        pre = f"_{pre}"
    keys = [f"{pre}k{i}" for i in range(1, len(levels) + 1)]
    named = leaves.select(*[F.col(c).alias(f"{pre}{c}") for c in leaves.columns])
    rows = docs.withColumns({k: lv.key() for k, lv in zip(keys, levels)}).withColumn(f"{pre}d", doc_key(doc_id))
    both = rows.join(named, keys)
    h, cut = draw(seed, F.col(f"{pre}epochs"), F.col(f"{pre}d")), F.col(f"{pre}cut_h")
    more = F.coalesce((h < cut) | ((h == cut) & (F.col(f"{pre}d") <= F.col(f"{pre}cut_d"))), F.lit(False))
    times = F.col(f"{pre}epochs").cast("int") + more.cast("int")
    return (both.withColumn(f"{pre}n", times).where(F.col(f"{pre}n") > 0)
            .select(*[f"`{c}`" for c in cols], F.explode(F.sequence(F.lit(0), F.col(f"{pre}n") - 1)).alias(epoch)))
