"""Operator 2: mixing sources to target weights by hierarchical budgeting (DataFrame functions only).

The tree is domain > language > source.  A budget of tokens flows down: children share
their parent's budget by weight; a child that can't use its share (its subtree's
tokens times ``max_epochs``) is filled, and what it leaves goes to its siblings in
proportion to their weights.  As each node's capacity is that of its whole subtree, a
shortage reaches an ancestor's siblings only when all nearer siblings are full.
Shares are integers, rounded down.

A leaf takes whole epochs while its budget covers them, then a prefix, in the order
seeded for that epoch, of documents whose tokens together stay within the rest.
The prefix is found from totals of hash ranges of the order; only the one range in
which a leaf's cut falls is sorted, so a leaf with a third of all rows is never one
task's work, and texts are never shuffled.

Tokens are white-space words.  Null text has none; null language or source count as
the leaf ''; a source without a trailing number belongs to the domain 'other'.
Documents without tokens follow their place in the order.  Rows with equal ids are
taken or left together.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stash, table

LEAF = ["domain", "leaf_lang", "leaf_source"]
#: Targets of the registered query: weight by node name, and the weight of the rest.
WEIGHTS = {
    "domain": ({"0": 4, "1": 3, "2": 2, "3": 1}, 1),
    "leaf_lang": ({"en": 6, "de": 2, "fr": 2}, 1),
    "leaf_source": ({"src0": 3}, 1),
}


def weight(level: str, weights: dict) -> Column:
    named, rest = weights[level]
    out = F.lit(int(rest))
    for name, w in named.items():
        out = F.when(F.col(level) == name, int(w)).otherwise(out)
    return out.cast("long")


def with_leaf(docs: DataFrame) -> DataFrame:
    number = F.expr(r"try_cast(regexp_extract(source, '([0-9]+)$', 1) AS bigint)")
    return docs.withColumns({"domain": F.coalesce((number % 4).cast("string"), F.lit("other")), "leaf_lang": F.coalesce("lang", F.lit("")), "leaf_source": F.coalesce("source", F.lit(""))})


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def share(nodes: DataFrame, parent: list[str], level: str, weights: dict) -> DataFrame:
    """nodes(parent, level, cap, budget of the parent) with each child's own budget."""
    w = nodes.withColumn("w", weight(level, weights))
    up = Window.partitionBy(*parent).orderBy(F.col("cap").cast("double") / F.col("w"), level)
    w = w.withColumn("c0", F.coalesce(F.sum("cap").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    w = w.withColumn("w1", F.sum("w").over(up.rowsBetween(0, Window.unboundedFollowing)))
    w = w.withColumn("full", F.min((F.col("cap") * F.col("w1") <= (F.col("budget") - F.col("c0")) * F.col("w")).cast("int")).over(up.rowsBetween(Window.unboundedPreceding, 0)))
    every = Window.partitionBy(*parent)
    w = w.withColumn("left", F.col("budget") - F.sum(F.col("cap") * F.col("full")).over(every)).withColumn("open", F.sum(F.col("w") * (1 - F.col("full"))).over(every))
    return w.withColumn("budget", F.when(F.col("full") == 1, F.col("cap")).otherwise(F.expr("(left * w) div greatest(open, 1)"))).drop("w", "c0", "w1", "full", "left", "open")


def place(epoch: Column, seed: int) -> Column:
    """Order of a document in an epoch: 60 bits of a digest of seed, epoch and id."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def plan(rows: DataFrame, weights: dict, share_of: tuple[int, int], max_epochs: int, seed: int, per_range: int = 4096) -> DataFrame:
    """One row per leaf: epochs (whole ones) and the last (cut_place, cut_id) of the prefix.

    rows has doc_id, the leaf columns and n_tokens.
    """
    leaves = stash(rows.groupBy(*LEAF).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")).withColumn("cap", F.col("tokens") * max_epochs), "leaves")
    budget = leaves.agg(F.expr(f"coalesce(sum(tokens), 0) * {share_of[0]} div {share_of[1]}")).first()[0]
    lang = leaves.groupBy(*LEAF[:2]).agg(F.sum("cap").alias("cap"))
    domain = lang.groupBy("domain").agg(F.sum("cap").alias("cap")).withColumns({"budget": F.lit(budget).cast("long"), "root": F.lit(0)})
    domain = share(domain, ["root"], "domain", weights)
    lang = share(lang.join(domain.select("domain", "budget"), "domain"), ["domain"], "leaf_lang", weights)
    leaf = share(leaves.join(lang.select(*LEAF[:2], "budget"), LEAF[:2]), LEAF[:2], "leaf_source", weights)
    leaf = leaf.withColumn("epochs", F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(0)).withColumn("rest", F.when(F.col("tokens") > 0, F.expr("budget % tokens")).otherwise(0))
    leaf = stash(leaf.withColumn("ranges", F.expr(f"least(1048576, 1 + docs div {per_range})")).select(*LEAF, "budget", "tokens", "epochs", "rest", "ranges"), "budgets")

    at = rows.join(leaf, LEAF).withColumn("p", place(F.col("epochs"), seed)).withColumn("range", F.expr("shiftright(shiftright(p, 20) * ranges, 40)"))
    sums = at.groupBy(*LEAF, "range").agg(F.sum("n_tokens").alias("t"))
    order = Window.partitionBy(*LEAF).orderBy("range").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumn("upto", F.sum("t").over(order)).join(leaf.select(*LEAF, "rest"), LEAF)
    last = sums.where("upto > rest").groupBy(*LEAF).agg(F.min("range").alias("range"), F.min_by(F.col("upto") - F.col("t"), "range").alias("t0"))
    inside = Window.partitionBy(*LEAF).orderBy("p", "doc_id").rangeBetween(Window.unboundedPreceding, 0)
    near = at.join(last, [*LEAF, "range"]).withColumn("upto", F.col("t0") + F.sum("n_tokens").over(inside)).where("upto <= rest")
    cut = near.groupBy(*LEAF).agg(F.max(F.struct("p", "doc_id")).alias("cut"))
    out = leaf.join(last.select(*LEAF, "range"), LEAF, "left").join(cut, LEAF, "left")
    return stash(out.select(*LEAF, "budget", "epochs", "rest", "ranges", "range", F.col("cut.p").alias("cut_place"), F.col("cut.doc_id").alias("cut_id")), "plan")


def taken(rows: DataFrame, leaf_plan: DataFrame, seed: int) -> DataFrame:
    """rows with leaf columns, joined to the plan, and copies: how often each is taken (0 included)."""
    x = rows.join(leaf_plan, LEAF).withColumn("p", place(F.col("epochs"), seed))
    first = F.expr("range is null or shiftright(shiftright(p, 20) * ranges, 40) < range")
    upto = F.col("cut_place").isNotNull() & ((F.col("p") < F.col("cut_place")) | ((F.col("p") == F.col("cut_place")) & (F.coalesce("doc_id", F.lit(-(2**63))) <= F.coalesce("cut_id", F.lit(-(2**63))))))
    partial = F.when(F.col("range").isNull() | (F.col("rest") <= 0), F.lit(False)).otherwise(first | upto)
    return x.withColumn("copies", F.col("epochs") + partial.cast("long"))


def mix(docs: DataFrame, weights: dict = WEIGHTS, share_of: tuple[int, int] = (1, 2), max_epochs: int = 2, seed: int = 11) -> DataFrame:
    """doc_id, domain, lang, source, n_tokens, copies of the documents taken at least once."""
    rows = stash(with_leaf(docs).select("doc_id", *LEAF, n_words(F.col("text")).alias("n_tokens")), "tokens")
    out = taken(rows, plan(rows, weights, share_of, max_epochs, seed), seed).where("copies > 0")
    return out.select("doc_id", "domain", F.col("leaf_lang").alias("lang"), F.col("leaf_source").alias("source"), "n_tokens", "copies")


def mixed_documents(docs: DataFrame, weights: dict = WEIGHTS, share_of: tuple[int, int] = (9, 10), seed: int = 11) -> DataFrame:
    """The rows of docs, own columns only, that one epoch's mix takes."""
    keep = docs.columns
    rows = stash(with_leaf(docs).select("doc_id", *LEAF, n_words(F.col("text")).alias("n_tokens")), "tokens")
    named = with_leaf(docs.select("doc_id", "lang", "source", F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row_")))
    return taken(named, plan(rows, weights, share_of, 1, seed), seed).where("copies > 0").select("row_.*")


def op2_hierarchical_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def _case(level: str, weights: dict) -> str:
    named, rest = weights[level]
    return "CASE " + " ".join(f"WHEN {level} = '{k}' THEN {v}" for k, v in named.items()) + f" ELSE {rest} END"


def _share_sql(name: str, source: str, parent: str, level: str, weights: dict) -> str:
    return f"""
{name}_w AS (SELECT *, CAST({_case(level, weights)} AS BIGINT) AS w FROM {source}),
{name}_c AS (SELECT *, coalesce(sum(cap) OVER (PARTITION BY {parent} ORDER BY CAST(cap AS DOUBLE) / w, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c0,
  sum(w) OVER (PARTITION BY {parent} ORDER BY CAST(cap AS DOUBLE) / w, {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w1 FROM {name}_w),
{name}_f AS (SELECT *, min(CASE WHEN cap * w1 <= (budget - c0) * w THEN 1 ELSE 0 END) OVER (PARTITION BY {parent} ORDER BY CAST(cap AS DOUBLE) / w, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sat FROM {name}_c),
{name}_s AS (SELECT *, budget - sum(cap * sat) OVER (PARTITION BY {parent}) AS spare, sum(w * (1 - sat)) OVER (PARTITION BY {parent}) AS opened FROM {name}_f),
{name} AS (SELECT * EXCLUDE (w, c0, w1, sat, spare, opened, budget), CAST(CASE WHEN sat = 1 THEN cap ELSE (spare * w) // greatest(opened, 1) END AS BIGINT) AS budget FROM {name}_s)"""


def mix_sql(source: str = "documents", share_of: tuple[int, int] = (1, 2), max_epochs: int = 2, seed: int = 11, weights: dict = WEIGHTS) -> str:
    """DuckDB SQL of mix(): the same shares, with plain windows over whole leaves."""
    leaf = ", ".join(LEAF)
    return rf"""
WITH rows_ AS (SELECT doc_id, coalesce(CAST(try_cast(regexp_extract(source, '([0-9]+)$', 1) AS BIGINT) % 4 AS VARCHAR), 'other') AS domain,
  coalesce(lang, '') AS leaf_lang, coalesce(source, '') AS leaf_source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens FROM {source}),
leaves AS (SELECT {leaf}, CAST(sum(n_tokens) AS BIGINT) AS tokens, CAST(sum(n_tokens) * {max_epochs} AS BIGINT) AS cap FROM rows_ GROUP BY ALL),
root AS (SELECT CAST(coalesce(sum(tokens), 0) * {share_of[0]} // {share_of[1]} AS BIGINT) AS budget FROM leaves),
d0 AS (SELECT domain, CAST(sum(cap) AS BIGINT) AS cap, any_value(budget) AS budget FROM leaves, root GROUP BY domain),
{_share_sql('d', 'd0', '1', 'domain', weights)},
l0 AS (SELECT l.domain, leaf_lang, CAST(sum(l.cap) AS BIGINT) AS cap, any_value(d.budget) AS budget FROM leaves l JOIN d USING (domain) GROUP BY ALL),
{_share_sql('l', 'l0', 'domain', 'leaf_lang', weights)},
s0 AS (SELECT leaves.*, l.budget FROM leaves JOIN l USING (domain, leaf_lang)),
{_share_sql('s', 's0', 'domain, leaf_lang', 'leaf_source', weights)},
e AS (SELECT {leaf}, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS epochs, CASE WHEN tokens > 0 THEN budget % tokens ELSE 0 END AS rest FROM s),
p AS (SELECT r.*, epochs, rest, CAST('0x' || substr(md5('{seed}:' || epochs || ':' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS p FROM rows_ r JOIN e USING ({leaf})),
u AS (SELECT *, sum(n_tokens) OVER (PARTITION BY {leaf} ORDER BY p, doc_id NULLS FIRST RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM p)
SELECT doc_id, domain, leaf_lang AS lang, leaf_source AS source, n_tokens, CAST(epochs + CASE WHEN upto <= rest AND rest > 0 THEN 1 ELSE 0 END AS BIGINT) AS copies
FROM u WHERE epochs + CASE WHEN upto <= rest AND rest > 0 THEN 1 ELSE 0 END > 0
"""


OP2_SQL = mix_sql()
