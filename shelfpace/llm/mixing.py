"""Mixing sources to target weights down a tree of domain, language and source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfpace.llm.sqltext import one_space
from shelfpace.llm.staging import stage

LEVELS = ("domain", "lang", "source")
# Weight of each language inside its domain; others get the last value. Domains and sources weigh alike.
LANG_WEIGHTS = {"en": 5, "de": 2, "fr": 2, "es": 1}
OTHER_WEIGHT = 1
SHARE = 0.8  # of the tokens there are, the budget to be mixed
SEED = "mix-1"
BINS = 4096  # of the shuffled order of a leaf, by the first three hexadecimal digits


def n_tokens(text: Column) -> Column:
    """Words of a text separated by ASCII white space."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    return F.size(F.filter(F.split(one_space(t), " "), lambda w: w != "")).cast("long")


def domain(source: Column) -> Column:
    """The kind of a source: its first digit, for the invented source names."""
    return F.concat(F.lit("domain"), F.regexp_extract(source, "([0-9])", 1))


def _share_out(nodes: DataFrame, parent: list[str]) -> DataFrame:
    """Split each parent's ``budget`` among its children by ``weight``, none above its ``supply``.

    What a full child leaves over goes to its siblings in proportion to their weights. In the order of supply per weight
    the full children come first, so running sums tell for each child what is left when all before it are full.
    """
    order = Window.partitionBy(*parent).orderBy((F.col("supply") / F.col("weight")).asc(), *[F.col(c).asc_nulls_first() for c in LEVELS if c in nodes.columns])
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*parent)
    rows = nodes.withColumn("left", F.col("budget") - F.coalesce(F.sum("supply").over(before), F.lit(0)))
    rows = rows.withColumn("weight_left", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    rows = rows.withColumn("full", F.col("supply") * F.col("weight_left") <= F.col("left") * F.col("weight"))
    first = F.min(F.when(~F.col("full"), F.struct((F.col("supply") / F.col("weight")).alias("r"), -F.col("left"), "left", "weight_left"))).over(whole)
    rows = rows.withColumn("open", first)
    share = F.floor(F.col("open.left") * F.col("weight") / F.col("open.weight_left"))
    return rows.withColumn("budget", F.when(F.col("full"), F.col("supply")).otherwise(share).cast("long")).drop("left", "weight_left", "full", "open")


def leaf_budgets(sizes: DataFrame, share: float = SHARE, epochs: int = 1, lang_weights: dict[str, int] = LANG_WEIGHTS) -> DataFrame:
    """domain, lang, source, supply, budget for each leaf, from its tokens ``supply``.

    The root's budget is ``share`` of all tokens. It goes down level by level; a leaf can give its supply ``epochs`` times
    at most. A shortage goes to siblings first, because a node never gets more than its whole subtree can give, and only
    what the subtree cannot give reaches the siblings above.
    """
    lang_weight = F.lit(OTHER_WEIGHT)
    for lang, w in lang_weights.items():
        lang_weight = F.when(F.col("lang") == lang, F.lit(w)).otherwise(lang_weight)
    leaves = sizes.withColumn("supply", F.col("supply") * epochs)
    total = leaves.agg(F.floor(F.coalesce(F.sum("supply"), F.lit(0)) / F.lit(epochs) * F.lit(share)).cast("long").alias("budget"))
    nodes = {}
    for depth in (1, 2, 3):
        nodes[depth] = leaves.groupBy(*LEVELS[:depth]).agg(F.sum("supply").alias("supply")).withColumn("weight", F.when(F.lit(depth == 2), lang_weight).otherwise(F.lit(1)) if depth == 2 else F.lit(1))
    # One row of totals to each of the domains.
    budgets = _share_out(nodes[1].join(F.broadcast(total)).withColumn("all", F.lit(0)), ["all"]).drop("all")
    for depth in (2, 3):
        above = budgets.select(*[F.col(c).alias(f"up_{c}") for c in LEVELS[: depth - 1]], "budget")
        same = F.lit(True)
        for c in LEVELS[: depth - 1]:
            same = same & F.col(c).eqNullSafe(F.col(f"up_{c}"))
        joined = nodes[depth].join(above, same).drop(*[f"up_{c}" for c in LEVELS[: depth - 1]])
        budgets = _share_out(joined, list(LEVELS[: depth - 1]))
    return budgets.select(*LEVELS, (F.col("supply") / epochs).cast("long").alias("supply"), "budget")


def _position(seed: str, epoch: Column, key: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), epoch.cast("string"), F.coalesce(key.cast("string"), F.lit(""))))


def choose(docs: DataFrame, share: float = SHARE, epochs: int = 1, seed: str = SEED) -> DataFrame:
    """doc_id, domain, lang, source, n_tokens, epoch of the chosen documents.

    A leaf's budget first takes whole epochs of the leaf, then from the next epoch the longest beginning, in the order of
    a hash of seed, epoch and doc_id, whose tokens fit. The order is cut into bins: sums per bin say which bins are taken
    whole, and only the documents of the one bin in which the budget ends are ordered one by one, so no task sorts a leaf.

    Null text has no tokens; documents without tokens are free and follow their place in the order. Null languages or
    sources form leaves of their own. Rows that repeat a doc_id stand side by side and are chosen one by one. Other
    columns are not read. An empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), domain(F.col("source")).alias("domain"), "lang", "source", n_tokens(F.col("text")).alias("n_tokens"))
    rows = stage(rows, "mix-rows")
    leaves = rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("supply"))
    budgets = leaf_budgets(leaves, share, epochs).withColumn("full_epochs", F.when(F.col("supply") > 0, F.floor(F.col("budget") / F.col("supply"))).otherwise(1))
    budgets = stage(budgets.withColumn("rest", F.col("budget") - F.col("full_epochs") * F.col("supply")), "mix-budgets")
    same = [F.col(c).eqNullSafe(F.col(f"b_{c}")) for c in LEVELS]
    leaf = budgets.select(*[F.col(c).alias(f"b_{c}") for c in LEVELS], "full_epochs", "rest")
    joined = rows.join(leaf, same[0] & same[1] & same[2]).drop(*[f"b_{c}" for c in LEVELS])
    whole = joined.filter("full_epochs > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), (F.col("full_epochs") - 1).cast("int"))))
    part = joined.withColumn("epoch", F.col("full_epochs").cast("int")).filter(F.col("epoch") < epochs)
    part = part.withColumn("place", _position(seed, F.col("epoch"), F.col("doc_id"))).withColumn("bin", F.substring("place", 1, 3))
    order = Window.partitionBy(*LEVELS).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = part.groupBy(*LEVELS, "bin").agg(F.sum("n_tokens").alias("in_bin")).withColumn("before", F.coalesce(F.sum("in_bin").over(order), F.lit(0)))
    bins = bins.select(*[F.col(c).alias(f"b_{c}") for c in LEVELS], F.col("bin").alias("b_bin"), "in_bin", "before")
    placed = part.join(bins, same[0] & same[1] & same[2] & (F.col("bin") == F.col("b_bin"))).filter("before <= rest")
    inside = placed.filter("before + in_bin <= rest")
    edge = placed.filter("before + in_bin > rest")
    running = Window.partitionBy(*LEVELS, "bin").orderBy("place", F.col("doc_id").asc_nulls_first(), "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    edge = edge.withColumn("upto", F.col("before") + F.sum("n_tokens").over(running)).filter("upto <= rest")
    columns = ["doc_id", *LEVELS, "n_tokens", "epoch"]
    return whole.select(*columns).unionByName(inside.select(*columns)).unionByName(edge.select(*columns))


def mixed(docs: DataFrame, share: float = SHARE, seed: str = SEED) -> DataFrame:
    """The chosen rows of ``docs`` with all their columns, each at most once.

    Rows are told apart by doc_id and text; of rows that repeat both, as many stay as were chosen of that doc_id. A null doc_id is
    an id like others. An empty table gives an empty result.
    """
    taken = {c.lower() for c in docs.columns}
    mix_id, mix_n, mix_k = (next(n for n in (name + "_" * k for k in range(len(taken) + 1)) if n not in taken) for name in ("mix_id", "mix_n", "mix_k"))
    chosen = choose(docs, share, 1, seed).groupBy("doc_id").agg(F.count("*").alias(mix_n)).withColumnRenamed("doc_id", mix_id)
    joined = docs.join(stage(chosen, "mix-chosen"), F.col("doc_id").cast("long").eqNullSafe(F.col(mix_id)))
    # Rows of one doc_id, in the order in which they were chosen.
    several = Window.partitionBy("doc_id").orderBy(n_tokens(F.col("text")), F.col("text").asc_nulls_first())
    return joined.withColumn(mix_k, F.row_number().over(several)).filter(F.col(mix_k) <= F.col(mix_n)).select(*docs.columns)


# The same for up to two epochs, as SQL.
ORACLE = f"""
WITH d AS (
  SELECT doc_id, 'domain' || regexp_extract(source, '([0-9])', 1) AS domain, lang, source,
         CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')) AS BIGINT) AS n_tokens
  FROM documents),
l AS (SELECT domain, lang, source, 2 * CAST(sum(n_tokens) AS BIGINT) AS supply FROM d GROUP BY ALL),
n1 AS (SELECT domain, CAST(sum(supply) AS BIGINT) AS supply, 1 AS weight FROM l GROUP BY ALL),
n2 AS (SELECT domain, lang, CAST(sum(supply) AS BIGINT) AS supply,
         CASE lang {" ".join(f"WHEN '{k}' THEN {v}" for k, v in LANG_WEIGHTS.items())} ELSE {OTHER_WEIGHT} END AS weight FROM l GROUP BY ALL),
s1 AS (SELECT *, (SELECT CAST(floor(CAST(sum(supply) AS DOUBLE) / 2 * CAST({SHARE} AS DOUBLE)) AS BIGINT) FROM l) AS b FROM n1),
r1 AS (SELECT *, b - coalesce(sum(supply) OVER w, 0) AS lft, sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS wl FROM s1
  WINDOW w AS (ORDER BY supply / weight, domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
o1 AS (SELECT lft, wl FROM r1 WHERE supply * wl > lft * weight ORDER BY supply / weight, lft DESC LIMIT 1),
b1 AS (SELECT domain, CASE WHEN supply * wl <= lft * weight THEN supply ELSE CAST(floor(CAST((SELECT lft FROM o1) * weight AS DOUBLE) / (SELECT wl FROM o1)) AS BIGINT) END AS b FROM r1),
r2 AS (SELECT n2.*, b, b - coalesce(sum(supply) OVER w, 0) AS lft, sum(weight) OVER (PARTITION BY domain) - coalesce(sum(weight) OVER w, 0) AS wl FROM n2 JOIN b1 USING (domain)
  WINDOW w AS (PARTITION BY domain ORDER BY supply / weight, lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
o2 AS (SELECT domain, arg_min(lft, row(supply / weight, -lft)) AS olft, arg_min(wl, row(supply / weight, -lft)) AS owl FROM r2 WHERE supply * wl > lft * weight GROUP BY domain),
b2 AS (SELECT domain, lang, CASE WHEN supply * wl <= lft * weight THEN supply ELSE CAST(floor(CAST(olft * weight AS DOUBLE) / owl) AS BIGINT) END AS b FROM r2 LEFT JOIN o2 USING (domain)),
r3 AS (SELECT l.*, 1 AS weight, b, b - coalesce(sum(supply) OVER w, 0) AS lft, count(*) OVER (PARTITION BY domain, lang) - count(*) OVER w AS wl FROM l JOIN b2 USING (domain, lang)
  WINDOW w AS (PARTITION BY domain, lang ORDER BY supply, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
o3 AS (SELECT domain, lang, arg_min(lft, row(supply, -lft)) AS olft, arg_min(wl, row(supply, -lft)) AS owl FROM r3 WHERE supply * wl > lft GROUP BY ALL),
b3 AS (SELECT domain, lang, source, supply // 2 AS supply, CASE WHEN supply * wl <= lft THEN supply ELSE CAST(floor(CAST(olft AS DOUBLE) / owl) AS BIGINT) END AS budget FROM r3 LEFT JOIN o3 USING (domain, lang)),
e AS (SELECT d.*, CASE WHEN supply > 0 THEN budget // supply ELSE 1 END AS full_epochs, budget, supply FROM d JOIN b3 USING (domain, lang, source)),
p AS (SELECT *, md5('{SEED}:' || full_epochs || ':' || doc_id) AS place, budget - full_epochs * supply AS rest FROM e),
q AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY place, doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM p)
SELECT doc_id, domain, lang, source, n_tokens, CAST(unnest(range(full_epochs)) AS INTEGER) AS epoch FROM e
UNION ALL
SELECT doc_id, domain, lang, source, n_tokens, CAST(full_epochs AS INTEGER) AS epoch FROM q WHERE upto <= rest AND full_epochs < 2
"""
