"""Mixing sources to target weights by hierarchical budgets, in DataFrame functions only.

Leaves (domain, language, source) report their tokens.  A token budget runs down the tree: at each
parent the children share it by integer weight, a child that lacks tokens (``max_epochs`` times its
own) is filled up and its shortage is dealt among its siblings by weight; only what a whole family
lacks has already gone to the family's own siblings one level up.  All sums are whole numbers; what a division
leaves over goes to the first of the children that are not filled, one token each, so the budget is spent whole.

Each leaf then takes the first ``quota`` tokens of its seeded epochs: whole epochs first, and of one
more epoch the documents in the order of a seeded hash up to a cut.  The cut is found without sorting
a leaf in one task: leaves are sliced by hash prefix into about 1024 documents, sums of runs of slices, then of the
slices of one run (combined before the shuffle) name the slice that holds the cut, and only that slice is ordered.

Defined cases: a token is four UTF-8 bytes, rounded up; null and empty texts hold none and are never
taken; null keys form their own leaves; unlisted names weigh 1; repeated rows that share doc_id and
length with the cut share its outcome; an empty table, or a budget of 0, gives an empty result; extra
columns pass through (working columns start with ``__m``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weirflow.durable import columns, materialize, small_join

LEVELS = ("domain", "lang", "source")
DOMAINS = ("web", "reference", "forum", "news")
WEIGHTS = {"domain": {"web": 50, "reference": 20, "forum": 10, "news": 20}, "lang": {"en": 60, "de": 15, "fr": 15, "es": 10}, "source": {}}
SLICE = 1024


def domain_of(source: str = "source") -> Column:
    """The domain of a source: by the number its name ends with, else the first."""
    number = F.regexp_extract(F.coalesce(F.col(source), F.lit("")), r"(\d{1,9})$", 1)
    pick = F.pmod(F.when(number == "", 0).otherwise(F.nullif(number, F.lit("")).cast("long")), F.lit(len(DOMAINS)))
    return F.get(F.array(*[F.lit(d) for d in DOMAINS]), pick.cast("int"))


def tokens_of(text: str = "text") -> Column:
    return F.floor((F.octet_length(F.coalesce(F.col(text), F.lit(""))) + 3) / 4).cast("long")


def weight_of(level: str, name: Column, weights: dict) -> Column:
    listed = weights.get(level, {})
    if not listed:
        return F.lit(1)
    return F.coalesce(F.create_map(*[F.lit(x) for kv in listed.items() for x in kv])[name], F.lit(1))


def pour(nodes: DataFrame, parents: list[str], node: str, weight: Column, budget: Column) -> DataFrame:
    """Share ``budget`` among siblings with a ``cap`` each; adds ``got``."""
    family = W.partitionBy(*(parents or [F.lit(0)]))
    line = family.orderBy(F.col("cap") / F.col("w"), F.col(node))
    big = lambda c: F.col(c).cast("decimal(24,0)")
    df = nodes.withColumn("w", weight.cast("long")).withColumn("b", budget.cast("long"))
    df = df.withColumn("before", F.coalesce(F.sum("cap").over(line.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    df = df.withColumn("rest", F.sum("w").over(line.rowsBetween(0, W.unboundedFollowing)))
    df = df.withColumn("full", big("cap") * F.col("rest").cast("decimal(12,0)") <= F.col("w").cast("decimal(12,0)") * (F.col("b") - F.col("before")).cast("decimal(24,0)"))
    df = df.withColumn("filled", F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(family))
    df = df.withColumn("open", F.sum(F.when(F.col("full"), 0).otherwise(F.col("w"))).over(family))
    share = F.expr("cast(w as decimal(12,0)) * cast(b - filled as decimal(24,0)) div greatest(open, 1)")
    df = df.withColumn("share", F.when(F.col("full"), F.col("cap")).otherwise(share).cast("long"))
    df = df.withColumn("over", F.col("b") - F.sum("share").over(family)).withColumn("turn", F.sum((~F.col("full")).cast("int")).over(line.rowsBetween(W.unboundedPreceding, 0)))
    got = F.col("share") + F.when(~F.col("full") & (F.col("turn") <= F.col("over")), 1).otherwise(0)
    return df.withColumn("got", got.cast("long")).drop("w", "b", "before", "rest", "full", "filled", "open", "share", "over", "turn")


def budgets(leaves: DataFrame, weights: dict, share: tuple[int, int], max_epochs: int) -> DataFrame:
    """Quota of each leaf from (g0.., total, docs); the budget is share[0] / share[1] of all tokens."""
    keys = [c for c in leaves.columns if c.startswith("g")]
    df = leaves.withColumn("cap", F.col("total") * max_epochs)
    df = df.withColumn("budget", F.expr(f"sum(total) over (partition by 0) * {share[0]} div {share[1]}"))
    above = "budget"
    for k, key in enumerate(keys):
        own = keys[: k + 1]
        nodes = df.groupBy(*own).agg(F.sum("cap").alias("cap"), F.max(above).alias("from_above"))
        got = pour(nodes, own[:-1], key, weight_of(LEVELS[k], F.col(key), weights), F.col("from_above")).select(*[F.col(x).alias(f"r{x}") for x in own], F.col("got").alias(f"got{k}"))
        cond = F.lit(True)
        for x in own:
            cond = cond & F.col(x).eqNullSafe(F.col(f"r{x}"))
        df = df.join(got, cond).drop(*[f"r{x}" for x in own])
        above = f"got{k}"
    quota = F.col(above)
    return df.select(
        *keys, "total", "docs", quota.alias("quota"),
        F.when(F.col("total") > 0, F.expr(f"{above} div greatest(total, 1)")).otherwise(0).cast("int").alias("whole"),
        F.when(F.col("total") > 0, quota % F.greatest(F.col("total"), F.lit(1))).otherwise(0).cast("long").alias("rest"),
        F.greatest(F.lit(0), F.least(F.lit(30), F.ceil(F.log2(F.greatest(F.col("docs"), F.lit(1)) / SLICE)))).cast("int").alias("bits"),
    )


def ordered(df: DataFrame, seed: int) -> DataFrame:
    """Add the place of a document in its leaf's partial epoch: ``k`` (32 bits of a seeded hash) and its slice."""
    text = F.concat_ws("|", F.lit(str(seed)), F.col("whole"), F.coalesce(F.col("id").cast("string"), F.lit("")), F.col("n"))
    df = df.withColumn("k", F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long"))
    return df.withColumn("slice", F.expr("shiftright(k, 32 - bits)"))


def plan(slim: DataFrame, weights: dict, share: tuple[int, int], max_epochs: int, seed: int) -> DataFrame:
    """One row per leaf: whole epochs, and the last document (k, id, n) of the partial epoch with its take.

    ``slim`` has g0.., id, n and is read three times, so hand in a written table.
    """
    keys = [c for c in slim.columns if c.startswith("g")]
    leaves = slim.groupBy(*keys).agg(F.sum("n").alias("total"), F.count("*").alias("docs"))
    quota = materialize(budgets(leaves, weights, share, max_epochs), "quotas")
    placed = ordered(small_join(slim.filter("n > 0"), quota, keys, "inner"), seed).filter("rest > 0")

    def crossed(rows: DataFrame, part: str, left: str) -> DataFrame:
        """The part of each leaf in which the sum reaches ``left``, and what is left at its start."""
        sums = rows.groupBy(*keys, part).agg(F.sum("n").alias("t"), F.max(left).alias("all"))
        before = F.sum("t").over(W.partitionBy(*keys).orderBy(part)) - F.col("t")
        found = sums.withColumn("before", before).filter("before < all and all <= before + t")
        return materialize(found.select(*keys, F.col(part).alias("cut"), (F.col("all") - F.col("before")).alias("left")), "cut_slices")

    placed = placed.withColumn("run", F.expr("shiftright(slice, (bits + 1) div 2)"))
    inside = small_join(placed, crossed(placed, "run", "rest"), keys, "inner").filter("run = cut").drop("cut")
    cut = crossed(inside, "slice", "left")
    line = W.partitionBy(*keys).orderBy("k", "id", "n").rowsBetween(W.unboundedPreceding, 0)
    edge = small_join(placed, cut, keys, "inner").filter("slice = cut").withColumn("past", F.sum("n").over(line) - F.col("n")).filter("past < left")
    last = edge.groupBy(*keys).agg(F.max(F.struct("k", "id", "n", (F.col("left") - F.col("past")).alias("take"))).alias("last"))
    last = last.select(*[F.col(x).alias(f"r{x}") for x in keys], "last")
    cond = F.lit(True)
    for x in keys:
        cond = cond & F.col(x).eqNullSafe(F.col(f"r{x}"))
    return materialize(quota.join(last, cond, "left").drop(*[f"r{x}" for x in keys]), "mix_plan")


def take(rows: DataFrame, leaf_plan: DataFrame, seed: int) -> DataFrame:
    """Rows with g0.., id, n times the epochs that take them; adds ``epoch`` and ``take``."""
    keys = [c for c in leaf_plan.columns if c.startswith("g")]
    df = ordered(small_join(rows.filter("n > 0"), leaf_plan, keys, "inner"), seed)
    here, end = F.struct("k", "id", "n"), F.struct("last.k", "last.id", "last.n")
    inside = F.when(F.col("last").isNotNull() & (here <= end), F.least(F.col("n"), F.when(here == end, F.col("last.take")).otherwise(F.col("n"))))
    whole = F.when(F.col("whole") > 0, F.transform(F.sequence(F.lit(0), F.col("whole") - 1), lambda e: F.struct(e.alias("epoch"), F.col("n").alias("take")))).otherwise(F.array().cast("array<struct<epoch:int,take:bigint>>"))
    part = F.when(inside.isNotNull(), F.array(F.struct(F.col("whole").alias("epoch"), inside.alias("take")))).otherwise(F.array().cast("array<struct<epoch:int,take:bigint>>"))
    df = df.withColumn("x", F.explode(F.concat(whole, part))).withColumns({"epoch": F.col("x.epoch"), "take": F.col("x.take")})
    return df.drop("x", "k", "slice", "last", "total", "docs", "quota", "whole", "rest", "bits")


def keyed(docs: DataFrame) -> list[Column]:
    return [domain_of().alias("g0"), F.col("lang").alias("g1"), F.col("source").alias("g2"), F.col("doc_id").alias("id"), tokens_of().alias("n")]


def mix_documents(docs: DataFrame, share: tuple[int, int] = (85, 100), weights: dict = WEIGHTS, seed: int = 17) -> DataFrame:
    """The documents of one mixed epoch, with their own columns; a cut document is kept whole."""
    slim = materialize(docs.select(*keyed(docs)), "mix_slim")
    rows = docs.select(F.struct(*columns(docs)).alias("__m"), *keyed(docs))
    return take(rows, plan(slim, weights, share, 1, seed), seed).select("__m.*")


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    slim = materialize(docs.select(*keyed(docs)), "mix_slim")
    out = take(slim, plan(slim, WEIGHTS, (1, 2), 3, 17), 17)
    return out.select(F.col("id").alias("doc_id"), F.col("g0").alias("domain"), F.col("g1").alias("lang"), F.col("g2").alias("source"), "epoch", F.col("n").alias("n_tokens"), F.col("take").alias("take_tokens"))


def _pour_sql(name: str, level: int, source: str, budget: str, weight: str) -> str:
    keys = [f"g{i}" for i in range(level + 1)]
    by = f"PARTITION BY {', '.join(keys[:-1])}" if level else ""
    return f"""
{name}a AS (SELECT {", ".join(keys)}, sum(cap)::HUGEINT AS cap, max({budget})::HUGEINT AS b, {weight} AS w FROM {source} GROUP BY ALL),
{name}b AS (SELECT *, coalesce(sum(cap) OVER ({by} ORDER BY cap::BIGINT::DOUBLE / w, g{level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c0,
  sum(w) OVER ({by} ORDER BY cap::BIGINT::DOUBLE / w, g{level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS wr FROM {name}a),
{name}c AS (SELECT *, cap * wr <= w * (b - c0) AS f FROM {name}b),
{name}d AS (SELECT *, sum(CASE WHEN f THEN cap ELSE 0 END) OVER ({by}) AS cs, sum(CASE WHEN f THEN 0 ELSE w END) OVER ({by}) AS wo FROM {name}c),
{name}e AS (SELECT *, CASE WHEN f THEN cap ELSE w * (b - cs) // greatest(wo, 1) END AS s FROM {name}d),
{name}f AS (SELECT *, b - sum(s) OVER ({by}) AS over, sum(CASE WHEN f THEN 0 ELSE 1 END) OVER ({by} ORDER BY cap::BIGINT::DOUBLE / w, g{level} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS turn FROM {name}e),
{name} AS (SELECT {", ".join(keys)}, (s + CASE WHEN NOT f AND turn <= over THEN 1 ELSE 0 END)::BIGINT AS got FROM {name}f),
{source}{level} AS (SELECT s.*, p.got AS got{level} FROM {source} s JOIN {name} p ON {" AND ".join(f"s.{k} IS NOT DISTINCT FROM p.{k}" for k in keys)}),"""


_W = {k: "CASE " + f"g{i} " + " ".join(f"WHEN '{n}' THEN {w}" for n, w in WEIGHTS[k].items()) + " ELSE 1 END" for i, k in enumerate(LEVELS) if WEIGHTS[k]}
OP2_SQL = (
    """
WITH s AS (SELECT CASE coalesce(try_cast(nullif(regexp_extract(coalesce(source, ''), '(\\d{1,9})$', 1), '') AS BIGINT), 0) % 4
    WHEN 0 THEN 'web' WHEN 1 THEN 'reference' WHEN 2 THEN 'forum' ELSE 'news' END AS g0, lang AS g1, source AS g2, doc_id AS id,
    (strlen(coalesce(text, '')) + 3) // 4 AS n FROM documents),
t AS (SELECT g0, g1, g2, sum(n)::BIGINT AS total, 3 * sum(n)::BIGINT AS cap, (SELECT sum(n)::HUGEINT * 1 // 2 FROM s) AS budget FROM s GROUP BY ALL),"""
    + _pour_sql("p", 0, "t", "budget", _W["domain"])
    + _pour_sql("q", 1, "t0", "got0", _W["lang"])
    + _pour_sql("r", 2, "t01", "got1", "1")
    + """
l AS (SELECT g0, g1, g2, got2 // greatest(total, 1) AS whole, got2 % greatest(total, 1) AS rest FROM t012),
d AS (SELECT s.*, whole, rest, ('0x' || substr(md5('17|' || whole || '|' || coalesce(id::VARCHAR, '') || '|' || n), 1, 8))::BIGINT AS k
      FROM s JOIN l ON s.g0 IS NOT DISTINCT FROM l.g0 AND s.g1 IS NOT DISTINCT FROM l.g1 AND s.g2 IS NOT DISTINCT FROM l.g2 WHERE n > 0),
c AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY g0, g1, g2 ORDER BY k, id, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS past FROM d),
o AS (SELECT *, least(n, rest - past) AS part FROM c)
SELECT id AS doc_id, g0 AS domain, g1 AS lang, g2 AS source, e::INTEGER AS epoch, n::BIGINT AS n_tokens, n::BIGINT AS take_tokens FROM (SELECT *, unnest(range(0, whole)) AS e FROM o)
UNION ALL SELECT id, g0, g1, g2, whole::INTEGER, n::BIGINT, part::BIGINT FROM o WHERE part > 0"""
)

QUERIES = {"op2_mixing": op2_mixing}
SQL = {"op2_mixing": OP2_SQL}
