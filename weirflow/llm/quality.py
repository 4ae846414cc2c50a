"""Quality rules with adaptive thresholds, in DataFrame functions only.

Each text is measured inside its own row (no shuffle).  The measured ratios of the texts that pass the base rule
go into log-linear histograms per (language, source): the value range is cut so that a bin is at most 1/32 wide
relative to its value, a bin holds an exact count, and two sketches merge by adding counts.  So partial sketches
combine before the shuffle and a hot source costs no more than any other.  A group's limit for a rule is
``high + (high - low)``, two quantiles read off its sketch: nothing but the group's own values decides, and a
value must lie beyond the high quantile by as much as the group's upper part is wide.  A text goes if its bin is above
a limit.  The first occurrence of a sign is not counted, so that one never decides.  Groups with fewer than
``min_rows`` texts take the merged sketch of their language, then that of all texts.  A join brings the
limits back.

Defined cases: a null or blank text has no words and fails the base rule; null languages and sources
form groups of their own; repeated rows count as often as they occur; an empty table gives an empty
result; other columns pass through untouched (working columns start with ``__q``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.durable import columns, materialize, small_join

#: Word separators: space and the control characters 9 to 13.
BLANK = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[^#*$%&|<>]+"
WINDOW = 8

#: Ratio (numerator, denominator), and the quantiles (high, low) in parts per 10,000 that make its limit.
RULES = {
    "symbols": ("__q_n_symbols", "__q_word_chars", 9000, 1000),
    "dup_lines": ("__q_n_dup_lines", "__q_n_lines", 9900, 9000),
    "repeats": ("__q_n_repeat_words", "__q_n_words", 9900, 9000),
    "runs": ("__q_n_run_words", "__q_n_words", 9900, 9000),
    "capitals": ("__q_n_capitals", "__q_word_chars", 9900, 9000),
}
METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the ``__q_*`` measurements of every whole text; one narrow pass."""
    body = F.coalesce(F.col(text), F.lit(""))
    df = docs.withColumn("__q_w", F.filter(F.split(body, BLANK), lambda w: w != ""))
    df = df.withColumn("__q_l", F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    word = lambda i: F.col("__q_w")[i]
    windows = F.transform(F.sequence(F.lit(0), F.size("__q_w") - WINDOW), lambda i: F.xxhash64(*[word(i + k) for k in range(WINDOW)]))
    df = df.withColumn("__q_h", F.when(F.size("__q_w") >= WINDOW, windows).otherwise(F.array().cast("array<bigint>")))
    # Only texts with a repeated window pay for sorting; neighbours in the order of hashes are repeats.
    pairs = F.sort_array(F.transform("__q_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("__q_s", F.when(F.size(F.array_distinct("__q_h")) < F.size("__q_h"), pairs))
    at = lambda j: F.get(F.col("__q_s"), j)["h"]
    twice = F.filter(F.sequence(F.lit(0), F.size("__q_s") - 1), lambda j: at(j).eqNullSafe(at(j - 1)) | at(j).eqNullSafe(at(j + 1)))
    df = df.withColumn("__q_p", F.when(F.col("__q_s").isNotNull(), F.sort_array(F.transform(twice, lambda j: F.get(F.col("__q_s"), j)["i"]))))
    gaps = F.zip_with(F.col("__q_p"), F.slice(F.col("__q_p"), 2, F.size("__q_p")), lambda a, b: F.least(F.lit(WINDOW), b - a))
    count = lambda pattern: F.length(F.regexp_replace(body, pattern, "")).cast("long")
    return df.withColumns(
        {
            "__q_n_words": F.size("__q_w").cast("long"),
            "__q_word_chars": F.length(body).cast("long") - count(r"[^\x20\x09-\x0D]+"),
            "__q_n_symbols": count(SYMBOLS),
            "__q_n_capitals": count("[^A-Z]+"),
            "__q_n_lines": F.size("__q_l").cast("long"),
            "__q_n_run_words": F.size(F.filter(F.zip_with("__q_w", F.slice("__q_w", 2, F.size("__q_w")), lambda a, b: a == b), lambda x: x)).cast("long"),
            "__q_n_dup_lines": (F.size("__q_l") - F.size(F.array_distinct("__q_l"))).cast("long"),
            "__q_n_repeat_words": F.coalesce(F.aggregate(gaps, F.lit(0).cast("long"), lambda s, x: s + x), F.lit(0)).cast("long"),
        }
    ).drop("__q_w", "__q_l", "__q_h", "__q_s", "__q_p")


def ratio(rule: str) -> Column:
    """The measured ratio in whole parts per 10,000, by its bin's lower edge."""
    top, bottom, *_ = RULES[rule]
    return F.expr(bin_of(f"floor(greatest({top} - 1, 0) * 10000 / greatest({bottom}, 1))"))


def bin_of(v: str) -> str:
    """SQL for the lower edge of the bin of a whole number: exact below 64, then 6 leading bits."""
    return f"CASE WHEN {v} < 64 THEN {v} ELSE shiftleft(shiftright({v}, length(bin({v})) - 6), length(bin({v})) - 6) END"


def sketches(measured: DataFrame, groups: list[str]) -> DataFrame:
    """Mergeable quantile sketches of the texts that pass the base rule: (groups, rule, bin, n); all groups have rows."""
    values = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), ratio(r).alias("bin")) for r in RULES]))
    keys = [F.col(g).alias(f"g{i}") for i, g in enumerate(groups)]
    rows = measured.select(*keys, values.alias("x"), (~base_failed()).cast("long").alias("one")).select("*", "x.rule", "x.bin").drop("x")
    return rows.groupBy(*[f"g{i}" for i in range(len(groups))], "rule", "bin").agg(F.sum("one").alias("n"))


def fences(sketch: DataFrame, n_groups: int, min_rows: int) -> DataFrame:
    """One row per group with an upper limit for each rule; sparse groups take those of their parents."""
    part = lambda k: F.create_map(*[F.lit(x) for r, spec in RULES.items() for x in (r, spec[k])])[F.col("rule")]
    keys = [f"g{i}" for i in range(n_groups)]
    found = None
    for level in range(n_groups, -1, -1):
        own = keys[:level]
        merged = sketch.groupBy(*own, "rule", "bin").agg(F.sum("n").alias("n"))
        per = merged.groupBy(*own, "rule").agg(F.sort_array(F.collect_list(F.struct("bin", "n"))).alias("bins"), F.sum("n").alias("total"), part(2).alias("hq"), part(3).alias("lq"))
        reached = lambda s, b, q: (s.seen + b.n > 0) & ((s.seen + b.n) * 10000 >= F.col("total") * F.col(q))
        running = F.aggregate(
            "bins",
            F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("low"), F.lit(None).cast("long").alias("high")),
            lambda s, b: F.struct(
                (s.seen + b.n).alias("seen"),
                F.when(s.low.isNull() & reached(s, b, "lq"), b.bin).otherwise(s.low).alias("low"),
                F.when(s.high.isNull() & reached(s, b, "hq"), b.bin).otherwise(s.high).alias("high"),
            ),
        )
        per = per.withColumn("q", running).select(*own, "rule", "total", (F.col("q.high") * 2 - F.col("q.low")).alias("fence"))
        wide = per.groupBy(*own).agg(F.max("total").alias(f"n{level}"), *[F.max(F.when(F.col("rule") == r, F.col("fence"))).alias(f"{r}{level}") for r in RULES])
        if found is None:
            found = wide
        else:
            right = wide.select(*[F.col(k).alias(f"r{k}") for k in own], *[c for c in wide.columns if c not in own])
            cond = F.lit(True)
            for k in own:
                cond = cond & F.col(k).eqNullSafe(F.col(f"r{k}"))
            found = found.join(F.broadcast(right) if not own else right, cond, "left").drop(*[f"r{k}" for k in own])
    pick = lambda r: F.coalesce(*[F.when(F.col(f"n{x}") >= min_rows, F.col(f"{r}{x}")) for x in range(n_groups, 0, -1)], F.col(f"{r}0"))
    return found.select(*keys, *[pick(r).alias(f"__q_fence_{r}") for r in RULES])


def base_failed() -> Column:
    return (F.col("__q_n_words") < 20) | (F.col("__q_n_repeat_words") * 100 > F.col("__q_n_words") * 30)


def limited(measured: DataFrame, groups: tuple[str, ...] = ("lang", "source"), min_rows: int = 100) -> DataFrame:
    """Add a ``__q_fence_`` limit for each rule.  ``measured`` is read twice, so hand in a written table."""
    limits = materialize(fences(sketches(measured, list(groups)), len(groups), min_rows), "fences")
    limits = limits.select(*[F.col(f"g{i}").alias(g) for i, g in enumerate(groups)], *[f"__q_fence_{r}" for r in RULES])
    return small_join(measured, limits, list(groups))


def judge(measured: DataFrame, **options) -> DataFrame:
    """Add ``__q_base_failed`` and ``__q_kept``."""
    over = F.lit(False)
    for r in RULES:
        over = over | (ratio(r) > F.col(f"__q_fence_{r}"))
    df = limited(measured, **options).withColumn("__q_base_failed", base_failed())
    return df.withColumn("__q_kept", ~F.col("__q_base_failed") & ~F.coalesce(over, F.lit(False))).drop(*[f"__q_fence_{r}" for r in RULES])


def rejections(measured: DataFrame, groups: tuple[str, ...] = ("lang", "source"), **options) -> DataFrame:
    """(groups, rule, limit, n_rows, n_over): what each rule rejects of the texts that pass the base rule."""
    df = limited(measured, groups, **options).filter(~base_failed())
    values = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"__q_fence_{r}").alias("limit"), (ratio(r) > F.col(f"__q_fence_{r}")).cast("long").alias("over")) for r in RULES]))
    rows = df.select(*groups, values.alias("x")).select(*groups, "x.*")
    return rows.groupBy(*groups, "rule", "limit").agg(F.count("*").alias("n_rows"), F.sum("over").alias("n_over"))


def filter_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents that pass, with their own columns."""
    # A filter before the write would be pushed below the measurements and repeat them.
    return judge(materialize(measure(docs), "measured"), **options).filter("__q_kept").select(*columns(docs))


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    slim = measure(docs).select("doc_id", "lang", "source", *[f"__q_{m}" for m in METRICS], "__q_n_capitals", "__q_n_run_words", "__q_n_lines")
    out = judge(materialize(slim, "measured"))
    return out.select("doc_id", *[F.col(f"__q_{m}").alias(m) for m in METRICS], F.col("__q_base_failed").alias("base_failed"), F.col("__q_kept").alias("kept"))


#: CTEs on ``docs(rid, doc_id, text, lang, source)`` up to ``judged``; shared with the pipeline's SQL.
JUDGE_SQL = r"""
w0 AS (SELECT rid, doc_id, text, lang, source, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM docs),
w1 AS (SELECT *, list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM w0),
win AS (SELECT rid, i, ws[i : i + 7] AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM w1 WHERE len(ws) >= 8)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 8)) AS p FROM rep) GROUP BY rid),
m AS (
  SELECT w1.rid, doc_id, text, lang, source, len(ws)::BIGINT AS n_words,
         coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(body, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         length(regexp_replace(body, '[^A-Z]', '', 'g'))::BIGINT AS n_capitals,
         len(list_filter(list_zip(ws[1 : len(ws) - 1], ws[2 :]), lambda p: p[1] = p[2]))::BIGINT AS n_run_words,
         len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
  FROM w1 LEFT JOIN cov USING (rid)),
v0 AS (
  SELECT *, greatest(n_symbols - 1, 0) * 10000 // greatest(word_chars, 1) AS x1, greatest(n_dup_lines - 1, 0) * 10000 // greatest(n_lines, 1) AS x2,
         greatest(n_repeat_words - 1, 0) * 10000 // greatest(n_words, 1) AS x3, greatest(n_run_words - 1, 0) * 10000 // greatest(n_words, 1) AS x4,
         greatest(n_capitals - 1, 0) * 10000 // greatest(word_chars, 1) AS x5, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
v AS (
  SELECT *, CASE WHEN x1 < 64 THEN x1 ELSE (x1 >> (length(bin(x1)) - 6)) << (length(bin(x1)) - 6) END AS v1,
         CASE WHEN x2 < 64 THEN x2 ELSE (x2 >> (length(bin(x2)) - 6)) << (length(bin(x2)) - 6) END AS v2,
         CASE WHEN x3 < 64 THEN x3 ELSE (x3 >> (length(bin(x3)) - 6)) << (length(bin(x3)) - 6) END AS v3,
         CASE WHEN x4 < 64 THEN x4 ELSE (x4 >> (length(bin(x4)) - 6)) << (length(bin(x4)) - 6) END AS v4,
         CASE WHEN x5 < 64 THEN x5 ELSE (x5 >> (length(bin(x5)) - 6)) << (length(bin(x5)) - 6) END AS v5 FROM v0),
long AS (
  SELECT lang, source, r, b FROM (SELECT lang, source, 1 AS r, v1 AS b FROM v WHERE NOT base_failed UNION ALL SELECT lang, source, 2, v2 FROM v WHERE NOT base_failed
        UNION ALL SELECT lang, source, 3, v3 FROM v WHERE NOT base_failed UNION ALL SELECT lang, source, 4, v4 FROM v WHERE NOT base_failed
        UNION ALL SELECT lang, source, 5, v5 FROM v WHERE NOT base_failed)),
q AS (
  SELECT 2 AS lvl, lang, source, r, b, row_number() OVER (PARTITION BY lang, source, r ORDER BY b) AS k, count(*) OVER (PARTITION BY lang, source, r) AS n FROM long
  UNION ALL SELECT 1, lang, NULL, r, b, row_number() OVER (PARTITION BY lang, r ORDER BY b), count(*) OVER (PARTITION BY lang, r) FROM long
  UNION ALL SELECT 0, NULL, NULL, r, b, row_number() OVER (PARTITION BY r ORDER BY b), count(*) OVER (PARTITION BY r) FROM long),
f AS (
  SELECT lvl, lang, source, r, max(n) AS n, min(b) FILTER (WHERE 10000 * k >= CASE r WHEN 1 THEN 1000 ELSE 9000 END * n) AS low,
         min(b) FILTER (WHERE 10000 * k >= CASE r WHEN 1 THEN 9000 ELSE 9900 END * n) AS high
  FROM q GROUP BY lvl, lang, source, r),
fence AS (SELECT lvl, lang, source, r, n, 2 * high - low AS y FROM f),
lim AS (
  SELECT a.lang, a.source, a.r, CASE WHEN a.n >= 100 THEN a.y WHEN b.n >= 100 THEN b.y ELSE c.y END AS y
  FROM (SELECT * FROM fence WHERE lvl = 2) a
  JOIN (SELECT * FROM fence WHERE lvl = 1) b ON a.lang IS NOT DISTINCT FROM b.lang AND a.r = b.r
  JOIN (SELECT * FROM fence WHERE lvl = 0) c ON a.r = c.r),
wide AS (
  SELECT lang, source, max(y) FILTER (WHERE r = 1) AS y1, max(y) FILTER (WHERE r = 2) AS y2, max(y) FILTER (WHERE r = 3) AS y3,
         max(y) FILTER (WHERE r = 4) AS y4, max(y) FILTER (WHERE r = 5) AS y5 FROM lim GROUP BY lang, source),
judged AS (
  SELECT v.*, NOT base_failed AND v1 <= y1 AND v2 <= y2 AND v3 <= y3 AND v4 <= y4 AND v5 <= y5 AS kept
  FROM v LEFT JOIN wide w ON w.lang IS NOT DISTINCT FROM v.lang AND w.source IS NOT DISTINCT FROM v.source)
"""

QUERIES = {"op4_quality_rules": op4_quality_rules}
SQL = {
    "op4_quality_rules": "WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, text, lang, source FROM documents),"
    + JUDGE_SQL
    + "SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM judged"
}
