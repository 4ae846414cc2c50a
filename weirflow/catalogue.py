"""Registered queries of the exchange operators and their SQL.

Each query covers its whole table.  Identifiers of maps, reduce partitions and addresses are derived from
table keys; lengths of blocks are declared sizes, as bytes inside Spark's files cannot be seen from a
DataFrame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weirflow.durable import materialize
from weirflow.functions import naming, sizing
from weirflow.operators import keyed, partitioning, relational
from weirflow.operators.relational import cents
from weirflow.plans import fetchplan, mapoutput, policy
from weirflow.sources import segments, table
from weirflow.streaming import events as windows

QUERIES: dict = {}
SQL: dict[str, str] = {}

MAPS, REDUCES, ADDRESSES = 64, 512, 64
SPAN = 64


def query(sql: str | None = None):
    """Register a function under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Keyed rows


@query("SELECT (l_suppkey % 16)::INTEGER AS partition_id, count(*) AS n_rows FROM lineitem GROUP BY ALL")
def hash_partition_counts(spark, sf):
    return partitioning.partition_counts(partitioning.hash_partition(table(spark, sf, "lineitem"), "l_suppkey", 16))


@query("SELECT l_orderkey, sum(round(l_quantity * 100)::BIGINT)::BIGINT AS qty_hundredths, max(l_extendedprice) AS max_price, count(*) AS n FROM lineitem GROUP BY l_orderkey")
def reduce_by_key(spark, sf):
    return keyed.reduce_by_key(table(spark, sf, "lineitem"), ["l_orderkey"], qty_hundredths=F.sum(cents("l_quantity")), max_price=F.max("l_extendedprice"), n=F.count("*"))


@query("SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY ALL")
def count_by_key(spark, sf):
    return keyed.count_by_key(table(spark, sf, "orders"), ["o_orderpriority"])


@query("SELECT o_custkey, count(*) AS n, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS orders FROM orders GROUP BY o_custkey")
def group_by_key(spark, sf):
    held = keyed.group_by_key(table(spark, sf, "orders"), "o_custkey", "o_orderkey")
    return held.select("o_custkey", F.size("values").cast("long").alias("n"), F.array_join(F.col("values").cast("array<string>"), ",").alias("orders"))


@query("""SELECT l_suppkey, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS total_cents, count(*) AS n,
  max(round(l_extendedprice * 100)::BIGINT) AS top_cents FROM lineitem GROUP BY l_suppkey""")
def combine_by_key(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_suppkey", cents("l_extendedprice").alias("v"))
    one = lambda v: F.struct(v.alias("total"), F.lit(1).cast("long").alias("n"), v.alias("top"))
    join = lambda a, b: F.struct((a["total"] + b["total"]).alias("total"), (a["n"] + b["n"]).alias("n"), F.greatest(a["top"], b["top"]).alias("top"))
    held = keyed.combine_by_key(rows, "l_suppkey", "v", one, lambda c, v: join(c, one(v)), join)
    return held.select("l_suppkey", F.col("combined.total").alias("total_cents"), F.col("combined.n").alias("n"), F.col("combined.top").alias("top_cents"))


@query("SELECT l_partkey, sum(round(l_quantity * 100)::BIGINT)::BIGINT AS qty_hundredths, count(*) AS n, min(l_shipdate) AS first_ship FROM lineitem GROUP BY l_partkey")
def merge_combiners(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("map_id", F.pmod("l_orderkey", F.lit(MAPS)))
    part = keyed.reduce_by_key(rows, ["map_id", "l_partkey"], q=F.sum(cents("l_quantity")), c=F.count("*"), d=F.min("l_shipdate"))
    return keyed.merge_partials(part, ["l_partkey"], qty_hundredths=F.sum("q"), n=F.sum("c"), first_ship=F.min("d"))


@query("""WITH a AS (SELECT c_custkey AS k, string_agg(c_nationkey::VARCHAR, ',' ORDER BY c_nationkey) AS l FROM customer GROUP BY 1),
b AS (SELECT o_custkey AS k, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS r, count(*) AS n FROM orders GROUP BY 1)
SELECT coalesce(a.k, b.k) AS custkey, coalesce(l, '') AS nations, coalesce(r, '') AS orders, coalesce(n, 0)::BIGINT AS n_orders FROM a FULL JOIN b ON a.k = b.k""")
def cogroup(spark, sf):
    left = table(spark, sf, "customer").select(F.col("c_custkey").alias("custkey"), "c_nationkey")
    right = table(spark, sf, "orders").select(F.col("o_custkey").alias("custkey"), "o_orderkey")
    both = keyed.cogroup(left, right, "custkey", "c_nationkey", "o_orderkey")
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return both.select("custkey", text("left_values").alias("nations"), text("right_values").alias("orders"), F.size("right_values").cast("long").alias("n_orders"))


@query("SELECT o_orderkey, round(o_totalprice * 100)::BIGINT AS price_cents, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS position FROM orders")
def sort_by_key(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return partitioning.sort_positions(rows, F.desc("o_totalprice"), "o_orderkey").select("o_orderkey", cents("o_totalprice").alias("price_cents"), "position")


@query("""WITH k AS (SELECT c_name || s AS key, c_custkey FROM customer, (VALUES ('Aa'), ('BB')) t(s))
SELECT key, count(*) AS n, sum(c_custkey)::BIGINT AS total FROM k GROUP BY key""")
def hash_collision_group(spark, sf):
    """Keys that end in Aa and BB have equal Java hash codes pair by pair; groups go by value."""
    rows = table(spark, sf, "customer").select(F.explode(F.array(F.concat("c_name", F.lit("Aa")), F.concat("c_name", F.lit("BB")))).alias("key"), "c_custkey")
    return keyed.reduce_by_key(rows, ["key"], n=F.count("*"), total=F.sum("c_custkey"))


@query("""SELECT (o_custkey % 8)::INTEGER AS partition_id, o_orderkey, row_number() OVER (PARTITION BY o_custkey % 8 ORDER BY o_orderdate, o_orderkey) AS position FROM orders""")
def sort_within_partition(spark, sf):
    rows = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return partitioning.sort_within(rows, "o_custkey", 8, "o_orderdate", "o_orderkey").select("partition_id", "o_orderkey", "position")


@query("SELECT (o_custkey % 4)::INTEGER AS run, o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS position FROM orders")
def kway_merge(spark, sf):
    """Four runs merged to one order: ranges of all runs meet in a partition, whose sort merges them."""
    rows = table(spark, sf, "orders").select(partitioning.partition_of("o_custkey", 4).alias("run"), "o_orderkey", "o_orderdate")
    return partitioning.sort_positions(rows, "o_orderdate", "o_orderkey").select("run", "o_orderkey", "position")


# Metadata of map outputs


def _blocks(spark, sf) -> DataFrame:
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity")
    return mapoutput.lengths(rows, F.pmod("l_orderkey", F.lit(MAPS)), F.pmod(F.col("l_partkey") * 7 + F.col("l_suppkey"), F.lit(REDUCES)), cents("l_quantity"), MAPS, REDUCES)


BLOCKS = f"""held AS (SELECT l_orderkey % {MAPS} AS map_id, (l_partkey * 7 + l_suppkey) % {REDUCES} AS reduce_id, sum(round(l_quantity * 100)::BIGINT)::BIGINT AS length FROM lineitem GROUP BY ALL),
blocks AS (SELECT m.i AS map_id, r.i::INTEGER AS reduce_id, coalesce(length, 0)::BIGINT AS length FROM range({MAPS}) m(i) CROSS JOIN range({REDUCES}) r(i) LEFT JOIN held ON map_id = m.i AND reduce_id = r.i),
indexed AS (SELECT *, coalesce(sum(length) OVER (PARTITION BY map_id ORDER BY reduce_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM blocks)"""


@query(f"WITH {BLOCKS} SELECT map_id, reduce_id, length, \"offset\" FROM indexed")
def map_output_index(spark, sf):
    return mapoutput.index(_blocks(spark, sf))


@query(f"WITH {BLOCKS} SELECT map_id, reduce_id, length FROM blocks")
def index_to_lengths(spark, sf):
    indexed = mapoutput.index(_blocks(spark, sf))
    ends = indexed.groupBy("map_id").agg((F.max("reduce_id") + 1).alias("reduce_id"), F.sum("length").alias("offset"))
    return mapoutput.from_offsets(indexed.select("map_id", "reduce_id", "offset").unionByName(ends))


@query(f"""WITH {BLOCKS} SELECT map_id, (reduce_id // {SPAN} * {SPAN})::INTEGER AS start_reduce, (reduce_id // {SPAN} * {SPAN} + {SPAN})::INTEGER AS end_reduce,
min("offset") AS "offset", sum(length)::BIGINT AS length FROM indexed GROUP BY ALL""")
def block_range_lookup(spark, sf):
    ranges = spark.range(0, REDUCES, SPAN).select(F.col("id").cast("int").alias("start_reduce"), (F.col("id") + SPAN).cast("int").alias("end_reduce"))
    return mapoutput.block_ranges(materialize(mapoutput.index(_blocks(spark, sf)), "index"), F.broadcast(ranges))


@query(f"""WITH {BLOCKS}, l AS (SELECT (reduce_id // {SPAN})::INTEGER AS reader, * FROM blocks WHERE length > 0),
f AS (SELECT *, CASE WHEN lag(map_id) OVER w IS DISTINCT FROM map_id THEN 1 ELSE 0 END AS s FROM l WINDOW w AS (PARTITION BY reader ORDER BY map_id, reduce_id)),
g AS (SELECT *, sum(s) OVER (PARTITION BY reader ORDER BY map_id, reduce_id) AS run FROM f)
SELECT reader, map_id, min(reduce_id)::INTEGER AS start_reduce, (max(reduce_id) + 1)::INTEGER AS end_reduce, sum(length)::BIGINT AS bytes FROM g GROUP BY reader, run, map_id""")
def merge_block_runs(spark, sf):
    return fetchplan.merge_runs(_blocks(spark, sf).withColumn("reader", F.floor(F.col("reduce_id") / SPAN).cast("int")))


def _addressed(spark, sf):
    return _blocks(spark, sf).withColumn("address", F.concat(F.lit("host-"), F.pmod(F.col("map_id") * 5 + F.col("reduce_id"), F.lit(ADDRESSES))))


IN_FLIGHT, MAX_BLOCKS = 500_000, 24
PACK = f"""{BLOCKS}, numbered AS (SELECT 'host-' || ((map_id * 5 + reduce_id) % {ADDRESSES}) AS address, map_id, reduce_id, length,
  row_number() OVER (PARTITION BY (map_id * 5 + reduce_id) % {ADDRESSES} ORDER BY map_id, reduce_id) AS i FROM blocks WHERE length > 0),
fold(address, i, req, bytes, n, shut) AS (
  SELECT address, i, 0, length, 1, length >= {IN_FLIGHT // 5} OR 1 >= {MAX_BLOCKS} FROM numbered WHERE i = 1
  UNION ALL SELECT x.address, x.i, CASE WHEN f.shut THEN f.req + 1 ELSE f.req END, CASE WHEN f.shut THEN 0 ELSE f.bytes END + x.length, CASE WHEN f.shut THEN 0 ELSE f.n END + 1,
    CASE WHEN f.shut THEN 0 ELSE f.bytes END + x.length >= {IN_FLIGHT // 5} OR CASE WHEN f.shut THEN 0 ELSE f.n END + 1 >= {MAX_BLOCKS}
  FROM fold f JOIN numbered x ON x.address = f.address AND x.i = f.i + 1),
packed AS (SELECT address, req AS req_id, max(n)::INTEGER AS n_blocks, max(bytes)::BIGINT AS bytes FROM fold GROUP BY ALL)"""


@query(f"WITH RECURSIVE {PACK} SELECT address, req_id, n_blocks, bytes FROM packed")
def pack_fetch_requests(spark, sf):
    return fetchplan.pack_requests(_addressed(spark, sf), IN_FLIGHT, MAX_BLOCKS)


@query(f"""WITH {BLOCKS}, l AS (SELECT 'host-' || ((map_id * 5 + reduce_id) % {ADDRESSES}) AS address, map_id, reduce_id, length FROM blocks WHERE length > 0),
g AS (SELECT *, (row_number() OVER (PARTITION BY address ORDER BY map_id, reduce_id) - 1) // 10 AS group_id FROM l)
SELECT address, group_id::INTEGER AS group_id, count(*) AS n_blocks, sum(length)::BIGINT AS bytes FROM g GROUP BY ALL""")
def split_oversized_groups(spark, sf):
    return fetchplan.split_groups(_addressed(spark, sf), 10).groupBy("address", "group_id").agg(F.count("*").alias("n_blocks"), F.sum("length").alias("bytes"))


WAVE_BYTES, WAVE_REQUESTS = 600_000, 5


@query(f"""WITH RECURSIVE {PACK}, rs AS (SELECT address, req_id, bytes, row_number() OVER (PARTITION BY address ORDER BY req_id) AS i FROM packed),
w(address, i, req_id, wave, b, n) AS (
  SELECT address, i, req_id, 0, bytes, 1 FROM rs WHERE i = 1
  UNION ALL SELECT r.address, r.i, r.req_id, CASE WHEN w.n + 1 <= {WAVE_REQUESTS} AND w.b + r.bytes <= {WAVE_BYTES} THEN w.wave ELSE w.wave + 1 END,
    CASE WHEN w.n + 1 <= {WAVE_REQUESTS} AND w.b + r.bytes <= {WAVE_BYTES} THEN w.b + r.bytes ELSE r.bytes END,
    CASE WHEN w.n + 1 <= {WAVE_REQUESTS} AND w.b + r.bytes <= {WAVE_BYTES} THEN w.n + 1 ELSE 1 END
  FROM w JOIN rs r ON r.address = w.address AND r.i = w.i + 1)
SELECT address, wave, count(*) AS n_requests, sum(bytes)::BIGINT AS bytes FROM w JOIN rs USING (address, i) GROUP BY ALL""")
def fetch_waves(spark, sf):
    waved = fetchplan.waves(fetchplan.pack_requests(_addressed(spark, sf), IN_FLIGHT, MAX_BLOCKS), WAVE_BYTES, WAVE_REQUESTS, "address")
    return waved.groupBy("address", "wave").agg(F.count("*").alias("n_requests"), F.sum("bytes").alias("bytes"))


@query(f"""WITH {BLOCKS}, e AS (SELECT *, CASE WHEN length <= 0 THEN 0 WHEN length <= 1 THEN 1 ELSE least(255, ceil(ln(length::DOUBLE) / ln(1.1::DOUBLE))) END::INTEGER AS code FROM blocks)
SELECT map_id, reduce_id, length, code, (CASE WHEN code = 0 THEN 0 ELSE floor(pow(1.1::DOUBLE, code)) END)::BIGINT AS decoded FROM e""")
def size_codec(spark, sf):
    rows = _blocks(spark, sf).withColumn("code", sizing.encode_size(F.col("length")))
    return rows.withColumn("decoded", sizing.decode_size(F.col("code")))


@query(f"""WITH {BLOCKS}, a AS (SELECT map_id, attempt, sum(length)::BIGINT + CASE WHEN (map_id * 7 + attempt) % 3 = 0 THEN 1 ELSE 0 END AS data_bytes, sum(length)::BIGINT AS total,
  ({REDUCES} + CASE WHEN (map_id + attempt) % 5 = 0 THEN 0 ELSE 1 END) * 8 AS index_bytes FROM blocks, range(3) t(attempt) GROUP BY map_id, attempt)
SELECT 7 AS shuffle_id, map_id, min(attempt)::INTEGER AS attempt, arg_min(data_bytes, attempt)::BIGINT AS data_bytes FROM a
WHERE total = data_bytes AND index_bytes = ({REDUCES} + 1) * 8 GROUP BY map_id""")
def commit_arbitration(spark, sf):
    """Three attempts per map; some indexes are short, some data files a byte too long."""
    maps = _blocks(spark, sf).groupBy("map_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("reduce_id", "length"))), lambda x: x["length"]).alias("lengths"), F.sum("length").alias("total"))
    tries = maps.withColumn("attempt", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).withColumns(
        {
            "shuffle_id": F.lit(7),
            "first_offset": F.lit(0),
            "data_bytes": F.col("total") + (F.pmod(F.col("map_id") * 7 + F.col("attempt"), F.lit(3)) == 0).cast("int"),
            "index_bytes": (REDUCES + 1 - (F.pmod(F.col("map_id") + F.col("attempt"), F.lit(5)) == 0).cast("int")) * 8,
        }
    )
    return mapoutput.arbitrate(tries, mapoutput.valid_attempt(REDUCES))


@query("""WITH c AS (SELECT l_suppkey % 4 AS map_id, count(*) AS n FROM lineitem GROUP BY 1)
SELECT map_id, b::INTEGER AS batch, least(10000, n - b * 10000)::BIGINT AS n_records, (b * 10000)::BIGINT AS first_record FROM (SELECT *, unnest(range(0, (n + 9999) // 10000)) AS b FROM c)""")
def spill_batches(spark, sf):
    counts = table(spark, sf, "lineitem").groupBy(F.pmod("l_suppkey", F.lit(4)).alias("map_id")).agg(F.count("*").alias("n"))
    return sizing.spill_batches(counts)


@query(f"""WITH {BLOCKS}, c AS (SELECT *, unnest(range(0, (length + 2499) // 2500)) AS i FROM blocks WHERE length > 0)
SELECT map_id, reduce_id, i::INTEGER AS chunk, (i * 2500)::BIGINT AS chunk_offset, least(2500, length - i * 2500)::BIGINT AS chunk_length, length - i * 2500 >= 2500 AS is_full FROM c""")
def buffer_chunks(spark, sf):
    return sizing.chunks(_blocks(spark, sf), 2500).select("map_id", "reduce_id", "chunk", "chunk_offset", "chunk_length", "is_full")


@query(f"""WITH {BLOCKS}, s AS (SELECT *, (sum(length) OVER (PARTITION BY reduce_id ORDER BY map_id))::BIGINT AS e FROM blocks WHERE length > 0),
r AS (SELECT *, e - length AS b, CASE WHEN e - length < 10000 THEN 0 ELSE (e - length - 10000) // 20000 + 1 END AS r0, CASE WHEN e - 1 < 10000 THEN 0 ELSE (e - 1 - 10000) // 20000 + 1 END AS r1 FROM s),
x AS (SELECT *, unnest(range(r0, r1 + 1)) AS read_id FROM r),
y AS (SELECT *, greatest(b, CASE WHEN read_id = 0 THEN 0 ELSE 10000 + (read_id - 1) * 20000 END) AS lo, least(e, 10000 + read_id * 20000) AS hi FROM x)
SELECT reduce_id, read_id, map_id, (lo - b)::BIGINT AS block_offset, (hi - lo)::BIGINT AS length FROM y""")
def pack_reads(spark, sf):
    return fetchplan.pack_reads(_blocks(spark, sf), 10_000, 20_000)


@query(f"""WITH {BLOCKS}, e AS (SELECT *, CASE WHEN length <= 0 THEN 0 WHEN length <= 1 THEN 1 ELSE least(255, ceil(ln(length::DOUBLE) / ln(1.1::DOUBLE))) END::INTEGER AS code FROM blocks),
d AS (SELECT reduce_id AS reader, length, (CASE WHEN code = 0 THEN 0 ELSE floor(pow(1.1::DOUBLE, code)) END)::BIGINT AS stated, (map_id + reduce_id) % 257 <> 0 AS done FROM e)
SELECT reader, bool_and(done) AS all_read, NOT bool_or(stated * 1.1::DOUBLE < length) AS sizes_fit FROM d GROUP BY reader""")
def read_validation(spark, sf):
    """Whether each reader got all its parts, and none longer by a tenth than its coded size."""
    rows = _blocks(spark, sf).withColumn("stated", sizing.decode_size(sizing.encode_size(F.col("length"))))
    return mapoutput.read_complete(rows.select(F.col("reduce_id").alias("reader"), "length", "stated", (F.pmod(F.col("map_id") + F.col("reduce_id"), F.lit(257)) != 0).alias("done")))


@query("""SELECT s_suppkey, (1073741824 * (1 + s_suppkey % 4))::BIGINT AS memory, (floor(((1073741824 * (1 + s_suppkey % 4)) - 314572800) * 0.5::DOUBLE * 1 / 4 * 0.1::DOUBLE))::BIGINT AS watermark FROM supplier""")
def low_grant_watermark(spark, sf):
    """The grant below which memory counts as low, for executors of one to four GiB."""
    rows = table(spark, sf, "supplier").select("s_suppkey", (F.lit(1 << 30) * (1 + F.pmod("s_suppkey", F.lit(4)))).cast("long").alias("memory"))
    return rows.withColumn("watermark", sizing.grant_watermark(F.col("memory"), F.lit(0.5), F.lit(1), F.lit(4), F.lit(0.1)))


@query(f"""WITH {BLOCKS}, a AS (SELECT *, (sum(length) OVER () // ({MAPS} * {REDUCES}))::BIGINT AS average FROM blocks)
SELECT map_id, reduce_id, length, (SELECT min(k) FROM range(1, 200) t(k) WHERE (average + 100) * k * (k + 1) // 2 > length)::BIGINT AS rounds FROM a""")
def probe_read_rounds(spark, sf):
    blocks = materialize(_blocks(spark, sf), "blocks")
    average = blocks.agg(F.expr("sum(length) div count(*)").alias("average"))
    return blocks.join(F.broadcast(average)).select("map_id", "reduce_id", "length", sizing.probe_rounds(F.col("length"), F.col("average")).alias("rounds"))


@query("""SELECT l_suppkey AS shuffle_id, l_orderkey % 16 AS map_id, count(*) AS n FROM lineitem
WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_acctbal > 0 AND s_suppkey = l_suppkey) GROUP BY ALL""")
def retention_orphans(spark, sf):
    """A supplier stands for a shuffle, registered while its balance is positive."""
    outputs = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("shuffle_id"), F.pmod("l_orderkey", F.lit(16)).alias("map_id"))
    live = table(spark, sf, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("shuffle_id"))
    return mapoutput.orphans(keyed.reduce_by_key(outputs, ["shuffle_id", "map_id"], n=F.count("*")), live)


@query("""SELECT l_suppkey AS shuffle_id, l_orderkey % 16 AS map_id, count(*) AS n FROM lineitem
WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey % 100 = l_suppkey AND o_orderkey % 16 = l_orderkey % 16 AND o_totalprice > 400000) GROUP BY ALL""")
def retention_by_map(spark, sf):
    """Map tasks that ran again, named by orders of high value."""
    outputs = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("shuffle_id"), F.pmod("l_orderkey", F.lit(16)).alias("map_id"))
    lost = table(spark, sf, "orders").filter("o_totalprice > 400000").select((F.col("o_custkey") % 100).alias("shuffle_id"), (F.col("o_orderkey") % 16).alias("map_id"))
    return mapoutput.orphans_of_maps(keyed.reduce_by_key(outputs, ["shuffle_id", "map_id"], n=F.count("*")), lost)


@query("""SELECT o_custkey AS app_id, o_orderkey % 8 AS shuffle_id, count(*) AS n FROM orders
WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY ALL""")
def retention_by_app(spark, sf):
    """A customer stands for an application, which runs while the balance is positive."""
    outputs = table(spark, sf, "orders").select(F.col("o_custkey").alias("app_id"), F.pmod("o_orderkey", F.lit(8)).alias("shuffle_id"))
    live = table(spark, sf, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("app_id"))
    return mapoutput.orphans_of_apps(keyed.reduce_by_key(outputs, ["app_id", "shuffle_id"], n=F.count("*")), live)


@query(f"""WITH {BLOCKS} SELECT map_id, (reduce_id // {SPAN} * {SPAN})::INTEGER AS start_reduce, (reduce_id // {SPAN} * {SPAN} + {SPAN})::INTEGER AS end_reduce,
min("offset") AS "offset", sum(length)::BIGINT AS length FROM indexed WHERE map_id IN (1, 2, 3, 5, 8, 13, 21, 34, 55) GROUP BY ALL""")
def served_index(spark, sf):
    """Readers of nine maps ask an index that was written once; the maps ask for pruned row groups."""
    ranges = spark.range(0, REDUCES, SPAN).select(F.col("id").cast("int").alias("start_reduce"), (F.col("id") + SPAN).cast("int").alias("end_reduce"))
    return mapoutput.IndexService(_blocks(spark, sf)).segments(F.broadcast(ranges), [1, 2, 3, 5, 8, 13, 21, 34, 55])


CASES = "(VALUES (true), (false))"


@query(f"""WITH c AS (SELECT a.x AS map_side_combine, b.x AS relocatable, p.x AS num_partitions, d.x AS compressed, e.x AS concat_codec, f.x AS old_protocol
  FROM {CASES} a(x), {CASES} b(x), (VALUES (1), (200), (2000), (2001), (16777217)) p(x), {CASES} d(x), {CASES} e(x), {CASES} f(x))
SELECT *, CASE WHEN NOT map_side_combine AND num_partitions <= 200 THEN 'bypass' WHEN relocatable AND NOT map_side_combine AND num_partitions <= 16777216 THEN 'serialized' ELSE 'general' END AS writer,
  CASE WHEN num_partitions > 2000 THEN 'unknown_sizes' ELSE 'known_sizes' END AS reader, relocatable AND (NOT compressed OR concat_codec) AND NOT old_protocol AS batch_fetch FROM c""")
def strategy_policy(spark, sf):
    flags = ("map_side_combine", "relocatable", "compressed", "concat_codec", "old_protocol")
    cases = spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in (1, 200, 2000, 2001, 16777217)])).alias("num_partitions"))
    for flag in flags:
        cases = cases.withColumn(flag, F.explode(F.array(F.lit(True), F.lit(False))))
    return cases.select("*", policy.writer(200).alias("writer"), policy.reader().alias("reader"), policy.batch_fetch().alias("batch_fetch"))


@query("""WITH b AS (SELECT l_suppkey % 8 AS task, l_suppkey AS partition_id, sum(round(l_quantity * 100)::BIGINT)::BIGINT AS est_bytes FROM lineitem GROUP BY ALL),
t AS (SELECT task, sum(est_bytes)::BIGINT // 4 AS target FROM b GROUP BY task),
s AS (SELECT b.*, target, (sum(est_bytes) OVER (PARTITION BY b.task ORDER BY est_bytes DESC, partition_id) - est_bytes)::BIGINT AS freed_before FROM b JOIN t USING (task))
SELECT task, partition_id, est_bytes, freed_before FROM s WHERE freed_before < target""")
def evict_largest_first(spark, sf):
    rows = table(spark, sf, "lineitem").groupBy(F.pmod("l_suppkey", F.lit(8)).alias("task"), F.col("l_suppkey").alias("partition_id")).agg(F.sum(cents("l_quantity")).alias("est_bytes"))
    target = F.expr("sum(est_bytes) over (partition by task) div 4")
    return sizing.evict_largest(rows.withColumn("target", target), F.col("target"), "task").select("task", "partition_id", "est_bytes", "freed_before")


@query("""WITH RECURSIVE last AS (SELECT l_returnflag AS buffer, count(*) AS n FROM lineitem GROUP BY 1),
p(buffer, n, x) AS (SELECT buffer, n, 1::BIGINT FROM last UNION ALL SELECT buffer, n, greatest(x + 1, ceil(x * 1.1::DOUBLE)::BIGINT) FROM p WHERE greatest(x + 1, ceil(x * 1.1::DOUBLE)::BIGINT) <= n)
SELECT buffer, x AS n_updates, x * 100 AS bytes, CASE WHEN lag(x) OVER w IS NULL THEN 0.0 ELSE 100.0 END::DOUBLE AS per_update,
  (x * 100 + CASE WHEN lag(x) OVER w IS NULL THEN 0 ELSE 100 * (coalesce(lead(x) OVER w, x) - x) END)::BIGINT AS projected FROM p WINDOW w AS (PARTITION BY buffer ORDER BY x)""")
def sample_schedule(spark, sf):
    """Buffers of 100-byte records: when they are measured, and the size projected to the next measure."""
    last = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("buffer")).agg(F.count("*").alias("n"))
    points = last.select("buffer", F.explode(sizing.sample_points(F.col("n"))).alias("n_updates")).withColumn("bytes", F.col("n_updates") * 100)
    return sizing.extrapolate(points, "buffer")


@query("SELECT l_partkey % 12 AS bucket, count(*) AS n, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS total_cents FROM lineitem GROUP BY 1")
def durable_exchange(spark, sf):
    """The exchange is written to shared storage; what follows reads it from there."""
    rows = table(spark, sf, "lineitem").select(F.pmod("l_partkey", F.lit(12)).alias("bucket"), cents("l_extendedprice").alias("v"))
    return keyed.reduce_by_key(materialize(partitioning.hash_partition(rows, "bucket", 12), "exchange"), ["bucket"], n=F.count("*"), total_cents=F.sum("v"))


@query("SELECT (o_custkey % 16)::INTEGER AS reduce_id, count(*) AS n, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS total_cents FROM orders WHERE o_custkey % 16 BETWEEN 4 AND 11 GROUP BY 1")
def segment_range_read(spark, sf):
    """Half of the reduce partitions of a reduce-major exchange; the others are not opened."""
    path = segments.write_segments(table(spark, sf, "orders").select("o_custkey", "o_totalprice"), "o_custkey", 16)
    return segments.read_segments(spark, path, 4, 12).groupBy("reduce_id").agg(F.count("*").alias("n"), F.sum(cents("o_totalprice")).alias("total_cents"))


@query("""SELECT event_id, 'shuffle_' || user_id || '_' || event_id || '_' || (event_id % 8) AS block, user_id::INTEGER AS shuffle_id, event_id AS map_id, (event_id % 8)::INTEGER AS reduce_id,
  '/shuffle/app-1/' || user_id || '_' || event_id || '.index' AS index_path, event_id || '_' || (event_id % 8) AS spill_key, 1 AS app_number, 'app-1' || user_id AS object_key,
  'store' AS host, 31457280 AS buffer_bytes FROM events""")
def block_names(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "user_id", F.concat_ws("_", F.lit("shuffle"), "user_id", "event_id", F.pmod("event_id", F.lit(8))).alias("block"), F.lit("app-1").alias("app"))
    rows = rows.withColumn("p", naming.parse_block(F.col("block")))
    return rows.select(
        "event_id", "block", "p.shuffle_id", "p.map_id", "p.reduce_id", naming.file_path(F.lit("/shuffle"), F.col("app"), F.col("user_id"), F.col("event_id"), "index").alias("index_path"),
        naming.spill_key(F.col("event_id"), F.col("p.reduce_id")).alias("spill_key"), naming.numeric_app_id(F.col("app")).cast("int").alias("app_number"), naming.object_key(F.col("app"), F.col("user_id")).alias("object_key"),
        naming.host(F.lit("hdfs://store:9000/x")).alias("host"), naming.byte_size(F.lit("30m")).cast("int").alias("buffer_bytes"),
    )


# Relational queries over the exchange


@query("""SELECT o_orderpriority, count(*) AS n, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS revenue_cents
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL""")
def shuffled_inner_join(spark, sf):
    lines, orders = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    joined = lines.hint("merge").join(orders, lines.l_orderkey == orders.o_orderkey)
    return joined.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.sum(cents("l_extendedprice")).alias("revenue_cents"))


@query("""SELECT 'left' AS kind, c_mktsegment, count(*) AS n, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY ALL
UNION ALL SELECT 'right', c_mktsegment, count(*), count(o_orderkey) FROM customer RIGHT JOIN orders ON c_custkey = o_custkey GROUP BY ALL
UNION ALL SELECT 'full', c_mktsegment, count(*), count(o_orderkey) FROM customer FULL JOIN orders ON c_custkey = o_custkey GROUP BY ALL""")
def shuffled_outer_join(spark, sf):
    customers, orders, out = table(spark, sf, "customer"), table(spark, sf, "orders"), None
    for how in ("left", "right", "full"):
        one = customers.join(orders, customers.c_custkey == orders.o_custkey, how).groupBy(F.lit(how).alias("kind"), "c_mktsegment").agg(F.count("*").alias("n"), F.count("o_orderkey").alias("n_orders"))
        out = one if out is None else out.unionByName(one)
    return out


@query("""SELECT 'semi' AS kind, c_nationkey, count(*) AS n FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) GROUP BY ALL
UNION ALL SELECT 'anti', c_nationkey, count(*) FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) GROUP BY ALL""")
def semi_anti_join(spark, sf):
    customers, orders = table(spark, sf, "customer"), table(spark, sf, "orders")
    one = lambda how: customers.join(orders, customers.c_custkey == orders.o_custkey, f"left_{how}").groupBy(F.lit(how).alias("kind"), "c_nationkey").agg(F.count("*").alias("n"))
    return one("semi").unionByName(one("anti"))


@query("""WITH p AS (SELECT (epoch(o_orderdate)::BIGINT // 86400)::BIGINT AS d, o_totalprice FROM orders),
b AS (SELECT min(d) OVER () + 90 * i AS s, min(d) OVER () + 90 * i + 120 AS e, i::INTEGER AS bucket FROM range(0, 30) t(i), (SELECT min(d) AS d FROM p))
SELECT bucket, count(*) AS n, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS total_cents FROM p JOIN b ON p.d >= s AND p.d < e GROUP BY ALL""")
def range_join(spark, sf):
    """Orders against overlapping spans of 120 days that start every 90."""
    orders = table(spark, sf, "orders").select(F.floor(F.unix_timestamp("o_orderdate") / 86400).alias("day"), "o_totalprice")
    first = orders.agg(F.min("day").alias("d"))
    spans = first.select(F.explode(F.sequence(F.lit(0), F.lit(29))).alias("bucket"), "d").select("bucket", (F.col("d") + F.col("bucket") * 90).alias("s"), (F.col("d") + F.col("bucket") * 90 + 120).alias("e"))
    return relational.range_join(orders, spans, "day", "s", "e", 60).groupBy("bucket").agg(F.count("*").alias("n"), F.sum(cents("o_totalprice")).alias("total_cents"))


@query("SELECT l_returnflag, count(DISTINCT l_suppkey) AS n_suppliers, count(DISTINCT l_partkey) AS n_parts FROM lineitem GROUP BY ALL")
def distinct_aggregate(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.countDistinct("l_suppkey").alias("n_suppliers"), F.countDistinct("l_partkey").alias("n_parts"))


@query("""SELECT 'rollup' AS kind, l_returnflag, l_linestatus, grouping(l_returnflag, l_linestatus)::BIGINT AS gid, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)
UNION ALL SELECT 'cube', l_returnflag, l_linestatus, grouping(l_returnflag, l_linestatus)::BIGINT, count(*) FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""")
def rollup_cube(spark, sf):
    lines = table(spark, sf, "lineitem")
    one = lambda g, kind: g.agg(F.grouping_id().alias("gid"), F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "l_returnflag", "l_linestatus", "gid", "n")
    return one(lines.rollup("l_returnflag", "l_linestatus"), "rollup").unionByName(one(lines.cube("l_returnflag", "l_linestatus"), "cube"))


@query("""SELECT o_custkey, o_orderkey, row_number() OVER w AS rn, round(o_totalprice * 100)::BIGINT - lag(round(o_totalprice * 100)::BIGINT) OVER w AS change_cents,
  sum(round(o_totalprice * 100)::BIGINT) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)::BIGINT AS rolling_cents
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def window_rank_frame(spark, sf):
    line = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    price = cents("o_totalprice")
    return table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.row_number().over(line).cast("long").alias("rn"), (price - F.lag(price).over(line)).alias("change_cents"), F.sum(price).over(line.rowsBetween(-2, 0)).alias("rolling_cents"))


@query("SELECT o_orderkey, o_custkey, round(o_totalprice * 100)::BIGINT AS price_cents FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def top_k(spark, sf):
    return table(spark, sf, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10).select("o_orderkey", "o_custkey", cents("o_totalprice").alias("price_cents"))


@query("""WITH c AS (SELECT c_nationkey::BIGINT AS k FROM customer), s AS (SELECT s_nationkey::BIGINT AS k FROM supplier)
SELECT 'intersect' AS op, k, count(*) AS n FROM (SELECT k FROM c INTERSECT SELECT k FROM s) GROUP BY k
UNION ALL SELECT 'except_all', k, count(*) FROM (SELECT k FROM c EXCEPT ALL SELECT k FROM s) GROUP BY k
UNION ALL SELECT 'union_all', k, count(*) FROM (SELECT k FROM c UNION ALL SELECT k FROM s) GROUP BY k""")
def set_operations(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_nationkey").cast("long").alias("k"))
    s = table(spark, sf, "supplier").select(F.col("s_nationkey").cast("long").alias("k"))
    one = lambda rows, op: rows.groupBy(F.lit(op).alias("op"), "k").agg(F.count("*").alias("n"))
    return one(c.intersect(s), "intersect").unionByName(one(c.exceptAll(s), "except_all")).unionByName(one(c.unionByName(s), "union_all"))


_SAME = "SELECT '{0}' AS kind, count(*) AS n, sum(o_orderkey)::BIGINT AS key_sum, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS total_cents FROM orders"


@query(" UNION ALL ".join(_SAME.format(k) for k in ("round_robin", "range", "hash", "sparse")))
def repartition_invariance(spark, sf):
    """The rows are the same however they are dealt, also over more partitions than there are keys."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    ways = {"round_robin": partitioning.round_robin(orders, 20), "range": partitioning.range_partition(orders, 12, "o_totalprice"), "hash": partitioning.hash_partition(orders, "o_custkey", 16), "sparse": partitioning.hash_partition(orders, F.pmod("o_custkey", F.lit(3)), 40)}
    out = None
    for kind, rows in ways.items():
        one = rows.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"), F.sum("o_orderkey").alias("key_sum"), F.sum(cents("o_totalprice")).alias("total_cents"))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT l_quantity AS value, sum(round(l_quantity * 100)::BIGINT)::BIGINT AS total_hundredths FROM lineitem GROUP BY 1")
def adaptive_group_sum(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.col("l_quantity").alias("value")).agg(F.sum(cents("l_quantity")).alias("total_hundredths"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n_events FROM events GROUP BY ALL")
def event_windows(spark, sf):
    return windows.tumbling(table(spark, sf, "events"))


@query("""WITH g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
r AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n_events FROM r GROUP BY user_id, run""")
def event_sessions(spark, sf):
    return windows.sessions(table(spark, sf, "events"))
