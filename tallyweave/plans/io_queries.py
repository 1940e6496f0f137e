"""Binary traces, synthetic skew, sinks, saved summaries and streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyweave.functions.weights import WEIGHTS
from tallyweave.operators import extract as E
from tallyweave.operators import universal as U
from tallyweave.operators.exact import key_counts
from tallyweave.operators.params import sketch_params_table
from tallyweave.plans import sqltext as Q
from tallyweave.plans import streams as S
from tallyweave.plans import summary_queries as M
from tallyweave.plans.exact_queries import PART_COUNTS, rounded
from tallyweave.plans.registry import query
from tallyweave.sources import binary as R
from tallyweave.sources import sinks as K
from tallyweave.sources import zipf as Z
from tallyweave.sources.scratch import scratch_path
from tallyweave.streaming import summaries as G

# --- binary traces ----------------------------------------------------------------------

IN_ORDER = "row_number() OVER (ORDER BY seq) - 1 AS seq"


def written(spark, df, layout, **options) -> str:
    """Write a stream as raw records and return the folder."""
    folder = scratch_path(spark, "trace")
    R.write_trace(df, folder, layout, **options).collect()
    return folder


@query("read_flow_trace", f"SELECT {IN_ORDER}, src_ip, dst_ip, src_port, dst_port, proto, ts FROM ({S.TRACE})")
def _(spark, d):
    return R.read_flow_trace(spark, written(spark, S.trace(spark, d), "flow") + "/part-*.dat")


@query("read_flow_trace_big_endian", f"SELECT {IN_ORDER}, src_ip, ts FROM ({S.TRACE})")
def _(spark, d):
    folder = written(spark, S.trace(spark, d), "flow", byte_order="big")
    return R.read_flow_trace(spark, folder + "/part-*.dat", byte_order="big").select("seq", "src_ip", "ts")


@query("read_trace_dir", f"SELECT src_ip AS key, count(*) AS f FROM ({S.TRACE}) GROUP BY 1")
def _(spark, d):
    trace = R.read_trace_dir(spark, written(spark, S.trace(spark, d), "flow"))
    return trace.groupBy(F.col("src_ip").alias("key")).agg(F.count(F.lit(1)).alias("f"))


@query("read_doc_items", f"SELECT {IN_ORDER}, src_ip AS key, ts FROM ({S.TRACE})")
def _(spark, d):
    items = S.trace(spark, d).select("seq", F.col("src_ip").alias("key"), "ts")
    return R.read_doc_items(spark, written(spark, items, "item") + "/part-*.dat")


@query("read_id_stream", "SELECT row_number() OVER (ORDER BY event_id) - 1 AS seq, user_id AS key FROM events")
def _(spark, d):
    return R.read_id_stream(spark, written(spark, S.users(spark, d), "id") + "/part-*.dat")


@query("write_trace", "SELECT count(*)::BIGINT AS records FROM events")
def _(spark, d):
    parts = R.write_trace(S.users(spark, d), scratch_path(spark, "trace"), "id")
    return parts.agg(F.sum("records").alias("records"))


# --- synthetic skew ---------------------------------------------------------------------

N_KEYS, SEED = 1000, 42


def zipf_sql(alpha: float) -> str:
    """Every event draws the first rank whose cumulative share reaches its uniform."""
    u = f"({Q.one_hash('event_id', SEED, 'uniform')} + 0.5)::DOUBLE / 2147483647.0::DOUBLE"
    return f"""SELECT e.seq, c.rank, {Q.one_hash('c.rank', SEED, 'zipf')} AS key, 1::BIGINT AS weight
 FROM (SELECT event_id AS seq, {u} AS u FROM events) e
 ASOF JOIN (SELECT rank, sum(p) OVER (ORDER BY rank) / sum(p) OVER () AS share
  FROM (SELECT r AS rank, pow(r, -{alpha}) AS p FROM (SELECT unnest(range(1, {N_KEYS + 1})) AS r))) c ON e.u <= c.share"""


def positions(spark, d):
    return S.table(spark, d, "events").select(F.col("event_id").alias("seq"))


@query("zipf_keys", zipf_sql(1.2))
def _(spark, d):
    return Z.zipf_keys(positions(spark, d), N_KEYS, 1.2, SEED)


# Skews from 1 to 3 in steps of a tenth.
ALPHAS = [round(1 + i / 10, 1) for i in range(21)]
# Positions of one task of the sweep.
SWEPT_ROWS = 200_000


@query("zipf_sweep", " UNION ALL ".join(
    f"SELECT {a}::DOUBLE AS alpha, rank, count(*) AS n FROM ({zipf_sql(a)}) GROUP BY rank" for a in ALPHAS))
def _(spark, d):
    """All skews in one scan, one folder each, read back."""
    path = scratch_path(spark, "zipf")
    numbers = positions(spark, d)
    # A task sorts what it writes by folder, so it gets a fixed number of positions however large the input's splits are.
    dealt = numbers.repartition(-(-numbers.count() // SWEPT_ROWS) or 1)
    Z.zipf_sweep(dealt, N_KEYS, ALPHAS, SEED).write.partitionBy("alpha").parquet(path)
    return spark.read.parquet(path).groupBy(F.col("alpha").cast("double"), "rank").agg(F.count(F.lit(1)).alias("n"))


# --- sinks ------------------------------------------------------------------------------

def _results(spark, d):
    return S.table(spark, d, "lineitem").select(
        F.col("l_linenumber").alias("mem"), F.col("l_returnflag").alias("algo"), F.col("l_quantity").alias("value"))


@query("write_result_csv", "SELECT l_linenumber AS mem, " + ", ".join(
    f"round(avg(l_quantity) FILTER (l_returnflag = '{x}'), 6) AS {x.lower()}" for x in "ANR") + " FROM lineitem GROUP BY 1")
def _(spark, d):
    path = scratch_path(spark, "csv")
    K.write_result_csv(_results(spark, d), path, ["A", "N", "R"])
    back = spark.read.csv(path, header=True, schema="mem int, A double, N double, R double")
    return rounded(back.toDF("mem", "a", "n", "r"), "a", "n", "r")


@query("write_frequency_stats", f"SELECT 'total' AS part, count(*) AS a, sum(f)::BIGINT AS b FROM ({PART_COUNTS}) "
                                f"UNION ALL SELECT 'size', f, count(*) FROM ({PART_COUNTS}) GROUP BY f")
def _(spark, d):
    path = scratch_path(spark, "stats")
    K.write_frequency_stats(key_counts(S.parts(spark, d)), path)
    return spark.read.csv(path, header=True, schema="part string, a bigint, b bigint")


@query("write_text_report", f"SELECT concat_ws(',', key, f) AS value FROM ({PART_COUNTS})")
def _(spark, d):
    path = scratch_path(spark, "report")
    K.write_text_report(key_counts(S.parts(spark, d)), path)
    return spark.read.text(path)


@query("save_sketch", Q.chain(M.gsum_sql(M.CUT, "entropy"), **M.extract_ctes(S.PARTS, M.CUT)))
def _(spark, d):
    path = scratch_path(spark, "sketch")
    K.save_sketch(M.summary(spark, d), path)
    return rounded(E.extract_gsum(K.load_sketch(spark, path), WEIGHTS["entropy"]), "gsum")


@query("load_sketch", Q.chain("SELECT * FROM u", **M.extract_ctes(S.PARTS, M.CUT)))
def _(spark, d):
    path = scratch_path(spark, "sketch")
    K.save_sketch(M.summary(spark, d), path)
    return K.load_sketch(spark, path).counters


_lvl = "trunc(mem * (1::DOUBLE - 0.6::DOUBLE))::BIGINT // 14"


@query("sketch_params_from_memory", f"""SELECT mem, trunc(mem * 0.6::DOUBLE)::BIGINT // 64 AS buckets,
 greatest(1, trunc(lvl * 0.9::DOUBLE)::BIGINT // 4 // 5) AS width, greatest(1, trunc(lvl * (1::DOUBLE - 0.9::DOUBLE))::BIGINT // 4) AS capacity
 FROM (SELECT mem, {_lvl} AS lvl FROM (SELECT DISTINCT p_size * 7919::BIGINT AS mem FROM part))""")
def _(spark, d):
    budgets = S.table(spark, d, "part").select((F.col("p_size") * F.lit(7919).cast("bigint")).alias("mem")).distinct()
    return sketch_params_table(budgets)


# --- streaming --------------------------------------------------------------------------

def user_stream(spark, d):
    """The events file as an unbounded stream of users."""
    schema = S.table(spark, d, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    from tallyweave.operators.exact import keyed_stream
    return keyed_stream(events, "user_id", seq="event_id")


def ordered_user_stream(spark, d):
    """The same with micro-batches of bounded size that follow each other by arrival number."""
    return G.land_in_order(S.users(spark, d))


@query("stream_key_counts", S.counts_sql(S.USERS))
def _(spark, d):
    return G.last_batch(G.drain(G.stream_key_counts(user_stream(spark, d)), "complete"))


@query("stream_key_counts_update", S.counts_sql(S.USERS))
def _(spark, d):
    return G.last_update(G.drain(G.stream_key_counts(user_stream(spark, d)), "update"), ["key"])


@query("reset_epoch", f"SELECT seq // 2000 AS epoch, key, sum(weight)::BIGINT AS f FROM ({S.USERS}) GROUP BY ALL")
def _(spark, d):
    epochs = G.reset_epoch(user_stream(spark, d), 2000)
    return G.last_batch(G.drain(G.stream_key_counts(epochs, by=["epoch"]), "complete"))


@query("stream_linear_sketch", Q.cells(S.USERS, M.FOLD, "count"))
def _(spark, d):
    return G.last_batch(G.drain(G.stream_linear_sketch(user_stream(spark, d), M.FOLD), "complete"))


@query("stream_universal_sketch", Q.chain("SELECT * FROM u", **{k: v for k, v in M.level_ctes(S.USERS, M.FOLD).items() if k in "csu"}))
def _(spark, d):
    return G.last_batch(G.drain(G.stream_linear_sketch(user_stream(spark, d), M.FOLD, "universal"), "complete"))


_fold = {"s": Q.heavy_replay(S.USERS, M.FOLD, "elastic"), "h": Q.replay_heavy("s"), "m": Q.replay_moved("s")}


@query("stream_heavy_fold", Q.chain("SELECT bucket, key, v, flag FROM h", **_fold))
def _(spark, d):
    return G.latest_residents(G.drain(G.stream_heavy_fold(ordered_user_stream(spark, d), M.FOLD, "elastic", shards=1))).drop("shard")


@query("stream_heavy_evictions", Q.chain("SELECT kind, bucket, seq, key, f FROM m", **_fold))
def _(spark, d):
    rows = G.drain(G.stream_heavy_fold(ordered_user_stream(spark, d), M.FOLD, "elastic", shards=1))
    return rows.filter(F.col("kind") != "heavy").select("kind", "bucket", "seq", "key", "f")


_dealt = f"(seq % {G.STREAM_SHARDS}) * 1000 + {Q.bucket_sql('key', M.FOLD.seed, M.FOLD.buckets)}"
_sharded = {"st": Q.heavy_replay(S.USERS, M.FOLD, "frequent", bucket=_dealt), "hs": Q.replay_heavy("st"), "m": Q.replay_moved("st"),
            "g": "SELECT bucket % 1000 AS bucket, key, sum(v)::BIGINT AS v, bool_or(flag) OR count(*) < (SELECT count(DISTINCT bucket // 1000) FROM hs) AS flag FROM hs GROUP BY ALL",
            "h": f"SELECT bucket, key, v, flag FROM g QUALIFY row_number() OVER (PARTITION BY bucket ORDER BY v DESC, key) <= {M.FOLD.slots}",
            "r": "SELECT key, sum(f)::BIGINT AS f FROM (SELECT key, f FROM m UNION ALL SELECT key, v FROM g WHERE key NOT IN (SELECT key FROM h)) GROUP BY key",
            "s": Q.sampled("SELECT * FROM r", M.FOLD), "u": Q.level_cells("s", M.FOLD)}


@query("stream_heavy_fold_sharded", Q.chain("SELECT bucket // 1000 AS shard, bucket % 1000 AS bucket, key, v, flag FROM hs", **{k: _sharded[k] for k in ("st", "hs")}))
def _(spark, d):
    return G.latest_residents(G.drain(G.stream_heavy_fold(ordered_user_stream(spark, d), M.FOLD, "frequent")))


def _streamed(spark, d, strategy="elastic", **options):
    path = scratch_path(spark, "extract")
    G.stream_extract(ordered_user_stream(spark, d), M.FOLD, strategy, path, **options)
    return G.load_stream_extract(spark, path, M.FOLD)


@query("stream_extract", Q.chain("SELECT * FROM u", **M.replay_ctes(S.USERS, M.FOLD, "elastic")))
def _(spark, d):
    return _streamed(spark, d, shards=1)[1]


@query("stream_extract_query", Q.chain(M.value_sql("SELECT DISTINCT user_id AS key FROM events", M.FOLD), **M.replay_ctes(S.USERS, M.FOLD, "elastic")))
def _(spark, d):
    heavy, counters = _streamed(spark, d, shards=1)
    s = E.Summary(heavy, counters, None, M.FOLD)
    return E.extract_query(S.users(spark, d).select("key").distinct(), s)


@query("stream_extract_sharded", Q.chain(M.value_sql("SELECT DISTINCT user_id AS key FROM events", M.FOLD), **_sharded))
def _(spark, d):
    heavy, counters = _streamed(spark, d, "frequent")
    return E.extract_query(S.users(spark, d).select("key").distinct(), E.Summary(heavy, counters, None, M.FOLD))
