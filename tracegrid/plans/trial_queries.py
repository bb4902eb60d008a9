"""Queries of screening, trials and clocks; imported by the registry, which they enter."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import align as J
from ..operators import events as E
from ..operators import screening as K
from ..operators import series as W
from ..operators import stats as A
from ..sources import tables as T
from ..operators.lineage import new_path
from . import adapters as D
from .registry import query

T_SQL = "WITH " + D.TRIALS
S_SQL = "WITH " + D.SAMPLES


@query("f5_high_impedance", """WITH x AS (SELECT s_nationkey AS session, s_suppkey AS electrode, CASE WHEN s_acctbal > 0 THEN s_acctbal END AS kohm FROM supplier),
k AS (SELECT *, coalesce(kohm <= 1000, true) AS ok FROM x) SELECT session, electrode FROM k QUALIFY ok OR NOT bool_or(ok) OVER (PARTITION BY session)""")
def _(spark, d):
    s = D.table(spark, d, "supplier").select(F.col("s_nationkey").alias("session"), F.col("s_suppkey").alias("electrode"), F.col("s_acctbal").alias("kohm"))
    return K.exclude_high_impedance(s.drop("kohm"), s.where("kohm > 0"), 1000.0).select("session", "electrode")


@query("f6_resolve_metadata", """SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority <> '2-HIGH', o_orderstatus <> 'F', o_totalprice <= 100000, o_orderkey) = 1""")
def _(spark, d):
    o = D.table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice")
    wishes = [F.col("o_orderpriority") == "2-HIGH", F.col("o_orderstatus") == "F", F.col("o_totalprice") > 100000]
    return K.resolve_metadata(o, "o_custkey", wishes, "o_orderkey").select("o_custkey", "o_orderkey")


@query("f7_curated_events", """WITH keep AS (SELECT DISTINCT event_type, event_id FROM events WHERE value > 60 AND event_type <> 'click')
SELECT event_type, event_id FROM events WHERE event_type NOT IN (SELECT event_type FROM keep) OR event_id IN (SELECT event_id FROM keep)""")
def _(spark, d):
    e = D.table(spark, d, "events").select("event_type", "event_id", "value")
    return K.curate_events(e, e.where("value > 60 and event_type <> 'click'"), "event_type", "event_id").select("event_type", "event_id")


@query("f8_drop_near", """WITH e AS (SELECT event_id, user_id % 4 AS k, epoch_us(ts) / 1000.0::DOUBLE AS tm, event_type FROM events)
SELECT event_id FROM e WHERE event_type = 'click' AND NOT EXISTS (SELECT 1 FROM e f WHERE f.event_type = 'error' AND f.k = e.k AND abs(f.tm - e.tm) <= 900000)""")
def _(spark, d):
    e = D.table(spark, d, "events").select("event_id", "event_type", (F.col("user_id") % 4).alias("k"), D.micros("ts").alias("start"))
    return K.drop_near(e.where("event_type = 'click'"), e.where("event_type = 'error'"), 900_000, "k").select("event_id")


@query("f9_rename_segments", """WITH n AS (SELECT o_orderkey, concat('base_', CASE o_orderkey % 4 WHEN 0 THEN 'nan' WHEN 1 THEN '0' WHEN 2 THEN '100' ELSE '300' END, '_', CASE WHEN o_custkey % 2 = 0 THEN 'neg' ELSE 'pos' END) AS old FROM orders)
SELECT o_orderkey, regexp_replace(old, '^base_(nan|0|100|200)_(neg|pos)$', 'base_\\2_\\1') AS name FROM n""")
def _(spark, d):
    k = F.col("o_orderkey") % 4
    name = F.concat(F.lit("base_"), F.when(k == 0, "nan").when(k == 1, "0").when(k == 2, "100").otherwise("300"), F.lit("_"), F.when(F.col("o_custkey") % 2 == 0, "neg").otherwise("pos"))
    return D.table(spark, d, "orders").select("o_orderkey", S.rename_segment(name).alias("name"))


@query("f13_channel_order", """WITH b AS (SELECT l_linestatus AS region, l_suppkey AS channel, max(l_quantity) AS peak, arg_min(l_orderkey, (-l_quantity, l_orderkey)) AS peak_t FROM lineitem GROUP BY ALL)
SELECT *, CAST(row_number() OVER (PARTITION BY region ORDER BY peak_t, peak DESC, channel) AS INTEGER) AS rank FROM b""")
def _(spark, d):
    li = D.table(spark, d, "lineitem").select(F.col("l_linestatus").alias("region"), F.col("l_suppkey").alias("channel"), F.col("l_quantity").alias("value"), F.col("l_orderkey").alias("t"))
    return K.order_channels(li)


@query("f17_coverage", """WITH x AS (SELECT event_type, user_id, CASE WHEN value > 40 THEN value END AS v FROM events)
SELECT event_type, user_id, count(*) AS n FROM x GROUP BY ALL HAVING avg(CASE WHEN v IS NOT NULL THEN 1.0 ELSE 0.0 END) >= 0.5""")
def _(spark, d):
    e = D.table(spark, d, "events").select("event_type", "user_id", F.when(F.nanvl("value", F.lit(None).cast("double")) > 40, F.col("value")).alias("value"))
    return K.filter_coverage(e, ["event_type", "user_id"], 0.5).groupBy("event_type", "user_id").agg(F.count("*").alias("n"))


@query("j4_raw_windows", S_SQL + """, ev AS (SELECT session, sample AS tm FROM samples WHERE channel = 0 AND value > 90),
w AS (SELECT ev.session, tm AS event_id, channel, sample - tm AS rel, value, count(*) OVER (PARTITION BY ev.session, tm, channel) AS n FROM ev JOIN samples s ON s.session = ev.session AND sample BETWEEN tm - 3 AND tm + 3)
SELECT session, event_id, channel, rel, value FROM w WHERE n = 7""")
def _(spark, d):
    s = D.samples(spark, d)
    ev = s.where("channel = 0 and value > 90").select("session", F.col("sample").alias("event_id"), F.col("sample").alias("at"))
    return J.extract_trials(T.to_blocks(s, 16), ev, 3, 4, 16)


@query("j8_align_frames", """WITH o AS (SELECT l_suppkey AS k, CAST(l_linenumber AS BIGINT) AS frame, l_orderkey AS row, l_partkey AS p, l_quantity AS q, l_extendedprice AS e, l_shipdate AS sd FROM lineitem),
m AS (SELECT k, frame, CAST(2 * frame + arg_max(p, (row, p)) % 3 AS BIGINT) AS corrected FROM o GROUP BY k, frame), tr AS (SELECT k, frame, max(q) AS value FROM o GROUP BY ALL),
g AS (SELECT k, corrected, arg_max(value, frame) AS value FROM tr JOIN m USING (k, frame) GROUP BY ALL), e AS (SELECT k, max(corrected) AS m FROM g GROUP BY k), sp AS (SELECT k, unnest(range(m + 1)) AS corrected FROM e)
SELECT k, corrected, value FROM sp LEFT JOIN g USING (k, corrected)""")
def _(spark, d):
    li = D.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_linenumber").cast("long").alias("frame"), "l_orderkey", "l_partkey", "l_quantity")
    fmap = li.select("k", F.col("frame").alias("avi"), F.struct("l_orderkey", "l_partkey").alias("row"), (2 * F.col("frame") + F.col("l_partkey") % 3).alias("corrected"))
    return J.align_frames(li.groupBy("k", "frame").agg(F.max("l_quantity").alias("value")), fmap, "k")


@query("j11_map_intervals", """WITH x AS (SELECT l_orderkey AS id, l_suppkey AS session, l_partkey * 10 AS a, l_partkey * 10 + CAST(l_quantity AS BIGINT) AS b FROM lineitem),
n AS (SELECT session, CAST(floor(0.9::DOUBLE * max(b)) AS BIGINT) AS n FROM x GROUP BY ALL),
y AS (SELECT id, x.session, CAST(round_even((a - 50 * (x.session % 3)) * 30000.0::DOUBLE / 20000.0::DOUBLE, 0) AS BIGINT) AS start, least(CAST(round_even((b - 50 * (x.session % 3)) * 30000.0::DOUBLE / 20000.0::DOUBLE, 0) AS BIGINT), CAST(round_even(n * 1.5::DOUBLE, 0) AS BIGINT)) AS "end" FROM x JOIN n USING (session))
SELECT * FROM y WHERE start >= 0 AND "end" > start""")
def _(spark, d):
    iv = D.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_suppkey").alias("session"), (F.col("l_partkey") * 10).alias("start"), (F.col("l_partkey") * 10 + F.col("l_quantity").cast("long")).alias("end"))
    # A recording on the other clock ends a tenth before the last interval does.
    ends = iv.groupBy("session").agg(F.rint(F.floor(0.9 * F.max("end")) * 1.5).cast("long").alias("n_samples"))
    return J.map_intervals(iv, ends.select("session", (50 * (F.col("session") % 3)).alias("anchor_sample"), F.lit(20000.0).alias("fs_from"), F.lit(30000.0).alias("fs_to"), "n_samples"))


@query("j17_resample_linear", S_SQL + """, k AS (SELECT session, channel * 100000 + sample AS t, value FROM samples WHERE value <= 50), g AS (SELECT session, channel * 100000 + sample AS t FROM samples),
j AS (SELECT g.session, g.t, b.t AS bt, b.value AS bv FROM g ASOF LEFT JOIN k b ON g.session = b.session AND g.t >= b.t), h AS (SELECT j.*, a.t AS nt, a.value AS av FROM j ASOF LEFT JOIN k a ON j.session = a.session AND j.t <= a.t)
SELECT session, t, round(CASE WHEN bt IS NULL THEN av WHEN nt IS NULL OR nt = bt THEN bv ELSE bv + (av - bv) * (t - bt) / (nt - bt) END, 6) AS value FROM h""")
def _(spark, d):
    s = D.samples(spark, d).withColumn("t", F.col("channel").cast("long") * 100000 + F.col("sample"))
    return J.resample_linear(s.where("value <= 50").select("session", "t", "value"), s.select("session", "t"), "session").withColumn("value", F.round("value", 6))


@query("j18_within", """WITH e AS (SELECT event_id AS id, epoch_us(ts) / 1000.0::DOUBLE AS tm, event_type FROM events)
SELECT e.id, arg_min(f.id, (abs(e.tm - f.tm), f.id)) AS other FROM e JOIN e f ON abs(e.tm - f.tm) <= 900000 WHERE e.event_type = 'click' AND f.event_type = 'error' GROUP BY ALL""")
def _(spark, d):
    e = D.table(spark, d, "events").select(F.col("event_id").alias("id"), D.micros("ts").alias("t"), "event_type")
    return J.within(e.where("event_type = 'click'").drop("event_type"), e.where("event_type = 'error'").select(F.col("id").alias("other"), "t"), 900_000.0)


@query("j20_neighbours", """WITH c AS (SELECT s_suppkey AS channel, CAST(s_suppkey * 37 % 500 AS DOUBLE) AS x, CAST(s_suppkey * 91 % 500 AS DOUBLE) AS y FROM supplier)
SELECT a.channel, b.channel AS neighbour, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 6) AS distance FROM c a JOIN c b ON a.channel <> b.channel AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) BETWEEN 30 AND 150""")
def _(spark, d):
    c = D.table(spark, d, "supplier").select(F.col("s_suppkey").alias("channel"), (F.col("s_suppkey") * 37 % 500).cast("double").alias("x"), (F.col("s_suppkey") * 91 % 500).cast("double").alias("y"))
    return K.neighbours(c, 30.0, 150.0).withColumn("distance", F.round("distance", 6))


@query("j24_align_to_peak", T_SQL + """, p AS (SELECT trial, arg_min(bin, (-abs(value), bin)) AS peak FROM trials WHERE bin BETWEEN 1 AND 5 AND value IS NOT NULL GROUP BY ALL)
SELECT trial, CAST(bin - peak AS INTEGER) AS rel, value FROM trials JOIN p USING (trial) WHERE bin - peak BETWEEN -2 AND 2""")
def _(spark, d):
    return J.align_to_peak(D.trials(spark, d).select("trial", "bin", "value"), ["trial"], "bin", 1, 5, 2, 2)


@query("j24_align_without_bias", T_SQL + """, b AS (SELECT trial, avg(CASE WHEN bin BETWEEN 1 AND 2 THEN value END) AS bias FROM trials GROUP BY ALL),
v AS (SELECT trial, bin, value - coalesce(bias, 0) AS value FROM trials JOIN b USING (trial)),
p AS (SELECT trial, arg_min(bin, (-abs(value), bin)) AS peak FROM v WHERE bin BETWEEN 1 AND 5 AND value IS NOT NULL GROUP BY ALL)
SELECT trial, CAST(bin - peak AS INTEGER) AS rel, value FROM v JOIN p USING (trial) WHERE bin - peak BETWEEN -2 AND 2""")
def _(spark, d):
    return J.align_to_peak(D.trials(spark, d).select("trial", "bin", "value"), ["trial"], "bin", 1, 5, 2, 2, bias=2)


@query("a3_median_line", T_SQL + """, b AS (SELECT trial, median(value) AS base FROM trials WHERE bin < 3 AND value IS NOT NULL GROUP BY ALL)
SELECT condition, bin, round(median(value - base), 6) AS median, count(value) AS n FROM trials JOIN b USING (trial) GROUP BY ALL""")
def _(spark, d):
    return A.median_line(D.trials(spark, d), ["trial"], ["condition", "bin"], "bin", 1, 3).withColumn("median", F.round("median", 6))


@query("a14_psth", T_SQL + " SELECT condition, bin, round(avg(value), 6) AS rate, count(value) AS n FROM trials GROUP BY ALL")
def _(spark, d):
    return A.psth(D.trials(spark, d), ["condition", "bin"]).withColumn("rate", F.round("rate", 6))


@query("a15_rate_kinematics", T_SQL + """, b AS (SELECT condition, avg(value) AS m, stddev_samp(value) AS sd FROM trials WHERE bin <= 2 GROUP BY ALL)
SELECT condition, round(corr((value - m) / sd, position), 6) AS r, count(*) FILTER (value IS NOT NULL AND position IS NOT NULL) AS n FROM trials JOIN b USING (condition) GROUP BY ALL""")
def _(spark, d):
    return A.rate_kinematics_corr(D.trials(spark, d), ["condition"], "bin", 3).withColumn("r", F.round("r", 6))


@query("a18_snr", T_SQL + """, t AS (SELECT condition, trial, sum(value ** 2) AS p, sum((value - least(value, 40)) ** 2) AS q FROM trials GROUP BY ALL),
s AS (SELECT condition, CASE WHEN q > 0 AND p > 0 THEN 10 * log10(p / q) END AS snr FROM t) SELECT condition, round(median(snr), 6) AS snr, count(snr) AS n FROM s GROUP BY ALL""")
def _(spark, d):
    t = D.trials(spark, d).withColumn("clean", F.least("value", F.lit(40.0)))
    return A.snr(t, ["condition", "trial"], ["condition"], "value", "clean").withColumn("snr", F.round("snr", 6))


@query("a19_bin_mean", S_SQL + """, k AS (SELECT session, channel, max(sample) // 5 + 1 AS n FROM samples GROUP BY ALL), sp AS (SELECT session, channel, unnest(range(n)) AS bin FROM k),
g AS (SELECT session, channel, sample // 5 AS bin, avg(value) AS mean FROM samples GROUP BY ALL) SELECT session, channel, bin, round(mean, 6) AS mean FROM sp LEFT JOIN g USING (session, channel, bin)""")
def _(spark, d):
    return A.bin_mean(D.samples(spark, d), 5, ["session", "channel"]).withColumn("mean", F.round("mean", 6))


@query("w8_common_reference", S_SQL + """, m AS (SELECT session, sample, median(value) AS m FROM samples GROUP BY ALL)
SELECT session, channel, sample, round(value - m, 6) AS value FROM samples JOIN m USING (session, sample)""")
def _(spark, d):
    s = D.samples(spark, d).select("session", "channel", "sample", "value")
    return W.common_reference(s, ["session", "sample"]).select("session", "channel", "sample", F.round("value", 6).alias("value"))


@query("w12_zscore_tracks", T_SQL + """, s AS (SELECT trial, avg(value) AS a, stddev_pop(value) AS sd FROM trials GROUP BY ALL)
SELECT trial, bin, round(CASE WHEN sd > 0 THEN (value - a) / sd END, 6) AS value FROM trials JOIN s USING (trial)""")
def _(spark, d):
    return W.zscore_tracks(D.trials(spark, d).select("trial", "bin", "value"), ["trial"]).select("trial", "bin", F.round("value", 6).alias("value"))


@query("w14_rank_sessions", "SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INTEGER) AS rank FROM orders")
def _(spark, d):
    return W.ranked(D.table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "rank").select("o_custkey", "o_orderkey", "rank")


@query("w15_decimate", S_SQL + """, r AS (SELECT *, row_number() OVER (PARTITION BY session, channel ORDER BY sample) - 1 AS r, count(*) OVER (PARTITION BY session, channel) AS n FROM samples)
SELECT session, channel, sample, value FROM r WHERE r % CAST(ceil(n / 10.0) AS BIGINT) = 0""")
def _(spark, d):
    return W.decimate(D.samples(spark, d).select("session", "channel", "sample", "value"), ["session", "channel"], 10)


@query("w16_screen_trials", T_SQL + """, ok AS (SELECT trial FROM trials GROUP BY ALL HAVING coalesce(max(CASE WHEN bin < 3 THEN abs(value) END), 0) <= 45 AND coalesce(max(CASE WHEN bin >= 3 AND bin < 9 THEN abs(value) END), 0) <= 48)
SELECT trial, bin, value FROM trials WHERE trial IN (SELECT trial FROM ok)""")
def _(spark, d):
    return K.screen_trials(D.trials(spark, d).select("trial", "bin", "value"), ["trial"], "bin", [(1, 3, 45.0), (3, 9, 48.0)])


@query("w16_gradient_screen", T_SQL + """, g AS (SELECT trial, bin, value AS own, lag(value) OVER w AS b, lead(value) OVER w AS a, lag(1) OVER w AS f, lead(1) OVER w AS l FROM trials WINDOW w AS (PARTITION BY trial ORDER BY bin)),
v AS (SELECT trial, bin, CASE WHEN f IS NULL THEN a - own WHEN l IS NULL THEN own - b ELSE (a - b) / 2 END AS value FROM g)
SELECT trial, bin, value FROM v WHERE trial IN (SELECT trial FROM v GROUP BY ALL HAVING coalesce(max(CASE WHEN bin >= 3 AND bin < 9 THEN abs(value) END), 0) <= 20)""")
def _(spark, d):
    v = K.gradient(D.trials(spark, d).select("trial", "bin", "value"), ["trial"], "bin")
    return K.screen_trials(v, ["trial"], "bin", [(3, 9, 20.0)])


@query("w16_trim_without_bias", T_SQL + """, b AS (SELECT trial, avg(CASE WHEN bin BETWEEN 1 AND 3 THEN position END) AS bias, count(*) AS n FROM trials GROUP BY ALL),
s AS (SELECT o_custkey AS customer, min(n) AS n FROM b JOIN orders ON o_orderkey = trial GROUP BY ALL)
SELECT o_custkey AS customer, trial, bin, round(position - coalesce(bias, 0), 6) AS value FROM trials JOIN b USING (trial) JOIN orders ON o_orderkey = trial JOIN s ON s.customer = o_custkey WHERE bin <= s.n""")
def _(spark, d):
    o = D.table(spark, d, "orders").select(F.col("o_orderkey").alias("trial"), F.col("o_custkey").alias("customer"))
    t = D.trials(spark, d).select("trial", "bin", F.col("position").alias("value")).join(o, "trial")
    return K.trim_to_shortest(K.remove_bias(t, ["trial"], "bin", 1, 3), ["trial"], "bin", ["customer"]).select("customer", "trial", "bin", F.round("value", 6).alias("value"))


@query("w16_position_filter", T_SQL + """, b AS (SELECT trial, avg(CASE WHEN bin BETWEEN 1 AND 3 THEN value END) AS bv, avg(CASE WHEN bin BETWEEN 1 AND 3 THEN position / 2000 END) AS bp, max(CASE WHEN bin = 3 THEN value END) AS pv, max(CASE WHEN bin = 3 THEN position / 2000 END) AS pp FROM trials GROUP BY ALL),
k AS (SELECT *, coalesce(abs(pv - CASE WHEN bv < 20 THEN bv ELSE 0 END) < 20 AND abs(pp - CASE WHEN bp < 20 THEN bp ELSE 0 END) < 20, false) AS kept FROM b)
SELECT trial, bin, kept, round(value - CASE WHEN kept THEN bv ELSE 0 END, 6) AS value, round(position / 2000 - CASE WHEN kept THEN bp ELSE 0 END, 6) AS position FROM trials JOIN k USING (trial)""")
def _(spark, d):
    t = D.trials(spark, d).select("trial", "bin", "value", (F.col("position") / 2000).alias("position"))
    kept, removed = K.position_filter(t, ["trial"], "bin", ["value", "position"], 3, 20.0, 2)
    both = kept.withColumn("kept", F.lit(True)).unionByName(removed.withColumn("kept", F.lit(False)))
    return both.withColumns({c: F.round(c, 6) for c in ("value", "position")})


@query("m4_local_template", T_SQL + """, t AS (SELECT condition, trial, bin, value, avg(value) OVER (PARTITION BY condition, bin ORDER BY trial ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS template FROM trials)
SELECT condition, trial, bin, round(template, 6) AS template, round(value - coalesce(template, 0), 6) AS value FROM t""")
def _(spark, d):
    t = W.template_local(D.trials(spark, d).drop("position"), ["condition", "bin"], "trial", 3)
    return t.select("condition", "trial", "bin", F.round("template", 6).alias("template"), F.round("value", 6).alias("value"))


@query("m7_delay_regression", T_SQL + """, x AS (SELECT condition, trial, bin, value AS y, position AS x1, CAST(bin * bin AS DOUBLE) AS x2 FROM trials), l AS (SELECT unnest([-1, 0, 1]) AS lag),
p AS (SELECT a.condition, lag, a.y, b.x1, b.x2 FROM x a, l JOIN x b ON b.trial = a.trial AND b.bin = a.bin + lag),
s AS (SELECT condition, lag, var_pop(x1) aa, covar_pop(x1, x2) ab, var_pop(x2) bb, covar_pop(x1, y) ay, covar_pop(x2, y) yb, var_pop(y) yy FROM p GROUP BY ALL),
f AS (SELECT condition, lag, ((ay * bb - yb * ab) * ay + (yb * aa - ay * ab) * yb) / (aa * bb - ab * ab) / yy AS vaf FROM s WHERE aa * bb - ab * ab > 0 AND yy > 0)
SELECT condition, CAST(arg_max(lag, (round(vaf, 12), -lag)) AS INTEGER) AS lag, round(max(vaf), 6) AS vaf FROM f GROUP BY ALL""")
def _(spark, d):
    x = D.trials(spark, d).select("condition", "trial", "bin", F.col("value").alias("y"), F.col("position").alias("x1"), (F.col("bin") * F.col("bin")).cast("double").alias("x2"))
    return A.delay_regression(x, [-1, 0, 1], ["trial"], ["condition"]).select("condition", "lag", F.round("vaf", 6).alias("vaf"))


@query("s1_encodings", """SELECT CAST(o_orderkey AS VARCHAR) AS br_file, o_orderpriority || ' ' || t AS notes FROM orders, (SELECT unnest(['5 \u20ac', 'd\u00e9j\u00e0', 'x' || chr(129)]) AS t)""")
def _(spark, d):
    o = D.table(spark, d, "orders")
    got = None
    for text, encoding in (("5 \x80", "ISO-8859-1"), ("d\u00e9j\u00e0", "UTF-8"), ("x\u0081", "ISO-8859-1")):
        path = new_path(spark, "encoded")
        o.select(F.col("o_orderkey").alias("BR File"), F.concat_ws(" ", "o_orderpriority", F.lit(text)).alias("Notes")).write.options(header=True, encoding=encoding).csv(path)
        one = T.read_metadata(spark, path)
        got = one if got is None else got.unionByName(one)
    return got


@query("s8_write_aligned", S_SQL + """, c AS (SELECT DISTINCT session, length(session) * 10.0::DOUBLE AS offset_ms FROM samples WHERE session <> 'click')
SELECT session, 'rates' AS source, t_ms, value AS rate_hz, CAST(NULL AS INTEGER) AS unit, t_ms + coalesce(offset_ms, 0) AS t_ms_aligned FROM samples LEFT JOIN c USING (session) WHERE channel < 4
UNION ALL SELECT session, 'peaks', t_ms, NULL, channel, t_ms FROM samples WHERE channel >= 4""")
def _(spark, d):
    s, path = D.samples(spark, d), new_path(spark, "aligned")
    clocks = s.where("session != 'click'").select("session", F.lit("rates").alias("source"), (F.length("session") * 10.0).alias("offset_ms")).distinct()
    T.write_aligned({"rates": s.where("channel < 4").select("session", "t_ms", F.col("value").alias("rate_hz")), "peaks": s.where("channel >= 4").select("session", "t_ms", F.col("channel").alias("unit"))}, path, clocks)
    return spark.read.parquet(path).select("session", "source", "t_ms", "rate_hz", "unit", "t_ms_aligned")


@query("s10_append_manifest", """SELECT o_orderpriority AS condition, count(DISTINCT l_orderkey) AS n_events, count(DISTINCT l_suppkey) AS n_traces, count(DISTINCT l_linenumber) AS length, 'all' AS file, false AS curated FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL
UNION ALL SELECT o_orderpriority, count(DISTINCT l_orderkey), count(DISTINCT l_suppkey), count(DISTINCT l_linenumber), 'kept', true FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity > 10 GROUP BY ALL""")
def _(spark, d):
    path = new_path(spark, "manifest")
    w = D.table(spark, d, "lineitem").join(D.table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    w = w.select(F.col("o_orderpriority").alias("condition"), F.col("l_orderkey").alias("event_id"), F.col("l_suppkey").alias("trace"), F.col("l_linenumber").alias("rel_bin"), "l_quantity")
    T.append_manifest(w, ["condition"], path, "all")
    T.append_manifest(w.where("l_quantity > 10"), ["condition"], path, "kept", curated=True)
    return spark.read.parquet(path)


_PEAKS = """WITH x AS (SELECT l_linestatus AS region, l_suppkey AS channel, l_linenumber - {zero} AS t, CASE WHEN l_suppkey % 9 > 0 THEN l_quantity - 25 END AS value FROM lineitem),
b AS (SELECT region, channel, max({size}) FILTER (value IS NOT NULL AND t {until}) AS peak FROM x GROUP BY ALL),
p AS (SELECT b.region, b.channel, b.peak, CAST(min(t) AS INTEGER) AS peak_t FROM b LEFT JOIN x ON x.region = b.region AND x.channel = b.channel AND x.t {until} AND {size} = b.peak GROUP BY ALL)
SELECT *, CAST(row_number() OVER (PARTITION BY region ORDER BY {order}) AS INTEGER) AS rank FROM p"""


def _traces(spark, d, zero):
    li = D.table(spark, d, "lineitem")
    value = F.when(F.col("l_suppkey") % 9 > 0, F.col("l_quantity") - 25)
    return li.select(F.col("l_linestatus").alias("region"), F.col("l_suppkey").alias("channel"), (F.col("l_linenumber") - zero).cast("int").alias("t"), value.alias("value"))


@query("f13_order_before_event", _PEAKS.format(zero=3, size="value", until="<= 0", order="peak_t NULLS LAST, peak DESC, channel"))
def _(spark, d):
    return K.order_channels(_traces(spark, d, 3), before=True)


@query("f13_order_reversed", _PEAKS.format(zero=3, size="abs(value)", until="< 0", order="peak_t DESC NULLS FIRST, peak, channel DESC"))
def _(spark, d):
    return K.order_channels(_traces(spark, d, 3), mode="abs", before=True, with_zero=False, reverse=True)


@query("f13_order_without_early_rows", _PEAKS.format(zero=0, size="-value", until="IS NOT NULL", order="peak_t NULLS LAST, peak DESC, channel"))
def _(spark, d):
    return K.order_channels(_traces(spark, d, 0), mode="min", before=True)


@query("a4_fallback_window", T_SQL + """, x AS (SELECT condition, trial, bin % 3 AS channel, CASE WHEN condition = '1-URGENT' THEN bin + 100 ELSE bin END AS rel_bin, value FROM trials WHERE condition <> '5-LOW'),
f AS (SELECT condition, trial, channel, avg(value) AS value FROM x WHERE rel_bin BETWEEN 2 AND 6 OR (condition = '1-URGENT' AND rel_bin BETWEEN 101 AND 104) GROUP BY ALL HAVING avg(value) IS NOT NULL),
ok AS (SELECT condition, trial FROM f GROUP BY ALL HAVING count(*) >= 2), big AS (SELECT condition FROM ok GROUP BY ALL HAVING count(*) >= 15)
SELECT condition, trial, CAST(channel AS INTEGER) AS channel, round(value, 6) AS value FROM f WHERE (condition, trial) IN (SELECT condition, trial FROM ok) AND condition IN (SELECT condition FROM big)""")
def _(spark, d):
    moved = F.when(F.col("condition") == "1-URGENT", F.col("bin") + 100).otherwise(F.col("bin"))
    t = D.trials(spark, d).select("condition", "trial", (F.col("bin") % 3).cast("int").alias("channel"), moved.alias("rel_bin"), "value")
    return A.trial_features(t, 2, 6, fallback=(101, 104), skip=("5-LOW",)).select("condition", "trial", "channel", F.round("value", 6).alias("value"))


@query("a5_zscore_whole_trials", "WITH " + D.FEATURES + """, x AS (SELECT trial, channel, CASE WHEN channel = 5 OR (trial % 3 = 0 AND channel = trial % 8) THEN NULL ELSE value END AS value FROM features WHERE NOT (trial % 7 = 0 AND channel = 2)),
s AS (SELECT channel, avg(value) AS m, stddev_pop(value) AS sd FROM x GROUP BY ALL HAVING m IS NOT NULL), ok AS (SELECT trial FROM x GROUP BY ALL HAVING count(DISTINCT CASE WHEN value IS NOT NULL THEN channel END) = (SELECT count(*) FROM s))
SELECT trial, channel, round((value - m) / CASE WHEN sd > 0 THEN sd ELSE 1 END, 5) AS z FROM x JOIN s USING (channel) WHERE value IS NOT NULL AND trial IN (SELECT trial FROM ok)""")
def _(spark, d):
    gone = (F.col("channel") == 5) | ((F.col("trial") % 3 == 0) & (F.col("channel") == F.col("trial") % 8))
    f = D.features(spark, d).where("not (trial % 7 = 0 and channel = 2)").withColumn("value", F.when(~gone, F.col("value")))
    return A.zscore(f, "channel", ["trial"]).select("trial", "channel", F.round("z", 5).alias("z"))


@query("a10_metric_summaries", """WITH x AS (SELECT CASE l_returnflag WHEN 'A' THEN 'catch_pos' WHEN 'R' THEN 'active_like_stim_' || lower(l_linestatus) ELSE 'rest' END AS field, CASE WHEN l_quantity > 3 THEN l_quantity - 25 END AS error, l_extendedprice / 1000 AS peak FROM lineitem)
SELECT field, count(error) AS n_trials, round(avg(error), 6) AS error_mean, round(var_samp(error), 6) AS error_var, round(avg(peak), 6) AS peak_mean, round(var_samp(peak), 6) AS peak_var, round(avg(abs(error)), 6) AS error_abs_mean, round(var_samp(abs(error)), 6) AS error_abs_var,
 CASE WHEN starts_with(field, 'catch_') THEN 'ipsi_catch_summary' WHEN contains(field, 'stim_') THEN 'ipsi_' || split_part(field, 'stim_', 2) || '_summary' END AS summary FROM x GROUP BY ALL""")
def _(spark, d):
    flag = F.col("l_returnflag")
    field = F.when(flag == "A", "catch_pos").when(flag == "R", F.concat(F.lit("active_like_stim_"), F.lower("l_linestatus"))).otherwise("rest")
    x = D.table(spark, d, "lineitem").select(field.alias("field"), F.when(F.col("l_quantity") > 3, F.col("l_quantity") - 25).alias("error"), (F.col("l_extendedprice") / 1000).alias("peak"))
    s = A.summarise_metrics(x, ["error", "peak"], "ipsi")
    return s.select("field", "summary", "n_trials", *(F.round(c, 6).alias(c) for c in s.columns if c.endswith(("_mean", "_var"))))


@query("a16_interval_gaps", """WITH x AS (SELECT event_type AS session, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY event_type ORDER BY ts)) / 1000.0::DOUBLE AS d FROM events), m AS (SELECT session, median(d) AS m FROM x GROUP BY ALL)
SELECT session, round(median(d), 3) AS median, round(stddev_pop(d), 3) AS sd, count(d) AS n, count(CASE WHEN d > 3 * m THEN 1 END) AS gaps, CAST(coalesce(sum(CASE WHEN d > 3 * m THEN CAST(round_even(d / m, 0) AS BIGINT) - 1 END), 0) AS BIGINT) AS lost FROM x JOIN m USING (session) GROUP BY ALL""")
def _(spark, d):
    e = D.table(spark, d, "events").select(F.col("event_type").alias("session"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    return A.interval_stats(e, "session", "t", gap=3.0, per=1000.0).select("session", F.round("median", 3).alias("median"), F.round("sd", 3).alias("sd"), "n", "gaps", "lost")


@query("w1_median_baseline", T_SQL + """, r AS (SELECT *, row_number() OVER (PARTITION BY trial ORDER BY bin) AS r, count(*) OVER (PARTITION BY trial) AS n FROM trials),
b AS (SELECT trial, CASE WHEN bool_or(bin BETWEEN 2 AND 3) THEN median(CASE WHEN bin BETWEEN 2 AND 3 THEN value END) ELSE median(CASE WHEN r <= greatest(1, round_even(n * 0.1, 0)) THEN value END) END AS base FROM r GROUP BY ALL)
SELECT trial, bin, round(value - base, 6) AS value FROM r JOIN b USING (trial)""")
def _(spark, d):
    t = D.trials(spark, d).select("trial", "bin", "value")
    return W.baseline_zero(t, 2, 3, ["trial"], "bin", stat="median", closed=True, missing="tenth").withColumn("value", F.round("value", 6))


@query("w13_catch_trials", """WITH o AS (SELECT o_orderpriority AS condition, o_orderkey AS trial, coalesce(o_orderstatus = 'P', false) AS "catch" FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY condition ORDER BY trial) AS i, row_number() OVER (PARTITION BY condition ORDER BY trial DESC) AS j FROM o WHERE NOT "catch")
SELECT condition, trial, i <= 10 AS "first", j <= 10 AS "last", "catch" FROM r WHERE i <= 10 OR j <= 10 UNION ALL SELECT condition, trial, false, false, true FROM o WHERE o."catch" """)
def _(spark, d):
    o = D.table(spark, d, "orders").select(F.col("o_orderpriority").alias("condition"), F.col("o_orderkey").alias("trial"), F.col("o_orderstatus").alias("kind"))
    return W.adaptation_sets(o, "condition", "trial", catch=F.col("kind") == "P").drop("kind")


@query("w14_first_pulses", """SELECT o_custkey AS block, o_orderkey AS start, o_orderkey = min(o_orderkey) OVER (PARTITION BY o_custkey) AS "first", count(*) OVER (PARTITION BY o_custkey) AS n_pulses FROM orders""")
def _(spark, d):
    return E.mark_first_pulse(D.table(spark, d, "orders").select(F.col("o_custkey").alias("block"), F.col("o_orderkey").alias("start")), ["block"])


@query("w14_session_offsets", S_SQL + """, n AS (SELECT session, count(*) AS n_samples FROM samples GROUP BY ALL)
SELECT session, n_samples, CAST(sum(n_samples) OVER (ORDER BY session) AS BIGINT) AS "end", CAST(sum(n_samples) OVER (ORDER BY session) - n_samples AS BIGINT) AS start FROM n""")
def _(spark, d):
    return W.session_offsets(D.samples(spark, d).groupBy("session").agg(F.count("*").alias("n_samples")), "session")


@query("w15_downsample", S_SQL + " SELECT session, channel, sample, value FROM samples WHERE sample % 7 = 0")
def _(spark, d):
    return W.downsample(D.samples(spark, d).select("session", "channel", "sample", "value"), ["session", "channel"], 7)
