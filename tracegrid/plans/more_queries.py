"""Queries of sources, channel maps, clocks, movement and sets; imported by the registry, which they enter."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import align as J
from ..operators import movement as M
from ..operators import screening as K
from ..operators import stats as A
from ..operators.lineage import new_path
from ..sources import tables as T
from . import adapters as D
from .registry import query

T_SQL = "WITH " + D.TRIALS
S_SQL = "WITH " + D.SAMPLES


@query("s1_s2_metadata", """SELECT CAST(o_orderkey AS VARCHAR) AS br_file, CAST(o_custkey AS VARCHAR) AS video_file, o_orderpriority AS notes_text FROM orders""")
def _(spark, d):
    path = new_path(spark, "metadata")
    o = D.table(spark, d, "orders").select(F.col("o_orderkey").alias(" BR File"), F.col("o_custkey").alias("Video-File "), F.col("o_orderpriority").alias("Notes (text)"))
    o.write.option("header", True).csv(path)
    got = T.read_metadata(spark, path)
    return got.select(T.pick_col(got, ["BR_File"]), T.pick_col(got, ["VideoFile"]), T.pick_col(got, ["Notes_Text"]))


@query("s3_keypoints", """SELECT CAST(s_suppkey AS BIGINT) AS frame, p AS keypoint, a AS axis, CASE WHEN a = 'x' THEN CAST(s_nationkey AS DOUBLE) ELSE round(s_acctbal, 2) END AS value FROM supplier, (SELECT unnest(['hand', 'eye']) AS p), (SELECT unnest(['x', 'y']) AS a)""")
def _(spark, d):
    path = new_path(spark, "keypoints")
    s = D.table(spark, d, "supplier")
    line = F.concat_ws(",", "s_suppkey", *(F.col("s_nationkey").cast("double"), F.round("s_acctbal", 2)) * 2)
    head = [",".join(x) for x in (["scorer"] + ["net"] * 4, ["bodyparts", "hand", "hand", "eye", "eye"], ["coords", "x", "y", "x", "y"])]
    spark.createDataFrame([(h,) for h in head], "value string").coalesce(1).unionByName(s.select(line.alias("value"))).coalesce(1).write.text(path)
    return T.read_keypoints(spark, path)


@query("s4_frame_map", """SELECT l_orderkey * 8 + l_linenumber AS avi, CASE WHEN l_returnflag <> 'R' THEN l_partkey END AS ocr, l_partkey AS corrected FROM lineitem""")
def _(spark, d):
    path = new_path(spark, "frames")
    li = D.table(spark, d, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("AVI_framenum"), F.when(F.col("l_returnflag") == "R", "bad").otherwise(F.col("l_partkey").cast("string")).alias("OCR_framenum"), F.col("l_partkey").cast("double").alias("CORRECTED_framenum"))
    li.write.option("header", True).csv(path)
    return T.read_frame_map(spark, path)


@query("s4_frame_map_check", """SELECT max(avi) AS last, true AS agrees FROM (SELECT l_orderkey * 8 + l_linenumber AS avi FROM lineitem WHERE l_returnflag <> 'R')""")
def _(spark, d):
    li = D.table(spark, d, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("avi"), F.when(F.col("l_returnflag") != "R", F.col("l_partkey")).alias("ocr"), F.col("l_partkey").alias("corrected"))
    return T.frame_map_agrees(li)


@query("s6_signed", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey - 32768 AS value FROM lineitem")
def _(spark, d):
    return D.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", S.unsigned_to_signed(F.col("l_suppkey")).alias("value"))


@query("s7_bundle", S_SQL + " SELECT session, channel, sample, value, 'sync' AS kind FROM samples WHERE channel IN (0, 3) UNION ALL SELECT session, channel, sample, value, 'digital' FROM samples WHERE channel = 7")
def _(spark, d):
    path, s = new_path(spark, "bundle"), D.samples(spark, d).select("session", "channel", "sample", "value")
    T.write_bundle(s, path, [0, 3], s.where("channel = 7"))
    return spark.read.parquet(path).select("session", "channel", "sample", "value", "kind")


@query("s8_rates_checkpoint", S_SQL + " SELECT session, channel, sample AS bin, value AS rate_hz, CAST(NULL AS VARCHAR) AS blank FROM samples")
def _(spark, d):
    path = new_path(spark, "rates")
    T.write_rates(D.samples(spark, d).select("session", "channel", F.col("sample").alias("bin"), F.col("value").alias("rate_hz")), path)
    return T.read_rates(spark, path).select("session", "channel", "bin", "rate_hz", "blank")


@query("s9_export", "SELECT o_orderkey AS id, CAST(o_custkey AS DOUBLE) AS anchor_ms, 30000.0::DOUBLE AS fs FROM orders")
def _(spark, d):
    path = new_path(spark, "export")
    o = D.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.to_json(F.struct(F.col("o_custkey").alias("anchor_ms"), F.lit(30000).alias("fs"))).alias("align_meta"))
    T.export_aligned(o, path)
    return spark.read.schema("id long, anchor_ms double, fs double").json(path)


@query("s10_manifest", T_SQL + " SELECT condition, count(DISTINCT trial) AS n_events, count(DISTINCT value) AS n_traces, count(DISTINCT bin) AS length FROM trials GROUP BY ALL")
def _(spark, d):
    return T.manifest(D.trials(spark, d).select("condition", F.col("trial").alias("event_id"), F.col("value").alias("trace"), F.col("bin").alias("rel_bin")), ["condition"])


@query("s11_impedances", "SELECT CAST(s_nationkey AS INTEGER) AS electrode, arg_max(round(s_acctbal, 1) * CASE WHEN s_acctbal > 5000 THEN 1 ELSE 0.001 END, s_suppkey) AS kohm FROM supplier WHERE s_acctbal > 0 GROUP BY ALL")
def _(spark, d):
    unit = F.when(F.col("s_acctbal") > 5000, "kOhm").otherwise("Ω")
    line = F.concat(F.lit("junk Elec1-"), F.col("s_nationkey"), F.lit("   "), F.format_string("%.1f", F.round("s_acctbal", 1)), F.lit(" "), unit)
    s = D.table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("line_no"), line.alias("value"))
    return T.parse_impedances(s)


@query("s12_session_index", "SELECT strftime(o_orderdate, '%y%m%d') || '_120000' AS session, CAST(row_number() OVER (ORDER BY strftime(o_orderdate, '%y%m%d')) AS INTEGER) AS place FROM (SELECT DISTINCT o_orderdate FROM orders)")
def _(spark, d):
    name = F.concat(F.lit("rec_"), F.date_format(F.col("o_orderdate").cast("date"), "yyMMdd"), F.lit("_120000.rhd"))
    return T.session_index(D.table(spark, d, "orders").select(name.alias("name")))


@query("s12_complete_sets", "SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus IN ('O', 'F') GROUP BY ALL HAVING count(DISTINCT o_orderstatus) = 2)")
def _(spark, d):
    return T.complete_sets(D.table(spark, d, "orders"), "o_custkey", "o_orderstatus", ["O", "F"]).select("o_custkey", "o_orderkey")


@query("f1_reorder_channels", S_SQL + " SELECT session, sample, CAST(7 - channel AS INTEGER) AS channel, value FROM samples")
def _(spark, d):
    order = D.samples(spark, d).select(F.col("channel").alias("device")).distinct().withColumn("place", 7 - F.col("device"))
    return K.reorder_channels(D.samples(spark, d).select("session", "sample", "channel", "value"), order)


@query("f2_electrode_map", """WITH c AS (SELECT s_suppkey AS channel, CASE WHEN s_acctbal > 3000 THEN 'B' ELSE 'A' END AS port FROM supplier), n AS (SELECT *, channel + CASE WHEN port = 'B' THEN 128 ELSE 0 END AS nsp FROM c),
m AS (SELECT n_nationkey * 2 + 1 AS nsp, n_nationkey + 1 AS electrode FROM nation), j AS (SELECT channel, port, nsp, coalesce(electrode, -1) AS electrode FROM n LEFT JOIN m USING (nsp))
SELECT *, format('UAe{:03d}_NSP{:03d}', electrode, nsp) AS name FROM j WHERE electrode >= 0 UNION ALL SELECT *, format('UAe-01_NSP{:03d}', nsp) FROM j WHERE electrode < 0""")
def _(spark, d):
    c = D.table(spark, d, "supplier").select(F.col("s_suppkey").alias("channel"), F.when(F.col("s_acctbal") > 3000, " b").otherwise("A").alias("port"))
    m = D.table(spark, d, "nation").select((F.col("n_nationkey") * 2 + 1).alias("nsp"), (F.col("n_nationkey") + 1).alias("electrode"))
    return K.apply_electrode_map(c, m).select("channel", F.upper(F.trim("port")).alias("port"), "nsp", F.col("electrode").cast("long").alias("electrode"), "name")


@query("f3_region_groups", "SELECT s_suppkey, CASE WHEN s_suppkey <= 0 THEN NULL WHEN s_suppkey <= 128 THEN 'M1i+M1s' WHEN s_suppkey <= 192 THEN 'PMd' ELSE 'SMA' END AS area FROM supplier")
def _(spark, d):
    return D.table(spark, d, "supplier").select("s_suppkey", S.region_group(S.region_code(F.col("s_suppkey"))).alias("area"))


@query("f10_parse_delay", "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 0.0::DOUBLE WHEN 'P' THEN NULL ELSE CAST(o_custkey AS DOUBLE) END AS delay FROM orders")
def _(spark, d):
    text = F.when(F.col("o_orderstatus") == "O", " Random ").when(F.col("o_orderstatus") == "P", "n/a").otherwise(F.concat(F.col("o_custkey").cast("string"), F.lit(" ms")))
    return D.table(spark, d, "orders").select("o_orderkey", S.parse_delay(text).alias("delay"))


@query("f11_anchor_ms", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN CAST(o_custkey AS DOUBLE) ELSE o_custkey * 1000.0::DOUBLE / 30000.0::DOUBLE END AS anchor FROM orders")
def _(spark, d):
    text = F.to_json(F.when(F.col("o_orderstatus") == "O", F.struct(F.col("o_custkey").alias("anchor_ms"), F.lit(None).cast("long").alias("anchor_sample"))).otherwise(F.struct(F.lit(None).cast("long").alias("anchor_ms"), F.col("o_custkey").alias("anchor_sample"))))
    return D.table(spark, d, "orders").select("o_orderkey", S.anchor_ms(text).alias("anchor"))


@query("f12_behaviour_ms", S_SQL + """, f AS (SELECT session, channel * 1000000 + sample AS n, sample * CASE WHEN session = 'click' THEN 300 ELSE 1 END + channel * 1000000 * 0 AS t FROM samples WHERE channel = 0),
r AS (SELECT session, max(t) > 10000 OR coalesce(median(t - b), 0) > 10 AS s FROM (SELECT *, lag(t) OVER (PARTITION BY session ORDER BY n) AS b FROM f) GROUP BY ALL)
SELECT session, n, CASE WHEN s THEN t * 1000.0::DOUBLE / 30000 ELSE t * 1000.0::DOUBLE / 100 END AS ms FROM f JOIN r USING (session)""")
def _(spark, d):
    s = D.samples(spark, d).where("channel = 0").select("session", F.col("sample").alias("n"), (F.col("sample") * F.when(F.col("session") == "click", 300).otherwise(1)).alias("t"))
    return J.behaviour_ms(s, 100.0, 30000.0).select("session", "n", "ms")


@query("f12_joined_segments", """WITH g AS (SELECT l_suppkey AS session, l_linenumber AS segment, max(l_partkey) + 1 AS n FROM lineitem GROUP BY ALL), b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY session ORDER BY segment ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM g)
SELECT l_orderkey AS id, l_suppkey AS session, CAST(l_partkey + base AS BIGINT) AS sample, (l_partkey + base) * (1000.0::DOUBLE / 30000.0::DOUBLE) AS t_ms FROM lineitem JOIN b ON session = l_suppkey AND segment = l_linenumber""")
def _(spark, d):
    p = D.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_suppkey").alias("session"), F.col("l_linenumber").alias("segment"), F.col("l_partkey").alias("sample"))
    seg = p.groupBy("session", "segment").agg((F.max("sample") + 1).alias("n_samples"))
    return J.joined_segments(p, seg, 30000.0).select("id", "session", "sample", "t_ms")


@query("f14_offsets", T_SQL + """, m AS (SELECT condition AS keypoint, bin AS axis, median(value) AS m FROM trials GROUP BY ALL), r AS (SELECT axis, m AS r FROM m WHERE keypoint = '1-URGENT') SELECT keypoint, axis, round(m - r, 6) AS "offset" FROM m LEFT JOIN r USING (axis)""")
def _(spark, d):
    t = D.trials(spark, d).select(F.col("condition").alias("keypoint"), F.col("bin").alias("axis"), "value")
    return K.offset_to_reference(t, "1-URGENT").withColumn("offset", F.round("offset", 6))


@query("f15_channel_groups", """WITH c AS (SELECT s_suppkey AS channel, s_acctbal AS y FROM supplier), st AS (SELECT channel, y FROM c WHERE y BETWEEN 2000 AND 4000), g AS (SELECT l_suppkey AS channel, max(abs(l_extendedprice)) AS most FROM lineitem GROUP BY ALL)
SELECT channel, CASE WHEN channel IN (SELECT channel FROM st) THEN 'stim' WHEN most >= 100000 THEN 'saturated' WHEN y BETWEEN (SELECT min(y) FROM st) - 500 AND (SELECT max(y) FROM st) + 500 THEN 'neighbour' ELSE 'other' END AS kind FROM c LEFT JOIN g USING (channel)""")
def _(spark, d):
    c = D.table(spark, d, "supplier").select(F.col("s_suppkey").alias("channel"), F.col("s_acctbal").alias("y"))
    most = D.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("channel")).agg(F.max(F.abs("l_extendedprice")).alias("most"))
    return K.segment_channels(c, most, c.where("y between 2000 and 4000"), 500.0, 100_000.0)


@query("f18_good_units", "SELECT p_partkey AS unit, count(l_partkey) / 60.0::DOUBLE AS rate FROM part LEFT JOIN lineitem ON l_partkey = p_partkey WHERE p_size > 25 GROUP BY ALL")
def _(spark, d):
    u = D.table(spark, d, "part").select(F.col("p_partkey").alias("unit"), F.when(F.col("p_size") > 25, " Good").otherwise("mua").alias("label"))
    return K.good_units(u, D.table(spark, d, "lineitem").select(F.col("l_partkey").alias("unit")), 60.0)


@query("j7_frames_to_samples", S_SQL + """, f AS (SELECT session, sample AS frame, row_number() OVER (PARTITION BY session ORDER BY sample) AS k FROM samples WHERE channel = 0), e AS (SELECT session, sample, row_number() OVER (PARTITION BY session ORDER BY sample) AS k FROM samples WHERE channel = 1 AND value > 50)
SELECT session, frame, e.sample FROM f LEFT JOIN e USING (session, k)""")
def _(spark, d):
    s = D.samples(spark, d)
    return J.frames_to_samples(s.where("channel = 0").select("session", F.col("sample").alias("frame")), s.where("channel = 1 and value > 50").select("session", "sample"))


@query("j9_join_cameras", S_SQL + """, c AS (SELECT session || '-' || sample AS frame, channel, value FROM samples) SELECT frame, a.value AS cam0_value, b.value AS cam1_value FROM (SELECT * FROM c WHERE channel = 0) a FULL JOIN (SELECT * FROM c WHERE channel = 1) b USING (frame)""")
def _(spark, d):
    c = D.samples(spark, d).select(F.concat_ws("-", "session", "sample").alias("frame"), "channel", "value")
    return J.join_cameras(c.where("channel = 0").drop("channel"), c.where("channel = 1").drop("channel"))


@query("j10_apply_anchor", S_SQL + """, a AS (SELECT session, CASE WHEN session = 'click' THEN 250.0::DOUBLE ELSE count(*) * 1000.0::DOUBLE / 30000.0::DOUBLE END AS anchor FROM samples GROUP BY session) SELECT session, channel, sample, t_ms - anchor AS t_ms FROM samples JOIN a USING (session)""")
def _(spark, d):
    s = D.samples(spark, d)
    shifts = s.groupBy("session").agg(F.count("*").alias("anchor_sample")).select("session", F.when(F.col("session") == "click", 250.0).alias("anchor_ms"), "anchor_sample", F.lit(30000.0).alias("fs"))
    return J.apply_anchor(s.drop("value"), shifts)


@query("j14_mask_around", """WITH s AS (SELECT event_id, epoch_us(ts) / 1000.0::DOUBLE AS t, value FROM events), e AS (SELECT epoch_us(ts) / 1000.0::DOUBLE AS tm FROM events WHERE event_type = 'error')
SELECT event_id, CASE WHEN EXISTS (SELECT 1 FROM e WHERE t BETWEEN tm AND tm + 40000 OR t BETWEEN tm + 300000 AND tm + 340000) THEN NULL ELSE value END AS value FROM s""")
def _(spark, d):
    s = D.table(spark, d, "events").select(F.lit("all").alias("session"), "event_id", D.micros("ts").alias("t_ms"), "value")
    ev = D.table(spark, d, "events").where("event_type = 'error'").select(F.lit("all").alias("session"), D.micros("ts").alias("at"))
    return J.mask_around(s, ev, 300_000.0, 40_000.0).select("event_id", "value")


@query("j14_mask_and_shift", S_SQL + """, m AS (SELECT session, sample AS bin FROM samples WHERE channel = 2 AND value > 80), a AS (SELECT session, sample AS bin, value FROM samples WHERE channel = 0), b AS (SELECT session, sample AS bin, value FROM samples WHERE channel = 1)
SELECT a.session, a.bin, a.value AS a, b.value AS b FROM a JOIN b ON a.session = b.session AND b.bin = a.bin + 3 WHERE (a.session, a.bin) NOT IN (SELECT session, bin FROM m) AND (b.session, b.bin) NOT IN (SELECT session, bin FROM m)""")
def _(spark, d):
    s = D.samples(spark, d).select("session", "channel", F.col("sample").alias("bin"), "value")
    of = lambda c: s.where(F.col("channel") == c).drop("channel")
    return J.mask_and_shift(of(0), of(1), of(2).where("value > 80").select("session", "bin"), 3)


@query("j19_stitch_spikes", """WITH s AS (SELECT l_suppkey AS unit, l_linenumber AS channel, l_orderkey AS sample FROM lineitem), r AS (SELECT o_orderpriority AS file, min(o_orderkey) + 100 AS first, max(o_orderkey) - 200 AS last FROM orders GROUP BY ALL),
d AS (SELECT file, unit, channel, (sample - first) // 30 AS bin FROM s JOIN r ON sample BETWEEN first AND last), m AS (SELECT file, unit, arg_min(channel, (-n, channel)) AS channel FROM (SELECT file, unit, channel, count(*) AS n FROM d GROUP BY ALL) GROUP BY ALL)
SELECT DISTINCT d.file, d.unit, m.channel, d.bin FROM d JOIN m ON d.file = m.file AND d.unit = m.unit""")
def _(spark, d):
    s = D.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("unit"), F.col("l_linenumber").alias("channel"), F.col("l_orderkey").alias("sample"))
    r = D.table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("file")).agg((F.min("o_orderkey") + 100).alias("first"), (F.max("o_orderkey") - 200).alias("last"))
    return J.stitch_spikes(s, r)


@query("j20_nearest_channels", """WITH c AS (SELECT s_suppkey AS channel, CAST(s_suppkey * 37 % 500 AS DOUBLE) AS x, s_acctbal AS y FROM supplier)
SELECT a.channel, b.channel AS neighbour, greatest(abs(a.x - b.x), abs(a.y - b.y)) AS distance FROM c a JOIN c b ON a.channel <> b.channel QUALIFY row_number() OVER (PARTITION BY a.channel ORDER BY distance, b.channel) <= 4""")
def _(spark, d):
    c = D.table(spark, d, "supplier").select(F.col("s_suppkey").alias("channel"), (F.col("s_suppkey") * 37 % 500).cast("double").alias("x"), F.col("s_acctbal").alias("y"))
    return K.nearest_channels(c, 4)


@query("j22_segment_windows", S_SQL + """, g AS (SELECT session, sample AS seg_id, sample * 30 AS start FROM samples WHERE channel = 0 AND value > 85), e AS (SELECT session, seg_id, CAST(round(start / 30.0::DOUBLE) AS BIGINT) AS at_bin FROM g),
w AS (SELECT e.session, seg_id, channel AS trace, sample - at_bin AS rel, value, count(*) OVER (PARTITION BY e.session, seg_id, channel) AS n FROM e JOIN samples s ON s.session = e.session AND sample BETWEEN at_bin - 2 AND at_bin + 3)
SELECT session, seg_id, trace, rel, value FROM w WHERE n = 6""")
def _(spark, d):
    s = D.samples(spark, d)
    seg = s.where("channel = 0 and value > 85").select("session", F.col("sample").alias("seg_id"), (F.col("sample") * 30).alias("start"))
    return M.segment_windows(s.select("session", F.col("channel").alias("trace"), F.col("sample").alias("bin"), "value"), seg, 2, 3, 30)


@query("j23_realign_to_burst", """WITH e AS (SELECT user_id % 4 AS session, event_id, event_type, epoch_us(ts) / 1000.0::DOUBLE AS t FROM events), g AS (SELECT session, event_id AS seg_id, t AS start, t + 2000000 AS "end" FROM e WHERE event_type = 'click'), b AS (SELECT session, t AS b0 FROM e WHERE event_type = 'error')
SELECT g.session, g.seg_id, round(min(b0 - start), 3) AS "first", round(min(CASE WHEN b0 - start > 750000 THEN b0 END) - 800, 3) AS new_start, round(min(CASE WHEN b0 - start > 750000 THEN b0 END) + 1200, 3) AS new_end
FROM g LEFT JOIN b ON b.session = g.session AND b0 + 150000 >= start AND b0 <= "end" GROUP BY ALL""")
def _(spark, d):
    e = D.table(spark, d, "events").select((F.col("user_id") % 4).alias("session"), "event_id", "event_type", D.micros("ts").alias("start"))
    seg = e.where("event_type = 'click'").select("session", F.col("event_id").alias("seg_id"), "start", (F.col("start") + 2_000_000).alias("end"))
    got = M.realign_to_burst(seg, e.where("event_type = 'error'").select("session", "start"), 150_000.0, 750_000.0, 800.0, 1200.0)
    return got.select("session", "seg_id", *(F.round(c, 3).alias(c) for c in ("first", "new_start", "new_end")))


@query("a4_trial_features", T_SQL + """, f AS (SELECT condition, trial, channel, avg(value) AS value FROM (SELECT condition, trial, bin % 3 AS channel, bin, value FROM trials) WHERE bin BETWEEN 2 AND 6 GROUP BY ALL HAVING avg(value) IS NOT NULL),
ok AS (SELECT condition, trial FROM f GROUP BY ALL HAVING count(*) >= 2), big AS (SELECT condition FROM ok GROUP BY ALL HAVING count(*) >= 15) SELECT condition, trial, CAST(channel AS INTEGER) AS channel, round(value, 6) AS value FROM f WHERE (condition, trial) IN (SELECT condition, trial FROM ok) AND condition IN (SELECT condition FROM big)""")
def _(spark, d):
    t = D.trials(spark, d).select("condition", "trial", (F.col("bin") % 3).cast("int").alias("channel"), F.col("bin").alias("rel_bin"), "value")
    return A.trial_features(t, 2, 6).select("condition", "trial", "channel", F.round("value", 6).alias("value"))


@query("a6_rsa_matrix", "WITH " + D.FEATURES + """, t AS (SELECT trial, avg(value) AS m, stddev_pop(value) AS sd, count(*) AS k FROM features GROUP BY ALL HAVING sd > 0),
u AS (SELECT trial, list((value - m) / sd / sqrt(k) ORDER BY channel) AS u FROM features JOIN t USING (trial) GROUP BY ALL) SELECT a.trial AS i, b.trial AS j, round(list_dot_product(a.u, b.u), 6) AS r FROM u a JOIN u b ON a.trial < b.trial""")
def _(spark, d):
    return M.rsa_matrix(D.features(spark, d), digits=6)


@query("a8_baseline_groups", """WITH m AS (SELECT o_orderkey AS id, o_orderstatus AS port, o_custkey AS depth FROM orders WHERE o_orderpriority = '1-URGENT'), l AS (SELECT *, row_number() OVER (PARTITION BY port, depth ORDER BY id) - 1 AS local_index, row_number() OVER (ORDER BY port, depth, id) - 1 AS global_index FROM m)
SELECT id, port, depth, CAST(local_index AS INTEGER) AS local_index, global_index FROM l""")
def _(spark, d):
    o = D.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit(" "), F.lower("o_orderstatus")).alias("port"), F.col("o_custkey").alias("depth"), F.when(F.col("o_orderpriority") == "1-URGENT", " Baseline ").otherwise("stim").alias("note"))
    return M.baseline_groups(o, [F.col("id")]).select("id", "port", "depth", "local_index", "global_index")


_TRACE = T_SQL + """, tr AS (SELECT trial, bin AS i, value AS velocity, position, value - coalesce(lag(value) OVER (PARTITION BY trial ORDER BY bin), 25) AS acceleration FROM trials),
sg AS (SELECT *, sign(acceleration) <> lead(sign(acceleration)) OVER w AS fa, sign(velocity - 0) <> lead(sign(velocity)) OVER w AS fv FROM tr WINDOW w AS (PARTITION BY trial ORDER BY i)),
en AS (SELECT trial, coalesce(min(CASE WHEN i >= 2 AND i < 6 AND fa THEN i END), min(CASE WHEN i >= 2 AND i < 6 AND fv THEN i END)) AS e, max(i) AS l FROM sg GROUP BY ALL)"""


@query("a9_movement_metrics", _TRACE + """ SELECT trial, max(CASE WHEN i = e THEN position END) AS endpoint, round(stddev_samp(CASE WHEN i BETWEEN e AND e + 2 AND e + 2 <= l THEN velocity END), 6) AS end_spread, max(CASE WHEN i BETWEEN 2 AND 5 THEN abs(velocity) END) AS max_speed,
round(avg(CASE WHEN i BETWEEN 2 AND 5 THEN abs(velocity) END), 6) AS avg_speed, round(stddev_samp(CASE WHEN i BETWEEN 2 AND 5 THEN velocity END), 6) AS speed_spread, CAST(sum(CASE WHEN i >= 2 AND fa IS NOT NULL THEN CAST(fa AS INTEGER) WHEN i < 2 THEN 0 END) AS BIGINT) AS oscillations, round(avg(CASE WHEN i BETWEEN 2 AND 5 THEN velocity ** 2 END), 6) AS power
FROM sg JOIN en USING (trial) GROUP BY ALL""")
def _(spark, d):
    from pyspark.sql.window import Window

    t = D.trials(spark, d).select("trial", F.col("bin").alias("i"), F.col("value").alias("velocity"), "position")
    t = t.withColumn("acceleration", F.col("velocity") - F.coalesce(F.lag("velocity").over(Window.partitionBy("trial").orderBy("i")), F.lit(25.0)))
    got = M.movement_metrics(t, ["trial"], (2, 6), 2, (2, 5))
    return got.select("trial", "endpoint", "max_speed", "oscillations", *(F.round(c, 6).alias(c) for c in ("end_spread", "avg_speed", "speed_spread", "power")))


@query("a9_endpoint_errors", """SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END * (o_totalprice - CASE WHEN o_custkey % 2 = 0 THEN 1000.0::DOUBLE ELSE -2000.0::DOUBLE END) AS error FROM orders""")
def _(spark, d):
    o = D.table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_custkey") % 2 == 0, "active_pos").otherwise("active_neg_100").alias("field"), F.col("o_totalprice").alias("endpoint"))
    refs = spark.createDataFrame([("pos", 1000.0), ("neg", -2000.0)], "side string, reference double")
    return M.endpoint_errors(o, refs).select("o_orderkey", "error")


@query("a13_mean_ci", None)
def _(spark, d):
    return M.mean_ci(D.trials(spark, d), ["condition", "bin"])


@query("a13_bootstrap_ci", None)
def _(spark, d):
    return M.bootstrap_ci(D.trials(spark, d), ["condition", "bin"], "trial", 100)


@query("a13_bootstrap_means", "WITH " + D.TRIALS + " SELECT condition, bin, round(avg(value), 6) AS mean, count(value) AS n FROM trials GROUP BY ALL")
def _(spark, d):
    return M.bootstrap_ci(D.trials(spark, d), ["condition", "bin"], "trial", 100).select("condition", "bin", F.round("mean", 6).alias("mean"), "n")


_FILES = """files AS (SELECT 'rec_' || lpad(CAST(o_custkey % 250 AS VARCHAR), 3, '0') || '_' || o_orderstatus || '.ns5' AS path, o_orderkey AS id, CAST(o_orderdate AS DATE) AS mtime, o_totalprice AS size FROM orders)"""


def _files(spark, d):
    name = F.concat(F.lit("rec_"), F.lpad((F.col("o_custkey") % 250).cast("string"), 3, "0"), F.lit("_"), "o_orderstatus", F.lit(".ns5"))
    return D.table(spark, d, "orders").select(F.concat(F.lit("/data.v2/17/"), name).alias("path"), F.col("o_orderdate").cast("date").alias("mtime"), F.col("o_totalprice").alias("size"))


@query("s12_best_file", "WITH " + _FILES + """, n AS (SELECT *, regexp_extract_all(regexp_replace(path, '\\.[^.]*$', ''), '[0-9]+') AS numbers FROM files),
w AS (SELECT s_suppkey AS index, CASE WHEN s_suppkey < 100 THEN lpad(CAST(s_suppkey AS VARCHAR), 3, '0') ELSE CAST(s_suppkey AS VARCHAR) END AS token FROM supplier),
x AS (SELECT index, list_contains(numbers, token) AS strong, path, mtime, size FROM w, n)
SELECT index, '/data.v2/17/' || arg_max(path, (strong, mtime, size, path)) AS path, max(strong) AS strong FROM x GROUP BY index""")
def _(spark, d):
    return T.best_file_per_index(_files(spark, d), D.table(spark, d, "supplier").select(F.col("s_suppkey").alias("index")))


@query("s12_preferred", """SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END,
 CASE o_orderpriority WHEN '3-MEDIUM' THEN 1 WHEN '1-URGENT' THEN 2 WHEN '2-HIGH' THEN 3 ELSE 4 END, o_orderdate DESC, o_orderkey DESC) = 1""")
def _(spark, d):
    o = D.table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderpriority", "o_orderdate")
    return T.preferred(o, ["o_custkey"], [("o_orderstatus", ["F", "O"]), ("o_orderpriority", ["3-MEDIUM", "1-URGENT", "2-HIGH"])], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("o1_top_trials", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3")
def _(spark, d):
    from ..operators import series as W

    o = D.table(spark, d, "orders").withColumn("least", -F.col("o_totalprice"))
    return W.ranked(o, ["o_custkey"], ["least", "o_orderkey"]).where("rank <= 3").select("o_custkey", "o_orderkey")


@query("o2_union", "SELECT 'order' AS source, o_orderkey AS id, o_totalprice AS value, CAST(NULL AS VARCHAR) AS name FROM orders UNION ALL SELECT 'part', p_partkey, p_retailprice, p_name FROM part")
def _(spark, d):
    o = D.table(spark, d, "orders").select(F.lit("order").alias("source"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("value"))
    p = D.table(spark, d, "part").select(F.lit("part").alias("source"), F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("value"), F.col("p_name").alias("name"))
    return o.unionByName(p, allowMissingColumns=True)


@query("o5_distinct", "SELECT DISTINCT l_suppkey, l_linenumber FROM lineitem")
def _(spark, d):
    return D.table(spark, d, "lineitem").select("l_suppkey", "l_linenumber").distinct()


@query("o8_condition_order", """WITH c AS (SELECT o_orderpriority AS trigger, o_orderstatus AS kind, count(*) AS n FROM orders GROUP BY ALL)
SELECT trigger, kind, n, CAST(row_number() OVER (ORDER BY CASE trigger WHEN '5-LOW' THEN 1 WHEN '1-URGENT' THEN 2 ELSE 3 END, n DESC, trigger, kind) AS INTEGER) AS place FROM c""")
def _(spark, d):
    c = D.table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("trigger"), F.col("o_orderstatus").alias("kind")).agg(F.count("*").alias("n"))
    return K.ordered_conditions(c, "trigger", ["5-LOW", "1-URGENT"], [("n", False), ("trigger", True), ("kind", True)])
