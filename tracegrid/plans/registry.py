"""Names the library's queries and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import align as J
from ..operators import events as E
from ..operators import screening as K
from ..operators import series as W
from ..operators import stats as A
from ..operators.lineage import written
from ..sources import tables as T
from . import adapters as D

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        _QUERIES[name] = f
        if sql:
            _ORACLE[name] = sql
        return f

    return keep


_NOISE = D.SAMPLES + """, med AS (SELECT session, channel, median(value) AS med FROM samples GROUP BY ALL),
noise AS (SELECT s.session, s.channel, med, median(abs(value - med)) / 0.6744897501960817::DOUBLE AS noise FROM samples s JOIN med USING (session, channel) GROUP BY ALL)"""
_PEAKS = _NOISE + """, x AS (SELECT s.*, value - med AS x, noise FROM samples s JOIN noise USING (session, channel) WHERE value IS NOT NULL),
y AS (SELECT *, lag(x) OVER w AS b, lead(x) OVER w AS a FROM x WINDOW w AS (PARTITION BY session, channel ORDER BY sample)),
peaks AS (SELECT session, channel, sample, t_ms, value AS amplitude FROM y WHERE x > 1.5::DOUBLE * noise AND (b IS NULL OR x > b) AND (a IS NULL OR x >= a))"""


def _peaks(spark, d):
    return _peaks_of(D.samples(spark, d))


def _peaks_of(samples):
    return written(E.detect_peaks(samples, 1.5, "pos"), "peaks")


def _counts(spark, d):
    s = D.samples(spark, d)
    return written(A.bin_counts(_peaks_of(s), s.groupBy("session", "channel").agg(F.count("*").alias("n_samples")), 4), "counts")


@query("e9_noise", "WITH " + _NOISE + " SELECT session, channel, round(med, 6) AS med, round(noise, 6) AS noise FROM noise")
def _(spark, d):
    return E.noise_levels(D.samples(spark, d)).select("session", "channel", F.round("med", 6).alias("med"), F.round("noise", 6).alias("noise"))


@query("e9_peaks", "WITH " + _PEAKS + " SELECT session, channel, sample, amplitude FROM peaks")
def _(spark, d):
    return _peaks(spark, d).select("session", "channel", "sample", "amplitude")


_COUNTS = _PEAKS + """, rec AS (SELECT session, channel, greatest(CAST(ceil(count(*) / 4.0) AS BIGINT), 1) AS n_bins FROM samples GROUP BY ALL),
spine AS (SELECT session, channel, n_bins, unnest(range(n_bins)) AS bin FROM rec),
hit AS (SELECT p.session, p.channel, least(p.sample // 4, n_bins - 1) AS bin, count(*) AS n FROM peaks p JOIN rec USING (session, channel) GROUP BY ALL),
counts AS (SELECT session, channel, bin, coalesce(n, 0) AS count FROM spine LEFT JOIN hit USING (session, channel, bin))"""


@query("a1_bin_counts", "WITH " + _COUNTS + " SELECT session, channel, bin, count FROM counts")
def _(spark, d):
    return _counts(spark, d)


def _firing(c):
    """Bins in which the first channel of a session has peaks, as events."""
    return c.where("trace = 0 and value > 0").select("session", F.col("bin").alias("event_id"), F.col("bin").alias("at"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Peaks to bins to windows around the bins in which the first channel fires, less their baseline, then medians across events."""
    c = _counts(spark, d).select("session", F.col("channel").alias("trace"), "bin", F.col("count").cast("double").alias("value"))
    ev = _firing(c)
    z = W.baseline_zero(J.peri_event(c, ev, 1, 2), -1, 0, ["session", "event_id", "trace"])
    return A.across_trials(z, ["session", "trace", "rel_bin"]).select("session", "trace", "rel_bin", F.round("median", 6).alias("median"), F.round("variance", 6).alias("variance"), "n")


_PERI = _COUNTS + """, ev AS (SELECT session, bin AS tm FROM counts WHERE channel = 0 AND count > 0),
w AS (SELECT c.session, tm AS event_id, c.channel AS trace, c.bin - tm AS rel_bin, CAST(count AS DOUBLE) AS value, count(*) OVER (PARTITION BY c.session, tm, c.channel) AS n
 FROM counts c JOIN ev ON c.session = ev.session AND c.bin BETWEEN tm - 1 AND tm + 1),
peri AS (SELECT session, event_id, trace, rel_bin, value FROM w WHERE n = 3)"""
_QUERIES["j2_w1_a2_peri_event_medians"] = flagship
_ORACLE["j2_w1_a2_peri_event_medians"] = "WITH " + _PERI + """, z AS (SELECT session, trace, rel_bin, value - avg(CASE WHEN rel_bin < 0 THEN value END) OVER (PARTITION BY session, event_id, trace) AS v FROM peri)
SELECT session, trace, rel_bin, round(median(v), 6) AS median, round(var_pop(v), 6) AS variance, count(v) AS n FROM z GROUP BY ALL"""


@query("j3_window_resampled", "WITH " + _COUNTS + """, ev AS (SELECT session, bin AS tm FROM counts WHERE channel = 0 AND count > 0), span AS (SELECT session, min(bin) lo, max(bin) hi FROM counts GROUP BY ALL),
e AS (SELECT session, tm AS event_id, greatest(tm - 3, lo) i0, least(tm + 4, hi) i1 FROM ev JOIN span USING (session)),
need AS (SELECT session, event_id, k - 3 AS rel_bin, CAST(round_even(i0 + (i1 - i0) * k / 7.0::DOUBLE, 0) AS BIGINT) AS bin FROM (SELECT *, unnest(range(8)) AS k FROM e WHERE i0 <= i1))
SELECT session, event_id, channel AS trace, CAST(rel_bin AS INTEGER) AS rel_bin, CAST(count AS DOUBLE) AS value FROM need JOIN counts USING (session, bin)""")
def _(spark, d):
    c = _counts(spark, d).select("session", F.col("channel").alias("trace"), "bin", F.col("count").cast("double").alias("value"))
    ev = _firing(c)
    return J.window_resampled(c, ev, 3, 4)


@query("e1_rising_edges", "WITH " + D.SAMPLES + """, lim AS (SELECT session, channel, (min(value) + max(value)) / 2 AS lo, max(value) AS mx FROM samples GROUP BY ALL),
l2 AS (SELECT session, channel, lo, (lo + mx) / 2 AS hi FROM lim), s AS (SELECT s.*, CASE WHEN value >= hi THEN 1 WHEN value <= lo THEN 0 END AS st FROM samples s JOIN l2 USING (session, channel) WHERE hi > lo),
t AS (SELECT session, channel, sample, last_value(st IGNORE NULLS) OVER (PARTITION BY session, channel ORDER BY sample) AS state FROM s),
u AS (SELECT *, lag(state) OVER (PARTITION BY session, channel ORDER BY sample) AS b FROM t) SELECT session, channel, sample FROM u WHERE state = 1 AND coalesce(b, 0) = 0""")
def _(spark, d):
    return E.rising_edges_hysteresis(D.samples(spark, d))


@query("e3_falling_edges", "WITH " + D.SAMPLES + """, s AS (SELECT *, CAST(value > 50 AS INTEGER) AS h, lag(CAST(value > 50 AS INTEGER)) OVER (PARTITION BY session, channel ORDER BY sample) AS b FROM samples WHERE value IS NOT NULL)
SELECT session, channel, sample FROM s WHERE h - b = -1""")
def _(spark, d):
    return E.edges(D.samples(spark, d), 50, rising=False)


_BURST = "SELECT session, channel, t_ms FROM (SELECT *, lag(t_ms) OVER (PARTITION BY session, channel ORDER BY t_ms) AS b FROM samples) WHERE b IS NULL OR t_ms - b {} 60000000"


@query("e3_burst_starts", "WITH " + D.SAMPLES + _BURST.format(">").join((" ", "")))
def _(spark, d):
    return E.burst_starts(D.samples(spark, d), 60_000_000)


@query("e4_refractory_consecutive", "WITH " + D.SAMPLES + _BURST.format(">=").join((" ", "")))
def _(spark, d):
    return E.burst_starts(D.samples(spark, d), 60_000_000, inclusive=True)


@query("e4_refractory_greedy", "WITH RECURSIVE " + D.SAMPLES + """, s AS MATERIALIZED (SELECT DISTINCT session, channel, t_ms FROM samples),
nx AS MATERIALIZED (SELECT a.session, a.channel, a.t_ms, b.t_ms AS nxt FROM (SELECT *, t_ms + 60000000::DOUBLE AS lim FROM s) a ASOF JOIN s b ON a.session = b.session AND a.channel = b.channel AND a.lim <= b.t_ms),
k AS (SELECT session, channel, min(t_ms) AS t_ms FROM s GROUP BY ALL UNION ALL SELECT k.session, k.channel, nx.nxt FROM k JOIN nx USING (session, channel, t_ms)) SELECT session, channel, t_ms FROM k""")
def _(spark, d):
    return E.refractory_greedy(D.samples(spark, d), 60_000_000)


def _stim(spark, d):
    v = F.col("value")
    return D.samples(spark, d).withColumn("value", F.when(v > 60, v).when(v < 30, -v).otherwise(0.0))


_PULSES = D.SAMPLES + """, st AS (SELECT session, channel, sample, CASE WHEN value > 60 THEN value WHEN value < 30 THEN -value ELSE 0 END AS value FROM samples),
df AS (SELECT *, value - lag(value) OVER w AS diff, min(CASE WHEN value = 0 THEN sample END) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS e FROM st WINDOW w AS (PARTITION BY session, channel ORDER BY sample)),
fe AS (SELECT session, channel, sample, row_number() OVER (PARTITION BY session, channel ORDER BY sample) AS n FROM df WHERE diff < 0),
re AS (SELECT session, channel, sample, row_number() OVER (PARTITION BY session, channel ORDER BY sample) AS n FROM df WHERE diff > 0),
rz AS (SELECT session, channel, e, row_number() OVER (PARTITION BY session, channel ORDER BY sample) AS n FROM df WHERE diff < 0 AND e IS NOT NULL),
more AS (SELECT session, channel, count(*) FILTER (diff > 0) > count(*) FILTER (diff < 0) AS more FROM df GROUP BY ALL),
beg AS (SELECT fe.* FROM fe JOIN more USING (session, channel) WHERE NOT more UNION ALL SELECT re.* FROM re JOIN more USING (session, channel) WHERE more),
pulses AS (SELECT b.session, b.channel, b.sample AS start, rz.e AS "end", rz.e - b.sample AS size FROM beg b JOIN rz ON b.session = rz.session AND b.channel = rz.channel AND rz.n = b.n + 1 WHERE b.n % 2 = 1)"""


@query("e5_pulses", "WITH " + _PULSES + ' SELECT session, channel, start, "end", size FROM pulses')
def _(spark, d):
    return E.pulses(_stim(spark, d))


@query("e6_pulse_blocks", "WITH " + _PULSES + """, m AS (SELECT session, channel, CAST(floor(median(size)) AS BIGINT) AS m FROM pulses GROUP BY ALL),
g AS (SELECT p.*, CASE WHEN lag(start) OVER w IS NULL OR start - lag(start) OVER w > 5 * m THEN 1 ELSE 0 END AS new FROM pulses p JOIN m USING (session, channel) WINDOW w AS (PARTITION BY session, channel ORDER BY start)),
b AS (SELECT *, CAST(sum(new) OVER (PARTITION BY session, channel ORDER BY start) AS BIGINT) AS block FROM g)
SELECT session, channel, block, min(start) AS start, arg_max("end", start) AS "end", count(*) AS pulses FROM b GROUP BY ALL""")
def _(spark, d):
    return E.pulse_blocks(E.pulses(_stim(spark, d)), factor=5)


@query("e7_stim_channels", "WITH " + D.SAMPLES + """, q AS (SELECT session, channel, (quantile_cont(value, 0.05) + quantile_cont(value, 0.95)) / 2 AS thr FROM samples GROUP BY ALL),
s AS (SELECT s.session, s.channel, CAST(value > thr AS INTEGER) AS h, lag(CAST(value > thr AS INTEGER)) OVER (PARTITION BY s.session, s.channel ORDER BY sample) AS b FROM samples s JOIN q USING (session, channel) WHERE value IS NOT NULL)
SELECT session, channel, count(*) AS n_edges FROM s WHERE h = 1 AND b = 0 GROUP BY ALL HAVING count(*) >= 3""")
def _(spark, d):
    return E.stim_channels(D.samples(spark, d), 0.0, 3)


@query("e8_busiest_channel", "WITH " + D.SAMPLES + """, s AS (SELECT session, channel, round(stddev_pop(value), 9) AS sd FROM samples GROUP BY ALL)
SELECT session, channel, round(sd, 6) AS sd FROM s QUALIFY row_number() OVER (PARTITION BY session ORDER BY sd DESC, channel) = 1""")
def _(spark, d):
    return E.busiest_channel(D.samples(spark, d)).withColumn("sd", F.round("sd", 6))


@query("e10_dedup_peaks", "WITH RECURSIVE " + _PEAKS + """, g AS (SELECT *, CASE WHEN sample - lag(sample) OVER w > 2 OR lag(sample) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM peaks WINDOW w AS (PARTITION BY session, channel ORDER BY sample)),
r AS MATERIALIZED (SELECT session, channel, sample, t_ms, amplitude, sum(new) OVER (PARTITION BY session, channel ORDER BY sample) AS run FROM g),
k AS (SELECT session, channel, run, min(sample) AS c FROM r GROUP BY ALL UNION ALL SELECT k.session, k.channel, k.run, (SELECT min(x.sample) FROM r x WHERE x.session = k.session AND x.channel = k.channel AND x.run = k.run AND x.sample > k.c + 4) FROM k WHERE k.c IS NOT NULL),
a AS (SELECT r.*, max(k.c) AS c FROM r JOIN k ON r.session = k.session AND r.channel = k.channel AND r.run = k.run AND k.c <= r.sample GROUP BY ALL)
SELECT session, channel, sample, t_ms, amplitude FROM a QUALIFY row_number() OVER (PARTITION BY session, channel, run, c ORDER BY -abs(amplitude), sample) = 1""")
def _(spark, d):
    return E.dedup_peaks(_peaks(spark, d), 2, 4)


@query("e11_local_maxima", "WITH " + D.SAMPLES + """, s AS (SELECT session, channel, sample, round(value / 10) AS value FROM samples WHERE value IS NOT NULL),
n AS (SELECT *, lag(value) OVER w AS b, lead(value) OVER w AS a FROM s WINDOW w AS (PARTITION BY session, channel ORDER BY sample)),
g AS (SELECT *, sum(CASE WHEN b IS NULL OR b <> value THEN 1 ELSE 0 END) OVER (PARTITION BY session, channel ORDER BY sample) AS run FROM n),
r AS (SELECT session, channel, run, min(sample) AS lo, max(sample) AS hi, min(value) AS value, bool_or(b < value) AS up, bool_or(a < value) AS down FROM g GROUP BY ALL)
SELECT session, channel, CAST((lo + hi) // 2 AS BIGINT) AS sample, value FROM r WHERE up AND down AND value >= 6""")
def _(spark, d):
    return E.local_maxima(D.samples(spark, d).where("value is not null").withColumn("value", F.round(F.col("value") / 10)), 6)


@query("e2_falling_edges", "WITH " + D.SAMPLES + """, s AS (SELECT session, channel, row_number() OVER (PARTITION BY session, channel ORDER BY sample) - 1 AS sample, value FROM samples WHERE value IS NOT NULL),
m AS (SELECT session, channel, (min(value) + max(value)) / 2 AS mid FROM s GROUP BY ALL),
h AS (SELECT s.session, s.channel, sample, value > mid AS h, lag(value > mid) OVER (PARTITION BY s.session, s.channel ORDER BY sample) AS b FROM s JOIN m USING (session, channel))
SELECT session, channel, CAST(sample AS BIGINT) AS sample FROM h WHERE NOT h AND b""")
def _(spark, d):
    return E.falling_edges(D.samples(spark, d), 1)


@query("e2_falling_edges_debounced", "WITH RECURSIVE " + D.SAMPLES + """, s AS (SELECT session, channel, row_number() OVER (PARTITION BY session, channel ORDER BY sample) - 1 AS sample, value FROM samples WHERE value IS NOT NULL),
m AS (SELECT session, channel, (min(value) + max(value)) / 2 AS mid FROM s GROUP BY ALL),
h AS (SELECT s.session, s.channel, sample, value > mid AS h, lag(value > mid) OVER (PARTITION BY s.session, s.channel ORDER BY sample) AS b FROM s JOIN m USING (session, channel)),
f AS (SELECT session, channel, CAST(sample AS BIGINT) AS sample FROM h WHERE NOT h AND b),
nx AS (SELECT f.session, f.channel, f.sample, (SELECT min(g.sample) FROM f g WHERE g.session = f.session AND g.channel = f.channel AND g.sample >= f.sample + 5) AS nxt FROM f),
k AS (SELECT session, channel, min(sample) AS sample FROM f GROUP BY ALL UNION ALL SELECT k.session, k.channel, nx.nxt FROM k JOIN nx ON nx.session = k.session AND nx.channel = k.channel AND nx.sample = k.sample WHERE nx.nxt IS NOT NULL)
SELECT session, channel, sample FROM k""")
def _(spark, d):
    return E.falling_edges(D.samples(spark, d), 5)


@query("e12_still_periods", "WITH " + D.SAMPLES + """, s AS (SELECT session, channel, sample, CAST(avg(abs(value)) OVER (PARTITION BY session, channel ORDER BY sample ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) <= 50 AS INTEGER) AS still FROM samples),
r AS (SELECT *, sample - sum(still) OVER (PARTITION BY session, channel ORDER BY sample) AS run FROM s)
SELECT session, channel, min(sample) AS start, max(sample) AS "end", count(*) AS n FROM r WHERE still = 1 GROUP BY session, channel, run HAVING count(*) >= 6""")
def _(spark, d):
    return E.still_periods(D.samples(spark, d), 5, 50, 6)


@query("e12_still_windows", "WITH " + D.SAMPLES + """, s AS (SELECT session, channel, sample, CAST(avg(abs(value)) OVER (PARTITION BY session, channel ORDER BY sample ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) <= 50 AS INTEGER) AS still FROM samples),
r AS (SELECT *, sample - sum(still) OVER (PARTITION BY session, channel ORDER BY sample) AS run FROM s),
p AS (SELECT session, channel, min(sample) AS a, max(sample) AS b FROM r WHERE still = 1 GROUP BY session, channel, run HAVING count(*) >= 4),
x AS (SELECT session, channel, unnest(range(a, b - 3, 2)) AS start FROM p) SELECT session, channel, start, start + 4 AS "end" FROM x""")
def _(spark, d):
    return E.still_windows(E.still_periods(D.samples(spark, d), 5, 50, 4), 5, 2)


@query("e13_first_sign_change", "WITH " + D.SAMPLES + """, n AS (SELECT session, channel, count(*) AS n FROM samples GROUP BY ALL), s AS (SELECT s.session, s.channel, sample, sign(value - 50) AS g, lag(sign(value - 50)) OVER (PARTITION BY s.session, s.channel ORDER BY sample) AS b
 FROM samples s JOIN n USING (session, channel) WHERE value IS NOT NULL AND sample BETWEEN n // 4 AND n) SELECT session, channel, min(sample) AS sample FROM s WHERE g <> b GROUP BY ALL""")
def _(spark, d):
    s = D.samples(spark, d)
    n = s.groupBy("session", "channel").agg(F.floor(F.count("*") / 4).alias("lo"), F.count("*").alias("hi"))
    return E.first_sign_change(s.withColumn("value", F.col("value") - 50).join(n, ["session", "channel"]), "lo", "hi")


@query("e14_active_spans", "WITH " + D.SAMPLES + """, m AS (SELECT session, channel, avg(value) AS m FROM samples GROUP BY ALL),
e AS (SELECT s.session, s.channel, sample, CAST(sqrt(avg((value - m) ** 2) OVER (PARTITION BY s.session, s.channel ORDER BY sample ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) > 30 AS INTEGER) AS active FROM samples s JOIN m USING (session, channel)),
r AS (SELECT *, sample - sum(active) OVER (PARTITION BY session, channel ORDER BY sample) AS run FROM e) SELECT session, channel, min(sample) AS start, max(sample) AS "end" FROM r WHERE active = 1 GROUP BY session, channel, run""")
def _(spark, d):
    return E.active_spans(D.samples(spark, d), 5, 30.0)


@query("j1_lookup_last", """SELECT o_custkey AS key, arg_max(o_orderpriority, o_orderkey) AS value FROM orders GROUP BY ALL""")
def _(spark, d):
    o = D.table(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderpriority").alias("value"), F.col("o_orderkey").alias("row"))
    return J.lookup(o.select("key").distinct(), o, "key", "value", "row")


def _stims(spark, d):
    return D.table(spark, d, "events").where("event_type = 'error'").select(F.lit("all").alias("session"), "event_id", D.micros("ts").alias("at"))


def _all_samples(spark, d):
    return D.table(spark, d, "events").select(F.lit("all").alias("session"), (F.col("user_id") % 8).cast("int").alias("channel"), "event_id", D.micros("ts").alias("t_ms"), "value")


@query("j5_raster", """WITH s AS (SELECT event_id AS id, CAST(user_id % 8 AS INTEGER) AS channel, epoch_us(ts) / 1000.0::DOUBLE AS t FROM events), e AS (SELECT event_id, epoch_us(ts) / 1000.0::DOUBLE AS tm FROM events WHERE event_type = 'error')
SELECT 'all' AS session, event_id, channel, round(t - tm, 3) AS rel_ms FROM s JOIN e ON t - tm >= -60000 AND t - tm < 120000""")
def _(spark, d):
    # Whole microseconds, to which times are exact within a quarter; F.round makes a decimal number of each.
    return J.raster(_all_samples(spark, d), _stims(spark, d), 60_000.0, 120_000.0).withColumn("rel_ms", F.rint(F.col("rel_ms") * 1000) / 1000)


@query("j12_blank_intervals", """WITH s AS (SELECT event_id, epoch_us(ts) / 1000.0::DOUBLE AS t, value FROM events), e AS (SELECT epoch_us(ts) / 1000.0::DOUBLE AS tm FROM events WHERE event_type = 'error')
SELECT event_id, CASE WHEN EXISTS (SELECT 1 FROM e WHERE t >= tm - 20000 AND t <= tm + 120000) THEN 0 ELSE value END AS value FROM s""")
def _(spark, d):
    iv = _stims(spark, d).select("session", F.col("at").alias("start"), (F.col("at") + 100_000).alias("end"))
    return J.blank_intervals(_all_samples(spark, d), iv, 20_000.0, 20_000.0, 600_000.0).select("event_id", "value")


@query("j13_blank_bins", "WITH " + _PULSES + """ SELECT DISTINCT session, unnest(range(start // 10, ("end" + 10) // 10)) AS bin FROM pulses WHERE "end" >= start""")
def _(spark, d):
    return J.blank_bins(E.pulses(_stim(spark, d)), 10)


@query("j6_asof_next", """WITH f AS (SELECT event_id AS frame, epoch_us(ts) / 1000.0::DOUBLE AS t FROM events WHERE event_type = 'click'), e AS (SELECT event_id, epoch_us(ts) / 1000.0::DOUBLE AS tm FROM events WHERE event_type = 'error'),
j AS (SELECT event_id, tm, (SELECT min(t) FROM f WHERE t >= tm) AS ft FROM e) SELECT 'all' AS session, event_id, (SELECT min(frame) FROM f WHERE t = ft) AS frame, round(ft - tm, 3) AS late_ms FROM j""")
def _(spark, d):
    f = D.table(spark, d, "events").where("event_type = 'click'").select(F.lit("all").alias("session"), F.col("event_id").alias("frame"), D.micros("ts").alias("t_ms"))
    return J.asof_next(_stims(spark, d), f).withColumn("late_ms", F.round("late_ms", 3))


@query("j21_matched_pairs", """SELECT o_custkey, o_orderstatus, min(o_totalprice) AS low, arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS low_id, max(o_totalprice) AS high, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS high_id FROM orders GROUP BY ALL HAVING count(*) = 2""")
def _(spark, d):
    return J.matched_pairs(D.table(spark, d, "orders").withColumn("id", F.col("o_orderkey")), "o_totalprice", ["o_custkey", "o_orderstatus"])


@query("a2_across_trials", "WITH " + D.TRIALS + " SELECT condition, bin, round(median(value), 6) AS median, round(var_pop(value), 6) AS variance, count(value) AS n FROM trials GROUP BY ALL")
def _(spark, d):
    return A.across_trials(D.trials(spark, d), ["condition", "bin"]).select("condition", "bin", F.round("median", 6).alias("median"), F.round("variance", 6).alias("variance"), "n")


@query("a12_mean_sem", "WITH " + D.TRIALS + " SELECT condition, bin, round(avg(value), 6) AS mean, round(stddev_samp(value) / sqrt(count(value)), 6) AS sem, count(value) AS n FROM trials GROUP BY ALL")
def _(spark, d):
    return A.mean_sem(D.trials(spark, d), ["condition", "bin"]).select("condition", "bin", F.round("mean", 6).alias("mean"), F.round("sem", 6).alias("sem"), "n")


@query("a5_zscore", "WITH " + D.FEATURES + """, s AS (SELECT channel, avg(value) AS m, stddev_pop(value) AS sd FROM features GROUP BY ALL)
SELECT trial, channel, round((value - m) / CASE WHEN sd > 0 THEN sd ELSE 1 END, 5) AS z FROM features JOIN s USING (channel)""")
def _(spark, d):
    return A.zscore(D.features(spark, d), "channel").select("trial", "channel", F.round("z", 5).alias("z"))


@query("a7_rsa_blocks", "WITH " + D.FEATURES + """, t AS (SELECT condition, trial, avg(value) AS m, stddev_pop(value) AS sd, count(*) AS k FROM features GROUP BY ALL HAVING sd > 0),
u AS (SELECT condition, trial, list((value - m) / sd / sqrt(k) ORDER BY channel) AS u FROM features JOIN t USING (condition, trial) GROUP BY ALL)
SELECT a.condition AS i, b.condition AS j, round(avg(list_dot_product(a.u, b.u)), 8) AS similarity, count(*) * (CASE WHEN a.condition = b.condition THEN 2 ELSE 1 END) AS pairs FROM u a JOIN u b ON a.condition < b.condition OR (a.condition = b.condition AND a.trial < b.trial) GROUP BY a.condition, b.condition""")
def _(spark, d):
    return A.rsa_blocks(D.features(spark, d)).withColumn("similarity", F.round("similarity", 8))


@query("a11_ttest")
def _(spark, d):
    o = D.table(spark, d, "orders").select(F.col("o_orderpriority").alias("condition"), F.col("o_totalprice").alias("value"))
    return A.ttest_vs_baseline(o, "1-URGENT")


@query("a11_condition_sets", """WITH o AS (SELECT o_orderkey AS trial, o_totalprice AS value, o_orderpriority AS p, o_orderstatus AS s, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS i, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS j FROM orders),
m AS (SELECT 'catch' AS condition, trial, value FROM o WHERE s = 'P' UNION ALL SELECT 'stim', trial, value FROM o WHERE s <> 'P' UNION ALL SELECT 'urgent', trial, value FROM o WHERE p IN ('1-URGENT', '2-HIGH')
 UNION ALL SELECT p || ' first', trial, value FROM o WHERE i <= 10 UNION ALL SELECT p || ' last', trial, value FROM o WHERE j <= 10),
g AS (SELECT condition, count(value) AS n, avg(value) AS m, var_samp(value) AS v FROM m GROUP BY ALL), b AS (SELECT n AS nb, m AS mb, v AS vb FROM g WHERE condition = 'catch')
SELECT condition, n, n + nb - 2 AS df, round(m, 6) AS mean, round((m - mb) / sqrt(((n - 1) * v + (nb - 1) * vb) / (n + nb - 2) * (1.0::DOUBLE / n + 1.0::DOUBLE / nb)), 6) AS t FROM g, b WHERE condition <> 'catch' AND n > 1 AND nb > 1""")
def _(spark, d):
    o = D.table(spark, d, "orders").select(F.col("o_orderkey").alias("trial"), F.col("o_totalprice").alias("value"), "o_orderpriority", "o_orderstatus", "o_orderdate")
    status = F.col("o_orderstatus")
    sets = A.condition_sets(o, {"catch": status == "P", "stim": status != "P", "urgent": F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")}, ("o_orderpriority", [F.col("o_orderdate"), F.col("trial")], 10))
    return A.ttest_sets(o, sets, "catch").select("condition", "n", "df", F.round("mean", 6).alias("mean"), F.round("t", 6).alias("t"))


@query("a16_interval_stats", """WITH x AS (SELECT event_type, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY event_type ORDER BY ts)) / 1000.0::DOUBLE AS d FROM events)
SELECT event_type AS session, round(median(d), 3) AS median, round(avg(d), 3) AS mean, round(min(d), 3) AS least, round(max(d), 3) AS most, count(d) AS n FROM x GROUP BY ALL""")
def _(spark, d):
    e = D.table(spark, d, "events").select(F.col("event_type").alias("session"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    return A.interval_stats(e, "session", "t", per=1000.0).select("session", *(F.round(c, 3).alias(c) for c in ("median", "mean", "least", "most")), "n")


@query("a10_summaries_rollup", """SELECT l_returnflag AS field, l_linestatus AS side, round(avg(l_quantity), 6) AS mean, round(var_samp(l_quantity), 6) AS variance, count(l_quantity) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
def _(spark, d):
    li = D.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("field"), F.col("l_linestatus").alias("side"), F.col("l_quantity").alias("value"))
    return A.summarise(li, ["field", "side"]).select("field", "side", F.round("mean", 6).alias("mean"), F.round("variance", 6).alias("variance"), "n")


@query("m1_pca")
def _(spark, d):
    return A.pca(D.features(spark, d), 3)[0]


@query("w2_smooth_counts", "WITH " + _COUNTS + """, tk AS (SELECT unnest(range(-4, 5)) AS k), wk AS (SELECT k, exp(-0.5 * k * k) / sum(exp(-0.5 * k * k)) OVER () AS g FROM tk),
mi AS (SELECT c.session, c.channel, bin, count, r.n_bins AS n, k, g, (bin + k + 4 * (r.n_bins - 1)) % greatest(2 * r.n_bins - 2, 1) AS q FROM counts c JOIN rec r ON r.session = c.session AND r.channel = c.channel, wk),
sx AS (SELECT *, CASE WHEN q >= n THEN 2 * n - 2 - q ELSE q END AS src FROM mi), sm AS (SELECT sx.session, sx.channel, sx.bin, any_value(sx.count) AS count, any_value(n) AS n, sum(g * c.count) AS num FROM sx LEFT JOIN counts c ON c.session = sx.session AND c.channel = sx.channel AND c.bin = sx.src GROUP BY sx.session, sx.channel, sx.bin)
SELECT session, channel, bin, count, round((CASE WHEN n < 4 THEN count ELSE num END) * 100.0::DOUBLE, 6) AS rate_hz FROM sm""")
def _(spark, d):
    c = _counts(spark, d)
    return W.smooth_counts(c, 1.0, 10.0, ["session", "channel"]).withColumn("rate_hz", F.round("rate_hz", 6))


@query("w3_interpolate_gaps", "WITH " + D.SAMPLES + """, s AS (SELECT session, channel, sample, CASE WHEN value > 90 THEN NULL ELSE value END AS v FROM samples),
k AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN sample END IGNORE NULLS) OVER w AS bi, last_value(v IGNORE NULLS) OVER w AS bv,
 first_value(CASE WHEN v IS NOT NULL THEN sample END IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ai, first_value(v IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS av FROM s WINDOW w AS (PARTITION BY session, channel ORDER BY sample))
SELECT session, channel, sample, round(CASE WHEN v IS NULL AND ai - bi - 1 <= 2 THEN bv + (av - bv) * (sample - bi) / (ai - bi) ELSE v END, 6) AS value FROM k""")
def _(spark, d):
    s = D.samples(spark, d).select("session", "channel", "sample", F.when(F.col("value") > 90, None).otherwise(F.col("value")).alias("value"))
    return W.interpolate_gaps(s, 2, ["session", "channel"]).withColumn("value", F.round("value", 6))


_FILL = """round(CASE WHEN {c} IS NULL AND a{c}i - b{c}i - 1 <= 6 THEN b{c}v + (a{c}v - b{c}v) * (sample - b{c}i) / (a{c}i - b{c}i) ELSE {c} END, 6) AS {c}"""
_KNOWN = """last_value(CASE WHEN {c} IS NOT NULL THEN sample END IGNORE NULLS) OVER w AS b{c}i, last_value({c} IGNORE NULLS) OVER w AS b{c}v,
 first_value(CASE WHEN {c} IS NOT NULL THEN sample END IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a{c}i, first_value({c} IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a{c}v"""


@query("w4_remove_teleports", "WITH " + D.SAMPLES + """, t AS (SELECT session, channel, sample, exp(value / 10) AS x, value AS y FROM samples),
st AS (SELECT *, row_number() OVER w AS rn, lag(x) OVER w AS lx, lag(y) OVER w AS ly FROM t WINDOW w AS (PARTITION BY session, channel ORDER BY sample)),
sp AS (SELECT *, CASE WHEN rn = 1 AND x IS NOT NULL THEN 0 ELSE sqrt((x - lx) ** 2 + (y - ly) ** 2) END AS step FROM st),
q AS (SELECT session, channel, quantile_cont(step, 0.25) AS q1, median(step) AS md, quantile_cont(step, 0.75) AS q3 FROM sp GROUP BY ALL),
m AS (SELECT session, channel, median(abs(step - md)) + 1e-12 AS mad FROM sp JOIN q USING (session, channel) GROUP BY ALL),
b AS (SELECT sp.*, coalesce(abs(0.6745 * (step - md) / mad) > 6 OR step > q3 + 6 * greatest(q3 - q1, 1), false) AS bad FROM sp JOIN q USING (session, channel) JOIN m USING (session, channel)),
c AS (SELECT *, bad OR coalesce(lag(bad) OVER w, false) OR coalesce(lead(bad) OVER w, false) AS near FROM b WINDOW w AS (PARTITION BY session, channel ORDER BY sample)),
e AS (SELECT session, channel, sample, CASE WHEN NOT near THEN x END AS x, CASE WHEN NOT near THEN y END AS y FROM c),
k AS (SELECT *, """ + _KNOWN.format(c="x") + ", " + _KNOWN.format(c="y") + " FROM e WINDOW w AS (PARTITION BY session, channel ORDER BY sample)) SELECT session, channel, sample, " + _FILL.format(c="x") + ", " + _FILL.format(c="y") + " FROM k")
def _(spark, d):
    s = D.samples(spark, d).select("session", "channel", "sample", F.exp(F.col("value") / 10).alias("x"), F.col("value").alias("y"))
    return W.remove_teleports(s, ["session", "channel"]).withColumns({c: F.round(c, 6) for c in ("x", "y")})


@query("w6_central_velocity", "WITH " + D.TRIALS + """, t AS (SELECT trial, bin, position AS v, lag(position) OVER w AS b, lead(position) OVER w AS a FROM trials WINDOW w AS (PARTITION BY trial ORDER BY bin))
SELECT trial, bin, round(CASE WHEN b IS NULL THEN a - v WHEN a IS NULL THEN v - b ELSE (a - b) / 2 END, 6) AS velocity FROM t""")
def _(spark, d):
    t = D.trials(spark, d).select("trial", "bin", F.col("position").alias("value"))
    return W.central_velocity(t, ["trial"], "bin", 1.0).select("trial", "bin", F.round("velocity", 6).alias("velocity"))


@query("w11_correct_frames", """WITH o AS (SELECT l_suppkey AS k, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity, l_shipdate) AS avi, l_quantity AS dt, l_returnflag <> 'R' AS ok FROM lineitem),
m AS (SELECT *, CASE WHEN ok THEN CAST(round_even(dt / 10 - 1, 0) AS BIGINT) END AS n FROM o),
t AS (SELECT *, coalesce(sum(n) OVER w, 0) AS t, sum(CASE WHEN n > 0 THEN 1 ELSE 0 END) OVER w AS c FROM m WINDOW w AS (PARTITION BY k ORDER BY avi))
SELECT k, avi, n AS n_missing, CAST(t AS BIGINT) AS total_missing, CAST(c AS BIGINT) AS n_chunks_missing, CASE WHEN ok THEN CAST(avi + t AS BIGINT) END AS corrected FROM t""")
def _(spark, d):
    from pyspark.sql.window import Window

    order = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_shipdate")
    text = F.translate(F.col("l_quantity").cast("string"), "0", "o")
    o = D.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), F.row_number().over(order).cast("long").alias("avi"), text.alias("delta_t"), (F.col("l_returnflag") != "R").alias("ok"))
    return W.correct_frames(o, "k").select("k", "avi", "n_missing", "total_missing", "n_chunks_missing", "corrected")


@query("w13_adaptation_sets", """WITH o AS (SELECT o_orderpriority AS condition, o_orderkey AS trial, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS i, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey DESC) AS j FROM orders)
SELECT condition, trial, i <= 10 AS "first", j <= 10 AS "last" FROM o WHERE i <= 10 OR j <= 10""")
def _(spark, d):
    o = D.table(spark, d, "orders").select(F.col("o_orderpriority").alias("condition"), F.col("o_orderkey").alias("trial"))
    return W.adaptation_sets(o, "condition", "trial")


@query("f3_regions", """SELECT s_suppkey, CASE WHEN s_suppkey + 1 <= 0 THEN -1 WHEN s_suppkey + 1 <= 64 THEN 0 WHEN s_suppkey + 1 <= 128 THEN 1 WHEN s_suppkey + 1 <= 192 THEN 2 ELSE 3 END AS region,
format('UAe{:03d}_NSP{:03d}', s_suppkey + 1, s_suppkey % 256) AS name FROM supplier""")
def _(spark, d):
    s = D.table(spark, d, "supplier")
    return s.select("s_suppkey", S.region_code(F.col("s_suppkey") + 1).alias("region"), S.channel_name(F.col("s_suppkey") + 1, F.col("s_suppkey") % 256).alias("name"))


@query("f4_first_int", "SELECT c_custkey, CAST(regexp_extract(c_name, '([0-9]+)', 1) AS BIGINT) AS n FROM customer")
def _(spark, d):
    return D.table(spark, d, "customer").select("c_custkey", S.first_int(F.col("c_name")).alias("n"))


@query("s5_blocks_roundtrip", "WITH " + D.SAMPLES + " SELECT session, channel, sample, value FROM samples")
def _(spark, d):
    return T.explode_blocks(T.to_blocks(D.samples(spark, d), 64))


@query("s12_newest_per_key", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def _(spark, d):
    return T.newest_per_key(D.table(spark, d, "orders"), ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()]).select("o_custkey", "o_orderkey")


@query("o3_intersect", "SELECT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A'")
def _(spark, d):
    k = lambda f: D.table(spark, d, "lineitem").where(F.col("l_returnflag") == f).select(F.col("l_partkey").alias("k"))
    return K.in_both(k("R"), k("A"))


@query("o4_except", "SELECT p_partkey AS k FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45)")
def _(spark, d):
    returned = D.table(spark, d, "lineitem").where("l_returnflag = 'R' and l_quantity > 45").select(F.col("l_partkey").alias("k"))
    return K.removed(D.table(spark, d, "part").select(F.col("p_partkey").alias("k")), returned, ["k"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLE)


from . import more_queries, signal_queries, trial_queries  # noqa: E402, F401  (enter their queries)
