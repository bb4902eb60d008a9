"""Queries of filters, templates and models; imported by the registry, which they enter."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import artifacts as R
from ..operators import filters as L
from ..operators.lineage import written
from . import adapters as D
from .registry import _PULSES, _stim, query

S_SQL = "WITH " + D.SAMPLES
SC = ["session", "channel"]


def _signal(spark, d):
    return D.samples(spark, d).select("session", "channel", "sample", "value")


@query("w5_gaussian_filtfilt")
def _(spark, d):
    return L.gaussian_filtfilt(_signal(spark, d), 1.5, SC).withColumn("value", F.round("value", 6))


@query("w5_gaussian_irregular", S_SQL + """, s AS (SELECT session, channel, t_ms, value FROM samples WHERE value IS NOT NULL),
x AS (SELECT *, lag(t_ms) OVER w AS b, lead(t_ms) OVER w AS a, min(t_ms) OVER k AS lo, max(t_ms) OVER k AS hi FROM s WINDOW w AS (PARTITION BY session, channel ORDER BY t_ms), k AS (PARTITION BY session, channel)),
y AS (SELECT *, least(coalesce((a - b) / 2, a - t_ms, t_ms - b), 2.5 * 3e7) AS w FROM x),
z AS (SELECT i.session, i.channel, i.t_ms, sum(j.w * j.value * exp(-0.5 * ((j.t_ms - i.t_ms) / 3e7) ** 2)
 * (1 + CASE WHEN i.t_ms < i.lo + 2.4 * 3e7 AND j.t_ms - i.t_ms > i.t_ms - i.lo THEN 1 ELSE 0 END + CASE WHEN i.t_ms > i.hi - 2.4 * 3e7 AND j.t_ms - i.t_ms < i.t_ms - i.hi THEN 1 ELSE 0 END)) / (sqrt(2 * pi()) * 3e7) AS value
 FROM y i JOIN y j ON i.session = j.session AND i.channel = j.channel AND j.t_ms BETWEEN i.t_ms - 3e8 AND i.t_ms + 3e8 GROUP BY ALL) SELECT session, channel, t_ms, round(value, 6) AS value FROM z""")
def _(spark, d):
    return L.gaussian_irregular(D.samples(spark, d), 3e7, SC).withColumn("value", F.round("value", 6))


@query("w6_lowpass")
def _(spark, d):
    return L.lowpass(_signal(spark, d), 10.0, 100.0, SC).withColumn("value", F.round("value", 6))


@query("w7_highpass")
def _(spark, d):
    return L.highpass(_signal(spark, d), 300.0, 3000.0, SC).withColumn("value", F.round("value", 6))


@query("w7_bandpass")
def _(spark, d):
    return L.bandpass(_signal(spark, d), 300.0, 1000.0, 3000.0, SC).withColumn("value", F.round("value", 6))


@query("w9_remove_drift")
def _(spark, d):
    return L.remove_drift(_signal(spark, d), 1000.0, SC).withColumn("value", F.round("value", 6))


@query("w8_local_reference", S_SQL + """, n AS (SELECT a.channel, b.channel AS o FROM (SELECT DISTINCT channel FROM samples) a JOIN (SELECT DISTINCT channel FROM samples) b ON abs(a.channel - b.channel) BETWEEN 1 AND 2),
m AS (SELECT s.session, s.sample, n.channel, median(s.value) AS m FROM samples s JOIN n ON s.channel = n.o GROUP BY ALL)
SELECT s.session, s.channel, s.sample, round(value - coalesce(m, 0), 6) AS value FROM samples s LEFT JOIN m USING (session, sample, channel)""")
def _(spark, d):
    s = _signal(spark, d)
    c = s.select("channel").distinct()
    near = c.join(c.withColumnRenamed("channel", "neighbour"), F.abs(F.col("channel") - F.col("neighbour")).between(1, 2))
    return L.local_reference(s, near).withColumn("value", F.round("value", 6))


@query("w10_kernel_rates", S_SQL + """, r AS (SELECT session, channel, (count(*) - 1) // 4 AS l FROM samples GROUP BY ALL), sp AS (SELECT session, channel, unnest(range(l + 1)) AS place FROM r),
k AS (SELECT session, channel, sample FROM samples WHERE value > 80), g AS (SELECT k.session, k.channel, place, sum((9.4352::DOUBLE * 5) ** 2 * ((place * 4 - sample) / 1000.0::DOUBLE) * exp(-9.4352::DOUBLE * 5 * ((place * 4 - sample) / 1000.0::DOUBLE))) AS rate
 FROM k JOIN sp ON k.session = sp.session AND k.channel = sp.channel AND place * 4 >= sample AND place * 4 <= sample + 40 GROUP BY ALL)
SELECT session, channel, place, round(coalesce(rate, 0), 6) AS rate FROM sp LEFT JOIN g USING (session, channel, place)""")
def _(spark, d):
    s = _signal(spark, d)
    rec = s.groupBy(*SC).agg(F.count("*").alias("n_samples"))
    return L.kernel_rates(s.where("value > 80").select(*SC, "sample"), rec, 5.0, 1000.0, 4, SC, 0.04).withColumn("rate", F.round("rate", 6))


def _spike_rates(spark, d, kernel):
    s = _signal(spark, d)
    rec = s.groupBy(*SC).agg(F.count("*").alias("n_samples"))
    return L.convolved_rates(s.where("value > 80").select(*SC, "sample"), rec, kernel, 4, SC).withColumn("rate", F.round("rate", 6))


#: weight(i) of the i-th tap, taps and delay go in between.
_RATES = S_SQL + """, r AS (SELECT session, channel, (count(*) - 1) // 4 AS l FROM samples GROUP BY ALL), sp AS (SELECT session, channel, unnest(range(l + 1)) AS place FROM r), k AS (SELECT session, channel, sample FROM samples WHERE value > 80),
{taps}, g AS (SELECT sp.session, sp.channel, place, sum(w) AS rate FROM sp JOIN k ON k.session = sp.session AND k.channel = sp.channel JOIN taps ON i = place * 4 - sample + {delay} GROUP BY ALL)
SELECT session, channel, place, round(coalesce(rate, 0), 6) AS rate FROM sp LEFT JOIN g USING (session, channel, place)"""


@query("w10_causal_rates", _RATES.format(delay=0, taps="taps AS (SELECT i, (9.4352::DOUBLE * 5) ** 2 * (i / 30000.0::DOUBLE) * exp(-9.4352::DOUBLE * 5 * (i / 30000.0::DOUBLE)) AS w FROM (SELECT unnest(range(60001)) AS i))"))
def _(spark, d):
    return _spike_rates(spark, d, L.causal_kernel(5.0, 30_000.0))


@query("w10_gaussian_rates", _RATES.format(delay=159, taps="""t0 AS (SELECT unnest(range(319)) AS i), t1 AS (SELECT i, exp(-((-6 * 0.0265::DOUBLE + i / 1000.0::DOUBLE) ** 2) / (2 * 0.0265::DOUBLE ** 2)) AS k FROM t0),
taps AS (SELECT i, k / ((SELECT sum(k) - sum(CASE WHEN i IN (0, 318) THEN k ELSE 0 END) / 2 FROM t1) / 1000) AS w FROM t1)"""))
def _(spark, d):
    return _spike_rates(spark, d, L.gaussian_kernel(5.0, 1000.0))


@query("w10_kaiser_rates", _RATES.format(delay=1812, taps="""t0 AS (SELECT unnest(range(3627)) AS i), t1 AS (SELECT i, CASE WHEN i = 1813 THEN 1 ELSE sin(pi() * 0.011::DOUBLE * (i - 1813)) / (pi() * 0.011::DOUBLE * (i - 1813)) END
 * list_sum(list_transform(range(60), lambda k: (pow(0.1102::DOUBLE * 51.3 / 2 * sqrt(greatest(0, 1 - ((i - 1813) / 1813.0::DOUBLE) ** 2)), k) / gamma(k + 1)) ** 2)) AS h FROM t0),
taps AS (SELECT i, h / (SELECT sum(h) FROM t1) * 1000 AS w FROM t1)"""))
def _(spark, d):
    return _spike_rates(spark, d, L.kaiser_kernel(5.0, 6.0, 1000.0))


_ANCHORS = """z AS (SELECT session, channel, sample, coalesce((value - avg(value) OVER w) / stddev_pop(value) OVER w, 0) AS z FROM samples WINDOW w AS (PARTITION BY session, channel)),
t AS (SELECT unnest(range(5)) AS i, unnest([-2, -1, 0, 1, 2]) / sqrt(2.0::DOUBLE) AS t), c AS (SELECT session, channel, z.sample - i AS lag, sum(z * t) AS c FROM z, t GROUP BY ALL),
n AS (SELECT session, channel, lag, round(c / (max(abs(c)) OVER (PARTITION BY session, channel) + 1e-12), 9) AS r FROM c),
p AS (SELECT *, CASE WHEN lag(r) OVER w = r THEN 0 ELSE 1 END AS new FROM n WINDOW w AS (PARTITION BY session, channel ORDER BY lag)),
g AS (SELECT *, sum(new) OVER (PARTITION BY session, channel ORDER BY lag) AS run FROM p), h AS (SELECT session, channel, run, any_value(r) AS r, floor((min(lag) + max(lag)) / 2.0) AS lag FROM g GROUP BY ALL),
e AS (SELECT *, lag(r) OVER w AS b, lead(r) OVER w AS a FROM h WINDOW w AS (PARTITION BY session, channel ORDER BY run)),
anchors AS (SELECT session, channel, CAST(min(lag) AS BIGINT) AS lag, arg_min(r, lag) AS c FROM e WHERE r >= 0.9 AND r > b AND r > a GROUP BY ALL)"""


def _anchors(spark, d):
    return L.template_anchor(_signal(spark, d), np.array([-2.0, -1.0, 0.0, 1.0, 2.0]), SC, 0.9)


@query("j15_template_anchor", S_SQL + ", " + _ANCHORS + " SELECT session, channel, lag, round(c, 6) AS c FROM anchors")
def _(spark, d):
    return _anchors(spark, d).withColumn("c", F.round("c", 6))


@query("j16_refine_anchor", S_SQL + ", " + _ANCHORS + """, ai AS (SELECT session, channel, sample, (value - avg(value) OVER k) / (max(value) OVER k - min(value) OVER k + 1e-12) AS x FROM samples WINDOW k AS (PARTITION BY session, channel)),
ax AS (SELECT *, lead(x) OVER (PARTITION BY session, channel ORDER BY sample) AS x1 FROM ai), bs AS (SELECT session, (channel + 7) % 8 AS channel, sample AS m, x AS y FROM ai),
j AS (SELECT session, channel, m, y, lag AS anchor FROM bs JOIN anchors USING (session, channel)), k AS (SELECT *, unnest(range(-4, 5)) AS n FROM j),
q AS (SELECT *, anchor + (m + n) * 1.25::DOUBLE AS p FROM k), u AS (SELECT q.session, q.channel, anchor, m, n, y, CASE WHEN p = floor(p) THEN x ELSE x + (x1 - x) * (p - floor(p)) END AS u FROM q LEFT JOIN ax ON ax.session = q.session AND ax.channel = q.channel AND ax.sample = floor(p)),
f AS (SELECT session, channel, anchor, n, avg(u) AS mu FROM u WHERE y IS NOT NULL GROUP BY ALL), r AS (SELECT session, channel, anchor, n, round(sqrt(avg((y - coalesce(u, mu)) ** 2)), 9) AS rms FROM u JOIN f USING (session, channel, anchor, n) WHERE mu IS NOT NULL GROUP BY ALL),
o AS (SELECT session, channel, anchor, arg_min(n, (rms, n)) AS best, min(rms) AS rms FROM r GROUP BY ALL), z1 AS (SELECT session, channel, max(sample) AS hi FROM samples GROUP BY ALL)
SELECT session, channel, anchor, CAST(best AS INTEGER) AS best, round(rms, 6) AS rms, CAST(round_even(best * 1.25::DOUBLE, 0) AS BIGINT) AS delta, greatest(0, least(anchor + CAST(round_even(best * 1.25::DOUBLE, 0) AS BIGINT), hi)) AS shift, 1000 * round_even(best * 1.25::DOUBLE, 0) / 30000 AS dt_ms FROM o JOIN z1 USING (session, channel)""")
def _(spark, d):
    s = _signal(spark, d)
    other = s.withColumn("channel", (F.col("channel") + 7) % 8)  # each channel against the next one, of another rate
    got = L.refine_anchor(s, other, _anchors(spark, d).withColumnRenamed("lag", "anchor"), 30_000.0, 24_000.0, 4, SC, both=True)
    return got.withColumn("rms", F.round("rms", 6))


@query("j16_refine_offset", S_SQL + """, a AS (SELECT session, sample, value AS va FROM samples WHERE channel = 0), b AS (SELECT session, sample, value AS vb FROM samples WHERE channel = 1), m AS (SELECT session, avg(va) AS m FROM a GROUP BY ALL),
r AS (SELECT a.session, CAST(k AS INTEGER) AS shift, round(sqrt(avg((va - coalesce(vb, m)) ** 2)), 9) AS rms FROM (SELECT *, unnest(range(-3, 4)) AS k FROM a JOIN m USING (session) WHERE va IS NOT NULL) a LEFT JOIN b ON a.session = b.session AND b.sample = a.sample + k GROUP BY ALL)
SELECT session, arg_min(shift, (rms, shift)) AS shift, round(min(rms), 6) AS rms FROM r GROUP BY ALL""")
def _(spark, d):
    s = _signal(spark, d)
    of = lambda c: s.where(F.col("channel") == c).select("session", "sample", "value")
    return L.refine_offset(of(0), of(1), 3, ["session"]).withColumn("rms", F.round("rms", 6))


def _pulses(spark, d):
    from ..operators import events as E

    p = E.pulses(_stim(spark, d)).where("size >= 0").select(*SC, F.floor(F.col("start") / 20).alias("block"), F.col("start").alias("pulse"), "start", "end")
    return written(p, "pulses")


def _full(spark, d):
    return _signal(spark, d).withColumn("value", F.coalesce("value", F.lit(0.0)))


def _snippets(spark, d):
    return R.pulse_snippets(_full(spark, d), _pulses(spark, d), 1, 1)


_SNIPS = _PULSES + """, sp0 AS (SELECT session, channel, min(sample) AS lo, max(sample) AS hi FROM samples GROUP BY ALL), pa AS (SELECT session, channel, start // 20 AS block, start AS pulse, start - 1 AS a, "end" + 1 AS z FROM pulses WHERE size >= 0),
lg AS (SELECT session, channel, block, max(z - a) AS l FROM pa GROUP BY ALL), pp AS (SELECT pa.* FROM pa JOIN sp0 USING (session, channel) WHERE a >= lo AND z <= hi), nd AS (SELECT session, channel, block, pulse, a, z, unnest(range(l + 1)) AS pos FROM pp JOIN lg USING (session, channel, block)),
snips AS (SELECT nd.session, nd.channel, block, pulse, pos, coalesce(value, 0) AS value FROM nd JOIN samples s ON s.session = nd.session AND s.channel = nd.channel AND s.sample = least(a + pos, z))"""


@query("m2_pulse_snippets", "WITH " + _SNIPS + " SELECT session, channel, block, pulse, pos, value FROM snips")
def _(spark, d):
    return _snippets(spark, d)


@query("m3_remove_artifacts_pca")
def _(spark, d):
    return R.pulse_artifacts(_full(spark, d), _pulses(spark, d), 1, 1).withColumn("value", F.round("value", 6))


@query("m3_clean_signal")
def _(spark, d):
    return R.clean_signal(_full(spark, d), _pulses(spark, d), 1, 1, exclude=1, k=3, tail=1).withColumn("value", F.round("value", 6))


@query("m3_clean_signal_mean", "WITH " + _SNIPS + """, ap AS (SELECT session, channel, start // 20 AS block, start, "end" AS e, lead(start) OVER (PARTITION BY session, channel ORDER BY start) AS nx FROM pulses WHERE size >= 0),
al AS (SELECT ap.*, start - 1 AS a, least(e + 1, hi) AS r FROM ap JOIN lg USING (session, channel, block) JOIN sp0 USING (session, channel) WHERE start - 1 >= lo AND start - 1 + l <= hi),
tp AS (SELECT session, channel, block, pos, avg(value) AS t FROM (SELECT *, dense_rank() OVER (PARTITION BY session, channel, block ORDER BY pulse) AS k FROM snips) WHERE k > 1 GROUP BY ALL),
pt AS (SELECT al.session, al.channel, al.start, a + pos AS sample, t FROM al JOIN tp USING (session, channel, block)),
v AS (SELECT session, channel, sample, coalesce(value, 0) AS x FROM samples),
r0 AS (SELECT al.session, al.channel, r, nx, any_value(x) - coalesce(sum(t), 0) AS v0 FROM al JOIN v ON v.session = al.session AND v.channel = al.channel AND v.sample = r
 LEFT JOIN pt ON pt.session = al.session AND pt.channel = al.channel AND pt.sample = r AND pt.start <= al.start WHERE nx > r GROUP BY al.session, al.channel, al.start, r, nx),
ts AS (SELECT session, channel, sample, sum(t) AS t FROM pt GROUP BY ALL), rs AS (SELECT session, channel, unnest(range(r, nx)) AS sample, r, nx, v0 FROM r0)
SELECT session, channel, sample, round(x - coalesce(t, 0) - coalesce(v0 * (1 - (sample - r) / (nx - r)::DOUBLE), 0), 6) AS value FROM v LEFT JOIN ts USING (session, channel, sample) LEFT JOIN rs USING (session, channel, sample)""")
def _(spark, d):
    return R.clean_signal(_full(spark, d), _pulses(spark, d), 1, 1, exclude=1, k=0, tail=1).withColumn("value", F.round("value", 6))


@query("m3_interpulse_ramp", S_SQL + """, v AS (SELECT session, channel, sample, coalesce(value, 0) AS value FROM samples),
k AS (SELECT session, channel, (sample // 10) * 10 + 2 AS start, (sample // 10) * 10 + 8 AS "end", any_value(sample) AS x FROM v GROUP BY session, channel, sample // 10),
f AS (SELECT k.*, v.value AS v0 FROM k JOIN v ON v.session = k.session AND v.channel = k.channel AND v.sample = k.start)
SELECT v.session, v.channel, v.sample, round(value - coalesce(v0 * (1 - (v.sample - start) / 6.0::DOUBLE), 0), 6) AS value FROM v LEFT JOIN f ON f.session = v.session AND f.channel = v.channel AND v.sample >= start AND v.sample < "end\"""")
def _(spark, d):
    s = _signal(spark, d).withColumn("value", F.coalesce("value", F.lit(0.0)))
    gaps = s.select(*SC, (F.floor(F.col("sample") / 10) * 10 + 2).alias("start"), (F.floor(F.col("sample") / 10) * 10 + 8).alias("end")).distinct()
    return R.interpulse_ramp(s, gaps).withColumn("value", F.round("value", 6))


@query("m4_template_parts", "WITH " + _SNIPS + """, fs AS (SELECT *, pulse = min(pulse) OVER (PARTITION BY session, channel, block) AS is_first FROM snips),
nr AS (SELECT session, channel, is_first, pulse, row_number() OVER (PARTITION BY session, channel, is_first ORDER BY pulse) AS n FROM (SELECT DISTINCT session, channel, is_first, pulse FROM fs)),
t AS (SELECT fs.*, CASE WHEN is_first THEN avg(value) OVER (w RANGE BETWEEN 3 PRECEDING AND 1 PRECEDING) ELSE avg(value) OVER (w RANGE BETWEEN 4 PRECEDING AND 1 PRECEDING) END AS base
 FROM fs JOIN nr USING (session, channel, is_first, pulse) WINDOW w AS (PARTITION BY session, channel, is_first, pos ORDER BY n)),
e AS (SELECT session, channel, block, pulse, arg_min(base, pos) AS b0, arg_max(base, pos) AS b1, max(pos) AS l FROM t WHERE base IS NOT NULL GROUP BY ALL),
r AS (SELECT t.*, coalesce((base - b0) - (b1 - b0) * pos / greatest(l, 1)::DOUBLE, 0) AS tpl FROM t LEFT JOIN e USING (session, channel, block, pulse))
SELECT session, channel, block, pulse, pos, is_first, round(tpl, 6) AS template, round(value - tpl, 6) AS value FROM r""")
def _(spark, d):
    got = R.pulse_template_parts(_full(spark, d), _pulses(spark, d), 1, 1, 4)
    return got.withColumns({c: F.round(c, 6) for c in ("template", "value")})


@query("a17_template_rmse", "WITH " + D.TRIALS + """, s AS (SELECT condition AS session, CAST(trial % 4 AS INTEGER) AS channel, bin AS pos, avg(value) AS value FROM trials GROUP BY ALL),
n AS (SELECT a.channel, b.channel AS o FROM (SELECT DISTINCT channel FROM s) a JOIN (SELECT DISTINCT channel FROM s) b ON a.channel <> b.channel), m AS (SELECT n.channel, session, pos, avg(value) AS m FROM s JOIN n ON s.channel = n.o GROUP BY ALL)
SELECT session, channel, round(sqrt(avg((value - m) ** 2)), 6) AS rmse FROM s JOIN m USING (session, channel, pos) GROUP BY ALL""")
def _(spark, d):
    s = D.trials(spark, d).groupBy(F.col("condition").alias("session"), (F.col("trial") % 4).cast("int").alias("channel"), F.col("bin").alias("pos")).agg(F.avg("value").alias("value")).withColumns({"block": F.lit(0), "pulse": F.lit(0)})
    c = s.select("channel").distinct()
    near = c.join(c.withColumnRenamed("channel", "neighbour"), F.col("channel") != F.col("neighbour"))
    return R.template_rmse(s, near).select("session", "channel", F.round("rmse", 6).alias("rmse"))


def _wide(spark, d):
    from ..operators import models as Q

    v = Q.vectors(D.features(spark, d), ["trial"])
    return v.select("trial", *(F.get("x", F.lit(i)).alias(f"c{i}") for i in range(64)))


@query("m5_reduced_rank_regression")
def _(spark, d):
    return R.reduced_rank_regression(_wide(spark, d), [f"c{i}" for i in range(32)], [f"c{i}" for i in range(32, 64)], list(range(1, 20)))


@query("m6_factor_loadings")
def _(spark, d):
    return R.factor_loadings(_wide(spark, d), [f"c{i}" for i in range(64)])


def _groups(spark, d):
    from ..operators import models as Q

    return Q.factor_groups(Q.vectors(D.features(spark, d), ["condition", "trial"]), ["condition"], "trial")


@query("m6_factor_groups")
def _(spark, d):
    return _groups(spark, d)[0]


@query("m6_factor_scores")
def _(spark, d):
    return _groups(spark, d)[1]


@query("w7_notch")
def _(spark, d):
    return L.notch(_signal(spark, d), 1000.0, SC).withColumn("value", F.round("value", 6))
