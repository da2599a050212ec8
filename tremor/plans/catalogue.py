"""Registered queries of the modal-analysis operators and, where SQL can say it, the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tremor.functions import modal
from tremor.operators import geometry, identify, merge, signals, spectral, stabil
from tremor.sources import panel
from tremor.scratch import written
from tremor.streaming import monitor

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

REFS = (0, 1)
TAPS = (0.1, 0.2, 0.4, 0.2, 0.1)
ORDERS = range(4, 21, 2)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    """Rounded values, so that another order of summation gives the same; -0 becomes 0."""
    return df.withColumns({n: F.round(F.col(n), digits) + F.lit(0.0) for n in names}).drop("setup")


def _rounds(digits: int, **columns: str) -> str:
    return ", ".join(f"round({e}, {digits}) + 0.0 AS {n}" for n, e in columns.items())


# --- signals ---------------------------------------------------------------------------------------

PANEL = """
names AS (SELECT (row_number() OVER (ORDER BY name) - 1)::INT AS channel, name FROM (SELECT DISTINCT event_type AS name FROM events WHERE event_type IS NOT NULL)),
hourly AS (SELECT epoch_us(ts) // 3600000000 AS hour, event_type AS name, sum(value) AS y FROM events WHERE event_type IS NOT NULL GROUP BY ALL),
span AS (SELECT min(hour) // 24 * 24 AS origin, ((max(hour) // 24 + 1) * 24 - min(hour) // 24 * 24)::INT AS h FROM hourly),
sums AS (SELECT (hour - origin)::INT AS n, name, y FROM hourly, span),
panel AS (SELECT s.n, channel, coalesce(y, 0.0) AS y FROM (SELECT unnest(range(h))::INT AS n FROM span) s CROSS JOIN names LEFT JOIN sums USING (n, name)),
centred AS (SELECT n, channel, y - avg(y) OVER (PARTITION BY channel) AS y FROM panel)
"""
H = "(SELECT h FROM span)"


def _centred(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.correct_offset(panel.hourly_events(spark, sf_dir))


@query(f"WITH {PANEL} SELECT n, channel, {_rounds(4, y='y')} FROM panel")
def panel_hourly(spark, sf_dir):
    return rounded(panel.hourly_events(spark, sf_dir), 4, "y")


@query(f"SELECT vec_id::INT AS n, i::INT AS channel, {_rounds(6, y='embedding[i + 1]::DOUBLE')} FROM (SELECT vec_id, embedding, unnest(range(len(embedding))) AS i FROM embeddings)")
def panel_embeddings(spark, sf_dir):
    return rounded(panel.embedding_channels(spark, sf_dir), 6, "y")


@query(f"WITH {PANEL} SELECT channel, {_rounds(2, power='avg(y * y)', rms='sqrt(avg(y * y))')} FROM panel GROUP BY channel")
def signal_power_rms(spark, sf_dir):
    return rounded(signals.power_and_rms(panel.hourly_events(spark, sf_dir)), 2, "power", "rms")


@query(f"WITH {PANEL} SELECT n, channel, {_rounds(4, y='y')} FROM centred")
def offset_correct(spark, sf_dir):
    return rounded(_centred(spark, sf_dir), 4, "y")


@query(f"WITH {PANEL} SELECT channel, {_rounds(4, factor='quantile_cont(y, 0.95) - quantile_cont(y, 0.05)')} FROM panel GROUP BY channel")
def scale_iqr(spark, sf_dir):
    return rounded(signals.scale_factors(panel.hourly_events(spark, sf_dir)), 4, "factor")


@query(f"WITH {PANEL}, f AS (SELECT channel, max(y) - min(y) AS factor FROM centred GROUP BY channel) SELECT n, channel, {_rounds(6, y='y / factor')} FROM centred JOIN f USING (channel)")
def scale_range(spark, sf_dir):
    return rounded(signals.precondition(panel.hourly_events(spark, sf_dir), "range"), 6, "y")


@query(f"WITH {PANEL} SELECT n, channel, {_rounds(4, y='sum(y) OVER (PARTITION BY channel ORDER BY n ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) / 5')} FROM panel")
def moving_average(spark, sf_dir):
    return rounded(signals.moving_average(panel.hourly_events(spark, sf_dir), 5), 4, "y")


_FIR = f"taps AS (SELECT * FROM (VALUES {', '.join(f'({i}, {t})' for i, t in enumerate(TAPS))}) v(lag, tap)), filtered AS (SELECT a.n, a.channel, sum(b.y * tap) AS y FROM panel a JOIN taps ON true JOIN panel b ON b.channel = a.channel AND b.n = a.n - lag GROUP BY ALL)"


@query(f"WITH {PANEL}, {_FIR} SELECT n, channel, {_rounds(4, y='y')} FROM filtered")
def fir_taps(spark, sf_dir):
    return rounded(signals.fir(panel.hourly_events(spark, sf_dir), list(TAPS)), 4, "y")


@query(f"WITH {PANEL}, {_FIR} SELECT (n // 7)::INT AS n, channel, {_rounds(4, y='7 * y')} FROM filtered WHERE n % 7 = 0 AND n < {H} // 7 * 7")
def decimate(spark, sf_dir):
    return rounded(signals.decimate(signals.fir(panel.hourly_events(spark, sf_dir), list(TAPS)), 7), 4, "y")


@query(f"WITH {PANEL} SELECT n, (dense_rank() OVER (ORDER BY channel) - 1)::INT AS channel, channel AS old, {_rounds(4, y='y')} FROM panel WHERE channel NOT IN (1, 3)")
def channel_delete_renumber(spark, sf_dir):
    return rounded(signals.delete_channels(panel.hourly_events(spark, sf_dir), [1, 3]), 4, "y")


@query()
def filter_zero_phase(spark, sf_dir):
    return rounded(signals.filter_lowpass(_centred(spark, sf_dir), 0.25, 4, "cheby1"), 6, "y")


# --- correlation and spectra -----------------------------------------------------------------------


def _corr_sql(length: str, blocks: int, lags: int) -> str:
    return f"""
blocks AS (SELECT n // ({length}) AS block, n % ({length}) AS n, channel, y FROM centred WHERE n < ({length}) * {blocks}),
corr AS (
  SELECT a.block, a.channel, b.channel AS ref, (a.n - b.n)::INT AS lag, sum(a.y * b.y) / (({length}) - (a.n - b.n)) AS r
  FROM blocks a JOIN blocks b ON a.block = b.block AND b.channel IN {REFS} AND a.n - b.n BETWEEN 0 AND {lags - 1}
  GROUP BY a.block, a.channel, b.channel, a.n - b.n)
"""


_HOURLY_CORR = f"WITH {PANEL}, {_corr_sql(H, 1, 6)} SELECT channel, ref, lag, {_rounds(2, r='r')} FROM corr"


@query(_HOURLY_CORR)
def corr_bt(spark, sf_dir):
    return rounded(spectral.corr_bt(_centred(spark, sf_dir), REFS, 6, panel.hours(spark, sf_dir)).drop("block"), 2, "r")


@query(_HOURLY_CORR)
def corr_bt_chunked(spark, sf_dir):
    return rounded(spectral.corr_bt_chunked(_centred(spark, sf_dir), REFS, 6, panel.hours(spark, sf_dir), chunk=128), 2, "r")


@query(f"WITH {PANEL}, {_corr_sql(H + ' // 4', 4, 6)} SELECT channel, ref, lag, {_rounds(1, r='avg(r)', var_r='var_pop(r)')} FROM corr GROUP BY channel, ref, lag")
def corr_bt_blocks(spark, sf_dir):
    return rounded(spectral.over_blocks(spectral.corr_bt(_centred(spark, sf_dir), REFS, 6, panel.hours(spark, sf_dir) // 4, 4)), 1, "r", "var_r")


LINES = 24  # hours of a segment; the panel has whole days, so no hour is left over
SEGMENTS = f"({H} // {LINES})"
_WELCH = f"""
seg AS (SELECT n // {LINES} AS block, n % {LINES} AS n, channel, y - avg(y) OVER (PARTITION BY channel, n // {LINES}) AS y FROM centred WHERE n < {LINES} * {SEGMENTS}),
tap AS (SELECT block, n, channel, y * (0.54 - 0.46 * cos(2 * pi() * n / {LINES})) AS y FROM seg),
four AS (
  SELECT block, channel, k, sum(y * cos(2 * pi() * ((k * n) % {LINES}) / {LINES})) AS re, -sum(y * sin(2 * pi() * ((k * n) % {LINES}) / {LINES})) AS im
  FROM tap, (SELECT unnest(range({LINES // 2 + 1}))::INT AS k) GROUP BY block, channel, k),
scale AS (SELECT {SEGMENTS} * {LINES} / (2 * sum((0.54 - 0.46 * cos(2 * pi() * n / {LINES})) ** 2)) AS s FROM (SELECT unnest(range({LINES})) AS n)),
psd AS (
  SELECT a.channel, b.channel AS ref, a.k, avg(CASE WHEN a.k IN (0, {LINES // 2}) THEN s / 2 ELSE s END * (a.re * b.re + a.im * b.im)) AS re,
         avg(CASE WHEN a.k IN (0, {LINES // 2}) THEN s / 2 ELSE s END * (a.re * b.im - a.im * b.re)) AS im
  FROM four a JOIN four b ON a.block = b.block AND a.k = b.k AND b.channel IN {REFS}, scale GROUP BY a.channel, b.channel, a.k)
"""
LONG = 48  # hours of a longer segment: two days; of an odd number of days the last one is a segment of its own with zeros after it
_LONG_WELCH = f"""
seg AS (SELECT n // {LONG} AS block, n % {LONG} AS n, channel, count(*) OVER w AS size, y - avg(y) OVER w AS y FROM centred WINDOW w AS (PARTITION BY channel, n // {LONG})),
tap AS (SELECT block, size, n, channel, y * (0.54 - 0.46 * cos(2 * pi() * n / size)) AS y FROM seg),
four AS (
  SELECT block, size, channel, k, sum(y * cos(2 * pi() * ((k * n) % {LONG}) / {LONG})) AS re, -sum(y * sin(2 * pi() * ((k * n) % {LONG}) / {LONG})) AS im
  FROM tap, (SELECT unnest(range({LONG // 2 + 1}))::INT AS k) GROUP BY block, size, channel, k),
scale AS (SELECT {H} AS h, {H} * {LONG} / (2 * sum((0.54 - 0.46 * cos(2 * pi() * n / {LONG})) ** 2)) AS s FROM (SELECT unnest(range({LONG})) AS n)),
parts AS (
  SELECT a.channel, b.channel AS ref, a.k, a.size / h AS share, CASE WHEN a.k IN (0, {LONG // 2}) THEN s / 2 ELSE s END / a.size * (a.re * b.re + a.im * b.im) AS re,
         CASE WHEN a.k IN (0, {LONG // 2}) THEN s / 2 ELSE s END / a.size * (a.re * b.im - a.im * b.re) AS im
  FROM four a JOIN four b ON a.block = b.block AND a.k = b.k AND b.channel IN {REFS}, scale),
psd AS (SELECT channel, ref, k, sum(share * re) AS re, sum(share * im) AS im FROM parts GROUP BY channel, ref, k)
"""
_LONG_WELCH_SQL = f"WITH {PANEL}, {_LONG_WELCH} SELECT channel, ref, k, {_rounds(0, re='re', im='im')} FROM psd"


def _segments(spark: SparkSession, sf_dir: str) -> int:
    return panel.hours(spark, sf_dir) // LINES


def _long_welch(spark: SparkSession, sf_dir: str, fft: bool = True, by_segment: bool = False) -> DataFrame:
    hours = panel.hours(spark, sf_dir)
    return spectral.psd_welch(_centred(spark, sf_dir), REFS, LONG, -(-hours // LONG), fft, by_segment, last=hours % LONG)


@query(_LONG_WELCH_SQL)
def psd_welch(spark, sf_dir):
    return rounded(_long_welch(spark, sf_dir, fft=False), 0, "re", "im")


@query(_LONG_WELCH_SQL)
def psd_welch_fft(spark, sf_dir):
    return rounded(_long_welch(spark, sf_dir), 0, "re", "im")


def _cfp(lines: int) -> str:
    return f"CASE WHEN k IN (0, {lines // 2}) THEN 1 ELSE 2 END * (re * cos(2 * pi() * ((k * lag) % {lines}) / {lines}) - CASE WHEN k IN (0, {lines // 2}) THEN 0 ELSE im END * sin(2 * pi() * ((k * lag) % {lines}) / {lines}))"


_CFP = _cfp(LINES)


@query(f"WITH {PANEL}, {_LONG_WELCH} SELECT channel, ref, lag, {_rounds(1, r=f'sum({_cfp(LONG)}) / {LONG * LONG}')} FROM psd, (SELECT unnest(range({LONG // 2 + 1}))::INT AS lag) GROUP BY channel, ref, lag")
def corr_from_psd(spark, sf_dir):
    return rounded(spectral.corr_from_psd(_long_welch(spark, sf_dir, fft=False), LONG // 2 + 1), 1, "r")


@query()
def sv_psd(spark, sf_dir):
    return spectral.sv_psd(spectral.psd_welch(_centred(spark, sf_dir), range(5), LINES, _segments(spark, sf_dir))).select("k", F.transform("sigma", lambda s: F.round(s, 0)).alias("sigma"))


@query(
    f"""WITH {PANEL}, {_corr_sql(H, 1, 16)},
w AS (SELECT i, 0.54 - 0.46 * cos(2 * pi() * i / 16) AS w FROM (SELECT unnest(range(16)) AS i)),
lw AS (SELECT b.i - a.i AS lag, sum(a.w * b.w) / 16 AS lw FROM w a JOIN w b ON b.i >= a.i GROUP BY b.i - a.i),
s AS (SELECT 2 * {H} * 16 / sum(w) AS s FROM w)
SELECT channel, ref, k, {_rounds(0, s='any_value(s.s) * sum(CASE WHEN lag = 0 THEN 1 ELSE 2 END * lw * r * cos(2 * pi() * ((k * lag) % 32) / 32))')}
FROM corr JOIN lw USING (lag), s, (SELECT unnest(range(17))::INT AS k) GROUP BY channel, ref, k"""
)
def psd_bt(spark, sf_dir):
    return rounded(spectral.psd_bt(spectral.corr_bt(_centred(spark, sf_dir), REFS, 16, panel.hours(spark, sf_dir)), 16, panel.hours(spark, sf_dir)), 0, "s")


_HALF = "r * exp(lag * ln(0.001) / 16)"


@query(
    f"""WITH {PANEL}, {_corr_sql(H, 1, 16)}
SELECT channel, ref, k, {_rounds(1, re=f'sum({_HALF} * cos(2 * pi() * ((k * lag) % 16) / 16))', im=f'-sum({_HALF} * sin(2 * pi() * ((k * lag) % 16) / 16))')}
FROM corr, (SELECT unnest(range(9))::INT AS k) GROUP BY channel, ref, k"""
)
def half_spectra(spark, sf_dir):
    return rounded(spectral.half_spectra(spectral.corr_bt(_centred(spark, sf_dir), REFS, 16, panel.hours(spark, sf_dir)), 16), 1, "re", "im")


# --- modal functions and stabilisation on the poles of every day -----------------------------------

DAY = 24
POLES_SQL = f"""{PANEL},
days AS (SELECT n // {DAY} AS o, n % {DAY} AS n, channel, y FROM centred),
meet AS (
  SELECT a.o, b.channel AS c, a.channel AS j, sum(a.y * b.y) FILTER (a.n = b.n) AS r0, sum(a.y * b.y) FILTER (a.n = b.n + 1) AS r1, sum(a.y * b.y) FILTER (a.n = b.n + 2) AS r2
  FROM days a JOIN days b ON a.o = b.o AND a.n BETWEEN b.n AND b.n + 2 GROUP BY ALL),
recursion AS (SELECT o, c, r0 AS power, r1 * (r0 - r2) / (r0 * r0 - r1 * r1) AS a1, (r0 * r2 - r1 * r1) / (r0 * r0 - r1 * r1) AS a2 FROM meet WHERE j = c AND r0 * r0 - r1 * r1 > 0),
roots AS (SELECT o, c, power, a1 / 2 AS lam_re, sqrt(-a1 * a1 - 4 * a2) / 2 AS lam_im FROM recursion WHERE a1 * a1 + 4 * a2 < 0),
waves AS (
  SELECT o, c, lam_re, lam_im, ln(lam_re ** 2 + lam_im ** 2) / 2 AS size, atan2(lam_im, lam_re) AS turn,
         list(r0 / power ORDER BY j) AS phi_re, list((r0 / power * lam_re - r1 / power) / lam_im ORDER BY j) AS phi_im
  FROM roots JOIN meet USING (o, c) GROUP BY o, c, lam_re, lam_im),
scalars AS (SELECT (o + 2)::INT AS ord, c, sqrt(size * size + turn * turn) / (2 * pi()) AS f, -100 * size / sqrt(size * size + turn * turn) AS d, lam_re, lam_im, phi_re, phi_im FROM waves),
poles AS (SELECT ord, (row_number() OVER (PARTITION BY ord ORDER BY f, c) - 1)::INT AS idx, f, d, lam_re, lam_im, phi_re, phi_im FROM scalars)
"""


def _poles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Poles of every day of the event panel; days stand for orders."""
    return written(identify.ar_poles(_centred(spark, sf_dir), DAY, 1.0).drop("method"), "poles")


def _mac_sql(a: str, b: str) -> str:
    p = lambda x, y: f"list_dot_product({x}::DOUBLE[], {y}::DOUBLE[])"
    ar, ai, br, bi = f"{a}.phi_re", f"{a}.phi_im", f"{b}.phi_re", f"{b}.phi_im"
    return f"((({p(ar, br)} + {p(ai, bi)}) ** 2 + ({p(ai, br)} - {p(ar, bi)}) ** 2) / (({p(ar, ar)} + {p(ai, ai)}) * ({p(br, br)} + {p(bi, bi)})))"


_XX, _YY, _XY = ("list_dot_product(phi_re::DOUBLE[], phi_re::DOUBLE[])", "list_dot_product(phi_im::DOUBLE[], phi_im::DOUBLE[])", "list_dot_product(phi_re::DOUBLE[], phi_im::DOUBLE[])")
_MPC = f"((({_XX} - {_YY}) ** 2 + 4 * {_XY} ** 2) / ({_XX} + {_YY}) ** 2)"
_PHASE = f"(degrees(0.5 * atan2(2 * {_XY}, {_XX} - {_YY})))"
_SIZE = "sqrt(phi_re[j] ** 2 + phi_im[j] ** 2)"
_OFF = f"CASE WHEN {_SIZE} > 0 THEN {_SIZE} * acos(least(1.0, abs(phi_re[j] * cos(radians(mp)) + phi_im[j] * sin(radians(mp))) / {_SIZE})) ELSE 0 END"
_MPD = f"degrees(list_sum(list_transform(range(1, len(phi_re) + 1), lambda j: {_OFF})) / list_sum(list_transform(range(1, len(phi_re) + 1), lambda j: {_SIZE})))"
_SHAPES = f"shapes AS (SELECT *, {_MPC} AS mpc, CASE WHEN {_PHASE} < 0 THEN {_PHASE} + 180 ELSE {_PHASE} END AS mp FROM poles), criteria AS (SELECT *, {_MPD} AS mpd FROM shapes)"


@query(f"WITH {POLES_SQL} SELECT a.idx AS idx_a, b.idx AS idx_b, {_rounds(8, mac=_mac_sql('a', 'b'))} FROM poles a, poles b WHERE a.ord = 13 AND b.ord = 12")
def mac_matrix(spark, sf_dir):
    p = _poles(spark, sf_dir)
    a, b = p.where("ord = 13").alias("a"), F.broadcast(p.where("ord = 12").alias("b"))
    same = modal.mac(F.col("a.phi_re"), F.col("a.phi_im"), F.col("b.phi_re"), F.col("b.phi_im"))
    return a.crossJoin(b).select(F.col("a.idx").alias("idx_a"), F.col("b.idx").alias("idx_b"), (F.round(same, 8) + 0.0).alias("mac"))


@query(f"WITH {POLES_SQL}, {_SHAPES} SELECT ord, idx, {_rounds(6, mpc='mpc', mp='mp', mpd='mpd')} FROM criteria")
def shape_criteria(spark, sf_dir):
    re, im = F.col("phi_re"), F.col("phi_im")
    return rounded(_poles(spark, sf_dir).select("ord", "idx", modal.mpc(re, im).alias("mpc"), modal.mean_phase(re, im).alias("mp"), modal.mpd(re, im).alias("mpd")), 6, "mpc", "mp", "mpd")


_ARG, _LOG = "abs(atan2(lam_im, lam_re))", "(0.5 * ln(lam_re ** 2 + lam_im ** 2))"


@query(f"WITH {POLES_SQL} SELECT ord, idx, {_rounds(6, f=f'100 * sqrt({_ARG} ** 2 + {_LOG} ** 2) / (2 * pi())', d=f'100 * abs({_LOG}) / sqrt({_ARG} ** 2 + {_LOG} ** 2)')} FROM poles")
def modal_scalars(spark, sf_dir):
    re, im = F.col("lam_re"), F.col("lam_im")
    return rounded(_poles(spark, sf_dir).select("ord", "idx", modal.frequency(re, im, F.lit(100.0)).alias("f"), modal.damping(re, im).alias("d")), 6, "f", "d")


_PAIRS = f"""
prev AS (SELECT ord, lag(ord) OVER (ORDER BY ord) AS prev FROM (SELECT DISTINCT ord FROM poles)),
pairs AS (
  SELECT c.ord, c.idx, p.ord AS prev_ord, p.idx AS prev_idx,
    sqrt((c.lam_re - p.lam_re) ** 2 + (c.lam_im - p.lam_im) ** 2) / greatest(sqrt(c.lam_re ** 2 + c.lam_im ** 2), sqrt(p.lam_re ** 2 + p.lam_im ** 2)) AS d_lambda,
    abs(c.f - p.f) / greatest(abs(c.f), abs(p.f)) AS d_f, abs(c.d - p.d) / greatest(abs(c.d), abs(p.d)) AS d_d, 1 - {_mac_sql("c", "p")} AS d_mac,
    coalesce(abs(c.mpd - p.mpd) / nullif(greatest(abs(c.mpd), abs(p.mpd)), 0), 0) AS d_mpd, coalesce(abs(c.mp - p.mp) / nullif(greatest(abs(c.mp), abs(p.mp)), 0), 0) AS d_mp
  FROM criteria c JOIN prev USING (ord) JOIN criteria p ON p.ord = prev.prev)
"""


@query(f"WITH {POLES_SQL}, {_SHAPES}, {_PAIRS} SELECT ord, idx, prev_ord, prev_idx, {_rounds(7, d_lambda='d_lambda', d_f='d_f', d_d='d_d', d_mac='d_mac', d_mpd='d_mpd', d_mp='d_mp')} FROM pairs")
def pole_pairs(spark, sf_dir):
    return rounded(stabil.pole_pairs(_poles(spark, sf_dir)), 7, "d_lambda", "d_f", "d_d", "d_mac", "d_mpd", "d_mp")


_LIMITS = (0.3, 0.5, 0.7)
_OK = {"f": f"d_f > 0 AND d_f <= {_LIMITS[0]}", "d": f"d_d > 0 AND d_d <= {_LIMITS[1]}", "m": f"d_mac > 0 AND d_mac <= {_LIMITS[2]}"}


@query(
    f"""WITH {POLES_SQL}, {_SHAPES}, {_PAIRS},
met AS (SELECT ord, idx, bool_or({" AND ".join(_OK.values())}) AS a, bool_or({_OK["f"]}) AS x, bool_or({_OK["d"]}) AS y, bool_or({_OK["m"]}) AS z FROM pairs GROUP BY ord, idx),
j AS (SELECT ord, idx, d BETWEEN 0 AND 80 AND mpc >= 0.1 AND mpd <= 60 AND f > 0 AS in_range, coalesce(a, false) AS a, coalesce(x, false) AS x, coalesce(y, false) AS y, coalesce(z, false) AS z
      FROM criteria LEFT JOIN met USING (ord, idx))
SELECT ord, idx, in_range, in_range AND a AS stable, in_range AND NOT x AND y AND z AS only_f, in_range AND x AND NOT y AND z AS only_d, in_range AND x AND y AND NOT z AS only_mac FROM j"""
)
def stable_masks(spark, sf_dir):
    return stabil.masks(_poles(spark, sf_dir), *_LIMITS, (0.0, 80.0), 0.1, 60.0).drop("setup")


@query(f"WITH {POLES_SQL}, {_SHAPES}, {_PAIRS}, least AS (SELECT min(d_f) AS x FROM pairs GROUP BY ord, idx) SELECT floor(x * 50 / 0.5)::INT AS bin, count(*) AS n FROM least WHERE x < 0.5 GROUP BY 1")
def criteria_histogram(spark, sf_dir):
    return stabil.histogram(stabil.pole_pairs(_poles(spark, sf_dir)), "d_f", 50, 0.5)


# --- merging and geometry --------------------------------------------------------------------------


def _modes(spark: SparkSession, sf_dir: str, order: int) -> DataFrame:
    return _poles(spark, sf_dir).where(F.col("ord") == order).select(F.col("idx").alias("mode"), "f", "phi_re", "phi_im")


@query(f"WITH {POLES_SQL} SELECT a.idx AS mode_a, b.idx AS mode_b, {_rounds(8, d_f='abs(a.f - b.f) / greatest(a.f, b.f)', mac=_mac_sql('a', 'b'))} FROM poles a, poles b WHERE a.ord = 13 AND b.ord = 5 AND abs(a.f - b.f) / greatest(a.f, b.f) < 0.6 AND {_mac_sql('a', 'b')} > 0.1")
def pair_candidates(spark, sf_dir):
    return rounded(merge.pair_candidates(_modes(spark, sf_dir, 13), _modes(spark, sf_dir, 5), 0.6, 0.1), 8, "d_f", "mac")


def greedy_sql(candidates: str) -> str:
    """One-to-one pairs of a table (mode_a, mode_b, d_f, mac): row after row in order of distance, where both modes are free."""
    return f"""
ranked AS (SELECT *, row_number() OVER (ORDER BY d_f, mac DESC, mode_a, mode_b) AS place FROM {candidates}),
taken AS (
  SELECT 0::BIGINT AS place, []::INT[] AS a, []::INT[] AS b, NULL::INT AS mode_a, NULL::INT AS mode_b, NULL::DOUBLE AS d_f, NULL::DOUBLE AS mac
  UNION ALL
  SELECT r.place, CASE WHEN free THEN list_append(a, r.mode_a) ELSE a END, CASE WHEN free THEN list_append(b, r.mode_b) ELSE b END,
         CASE WHEN free THEN r.mode_a END, CASE WHEN free THEN r.mode_b END, r.d_f, r.mac
  FROM (SELECT t.a, t.b, r.*, NOT list_contains(t.a, r.mode_a) AND NOT list_contains(t.b, r.mode_b) AS free FROM taken t JOIN ranked r ON r.place = t.place + 1) r)
"""


_CANDIDATES = f"candidates AS (SELECT a.idx AS mode_a, b.idx AS mode_b, (abs(a.f - b.f) / greatest(a.f, b.f))::DOUBLE AS d_f, {_mac_sql('a', 'b')} AS mac FROM poles a, poles b WHERE a.ord = 13 AND b.ord = 5 AND abs(a.f - b.f) / greatest(a.f, b.f) < 0.6 AND {_mac_sql('a', 'b')} > 0.1)"


@query(f"WITH RECURSIVE {POLES_SQL}, {_CANDIDATES}, {greedy_sql('candidates')} SELECT mode_a, mode_b, {_rounds(8, d_f='d_f', mac='mac')} FROM taken WHERE mode_a IS NOT NULL")
def mode_pairs(spark, sf_dir):
    return rounded(merge.pairs(merge.pair_candidates(_modes(spark, sf_dir, 13), _modes(spark, sf_dir, 5), 0.6, 0.1)), 8, "d_f", "mac")


@query(f"WITH {POLES_SQL} SELECT idx AS mode, {_rounds(8, mean_f='avg(f)', std_f='stddev_pop(f)', mean_d='avg(d)', std_d='stddev_pop(d)')} FROM poles GROUP BY idx")
def merged_statistics(spark, sf_dir):
    rows = _poles(spark, sf_dir).select(F.col("ord").alias("setup"), F.col("idx").alias("mode"), "f", "d")
    return rounded(merge.merged_statistics(rows), 8, "mean_f", "std_f", "mean_d", "std_d")


# Suppliers are measured points: a nation is a setup, its suppliers are channels in the order of their keys; points that every nation has are common.
_DOFS_SQL = "dofs AS (SELECT setup, channel, 'p' || channel AS node, 90.0 * (channel % 2) AS azimuth, 0.0 AS elevation FROM (SELECT 's' || s_nationkey AS setup, (row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1)::INT AS channel FROM supplier))"
_COMMON_SQL = "common AS (SELECT node, azimuth, elevation FROM dofs GROUP BY ALL HAVING count(DISTINCT setup) = (SELECT count(DISTINCT setup) FROM dofs))"
# Where three channels of the panel stand and which way they look.
_RIG = [("events", 0, "a", 0.0, 0.0), ("events", 1, "b", 90.0, 0.0), ("events", 2, "c", 0.0, 90.0)]


def _dofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")) - 1
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.concat(F.lit("s"), "s_nationkey").alias("setup"), place.cast("int").alias("channel"))
    return rows.selectExpr("setup", "channel", "concat('p', channel) AS node", "double(90 * (channel % 2)) AS azimuth", "double(0) AS elevation")


def _rig(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_RIG, "setup string, channel int, node string, azimuth double, elevation double")


@query(f"WITH {_DOFS_SQL}, {_COMMON_SQL} SELECT node, azimuth::DOUBLE AS azimuth, elevation::DOUBLE AS elevation FROM common")
def common_dofs(spark, sf_dir):
    return merge.common_dofs(_dofs(spark, sf_dir))


@query(f"WITH {_DOFS_SQL}, {_COMMON_SQL} SELECT setup, channel, node, azimuth::DOUBLE AS azimuth, elevation::DOUBLE AS elevation FROM dofs ANTI JOIN common USING (node, azimuth, elevation)")
def roving_channels(spark, sf_dir):
    return merge.rovings(_dofs(spark, sf_dir)).select("setup", "channel", "node", "azimuth", "elevation")


_NODES = [("a", 0.0, 0.0, 0.0), ("b", 1.0, 0.0, 0.0), ("c", 1.0, 1.0, 0.0), ("d", 0.0, 1.0, 2.0)]
# Suppliers are nodes too, and lines join each with the next one of its nation.
_GRID_SQL = """
nodes AS (SELECT 'p' || s_suppkey AS node, (s_suppkey % 10)::DOUBLE AS x, (s_suppkey // 10 % 10)::DOUBLE AS y, (s_acctbal / 1000)::DOUBLE AS z, s_suppkey AS key FROM supplier),
lines AS (SELECT 'p' || before AS start, 'p' || s_suppkey AS stop, s_suppkey AS key FROM (SELECT s_suppkey, lag(s_suppkey) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS before FROM supplier) WHERE before IS NOT NULL)
"""


def _grid(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(node, x, y, z, key; start, stop, key)."""
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    nodes = rows.selectExpr("concat('p', s_suppkey) AS node", "double(s_suppkey % 10) AS x", "double(s_suppkey div 10 % 10) AS y", "double(s_acctbal / 1000) AS z", "s_suppkey AS key")
    before = F.lag("s_suppkey").over(Window.partitionBy("s_nationkey").orderBy("s_suppkey"))
    lines = rows.withColumn("before", before).where("before IS NOT NULL").selectExpr("concat('p', before) AS start", "concat('p', s_suppkey) AS stop", "s_suppkey AS key")
    return nodes, lines


@query(f"WITH {_GRID_SQL}, gone AS (SELECT node FROM nodes WHERE key % 7 = 0) SELECT start, stop FROM lines WHERE start NOT IN (FROM gone) AND stop NOT IN (FROM gone)")
def geometry_cascade(spark, sf_dir):
    nodes, lines = _grid(spark, sf_dir)
    return geometry.without_nodes(lines.select("start", "stop"), nodes.where("key % 7 = 0").select("node"))


def _moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    shapes = _poles(spark, sf_dir).where("ord = 13").select(F.col("idx").alias("mode"), F.posexplode(F.arrays_zip("phi_re", "phi_im")).alias("channel", "v")).select("mode", "channel", F.col("v.phi_re").alias("re"), F.col("v.phi_im").alias("im"))
    return geometry.displacements(_rig(spark).select("channel", "node", "azimuth", "elevation"), shapes)


_MOVES_SQL = f"{POLES_SQL}, moves AS (SELECT idx AS mode, node, axis, CASE WHEN axis = own THEN phi_re[ch + 1] ELSE 0 END AS re, CASE WHEN axis = own THEN phi_im[ch + 1] ELSE 0 END AS im FROM poles, (VALUES ('a', 0, 'x'), ('b', 1, 'y'), ('c', 2, 'z')) v(node, ch, own), (VALUES ('x'), ('y'), ('z')) w(axis) WHERE ord = 13)"


@query(f"WITH {_MOVES_SQL} SELECT mode, node, axis, {_rounds(6, re='re::DOUBLE', im='im::DOUBLE')} FROM moves")
def node_displacement(spark, sf_dir):
    return rounded(_moves(spark, sf_dir), 6, "re", "im")


@query(
    f"""WITH {_MOVES_SQL}, nodes AS (SELECT * FROM (VALUES {', '.join(map(str, _NODES))}) v(node, x, y, z)),
rest AS (SELECT node, 'x' AS axis, x AS rest FROM nodes UNION ALL SELECT node, 'y', y FROM nodes UNION ALL SELECT node, 'z', z FROM nodes)
SELECT mode, node, axis, frame::INT AS frame, {_rounds(6, at='(rest + sqrt(re ** 2 + im ** 2) * cos(2 * pi() * frame / 25 + atan2(im, re)))::DOUBLE')} FROM moves JOIN rest USING (node, axis), (SELECT unnest(range(25)) AS frame)"""
)
def animation_frames(spark, sf_dir):
    return rounded(geometry.frames(spark.createDataFrame(_NODES, "node string, x double, y double, z double"), _moves(spark, sf_dir)), 6, "at")


# --- identification and selection: no SQL; held against analytic systems in the tests --------------


def _event_corr(spark: SparkSession, sf_dir: str, lags: int = 48) -> DataFrame:
    return spectral.corr_bt_chunked(_centred(spark, sf_dir), REFS, lags, panel.hours(spark, sf_dir))


@query()
def ssi_cov_poles(spark, sf_dir):
    return identify.ssi_cov_poles(_event_corr(spark, sf_dir), 1.0, 20, ORDERS)


@query()
def modal_contributions(spark, sf_dir):
    return identify.ssi_cov_contributions(_event_corr(spark, sf_dir), 1.0, 20, ORDERS)


@query()
def ssi_data_poles(spark, sf_dir):
    return identify.ssi_data_poles(_centred(spark, sf_dir), list(REFS), 1.0, 12, ORDERS, chunk=256)


@query()
def era_poles(spark, sf_dir):
    return identify.era_poles(_event_corr(spark, sf_dir), 1.0, 20, ORDERS)


@query()
def prce_poles(spark, sf_dir):
    return identify.prce_poles(_event_corr(spark, sf_dir), 1.0, range(2, 11, 2))


@query()
def plscf_poles(spark, sf_dir):
    return identify.plscf_poles(_event_corr(spark, sf_dir), 1.0, range(2, 11, 2))


@query()
def auto_selection(spark, sf_dir):
    poles = written(identify.ssi_cov_poles(_event_corr(spark, sf_dir), 1.0, 20, ORDERS), "poles")
    return stabil.representatives(stabil.clusters(poles, stabil.clearing(poles)), 5)


# --- monitoring ------------------------------------------------------------------------------------


@query(f"SELECT date_trunc('day', ts) AS start, event_type AS channel, count(*) AS n, {_rounds(2, power='avg(value * value)', rms='sqrt(avg(value * value))')} FROM events GROUP BY 1, 2")
def window_power(spark, sf_dir):
    samples = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", F.col("event_type").alias("channel"), F.col("value").alias("y"))
    return rounded(monitor.window_power(samples), 2, "power", "rms")
