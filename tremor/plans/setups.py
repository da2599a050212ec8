"""Registered queries of set-ups, spectra, stabilisation, merging and geometry beyond the catalogue, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tremor.functions import modal
from tremor.operators import channels, factors, flow, geometry, identify, implicit, kalman, longfft, merge, signals, spectral, stabil, subspace
from tremor.operators.estimates import Estimates
from tremor.plans.catalogue import (
    _CANDIDATES, _CFP, _COMMON_SQL, _DOFS_SQL, _GRID_SQL, _LIMITS, _MOVES_SQL, _NODES, _OK, _PAIRS, _SHAPES, DAY, H, LINES, LONG, PANEL, POLES_SQL, REFS, SEGMENTS,
    _LONG_WELCH, _WELCH, _centred, _corr_sql, _dofs, _event_corr, _grid, _long_welch, _mac_sql, _modes, _moves, _poles, _rig, _rounds, _segments, greedy_sql, query, rounded,
)
from tremor.scratch import written
from tremor.sources import panel
from tremor.sources.setup_files import Setup

RATE = 1 / 3600
START = "2024-01-01 00:00:00"

# --- channel metadata ------------------------------------------------------------------------------
# A setup is a week of the panel; its channels are the event types, some of them named, tagged and given directions by number.
_TAGS = {"accel": [3], "velo": [0, 1], "disp": [1]}


def _sql_rows(rows: list[tuple], names: str) -> str:
    text = lambda v: "NULL" if v is None else repr(v)
    return f"(VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) v({names})"


_TABLE_SQL = f"""{PANEL},
given AS (SELECT DISTINCT 'w' || (n // 168) AS setup, channel, CASE WHEN channel IN (0, 3) THEN 'ch' || channel END AS name FROM panel),
tagged AS (
  SELECT *, CASE WHEN channel IN (3) THEN 'accel' WHEN channel IN (0, 1) THEN 'velo' WHEN channel IN (1) THEN 'disp' ELSE 'accel' END AS quantity,
         (channel IN (3))::INT + (channel IN (0, 1))::INT + (channel IN (1))::INT AS n_tags, channel IN (1, 3) AS is_ref FROM given),
named_dofs AS (
  SELECT setup, channel, CASE WHEN channel < 2 THEN 'p' || channel WHEN channel < 4 THEN 'p' || channel || setup END AS node, 90.0::DOUBLE * channel AS azimuth, 0.0::DOUBLE AS elevation,
         CASE WHEN channel < 3 THEN 'd' || channel WHEN channel = 4 THEN 'free' END AS name FROM given
  UNION ALL SELECT setup, channel, 'q', 0.0::DOUBLE, 0.0::DOUBLE, 'q_x' FROM given WHERE channel = 1)
"""


def _weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = panel.hourly_events(spark, sf_dir).select(F.concat(F.lit("w"), F.floor(F.col("n") / 168)).alias("setup"), "channel").distinct()
    return rows.withColumn("name", F.when(F.col("channel").isin(0, 3), F.concat(F.lit("ch"), "channel")))


def _table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return channels.described(_weeks(spark, sf_dir), RATE, [1, 3], _TAGS, START)


def _named_dofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = _weeks(spark, sf_dir)
    own = given.selectExpr("setup", "channel", "CASE WHEN channel < 2 THEN concat('p', channel) WHEN channel < 4 THEN concat('p', channel, setup) END AS node", "double(90 * channel) AS azimuth", "double(0) AS elevation", "CASE WHEN channel < 3 THEN concat('d', channel) WHEN channel = 4 THEN 'free' END AS name")
    return own.unionByName(given.where("channel = 1").selectExpr("setup", "channel", "'q' AS node", "double(0) AS azimuth", "double(0) AS elevation", "'q_x' AS name"))


@query(f"WITH {_TABLE_SQL} SELECT setup, channel, name, quantity, n_tags, is_ref, (1 / 3600)::DOUBLE AS rate, TIMESTAMP '{START}' AS start FROM tagged")
def channel_table(spark, sf_dir):
    return _table(spark, sf_dir)


@query(f"WITH {_TABLE_SQL} SELECT setup, channel, quantity, is_ref FROM (SELECT setup, channel, CASE WHEN channel IN (1, 2) THEN 'disp' ELSE quantity END AS quantity, channel IN (0) AS is_ref FROM tagged)")
def channel_retagged(spark, sf_dir):
    return channels.with_references(channels.retagged(_table(spark, sf_dir), "disp", [1, 2]), [0]).select("setup", "channel", "quantity", "is_ref")


@query(f"WITH {_TABLE_SQL} SELECT setup, channel, 'several quantities' AS problem FROM tagged WHERE n_tags > 1 UNION ALL SELECT DISTINCT setup, 7, 'no such channel' FROM given")
def channel_problems(spark, sf_dir):
    return channels.problems(_table(spark, sf_dir), [0, 7])


@query(f"WITH {_TABLE_SQL} SELECT a.setup, a.channel, b.channel AS ref FROM tagged a JOIN tagged b ON a.setup = b.setup AND b.is_ref WHERE a.channel = 2 OR a.name IN ('ch0', 'ch3')")
def channel_pairs(spark, sf_dir):
    return channels.pairs_of(_table(spark, sf_dir), [2, "ch0", "ch3"])


@query(f"WITH {_TABLE_SQL}, p AS (SELECT a.setup, a.channel, b.channel AS ref FROM tagged a JOIN tagged b ON a.setup = b.setup AND b.is_ref) SELECT setup, channel, ref FROM p WHERE channel <= ref OR NOT EXISTS (SELECT 1 FROM p q WHERE q.setup = p.setup AND q.channel = p.ref AND q.ref = p.channel)")
def channel_pairs_once(spark, sf_dir):
    return channels.non_redundant(channels.pairs_of(_table(spark, sf_dir)))


@query(f"WITH {_TABLE_SQL} SELECT t.setup, t.channel, coalesce(t.name, min(d.name), 'Channel_' || t.channel) AS name FROM tagged t LEFT JOIN named_dofs d USING (setup, channel) GROUP BY t.setup, t.channel, t.name")
def channel_names(spark, sf_dir):
    return channels.named(_table(spark, sf_dir), _named_dofs(spark, sf_dir)).select("setup", "channel", "name")


@query(f"WITH {_TABLE_SQL} SELECT t.setup, t.channel, t.quantity, d.node, d.azimuth, d.elevation FROM tagged t JOIN (SELECT * FROM named_dofs WHERE node IS NOT NULL QUALIFY row_number() OVER (PARTITION BY setup, channel ORDER BY node, azimuth, elevation) = 1) d USING (setup, channel)")
def channel_directions(spark, sf_dir):
    return channels.with_directions(_table(spark, sf_dir), _named_dofs(spark, sf_dir)).select("setup", "channel", "quantity", "node", "azimuth", "elevation")


@query(f"WITH {_TABLE_SQL}, c AS (SELECT node, azimuth, elevation FROM named_dofs WHERE node IS NOT NULL GROUP BY ALL HAVING count(DISTINCT setup) = (SELECT count(DISTINCT setup) FROM given)) SELECT d.setup, d.channel, d.node, d.azimuth, d.elevation, t.is_ref AS usable FROM named_dofs d JOIN c USING (node, azimuth, elevation) JOIN tagged t ON t.setup = d.setup AND t.channel = d.channel")
def channels_of_common(spark, sf_dir):
    dofs = _named_dofs(spark, sf_dir)
    return channels.of_common(_table(spark, sf_dir), dofs, merge.common_dofs(dofs.where("node IS NOT NULL")))


def _panel_table(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    y = panel.hourly_events(spark, sf_dir)
    names = y.select("setup", "channel", F.lit(None).cast("string").alias("name")).distinct()
    return y, channels.described(names, RATE, list(REFS), {"velo": [2]}, START)


@query(f"WITH {PANEL} SELECT n, channel, {_rounds(6, t='n * 3600')}, TIMESTAMP '{START}' + INTERVAL 1 HOUR * n AS at, {_rounds(4, y='y')} FROM panel")
def time_axis(spark, sf_dir):
    return rounded(channels.time_axis(*_panel_table(spark, sf_dir)), 6, "t").withColumn("y", F.round("y", 4) + 0.0)


@query(f"WITH {PANEL} SELECT (max(n) + 1)::BIGINT AS samples, count(DISTINCT channel)::BIGINT AS n_channels, 2::BIGINT AS n_refs, 3600.0::DOUBLE AS dt, ((max(n) + 1) * 3600.0)::DOUBLE AS duration FROM panel")
def durations(spark, sf_dir):
    return rounded(channels.durations(*_panel_table(spark, sf_dir)), 6, "dt", "duration")


@query(f"WITH {PANEL} SELECT k::INT AS k, {_rounds(12, freq='k / 3600.0 / h')} FROM span, (SELECT unnest(range({H} // 2 + 1)) AS k)")
def frequency_lines(spark, sf_dir):
    return rounded(channels.frequency_axis(spark, RATE, panel.hours(spark, sf_dir)), 12, "freq")


@query(f"WITH {PANEL} SELECT lag::INT AS lag, {_rounds(6, tau='lag * 3600.0')} FROM (SELECT unnest(range({H} // 15)) AS lag)")
def lag_times(spark, sf_dir):
    return rounded(channels.lag_axis(spark, RATE, panel.hours(spark, sf_dir) // 15), 6, "tau")


_SETUP = Setup("events", RATE, [0, 4], [1, 3], {"accel": [0], "velo": [2, 4], "disp": []})


@query(f"WITH {PANEL} SELECT n, CASE channel WHEN 0 THEN 0 WHEN 2 THEN 1 ELSE 2 END AS channel, {_rounds(4, y='y')} FROM panel WHERE channel IN (0, 2, 4)")
def setup_signals(spark, sf_dir):
    return rounded(channels.prepared(panel.hourly_events(spark, sf_dir), _SETUP)[0], 4, "y")


@query("SELECT * FROM (VALUES (0, 'accel', 1, true), (1, 'velo', 1, false), (2, 'velo', 1, true)) v(channel, quantity, n_tags, is_ref)")
def setup_channels(spark, sf_dir):
    return channels.prepared(panel.hourly_events(spark, sf_dir), _SETUP)[1].select("channel", "quantity", "n_tags", "is_ref")


# --- filters and spectra ---------------------------------------------------------------------------


@query()
def filter_band(spark, sf_dir):
    return rounded(signals.filter_signals(_centred(spark, sf_dir), 24.0, 3.0, 0.5, 4, "cheby2", attenuation=40.0, chunk=128), 6, "y")


@query()
def decimate_filtered(spark, sf_dir):
    return rounded(signals.decimated(_centred(spark, sf_dir), 4, 24.0), 6, "y")


@query(f"WITH {PANEL}, {_LONG_WELCH}, v AS (SELECT channel, ref, k, any_value(m.re) AS re, any_value(m.im) AS im, sum(share * ((p.re - m.re) ** 2 + (p.im - m.im) ** 2)) AS var FROM parts p JOIN psd m USING (channel, ref, k) GROUP BY ALL) SELECT channel, ref, k, {_rounds(0, re='re', im='im')}, {_rounds(3, log_var='log10(var + 1)')} FROM v")
def psd_welch_variance(spark, sf_dir):
    found = spectral.over_segments(_long_welch(spark, sf_dir, by_segment=True))
    return found.select("channel", "ref", "k", *[(F.round(c, 0) + 0.0).alias(c) for c in ("re", "im")], (F.round(F.log10(F.col("var") + 1), 3) + 0.0).alias("log_var"))


@query(f"WITH {PANEL}, {_LONG_WELCH}, r AS (SELECT channel, ref, {_rounds(0, re='re', im='im')} FROM psd) SELECT channel, ref, re, im FROM r QUALIFY row_number() OVER (PARTITION BY channel, ref ORDER BY re DESC, im DESC) = 1")
def psd_scaling_factors(spark, sf_dir):
    found = _long_welch(spark, sf_dir)
    return spectral.scaling_factors(found.withColumns({c: F.round(c, 0) + 0.0 for c in ("re", "im")})).drop("setup")


@query(f"WITH {PANEL}, {_LONG_WELCH} SELECT channel, ref, k, {_rounds(4, value='10 * log10(sqrt(re * re + im * im))')} FROM psd WHERE k > 2 AND k < 10")
def psd_decibels(spark, sf_dir):
    found = _long_welch(spark, sf_dir)
    return rounded(spectral.scaled(spectral.in_band(found, 1.0, LONG, 2 / LONG, 10 / LONG), "db"), 4, "value")


@query(
    f"""WITH {PANEL}, c AS (
  SELECT b.n // ({H} // 4) AS block, a.channel, b.channel AS ref, (a.n - b.n)::INT AS lag, sum(a.y * b.y) / ({H} // 4) AS r
  FROM centred a JOIN centred b ON b.channel IN {REFS} AND a.n - b.n BETWEEN 1 AND 6 GROUP BY ALL)
SELECT block::INT AS block, channel, ref, lag, {_rounds(1, r='r')} FROM c"""
)
def block_covariances(spark, sf_dir):
    return rounded(spectral.block_covariances(_centred(spark, sf_dir), REFS, 6, panel.hours(spark, sf_dir) // 4, 4), 1, "r")


@query(
    f"""WITH {PANEL}, {_LONG_WELCH},
x AS (SELECT a.channel, b.channel AS ref, avg(abs(a.y * b.y)) AS power, sum(a.y * b.y) / count(*) AS correlated FROM centred a JOIN centred b ON a.n = b.n AND b.channel IN {REFS} GROUP BY ALL),
m AS (SELECT channel, ref, avg(sqrt(re * re + im * im)) AS spectral FROM psd GROUP BY ALL)
SELECT channel, ref, {_rounds(0, spectral='spectral')}, {_rounds(1, correlated='correlated', power='power')} FROM m JOIN x USING (channel, ref)"""
)
def power_check(spark, sf_dir):
    y = _centred(spark, sf_dir)
    found = spectral.power_check(y, _long_welch(spark, sf_dir), spectral.corr_bt_chunked(y, REFS, 1, panel.hours(spark, sf_dir)))
    return rounded(found.withColumn("spectral", F.round("spectral", 0) + 0.0), 1, "correlated", "power")


@query()
def sv_decibels(spark, sf_dir):
    return rounded(spectral.sv_decibels(spectral.sv_psd(spectral.psd_welch(_centred(spark, sf_dir), range(5), LINES, _segments(spark, sf_dir), fft=True))), 4, "db")


@query()
def signals_with_noise(spark, sf_dir):
    return signals.add_noise(panel.hourly_events(spark, sf_dir), snr=0.1, seed=7).drop("setup")


@query()
def impulse_responses(spark, sf_dir):
    y = _centred(spark, sf_dir)
    found = spectral.frequency_response(y, y.where("channel = 0").select("setup", "n", F.col("y").alias("f")), panel.hours(spark, sf_dir))
    return found.select("channel", F.transform("irf", lambda v: F.round(v, 6)).alias("irf"))


# --- stabilisation ---------------------------------------------------------------------------------

_UNSURE = "0.03 * f * (1 + sin(ord)) AS std_f, 0.05 * d * (1 + cos(ord)) AS std_d, 0.4 * sin(ord + idx) AS mc"
_MET = f"met AS (SELECT ord, idx, bool_or({' AND '.join(_OK.values())}) AS a FROM pairs GROUP BY ord, idx)"
_INSIDE = "d BETWEEN 0 AND 100 AND mpc >= 0 AND mpd <= 90 AND f > 0 AND ord >= 4 AND (ord - 4) % 2 = 0 AND ord < 24 AND std_f <= 0.05 * f AND std_d <= 0.08 * d AND abs(mc) >= 0.1"
_MASKED = f"unsure AS (SELECT *, {_UNSURE} FROM criteria), {_MET}, masked AS (SELECT ord, idx, {_INSIDE} AS in_range, ({_INSIDE}) AND coalesce(a, false) AS stable FROM unsure LEFT JOIN met USING (ord, idx))"


def _unsure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _poles(spark, sf_dir).selectExpr("*", *_UNSURE.split(", "))


def _masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stabil.masks(_unsure(spark, sf_dir), *_LIMITS, orders=(4, 24, 2), std_f_max=5.0, std_d_max=8.0, mc_min=0.1)


@query(f"WITH {POLES_SQL}, {_SHAPES}, {_PAIRS}, {_MASKED} SELECT ord, idx, in_range, stable FROM masked")
def masks_of_uncertain(spark, sf_dir):
    return _masked(spark, sf_dir).select("ord", "idx", "in_range", "stable")


@query(f"WITH {POLES_SQL}, {_SHAPES}, {_PAIRS}, {_MASKED}, least AS (SELECT ord, idx, min(d_f) AS x FROM pairs GROUP BY ord, idx) SELECT floor(x * 20 / 0.5)::INT AS bin, count(*) AS n, (count(*) FILTER (stable))::BIGINT AS n_stable FROM least JOIN masked USING (ord, idx) WHERE x < 0.5 GROUP BY 1")
def stable_histogram(spark, sf_dir):
    return stabil.selected_histogram(stabil.pole_pairs(_poles(spark, sf_dir)), _masked(spark, sf_dir), "d_f", 20, 0.5)


def _selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Poles of every fifth day; one is added by hand, another added and taken out again."""
    one = _poles(spark, sf_dir).where("ord % 5 = 3").select("setup", "ord", "idx")
    return stabil.remove_mode(stabil.add_mode(stabil.add_mode(one, "events", 10, 0), "events", 9, 0), "events", 9, 0)


@query(
    f"""WITH {POLES_SQL}, {_SHAPES}, {_PAIRS}, chosen AS (SELECT ord, idx FROM poles WHERE ord % 5 = 3 UNION SELECT 10, 0),
least AS (SELECT ord, idx, min(d_mp) FILTER (d_mp > 0) AS d_mp, min(d_mpd) FILTER (d_mpd > 0) AS d_mpd FROM pairs GROUP BY ord, idx)
SELECT (row_number() OVER (ORDER BY f, ord, idx) - 1)::INT AS mode, ord, idx, {_rounds(6, f='f', d='d', mpc='mpc', mp='mp', mpd='mpd', d_mp='d_mp', d_mpd='d_mpd')} FROM criteria JOIN chosen USING (ord, idx) LEFT JOIN least USING (ord, idx)"""
)
def modal_values(spark, sf_dir):
    return rounded(stabil.modal_values(_poles(spark, sf_dir), _selection(spark, sf_dir)), 6, "f", "d", "mpc", "mp", "mpd", "d_mp", "d_mpd")


_POINTS = [(0, 0.08, 5.0), (1, 0.2, 9.0), (2, 0.35, 13.0)]


@query(f"WITH {POLES_SQL}, q AS (SELECT * FROM {_sql_rows(_POINTS, 'id, qf, qord')}) SELECT id, ord, idx FROM poles, q QUALIFY row_number() OVER (PARTITION BY id ORDER BY ((f - qf) / 0.5) ** 2 + ((ord - qord) / 14) ** 2, ord, idx) = 1")
def nearest_poles(spark, sf_dir):
    points = spark.createDataFrame([(i, "events", f, o) for i, f, o in _POINTS], "id int, setup string, f double, ord double")
    return stabil.nearest_pole(_poles(spark, sf_dir), points, 0.5, 14.0).drop("setup")


@query(f"WITH {POLES_SQL} SELECT ord, {_rounds(8, mc='abs(sum(mc))')} FROM (SELECT ord, {_UNSURE} FROM poles) GROUP BY ord")
def contributions_by_order(spark, sf_dir):
    return rounded(stabil.contributions_by_order(_unsure(spark, sf_dir)), 8, "mc")


# Fixed value: 97.5 % quantile of Student's t with 30 degrees of freedom.
@query(f"WITH {POLES_SQL} SELECT ord, idx, {_rounds(6, half_f='2.0422724563012373 * std_f / sqrt(30)', half_d='2.0422724563012373 * std_d / sqrt(30)')} FROM (SELECT ord, idx, {_UNSURE} FROM poles)")
def confidence_intervals(spark, sf_dir):
    return rounded(stabil.confidence(_unsure(spark, sf_dir), 30).select("ord", "idx", "half_f", "half_d"), 6, "half_f", "half_d")


@query()
def clustered_selection(spark, sf_dir):
    poles = written(identify.ssi_cov_poles(_event_corr(spark, sf_dir), 1.0, 20, range(4, 21, 2)), "poles")
    return stabil.representatives(stabil.clusters(poles, stabil.clearing(poles)))


# --- merging ---------------------------------------------------------------------------------------

_EVERY = f"every AS (SELECT a.idx AS mode_a, b.idx AS mode_b, (abs(b.f - a.f) / a.f)::DOUBLE AS d_f, {_mac_sql('a', 'b')} AS mac FROM poles a, poles b WHERE a.ord = 13 AND b.ord = 3)"


@query(f"WITH RECURSIVE {POLES_SQL}, {_EVERY}, {greedy_sql('every')} SELECT mode_a, mode_b, {_rounds(8, d_f='d_f', mac='mac')} FROM taken WHERE mode_a IS NOT NULL")
def nearest_pairs(spark, sf_dir):
    return rounded(merge.pairs(merge.all_candidates(_modes(spark, sf_dir, 13), _modes(spark, sf_dir, 3))), 8, "d_f", "mac")


@query(f"WITH {POLES_SQL}, p AS (SELECT 'day' || ord AS setup, idx AS mode_a, (row_number() OVER (PARTITION BY ord ORDER BY d, idx) - 1)::INT AS mode_b FROM poles) SELECT setup, mode_a, mode_b FROM p WHERE mode_a IN (SELECT mode_a FROM p GROUP BY mode_a HAVING count(DISTINCT setup) = (SELECT count(DISTINCT setup) FROM p))")
def common_modes(spark, sf_dir):
    """Days are setups: a day's poles by frequency are paired with the same by damping."""
    found = _poles(spark, sf_dir).select(F.concat(F.lit("day"), "ord").alias("setup"), F.col("idx").alias("mode_a"), (F.row_number().over(Window.partitionBy("ord").orderBy("d", "idx")) - 1).alias("mode_b"))
    return merge.common_modes(found, found.select("setup").distinct().count()).select("setup", "mode_a", "mode_b")


def _two(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    a, b = (_poles(spark, sf_dir).where(F.col("ord") == o).select(F.col("idx").alias("mode"), "f", "d", "phi_re", "phi_im") for o in (13, 3))
    return a, b, merge.pairs(merge.pair_candidates(a, b, 0.6, 0.1))


_NEAR3 = _CANDIDATES.replace("b.ord = 5", "b.ord = 3")


@query(
    f"""WITH RECURSIVE {POLES_SQL}, {_NEAR3}, {greedy_sql('candidates')}, found AS (SELECT mode_a, mode_b, mac FROM taken WHERE mode_a IS NOT NULL)
SELECT count(*) AS n, {_rounds(8, mean_df='avg(a.f - b.f)', std_df='stddev_pop(a.f - b.f)', mean_dd='avg(a.d - b.d)', std_dd='stddev_pop(a.d - b.d)', mean_mac='avg(mac)', min_mac='min(mac)')},
  (SELECT count(*) FROM poles WHERE ord = 13 AND idx NOT IN (SELECT mode_a FROM found)) AS unmatched_a, (SELECT count(*) FROM poles WHERE ord = 3 AND idx NOT IN (SELECT mode_b FROM found)) AS unmatched_b
FROM found JOIN poles a ON a.ord = 13 AND a.idx = mode_a JOIN poles b ON b.ord = 3 AND b.idx = mode_b"""
)
def pair_statistics(spark, sf_dir):
    return rounded(merge.pair_statistics(*_two(spark, sf_dir)), 8, "mean_df", "std_df", "mean_dd", "std_dd", "mean_mac", "min_mac")


@query(f"WITH RECURSIVE {POLES_SQL}, {_NEAR3}, {greedy_sql('candidates')} SELECT idx AS mode, f::DOUBLE AS f FROM poles WHERE ord = 13 AND idx NOT IN (SELECT mode_a FROM taken WHERE mode_a IS NOT NULL)")
def unpaired_modes(spark, sf_dir):
    a, _, found = _two(spark, sf_dir)
    return merge.unpaired(a, found, "a").select("mode", "f")


@query(f"WITH {_DOFS_SQL} SELECT 'x' || setup AS setup, 'no directions' AS problem FROM dofs WHERE channel = 0 AND setup >= 's2' UNION ALL SELECT DISTINCT setup, 'no selected modes' FROM dofs WHERE setup >= 's2'")
def setup_problems(spark, sf_dir):
    """Modes of some setups are there, those of the others under wrong names."""
    dofs = _dofs(spark, sf_dir)
    modes = dofs.where("channel = 0").select(F.expr("CASE WHEN setup >= 's2' THEN concat('x', setup) ELSE setup END").alias("setup"), F.lit(0).alias("mode"))
    return merge.setup_problems(dofs, modes)


_SHAPES_SQL = """
raw AS (SELECT d.setup, m.idx AS mode, d.node, d.azimuth::DOUBLE AS azimuth, d.elevation::DOUBLE AS elevation, (1 + 0.3 * m.idx + 0.2 * d.channel - 0.1 * d.azimuth / 90)::DOUBLE AS u, (0.1 * m.idx - 0.02 * d.channel)::DOUBLE AS v FROM dofs d, (VALUES (0), (1)) m(idx)),
base AS (SELECT min(setup) AS base FROM dofs)
"""


@query(
    f"""WITH {_DOFS_SQL}, {_COMMON_SQL}, {_SHAPES_SQL},
whole AS (SELECT r.* FROM raw r, base WHERE setup = base UNION ALL SELECT r.* FROM (SELECT * FROM raw ANTI JOIN common USING (node, azimuth, elevation)) r, base WHERE setup <> base),
top AS (SELECT mode, u AS tu, v AS tv FROM whole QUALIFY row_number() OVER (PARTITION BY mode ORDER BY u * u + v * v DESC) = 1)
SELECT mode, node, azimuth, elevation, {_rounds(8, re='(u * tu + v * tv) / (tu * tu + tv * tv)', im='(v * tu - u * tv) / (tu * tu + tv * tv)')} FROM whole JOIN top USING (mode)"""
)
def merged_shapes(spark, sf_dir):
    """Every nation's suppliers hold the same shape on a scale of their own, so merging gives back one shape."""
    raw = _dofs(spark, sf_dir).crossJoin(spark.range(2).select(F.col("id").cast("int").alias("mode"))).selectExpr(
        "*", "double(1 + 0.3 * mode + 0.2 * channel - 0.1 * azimuth / 90) AS u", "double(0.1 * mode - 0.02 * channel) AS v", "1 + 0.1D * int(substr(setup, 2)) AS p", "0.05D * int(substr(setup, 2)) AS q"
    )
    shapes = raw.selectExpr("setup", "mode", "node", "azimuth", "elevation", "u * p - v * q AS re", "u * q + v * p AS im")
    return rounded(merge.merged_shapes(shapes, raw.agg(F.min("setup")).first()[0]), 8, "re", "im")


# --- geometry --------------------------------------------------------------------------------------

_NEW_SQL = "new AS (SELECT stop AS start, start AS stop FROM lines WHERE key % 2 = 0 UNION ALL SELECT 'p' || key, 'p' || (key + 2) FROM nodes)"


@query(f"WITH {_GRID_SQL}, {_NEW_SQL}, every AS (SELECT start, stop FROM lines UNION ALL SELECT start, stop FROM new WHERE start IN (SELECT node FROM nodes) AND stop IN (SELECT node FROM nodes)) SELECT CASE WHEN bool_or(start < stop) THEN least(min(start), min(stop)) ELSE greatest(max(start), max(stop)) END AS start, CASE WHEN bool_or(start < stop) THEN greatest(max(start), max(stop)) ELSE least(min(start), min(stop)) END AS stop FROM every GROUP BY least(start, stop), greatest(start, stop)")
def geometry_lines(spark, sf_dir):
    """Lines of the nations, with some the other way round, and lines from every supplier to the one after next, which need not be there."""
    nodes, lines = _grid(spark, sf_dir)
    new = lines.where("key % 2 = 0").select(F.col("stop").alias("start"), F.col("start").alias("stop")).unionByName(nodes.selectExpr("node AS start", "concat('p', key + 2) AS stop"))
    return geometry.add_lines(lines, new, nodes)


@query(f"WITH {_GRID_SQL} SELECT node, {_rounds(6, x='2.5 * x', y='2.5 * y', z='2.5 * z')} FROM (SELECT node, CASE WHEN key % 5 = 0 THEN 4.0 ELSE x END AS x, y, z FROM nodes UNION ALL SELECT 'q' || key, y, x, z FROM nodes WHERE key % 5 = 1)")
def geometry_nodes(spark, sf_dir):
    """Some nodes are moved, some are new, all are rescaled."""
    nodes = _grid(spark, sf_dir)[0]
    new = nodes.where("key % 5 = 0").withColumn("x", F.lit(4.0)).unionByName(nodes.where("key % 5 = 1").selectExpr("concat('q', key) AS node", "y AS x", "x AS y", "z", "key"))
    return rounded(geometry.rescaled(geometry.add_nodes(nodes, new), 2.5), 6, "x", "y", "z").select("node", "x", "y", "z")


@query(f"WITH {_DOFS_SQL} SELECT setup, channel, CASE WHEN node <> 'p0' THEN node END AS node FROM dofs")
def geometry_free_dofs(spark, sf_dir):
    return geometry.without_dofs(_dofs(spark, sf_dir), spark.createDataFrame([("p0",)], "node string")).select("setup", "channel", "node")


@query(f"WITH {_MOVES_SQL} SELECT mode, node, axis, {_rounds(6, size='sqrt(re ** 2 + im ** 2)::DOUBLE', phase='atan2(im, re)::DOUBLE')} FROM moves")
def displayed_shape(spark, sf_dir):
    return rounded(geometry.shown(_moves(spark, sf_dir)), 6, "size", "phase")


# E follows a and b, f follows e.
_LINKS = [("a", 1.0, 0.0, 0.0, "e", 0.5, 0.0, 0.0), ("b", 0.0, 1.0, 0.0, "e", 0.0, 2.0, 0.0), ("e", 1.0, 1.0, 0.0, "f", 0.0, 0.0, 1.0)]


@query(
    f"""WITH {_MOVES_SQL},
e AS (SELECT mode, 'e' AS node, axis, sum(CASE WHEN node = 'a' AND axis = 'x' THEN 0.5 * (SELECT sum(m.re) FROM moves m WHERE m.mode = moves.mode AND m.node = 'a' AND m.axis = 'x') WHEN node = 'b' AND axis = 'y' THEN 2 * (SELECT sum(m.re) FROM moves m WHERE m.mode = moves.mode AND m.node = 'b' AND m.axis = 'y') END) AS re,
  sum(CASE WHEN node = 'a' AND axis = 'x' THEN 0.5 * (SELECT sum(m.im) FROM moves m WHERE m.mode = moves.mode AND m.node = 'a' AND m.axis = 'x') WHEN node = 'b' AND axis = 'y' THEN 2 * (SELECT sum(m.im) FROM moves m WHERE m.mode = moves.mode AND m.node = 'b' AND m.axis = 'y') END) AS im
  FROM moves WHERE (node = 'a' AND axis = 'x') OR (node = 'b' AND axis = 'y') GROUP BY mode, axis),
f AS (SELECT mode, 'f' AS node, 'z' AS axis, sum(re) AS re, sum(im) AS im FROM e GROUP BY mode)
SELECT mode, node, axis, {_rounds(6, re='re::DOUBLE', im='im::DOUBLE')} FROM (SELECT * FROM e UNION ALL SELECT * FROM f)"""
)
def dependent_nodes(spark, sf_dir):
    links = spark.createDataFrame(_LINKS, "parent string, px double, py double, pz double, child string, cx double, cy double, cz double")
    return rounded(geometry.with_dependent(_moves(spark, sf_dir), links).where("node IN ('e', 'f')"), 6, "re", "im")


@query(f"WITH {PANEL} SELECT n, node, axis, {_rounds(4, at='CASE axis WHEN own THEN r + 0.001 * y ELSE r END')} FROM centred JOIN (VALUES (0, 'a', 'x'), (1, 'b', 'y'), (2, 'c', 'z')) d(channel, node, own) USING (channel) JOIN (SELECT node, unnest(['x', 'y', 'z']) AS axis, unnest([x, y, z]) AS r FROM {_sql_rows(_NODES, 'node, x, y, z')}) USING (node)")
def measured_frames(spark, sf_dir):
    nodes = spark.createDataFrame(_NODES, "node string, x double, y double, z double")
    return rounded(geometry.measured_frames(nodes, _rig(spark), _centred(spark, sf_dir), 0.001), 4, "at")


# --- identification --------------------------------------------------------------------------------


@query(f"WITH {POLES_SQL}, t AS (SELECT *, list_transform(range(1, len(phi_re) + 1), lambda j: phi_re[j] ** 2 + phi_im[j] ** 2) AS sizes FROM poles), w AS (SELECT *, phi_re[list_position(sizes, list_max(sizes))]::DOUBLE AS a, phi_im[list_position(sizes, list_max(sizes))]::DOUBLE AS b FROM t), j AS (SELECT *, unnest(range(1, len(phi_re) + 1)) AS j FROM w) SELECT ord, idx, (j - 1)::INT AS channel, {_rounds(8, re='(phi_re[j] * a + phi_im[j] * b) / sqrt(a * a + b * b)', im='(phi_im[j] * a - phi_re[j] * b) / sqrt(a * a + b * b)')} FROM j")
def rotated_shapes(spark, sf_dir):
    re, im = modal.rotated(F.col("phi_re"), F.col("phi_im"))
    flat = _poles(spark, sf_dir).select("ord", "idx", F.posexplode(F.arrays_zip(re.alias("re"), im.alias("im"))).alias("channel", "z")).select("ord", "idx", "channel", "z.re", "z.im")
    return rounded(flat, 8, "re", "im")


_W = "(2 * pi() * f)"


@query(f"WITH {POLES_SQL}, j AS (SELECT ord, idx, f, unnest(range(len(phi_re))) AS c, unnest(['accel', 'velo', 'disp', 'accel', 'velo']) AS q, unnest(phi_re) AS a, unnest(phi_im) AS b FROM poles) SELECT ord, idx, c::INT AS channel, {_rounds(8, re=f'CASE q WHEN $accel$ THEN -a / {_W} ** 2 WHEN $velo$ THEN -b / {_W} ELSE a END', im=f'CASE q WHEN $accel$ THEN -b / {_W} ** 2 WHEN $velo$ THEN a / {_W} ELSE b END').replace('$accel$', chr(39) + 'accel' + chr(39)).replace('$velo$', chr(39) + 'velo' + chr(39))} FROM j")
def displacement_shapes(spark, sf_dir):
    re, im = modal.as_displacements(F.col("phi_re"), F.col("phi_im"), F.array(*map(F.lit, ("accel", "velo", "disp", "accel", "velo"))), F.col("f"))
    flat = _poles(spark, sf_dir).select("ord", "idx", F.posexplode(F.arrays_zip(re.alias("re"), im.alias("im"))).alias("channel", "z")).select("ord", "idx", "channel", "z.re", "z.im")
    return rounded(flat, 8, "re", "im")


_BLOCK = 24  # hours; the panel has whole days


@query()
def uncertain_poles(spark, sf_dir):
    """Blocks of one day over the whole panel."""
    blocks = panel.hours(spark, sf_dir) // _BLOCK
    return subspace.uncertain_poles(spectral.block_covariances(_centred(spark, sf_dir), REFS, 20, _BLOCK, blocks), 1.0, 9, range(4, 13, 2))


@query()
def uncertain_poles_of_projections(spark, sf_dir):
    """Blocks of five days; the last one may be shorter."""
    return subspace.uncertain_poles_of_projections(_centred(spark, sf_dir), REFS, 1.0, 9, range(4, 13, 2), 120, chunk=60, how="qr")


@query()
def merged_setup_poles(spark, sf_dir):
    """Three setups of a third of the panel each, as in a campaign: all share two reference channels and each has one of the others, so it does not read
    the other two channels in that third."""
    third = panel.hours(spark, sf_dir) // 3
    y = _centred(spark, sf_dir).withColumn("turn", F.least(F.floor(F.col("n") / third), F.lit(2)).cast("int"))
    y = y.where("channel < 2 OR channel = turn + 2").select(F.concat(F.lit("m"), "turn").alias("setup"), (F.col("n") - F.col("turn") * third).cast("int").alias("n"), "channel", "y")
    dofs = y.select("setup", "channel").distinct().select("setup", "channel", F.concat(F.lit("node"), "channel").alias("node"), F.lit(0.0).alias("azimuth"), F.lit(0.0).alias("elevation"))
    return subspace.merged_poles(spectral.corr_bt_chunked(y, REFS, 40, third), dofs, 1.0, 15, range(4, 11, 2))


_ROWS, _FOLDS = 10, 4


def _events_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One factor of the whole panel, from chunks of 240 hours."""
    leaves = factors.block_factors(_centred(spark, sf_dir), REFS, _ROWS, panel.hours(spark, sf_dir), 240)
    return factors.merged(leaves, ["setup"], "part")


@query()
def kalman_models(spark, sf_dir):
    """State matrices, noise covariances, gain and the residual of its Riccati equation."""
    return kalman.kalman_models(_events_factor(spark, sf_dir), ["setup"], _ROWS, [4, 8]).drop("setup")


@query()
def modal_signals(spark, sf_dir):
    models = kalman.kalman_models(_events_factor(spark, sf_dir), ["setup"], _ROWS, [8])
    return kalman.modal_signals(_centred(spark, sf_dir), models, 1.0, chunk=256).drop("setup")


@query()
def signal_contributions(spark, sf_dir):
    y = _centred(spark, sf_dir)
    models = kalman.kalman_models(_events_factor(spark, sf_dir), ["setup"], _ROWS, [8])
    return subspace.signal_contributions(y, kalman.modal_signals(y, models, 1.0, chunk=256)).drop("setup")


@query()
def cross_validation(spark, sf_dir):
    length = panel.hours(spark, sf_dir) // _FOLDS
    y = _centred(spark, sf_dir)
    return subspace.cross_validated(y, spectral.corr_bt(y, range(5), 22, length, _FOLDS), 9, [2, 4, 8], length, chunk=64).drop("setup")


@query()
def cross_validation_lq(spark, sf_dir):
    return subspace.cross_validated_lq(_centred(spark, sf_dir), REFS, _ROWS, [2, 4, 8], panel.hours(spark, sf_dir) // _FOLDS, chunk=64).drop("setup")


@query()
def correlation_synthesis(spark, sf_dir):
    corr = _event_corr(spark, sf_dir)
    return subspace.synthetic_correlations(corr, identify.ssi_cov_poles(corr, 1.0, 20, range(12, 13)), 12).drop("setup")


@query()
def synthesis_errors(spark, sf_dir):
    corr = _event_corr(spark, sf_dir)
    return subspace.synthesis_errors(subspace.synthetic_correlations(corr, identify.ssi_cov_poles(corr, 1.0, 20, range(12, 13)), 12)).drop("setup")


@query()
def spectrum_synthesis(spark, sf_dir):
    corr = _event_corr(spark, sf_dir)
    return subspace.synthetic_spectra(subspace.synthetic_correlations(corr, identify.ssi_cov_poles(corr, 1.0, 20, range(12, 13)), 12), 48).drop("setup")


@query()
def residual_poles(spark, sf_dir):
    return subspace.residual_poles(_event_corr(spark, sf_dir), 1.0, 6).drop("setup")


@query()
def ssi_cov_poles_implicit(spark, sf_dir):
    """The block Toeplitz matrix through its products only."""
    return implicit.ssi_cov_poles(_event_corr(spark, sf_dir), 1.0, 20, range(4, 21, 4))


@query()
def plscf_poles_summed(spark, sf_dir):
    """Normal equations summed over the channels."""
    return implicit.plscf_poles(_event_corr(spark, sf_dir), 1.0, range(2, 11, 2))


@query()
def plscf_poles_complex(spark, sf_dir):
    return implicit.plscf_poles(_event_corr(spark, sf_dir), 1.0, range(2, 11, 2), real=False)


@query()
def modal_spectra(spark, sf_dir):
    return subspace.modal_spectra(_event_corr(spark, sf_dir), 1.0, 6).drop("setup")


@query()
def spectral_contributions(spark, sf_dir):
    return subspace.spectral_contributions(subspace.modal_spectra(_event_corr(spark, sf_dir), 1.0, 6)).drop("setup")


@query()
def era_of_force(spark, sf_dir):
    """Channel 0 stands for a measured force on the others."""
    y = _centred(spark, sf_dir)
    return longfft.era_poles(y, y.where("channel = 0").select("setup", "n", F.col("y").alias("f")), panel.hours(spark, sf_dir), 1.0, 12, range(2, 9, 2))


# --- other ways ------------------------------------------------------------------------------------


@query(
    f"""WITH {PANEL}, {_WELCH.replace('(0.54 - 0.46 * cos(2 * pi() * n / ', '(0.5 - 0.5 * cos(2 * pi() * n / ')}
SELECT channel, ref, k, {_rounds(0, re='re', im='im')} FROM psd"""
)
def psd_welch_hann(spark, sf_dir):
    return rounded(spectral.psd_welch(_centred(spark, sf_dir), REFS, LINES, _segments(spark, sf_dir), fft=True, window="hann"), 0, "re", "im")


@query(
    f"""WITH {PANEL},
c AS (SELECT a.channel, b.channel AS ref, (a.n - b.n)::INT AS lag, sum(a.y * b.y) / ({H} - (a.n - b.n)) AS r FROM centred a JOIN centred b ON b.channel IN {REFS} AND a.n - b.n BETWEEN 0 AND 15 GROUP BY a.channel, b.channel, a.n - b.n),
w AS (SELECT i, 0.5 - 0.5 * cos(2 * pi() * i / 16) AS w FROM (SELECT unnest(range(16)) AS i)),
lw AS (SELECT b.i - a.i AS lag, sum(a.w * b.w) / 16 AS lw FROM w a JOIN w b ON b.i >= a.i GROUP BY b.i - a.i),
s AS (SELECT 2 * {H} * sum(w * w) / sum(w) ** 2 * 16 AS s FROM w),
e AS (SELECT a.*, coalesce(b.r, a.r) AS back, lw FROM c a LEFT JOIN c b ON b.channel = a.ref AND b.ref = a.channel AND b.lag = a.lag JOIN lw ON lw.lag = a.lag)
SELECT channel, ref, k, {_rounds(0, re='any_value(s.s) * sum(lw * (r + CASE WHEN lag = 0 THEN 0 ELSE back END) * cos(2 * pi() * ((k * lag) % 32) / 32))', im='any_value(s.s) * sum(CASE WHEN lag = 0 THEN 0 ELSE lw * (back - r) * sin(2 * pi() * ((k * lag) % 32) / 32) END)')}
FROM e, s, (SELECT unnest(range(17))::INT AS k) GROUP BY channel, ref, k"""
)
def cross_spectra_bt(spark, sf_dir):
    hours = panel.hours(spark, sf_dir)
    return rounded(spectral.cross_spectra_bt(spectral.corr_bt_chunked(_centred(spark, sf_dir), REFS, 16, hours), 16, hours), 0, "re", "im")


def _spread_sql(weight: str) -> str:
    total = lambda e: f"list_sum(list_transform(range(1, len(phi_re) + 1), lambda j: {e}))"
    w = "sqrt(phi_re[j] ** 2 + phi_im[j] ** 2)" if weight == "size" else "1.0"
    return f"""
t AS (SELECT *, atan2(2 * list_dot_product(phi_re, phi_im), list_dot_product(phi_re, phi_re) - list_dot_product(phi_im, phi_im)) / 2 AS turn FROM poles),
p AS (SELECT *, list_transform(range(1, len(phi_re) + 1), lambda j: degrees(atan2(phi_im[j] * cos(turn) - phi_re[j] * sin(turn), phi_re[j] * cos(turn) + phi_im[j] * sin(turn)))) AS raw,
        list_transform(range(1, len(phi_re) + 1), lambda j: CASE WHEN phi_im[j] < 0 THEN degrees(atan2(phi_im[j], phi_re[j])) + 180 ELSE degrees(atan2(phi_im[j], phi_re[j])) END) AS folded FROM t),
q AS (SELECT *, list_transform(raw, lambda x: CASE WHEN x > 90 THEN x - 180 WHEN x < -90 THEN x + 180 ELSE x END) AS bent, {total(f"{w} * folded[j]")} / {total(w)} AS mp_a FROM p),
r AS (SELECT *, list_sum(bent) / len(bent) AS centre FROM q)
SELECT ord, idx, {_rounds(6, mp_o='CASE WHEN turn < 0 THEN degrees(turn) + 180 ELSE degrees(turn) END', mpd_o=f'sqrt({total(f"{w} * (bent[j] - centre) ** 2")} / {total(w)})', mp_a='mp_a', mpd_a=f'sqrt({total(f"{w} * (folded[j] - mp_a) ** 2")} / {total(w)})')} FROM r"""


def _spreads(spark: SparkSession, sf_dir: str, weighted: bool) -> DataFrame:
    ways = [modal.phase_spread(F.col("phi_re"), F.col("phi_im"), about, weighted) for about in ("ortho", "arithm")]
    names = [("mp_o", "mpd_o"), ("mp_a", "mpd_a")]
    return rounded(_poles(spark, sf_dir).select("setup", "ord", "idx", *(c.alias(n) for pair, both in zip(ways, names) for c, n in zip(pair, both))), 6, *(n for both in names for n in both))


@query(f"WITH {POLES_SQL}, {_spread_sql('size')}")
def phase_spreads(spark, sf_dir):
    """Mean phases and deviations by orthogonal regression and by the arithmetic mean."""
    return _spreads(spark, sf_dir, True)


@query(f"WITH {POLES_SQL}, {_spread_sql('none')}")
def phase_spreads_unweighted(spark, sf_dir):
    return _spreads(spark, sf_dir, False)


@query()
def single_setup_flow(spark, sf_dir):
    """A setup file's and a method file's values to the modal values of the selected modes in one call."""
    hours = panel.hours(spark, sf_dir)
    return flow.single_setup(panel.hourly_events(spark, sf_dir), _SETUP, hours, "ssi-cov", {"block_columns": "20", "max_order": "20"})[2].drop("setup")


# --- conjugates, methods used last, random phases, hooks --------------------------------------------

_ROOTS_SQL = f"""WITH {POLES_SQL}, two AS (
  SELECT (o + 2)::INT AS ord, (2 * c + place)::INT AS idx, a1 / 2 + CASE WHEN inner_ < 0 THEN 0 ELSE sign * sqrt(abs(inner_)) / 2 END AS re, CASE WHEN inner_ < 0 THEN sign * sqrt(abs(inner_)) / 2 ELSE 0 END AS im
  FROM (SELECT o, c, a1, a1 * a1 + 4 * a2 AS inner_ FROM recursion), (VALUES (0, 1), (1, -1)) v(place, sign))"""


@query(f"{_ROOTS_SQL} SELECT ord, idx, {_rounds(8, re='re', im='im')} FROM two a WHERE im <> 0 AND re * re + im * im <= 1 AND NOT EXISTS (SELECT 1 FROM two b WHERE b.ord = a.ord AND b.idx < a.idx AND b.im <> 0 AND sqrt((a.re - b.re) ** 2 + (a.im + b.im) ** 2) <= 1e-8 + 1e-5 * sqrt(b.re ** 2 + b.im ** 2))")
def roots_without_conjugates(spark, sf_dir):
    return rounded(identify.without_conjugates(identify.ar_roots(_centred(spark, sf_dir), DAY)), 8, "re", "im")


@query(f"{_ROOTS_SQL} SELECT ord, idx, {_rounds(8, re='re', im='im')} FROM two a WHERE im <> 0 AND NOT EXISTS (SELECT 1 FROM two b WHERE b.ord = a.ord AND b.idx < a.idx AND b.re = a.re AND b.im = -a.im)")
def roots_without_exact_conjugates(spark, sf_dir):
    return rounded(identify.without_conjugates(identify.ar_roots(_centred(spark, sf_dir), DAY), exact=True), 8, "re", "im")


@query(
    f"""WITH {PANEL}, {_WELCH}, {_corr_sql(H, 1, 6)}, welch AS (SELECT channel, ref, lag, sum({_CFP}) / {LINES * LINES} AS r FROM psd, (SELECT unnest(range({LINES // 2 + 1}))::INT AS lag) GROUP BY channel, ref, lag)
SELECT 'blackman-tukey' AS method, false AS is_last, channel, ref, lag, 3600.0::DOUBLE * lag AS tau, {_rounds(1, r='r')} FROM corr
UNION ALL SELECT 'welch', true, channel, ref, lag, 3600.0::DOUBLE * lag, {_rounds(1, r='r')} FROM welch"""
)
def correlations_by_method(spark, sf_dir):
    """Spectra asked for after correlations, without a method, come from the method used last; here Welch's is named, so its correlations are the current ones."""
    found = Estimates(_centred(spark, sf_dir), REFS, panel.hours(spark, sf_dir), RATE)
    found.correlation(6)
    found.psd(LINES, "welch")
    return rounded(found.correlations(), 1, "r").withColumn("tau", F.round("tau", 6))


@query(f"WITH {PANEL} SELECT channel, {_rounds(2, power='avg(y * y)')} FROM centred GROUP BY channel")
def random_phase_power(spark, sf_dir):
    """A record of random phases with the panel's spectra has the panel's power."""
    y, hours = _centred(spark, sf_dir), panel.hours(spark, sf_dir)
    lines = longfft.transform(y.select("setup", "channel", "n", F.col("y").alias("re"), F.lit(0.0).alias("im")), ["setup", "channel"], hours)
    return rounded(longfft.random_phases(lines, hours, seed=1).groupBy("channel").agg(F.avg(F.col("y") * F.col("y")).alias("power")), 2, "power")


_NORM = "sqrt(list_inner_product(p.phi_re, p.phi_re) + list_inner_product(p.phi_im, p.phi_im))"


@query(
    f"""WITH {POLES_SQL}, {_SHAPES}, {_PAIRS}, chosen AS (SELECT ord, idx FROM poles WHERE ord % 5 = 3 UNION SELECT 10, 0)
SELECT (row_number() OVER (ORDER BY c.f, ord, idx) - 1)::INT AS mode, ord, idx, {_rounds(6, f='c.f', d='c.d', mpc='mpc', first_part=f'p.phi_re[1] / {_NORM}', shrinks='ln(p.lam_re ** 2 + p.lam_im ** 2) / 2')}
FROM criteria c JOIN chosen USING (ord, idx) JOIN (SELECT ord, idx, phi_re, phi_im, lam_re, lam_im FROM poles) p USING (ord, idx)"""
)
def modal_values_of_scaled(spark, sf_dir):
    """The caller's own scale of shapes (here to length 1) and own values beside the modal ones."""

    def to_length_one(re, im):
        square = lambda parts: F.aggregate(parts, F.lit(0.0), lambda s, x: s + x * x)
        size = F.sqrt(square(re) + square(im))
        return F.transform(re, lambda x: x / size), F.transform(im, lambda x: x / size)

    poles = identify.rescaled(_poles(spark, sf_dir), to_length_one)
    own = {"first_part": F.element_at("phi_re", 1), "shrinks": F.log(F.col("lam_re") ** 2 + F.col("lam_im") ** 2) / 2}
    found = stabil.modal_values(poles, _selection(spark, sf_dir), own)
    return rounded(found, 6, "f", "d", "mpc", "first_part", "shrinks").drop("mp", "mpd", "d_mp", "d_mpd")
