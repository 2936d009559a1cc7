"""The registered queries as plain SQL over the same tables, for checking results.

Each text states its operator from the definition (cosine sums, sliding frames,
direct recurrences), not the way the Spark side computes it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from wavecut.operators.stats import ABS_QUANTILES, ABS_TAILS, FIVE_POINT, SIGNED_QUANTILES, TAILS
from wavecut.plans.signal import SMALL

L = SMALL.seg_len
SHORT = 300
NSEG = f"(SELECT count(*) // {L} FROM events)"
CUT = f"(SELECT (count(*) // {L}) * 3 // 4 FROM events)"


def _signal(seg_len: int = L) -> str:
    return f"""sig AS (
  SELECT event_id AS uid, event_id + 1 AS idx, event_id // {seg_len} AS seg, event_id % {seg_len} + 1 AS no,
         value - 50.0 AS x,
         CAST(86400 - extract('hour' FROM ts) * 3600 - extract('minute' FROM ts) * 60
              - extract('second' FROM ts) AS DOUBLE) AS y
  FROM events)"""


def _full(seg_len: int = L) -> str:
    return f"""{_signal(seg_len)},
fs AS (SELECT * FROM sig WHERE seg < (SELECT count(*) // {seg_len} FROM events))"""


LABEL = "concat('raw_', lpad(CAST(seg AS VARCHAR), CAST(greatest(4, length(CAST(seg AS VARCHAR))) AS INTEGER), '0'))"


def r(expr: str, name: str) -> str:
    return f"round({expr}, 6) AS {name}"


def cols(exprs: Mapping[str, str]) -> str:
    return ",\n  ".join(r(e, n) for n, e in exprs.items())


def _q(value: str, prefix: str, fractions: Mapping[str, float]) -> dict[str, str]:
    return {f"{prefix}_{k}": f"quantile_cont({value}, {p})" for k, p in fractions.items()}


# x with its deviation from the mean (d), |x| (xa) with its own (da)
_CENTRED = """cx AS (
  SELECT *, x - avg(x) OVER (PARTITION BY seg) AS d, abs(x) AS xa,
         abs(x) - avg(abs(x)) OVER (PARTITION BY seg) AS da
  FROM {src})"""


def _skew(d: str) -> str:
    return f"avg(power({d}, 3)) / power(avg(power({d}, 2)), 1.5)"


def _kurt(d: str) -> str:
    return f"avg(power({d}, 4)) / power(avg(power({d}, 2)), 2) - 3"


def _g1(d: str, n: str = "count(*)") -> str:
    return f"({_skew(d)}) * sqrt(CAST({n} AS DOUBLE) * ({n} - 1)) / ({n} - 2)"


def _g2(d: str, n: str = "count(*)") -> str:
    return f"(({n} + 1) * ({_kurt(d)}) + 6) * ({n} - 1.0) / (({n} - 2.0) * ({n} - 3.0))"


def _moments(prefix: str, v: str, d: str) -> dict[str, str]:
    return {
        f"{prefix}_avg": f"avg({v})", f"{prefix}_std": f"stddev_samp({v})", f"{prefix}_skew": _skew(d),
        f"{prefix}_kurt": _kurt(d), f"{prefix}_max": f"max({v})",
    }


_BASE = {**_moments("x", "x", "d"), **_moments("xa", "xa", "da")}
_STATS20 = {**_BASE, **_q("x", "x", FIVE_POINT), **_q("xa", "xa", FIVE_POINT)}
_STATS36 = {
    **_BASE, "x_min": "min(x)", "xa_min": "min(xa)", "x_range": "max(x) - min(x)",
    **_q("x", "x", {**FIVE_POINT, **TAILS}), **_q("xa", "xa", {**FIVE_POINT, **ABS_TAILS}),
}


def _per_segment(exprs: Mapping[str, str], src: str = "sig", head: str | None = None) -> str:
    return f"WITH {head or _signal()},\n{_CENTRED.format(src=src)}\nSELECT seg,\n  {cols(exprs)}\nFROM cx GROUP BY seg"


O: dict[str, str] = {}

# ------------------------------------------------------------- segmentation
O["segment_index"] = f"""
SELECT event_id AS uid, idx, (idx - 1) // {L} AS seg, (idx - 1) % {L} + 1 AS no
FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) AS idx FROM events)"""
O["segment_complete"] = f"""WITH {_signal(SHORT)}
SELECT seg, count(*) AS n FROM sig GROUP BY seg HAVING count(*) <> {SHORT}"""
O["segment_label"] = f"WITH {_signal()} SELECT uid, {LABEL} AS name FROM sig"
O["point_target"] = f"WITH {_signal()} SELECT seg, {r('y', 'y')} FROM sig WHERE no = {L}"
_points = {f"y{i}": f"max(y) FILTER (WHERE no = {p})" for i, p in enumerate(SMALL.target_positions)}
_wanted = ", ".join(str(p) for p in SMALL.target_positions)
O["multi_target_pivot"] = f"""WITH {_signal()}
SELECT seg, {cols(_points)} FROM sig GROUP BY seg
HAVING count(*) FILTER (WHERE no IN ({_wanted})) = {len(SMALL.target_positions)}"""
O["last_value"] = f"""WITH {_signal(SHORT)}
SELECT seg, count(*) AS n, {r('arg_max(y, no)', 'y')} FROM sig GROUP BY seg"""
O["systematic_sample"] = f"""WITH {_signal()}
SELECT uid, {r('x', 'x')}, {r('y', 'y')} FROM sig WHERE (idx - 1) % {SMALL.sample_step} = 0"""
O["holdout_split"] = f"""WITH {_full()}
SELECT CASE WHEN seg < {CUT} THEN 'train' ELSE 'holdout' END AS part, seg, count(*) AS n, {r('avg(y)', 'y_avg')}
FROM fs GROUP BY 1, 2"""
O["set_union"] = f"""WITH {_full()}
SELECT uid, CAST(0 AS BIGINT) AS "set", seg, no, {LABEL} AS name, {r('x', 'x')}, {r('y', 'y')} FROM fs WHERE seg < {CUT}
UNION ALL
SELECT uid, 1, seg, no, {LABEL}, round(x, 6), CAST(NULL AS DOUBLE) FROM fs WHERE seg >= {CUT}"""
O["key_semi_join"] = f"""WITH {_signal()},
named AS (SELECT *, {LABEL} AS name FROM sig),
keys AS (SELECT name FROM named GROUP BY name HAVING arg_max(y, no) > 43200)
SELECT name, count(*) AS n, {r('avg(x)', 'x_avg')} FROM named WHERE name IN (SELECT name FROM keys) GROUP BY name"""
O["row_id_range"] = "SELECT max(event_id) AS m FROM events"
O["position_slice"] = f"WITH {_signal()} SELECT uid, seg, no, {r('x', 'x')} FROM sig WHERE no BETWEEN 50 AND 100"
O["segment_position"] = f"""WITH {_signal()}
SELECT uid, seg, row_number() OVER (PARTITION BY seg ORDER BY uid) AS no FROM sig"""
O["cast_key_join"] = f"""WITH {_signal()},
c AS (SELECT CAST(seg AS VARCHAR) AS seg, count(*) AS n FROM sig GROUP BY 1)
SELECT CAST(c.seg AS BIGINT) AS seg, n, {r('y', 'y')} FROM c JOIN sig ON CAST(c.seg AS BIGINT) = sig.seg AND no = {L}"""

# --------------------------------------------------------------- statistics
O["moment_stats"] = _per_segment({**_BASE, "x_min": "min(x)", "xa_min": "min(xa)", "x_range": "max(x) - min(x)"})
O["adjusted_moments"] = _per_segment({"std_pop": "stddev_pop(x)", "skew": _g1("d"), "kurt": _g2("d")})
O["stats20"] = _per_segment(_STATS20)
O["percentile_stats"] = _per_segment({"x_avg": "avg(x)", **_q("x", "x", TAILS), **_q("xa", "xa", ABS_TAILS)})
O["stats36"] = _per_segment(_STATS36)
_order = [
    *(f"x_{s}" for s in ("avg", "std", "skew", "kurt", "max")),
    *(f"xa_{s}" for s in ("avg", "std", "skew", "kurt", "max")),
    *(f"x_{k}" for k in FIVE_POINT), *(f"xa_{k}" for k in FIVE_POINT),
]
O["scaled_stats"] = f"""WITH {_full()},
{_CENTRED.format(src='fs')},
st AS (SELECT seg, {', '.join(f'{_STATS20[n]} AS {n}' for n in _order)} FROM cx GROUP BY seg),
lng AS ({' UNION ALL '.join(f'SELECT seg, CAST({i} AS BIGINT) AS pos, {n} AS v FROM st' for i, n in enumerate(_order))}),
sd AS (SELECT pos, stddev_samp(v) AS s FROM lng WHERE seg < {CUT} GROUP BY pos)
SELECT seg, pos, {r('CASE WHEN s > 0 THEN v / s ELSE 0.0 END', 'v')} FROM lng JOIN sd USING (pos)"""
O["abs_quantiles"] = _per_segment(
    {
        **{f"abs_q{p:02d}": f"quantile_cont(xa, {p / 100})" for p in ABS_QUANTILES},
        **{f"q{p:02d}": f"quantile_cont(x, {p / 100})" for p in SIGNED_QUANTILES},
    }
)
O["iqr_median"] = _per_segment({"iqr": "quantile_cont(x, 0.75) - quantile_cont(x, 0.25)", "med": "median(x)"})
O["mean_abs_dev"] = _per_segment({"mad": "avg(abs(d))"})
O["mean_abs_dev_tail"] = _per_segment({"mad": "avg(abs(d))"}, "sig", _signal(SHORT))
O["trend_slope"] = _per_segment({"trend": "regr_slope(x, no)", "abs_trend": "regr_slope(xa, no)"})
_counted = f"{_full()},\nns AS (SELECT *, count(*) OVER (PARTITION BY seg) AS n FROM fs)"


def _head_tail() -> dict[str, str]:
    return {
        f"{stat}_{side}_{size}": f"{agg}(x) FILTER (WHERE {cond})"
        for stat, agg in (("std", "stddev_samp"), ("avg", "avg"), ("min", "min"), ("max", "max"))
        for size in SMALL.head_tail
        for side, cond in (("first", f"no <= {size}"), ("last", f"no > n - {size}"))
    }


O["head_tail_stats"] = f"WITH {_counted}\nSELECT seg, {cols(_head_tail())} FROM ns GROUP BY seg"
_bucket = f"""SELECT seg, no // {SMALL.bucket} AS seq, avg(x) AS x_avg, quantile_cont(x, 0.02) AS x_p02,
  quantile_cont(x, 0.98) AS x_p98, quantile_cont(abs(x), 0.95) AS xa_p95"""
O["bucket_stats"] = f"""WITH {_signal()}, b AS ({_bucket} FROM sig GROUP BY 1, 2)
SELECT seg, seq, {', '.join(r(c, c) for c in ('x_avg', 'x_p02', 'x_p98', 'xa_p95'))} FROM b"""
_inner = {
    **{f"xp{k[1:]}": f"quantile_cont(x, {p})" for k, p in TAILS.items()},
    **{f"xap{k[1:]}": f"quantile_cont(abs(x), {p})" for k, p in ABS_TAILS.items()},
}
_two_level = f"""WITH {_signal()},
inn AS (SELECT seg, no // {SMALL.bucket} AS seq, {', '.join(f'{e} AS {n}' for n, e in _inner.items())}
        FROM sig GROUP BY 1, 2),
dev AS (SELECT *, {', '.join(f'{n} - avg({n}) OVER (PARTITION BY seg) AS d_{n}' for n in _inner)} FROM inn)"""
_outer = {
    f"{n}_{s}": e
    for n in _inner
    for s, e in (
        ("avg", f"avg({n})"), ("std", f"stddev_samp({n})"), ("skew", _skew(f"d_{n}")),
        ("kurt", _kurt(f"d_{n}")), ("max", f"max({n})"), ("min", f"min({n})"),
    )
}
_base6 = {**_moments("x", "x", "d"), "x_min": "min(x)", **_q("x", "x", TAILS), **_q("xa", "xa", ABS_TAILS)}
O["two_level_percentiles"] = f"""{_two_level},
{_CENTRED.format(src='sig')},
base AS (SELECT seg, {cols(_base6)} FROM cx GROUP BY seg),
outr AS (SELECT seg, {cols(_outer)} FROM dev GROUP BY seg)
SELECT * FROM base JOIN outr USING (seg)"""
_stds = [f"stddev_samp(xap{k[1:]})" for k in ABS_TAILS]
O["std_max_mean"] = f"""{_two_level}
SELECT seg, {r(f"greatest({', '.join(_stds)})", 'xaSTD_max')}, {r(f"({' + '.join(_stds)}) / 5", 'xaAVG')}
FROM dev GROUP BY seg"""

# ------------------------------------------------------------------ packing
_SLICES = f"""sl AS (
  SELECT seg, s AS slice, no, x, row_number() OVER (PARTITION BY seg, s ORDER BY no) - 1 AS pos
  FROM fs JOIN range({SMALL.n_slices}) AS t(s) ON no BETWEEN s * {SMALL.slice_len} AND (s + 1) * {SMALL.slice_len})"""
O["pack_slices"] = f"WITH {_full()},\n{_SLICES}\nSELECT seg, slice, pos, {r('x', 'x')} FROM sl"
O["pack_bucket_stats"] = f"""WITH {_full()}, b AS ({_bucket} FROM fs GROUP BY 1, 2)
SELECT seg, row_number() OVER (PARTITION BY seg ORDER BY seq) - 1 AS pos, {r('x_avg', 'stx1')}, {r('x_p02', 'stx2')},
  {r('x_p98', 'stx3')}, {r('xa_p95', 'stx4')} FROM b"""

_bs = ("x_avg", "x_p02", "x_p98", "xa_p95")
O["scaled_bucket_stats"] = f"""WITH {_full()}, b AS ({_bucket} FROM fs GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY seg ORDER BY seq) - 1 AS pos FROM b),
sd AS (SELECT pos, {', '.join(f'stddev_samp({c}) AS s_{c}' for c in _bs)} FROM o GROUP BY pos)
SELECT seg, pos, {', '.join(
    r(f'CASE WHEN s_{c} > 0 THEN {c} / s_{c} ELSE 0.0 END', f'stxn{i}') for i, c in enumerate(_bs, start=1))}
FROM o JOIN sd USING (pos)"""


# ------------------------------------------------------------------ rolling
def _frame(agg: str, value: str, w: int) -> str:
    """Sliding aggregate, NULL on incomplete frames."""
    return (
        f"CASE WHEN no >= {w} THEN {agg}({value}) OVER "
        f"(PARTITION BY seg ORDER BY no ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW) END"
    )


def _rolled(means: Sequence[int], stds: Sequence[int], exprs: Mapping[str, str]) -> str:
    frames = [f"{_frame('avg', 'x', w)} AS m_{w}" for w in means]
    frames += [f"{_frame('stddev_samp', 'x', w)} AS s_{w}" for w in stds]
    return f"WITH {_full()},\nro AS (SELECT seg, {', '.join(frames)} FROM fs)\nSELECT seg, {cols(exprs)} FROM ro GROUP BY seg"


_MA = {f"ma_{w}_mean": f"avg(m_{w})" for w in SMALL.mean_widths}
_MS = {f"ma_{w}_std_mean": f"avg(s_{w})" for w in SMALL.std_widths}
_m0 = SMALL.mean_widths[0]
_BB = {
    f"bb_{w}_{side}_mean": f"avg(m_{_m0}) {sign} 2 * avg(s_{w})"
    for w in SMALL.std_widths[:2]
    for side, sign in (("high", "+"), ("low", "-"))
}
_EX = {}
for _w in SMALL.extrema_widths:
    _EX[f"abs_max_roll_mean_{_w}"] = f"max(abs(m_{_w}))"
    _EX[f"abs_max_roll_std_{_w}"] = f"max(abs(s_{_w}))"
O["rolling_mean"] = _rolled(SMALL.mean_widths, (), _MA)
O["rolling_std"] = _rolled((), SMALL.std_widths, _MS)
O["bollinger"] = _rolled((_m0,), SMALL.std_widths[:2], _BB)
O["roll_extrema"] = _rolled(SMALL.extrema_widths, SMALL.extrema_widths, _EX)


def _ewma(span: int) -> str:
    g = f"(1 - 2.0 / ({span} + 1.0))"
    return f"""SELECT seg, avg(num / den) AS v FROM (
    SELECT a.seg, a.no, sum(b.x * power({g}, a.no - b.no)) AS num, sum(power({g}, a.no - b.no)) AS den
    FROM fs a JOIN fs b ON a.seg = b.seg AND b.no <= a.no GROUP BY a.seg, a.no) GROUP BY seg"""


O["ewma_mean"] = f"WITH {_full()}" + "".join(
    f",\ne{s} AS ({_ewma(s)})" for s in SMALL.ewma_spans
) + "\nSELECT seg, " + ", ".join(r(f"e{s}.v", f"ewma_{s}_mean") for s in SMALL.ewma_spans) + " FROM " + " JOIN ".join(
    f"e{s}" if i == 0 else f"e{s} USING (seg)" for i, s in enumerate(SMALL.ewma_spans)
)


def _energy(w: int) -> str:
    return f"sum(x * x) OVER (PARTITION BY seg ORDER BY no ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW) / {w}"


O["sta_lta"] = f"""WITH {_full()},
ra AS (SELECT seg, {', '.join(
    f"CASE WHEN no >= {l} THEN ({_energy(s)}) / greatest({_energy(l)}, 2.2250738585072014e-308) ELSE 0 END AS r{i}"
    for i, (s, l) in enumerate(SMALL.sta_lta))} FROM fs)
SELECT seg, {', '.join(r(f'avg(r{i})', f'sta_lta{i + 1}_mean') for i in range(len(SMALL.sta_lta)))} FROM ra GROUP BY seg"""
O["autocorrelation"] = f"""WITH {_full()},
{_CENTRED.format(src='fs')},
la AS (SELECT seg, d, {', '.join(f'lag(d, {k}) OVER (PARTITION BY seg ORDER BY no) AS d{k}' for k in SMALL.lags)} FROM cx)
SELECT seg, {', '.join(
    r(f'sum(d * d{k}) / ((count(*) - {k}) * avg(d * d))', f'autocorrelation_{k}') for k in SMALL.lags)}
FROM la GROUP BY seg"""


def _rates() -> dict[str, str]:
    out = {}
    for size in SMALL.head_tail:
        for side, cond, shift in (
            ("first", f"no < {size}", "0"), ("last", f"no > n - {size} AND no < n", f"greatest(n - {size}, 0)"),
        ):
            out[f"nonzero_rate_pos_mean_{side}_{size}"] = (
                f"avg(no - 1 - ({shift})) FILTER (WHERE {cond} AND NOT (nx = x AND x <> 0))"
            )
            out[f"mean_rate_{side}_{size}"] = f"avg((nx - x) / x) FILTER (WHERE {cond} AND x <> 0)"
    return out


O["change_rate"] = f"""WITH {_full()},
nx AS (SELECT seg, no, x, lead(x) OVER (PARTITION BY seg ORDER BY no) AS nx, count(*) OVER (PARTITION BY seg) AS n FROM fs)
SELECT seg, {cols(_rates())} FROM nx GROUP BY seg"""


def _hann(w: int) -> str:
    """Direct same-size convolution with w taps, averaged over the segment."""
    start = (w - 1) // 2
    tap = f"(0.5 - 0.5 * cos(2 * pi() * k / {w - 1}))"
    return f"""SELECT seg, sum(x * {tap}) / {(w - 1) / 2} / max(n) AS v
    FROM ns JOIN range({w}) AS t(k) ON no - 1 + k - {start} BETWEEN 0 AND n - 1 GROUP BY seg"""


O["hann_mean"] = f"WITH {_counted}" + "".join(f",\nh{w} AS ({_hann(w)})" for w in SMALL.hann) + "\nSELECT seg, " + ", ".join(
    r(f"h{w}.v", f"hann_{w}_mean") for w in SMALL.hann
) + " FROM " + " JOIN ".join(f"h{w}" if i == 0 else f"h{w} USING (seg)" for i, w in enumerate(SMALL.hann))


# ----------------------------------------------------------------- spectral
_ALL = f"""{_full()},
{_SLICES},
al AS (SELECT seg, x, row_number() OVER (PARTITION BY seg ORDER BY slice, no) - 1 AS j, count(*) OVER (PARTITION BY seg) AS n FROM sl)"""


def _dct(source: str, group: str, limit: str) -> str:
    """Orthonormal cosine sums of the rows (j, n, x) of each group."""
    return f"""SELECT {group}, k,
    sum(x * cos(pi() * k * (2 * j + 1) / (2.0 * n))) * CASE WHEN k = 0 THEN sqrt(1.0 / max(n)) ELSE sqrt(2.0 / max(n)) END AS v
  FROM {source} JOIN range({limit}) AS t(k) ON k < n GROUP BY {group}, k"""


_whole_len = SMALL.n_slices * SMALL.slice_len + SMALL.n_slices - 1
_SPEC = f"{_ALL},\nsp AS ({_dct('al', 'seg', str(SMALL.cut))})"
_SCALED = f"""{_SPEC},
sd AS (SELECT k, stddev_samp(v) AS s FROM sp WHERE seg < {CUT} GROUP BY k),
sc AS (SELECT seg, k, CASE WHEN s > 0 THEN v / s ELSE 0.0 END AS v FROM sp JOIN sd USING (k))"""
O["dct_coeffs"] = f"WITH {_ALL},\nsp AS ({_dct('al', 'seg', str(_whole_len))})\nSELECT seg, k, {r('v', 'v')} FROM sp"
O["low_freq_cut"] = f"WITH {_SPEC}\nSELECT seg, k, {r('v', 'v')} FROM sp"
O["unit_scale"] = f"WITH {_SCALED}\nSELECT seg, k, {r('v', 'v')} FROM sc"
_ms = {**_BASE, "x_min": "min(x)", "xa_min": "min(xa)", "x_range": "max(x) - min(x)"}
O["standard_scale"] = f"""WITH {_full()},
{_CENTRED.format(src='fs')},
st AS (SELECT seg, {', '.join(f'{e} AS {n}' for n, e in _ms.items())} FROM cx GROUP BY seg),
fit AS (SELECT {', '.join(f'avg({n}) AS m_{n}, stddev_pop({n}) AS s_{n}' for n in _ms)} FROM st WHERE seg < {CUT})
SELECT seg, {', '.join(r(f'({n} - m_{n}) / CASE WHEN s_{n} > 0 THEN s_{n} ELSE 1 END', n) for n in _ms)} FROM st, fit"""
_b = SMALL.bands
_BANDS = f"""{_SCALED},
bd AS (SELECT seg, b AS band, sum(abs(v)) / {_b['divisor']} AS v
  FROM sc JOIN range({_b['count']}) AS t(b) ON k >= b * {_b['step']} AND k < b * {_b['step']} + {_b['width']} GROUP BY seg, b)"""
O["band_means"] = f"WITH {_BANDS}\nSELECT seg, band, {r('v', 'v')} FROM bd"
O["band_slice"] = f"""WITH {_BANDS}
SELECT seg, band - {SMALL.band_slice[0]} AS pos, {r('v', 'v')} FROM bd
WHERE band BETWEEN {SMALL.band_slice[0]} AND {SMALL.band_slice[1]}"""
_w = SMALL.window_bands
_WBANDS = f"""{_full()},
{_SLICES},
wn AS (SELECT seg, w AS win, x, row_number() OVER (PARTITION BY seg, w ORDER BY slice, no) - 1 AS j,
              count(*) OVER (PARTITION BY seg, w) AS n
       FROM sl JOIN range({SMALL.n_windows}) AS t(w) ON slice BETWEEN w AND w + {SMALL.per_window - 1}),
sp AS ({_dct('wn', 'seg, win', str(SMALL.window_cut))}),
sd AS (SELECT win, k, stddev_samp(v) AS s FROM sp WHERE seg < {CUT} GROUP BY win, k),
sc AS (SELECT seg, win, k, CASE WHEN s > 0 THEN v / s ELSE 0.0 END AS v FROM sp JOIN sd USING (win, k)),
wb AS (SELECT seg, win, b AS band, sum(abs(v)) / {_w['divisor']} AS v
  FROM sc JOIN range({_w['count']}) AS t(b) ON k >= b * {_w['step']} AND k < b * {_w['step']} + {_w['width']}
  GROUP BY seg, win, b)"""
O["window_band_means"] = f"WITH {_WBANDS}\nSELECT seg, win, band, {r('v', 'v')} FROM wb"
_f, _l = SMALL.wide_band_slice
O["window_concat"] = f"""WITH {_WBANDS}
SELECT seg, win * {_l - _f + 1} + band - {_f} AS pos, {r('v', 'v')} FROM wb WHERE band BETWEEN {_f} AND {_l}"""
_a, _e = SMALL.fft_bins
O["fft_mag_stats"] = f"""WITH {_counted},
mg AS (SELECT seg, k, max(n) AS n, sqrt(power(sum(x * cos(2 * pi() * k * (no - 1) / n)), 2)
                         + power(sum(x * sin(2 * pi() * k * (no - 1) / n)), 2)) AS m
       FROM ns JOIN range({L}) AS t(k) ON k < n AND ((k >= {_a} AND k < {_e}) OR k >= n - {SMALL.fft_last}) GROUP BY seg, k),
ba AS (SELECT seg, m, m - avg(m) OVER (PARTITION BY seg) AS d FROM mg WHERE k >= {_a} AND k < {_e}),
la AS (SELECT seg, m - avg(m) OVER (PARTITION BY seg) AS d FROM mg WHERE k >= n - {SMALL.fft_last}),
lb AS (SELECT seg, {r(_g1('d'), 'fft_mag_skew_last')} FROM la GROUP BY seg),
bb AS (SELECT seg, {cols({
    'fft_mag_mean': 'avg(m)', 'fft_mag_std': 'stddev_pop(m)', 'fft_mag_kurt': _g2('d'), 'fft_mag_skew': _g1('d'),
    'fft_mag_max': 'max(m)', 'fft_mag_median': 'median(m)'})} FROM ba GROUP BY seg)
SELECT * FROM bb JOIN lb USING (seg)"""
_half = L // 2
O["envelope_mean"] = f"""WITH {_counted},
ft AS (SELECT seg, k, sum(x * cos(2 * pi() * k * (no - 1) / n)) AS re, -sum(x * sin(2 * pi() * k * (no - 1) / n)) AS im
       FROM ns JOIN range(1, {_half}) AS t(k) ON 2 * k < n GROUP BY seg, k),
hi AS (SELECT ns.seg, ns.no, any_value(x) AS x,
              2.0 / max(n) * sum(re * sin(2 * pi() * k * (no - 1) / n) + im * cos(2 * pi() * k * (no - 1) / n)) AS h
       FROM ns JOIN ft ON ns.seg = ft.seg GROUP BY ns.seg, ns.no)
SELECT seg, {r('avg(sqrt(x * x + h * h))', 'envelope_mean')} FROM hi GROUP BY seg"""
_wide_own = {
    "abs_max": "max(xa)", "abs_mean": "avg(xa)", "abs_std": "stddev_samp(xa)", "abs_trend": "regr_slope(xa, no)",
    "mad": "avg(abs(d))", "kurt": _g2("d"), "skew": _g1("d"), "med": "median(x)",
    "iqr": "quantile_cont(x, 0.75) - quantile_cont(x, 0.25)",
    **{f"abs_q{p:02d}": f"quantile_cont(xa, {p / 100})" for p in ABS_QUANTILES},
    **{f"q{p:02d}": f"quantile_cont(x, {p / 100})" for p in SIGNED_QUANTILES},
}
_parts = [
    _per_segment(_wide_own, "fs", _full()), O["autocorrelation"], O["head_tail_stats"], O["change_rate"], O["hann_mean"],
    O["sta_lta"], O["rolling_mean"], O["rolling_std"], O["bollinger"], O["roll_extrema"], O["ewma_mean"],
    O["fft_mag_stats"], O["envelope_mean"],
]
O["signal_features"] = "SELECT * FROM " + "\nJOIN ".join(
    f"({q}) AS p{i}" + (" USING (seg)" if i else "") for i, q in enumerate(_parts)
)

# The same over segments of SHORT rows, of which the last is a partial one.
_TAIL = f"{_signal(SHORT)},\nfs AS (SELECT * FROM sig)"
TAIL_QUERIES = (
    "signal_features", "head_tail_stats", "rolling_mean", "rolling_std", "hann_mean", "ewma_mean", "fft_mag_stats", "envelope_mean",
)
for _name in TAIL_QUERIES:
    O[f"{_name}_tail"] = O[_name].replace(_full(), _TAIL)
O["drop_partial"] = f"""WITH {_full(SHORT)} SELECT uid, seg, no, {r('x', 'x')} FROM fs"""

# ----------------------------------------------------------------- assembly
_bf, _bl = SMALL.band_slice
O["feature_join"] = f"""WITH {_BANDS},
{_CENTRED.format(src='fs')},
pv AS (SELECT seg, {', '.join(f'max(v) FILTER (WHERE band = {b}) AS f_{b - _bf}' for b in range(_bf, _bl + 1))} FROM bd GROUP BY seg),
st AS (SELECT seg, avg(x) AS x_avg, stddev_samp(x) AS x_std, quantile_cont(xa, 0.95) AS xa_p9 FROM cx GROUP BY seg),
lb AS (SELECT seg, y AS label FROM fs WHERE no = {L})
SELECT seg, {', '.join(r(c, c) for c in [*(f'f_{i}' for i in range(_bl - _bf + 1)), 'x_avg', 'x_std', 'xa_p9', 'label'])}
FROM pv JOIN st USING (seg) JOIN lb USING (seg)"""
O["suffix_join"] = f"""WITH {_full()},
b AS (SELECT seg, no // {SMALL.bucket} AS seq, avg(x) AS v FROM fs GROUP BY 1, 2),
p AS (SELECT seg, avg(x) AS a, max(x) AS mx, min(x) AS mn, arg_max(y, no) AS t FROM fs GROUP BY seg),
q AS (SELECT seg, avg(v) AS a, max(v) AS mx, min(v) AS mn FROM b GROUP BY seg)
SELECT seg, {r('p.a', 'avg')}, {r('p.mx', 'max')}, {r('p.mn', 'min')}, {r('p.t', 'target')},
  {r('q.a', 'avg_denoised')}, {r('q.mx', 'max_denoised')}, {r('q.mn', 'min_denoised')} FROM p JOIN q USING (seg)"""
O["prediction_diff"] = f"""WITH {_full()},
p AS (SELECT {LABEL} AS seg_id, avg(y) AS a, arg_max(y, no) AS b FROM fs GROUP BY seg)
SELECT seg_id, {r('a', 'prediction_a')}, {r('b', 'prediction_b')}, {r('a - b', 'diff')}, {r('abs(a - b)', 'abs_diff')} FROM p"""
O["sequence_table"] = f"""WITH {_WBANDS},
tg AS ({' UNION ALL '.join(f'SELECT seg, CAST({i} AS BIGINT) AS win, y FROM fs WHERE no = {p}' for i, p in enumerate(SMALL.target_positions))})
SELECT seg, win, {r('y', 'y')}, band - {_bf} AS band, {r('v', 'v')} FROM wb JOIN tg USING (seg, win) WHERE band BETWEEN {_bf} AND {_bl}"""
O["target_normalise"] = f"""WITH {_full()}, t AS (SELECT seg, y FROM fs WHERE no = {L})
SELECT seg, {r(f'y / (SELECT max(y) FROM t WHERE seg < {CUT})', 'y')} FROM t"""
_FP = f"{_full()},\nfp AS (SELECT seg, no % 5 AS fold, avg(y) AS prediction FROM fs GROUP BY 1, 2)"
O["fold_average"] = f"WITH {_FP}\nSELECT seg, {r('avg(prediction)', 'prediction')} FROM fp GROUP BY seg"
O["importance_topk"] = f"""WITH im AS (
  SELECT 'f_' || CAST(user_id AS VARCHAR) AS feature, event_id % 5 AS fold,
         CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) AS importance FROM events GROUP BY 1, 2),
tp AS (SELECT feature FROM im GROUP BY feature ORDER BY avg(importance) DESC, feature LIMIT 50)
SELECT feature, fold, {r('importance', 'importance')} FROM im WHERE feature IN (SELECT feature FROM tp)"""
_FE = f"""{_FP},
lb AS (SELECT seg, arg_max(y, no) AS label FROM fs GROUP BY seg),
fe AS (SELECT fold, abs(label - prediction) AS e FROM fp JOIN lb USING (seg))"""
O["mae"] = f"WITH {_FE}\nSELECT {r('avg(e)', 'mae')} FROM fe"
O["fold_score_summary"] = f"""WITH {_FE}, s AS (SELECT fold, avg(e) AS mae FROM fe GROUP BY fold)
SELECT {r('avg(mae)', 'cv_mean')}, {r('stddev_pop(mae)', 'cv_std')} FROM s"""

# ------------------------------------------------------ learning, streaming
O["kfold_assign"] = f"""WITH {_full()}, s AS (SELECT DISTINCT seg FROM fs)
SELECT seg, (row_number() OVER (ORDER BY substr(md5('42_' || CAST(seg AS VARCHAR)), 1, 15), seg) - 1) % 5 AS fold FROM s"""
O["segment_apply"] = f"""WITH {_signal()}
SELECT seg, CAST(0 AS BIGINT) AS chunk, {r('arg_max(y, no)', 'target')}, {r('sum(x * x)', 'energy')}, {r('max(abs(x))', 'peak')}
FROM sig GROUP BY seg"""
O["segment_apply_tail"] = O["segment_apply"].replace(_signal(), _signal(SHORT))
O["segment_apply_chunks"] = f"""WITH {_signal()}
SELECT seg, (no - 1) // 200 AS chunk, {r('arg_max(y, no)', 'target')}, {r('sum(x * x)', 'energy')}, {r('max(abs(x))', 'peak')}
FROM sig GROUP BY 1, 2"""
O["row_id_offset"] = f"""WITH {_full()}
SELECT CAST(CASE WHEN seg < {CUT} THEN 0 ELSE 1 END AS BIGINT) AS "set", uid AS event_id, row_number() OVER (ORDER BY uid) AS idx FROM fs"""
_numbered = f"SELECT idx, seg, no, {LABEL} AS name, {r('x', 'x')}, {r('y', 'y')} FROM sig"
O["csv_round_trip"] = f"WITH {_signal(SHORT)} {_numbered}"
O["narrow_csv"] = f"WITH {_signal()} SELECT idx, {r('CAST(CAST(round(x) AS SMALLINT) AS DOUBLE) ** 2', 'energy')} FROM sig"
O["signal_table"] = f"""WITH {_signal(SHORT)} SELECT CAST(0 AS BIGINT) AS "set", seg, no, {r('x', 'x')} FROM sig"""
O["compact_batches"] = O["signal_table"]
O["append_twice"] = f"WITH {_signal(SHORT)} SELECT {LABEL} AS name, no, {r('x', 'x')} FROM sig"
O["result_csv"] = f"WITH {_full()} SELECT {LABEL} AS seg_id, {r('avg(y)', 'time_to_failure')} FROM fs GROUP BY seg"
O["named_view"] = f"WITH {_signal()} SELECT seg, count(*) AS n, {r('avg(x)', 'x_avg')} FROM sig GROUP BY seg"
O["feature_csv"] = f"""WITH {_full()}
SELECT {LABEL} AS seg_id, {r('avg(x)', 'x_avg')}, {r('max(x)', 'x_max')} FROM fs GROUP BY seg"""
O["total_order"] = f"""WITH {_signal(SHORT)} SELECT row_number() OVER (ORDER BY seg, no) AS pos, uid FROM sig"""
O["incremental_ingest"] = f"""WITH {_signal(100)}
SELECT CAST(1 AS BIGINT) AS "set", seg, no, {LABEL} AS name, {r('x', 'x')}, CAST(NULL AS DOUBLE) AS y FROM sig"""
O["ingest_batches"] = f"""WITH {_signal(100)}
SELECT count(DISTINCT seg) AS segments, count(*) AS n_rows, 3 <= ceil(count(DISTINCT seg) / 20.0) AS several_batches,
  CAST(0 AS BIGINT) AS added_by_second_run FROM sig"""
O["stream_segment_stats"] = _per_segment(_STATS20)

# Learning: labels, folds and row sets from SQL; what must hold of any right fit is stated as a constant.
_CUT100 = "(SELECT (count(*) // 100) * 3 // 4 FROM events)"
_L100 = f"""{_full(100)},
lb AS (SELECT seg, arg_max(y, no) AS label FROM fs GROUP BY seg)"""
O["forest_predict"] = f"WITH {_L100} SELECT seg, {r('label', 'label')}, TRUE AS inside FROM lb WHERE seg >= {_CUT100}"
_FOLD = "(row_number() OVER (ORDER BY substr(md5('42_' || CAST(seg AS VARCHAR)), 1, 15), seg) - 1) % {k} AS fold"
O["gbt_oof"] = f"WITH {_L100} SELECT seg, {_FOLD.format(k=5)}, {r('label', 'label')}, TRUE AS predicted FROM lb"
O["gbt_importance"] = "SELECT k AS fold, CAST(20 AS BIGINT) AS features, 1.0::DOUBLE AS total, TRUE AS not_negative FROM range(5) AS t(k)"
O["param_search"] = "SELECT t AS trial, f AS fold, TRUE AS positive FROM range(4) AS a(t), range(3) AS b(f)"
_NW = SMALL.n_windows * (_bl - _bf + 1)
O["sequence_regress"] = f"""WITH {_full()},
lb AS (SELECT seg, y / (SELECT max(y) FROM fs WHERE no = {L} AND seg < {CUT}) AS label FROM fs WHERE no = {L}),
tr AS (SELECT count(*) AS n, avg(label) AS m FROM lb WHERE seg < {CUT}),
te AS (SELECT count(*) AS h FROM lb WHERE seg >= {CUT})
SELECT k AS feature, TRUE AS at_minimum, n, {r('m', 'label_mean')}, h AS held FROM range({_NW}) AS t(k), tr, te"""
O["window_regress"] = f"""WITH {_full()},
tg AS ({' UNION ALL '.join(f'SELECT seg, CAST({i} AS BIGINT) AS win, y FROM fs WHERE no = {p}' for i, p in enumerate(SMALL.target_positions))})
SELECT seg, win, {r('y', 'label')}, TRUE AS predicted FROM tg WHERE seg >= {CUT}"""
O["batch_score"] = f"WITH {_L100} SELECT {LABEL} AS seg_id, TRUE AS inside FROM lb WHERE seg >= {_CUT100}"
O["score_saved_models"] = f"WITH {_L100} SELECT {LABEL} AS seg_id, TRUE AS inside, CAST(20 AS BIGINT) AS scaled_columns FROM lb WHERE seg >= {_CUT100}"

ORACLES = O
