"""SQL of the queries in ``long_signals``."""

from __future__ import annotations

from wavecut.plans import oracles as B
from wavecut.plans.long_signals import ABS_FRACTIONS, FRACTIONS, PRIME, SLICES
from wavecut.plans.signal import SMALL

O: dict[str, str] = {}
r = B.r

O["stream_state_stats"] = B._per_segment(B._STATS20, "sig", B._signal(B.SHORT)).replace(
    "SELECT seg,\n", "SELECT seg, count(*) AS n, 0::BIGINT AS rank_error,\n"
)
O["segment_source"] = f"WITH {B._signal(B.SHORT)} SELECT 1::BIGINT AS \"set\", {B.LABEL} AS name, no, {r('x', 'x')} FROM sig"
O["segment_source_keys"] = f"""WITH {B._signal(B.SHORT)}
SELECT {B.LABEL} AS name, seg * 10 AS seg, count(*) AS n, {r('avg(x)', 'x_avg')}, max(no) AS last
FROM sig WHERE seg % 3 = 1 GROUP BY seg"""

_decay = {s: 1 - 2 / (s + 1) for s in SMALL.ewma_spans}
_ewma = [
    r(f"sum(b.x * power({d!r}::DOUBLE, a.no - b.no)) / sum(power({d!r}::DOUBLE, a.no - b.no))", f"ewma_{s}") for s, d in _decay.items()
]
O["ewma_series"] = f"""WITH {B._signal()}
SELECT a.seg, a.no, {', '.join(_ewma)} FROM sig a JOIN sig b ON a.seg = b.seg AND b.no <= a.no GROUP BY a.seg, a.no"""


def _frame(f: str, w: int) -> str:
    return f"CASE WHEN no >= {w} THEN {f}(x) OVER (PARTITION BY seg ORDER BY no ROWS {w - 1} PRECEDING) END"


_rolled = [r(_frame("avg", w), f"ma_{w}") for w in SMALL.mean_widths] + [r(_frame("stddev_samp", w), f"sd_{w}") for w in SMALL.std_widths]
O["rolling_series"] = f"WITH {B._signal()} SELECT seg, no, {', '.join(_rolled)} FROM sig"
_running = "sum(x) OVER (PARTITION BY seg ORDER BY no)"
O["cumulative_series"] = f"WITH {B._signal()} SELECT seg, no, {r(_running, 'cum_sum')} FROM sig"

O["fft_long"], O["envelope_long"] = B.O["fft_mag_stats"], B.O["envelope_mean"]
for _new, _old in (("fft_chirp", "fft_mag_stats"), ("envelope_chirp", "envelope_mean")):
    O[_new] = B.O[_old].replace(B._full(), B._full(PRIME))

_q = [r(f"quantile_disc(x, {p})", f"x_{n}") for n, p in FRACTIONS.items()]
_q += [r(f"quantile_disc(abs(x), {p})", f"xa_{n}") for n, p in ABS_FRACTIONS.items()]
O["sketch_quantiles"] = f"""WITH {B._signal()}
SELECT seg, no // {SMALL.bucket} AS seq, count(*) AS n, {', '.join(_q)} FROM sig GROUP BY 1, 2
UNION ALL BY NAME SELECT seg, -1 AS seq, count(*) AS n, {', '.join(_q)} FROM sig GROUP BY 1"""

_ranges = [("first_{0}", "no <= {0}", s) for s in SMALL.head_tail] + [("last_{0}", "no > n - {0}", s) for s in SMALL.head_tail]
_parts = [(name.format(s), where.format(s)) for name, where, s in _ranges] + [(f"{a}-{b}", f"no BETWEEN {a} AND {b}") for a, b in SLICES]
O["range_stats"] = f"""WITH {B._signal()}, ns AS (SELECT *, count(*) OVER (PARTITION BY seg) AS n FROM sig),
pr(part, a) AS (VALUES {', '.join(f"('{p}', {i})" for i, (p, _) in enumerate(_parts))}),
hit AS (SELECT seg, CASE {' '.join(f'WHEN a = {i} THEN {w}' for i, (_, w) in enumerate(_parts))} END AS inside, part, x FROM ns, pr)
SELECT seg || '/' || part AS id, count(x) FILTER (inside) AS n, {r('avg(x) FILTER (inside)', 'avg')}, {r('stddev_samp(x) FILTER (inside)', 'std')},
       {r('min(x) FILTER (inside)', 'min')}, {r('max(x) FILTER (inside)', 'max')} FROM hit GROUP BY seg, part"""

O["running_features"] = f"""WITH {B._signal(B.SHORT)},
st AS (SELECT *, lag(x) OVER (PARTITION BY seg ORDER BY no) AS before FROM sig),
sg AS (SELECT seg, sign(x) <> lag(sign(x)) OVER (PARTITION BY seg ORDER BY no) AS crossed FROM sig WHERE x <> 0),
cr AS (SELECT seg, count(*) FILTER (crossed) AS crossings FROM sg GROUP BY seg)
SELECT st.seg, count(*) AS n, {r('sum(x * x)', 'energy')}, {r('max(abs(x))', 'peak')},
       coalesce(max(cr.crossings), 0)::DOUBLE AS crossings, {r('coalesce(sum(abs(x - before)), 0)', 'travel')}
FROM st LEFT JOIN cr ON cr.seg = st.seg GROUP BY st.seg"""

ORACLES = O
