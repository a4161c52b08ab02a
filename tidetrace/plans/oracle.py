"""The same queries as SQL over the same tables, for an independent check of the results."""

from __future__ import annotations

from tidetrace.functions.physics import TwoState
from tidetrace.operators import experiments, segments
from tidetrace.operators.consistency import BATCH_ROWS
from tidetrace.operators.scores import EPSILON, poisson_cdf
from tidetrace.plans import queries as q
from tidetrace.plans import views


def dbl(value: float) -> str:
    return f"CAST('{float(value)!r}' AS DOUBLE)"


def r6(expression: str, name: str) -> str:
    return f"round({expression}, 6) AS {name}"


SIGNALS = """
WITH signals AS (
  SELECT user_id AS sample_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS time,
         value AS input_voltage, CAST(json_extract(props, '$.k') AS DOUBLE) AS el_power, ts, event_id
  FROM events)"""

LEVELS = SIGNALS + f""",
levels AS (
  SELECT sample_id, time, input_voltage, CAST(floor(el_power / {views.LEVEL_WIDTH}) AS BIGINT) AS el_power FROM signals)"""

PREDICTIONS = SIGNALS + """,
predictions AS (
  SELECT * FROM (SELECT sample_id, time, el_power AS y_true,
                        lag(el_power) OVER (PARTITION BY sample_id ORDER BY time) AS y_pred FROM signals)
  WHERE y_pred IS NOT NULL)"""

METRICS = f"""
metrics AS (
  SELECT sample_id, count(*) AS n, avg((y_true - y_pred) ** 2) AS mse, sqrt(avg((y_true - y_pred) ** 2)) AS rmse,
         CASE WHEN var_pop(y_true) * count(*) = 0 THEN CASE WHEN sum((y_true - y_pred) ** 2) = 0 THEN 1.0 ELSE 0.0 END
              ELSE 1 - sum((y_true - y_pred) ** 2) / (var_pop(y_true) * count(*)) END AS r2,
         avg(abs(y_true - y_pred)) AS mae, max(abs(y_true - y_pred)) AS maxae,
         avg(abs(y_true - y_pred) / greatest(abs(y_true), {dbl(EPSILON)})) AS mape
  FROM predictions GROUP BY sample_id)"""

SCORED = PREDICTIONS + "," + METRICS + f""",
scored AS (
  SELECT *, CASE WHEN sample_id % {views.TEST_EVERY} = 0 THEN 'test' ELSE 'train' END AS split FROM metrics)"""

_LO, _HI = views.OUTPUT_RANGE
_ILO, _IHI = views.INPUT_RANGE


def scale(column: str, lo: float, hi: float) -> str:
    return f"({column} - {dbl(lo)}) / {dbl(hi - lo)}"


def steps(size: int = BATCH_ROWS, per_sample: bool = False) -> str:
    order = "time - 1" if per_sample else "row_number() OVER (ORDER BY sample_id, time) - 1"
    if per_sample:
        order = "time"
    part = "PARTITION BY sample_id, batch_no" if per_sample else "PARTITION BY batch_no"
    return PREDICTIONS + f""",
rows AS (
  SELECT sample_id, time, {scale('y_true', _LO, _HI)} AS y_true, {scale('y_pred', _LO, _HI)} AS y_pred,
         {order} AS row_no FROM predictions),
blocks AS (SELECT *, row_no // {size} AS batch_no FROM rows),
steps AS (SELECT *, abs(y_pred - lag(y_pred) OVER ({part} ORDER BY row_no)) AS d FROM blocks)"""


def moving(rule: TwoState, d: str = "d") -> str:
    lower, upper = rule.steepness * (1 - rule.tolerance), rule.steepness * (1 + rule.tolerance)
    return f"(CASE WHEN {d} < {dbl(lower)} THEN {dbl(lower)} - {d} WHEN {d} > {dbl(upper)} THEN {d} - {dbl(upper)} ELSE 0 END ** 2)"


def static(rule: TwoState, d: str = "d") -> str:
    bound = dbl(rule.tolerance * rule.steepness)
    return f"(CASE WHEN {d} > {bound} THEN {d} - {bound} ELSE 0 END ** 2)"


def loss_by_batch(rule: TwoState, keys: str) -> str:
    steps_or_zero = "CASE WHEN batch_rows = 1 THEN 0 ELSE d END"
    weight = 1 - rule.theta if rule.normalized else 1.0
    return f""",
sized AS (SELECT *, count(*) OVER (PARTITION BY {keys}) AS batch_rows FROM steps),
filled AS (SELECT *, {steps_or_zero} AS dd FROM sized),
parts AS (
  SELECT {keys}, count(*) AS n, avg((y_true - y_pred) ** 2) AS mse,
         avg({static(rule, 'dd')}) FILTER (WHERE dd IS NOT NULL) AS static,
         avg({moving(rule, 'dd')}) FILTER (WHERE dd IS NOT NULL) AS trans
  FROM filled GROUP BY {keys}),
weighed AS (SELECT *, least({dbl(rule.alpha)} * static, {dbl(rule.beta)} * trans) AS tgds FROM parts)
SELECT {keys}, n, {r6('mse', 'mse')}, {r6('static', 'static')}, {r6('trans', 'trans')}, {r6('tgds', 'tgds')},
       {r6(f'{dbl(weight)} * mse + {dbl(rule.theta)} * tgds', 'loss')}
FROM weighed"""


HISTORY = SIGNALS + """,
history AS (SELECT sample_id AS run_id, time + 1 AS epoch, el_power AS loss, input_voltage AS val_loss FROM signals),
seen AS (
  SELECT *, min(val_loss) OVER (PARTITION BY run_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best
  FROM history),
improved AS (SELECT *, best IS NULL OR val_loss < best AS better FROM seen)"""

BATCHES = SIGNALS + """,
batches AS (
  SELECT sample_id AS run_id, time // 10 AS epoch, time % 10 AS batch,
         CASE WHEN el_power = 13 THEN CAST('NaN' AS DOUBLE) ELSE input_voltage END AS loss, time % 10 + 119 AS n
  FROM signals)"""

JOINED = """
WITH config AS (
  SELECT c_custkey AS folder, c_mktsegment AS loss_function, CAST(c_nationkey % 6 + 1 AS BIGINT) AS n_train_samples,
         'config' AS origin FROM customer),
result AS (
  SELECT o_custkey AS folder, avg(o_totalprice) AS test_rmse_mean,
         CASE WHEN o_custkey % 2 = 0 THEN 'result' END AS origin
  FROM orders GROUP BY o_custkey),
joined AS (
  SELECT c.folder, coalesce(r.origin, c.origin) AS origin, loss_function, n_train_samples, test_rmse_mean
  FROM config c JOIN result r ON c.folder = r.folder)"""

SEGMENTS = LEVELS + """,
diffs AS (
  SELECT * FROM (SELECT *, el_power - lead(el_power) OVER (PARTITION BY sample_id ORDER BY time) AS diff FROM levels)
  WHERE diff IS NOT NULL),
flags AS (
  SELECT *, diff = 0 AS is_static,
         CASE WHEN lag(diff = 0) OVER (PARTITION BY sample_id ORDER BY time) IS NOT DISTINCT FROM (diff = 0)
              THEN 0 ELSE 1 END AS starts FROM diffs),
numbered AS (SELECT *, CAST(sum(starts) OVER (PARTITION BY sample_id ORDER BY time) AS BIGINT) AS segment FROM flags),
segments AS (
  SELECT sample_id, segment, any_value(is_static) AS is_static, min(time) AS first_tick, count(*) AS length
  FROM numbered GROUP BY sample_id, segment)"""

RUNS = LEVELS + """,
marked AS (
  SELECT *, CASE WHEN lag(el_power) OVER (PARTITION BY sample_id ORDER BY time) = el_power THEN 0 ELSE 1 END AS starts
  FROM levels),
runs AS (SELECT *, CAST(sum(starts) OVER (PARTITION BY sample_id ORDER BY time) AS BIGINT) AS run_id FROM marked)"""

POINTS = RUNS + """,
points AS (SELECT sample_id, time, el_power FROM runs WHERE starts = 1),
lengths AS (SELECT sample_id, count(*) AS length FROM levels GROUP BY sample_id)"""

RESPONSE = POINTS.replace("WITH signals", "WITH RECURSIVE signals") + f""",
spans AS (
  SELECT p.sample_id, p.time AS t0, coalesce(lead(p.time) OVER (PARTITION BY p.sample_id ORDER BY p.time), l.length) AS t1,
         row_number() OVER (PARTITION BY p.sample_id ORDER BY p.time) AS no,
         40 * CAST(p.el_power AS DOUBLE) * p.el_power AS target
  FROM points p JOIN lengths l ON p.sample_id = l.sample_id),
levelled AS (
  SELECT sample_id, t0, t1, no, target, target AS start_level, target AS end_level FROM spans WHERE no = 1
  UNION ALL
  SELECT s.sample_id, s.t0, s.t1, s.no, s.target, v.end_level,
         CASE WHEN s.target >= v.end_level
              THEN least(s.target, v.end_level + {dbl(q.RESPONSE_STEEPNESS)} * (s.t1 - s.t0 - 1))
              ELSE greatest(s.target, v.end_level - {dbl(q.RESPONSE_STEEPNESS)} * (s.t1 - s.t0 - 1)) END
  FROM levelled v JOIN spans s ON s.sample_id = v.sample_id AND s.no = v.no + 1),
expected AS (
  SELECT l.sample_id, l.time, 40 * CAST(l.el_power AS DOUBLE) * l.el_power AS resting,
         CASE WHEN v.target >= v.start_level
              THEN least(v.target, v.start_level + {dbl(q.RESPONSE_STEEPNESS)} * (l.time - v.t0))
              ELSE greatest(v.target, v.start_level - {dbl(q.RESPONSE_STEEPNESS)} * (l.time - v.t0)) END AS expected
  FROM levels l JOIN levelled v ON l.sample_id = v.sample_id AND l.time >= v.t0 AND l.time < v.t1)"""


def lagged(columns: dict[str, str], n_in: int, n_out: int, source: str = SIGNALS) -> str:
    """Rows with a full look-back and look-ahead; ``columns`` maps output prefixes to expressions."""
    names = []
    for k in range(-n_in, n_out):
        for name, expression in columns.items():
            call = f"lag({expression}, {-k})" if k < 0 else f"lead({expression}, {k})" if k else None
            suffix = f"_t_{'minus' if k < 0 else 'plus'}_{abs(k)}" if k else "_t"
            names.append(f"{call} OVER w AS {name}{suffix}" if call else f"{expression} AS {name}{suffix}")
    return source + f""",
lagged AS (
  SELECT * EXCLUDE (pos, size) FROM (
    SELECT sample_id, time, {', '.join(names)}, time AS pos, count(*) OVER (PARTITION BY sample_id) AS size
    FROM signals WINDOW w AS (PARTITION BY sample_id ORDER BY time))
  WHERE pos >= {n_in} AND pos + {n_out} <= size)"""


BOTH = {"input_voltage": "input_voltage", "el_power": "el_power"}
SCALED = {"input_voltage": scale("input_voltage", _ILO, _IHI), "el_power": scale("el_power", _LO, _HI)}

MODEL_ROWS = lagged(SCALED, 1, 1) + f""",
rows AS (
  SELECT *, CASE WHEN sample_id % {views.TEST_EVERY} = 0 THEN 'test' ELSE 'train' END AS split,
         input_voltage_t_minus_1 AS x1, input_voltage_t AS x2, el_power_t AS y FROM lagged)"""

FITTED = MODEL_ROWS + """,
moments AS (
  SELECT var_pop(x1) AS s11, var_pop(x2) AS s22, covar_pop(x1, x2) AS s12, covar_pop(x1, y) AS s1y,
         covar_pop(x2, y) AS s2y, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my FROM rows WHERE split = 'train'),
slopes AS (
  SELECT (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) AS w1, (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) AS w2,
         m1, m2, my FROM moments),
model AS (SELECT w1, w2, my - w1 * m1 - w2 * m2 AS b FROM slopes)"""


def guided_steps(rule: TwoState, count: int) -> str:
    """``count`` steps of the guided fit with two features, written out step by step, as the table ``guided``."""
    span_low, span_high = rule.steepness * (1 - rule.tolerance), rule.steepness * (1 + rule.tolerance)
    still = dbl(rule.tolerance * rule.steepness)
    top = dbl(2 * rule.theta * max(rule.alpha, rule.beta))

    def cell(i: int, j: int) -> str:
        return f"2 * avg(x{i} * x{j}) + {top} * sum(coalesce(dx{i} * dx{j}, 0)) / count(*) AS h{i}{j}"

    def pull(i: int) -> str:
        outside = f"greatest(abs(u) - {dbl(span_high)}, 0) - greatest({dbl(span_low)} - abs(u), 0)"
        return (
            f"avg(e * x{i}) AS a{i}, coalesce(avg(greatest(abs(u) - {still}, 0) * sign(u) * dx{i}), 0) AS s{i}, "
            f"coalesce(avg(({outside}) * sign(u) * dx{i}), 0) AS t{i}"
        )

    def slope(i: int) -> str:
        moved = f"CASE WHEN {dbl(rule.alpha)} * st <= {dbl(rule.beta)} * mv THEN {dbl(rule.alpha)} * s{i} ELSE {dbl(rule.beta)} * t{i} END"
        return f"sum(n * (2 * a{i} + {dbl(2 * rule.theta)} * {moved})) / sum(n) AS g{i}"

    sql = MODEL_ROWS + f""",
ordered AS (
  SELECT split, x1, x2, y, row_number() OVER (PARTITION BY split ORDER BY sample_id, time) - 1 AS row_no FROM rows),
blocks AS MATERIALIZED (
  SELECT *, row_no // {BATCH_ROWS} AS batch_no, x1 - lag(x1) OVER w AS dx1, x2 - lag(x2) OVER w AS dx2
  FROM ordered WINDOW w AS (PARTITION BY split, row_no // {BATCH_ROWS} ORDER BY row_no)),
bound AS (
  SELECT *, h11 * (h22 * h33 - h23 * h23) - h12 * (h12 * h33 - h13 * h23) + h13 * (h12 * h23 - h13 * h22) AS det FROM (
    SELECT {cell(1, 1)}, {cell(1, 2)}, {cell(2, 2)}, 2 * avg(x1) AS h13, 2 * avg(x2) AS h23, CAST(2 AS DOUBLE) AS h33
    FROM blocks WHERE split = 'train')),
p1 AS (SELECT CAST(0 AS DOUBLE) AS w1, CAST(0 AS DOUBLE) AS w2, CAST(0 AS DOUBLE) AS b)"""
    for k in range(1, count + 1):
        sql += f""",
b{k} AS MATERIALIZED (
  SELECT split, batch_no, count(*) AS n, avg(e * e) AS mse, avg(e) AS ab,
         coalesce(avg(greatest(abs(u) - {still}, 0) ** 2) FILTER (WHERE u IS NOT NULL), 0) AS st,
         coalesce(avg(greatest({dbl(span_low)} - abs(u), abs(u) - {dbl(span_high)}, 0) ** 2) FILTER (WHERE u IS NOT NULL),
                  {dbl(span_low ** 2)}) AS mv,
         {pull(1)}, {pull(2)}
  FROM (SELECT *, w1 * x1 + w2 * x2 + b - y AS e, w1 * dx1 + w2 * dx2 AS u FROM blocks, p{k}) GROUP BY split, batch_no),
g{k} AS MATERIALIZED (
  SELECT split, sum(n * mse) / sum(n) AS mse, sum(n * least({dbl(rule.alpha)} * st, {dbl(rule.beta)} * mv)) / sum(n) AS tgds,
         {slope(1)}, {slope(2)}, sum(n * 2 * ab) / sum(n) AS g3 FROM b{k} GROUP BY split),
p{k + 1} AS MATERIALIZED (
  SELECT w1 - ((h22 * h33 - h23 * h23) * g1 + (h13 * h23 - h12 * h33) * g2 + (h12 * h23 - h13 * h22) * g3) / det AS w1,
         w2 - ((h13 * h23 - h12 * h33) * g1 + (h11 * h33 - h13 * h13) * g2 + (h12 * h13 - h11 * h23) * g3) / det AS w2,
         b - ((h12 * h23 - h13 * h22) * g1 + (h12 * h13 - h11 * h23) * g2 + (h11 * h22 - h12 * h12) * g3) / det AS b
  FROM p{k}, g{k}, bound WHERE split = 'train')"""
    total = f"mse + {dbl(rule.theta)} * tgds"
    rows = [
        f"SELECT CAST({k} AS BIGINT) AS epoch, t.{total.replace('tgds', 't.tgds')} AS loss, t.mse AS mse, t.tgds AS tgds, "
        f"v.{total.replace('tgds', 'v.tgds')} AS val_loss, v.mse AS val_mse, v.tgds AS val_tgds "
        f"FROM (SELECT * FROM g{k} WHERE split = 'train') t, (SELECT * FROM g{k} WHERE split = 'test') v"
        for k in range(1, count + 1)
    ]
    return sql + ",\nguided AS MATERIALIZED (\n" + "\nUNION ALL ".join(rows) + ")"


def numbers(values) -> str:
    return "[" + ", ".join(dbl(v) for v in values) + "]"


# Settings of one run in the order of the published loops, from their parameter lists.
GRID = f"""
given AS (
  SELECT 1 AS part, i AS pos, 4 AS train_size, 'two' AS kind, 'incorrect_prior_knowledge' AS ex_name,
         {dbl(experiments.STEEPNESS)} * (2.0 ** (i - 8))::DOUBLE AS steepness, NULL::DOUBLE AS loss_tolerance,
         NULL::DOUBLE AS theta, NULL::DOUBLE AS tgds_ratio FROM range(1, 16) t(i)
  UNION ALL
  SELECT 2, i, 4, 'two', 'approximation_prior_knowledge', NULL, i / 20::DOUBLE, NULL, NULL FROM range(0, 11) t(i)
  UNION ALL
  SELECT 3, 4 * s + j, s, CASE WHEN j = 3 THEN 'plain' ELSE 'two' END, 'diff_sizes', NULL,
         CASE WHEN j < 3 THEN ({numbers(experiments.SIZE_TOLERANCES)})[j + 1] END, NULL, NULL
  FROM range(1, 7) a(s), range(0, 4) b(j)
  UNION ALL
  SELECT 4, i, 4, 'two', 'sensitivity_analysis_lambda', NULL, NULL, ({numbers(experiments.THETAS)})[i], 1
  FROM range(1, 9) t(i)
  UNION ALL
  SELECT 5, i, 4, 'two', 'sensitivity_analysis_tgds_ratio', NULL, NULL, 1000, ({numbers(experiments.RATIOS)})[i]
  FROM range(1, 9) t(i)),
numbered_settings AS (
  SELECT row_number() OVER (ORDER BY part, pos) - 1 AS setting_no, CAST(train_size AS BIGINT) AS train_size, ex_name,
         CASE WHEN kind = 'plain' THEN '{experiments.PLAIN_LOSS}' ELSE '{experiments.TWO_STATE_LOSS}' END AS loss,
         coalesce(steepness, {dbl(experiments.STEEPNESS)}) AS steepness,
         coalesce(loss_tolerance, {dbl(0)}) AS loss_tolerance, coalesce(theta, {dbl(1000)}) AS theta,
         coalesce(tgds_ratio, {dbl(0.6)}) AS tgds_ratio FROM given),
grid AS (
  SELECT CAST(run AS BIGINT) AS run, CAST(run * (SELECT count(*) FROM numbered_settings) + setting_no AS BIGINT) AS config_id,
         train_size, ex_name, loss, steepness, loss_tolerance, theta, tgds_ratio
  FROM range(0, {experiments.RUNS}) t(run), numbered_settings)"""

SWEEP = steps() + "," + GRID + f""",
shapes AS (
  SELECT DISTINCT steepness, loss_tolerance, ({scale('steepness', _LO, _HI)}) AS s FROM grid),
sums AS (
  SELECT steepness, loss_tolerance, batch_no, count(*) AS n, avg((y_true - y_pred) ** 2) AS mse,
         avg(greatest(dd - loss_tolerance * s, 0) ** 2) FILTER (WHERE dd IS NOT NULL) AS static,
         avg(greatest(s * (1 - loss_tolerance) - dd, dd - s * (1 + loss_tolerance), 0) ** 2) FILTER (WHERE dd IS NOT NULL)
           AS trans
  FROM (SELECT *, CASE WHEN count(*) OVER (PARTITION BY batch_no) = 1 THEN 0 ELSE d END AS dd FROM steps) z, shapes
  GROUP BY steepness, loss_tolerance, batch_no),
weighed AS (
  SELECT g.*, n, mse, least((1 - 1 / (tgds_ratio + 1)) * static, 1 / (tgds_ratio + 1) * trans) AS tgds
  FROM grid g JOIN sums USING (steepness, loss_tolerance))
SELECT config_id, run, ex_name, train_size, loss AS loss_function, count(*) AS batches,
       round(sum(n * mse) / sum(n), 6) AS mse, round(sum(n * tgds) / sum(n), 6) AS tgds,
       round(sum(n * mse) / sum(n) + CASE WHEN loss = '{experiments.TWO_STATE_LOSS}' THEN any_value(theta) ELSE 0 END
             * sum(n * tgds) / sum(n), 4) AS loss
FROM weighed GROUP BY config_id, run, ex_name, train_size, loss"""

DRAW = "md5(concat_ws('-', CAST({seed} AS VARCHAR), CAST({key} AS VARCHAR)))"

WINDOWED = f"""
WITH keyed AS (
  SELECT user_id AS sample_id, date_trunc('day', ts) AS day, ts, event_id,
         CAST(json_extract(props, '$.k') AS DOUBLE) AS y FROM events),
stepped AS (
  SELECT *, abs(y - lag(y) OVER (PARTITION BY sample_id, day ORDER BY ts, event_id)) AS d,
         count(*) OVER (PARTITION BY sample_id, day) AS size FROM keyed),
filled AS (SELECT *, CASE WHEN size = 1 THEN 0 ELSE d END AS dd FROM stepped),
windows AS (
  SELECT sample_id, day, count(*) AS n, greatest(count(*) - 1, 1) AS steps,
         sum({moving(q.STREAM_RULE, 'dd')}) FILTER (WHERE dd IS NOT NULL) AS moving,
         sum({static(q.STREAM_RULE, 'dd')}) FILTER (WHERE dd IS NOT NULL) AS still FROM filled GROUP BY sample_id, day),
weighed AS (
  SELECT *, least({dbl(q.STREAM_RULE.alpha)} * moving, {dbl(q.STREAM_RULE.beta)} * still) AS total FROM windows)"""

_POISSON = " + ".join(f"CASE WHEN u >= {dbl(edge)} THEN 1 ELSE 0 END" for edge in poisson_cdf())
_TAIL = (1 - q.LEVEL) / 2

ORACLE: dict[str, str] = {
    "scan_signals": SIGNALS + "\nSELECT sample_id, time, input_voltage, el_power FROM signals",
    "sample_id_from_path": "SELECT user_id AS sample_id, count(*) AS n FROM events GROUP BY user_id",
    "harmonize_columns": SIGNALS + "\nSELECT sample_id, time, input_voltage, el_power FROM signals",
    "read_info": SEGMENTS + f"""
SELECT {dbl(_ILO)} AS input_lo, {dbl(_IHI)} AS input_hi, {dbl(_LO)} AS output_lo, {dbl(_HI)} AS output_hi,
       max(length) FILTER (WHERE is_static) AS max_static_size, max(length) FILTER (WHERE NOT is_static) AS max_lag,
       (SELECT max(time) + 1 FROM levels) AS max_length FROM segments""",
    "write_signals": SIGNALS + "\nSELECT sample_id, time, input_voltage, el_power FROM signals",
    "write_true_pred": PREDICTIONS + f"""
SELECT sample_id, CAST(0 AS BIGINT) AS part, count(*) AS n,
       string_agg(CAST(CAST(y_true AS BIGINT) AS VARCHAR), ',' ORDER BY time) AS true_values,
       string_agg(CAST(CAST(y_pred AS BIGINT) AS VARCHAR), ',' ORDER BY time) AS pred_values
FROM predictions GROUP BY ALL""",
    "write_config": JOINED + "\nSELECT folder, loss_function, n_train_samples, origin FROM config",
    "write_info": SIGNALS + """
SELECT min(input_voltage) AS input_lo, max(input_voltage) AS input_hi, min(el_power) AS output_lo,
       max(el_power) AS output_hi, max(time) + 1 AS max_length FROM signals""",
    "write_result": SCORED + """
SELECT (SELECT time + 1 FROM signals ORDER BY input_voltage, time LIMIT 1) AS best_epoch, '0:00:01.500000' AS train_time,
       round_even(avg(rmse) FILTER (WHERE split = 'train'), 3) AS train_rmse_mean,
       round_even(stddev_pop(rmse) FILTER (WHERE split = 'train'), 3) AS train_rmse_std,
       round_even(avg(rmse) FILTER (WHERE split = 'test'), 3) AS test_rmse_mean,
       round_even(stddev_pop(rmse) FILTER (WHERE split = 'test'), 3) AS test_rmse_std FROM scored""",
    "scan_results": """
SELECT 'ex_name=' || c_mktsegment || '/approach=n' || c_nationkey || '/' AS folder, min(c_custkey) AS seed,
       count(*) AS n_train_samples, min(c_name) AS loss_function, max(c_custkey) AS best_epoch,
       round(avg(c_acctbal), 6) AS test_rmse_mean
FROM customer GROUP BY c_mktsegment, c_nationkey HAVING max(c_custkey) % 7 <> 0""",
    "project_results": JOINED + f"""
SELECT loss_function, n_train_samples, {r6('test_rmse_mean', 'test_rmse_mean')}, folder FROM joined""",
    "select_features": lagged({"input_voltage": "input_voltage"}, q.LAG - 1, 1) + "\nSELECT * FROM lagged",
    "rename_lags": lagged(BOTH, 1, 2) + "\nSELECT * FROM lagged",
    "dropna_rows": SIGNALS + f"""
SELECT sample_id, time, {r6('diff', 'diff')} FROM (
  SELECT sample_id, time, input_voltage - lead(input_voltage) OVER (PARTITION BY sample_id ORDER BY time) AS diff
  FROM signals) WHERE diff IS NOT NULL""",
    "split_test": SIGNALS + f"""
SELECT CASE WHEN sample_id % {views.TEST_EVERY} = 0 THEN 'test' ELSE 'train' END AS split, sample_id, count(*) AS n,
       {r6('sum(el_power)', 'el_power')} FROM signals GROUP BY ALL""",
    "split_pool": SIGNALS + """
SELECT sample_id, time,
       CASE WHEN sample_id IN (4, 12) THEN 'test' WHEN sample_id BETWEEN 0 AND 99 THEN 'train' END AS split FROM signals""",
    "static_vs_slope": SEGMENTS + """
SELECT sample_id, count(*) FILTER (WHERE is_static) AS static_segments,
       count(*) FILTER (WHERE NOT is_static) AS slope_segments, max(length) FILTER (WHERE is_static) AS longest_static,
       max(length) FILTER (WHERE NOT is_static) AS longest_slope FROM segments GROUP BY sample_id""",
    "align_tail": SIGNALS + f"\nSELECT sample_id, time, el_power FROM signals WHERE time >= {q.LAG - 1}",
    "join_config_result": JOINED + f"""
SELECT folder, origin, loss_function, n_train_samples, {r6('test_rmse_mean', 'test_rmse_mean')} FROM joined""",
    "scale_by_bounds": SIGNALS + f"""
SELECT sample_id, time, {r6(SCALED['input_voltage'], 'input_voltage')}, {r6(SCALED['el_power'], 'el_power')}
FROM signals""",
    "align_xy": lagged({"input_voltage": "input_voltage"}, q.LAG - 1, 1) + """
SELECT lagged.*, el_power FROM lagged JOIN signals USING (sample_id, time)""",
    "split_overlap": f"""
SELECT sample_id FROM (
  SELECT DISTINCT user_id AS sample_id FROM events
  ORDER BY {DRAW.format(seed=7, key='sample_id')}, sample_id LIMIT 40) WHERE sample_id % {views.TEST_EVERY} = 0""",
    "step_fill": POINTS + """
SELECT l.sample_id, l.time, p.el_power
FROM (SELECT sample_id, unnest(range(0, length)) AS time FROM lengths) l
ASOF JOIN points p ON l.sample_id = p.sample_id AND l.time >= p.time""",
    "tgds_sweep": SWEEP,
    "regression_metrics": SCORED + f"""
SELECT sample_id, n, {r6('mse', 'mse')}, {r6('rmse', 'rmse')}, {r6('r2', 'r2')}, {r6('mae', 'mae')},
       {r6('maxae', 'maxae')}, {q.SIGNIFICANT.format('mape')} AS mape
FROM metrics""",
    "trimmed_rmse": SCORED + """,
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY split ORDER BY rmse, sample_id) - 1 AS rank,
         count(*) OVER (PARTITION BY split) AS size FROM scored)
SELECT split, round_even(avg(rmse), 3) AS rmse_mean, round_even(stddev_pop(rmse), 3) AS rmse_std FROM ranked
WHERE rank >= round_even(size * 0.05::DOUBLE, 0) AND rank < round_even(size * 0.95::DOUBLE, 0) GROUP BY split""",
    "rmse_summary": SCORED + """
SELECT split, round_even(avg(rmse), 3) AS rmse_mean, round_even(stddev_pop(rmse), 3) AS rmse_std
FROM scored GROUP BY split""",
    "results_rollup": JOINED + f"""
SELECT loss_function, n_train_samples, {r6('avg(test_rmse_mean)', 'mean')}, {r6('stddev_samp(test_rmse_mean)', 'std')},
       count(test_rmse_mean) AS count FROM joined GROUP BY loss_function, n_train_samples""",
    "bootstrap_ci": JOINED + f""",
drawn AS (
  SELECT joined.*, rep,
         CAST('0x' || substr(md5(concat_ws('-', '0', CAST(rep // 4 AS VARCHAR), CAST(folder AS VARCHAR))), 1 + 8 * (rep % 4), 8)
              AS BIGINT) / {dbl(1 << 32)} AS u FROM joined, range(0, {q.REPS}) t(rep)),
counted AS (SELECT *, {_POISSON} AS w FROM drawn),
reps AS (
  SELECT loss_function, n_train_samples, rep,
         CASE WHEN sum(w) > 0 THEN sum(w * test_rmse_mean) / sum(w) END AS rep_mean FROM counted GROUP BY ALL),
bands AS (
  SELECT loss_function, n_train_samples, quantile_cont(rep_mean, {_TAIL!r}) AS ci_low,
         quantile_cont(rep_mean, {1 - _TAIL!r}) AS ci_high FROM reps GROUP BY ALL),
means AS (SELECT loss_function, n_train_samples, avg(test_rmse_mean) AS mean FROM joined GROUP BY ALL)
SELECT loss_function, n_train_samples, {q.SIGNIFICANT.format('mean')} AS mean, {q.SIGNIFICANT.format('ci_low')} AS ci_low,
       {q.SIGNIFICANT.format('ci_high')} AS ci_high
FROM means JOIN bands USING (loss_function, n_train_samples)""",
    "run_lists": RUNS + f""",
placed AS (SELECT *, min(time) OVER r AS first, count(*) OVER r AS length FROM runs WINDOW r AS (PARTITION BY sample_id, run_id))
SELECT sample_id, run_id, (time - first) // {segments.LIST_TICKS} AS part,
       string_agg(CAST(el_power AS VARCHAR), ',' ORDER BY time) AS items, length
FROM placed GROUP BY sample_id, run_id, part, length""",
    "segment_stats": SEGMENTS + """
SELECT max(length) FILTER (WHERE is_static) AS max_static_size, max(length) FILTER (WHERE NOT is_static) AS max_lag,
       (SELECT max(time) + 1 FROM levels) AS max_length FROM segments""",
    "tgds_loss_by_batch": steps() + loss_by_batch(q.RULE, "batch_no"),
    "tgds_loss_by_sample": steps(16, per_sample=True) + loss_by_batch(q.NORMALIZED_RULE, "sample_id, batch_no"),
    "tgds_metric": steps() + f""",
sized AS (SELECT *, count(*) OVER (PARTITION BY batch_no) AS size FROM steps),
filled AS (SELECT *, CASE WHEN size = 1 THEN 0 ELSE d END AS dd FROM sized),
sums AS (
  SELECT batch_no, greatest(count(*) - 1, 1) AS steps,
         sum({moving(q.METRIC_RULE, 'dd')}) FILTER (WHERE dd IS NOT NULL) AS moving,
         sum({static(q.METRIC_RULE, 'dd')}) FILTER (WHERE dd IS NOT NULL) AS still FROM filled GROUP BY batch_no),
weighed AS (
  SELECT sum(least({dbl(q.METRIC_RULE.alpha)} * moving, {dbl(q.METRIC_RULE.beta)} * still)) AS total,
         CAST(sum(steps) AS BIGINT) AS steps FROM sums)
SELECT {r6('total', 'total')}, steps, {r6(f'{dbl(q.METRIC_RULE.theta)} * total / steps', 'loss_tgds')} FROM weighed""",
    "best_epoch": HISTORY + """
SELECT run_id, epoch AS best_epoch, val_loss AS best_val_loss FROM history
QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY val_loss, epoch) = 1""",
    "sample_lengths": "SELECT user_id AS sample_id, count(*) AS length FROM events GROUP BY user_id",
    "lag_features": lagged(BOTH, q.LAG - 1, 2) + "\nSELECT * FROM lagged",
    "lag_array": SIGNALS + """
SELECT sample_id, time, features FROM (
  SELECT sample_id, time,
         array_to_string(list(CAST(CAST(el_power AS BIGINT) AS VARCHAR)) OVER w, ',') AS features
  FROM signals WINDOW w AS (PARTITION BY sample_id ORDER BY time ROWS BETWEEN 15 PRECEDING AND CURRENT ROW))
WHERE time >= 15""",
    "abs_diff": steps() + f"\nSELECT batch_no, row_no, {r6('d', 'd')} FROM steps WHERE d IS NOT NULL",
    "forward_diff": SEGMENTS + "\nSELECT sample_id, time, diff FROM diffs",
    "value_runs": RUNS + "\nSELECT sample_id, time, el_power, run_id FROM runs",
    "static_segments": SEGMENTS + "\nSELECT sample_id, segment, is_static, first_tick, length FROM segments",
    "batch_blocks": SIGNALS + f"""
SELECT sample_id, time, row_no, row_no // {BATCH_ROWS} AS batch_no FROM (
  SELECT sample_id, time, row_number() OVER (ORDER BY sample_id, time) - 1 AS row_no FROM signals)""",
    "running_batch_loss": BATCHES + f"""
SELECT run_id, epoch, batch, loss, n,
       {r6('sum(loss * n) OVER w / sum(n) OVER w', 'running_loss')}
FROM batches
WINDOW w AS (PARTITION BY run_id, epoch ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "checkpoint_epochs": HISTORY + "\nSELECT run_id, epoch, val_loss FROM improved WHERE better",
    "early_stop_epoch": HISTORY + f""",
waits AS (
  SELECT *, epoch - max(CASE WHEN better THEN epoch END) OVER (PARTITION BY run_id ORDER BY epoch) AS waited FROM improved)
SELECT run_id, min(epoch) FILTER (WHERE waited >= {q.PATIENCE}) AS stop_epoch, max(epoch) AS last_epoch
FROM waits GROUP BY run_id""",
    "first_nan_batch": BATCHES + """,
broken AS (
  SELECT run_id, epoch, batch FROM batches WHERE isnan(loss) OR isinf(loss)
  QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY epoch, batch) = 1)
SELECT r.run_id, b.epoch AS nan_epoch, b.batch AS nan_batch
FROM (SELECT DISTINCT run_id FROM batches) r LEFT JOIN broken b ON r.run_id = b.run_id""",
    "order_samples": "SELECT DISTINCT user_id AS sample_id FROM events ORDER BY 1",
    "sample_train": f"""
SELECT DISTINCT user_id AS sample_id FROM events WHERE user_id % {views.TEST_EVERY} <> 0
ORDER BY {DRAW.format(seed=42, key='sample_id')}, sample_id LIMIT 6""",
    "tail_split": SIGNALS + f"""
SELECT sample_id, time, row_no,
       CASE WHEN row_no < floor((SELECT count(*) FROM events) * (1 - {dbl(q.VAL_FRAC)})) THEN 'train' ELSE 'validation' END
         AS split
FROM (SELECT sample_id, time, row_number() OVER (ORDER BY sample_id, time) - 1 AS row_no FROM signals)""",
    "union_samples": SIGNALS + "\nSELECT sample_id, time, input_voltage, el_power FROM signals",
    "experiment_grid": "WITH " + GRID + f""",
pool AS (
  SELECT user_id AS sample_id, count(*) AS length FROM events WHERE user_id % {views.TEST_EVERY} <> 0 GROUP BY user_id),
draws AS (
  SELECT run, sample_id, length,
         row_number() OVER (PARTITION BY run ORDER BY {DRAW.format(seed='run', key='sample_id')}, sample_id) AS draw_no
  FROM pool, range(0, {experiments.RUNS}) t(run))
SELECT run, train_size, ex_name, loss, steepness: round(steepness, 6), loss_tolerance, theta, tgds_ratio, config_id,
       CAST(sum(length) AS BIGINT) AS train_rows, string_agg(CAST(sample_id AS VARCHAR), ',' ORDER BY sample_id) AS train_samples
FROM grid JOIN draws USING (run) WHERE draw_no <= train_size GROUP BY ALL""",
    "minmax_scale": SIGNALS + f"\nSELECT sample_id, time, {r6(SCALED['input_voltage'], 'scaled')} FROM signals",
    "minmax_inverse": SIGNALS + f"""
SELECT sample_id, time, {r6(f'input_voltage / 500 * {dbl(_HI - _LO)} + {dbl(_LO)}', 'unscaled')} FROM signals""",
    "scale_steepness": SIGNALS + f"""
SELECT sample_id, {r6(scale('avg(el_power)', _LO, _HI), 'affine')}, {r6(f'avg(el_power) / {dbl(_HI - _LO)}', 'linear')}
FROM signals GROUP BY sample_id""",
    "band_deviation": SIGNALS + """
SELECT sample_id, time, CASE WHEN el_power < 25 THEN 25 - el_power WHEN el_power > 75 THEN el_power - 75 ELSE 0 END
  AS deviation FROM signals""",
    "static_curve": SIGNALS + """
SELECT sample_id, time, round(40 * (input_voltage / 100) ** 2, 9) AS output FROM signals""",
    "expected_response": RESPONSE + f"\nSELECT sample_id, time, {r6('expected', 'expected')} FROM expected",
    "response_residuals": RESPONSE + f"""
SELECT sample_id, count(*) AS n, {r6('sqrt(avg((resting - expected) ** 2))', 'rmse')},
       {r6('avg(abs(resting - expected))', 'mae')}, {r6('max(abs(resting - expected))', 'maxae')}
FROM expected GROUP BY sample_id""",
    "parse_path": """
SELECT event_id, event_type || '/user-' || user_id || '/' AS folder, event_id AS sample_no,
       'sample_' || event_id || '.csv' AS file FROM events""",
    "parse_duration": """
SELECT event_id, round((event_id % 3) * 86400 + (user_id % 24) * 3600 + (event_id % 60) * 60 + event_id % 59
       + (event_id % 1000000) / 1e6, 6) AS seconds FROM events""",
    "explode_true_pred": PREDICTIONS + "\nSELECT sample_id, time, y_true, y_pred FROM predictions",
    "json_merge": """
SELECT event_id, CASE WHEN event_id % 2 = 0 THEN user_id ELSE CAST(json_extract(props, '$.k') AS BIGINT) END AS k,
       event_type AS t, CAST(2 AS BIGINT) AS entries FROM events""",
    "stream_tgds": WINDOWED + f"""
SELECT sample_id, {r6('sum(total)', 'total')}, CAST(sum(steps) AS BIGINT) AS steps,
       {r6(f'sum(total) / sum(steps) * {dbl(q.STREAM_RULE.theta)}', 'loss_tgds')} FROM weighed GROUP BY sample_id""",
    "stream_batch_log": WINDOWED + f"""
SELECT sample_id, CAST(epoch(day) AS BIGINT) AS window_start, n, steps, {r6('moving', 'moving')}, {r6('still', 'still')},
       {r6('total', 'total')} FROM weighed""",
    "fit_lag_baseline": FITTED + f"""
SELECT term, round(value, 6) AS value FROM (
  SELECT 'intercept' AS term, b AS value FROM model UNION ALL SELECT 'input_voltage_t_minus_1', w1 FROM model
  UNION ALL SELECT 'input_voltage_t', w2 FROM model)""",
    "predict_samples": FITTED + f""",
predicted AS (
  SELECT split, sample_id, y * {dbl(_HI - _LO)} + {dbl(_LO)} AS t,
         (w1 * x1 + w2 * x2 + b) * {dbl(_HI - _LO)} + {dbl(_LO)} AS p FROM rows, model)
SELECT split, sample_id, count(*) AS n, {r6('sqrt(avg((t - p) ** 2))', 'rmse')}, {r6('avg(abs(t - p))', 'mae')},
       {r6('max(abs(t - p))', 'maxae')} FROM predicted GROUP BY split, sample_id""",
    "fit_tgds_linear": guided_steps(q.GUIDED_RULE, q.FIT_STEPS) + f"""
SELECT epoch, {r6('loss', 'loss')}, {r6('mse', 'mse')}, {r6('tgds', 'tgds')}, {r6('val_loss', 'val_loss')},
       {r6('val_mse', 'val_mse')}, {r6('val_tgds', 'val_tgds')} FROM guided""",
    "guided_replay": guided_steps(q.GUIDED_RULE, q.FIT_STEPS) + """,
rounded AS (SELECT epoch, round(val_loss, 6) AS val_loss FROM guided),
marked AS (
  SELECT *, val_loss < coalesce(min(val_loss) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                                'infinity'::DOUBLE) AS better FROM rounded),
waits AS (SELECT *, epoch - max(CASE WHEN better THEN epoch END) OVER (ORDER BY epoch) AS waited FROM marked)
SELECT CAST(1 AS BIGINT) AS run_id, arg_min(epoch, (val_loss, epoch)) AS best_epoch, min(val_loss) AS best_val_loss,
       max(epoch) FILTER (WHERE better) AS last_saved, count(*) FILTER (WHERE better) AS saves,
       min(epoch) FILTER (WHERE waited >= 1) AS stop_epoch, max(epoch) AS last_epoch FROM waits""",
}
ORACLE["write_true_pred_text"] = ORACLE["write_true_pred"]
ORACLE["tgds_metric_by_day"] = ORACLE["tgds_metric"]
