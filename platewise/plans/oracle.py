"""SQL with the same results as the registered queries, for the correctness check."""

from __future__ import annotations

from platewise.plans.inputs import DIMENSIONS, MEASURES

ORACLE: dict[str, str] = {}

OBJECT_NAMES = ("Cells", "Cytoplasm", "FilteredNuclei")
STANDARDIZED = tuple(f"rp_norm_{f}" for f in MEASURES)
META = ('"cell_ID"', '"Metadata_Day"', '"Metadata_Biorep"', '"Tech_replica"', '"Concentration"',
        '"Metadata_Well"', '"Day_Well_BR"')
META_LIST = ", ".join(META)
DAY, BIOREP, TECH, CONC, WELL = META[1], META[2], META[3], META[4], META[5]


def r(expr: str, digits: int = 4) -> str:
    return f"(round({expr}, {digits}) + 0.0)"


def ctes(*parts: str) -> str:
    return "WITH " + ",\n".join(parts)


MEASURE = """measure0 AS (
  SELECT concat(l_orderkey, '_', l_linenumber) AS "cell_ID",
    CASE l_returnflag WHEN 'A' THEN 'Cells' WHEN 'N' THEN 'Cytoplasm' ELSE 'FilteredNuclei' END AS object,
    CASE year(l_shipdate) % 4 WHEN 0 THEN 'D1' WHEN 1 THEN 'D5' WHEN 2 THEN 'D7' ELSE 'D9' END AS "Metadata_Day",
    concat('BR', l_suppkey % 4 + 1) AS "Metadata_Biorep",
    substr('BCD', CAST(l_linenumber % 3 + 1 AS INTEGER), 1) AS "Tech_replica",
    CAST(l_partkey % 10 + 2 AS INTEGER) AS "Concentration",
    l_orderkey, l_quantity, l_extendedprice, l_discount, l_tax
  FROM lineitem),
measure AS (
  SELECT *, concat("Tech_replica", "Concentration") AS "Metadata_Well",
    concat_ws('_', "Metadata_Day", concat("Tech_replica", "Concentration"), "Metadata_Biorep") AS "Day_Well_BR"
  FROM measure0)"""

FLAWED = MEASURE + f""",
flawed AS (
  SELECT {META_LIST}, l_orderkey,
    CASE WHEN l_orderkey % 7 = 0 THEN NULL WHEN l_orderkey % 11 = 0 THEN 'Infinity'::DOUBLE ELSE l_quantity END AS l_quantity,
    CASE WHEN l_orderkey % 13 = 0 THEN -1e13 WHEN l_orderkey % 17 = 0 THEN 'NaN'::DOUBLE ELSE l_extendedprice END AS l_extendedprice,
    l_discount, l_tax
  FROM measure),
clean AS (
  SELECT {META_LIST}, l_orderkey,
    {", ".join(f"CASE WHEN NOT isnan({f}) AND abs({f}) <= 1e12 THEN {f} END AS {f}" for f in MEASURES)}
  FROM flawed)"""


def rounded_list(columns, digits=4):
    return ", ".join(f'{r(c, digits)} AS "{c}"' for c in columns)


# ---- pooling


def _pooled(key: str, meta: tuple[str, ...], carried: tuple[str, ...]) -> str:
    parts = [MEASURE]
    for o in OBJECT_NAMES:
        med = ", ".join(f'median({f}) AS "{f}_{o}"' for f in MEASURES)
        parts.append(f"""p_{o} AS (SELECT {key}, {med}, count(*) AS "counts_{o}"
          FROM measure WHERE object = '{o}' GROUP BY {key})""")
    parts.append(f"keys AS (SELECT DISTINCT {key} FROM measure)")
    parts.append(f"""meta AS (SELECT {key}, {', '.join(meta)} FROM (
      SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {', '.join(carried)}) AS place
      FROM measure WHERE object = 'Cells') WHERE place = 1)""")
    values = ", ".join(f'{r(f"{chr(34)}{f}_{o}{chr(34)}")} AS "{f}_{o}"' for o in OBJECT_NAMES for f in MEASURES)
    counts = ", ".join(f'"counts_{o}"' for o in OBJECT_NAMES)
    joins = " ".join(f"LEFT JOIN p_{o} USING ({key})" for o in OBJECT_NAMES)
    return ctes(*parts) + f"""
      SELECT {key}, {values}, {counts}, {', '.join(meta)},
        nullif(regexp_extract({WELL}, '([A-Z])', 1), '') AS "Tech_replica",
        TRY_CAST(nullif(regexp_extract({WELL}, '(\\d+)', 1), '') AS INTEGER) AS "Concentration"
      FROM keys {joins} LEFT JOIN meta USING ({key})"""


ORACLE["pool_cells"] = _pooled('"cell_ID"', (WELL, DAY, BIOREP, '"Day_Well_BR"'), (WELL, DAY, BIOREP, '"Day_Well_BR"'))
ORACLE["pool_wells"] = _pooled('"Day_Well_BR"', (WELL, DAY, BIOREP), (WELL, DAY, BIOREP))
ORACLE["object_counts"] = f"""{ctes(MEASURE)} SELECT "cell_ID",
  {", ".join(f"nullif(count(*) FILTER (object = '{o}'), 0) AS " + '"counts_' + o + '"' for o in OBJECT_NAMES)}
  FROM measure GROUP BY "cell_ID" """

# ---- standardization

ROW_KEYS = f"{DAY}, {BIOREP}, {TECH}"
STD = MEASURE + f""",
row_med AS (SELECT {ROW_KEYS}, {", ".join(f"median({f}) AS m_{f}" for f in MEASURES)} FROM measure GROUP BY {ROW_KEYS}),
row_off AS (SELECT {META_LIST}, {", ".join(f"{f} - m_{f} AS {f}" for f in MEASURES)}
  FROM measure JOIN row_med USING ({ROW_KEYS})),
day_med AS (SELECT {DAY}, {", ".join(f"median({f}) AS d_{f}" for f in MEASURES)} FROM row_off GROUP BY {DAY}),
std AS (SELECT {META_LIST}, {", ".join(f"{f} - d_{f} AS rp_norm_{f}" for f in MEASURES)}
  FROM row_off JOIN day_med USING ({DAY}))"""
ORACLE["standardize_row_day"] = f"{ctes(STD)} SELECT {META_LIST}, {rounded_list(STANDARDIZED)} FROM std"

Z_KEYS = f"{DAY}, {BIOREP}"
ORACLE["robust_z"] = ctes(MEASURE) + f""",
med AS (SELECT {Z_KEYS}, {", ".join(f"median({f}) AS m_{f}" for f in MEASURES)} FROM measure GROUP BY {Z_KEYS}),
off AS (SELECT measure.*, {", ".join(f"{f} - m_{f} AS o_{f}" for f in MEASURES)} FROM measure JOIN med USING ({Z_KEYS})),
mad AS (SELECT {Z_KEYS}, {", ".join(f"median(abs(o_{f})) AS a_{f}" for f in MEASURES)} FROM off GROUP BY {Z_KEYS})
SELECT {META_LIST}, {", ".join(f'{r(f"0.6745 * o_{f} / nullif(a_{f}, 0)")} AS "rZs_{f}"' for f in MEASURES)}
FROM off JOIN mad USING ({Z_KEYS})"""

WELL_KEYS = f"{DAY}, {BIOREP}, {WELL}"


def trimmed(source: str, name: str, features) -> str:
    bounds = ", ".join(
        f"quantile_cont({f}, 0.025) AS lo_{f}, quantile_cont({f}, 0.975) AS hi_{f}" for f in features
    )
    kept = ", ".join(
        f"CASE WHEN {f} >= lo_{f} - 1e-9 * abs(lo_{f}) AND {f} <= hi_{f} + 1e-9 * abs(hi_{f}) THEN {f} END AS {f}"
        for f in features
    )
    return f"""{name}_b AS (SELECT {WELL_KEYS}, {bounds} FROM {source} GROUP BY {WELL_KEYS}),
{name} AS (SELECT {META_LIST}, {kept} FROM {source} JOIN {name}_b USING ({WELL_KEYS}))"""


ORACLE["trim_wells"] = f"""{ctes(MEASURE, trimmed("measure", "trim", MEASURES))}
SELECT {META_LIST}, {rounded_list(MEASURES)} FROM trim"""
_TWO = ("rp_norm_l_quantity", "rp_norm_l_tax")
ORACLE["trim_selected"] = f"""{ctes(STD, trimmed("std", "trim", _TWO))}
SELECT {META_LIST}, {rounded_list(_TWO)} FROM trim"""

# ---- earth mover's distance


def emd(long: str, name: str, by: str) -> str:
    """``by, p, q, na, nb, score`` for every pair p < q of ``pop`` in ``long(by, pop, value)``."""
    return f"""{name}_c AS (SELECT {by}, pop, value, count(*) AS n FROM {long} WHERE value IS NOT NULL GROUP BY {by}, pop, value),
{name}_t AS (SELECT {by}, pop, sum(n) AS total FROM {name}_c GROUP BY {by}, pop),
{name}_p AS (SELECT {by}, a.pop AS p, b.pop AS q, a.total AS na, b.total AS nb
  FROM {name}_t a JOIN {name}_t b USING ({by}) WHERE a.pop < b.pop),
{name}_e AS (SELECT {by}, p, q, na, nb, value, sum(ca) AS ca, sum(cb) AS cb FROM (
    SELECT {by}, p, q, na, nb, value, n AS ca, 0 AS cb FROM {name}_p JOIN {name}_c USING ({by}) WHERE pop = p
    UNION ALL
    SELECT {by}, p, q, na, nb, value, 0, n FROM {name}_p JOIN {name}_c USING ({by}) WHERE pop = q)
  GROUP BY {by}, p, q, na, nb, value),
{name}_s AS (SELECT *, sum(ca) OVER w AS ra, sum(cb) OVER w AS rb, lead(value) OVER w - value AS dx FROM {name}_e
  WINDOW w AS (PARTITION BY {by}, p, q ORDER BY value)),
{name} AS (SELECT {by}, p, q, CAST(na AS BIGINT) AS na, CAST(nb AS BIGINT) AS nb,
    coalesce(sum(abs(CAST(ra AS DOUBLE) / na - CAST(rb AS DOUBLE) / nb) * dx), 0.0) AS score
  FROM {name}_s GROUP BY {by}, p, q, na, nb)"""


def unpivoted(source: str, ids: str, features) -> str:
    return " UNION ALL ".join(
        f"SELECT {ids}, '{f}' AS feature, {f} AS value FROM {source}" for f in features
    )


def dose_ctes(before: str, source: str, features) -> str:
    return before + ",\n" + trimmed(source, "trim", features) + f""",
dose_long AS ({unpivoted("trim", f"{DAY}, {CONC} AS pop", features)}),
{emd("dose_long", "dose", f"{DAY}, feature")},
dose_scores AS (SELECT feature AS "Feature", CAST(p AS VARCHAR) AS "Population1", CAST(q AS VARCHAR) AS "Population2",
  concat(p, '_vs_', q) AS "Concentration", {DAY}, na AS "Count1", nb AS "Count2", score AS "EMD_score" FROM dose)"""


DOSE = dose_ctes(STD, "std", STANDARDIZED)
CONTROL = f"""control_std AS (SELECT * FROM std WHERE {CONC} = 11),
{trimmed("control_std", "control_trim", STANDARDIZED)},
control_long AS ({unpivoted("control_trim", f"{DAY}, {BIOREP} AS pop", STANDARDIZED)}),
{emd("control_long", "control", f"{DAY}, feature")},
control_scores AS (SELECT feature AS "Feature", concat(p, '_', {DAY}, '_11') AS "Population1",
  concat(q, '_', {DAY}, '_11') AS "Population2", '11' AS "Concentration", {DAY}, na AS "Count1", nb AS "Count2",
  score AS "EMD_score" FROM control)"""
SCORE_COLUMNS = f'"Feature", "Population1", "Population2", "Concentration", {DAY}, "Count1", "Count2"'
VS_CONTROL = """"Population2" = '11'"""

ORACLE["emd_concentrations"] = f"""{ctes(DOSE)} SELECT {SCORE_COLUMNS}, {r('"EMD_score" + 1e-9', 6)} AS "EMD_score" FROM dose_scores"""
ORACLE["emd_controls"] = f"""{ctes(STD, CONTROL)} SELECT {SCORE_COLUMNS}, {r('"EMD_score" + 1e-9', 6)} AS "EMD_score" FROM control_scores"""

EVENTS = """event_long AS (SELECT concat('D', dayofmonth(ts) % 4) AS "Metadata_Day", event_type AS pop, value FROM events)"""
ORACLE["emd_event_types"] = f"""{ctes(EVENTS, emd("event_long", "ev", DAY))}
SELECT {DAY}, p AS "Population1", q AS "Population2", na AS "Count1", nb AS "Count2", {r("score", 6)} AS "EMD_score" FROM ev"""

RANKED = """ranked AS (SELECT "Feature", median_emd, CAST(row_number() OVER (ORDER BY median_emd, "Feature") - 1 AS INTEGER) AS position
  FROM (SELECT "Feature", median("EMD_score") AS median_emd FROM {source} GROUP BY "Feature"))"""
ORACLE["rank_features"] = f"""{ctes(DOSE, RANKED.format(source="dose_scores"))}
SELECT "Feature", {r("median_emd")} AS median_emd, position FROM ranked"""
ORACLE["score_panels"] = f"""{ctes(DOSE, f"treat AS (SELECT * FROM dose_scores WHERE {VS_CONTROL})", RANKED.format(source="treat"))}
SELECT {SCORE_COLUMNS}, {r('"EMD_score" + 1e-9', 6)} AS "EMD_score", {r("median_emd")} AS median_emd, position,
  CASE WHEN "EMD_score" > 7 THEN 'log' ELSE 'linear' END AS panel
FROM treat JOIN ranked USING ("Feature")"""

CLASSES = f"""treat AS (SELECT "Feature", bool_or("EMD_score" >= 0.05) AS active FROM dose_scores WHERE {VS_CONTROL} GROUP BY "Feature"),
means AS (SELECT "Feature", avg("EMD_score") AS control_mean FROM control_scores GROUP BY "Feature"),
classes AS (SELECT "Feature", control_mean, threshold,
    CASE WHEN control_mean > threshold THEN 'noisy' WHEN NOT coalesce(active, false) THEN 'inactive' ELSE 'normal' END AS class,
    control_mean <= threshold AND coalesce(active, false) AS selected
  FROM means LEFT JOIN treat USING ("Feature"), (SELECT quantile_cont(control_mean, 0.75) AS threshold FROM means))"""
ORACLE["classify_features"] = f"""{ctes(DOSE, CONTROL, CLASSES)}
SELECT "Feature", {r("control_mean")} AS control_mean, {r("threshold")} AS threshold, class, selected FROM classes"""
ORACLE["select_high_low"] = f"""{ctes(DOSE, CONTROL, CLASSES)} SELECT "Feature" FROM classes WHERE selected"""

# ---- violin statistics

ORACLE["group_stats"] = f"""{ctes(FLAWED)}, long AS ({unpivoted("clean", f"{DAY}, {CONC}", MEASURES)})
SELECT {DAY}, {CONC}, feature, count(value) AS n, {r("median(value)")} AS median, {r("avg(value)")} AS mean
FROM long WHERE value IS NOT NULL GROUP BY {DAY}, {CONC}, feature"""


def kruskal(long: str, name: str, by: str) -> str:
    """``by, groups, n, h, p`` across ``grp`` in ``long(by, grp, value)``, by the textbook formula."""
    return f"""{name}_v AS (SELECT {by}, grp FROM {long} WHERE value IS NOT NULL GROUP BY {by}, grp HAVING count(DISTINCT value) > 1),
{name}_l AS (SELECT {by}, grp, value FROM {long} SEMI JOIN {name}_v USING ({by}, grp) WHERE value IS NOT NULL),
{name}_r AS (SELECT {by}, grp, value, rank() OVER (PARTITION BY {by} ORDER BY value)
    + (count(*) OVER (PARTITION BY {by}, value) - 1) / 2.0 AS place FROM {name}_l),
{name}_g AS (SELECT {by}, grp, count(*) AS ng, sum(place) AS ranks FROM {name}_r GROUP BY {by}, grp),
{name}_t AS (SELECT {by}, sum(t * t * t - t) AS ties FROM (
    SELECT {by}, value, CAST(count(*) AS DOUBLE) AS t FROM {name}_l GROUP BY {by}, value) GROUP BY {by}),
{name}_h AS (SELECT {by}, count(*) AS groups, CAST(sum(ng) AS BIGINT) AS n,
    12.0 * sum(ng * power(ranks / ng - (total + 1) / 2, 2)) / (any_value(total) * (any_value(total) + 1)) AS plain, any_value(total) AS total
  FROM {name}_g JOIN (SELECT {by}, CAST(sum(ng) AS DOUBLE) AS total FROM {name}_g GROUP BY {by}) USING ({by}) GROUP BY {by}),
{name}_f AS (SELECT {by}, groups, n, plain / (1 - ties / (power(total, 3) - total)) AS h
  FROM {name}_h JOIN {name}_t USING ({by}) WHERE groups >= 2),
{name} AS (SELECT {by}, groups, n, h, greatest(0.0, 1.0
    - list_sum(list_transform(range(0, CAST(h AS BIGINT) + 400), lambda i: exp(((groups - 1) / 2.0 + i) * ln(h / 2) - h / 2 - lgamma((groups - 1) / 2.0 + i + 1))))) AS p FROM {name}_f)"""


ORACLE["kruskal_events"] = f"""{ctes(EVENTS, f"ev AS (SELECT {DAY}, pop AS grp, value FROM event_long)", kruskal("ev", "kw", DAY))}
SELECT {DAY}, groups, n, {r("h")} AS h, {r("p")} AS p, p < 0.05 AS significant FROM kw"""
ORACLE["kruskal_parts"] = f"""WITH long AS (SELECT 'l_quantity' AS feature, l_partkey AS grp, CAST(l_quantity AS DOUBLE) AS value FROM lineitem),
{kruskal("long", "kw", "feature")}
SELECT feature, groups, n, {r("h")} AS h, {r("p")} AS p, p < 0.05 AS significant FROM kw"""
ORACLE["kruskal_doses"] = f"""{ctes(MEASURE)}, long AS ({unpivoted("measure", f"{DAY}, {CONC} AS grp", MEASURES)}),
{kruskal("long", "kw", f"feature, {DAY}")}
SELECT feature, {DAY}, groups, n, {r("h")} AS h, {r("p")} AS p, p < 0.05 AS significant FROM kw"""
ORACLE["mean_difference_flags"] = f"""{ctes(STD)}, long AS ({unpivoted("std", f"{DAY}, {CONC}, {CONC} AS grp", STANDARDIZED)}),
{kruskal("long", "kw", f"feature, {DAY}")},
st AS (SELECT feature, {DAY}, {CONC}, count(value) AS n, median(value) AS median, avg(value) AS mean FROM long GROUP BY ALL),
fl AS (SELECT a.feature, a.{DAY}, bool_or(b.mean <> a.mean AND b.mean <> 0 AND abs(a.mean - b.mean) / b.mean > 0.3) AS f
  FROM st a JOIN st b ON a.feature = b.feature AND a.{DAY} = b.{DAY} GROUP BY ALL),
sg AS (SELECT a.feature, a.{DAY}, a.{CONC}, bool_or(b.mean <> a.mean AND b.mean <> 0 AND abs(a.mean - b.mean) / abs(b.mean) > 0.3) AS s
  FROM st a JOIN st b ON a.feature = b.feature AND a.{DAY} = b.{DAY} GROUP BY ALL)
SELECT feature, {DAY}, {CONC}, st.n, {r("median")} AS median, {r("mean")} AS mean,
  f AND kw.feature IS NOT NULL AS mean_flag, f AND s AND kw.feature IS NOT NULL AS star
FROM st JOIN fl USING (feature, {DAY}) JOIN sg USING (feature, {DAY}, {CONC}) LEFT JOIN kw USING (feature, {DAY})"""

# ---- subsets

STRATA = {
    "day_concentration": (DAY, CONC),
    "day_biorep": (DAY, BIOREP),
    "concentration_biorep": (CONC, BIOREP),
    "day_concentration_biorep": (DAY, CONC, BIOREP),
    "day": (DAY,),
    "concentration": (CONC,),
}
ORACLE["stratum_counts"] = ctes(MEASURE) + " UNION ALL ".join(
    f" SELECT '{name}' AS stratum, "
    + ", ".join(f"{k if k in keys else 'NULL'} AS {k}" for k in (DAY, CONC, BIOREP))
    + f', count(*) AS "Counts" FROM measure GROUP BY {", ".join(keys)}'
    for name, keys in STRATA.items()
)
def _sample(cap: str, where: str = "") -> str:
    ranked = f"""drawn AS (SELECT "cell_ID", {DAY}, {CONC}, {cap} AS cap,
  row_number() OVER (PARTITION BY {DAY}, {CONC} ORDER BY md5("cell_ID" || ':1'), "cell_ID") AS place FROM sized {where})"""
    sized = f"""sizes AS (SELECT {DAY}, {CONC}, count(*) AS size FROM measure GROUP BY {DAY}, {CONC}),
least_sizes AS (SELECT {DAY}, min(size) AS least_size FROM sizes GROUP BY {DAY}),
sized AS (SELECT * FROM measure JOIN least_sizes USING ({DAY}))"""
    return f"""{ctes(MEASURE, sized, ranked)} SELECT "cell_ID", {DAY}, {CONC} FROM drawn WHERE place <= cap"""


ORACLE["sample_capped"] = _sample("900")
ORACLE["sample_capped_without_top_dose"] = _sample("900", f"WHERE {CONC} <> 2")
ORACLE["sample_by_cap"] = _sample(f"CASE {CONC} WHEN 2 THEN 900 WHEN 3 THEN 1200 ELSE 1500 END")
ORACLE["sample_equal"] = _sample("least_size")

HOLED = FLAWED + """,
holed AS (SELECT *, CASE WHEN l_orderkey % 3 <> 0 THEN l_tax END AS holes,
  CASE WHEN l_orderkey % 5 = 0 THEN 'Infinity'::DOUBLE ELSE 2.5 END AS flat,
  l_quantity AS "Number_Object_Number_x" FROM flawed)"""
REPORTED = (*MEASURES, "holes", "flat", "Number_Object_Number_x")
REPORT = HOLED + ",\nreport AS (" + " UNION ALL ".join(
    f"""SELECT '{f}' AS feature, 100.0 * (count(*) - count(v)) / count(*) AS missing_percent,
    100.0 * (count(*) - count(v)) / count(*) >= 30 AS too_missing,
    coalesce(count(k) >= 2 AND min(k) = max(k), false) AS zero_variance,
    {str('Number_Object_Number' in f).lower()} AS object_number, {str(f == 'l_discount').lower()} AS excluded
    FROM (SELECT CASE WHEN NOT isnan("{f}") THEN "{f}" END AS v, CASE WHEN isfinite("{f}") THEN "{f}" END AS k FROM holed)"""
    for f in REPORTED
) + ")"
GONE = "too_missing OR zero_variance OR object_number OR excluded"
ORACLE["filter_report"] = f"""{ctes(REPORT)} SELECT feature, {r("missing_percent")} AS missing_percent,
  too_missing, zero_variance, object_number, excluded, {GONE} AS removed FROM report"""
ORACLE["filter_summary"] = f"""{ctes(REPORT)} SELECT count(*) AS features, count(*) FILTER ({GONE}) AS removed,
  count(*) FILTER (too_missing) AS too_missing, count(*) FILTER (zero_variance) AS zero_variance,
  count(*) FILTER (object_number) AS object_number, count(*) FILTER (excluded) AS excluded FROM report"""
ORACLE["filter_features"] = f"""{ctes(HOLED)} SELECT {META_LIST}, {rounded_list(("l_quantity", "l_extendedprice", "l_tax"))} FROM holed"""

# ---- dose response

SERIES_TAIL = f""",
points AS (SELECT "Feature", {DAY} AS "Day", CAST(10 - CAST("Population1" AS INTEGER) AS INTEGER) AS x, "EMD_score" AS y
  FROM dose_scores WHERE {VS_CONTROL} AND "Population1" <> '2'),
series AS (SELECT * FROM points WHERE ("Feature", "Day") IN (SELECT ("Feature", "Day") FROM points GROUP BY "Feature", "Day" HAVING count(*) = 8))"""
SERIES = DOSE + SERIES_TAIL
ORACLE["dose_series"] = f"""{ctes(SERIES)} SELECT "Feature", "Day", x, {r("y")} AS y FROM series"""
LINES_TAIL = """,
lines AS (SELECT "Feature", "Day", regr_slope(y, x) AS slope, regr_intercept(y, x) AS icept, avg(y) AS level FROM series GROUP BY ALL),
resid AS (SELECT "Feature", "Day", any_value(slope) AS slope, any_value(icept) AS icept, any_value(level) AS level,
    sum(power(y - slope * x - icept, 2)) AS line_ssr, sum(power(y - level, 2)) AS level_ssr
  FROM series JOIN lines USING ("Feature", "Day") GROUP BY "Feature", "Day")"""
LINES = SERIES + LINES_TAIL
ORACLE["fit_lines"] = f"""{ctes(LINES)} SELECT "Feature", "Day", {r("slope", 3)} AS "Slope", {r("icept", 3)} AS "Intercept",
  {r("level", 3)} AS "Level", {r("line_ssr", 3)} AS line_ssr, {r("level_ssr", 3)} AS level_ssr FROM resid"""

def _curve_fits() -> str:
    """Pattern search of the curve models from the best point of each cell of a wide grid.

    Its own search, by its own formulas: plain normal equations on values scaled by the largest, cells of slope and midpoint,
    and moves that shrink. Only the curves themselves are shared with the fits it checks.
    """
    id_ = '"Feature", "Day", "Model"'
    # The residual of a candidate (id_, y, b, m): shape on the doses 0..7, intercept out, one or two directions out.
    def residual(source: str, keep: str) -> str:
        spread = "list_transform(range(0, 8), lambda i: b * (ln(i + 1e-10) - m))"
        logs = """CASE WHEN "Model" = 'WB1.4' THEN list_transform(s, lambda v: CASE WHEN low THEN CASE WHEN v < -6 THEN v + ln(1 - exp(v) / 2 + exp(2 * v) / 6 - exp(3 * v) / 24) ELSE ln(1 - exp(-exp(least(v, 700)))) END ELSE -exp(least(v, 700)) END)
      WHEN low AND "Model" <> 'BC4' THEN list_transform(s, lambda v: -greatest(-v, 0) - ln(1 + exp(-abs(v))))
      ELSE list_transform(s, lambda v: -greatest(v, 0) - ln(1 + exp(-abs(v)))) END"""
        second = "list_transform(range(0, 8), lambda i: CASE WHEN i = 0 THEN -1e300 ELSE ln(greatest(i, 1)) - greatest(s[i + 1], 0) - ln(1 + exp(-abs(s[i + 1]))) END)"
        return f"""SELECT {keep}, b, m, (dyy - CASE WHEN pp > 1e-26 THEN py * py / pp ELSE 0 END
      - CASE WHEN two AND qq > 1e-14 * hh THEN qy * qy / qq ELSE 0 END) AS miss
  FROM (SELECT *, list_inner_product(q, q) AS qq, list_inner_product(q, dy) AS qy, list_inner_product(h, h) AS hh
  FROM (SELECT *, CASE WHEN pp > 1e-26 THEN list_transform(range(1, 9), lambda i: h[i] - ph / pp * p[i]) ELSE h END AS q
  FROM (SELECT *, list_inner_product(p, p) AS pp, list_inner_product(p, dy) AS py, list_inner_product(p, h) AS ph, list_inner_product(dy, dy) AS dyy
  FROM (SELECT *, "Model" IN ('BC4', 'BC5') AS two, list_transform(y, lambda v: v - f * list_avg(y)) AS dy,
    list_transform(g, lambda v: v - f * list_avg(g)) AS p, list_transform(xg, lambda v: v - f * list_avg(xg)) AS h
  FROM (SELECT *, list_transform(lg, lambda v: exp(greatest(v - list_max(lg), -745))) AS g, list_transform(lx, lambda v: exp(greatest(v - list_max(lx), -745))) AS xg,
    CASE "Model" WHEN 'BC4' THEN 0.0 ELSE 1.0 END AS f
  FROM (SELECT *, {logs} AS lg, {second} AS lx
  FROM (SELECT *, list_median(s) < 0 AS low FROM (SELECT *, {spread} AS s FROM {source}))))))))"""

    moved = f"""(SELECT {id_}, y, origin, step, turn, miss AS before, b * exp(step * db) AS b,
      CASE WHEN held THEN m * exp(-step * db) ELSE m END + step * dm * (1 + 1 / abs(b)) AS m
    FROM search, unnest([-1, -0.3, 0, 0.3, 1]) AS t(db), unnest([-1, -0.3, 0, 0.3, 1]) AS t2(dm),
      unnest([true, false]) AS t3(held) WHERE turn < 400 AND step > 1e-5)"""
    return f"""vectors AS MATERIALIZED (SELECT "Feature", "Day", list(y ORDER BY x) AS y FROM series GROUP BY ALL),
cells AS (SELECT {id_}, y, CAST(sign * exp(0.2 * i) AS DOUBLE) AS b, CAST(m AS DOUBLE) AS m, i // 2 AS cell_b, CAST(floor(m / 2) AS INTEGER) AS cell_m
  FROM vectors, unnest(['BC4', 'BC5', 'LL4', 'WB1.4']) AS t("Model"), unnest([1.0, -1.0]) AS t2(sign), range(-20, 28) AS t3(i),
    (SELECT k * 0.75 - 24 AS m FROM range(0, 56) AS t4(k) UNION ALL SELECT k * 0.06 - 1 AS m FROM range(0, 60) AS t5(k)
     UNION ALL SELECT ln(k) FROM range(1, 8) AS t6(k))
  WHERE "Model" <> 'LL4' OR sign > 0),
coarse AS ({residual("cells", f"{id_}, y, cell_b, cell_m")}),
winners AS (SELECT {id_}, y, arg_min(b, miss) AS b, arg_min(m, miss) AS m, min(miss) AS miss FROM coarse GROUP BY {id_}, y, cell_b, cell_m, b > 0),
origins AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {id_} ORDER BY miss, b, m) AS origin FROM winners) WHERE origin <= 16),
found AS (
  WITH RECURSIVE search AS (
    SELECT {id_}, y, origin, b, m, miss, CAST(0.2 AS DOUBLE) AS step, 0 AS turn FROM origins
    UNION ALL
    SELECT {id_}, any_value(y), origin, arg_min(b, miss), arg_min(m, miss), min(miss),
      CASE WHEN min(miss) < any_value(before) THEN any_value(step) * 1.4 ELSE any_value(step) * 0.6 END, any_value(turn) + 1
    FROM ({residual(moved, f"{id_}, y, origin, step, turn, before")})
    GROUP BY {id_}, origin)
  SELECT {id_}, min(miss) AS ssr FROM search GROUP BY {id_}),
fits AS (SELECT "Feature", "Day", "Model", 8 * ln(ssr / 8) + 2 * k AS "AIC", 8 * ln(ssr / 8) + k * ln(8) AS "BIC", slope AS "Slope" FROM (
    SELECT {id_}, ssr, CAST(NULL AS DOUBLE) AS slope, CASE "Model" WHEN 'BC5' THEN 5 ELSE 4 END AS k FROM found
    UNION ALL SELECT "Feature", "Day", 'Lin', line_ssr, slope, 2 FROM resid
    UNION ALL SELECT "Feature", "Day", 'Con', level_ssr, NULL, 1 FROM resid))"""
FITS = LINES + ",\n" + _curve_fits()
ORACLE["fit_models"] = f"""{ctes(FITS)} SELECT "Feature", "Day", "Model", {r('"AIC"', 3)} AS "AIC", {r('"BIC"', 3)} AS "BIC", {r('"Slope"', 3)} AS "Slope" FROM fits"""
SELECTED = """days AS (SELECT "Feature", "Day", min("AIC" + "BIC") AS best, min(CASE WHEN "Model" = 'Con' THEN "AIC" + "BIC" END) AS flat,
  bool_or("Model" = 'Lin' AND "Slope" > 0) AS rises FROM fits GROUP BY "Feature", "Day"),
selected AS (SELECT "Feature" FROM days GROUP BY "Feature" HAVING bool_or(rises) AND NOT bool_or(coalesce(flat = best, false)))"""
ORACLE["select_features"] = f"""{ctes(FITS, SELECTED)} SELECT "Feature" FROM selected"""
_SHIFTED = ("rp_norm_l_tax", "rp_norm_shifted", "rp_norm_bent")
SHIFTED = STD + f""",
shifted AS (SELECT {META_LIST}, rp_norm_l_tax, rp_norm_l_quantity + (11 - {CONC}) * 4 AS rp_norm_shifted,
  rp_norm_l_quantity + greatest(0, 7 - {CONC}) * 6 AS rp_norm_bent FROM std)"""
SHIFTED_FITS = dose_ctes(SHIFTED, "shifted", _SHIFTED) + SERIES_TAIL + LINES_TAIL + ",\n" + _curve_fits()
ORACLE["select_responding"] = f"""{ctes(SHIFTED_FITS, SELECTED)} SELECT "Feature" FROM selected"""
ORACLE["fit_responding"] = f"""{ctes(SHIFTED_FITS)} SELECT "Feature", "Day", "Model", {r('"AIC"', 3)} AS "AIC", {r('"BIC"', 3)} AS "BIC", {r('"Slope"', 3)} AS "Slope" FROM fits"""

# ---- correlation

_WIDE = (*STANDARDIZED, "rp_norm_twice", "rp_norm_negated", "rp_norm_even", "rp_norm_holed")
WIDE = STD + f""",
wide AS (SELECT *, rp_norm_l_quantity * 2 + rp_norm_l_tax AS rp_norm_twice, 0.0 - rp_norm_l_extendedprice + rp_norm_l_tax AS rp_norm_negated,
  1.5 AS rp_norm_even, CASE WHEN rp_norm_l_quantity > -20 THEN rp_norm_l_quantity + rp_norm_l_tax * 3 END AS rp_norm_holed FROM std),
full_wide AS (SELECT {META_LIST}, {", ".join(f"coalesce({f}, avg({f}) OVER ()) AS {f}" for f in _WIDE)} FROM wide),
wells AS (SELECT {WELL_KEYS}, {", ".join(f"CAST(median({f}) AS DOUBLE) AS {f}" for f in _WIDE)} FROM full_wide GROUP BY {WELL_KEYS}),
well_long AS ({unpivoted("wells", WELL_KEYS, _WIDE)}),
corr AS (SELECT a.feature AS feature_a, b.feature AS feature_b,
    CASE WHEN stddev_samp(a.value) > 0 AND stddev_samp(b.value) > 0 THEN corr(a.value, b.value) END AS r
  FROM well_long a JOIN well_long b USING ({WELL_KEYS}) WHERE a.feature < b.feature GROUP BY a.feature, b.feature)"""
ORACLE["feature_correlation"] = f"""{ctes(WIDE)} SELECT feature_a, feature_b, {r("r", 6)} AS r,
  {r("CASE WHEN r IS NULL THEN 1.0 ELSE greatest(1 - abs(r), 0) END", 6)} AS distance FROM corr"""
# One merge per step: of the two closest clusters, while their mean distance is below the threshold.
LINKAGE = WIDE + """,
apart AS (SELECT feature_a, feature_b, CASE WHEN r IS NULL THEN 1.0 ELSE greatest(1 - abs(r), 0) END AS distance FROM corr),
both_ways AS (SELECT feature_a AS a, feature_b AS b, distance FROM apart UNION ALL SELECT feature_b, feature_a, distance FROM apart),
c AS (SELECT 0 AS step, a AS feature, a AS label FROM both_ways GROUP BY a
  UNION ALL
  SELECT step + 1, feature, CASE WHEN label = lb THEN la ELSE label END FROM c, (
    SELECT la, lb FROM (SELECT x.label AS la, y.label AS lb, avg(distance) AS m FROM c x JOIN c y ON x.label < y.label
      JOIN both_ways ON a = x.feature AND b = y.feature GROUP BY x.label, y.label) WHERE m < 0.1 ORDER BY m, la, lb LIMIT 1) best),
clustered AS (SELECT feature, label FROM c WHERE step = (SELECT max(step) FROM c)),
numbered AS (SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS cluster, CAST(count(*) AS INTEGER) AS members FROM clustered GROUP BY label)"""
_LINKED = ctes(LINKAGE).replace("WITH ", "WITH RECURSIVE ", 1)
ORACLE["cluster_features"] = f"{_LINKED} SELECT cluster, feature FROM clustered JOIN numbered USING (label)"
ORACLE["cluster_representatives"] = f"{_LINKED} SELECT label AS feature FROM numbered"
ORACLE["cluster_sizes"] = f"{_LINKED} SELECT cluster, members, members > 2 AS flagged FROM numbered"
ORACLE["embedding_correlation"] = f"""WITH long AS (SELECT vec_id, concat('f', i - 1) AS feature, CAST(embedding[i] AS DOUBLE) AS value
  FROM embeddings, range(1, {DIMENSIONS + 1}) t(i))
SELECT a.feature AS feature_a, b.feature AS feature_b, {r("corr(a.value, b.value)", 6)} AS r
FROM long a JOIN long b USING (vec_id) WHERE a.feature < b.feature GROUP BY a.feature, b.feature"""

# ---- categories


def nth(values, at: str) -> str:
    return f"[{', '.join(repr(v) for v in values)}][CAST({at} AS INTEGER) + 1]"


NAMED = f"""named AS (SELECT p_partkey, p_size, CASE
  WHEN p_partkey % 50 = 0 THEN concat('counts_', {nth(["RelateLysoCell", "RelateMitoCell", "FilteredNuclei", "Cells", "Cytoplasm", "Blob"], "p_partkey % 6")})
  WHEN p_partkey % 77 = 0 THEN concat('raw_', p_brand)
  ELSE concat('rp_norm_', {nth(["AreaShape", "Granularity", "Intensity", "RadialDistribution", "Texture", "Mean", "Number", "Shade"], "p_partkey % 8")},
    '_', p_size, '_', {nth(["GrayLys", "GrayMito", "GrayNuclei", "None"], "p_partkey % 4")}, '_',
    {nth(["RelateLysoCell", "RelateMitoCell", "FilteredNuclei", "Cells", "Cytoplasm", "Blob"], "p_partkey % 6")}) END AS feature FROM part)"""
GUESSED = """token AS (SELECT DISTINCT feature, split_part(substr(feature, 9), '_', 1) AS token FROM named),
guess0 AS (SELECT feature, CASE WHEN starts_with(feature, 'counts_') THEN 'Counts'
  WHEN starts_with(feature, 'rp_norm_') THEN CASE token WHEN 'Mean' THEN 'Correlation' ELSE token END ELSE '' END AS category FROM token),
guess AS (SELECT feature, category, CASE WHEN category = 'Correlation' THEN 'Other'
  WHEN contains(feature, '_GrayLys_') THEN 'Lysosomes' WHEN contains(feature, '_GrayMito_') THEN 'Mitochondria'
  WHEN contains(feature, '_GrayNuclei_') THEN 'Nuclei'
  WHEN ends_with(feature, '_RelateLysoCell') THEN 'Lysosomes' WHEN ends_with(feature, '_RelateMitoCell') THEN 'Mitochondria'
  WHEN ends_with(feature, '_FilteredNuclei') THEN 'Nuclei'
  WHEN ends_with(feature, '_Cells') OR ends_with(feature, '_Cytoplasm') THEN 'Other' ELSE '' END AS organelle FROM guess0)"""
LOOKUP = f"""lookup0 AS (SELECT feature, min(p_partkey) AS k FROM named WHERE p_size <= 30 GROUP BY feature),
lookup AS (SELECT feature, CASE WHEN k % 9 = 0 THEN '' WHEN k % 10 = 0 THEN 'Odd' ELSE {nth(["Texture", "Intensity", "AreaShape", "Correlation"], "k % 4")} END AS category,
  CASE WHEN k % 12 = 0 THEN '' WHEN k % 15 = 0 THEN 'Golgi' ELSE {nth(["Nuclei", "Lysosomes", "Mitochondria", "Other"], "k % 4")} END AS organelle FROM lookup0)"""
ORACLE["guess_categories"] = f"{ctes(NAMED, GUESSED)} SELECT feature, category, organelle FROM guess"
ORACLE["upsert_lookup"] = f"""{ctes(NAMED, GUESSED, LOOKUP)}
SELECT feature, category, organelle, false AS added, false AS unresolved FROM lookup
UNION ALL SELECT feature, category, organelle, true, category = '' OR organelle = '' FROM guess
WHERE feature NOT IN (SELECT feature FROM lookup)"""
ORACLE["duplicate_names"] = f"{ctes(NAMED)} SELECT feature AS name, count(*) AS times FROM named GROUP BY feature HAVING count(*) > 1"
_LABEL_COLUMN = """CASE category WHEN 'Counts' THEN 'Counts' WHEN 'Number' THEN 'Counts' WHEN 'AreaShape' THEN 'AreaShape'
  WHEN 'Granularity' THEN 'Granularity' WHEN 'Intensity' THEN 'Intensity' WHEN 'RadialDistribution' THEN 'Radial Distribution'
  WHEN 'Texture' THEN 'Texture' WHEN 'Correlation' THEN 'Other/Correlation' END"""
_LABEL_ROW = """CASE organelle WHEN 'Nuclei' THEN 'Nuclei (Hoecst)' WHEN 'Lysosomes' THEN 'Lysosomes (Quinacrine)'
  WHEN 'Mitochondria' THEN 'Mitochondria (TMRM)' WHEN 'Other' THEN 'Other' END"""
PLACED = f"""placed AS (SELECT named.feature, category, organelle, lookup.feature IS NOT NULL AS known,
  {_LABEL_COLUMN} AS col, {_LABEL_ROW} AS row FROM named LEFT JOIN lookup USING (feature))"""
_COLUMNS = ("Counts", "AreaShape", "Granularity", "Intensity", "Radial Distribution", "Texture", "Other/Correlation")
_ROWS = ("Nuclei (Hoecst)", "Lysosomes (Quinacrine)", "Mitochondria (TMRM)", "Other")
ORACLE["category_crosstab"] = f"""{ctes(NAMED, LOOKUP, PLACED)},
rows AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{v}')" for i, v in enumerate(_ROWS))}) t(position, organelle))
SELECT position, rows.organelle, {", ".join(f"nullif(count(*) FILTER (col = '{c}'), 0) AS " + '"' + c + '"' for c in _COLUMNS)}
FROM rows LEFT JOIN placed ON placed.row = rows.organelle GROUP BY position, rows.organelle"""
ORACLE["category_margins"] = f"""{ctes(NAMED, LOOKUP, PLACED)}
SELECT col AS category, count(*) AS features FROM placed WHERE col IS NOT NULL AND row IS NOT NULL GROUP BY col
UNION ALL SELECT NULL, count(*) FROM placed WHERE col IS NOT NULL AND row IS NOT NULL"""
ORACLE["unplaced_features"] = f"""{ctes(NAMED, LOOKUP, PLACED)}
SELECT feature, CASE WHEN NOT known THEN 'not in the lookup' ELSE concat_ws('; ',
  CASE WHEN category = '' THEN 'category blank' WHEN col IS NULL THEN concat('category ''', category, ''' is not in category_labels') END,
  CASE WHEN organelle = '' THEN 'organelle blank' WHEN row IS NULL THEN concat('organelle ''', organelle, ''' is not in organelle_labels') END) END AS reason
FROM placed WHERE NOT known OR col IS NULL OR row IS NULL"""

# ---- image quality control

MANIFEST = """manifest AS (SELECT doc_id AS "ImageNumber", concat(source, '_', doc_id, '_lys.tif') AS "Image_FileName_Lys",
  concat(source, '_', doc_id, '_mito.tif') AS "Image_FileName_Mito", concat(source, '_', doc_id, '_nuc.tif') AS "Image_FileName_Nuclei" FROM documents),
flagged AS (
  SELECT manifest.*, CAST(quality = 0 AS BIGINT) AS "Artefacts  Image Count", CAST(NULL AS BIGINT) AS "Empty  Image Count",
    CAST(NULL AS BIGINT) AS "Oversaturated  Image Count" FROM manifest LEFT JOIN labels ON "ImageNumber" = doc_id
  UNION ALL SELECT manifest.*, NULL, CAST(n_chars < 200 AS BIGINT), NULL FROM manifest LEFT JOIN documents ON "ImageNumber" = doc_id
  UNION ALL SELECT manifest.*, NULL, NULL, CAST(toxic AS BIGINT) FROM manifest LEFT JOIN labels ON "ImageNumber" = doc_id)"""
_FILES = ('"Image_FileName_Lys"', '"Image_FileName_Mito"', '"Image_FileName_Nuclei"')
REMOVAL = MANIFEST + """,
hit AS (SELECT * FROM flagged WHERE "Artefacts  Image Count" = 1 OR "Empty  Image Count" = 1 OR "Oversaturated  Image Count" = 1),
removal AS (""" + " UNION ".join(f"SELECT {f} AS remove FROM hit" for f in _FILES) + ")"
ORACLE["attach_tags"] = f"{ctes(MANIFEST)} SELECT * FROM flagged"
ORACLE["removal_list"] = f"{ctes(REMOVAL)} SELECT remove FROM removal"
ORACLE["split_manifest"] = f"""{ctes(REMOVAL)}, files AS ({" UNION ALL ".join(f'SELECT {f} AS file FROM manifest' for f in _FILES)}),
listed AS (SELECT remove FROM removal UNION SELECT concat('absent_', "ImageNumber") FROM manifest WHERE "ImageNumber" % 10 = 3)
SELECT file, CASE WHEN file IN (SELECT remove FROM listed) THEN 'removed' ELSE 'kept' END AS status FROM files
UNION ALL SELECT remove, 'missing' FROM listed WHERE remove NOT IN (SELECT file FROM files)"""
ORACLE["image_ranges"] = """WITH c AS (SELECT count(*) // 3 AS images, count(*) // 3 // 20 AS per FROM pages)
SELECT i AS instance, (i - 1) * per + 1 AS first_image, CASE WHEN i = 20 THEN images ELSE i * per END AS last_image FROM c, range(1, 21) t(i)"""

# ---- identity and lineage

LINEAGE = """cells AS (SELECT CAST(n_regionkey AS BIGINT) AS image, o_orderkey AS number,
    CASE WHEN o_orderpriority <> '5-LOW' THEN o_custkey END AS parent
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
middle AS (SELECT CAST(n_regionkey AS BIGINT) AS image, c_custkey AS number, CAST(c_nationkey AS BIGINT) AS parent
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
nuclei AS (SELECT CAST(n_regionkey AS BIGINT) AS image, CAST(n_nationkey AS BIGINT) AS number, n_name FROM nation)"""
ORACLE["link_chain"] = f"""{ctes(LINEAGE)},
via AS (SELECT m.image, m.parent, CASE WHEN c.number IS NOT NULL THEN concat(c.image, '_', c.number) END AS "cell_ID"
  FROM middle m LEFT JOIN cells c ON c.image = m.image AND c.parent = m.number)
SELECT n.image AS "ImageNumber", n.number AS "ObjectNumber", n_name, "cell_ID"
FROM nuclei n LEFT JOIN via ON via.image = n.image AND via.parent = n.number"""
ORACLE["link_via"] = f"""{ctes(LINEAGE)}
SELECT c.image AS "ImageNumber", c.number AS "ObjectNumber", c.parent AS "Parent_PunctaMito",
  CASE WHEN m.number IS NOT NULL THEN concat(m.image, '_', m.parent) END AS "cell_ID"
FROM cells c LEFT JOIN middle m ON m.image = c.image AND m.number = c.parent"""
ORACLE["link_direct"] = f"""{ctes(LINEAGE)} SELECT image AS "ImageNumber", number AS "ObjectNumber", parent AS "Parent_FilteredNuclei",
  concat(image, '_', parent) AS "cell_ID" FROM middle"""
ORACLE["exclude_site"] = f"""{ctes(MEASURE)}, s AS (SELECT {WELL}, CASE WHEN l_orderkey % 6 <> 0 THEN concat(l_orderkey % 6, '_1') END AS "Metadata_Site" FROM measure)
SELECT {WELL}, "Metadata_Site", count(*) AS n FROM s
WHERE "Metadata_Site" IS NULL OR NOT ({WELL} = 'B11' AND starts_with("Metadata_Site", '5_')) GROUP BY ALL"""
ORACLE["parse_wells"] = f"""SELECT p_partkey, p_brand AS {WELL}, nullif(regexp_extract(p_brand, '[A-Z]'), '') AS {TECH},
  TRY_CAST(nullif(regexp_extract(p_brand, '\\d+'), '') AS INTEGER) AS {CONC} FROM part"""
ORACLE["normalize_keys"] = f"""{ctes(MEASURE)}, k AS (SELECT {DAY}, CASE WHEN {CONC} <> 5 THEN {BIOREP} END AS {BIOREP}, {WELL} FROM measure)
SELECT {DAY}, {BIOREP}, {WELL}, {DAY} || '_' || {WELL} || '_' || {BIOREP} AS "Day_Well_BR", count(*) AS n FROM k GROUP BY ALL"""
ORACLE["drop_matching_columns"] = f"""{ctes(MEASURE)} SELECT "cell_ID", {r("l_discount")} AS "Intensity_GrayNuclei_FilteredNuclei" FROM measure"""
ORACLE["select_listed"] = f"{ctes(MEASURE)} SELECT {META_LIST}, {rounded_list(('l_quantity', 'l_tax'))} FROM measure"
ORACLE["remap_replicas"] = f"""{ctes(MEASURE)} SELECT CASE {TECH} WHEN 'B' THEN 'B' WHEN 'C' THEN 'B' ELSE 'C' END AS {TECH}, {DAY}, count(*) AS n
FROM measure GROUP BY 1, 2"""
ORACLE["highlight_bioreps"] = f"""{ctes(MEASURE)}, v AS (SELECT unnest(['BR1', 'BR2', 'BR3', 'BR4']) AS highlight)
SELECT highlight, CASE WHEN {BIOREP} = highlight THEN concat('Metadata_Biorep ', highlight) ELSE 'Other' END AS "Color",
  CASE WHEN {BIOREP} = highlight THEN 20 ELSE 9 END AS "Size", count(*) AS n FROM measure, v GROUP BY ALL"""
ORACLE["dose_colors"] = f"""{ctes(MEASURE)}
SELECT {CONC}, ['#313695', '#4575b4', '#74add1', '#abd9e9', '#e0f3f8', '#fee090', '#fdae61', '#f46d43', '#d73027', '#a50026']
  [(row_number() OVER (ORDER BY {CONC} DESC) - 1) % 10 + 1] AS color FROM (SELECT DISTINCT {CONC} FROM measure)"""
ORACLE["day_labels"] = f"{ctes(MEASURE)} SELECT {DAY}, count(*) AS n, concat('Day ', substr({DAY}, 2)) AS label FROM measure GROUP BY {DAY}"

# ---- imputation and scaling

ORACLE["sanitize_values"] = f"{ctes(FLAWED)} SELECT {META_LIST}, {rounded_list(MEASURES)} FROM clean"
ORACLE["impute_mean"] = f"""{ctes(FLAWED)} SELECT "cell_ID", {", ".join(f'{r(f"coalesce({f}, (SELECT avg({f}) FROM clean))")} AS {f}' for f in MEASURES)} FROM clean"""
ORACLE["impute_median"] = f"""{ctes(FLAWED)} SELECT "cell_ID", {", ".join(f'{r(f"coalesce({f}, (SELECT median({f}) FROM clean))")} AS {f}' for f in MEASURES)} FROM clean"""
ORACLE["impute_group_mean"] = f"""{ctes(FLAWED)}, m AS (SELECT {CONC}, {", ".join(f"avg({f}) AS m_{f}" for f in MEASURES)} FROM clean GROUP BY {CONC})
SELECT "cell_ID", {CONC}, {", ".join(f'{r(f"coalesce({f}, m_{f})")} AS {f}' for f in MEASURES)} FROM clean JOIN m USING ({CONC})"""
ORACLE["center"] = f"""{ctes(MEASURE)} SELECT "cell_ID", {", ".join(f'{r(f"{f} - (SELECT avg({f}) FROM measure)", 8)} AS {f}' for f in MEASURES)} FROM measure"""
VECTORS = "vec AS (SELECT vec_id, CAST(label + 2 AS INTEGER) AS \"Concentration\", " + ", ".join(
    f"CAST(embedding[{i + 1}] AS DOUBLE) AS f{i}" for i in range(DIMENSIONS)
) + " FROM embeddings)"


def scaled(f: str) -> str:
    return f"coalesce(({f} - min({f}) OVER ()) / nullif(max({f}) OVER () - min({f}) OVER (), 0), 0.0)"


ORACLE["min_max"] = f"""{ctes(VECTORS)} SELECT vec_id, {CONC}, {", ".join(f'{r(scaled(f"f{i}"), 6)} AS f{i}' for i in range(DIMENSIONS))} FROM vec"""
ORACLE["clip_scale"] = f"""{ctes(MEASURE)}, b AS (SELECT {", ".join(f"quantile_cont({f}, 0.05) AS lo_{f}, quantile_cont({f}, 0.95) AS hi_{f}" for f in MEASURES)} FROM measure)
SELECT "cell_ID", {", ".join(f'{r(f"(least(greatest({f}, lo_{f}), hi_{f}) - lo_{f}) / nullif(hi_{f} - lo_{f}, 0)", 6)} AS {f}' for f in MEASURES)} FROM measure, b"""
ORACLE["shuffled_rows"] = f"""{ctes(MEASURE)} SELECT "cell_ID", {rounded_list(MEASURES)} FROM measure"""


def uniform(f: str) -> str:
    """Interpolate forward and backward over 1000 reference quantiles and take the middle."""
    return f"""s_{f} AS (SELECT {f} AS v, row_number() OVER (ORDER BY {f}) - 1 AS k, count(*) OVER () AS n FROM measure),
q_{f} AS (SELECT i, lo.v + (h - floor(h)) * (hi.v - lo.v) AS q
  FROM (SELECT i, i * ((SELECT count(*) FROM measure) - 1) / 999.0 AS h FROM range(0, 1000) t(i))
  JOIN s_{f} lo ON lo.k = CAST(floor(h) AS BIGINT) JOIN s_{f} hi ON hi.k = CAST(ceil(h) AS BIGINT)),
u_{f} AS (SELECT v, count(*) FILTER (q < v) AS lt, count(*) FILTER (q <= v) AS le, max(q) FILTER (q <= v) AS a, min(q) FILTER (q > v) AS b,
    v <= min(q) AS first, v >= max(q) AS last FROM (SELECT DISTINCT {f} AS v FROM measure), q_{f} GROUP BY v),
m_{f} AS (SELECT v, CASE WHEN first THEN 0.0 WHEN last THEN 1.0 WHEN le > lt THEN (lt + le - 1) / 2.0 / 999.0
    ELSE (le - 1 + (v - a) / (b - a)) / 999.0 END AS u FROM u_{f})"""


_UNI = ",\n".join(uniform(f) for f in MEASURES)
ORACLE["quantile_uniform"] = f"""{ctes(MEASURE, _UNI)} SELECT "cell_ID", {", ".join(f'{r(f"m_{f}.u", 6)} AS {f}' for f in MEASURES)}
FROM measure {" ".join(f"JOIN m_{f} ON m_{f}.v = measure.{f}" for f in MEASURES)}"""

# ---- population distances and embedding

_DIMS = [f"f{i}" for i in range(DIMENSIONS)]
POPULATIONS = VECTORS + f""",
pop AS (SELECT * REPLACE (CASE WHEN {CONC} >= 7 THEN 11 ELSE {CONC} END AS {CONC}) FROM vec)"""


def ready(source: str, name: str) -> str:
    return f"""{name} AS (SELECT vec_id, {CONC}, {", ".join(f"{scaled(f)} AS {f}" for f in _DIMS)} FROM {source})"""


def mmd(source: str, name: str, dims=tuple(_DIMS)) -> str:
    d2 = " + ".join(f"(a.{f} - b.{f}) * (a.{f} - b.{f})" for f in dims)
    return f"""{name}_k AS (SELECT a.{CONC} AS ga, b.{CONC} AS gb, avg(exp(-0.24 * ({d2}))) AS k
  FROM {source} a JOIN {source} b ON a.{CONC} = b.{CONC} OR a.{CONC} = 11 GROUP BY ga, gb),
{name} AS (SELECT x.ga AS "Group_A", x.gb AS "Group_B", aa.k + bb.k - 2 * x.k AS score
  FROM {name}_k x JOIN {name}_k aa ON aa.ga = 11 AND aa.gb = 11 JOIN {name}_k bb ON bb.ga = x.gb AND bb.gb = x.gb
  WHERE x.ga = 11 AND x.gb <> 11)"""


def mean_emd(source: str, name: str, dims=tuple(_DIMS)) -> str:
    return f"""{name}_l AS ({unpivoted(source, f"{CONC} AS pop", dims)}), {emd(f"{name}_l", f"{name}_e0", "feature")},
{name} AS (SELECT 11 AS "Group_A", p AS "Group_B", avg(score) AS score FROM {name}_e0 WHERE q = 11 GROUP BY p)"""


ORACLE["mmd"] = f"""{ctes(POPULATIONS, ready("pop", "rdy"), mmd("rdy", "m"))} SELECT "Group_A", "Group_B", {r("score", 6)} AS "MMD_Score" FROM m"""
ORACLE["mean_emd"] = f"""{ctes(POPULATIONS, ready("pop", "rdy"), mean_emd("rdy", "e"))} SELECT "Group_A", "Group_B", {r("score", 6)} AS "EMD_Score" FROM e"""
def mahalanobis(source: str, name: str, dims=tuple(_DIMS)) -> str:
    """Squared distance as the sum of squared residuals of each dimension on those before it."""
    parts = [f"""{name}_0 AS (SELECT vec_id, {CONC}, {", ".join(f"{f} - (SELECT avg({f}) FROM {source} WHERE {CONC} = 11) AS {f}" for f in dims)} FROM {source})"""]
    for k, f in enumerate(dims):
        done = [f"r{j}" for j in range(k)]
        if k == 0:
            parts.append(f"{name}_1 AS (SELECT *, {f} AS r0 FROM {name}_0)")
            continue
        slopes = ", ".join(f"sum({f} * {q}) / sum({q} * {q}) AS s_{q}" for q in done)
        left = f + "".join(f" - s_{q} * {q}" for q in done)
        keep = ", ".join([f"{name}_{k}.*"])
        parts.append(f"""{name}_{k + 1} AS (SELECT {keep}, {left} AS r{k} FROM {name}_{k},
  (SELECT {slopes} FROM {name}_{k} WHERE {CONC} = 11))""")
    d = len(dims)
    variances = ", ".join(f"sum(r{k} * r{k}) / (count(*) - 1) AS v{k}" for k in range(d))
    total = " + ".join(f"r{k} * r{k} / v{k}" for k in range(d))
    parts.append(f"""{name} AS (SELECT 11 AS "Group_A", {CONC} AS "Group_B", avg(sqrt({total})) AS score
  FROM {name}_{d}, (SELECT {variances} FROM {name}_{d} WHERE {CONC} = 11) WHERE {CONC} <> 11 GROUP BY {CONC})""")
    return ",\n".join(parts)


ORACLE["mahalanobis"] = f"""{ctes(POPULATIONS, ready("pop", "rdy"), mahalanobis("rdy", "h"))} SELECT "Group_A", "Group_B", {r("score", 6)} AS "Mahalanobis_Score" FROM h"""


def _distances() -> str:
    parts, rows = [POPULATIONS], []
    for day, odd in (("D1", 0), ("D5", 1)):
        parts += [f"v{odd} AS (SELECT * FROM pop WHERE vec_id % 2 = {odd})", ready(f"v{odd}", f"y{odd}"),
                  mmd(f"y{odd}", f"m{odd}"), mahalanobis(f"y{odd}", f"h{odd}"), mean_emd(f"y{odd}", f"e{odd}")]
        rows.append(f"""SELECT "Group_A", "Group_B", {r(f"m{odd}.score", 6)} AS "MMD_Score", {r(f"h{odd}.score", 6)} AS "Mahalanobis_Score",
  {r(f"e{odd}.score", 6)} AS "EMD_Score", '{day}' AS "Condition" FROM m{odd} JOIN h{odd} USING ("Group_A", "Group_B") JOIN e{odd} USING ("Group_A", "Group_B")""")
    return ctes(*parts) + " " + " UNION ALL ".join(rows)


ORACLE["population_distances"] = _distances()
def _sampled_distances() -> str:
    dims = ("l_quantity", "l_extendedprice", "l_tax")
    parts = [FLAWED, f"""pooled AS (SELECT "cell_ID", {DAY}, {CONC}, {", ".join(f"max({f}) AS {f}" for f in dims)} FROM clean GROUP BY "cell_ID", {DAY}, {CONC}),
placed AS (SELECT *, row_number() OVER (PARTITION BY {DAY}, {CONC} ORDER BY md5("cell_ID" || ':1'), "cell_ID") AS place FROM pooled),
filled AS (SELECT "cell_ID" AS vec_id, {DAY}, {CONC}, {", ".join(f"coalesce({f}, avg({f}) OVER (PARTITION BY {DAY}, {CONC})) AS {f}" for f in dims)}
  FROM placed WHERE place <= 300)"""]
    rows = []
    for d in ("D1", "D5", "D7", "D9"):
        parts += [f"""y{d} AS (SELECT vec_id, {CONC}, {", ".join(f"{scaled(f)} AS {f}" for f in dims)} FROM filled WHERE {DAY} = '{d}')""",
                  mmd(f"y{d}", f"m{d}", dims), mahalanobis(f"y{d}", f"h{d}", dims), mean_emd(f"y{d}", f"e{d}", dims)]
        rows.append(f"""SELECT "Group_A", "Group_B", {r(f"m{d}.score", 6)} AS "MMD_Score", {r(f"h{d}.score", 6)} AS "Mahalanobis_Score",
  {r(f"e{d}.score", 6)} AS "EMD_Score", '{d}' AS "Condition" FROM m{d} JOIN h{d} USING ("Group_A", "Group_B") JOIN e{d} USING ("Group_A", "Group_B")""")
    return ctes(*parts) + " " + " UNION ALL ".join(rows)


ORACLE["sampled_distances"] = _sampled_distances()
ORACLE["knn"] = f"""WITH d AS (SELECT a.vec_id, b.vec_id AS neighbour, sqrt(list_sum(list_transform(range(1, {DIMENSIONS + 1}),
    lambda i: power(CAST(a.embedding[i] AS DOUBLE) - CAST(b.embedding[i] AS DOUBLE), 2)))) AS distance FROM embeddings a, embeddings b),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbour) AS INTEGER) AS rank FROM d)
SELECT vec_id, neighbour, {r("distance", 6)} AS distance, rank FROM k WHERE rank <= 15"""
ORACLE["density"] = f"""WITH b AS (SELECT quantile_cont(value, 0.05) AS lo, quantile_cont(value, 0.95) AS hi FROM events),
v AS (SELECT least(greatest(value, lo), hi) AS value FROM events, b),
s AS (SELECT count(*) AS n, min(value) AS a, max(value) AS z, stddev_samp(value) * power(count(*), -0.2) AS w FROM v),
g AS (SELECT i AS point, a - 3 * w + (z - a + 6 * w) * i / 199.0 AS x, w, n FROM s, range(0, 200) t(i)),
c AS (SELECT value, count(*) AS times FROM v GROUP BY value)
SELECT 'value' AS feature, CAST(point AS INTEGER) AS point, {r("x", 6)} AS x,
  {r("sum(times * exp(-0.5 * power((x - value) / w, 2))) / (any_value(n) * any_value(w) * sqrt(2 * pi()))", 6)} AS density
FROM g, c GROUP BY point, x"""
def _power(name: str, matrix: str) -> str:
    """``name`` (lam, v): top eigenvalue and vector of ``matrix`` (m, a list of rows), by squaring it until one direction is left."""
    squared = "list_transform(m, lambda a: list_transform(m, lambda b: list_inner_product(a, b)))"
    trace = "list_sum(list_transform(range(1, len(m) + 1), lambda i: m[i][i]))"
    return f"""{name}_p AS (SELECT 0 AS t, m FROM {matrix} UNION ALL SELECT t + 1, list_transform(m, lambda a: list_transform(a, lambda c: c / w))
  FROM (SELECT t, m, {trace} AS w FROM (SELECT t, {squared} AS m FROM {name}_p WHERE t < 36))),
{name}_d AS (SELECT m, list_transform(range(1, len(m) + 1), lambda i: m[i][i]) AS d FROM {name}_p WHERE t = 36),
{name}_v AS (SELECT list_transform(m[top], lambda c: c / sqrt(m[top][top])) AS v FROM (SELECT m, list_position(d, list_max(d)) AS top FROM {name}_d)),
{name} AS (SELECT v, list_inner_product(v, list_transform(m, lambda a: list_inner_product(a, v))) AS lam FROM {name}_v, {matrix})"""


def _embedded(rows: str, k: int) -> str:
    """Coordinates on the ``k`` leading axes of ``rows`` (vec_id, i, value)."""
    parts = [f"""emb_c AS (SELECT vec_id, i, value - avg(value) OVER (PARTITION BY i) AS c FROM {rows}),
emb_s AS (SELECT a.i, b.i AS j, sum(a.c * b.c) AS s FROM emb_c a JOIN emb_c b USING (vec_id) GROUP BY a.i, b.i),
emb_0 AS (SELECT list(line ORDER BY i) AS m FROM (SELECT i, list(s ORDER BY j) AS line FROM emb_s GROUP BY i))"""]
    for j in range(k):
        parts.append(_power(f"axis{j}", f"emb_{j}"))
        left = "list_transform(range(1, len(m) + 1), lambda a: list_transform(range(1, len(m) + 1), lambda b: m[a][b] - lam * v[a] * v[b]))"
        parts.append(f"emb_{j + 1} AS (SELECT {left} AS m FROM emb_{j}, axis{j})")
    parts.append(f"emb_x AS (SELECT vec_id, list(value ORDER BY i) AS x FROM {rows} GROUP BY vec_id)")
    dims = ", ".join(r(f"list_inner_product(x, axis{j}.v)", 6) + f" AS dim{j + 1}" for j in range(k))
    return ",\n".join(parts) + f"\nSELECT vec_id, {dims} FROM emb_x, {', '.join(f'axis{j}' for j in range(k))}"


_EMBED_LONG = f"""emb_l AS (SELECT vec_id, i, CAST(embedding[i] AS DOUBLE) AS value FROM embeddings, range(1, {DIMENSIONS + 1}) t(i))"""
# The quantile transform of every dimension, as in "quantile_uniform", with a dimension's number as key.
_EMBED_UNIFORM = _EMBED_LONG + """,
emb_n AS (SELECT count(*) AS n, least(1000, count(*)) - 1 AS q FROM embeddings),
emb_k AS (SELECT i, value, row_number() OVER (PARTITION BY i ORDER BY value) - 1 AS k FROM emb_l),
emb_q AS (SELECT lo.i, lo.value + (h - floor(h)) * (hi.value - lo.value) AS q
  FROM (SELECT CAST(j AS DOUBLE) * (n - 1) / q AS h FROM emb_n, range(0, 1000) t(j) WHERE j <= q)
  JOIN emb_k lo ON lo.k = CAST(floor(h) AS BIGINT) JOIN emb_k hi ON hi.i = lo.i AND hi.k = CAST(ceil(h) AS BIGINT)),
emb_u AS (SELECT i, value, count(*) FILTER (emb_q.q < value) AS lt, count(*) FILTER (emb_q.q <= value) AS le, max(emb_q.q) FILTER (emb_q.q <= value) AS a,
    min(emb_q.q) FILTER (emb_q.q > value) AS b, value <= min(emb_q.q) AS first, value >= max(emb_q.q) AS last
  FROM (SELECT DISTINCT i, value FROM emb_l) JOIN emb_q USING (i) GROUP BY i, value),
emb_m AS (SELECT i, value, CASE WHEN first THEN 0.0 WHEN last THEN 1.0 WHEN le > lt THEN (lt + le - 1) / 2.0 / emb_n.q
    ELSE (le - 1 + (value - a) / (b - a)) / emb_n.q END AS u FROM emb_u, emb_n),
emb_r AS (SELECT vec_id, i, u AS value FROM emb_l JOIN emb_m USING (i, value))"""
ORACLE["embed_unscaled"] = "WITH RECURSIVE " + _EMBED_LONG + ",\n" + _embedded("emb_l", 2)
ORACLE["embed_doses"] = "WITH RECURSIVE " + _EMBED_UNIFORM + ",\n" + _embedded("emb_r", 2)
ORACLE["embed_three_dimensions"] = "WITH RECURSIVE " + _EMBED_UNIFORM + ",\n" + _embedded("emb_r", 3)
_EF = _DIMS
ORACLE["embedding_features"] = f"""{ctes(VECTORS)},
h AS (SELECT * REPLACE (CASE WHEN vec_id % 5 <> 0 THEN f0 END AS f0) FROM vec),
b AS (SELECT {", ".join(f"quantile_cont({f}, 0.05) AS lo_{f}, quantile_cont({f}, 0.95) AS hi_{f}" for f in _EF)} FROM h),
s AS ({" UNION ALL ".join(f"SELECT vec_id, f10, f11, '{f}' AS feature, CASE WHEN {f} IS NOT NULL THEN (least(greatest({f}, lo_{f}), hi_{f}) - lo_{f}) / (hi_{f} - lo_{f}) END AS value FROM h, b" for f in _EF)})
SELECT vec_id, {r("f10", 6)} AS dim1, {r("f11", 6)} AS dim2, feature, {r("value", 6)} AS value, value IS NULL AS missing FROM s"""
ORACLE["embedded_features"] = f"""WITH RECURSIVE {VECTORS},
b AS (SELECT {", ".join(f"quantile_cont({f}, 0.05) AS lo_{f}, quantile_cont({f}, 0.95) AS hi_{f}" for f in _EF)} FROM vec),
s AS ({" UNION ALL ".join(f"SELECT vec_id, '{f}' AS feature, (least(greatest({f}, lo_{f}), hi_{f}) - lo_{f}) / (hi_{f} - lo_{f}) AS value FROM vec, b" for f in _EF)}),
{_EMBED_LONG}, coords AS ({"WITH RECURSIVE " + _embedded("emb_l", 2)})
SELECT vec_id, dim1, dim2, feature, {r("value", 6)} AS value, false AS missing FROM s JOIN coords USING (vec_id)"""

# ---- sources and sinks

_FINITE = ", ".join(r(f"CASE WHEN abs({f}) < 1e15 THEN {f} END") + f" AS {f}" for f in MEASURES)
ORACLE["tsv_round_trip"] = f"""{ctes(FLAWED)} SELECT "cell_ID", {DAY}, {_FINITE} FROM flawed"""
ORACLE["csv_columns"] = f"""{ctes(MEASURE)} SELECT "cell_ID", {rounded_list(MEASURES[:2])} FROM measure"""
ORACLE["scan_subsets"] = f"""{ctes(MEASURE)} SELECT "cell_ID", CASE WHEN {DAY} <> 'D1' THEN {CONC} END AS {CONC}, {r("l_quantity")} AS l_quantity
FROM measure WHERE {DAY} IN ('D1', 'D5', 'D7', 'D9')"""
ORACLE["table_header"] = "SELECT CAST(i AS INTEGER) AS pos, name FROM (VALUES " + ", ".join(
    f"({i}, '{c}')" for i, c in enumerate(["cell_ID", "Metadata_Day", *MEASURES])) + ") t(i, name)"
ORACLE["combine_instances"] = f"""{ctes(MEASURE)} SELECT object AS "Subfolder", count(*) AS n,
  count(CASE WHEN object <> 'Cytoplasm' THEN l_tax END) AS taxed, {r("sum(l_quantity)")} AS quantity FROM measure GROUP BY object"""
ORACLE["combine_parts"] = f"""{ctes(MEASURE)} SELECT object AS "Subfolder", count(*) AS n,
  count(CASE WHEN object <> 'Cytoplasm' THEN l_tax END) AS taxed, {r("sum(l_quantity)")} AS quantity FROM measure GROUP BY object"""
ORACLE["partitioned_sink"] = f"""{ctes(MEASURE)} SELECT {DAY}, {CONC}, count(*) AS n, {r("sum(l_quantity)")} AS quantity FROM measure GROUP BY {DAY}, {CONC}"""
ORACLE["feature_list_round_trip"] = f"{ctes(NAMED)} SELECT DISTINCT feature FROM named"
ORACLE["lookup_round_trip"] = f"""{ctes(NAMED, LOOKUP)} SELECT feature, category, organelle FROM lookup
UNION ALL SELECT 'rp_norm_noted', 'Texture', '' """

# ---- the whole analysis

_POOLED = [f"{f}_{o}" for o in OBJECT_NAMES for f in MEASURES]
_CHAIN_OBJECTS = ",\n".join(
    f"""c_{o} AS (SELECT "cell_ID", {", ".join(f'median({f}) AS "{f}_{o}"' for f in MEASURES)} FROM measure WHERE object = '{o}' GROUP BY "cell_ID")"""
    for o in OBJECT_NAMES
)
_CHAIN = MEASURE + ",\n" + _CHAIN_OBJECTS + f""",
meta AS (SELECT {META_LIST} FROM (SELECT *, row_number() OVER (PARTITION BY "cell_ID" ORDER BY {WELL}, {DAY}, {BIOREP}, "Day_Well_BR") AS place
  FROM measure WHERE object = 'Cells') WHERE place = 1),
cells AS (SELECT meta.*, {", ".join(_POOLED)} FROM meta {" ".join(f'LEFT JOIN c_{o} USING ("cell_ID")' for o in OBJECT_NAMES)}),
row_med AS (SELECT {ROW_KEYS}, {", ".join(f"median({f}) AS m_{f}" for f in _POOLED)} FROM cells GROUP BY {ROW_KEYS}),
row_off AS (SELECT {META_LIST}, {", ".join(f"{f} - m_{f} AS {f}" for f in _POOLED)} FROM cells JOIN row_med USING ({ROW_KEYS})),
day_med AS (SELECT {DAY}, {", ".join(f"median({f}) AS d_{f}" for f in _POOLED)} FROM row_off GROUP BY {DAY}),
std AS (SELECT {META_LIST}, {", ".join(f"{f} - d_{f} AS rp_norm_{f}" for f in _POOLED)} FROM row_off JOIN day_med USING ({DAY}))"""
ORACLE["profile_dose_scores"] = f"""{ctes(dose_ctes(_CHAIN, "std", [f"rp_norm_{f}" for f in _POOLED]))}
SELECT {SCORE_COLUMNS}, {r('"EMD_score" + 1e-9', 6)} AS "EMD_score" FROM dose_scores"""

# ---- quantiles of large groups

_PROBS = (0.0, 0.025, 0.25, 0.5, 0.9, 0.975, 1.0)
ORACLE["whole_table_quantiles"] = " UNION ALL ".join(
    f"SELECT '{f}' AS feature, CAST({p} AS DOUBLE) AS p, {r(f'quantile_cont({f}, {p})')} AS q FROM lineitem" for f in MEASURES for p in _PROBS
)
_FLAWED_DAYS = ", ".join(
    f"""{r(f"quantile_cont({f}, {p}) FILTER (NOT isnan({f}))")} AS "{f}_{n}" """ for f in MEASURES for n, p in (("low", 0.05), ("median", 0.5), ("high", 0.95))
)
ORACLE["crowded_day_quantiles"] = f"{ctes(FLAWED)} SELECT {DAY}, count(*) AS n, {_FLAWED_DAYS} FROM flawed GROUP BY {DAY}"
