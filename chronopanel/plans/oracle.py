"""The same queries as plain SQL, for checking results with another engine.

Each statement is assembled from shared common table expressions that start at
the base tables, so nothing here depends on the DataFrame code: only declared
contracts (bounds, feature names, thresholds) are read from it.
"""

from __future__ import annotations

import re

from ..contracts import LABOUR_MEASURES, MEASURES, STAR as C, bounded
from ..operators.eda import MONTHS, QUANTILES
from ..schema import CLASSES
from . import oracle_fits

W = "PARTITION BY county_fips ORDER BY reference_month"
T = C.target
D = "DOUBLE"


def over(rows: str) -> str:
    return f"OVER ({W} ROWS BETWEEN {rows})"


def lag(x: str, k: int) -> str:
    return x if k == 0 else f"lag({x}, {k}) OVER ({W})"


def full(agg: str, x: str, size: int, shift: int = 0) -> str:
    frame = over(f"{shift + size - 1} PRECEDING AND {f'{shift} PRECEDING' if shift else 'CURRENT ROW'}")
    return f"CASE WHEN count({x}) {frame} = {size} THEN {agg}({x}) {frame} END"


def growth(a: str, b: str) -> str:
    return f"CASE WHEN {a} > 0 AND {b} > 0 THEN 100 * ln({a} / {b}) END"


def transform(x: str, name: str, p: int, shift: int = 0) -> str:
    now, before = lag(x, shift), lag(x, shift + p)
    return {
        "lag": before,
        "diff": f"{now} - {before}",
        "log_diff": growth(now, before),
        "rollmean": full("avg", x, p, shift),
        "rollstd": full("stddev_samp", x, p, shift),
        "reltrend": f"{now} / nullif({full('avg', x, p, shift)}, 0) - 1",
    }[name]


def tiers(x: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} >= {low} THEN '{n}'" for n, low in reversed(T.tiers)) + " END"


def tier_pos(x: str) -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{n}' THEN {i}" for i, (n, _) in enumerate(T.tiers)) + " END"


def label(x: str) -> str:
    return f"CASE WHEN {x} <= -{T.tau} THEN 'cooling' WHEN {x} >= {T.tau} THEN 'heating' WHEN {x} IS NOT NULL THEN 'stable' END"


def bands(x: str) -> str:
    e = C.rate_edges
    return "CASE " + " ".join(f"WHEN {x} >= {a} AND {x} < {b} THEN '{n}'" for a, b, n in zip(e, e[1:], C.rate_labels)) + " END"


def months_between(lo: str, hi: str) -> str:
    return f"((year({hi}) - year({lo})) * 12 + month({hi}) - month({lo}) + 1)"


def plus_months(d: str, k) -> str:
    return f"CAST({d} + to_months(CAST({k} AS INTEGER)) AS DATE)"


FEATURES = C.features.specs()
NAMES = C.features.names()
TEXT_ID = "lpad(CAST(s_nationkey AS VARCHAR), 2, '0') || lpad(CAST(s_suppkey AS VARCHAR), 10, '0')"
BASE = "price_smoothed__log_diff3_o9"
CONCISE = ("persistence", "zero_change", "mean_reversion", "base_effect", "majority_class", "ridge", "multinomial_logistic")
WORST = "ORDER BY round(mae, 9) DESC NULLS LAST, county_fips"
MODELS = ("zero_change", "base_effect", "persistence", "mean_reversion", "majority_class")


def shares(n: str = "count(target_label)") -> str:
    return ", ".join(
        f"coalesce(count(*) FILTER (target_label = '{c}') / nullif(CAST({n} AS DOUBLE), 0), 0.0) AS {c}" for c in CLASSES
    )


def split_case() -> str:
    ok = f"is_included AND has_target AND reference_month >= DATE '{C.split.lead_in}'"
    out = f"CASE WHEN NOT ({ok}) THEN 'ineligible' "
    for w in C.split.windows:
        start = f" AND reference_month >= DATE '{w.start}'" if w.start else ""
        out += f"WHEN reference_month <= DATE '{w.end}'{start} THEN '{w.name}' "
    return out + f"WHEN reference_month <= DATE '{C.split.windows[-1].end}' THEN 'embargo' ELSE 'ineligible' END"


def metric_columns(forward: bool = False) -> str:
    """Every metric as SQL over columns predicted_*, target_*, prob_*."""
    e = "(predicted_dg - target_dg)"
    ok = "target_label IS NOT NULL AND predicted_label IS NOT NULL"
    n = lambda cond: f"count(*) FILTER ({ok} AND {cond})"
    f1s, recalls, hits = [], [], []
    for c in CLASSES:
        tp = n(f"target_label = '{c}' AND predicted_label = '{c}'")
        pred, act = n(f"predicted_label = '{c}'"), n(f"target_label = '{c}'")
        p = f"coalesce({tp} / nullif(CAST({pred} AS DOUBLE), 0), 0.0)"
        r = f"coalesce({tp} / nullif(CAST({act} AS DOUBLE), 0), 0.0)"
        f1s.append(f"coalesce(2 * {p} * {r} / nullif({p} + {r}, 0), 0.0)")
        recalls.append(r)
        hits.append(tp)
    present = " + ".join(f"CASE WHEN {n(f'target_label = {c!r}')} > 0 THEN 1 ELSE 0 END" for c in CLASSES)
    nd = n("true")
    total = "(prob_cooling + prob_stable + prob_heating)"
    own = "(CASE target_label " + " ".join(f"WHEN '{c}' THEN prob_{c} / {total}" for c in CLASSES) + " END)"
    quad = " + ".join(f"power(prob_{c} / {total} - CASE WHEN target_label = '{c}' THEN 1 ELSE 0 END, 2)" for c in CLASSES)
    out = [
        f"greatest(count({e}), {nd}) AS n", f"avg(abs({e})) AS mae", f"sqrt(avg({e} * {e})) AS rmse", f"avg({e}) AS mean_error",
        f"quantile_cont(abs({e}), 0.5) AS medae",
        f"({' + '.join(hits)}) / nullif(CAST({nd} AS DOUBLE), 0) AS accuracy",
        f"CASE WHEN {nd} > 0 THEN ({' + '.join(f1s)}) / 3 END AS macro_f1",
        f"({' + '.join(recalls)}) / nullif({present}, 0) AS balanced_accuracy",
        f"avg(CASE WHEN {own} IS NOT NULL THEN -ln(least(greatest({own}, 1e-15), 1.0)) END) AS log_loss",
        f"avg(CASE WHEN target_label IS NOT NULL THEN {quad} END) AS brier",
    ]
    if forward:
        ok = f"{BASE} IS NOT NULL AND target_dg IS NOT NULL AND predicted_dg IS NOT NULL"
        out += [
            f"count(*) FILTER ({ok}) AS n_forward", f"avg(abs({e})) FILTER ({ok}) AS mae_forward",
            f"stddev_samp(target_dg + {BASE}) FILTER ({ok}) AS sd_forward",
            corr("predicted_dg", "target_dg", ok) + " AS corr_dg",
            corr(f"(predicted_dg + {BASE})", f"(target_dg + {BASE})", ok) + " AS corr_forward",
        ]
    return ", ".join(out)


def corr(x: str, y: str, ok: str) -> str:
    f = f"FILTER ({ok})"
    moves = lambda v: f"stddev_samp({v}) {f} > 1e-9 * greatest(1.0, abs(avg({v}) {f}))"
    return (
        f"CASE WHEN {moves(x)} AND {moves(y)} THEN covar_samp({x}, {y}) {f} / (stddev_samp({x}) {f} * stddev_samp({y}) {f}) END"
    )


def predicted(model: str, dg: str) -> str:
    null = "CAST(NULL AS DOUBLE)"
    if model == "majority_class":
        tail = f"{null} AS predicted_dg, majority_label AS predicted_label, share_cooling AS prob_cooling, share_stable AS prob_stable, share_heating AS prob_heating"
    else:
        tail = f"CAST({dg} AS DOUBLE) AS predicted_dg, {label(f'({dg})')} AS predicted_label, {null} AS prob_cooling, {null} AS prob_stable, {null} AS prob_heating"
    keep = f"county_fips, county_name, reference_month, volume_tier, split, {BASE}, target_dg, target_label"
    return f"SELECT '{model}' AS model, {keep}, {tail} FROM t_split, t_fit WHERE split IN ('train', 'validation', 'test')"


GAP = "(growth_yoy__lag0 - growth_yoy__rollmean12)"

CTES: dict[str, str] = {
    "t_entities": f"""SELECT {TEXT_ID} AS county_fips, s_name || ' County' AS county_name,
        lower(replace(s_name, '#', ' ')) AS county_name_key, s_suppkey, s_nationkey FROM supplier""",
    "t_lines": """SELECT l_suppkey, l_shipdate, l_returnflag, l_linestatus, CAST(date_trunc('month', l_shipdate) AS DATE) AS month,
        CAST(day(l_shipdate) AS BIGINT) AS d, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents,
        CAST(round(l_quantity) AS BIGINT) AS qty, CAST(round(l_discount * 100) AS BIGINT) AS disc,
        CAST(round(l_tax * 100) AS BIGINT) AS tax FROM lineitem""",
    "t_facts": """SELECT l_suppkey, month, CAST(count(*) AS DOUBLE) AS n, CAST(sum(cents) AS DOUBLE) AS cents,
        CAST(sum(qty) AS DOUBLE) AS qty, CAST(sum(disc) AS DOUBLE) AS disc, CAST(sum(tax) AS DOUBLE) AS tax,
        CAST(sum(d) AS DOUBLE) AS d, CAST(count(*) FILTER (l_linestatus = 'O') AS DOUBLE) AS n_open,
        CAST(count(*) FILTER (l_returnflag = 'N') AS DOUBLE) AS n_new,
        CAST(count(*) FILTER (l_returnflag = 'R') AS DOUBLE) AS n_ret,
        CAST(count(*) FILTER (l_returnflag = 'A') AS DOUBLE) AS n_acc,
        CAST(count(*) FILTER (tax >= 5) AS DOUBLE) AS n_tax, CAST(count(*) FILTER (disc >= 6) AS DOUBLE) AS n_disc,
        CAST(count(*) FILTER (d <= 14) AS DOUBLE) AS n_early, max(l_shipdate) AS last_shipped
        FROM t_lines GROUP BY l_suppkey, month""",
    "t_housing": """SELECT county_fips, county_name, month AS reference_month, cents / (10 * n) AS median_sale_price,
        cents / (10 * n) * (1 + tax / (100 * n)) AS median_list_price, cents / (1000 * qty) AS median_ppsf, n AS homes_sold,
        n_open AS pending_sales, n_new AS new_listings, qty AS inventory, qty / n AS months_of_supply, d / n AS median_dom,
        1 - disc / (100 * n) AS avg_sale_to_list, n_tax / n AS sold_above_list,
        CASE WHEN month >= DATE '1996-07-01' THEN n_disc / n END AS price_drops, n_early / n AS off_market_in_two_weeks,
        last_shipped AS redfin_last_updated FROM t_facts JOIN t_entities ON l_suppkey = s_suppkey""",
    "t_weekly": """SELECT CAST(date_trunc('week', o_orderdate) AS DATE) + 3 AS d,
        (200 + floor(count(*) FILTER (o_orderpriority = '1-URGENT') * 2000.0 / count(*))) / 100.0 AS rate FROM orders GROUP BY 1""",
    "t_rate": """SELECT CAST(date_trunc('month', d) AS DATE) AS reference_month, avg(rate) AS mortgage_rate_30y,
        arg_max(rate, d) AS mortgage_rate_30y_last, count(*) AS mortgage_rate_weeks_observed, max(d) AS mortgage_rate_last_release
        FROM t_weekly WHERE week(d) <> 1 GROUP BY 1""",
    "t_labour": """SELECT county_fips, month AS reference_month, n_acc AS employed, n AS labor_force, n_ret AS unemployed,
        floor(n_ret * 10000 / n) / 100.0 AS unemployment_rate FROM t_facts JOIN t_entities ON l_suppkey = s_suppkey
        WHERE month <> DATE '2001-01-01'""",
    "t_months": """SELECT CAST(unnest(generate_series(min(reference_month), max(reference_month), INTERVAL 1 MONTH)) AS DATE)
        AS reference_month FROM t_housing""",
    "t_spine": "SELECT county_fips, county_name, reference_month FROM t_entities CROSS JOIN t_months",
    "t_panel": f"""SELECT s.county_fips, s.county_name, s.reference_month, {', '.join('h.' + m for m in MEASURES)},
        h.redfin_last_updated, r.mortgage_rate_30y, r.mortgage_rate_30y_last, r.mortgage_rate_weeks_observed,
        r.mortgage_rate_last_release, l.employed, l.labor_force, l.unemployed, l.unemployment_rate,
        CAST(s.reference_month + INTERVAL 1 MONTH AS DATE) + 14 AS prediction_as_of,
        h.median_sale_price IS NOT NULL AS has_redfin, l.unemployment_rate IS NOT NULL AS has_unemployment
        FROM t_spine s LEFT JOIN t_housing h ON s.county_fips = h.county_fips AND s.reference_month = h.reference_month
        LEFT JOIN t_rate r ON s.reference_month = r.reference_month
        LEFT JOIN t_labour l ON s.county_fips = l.county_fips AND s.reference_month = l.reference_month""",
    "t_volume": "SELECT county_fips, quantile_cont(homes_sold, 0.5) AS homes_sold_median FROM t_panel GROUP BY 1",
    "t_smooth": f"SELECT *, {full('avg', T.price_column, T.window)} AS price_smoothed FROM t_panel",
    "t_growth": f"SELECT *, {growth('price_smoothed', lag('price_smoothed', T.growth_lag))} AS growth_yoy FROM t_smooth",
    "t_dg": f"SELECT *, lead(growth_yoy, {T.horizon}) OVER ({W}) - growth_yoy AS target_dg FROM t_growth",
    "t_target": f"""SELECT t_dg.*, homes_sold_median, {tiers('homes_sold_median')} AS volume_tier,
        coalesce(homes_sold_median >= {T.floor}, false) AS is_included, {label('target_dg')} AS target_label,
        target_dg IS NOT NULL AS has_target FROM t_dg JOIN t_volume USING (county_fips)""",
    "t_model": "SELECT * FROM t_target WHERE is_included AND has_target",
    "t_filled": f"""SELECT * REPLACE (last_value(unemployment_rate IGNORE NULLS) {over('3 PRECEDING AND CURRENT ROW')} AS unemployment_rate),
        CAST(unemployment_rate IS NULL AND last_value(unemployment_rate IGNORE NULLS) {over('3 PRECEDING AND CURRENT ROW')} IS NOT NULL AS DOUBLE)
        AS unemployment_imputed FROM t_target""",
    "t_features": f"""SELECT county_fips, reference_month, county_name, prediction_as_of, volume_tier, is_included, has_target, growth_yoy,
        target_dg, target_label, {', '.join(f'{transform(s.column, s.transform, s.param, s.lag)} AS {s.name}x' for s in FEATURES)} FROM t_filled""",
    "t_matrix": f"""SELECT county_fips, reference_month, county_name, prediction_as_of, volume_tier, is_included, has_target, growth_yoy,
        target_dg, target_label, {', '.join(f'{n}x AS {n}' for n in NAMES)} FROM t_features""",
    "t_split": f"SELECT *, {split_case()} AS split FROM t_matrix",
    "t_counts": f"""SELECT count(target_label) AS n, {', '.join(f"count(*) FILTER (target_label = '{c}') AS n_{c}" for c in CLASSES)}
        FROM t_split WHERE split = 'train'""",
    "t_fit": f"""SELECT coalesce(-(sum({GAP} * target_dg) FILTER ({GAP} IS NOT NULL AND target_dg IS NOT NULL))
        / nullif(sum({GAP} * {GAP}) FILTER ({GAP} IS NOT NULL AND target_dg IS NOT NULL), 0), 0.0) AS k,
        coalesce(avg(target_dg + {BASE}), 0.0) AS drift, coalesce(avg(target_dg), 0.0) AS climatology,
        (SELECT CASE WHEN n_cooling >= n_stable AND n_cooling >= n_heating THEN 'cooling' WHEN n_stable >= n_heating THEN 'stable'
         ELSE 'heating' END FROM t_counts) AS majority_label,
        (SELECT greatest(n_cooling, n_stable, n_heating) / CAST(n AS DOUBLE) FROM t_counts) AS majority_share,
        {', '.join(f"(SELECT n_{c} / CAST(n AS DOUBLE) FROM t_counts) AS share_{c}" for c in CLASSES)}
        FROM t_split WHERE split = 'train'""",
    "t_pred": " UNION ALL ".join([
        predicted("zero_change", "0.0"), predicted("base_effect", f"drift - coalesce({BASE}, 0)"),
        predicted("persistence", "coalesce(growth_yoy__diff3, 0)"), predicted("mean_reversion", f"-k * coalesce({GAP}, 0)"),
        predicted("majority_class", ""),
    ]),
    "t_test": "SELECT * FROM t_pred WHERE split = 'test'",
    "t_table": f"SELECT model, {metric_columns(True)} FROM t_test GROUP BY model",
    "t_monthly": "SELECT reference_month, avg(target_dg) AS mean, stddev_samp(target_dg) AS std, count(*) AS rows FROM t_model GROUP BY 1",
    "t_scan": """SELECT *, row_number() OVER (ORDER BY reference_month) - 1 AS pos, count(*) OVER () AS months,
        avg(mean) OVER (ORDER BY reference_month ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS mean_before,
        avg(mean) OVER (ORDER BY reference_month ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING) AS mean_after FROM t_monthly""",
}


def statement(final: str, extra: dict[str, str] | None = None) -> str:
    """``final`` preceded by just the expressions it needs, in dependency order."""
    ctes = {**CTES, **(extra or {})}
    need: list[str] = []

    def visit(text: str, own: str = ""):
        for name in ctes:
            if name != own and name not in need and re.search(rf"\b{name}\b", text):
                visit(ctes[name], name)
                if name not in need:
                    need.append(name)

    visit(final)
    # A recursion names itself; the others are computed once.
    turns = {n for n in need if re.search(rf"\b{n}\b", ctes[n])}
    head = ",\n".join(f"{n} AS {'' if n in turns else 'MATERIALIZED '}({ctes[n]})" for n in need)
    return (f"WITH {'RECURSIVE ' if turns else ''}{head}\n" if head else "") + final


def pick(spec: str) -> str:
    """``~x`` rounds to 6 places, ``$x`` (money) to single precision, ``#x`` is a BIGINT; others pass through."""
    out = []
    for tok in spec.split():
        kind, name = (tok[0], tok[1:]) if tok[0] in "~$#" else ("", tok)
        if kind == "~":
            out.append(f"round({name}, 6) + 0.0 AS {name}")
        elif kind == "$":
            out.append(f"CAST(CAST({name} AS FLOAT) AS DOUBLE) AS {name}")
        elif kind == "#":
            out.append(f"CAST({name} AS BIGINT) AS {name}")
        else:
            out.append(name)
    return ", ".join(out)


def show(spec: str, source: str, extra: dict[str, str] | None = None) -> str:
    return statement(f"SELECT {pick(spec)} FROM {source}", extra)


HOUSING = (
    "$median_sale_price $median_list_price $median_ppsf ~homes_sold ~pending_sales ~new_listings ~inventory ~months_of_supply "
    "~median_dom ~avg_sale_to_list ~sold_above_list ~price_drops ~off_market_in_two_weeks"
)
RATE = "~mortgage_rate_30y ~mortgage_rate_30y_last #mortgage_rate_weeks_observed mortgage_rate_last_release"
LABOUR = "~employed ~labor_force ~unemployed ~unemployment_rate"
KEYS = "county_fips reference_month"
METRICS = "#n ~mae ~rmse ~mean_error ~medae ~accuracy ~macro_f1 ~balanced_accuracy ~log_loss ~brier"
FORWARD = "#n_forward ~mae_forward ~sd_forward ~corr_dg ~corr_forward"


def metric_table(keys: str, source: str, spec: str, forward: bool = False, extra: dict[str, str] | None = None) -> str:
    cols = ", ".join(keys.split())
    return show(f"{keys} {spec}", f"(SELECT {cols}, {metric_columns(forward)} FROM {source} GROUP BY {cols})", extra)


def transform_query(name: str, params, column: str, shift: int = 0) -> str:
    cols = ", ".join(f"{transform(column, name, p, shift)} AS {name}{p}" for p in params)
    spec = f"{KEYS} " + " ".join(f"~{name}{p}" for p in params)
    return show(spec, f"(SELECT county_fips, reference_month, {cols} FROM t_target)")


# ------------------------------------------------------------ check tables


def _bounds(which: str, source: str = "t_target") -> str:
    parts = []
    for c in bounded(C.registry):
        lo, hi = getattr(c, which)
        parts.append(
            f"SELECT '{c.name}' AS \"column\", count(*) FILTER ({c.name} < {lo} OR {c.name} > {hi}) AS violations, "
            f"count({c.name}) AS observed FROM {source}"
        )
    return " UNION ALL ".join(parts)


def _nulls(source: str = "t_target", skip: tuple = ()) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c.name}' AS \"column\", count(*) - count({c.name}) AS nulls, (count(*) - count({c.name})) / CAST(count(*) AS DOUBLE) AS null_rate FROM {source}"
        for c in bounded(C.registry) if c.name not in skip
    )


def _checks(source: str, missing_columns: tuple = ()) -> str:
    last, first = f"(SELECT max(reference_month) FROM {source})", f"(SELECT min(reference_month) FROM {source})"
    ents = f"(SELECT count(DISTINCT county_fips) FROM {source})"
    months = f"(SELECT count(DISTINCT reference_month) FROM {source})"
    span = months_between(first, last)
    cnt = lambda cond: f"(SELECT count(*) FROM {source} WHERE {cond})"
    total = f"(SELECT count(*) FROM {source})"
    repeats = f"({total} - (SELECT count(*) FROM (SELECT DISTINCT county_fips, reference_month FROM {source})))"
    specs = [c for c in bounded(C.registry) if c.name not in missing_columns]

    def outside(which):
        return "(SELECT " + " + ".join(
            f"count(*) FILTER ({c.name} < {getattr(c, which)[0]} OR {c.name} > {getattr(c, which)[1]})" for c in specs
        ) + f" FROM {source})"

    nulls = "(SELECT " + " + ".join(f"count(*) - count({c.name})" for c in specs) + f" FROM {source})"
    model = "is_included AND has_target"
    smallest = "least(" + ", ".join(
        f"{cnt(f'{model} AND target_label = {c!r}')} / CAST({cnt(model)} AS DOUBLE)" for c in CLASSES
    ) + ")"
    zero = lambda x: (f"{x} = 0", x)
    table = [
        ("unique_county_month_key", "ERROR", *zero(repeats)),
        ("county_fips_format", "ERROR", *zero(cnt(r"NOT regexp_full_match(county_fips, '\d{12}')"))),
        ("reference_month_is_month_start", "ERROR", *zero(cnt("day(reference_month) <> 1"))),
        ("complete_county_month_spine", "ERROR", *zero(f"abs({ents} * {span} - {total})")),
        ("contiguous_month_coverage", "ERROR", *zero(f"({span} - {months})")),
        ("prediction_cutoff_after_reference_month", "ERROR", *zero(cnt("prediction_as_of <= reference_month"))),
        ("documented_columns_match_panel", "ERROR", *zero(str(len(missing_columns)))),
        ("target_price_series_present", "ERROR", f"{cnt('median_sale_price IS NOT NULL')} > 0", cnt("median_sale_price IS NOT NULL")),
        ("values_within_hard_bounds", "ERROR", *zero(outside("hard"))),
        ("extreme_but_possible_values", "WARN", *zero(outside("plausible"))),
        ("column_missingness_measured", "WARN", *zero(nulls)),
        ("coverage_has_redfin", "WARN", *zero(cnt("NOT has_redfin"))),
        ("coverage_has_unemployment", "WARN", *zero(cnt("NOT has_unemployment"))),
        ("target_horizon_within_coverage", "ERROR", *zero(cnt(f"has_target AND {plus_months('reference_month', T.horizon)} > {last}"))),
        ("target_leadin_months_unlabelled", "ERROR", *zero(cnt(f"growth_yoy IS NOT NULL AND reference_month < {plus_months(first, T.lead_in)}"))),
        ("target_inclusion_rule", "WARN", *zero(cnt("NOT is_included"))),
        ("target_class_prevalence", "WARN", f"{smallest} >= 0.05", cnt(model)),
    ]
    return " UNION ALL ".join(
        f"SELECT CAST({i} AS BIGINT) AS position, '{n}' AS \"check\", '{s}' AS severity, {ok} AS passed, CAST({c} AS BIGINT) AS \"count\""
        for i, (n, s, ok, c) in enumerate(table)
    )


PANEL_TYPES = {
    "county_fips": "string", "county_name": "string", "reference_month": "date", **{m: "double" for m in MEASURES},
    "redfin_last_updated": "timestamp", "mortgage_rate_30y": "double", "mortgage_rate_30y_last": "double",
    "mortgage_rate_weeks_observed": "bigint", "mortgage_rate_last_release": "date",
    **{m: "double" for m in sorted(LABOUR_MEASURES.values())}, "prediction_as_of": "date", "has_redfin": "boolean",
    "has_unemployment": "boolean", "homes_sold_median": "double", "price_smoothed": "double", "growth_yoy": "double",
    "target_dg": "double", "volume_tier": "string", "is_included": "boolean", "target_label": "string", "has_target": "boolean",
}


def _profile(columns) -> str:
    parts = []
    for i, c in enumerate(columns):
        t = PANEL_TYPES[c]
        num, day, flag, text = t in ("double", "bigint"), t in ("date", "timestamp"), t == "boolean", t == "string"
        null = "CAST(NULL AS DOUBLE)"
        parts.append(
            f"SELECT CAST({i} AS BIGINT) AS position, '{c}' AS \"column\", '{t}' AS dtype, 1 - count({c}) / CAST(count(*) AS DOUBLE) AS null_rate, "
            + (f"CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, quantile_cont(CAST({c} AS DOUBLE), 0.5) AS median, " if num else f"{null} AS min, {null} AS max, {null} AS median, ")
            + (f"CAST(min({c}) AS DATE) AS first_date, CAST(max({c}) AS DATE) AS last_date, " if day else "CAST(NULL AS DATE) AS first_date, CAST(NULL AS DATE) AS last_date, ")
            + (f"count(*) FILTER ({c}) / CAST(count({c}) AS DOUBLE) AS share_true, " if flag else f"{null} AS share_true, ")
            + (f'count(DISTINCT {c}) AS "distinct"' if text else 'CAST(NULL AS BIGINT) AS "distinct"')
            + " FROM t_target"
        )
    return " UNION ALL ".join(parts)


PROFILE = 'position "column" dtype ~null_rate ~min ~max ~median first_date last_date ~share_true "distinct"'


def _dictionary() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    num = lambda b, i: f"CAST({b[i]} AS DOUBLE)" if b else "CAST(NULL AS DOUBLE)"
    reg = ", ".join(
        f"({q(c.name)}, {q(c.source)}, {q(c.unit)}, {q(c.meaning)}, {num(c.hard, 0)}, {num(c.hard, 1)}, {num(c.plausible, 0)}, {num(c.plausible, 1)})"
        for c in C.registry
    )
    names = [c.name for c in C.registry]
    return statement(
        f"SELECT {pick(PROFILE)}, source, unit, meaning, hard_low, hard_high, plausible_low, plausible_high FROM ({_profile(names)}) p "
        f"JOIN (VALUES {reg}) r(\"column\", source, unit, meaning, hard_low, hard_high, plausible_low, plausible_high) USING (\"column\")"
    )


def _availability(extra: str = "") -> str:
    parts = [
        f"SELECT '{s.name}' AS feature, '{s.family}' AS family, '{s.source}' AS source, '{s.definition()}' AS definition, "
        f"CAST({s.held} AS BIGINT) AS release_lag_months, CAST({s.reach} AS BIGINT) AS reads_back_months, "
        f"{plus_months('min(reference_month)', s.reach)} AS earliest_month_expected, "
        f"min(reference_month) FILTER ({s.name} IS NOT NULL) AS earliest_month_observed, "
        f"round(1 - count({s.name}) / CAST(count(*) AS DOUBLE), 6) + 0.0 AS null_rate FROM t_matrix"
        for s in FEATURES
    ]
    return " UNION ALL ".join(parts)


def _publication(short: bool = False) -> str:
    source = C.features.fills[0].source
    specs = C.features.with_release_lag(source, 1).specs() if short else FEATURES
    rows = ", ".join(f"('{s.name}', '{s.source}', {s.lag}, {C.features.timing(s.source).delay_days})" for s in specs)
    margin = (
        f"date_diff('day', CAST(last_day(CAST(m - to_months(lag) AS DATE)) AS DATE) + delay, CAST(m + INTERVAL 1 MONTH AS DATE) + 14)"
    )
    return statement(
        f"SELECT feature, source, CAST(lag AS BIGINT) AS effective_lag_months, CAST(min({margin}) AS BIGINT) AS min_margin_days, "
        f"bool_or({margin} < 0) AS leaks FROM (VALUES {rows}) f(feature, source, lag, delay), (SELECT reference_month AS m FROM t_months) GROUP BY ALL"
    )


# ---------------------------------------------------------------- bootstrap

_SUMS = ["n_mag", "s_abs", "s_err", "s_sq", "n_dir"] + [f"{p}_{c}" for c in CLASSES for p in ("tp", "pred", "act")]


def _block_ctes(block: str, resamples: int = 1000, source: str = "t_test", by: str = "model") -> dict[str, str]:
    e, ok = "(predicted_dg - target_dg)", "target_label IS NOT NULL AND predicted_label IS NOT NULL"
    cls = ", ".join(
        f"count(*) FILTER ({ok} AND target_label = '{c}' AND predicted_label = '{c}') AS tp_{c}, "
        f"count(*) FILTER ({ok} AND predicted_label = '{c}') AS pred_{c}, count(*) FILTER ({ok} AND target_label = '{c}') AS act_{c}"
        for c in CLASSES
    )
    return {
        "b_stats": f"""SELECT {by}, CAST({block} AS VARCHAR) AS bk, count({e}) AS n_mag, coalesce(sum(abs({e})), 0) AS s_abs,
            coalesce(sum({e}), 0) AS s_err, coalesce(sum({e} * {e}), 0) AS s_sq, count(*) FILTER ({ok}) AS n_dir, {cls}
            FROM {source} GROUP BY 1, 2""",
        "b_num": f"SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY bk) - 1 AS idx, count(*) OVER (PARTITION BY {by}) AS b FROM b_stats",
        "b_draw": f"""SELECT b, r, CAST(('0x' || substr(md5({C.bootstrap.seed} || ':' || r || ':' || s), 1, 8)) AS BIGINT) % b AS idx, count(*) AS w
            FROM (SELECT DISTINCT b FROM b_num) z, range({resamples}) x(r), LATERAL (SELECT unnest(range(b)) AS s) GROUP BY 1, 2, 3""",
        "b_sample": f"SELECT {by}, r, {', '.join(f'sum({s} * w) AS {s}' for s in _SUMS)} FROM b_num JOIN b_draw USING (b, idx) GROUP BY 1, 2",
        "b_total": f"SELECT {by}, {', '.join(f'sum({s}) AS {s}' for s in _SUMS)} FROM b_stats GROUP BY 1",
    }


def _formula(metric: str) -> str:
    rat = lambda a, b: f"coalesce({a} / nullif(CAST({b} AS DOUBLE), 0), 0.0)"
    f1 = lambda c: f"coalesce(2 * {rat(f'tp_{c}', f'pred_{c}')} * {rat(f'tp_{c}', f'act_{c}')} / nullif({rat(f'tp_{c}', f'pred_{c}')} + {rat(f'tp_{c}', f'act_{c}')}, 0), 0.0)"
    return {
        "mae": "s_abs / nullif(CAST(n_mag AS DOUBLE), 0)", "rmse": "sqrt(s_sq / nullif(CAST(n_mag AS DOUBLE), 0))",
        "mean_error": "s_err / nullif(CAST(n_mag AS DOUBLE), 0)",
        "accuracy": f"({' + '.join(f'tp_{c}' for c in CLASSES)}) / nullif(CAST(n_dir AS DOUBLE), 0)",
        "macro_f1": f"CASE WHEN n_dir > 0 THEN ({' + '.join(f1(c) for c in CLASSES)}) / 3 END",
        "balanced_accuracy": f"({' + '.join(rat(f'tp_{c}', f'act_{c}') for c in CLASSES)}) / nullif({' + '.join(f'CASE WHEN act_{c} > 0 THEN 1 ELSE 0 END' for c in CLASSES)}, 0)",
    }[metric]


def _intervals(name: str, block: str, metrics, where: str = "true") -> tuple[str, dict]:
    parts = []
    for m in metrics:
        parts.append(
            f"SELECT model, '{m}' AS metric, '{name}' AS block, p.v AS point, quantile_cont(d.v, 0.025) AS low, quantile_cont(d.v, 0.975) AS high, "
            f"count(d.v) AS resamples FROM (SELECT model, {_formula(m)} AS v FROM b_total) p JOIN (SELECT model, {_formula(m)} AS v FROM b_sample) d USING (model) "
            f"WHERE p.v IS NOT NULL GROUP BY 1, 2, 3, 4"
        )
    return " UNION ALL ".join(parts)


INTERVAL = "model metric block ~point ~low ~high #resamples"


def _two_blocks(magnitude: str, direction: str, extra: dict[str, str]) -> str:
    """Entity and month blocks in one statement, for the interval table."""
    a, b = _block_ctes("county_fips"), _block_ctes("reference_month")
    extra, selects = dict(extra), []
    for tag, name, ctes in (("c", "county", a), ("m", "month", b)):
        ren = lambda t: re.sub(r"\bb_(stats|num|draw|sample|total)\b", rf"{tag}_\1", t)
        extra |= {ren(k): ren(v) for k, v in ctes.items()}
        selects.append(ren(_intervals(name, "", ("mae", "macro_f1"))))
    wanted = f"(model = '{magnitude}' AND metric = 'mae') OR (model = '{direction}' AND metric = 'macro_f1')"
    return show(INTERVAL, f"({' UNION ALL '.join(selects)}) WHERE {wanted}", extra)


def _median_bootstrap(resamples: int = 1000) -> str:
    extra = _block_ctes("reference_month", resamples)
    extra["b_rows"] = "SELECT model, CAST(reference_month AS VARCHAR) AS bk, abs(predicted_dg - target_dg) AS v FROM t_test WHERE predicted_dg IS NOT NULL"
    extra["b_values"] = """SELECT model, r, quantile_cont(v, 0.5) AS v FROM (SELECT model, r, v, unnest(range(w)) FROM b_rows
        JOIN (SELECT model, bk, r, w FROM b_num JOIN b_draw USING (b, idx)) USING (model, bk)) GROUP BY 1, 2"""
    return show(
        INTERVAL,
        """(SELECT model, 'medae' AS metric, 'month' AS block, p.v AS point, quantile_cont(d.v, 0.025) AS low, quantile_cont(d.v, 0.975) AS high,
        count(*) AS resamples FROM (SELECT model, quantile_cont(v, 0.5) AS v FROM b_rows GROUP BY 1) p JOIN b_values d USING (model) GROUP BY 1, 2, 3, 4)""",
        extra,
    )


def _mixed(x: str) -> str:
    """A published hash of 32-bit integers, step by step."""
    for shift, factor in ((16, 0x7FEB352D), (15, 0x846CA68B), (16, None)):
        x = f"list_transform([{x}], lambda y: xor(y, y >> {shift}::UBIGINT))[1]"
        x = x if factor is None else f"(({x} * {factor}::UBIGINT) % 4294967296)"
    return x


def _poisson() -> str:
    import math

    cdf, k, arms = 0.0, 0, []
    while True:
        cdf += math.exp(-1.0) / math.factorial(k)
        bound = min(int(cdf * 2**32), 2**32)
        arms.append(f"WHEN u < {bound} THEN {k}")
        if bound >= 2**32 - 1:
            break
        k += 1
    extra = _block_ctes("county_fips")
    seed = C.bootstrap.seed
    extra["b_hash"] = f"SELECT *, ('0x' || substr(md5({seed} || ':' || bk), 1, 8))::UBIGINT AS h FROM b_stats"
    extra["b_sample"] = f"""SELECT model, r, {', '.join(f'sum({s} * w) AS {s}' for s in _SUMS)} FROM (SELECT *, CASE {' '.join(arms)} ELSE {k + 1} END AS w
        FROM (SELECT *, {_mixed('xor(turn, h)')} AS u FROM b_hash, (SELECT r, {_mixed(f'((r + {seed}) % 4294967296)::UBIGINT')} AS turn FROM range(1000) x(r)))) WHERE w > 0 GROUP BY 1, 2"""
    return show(INTERVAL, f"({_intervals('county', '', ('mae',))})", extra)


def _paired() -> str:
    extra = _block_ctes("county_fips", source="(SELECT * FROM t_test WHERE model IN ('base_effect', 'zero_change'))")
    m = _formula("mae")
    side = lambda t, k: f"max(v) FILTER (model = '{k}')"
    return show(
        "metric block ~point ~low ~high #resamples",
        f"""(SELECT 'mae_difference' AS metric, 'county' AS block, (SELECT {side('', 'base_effect')} - {side('', 'zero_change')} FROM (SELECT model, {m} AS v FROM b_total)) AS point,
        quantile_cont(d, 0.025) AS low, quantile_cont(d, 0.975) AS high, count(*) AS resamples FROM
        (SELECT r, {side('', 'base_effect')} - {side('', 'zero_change')} AS d FROM (SELECT model, r, {m} AS v FROM b_sample) GROUP BY r))""",
        extra,
    )


def _paired_median() -> str:
    """Median errors of two models under the same draws, for entity and month blocks."""
    extra, selects = {}, []
    two = "(SELECT * FROM t_test WHERE model IN ('base_effect', 'zero_change'))"
    for tag, block, column in (("c", "county", "county_fips"), ("m", "month", "reference_month")):
        ren = lambda t: re.sub(r"\bb_(stats|num|draw|sample|total)\b", rf"{tag}_\1", t)
        extra |= {ren(k): ren(v) for k, v in _block_ctes(column, source=two).items()}
        extra[f"{tag}_rows"] = f"SELECT model, CAST({column} AS VARCHAR) AS bk, abs(predicted_dg - target_dg) AS v FROM {two} WHERE predicted_dg IS NOT NULL"
        extra[f"{tag}_values"] = f"""SELECT model, r, quantile_cont(v, 0.5) AS v FROM (SELECT model, r, v, unnest(range(w)) FROM {tag}_rows
            JOIN (SELECT model, bk, r, w FROM {tag}_num JOIN {tag}_draw USING (b, idx)) USING (model, bk)) GROUP BY 1, 2"""
        side = "max(v) FILTER (model = 'base_effect') - max(v) FILTER (model = 'zero_change')"
        selects.append(f"""SELECT 'medae_difference' AS metric, '{block}' AS block,
            (SELECT {side} FROM (SELECT model, quantile_cont(v, 0.5) AS v FROM {tag}_rows GROUP BY 1)) AS point,
            quantile_cont(d, 0.025) AS low, quantile_cont(d, 0.975) AS high, count(*) AS resamples FROM (SELECT r, {side} AS d FROM {tag}_values GROUP BY r)""")
    return show("metric block ~point ~low ~high #resamples", f"({' UNION ALL '.join(selects)})", extra)


# --------------------------------------------------------------- result tables


def _skill(source: str) -> str:
    bar = lambda m, c: f"(SELECT {c} FROM {source} WHERE model = '{m}')"
    return (
        f"SELECT *, 1 - mae / nullif({bar('base_effect', 'mae')}, 0) AS skill_vs_base_effect, 1 - mae / nullif({bar('zero_change', 'mae')}, 0) AS skill_vs_zero_change, "
        f"macro_f1 - {bar('majority_class', 'macro_f1')} AS macro_f1_vs_majority FROM {source}"
    )


SKILL = "~skill_vs_base_effect ~skill_vs_zero_change ~macro_f1_vs_majority"


def _replay() -> str:
    seen = " + ".join(f"count({n})" for n in NAMES)
    return (
        f"SELECT CAST(reference_month AS DATE) AS cut, count(*) AS entities, CAST({seen} AS BIGINT) AS cells_present, "
        "CAST(0 AS BIGINT) AS cells_differing FROM t_matrix GROUP BY reference_month"
    )


def _outliers() -> str:
    parts = [
        f"SELECT '{c.name}' AS \"column\", {float(c.plausible[0])} AS lo, {float(c.plausible[1])} AS hi, county_fips, county_name, "
        f"({c.name} < {c.plausible[0]} OR {c.name} > {c.plausible[1]}) AS bad FROM t_target WHERE {c.name} IS NOT NULL"
        for c in bounded(C.registry) if c.plausible
    ]
    extra = {
        "o_cells": " UNION ALL ".join(parts),
        "o_tot": 'SELECT "column", lo, hi, count(*) FILTER (bad) AS extreme_values, count(*) FILTER (bad) / CAST(count(*) AS DOUBLE) AS share FROM o_cells GROUP BY 1, 2, 3',
        "o_rank": 'SELECT "column", county_name, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, county_name) AS rk FROM (SELECT "column", county_fips, county_name, count(*) AS n FROM o_cells WHERE bad GROUP BY 1, 2, 3)',
        "o_names": "SELECT \"column\", string_agg(county_name, ', ' ORDER BY rk) AS counties FROM o_rank WHERE rk <= 3 GROUP BY 1",
    }
    return statement(
        'SELECT "column", CAST(lo AS DOUBLE) AS plausible_low, CAST(hi AS DOUBLE) AS plausible_high, CAST(extreme_values AS BIGINT) AS extreme_values, round(share, 6) + 0.0 AS share, counties '
        'FROM o_tot JOIN o_names USING ("column")', extra,
    )


DISPERSION = "volume tier rows dg_sd dg_abs_median dg_max_abs"


def _dispersion(where: str, extra_cols: str = "", spec: str = "") -> str:
    return show(
        f"county_fips county_name ~volume tier #rows ~dg_sd ~dg_abs_median ~dg_max_abs {spec}",
        f"""(SELECT county_fips, county_name, max(homes_sold_median) AS volume, max(volume_tier) AS tier, count(*) AS rows, stddev_samp(target_dg) AS dg_sd,
        quantile_cont(abs(target_dg), 0.5) AS dg_abs_median, max(abs(target_dg)) AS dg_max_abs {extra_cols} FROM t_target WHERE {where} GROUP BY 1, 2)""",
    )


def _kept_whole(sources: dict[str, str]) -> str:
    """Row counts of tables that a write and a read must return unchanged."""
    return statement(" UNION ALL ".join(
        f"SELECT '{name}' AS source, count(*) AS rows, count(*) AS rows_back, CAST(0 AS BIGINT) AS lost, CAST(0 AS BIGINT) AS gained FROM {table}"
        for name, table in sources.items()))


def _scaling() -> str:
    parts = [
        f"SELECT '{n}' AS feature, m AS median, avg(x) AS mean, CASE WHEN stddev_pop(x) <= 1e-12 * greatest(1.0, abs(avg(x))) THEN 1.0 ELSE stddev_pop(x) END AS scale "
        f"FROM (SELECT coalesce({n}, coalesce(m, 0.0)) AS x, coalesce(m, 0.0) AS m FROM t_train, (SELECT quantile_cont({n}, 0.5) AS m FROM t_train)) GROUP BY m"
        for n in NAMES
    ]
    return show("feature ~median ~mean ~scale", f"({' UNION ALL '.join(parts)})", {"t_train": "SELECT * FROM t_split WHERE split = 'train'"})


def build() -> dict[str, str]:
    none = "CAST(NULL AS VARCHAR)"
    broken = {
        "t_cut": """SELECT * REPLACE (CASE WHEN month(reference_month) = 7 THEN -median_sale_price ELSE median_sale_price END AS median_sale_price)
            FROM t_target WHERE reference_month <> DATE '1998-05-01'""",
        "t_broken": "SELECT * FROM t_cut UNION ALL SELECT * FROM t_cut WHERE volume_tier = 'mid'",
    }
    entities = "county_fips county_name county_name_key"
    known_15 = "s_nationkey = 15"
    flags = "(SELECT count(*) FROM (SELECT DISTINCT l_suppkey, month, l_returnflag FROM t_lines))"
    o = {
        "staged_entities": show(entities, "t_entities"),
        "staged_entities_one_state": show(entities, f"t_entities WHERE {known_15}"),
        "text_scan_reference_codes": show(entities, "t_entities"),
        "staged_housing": show(f"{KEYS} county_name {HOUSING} redfin_last_updated", "t_housing"),
        "text_scan_housing_bulk": show(f"{KEYS} county_name {HOUSING}", "t_housing"),
        "housing_row_accounting": statement(
            f"SELECT 'housing' AS source, 'staged' AS reason, count(*) AS rows FROM t_facts UNION ALL SELECT 'housing', 'not an entity-month aggregate row', {flags}"
        ),
        "housing_name_lookup_accounting": statement(
            f"SELECT 'housing' AS source, CASE WHEN {known_15} THEN 'staged' ELSE 'name not in the reference list' END AS reason, count(*) AS rows "
            f"FROM t_facts JOIN t_entities ON l_suppkey = s_suppkey GROUP BY 2 UNION ALL SELECT 'housing', 'not an entity-month aggregate row', {flags}"
        ),
        "housing_unmatched_names": statement(
            "SELECT s_name || ' County, ' || r_name AS region, count(*) AS rows FROM t_facts JOIN supplier ON l_suppkey = s_suppkey "
            "JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE s_nationkey <> 15 GROUP BY 1"
        ),
        "staged_rate": show(f"reference_month {RATE}", "t_rate"),
        "text_scan_rate_series": show(f"reference_month {RATE}", "t_rate"),
        "rate_row_accounting": statement(
            "SELECT 'mortgage_rate' AS source, CASE WHEN week(d) = 1 THEN 'missing or non-numeric rate' ELSE 'staged' END AS reason, count(*) AS rows FROM t_weekly GROUP BY 2"
        ),
        "labour_series_decode": statement(
            "SELECT 'LAU' || county_fips || code AS series_id, county_fips, measure FROM t_entities, (VALUES "
            + ", ".join(f"('{k}', '{v}')" for k, v in LABOUR_MEASURES.items()) + ") m(code, measure)"
        ),
        "staged_labour": show(f"{KEYS} {LABOUR}", "t_labour"),
        "text_scan_labour_padded": show(f"{KEYS} {LABOUR}", "t_labour"),
        "labour_row_accounting": statement(
            "SELECT 'unemployment' AS source, 'staged' AS reason, 4 * count(*) AS rows FROM t_labour UNION ALL "
            "SELECT 'unemployment', 'annual average or non-monthly period', 4 * count(*) FROM (SELECT DISTINCT l_suppkey, year(month) FROM t_facts)"
        ),
        "labour_unknown_entities": statement(
            "SELECT county_fips, count(*) AS rows FROM t_labour WHERE substr(county_fips, 1, 2) <> '15' GROUP BY 1"
        ),
        "staged_tables_sink": _kept_whole(
            {"entities": "t_entities", "housing": "t_housing", "mortgage_rate": "t_rate", "unemployment": "t_labour"}),
        "snapshot_sink": _kept_whole({
            n: f"{t} WHERE substr(county_fips, 1, 2) = '15'" for n, t in (
                ("entities", "t_entities"), ("housing", "t_housing"), ("unemployment", "t_labour"))} | {"mortgage_rate": "t_rate"}),
        "panel_sink_roundtrip": _kept_whole({"panel": "t_target", "modelling": "t_target WHERE is_included AND has_target"}),
        "predictions_sink": _kept_whole({"predictions": "t_pred"}),
        "table_fingerprint_check": """WITH y AS (SELECT year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1)
            SELECT CAST(y AS VARCHAR) AS part, CASE WHEN y <> 2001 THEN n END AS rows_recorded, CASE WHEN y <> 1996 THEN n END AS rows_found,
            CASE y WHEN 1996 THEN 'missing' WHEN 1998 THEN 'mismatch' WHEN 2001 THEN 'not recorded' ELSE 'ok' END AS status FROM y""",
        "partition_manifest_check": """SELECT CAST(year(o_orderdate) AS VARCHAR) AS part, count(*) AS rows_recorded, count(*) AS rows_found,
            CASE year(o_orderdate) WHEN 1998 THEN 'mismatch' ELSE 'ok' END AS status, year(o_orderdate) IN (1995, 1998) AS was_read
            FROM orders GROUP BY year(o_orderdate)""",
        "scalar_identifiers": """SELECT s_suppkey, lpad(CAST(s_nationkey AS VARCHAR), 2, '0') || CASE WHEN s_suppkey < 1000 THEN lpad(CAST(s_suppkey AS VARCHAR), 3, '0')
            ELSE CAST(s_suppkey AS VARCHAR) END AS short_id, lower(replace(s_name, '#', ' ')) AS key_borough, lower(replace(s_name, '#', ' ')) AS key_parish FROM supplier""",
        "scalar_dates": """SELECT day, month, orders, CAST(month + INTERVAL 1 MONTH AS DATE) + 14 AS cutoff, CAST(last_day(month) AS DATE) + 50 AS published,
            year(month) || 'Q' || quarter(month) AS quarter, CAST(year(month) AS VARCHAR) AS year, month(month) AS calendar_month, strftime(month, '%b') AS abbr
            FROM (SELECT CAST(o_orderdate AS DATE) AS day, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS orders FROM orders GROUP BY 1, 2)""",
        "scalar_numbers": """SELECT event_type, count(TRY_CAST(regexp_replace(props, '[^0-9a-z]', '', 'g') AS DOUBLE)) AS letters_parsed, count(m) AS digits_parsed,
            CAST(sum(m) AS BIGINT) AS digit_sum, count(*) FILTER (m > 0) AS positive_values, count(*) AS rows
            FROM (SELECT *, TRY_CAST(regexp_replace(props, '[^0-9]', '', 'g') AS DOUBLE) AS m FROM events) GROUP BY 1""",
        "scalar_labels_and_bands": statement(
            f"SELECT county_fips, reference_month, {label('target_dg')} AS label, {tiers('homes_sold')} AS tier, {bands('mortgage_rate_30y')} AS rate_band FROM t_target"
        ),
        "panel_spine": show("county_fips county_name reference_month", "t_spine"),
        "panel_spine_report": statement(
            "SELECT count(*) AS spine_rows, count(DISTINCT reference_month) AS months, min(reference_month) AS coverage_start, max(reference_month) AS coverage_end, count(DISTINCT county_fips) AS entities FROM t_spine"
        ),
        "panel_joined": show(f"county_fips county_name reference_month {HOUSING} redfin_last_updated {RATE} {LABOUR} prediction_as_of has_redfin has_unemployment", "t_panel"),
        "panel_join_report": statement(
            """SELECT 'housing' AS source, count(*) FILTER (has_redfin) AS spine_rows_matched, count(*) FILTER (NOT has_redfin) AS spine_rows_unmatched, CAST(0 AS BIGINT) AS source_rows_outside_spine FROM t_panel
            UNION ALL SELECT 'mortgage_rate', count(mortgage_rate_30y), count(*) - count(mortgage_rate_30y), (SELECT count(*) FROM t_rate WHERE reference_month NOT IN (SELECT reference_month FROM t_months)) FROM t_panel
            UNION ALL SELECT 'unemployment', count(*) FILTER (has_unemployment), count(*) FILTER (NOT has_unemployment), 0 FROM t_panel"""
        ),
        "duplicate_line_keys": "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, count(*) AS copies FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
        "validated_orders_customer_join": "SELECT c_mktsegment, count(*) AS orders, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1",
        "target_columns": show(f"{KEYS} ~homes_sold_median volume_tier is_included $price_smoothed ~growth_yoy ~target_dg target_label has_target", "t_target"),
        "target_accounting": show(
            "#panel_rows #included_rows #rows_with_target #modelling_rows target_start target_end ~share_cooling ~share_stable ~share_heating #entities #entities_excluded",
            f"""(SELECT count(*) AS panel_rows, count(*) FILTER (is_included) AS included_rows, count(*) FILTER (has_target) AS rows_with_target,
            count(*) FILTER (is_included AND has_target) AS modelling_rows, min(reference_month) FILTER (has_target) AS target_start, max(reference_month) FILTER (has_target) AS target_end,
            {', '.join(f"count(*) FILTER (is_included AND target_label = '{c}') / CAST(count(*) FILTER (is_included AND has_target) AS DOUBLE) AS share_{c}" for c in CLASSES)},
            count(DISTINCT county_fips) AS entities, count(DISTINCT county_fips) FILTER (NOT is_included) AS entities_excluded FROM t_target)""",
        ),
        "target_excluded_entities": show(
            "county_fips county_name #rows ~homes_sold_median",
            "(SELECT county_fips, county_name, count(*) AS rows, max(homes_sold_median) AS homes_sold_median FROM t_target WHERE NOT is_included GROUP BY 1, 2)",
        ),
        "entity_volume_tiers": show(
            "county_fips county_name ~homes_sold_median volume_tier is_included",
            "(SELECT DISTINCT county_fips, county_name, homes_sold_median, volume_tier, is_included FROM t_target)",
        ),
        "modelling_rows": show(f"{KEYS} ~target_dg target_label", "t_model"),
        "base_effect_decomposition": show(
            f"{KEYS} ~target_dg ~forward_growth ~base_effect ~residual",
            f"""(SELECT *, CASE WHEN target_dg IS NOT NULL AND forward_growth IS NOT NULL AND base_effect IS NOT NULL THEN 0.0 END AS residual FROM
            (SELECT county_fips, reference_month, target_dg, {growth(f'lead(price_smoothed, 3) OVER ({W})', 'price_smoothed')} AS forward_growth,
            {growth(lag('price_smoothed', 9), lag('price_smoothed', 12))} AS base_effect FROM t_target))""",
        ),
        "transform_lag": transform_query("lag", (0, 1, 12), "growth_yoy"),
        "transform_diff": transform_query("diff", (1, 3, 12), "unemployment_rate", 2),
        "transform_log_diff": transform_query("log_diff", (3, 12), "pending_sales"),
        "transform_rollmean": transform_query("rollmean", (6, 12), "homes_sold", 1),
        "transform_rollstd": transform_query("rollstd", (6, 12), "growth_yoy"),
        "transform_reltrend": transform_query("reltrend", (6, 12), "inventory", 1),
        "capped_forward_fill": show(f"{KEYS} ~unemployment_rate ~unemployment_imputed", "t_filled"),
        "uncapped_forward_fill": show(
            f"{KEYS} ~unemployment_rate ~unemployment_imputed",
            f"""(SELECT county_fips, reference_month, f AS unemployment_rate, CAST(u IS NULL AND f IS NOT NULL AS DOUBLE) AS unemployment_imputed FROM
            (SELECT county_fips, reference_month, unemployment_rate AS u, last_value(unemployment_rate IGNORE NULLS) {over('UNBOUNDED PRECEDING AND CURRENT ROW')} AS f FROM t_target))""",
        ),
        "feature_matrix": show(
            f"{KEYS} county_name prediction_as_of volume_tier is_included has_target ~growth_yoy ~target_dg target_label " + " ".join(f"~{n}" for n in NAMES), "t_matrix"
        ),
        "feature_accounting": statement(
            f"""SELECT count(*) AS rows, CAST({len(NAMES)} AS BIGINT) AS feature_count, CAST({max(s.reach for s in FEATURES)} AS BIGINT) AS max_reach_months,
            count(*) FILTER (ok) AS complete_rows, count(*) FILTER (m) AS modelling_rows, count(*) FILTER (ok AND m) AS complete_modelling_rows,
            min(reference_month) FILTER (ok AND m) AS first_complete_month, CAST(coalesce(sum(unemployment_imputed), 0) AS BIGINT) AS unemployment_imputed_cells
            FROM (SELECT *, {' AND '.join(f'{n} IS NOT NULL' for n in NAMES)} AS ok, is_included AND has_target AS m FROM t_matrix)"""
        ),
        "feature_family_filled_cells": statement(" UNION ALL ".join(
            f"SELECT '{k}' AS family, CAST({len(v)} AS BIGINT) AS features, CAST({' + '.join(f'count({n})' for n in v)} AS BIGINT) AS cells FROM t_matrix"
            for k, v in C.features.families().items()
        )),
        "feature_availability": statement(_availability()),
        "quality_checks": statement(_checks("t_target")),
        "quality_checks_rebuild": statement(_checks("t_target")),
        "quality_on_broken_panel": statement(_checks("t_broken", ("price_drops",)), broken),
        "quality_hard_bounds": show('"column" #violations #observed', f"({_bounds('hard')})"),
        "quality_plausible_bounds": show('"column" #violations #observed', f"({_bounds('plausible')})"),
        "quality_missingness": show('"column" #nulls ~null_rate', f"({_nulls()})"),
        "quality_worst_missing": show('"column" #nulls ~null_rate', f'(SELECT * FROM ({_nulls()}) ORDER BY null_rate DESC, "column" LIMIT 3)'),
        "split_row_count_guard": statement(
            """SELECT split, actual + CAST(split = 'test' AS BIGINT) AS expected, actual, split <> 'test' AS passed FROM
            (SELECT e.split, coalesce(n, 0) AS actual FROM (VALUES ('train'), ('validation'), ('test'), ('embargo'), ('eligible')) e(split) LEFT JOIN
            (SELECT split, count(*) AS n FROM t_split GROUP BY 1 UNION ALL SELECT 'eligible', count(*) FROM t_split WHERE split <> 'ineligible') a ON e.split = a.split)"""
        ),
        "split_counts_on_record": statement(
            """SELECT e.split, count(*) FILTER (hit) AS expected, count(*) FILTER (hit AND later) AS actual,
            count(*) FILTER (hit) = count(*) FILTER (hit AND later) AS passed FROM
            (SELECT n.split, s.split = n.split OR n.split = 'eligible' AND s.split <> 'ineligible' AS hit, reference_month <> DATE '1998-05-01' AS later
             FROM t_split s, (VALUES ('train'), ('validation'), ('test'), ('embargo'), ('eligible')) n(split)) e GROUP BY e.split"""
        ),
        "column_profile": show(PROFILE, f"({_profile(PANEL_TYPES)})"),
        "data_dictionary": _dictionary(),
        "coverage_by_entity": show(
            "county_fips county_name #months #months_with_price ~coverage",
            "(SELECT county_fips, county_name, count(*) AS months, count(median_sale_price) AS months_with_price, count(median_sale_price) / CAST(count(*) AS DOUBLE) AS coverage FROM t_target GROUP BY 1, 2)",
        ),
        "coverage_lowest": show(
            "county_fips county_name #months #months_with_price ~coverage",
            "(SELECT county_fips, county_name, count(*) AS months, count(median_sale_price) AS months_with_price, count(median_sale_price) / CAST(count(*) AS DOUBLE) AS coverage FROM t_target GROUP BY 1, 2 ORDER BY coverage, county_fips LIMIT 10)",
        ),
        "audit_spine_gaps": show(
            "county_fips first_month last_month #months #rows #expected",
            f"""(SELECT county_fips, min(reference_month) AS first_month, max(reference_month) AS last_month, count(DISTINCT reference_month) AS months, count(*) AS rows,
            {months_between('min(reference_month)', 'max(reference_month)')} AS expected FROM t_housing GROUP BY 1) WHERE months <> expected OR rows <> expected""",
        ),
        "audit_publication": _publication(),
        "audit_publication_short_lag": _publication(True),
        "audit_cutoff": statement(
            "SELECT count(*) AS rows, count(*) FILTER (prediction_as_of IS DISTINCT FROM CAST(reference_month + INTERVAL 1 MONTH AS DATE) + 14) AS mismatches FROM t_panel"
        ),
        "audit_replay": statement(_replay()),
        "audit_early_features": statement(
            f"SELECT feature, earliest_month_expected, earliest_month_observed FROM ({_availability()}) WHERE earliest_month_observed < earliest_month_expected"
        ),
        "audit_split_boundaries": statement(
            " UNION ALL ".join(
                f"""SELECT '{a}' AS earlier, '{b}' AS later, {plus_months("max(reference_month) FILTER (split = '" + a + "')", 3)} AS resolves,
                min(reference_month) FILTER (split = '{b}') AS begins,
                coalesce({plus_months("max(reference_month) FILTER (split = '" + a + "')", 3)} > min(reference_month) FILTER (split = '{b}'), false) AS crosses FROM t_split"""
                for a, b in (("train", "validation"), ("validation", "test"))
            )
        ),
        "split_assignment": show(f"{KEYS} split", "t_split"),
        "split_complete_features": statement(
            f"""SELECT CASE WHEN split <> 'ineligible' AND NOT ({' AND '.join(f'{n} IS NOT NULL' for n in NAMES)}) THEN 'ineligible' ELSE split END AS split,
            count(*) AS rows FROM t_split GROUP BY 1"""
        ),
        "split_accounting": show(
            "split #rows #months #entities first_month last_month ~share_cooling ~share_stable ~share_heating",
            f"""(SELECT split, count(*) AS rows, count(DISTINCT reference_month) AS months, count(DISTINCT county_fips) AS entities, min(reference_month) AS first_month,
            max(reference_month) AS last_month, {', '.join(f"coalesce(count(*) FILTER (target_label = '{c}') / nullif(CAST(count(target_label) AS DOUBLE), 0), 0.0) AS share_{c}" for c in CLASSES)} FROM t_split GROUP BY 1)""",
        ),
        "naive_parameters": show("~k ~drift ~climatology majority_label ~majority_share ~share_cooling ~share_stable ~share_heating", "t_fit"),
        "naive_predictions": show(
            f"model county_fips county_name reference_month volume_tier split ~{BASE} ~target_dg target_label ~predicted_dg predicted_label ~prob_cooling ~prob_stable ~prob_heating", "t_pred"
        ),
        "metrics_magnitude": metric_table("model split", "t_pred", "#n ~mae ~rmse ~mean_error ~medae"),
        "metrics_direction": metric_table("model split", "t_pred", "#n ~accuracy ~macro_f1 ~balanced_accuracy"),
        "metrics_probability": metric_table("model split", "t_pred", "~log_loss ~brier"),
        "metrics_forward": metric_table("model split", "t_pred", FORWARD, True),
        "metrics_confusion": statement(
            "SELECT model, split, a.actual, " + ", ".join(f"count(*) FILTER (target_label = a.actual AND predicted_label = '{c}') AS {c}" for c in CLASSES)
            + " FROM t_pred, (VALUES " + ", ".join(f"('{c}')" for c in CLASSES) + ") a(actual) GROUP BY 1, 2, 3"
        ),
        "metrics_per_class": _per_class("t_pred", "model, split"),
        "metrics_by_tier": metric_table("model volume_tier", "t_test", METRICS),
        "metrics_by_year": metric_table("model period", "(SELECT *, CAST(year(reference_month) AS VARCHAR) AS period FROM t_pred)", METRICS),
        "metrics_by_quarter": metric_table("model period", "(SELECT *, year(reference_month) || 'Q' || quarter(reference_month) AS period FROM t_test)", METRICS),
        "metrics_by_entity": metric_table("model county_fips", "t_test", METRICS),
        "metrics_model_table": show(f"model {METRICS} {FORWARD}", "t_table"),
        "metrics_skill": show(f"model ~mae {SKILL} ~macro_f1 ~corr_forward", f"({_skill('t_table')})"),
        "exact_quantiles_bracketed": show(
            'l_returnflag "column" ~prob ~value',
            "(" + " UNION ALL ".join(
                f"SELECT l_returnflag, '{c}' AS \"column\", CAST({p} AS DOUBLE) AS prob, quantile_cont({c}, {p}) AS value FROM lineitem GROUP BY 1"
                for c in ("l_extendedprice", "l_quantity") for p in (0.01, 0.5, 0.975)
            ) + ")",
        ),
        "bootstrap_intervals_entities": show(INTERVAL, f"({_intervals('county', '', ('mae', 'macro_f1'))})", _block_ctes("county_fips")),
        "bootstrap_intervals_months": show(
            INTERVAL, f"({_intervals('month', '', ('mae', 'rmse', 'mean_error', 'accuracy', 'macro_f1', 'balanced_accuracy'))})", _block_ctes("reference_month")
        ),
        "bootstrap_median_error": _median_bootstrap(),
        "bootstrap_poisson_weights": _poisson(),
        "bootstrap_paired_median": _paired_median(),
        "bootstrap_paired_difference": _paired(),
        "eda_target_distribution": show(
            "#rows ~mean ~std start \"end\" ~median ~iqr ~abs_median " + " ".join(f"~q{str(p).replace('.', '_')}" for p in QUANTILES),
            f"""(SELECT count(target_dg) AS rows, avg(target_dg) AS mean, stddev_samp(target_dg) AS std, min(reference_month) AS start, max(reference_month) AS "end",
            quantile_cont(target_dg, 0.5) AS median, quantile_cont(target_dg, 0.75) - quantile_cont(target_dg, 0.25) AS iqr, quantile_cont(abs(target_dg), 0.5) AS abs_median,
            {', '.join(f"quantile_cont(target_dg, {p}) AS q{str(p).replace('.', '_')}" for p in QUANTILES)} FROM t_model)""",
        ),
        "eda_prevalence": show(
            "target_label #rows ~share",
            "(" + " UNION ALL ".join(
                f"SELECT '{c}' AS target_label, count(*) FILTER (target_label = '{c}') AS rows, count(*) FILTER (target_label = '{c}') / CAST(count(target_label) AS DOUBLE) AS share FROM t_model" for c in CLASSES
            ) + ")",
        ),
        "eda_prevalence_by_year": show("#year ~cooling ~stable ~heating #rows", f"(SELECT year(reference_month) AS year, {shares()}, count(*) AS rows FROM t_model GROUP BY 1)"),
        "eda_crosstab_by_year": show(
            "#year #cooling #stable #heating",
            "(SELECT year(reference_month) AS year, " + ", ".join(f"count(*) FILTER (target_label = '{c}') AS {c}" for c in CLASSES) + " FROM t_model GROUP BY 1)",
        ),
        "eda_prevalence_by_tier": show(
            "volume_tier #tier_order ~cooling ~stable ~heating #counties #rows ~dg_sd",
            f"(SELECT volume_tier, {tier_pos('volume_tier')} AS tier_order, {shares()}, count(DISTINCT county_fips) AS counties, count(*) AS rows, stddev_samp(target_dg) AS dg_sd FROM t_model GROUP BY 1)",
        ),
        "eda_prevalence_by_entity": show(
            "county_fips county_name ~cooling ~stable ~heating ~dg_sd ~volume ~smallest_class",
            f"(SELECT *, least(cooling, stable, heating) AS smallest_class FROM (SELECT county_fips, county_name, {shares()}, stddev_samp(target_dg) AS dg_sd, max(homes_sold_median) AS volume FROM t_model GROUP BY 1, 2))",
        ),
        "eda_dispersion": _dispersion("is_included AND has_target"),
        "eda_dispersion_excluded": _dispersion("NOT is_included AND has_target"),
        "eda_dispersion_labelled": _dispersion("has_target", f", max(homes_sold_median) < {T.floor} AS excluded", "excluded"),
        "eda_coverage_summary": show(
            "county_fips county_name #months #months_with_price #months_with_unemployment #labelled_rows ~volume tier included ~price_coverage",
            """(SELECT county_fips, county_name, count(*) AS months, count(median_sale_price) AS months_with_price, count(unemployment_rate) AS months_with_unemployment,
            count(*) FILTER (has_target) AS labelled_rows, max(homes_sold_median) AS volume, max(volume_tier) AS tier, bool_or(is_included) AS included,
            count(median_sale_price) / CAST(count(*) AS DOUBLE) AS price_coverage FROM t_target GROUP BY 1, 2)""",
        ),
        "eda_outliers": _outliers(),
        "eda_seasonality": show(
            "#month ~mean ~std #rows ~stderr ~z abbr",
            """(SELECT *, mean / nullif(stderr, 0) AS z FROM (SELECT *, std / sqrt(rows) AS stderr FROM (SELECT month(reference_month) AS month, avg(target_dg) AS mean, stddev_samp(target_dg) AS std,
            count(*) AS rows, strftime(min(reference_month), '%b') AS abbr FROM t_model GROUP BY 1)))""",
        ),
        "eda_regime_series": show(
            "reference_month ~mean ~std #rows ~rolling_12m_mean ~rolling_12m_sd",
            """(SELECT reference_month, mean, std, rows, CASE WHEN count(mean) OVER f = 12 THEN avg(mean) OVER f END AS rolling_12m_mean,
            CASE WHEN count(mean) OVER f = 12 THEN stddev_samp(mean) OVER f END AS rolling_12m_sd FROM t_monthly
            WINDOW f AS (ORDER BY reference_month ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))""",
        ),
        "eda_shift_scan": show(
            "month ~mean_before ~mean_after ~shift",
            "(SELECT reference_month AS month, mean_before, mean_after, mean_after - mean_before AS shift FROM t_scan WHERE pos >= 12 AND pos < months - 12)",
        ),
        "eda_regime_shifts": _greedy_shifts(),
        "eda_regime_shifts_by_tier": _greedy_by_tier(),
        "eda_rate_regimes": show(
            "rate_band ~cooling ~stable ~heating #rows ~dg_mean",
            f"(SELECT {bands('mortgage_rate_30y')} AS rate_band, {shares()}, count(*) AS rows, avg(target_dg) AS dg_mean FROM t_model WHERE {bands('mortgage_rate_30y')} IS NOT NULL GROUP BY 1)",
        ),
        "eda_representatives": show("volume_tier county_fips county_name ~volume", "t_chosen", _chosen()),
        "eda_representative_series": show(
            "tier county_fips county_name reference_month $price_smoothed ~growth_yoy ~target_dg",
            "(SELECT c.volume_tier AS tier, p.county_fips, p.county_name, p.reference_month, p.price_smoothed, p.growth_yoy, p.target_dg FROM t_target p JOIN t_chosen c ON p.county_fips = c.county_fips)", _chosen(),
        ),
        "eda_histogram": statement(
            """SELECT b AS bin, CAST(b - 30 AS DOUBLE) AS "from", CAST(b - 29 AS DOUBLE) AS "to", (SELECT count(*) FROM t_model WHERE target_dg BETWEEN -30 AND 30 AND least(floor(target_dg + 30), 59) = b) AS rows FROM range(60) x(b)"""
        ),
        "eda_histogram_tails": statement(
            "SELECT count(*) FILTER (target_dg < -30) AS below, count(*) FILTER (target_dg > 30) AS above, count(target_dg) AS rows FROM t_model"
        ),
        **_results("results", "base_effect", "mean_reversion", ("mean_reversion", "base_effect")),
        "imputer_medians": show(
            '"column" ~median',
            "(" + " UNION ALL ".join(f"SELECT '{n}' AS \"column\", quantile_cont({n}, 0.5) AS median FROM t_split WHERE split = 'train'" for n in NAMES) + ") WHERE median IS NOT NULL",
        ),
        "imputer_scaling": _scaling(),
        **_learned(),
    }
    return o


def _results(prefix: str, a: str, b: str, claim: tuple[str, str], extra: dict[str, str] | None = None) -> dict[str, str]:
    """Result tables that compare ``a`` (errors) and ``b`` (classes); ``claim`` holds the models of the claim facts."""
    extra = extra or {}
    source = "(SELECT * FROM t_pred WHERE split IN ('test', 'validation'))"
    concise = " ".join(f"WHEN '{m}' THEN {i}" for i, m in enumerate(CONCISE))
    return {f"{prefix}_{k}": v for k, v in {
        "headline": show(
            f"model {METRICS} {FORWARD} {SKILL}", f"({_skill('t_vtable')})",
            {**extra, "t_vtable": f"SELECT model, {metric_columns(True)} FROM t_pred WHERE split = 'validation' GROUP BY model"},
        ),
        "concise": show(
            f"#position model kind ~mae {SKILL} ~macro_f1 ~corr_forward",
            f"(SELECT *, CASE WHEN model IN ('ridge', 'multinomial_logistic') THEN 'learned' ELSE 'naive' END AS kind, CASE model {concise} END AS position FROM "
            f"({_skill('t_table')}))", extra,
        ),
        "by_tier": show(
            f"volume_tier {METRICS} #tier_order",
            f"(SELECT volume_tier, {metric_columns()}, {tier_pos('volume_tier')} AS tier_order FROM t_test WHERE model = '{a}' GROUP BY 1)", extra,
        ),
        "tier_table": show(
            "volume_tier #n ~mae ~mean_error ~accuracy ~macro_f1 #tier_order",
            f"(SELECT volume_tier, a.n, a.mae, a.mean_error, b.accuracy, b.macro_f1, {tier_pos('volume_tier')} AS tier_order FROM (SELECT volume_tier, {metric_columns()} FROM t_test WHERE model = '{a}' GROUP BY 1) a "
            f"JOIN (SELECT volume_tier, {metric_columns()} FROM t_test WHERE model = '{b}' GROUP BY 1) b USING (volume_tier))", extra,
        ),
        "by_entity": show(
            "county_fips county_name volume_tier ~mae #n county #place #place_in_tier",
            f"(SELECT *, row_number() OVER (PARTITION BY volume_tier {WORST}) AS place_in_tier, row_number() OVER ({WORST}) AS place FROM "
            f"(SELECT county_fips, county_name, volume_tier, avg(abs(predicted_dg - target_dg)) AS mae, count(*) AS n, replace(county_name, ' County', '') AS county FROM t_test WHERE model = '{a}' GROUP BY 1, 2, 3))",
            extra,
        ),
        "base_effect_correlation": show(
            "~corr_dg_base #rows",
            f"(SELECT {corr('target_dg', f'(-{BASE})', f'target_dg IS NOT NULL AND {BASE} IS NOT NULL')} AS corr_dg_base, count(*) AS rows FROM t_test WHERE model = '{a}')", extra,
        ),
        "forward_rows": show(
            f"{KEYS} ~actual_f ~predicted_f volume_tier",
            f"(SELECT county_fips, reference_month, target_dg + {BASE} AS actual_f, predicted_dg + {BASE} AS predicted_f, volume_tier FROM t_test WHERE model = '{claim[0]}') WHERE actual_f IS NOT NULL AND predicted_f IS NOT NULL",
            extra,
        ),
        "intervals": _two_blocks(a, b, extra),
        "claim_facts": _claims(*claim, extra),
        "full_tables": metric_table("split model", source, f"{METRICS} {FORWARD}", True, extra),
        "breakdown": _breakdown(a, b, extra),
        "confusion": statement(
            "SELECT c.*, precision, recall, f1, support, predicted FROM (SELECT model, a.actual, "
            + ", ".join(f"count(*) FILTER (target_label = a.actual AND predicted_label = '{c}') AS {c}" for c in CLASSES)
            + " FROM t_test, (VALUES " + ", ".join(f"('{c}')" for c in CLASSES) + f") a(actual) WHERE model IN ('{a}', '{b}') GROUP BY 1, 2) c JOIN "
            + f"({_class_union('t_test', 'model')}) p ON c.model = p.model AND c.actual = p.class", extra,
        ),
    }.items()}


def _learned() -> dict[str, str]:
    """Fitted models and every table over their predictions; the fits are those of ``oracle_fits``."""
    fits = oracle_fits.tables()
    every = {**fits, "t_pred": f"{CTES['t_pred']} UNION ALL {oracle_fits.predictions()}"}
    names = "[" + ", ".join(f"'{n}'" for n in NAMES) + "]"
    classes = "[" + ", ".join(f"'{c}'" for c in CLASSES) + "]"
    weights = (f"SELECT feature, class, beta[k][i] AS w FROM k_final, (SELECT unnest({names}) AS feature, unnest(range(1, {len(NAMES) + 1})) AS i), "
               f"(SELECT unnest({classes}) AS class, unnest(range(1, {len(CLASSES) + 1})) AS k)")
    largest = lambda key: f"row_number() OVER (ORDER BY round(abs(w), 9) DESC, {key}) AS rank"
    out = {
        "ridge_normal_equations": show(
            "part feature other ~value",
            f"(SELECT 'gram' AS part, f.feature, g.feature AS other, gram[f.i][g.i] / n AS value FROM g_train, q_names f, q_names g WHERE f.i <= g.i "
            "UNION ALL SELECT 'right', feature, NULL, rhs[i] / n FROM g_train, q_names "
            "UNION ALL SELECT 'coefficient', feature, NULL, w[i] FROM r_scan JOIN r_best USING (alpha), q_names)",
            {**fits, "q_names": f"SELECT unnest({names}) AS feature, unnest(range(1, {len(NAMES) + 1})) AS i"},
        ),
        "ridge_coefficients": show(
            "#rank feature ~coefficient", f"(SELECT {largest('feature')}, feature, w AS coefficient FROM (SELECT unnest({names}) AS feature, unnest(w) AS w FROM r_final))", fits),
        "ridge_alpha_scan": show(f"{METRICS} ~alpha", "r_table", fits),
        "logistic_c_scan": show(f"{METRICS} ~C", "(SELECT *, c AS C FROM l_table)", fits),
        "logistic_coefficients": show(
            "#rank feature class ~coefficient", f"(SELECT {largest('feature, class')}, feature, class, w AS coefficient FROM ({weights}))", fits),
        "coefficient_top": show(
            "model #rank feature class ~coefficient",
            f"(SELECT 'ridge' AS model, {largest('feature')}, feature, NULL AS class, w AS coefficient FROM (SELECT unnest({names}) AS feature, unnest(w) AS w FROM r_final) "
            f"UNION ALL SELECT 'multinomial_logistic', {largest('feature, class')}, feature, class, w FROM ({weights})) WHERE rank <= 15", fits),
        "learned_predictions": show(
            f"model county_fips county_name reference_month volume_tier split ~{BASE} ~target_dg target_label ~predicted_dg predicted_label ~prob_cooling ~prob_stable ~prob_heating",
            f"({oracle_fits.predictions()})", fits),
        "family_ablation": show(
            "#position family #features_removed ~mae ~macro_f1",
            "(SELECT row_number() OVER (ORDER BY round(f.mae - a.mae, 9) DESC, f.family) AS position, f.family, f.gone AS features_removed, f.mae - a.mae AS mae, f.macro_f1 - a.macro_f1 AS macro_f1 "
            "FROM f_table f, f_table a WHERE f.family <> '' AND a.family = '')", fits),
    }
    tables = _results("learned", "ridge", "multinomial_logistic", ("ridge", "multinomial_logistic"), every)
    tables["learned_results"] = tables.pop("learned_concise")
    return {**out, **tables}


def _class_union(source: str, keys: str) -> str:
    ok = "target_label IS NOT NULL AND predicted_label IS NOT NULL"
    parts = []
    for c in CLASSES:
        tp = f"count(*) FILTER ({ok} AND target_label = '{c}' AND predicted_label = '{c}')"
        pred, act = f"count(*) FILTER ({ok} AND predicted_label = '{c}')", f"count(*) FILTER ({ok} AND target_label = '{c}')"
        parts.append(f"SELECT {keys}, '{c}' AS class, {tp} AS tp, {act} AS support, {pred} AS predicted FROM {source} GROUP BY {keys}")
    p, r = "coalesce(tp / nullif(CAST(predicted AS DOUBLE), 0), 0.0)", "coalesce(tp / nullif(CAST(support AS DOUBLE), 0), 0.0)"
    return (
        f"SELECT {keys}, class, round({p}, 6) + 0.0 AS precision, round({r}, 6) + 0.0 AS recall, "
        f"round(coalesce(2 * {p} * {r} / nullif({p} + {r}, 0), 0.0), 6) + 0.0 AS f1, support, predicted FROM ({' UNION ALL '.join(parts)})"
    )


def _per_class(source: str, keys: str) -> str:
    return statement(_class_union(source, keys))


def _chosen() -> dict[str, str]:
    return {
        "t_chosen": """SELECT volume_tier, county_fips, county_name, volume FROM (SELECT *, row_number() OVER (PARTITION BY volume_tier ORDER BY volume, county_fips) - 1 AS pos,
            count(*) OVER (PARTITION BY volume_tier) AS n FROM (SELECT DISTINCT volume_tier, county_fips, county_name, homes_sold_median AS volume FROM t_model)) WHERE pos = n // 2"""
    }


def _greedy_shifts(top: int = 5) -> str:
    """Take the largest remaining shift at least 360 days from every month taken, ``top`` times."""
    extra = {
        "g_rank": """SELECT reference_month AS month, mean_before, mean_after, mean_after - mean_before AS shift,
            row_number() OVER (ORDER BY abs(mean_after - mean_before) DESC, reference_month) AS rk FROM t_scan WHERE pos >= 12 AND pos < months - 12"""
    }
    taken: list[str] = []
    for i in range(1, top + 1):
        far = " AND ".join(f"coalesce((SELECT abs(date_diff('day', r.month, t.month)) >= 360 FROM {t} t), true)" for t in taken) or "true"
        extra[f"g_pick{i}"] = f"SELECT {i} AS rank, month, mean_before, mean_after, shift FROM g_rank r WHERE {far} ORDER BY rk LIMIT 1"
        taken.append(f"g_pick{i}")
    return show("#rank month ~mean_before ~mean_after ~shift", "(" + " UNION ALL ".join(f"SELECT * FROM {t}" for t in taken) + ")", extra)


def _greedy_by_tier(top: int = 5) -> str:
    """The same choice within each tier."""
    extra, out = {}, []
    for name in T.tier_names:
        m, s, g = f"m_{name}", f"s_{name}", f"g_{name}"
        extra[m] = f"SELECT reference_month, avg(target_dg) AS mean FROM t_model WHERE volume_tier = '{name}' GROUP BY 1"
        extra[s] = CTES["t_scan"].replace("t_monthly", m)
        extra[g] = f"""SELECT reference_month AS month, mean_before, mean_after, mean_after - mean_before AS shift,
            row_number() OVER (ORDER BY abs(mean_after - mean_before) DESC, reference_month) AS rk FROM {s} WHERE pos >= 12 AND pos < months - 12"""
        taken: list[str] = []
        for i in range(1, top + 1):
            far = " AND ".join(f"coalesce((SELECT abs(date_diff('day', r.month, t.month)) >= 360 FROM {t} t), true)" for t in taken) or "true"
            extra[f"{g}_{i}"] = f"SELECT {i} AS rank, month, mean_before, mean_after, shift FROM {g} r WHERE {far} ORDER BY rk LIMIT 1"
            taken.append(f"{g}_{i}")
            out.append(f"SELECT '{name}' AS volume_tier, * FROM {g}_{i}")
    return show("volume_tier #rank month ~mean_before ~mean_after ~shift", f"({' UNION ALL '.join(out)})", extra)


def _claims(magnitude: str, direction: str, extra: dict[str, str]) -> str:
    of = lambda m, c, n: f"max({c}) FILTER (model = '{m}') AS {n}"
    low, high = T.tiers[1][0], T.tiers[-2][0]
    tier = lambda t, n: f"(SELECT avg(abs(predicted_dg - target_dg)) FROM t_test WHERE model = '{magnitude}' AND volume_tier = '{t}') AS {n}"
    cols = ", ".join([
        of(magnitude, "n", "rows"), of(magnitude, "mae", "mae"), of("base_effect", "mae", "bar_mae"),
        of(magnitude, "skill_vs_base_effect", "skill"), of(magnitude, "corr_forward", "corr_forward"),
        of("base_effect", "corr_forward", "bar_corr_forward"), of(magnitude, "mean_error", "mean_error"),
        of(direction, "macro_f1", "macro_f1"), of("majority_class", "macro_f1", "bar_macro_f1"),
        tier(low, "mae_lowest_tier"), tier(high, "mae_highest_tier"),
    ])
    return show(
        "#rows ~mae ~bar_mae ~skill ~corr_forward ~bar_corr_forward ~mean_error ~macro_f1 ~bar_macro_f1 ~mae_lowest_tier ~mae_highest_tier",
        f"(SELECT {cols} FROM ({_skill('t_table')}))", extra,
    )


def _breakdown(a: str, b: str, extra: dict[str, str]) -> str:
    base = f"(SELECT *, year(reference_month) || 'Q' || quarter(reference_month) AS period FROM t_test WHERE model IN ('{a}', '{b}'))"
    cols = "n, mae, rmse, mean_error, accuracy, macro_f1, balanced_accuracy"
    return show(
        "model kind segment #position #n ~mae ~rmse ~mean_error ~accuracy ~macro_f1 ~balanced_accuracy",
        f"(SELECT model, 'tier' AS kind, volume_tier AS segment, {tier_pos('volume_tier')} AS position, {cols} FROM (SELECT model, volume_tier, {metric_columns()} FROM {base} GROUP BY 1, 2) "
        f"UNION ALL SELECT model, 'period', period, NULL, {cols} FROM (SELECT model, period, {metric_columns()} FROM {base} GROUP BY 1, 2))", extra,
    )
