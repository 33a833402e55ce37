"""Fitted models in plain SQL: ridge by conjugate gradients, multinomial logistic by a damped Newton recursion.

Nothing here uses the DataFrame code or its solvers.  Rows become lists of
standardised features, columns the lists of a feature over all rows; matrices are
lists of lists.  A Newton step solves its system by conjugate gradients, and takes
of six step lengths the one with the least loss, so the recursion cannot diverge;
next to the optimum, where losses differ by rounding alone, it takes the whole step.
"""

from __future__ import annotations

from ..contracts import LOGISTIC_CS, RIDGE_ALPHAS, STAR as C
from ..schema import CLASSES

NAMES = C.features.names()
D = len(NAMES)
SETS = {"train": "split = 'train'", "dev": "split IN ('train', 'validation')"}
TURNS, SOLVES = 30, 160  # Newton steps and conjugate gradient steps, at most
LENGTHS = (1.0, 0.5, 0.25, 0.1, 0.02, 0.0)


def bind(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` standing for ``value``, which is computed once."""
    return f"list_transform([{value}], lambda {name}: {body})[1]"


def added(a: str, b: str, times: str) -> str:
    return f"list_transform(list_zip({a}, {b}), lambda z: z[1] + ({times}) * z[2])"


def product(a: str, b: str) -> str:
    return f"list_transform(list_zip({a}, {b}), lambda z: z[1] * z[2])"


def solved(matrix: str, diagonal: str, keep: str, right: str, steps: int) -> str:
    """Conjugate gradients for (matrix + diagonal) x = right, in the coordinates where ``keep`` is one."""
    empty = "{'x': NULL::DOUBLE[], 'r': NULL::DOUBLE[], 'p': NULL::DOUBLE[], 'rr': 0.0::DOUBLE}"
    q = product(added(f"list_transform({matrix}, lambda w: list_inner_product(w, s.p))", product(diagonal, "s.p"), "1.0"), keep)
    ratio = "coalesce(v.rr / nullif(v.u.t.s.rr, 0), 0.0)"
    step = bind(
        f"{{'s': s, 'q': {q}}}", "t", bind(
            "{'t': t, 'a': coalesce(t.s.rr / nullif(list_inner_product(t.s.p, t.q), 0), 0.0)}", "u", bind(
                bind(f"{{'u': u, 'r': {added('u.t.s.r', 'u.t.q', '-u.a')}}}", "k", "{'u': k.u, 'r': k.r, 'rr': list_inner_product(k.r, k.r)}"), "v",
                f"{{'x': {added('v.u.t.s.x', 'v.u.t.s.p', 'v.u.a')}, 'r': v.r, 'p': {added('v.r', 'v.u.t.s.p', ratio)}, 'rr': v.rr}}")))
    start = bind(product(right, keep), "b", "{'x': list_transform(b, lambda z: 0.0::DOUBLE), 'r': b, 'p': b, 'rr': list_inner_product(b, b)}")
    return f"list_reduce(list_transform(range({steps}), lambda k: {empty}), lambda s, e: {step}, {start}).x"


def tables() -> dict[str, str]:
    """Shared expressions; the recursive ones are marked by their names ``n_``."""
    out = {}
    cells = lambda each: "[" + ", ".join(each(i, n) for i, n in enumerate(NAMES, 1)) + "]"
    for name, where in SETS.items():
        out[f"x_{name}"] = f"SELECT {cells(lambda i, n: f'coalesce(quantile_cont({n}, 0.5), 0.0)')} AS med FROM t_split WHERE {where}"
        out[f"y_{name}"] = (
            f"SELECT county_fips, reference_month, split, target_dg, target_label, {cells(lambda i, n: f'coalesce({n}, med[{i}])')} AS v "
            f"FROM t_split, x_{name} WHERE split IN ('train', 'validation', 'test')")
        spread = lambda i, n: f"CASE WHEN stddev_pop(v[{i}]) <= 1e-12 * greatest(1.0, abs(avg(v[{i}]))) THEN 1.0 ELSE stddev_pop(v[{i}]) END"
        out[f"s_{name}"] = (
            f"SELECT {cells(lambda i, n: f'avg(v[{i}])')} AS mean, {cells(spread)} AS sd, avg(target_dg) AS y_mean, count(*) AS n "
            f"FROM y_{name} WHERE {where} AND target_dg IS NOT NULL")
        out[f"z_{name}"] = (
            "SELECT county_fips, reference_month, split, target_dg, target_label, "
            f"list_transform(list_zip(v, mean, sd), lambda e: (e[1] - e[2]) / e[3]) AS z FROM y_{name}, s_{name}")
        order = "ORDER BY county_fips, reference_month"
        # Standardised columns, the same of every fit, and the centred target.
        out[f"c_{name}"] = (
            f"SELECT {cells(lambda i, n: f'list(z[{i}] {order})')} AS cols, list(target_dg - y_mean {order}) AS y, any_value(n) AS n, any_value(y_mean) AS y_mean "
            f"FROM z_{name}, s_{name} WHERE {where} AND target_dg IS NOT NULL")
        out[f"g_{name}"] = (
            "SELECT list_transform(cols, lambda a: list_transform(cols, lambda b: list_inner_product(a, b))) AS gram, "
            f"list_transform(cols, lambda a: list_inner_product(a, y)) AS rhs, n, y_mean FROM c_{name}")
        # Rows and columns with a constant last, for the logistic fits.
        out[f"l_{name}"] = (
            f"SELECT row_number() OVER ({order}) AS id, list_append(z, 1.0) AS x, "
            + ", ".join(f"(target_label = '{c}')::INT AS h{k}" for k, c in enumerate(CLASSES)) + f" FROM z_{name} WHERE {where} AND target_label IS NOT NULL")
        out[f"lc_{name}"] = "SELECT [" + ", ".join(f"list(x[{i}] ORDER BY id)" for i in range(1, D + 2)) + f"] AS cols FROM l_{name}"
    alphas = ", ".join(f"({a!r}::DOUBLE)" for a in RIDGE_ALPHAS)
    ones = f"list_transform(range({D}), lambda i: 1.0::DOUBLE)"
    out["r_scan"] = f"SELECT alpha, {_ridge('alpha', ones)} AS w, y_mean FROM g_train, (VALUES {alphas}) a(alpha)"
    out["r_scored"] = f"SELECT alpha, {_truth('y_mean + list_inner_product(z, w)')} FROM z_train, r_scan WHERE split = 'validation'"
    out["r_table"] = f"SELECT alpha, {_metrics()} FROM r_scored GROUP BY alpha"
    out["r_best"] = "SELECT alpha FROM r_table ORDER BY mae, alpha LIMIT 1"
    out["r_final"] = f"SELECT alpha, {_ridge('alpha', ones)} AS w, y_mean FROM g_dev, r_best"
    cs = ", ".join(f"({c!r}::DOUBLE)" for c in LOGISTIC_CS)
    every = f"list_transform(range({3 * (D + 1)}), lambda i: 1.0::DOUBLE)"
    out["m_scan"] = f"SELECT c AS model, c, {every} AS keep FROM (VALUES {cs}) a(c)"
    out["n_scan"] = newton("n_scan", "train", "m_scan")
    out["k_scan"] = "SELECT model, c, beta FROM n_scan QUALIFY row_number() OVER (PARTITION BY model ORDER BY it DESC) = 1"
    out["l_scored"] = f"SELECT c, {_labelled('k_scan', 'z_train', 'c')} WHERE split = 'validation')"
    out["l_table"] = f"SELECT c, {_metrics()} FROM l_scored GROUP BY c"
    out["l_best"] = "SELECT c FROM l_table ORDER BY round(macro_f1, 12) DESC, c LIMIT 1"
    out["m_final"] = f"SELECT c AS model, c, {every} AS keep FROM l_best"
    out["n_final"] = newton("n_final", "dev", "m_final")
    out["k_final"] = "SELECT model, c, beta FROM n_final QUALIFY row_number() OVER (PARTITION BY model ORDER BY it DESC) = 1"
    out.update(_ablation())
    return out


def _ridge(alpha: str, keep: str) -> str:
    return solved("gram", f"list_transform(range({D}), lambda i: {alpha})", keep, "rhs", 600)


def _label(x: str) -> str:
    return f"CASE WHEN {x} <= -{C.target.tau} THEN 'cooling' WHEN {x} >= {C.target.tau} THEN 'heating' WHEN {x} IS NOT NULL THEN 'stable' END"


def _truth(value: str) -> str:
    return (f"target_dg, target_label, {value} AS predicted_dg, {_label(f'({value})')} AS predicted_label, "
            + ", ".join(f"CAST(NULL AS DOUBLE) AS prob_{c}" for c in CLASSES))


def _metrics() -> str:
    from .oracle import metric_columns

    return metric_columns()


def _labelled(models: str, rows: str, keys: str, also: str = "") -> str:
    """Label and probabilities of every row by every model; the caller closes the bracket, with a condition if it likes."""
    shift = [f"exp(s{k} - greatest(s0, s1, s2))" for k in range(3)]
    total = " + ".join(shift)
    scores = ", ".join(f"list_inner_product(beta[{k + 1}], list_append(z, 1.0)) AS s{k}" for k in range(3))
    probs = ", ".join(f"{shift[k]} / ({total}) AS prob_{c}" for k, c in enumerate(CLASSES))
    best = " ".join(f"WHEN s{k} = greatest(s0, s1, s2) THEN '{c}'" for k, c in enumerate(CLASSES))
    return (f"{also} target_dg, target_label, CAST(NULL AS DOUBLE) AS predicted_dg, CASE {best} END AS predicted_label, {probs} "
            f"FROM (SELECT {keys}, {also} split, target_dg, target_label, {scores} FROM {rows}, {models}")


def newton(name: str, data: str, models: str) -> str:
    """Recursion from zero coefficients; a row per model and turn, until the decrement is below rounding."""
    d = D + 1
    scores = ", ".join(f"list_inner_product(beta[{k + 1}], x) AS s{k}" for k in range(3))
    top = "greatest(s0, s1, s2)"
    total = " + ".join(f"exp(s{k} - {top})" for k in range(3))
    p = [f"exp(s{k} - {top}) / ({total})" for k in range(3)]
    lists = ", ".join(f"list({p[k]} ORDER BY id) AS p{k}, list({p[k]} - h{k} ORDER BY id) AS e{k}" for k in range(3))
    by_model = (f"SELECT model, c, it, beta, {lists} FROM (SELECT n.*, id, h0, h1, h2, {scores} FROM {name} n, l_{data} "
                f"WHERE it < {TURNS} AND decrement > 1e-19) GROUP BY model, c, it, beta")
    weight = {(a, b): (f"list_transform(p{a}, lambda z: z * (1 - z))" if a == b else f"list_transform(list_zip(p{a}, p{b}), lambda z: -z[1] * z[2])")
              for a in range(3) for b in range(a, 3)}
    blocks = ", ".join(
        "list_transform(list_transform(cols, lambda col: " + product("col", w) + f"), lambda q: list_transform(cols, lambda col: list_inner_product(q, col))) AS b{a}{b}"
        for (a, b), w in weight.items())
    penalty = f"list_transform(range({3 * d}), lambda i: CASE WHEN i % {d} = {d - 1} THEN 0.0 ELSE 1.0 / c END)"
    flat = "flatten(beta)"
    gradient = "flatten([" + ", ".join(f"list_transform(cols, lambda col: list_inner_product(col, e{k}))" for k in range(3)) + "])"
    sums = f"SELECT model, c, it, beta, {flat} AS flat, {penalty} AS penalty, {gradient} AS slope, {blocks} FROM ({by_model}), lc_{data}"
    rows = "flatten([" + ", ".join(
        f"list_transform(range(1, {d + 1}), lambda i: flatten([" + ", ".join(f"b{min(a, b)}{max(a, b)}[i]" for b in range(3)) + "]))" for a in range(3)) + "])"
    ready = (f"SELECT f.model, f.c, it, flat, penalty, keep, {product(added('slope', product('penalty', 'flat'), '1.0'), 'keep')} AS g, {rows} AS h "
             f"FROM ({sums}) f JOIN {models} m ON f.model = m.model")
    stepped = f"SELECT model, c, it, flat, penalty, g, {solved('h', 'penalty', 'keep', 'g', SOLVES)} AS delta FROM ({ready})"
    tried = (f"SELECT model, c, it, list_inner_product(g, delta) AS decrement, penalty, len, {added('flat', 'delta', '-len')} AS next "
             f"FROM ({stepped}), (VALUES {', '.join(f'({x!r}::DOUBLE)' for x in LENGTHS)}) l(len)")
    cut = ", ".join(f"list_inner_product(next[{k * d + 1}:{(k + 1) * d}], x) AS s{k}" for k in range(3))
    loss = f"sum({top} + ln({total}) - h0 * s0 - h1 * s1 - h2 * s2)"
    valued = (f"SELECT model, c, it, decrement, len, next, {loss} + any_value(list_inner_product(penalty, {product('next', 'next')})) / 2 AS loss "
              f"FROM (SELECT t.*, h0, h1, h2, {cut} FROM ({tried}) t, l_{data}) GROUP BY model, c, it, decrement, len, next")
    zero = f"[list_transform(range({d}), lambda i: 0.0::DOUBLE), list_transform(range({d}), lambda i: 0.0::DOUBLE), list_transform(range({d}), lambda i: 0.0::DOUBLE)]"
    split = f"[next[1:{d}], next[{d + 1}:{2 * d}], next[{2 * d + 1}:{3 * d}]]"
    return (f"SELECT model, c, 0 AS it, {zero} AS beta, 1.0::DOUBLE AS decrement FROM {models} UNION ALL "
            f"SELECT model, c, any_value(it) + 1, arg_min({split}, CASE WHEN decrement < 1e-8 THEN -len ELSE loss END), any_value(decrement) FROM ({valued}) GROUP BY model, c")


def _ablation() -> dict[str, str]:
    out, families = {}, sorted((f, set(m)) for f, m in C.features.families().items() if len(set(m)) < D)
    kept = [("", set()), *families]
    masks = lambda gone: "[" + ", ".join("0.0" if n in gone else "1.0" for n in NAMES) + "]::DOUBLE[]"
    out["m_family"] = " UNION ALL ".join(f"SELECT '{f}' AS family, {len(gone)} AS gone, {masks(gone)} AS keep" for f, gone in kept)
    out["r_family"] = f"SELECT family, {_ridge('alpha', 'keep')} AS w, y_mean FROM g_train, r_best, m_family"
    out["r_without"] = f"SELECT family, {_truth('y_mean + list_inner_product(z, w)')} FROM z_train, r_family WHERE split = 'validation'"
    out["m_without"] = ("SELECT family AS model, c, flatten([list_append(keep, 1.0), list_append(keep, 1.0), list_append(keep, 1.0)]) AS keep FROM m_family, l_best")
    out["n_without"] = newton("n_without", "train", "m_without")
    out["k_without"] = "SELECT model AS family, beta FROM n_without QUALIFY row_number() OVER (PARTITION BY model ORDER BY it DESC) = 1"
    out["l_without"] = f"SELECT family, {_labelled('k_without', 'z_train', 'family')} WHERE split = 'validation')"
    out["f_table"] = (
        f"SELECT family, gone, r.mae, l.macro_f1 FROM (SELECT family, {_metrics()} FROM r_without GROUP BY family) r "
        f"JOIN (SELECT family, {_metrics()} FROM l_without GROUP BY family) l USING (family) JOIN m_family USING (family)")
    return out


def predictions() -> str:
    """Long predictions of both learned models, in the columns of the naive ones."""
    from .oracle import BASE

    keep = f"s.county_fips, county_name, s.reference_month, volume_tier, s.split, {BASE}, s.target_dg, s.target_label"
    join = "JOIN t_split s ON s.county_fips = p.county_fips AND s.reference_month = p.reference_month"
    null = ", ".join(f"CAST(NULL AS DOUBLE) AS prob_{c}" for c in CLASSES)
    ridge = f"SELECT county_fips, reference_month, y_mean + list_inner_product(z, w) AS v FROM z_dev, r_final"
    logistic = _labelled("k_final", "z_dev", "county_fips, reference_month")
    return (
        f"SELECT 'ridge' AS model, {keep}, v AS predicted_dg, {_label('v')} AS predicted_label, {null} FROM ({ridge}) p {join} UNION ALL "
        f"SELECT 'multinomial_logistic', {keep}, predicted_dg, predicted_label, " + ", ".join(f"prob_{c}" for c in CLASSES)
        + f" FROM (SELECT county_fips, reference_month, {logistic})) p {join}")
