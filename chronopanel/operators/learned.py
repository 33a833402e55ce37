"""Learned forecasters: ridge from one pass of moments, multinomial logistic by Newton steps of one pass each.

Imputation medians, standardisation and coefficients are numbers per feature, so
they are bounded by the declaration and live on the driver like any fitted model;
all row work stays in Spark.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Correlation, Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..contracts import LOGISTIC_CS, RIDGE_ALPHAS, FeatureContract
from ..functions.scalar import classify
from ..schema import CLASSES, TEST, TRAIN, VALIDATION
from ..session import land
from .metrics import evaluate
from .naive import CONTEXT, PROBS, TRUTH, predict_naive
from .quantiles import exact_quantiles
from .results import LOGISTIC, RIDGE


@dataclass(frozen=True)
class Scaling:
    """Exact medians, then mean and population deviation of the imputed columns."""

    features: tuple[str, ...]
    medians: np.ndarray
    means: np.ndarray
    sds: np.ndarray

    def imputed(self, i: int) -> Column:
        return F.coalesce(F.col(self.features[i]), F.lit(float(self.medians[i])))

    def standardised(self, i: int) -> Column:
        return (self.imputed(i) - float(self.means[i])) / float(self.sds[i])


@dataclass(frozen=True)
class Moments:
    """Everything ridge needs: one scan serves every penalty and every feature subset."""

    scaling: Scaling
    n: int
    corr: np.ndarray  # features x features
    corr_y: np.ndarray
    y_mean: float
    y_sd: float
    rows: DataFrame | None = field(default=None, compare=False)  # landed: truth and the imputed features as an array

    def assembled(self, carry: list[str]) -> DataFrame:
        """``assemble`` on the rows of these moments, as landed."""
        s = self.scaling
        cells = [(F.get("imputed", F.lit(i)) - float(s.means[i])) / float(s.sds[i]) for i in range(len(s.features))]
        return self.rows.select(*carry, _class_number(), F.array(*cells).alias("features"))


def medians(train: DataFrame, features: list[str]) -> np.ndarray:
    rows = exact_quantiles(train, features, [0.5]).select("column", "value").collect()
    found = {r["column"]: r["value"] for r in rows}
    return np.array([found.get(f, 0.0) or 0.0 for f in features])


def moments(train: DataFrame, features: list[str], target: str = "target_dg") -> Moments:
    """Standardised Gram matrix as the correlation matrix, a single treeAggregate.

    The imputed rows are landed, not cached: a cached partition's columns are built in
    the heap, all tasks of an executor at a time, and these rows are the widest there are.
    """
    med = medians(train, features)
    blank = Scaling(tuple(features), med, np.zeros(len(features)), np.ones(len(features)))
    carry = [c for c in dict.fromkeys([*TRUTH, target]) if c in train.columns]
    rows = land(train.select(*carry, F.array(*[blank.imputed(i) for i in range(len(features))]).alias("imputed")), "imputed_rows")
    every = F.array_append("imputed", F.col(target).cast("double"))
    known = F.when(F.exists(every, F.isnan), F.raise_error(F.lit("a feature or the target is not a number"))).otherwise(every)
    vec = rows.filter(F.col(target).isNotNull()).select(array_to_vector(known).alias("v"))
    s = vec.select(Summarizer.metrics("count", "mean", "variance").summary(F.col("v")).alias("s")).first()["s"]
    corr = Correlation.corr(vec, "v").first()[0].toArray()
    n = int(s["count"])
    mean = s["mean"].toArray()
    sd = np.sqrt(s["variance"].toArray() * (n - 1) / n) if n > 1 else np.zeros_like(mean)
    flat = sd <= 1e-12 * np.maximum(1.0, np.abs(mean))
    corr = np.where(np.isfinite(corr), corr, 0.0)
    corr[flat, :] = 0.0
    corr[:, flat] = 0.0
    # A constant column is centred to zero and left unscaled.
    scale = np.where(flat, 1.0, sd)
    return Moments(
        Scaling(tuple(features), med, mean[:-1], scale[:-1]), n, corr[:-1, :-1], corr[:-1, -1], float(mean[-1]), float(sd[-1]), rows
    )


# -------------------------------------------------------------------- ridge


@dataclass(frozen=True)
class RidgeModel:
    scaling: Scaling
    index: tuple[int, ...]  # positions of the features in the scaling
    weights: np.ndarray  # standardised coefficients
    intercept: float
    alpha: float

    def prediction(self) -> Column:
        """A plain linear expression, so predicting stays in generated code."""
        s = self.scaling
        const = self.intercept - sum(w * s.means[i] / s.sds[i] for i, w in zip(self.index, self.weights))
        terms = [s.imputed(i) * float(w / s.sds[i]) for i, w in zip(self.index, self.weights)]
        return _balanced_sum([F.lit(float(const)), *terms])

    def coefficients(self, spark) -> DataFrame:
        rows = [(self.scaling.features[i], float(w)) for i, w in zip(self.index, self.weights)]
        rows.sort(key=lambda r: (-round(abs(r[1]), 9), r[0]))  # weights equal up to rounding go by name
        return spark.createDataFrame(
            [(k + 1, f, w) for k, (f, w) in enumerate(rows)], "rank int, feature string, coefficient double"
        )


def _balanced_sum(terms: list[Column]) -> Column:
    while len(terms) > 1:
        terms = [a + b for a, b in zip(terms[::2], terms[1::2])] + ([terms[-1]] if len(terms) % 2 else [])
    return terms[0]


def solve_ridge(m: Moments, alpha: float, keep: list[int] | None = None) -> RidgeModel:
    """Normal equations on the standardised scale; the matrix is features x features."""
    idx = list(range(len(m.scaling.features))) if keep is None else keep
    gram = m.n * m.corr[np.ix_(idx, idx)] + alpha * np.eye(len(idx))
    rhs = m.n * m.corr_y[idx] * m.y_sd
    return RidgeModel(m.scaling, tuple(idx), np.linalg.solve(gram, rhs), m.y_mean, alpha)


def normal_equations(spark, m: Moments, alpha: float) -> DataFrame:
    """The standardised system of a ridge fit in long form, each cell per row of data: the Gram matrix's upper half, the right side, the solution."""
    names, fit = m.scaling.features, solve_ridge(m, alpha)
    cells = [("gram", a, names[j], float(m.corr[i, j])) for i, a in enumerate(names) for j in range(i, len(names))]
    cells += [("right", a, None, float(m.corr_y[i] * m.y_sd)) for i, a in enumerate(names)]
    cells += [("coefficient", names[i], None, float(w)) for i, w in zip(fit.index, fit.weights)]
    return spark.createDataFrame(cells, "part string, feature string, other string, value double")


def fit_ridge(train: DataFrame, features: list[str], alpha: float) -> RidgeModel:
    return solve_ridge(moments(train, features), alpha)


def _score_ridges(df: DataFrame, models: dict[str, RidgeModel], tau: float) -> DataFrame:
    """Metrics of many ridge models from one scan of the rows."""
    cells = F.array(*[F.struct(F.lit(k).alias("candidate"), m.prediction().alias("predicted_dg")) for k, m in models.items()])
    long = df.select(*TRUTH, F.explode(cells).alias("c")).select(*TRUTH, "c.*")
    long = long.withColumn("predicted_label", classify(F.col("predicted_dg"), tau))
    return evaluate(long.withColumns({p: F.lit(None).cast("double") for p in PROBS}), ["candidate"])


def scan_ridge(m: Moments, validation: DataFrame, tau: float, alphas=RIDGE_ALPHAS) -> tuple[RidgeModel, DataFrame]:
    """Choose alpha by validation MAE; ties go to the smallest."""
    models = {f"{a:g}": solve_ridge(m, a) for a in alphas}
    scores = _score_ridges(validation, models, tau).withColumn("alpha", F.col("candidate").cast("double")).drop("candidate")
    found = {r["alpha"]: r["mae"] for r in scores.select("alpha", "mae").collect()}
    best = min(alphas, key=lambda a: (found.get(float(f"{a:g}"), float("inf")), a))
    return models[f"{best:g}"], scores


# ----------------------------------------------------------------- logistic


@dataclass(frozen=True)
class LogisticModel:
    scaling: Scaling
    index: tuple[int, ...]
    weights: np.ndarray  # classes x features, on the standardised scale
    intercepts: np.ndarray  # minus infinity for a class that was never seen
    c: float
    steps: int
    curvature: np.ndarray | None = None  # of the objective at the optimum, seen classes x (features, intercept)

    def _seen(self) -> list[int]:
        return [k for k in range(len(CLASSES)) if np.isfinite(self.intercepts[k])]

    def without(self, keep: list[int]) -> np.ndarray:
        """Coefficients to start a fit on fewer features from: the least point of this fit's quadratic model with the others at zero."""
        seen, own = self._seen(), list(self.index)
        full = np.column_stack([self.weights[seen], self.intercepts[seen]])
        stays = np.zeros(full.shape, bool)
        stays[:, [own.index(i) for i in keep] + [len(own)]] = True
        stays, flat = stays.ravel(), full.ravel().copy()
        if self.curvature is not None and not stays.all():
            h = self.curvature
            flat[stays] += np.linalg.lstsq(h[np.ix_(stays, stays)], h[np.ix_(stays, ~stays)] @ flat[~stays], rcond=1e-13)[0]
        return flat[stays].reshape(len(seen), -1)

    def rescaled(self, to: Scaling) -> np.ndarray:
        """The same model's coefficients where features are standardised by ``to``."""
        seen, index = self._seen(), list(self.index)
        per = to.sds[index] / self.scaling.sds[index]
        shift = (to.means[index] - self.scaling.means[index]) / self.scaling.sds[index]
        return np.column_stack([self.weights[seen] * per, self.intercepts[seen] + self.weights[seen] @ shift])

    def predict(self, rows: DataFrame) -> DataFrame:
        """Label and one probability per class on assembled rows; an absent class gets 0."""
        seen = [k for k in range(len(CLASSES)) if np.isfinite(self.intercepts[k])]
        own = rows
        # Sums of products, not a function over arrays, so that predicting stays in generated code.
        scores = {
            k: _balanced_sum([F.lit(float(self.intercepts[k])), *[F.get("features", F.lit(i)) * float(w) for i, w in zip(self.index, self.weights[k])]])
            for k in seen
        }
        own = own.withColumns({f"_s{k}": v for k, v in scores.items()})
        own = own.withColumn("_top", F.greatest(*[F.col(f"_s{k}") for k in seen]) if len(seen) > 1 else F.col(f"_s{seen[0]}"))
        own = own.withColumns({f"_e{k}": F.exp(F.col(f"_s{k}") - F.col("_top")) for k in seen})
        total = _balanced_sum([F.col(f"_e{k}") for k in seen])
        probs = [(F.col(f"_e{k}") / total if k in seen else F.lit(0.0)).alias(n) for k, n in enumerate(PROBS)]
        label = F.coalesce(*[F.when(F.col(f"_s{k}") == F.col("_top"), F.lit(CLASSES[k])) for k in seen])
        return own.select(
            *[c for c in rows.columns if c != "features"], F.lit(None).cast("double").alias("predicted_dg"),
            label.alias("predicted_label"), *probs,
        )

    def coefficients(self, spark) -> DataFrame:
        rows = [
            (self.scaling.features[i], c, float(self.weights[k, j]))
            for j, i in enumerate(self.index) for k, c in enumerate(CLASSES) if np.isfinite(self.intercepts[k])
        ]
        rows.sort(key=lambda r: (-round(abs(r[2]), 9), r[0], r[1]))
        return spark.createDataFrame(
            [(k + 1, *r) for k, r in enumerate(rows)], "rank int, feature string, class string, coefficient double"
        )


def _class_number() -> Column:
    return F.when(F.col("target_label").isNotNull(), sum(
        (F.when(F.col("target_label") == c, float(i)).otherwise(0.0) for i, c in enumerate(CLASSES)), F.lit(0.0)
    )).alias("label")


def assemble(df: DataFrame, s: Scaling, carry: list[str]) -> DataFrame:
    """Carried columns plus the class number and the standardised features as an array."""
    return df.select(*carry, _class_number(), F.array(*[s.standardised(i) for i in range(len(s.features))]).alias("features"))


STRETCH = 4096  # sums in one row
SLICE = 1024  # rows multiplied at a time, so that they stay in a core's cache


def _newton_sums(states: dict):
    """Per task, loss, gradient and curvature of every model at its present coefficients, as ``(model, part, cells)``.

    ``states`` holds (columns, coefficients) with an intercept last in each class's row.
    Probabilities add up to one, so the last class's curvature is minus the sum of the
    others': only blocks between the other classes are multiplied out, once per task the rest follows.
    """

    def run(batches):
        sums: dict = {}
        for batch in batches:
            y = batch.column(0).to_numpy(zero_copy_only=False).astype(int)
            if not len(y):
                continue
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(y), -1)
            for lo in range(0, len(y), SLICE):
                some, truth = np.column_stack([x[lo:lo + SLICE], np.ones(len(y[lo:lo + SLICE]))]), y[lo:lo + SLICE]
                for name, (columns, classes, beta) in states.items():
                    own = some if len(columns) == some.shape[1] - 1 else some[:, [*columns, -1]]
                    p = own @ beta.T
                    p = np.exp(p - p.max(axis=1, keepdims=True))
                    p /= p.sum(axis=1, keepdims=True)
                    hit = truth[:, None] == np.array(classes)[None, :]
                    k, d = beta.shape
                    if name not in sums:
                        sums[name] = [np.zeros(2), np.zeros((k, d)), np.zeros((k, d, k, d))]
                    ends, gradient, blocks = sums[name]
                    for i in range(k - 1):
                        for j in range(i, k - 1):
                            weight = p[:, i] * ((i == j) - p[:, j])
                            blocks[i, :, j, :] += (own * weight[:, None]).T @ own
                    gradient += (p - hit).T @ own
                    ends += [-np.log(np.maximum(p[hit], 1e-300)).sum(), len(truth)]
        for name, (ends, gradient, blocks) in sums.items():
            k, d = gradient.shape
            for i in range(k - 1):
                for j in range(i):
                    blocks[i, :, j, :] = blocks[j, :, i, :].T
            blocks[:-1, :, -1, :] = -blocks[:-1, :, :-1, :].sum(axis=2)
            blocks[-1, :, -1, :] = -blocks[:-1, :, -1, :].sum(axis=0)
            flat = np.concatenate([ends, gradient.ravel(), blocks.reshape(k * d, k * d)[np.triu_indices(k * d)]])
            parts = [flat[lo:lo + STRETCH] for lo in range(0, len(flat), STRETCH)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(parts)), pa.array(np.arange(len(parts), dtype=np.int32)), pa.array([p.tolist() for p in parts], pa.list_(pa.float64()))],
                names=["model", "part", "cells"])

    return run


def fit_logistics(rows: DataFrame, s: Scaling, jobs: dict[str, tuple[float, list[int] | None]], most_steps: int = 100,
                  tol: float = 1e-12, starts: dict[str, np.ndarray] | None = None) -> dict[str, LogisticModel]:
    """L2 multinomial fits of summed loss plus |w|^2 / 2C, several penalties and subsets side by side.

    Every step is one pass over the rows for all models that have not converged: tasks
    sum loss, gradient and curvature, and (features x classes)^2 numbers reach the
    driver, which takes a Newton step and halves it where the loss would rise.  The
    objective is strictly convex in the weights, so there is one optimum; a fit that does
    not reach it (Newton decrement at most ``tol`` per row) raises.  Intercepts bear no
    penalty and sum to zero.  ``starts`` names coefficients to begin with instead of
    zeros; they change the number of steps, not the optimum.
    """
    data = rows.filter("label IS NOT NULL").select("label", "features")
    seen = sorted(int(r[0]) for r in data.select("label").distinct().collect())
    if not seen:
        raise ValueError("no labelled rows to fit on")
    every = list(range(len(s.features)))
    states = {k: {"c": c, "idx": every if keep is None else keep, "n": 0, "old": None, "step": None} for k, (c, keep) in jobs.items()}
    for st in states.values():
        st["beta"] = np.zeros((len(seen), len(st["idx"]) + 1))
    for k, beta in (starts or {}).items():
        if beta.shape == states[k]["beta"].shape:
            states[k]["beta"] = beta
    done: dict[str, LogisticModel] = {}
    for turn in range(1, most_steps + 1):
        asked = {k: (st["idx"], seen, st["beta"]) for k, st in states.items() if k not in done}
        sums = data.mapInArrow(_newton_sums(asked), "model string, part int, cells array<double>").groupBy("model", "part").agg(
            Summarizer.sum(array_to_vector("cells")).alias("cells"))
        found: dict[str, dict] = {}
        for r in sums.collect():
            found.setdefault(r["model"], {})[r["part"]] = r["cells"].toArray()
        for name in asked:
            st, own = states[name], found[name]
            beta, (k, d) = st["beta"], st["beta"].shape
            flat = np.concatenate([own[i] for i in range(len(own))])
            penalty = np.tile(np.append(np.full(d - 1, 1.0 / st["c"]), 0.0), k)
            loss = flat[0] + 0.5 * (penalty * beta.ravel() ** 2).sum()
            if st["old"] is not None and loss > st["old"][1] + 1e-9 * max(1.0, abs(st["old"][1])):
                st["step"] = st["step"] / 2
                st["beta"] = st["old"][0] - st["step"].reshape(k, d)
                continue
            gradient = flat[2:2 + k * d] + penalty * beta.ravel()
            curve = np.zeros((k * d, k * d))
            curve[np.triu_indices(k * d)] = flat[2 + k * d:]
            curve = curve + np.triu(curve, 1).T + np.diag(penalty)
            step = np.linalg.lstsq(curve, gradient, rcond=1e-13)[0]
            if gradient @ step <= tol * flat[1]:
                beta = beta - step.reshape(k, d)
                weights, ends = np.zeros((len(CLASSES), d - 1)), np.full(len(CLASSES), -np.inf)
                weights[seen], ends[seen] = beta[:, :-1], beta[:, -1] - beta[:, -1].mean()
                done[name] = LogisticModel(s, tuple(st["idx"]), weights, ends, st["c"], turn, curve)
            else:
                st["old"], st["step"], st["beta"] = (beta, loss), step, beta - step.reshape(k, d)
        if len(done) == len(states):
            return {k: done[k] for k in jobs}
    raise RuntimeError(f"no optimum after {most_steps} steps for {sorted(set(states) - set(done))}")


def fit_logistic(rows: DataFrame, s: Scaling, c: float, keep: list[int] | None = None, start: np.ndarray | None = None, **how) -> LogisticModel:
    return fit_logistics(rows, s, {"": (c, keep)}, starts=None if start is None else {"": start}, **how)[""]


def _dot(x: Column, w: Column) -> Column:
    return F.aggregate(F.zip_with(x, w, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)


def score_fits(rows: DataFrame, tau: float, fits: dict[str, tuple[RidgeModel | None, LogisticModel | None]]) -> DataFrame:
    """Metrics of many candidates from one scan of assembled rows: errors of the ridge, classes and probabilities of the logistic model.

    A candidate without a logistic model takes its class from the predicted value.  The
    table of candidates is as large as their coefficients, so it stands in the plan.
    """
    def wide(model, weights):
        out = np.zeros(len(model.scaling.features))
        out[list(model.index)] = weights
        return F.array(*[F.lit(float(w)) for w in out])

    none = F.lit(None).cast("array<double>")
    cells = [F.struct(
        F.lit(name).alias("candidate"), (none if r is None else wide(r, r.weights)).alias("w"), F.lit(None if r is None else r.intercept).cast("double").alias("b"),
        *[(none if lo is None else wide(lo, lo.weights[k])).alias(f"w{k}") for k in range(len(CLASSES))],
        *[F.lit(None if lo is None else float(lo.intercepts[k])).cast("double").alias(f"b{k}") for k in range(len(CLASSES))],
    ) for name, (r, lo) in fits.items()]
    long = rows.select(*TRUTH, "features", F.explode(F.array(*cells)).alias("m"))
    score = {k: F.col(f"m.b{k}") + _dot(F.col("features"), F.col(f"m.w{k}")) for k in range(len(CLASSES))}
    long = long.select(*TRUTH, "m.candidate", (F.col("m.b") + _dot(F.col("features"), F.col("m.w"))).alias("predicted_dg"),
                       *[v.alias(f"_s{k}") for k, v in score.items()])
    top = F.greatest(*[F.col(f"_s{k}") for k in score])
    total = _balanced_sum([F.exp(F.col(f"_s{k}") - top) for k in score])
    best = F.coalesce(*[F.when(F.col(f"_s{k}") == top, F.lit(CLASSES[k])) for k in score])
    long = long.withColumn("predicted_label", F.when(top.isNull(), classify(F.col("predicted_dg"), tau)).otherwise(best))
    return evaluate(long.withColumns({p: F.exp(F.col(f"_s{k}") - top) / total for k, p in enumerate(PROBS)}), ["candidate"])


def scan_logistic(train_v, validation_v, s: Scaling, tau: float, values=LOGISTIC_CS) -> tuple[LogisticModel, DataFrame]:
    """Choose C by validation macro-F1; ties go to the smallest."""
    models = fit_logistics(train_v, s, {f"{c:g}": (c, None) for c in values})
    scores = score_fits(validation_v, tau, {k: (None, m) for k, m in models.items()})
    scores = scores.withColumn("C", F.col("candidate").cast("double")).drop("candidate")
    found = {r["C"]: r["macro_f1"] for r in scores.select("C", "macro_f1").collect()}
    best = min(values, key=lambda c: (-(found.get(float(f"{c:g}")) or 0.0), c))
    return models[f"{best:g}"], scores


# ---------------------------------------------------------------- the run


@dataclass(frozen=True)
class Run:
    predictions: DataFrame
    ridge: RidgeModel
    logistic: LogisticModel
    ridge_scores: DataFrame
    logistic_scores: DataFrame
    ablation: DataFrame | None = None
    chosen: LogisticModel | None = None  # the logistic fit of the training rows alone
    params: dict = field(default_factory=dict)
    moments: Moments | None = None  # of the training rows alone


def family_masks(contract: FeatureContract) -> dict[str, list[int]]:
    """Positions of the features that stay when a family goes; families that are all there is are no candidates."""
    names = contract.names()
    gone = {family: frozenset(members) for family, members in contract.families().items()}
    return {f: [i for i, n in enumerate(names) if n not in g] for f, g in gone.items() if len(g) < len(names)}


def ablate(m: Moments, train_v: DataFrame, validation_v: DataFrame, contract: FeatureContract, alpha: float, full: LogisticModel, tau: float) -> DataFrame:
    """``(position, family, features_removed, mae, macro_f1, steps)``: change in validation metrics without a family, largest loss first.

    Penalties stay.  Ridge solves submatrices of the one Gram matrix, at no scan.  The
    logistic fits start from the full fit's coefficients, moved by its curvature to
    where the removed ones are zero, so that few passes are left.  All candidates are
    scored in one scan.
    """
    masks, size = family_masks(contract), len(m.scaling.features)
    fits = fit_logistics(train_v, m.scaling, {f: (full.c, keep) for f, keep in masks.items()},
                         starts={f: full.without(keep) for f, keep in masks.items()}) if masks else {}
    scores = score_fits(validation_v, tau, {"": (solve_ridge(m, alpha), full)} | {f: (solve_ridge(m, alpha, masks[f]), fits[f]) for f in masks})
    whole = scores.filter(F.col("candidate") == "").select(F.struct("mae", "macro_f1")).scalar()
    facts = F.create_map(F.lit(""), F.struct(F.lit(0).alias("removed"), F.lit(0).alias("steps")),
                         *[x for f, keep in masks.items() for x in (F.lit(f), F.struct(F.lit(size - len(keep)).alias("removed"), F.lit(fits[f].steps).alias("steps")))])
    out = scores.filter(F.col("candidate") != "").select(
        F.col("candidate").alias("family"), facts[F.col("candidate")]["removed"].alias("features_removed"),
        (F.col("mae") - whole["mae"]).alias("mae"), (F.col("macro_f1") - whole["macro_f1"]).alias("macro_f1"),
        facts[F.col("candidate")]["steps"].alias("steps"))
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.round("mae", 9).desc(), "family"))  # a row per family
    return out.select(place.alias("position"), "*")


def top_coefficients(spark, models: dict[str, RidgeModel | LogisticModel], k: int = 15) -> DataFrame:
    """``(model, rank, feature, class, coefficient)``: the ``k`` largest standardised coefficients of each model."""
    out = None
    for name, model in models.items():
        own = model.coefficients(spark)
        own = own if "class" in own.columns else own.withColumn("class", F.lit(None).cast("string"))
        own = own.filter(F.col("rank") <= k).select(F.lit(name).alias("model"), "rank", "feature", "class", "coefficient")
        out = own if out is None else out.unionByName(own)
    return out


def train_and_score(
    split: DataFrame, contract: FeatureContract, tau: float, with_ablation: bool = False,
    alphas=RIDGE_ALPHAS, cs=LOGISTIC_CS,
) -> Run:
    """Naive and learned models: choose on validation, refit on train + validation, predict all splits."""
    names = contract.names()
    train = split.filter(F.col("split") == TRAIN)
    validation = split.filter(F.col("split") == VALIDATION)
    development = split.filter(F.col("split").isin(TRAIN, VALIDATION))
    scored = split.filter(F.col("split").isin(TRAIN, VALIDATION, TEST))

    m = moments(train, names)
    ridge, ridge_scores = scan_ridge(m, validation, tau, alphas)

    train_v = m.assembled(TRUTH)
    validation_v = assemble(validation, m.scaling, TRUTH)
    logistic, logistic_scores = scan_logistic(train_v, validation_v, m.scaling, tau, cs)
    ablation = (
        ablate(m, train_v, validation_v, contract, ridge.alpha, logistic, tau) if with_ablation else None
    )

    full = moments(development, names)
    final_ridge = solve_ridge(full, ridge.alpha)
    final_logistic = fit_logistic(full.assembled(TRUTH), full.scaling, logistic.c, start=logistic.rescaled(full.scaling))

    keep = [*CONTEXT, *TRUTH]
    null = F.lit(None).cast("double")
    r = scored.select(*keep, final_ridge.prediction().alias("predicted_dg"))
    r = r.withColumns({"model": F.lit(RIDGE), "predicted_label": classify(F.col("predicted_dg"), tau), **{p: null for p in PROBS}})
    lo = final_logistic.predict(assemble(scored, full.scaling, keep)).drop("label").withColumn("model", F.lit(LOGISTIC))
    predictions = predict_naive(split, tau).unionByName(r).unionByName(lo, allowMissingColumns=True)
    return Run(predictions, final_ridge, final_logistic, ridge_scores, logistic_scores, ablation, logistic,
               {"alpha": ridge.alpha, "C": logistic.c}, m)
