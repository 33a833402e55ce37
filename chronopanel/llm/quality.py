"""Quality rules with risk-controlled thresholds (operator 8).

Measures are counted per text.  Thresholds come from labelled documents: one
half proposes, per stratum, a path of ever stricter threshold vectors; the other
half certifies it.  A step is certified when an exact binomial test rejects "good
documents are turned away more often than ``risk``" at the level left by a
Bonferroni correction over strata; steps are tested from mild to strict and
testing ends at the first failure, so all certified steps hold together with
probability ``1 - failure``.  Of these the step with the fewest mistakes on the
proposing half is used.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import store, text_slices

SYMBOLS = "#*$%&|<>"
WINDOW = 8
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "top_word")
# From mild to strict: room above the worst good document of the proposing half (relative, and up to 8
# cells), then the share of good documents that one rule may turn away there.
STEPS = ((1.0, 0.0), (0.5, 0.0), (0.25, 0.0), (0.0, 0.0), (0.0, 0.001), (0.0, 0.002), (0.0, 0.005), (0.0, 0.01), (0.0, 0.02))
GRID = 256  # cells per measure


def repeat_words(words: np.ndarray, ends: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Per text, its words in windows that occur twice or more in it.

    ``words`` numbers the words of all texts, distinct between texts; ``ends``
    are the texts' ends.  Windows get numbers by doubling: a window of 2k words
    is the pair of its halves' numbers, exactly, with no hash involved.  Places
    whose shorter window is unique are left out of the longer ones.
    """
    n = len(words)
    covered = np.zeros(n + 1, np.int64)
    if n >= window:
        ids, places, width = words.astype(np.int64), np.arange(n), 1
        while width < window:
            # A number for every place, -1 where the shorter window occurs once.
            at = np.full(n + width, -1, np.int64)
            at[places] = ids
            second = at[places + width]
            own = second >= 0
            places, pair = places[own], ids[own] * (n + 1) + second[own]
            _, ids, count = np.unique(pair, return_inverse=True, return_counts=True)
            again = count[ids] > 1
            places, ids, width = places[again], ids[again], 2 * width
        np.add.at(covered, places, 1)
        np.add.at(covered, places + window, -1)
    inside = np.concatenate([[0], np.cumsum(np.cumsum(covered[:n]) > 0)])
    return np.diff(inside[np.concatenate([[0], ends])])


def measure(texts: list[str]) -> dict[str, np.ndarray]:
    numbers, sizes, out = [], [], {c: [] for c in COUNTS if c != "n_repeat_words"}
    base = 0
    for text in texts:
        raw = text.encode("utf-8", "surrogatepass")
        words = raw.split()
        lines = [line for line in raw.split(b"\n") if line.strip()]
        seen: dict[bytes, int] = {}
        own = [seen.setdefault(w, len(seen)) for w in words]
        numbers.append(np.array(own, np.int64) + base)
        base += len(seen)
        sizes.append(len(words))
        out["n_words"].append(len(words))
        out["word_chars"].append(len(text) - sum(text.count(c) for c in " \t\n\v\f\r"))
        out["n_symbols"].append(sum(text.count(c) for c in SYMBOLS))
        out["n_lines"].append(len(lines))
        out["n_dup_lines"].append(len(lines) - len(set(lines)))
        out["top_word"].append(int(np.bincount(numbers[-1] - (base - len(seen))).max()) if words else 0)
    ends = np.cumsum(sizes)
    flat = np.concatenate(numbers) if numbers else np.zeros(0, np.int64)
    found = {k: np.array(v, np.int64) for k, v in out.items()}
    return found | {"n_repeat_words": repeat_words(flat, ends)}


def measures(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, n_words, word_chars, …)`` per row; a null text counts as one without words."""

    def run(batches):
        for part, texts in text_slices(batches, text):
            own = measure(texts)
            yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(own[c]) for c in COUNTS]], names=[key, *COUNTS])

    schema = T.StructType([docs.schema[key], *[T.StructField(c, T.LongType()) for c in COUNTS]])
    return docs.select(key, F.col(text).cast("string").alias(text)).mapInArrow(run, schema)


def base_failed():
    """Fewer than 20 words, or over 30 % of them in repeated windows."""
    return (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)


def rules() -> dict:
    """Badness by rule: the larger, the worse; cells of ``1 / GRID`` on the scale of 0 to 1."""
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    mean = F.col("word_chars") / words
    scaled = {
        "symbols": F.col("n_symbols") / chars,
        "symbols_per_word": F.col("n_symbols") / words,
        "repeats": F.col("n_repeat_words") / words,
        "duplicate_lines": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)),
        "commonest_word": F.col("top_word") / words,
        "long_words": mean / 40,
        "short_words": F.lit(1) / F.greatest(mean, F.lit(1)),
    }
    return {k: F.least(F.floor(v * GRID), F.lit(GRID)).cast("int") for k, v in scaled.items()}


RULES = ("symbols", "symbols_per_word", "repeats", "duplicate_lines", "commonest_word", "long_words", "short_words")


def binomial_tail(k: int, n: int, p: float) -> float:
    """Exact P(X <= k) for X binomial(n, p)."""
    if n == 0:
        return 1.0
    terms = [
        math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
        for i in range(min(k, n) + 1)
    ]
    top = max(terms)
    return min(1.0, math.exp(top) * sum(math.exp(t - top) for t in terms))


def _propose(rows: pd.DataFrame) -> pd.DataFrame:
    """Per stratum: for every step the largest cell that each rule still lets through."""
    out = []
    for step, (room, share) in enumerate(STEPS):
        cut = {"stratum": rows["stratum"].iloc[0], "step": step}
        for rule in RULES:
            good = rows[(rows["rule"] == rule) & (rows["quality"] == 1)].groupby("cell")["n"].sum().sort_index()
            most, total = GRID, int(good.sum())
            if total:
                above = total - good.cumsum()  # good documents in larger cells
                most = int(above[above <= share * total].index[0])
                most = min(GRID, most + math.ceil(room * most) + math.ceil(8 * room))
            cut[rule] = most
        out.append(cut)
    return pd.DataFrame(out)


def _certify(risk: float, failure: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("step")
        level = failure / int(rows["strata"].iloc[0])
        best, mistakes, certified = None, None, 0
        for r in rows.itertuples():
            if binomial_tail(int(r.good_rejected), int(r.good), risk) > level:
                break
            certified += 1
            wrong = r.fit_good_rejected + r.fit_bad - r.fit_bad_rejected
            if best is None or wrong < mistakes:
                best, mistakes = r, wrong
        cut = {c: getattr(best, c) if best is not None else GRID for c in RULES}
        return pd.DataFrame([{
            "stratum": rows["stratum"].iloc[0], "step": best.step if best is not None else -1, "certified_steps": certified,
            "good": int(rows["good"].iloc[0]), "good_rejected": int(best.good_rejected) if best is not None else 0, **cut}])

    return run


def _any_over(prefix: str = ""):
    over = F.lit(False)
    for rule in RULES:
        over = over | (F.col(f"m_{rule}") > F.col(f"{prefix}{rule}"))
    return over


def thresholds(measured: DataFrame, labels: DataFrame, risk: float = 0.05, failure: float = 0.05) -> DataFrame:
    """Certified cutoffs per stratum from ``(key, stratum, base_failed, m_…)`` and ``(key, quality)``.

    Labels other than 0 and 1 are left out; a key labelled both ways counts as
    bad.  Documents that already fail the base rules take no part.  A stratum
    without a certified step gets cutoffs that turn nothing away.  One row per
    stratum; only counts by stratum, rule and cell are grouped.
    """
    marks = labels.filter(F.col("quality").isin(0, 1) & F.col("key").isNotNull()).groupBy("key").agg(
        F.min("quality").cast("int").alias("quality"))
    own = store(
        measured.filter(~F.col("base_failed")).join(marks, "key")
        .withColumn("half", F.pmod(F.xxhash64("key", F.lit("half")), F.lit(2)).cast("int"))
        .select("stratum", "quality", "half", *[f"m_{r}" for r in RULES]), "quality-labelled")
    cells = (
        own.filter("half = 0")
        .select("stratum", "quality", F.explode(F.array(*[
            F.struct(F.lit(r).alias("rule"), F.col(f"m_{r}").alias("cell")) for r in RULES])).alias("c"))
        .groupBy("stratum", "quality", "c.rule", "c.cell").agg(F.count("*").alias("n"))
    )
    shape = "stratum string, step int, " + ", ".join(f"{r} int" for r in RULES)
    proposed = cells.groupBy("stratum").applyInPandas(_propose, shape)
    of = lambda half, quality: (F.col("half") == half) & (F.col("quality") == quality)
    tally = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    tested = own.join(proposed, "stratum").groupBy("stratum", "step", *RULES).agg(
        tally(of(1, 1)).alias("good"), tally(of(1, 1) & _any_over()).alias("good_rejected"),
        tally(of(0, 1) & _any_over()).alias("fit_good_rejected"),
        tally(of(0, 0)).alias("fit_bad"), tally(of(0, 0) & _any_over()).alias("fit_bad_rejected"))
    chosen = tested.withColumn("strata", F.lit(own.select("stratum").distinct().count())).groupBy("stratum").applyInPandas(
        _certify(risk, failure),
        "stratum string, step int, certified_steps int, good long, good_rejected long, " + ", ".join(f"{r} int" for r in RULES))
    return store(chosen, "quality-thresholds")


def judge(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang",
    carry: str | None = None, risk: float = 0.05, failure: float = 0.05,
) -> DataFrame:
    """Measures, ``base_failed``, ``kept`` and the certified step for every row.

    ``labels`` holds ``key`` and ``quality``.  A null stratum is a stratum of its
    own.  Null, empty and blank texts fail the base rules.  Repeated rows are
    judged alike; rows with null keys are judged but have no labels.  Other
    columns are not read, but for one named by ``carry``, which is returned too.
    """
    whole = docs.select(
        F.struct(F.col(key).alias("key"), F.coalesce(F.col(stratum).cast("string"), F.lit("\0")).alias("stratum"),
                 (F.col(carry) if carry else F.lit(None).cast("int")).alias("carried")).alias("own"),
        F.col(text).alias("text"))
    own = measures(whole, "own", "text").select("own.key", "own.stratum", "own.carried", *COUNTS)
    own = store(own.withColumn("base_failed", base_failed()).select("*", *[v.alias(f"m_{k}") for k, v in rules().items()]),
                "quality-measures")
    cuts = thresholds(own, labels.select(F.col(key).alias("key"), F.col("quality")), risk, failure)
    judged = own.join(cuts.select("stratum", "step", *RULES), "stratum", "left")
    kept = ~F.col("base_failed") & ~F.coalesce(_any_over(), F.lit(False))
    carried = [F.col("carried").alias(carry)] if carry else []
    return judged.select(F.col("key").alias(key), *COUNTS, "base_failed", kept.alias("kept"), "step", *carried)


def keep(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang", **how,
) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with their own columns only.

    A verdict belongs to a key, text and stratum, so rows that share a key are
    told apart by their text's hash.
    """
    mark = [F.col(key).cast("long").alias("k"), F.xxhash64(F.col(text)).alias("h"), F.col(stratum).cast("string").alias("s")]
    named = docs.select(F.struct(*mark).alias("carried"), F.col(text).alias("text"))
    named = named.select("carried", F.col("carried.k").alias("key"), F.col("carried.s").alias("stratum"), "text")
    good = judge(named, labels.select(F.col(key).alias("key"), "quality"), "key", "text", "stratum", "carried", **how)
    good = good.filter("kept").select("carried.*").distinct()
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"), *mark)
    same = [whole[c].eqNullSafe(good[c]) for c in ("k", "h", "s")]
    return whole.join(good, same[0] & same[1] & same[2], "left_semi").select("own.*")
