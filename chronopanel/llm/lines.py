"""Line deduplication by a deletion-neighbourhood join (operator 7).

Two lines are near when one edit (a character replaced, added or left out) makes
them equal.  Each line emits itself and itself without each character, as
hashes.  Lines that share a variant with the same place left out differ by a
replacement there; a line that equals a variant of a longer one lacks that
character.  A line's earliest near line comes from the least of such a run, so lines
that share a variant are not all paired; as distinct lines of one run differ in one
character, a run is no longer than the alphabet, or that times the line's length.
The edit distance of the pair found is verified on the texts.

Near lines agree on all but one of ``m`` segments, counted from head and tail.
Hashes of these, first of halves and then of eighths, tell which lines can have a near
line and where the edit would be, so that variants are made for little else.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import partitions, store, text_slices

LEAST = 1  # characters; every line that is not blank takes part
NEAR = 20  # characters; shorter lines go as exact repeats only, as one edit makes another short line of them
_SEEN = 400_000  # lines a task remembers, to leave out repeats early


def _number(raw: bytes) -> tuple[int, int]:
    from xxhash import xxh3_128_intdigest

    x = xxh3_128_intdigest(raw)
    return _signed(x >> 64), _signed(x & ((1 << 64) - 1))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


_B1, _B2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F  # odd multipliers of the two polynomial hashes


def variant_hashes(line: str) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of the line (first) and of the line without each of its characters.

    Polynomial hashes modulo 2**64 over mixed code points, from prefix and suffix
    sums, so all variants together cost as much as the line.
    """
    codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    out = []
    for base, shift in ((_B1, 32), (_B2, 29)):
        mixed = codes * np.uint64(0xFF51AFD7ED558CCD + 2 * shift)
        mixed ^= mixed >> np.uint64(shift)
        mixed *= np.uint64(base)
        powers = np.cumprod(np.full(len(codes), base, np.uint64))  # base ** (place + 1)
        terms = mixed * powers
        heads = np.concatenate([[np.uint64(0)], np.cumsum(terms)])
        # Behind the place left out every power is one less: weigh those terms by the power before.
        lower = np.concatenate([[np.uint64(1)], powers[:-1]])
        shifted = np.concatenate([[np.uint64(0)], np.cumsum(mixed * lower)])
        without = heads[:-1] + (shifted[-1] - shifted[1:])
        h = np.concatenate([heads[-1:], without])
        h ^= h >> np.uint64(31)
        out.append((h * np.uint64(base)).view(np.int64))
    return out[0], out[1]


def segment_keys(line: str, m: int) -> list[tuple[int, int, int]]:
    """``(hash, lo, hi)``: what is left of a line without places ``lo`` to ``hi``, for each of ``m`` segments.

    Segments are laid out for the line's own length and for one less, so that a
    line and one with a character more have common layouts.
    """
    from xxhash import xxh3_64_intdigest

    n, out = len(line), {}
    for whole in (n, n - 1):
        for k in range(m):
            lo, tail = k * whole // m, whole - (k + 1) * whole // m
            rest = f"{whole} {k} {line[:lo]}\0{line[n - tail:]}"
            out[_signed(xxh3_64_intdigest(rest.encode("utf-8", "surrogatepass")))] = (lo, n - tail)
    return [(h, lo, hi) for h, (lo, hi) in out.items()]


def within_one(a: str, b: str) -> bool:
    """Edit distance of at most one, from the common head and tail."""
    if abs(len(a) - len(b)) > 1:
        return False
    n = min(len(a), len(b))
    head = 0
    while head < n and a[head] == b[head]:
        head += 1
    return a[head + 1:] == b[head + 1:] if len(a) == len(b) else (
        a[head + 1:] == b[head:] if len(a) > len(b) else a[head:] == b[head + 1:])


OCCURRENCES = "a long, b long, key long, row long, line int, halves array<long>"


def _row(text):
    """Tells rows that share a key apart; rows with the same key and text are alike in every line."""
    return F.xxhash64(text.cast("string"))


def occurrences(docs: DataFrame, key: str, text: str, least: int, near: int) -> DataFrame:
    """Every line of ``least`` characters or more that is not blank: its number ``(a, b)`` and place ``(key, row, line)``.

    ``halves`` comes with the earliest places only that a task sees of a line; it
    is empty for a line of less than ``near`` characters.
    """

    def split(batches):
        seen: dict[tuple[int, int], tuple] = {}
        for part, texts in text_slices(batches, "text"):
            rows: list[tuple] = []
            for k, row, whole in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), texts):
                for n, line in enumerate(whole.split("\n")):
                    if len(line) < least or not line or line.isspace():
                        continue
                    own, place, halves = _number(line.encode("utf-8", "surrogatepass")), (k is not None, k or 0, row, n), None
                    if own not in seen or place < seen[own]:
                        seen[own] = place
                        halves = [h for h, _, _ in segment_keys(line, 2)] if len(line) >= near else []
                    rows.append((*own, k, row, n, halves))
            if len(seen) > _SEEN:
                seen.clear()
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["a", "b", "key", "row", "line", "halves"])

    own = docs.select(F.col(key).cast("long").alias("key"), _row(F.col(text)).alias("row"), F.col(text).cast("string").alias("text"))
    return store(own.mapInArrow(split, OCCURRENCES), "line-occurrences")


def distinct_lines(seen: DataFrame) -> DataFrame:
    """Every line once, with its earliest place (null keys first)."""

    def first(batches):
        last = None
        for batch in batches:
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(a):
                continue
            new = np.concatenate([[last != (a[0], b[0])], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
            last = (a[-1], b[-1])
            yield batch.filter(pa.array(new))

    dealt = seen.filter("halves IS NOT NULL").repartition(partitions(seen.sparkSession), "a", "b")
    dealt = dealt.sortWithinPartitions("a", "b", F.col("key").asc_nulls_first(), "row", "line")
    return store(dealt.mapInArrow(first, OCCURRENCES), "lines")


def _shared(keys: DataFrame) -> DataFrame:
    """The rows whose ``h`` occurs more than once; counted first, so that a frequent ``h`` is combined and can be split."""
    often = keys.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h")
    return keys.join(often, "h")


def able_lines(docs: DataFrame, lines: DataFrame, key: str, text: str) -> DataFrame:
    """Lines that share a half with another, with their texts; ``r`` numbers them in order of place."""
    some = _shared(lines.select(F.explode("halves").alias("h"), "a", "b")).select("a", "b").distinct()
    places = lines.join(some, ["a", "b"]).groupBy("key", "row").agg(
        F.collect_list(F.struct("line", "a", "b")).alias("places"))
    own = docs.select(F.col(key).cast("long").alias("doc"), _row(F.col(text)).alias("doc_row"), F.col(text).cast("string").alias("text"))
    # Lines to look up grow with the corpus, so documents are always dealt by key, at any size.
    places = store(places, "line-places").hint("merge")
    both = own.join(places, F.col("doc").eqNullSafe(F.col("key")) & (F.col("doc_row") == F.col("row"))).select(
        "doc", "row", "text", "places")

    def pick(batches):
        for batch in batches:
            rows = []
            for k, row, whole, wanted in zip(*[batch.column(c).to_pylist() for c in range(4)]):
                own = (whole or "").split("\n")
                for w in wanted:  # only the line meant is taken
                    line = own[w["line"]] if w["line"] < len(own) else ""
                    if _number(line.encode("utf-8", "surrogatepass")) == (w["a"], w["b"]):
                        rows.append((w["a"], w["b"], k, row, w["line"], line))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["a", "b", "key", "row", "line", "text"])

    found = both.mapInArrow(pick, "a long, b long, key long, row long, line int, text string")
    by = [F.col("key").asc_nulls_first(), F.col("row"), F.col("line"), F.col("a"), F.col("b")]
    n = partitions(docs.sparkSession)
    ranked = store(found, "lines-found").dropDuplicates(["a", "b"]).repartitionByRange(n, *by).sortWithinPartitions(*by)
    return store(ranked.withColumn("r", F.monotonically_increasing_id()), "lines-able")


def near_lines(able: DataFrame) -> DataFrame:
    """``(a, b)`` of the lines with an earlier line within one edit."""

    def eighths(batches):
        for batch in batches:
            rows = [(h, r, lo, hi) for r, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                    for h, lo, hi in segment_keys(line, 8)]
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["h", "r", "lo", "hi"])

    keys = store(able.select("r", "text").mapInArrow(eighths, "h long, r long, lo int, hi int"), "line-eighths")
    spans = _shared(keys).groupBy("r").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))  # 16 at most

    def variants(batches):
        for batch in batches:
            for r, line, spans in zip(*[batch.column(c).to_pylist() for c in range(3)]):
                gaps = np.unique(np.concatenate([[-1], *[np.arange(s["lo"], s["hi"]) for s in spans]])).astype(np.int64)
                v, w = variant_hashes(line)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v[gaps + 1]), pa.array(w[gaps + 1]), pa.array(gaps.astype(np.int32)), pa.array(np.full(len(gaps), r))],
                    names=["v", "w", "gap", "r"])

    def runs(batches):
        """Sorted by variant, gap and place: the least of a run, for every other row of it."""
        held = None
        for batch in batches:
            own = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(4)]
            if held is not None:
                own = [np.concatenate(x) for x in zip(held, own)]
            if not len(own[0]):
                continue
            cut = int(np.searchsorted(own[0], own[0][-1]))
            held = [c[cut:] for c in own]
            yield from pairs([c[:cut] for c in own])
        if held is not None:
            yield from pairs(held)

    def pairs(own):
        v, w, gap, r = own
        if len(v) < 2:
            return
        new = np.concatenate([[True], (v[1:] != v[:-1]) | (w[1:] != w[:-1])])
        start = np.flatnonzero(new)[np.cumsum(new) - 1]  # of the variant; the line itself stands there with gap -1
        whole = gap[start] < 0
        low = np.where(whole & (gap >= 0), r[start], r)
        least = np.minimum.reduceat(np.where(gap < 0, np.iinfo(np.int64).max, r), np.flatnonzero(new))[np.cumsum(new) - 1]
        low = np.where(gap < 0, np.minimum(least, r), low)
        run = np.concatenate([[True], new[1:] | (gap[1:] != gap[:-1])])
        low = np.minimum(low, r[np.flatnonzero(run)[np.cumsum(run) - 1]])
        out = low < r
        if out.any():
            yield pa.RecordBatch.from_arrays([pa.array(r[out]), pa.array(low[out])], names=["r", "near"])

    n = partitions(able.sparkSession)
    made = able.select("r", "text").join(spans, "r").select("r", "text", "spans").mapInArrow(variants, "v long, w long, gap int, r long")
    least = made.repartition(n, "v").sortWithinPartitions("v", "w", "gap", "r").mapInArrow(runs, "r long, near long")
    least = least.groupBy("r").agg(F.min("near").alias("near"))
    near = able.select(F.col("r").alias("near"), F.col("text").alias("near_text"))
    both = able.join(least, "r").join(near, "near").select("a", "b", "text", "near_text")

    def verify(batches):
        for batch in batches:
            own = [within_one(x, y) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield batch.select([0, 1]).filter(pa.array(own, pa.bool_()))

    return both.mapInArrow(verify, "a long, b long")


def removals(
    docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, near: int | None = None,
) -> DataFrame:
    """``(doc, row, dropped)``: the numbers of the lines that go, for every row with any.

    A line goes when the same line, or one within one edit, stands earlier: in a
    document with a smaller key, or earlier in the same one.  Lines of less than
    ``near`` characters (``NEAR``; ``least`` where that is given) go as exact repeats
    only.  Blank lines stay.  (Chains count: a
    line whose only earlier neighbour goes itself still goes.)  Rows that share a
    key are told apart by ``row``, a hash of the text, and come in its order; those with
    equal texts as well are treated alike.  Null keys come first.
    """
    if near is None:
        near = NEAR if least == LEAST else least
    seen = occurrences(docs, key, text, least, near)
    lines = distinct_lines(seen)
    edited = near_lines(able_lines(docs, lines, key, text))
    goes = F.col("near").isNotNull()
    decided = lines.join(edited.withColumn("near", F.lit(True)), ["a", "b"], "left").select(
        "a", "b", F.col("key").alias("first_key"), F.col("row").alias("first_row"), F.col("line").alias("first_line"), goes.alias("goes"))
    out = seen.select("a", "b", "key", "row", "line").join(decided, ["a", "b"]).filter(
        F.col("goes") | ~F.col("key").eqNullSafe(F.col("first_key")) | (F.col("row") != F.col("first_row"))
        | (F.col("line") != F.col("first_line")))
    return store(out.groupBy(F.col("key").alias("doc"), "row").agg(F.sort_array(F.collect_set("line")).alias("dropped")), "line-removals")


def deduplicate(
    docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, near: int | None = None,
) -> DataFrame:
    """All rows and columns of ``docs`` with the lines that go left out of ``text``; adds ``lines_dropped``.

    A null text stays null, an empty one empty.  A text of which nothing is left
    becomes empty.  A column ``lines_dropped`` of ``docs`` itself makes way for the new one.
    """
    return _cut(docs, key, text, least, near).select(
        *[(F.col("text") if c == text else F.col("own")[c]).alias(c) for c in docs.columns if c != "lines_dropped"],
        F.col("n").alias("lines_dropped"))


def keep(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, near: int | None = None) -> DataFrame:
    """Rows of ``docs`` with their own columns and the lines that go left out; a text that loses its last line with text goes itself.

    A text without a line to lose stays, also when it is null, empty or blank.
    """
    kept = _cut(docs, key, text, least, near).filter((F.col("n") == 0) | F.col("text").rlike(r"(?U)\S"))
    return kept.select(*[(F.col("text") if c == text else F.col("own")[c]).alias(c) for c in docs.columns])


def _cut(docs: DataFrame, key: str, text: str, least: int, near: int | None) -> DataFrame:
    """``(own, text, n)``: a row of ``docs``, what is left of its text, and the number of lines that went."""
    gone = removals(docs, key, text, least, near).hint("merge")  # grows with the corpus
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"), _row(F.col(f"`{text}`")).alias("own_row"))
    both = whole.join(
        gone, F.col("own")[key].cast("long").eqNullSafe(F.col("doc")) & (F.col("own_row") == F.col("row")), "left").select(
        "own", F.col("own")[text].cast("string").alias("text"), "dropped")

    def cut(batches):
        for batch in batches:
            texts, counts = [], []
            for whole, dropped in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                out = frozenset(dropped or ())
                if out and whole is not None:
                    whole = "\n".join(line for n, line in enumerate(whole.split("\n")) if n not in out)
                texts.append(whole)
                counts.append(len(out))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int32())], names=["own", "text", "n"])

    shape = T.StructType([both.schema["own"], T.StructField("text", T.StringType()), T.StructField("n", T.IntegerType())])
    return both.mapInArrow(cut, shape)
