"""Languages of words and documents by a linear-chain conditional random field (operator 1).

A word's features are its letter n-grams with word boundaries (so prefixes and
suffixes are among them) and, where it is frequent in the sample, the word
itself.  Label transitions are learned too.  Forward-backward over a document's
words gives the probability of each language for each word; the document gets
the language with the largest share of letters.

Forward-backward runs over all documents of a batch at once: chains are cut to
blocks, each block's transfer matrix is built alongside all others, messages
pass from block to block, and the blocks are then filled in together.  This is
the exact recursion, in another order.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Callable
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import slices, text_slices
from .tokens import forget

UNKNOWN = "und"
WORD = re.compile(r"[^\W\d_]+")
RUNS = T.ArrayType(T.StructType([
    T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("lang", T.StringType()),
    T.StructField("words", T.LongType()), T.StructField("letters", T.LongType()), T.StructField("probability", T.DoubleType())]))
CUT = re.compile(f"({WORD.pattern})")
BUCKETS = 1 << 16
BLOCK = 64
GRAMS = (2, 3, 4)
PART = 100_000  # words that a recursion holds at a time in training
SLICE = 512 << 10  # bytes of text whose words are labelled at a time


# ------------------------------------------------------------------ features


def word_features(words: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all words in a row, and each word's first place.

    N-grams are hashed to ``BUCKETS`` numbers; lexicon words follow these.
    """
    flat = "".join(f"^{w}$" for w in words)
    codes = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    ends = np.cumsum(lengths)
    word = np.repeat(np.arange(len(words)), lengths)
    place = np.arange(len(codes))
    left = np.repeat(ends, lengths) - place  # letters from here to the word's end
    numbers, owners = [], []  # 32-bit, as a sample has millions
    for n in GRAMS:
        at = np.flatnonzero(left >= n)
        h = np.full(len(at), n, np.uint64)
        for k in range(n):
            h = (h ^ codes[at + k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        numbers.append(((h >> np.uint64(40)) % np.uint64(BUCKETS)).astype(np.int32))
        owners.append(word[at].astype(np.int32))
    listed = np.fromiter((lexicon.get(w, -1) for w in words), np.int64, len(words))
    known = np.flatnonzero(listed >= 0)
    numbers.append((BUCKETS + listed[known]).astype(np.int32))
    owners.append(known.astype(np.int32))
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    count = np.bincount(owner, minlength=len(words))
    return np.concatenate(numbers)[order], np.cumsum(count) - count


# ---------------------------------------------------------- forward-backward


class Chains:
    """Documents' words as blocks of ``BLOCK`` places, for recursions over all of them at once."""

    def __init__(self, sizes: np.ndarray):
        sizes = np.asarray(sizes, np.int64)
        per = -(-sizes // BLOCK)
        self.blocks = int(per.sum())
        first = np.cumsum(per) - per
        start = np.cumsum(sizes) - sizes
        doc = np.repeat(np.arange(len(sizes)), sizes)
        at = np.arange(int(sizes.sum())) - start[doc]
        self.row, self.column = first[doc] + at // BLOCK, at % BLOCK
        self.mask = np.zeros((BLOCK, self.blocks), bool)
        self.mask[self.column, self.row] = True
        # Documents with at least k + 1 blocks, and their k-th blocks.
        order = np.argsort(-per, kind="stable")
        self.steps = [first[order[:m]] + k for k in range(int(per.max(initial=0)))
                      if (m := int((per > k).sum()))]
        self.per, self.first = per, first

    def place(self, values: np.ndarray) -> np.ndarray:
        out = np.ones((BLOCK, self.blocks, values.shape[1]))
        out[self.column, self.row] = values
        return out

    def marginals(self, emission: np.ndarray, transition: np.ndarray, start: np.ndarray, pairs: bool = False):
        """Probabilities per word; with ``pairs`` also expected transitions between words, states before the first, log likelihood."""
        top = emission.max(axis=1, keepdims=True)
        e = self.place(np.exp(emission - top))
        mask, n = self.mask[:, :, None], emission.shape[1]
        whole = np.broadcast_to(np.eye(n), (self.blocks, n, n)).copy()
        for t in range(BLOCK):
            step = (whole @ transition) * e[t][:, None, :]
            step /= step.max(axis=(1, 2), keepdims=True)
            whole = np.where(mask[t][:, :, None], step, whole)
        into, back = np.ones((self.blocks, n)), np.ones((self.blocks, n))
        for k, rows in enumerate(self.steps):
            if k == 0:
                into[rows] = start
            else:
                v = np.einsum("bi,bij->bj", into[rows - 1], whole[rows - 1])
                into[rows] = v / v.sum(axis=1, keepdims=True)
        for rows in reversed(self.steps[1:]):
            v = np.einsum("bij,bj->bi", whole[rows], back[rows])
            back[rows - 1] = v / v.sum(axis=1, keepdims=True)
        alpha, beta = np.empty_like(e), np.empty_like(e)
        a, scale = into, np.ones((BLOCK, self.blocks))
        for t in range(BLOCK):
            step = (a @ transition) * e[t]
            total = step.sum(axis=1, keepdims=True)
            a = np.where(mask[t], step / total, a)
            scale[t] = np.where(self.mask[t], total[:, 0], 1.0)
            alpha[t] = a
        b = back
        for t in range(BLOCK - 1, -1, -1):
            beta[t] = b
            step = (b * e[t]) @ transition.T
            b = np.where(mask[t], step / step.sum(axis=1, keepdims=True), b)
        both = alpha * beta
        both /= both.sum(axis=2, keepdims=True)
        out = both[self.column, self.row]
        if not pairs:
            return out
        # Expected moves are sums of products before x transition x ahead, each place scaled to one.
        before, ahead = np.concatenate([into[None], alpha[:-1]]), e * beta
        ahead /= ((before @ transition) * ahead).sum(axis=2, keepdims=True)
        heads = self.first[self.per > 0]
        opening = before[0, heads] * (ahead[0, heads] @ transition.T)  # from the state before the first word
        inner = self.mask.copy()
        inner[0, heads] = False
        moves = transition * (before[inner].T @ ahead[inner])
        likelihood = float(np.log(scale[self.mask]).sum() + top.sum())
        return out, moves, opening.sum(axis=0), likelihood


# -------------------------------------------------------------------- labels


def _spans(text: str) -> tuple[list[str], np.ndarray]:
    """Lower-cased words of a text, and their spans in the text as it is."""
    low = text.lower()
    parts = CUT.split(low)  # gaps and words in turn
    words, ends = parts[1::2], np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
    spans = np.stack([ends[:-1:2], ends[1::2]], axis=1)
    if len(low) != len(text):  # some letters become two when lower-cased
        origin = np.repeat(np.arange(len(text)), [len(c.lower()) for c in text])
        spans = np.stack([origin[spans[:, 0]], origin[spans[:, 1] - 1] + 1], axis=1)
    return words, spans


class Model:
    """Languages, feature weights, transitions; small enough to ship with a task."""

    def __init__(self, languages: list[str], lexicon: dict[str, int], weights, transition, start):
        self.languages, self.lexicon = languages, lexicon
        self.weights, self.transition, self.start = weights.astype(np.float32), transition, start

    def emissions(self, words: list[str]) -> np.ndarray:
        numbers, first = word_features(words, self.lexicon)
        return np.add.reduceat(self.weights[numbers], first, axis=0) if len(words) else np.zeros((0, len(self.languages)))

    def words(self, documents: list[list[str]]) -> np.ndarray:
        """Language probabilities of every word of every document, in a row."""
        flat = [w for d in documents for w in d]
        if not flat:
            return np.zeros((0, len(self.languages)))
        codes, distinct = pd.factorize(np.array(flat, dtype=object))
        e = self.emissions(list(distinct))[codes].astype(np.float64)
        return Chains([len(d) for d in documents]).marginals(e, self.transition, self.start)

    def documents(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, its share of letters, and the number of words, per text."""
        split = [WORD.findall(t.lower()) for t in texts]
        sizes = np.array([len(d) for d in split], np.int64)
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), sizes
        return (*self._digest(self.words(split), split, sizes), sizes)

    def _digest(self, p: np.ndarray, split: list[list[str]], sizes: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and its share of letters per document, from all words' probabilities; of equal shares the first language's."""
        letters = np.fromiter(map(len, chain.from_iterable(split)), np.float64, len(p))
        ends = np.cumsum(np.concatenate([np.zeros((1, p.shape[1])), p * letters[:, None]]), axis=0)
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        mass = ends[bounds[1:]] - ends[bounds[:-1]]
        total = mass.sum(axis=1)
        best = mass.argmax(axis=1)
        score = np.where(total > 0, mass[np.arange(len(sizes)), best] / np.maximum(total, 1e-300), 0.0)
        names = [self.languages[b] if t > 0 else UNKNOWN for b, t in zip(best, total)]
        return names, np.clip(score, 0, 1)

    def runs(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, pa.Array]:
        """As ``documents``, and each text's runs of consecutive words whose likeliest language is the same.

        A run's span is in code points of the text as it is, from its first word's
        start to its last word's end; its probability is the mean of its words',
        weighted by letters.
        """
        found = [_spans(t) for t in texts]
        split = [words for words, _ in found]
        sizes = np.array([len(d) for d in split], np.int64)
        n = int(sizes.sum())
        if not self.languages:
            names, score, p = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros((n, 0))
            best, sure = np.zeros(n, np.int64), np.zeros(n)
        else:
            p = self.words(split)
            names, score = self._digest(p, split, sizes)
            best = p.argmax(axis=1)
            sure = p[np.arange(n), best]
        home = np.repeat(np.arange(len(texts)), sizes)
        spans = np.concatenate([np.zeros((0, 2), np.int64), *(own for _, own in found)])
        letters = spans[:, 1] - spans[:, 0]
        change = np.ones(n, bool)
        change[1:] = (best[1:] != best[:-1]) | (home[1:] != home[:-1])
        first = np.flatnonzero(change)
        last = np.append(first[1:], n) - 1 if n else first

        def total(x):
            return np.add.reduceat(x, first) if n else x

        held = total(letters)
        label = [self.languages[b] if self.languages else UNKNOWN for b in best[first]]
        runs = pa.StructArray.from_arrays(
            [pa.array(spans[first, 0]), pa.array(spans[last, 1]), pa.array(label, pa.string()), pa.array(last - first + 1),
             pa.array(held), pa.array(np.clip(total(sure * letters) / np.maximum(held, 1), 0, 1))],
            ["start", "end", "lang", "words", "letters", "probability"])
        per = np.bincount(home[first], minlength=len(texts))
        return names, score, sizes, pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(per)), pa.int32()), runs)


# ------------------------------------------------------------------ training


def train(
    texts: list[str], labels: list[str], lexicon_size: int = 4000, rounds: int = 30, penalty: float = 1e-6, rate: float = 0.3
) -> Model:
    """Maximum likelihood from documents that carry one label each.

    First every word bears its document's label.  The model then relabels the
    words, leaning to the document's label, so that passages in another language
    get their own; a second run learns from these, switches included.
    """
    languages = sorted(set(labels))
    numbered, parts, sizes, homes = {}, [], [], []
    for text, label in zip(texts, labels):  # words become numbers text by text, so that only distinct ones are held
        words = WORD.findall(text.lower())
        if words:
            parts.append(np.fromiter((numbered.setdefault(w, len(numbered)) for w in words), np.int32, len(words)))
            sizes.append(len(words)), homes.append(languages.index(label))
    k = len(languages)
    if not parts or not k:
        return Model([], {}, np.zeros((BUCKETS, 0)), np.zeros((0, 0)), np.zeros(0))
    codes, distinct, sizes = np.concatenate(parts), list(numbered), np.array(sizes, np.int64)
    del numbered, parts
    frequent = np.argsort(-np.bincount(codes), kind="stable")[:lexicon_size]
    lexicon = {distinct[w]: i for i, w in enumerate(sorted(frequent.tolist()))}
    numbers, first = word_features(distinct, lexicon)
    by = np.argsort(numbers, kind="stable").astype(np.int32)
    used, cuts = np.unique(numbers[by], return_index=True)
    owner = np.repeat(np.arange(len(distinct), dtype=np.int32), np.diff(np.append(first, len(numbers))))[by]
    # Recursions run over slices of documents, so that only one slice's places are held at a time.
    ends = np.cumsum(sizes)
    parts = [(int(ends[lo] - sizes[lo]), int(ends[hi - 1]), Chains(sizes[lo:hi])) for lo, hi in slices(sizes.tolist(), PART)]
    home = np.repeat(np.array(homes, np.int16), sizes)
    state = home.copy()
    w = np.zeros((BUCKETS + len(lexicon), k))
    t, s = np.full((k, k), -2.0) + 2.0 * np.eye(k), np.zeros(k)
    speed = [np.full_like(x, 1e-8) for x in (w[used], t, s)]
    starts = ends - sizes
    inner = np.ones(len(codes), bool)
    inner[starts] = False

    def soft(x, axis=-1):
        y = np.exp(x - x.max(axis=axis, keepdims=True))
        return y / y.sum(axis=axis, keepdims=True)

    def emissions():
        return np.stack([np.add.reduceat(np.ascontiguousarray(w[:, j])[numbers], first) for j in range(k)], axis=1)

    for turn in range(rounds):
        by_word = emissions()
        if turn == rounds // 2:
            gentle = np.exp(np.full((k, k), -3.0) + 3.0 * np.eye(k))
            for lo, hi, chains in parts:
                e = by_word[codes[lo:hi]]
                e[np.arange(hi - lo), home[lo:hi]] += 0.5
                state[lo:hi] = chains.marginals(e, gentle, np.ones(k) / k).argmax(axis=1)
            speed = [np.full_like(v, 1e-8) for v in speed]
        per_word, moves, opening = np.zeros((len(distinct), k)), np.zeros((k, k)), np.zeros(k)
        for lo, hi, chains in parts:
            gap, more, heads, _ = chains.marginals(by_word[codes[lo:hi]], np.exp(t - t.max()), soft(s), pairs=True)
            gap *= -1
            gap[np.arange(hi - lo), state[lo:hi]] += 1
            for j in range(k):
                per_word[:, j] += np.bincount(codes[lo:hi], gap[:, j], minlength=len(distinct))
            moves += more
            opening += heads
        grad_w = np.stack([np.add.reduceat(np.ascontiguousarray(per_word[:, j])[owner], cuts) for j in range(k)], axis=1)
        grad_w = grad_w / len(codes) - penalty * w[used]
        switches = state[:-1][inner[1:]].astype(np.int64) * k + state[1:][inner[1:]]
        seen = np.bincount(switches, minlength=k * k).reshape(k, k)
        grad_t = (seen - moves) / len(codes) - 1e-4 * t
        grad_s = (np.bincount(state[starts], minlength=k) - opening) / len(starts)
        for x, g, v in zip((w, t, s), (grad_w, grad_t, grad_s), speed):  # steps by each weight's own history
            v += g * g
            if x is w:
                x[used] += rate * g / np.sqrt(v)
            else:
                x += rate * g / np.sqrt(v)
    return Model(languages, lexicon, w, np.exp(t - t.max()), soft(s))


def learnable(docs: DataFrame, key: str = "doc_id", label: str = "lang") -> DataFrame:
    """Rows that may be learned from: labelled, and not held out."""
    return docs.filter(~held_out(key) & F.col(label).isNotNull())


def held_out(key: str = "doc_id"):
    """True for the quarter of the keys kept for testing; null keys are not held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(
    docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", sample_rows: int = 350,
    sample_characters: int = 4_000_000, most_labels: int = 1000, **how,
) -> Model:
    """Fit on a bounded sample: up to ``sample_rows`` rows per label, whole texts, at most ``sample_characters`` of each label's.

    The rows with the smallest hashes of key and text are taken, so the sample is
    the same in every run; rows alike in both are drawn once.  Texts that would
    exceed the bound on characters are left out.  The choice is made on hashes and
    lengths; only the texts chosen are gathered.  More than ``most_labels`` labels
    raise, as a model has weights for each.
    """
    rows = learnable(docs, key, label).select(
        F.col(label).cast("string").alias("label"), F.col(text).cast("string").alias("text"),
        F.xxhash64(F.col(key), F.col(text), F.lit(11)).alias("draw"))
    counts = rows.groupBy("label").agg(F.approx_count_distinct("draw", 0.05).alias("n")).limit(most_labels + 1).collect()
    if len(counts) > most_labels:
        raise ValueError(f"more than {most_labels} labels to learn")
    # About twice the rows wanted pass; a label with fewer passes whole.
    passing, span = F.lit(False), 1 << 40
    for r in counts:
        share = int(span * min(1.0, 2.0 * sample_rows / max(1, r["n"])))
        passing = passing | ((F.col("label") == r["label"]) & (F.pmod("draw", F.lit(span)) < share))
    passed = rows.filter(passing & (F.length("text") <= sample_characters))
    order = Window.partitionBy("label").orderBy(F.pmod("draw", F.lit(span)), "draw")
    sizes = passed.groupBy("label", "draw").agg(F.max(F.length("text")).alias("size")).withColumn(
        "place", F.row_number().over(order)).filter(F.col("place") <= 2 * sample_rows).collect()
    chosen, held, number = [], {}, {}
    for r in sorted(sizes, key=lambda r: (r["label"], r["place"])):
        name = r["label"]
        if number.get(name, 0) < sample_rows and held.get(name, 0) + r["size"] <= sample_characters:
            chosen.append(r["draw"])
            held[name], number[name] = held.get(name, 0) + r["size"], number.get(name, 0) + 1
    taken = passed.filter(F.col("draw").isin(chosen)).groupBy("label", "draw").agg(F.max("text").alias("text"))

    def learn(batches):
        forget()  # what earlier tasks of this worker have kept
        got = sorted((r["label"], r["draw"], r["text"]) for batch in batches for r in batch.to_pylist())
        model = train([t for _, _, t in got], [name for name, _, _ in got], **how)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)])], names=["model"])

    # The sample is bounded, so one task learns from it, and only the model reaches the driver.
    found = taken.repartition(1).mapInArrow(learn, "model binary").first()
    return pickle.loads(found["model"]) if found else train([], [])


def identify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, lang_pred, score, n_words)`` for every row, from its whole text alone.

    ``score`` is the language's share of the text's letters; of languages with equal
    shares the first by name is taken.  A text that is null or has no letter is
    ``und`` with score 0; so is every text when there was nothing to learn from.
    Repeated rows come back repeated; other columns are not read.
    """
    return _labelled(docs, model, key, text, Model.documents)


def label_runs(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``identify``'s columns and ``runs``: every row's words, labelled by language and joined to runs of one language.

    A run is ``(start, end, lang, words, letters, probability)``, in the order of the
    text; ``start`` and ``end`` are code points of the whole text.  A text that is null
    or has no letter has no runs; with nothing to learn from all words are one run
    of ``und`` with probability 0.  Ties between languages go to the first by name.
    """
    return _labelled(docs, model, key, text, Model.runs, RUNS)


def _labelled(docs: DataFrame, model: Model, key: str, text: str, how: Callable, runs: T.DataType | None = None) -> DataFrame:
    shape = T.StructType([
        docs.schema[key], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
        T.StructField("n_words", T.LongType())])
    if runs:
        shape = shape.add("runs", runs)
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # bounded: buckets and lexicon times languages

    def run(batches):
        own = shipped.value
        for part, texts in text_slices(batches, text, SLICE):
            found = how(own, texts)
            types = [pa.string(), pa.float64(), pa.int64()]
            columns = [pa.array(c, t) for c, t in zip(found, types)] + list(found[len(types):])
            yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=shape.names)

    return docs.select(key, F.col(text).cast("string").alias(text)).mapInArrow(run, shape)


def keep(
    docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", least: float = 0.5, **how,
) -> DataFrame:
    """The rows of ``docs`` in which one language holds at least ``least`` of the letters, with that language as ``label``.

    Other columns stay as they are.  Texts without letters go.  Where nothing can be
    learned, as no row has a label, the rest stays as it is.
    """
    model = fit(docs, key, text, label, **how)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"), F.col(f"`{text}`").alias("text"))
    if not model.languages:
        return whole.filter(F.col("text").rlike(r"\p{L}")).select("own.*")
    found = identify(whole, model, "own", "text")
    named = [F.col("lang_pred").cast(docs.schema[c].dataType).alias(c) if c == label else F.col(f"own.`{c}`") for c in docs.columns]
    return found.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select(*named)
