"""Toxic passages by maximum-scoring segments.

Words score the log-odds of toxic against other texts under an informative Dirichlet prior
(the corpus distribution); all other words score a small negative drift.  A linear scan
(Ruzzo and Tompa) finds every maximal segment of a text.  Extreme-value statistics (Karlin
and Altschul) turn a segment's score into the number of segments that good which a clean
text of that length would hold by chance; those below ``SIGNIFICANT`` are toxic passages.
A logistic function of a text's evidence, fitted on the sample, gives its score.

The model is learnt from a sample of labelled texts: all of a class, or about ``SAMPLE`` of
them chosen by a hash of the id.  What stands for the corpus (the prior, the base rate of the
logistic function) weighs each class by the inverse of its share in the sample.  To keep
copies of one text from making its words look toxic, a word is counted once for each pair of neighbours it stands between.  Words of few
such contexts enter with a score that shrinks with their certainty.  All other
rows are only scored; labels, language, source and id never enter a score.

Contract: null text counts as empty and gets the score of a text without evidence.  Null
labels are unlabelled; of repeated labels the largest holds.  Without toxic or clean
labels, the score is the share of toxic labels (0 without any).  Rows that repeat are
scored alike.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.common import SPACES, arrow_strings, blocks, shared_folder, stored
from llm.pretokens import mixed
from llm.words import word_hashes, word_spans

#: Labelled texts of each class that are learnt from, about.
SAMPLE = 20_000
#: Mass of the Dirichlet prior as a share of the words learnt from.
PRIOR = 0.05
#: Standard errors of a word's log-odds: to enter the model, and to enter it with its whole score.
CANDIDATE, CERTAIN = 2.0, 3.0
#: Score of any other word, and the least and the most that a word of the model can score.
DRIFT, LEAST, MOST = -0.5, 2.0, 8.0
#: Chance segments expected in a clean text below which a segment is a toxic passage.
SIGNIFICANT = 0.05
BLOCK = 1 << 20
#: Words end at white space and ASCII punctuation.
BREAKS = SPACES + string.punctuation.encode()


@dataclass(frozen=True)
class Model:
    """Words (ascending hashes) with scores, the constants of the extreme-value law and the logistic weights."""

    words: np.ndarray
    scores: np.ndarray
    decay: float
    scale: float
    weights: tuple[float, float, float]


def held_out(id_column: Column) -> Column:
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def segments(places: list[int], scores: list[float], drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """All maximal scoring segments ``(first, last, score)`` of a text whose words at ``places`` score ``scores``.

    Linear: ``back`` names the last candidate with a smaller left sum, so none is looked at twice.
    """
    first: list[int] = []
    last: list[int] = []
    left: list[float] = []
    right: list[float] = []
    back: list[int] = []
    total, seen = 0.0, 0
    for place, score in zip(places, scores, strict=True):
        low = total + drift * (place - seen)
        total, seen = low + score, place + 1
        start, high = place, total
        j = len(left) - 1
        while True:
            while j >= 0 and left[j] >= low:
                j = back[j]
            if j < 0 or right[j] >= high:
                break
            start, low = first[j], left[j]
            for held in (first, last, left, right, back):
                del held[j:]
            j -= 1
        for held, value in ((first, start), (last, place), (left, low), (right, high), (back, j)):
            held.append(value)
    return [(a, b, r - x) for a, b, x, r in zip(first, last, left, right, strict=True)]


def _tokens(column):
    data, offsets = arrow_strings(column)
    starts, ends, firsts = word_spans(data, offsets, BREAKS)
    return word_hashes(data, starts, ends), starts, ends, firsts, offsets


def _found(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Number of each hash among the sorted words, or -1."""
    if not len(words):
        return np.full(len(hashes), -1)
    place = np.minimum(np.searchsorted(words, hashes), len(words) - 1)
    return np.where(words[place] == hashes, place, -1)


def _learnt(docs: DataFrame, labels: DataFrame, id_column: str, text_column: str, label_column: str, sample: int) -> DataFrame:
    """``text, toxic, weight`` of the sampled labelled rows that are not held out; the weight is how many rows one stands for."""
    known = labels.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{label_column}`").cast("int").alias("toxic"))
    known = known.where(F.col("id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("id"))).groupBy("id").agg(F.max("toxic").alias("toxic"))
    counts = dict(known.groupBy("toxic").count().collect())
    chosen, weight = F.lit(False), F.lit(1.0)
    for label, count in counts.items():
        share = int(min(1.0, sample / count) * (1 << 32))
        chosen = chosen | ((F.col("toxic") == label) & (F.xxhash64("id").bitwiseAND(F.lit((1 << 32) - 1)) < share))
        weight = F.when(F.col("toxic") == label, F.lit((1 << 32) / max(1, share))).otherwise(weight)
    texts = docs.select(F.col(f"`{id_column}`").alias("id"), F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(known.where(chosen).withColumn("weight", weight)), "id").select("text", "toxic", "weight")  # about 2 * sample ids


def _prior(toxic, clean, n_toxic: float, n_clean: float, stands: tuple[float, float]):
    """Pseudo-counts of words: ``PRIOR`` of the words learnt from, dealt by the words' shares of the corpus.

    ``stands``: the texts of the corpus that a sampled clean and a sampled toxic text stand for.
    """
    of_corpus = stands[1] * n_toxic + stands[0] * n_clean
    return (toxic * stands[1] + clean * stands[0]) * (PRIOR * (n_toxic + n_clean) / of_corpus)


def _log_odds(toxic, clean, n_toxic: float, n_clean: float, stands: tuple[float, float]):
    """Log-odds ratio under the prior, and its standard error; works on columns and arrays alike."""
    log, root = (F.log, F.sqrt) if isinstance(toxic, Column) else (np.log, np.sqrt)
    mass = PRIOR * (n_toxic + n_clean)
    prior = _prior(toxic, clean, n_toxic, n_clean, stands)
    one, two = toxic + prior, clean + prior
    ratio = log(one / (n_toxic + mass - one)) - log(two / (n_clean + mass - two))
    return ratio, root(1 / one + 1 / two)


def _candidates(train: DataFrame, stands: tuple[float, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, float]:
    """Hashes of words that lean to toxic texts, with their counts in both classes, and the words of each class."""

    def count(batches):
        for table in blocks(batches, BLOCK):
            hashes, _, _, firsts, _ = _tokens(table.column("text"))
            toxic = np.repeat(table.column("toxic").to_numpy() == 1, np.diff(firsts))
            words, inverse = np.unique(hashes, return_inverse=True)
            both = [np.bincount(inverse[which], minlength=len(words)) for which in (toxic, ~toxic)]
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), *map(pa.array, both)], ["h", "toxic", "clean"])

    counts = train.mapInArrow(count, "h bigint, toxic bigint, clean bigint").groupBy("h").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).persist()
    n_toxic, n_clean = (float(x or 0) for x in counts.agg(F.sum("toxic"), F.sum("clean")).first())
    if not n_toxic or not n_clean:
        counts.unpersist()
        return np.empty(0, np.uint64), np.empty(0), np.empty(0), n_toxic, n_clean
    toxic, clean = F.col("toxic").cast("double"), F.col("clean").cast("double")
    ratio, error = _log_odds(toxic, clean, n_toxic, n_clean, stands)
    rows = counts.where("toxic >= 3").withColumn("z", ratio / error).where(F.col("z") >= CANDIDATE).collect()  # words of the sample
    counts.unpersist()
    rows.sort(key=lambda r: r.h & 0xFFFFFFFFFFFFFFFF)
    hashes = np.array([r.h for r in rows], np.int64).view(np.uint64)
    return hashes, np.array([float(r.toxic) for r in rows]), np.array([float(r.clean) for r in rows]), n_toxic, n_clean


def _contexts(train: DataFrame, words: np.ndarray) -> np.ndarray:
    """For each word, the pairs of neighbours it stands between in toxic and in clean texts."""

    def pairs(batches):
        for table in blocks(batches, BLOCK):
            hashes, _, _, firsts, _ = _tokens(table.column("text"))
            texts = np.repeat(np.arange(table.num_rows), np.diff(firsts))
            number = _found(words, hashes)
            at = np.flatnonzero(number >= 0)
            padded = np.concatenate(([0], hashes, [0])).astype(np.uint64)
            edge = np.concatenate(([-1], texts, [-1]))
            before = np.where(edge[at] == texts[at], padded[at], 0).astype(np.uint64)
            after = np.where(edge[at + 2] == texts[at], padded[at + 2], 0).astype(np.uint64)
            with np.errstate(over="ignore"):
                context = mixed(mixed(before + np.uint64(1)) * np.uint64(3) + after)
            toxic = table.column("toxic").to_numpy()[texts[at]]
            rows = np.unique(np.column_stack((number[at], context.view(np.int64), toxic)), axis=0) if len(at) else np.empty((0, 3), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(rows[:, i].astype(np.int64)) for i in range(3)], ["word", "context", "toxic"])

    found = train.mapInArrow(pairs, "word bigint, context bigint, toxic bigint").distinct().groupBy("word", "toxic").count().collect()
    out = np.zeros((len(words), 2))
    for row in found:  # two a word at most
        out[row.word, 1 - row.toxic] = row["count"]
    return out


def _decay(scores: np.ndarray, chances: np.ndarray) -> float:
    """The positive root of the sum of chance * exp(decay * score) = 1 over the words of clean texts."""
    rest = max(0.0, 1 - chances.sum())
    low, high = 0.0, 1.0

    def excess(x: float) -> float:
        return float((chances * np.exp(x * scores)).sum() + rest * np.exp(x * DRIFT) - 1)

    while excess(high) < 0 and high < 64:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if excess(middle) < 0 else (low, middle)
    return high


def _evidence(model: Model, table: pa.Table):
    """For each text: words, best segment score, evidence of the best and of all significant segments, and these."""
    hashes, starts, ends, firsts, offsets = _tokens(table.column("text"))
    number = _found(model.words, hashes)
    at = np.flatnonzero(number >= 0)
    values = model.scores[number[at]] if len(at) else np.empty(0)
    bounds = np.searchsorted(at, firsts)
    for i in range(table.num_rows):
        size = int(firsts[i + 1] - firsts[i])
        low, high = bounds[i], bounds[i + 1]
        if low == high:
            yield size, 0.0, 0.0, 0.0, []
            continue
        found = segments((at[low:high] - firsts[i]).tolist(), values[low:high].tolist())
        best = max(score for _, _, score in found)
        # -log of the segments that good which chance would put into a clean text of this length
        sure = [(a, b, score, model.decay * score - np.log(model.scale * size)) for a, b, score in found]
        kept = [x for x in sure if x[3] > -np.log(SIGNIFICANT)]
        passages = [(int(starts[firsts[i] + a] - offsets[i]), int(ends[firsts[i] + b] - offsets[i]), float(score), float(np.exp(-e))) for a, b, score, e in kept]
        yield size, best, max(0.0, max(x[3] for x in sure)), float(sum(x[3] for x in kept)), passages


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic", sample: int = SAMPLE) -> Model:
    """Learns words, constants and weights from the labelled rows that are not held out."""
    folder = shared_folder(docs.sparkSession, "toxicity")
    train = stored(_learnt(docs, labels, id_column, text_column, label_column, sample), folder, "train")
    of = {r.toxic: r for r in train.groupBy("toxic").agg(F.count("*").alias("rows"), F.max("weight").alias("weight")).collect()}
    stands = tuple(of[label].weight if label in of else 1.0 for label in (0, 1))
    words, toxic, clean, n_toxic, n_clean = _candidates(train, stands)
    if len(words):
        apart = _contexts(train, words)
        ratio, error = _log_odds(apart[:, 0], apart[:, 1], n_toxic, n_clean, stands)
        sure = ratio / error
        keep = (sure >= CANDIDATE) & (ratio >= LEAST)
        words, toxic, clean = words[keep], toxic[keep], clean[keep]
        ratio = np.minimum(ratio[keep], MOST) * np.minimum(1, sure[keep] / CERTAIN)
    if not len(words):
        held = [of[label].rows * stands[label] if label in of else 0.0 for label in (0, 1)]
        share = held[1] / max(1.0, sum(held))
        base = float(np.log(share / (1 - share))) if 0 < share < 1 else (36.0 if share else -36.0)
        return Model(np.empty(0, np.uint64), np.empty(0), 1.0, 1.0, (base, 0.0, 0.0))
    chances = (clean + _prior(toxic, clean, n_toxic, n_clean, stands)) / (n_clean + PRIOR * (n_toxic + n_clean))
    rough = Model(words, ratio, _decay(ratio, chances), 1.0, (0.0, 0.0, 0.0))

    def gather(model: Model) -> np.ndarray:
        def run(batches):
            for table in blocks(batches, BLOCK):
                rows = [x[:4] for x in _evidence(model, table)]
                columns = [pa.array(x, pa.float64()) for x in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays([table.column("toxic").combine_chunks().cast(pa.float64()), *columns], ["toxic", "size", "best", "one", "all"])

        # five numbers for each text of the sample
        return np.array(train.mapInArrow(run, "toxic double, size double, best double, one double, all double").collect())

    rows = gather(rough)
    rows_clean = rows[(rows[:, 0] == 0) & (rows[:, 1] > 0)]
    scale = len(rows_clean) / max(1e-9, float((rows_clean[:, 1] * np.exp(-rough.decay * rows_clean[:, 2])).sum()))
    model = Model(words, ratio, rough.decay, scale, (0.0, 0.0, 0.0))
    rows = gather(model)
    return Model(words, ratio, rough.decay, scale, _logistic(_shrunk(rows[:, 3:5]), rows[:, 0], np.where(rows[:, 0] == 1, stands[1], stands[0])))


def _shrunk(evidence: np.ndarray) -> np.ndarray:
    return np.log1p(evidence)


def _logistic(x: np.ndarray, y: np.ndarray, stands: np.ndarray, ridge: float = 1e-2) -> tuple[float, float, float]:
    """Weights by Newton steps, rows counted by what they stand for; evidence never counts against toxicity."""
    stands = stands / stands.mean()
    weights = np.zeros(3)
    used = [0, 1, 2]
    while True:
        own = np.column_stack((np.ones(len(x)), x))[:, used]
        w = np.zeros(len(used))
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(own @ w, -30, 30)))
            penalty = ridge * np.r_[0, np.ones(len(w) - 1)]
            slope = own.T @ (stands * (y - p)) - penalty * w
            bend = (own * (stands * p * (1 - p))[:, None]).T @ own + np.diag(penalty + 1e-9)
            step = np.linalg.solve(bend, slope)
            w += step / max(1.0, float(np.abs(step).max()))
            if np.abs(step).max() < 1e-6:
                break
        against = [i for i, value in zip(used[1:], w[1:], strict=True) if value < 0]
        if not against:
            weights[used] = w
            return float(weights[0]), float(weights[1]), float(weights[2])
        used.remove(against[0])


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text", threshold: float = 0.7) -> DataFrame:
    """``id_column, score, predicted, n_words, passages`` of each text.

    A passage has ``start`` and ``end`` (bytes of the UTF-8 text), its score and its expected number by chance.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # words of the sample

    def run(batches):
        model = held.value
        for table in blocks(batches, BLOCK):
            rows = list(_evidence(model, table))
            evidence = _shrunk(np.array([x[2:4] for x in rows]).reshape(-1, 2))
            values = 1 / (1 + np.exp(-np.clip(model.weights[0] + evidence @ np.array(model.weights[1:]), -36, 36)))
            passages = [[dict(zip(("start", "end", "score", "expected"), p, strict=True)) for p in x[4]] for x in rows]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())]))
            columns = [pa.array(values), pa.array((values >= threshold).astype(np.int32)), pa.array([x[0] for x in rows], pa.int64()), pa.array(passages, kind)]
            yield pa.RecordBatch.from_arrays([table.column("id").combine_chunks(), *columns], [id_column, "score", "predicted", "n_words", "passages"])

    source = docs.select(F.col(f"`{id_column}`").alias("id"), F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit("")).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(
        run, f"`{id_column}` {kind}, score double, predicted int, n_words bigint, passages array<struct<start: bigint, end: bigint, score: double, expected: double>>"
    )


def without_toxic(docs: DataFrame, model: Model, text_column: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text is not predicted to be toxic."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        weights = held.value.weights
        for table in blocks(batches, BLOCK, which):
            texts = pa.table({"text": table.column(which)})
            evidence = _shrunk(np.array([x[2:4] for x in _evidence(held.value, texts)]).reshape(-1, 2))
            values = 1 / (1 + np.exp(-np.clip(weights[0] + evidence @ np.array(weights[1:]), -36, 36)))
            yield from table.filter(pa.array(values < threshold)).to_batches()

    which = docs.columns.index(text_column)
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*names)
    return rows.mapInArrow(run, rows.schema).toDF(*docs.columns)
