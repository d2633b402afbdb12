"""Toxicity by maximum-scoring segments of token log-odds.

Training counts the labelled texts that hold a word, or a word with the same first
letters.  The log-odds between the classes are smoothed by a Dirichlet prior whose
shape is the feature's share of *all* documents; features of significant and clear
log-odds score, every other word costs ``DRIFT``.  A linear scan then finds all maximal segments of a
text, and Karlin-Altschul statistics turn a segment's score into the number of
such segments to expect in a clean text of that length: the decay comes from the
score distribution, the constant from the best segments of clean labelled texts
(extreme-value calibration).  Segments expected fewer than ``EXPECT`` times are
toxic passages.  What they hold together gives the score of the text, calibrated
on the labelled texts.

Labelled rows are a sample of about ``MAX_LABELS`` at most, chosen by a hash;
the prior counts all documents.  Every feature of the labelled texts is counted
and tested; only the significant ones are broadcast, which the sample bounds.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import alnum_words, hidden, shown
from driftline.llm.tokens import Kept

MAX_LABELS = 200_000
MIN_DOCS = 3
PREFIXES = (4, 5, 6)
PRIOR = 10.0  # documents the corpus-shaped part of the prior counts for
FLOOR = 0.5  # and what every feature gets besides
SIGNIFICANT = 4.0  # signed root of the deviance from equal shares in both classes
CLEAR = 1.0  # log-odds, less two standard errors
DRIFT = 0.1
EXPECT = 0.01
KNOWN_WORDS = 300_000
SCORED = "score double, predicted int, passages array<struct<start: int, words: int, expected: double>>"


def features(word: bytes) -> list[bytes]:
    """The word and its first letters, the latter marked by a caret (no word holds one)."""
    letters = word.decode("utf-8")
    return [word, *[b"^" + letters[:n].encode("utf-8") for n in PREFIXES if len(letters) >= n]]


def segments(hits: list[tuple[int, float]], drift: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score) of a text in linear time.

    ``hits`` are the places and scores of words that score; each word between
    two of them costs ``drift``.
    """
    found: list[list] = []  # start, end, total before, total after
    total, last = 0.0, -1
    for place, score in hits:
        total -= drift * (place - last - 1)
        last = place
        part = [place, place + 1, total, total + score]
        total += score
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= part[2]:
                j = found[j][4]
            if j < 0 or found[j][3] >= part[3]:
                part.append(j)
                found.append(part)
                break
            part = [found[j][0], part[1], found[j][2], part[3]]
            del found[j:]
    return [(a, b, after - before) for a, b, before, after, _ in found]


@dataclass
class Model:
    weights: dict[bytes, float] = field(default_factory=dict)
    decay: float = 1.0
    constant: float = 1.0
    fit: tuple[float, float, float] | None = None

    def word_score(self, word: bytes) -> float:
        known = [self.weights[f] for f in features(word) if f in self.weights]
        return max(known, default=0.0)

    def scorer(self) -> Kept:
        return Kept(self.word_score, KNOWN_WORDS)

    def passages(self, text: str | None, scores: Kept) -> tuple[list[tuple[int, int, float]], float, int]:
        """Segments as (start, words, expected number in a clean text), best score, words."""
        words = alnum_words(text)
        values = list(map(scores.__getitem__, words))
        # A word that only repeats the last one that scored adds nothing.
        places = [i for i, v in enumerate(values) if v]
        hits = [(i, values[i]) for i, before in zip(places, [-1, *places], strict=False)
                if before < 0 or words[i] != words[before]]
        made = segments(hits, DRIFT)
        n = max(len(words), 1)
        expected = [(a, b - a, self.constant * n * math.exp(-self.decay * s)) for a, b, s in made]
        return expected, max((s for _, _, s in made), default=0.0), n

    def evidence(self, passages: list[tuple[int, int, float]]) -> tuple[float, float]:
        """Of the least expected passage, and of all significant ones together."""
        sizes = [-math.log(max(e, 1e-300)) for _, _, e in passages if e <= EXPECT]
        return math.log1p(max(sizes, default=0.0)), math.log1p(sum(sizes))

    def score(self, one: float, two: float) -> float:
        if self.fit is None:
            return 0.0
        a, b, c = self.fit
        return 1 / (1 + math.exp(-min(max(a + b * one + c * two, -50), 50)))


def training_rows(docs: DataFrame, labels: DataFrame, key: str = "doc_id", limit: int = MAX_LABELS) -> DataFrame:
    """``docs`` with a column ``_label``: 0 or 1 for chosen labelled rows, else NULL.

    Rows whose crc32 of the key as text is a multiple of 5 are held out.  A key
    labelled twice counts as toxic if either says so.
    """
    own = labels.select(F.col(key).alias("_key"), F.col("toxic").cast("int").alias("_label")).where(
        F.col("_key").isNotNull() & F.col("_label").isNotNull() & ~held_out(F.col("_key")))
    own = own.groupBy("_key").agg(F.max("_label").alias("_label"))
    share = limit / max(own.count(), 1)
    if share < 1:
        own = own.where(F.pmod(F.xxhash64("_key"), F.lit(1 << 30)) < int(share * (1 << 30)))
    return docs.join(F.broadcast(own), docs[key] == F.col("_key"), "left").drop("_key")  # about ``limit`` rows


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % 5 == 0, F.lit(False))


def _candidates(rows: DataFrame) -> list[bytes]:
    """The features in at least ``MIN_DOCS`` toxic texts whose deviance is significant."""
    labelled = rows.where(F.col("_label").isNotNull())
    texts = {r["_label"]: r["count"] for r in labelled.groupBy("_label").count().collect()}
    if not texts.get(1):
        return []

    def seen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of_word = Kept(features, KNOWN_WORDS)

        def made(counts: tuple[Counter, Counter]) -> pd.DataFrame:
            held = list(counts[0].keys() | counts[1].keys())
            return pd.DataFrame({
                "feature": pd.Series(held, dtype=object),
                "clean": np.array([counts[0][f] for f in held], dtype=np.int64),
                "toxic": np.array([counts[1][f] for f in held], dtype=np.int64)})

        counts = Counter(), Counter()
        for batch in batches:
            for label, text in zip(batch["_label"].astype(int), batch["_text"], strict=True):
                counts[label].update({f for own in map(of_word.__getitem__, set(alnum_words(text))) for f in own})
            if len(counts[0]) + len(counts[1]) > KNOWN_WORDS:
                yield made(counts)
                counts = Counter(), Counter()
        yield made(counts)

    counted = (
        labelled.select("_text", "_label").mapInPandas(seen, "feature binary, clean long, toxic long")
        .groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        .where(F.col("toxic") >= MIN_DOCS)
    )
    toxic, both, share = F.col("toxic"), F.col("toxic") + F.col("clean"), texts[1] / sum(texts.values())
    part = lambda held, wanted: F.when(held > 0, held * F.log(held / wanted)).otherwise(0.0)
    size = 2 * part(toxic, both * share)
    if share < 1:
        size = size + 2 * part(F.col("clean"), both * (1 - share))
    # With some room for rounding; train() decides.
    kept = counted.where((toxic > both * share) & (size > SIGNIFICANT**2 - 1e-6)).select("feature")
    return sorted(bytes(r.feature) for r in kept.collect())


def _counted(rows: DataFrame, wanted: list[bytes]) -> tuple[np.ndarray, np.ndarray, float]:
    """For toxic, clean and all texts: their number, how many hold each wanted feature, and
    the number of words in clean ones."""
    places = rows.sparkSession.sparkContext.broadcast({f: i for i, f in enumerate(wanted)})
    size = len(wanted)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place = places.value
        sums, clean_words = np.zeros((3, size + 2), dtype=np.int64), 0
        of_word = Kept(lambda w: [place[f] for f in features(w) if f in place], KNOWN_WORDS)
        for batch in batches:
            label = batch["_label"].to_numpy(dtype=float, na_value=np.nan)
            for kind, text in zip(np.where(np.isnan(label), 2, 1 - label).astype(int), batch["_text"], strict=True):
                words = alnum_words(text)
                held = {f for own in map(of_word.__getitem__, set(words)) for f in own}
                sums[kind, list(held)] += 1
                sums[kind, size] += 1
                clean_words += len(words) if kind == 1 else 0
        sums[2] += sums[0] + sums[1]
        sums[2, size + 1] = clean_words
        some = np.flatnonzero(sums[2])
        yield pd.DataFrame({"at": some, "toxic": sums[0, some], "clean": sums[1, some], "every": sums[2, some]})

    summed = rows.select("_text", "_label").mapInPandas(count, "at long, toxic long, clean long, every long").groupBy(
        "at").agg(*[F.sum(c).alias(c) for c in ("toxic", "clean", "every")])
    counts = np.zeros((3, size + 2), dtype=np.float64)
    for r in summed.collect():  # one row a feature
        counts[:, r["at"]] = r["toxic"], r["clean"], r["every"]
    return counts[:, size], counts[:, :size], counts[2, size + 1]


def _log_odds(docs: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of toxic against clean texts to hold a feature, and their standard errors."""
    prior = PRIOR * counts[2] / max(docs[2], 1) + FLOOR
    toxic, clean = counts[0] + prior, counts[1] + prior
    rest_toxic, rest_clean = (docs[i] + PRIOR + 2 * FLOOR - x for i, x in enumerate((toxic, clean)))
    odds = np.log(toxic / np.maximum(rest_toxic, FLOOR)) - np.log(clean / np.maximum(rest_clean, FLOOR))
    return odds, np.sqrt(1 / toxic + 1 / clean)


def _deviance(docs: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Signed root of the deviance of a feature's texts from the classes' own shares."""
    both, share = counts[0] + counts[1], docs[0] / max(docs[0] + docs[1], 1)
    part = lambda seen, wanted: np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-9) / np.maximum(wanted, 1e-9)), 0)
    size = 2 * (part(counts[0], both * share) + part(counts[1], both * (1 - share)))
    return np.sign(counts[0] - both * share) * np.sqrt(np.maximum(size, 0))


def _decay(scores: np.ndarray, shares: np.ndarray) -> float:
    """The positive root of the moment equation of a clean word's score."""
    rest = max(1 - shares.sum(), 1e-9)
    moment = lambda x: float((shares * np.exp(np.minimum(x * scores, 700))).sum()) + rest * math.exp(-x * DRIFT) - 1
    high = 1e-3
    while moment(high) < 0 and high < 100:
        high *= 2
    low = high / 2 if high > 1e-3 else 1e-9
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if moment(middle) < 0 else (low, middle)
    return high


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Ridge logistic regression by Newton steps; slopes are kept from going negative."""
    design = np.column_stack([np.ones(len(x)), x])
    beta, ridge = np.zeros(3), np.diag([1e-6, 0.1, 0.1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -40, 40)))
        grad = design.T @ (p - y) + ridge @ beta
        step = np.linalg.solve((design * (p * (1 - p) + 1e-9)[:, None]).T @ design + ridge, grad)
        beta -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(b) for b in (beta[0], max(beta[1], 0.0), max(beta[2], 0.0)))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text_col: str = "text") -> Model:
    """A model from the labelled rows of ``docs``; one that calls nothing toxic without such rows."""
    rows = training_rows(docs.select(F.col(key).alias(key), F.col(text_col).alias("_text")), labels, key)
    wanted = _candidates(rows)
    model = Model()
    if not wanted:
        return model
    numbers, counts, clean_words = _counted(rows, wanted)
    odds, error = _log_odds(numbers, counts)
    shares = (counts[1] + FLOOR) / (clean_words + 1)
    kept = np.flatnonzero((_deviance(numbers, counts) > SIGNIFICANT) & (odds - 2 * error > CLEAR))
    model.weights = {wanted[i]: float(odds[i] - error[i]) for i in kept}
    whole = [i for i in kept if not wanted[i].startswith(b"^")]
    model.decay = _decay(odds[whole] - error[whole], shares[whole]) if whole else 1.0
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scores = shared.value.scorer()
        for batch in batches:
            made = [shared.value.passages(t, scores)[1:] for t in batch["_text"]]
            yield pd.DataFrame({"label": batch["_label"].astype("int32"), "best": [float(b) for b, _ in made],
                                "n": [n for _, n in made]})

    # What one row a labelled text holds, in classes, so that its size stays small.
    tail = F.col("n") * F.exp(-F.col("best") * model.decay)
    best = (
        rows.where(F.col("_label").isNotNull()).mapInPandas(measured, "label int, best double, n long")
    )
    clean, spread = best.where(F.col("label") == 0).agg(F.count(F.lit(1)), F.sum(tail)).first()
    model.constant = clean / spread if spread else 1.0
    sized = docs.sparkSession.sparkContext.broadcast(model)

    def weighed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scores = sized.value.scorer()
        for batch in batches:
            seen = [sized.value.evidence(sized.value.passages(t, scores)[0]) for t in batch["_text"]]
            yield pd.DataFrame({"label": batch["_label"].astype("int32"), "one": [s[0] for s in seen],
                                "two": [s[1] for s in seen]})

    seen = rows.where(F.col("_label").isNotNull()).mapInPandas(weighed, "label int, one double, two double")
    fitted = seen.toPandas()  # about MAX_LABELS rows of three numbers
    if fitted["label"].nunique() == 2:
        model.fit = _logistic(fitted[["one", "two"]].to_numpy(), fitted["label"].to_numpy(float))
    return model


def scored(docs: DataFrame, model: Model, text_col: str = "text", name: str = "toxicity") -> DataFrame:
    """Add a struct ``toxicity`` to every row: ``score``, ``predicted`` and the toxic ``passages``.

    NULL and empty texts have no passage and get the score of such texts.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(SCORED)
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own, scores = shared.value, shared.value.scorer()
        for texts in batches:
            found = [[p for p in own.passages(t, scores)[0] if p[2] <= EXPECT] for t in texts]
            values = [own.score(*own.evidence(p)) for p in found]
            yield pd.DataFrame({
                "score": pd.Series(values, dtype=float),
                "predicted": pd.Series([int(v >= 0.5) for v in values], dtype="int32"),
                "passages": pd.Series(
                    [[{"start": a, "words": n, "expected": e} for a, n, e in p] for p in found], dtype=object)})

    return docs.withColumn(name, judge(F.col(text_col)))


def without_toxic(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` not predicted toxic, as they are."""
    model = train(docs, labels, key, text_col)
    judged = scored(docs.select(*hidden(docs), F.col(text_col).alias("_text")), model, "_text", "_toxicity")
    return judged.where(F.col("_toxicity.predicted") == 0).select(*shown(docs))
