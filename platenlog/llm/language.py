"""Language identification with a string kernel.

The kernel of two texts is the number of different character n-grams (n from 1 to
``GRAMS``, of the lower-cased text with all but letters as blanks) that both have, over the
root of the product of their own numbers: a blended-spectrum presence kernel. A few
landmark texts give the Nyström features, and one ridge regression per language
(its texts against the rest) is fitted on those. A batch of texts is scored by two matrix products:
presence by landmark presence, and that by the fitted weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from platenlog.plans.session import shared_folder

GRAMS = 3
# The labelled rows learned from: at most so many different texts a language, of which so many are
# landmarks, and at most so many of both in all. Every label with a text is learned; with many
# labels each has fewer texts, one at least.
SAMPLE_TEXTS = 300
LANDMARKS = 32
ALL_TEXTS = 20_000
ALL_LANDMARKS = 512
# More labels than this are joined by a shuffle.
FEW_LABELS = 100_000
RIDGE = 0.01
UNDETERMINED = "und"
# Unknown three-grams a text may have: this many times what all but a fiftieth of its
# language's labelled texts have, and a share more.
UNKNOWN = (2.0, 0.1, 0.98)
HELD_OUT = (4, 2)
ROWS = 256


def grams(text: str) -> np.ndarray:
    """The different n-grams of a whole text, as sorted codes of up to three code points."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.int64)
    # Below 192 only a to z are letters that count.
    points[(points < 97) | ((points > 122) & (points < 192))] = 32
    found = [np.unique(points)]
    code = points
    for n in range(1, GRAMS):
        code = (code[:-1] << 21) | points[n:] if len(points) > n else code[:0]
        found.append(distinct(code))
    return np.concatenate(found)


def distinct(codes: np.ndarray) -> np.ndarray:
    if not len(codes):
        return codes
    codes = np.sort(codes)
    return codes[np.concatenate(([True], codes[1:] != codes[:-1]))]


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass
class Model:
    """What scoring needs; its size is bounded by the landmarks, whatever the corpus."""

    languages: list[str]
    vocabulary: np.ndarray  # sorted codes of the landmarks
    presence: np.ndarray  # vocabulary x landmarks, 0 or 1 over the root of the landmark's number of n-grams
    weights: np.ndarray  # landmarks x languages
    offsets: np.ndarray
    allowed: np.ndarray  # per language, the share of three-grams that no landmark has to be expected at most

    def unknown(self, codes: np.ndarray) -> tuple[int, int]:
        """How many of a text's three-grams no landmark has, and how many there are; of shorter letters if there are none."""
        own = codes[codes >= 1 << 42]
        own = own if len(own) else codes[codes != 32]
        at = np.minimum(np.searchsorted(self.vocabulary, own), len(self.vocabulary) - 1)
        return int((self.vocabulary[at] != own).sum()), len(own)

    def foreign(self, codes: np.ndarray, language: int, sigmas: float) -> bool:
        """More unknown than a labelled text of the language by so many standard deviations of a draw of its length."""
        missing, n = self.unknown(codes)
        share = min(1.0, float(self.allowed[language]))
        return missing > share * n + sigmas * np.sqrt(n * share * (1 - share)) or missing == n

    def kernel(self, texts: list[np.ndarray]) -> np.ndarray:
        rows = np.zeros((len(texts), len(self.vocabulary)), dtype=np.float32)
        for row, codes in zip(rows, texts, strict=True):
            at = np.searchsorted(self.vocabulary, codes)
            at[at == len(self.vocabulary)] = 0
            row[at[self.vocabulary[at] == codes]] = 1 / np.sqrt(len(codes))
        return rows @ self.presence

    def scores(self, texts: list[np.ndarray]) -> np.ndarray:
        return self.kernel(texts) @ self.weights + self.offsets


def fit(
    samples: list[tuple[str, np.ndarray]], landmarks: int = LANDMARKS, ridge: float = RIDGE, all_landmarks: int = ALL_LANDMARKS
) -> Model | None:
    """The model of (language, codes) samples; the first of each language are its landmarks, as far as there is room."""
    own_texts: dict[str, list[np.ndarray]] = {}
    for lang, codes in samples:
        own_texts.setdefault(lang, []).append(codes)
    languages = sorted(own_texts)
    if not languages:
        return None
    landmarks = max(1, min(landmarks, all_landmarks // len(languages)))
    marks = [codes for lang in languages for codes in own_texts[lang][:landmarks]][:all_landmarks]
    vocabulary = distinct(np.concatenate(marks))
    presence = np.zeros((len(vocabulary), len(marks)), dtype=np.float32)
    for k, codes in enumerate(marks):
        presence[np.searchsorted(vocabulary, codes), k] = 1 / np.sqrt(len(codes))
    model = Model(languages, vocabulary, presence, np.eye(len(marks)), np.zeros(len(marks)), np.ones(len(languages)))
    values, vectors = np.linalg.eigh(presence.T.astype(np.float64) @ presence)
    kept = values > 1e-6 * values.max()
    to_features = vectors[:, kept] / np.sqrt(values[kept])
    features = np.vstack([model.kernel([c for _, c in samples[k : k + ROWS]]) for k in range(0, len(samples), ROWS)])
    features = features.astype(np.float64) @ to_features
    number = {lang: k for k, lang in enumerate(languages)}
    own = np.array([number[lang] for lang, _ in samples])
    # Languages weigh the same, however many texts they have.
    weight = len(samples) / (len(languages) * np.bincount(own)[own])
    middle = weight @ features / len(samples)
    centred = features - middle
    weighted = weight[:, None] * centred
    # Targets are 1 for the own language and -1 for all others; less their mean, only the own ones remain,
    # as the weighted features sum to 0.
    summed = np.zeros((len(languages), centred.shape[1]))
    np.add.at(summed, own, weighted)
    solved = np.linalg.solve(centred.T @ weighted + ridge * len(samples) * np.eye(centred.shape[1]), 2 * summed.T)
    model.weights = (to_features @ solved).astype(np.float32)
    model.offsets = 2 / len(languages) - 1 - middle @ solved
    # A landmark is judged by the others: what it alone has counts as unknown.
    alone = vocabulary[(presence > 0).sum(axis=1) == 1]
    factor, more, quantile = UNKNOWN
    for k, lang in enumerate(languages):
        shares = []
        for place, codes in enumerate(own_texts[lang]):
            missing, n = model.unknown(codes)
            if place < landmarks and k * landmarks + place < all_landmarks:
                missing = int(np.isin(codes[codes >= 1 << 42], alone).sum())
            shares.append(missing / max(n, 1))
        model.allowed[k] = factor * np.quantile(shares, quantile) + more
    return model


def remainder(doc_id: str) -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % HELD_OUT[0]


def learn(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample_texts: int = SAMPLE_TEXTS
) -> Model | None:
    """Fit on different texts with a label outside the held-out fold, drawn over all rows by the hash of the text.

    Counts and the choice run over all rows; what comes to the driver is the chosen texts' n-gram codes:
    at most ``sample_texts`` of a language and ``ALL_TEXTS`` of all, but one of each. Copies
    of a text count once, so a label whose rows are nearly all copies is learned from as many texts as it has.
    """
    shared_folder(docs.sparkSession)
    labelled = docs.where((remainder(doc_id) != HELD_OUT[1]) & F.col(lang).isNotNull()).select(
        F.col(lang).cast("string").alias("lang"), F.xxhash64(text).alias("mark"), F.col(text).alias("text")
    )
    labelled = labelled.where(F.col("text").rlike(r"\p{L}"))
    # Different texts count, not rows; copies combine before the shuffle.
    counts = labelled.select("lang", "mark").distinct().groupBy("lang").count().checkpoint()
    labels = counts.count()
    sample_texts = max(1, min(sample_texts, ALL_TEXTS // max(labels, 1)))
    # A stretch of hash values with some four times the texts that are wanted, and a few dozen where that is few.
    share = F.least(F.lit(1.0), F.lit(4.0 * sample_texts + 60) / F.col("count"))
    reach = counts.select("lang", (F.lit(-(2.0**63)) + share * 2.0**64).alias("reach"))
    reach = F.broadcast(reach) if labels <= FEW_LABELS else reach
    near = labelled.join(reach, "lang").where(F.col("mark").cast("double") <= F.col("reach"))
    place = F.row_number().over(W.partitionBy("lang").orderBy("mark"))
    chosen = (
        near.groupBy("lang", "mark")
        .agg(F.first("text").alias("text"))
        .withColumn("place", place)
        .where(F.col("place") <= sample_texts)
        .select("lang", "mark", "text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = pa.array([grams(t.as_py()) for t in batch.column(2)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), codes], ["lang", "mark", "codes"])

    rows = chosen.mapInArrow(run, "lang string, mark bigint, codes array<bigint>").toArrow()
    samples = sorted(
        (lang, mark, k)
        for k, (lang, mark) in enumerate(zip(rows["lang"].to_pylist(), rows["mark"].to_pylist(), strict=True))
    )
    return fit([(lang, np.array(rows["codes"][k].values)) for lang, _, k in samples])


def predicted(model: Model | None, docs: DataFrame, text: Column, sigmas: float | None = None) -> Column:
    """A struct of ``lang_pred`` and ``score`` for a column of texts; with ``sigmas``, foreign ones are ``und``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])

    @F.arrow_udf("lang_pred string, score double")
    def predict(texts: pa.Array) -> pa.Array:
        model = shared.value
        langs, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        batch: list[tuple[int, np.ndarray]] = []

        def score() -> None:
            if batch:
                margins = model.scores([codes for _, codes in batch])
                for (k, codes), best, margin in zip(batch, margins.argmax(axis=1), margins.max(axis=1), strict=True):
                    if sigmas is not None and model.foreign(codes, best, sigmas):
                        continue
                    langs[k], scores[k] = model.languages[best], min(1.0, max(0.0, (float(margin) + 1) / 2))
                batch.clear()

        for k, value in enumerate(texts):
            own = value.as_py()
            if model is not None and has_letter(own):
                batch.append((k, grams(own)))
                if len(batch) == ROWS:
                    score()
        score()
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], fields=list(kind))

    return predict(text)


def identify(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", model: Model | None = None
) -> DataFrame:
    """``doc_id, held_out, lang_pred, score``, one row per row of ``docs``.

    Learns from ``docs`` unless a model is given. ``score`` is the ridge margin of
    the language, from -1 and 1 to 0 and 1. ``und`` with score 0 where the text is
    null or has no letter, or where nothing could be learned. A row without an id
    is in neither fold: it is predicted, not learned from. Repeated rows give
    repeated results; other columns are ignored; an empty table gives no rows.
    """
    model = model or learn(docs, doc_id, text, lang)
    return docs.select(
        F.col(doc_id).cast("bigint").alias("doc_id"),
        F.coalesce(remainder(doc_id) == HELD_OUT[1], F.lit(False)).alias("held_out"),
        predicted(model, docs, F.col(text)).alias("found"),
    ).select("doc_id", "held_out", "found.lang_pred", "found.score")


def accepted(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    least: float = 0.5,
    sigmas: float | None = None,
) -> DataFrame:
    """The rows of ``docs``, all columns, whose text is in a learned language by a score of ``least`` or more.

    Scores sum to one over the languages, so ``least`` tells the languages from each other
    and not from others. With ``sigmas``, texts go that have more three-grams no landmark has than
    labelled texts of the predicted language, short ones being given the chance of their length.
    """
    model = learn(docs, doc_id, text, lang)
    columns = [F.col(f"`{name}`") for name in docs.columns]
    return (
        docs.withColumn("__found", predicted(model, docs, F.col(text), sigmas))
        .where((F.col("__found.lang_pred") != UNDETERMINED) & (F.col("__found.score") >= least))
        .select(*columns)
    )
