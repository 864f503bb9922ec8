"""Toxicity scores by gradient-boosted trees over dense features of the text.

Features are densities of lexicon words (learned ones and a fixed list), how many
of them stand near a second-person pronoun, and rates of capitals, punctuation,
obfuscated and stretched words.  The lexicon is learned from labelled documents:
words, and beginnings of words, that toxic ones hold far more often.  Trees are
trained on three quarters of the labelled sample, and an isotonic regression on
the last quarter turns their margin into a probability.

Labels, language, source and ids are never inputs of a score.
"""

import math
import re
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clicktide.llm.cache import hold
from clicktide.llm.common import documents, materialize

# Insults of everyday English, and pronouns of address.
INSULTS = (
    "bastard bitch clown coward creep cretin damn disgusting dumb dumbass fool freak garbage hate idiot idiotic imbecile "
    "jerk kill liar loser lunatic moron moronic nasty pathetic pig scum shit shut stupid sucker swine trash ugly useless "
    "vermin vile worthless wretch"
).split()
ADDRESS = "you your yours yourself u ur tu te ton ta tes toi vous votre vos du dich dir dein deine ihr euch sie tú ti tuyo usted ustedes vosotros".split()

BEGINNINGS = (4, 5, 6)
LEAST_TOXIC = 2  # documents that a lexicon entry needs
LEAST_RATIO = 5.0  # times as frequent in toxic documents
ENTRIES = 4000
NEAR = 5  # words around a pronoun
_STRONG = 3.0  # log-odds that count as a hit
_KEPT = 1 << 17

_ENDS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~¡¿«»“”„’…–—"
_LEET = str.maketrans("013457@$€!|", "oieastaseil")
_STRETCHED = re.compile(r"(.)\1\1")
_SYMBOL_INSIDE = re.compile(r"\w[*@$€!|#.+_-]+\w|[a-zA-Z]\d|\d[a-zA-Z]")
_ADDRESS, _CAPITALS, _HIDDEN, _LONG, _FIXED, _WORD = (1 << b for b in range(16, 22))
_INDEX = (1 << 16) - 1

FEATURES = (
    "words", "learned_density", "learned_hits", "learned_entries", "best_odds", "best_three_odds", "mean_odds",
    "fixed_density", "fixed_hits", "hits_near_address", "address_density", "capitals", "capital_words", "punctuation",
    "exclamations", "questions", "hidden_density", "hidden_hits", "stretched_density", "digits",
)


def plain_word(raw: str) -> str:
    """A word without the marks around it, in lower case."""
    return raw.strip(_ENDS).lower()


def revealed(word: str) -> str:
    """A word with look-alike signs read as letters and other marks removed."""
    return re.sub(r"[^\w]|_", "", word.translate(_LEET))


def word_forms(raw: str) -> list[str]:
    """The lexicon keys of a word: itself, and its beginnings marked by a star."""
    word = plain_word(raw)
    if word and _SYMBOL_INSIDE.search(word):
        word = revealed(word)
    return [word, *(f"{word[:n]}*" for n in BEGINNINGS if len(word) > n)] if word else []


@dataclass
class Lexicon:
    """Learned entries with the number of toxic and other documents that hold them."""

    toxic: int = 0
    other: int = 0
    forms: dict[str, int] = field(default_factory=dict)  # from 1
    counts: np.ndarray = field(default_factory=lambda: np.zeros((1, 2)))

    def odds(self, entries: np.ndarray, own: int | None) -> np.ndarray:
        """Log-odds of entries; ``own``: the label of the document itself, which doesn't count."""
        counts = self.counts[entries].copy()
        totals = np.array([self.toxic, self.other], float)
        if own is not None:
            counts[:, 1 - own] -= 1
            totals[1 - own] -= 1
        return np.log((counts[:, 0] + 0.3) / (totals[0] + 1)) - np.log((counts[:, 1] + 0.3) / (totals[1] + 1))


class _Words(dict):
    """The marks of each distinct word, worked out once; starts anew when full."""

    def __init__(self, lexicon: Lexicon):
        super().__init__()
        self.lexicon, self.odds = lexicon, lexicon.odds(np.arange(len(lexicon.counts)), None)

    def __missing__(self, raw):
        word = plain_word(raw)
        mark = _WORD if word else 0
        if word in _ADDRESSES:
            mark |= _ADDRESS
        if len(word) > 1 and raw.isupper():
            mark |= _CAPITALS
        if _STRETCHED.search(word):
            mark |= _LONG
        hidden = bool(word) and bool(_SYMBOL_INSIDE.search(word))
        if hidden:
            mark |= _HIDDEN
        if word in _INSULTS or (hidden and revealed(word) in _INSULTS):
            mark |= _FIXED
        entries = [e for form in word_forms(raw) if (e := self.lexicon.forms.get(form))]
        if entries:
            mark |= max(entries, key=lambda e: self.odds[e])
        if len(raw) <= 64:
            if len(self) >= _KEPT:
                self.clear()
            self[raw] = mark
        return mark


_ADDRESSES, _INSULTS = frozenset(ADDRESS), frozenset(INSULTS)


def text_features(text: str, marks: _Words, own: int | None = None) -> list[float]:
    """The dense features of a text; all are defined, and 0 for the empty text but for the odds."""
    words = text.split()
    seen = np.fromiter(map(marks.__getitem__, words), np.int64, len(words))
    n = max(1, int(np.count_nonzero(seen & _WORD)))
    entries = seen & _INDEX
    places = np.flatnonzero(entries)
    distinct = np.unique(entries[places])
    odds = marks.lexicon.odds(distinct, own) if len(distinct) else np.zeros(0)
    strong = distinct[odds >= _STRONG]
    hits = places[np.isin(entries[places], strong)]
    fixed = np.flatnonzero(seen & _FIXED)
    address = np.flatnonzero(seen & _ADDRESS)
    either = np.union1d(hits, fixed)
    at = np.searchsorted(address, either)
    gap = np.full(len(either), len(words) + NEAR + 1)
    if len(address):
        before = np.abs(either - address[np.maximum(at - 1, 0)])
        after = np.abs(either - address[np.minimum(at, len(address) - 1)])
        gap = np.minimum(before, after)
    best = np.sort(odds)[::-1]
    hidden = (seen & _HIDDEN) > 0
    letters = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    size = max(1, len(text))
    capitals = int(letters[65:91].sum())
    small = int(letters[97:123].sum())
    digits = int(letters[48:58].sum())
    marked = int(letters[33:127].sum()) - capitals - small - digits
    return [
        math.log1p(len(words)), len(hits) / n, math.log1p(len(hits)), math.log1p(len(strong)),
        float(best[0]) if len(best) else -5.0, float(best[:3].mean()) if len(best) else -5.0,
        float(odds.mean()) if len(odds) else -5.0, len(fixed) / n, math.log1p(len(fixed)),
        int((gap <= NEAR).sum()) / max(1, len(either)), len(address) / n, capitals / max(1, capitals + small),
        int(np.count_nonzero(seen & _CAPITALS)) / n, marked / size, int(letters[33]) / size, int(letters[63]) / size,
        int(hidden.sum()) / n, math.log1p(int((hidden & (((seen & _FIXED) > 0) | np.isin(entries, strong))).sum())),
        int(np.count_nonzero(seen & _LONG)) / n, digits / size,
    ]


# --- learning ---------------------------------------------------------------


def held_out(doc_id: Column) -> Column:
    """Rows no label is learned from; a row without an id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(True))


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """``doc_id, text, toxic, part`` of at most ``most`` labelled rows outside the held-out ones.

    The rows with the smallest hash of their id are taken.  Of several labels of a
    document the highest counts.
    """
    known = (
        labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["toxic"].cast("int").alias("toxic"))
        .where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)  # at most ``most`` short rows
    part = F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(4))
    return documents(docs).join(F.broadcast(sample), "doc_id").withColumn("part", part)


def _count_forms(batches):
    for batch in batches:
        counts: dict[str, list[int]] = {}
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            for form in {f for raw in set(text.split()) for f in word_forms(raw)}:
                counts.setdefault(form, [0, 0])[1 - toxic] += 1
        if counts:
            yield pa.RecordBatch.from_pydict(
                {"form": list(counts), "toxic": pa.array([c[0] for c in counts.values()], pa.int64()),
                 "other": pa.array([c[1] for c in counts.values()], pa.int64())}
            )


def learn_lexicon(sample: DataFrame) -> Lexicon:
    """At most ``ENTRIES`` forms, by how many toxic documents they mark."""
    totals = sample.agg(F.sum("toxic").alias("toxic"), F.count(F.lit(1)).alias("n")).first()
    toxic, other = totals["toxic"] or 0, totals["n"] - (totals["toxic"] or 0)
    lexicon = Lexicon(toxic, other)
    if not toxic or not other:
        return lexicon
    ratio = (F.col("toxic") + 0.3) / (toxic + 1) / ((F.col("other") + 0.3) / (other + 1))
    found = (
        sample.select("text", "toxic")
        .mapInArrow(_count_forms, "form string, toxic long, other long")
        .groupBy("form")
        .agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
        .where((F.col("toxic") >= LEAST_TOXIC) & (ratio >= LEAST_RATIO))
        .orderBy(F.desc(F.col("toxic") * F.log(ratio)), "form")
        .limit(ENTRIES)
        .collect()
    )
    lexicon.forms = {r["form"]: i + 1 for i, r in enumerate(found)}
    lexicon.counts = np.array([[0.0, 0.0], *([r["toxic"], r["other"]] for r in found)])
    return lexicon


def _features_of(batches, lexicon, learning):
    marks = _Words(lexicon)
    hold(marks)
    for batch in batches:
        # whole rows have their text inside, which is not sent twice
        texts = batch.column("text") if "text" in batch.schema.names else pc.struct_field(batch.column("row"), "text")
        own = batch.column("toxic").to_pylist() if learning else [None] * len(texts)
        rows = [text_features(texts[i].as_py() or "", marks, own[i]) for i in range(len(texts))]
        columns = {"features": pa.array(rows, pa.list_(pa.float64()))}
        for name in batch.schema.names:
            if name != "text":
                columns[name] = batch.column(name)
        yield pa.RecordBatch.from_pydict(columns)


@dataclass
class Model:
    """The lexicon, the trees and the calibration; without both classes a constant share."""

    lexicon: Lexicon
    trees: object = None
    calibration: object = None
    share: float = 0.0


def _margin(frame: DataFrame, trees) -> DataFrame:
    raised = trees.transform(frame.withColumn("features", array_to_vector("features")))
    return raised.withColumn("margin", vector_to_array("rawPrediction")[1])


def fit(docs: DataFrame, labels: DataFrame, most: int = 20_000, trees: int = 20, depth: int = 3) -> Model:
    """Train on at most ``most`` labelled documents; without both labels every score is the share of toxic ones."""
    sample = materialize(labelled_sample(docs, labels, most), "labelled-sample")
    lexicon = learn_lexicon(sample)
    share = lexicon.toxic / max(1, lexicon.toxic + lexicon.other)
    if not lexicon.toxic or not lexicon.other:
        return Model(lexicon, share=share)
    features = materialize(
        sample.select("text", "doc_id", "toxic", "part").mapInArrow(
            partial(_features_of, lexicon=lexicon, learning=True),
            "features array<double>, doc_id long, toxic int, part long",
        ),
        "labelled-features",
    ).coalesce(1)  # at most ``most`` narrow rows: sums in one order, and no small tasks
    rows = features.orderBy("doc_id")
    training = rows.where("part < 3")
    if training.select("toxic").distinct().count() < 2:
        training = rows
    classifier = GBTClassifier(
        featuresCol="features", labelCol="toxic", maxIter=trees, maxDepth=depth, stepSize=0.3, seed=1,
        predictionCol="tree_prediction",
    )
    trained = classifier.fit(training.select(array_to_vector("features").alias("features"), F.col("toxic").cast("double").alias("toxic")))
    told = _margin(rows, trained).select("margin", F.col("toxic").cast("double").alias("toxic"), "part")
    unseen = told.where("part = 3")
    if unseen.select("toxic").distinct().count() < 2:
        unseen = told
    isotonic = IsotonicRegression(featuresCol="margin", labelCol="toxic", predictionCol="score").fit(unseen.select("margin", "toxic"))
    return Model(lexicon, trained, isotonic, share)


def score(docs: DataFrame, model: Model, threshold: float = 0.3, whole_rows: bool = False) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row; null and empty texts get a score like others.

    Only ``doc_id`` and ``text`` are read.  Rows without an id have a null one and
    count as held out; repeated rows are scored each.  ``score`` lies from 0 to 1.
    With ``whole_rows`` the rows of ``docs`` come along in a struct ``row``.
    """
    text = F.struct(*[docs[c] for c in docs.columns]).alias("row") if whole_rows else docs["text"]
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text)
    kept = [c for c in texts.columns if c != "text"]
    if model.trees is None:
        scored = texts.select(*kept, F.lit(model.share).alias("score"))
    else:
        types = dict(texts.dtypes)
        features = texts.mapInArrow(
            partial(_features_of, lexicon=model.lexicon, learning=False),
            "features array<double>, " + ", ".join(f"{c} {types[c]}" for c in kept),
        )
        scored = model.calibration.transform(_margin(features, model.trees).select(*kept, "margin"))
    bounded = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score")))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), bounded.alias("score"),
        (bounded >= threshold).cast("int").alias("predicted"), *kept[1:],
    )
