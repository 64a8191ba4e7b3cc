"""Counterfactual-regularised toxicity classifier.

Logistic regression over which words occur in a text. Its loss has, besides the
labels, the squared change of the score when identity terms in a labelled sentence
are swapped for other ones: a group's name alone then can't move a score, which
spares neutral mentions. Few weights survive (soft threshold), so a score is a sum
over the handful of words of a text that the model knows."""
from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import checkpointed
from .arrays import as_bytes, small_batches

#: Fixed groups of identity terms; a term is swapped for the next of its group.
IDENTITY = (
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "sikh"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "sikhs"),
    ("black", "white", "asian", "latino", "arab", "african", "european"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "queer"),
    ("women", "men"), ("woman", "man"), ("female", "male"), ("girls", "boys"),
    ("immigrants", "refugees", "foreigners", "natives"), ("immigrant", "refugee", "foreigner", "native"),
    ("deaf", "blind", "disabled", "autistic"), ("old", "young"), ("poor", "rich"),
    ("blacks", "whites", "asians", "latinos", "arabs", "africans", "europeans"), ("gays", "lesbians"),
    # German
    ("muslime", "christen", "juden", "buddhisten", "atheisten"), ("schwarze", "weiße"), ("schwarzen", "weißen"), ("afrikaner", "europäer", "asiaten", "araber"),
    ("schwule", "lesben"), ("schwul", "lesbisch"), ("frauen", "männer"), ("frau", "mann"), ("mädchen", "jungen"), ("ausländer", "flüchtlinge", "einwanderer", "migranten"),
    # French
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"), ("musulman", "chrétien", "juif", "hindou", "bouddhiste", "athée"), ("noirs", "blancs"),
    ("africains", "européens", "asiatiques"), ("homosexuels", "hétérosexuels"), ("femmes", "hommes"), ("femme", "homme"), ("filles", "garçons"), ("immigrés", "réfugiés", "migrants"),
    # Spanish
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"), ("musulmán", "cristiano", "judío", "hindú", "budista", "ateo"), ("negros", "blancos"),
    ("africanos", "europeos", "asiáticos"), ("homosexuales", "heterosexuales"), ("mujeres", "hombres"), ("mujer", "hombre"), ("chicas", "chicos"), ("inmigrantes", "refugiados", "extranjeros"),
)
SWAP = {w: group[(k + 1) % len(group)] for group in IDENTITY for k, w in enumerate(group)}
TERMS = frozenset(w.encode() for w in SWAP)
_WORD = re.compile(rb"[a-z\x80-\xff]+(?:'[a-z]+)?")
#: Labelled rows that a model is fitted on, at most; the rows with the smallest hashes.
TRAINING_ROWS = 20_000
#: Words in fewer rows, or that tell the classes apart by fewer standard errors, are left out.
MIN_ROWS, MIN_Z = 4, 4.0
#: Length of a gradient step.
RATE = 0.3


def words_of(text: bytes) -> set[bytes]:
    """Words of a text, and their first four and five bytes as `^...`: invectives
    bend and compound, mostly at their end. An identity term is one feature, without its
    beginnings and what follows an apostrophe: a swap then moves all that it gives."""
    found = {t if b"'" in w and (t := w[: w.index(b"'")]) in TERMS else w for w in _WORD.findall(text.lower())}
    bent = found - TERMS
    return found | {b"^" + w[:4] for w in bent if len(w) > 4} | {b"^" + w[:5] for w in bent if len(w) > 5}


@dataclass(frozen=True)
class Model:
    bias: float
    weights: dict[bytes, float]

    def score(self, text: bytes) -> float:
        found = words_of(text) & self.weights.keys()
        z = self.bias + sum(sorted(self.weights[w] for w in found))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def told_apart(n, bad, rows, bad_rows, min_rows: int, min_z: float, root):
    """A word of `n` rows, `bad` of them toxic, is frequent enough and its two shares
    differ by `min_z` standard errors. For numbers and for Columns alike."""
    good_rows = rows - bad_rows
    gap = bad * good_rows - (n - bad) * bad_rows
    spread = root(n * (rows - n) * good_rows * bad_rows * (1.0 / rows))
    return (n >= min_rows) & (gap * gap >= min_z * min_z * spread * spread)


def fit(rows: list[tuple[frozenset[bytes], int]], min_rows: int = MIN_ROWS, min_z: float = MIN_Z, l1: float = 5e-5, swap_penalty: float = 1.0, steps: int = 300) -> Model:
    """Model of (words, label) rows by proximal gradient steps over all rows.

    Words in fewer than `min_rows` rows, or as frequent in both classes (a difference
    under `min_z` standard errors), are left out, identity terms never. Both classes
    weigh the same. Without rows, or with one class, the model is constant."""
    y = np.array([label for _, label in rows], float)
    if not len(y) or y.min() == y.max():
        return Model(0.0 if not len(y) else (4.0 if y[0] else -4.0), {})
    counts, bad = Counter(), Counter()
    for found, label in rows:
        counts.update(found)
        if label:
            bad.update(found)
    n1 = float(y.sum())
    names = sorted(w for w, n in counts.items() if w in TERMS or told_apart(n, bad[w], len(y), n1, min_rows, min_z, math.sqrt))
    index = {w: k for k, w in enumerate(names)}
    pairs = [(r, index[w]) for r, (found, _) in enumerate(rows) for w in found if w in index]
    row, col = (np.array(x, np.int64) for x in zip(*pairs)) if pairs else (np.zeros(0, np.int64),) * 2
    # counterfactual: which features a swap of identity terms takes and gives
    d_row, d_col, d_sign, k = [], [], [], 0
    for found, _ in rows:
        if own := found & TERMS:
            for w in own:
                for name, sign in ((w, -1.0), (SWAP[w.decode()].encode(), 1.0)):
                    if name in index:
                        d_row.append(k), d_col.append(index[name]), d_sign.append(sign)
            k += 1
    d_row, d_col, d_sign = np.array(d_row, np.int64), np.array(d_col, np.int64), np.array(d_sign)
    weight = np.where(y > 0, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    n, size = len(y), len(names)
    # each column at its own pace (sums of squared gradients), so rare words move as far
    w, b = np.zeros(size), 0.0
    sum_w, sum_b = np.full(size, 1e-10), 1e-10
    for _ in range(steps):
        z = b + np.bincount(row, w[col], n)
        error = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        gradient = np.bincount(col, error[row], size)
        if k:
            change = np.bincount(d_row, d_sign * w[d_col], k)
            gradient += swap_penalty / k * np.bincount(d_col, d_sign * change[d_row], size)
        sum_w += gradient**2
        sum_b += error.sum() ** 2
        pace = RATE / np.sqrt(sum_w)
        w = w - pace * gradient
        w = np.sign(w) * np.maximum(0, np.abs(w) - pace * l1)
        b -= RATE / math.sqrt(sum_b) * error.sum()
    return Model(float(b), {names[i]: float(w[i]) for i in np.flatnonzero(w)})


def train(docs: DataFrame, labels: DataFrame, training_rows: int = TRAINING_ROWS, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", **options) -> Model:
    """Model of the labelled rows of `docs` whose crc32(doc_id as text) mod 3 is not 1.

    Equal texts count once (with their larger label). If there are more than
    `training_rows` of them, those with the smallest hash of the text are taken: that
    bound is the only one, scores cover all rows. Words are counted and chosen where the
    rows are; the driver gets the chosen words and the rows' lists of them. Null texts,
    labels and ids teach nothing."""
    learn = labels.select(F.col(doc_id).alias("i"), F.col(label).cast("int").alias("y")).filter("y is not null and crc32(cast(i as string)) % 3 <> 1")
    learn = learn.groupBy("i").agg(F.max("y").alias("y"))
    rows = small_batches(docs).select(F.col(doc_id).alias("i"), F.col(text).cast("string").alias("t")).filter("t is not null").withColumn("h", F.xxhash64("t"))
    # Texts are chosen by their hashes; the choice has at most `training_rows` small
    # rows, so it is broadcast, and only the chosen texts move.
    chosen_rows = rows.select("i", "h").join(learn, "i").groupBy("h").agg(F.max("y").alias("y"), F.min("i").alias("i")).orderBy("h").limit(training_rows)
    texts = rows.join(F.broadcast(checkpointed(chosen_rows)), ["i", "h"]).dropDuplicates(["h"])
    picked = checkpointed(texts.select("t", "y").repartition(max(1, training_rows // 1000)))

    def count(batches):
        seen, bad = Counter(), Counter()
        for batch in batches:
            for t, y in zip(as_bytes(batch.column(0)), batch.column(1).to_pylist()):
                found = words_of(t)
                seen.update(found)
                if y:
                    bad.update(found)
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64()), pa.array([bad[w] for w in seen], pa.int64())], ["w", "n", "bad"])

    sums = picked.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("bad")).first()
    if not sums.n or not 0 < sums.bad < sums.n:
        return fit([(frozenset(), int(bool(sums.bad)))] * min(1, sums.n))
    counts = picked.mapInArrow(count, "w binary, n long, bad long").groupBy("w").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    tells = told_apart(F.col("n"), F.col("bad"), F.lit(float(sums.n)), F.lit(float(sums.bad)), options.get("min_rows", MIN_ROWS), options.get("min_z", MIN_Z), F.sqrt)
    chosen = frozenset(bytes(r.w) for r in counts.filter(tells | F.col("w").isin(sorted(TERMS))).select("w").toLocalIterator())

    def sets(batches):
        for batch in batches:
            out = [b" ".join(sorted(words_of(t) & chosen)) for t in as_bytes(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), batch.column(1)], ["w", "y"])

    found = picked.mapInArrow(sets, "w binary, y int")
    return fit([(frozenset(bytes(r.w).split()), r.y) for r in found.toLocalIterator()], **options)


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.7) -> DataFrame:
    """`docs` with held_out, score (0 to 1) and predicted added (columns of those names
    are replaced). A null text scores as an empty one; a null doc_id is not held out."""
    kept = [c for c in docs.columns if c not in ("held_out", "score", "predicted")]
    rows = small_batches(docs).select(*kept)
    place = kept.index(text)

    def run(batches):
        for batch in batches:
            s = [model.score(t) for t in as_bytes(batch.column(place))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64())], [*batch.schema.names, "score"])

    shape = rows.withColumn("score", F.lit(0.0)).schema
    out = rows.mapInArrow(run, shape)
    held = F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))
    return out.withColumn("held_out", held).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
