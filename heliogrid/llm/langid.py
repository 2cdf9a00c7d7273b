"""Language identification: multinomial logistic regression on TF-IDF character n-grams.

Trained by follow-the-regularised-leader (proximal, with elastic net), which
keeps most weights at zero, and calibrated by a temperature.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, splitmix

ORDERS = (1, 2, 3)
#: Characters that are counted at once.
PIECE = 1 << 18
_MULTIPLIERS = splitmix(31, 16).astype(np.uint32) | np.uint32(1)


def counts(text: str, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of the lower-cased text's character n-grams, and how often each occurs."""
    total = np.zeros(1 << bits, np.int64)
    shift = np.uint32(32 - bits)
    step = max(ORDERS) - 1
    before = np.zeros(0, np.uint32)  # the last characters of the piece before, lower-cased
    with np.errstate(over="ignore"):
        for at in range(0, len(text), PIECE):
            # a sigma's lower case depends on what follows, so it is given one
            raw = text[at : at + PIECE].replace("\u03a3", "\u03c3").lower().encode("utf-32-le", "surrogatepass")
            c = (np.frombuffer(raw, np.uint32) + np.uint32(1)) * _MULTIPLIERS[0]
            c ^= c >> np.uint32(15)
            for n in ORDERS:
                own = np.concatenate([before[max(0, len(before) - n + 1) :], c]) if n > 1 else c  # n-grams that end in this piece
                if len(own) < n:
                    continue
                h = own[: len(own) - n + 1] * _MULTIPLIERS[n]
                for j in range(1, n):
                    h = (h ^ own[j : len(own) - n + 1 + j]) * _MULTIPLIERS[4 + j]
                h ^= h >> np.uint32(16)
                total += np.bincount((h * _MULTIPLIERS[9]) >> shift, minlength=1 << bits)
            before = np.concatenate([before, c])[-step:]
    found = np.flatnonzero(total)
    return found, total[found]


def weigh(found: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """(1 + log tf) * idf, scaled to length 1."""
    v = (1 + np.log(n)) * idf[found]
    length = float(np.sqrt(v @ v))
    return v / length if length else v


def document_frequency(texts: DataFrame, bits: int) -> tuple[np.ndarray, int]:
    """(documents with each bucket, documents) over all rows of texts (one string column)."""

    def run(batches):
        df, docs = np.zeros(1 << bits, np.int64), 0
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                found, _ = counts(text, bits)
                df[found] += 1
                docs += 1
        if docs:
            at = np.flatnonzero(df)
            yield pa.RecordBatch.from_arrays([pa.array([*at.tolist(), -1], pa.int32()), pa.array([*df[at].tolist(), docs], pa.int64())], ["bucket", "n"])

    out = np.zeros(1 << bits, np.int64)
    docs = 0
    for r in texts.mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        if r.bucket < 0:
            docs = r.n
        else:
            out[r.bucket] = r.n
    return out, docs


def train(rows: list, classes: int, dims: int, epochs: int, batch: int, alpha: float, beta: float, l1: float, l2: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal on (buckets, values, class) rows, a few rows at a step: weights and intercepts."""
    z, n = np.zeros((dims + 1, classes)), np.zeros((dims + 1, classes))

    def weights(at):
        zz = z[at]
        w = -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2)
        return np.where(np.abs(zz) <= l1, 0.0, w)

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for start in range(0, len(rows), batch):
            some = [rows[k] for k in order[start : start + batch]]
            at, place = np.unique(np.concatenate([[dims], *(r[0] for r in some)]), return_inverse=True)
            x = np.zeros((len(some), len(at)))
            x[:, place[0]] = 1.0
            x[np.repeat(np.arange(len(some)), [len(r[0]) for r in some]), place[1:]] = np.concatenate([r[1] for r in some])
            w = weights(at)
            s = x @ w
            p = np.exp(s - s.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(some)), [r[2] for r in some]] -= 1
            g = x.T @ p
            n_new = n[at] + g * g
            z[at] += g - (np.sqrt(n_new) - np.sqrt(n[at])) / alpha * w
            n[at] = n_new
    w = weights(np.arange(dims + 1))
    return w[:dims], w[dims]


def temperature(scores: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the scores under which held-back rows are likeliest (golden section on its logarithm)."""

    def loss(t):
        s = scores / np.exp(t)
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]).mean())

    low, high, ratio = np.log(0.05), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def fit(rows: DataFrame, per_class: int, bits: int, epochs: int, batch: int, seed: int = 5) -> dict | None:
    """A model of rows (id, text, lang), none of them null; None where there are none.

    IDF counts every row. The weights are learned from at most per_class rows of
    each language, those of the smallest hashes of the id, with their whole texts;
    a fifth of these set the temperature. Only the sample's n-gram counts come to
    the driver.
    """
    spark = rows.sparkSession
    by_lang = {r.lang: r.n for r in rows.groupBy("lang").agg(F.approx_count_distinct("id").alias("n")).collect()}
    langs = sorted(by_lang)
    if not langs:
        return None
    df, docs = document_frequency(rows.select("text"), bits)
    idf = np.log((1 + docs) / (1 + df)) + 1
    # ids with hashes up to where 2.5 times per_class are expected: few, whatever the corpus' size, and sure to hold the smallest per_class
    shares = spark.createDataFrame([(lang, 2.5 * per_class / n + 1e-9) for lang, n in by_lang.items()], "lang string, share double")
    h = F.shiftrightunsigned(F.xxhash64("id"), 11)
    near = rows.select("id", "lang", h.alias("h")).join(F.broadcast(shares), "lang").where(F.col("h") <= F.col("share") * float(1 << 53))
    first = F.row_number().over(Window.partitionBy("lang").orderBy("h", "id"))
    ids = near.select("id", "lang", "h").distinct().withColumn("r", first).where(F.col("r") <= per_class)
    picked = spark.createDataFrame([(r.id, r.lang) for r in ids.collect()], "id long, lang string")
    texts = rows.join(F.broadcast(picked), ["id", "lang"]).groupBy("id", "lang").agg(F.max("text").alias("text"))

    def run(batches):
        for part in slices(batches, 64):
            out = [[], []]
            for text in part.column(2).to_pylist():
                found, n = counts(text, bits)
                out[0].append(found.astype(np.int32).tobytes())
                out[1].append(n.astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(c, pa.binary()) for c in out)], ["id", "lang", "found", "n"])

    sample = texts.select("id", "lang", "text").mapInArrow(run, "id long, lang string, found binary, n binary").collect()
    data = []
    for r in sorted(sample, key=lambda r: (r.id, r.lang)):
        found = np.frombuffer(bytes(r.found), np.int32)
        data.append((found, weigh(found, np.frombuffer(bytes(r.n), np.int32), idf).astype(np.float32), langs.index(r.lang)))
    held, kept = data[::5], [r for i, r in enumerate(data) if i % 5]
    w, b = train(kept or data, len(langs), 1 << bits, epochs, batch, alpha=0.5, beta=1.0, l1=0.02, l2=1e-4, seed=seed)
    scores = np.array([v @ w[found] + b for found, v, _ in held]) if held else np.zeros((0, len(langs)))
    t = temperature(scores, np.array([y for *_, y in held])) if len(held) >= 10 and len(langs) > 1 else 1.0
    return {"langs": langs, "idf": idf, "w": w / t, "b": b / t, "bits": bits}


def identify(
    docs: DataFrame,
    train_rows: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    per_class: int = 800,
    bits: int = 15,
    epochs: int = 4,
    batch: int = 8,
) -> DataFrame:
    """(id_col, lang_pred, score) for every row of docs.

    lang_pred is one of the languages of train_rows, score its calibrated
    probability. It is `und`, with score 0, for null texts and texts without any
    letter, and for all texts if train_rows has no row with both text and
    language; of languages with equal scores it is the first by code point. Texts
    of any length count as a whole. Rows of train_rows with a null id, text or
    language teach nothing. Repeated rows give repeated results; repeated training
    rows count each for IDF and once for the weights (of texts that share an id and
    a language, the greatest). Bytes that aren't valid UTF-8 count as U+FFFD. An
    empty table of docs gives no rows. Other columns of docs are not read.
    """
    rows = train_rows.select(F.col(id_col).cast("long").alias("id"), F.make_valid_utf8(F.col(text_col)).alias("text"), F.make_valid_utf8(F.col(lang_col)).alias("lang")).dropna()
    model = fit(rows, per_class, bits, epochs, batch)
    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.make_valid_utf8(F.when(F.col(text_col).rlike(r"\p{L}"), F.col(text_col))).alias("text"))
    if model is None:
        return picked.select(F.col("id").alias(id_col), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in slices(batches):
            preds, scores = [], []
            for text in batch.column(1).to_pylist():
                if text is None:
                    preds.append("und")
                    scores.append(0.0)
                    continue
                found, n = counts(text, m["bits"])
                s = weigh(found, n, m["idf"]) @ m["w"][found] + m["b"]
                p = np.exp(s - s.max())
                best = int(p.argmax())
                preds.append(m["langs"][best])
                scores.append(float(p[best] / p.sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(preds, pa.string()), pa.array(scores, pa.float64())], [id_col, "lang_pred", "score"])

    return picked.mapInArrow(run, f"`{id_col}` long, lang_pred string, score double")
