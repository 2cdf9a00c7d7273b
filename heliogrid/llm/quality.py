"""Quality by compression: which of two Zstandard dictionaries suits a text better.

One dictionary is built from good and one from bad labelled texts. The difference
of the sizes to which they compress a text, over their sum, is calibrated to the
probability that the text is good.

Texts are compressed in short pieces, in which a dictionary counts for much, and
with words that come back at once replaced by counters (`counted`). Otherwise
words repeated over and over would shrink to nothing under either dictionary;
the counters are common in the dictionary of such texts only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binaries, slices

#: Bytes that are compressed at once; a dictionary counts for little in a long piece.
PIECE = 512
LEVEL = 3
#: Bytes whose words are counted at once; it bounds the memory of a long text.
STRETCH = 1 << 16
#: A word counts as coming back if it is one of so many words before it.
LAG = 3
_COUNTERS = [b" \x01%02d" % k for k in range(100)]


def counted(text: bytes):
    """The text in stretches, each word that is among the LAG words before it replaced by the
    number of such words since LAG words went by without one (99 for more)."""
    before, back, since = [], 0, 0
    for at in range(0, len(text), STRETCH):
        out = []
        for word in text[at : at + STRETCH].split(b" "):
            if word and word in before:
                back, since = back + 1, 0
                out.append(_COUNTERS[min(back, 99)])
            else:
                since += 1
                back = back if since <= LAG else 0
                out.append(b" " + word)
            before.append(word)
            if len(before) > LAG:
                del before[0]
        yield b"".join(out)


def pieces(text: bytes):
    for part in counted(text):
        for at in range(0, len(part), PIECE):
            yield part[at : at + PIECE]


class Compressors:
    """The two dictionaries, loaded once in each Python worker."""

    def __init__(self, dictionaries: tuple[bytes, bytes]):
        raw = zstandard.DICT_TYPE_RAWCONTENT
        self.own = []
        for content in dictionaries:
            d = zstandard.ZstdCompressionDict(content, dict_type=raw if content[:4] != b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_AUTO)
            d.precompute_compress(level=LEVEL)
            self.own.append(zstandard.ZstdCompressor(dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))

    def difference(self, text: bytes | None) -> float:
        """The difference of the sizes over their sum, over all pieces: above 0 if the good dictionary suits better."""
        good, bad = 0, 0
        for piece in pieces(text or b""):
            good += len(self.own[0].compress(piece))
            bad += len(self.own[1].compress(piece))
        return (bad - good) / (bad + good) if text else 0.0


def dictionary(parts: list[bytes], size: int) -> bytes:
    """A trained dictionary; the pieces themselves where they are too few for one."""
    if len(parts) >= 64:
        try:
            return zstandard.train_dictionary(size, parts).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(parts)[-size:] or b"\n" * 8


def calibrate(x: np.ndarray, y: np.ndarray, steps: int = 60, ridge: float = 1e-2) -> tuple[float, float]:
    """Intercept and slope of a logistic regression on x, by Newton's method."""
    mean, scale = x.mean(), x.std() + 1e-9
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    w = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (p - y) + ridge * w
        h = (z * (p * (1 - p) + 1e-9)[:, None]).T @ z + ridge * np.eye(2)
        w = w - np.linalg.solve(h, g)
    return float(w[0] - w[1] * mean / scale), float(w[1] / scale)


def _sample_pieces(rows: DataFrame, n: int) -> tuple[list[bytes], list[bytes]]:
    """Of each class at most n pieces, the smallest hashes from all over the whole texts of rows (id, y, text)."""

    def run(batches):
        for batch in slices(batches, 64):
            for y, text in zip(batch.column(1).to_pylist(), binaries(batch.column(2))):
                parts = list(pieces(text or b""))
                yield pa.RecordBatch.from_arrays([pa.array([y] * len(parts), pa.int32()), pa.array(parts, pa.binary())], ["y", "piece"])

    cut = rows.select("id", "y", "text").mapInArrow(run, "y int, piece binary")
    found = []
    for y in (0, 1):
        picked = cut.where(F.col("y") == y).select("piece").orderBy(F.xxhash64("piece"), "piece").limit(n)
        found.append([bytes(r.piece) for r in picked.collect()])
    return found[0], found[1]


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, per_class: int, dict_bytes: int, dict_pieces: int) -> dict:
    """Dictionaries from one half of the sample, calibration from the other."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).distinct()
    order = F.xxhash64("id")
    ids = [(r.id, r.y, k % 2) for y in (0, 1) for k, r in enumerate(known.where(F.col("y") == y).orderBy(order, "id").limit(per_class).collect())]
    if not ids:
        return {"constant": 0.5}
    picked = docs.sparkSession.createDataFrame(ids, "id long, y int, half int")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "id")
    rows = texts.groupBy("id", "y", "half").agg(F.max("text").alias("text")).cache()  # the sample's rows only
    n = {(r.y, r.half): r["count"] for r in rows.groupBy("y", "half").count().collect()}
    if min(sum(n.get((y, h), 0) for h in (0, 1)) for y in (0, 1)) < 4:
        rows.unpersist()
        each = [sum(n.get((y, h), 0) for h in (0, 1)) for y in (0, 1)]
        return {"constant": (each[1] + 1) / (sum(each) + 2)}
    bad, good = _sample_pieces(rows.where("half = 0"), dict_pieces)
    dictionaries = (dictionary(good, dict_bytes), dictionary(bad, dict_bytes))
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def run(batches):
        tool = Compressors(shared.value)
        for batch in slices(batches, 64):
            d = [tool.difference(t) for t in binaries(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(d, pa.float64())], ["id", "y", "d"])

    seen = rows.where("half = 1").select("id", "y", "text").mapInArrow(run, "id long, y int, d double").collect()
    rows.unpersist()
    x, y = (np.array(v, float) for v in zip(*sorted((r.d, r.y) for r in seen)))
    shift, slope = calibrate(x, y)
    total = {r.y: r["count"] for r in known.groupBy("y").count().collect()}  # the share of each class, for the intercept
    shift += float(np.log(total[1] / total[0]) - np.log(y.sum() / (len(y) - y.sum())))
    return {"dictionaries": dictionaries, "weights": (shift, slope)}


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    per_class: int = 3000,
    dict_bytes: int = 65536,
    dict_pieces: int = 40_000,
    out_col: str = "score",
) -> DataFrame:
    """docs with out_col: the probability, from 0 to 1, that the text is good.

    The model is fitted on at most per_class labelled rows of each class (the
    smallest hashes of the id), on their whole texts: one half gives the
    dictionaries, trained on dict_pieces pieces that a hash picks from all over
    the texts, the other half the calibration. Every text is scored as a whole,
    however long. Null and empty texts have a difference of 0, and all have that
    score. With fewer than four texts of either class, every score is the smoothed
    share of good labels. Label rows that repeat count once, and so do rows of docs
    that repeat an id, in fitting (the greatest text); each row is scored. An id
    with both labels teaches both. An empty table of docs gives no rows. An
    existing column out_col is replaced, others go through.
    """
    model = fit(docs, labels, id_col, text_col, label_col, per_class, dict_bytes, dict_pieces)
    if "constant" in model:
        return docs.withColumn(out_col, F.lit(float(model["constant"])))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c != out_col]
    at = names.index(text_col)
    picked = docs.select(*[F.col(f"`{c}`") for c in names])
    schema = picked.withColumn(out_col, F.lit(0.0)).schema

    def run(batches):
        tool = Compressors(shared.value["dictionaries"])
        shift, slope = shared.value["weights"]
        for batch in slices(batches):
            x = np.array([tool.difference(t) for t in binaries(batch.column(at))])
            p = 1 / (1 + np.exp(-np.clip(shift + slope * x, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64())], [*names, out_col])

    return picked.mapInArrow(run, schema)
