"""Personal data: patterns, and the terms that give protected entities away.

Patterns find e-mail and IP addresses, card and phone numbers. Each value is a
protected entity. Over the corpus, the co-occurrence of an entity with the terms
around it estimates how much of the entity's information a term discloses:
PMI(entity, term) / IC(entity), which is 1 if the term occurs with the entity
only. Counts are of distinct texts: what only copies repeat is no evidence.

A term at or above a threshold is generalised to its class (name, word, number,
code), unless the corpus says that the class discloses as much, and removed from
a higher threshold on.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, binaries, settle, slices, splitmix, word_hashes

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DIGIT = re.compile(r"[0-9]")
# A match can only begin where a run of digits begins: one that began later would also begin there.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Terms are runs of letters, digits and non-ASCII bytes.
_TERM_GAP = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
#: What terms are generalised to; each counts in the corpus like a term.
CLASSES = ("number", "code", "name", "word")
_CLASS_KEYS = splitmix(77, len(CLASSES))


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str):
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(done, at + 1))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in code points, by kind and start."""
    out = [(0, s, e) for s, e in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(x) <= 3 and int(x or 0) <= 255 for x in (g.lstrip("0") for g in m.groups())):
                out.append((1, *m.span()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() <= 37:
                digits = re.sub(r"[^0-9]", "", m[0])
                if 16 <= len(digits) <= 19 and _luhn(digits):
                    out.append((2, *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 8 <= len(_DIGIT.findall(m[0])) <= 15:
                    out.append((3, *m.span()))
    return out


def entity(kind: int, value: str) -> int:
    """A 64-bit name of an entity's normalised value."""
    value = value.lower() if kind < 2 else re.sub(r"[^0-9]", "", value)
    return int.from_bytes(hashlib.blake2b(f"{kind}:{value}".encode(), digest_size=8).digest(), "little", signed=True)


def terms(text: bytes):
    """(hash, start, end, class) of the terms; starts and ends in code points, classes by number."""
    h, s, e = word_hashes(text, True, _TERM_GAP)
    raw = np.frombuffer(text, np.uint8)
    digits, others = (np.concatenate([[0], np.cumsum(x)]) for x in ((raw >= 48) & (raw <= 57), ~_TERM_GAP[raw] & ~((raw >= 48) & (raw <= 57))))
    has_digit, has_other = digits[e] > digits[s], others[e] > others[s]
    upper = (raw[s] >= 65) & (raw[s] <= 90) if len(s) else has_digit
    kind = np.where(has_digit & ~has_other, 0, np.where(has_digit, 1, np.where(upper, 2, 3)))
    if len(s) and (raw >= 128).any():
        chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        s, e = chars[s], chars[e]
    return h, s, e, kind


def valid(raw: bytes | None) -> tuple[str, bytes]:
    """A text and its UTF-8 bytes; what isn't valid UTF-8 becomes U+FFFD in both, a null is empty."""
    raw = raw or b""
    try:
        return raw.decode(), raw
    except UnicodeDecodeError:
        text = raw.decode("utf-8", "replace")
        return text, text.encode()


def _outside(s: np.ndarray, e: np.ndarray, spans) -> np.ndarray:
    free = np.ones(len(s), bool)
    for _, a, b in spans:
        free[np.searchsorted(e, a, "right") : np.searchsorted(s, b, "left")] = False
    return free


def weighted(docs: DataFrame, text_col: str, max_rows: int) -> DataFrame:
    """(text, weight): each row's text, and 1 / the number of rows that have it, so that sums of
    weights count distinct texts. Texts are shuffled only if more than max_rows of them repeat."""
    keyed = docs.select(F.col(text_col).alias("text"), F.xxhash64(text_col).alias("key"), F.xxhash64(F.lit(7), F.col(text_col)).alias("key2"))
    copies = settle(keyed.groupBy("key", "key2").agg(F.count("*").alias("n")).where("n > 1"))
    few = copies.count() <= max_rows
    return keyed.join(F.broadcast(copies) if few else copies, ["key", "key2"], "left").select("text", (F.lit(1.0) / F.coalesce("n", F.lit(1))).alias("weight"))


def contexts(texts: DataFrame, window: int | None) -> DataFrame:
    """(entity, term, weight) of texts (text, weight): for each entity of a text a row without a term,
    and one for each term of the text, or within `window` terms of it, and for each of their classes."""

    def run(batches):
        for batch in slices(batches):
            es, ts, ws = [], [], []
            for raw, weight in zip(binaries(batch.column(0)), batch.column(1).to_pylist()):
                text, raw = valid(raw)
                spans = base_spans(text)
                if not spans:
                    continue
                h, s, e, kind = terms(raw)
                free = _outside(s, e, spans)
                h, s, kind = h[free].view(np.int64), s[free], _CLASS_KEYS.view(np.int64)[kind[free]]
                near: dict[int, set] = {}
                for k, a, b in spans:
                    at = int(np.searchsorted(s, a))
                    lo, hi = (0, len(s)) if window is None else (max(0, at - window), at + window)
                    near.setdefault(entity(k, text[a:b]), set()).update(h[lo:hi].tolist(), kind[lo:hi].tolist())
                for k, found in near.items():
                    es += [k] * (len(found) + 1)
                    ts += [None, *sorted(found)]
                    ws += [weight] * (len(found) + 1)
            yield pa.RecordBatch.from_arrays([pa.array(es, pa.int64()), pa.array(ts, pa.int64()), pa.array(ws, pa.float64())], ["entity", "term", "weight"])

    return texts.mapInArrow(run, "entity long, term long, weight double")


def term_frequency(texts: DataFrame, held: int = 1 << 20) -> DataFrame:
    """(term, n): distinct texts with each term or class, over all of texts (text, weight); summed
    in each task first, `held` terms at a time."""

    def packed(keys, weights):
        found, place = np.unique(np.concatenate(keys), return_inverse=True)
        return found, np.bincount(place, np.concatenate(weights), len(found))

    def run(batches):
        keys, weights, n, settled = [], [], 0, 0
        for batch in slices(batches):
            for raw, weight in zip(binaries(batch.column(0)), batch.column(1).to_pylist()):
                if raw:
                    h, _, _, kind = terms(valid(raw)[1])
                    found = np.unique(np.concatenate([h, _CLASS_KEYS[kind]]))
                    keys.append(found)
                    weights.append(np.full(len(found), weight))
                    n += len(found)
            if n >= held + settled:
                found, total = packed(keys, weights)
                keys, weights, n, settled = [found], [total], len(found), len(found)
                if len(found) >= held:
                    yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(total)], ["term", "n"])
                    keys, weights, n, settled = [], [], 0, 0
        if keys:
            found, total = packed(keys, weights)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(total)], ["term", "n"])

    return texts.mapInArrow(run, "term long, n double").groupBy("term").agg(F.round(F.sum("n")).alias("n"))


def disclosing_terms(docs: DataFrame, text_col: str, window: int | None, min_texts: int, threshold: float, max_rows: int, salts: int = 64) -> DataFrame:
    """(term, disclosure): the largest PMI(entity, term) / IC(entity) of each term (or class) at or above the threshold."""
    texts = weighted(docs, text_col, max_rows)
    pairs = contexts(texts, window).groupBy("entity", "term").agg(F.round(F.sum("weight")).alias("both"))
    pairs = settle(pairs.where(F.col("both") >= min_texts))
    near = pairs.where("term is not null")
    n = float(docs.select(F.xxhash64(text_col).alias("key"), F.xxhash64(F.lit(7), F.col(text_col)).alias("key2")).distinct().count())
    entities = pairs.where("term is null").select("entity", F.col("both").alias("n_entity"))
    ic = F.log2(F.lit(n) / F.col("n_entity"))
    pmi = F.log2(F.lit(n) * F.col("both") / (F.col("n") * F.col("n_entity")))
    # an entity that every text has discloses nothing
    # every entity has the same few classes near it: their rows are dealt over salts, those of terms are not
    classes = F.col("term").isin(*_CLASS_KEYS.view(np.int64).tolist())
    near = near.withColumn("salt", F.when(classes, F.pmod(F.xxhash64("entity"), F.lit(salts))).otherwise(0).cast("int"))
    every = F.explode(F.when(classes, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))
    known = near.join(entities, "entity").join(term_frequency(texts).withColumn("salt", every), ["term", "salt"])
    known = known.withColumn("disclosure", F.when(ic > 0, pmi / ic))
    return settle(known.groupBy("term").agg(F.max("disclosure").alias("disclosure")).where(F.col("disclosure") >= threshold))


def sanitised(text: str, spans: list[tuple[int, int, str]]) -> str:
    """text with each span's stand-in; where spans overlap, one stand-in (of the first) for all."""
    out, at = [], 0
    for s, e, stand_in in sorted(spans):
        if s >= at:
            out += [text[at:s], stand_in]
        at = max(at, e)
    return "".join([*out, text[at:]])


def _own_terms(docs: DataFrame, id_col: str, text_col: str, listed: DataFrame, salts: int) -> DataFrame:
    """docs with __listed: (term, disclosure) structs of the listed terms of its text, by a shuffle on terms."""

    def run(batches):
        for batch in slices(batches):
            keys, keys2, ts = [], [], [np.zeros(0, U64)]
            for key, key2, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), binaries(batch.column(2))):
                h, _, _, kind = terms(valid(raw)[1])
                ts.append(np.unique(np.concatenate([h, _CLASS_KEYS[kind]])))
                keys += [key] * len(ts[-1])
                keys2 += [key2] * len(ts[-1])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(keys2, pa.int64()), pa.array(np.concatenate(ts).view(np.int64))], ["key", "key2", "term"])

    keyed = docs.withColumns({"__key": F.xxhash64(text_col), "__key2": F.xxhash64(F.lit(7), F.col(text_col))})
    has = keyed.select(F.col("__key").alias("key"), F.col("__key2").alias("key2"), F.col(text_col).alias("text")).mapInArrow(run, "key long, key2 long, term long")
    salt = F.pmod(F.xxhash64("key"), F.lit(salts)).cast("int")
    spread = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    own = has.distinct().withColumn("salt", salt).join(listed.withColumn("salt", spread), ["term", "salt"])
    own = own.groupBy("key", "key2").agg(F.collect_list(F.struct("term", "disclosure")).alias("__listed"))  # terms of one text
    own = own.select(F.col("key").alias("__key"), F.col("key2").alias("__key2"), "__listed").withColumn("__salt", spread)
    return keyed.withColumn("__salt", F.pmod(F.xxhash64(id_col), F.lit(salts)).cast("int")).join(own, ["__key", "__key2", "__salt"], "left").drop("__key", "__key2", "__salt")


def sanitise(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int | None = None,
    min_texts: int = 1,
    generalise_at: float = 0.95,
    remove_at: float = 0.99,
    max_rows: int = 500_000,
    salts: int = 16,
) -> DataFrame:
    """(id_col, n_email, n_ip, n_card, n_phone, n_generalised, n_removed, base_sha256, spans, sanitised) for every row of docs.

    Spans are kind:start:end in code points, end exclusive, by kind (email, ip,
    card, phone, then generalised and removed terms) and start; base_sha256 is the
    digest of the base ones. A term is protected if it stands in a text with an
    entity (with a window: within so many terms of it), in min_texts distinct texts
    or more, and discloses at least generalise_at of it; then each of its
    occurrences outside base spans is replaced by its class, as [NAME], or taken
    out from remove_at on, or where the class itself is protected. Base spans
    become [EMAIL], [IP], [CARD], [PHONE]. Of an entity in one of N texts a term in
    n texts discloses 1 - log(n) / log(N), so rarity alone bounds what is protected.

    A null text counts as empty; copies of a text count as one in all statistics,
    and each row has its result. Ids play no part: null and repeated ones go
    through. Terms of one letter count too, texts of any length as a whole. Of
    entities that a term discloses, the one disclosed most counts. An empty table
    gives no rows; other columns are not read. Up to max_rows protected terms are
    broadcast; more meet the texts in a shuffle, with the same result. Bytes that
    aren't valid UTF-8 count as U+FFFD, one code point for each run that is replaced.
    """
    listed = disclosing_terms(docs, text_col, window, min_texts, generalise_at, max_rows)
    docs = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias(text_col))
    shared = None
    if listed.count() <= max_rows:
        rows = sorted((r.term, r.disclosure) for r in listed.collect())
        keys = np.array([t for t, _ in rows], np.int64).view(U64)
        order = np.argsort(keys)
        shared = docs.sparkSession.sparkContext.broadcast((keys[order], np.array([d for _, d in rows], float)[order]))
    else:
        docs = _own_terms(docs, id_col, text_col, listed, salts)
    names = [id_col, *(f"n_{k}" for k in KINDS), "n_generalised", "n_removed", "base_sha256", "spans", "sanitised"]
    kinds = [pa.int64()] * 7 + [pa.string()] * 3
    schema = ", ".join(f"`{n}` {'long' if t == pa.int64() else 'string'}" for n, t in zip(names, kinds))

    def run(batches):
        hidden = np.isin(_CLASS_KEYS, shared.value[0]) if shared is not None else None  # classes that disclose as much themselves
        for batch in slices(batches, 256):
            out = [[] for _ in names]
            lists = batch.column(2).to_pylist() if shared is None else [None] * batch.num_rows
            for i, raw, own in zip(batch.column(0).to_pylist(), binaries(batch.column(1)), lists):
                text, raw = valid(raw)
                base = base_spans(text)
                if shared is not None:
                    keys, disclosure = shared.value
                else:
                    own = sorted((np.int64(x["term"]).astype(U64), x["disclosure"]) for x in own or [])
                    keys, disclosure = np.array([t for t, _ in own], U64), np.array([d for _, d in own], float)
                found = []
                if len(keys) and raw:
                    h, s, e, kind = terms(raw)
                    at = np.searchsorted(keys, h)
                    at[at == len(keys)] = 0
                    hit = np.flatnonzero((keys[at] == h) & _outside(s, e, base))
                    gone = (disclosure[at[hit]] >= remove_at) | (np.isin(_CLASS_KEYS, keys) if hidden is None else hidden)[kind[hit]]
                    found = sorted((int(s[k]), int(e[k]), "" if g else f"[{CLASSES[kind[k]].upper()}]") for k, g in zip(hit, gone))
                named = ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in base)
                n = [sum(k == j for k, _, _ in base) for j in range(4)]
                actions = [[f"{name}:{s}:{e}" for s, e, x in found if bool(x) == kept] for name, kept in (("generalised", True), ("removed", False))]
                every = ",".join([named] * bool(base) + actions[0] + actions[1])
                clean = sanitised(text, [(s, e, f"[{KINDS[k].upper()}]") for k, s, e in base] + found)
                for column, value in zip(out, (i, *n, len(actions[0]), len(actions[1]), hashlib.sha256(named.encode()).hexdigest(), every, clean)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names)

    return docs.mapInArrow(run, schema)
