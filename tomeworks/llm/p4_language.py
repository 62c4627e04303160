"""Problem 4: missing or wrong document language labels.

String-kernel classification. The kernel of two units of text is the cosine of their sets of
character n-grams (blended spectrum of lengths 1 to 4, presence only, hashed to DIMS). A bounded
sample of labelled documents (TRAIN_DOCS per language, DOC_UNITS units of each, spread over its text)
is cut to presence vectors where it is read; LANDMARKS of them make the Nystroem map, and
one-versus-rest kernel ridge regression is solved on it. As the kernel is an inner product of
presence vectors, map and weights fold into one matrix, and batches of presence rows times that
matrix score all units. The rest of the data is read in full by one pass.

The languages are those that labels name, in at least MIN_LABELLED documents of the sample where
SPELLINGS doesn't know the code, and that the first fit can tell apart: a label whose units mostly
belong to other languages is no class. A unit that scores
below what all but REJECTED of the held-out units score for their own language speaks for "und",
none of these.

Each document's units (sentences of the running text) get the best path of languages under a
penalty for each change, so stretches in another language come out with their limits. Sentences of
a word or two have no part in the path; their words count to the stretch they stand in.

Defined results: a null or empty text, or one without running text, has no stretch and the language
null with confidence 0; repeated rows come out repeated (in the sample, rows of one key count once);
an empty table, or one without usable labels, gives no model, and documents then have no language;
other columns are not looked at.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tomeworks.functions.text import plain_number
from tomeworks.llm import codepoints as C
from tomeworks.session import table

LANGS = ("de", "en", "es", "fr", "it", "nl", "pt")
# Codes and names of the languages.
SPELLINGS = {
    "de": "de deu ger german deutsch",
    "en": "en eng english",
    "es": "es spa spanish español espanol castellano",
    "fr": "fr fra fre french français francais",
    "it": "it ita italian italiano",
    "nl": "nl nld dut dutch nederlands",
    "pt": "pt por portuguese português portugues",
}
TRAIN_DOCS, DOC_UNITS, MIN_LABELLED, LANDMARKS = 150, 12, 20, 384
UNKNOWN, REJECTED = "und", 0.005
PARTS = ((1, 64), (2, 1024), (3, 1472), (4, 1536))  # n-gram length, hashed dimensions
DIMS = sum(d for _, d in PARTS)
RIDGE, SWITCH, STRETCH = 1e-3, 5.0, 40
ROWS = 512  # units scored at once


def named_languages(col: Column) -> Column:
    """The known languages a cell names, as an array of two-letter codes."""
    known = F.create_map(*(F.lit(x) for code, names in SPELLINGS.items() for n in names.split() for x in (n, code)))
    words = F.regexp_extract_all(F.lower(F.coalesce(col, F.lit(""))), F.lit(r"(\p{L}+)(?:[-_]\p{L}{2}\b)?"), F.lit(1))
    return F.array_compact(F.array_distinct(F.transform(words, lambda w: F.try_element_at(known, w))))


def label_code(col: Column) -> Column:
    """The language a label names: the first known one, else a cell that is nothing but a code of two letters, or one with its region."""
    code = F.regexp_extract(F.lower(F.coalesce(col, F.lit(""))), r"^\s*([a-z]{2})(?:[-_][a-z]{2})?\s*$", 1)
    return F.coalesce(F.try_element_at(named_languages(col), F.lit(1)), F.nullif(code, F.lit("")))


@cache
def symbols() -> np.ndarray:
    """Letters as 1 to 63, all else 0. Accented letters of the Latin script have symbols of their own."""
    own = "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïñòóôõöøùúûüýßœ"
    number = {ch: i + 1 for i, ch in enumerate(own)}
    folded = C.fold_table()
    out = np.zeros(C.LIMIT, np.uint8)
    twins = {**C.CYRILLIC_AS_LATIN, **C.GREEK_AS_LATIN}
    for c, letter, kind in C.assigned():
        if kind[0] != "L":
            continue
        ch = twins.get(letter, letter).lower()[:1]
        if ch not in number and folded.count[ord(ch)] == 1:
            ch = chr(folded.single[ord(ch)])
        out[c] = number.get(ch) or number.get(unicodedata.normalize("NFD", ch)[0], 63)
    return out


class Units(NamedTuple):
    row: np.ndarray
    start: np.ndarray  # code points
    end: np.ndarray
    words: np.ndarray


def _bodies(t: C.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Where each row's text between its START and END lines begins and ends."""
    low, high = t.off[:-1].copy(), t.off[1:].copy()
    star = t.cp == ord("*")
    if len(star) < 4:
        return low, high
    at = np.flatnonzero(star[:-2] & star[1:-1] & star[2:])
    first = np.ones(len(t.cp), bool)
    first[1:] = (t.cp[:-1] == 10) | (t.cp[:-1] == 13)
    first[t.off[:-1][np.diff(t.off) > 0]] = True
    at = at[first[at]]
    if not len(at):
        return low, high
    row = np.searchsorted(t.off, at, side="right") - 1
    started, ended = np.zeros(len(low), bool), np.zeros(len(low), bool)
    line_end = np.append(np.flatnonzero((t.cp == 10) | (t.cp == 13)), len(t.cp))
    ends = np.minimum(line_end[np.searchsorted(line_end, at)], t.off[1:][row])
    for p, r, end in zip(at.tolist(), row.tolist(), ends.tolist(), strict=True):
        head = t.cp[p + 3 : min(end, p + 16)].tobytes().decode("utf-32-le").upper().strip()
        if head.startswith("START OF") and not started[r]:
            started[r] = True
            low[r] = end
        elif head.startswith("END OF") and not ended[r]:
            ended[r] = True
            high[r] = p
    return low, np.maximum(low, high)


def units(t: C.Texts) -> Units:
    """Sentences of the running text, of rows in order; headings and sentences of a word or two are left out."""
    return long_and_short(t)[0]


def long_and_short(t: C.Texts) -> tuple[Units, Units]:
    """The sentences of units(), and those too short to be scored."""
    cp = t.cp
    none = np.empty(0, np.int64)
    if not len(cp):
        return Units(none, none, none, none), Units(none, none, none, none)
    blank = (cp == 32) | (cp == 10) | (cp == 13) | (cp == 9) | (cp == 160)
    low, high = _bodies(t)
    edge = np.zeros(len(cp) + 1, np.int32)
    np.add.at(edge, low, 1)
    np.add.at(edge, high, -1)
    inside = np.cumsum(edge[:-1]) > 0
    cut = np.zeros(len(cp) + 1, bool)
    cut[t.off[:-1]] = True
    cut[low], cut[high] = True, True
    stop = np.isin(cp, np.frombuffer(".!?".encode("utf-32-le"), np.uint32))
    closing = np.isin(cp, np.frombuffer("”\"’»)'".encode("utf-32-le"), np.uint32))
    after = np.flatnonzero(stop[:-1] & (blank[1:] | closing[1:])) + 1
    cut[after] = True
    line = np.flatnonzero(cp == 10)
    filled = np.cumsum(~blank)
    gap = line[1:][filled[line[1:]] == filled[line[:-1]]] if len(line) > 1 else none
    cut[gap] = True
    start = np.flatnonzero(cut[:-1])
    end = np.append(start[1:], len(cp))
    token = ~blank
    token[1:] &= blank[:-1] | cut[1:-1]
    count = np.add.reduceat(token.astype(np.int64), start)
    letters = np.add.reduceat((symbols()[cp] > 0).astype(np.int64), start)
    keep = inside[start] & (count >= 3) & (letters >= 2 * count)
    row = np.searchsorted(t.off, start, side="right") - 1
    short = inside[start] & ~keep & (letters > 0) & stop[end - 1]
    return Units(row[keep], start[keep], end[keep], count[keep]), Units(row[short], start[short], end[short], count[short])


def around(u: Units, path: np.ndarray, short: Units, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which short sentences have a unit beside them in their row, and the unit each goes with: of two languages, that of its better score."""
    after = np.searchsorted(u.start, short.start)
    before, next_ = np.maximum(after - 1, 0), np.minimum(after, len(u.row) - 1)
    has_before, has_after = (after > 0) & (u.row[before] == short.row), (after < len(u.row)) & (u.row[next_] == short.row)
    own = np.arange(len(after))
    forward = has_after & (~has_before | (score[own, path[next_]] > score[own, path[before]]))
    which = np.flatnonzero(has_before | has_after)
    return which, np.where(forward, next_, before)[which]


def presence(t: C.Texts, u: Units) -> Iterator[np.ndarray]:
    """Rows of n-gram presence, at most ROWS at a time."""
    for k in range(0, len(u.row), ROWS):
        a, b = u.start[k : k + ROWS], u.end[k : k + ROWS]
        length = b - a
        off = np.concatenate(([0], np.cumsum(length)))
        at = np.repeat(a - off[:-1], length) + np.arange(off[-1])
        unit = np.repeat(np.arange(len(a)), length)
        s = symbols()[t.cp[at]].astype(np.uint32)
        keep = s > 0
        keep[1:] |= s[:-1] > 0
        s, unit = s[keep], unit[keep]
        out = np.zeros((len(a), DIMS), np.uint8)
        flat, base, gram = out.reshape(-1), 0, np.zeros(len(s), np.uint32)
        offset = unit * DIMS
        for n, dims in PARTS:
            m = len(s) - n + 1
            if m <= 0:
                break
            gram = gram[:m] * np.uint32(64) + s[n - 1 :]
            ok = unit[:m] == unit[n - 1 :]
            slot = gram if n == 1 else ((gram * np.uint32(2654435761)) >> np.uint32(8)) % np.uint32(dims)
            flat[(offset[:m] + base + slot)[ok]] = 1
            base += dims
        yield out


class Model(NamedTuple):
    langs: tuple[str, ...]
    matrix: np.ndarray  # DIMS x languages + 1; the last column of ones counts the n-grams
    sharpness: float  # of the softmax that turns scores into confidence
    reject: float  # score of a unit that speaks for none of the languages

    @property
    def names(self) -> tuple[str, ...]:
        return (*self.langs, UNKNOWN)


def scores(t: C.Texts, u: Units, model: Model) -> np.ndarray:
    """One score per unit and language, and one for none of them: presence rows times the folded matrix, over the norm."""
    out = [np.zeros((0, len(model.names)), np.float32)]
    for p in presence(t, u):
        product = p.astype(np.float32) @ model.matrix
        product[:, :-1] /= np.sqrt(np.maximum(product[:, -1:], 1))
        product[:, -1] = model.reject
        out.append(product)
    return np.concatenate(out)


def _features(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nystroem features of packed presence rows, and the map from presence vectors to them."""

    def unit(rows: np.ndarray) -> np.ndarray:
        x = np.unpackbits(rows, axis=1).astype(np.float32)
        return x / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))

    marks = unit(packed[np.random.default_rng(7).permutation(len(packed))[:LANDMARKS]])
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    good = values > 1e-6 * values.max()
    into = marks.T @ (vectors[:, good] / np.sqrt(values[good]))
    return np.concatenate([unit(packed[k : k + ROWS]) @ into for k in range(0, len(packed), ROWS)]), into


def _ridge(features: np.ndarray, y: np.ndarray, classes: int) -> np.ndarray:
    """One-versus-rest kernel ridge regression on Nystroem features."""
    target = np.where(y[:, None] == np.arange(classes), 1.0, -1.0)
    return np.linalg.solve(features.T @ features + RIDGE * len(y) * np.eye(features.shape[1]), features.T @ target)


def train(packed: np.ndarray, labels: list[str]) -> Model | None:
    """Fit on presence rows, packed to bits, and their labels; units that a first fit gives to another language are left out of the second."""
    if not len(packed):
        return None
    langs, y = np.unique(labels, return_inverse=True)
    x, into = _features(packed)
    while True:
        agree = np.argmax(x @ _ridge(x, y, len(langs)), axis=1) == y
        own = np.bincount(y[agree], minlength=len(langs)) >= 0.5 * np.bincount(y, minlength=len(langs))
        if own.all() or not own.any():
            break
        keep = own[y]
        x, y, langs = x[keep], np.cumsum(own)[y[keep]] - 1, langs[own]
    if agree.sum() < 2:
        return None
    fold = np.arange(len(y)) % 5 == 0
    test, rest = fold & agree, agree & ~fold
    held = x @ _ridge(x[rest], y[rest], len(langs)) if rest.any() else x @ _ridge(x, y, len(langs))
    own_score = held[np.arange(len(y)), y][test]

    def loss(g: float) -> float:
        z = g * held[test]
        z = z - z.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(z).sum(axis=1)) - z[np.arange(test.sum()), y[test]])) if test.any() else 0.0

    sharpness = min((1.0, 2.0, 4.0, 6.0, 8.0, 12.0, 16.0, 24.0), key=loss)
    reject = min(0.0, float(np.quantile(own_score, REJECTED))) if test.any() else -1.0
    matrix = into @ _ridge(x[agree], y[agree], len(langs))
    return Model(tuple(map(str, langs)), np.hstack([matrix, np.ones((DIMS, 1))]).astype(np.float32), sharpness, reject)


def best_path(u: Units, score: np.ndarray) -> np.ndarray:
    """The language of each unit: the path of most score per row, less SWITCH for each change.

    All rows advance together, one unit at a time.
    """
    gain = score * np.minimum(u.words, 30)[:, None]
    rows, first = np.unique(u.row, return_index=True)
    size = np.diff(np.append(first, len(u.row)))
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    total = gain[first].astype(np.float64)
    back = np.zeros(gain.shape, np.int16)
    own = np.arange(gain.shape[1])
    for k in range(1, int(size.max()) if len(size) else 0):
        live = int(np.searchsorted(-size, -k, side="left"))
        at, before = first[:live] + k, total[:live]
        top = before.argmax(axis=1)
        switch = before[np.arange(live), top] - SWITCH
        stay = before >= switch[:, None]
        back[at] = np.where(stay, own, top[:, None])
        total[:live] = np.where(stay, before, switch[:, None]) + gain[at]
    out = np.zeros(len(gain), np.int64)
    state = total.argmax(axis=1) if len(total) else np.empty(0, np.int64)
    for k in range(int(size.max()) - 1 if len(size) else -1, -1, -1):
        live = int(np.searchsorted(-size, -(k + 1), side="right"))
        at = first[:live] + k
        out[at] = state[:live]
        state[:live] = back[at, state[:live]]
    return out


def fit_sample(documents: DataFrame, key: str, text: str, label: str, per_language: int = TRAIN_DOCS, per_document: int = DOC_UNITS) -> Model | None:
    """Fit on the per_language documents of each label with the smallest hashes: a sample of bounded size.

    What reaches the driver is at most per_document presence vectors of DIMS bits of each, whatever
    the length of the texts.
    """
    kind = documents.schema[key].dataType.simpleString()
    labelled = documents.select(F.col(key).alias("k"), label_code(F.col(label)).alias("l")).where("l is not null and k is not null")
    rank = F.row_number().over(W.partitionBy("l").orderBy(F.xxhash64("k"), "k"))
    chosen = labelled.withColumn("r", rank).where(F.col("r") <= per_language)
    chosen = chosen.groupBy("k").agg(F.min("l").alias("l"))
    rows = documents.select(F.col(key).alias("k"), F.make_valid_utf8(F.col(text)).alias("x")).join(F.broadcast(chosen), "k").select("k", "l", "x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in C.slices(batch, "x"):
                t = C.from_arrow(part.column(2))
                u = units(t)
                first, size = np.searchsorted(u.row, np.arange(part.num_rows)), np.bincount(u.row, minlength=part.num_rows)
                pick = [a + np.unique(np.linspace(0, n - 1, min(n, per_document)).astype(int)) for a, n in zip(first, size, strict=True)]
                taken = np.concatenate(pick)
                bits = [np.packbits(p, axis=1) for p in presence(t, Units(*(c[taken] for c in u)))]
                packed = np.concatenate(bits) if bits else np.zeros((0, DIMS // 8), np.uint8)
                ends = np.cumsum([0, *map(len, pick)]).astype(np.int32)
                values = pa.array([p.tobytes() for p in packed], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.ListArray.from_arrays(pa.array(ends), values)], ["k", "l", "units"]
                )

    cut = rows.mapInArrow(run, f"k {kind}, l string, units array<binary>").groupBy("k", "l").agg(F.min("units").alias("units")).collect()
    enough = {x for x in {r["l"] for r in cut} if x in SPELLINGS or sum(r["l"] == x for r in cut) >= MIN_LABELLED}
    pairs = [(r["l"], bytes(x)) for r in sorted(cut, key=lambda r: (r["l"], r["k"])) if r["l"] in enough for x in r["units"]]
    if not pairs:
        return None
    return train(np.frombuffer(b"".join(x for _, x in pairs), np.uint8).reshape(len(pairs), DIMS // 8), [x for x, _ in pairs])


def stretches(documents: DataFrame, key: str, text: str, model: Model | None) -> DataFrame:
    """row_key, seg_no, start_char, end_char, lang, n_words, confidence: the stretches of each document in one language."""
    source = documents.select(F.col(key).alias("row_key"), F.make_valid_utf8(F.col(text)).alias("row_text"))
    names = ["row_key", "seg_no", "start_char", "end_char", "lang", "n_words", "confidence"]
    schema = f"row_key {documents.schema[key].dataType.simpleString()}, seg_no int, start_char long, end_char long, lang string, n_words long, confidence double"
    if model is None:
        return documents.sparkSession.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages = pa.array(model.names)
        for batch in batches:
            for part in C.slices(batch, "row_text"):
                t = C.from_arrow(part.column(1))
                u, short = long_and_short(t)
                if not len(u.row):
                    continue
                score = scores(t, u, model)
                path = best_path(u, score)
                z = model.sharpness * (score - score.max(axis=1, keepdims=True))
                sure = (np.exp(z) / np.exp(z).sum(axis=1, keepdims=True))[np.arange(len(path)), path]
                fresh = np.ones(len(path), bool)
                fresh[1:] = (path[1:] != path[:-1]) | (u.row[1:] != u.row[:-1])
                first = np.flatnonzero(fresh)
                last = np.append(first[1:], len(path)) - 1
                scored = np.add.reduceat(u.words, first)
                n, start, end = scored.copy(), u.start[first], u.end[last]
                which, beside = around(u, path, short, scores(t, short, model))
                stretch = np.cumsum(fresh)[beside] - 1
                np.add.at(n, stretch, short.words[which])
                np.minimum.at(start, stretch, short.start[which])
                np.maximum.at(end, stretch, short.end[which])
                row = u.row[first]
                number = np.arange(len(first)) - np.searchsorted(row, row)
                columns = [
                    part.column(0).take(pa.array(row)), pa.array(number.astype(np.int32)), pa.array(start - t.off[row]), pa.array(end - t.off[row]),
                    languages.take(pa.array(path[first])), pa.array(n), pa.array(np.add.reduceat(sure * u.words, first) / scored),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)

    return source.mapInArrow(run, schema)


def p4_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stretch of running text of every document, with its language and confidence."""
    docs = table(spark, sf_dir, "documents")
    found = stretches(docs, "doc_id", "text", fit_sample(docs, "doc_id", "text", "lang"))
    return found.withColumnRenamed("row_key", "doc_id").withColumn("confidence", F.round("confidence", 4))


def p4_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its main language, confidence and share, beside the label it came with."""
    docs = table(spark, sf_dir, "documents")
    found = stretches(docs, "doc_id", "text", fit_sample(docs, "doc_id", "text", "lang"))
    by_lang = found.groupBy("row_key", "lang").agg(F.sum("n_words").alias("n"), F.sum(F.col("confidence") * F.col("n_words")).alias("c"))
    best = by_lang.groupBy("row_key").agg(F.max(F.struct("n", "c", "lang")).alias("m"), F.sum("n").alias("all"), F.count("*").alias("n_langs"))
    labelled = docs.select("doc_id", label_code(F.col("lang")).alias("label"))
    best = best.select(
        F.col("row_key").alias("doc_id"),
        F.col("m.lang").alias("lang"),
        F.round(F.col("m.c") / F.col("m.n"), 4).alias("confidence"),
        F.round(F.col("m.n") / F.col("all"), 4).alias("share"),
        "n_langs"
    )
    return labelled.join(best, "doc_id", "left").fillna(0.0, ["confidence"])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books with a stretch of STRETCH words in a language that no metadata row of the book names."""
    docs = table(spark, sf_dir, "documents")
    model = fit_sample(docs, "doc_id", "text", "lang")
    keyed = docs.where(F.col("gutenberg_id").isNotNull()).select("gutenberg_id", "text")
    held = stretches(keyed, "gutenberg_id", "text", model).where(
        (F.col("n_words") >= STRETCH) & F.col("lang").isin(*LANGS)
    ).select(F.col("row_key").alias("gutenberg_id"), "lang").distinct()
    named = table(spark, sf_dir, "metadata").select(
        plain_number(F.col("gutenberg_id")).alias("gutenberg_id"), F.explode(named_languages(F.col("language"))).alias("lang")
    ).distinct()
    return held.join(named, ["gutenberg_id", "lang"], "left_anti")
