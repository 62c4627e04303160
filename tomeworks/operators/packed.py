"""Several values packed in one field: one value per row, with its position.

Delimiters are inferred per source. A cell is cut into atoms at every candidate delimiter outside
quotes; each candidate is scored per source and field by how regular the pieces are that it makes
(a value known from cells of its own, or of the form of a name) and how consistent their count is.
Candidates below MIN_SCORE are not used in that source. With the others, names are put together by
their form ("Last, First, Title", "First Last", houses), labels by the cut into most pieces that
are all known from cells of their own. Words that may close a name behind an and-sign or a second
comma (titles, "Sons", "Publishers") are learned from where they stand last: those with TAIL_SHARE
of all such places in the field.

Cells of one value that can be told by their form alone (no delimiter at all, or one word, a comma
and a rest) never leave the JVM. All others are cut once to score the delimiters and once to give
the values, from Arrow batches, without a shuffle; equal cells of a batch are worked on once.

Defined results: null and blank cells and stand-ins for "not known" have no values; empty pieces
are no values and take no position; quotes and brackets around a value or list are removed, all
else stays as stored; a null source is a source of its own; rows repeated whole come out repeated;
an empty table gives no rows; columns other than those named are not looked at.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomeworks.session import materialize, small_or_none

MIN_SCORE = {"name": 0.5, "label": 0.05, "label-sign": 0.001}  # commas and and-signs of labels are also judged cell by cell
PRIOR = 5.0  # cells of the whole field that each source's score is mixed with
TAIL_SHARE = 0.001
DICTIONARY = (50_000, 4 << 20)  # labels, and characters in them, up to which the dictionary goes to the tasks whole
SOURCES = 10_000  # sources and fields up to which the chosen delimiters do
HARD = ";|/\n+"
BREAK = re.compile(r"[;|/\n+,]|\s+(?:and|&)\s+")
GAP = re.compile(r"[^\S\n]*")
CLOSE = {'"': re.compile(r'"\s*(?=[;|/\n+,\]]|(?:and|&)\s|$)'), "'": re.compile(r"'\s*(?=[;|/\n+,\]]|(?:and|&)\s|$)")}
WHITE = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
# Fixed values.
STAND_INS = frozenset(("n/a", "unknown", "none", "null", "-", "?", "[not known]"))


def plain_word(word: str) -> str:
    """A word for comparison: no invisible signs, one width, lower case, no full stop."""
    if not word.isascii():
        word = "".join(c for c in unicodedata.normalize("NFKC", word) if unicodedata.category(c) != "Cf")
    return word.lower().strip(".,")


class Piece(NamedTuple):
    text: str
    quoted: bool
    before: str  # the delimiter in front of it
    start: int
    end: int


AND = re.compile(r"(?:and|&)\s+")


def cut(cell: str) -> tuple[str, list[Piece]]:
    """The cell without the brackets around it, and its pieces at all candidate delimiters outside quotes."""
    text = cell.strip()
    if text.startswith("[") and text.endswith("]"):
        text = text[1:-1]
    out, pos, before = [], 0, ""
    while pos <= len(text):
        pos = GAP.match(text, pos).end()
        mark = text[pos : pos + 1]
        closing = CLOSE[mark].search(text, pos + 1) if mark in ('"', "'") else None
        if closing:
            start, end = pos + 1, closing.start()
            pos = closing.end()
            m = BREAK.match(text, pos) or AND.match(text, pos)
        else:
            m = BREAK.search(text, pos)
            start, end = pos, m.start() if m else len(text)
        if closing:
            start = GAP.match(text, start).end()
        piece = text[start:end].strip()
        out.append(Piece(piece, closing is not None, before, start, start + len(piece)))
        if not m:
            break
        sign = m.group().strip()
        before, pos = ("&" if sign in ("and", "&") else sign or "\n", m.end())
    return text, out


def parts_of(pieces: list[Piece], hard: str) -> list[list[Piece]]:
    """Pieces grouped between hard delimiters; a quoted piece stands alone. Groups of nothing are left out."""
    groups: list[list[Piece]] = []
    for i, p in enumerate(pieces):
        alone = p.quoted or (i and pieces[i - 1].quoted)
        if not groups or (p.before and p.before in hard) or alone:
            groups.append([p])
        else:
            groups[-1].append(p)
    return [g for g in groups if any(p.text for p in g)]


def rejoin(text: str, pieces: list[Piece]) -> str:
    """The stored text from the first to the last of neighbouring pieces."""
    return text[pieces[0].start : pieces[-1].end].strip()


def one_word(text: str) -> bool:
    return len(text.split()) == 1


def tail_of(part: list[Piece]) -> str | None:
    """The word in the place of a title or a house's ending, if the part has one."""
    p = [x for x in part if x.text]
    if len(p) < 2 or p[-1].quoted or not one_word(p[-1].text):
        return None
    house = p[-1].before == "&" or (len(p) > 2 and p[-1].before == "," and p[-2].before == "&" and one_word(p[-2].text))
    title = len(p) == 3 and p[1].before == p[2].before == "," and one_word(p[0].text)
    return plain_word(p[-1].text) if house or title else None


def name_groups(pieces: list[Piece], use_and: bool, tails: frozenset[str]) -> list[list[Piece]]:
    """Neighbouring pieces grouped to names by their form; tails: words that may close a name."""
    pieces = [p for p in pieces if p.text]
    chunks: list[list[list[Piece]]] = []  # between and-signs: between commas: pieces
    for i, p in enumerate(pieces):
        if chunks and p.before == "&":
            follows = i + 1 < len(pieces) and pieces[i + 1].before == ","
            tail = one_word(p.text) and (not follows or plain_word(p.text) in tails)
            lone = len(chunks[-1]) == 1 and len(chunks[-1][0]) == 1 and one_word(chunks[-1][0][0].text)
            if tail or lone or not use_and:
                chunks[-1][-1].append(p)
            else:
                chunks.append([[p]])
        elif chunks:
            chunks[-1].append([p])
        else:
            chunks.append([[p]])
    names: list[list[Piece]] = []
    for chunk in chunks:
        i = 0
        while i < len(chunk):
            take = 2 if len(chunk[i]) == 1 and one_word(chunk[i][0].text) and i + 1 < len(chunk) else 1
            while i + take < len(chunk):
                nxt = chunk[i + take]
                short = len(nxt) == 1 and one_word(nxt[0].text)
                if short and (plain_word(nxt[0].text) in tails or i + take + 1 == len(chunk)):
                    take += 1
                else:
                    break
            names.append([p for c in chunk[i : i + take] for p in c])
            i += take
    return names


def regular_name(text: str) -> bool:
    """A house, "Last, First" or two and more words, of letters."""
    return any(c.isalpha() for c in text) and (len(text.split()) > 1) and not any(c in ";|/\n+" for c in text)


class Known(NamedTuple):
    """Labels known from cells of their own."""

    labels: frozenset[str]
    longest: int

    @classmethod
    def of(cls, labels) -> Known:
        labels = frozenset(labels or ())
        return cls(labels, max(map(len, labels), default=0))


def label_cut(atoms: list[str], known: Known) -> list[int] | None:
    """Lengths of the most pieces into which atoms can be cut so that all are known; the text of a piece
    is that of its atoms and the delimiters between them, which stand at odd places. None if there is no such cut."""
    n = (len(atoms) + 1) // 2
    best: list[tuple[int, int] | None] = [(0, 0)] + [None] * n
    for end in range(1, n + 1):
        for size in range(1, end + 1):
            start, span = best[end - size], "".join(atoms[2 * (end - size) : 2 * end - 1]).strip()
            if len(span) > known.longest:
                break
            if start is not None and span in known.labels and (best[end] is None or start[0] + 1 > best[end][0]):
                best[end] = (start[0] + 1, size)
    if best[n] is None:
        return None
    out, at = [], n
    while at:
        out.append(best[at][1])
        at -= best[at][1]
    return out[::-1]


SOFT_CUT = {",": r"\s*,\s*", "&": r"\s+(?:and|&)\s+", " ": r"\s+"}


def soft_atoms(text: str, delimiters: str) -> list[str]:
    """Atoms of a label and the delimiters between them, as stored."""
    chosen = [SOFT_CUT[d] for d in (",", "&", " ") if d in delimiters]
    return re.split("(" + "|".join(chosen) + ")", text) if chosen else [text]


@lru_cache(1 << 16)
def soft_cut(text: str, delimiters: str, known: Known) -> tuple[list[str], list[int] | None]:
    """The atoms of a label and the cut of them; the same parts return in many cells."""
    atoms = soft_atoms(text, delimiters)
    return atoms, label_cut(atoms, known)


def spans_of(atoms: list[str], limit: int) -> set[str]:
    n = (len(atoms) + 1) // 2
    return {"".join(atoms[2 * i : 2 * (i + size) - 1]).strip() for i in range(n) for size in range(1, min(limit, n - i) + 1)}


def _hard_parts(cell: str) -> list[str]:
    """Stored text of each part of a label cell between hard delimiters."""
    text, pieces = cut(cell)
    return [rejoin(text, g) for g in parts_of(pieces, HARD)]


def stats_of(cell: str, kind: str, known: Known) -> tuple[list[tuple[str, int, float]], list[str]]:
    """For each candidate delimiter in a cell: (delimiter, pieces, share of regular pieces); and the words that stand where a name may be closed."""
    text, pieces = cut(cell)
    out = []
    present = {p.before for p in pieces[1:]}
    for d in present & set(HARD):
        good = []
        for g in parts_of(pieces, d):
            first = parts_of(g, HARD)[0]  # what other delimiters cut off is judged under them
            whole = rejoin(text, first)
            good.append(first[0].quoted or (regular_name(whole) if kind == "name" else soft_cut(whole, ",&", known)[1] is not None))
        if good:
            out.append((d, len(good), sum(good) / len(good)))
    parts = parts_of(pieces, HARD)
    if kind == "name":
        if "&" in present:
            names = [n for g in parts for n in name_groups(g, True, frozenset())]
            out.append(("&", len(names), sum(n[0].quoted or regular_name(rejoin(text, n)) for n in names) / max(1, len(names))))
        return out, [w for g in parts if (w := tail_of(g))]
    for g in parts:
        if not g[0].quoted:
            for d in (",", "&", " "):
                atoms, lengths = soft_cut(rejoin(text, g), d, known)
                if len(atoms) > 1:
                    n = len(lengths or [1])
                    out.append((d, n, float(n > 1)))
    return out, []


def values_of(cell: str, kind: str, delimiters: str, known: Known, tails: frozenset[str] = frozenset()) -> list[str]:
    hard = "".join(d for d in delimiters if d in HARD)
    text, pieces = cut(cell)
    if kind == "name":
        groups = [n for g in parts_of(pieces, hard) for n in ([g] if g[0].quoted else name_groups(g, "&" in delimiters, tails))]
        return [v for v in (rejoin(text, g) for g in groups if any(p.text for p in g)) if v]
    out = []
    for g in parts_of(pieces, hard):
        whole = rejoin(text, g)
        if g[0].quoted:
            out.append(whole)
            continue
        atoms, lengths = soft_cut(whole, delimiters, known)
        at = 0
        for size in lengths or [(len(atoms) + 1) // 2]:
            out.append("".join(atoms[2 * at : 2 * (at + size) - 1]).strip())
            at += size
    return [v for v in out if v]


def _told_by_form(kind: Column) -> Column:
    """A cell t that is one value whatever the delimiters are."""
    plain = r"^[^;|/\n+,\"\[']" + r"[^;|/\n+,\"\[]*$"
    word, gap, rest = r"[^\s;|/+,\"\['&][^\s;|/+,\"\[&]*", r"[\s&&[^\n]]*", r"[^\s;|/+,\"\['][^;|/\n+,\"\[]*"
    signs = F.col("t").rlike(r"(?U)\s(and|&)\s")
    name = F.col("t").rlike(f"(?U){plain}|^{word}{gap},{gap}{rest}$") & ~signs
    label = F.col("t").rlike(plain) & ~F.col("t").rlike(r"(?U)\s")
    return F.when(kind == "label", label).otherwise(name)


def _dictionary(cells: DataFrame) -> tuple[DataFrame, dict[str, Known] | None]:
    """The labels of cells of their own (f, span), and by field where they are few enough to go to the tasks."""
    alone = cells.where((F.col("kind") == "label") & ~F.col("t").rlike(r"[;|/\n+\"\[]|^'")).select("f", F.col("t").alias("span")).distinct()
    alone = materialize(alone, "labels")
    size = alone.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("span")), F.lit(0)).alias("c")).first()
    if size["n"] > DICTIONARY[0] or size["c"] > DICTIONARY[1]:
        return alone, None
    by_field = defaultdict(set)
    for r in alone.collect():
        by_field[r["f"]].add(r["span"])
    return alone, {f: Known.of(x) for f, x in by_field.items()}


def _with_known(todo: DataFrame, alone: DataFrame, key_type: str) -> DataFrame:
    """todo with the labels known of each cell, for a dictionary that is too large to go to the tasks: by a join with the spans of its atoms."""
    n_atoms = F.size(F.split("span", "(?U)" + "|".join(SOFT_CUT.values())))
    limits = {r["f"]: r["n"] for r in alone.groupBy("f").agg(F.max(n_atoms).alias("n")).collect()}  # of the longest label of each field

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            rows: list[tuple[int, str]] = []
            for i, (f, c) in enumerate(zip(x.column(1).to_pylist(), x.column(2).to_pylist(), strict=True)):
                n = limits.get(f, 0)
                rows += [(i, s) for t in _hard_parts(c) for s in spans_of(soft_atoms(t, ",&"), n) | spans_of(soft_atoms(t, ",& "), n)]
            at = pa.array([i for i, _ in rows], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [x.column(0).take(at), x.column(1).take(at), pa.array([s for _, s in rows], pa.string())], ["k", "f", "span"]
            )

    wanted = todo.where("kind = 'label'").select("k", "f", "t").mapInArrow(spans, f"k {key_type}, f string, span string").distinct()
    known = wanted.join(alone, ["f", "span"], "left_semi").groupBy("k", "f").agg(F.collect_set("span").alias("known"))
    return materialize(todo.join(known, ["k", "f"], "left"), "packed")


def _known_of(x: pa.RecordBatch, known: dict[str, Known] | None) -> list[Known]:
    """What is known of each row's cell."""
    nothing = Known.of(())
    if known is not None:
        return [known.get(f, nothing) for f in x.column("f").to_pylist()]
    return [Known.of(v) if v else nothing for v in x.column("known").to_pylist()]


def split_packed(df: DataFrame, key: str, source: str, fields: dict[str, str]) -> DataFrame:
    """key, field_name, pos, value, n_values: every value of the given fields ("name" or "label" each)."""
    key_type = df.schema[key].dataType.simpleString()
    kinds = F.create_map(*(F.lit(x) for f, k in fields.items() for x in (f, k)))
    pairs = F.explode(
        F.array(*(F.struct(F.lit(f).alias("f"), F.lit(k).alias("kind"), F.col(f).cast("string").alias("c")) for f, k in fields.items()))
    )
    cells = df.select(F.col(key).alias("k"), F.col(source).cast("string").alias("s"), pairs.alias("p")).select(
        "k", "s", "p.f", "p.kind", F.btrim(F.make_valid_utf8("p.c"), F.lit(WHITE)).alias("t")
    )
    cells = cells.where((F.col("t") != "") & ~F.lower("t").isin(*STAND_INS))
    told = _told_by_form(F.col("kind"))
    todo = cells.where(~told)
    alone, known = _dictionary(cells) if "label" in fields.values() else (None, {})
    if known is None:
        todo = _with_known(todo, alone, key_type)
    columns = ["s", "f", "kind", "t", *(["known"] if known is None else [])]

    def stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once = lru_cache(1 << 14)(stats_of)
        for x in batches:
            sums: dict[tuple, list[float]] = defaultdict(lambda: [0, 0.0, 0, 0])
            for s, f, kind, c, own in zip(*(x.column(i).to_pylist() for i in range(4)), _known_of(x, known), strict=True):
                found, ends = once(c, kind, own) if known is not None else stats_of(c, kind, own)
                for d, n, r in found:
                    row = sums[s, f, d]
                    row[0] += 1
                    row[1] += r
                    row[2] += n
                    row[3] += n * n
                for w in ends:
                    sums[None, f, "tail " + w][0] += 1
            keys, values = list(sums), list(sums.values())
            yield pa.RecordBatch.from_arrays(
                [*(pa.array([k[i] for k in keys], pa.string()) for i in range(3)), *(pa.array([v[i] for v in values], pa.float64()) for i in range(4))], ["s", "f", "d", "cells", "r", "n", "nn"]
            )

    names = ("cells", "r", "n", "nn")
    by_source = todo.select(*columns).mapInArrow(
        stats, "s string, f string, d string, cells double, r double, n double, nn double"
    ).groupBy("s", "f", "d").agg(*(F.sum(c).alias(c) for c in names))
    by_source = materialize(by_source, "packed-scores")
    is_tail = F.col("d").startswith("tail ")
    ends = by_source.where(is_tail).select("f", F.substring("d", 6, 1 << 30).alias("w"), "cells")
    all_ends = ends.groupBy("f").agg(F.sum("cells").alias("all"))
    # At most 1 / TAIL_SHARE words of each field.
    frequent = ends.join(F.broadcast(all_ends), "f").where((F.col("cells") >= 2) & (F.col("cells") >= TAIL_SHARE * F.col("all"))).collect()
    tails = {f: frozenset(r["w"] for r in frequent if r["f"] == f) for f in fields}
    by_source = by_source.where(~is_tail)
    whole = by_source.groupBy("f", "d").agg(*(F.sum(c).alias("w_" + c) for c in names))
    scored = by_source.join(whole, ["f", "d"])
    mixed = {c: F.col(c) + F.lit(PRIOR) * F.col("w_" + c) / F.col("w_cells") for c in ("r", "n", "nn")}
    size = F.col("cells") + F.lit(PRIOR)
    mean, square = mixed["n"] / size, mixed["nn"] / size
    consistency = 1 / (1 + F.greatest(square - mean * mean, F.lit(0.0)) / (mean * mean))
    limit = F.when(kinds[F.col("f")] == "name", MIN_SCORE["name"]).when(
        F.col("d").isin(",", "&"), MIN_SCORE["label-sign"]
    ).otherwise(MIN_SCORE["label"])
    chosen = scored.withColumn("score", mixed["r"] / size * consistency).where(F.col("score") >= limit)
    chosen = chosen.groupBy(F.col("s").alias("cs"), F.col("f").alias("cf")).agg(
        F.array_join(F.array_sort(F.collect_set("d")), "").alias("delimiters")
    )
    few = small_or_none(chosen, SOURCES)
    of_source = None if few is None else {(r["cs"], r["cf"]): r["delimiters"] for r in few}
    if few is None:
        todo = todo.join(chosen, todo["s"].eqNullSafe(chosen["cs"]) & (todo["f"] == chosen["cf"]), "left")
        columns = [*columns, "delimiters"]

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once = lru_cache(1 << 14)(values_of)
        for x in batches:
            s, f, kind, t = (x.column(c).to_pylist() for c in ("s", "f", "kind", "t"))
            cut_at = x.column("delimiters").to_pylist() if of_source is None else [of_source.get(p) for p in zip(s, f, strict=True)]
            use = once if known is not None else values_of
            lists = [
                use(c, k, d or "", own, tails.get(g, frozenset())) for c, k, d, own, g in zip(t, kind, cut_at, _known_of(x, known), f, strict=True)
            ]
            yield pa.RecordBatch.from_arrays([x.column("k"), x.column("f"), pa.array(lists, pa.list_(pa.string()))], ["k", "f", "v"])

    split = todo.select("k", *columns).mapInArrow(values, f"k {key_type}, f string, v array<string>")
    single = cells.where(told).select("k", "f", F.array("t").alias("v"))
    out = split.unionByName(single).select("k", "f", F.size("v").alias("n_values"), F.posexplode("v").alias("pos", "value"))
    return out.select(F.col("k").alias(key), F.col("f").alias("field_name"), (F.col("pos") + 1).cast("long").alias("pos"), "value", "n_values")
