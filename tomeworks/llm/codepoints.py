"""Text as numpy code-point arrays: table gathers, expansions, composition, words, n-grams.

A batch of texts is one uint32 array of code points plus row offsets. All work is done on the
whole array; no string function is called for a single row.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LIMIT = 0x110000
BLOCK = 1 << 20  # characters worked on at once where a step needs several numbers for each
LATIN, CYRILLIC, GREEK, OTHER = 1, 2, 3, 4

# Letters of one script that look like letters of another.
CYRILLIC_AS_LATIN = dict(zip("АВЕЅІЈКМНОРСТХУаеѕіјкорсухһԁԛԝӏЁЇёї", "ABESIJKMHOPCTXYaesijkopcyxhdqwlËÏëï", strict=True))
GREEK_AS_LATIN = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαγηικνορυχϲάίό", "ABEZHIKMNOPTYXaynikvopuxcáíó", strict=True))
GREEK_AS_CYRILLIC = dict(zip("ΑΒΓΕΗΚΜΟΠΡΤΦΧοραχ", "АВГЕНКМОПРТФХорах", strict=True))
ARMENIAN_AS_LATIN = dict(zip("ՕՏԼՍաոսհցզյօ", "OSLUwnuhgqjo", strict=True))
CHEROKEE_AS_LATIN = dict(zip("ᎠᎡᎢᎥᎩᎪᎫᎬᎳᎷᎻᎽᏀᏂᏃᏏᏒᏔᏕᏙᏚᏞᏟᏢᏦᏧᏳᏴ", "DRTiYAJEWMHYGhZbRWSVSLCPKdGB", strict=True))
LISU_AS_LATIN = dict(zip("ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU", strict=True))
COPTIC_AS_LATIN = dict(zip("ⲎⲒⲔⲘⲚⲞⲢⲤⲦⲨⲬⲓⲟⲣⲥⲭ", "HIKMNOPCTYXiopcx", strict=True))
LATIN_AS_LATIN = dict(zip("ɑɡɩꞮꟾ", "agiII", strict=True))

# Signs that are written in many ways and are left as they are.
KEPT_SIGNS = "'\"`´‘’‚‛“”„‟‹›«»ʼ′″…"


class Texts(NamedTuple):
    cp: np.ndarray  # uint32 code points of all rows
    off: np.ndarray  # int64 row offsets, one more than rows

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.off) - 1), np.diff(self.off))


def sums_between(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of values from each offset to the next."""
    out = np.zeros(len(off) - 1, np.int64)
    filled = np.flatnonzero(np.diff(off))
    if len(filled):
        out[filled] = np.add.reduceat(values, off[filled], dtype=np.int64)
    return out


def offsets(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))


def from_arrow(column: pa.Array | pa.ChunkedArray) -> Texts:
    """Code points of a string column; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return Texts(np.empty(0, np.uint32), np.zeros(1, np.int64))
    _, ends, data = column.buffers()
    at = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = bytes(memoryview(data)[at[0] : at[-1]]) if data is not None else b""
    cp = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
    first = np.frombuffer(raw, np.uint8)
    return Texts(cp, offsets(sums_between((first & 0xC0) != 0x80, at - at[0])))


def to_arrow(t: Texts, null_mask: np.ndarray | None = None) -> pa.Array:
    raw = t.cp.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    width = 1 + (t.cp >= 0x80).astype(np.uint8) + (t.cp >= 0x800) + (t.cp >= 0x10000)
    at = offsets(sums_between(width, t.off))
    out = pa.LargeStringArray.from_buffers(len(t.off) - 1, pa.py_buffer(at.astype(np.int64).tobytes()), pa.py_buffer(raw))
    if null_mask is not None and null_mask.any():
        out = pc.if_else(pa.array(~null_mask), out, pa.scalar(None, pa.large_string()))
    return out.cast(pa.string())


def slices(batch: pa.RecordBatch, *columns: str, chars: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts in the columns have about so many bytes; a longer row makes a run of its own."""
    size = sum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns)
    total = np.cumsum(size)
    start = 0
    while start < len(size):
        before = total[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(total, before + chars, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


class Table(NamedTuple):
    """What each code point becomes: nothing, one code point, or several."""

    single: np.ndarray
    count: np.ndarray
    start: np.ndarray
    data: np.ndarray

    @classmethod
    def of(cls, mapping: dict[int, str]) -> Table:
        single, count = np.arange(LIMIT, dtype=np.uint32), np.ones(LIMIT, np.uint8)
        start, data = np.zeros(LIMIT, np.uint32), []
        for c, text in mapping.items():
            count[c], start[c] = len(text), len(data)
            data += map(ord, text)
            if text:
                single[c] = ord(text[0])
        return cls(single, count, start, np.array(data or [0], np.uint32))

    def apply(self, t: Texts) -> Texts:
        n = self.count[t.cp]
        if (n == 1).all():
            return Texts(self.single[t.cp], t.off)
        parts = [self._expanded(t.cp[k : k + BLOCK], n[k : k + BLOCK]) for k in range(0, len(n), BLOCK)]
        return Texts(np.concatenate(parts), offsets(sums_between(n, t.off)))

    def _expanded(self, cp: np.ndarray, n: np.ndarray) -> np.ndarray:
        end = offsets(n)
        source = np.repeat(np.arange(len(cp)), n)
        cp = cp[source]
        many = np.flatnonzero(n[source] > 1)
        out = self.single[cp]
        out[many] = self.data[self.start[cp[many]] + (many - end[source[many]])]
        return out


def _kept(ch: str) -> bool:
    return ch in KEPT_SIGNS or unicodedata.category(ch) in ("Pd", "Pi", "Pf")


@cache
def assigned() -> list[tuple[int, str, str]]:
    """Number, character and category of every code point that has a meaning of its own, of the whole range."""
    return [(c, ch, kind) for c in range(LIMIT) if (kind := unicodedata.category(ch := chr(c))) not in ("Cn", "Co", "Cs")]


def _marks_and_signs() -> Iterator[tuple[int, str, str]]:
    """Those beyond ASCII."""
    return ((c, ch, kind) for c, ch, kind in assigned() if c >= 0x80)


def _invisible(c: int, kind: str) -> bool:
    return kind == "Cf" or 0xFE00 <= c <= 0xFE0F or 0xE0100 <= c <= 0xE01EF or c in (0x034F, 0x115F, 0x1160, 0x3164, 0xFFA0)


def _small_capital(ch: str) -> str | None:
    """The capital that a small capital looks like, by its name."""
    if ord(ch) < 0x250:
        return None
    found = re.fullmatch(r"LATIN LETTER SMALL CAPITAL ([A-Z])", unicodedata.name(ch, ""))
    return found and found.group(1)


@cache
def plain_table() -> tuple[Table, np.ndarray]:
    """The plain form of each code point, and which ones differ from the sign they look like."""
    mapping: dict[int, str] = {}
    odd = np.zeros(LIMIT, bool)
    for c, ch, kind in _marks_and_signs():
        if _kept(ch):
            continue
        if _invisible(c, kind):
            mapping[c], odd[c] = "", True
        elif kind == "Zs":
            mapping[c], odd[c] = " ", True
        elif twin := _small_capital(ch) or LATIN_AS_LATIN.get(ch):
            mapping[c], odd[c] = twin, True
        elif (d := unicodedata.decomposition(ch)) and (plain := unicodedata.normalize("NFKC", ch)) != ch:
            mapping[c] = plain
            odd[c] = not d.startswith(("<super>", "<sub>", "<fraction>"))
    odd[0x300:0x370] = True
    return Table.of(mapping), odd


@cache
def fold_table() -> Table:
    """Plain form with case folded, for comparing words."""
    table, _ = plain_table()
    mapping = {}
    for c, ch, _ in assigned():
        plain = "".join(map(chr, table.data[table.start[c] : table.start[c] + table.count[c]])) if table.count[c] != 1 else chr(table.single[c])
        folded = unicodedata.normalize("NFC", plain.casefold())
        if folded != ch:
            mapping[c] = folded
    return Table.of(mapping)


@cache
def combining() -> np.ndarray:
    out = np.zeros(LIMIT, np.uint8)
    for c, ch, kind in assigned():
        if kind[0] == "M":
            out[c] = unicodedata.combining(ch)
    return out


@cache
def pairs() -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys base << 21 | mark and the composed code points."""
    found = {}
    for c, ch, _ in _marks_and_signs():
        d = unicodedata.decomposition(ch)
        if d and d[0] != "<" and " " in d and unicodedata.normalize("NFC", ch) == ch:
            base, mark = (int(x, 16) for x in d.split())
            found[base << 21 | mark] = c
    keys = np.array(sorted(found), np.int64)
    return keys, np.array([found[k] for k in keys.tolist()], np.uint32)


def compose(t: Texts) -> Texts:
    """Canonical order of marks, then base and marks joined where a joined letter exists.

    Works on all runs of marks at once, by the mark's place in its run.
    """
    ccc = combining()[t.cp]
    if not ccc.any():
        return t
    cp = t.cp.copy()
    at = np.flatnonzero(ccc)
    row = np.searchsorted(t.off, at, side="right") - 1
    fresh = np.ones(len(at), bool)
    fresh[1:] = (np.diff(at) > 1) | (row[1:] != row[:-1])
    run = np.cumsum(fresh) - 1
    order = np.lexsort((np.arange(len(at)), ccc[at], run))
    cp[at] = cp[at[order]]
    ccc = ccc.copy()
    ccc[at] = ccc[at[order]]
    first = at[fresh]
    base = first - 1
    usable = base >= t.off[row[fresh]]
    place = np.arange(len(at)) - np.flatnonzero(fresh)[run]
    last = np.zeros(len(first), np.int64)
    keep = np.ones(len(cp), bool)
    keys, made = pairs()
    for at_place in np.split(np.argsort(place, kind="stable"), np.cumsum(np.bincount(place))[:-1]):
        pos, r = at[at_place], run[at_place]
        free = usable[r] & ((last[r] == 0) | (last[r] < ccc[pos]))
        key = cp[np.maximum(base[r], 0)].astype(np.int64) << 21 | cp[pos]
        i = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        hit = free & (keys[i] == key)
        cp[base[r[hit]]] = made[i[hit]]
        keep[pos[hit]] = False
        last[r[~hit]] = ccc[pos[~hit]]
    return Texts(cp[keep], t.off - np.searchsorted(np.flatnonzero(~keep), t.off))


@cache
def scripts() -> tuple[np.ndarray, np.ndarray]:
    """The script of each letter; and for each target script what a letter of another looks like there (0: nothing)."""
    script = np.zeros(LIMIT, np.uint8)
    for c, ch, kind in assigned():
        if kind[0] == "L" and ch not in "ªº":
            name = unicodedata.name(ch, "")
            script[c] = LATIN if "LATIN" in name else CYRILLIC if name.startswith("CYRILLIC") else GREEK if name.startswith("GREEK") else OTHER
    alike = np.zeros((5, LIMIT), np.uint32)
    for table, a, b in ((CYRILLIC_AS_LATIN, CYRILLIC, LATIN), (GREEK_AS_LATIN, GREEK, LATIN), (GREEK_AS_CYRILLIC, GREEK, CYRILLIC)):
        for x, y in table.items():
            alike[b][ord(x)] = ord(y)
            alike[a][ord(y)] = alike[a][ord(y)] or ord(x)
    for table in (ARMENIAN_AS_LATIN, CHEROKEE_AS_LATIN, LISU_AS_LATIN, COPTIC_AS_LATIN):
        for x, y in table.items():
            alike[LATIN][ord(x)] = ord(y)
    return script, alike


def one_script(t: Texts) -> tuple[Texts, np.ndarray]:
    """Letters that stray into a word or text of another script, replaced; and which rows had any."""
    script, alike = scripts()
    s = script[t.cp]
    n_rows = len(t.off) - 1
    flagged = np.zeros(n_rows, bool)
    foreign = s > LATIN
    if not foreign.any():
        return t, flagged
    row = t.rows
    per_row = np.zeros((n_rows, 5), np.int64)
    single = np.zeros(len(s), bool)  # letters that look like none of another script
    letters = s > 0
    for k in (LATIN, CYRILLIC, GREEK, OTHER):
        mine = s == k
        others = [x for x in (LATIN, CYRILLIC, GREEK) if x != k]
        single |= mine & ~np.any([alike[x][t.cp] > 0 for x in others], axis=0)
    for k in (LATIN, CYRILLIC, GREEK, OTHER):
        per_row[:, k] = np.bincount(row[single & (s == k)], minlength=n_rows) * 1000 + np.bincount(row[s == k], minlength=n_rows)
    main = np.argmax(per_row, axis=1)
    at = np.flatnonzero(letters)
    fresh = np.ones(len(at), bool)
    fresh[1:] = (np.diff(at) > 1) | (row[at[1:]] != row[at[:-1]])
    word = np.cumsum(fresh) - 1
    n_words = word[-1] + 1
    counts = np.stack([np.zeros(n_words)] + [np.bincount(word[s[at] == k], minlength=n_words) for k in (1, 2, 3, 4)], axis=1)
    sure = np.stack([np.zeros(n_words)] + [np.bincount(word[(s[at] == k) & single[at]], minlength=n_words) for k in (1, 2, 3, 4)], axis=1)
    home = main[row[at[fresh]]]
    weight = sure * 1e6 + counts
    weight[np.arange(n_words), home] += np.where(counts[np.arange(n_words), home] > 0, 5e5, 0)
    target = np.argmax(weight, axis=1)
    mixed = (counts > 0).sum(axis=1) > 1
    # A word wholly of letters that have a twin in the text's own script is of that script.
    own = np.argmax(counts, axis=1)
    stray = ~mixed & (own != home) & (home > 0) & (sure.sum(axis=1) == 0)
    numeral = np.isin(t.cp[at], np.frombuffer("IVXLCDM".encode("utf-32-le"), np.uint32))
    stray &= ~((own == LATIN) & (np.bincount(word[numeral], minlength=n_words) == counts[:, LATIN]))
    target[stray] = home[stray]
    act = (mixed | stray)[word]
    pos, goal = at[act], target[word[act]]
    cp = t.cp.copy()
    twin = alike[goal, cp[pos]]
    wrong = s[pos] != goal
    change = wrong & (twin > 0)
    cp[pos[change]] = twin[change]
    flagged[row[pos[wrong]]] = True
    return Texts(cp, t.off), flagged


def spans(t: Texts, start: np.ndarray, end: np.ndarray) -> Texts:
    """The characters from each start to its end, as texts of their own."""
    length = end - start
    off = offsets(length)
    return Texts(t.cp[np.repeat(start - off[:-1], length) + np.arange(off[-1])], off)


def take(t: Texts, rows: np.ndarray) -> Texts:
    return t if len(rows) == len(t.off) - 1 else spans(t, t.off[rows], t.off[rows + 1])


def put(t: Texts, rows: np.ndarray, new: Texts) -> Texts:
    """t with the given rows replaced by the rows of new."""
    if len(rows) == len(t.off) - 1:
        return new
    length, start = np.diff(t.off), t.off[:-1].copy()
    length[rows], start[rows] = np.diff(new.off), len(t.cp) + new.off[:-1]
    off = np.concatenate(([0], np.cumsum(length)))
    return Texts(np.concatenate((t.cp, new.cp))[np.repeat(start - off[:-1], length) + np.arange(off[-1])], off)


def level(t: Texts) -> tuple[Texts, np.ndarray]:
    """One consistent form of each text, and which rows held a look-alike character.

    Rows of common characters only are not touched.
    """
    table, odd = plain_table()
    script, _ = scripts()
    flagged = np.zeros(len(t.off) - 1, bool)
    notable = np.flatnonzero(_notable()[t.cp])
    if not len(notable):
        return t, flagged
    rows = np.unique(np.searchsorted(t.off, notable, side="right") - 1)
    part = take(t, rows)
    found = np.zeros(len(rows), bool)
    hit = odd[part.cp]
    if hit.any():
        found[part.rows[hit]] = True
    if (hit | (table.count[part.cp] != 1) | (table.single[part.cp] != part.cp)).any():
        part = compose(table.apply(part))
    part, strayed = one_script(part)
    flagged[rows] = found | strayed
    return put(t, rows, part), flagged


@cache
def _notable() -> np.ndarray:
    table, odd = plain_table()
    script, _ = scripts()
    return odd | (table.count != 1) | (table.single != np.arange(LIMIT)) | (script > LATIN) | (combining() > 0)


# Words and n-grams

SEPARATOR, WORD, DROPPED, HYPHEN, BLANK = 0, 1, 2, 3, 4
ODD1, ODD2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


@cache
def classes() -> np.ndarray:
    out = np.zeros(LIMIT, np.uint8)
    for c, ch, kind in assigned():
        if kind[0] in "LN" or kind in ("Mn", "Mc"):
            out[c] = WORD
        elif ch in "'’‘ʼ":
            out[c] = DROPPED
        elif ch in "-‐‑":
            out[c] = HYPHEN
        elif ch.isspace():
            out[c] = BLANK
    out[0xAD] = HYPHEN
    return out


@cache
def line_ends() -> np.ndarray:
    out = np.zeros(LIMIT, bool)
    out[[ord(c) for c in "\n\r\v\f\x85\u2028\u2029"]] = True
    return out


class Words(NamedTuple):
    hash: np.ndarray  # uint64 per word
    row: np.ndarray  # row of each word, ascending
    chars: np.ndarray  # letters in each word
    first: np.ndarray  # place of its first letter in the code points
    end: np.ndarray  # place after its last letter


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * ODD1
    x = x ^ (x >> np.uint64(29))
    x = x * ODD2
    return x ^ (x >> np.uint64(32))


def _filled(size: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """True from each start to its end."""
    edge = np.zeros(size + 1, np.int8)
    edge[start] += 1
    edge[end] -= 1
    return np.cumsum(edge[:-1], dtype=np.int8) > 0


def _next(places: np.ndarray, at: np.ndarray, none: int) -> np.ndarray:
    """The first of the sorted places that is not before each of at."""
    i = np.searchsorted(places, at)
    return np.append(places, none)[i]


def markup_mask(t: Texts) -> np.ndarray:
    """Which characters belong to tags (a "<" with a letter, "/", "!" or "?" behind it, to the next ">") or to numbers in brackets.

    Tags and numbers may be of any length and hold any characters, line breaks too, but lie in one row.
    """
    cp, n = t.cp, len(t.cp)
    out = np.zeros(n, bool)
    # Found among the signs alone, which are few.
    sign = np.flatnonzero((cp == ord("<")) | (cp == ord(">")))
    start = sign[:-1][(cp[sign[:-1]] == ord("<")) & (cp[sign[1:]] == ord(">"))] if len(sign) > 1 else sign[:0]
    if len(start):
        end = _next(sign, start + 1, n)
        behind = cp[start + 1]
        ok = (scripts()[0][behind] > 0) | np.isin(behind, [ord(c) for c in "/!?"])
        ok &= np.searchsorted(t.off, start, side="right") == np.searchsorted(t.off, end, side="right")
        out |= _filled(n, start[ok], end[ok] + 1)
    for opening, closing in ("[]", "{}"):
        start = np.flatnonzero(cp == ord(opening))
        if not len(start):
            continue
        end = _next(np.flatnonzero((cp < ord("0")) | (cp > ord("9"))), start + 1, n)
        ok = (end > start + 1) & (end < n)
        ok[ok] = cp[end[ok]] == ord(closing)
        ok &= np.searchsorted(t.off, start, side="right") == np.searchsorted(t.off, end, side="right")
        out |= _filled(n, start[ok], end[ok] + 1)
    return out


def words(t: Texts, markup: bool = False) -> Words:
    """The words of folded texts.

    Apostrophes and hyphens within a word, and a hyphen with the line break and all blanks after
    it, join their two sides. With markup, tags and bracketed numbers count as nothing.
    """
    cp, n = t.cp, len(t.cp)
    kind = classes()[cp]
    if markup:
        kind[markup_mask(t)] = SEPARATOR
    hyphens = np.flatnonzero(kind == HYPHEN)
    if len(hyphens):
        end = t.off[np.searchsorted(t.off, hyphens, side="right")]
        before = (hyphens > 0) & (kind[np.maximum(hyphens - 1, 0)] == WORD)
        after = _next(np.flatnonzero(kind != BLANK), hyphens + 1, n)
        broken = _next(np.flatnonzero(line_ends()[cp]), hyphens + 1, n) < after
        inside = before & (after < end) & (kind[np.minimum(after, n - 1)] == WORD) & ((after == hyphens + 1) | broken)
        kind[hyphens[~inside]] = SEPARATOR
        kind[_filled(n, hyphens[inside], after[inside])] = DROPPED
    # Blocks end where neither a word nor a sign within one stands, or where a row ends.
    parts, a = [], 0
    while a < n:
        b = min(n, a + BLOCK)
        if b < n:
            loose = np.flatnonzero((kind[a:b] != WORD) & (kind[a:b] != DROPPED))
            edge = t.off[np.searchsorted(t.off, b, side="right") - 1]
            b = max(a + loose[-1] + 1 if len(loose) else a, edge)
            if b == a:  # one word longer than a block
                loose = np.flatnonzero((kind[a:] != WORD) & (kind[a:] != DROPPED))
                b = min(a + loose[0] + 1 if len(loose) else n, t.off[np.searchsorted(t.off, a, side="right")])
        parts.append(_words_of(cp[a:b], kind[a:b], t.off, a))
        a = b
    if not parts:
        none = np.empty(0, np.int64)
        return Words(np.empty(0, np.uint64), none, none, none, none)
    return Words(*map(np.concatenate, zip(*parts, strict=True)))


def _words_of(cp: np.ndarray, kind: np.ndarray, off: np.ndarray, base: int) -> tuple[np.ndarray, ...]:
    """hash, row, chars, first, end of the words of a block that begins at base."""
    keep = np.flatnonzero(kind != DROPPED)
    is_word = kind[keep] == WORD
    letters = keep[is_word]
    if not len(letters):
        none = np.empty(0, np.int64)
        return np.empty(0, np.uint64), none, none, none, none
    # A row that begins with a dropped sign still begins a word at its first kept sign.
    edges = np.searchsorted(keep, off - base)
    begin = is_word.copy()
    begin[1:] &= ~is_word[:-1]
    edges = edges[edges < len(keep)]
    begin[edges] |= is_word[edges]
    first = np.flatnonzero(begin[is_word])
    length = np.diff(np.append(first, len(letters)))
    place = np.arange(len(letters)) - np.repeat(first, length)
    power = np.cumprod(np.full(int(length.max()), ODD1 | np.uint64(1), np.uint64))
    h = np.add.reduceat((cp[letters].astype(np.uint64) + np.uint64(1)) * ODD2 * power[place], first)
    start = letters[first] + base
    return mix(h + length.astype(np.uint64)), np.searchsorted(off, start, side="right") - 1, length, start, letters[first + length - 1] + base + 1


def ngrams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of n words within a row, and the number of its first word."""
    count = len(w.hash) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    out = np.zeros(count, np.uint64)
    for k in range(n):
        out = out * (ODD1 | np.uint64(1)) + w.hash[k : k + count]
    at = np.flatnonzero(w.row[:count] == w.row[n - 1 :])
    return mix(out[at]), at
