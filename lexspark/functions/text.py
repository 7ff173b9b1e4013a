"""Text functions as native expressions, and the one that needs Python (normalisation with an offset map)."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from lexspark import fixed


@cache
def _accents() -> tuple[str, str]:
    """Latin letters with marks, and the letters without, from the Unicode decompositions."""
    pairs = [(chr(c), d[0]) for c in range(0xC0, 0x250) if len(d := unicodedata.normalize("NFD", chr(c))) > 1 and all(unicodedata.category(x) == "Mn" for x in d[1:])]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def unaccent(c: Column) -> Column:
    """Latin letters without their marks; length-preserving for composed text. Loose combining marks go."""
    return F.translate(F.regexp_replace(c, r"\p{Mn}+", ""), *_accents())


def fold(c: Column) -> Column:
    return F.lower(unaccent(c))


def phrase(c: Column) -> Column:
    """Folded words of a-z and 0-9, one blank between."""
    return F.trim(F.regexp_replace(fold(c), "[^a-z0-9]+", " "))


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def collapse(c: Column) -> Column:
    """Inner runs of white space as one blank; a blank at an edge stays one blank."""
    return F.regexp_replace(c, r"(?U)\s+", " ")


def number_key(number: Column, uf: Column | None = None) -> Column:
    """Digits without leading zeros ("0" if none are left), then |UF if there is one."""
    d = F.regexp_replace(digits(number), "^0+", "")
    d = F.when(d == "", "0").otherwise(d)
    return d if uf is None else F.when(uf.isNull() | (uf == ""), d).otherwise(F.concat(d, F.lit("|"), F.upper(uf)))


def distance(a: Column, b: Column) -> Column:
    """Levenshtein distance over b's length; 1 if b is empty."""
    return F.when(F.length(b) == 0, F.lit(1.0)).otherwise(F.levenshtein(a, b) / F.length(b))


def dotted(n: Column) -> Column:
    """An integer with dots between its thousands."""
    return F.translate(F.format_number(n, 0), ",", ".")


def class_tokens(c: Column) -> Column:
    """Words of a procedural class in full, repeats included: a multiset."""
    full = F.create_map(*(F.lit(x) for kv in fixed.CLASS_IN_FULL.items() for x in kv))
    words = F.filter(F.split(phrase(c), " "), lambda t: (t != "") & ~t.rlike("^[0-9]+$") & ~t.isin(*fixed.CLASS_STOPWORDS))
    return F.flatten(F.transform(words, lambda t: F.split(F.coalesce(full[t], t), " ")))


def multiset_jaccard(a: Column, b: Column) -> Column:
    count = lambda xs, t: F.size(F.filter(xs, lambda x: x == t))
    total = lambda f: F.aggregate(F.array_distinct(F.concat(a, b)), F.lit(0), lambda acc, t: acc + f(count(a, t), count(b, t)))
    union = total(F.greatest)
    return F.when(union == 0, F.lit(0.0)).otherwise(total(F.least) / union)


def heading_class(text: Column, n: int = 220) -> Column:
    """The procedural class that heads a decision: what stands before its number."""
    head = F.regexp_replace(F.upper(unaccent(F.substring(text, 1, n))), fixed.HEAD_TITLE, " ")
    return F.trim(F.regexp_replace(F.regexp_replace(head, fixed.HEAD_NUMBER, ""), "[^A-Z0-9]+", " "))


def iou(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    both = F.greatest(F.lit(0), F.least(a1, b1) - F.greatest(a0, b0))
    either = (a1 - a0) + (b1 - b0) - both
    return F.when(either > 0, both / either).otherwise(F.lit(0.0))


def keeps_identity(noisy: Column, original: Column) -> Column:
    """The digits of ``noisy`` are a subsequence of those of ``original``."""
    wanted = F.split(digits(noisy), "")
    rest = F.aggregate(wanted, digits(original), lambda left, d: F.when((d == "") | left.isNull(), left).when(F.instr(left, d) > 0, F.substring(left, F.instr(left, d) + 1, F.length(left))))
    return rest.isNotNull()


NORMALISED = StructType([StructField("proc", StringType()), StructField("start", ArrayType(IntegerType())), StructField("end", ArrayType(IntegerType()))])


@cache
def _changing():
    """Finds what normalisation may change: line ends, characters with marks after them, characters that are composed otherwise."""
    import sys

    import regex

    def ranges(codes):
        out = []
        for c in codes:
            if out and out[-1][1] == c - 1:
                out[-1][1] = c
            else:
                out.append([c, c])
        return "".join(rf"\U{a:08x}-\U{b:08x}" for a, b in out)

    every = [(i, c) for i in range(sys.maxunicode + 1) if not 0xD800 <= i < 0xE000 for c in [chr(i)]]
    marks, others = ranges(i for i, c in every if unicodedata.combining(c)), ranges(i for i, c in every if unicodedata.normalize("NFC", c) != c)
    return regex.compile(rf"\r\n?|[^\r][{marks}]+|[{others}]", regex.S)


def _normalise(raw: str):
    """As ``normalise``, with arrays of 32 bits."""
    import numpy as np

    if "\r" not in raw and not raw.startswith("\ufeff") and unicodedata.is_normalized("NFC", raw):
        return raw, None, None
    at = bom = int(raw.startswith("\ufeff"))
    out, changes, n = [], [], 0
    for m in _changing().finditer(raw, bom):
        i, j = m.span()
        piece = "\n" if raw[i] == "\r" else unicodedata.normalize("NFC", m.group())
        out += (raw[at:i], piece)
        n += i - at
        changes.append((n, len(piece), i, j))
        n += len(piece)
        at = j
    out.append(raw[at:])
    n += len(raw) - at
    places, sizes, i, j = np.array(changes, np.int32).reshape(-1, 4).T
    steps = np.ones(n + 1, np.int32)
    steps[0] = bom
    for p, k in zip(places[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
        steps[p + 1 : p + k] = 0
    steps[places + sizes] = j - i
    # a change that starts a text has nothing before it, so its own step is the text's start
    starts = np.cumsum(steps[:n], dtype=np.int32)
    ends = starts + 1
    ends[places] = j
    for p, k, z in zip(places[sizes > 1].tolist(), sizes[sizes > 1].tolist(), j[sizes > 1].tolist(), strict=True):
        ends[p : p + k] = z
    return "".join(out), starts, ends


def normalise(raw: str | None):
    """(text, starts, ends): no BOM, LF line ends, NFC; the arrays give each code point's place in raw, and are None if raw is unchanged."""
    if raw is None:
        return None
    text, starts, ends = _normalise(raw)
    return (text, None, None) if starts is None else (text, starts.tolist(), ends.tolist())


#: Code points of the texts whose results leave a worker at once: arrays take eight bytes of each.
_AT_ONCE = 1 << 20


@F.arrow_udf(NORMALISED)
def normalised(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """``normalise`` as a column; results leave a worker some megabytes at a time, however many texts come at once."""
    import numpy as np

    def lists(arrays):
        offsets = np.cumsum([0, *(0 if x is None else len(x) for x in arrays)], dtype=np.int32)
        values = [x for x in arrays if x is not None]
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values) if values else np.empty(0, np.int32)), mask=pa.array([x is None for x in arrays]))

    def done(rows):
        texts, starts, ends = zip(*rows, strict=True)
        return pa.StructArray.from_arrays([pa.array(texts, pa.string()), lists(starts), lists(ends)], ["proc", "start", "end"])

    for b in batches:
        rows, size = [], 0
        for x in b:
            raw = x.as_py()
            rows.append((None, None, None) if raw is None else _normalise(raw))
            size += len(raw or "")
            if size >= _AT_ONCE:
                yield done(rows)
                rows, size = [], 0
        if rows:
            yield done(rows)


def raw_span(n: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """A span of normalised text as a span of the text it came from."""
    s, e = n["start"], n["end"]
    at = F.coalesce(F.try_element_at(s, start + 1), F.try_element_at(e, F.size(e)), F.lit(0))
    empty = end <= start
    return (F.when(s.isNull(), start).otherwise(at), F.when(s.isNull(), end).when(empty, at).otherwise(F.try_element_at(e, end)))
