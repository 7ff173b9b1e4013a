"""Synthetic corpora with known truth: rendering, running offsets, noise that preserves identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspark import fixed
from lexspark.functions import text as T

#: Confusions of characters in prose: no two read the same character, so each place has one; rn stands for itself.
CONFUSIONS = (
    ("e", "c"), ("c", "e"), ("i", "l"), ("l", "i"), ("m", "rn"), ("rn", "m"), ("a", "ã"), ("o", "õ"), ("t", "l"), ("s", "5"), ("O", "0"), ("S", "5"),
    ("u", "ü"), ("n", "ñ"), ("d", "cl"),
)

#: Share of texts in which one blank is doubled.
DOUBLE_BLANK = 0.15

#: A full stop after one of these ends no sentence.
ABBREVIATIONS = ("art", "arts", "n", "nº", "fl", "fls", "Rel", "Min", "Des", "Dr", "Dra", "Sr", "Sra", "p", "pp", "inc", "proc")


def render_number(n: Column, form: Column) -> Column:
    """plain, dotted, spaced after its dots, or broken by a line."""
    d = T.dotted(n)
    return F.when(form == "plain", n.cast("string")).when(form == "spaced", F.replace(d, F.lit("."), F.lit(". "))).when(form == "broken", F.replace(d, F.lit("."), F.lit(".\n"))).otherwise(d)


def misread_interior(digits: Column, at: int = 2) -> Column:
    """One interior digit as the letter that is read for it, where there is one."""
    d = F.substring(digits, at, 1)
    return F.concat(F.substring(digits, 1, at - 1), F.translate(d, "0125679", "OIZSGtg"), F.substring(digits, at + 1, 99))


def offsets(segments: DataFrame, by: list[str], order: list[str], text: str = "text") -> DataFrame:
    """segments with start and end: their place in the text that they make, one after the other."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length(text)).over(w), F.lit(0))
    return segments.withColumn("start", start).withColumn("end", F.col("start") + F.length(text))


def add_noise(texts: DataFrame, rate: float = 0.02, seed: int = 1, text: str = "text") -> DataFrame:
    """Misread letters of prose at a given rate, each by a hash of its place; digits stay.

    Adds noisy and edits, the edit distance summed over the places of the whole text.
    The text is hashed once, so work is linear in its length.
    """
    pairs = F.create_map(*(F.lit(x) for kv in CONFUSIONS if len(kv[0]) == 1 for x in kv))
    chars = F.split(F.col(text), "")
    blanks = F.array_compact(F.transform(chars, lambda c, i: F.when(c == " ", i)))
    around = F.arrays_zip(chars.alias("was"), F.concat(F.array(F.lit("")), F.slice(chars, 1, F.size(chars) - 1)).alias("before"), F.concat(F.slice(chars, 2, F.size(chars)), F.array(F.lit(""))).alias("after"))

    def swapped(b):
        h = lambda i: F.pmod(F.xxhash64(b["key"], i, F.lit(seed)), F.lit(10_000)) / 10_000.0
        chosen = lambda i: h(i) < rate

        def now(x, i):
            first_of_rn = (x["was"] == "r") & (x["after"] == "n")
            second_of_rn = (x["was"] == "n") & (x["before"] == "r") & chosen(i - 1)
            return F.when(i == b["blank"], "  ").when(second_of_rn, "").when(~chosen(i), x["was"]).when(first_of_rn, "m").otherwise(F.coalesce(pairs[x["was"]], x["was"]))

        return F.transform(b["around"], lambda x, i: F.struct(x["was"].alias("was"), now(x, i).alias("now")))

    key = F.xxhash64(text)
    doubled = (F.pmod(F.xxhash64(key, F.lit("blank"), F.lit(seed)), F.lit(10_000)) / 10_000.0 < DOUBLE_BLANK) & F.lit(rate > 0) & (F.size("__blanks") > 0)
    blank = F.when(doubled, F.get("__blanks", F.pmod(F.xxhash64(key, F.lit("place"), F.lit(seed)), F.size("__blanks")).cast("int")))
    texts = texts.withColumn("__blanks", blanks)
    bound = F.array(F.struct(key.alias("key"), blank.alias("blank"), around.alias("around")))
    places = F.element_at(F.transform(bound, swapped), 1)
    out = texts.withColumn("__places", places)
    edits = F.aggregate("__places", F.lit(0), lambda n, p: n + F.when(p["was"] == p["now"], 0).otherwise(F.levenshtein(p["was"], p["now"])))
    return out.withColumns({"noisy": F.array_join("__places.now", ""), "edits": edits}).drop("__places", "__blanks")


def absent_numbers(wanted: DataFrame, keys: DataFrame) -> DataFrame:
    """Numbers (key) that the registry's keys don't hold."""
    return wanted.join(keys.select("key").distinct(), "key", "left_anti")


def near_texts(texts: DataFrame, id_col: str, text_col: str, tolerance: float, gram: int = 3) -> DataFrame:
    """(id_col, other): pairs of rows with a nonempty second text within ``tolerance`` of it, in edits by its length; each text is near itself.

    An edit spoils ``gram`` of a text's grams at most, so near texts share one of the
    rarest grams of the longer one, whose number the tolerance bounds; texts whose grams
    could all be spoiled meet those of their own length and near it.
    """
    key = id_col
    t = texts.select(F.col(key), F.col(text_col).alias("s"), F.length(text_col).alias("n")).where("s is not null")
    # both texts of a pair have at most this many edits between them, whichever is the second
    t = t.withColumn("edits", F.floor(F.col("n") / (1 - tolerance) * tolerance).cast("int"))
    places = F.when(F.col("n") >= gram, F.sequence(F.lit(1), F.col("n") - gram + 1)).otherwise(F.array().cast("array<int>"))
    grams = t.select(key, "n", "edits", F.explode(F.transform(places, lambda i: F.substring(F.col("s"), i, F.lit(gram)))).alias("gram")).groupBy(key, "n", "edits", "gram").agg(F.count(F.lit(1)).alias("times"))
    common = grams.groupBy("gram").agg(F.sum("times").alias("df"))
    ranked = grams.join(common, "gram").groupBy(key, "n", "edits").agg(F.array_sort(F.collect_list(F.struct("df", "gram", "times"))).alias("own"))
    # rarest first, until more grams are taken than the edits can spoil
    taken = F.aggregate("own", F.struct(F.lit(0).cast("long").alias("seen"), F.lit(0).alias("k")), lambda a, g: F.when(a["seen"] > F.col("edits") * gram, a).otherwise(F.struct((a["seen"] + g["times"]).alias("seen"), (a["k"] + 1).alias("k"))))
    prefix = ranked.withColumn("taken", taken).select(key, F.explode(F.slice("own", F.lit(1), F.greatest(F.col("taken.k"), F.lit(1)))).alias("g")).select(key, F.col("g.gram").alias("gram"))
    by_gram = prefix.join(prefix.withColumnRenamed(key, "other"), "gram").select(key, "other")
    short = t.where(f"n - {gram - 1} <= edits * {gram}").select(F.col(key), "n", "edits")
    by_length = short.select(F.col(key), F.explode(F.sequence(F.col("n") - F.col("edits"), F.col("n") + F.col("edits"))).alias("n")).join(t.select(F.col(key).alias("other"), "n"), "n").select(key, "other")
    pairs = by_gram.unionByName(by_length).unionByName(by_length.select(F.col("other").alias(key), F.col(key).alias("other"))).distinct()
    side = lambda a, b: t.select(F.col(key).alias(a), F.col("s").alias(b))
    met = pairs.join(side(key, "a"), key).join(side("other", "b"), "other")
    return met.where((F.length("b") > 0) & (T.distance(F.col("a"), F.col("b")) <= tolerance)).select(key, "other")


def sentences(docs: DataFrame) -> DataFrame:
    """(document_id, sentence, text): cut after . ! or ? and white space, not after an abbreviation."""
    marked = F.regexp_replace("raw", rf"(?<=[.!?])(?<!(?<![\p{{L}}\p{{N}}_])(?:{'|'.join(ABBREVIATIONS)})\.)\s+", "\x01")
    return docs.select("document_id", F.posexplode(F.split(marked, "\x01")).alias("sentence", "text")).where("text <> ''")


def whole_sentences(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(document_id, sentence, start, end, text): docs (document_id, raw) cut after . ! or ? and white space, not after a short form nor inside a span.

    spans: (document_id, start, end).  The pieces make the whole text.
    """
    inside = spans.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    d = docs.select("document_id", "raw").join(inside, "document_id", "left")
    stops, hidden = ".!?", "\x02\x03\x04"
    hide = lambda t, s: F.concat(F.substring(t, F.lit(1), s["start"]), F.translate(F.substring(t, s["start"] + 1, s["end"] - s["start"]), stops, hidden), F.substring(t, s["end"] + 1, F.length(t)))
    masked = F.aggregate(F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")), F.col("raw"), hide)
    cut = F.split(F.regexp_replace(masked, rf"(?U)(?<=[.!?])(?<!{fixed.SHORT_FORM}\.)\s+", "$0\x01"), "\x01")
    pieces = d.select("document_id", F.posexplode(F.transform(cut, lambda x: F.translate(x, hidden, stops))).alias("sentence", "text")).where("text <> ''")
    return offsets(pieces, ["document_id"], ["sentence"])


def templates(docs: DataFrame, gold: DataFrame) -> DataFrame:
    """(list, text): what a generator needs of a corpus with known truth.

    docs: (document_id, raw, level); gold: (document_id, start, end, kind, verdict).
    header: what stands before the first citation's paragraph; section: titles;
    neutral: sentences without a citation; kind|verdict: sentences with one, which {CIT}
    stands for; and, of the clean level 1 alone, filler and closing.
    """
    spans = gold.select("document_id", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "kind", "verdict")
    s = whole_sentences(docs, spans).join(docs.select("document_id", "level"), "document_id")
    cited = spans.select("document_id", F.col("start").alias("a"), F.col("end").alias("b"), "kind", "verdict")
    at = ["document_id", "sentence"]
    inside = s.select(*at, "start", "end").join(cited, "document_id").where("start <= a and b <= end").groupBy(*at).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("a", "b", "kind", "verdict")).alias("g"))
    s = s.join(inside, at, "left")
    between = lambda c, ends: (F.length(c) > ends[0]) & (F.length(c) < ends[1])
    edge = lambda t: F.concat(F.when(t.rlike(r"(?U)^\s"), " ").otherwise(""), F.trim(T.collapse(t)), F.when(t.rlike(r"(?U)\S\s+$"), " ").otherwise(""))
    before, after = F.substring("text", F.lit(1), F.col("g.a") - F.col("start")), F.substring("text", F.col("g.b") - F.col("start") + 1, F.length("text"))
    carriers = s.where("n = 1").select(F.concat("g.kind", F.lit("|"), "g.verdict").alias("list"), F.concat(edge(before), F.lit("{CIT}"), edge(after)).alias("text")).where(between("text", fixed.CARRIER_LENGTH))
    plain = s.where("n is null").select("level", F.trim(T.collapse(F.col("text"))).alias("text")).where(~F.col("text").rlike(fixed.SECTION_LINE))
    neutral = plain.where(between("text", fixed.NEUTRAL_SENTENCE)).select(F.lit("neutral").alias("list"), "text")
    filler = plain.where("level = 1").where(between("text", fixed.FILLER_SENTENCE) & ~F.col("text").rlike(r"^[0-9/]")).select(F.lit("filler").alias("list"), "text")
    first = docs.join(cited.groupBy("document_id").agg(F.min("a").alias("a")), "document_id", "left").withColumn("upto", F.substring("raw", F.lit(1), F.coalesce("a", F.length("raw"))))
    paragraph = F.length(F.regexp_extract("upto", r"(?s)^(.*)\n\n", 1))
    header = F.substring("raw", F.lit(1), F.when(paragraph > 0, paragraph).otherwise(F.least(F.length("upto"), F.lit(400))))
    headers = first.select(F.lit("header").alias("list"), F.concat(F.rtrim(F.regexp_replace(header, r"(?U)\s+$", "")), F.lit("\n\n")).alias("text"))
    clean = docs.where("level = 1")
    titles = F.filter(F.split("raw", "\n"), lambda x: x.rlike(fixed.SECTION_LINE))
    sections = clean.select(F.lit("section").alias("list"), F.explode(titles).alias("text"))
    closings = clean.select(F.lit("closing").alias("list"), F.regexp_replace(F.regexp_replace("raw", r"(?s)^.*\n\n", ""), r"(?U)^\s+|\s+$", "").alias("text"))
    out = carriers
    for x in (neutral, filler, headers, sections, closings):
        out = out.unionByName(x)
    return out.distinct()


def template_lists(rows: DataFrame) -> dict:
    """templates() as the lists that a generator takes; templates come of a small corpus, so they are gathered."""
    lists: dict = {}
    for r in rows.orderBy("list", "text").collect():
        lists.setdefault(r.list, []).append(r.text)
    plural = {"header": "headers", "section": "sections", "closing": "closings", "filler": "filler", "neutral": "neutral"}
    return {v: lists.get(k, []) for k, v in plural.items()} | {"carriers": {k: v for k, v in lists.items() if k not in plural}}
