"""Synthetic documents with known truth, generated from a registry as tables.

A draw is a hash of a row's key and of what is drawn, so rows are generated wherever
they are and again alike.  A document is a set of segments; citations are segments
with a truth; running sums of lengths give their places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexspark import fixed
from lexspark.functions import text as T
from lexspark.operators import synth
from lexspark.operators.index import Index
from lexspark.shared import written

_RANGE = 1 << 30


def draw(what: str, *key) -> Column:
    """Uniform in [0, 1), by a hash of the key."""
    return F.pmod(F.xxhash64(F.lit(what), *key), F.lit(_RANGE)) / _RANGE


def pick(what: str, options, *key) -> Column:
    """One of a short list of options, by a hash of the key."""
    return F.element_at(F.array(*map(F.lit, options)), F.floor(draw(what, *key) * len(options)).cast("int") + 1)


def numbered(df: DataFrame, name: str = "n") -> DataFrame:
    """``df``, written in the order of its columns, with a dense number from 0: places in the partitions plus what stands before each partition."""
    d = written(df.orderBy(*df.columns).withColumn("__id", F.monotonically_increasing_id()))
    sizes = d.groupBy(F.shiftright("__id", 33).alias("__part")).agg(F.count(F.lit(1)).alias("rows"))
    before = F.coalesce(F.sum("rows").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a partition
    starts = sizes.select("__part", before.alias("__before"))
    d = d.withColumn("__part", F.shiftright("__id", 33)).join(starts, "__part")
    return d.withColumn(name, F.col("__before") + F.col("__id").bitwiseAND((1 << 33) - 1)).drop("__id", "__part", "__before")


# --- what the registry holds -----------------------------------------------------


def canonical_surface(records: DataFrame) -> DataFrame:
    """(id, number, uf): a decision's own number as its heading writes it; (court, text) decide where it stands."""
    head = F.substring("text", 1, fixed.HEADING_WINDOW)
    first = lambda p, g, c=head: F.regexp_extract(c, p, g)
    tst = F.when(F.col("court") == "TST", first(fixed.HEAD_TST, 1, F.col("text"))).otherwise("")
    number = F.when(tst != "", tst).when(first(fixed.HEAD_UF, 1) != "", first(fixed.HEAD_UF, 1)).otherwise(first(fixed.HEAD_CNJ, 0))
    uf = F.when((tst == "") & (first(fixed.HEAD_UF, 1) != ""), F.upper(first(fixed.HEAD_UF, 2)))
    return records.select("id", number.alias("number"), uf.alias("uf")).where("number <> ''")


def semantic_class(heading: Column) -> Column:
    """The first class all of whose words a heading holds; a special appeal if there is none."""
    folded = T.fold(heading)
    fits = lambda k: F.forall(F.array(*map(F.lit, k.split())), lambda w: F.contains(folded, w))
    return F.coalesce(*(F.when(fits(k), F.lit(k)) for k in fixed.CLASS_FORMS), F.lit("recurso especial"))


def pools(registry: DataFrame, index: Index) -> dict[str, DataFrame]:
    """cases (id, number, uf, class), rapporteurs (court, rapporteur, year), sumulas and statutes (key, id).

    Only cases whose own number resolves to them alone, so that a rendered citation's truth is known.
    """
    r = registry.where("nature = 'acordao'").withColumn("id", F.col("id").cast("string"))
    surface = canonical_surface(r).withColumn("key", T.number_key(F.col("number")))
    alone = index.cases.where("layer = 0 and size(ids) = 1").select("key", F.element_at("ids", 1).alias("id"))
    cases = surface.join(alone, ["key", "id"]).join(index.meta, "id").select("id", "number", "uf", semantic_class(F.coalesce("header_class", F.lit(""))).alias("class"))
    return {
        "cases": cases, "rapporteurs": r.where("court is not null and rapporteur is not null").select("court", "rapporteur", "year").distinct(),
        "sumulas": index.sumulas.where(~F.contains("key", F.lit("|SV|"))), "statutes": index.statutes,
    }


# --- surfaces --------------------------------------------------------------------


def format_number(number: Column, *key) -> Column:
    """A number written in one of its ways, its digits unchanged."""
    d, dotted = T.digits(number), T.dotted(T.digits(number).cast("decimal(25,0)").cast("long"))
    cnj = F.element_at(F.array(number, number, F.replace(number, F.lit("."), F.lit(" ")), F.replace(number, F.lit("."), F.lit("")), F.regexp_replace(number, r"^([^.]*)\.", "$1"), F.replace(number, F.lit("-"), F.lit(" - "))), F.floor(draw("cnj form", *key) * 6).cast("int") + 1)
    plain = F.element_at(F.array(number, d, dotted, dotted, F.replace(dotted, F.lit("."), F.lit(" ")), F.replace(dotted, F.lit("."), F.lit(". "))), F.floor(draw("number form", *key) * F.when(F.length(d) > 3, 6).otherwise(2)).cast("int") + 1)
    return F.when(F.contains(number, F.lit("-")), cnj).otherwise(plain)


def fake_cnj(*key) -> Column:
    """A number in the form of the courts' unified numbering that is drawn, not given."""
    part = lambda what, low, high, width: F.lpad((F.floor(draw(what, *key) * (high - low + 1)) + low).cast("long").cast("string"), width, "0")
    return F.concat(part("seq", 1_000_000, 9_999_999, 7), F.lit("-"), part("check", 10, 99, 2), F.lit("."), part("cnj year", 2015, 2025, 4), F.lit("."), part("branch", 1, 8, 1), F.lit("."), part("court", 1, 20, 2), F.lit("."), part("unit", 1000, 9999, 4))


def _bound(c: Column, f) -> Column:
    """f of a value that is worked out once, however often f names it."""
    return F.element_at(F.transform(F.array(c), f), 1)


def identifier_noise(text: Column, *key) -> Column:
    """Noise inside a citation that keeps its identity: a digit read as a letter, a line break, a blank, a mark gone or doubled, a no-break space.

    Each kind comes with its chance at a place drawn among those it fits; a result whose
    digits aren't the original's, in order, is not taken.
    """

    def at_place(c, pattern, what, put):
        """``c`` changed at one of the places inside of it whose neighbourhood fits the pattern."""
        fits = lambda c: F.filter(F.sequence(F.lit(2), F.greatest(F.length(c) - 1, F.lit(2))), lambda i: F.substring(c, i - 1, F.lit(3)).rlike(pattern) & (i < F.length(c)))

        def changed(c, places):
            i = F.element_at(places, F.floor(draw(what, *key) * F.size(places)).cast("int") + 1)
            return _bound(i, lambda i: put(F.substring(c, F.lit(1), i - 1), F.substring(c, i, F.lit(1)), F.substring(c, i + 1, F.length(c))))

        return _bound(fits(c), lambda places: F.when(F.size(places) > 0, changed(c, places)).otherwise(c))

    def marks(c):
        doubled = at_place(c, r"^\d-\d$", "mark at", lambda a, x, z: F.concat(a, F.lit("--"), z))
        return F.when(draw("which mark", *key) < 0.5, F.regexp_replace(c, r"^([^.]*)\.", "$1")).otherwise(doubled)

    def maybe(kind, change):
        return lambda c: F.when(draw(kind, *key) < fixed.ID_NOISE[kind], change(c)).otherwise(c)

    noisy = text
    for kind, change in (
        ("letter", lambda c: at_place(c, r"^\d\d\d$", "letter at", lambda a, x, z: F.concat(a, F.translate(x, fixed.ID_DIGITS, fixed.ID_LETTERS), z))),
        ("break", lambda c: at_place(c, r"^[\d.\-][\d.]", "break at", lambda a, x, z: F.concat(a, F.lit("\n"), x, z))),
        ("space", lambda c: at_place(c, r"^[.\-]\d", "space at", lambda a, x, z: F.concat(a, F.lit(" "), x, z))),
        ("mark", marks),
        ("nbsp", lambda c: at_place(c, r"^. .$", "nbsp at", lambda a, x, z: F.concat(a, F.lit("\u00a0"), z))),
    ):
        noisy = _bound(noisy, maybe(kind, change))
    return _bound(noisy, lambda c: F.when(T.keeps_identity(c, text), c).otherwise(text))


def render_case(number: Column, uf: Column, cls: Column, *key) -> Column:
    forms = F.create_map(*(x for k, v in fixed.CLASS_FORMS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    own = F.coalesce(forms[cls], forms["recurso especial"])
    state = F.when(uf.isNotNull() & (draw("with state", *key) < 0.85), F.format_string("%s%s", F.lit(""), F.replace(pick("state mark", fixed.STATE_MARKS, *key), F.lit("%s"), uf))).otherwise("")
    form = F.element_at(own, F.floor(draw("class form", *key) * F.size(own)).cast("int") + 1)
    return F.concat(pick("prefix", fixed.CLASS_PREFIXES, *key), form, F.lit(" "), pick("mark", fixed.NUMBER_MARKS, *key), format_number(number, *key), state)


def render_statute(alias: Column, article: Column, *key) -> Column:
    """An article of a statute, by one of its names, or by its number if it has none."""
    forms = F.create_map(*(x for k, v in fixed.STATUTE_FORMS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    by_number = F.concat(F.when(alias.startswith("LC"), "da Lei Complementar nº ").otherwise("da Lei nº "), F.regexp_replace(alias, "^[A-Z]+ ", ""))
    own = F.coalesce(forms[alias], F.array(by_number))
    return F.concat(pick("article", fixed.ARTICLE_FORMS, *key), article, pick("clause", fixed.CLAUSE_FORMS, *key), F.lit(" "), F.element_at(own, F.floor(draw("statute form", *key) * F.size(own)).cast("int") + 1))


def render_vague(court: Column, year: Column, rapporteur: Column, *key) -> Column:
    """A reference by court, year and rapporteur, which names no single decision."""
    out = pick("vague form", fixed.VAGUE_FORMS, *key)
    name = F.regexp_replace(F.coalesce(rapporteur, F.lit("Fulano")), r"^(Min\.|Ministr[ao])\s*", "")
    for mark, value in (("{t}", court), ("{a}", F.coalesce(year.cast("string"), F.lit("2020"))), ("{r}", name), ("{c}", pick("vague class", fixed.VAGUE_CLASSES, *key))):
        out = F.replace(out, F.lit(mark), value)
    return out


# --- documents -------------------------------------------------------------------


def documents(spark: SparkSession, source: dict[str, DataFrame], index: Index, templates: dict, n: int, level: int = 0, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """``n`` documents and their truth: (document_id, raw), (level, document_id, g, start, end, surface, kind, verdict, ids).

    templates: lists of texts (headers, sections, filler, carriers by "kind|verdict" with {CIT}, closings).
    Level 1 is clean, level 2 noisy; 0 is both by turns.  Case numbers and articles
    rendered as invented are looked up first; those that are known are rendered as real ones.
    """
    lists = {k: list(templates.get(k) or [""]) for k in ("headers", "sections", "filler", "closings")}
    carriers = {k: list(v) for k, v in templates["carriers"].items() if v}
    doc = ["doc", F.lit(seed)]
    d = spark.range(n).select(F.col("id").alias("doc"), (F.lit(level) if level else F.col("id") % 2 + 1).cast("int").alias("level"))
    d = d.withColumn("sections", F.floor(draw("sections", *doc) * 2).cast("int") + 3)
    sec = d.select("doc", "level", F.explode(F.sequence(F.lit(1), F.col("sections"))).alias("section"))
    items = sec.withColumn("items", F.floor(draw("items", *doc, "section") * 4).cast("int") + 3).select("doc", "level", "section", F.explode(F.sequence(F.lit(1), F.col("items"))).alias("item"))
    key = ["doc", "section", "item", F.lit(seed)]
    v = draw("verdict", *key) * sum(fixed.VERDICT_WEIGHTS.values())
    real, fake = fixed.VERDICT_WEIGHTS["real"], fixed.VERDICT_WEIGHTS["real"] + fixed.VERDICT_WEIGHTS["inventada"]
    items = items.withColumns({
        "filler": draw("filler", *key) < fixed.FILLER_SHARE, "kind": F.when(draw("kind", *key) < fixed.STATUTE_SHARE, "lei").otherwise("jurisprudencia"),
        "wanted": F.when(v < real, "real").when(v < fake, "inventada").otherwise("incompleta"),
    })
    cited = items.where("not filler and not (kind = 'lei' and wanted = 'incompleta')").withColumn("sumula", draw("sumula", *key) < F.when(F.col("wanted") == "real", fixed.SUMULA_REAL).otherwise(fixed.SUMULA_FAKE))

    def from_pool(rows: DataFrame, name: str, where) -> DataFrame:
        """rows that ``where`` holds for, each with a record of the pool drawn by its number."""
        pool = numbered(source[name], "record")
        size = pool.count()
        chosen = rows.where(where).withColumn("record", F.floor(draw(name, *key) * size))
        return chosen.join(pool, "record").drop("record") if size else chosen.limit(0).drop("record").join(pool.drop("record"), how="cross")

    base = ["doc", "level", "section", "item", "kind", "wanted"]
    out = lambda rows, surface, ids: rows.select(*base, surface.alias("surface"), ids.alias("id"))
    none = F.lit(None).cast("string")
    is_ = lambda kind, wanted, sumula=None: (F.col("kind") == kind) & (F.col("wanted") == wanted) & (F.lit(True) if sumula is None else F.col("sumula") == sumula)
    statute = F.split("key", r"\|")
    sumula_of = F.concat(F.lit("Súmula "), F.element_at(F.split("key", r"\|"), 2), F.lit(" do "), F.element_at(F.split("key", r"\|"), 1))
    fakes = cited.where(is_("jurisprudencia", "inventada", False)).withColumn("number", F.when(draw("as cnj", *key) < 0.4, fake_cnj(*key)).otherwise((F.floor(draw("fake", *key) * 9_990_000) + 10_000).cast("string")))
    fakes = fakes.withColumn("key", T.number_key(F.col("number"))).join(index.cases.select("key").distinct(), "key", "left_anti")
    fake_sumulas = cited.where(is_("jurisprudencia", "inventada", True)).withColumn("key", F.concat(pick("court", ("STF", "STJ", "TSE", "TST"), *key), F.lit("|"), (F.floor(draw("sumula number", *key) * 500) + 500).cast("string")))
    fake_laws = cited.where(is_("lei", "inventada")).withColumn("key", F.concat(pick("statute", tuple(fixed.STATUTE_FORMS), *key), F.lit("|"), (F.floor(draw("article", *key) * 1101) + 100).cast("string")))
    law = lambda rows: render_statute(F.element_at(statute, 1), F.element_at(statute, 2), *key)  # noqa: E731, ARG005
    cases = from_pool(cited, "cases", is_("jurisprudencia", "real", False))
    surfaces = out(cases, render_case(F.col("number"), F.col("uf"), F.col("class"), *key), F.col("id"))
    for rows, surface, ids in (
        (from_pool(cited, "sumulas", is_("jurisprudencia", "real", True)), sumula_of, F.col("id")),
        (from_pool(cited, "statutes", is_("lei", "real")), law(None), F.col("id")),
        (fakes, render_case(F.col("number"), pick("uf", tuple(fixed.UFS), *key), pick("class", tuple(fixed.CLASS_FORMS), *key), *key), none),
        (fake_sumulas.join(index.sumulas.select("key"), "key", "left_anti"), sumula_of, none),
        (fake_laws.join(index.statutes.select("key"), "key", "left_anti"), law(None), none),
        (from_pool(cited, "rapporteurs", is_("jurisprudencia", "incompleta")), render_vague(F.col("court"), F.col("year"), F.col("rapporteur"), *key), none),
    ):
        surfaces = surfaces.unionByName(out(rows, surface, ids))
    numbers = (F.col("kind") == "jurisprudencia") & (F.col("wanted") != "incompleta") & ~F.col("surface").startswith("Súmula")
    surfaces = surfaces.withColumn("surface", F.when((F.col("level") == 2) & numbers, identifier_noise(F.col("surface"), *key)).otherwise(F.col("surface")))
    by_kind = F.concat("kind", F.lit("|"), "wanted")
    moulds = F.create_map(*(x for k, v in carriers.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    surfaces = surfaces.withColumn("mould", F.element_at(moulds[by_kind], F.floor(draw("mould", *key) * F.size(moulds[by_kind])).cast("int") + 1)).where("mould is not null")

    segment = lambda df, part, text, *more: df.select("doc", "level", F.col("section") if "section" in df.columns else F.lit(0).alias("section"), F.col("item") if "item" in df.columns else F.lit(0).alias("item"), F.lit(part).alias("part"), text.alias("text"), *(more or (none.alias("kind"), none.alias("wanted"), none.alias("id"))))
    title = F.element_at(F.array(*map(F.lit, lists["sections"])), F.least(F.col("section"), F.lit(len(lists["sections"]))))
    prose = segment(d, 0, pick("header", lists["headers"], *doc)).unionByName(segment(sec, 0, F.concat(F.lit("\n"), F.when(F.col("section") <= len(lists["sections"]), title).otherwise(""), F.lit("\n\n"))))
    prose = prose.unionByName(segment(items.where("filler"), 1, F.concat(pick("filler text", lists["filler"], *key), F.lit(" "))))
    around = F.split("mould", r"\{CIT\}")
    prose = prose.unionByName(segment(surfaces, 1, F.element_at(around, 1))).unionByName(segment(surfaces, 3, F.concat(F.element_at(around, 2), F.lit(" "))))
    prose = prose.unionByName(segment(d.withColumn("section", F.lit(99)), 0, F.concat(F.lit("\n"), pick("closing", lists["closings"], *doc), F.lit("\n"))))
    noisy = synth.add_noise(prose.where("level = 2"), 0.012, seed).withColumn("text", F.col("noisy")).select(prose.columns)
    whole = written(prose.where("level = 1").unionByName(noisy).unionByName(segment(surfaces, 2, F.col("surface"), "kind", F.col("wanted"), "id")))
    place = ["section", "item", "part"]
    placed = synth.offsets(whole, ["doc"], place)
    name = F.format_string("syn_n%d_%05d", "level", "doc").alias("document_id")
    raw = whole.groupBy("doc", "level").agg(F.array_sort(F.collect_list(F.struct(*place, "text"))).alias("t")).select(name, F.array_join("t.text", "").alias("raw"))
    g = (F.row_number().over(Window.partitionBy("doc").orderBy("start")) - 1).alias("g")
    ids = F.when(F.col("id").isNull(), F.array().cast("array<string>")).otherwise(F.array("id")).alias("ids")
    truth = placed.where("part = 2").select("level", name, g, F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), F.col("text").alias("surface"), "kind", F.col("wanted").alias("verdict"), ids)
    return raw, truth


# --- batteries -------------------------------------------------------------------

def misread_words(text: Column, least: int = 6, pairs=(("o", "0"), ("l", "1")), holding: str = "") -> Column:
    """m read as rn everywhere; in the first word of ``least`` letters or more that holds ``holding``, the first of each pair's letters misread."""

    def once(w):
        for a, b in pairs:
            w = F.regexp_replace(w, f"^([^{a}]*){a}", f"$1{b}")
        return w

    words = F.split(F.replace(text, F.lit("m"), F.lit("rn")), " ")
    at = F.array_position(F.transform(words, lambda w: (F.length(w) >= least) & F.contains(w, F.lit(holding))), F.lit(True))
    return F.array_join(F.transform(words, lambda w, i: F.when(i == at - 1, once(w)).otherwise(w)), " ")


def case_forms(cases: DataFrame) -> DataFrame:
    """cases: (id, number, uf, court, full): the class in full -> (id, form, surface): in full, abbreviated, misread."""
    table = F.lit(None).cast("string")
    for court, forms in fixed.COURT_FORMS.items():
        short = F.col("full")
        for phrase, letters in sorted(forms, key=lambda x: -len(x[0])):
            short = F.regexp_replace(short, rf"(?iU)\b{phrase}\b", letters)
        table = F.when(F.col("court") == court, short).otherwise(table)
    number = F.concat(F.lit(" nº "), F.col("number"), F.when(F.col("uf").isNotNull(), F.concat(F.lit("/"), "uf")).otherwise(""))
    rows = F.array(
        F.struct(F.lit("full").alias("form"), F.concat("full", number).alias("surface")),
        F.struct(F.lit("short").alias("form"), F.when(table != F.col("full"), F.concat(table, number)).alias("surface")),
        F.struct(F.lit("misread").alias("form"), F.concat(misread_words(F.col("full")), number).alias("surface")),
    )
    return cases.select("id", F.explode(rows).alias("r")).select("id", "r.form", "r.surface").where("surface is not null")


def statute_forms(devices: DataFrame) -> DataFrame:
    """devices: (id, article, short, full): names with their preposition, either may be null -> (id, form, surface)."""
    ocr = misread_words(F.replace("full", F.lit(" das "), F.lit(" da5 ")), 7, (("o", "0"),), "o")
    made = {
        "short": F.concat(F.lit("art. "), "article", F.lit(" "), "short"), "short+clause": F.concat(F.lit("art. "), "article", F.lit(", I, "), "short"),
        "full": F.concat(F.lit("artigo "), "article", F.lit(" "), "full"), "full+clause": F.concat(F.lit("artigo "), "article", F.lit(", inciso I, "), "full"),
        "paragraph": F.concat(F.lit("art. "), "article", F.lit(", § 1º, "), "full"), "line break": F.concat(F.lit("art.\n"), "article", F.lit(" "), "full"),
        "misread l": F.concat(F.lit("arl. "), "article", F.lit(" "), ocr), "misread o": F.concat(F.lit("artigõ "), "article", F.lit(" "), ocr),
    }
    rows = F.array(*(F.struct(F.lit(k).alias("form"), v.alias("surface")) for k, v in made.items()))
    return devices.select("id", F.explode(rows).alias("r")).select("id", "r.form", "r.surface").where("surface is not null")


def sumula_forms(sumulas: DataFrame) -> DataFrame:
    """sumulas: (id, number, court) -> (id, form, surface)."""
    made = {"plain": "Súmula {n} do {t}", "with mark": "Súmula nº {n} do {t}", "slash": "Súmula {n}/{t}", "short": "Súm. {n} do {t}", "capitals": "SÚMULA {n} DO {t}", "misread": "5úrnula {n} do {t}"}
    fill = lambda s: F.replace(F.replace(F.lit(s), F.lit("{n}"), F.col("number").cast("string")), F.lit("{t}"), F.col("court"))
    rows = F.array(*(F.struct(F.lit(k).alias("form"), fill(s).alias("surface")) for k, s in made.items()))
    return sumulas.select("id", F.explode(rows).alias("r")).select("id", "r.form", "r.surface")


def found_forms(verified: DataFrame, forms: DataFrame, before: str) -> DataFrame:
    """forms: (document_id, form, surface) rendered after ``before`` -> with verdict and canonical_id of the citation that overlaps the surface by half or more, null if none does."""
    start, end = F.lit(len(before)), F.lit(len(before)) + F.length("surface")
    c = verified.select("document_id", F.col("start").alias("s"), F.col("end").alias("e"), "verdict", "canonical_id")
    met = forms.join(c, "document_id", "left").withColumn("near", F.coalesce(T.iou(F.col("s"), F.col("e"), start, end), F.lit(0.0)) >= fixed.IOU)
    keys = ["document_id", "form", "surface"]
    return met.groupBy(*keys).agg(F.min_by(F.when(F.col("near"), F.struct("verdict", "canonical_id")), F.when(F.col("near"), F.col("s"))).alias("f")).select(*keys, "f.verdict", "f.canonical_id")
