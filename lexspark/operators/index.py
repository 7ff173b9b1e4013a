"""The registry's lookup tables, read from the records' headings with native expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lexspark import fixed
from lexspark.functions import text as T
from lexspark.shared import dealt, written


@dataclass
class Index:
    """cases: (key, layer, ids); sumulas: (key, id); statutes: (key, id); meta: (id, header_class).

    numbers: (number, records of layer, uf, id), the cases by their bare number; read from the cases if it isn't given.
    """

    cases: DataFrame
    sumulas: DataFrame
    statutes: DataFrame
    meta: DataFrame
    numbers: DataFrame | None = None

    def __post_init__(self):
        if self.numbers is None:
            part = F.split("key", r"\|")
            self.numbers = by_number(self.cases.select(part[0].alias("number"), F.get(part, F.lit(1)).alias("uf"), "layer", F.explode("ids").alias("id")))


_key_digits = lambda d: F.when(F.ltrim(d, F.lit("0")) == "", "0").otherwise(F.ltrim(d, F.lit("0")))


def _state(match: Column, at: Column) -> Column:
    """The state of a record's own number ``at`` in _found, read from the match that gave the number."""
    in_full = F.create_map(*(F.lit(x) for kv in fixed.STATES.items() for x in kv))
    return F.when(at < F.col("n_short"), F.upper(F.right(match, F.lit(2)))).when(at < F.col("n_short") + F.col("n_full"), in_full[F.regexp_extract(match, r"(?U)\s(\p{L}.*)$", 1)])


def _found(decisions: DataFrame) -> DataFrame:
    """(id, matches, n_short, n_full, own, others): the digits of a record's own numbers and of all others in its heading.

    Of the matches that gave its own numbers n_short end with a state's letters, n_full more with its name.
    """
    every = lambda c, p, g=0: F.regexp_extract_all(c, F.lit(p), F.lit(g))
    only_if = lambda test, found: F.when(test, found).otherwise(F.array().cast("array<string>"))
    # a match has no digits but its number's and no bar, so the digits of all are taken at once
    digits = lambda found: only_if(F.size(found) > 0, F.split(F.regexp_replace(F.array_join(found, "|"), "[^0-9|]", ""), r"\|"))
    text, head = F.col("text"), F.substring("text", 1, fixed.HEADING_WINDOW)
    tst = F.regexp_extract(text, fixed.HEAD_TST, 1)
    tst = F.when(tst != "", tst).otherwise(F.regexp_extract(F.substring(text, 1, fixed.TST_WINDOW), fixed.HEAD_TST_ELSE, 1))
    # costly patterns meet only headings that have what these must have
    d = decisions.select(
        "id", every(head, fixed.HEAD_UF).alias("short"), only_if(head.rlike(fixed.HEAD_STATE_PIECE), every(F.upper(T.unaccent(head)), fixed.HEAD_STATE)).alias("full"),
        only_if(text.rlike(fixed.HEAD_CNJ), F.concat(every(head, fixed.HEAD_CNJ), F.filter(F.array(tst), lambda x: x != ""))).alias("cnj"), every(head, fixed.HEAD_ANY, 1).alias("any"),
    )
    d = d.select("id", F.concat("short", "full", "cnj").alias("matches"), F.size("short").alias("n_short"), F.size("full").alias("n_full"), "any")
    d = d.select("id", "matches", "n_short", "n_full", digits(F.col("matches")).alias("own"), digits(F.col("any")).alias("any"))
    return d.select("id", "matches", "n_short", "n_full", "own", F.array_except("any", "own").alias("others"))


def case_numbers(decisions: DataFrame) -> DataFrame:
    """(id, number, uf, layer), a row a number of a heading: layer 0 with its state for a record's own, 1 for others, which may be own ones spelled otherwise."""
    each = F.posexplode(F.arrays_zip(F.concat("own", "others").alias("digits"), F.col("matches").alias("match"))).alias("at", "k")
    k = _found(decisions).select("id", "n_short", "n_full", F.size("own").alias("n_own"), each)
    return k.select("id", _key_digits(F.col("k.digits")).alias("number"), _state(F.col("k.match"), F.col("at")).alias("uf"), (F.col("at") >= F.col("n_own")).cast("int").alias("layer"))


def case_keys(decisions: DataFrame) -> DataFrame:
    """(id, key, layer): layer 0 for a record's own numbers, 1 for other numbers in its heading."""
    numbers = lambda digits: F.transform(digits, _key_digits)
    own = F.transform(F.arrays_zip(numbers("own").alias("n"), F.transform("matches", _state).alias("u")), lambda x: F.array_compact(F.array(F.concat(x["n"], F.lit("|"), x["u"]), x["n"])))
    # one explode gives both layers, so headings are read once
    marked = lambda keys, layer: F.transform(keys, lambda k: F.struct(k.alias("key"), F.lit(layer).alias("layer")))
    k = _found(decisions).select("id", F.array_distinct(F.flatten(own)).alias("own"), F.array_distinct(numbers("others")).alias("others"))
    return k.select("id", F.explode(F.concat(marked(F.col("own"), 0), marked(F.array_except("others", "own"), 1))).alias("k")).select("id", "k.*").where("key <> '0'")


def by_number(cases: DataFrame) -> DataFrame:
    """(id, number, uf, layer) -> numbers: a row a number with all records that have it, so a citation finds them by one key, whatever its state."""
    return cases.groupBy("number").agg(F.collect_set(F.struct("layer", "uf", "id")).alias("records"))


def records_of(number: Column, uf: Column | None) -> Column:
    """(layer, ids) of a row of numbers for a citation: own numbers before secondary ones, with the state before without; the bare 0 is no number."""
    records = F.col("records")
    made = lambda chosen: F.struct(F.element_at(chosen, 1)["layer"].alias("layer"), F.array_sort(F.array_distinct(F.transform(chosen, lambda r: r["id"]))).alias("ids"))
    least = F.array_min(F.transform(records, lambda r: r["layer"]))
    bare = F.when(number != "0", made(F.filter(records, lambda r: r["layer"] == least)))
    if uf is None:
        return bare
    with_uf = F.filter(records, lambda r: r["uf"] == uf)
    one = F.element_at(records, 1)
    # most numbers are of one record, which is found whatever the state
    return F.when((F.size(records) == 1) & (number != "0"), F.struct(one["layer"].alias("layer"), F.array(one["id"]).alias("ids"))).when(F.size(with_uf) > 0, made(with_uf)).otherwise(bare)


def by_key(numbers: DataFrame) -> DataFrame:
    """numbers -> (key, layer, ids)."""
    ufs = F.array_compact(F.array_distinct(F.transform("records", lambda r: r["uf"])))
    keyed = lambda uf: F.struct(F.concat_ws("|", "number", uf).alias("key"), records_of(F.lit("0"), uf).alias("r"))
    bare = F.when(F.col("number") != "0", F.struct(F.col("number").alias("key"), records_of(F.col("number"), None).alias("r")))
    return numbers.select(F.explode(F.concat(F.array_compact(F.array(bare)), F.transform(ufs, keyed))).alias("k")).select("k.key", "k.r.layer", "k.r.ids")


def _place(records: DataFrame) -> list[str]:
    return [c for c in records.columns if c == "place"]


def _each(records: DataFrame, *made: Column) -> DataFrame:
    """``records`` with the fields of each struct made that isn't null.

    An explode stays where it is: a filter on what is read from headings would be moved
    before the records are dealt, into the few tasks of their files, and read them once for
    each time that it names them.
    """
    keep = [c for c in records.columns if c != "text"]
    return records.select(*keep, F.explode(F.array_compact(F.array(*made))).alias("made")).select(*keep, "made.*")


def sumula_keys(sumulas: DataFrame) -> DataFrame:
    head = F.substring("text", 1, 120)
    part = lambda g: F.regexp_extract(head, fixed.HEAD_SUMULA, g)
    read = _each(sumulas, F.struct(part(1).alias("binding"), part(2).alias("number"), part(3).alias("of"))).where("number <> ''")
    court = F.when(F.col("of") != "", F.upper("of")).otherwise(F.upper(F.coalesce("court", F.lit(""))))
    keys = F.array(F.when(F.col("binding") != "", F.concat(court, F.lit("|SV|"), "number")), F.concat(court, F.lit("|"), "number"))
    return read.select("id", *_place(sumulas), F.explode(F.array_compact(keys)).alias("key"))


@F.pandas_udf(StringType())
def _by_name(names):
    from lexspark.functions.spans import match_statute

    return names.map(lambda x: None if not x or (found := match_statute(x)) is None else found[0])


def statute_keys(devices: DataFrame) -> DataFrame:
    head = F.substring("text", 1, 200)
    d = _each(devices, F.struct(F.regexp_replace(F.regexp_extract(head, fixed.HEAD_DEVICE, 1), r"\.", "").alias("article"), F.regexp_extract(head, fixed.HEAD_DEVICE, 2).alias("law"))).where("article <> ''")
    number, year = F.regexp_replace(F.regexp_extract("law", fixed.HEAD_LAW_NUMBER, 1), r"\.", ""), F.regexp_extract("law", fixed.HEAD_LAW_NUMBER, 2)
    d = _each(d, F.struct(number.alias("number"), year.alias("year"), T.fold(F.col("law")).alias("folded")))
    named = F.create_map(*(F.lit(x) for kv in fixed.NAMED_BY_NUMBER.items() for x in kv))
    number, year, folded, full = F.col("number"), F.col("year"), F.col("folded"), F.concat("number", F.lit("/"), "year")
    known = (
        F.when(folded.contains("constitui"), F.lit("CF"))
        .when(folded.contains("complementar") & (number != ""), F.concat(F.lit("LC "), number, F.when(year != "", F.concat(F.lit("/"), year)).otherwise("")))
        .when((number != "") & (year != ""), F.coalesce(named[full], F.concat(F.lit("LEI "), full)))
    )
    d = d.withColumn("alias", known)
    by_name = d.where("alias is null").withColumn("alias", _by_name("law"))
    key = F.when(F.col("alias").isNotNull(), F.struct(F.concat("alias", F.lit("|"), "article").alias("key")))
    return _each(d, key).unionByName(_each(by_name, key)).select("id", *_place(devices), "key")


def build(registry: DataFrame) -> Index:
    """registry: (id, court, nature, text) -> Index.

    A key that is a record's own number anywhere is no other record's secondary one.
    Súmulas and statutes hold one record a key: the one that a scan meets last, that is
    of the largest place if the registry has places, else of the largest document_id or id.
    """
    order = next(F.col(c) for c in ("place", "document_id", "id") if c in registry.columns)
    r = dealt(registry.select(F.col("id").cast("string").alias("id"), F.col("court"), "nature", "text", order.alias("place")), "id")
    numbers = by_number(case_numbers(r.where("nature = 'acordao'")))
    last = lambda keys: keys.groupBy("key").agg(F.max_by("id", F.struct("place", "id")).alias("id"))
    meta = r.where("nature = 'acordao'").select("id", T.heading_class(F.col("text")).alias("header_class"))
    return Index(by_key(numbers), last(sumula_keys(r.where("nature = 'sumula'"))), last(statute_keys(r.where("nature = 'dispositivo'"))), meta, numbers)


def summary(index: Index) -> DataFrame:
    """Sizes of the tables: name, n."""
    c = index.cases.agg(F.count_if(F.col("layer") == 0).alias("own"), F.count_if((F.col("layer") == 0) & (F.size("ids") > 1)).alias("ambiguous"), F.count_if(F.col("layer") == 1).alias("secondary"))
    sizes = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), F.col(name).alias("n")) for name in ("own", "ambiguous", "secondary")))).alias("s")
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
    return c.select(sizes).select("s.*").unionByName(count(index.sumulas, "sumulas")).unionByName(count(index.statutes, "statutes"))


def stored(index: Index) -> Index:
    """The tables, each computed once, for an index that is looked up several times."""
    numbers = written(index.numbers)
    return Index(by_key(numbers), *map(written, (index.sumulas, index.statutes, index.meta)), numbers)


__all__ = ["Index", "build", "case_keys", "case_numbers", "records_of", "statute_keys", "stored", "sumula_keys", "summary"]
