"""Registered queries over the driver's tables, and their SQL.

The tables hold no legal text.  Queries render citations from rows whose truth is
known and run the engine over them; the SQL states the truth without parsing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexspark import fixed
from lexspark.functions import text as T
from lexspark.functions.spans import alias_forms
from lexspark.operators import evaluate, generate, statutes, synth, tagger
from lexspark.operators.arbitrate import first_come, suppress
from lexspark.operators.detect import find_candidates
from lexspark.operators.index import build, case_keys, stored, summary
from lexspark.plans.verify import contract, submission, submission_counts, verify
from lexspark.shared import dealt, new_folder, written

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
_UF_SQL = "list_value(" + ", ".join(f"'{u}'" for u in fixed.UFS) + ")"
_DOTTED = "replace(format('{:,}', %s), ',', '.')"


def _query(sql: str | None = None):
    def take(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return take


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _orders(spark, sf_dir):
    """Orders with a process number n, its dotted form and the customer's state."""
    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    c = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    uf = F.element_at(F.array(*map(F.lit, fixed.UFS)), (F.col("c_nationkey") % 27 + 1).cast("int"))
    n = F.col("o_orderkey") + 100000
    return o.join(c, "o_custkey").select("o_orderkey", "o_orderstatus", n.alias("n"), T.dotted(n).alias("d"), uf.alias("uf"))


_ORDERS = f"SELECT o_orderkey, o_orderstatus, o_orderkey + 100000 AS n, {_DOTTED % '(o_orderkey + 100000)'} AS d, {_UF_SQL}[(c_nationkey % 27 + 1)::INT] AS uf FROM orders JOIN customer ON o_custkey = c_custkey"


def _docs(df, raw):
    return df.select(F.col("o_orderkey").cast("string").alias("document_id"), raw.alias("raw"))


def _registry(df, text, nature="acordao", first_id=7000000000, key="o_orderkey", court=None):
    return df.select((F.col(key) + first_id).alias("id"), F.lit(court).cast("string").alias("court"), F.lit(nature).alias("nature"), text.alias("text"))


_heading = lambda: F.concat(F.lit("RECURSO ESPECIAL Nº "), "d", F.lit(" - "), "uf", F.lit(" (2020)\nEMENTA"))
_cited = lambda before, d="d", uf="uf", after=", nega-se.": F.concat(F.lit(before), d, F.lit("/"), uf, F.lit(after))


@_query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey::VARCHAR || '|' || uf ELSE o_orderkey::VARCHAR END AS key FROM (" + _ORDERS + ")")
def number_keys(spark, sf_dir):
    o = _orders(spark, sf_dir)
    return o.select("o_orderkey", T.number_key(F.concat(F.lit("Nº 00"), F.col("o_orderkey").cast("string"), F.lit(".")), F.when(F.col("o_orderkey") % 2 == 0, F.lower("uf"))).alias("key"))


@_query("SELECT doc_id, md5(trim(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', ' ', 'g'))) AS folded FROM documents")
def accent_fold(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", F.md5(T.phrase(F.col("text"))).alias("folded"))


@_query("SELECT doc_id, length(text)::INT AS n, (length(text) + length(text) - length(replace(text, chr(10), '')) + 1)::INT AS raw_end FROM documents WHERE length(text) > 0")
def newline_offsets(spark, sf_dir):
    raw = F.concat(F.lit("﻿"), F.replace("text", F.lit("\n"), F.lit("\r\n")))
    d = _t(spark, sf_dir, "documents").where(F.length("text") > 0).select("doc_id", T.normalised(raw).alias("x"))
    return d.select("doc_id", F.length("x.proc").alias("n"), T.raw_span(F.col("x"), F.lit(0), F.length("x.proc"))[1].alias("raw_end"))


@_query("""
WITH d AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE length(text) > 0),
s AS (SELECT doc_id, text, n, unnest(CASE WHEN n <= 900 THEN [0] ELSE list_distinct(list_append(list_filter(range(0, n, 700), lambda s: s + 900 < n), n - 900)) END) AS s FROM d)
SELECT doc_id::VARCHAR AS document_id, s::INT AS "start", least(s + 900, n)::INT AS "end", md5(substr(text, s::INT + 1, 900)) AS digest FROM s""")
def text_windows(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("document_id"), F.col("text").alias("raw"))
    return tagger.windows(d).select("document_id", "start", "end", F.md5("text").alias("digest"))


@_query(r"""
WITH p AS (SELECT doc_id, regexp_replace(text, '(^|[^\p{L}\p{N}_])(art|arts|n|nº|fl|fls|Rel|Min|Des|Dr|Dra|Sr|Sra|p|pp|inc|proc)\.', '\1\2' || chr(2), 'g') AS t FROM documents),
s AS (SELECT doc_id, list_filter(string_split(regexp_replace(t, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS s FROM p)
SELECT doc_id::VARCHAR AS document_id, len(s)::BIGINT AS n, sum(length(x))::BIGINT AS chars FROM s, unnest(s) AS u(x) GROUP BY doc_id, s""")
def sentence_split(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("document_id"), F.col("text").alias("raw"))
    return synth.sentences(d).groupBy("document_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


_CASE_SQL = """SELECT o_orderkey::VARCHAR AS document_id, 'c1' AS citation_id, {start} AS "start", ({start} + length(surface))::INT AS "end", surface, {verdict} AS verdict, {id} AS canonical_id, '{evidence}' AS evidence FROM (SELECT *, {surface} AS surface FROM ({orders}))"""
_CASE_COLS = ["document_id", "citation_id", "start", "end", "surface", "verdict", "canonical_id", "evidence"]


def _case_sql(surface, verdict="CASE WHEN o_orderstatus <> 'O' THEN 'real' ELSE 'inventada' END", id_="CASE WHEN o_orderstatus <> 'O' THEN (o_orderkey + 7000000000)::VARCHAR END", evidence="num_uf", start=11, orders=_ORDERS):
    return _CASE_SQL.format(surface=surface, verdict=verdict, id=id_, evidence=evidence, start=start, orders=orders)


@_query(_case_sql("'REsp nº ' || d || '/' || uf"))
def case_verdicts(spark, sf_dir):
    o = _orders(spark, sf_dir)
    return verify(_docs(o, _cited("Conforme o REsp nº ")), build(_registry(o.where("o_orderstatus <> 'O'"), _heading()))).select(*_CASE_COLS)


@_query(_case_sql("'REsp nº ' || d || '/' || CASE WHEN uf = 'AC' THEN 'SP' ELSE 'AC' END"))
def case_verdict_uf_mismatch(spark, sf_dir):
    """A wrong state doesn't veto: the bare number still resolves."""
    o = _orders(spark, sf_dir)
    wrong = F.when(F.col("uf") == "AC", "SP").otherwise("AC")
    return verify(_docs(o, _cited("Conforme o REsp nº ", uf=wrong)), build(_registry(o.where("o_orderstatus <> 'O'"), _heading()))).select(*_CASE_COLS)


@_query(_case_sql("CASE WHEN o_orderkey % 2 = 0 THEN 'REsp' ELSE 'RHC' END || ' nº ' || d || '/' || uf", "'real'", "(CASE WHEN o_orderkey % 2 = 0 THEN 8000000000 ELSE 7000000000 END + o_orderkey)::VARCHAR", "duplicata"))
def case_duplicates_tiebreak(spark, sf_dir):
    """Two records share a number; the class in the citation decides."""
    o = _orders(spark, sf_dir)
    other = F.concat(F.lit("RECURSO EM HABEAS CORPUS Nº "), "d", F.lit(" - "), "uf", F.lit("\nEMENTA"))
    r = _registry(o, other).unionByName(_registry(o, _heading(), first_id=8000000000))
    cls = F.when(F.col("o_orderkey") % 2 == 0, "REsp").otherwise("RHC")
    return verify(_docs(o, F.concat(F.lit("Conforme o "), cls, F.lit(" nº "), "d", F.lit("/"), "uf", F.lit(", nega-se."))), build(r)).select(*_CASE_COLS)


@_query("SELECT document_id, citation_id, \"start\", \"end\", surface, verdict, canonical_id, evidence, 'secundaria' AS layer FROM (" + _case_sql("'REsp nº ' || d", "'real'", "(o_orderkey + 7000000000)::VARCHAR", "num") + ")")
def case_secondary_layer(spark, sf_dir):
    o = _orders(spark, sf_dir)
    head = F.concat(F.lit("RECURSO ESPECIAL Nº "), (F.col("n") + 50000000).cast("string"), F.lit(" - SP, referente ao feito Nº "), "d", F.lit(", origem."))
    out = verify(_docs(o, F.concat(F.lit("Conforme o REsp nº "), "d", F.lit(", nega-se."))), build(_registry(o, head)))
    return out.select(*_CASE_COLS, F.col("signals.layer").alias("layer"))


_MISREAD = "substr(n::VARCHAR, 1, 2) || translate(substr(n::VARCHAR, 3, 1), '0125679', 'OIZSGtg') || substr(n::VARCHAR, 4)"


@_query(_case_sql(f"'REsp nº ' || {_MISREAD} || '/' || uf", evidence="' || CASE WHEN substr(n::VARCHAR, 3, 1) IN ('0', '1', '2', '5', '6', '7', '9') THEN 'ruidoso' ELSE 'num_uf' END || '"))
def ocr_digit_variants(spark, sf_dir):
    """One interior digit is misread as a letter."""
    o = _orders(spark, sf_dir)
    return verify(_docs(o, _cited("Conforme o REsp nº ", synth.misread_interior(F.col("n").cast("string"), 3))), build(_registry(o.where("o_orderstatus <> 'O'"), _heading()))).select(*_CASE_COLS)


@_query(_case_sql("'REsp nº ' || replace(d, '.', CASE WHEN o_orderkey % 2 = 0 THEN '. ' ELSE '.' || chr(10) END) || '/' || uf"))
def fragmented_numbers(spark, sf_dir):
    o = _orders(spark, sf_dir)
    form = F.when(F.col("o_orderkey") % 2 == 0, "spaced").otherwise("broken")
    return verify(_docs(o, _cited("Conforme o REsp nº ", synth.render_number(F.col("n"), form))), build(_registry(o.where("o_orderstatus <> 'O'"), _heading()))).select(*_CASE_COLS)


@_query("SELECT o_orderkey::VARCHAR AS document_id, (CASE o_orderkey % 4 WHEN 3 THEN 1 ELSE 0 END)::BIGINT AS n FROM orders")
def suppressed_numbers(spark, sf_dir):
    """Folios, docket lines and numbers without a class are no citations; a plain reference is."""
    o = _orders(spark, sf_dir)
    k = F.col("o_orderkey") % 4
    raw = F.when(k == 0, F.concat(F.lit("Ver REsp à fl. "), "d", F.lit("."))).when(k == 1, F.concat(F.lit("Processo nº "), "d", F.lit("/"), "uf")).when(k == 2, F.concat(F.lit("O valor de "), "d", F.lit(" reais."))).otherwise(_cited("Vide o REsp nº "))
    d = _docs(o, raw)
    found = find_candidates(d).groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))
    return d.select("document_id").join(found, "document_id", "left").select("document_id", F.coalesce("n", F.lit(0)).alias("n"))


_LAWS = ("Código de Processo Civil", "CDC", "Constituição Federal", "Lei nº 8.245/1991", "Código Pena1", "Consolidação da5 Leis do Trabalho")
_LAW_HEADS = ("da Lei nº 13.105, de 16 de março de 2015", "da Lei nº 8.078, de 11 de setembro de 1990", "da Constituição Federal", "da Lei nº 8.245, de 18 de outubro de 1991", "do Decreto-Lei nº 2.848, de 7 de dezembro de 1940", "do Decreto-Lei nº 5.452, de 1º de maio de 1943")
_PART = f"SELECT p_partkey, (p_partkey % 6)::INT AS law, CASE WHEN p_partkey // 6 + 1 > 9999 THEN {_DOTTED % '(p_partkey // 6 + 1)'} ELSE (p_partkey // 6 + 1)::VARCHAR END AS article FROM part"


def _articles(spark, sf_dir):
    """All parts as devices of six laws; an article of five digits or more is dotted, as the grammar reads it."""
    n = F.expr("p_partkey div 6 + 1")
    article = F.when(n > 9999, T.dotted(n)).otherwise(n.cast("string"))
    p = _t(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 6).cast("int").alias("law"), article.alias("article"))
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), F.col("law") + 1)
    heads = F.concat(F.lit("Artigo "), F.col("article"), F.lit(" "), pick(_LAW_HEADS), F.lit("\nTexto"))
    return p, pick, p.select((F.col("p_partkey") + 9000000000).alias("id"), F.lit(None).cast("string").alias("court"), F.lit("dispositivo").alias("nature"), heads.alias("text"))


def _law_sql(law_sql, verdict, id_):
    return f"""SELECT p_partkey::VARCHAR AS document_id, 'lei' AS kind, (12 + length(surface))::INT AS "end", surface, {verdict} AS verdict, {id_} AS canonical_id
FROM (SELECT *, 'art. ' || {law_sql[0]} || ' do ' || {law_sql[1]} AS surface FROM ({_PART}))"""


_LAW_LIST = "list_value(" + ", ".join(f"'{x}'" for x in _LAWS) + ")[law + 1]"


@_query(_law_sql(("article", _LAW_LIST), "CASE WHEN p_partkey % 5 = 0 THEN 'inventada' ELSE 'real' END", "CASE WHEN p_partkey % 5 <> 0 THEN (p_partkey + 9000000000)::VARCHAR END"))
def statute_verdicts(spark, sf_dir):
    """Names in full, abbreviated, numbered and misread; every fifth article isn't in the registry."""
    p, pick, registry = _articles(spark, sf_dir)
    d = p.select(F.col("p_partkey").cast("string").alias("document_id"), F.concat(F.lit("Nos termos, art. ").substr(1, 12), F.lit("art. "), F.col("article"), F.lit(" do "), pick(_LAWS), F.lit(".")).alias("raw"))
    return verify(d, build(registry.where("(id - 9000000000) % 5 <> 0"))).select("document_id", "kind", "end", "surface", "verdict", "canonical_id")


@_query("SELECT p_partkey::VARCHAR AS document_id, 'inventada' AS verdict, CAST(NULL AS VARCHAR) AS canonical_id FROM part")
def statute_digit_guard(spark, sf_dir):
    """A statute whose number differs in one digit is another statute, however near."""
    p = _t(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("string").alias("article"))
    d = p.select(F.col("p_partkey").cast("string").alias("document_id"), F.concat(F.lit("Nos termos do art. "), "article", F.lit(" da Lei nº 8.079/1990.")).alias("raw"))
    r = p.select((F.col("p_partkey") + 9000000000).alias("id"), F.lit(None).cast("string").alias("court"), F.lit("dispositivo").alias("nature"), F.concat(F.lit("Artigo "), "article", F.lit(" da Lei nº 8.078, de 11 de setembro de 1990\n")).alias("text"))
    return verify(d, build(r)).select("document_id", "verdict", "canonical_id")


def _sumulas(spark, sf_dir):
    """All suppliers as súmulas of five courts."""
    s = _t(spark, sf_dir, "supplier").select("s_suppkey", F.expr("s_suppkey div 5 + 1").alias("number"), F.element_at(F.array(*map(F.lit, fixed.COURTS)), (F.col("s_suppkey") % 5 + 1).cast("int")).alias("court"))
    r = s.where("s_suppkey % 3 <> 0").select((F.col("s_suppkey") + 6000000000).alias("id"), F.col("court"), F.lit("sumula").alias("nature"), F.concat(F.lit("Súmula n. "), F.col("number").cast("string"), F.lit(" do "), "court", F.lit(" Texto")).alias("text"))
    return s, r


@_query("SELECT s_suppkey::VARCHAR AS document_id, CASE WHEN s_suppkey % 3 <> 0 THEN 'real' ELSE 'inventada' END AS verdict, CASE WHEN s_suppkey % 3 <> 0 THEN (s_suppkey + 6000000000)::VARCHAR END AS canonical_id FROM supplier")
def sumula_verdicts(spark, sf_dir):
    s, r = _sumulas(spark, sf_dir)
    mould = F.when(F.col("s_suppkey") % 2 == 0, "a Súmula ").otherwise("a 5úrnula nº ")
    d = s.select(F.col("s_suppkey").cast("string").alias("document_id"), F.concat(F.lit("Aplica-se "), mould, F.col("number").cast("string"), F.lit(" do "), "court", F.lit(".")).alias("raw"))
    return verify(d, build(r)).select("document_id", "verdict", "canonical_id")


@_query("""WITH r AS (SELECT s_suppkey // 5 + 1 AS number, count(*) AS n, min(s_suppkey) AS one FROM supplier WHERE s_suppkey % 3 <> 0 GROUP BY 1)
SELECT s_suppkey::VARCHAR AS document_id, CASE WHEN n = 1 THEN 'real' WHEN n > 1 THEN 'incompleta' ELSE 'inventada' END AS verdict, CASE WHEN n = 1 THEN (one + 6000000000)::VARCHAR END AS canonical_id
FROM supplier LEFT JOIN r ON number = s_suppkey // 5 + 1""")
def sumula_bare_ambiguous(spark, sf_dir):
    """Without a court, a number that several courts have is incomplete."""
    s, r = _sumulas(spark, sf_dir)
    d = s.select(F.col("s_suppkey").cast("string").alias("document_id"), F.concat(F.lit("Aplica-se a Súmula "), F.col("number").cast("string"), F.lit(" ao caso.")).alias("raw"))
    return verify(d, build(r)).select("document_id", "verdict", "canonical_id")


def _no_registry(spark):
    return build(spark.createDataFrame([], "id string, court string, nature string, text string"))


@_query("SELECT p_partkey::VARCHAR AS document_id, 'inventada' AS verdict, 'tema' AS evidence, ('Tema ' || (p_partkey % 1400 + 1) || ' da repercussão geral') AS surface FROM part")
def topic_always_invented(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    d = p.select(F.col("p_partkey").cast("string").alias("document_id"), F.concat(F.lit("Ver o Tema "), (F.col("p_partkey") % 1400 + 1).cast("string"), F.lit(" da repercussão geral.")).alias("raw"))
    return verify(d, _no_registry(spark)).select("document_id", "verdict", "evidence", "surface")


_NAMES = ("Rosa Weber", "Dias Toffoli", "MARIA ELIZABETH GUIMARÃES TEIXEIRA ROCHA", "Francisco Falcão")


@_query("SELECT s_suppkey::VARCHAR AS document_id, 'Rcl de ' || (2000 + s_suppkey % 24) || ', Rel. Min. ' || list_value(" + ", ".join(f"'{n}'" for n in _NAMES) + ")[(s_suppkey % 4 + 1)::INT] AS surface, 'incompleta' AS verdict, 'vaga' AS evidence FROM supplier")
def vague_citations(spark, sf_dir):
    s = _t(spark, sf_dir, "supplier")
    name = F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("s_suppkey") % 4 + 1).cast("int"))
    d = s.select(F.col("s_suppkey").cast("string").alias("document_id"), F.concat(F.lit("Como na Rcl de "), (F.col("s_suppkey") % 24 + 2000).cast("string"), F.lit(", Rel. Min. "), name, F.lit(". Cumpre lembrar.")).alias("raw"))
    return verify(d, _no_registry(spark)).select("document_id", "surface", "verdict", "evidence")


@_query("SELECT s_suppkey::VARCHAR AS document_id, (s_suppkey % 2)::BIGINT AS diffuse, 0::BIGINT AS strict FROM supplier")
def diffuse_mode(spark, sf_dir):
    s = _t(spark, sf_dir, "supplier")
    raw = F.when(F.col("s_suppkey") % 2 == 1, "Nos termos da jurisprudência pacífica desta Corte, nega-se.").otherwise("Nos termos do voto, nega-se.")
    d = s.select(F.col("s_suppkey").cast("string").alias("document_id"), raw.alias("raw"))
    n = lambda diffuse, name: find_candidates(d, diffuse).groupBy("document_id").agg(F.count(F.lit(1)).alias(name))
    return d.select("document_id").join(n(True, "diffuse"), "document_id", "left").join(n(False, "strict"), "document_id", "left").fillna(0)


@_query("SELECT s_suppkey::VARCHAR AS document_id FROM supplier WHERE s_suppkey % 2 = 0")
def neutral_suppression(spark, sf_dir):
    """A sentence that nearly is a known neutral one hosts no vague citation."""
    neutral = ("Consoante o julgado do STF proferido em 2020 pela relatoria de Fulano Sicrano, a matéria segue em debate.",)
    s = _t(spark, sf_dir, "supplier")
    raw = F.when(F.col("s_suppkey") % 2 == 1, "Consoante o julgado do STF proferido em 2021 pela relatoria de Fulano Sicrana, a matéria segue em debate.").otherwise("Decidiu assim o julgado do STF proferido em 2021 pela relatoria de Rosa Weber em caso igual ao presente dos autos.")
    d = s.select(F.col("s_suppkey").cast("string").alias("document_id"), raw.alias("raw"))
    return find_candidates(d, neutral=neutral).select("document_id").distinct()


_SPANS = "SELECT user_id, event_id, (event_id * 7 % 400)::INT AS a, (event_id * 7 % 400 + 5 + event_id % 23)::INT AS b, value FROM events WHERE event_type = 'click'"


def _spans(spark, sf_dir):
    return _t(spark, sf_dir, "events").where("event_type = 'click'").select("user_id", "event_id", (F.col("event_id") * 7 % 400).cast("int").alias("start"), (F.col("event_id") * 7 % 400 + 5 + F.col("event_id") % 23).cast("int").alias("end"), "value")


_FOLD = """WITH RECURSIVE s AS (SELECT user_id, a, b, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM ({spans})),
f AS (SELECT user_id, k, [struct_pack(a := a, b := b, e := event_id)] AS kept FROM s WHERE k = 1
  UNION ALL SELECT f.user_id, s.k, CASE WHEN len(list_filter(kept, lambda x: s.b > x.a AND s.a < x.b)) > 0 THEN kept ELSE list_append(kept, struct_pack(a := s.a, b := s.b, e := s.event_id)) END
  FROM f JOIN s ON s.user_id = f.user_id AND s.k = f.k + 1),
l AS (SELECT user_id, arg_max(kept, k) AS kept FROM f GROUP BY user_id)
SELECT user_id, x.e AS event_id FROM l, unnest(kept) AS u(x)"""


@_query(_FOLD.format(spans=_SPANS))
def occupancy_fold(spark, sf_dir):
    rows = _spans(spark, sf_dir).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "start", "end"))).alias("r"))
    return rows.select("user_id", F.explode(first_come(F.col("r"))).alias("x")).select("user_id", "x.event_id")


def _verified_with(spark, sf_dir, kept=lambda index: index):
    o = _orders(spark, sf_dir)
    d = _docs(o, F.when(F.col("o_orderkey") % 10 == 9, "Nada consta.").otherwise(_cited("Conforme o REsp nº ")))
    index = kept(build(_registry(o.where("o_orderstatus <> 'O'"), _heading())))
    return d, index, verify(d, index)


def _verified(spark, sf_dir):
    d, _, c = _verified_with(spark, sf_dir)
    return d, c


_SUBMITTED = f"""SELECT o_orderkey::VARCHAR AS documento_id, CASE WHEN o_orderkey % 10 = 9 THEN '-' ELSE '11,' || (11 + length('REsp nº ' || d || '/' || uf)) || ',' ||
CASE WHEN o_orderstatus <> 'O' THEN 'real,' || (o_orderkey + 7000000000) ELSE 'inventada,-' END || ',1.0000' END AS citacoes FROM ({_ORDERS})"""


@_query(_SUBMITTED)
def submission_encoding(spark, sf_dir):
    return submission(*_verified(spark, sf_dir))


@_query("SELECT CASE WHEN o_orderstatus <> 'O' THEN 'real' ELSE 'inventada' END AS verdict, count(*) AS n FROM orders WHERE o_orderkey % 10 <> 9 GROUP BY 1")
def submission_counts_by_verdict(spark, sf_dir):
    return submission_counts(submission(*_verified(spark, sf_dir)))


@_query("SELECT o_orderkey::VARCHAR AS document_id, (CASE WHEN o_orderkey % 10 = 9 THEN 0 ELSE 1 END)::INT AS n, '1.2' AS version FROM orders")
def output_contract(spark, sf_dir):
    c = contract(*_verified(spark, sf_dir))
    read = c.select("document_id", F.from_json("json", "schema_version string, citacoes array<struct<id:string>>").alias("c"))
    return read.select("document_id", F.size("c.citacoes").alias("n"), F.col("c.schema_version").alias("version"))


@_query(f"""SELECT o_orderkey::VARCHAR AS document_id, p AS problem FROM (SELECT o_orderkey, unnest(CASE o_orderkey % 6 WHEN 0 THEN ['bad span'] WHEN 1 THEN ['unknown verdict', 'id without real'] WHEN 2 THEN ['real without id'] WHEN 3 THEN ['surface differs'] WHEN 4 THEN ['bad confidence'] ELSE [] END) AS p FROM ({_ORDERS}))""")
def contract_violations(spark, sf_dir):
    o = _orders(spark, sf_dir)
    k, d = F.col("o_orderkey") % 6, F.concat(F.lit("o REsp nº "), "d")
    c = o.select(F.col("o_orderkey").cast("string").alias("document_id"), F.lit("c1").alias("citation_id"), F.lit(2).alias("start"), F.when(k == 0, 999).otherwise(F.length(d)).alias("end"),
                 F.when(k == 3, "x").otherwise(F.substring(d, 3, 99)).alias("surface"), F.lit("jurisprudencia").alias("kind"), F.when(k == 1, "talvez").otherwise("real").alias("verdict"),
                 F.when(k != 2, "70").alias("canonical_id"), F.when(k == 4, 1.5).otherwise(1.0).alias("confidence"))
    return evaluate.violations(_docs(o, d), c).select("document_id", "problem")


_PAIRS = "g AS (SELECT user_id, event_id AS g, a, b FROM ({s}) WHERE event_id % 2 = 0), p AS (SELECT user_id, event_id AS p, a, b FROM ({s}) WHERE event_id % 2 = 1), i AS (SELECT user_id, g, p, (least(g.b, p.b) - greatest(g.a, p.a))::DOUBLE AS n, (greatest(g.b, p.b) - least(g.a, p.a))::DOUBLE AS u FROM g JOIN p USING (user_id) WHERE g.a < p.b AND p.a < g.b)".format(s=_SPANS)


def _sides(spark, sf_dir):
    s = _spans(spark, sf_dir).withColumnRenamed("user_id", "document_id")
    side = lambda k, v: s.where(F.col("event_id") % 2 == k).select("document_id", F.col("event_id").alias(v), "start", "end")
    return side(0, "g"), side(1, "p")


@_query(f"WITH {_PAIRS} SELECT user_id AS document_id, g, p, round(n / u, 9) AS iou FROM i WHERE n / u >= 0.5")
def iou_pairs(spark, sf_dir):
    return evaluate.overlapping(*_sides(spark, sf_dir)).withColumn("iou", F.round("iou", 9))


@_query(f"""WITH RECURSIVE {_PAIRS}, c AS (SELECT user_id, g, p, row_number() OVER (PARTITION BY user_id ORDER BY n / u DESC, p DESC, g DESC) AS k FROM i WHERE n / u >= 0.5),
f AS (SELECT user_id, k, [struct_pack(g := g, p := p)] AS kept FROM c WHERE k = 1
  UNION ALL SELECT f.user_id, c.k, CASE WHEN len(list_filter(kept, lambda x: x.g = c.g OR x.p = c.p)) > 0 THEN kept ELSE list_append(kept, struct_pack(g := c.g, p := c.p)) END FROM f JOIN c ON c.user_id = f.user_id AND c.k = f.k + 1),
l AS (SELECT user_id, arg_max(kept, k) AS kept FROM f GROUP BY user_id) SELECT user_id AS document_id, x.g AS g, x.p AS p FROM l, unnest(kept) AS u(x)""")
def greedy_match(spark, sf_dir):
    return evaluate.greedy_match(*_sides(spark, sf_dir)).select("document_id", "g", "p")


_LABELLED = "SELECT doc_id, quality, toxic, CASE doc_id % 3 WHEN 0 THEN 'num' WHEN 1 THEN 'lei' ELSE 'vaga' END AS evidence FROM labels"


@_query(f"SELECT evidence, count(*) AS n, round(avg(quality), 9) AS hit_rate, round(avg((0.9::DOUBLE - quality) ** 2), 9) AS brier, round((1 - avg((0.9::DOUBLE - quality) ** 2)) * 0.1, 9) AS bonus FROM ({_LABELLED}) GROUP BY evidence")
def evidence_calibration(spark, sf_dir):
    k = F.col("doc_id") % 3
    rows = _t(spark, sf_dir, "labels").select(F.when(k == 0, "num").when(k == 1, "lei").otherwise("vaga").alias("evidence"), F.lit(0.9).alias("confidence"), F.col("quality").alias("ok"))
    return evaluate.calibration(rows).select("evidence", "n", *(F.round(c, 9).alias(c) for c in ("hit_rate", "brier", "bonus")))


@_query("""WITH p AS (SELECT CASE quality WHEN 1 THEN 'real' ELSE 'inventada' END AS g, CASE WHEN toxic = 1 THEN 'incompleta' WHEN doc_id % 7 = 0 THEN 'inventada' ELSE 'real' END AS s FROM labels), c AS (SELECT DISTINCT g AS class FROM p UNION SELECT DISTINCT s FROM p)
SELECT class, count(*) FILTER (g = class AND s = class) AS tp, count(*) FILTER (g <> class AND s = class) AS fp, count(*) FILTER (g = class AND s <> class) AS fn,
round(2.0::DOUBLE * count(*) FILTER (g = class AND s = class) / (count(*) FILTER (g = class) + count(*) FILTER (s = class)), 9) AS f1 FROM c, p GROUP BY class""")
def class_confusion_f1(spark, sf_dir):
    rows = _t(spark, sf_dir, "labels").select(F.when(F.col("quality") == 1, "real").otherwise("inventada").alias("g"), F.when(F.col("toxic") == 1, "incompleta").when(F.col("doc_id") % 7 == 0, "inventada").otherwise("real").alias("s"))
    return evaluate.f1_by_class(rows, "g", "s").withColumn("f1", F.round("f1", 9))


@_query("""SELECT doc_id::VARCHAR AS document_id, CASE doc_id % 4 WHEN 1 THEN 'real -> inventada' WHEN 2 THEN 'wrong id' WHEN 3 THEN 'missed' END AS error FROM labels WHERE doc_id % 4 <> 0
UNION ALL SELECT doc_id::VARCHAR, 'spurious' FROM labels WHERE doc_id % 4 = 3""")
def error_report(spark, sf_dir):
    k = F.col("doc_id") % 4
    base = _t(spark, sf_dir, "labels").withColumn("document_id", F.col("doc_id").cast("string"))
    gold = base.select("document_id", F.lit(0).alias("g"), F.lit(10).alias("start"), F.lit(20).alias("end"), F.lit("real").alias("verdict"), F.array(F.lit("70"), F.lit("71")).alias("ids"))
    said = base.select("document_id", F.lit(0).alias("p"), F.when(k == 3, 50).otherwise(11).alias("start"), F.when(k == 3, 60).otherwise(20).alias("end"), F.when(k == 1, "inventada").otherwise("real").alias("verdict"), F.when(k == 2, "99").otherwise("71").alias("canonical_id"))
    return evaluate.error_report(gold, said).select("document_id", "error")


_TAGS = "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, CASE event_type WHEN 'click' THEN 'B-JUR' WHEN 'view' THEN 'I-JUR' WHEN 'purchase' THEN 'I-LEI' WHEN 'signup' THEN 'B-LEI' ELSE 'O' END AS tag FROM events"


@_query(f"""WITH t AS (SELECT *, tag[3:] AS type, lag(tag[3:]) OVER w AS before FROM ({_TAGS}) WINDOW w AS (PARTITION BY user_id ORDER BY k)),
r AS (SELECT *, sum(CASE WHEN tag[1] IN ('B', 'O') OR before IS NULL OR before <> type THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY k) AS run FROM t)
SELECT user_id AS document_id, min(k)::INT AS "start", max(k + 1)::INT AS "end", min(type) AS label FROM r GROUP BY user_id, run HAVING arg_min(tag[1], k) = 'B'""")
def bio_spans(spark, sf_dir):
    k = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    tag = F.when(F.col("event_type") == "click", "B-JUR").when(F.col("event_type") == "view", "I-JUR").when(F.col("event_type") == "purchase", "I-LEI").when(F.col("event_type") == "signup", "B-LEI").otherwise("O")
    t = _t(spark, sf_dir, "events").select(F.col("user_id").alias("document_id"), k.alias("position"), k.alias("start"), (k + 1).alias("end"), tag.alias("tag"), F.lit(1.0).alias("score"))
    return tagger.decode_tags(t).drop("score")


@_query(_FOLD.format(spans=f"SELECT user_id, a, b, row_number() OVER (ORDER BY value DESC, a, b) AS event_id FROM ({_SPANS})").replace("s.b > x.a AND s.a < x.b", "(least(s.b, x.b) - greatest(s.a, x.a))::DOUBLE / (greatest(s.b, x.b) - least(s.a, x.a)) >= 0.5").replace("x.e AS event_id", 'x.a AS "start", x.b AS "end"').replace("SELECT user_id, x.a", "SELECT user_id AS document_id, x.a"))
def span_nms(spark, sf_dir):
    s = _spans(spark, sf_dir).select(F.col("user_id").alias("document_id"), "start", "end", F.lit("JUR").alias("label"), F.col("value").alias("score"))
    return suppress(s).select("document_id", "start", "end")


def _fused(spark, sf_dir, strict):
    s = _spans(spark, sf_dir).withColumnRenamed("user_id", "document_id").withColumn("end", F.col("start") + 4)
    score = F.when(F.col("event_id") % 5 == 0, 0.5).otherwise(0.95)
    return tagger.fuse(s.where("event_id % 2 = 0"), s.where("event_id % 2 = 1").select("document_id", "start", "end", F.lit("JUR").alias("label"), score.alias("score")), strict).select("document_id", "start", "end")


_FUSED = """WITH RECURSIVE x AS (SELECT user_id, event_id, a, a + 4 AS b FROM ({s})), t AS (SELECT user_id, a, b FROM x WHERE event_id % 2 = 1 AND event_id % 5 <> 0 AND NOT EXISTS (SELECT 1 FROM x y WHERE y.event_id % 2 = 0 AND y.user_id = x.user_id AND {hit})),
s AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY a, b) AS k FROM t),
f AS (SELECT user_id, k, [a] AS kept FROM s WHERE k = 1 UNION ALL SELECT f.user_id, s.k, CASE WHEN len(list_filter(kept, lambda z: {again})) > 0 THEN kept ELSE list_append(kept, s.a) END FROM f JOIN s ON s.user_id = f.user_id AND s.k = f.k + 1),
l AS (SELECT user_id, arg_max(kept, k) AS kept FROM f GROUP BY user_id) SELECT user_id AS document_id, z::INT AS "start", (z + 4)::INT AS "end" FROM l, unnest(kept) AS u(z)"""


@_query(_FUSED.format(s=_SPANS, hit="abs(y.a - x.a) < 4", again="abs(s.a - z) < 4"))
def fusion_strict(spark, sf_dir):
    return _fused(spark, sf_dir, True)


@_query(_FUSED.format(s=_SPANS, hit="abs(y.a - x.a) <= 1", again="abs(s.a - z) <= 1"))
def fusion_legacy(spark, sf_dir):
    return _fused(spark, sf_dir, False)


@_query("SELECT o_orderkey, (o_orderkey % 3 <> 2 OR reverse((o_orderkey + 100000)::VARCHAR) = (o_orderkey + 100000)::VARCHAR) AS kept FROM orders")
def noise_subsequence(spark, sf_dir):
    n = (F.col("o_orderkey") + 100000).cast("string")
    k = F.col("o_orderkey") % 3
    noisy = F.when(k == 0, F.concat(F.substring(n, 1, 2), F.lit("O. "), F.substring(n, 4, 9))).when(k == 1, n).otherwise(F.reverse(n))
    return _t(spark, sf_dir, "orders").select("o_orderkey", T.keeps_identity(noisy, n).alias("kept"))


@_query("""SELECT conv_id, turn, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "start",
coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + length(text) AS "end" FROM conversations""")
def running_offsets(spark, sf_dir):
    return synth.offsets(_t(spark, sf_dir, "conversations"), ["conv_id"], ["turn"]).select("conv_id", "turn", "start", "end")


@_query("SELECT DISTINCT (l_orderkey + l_linenumber * 3001)::VARCHAR AS key FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey + l_linenumber * 3001)")
def fake_number_antijoin(spark, sf_dir):
    wanted = _t(spark, sf_dir, "lineitem").select((F.col("l_orderkey") + F.col("l_linenumber") * 3001).cast("string").alias("key")).distinct()
    return synth.absent_numbers(wanted, _t(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("key")))


@_query("SELECT coalesce(uf, 'TOTAL') AS uf, count(*) AS n, count(*) FILTER (o_orderstatus <> 'O') AS found FROM (" + _ORDERS + ") GROUP BY ROLLUP (uf)")
def coverage_rollup(spark, sf_dir):
    o = _orders(spark, sf_dir)
    out = verify(_docs(o, _cited("Conforme o REsp nº ")), build(_registry(o.where("o_orderstatus <> 'O'"), _heading()))).select("document_id", "verdict", F.element_at(F.split("surface", "/"), -1).alias("uf"))
    return out.rollup("uf").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("verdict") == "real").alias("found")).select(F.coalesce("uf", F.lit("TOTAL")).alias("uf"), "n", "found")


@_query("SELECT 'own' AS name, 2 * count(*) AS n FROM orders UNION ALL SELECT 'ambiguous', 0 UNION ALL SELECT 'secondary', 0 UNION ALL SELECT 'sumulas', 0 UNION ALL SELECT 'statutes', 0")
def index_summary(spark, sf_dir):
    return summary(build(_registry(_orders(spark, sf_dir), _heading())))


@_query("SELECT (o_orderkey + 7000000000)::VARCHAR AS id, unnest([n::VARCHAR, n || '|' || uf]) AS key, 0 AS layer FROM (" + _ORDERS + ")")
def index_case_keys(spark, sf_dir):
    r = _registry(_orders(spark, sf_dir), _heading())
    return case_keys(r.withColumn("id", F.col("id").cast("string")))


@_query("SELECT o_orderkey, round(least(0.999, greatest(0.001, 1 / (1 + exp(-(0.25::DOUBLE + 1.5::DOUBLE * (o_orderkey % 2) - 0.02::DOUBLE * (o_orderkey % 100)))))), 9) AS score FROM orders")
def logistic_scores(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select("o_orderkey", F.array((F.col("o_orderkey") % 2).cast("double"), (F.col("o_orderkey") % 100).cast("double")).alias("features"))
    return tagger.logistic_scores(o, [1.5, -0.02], 0.25).select("o_orderkey", F.round("score", 9).alias("score"))


@_query("""WITH s AS (SELECT item_id, trim(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', ' ', 'g')) AS s FROM benchmark)
SELECT a.item_id, b.item_id AS other FROM s a JOIN s b ON length(b.s) > 0 AND levenshtein(a.s, b.s)::DOUBLE / length(b.s) <= 0.16""")
def near_sentences(spark, sf_dir):
    """The fuzzy join behind neutral sentences, over whole benchmark texts."""
    s = _t(spark, sf_dir, "benchmark").select("item_id", T.phrase(F.col("text")).alias("s"))
    return synth.near_texts(s, "item_id", "s", fixed.NEUTRAL_TOLERANCE).select("item_id", "other")


@_query()
def ocr_noise(spark, sf_dir):
    return synth.add_noise(_t(spark, sf_dir, "documents").select("doc_id", "text"), 0.02).select("doc_id", "edits")


@_query()
def train_calibration(spark, sf_dir):
    _, c = _verified(spark, sf_dir)
    rows = written(tagger.features(c).select("document_id", "citation_id", "features", (F.col("verdict") == "real").cast("int").alias("ok")))  # training and scoring read it
    coefficients, intercept = tagger.train_calibration(rows)
    return tagger.logistic_scores(rows, coefficients, intercept).select("document_id", "citation_id", "score")


@_query()
def tagger_fusion(spark, sf_dir):
    """A simulated tagger over the citations' truth, merged with half of the rules' output and resolved."""
    d, index, c = _verified_with(spark, sf_dir, stored)
    c = written(c)
    half = c.where(F.pmod(F.xxhash64("document_id"), F.lit(2)) == 0)
    return tagger.merge(d, half, tagger.simulate(c), index).select(*_CASE_COLS)


@_query("""SELECT o_orderkey::VARCHAR AS document_id, 11 AS "start", (11 + length(surface))::INT AS "end", surface, CASE WHEN o_orderstatus <> 'O' THEN 'real' ELSE 'inventada' END AS verdict,
CASE WHEN o_orderstatus <> 'O' THEN (o_orderkey + 7000000000)::VARCHAR END AS canonical_id FROM (SELECT *, CASE o_orderkey % 4 WHEN 0 THEN 'REsp nº' || chr(160) || d || '/' || uf WHEN 1 THEN 'REsp' || chr(160) || 'nº ' || d || '/' || uf
WHEN 2 THEN 'REsp nº ' || replace(d, '.', '.' || chr(160)) || '/' || uf ELSE 'REsp nº ' || d || chr(160) || '(' || uf || ')' END AS surface FROM (""" + _ORDERS + "))")
def nbsp_citations(spark, sf_dir):
    """No-break spaces before the mark, before the number, inside of it, and after it; one that follows the citation isn't part of it."""
    o, nb, k = _orders(spark, sf_dir), F.lit("\u00a0"), F.col("o_orderkey") % 4
    said = F.when(k == 0, F.concat(F.lit("REsp nº"), nb, "d", F.lit("/"), "uf")).when(k == 1, F.concat(F.lit("REsp"), nb, F.lit("nº "), "d", F.lit("/"), "uf"))
    said = said.when(k == 2, F.concat(F.lit("REsp nº "), F.replace("d", F.lit("."), F.concat(F.lit("."), nb)), F.lit("/"), "uf")).otherwise(F.concat(F.lit("REsp nº "), "d", nb, F.lit("("), "uf", F.lit(")")))
    return verify(_docs(o, F.concat(F.lit("Conforme o "), said, nb, F.lit(", nega-se."))), build(_registry(o.where("o_orderstatus <> 'O'"), _heading()))).select("document_id", "start", "end", "surface", "verdict", "canonical_id")


@_query("SELECT o_orderkey::VARCHAR AS document_id, 'REsp nº ' || d || '/' || uf AS surface FROM (" + _ORDERS + ") WHERE o_orderkey % 5 <> 4")
def docket_lines(spark, sf_dir):
    """Lines that label the document's own docket, misread or not, and labelled lines of its header hold no citations; the body does."""
    o, k = _orders(spark, sf_dir), F.col("o_orderkey") % 5
    label = F.when(k == 0, "Processo nº 7654321-00.2020").when(k == 1, "Auto5 nº 4837911-57").when(k == 2, "Rcferência: REsp 123456").when(k == 3, "Nome da parte: REsp 765432").otherwise("Assunto: recurso no REsp 987654")
    body = F.when(k == 4, "Nada mais.").otherwise(F.concat(F.lit("Vide o REsp nº "), "d", F.lit("/"), "uf", F.lit(".")))
    return find_candidates(_docs(o, F.concat(label, F.lit("\n\nI — RELATÓRIO\n\n"), body))).select("document_id", "surface")


@_query("""SELECT p_partkey::VARCHAR AS document_id, 'art. ' || p_size || ' do Código Civil' || CASE p_partkey % 3 WHEN 1 THEN ' de 2002' ELSE '' END AS surface, 'real' AS verdict FROM part WHERE p_partkey % 3 <> 0""")
def year_guard(spark, sf_dir):
    """A statute's name with another statute's year is no citation of it."""
    p = _t(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("string").alias("article"))
    k = F.col("p_partkey") % 3
    d = p.select(F.col("p_partkey").cast("string").alias("document_id"), F.concat(F.lit("Nos termos do art. "), "article", F.lit(" do Código Civil"), F.when(k == 0, " de 1916.").when(k == 1, " de 2002.").otherwise(", nega-se.")).alias("raw"))
    r = p.select("article").distinct().select((F.col("article").cast("long") + 9000000000).alias("id"), F.lit(None).cast("string").alias("court"), F.lit("dispositivo").alias("nature"), F.concat(F.lit("Artigo "), "article", F.lit(" da Lei nº 10.406, de 10 de janeiro de 2002\n")).alias("text"))
    return verify(d, build(r)).select("document_id", "surface", "verdict")


@_query(_case_sql("'REsp nº ' || d || '/' || uf"))
def streaming_verdicts(spark, sf_dir):
    """case_verdicts over a stream of document files."""
    from lexspark.streaming.verify import verify_stream

    o = _orders(spark, sf_dir)
    _docs(o, _cited("Conforme o REsp nº ")).write.parquet(f"{(root := new_folder(spark))}/in")
    index = build(written(_registry(o.where("o_orderstatus <> 'O'"), _heading())))
    verify_stream(spark, f"{root}/in", index, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{root}/out").select(*_CASE_COLS)


_FULL_CLASSES = {"STJ": "Agravo Interno no Recurso em Mandado de Segurança", "STF": "Recurso Extraordinário com Agravo", "TSE": "Agravo Regimental no Recurso Especial Eleitoral", "TST": "Recurso de Revista com Agravo", "STM": "Recurso em Sentido Estrito"}
_SHORT_CLASSES = {"STJ": "AgInt no RMS", "STF": "ARE", "TSE": "AgR no REspe", "TST": "ARR", "STM": "RSE"}
_MISREAD_CLASSES = {"STJ": "Agrav0 Interno no Recurso ern Mandado de Segurança", "STF": "Recurs0 Extraordinário corn Agravo", "TSE": "Agrav0 Regirnental no Recurso Especial Eleitoral", "TST": "Recurs0 de Revista corn Agravo", "STM": "Recurs0 ern Sentido Estrito"}
_pick_sql = lambda column, table: "CASE " + column + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"
_COURT_SQL = "list_value(" + ", ".join(f"'{c}'" for c in fixed.COURTS) + ")[(o_orderkey % 5 + 1)::INT]"


@_query(f"""WITH o AS (SELECT *, {_COURT_SQL} AS court FROM ({_ORDERS})),
f AS (SELECT *, 'full' AS form, {_pick_sql('court', _FULL_CLASSES)} AS cls FROM o UNION ALL SELECT *, 'short', {_pick_sql('court', _SHORT_CLASSES)} FROM o UNION ALL SELECT *, 'misread', {_pick_sql('court', _MISREAD_CLASSES)} FROM o)
SELECT o_orderkey::VARCHAR || '/' || form AS document_id, form, cls || ' nº ' || d || '/' || uf AS surface, CASE WHEN o_orderstatus <> 'O' THEN 'real' ELSE 'inventada' END AS verdict, CASE WHEN o_orderstatus <> 'O' THEN (o_orderkey + 7000000000)::VARCHAR END AS canonical_id FROM f""")
def coverage_forms(spark, sf_dir):
    """Each case in full, abbreviated as its court does, and misread: whatever the form, its record is found; cases not in the registry are invented."""
    o = _orders(spark, sf_dir).withColumn("court", F.element_at(F.array(*map(F.lit, fixed.COURTS)), (F.col("o_orderkey") % 5 + 1).cast("int")))
    full = F.create_map(*(F.lit(x) for kv in _FULL_CLASSES.items() for x in kv))[F.col("court")]
    forms = generate.case_forms(o.select(F.col("o_orderkey").cast("string").alias("id"), F.col("d").alias("number"), "uf", "court", full.alias("full")))
    forms = forms.select(F.concat("id", F.lit("/"), "form").alias("document_id"), "form", "surface")
    before = "Nesse sentido, "
    c = verify(forms.select("document_id", F.concat(F.lit(before), "surface", F.lit(", nega-se.")).alias("raw")), build(_registry(o.where("o_orderstatus <> 'O'"), _heading())))
    return generate.found_forms(c, forms, before)


_NORMS = (("CPC", "do CPC", "do Código de Processo Civil", "da Lei nº 13.105, de 16 de março de 2015"), ("CLT", "da CLT", "da Consolidação das Leis do Trabalho", "do Decreto-Lei nº 5.452, de 1º de maio de 1943"),
          ("CF", "da CF/88", "da Constituição Federal", "da Constituição Federal"), ("LC 64/1990", "da LC nº 64/90", "da Lei Complementar nº 64/1990", "da Lei Complementar nº 64, de 18 de maio de 1990"))
_NORM_MISREAD = ("do Código de Pr0cesso Civil", "da C0nsolidação da5 Leis do Trabalho", "da C0nstituição Federal", "da Lei C0rnplernentar nº 64/1990")


def _norm_sql():
    forms = {
        "short": "'art. ' || a || ' ' || short", "short+clause": "'art. ' || a || ', I, ' || short", "full": "'artigo ' || a || ' ' || full_", "full+clause": "'artigo ' || a || ', inciso I, ' || full_",
        "paragraph": "'art. ' || a || ', § 1º, ' || full_", "line break": "'art.' || chr(10) || a || ' ' || full_", "misread l": "'arl. ' || a || ' ' || bad", "misread o": "'artigõ ' || a || ' ' || bad",
    }
    pick = lambda xs: "list_value(" + ", ".join(f"'{x}'" for x in xs) + ")[(p_partkey % 4 + 1)::INT]"
    base = f"SELECT p_partkey, ((p_partkey // 4) % 900 + 1)::VARCHAR AS a, {pick([n[1] for n in _NORMS])} AS short, {pick([n[2] for n in _NORMS])} AS full_, {pick(_NORM_MISREAD)} AS bad FROM part"
    rows = " UNION ALL ".join(f"SELECT p_partkey, a, '{k}' AS form, {v} AS surface FROM b" for k, v in forms.items())
    return f"""WITH b AS ({base}), f AS ({rows}) SELECT p_partkey::VARCHAR || '/' || form AS document_id, form, surface, CASE WHEN a::INT % 5 = 0 THEN 'inventada' ELSE 'real' END AS verdict,
CASE WHEN a::INT % 5 <> 0 THEN (9000000000 + (p_partkey % 4) * 1000 + a::INT)::VARCHAR END AS canonical_id FROM f"""


@_query(_norm_sql())
def norm_forms(spark, sf_dir):
    """Each article by short and full names, with clauses and paragraphs, over a line break and misread; every fifth isn't in the registry."""
    k, a = (F.col("p_partkey") % 4).cast("int"), F.expr("p_partkey div 4 % 900 + 1").cast("string")
    pick = lambda i: F.element_at(F.array(*(F.lit(n[i]) for n in _NORMS)), k + 1)
    p = _t(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), a.alias("article"), pick(1).alias("short"), pick(2).alias("full"), pick(3).alias("head"), k.alias("law"))
    devices = p.select("article", "head", "law").distinct().where("article % 5 <> 0")
    r = devices.select((F.lit(9000000000) + F.col("law") * 1000 + F.col("article").cast("int")).alias("id"), F.lit(None).cast("string").alias("court"), F.lit("dispositivo").alias("nature"), F.concat(F.lit("Artigo "), "article", F.lit(" "), "head", F.lit("\nTexto")).alias("text"))
    forms = generate.statute_forms(p).select(F.concat("id", F.lit("/"), "form").alias("document_id"), "form", "surface")
    before = "Cumpre observar o disposto no "
    c = verify(forms.select("document_id", F.concat(F.lit(before), "surface", F.lit(", de aplicação cogente ao caso.")).alias("raw")), build(r))
    return generate.found_forms(c, forms, before)


_OUTSIDE = ("art. 5º da Constituição Estadual", "art. 5º da Constituição do Estado de São Paulo", "art. 312 do Código de Processo Penal Militar", "art. 186 do Código Civil de 1916", "art. 373 da Lei nº 13.106/2015", "art. 14 da Lei nº 8.079/1990", "art. 1º da Lei Complementar nº 65/1990", "art. 93 da CF/89")


@_query("SELECT 0::BIGINT AS real, count(*) AS documents FROM part")
def outside_statutes(spark, sf_dir):
    """Statutes outside of the registry whose names start like ones in it: none is real."""
    p = _t(spark, sf_dir, "part")
    said = F.element_at(F.array(*map(F.lit, _OUTSIDE)), (F.col("p_partkey") % len(_OUTSIDE) + 1).cast("int"))
    d = p.select(F.col("p_partkey").cast("string").alias("document_id"), F.concat(F.lit("Nos termos do "), said, F.lit(", nega-se.")).alias("raw"))
    heads = ("Artigo 5 da Constituição Federal", "Artigo 312 do Decreto-Lei nº 3.689, de 3 de outubro de 1941", "Artigo 186 da Lei nº 10.406, de 10 de janeiro de 2002", "Artigo 373 da Lei nº 13.105, de 16 de março de 2015", "Artigo 14 da Lei nº 8.078, de 11 de setembro de 1990", "Artigo 1 da Lei Complementar nº 64, de 18 de maio de 1990", "Artigo 93 da Constituição Federal")
    r = spark.createDataFrame([(str(i), None, "dispositivo", h) for i, h in enumerate(heads)], "id string, court string, nature string, text string")
    real = verify(d, build(r)).where("verdict = 'real'").agg(F.count(F.lit(1)).alias("real"))
    return real.join(d.agg(F.count(F.lit(1)).alias("documents")), how="cross")  # two single rows


@_query("""SELECT s_suppkey::VARCHAR || '/' || form AS document_id, form, replace(replace(mould, '{n}', (s_suppkey // 5 + 1)::VARCHAR), '{t}', t) AS surface, 'real' AS verdict, (s_suppkey + 6000000000)::VARCHAR AS canonical_id
FROM (SELECT s_suppkey, list_value('STF', 'STJ', 'STM', 'TSE', 'TST')[(s_suppkey % 5 + 1)::INT] AS t FROM supplier),
(VALUES ('plain', 'Súmula {n} do {t}'), ('with mark', 'Súmula nº {n} do {t}'), ('short', 'Súm. {n} do {t}'), ('capitals', 'SÚMULA {n} DO {t}'), ('misread', '5úrnula {n} do {t}')) f(form, mould)""")
def sumula_forms(spark, sf_dir):
    """Súmulas with their court in every form but the slash, which the grammar reads without its court."""
    s, _ = _sumulas(spark, sf_dir)
    r = s.select((F.col("s_suppkey") + 6000000000).alias("id"), F.col("court"), F.lit("sumula").alias("nature"), F.concat(F.lit("Súmula n. "), F.col("number").cast("string"), F.lit(" do "), "court", F.lit(" Texto")).alias("text"))
    forms = generate.sumula_forms(s.select(F.col("s_suppkey").cast("string").alias("id"), "number", "court")).where("form <> 'slash'").select(F.concat("id", F.lit("/"), "form").alias("document_id"), "form", "surface")
    before = "Aplica-se a "
    c = verify(forms.select("document_id", F.concat(F.lit(before), "surface", F.lit(", sem reservas.")).alias("raw")), build(r))
    return generate.found_forms(c, forms, before)


@_query("SELECT o_orderkey, true AS kept, true AS read FROM (" + _ORDERS + ")")
def identifier_noise(spark, sf_dir):
    """Noise inside of citations keeps their digits in order, and the record is found all the same."""
    o = _orders(spark, sf_dir)
    clean = F.concat(F.lit("REsp nº "), "d", F.lit("/"), "uf")
    n = written(dealt(o, "o_orderkey").select("o_orderkey", "n", clean.alias("clean"), generate.identifier_noise(clean, "o_orderkey").alias("noisy")))
    d = n.select(F.col("o_orderkey").cast("string").alias("document_id"), F.concat(F.lit("Conforme o "), "noisy", F.lit(" nega-se.")).alias("raw"))
    c = verify(d, build(_registry(o, _heading()))).where("verdict = 'real'").select(F.col("document_id").cast("long").alias("o_orderkey"), F.col("canonical_id"))
    read = F.coalesce(F.col("canonical_id") == (F.col("o_orderkey") + 7000000000).cast("string"), F.lit(False))
    return n.join(c, "o_orderkey", "left").select("o_orderkey", T.keeps_identity(F.col("noisy"), F.col("clean")).alias("kept"), read.alias("read"))


@_query("""WITH s AS (SELECT user_id, event_id, (event_id * 7 % 400)::INT AS a, (event_id * 7 % 400 + 5 + event_id % 23)::INT AS b, value FROM events),
i AS (SELECT g.user_id, g.event_id AS g, p.event_id AS p, p.value, (least(g.b, p.b) - greatest(g.a, p.a))::DOUBLE / (greatest(g.b, p.b) - least(g.a, p.a)) AS iou FROM s g JOIN s p USING (user_id) WHERE g.event_id % 2 = 0 AND p.event_id % 2 = 1 AND g.a < p.b AND p.a < g.b),
c AS (SELECT user_id, g, p, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, p, iou DESC, g DESC) AS k FROM i WHERE iou >= 0.5)""".replace("WITH s", "WITH RECURSIVE s") + """,
f AS (SELECT user_id, k, [struct_pack(g := g, p := p)] AS kept FROM c WHERE k = 1
  UNION ALL SELECT f.user_id, c.k, CASE WHEN len(list_filter(kept, lambda x: x.g = c.g OR x.p = c.p)) > 0 THEN kept ELSE list_append(kept, struct_pack(g := c.g, p := c.p)) END FROM f JOIN c ON c.user_id = f.user_id AND c.k = f.k + 1),
n AS (SELECT sum(len(kept))::BIGINT AS tp FROM (SELECT user_id, arg_max(kept, k) AS kept FROM f GROUP BY user_id))
SELECT tp, (SELECT count(*) FROM s WHERE event_id % 2 = 1) - tp AS fp, (SELECT count(*) FROM s WHERE event_id % 2 = 0) - tp AS fn FROM n""")
def span_scores(spark, sf_dir):
    """Spans matched by score, as the tagger's training does."""
    e = _t(spark, sf_dir, "events").select(F.col("user_id").alias("document_id"), "event_id", (F.col("event_id") * 7 % 400).cast("int").alias("start"), (F.col("event_id") * 7 % 400 + 5 + F.col("event_id") % 23).cast("int").alias("end"), "value")
    gold = e.where("event_id % 2 = 0").select("document_id", F.col("event_id").alias("g"), "start", "end")
    said = e.where("event_id % 2 = 1").select("document_id", F.col("event_id").alias("p"), "start", "end", F.col("value").alias("score"))
    return evaluate.span_scores(gold, said, float("-inf")).select("tp", "fp", "fn")


@_query(f"""SELECT o_orderkey::VARCHAR AS document_id, 'c' || k AS citation_id, surface, verdict, canonical_id, evidence FROM (
  SELECT o_orderkey, 1 AS k, 'REsp nº ' || d || '/' || uf AS surface, CASE WHEN o_orderstatus <> 'O' THEN 'real' ELSE 'inventada' END AS verdict, CASE WHEN o_orderstatus <> 'O' THEN (o_orderkey + 7000000000)::VARCHAR END AS canonical_id, 'num_uf' AS evidence FROM ({_ORDERS})
  UNION ALL SELECT o_orderkey, 2, 'feito ' || d, CASE WHEN o_orderstatus <> 'O' THEN 'real' ELSE 'inventada' END, CASE WHEN o_orderstatus <> 'O' THEN (o_orderkey + 7000000000)::VARCHAR END, 'ner:num' FROM ({_ORDERS}))""")
def fused_citations(spark, sf_dir):
    """The rules find the first citation; a tagger gives the second, which no class heads, a span that names nothing and overlaps it, and one that touches the first."""
    o = _orders(spark, sf_dir)
    first = F.concat(F.lit("REsp nº "), "d", F.lit("/"), "uf")
    d = _docs(o, F.concat(F.lit("Conforme o "), first, F.lit(" e o que ali se disse quanto ao feito "), "d", F.lit(" do acervo.")))
    index = stored(build(_registry(o.where("o_orderstatus <> 'O'"), _heading())))
    at = F.length(F.concat(F.lit("Conforme o "), first, F.lit(" e o que ali se disse quanto ao ")))
    end = at + F.length(F.concat(F.lit("feito "), "d"))
    span = lambda a, b, score: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"), F.lit("JUR").alias("label"), F.lit(score).alias("score"))
    given = F.array(span(at - 16, at + 3, 0.99), span(at, end, 0.95), span(F.lit(13), F.lit(25), 0.99), span(end + 2, end + 9, 0.5))
    tagged = o.select(F.col("o_orderkey").cast("string").alias("document_id"), F.explode(given).alias("s")).select("document_id", "s.*")
    return tagger.merge(d, written(verify(d, index)), tagged, index).select("document_id", "citation_id", "surface", "verdict", "canonical_id", "evidence")


@_query("SELECT doc_id, length(text)::INT AS n, 0 AS \"start\", length(text)::INT AS \"end\" FROM documents WHERE length(text) > 0")
def newline_nfc_lengths(spark, sf_dir):
    """Texts with their accents taken apart and their line ends doubled are normalised to their own lengths, and spans map back."""
    raw = F.replace("text", F.lit("\n"), F.lit("\r\n"))
    for whole, parts in (("é", "e\u0301"), ("ã", "a\u0303"), ("ç", "c\u0327"), ("ü", "u\u0308"), ("ó", "o\u0301")):
        raw = F.replace(raw, F.lit(whole), F.lit(parts))
    d = _t(spark, sf_dir, "documents").where(F.length("text") > 0).select("doc_id", raw.alias("raw"), T.normalised(raw).alias("x"))
    start, end = T.raw_span(F.col("x"), F.lit(0), F.length("x.proc"))
    return d.select("doc_id", F.length("x.proc").alias("n"), start.alias("start"), F.when(end == F.length("raw"), F.length("x.proc")).otherwise(-1).alias("end"))


_MISREAD_NAMES = ("Códig0 de Processo Civil", "Consolidação da5 Leis do Trabaiho", "Constituição Fedcral", "Lei nº 8.245/1991", "Lei nº 8.246/1991", "Estatuto da Crlança e do Adolescente", "Lei Cornplementar nº 64/90", "Regimento Interno")


@_query("WITH a(ord, key, form) AS (VALUES " + ", ".join(f"({i}, '{k}', '{f}')" for i, (k, f) in enumerate(alias_forms())) + """),
n AS (SELECT p_partkey AS id, trim(regexp_replace(replace(lower(strip_accents(list_value(""" + ", ".join(f"'{x}'" for x in _MISREAD_NAMES) + """)[(p_partkey % 8 + 1)::INT])), 'º', 'o'), '[^a-z0-9/]+', ' ', 'g')) AS name FROM part)
SELECT id, key, round(levenshtein(name, form)::DOUBLE / length(form), 9) AS distance FROM n JOIN a ON levenshtein(name, form)::DOUBLE / length(form) <= 0.22 AND regexp_replace(form, '[^0-9]', '', 'g') IN ('', regexp_replace(name, '[^0-9]', '', 'g'))
QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(levenshtein(name, form)::DOUBLE / length(form), 3), ord) = 1""")
def statute_ocr_names(spark, sf_dir):
    """Misread names of statutes joined to the table of aliases; a number that differs in a digit, and another text, meet none."""
    name = F.element_at(F.array(*map(F.lit, _MISREAD_NAMES)), (F.col("p_partkey") % 8 + 1).cast("int"))
    found = statutes.nearest_alias(_t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), name.alias("name")), statutes.alias_table(spark))
    return found.withColumn("distance", F.round("distance", 9))
