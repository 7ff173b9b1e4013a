"""Sources and sinks: raw texts, the SQLite registry, gold and submission CSV, contract JSON, index tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lexspark.operators.index import Index

REGISTRY = "document_id string, id long, court string, year int, rapporteur string, nature string, kind string, text string, place long"
GOLD = "nivel int, documento_id string, citacao_id string, inicio int, fim int, trecho string, tipo string, classificacao string, id_canonico string"
SPAN = "inicio int, fim int, rotulo string, score double"
_CITATION = "id string, inicio int, fim int, trecho string, tipo string, classificacao string, resolucao struct<fonte:string,id_canonico:string>, confianca double, evidencia string"


def read_texts(spark: SparkSession, folder: str, glob: str = "*.txt") -> DataFrame:
    """(document_id, raw): whole files as UTF-8, line ends and BOM untouched; the id is the file's name without its ending.  A folder without such files is an error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    if not files.select("path").limit(1).count():
        raise FileNotFoundError(f"no {glob} in {folder}")
    name = F.regexp_replace(F.regexp_extract("path", r"([^/]+)$", 1), r"\.[^.]*$", "")
    return files.select(name.alias("document_id"), F.decode("content", "UTF-8").alias("raw"))


class _Range(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class _RegistryReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.n = options["path"], int(options.get("partitions", 4))

    def _rows(self, sql, *values):
        import sqlite3

        con = sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)
        try:
            yield from con.execute(sql, values)
        finally:
            con.close()

    def partitions(self):
        low, high = next(self._rows("select min(rowid), max(rowid) from documentos"))
        if low is None:
            return [_Range(0, 0)]
        step = max(1, -(-(high - low + 1) // self.n))
        return [_Range(a, a + step) for a in range(low, high + 1, step)]

    def read(self, partition):
        sql = "select documento_id, id, tribunal, ano, relator, natureza, tipo, texto, rowid from documentos where rowid >= ? and rowid < ? order by rowid"
        yield from self._rows(sql, partition.low, partition.high)


class RegistrySource(DataSource):
    """format("legal_registry"): a SQLite registry, read by ranges of rows; place is a record's place in a scan.

    The file must stand at the same path on every machine that reads it.
    """

    @classmethod
    def name(cls):
        return "legal_registry"

    def schema(self):
        return REGISTRY

    def reader(self, schema):
        return _RegistryReader(self.options)


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(RegistrySource)
    return spark.read.format("legal_registry").option("path", path).load()


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """(level, document_id, g, start, end, surface, kind, verdict, ids); several ids may stand in a field."""
    from pyspark.sql import Window

    g = spark.read.csv(path, header=True, schema=GOLD, multiLine=True, quote='"', escape='"')
    ids = F.filter(F.split(F.coalesce("id_canonico", F.lit("")), r"[\s:;,]+"), lambda x: (x != "") & (x != "-"))
    index = (F.row_number().over(Window.partitionBy("documento_id").orderBy("inicio", "fim", "citacao_id")) - 1).alias("g")
    return g.select(F.col("nivel").alias("level"), F.col("documento_id").alias("document_id"), index, F.col("inicio").alias("start"), F.col("fim").alias("end"), F.col("trecho").alias("surface"), F.col("tipo").alias("kind"), F.col("classificacao").alias("verdict"), ids.alias("ids"))


def write_contract(contract: DataFrame, folder: str) -> None:
    """The contract as JSON lines, a document each, in as many files as there are partitions: the form for many documents."""
    contract.select("json").write.mode("overwrite").text(folder)


def write_contract_files(contract: DataFrame, folder: str) -> None:
    """One <document_id>.json a document, each written whole and then renamed: the form for a folder of some thousand documents."""
    root = folder.rstrip("/")
    spark = contract.sparkSession
    made = contract.select(F.col("json").alias("value"), "document_id")
    made.write.mode("overwrite").partitionBy("document_id").text(f"{root}/_parts")
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(sc._jsc.hadoopConfiguration())
    for row in spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load(f"{root}/_parts").select("path").toLocalIterator():
        name = sc._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName(row.path.split("/document_id=")[1].split("/")[0])
        fs.delete(path(f"{root}/{name}.json"), False)
        fs.rename(path(row.path), path(f"{root}/{name}.json"))
    fs.delete(path(f"{root}/_parts"), True)


def read_contract_files(spark: SparkSession, folder: str) -> DataFrame:
    """(document_id, json) of a folder of <document_id>.json files, whatever they hold."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder)
    return files.select(F.regexp_replace(F.regexp_extract("path", r"([^/]+)$", 1), r"\.json$", "").alias("document_id"), F.decode("content", "UTF-8").alias("json"))


def read_contract(spark: SparkSession, folder: str) -> DataFrame:
    """Citations of a folder of contract files, one JSON text a line or a file; documents without a file just have none: document_id, citation_id, start, end, surface, kind, verdict, canonical_id, confidence, evidence."""
    schema = f"schema_version string, documento_id string, citacoes array<struct<{_CITATION.replace(' ', ':').replace(',:', ',')}>>"
    d = spark.read.text(folder, recursiveFileLookup=True, pathGlobFilter="[!._]*").select(F.from_json("value", schema).alias("d"))
    c = d.select(F.col("d.documento_id").alias("document_id"), F.explode("d.citacoes").alias("c"))
    return c.select("document_id", F.col("c.id").alias("citation_id"), F.col("c.inicio").alias("start"), F.col("c.fim").alias("end"), F.col("c.trecho").alias("surface"), F.col("c.tipo").alias("kind"), F.col("c.classificacao").alias("verdict"), F.col("c.resolucao.id_canonico").alias("canonical_id"), F.col("c.confianca").alias("confidence"), F.col("c.evidencia").alias("evidence"))


def write_submission(rows: DataFrame, path: str) -> None:
    rows.orderBy("documento_id").write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def read_spans(spark: SparkSession, path: str) -> DataFrame:
    """A tagger's spans -> (document_id, start, end, label, score): {document: [span]} as one text, or one such object a line."""
    kind = f"map<string,array<struct<{SPAN.replace(' ', ':').replace(',:', ',')}>>>"
    lines = F.filter(F.split("value", "\n"), lambda x: F.trim(x) != "")
    whole = F.array(F.from_json("value", kind))
    maps = F.when(F.forall(lines, lambda x: F.json_object_keys(x).isNotNull()), F.transform(lines, lambda x: F.from_json(x, kind))).otherwise(whole)
    j = spark.read.text(path, wholetext=True).select(F.explode(maps).alias("m")).select(F.explode("m").alias("document_id", "spans"))
    return j.select("document_id", F.explode("spans").alias("s")).select("document_id", F.col("s.inicio").alias("start"), F.col("s.fim").alias("end"), F.col("s.rotulo").alias("label"), "s.score")


def write_spans(spans: DataFrame, folder: str) -> None:
    """A tagger's spans, {document: [span]} a line."""
    one = F.struct(F.col("start").alias("inicio"), F.col("end").alias("fim"), F.col("label").alias("rotulo"), "score")
    rows = spans.groupBy("document_id").agg(F.array_sort(F.collect_list(one)).alias("s"))
    rows.select(F.to_json(F.create_map("document_id", "s")).alias("value")).write.mode("overwrite").text(folder)


def write_windows(w: DataFrame, entities: DataFrame, folder: str) -> None:
    """Training windows as JSON lines: id, texto, entidades in the window's offsets."""
    one = F.struct(F.col("start").alias("inicio"), F.col("end").alias("fim"), F.col("label").alias("rotulo"))
    e = entities.groupBy("document_id", "window").agg(F.array_sort(F.collect_list(one)).alias("entidades"))
    empty = F.array().cast("array<struct<inicio:int,fim:int,rotulo:string>>")
    rows = w.join(e, ["document_id", "window"], "left").select(F.concat("document_id", F.lit("#"), "window").alias("id"), F.col("text").alias("texto"), F.coalesce("entidades", empty).alias("entidades"))
    rows.write.mode("overwrite").json(folder)


def read_windows(spark: SparkSession, path: str) -> DataFrame:
    """(document_id, window, text, entities) of training windows; blank lines don't count."""
    j = spark.read.schema("id string, texto string, entidades array<struct<inicio:int,fim:int,rotulo:string>>").json(path).where("id is not null")
    part = lambda k: F.element_at(F.split("id", "#(?=[0-9]+$)"), k)
    return j.select(part(1).alias("document_id"), part(2).cast("int").alias("window"), F.col("texto").alias("text"), F.col("entidades").alias("entities"))


_TEMPLATE_NAMES = {"headers": "cabecalhos", "sections": "secoes", "filler": "enchimento", "closings": "fechos", "neutral": "neutras"}


def read_templates(spark: SparkSession, path: str) -> dict:
    """Lists of headers, sections, filler, closings and neutral sentences, and carriers by "kind|verdict"; a small file, read whole."""
    fields = ", ".join(f"{v} array<string>" for v in _TEMPLATE_NAMES.values())
    row = spark.read.schema(f"{fields}, veiculos map<string,array<string>>").json(path, multiLine=True).first()
    return {k: list(row[v] or []) for k, v in _TEMPLATE_NAMES.items()} | {"carriers": {k: list(v) for k, v in (row["veiculos"] or {}).items()}}


_TABLES = ("cases", "sumulas", "statutes", "meta")


def write_index(index: Index, folder: str) -> None:
    """The tables in order of their keys, so that equal registries give equal rows in equal order."""
    for name in _TABLES:
        t = getattr(index, name)
        t.orderBy(*t.columns[:2]).write.mode("overwrite").parquet(f"{folder}/{name}")


def read_index(spark: SparkSession, folder: str) -> Index:
    return Index(*(spark.read.parquet(f"{folder}/{name}") for name in _TABLES))
