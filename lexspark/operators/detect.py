"""Detection: documents -> candidate spans, one Arrow pass over the texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.shared import dealt

SCHEMA = (
    "document_id string, seq int, family int, start int, end int, surface string, kind string, alias string, article string, number string,"
    " court string, binding boolean, readings array<string>, uf string, n_digits int, noisy boolean, class_words int, raw_start int, raw_end int, raw_surface string"
)


def arrow_types(schema: str) -> list:
    """The Arrow types of a schema in the form of SCHEMA."""
    import pyarrow as pa

    kinds = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
    return [kinds[t] for t in schema.replace(",", "").split()[1::2]]


def find_candidates(docs: DataFrame, diffuse: bool = False, neutral: tuple[str, ...] = (), settled: bool = False) -> DataFrame:
    """docs: (document_id, raw) -> candidates, in both normalised and raw offsets.

    ``settled``: only those that stay by ``arbitrate``'s rule, with their number by place in
    the document (place); rows of one document meet by a sort inside of the tasks, so
    candidates needn't be shuffled again.

    ``neutral``: sentences of filler whose look-alikes are no citations; a short list,
    cut down to those that would give a candidate at all.  Documents are dealt by id.
    """
    from lexspark.functions import spans

    listed = tuple(spans.folded_phrase(s) for s in neutral if next(spans.vague(s), None))

    def run(batches):
        import pyarrow as pa

        import pyarrow.compute as pc

        from lexspark.functions.spans import OTHERS, candidates, first_come
        from lexspark.functions.text import normalise

        def read(doc, raw, only_numbers):
            text, starts, ends = normalise(raw)
            for i, c in enumerate(candidates(text, diffuse, listed, only_numbers and text is raw)):
                a, z = (c.start, c.end) if starts is None else (starts[c.start], ends[c.end - 1])
                yield (doc, i, c.family, c.start, c.end, text[c.start : c.end], c.kind, c.alias, c.article, c.number, c.court, c.binding, c.readings, c.uf, c.n_digits, c.noisy, c.class_words, a, z, raw[a:z])

        def settle(rows):
            if len(rows) < 2:
                return [(*r, 1) for r in rows]
            kept = first_come(sorted(rows, key=lambda r: (r[2], r[1], *r[3:7])), at=3)
            place = {id(r): n for n, r in enumerate(sorted(kept, key=lambda r: r[3]), 1)}
            return [(*r, place[id(r)]) for r in kept]

        def batch(rows):
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], names)

        last, own, rows = None, [], []
        for b in batches:
            others = pc.match_substring_regex(b.column(1), OTHERS)
            for doc, raw, other in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), others.to_pylist(), strict=True):
                if not raw:
                    continue
                if not settled:
                    rows += read(doc, raw, not other)
                    continue
                if doc != last:
                    rows += settle(own)
                    last, own = doc, []
                own += read(doc, raw, not other)
            yield batch(rows)
            rows = []
        yield batch(settle(own))

    schema = SCHEMA + ", place int" if settled else SCHEMA
    names, types = schema.replace(",", "").split()[::2], arrow_types(schema)
    d = dealt(docs.select(F.col("document_id").cast("string"), "raw"), "document_id")
    if settled:
        d = d.sortWithinPartitions("document_id")
    return d.mapInArrow(run, schema.replace(" end ", " `end` "))
