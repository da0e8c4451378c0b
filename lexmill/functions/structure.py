"""Structure of legal texts: units of a body, references with their places, clauses."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def units(lines: DataFrame, key: str, at: str, line: str, levels: dict[str, str]) -> DataFrame:
    """lines with one column for each level: the last marker of that level at or before the line, null once a
    marker of a higher level has opened since. levels: name -> pattern whose first group is the marker, from the
    highest down. A line's unit comes from the lines before it by windows that fill down within a document."""
    out, above = lines, []
    w = Window.partitionBy(key).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    for name, pattern in levels.items():
        mark = F.nullif(F.regexp_extract(line, pattern, 1), F.lit(""))
        out = out.withColumn(f"_{name}_at", F.max(F.when(mark.isNotNull(), F.col(at))).over(w)).withColumn(f"_{name}", F.last(mark, ignorenulls=True).over(w))
        open_ = F.col(f"_{name}_at").isNotNull()
        for higher in above:
            open_ = open_ & (F.col(f"_{name}_at") >= F.coalesce(F.col(f"_{higher}_at"), F.lit(-1)))
        out = out.withColumn(name, F.when(open_, F.col(f"_{name}")))
        above.append(name)
    return out.drop(*[f"_{n}_at" for n in levels], *[f"_{n}" for n in levels])


def unit_id(document: Column, parts: dict[str, Column], otherwise: Column) -> Column:
    """document and the fragments that are there; a block number where none is."""
    fragments = F.concat_ws("-", *[F.when(c.isNotNull(), F.concat(F.lit(prefix), c)) for prefix, c in parts.items()])
    return F.concat_ws("-", document.cast("string"), F.when(fragments != "", fragments).otherwise(F.concat(F.lit("block"), otherwise.cast("string"))))


def references(rows: DataFrame, key: str, text: str, patterns: dict[str, str]) -> DataFrame:
    """key, kind, start, end, body of the references in a text; kinds are tried in order, and a match that
    overlaps one taken before does not count. Places are code points, ends exclusive."""
    import re

    import pyarrow as pa

    compiled = [(kind, re.compile(p)) for kind, p in patterns.items()]
    kind_of = rows.schema[key].dataType.simpleString()

    def found(t: str) -> list[tuple[str, int, int, str]]:
        taken: list[tuple[str, int, int, str]] = []
        for kind, p in compiled:
            taken += [(kind, m.start(), m.end(), m[0]) for m in p.finditer(t) if not any(m.start() < b and a < m.end() for _, a, b, _ in taken)]
        return sorted(taken, key=lambda x: x[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            each = [found(t or "") for t in b.column(1).to_pylist()]
            flat = [x for e in each for x in e]
            place = pa.array([i for i, e in enumerate(each) for _ in e], pa.int64())
            cols = [pa.array([x[i] for x in flat], k) for i, k in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([b.column(0).take(place), *cols], names=[key, "kind", "start", "end", "body"])

    return rows.select(key, text).mapInArrow(run, f"{key} {kind_of}, kind string, start bigint, end bigint, body string")
