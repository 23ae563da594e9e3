"""Sinks: JSON lines, CSV, tiers and small reports."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def json_lines(frame: DataFrame, path: str) -> None:
    frame.write.mode("overwrite").json(path)


def json_array(frame: DataFrame, path: str) -> None:
    """All rows as one JSON array in one file, an element a line. The format has one writer; it streams."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = "["
        for batch in batches:
            out = []
            for row in batch.column("value").to_pylist():
                out.append(lead + row)
                lead = ","
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["]" if lead == "," else "[]"])], ["value"])

    rows = frame.select(F.to_json(F.struct("*")).alias("value")).coalesce(1)
    rows.mapInArrow(lines, "value string").write.mode("overwrite").text(path)


def csv(frame: DataFrame, path: str, fields: Sequence[str] | None = None) -> None:
    """Stated fields in order (others left out, missing ones empty), else the columns sorted; arrays
    joined by semicolons. Files begin with a byte-order mark, as the first name's first character."""
    fields = list(fields) if fields else sorted(frame.columns)
    kinds = dict(frame.dtypes)
    shown = [F.array_join(F.col(c).cast("array<string>"), ";").alias(c) if kinds.get(c, "").startswith("array") else F.col(c) if c in kinds else F.lit("").alias(c) for c in fields]
    marked = frame.select(*shown)
    marked.withColumnRenamed(fields[0], "\ufeff" + fields[0]).write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


def by_key(frame: DataFrame, path: str, key: str, form: str = "json") -> None:
    """One folder a value of the key: rule levels, audit tiers, industries, pairs."""
    frame.write.mode("overwrite").partitionBy(key).format(form).save(path)


def tiers(frame: DataFrame, path: str, column: str = "tier") -> dict[str, DataFrame]:
    """Write once by tier; the tiers and their older names as views of that one table."""
    by_key(frame, path, column, "parquet")
    back = frame.sparkSession.read.schema(T.StructType([*[f for f in frame.schema if f.name != column], frame.schema[column]])).parquet(path)
    pick = lambda *names: back.where(F.col(column).isin(*names))
    return {"all": back, "high": pick("high"), "medium": pick("medium"), "review": pick("review"), "verified": pick("high"), "needs_review": pick("medium", "review"), "rejected": back.limit(0)}


def leading(frame: DataFrame, order: Sequence, n: int = 1000) -> DataFrame:
    """The first n rows by a stated order."""
    return frame.orderBy(*order).limit(n)


def review_queue(frame: DataFrame, path: str, flag: str = "need_human_review", columns: Sequence[str] | None = None) -> None:
    """The rows that a person has to look at, as CSV with the given columns in order."""
    csv(frame.where(F.coalesce(F.col(flag), F.lit(False))), path, columns)


def updated(stored: DataFrame, found: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Stored rows with new values where a key was found, the first of equals; the caller writes the
    result beside the old table and swaps."""
    first = found.groupBy(*keys).agg(*[F.min_by(F.col(v), F.struct(*[F.col(x) for x in values])).alias(f"new_{v}") for v in values])
    rows = stored.join(first, list(keys), "left")
    for v in values:
        rows = rows.withColumn(v, F.coalesce(f"new_{v}", v) if v in stored.columns else F.col(f"new_{v}")).drop(f"new_{v}")
    return rows


def appended(existing: DataFrame, new: DataFrame) -> DataFrame:
    return existing.unionByName(new, allowMissingColumns=True)


def markdown(title: str, sections: Mapping[str, DataFrame], most: int = 200) -> str:
    """Aggregates as a report; each section shows at most ``most`` rows."""
    out = [f"# {title}"]
    for name, frame in sections.items():
        out += ["", f"## {name}", "", "| " + " | ".join(frame.columns) + " |", "|" + "---|" * len(frame.columns)]
        out += ["| " + " | ".join("" if v is None else str(v) for v in row) + " |" for row in frame.limit(most).collect()]
    return "\n".join(out) + "\n"


def manifest(counts: Mapping[str, DataFrame], **arguments: str) -> dict:
    """Row counts by name, and the run's arguments."""
    return {"counts": {name: frame.count() for name, frame in counts.items()}, "arguments": arguments}
