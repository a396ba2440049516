"""Readers with defined positions and strict schemas, and the matching writers."""

from __future__ import annotations

import json
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BOM = b"\xef\xbb\xbf"
# Fixed value: character pairs that damaged UTF-8 leaves behind.
MOJIBAKE = "Ã[\x80-\xbf]|Â[\xa0-\xbf]|â€|�"


def strings(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def read_csv(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """All-string CSV with a header, quoted line breaks and doubled quotes; empty cells are empty strings. With ``columns`` the header must be just these."""
    df = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', inferSchema=False)
    df = df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c.strip().lstrip("﻿")) for c in df.columns])
    if columns is not None and df.columns != columns:
        raise ValueError(f"{path}: header {df.columns} is not {columns}")
    return df


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str, strict: bool = True) -> DataFrame:
    """JSON lines; a bad line fails the read where ``strict``, else it is left out. Blank lines are skipped."""
    return spark.read.schema(schema).json(path, mode="FAILFAST" if strict else "DROPMALFORMED")


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Whole-file JSON."""
    return (spark.read.schema(schema) if schema else spark.read).json(path, multiLine=True)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_rows(spark: SparkSession, path: str, columns: list[str] | None = None, schema: T.StructType | str | None = None) -> DataFrame:
    """The reader that the suffix names: ``.jsonl``, ``.json``, ``.parquet``, else CSV."""
    suffix = Path(path).suffix
    if suffix == ".jsonl":
        return read_jsonl(spark, path, schema) if schema else spark.read.json(path)
    if suffix == ".json":
        return read_json(spark, path, schema)
    return read_parquet(spark, path) if suffix == ".parquet" else read_csv(spark, path, columns)


def first_existing(*paths: str) -> str:
    for p in paths:
        if os.path.exists(p):
            return p
    raise FileNotFoundError(", ".join(paths))


def with_positions(df: DataFrame, name: str = "pos") -> DataFrame:
    """``df`` with the zero-based position of each row in its files, without one task for all.

    Rows are numbered inside each partition and shifted by the sizes of the ones
    before; needs a frame read straight from files, whose partitions have an order.
    """
    from pyspark.sql.window import Window

    numbered = df.withColumn("_at", F.monotonically_increasing_id())
    part = F.shiftright("_at", 33)
    sizes = numbered.groupBy(part.alias("_p")).agg(F.count("*").alias("_c"))
    starts = sizes.select("_p", (F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_c")).alias("_s"))
    shifted = numbered.withColumn("_p", part).join(F.broadcast(starts), "_p")  # one row a partition: some bytes for each task
    return shifted.withColumn(name, F.col("_s") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at", "_p", "_s")


def conversations(spark: SparkSession, path: str, field: str = "text") -> DataFrame:
    """(line, human, bot): turns of JSON lines with ``<human>:`` and ``<bot>:`` marks; unreadable lines are left out but counted in ``line``."""
    lines = with_positions(spark.read.text(path), "line")
    t = F.try_variant_get(F.try_parse_json("value"), f"$.{field}", "string")
    human = F.trim(F.get(F.split(F.get(F.split(t, "<human>:", 2), 1), "<bot>:", 2), 0))
    return lines.select("line", human.alias("human"), F.trim(F.get(F.split(t, "<bot>:", 2), 1)).alias("bot")).where("human IS NOT NULL")


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256, valid_utf8, has_nul, damaged): each file's digest, whether it decodes, and whether the text holds NUL or what damaged UTF-8 leaves behind; NULL where it does not decode."""
    content = F.col("content")
    text = F.expr("try_validate_utf8(cast(content as string))")
    return spark.read.format("binaryFile").load(path).select(
        "path", F.col("length").alias("bytes"), F.sha2(content, 256).alias("sha256"), text.isNotNull().alias("valid_utf8"), text.contains("\0").alias("has_nul"), F.rlike(text, F.lit(MOJIBAKE)).alias("damaged")
    )


def require_digest(spark: SparkSession, path: str, sha256: str) -> None:
    if [r.sha256 for r in file_digests(spark, path).select("sha256").collect()] != [sha256]:
        raise ValueError(f"{path} has changed")


def write_csv(df: DataFrame, path: str, columns: list[str], mode: str = "overwrite") -> None:
    """The named columns only; missing ones are empty."""
    df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in columns]).write.csv(path, header=True, mode=mode, quote='"', escape='"', emptyValue="")


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.json(path, mode=mode, ignoreNullFields=False)


def write_report(value: object, path: str) -> None:
    """A small value as indented JSON, replaced in one step."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    part = target.with_suffix(target.suffix + ".part")
    part.write_text(json.dumps(value, ensure_ascii=False, indent=2) + "\n", encoding="utf-8")
    part.replace(target)


def add_bom(path: str) -> bool:
    """Put a byte-order mark in front; False if there is one already."""
    p = Path(path)
    data = p.read_bytes()
    if data.startswith(BOM):
        return False
    p.write_bytes(BOM + data)
    return True


def shown(value: float | None, places: int = 3, signed: bool = False, percent: bool = False, nothing: str = "-") -> str:
    """A number as reports have it: fixed places, with a sign or as a percentage."""
    if value is None:
        return nothing
    return f"{value * 100:.{places}f}%" if percent else f"{value:{'+' if signed else ''}.{places}f}"


def shown_p(p: float | None, places: int = 3) -> str:
    """A p value; below a thousandth only that."""
    return "n/a" if p is None else "<0.001" if p < 0.001 else f"{p:.{places}f}"


def comparison_report(title: str, sections: dict[str, dict[str, tuple]], base: str, other: str) -> str:
    """Markdown with a table for each section: measures (base, other), their values and the difference."""
    out = [f"# {title}\n"]
    for name, measures in sections.items():
        rows = [{"metric": m, base: shown(a), other: shown(b), "delta": shown(None if a is None or b is None else b - a, signed=True)} for m, (a, b) in measures.items()]
        out.append(f"## {name}\n\n{markdown(rows, ['metric', base, other, 'delta'])}\n")
    return "\n".join(out)


def counts_report(title: str, tables: dict[str, list[dict]]) -> str:
    """Markdown with a table of collected counts for each heading; empty ones say so."""
    return f"# {title}\n\n" + "\n".join(f"## {name}\n\n" + (markdown(rows, list(rows[0])) if rows else "none") + "\n" for name, rows in tables.items())


def markdown(rows: list[dict], columns: list[str]) -> str:
    """A table of a few collected rows; numbers with three places, a dash for nothing."""
    show = lambda v: "-" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    return "\n".join(lines + ["| " + " | ".join(show(r.get(c)) for c in columns) + " |" for r in rows])


def parse_csv(text: str) -> list[list[str]]:
    """The records of RFC 4180 text; a quote that opens inside a cell, text after a closing one and an unclosed one fail."""
    out: list[list[str]] = []
    row: list[str] = []
    at, n = 0, len(text)
    while at < n:
        if text[at] == '"':
            end, parts = at + 1, []
            while True:
                stop = text.find('"', end)
                if stop < 0:
                    raise ValueError(f"unclosed quote at {at}")
                parts.append(text[end:stop])
                if text[stop + 1 : stop + 2] != '"':
                    break
                parts.append('"')
                end = stop + 2
            cell, at = "".join(parts), stop + 1
            if at < n and text[at] not in ",\r\n":
                raise ValueError(f"text after a quote at {at}")
        else:
            stop = min((x for x in (text.find(c, at) for c in ",\r\n") if x >= 0), default=n)
            cell, at = text[at:stop], stop
            if '"' in cell:
                raise ValueError(f"quote inside a cell at {at}")
        row.append(cell)
        if at < n and text[at] == ",":
            at += 1
            if at == n:
                row.append("")
            elif text[at] in "\r\n":
                row.append("")
                at += 2 if text[at : at + 2] == "\r\n" else 1
                out.append(row)
                row = []
            continue
        out.append(row)
        row = []
        at += 2 if text[at : at + 2] == "\r\n" else 1
    return [*out, row] if row else out


def format_csv(rows: list[list[str]]) -> str:
    """RFC 4180 text with CRLF; cells are quoted only where they must be."""
    cell = lambda c: '"' + c.replace('"', '""') + '"' if any(x in c for x in ',"\r\n') else c
    return "".join(",".join(map(cell, r)) + "\r\n" for r in rows)


def read_strict_csv(path: str, columns: list[str]) -> tuple[list[list[str]], list[str]]:
    """(records, problems) of a small contract file: other encodings, NUL, another or a repeated header and records of another width are named, not read."""
    try:
        text = Path(path).read_bytes().decode("utf-8-sig")
    except UnicodeDecodeError:
        return [], ["not UTF-8"]
    if "\0" in text:
        return [], ["NUL in the text"]
    try:
        rows = parse_csv(text)
    except ValueError as e:
        return [], [str(e)]
    if not rows or rows[0] != columns or len(set(columns)) != len(columns):
        return [], [f"header {rows[0] if rows else []} is not {columns}"]
    problems = [f"record {k}: {len(r)} cells" for k, r in enumerate(rows[1:], 1) if len(r) != len(columns)]
    return [r for r in rows[1:] if len(r) == len(columns)], problems


def read_locked_csv(spark: SparkSession, path: str, sha256: str, columns: list[str], rows: int) -> DataFrame:
    """A CSV that must be the one that was locked: digest, header and number of rows."""
    require_digest(spark, path, sha256)
    df = read_csv(spark, path, columns)
    if (n := df.count()) != rows:
        raise ValueError(f"{path}: {n} rows are not {rows}")
    return df


def read_sets(spark: SparkSession, paths: list[str], column: str, keep: tuple[int, ...]) -> DataFrame:
    """Rows of several CSV files whose set number is one of ``keep``, with ``source_row_id`` (file and position); what is no number is left out."""
    parts = []
    for p in paths:
        df = with_positions(read_csv(spark, p), "_pos")
        parts.append(df.withColumn(column, F.expr(f"cast(try_cast(`{column}` as double) as int)")).withColumn("source_row_id", F.concat(F.lit(f"{Path(p).name}:"), F.col("_pos"))).drop("_pos"))
    out = parts[0]
    for df in parts[1:]:
        out = out.unionByName(df)
    return out.where(F.col(column).isin(*keep))


def write_provenance(path: str, inputs: list[str], counts: dict) -> None:
    """What a step was made from: digest and size of each input, and its counts."""
    import hashlib

    files = [{"path": p, "bytes": len(data), "sha256": hashlib.sha256(data).hexdigest()} for p in inputs for data in [Path(p).read_bytes()]]
    write_report({"inputs": files, "counts": counts}, path)


def write_chat_jsonl(df: DataFrame, path: str, record: str, mode: str = "overwrite") -> None:
    """The JSON texts of a column, one a line."""
    df.select(F.col(record).alias("value")).write.mode(mode).text(path)
