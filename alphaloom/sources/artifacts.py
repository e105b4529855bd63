"""Benchmarks, universes and report files."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.collect import numeric, parsed_date
from ..operators.crosssection import observed
from ..operators.joins import keep_last


def _series(df: DataFrame, dates: list[str], values: list[str]) -> DataFrame:
    date, value = (next((c for c in df.columns if c.lower() in names), None) for names in (dates, values))
    if date is None or value is None:
        raise ValueError("a benchmark needs a date and a value column")
    rows = df.select(F.monotonically_increasing_id().alias("_n"), parsed_date(F.col(date).cast("string")).alias("date"), numeric(F.col(value)).alias("value"))
    rows = rows.where(F.col("date").isNotNull() & observed("value").isNotNull())
    return keep_last(rows, ["date"], "_n").select("date", "value")


def benchmark(spark: SparkSession, path: str) -> DataFrame:
    """date and value of a CSV or Parquet series: unreadable rows are skipped, the last of equal dates stays; empty is an error."""
    kind = path.rstrip("/").rpartition(".")[2].lower()
    if kind in ("csv", "txt"):
        df = spark.read.csv(path, header=True)
    elif kind in ("parquet", "pq"):
        df = spark.read.parquet(path)
    else:
        raise ValueError(f"unknown benchmark format {kind}")
    out = _series(df, ["date", "datetime", "trade_date"], ["close", "value", "return", "ret"])
    if out.isEmpty():
        raise ValueError("the benchmark is empty")
    return out


def universe(spark: SparkSession, path: str) -> DataFrame:
    """symbol, start and end of a file of tab-separated intervals without a header, or of a CSV with one; blanks are open ends."""
    if path.endswith(".csv"):
        df = spark.read.csv(path, header=True)
        df = df.toDF(*(c.lower() for c in df.columns))
    else:
        df = spark.read.csv(path, sep="\t", schema="symbol string, start string, end string")
    end = lambda c: parsed_date(F.when(~F.lower(F.trim(F.col(c))).isin("", "nan", "nat", "none", "null"), F.col(c)))
    return df.select(F.trim("symbol").alias("symbol"), end("start").alias("start"), end("end").alias("end"))


def csv_report(df: DataFrame, path: str, digits: int = 12) -> None:
    """Writes a report with doubles of a fixed number of decimals, or nothing where a value is missing."""
    text = [F.when(observed(c).isNotNull(), F.format_string(f"%.{digits}f", c)).otherwise(F.lit("")).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    df.select(*text).write.mode("overwrite").csv(path, header=True)


def tsv_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, sep="\t")


def json_report(df: DataFrame, path: str) -> None:
    """A line for each row; missing values are left out."""
    df.write.mode("overwrite").json(path)


def markdown_table(df: DataFrame, rows: int = 20, digits: int = 4) -> str:
    """The first rows of a report as a table; how many are left out is said. Only those rows reach the driver."""
    shown = df.limit(rows).collect()
    text = lambda v: "" if v is None or v != v else f"{v:.{digits}f}" if isinstance(v, float) else str(v).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns), *("| " + " | ".join(map(text, r)) + " |" for r in shown)]
    more = df.count() - len(shown) if len(shown) == rows else 0
    return "\n".join(lines + ([f"\n{more} more rows"] if more else []))


def readme(title: str, facts: dict[str, object], tables: dict[str, DataFrame] | None = None, rows: int = 20) -> str:
    """A report for people: facts as a list, then a table under each heading."""
    parts = [f"# {title}", "\n".join(f"- {k}: {v}" for k, v in facts.items())]
    parts += [f"## {name}\n\n{markdown_table(df, rows)}" for name, df in (tables or {}).items()]
    return "\n\n".join(p for p in parts if p) + "\n"


def csv_rows(spark: SparkSession, path: str, required: list[str] | None = None) -> DataFrame:
    """A CSV artifact as text in the order of its header; an error without rows or required columns."""
    df = spark.read.csv(path, header=True)
    absent = [c for c in required or [] if c not in df.columns]
    if absent:
        raise ValueError(f"{path} lacks {', '.join(absent)}")
    if df.isEmpty():
        raise ValueError(f"{path} has no rows")
    return df


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def parquet_if_any(spark: SparkSession, path: str) -> DataFrame | None:
    """A Parquet dataset, or None where nothing is or a file is empty; damaged files stay errors."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p) or (fs.getFileStatus(p).isFile() and fs.getFileStatus(p).getLen() == 0):
        return None
    return spark.read.parquet(path)


def _scalar(text: str):
    text = text.strip()
    if text[:1] in "'\"" and text[:1] and text[-1:] == text[0] and len(text) > 1:
        return json.loads(text) if text[0] == '"' else text[1:-1].replace("''", "'")
    if text[:1] == "[" and text[-1:] == "]":
        return [_scalar(x) for x in _split(text[1:-1])]
    if text[:1] == "{" and text[-1:] == "}":
        return {str(_scalar(k)): _scalar(v) for k, _, v in (x.partition(":") for x in _split(text[1:-1]))}
    known = {"": None, "~": None, "null": None, "true": True, "false": False}
    if text.lower() in known:
        return known[text.lower()]
    for kind in (int, float):
        if re.fullmatch(r"[-+]?(\d+|\d*\.\d+([eE][-+]?\d+)?|\d+\.\d*([eE][-+]?\d+)?|\d+[eE][-+]?\d+)", text):
            try:
                return kind(text)
            except ValueError:
                pass
    return text


def _split(text: str) -> list[str]:
    """Parts between commas that stand in no quotes and brackets."""
    out, depth, quote, last = [], 0, "", 0
    for k, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c in "[{":
            depth += 1
        elif c in "]}":
            depth -= 1
        elif c == "," and not depth:
            out.append(text[last:k])
            last = k + 1
    return [x for x in [*out, text[last:]] if x.strip()]


def _bare(line: str) -> str:
    """A line without its comment."""
    quote = ""
    for k, c in enumerate(line):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"" and (k == 0 or line[k - 1] in " [{,:-"):
            quote = c
        elif c == "#" and (k == 0 or line[k - 1] == " "):
            return line[:k].rstrip()
    return line.rstrip()


_KEY = re.compile(r"""((?:"[^"]*"|'[^']*'|[^\s#:'"\[\]{}][^:]*?))\s*:(?:\s+(.*))?""")


def _block(lines: list[tuple[int, str]], at: int, indent: int):
    """(value, next line) of the mapping or list that begins at a line."""
    out: dict | list = [] if lines[at][1].startswith("-") else {}
    while at < len(lines) and lines[at][0] == indent:
        text = lines[at][1]
        if isinstance(out, list):
            if not re.match(r"-(\s|$)", text):
                break
            rest = text[1:].strip()
            if rest and (_KEY.fullmatch(rest) and rest[0] not in "[{"):
                deeper = indent + len(text) - len(text[1:].lstrip())
                lines[at] = (deeper, rest)
                value, at = _block(lines, at, deeper)
            elif rest:
                value, at = _scalar(rest), at + 1
            elif at + 1 < len(lines) and lines[at + 1][0] > indent:
                value, at = _block(lines, at + 1, lines[at + 1][0])
            else:
                value, at = None, at + 1
            out.append(value)
            continue
        found = _KEY.fullmatch(text)
        if not found:
            raise ValueError(f"can't read {text!r}")
        key, rest = str(_scalar(found[1])), found[2]
        if rest:
            value, at = _scalar(rest), at + 1
        elif at + 1 < len(lines) and (lines[at + 1][0] > indent or (lines[at + 1][0] == indent and lines[at + 1][1].startswith("- "))):
            value, at = _block(lines, at + 1, lines[at + 1][0])
        else:
            value, at = None, at + 1
        out[key] = value
    return out, at


def document(text: str):
    """A configuration document: JSON, or the part of YAML that configurations need: mappings, lists, inline ones, scalars and comments."""
    try:
        return json.loads(text)
    except ValueError:
        pass
    lines = [(len(x) - len(x.lstrip(" ")), x.strip()) for x in map(_bare, text.replace("\t", "    ").splitlines()) if x.strip() and x.strip() != "---"]
    if not lines:
        return {}
    value, at = _block(lines, 0, lines[0][0])
    if at < len(lines):
        raise ValueError(f"can't read {lines[at][1]!r}")
    return value
