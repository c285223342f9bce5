"""Readers by extension. JSON is read by Spark; relaxed JSON, TOML, YAML, INI and text come as one variant per file.

What a format cannot say stays out: INI values are strings, TOML dates are their text, YAML needs an installed parser.
Extensions that name another kind of file are refused by name; Parquet, ORC and CSV are Spark's own readers.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F


def _dump(x: object) -> str:
    return json.dumps(x, ensure_ascii=False, default=str)


def _toml(text: str) -> str:
    import tomllib

    return _dump(tomllib.loads(text))


def _ini(text: str) -> str:
    import configparser

    p = configparser.ConfigParser(interpolation=None, default_section="\x00")
    p.optionxform = str
    try:
        p.read_string(text)
        return _dump({s: dict(p[s]) for s in p.sections()})
    except configparser.MissingSectionHeaderError:
        p.read_string("[\x01]\n" + text)
        top = dict(p["\x01"])
        return _dump(top | {s: dict(p[s]) for s in p.sections() if s != "\x01"})


def _yaml(text: str) -> str:
    try:
        import yaml
    except ImportError as e:
        raise ImportError("reading YAML needs a YAML parser") from e
    return _dump(yaml.safe_load(text))


def relaxed(text: str) -> str:
    """Relaxed JSON as strict JSON: comments, trailing commas, bare keys and single quotes are allowed."""

    token = re.compile(r"""//[^\n]*|/\*.*?\*/|\#[^\n]*|"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|[{}\[\],:]|[^\s{}\[\],:"'/#]+|\s+|.""", re.DOTALL)
    out: list[str] = []
    for m in token.finditer(text):
        t = m[0]
        if t[:2] in ("//", "/*") or t[0] == "#" or t.isspace():
            continue
        if t[0] == "'":
            t = json.dumps(re.sub(r"\\(.)", lambda x: x[1] if x[1] == "'" else x[0], t[1:-1]).encode().decode("unicode_escape") if "\\" in t else t[1:-1], ensure_ascii=False)
        elif t[0] not in '"{}[],:':
            try:
                v = json.loads(t)
                t = t if not isinstance(v, float) or v == v and abs(v) != float("inf") else json.dumps(t)
            except ValueError:
                t = json.dumps(int(t, 16)) if t[:2].lower() == "0x" else t[1:] if t[0] == "+" else json.dumps(t, ensure_ascii=False)
        if t in "]}" and out and out[-1] == ",":
            out.pop()
        out.append(t)
    joined = "".join(out)
    return joined if joined[:1] in "[{" or ":" not in out else "{" + joined + "}"


def _strict(text: str) -> str:
    return _dump(json.loads(text))


_PARSERS: dict[str, Callable[[str], str]] = {"json": _strict, "relaxed": relaxed, "toml": _toml, "yaml": _yaml, "ini": _ini}
#: Extension to format.
EXTENSIONS = {
    "json": "json", "jsonld": "json", "jsonc": "relaxed", "json5": "relaxed", "jsonic": "relaxed", "jsc": "relaxed", "toml": "toml", "yaml": "yaml", "yml": "yaml", "ini": "ini", "txt": "text",
}


def read(spark: SparkSession, path: str) -> DataFrame:
    """(path, value): one row for each file, its document as a variant; a text file's value is its text."""
    ext = os.path.splitext(path)[1].lstrip(".").lower()
    if ext not in EXTENSIONS:
        raise ValueError(f"include_extension: .{ext}")
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    kind = EXTENSIONS[ext]
    if kind == "text":
        return raw.select("path", F.col("text").alias("value"))
    parse = _PARSERS[kind]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(text=[parse(x) for x in b["text"]])

    return raw.mapInPandas(run, "path string, text string").select("path", F.parse_json("text").alias("value"))


def read_memory(spark: SparkSession, files: Mapping[str, str]) -> DataFrame:
    """(path, value): documents that are given as texts, by the extensions of their names; for what is small."""
    rows = []
    for path, text in sorted(files.items()):
        ext = os.path.splitext(path)[1].lstrip(".").lower()
        if ext not in EXTENSIONS:
            raise ValueError(f"include_extension: .{ext}")
        kind = EXTENSIONS[ext]
        rows.append((path, json.dumps(text) if kind == "text" else _PARSERS[kind](text)))
    return spark.createDataFrame(rows, "path string, text string").select("path", F.parse_json("text").alias("value"))


def resolve(spark: SparkSession, name: str, roots: Sequence[str] = (), files: Mapping[str, str] | None = None) -> DataFrame:
    """(path, value) of a document by name: one that is given wins, then the first root that has it; none is an error."""
    if files and name in files:
        return read_memory(spark, {name: files[name]})
    for root in roots:
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{name}")
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            return read(spark, at.toString())
    raise ValueError(f"include_missing: {name}")


def with_vars(template: str, values: Mapping[str, str | int | float | bool | None]) -> str:
    """A document's text with ``$name`` for each variable replaced by its value as JSON; ``$$`` is a dollar sign."""

    def put(m: re.Match) -> str:
        if m[0] == "$$":
            return "$"
        if m[1] not in values:
            raise ValueError(f"var_missing: ${m[1]}")
        return json.dumps(values[m[1]])

    return re.sub(r"\$\$|\$([A-Za-z_][A-Za-z0-9_]*)", put, template)


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table of JSON lines with a given schema; a line that does not fit is an error, nothing is guessed."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
