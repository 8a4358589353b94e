"""Small helpers over the text of R code and documents, batched through Arrow."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Reserved words and constants of R, never variables.
R_RESERVED = {"if", "else", "for", "while", "repeat", "in", "next", "break", "function", "TRUE", "FALSE", "NULL", "NA", "NaN",
              "Inf", "NA_integer_", "NA_real_", "NA_character_", "T", "F"}

_QUIET = re.compile(r"""(#[^\n]*)|"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'""", re.S)
_NAME = re.compile(r"`([^`]+)`|(?<![\w.])([A-Za-z.][\w.]*)")
_PARAMS = re.compile(r"function\s*\(([^)]*)\)")


def names_read(code: str) -> list[str]:
    """Names a piece of R code reads before it assigns them itself."""
    text = _QUIET.sub(lambda m: "" if m.group(1) is not None else '""', code or "")
    own = {p.split("=")[0].strip() for group in _PARAMS.findall(text) for p in group.split(",")}
    read: set[str] = set()
    for m in _NAME.finditer(text):
        name = m.group(1) or m.group(2)
        before, after = text[: m.start()].rstrip(" \t"), text[m.end():].lstrip(" \t")
        if name in R_RESERVED or before.endswith(("$", "@", "::")) or after.startswith(("(", "::")):
            continue
        if re.match(r"<<?-|=(?!=)", after):
            # At the start of a statement "=" assigns; within a call it names an argument.
            if after.startswith("<") or _statement_start(before):
                right = re.match(r"(?:<<?-|=)([^\n;]*)", after).group(1)
                if not re.search(rf"(?<![\w.]){re.escape(name)}(?![\w.(])", right):
                    own.add(name)
                elif name not in own:
                    read.add(name)
                    own.add(name)
            continue
        if before.endswith(("->", "->>")) or re.search(r"\bfor\s*\($", before):
            own.add(name)
            continue
        if name not in own:
            read.add(name)
    return sorted(read)


def _statement_start(before: str) -> bool:
    return before == "" or before[-1] in "\n;{}"


@F.pandas_udf(T.ArrayType(T.StringType()))
def names_read_by(code: pd.Series) -> pd.Series:
    return code.fillna("").map(names_read)


_CHUNK = re.compile(r"^[ \t]*```+[ \t]*\{r([ ,][^}\n]*)?\}[ \t]*\r?\n((?:(?![ \t]*```)[^\n]*\n?)*)(?:[ \t]*```[^\n]*)?", re.M)
_LABEL = re.compile(r"^\s*#\|\s*label:\s*(\S+)", re.M)


def chunks_in(text: str) -> list[dict]:
    """R chunks of a document with label and body lines, one-based; unlabelled ones are #1, #2, …"""
    found = []
    for n, m in enumerate(_CHUNK.finditer(text or ""), 1):
        options, body = (m.group(1) or "").strip(" ,"), m.group(2)
        first = options.split(",")[0].strip()
        labels = _LABEL.findall(body)
        label = labels[-1] if labels else (first if first and "=" not in first else f"#{n}")
        start = text.count("\n", 0, m.start(2)) + 1
        lines = body[:-1].split("\n") if body.endswith("\n") else (body.split("\n") if body else [])
        found.append({"label": label, "start_line": start, "end_line": start + len(lines) - 1, "code": "\n".join(lines)})
    return found


_CHUNK_ROW = T.StructType([T.StructField("label", T.StringType()), T.StructField("start_line", T.IntegerType()),
                           T.StructField("end_line", T.IntegerType()), T.StructField("code", T.StringType())])


@F.pandas_udf(T.ArrayType(_CHUNK_ROW))
def chunks_of(text: pd.Series) -> pd.Series:
    return text.map(chunks_in)


def plain_code(c):
    """Code without indentation, empty lines and chunk options, for comparison."""
    lines = F.transform(F.split(c, "\n"), lambda x: F.trim(x))
    return F.array_join(F.filter(lines, lambda x: (x != "") & ~x.startswith("#|")), "\n")
