"""Defect lists in the KLARF text format: a reader for versions 1.2 and 1.8 and a writer for 1.2."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns that mark a table as a defect list.
REQUIRED = {"DEFECTID", "XINDEX", "YINDEX"}
SCHEMA = "path string, wafer string, lot string, pitch_x double, pitch_y double, defect_id double, xindex double, yindex double, xrel double, yrel double, classnumber double"
_OUT = ("defect_id", "xindex", "yindex", "xrel", "yrel", "classnumber")
_IN = ("DEFECTID", "XINDEX", "YINDEX", "XREL", "YREL", "CLASSNUMBER")


def _number(text: str) -> float | None:
    return None if text in ("N", "") else float(text)


def parse(text: str) -> tuple[dict, list[tuple]]:
    """Header (wafer, lot, pitch_x, pitch_y) and defects of one file; N is null, columns that are not there are null."""
    head: dict = {"wafer": None, "lot": None, "pitch_x": None, "pitch_y": None}
    for key, name in (("WaferID", "wafer"), ("LotID", "lot")):
        found = re.search(rf'(?:^|\s){key}\s+"?([^";\s]+)"?', text) or re.search(rf'Record\s+{name.capitalize()}Record\s+"([^"]+)"', text)
        head[name] = found[1] if found else None
    pitch = re.search(r"DiePitch\s+(?:\d+\s*\{\s*)?([-+.\deE]+)[,\s]+([-+.\deE]+)", text)
    if pitch:
        head["pitch_x"], head["pitch_y"] = float(pitch[1]), float(pitch[2])
    rows: list[tuple] = []
    old = re.search(r"DefectRecordSpec\s+\d+\s+([^;]+);", text)
    body = re.search(r"DefectList\s+([^;]*);", text)
    if old and body:
        names = old[1].upper().split()
        rows = _rows(names, [line.split() for line in body[1].strip().splitlines()])
    for table in re.finditer(r"List\s+\w+\s*\{\s*Columns\s+\d+\s*\{([^}]*)\}\s*Data\s+\d+\s*\{([^}]*)\}", text):  # 1.8: any list with the columns
        names = [c.split()[-1].upper() for c in table[1].split(",") if c.strip()]
        if REQUIRED <= set(names):
            rows += _rows(names, [re.split(r"[,\s]+", line.strip()) for line in table[2].split(";") if line.strip()])
    return head, rows


def _rows(names: list[str], lines: list[list[str]]) -> list[tuple]:
    if not REQUIRED <= set(names):
        raise ValueError(f"missing columns: {', '.join(sorted(REQUIRED - set(names)))}")
    at = [names.index(n) if n in names else None for n in _IN]
    return [tuple(None if k is None or k >= len(line) else _number(line[k]) for k in at) for line in lines if line]


def parse_texts(texts: DataFrame) -> DataFrame:
    """One row per defect of (path, text) rows, a file each."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, text in zip(part["path"], part["text"]):
                head, rows = parse(text or "")
                out = pd.DataFrame(rows, columns=list(_OUT), dtype=float)
                for k, (name, value) in enumerate([("path", path), *head.items()]):
                    out.insert(k, name, value)
                yield out

    return texts.select("path", "text").mapInPandas(run, SCHEMA)


def check_texts(texts: DataFrame, least: int = 1) -> DataFrame:
    """path, status, reason, defects for (path, text) rows: OK, SKIPPED with under `least` defects, or ERROR with what went wrong."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for path, text in zip(part["path"], part["text"]):
                try:
                    n = len(parse(text or "")[1])
                    out.append((path, "OK" if n >= least else "SKIPPED", None, n))
                except (ValueError, IndexError) as bad:
                    out.append((path, "ERROR", str(bad), None))
            own = pd.DataFrame(out, columns=["path", "status", "reason", "defects"])
            own["defects"] = own["defects"].astype("Int64")
            yield own

    return texts.select("path", "text").mapInPandas(run, "path string, status string, reason string, defects long")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Defects of all files under a path, each read whole."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return parse_texts(files)


def render(lot: Column, wafer: Column, pitch_x: float, pitch_y: float, rows: Column) -> Column:
    """The text of one file from an array of structs (defect_id, xindex, yindex, xrel, yrel, classnumber)."""
    line = lambda d: F.concat_ws(" ", *[F.coalesce(d[n].cast("string"), F.lit("N")) for n in _OUT])
    return F.concat(F.lit('FileVersion 1 2;\nLotID "'), lot, F.lit('";\nWaferID "'), wafer, F.lit(f'";\nDiePitch {pitch_x!r} {pitch_y!r};\nDefectRecordSpec 6 {" ".join(_IN)} ;\nDefectList\n'), F.array_join(F.transform(rows, line), "\n"), F.lit(";\nEndOfFile;\n"))
