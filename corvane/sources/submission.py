"""Submission files: a JSON object by question in a zip, with the findings that only the file can give."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import DataFrame, SparkSession

ENTRY = "submission.json"
JUNK = ("__MACOSX/", ".DS_Store", "Thumbs.db", "desktop.ini")


def pack(text: str) -> bytes:
    """The zip of one submission: its JSON at the root, deflated."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(ENTRY, text)
    return out.getvalue()


def unpack(name: str, data: bytes) -> tuple[str | None, list[tuple[str, str]]]:
    """The JSON text of a file, if there is one, and findings (code, detail)."""
    found: list[tuple[str, str]] = []
    if name.lower().endswith(".json"):
        found.append(("W004", name))
        raw = data
    else:
        try:
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                names = [n for n in z.namelist() if not n.endswith("/")]
                junk = [n for n in names if any(j in n for j in JUNK)]
                rest = [n for n in names if n not in junk]
                found += [("W003", n) for n in junk]
                if ENTRY not in rest:
                    nested = [n for n in rest if n.endswith("/" + ENTRY)]
                    return None, [*found, ("E001", nested[0] if nested else ENTRY)]
                found += [("E002", n) for n in rest if n != ENTRY]
                raw = z.read(ENTRY)
        except zipfile.BadZipFile:
            return None, [("E001", name)]
    try:
        return raw.decode("utf-8-sig"), found
    except UnicodeDecodeError as e:
        return None, [*found, ("E003", str(e))]


def read(spark: SparkSession, path: str) -> DataFrame:
    """(sub_id, json, file_findings) of every submission file that ``path`` names; unreadable ones have null json."""

    def run(frames):
        import pandas as pd

        for frame in frames:
            got = [unpack(p.rsplit("/", 1)[-1], bytes(c)) for p, c in zip(frame["path"], frame["content"], strict=True)]
            yield pd.DataFrame({"sub_id": frame["path"], "json": [t for t, _ in got], "file_findings": [[{"code": c, "detail": d} for c, d in f] for _, f in got]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "sub_id string, json string, file_findings array<struct<code: string, detail: string>>")
