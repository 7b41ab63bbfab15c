"""Saved tables and documents by handle: ``tbl:N`` folders of Parquet with one manifest row each.

Saving a table that is already there (same source, columns and rows) gives its old handle: every
manifest row keeps an order-independent fingerprint of the rows, and a match is verified by an anti-join
both ways before it is used. Rows are written to a folder of their own first; then the manifest row claims the next
free number, which only one writer can get. Nothing is changed in place, and what a failed writer left is never read.
"""

from __future__ import annotations

import json
import os
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import EngineError


class Catalog:
    """A folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, Path(root.removeprefix("file://").removeprefix("file:"))
        self.root.mkdir(parents=True, exist_ok=True)

    def _entries(self) -> list[dict]:
        return sorted((json.loads(p.read_text()) for p in self.root.glob("tbl-*.json")), key=lambda e: e["id"])

    def _fingerprint(self, df: DataFrame) -> str:
        row = df.select(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).alias("h")).agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s"), F.bit_xor("h").alias("x")).first()
        return f"{row.n}:{row.s}:{row.x}"

    def save(self, df: DataFrame, title: str = "", source: str = "") -> str:
        """The handle of the saved table, an old one if the same table is there."""
        mark, columns = self._fingerprint(df), df.columns
        for e in self._entries():
            if (e["mark"], e["columns"], e["source"]) == (mark, columns, source):
                old = self.spark.read.parquet(str(self.root / e["folder"]))
                if df.exceptAll(old).isEmpty() and old.exceptAll(df).isEmpty():
                    return f"tbl:{e['id']}"
        folder = f"rows-{uuid.uuid4().hex}"
        df.write.parquet(str(self.root / folder))
        new = max([e["id"] for e in self._entries()], default=0) + 1
        while True:
            entry = {"id": new, "title": title, "source": source, "columns": columns, "mark": mark, "folder": folder}
            draft = self.root / f"{folder}.json"
            draft.write_text(json.dumps(entry, ensure_ascii=False))
            try:
                os.link(draft, self.root / f"tbl-{new}.json")  # fails if another writer has the number
                return f"tbl:{new}"
            except FileExistsError:
                new += 1
            finally:
                draft.unlink()

    def load(self, handle: str) -> DataFrame:
        """The table of a handle (without case)."""
        kind, _, n = handle.strip().lower().partition(":")
        path = self.root / f"tbl-{n}.json"
        if kind != "tbl" or not path.exists():
            recent = ", ".join(f"tbl:{e['id']} {e['title']}".strip() for e in self._entries()[-5:][::-1])
            raise EngineError("not_found", f"no table `{handle}`", f"Recent tables: {recent}" if recent else "No table is saved yet")
        return self.spark.read.parquet(str(self.root / json.loads(path.read_text())["folder"]))


def document(docs: DataFrame, handle: str, id_col: str = "doc_id", title: str = "title") -> DataFrame:
    """The stored document of a handle ``doc:N`` (without case); if there is none, the error names the five latest."""
    kind, _, n = handle.strip().lower().partition(":")
    found = docs.where(F.col(id_col) == int(n)) if kind == "doc" and n.isdigit() else docs.limit(0)
    if found.isEmpty():
        latest = docs.select(id_col, title).orderBy(F.desc(id_col)).limit(5).collect()
        raise EngineError("not_found", f"no document `{handle}`", "Recent documents: " + ", ".join(f"doc:{r[0]} {r[1] or ''}".strip() for r in latest) if latest else "No document is stored yet")
    return found
