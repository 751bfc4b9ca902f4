"""From files to records: one scanner per language, run over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom import schema
from codeloom.extract import c_family, python_ruby, rust_go, typescript
from codeloom.extract.text import Source
from codeloom.runtime import spread

#: language -> scanner; further languages may be registered.
SCANNERS: dict[str, Callable[[Source], dict[str, list]]] = {
    "TypeScript": typescript.scan, "Rust": rust_go.scan_rust, "Go": rust_go.scan_go, "Python": python_ruby.scan_python, "Ruby": python_ruby.scan_ruby,
    **{x: c_family.scan for x in ("Java", "Kotlin", "Scala", "CSharp", "Swift", "Cpp", "PHP")},
}


def scan(content: bytes, language: str, path: str) -> dict[str, list]:
    """The nine entity arrays of one file."""
    source = Source(content, language, path)
    found = SCANNERS[language](source)
    out = {k: found.get(k, []) for k in schema.ENTITIES}
    for kind in ("classes", "services", "implementations"):
        for entity in out[kind]:
            for method in entity["methods"]:
                method.setdefault("owner", None)
                method.setdefault("implements", None)
                method.setdefault("file", path)
    return out


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


#: Files of an Arrow batch that are turned into records at once, so that one batch of large files stays small.
SLICE = 256
_OUT = "error string, " + schema.IR_FILE


def ir_files(files: DataFrame, status: str = "built") -> DataFrame:
    """files (path, language, content, content_hash) -> records with a column error, which says why a file gave none.

    A file in an unknown language is left out, as is one without content or path. content_hash is computed where it is
    missing. A file that cannot be scanned gives empty arrays and an error and never ends the job.
    """
    kind = _arrow(_OUT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                rows = []
                for x in batch.slice(at, SLICE).to_pylist():
                    error = None
                    try:
                        found = scan(x["content"], x["language"], x["path"])
                    except Exception as e:  # noqa: BLE001
                        found, error = {k: [] for k in schema.ENTITIES}, f"{type(e).__name__}: {e}"[:500]
                    rows.append({"error": error, "path": x["path"], "language": x["language"], "content_hash": x["content_hash"], "build_status": status, "confidence": x["confidence"], **found})
                yield pa.RecordBatch.from_pylist(rows, schema=kind)

    hashed = F.coalesce(F.col("content_hash"), F.sha2("content", 256)) if "content_hash" in files.columns else F.sha2("content", 256)
    known = files.where(F.col("language").isin(list(SCANNERS)) & F.col("content").isNotNull() & F.col("path").isNotNull())
    ready = known.select("path", "language", "content", hashed.alias("content_hash"), schema.confidence(F.lit(status)).alias("confidence"))
    return spread(ready).mapInArrow(run, _OUT)
