"""Results out: JSON that JavaScript reads without loss, and small text renderings of collected rows."""

from __future__ import annotations

import csv
import datetime as dt
import decimal
import io
import json
import math

from pyspark.sql import DataFrame, Row

SAFE = 2**53 - 1


def json_value(x, safe: bool = True):
    """A value as JSON has it; safe: integers beyond 2^53 - 1 and numbers that aren't finite become strings."""
    if isinstance(x, bool) or x is None or isinstance(x, str):
        return x
    if isinstance(x, decimal.Decimal):
        x = int(x) if x == x.to_integral_value() else float(x)
    if isinstance(x, int):
        return str(x) if safe and abs(x) > SAFE else x
    if isinstance(x, float):
        return x if math.isfinite(x) else "NaN" if math.isnan(x) else "Infinity" if x > 0 else "-Infinity"
    if isinstance(x, (dt.datetime, dt.date)):
        return x.isoformat()
    if isinstance(x, (bytes, bytearray)):
        return x.hex()
    if isinstance(x, Row):
        return {k: json_value(v, safe) for k, v in x.asDict().items()}
    if isinstance(x, dict):
        return {str(k): json_value(v, safe) for k, v in x.items()}
    return [json_value(v, safe) for v in x]


def rows(df: DataFrame, limit: int) -> list[dict]:
    """At most limit rows for display; larger results are written by Spark, not collected."""
    return [json_value(r) for r in df.limit(limit).collect()]


def render(df: DataFrame, form: str = "table", limit: int = 1000) -> str:
    """The first rows as jsonl, csv, kv or table."""
    found, names = rows(df, limit), df.columns
    text = lambda v: "" if v is None else v if isinstance(v, str) else json.dumps(v)
    if form == "jsonl":
        return "\n".join(json.dumps(r) for r in found)
    if form == "csv":
        out = io.StringIO()
        w = csv.writer(out, lineterminator="\n")
        w.writerow(names)
        w.writerows([text(r[n]) for n in names] for r in found)
        return out.getvalue().rstrip("\n")
    if form == "kv":
        return "\n\n".join("\n".join(f"{n}: {text(r[n])}" for n in names) for r in found)
    if form != "table":
        raise ValueError(f"unknown form {form!r}")
    cells = [names, *[[text(r[n]) for n in names] for r in found]]
    width = [max(len(row[k]) for row in cells) for k in range(len(names))]
    lines = [" | ".join(c.ljust(w) for c, w in zip(row, width, strict=True)).rstrip() for row in cells]
    return "\n".join([lines[0], "-+-".join("-" * w for w in width), *lines[1:]])


def arrow_stream(df: DataFrame, limit: int) -> bytes:
    """The first rows as an Arrow IPC stream."""
    import pyarrow as pa

    table, out = df.limit(limit).toArrow(), io.BytesIO()
    with pa.ipc.new_stream(out, table.schema) as w:
        w.write_table(table)
    return out.getvalue()


def write_arrow(df: DataFrame, folder: str) -> DataFrame:
    """All rows as Arrow IPC files in a folder that all executors share, one a task; gives file, rows.  A file appears by one rename when it is whole."""

    def run(batches):
        import uuid

        import pyarrow as pa
        from pyarrow import fs
        from pyspark import TaskContext

        writer, n = None, 0
        for batch in batches:
            if writer is None:
                store, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
                store.create_dir(root, recursive=True)
                name = f"part-{TaskContext.get().partitionId():05d}.arrow"
                temp = f"{root}/{name}.{uuid.uuid4().hex}"
                out = store.open_output_stream(temp)
                writer = pa.ipc.new_file(out, batch.schema)
            writer.write_batch(batch)
            n += batch.num_rows
        if writer is not None:
            writer.close()
            out.close()
            store.move(temp, f"{root}/{name}")
            yield pa.RecordBatch.from_pylist([{"file": name, "rows": n}], pa.schema([("file", pa.string()), ("rows", pa.int64())]))

    return df.mapInArrow(run, "file string, rows long")


def write_jsonl(records: DataFrame, path: str) -> None:
    """A DataFrame with one column value as text files, one record a line."""
    records.select("value").write.text(path)
