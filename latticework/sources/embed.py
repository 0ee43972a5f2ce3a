"""An offline job that fills missing vectors of JSON records, before they are loaded."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame

from ..plans.schema import Catalog


def fill_vectors(records: DataFrame, catalog: Catalog, embed: Callable[[str, int], list[float]], again: bool = False) -> DataFrame:
    """value: the records, with each vector that has @embed made from its source property where it is missing (again: wherever there is a source).

    embed (text and dimension to a vector) goes to the executors; a text that comes again in a batch is embedded once.
    Records of other types, and those without a source text, pass as they are.
    """
    wanted = {
        t.name: [(p, notes["embed"]["value"], t.props[p].dim) for p, notes in t.notes.items() if p in t.props and notes.get("embed", {}).get("value")] for t in catalog.types.values()
    }

    def run(batches: Iterator) -> Iterator:
        import json

        import pyarrow as pa

        for batch in batches:
            known: dict[tuple[str, int], list[float]] = {}
            out = []
            for text in batch.column(0).to_pylist():
                record = json.loads(text)
                data = record.get("data") or {}
                changed = False
                for prop, source, dim in wanted.get(record.get("type") or record.get("edge"), ()):
                    if isinstance(data.get(source), str) and (again or data.get(prop) is None):
                        key = (data[source], dim)
                        data[prop] = known[key] = known.get(key) or embed(*key)
                        changed = True
                out.append(json.dumps(record) if changed else text)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

    return records.select("value").mapInArrow(run, "value string")
