"""Interfaces of engines that are not data processing: recognisers, renderers, text-layer writers.

Each is a function from an iterator of Arrow batches to another with a fixed schema, run by
mapInArrow, so that an installation can put in its own. The stand-ins here raise.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

Engine = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]

#: Schemas that an engine takes and gives.
CONTRACTS = {
    "recognise_page": ("fingerprint string, page_index int, bitmap binary", "fingerprint string, page_index int, ord int, text string, left float, top float, right float, bottom float"),
    "recognise_ink": ("fingerprint string, page_index int, line int, points array<struct<x:float,y:float,time_ms:bigint>>", "fingerprint string, page_index int, line int, text string"),
    "render_page": ("fingerprint string, page_index int, source_page int, width int", "fingerprint string, page_index int, bitmap binary"),
    "write_text_layer": ("fingerprint string, page_index int, lines array<struct<text:string,x:float,y:float,font_size:float,horizontal_scale:float>>", "fingerprint string, page_index int, patch binary"),
    "transliterate": ("id long, text string", "id long, text string"),
    "draw_page": ("fingerprint string, page_index int, layer int, ord int, item string", "fingerprint string, page_index int, bitmap binary"),
}


def missing(name: str) -> Engine:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raise NotImplementedError(f"no engine for {name}; pass one that maps {CONTRACTS[name][0]} to {CONTRACTS[name][1]}")
        yield from batches

    return run


def apply(name: str, rows: DataFrame, engine: Engine | None = None) -> DataFrame:
    takes, gives = CONTRACTS[name]
    return rows.select(*StructType.fromDDL(takes).names).mapInArrow(engine or missing(name), gives)
