"""Tables kept in a list state as Arrow streams: one element for many rows, so that state costs no call and no object by row."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa

#: Rows of an element at most.
PIECE_ROWS = 20_000
STATE = "rows binary"


def append_rows(state, rows: pd.DataFrame) -> None:
    if len(rows):
        state.appendList(_pieces(rows))


def put_rows(state, rows: pd.DataFrame) -> None:
    """Replace what ``state`` holds."""
    if len(rows):
        state.put(_pieces(rows))
    else:
        state.clear()


def held_rows(state, nullable: bool = False) -> pd.DataFrame | None:
    """All rows in the order they were added; None if there are none. With ``nullable`` whole numbers stay whole beside NULLs."""
    tables = [pa.ipc.open_stream(blob).read_all() for (blob,) in state.get()]
    kinds = {pa.int64(): pd.Int64Dtype()} if nullable else {}
    return pa.concat_tables(tables, promote_options="permissive").to_pandas(types_mapper=kinds.get) if tables else None


def _pieces(rows: pd.DataFrame) -> list[tuple[bytes]]:
    table = pa.Table.from_pandas(rows, preserve_index=False).replace_schema_metadata(None)
    out = []
    for at in range(0, table.num_rows, PIECE_ROWS):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as writer:
            writer.write_table(table.slice(at, PIECE_ROWS))
        out.append((sink.getvalue().to_pybytes(),))
    return out
