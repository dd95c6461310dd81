"""Rows of one task brought together by group on its own disk, with memory for a few batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

#: Bytes of rows that wait in memory before they go to disk.
HELD = 16 << 20


def together(batches: Iterable, group: str, order: str | None = None) -> Iterator[tuple[tuple, object]]:
    """((group, order), Arrow batch) of a task's batches: the rows of a group come together, in it by the whole number `order` from 0.

    The first group's rows of order 0 pass as they come; all others wait in an unlinked file of the executor's local
    folder and follow by group.  A sort in the JVM would hold all rows that its memory has room for.
    """
    import os
    import tempfile

    import pyarrow as pa

    unset = object()
    lead, held, size = unset, [], 0
    at: dict[tuple, list[tuple[int, int]]] = {}
    local = next((d for d in os.environ.get("SPARK_LOCAL_DIRS", "").split(",") if os.path.isdir(d)), None)
    packed = pa.ipc.IpcWriteOptions(compression="lz4" if pa.Codec.is_available("lz4") else None)
    with tempfile.TemporaryFile(dir=local) as f:

        def put():
            for b in pa.Table.from_batches(held).combine_chunks().to_batches() if held else ():
                for key, part in _parts(b, *_codes(b, group, order)):
                    begin = f.tell()
                    with pa.ipc.new_stream(pa.PythonFile(f, "w"), part.schema, options=packed) as to:
                        to.write_batch(part)
                    at.setdefault(key, []).append((begin, f.tell() - begin))
            held.clear()

        for b in batches:
            names, codes, wide = _codes(b, group, order)
            if lead is unset and (first := codes[codes % wide == 0][:1]).size:
                lead = names[first[0] // wide]
            mine = codes == (names.index(lead) * wide if lead in names else -1)
            if mine.any():
                yield (lead, 0), b if mine.all() else b.filter(pa.array(mine))
            if not mine.all():
                held.append(b.filter(pa.array(~mine)) if mine.any() else b)
                size += held[-1].nbytes
            if size > HELD:
                put()
                size = 0
        put()
        for key in sorted(at, key=lambda k: (k[0] != lead, k[0] is not None, () if k[0] is None else (k[0],), k[1])):
            for begin, n in at[key]:
                f.seek(begin)
                for part in pa.ipc.open_stream(f.read(n)):
                    yield key, part


def _codes(b, group: str, order: str | None):
    """A batch's groups, and for each row the place of its group times `wide` plus its order."""
    import numpy as np

    g = b.column(b.schema.get_field_index(group)).dictionary_encode(null_encoding="encode")
    codes = g.indices.to_numpy().astype(np.int64)
    if order is None or not b.num_rows:
        return g.dictionary.to_pylist(), codes, 1
    o = b.column(b.schema.get_field_index(order)).to_numpy().astype(np.int64)
    wide = int(o.max()) + 1
    return g.dictionary.to_pylist(), codes * wide + o, wide


def _parts(b, names: list, codes, wide: int) -> Iterator[tuple[tuple, object]]:
    """((group, order), rows) of a batch."""
    import numpy as np
    import pyarrow as pa

    rows = np.argsort(codes, kind="stable")
    found, first = np.unique(codes[rows], return_index=True)
    if len(found) > 1:
        b = b.take(pa.array(rows))
    for c, lo, hi in zip(found, first, [*first[1:], len(rows)], strict=True):
        yield (names[c // wide], int(c % wide)), b.slice(lo, hi - lo)


def values(column) -> list:
    """An Arrow column as Python values."""
    import pyarrow.types as t

    kind = column.type
    if t.is_string(kind) or t.is_large_string(kind) or t.is_binary(kind) or t.is_large_binary(kind) or (not column.null_count and (t.is_integer(kind) or t.is_floating(kind))):
        return column.to_numpy(zero_copy_only=False).tolist()
    return column.to_pylist()


def records(column) -> Iterator[dict]:
    """An Arrow column of structs without nulls as dicts."""
    names = [f.name for f in column.type]
    if not names:
        return ({} for _ in range(len(column)))
    return (dict(zip(names, r, strict=True)) for r in zip(*map(values, column.flatten()), strict=True))
