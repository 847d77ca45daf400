"""Rows of two streams that meet by key, and the place of a row in its task; runs inside Spark tasks."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Row
from pyspark.sql.streaming import StatefulProcessor

CHUNK, REFS = 0, 1


def with_rows(batches):
    """Arrow batches of one task with `row`, the place of each row in the task."""
    passed = 0
    for batch in batches:
        place = pa.array(np.arange(passed, passed + batch.num_rows, dtype=np.int64))
        passed += batch.num_rows
        yield pa.RecordBatch.from_arrays([*batch.columns, place], [*batch.schema.names, "row"])


class Meeting(StatefulProcessor):
    """Keeps the last refs of a unit, and that its chunk has come; texts of chunks stay in their files and the table.

    A unit leaves when its chunk arrives, with what is known of its refs, and again whenever refs of it arrive later. Of the rows of
    one micro-batch the one latest by `place` counts, and a later micro-batch counts over an earlier one. What
    is kept is dropped `hold_ms` after it was last written. Out: id, the file of the chunk that arrives now or NULL, the
    number of its rows in this micro-batch, and the refs.
    """

    def __init__(self, hold_ms):
        self.hold_ms = hold_ms

    def init(self, handle):
        self.kept = {
            CHUNK: handle.getValueState("came", "body string", self.hold_ms),
            REFS: handle.getValueState("refs", "body string", self.hold_ms),
        }

    def handleInputRows(self, key, rows, timerValues):
        last, times = {}, 0
        for row in rows:
            times += row.kind == CHUNK
            if row.kind not in last or last[row.kind][0] < row.place:
                last[row.kind] = (row.place, row.body)
        for kind, (_, body) in last.items():
            self.kept[kind].update((body if kind == REFS else "",))
        # The store is asked only for what did not come just now: a question takes most of the time of a unit.
        if CHUNK in last or self.kept[CHUNK].get() is not None:
            file = last[CHUNK][1] if CHUNK in last else None
            refs = (last[REFS][1],) if REFS in last else self.kept[REFS].get()
            yield Row(id=key[0], file=file, times=times, refs=None if refs is None else refs[0])

    def close(self):
        pass
