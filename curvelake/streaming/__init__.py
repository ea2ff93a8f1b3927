"""Saved results kept up to date as files arrive.

Fields have no unbounded operators.  What a stream adds is a trigger: each
micro-batch of new files refreshes the saved results that read them, which
recomputes only the curves of the new files' inputs.
"""

from __future__ import annotations

from pyspark.sql.streaming import StreamingQuery


def refresh_on_arrival(session, table: str, datasets: list[str], checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Watches a table's folder and refreshes ``datasets`` after each batch of new files."""
    t = session.tables[table]
    files = session.spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary")
    glob = t.template.text
    import re

    arriving = files.load(f"{t.root}/{re.sub(r'{[^}]*}', '*', glob)}").select("path", "length")

    def batch(df, _epoch: int) -> None:
        if not df.isEmpty():
            for name in datasets:
                session.refresh(name)

    writer = arriving.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
