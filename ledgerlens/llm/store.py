"""Tables in the cluster's shared folder, so that later steps reread instead of recomputing."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.session import cut_lineage

ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
TEXT_ROWS = 2000


def settle(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` once to the folder of ``spark.checkpoint.dir`` and read it back.

    It cuts the lineage without tying rows to an executor, and a join of two settled
    tables exchanges both sides, so the adaptive skew join may split a hot key. While it is
    written, Arrow batches hold at most ``TEXT_ROWS`` rows, since rows here carry whole texts.
    """
    conf = df.sparkSession.conf
    before = conf.get(ARROW_ROWS)
    conf.set(ARROW_ROWS, str(min(int(before), TEXT_ROWS) if int(before) > 0 else TEXT_ROWS))
    try:
        return cut_lineage(df, purpose)
    finally:
        conf.set(ARROW_ROWS, before)


def discard(*tables: DataFrame) -> None:
    """Delete the settled tables that ``tables`` read, once everything made from them is settled itself.

    Files that ``settle`` has not written stay.
    """
    for table in tables:
        jvm, conf = table.sparkSession._jvm, table.sparkSession._jsc.hadoopConfiguration()
        for folder in {name.rsplit("/", 1)[0] for name in table.inputFiles()}:
            if re.search(r"/ledgerlens/[^/]+-[0-9a-f]{32}$", folder):
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(conf).delete(path, True)


def whole_text(text: Column) -> Column:
    """The text, an empty string for null."""
    return F.coalesce(text.cast("string"), F.lit(""))
