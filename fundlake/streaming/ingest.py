"""Files that land in a folder -> cleansed, deduplicated rows in a table kept by month, each file once."""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fundlake.operators.loads import new_rows
from fundlake.sources import monthly
from fundlake.sources.tables import stored

FILES_PER_BATCH = 1_000


def take_batch(batch: DataFrame, load: str, parse: Callable[[DataFrame], DataFrame], keys: Sequence[str], name: str,
               directory: str, schema: T.StructType, date: str = "value_date") -> None:
    """Add one batch to table ``name`` as load ``load``; a repeated load takes the place of its first try.

    ``parse`` cleanses: landed rows to typed rows. Rows with a NULL key go to the table ``name_rejected``. Of the others
    those come in whose key no other load has, one per key: the least row. What a load keeps depends on its rows and
    the other loads only, so a repetition gives the same table.
    """
    rows = stored(parse(batch), "batch")
    complete = functools.reduce(operator.and_, [F.col(k).isNotNull() for k in keys])
    monthly.write(rows.filter(~complete), f"{name}_rejected", directory, load, date, schema)
    known = monthly.read(batch.sparkSession, name, directory, schema, without_load=load)
    fresh = new_rows(rows.filter(complete), known, keys, date, dedup_batch=True)
    monthly.write(fresh.select(*schema.fieldNames()), name, directory, load, date, schema)


def stream_ingest(
    spark: SparkSession,
    landing: str,
    landed: T.StructType,
    parse: Callable[[DataFrame], DataFrame],
    keys: Sequence[str],
    name: str,
    directory: str,
    schema: T.StructType,
    checkpoint: str,
    fmt: str = "parquet",
    files_per_batch: int = FILES_PER_BATCH,
    date: str = "value_date",
    **options: str,
) -> None:
    """Process all files not yet seen and stop; run it again for later files.

    A load is named by the stream's id, which its checkpoint keeps, and the number of the batch, so a new stream never
    takes the place of an older one's loads.
    """
    files = (
        spark.readStream.format(fmt).schema(landed)
        .options(**options, maxFilesPerTrigger=str(files_per_batch)).load(landing)
    )

    def sink(batch: DataFrame, number: int) -> None:
        stream = batch.sparkSession.read.text(f"{checkpoint}/metadata").select(F.get_json_object("value", "$.id")).first()[0]
        take_batch(batch, f"{stream}-{number:09d}", parse, keys, name, directory, schema, date)

    query = (
        files.writeStream.foreachBatch(sink)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
