"""Optional sources of hints, gathered so that the failure of one leaves the others' hints whole.

A source is a function that gives a table; it may fail when it is asked for the table (no such path, no such column) or
only while its rows are computed (a broken file, a function that raises).  Each is therefore written on its own, in a job
of its own, and counts only once that job has been committed.  The jobs run side by side."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
import time
import uuid

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from webplan.session import shared_folder

HINT = (
    StructType().add("page_id", "long").add("tag_id", "long").add("source", "string").add("event_name", "string")
    .add("confidence", "double").add("note", "string").add("parameters", ArrayType(StringType())).add("seq", "long"))
#: Bits of ``seq`` that are a source's own order; the bits above are the place of the source.
SEQ_BITS = 48


@dataclass
class Gathered:
    """hints: the rows of all sources that came through, in the layout ``HINT``.  report: one row per source, in the order
    asked: source, status (done, failed or off), hints (0 unless done), unplaced (those without page or element), error
    (first line; null unless failed), seconds.  folders: where the hints lie; see ``discard``."""

    hints: DataFrame
    report: DataFrame
    folders: list[str]

    def discard(self) -> None:
        """Remove the stored hints; afterwards ``hints`` cannot be read."""
        spark = self.hints.sparkSession
        for folder in self.folders:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shaped(rows: DataFrame, source: str, place: int) -> DataFrame:
    """A source's rows in the layout ``HINT``: absent columns are null, others are left out, names are matched as they are
    spelled.  A value that cannot be cast, or a seq that is null, negative or of more than ``SEQ_BITS`` bits, is an error
    of the source."""
    if "seq" not in rows.columns:
        raise ValueError(f"hints of {source} have no order: column seq is missing")
    own = F.col("`seq`").cast("long")
    good = own.isNotNull() & (own >= 0) & (own < F.lit(1 << SEQ_BITS))
    seq = F.when(good, own + F.lit(place << SEQ_BITS)).otherwise(F.raise_error(F.lit(f"seq of {source} out of range")).cast("long"))
    given = {"source": F.lit(source), "seq": seq}
    return rows.select(*[
        (given[f.name] if f.name in given else F.col(f"`{f.name}`") if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in HINT.fields])


def gather_hints(spark: SparkSession, sources: dict[str, Callable[[], DataFrame] | None]) -> Gathered:
    """Gather hints from sources, each a function without arguments, or None where the source is switched off.

    Hints of an earlier source come before those of a later one, each source's in the order of its ``seq``.  A source that
    fails gives no hint at all, however many rows it had written by then, and one row in the report.  No sources give
    empty tables.  Nothing but counts and messages reach the driver."""
    base = f"{shared_folder(spark)}/webplan-hints-{uuid.uuid4().hex}"

    def run(place: int, name: str, make) -> tuple:
        if make is None:
            return name, "off", 0, 0, None, 0.0
        began, seen = time.monotonic(), Observation()
        try:
            lost = F.col("page_id").isNull() | F.col("tag_id").isNull()
            rows = shaped(make(), name, place).observe(seen, F.count(F.lit(1)).alias("n"), F.count_if(lost).alias("unplaced"))
            rows.write.parquet(f"{base}/{place}")
            met = seen.get
        except Exception as error:  # whatever stops a source must not stop the others; it is told in the report
            text = next((x for x in str(error).splitlines() if x.strip()), type(error).__name__)
            return name, "failed", 0, 0, text, time.monotonic() - began
        return name, "done", met["n"], met["unplaced"], None, time.monotonic() - began

    asked = [(place, name, make) for place, (name, make) in enumerate(sources.items())]
    told = []
    if asked:
        with ThreadPoolExecutor(len(asked)) as pool:
            told = [job.result() for job in [pool.submit(inheritable_thread_target(spark)(run), *x) for x in asked]]
    report = spark.createDataFrame(told, "source string, status string, hints long, unplaced long, error string, seconds double")
    folders = [f"{base}/{place}" for place, row in enumerate(told) if row[1] == "done"]
    hints = spark.read.schema(HINT).parquet(*folders) if folders else spark.createDataFrame([], HINT)
    return Gathered(hints, report, folders)
