"""Vocabularies of any size without a broadcast: what a part of the table asks for is dealt to its own file.

A table is written once with the number of its part beside each row. A task counts
the words of the parts that it reads, Spark adds the counts up, and what it found for
each word goes back to one file for each part. A task that meets a part reads that
file, so it holds the words of one part and never the vocabulary. The number is in
the rows, so it does not matter how a later scan is cut.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.dataset as ds
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtrace.llm.common import FILE_KEYS, new_folder, opened, written
from loomtrace.plans.closure import settled_rows

#: Rows of a part at most, as a power of two.
PART_ROWS = 16
#: Bytes of text after which a task sends the counts that it holds.
HELD_BYTES = 48 << 20
#: Rows of a batch that a task sends.
OUT = 200_000


def laid(docs: DataFrame, *cols: Column) -> DataFrame:
    """The columns ``cols`` of ``docs`` behind ``part``, as a written table."""
    place = F.monotonically_increasing_id()
    return written(docs.select(F.shiftright(place, PART_ROWS).alias("part"), *cols), "laid")


def count_words(rows: DataFrame, words: Callable[[bytes], list[bytes]]) -> DataFrame:
    """(part, grp, word, n) as a written table, from ``rows(part, grp, counted, text)``.

    ``n`` counts in rows that are ``counted``; words of others alone have 0. A large
    part may give a word in several rows.
    """

    def sent(held: dict[tuple[int, str], Counter]) -> Iterator[pa.RecordBatch]:
        for (part, grp), found in held.items():
            keys, counts = list(found), list(found.values())
            for at in range(0, len(keys), OUT):
                word, n = pa.array(keys[at : at + OUT], pa.binary()), pa.array(counts[at : at + OUT], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(n), pa.int64()), pa.array([grp] * len(n), pa.string()), word, n], ["part", "grp", "word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, str], Counter] = {}
        size = 0
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(3)]
            for part, grp, counted, text in zip(*columns, batch.column(3).cast(pa.binary())):
                text = text.as_py()
                found = held.setdefault((part, grp), Counter())
                mine = words(text)
                found.update(mine if counted else dict.fromkeys(mine, 0))
                size += len(text)
                if size > HELD_BYTES:
                    yield from sent(held)
                    held, size = {}, 0
        yield from sent(held)

    return written(rows.select("part", "grp", "counted", "text").mapInArrow(run, "part long, grp string, word binary, n long"), "words")


class Lookup:
    """What was dealt to a part: ``lookup(part)`` is a table of ``columns``, to be read when the part changes."""

    def __init__(self, names: dict[int, str], files: int, columns: list[str]):
        self.names, self.files, self.columns = names, files, columns

    def __call__(self, part: int, where: ds.Expression | None = None) -> pa.Table | None:
        if not (name := self.names.get((part >> (33 - PART_ROWS)) % self.files)):
            return None
        system, path = opened(name)
        here = ds.field("part") == part
        return ds.dataset(path, filesystem=system, format="parquet").to_table(columns=self.columns, filter=here if where is None else here & where)


def dealt(answers: DataFrame) -> Lookup:
    """The rows of ``answers(part, ..)`` in files by part."""
    spark, columns = answers.sparkSession, [c for c in answers.columns if c != "part"]
    answers, n = settled_rows(answers, new_folder(spark, "answers"))
    files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // FILE_KEYS))
    slot = F.pmod(F.shiftright("part", 33 - PART_ROWS), F.lit(files)).cast("int")
    table = written(answers.repartitionById(files, slot).sortWithinPartitions("part"), "dealt")
    names = {int(m[1]): name for name in table.inputFiles() if (m := re.search(r"part-(\d+)-[^/]*$", name))}
    return Lookup(names, files, columns)
