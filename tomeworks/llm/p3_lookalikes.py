"""Problem 3: visually identical text with different characters.

Text columns go through Arrow into code-point arrays (see codepoints): a table gather replaces
other widths, unusual blanks, ligatures and single-sign letter groups and drops invisible signs,
expansion offsets make room for groups, marks are composed with their letters for all rows at
once, and letters that stray in from another script are set to their twin.

Defined results: a null stays null and is not flagged; an empty text stays empty; repeated rows
come out repeated; an empty table gives no rows; columns other than the key and the named ones
are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tomeworks.llm import codepoints as C
from tomeworks.session import table


def level_columns(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row per row: the key, each column in its plain form, and <column>_odd: it held a look-alike character."""
    fields = [T.StructField("row_key", df.schema[key].dataType)]
    fields += [T.StructField(c, T.StringType()) for c in columns] + [T.StructField(f"{c}_odd", T.BooleanType()) for c in columns]
    source = df.select(F.col(key).alias("row_key"), *(F.make_valid_utf8(F.col(c).cast("string")).alias(c) for c in columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in C.slices(batch, *columns):
                texts, odd = [], []
                for c in columns:
                    column = part.column(part.schema.get_field_index(c))
                    plain, hit = C.level(C.from_arrow(column))
                    null = np.asarray(column.is_null())
                    texts.append(C.to_arrow(plain, null))
                    odd.append(pa.array(hit & ~null))
                yield pa.RecordBatch.from_arrays([part.column(0), *texts, *odd], [f.name for f in fields])

    return source.mapInArrow(run, T.StructType(fields)).withColumnRenamed("row_key", key)


def plain(column):
    """A text column in its plain form, as a column expression (Arrow batches to numpy)."""
    return _plain(F.make_valid_utf8(column.cast("string")))


@F.arrow_udf(T.StringType())
def _plain(s: pa.Array) -> pa.Array:
    return C.to_arrow(C.level(C.from_arrow(s))[0], np.asarray(s.is_null()))


def p3_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every catalogue row with title and authors in one consistent form."""
    return level_columns(table(spark, sf_dir, "metadata"), "rec_id", ["title", "authors"])


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of title and authors that hold a character differing from the plain one it looks like."""
    cells = p3_plain(spark, sf_dir)
    named = F.explode(F.array_compact(F.array(*(F.when(F.col(f"{c}_odd"), F.lit(c)) for c in ("title", "authors")))))
    return cells.select("rec_id", named.alias("field_name")).distinct()
