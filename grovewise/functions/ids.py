"""Canonical forms of ids, as column expressions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The characters that count as outer white space of an id.
BLANKS = "".join(map(chr, [*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def _outer(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def group_id(c: Column) -> Column:
    """Upper case without outer white space; an empty id is null."""
    return F.nullif(F.upper(_outer(c)), F.lit(""))


def component_id(c: Column) -> Column:
    """Lower case without outer white space; an empty component is null."""
    return F.nullif(F.lower(_outer(c)), F.lit(""))


def tip_id(c: Column) -> Column:
    """Lower case, without outer white space and ``;size=N`` suffix; null, empty and ``*`` are no tips."""
    plain = F.lower(_outer(c))
    bare = F.when(plain.contains(";size="), F.regexp_replace(plain, r";size=\d+;?$", "")).otherwise(plain)
    bare = F.btrim(bare, F.lit(BLANKS))
    return F.when((bare != "") & (bare != "*"), bare)


def canonical_tips(values: pa.Array) -> pa.Array:
    """``tip_id`` of an Arrow array of strings; each distinct spelling is mended once."""
    coded = values.dictionary_encode()
    bare = pc.utf8_lower(pc.utf8_trim(coded.dictionary, BLANKS))
    bare = pc.utf8_trim(pc.replace_substring_regex(bare, r";size=\d+;?$", ""), BLANKS)
    bare = pc.if_else(pc.or_(pc.equal(bare, ""), pc.equal(bare, "*")), None, bare)
    return bare.take(coded.indices)


def tip_lists(df: DataFrame, keep: list[str], lists: list[str]) -> DataFrame:
    """Columns ``keep``, and ``lists`` (arrays of strings) with their elements as ``tip_id`` gives them.

    Elements keep their order and repeats; those that are no tips go. A null list stays null. An array's
    elements can't be changed in compiled code, so this runs on Arrow batches.
    """

    def mended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.columns[: len(keep)]
            for given in batch.columns[len(keep) :]:
                flat, row = canonical_tips(given.flatten()), pc.list_parent_indices(given)
                is_tip = flat.is_valid()
                sizes = pa.array(np.bincount(row.filter(is_tip).to_numpy(), minlength=len(given)))
                offsets = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32), mask=np.r_[given.is_null().to_numpy(False), False])
                columns.append(pa.ListArray.from_arrays(offsets, flat.filter(is_tip)))
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, *lists])

    kinds = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), *(f"`{c}` array<string>" for c in lists)])
    return df.select(*keep, *lists).mapInArrow(mended, kinds)
