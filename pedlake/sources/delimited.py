"""Quote-aware reading of delimited records: good rows typed, bad rows with the reason.

A finite-state tokenizer runs over whole Arrow batches in NumPy. Records are laid out in chunks of
fixed width. For each chunk the transition function (start state -> end state) is computed for all
states at once; functions of a record's chunks are composed in order, which gives every chunk its
real start state; a second sweep then marks field bounds and the offset of the first error. A record
of any length is thus handled in vector steps of one chunk width.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pedlake.plans.scratch import Scratch

#: States: between fields, in a plain field, inside quotes, after a quote inside quotes, error.
GAP, PLAIN, QUOTED, AFTER, ERROR = range(5)
#: Classes: blank or tab, quote, other, padding (which changes nothing).
BLANK, QUOTE, OTHER, PAD = range(4)
STEP = np.array(
    [  # BLANK  QUOTE   OTHER   PAD
        [GAP, QUOTED, PLAIN, GAP],
        [GAP, ERROR, PLAIN, PLAIN],
        [QUOTED, AFTER, QUOTED, QUOTED],
        [GAP, QUOTED, ERROR, AFTER],
        [ERROR, ERROR, ERROR, ERROR],
    ],
    dtype=np.uint8,
)
_CLASS = np.full(256, OTHER, dtype=np.uint8)
_CLASS[[ord(" "), ord("\t")]] = BLANK
_CLASS[ord('"')] = QUOTE
WIDTH = 64


def tokenize(lines: list[str], width: int = WIDTH) -> tuple[list[list[str] | None], np.ndarray]:
    """Fields of each line, or None and the byte offset (in the stripped line) of its quoting error.

    Lines are stripped of white space first. A quote that is never closed is an error at the place
    where it opens. An empty line has no fields.
    """
    data = [x.strip().encode("utf-8", "surrogatepass") for x in lines]
    n = len(data)
    sizes = np.fromiter(map(len, data), np.int64, n)
    parts = -(-sizes // width)
    first = np.concatenate([[0], np.cumsum(parts)])
    chunks = int(first[-1])
    fields: list[list[str] | None] = [[] for _ in range(n)]
    offsets = np.full(n, -1, dtype=np.int64)
    if not chunks:
        return fields, offsets
    line = np.repeat(np.arange(n), parts)
    rank = np.arange(chunks) - first[line]
    flat = np.frombuffer(b"".join(data), dtype=np.uint8)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    cells = np.full(chunks * width, PAD, dtype=np.uint8)
    cells[np.arange(len(flat)) + np.repeat(first[:-1] * width - begin[:-1], sizes)] = _CLASS[flat]
    cells = cells.reshape(chunks, width)

    ends = np.tile(np.arange(len(STEP), dtype=np.uint8), (chunks, 1))  # each chunk as a function of its start
    for j in range(width):
        ends = STEP[ends, cells[:, j, None]]
    state = np.full(chunks, GAP, dtype=np.uint8)
    by_rank = np.argsort(rank, kind="stable")
    cuts = np.searchsorted(rank[by_rank], np.arange(1, int(rank.max()) + 2))
    for r in range(1, len(cuts)):  # composition along each line
        here = by_rank[cuts[r - 1] : cuts[r]]
        state[here] = ends[here - 1, state[here - 1]]

    seen = np.empty((chunks, width + 1), dtype=np.uint8)
    seen[:, 0] = state
    for j in range(width):
        seen[:, j + 1] = STEP[seen[:, j], cells[:, j]]
    was, now = seen[:, :-1], seen[:, 1:]

    def places(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        c, j = np.nonzero(mask)
        return line[c], rank[c] * width + j

    open_line, open_at = places((was == GAP) & ((now == PLAIN) | (now == QUOTED)))
    shut_line, shut_at = places(((was == PLAIN) | (was == AFTER)) & (now == GAP))
    err_line, err_at = places((was != ERROR) & (now == ERROR))
    offsets[err_line] = err_at
    last = first[1:] - 1
    final = np.where(parts > 0, seen[np.maximum(last, 0), width], GAP)
    opens = np.searchsorted(open_line, np.arange(n + 1))
    shuts = np.searchsorted(shut_line, np.arange(n + 1))
    for i in range(n):
        starts = open_at[opens[i] : opens[i + 1]]
        if offsets[i] >= 0 or final[i] == QUOTED:
            fields[i] = None
            if offsets[i] < 0:
                offsets[i] = starts[-1]
            continue
        stops = [*shut_at[shuts[i] : shuts[i + 1]], sizes[i]]
        raw = [data[i][a:b].decode("utf-8", "surrogatepass") for a, b in zip(starts, stops)]
        fields[i] = [x[1:-1].replace('""', '"') if x[0] == '"' else x for x in raw]
    return fields, offsets


def _batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in it:
        lines = [x if isinstance(x, str) else "" for x in pdf["raw_line"]]
        fields, offsets = tokenize(lines)
        yield pd.DataFrame({"line_id": pdf["line_id"], "file_name": pdf["file_name"], "fields": pd.Series(fields, dtype=object, index=pdf.index), "error_at": offsets})


#: An id has only these characters, at least one letter or digit, and is no missing code.
ID_CHARS, ID_NEEDS, ID_MISSING = r"^[A-Za-z0-9._ \-]+\z", r"[A-Za-z0-9]", ("0", "-9", "NA", "NULL")


def _is_id(c):
    return c.rlike(ID_CHARS) & c.rlike(ID_NEEDS) & ~F.upper(F.trim(c)).isin(*ID_MISSING)


def read_fam_lines(lines: DataFrame) -> DataFrame:
    """Every distinct line of fam_line with its fields and, if it can't be loaded, the reason.

    Columns line_id, file_name, fields, reason, error_at (byte offset of a quoting error, else null).
    Reasons in order: quoting, columns (not the count of 5 or 6 that most lines of the file have; of a
    tie, 6), values (S_FID or S_IID is no id). Null and empty lines have no fields: columns. Extra
    columns of the input are ignored. Only counts per file are joined back, so a file may hold any
    share of the rows; the distinct step also spreads a table that one task would read.
    """
    rows = lines.select("line_id", "file_name", "raw_line").distinct()
    parsed = Scratch(lines.sparkSession, "fam").cut(rows.mapInPandas(_batches, "line_id long, file_name string, fields array<string>, error_at long"))
    n = F.size("fields")
    shape = parsed.where(F.col("error_at") < 0).groupBy("file_name").agg(F.when(F.count_if(n == 5) > F.count_if(n == 6), 5).otherwise(6).alias("width"))
    both = parsed.alias("p").join(shape.alias("s"), F.col("p.file_name").eqNullSafe(F.col("s.file_name")), "left").select("p.*", "s.width")
    field = [F.get("fields", F.lit(i)) for i in (0, 1)]
    reason = F.when(F.col("error_at") >= 0, "quoting").when(n != F.coalesce("width", F.lit(6)), "columns").when(~(_is_id(field[0]) & _is_id(field[1])), "values")
    return both.select("line_id", "file_name", "fields", reason.alias("reason"), F.when(F.col("error_at") >= 0, F.col("error_at")).alias("error_at"))


_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def fam_samples(read: DataFrame) -> DataFrame:
    """The lines without a reason as typed rows of samples; ids trimmed and in upper case."""
    f = [F.get("fields", F.lit(i)) for i in range(6)]
    key = lambda c: F.upper(F.btrim(c, F.lit(" \t")))
    sex = F.when(f[4].isin("1", "2"), f[4]).cast("tinyint")
    trait = F.when(f[5].rlike(_NUMBER) & (f[5] != "-9"), f[5]).cast("double")
    return read.where(F.col("reason").isNull()).select("line_id", "file_name", key(f[0]).alias("fid"), key(f[1]).alias("iid"), F.nullif(key(f[2]), F.lit("0")).alias("pat"), F.nullif(key(f[3]), F.lit("0")).alias("mat"), sex.alias("sex"), trait.alias("trait"))
