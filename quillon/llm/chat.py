"""Transcript parsing by a hidden Markov model, and canonical turn rendering.

States are the roles. A line's speaker marker (its role column, or a "Name:" at its beginning) and shape are what the
model sees; its tables are counted over all lines with a known marker, so the unmarked ones are recovered from shape and
order. Viterbi runs on blocks of BLOCK turns at once: a block is reduced to the best log-probability from each state
before it to each state at its end, a conversation's few block tables are chained, and each block is then traced back
alone between its fixed ends. Where turns are null or repeated, a block of more than BLOCK rows is cut by rank into blocks of
BLOCK. No conversation, however long, is held in one task.

Rendering: the pieces `rendered`, in order of conversation and turn, are the canonical text. Neighbouring lines of one
role are one turn.

Defined results: null text is an empty line; unknown or null markers are left to the model; a line's "Name:" is removed if
it was read as its marker; rows with equal turns are ordered by text; null conversations are one conversation and null
turns come first; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow

BLOCK = 256
ROLES = ("system", "user", "assistant")
# Names by which speakers are marked, for each role.
MARKERS = {
    "system": ("system", "developer", "instruction", "instructions"),
    "user": ("user", "human", "prompter", "customer", "question", "q", "me"),
    "assistant": ("assistant", "ai", "bot", "chatbot", "gpt", "model", "agent", "answer", "a"),
}
#: Values of each shape feature: question mark at the end, length by powers of four, several lines.
SHAPES = (2, 8, 2)
_PATTERN = r"^\s*[#<|\[*]{0,4}\s*([A-Za-z]{1,12})\s*[|\]>*]{0,4}:\s*"


def marker(value: Column) -> Column:
    """0, 1, 2 for a known name of a role, else null."""
    known = F.create_map(*[F.lit(x) for k, r in enumerate(ROLES) for name in MARKERS[r] for x in (name, k)])
    return F.element_at(known, F.lower(F.trim(value)))


def lines(turns: DataFrame) -> DataFrame:
    """conv_id, turn, block, mark, shape and text of each row of turns(conv_id, turn, role, text)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    out = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), text.alias("text"))
    given, said = marker(F.col("role")), marker(F.regexp_extract("text", _PATTERN, 1))
    out = out.withColumn("mark", F.coalesce(given, said).cast("int")).withColumn("text", F.when(given.isNull() & said.isNotNull(), F.regexp_replace("text", _PATTERN, "")).otherwise(F.col("text")))
    asks, size, many = F.rtrim("text").endswith("?").cast("int"), F.least(F.lit(SHAPES[1] - 1), F.floor(F.log2(F.char_length("text") + 1.0) / 2)).cast("int"), F.contains("text", F.lit("\n")).cast("int")
    shape = (asks * SHAPES[1] + size) * SHAPES[2] + many
    return out.select("conv_id", "turn", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-1)).alias("block"), "mark", shape.alias("shape"), "text")


def transcript_lines(transcripts: DataFrame) -> DataFrame:
    """Rows for `lines` from raw transcripts(conv_id, text): a row for each line, without a role."""
    return transcripts.select("conv_id", F.posexplode(F.split("text", "\n")).alias("turn", "text")).withColumn("role", F.lit(None).cast("string"))


def fit(read: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log tables (first, next, shape) counted over all lines with a marker; the driver gets a row for each cell."""
    n = SHAPES[0] * SHAPES[1] * SHAPES[2]
    first, then, shape = np.ones(3), np.ones((3, 3)), np.ones((3, n))
    known = read.where("mark is not null").select("conv_id", "turn", "mark", "shape")
    for r in known.groupBy("mark", "shape", F.coalesce(F.col("turn") == 0, F.lit(False)).alias("first")).count().collect():
        shape[r["mark"], r["shape"]] += r["count"]
        first[r["mark"]] += r["count"] * r["first"]
    after = known.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("mark").alias("next"))
    for r in known.select("conv_id", "turn", "mark").join(after, ["conv_id", "turn"]).groupBy("mark", "next").count().collect():
        then[r["mark"], r["next"]] += r["count"]
    return tuple(np.log(x / x.sum(-1, keepdims=True)) for x in (first, then, shape))


def _emission(model, mark, shape) -> np.ndarray:
    """A marker names its role but for one line in a thousand."""
    out = model[2][:, shape].copy()
    if mark is not None:
        out += np.log(np.where(np.arange(3) == mark, 0.999, 0.0005))
    return out


def _stream(batches, key: int):
    """Rows of sorted batches by runs of their first `key` columns, across batches."""
    rows = (x for batch in batches for x in zip(*(c.to_pylist() for c in batch.columns)))
    return groupby(rows, lambda x: x[:key])


_BLOCK = pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("sub", pa.int64()), ("start", pa.list_(pa.float64())), ("table", pa.list_(pa.float64()))])
_ENDS = pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("sub", pa.int64()), ("before", pa.int32()), ("end", pa.int32()), ("closes", pa.bool_())])
_LINE = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("opens", pa.bool_()), ("rendered", pa.string())])


def _out(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)


def _chunks(rows, schema: pa.Schema):
    held = []
    for row in rows:
        held.append(row)
        if len(held) == 4096:
            yield _out(held, schema)
            held = []
    yield _out(held, schema)


def _reduce(model):
    def tables(batches):
        for (conv, block, sub), rows in _stream(batches, 3):
            start = table = None
            for _, _, _, _, mark, shape, *_ in rows:
                seen = _emission(model, mark, shape)
                start = model[0] + seen if start is None else (start[:, None] + model[1]).max(0) + seen
                table = model[1] + seen if table is None else (table[:, :, None] + model[1]).max(1) + seen
            yield conv, block, sub, start.tolist(), table.ravel().tolist()

    return lambda batches: _chunks(tables(batches), _BLOCK)


def _chain(batches):
    def ends():
        for (conv,), rows in _stream(batches, 1):
            blocks, best, back = [], None, []
            for _, block, sub, start, table in rows:
                step = None if best is None else best[:, None] + np.array(table).reshape(3, 3)
                best = np.array(start) if best is None else step.max(0)
                back.append(None if step is None else step.argmax(0).astype(np.int8))
                blocks.append((block, sub))
            state = int(best.argmax())
            for k in range(len(blocks) - 1, -1, -1):
                before = None if back[k] is None else int(back[k][state])
                yield conv, *blocks[k], before, state, k == len(blocks) - 1
                state = before

    return _chunks(ends(), _ENDS)


def _trace(model):
    def decoded(batches):
        for (conv, *_), group in _stream(batches, 3):
            rows, best, back = list(group), None, []  # at most BLOCK rows
            before, end, closes = rows[0][7:10]
            for _, _, _, _, mark, shape, *_ in rows:
                seen = _emission(model, mark, shape)
                if best is None:
                    best = (model[0] if before is None else model[1][before]) + seen
                else:
                    step = best[:, None] + model[1]
                    back.append(step.argmax(0))
                    best = step.max(0) + seen
            path = [end]
            for step in reversed(back):
                path.append(int(step[path[-1]]))
            last = before
            for k, (row, state) in enumerate(zip(rows, reversed(path))):
                opens = state != last
                head = ("" if last is None else "<|end|>\n") + f"<|{ROLES[state]}|>\n" if opens else "\n"
                tail = "<|end|>\n" if closes and k == len(rows) - 1 else ""
                yield conv, row[3], ROLES[state], opens, head + row[6] + tail
                last = state

    return lambda batches: _chunks(decoded(batches), _LINE)


def blocked(read: DataFrame) -> DataFrame:
    """read with column sub: 0, or the place of a row's part in a block that has more than BLOCK rows. Such blocks alone are ranked."""
    many = read.groupBy("conv_id", "block").count().where(F.col("count") > BLOCK).select(F.col("conv_id").alias("c"), F.col("block").alias("b"))
    none = F.lit(0).cast("long")
    if not many.limit(1).count():
        return read.withColumn("sub", none)
    on = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b"))
    rank = F.row_number().over(Window.partitionBy("conv_id", "block").orderBy(*_in_block()))
    return read.join(many, on, "left_anti").withColumn("sub", none).union(read.join(many, on, "left_semi").withColumn("sub", F.floor((rank - 1) / BLOCK)))


def _in_block() -> list[Column]:
    return [F.asc_nulls_first(c) for c in ("turn", "text", "mark")]


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role (recovered), opens (the row opens a canonical turn) and rendered of each row of turns."""
    read = lines(turns)
    model = fit(read)
    read, key = blocked(read), ["conv_id", "block", "sub"]
    columns = [*key, "turn", "mark", "shape", "text"]
    order = [*(F.asc_nulls_first(c) for c in key), *_in_block()]
    tables = map_arrow(read.select(*columns).repartition(*key).sortWithinPartitions(*order), _reduce(model), "conv_id long, block long, sub long, start array<double>, table array<double>")
    ends = map_arrow(tables.repartition("conv_id").sortWithinPartitions(*key), _chain, "conv_id long, block long, sub long, before int, end int, closes boolean")
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")) & (F.col("sub") == F.col("s"))
    fixed = read.select(*columns).join(ends.toDF("c", "b", "s", "before", "end", "closes"), same).drop("c", "b", "s")
    return map_arrow(fixed.repartition(*key).sortWithinPartitions(*order), _trace(model), "conv_id long, turn long, role string, opens boolean, rendered string")
