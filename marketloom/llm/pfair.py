"""Mixing sources to target weights by Pfair scheduling.

Every source is cut into blocks of ``block_bytes`` in id order. With weight ``w`` (shares that sum
to one), block ``j`` of a source is released at slot ``floor(j / w)`` and due before slot
``ceil((j + 1) / w)``; the released block with the earliest deadline takes the next slot. At every
slot a source has had its share to within less than one block. Weights are whole shares of a
period, so the schedule repeats: it is worked out for one period and any block's slot follows by
arithmetic, with no pass over the blocks. When a source has no blocks left, the others go on by
their weights among themselves, so every document is placed exactly once.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from marketloom.llm.common import slices
from marketloom.session import durable

PERIOD = 1000
BLOCK_BYTES = 64 << 10
# Target shares that are not given grow with this power of a source's size.
SMOOTHING = 0.7
_OWN = ("mix_before", "mix_block", "mix_slot")


def period_slots(shares: dict[str, int]) -> dict[str, list[int]]:
    """The slots of each source within one period of ``sum(shares)`` slots, earliest deadline
    first among the released blocks; ties go by name."""
    total = sum(shares.values())
    waiting = [(0, -(-total // n), s, 0) for s, n in shares.items()]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    slots: dict[str, list[int]] = {s: [] for s in shares}
    for t in range(total):
        while waiting and waiting[0][0] <= t:
            _, due, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (due, s, j))
        due, s, j = heapq.heappop(ready)
        slots[s].append(t)
        n, j = shares[s], j + 1
        if j < n:
            heapq.heappush(waiting, (j * total // n, -(-(j + 1) * total // n), s, j))
    return slots


def phases(shares: dict[str, int], blocks: dict[str, int]) -> list[tuple]:
    """Rows (source, from block, to block, first slot, period, share, slots): within a phase the
    same sources are active, and it ends with the slot in which one of them runs out."""
    left = {s: n for s, n in blocks.items() if n > 0}
    done = dict.fromkeys(left, 0)
    base, rows = 0, []
    while left:
        weighted = {s: shares[s] for s in left if shares.get(s, 0) > 0}
        active = weighted or dict.fromkeys(left, 1)
        period, slots = sum(active.values()), period_slots(active)
        length = 1 + min(
            (left[s] - 1) // n * period + slots[s][(left[s] - 1) % n] for s, n in active.items()
        )
        whole, rest = divmod(length, period)
        for s, n in active.items():
            taken = whole * n + sum(x < rest for x in slots[s])
            if taken:
                rows.append((s, done[s], done[s] + taken, base, period, n, slots[s]))
                done[s] += taken
                left[s] -= taken
        left = {s: n for s, n in left.items() if n}
        base += length
    return rows


def whole_shares(weights: dict[str, float], period: int = PERIOD) -> dict[str, int]:
    """Weights as whole shares of a period by largest remainders, at least one each."""
    weights = {s: w for s, w in weights.items() if w > 0}
    period = max(period, 4 * len(weights))
    total = sum(weights.values())
    exact = {s: w / total * period for s, w in weights.items()}
    out = {s: max(1, int(x)) for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: (int(exact[s]) - exact[s], s))[: max(0, period - sum(out.values()))]:
        out[s] += 1
    return out


def mix(
    docs: DataFrame,
    size: str,
    weights: dict[str | None, float] | None = None,
    block_bytes: int = BLOCK_BYTES,
    id_col: str = "doc_id",
    source_col: str = "source",
) -> DataFrame:
    """All rows and columns of ``docs`` with ``mix_before`` (bytes of the source before the row),
    ``mix_block`` and ``mix_slot``; the mixed order is ``mix_slot, mix_before``.

    ``size`` names the column with a document's bytes; null or negative counts as zero, and every
    document counts one byte more for its end. A document that is longer than a block uses up the
    blocks it covers. A null source is a source of its own. Sources that ``weights`` leaves out
    come after all others, evenly; without ``weights`` a source's share grows with a power of its
    size. Rows with a null id come first in their source, rows of one id go by a hash of all their
    columns, repeated rows stay. Columns of ``docs``
    with the three names are replaced. An empty table gives an empty result.
    """
    name = F.when(F.col(source_col).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), source_col))
    held = docs.drop(*_OWN)
    # The row travels as one column, so its names cannot meet the operator's own.
    rows = held.select(
        F.struct(*held.columns).alias("_row"),
        F.col(id_col).alias("_id"),
        name.alias("_source"),
        (F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0)) + 1).alias("_size"),
        # Many rows may share an id or have none; their contents put them in order and divide them.
        F.xxhash64(*[c for c, kind in held.dtypes if "map<" not in kind]).alias("_tie"),
    )
    order = ["_source", "_id", "_tie"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("_tie")
    schema = T.StructType(
        [*dealt.schema, T.StructField("_part", T.IntegerType()), T.StructField("_in_part", T.LongType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, source, total = TaskContext.get().partitionId(), None, 0
        for batch in slices(batches):
            sizes = batch.column("_size").to_numpy()
            names = batch.column("_source").to_pylist()
            before = np.zeros(len(names), np.int64)
            for i, (s, n) in enumerate(zip(names, sizes.tolist())):
                if s != source:
                    source, total = s, 0
                before[i] = total
                total += n
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(len(names), part, np.int32)), pa.array(before)],
                [*batch.schema.names, "_part", "_in_part"],
            )

    stored = durable(dealt.mapInArrow(run, schema))
    # One row per source and partition that holds it: sources plus partitions at most.
    totals = stored.groupBy("_source", "_part").agg(F.max(F.col("_in_part") + F.col("_size")).alias("_n"))
    running = Window.partitionBy("_source").orderBy("_part")
    offsets = totals.withColumn("_offset", F.sum("_n").over(running) - F.col("_n")).drop("_n")
    sums = {r["_source"]: r["n"] for r in totals.groupBy("_source").agg(F.sum("_n").alias("n")).collect()}
    blocks = {s: (n - 1) // block_bytes + 1 for s, n in sums.items()}
    if weights is None:
        wanted = {s: n**SMOOTHING for s, n in sums.items()}
    else:
        wanted = {"" if s is None else f"={s}": w for s, w in weights.items()}
        wanted = {s: w for s, w in wanted.items() if s in sums}
    plan = phases(whole_shares(wanted) if wanted else {}, blocks)
    spark = docs.sparkSession
    kind = "_source string, _from long, _to long, _base long, _period long, _share long, _slots array<int>"
    table = spark.createDataFrame(plan, kind).groupBy("_source").agg(
        F.collect_list(F.struct("_from", "_to", "_base", "_period", "_share", "_slots")).alias("_phases")
    )
    placed = (
        stored.join(F.broadcast(offsets), ["_source", "_part"])
        .withColumn("mix_before", F.col("_in_part") + F.col("_offset"))
        .withColumn("mix_block", F.floor(F.col("mix_before") / block_bytes).cast("long"))
        .join(F.broadcast(table), "_source")
        .withColumn("_p", F.filter("_phases", lambda p: (p["_from"] <= F.col("mix_block")) & (F.col("mix_block") < p["_to"]))[0])
    )
    nth = F.col("mix_block") - F.col("_p._from")
    slot = (
        F.col("_p._base")
        + F.floor(nth / F.col("_p._share")).cast("long") * F.col("_p._period")
        + F.element_at(F.col("_p._slots"), (nth % F.col("_p._share")).cast("int") + 1)
    )
    return placed.withColumn("mix_slot", slot).select("_row.*", *_OWN)
