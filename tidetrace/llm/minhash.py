"""Near duplicates by MinHash.

A document is the set of its distinct runs of five words. Documents with the same set are one class from the start. Classes
get the minima of many universal hashes of their sets; those with equal minima in a whole band meet in a bucket.

A bucket's links are found without writing out its pairs: every member is compared with the bucket's smallest, then those
which that has not connected with all, block by block. Compared pairs first pass a check of their signatures, wide enough to
let linked pairs through, then the exact one on the full sets. The groups are the connected components.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidetrace.llm import shingles
from tidetrace.llm.common import written
from tidetrace.llm.components import components, extended


@dataclass(frozen=True)
class Plan:
    """``words`` per shingle; links are pairs with 100 |A and B| >= ``percent`` |A or B|. ``bands`` of ``rows`` minima each: a
    linked pair shares no band with probability (1 - 0.75^5)^32 = 0.0002 at the threshold, 0.000003 at 0.8. Pairs whose
    signatures agree in less than ``least`` of the places are not compared; at the threshold that is 5.8 deviations off."""

    words: int = 5
    percent: int = 75
    bands: int = 32
    rows: int = 5
    least: float = 0.55
    seed: int = 3

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        draw = np.random.default_rng(self.seed)
        n = self.bands * self.rows
        return draw.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1), draw.integers(0, 1 << 63, n, np.uint64)


#: Ids up to this number (8 MB) are sent to all tasks to pick their rows.
SENT_IDS = 1 << 20
#: Members of a bucket that a task holds while others pass by.
BLOCK_ROWS = 512

#: Elements of sets worked on at once, so that they stay in the processor's cache.
_PIECE = 1 << 15


def _minima(sets: list[np.ndarray], plan: Plan) -> np.ndarray:
    """The smallest a x + b (mod 2^64) of each non-empty set for each hash, upper 32 bits; long sets are taken in pieces."""
    a, b = plan.hashes()
    out = np.full((len(sets), len(a)), np.iinfo(np.uint64).max, np.uint64)
    cuts, parts, held = [], [], 0

    def flush() -> None:
        nonlocal held
        if not parts:
            return
        x = np.concatenate(parts)
        starts = np.cumsum([0, *map(len, parts[:-1])])
        y = np.empty_like(x)
        for k in range(len(a)):
            np.multiply(x, a[k], out=y)
            np.add(y, b[k], out=y)
            # the parts of a long set follow each other in different pieces
            out[cuts, k] = np.minimum(out[cuts, k], np.minimum.reduceat(y, starts))
        cuts.clear()
        parts.clear()
        held = 0

    for i, values in enumerate(sets):
        for at in range(0, len(values), _PIECE):
            part = values[at : at + _PIECE]
            if held + len(part) > _PIECE:
                flush()
            cuts.append(i)
            parts.append(part)
            held += len(part)
    flush()
    return (out >> np.uint64(32)).astype(np.uint32)


def sketches(documents: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """``id, n_shingles, high, low, bands, signature`` of (id, text) rows.

    ``high`` and ``low`` identify the set; ``bands`` has a hash for each band, ``signature`` a byte for each minimum. Null
    and empty texts, and texts without words, have no shingles, and null in the other columns.
    """
    schema = T.StructType(
        [
            documents.schema["id"],
            T.StructField("n_shingles", T.LongType()),
            T.StructField("high", T.LongType()),
            T.StructField("low", T.LongType()),
            T.StructField("bands", T.ArrayType(T.LongType())),
            T.StructField("signature", T.BinaryType()),
        ]
    )

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shingles.mix(np.arange(1, plan.rows + 1, dtype=np.uint64)) | np.uint64(1)
        for batch in batches:
            for piece in shingles.words(batch.column(1)):
                sets = shingles.shingle_sets(piece, plan.words)
                full = np.flatnonzero([len(s) for s in sets])
                minima = _minima([sets[i] for i in full], plan)
                keys = shingles.mix(
                    (minima.reshape(len(full), plan.bands, plan.rows).astype(np.uint64) * weights).sum(axis=2, dtype=np.uint64)
                    + shingles.mix(np.arange(plan.bands, dtype=np.uint64))
                )
                n = np.array([len(s) for s in sets], np.int64)
                high, low = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
                for i in full:
                    high[i] = sets[i].sum(dtype=np.uint64)
                    low[i] = np.bitwise_xor.reduce(shingles.mix(sets[i] + np.uint64(1)))
                bands, signature = [None] * len(sets), [None] * len(sets)
                for k, i in enumerate(full):
                    bands[i] = keys[k].view(np.int64)
                    signature[i] = (minima[k] & 0xFF).astype(np.uint8).tobytes()
                empty = n == 0
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(piece.first, len(sets)),
                        pa.array(n),
                        pa.array(high.view(np.int64), mask=empty),
                        pa.array(low.view(np.int64), mask=empty),
                        pa.array(bands, pa.list_(pa.int64())),
                        pa.array(signature, pa.binary()),
                    ],
                    schema.names,
                )

    return documents.mapInArrow(sketch, schema)


def _least(plan: Plan) -> int:
    return int(plan.least * plan.bands * plan.rows)


def _upper(plan: Plan, both: np.ndarray, x: np.ndarray | int, y: np.ndarray | int) -> np.ndarray:
    """Whether sets of x and y elements that share ``both`` are linked."""
    return 100 * both >= plan.percent * (x + y - both)


def _agree(plan: Plan) -> Column:
    """The signatures ``sa`` and ``sb`` agree in enough places."""

    @F.pandas_udf("boolean")
    def agree(a, b):
        import pandas as pd

        x = np.frombuffer(b"".join(a), np.uint8).reshape(len(a), -1)
        y = np.frombuffer(b"".join(b), np.uint8).reshape(len(b), -1)
        return pd.Series((x == y).sum(axis=1) >= _least(plan))

    return agree("sa", "sb")


def _linked(plan: Plan) -> Column:
    """The sets ``xa`` and ``xb``, as sorted 64-bit numbers, are similar enough."""

    @F.pandas_udf("boolean")
    def linked(a, b):
        import pandas as pd

        out = []
        for x, y in zip(a, b):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(bool(_upper(plan, both, len(x), len(y))))
        return pd.Series(out, dtype=bool)

    return linked("xa", "xb")


def _sent(ids: DataFrame) -> DataFrame:
    """Ids to pick rows by: sent to all tasks up to ``SENT_IDS`` of them, else joined by a shuffle."""
    ids = written(ids.distinct(), "ids")
    return F.broadcast(ids) if ids.count() <= SENT_IDS else ids


def _sets(documents: DataFrame, ids: DataFrame, plan: Plan, low: bool = False) -> DataFrame:
    """``id, x``: the sets of the given ids, one row per id, as sorted numbers of 64 bits, or their lowest 16 bits only."""
    schema = T.StructType([documents.schema["id"], T.StructField("x", T.BinaryType())])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in shingles.words(batch.column(1)):
                sets = shingles.shingle_sets(piece, plan.words)
                sets = [(s & np.uint64(0xFFFF)).astype(np.uint16).tobytes() if low else s.tobytes() for s in sets]
                of = batch.column(0).slice(piece.first, len(sets))
                yield pa.RecordBatch.from_arrays([of, pa.array(sets, pa.binary())], schema.names)

    made = documents.join(_sent(ids), "id", "left_semi").mapInArrow(build, schema)
    return written(made.dropDuplicates(["id"]), "sets")


def _alike(pairs: DataFrame, classes: DataFrame, plan: Plan) -> DataFrame:
    """The pairs (u, v) whose sizes and signatures allow a link."""
    pairs = written(pairs, "pairs")
    ids = pairs.select(F.explode(F.array("u", "v")).alias("id"))
    marks = written(classes.select("id", "n_shingles", "signature").join(_sent(ids), "id", "left_semi"), "marks")
    both = pairs.join(marks.toDF("u", "na", "sa"), "u").join(marks.toDF("v", "nb", "sb"), "v")
    sizes = (100 * F.col("na") >= plan.percent * F.col("nb")) & (100 * F.col("nb") >= plan.percent * F.col("na"))
    return both.where(sizes).where(_agree(plan)).select("u", "v")


def _confirmed(pairs: DataFrame, documents: DataFrame, plan: Plan) -> DataFrame:
    """The pairs (u, v) that the full sets link."""
    pairs = written(pairs, "likely")
    if pairs.isEmpty():
        return pairs
    sets = _sets(documents, pairs.select(F.explode(F.array("u", "v")).alias("id")), plan)
    return pairs.join(sets.toDF("u", "xa"), "u").join(sets.toDF("v", "xb"), "v").where(_linked(plan)).select("u", "v")


def _compared(rows: DataFrame, plan: Plan) -> DataFrame:
    """The pairs (u, v) in different components that may be linked, of members of the same bucket.

    ``rows`` is (key, id, c, odd, odds, all, signature, x) for all members of some buckets: ``odd`` members, ``odds`` of them,
    are compared with all. Both sides are cut into blocks, and each task compares a block with a block: the odd members of
    its block are held, the others pass by. Signatures decide first. Then the shared lowest bits of the shingles are
    counted, which are as many as the shared shingles or more, so that no link is lost.
    """
    parts = {"odds": F.ceil(F.col("odds") / BLOCK_ROWS), "all": F.ceil(F.col("all") / BLOCK_ROWS)}
    rows = rows.withColumns({k: v.cast("int") for k, v in parts.items()}).withColumn("h", F.xxhash64("id", F.lit(1)))
    sides = []
    for own, other, passing in (("odds", "all", False), ("all", "odds", True)):
        side = rows if passing else rows.where("odd")
        mine = F.pmod("h", own).cast("int")
        spread = F.explode(F.sequence(F.lit(0), F.col(other) - 1))
        i, j = (spread, mine) if passing else (mine, spread)
        side = side.withColumn("i", i).withColumn("j", j)
        sides.append(side.select("key", "i", "j", F.lit(passing).alias("passing"), "id", "c", "odd", "signature", "x"))
    dealt = sides[0].union(sides[1]).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "passing")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, []
        table = np.zeros(1 << 16, bool)
        for batch in batches:
            key, i, j, passing, ids, c, odd = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(7))
            signs = np.frombuffer(b"".join(batch.column(7).to_pylist()), np.uint8).reshape(len(key), -1)
            sets = [np.frombuffer(x, np.uint16) for x in batch.column(8).to_pylist()]
            size = np.array([len(x) for x in sets])
            new = (np.diff(key) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0) | (np.diff(passing.astype(np.int8)) != 0)
            cuts = [0, *(np.flatnonzero(new) + 1).tolist(), len(key)]
            u, v = [], []
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                if block != (here := (key[a], i[a], j[a])):
                    block, held = here, []
                if not passing[a]:
                    held += [(ids[k], c[k], signs[k], sets[k]) for k in range(a, b)]
                    continue
                for own_id, own_c, own_sign, own_set in held:
                    # a pair of odd members meets twice
                    can = (c[a:b] != own_c) & (~odd[a:b] | (ids[a:b] > own_id))
                    can &= (signs[a:b] == own_sign).sum(axis=1) >= _least(plan)
                    some = np.flatnonzero(can) + a
                    if not len(some):
                        continue
                    table[own_set] = True
                    shared = [np.count_nonzero(table[sets[k]]) for k in some]
                    table[own_set] = False
                    shared = np.minimum(shared, np.minimum(size[some], len(own_set)))
                    some = some[_upper(plan, shared, size[some], len(own_set))]
                    u += [own_id] * len(some)
                    v += ids[some].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return dealt.mapInArrow(compare, "u bigint, v bigint").distinct()


def _across(members: DataFrame, found: DataFrame, classes: DataFrame, documents: DataFrame, plan: Plan) -> DataFrame:
    """Pairs of a bucket that may be linked and aren't in the same component. ``members`` is (key, id, lowest).

    The bucket's smallest has been compared with all. So a pair has a member outside of its component: an odd one.
    """
    placed = members.join(found, members.id == found.node, "left")
    placed = written(placed.select("key", "id", "lowest", F.coalesce("component", "id").alias("c")), "placed")
    leads = placed.where("id = lowest").select("key", F.col("c").alias("lead"))
    rest = written(placed.where("id != lowest").join(leads, "key").select("key", "id", "c", (F.col("c") != F.col("lead")).alias("odd")), "rest")
    counts = rest.groupBy("key").agg(F.count_if("odd").alias("odds"), F.count("*").alias("all"))
    counts = written(counts.where("odds > 0 and all > 1"), "counts")
    rows = written(rest.join(counts, "key"), "rows")
    if rows.isEmpty():
        return rows.select(F.col("id").alias("u"), F.col("id").alias("v"))
    low = _sets(documents, rows.select("id"), plan, low=True)
    held = written(low.join(classes.select("id", "signature"), "id"), "held")
    return _compared(rows.join(held, "id"), plan)


def class_components(classes: DataFrame, documents: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """``node, component`` of the linked classes. ``classes`` is a table of sketches with one row per set."""
    banded = classes.select("id", F.posexplode("bands").alias("band", "key"))
    buckets = banded.select(F.xxhash64("band", "key").alias("key"), "id")
    lowest = buckets.groupBy("key").agg(F.min("id").alias("lowest"), F.max("id").alias("highest")).where("lowest < highest")
    lowest = written(lowest.drop("highest"), "lowest")
    members = written(buckets.join(lowest, "key"), "members")
    stars = members.where("id > lowest").select(F.col("lowest").alias("u"), F.col("id").alias("v")).distinct()
    found = components(_confirmed(_alike(stars, classes, plan), documents, plan))
    return extended(found, _confirmed(_across(members, found, classes, documents, plan), documents, plan))


def near_duplicates(documents: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """``id, n_shingles, component`` of every row of ``documents``, a written table (id, text) with bigint ids.

    ``component`` is the smallest id that can be reached over links. Rows without shingles are linked with nothing: their
    component is their own id. Equal texts are linked; of a repeated id, all rows are in one component. A null id has a null
    component if no row with an id has the same set. Ids are unique but for repeated rows. An empty table gives an empty result.
    """
    sketched = written(sketches(documents.select("id", "text"), plan), "sketches")
    of_set = ["n_shingles", "high", "low"]
    sets = sketched.where("n_shingles > 0").groupBy(*of_set).agg(F.min("id").alias("id"))
    sets = written(sets.where("id is not null"), "sets")
    # the sketch of a class is that of its smallest id
    classes = sketched.join(sets.select("id", *of_set), ["id", *of_set], "left_semi")
    classes = written(classes.dropDuplicates(["id"]), "classes")
    found = class_components(classes, documents.select("id", "text"), plan)
    named = sets.join(found, sets.id == found.node, "left")
    named = written(named.select(*of_set, F.coalesce("component", "id").alias("component")), "named")
    out = sketched.select("id", *of_set).join(named, of_set, "left")
    return out.select("id", "n_shingles", F.coalesce("component", "id").alias("component"))
