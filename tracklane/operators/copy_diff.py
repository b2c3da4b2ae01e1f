"""Differences between two copies of a dataset (problem 2).

Each copy is digested into a tree of checksums over key ranges: a leaf covers
``2**leaf_bits`` neighbouring keys of one entity, each level above covers
``2**fan_bits`` ranges of the level below. Comparison starts at the top and goes
down only into ranges whose checksums disagree (splitting each into
``2**fan_bits`` parts rather than two, as each level costs a Spark stage; there are
``levels`` of them, so the top is a row per ``2**(leaf_bits + (levels - 1) * fan_bits)``
keys rather than a single one); fields are compared for the rows of disagreeing leaves alone.

Numbers are not compared bit by bit, so a checksum is made of cells: a double
falls into a cell as wide as the tolerance, a nanosecond stamp is rounded as a
double would round it (256 ns apart in this century). Equal cells always mean
values within tolerance, so a range with equal checksums holds no difference;
values that are close but fall into two cells only send their leaf down to the
field comparison.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklane.functions.missing import present
from tracklane.session import cut


@dataclass(frozen=True)
class Field:
    """A compared field: ``path`` may name a struct member; kind is 'number', 'stamp' or 'text'."""

    path: str
    kind: str = "number"


@dataclass(frozen=True)
class DiffConfig:
    tolerance: float = 0.001
    stamp_tolerance_ns: int = 1024
    cell_phase: float = 0.00005  # values written with four decimals then sit away from cell borders
    exact_above: float = 1e9  # beyond it a cell is the double itself
    leaf_bits: int = 3  # of few keys, so that a difference sends few rows to the field comparison
    fan_bits: int = 5
    levels: int = 4


def _value(f: Field) -> Column:
    x = F.col(f.path)
    if f.kind == "number":
        x = x.cast("double")
        return F.when(present(x), x)
    return x.cast("bigint") if f.kind == "stamp" else x.cast("string")


def _cell(f: Field, x: Column, cfg: DiffConfig) -> Column:
    if f.kind == "number":
        cell = F.floor((x + F.lit(cfg.cell_phase)) / F.lit(cfg.tolerance)).cast("double")
        return F.when(F.abs(x) > cfg.exact_above, x).otherwise(F.when(F.abs(x) <= cfg.exact_above, cell))
    if f.kind == "stamp":
        return x.cast("double").cast("bigint")
    return x


def _differs(f: Field, a: Column, b: Column, cfg: DiffConfig) -> Column:
    if f.kind == "text":
        return ~a.eqNullSafe(b)
    if f.kind == "stamp":
        far = F.coalesce(F.abs(F.try_subtract(a, b)) > cfg.stamp_tolerance_ns, F.lit(True))
    else:
        far = F.when(a == b, False).otherwise(F.abs(a - b) > cfg.tolerance)
    return F.when(a.isNull() | b.isNull(), ~(a.isNull() & b.isNull())).otherwise(far)


SIDES = (0, 1)  # generated, golden
SUMS = ("digest", "total", "n")


def leaf_checksums(generated: DataFrame, golden: DataFrame, entity: str, key: str, fields: list[Field], cfg: DiffConfig) -> DataFrame:
    """One row per leaf range: (entity, leaf) and the checksum (digest, total, n) of either side. Repeated rows of a key count once."""
    cells = [(_cell(f, _value(f), cfg)) for f in fields]
    gaps = sum((F.when(_value(f).isNull(), F.lit(1 << i)).otherwise(0) for i, f in enumerate(fields)), F.lit(0))

    def rows(df: DataFrame, side: int) -> DataFrame:
        k = F.col(key).cast("bigint")
        return df.select(F.col(entity).alias("entity"), F.shiftright(k, cfg.leaf_bits).alias("leaf"), k.alias("k"), F.lit(side).alias("side"), F.xxhash64(*cells, gaps).alias("h"))

    # one shuffle by range serves both the repeats and the sums over ranges
    once = rows(generated, 0).unionByName(rows(golden, 1)).repartition("entity", "leaf").distinct()
    row = F.xxhash64(F.coalesce("k", F.lit(0)), F.col("k").isNull(), "h")  # every version that a key has counts
    return once.withColumn("row", row).groupBy("entity", "leaf").agg(
        *(F.bit_xor(F.when(F.col("side") == s, F.col("row"))).alias(f"digest{s}") for s in SIDES),
        *(F.sum(F.when(F.col("side") == s, F.pmod("row", F.lit(1 << 31)))).alias(f"total{s}") for s in SIDES),
        *(F.count_if(F.col("side") == s).alias(f"n{s}") for s in SIDES),
    )


def _parent(level: DataFrame, cfg: DiffConfig) -> DataFrame:
    return level.groupBy("entity", F.shiftright("leaf", cfg.fan_bits).alias("leaf")).agg(
        *(F.bit_xor(f"digest{s}").alias(f"digest{s}") for s in SIDES), *(F.sum(f"{c}{s}").alias(f"{c}{s}") for c in ("total", "n") for s in SIDES)
    )


def _mismatched(level: DataFrame) -> DataFrame:
    """Ranges of one level whose checksums disagree or that one side lacks."""
    same = [F.col(f"{c}0").eqNullSafe(F.col(f"{c}1")) for c in SUMS]
    return level.filter(~(same[0] & same[1] & same[2])).select("entity", "leaf")


def mismatched_leaves(leaves: DataFrame, cfg: DiffConfig) -> DataFrame:
    """Bisect from the top: (entity, leaf) of the leaf ranges in which the copies disagree."""
    tree = [leaves]
    for _ in range(cfg.levels - 1):
        tree.append(_parent(tree[-1], cfg))
    bad = _mismatched(tree.pop())
    while tree:
        up = bad.select(F.col("entity").alias("e"), F.col("leaf").alias("up")).alias("b")
        below = _mismatched(tree.pop()).alias("x")
        on = F.col("x.entity").eqNullSafe(F.col("b.e")) & F.shiftright("x.leaf", cfg.fan_bits).eqNullSafe(F.col("b.up"))
        bad = below.join(up, on, "left_semi")
    return bad


def diff_copies(
    generated: DataFrame,
    golden: DataFrame,
    entity: str,
    key: str,
    fields: list[Field],
    cfg: DiffConfig = DiffConfig(),
) -> DataFrame:
    """Rows (entity, row_key, diff, field_name), one per missing row or differing field.

    Null and NaN are one missing value that differs from any number; equal
    infinities agree. Rows repeated under a key are one row (where they disagree
    among themselves, the least in field order stands for them). A null entity or
    key is a key like any other. Columns beyond ``fields`` are never looked at;
    an empty copy makes every row of the other one missing.
    """
    leaves = cut(leaf_checksums(generated, golden, entity, key, fields, cfg))
    bad = cut(mismatched_leaves(leaves, cfg))
    names = [f"f{i}" for i in range(len(fields))]

    def suspects(df: DataFrame, side: int) -> DataFrame:
        rows = df.select(
            F.col(entity).alias("entity"),
            F.col(key).cast("bigint").alias("row_key"),
            F.struct(*(_value(f).alias(n) for f, n in zip(fields, names, strict=True))).alias("v"),
            F.lit(side).alias("side"),
        ).alias("x")
        on = F.col("x.entity").eqNullSafe(F.col("b.entity")) & F.shiftright("x.row_key", cfg.leaf_bits).eqNullSafe(F.col("b.leaf"))
        return rows.join(bad.alias("b"), on, "left_semi")

    pairs = (
        suspects(generated, 0)
        .unionByName(suspects(golden, 1))
        .groupBy("entity", "row_key")
        .agg(*(F.min(F.when(F.col("side") == s, F.col("v"))).alias(c) for s, c in ((0, "a"), (1, "b"))))
    )
    at = lambda diff, name: F.struct(F.lit(diff).alias("diff"), F.lit(name).alias("field_name"))
    values = F.array_compact(
        F.array(*(F.when(_differs(f, F.col(f"a.{n}"), F.col(f"b.{n}"), cfg), at("value", f.path)) for f, n in zip(fields, names, strict=True)))
    )
    found = (
        F.when(F.col("b").isNull(), F.array(at("missing_in_golden", "")))
        .when(F.col("a").isNull(), F.array(at("missing_in_generated", "")))
        .otherwise(values)
    )
    return pairs.select("entity", "row_key", F.explode(found).alias("d")).select("entity", "row_key", "d.diff", "d.field_name")
