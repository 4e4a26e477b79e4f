"""Feature registry: declared columns, resolved into layers of one block plan."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property
from typing import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import StructField, StructType

from ..functions.frame import Frame
from ..operators.layout import block_rows, framed

CARRIED = ("symbol", "ts", "pos", "blk", "home")


@dataclass
class Feature:
    name: str
    build: Callable[[Frame], Column] | None
    group: str
    scan: tuple[str, str] | None = None  # (input column, operation) for running totals

    @cached_property
    def _probe(self) -> Frame:
        """A trial build that records the needs; it runs when a session exists."""
        probe = Frame()
        if self.scan:
            probe[self.scan[0]]
        else:
            self.build(probe)
        return probe

    @property
    def deps(self) -> tuple[str, ...]:
        return tuple(sorted(self._probe.deps - {self.name}))

    @property
    def back(self) -> int:
        return self._probe.back

    @property
    def ahead(self) -> int:
        return self._probe.ahead


@dataclass
class Registry:
    parent: "Registry | None" = None
    features: dict[str, Feature] = field(default_factory=dict)

    # -- declaration -----------------------------------------------------
    def add(self, group: str, **builders: Callable[[Frame], Column]):
        """Declare features; their needs are read off a trial build later."""
        for name, build in builders.items():
            self.features[name] = Feature(name, build, group)

    def running(self, group: str, name: str, source: str, op: str = "sum"):
        """Declare a running total (sum, product or max) over the whole series."""
        self.features[name] = Feature(name, None, group, (source, op))

    def find(self, name: str) -> Feature | None:
        if name in self.features:
            return self.features[name]
        return self.parent.find(name) if self.parent else None

    def group(self, group: str) -> list[str]:
        return [f.name for f in self.features.values() if f.group == group and not f.name.startswith("_")]

    def groups(self) -> dict[str, list[str]]:
        names = dict.fromkeys(f.group for f in self.features.values())
        return {g: self.group(g) for g in names}

    # -- resolution ------------------------------------------------------
    def resolve(self, wanted, given) -> tuple[list[list[Feature]], dict[str, tuple[int, int]]]:
        """Layers of features in dependency order, and the total need of each."""
        level: dict[str, int] = {}
        need: dict[str, tuple[int, int]] = {}
        open_names: set[str] = set()

        def visit(name: str) -> int:
            if name in level:
                return level[name]
            feature = self.find(name)
            if feature is None or (name in given and name not in wanted):
                if name not in given:
                    raise ValueError(f"missing dependency: {name}")
                level[name], need[name] = 0, (0, 0)
                return 0
            if name in open_names:
                raise ValueError(f"circular dependency: {name}")
            open_names.add(name)
            depth = 1 + max([visit(d) for d in feature.deps], default=0)
            back = max([need[d][0] for d in feature.deps], default=0)
            ahead = max([need[d][1] for d in feature.deps], default=0)
            level[name], need[name] = depth, (back + feature.back, ahead + feature.ahead)
            return depth

        for name in wanted:
            visit(name)
        layers: dict[int, list[Feature]] = {}
        for name, depth in level.items():
            if depth:
                layers.setdefault(depth, []).append(self.find(name))
        return [layers[d] for d in sorted(layers)], need

    def compute(self, df: DataFrame, wanted, keep=(), block: int | None = None) -> DataFrame:
        """Add the wanted features to a table with (symbol, ts, pos).

        One shuffle on (symbol, block) serves all layers. Returned columns are
        symbol, ts, pos, the kept input columns and the wanted features.
        """
        wanted, keep = list(dict.fromkeys(wanted)), list(keep)
        given = set(df.columns)
        layers, need = self.resolve(wanted, given)
        back = max([n[0] for n in need.values()], default=0)
        ahead = max([n[1] for n in need.values()], default=0)
        block = block or block_rows(df, back, ahead)
        used = {d for layer in layers for f in layer for d in f.deps if d in given}
        base = ["symbol", "ts", "pos"] + sorted((used | set(keep)) - {"symbol", "ts", "pos"})
        plan = framed(df.select(*base), back, ahead, block)
        start = F.greatest(F.col("blk") * block - back, F.lit(0))

        last_use: dict[str, int] = {}
        for i, layer in enumerate(layers):
            for f in layer:
                for d in f.deps:
                    last_use[d] = i
        final = set(wanted) | set(keep) | set(CARRIED)

        for i, layer in enumerate(layers):
            plain = [f for f in layer if f.scan is None]
            if plain:
                frame = Frame(start=start, rows=block + back + ahead)
                alive = [c for c in plan.columns if c in final or last_use.get(c, -1) >= i]
                fresh = {f.name: f.build(frame).alias(f.name) for f in plain}
                for step in frame.pooled():
                    plan = plan.select("*", *step)
                if frame.ranks:
                    plan = sliding_ranks(plan, list(frame.ranks.values()))
                plan = plan.select(*[c for c in alive if c not in fresh], *fresh.values())
            scans: dict[int, dict] = {}
            for f in layer:
                if f.scan:
                    scans.setdefault(need[f.name][0], {})[f.name] = f.scan
            for input_back, group in scans.items():
                plan = running_totals(plan, group, block, back, input_back)
        return plan.where("home").select("symbol", "ts", "pos", *[c for c in keep if c not in ("symbol", "ts", "pos")],
                                         *[c for c in wanted if c not in keep])


def sliding_ranks(plan: DataFrame, wanted: list) -> DataFrame:
    """Add average-tie ranks (name, value, n rows) over n, one pass per block with the last n values in order.

    A row enters and leaves the ordered ring once; the partitioning of the blocks is the one the windows use.
    """
    out = plan.select("*", *[value.cast("double").alias(name) for name, value, _ in wanted])
    sizes = {name: n for name, _, n in wanted}

    def run(block):
        import bisect

        import numpy as np
        import pyarrow as pa

        block = block.sort_by("pos")
        for name, n in sizes.items():
            at = block.schema.get_field_index(name)
            values = block.column(at).to_numpy(zero_copy_only=False)
            ranks, ring = np.full(len(values), np.nan), []
            for i, v in enumerate(values):
                if i >= n and values[i - n] == values[i - n]:
                    del ring[bisect.bisect_left(ring, values[i - n])]
                if v == v:
                    bisect.insort(ring, v)
                    if len(ring) == n:
                        low, high = bisect.bisect_left(ring, v), bisect.bisect_right(ring, v)
                        ranks[i] = (low + (high - low + 1) / 2) / n
            block = block.set_column(at, name, pa.array(ranks, mask=np.isnan(ranks)))
        return block

    schema = StructType([StructField(f.name, f.dataType, True) for f in out.schema])
    return out.groupBy("symbol", "blk").applyInArrow(run, schema)


FOLD = {"sum": F.sum, "product": F.product, "max": F.max}
MERGE = {
    "sum": lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b),
    "product": lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a * b),
    "max": lambda a, b: F.greatest(a, b),
}


def running_totals(plan: DataFrame, scans: dict, block: int, back: int, input_back: int) -> DataFrame:
    """Running totals of whole series inside overlapping blocks.

    Block k is trusted from row v(k) on, where its inputs are complete. The rows
    v(k) .. v(k+1)-1 of all blocks cover the series once, so their totals per
    block (a small table) accumulate to the value each block starts from.
    """

    def trusted(blk: Column) -> Column:
        first = blk * block - back
        return F.when(first <= 0, F.lit(0)).otherwise(first + input_back)

    known = F.col("pos") >= trusted(F.col("blk"))
    owned = known & (F.col("pos") < trusted(F.col("blk") + 1))
    totals = plan.groupBy("symbol", "blk").agg(
        *[FOLD[op](F.when(owned, F.col(x))).alias(f"_t_{n}") for n, (x, op) in scans.items()]
    )
    before = W.partitionBy("symbol").orderBy("blk").rowsBetween(W.unboundedPreceding, -1)
    carry = totals.select(
        "symbol", "blk", *[FOLD[op](f"_t_{n}").over(before).alias(f"_c_{n}") for n, (_, op) in scans.items()]
    )
    run = W.partitionBy("symbol", "blk").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    local = plan.select(
        "*", *[FOLD[op](F.when(known, F.col(x))).over(run).alias(f"_l_{n}") for n, (x, op) in scans.items()]
    )
    return local.join(carry, ["symbol", "blk"], "left").select(
        *plan.columns,
        *[MERGE[op](F.col(f"_c_{n}"), F.col(f"_l_{n}")).alias(n) for n, (_, op) in scans.items()],
    )
