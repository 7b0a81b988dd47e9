"""Encode plans: validated chains of named stages, codecs by type, and two-pass rate control."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..operators.rate import recur

Stage = Callable[[DataFrame], DataFrame]


@dataclass
class Plan:
    """Stages applied in order; nothing runs until the result is asked for."""

    name: str
    stages: list[tuple[str, Stage]] = field(default_factory=list)
    needs: set[str] = field(default_factory=set)

    def then(self, name: str, stage: Stage) -> Plan:
        return Plan(self.name, [*self.stages, (name, stage)], self.needs)

    def problems(self, df: DataFrame) -> list[str]:
        """What keeps the plan from running on a table."""
        out = [f"column {c} is missing" for c in sorted(self.needs - set(df.columns))]
        names = [n for n, _ in self.stages]
        out += [f"stage {n} stands twice" for n in sorted({n for n in names if names.count(n) > 1})]
        return out + ([] if self.stages else ["the plan has no stage"])

    def run(self, df: DataFrame) -> DataFrame:
        if found := self.problems(df):
            raise ValueError(f"{self.name}: {'; '.join(found)}")
        for _, stage in self.stages:
            df = stage(df)
        return df


class Codecs:
    """Decoders by stream type; an unknown type is an error when it is asked for."""

    def __init__(self):
        self._by_type: dict[str, Callable[[Column], Column]] = {}

    def add(self, kind: str, decode: Callable[[Column], Column]) -> None:
        self._by_type[kind] = decode

    def decode(self, kind: str, payload: Column) -> Column:
        if kind not in self._by_type:
            raise ValueError(f"no codec for {kind}; known: {sorted(self._by_type)}")
        return self._by_type[kind](payload)


def two_pass_bits(frames: DataFrame, total_bits: int, clip: str = "clip", cost: str = "cost") -> DataFrame:
    """Bits of each frame in proportion to its cost within its clip, at least 1.

    Pass 1 sums the costs of each clip, pass 2 joins the sums back; both are one plan.
    """
    sums = frames.groupBy(clip).agg(F.sum(cost).alias("total"))
    share = F.floor(F.lit(total_bits).cast("long") * F.col(cost) / F.col("total")).cast("long")
    return frames.join(sums, clip).withColumn("bits", F.greatest(F.lit(1).cast("long"), share)).drop("total")


def reservoir_bits(frames: DataFrame, per_frame: int, delay: int, clip: str = "clip", order: str = "n", cost: str = "cost") -> DataFrame:
    """(clip, n, bits): bits of each frame under a reservoir of ``delay`` frames' worth, half full at first.

    Pass 1 sums what the next ``delay`` frames cost. Pass 2 goes through a clip: the bits that may be spent on those
    frames, so that the reservoir is half full behind them, are shared in proportion to cost; a frame gets one bit at least
    and never more than the reservoir holds, and what overflows is lost.
    """
    ahead = Window.partitionBy(clip).orderBy(order).rowsBetween(0, delay - 1)
    rows = frames.select(clip, order, F.col(cost).cast("long").alias("cost")).withColumn("ahead", F.sum("cost").over(ahead)).withColumn("frames", F.count("*").over(ahead))
    size = per_frame * delay

    def step(state, cost, ahead, n):
        held = (size // 2 if state is None else state) + per_frame
        spend = max(0, held + (n - 1) * per_frame - size // 2)
        bits = max(1, min(held, spend * cost // ahead if ahead else 0))
        return bits, min(size, held - bits)

    return recur(rows, clip, order, ["cost", "ahead", "frames"], "bits", step)


def profiled(df: DataFrame, **metrics: Column) -> tuple[DataFrame, Observation]:
    """The same rows, and metrics that are summed while they pass."""
    seen = Observation()
    return df.observe(seen, *(c.alias(k) for k, c in metrics.items())), seen
