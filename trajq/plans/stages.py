"""Chains of table functions with their inverses."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

Step = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Stages:
    """Forward steps in order and the inverse steps that undo them.

    A pushed group runs after the forward steps and before the inverse ones, so outputs undo
    inputs from the inside out. The usual order is repack, data, normalize, model.
    """

    forward: tuple[Step, ...] = ()
    inverse: tuple[Step, ...] = ()

    def push(self, forward: tuple[Step, ...] = (), inverse: tuple[Step, ...] = ()) -> Stages:
        return Stages((*self.forward, *forward), (*inverse, *self.inverse))

    def apply(self, df: DataFrame) -> DataFrame:
        for step in self.forward:
            df = df.transform(step)
        return df

    def undo(self, df: DataFrame) -> DataFrame:
        for step in self.inverse:
            df = df.transform(step)
        return df
