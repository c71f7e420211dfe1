"""Named operators and readers, so that a configuration can say which to apply."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Operator = Callable[..., DataFrame]


class Registry:
    """Functions by name; a name is taken once."""

    def __init__(self, kind: str):
        self.kind = kind
        self.known: dict[str, Operator] = {}

    def register(self, name: str) -> Callable[[Operator], Operator]:
        def keep(function: Operator) -> Operator:
            if name in self.known:
                raise ValueError(f"{self.kind} {name} is there")
            self.known[name] = function
            return function

        return keep

    def __getitem__(self, name: str) -> Operator:
        if name not in self.known:
            raise KeyError(f"no {self.kind} {name}; there are {', '.join(sorted(self.known))}")
        return self.known[name]


FILTERS = Registry("filter")
READERS = Registry("reader")


def filtered(df: DataFrame, steps: list[dict]) -> DataFrame:
    """``df`` through the named filters in turn, each with its own arguments."""
    for step in steps:
        own = dict(step)
        df = FILTERS[own.pop("name")](df, **own)
    return df


def read(spark: SparkSession, name: str, **arguments) -> DataFrame:
    return READERS[name](spark, **arguments)


@FILTERS.register("object_types")
def object_types(df: DataFrame, types: list[str]) -> DataFrame:
    """Rows of the allowed types."""
    return df.where(df["object_type"].isin(types))


@FILTERS.register("valid_at")
def valid_at(df: DataFrame, t: int) -> DataFrame:
    """Agents that are valid at a step, with all their rows."""
    from scenelake.operators.kinematics import AGENT

    now = df.where((df["t"] == t) & df["valid"]).select(*AGENT).distinct()
    return df.join(now, AGENT, "left_semi")


def _readers() -> None:
    from scenelake.sources import records, scenarios

    READERS.register("scenarios")(scenarios.read)
    READERS.register("records")(records.read_records)


_readers()
