"""PERFORM n TIMES and PERFORM UNTIL over the state that a record carries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from recordloom.session import cut

FIRST_TURNS = 16      # turns folded before the records that are done are set aside


def perform_times(count: Column | int, start: Column, turn: Callable[[Column], Column]) -> Column:
    """The state struct ``start`` after ``count`` turns, none if it is below one."""
    n = (count if isinstance(count, Column) else F.lit(count)).cast("int")
    turns = F.when(n >= 1, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(turns, start, lambda state, _: turn(state))


def perform_until(df: DataFrame, state: Column, until: Callable[[Column], Column], turn: Callable[[Column], Column],
                  name: str = "state", most_turns: int = 1 << 20) -> DataFrame:
    """``df`` with ``name``: the struct ``state`` after as many turns as ``until`` asks.

    The test comes before each turn. Records that are done are set aside and the
    others go on, twice as many turns each round; the rounds are kept on the
    shared folder. A record that is not done after ``most_turns`` is an error.
    """
    kind = df.select(state.alias(name)).schema[name].dataType.simpleString()      # without what it says of nulls
    waiting, done, turns, spent = df.withColumn(name, state.cast(kind)), None, FIRST_TURNS, 0
    while True:
        step = lambda s: F.when(F.coalesce(until(s), F.lit(False)), s).otherwise(turn(s)).cast(kind)
        waiting = cut(waiting.withColumn(name, perform_times(turns, F.col(name), step)))
        over = F.coalesce(until(F.col(name)), F.lit(False))
        ready, waiting = waiting.where(over), waiting.where(~over)
        done = ready if done is None else done.unionByName(ready)
        spent += turns
        if waiting.isEmpty():
            return done
        if spent >= most_turns:
            raise RuntimeError(f"records that are not done after {spent} turns")
        turns *= 2
