"""From touches to the stored player tables and what is read from them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.operators import events as ev
from touchline.operators import probability, state, summaries
from touchline.operators.documents import write_document
from touchline.sources.tables import materialise, write_table


@dataclass(frozen=True)
class PlayerTables:
    """Positions, counters and movements per player."""

    events: DataFrame
    positions: DataFrame

    @staticmethod
    def from_touches(touches: DataFrame, roster: DataFrame | None = None) -> PlayerTables:
        """All touches, and with a roster also those moved to imaginary games."""
        extra = None if roster is None else ev.remap_touches(touches, roster)
        events = ev.touch_events(touches, extra)
        return PlayerTables(events, ev.position_summary(events))

    def game_summary(self, event_grain: bool = False) -> DataFrame:
        return summaries.game_summary(self.events, self.positions, event_grain)

    def move_summary(self, fix_prev_y: bool = False) -> DataFrame:
        return summaries.move_summary(self.events, self.positions, fix_prev_y)

    def touches_summary(self) -> DataFrame:
        return summaries.touches_summary(materialise(self.game_summary()))

    def probability_bundle(self, teamid: int | None = None) -> DataFrame:
        return probability.probability_bundle(
            materialise(self.game_summary()), materialise(self.move_summary()), teamid
        )


def write_player_tables(
    touches: DataFrame, folder: str, roster: DataFrame | None = None
) -> None:
    """Write positions, game summary, move summary and cumulative state as tables."""
    spark = touches.sparkSession
    tables = PlayerTables.from_touches(touches, roster)
    write_table(tables.positions, f"{folder}/position_summary")
    positions = spark.read.parquet(f"{folder}/position_summary")
    stored = PlayerTables(tables.events, positions)
    write_table(stored.game_summary(), f"{folder}/game_summary")
    write_table(stored.move_summary(), f"{folder}/move_summary")
    summary = spark.read.parquet(f"{folder}/game_summary")
    write_table(summaries.touches_summary(summary), f"{folder}/touches_summary")


def write_probability_bundle(spark: SparkSession, folder: str, path: str, teamid: int) -> None:
    """Write a team's share tables, from the stored summaries, as one JSON document."""
    summary = spark.read.parquet(f"{folder}/game_summary")
    moves = spark.read.parquet(f"{folder}/move_summary")
    lines = probability.probability_bundle(summary, moves, teamid)
    write_document(lines, ["teamid"], ["playerid", *probability.ZONE], path)


def write_state_document(spark: SparkSession, folder: str, path: str, matchid: int) -> None:
    """Write a match's cumulative state, from the stored table, as one JSON document."""
    stored = spark.read.parquet(f"{folder}/touches_summary").filter(F.col("matchid") == matchid)
    order = ["teamid", "timestamp", "playerid", "position", "x", "y"]
    write_document(state.state_document(stored), ["matchid"], order, path)
