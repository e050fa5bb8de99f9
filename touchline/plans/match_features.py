"""From touches to match features.

Team totals and the team summary are stored once (one row per team and match) and
serve every later step.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from touchline import schema
from touchline.operators import history, match_stats
from touchline.sources.tables import materialise


@dataclass(frozen=True)
class MatchTables:
    """Match-level tables: games, team summary, scores, paired summary."""

    match_games: DataFrame
    summary: DataFrame
    goals: DataFrame
    paired: DataFrame

    @staticmethod
    def from_touches(touches: DataFrame, match_games: DataFrame) -> MatchTables:
        """Compute the summary and the score from the raw events.

        The totals per team are counted in one scan, the repeated events in a
        second one that reads two columns.
        """
        totals = materialise(match_stats.team_totals(touches))
        summary = match_stats.scale_ingested(
            match_stats.summary_of_totals(totals, match_games),
            match_stats.ingestion_multiplicity(touches),
        )
        goals = match_stats.final_scores(totals)
        return MatchTables.from_stored(materialise(summary), goals, match_games)

    @staticmethod
    def from_stored(
        summary: DataFrame, goals: DataFrame, match_games: DataFrame
    ) -> MatchTables:
        """Take the stored summary and score tables."""
        paired = history.team_game_op_summary(summary)
        return MatchTables(match_games, summary, goals, paired)

    def history(self, size: int) -> DataFrame:
        return history.history_features(self.match_games, self.paired, size)

    def history_with_goals(self, size: int) -> DataFrame:
        return history.history_features_with_goals(self.history(size), self.goals)


def get_features(tables: MatchTables, size: int) -> DataFrame:
    """Training features with outcomes, newest games first."""
    return history.newest_first(tables.history_with_goals(size))


def get_wc_features(
    tables: MatchTables, size: int, competition: int = schema.WORLD_CUP
) -> DataFrame:
    """Features of the world cup games, without outcomes, newest games first."""
    features = history.competition_features(tables.history(size), competition)
    return history.newest_first(features)


def get_game_summaries(tables: MatchTables) -> DataFrame:
    """The paired summaries, newest games first."""
    return history.newest_first(tables.paired)
