"""The registered queries: one per operator, on tables derived from the given ones.

Raw events, and the tables that a run of the event jobs leaves behind (summaries,
features), are stored once per session; each query runs its operator on whole
tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, TimestampType

from touchline import schema
from touchline.functions.counters import COMPOSITES, counters, shot_outcomes
from touchline.functions.expressions import equals_integer, zone_x, zone_y
from touchline.operators import (
    documents,
    evaluation,
    events,
    history,
    match_stats,
    models,
    pairs,
    power,
    probability,
    scores,
    state,
    summaries,
)
from touchline.operators.lasso import LinearModel
from touchline.operators.ordered import exact_percentiles
from touchline.plans.match_features import (
    MatchTables,
    get_features,
    get_game_summaries,
    get_wc_features,
)
from touchline.plans.player_tables import PlayerTables
from touchline.plans.refresh import refresh_goals, store_goals
from touchline.sources import fixture, tables
from touchline.sources.tables import materialise

Query = Callable[[SparkSession, str], DataFrame]

HISTORY_SIZE = 10
SPLIT_SEED = 7

_tables: dict[tuple[str, str, str], object] = {}


class Inputs:
    """The input tables of one data folder; derived ones are stored on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def _once(self, name: str, build: Callable[[], object]):
        application = self.spark.sparkContext.applicationId
        key = (application, self.sf_dir, name)
        if key not in _tables:
            for ended in [k for k in _tables if k[0] != application]:
                del _tables[ended]
            _tables[key] = build()
        return _tables[key]

    def _stored(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        return self._once(name, lambda: materialise(build()))

    @property
    def touches(self) -> DataFrame:
        return fixture.touches(self.spark, self.sf_dir)

    @property
    def match_games(self) -> DataFrame:
        return fixture.match_games(self.spark, self.sf_dir)

    @property
    def matches(self) -> DataFrame:
        return fixture.matches(self.spark, self.sf_dir)

    @property
    def roster(self) -> DataFrame:
        return fixture.roster(self.spark, self.sf_dir)

    @property
    def home_advantage(self) -> DataFrame:
        return fixture.home_advantage(self.spark, self.sf_dir)

    @property
    def players(self) -> PlayerTables:
        return PlayerTables.from_touches(self.touches, self.roster)

    @property
    def match_tables(self) -> MatchTables:
        return self._once(
            "match tables", lambda: MatchTables.from_touches(self.touches, self.match_games)
        )

    @property
    def features(self) -> DataFrame:
        return self._stored(
            "features", lambda: self.match_tables.history_with_goals(HISTORY_SIZE)
        )

    @property
    def balanced(self) -> DataFrame:
        return pairs.drop_unbalanced_matches(self.features)

    @property
    def judged(self) -> DataFrame:
        """Features with a plain prediction: the share of points won so far."""
        return self.balanced.withColumn("predicted", F.col("avg_points") / 3)

    @property
    def game_summary(self) -> DataFrame:
        return self._stored("game summary", self.players.game_summary)

    @property
    def move_summary(self) -> DataFrame:
        return self._stored("move summary", self.players.move_summary)

    @property
    def outcome_summary(self) -> DataFrame:
        """The game summary with the counters of what became of shots."""
        return self._stored("outcome summary", lambda: summaries.game_summary(
            self.players.events, self.players.positions, extra=shot_outcomes()
        ))

    @property
    def state(self) -> DataFrame:
        return self._stored("state", lambda: summaries.touches_summary(self.game_summary))

    @property
    def scores(self) -> DataFrame:
        return scores.score_history(self.match_tables.goals, self.match_games)

    @property
    def own_goal_pairs(self) -> DataFrame:
        """Paired rows of which some lack the mirror row: own goals by credited team."""
        return match_stats.own_goal_credit(self.touches).withColumnsRenamed(
            {"credit_team": "teamid", "deduct_team": "op_teamid"}
        )

    @property
    def coefficients(self) -> DataFrame:
        """Stand-in coefficients: a team's mean points, centred."""
        mean = F.round(F.avg("points") - 1.4, 6).alias("coef")
        return self.features.groupBy("competitionid", "teamid").agg(mean)


def _comparable(frame: DataFrame) -> DataFrame:
    """Doubles to 6 decimals, times as seconds."""
    columns = []
    for field in frame.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, DoubleType):
            column = F.round(column, 6)
        elif isinstance(field.dataType, TimestampType):
            column = F.unix_seconds(column)
        columns.append(column.alias(field.name))
    return frame.select(*columns)


FEATURE_NUMBERS = ["is_home", *history.HISTORY]
GOAL_FEATURES = ["is_home", "avg_goals", "op_avg_goals", "expected_goals", "shots"]


def _won():
    return F.col("points") == 3


def _counter_totals(t: Inputs) -> DataFrame:
    names = [*COMPOSITES, *[counter.name for counter in counters()]]
    summary = t.players.game_summary()
    return summary.groupBy("matchid", "teamid").agg(*[F.sum(n).alias(n) for n in names])


def _countable(t: Inputs) -> DataFrame:
    rows = summaries.countable_rows(t.players.events)
    return rows.groupBy("matchid", "typeid", "type").agg(F.count("*").alias("rows_counted"))


def _zones(t: Inputs) -> DataFrame:
    zones = [zone_x(F.col("x")).alias("section_x"), zone_y(F.col("y")).alias("section_y")]
    return t.touches.groupBy(*zones).agg(F.count("*").alias("touches"))


def _bundle_rows(t: Inputs) -> DataFrame:
    """The JSON documents of all teams, parsed back into values."""
    lines = probability.probability_bundle(t.game_summary, t.move_summary)
    names = F.array(*[F.lit(name) for name in probability.BUNDLE])
    row = F.from_json(F.regexp_replace("value", "^,", ""), "map<string,double>")
    ids = ("playerid", *probability.ZONE)
    return (
        lines.filter(F.col("part") == documents.ROW)
        .select(
            "teamid", names[F.col("table")].alias("table_name"), *ids,
            F.explode(row).alias("measure", "value"),
        )
        .filter(~F.col("measure").isin(*ids))
    )


def _state_rows(t: Inputs) -> DataFrame:
    """The JSON documents of all matches, parsed back into rows."""
    stored = t.state
    types = dict(stored.dtypes)
    row_schema = ", ".join(f"`{name}` {types[name]}" for name in state.STATE_COLUMNS)
    text = F.regexp_replace("value", "^,", "")
    lines = state.state_document(stored).filter(F.col("part") == documents.ROW)
    return lines.select(F.from_json(text, f"{row_schema}, copies bigint").alias("row")).select("row.*")


def _thresholds(t: Inputs) -> DataFrame:
    return scores.event_cdf(t.outcome_summary).select(
        "playerid", "section", F.posexplode("thresholds").alias("transition", "threshold")
    )


def _split(t: Inputs) -> DataFrame:
    train, test = pairs.split(t.balanced, seed=SPLIT_SEED)
    return train.select(*pairs.KEYS, F.lit(True).alias("is_train")).unionByName(
        test.select(*pairs.KEYS, F.lit(False).alias("is_train"))
    )


def _splice(t: Inputs) -> DataFrame:
    rows = t.balanced.select(*pairs.KEYS, *FEATURE_NUMBERS)
    return pairs.splice(rows, FEATURE_NUMBERS)


def _trained(t: Inputs) -> tuple[models.WinModel, DataFrame]:
    return t._once("win model", lambda: models.train_model(t.features, seed=SPLIT_SEED))


def _four_decimals(name: str) -> Column:
    return (F.round(name, 4) + F.lit(0.0)).alias(name)


def _coefficients(t: Inputs, model: LinearModel) -> DataFrame:
    rows = t.spark.createDataFrame(models.coefficients(model), "feature string, coefficient double")
    return rows.select("feature", _four_decimals("coefficient"))


def _win_coefficients(t: Inputs) -> DataFrame:
    return _coefficients(t, _trained(t)[0].model)


def _poisson(t: Inputs) -> DataFrame:
    scored = match_stats.raw_goals(t.touches).select(
        *match_stats.TEAM, F.col("goals").cast("double").alias("scored")
    )
    rows = t.balanced.join(scored, match_stats.TEAM)
    return _coefficients(t, models.build_model_poisson(rows, F.col("scored"), GOAL_FEATURES))


def _predictions(t: Inputs) -> DataFrame:
    model, test = _trained(t)
    return models.predict_model(model, test).select(
        *pairs.KEYS, "points", _four_decimals("predicted")
    )


def _ranked(t: Inputs) -> DataFrame:
    return power.power_map(power.build_team_matrix(t.balanced, "points"), lambda c: c > 0)


def _with_power(t: Inputs) -> DataFrame:
    return power.add_power(t.balanced, t.balanced, [("points", lambda c: c > 0, "points")])


def _new_path(t: Inputs, name: str) -> str:
    return f"{tables.run_folder(t.spark)}/{name}-{uuid.uuid4().hex}"


def _through_csv(t: Inputs) -> DataFrame:
    teams = t.match_games.select(F.col("team_name").alias("Team"), "teamid").distinct()
    rows = teams.join(t.home_advantage, "teamid").selectExpr(
        "Team", "CAST(teamid * 7 % 1000 AS INT) power_ranking", "CAST(teamid AS INT) teamid", "is_home"
    )
    path = _new_path(t, "csv")
    rows.write.csv(path, header=True)
    return tables.read_home_advantage(t.spark, path)


def _through_table(t: Inputs) -> DataFrame:
    path = _new_path(t, "table")
    tables.write_table(t.match_games.limit(1), path)
    tables.write_table(t.match_games, path)  # replaces the first one
    return tables.read_table(t.spark, path)


def _through_view(t: Inputs) -> DataFrame:
    name = f"match_games_{uuid.uuid4().hex}"
    tables.create_view(t.match_games, name)
    return tables.read_table(t.spark, name)


def _through_dataset(t: Inputs) -> DataFrame:
    dataset = f"touchline_{uuid.uuid4().hex}"
    tables.create_dataset(t.spark, dataset)
    tables.write_table(t.match_games, f"{dataset}.match_games")
    return tables.read_table(t.spark, f"{dataset}.match_games")


def _changed_matches(t: Inputs) -> DataFrame:
    """Goals per match stored with part of the goals missing, then refreshed for the matches concerned."""
    late = F.col("matchid").cast("bigint") % 20 == 0
    path = _new_path(t, "goals")
    early = t.touches.filter(~(late & (F.col("typeid") == schema.GOAL)))
    store_goals(early, t.match_games, path)
    refresh_goals(t.touches, t.match_games, t.match_games.filter(late).select("matchid"), path)
    return tables.read_table(t.spark, path).select("matchid", "teamid", "goals", "competitionid", "seasonid")


def _through_catalog_view(t: Inputs) -> DataFrame:
    dataset = f"touchline_{uuid.uuid4().hex}"
    tables.create_dataset(t.spark, dataset)
    tables.write_table(t.match_games, f"{dataset}.match_games")
    tables.create_view(t.match_games, f"temporary_{dataset}")
    select = f"SELECT matchid, teamid, team_name, timestamp FROM {dataset}.match_games"
    for condition in ("is_home = 0", "is_home = 1"):  # the second one replaces the first
        view = tables.create_catalog_view(t.spark, dataset, "home_games", f"{select} WHERE {condition}")
    t.spark.catalog.dropTempView(f"temporary_{dataset}")
    return tables.read_table(t.spark, view)


def _player_documents(t: Inputs) -> DataFrame:
    """Player documents written as JSON lines, read back with the declared schema."""
    path = _new_path(t, "players")
    tables.write_json(scores.player_models(t.outcome_summary, t.move_summary, t.players.positions), path)
    models, _ = tables.split_broken(tables.read_player_models(t.spark, path, one_per_file=False))
    return scores.model_thresholds(models)


def _team_documents(t: Inputs) -> DataFrame:
    """The documents of all teams, written by one job and read back row by row."""
    path = _new_path(t, "documents")
    order = ["playerid", *probability.ZONE]
    lines = probability.probability_bundle(t.game_summary, t.move_summary)
    documents.write_documents(lines, "teamid", order, path)
    row = F.from_json("value", "map<string,double>")
    ids = [row[c].cast("bigint" if c == "playerid" else "int").alias(c) for c in order]
    found = documents.read_documents(t.spark, path, "teamid").select(
        F.col("teamid").cast("bigint").alias("teamid"), F.col("table").alias("table_name"), *ids,
        F.explode(row).alias("measure", "value"),
    )
    return found.filter(~F.col("measure").isin(*order))


def _tied_games(t: Inputs) -> DataFrame:
    """Match games with kick-offs moved to the start of their 30 days, so that many tie."""
    return t.match_games.withColumn("timestamp", F.timestamp_seconds(
        F.floor(F.unix_seconds("timestamp") / 2592000) * 2592000
    ))


def _requests(t: Inputs) -> DataFrame:
    """Three times for every match, and 200 for one."""
    matches = t.match_games.select("matchid").distinct().select(F.col("matchid").cast("bigint").alias("matchid"))
    share = F.col("matchid") % 100 / 100.0
    few = matches.select("matchid", F.explode(F.array(F.lit(0.25), F.lit(0.5), share)).alias("at"))
    hot = matches.agg(F.min("matchid").alias("matchid"))
    many = hot.select("matchid", F.explode(F.sequence(F.lit(0), F.lit(199))).alias("k"))
    return few.union(many.select("matchid", F.col("k") / 200.0))


def _percentiles(t: Inputs) -> DataFrame:
    return exact_percentiles(t.touches, ["typeid"], "x", [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0])


def _table(name: str) -> Callable[[Inputs], DataFrame]:
    return lambda t: probability.probability(t.game_summary, name)


_QUERIES: dict[str, Callable[[Inputs], DataFrame]] = {
    # tables
    "s3_csv": _through_csv,
    "s4_replaced_table": _through_table,
    "s4_replaced_matches": _changed_matches,
    "s5_view": _through_view,
    "s5_catalog_view": _through_catalog_view,
    "s6_dataset": _through_dataset,
    "s8_documents": _team_documents,
    "s9_player_models": _player_documents,
    # event preparation
    "p1_remap_touches": lambda t: events.explode_qualifiers(
        events.remap_touches(t.touches, t.roster)
    ),
    "p2_touches_view": lambda t: events.touches_view(
        t.touches, events.remap_touches(t.touches, t.roster)
    ),
    "p3_position_summary": lambda t: t.players.positions,
    "p4_game_summary": lambda t: t.players.game_summary(),
    "p4_game_summary_event_grain": lambda t: t.players.game_summary(event_grain=True),
    "p5_move_summary": lambda t: t.players.move_summary(),
    "p5_move_summary_fixed": lambda t: t.players.move_summary(fix_prev_y=True),
    "p6_touches_summary": lambda t: t.players.touches_summary(),
    "p7_ingested_leagues": lambda t: events.ingested_leagues(t.matches),
    "c1_c37_counter_totals": _counter_totals,
    "c38_zones": _zones,
    "c39_c40_countable_rows": _countable,
    # match statistics
    "p8_expected_goals": lambda t: match_stats.expected_goals(t.touches),
    "p9_pass_stats": lambda t: match_stats.pass_stats(t.touches),
    "p10a_own_goals_by_team": lambda t: match_stats.own_goals_by_team(t.touches),
    "p10b_own_goal_credit": lambda t: match_stats.own_goal_credit(t.touches),
    "p10c_raw_goals": lambda t: match_stats.raw_goals(t.touches),
    "p11_match_goals": lambda t: match_stats.match_goals(t.touches),
    "p12_team_game_summary": lambda t: match_stats.team_game_summary(t.touches, t.match_games),
    "p13_team_game_summary_corrected": lambda t: match_stats.team_game_summary_corrected(
        t.touches, t.match_games
    ),
    "p14_team_stats_stored": lambda t: match_stats.team_stats(
        t.match_games, stored=t.match_tables.summary
    ),
    # rolling history
    "p15_feature_columns": lambda t: t.features.select(
        *match_stats.get_feature_columns(t.features.columns)
    ),
    "p16a_games_with_stats": lambda t: history.games_with_stats(
        t.match_games, t.match_tables.summary
    ),
    "p16b_match_history": lambda t: history.match_history(
        t.match_games, t.match_tables.summary, HISTORY_SIZE
    ),
    "p16b_history_range": lambda t: history.match_history_range(
        _tied_games(t), t.match_tables.summary, HISTORY_SIZE
    ),
    "p17_team_game_op_summary": lambda t: t.match_tables.paired,
    "p18a_history_features": lambda t: t.match_tables.history(HISTORY_SIZE),
    "p18b_history_features_with_goals": lambda t: t.match_tables.history_with_goals(HISTORY_SIZE),
    "p18c_wc_history_features": lambda t: get_wc_features(t.match_tables, HISTORY_SIZE),
    "p18d_get_features": lambda t: get_features(t.match_tables, HISTORY_SIZE),
    "p18d_get_game_summaries": lambda t: get_game_summaries(t.match_tables),
    # probability tables and state
    "p19_shot_probability": _table("shot"),
    "p20_move_probability": lambda t: probability.move_probability(t.move_summary),
    "p21_pass_probability": _table("pass"),
    "p22_save_probability": _table("save"),
    "p23_intercept_probability": _table("intercept"),
    "p24_tackle_probability": _table("tackle"),
    "p25_foul_probability": _table("foul"),
    "p26_out_probability": _table("out"),
    "p27_defense_probability": _table("defense"),
    "p27_offense_probability": _table("offense"),
    "p28_probability_bundle": _bundle_rows,
    "p29_player_state_asof": lambda t: state.player_state_asof(t.state, 0.5),
    "p29_state_requests": lambda t: state.state_requests(t.state, _requests(t)),
    "p30_state_summary": lambda t: state.state_summary(t.state),
    "p30_state_document": _state_rows,
    "p31_pass_by_position": lambda t: probability.probability(
        t.game_summary, "pass", probability.POSITION
    ),
    "p31_move_by_position": lambda t: probability.move_probability(
        t.move_summary, probability.POSITION
    ),
    "p31_pass_by_player_position": lambda t: probability.probability(
        t.game_summary, "pass", probability.PLAYER_POSITION
    ),
    "p31_pass_with_fallback": lambda t: probability.with_position_fallback(
        t.game_summary, "pass"
    ),
    "p31_pass_thin": lambda t: probability.thin_probability(t.game_summary, "pass", least=37),
    "a10_percentiles": _percentiles,
    # paired rows
    "m1_drop_unbalanced_matches": lambda t: t.balanced,
    "m1_drop_unbalanced_own_goals": lambda t: pairs.drop_unbalanced_matches(t.own_goal_pairs),
    "m2_check_data": lambda t: pairs.check_data(t.own_goal_pairs),
    "m3_prepare_data": lambda t: pairs.prepare_data(t.features),
    "m4_split": _split,
    "m5_extract_target": lambda t: pairs.extract_target(t.balanced, "points")[0],
    "m6_clone_and_drop": lambda t: pairs.clone_and_drop(
        t.balanced,
        ["competitionid", "seasonid", "is_home", "team_name", "op_team_name", "timestamp",
         "goals", "op_goals", "points", "no such column"],
    ),
    "m7_standardize": lambda t: pairs.standardize(
        t.balanced.select(*pairs.KEYS, *FEATURE_NUMBERS), FEATURE_NUMBERS
    ),
    "m8_splice": _splice,
    "m9_train_model": _win_coefficients,
    "m10_build_model_poisson": _poisson,
    "m11_predict_model": _predictions,
    "m12_validate": lambda t: evaluation.validate(
        "mean points", t.judged, _won(), "predicted", baseline=0.4
    ),
    "m12_validate_with_auc": lambda t: evaluation.validate(
        "mean points", t.judged, _won(), "predicted", baseline=0.4, compute_auc=True
    ).select("tp", "fp", "auc"),
    "m13_roc": lambda t: evaluation.roc_points(t.judged, _won(), "predicted"),
    "m13_auc": lambda t: evaluation.auc(t.judged, _won(), "predicted"),
    "m14_extract_predictions": lambda t: pairs.extract_predictions(t.judged),
    "m15_normalize": lambda t: pairs.normalize(
        t.match_tables.goals.select("matchid", "teamid", "goals"), "goals", "share"
    ),
    "m16_games": lambda t: pairs.games(t.balanced),
    "m17_check_eq": lambda t: t.features.select(
        *pairs.KEYS, equals_integer(3)(F.col("points")).alias("won")
    ),
    "m18_build_team_matrix": lambda t: power.build_team_matrix(t.balanced, "points"),
    "m19_build_power": lambda t: power.build_power(t.coefficients),
    "m19_build_power_unsnapped": lambda t: power.build_power(t.coefficients, snap=False),
    "m20_power_map": _ranked,
    "m21_with_power": lambda t: power.with_power(
        t.features, power.build_power(t.coefficients), "points"
    ),
    "m21_add_power": _with_power,
    "m22_home_advantage": lambda t: pairs.apply_home_advantage(t.match_games, t.home_advantage),
    # score history
    "h1_outcome_counts": lambda t: scores.outcome_counts(t.scores),
    "h2_goal_distribution": lambda t: scores.goal_distribution(t.scores),
    "h3_win_probability": lambda t: scores.win_probability(t.scores),
    "h4_event_cdf": _thresholds,
}


def _registered(run: Callable[[Inputs], DataFrame]) -> Query:
    return lambda spark, sf_dir: _comparable(run(Inputs(spark, sf_dir)))


def queries() -> dict[str, Query]:
    return {name: _registered(run) for name, run in _QUERIES.items()}
