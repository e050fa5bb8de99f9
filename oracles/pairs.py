"""Paired-row operators, evaluation and power rankings."""

from oracles.features import FEATURES, GAME, HISTORY
from oracles.lasso import MEAN, fit
from oracles.sql import big, rounded, rounded_all

_NUMBERS = ["is_home", *HISTORY]
_SPLICED = [name for name in _NUMBERS if name != "is_home"]
_PAIR_KEYS = "matchid, teamid, op_teamid"
_FIRST = "PARTITION BY matchid ORDER BY is_home, teamid"
_OUTCOMES = f"{GAME}, goals, op_goals, points"


def _scaled(name: str) -> str:
    return (
        f"CASE WHEN ABS(std_{name}) > 0.001 THEN (b.{name} - mean_{name}) / std_{name}"
        f" ELSE b.{name} END"
    )


def _design(rows: str) -> str:
    """Standardised rows of both sides as one list: own features, the opponent's, 1."""
    moments = ", ".join(f"AVG({n}) AS mean_{n}, STDDEV_POP({n}) AS std_{n}" for n in _NUMBERS)
    scaled = ", ".join(f"{_scaled(n)} AS {n}" for n in _NUMBERS)
    own = ", ".join(f"CAST(a.{n} AS DOUBLE)" for n in _NUMBERS)
    other = ", ".join(f"CAST(o.{n} AS DOUBLE)" for n in _SPLICED)
    return f"""
        WITH m AS (SELECT {moments} FROM {rows}),
             z AS (SELECT b.matchid, b.teamid, b.op_teamid, b.points, {scaled} FROM {rows} b, m)
        SELECT 1 AS g, a.matchid || '/' || a.teamid AS r, a.matchid, a.teamid, a.op_teamid, a.points,
               [{own}, {other}, CAST(1 AS DOUBLE)] AS x, CASE WHEN a.points = 3 THEN 1 ELSE 0 END AS y
        FROM z a JOIN z o ON a.matchid = o.matchid AND a.teamid <> o.teamid"""


def _named(fitted: str, names: list[str]) -> str:
    listed = ", ".join(f"'{n}'" for n in [*names, "intercept"])
    return f"""
        SELECT [{listed}][i] AS feature, ROUND(c, 4) + CAST(0 AS DOUBLE) AS coefficient
        FROM (SELECT unnest(w) AS c, generate_subscripts(w, 1) AS i FROM {fitted})"""


_WIN_COLUMNS = [*_NUMBERS, *[f"opp_{name}" for name in _SPLICED]]
_GOAL_FEATURES = ["is_home", "avg_goals", "op_avg_goals", "expected_goals", "shots"]
_DIGEST = "CAST('0x' || SUBSTR(MD5('7:' || matchid), 1, 8) AS UBIGINT)"
_TRAINS = f"{_DIGEST} / CAST(4294967296 AS DOUBLE) > 0.4"


def _power_of(fitted: str, name: str) -> dict[str, str]:
    """Rankings from fitted coefficients, teams in the order of their ids."""
    return {
        f"strength_{name}": f"""
            SELECT g AS competitionid, t.teamid, EXP(w[t.place]) AS s
            FROM {fitted} JOIN team_place t ON t.competitionid = g WHERE EXP(w[t.place]) <> 1""",
        f"ranking_{name}": f"""
            SELECT p.competitionid, p.teamid,
                   CASE WHEN cut[1] > power THEN 0.0 WHEN cut[2] > power THEN 0.25 WHEN cut[3] > power THEN 0.5
                        WHEN cut[4] > power THEN 0.75 ELSE 1.0 END AS power
            FROM (SELECT *, (s - MIN(s) OVER c) / (MAX(s) OVER c - MIN(s) OVER c) AS power
                  FROM strength_{name} WINDOW c AS (PARTITION BY competitionid)
                  QUALIFY MAX(s) OVER c - MIN(s) OVER c >= CAST(0.0001 AS DOUBLE)) p
            JOIN (SELECT competitionid, [QUANTILE_CONT(power, 0.2), QUANTILE_CONT(power, 0.4),
                                         QUANTILE_CONT(power, 0.6), QUANTILE_CONT(power, 0.8)] AS cut
                  FROM (SELECT competitionid, (s - MIN(s) OVER c) / NULLIF(MAX(s) OVER c - MIN(s) OVER c, 0) AS power
                        FROM strength_{name} WINDOW c AS (PARTITION BY competitionid)) GROUP BY competitionid) q
              ON p.competitionid = q.competitionid""",
    }


CTES = {
    # matches of one team only are unbalanced, as are those with a NULL
    "complete_row": "SELECT * FROM features WHERE "
    + " AND ".join(f"{name} IS NOT NULL" for name in (*HISTORY, "goals", "op_goals")),
    "balanced": """
        SELECT * FROM complete_row WHERE matchid IN
          (SELECT matchid FROM complete_row GROUP BY matchid HAVING COUNT(*) = 2)""",
    "own_goal_pair": """
        SELECT matchid, credit_team AS teamid, deduct_team AS op_teamid, cnt
        FROM own_goal_moved""",
    "moment": "SELECT "
    + ", ".join(
        f"AVG({name}) AS mean_{name}, STDDEV_POP({name}) AS std_{name}" for name in _NUMBERS
    )
    + " FROM balanced",
    "judged": """
        SELECT *, avg_points / 3 AS predicted, points = 3 AS won FROM balanced""",
    "ranked": """
        SELECT won, predicted, COUNT(*) OVER () AS n,
               ROW_NUMBER() OVER (ORDER BY predicted DESC, matchid, teamid) - 1 AS place
        FROM judged""",
    "confusion": """
        SELECT SUM(CASE WHEN won AND guess THEN 1 ELSE 0 END) AS tp,
               SUM(CASE WHEN NOT won AND NOT guess THEN 1 ELSE 0 END) AS tn,
               SUM(CASE WHEN NOT won AND guess THEN 1 ELSE 0 END) AS fp,
               SUM(CASE WHEN won AND NOT guess THEN 1 ELSE 0 END) AS fn, COUNT(*) AS n
        FROM (SELECT won, n, CASE WHEN predicted = 0 THEN FALSE WHEN predicted = 1 THEN TRUE
                     ELSE place < n * CAST(0.4 AS DOUBLE) END AS guess FROM ranked) g""",
    "roc": """
        SELECT d.predicted AS threshold,
               SUM(CASE WHEN j.won THEN 1 ELSE 0 END) AS tp,
               SUM(CASE WHEN j.won THEN 0 ELSE 1 END) AS fp
        FROM (SELECT DISTINCT predicted FROM judged) d JOIN judged j ON j.predicted >= d.predicted
        GROUP BY d.predicted""",
    "side": f"SELECT *, ROW_NUMBER() OVER ({_FIRST}) AS place_in_match FROM balanced",
    "game_pair": """
        SELECT a.competitionid, a.matchid, a.seasonid, a.timestamp, a.teamid AS first_team,
               b.teamid AS second_team, a.is_home AS first_home, b.is_home AS second_home,
               a.points - b.points AS result
        FROM side a JOIN side b ON a.matchid = b.matchid
        WHERE a.place_in_match = 1 AND b.place_in_match = 2""",
    "season_step": """
        SELECT *, CASE WHEN seasonid IS DISTINCT FROM LAG(seasonid) OVER (
                 PARTITION BY competitionid ORDER BY timestamp DESC, matchid)
               THEN 1 ELSE 0 END AS changed
        FROM game_pair""",
    "discounted": """
        SELECT *, POWER(CAST(0.9 AS DOUBLE), SUM(changed) OVER (
                 PARTITION BY competitionid ORDER BY timestamp DESC, matchid
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS discount
        FROM season_step""",
    # a stand-in for fitted coefficients: mean points of a team, centred
    "coefficient": """
        SELECT competitionid, teamid, ROUND(AVG(points) - 1.4, 6) AS coef FROM features
        GROUP BY competitionid, teamid""",
    "strength": """
        SELECT competitionid, teamid, EXP(coef) AS s FROM coefficient WHERE EXP(coef) <> 1""",
    "scaled_strength": """
        SELECT s.competitionid, s.teamid, (s - low) / spread AS power
        FROM strength s JOIN (SELECT competitionid, MIN(s) AS low, MAX(s) - MIN(s) AS spread
                              FROM strength GROUP BY competitionid) b
          ON s.competitionid = b.competitionid
        WHERE spread >= CAST(0.0001 AS DOUBLE)""",
    "power_step": """
        SELECT p.competitionid, p.teamid,
               CASE WHEN c1 > power THEN 0.0 WHEN c2 > power THEN 0.25 WHEN c3 > power THEN 0.5
                    WHEN c4 > power THEN 0.75 ELSE 1.0 END AS power
        FROM scaled_strength p JOIN (
          SELECT competitionid, QUANTILE_CONT(power, 0.2) AS c1, QUANTILE_CONT(power, 0.4) AS c2,
                 QUANTILE_CONT(power, 0.6) AS c3, QUANTILE_CONT(power, 0.8) AS c4
          FROM scaled_strength GROUP BY competitionid) q ON p.competitionid = q.competitionid""",
    # fits
    "train_row": f"SELECT * FROM balanced WHERE {_TRAINS}",
    "test_row": f"SELECT * FROM balanced WHERE NOT ({_TRAINS})",
    "win_design": _design("train_row"),
    "win_asked": _design("test_row"),
    **fit("win_fit", "win_design", "logistic", 8.0),
    "goal_design": "SELECT 1 AS g, b.matchid || '/' || b.teamid AS r, CAST(s.goals AS DOUBLE) AS y, ["
    + ", ".join(f"CAST(b.{n} AS DOUBLE)" for n in _GOAL_FEATURES)
    + """, CAST(1 AS DOUBLE)] AS x
        FROM balanced b JOIN raw_score s ON b.matchid = s.matchid AND b.teamid = s.teamid""",
    **fit("goal_fit", "goal_design", "poisson", 4.0),
    "team_place": """
        SELECT competitionid, teamid, ROW_NUMBER() OVER (PARTITION BY competitionid ORDER BY teamid) AS place
        FROM (SELECT competitionid, first_team AS teamid FROM game_pair
              UNION SELECT competitionid, second_team FROM game_pair)""",
    "game_design": """
        SELECT competitionid AS g, matchid AS r, CASE WHEN result > 0 THEN 1 ELSE 0 END AS y,
               list(CASE teamid WHEN first_team THEN (1 + first_home * 0.25) / discount
                                WHEN second_team THEN -(1 + second_home * 0.25) / discount
                                ELSE CAST(0 AS DOUBLE) END ORDER BY place) || [CAST(1 AS DOUBLE)] AS x
        FROM discounted JOIN team_place USING (competitionid) GROUP BY ALL""",
    **fit("power_fit_a", "game_design", "logistic", 0.5, steps=10, updates=3000),
    **fit("power_fit_b", "game_design", "logistic", 0.25, steps=10, updates=3000),
    **fit("power_fit_c", "game_design", "logistic", 0.125, steps=10, updates=3000),
    **_power_of("power_fit_a", "a"),
    **_power_of("power_fit_b", "b"),
    **_power_of("power_fit_c", "c"),
    "ranking": """
        SELECT * FROM ranking_a
        UNION ALL SELECT * FROM ranking_b WHERE competitionid NOT IN (SELECT competitionid FROM ranking_a)
        UNION ALL SELECT * FROM ranking_c WHERE competitionid NOT IN (SELECT competitionid FROM ranking_a)
          AND competitionid NOT IN (SELECT competitionid FROM ranking_b)""",
    "balanced_order": """
        SELECT competitionid, ROW_NUMBER() OVER (ORDER BY t DESC, m, h) AS nth FROM (
          SELECT competitionid, timestamp AS t, matchid AS m, is_home AS h,
                 ROW_NUMBER() OVER (PARTITION BY competitionid
                   ORDER BY timestamp DESC, matchid, is_home) AS rn FROM balanced) f
        WHERE rn = 1""",
    "ranked_team": """
        SELECT teamid, power FROM ranking JOIN balanced_order USING (competitionid)
        QUALIFY ROW_NUMBER() OVER (PARTITION BY teamid ORDER BY nth DESC) = 1""",
    "competition_order": """
        SELECT competitionid, ROW_NUMBER() OVER (ORDER BY t DESC, m, h) AS nth FROM (
          SELECT competitionid, timestamp AS t, matchid AS m, is_home AS h,
                 ROW_NUMBER() OVER (PARTITION BY competitionid
                   ORDER BY timestamp DESC, matchid, is_home) AS rn FROM features) f
        WHERE rn = 1""",
    "power_of_team": """
        SELECT teamid, power FROM (
          SELECT teamid, power, ROW_NUMBER() OVER (PARTITION BY teamid ORDER BY nth DESC) AS rn
          FROM power_step p JOIN competition_order o ON p.competitionid = o.competitionid) x
        WHERE rn = 1""",
}

QUERIES = {
    "m9_train_model": _named("win_fit", _WIN_COLUMNS),
    "m10_build_model_poisson": _named("goal_fit", _GOAL_FEATURES),
    "m11_predict_model": f"""
        SELECT matchid, teamid, op_teamid, points, ROUND(mu, 4) + CAST(0 AS DOUBLE) AS predicted
        FROM (SELECT *, {MEAN["logistic"]} AS mu
              FROM (SELECT a.*, list_dot_product(x, w) AS eta FROM win_asked a JOIN win_fit USING (g)))""",
    "m20_power_map": "SELECT competitionid, teamid, CAST(power AS DOUBLE) AS power FROM ranking",
    "m21_add_power": f"""
        SELECT {_OUTCOMES}, {rounded_all(HISTORY)}, CAST(COALESCE(p.power, 0.5) AS DOUBLE) AS power_points
        FROM balanced LEFT JOIN ranked_team p USING (teamid)""",
    "m1_drop_unbalanced_matches": f"SELECT {FEATURES} FROM balanced",
    "m1_drop_unbalanced_own_goals": """
        SELECT matchid, teamid, op_teamid, cnt FROM own_goal_pair WHERE matchid IN
          (SELECT matchid FROM own_goal_pair GROUP BY matchid HAVING COUNT(*) = 2)""",
    "m2_check_data": f"""
        SELECT {_PAIR_KEYS} FROM own_goal_pair f WHERE NOT EXISTS (
          SELECT 1 FROM own_goal_pair g WHERE g.matchid = f.matchid
             AND g.teamid = f.op_teamid AND g.op_teamid = f.teamid)""",
    "m3_prepare_data": f"SELECT {FEATURES} FROM balanced",
    "m4_split": f"""
        SELECT {_PAIR_KEYS}, {_TRAINS} AS is_train
        FROM balanced""",
    "m5_extract_target": f"SELECT {_PAIR_KEYS}, points FROM balanced",
    "m6_clone_and_drop": f"SELECT {_PAIR_KEYS}, {rounded_all(HISTORY)} FROM balanced",
    "m7_standardize": f"SELECT {_PAIR_KEYS}, "
    + ", ".join(rounded(_scaled(name), name) for name in _NUMBERS)
    + " FROM balanced b, moment",
    "m8_splice": "SELECT a.matchid, a.teamid, a.op_teamid, a.is_home, "
    + rounded_all(HISTORY, "a.")
    + ", "
    + ", ".join(rounded(f"b.{name}", f"opp_{name}") for name in _SPLICED)
    + """ FROM balanced a JOIN balanced b
          ON a.matchid = b.matchid AND a.teamid <> b.teamid""",
    "m12_validate": f"""
        SELECT 'mean points' AS label, {big("tp", "tp")}, {big("tn", "tn")}, {big("fp", "fp")},
               {big("fn", "fn")}, {big("tp + fn", "positives")}, {big("tn + fp", "negatives")},
               n AS rows, CAST(0.4 AS DOUBLE) AS baseline,
               {rounded("COALESCE(tp / NULLIF(CAST(tp + fp AS DOUBLE), 0), -1)", "p1_t")},
               {rounded("COALESCE(tn / NULLIF(CAST(tn + fn AS DOUBLE), 0), -1)", "p0_f")},
               {rounded("COALESCE(tp / NULLIF(CAST(tp + fp AS DOUBLE), 0), -1) / ((tp + fn) / CAST(n AS DOUBLE))", "lift")},
               {rounded("(tp + tn) / CAST(n AS DOUBLE)", "accuracy")}
        FROM confusion""",
    "m13_roc": f"""
        SELECT {rounded("threshold", "threshold")}, {big("tp", "tp")}, {big("fp", "fp")},
               {rounded("tp / CAST((SELECT COUNT(*) FROM judged WHERE won) AS DOUBLE)", "tpr")},
               {rounded("fp / CAST((SELECT COUNT(*) FROM judged WHERE NOT won) AS DOUBLE)", "fpr")}
        FROM roc""",
    "m13_auc": f"""
        SELECT {rounded("(SUM(CASE WHEN won THEN r END) - SUM(CASE WHEN won THEN 1 ELSE 0 END) * (SUM(CASE WHEN won THEN 1 ELSE 0 END) + 1) / CAST(2 AS DOUBLE)) / (SUM(CASE WHEN won THEN 1 ELSE 0 END) * CAST(SUM(CASE WHEN won THEN 0 ELSE 1 END) AS DOUBLE))", "auc")}
        FROM (SELECT won, RANK() OVER (ORDER BY predicted)
                + (COUNT(*) OVER (PARTITION BY predicted) - 1) / CAST(2 AS DOUBLE) AS r
              FROM judged) x""",
    "m14_extract_predictions": f"""
        SELECT matchid, team_name, op_team_name, {rounded("avg_points / 3 * 100", "predicted")},
               CASE WHEN avg_points / 3 * 100 >= 50 THEN team_name ELSE op_team_name END AS expected,
               points, CASE WHEN points = 3 THEN team_name WHEN points = 0 THEN op_team_name
                            ELSE 'draw' END AS winner
        FROM side WHERE place_in_match = 1""",
    "m15_normalize": f"""
        SELECT matchid, teamid, goals,
               {rounded("goals / CAST((SELECT SUM(goals) FROM score) AS DOUBLE)", "share")}
        FROM score""",
    "m16_games": f"SELECT {FEATURES} FROM side WHERE place_in_match = 1",
    "m17_check_eq": f"SELECT {_PAIR_KEYS}, points = 3 AS won FROM features",
    "m18_build_team_matrix": f"""
        SELECT competitionid, matchid, seasonid, first_team, second_team,
               {rounded("(1 + first_home * 0.25) / discount", "first_weight")},
               {rounded("-(1 + second_home * 0.25) / discount", "second_weight")}, result
        FROM discounted""",
    "m19_build_power": "SELECT competitionid, teamid, CAST(power AS DOUBLE) AS power FROM power_step",
    "m19_build_power_unsnapped": f"""
        SELECT competitionid, teamid, {rounded("power", "power")} FROM scaled_strength""",
    "m21_with_power": f"""
        SELECT {_OUTCOMES}, {rounded_all(HISTORY)},
               CAST(COALESCE(p.power, 0.5) AS DOUBLE) AS power_points
        FROM features LEFT JOIN power_of_team p USING (teamid)""",
    "m22_home_advantage": """
        SELECT matchid, teamid, op_teamid, team_name, op_team_name,
               (teamid % 11) / CAST(10 AS DOUBLE) AS is_home, competitionid, seasonid,
               kickoff AS timestamp FROM match_games""",
}
QUERIES["m12_validate_with_auc"] = f"""
        SELECT {big("tp", "tp")}, {big("fp", "fp")}, auc
        FROM confusion, ({QUERIES["m13_auc"]}) a"""
