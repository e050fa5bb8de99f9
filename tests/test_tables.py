import json

import pytest
from micro import line_up, match_games, touch, touches
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from touchline.operators import scores
from touchline.operators.documents import document_lines, read_documents, write_documents
from touchline.plans import refresh
from touchline.plans.player_tables import (
    write_player_tables,
    write_probability_bundle,
    write_state_document,
)
from touchline.sources import tables


def test_home_advantage_csv(spark, tmp_path):
    file = tmp_path / "home.csv"
    file.write_text("Team,power_ranking,teamid,is_home\nCote d'Ivoire,809,1221,0\nBrazil,1242,614,0.8\n")
    rows = tables.read_home_advantage(spark, str(file)).collect()
    assert [tuple(r) for r in rows] == [("Cote d'Ivoire", 809, 1221, 0.0), ("Brazil", 1242, 614, 0.8)]


def test_player_models_json(spark, tmp_path):
    file = tmp_path / "player.json"
    file.write_text(json.dumps({"position": "forward", "move": [0, 0.5], "probability": [[0, 0.1], [0.2]]}, indent=1))
    row = tables.read_player_models(spark, str(file)).first()
    assert (row.position, row.move, row.probability) == ("forward", [0.0, 0.5], [[0.0, 0.1], [0.2]])


def test_write_replaces_and_views(spark, tmp_path):
    path = str(tmp_path / "table")
    tables.write_table(spark.range(5), path)
    tables.write_table(spark.range(3), path)
    assert tables.read_table(spark, path).count() == 3
    tables.create_view(spark.range(2), "some_view")
    tables.create_view(spark.range(4), "some_view")
    assert tables.read_table(spark, "some_view").count() == 4


def test_dataset_holds_tables(spark):
    tables.create_dataset(spark, "season")
    tables.create_dataset(spark, "season")
    tables.write_table(spark.range(2), "season.games")
    tables.write_table(spark.range(7), "season.games")
    assert tables.read_table(spark, "season.games").count() == 7


def test_json_keeps_nulls(spark, tmp_path):
    frame = spark.sql("SELECT 1 AS team, 2 AS a, CAST(NULL AS INT) AS b")
    assert tables.json_rows(frame, "team").first().value == '{"a":2,"b":null}'
    tables.write_json(frame, str(tmp_path / "json"), "team")
    assert list((tmp_path / "json").glob("team=1/*.json"))


def test_materialise_keeps_rows_and_schema(spark):
    frame = touches(spark, [touch(1, qualifiers=[(140, "1")])])
    stored = tables.materialise(frame)
    assert stored.schema == frame.schema and stored.collect() == frame.collect()


def test_player_tables_are_written(spark, tmp_path):
    raw = touches(spark, [touch(4, qualifiers=[(13, "")], second=9), *line_up((1, 101))])
    write_player_tables(raw, str(tmp_path))
    for name, rows in (("position_summary", 1), ("game_summary", 1), ("move_summary", 2), ("touches_summary", 1)):
        assert spark.read.parquet(str(tmp_path / name)).count() == rows
    write_probability_bundle(spark, str(tmp_path), str(tmp_path / "bundle"), 1)
    write_state_document(spark, str(tmp_path), str(tmp_path / "state"), 1)
    for name, table, size in (("bundle", "move", 2), ("state", "state", 1)):
        parts = sorted((tmp_path / name).glob("part-*"))
        assert len(json.loads("".join(p.read_text() for p in parts))[table]) in (1, size)


def test_without_a_checkpoint_folder_the_warehouse_is_shared():
    class Session:
        class sparkContext:
            class getConf:
                def get(self, key, default=None):
                    return default

            getCheckpointDir = staticmethod(lambda: None)

        class conf:
            get = staticmethod({"spark.sql.warehouse.dir": "/shared/warehouse"}.get)

    assert tables.shared_folder(Session) == "/shared/warehouse"


def test_stored_tables_are_deleted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "shared_folder", lambda _: str(tmp_path))
    with tables.stored_tables(spark) as folder:
        assert tables.materialise(spark.range(3)).count() == 3
        assert any(tmp_path.rglob("*.parquet"))
        name = tables.run_table(spark, "kept")
        spark.range(2).write.saveAsTable(name)
    assert not spark.catalog.tableExists(name)
    assert folder.startswith(str(tmp_path)) and not any(tmp_path.rglob("*.parquet"))


@pytest.mark.parametrize("configured", ["/some/folder/", "/some/folder"])
def test_configured_folder_is_used(configured):
    class Conf:
        def get(self, key, default=None):
            return configured

    class Session:
        class sparkContext:
            getConf = staticmethod(Conf)

    assert tables.shared_folder(Session) == "/some/folder"


def test_broken_player_documents_are_reported(spark, tmp_path):
    good = {"playerid": 3, "position": "forward", "move": [0, 0.5], "probability": [[0, 0.1], []]}
    (tmp_path / "players.json").write_text(json.dumps(good) + "\n{\"playerid\": 4, \"move\": [0,\n" + json.dumps(good | {"move": "x"}) + "\n")
    models = tables.materialise(tables.read_player_models(spark, str(tmp_path / "players.json"), one_per_file=False))
    sound, broken = tables.split_broken(models)
    assert [r.playerid for r in sound.collect()] == [3]
    assert sorted(r.text[:17] for r in broken.collect()) == ['{"playerid": 3, "', '{"playerid": 4, "']
    assert all(r.file.endswith("players.json") for r in broken.collect())
    rows = {tuple(r) for r in scores.model_thresholds(sound).select("kind", "section", "transition", "threshold").collect()}
    assert rows == {("move", 0, None, 0.0), ("move", 1, None, 0.5), ("probability", 0, 0, 0.0), ("probability", 0, 1, 0.1)}


def test_a_broken_file_among_single_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"position": "forward", "move": [0]}, indent=1))
    (tmp_path / "b.json").write_text("{ not a document")
    sound, broken = tables.split_broken(tables.materialise(tables.read_player_models(spark, str(tmp_path))))
    assert sound.count() == 1 and broken.first().file.endswith("b.json")


def test_catalog_view_outlives_temporary_ones(spark):
    tables.create_dataset(spark, "views")
    tables.write_table(spark.range(6), "views.numbers")
    spark.range(3).createOrReplaceTempView("passing")
    with pytest.raises(AnalysisException):
        tables.create_catalog_view(spark, "views", "bad", "SELECT * FROM passing")
    for least in (1, 4):  # dropped if it exists
        name = tables.create_catalog_view(spark, "views", "big", f"SELECT id FROM views.numbers WHERE id >= {least}")
    spark.catalog.dropTempView("passing")
    assert sorted(r.id for r in spark.table(name).collect()) == [4, 5]
    assert not spark.catalog.tableExists("views.bad")


def season_touches(spark, goals):
    """Matches 1 and 2 of season 2014, 3 of 2015; (match, team, goals)."""
    rows = []
    for match, team, count in goals:
        rows += line_up((team, team * 100), matchid=match)
        rows += [touch(16, matchid=match, teamid=team, playerid=team * 100, eventid=i, second=i) for i in range(count)]
    return touches(spark, rows)


def test_refresh_touches_only_the_changed_seasons(spark, tmp_path):
    games = match_games(spark, [("1", 1, 2, 1, 0), ("1", 2, 1, 0, 0), ("2", 1, 2, 1, 1), ("2", 2, 1, 0, 1), ("3", 1, 2, 1, 400), ("3", 2, 1, 0, 400)])
    games = games.withColumn("seasonid", F.when(F.col("matchid") == "3", 2015).otherwise(2014).cast("int"))
    path = tmp_path / "goals"
    first = season_touches(spark, [("1", 1, 2), ("1", 2, 0), ("2", 1, 1), ("2", 2, 1), ("3", 1, 0), ("3", 2, 3)])
    refresh.store_goals(first, games, str(path))

    def files():
        return {str(f.relative_to(path)): f.stat().st_mtime_ns for f in path.rglob("*.parquet")}

    def goals():
        return {(r.matchid, r.teamid): r.goals for r in tables.read_table(spark, str(path)).collect()}

    before = files()
    later = season_touches(spark, [("1", 1, 5), ("1", 2, 0), ("2", 1, 1), ("2", 2, 1), ("3", 1, 9), ("3", 2, 9)])
    changed = spark.createDataFrame([("1",)], "matchid string")
    refresh.refresh_goals(later, games, changed, str(path))
    assert goals() == {("1", 1): 5, ("1", 2): 0, ("2", 1): 1, ("2", 2): 1, ("3", 1): 0, ("3", 2): 3}
    kept = {f for f in before if "seasonid=2015" in f}
    assert kept and all(files()[f] == before[f] for f in kept) and not (set(before) - kept) & set(files())
    refresh.refresh_goals(later, games, changed.limit(0), str(path))
    assert goals()[("1", 1)] == 5


@pytest.mark.parametrize("slices", [1, 7])
def test_all_documents_from_one_job(spark, tmp_path, slices):
    """Slices of a document lie in files whose names put them in order."""
    rows = [(t, k, i, f'{{"n":{i}}}') for t in (1, 2, 3) for k in (0, 1) for i in range(40 if t == 2 else 2) if (t, k) != (3, 1)]
    frame = spark.createDataFrame(rows, "team int, table int, i int, value string").repartition(5)
    lines = document_lines(frame, ["team"], ["first", "second"], ["i"])
    write_documents(lines, "team", ["i"], str(tmp_path / "docs"), slices)
    for team in (1, 2, 3):
        files = sorted((tmp_path / "docs" / f"team={team}").glob("part-*"))
        document = json.loads("".join(f.read_text() for f in files))
        assert document == {name: [{"n": i} for t, k, i, _ in rows if (t, k) == (team, n)] for n, name in enumerate(("first", "second"))}
        assert len(files) > 1 or slices == 1 or team != 2
    back = read_documents(spark, str(tmp_path / "docs"), "team").collect()
    assert sorted((r.team, r.table, json.loads(r.value)["n"]) for r in back) == sorted((t, ("first", "second")[k], i) for t, k, i, _ in rows)
