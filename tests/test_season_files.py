from touchline.plans.refresh import store_goals
from touchline.sources import fixture

SF_DIR = "/root/testdata/sf0.001"


def test_seasons_are_written_by_several_tasks_one_file_each(spark, tmp_path):
    games = fixture.match_games(spark, SF_DIR)
    store_goals(fixture.touches(spark, SF_DIR), games, str(tmp_path / "goals"))
    files = list((tmp_path / "goals").rglob("*.parquet"))
    assert len(files) == len({f.parent for f in files}) == games.select("competitionid", "seasonid").distinct().count()
    assert len({f.name.split("-")[1] for f in files}) > 1  # the number of the task
