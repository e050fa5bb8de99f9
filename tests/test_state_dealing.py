from test_narrow_shuffles import prepared, shuffle_joins

from touchline.operators import state, summaries
from touchline.sources.tables import materialise


def test_document_of_states_moves_columns_once_and_no_text(spark):
    summary = materialise(summaries.game_summary(*prepared(spark)))
    stored = materialise(summaries.touches_summary(summary))
    found = shuffle_joins(spark, lambda: state.state_document(stored))
    assert not [columns for columns in found if "value" in columns]
    assert len([columns for columns in found if "goals" in columns]) == 1


def test_rows_without_a_time_appear_once(spark):
    base = spark.range(2)
    both = base.crossJoin(spark.createDataFrame([(0.5,), (None,)], "t double"))
    fixed = {"x": "CAST(id AS DOUBLE) x", "y": "1D y", "position": "'back' position", "timestamp": "t timestamp"}
    table = both.selectExpr(*[fixed.get(n, f"1L `{n}`") for n in state.STATE_COLUMNS])
    found = sorted((r.timestamp or 0, r.copies) for r in state.state_summary(table).collect())
    assert found == [(0, 1), (0, 1), (0.5, 2), (0.5, 2)]
