from test_narrow_shuffles import prepared, shuffle_joins

from touchline.operators import probability, scores, summaries
from touchline.functions.counters import shot_outcomes
from touchline.sources.tables import materialise


def test_player_shares_are_summed_after_the_shuffle(spark):
    summary = materialise(summaries.game_summary(*prepared(spark), extra=shot_outcomes()))
    for table in (lambda: probability.probability(summary, "pass"), lambda: scores.transition_counts(summary)):
        found, = shuffle_joins(spark, table)
        assert not [name for name in found if name.startswith("sum")]


def test_position_shares_are_summed_before_it(spark):
    summary = materialise(summaries.game_summary(*prepared(spark)))
    found, = shuffle_joins(spark, lambda: probability.probability(summary, "pass", probability.POSITION))
    assert [name for name in found if name.startswith("sum")]
