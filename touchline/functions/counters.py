"""The event counters, declared as data.

A counter is a test on the event and, for most, a test on one qualifier's type
and pass band. The same declaration serves both grains:

* qualifier grain (the default): one row per (event, qualifier), so a counter
  without a qualifier test counts an event once per qualifier;
* event grain: one row per event, the qualifier test asks for any match.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from touchline import schema
from touchline.functions.expressions import bucket

QualifierTest = Callable[[Column, Column], Column]


@dataclass(frozen=True)
class Counter:
    name: str
    event: Column
    qualifier: QualifierTest | None = None

    def on_qualifier_row(self) -> Column:
        if self.qualifier is None:
            return self.event
        return self.event & self.qualifier(F.col("type"), F.col("band"))

    def on_event_row(self) -> Column:
        if self.qualifier is None:
            return self.event
        return self.event & F.exists("qualifiers", lambda q: self.qualifier(q["type"], q["band"]))


BANDS = range(len(schema.X_EDGES) + 1)
PASSES = [f"pass_{band}" for band in BANDS]
PASS_ATTEMPTS = [f"pass_attempt_{band}" for band in BANDS]

# set piece -> (qualifier types, name of the attempts, name of those on target)
SET_PIECES = {
    "corner_kick": ((schema.CORNER_KICK,), "corner_kick_attempts", "corner_kicks_ontarget"),
    "penalty_kick": ((schema.PENALTY,), "penalty_kick_attempts", "penalty_kicks_ontarget"),
    "free_kick": (schema.FREE_KICK, "free_kick_attempts", "free_kicks_ontarget"),
    "throwin": ((schema.THROW_IN,), "throwin_attempts", "throwins_ontarget"),
}


def _one_of(*types: int) -> QualifierTest:
    return lambda kind, _: kind.isin(*types)


def _none_of(*types: int) -> QualifierTest:
    return lambda kind, _: ~kind.isin(*types)


def _ends_in(band: int) -> QualifierTest:
    return lambda _, pass_band: pass_band == band


def pass_end(kind: Column, value: Column) -> Column:
    """Where a pass ends, from the qualifier that tells it."""
    return F.when(kind == schema.PASS_END_X, value.try_cast("double"))


def pass_band(end_x: Column) -> Column:
    """The band of the field a pass ends in; NULL for other qualifiers."""
    return F.when(end_x.isNotNull(), bucket(end_x, schema.X_EDGES))


def counters() -> list[Counter]:
    """All 34 counters in output order."""
    typeid = F.col("typeid")
    done = F.col("outcomeid") == 1
    passing = typeid == schema.PASS
    saving = typeid == schema.SAVE
    shot = typeid.isin(*schema.SHOTS)
    on_target = typeid.isin(*schema.SHOTS_ON_TARGET)
    goal = (typeid == schema.GOAL) & done
    intercepting = typeid.isin(*schema.INTERCEPTIONS)
    tackling = typeid == schema.TACKLE
    open_play = _none_of(*schema.SET_PIECES_AND_OWN_GOALS)

    result = [
        Counter("fouls", (typeid == schema.FOUL) & done),
        Counter("outs", (typeid == schema.OUT) & done),
        Counter("yellow_cards", typeid == schema.CARD, _one_of(schema.YELLOW)),
        Counter("red_cards", typeid == schema.CARD, _one_of(*schema.RED)),
    ]
    result += [Counter(PASSES[band], passing & done, _ends_in(band)) for band in BANDS]
    result += [Counter(PASS_ATTEMPTS[band], passing, _ends_in(band)) for band in BANDS]
    result += [
        Counter("save", saving & done, _none_of(schema.NOT_A_SAVE)),
        Counter("save_attempts", saving, _none_of(schema.NOT_A_SAVE)),
    ]
    for types, attempts, hits in SET_PIECES.values():
        result += [
            Counter(attempts, shot, _one_of(*types)),
            Counter(hits, on_target, _one_of(*types)),
        ]
    result += [
        Counter("shot_attempts", typeid.isin(*schema.SHOTS_OFF_TARGET), open_play),
        Counter("shots_ontarget", on_target, open_play),
        Counter("goals", goal, _none_of(schema.OWN_GOAL)),
        Counter("own_goals", goal, _one_of(schema.OWN_GOAL)),
        Counter("intercepts", intercepting & done),
        Counter("intercept_attempts", intercepting),
        Counter("tackles", tackling & done),
        Counter("tackle_attempts", tackling),
    ]
    return result


def shot_outcomes() -> list[Counter]:
    """Shots by set piece and result; no row counts in two of them."""
    goal = (F.col("typeid") == schema.GOAL) & (F.col("outcomeid") == 1)
    missed = F.col("typeid").isin(*schema.SHOTS) & (F.col("typeid") != schema.GOAL)
    pieces = [kind for types, _, _ in SET_PIECES.values() for kind in types]
    result = [
        Counter("regular_goals", goal, _none_of(schema.OWN_GOAL, *pieces)),
        Counter("regular_missed", missed, _none_of(*schema.SET_PIECES_AND_OWN_GOALS, *pieces)),
    ]
    for piece, (types, _, _) in SET_PIECES.items():
        result += [
            Counter(f"{piece}_goals", goal, _one_of(*types)),
            Counter(f"{piece}_missed", missed, _one_of(*types)),
        ]
    return result


COUNTED_TYPES = (
    schema.PASS, schema.FOUL, schema.OUT, schema.TACKLE, *schema.INTERCEPTIONS,
    schema.SAVE, *schema.SHOTS, schema.CARD,
)


def countable() -> list[Counter]:
    """The rows that may be counted and do count in some counter.

    Shots need outcome 1. A shot with a free-kick-shot or own-goal qualifier
    counts only as a goal, and one without any qualifier not at all.
    """
    typeid = F.col("typeid")
    done = F.col("outcomeid") == 1
    neither = _none_of(schema.FREE_KICK_SHOT, schema.OWN_GOAL)
    return [
        Counter("stopped play", typeid.isin(schema.FOUL, schema.OUT) & done),
        Counter("won ball", typeid.isin(schema.TACKLE, *schema.INTERCEPTIONS)),
        Counter("save", typeid == schema.SAVE, _none_of(schema.NOT_A_SAVE)),
        Counter("pass", typeid == schema.PASS, lambda _, band: band.isNotNull()),
        Counter("goal", (typeid == schema.GOAL) & done, lambda kind, _: kind.isNotNull()),
        Counter("shot", typeid.isin(*schema.SHOTS) & done, neither),
        Counter("card", typeid == schema.CARD, _one_of(schema.YELLOW, *schema.RED)),
    ]


# Counters that add up to the three composite counts.
ATTEMPTS_IN_OPEN_PLAY = ["fouls", "outs", *PASS_ATTEMPTS, "shot_attempts"]
COMPOSITES = {
    "event_count": [
        *ATTEMPTS_IN_OPEN_PLAY, "yellow_cards", "red_cards",
        *[attempts for _, attempts, _ in SET_PIECES.values()],
        "save_attempts", "intercept_attempts",
    ],
    "offense_event_count": ATTEMPTS_IN_OPEN_PLAY,
    "defense_event_count": ["fouls", "tackle_attempts", "intercept_attempts", "save_attempts"],
}

# Counters of the cumulative state; the pass bands are merged into two totals.
STATE_COUNTERS = {
    "fouls": ["fouls"],
    "outs": ["outs"],
    "red_cards": ["red_cards"],
    "yellow_cards": ["yellow_cards"],
    "pass": PASSES,
    "pass_attempts": PASS_ATTEMPTS,
    "save": ["save"],
    "save_attempts": ["save_attempts"],
    **{name: [name] for _, attempts, hits in SET_PIECES.values() for name in (hits, attempts)},
    **{
        name: [name]
        for name in (
            "shots_ontarget", "shot_attempts", "goals", "own_goals",
            "intercepts", "intercept_attempts", "tackles", "tackle_attempts",
        )
    },
}
