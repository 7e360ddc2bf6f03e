"""Sentiment lexicon: token valences plus the modifiers of the published valence-shifting heuristics.

``Lexicon.default()`` is a small hand-written seed. Load a full lexicon with ``Lexicon.from_dataframe``
(columns token, valence).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Seed valences on the usual -4..4 scale.
SEED = """
great 3.1; excellent 2.7; amazing 2.8; good 1.9; love 3.2; loved 2.9; nice 1.8; best 3.2; awesome 3.1; perfect 2.7;
happy 2.7; helpful 1.8; easy 1.9; fast 1.0; smooth 1.2; polite 1.6; delicious 2.5; fresh 1.3; thanks 1.9; thank 1.5;
enjoy 2.2; recommend 1.5; useful 1.9; better 1.9; like 1.5; pleased 1.9; friendly 2.2; fine 0.8; please 1.3; wish 1.7;
bad -2.5; terrible -2.1; awful -2.0; worst -3.1; poor -2.1; broken -1.5; hate -2.7; horrible -2.5; useless -1.8;
slow -1.0; rude -2.0; late -0.8; failed -2.3; fail -2.5; fails -1.8; wrong -2.1; missing -1.2; crash -1.7; crashes -1.7;
crashing -1.7; problem -1.7; problems -1.7; unable -1.2; unsafe -1.9; scam -2.7; fraud -2.8; angry -2.3; annoying -1.7;
disappointed -1.9; disappointing -2.2; blocked -1.1; declined -1.0; stale -1.2; cold -0.6; frustrating -1.9; lost -1.3;
pain -2.3; poisoning -2.2; sad -2.1; error -1.7; errors -1.4; stuck -1.0; waste -1.8; ignored -1.3; delayed -0.9
"""

# Shift sizes of the published heuristics and the words that trigger them.
BOOST, CAPS_SHIFT, NEGATION_FACTOR, NORMALISER = 0.293, 0.733, -0.74, 15.0
BOOST_DECAY = (1.0, 0.95, 0.9)
EXCLAIM_STEP, EXCLAIM_LIMIT, QUESTION_STEP, QUESTION_CEILING = 0.292, 4, 0.18, 0.96
BEFORE_BUT, AFTER_BUT = 0.5, 1.5
INTENSIFIERS = (
    "absolutely", "completely", "deeply", "especially", "extremely", "highly", "incredibly", "really", "so",
    "totally", "truly", "very",
)
DAMPENERS = ("almost", "barely", "hardly", "kinda", "less", "little", "marginally", "partly", "slightly", "somewhat")
NEGATIONS = (
    "not", "no", "never", "none", "nothing", "neither", "nor", "nowhere", "cannot", "without", "isn't", "wasn't",
    "aren't", "weren't", "don't", "doesn't", "didn't", "won't", "wouldn't", "can't", "couldn't", "shouldn't",
    "haven't", "hasn't", "hadn't", "rarely", "seldom", "despite",
)


def _seed() -> dict[str, float]:
    pairs = (entry.split() for entry in SEED.replace("\n", " ").split(";") if entry.strip())
    return {token: float(valence) for token, valence in pairs}


@dataclass(frozen=True)
class Lexicon:
    """Token valences; the size is checked because the table travels to every Python worker."""

    valences: dict[str, float] = field(default_factory=_seed)

    MAX_TOKENS = 200_000

    def __post_init__(self) -> None:
        if len(self.valences) > self.MAX_TOKENS:
            raise ValueError(f"A lexicon may hold at most {self.MAX_TOKENS:,} tokens.")

    @classmethod
    def default(cls) -> "Lexicon":
        return cls()

    @classmethod
    def from_dataframe(cls, df: DataFrame) -> "Lexicon":
        """From columns token and valence. A token that stands there twice counts with its larger valence."""
        rows = df.filter("token IS NOT NULL").groupBy("token").agg(F.max("valence").alias("valence")).limit(cls.MAX_TOKENS + 1).collect()
        return cls({r["token"]: float(r["valence"]) for r in rows})
