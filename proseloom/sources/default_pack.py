"""The rule pack that stands where none is given."""

from __future__ import annotations

from functools import lru_cache

from proseloom.sources.pack import DETECTORS, Pack, Phrase, Tier, _build

# The words of the three tiers, and the phrases as (match, fix, category, weight); no fix means that a phrase is only
# found, an empty one that it is deleted.
TIER1 = (
    "delve delves delving delved tapestry testament pivotal intricate intricacies showcase showcases showcasing showcased foster fosters fostering fostered garner garners garnered garnering "
    "interplay enduring vibrant crucial meticulous meticulously seamless seamlessly groundbreaking leverage leverages leveraging leveraged synergy synergies transformative paramount multifaceted "
    "myriad cornerstone empower empowers empowering empowered catalyst catalyze catalyzing nestled realm bustling renowned invaluable actionable impactful learnings robust embark embarks embarking "
    "embarked underscore underscores underscoring underscored unparalleled ever-evolving game-changer game-changing"
).split()
TIER2 = (
    "additionally furthermore moreover notably consequently subsequently accordingly nonetheless comprehensive paradigm holistic holistically utilize utilizes utilizing utilized facilitate "
    "facilitates facilitating facilitated nuanced elucidate illuminate encompass encompasses encompassing streamline streamlines streamlining streamlined spearhead spearheading bolster bolstering "
    "poised cutting-edge harness harnessing harnessed unleash unleashing revolutionize reimagine elevate elevating alleviate alleviating cadence quintessential ubiquitous proactive endeavor endeavour"
).split()
TIER3 = "significant effective unique compelling exceptional essential valuable innovative notable".split()
PHRASES = [
    ("in order to", "to", "filler", 3), ("due to the fact that", "because", "filler", 3), ("at this point in time", "now", "filler", 3), ("in the event that", "if", "filler", 3),
    ("has the ability to", "can", "filler", 3), ("have the ability to", "can", "filler", 3), ("it is important to note that", "", "filler", 4), ("it is worth noting that", "", "filler", 4),
    ("it should be noted that", "", "filler", 4), ("at the end of the day", "", "filler", 3), ("for the purpose of", "to", "filler", 3), ("in light of the fact that", "because", "filler", 3),
    ("first and foremost", "first", "filler", 3), ("last but not least", "finally", "filler", 3), ("in the realm of", "in", "filler", 4), ("when it comes to", None, "filler", 2),
    ("in today's digital age", None, "significance", 5), ("in today's fast-paced", None, "significance", 5), ("in today's rapidly evolving", None, "significance", 5),
    ("plays a crucial role", None, "significance", 5), ("harness the power of", None, "significance", 5), ("embark on a journey", None, "significance", 5), ("paradigm shift", None, "significance", 4),
    ("deep dive", None, "jargon", 3), ("move the needle", None, "jargon", 3), ("low-hanging fruit", None, "jargon", 3), ("pain points", "problems", "jargon", 3), ("circle back", None, "jargon", 3),
    ("double-click on", None, "jargon", 3), ("best practices", None, "jargon", 2), ("thought leader", None, "jargon", 3), ("state-of-the-art", None, "promotional", 3),
    ("world-class", None, "promotional", 3), ("must-visit", None, "promotional", 4), ("breathtaking", None, "promotional", 4), ("rich cultural heritage", None, "promotional", 4),
    ("commitment to excellence", None, "promotional", 4), ("in the heart of", None, "promotional", 3),
]


@lru_cache
def default_pack() -> Pack:
    return _build([Phrase(*p) for p in PHRASES], [Tier(1, 5, tuple(TIER1)), Tier(2, 3, tuple(TIER2), min_distinct=2), Tier(3, 1, tuple(TIER3), max_density_pct=1.5)], DETECTORS)
