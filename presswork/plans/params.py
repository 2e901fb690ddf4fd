"""Parameter sets used by the registered queries.

The default keyword tables hardly ever occur in the driver's synthetic
prose, so each rule operator is also registered with a rule set made of
frequent words of that prose; that exercises every branch (all categories,
all severity levels) on the same tables.
"""

from __future__ import annotations

FREQ_CATEGORY_RULES: list[tuple[str, list[str]]] = [
    ("c_que", ["que", "sch"]),
    ("c_the", ["the ", "and"]),
    ("c_der", ["der", "die "]),
    ("c_ing", ["ing", "tion"]),
]
FREQ_SEVERITY_HIGH: list[str] = ["eriner", "attion", "thanedble"]
FREQ_SEVERITY_MED: list[str] = ["the", "and", "ou", "ei"]
FREQ_TIERS: list[tuple[str, list[str]]] = [
    ("alta", ["eriner", "que "]),
    ("media", ["the ", "der"]),
    ("baja", ["ou"]),
]

# robots rules as an input table: (host, rule_ord, allow, path_prefix)
ROBOTS_RULES: list[tuple[str, int, bool, str]] = [
    ("spam-farm.example.org", 0, False, "/"),
    ("www.cheap-pills.example.com", 0, True, "/en/4"),
    ("www.cheap-pills.example.com", 1, False, "/en/"),
    ("blog.ththan.example.net", 0, False, "/es/"),
    ("blog.ththan.example.net", 1, True, "/"),
]
