"""All queries of the core, by name, and the SQL each is checked with."""

from __future__ import annotations

from convolens.plans import derived, episodes, explore, features, intervals, io, keywords, labels, matching, reports, search, segments, speakers

QUERIES, ORACLE = {}, {}
for _module in (intervals, speakers, segments, features, keywords, labels, search, explore, episodes, matching, io, derived, reports):
    QUERIES |= _module.QUERIES
    ORACLE |= _module.ORACLE

FLAGSHIP = "episode_features"
