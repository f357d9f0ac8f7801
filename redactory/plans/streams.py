"""Streaming queries; their SQL is the batch twin."""

from __future__ import annotations

from redactory.plans.activity import SQL as _BATCH
from redactory.plans.activity import STATS
from redactory.streaming import live

QUERIES = {
    "stream_counters": live.platform_counters, "stream_sessions": live.session_counters, "stream_dedupe": live.first_announcements, "stream_conversations": live.conversation_announcements,
    "stream_settings": live.answered_with_settings, "stream_restore": live.restored_answers, "stream_passes": live.debounced_passes, "stream_growing": live.growing_mapping,
    "stream_resets": live.announcements_after_resets,
}
#: Events of a session in order, as its clock reads; the fold below is that of a session's passes.
_EVENTS = "SELECT user_id AS session, event_id, epoch_ms(ts) // 200000 AS tick, event_type FROM events"
_DUE = "(a.due IS NOT NULL AND a.due <= x.tick)"
_LAST, _PAIRS = f"CASE WHEN {_DUE} THEN a.due ELSE a.last_pass END", "a.n_pairs + CASE WHEN x.is_pair THEN 1 ELSE 0 END"
_SINCE = f"(x.tick - ({_LAST}))"
_NOW = f"({_PAIRS} > 0 AND {_SINCE} >= 600)"
_FOLDED = f"""folded AS MATERIALIZED (SELECT session, list_reduce(list({{'tick': tick, 'is_pair': event_type = 'signup'}} ORDER BY tick, event_id), lambda a, x: {{
    'last_pass': CASE WHEN {_NOW} THEN x.tick ELSE {_LAST} END,
    'due': CASE WHEN {_NOW} OR {_PAIRS} = 0 THEN NULL ELSE x.tick + least(180, 600 - {_SINCE}) END,
    'n_pairs': {_PAIRS},
    'known': CASE WHEN {_NOW} THEN {_PAIRS} WHEN {_DUE} THEN a.n_pairs ELSE a.known END,
    'seen': CASE WHEN {_NOW} THEN a.n_seen + 1 WHEN {_DUE} THEN a.n_seen ELSE a.seen END,
    'n_seen': a.n_seen + 1,
    'passes': list_concat(list_concat(a.passes, CASE WHEN {_DUE} THEN [a.due] ELSE [] END), CASE WHEN {_NOW} THEN [x.tick] ELSE [] END)}},
    {{'last_pass': CAST(-600 AS BIGINT), 'due': CAST(NULL AS BIGINT), 'n_pairs': CAST(0 AS BIGINT), 'known': CAST(0 AS BIGINT), 'seen': CAST(0 AS BIGINT), 'n_seen': CAST(0 AS BIGINT), 'passes': CAST([] AS BIGINT[])}}) AS f
  FROM ({_EVENTS}) GROUP BY session),
passed AS MATERIALIZED (SELECT session, f, f.due IS NOT NULL AND f.due <= (SELECT max(tick) FROM ({_EVENTS})) AS at_end FROM folded)"""
SQL = {
    "stream_counters": _BATCH["platform_counts"],
    "stream_sessions": _BATCH["session_counters"],
    "stream_dedupe": f"SELECT kind, item FROM ({_BATCH['activity_dedupe']})",
    "stream_conversations": f"SELECT DISTINCT session_id, kind, item FROM {STATS}",
    "stream_settings": f"""SELECT platform, count(*) AS n_messages FROM (SELECT *, last_value(CASE WHEN event_type = 'purchase' THEN event_id % 2 = 0 END IGNORE NULLS) OVER (PARTITION BY session ORDER BY tick, event_id) AS is_on,
      'p' || session % 3 AS platform FROM ({_EVENTS})) WHERE event_type <> 'purchase' AND coalesce(is_on, true) GROUP BY platform""",
    "stream_passes": f"WITH {_FOLDED} SELECT session, unnest(list_concat(f.passes, CASE WHEN at_end THEN [f.due] ELSE [] END)) AS \"at\" FROM passed",
    "stream_growing": f"""WITH {_FOLDED}, numbered AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY tick, event_id) AS no,
        CASE WHEN event_type = 'signup' THEN row_number() OVER (PARTITION BY session, event_type ORDER BY tick, event_id) END AS pair_no FROM ({_EVENTS})),
      known AS (SELECT DISTINCT session, event_id % 7 AS k FROM numbered JOIN passed USING (session) WHERE pair_no <= CASE WHEN at_end THEN f.n_pairs ELSE f.known END)
      SELECT n.session, event_id AS id, 'see ' || CASE WHEN k.k IS NULL THEN 'F' ELSE 'R' END || event_id % 7 || ' now' AS shown
      FROM numbered n JOIN passed USING (session) LEFT JOIN known k ON k.session = n.session AND k.k = n.event_id % 7
      WHERE event_type <> 'signup' AND no <= CASE WHEN at_end THEN f.n_seen ELSE f.seen END""",
    "stream_resets": f"""SELECT session, 'F' || k AS name, count(DISTINCT epoch) AS n FROM (SELECT *, event_id % 7 AS k, count(CASE WHEN event_type = 'error' THEN 1 END) OVER (PARTITION BY session ORDER BY tick, event_id) AS epoch FROM ({_EVENTS}))
      WHERE event_type <> 'error' GROUP BY session, k""",
    "stream_restore": "SELECT o_orderkey AS id, c_name || ' and not Client ' || o_custkey || '0x' AS restored FROM orders JOIN customer ON c_custkey = o_custkey",
}
