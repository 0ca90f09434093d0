"""Queries over audit, quarantine state and change events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import audit as A, sinks
from ledgerloom.plans.fixtures import QUEUE_SQL, queue, validation_log
from ledgerloom.plans.q_triage import DECIDE_SQL, decisions
from ledgerloom.operators.triage import apply_decisions
from ledgerloom.sources.tables import load_quarantined

Q = {}


def q(name, sql=None):
    def put(f):
        Q[name] = (f, sql)
        return f

    return put


COLUMNS = ["id", "state", "category", "resolved_by"]


def versions(s, d):
    old = queue(s, d).select(*COLUMNS)
    new = apply_decisions(queue(s, d), decisions(s, d))[0].select(*COLUMNS)
    return old, new


def trail(s, d):
    """One audit row for each settled exception but every eleventh."""
    return queue(s, d).where("state IN ('RESOLVED', 'REJECTED') AND event_id % 11 <> 0").selectExpr("'exceptionqueue' AS entity_type", "id AS entity_id", "'UPDATE' AS action", "coalesce(resolved_by, 'system') AS actor", "resolved_at AS changed_at")


TRAIL_SQL = QUEUE_SQL + ", trail AS (SELECT 'exceptionqueue' AS entity_type, id AS entity_id, 'UPDATE' AS action, coalesce(resolved_by, 'system') AS actor, resolved_at AS changed_at FROM queue WHERE state IN ('RESOLVED', 'REJECTED') AND event_id % 11 <> 0)"


@q("capture_changes", f"WITH {QUEUE_SQL}, {DECIDE_SQL} SELECT id AS entity_id, actor FROM fin WHERE ok")
def _(s, d):
    return A.capture_changes(*versions(s, d)).select("entity_id", "actor")


@q("changed_fields", f"WITH {QUEUE_SQL}, {DECIDE_SQL} SELECT id AS entity_id, list_sort(list_filter([CASE WHEN category IS DISTINCT FROM final THEN 'category' END, 'resolved_by', 'state'], lambda x: x IS NOT NULL)) AS fields FROM fin WHERE ok")
def _(s, d):
    c = A.capture_changes(*versions(s, d))
    return c.select("entity_id", A.changed_fields(F.col("old_state"), F.col("new_state")).alias("fields"))


@q("audit_query", f"WITH {TRAIL_SQL} SELECT entity_id, actor FROM trail WHERE actor = 'user-3' AND changed_at >= TIMESTAMP '2024-01-10' ORDER BY changed_at DESC, entity_id LIMIT 50 OFFSET 5")
def _(s, d):
    return A.audit_query(trail(s, d), actor="user-3", since="2024-01-10", offset=5)[0].select("entity_id", "actor")


@q("audit_query_total", f"WITH {TRAIL_SQL} SELECT count(*) AS total FROM trail WHERE entity_type = 'exceptionqueue' AND action = 'UPDATE'")
def _(s, d):
    return A.audit_query(trail(s, d), entity_type="exceptionqueue", action="UPDATE")[1]


@q("audit_integrity", f"""WITH {TRAIL_SQL}, st AS (SELECT id, id IN (SELECT entity_id FROM trail) AS seen FROM queue WHERE state IN ('RESOLVED', 'REJECTED')), n AS (SELECT count(*) AS settled, count(*) FILTER (seen) AS audited FROM st)
SELECT settled, audited, settled - audited AS missing, round(audited / nullif(settled, 0), 4) AS coverage, (SELECT list(id ORDER BY id) FROM (SELECT id FROM st WHERE NOT seen ORDER BY id LIMIT 25)) AS sample, (SELECT count(*) FROM trail WHERE actor = 'system') AS by_system FROM n""")
def _(s, d):
    return A.audit_integrity(queue(s, d), trail(s, d))


@q("actor_activity", f"WITH {TRAIL_SQL} SELECT actor, count(*) AS changes, min(changed_at) AS first, max(changed_at) AS last FROM trail GROUP BY 1 ORDER BY changes DESC, actor LIMIT 50")
def _(s, d):
    return A.actor_activity(trail(s, d))


def quarantine(s, d):
    return validation_log(s, d).where("status = 'QUARANTINED'").selectExpr("id", "stage", "validated_at AS quarantined_at", "CASE WHEN stage = 'schema' AND minute(validated_at) % 2 = 0 THEN validated_at + INTERVAL 1 HOUR END AS replayed_at")


QUARANTINE_SQL = "quarantine AS (SELECT 'VAL-' || event_id AS id, CASE WHEN event_id % 2 = 0 THEN 'schema' ELSE 'business_rule' END AS stage, ts AS quarantined_at, CASE WHEN event_id % 2 = 0 AND minute(ts) % 2 = 0 THEN ts + INTERVAL 1 HOUR END AS replayed_at FROM events WHERE event_id % 13 = 0)"


@q("load_quarantined", f"WITH {QUARANTINE_SQL} SELECT id, stage FROM quarantine WHERE replayed_at IS NULL AND stage = 'business_rule' ORDER BY quarantined_at, id LIMIT 100")
def _(s, d):
    rows = quarantine(s, d)
    return load_quarantined(rows, ids=rows.where("stage = 'business_rule'").select("id"), limit=100).select("id", "stage")


@q("mark_replayed", f"WITH {QUARANTINE_SQL} SELECT id, CASE WHEN replayed_at IS NOT NULL THEN replayed_at WHEN stage = 'business_rule' THEN TIMESTAMP '2024-02-01' END AS replayed_at FROM quarantine")
def _(s, d):
    rows = quarantine(s, d)
    return sinks.mark_replayed(rows, rows.where("stage = 'business_rule'").select("id"), "2024-02-01").select("id", "replayed_at")
