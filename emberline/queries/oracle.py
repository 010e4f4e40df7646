"""Building blocks of the checking SQL: named subqueries and their needs.

The checking SQL is written independently of the Spark operators: close pairs by
a plain predicate, components by recursion, ranks by window functions.
"""

from __future__ import annotations

from emberline import fixtures


def half_up(expression: str, digits: int) -> str:
    """Text of the display rounding used for aggregates."""
    scale = f"CAST({10**digits} AS DOUBLE)"
    return f"(floor(({expression})*{scale}+CAST(0.50001 AS DOUBLE))/{scale})"


def key_round(expression: str, digits: int) -> str:
    scale = f"CAST({10**digits} AS DOUBLE)"
    return f"(floor(({expression})*{scale}+CAST(0.5 AS DOUBLE))/{scale})"


OBS = fixtures.OBSERVATIONS.format(events="events")

# name -> (needs, text)
PARTS: dict[str, tuple[tuple[str, ...], str]] = {
    "obs": ((), f"SELECT * EXCLUDE (loc) FROM ({OBS})"),
    "raw": ((), fixtures.RAW_DETECTIONS.replace("{observations}", OBS)),
    "facilities": ((), fixtures.FACILITIES.format(supplier="supplier")),
    "points": ((), fixtures.QUERY_POINTS.format(nation="nation")),
    "slim": (("obs",), "SELECT obs_id, latitude AS lat, longitude AS lon, epoch_us(timestamp) AS t, "
                       "CAST(floor(latitude*50) AS BIGINT) AS ci, CAST(floor(longitude*50) AS BIGINT) AS cj FROM obs"),
    "spread": (("slim",), "SELECT s.*, s.ci+di.i AS ni, s.cj+dj.j AS nj FROM slim s, (VALUES (-1),(0),(1)) di(i), (VALUES (-1),(0),(1)) dj(j)"),
    "close_pairs": (("slim", "spread"), """
SELECT a.obs_id AS x, b.obs_id AS y FROM spread a JOIN slim b ON a.ni=b.ci AND a.nj=b.cj
WHERE a.obs_id<b.obs_id AND abs(a.t-b.t)<=259200000000
 AND sqrt(pow(111200*(a.lat-b.lat),2)+pow(111200*cos(radians((a.lat+b.lat)/2))*(a.lon-b.lon),2))<=1000"""),
    "both_ways": (("close_pairs",), "SELECT x, y FROM close_pairs UNION ALL SELECT y, x FROM close_pairs"),
    "reach": (("obs", "both_ways"), """
SELECT obs_id AS n, obs_id AS root FROM obs
UNION SELECT e.y, r.root FROM reach r JOIN both_ways e ON e.x=r.n WHERE r.root<e.y"""),
    "component": (("reach",), "SELECT n AS obs_id, min(root) AS event_id FROM reach GROUP BY n"),
    "linked": (("obs", "component"), "SELECT o.*, c.event_id FROM obs o JOIN component c USING (obs_id)"),
}


def sql(final: str, *needs: str, **extra: tuple[tuple[str, ...], str]) -> str:
    """A WITH RECURSIVE statement holding ``needs`` (and what they need) before ``final``."""
    parts = {**PARTS, **extra}
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for need in parts[name][0]:
            visit(need)
        ordered.append(name)

    for name in needs:
        visit(name)
    body = ",\n".join(f"{name} AS ({parts[name][1]})" for name in ordered)
    return f"WITH RECURSIVE {body}\n{final}" if ordered else final


def trend(first: str, second: str) -> str:
    limit = f"CASE WHEN {first}<>0 THEN abs({first})*0.1::DOUBLE ELSE 1.0::DOUBLE END"
    return (f"CASE WHEN {first} IS NULL OR {second} IS NULL THEN 'UNKNOWN' WHEN {second}-{first}>({limit}) THEN 'INCREASING' "
            f"WHEN {second}-{first}< -({limit}) THEN 'DECREASING' ELSE 'STABLE' END")


PARTS.update({
    "ranked": (("linked",), "SELECT *, CAST(timestamp AS DATE) AS day, row_number() OVER (PARTITION BY event_id ORDER BY timestamp, obs_id) AS rn, "
                            "count(*) OVER (PARTITION BY event_id) AS size FROM linked"),
    "wide": (("ranked",), """SELECT event_id, count(*) AS total_detections, count(DISTINCT day) AS active_days,
 avg(intensity) AS mean_i, var_pop(intensity) AS var_i, var_pop(latitude)+var_pop(longitude) AS var_place,
 min(timestamp) AS first_detection, max(timestamp) AS last_detection,
 avg(CASE WHEN rn<=size//2 THEN intensity END) AS f, avg(CASE WHEN rn>size//2 THEN intensity END) AS s
 FROM ranked GROUP BY event_id"""),
    "metrics": (("wide",), f"""SELECT event_id, total_detections, active_days,
 {half_up('total_detections/CAST(active_days AS DOUBLE)', 2)} AS persistence_score,
 {half_up('mean_i', 2)} AS average_intensity, {half_up('var_i', 2)} AS intensity_variance,
 CASE WHEN total_detections>1 THEN {half_up('var_place', 8)} END AS spatial_stability,
 first_detection, last_detection,
 CASE WHEN total_detections<4 THEN 'UNKNOWN' ELSE {trend('f', 's')} END AS trend FROM wide"""),
    "summary": (("linked",), """SELECT event_id, avg(latitude) AS latitude, avg(longitude) AS longitude,
 min(timestamp) AS start_time, max(timestamp) AS end_time, count(*) AS observation_count FROM linked GROUP BY event_id"""),
    "ev": (("summary", "metrics"), """SELECT s.*, m.active_days, m.persistence_score, m.trend, m.average_intensity,
 CASE WHEN epoch_us((SELECT max(timestamp) FROM linked))-epoch_us(s.end_time)>72*3600000000 THEN 'RESOLVED'
  WHEN m.active_days>=2 AND s.observation_count>=3 THEN 'PERSISTENT' ELSE 'ACTIVE' END AS status
 FROM summary s JOIN metrics m USING (event_id)"""),
})
